r"""Token ids by the tokenizers library, with the pieces of a text remembered.

White space starts a new pre-token in both vocabularies, so a text may be cut before every blank or line
feed that follows another character; the ids of a text are those of its pieces in turn. A worker
numbers the pieces it meets and keeps the ids of all of them in one array; the ids of many texts are then
one gather by piece numbers. A new piece of Latin letters and closing punctuation goes to the vocabulary's
merges directly (`model.tokenize`), any other piece through the whole tokenizer; texts with runs of white
space or unusual white space are encoded whole.
"""

from __future__ import annotations

import gc
import os
from array import array
from collections.abc import Iterable
from functools import lru_cache
from itertools import chain, compress, repeat
from operator import attrgetter

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")

#: Letters that need no care, ASCII punctuation without the apostrophe, and a piece of the former and then the latter.
_LATIN = "".join(chr(c) for c in (*range(0x41, 0x5B), *range(0x61, 0x7B), *range(0xC0, 0x100)) if c not in (0xD7, 0xF7))
_MARKS = "".join(chr(c) for c in range(0x21, 0x7F) if not chr(c).isalnum() and c != 0x27)
_SIMPLE = rf"\A[\x01\n]?[A-Za-zÀ-ÖØ-öø-ÿ]+[!-&(-/:-@\[-`{{-~]*\z"
#: Stands before the first piece of a text; a text that holds it is encoded whole.
_FIRST = "\x01"
_RUNS = ("  ", " \n", "\n ", "\n\n")
_ENDS = " \n"
#: Separators that Python splits at and the vocabularies take for symbols.
_SEPARATORS = ("\x1c", "\x1d", "\x1e", "\x1f")
#: Pieces that a worker remembers at once: bounds its memory, not what is encoded.
REMEMBERED = 400_000
#: Characters of texts that are gathered at once.
STEP = 1 << 22


def byte_letters() -> dict[int, int]:
    """Byte to code point in byte-level vocabularies: printable bytes stay, the rest follow from 256 in order."""
    printable = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    rest = iter(range(256, 512))
    return {b: b if b in printable else next(rest) for b in range(256)}


_LETTERS = byte_letters()
_BLANK = chr(_LETTERS[0x20])
_ID = attrgetter("id")


def _strings(values: pa.Array) -> list[str]:
    return values.to_numpy(zero_copy_only=False).tolist()


class _Pieces:
    """Numbers of pieces; the ids of all pieces lie one after another in `ids`. Number -1: the cut is unsafe."""

    def __init__(self):
        self.number: dict[str, int] = {}
        self.ids, self.starts = array("I"), array("q", [0])
        self.used = np.zeros(0, dtype=np.int64)

    def add(self, piece: str, ids: list[int] | None) -> int:
        if ids is None:
            self.number[piece] = -1
            return -1
        self.ids.extend(ids)
        self.number[piece] = number = len(self.starts) - 1
        self.starts.append(len(self.ids))
        return number

    def add_all(self, names: list[str], ids: np.ndarray, lengths: np.ndarray) -> range:
        """Numbers of pieces with so many of the given ids each, in turn."""
        first = len(self.starts) - 1
        self.starts.frombytes((np.cumsum(lengths) + len(self.ids)).tobytes())
        self.ids.frombytes(ids.tobytes())
        numbers = range(first, first + len(names))
        self.number.update(zip(names, numbers, strict=True))
        return numbers

    def add_composed(self, names: list[str], parts: np.ndarray) -> range:
        """Numbers of pieces that are the given parts (numbers, a row per piece) in turn."""
        ids, ends = self.gather(parts.ravel())
        base, first = len(self.ids), len(self.starts) - 1
        self.ids.frombytes(ids.tobytes())
        self.starts.frombytes((ends[parts.shape[1] - 1 :: parts.shape[1]] + base).tobytes())
        numbers = range(first, first + len(names))
        self.number.update(zip(names, numbers, strict=True))
        return numbers

    def gather(self, numbers: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of pieces one after another, and where each piece ends in them."""
        if not len(numbers) or not len(self.ids):
            return np.empty(0, dtype=np.uint32), np.zeros(len(numbers), dtype=np.int64)
        starts = np.frombuffer(self.starts, dtype=np.int64)
        lengths = (starts[1:] - starts[:-1])[numbers]
        ends = np.cumsum(lengths)
        at = np.repeat(starts[numbers] - (ends - lengths), lengths)
        at += np.arange(len(at))
        if len(self.used) < len(starts) - 1:
            self.used = np.append(self.used, np.zeros(max(len(starts), 1 << 16), dtype=np.int64))
        np.add.at(self.used, numbers, 1)
        return np.frombuffer(self.ids, dtype=np.uint32)[at], ends

    def age(self) -> None:
        """Once too many pieces are held, only those met twice since the last time stay."""
        if len(self.number) <= REMEMBERED:
            return
        numbers = np.fromiter(self.number.values(), np.int64, len(self.number))
        stays = (numbers >= 0) & (self.used[numbers] > 1)
        if stays.sum() > REMEMBERED // 2:
            stays[:] = False
        names = list(compress(self.number, stays.tolist()))
        ids, ends = self.gather(numbers[stays])
        self.number = dict(zip(names, range(len(names)), strict=True))
        self.ids, self.starts = array("I", ids.tobytes()), array("q", [0])
        self.starts.frombytes(ends.astype(np.int64).tobytes())
        self.used = np.zeros(len(names), dtype=np.int64)


class PieceEncoder:
    """Encodes texts to little-endian ids of `width` bytes (2 or 4), no special tokens added.

    With `literal` the strings of special tokens in a text are ordinary text; without, they are those tokens, as
    in the tokenizer as loaded, and a text that holds one is encoded whole. `words` says that the vocabulary drops
    white space and case; otherwise a blank before letters belongs to their pre-token and a line feed is its own.
    """

    def __init__(self, path: str, width: int, words: bool, literal: bool = True):
        from tokenizers import Tokenizer

        self.whole = Tokenizer.from_file(path)
        self.whole.encode_special_tokens = literal
        self.added = () if literal else tuple(t.content for t in self.whole.get_added_tokens_decoder().values())
        self.model = self.whole.model
        self.dtype, self.words = f"<u{width}", words
        self.pieces = _Pieces()

    def _mapped(self, keys: list[str]) -> list[str]:
        """Pre-tokens as the model takes them; outside vocabularies of words a blank goes before those that do not begin with _FIRST."""
        blank, mapped = ("", "") if self.words else (" ", _BLANK)
        out = []
        for key in keys:
            if key.isascii() and key.isprintable():  # letters alone, which stand for themselves
                out.append(mapped + key if key else key)
            elif key[0] == _FIRST:
                plain = key[1:]
                out.append(plain if plain.isascii() and plain.isprintable() else plain.encode().decode("latin-1").translate(_LETTERS))
            else:
                out.append((blank + key).encode().decode("latin-1").translate(_LETTERS))
        return out

    def _piece(self, piece: str) -> list[int] | None:
        """Ids of any piece between blanks; None if its ends make the cut unsafe."""
        if not piece:
            return []
        if piece[0] == _FIRST:
            return None if piece[-1].isspace() else self._whole(piece[1:])
        if piece[-1:].isspace() or piece[1:2].isspace() or piece[:1] != "\n" and piece[:1].isspace():
            return None
        return self._whole(piece if self.words or piece[0] == "\n" else " " + piece)

    def _looked_up(self, names: list[str]) -> np.ndarray:
        """Numbers of pieces; -2 for new ones."""
        return np.fromiter(map(self.pieces.number.get, names, repeat(-2)), np.int64, len(names))

    def _part_numbers(self, keys: pa.Array) -> np.ndarray:
        """Numbers of pre-tokens (see `_mapped`); an empty key is a piece without ids."""
        coded = keys.dictionary_encode()
        names = _strings(coded.dictionary)
        numbers = self._looked_up(names)
        missing = np.flatnonzero(numbers == -2)
        if len(missing):
            new = [names[i] for i in missing.tolist()]
            for at in range(0, len(new), 4096):
                some = new[at : at + 4096]
                found = list(map(self.model.tokenize, self._mapped(some)))
                lengths = np.fromiter(map(len, found), np.int64, len(found))
                ids = np.fromiter(map(_ID, chain.from_iterable(found)), np.uint32, int(lengths.sum()))
                numbers[missing[at : at + 4096]] = self.pieces.add_all(some, ids, lengths)
        return numbers[coded.indices.to_numpy(zero_copy_only=False)]

    def _numbers(self, distinct: pa.Array) -> np.ndarray:
        """Numbers of distinct pieces; new ones are encoded first."""
        names = _strings(distinct)
        numbers = self._looked_up(names)
        missing = np.flatnonzero(numbers == -2)
        if not len(missing):
            return numbers
        words = distinct.take(pa.array(missing))
        simple = pc.match_substring_regex(words, _SIMPLE).to_numpy(zero_copy_only=False)
        for at in missing[~simple].tolist():
            numbers[at] = self.pieces.add(names[at], self._piece(names[at]))
        at = missing[simple]
        words = words.filter(pa.array(simple))
        body = pc.utf8_ltrim(words, "\n" + _FIRST)
        letters, marks = pc.utf8_rtrim(body, _MARKS), pc.utf8_ltrim(body, _LATIN)
        head = lambda x: pc.binary_join_element_wise(pa.scalar(_FIRST, x.type), x, pa.scalar("", x.type))
        line, none = pc.starts_with(words, "\n"), pa.scalar("", words.type)
        if self.words:
            cores = self._part_numbers(pc.utf8_lower(letters))
        else:
            cores = self._part_numbers(pc.if_else(pc.or_(line, pc.starts_with(words, _FIRST)), head(letters), letters))
        plain = pc.equal(pc.binary_length(marks), 0)
        alone = pc.and_not(plain, line).to_numpy(zero_copy_only=False)
        numbers[at[alone]] = cores[alone]
        if self.words:  # elsewhere such a piece is the key of its core
            self.pieces.number.update(zip(map(names.__getitem__, at[alone].tolist()), cores[alone].tolist(), strict=True))
        rest = pa.array(~alone)
        lines = self._part_numbers(pc.if_else(line, pa.scalar(_FIRST + "\n", words.type), none).filter(rest))
        tails = self._part_numbers(pc.if_else(plain, none, head(marks)).filter(rest))
        joined = np.stack([lines, cores[~alone], tails], axis=1)
        numbers[at[~alone]] = self.pieces.add_composed([names[i] for i in at[~alone].tolist()], joined)
        return numbers

    def _whole(self, text: str) -> list[int]:
        return self.whole.encode(text, add_special_tokens=False).ids

    def _cut_apart(self, texts: list[str], after_blank: bool) -> tuple[np.ndarray, pa.Array, np.ndarray]:
        """Which texts may be cut, the pieces of those one after another, and how many each has.

        Pieces stand behind a blank or begin with a line feed; a first piece without a blank before it begins with _FIRST.
        """
        cut = [t != "" for t in texts] if self.words else [t != "" and t[0] not in _ENDS and t[-1] not in _ENDS for t in texts]
        for x in (*self.added, _FIRST, *(_SEPARATORS if self.words else _RUNS)):
            cut = [good and x not in t for good, t in zip(cut, texts, strict=True)]
        fast = pa.array(compress(texts, cut), pa.large_string())
        if self.words:
            pieces = pc.utf8_split_whitespace(fast)
        else:
            if not after_blank:
                fast = pc.binary_join_element_wise(pa.scalar(_FIRST, fast.type), fast, pa.scalar("", fast.type))
            pieces = pc.split_pattern(pc.replace_substring(fast, "\n", " \n"), " ")
        return np.array(cut, dtype=bool), pieces.flatten(), pc.list_value_length(pieces).to_numpy(zero_copy_only=False)

    def _encode(self, texts: list[str | None], after_blank: bool) -> list[bytes]:
        cut, pieces, counts = self._cut_apart([t or "" for t in texts], after_blank)
        coded = pieces.dictionary_encode()
        codes = self._numbers(coded.dictionary)[coded.indices.to_numpy(zero_copy_only=False)]
        borders = np.append(0, np.cumsum(counts)).astype(np.int64)
        places = np.flatnonzero(cut)
        unsafe = np.flatnonzero(codes < 0)
        if len(unsafe):
            cut[places[np.searchsorted(borders, unsafe, "right") - 1]] = False
            codes = np.where(codes < 0, 0, codes)
        data, ends = self.pieces.gather(codes)
        data, size = data.astype(self.dtype).tobytes(), np.dtype(self.dtype).itemsize
        borders = (np.append(0, ends)[borders] * size).tolist()
        out = [b""] * len(texts)
        for at, start, end in zip(places.tolist(), borders[:-1], borders[1:], strict=True):
            out[at] = data[start:end]
        for at in np.flatnonzero(~cut).tolist():
            if texts[at]:
                out[at] = np.array(self._whole(" " + texts[at] if after_blank else texts[at]), dtype=self.dtype).tobytes()
        self.pieces.age()
        return out

    def _in_steps(self, texts: Iterable[str | None], after_blank: bool) -> list[bytes]:
        out, step, size = [], [], 0
        collects = gc.isenabled()
        gc.disable()  # a step makes many objects and no cycles
        try:
            for text in texts:
                step.append(text)
                size += len(text or "")
                if size >= STEP:
                    out += self._encode(step, after_blank)
                    step, size = [], 0
            return out + self._encode(step, after_blank)
        finally:
            if collects:
                gc.enable()

    def encode(self, texts: Iterable[str | None]) -> list[bytes]:
        """Ids of every text; null and empty texts have none."""
        return self._in_steps(texts, False)

    def encode_after_blank(self, texts: Iterable[str | None]) -> list[bytes]:
        """Ids of a blank and the text, for every text; null and empty texts have none."""
        return self._in_steps(texts, True)


@lru_cache(maxsize=4)
def encoder(path: str, width: int, words: bool = False) -> PieceEncoder:
    """One encoder per worker process and vocabulary, kept between tasks; the tokenizer stays as loaded."""
    return PieceEncoder(path, width, words, literal=False)
