r"""Quality rules as a bitmask ledger.

Every rule is evaluated once per document. The ledger keeps the measurements and one long whose
bit k says that rule k failed. Policies are versioned sets of rules: applying one is `bits & mask`,
and what each rule costs or saves (ablation) is counted from the ledger alone, by bit pattern.
Texts are read once; a policy change never reads them again.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from veriscope.llm.registry import query
from veriscope.llm.shared import WORD, shipped, table

_WORDS, _HAS_WORD = re.compile(WORD).findall, re.compile(WORD).search
_SYMBOLS = str.maketrans("", "", "#*$%&|<>")
MEASURES = ("n_words", "word_chars", "n_symbols", "n_lines", "n_dup_lines", "n_repeat_words", "n_upper_words")


def repeated_words(words: list[str], width: int = 3) -> int:
    """Words that stand in a window of `width` words which the text holds twice or more."""
    n = len(words) - width + 1
    if n < 2:
        return 0
    ids: dict[str, int] = {}
    codes = np.fromiter((ids.setdefault(w, len(ids)) for w in words), dtype=np.int64, count=len(words))
    if len(ids) == len(words):
        return 0
    windows = codes[:n]
    for k in range(1, width):
        # numbering the windows anew at each step keeps the product below 2**63
        windows = np.unique(windows, return_inverse=True)[1].astype(np.int64) * len(ids) + codes[k : k + n]
    _, which, counts = np.unique(windows, return_inverse=True, return_counts=True)
    starts = np.flatnonzero(counts[which] > 1)
    hit = np.zeros(len(words), dtype=bool)
    for k in range(width):
        hit[starts + k] = True
    return int(hit.sum())


def measure_text(text: str | None) -> tuple[int, ...]:
    """MEASURES of one whole text; all 0 for null or a text without words (symbols still count)."""
    if not text:
        return (0,) * len(MEASURES)
    words = _WORDS(text)
    lines = [x for x in text.split("\n") if _HAS_WORD(x)]
    return (
        len(words), sum(map(len, words)), len(text) - len(text.translate(_SYMBOLS)), len(lines),
        len(lines) - len(set(lines)), repeated_words(words), sum(map(str.isupper, words)),
    )


def _measured(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
    for texts in batches:
        yield pd.DataFrame([measure_text(x) for x in texts], columns=list(MEASURES), dtype="int64")


@dataclass(frozen=True)
class Rule:
    """A named failure condition over the measurements."""

    name: str
    fails: str


#: Bit k of the ledger belongs to rule k. Append only: stored ledgers keep their meaning.
RULES = (
    Rule("few_words", "n_words < 50"),
    Rule("repeated_windows", "100 * n_repeat_words > 50 * n_words"),
    Rule("many_symbols", "100 * n_symbols > 10 * n_words"),
    Rule("duplicate_lines", "100 * n_dup_lines > 40 * n_lines"),
    Rule("upper_case", "100 * n_upper_words > 50 * n_words"),
    Rule("word_length", "10 * word_chars < 25 * n_words OR word_chars > 12 * n_words"),
)
#: Versioned policies: a document is dropped if one of the rules named fails.
POLICIES = {
    1: ("few_words", "repeated_windows"),
    2: ("few_words", "repeated_windows", "many_symbols", "duplicate_lines", "upper_case", "word_length"),
}


def mask(names: tuple[str, ...], rules: tuple[Rule, ...] = RULES) -> int:
    known = [r.name for r in rules]
    return sum(1 << known.index(n) for n in names)


def ledger(documents: DataFrame, text: str = "text", rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """`documents` with MEASURES and `bits`, the failed rules; the text column goes.

    Null and empty texts measure 0 everywhere. Rows are independent: repeated rows get equal
    results and an empty table gives none. Columns of the input named like an output are replaced.
    At most 63 rules.
    """
    if len(rules) > 63:
        raise ValueError("a ledger holds at most 63 rules")
    measured = F.pandas_udf(_measured, ", ".join(f"{m} long" for m in MEASURES))
    keep = [c for c in documents.columns if c not in (text, *MEASURES, "bits")]
    rows = shipped(documents).select(*keep, measured(F.col(text)).alias("__m")).select(*keep, "__m.*")
    bits = F.lit(0).cast("long")
    for k, rule in enumerate(rules):
        bits = bits.bitwiseOR(F.when(F.expr(rule.fails), F.lit(1 << k)).otherwise(0).cast("long"))
    return rows.withColumn("bits", bits)


def passes(policy: int, bits: Column | None = None) -> Column:
    """Whether a ledger row passes the policy of this version."""
    bits = F.col("bits") if bits is None else bits
    return bits.bitwiseAND(F.lit(mask(POLICIES[policy])).cast("long")) == 0


def ablations(rows: DataFrame, policy: int, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """Per rule of the policy: failed, failed_alone (rows that dropping the rule would win back) and kept.

    Rows are first counted per bit pattern (at most 2**rules rows, combined before the shuffle).
    `kept` is the number of rows the policy keeps without the rule. An empty ledger gives zeros.
    """
    m = mask(POLICIES[policy], rules)
    patterns = rows.groupBy(F.col("bits").bitwiseAND(F.lit(m).cast("long")).alias("bits")).agg(F.count("*").alias("n"))
    total = lambda cond: F.coalesce(F.sum(F.when(cond, F.col("n"))), F.lit(0))
    parts = []
    for name in POLICIES[policy]:
        bit = mask((name,), rules)
        parts.append(F.struct(
            F.lit(name).alias("rule"),
            total(F.col("bits").bitwiseAND(F.lit(bit).cast("long")) != 0).alias("failed"),
            total(F.col("bits") == bit).alias("failed_alone"),
            total(F.col("bits").bitwiseAND(F.lit(m & ~bit).cast("long")) == 0).alias("kept"),
        ))
    return patterns.agg(F.array(*parts).alias("xs")).select(F.explode("xs").alias("x")).select("x.*")


_FAILS = "\n    | ".join(f"CASE WHEN {r.fails} THEN {1 << k} ELSE 0 END" for k, r in enumerate(RULES))


@query("op8_quality_ledger", rf"""
WITH w AS (
  SELECT doc_id, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '{WORD}') AS words FROM documents),
windows AS (
  SELECT doc_id, i, words[i] || ' ' || words[i + 1] || ' ' || words[i + 2] AS win
  FROM (SELECT doc_id, words, unnest(range(1, len(words) - 1)) AS i FROM w WHERE len(words) >= 3)),
twice AS (SELECT doc_id, i FROM (SELECT *, count(*) OVER (PARTITION BY doc_id, win) AS n FROM windows) WHERE n > 1),
hit AS (
  SELECT doc_id, count(*) AS n FROM (SELECT DISTINCT doc_id, i + k AS at FROM twice, (VALUES (0), (1), (2)) v(k)) GROUP BY doc_id),
m AS (
  SELECT doc_id, len(words)::BIGINT AS n_words, coalesce(list_sum(list_transform(words, lambda x: length(x))), 0)::BIGINT AS word_chars,
    (length(text) - length(regexp_replace(text, '[#*$%&|<>]', '', 'g')))::BIGINT AS n_symbols,
    list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '{WORD}')) AS lines,
    len(list_filter(words, lambda x: x = upper(x) AND x <> lower(x)))::BIGINT AS n_upper_words FROM w),
a AS (
  SELECT m.*, len(lines)::BIGINT AS n_lines, (len(lines) - len(list_distinct(lines)))::BIGINT AS n_dup_lines,
    coalesce(hit.n, 0)::BIGINT AS n_repeat_words FROM m LEFT JOIN hit USING (doc_id)),
b AS (SELECT *, ({_FAILS})::BIGINT AS bits FROM a)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words,
  (bits & {mask(POLICIES[1])}) <> 0 AS base_failed, (bits & {mask(POLICIES[2])}) = 0 AS kept, bits
FROM b""")
def op8_quality_ledger(spark: SparkSession, folder: str) -> DataFrame:
    rows = ledger(table(spark, folder, "documents").select("doc_id", "text"))
    return rows.select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
        (~passes(1)).alias("base_failed"), passes(2).alias("kept"), "bits",
    )
