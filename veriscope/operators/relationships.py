"""Relationships between the columns of many tables, by name and by the values they hold.

One inverted index over all columns of all tables answers every containment at once: each distinct value carries
the set of columns that hold it, as a bitmap combined before the shuffle. Equal sets are then counted, which
leaves a small table; a column lies within another if the AND over the sets that hold the first has the bit of the second.
"""

from __future__ import annotations

from collections.abc import Sequence
from typing import NamedTuple

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from veriscope.session import written

#: Columns per bitmap word: a long without its sign and a spare bit.
_WORD = 62
#: Texts longer than this are compared by their SHA-256.
_LONG_TEXT = 64
_KINDS = (
    ("integer", (T.ByteType, T.ShortType, T.IntegerType, T.LongType)),
    ("text", (T.StringType,)),
    ("number", (T.FloatType, T.DoubleType, T.DecimalType)),
    ("time", (T.DateType, T.TimestampType, T.TimestampNTZType)),
    ("boolean", (T.BooleanType,)),
)


class ColumnRef(NamedTuple):
    table: str
    column: str
    kind: str


def comparable_columns(tables: dict[str, DataFrame]) -> list[ColumnRef]:
    """Columns whose values can be compared, in order; nested and binary ones are left out. Kinds never meet."""
    return [
        ColumnRef(t, f.name, kind)
        for t in sorted(tables) for f in tables[t].schema.fields
        for kind, types in _KINDS if isinstance(f.dataType, types)
    ]


def _canonical(c: Column, kind: str) -> Column:
    if kind == "number":
        c = c.cast("double")
    elif kind == "time":
        c = c.cast("timestamp_ntz")
    elif kind == "text":
        return F.when(F.length(c) <= _LONG_TEXT, F.concat(F.lit("="), c)).otherwise(F.concat(F.lit("#"), F.sha2(c, 256)))
    return c.cast("string")


def column_sets(tables: dict[str, DataFrame], columns: Sequence[ColumnRef]) -> DataFrame:
    """(w0, w1, ..., n): how many distinct values are held by exactly the columns whose bits are set."""
    words = -(-len(columns) // _WORD)
    found = None
    for name in sorted({c.table for c in columns}):
        cells = [
            F.struct(
                F.lit(c.kind).alias("kind"), _canonical(F.col(f"`{c.column}`"), c.kind).alias("v"),
                *[F.lit(1 << i % _WORD if i // _WORD == w else 0).cast("long").alias(f"w{w}") for w in range(words)],
            )
            for i, c in enumerate(columns) if c.table == name
        ]
        part = tables[name].select(F.inline(F.array(*cells))).filter(F.col("v").isNotNull())
        found = part if found is None else found.unionByName(part)
    names = [f"w{w}" for w in range(words)]
    per_value = found.groupBy("kind", "v").agg(*[F.bit_or(w).alias(w) for w in names])
    return written(per_value.groupBy(*names).agg(F.count("*").alias("n")))


def filled_counts(tables: dict[str, DataFrame], columns: Sequence[ColumnRef]) -> dict[ColumnRef, int]:
    """Rows with a value per column: one aggregate a table, one row each."""
    out = {}
    for name in sorted({c.table for c in columns}):
        mine = [c for c in columns if c.table == name]
        row = tables[name].agg(*[F.count(f"`{c.column}`").alias(str(i)) for i, c in enumerate(mine)]).first()
        out |= {c: row[i] for i, c in enumerate(mine)}
    return out


def _has(i: int) -> Column:
    return F.col(f"w{i // _WORD}").bitwiseAND(F.lit(1 << i % _WORD).cast("long")) != 0


def stem(column: str) -> str:
    """A column name without its table prefix: `o_custkey` and `c_custkey` are both `custkey`, `doc_id` stays."""
    head, _, tail = column.partition("_")
    return tail if tail and len(head) <= 2 else column


class ColumnIndex:
    """What the sets of columns say: distinct values per column, containments, and values that a column lacks."""

    def __init__(self, tables: dict[str, DataFrame]):
        self.columns = comparable_columns(tables)
        self.place = {(c.table, c.column): i for i, c in enumerate(self.columns)}
        self.values: list[int] = []
        if not self.columns:
            return
        self.sets = column_sets(tables, self.columns)
        self.filled = filled_counts(tables, self.columns)
        words = [c for c in self.sets.columns if c != "n"]
        # one row: values per column and the AND of the sets that hold it
        everything = F.lit((1 << _WORD) - 1).cast("long")
        size = range(len(self.columns))
        self.sums = self.sets.agg(
            *[F.sum(F.when(_has(i), F.col("n")).otherwise(0)).alias(f"n{i}") for i in size],
            *[F.bit_and(F.when(_has(i), F.col(w)).otherwise(everything)).alias(f"{w}_{i}") for i in size for w in words],
        ).first()
        self.values = [self.sums[f"n{i}"] or 0 for i in size]

    def keys(self) -> list[int]:
        """Columns that hold every value once, and at least one."""
        return [i for i, c in enumerate(self.columns) if self.values[i] and self.values[i] == self.filled[c]]

    def within(self, i: int, j: int) -> bool:
        """Whether column j holds all values of column i, which has some."""
        return self.values[i] > 0 and bool(self.sums[f"w{j // _WORD}_{i}"] >> j % _WORD & 1)

    def missing(self, pairs: set[tuple[int, int]]) -> dict[tuple[int, int], int]:
        """How many distinct values of i are not in j, for each pair; one pass over the sets."""
        out = dict.fromkeys(pairs, 0)
        asked = sorted(p for p in pairs if not self.within(*p))
        if asked:
            lacks = self.sets.agg(
                *[F.sum(F.when(_has(i) & ~_has(j), F.col("n")).otherwise(0)).alias(str(at)) for at, (i, j) in enumerate(asked)]
            ).first()
            out |= {pair: lacks[at] or 0 for at, pair in enumerate(asked)}
        return out


_SHAPE = (
    "source_schema string, source_table string, source_column string, target_schema string, target_table string, target_column string, "
    "relationship_type string, constraint_name string, by_name boolean, values long, missing long, contained boolean"
)


def relationships(
    spark: SparkSession, tables: dict[str, DataFrame], *, schema: str = "public", least: int = 1,
) -> DataFrame:
    """Relationships of all columns of all tables, found by name and by value.

    Rows: source_schema, source_table, source_column, target_schema, target_table, target_column, relationship_type,
    constraint_name (null), by_name, values, missing, contained. `values` are the distinct values of the source column,
    `missing` those the target column does not hold (both null if there is no such column).

    - `inferred`: a field `x_id` points to the key `_id` of the table `xs`, whether or not that table exists; or its stem
      is that of a key column of another table. Such a row says how many values are missing.
    - `contained`: no name speaks for it, but all values (`least` at least) lie in a key column of another table.

    A key column holds every value once; nulls are no values. A column without values is contained nowhere.
    """
    index = ColumnIndex(tables)
    columns, keys = index.columns, index.keys() if index.columns else []
    # by name, with or without a target; then keys of other tables by stem or by values
    rows: list[tuple] = []
    for i, c in enumerate(columns):
        pointed = c.column[:-3] + "s" if c.column.endswith("_id") and c.column != "_id" else None
        if pointed:
            rows.append((i, index.place.get((pointed, "_id")), pointed, "_id", True))
        for j in keys:
            k = columns[j]
            if k.table == c.table or k.kind != c.kind or (k.table, k.column) == (pointed, "_id"):
                continue
            named = stem(c.column) == stem(k.column)
            if named or index.within(i, j) and index.values[i] >= least:
                rows.append((i, j, k.table, k.column, named))
    missing = index.missing({(i, j) for i, j, *_ in rows if j is not None})
    return spark.createDataFrame(
        [
            (schema, columns[i].table, columns[i].column, schema, table, column, "inferred" if named else "contained", None, named,
             index.values[i] if j is not None else None, missing.get((i, j)), j is not None and index.within(i, j))
            for i, j, table, column, named in rows
        ],
        _SHAPE,
    )


def declared_and_checked(spark: SparkSession, tables: dict[str, DataFrame], constraints: DataFrame) -> DataFrame:
    """Declared foreign keys of one column each, with what the data says of them: columns as in `relationships`.

    `constraints` has the six names and constraint_name, a row per foreign key (metadata, held by the driver). `missing` counts distinct
    values without a target; values and missing are null where a column is not there or the two cannot be compared.
    """
    index = ColumnIndex(tables)
    rows = constraints.select("source_schema", "source_table", "source_column", "target_schema", "target_table", "target_column", "constraint_name").collect()
    placed = []
    for r in rows:
        i, j = index.place.get((r.source_table, r.source_column)), index.place.get((r.target_table, r.target_column))
        alike = i is not None and j is not None and index.columns[i].kind == index.columns[j].kind
        placed.append((r, i if alike else None, j if alike else None))
    missing = index.missing({(i, j) for _, i, j in placed if i is not None}) if index.columns else {}
    return spark.createDataFrame(
        [
            (r.source_schema, r.source_table, r.source_column, r.target_schema, r.target_table, r.target_column, "foreign_key", r.constraint_name,
             stem(r.source_column) == stem(r.target_column), index.values[i] if i is not None else None, missing.get((i, j)),
             i is not None and missing[i, j] == 0)
            for r, i, j in placed
        ],
        _SHAPE,
    )
