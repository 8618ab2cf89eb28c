"""Clause extraction from SQL text and clause-wise similarity."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from veriscope import constants as K
from veriscope.functions import text as X

# fixed values: where each clause starts and ends in normalised SQL
_SELECT = X.UNICODE + r"select\s+(.*?)\s+from"
_FROM = X.UNICODE + r"from\s+([\w\.]+)"
_WHERE = X.UNICODE + r"where\s+(.*?)(?:\s+group\s+by|\s+order\s+by|\s+limit|$)"
_GROUP = X.UNICODE + r"group\s+by\s+(.*?)(?:\s+having|\s+order\s+by|\s+limit|$)"
_ORDER = X.UNICODE + r"order\s+by\s+(.*?)(?:\s+limit|$)"
_LIMIT = X.UNICODE + r"limit\s+(\d+)"
_JOIN = X.UNICODE + r"(inner|left|right|full)?\s*join\s+([\w\.]+)"

# fixed values: weight of each clause in the similarity of two statements
CLAUSE_WEIGHTS = {
    "select": 0.4,
    "from": 0.15,
    "where": 0.2,
    "group_by": 0.1,
    "order_by": 0.1,
    "joins": 0.05,
}


def _no_items() -> Column:
    return F.array().cast("array<string>")


def _items(sql: Column, pattern: str) -> Column:
    listed = F.transform(F.split(F.regexp_extract(sql, pattern, 1), ","), X.strip)
    return F.when(sql.rlike(pattern), listed).otherwise(_no_items())


def _single(sql: Column, pattern: str) -> Column:
    return F.when(sql.rlike(pattern), F.array(X.strip(F.regexp_extract(sql, pattern, 1)))).otherwise(
        _no_items()
    )


def clauses(normal: Column) -> Column:
    """Struct of clause lists of one normalised statement."""
    n = normal
    return F.struct(
        _items(n, _SELECT).alias("select"),
        _single(n, _FROM).alias("from"),
        _single(n, _WHERE).alias("where"),
        _items(n, _GROUP).alias("group_by"),
        _items(n, _ORDER).alias("order_by"),
        F.when(n.rlike(_LIMIT), F.regexp_extract(n, _LIMIT, 1)).alias("limit"),
        F.regexp_extract_all(n, F.lit(_JOIN), F.lit(2)).alias("joins"),
    )


def with_clauses(df: DataFrame, sql: str, out: str) -> DataFrame:
    """Add the clause struct of a SQL column; the text is normalised once, in its own step."""
    normal = f"__{out}_normal"
    return (
        df.withColumn(normal, X.normalise_sql(F.col(sql)))
        .withColumn(out, clauses(F.col(normal)))
        .drop(normal)
    )


def bare_reference(item: Column, known_columns: Iterable[str] = ()) -> Column:
    """Reference without alias, table suffix, schema prefix and inner table prefix."""
    c = F.lower(X.strip(item))
    c = F.regexp_replace(c, X.UNICODE + r"\s+as\s+\w+", "")
    c = F.regexp_replace(c, X.UNICODE + r"^([\w\.]+)\s+\w+$", "$1")
    c = F.regexp_replace(c, X.UNICODE + r"^\w+\.(\w+)$", "$1")
    # a prefix is dropped only between "name(" and the next ")"
    # (a match goes on where the one before it ended, so a call may be of any length)
    c = F.regexp_replace(c, X.UNICODE + r"(\G(?!^)|\w\()([^)]*?)\w+\.(\w+)(?=[^)]*\))", "$1$2$3")
    parts = F.split(c, r"\.")
    column = X.strip(F.get(parts, F.lit(1)))
    known = [k.lower() for k in known_columns]
    allowed = column.isin(known) if known else F.lit(True)
    plain = (F.size(parts) == 2) & ~F.contains(c, F.lit("(")) & allowed
    return X.strip(F.when(plain, column).otherwise(c))


def _as_set(items: Column) -> Column:
    return F.array_distinct(F.transform(items, lambda v: F.lower(X.strip(v))))


def overlap(a: Column, b: Column) -> Column:
    """Overlap coefficient of two lists without repeats; two empty lists agree."""
    common = F.size(F.array_intersect(a, b)).cast("double")
    return (
        F.when((F.size(a) == 0) & (F.size(b) == 0), 1.0)
        .when((F.size(a) == 0) | (F.size(b) == 0), 0.0)
        .otherwise(F.try_divide(common, F.least(F.size(a), F.size(b))))
    )


def _without_prefixes(where: Column) -> Column:
    return F.regexp_replace(where, X.UNICODE + r"\b\w+\.(\w+)", "$1")


def where_pairs(where: Column) -> Column:
    """Distinct `column operator` texts of a condition, whatever its literals."""
    return _pairs(_without_prefixes(where))


def _pairs(w: Column) -> Column:
    """As `where_pairs`, from a condition without prefixes. Give a column, as it is read by every rule."""
    # fixed values: how each operator is recognised
    comparison = X.UNICODE + r"""(\w+)\s*(>=|<=|<>|!=|>|<|=)\s*[\d'"]"""

    def all_of(pattern: str, group: int, *marks: str) -> Column:
        """Every match; a condition with none of the texts that each match holds is not searched."""
        found = F.regexp_extract_all(w, F.lit(pattern), F.lit(group))
        return F.when(~X.contains_any(w, marks), _no_items()).otherwise(found)

    def named(pattern: str, operator: str, mark: str) -> Column:
        found = all_of(X.UNICODE + pattern, 1, mark)
        return F.transform(found, lambda v: F.concat(v, F.lit(" " + operator)))

    compared = F.zip_with(
        all_of(comparison, 1, "<", ">", "="),
        all_of(comparison, 2, "<", ">", "="),
        lambda column, operator: F.concat_ws(" ", column, operator),
    )
    listed = F.concat(
        named(r"(\w+)\s+between\b", "between", "between"),
        compared,
        named(r"(\w+)\s+like\b", "like", "like"),
        named(r"(\w+)\s+in\s*\(", "in", "in"),
    )
    wanted = F.filter(listed, lambda p: ~F.substring_index(p, " ", 1).isin(*K.WHERE_SKIP_WORDS))
    nulls = named(r"(\w+)\s+is\s+(?:not\s+)?null", "is_null", "null")
    return F.array_distinct(F.concat(wanted, nulls))


def with_where_similarity(df: DataFrame, left: str, right: str, out: str) -> DataFrame:
    """Add the similarity of two WHERE lists by their column/operator pairs.

    Each step is a projection of its own, so that the pairs are extracted once
    and then read by all rules.
    """
    lw, rw, lq, rq, lp, rp, lc, rc = (f"__{out}_{n}" for n in ("lw", "rw", "lq", "rq", "lp", "rp", "lc", "rc"))

    def first(name: str) -> Column:
        return F.lower(X.strip(F.get(F.col(name), F.lit(0))))

    def columns(name: str) -> Column:
        return F.array_distinct(F.transform(name, lambda p: F.substring_index(p, " ", 1)))

    staged = (
        df.withColumns({lw: first(left), rw: first(right)})
        .withColumns({lq: _without_prefixes(F.col(lw)), rq: _without_prefixes(F.col(rw))})
        .withColumns({lp: _pairs(F.col(lq)), rp: _pairs(F.col(rq))})
        .withColumns({lc: columns(lp), rc: columns(rp)})
    )
    n_left, n_right = F.size(left), F.size(right)
    p_left, p_right = F.size(lp), F.size(rp)
    shared = F.size(F.array_intersect(lp, rp))
    jaccard = shared / F.size(F.array_union(lp, rp))
    by_column = F.size(F.array_intersect(lc, rc)) / F.greatest(F.size(lc), F.size(rc))
    score = (
        F.when((n_left == 0) & (n_right == 0), 1.0)
        .when((n_left == 0) | (n_right == 0), 0.0)
        .when(F.col(lw) == F.col(rw), 1.0)
        .when((p_left == 0) & (p_right == 0), 1.0)
        .when((p_left == 0) | (p_right == 0), 0.0)
        .when((shared == p_left) & (shared == p_right), 0.7)
        .otherwise(F.least(F.lit(0.65), jaccard * 0.6 + by_column * 0.35))
    )
    return staged.withColumn(out, score).drop(lw, rw, lq, rq, lp, rp, lc, rc)


def sql_similarity(
    df: DataFrame, sql: str, other: str, out: str = "similarity", known_columns: Iterable[str] = ()
) -> DataFrame:
    """Add the similarity of two SQL columns: weighted agreement of their clauses."""
    known = list(known_columns)
    l, r = f"__{out}_l", f"__{out}_r"
    parsed = (
        df.withColumns(
            {f"{l}_normal": X.normalise_sql(F.col(sql)), f"{r}_normal": X.normalise_sql(F.col(other))}
        ).withColumns({l: clauses(F.col(f"{l}_normal")), r: clauses(F.col(f"{r}_normal"))})
    )
    listed = [name for name in CLAUSE_WEIGHTS if name != "where"]
    sets = parsed.withColumns(
        {
            f"{side}_{name}": _as_set(F.transform(F.col(side)[name], lambda v: bare_reference(v, known)))
            for side in (l, r)
            for name in listed
        }
        | {f"{side}_where": F.col(side)["where"] for side in (l, r)}
    )
    scored = with_where_similarity(sets, f"{l}_where", f"{r}_where", f"__{out}_where")
    total = F.lit(0.0)
    for name, weight in CLAUSE_WEIGHTS.items():
        score = (
            F.col(f"__{out}_where") if name == "where"
            else overlap(F.col(f"{l}_{name}"), F.col(f"{r}_{name}"))
        )
        total = total + score * weight
    same = F.col(f"{l}_normal") == F.col(f"{r}_normal")
    missing = F.col(sql).isNull() | F.col(other).isNull()
    value = F.when(missing, None).when(same, 1.0).otherwise(total)
    return scored.select(*df.columns, value.alias(out))


def is_equivalent(similarity: Column) -> Column:
    return similarity >= 0.6


def components_match(similarity: Column) -> Column:
    return similarity >= 0.7
