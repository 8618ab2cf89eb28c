"""Column expressions over question and SQL text (no Python runs per row)."""

from __future__ import annotations

from collections.abc import Iterable
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from veriscope import constants as K

# Java's \w, \s and \b cover ASCII only unless this flag is set.
UNICODE = "(?U)"


def strip(c: Column) -> Column:
    """Trim every kind of white space (Spark's trim removes blanks only)."""
    return F.regexp_replace(c, UNICODE + r"^\s+|\s+$", "")


def collapse(c: Column) -> Column:
    return F.regexp_replace(c, UNICODE + r"\s+", " ")


def any_of(patterns: Iterable[str]) -> str:
    """One alternation, so a text is scanned once for the whole list."""
    return UNICODE + "|".join(f"(?:{p})" for p in patterns)


def either(conditions: Iterable[Column]) -> Column:
    return reduce(lambda a, b: a | b, conditions)


def contains_any(c: Column, phrases: Iterable[str]) -> Column:
    """Plain substring tests: cheaper than one alternation for the regex engine."""
    return either(F.contains(c, F.lit(p)) for p in phrases)


def matches_any(c: Column, patterns: Iterable[str]) -> Column:
    """Any of several patterns whose only operator is `.*`.

    A pattern without it is a substring test. One with it is handed to the
    regex engine only for texts that contain all of its literal parts.
    """
    tests = []
    for p in patterns:
        parts = [F.contains(c, F.lit(x)) for x in p.split(".*")]
        tests.append(reduce(lambda a, b: a & b, parts + ([c.rlike(p)] if ".*" in p else [])))
    return either(tests)


def question_key(c: Column) -> Column:
    """Key under which two spellings of a question are the same."""
    return F.rtrim(F.lower(strip(c)), F.lit("?.!"))


def agent_key(c: Column) -> Column:
    return F.replace(F.replace(F.lower(c), F.lit(" "), F.lit("_")), F.lit("_agent"), F.lit(""))


def clean_sql(c: Column, drop_sql_word: bool = True) -> Column:
    """Take the SQL out of a code fence.

    `drop_sql_word` keeps the original behaviour of deleting every literal
    "sql" once a fence was seen; without it only a language tag is removed.
    """
    trimmed = strip(c)
    parts = F.split(trimmed, "```", -1)
    body = F.when(F.size(parts) >= 3, F.get(parts, F.lit(1))).otherwise(trimmed)
    untagged = (
        F.replace(body, F.lit("sql"), F.lit(""))
        if drop_sql_word
        else F.regexp_replace(body, r"^sql\b", "")
    )
    return F.when(F.size(parts) >= 2, strip(untagged)).otherwise(trimmed)


def normalise_sql(c: Column) -> Column:
    return strip(F.rtrim(F.lower(collapse(c)), F.lit(";")))


def has_sql(sql: Column, status: Column) -> Column:
    """Rows that belong in the query history."""
    return sql.isNotNull() & (sql != "") & (sql != "-- No SQL Generated") & (status != "error")


def is_non_data_reply(sql: Column) -> Column:
    return F.coalesce(contains_any(F.lower(sql), K.NON_DATA_REPLIES), F.lit(False))


def is_business_question(question: Column) -> Column:
    return ~F.lower(strip(question)).rlike(any_of(K.NON_BUSINESS_PATTERNS))


def is_read_only(sql: Column, whole_words: bool = False) -> Column:
    """SELECT/WITH statements free of write keywords.

    The keywords are looked for as substrings (so `created_at` is refused);
    `whole_words` asks for word boundaries instead.
    """
    upper = F.upper(strip(sql))
    alternation = "|".join(K.WRITE_KEYWORDS)
    pattern = rf"\b(?:{alternation})\b" if whole_words else alternation
    return (upper.startswith("SELECT") | upper.startswith("WITH")) & ~upper.rlike(pattern)


def is_aggregate_query(sql: Column) -> Column:
    return F.upper(sql).rlike(
        UNICODE + r"\bGROUP\s+BY\b|\b(?:SUM|AVG|COUNT|MAX|MIN)\s*\("
    )


def orders_rows(sql: Column) -> Column:
    """ORDER BY occurs after the last closing parenthesis."""
    return F.coalesce(
        F.contains(F.substring_index(F.upper(sql), ")", -1), F.lit("ORDER BY")), F.lit(False)
    )


def sql_from_payload(payload: Column) -> Column:
    """SQL carried by a map payload: a known field first, else any SQL-like value."""
    named = [payload[name] for name in K.SQL_FIELDS]
    like_sql = "(?i)" + UNICODE + K.SQL_TEXT_PATTERN
    found = F.filter(F.map_values(payload), lambda v: v.rlike(like_sql))
    return F.coalesce(*named, F.get(found, F.lit(0)))


def sql_from_text(text: Column) -> Column:
    return F.when(text.rlike("(?i)" + UNICODE + K.SQL_TEXT_PATTERN), text)


def query_kind(sql: Column) -> Column:
    """First matching kind of a statement."""
    lower = F.lower(sql)
    aggregates = ("count", "sum", "avg", "max", "min", "group by")
    dates = ("date", "interval", "now()", "date_trunc")
    return (
        F.when(F.contains(lower, F.lit("join")), "JOIN")
        .when(contains_any(lower, aggregates), "Aggregation")
        .when(contains_any(lower, dates), "Date/Time")
        .otherwise("Simple SELECT")
    )


def polarity_conflict(left: Column, right: Column) -> Column:
    """One question asks for less while the other asks for more."""
    l, r = F.lower(left), F.lower(right)
    return (contains_any(l, K.LESS_PHRASES) & contains_any(r, K.MORE_PHRASES)) | (
        contains_any(l, K.MORE_PHRASES) & contains_any(r, K.LESS_PHRASES)
    )


def non_empty(c: Column) -> Column:
    """Null for an empty text, so that coalesce skips it."""
    return F.nullif(c, F.lit(""))


def shorten(c: Column, limit: int, marker: str = "...") -> Column:
    return F.when(F.length(c) > limit, F.concat(F.substring(c, 1, limit), F.lit(marker))).otherwise(c)
