"""What a question asks for, what a statement does, and how well they agree."""

from __future__ import annotations

import re
from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from veriscope.functions import text as X

_LOOK_BACK = 30  # fixed value: characters read before a measure name

# fixed values: phrases that reveal a comparison
COMPARISON_PATTERNS = (
    r"\b\w+\s*[<>=]+\s*\d+",
    r"\b(greater|less|equal|above|below|between)\s+(than|to)\b",
    r"\b(with|where|having)\b.*\b(greater|less|above|below|equal)\b",
)

# fixed values: phrases that reveal a text search
TEXT_SEARCH_PATTERNS = (
    r"have\s+['\"]",
    r"contain",
    r"whose\s+name",
    r"with\s+(the\s+)?name",
    r"\bnamed\b",
    r"\bcalled\b",
    r"in\s+(their|its|the)\s+name",
    r"case.insensitive",
    r"matching\s+['\"]",
    r"starts?\s+with",
    r"ends?\s+with",
    r"includes?\s+['\"]",
)

# fixed values: words that ask for an aggregate near a measure
AGGREGATE_WORDS = (
    "total", "sum", "average", "mean", "avg", "count", "max", "min", "highest", "lowest",
)
SUM_WORDS = ("total", "sum", "count", "number of")
MEAN_WORDS = ("average", "mean", "avg")
MAX_WORDS = ("highest", "maximum", "max", "top", "most")
MIN_WORDS = ("lowest", "minimum", "min", "bottom", "least")
SORT_WORDS = ("sort", "order", "rank")
GROUP_PHRASES = ("group by", "breakdown", "break down", "split by")

# fixed values: question phrases by intent; M and D stand for measure and dimension names
PHRASES = (
    (r"\b(list|show|get|find|select)\b.*\b(with|where|having)\b.*[<>=]", "filtering"),
    (
        r"\b(campaigns|products|users|customers|orders)\b.*\b(with|where)\b"
        r".*\b(greater|less|equal|above|below)\b",
        "filtering",
    ),
    (r"\b(total|sum|sum of|overall)\b.*\b({M})\b", "summation"),
    (r"\b(average|mean|avg|avg of)\b", "aggregation"),
    (r"\b(count|number of|how many)\b", "summation"),
    (r"\b({M})\b.*\b(per|by|for each)\b.*\b({D})\b", "grouping"),
    (r"\b(breakdown|break down|group by|split by)\b", "grouping"),
    (r"\b(top|highest|maximum|best)\b.*\b(by|in terms of)\b", "maximization"),
    (r"\b(lowest|minimum|bottom|worst)\b.*\b(by|in terms of)\b", "minimization"),
    (r"\b(top|first)\s+\d+", "limiting"),
)

# fixed values: texts of which one is in whatever the patterns above match; a substring test is far cheaper than they are
COMPARISON_MARKS = ("<", ">", "=", "greater", "less", "equal", "above", "below", "between")
TEXT_SEARCH_MARKS = ("have", "contain", "name", "called", "case", "matching", "start", "end", "include")
PHRASE_MARKS = {
    "filtering": COMPARISON_MARKS,
    "summation": ("total", "sum", "overall", "count", "number of", "how many"),
    "aggregation": ("average", "mean", "avg"),
    "grouping": ("per", "by", "for each", "breakdown", "break down"),
    "maximization": ("top", "highest", "maximum", "best"),
    "minimization": ("lowest", "minimum", "bottom", "worst"),
    "limiting": ("top", "first"),
}

INTENTS = (
    "filtering", "summation", "aggregation", "grouping", "maximization", "minimization",
    "limiting", "sorting",
)


def _alternatives(names: Sequence[str]) -> str:
    return "|".join(re.escape(n) for n in names)


def _flags_to_array(flags: dict[str, Column]) -> Column:
    return F.array_compact(F.array(*[F.when(flags[i], F.lit(i)) for i in INTENTS]))


def requested(question: Column, measures: Sequence[str], dimensions: Sequence[str]) -> Column:
    """Intents of a lower-case question, given the catalog's measure and dimension names."""
    q = question
    measures = sorted({m.lower() for m in measures})
    dimensions = sorted({d.lower() for d in dimensions})

    hits: dict[str, list[Column]] = {i: [] for i in INTENTS}
    by_intent: dict[str, list[str]] = {}
    for pattern, intent in PHRASES:
        filled = pattern.replace("{M}", _alternatives(measures)).replace(
            "{D}", _alternatives(dimensions)
        )
        by_intent.setdefault(intent, []).append(filled)
    for intent, patterns in by_intent.items():
        hits[intent].append(X.contains_any(q, PHRASE_MARKS[intent]) & q.rlike(X.any_of(patterns)))

    compares = X.contains_any(q, COMPARISON_MARKS) & q.rlike(X.any_of(COMPARISON_PATTERNS))
    hits["filtering"] += [compares, X.contains_any(q, TEXT_SEARCH_MARKS) & q.rlike(X.any_of(TEXT_SEARCH_PATTERNS))]

    hits["grouping"].append(X.contains_any(q, GROUP_PHRASES))
    if measures and dimensions:
        m, d = ("|".join(re.escape(n) for n in names) for names in (measures, dimensions))
        hits["grouping"].append(
            X.contains_any(q, ("per", "by")) & q.rlike(X.UNICODE + rf"(?:^|\s)(?:{m})\s+(?:per|by)\s+(?:{d})(?:\s|$)")
        )

    near = F.lit(False)
    for measure in measures:
        at = F.locate(measure, q) - 1
        start = F.greatest(at - _LOOK_BACK, F.lit(0))
        before = F.substring(q, start + 1, at - start)
        near = near | ((at >= 0) & X.contains_any(before, AGGREGATE_WORDS))
    aggregates = near & ~compares
    groups = ((SUM_WORDS, "summation"), (MEAN_WORDS, "aggregation"),
              (MAX_WORDS, "maximization"), (MIN_WORDS, "minimization"))
    earlier = F.lit(False)
    for words, intent in groups:
        said = X.contains_any(q, words)
        # the cheap tests come first: the other one is evaluated anew for every intent
        hits[intent].append(said & ~earlier & aggregates)
        earlier = earlier | said

    hits["sorting"].append(X.contains_any(q, SORT_WORDS))
    hits["limiting"].append(X.contains_any(q, ("top", "first", "limit")) & q.rlike(X.UNICODE + r"\b(top|first|limit)\s+\d+"))

    flags = {}
    for intent, columns in hits.items():
        flag = F.lit(False)
        for c in columns:
            flag = flag | c
        flags[intent] = flag
    return _flags_to_array(flags)


def performed(sql: Column) -> Column:
    """Intents that an upper-case statement carries out."""
    u = sql
    ordered = F.contains(u, F.lit("ORDER BY"))
    descending = F.contains(u, F.lit("DESC"))
    return _flags_to_array(
        {
            "filtering": F.contains(u, F.lit("WHERE")),
            "summation": u.rlike(X.UNICODE + r"\b(SUM|COUNT)\s*\("),
            "aggregation": u.rlike(X.UNICODE + r"\bAVG\s*\("),
            "grouping": F.contains(u, F.lit("GROUP BY")),
            "maximization": u.rlike(X.UNICODE + r"\bMAX\s*\(") | (ordered & descending),
            "minimization": u.rlike(X.UNICODE + r"\bMIN\s*\(") | (ordered & ~descending),
            "limiting": u.rlike(X.UNICODE + r"\bLIMIT\s+\d+"),
            "sorting": ordered,
        }
    )


def intent_score(asked: Column, done: Column, sql: Column) -> Column:
    """Share of asked intents that an upper-case statement does, with bonuses and penalties, in [0, 1]."""
    u = sql
    plain = ~F.contains(u, F.lit("GROUP BY")) & ~u.rlike(X.UNICODE + r"\b(SUM|COUNT|AVG|MAX|MIN)\s*\(")
    matched = F.size(F.array_intersect(asked, done))
    missing = F.size(F.array_except(asked, done))
    extra = F.size(F.array_except(done, asked))
    bonus = F.when(matched >= 3, 0.10).when(matched == 2, 0.05).otherwise(0.0)
    style = F.when(F.contains(u, F.lit("SELECT *")), 0.0).otherwise(0.03) + F.when(
        F.contains(u, F.lit(" AS ")), 0.02
    ).otherwise(0.0)
    score = (
        F.try_divide(matched.cast("double"), F.size(asked))
        + bonus + style - missing * 0.20 - extra * 0.05
    )
    bounded = F.greatest(F.lit(0.0), F.least(F.lit(1.0), score))
    return F.when(F.size(asked) == 0, F.when(plain, 1.0).otherwise(0.8)).otherwise(bounded)


def pattern_score(sql: Column) -> Column:
    """Habits of an upper-case statement: a base score, bonuses and penalties, in [0, 1]."""
    u = sql

    def has(word: str) -> Column:
        return F.contains(u, F.lit(word))

    aggregate = has("SUM(") | has("AVG(") | has("COUNT(") | has("MAX(") | has("MIN(")
    star = u.rlike(X.UNICODE + r"SELECT\s+\*")
    first_from = F.get(F.split(u, "FROM", -1), F.lit(1))
    tables = F.get(F.split(F.get(F.split(first_from, "WHERE", -1), F.lit(0)), "GROUP", -1), F.lit(0))
    listed = F.coalesce(F.contains(tables, F.lit(",")), F.lit(False))
    # fixed values: amount taken off or added per habit
    penalties = (
        (0.30, has("SELECT *") & aggregate & ~has("GROUP BY")),
        (0.15, has("LIMIT") & ~has("ORDER BY")),
        (0.10, star & ~has("LIMIT") & ~has("WHERE")),
        (0.20, listed & ~has("JOIN") & ~has("WHERE")),
    )
    bonuses = (
        (0.05, has("SELECT") & ~star),
        (0.04, u.rlike(X.UNICODE + r"\bAS\s+\w+")),
        (0.05, has("JOIN")),
        (0.04, has("WHERE")),
        (0.04, has("GROUP BY") & aggregate),
        (0.03, has("ORDER BY")),
        (0.02, has("LIMIT")),
        (0.02, F.regexp_count(u, F.lit("SELECT")) > 1),
        (0.02, has("HAVING")),
    )

    def total(rules) -> Column:
        out = F.lit(0.0)
        for amount, rule in rules:
            out = out + F.when(rule, amount).otherwise(0.0)
        return out

    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.lit(0.75) + total(bonuses) - total(penalties)))
