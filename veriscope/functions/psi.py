"""Bucket arithmetic of the Population Stability Index."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from veriscope import constants as K


def bucket_of(value: Column, edges: Column, max_buckets: int = K.PSI_BUCKETS, several: bool = False) -> Column:
    """Index of the bucket [e_i, e_i+1) holding a value, the last one closed; -1 outside.

    Plain comparisons per edge stay inside generated code, unlike a lambda over
    the edge array. Say `several` when one projection places several columns: their comparisons together make a method that is
    too long to be compiled, so a lambda counts the edges then.
    An array of more than `max_buckets` buckets is an error: give its length then.
    """
    last = F.size(edges) - 1
    if several:
        passed = F.size(F.filter(edges, lambda e: value >= e))
    else:
        passed = F.lit(0)
        for i in range(max_buckets + 1):
            passed = passed + F.when(value >= F.get(edges, F.lit(i)), 1).otherwise(0)
    outside = (value < F.get(edges, F.lit(0))) | (value > F.get(edges, last))
    too_long = F.raise_error(F.lit(f"a bucket edge array has more than {max_buckets} buckets")).cast("int")
    return F.when(last > max_buckets, too_long).when(outside, -1).otherwise(F.least(passed - 1, last - 1))


def shares(counts: Column, total: Column, buckets: Column) -> Column:
    """Share per bucket from a map bucket -> count and their total; uniform when the total is 0.

    Give columns, not expressions: a lambda would evaluate an expression again
    for every bucket.
    """

    def share(i: Column) -> Column:
        part = F.coalesce(F.try_element_at(counts, i), F.lit(0)) / total
        return F.when(total == 0, 1.0 / buckets).otherwise(F.greatest(part, F.lit(K.PSI_FLOOR)))

    return F.transform(F.sequence(F.lit(0), buckets - 1), share)


def stability_index(expected: Column, actual: Column) -> Column:
    """Sum over buckets of (a - e) * ln(a / e), both floored."""

    def term(e: Column, a: Column) -> Column:
        e, a = F.greatest(e, F.lit(K.PSI_FLOOR)), F.greatest(a, F.lit(K.PSI_FLOOR))
        return (a - e) * F.ln(a / e)

    terms = F.zip_with(expected, actual, term)
    return F.aggregate(terms, F.lit(0.0), lambda total, t: total + F.coalesce(t, F.lit(0.0)))


def psi_class(psi: Column) -> Column:
    return (
        F.when(psi < K.PSI_MEDIUM, "normal").when(psi < K.PSI_HIGH, "medium").otherwise("high")
    )


def is_metric_column(name: Column) -> Column:
    endings = "|".join(K.NON_METRIC_SUFFIXES)
    lower = F.lower(F.trim(name))
    return ~lower.isin(*K.NON_METRIC_NAMES) & ~lower.rlike(f"(?:{endings})$")


def is_metric_name(name: str) -> bool:
    """The same rule for column names known from a schema."""
    lower = name.lower().strip()
    return lower not in K.NON_METRIC_NAMES and not lower.endswith(K.NON_METRIC_SUFFIXES)
