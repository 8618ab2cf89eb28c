"""Joins to reference tables whose size is known when the join is planned."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame

from veriscope.session import written


def measured(table: DataFrame) -> DataFrame:
    """A reference table computed once, as a table in the shared folder.

    Spark knows the size of its files when it plans joins with it: below
    `spark.sql.autoBroadcastJoinThreshold` it is broadcast, above that the join shuffles. Nothing is
    held in executors' memory, a caller's cache is left alone, and lost executors cost nothing.
    """
    return written(table)


def lookup_join(
    facts: DataFrame, table: DataFrame, on: Sequence[str], how: str = "left"
) -> DataFrame:
    """Join facts to a reference table of measured size.

    While the table is small a hot key on the fact side costs nothing, as facts
    are not shuffled; beyond that adaptive execution splits the hot keys.
    """
    return facts.join(measured(table), list(on), how)
