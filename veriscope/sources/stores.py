"""Writing and maintaining stored tables without a transactional format.

A table is a folder of parquet files. Versions are appended with a batch
number; readers see the newest version per key.
"""

from __future__ import annotations

from collections.abc import Sequence
from datetime import datetime

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from veriscope.operators.lookup import measured
from veriscope.operators.ordering import rank_within


def upsert(old: DataFrame, new: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Old rows with those of `new` replacing equal keys; `new` has one row per key.

    While the batch is small its keys are broadcast and the old rows are not
    shuffled.
    """
    return old.join(new.select(*keys), list(keys), "left_anti").unionByName(new)


def replace_agents(old: DataFrame, new: DataFrame, agents: DataFrame, key: str = "agent_id") -> DataFrame:
    """All rows of the given agents replaced, also by nothing."""
    return old.join(measured(agents.select(key).distinct()), [key], "left_anti").unionByName(new)


def write_agents(df: DataFrame, path: str, key: str = "agent_id") -> None:
    """Overwrite only the partitions of the agents in `df`."""
    df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(key).parquet(path)


def append(df: DataFrame, path: str) -> None:
    df.write.mode("append").parquet(path)


def delete_agents(tables: dict[str, DataFrame], agents: DataFrame, dead_ids: DataFrame) -> dict[str, DataFrame]:
    """Remaining rows of every table after agents were deleted.

    `agents` is the registry (agent_id, agent_name), `dead_ids` the ids to
    delete. Tables keyed by query lose the rows of the agents' queries, tables
    keyed by agent lose the agents' rows.
    """
    doomed = agents.join(dead_ids.select("agent_id"), ["agent_id"], "left_semi")
    names = measured(doomed.select(F.col("agent_name").alias("agent_type")))
    dead_queries = tables["queries"].join(names, ["agent_type"], "left_semi").select("query_id")
    out = {"agents": agents.join(dead_ids.select("agent_id"), ["agent_id"], "left_anti")}
    for name, df in tables.items():
        if "agent_type" in df.columns:
            out[name] = df.join(names, ["agent_type"], "left_anti")
        else:
            out[name] = df.join(dead_queries, ["query_id"], "left_anti")
    return out


def register_telemetry(events: DataFrame, agents: DataFrame, by: str = "agent_name") -> DataFrame:
    """Telemetry of registered agents; the agent name always comes from the registry."""
    known = agents.select("agent_id", "agent_name", F.lower("agent_name").alias("__name"))
    if by == "agent_id":
        joined = events.join(known, ["agent_id"])
    else:
        joined = events.join(known, F.lower("agent_type") == F.col("__name"))
    return joined.withColumn("agent_type", F.col("agent_name")).drop("agent_name", "__name")


def rejected_telemetry(events: DataFrame, agents: DataFrame) -> DataFrame:
    known = agents.select(F.lower("agent_name").alias("__name"))
    return events.join(known, F.lower("agent_type") == F.col("__name"), "left_anti")


def apply_rules(df: DataFrame, rules: Sequence[tuple[str, str]], text: str = "query_text",
                sql: str = "generated_sql", placeholder: str = "SELECT 1") -> DataFrame:
    """SQL of placeholder rows set by the first rule whose keyword occurs in the text."""
    chain: Column | None = None
    for keyword, statement in rules:
        hit = (F.col(sql) == placeholder) & F.contains(F.lower(text), F.lit(keyword.lower()))
        chain = F.when(hit, statement) if chain is None else chain.when(hit, statement)
    return df.withColumn(sql, F.col(sql) if chain is None else chain.otherwise(F.col(sql)))


def drop_entries(entries: DataFrame, text: str, column: str = "query_text") -> DataFrame:
    return entries.filter(~F.col(column).eqNullSafe(F.lit(text)))


def append_entries(existing: DataFrame, new: DataFrame, order_by: Sequence[Column], key: str = "query_id",
                   position: str = "position") -> DataFrame:
    """New entries numbered after the largest existing id."""
    top = existing.agg(F.coalesce(F.max(key), F.lit(0)).alias("__top"))
    numbered = rank_within(new, [], order_by, "__rank").join(top).withColumn(
        key, F.col("__top") + F.col("__rank")
    )
    return existing.unionByName(numbered.select(*existing.columns))


def update_log(agent_id, agent_name: str, new: DataFrame, at: datetime) -> DataFrame:
    return new.agg(F.count("*").alias("queries_added")).select(
        F.lit(agent_id).alias("agent_id"), F.lit(agent_name).alias("agent_name"),
        F.lit(at).cast("timestamp_ntz").alias("updated_at"), "queries_added",
    )


def split_dataset(entries: DataFrame, key: str, seed: int = 42) -> DataFrame:
    """Exact 60/30/10 split of rows in hash order: train, test, validation."""
    hashed = entries.withColumn("__order", F.xxhash64(F.col(key), F.lit(seed)))
    ranked = rank_within(hashed, [], [F.col("__order"), F.col(key)], "__rank")
    total = entries.agg(F.count("*").alias("__total"))
    # fixed values: share of each part
    train, test = F.floor(F.col("__total") * 0.6), F.floor(F.col("__total") * 0.3)
    part = (
        F.when(F.col("__rank") <= train, "train")
        .when(F.col("__rank") <= train + test, "test").otherwise("validation")
    )
    return ranked.join(total).withColumn("split", part).drop("__order", "__rank", "__total")


class GroundTruthStore:
    """Ground-truth entries by agent name under one folder; the path scheme picks the storage."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")

    def path(self, agent: str) -> str:
        key = agent.lower().replace(" ", "_").replace("_agent", "")
        return f"{self.root}/{key}_agent_queries.json"

    def _hadoop(self, path: str):
        jvm = self.spark.sparkContext._jvm
        target = jvm.org.apache.hadoop.fs.Path(path)
        return target.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()), target

    def save(self, agent: str, entries: DataFrame) -> None:
        entries.write.mode("overwrite").json(self.path(agent))

    def load(self, agent: str, schema) -> DataFrame | None:
        if not self.exists(agent):
            return None
        return self.spark.read.schema(schema).json(self.path(agent))

    def exists(self, agent: str) -> bool:
        fs, target = self._hadoop(self.path(agent))
        return fs.exists(target)

    def delete(self, agent: str) -> bool:
        fs, target = self._hadoop(self.path(agent))
        return fs.delete(target, True)


def agent_dimension(log: DataFrame) -> DataFrame:
    """Agents from a registration and status log: first name, latest status and error."""
    return log.groupBy("agent_id").agg(
        F.min_by("agent_name", "at").alias("agent_name"),
        F.coalesce(F.max_by("status", "at"), F.lit("pending")).alias("status"),
        F.max_by(F.struct("error"), "at")["error"].alias("error"),
        F.min("at").alias("created_at"),
        F.max("at").alias("updated_at"),
    )


def ground_truth_status(attempts: DataFrame) -> DataFrame:
    """Status per agent from an attempt log (agent_id, at, status, error, query_count, retry_count).

    A success clears the error; counts keep their last known value. A retry is
    allowed unless an attempt runs or has succeeded.
    """
    latest = attempts.groupBy("agent_id").agg(
        F.max_by("status", "at").alias("gt_status"),
        F.max_by(F.struct("error"), "at")["error"].alias("__error"),
        F.max_by("query_count", F.when(F.col("query_count").isNotNull(), F.col("at"))).alias("gt_query_count"),
        F.max_by("retry_count", F.when(F.col("retry_count").isNotNull(), F.col("at"))).alias("gt_retry_count"),
    )
    return latest.withColumns(
        {
            "gt_error": F.when(F.col("gt_status") == "failed", F.col("__error")),
            "gt_retry_count": F.coalesce("gt_retry_count", F.lit(0)),
            "can_retry": ~F.col("gt_status").isin("in_progress", "success"),
        }
    ).drop("__error")


def entries_per_agent(entries: DataFrame, agent: str = "agent_type") -> DataFrame:
    """Entries of the two main agents and of all others."""
    group = F.when(F.lower(agent).isin("spend", "demand"), F.lower(agent)).otherwise("other")
    return entries.groupBy(group.alias("agent_group")).agg(F.count("*").alias("n"))


