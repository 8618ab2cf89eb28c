"""Question drift: centroids, cosine drift and skip states."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from veriscope import constants as K
from veriscope.functions import vectors as V
from veriscope.functions.text import agent_key
from veriscope.operators.lookup import lookup_join
from veriscope.operators.ordering import latest_per_key, top_per_key


def centroids(vectors: DataFrame, agent: str = "agent_type", vector: str = "embedding") -> DataFrame:
    """Mean of the non-zero vectors per agent: (agent, centroid, num_queries, version).

    `num_queries` counts every vector, also the dropped ones. An agent whose
    vectors are all zero gets no row. Should an agent mix dimensions, the one
    most of its vectors have is used.
    """
    source = vectors.select(F.col(agent).cast("string").alias(agent), vector)
    partial = source.mapInArrow(
        V.partial_sums(agent, vector, K.ZERO_NORM),
        f"`{agent}` string, dimension int, seen long, used long, sums array<double>",
    )
    counts = partial.groupBy(agent, "dimension").agg(
        F.sum("seen").alias("seen"), F.sum("used").alias("used")
    )
    chosen = counts.groupBy(agent).agg(
        F.sum("seen").alias("num_queries"),
        F.max_by(F.struct("dimension", "used"), F.struct("used", "dimension")).alias("pick"),
    )
    totals = (
        partial.select(agent, "dimension", F.posexplode("sums").alias("pos", "part"))
        .groupBy(agent, "dimension", "pos")
        .agg(F.sum("part").alias("total"))
        .groupBy(agent, "dimension")
        .agg(F.array_sort(F.collect_list(F.struct("pos", "total"))).alias("totals"))
    )
    joined = totals.join(
        chosen.select(agent, "num_queries", "pick.dimension", "pick.used"), [agent, "dimension"]
    ).filter(F.col("used") > 0)
    mean = F.transform("totals", lambda t: t["total"] / F.col("used"))
    return joined.select(
        agent, mean.alias("centroid"), "num_queries", F.lit(1).alias("version")
    )


def drift_class(similarity: Column) -> Column:
    return (
        F.when(similarity >= K.SIMILARITY_NORMAL, "normal")
        .when(similarity >= K.SIMILARITY_MEDIUM, "medium")
        .otherwise("high")
    )


def drift_quality(score: Column) -> Column:
    """1 - drift, not below 0; 0.5 when no drift could be computed."""
    return F.when(score.isNull(), 0.5).otherwise(F.greatest(F.lit(0.0), 1.0 - score))


def score_drift(
    queries: DataFrame,
    baselines: DataFrame,
    agent: str = "agent_type",
    vector: str = "embedding",
    keep_baselines: bool = True,
) -> DataFrame:
    """Drift of each query vector from its agent's centroid.

    Adds similarity_to_baseline, drift_score, drift_classification, is_anomaly
    and `stored`: false for the skip states, which score 0. Streams pass
    `keep_baselines=False`, as a kept table would hide later baselines.
    """
    table = baselines.select(F.col(agent), F.col("centroid").alias("__centroid"))
    named = queries.withColumn(agent, F.col(agent).cast("string"))
    joined = lookup_join(named, table, [agent]) if keep_baselines else named.join(table, [agent], "left")
    measured = joined.withColumns(
        {"__norm": V.norm(vector), "__cos": V.cosine(vector, "__centroid")}
    )
    skip = (
        F.when(F.col("__norm") < K.ZERO_NORM, "embedding_failed")
        .when(F.col("__centroid").isNull(), "no_baseline")
        .when(F.size(vector) != F.size("__centroid"), "dimension_mismatch")
    )
    scored = measured.withColumn("__skip", skip)
    live = F.col("__skip").isNull()
    similarity = F.when(live, F.col("__cos")).otherwise(0.0)
    return scored.withColumns(
        {
            "similarity_to_baseline": similarity,
            "drift_score": F.when(live, 1.0 - F.col("__cos")).otherwise(0.0),
            "drift_classification": F.coalesce("__skip", drift_class(F.col("__cos"))),
            "is_anomaly": live & (F.col("__cos") < K.SIMILARITY_MEDIUM),
            "stored": live,
        }
    ).drop("__norm", "__cos", "__centroid", "__skip")


def baseline_in_force(baselines: DataFrame, agent: str = "agent_type") -> DataFrame:
    """Newest version per agent."""
    return latest_per_key(baselines, [agent], ["version"])


def agents_without_baseline(
    agents: DataFrame, baselines: DataFrame, agent: str = "agent_type"
) -> DataFrame:
    """Agents whose baseline is missing or a zero vector."""
    valid = baselines.filter(V.norm("centroid") >= K.ZERO_NORM).select(agent)
    return agents.join(valid, [agent], "left_anti")


def baseline_questions(
    sources: list[DataFrame], agent: str = "agent_type", position: str = "position", most: int = K.BASELINE_QUESTIONS,
) -> DataFrame:
    """First `most` questions per agent from the first source that knows the agent.

    `sources` come in order of preference, each with (agent, position, query_text).
    """
    tagged = None
    for priority, source in enumerate(sources):
        part = source.withColumns(
            {"__priority": F.lit(priority), agent: agent_key(F.col(agent))}
        )
        tagged = part if tagged is None else tagged.unionByName(part)
    best = tagged.groupBy(agent).agg(F.min("__priority").alias("__priority"))
    chosen = lookup_join(tagged, best, [agent, "__priority"], "inner").drop("__priority")
    return top_per_key(chosen, [agent], [F.col(position)], most)


def unscored(queries: DataFrame, drift: DataFrame, key: str = "query_id") -> DataFrame:
    """Successful queries that have no drift row yet."""
    return queries.filter(F.col("status") == "success").join(drift.select(key), [key], "left_anti")
