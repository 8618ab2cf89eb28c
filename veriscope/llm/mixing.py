r"""Mixing sources to target weights by capped water-filling.

Sources are poured up to a common level of words per weight; a source stops at `max_epochs` times
its own size and what it cannot take is shared again among the others by weight. Sorted by the
level at which they stop, the sources that stop are a prefix, so the repeated reshare is one
running sum over the sources (one row each).

A source of target t and size s is read t / s times: whole repetitions of every document, then a
fractional one. The fractional one takes documents in a seeded hash order until the words are
reached; the last document is cut (or rounded). The order is found without gathering a source:
words are summed per hash bucket, only the bucket in which the target falls is ordered row by row.
There are as many buckets as keep a bucket near `bucket_rows` documents of the corpus.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from veriscope.llm.registry import query
from veriscope.llm.shared import WORD, same, staged, table, word_count

HASH_BITS = 52
BEFORE = (Window.unboundedPreceding, -1)


def hash_order(c: Column, seed: int) -> Column:
    """The first 52 bits of the MD5 of seed and value, as long; null counts as empty."""
    text = F.concat(F.lit(f"{seed}:"), F.coalesce(c.cast("string"), F.lit("")))
    return F.conv(F.substring(F.md5(text), 1, HASH_BITS // 4), 16, 10).cast("long")


def water_fill(sources: DataFrame, total: Column | int, max_epochs: float) -> DataFrame:
    """Targets of `sources` (source, source_size, weight): columns of it and `target`.

    target = min(max_epochs * source_size, level * weight), with the one level at which the targets
    add up to `total`; if all sources stop earlier, each has its maximum. Sources of weight 0, of
    null weight or of size 0 get 0. One row per source passes a single-partition window.
    """
    cap = F.col("source_size") * F.lit(float(max_epochs))
    live = sources.withColumn(
        "__w", F.when((F.col("source_size") > 0) & (F.col("weight") > 0), F.col("weight").cast("double")).otherwise(0.0)
    ).withColumn("__cap", F.when(F.col("__w") > 0, cap).otherwise(0.0))
    level = F.when(F.col("__w") > 0, F.col("__cap") / F.col("__w")).otherwise(0.0)
    order = Window.orderBy("__stop", F.col("source").asc_nulls_last())
    ranked = (
        live.withColumn("__stop", level)
        .withColumn("__left", F.lit(total) - F.coalesce(F.sum("__cap").over(order.rowsBetween(*BEFORE)), F.lit(0.0)))
        .withColumn("__open", F.sum("__w").over(order.rowsBetween(0, Window.unboundedFollowing)))
    )
    full = (F.col("__w") > 0) & (F.col("__cap") * F.col("__open") <= F.col("__w") * F.col("__left"))
    # the first source that stays below its maximum fixes the level of all behind it
    first = F.min(F.when((F.col("__w") > 0) & ~full, F.struct("__stop", "__left", "__open"))).over(Window.partitionBy())
    open_at = ranked.withColumn("__full", full).withColumn("__first", first)
    target = (
        F.when(F.col("__w") <= 0, 0.0)
        .when(F.col("__full"), F.col("__cap"))
        .otherwise(F.col("__w") * F.col("__first.__left") / F.col("__first.__open"))
    )
    return open_at.withColumn("target", target).select(*sources.columns, "target")


def mix(
    documents: DataFrame, weights: DataFrame, *, key: str = "doc_id", source: str = "source", size: Column,
    budget: float = 1.0, max_epochs: float = 3.0, seed: int = 17, cut: bool = True, bucket_rows: int = 50_000,
) -> DataFrame:
    """One row per document: key, source, size, source_size, target, repetitions, cut_size, taken.

    `weights` (source, weight) names the weights of sources, null being a source like others; a source
    without a row has weight 0. The mix has `budget` times the words of all documents. A document is
    taken `repetitions` times as a whole and `cut_size` words of it once more; taken = repetitions *
    size + cut_size. With `cut` the last document of the fractional repetition is cut so that a source
    takes its target to the word; without, it is taken whole if at least half of it is wanted.

    Rows of equal key and hash stand in the order together: each takes the same share. Documents
    without words take 0 words and have the whole repetitions only; sources of size 0 have target 0.
    An empty table gives no row. The seed and the keys alone decide, so reruns agree.
    """
    spark = documents.sparkSession
    docs = staged(
        documents.select(
            F.col(key).alias("key"), F.col(source).alias("source"), size.cast("long").alias("size"),
            hash_order(F.col(key), seed).alias("place"),
        ),
        "mix",
    )
    rows = docs.count()
    bits = min(HASH_BITS, max(0, (rows // bucket_rows).bit_length()))
    docs = docs.withColumn("bucket", F.shiftright("place", HASH_BITS - bits))
    sums = staged(docs.groupBy("source", "bucket").agg(F.sum("size").alias("words")), "mix")

    named = weights.select(F.col("source").alias("w_source"), F.col("weight").cast("double").alias("weight"))
    sizes = sums.groupBy("source").agg(F.sum("words").alias("source_size"))
    weighed = sizes.join(named, F.col("source").eqNullSafe(F.col("w_source")), "left").drop("w_source")
    total = sizes.agg(F.coalesce(F.sum("source_size"), F.lit(0)).alias("n")).first().n * budget
    poured = staged(
        water_fill(weighed, F.lit(float(total)), max_epochs)
        # words are whole before they are divided: a target just below a repetition is that repetition
        .withColumn("due", F.round("target").cast("long"))
        .withColumn("whole", F.when(F.col("source_size") > 0, F.floor(F.col("due") / F.col("source_size"))).otherwise(0))
        .withColumn("part", F.col("due") - F.col("whole") * F.col("source_size")),
        "mix",
    )

    # the bucket of each source in which the fractional repetition ends, then the place in it
    per_source = Window.partitionBy("source")
    ends = (
        sums.join(poured.select(F.col("source").alias("p_source"), "part"), F.col("source").eqNullSafe(F.col("p_source")))
        .withColumn("before", F.coalesce(F.sum("words").over(per_source.orderBy("bucket").rowsBetween(*BEFORE)), F.lit(0)))
        .filter((F.col("part") >= F.col("before")) & (F.col("part") < F.col("before") + F.col("words")))
        .select("source", "bucket", "part", "before")
    )
    named_ends = ends.select(*[F.col(c).alias(f"e_{c}") for c in ends.columns])
    groups = (
        docs.join(named_ends, same("", "e_", "source", "bucket"))
        .groupBy("source", "place", "key", "e_part", "e_before")
        .agg(F.sum("size").alias("words"))
        .withColumn(
            "at",
            F.col("e_before")
            + F.coalesce(
                F.sum("words").over(per_source.orderBy("place", F.col("key").asc_nulls_first()).rowsBetween(*BEFORE)), F.lit(0)
            ),
        )
        .filter((F.col("e_part") >= F.col("at")) & (F.col("e_part") < F.col("at") + F.col("words")))
        .select(
            F.col("source").alias("c_source"), F.col("place").alias("c_place"), F.col("key").alias("c_key"),
            ((F.col("e_part") - F.col("at")) / F.col("words")).alias("c_share"),
        )
    )
    plan = staged(
        poured.join(groups, F.col("source").eqNullSafe(F.col("c_source")), "left").select(
            F.col("source").alias("p_source"), "source_size", "target", "whole", "part", "c_place", "c_key", "c_share"
        ),
        "mix",
    )
    ahead = (F.col("place") < F.col("c_place")) | (
        (F.col("place") == F.col("c_place")) & F.coalesce(F.struct("key") < F.struct(F.col("c_key").alias("key")), F.lit(False))
    )
    cut_here = (F.col("place") == F.col("c_place")) & F.col("key").eqNullSafe(F.col("c_key"))
    wanted = F.col("c_share") * F.col("size")
    extra = F.when(ahead, 1).when(cut_here & F.lit(not cut) & (F.col("c_share") >= 0.5), 1).otherwise(0)
    partly = F.when(cut_here & F.lit(cut), F.floor(wanted)).otherwise(0)
    return (
        docs.join(plan, F.col("source").eqNullSafe(F.col("p_source")))
        .withColumn("repetitions", (F.col("whole") + extra).cast("long"))
        .withColumn("cut_size", partly.cast("long"))
        .select(
            F.col("key").alias(key), F.col("source").alias(source), "size", "source_size", "target", "repetitions", "cut_size",
            (F.col("repetitions") * F.col("size") + F.col("cut_size")).alias("taken"),
        )
    )


def weights_in_turn(documents: DataFrame, turn: tuple[float, ...] = (5.0, 2.0, 1.0), source: str = "source") -> DataFrame:
    """Weights for the sources in code point order, null last, repeating `turn`. One row per source is ordered."""
    place = F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1
    values = F.array(*[F.lit(float(x)) for x in turn])
    return (
        documents.select(F.col(source).alias("source")).distinct()
        .withColumn("weight", F.element_at(values, (place % len(turn) + 1).cast("int")))
    )


SEED, EPOCHS = 17, 3


@query("op1_source_mix", rf"""
WITH d AS (
  SELECT doc_id, source, coalesce(len(regexp_extract_all(text, '{WORD}')), 0)::BIGINT AS size,
    ('0x' || substr(md5('{SEED}:' || coalesce(doc_id::VARCHAR, '')), 1, 13))::BIGINT AS place FROM documents),
s AS (
  SELECT source, sum(size)::BIGINT AS source_size,
    [5.0, 2.0, 1.0][((row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1)::INT]::DOUBLE AS w FROM d GROUP BY source),
o AS (
  SELECT *, {EPOCHS}.0::DOUBLE * source_size AS cap, sum(source_size) OVER () AS total,
    CASE WHEN source_size > 0 THEN {EPOCHS}.0::DOUBLE * source_size / w ELSE 0 END AS stop,
    CASE WHEN source_size > 0 THEN w ELSE 0 END AS v FROM s),
r AS (
  SELECT *, total::DOUBLE - coalesce(sum(cap) OVER (ORDER BY stop, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS rest,
    sum(v) OVER (ORDER BY stop, source NULLS LAST ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS open FROM o),
f AS (SELECT *, v > 0 AND cap * open <= v * rest AS is_full FROM r),
l AS (SELECT rest AS l_rest, open AS l_open FROM f WHERE v > 0 AND NOT is_full ORDER BY stop, source NULLS LAST LIMIT 1),
t AS (
  SELECT source, source_size, CASE WHEN v <= 0 THEN 0 WHEN is_full THEN cap ELSE v * l_rest / l_open END AS target
  FROM f LEFT JOIN l ON true),
p AS (
  SELECT *, CASE WHEN source_size > 0 THEN floor(target / source_size)::BIGINT ELSE 0 END AS whole FROM t),
q AS (SELECT *, greatest(round(target)::BIGINT - whole * source_size, 0) AS part FROM p),
g AS (
  SELECT d.source, d.doc_id, place, part, sum(size)::BIGINT AS words FROM d JOIN q ON d.source IS NOT DISTINCT FROM q.source
  GROUP BY ALL),
c AS (
  SELECT *, coalesce(sum(words) OVER (PARTITION BY source ORDER BY place, doc_id NULLS FIRST
    ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS at FROM g)
SELECT d.doc_id, d.size, q.source_size, q.target,
  (q.whole * d.size + CASE WHEN c.at + c.words <= c.part AND (c.words > 0 OR c.at < c.part) THEN d.size
    WHEN c.at <= c.part AND c.words > 0 THEN floor((c.part - c.at)::DOUBLE / c.words * d.size)::BIGINT ELSE 0 END)::BIGINT AS taken
FROM d JOIN q ON d.source IS NOT DISTINCT FROM q.source
JOIN c ON d.source IS NOT DISTINCT FROM c.source AND d.doc_id IS NOT DISTINCT FROM c.doc_id AND d.place = c.place""")
def op1_source_mix(spark: SparkSession, folder: str) -> DataFrame:
    documents = table(spark, folder, "documents").select("doc_id", "source", "text")
    mixed = mix(documents, weights_in_turn(documents), size=word_count(F.col("text")), max_epochs=float(EPOCHS), seed=SEED)
    return mixed.select("doc_id", "size", "source_size", "target", "taken")
