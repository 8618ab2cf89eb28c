"""Pipeline over `documents`: toxicity, near duplicates, secrets, source mix, packing.

Every stage takes (spark, docs, sf_dir) and is written as Parquet before the next one reads it. All but the
last return the columns of `documents`.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from veriscope.llm import mixing, near_duplicates, packing, secrets, toxicity
from veriscope.llm.shared import staged, table, word_count

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]


def _digest():
    return F.md5(F.coalesce(F.col("text"), F.lit("")))


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the chain does not find toxic; fitted on those of them that have labels."""
    chain = toxicity.train_chain(docs, table(spark, sf_dir, "labels"), toxicity.label_categories())
    return toxicity.without_flagged(docs, chain)


def one_of_each_group(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document per group of near duplicates (5 words, 0.8); documents without words stay.

    Of repeated rows with the smallest id of a group one stays. Groups are told apart by their texts, so unrelated
    documents without an id or with the same id all stay.
    """
    rows = docs.withColumn("__digest", _digest())
    judged = near_duplicates.near_duplicates(
        rows.select("doc_id", "text", "__digest"), width=5, percent=80, keep=("__digest",), identity="__group"
    )
    kept = (
        judged.filter("kept AND n_shingles > 0").groupBy("__group")
        .agg(F.first("component_id").alias("k_id"), F.min("__digest").alias("k_digest")).select("k_id", "k_digest")
    )
    same = F.col("doc_id").eqNullSafe(F.col("k_id")) & (F.col("__digest") == F.col("k_digest"))
    copy = F.struct(*[c for c in docs.columns])
    with_words = rows.filter(word_count(F.col("text")) > 0).join(kept, same, "left_semi")
    chosen = with_words.groupBy("doc_id", "__digest").agg(F.min(copy).alias("d")).select("d.*")
    return chosen.unionByName(docs.filter(word_count(F.col("text")) == 0)).select(*docs.columns)


def without_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Live-looking secrets become <SECRET>; n_chars of a changed text is counted anew."""
    rows = docs.withColumn("__digest", _digest())
    found = secrets.find_secrets(rows, repository=F.concat_ws("/", "source", "lang"), keep=("__digest",))
    ranges = (
        found.select("__digest", secrets.live_ranges(F.col("spans")).alias("__ranges")).filter(F.size("__ranges") > 0)
        .groupBy("__digest").agg(F.min("__ranges").alias("__ranges"))
    )
    marked = rows.join(staged(ranges, "ranges"), "__digest", "left").withColumn(
        "__text", secrets.redact(F.col("text"), F.col("__ranges"))
    )
    changed = F.col("__ranges").isNotNull()
    values = {"text": F.col("__text"), "n_chars": F.when(changed, F.length("__text").cast("long")).otherwise(F.col("n_chars"))}
    return marked.select(*[values.get(c, F.col(c)).alias(c) for c in docs.columns])


def mixed_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document as often as the mix takes it: sources weigh 5, 2, 1 in turn, at most 3 epochs, all words in total.

    Fractional repetitions take whole documents, so a text is never cut.
    """
    rows = docs.withColumn("__key", F.concat_ws(":", F.coalesce(F.col("doc_id").cast("string"), F.lit("")), _digest()))
    mixed = mixing.mix(
        rows, mixing.weights_in_turn(docs), key="__key", size=word_count(F.col("text")), max_epochs=float(mixing.EPOCHS),
        seed=mixing.SEED, cut=False,
    )
    times = mixed.groupBy("__key", "source").agg(F.max("repetitions").alias("__times")).filter("__times > 0").select(
        F.col("__key").alias("m_key"), F.col("source").alias("m_source"), "__times"
    )
    taken = rows.join(times, (F.col("__key") == F.col("m_key")) & F.col("source").eqNullSafe(F.col("m_source")))
    return taken.withColumn("__copy", F.explode(F.sequence(F.lit(1), F.col("__times").cast("int")))).select(*docs.columns)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of sequences of 2048 tokens with their ids."""
    import public_tokenizers

    return packing.pack(docs, tokenizer=public_tokenizers.path("word_bpe_49k.json"), words=True, end_id=packing.END_ID)


STAGES: list[tuple[str, Stage]] = [
    ("toxicity", drop_toxic),
    ("near_duplicates", one_of_each_group),
    ("secrets", without_secrets),
    ("source_mix", mixed_sources),
    ("packing", packed),
]

#: Signatures, fitted models and tokenizers have no SQL; the stages are tested against brute-force versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over `documents`, each written and read again."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = staged(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
