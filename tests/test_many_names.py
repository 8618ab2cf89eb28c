from pyspark.sql import functions as F

from veriscope.functions import intents


def test_names_beyond_the_twentieth_count(spark):
    measures, dimensions = [f"m{i:02d}" for i in range(30)], [f"d{i}" for i in range(30)]
    df = spark.createDataFrame([("m05 for each d1",), ("m25 for each d1",)], "q string")
    got = [r.x for r in df.select(intents.requested(F.col("q"), measures, dimensions).alias("x")).collect()]
    assert got[0] == got[1] and "grouping" in got[0]
