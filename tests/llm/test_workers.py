"""The package reaches Python workers that cannot import it themselves."""

import os
import subprocess
import sys
from pathlib import Path

ROOT = Path(__file__).resolve().parents[2]

# the driver imports from a path of its own; workers start elsewhere and are not told of it
SCRIPT = """
import sys
sys.path.insert(0, sys.argv[1])
from pyspark.sql import SparkSession
spark = SparkSession.builder.master("local[2]").config("spark.ui.enabled", "false").config("spark.sql.shuffle.partitions", "2").getOrCreate()
from veriscope.llm import bisectors, quality_ledger, toxicity
docs = spark.createDataFrame([(1, "some words here"), (2, None)], "doc_id long, text string")
labels = spark.createDataFrame([(1, 1, 0)], "doc_id long, quality int, toxic int")
chain = toxicity.train_chain(docs, labels, toxicity.label_categories())
assert toxicity.score_documents(docs, chain).count() == 2 and toxicity.without_flagged(docs, chain).count() == 2
assert len(quality_ledger.ledger(docs).collect()) == 2
vectors = spark.createDataFrame([(i, [float(i), 1.0]) for i in range(5)], "vec_id long, embedding array<double>")
assert bisectors.cluster(vectors, k=2, dims=2)[0].count() == 5
print("reached")
"""


def test_operators_run_where_only_the_driver_has_the_package(tmp_path):
    script = tmp_path / "job.py"
    script.write_text(SCRIPT)
    env = {k: v for k, v in os.environ.items() if not k.startswith(("PYTHONPATH", "PYSPARK", "SPARK_"))}
    done = subprocess.run([sys.executable, str(script), str(ROOT)], cwd=tmp_path, env=env, capture_output=True, text=True, timeout=300)
    assert "reached" in done.stdout, done.stderr[-3000:]
