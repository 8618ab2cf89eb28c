import json
import random

import pytest
from pyspark.sql import functions as F

from veriscope.sources import files as I
from veriscope.sources.json_documents import read_entries


def text_of(rng):
    return "".join(rng.choice('ab}{][":,\\ \né中') for _ in range(rng.randrange(40)))


def entries_of(rng, n):
    return [
        {"query_text": f"q{i} {text_of(rng)}", "sql": text_of(rng), text_of(rng): {"deep": [{"x": text_of(rng)}, [], [{}]]}, "big": text_of(rng) * rng.choice((0, 0, 9))}
        for i in range(n)
    ]


@pytest.mark.parametrize("split", [150, 1 << 20])
def test_one_document_is_read_by_many_tasks(spark, tmp_path, split):
    rng = random.Random(split)
    wanted = {}
    for name, wrap in {
        "list.json": lambda e: e,
        "object.json": lambda e: {"agent} \"id\"": text_of(rng), "metadata": {"queries": [{"no": 1}], "z": [{"queries": 2}]}, "queries": e, "notes": [{"no": "entry"}] * 3},
        "pretty.json": lambda e: {"total_queries": len(e), "queries": e},
        "empty.json": lambda e: [], "none.json": lambda e: {"queries": []}, "other.json": lambda e: {"notes": e},
    }.items():
        entries = entries_of(rng, 40)
        document = json.dumps(wrap(entries), indent=2 if name == "pretty.json" else None, ensure_ascii=name == "list.json")
        (tmp_path / name).write_text(document, encoding="utf-8")
        wanted[name] = entries if name in ("list.json", "object.json", "pretty.json") else []
    (tmp_path / "blank.json").write_text("")
    spark.conf.set("spark.sql.files.maxPartitionBytes", split)
    spark.conf.set("spark.sql.files.openCostInBytes", 1)
    try:
        found = read_entries(spark, str(tmp_path))
        rows = found.select("position.*", "text").orderBy("file", "start", "seq").collect()
        got = {}
        for r in rows:
            got.setdefault(r.file.rsplit("/", 1)[1], []).append(json.loads(r.text))
        assert got == {k: v for k, v in wanted.items() if v}
        starts = {r.start for r in rows if r.file.endswith("object.json")}
        assert len(starts) > 5 or split > 10_000
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
        spark.conf.unset("spark.sql.files.openCostInBytes")


def test_the_last_entry_of_the_last_file_wins(spark, tmp_path):
    (tmp_path / "a.json").write_text(json.dumps([{"query": "How many?", "sql": "1"}, {"natural_language": " how MANY? ", "sql": "2"}, {"query": ""}]))
    (tmp_path / "b.json").write_text(json.dumps({"queries": [{"query_text": "how many", "sql": "3", "complexity": "complex"}, {"query": "other", "sql": None}]}))
    rows = I.ground_truth_index(I.read_ground_truth(spark, str(tmp_path))).select("question_key", "sql", "complexity").collect()
    assert {tuple(r) for r in rows} == {("how many", "3", "complex"), ("other", "", "simple")}


def test_what_is_no_json_is_no_error(spark, tmp_path):
    (tmp_path / "x.json").write_text('[{"query": "fine", "sql": "1"}, {"query": "open')
    (tmp_path / "y.json").write_text('}}}]{"queries": 5}')
    rows = I.read_ground_truth(spark, str(tmp_path)).filter(F.col("query").isNotNull()).collect()
    assert [(r["query"], r.sql) for r in rows][0] == ("fine", "1")
