import json

import pytest
from pyspark.sql import functions as F

from tessera.functions import canon
from tessera.sources import lineage, records
from tessera.streaming import ledger


def test_jsonl(spark, tmp_path):
    path = tmp_path / "a.jsonl"
    path.write_text('{"action": "go", "valid": true}\n\n{"action": null, "valid": false}\n')
    df = records.read_table(spark, str(path), records.DRAW)
    assert [(r["action"], r["valid"]) for r in df.collect()] == [("go", True), (None, False)]
    (tmp_path / "bad.jsonl").write_text('{"action": "go"\n')
    with pytest.raises(Exception):
        records.read_jsonl(spark, str(tmp_path / "bad.jsonl"), records.DRAW).collect()
    assert list(records.canonical_lines(df, ["valid"])) == ['{"action":null,"valid":false}', '{"action":"go","valid":true}']


def test_sinks_never_overwrite(spark, tmp_path):
    for suffix in ("parquet", "jsonl"):
        path = str(tmp_path / f"x.{suffix}")
        records.write_table(spark.range(3), path)
        with pytest.raises(Exception):
            records.write_table(spark.range(3), path)
    assert records.read_table(spark, [str(tmp_path / "x.parquet")] * 2).count() == 6


def test_merge_and_hash_check(spark):
    merged, violations = records.merge_shards([spark.range(3), spark.range(2, 4)], "id")
    assert merged.count() == 5 and [r["key"] for r in violations.collect()] == ["2"]
    df = spark.createDataFrame([("a",)], "x string").withColumn("h", canon.text_sha256(F.col("x")))
    assert records.verified(df, "h", canon.text_sha256(F.col("x"))).count() == 1
    with pytest.raises(Exception):
        records.verified(df.withColumn("x", F.lit("b")), "h", canon.text_sha256(F.col("x"))).collect()


def test_training_log(spark):
    lines = spark.createDataFrame([("step:3 - loss:0.25 - lr:1e-05",), ("nothing",)], "value string")
    assert [tuple(r) for r in records.training_log(lines, ["loss", "lr"]).collect()] == [(3, 0.25, 1e-05)]


def test_lineage(spark, tmp_path):
    for name in ("a", "b"):
        (tmp_path / name / "in").mkdir(parents=True)
        (tmp_path / name / "in" / "f.txt").write_text("x")
        (tmp_path / name / "g.txt").write_text("y")
    one, two = (lineage.tree_fingerprint(spark, str(tmp_path / n)) for n in ("a", "b"))
    assert one == two
    (tmp_path / "b" / "g.txt").write_text("z")
    assert lineage.tree_fingerprint(spark, str(tmp_path / "b")) != one
    assert lineage.table_digest(spark.range(9)) == lineage.table_digest(spark.range(9).repartition(3)) != lineage.table_digest(spark.range(8))
    m = lineage.manifest({"a": {"path": "/x", "sha256": "1"}}, {}, {})
    assert m["identity"] == lineage.manifest({"a": {"path": "/y", "sha256": "1"}}, {}, {})["identity"]
    assert json.loads(lineage.manifest_json(m))["inputs"]["a"]["path"] == "/x"


def test_stream_equals_batch(spark, tmp_path):
    source = spark.read.parquet("/root/testdata/sf0.001/events.parquet").select("event_id", "ts", "event_type")
    source.unionByName(source.where("event_id < 20")).repartition(4).write.parquet(str(tmp_path / "in"))
    stream = ledger.ledger_stream(spark, str(tmp_path / "in"), source.schema)
    counts = ledger.status_counts(ledger.accepted(stream, "event_id", "ts", "60 days"), "ts", "event_type", "1 day", None)
    q = counts.writeStream.format("memory").queryName("counts").outputMode("update").trigger(availableNow=True).option("checkpointLocation", str(tmp_path / "cp")).start()
    q.awaitTermination(120)
    got = spark.table("counts").groupBy("window_start", "event_type").agg(F.max("n").alias("n"))
    want = ledger.status_counts(source.withColumn("ts", F.col("ts").cast("timestamp")), "ts", "event_type", "1 day")
    assert got.exceptAll(want).count() == want.exceptAll(got).count() == 0 and want.count() > 0


def test_entry_module_without_the_llm_folder(tmp_path):
    """The rest imports and registers its queries when the subpackage is gone."""
    import os
    import shutil
    import subprocess
    import sys

    root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    shutil.copytree(f"{root}/tessera", tmp_path / "tessera", ignore=shutil.ignore_patterns("llm", "__pycache__"))
    shutil.copy(f"{root}/__spark_entry__.py", tmp_path)
    code = "import __spark_entry__ as e; q = e.queries(); assert 'l2_nested_selection' in q and not any(k.startswith('op') or k == 'pipeline' for k in q); e.oracle_sql()"
    subprocess.run([sys.executable, "-c", code], cwd=tmp_path, check=True, env=os.environ | {"PYTHONPATH": str(tmp_path)})


def test_files(spark, tmp_path):
    import numpy as np

    from tessera.sources import files

    assert files.plain({"a": np.array([[1, 2], [3, 4]]), 5: (np.float64(0.5), None)}) == {"a": [[1, 2], [3, 4]], "5": [0.5, None]}
    (tmp_path / "configs").mkdir()
    (tmp_path / "configs" / "one.yaml").write_text('{"seed": 3, "data": {"size": [1, 2]}}')
    assert [json.loads(r["config"]) for r in files.configs(spark, str(tmp_path / "configs")).collect()] == [{"seed": 3, "data": {"size": [1, 2]}}]
    df = spark.range(5)
    at = str(tmp_path / "done")
    assert files.committed(df, at).count() == 5 and not (tmp_path / "done.partial").exists()
    with pytest.raises(FileExistsError):
        files.committed(df, at)
    with pytest.raises(ValueError):
        files.cached_list(lambda: df.select(F.lit("test").alias("split")), "x", "train", spark)
    paths = spark.createDataFrame([("/d/pick-Mug/trial_1/game.z8",), ("/d/pick-movable/trial_1/game.z8",), ("/d/pick-Mug/trial_1/note.txt",)], "path string")
    assert [(r["task"], r["trial"]) for r in files.episodes(paths, skipped=("movable",)).collect()] == [("pick-Mug", "trial_1")]
    (tmp_path / "code").mkdir()
    (tmp_path / "code" / "a.py").write_text("x = 1\n")
    first = files.code_fingerprint(spark, str(tmp_path / "code"))
    (tmp_path / "code" / "a.log").write_text("noise")
    assert files.code_fingerprint(spark, str(tmp_path / "code")) == first
    (tmp_path / "code" / "b.py").write_text("y = 2\n")
    assert files.code_fingerprint(spark, str(tmp_path / "code")) != first


def test_tables_in_the_shared_folder(spark):
    from tessera.sources.shared import discard, durable

    made = durable(spark.range(7), "seven")
    assert made.count() == 7
    discard(made)
    with pytest.raises(Exception):
        spark.read.parquet(made._durable_path)
