"""Sums before a row over split groups, quotas, deep configurations, histories as one array."""

import hashlib
import io
import json
import random
from contextlib import redirect_stdout

import pytest
from pyspark.sql import functions as F

from tessera.operators import audit, history, sampling
from tessera.operators.ranking import running


def attempts(n=900, seed=3):
    rnd = random.Random(seed)
    return [(k, "hot" if k % 4 else rnd.choice(["a", "b", None]), rnd.random() < 0.2 if k % 11 else None) for k in rnd.sample(range(5 * n), n)]


@pytest.mark.parametrize("parts", [1, 7])
def test_sums_before_rows(spark, parts):
    rows = attempts()
    df = spark.createDataFrame(rows, "seq int, g string, ok boolean").repartition(5)
    got = {r["seq"]: (r["solved"], r["tried"]) for r in running(df, "g", ["seq"], {"solved": F.coalesce(F.col("ok").cast("int"), F.lit(0)), "tried": F.lit(1)}, parts=parts).collect()}
    want, seen = {}, {}
    for seq, g, ok in sorted(rows):
        want[seq] = seen.get(g, (0, 0))
        seen[g] = (want[seq][0] + bool(ok), want[seq][1] + 1)
    assert got == want


@pytest.mark.parametrize("quota,most", [(5, 1000), (1000, 50), (1, 1), (40, 600), (0, 5)])
def test_quota_over_split_strata(spark, quota, most):
    rows = attempts()
    df = spark.createDataFrame(rows, "seq int, g string, ok boolean")
    got = {(r["seq"], r["solved_before"], r["tried_before"]) for r in sampling.until_quota(df, quota, most, "seq", "ok", "g", parts=6).collect()}
    want, seen = set(), {}
    for seq, g, ok in sorted(rows):
        solved, tried = seen.get(g, (0, 0))
        if solved < quota and tried < most:
            want.add((seq, solved, tried))
            seen[g] = (solved + bool(ok), tried + 1)
        else:
            seen[g] = (quota, most)
    assert got == want


def test_a_stratum_of_all_rows_runs_in_several_tasks(spark):
    df = spark.range(6000).select(F.col("id").alias("seq"), F.lit("one").alias("g"), (F.col("id") % 5 == 0).alias("ok"))
    made = sampling.until_quota(df, 900, 10_000, "seq", "ok", "g", parts=6).withColumn("task", F.spark_partition_id())
    out = io.StringIO()
    with redirect_stdout(out):
        made.explain()
    windows = [line for line in out.getvalue().splitlines() if " Window " in line]
    assert any("__part" in w for w in windows)
    assert made.count() == 4496  # the 900th success is attempt 4,495
    parts = running(df, "g", ["seq"], {"n": F.lit(1)}, parts=6)
    assert parts.select(F.col("n")).agg(F.max("n"), F.count_distinct("n")).first()[:] == (5999, 6000)


def test_objects_of_any_depth(spark):
    def nest(depth, leaf):
        return {"k": nest(depth - 1, leaf)} if depth else leaf

    deep = {"a": {"b": 1, "list": [1, {"x": 2}], "none": {}}, "deep": nest(40, 7)}
    other = {"a": {"b": 1, "list": [1, {"x": 2}], "none": {}}, "deep": nest(40, 8)}
    df = spark.createDataFrame([("x", json.dumps(deep)), ("y", json.dumps(other))], "run string, config string")
    got = {(r["run"], r["path"]): r["value"] for r in audit.flattened(df, "run", "config").collect()}
    at = "deep" + ".k" * 40
    assert got["x", at] == "7" and got["y", at] == "8" and got["x", "a.b"] == "1" and got["x", "a.none"] == "{}" and json.loads(got["x", "a.list"]) == [1, {"x": 2}]
    assert len(got) == 8
    df = spark.createDataFrame([("x", json.dumps(nest(9, 7))), ("y", json.dumps(nest(9, 8)))], "run string, config string")
    df = df.withColumn("config", F.concat(F.lit('{"deep":'), "config", F.lit("}")))
    base, at = df.where("run = 'x'"), "deep" + ".k" * 9
    assert [(r["run"], r["path"]) for r in audit.differences(df, "run", "config", base).collect()] == [("y", at)]
    assert audit.differences(df, "run", "config", base, ("deep.k.k",)).count() == 0


def test_histories_are_told_from_one_array(spark):
    rows = [(c, k, f"m{(c * k) % 5}") for c in range(3) for k in range(c * 9)]
    got = history.told(spark.createDataFrame(rows, "c int, k int, t string"), "c", "k", F.col("t"), ["t"]).collect()
    assert len(got) == len(rows)
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    chain = {}
    for r in sorted(got, key=lambda r: (r["c"], r["k"])):
        lines = [t for c, k, t in rows if c == r["c"] and k <= r["k"]]
        chain[r["c"]] = sha(chain.get(r["c"], "") + "\n" + r["t"])
        assert (r["n_messages"], r["digest"], r["chain"]) == (len(lines), sha("\n".join(lines)), chain[r["c"]])
    wide = history.told(spark.createDataFrame(rows, "c int, k int, t string"), "c", "k", F.col("t"), [])
    assert "array" not in str([f.dataType for f in wide.schema.fields]).lower()


@pytest.mark.parametrize("stretch,width", [(100_000, 5), (7, 5), (7, 1), (4, 9)])
def test_moving_average_over_stretches(spark, monkeypatch, stretch, width):
    monkeypatch.setattr(history, "STRETCH", stretch)
    rnd = random.Random(6)
    rows = [(s, k * 3, None if rnd.random() < 0.1 else rnd.random()) for s in ("a", "b", None) for k in rnd.sample(range(60), 41)]
    got = {(r["s"], r["k"]): r["smooth"] for r in history.moving_average(spark.createDataFrame(rows, "s string, k int, v double"), "v", "k", width, "s").collect()}
    assert len(got) == len(rows)
    for s in ("a", "b", None):
        mine = sorted((k, v) for x, k, v in rows if x == s)
        for i, (k, _) in enumerate(mine):
            near = [v for _, v in mine[max(0, i - width + 1) : i + 1] if v is not None]
            assert got[s, k] == (pytest.approx(sum(near) / len(near)) if near else None)
