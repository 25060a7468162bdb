"""Selection and quantiles without sorting, against sorting."""

import hashlib
import io
import math
import random
from contextlib import redirect_stdout

import pytest
from pyspark.sql import functions as F

from tessera.operators import sampling, selection


def place(seed, key):
    return hashlib.sha256(f"{seed}|{key}".encode()).hexdigest(), key


def plan(df) -> str:
    out = io.StringIO()
    with redirect_stdout(out):
        df.collect()
        df.explain()
    return out.getvalue()


@pytest.mark.parametrize("few,digit", [(4_096, 12), (3, 4), (0, 12)])
def test_first_by_priority(spark, monkeypatch, few, digit):
    monkeypatch.setattr(selection, "FEW", few)
    monkeypatch.setattr(selection, "DIGIT", digit)
    df = spark.range(700).withColumnRenamed("id", "k").repartition(5)
    order = sorted(range(700), key=lambda k: place(7, k))
    for take in (0, 1, 5, 350, 699, 700, 900):
        got = {r["k"] for r in sampling.first_n(df, take, "k", 7).collect()}
        assert got == set(order[:take])
    assert sampling.first_n(df.where("k < 0"), 5, "k").count() == 0


@pytest.mark.parametrize("few,digit", [(4_096, 12), (2, 4)])
def test_first_by_priority_within_groups(spark, monkeypatch, few, digit):
    monkeypatch.setattr(selection, "FEW", few)
    monkeypatch.setattr(selection, "DIGIT", digit)
    rows = [(k, "hot" if k % 3 else f"g{k % 7}") for k in range(600)] + [(900, "one"), (901, None)]
    want = {"hot": 123, "g1": 1, "g2": 0, "g3": 10_000, "one": 1, "none there": 4}
    df, wanted = spark.createDataFrame(rows, "k int, g string"), spark.createDataFrame(list(want.items()), "g string, take long")
    marked = selection.first_by_priority_within(df, wanted, ["g"], "k", 3)
    assert marked.count() == len(rows)
    expected = {k for g, n in want.items() for k in sorted((k for k, x in rows if x == g), key=lambda k: place(3, k))[:n]}
    assert {r["k"] for r in marked.where("chosen").collect()} == expected


def test_split_of_clusters_needs_no_single_task(spark):
    clusters = spark.range(3000).select(F.concat(F.lit("c"), "id").alias("cluster_id"), (F.col("id") % 3).alias("stratum"))
    for stratum in (None, "stratum"):
        split = sampling.cluster_split(clusters, 0.15, "cluster_id", stratum)
        assert "SinglePartition" not in plan(split) and "Window" not in plan(split)
        assert split.where("is_validation").count() == 450
    targets = clusters.where("stratum < 2").limit(40)
    assert "SinglePartition" not in plan(sampling.matched_sample(clusters, targets, ["stratum"], "cluster_id")[0])


def test_split_of_one_and_two_clusters(spark):
    one = spark.createDataFrame([("a",)], "cluster_id string")
    assert [r["is_validation"] for r in sampling.cluster_split(one, 0.5, "cluster_id").collect()] == [False]
    two = spark.createDataFrame([("a",), ("b",)], "cluster_id string")
    assert sorted(r["is_validation"] for r in sampling.cluster_split(two, 0.01, "cluster_id").collect()) == [False, True]


def linear(values, p):
    values = sorted(values)
    at = p * (len(values) - 1)
    low = math.floor(at)
    return values[low] + (values[math.ceil(at)] - values[low]) * (at - low)


@pytest.mark.parametrize("few", [4_096, 8, 0])
def test_quantiles(spark, monkeypatch, few):
    """Spread, tied, two-valued and single values; few exact rows, so that sketches and counts decide."""
    monkeypatch.setattr(selection, "FEW", few)
    rnd = random.Random(4)
    data = {"spread": [rnd.gauss(0, 1) ** 5 * 10 ** rnd.randrange(-3, 6) for _ in range(2500)], "ties": [float(rnd.randrange(5)) for _ in range(2000)], "two": [0.0] * 500 + [1.0] * 500, "one": [3.5], "same": [2.0] * 300}
    rows = [(g, v) for g, values in data.items() for v in values] + [("one", None), ("one", float("nan")), ("empty", None)]
    wanted = {"a": 0.025, "m": 0.5, "z": 0.975, "low": 0.0, "high": 1.0}
    df = spark.createDataFrame(rows, "g string, v double").repartition(6)
    got = {r["g"]: r for r in selection.quantiles(df, ["g"], "v", wanted).collect()}
    assert set(got) == set(data)
    for g, values in data.items():
        assert got[g]["n"] == len(values)
        for name, p in wanted.items():
            assert got[g][name] == pytest.approx(linear(values, p), rel=1e-12, abs=1e-12), (g, name)
    every = selection.quantiles(df, [], "v", wanted).first()
    values = [v for _, v in rows if v is not None and not math.isnan(v)]
    assert all(every[name] == pytest.approx(linear(values, p), rel=1e-12, abs=1e-12) for name, p in wanted.items())


def test_quantiles_gather_no_group(spark):
    df = spark.range(50_000).select((F.col("id") % 2).alias("g"), F.rand(3).alias("v"))
    text = plan(selection.quantiles(df, ["g"], "v", {"m": 0.5}))
    assert "collect_list" not in text and "percentile" not in text and "SinglePartition" not in text
