"""Bootstrap draws by a tree of ranges."""

import io
import math
from contextlib import redirect_stdout

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessera.operators import bootstrap


def test_ranges_hold_all_draws_however_they_are_asked_for(monkeypatch):
    monkeypatch.setattr(bootstrap, "LEAF", 10)
    n, leaves = 1_234, 124
    for rep in range(5):
        whole = list(bootstrap.range_counts(rep, n, 0, leaves, 42, "c"))
        assert [k for k, _ in whole] == list(range(leaves)) and sum(c for _, c in whole) == n
        parts = [x for a in range(0, leaves, 7) for x in bootstrap.range_counts(rep, n, a, min(a + 7, leaves), 42, "c")]
        assert parts == whole
    assert list(bootstrap.range_counts(0, n, 0, leaves, 42, "c")) != list(bootstrap.range_counts(0, n, 0, leaves, 43, "c"))


def test_counts_of_ranges_are_multinomial(monkeypatch):
    """Means, variances and a covariance over many replicates, with a last range that is short."""
    monkeypatch.setattr(bootstrap, "LEAF", 40)
    n, reps = 190, 4_000
    counts = np.array([[c for _, c in bootstrap.range_counts(rep, n, 0, 5, 1, "c")] for rep in range(reps)], float)
    p = np.array([40, 40, 40, 40, 30]) / n
    assert np.abs(counts.mean(0) - n * p).max() < 5 * math.sqrt(n * 0.2 / reps)
    cov = n * (np.diag(p) - np.outer(p, p))
    assert np.abs(np.cov(counts.T, bias=True) - cov).max() < 0.1 * cov.max()


@pytest.mark.parametrize("leaf", [1_024, 16])
def test_sums_over_draws(spark, monkeypatch, leaf):
    """Sums by key are those of the draws themselves; absent rows and nulls count 0."""
    monkeypatch.setattr(bootstrap, "LEAF", leaf)
    monkeypatch.setattr(bootstrap, "KEYS", 2)
    n, reps = 100, 6
    rows = [(k, f"v{k % 5}", k / 3, None if k % 7 == 0 else 1.0) for k in range(n)] + [(k, "v9", 2.0, 1.0) for k in range(0, n, 3)] + [(5, None, 1.0, 1.0)]
    table = spark.createDataFrame(rows, "cluster_no int, key string, x double, y double")
    drawn = {}
    for r in bootstrap.draws(spark, reps, n, 42, "t").collect():
        drawn.setdefault(r["rep"], []).append(r["cluster_no"])
    assert all(len(d) == n and set(d) <= set(range(n)) for d in drawn.values()) and len(drawn) == reps
    got = {(r["rep"], r["key"]): (r["x"], r["y"]) for r in bootstrap.resampled(spark, table, n, ["key"], ["x", "y"], reps, 42, "t").collect()}
    for rep, d in drawn.items():
        for key in {r[1] for r in rows}:
            by = {r[0]: r for r in rows if r[1] == key}
            want = (sum(by[c][2] for c in d if c in by), sum(by[c][3] or 0 for c in d if c in by))
            assert got[rep, key] == pytest.approx(want)


def test_interval_over_many_clusters_is_that_of_theory(spark, monkeypatch):
    monkeypatch.setattr(bootstrap, "LEAF", 32)
    table = spark.range(500).select("id", ((F.col("id") * 37 % 101) / 10.0).alias("x"))
    values = np.array([(k * 37 % 101) / 10 for k in range(500)])
    r = bootstrap.mean_difference(spark, table, "x", "id", 600).first()
    half = 1.96 * values.std() / math.sqrt(500)
    assert r["estimate"] == pytest.approx(values.mean())
    assert r["upper"] - values.mean() == pytest.approx(half, rel=0.2) and values.mean() - r["lower"] == pytest.approx(half, rel=0.2)


def test_plan_for_a_million_clusters(spark):
    """One row for each replicate and range; nothing of n elements in the plan."""
    table = spark.range(1_000_000).select(F.col("id").alias("cluster_no"), (F.col("id") % 7).cast("double").alias("x"))
    made = bootstrap.resampled(spark, table, 1_000_000, [], ["x"], 50_000, 42)
    out = io.StringIO()
    with redirect_stdout(out):
        made.explain("extended")
    text = out.getvalue()
    assert len(text) < 40_000 and "Cartesian" not in text and "NestedLoop" not in text
    assert bootstrap.ranges(spark, 3, 1_000_000, 42, "c").count() == 3 * 977


def test_clusters_without_a_keys_row_count_zero_without_look_ups(spark):
    """Gaps at the start, inside and at the end of a range are filled in one step a cluster."""
    import io
    from contextlib import redirect_stdout

    from tessera.operators import bootstrap

    n, rows = 40, [(c, k, float(c + 1)) for k, there in {"x": range(3, 30, 4), "y": range(40), "z": [39], "w": [0, 1]}.items() for c in there]
    made = bootstrap.resampled(spark, spark.createDataFrame(rows, "cluster_no int, key string, v double"), n, ["key"], ["v"], 6, 5)
    out = io.StringIO()
    with redirect_stdout(out):
        made.explain()
    assert "map_from_entries" not in out.getvalue() and "try_element_at" not in out.getvalue()
    drawn, value, want = bootstrap.draws(spark, 6, n, 5).collect(), {(c, k): v for c, k, v in rows}, {}
    for r in drawn:
        for k in "xyzw":
            want[r["rep"], k] = want.get((r["rep"], k), 0.0) + value.get((r["cluster_no"], k), 0.0)
    assert {(r["rep"], r["key"]): r["v"] for r in made.collect()} == want
