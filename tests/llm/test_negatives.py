"""Hard negatives against a plain version."""

import math
import random

import pytest
from pyspark.sql import functions as F

from tessera.llm import negatives

ROW = "vec_id long, embedding array<double>, label int"


def plain(rows, positives=5, negatives=10):
    """Sorted (anchor, positive, rank, negative, positive score, negative score) of rows (vec_id, vector, label) told apart by their order."""
    held = []
    for place, (i, v, label) in enumerate(rows):
        if label is None or v is None or any(c is None or not math.isfinite(c) for c in v):
            continue
        held.append((i, place, (label + 1) % 10 if i is not None and i % 7 == 0 else label, [math.floor(c * 256) for c in v]))
    dims = max({len(h[3]) for h in held}, key=lambda d: (sum(len(h[3]) == d for h in held), d), default=0)
    held = [h for h in held if len(h[3]) == dims]
    out = []
    for a in held:
        if a[0] is None or a[0] % 100:
            continue
        scored = sorted(((-sum(p * q for p, q in zip(a[3], h[3])), h[0] is None, h[0] or 0, h[1], h) for h in held if h is not a), key=lambda t: t[:4])
        for p in [t for t in scored if t[4][2] == a[2]][:positives]:
            near = [t for t in scored if t[4][2] != a[2] and 30 * -p[0] <= 100 * -t[0] <= 90 * -p[0]][:negatives]
            out += [(a[0], p[4][0], k + 1, t[4][0], -p[0], -t[0]) for k, t in enumerate(near)]
    return sorted(out, key=str)


def mined(df, **sizes):
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    got = negatives.mine(df, F.col("vec_id") % 100 == 0, label=label, **sizes)
    assert got.columns == ["anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score"]
    return sorted((tuple(r) for r in got.collect()), key=str)


def table(n=700, dims=8, seed=1, spread=0.4):
    rnd = random.Random(seed)
    centres = [[rnd.gauss(0, spread) for _ in range(dims)] for _ in range(4)]
    return [(k, [c + rnd.gauss(0, spread) for c in centres[rnd.randrange(4)]], rnd.randrange(10)) for k in range(n)]


@pytest.mark.parametrize("sizes", [{}, {"block": 50, "pack": 3, "least": 50}])
def test_equals_the_plain_version(spark, sizes):
    rows = table()
    assert mined(spark.createDataFrame(rows, ROW).repartition(5), **sizes) == plain(rows)


@pytest.mark.parametrize("buckets,slack", [(2, 0), (4, 3), (1024, 64)])
def test_rounds_and_ties(spark, monkeypatch, buckets, slack):
    """Few different vectors, so that kth scores are tied among very many rows; few buckets, so that many rounds are needed."""
    monkeypatch.setattr(negatives, "BUCKETS", buckets)
    monkeypatch.setattr(negatives, "SLACK", slack)
    rnd = random.Random(3)
    kinds = [[rnd.randrange(-2, 4) / 4 for _ in range(4)] for _ in range(6)]
    rows = [(k, kinds[0] if k % 3 else rnd.choice(kinds), rnd.randrange(3)) for k in range(500)]
    assert mined(spark.createDataFrame(rows, ROW), block=64, least=64, pack=2) == plain(rows)


def test_edges(spark, tmp_path):
    nan, inf = float("nan"), float("inf")
    rows = table(230, 3, 5) + [(100, [0.5, 0.1, 0.0], 2), (100, [0.5, 0.1, 0.0], 2), (7, None, 1), (300, [1.0, None, 0.0], 1), (400, [nan, 0.0, 0.0], 1), (500, [0.0, inf, 0.0], 1), (600, [1.0], 1), (700, [1.0, 0.0, 0.0], None), (None, [0.4, 0.4, 0.1], 2), (None, [0.4, 0.4, 0.1], 3), (800, [0.0, 0.0, 0.0], 4), (900, [-1.0, -1.0, -1.0], 9), (-100, [0.3, 0.2, 0.9], 3)]
    path = f"{tmp_path}/embeddings.parquet"
    spark.createDataFrame([(*r, "x", k) for k, r in enumerate(rows)], ROW + ", score string, r int").coalesce(1).write.parquet(path)
    assert sorted((tuple(r) for r in negatives.op13_hard_negatives(spark, str(tmp_path)).collect()), key=str) == plain(rows)
    assert mined(spark.createDataFrame([], ROW)) == []
    assert mined(spark.createDataFrame(rows[1:50], ROW)) == []  # no anchors
    assert mined(spark.createDataFrame([(0, [1.0], 1)], ROW)) == []


@pytest.mark.parametrize("scale", [40.0, 3e5, 1e6])
def test_large_components(spark, scale):
    """Scores beyond what floats hold exactly."""
    rows = [(k, [c * scale for c in v], label) for k, v, label in table(300, 4, 9)]
    assert mined(spark.createDataFrame(rows, ROW)) == plain(rows)


def test_vectors_whose_scores_no_long_may_hold(spark):
    rows = table(250, 4, 2)
    assert mined(spark.createDataFrame([*rows, (1000, [1e9, 0.0, 0.0, 0.0], 1)], ROW)) == plain(rows)


def test_tenths():
    from pyspark.sql import SparkSession

    spark = SparkSession.getActiveSession()
    scores = [0, 1, 9, 10, 11, -1, -9, -10, -11, 2**62, -(2**62), 12345678901234567]
    got = spark.createDataFrame([(s,) for s in scores], "s long").select("s", negatives.tenths(F.col("s"), 3, True).alias("lo"), negatives.tenths(F.col("s"), 9, False).alias("hi")).collect()
    assert [(r["lo"], r["hi"]) for r in got] == [(-(-3 * s // 10), 9 * s // 10) for s in scores]
