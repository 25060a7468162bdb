"""Stores of one layout are joined without an exchange."""

import io
import os
from contextlib import redirect_stdout

import pytest
from pyspark.sql import functions as F

from tessera.sources import stores


def plan(df) -> str:
    out = io.StringIO()
    with redirect_stdout(out):
        df.explain()
    return out.getvalue()


@pytest.fixture
def shuffled(spark):
    """Small tables are joined as large ones would be."""
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    yield spark
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)


def test_joins_and_groups_move_nothing(shuffled):
    spark = shuffled
    layout = stores.Layout(("k",), 5)
    left = spark.range(300).select(F.when(F.col("id") % 50 != 0, F.col("id")).alias("k"), (F.col("id") * 2).alias("x"))
    right = spark.range(100, 400).select(F.col("id").alias("k"), (F.col("id") % 7).alias("y"))
    a, b = stores.stored(left, layout, "a"), stores.stored(right, layout, "b")
    both = stores.covered(a, b, "k")
    grouped = b.groupBy("k").agg(F.sum("y").alias("y"))
    semi = a.join(b, "k", "left_semi")
    for made in (both, a.join(b, "k"), a.join(grouped, "k"), semi, a.join(b, "k", "left_anti"), b.select("k").distinct()):
        assert "Exchange" not in plan(made), plan(made)
    assert "Exchange" in plan(left.join(right, "k"))
    got = {r["side"]: r["count"] for r in both.groupBy("side").count().collect()}
    # of 0, 50, ... 250 the keys are null
    assert got == {"only_base": 100 + 4, "only_updated": 100 + 4, "paired": 196}
    folder = spark.sql(f"DESCRIBE FORMATTED {a._store}").where("col_name = 'Location'").first()["data_type"].removeprefix("file:")
    assert len([f for f in os.listdir(folder) if f.endswith(".parquet")]) <= 5
    stores.dropped(spark, a, b)
    assert not os.path.exists(folder)


def test_layouts_follow_sizes(spark):
    assert stores.Layout.of(spark.range(10), "id") == stores.Layout(("id",), 8)
    assert stores.Layout.of(spark.range(10_000_000_000), "id").buckets > 200
