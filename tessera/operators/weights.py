"""Training rows, weights and acceptance of annotated units.

A record has a unit_id, cluster_id, base_value and draws: array<struct<action, valid>> in draw order.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def n_valid(draws: Column) -> Column:
    return F.size(F.filter(draws, lambda d: d["valid"]))


def training_rows(records: DataFrame, weighting: str = "game_state_mean") -> DataFrame:
    """A row for each valid draw, with its index among all draws, whether it differs from the base value, and a weight.

    sample_mean: 1 a row; state_mean: 1 a unit; game_state_mean: 1 a cluster, over its units with a valid draw.
    """
    counted = records.withColumn("k", n_valid(F.col("draws"))).where("k > 0")
    if weighting == "sample_mean":
        weighed = counted.withColumn("weight", F.lit(1.0))
    elif weighting == "state_mean":
        weighed = counted.withColumn("weight", 1.0 / F.col("k"))
    elif weighting == "game_state_mean":
        v = counted.groupBy("cluster_id").agg(F.count("*").alias("v"))
        weighed = counted.join(v, "cluster_id").withColumn("weight", 1.0 / (F.col("v") * F.col("k")))
    else:
        raise ValueError(f"unknown weighting mode: {weighting}")
    rows = weighed.select("unit_id", "cluster_id", "base_value", "weight", F.posexplode("draws").alias("sample_index", "draw")).where("draw.valid")
    return rows.select("unit_id", "cluster_id", "sample_index", F.col("draw.action").alias("action"), "base_value",
        (F.col("draw.action") != F.col("base_value")).alias("disagreement"), "weight")


def acceptance(records: DataFrame) -> DataFrame:
    """Counts and rates of each cluster and, with a null cluster_id and is_total 1, of all; a rate of no calls is null."""
    k = n_valid(F.col("draws"))
    facts = records.select("cluster_id", k.alias("k"), F.size("draws").alias("calls"))
    return (
        facts.rollup("cluster_id")
        .agg(
            F.grouping("cluster_id").cast("int").alias("is_total"), F.count("*").alias("selected_units"), F.count_if(F.col("k") > 0).alias("valid_units"),
            F.sum("calls").cast("long").alias("calls"), F.sum("k").cast("long").alias("valid_draws"),
        )
        .select("*", F.try_divide("valid_units", "selected_units").alias("unit_rate"), F.try_divide("valid_draws", "calls").alias("draw_rate"),
            (F.col("valid_units") > 0).alias("retained"))
    )


def unit_groups(rows: DataFrame) -> DataFrame:
    """A unit's training rows together; n_clusters above 1 is a violation."""
    return rows.groupBy("unit_id").agg(F.count("*").alias("n_rows"), F.sum("weight").alias("weight"), F.min("cluster_id").alias("cluster_id"),
        F.count_distinct("cluster_id").alias("n_clusters"))


def cluster_share(rows: DataFrame, cluster: str = "cluster_id") -> DataFrame:
    """Each row's 1 / rows of its cluster."""
    return rows.join(rows.groupBy(cluster).agg((1.0 / F.count("*")).alias("share")), cluster)


def distinct_levels(records: DataFrame) -> DataFrame:
    """Acceptance of draws, units and clusters."""
    per = records.select("unit_id", "cluster_id", n_valid(F.col("draws")).alias("k"), F.size("draws").alias("calls"))
    return per.agg(
        F.sum("k").cast("long").alias("valid_draws"), F.sum("calls").cast("long").alias("draws"), F.count_if(F.col("k") > 0).alias("valid_units"),
            F.count("*").alias("units"),
        F.count_distinct(F.when(F.col("k") > 0, F.col("cluster_id"))).alias("valid_clusters"), F.count_distinct("cluster_id").alias("clusters"),
    )


def weighted_loss(rows: DataFrame, losses: str, mask: str, weight: str) -> DataFrame:
    """Weighted mean over rows of the mean loss of their masked tokens; rows without one don't count."""
    n = F.aggregate(F.col(mask), F.lit(0.0), lambda a, m: a + m)
    s = F.aggregate(F.zip_with(losses, mask, lambda x, m: x * m), F.lit(0.0), lambda a, x: a + x)
    each = rows.select(F.try_divide(s, n).alias("loss"), F.col(weight).alias("w")).where("loss is not null")
    return each.agg(F.sum(F.col("loss") * F.col("w")).alias("numerator"), F.sum("w").alias("denominator")).select("numerator", "denominator",
        F.try_divide("numerator", "denominator").alias("loss"))
