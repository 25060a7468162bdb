"""Sampling designs, splits and orders that any partitioning reproduces."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tessera.functions.rng import priority, shuffle_key
from tessera.operators.ranking import global_rank, running
from tessera.operators.selection import first_by_priority, first_by_priority_within


def _ranked(df: DataFrame, partition: list[str], *order: Column) -> DataFrame:
    return df.withColumn("rn", F.row_number().over(Window.partitionBy(*partition).orderBy(*order)))


def nested_selection(units: DataFrame, k: int, seed: int = 42, cluster: str = "cluster_id", unit: str = "unit_id") -> DataFrame:
    """The k first units of each cluster by hash priority, with incl_prob = min(k, size) / size.

    A smaller k gives a subset. The size comes from a grouped count and a join, not a second window, so that Spark can
    cut each partition to k rows before the shuffle.
    """
    size = units.groupBy(cluster).agg(F.count("*").alias("n_units"))
    first = _ranked(units.withColumn("priority", priority(seed, F.col(cluster), F.col(unit))), [cluster], F.col("priority"),
        F.col(unit)).where(F.col("rn") <= k)
    return first.join(size, cluster).withColumn("incl_prob", F.least(F.lit(k), F.col("n_units")) / F.col("n_units"))


def top_score(units: DataFrame, k: int, score: str, seq: str, cluster: str = "cluster_id") -> DataFrame:
    """The k highest scores of each cluster, ties by seq; a deterministic choice has no inclusion probability."""
    return _ranked(units, [cluster], F.desc(score), F.col(seq)).where(F.col("rn") <= k).withColumn("incl_prob", F.lit(None).cast("double"))


def stable_order(df: DataFrame, key: str, seed: int = 42) -> DataFrame:
    return df.withColumn("shuffle_key", shuffle_key(seed, F.col(key)))


def stratum_sample(df: DataFrame, n: int, key: str, stratum: str, seed: int = 42) -> DataFrame:
    return _ranked(stable_order(df, key, seed), [stratum], F.col("shuffle_key"), F.col(key)).where(F.col("rn") <= n)


def nth_of_stratum(df: DataFrame, n: int, key: str, stratum: str, seed: int = 42) -> DataFrame:
    return stratum_sample(df, n, key, stratum, seed).where(F.col("rn") == n)


def matched_sample(candidates: DataFrame, targets: DataFrame, strata: list[str], key: str, seed: int = 42) -> tuple[DataFrame, DataFrame]:
    """As many candidates as targets in each stratum, and the strata that lack some (the caller must find none)."""
    wanted = targets.groupBy(*strata).agg(F.count("*").alias("take"))
    have = candidates.groupBy(*strata).agg(F.count("*").alias("have"))
    short = wanted.withColumnRenamed("take", "wanted").join(have, strata, "left").where(F.coalesce("have", F.lit(0)) < F.col("wanted"))
    return first_by_priority_within(candidates, wanted, strata, key, seed).where("chosen").drop("chosen"), short


def first_n(df: DataFrame, n: int, key: str, seed: int = 42) -> DataFrame:
    """The first n rows by hash priority, in no order."""
    return first_by_priority(df, n, key, seed).where("chosen").drop("chosen")


def cluster_split(clusters: DataFrame, fraction: float, cluster: str, stratum: str | None = None, seed: int = 42) -> DataFrame:
    """cluster, is_validation: whole clusters, at least one on either side (of each stratum); halves round to even.

    clusters holds one row for each cluster. The last cluster on the validation side is found by radix passes, so clusters
    may be as many as rows.
    """
    if stratum:
        size = clusters.groupBy(stratum).agg(F.count("*").alias("n"))
        take = F.least(F.col("n") - 1, F.greatest(F.lit(1), F.bround(F.col("n") * fraction).cast("long")))
        marked = first_by_priority_within(clusters, size.select(stratum, take.alias("take")), [stratum], cluster, seed)
    else:
        n = clusters.count()
        marked = first_by_priority(clusters, min(n - 1, max(1, round(n * fraction))), cluster, seed)
    return marked.withColumnRenamed("chosen", "is_validation")


def round_robin(df: DataFrame, limit: int, key: str, stratum: str, seed: int = 42) -> DataFrame:
    """First of every stratum, then second, until the limit: a top-k report."""
    ranked = _ranked(stable_order(df, key, seed), [stratum], F.col("shuffle_key"), F.col(key)).where(F.col("rn") <= limit)
    return ranked.orderBy("rn", stratum, key).limit(limit)


def until_quota(attempts: DataFrame, quota: int, most: int, seq: str, success: str, stratum: str, parts: int = 0) -> DataFrame:
    """Attempts of a stratum while fewer than `quota` before them succeeded and fewer than `most` were made.

    A stratum of any size is split; seq must order its attempts.
    """
    sums = {"solved_before": F.coalesce(F.col(success).cast("long"), F.lit(0)), "tried_before": F.lit(1).cast("long")}
    return running(attempts, stratum, [seq], sums, lambda s: (s["solved_before"] < quota) & (s["tried_before"] < most), parts)


def padded_shards(df: DataFrame, replicas: int, key: str) -> DataFrame:
    """key, rank, slot, multiplier: rows dealt in strides, the last stride filled up with first rows of weight 0.

    Places come from a range-partitioned count, not from a window without a key.
    """
    rows, n = global_rank(df.select(key), [key])
    padding = -n % replicas if n else 0
    again = rows.where(F.col("place") < padding).select(key, (F.col("place") + n).alias("place"), F.lit(0.0).alias("multiplier"))
    if padding > n > 0:
        copies = F.explode(F.sequence(F.lit(0), F.lit(padding // n)))
        again = rows.select(key, "place", copies.alias("c")).select(key, (F.col("place") + (F.col("c") + 1) * n).alias("place"),
            F.lit(0.0).alias("multiplier")).where(F.col("place") < n + padding)
    every = rows.select(key, "place", F.lit(1.0).alias("multiplier")).unionByName(again)
    return every.select(key, (F.col("place") % replicas).cast("int").alias("rank"), F.floor(F.col("place") / replicas).cast("long").alias("slot"), "multiplier")
