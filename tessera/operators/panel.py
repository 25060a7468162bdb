"""Cross-cluster neighbours by text similarity, and panels of scores built on them."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tessera.operators.blocks import scored


def neighbours(sources: DataFrame, targets: DataFrame, k: int, least: int = 1, min_similarity: float = 0.0, text_weight: float = 1.0,
    stop_words=(), whole_count: bool = False) -> tuple[DataFrame, DataFrame]:
    """For each source its k most similar targets of the same stratum and another cluster, and the sources with too few.

    sources, targets: unit_id, cluster_id, stratum, text and, with text_weight below 1, actions (sources also action, which
    the target must allow and which neither set counts). `eligible` says how many targets reach the threshold: with
    whole_count all of them, else counted up to the larger of k and least, which is exact for the sources that have too few.
    """
    most = max(k, least)
    made = scored(sources, targets, most, min_similarity, text_weight, stop_words)
    order = Window.partitionBy("source_id").orderBy(F.desc(F.round("similarity", 12)), "target_id")
    found = made.where("n is null").drop("n").withColumn("rn", F.row_number().over(order)).where(F.col("rn") <= k)
    counted = made.where("n is not null").groupBy("source_id").agg(F.sum("n").alias("eligible"))
    eligible = F.coalesce("eligible", F.lit(0).cast("long"))
    counts = sources.select(F.col("unit_id").alias("source_id")).join(counted, "source_id", "left").select("source_id",
        (eligible if whole_count else F.least(eligible, F.lit(most).cast("long"))).alias("eligible"))
    return found.join(counts.where(F.col("eligible") >= least), "source_id"), counts.where(F.col("eligible") < least)


def assemble(metadata: DataFrame, base: DataFrame, updated: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Mean score changes: S of a source itself, T over its neighbours; and the score ids that lack a side.

    metadata: source_id, self_score_id, neighbour_score_ids. base, updated: score_id, score.
    """
    both = base.withColumnRenamed("score", "before").join(updated.withColumnRenamed("score", "after"), "score_id", "full")
    faults = both.where("before is null or after is null").select("score_id")
    change = both.select("score_id", (F.col("after") - F.col("before")).alias("change"))
    own = metadata.select("source_id", F.col("self_score_id").alias("score_id")).join(change, "score_id").select("source_id", F.col("change").alias("S"))
    others = metadata.select("source_id", F.explode("neighbour_score_ids").alias("score_id")).join(change,
        "score_id").groupBy("source_id").agg(F.avg("change").alias("T"), F.count("*").alias("neighbours"))
    return own.join(others, "source_id"), faults
