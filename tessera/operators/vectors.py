"""Means and alignments of vectors held as arrays."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.functions.arrays import cosine, dot


def mean_vector(rows: DataFrame, group: list[str], vector: str, weight: str | None = None) -> DataFrame:
    """group columns, mean: the (weighted) mean of each coordinate, in place, over the vectors that have it.

    A null coordinate has no part in its mean, nor has a null weight; where no vector of the group has one, or all weights
    are 0, the mean is null there and later coordinates keep their places. The mean is as long as the group's longest
    vector; a group of empty or null vectors has an empty one. Coordinates are added up before the shuffle.
    """
    w = F.col(weight).cast("double") if weight else F.lit(1.0)
    each = rows.select(*group, w.alias("__w"), F.posexplode_outer(vector).alias("__i", "__x"))
    x = F.col("__x").cast("double")
    coordinate = each.groupBy(*group, "__i").agg(F.try_divide(F.sum(F.col("__w") * x), F.sum(F.when(x.isNotNull(), F.col("__w")))).alias("__m"))
    listed = F.array_sort(F.collect_list(F.when(F.col("__i").isNotNull(), F.struct("__i", "__m"))))
    return coordinate.groupBy(*group).agg(F.transform(listed, lambda s: s["__m"]).alias("mean"))


def alignment(pairs: DataFrame, a: str, b: str) -> DataFrame:
    """pairs with dot, norm_a, norm_b and cosine; the cosine is null for a zero vector."""
    x, y = F.col(a), F.col(b)
    return pairs.withColumns({"dot": dot(x, y), "norm_a": F.sqrt(dot(x, x)), "norm_b": F.sqrt(dot(y, y)), "cosine": cosine(x, y)})


def frobenius_ratio(modules: DataFrame, a: str = "aat", b: str = "btb", base: str = "base_sq") -> DataFrame:
    """||BA|| / ||W|| over modules: the squared norm of a product is the inner product of AA' and B'B, here flat arrays."""
    return modules.agg(F.sqrt(F.sum(dot(F.col(a), F.col(b)))).alias("update"), F.sqrt(F.sum(base)).alias("base")).select("update", "base",
        F.try_divide("update", "base").alias("ratio"))
