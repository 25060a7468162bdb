"""Places in a total order of a table of any size, and sums over what comes before."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tessera.sources.shared import durable


#: Rows of a part that is grouped into arrays.
GROUPED = 500_000


def by_key(df: DataFrame, *keys: str) -> DataFrame:
    """df dealt by its keys to parts of about GROUPED rows: what is gathered by these keys then takes the same memory in a task for any table."""
    return df.repartition(max(1, -(-df.count() // GROUPED)), *keys)


def global_rank(df: DataFrame, order: list[str]) -> tuple[DataFrame, int]:
    """df with `place`, 0-based, and the number of rows. `order` must tell rows apart.

    Rows are dealt by range and written once, each part is numbered by itself, and the counts of the parts, one row for
    each, give the offsets.
    """
    parted = durable(df.repartitionByRange(*order).withColumn("part", F.spark_partition_id()), "ranked")
    counts = parted.groupBy("part").agg(F.count("*").alias("rows_here"))
    offsets = counts.withColumn("before", F.coalesce(F.sum("rows_here").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    n = counts.agg(F.sum("rows_here")).first()[0] or 0
    local = F.row_number().over(Window.partitionBy("part").orderBy(*order)) - 1
    placed = parted.withColumn("local", local).join(offsets.select("part", "before"), "part").withColumn("place", F.col("before") + F.col("local"))
    return placed.drop("part", "local", "before"), int(n)


def running(df: DataFrame, by: str, order: list[str], sums: dict[str, Column], going: Callable[[dict[str, Column]], Column] | None = None, parts: int = 0) -> DataFrame:
    """df with, by name, the sum over the rows before it in its group; 0 for the first.

    Two passes over range parts: each part's sums first, which give what comes before a part, then windows inside parts. So a
    group with all rows runs in as many tasks as it has parts. going: a condition on the sums before a row that, once
    false in a group, stays false; rows where it is false are left out, and parts that begin so aren't read.
    """
    ranged = df.repartitionByRange(parts, by, *order) if parts else df.repartitionByRange(by, *order)
    parted = durable(ranged.withColumn("__part", F.spark_partition_id()), "running")
    per = parted.groupBy("__part", by).agg(*[F.sum(c).alias(name) for name, c in sums.items()])
    before = Window.partitionBy(by).orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)  # a row for each part
    offsets = per.select(F.col("__part").alias("__of"), F.col(by).alias("__by"), *[F.coalesce(F.sum(name).over(before), F.lit(0)).alias(f"__{name}") for name in sums])
    if going:
        offsets = offsets.where(going({name: F.col(f"__{name}") for name in sums}))
    inside = Window.partitionBy("__part", by).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    met = parted.join(offsets, (F.col("__part") == F.col("__of")) & F.col(by).eqNullSafe(F.col("__by")))
    told = met.withColumns({name: F.col(f"__{name}") + F.coalesce(F.sum(c).over(inside), F.lit(0)) for name, c in sums.items()})
    told = told.drop("__part", "__of", "__by", *[f"__{name}" for name in sums])
    return told.where(going({name: F.col(name) for name in sums})) if going else told
