"""Stores: tables that are joined on one key again and again, laid out for it once.

A store's rows are dealt into buckets by a hash of the key and sorted inside each, one file a bucket, so that joins, groups and
set operations on the key between stores of one layout read bucket beside bucket and move nothing.
"""

from __future__ import annotations

import uuid
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.sources.shared import shared_folder


@dataclass(frozen=True)
class Layout:
    """Key columns and the number of buckets that stores must share to be joined without moving rows."""

    key: tuple[str, ...]
    buckets: int

    @staticmethod
    def of(df: DataFrame, *key: str, bytes_per_bucket: int = 256 << 20, least: int = 8) -> Layout:
        """A layout for stores of about this table's size, by Catalyst's estimate."""
        size = int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
        return Layout(key, int(max(least, min(1 << 14, -(-size // bytes_per_bucket)))))


def stored(df: DataFrame, layout: Layout, name: str = "store", path: str | None = None) -> DataFrame:
    """df as a store under path (a new folder in the shared one if None); rows with a null key are kept, in one bucket."""
    spark = df.sparkSession
    table = f"{name}_{uuid.uuid4().hex}"
    folder = path or f"{shared_folder(spark)}/{table}"
    dealt = df.repartition(layout.buckets, *layout.key)
    dealt.write.format("parquet").bucketBy(layout.buckets, *layout.key).sortBy(*layout.key).option("path", folder).saveAsTable(table)
    made = spark.table(table)
    made._store = table
    return made


def dropped(spark: SparkSession, *stores: DataFrame) -> None:
    """Forgets stores and deletes their folders."""
    for store in stores:
        at = spark.sql(f"DESCRIBE FORMATTED {store._store}").where("col_name = 'Location'").first()["data_type"]
        spark.sql(f"DROP TABLE {store._store}")
        place = spark._jvm.org.apache.hadoop.fs.Path(at)
        place.getFileSystem(spark._jsc.hadoopConfiguration()).delete(place, True)


def covered(base: DataFrame, updated: DataFrame, key: str) -> DataFrame:
    """key and `side` (paired, only_base, only_updated) of two stores of one layout, all columns of both; nulls pair with nothing."""
    both = base.withColumn("__base", F.lit(True)).join(updated.withColumn("__updated", F.lit(True)), key, "full")
    side = F.when(F.col("__base").isNull(), "only_updated").when(F.col("__updated").isNull(), "only_base").otherwise("paired")
    return both.withColumn("side", side).drop("__base", "__updated")
