"""Tables between the steps of a job, in the folder that driver and executors share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

BATCH = "spark.sql.execution.arrow.maxRecordsPerBatch"
#: Shuffle files of a finished write are of no use: the next step reads the table.
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def shared_folder(spark: SparkSession) -> str:
    """spark.checkpoint.dir; where it is unset, a folder of this machine in local mode and an error on a cluster."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        folder = f"file://{tempfile.mkdtemp(prefix='tessera-')}"
        spark.conf.set("spark.checkpoint.dir", folder)
    if spark.sparkContext._jsc.sc().getCheckpointDir().isEmpty():
        spark.sparkContext.setCheckpointDir(folder)
    return folder.rstrip("/")


def durable(df: DataFrame, name: str, compression: str = "zstd", batch_rows: int = 0) -> DataFrame:
    """df, written to the shared folder and read again: its lineage is cut and an executor's loss costs its own tasks only.

    batch_rows: rows in a batch that goes to Python, where a row holds a whole text.
    """
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"
    before = {k: spark.conf.get(k) for k in (BATCH, CLEANUP)}
    try:
        spark.conf.set(CLEANUP, "true")
        if batch_rows:
            spark.conf.set(BATCH, str(batch_rows))
        df.write.option("compression", compression).parquet(path)
    finally:
        for key, value in before.items():
            spark.conf.set(key, value)
    made = spark.read.schema(df.schema).parquet(path)
    made._durable_path = path
    return made


def discard(*tables: DataFrame) -> None:
    """Deletes tables of `durable` that nothing reads any more."""
    for df in tables:
        spark, path = df.sparkSession, df._durable_path
        at = spark._jvm.org.apache.hadoop.fs.Path(path)
        at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)
