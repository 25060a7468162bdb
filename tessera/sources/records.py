"""Reading and writing record files."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

MESSAGE = T.StructType([T.StructField("role", T.StringType()), T.StructField("content", T.StringType())])
UNIT = T.StructType([
    T.StructField("unit_id", T.StringType()), T.StructField("cluster_id", T.StringType()), T.StructField("stratum", T.StringType()),
        T.StructField("seq", T.IntegerType()),
    T.StructField("observation", T.StringType()), T.StructField("actions", T.ArrayType(T.StringType())), T.StructField("messages", T.ArrayType(MESSAGE)),
])
DRAW = T.StructType([T.StructField("action", T.StringType()), T.StructField("valid", T.BooleanType())])


def read_jsonl(spark: SparkSession, path, schema: T.StructType) -> DataFrame:
    """Records of one schema; blank lines are skipped, a malformed one stops the job."""
    return spark.read.schema(schema).option("mode", "FAILFAST").json(path)


def read_table(spark: SparkSession, paths, schema: T.StructType | None = None) -> DataFrame:
    """Parquet or JSON lines by suffix, several files of one kind in one scan."""
    names = [paths] if isinstance(paths, str) else list(paths)
    kinds = {n.rstrip("/").rsplit(".", 1)[-1] for n in names}
    if kinds == {"parquet"}:
        return spark.read.parquet(*names)
    if kinds == {"jsonl"} and schema is not None:
        return read_jsonl(spark, names, schema)
    raise ValueError(f"cannot read {sorted(kinds)}; JSON lines need a schema")


def write_table(df: DataFrame, path: str) -> None:
    """By suffix; an existing path is never overwritten."""
    writer = df.write.mode("errorifexists")
    writer.parquet(path) if path.endswith(".parquet") else writer.option("ignoreNullFields", "false").json(path)


def canonical_lines(df: DataFrame, order: list[str], compact: bool = True):
    """Lines of canonical JSON in order, streamed to the driver partition by partition, where one file's bytes matter."""
    separators = (",", ":") if compact else (", ", ": ")
    for row in df.orderBy(*order).toLocalIterator():
        yield json.dumps(row.asDict(recursive=True), sort_keys=True, ensure_ascii=False, allow_nan=False, separators=separators)


def merge_shards(shards: list[DataFrame], key: str) -> tuple[DataFrame, DataFrame]:
    """All shards' rows, and violations: keys that occur more than once."""
    from tessera.operators.checks import all_of, unique

    merged = all_of(*shards)
    return merged, unique(merged, key, code="duplicate_record")


def verified(df: DataFrame, recorded: str, recomputed) -> DataFrame:
    """df, failing the job when a recorded hash isn't the recomputed one."""
    return df.where(F.assert_true(F.col(recorded) == recomputed, F.lit("recorded hash does not match the record")).isNull())


def training_log(lines: DataFrame, metrics: list[str]) -> DataFrame:
    """step and metrics of log lines like `step:12 - loss:0.5 - ...`; lines without a step are left out."""
    number = r"([-+]?[0-9]*\.?[0-9]+(?:[eE][-+]?[0-9]+)?)"
    found = lines.select(F.regexp_extract("value", r"step:(\d+) - ", 1).alias("step"),
        *[F.regexp_extract("value", rf"(?:^|[\s-]){m}:{number}", 1).alias(m) for m in metrics])
    return found.where("step <> ''").select(F.col("step").cast("long").alias("step"), *[F.expr(f"try_cast(`{m}` as double)").alias(m) for m in metrics])
