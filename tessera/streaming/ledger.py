"""An append-only request ledger as a stream. An extension: the record pipeline itself is batch."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout


def ledger_stream(spark: SparkSession, path: str, schema, files_per_trigger: int = 16) -> DataFrame:
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger).parquet(path)


def accepted(stream: DataFrame, key: str, time: str, late: str = "1 hour") -> DataFrame:
    """Each request once, within the watermark."""
    return stream.withColumn(time, F.col(time).cast("timestamp")).withWatermark(time, late).dropDuplicatesWithinWatermark([key])


def status_counts(stream: DataFrame, time: str, status: str, window: str = "1 hour", late: str | None = "1 hour") -> DataFrame:
    """Requests for each tumbling window and status; works on a batch table alike. late: None for a stream with a watermark."""
    marked = stream.withColumn(time, F.col(time).cast("timestamp")).withWatermark(time, late) if stream.isStreaming and late else stream
    return marked.groupBy(F.window(time, window).alias("w"), status).agg(F.count("*").alias("n")).select(F.col("w.start").alias("window_start"), status, "n")


def judged(stream: DataFrame, key: str, family: str, time: str, solved: str, quota: int, budget: int) -> DataFrame:
    """stream with `verdict`: admitted, duplicate, quota_met or budget_spent, for requests in order of time and key.

    A family admits requests until `quota` of them are solved or `budget` are spent; one that failed is spent like any other,
    so there is no free retry. A family's state is its counts and the keys it has admitted, at most `budget` of them.
    """
    columns = stream.columns

    def each(_, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        done, keys = state.get if state.exists else (0, [])
        keys = list(keys)
        seen = set(keys)
        rows = pd.concat(list(frames)).sort_values([time, key], kind="stable")
        verdicts = []
        for name, won in zip(rows[key].astype(str), rows[solved]):
            if name in seen:
                verdicts.append("duplicate")
            elif done >= quota:
                verdicts.append("quota_met")
            elif len(keys) >= budget:
                verdicts.append("budget_spent")
            else:
                verdicts.append("admitted")
                keys.append(name)
                seen.add(name)
                done += bool(won) if won is not None and won == won else 0
        state.update((done, keys))
        yield rows[columns].assign(verdict=verdicts)

    out = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in stream.schema.fields)
    return stream.groupBy(family).applyInPandasWithState(each, f"{out}, verdict string", "done long, keys array<string>", "append", GroupStateTimeout.NoTimeout)


def appended(stream: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """Appends what a stream has to a ledger, all that is there now, each batch once.

    A batch is a folder named by its number; one that is run again after a failure replaces its own folder, so no request is
    written twice or lost.
    """

    def write(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path}/batch={number}")

    return stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
