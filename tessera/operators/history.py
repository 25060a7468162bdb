"""Histories of ordered records: cumulative messages, truncation, turns, curves."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tessera.operators.ranking import running


def ordered(cluster: str, seq: str) -> Window:
    return Window.partitionBy(cluster).orderBy(seq)


def cumulative(turns: DataFrame, cluster: str, seq: str, fields: list[str]) -> DataFrame:
    """turns with `history`, all messages of the cluster up to and with each."""
    return turns.withColumn("history", F.collect_list(F.struct(*fields)).over(ordered(cluster, seq).rowsBetween(Window.unboundedPreceding, Window.currentRow)))


def told(turns: DataFrame, cluster: str, seq: str, line: Column, kept: list[str]) -> DataFrame:
    """A row for each turn with the columns kept, n_messages, and `digest` (of all lines up to it, joined by line feeds) and
    `chain` (of the chain before it, a line feed and its line, from an empty one on).

    A cluster's lines stand once in one array, from which each prefix is cut, so what moves is as long as the turns are. The
    chain needs each line once; two prefixes are equal where their chains are.
    """
    entry = F.struct(F.col(seq).alias("__seq"), line.alias("__line"), *kept)
    one = turns.groupBy(cluster).agg(F.array_sort(F.collect_list(entry)).alias("__t"))
    lines = F.transform("__t", lambda x: x["__line"])
    chained = F.aggregate(lines, F.struct(F.lit("").alias("last"), F.array().cast("array<string>").alias("all")), lambda a, x: F.transform(
        F.array(F.sha2(F.concat(a["last"], F.lit("\n"), F.coalesce(x, F.lit(""))), 256)), lambda h: F.struct(h.alias("last"), F.array_append(a["all"], h).alias("all")))[0], lambda a: a["all"])
    with_chain = one.select(cluster, "__t", lines.alias("__lines"), chained.alias("__chain"))
    each = F.transform("__t", lambda x, i: F.struct(x["__seq"].alias(seq), *[x[k].alias(k) for k in kept], (i + 1).alias("n_messages"),
        F.sha2(F.array_join(F.slice("__lines", F.lit(1), i + 1), "\n"), 256).alias("digest"), F.get("__chain", i).alias("chain")))
    return with_chain.select(cluster, F.explode(each).alias("__e")).select(cluster, "__e.*")


def truncated(turns: DataFrame, cluster: str, seq: str, length: Column, budget: int) -> DataFrame:
    """turns with `kept`: the newest ones of a cluster within the budget; the first and the last always stay.

    The cluster's first record is its anchor and counts against the budget; `overflow` says that anchor and last alone
    exceed it, which the caller refuses.
    """
    sized = turns.withColumn("len", length.cast("long"))
    w, back = Window.partitionBy(cluster), Window.partitionBy(cluster).orderBy(F.desc(seq))
    marked = sized.withColumns({"is_anchor": F.row_number().over(ordered(cluster, seq)) == 1, "is_last": F.row_number().over(back) == 1})
    anchor = F.sum(F.when(F.col("is_anchor"), F.col("len")).otherwise(0)).over(w)
    newest = F.sum(F.when(F.col("is_anchor"), 0).otherwise(F.col("len"))).over(back.rowsBetween(Window.unboundedPreceding, Window.currentRow))
    last = F.sum(F.when(F.col("is_last") & ~F.col("is_anchor"), F.col("len")).otherwise(0)).over(w)
    return marked.withColumns({"used": anchor + newest, "overflow": anchor + last > budget}).withColumn("kept",
        F.col("is_anchor") | F.col("is_last") | (F.col("used") <= budget)).drop("is_anchor", "is_last", "used")


def previous(turns: DataFrame, value: str, cluster: str, seq: str) -> DataFrame:
    """turns with `previous`, and both notions of a repeat: equal to it, and equal and not blank."""
    p = F.lag(value).over(ordered(cluster, seq))
    same = F.coalesce(F.col(value) == F.col("previous"), F.lit(False))
    return turns.withColumn("previous", p).withColumns({"repeat": same.cast("int"), "repeat_not_blank": (same & (F.trim(value) != "")).cast("int")})


def first_where(turns: DataFrame, condition: Column, cluster: str, seq: str) -> DataFrame:
    """The first record of each cluster that meets the condition."""
    return turns.where(condition).withColumn("rn", F.row_number().over(ordered(cluster, seq))).where("rn = 1").drop("rn")


#: Points of a series that one task smooths.
STRETCH = 100_000


def moving_average(points: DataFrame, value: str, seq: str, width: int, series: str) -> DataFrame:
    """Trailing mean over up to `width` points, of fewer at the start.

    A series is cut into stretches by its points' places; the last points of a stretch are copied to the next one, where they
    only serve the first means.
    """
    placed = running(points, series, [seq], {"__place": F.lit(1).cast("long")})
    size = max(STRETCH, width)
    own = F.call_function("div", F.col("__place"), F.lit(size))
    served = F.when(F.col("__place") % size >= size - width + 1, F.array(own, own + 1)).otherwise(F.array(own))
    near = Window.partitionBy(series, "__stretch").orderBy("__place").rowsBetween(1 - width, Window.currentRow)
    smooth = placed.withColumn("__stretch", F.explode(served)).withColumn("smooth", F.avg(value).over(near))
    return smooth.where(F.col("__stretch") == own).drop("__place", "__stretch")


def head_tail_change(points: DataFrame, value: str, seq: str, n: int, series: str) -> DataFrame:
    """Mean of the first and last n points of each series, and the change between them in per cent."""
    up, down = ordered(series, seq), Window.partitionBy(series).orderBy(F.desc(seq))
    ranked = points.withColumns({"a": F.row_number().over(up), "b": F.row_number().over(down)})
    means = ranked.groupBy(series).agg(F.avg(F.when(F.col("a") <= n, F.col(value))).alias("head"), F.avg(F.when(F.col("b") <= n, F.col(value))).alias("tail"))
    return means.withColumn("change_pct", F.try_divide(100 * (F.col("tail") - F.col("head")), F.abs("head")))
