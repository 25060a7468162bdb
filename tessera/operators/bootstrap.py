"""Cluster bootstraps.

Data enter only as one row a cluster. A replicate's n draws are dealt to ranges of LEAF clusters by a tree: a node's draws
are split between its halves by a binomial number whose generator is keyed by a hash of seed, replicate and range, so every
range finds its own number of draws, whoever asks. Inside a range each draw is a hash of its coordinates. A range's values
stand in one row as arrays, and its draws are added up in that row: there is one row for each replicate and range, never one
for each draw. With up to LEAF clusters there is one range and no split.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tessera.functions.rng import draw
from tessera.operators.single import with_values
from tessera.session import ship
from tessera.sources.shared import durable

#: Clusters of a range, ranges that one row of work asks for, and keys whose arrays stand in one row.
LEAF, CHUNK, KEYS = 1_024, 4_096, 64
#: Values up to which the ranges' arrays are broadcast: 8 bytes each.
MAX_BROADCAST = 1_000_000
#: Draws for each replicate, at most, until its ratio has a denominator.
MOST_REDRAWS = 20


def _numbered(table: DataFrame, order: str) -> tuple[DataFrame, int]:
    """One row a cluster, numbered from 0 in order."""
    n = table.count()
    if n <= LEAF:
        return table.withColumn("cluster_no", F.row_number().over(Window.orderBy(order)) - 1), n
    from tessera.operators.ranking import global_rank

    return global_rank(table, [order])[0].withColumnRenamed("place", "cluster_no"), n


def split(count: int, share: float, *coordinates: object) -> int:
    """How many of count draws fall to a share, by a generator keyed by the coordinates."""
    key = hashlib.sha256("|".join(map(str, coordinates)).encode()).digest()
    return int(np.random.Generator(np.random.Philox(key=int.from_bytes(key[:16], "big"))).binomial(count, share))


def range_counts(rep: int, n: int, first: int, last: int, seed: int, tag: str) -> Iterator[tuple[int, int]]:
    """(range, draws) of the ranges from first up to last, exclusive, in one replicate of n draws over n clusters."""
    stack = [(0, -(-n // LEAF), n)]
    while stack:
        low, high, count = stack.pop()
        if high <= first or low >= last:
            continue
        if high - low == 1:
            yield low, count
            continue
        middle = (low + high) // 2
        left = split(count, (middle - low) * LEAF / (min(high * LEAF, n) - low * LEAF), seed, tag, rep, low, high)
        stack += [(middle, high, count - left), (low, middle, left)]


def ranges(spark: SparkSession, replicates: int, n: int, seed: int, tag: str) -> DataFrame:
    """rep, leaf, c: the number of draws in each range of each replicate."""
    leaves = -(-n // LEAF)
    reps = spark.range(replicates).withColumnRenamed("id", "rep")
    if leaves <= 1:
        return reps.select("rep", F.lit(0).cast("long").alias("leaf"), F.lit(n).cast("long").alias("c"))
    ship(spark)
    chunks = spark.range(-(-leaves // CHUNK) * replicates).select((F.col("id") % replicates).alias("rep"), F.call_function("div", F.col("id"), F.lit(replicates)).alias("chunk"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for rep, chunk in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                leaf, count = zip(*range_counts(rep, n, chunk * CHUNK, (chunk + 1) * CHUNK, seed, tag))
                yield pa.RecordBatch.from_arrays([pa.array([rep] * len(leaf), pa.int64()), pa.array(leaf, pa.int64()), pa.array(count, pa.int64())], ["rep", "leaf", "c"])

    return chunks.mapInArrow(run, "rep long, leaf long, c long")


def _hits(n: int, seed: int, tag: str) -> Column:
    """The draws of a row of `ranges`, as places in the range."""
    size = F.least(F.lit(LEAF).cast("long"), F.lit(n) - F.col("leaf") * LEAF)
    each = F.transform(F.sequence(F.lit(0).cast("long"), F.greatest(F.col("c") - 1, F.lit(0))), lambda i: draw(seed, F.lit(tag), F.col("rep"), F.col("leaf") * (1 << 40) + i, below=size).cast("int"))
    return F.when(F.col("c") > 0, each).otherwise(F.array().cast("array<int>"))


def draws(spark: SparkSession, replicates: int, n: int, seed: int, tag: str = "c") -> DataFrame:
    """rep, cluster_no: n draws with replacement for each replicate, a row each; for factors of a few levels."""
    n = max(n, 1)
    return ranges(spark, replicates, n, seed, tag).select("rep", "leaf", F.explode(_hits(n, seed, tag)).alias("at")).select("rep", (F.col("leaf") * LEAF + F.col("at")).alias("cluster_no"))


def resampled(spark: SparkSession, table: DataFrame, n: int, keys: list[str], values: list[str], replicates: int, seed: int, tag: str = "c") -> DataFrame:
    """rep, keys, and the sum of each value over the clusters drawn; a cluster without a key's row counts 0 there.

    table: cluster_no, keys, values, a row for each cluster and key; null values count 0.
    """
    n, keyed = max(n, 1), table.select("cluster_no", F.struct(*keys, F.lit(0).alias("__k")).alias("key"), *[F.coalesce(F.col(v).cast("double"), F.lit(0.0)).alias(v) for v in values])
    distinct = keyed.select("key").distinct().count() if keys else 1
    block = F.pmod(F.xxhash64("key"), F.lit(-(-max(distinct, 1) // KEYS)))
    at = (F.col("cluster_no") % LEAF).cast("int")
    rows = keyed.select(F.call_function("div", F.col("cluster_no").cast("long"), F.lit(LEAF)).alias("leaf"), block.alias("block"), "key", F.struct(at.alias("at"), *values).alias("v"))
    listed = rows.groupBy("leaf", "block", "key").agg(F.sort_array(F.collect_list("v")).alias("v"))  # at most LEAF of them
    size = F.least(F.lit(LEAF), F.lit(n) - F.col("leaf") * LEAF).cast("int")
    # zeros up to each cluster that has a row, and after the last: one step a cluster, no look-up
    before = lambda k: F.coalesce(F.get("v", k - 1)["at"], F.lit(-1))
    filled = lambda v: F.flatten(F.transform("v", lambda x, k: F.concat(F.array_repeat(F.lit(0.0), x["at"] - before(k) - 1), F.array(x[v]))))
    dense = lambda v: F.when(F.size("v") == size, F.transform("v", lambda x: x[v])).otherwise(
        F.concat(filled(v), F.array_repeat(F.lit(0.0), size - 1 - F.element_at("v", -1)["at"])))
    packed = listed.select("leaf", "block", F.struct("key", *[dense(v).alias(v) for v in values]).alias("e")).groupBy("leaf", "block").agg(F.collect_list("e").alias("entries"))
    side = F.broadcast(packed) if n * max(distinct, 1) * len(values) <= MAX_BROADCAST else packed
    met = ranges(spark, replicates, n, seed, tag).join(side, "leaf").withColumn("hits", _hits(n, seed, tag))
    total = lambda e, v: F.aggregate("hits", F.lit(0.0), lambda s, h: s + F.get(e[v], h))
    sums = met.select("rep", F.explode(F.transform("entries", lambda e: F.struct(e["key"].alias("key"), *[total(e, v).alias(v) for v in values]))).alias("e"))
    return sums.groupBy("rep", *[F.col(f"e.key.{k}").alias(k) for k in keys]).agg(*[F.sum(f"e.{v}").alias(v) for v in values])


def floor_quantile(values: str, p: float) -> Column:
    """Of a group's sorted values, the one at floor(p * (count - 1))."""
    return F.get(F.array_sort(F.collect_list(values)), F.floor(F.lit(p) * (F.count(values) - 1)).cast("int"))


def mean_difference(spark, table: DataFrame, value: str, order: str, replicates: int, seed: int = 42) -> DataFrame:
    """estimate, lower, upper of a mean over clusters, floor-index quantiles."""
    numbered, n = _numbered(table, order)
    numbered = numbered.withColumn("__there", F.col(value).isNotNull().cast("double"))
    reps = resampled(spark, numbered, n, [], [value, "__there"], replicates, seed).select(F.try_divide(value, "__there").alias("x"))
    return with_values(table.agg(F.avg(value).alias("estimate")),
        reps.agg(floor_quantile("x", 0.025).alias("lower"), floor_quantile("x", 0.975).alias("upper")))


def ratio(spark, table: DataFrame, numerator: str, denominator: str, order: str, replicates: int, seed: int = 42, linear: bool = False) -> DataFrame:
    """estimate, lower, upper, kept of a ratio of sums; replicates without a denominator are drawn anew.

    The first `replicates` draws with a denominator are kept, out of at most MOST_REDRAWS times as many; where these are too
    few, the condition is too rare for an interval, and that is an error.
    """
    numbered, n = _numbered(table.select(order, F.col(numerator).alias("a"), F.col(denominator).alias("b")), order)
    for times in (2, 6, MOST_REDRAWS):
        sums = resampled(spark, numbered, n, [], ["a", "b"], times * replicates, seed)
        reps = sums.where("b > 0").orderBy("rep").limit(replicates).select((F.col("a") / F.col("b")).alias("x"))
        if reps.count() == replicates:
            break
    else:
        raise ValueError(f"fewer than {replicates} of {MOST_REDRAWS * replicates} draws have a denominator")
    quantile = (lambda p: F.percentile("x", F.lit(p))) if linear else (lambda p: floor_quantile("x", p))
    point = table.agg((F.sum(numerator) / F.sum(denominator)).alias("estimate"))
    return with_values(point, reps.agg(quantile(0.025).alias("lower"), quantile(0.975).alias("upper"), F.count("*").alias("kept")))


def crossed(spark, panel: DataFrame, replicate_col: str, cluster: str, value: str, replicates: int, seed: int = 42,
    resample_replicates: bool = True) -> DataFrame:
    """Mean paired difference with an interval over two crossed factors.

    panel: a difference for every pair of factor levels. Clusters are drawn once in a replicate and serve all drawn
    levels of the other factor; linear quantiles.
    """
    levels, n_levels = _numbered(panel.select(replicate_col).distinct(), replicate_col)
    clusters, n = _numbered(panel.select(cluster).distinct(), cluster)
    coded = panel.join(levels.withColumnRenamed("cluster_no", "level_no"), replicate_col).join(clusters, cluster).select("level_no", "cluster_no", value)
    seeds = draws(spark, replicates, n_levels, seed, "s").withColumnRenamed("cluster_no",
        "level_no") if resample_replicates else spark.range(replicates).select(F.col("id").alias("rep"),
            F.explode(F.sequence(F.lit(0), F.lit(n_levels - 1))).alias("level_no"))
    seeds = seeds.groupBy("rep", "level_no").agg(F.count("*").alias("ws"))
    sums = resampled(spark, coded, n, ["level_no"], [value], replicates, seed, "g").withColumnRenamed(value, "t")
    reps = sums.join(seeds, ["rep", "level_no"]).groupBy("rep").agg((F.sum(F.col("ws") * F.col("t")) / (n * n_levels)).alias("x"))
    point = panel.agg(F.avg(value).alias("estimate"))
    return with_values(point, reps.agg(F.percentile("x", F.lit(0.025)).alias("lower"), F.percentile("x", F.lit(0.975)).alias("upper")))


def paired_js(spark, reference: DataFrame, selected: DataFrame, value: str, replicates: int, seed: int = 42, cluster: str = "cluster_id") -> DataFrame:
    """Jensen-Shannon divergence of two balanced distributions over the same clusters, with shared cluster draws.

    reference and selected: cluster, value, p, as cluster_pmf gives them.
    """
    from tessera.operators.estimators import js_terms

    both = reference.withColumnRenamed("p", "a").join(selected.withColumnRenamed("p", "b"), [cluster, value], "full").na.fill(0.0, ["a", "b"])
    both = durable(both, "distributions")  # numbered, counted, drawn from and added up
    clusters, n = _numbered(both.select(cluster).distinct(), cluster)
    coded = both.join(clusters, cluster)
    masses = resampled(spark, coded, n, [value], ["a", "b"], replicates, seed, "j").withColumns({"a": F.col("a") / n, "b": F.col("b") / n})
    reps = masses.groupBy("rep").agg(F.sum(js_terms(F.col("a"), F.col("b"))).alias("x"))
    point = both.groupBy(value).agg((F.sum("a") / n).alias("a"), (F.sum("b") / n).alias("b")).agg(F.sum(js_terms(F.col("a"), F.col("b"))).alias("estimate"))
    return with_values(point, reps.agg(floor_quantile("x", 0.025).alias("lower"), floor_quantile("x", 0.975).alias("upper")))


def unpaired_js(spark, reference: DataFrame, selected: DataFrame, value: str, replicates: int, seed: int = 42, cluster: str = "cluster_id") -> DataFrame:
    """As paired_js, with clusters of either side drawn by themselves."""
    from tessera.operators.estimators import js_terms

    sides, points = [], []
    for table, name in ((reference, "a"), (selected, "b")):
        clusters, n = _numbered(table.select(cluster).distinct(), cluster)
        coded = table.join(clusters, cluster)
        sides.append(resampled(spark, coded, n, [value], ["p"], replicates, seed, name).select("rep", value, (F.col("p") / n).alias(name)))
        points.append(table.groupBy(value).agg((F.sum("p") / n).alias(name)))
    js = F.sum(js_terms(F.coalesce("a", F.lit(0.0)), F.coalesce("b", F.lit(0.0))))
    reps = sides[0].join(sides[1], ["rep", value], "full").groupBy("rep").agg(js.alias("x"))
    point = points[0].join(points[1], value, "full").agg(js.alias("estimate"))
    return with_values(point, reps.agg(floor_quantile("x", 0.025).alias("lower"), floor_quantile("x", 0.975).alias("upper")))
