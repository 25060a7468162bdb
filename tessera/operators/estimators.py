"""Distributions and estimators with equal weight for clusters.

All of them reduce rows to one row a cluster first; what comes after is small whatever the input's size.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.operators.single import with_values


def pmf(rows: DataFrame, value: str) -> DataFrame:
    counts = rows.groupBy(value).agg(F.count("*").alias("n"))
    return with_values(counts, counts.agg(F.sum("n").alias("all_n"))).select(value, (F.col("n") / F.col("all_n")).alias("p"))


def cluster_pmf(rows: DataFrame, value: str, cluster: str = "cluster_id") -> DataFrame:
    """cluster, value, p: each cluster's own distribution."""
    counts = rows.groupBy(cluster, value).agg(F.count("*").alias("n"))
    return counts.join(counts.groupBy(cluster).agg(F.sum("n").alias("size")), cluster).select(cluster, value, (F.col("n") / F.col("size")).alias("p"))


def balanced_pmf(rows: DataFrame, value: str, cluster: str = "cluster_id") -> DataFrame:
    """The mean of the clusters' distributions; a value that a cluster lacks counts 0 there."""
    clusters = rows.agg(F.count_distinct(cluster).alias("clusters"))
    masses = cluster_pmf(rows, value, cluster).groupBy(value).agg(F.sum("p").alias("mass"))
    return with_values(masses, clusters).select(value, (F.col("mass") / F.col("clusters")).alias("p"))


def js_terms(p: Column, q: Column) -> Column:
    """One value's part of the Jensen-Shannon divergence, in nats; zero-safe."""
    m = (p + q) / 2
    part = lambda x: F.when(x > 0, x * F.log(x / m)).otherwise(0.0)
    return 0.5 * part(p) + 0.5 * part(q)


def jensen_shannon(p: DataFrame, q: DataFrame, value: str) -> DataFrame:
    both = p.withColumnRenamed("p", "a").join(q.withColumnRenamed("p", "b"), value, "full")
    return both.agg(F.sum(js_terms(F.coalesce("a", F.lit(0.0)), F.coalesce("b", F.lit(0.0)))).alias("js"))


def common_support(rows: DataFrame, group: str, cluster: str = "cluster_id") -> DataFrame:
    """Clusters that every group has."""
    groups = rows.agg(F.count_distinct(group).alias("groups"))
    return with_values(rows.groupBy(cluster).agg(F.count_distinct(group).alias("k")), groups).where("k = groups").select(cluster)


def balanced_indicator(rows: DataFrame, indicator: str, cluster: str = "cluster_id") -> DataFrame:
    """Mean of cluster means over rows that have the indicator; the others are counted as missing."""
    per = rows.groupBy(cluster).agg(F.avg(F.col(indicator).cast("double")).alias("mean"), F.count(indicator).alias("observed"),
        F.count_if(F.col(indicator).isNull()).alias("missing"))
    return per.agg(F.avg("mean").alias("estimate"), F.count("mean").alias("clusters"), F.sum("observed").alias("observed"), F.sum("missing").alias("missing"))


def balanced_ratio(rows: DataFrame, numerator: str, denominator: str, cluster: str = "cluster_id") -> DataFrame:
    """Sum of cluster means of one indicator over that of another; null where a value is missing or nothing conditions."""
    per = rows.groupBy(cluster).agg(F.avg(F.col(numerator).cast("double")).alias("a"), F.avg(F.col(denominator).cast("double")).alias("b"),
        F.count("*").alias("n"), F.count_if(F.col(numerator).isNull() | F.col(denominator).isNull()).alias("gaps"))
    total = per.agg(F.sum("a").alias("a"), F.sum("b").alias("b"), F.count("*").alias("clusters"), F.sum("n").alias("rows_used"), F.sum("gaps").alias("gaps"))
    return total.select(F.when((F.col("b") > 0) & (F.col("gaps") == 0), F.col("a") / F.col("b")).alias("estimate"), "clusters", "rows_used")


def cluster_totals(rows: DataFrame, population: DataFrame, values: dict[str, str], prob: str = "incl_prob", cluster: str = "cluster_id") -> DataFrame:
    """One row for each cluster of the population: Horvitz-Thompson means of the named values.

    population: cluster, n_units. Rows with a missing value, a probability outside (0, 1] or an unknown cluster, and
    clusters without a row, show as `faults`; an estimate over a table with faults is refused.
    """
    p = F.col(prob)
    bad = p.isNull() | ~((p > 0) & (p <= 1))
    for v in values.values():
        bad = bad | F.col(v).isNull()
    sums = rows.groupBy(cluster).agg(*[F.sum(F.when(~bad, F.col(v).cast("double") / p)).alias(name) for name, v in values.items()],
        F.count("*").alias("n_rows"), F.count_if(bad).alias("n_bad"))
    joined = population.join(sums, cluster, "full")
    fault = F.coalesce("n_bad", F.lit(0)) + F.when(F.col("n_rows").isNull() | F.col("n_units").isNull() | (F.col("n_units") <= 0), 1).otherwise(0)
    return joined.select(cluster, *[(F.col(name) / F.col("n_units")).alias(name) for name in values], "n_rows", fault.alias("faults"))


def ht_mean(totals: DataFrame, name: str) -> DataFrame:
    agg = totals.agg(F.avg(name).alias("e"), F.count("*").alias("clusters"), F.sum("n_rows").alias("sampled"), F.sum("faults").alias("faults"))
    return agg.select(F.when(F.col("faults") == 0, F.col("e")).alias("estimate"), "clusters", "sampled", "faults")


def ht_ratio(totals: DataFrame, numerator: str, denominator: str) -> DataFrame:
    agg = totals.agg(F.sum(numerator).alias("a"), F.sum(denominator).alias("b"), F.count("*").alias("clusters"), F.sum("faults").alias("faults"))
    return agg.select(F.when((F.col("faults") == 0) & (F.col("b") > 0), F.col("a") / F.col("b")).alias("estimate"), "clusters", "faults")


def disagreement(draws: Column, base: Column) -> Column:
    """Whether any valid draw differs from the base value; null without a valid draw."""
    valid = F.filter(draws, lambda d: d["valid"])
    return F.when(F.size(valid) > 0, F.exists(valid, lambda d: d["action"] != base))


def resolved_label(valid: Column, label: Column, known=("Skip", "Weak", "Strong")) -> Column:
    """An invalid base value is Strong; a missing label stays missing; an unknown one is an error."""
    return F.when(~valid, F.lit("Strong")).when(label.isNull() | label.isin(*known), label).otherwise(F.raise_error(F.lit("unknown label")))


def mcnemar(pairs: DataFrame, a: str, b: str) -> DataFrame:
    """2x2 counts of paired outcomes and the exact two-sided p of their discordant cells, at most 1."""
    t = pairs.agg(*[F.count_if((F.col(a) == x) & (F.col(b) == y)).alias(n) for n, x,
        y in (("both", 1, 1), ("only_a", 1, 0), ("only_b", 0, 1), ("neither", 0, 0))])
    n, k = F.col("only_a") + F.col("only_b"), F.least("only_a", "only_b")
    # binomial terms in logs: each is the one before times (n - i + 1) / i, so no factorial overflows
    logs = F.aggregate(F.sequence(F.lit(0), k), F.struct(F.lit(0.0).alias("log_term"), F.lit(0.0).alias("sum")), lambda acc, i: F.struct(
        F.when(i == 0, -n * F.log(F.lit(2.0))).otherwise(acc["log_term"] + F.log((n - i + 1).cast("double")) - F.log(i.cast("double"))).alias("log_term"),
        (acc["sum"] + F.exp(F.when(i == 0,
            -n * F.log(F.lit(2.0))).otherwise(acc["log_term"] + F.log((n - i + 1).cast("double")) - F.log(i.cast("double"))))).alias("sum"),
    ), lambda acc: acc["sum"])
    return t.select("*", F.when(n == 0, 1.0).otherwise(F.least(F.lit(1.0), 2 * logs)).alias("p_value"))
