"""Constraints as tables of violations (code, key, detail); `enforce` raises on the driver when one isn't empty."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


class Violated(ValueError):
    pass


def enforce(violations: DataFrame, shown: int = 5) -> None:
    found = violations.limit(shown).collect()
    if found:
        raise Violated("; ".join(f"{r['code']} at {r['key']}: {r['detail']}" for r in found))


def row_checks(rows: DataFrame, key: Column, checks: dict[str, Column]) -> DataFrame:
    """A violation for each row and failed check; a check that is null has failed."""
    failed = F.array_compact(F.array(*[F.when(~F.coalesce(ok, F.lit(False)), F.lit(code)) for code, ok in checks.items()]))
    return rows.select(F.explode(failed).alias("code"), key.cast("string").alias("key")).withColumn("detail", F.lit("row check failed"))


def all_of(*tables: DataFrame) -> DataFrame:
    return reduce(DataFrame.unionByName, tables)


def unique(rows: DataFrame, *columns: str, code: str = "duplicate") -> DataFrame:
    key = F.concat_ws("|", *[F.col(c).cast("string") for c in columns])
    return rows.groupBy(*columns).agg(F.count("*").alias("n")).where("n > 1").select(F.lit(code).alias("code"), key.alias("key"),
        F.concat(F.col("n").cast("string"), F.lit(" rows")).alias("detail"))


def disjoint(a: DataFrame, b: DataFrame, column: str, code: str = "overlap") -> DataFrame:
    return a.select(column).distinct().join(b.select(column).distinct(), column, "left_semi").select(F.lit(code).alias("code"),
        F.col(column).cast("string").alias("key"), F.lit("on both sides").alias("detail"))


def subset(small: DataFrame, large: DataFrame, column: str, code: str = "not_in_larger") -> DataFrame:
    return small.select(column).distinct().join(large.select(column).distinct(), column, "left_anti").select(F.lit(code).alias("code"),
        F.col(column).cast("string").alias("key"), F.lit("only in the smaller").alias("detail"))


def same_rows(expected: DataFrame, actual: DataFrame, key: str, compared: dict[str, float | None]) -> DataFrame:
    """Violations of a one-to-one match on key; compared: columns with a tolerance, or None for equality."""
    both = expected.select(key, *[F.col(c).alias(f"__e_{c}") for c in compared],
        F.lit(1).alias("__e")).join(actual.select(key, *[F.col(c).alias(f"__a_{c}") for c in compared], F.lit(1).alias("__a")), key, "full")
    codes = [F.when(F.col("__a").isNull(), "missing").when(F.col("__e").isNull(), "unexpected")]
    present = F.col("__a").isNotNull() & F.col("__e").isNotNull()
    for c, tolerance in compared.items():
        e, a = F.col(f"__e_{c}"), F.col(f"__a_{c}")
        same = e.eqNullSafe(a) if tolerance is None else F.coalesce(F.abs(e - a) <= tolerance, e.isNull() & a.isNull())
        codes.append(F.when(present & ~same, f"different_{c}"))
    return both.select(F.explode(F.array_compact(F.array(*codes))).alias("code"), F.col(key).cast("string").alias("key")).withColumn("detail",
        F.lit("against the derived rows"))


def sums_to_one(rows: DataFrame, group: str, weight: str, tolerance: float = 1e-6) -> DataFrame:
    total = rows.groupBy(group).agg(F.sum(weight).alias("w"))
    return total.where(F.abs(F.col("w") - 1) > tolerance).select(F.lit("weights_do_not_sum_to_1").alias("code"),
        F.col(group).cast("string").alias("key"), F.col("w").cast("string").alias("detail"))


def config_difference(a: dict, b: dict, allowed: set[str] = frozenset(), at: str = "") -> list[str]:
    """Dotted paths at which two nested configurations differ, outside the allowed ones."""
    if isinstance(a, dict) and isinstance(b, dict):
        return [p for k in sorted({*a, *b}) for p in config_difference(a.get(k), b.get(k), allowed, f"{at}.{k}" if at else k)]
    return [] if a == b or at in allowed else [at]
