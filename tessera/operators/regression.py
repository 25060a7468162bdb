"""Least squares by a tree of QR factors, with a cluster bootstrap.

Each task reduces its rows of [X y] to a triangular factor, block by block; factors are stacked and reduced again in groups
and once more on the driver, where a few rows of as many numbers as there are columns arrive. X'X is never formed from the
raw columns, which would square their condition number.

A bootstrap needs sums over clusters. Its columns are first made orthogonal by the whole fit's factor (z = x R^-1), so that
sums of their products are well conditioned, and each replicate's solution is taken back.

A row with a null in a column takes no part.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.session import ship

#: Rows of a block, and groups in which tasks' factors are stacked before the driver.
BLOCK, GROUPS = 8_192, 32
#: Least singular value of a design with columns of length 1, below which its coefficients aren't identified.
LEAST = 1e-12


def _columns(rows: DataFrame, terms: dict[str, Column], outcome: Column, *more: str) -> DataFrame:
    named = rows.select(*more, *[c.cast("double").alias(f"x{i}") for i, c in enumerate([*terms.values(), outcome])])
    return named.dropna(subset=[f"x{i}" for i in range(len(terms) + 1)])


def reduced(factor: np.ndarray | None, rows: np.ndarray) -> np.ndarray:
    """The triangular factor of a factor's and further rows."""
    return np.linalg.qr(rows if factor is None else np.vstack([factor, rows]), mode="r")


def triangular(rows: DataFrame, terms: dict[str, Column], outcome: Column) -> np.ndarray:
    """The triangular factor of [X y], with as many rows as columns."""
    ship(rows.sparkSession)
    k = len(terms) + 1

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        factor = None
        for batch in batches:
            block = np.column_stack([c.to_numpy(zero_copy_only=False) for c in batch.columns])
            for at in range(0, len(block), BLOCK):
                factor = reduced(factor, block[at : at + BLOCK])
        if factor is not None:
            yield pa.RecordBatch.from_arrays([pa.array([factor.ravel()], pa.list_(pa.float64()))], ["factor"])

    def stacked(key: tuple, table: pa.Table) -> pa.Table:
        factors = np.concatenate([np.array(f).reshape(-1, k) for f in table["factor"].to_pylist()])
        return pa.table({"factor": pa.array([reduced(None, factors).ravel()], pa.list_(pa.float64()))})

    parts = _columns(rows, terms, outcome).mapInArrow(each, "factor array<double>").withColumn("g", F.spark_partition_id() % GROUPS)
    found = [np.array(r["factor"]).reshape(-1, k) for r in parts.groupBy("g").applyInArrow(stacked, "factor array<double>").collect()]
    factor = reduced(None, np.concatenate([np.zeros((k, k)), *found]))
    return factor[:k]


def solve(factor: np.ndarray, names: list[str]) -> dict[str, float] | None:
    """Coefficients from the factor of [X y], or None where the columns aren't independent."""
    k = len(names)
    x, y = factor[:k, :k], factor[:k, k]
    scale = np.sqrt((x * x).sum(0))
    if not np.isfinite(factor).all() or (scale == 0).any() or np.linalg.svd(x / scale, compute_uv=False)[-1] < LEAST:
        return None
    return dict(zip(names, (np.linalg.solve(x / scale, y) / scale).tolist()))


def fit(rows: DataFrame, terms: dict[str, Column], outcome: Column, cluster: str) -> dict[str, float]:
    found = solve(triangular(rows, terms, outcome), list(terms))
    if found is None:
        raise ValueError("the design is rank deficient; its coefficients aren't identified")
    return found


def drop_first(levels: list[str], column: str) -> dict[str, Column]:
    """Indicators of all levels but the first in order."""
    return {f"{column}[{v}]": (F.col(column) == v).cast("double") for v in sorted(levels)[1:]}


def cluster_moments(rows: DataFrame, columns: list[Column], cluster: str) -> DataFrame:
    """cluster, m: the upper triangle of Z'Z, summed over the cluster's rows."""
    named = rows.select(cluster, *[c.alias(f"z{i}") for i, c in enumerate(columns)])
    sums = [F.sum(F.col(f"z{i}") * F.col(f"z{j}")) for i in range(len(columns)) for j in range(i, len(columns))]
    return named.groupBy(cluster).agg(F.array(*sums).alias("m"))


def _solved(moments: np.ndarray, back: np.ndarray) -> np.ndarray | None:
    """Coefficients of a replicate from its sums in orthogonal columns; back takes them to the columns of the design."""
    k = len(back) + 1
    full = np.zeros((k, k))
    full[np.triu_indices(k)] = moments
    full = full + np.triu(full, 1).T
    zz, zy = full[:-1, :-1], full[:-1, -1]
    if not np.isfinite(full).all():
        return None
    if np.linalg.matrix_rank(zz, tol=1e-10 * max(np.trace(zz), 1e-300), hermitian=True) < k - 1:
        return None
    return back @ np.linalg.solve(zz, zy)


def bootstrap(rows: DataFrame, terms: dict[str, Column], outcome: Column, cluster: str, coefficients: list[str], replicates: int, seed: int = 42) -> DataFrame:
    """coefficient, estimate, lower, upper, kept: clusters drawn with replacement, rank-deficient draws left out."""
    from tessera.operators.bootstrap import _numbered, resampled

    spark, names = rows.sparkSession, list(terms)
    factor = triangular(rows, terms, outcome)
    point = solve(factor, names)
    if point is None:
        raise ValueError("the design is rank deficient; its coefficients aren't identified")
    k = len(names)
    back = np.linalg.inv(factor[:k, :k])
    data = _columns(rows, terms, outcome, cluster)
    z = [sum((F.col(f"x{i}") * float(back[i, j]) for i in range(j + 1)), F.lit(0.0)) for j in range(k)]
    m = cluster_moments(data, [*z, F.col(f"x{k}")], cluster)
    width = (k + 1) * (k + 2) // 2
    numbered, n = _numbered(m, cluster)
    moments = numbered.select("cluster_no", F.posexplode("m").alias("i", "x"))
    drawn = resampled(spark, moments, n, ["i"], ["x"], replicates, seed)
    sums = drawn.groupBy("rep").agg(F.array(*[F.max(F.when(F.col("i") == i, F.col("x"))) for i in range(width)]).alias("m"))

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for rep, v in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                found = _solved(np.array(v, float), back)
                out += [(rep, c, float(found[names.index(c)])) for c in coefficients] if found is not None else []
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in out], kind) for i, kind in enumerate((pa.int64(), pa.string(), pa.float64()))], ["rep", "coefficient", "x"])

    reps = sums.select("rep", "m").mapInArrow(each, "rep long, coefficient string, x double")
    estimates = spark.createDataFrame([(c, point[c]) for c in coefficients], "coefficient string, estimate double")
    return reps.groupBy("coefficient").agg(F.percentile("x", F.lit(0.025)).alias("lower"), F.percentile("x", F.lit(0.975)).alias("upper"),
        F.count("*").alias("kept")).join(estimates, "coefficient")
