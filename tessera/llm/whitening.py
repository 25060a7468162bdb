"""Embedding whitening from an exact scatter in residue numbers.

Entries become integers. The different vectors, each with a 1 in front, are multiplied with themselves modulo several
primes in every partition: residues below 2^20 in blocks of 4,096 rows keep a double GEMM exact. The residues are added
up over partitions by Spark, and Chinese remaindering gives the exact number of vectors, their sums and their scatter,
whatever the order of the work. As many primes are taken as the largest possible sum needs.

The covariance (n * scatter - sums * sums) / n^2 is an exact integer fraction, rounded once. A double eigendecomposition
gives the components, which two steps of first-order refinement in extended precision bring to double precision, so small
components next to large ones keep their digits. Rows are centred exactly, as n * x - sums in integers, before they are
projected. What goes through the driver depends on the number of dimensions alone.

Cases: a null vector, and one with a null or non-finite entry, is dropped; so is a vector whose length isn't the most
frequent one (of several the longest). Repeated rows and ids each get their rows, null ids too, while equal vectors count
once in the fit. An entry beyond a long's range becomes the nearest long. A deviation that no long can hold is null there
and stands in `deviation_exact`, which is null beyond 38 digits. A component without variance has null for `whitened`, and
`explained` 0; where all vectors are equal, `explained` is null. An empty table, or one of empty vectors, gives no rows.
Other columns play no part, whatever they are called.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import discard, durable, to_python

SCALE = 256
COMPONENTS = 4
#: Rows of a GEMM, and the bound of primes: half of 2^21, squared, times the rows stays below 2^53.
ROWS, PRIMES_BELOW = 4_096, 1 << 21
LONG = (1 << 63) - 1

OUT = "vec_id long, component int, n long, deviation long, deviation_exact decimal(38,0), whitened double, explained double, identity_error double"


def whole(vector: Column) -> Column:
    """Whether a vector is there and all of its entries are finite."""
    sound = F.forall(vector, lambda c: F.coalesce(~F.isnan(c) & (F.abs(c.cast("double")) < float("inf")), F.lit(False)))
    return F.coalesce(vector.isNotNull() & sound, F.lit(False))


def integers(vector: Column, scale: int = SCALE) -> Column:
    return F.transform(vector, lambda c: F.floor(c.cast("double") * scale))


def primes_for(bound: int) -> list[int]:
    """The largest primes below PRIMES_BELOW, until their product tells apart all integers from -bound to bound."""
    sieve = np.ones(PRIMES_BELOW, bool)
    sieve[:2] = False
    for k in range(2, int(PRIMES_BELOW**0.5) + 1):
        if sieve[k]:
            sieve[k * k :: k] = False
    found, product = [], 1
    for p in np.flatnonzero(sieve)[::-1].tolist():
        if product > 2 * bound + 1:
            break
        found.append(p)
        product *= p
    return found


def remaindered(residues: list[int], primes: list[int]) -> int:
    """The integer of least absolute value with these residues, digit by digit in the mixed radix of the primes."""
    value, product = 0, 1
    for r, p in zip(residues, primes):
        value += product * ((r - value) * pow(product, -1, p) % p)
        product *= p
    return value - product if 2 * value > product else value


def matrix(column: pa.Array) -> np.ndarray:
    """A column of lists of one length as rows of integers."""
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), -1)


def scatter(vectors: DataFrame, dims: int) -> list[list[int]]:
    """The exact sum over rows of the outer products of (1, x), of a table with the column x (array<long>)."""
    seen = vectors.agg(F.count("*"), F.max(F.array_max("x")), F.min(F.array_min("x"))).first()
    most = max(1, abs(seen[1] or 0), abs(seen[2] or 0))
    primes = primes_for(max(1, seen[0]) * most * most)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((len(primes), dims + 1, dims + 1), np.int64)
        for batch in batches:
            x = matrix(batch.column(0))
            for at in range(0, len(x), ROWS):
                part = x[at : at + ROWS]
                for k, p in enumerate(primes):
                    r = np.ones((len(part), dims + 1))
                    r[:, 1:] = (part % p + p // 2) % p - p // 2
                    total[k] = (total[k] + (r.T @ r).astype(np.int64)) % p
        up, down = np.triu_indices(dims + 1)
        for k in range(len(primes)):
            size = len(up)
            yield pa.RecordBatch.from_arrays([pa.array(np.full(size, k, np.int32)), pa.array(up.astype(np.int32)), pa.array(down.astype(np.int32)), pa.array(total[k][up, down])],
                ["prime", "i", "j", "residue"])

    sums = to_python(vectors.select("x")).mapInArrow(run, "prime int, i int, j int, residue long").groupBy("prime", "i", "j").agg(F.sum("residue").alias("residue"))
    by = {(r["prime"], r["i"], r["j"]): r["residue"] for r in sums.collect()}  # primes x dims^2 rows
    cell = lambda i, j: remaindered([by[k, i, j] % p for k, p in enumerate(primes)], primes)
    upper = [[cell(i, j) if j >= i else 0 for j in range(dims + 1)] for i in range(dims + 1)]
    return [[upper[min(i, j)][max(i, j)] for j in range(dims + 1)] for i in range(dims + 1)]


@dataclass
class Whitening:
    """n different vectors with their sums, and unit components (rows) by falling variance."""

    n: int
    sums: list[int]
    components: np.ndarray
    variances: np.ndarray
    trace: float
    identity_error: float | None = None

    @property
    def factors(self) -> np.ndarray:
        """What a centred vector is multiplied with: components over the square roots of their variances, nan without one."""
        with np.errstate(divide="ignore", invalid="ignore"):
            return np.where(self.variances[:, None] > 0, self.components / np.sqrt(self.variances)[:, None], np.nan)

    def centred(self, x: np.ndarray) -> np.ndarray:
        """n * x - sums, exact: 64-bit where these suffice, Python integers otherwise."""
        most = max(int(x.max(initial=0)), -int(x.min(initial=0)), 1) * self.n + max(map(abs, self.sums), default=0)
        kind = np.int64 if most * most * max(1, x.shape[1]) < LONG else object
        return x.astype(kind) * self.n - np.array(self.sums, kind)

    def project(self, centred: np.ndarray) -> np.ndarray:
        return (centred / self.n).astype(np.float64) @ self.factors.T


def components(n: int, sums: list[int], products: list[list[int]], most: int) -> Whitening:
    """The first components of the covariance of integer vectors, from its exact value."""
    dims = len(sums)
    centred = [[n * products[i][j] - sums[i] * sums[j] for j in range(dims)] for i in range(dims)]
    exact = np.array([[np.longdouble(v // (1 << 64)) * np.longdouble(2.0**64) + np.longdouble(v % (1 << 64)) for v in row] for row in centred]) / np.longdouble(n) ** 2
    rounded = np.array([[v / (n * n) for v in row] for row in centred])
    _, q = np.linalg.eigh(rounded)
    q = q[:, ::-1].astype(np.longdouble)
    trace = sum(centred[i][i] for i in range(dims)) / (n * n)
    floor = np.longdouble(trace) * dims * np.finfo(np.longdouble).eps * 16
    for _ in range(2):
        off = np.eye(dims, dtype=np.longdouble) - q.T @ q
        image = q.T @ exact @ q
        values = np.diag(image) / (1 - np.diag(off))
        gap = values[None, :] - values[:, None]
        wide = np.abs(gap) > np.maximum(floor, 1e-10 * np.maximum(np.abs(values[None, :]), np.abs(values[:, None])))
        with np.errstate(divide="ignore", invalid="ignore"):
            step = np.where(wide, (image + values[None, :] * off) / gap, off / 2)
        # a step is of first order: where it isn't small, the values are too near to tell their vectors apart
        q = q + q @ np.where(np.abs(step) < 0.1, step, off / 2)
    q = q / np.sqrt((q * q).sum(0))
    values = np.einsum("ik,ij,jk->k", q, exact, q)
    order = np.argsort(-values, kind="stable")[:most]
    values = np.where(values[order] > floor, values[order], 0)
    return Whitening(n, sums, q[:, order].T.astype(np.float64), values.astype(np.float64), float(trace))


def learned(vectors: DataFrame, dims: int, most: int = COMPONENTS) -> Whitening | None:
    """The whitening of a table of different integer vectors x; None where it has no rows."""
    products = scatter(vectors, dims)
    n, sums = products[0][0], products[0][1:]
    if not n:
        return None
    fit = components(n, sums, [row[1:] for row in products[1:]], most)
    fit.identity_error = identity_error(vectors, fit)
    return fit


def identity_error(vectors: DataFrame, fit: Whitening) -> float | None:
    """The largest absolute entry of the whitened rows' covariance minus the identity, of components that have a variance."""
    kept = int((fit.variances > 0).sum())
    if not kept:
        return None

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((kept + 1, kept + 1))
        for batch in batches:
            x = matrix(batch.column(0))
            for at in range(0, len(x), ROWS):
                part = x[at : at + ROWS]
                w = np.column_stack([np.ones(len(part)), fit.project(fit.centred(part))[:, :kept]])
                total += w.T @ w
        i, j = np.indices(total.shape)
        yield pa.RecordBatch.from_arrays([pa.array(i.ravel().astype(np.int32)), pa.array(j.ravel().astype(np.int32)), pa.array(total.ravel())], ["i", "j", "s"])

    sums = to_python(vectors.select("x")).mapInArrow(run, "i int, j int, s double").groupBy("i", "j").agg(F.sum("s").alias("s"))
    by = {(r["i"], r["j"]): r["s"] for r in sums.collect()}
    s = np.array([[by[i, j] for j in range(kept + 1)] for i in range(kept + 1)])
    covariance = s[1:, 1:] / s[0, 0] - np.outer(s[0, 1:], s[0, 1:]) / s[0, 0] ** 2
    return float(np.abs(covariance - np.eye(kept)).max())


def apply(rows: DataFrame, fit: Whitening) -> DataFrame:
    """A row for each row of vec_id and x, and each component."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        k, factors = len(fit.variances), fit.variances > 0
        share = [float(v / fit.trace) if fit.trace > 0 else None for v in fit.variances]
        for batch in batches:
            x = matrix(batch.column(1))
            centred = fit.centred(x)
            square = np.repeat((centred * centred).sum(1), k)
            if centred.dtype == object:
                exact = pa.array([v if v < 10**38 else None for v in square], pa.decimal128(38, 0))
                square = pa.array([v if v <= LONG else None for v in square], pa.int64())
            else:
                square = pa.array(square)
                exact = square.cast(pa.decimal128(38, 0))
            whitened = fit.project(centred)
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0).take(pa.array(np.repeat(np.arange(len(x)), k))),
                    pa.array(np.tile(np.arange(1, k + 1, dtype=np.int32), len(x))),
                    pa.array(np.full(k * len(x), fit.n, np.int64)),
                    square,
                    exact,
                    pa.array(whitened.ravel(), mask=~np.tile(factors, len(x))),
                    pa.array(share * len(x), pa.float64()),
                    pa.array([fit.identity_error] * (k * len(x)), pa.float64()),
                ],
                ["vec_id", "component", "n", "deviation", "deviation_exact", "whitened", "explained", "identity_error"],
            )

    return to_python(rows.select(F.col("vec_id").cast("long").alias("vec_id"), "x")).mapInArrow(run, OUT)


def whiten(embeddings: DataFrame, most: int = COMPONENTS, scale: int = SCALE) -> DataFrame:
    """vec_id, component, and what the contract of the columns above says, of a table with vec_id and embedding."""
    spark = embeddings.sparkSession
    sound = embeddings.where(whole(F.col("embedding"))).select("vec_id", integers(F.col("embedding"), scale).alias("x"))
    common = sound.groupBy(F.size("x").alias("dims")).count().orderBy(F.desc("count"), F.desc("dims")).first()
    if common is None or not common["dims"]:
        return spark.createDataFrame([], OUT)
    rows = sound.where(F.size("x") == common["dims"])
    different = durable(rows.select("x").distinct(), "vectors")
    fit = learned(different, common["dims"], min(most, common["dims"]))
    discard(different)
    return apply(rows, fit)


def op11_whitening(spark, sf_dir: str) -> DataFrame:
    """Whitened first components of every row of embeddings."""
    return whiten(spark.read.parquet(f"{sf_dir}/embeddings.parquet").select("vec_id", "embedding"))
