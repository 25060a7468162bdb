"""Sharding along a Hilbert curve over quantised metadata.

Language, source and size class are quantised, the cell's place on the curve orders the rows, and the order is cut
into runs of equal row counts; a run covers few cells, so a reader can skip files by any of the dimensions: `written` writes
a file a shard with a manifest of ranges, and `pruned` says which ones a query has to read. A category's cell is the place
of its value among the table's values, in equal parts, so neighbours in the alphabet are neighbours on the curve. Equal
texts are a group: all take the cell of the group's row with the smallest id (of several, and null ids after all others, the
smallest place on the curve), so they stand side by side, and only boundaries that the equal counts force divide them. Inside a
group rows follow their own cells, so a group of many shards can be pruned too.

Cases: a null text has size 8 and checksum 0, and is of one group with empty ones; null dimensions have a cell of their own;
ties in the curve are broken by checksum, digest, own cell, then id (null first), and rows that repeat all of these are
interchangeable; an empty table gives an empty result; repeated rows take places of their own; texts of any length only
count by size, checksum and digest; extra columns play no part.
"""

from __future__ import annotations

from itertools import product

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tessera.llm.common import PLACE, crc32, durable, let, placed

SHARDS = 24
BITS = 5


def hilbert_table(dims: int) -> tuple[list[int], list[int]]:
    """The curve as an automaton: (next state, digit) for each state * 2**dims + corner.

    A state is an entry corner and an axis; Hamilton's rules for Gray-code corners give the moves.
    """
    size = 1 << dims
    rotr = lambda x, k: ((x >> (k % dims)) | (x << (dims - k % dims))) & (size - 1)
    rotl = lambda x, k: rotr(x, dims - k % dims)
    ungray = {i ^ (i >> 1): i for i in range(size)}
    trailing = lambda x: (~x & (x + 1)).bit_length() - 1
    entry = lambda i: 0 if i == 0 else ((2 * ((i - 1) // 2)) ^ (2 * ((i - 1) // 2) >> 1))
    axis = lambda i: 0 if i == 0 else trailing(i - 1 if i % 2 == 0 else i) % dims
    nxt, digit = [], []
    for e, d, corner in product(range(size), range(dims), range(size)):
        w = ungray[rotr(corner ^ e, d + 1)]
        digit.append(w)
        nxt.append((e ^ rotl(entry(w), d + 1)) * dims + (d + axis(w) + 1) % dims)
    return nxt, digit


def hilbert_index(cells: list[Column], bits: int = BITS) -> Column:
    """Place on the curve of a cell, each of whose coordinates is an int of so many bits."""
    dims = len(cells)
    nxt, digit = hilbert_table(dims)
    moves, digits = F.array(*map(F.lit, nxt)), F.array(*map(F.lit, digit))

    def step(acc: Column, plane: Column) -> Column:
        corner = sum(((c.bitwiseAND(plane) != 0).cast("int") * (1 << k) for k, c in enumerate(cells)), F.lit(0))
        return let(acc["state"] * (1 << dims) + corner,
            lambda at: F.struct(F.get(moves, at).alias("state"), (acc["index"] * (1 << dims) + F.get(digits, at)).alias("index")))

    start = F.struct(F.lit(0).alias("state"), F.lit(0).cast("long").alias("index"))
    return F.aggregate(F.array(*[F.lit(1 << b) for b in reversed(range(bits))]), start, step, lambda acc: acc["index"])


#: Values of a category up to which their table is broadcast.
FEW = 10_000
SALT = 16


def with_cells(df: DataFrame, dim: str, bits: int = BITS) -> DataFrame:
    """df with `cell_<dim>`: 0 for null, and 1 and on for the values' places in their order, all cells in equal parts."""
    values = ranked(df.select(F.col(dim).alias("value")).where("value is not null").distinct(), ["value"])
    parts = (1 << bits) - 1
    cell = F.floor(F.col("rank") * parts / F.col("n_rows")).cast("int") + 1
    cells = values.select("value", cell.alias("cell"))
    if cells.limit(FEW + 1).count() <= FEW:
        met = df.join(F.broadcast(cells), F.col(dim) == F.col("value"), "left")
    else:  # a frequent value's rows are met in parts
        dealt = cells.select("*", F.explode(F.sequence(F.lit(0), F.lit(SALT - 1))).alias("salt"))
        met = df.join(dealt, (F.col(dim) == F.col("value")) & (F.pmod(F.xxhash64("doc_id"), F.lit(SALT)) == F.col("salt")), "left").drop("salt")
    return met.withColumn(f"cell_{dim}", F.coalesce("cell", F.lit(0))).drop("value", "cell")


def size_cell(size: Column, bits: int = BITS) -> Column:
    """A cell for each doubling."""
    return F.least(F.lit((1 << bits) - 1), F.floor(F.log2(size + 1))).cast("int")


def ranked(keyed: DataFrame, order: list[str]) -> DataFrame:
    """keyed with `rank`, its row's 0-based place in the order, and `n_rows`, without a sort in one task.

    Rows are dealt by range and written; each part's count then gives the first place of the next. The only window
    without a key runs over one row a part.
    """
    placed = durable(keyed.repartitionByRange(*order).sortWithinPartitions(*order).select("*", F.spark_partition_id().alias("part")), "ranges")
    parts = placed.groupBy("part").agg(F.count("*").alias("n"))
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = parts.select("part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("before"), F.sum("n").over(Window.partitionBy()).alias("n_rows"))
    local = placed.select("*", (F.row_number().over(Window.partitionBy("part").orderBy(*order)) - 1).alias("local"))
    return local.join(offsets, "part").select("*", (F.col("before") + F.col("local")).alias("rank")).drop("local", "before", "part")


def assign(docs: DataFrame, shards: int = SHARDS, dims=("lang", "source")) -> DataFrame:
    """doc_id, size, text_crc32, curve, shard, slot: law `rows`, counts at most one apart."""
    carried = [PLACE] if PLACE in docs.columns else []
    text = F.coalesce(F.col("text"), F.lit(""))
    size = (F.octet_length(text) + 8).cast("long")
    base = docs.select("doc_id", *dims, *carried, size.alias("size"), crc32(text).alias("text_crc32"), F.sha2(text.cast("binary"), 256).alias("digest"), size_cell(size).alias("cell_size"))
    for d in dims:
        base = with_cells(base, d)
    cells = [F.col(f"cell_{d}") for d in dims] + [F.col("cell_size")]
    own = base.select("*", hilbert_index(cells).alias("own_curve"))
    first_of = F.min(F.struct(F.col("doc_id").isNull(), "doc_id", "own_curve"))["own_curve"]
    groups = own.groupBy(F.col("digest").alias("of")).agg(first_of.alias("curve"))
    keyed = own.join(groups, F.col("digest") == F.col("of")).drop("of")
    out = ranked(keyed, ["curve", "text_crc32", "digest", "own_curve", "doc_id"])
    n, r = F.col("n_rows"), F.col("rank")
    small, larger = F.floor(n / shards), n % shards
    shard = F.when(r < larger * (small + 1),
        F.floor(r / (small + 1))).otherwise(larger + F.floor((r - larger * (small + 1)) / F.greatest(small, F.lit(1)))).cast("int")
    cut = out.select("*", shard.alias("shard"))
    first = F.when(F.col("shard") < larger, F.col("shard") * (small + 1)).otherwise(larger * (small + 1) + (F.col("shard") - larger) * small)
    return cut.select("*", (r - first).cast("long").alias("slot"))


def manifest(assigned: DataFrame, dims=("lang", "source")) -> DataFrame:
    """What a reader prunes by: each shard's rows, bytes and range of values in every dimension, and whether it has nulls."""
    ranges = [f(c).alias(f"{n}_{c}") for c in (*dims, "size") for n, f in (("min", F.min), ("max", F.max))]
    return assigned.groupBy("shard").agg(F.count("*").alias("rows"), F.sum("size").alias("bytes"), *ranges,
        *[F.max(F.col(d).isNull()).alias(f"null_{d}") for d in dims])


def written(docs: DataFrame, path: str, shards: int = SHARDS, dims=("lang", "source")) -> DataFrame:
    """docs as a folder for each shard under path/shards, in the curve's order, and path/manifest, which is returned."""
    docs = placed(docs)
    columns = [c for c in docs.columns if c != PLACE]
    at = assign(docs, shards, dims)
    whole = docs.select(F.struct(*[F.col(f"`{c}`") for c in columns]).alias("whole"), F.col(PLACE).alias("place"))
    rows = whole.join(at.select(F.col(PLACE).alias("own"), "shard", "slot"), F.col("place") == F.col("own"))
    rows.repartition(shards, "shard").sortWithinPartitions("shard", "slot").select("whole.*",
        F.col("shard").alias("__shard")).write.partitionBy("__shard").parquet(f"{path}/shards")
    manifest(at, dims).coalesce(1).write.parquet(f"{path}/manifest")
    return docs.sparkSession.read.parquet(f"{path}/manifest")


def pruned(ranges: DataFrame, **wanted) -> DataFrame:
    """The shards of a manifest that may hold rows with the wanted values: name=value or name=(low, high)."""
    for name, value in wanted.items():
        low, high = value if isinstance(value, tuple) else (value, value)
        ranges = ranges.where((F.col(f"max_{name}") >= F.lit(low)) & (F.col(f"min_{name}") <= F.lit(high)))
    return ranges.select("shard")


def op6_hilbert_shards(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text", "lang", "source")
    return assign(docs).select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot",
        F.lit(None).cast("int").alias("grown_shard"), "curve")
