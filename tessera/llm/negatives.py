"""Hard-negative mining by distributed radix selection.

Vectors become integers and a score is their integer inner product. Rows are numbered once in order of label and packed
into blocks, anchors into packs; every pack meets every block in one cell, a GEMM in the narrowest kind of number that is
exact. Nothing of a cell's scores is kept: for each window (an anchor with a range of scores) a cell reports a histogram of
the range, from the top down to the bucket where its own rows already suffice. Spark adds the histograms up and locates the
bucket of the kth score; the next round's digits are that bucket's. A window is settled when at most SLACK rows are left at
or above its bucket, or the bucket is a single score. Then a last pass gathers the rows at or above the settled scores, of a
cell at most the first k of a window, and these are ranked.

Positives are found first (rows of the anchor's label, any score), then negatives (rows of other labels, with a range of
scores that the positive's score gives). Equal ranges of an anchor are one window.

Cases: rows with a null label, a null vector, or a null or non-finite component take no part, nor do vectors whose length
isn't the most frequent one (of several the longest), or whose squared length is 2^62 or more, as scores of these no long
may hold. Repeated rows and ids are rows of their own: a copy of an anchor is another row of its label. A null id comes
after all others, and isn't an anchor. Among rows with equal score and id the order is that of their places in the files,
which no returned column shows. An anchor without positives, or a positive without negatives, gives no rows. An empty table
gives an empty one. Other columns play no part, whatever they are called.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tessera.llm.common import PLACE, discard, durable, placed, to_python
from tessera.llm.whitening import integers, whole
from tessera.operators.ranking import global_rank

POSITIVES, NEGATIVES = 5, 10
BUCKETS, SLACK = 1_024, 64
#: Rows of a block and anchors of a pack; small tables have blocks of at least LEAST rows.
BLOCK, PACK, LEAST = 65_536, 8_192, 1_024
#: Scores that are in memory at a time.
TILE = 1 << 22
#: Floats hold integers below these exactly.
SINGLE, DOUBLE = 1 << 24, 1 << 53

WINDOW = "a long, r long, key long, lo long, hi long, top long, need long"
OUT = "anchor_id long, positive_id long, rank int, negative_id long, positive_score long, negative_score long"


def taking_part(rows: DataFrame, label: Column, scale: int = 256) -> DataFrame:
    """vec_id, label, x, square and place of the rows that take part; square is the squared length as a double."""
    rows = placed(rows.select("vec_id", "label", "embedding")).where(F.col("label").isNotNull() & whole(F.col("embedding")))
    x = integers(F.col("embedding"), scale)
    square = F.aggregate("x", F.lit(0.0), lambda s, v: s + v.cast("double") * v.cast("double"))
    made = rows.select("vec_id", label.cast("long").alias("label"), x.alias("x"), PLACE)
    return made.select("*", square.alias("square")).where(F.col("square") < float(1 << 62))


def packed_blocks(rows: DataFrame, size: int, kind: np.dtype) -> DataFrame:
    """A row for each block of `size` consecutive places: labels, ids and vectors as bytes."""

    def pack(table: pa.Table) -> pa.Table:
        table = table.sort_by("r")
        x = table["x"].combine_chunks().flatten().to_numpy().astype(kind)
        ids, label = table["vec_id"].combine_chunks(), table["label"].to_numpy()
        held = {
            "b": table["b"][:1], "first": pa.array([table["r"][0].as_py()], pa.int64()), "label_from": pa.array([int(label.min())]), "label_to": pa.array([int(label.max())]),
            "labels": pa.array([label.tobytes()]), "ids": pa.array([ids.fill_null(0).to_numpy().tobytes()]), "unnamed": pa.array([ids.is_null().to_numpy(zero_copy_only=False).tobytes()]), "vectors": pa.array([x.tobytes()]),
        }
        return pa.table(held)

    return rows.select(F.floor(F.col("r") / size).alias("b"), "r", "vec_id", "label", "x").groupBy("b").applyInArrow(
        pack, "b long, first long, label_from long, label_to long, labels binary, ids binary, unnamed binary, vectors binary")


def packed_anchors(anchors: DataFrame, kind: np.dtype) -> DataFrame:
    def pack(table: pa.Table) -> pa.Table:
        table = table.sort_by("r")
        x, label = table["x"].combine_chunks().flatten().to_numpy().astype(kind), table["label"].to_numpy()
        return pa.table({"a": table["a"][:1], "anchor_from": pa.array([int(label.min())]), "anchor_to": pa.array([int(label.max())]), "anchor_places": pa.array([table["r"].to_numpy().tobytes()]),
            "anchor_labels": pa.array([label.tobytes()]), "anchor_vectors": pa.array([x.tobytes()])})

    return anchors.groupBy("a").applyInArrow(pack, "a long, anchor_from long, anchor_to long, anchor_places binary, anchor_labels binary, anchor_vectors binary")


class Mine:
    """Blocks and packs of one table, and selection of rows for windows over them."""

    def __init__(self, rows: DataFrame, anchors: Column, label: Column, scale: int = 256, block: int = BLOCK, pack: int = PACK, least: int = LEAST):
        sound = durable(taking_part(rows, label, scale), "vectors")
        common = sound.groupBy(F.size("x").alias("dims")).count().orderBy(F.desc("count"), F.desc("dims")).first()
        self.dims = common["dims"] if common else 0
        sound_rows = sound.where(F.size("x") == self.dims)
        most = sound_rows.agg(F.max("square"), F.max(F.array_max("x")), F.min(F.array_min("x"))).first()
        #: no score is larger than the largest squared length, nor any partial sum of one
        self.bound = int((most[0] or 0) * (1 + 1e-9)) + 1
        peak = max(most[1] or 0, -(most[2] or 0))
        self.stored = np.dtype(np.int16 if peak < 1 << 15 else np.int32 if peak < 1 << 31 else np.int64)
        self.kind = np.dtype(np.float32 if self.bound < SINGLE else np.float64 if self.bound < DOUBLE else np.int64)
        self.tables = []
        ranked, n = global_rank(sound_rows.select("label", "vec_id", PLACE, "x"), ["label", "vec_id", PLACE])
        self.rows = self.keep(ranked.select(F.col("place").alias("r"), "vec_id", "label", "x"), "numbered")
        size = max(least, min(block, -(-n // 32)))
        self.blocks = self.keep(packed_blocks(self.rows, size, self.stored), "blocks")
        self.n_blocks = -(-n // size)
        chosen, self.n_anchors = global_rank(self.rows.where(anchors), ["r"])
        self.anchors = self.keep(chosen.withColumn("a", F.floor(F.col("place") / pack)).drop("place"), "anchors")
        self.packs = self.keep(packed_anchors(self.anchors, self.stored), "packs")
        discard(sound)

    def keep(self, df: DataFrame, name: str) -> DataFrame:
        self.tables.append(durable(df, name, batch_rows=1 if name == "blocks" else 0))
        return self.tables[-1]

    def close(self) -> None:
        discard(*self.tables)

    def cells(self, windows: DataFrame, same: bool) -> DataFrame:
        """A row for each pack and block: every anchor with its windows meets every row once."""
        listed = windows.groupBy("a").agg(F.collect_list(F.struct("r", "key", "lo", "hi", "top", "need")).alias("windows"))  # of one pack
        asked = self.packs.join(listed, "a").withColumn("b", F.explode(F.sequence(F.lit(0), F.lit(max(0, self.n_blocks - 1))).cast("array<long>")))
        met = asked.join(self.blocks, "b")
        if same:
            met = met.where((F.col("anchor_from") <= F.col("label_to")) & (F.col("label_from") <= F.col("anchor_to")))
        return met.select("anchor_places", "anchor_labels", "anchor_vectors", "windows", "first", "labels", "ids", "unnamed", "vectors")

    def scored(self, same: bool) -> Callable:
        """Of a cell: anchor after anchor its windows, its scores of the rows that may count, and those rows' places in the block."""
        stored, kind, dims = self.stored, self.kind, self.dims
        none = -np.inf if kind.kind == "f" else np.iinfo(np.int64).min

        def each(batch: pa.RecordBatch) -> Iterator[tuple]:
            for k in range(batch.num_rows):
                get = lambda name, of: np.frombuffer(batch.column(name)[k].as_py(), of)  # noqa: B023, E731
                places, owners = get("anchor_places", np.int64), get("anchor_labels", np.int64)
                labels, first = get("labels", np.int64), batch.column("first")[k].as_py()
                rows = np.ascontiguousarray(get("vectors", stored).reshape(-1, dims).astype(kind).T)
                held = batch.column("windows").slice(k, 1).flatten()
                asked = {name: held.field(name).to_numpy() for name in ("r", "key", "lo", "hi", "top", "need")}
                order = np.argsort(asked["r"], kind="stable")
                asked = {name: v[order] for name, v in asked.items()}
                mine, starts = np.unique(asked["r"], return_index=True)
                ends = np.append(starts[1:], len(order))
                at = np.searchsorted(places, mine)
                vectors = get("anchor_vectors", stored).reshape(-1, dims)[at].astype(kind)
                step = max(1, TILE // max(1, len(labels)))
                for begin in range(0, len(mine), step):
                    scores = vectors[begin : begin + step] @ rows
                    scores[(labels[None, :] == owners[at[begin : begin + step], None]) != same] = none
                    if same:
                        own = mine[begin : begin + step] - first
                        inside = np.flatnonzero((own >= 0) & (own < len(labels)))
                        scores[inside, own[inside]] = none
                    for i, row in enumerate(scores):
                        yield asked, range(starts[begin + i], ends[begin + i]), row, (k, first)

        return each

    def histograms(self, windows: DataFrame, same: bool) -> DataFrame:
        """r, key, bucket and its number of rows, over all blocks; bucket 0 is the top of the window's range."""
        each = self.scored(same)

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                out = [[], [], [], []]
                for asked, of, row, _ in each(batch):
                    row.sort()
                    for w in of:
                        lo, hi, need = int(asked["lo"][w]), int(asked["hi"][w]), int(asked["need"][w])
                        end, start = int(np.searchsorted(row, hi, "right")), int(np.searchsorted(row, lo, "left"))
                        if end <= start:
                            continue
                        width = width_of(lo, hi)
                        best = [(hi - int(v)) // width for v in row[max(start, end - need) : end][::-1]]
                        counts: dict[int, int] = {}
                        for bucket in best:
                            counts[bucket] = counts.get(bucket, 0) + 1
                        last = best[-1]  # its rows beyond the first `need` count too
                        counts[last] += max(start, end - need) - max(start, int(np.searchsorted(row, hi - (last + 1) * width + 1, "left")))
                        for bucket, count in counts.items():
                            for held, v in zip(out, (int(asked["r"][w]), int(asked["key"][w]), bucket, count)):
                                held.append(v)
                yield pa.RecordBatch.from_arrays([pa.array(v, pa.int64()) for v in out], ["r", "key", "bucket", "held"])

        found = durable(to_python(self.cells(windows, same)).mapInArrow(run, "r long, key long, bucket long, held long"), "histograms", batch_rows=1)
        self.tables.append(found)
        return found.groupBy("r", "key", "bucket").agg(F.sum("held").alias("held"))

    def gathered(self, windows: DataFrame, same: bool) -> DataFrame:
        """r, key, score and row (place, vec_id) of the rows of each window from `lo` to `top`, of a block the first `need`."""
        each = self.scored(same)

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                r, key, scores, row_place, row_id, row_unnamed = [], [], [], [], [], []
                named = [(np.frombuffer(batch.column("ids")[k].as_py(), np.int64), np.frombuffer(batch.column("unnamed")[k].as_py(), bool)) for k in range(batch.num_rows)]
                for asked, of, row, (k, first) in each(batch):
                    ids, unnamed = named[k]
                    for w in of:
                        found = np.flatnonzero((row >= asked["lo"][w]) & (row <= asked["top"][w]))
                        need = int(asked["need"][w])
                        if len(found) > need:
                            found = found[np.lexsort((found, ids[found], unnamed[found], -row[found]))[:need]]
                        r.append(np.full(len(found), asked["r"][w]))
                        key.append(np.full(len(found), asked["key"][w]))
                        scores.append(row[found].astype(np.int64))
                        row_place.append(found + first)
                        row_id.append(ids[found])
                        row_unnamed.append(unnamed[found])
                whole_of = lambda parts, of: np.concatenate([np.zeros(0, of), *parts]).astype(of)
                ids = pa.array(whole_of(row_id, np.int64), mask=whole_of(row_unnamed, bool))
                longs = [pa.array(whole_of(parts, np.int64)) for parts in (r, key, scores, row_place)]
                yield pa.RecordBatch.from_arrays([*longs, ids], ["r", "key", "score", "row_place", "row_id"])

        found = durable(to_python(self.cells(windows, same)).mapInArrow(run, "r long, key long, score long, row_place long, row_id long"), "gathered", batch_rows=1)
        self.tables.append(found)
        return found

    def select(self, windows: DataFrame, k: int, same: bool) -> DataFrame:
        """The first k rows of each window (a, r, key, lo, hi): r, key, rank, score, row_place, row_id."""
        active = self.keep(windows.where("lo <= hi").select("a", "r", "key", "lo", "hi", F.col("hi").alias("top"), F.lit(k).cast("long").alias("need")), "windows")
        settled = []
        while not active.isEmpty():
            by = Window.partitionBy("r", "key").orderBy("bucket")  # of one window: its buckets
            located = self.histograms(active, same).select("r", "key", "bucket", "held", F.sum("held").over(by).alias("so_far"))
            located = located.join(active.select("r", "key", "lo", "hi", "need"), ["r", "key"]).where("so_far >= need and so_far - held < need")
            width = F.call_function("div", F.col("hi") - F.col("lo"), F.lit(BUCKETS)) + 1
            found = located.select("r", "key", (F.col("hi") - F.col("bucket") * width).alias("new_hi"), F.greatest("lo", F.col("hi") - (F.col("bucket") + 1) * width + 1).alias("new_lo"),
                (F.col("need") - F.col("so_far") + F.col("held")).alias("new_need"), "held")
            state = self.keep(active.join(found, ["r", "key"], "left"), "located")
            done = F.col("new_lo").isNull() | (F.col("new_lo") == F.col("new_hi")) | (F.lit(k) - F.col("new_need") + F.col("held") <= SLACK)
            settled.append(state.where(done).select("a", "r", "key", F.coalesce("new_lo", "lo").alias("lo"), "hi", "top", F.lit(k).cast("long").alias("need")))
            active = state.where(~done).select("a", "r", "key", F.col("new_lo").alias("lo"), F.col("new_hi").alias("hi"), "top", F.col("new_need").alias("need"))
        if not settled:
            return self.rows.sparkSession.createDataFrame([], "r long, key long, rank int, score long, row_place long, row_id long")
        final = settled[0]
        for more in settled[1:]:
            final = final.unionAll(more)
        rows = self.gathered(final, same)
        order = Window.partitionBy("r", "key").orderBy(F.desc("score"), F.asc_nulls_last("row_id"), "row_place")
        return rows.select("r", "key", F.row_number().over(order).alias("rank"), "score", "row_place", "row_id").where(F.col("rank") <= k)


def width_of(lo: int, hi: int) -> int:
    return (hi - lo) // BUCKETS + 1


def tenths(score: Column, share: int, up: bool) -> Column:
    """share tenths of a score, rounded up or down, without leaving the range of a long."""
    rest = F.pmod(score, F.lit(10))
    part = F.call_function("div", rest * share + (9 if up else 0), F.lit(10))
    return F.call_function("div", score - rest, F.lit(10)) * share + part


def mine(rows: DataFrame, anchors: Column, positives: int = POSITIVES, negatives: int = NEGATIVES, low: int = 3, high: int = 9, label: Column | None = None, **sizes: int) -> DataFrame:
    """Hard negatives of a table with vec_id, label and embedding.

    anchors: a condition on vec_id; label: an expression in place of the column. Each anchor with each of its first `positives` rows of its label, and the first
    `negatives` rows of other labels whose score is between low and high tenths of the positive's.
    """
    held = Mine(rows, anchors, F.col("label") if label is None else label, **sizes)
    if not held.n_anchors:
        held.close()
        return rows.sparkSession.createDataFrame([], OUT)
    everything = held.anchors.select("a", "r", F.lit(0).cast("long").alias("key"), F.lit(-held.bound).cast("long").alias("lo"), F.lit(held.bound).cast("long").alias("hi"))
    near = held.keep(held.select(everything, positives, True).select("r", F.col("row_id").alias("positive_id"), F.col("score").alias("positive_score"), F.col("rank").alias("positive_rank")), "positives")
    ranges = near.select("r", F.col("positive_score").alias("key")).distinct()
    ranges = ranges.select("r", "key", tenths(F.col("key"), low, True).alias("lo"), tenths(F.col("key"), high, False).alias("hi"))
    chosen = held.select(held.anchors.select("a", "r").join(ranges, "r").select("a", "r", "key", "lo", "hi"), negatives, False)
    found = near.join(chosen.withColumnRenamed("r", "of"), (F.col("r") == F.col("of")) & (F.col("positive_score") == F.col("key")))
    named = found.join(held.anchors.select(F.col("r").alias("place"), F.col("vec_id").alias("anchor_id")), F.col("r") == F.col("place"))
    out = durable(named.select(F.col("anchor_id").cast("long"), F.col("positive_id").cast("long"), F.col("rank").cast("int"), F.col("row_id").cast("long").alias("negative_id"), "positive_score",
        F.col("score").alias("negative_score")), "negatives")
    held.close()
    return out


def op13_hard_negatives(spark, sf_dir: str) -> DataFrame:
    """Every anchor's positives with their hard negatives, over all rows of embeddings."""
    label = F.col("label").cast("long")
    label = F.when(F.col("vec_id") % 7 == 0, (label + 1) % 10).otherwise(label)
    return mine(spark.read.parquet(f"{sf_dir}/embeddings.parquet"), F.col("vec_id") % 100 == 0, label=label)
