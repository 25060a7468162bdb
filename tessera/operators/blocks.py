"""Top-k similarity of sources and targets in blocks: every admitted pair is scored, and none of them is written.

Similarity is text_weight * cosine of token counts + (1 - text_weight) * Jaccard of action sets. A row becomes a bag of tokens for
each action that a source asks for, and is dealt by stratum and action to blocks of at most ROWS rows and BYTES of text. A block of sources meets
a block of targets in one task, which keeps the first k targets of each source and counts those that reach the threshold. So what
moves is the rows (once for each block of the other side), and what is held is a block of either; the comparisons are as
many as the admitted pairs, since the count needs them.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.session import ship
from tessera.sources.shared import discard, durable

#: Rows and bytes of text of a block, sources and targets that are scored at once, and tokens that stand in a dense matrix.
ROWS, BYTES, WIDE, DEEP, DENSE = 8_192, 32_000_000, 1_024, 256, 4_096
#: Rows that go to Python at once: they hold whole texts.
BATCH_ROWS = 500
#: Beyond twice the rounding of the order: similarities that may change places.
SLIP = 4e-12
#: Bytes of a text as tokens: ASCII letters, lower-cased, and digits; all others part them.
FOLD = bytes(ord(chr(c).lower()) if c < 128 and chr(c).isalnum() else 32 for c in range(256))


def bags(rows: DataFrame, stop_words=()) -> DataFrame:
    """rows with bag (different tokens, sorted, spaced), ns (their counts as 32-bit integers) and square, instead of text."""
    stop = {w.encode() for w in stop_words}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            joined, counts, squares = [], [], []
            for text in batch["text"]:
                n = Counter((text.as_py() or "").encode().translate(FOLD).split())
                held = sorted(n.keys() - stop)
                ns = np.array([n[t] for t in held], "<i4")
                joined.append(b" ".join(held))
                counts.append(ns.tobytes())
                squares.append(int((ns.astype(np.int64) ** 2).sum()))
            made = [pa.array(joined, pa.binary()).cast(pa.string()), pa.array(counts, pa.binary()), pa.array(squares, pa.int64())]
            kept = [k for k in batch.schema.names if k != "text"]
            yield pa.RecordBatch.from_arrays([*[batch[k] for k in kept], *made], names=[*kept, "bag", "ns", "square"])

    ship(rows.sparkSession)
    kept = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields if f.name != "text")
    return rows.mapInArrow(run, f"{kept}, bag string, ns binary, square long")


class Lists:
    """Lists of items with counts: rows, codes of items among `known` and counts, without the items that aren't known."""

    def __init__(self, items: pa.ListArray, counts: np.ndarray | None, known: pa.Array):
        lengths = pc.fill_null(pc.list_value_length(items), 0).to_numpy(zero_copy_only=False)
        code = pc.fill_null(pc.index_in(items.flatten(), value_set=known), -1).to_numpy(zero_copy_only=False)
        row = np.repeat(np.arange(len(items)), lengths)
        held = code >= 0
        self.row, self.code = row[held], code[held]
        self.n = np.ones(len(self.row), np.int64) if counts is None else counts[held].astype(np.int64)
        self.at = np.searchsorted(self.row, np.arange(len(items) + 1))


class Matrix:
    """Products of sources with targets: frequent items as a dense matrix, the others as lists of their sources."""

    def __init__(self, lists: Lists, low: int, high: int, known: int):
        a, b = lists.at[low], lists.at[high]
        row, code, n, self.width = lists.row[a:b] - low, lists.code[a:b], lists.n[a:b], high - low
        df = np.bincount(code, minlength=known)
        often = np.argsort(-df, kind="stable")[:DENSE]
        often = often[df[often] >= max(1, self.width // 32)]
        self.place = np.full(known, -1)
        self.place[often] = np.arange(len(often))
        dense = self.place[code] >= 0
        self.dense = np.zeros((len(often), self.width), np.float32)
        self.exact = not len(n) or n.max() < 1 << 24
        self.dense[self.place[code[dense]], row[dense]] = n[dense]
        self.large = None if self.exact else np.zeros(self.dense.shape)
        if self.large is not None:
            self.large[self.place[code[dense]], row[dense]] = n[dense]
        order = np.argsort(code[~dense], kind="stable")
        self.rare_row, self.rare_n = row[~dense][order], n[~dense][order]
        rare = np.bincount(code[~dense], minlength=known)
        self.rare_df, self.rare_from = rare, np.cumsum(rare) - rare

    def dots(self, lists: Lists, low: int, high: int, narrow: np.ndarray) -> np.ndarray:
        """Of targets low to high (rows) with all sources (columns); narrow: whose products stay below 2^24."""
        a, b = lists.at[low], lists.at[high]
        row, code, n = lists.row[a:b] - low, lists.code[a:b], lists.n[a:b]
        out = np.zeros((high - low, self.width))
        place = self.place[code]
        dense = place >= 0
        at = np.searchsorted(row[dense], np.arange(high - low + 1))
        places, ns = place[dense], n[dense]
        for t in range(high - low):
            mine, times = places[at[t] : at[t + 1]], ns[at[t] : at[t + 1]]
            if len(mine) and narrow[low + t] and self.exact:
                out[t] = times.astype(np.float32) @ self.dense[mine]
            elif len(mine):
                out[t] = times.astype(np.float64) @ (self.dense if self.large is None else self.large)[mine].astype(np.float64)
        row, code, n = row[~dense], code[~dense], n[~dense]
        df = self.rare_df[code]
        within = np.arange(df.sum()) - np.repeat(np.cumsum(df) - df, df)
        met = np.repeat(self.rare_from[code], df) + within
        np.add.at(out.reshape(-1), np.repeat(row, df) * self.width + self.rare_row[met], (np.repeat(n, df) * self.rare_n[met]).astype(np.float64))
        return out


def first_of(source: np.ndarray, value: np.ndarray, target: np.ndarray, k: int, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Places of all that may be among a source's first k: by value, ties by target; and each source's kth value, or -1."""
    order = np.lexsort((target, -value, source))
    s, v = source[order], value[order]
    place = np.arange(len(s)) - np.searchsorted(s, s)
    kth = np.full(width, -1.0)
    kth[s[place == k - 1]] = v[place == k - 1]
    fresh = np.ones(len(s), bool)
    fresh[1:] = (s[1:] != s[:-1]) | (v[1:] != v[:-1])
    tie = np.arange(len(s)) - np.maximum.accumulate(np.where(fresh, np.arange(len(s)), 0)) if len(s) else place
    return order[(v >= kth[s] - SLIP) & (tie < k)], kth


def _bag_lists(table: pa.Table, known: pa.Array) -> Lists:
    bag = table["bag"].combine_chunks()
    words = pc.split_pattern(pc.if_else(pc.equal(bag, ""), None, bag), " ")
    return Lists(words, np.frombuffer(b"".join(table["ns"].to_pylist()), "<i4"), known)


def _distinct(lists: pa.Array) -> pa.Array:
    return pc.unique(lists.flatten())


def met(key: tuple, sources: pa.Table, targets: pa.Table, k: int, least: float, weight: float) -> pa.Table:
    """A block of sources against a block of targets: a row for each of the first k, and one with a source's count."""
    if not len(sources) or not len(targets):
        return pa.table({"source_id": sources["source_id"][:0], "target_id": targets["target_id"][:0], "similarity": pa.array([], pa.float64()), "n": pa.array([], pa.int64())})
    targets = targets.take(pc.sort_indices(targets["target_id"]))
    vocabulary = _distinct(pc.split_pattern(sources["bag"].combine_chunks(), " "))
    mine, theirs = _bag_lists(sources, vocabulary), _bag_lists(targets, vocabulary)
    squares, target_squares = (t["square"].to_numpy().astype(np.float64) for t in (sources, targets))
    norms, target_norms = np.sqrt(squares), np.sqrt(target_squares)
    clusters = pc.unique(sources["cluster"].combine_chunks())
    cluster, target_cluster = (pc.fill_null(pc.index_in(t["cluster"].combine_chunks(), value_set=clusters), -1).to_numpy(zero_copy_only=False) for t in (sources, targets))
    barred = pc.is_null(sources["cluster"]).to_numpy(zero_copy_only=False), pc.is_null(targets["cluster"]).to_numpy(zero_copy_only=False)
    if weight < 1:
        acts = _distinct(sources["others"].combine_chunks())
        my_acts, their_acts = (Lists(t["others"].combine_chunks(), None, acts) for t in (sources, targets))
        sizes, target_sizes = (pc.list_value_length(t["others"]).to_numpy(zero_copy_only=False).astype(np.float64) for t in (sources, targets))
        few = np.ones(len(targets), bool)
    found = []
    for low in range(0, len(sources), WIDE):
        high = min(len(sources), low + WIDE)
        words = Matrix(mine, low, high, len(vocabulary))
        acted = Matrix(my_acts, low, high, len(acts)) if weight < 1 else None
        narrow = norms[low:high].max() * target_norms < 1 << 24
        count, kth = np.zeros(high - low, np.int64), np.full(high - low, -1.0)
        kept = [np.zeros(0, np.int64), np.zeros(0), np.zeros(0, np.int64)]
        for at in range(0, len(targets), DEEP):
            end = min(len(targets), at + DEEP)
            size = target_norms[at:end, None] * norms[None, low:high]
            value = np.divide(words.dots(theirs, at, end, narrow), size, out=np.zeros(size.shape), where=size > 0)
            if acted is None:
                value = weight * value
            else:
                both = acted.dots(their_acts, at, end, few)
                either = target_sizes[at:end, None] + sizes[None, low:high] - both
                value = weight * value + (1 - weight) * np.divide(both, either, out=np.zeros(size.shape), where=either > 0)
            admitted = (target_cluster[at:end, None] != cluster[None, low:high]) & ~barred[1][at:end, None] & ~barred[0][None, low:high] & (value >= least)
            count += admitted.sum(axis=0)
            t, s = np.nonzero(admitted & (value >= kth[None, :] - SLIP))
            kept = [np.concatenate(x) for x in zip(kept, (s, value[t, s], t + at))]
            first, kth = first_of(*kept, k, high - low)
            kept = [x[first] for x in kept]
        found.append((low + kept[0], kept[1], kept[2], low + np.flatnonzero(count), count[count > 0]))
    s, v, t, counted, n = (np.concatenate(x) for x in zip(*found))
    ids, target_ids = sources["source_id"].combine_chunks(), targets["target_id"].combine_chunks()
    none = lambda kind, size: pa.nulls(size, kind)
    return pa.table({
        "source_id": pa.concat_arrays([ids.take(pa.array(s)), ids.take(pa.array(counted))]), "target_id": pa.concat_arrays([target_ids.take(pa.array(t)), none(target_ids.type, len(n))]),
        "similarity": pa.concat_arrays([pa.array(v, pa.float64()), none(pa.float64(), len(n))]), "n": pa.concat_arrays([none(pa.int64(), len(s)), pa.array(n, pa.int64())]),
    })


def scored(sources: DataFrame, targets: DataFrame, k: int, least: float = 0.0, weight: float = 1.0, stop_words=()) -> DataFrame:
    """source_id, target_id, similarity of each block's first k; and, with a null target_id, n: a block's count at the threshold.

    sources, targets: unit_id, cluster_id, stratum, text and, with weight below 1, actions (sources also action).
    """
    action = weight < 1
    keys = ["stratum", "action"] if action else ["stratum"]
    acts = [F.array_except(F.array_distinct("actions"), F.array("action")).alias("others")] if action else []
    mine = sources.where("stratum is not null and action is not null" if action else "stratum is not null")
    theirs = targets.withColumn("action", F.explode(F.array_distinct("actions"))) if action else targets
    of = [F.col("cluster_id").alias("cluster"), *keys, *acts, "text"]
    mine, theirs = mine.select(F.col("unit_id").alias("source_id"), *of), theirs.select(F.col("unit_id").alias("target_id"), *of)
    blocks = lambda name: F.greatest(F.ceil(F.count("*") / ROWS), F.ceil(F.sum(F.coalesce(F.octet_length("text"), F.lit(0))) / BYTES)).cast("int").alias(name)
    counted = mine.groupBy(*keys).agg(blocks("packs")).join(theirs.groupBy(*keys).agg(blocks("parts")), keys)
    sizes = durable(counted, "blocks")
    deal = lambda rows, unit, own, other: bags(rows.join(sizes, keys).withColumn(own, F.pmod(F.xxhash64(unit), F.col(f"{own}s")).cast("int")), stop_words).withColumn(other, F.explode(F.sequence(F.lit(0), F.col(f"{other}s") - 1))).drop("packs", "parts")
    at = [*keys, "pack", "part"]
    left, right = deal(mine, "source_id", "pack", "part"), deal(theirs, "target_id", "part", "pack")
    kinds = {f.name: f.dataType.simpleString() for f in [*left.schema.fields, *right.schema.fields]}
    run = lambda key, a, b: met(key, a, b, k, least, weight)
    told = left.groupBy(*at).cogroup(right.groupBy(*at)).applyInArrow(run, f"source_id {kinds['source_id']}, target_id {kinds['target_id']}, similarity double, n long")
    made = durable(told, "neighbours", batch_rows=BATCH_ROWS)
    discard(sizes)
    return made
