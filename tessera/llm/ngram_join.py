"""Near-duplicate join: MinHash banding over word n-grams, pairs verified on the full n-gram sets.

Documents with the same n-gram set are one class of copies and are represented by their row with the smallest id. Bands and rows are
chosen for a target recall at the threshold. Representatives are shuffled on their band hashes; buckets of the same
members are looked at once, and a pair only in its first common band. A bucket is dealt out in blocks, and each pair of
blocks is verified on its own, so no task holds a large bucket; what comes out is each representative's number of links
and a spanning forest, never the pairs. Connected classes are found by alternating star contraction on tables.

The result has a row for each document: its class (the smallest id of its connected near duplicates) and its number of
links, the other documents whose n-gram sets have a Jaccard similarity of the threshold or more.

Cases: a text of fewer words than an n-gram has its words together as its only one, so equal short texts are copies; a
null, empty or blank text has none and links to nothing; rows that repeat an id count as rows; a null id comes after all
others; texts are read whole; an empty table gives an empty one; `stage` keeps all columns, whatever they are called, and the
query reads doc_id and text only.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import PLACE, discard, durable, mixed, placed, shares, to_python, without

WORDS, THRESHOLD, RECALL = 5, 0.8, 0.997
MOST_HASHES = 256
#: Members of a block of a large bucket.
BLOCK = 384
SALT = 16
#: Bytes of texts that block pairs of one group are sent: what a task holds at a time, beside what one block pair needs.
GROUP_BYTES = 1 << 20
MEMO = 400_000
BASE = np.uint64(0x9E3779B97F4A7C15 | 1)


def bands_and_rows(threshold: float = THRESHOLD, recall: float = RECALL, most: int = MOST_HASHES) -> tuple[int, int]:
    """The most rows, so the fewest chance meetings, with which pairs at the threshold still meet with this probability."""
    best = (most, 1)
    for rows in range(1, 33):
        miss = 1 - threshold**rows
        bands = int(np.ceil(np.log(1 - recall) / np.log(miss)))
        if bands * rows <= most:
            best = (bands, rows)
    return best


class _Hashes(dict):
    def __missing__(self, word: bytes) -> int:
        import xxhash

        self[word] = h = xxhash.xxh64_intdigest(word)
        return h


class NGrams:
    """N-gram sets of texts as sorted 64-bit hashes, and their band keys."""

    def __init__(self, words: int, bands: int, rows: int):
        self.words, self.bands, self.rows = words, bands, rows
        self.hashes = _Hashes()
        rng = np.random.default_rng(2027)
        self.factor = rng.integers(0, 1 << 63, bands * rows, np.uint64)[:, None] * np.uint64(2) + np.uint64(1)
        self.offset = rng.integers(0, 1 << 63, bands * rows, np.uint64)[:, None]
        self.weight = rng.integers(0, 1 << 63, rows, np.uint64) * np.uint64(2) + np.uint64(1)
        self.band = mixed(np.arange(1, bands + 1, dtype=np.uint64) * BASE)

    def set_of(self, text: bytes | None) -> np.ndarray:
        split = text.split() if text else []
        if not split:
            return np.zeros(0, np.uint64)
        if len(self.hashes) > MEMO:
            self.hashes.clear()
        w = np.fromiter(map(self.hashes.__getitem__, split), np.uint64, len(split))
        k = min(self.words, len(w))
        g = np.full(len(w) - k + 1, k, np.uint64)
        for i in range(k):
            g = g * BASE + w[i : len(w) - k + 1 + i]
        return np.unique(mixed(g))

    def keys(self, grams: np.ndarray) -> np.ndarray:
        least = None
        for at in range(0, len(grams), 4096):
            part = (grams[None, at : at + 4096] * self.factor + self.offset).min(axis=1)
            least = part if least is None else np.minimum(least, part)
        return (mixed((least.reshape(self.bands, self.rows) * self.weight).sum(axis=1, dtype=np.uint64)) ^ self.band).view(np.int64)


@lru_cache(maxsize=1)
def ngrams(words: int, bands: int, rows: int) -> NGrams:
    return NGrams(words, bands, rows)


def sketches(docs: DataFrame, words: int, bands: int, rows: int) -> DataFrame:
    """doc_id, the digest of its n-gram set (null if it has none), its band keys and, where docs has one, the row's place."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        make = ngrams(words, bands, rows)
        for batch in batches:
            digests, keys = [], []
            for text in batch.column(1).cast(pa.binary()).to_pylist():
                grams = make.set_of(text)
                digests.append(hashlib.blake2b(grams.tobytes(), digest_size=16).digest() if len(grams) else None)
                keys.append(make.keys(grams).tobytes() if len(grams) else None)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(digests, pa.binary()), pa.array(keys, pa.binary()), *batch.columns[2:]],
                    ["doc_id", "digest", "keys", *batch.schema.names[2:]]
            )

    carried = [PLACE] if PLACE in docs.columns else []
    made = "doc_id long, digest binary, keys binary" + (f", {PLACE} struct<file:string,row:long>" if carried else "")
    return to_python(docs.select(F.col("doc_id").cast("long"), "text", *carried)).mapInArrow(run, made)


def in_bands(sets: DataFrame, bands: int) -> DataFrame:
    """A row for each representative and band."""
    key = F.substr(F.col("keys"), F.col("band") * 8 + 1, F.lit(8))
    return sets.select("rep", "keys", F.explode(F.sequence(F.lit(0), F.lit(bands - 1))).alias("band")).select("rep", "band", key.alias("key"))


def verify(lengths: np.ndarray, grams: np.ndarray, left: np.ndarray, right: np.ndarray, threshold: float) -> np.ndarray:
    """Which pairs of sets (rows left[k], right[k]; grams: all sets in a row) reach the threshold."""
    a, b = lengths[left], lengths[right]
    fits = np.minimum(a, b) >= threshold * np.maximum(a, b)
    out = np.zeros(len(left), bool)
    left, right, at = left[fits], right[fits], np.flatnonzero(fits)
    if not len(at):
        return out
    begin = np.cumsum(lengths) - lengths
    if len(at) <= 64:
        common = np.empty(len(at), np.int64)
        for k, (i, j) in enumerate(zip(left.tolist(), right.tolist())):
            both = np.concatenate([grams[begin[i] : begin[i] + lengths[i]], grams[begin[j] : begin[j] + lengths[j]]])
            both.sort()
            common[k] = np.count_nonzero(both[1:] == both[:-1])
    else:
        # n-grams of one set only add nothing to what is common; the others make a 0/1 matrix, taken in slices
        _, of, n = np.unique(grams, return_inverse=True, return_counts=True)
        shared = n > 1
        place = np.cumsum(shared) - 1
        owner = np.repeat(np.arange(len(lengths)), lengths)
        keep = shared[of]
        owner, column = owner[keep], place[of[keep]]
        order = np.argsort(column, kind="stable")
        owner, column = owner[order], column[order]
        total = np.zeros((len(lengths), len(lengths)), np.float32)
        width = 8192
        for lo in range(0, int(shared.sum()), width):
            x, y = np.searchsorted(column, [lo, lo + width])
            part = np.zeros((len(lengths), width), np.float32)
            part[owner[x:y], column[x:y] - lo] = 1
            total += part @ part.T
        common = total[left, right].astype(np.int64)
    out[at] = common >= threshold * (lengths[left] + lengths[right] - common) - 1e-9
    return out


def _links(bands: int, threshold: float):
    def run(key: tuple, rows: pa.Table) -> pa.Table:
        rows = rows.sort_by([("band", "ascending"), ("key", "ascending"), ("i", "ascending"), ("j", "ascending"), ("rep", "ascending")])
        rep, band, i, j, own, copies = (rows[c].to_numpy() for c in ("rep", "band", "i", "j", "block", "copies"))
        bucket, sets, keys = rows["key"].to_pylist(), rows["grams"].to_pylist(), rows["keys"].to_pylist()
        change = np.ones(len(rep), bool)
        change[1:] = (np.diff(band) != 0) | (np.diff(i) != 0) | (np.diff(j) != 0) | np.array([x != y for x, y in zip(bucket[1:], bucket[:-1])], bool)
        cut = np.append(np.flatnonzero(change), len(rep))
        who, links, u, v = [], [], [], []
        for lo, hi in zip(cut[:-1].tolist(), cut[1:].tolist()):
            m = hi - lo
            if i[lo] == j[lo]:
                left, right = np.triu_indices(m, 1)
            else:
                a, b = np.flatnonzero(own[lo:hi] == i[lo]), np.flatnonzero(own[lo:hi] == j[lo])
                left, right = np.repeat(a, len(b)), np.tile(b, len(a))
            if not len(left):
                continue
            k = np.frombuffer(b"".join(keys[lo:hi]), "<i8").reshape(m, bands)
            first = np.ones(len(left), bool)
            for earlier in range(int(band[lo])):
                first &= k[left, earlier] != k[right, earlier]
            left, right = left[first], right[first]
            lengths = np.fromiter((len(s) // 8 for s in sets[lo:hi]), np.int64, m)
            good = verify(lengths, np.frombuffer(b"".join(sets[lo:hi]), "<u8"), left, right, threshold)
            left, right = left[good], right[good]
            if not len(left):
                continue
            n = np.bincount(left, copies[lo + right], minlength=m) + np.bincount(right, copies[lo + left], minlength=m)
            some = np.flatnonzero(n)
            who.append(rep[lo + some])
            links.append(n[some].astype(np.int64))
            root = np.arange(m)
            while True:  # each member takes the least root among its links', until none changes
                least = root.copy()
                np.minimum.at(least, left, root[right])
                np.minimum.at(least, right, root[left])
                least = least[least]
                if (least == root).all():
                    break
                root = least
            tied = np.flatnonzero(root != np.arange(m))
            u.append(rep[lo + tied])
            v.append(rep[lo + root[tied]])
        cat = lambda x: np.concatenate(x) if x else np.zeros(0, np.int64)
        n, e = len(cat(who)), len(cat(u))
        nulls = lambda k: pa.nulls(k, pa.int64())
        return pa.table({
            "u": pa.concat_arrays([pa.array(cat(who), pa.int64()), pa.array(cat(u), pa.int64())]),
            "v": pa.concat_arrays([nulls(n), pa.array(cat(v), pa.int64())]),
            "links": pa.concat_arrays([pa.array(cat(links), pa.int64()), nulls(e)]),
        })

    return run


def _dealt(df: DataFrame) -> DataFrame:
    """A row of df for each salt: the small side of a join on a key that many rows may share."""
    return df.select("*", F.explode(F.sequence(F.lit(0), F.lit(SALT - 1))).alias("salt"))


def _salt(*by: str):
    return F.pmod(F.hash(*by), F.lit(SALT)).alias("salt")


def components(edges: DataFrame) -> DataFrame:
    """node, root (the least node connected with it) of the nodes of edges (u, v)."""
    return contracted(edges).select(F.col("u").alias("node"), F.col("v").alias("root"))


def contracted(edges: DataFrame, name: str = "stars") -> DataFrame:
    """u, v of each node and the least node connected with it, if that is another, by alternating star contraction: written.

    A round joins each node to the least of its neighbours; distances to roots halve, and tables are written between
    rounds, so neither the driver nor the lineage grows. A node with many neighbours is met in parts, by its neighbours.
    """
    two = lambda a, b: [F.greatest(a, b).alias("u"), F.least(a, b).alias("v")]
    now = durable(edges.where("u <> v").select(*two("u", "v")).distinct(), name)
    state = None
    while True:
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v"))).select("u", "v", _salt("v"))
        least = _dealt(both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m")))
        large = both.join(least, ["u", "salt"]).where("v > u").select(F.col("v").alias("u"),
            F.col("m").alias("v")).where("u <> v").distinct().select("u", "v", _salt("v"))
        least = _dealt(large.groupBy("u").agg(F.min("v").alias("m")))
        small = large.join(least, ["u", "salt"]).select(F.explode(F.array(F.struct("v", "m"),
            F.struct(F.col("u").alias("v"), "m"))).alias("e")).select("e.*").where("v <> m")
        last, now = now, durable(small.select(*two("v", "m")).distinct(), name)
        new = now.agg(F.count("*"), F.bit_xor(F.xxhash64("u", "v"))).first()
        discard(last)
        if new == state:
            return now
        state = new


def classes(docs: DataFrame, words: int = WORDS, threshold: float = THRESHOLD, recall: float = RECALL, block: int = BLOCK) -> DataFrame:
    """doc_id, class_id, n_links, n_copies (documents with the same n-gram set, itself included), stays (one of a class) and
    the place of each row."""
    bands, rows = bands_and_rows(threshold, recall)
    docs = (docs if PLACE in docs.columns else placed(docs)).select("doc_id", "text", PLACE)
    found = durable(sketches(docs, words, bands, rows), "sketches", batch_rows=1_000)
    # A different set is a node by the number of its row in this table; ids may repeat.
    first = F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", PLACE)).alias("least")
    each = found.where("digest is not null").groupBy("digest").agg(first, F.count("*").alias("copies"), F.first("keys").alias("keys"))
    sets = durable(each.select("*", F.monotonically_increasing_id().alias("rep")), "sets")

    dealt = in_bands(sets, bands)
    members = dealt.groupBy("band", "key").agg(F.count("*").alias("m"), F.bit_xor(F.xxhash64("rep")).alias("x"),
        F.bit_xor(F.xxhash64("rep", F.lit(1))).alias("y")).where("m > 1")
    buckets = members.groupBy("m", "x", "y").agg(F.min(F.struct("band", "key")).alias("first")).select("first.band", "first.key",
        F.ceil(F.col("m") / block).cast("int").alias("blocks"))
    own = F.pmod(F.xxhash64("rep", F.lit(2)), F.col("blocks")).cast("int")
    met = dealt.select("*", _salt("rep")).join(_dealt(buckets), ["band", "key", "salt"])
    met = met.select("rep", "band", "key", own.alias("block"), F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("other"))
    met = met.select("rep", "band", "key", "block", F.least("block", "other").alias("i"), F.greatest("block", "other").alias("j"))
    visits = met.groupBy("rep").agg(F.collect_list(F.struct("band", "key", "block", "i", "j")).alias("visits"))

    # Each set that meets another is made once more, from the text of one of its rows.
    told_apart = durable(sets.join(visits, "rep").select("rep", "copies", "keys", "visits", F.col(f"least.{PLACE}").alias(PLACE)), "visits")
    # A block pair is the least that a group holds; what all of them are sent sets how many groups there are.
    sizes = docs.select(F.octet_length("text").cast("long").alias("bytes"), PLACE).join(told_apart.select(F.size("visits").alias("times"), PLACE), PLACE)
    groups = shares(sizes.agg(F.sum(F.col("bytes") * F.col("times"))).first()[0] or 0, GROUP_BYTES)
    group = F.pmod(F.xxhash64("band", "key", "i", "j"), F.lit(groups)).cast("int").alias("g")
    wanted = docs.select("text", PLACE).join(told_apart, PLACE).select("text", "rep", "copies", "keys", "visits")

    def with_sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        make = ngrams(words, bands, rows)
        for batch in batches:
            grams = [make.set_of(t).tobytes() for t in batch.column(0).cast(pa.binary()).to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns[1:], pa.array(grams, pa.binary())], [*batch.schema.names[1:], "grams"])

    visit = "struct<band:int,key:binary,block:int,i:int,j:int>"
    sent = wanted.mapInArrow(with_sets, f"rep long, copies long, keys binary, visits array<{visit}>, grams binary").select("rep", "copies", "keys",
        "grams", F.explode("visits").alias("at")).select("rep", "copies", "keys", "grams", "at.*").select(group, "*")
    verified = durable(sent.groupBy("g").applyInArrow(_links(bands, threshold), "u long, v long, links long"), "links")

    links = verified.where("links is not null").groupBy(F.col("u").alias("rep")).agg(F.sum("links").alias("links"))
    now = contracted(verified.where("v is not null").select("u", "v"))
    roots = now.select(F.col("u").alias("node"), F.col("v").alias("root"))
    told = sets.join(links, "rep", "left").join(roots.withColumnRenamed("node", "rep"), "rep",
        "left").where("copies > 1 or links is not null or root is not null")
    told = told.select("rep", "digest", F.coalesce("root", "rep").alias("root"), "least",
        (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links"), "copies", _salt("rep"))
    keepers = _dealt(told.groupBy("root").agg(F.min("least").alias("keeper")))
    told = _dealt(told.join(keepers, ["root", "salt"]).select("digest", "keeper", "n_links", "copies"))
    out = found.select("doc_id", "digest", PLACE, _salt(PLACE)).join(told, ["digest", "salt"], "left")
    alone = F.col("keeper").isNull()
    out = out.select(
        "doc_id",
        F.when(alone, F.col("doc_id")).otherwise(F.col("keeper.doc_id")).alias("class_id"),
        F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"),
        F.coalesce("copies", F.lit(1)).cast("long").alias("n_copies"),
        (alone | (F.col(f"keeper.{PLACE}") == F.col(PLACE))).alias("stays"),
        PLACE,
    )
    out = durable(out, "classes")
    discard(found, sets, told_apart, verified, now)
    return out


def op2_ngram_join(spark, sf_dir: str) -> DataFrame:
    return classes(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")).drop("stays", PLACE)


def stage(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class stays, the one with the smallest id, and of rows with that id and text one."""
    docs = placed(docs)
    return without(docs, classes(docs.select("doc_id", "text", PLACE)).where("not stays").select(PLACE))
