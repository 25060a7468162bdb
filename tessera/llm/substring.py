"""Substring dedup: words covered by a window that also starts in a document with a smaller id go.

A window is WINDOW words in a row. Windows are routed by an anchor, the least hash among their ANCHOR-word pieces, so
equal windows meet in one shard whatever documents they stand in. Anchors of one document only are settled first. Runs
of windows around one anchor make a segment; a chunk of the corpus sends each different segment once, with the smallest
id that has it. A shard builds a compressed FM-index over its segments and streams them through backward search over its
wavelet matrix: matching statistics say which windows stand in more than one segment, and the smallest id over a
window's interval goes back to the chunks that asked. Chunks then mark, judged on the input alone, what to remove.

An anchor with very many occurrences (a passage that many documents share, each between words of its own) isn't routed
whole: each of its windows is a segment of its own and goes to a shard by its own hash.

Words are compared by 64-bit hashes. Cases: null and empty texts have no words; texts shorter than a window lose
nothing; of equal texts the smallest id keeps its words; rows with one id aren't repeats of each other; texts of any
length are cut whole; an empty table gives an empty one; extra columns pass through `stage`, but for `n_chars`, which is the text's
length in characters there and is set anew where the text is cut.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import discard, durable, mixed, shares, trim
from tessera.llm.corpus import Chunk, chunks_of, packed, tokenised, total_words, unpacked
from tessera.llm.fmindex import FMIndex

WINDOW, ANCHOR = 13, 7
#: Occurrences from which an anchor's windows are routed one by one.
HOT = 5_000
ANCHOR_WORDS, SHARD_WORDS = 2_200_000, 800_000
#: Words of a chunk: a task holds about a dozen numbers for each.
CHUNK_WORDS = 1_400_000
BASE = np.uint64(0x9E3779B97F4A7C15 | 1)
INVERSE = np.uint64(pow(int(BASE), -1, 1 << 64))
FAR = np.iinfo(np.int64).max

MESSAGE = "kind int, dest long, source long, n long, a binary, b binary, c binary"
NAMES = ["kind", "dest", "source", "n", "a", "b", "c"]
ANCHORS, ANCHOR_CODES, SEGMENTS, SMALLEST = range(4)
ONCE, REPEATED, VERY_OFTEN = range(3)


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    kinds = [pa.int32(), pa.int64(), pa.int64(), pa.int64(), *[pa.binary()] * 3]
    return pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], t) for k, t in enumerate(kinds)], NAMES)


def _parts(of: np.ndarray) -> Iterator[tuple[int, slice]]:
    cut = np.concatenate([[0], np.flatnonzero(np.diff(of)) + 1, [len(of)]])
    for a, b in zip(cut[:-1].tolist(), cut[1:].tolist()):
        if b > a:
            yield int(of[a]), slice(a, b)


def _spans(start: np.ndarray, length: np.ndarray) -> np.ndarray:
    """start[0], start[0] + 1, ... of each span, in a row."""
    before = np.cumsum(length) - length
    return np.repeat(start - before, length) + np.arange(int(length.sum()))


def alike(digest: np.ndarray, start: np.ndarray, length: np.ndarray, words: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(first of each different segment, each segment's number): of one digest, and verified word by word.

    Segments of a digest that differ from its first in length or words stand alone.
    """
    _, first, of = np.unique(digest, return_index=True, return_inverse=True)
    rep = first[of]
    same = length == length[rep]
    some = np.flatnonzero(same & (rep != np.arange(len(rep))))
    if len(some):
        equal = words[_spans(start[some], length[some])] == words[_spans(start[rep[some]], length[some])]
        same[some] = np.logical_and.reduceat(equal, np.cumsum(length[some]) - length[some])
    other = np.flatnonzero(~same)
    of[other] = len(first) + np.arange(len(other))
    return np.concatenate([first, other]), of


class Windows:
    """A chunk's windows and their anchors."""

    def __init__(self, chunk: Chunk, anchor_groups: int):
        import xxhash

        self.chunk = chunk
        hashes = np.fromiter((xxhash.xxh64_intdigest(w) for w in chunk.vocabulary), np.uint64, len(chunk.vocabulary))
        self.words = hashes[chunk.words] if len(hashes) else np.zeros(0, np.uint64)
        # no id is greater than all ids
        self.ids = np.where(chunk.no_id, FAR, chunk.doc_ids)
        n, sizes = len(self.words), chunk.doc_words
        self.doc = np.repeat(np.arange(len(sizes), dtype=np.int32), sizes)
        left = np.repeat(np.cumsum(sizes), sizes) - np.arange(n)  # words from here to the text's end
        if n < WINDOW:
            self.start = np.zeros(0, np.int64)
            self.anchor_at = self.start
            self.grams = np.zeros(0, np.uint64)
        else:
            grams = np.zeros(n - ANCHOR + 1, np.uint64)
            for k in range(ANCHOR):
                grams *= BASE
                grams += self.words[k : n - ANCHOR + 1 + k]
            self.grams = mixed(grams)
            # The least of WINDOW - ANCHOR + 1 = 7 pieces from each place on, its place in the lowest bits. Which of two equal
            # pieces is taken doesn't matter: windows are routed by the piece, not by its place.
            m = n - WINDOW + 1
            low = np.uint64(15)
            key = (self.grams & ~low) | (np.arange(len(grams), dtype=np.uint64) & low)
            two = np.minimum(key[:-1], key[1:])
            four = np.minimum(two[:-2], two[2:])
            least = np.minimum(four[:m], four[3 : m + 3]) & low
            self.start = np.flatnonzero(left[:m] >= WINDOW)
            self.anchor_at = self.start + ((least[self.start].astype(np.int64) - self.start) & 15)
            del key, two, four, least, left
        # anchors: different values in the chunk, by (group, value)
        is_anchor = np.zeros(n, bool)
        is_anchor[self.anchor_at] = True
        places = np.flatnonzero(is_anchor)
        values, of = np.unique(self.grams[places], return_inverse=True) if len(places) else (np.zeros(0, np.uint64), np.zeros(0, np.int64))
        self.places, self.count = places, np.bincount(of, minlength=len(values))
        low, high = np.full(len(values), FAR), np.full(len(values), -1)
        np.minimum.at(low, of, self.doc[places])
        np.maximum.at(high, of, self.doc[places])
        self.several = low < high
        group = (mixed(values ^ np.uint64(0x2545F491)) % np.uint64(anchor_groups)).astype(np.int64)
        self.order = np.argsort(group, kind="stable")
        self.group, self.values, self.value_of_place = group[self.order], values, of

    def anchors(self) -> pa.RecordBatch:
        out = []
        for group, places in _parts(self.group):
            i = self.order[places]
            # the count's lowest bit says whether two documents of this chunk have it
            out.append((ANCHORS, group, self.chunk.chunk_id, len(i), self.values[i].astype("<u8").tobytes(),
                packed((2 * self.count[i] + self.several[i]).astype("<u4")), None))
        return _batch(out)

    def segments(self, replies: list[dict], shards: int) -> None:
        """Sets the segments of anchors that are repeated, and their routes."""
        at, code = dict(_parts(self.group)), np.zeros(len(self.values), np.uint8)
        for r in replies:
            code[self.order[at[r["source"]]]] = unpacked(r["a"], "u1")
        of_place = np.zeros(len(self.words) + 1, np.uint8)
        of_place[self.places] = code[self.value_of_place]
        kind = of_place[self.anchor_at]
        some = np.flatnonzero(kind != ONCE)
        start, anchor, kind = self.start[some], self.anchor_at[some], kind[some]
        fresh = np.ones(len(some), bool)
        fresh[1:] = (anchor[1:] != anchor[:-1]) | (start[1:] != start[:-1] + 1) | (kind[1:] == VERY_OFTEN)
        begin = np.flatnonzero(fresh)
        self.run_start, self.run_windows = start[begin], np.diff(np.concatenate([begin, [len(start)]]))
        length = self.run_windows + WINDOW - 1
        # content by prefix sums of a polynomial hash
        n = len(self.words)
        powers = np.full(n + 1, BASE, np.uint64)
        powers[:1] = 1
        powers = np.multiply.accumulate(powers)
        back = np.full(n + 1, INVERSE, np.uint64)
        back[:1] = 1
        back = np.multiply.accumulate(back)
        sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(self.words * powers[:-1], dtype=np.uint64)])
        content = mixed((sums[self.run_start + length] - sums[self.run_start]) * back[self.run_start] + length.astype(np.uint64) * np.uint64(0x632BE59BD9B4E019))
        route = np.where(kind[begin] == VERY_OFTEN, content, self.grams[anchor[begin]] if len(begin) else content)
        first, self.run_of = alike(content, self.run_start, length, self.words)
        digest = content[first]
        self.seg_start, self.seg_words = self.run_start[first], length[first]
        self.smallest = np.full(len(digest), FAR)
        np.minimum.at(self.smallest, self.run_of, self.ids[self.doc[self.run_start]])
        group = (mixed(route[first] ^ np.uint64(0x1B873593)) % np.uint64(shards)).astype(np.int64)
        self.seg_order = np.lexsort((digest, group))
        self.seg_group = group[self.seg_order]

    def sent(self) -> pa.RecordBatch:
        out = []
        for group, places in _parts(self.seg_group):
            i = self.seg_order[places]
            words = self.words[_spans(self.seg_start[i], self.seg_words[i])]
            out.append((SEGMENTS, group, self.chunk.chunk_id, len(i), packed(self.seg_words[i].astype("<u2")), words.astype("<u8").tobytes(),
                packed(self.smallest[i].astype("<i8"))))
        return _batch(out)

    def removed(self, replies: list[dict]) -> np.ndarray:
        """Whether each word goes."""
        at = dict(_parts(self.seg_group))
        windows = self.seg_words - WINDOW + 1
        first = np.cumsum(windows) - windows
        least = np.full(int(windows.sum()), FAR)
        for r in replies:
            i = self.seg_order[at[r["source"]]]
            least[_spans(first[i], windows[i])] = unpacked(r["a"], "<i8")
        goes = np.zeros(len(self.words) + 1, np.int64)
        if len(self.run_start):
            start = _spans(self.run_start, self.run_windows)
            value = least[_spans(first[self.run_of], self.run_windows)]
            hit = start[value < self.ids[self.doc[start]]]
            np.add.at(goes, hit, 1)
            np.add.at(goes, hit + WINDOW, -1)
        return np.cumsum(goes[:-1]) > 0


def _settle_anchors(key: tuple, rows: pa.Table, hot: int = HOT) -> pa.Table:
    rows = rows.sort_by("source").to_pylist()
    value, of = np.unique(np.concatenate([np.frombuffer(r["a"], "<u8") for r in rows]), return_inverse=True)
    said = np.concatenate([unpacked(r["b"], "<u4") for r in rows]).astype(np.int64)
    count = np.bincount(of, said >> 1, minlength=len(value))
    repeated = (np.bincount(of, minlength=len(value)) > 1) | (np.bincount(of, said & 1, minlength=len(value)) > 0)
    code = np.where(repeated, np.where(count > hot, VERY_OFTEN, REPEATED), ONCE).astype("u1")[of]
    out, at = [], 0
    for r in rows:
        out.append((ANCHOR_CODES, r["source"], key[0].as_py(), r["n"], packed(code[at : at + r["n"]]), None, None))
        at += r["n"]
    return pa.Table.from_batches([_batch(out)])


def smallest_ids(lengths: np.ndarray, words: np.ndarray, ids: np.ndarray, window: int = WINDOW) -> np.ndarray:
    """Of segments, in a row: for each window the smallest id of a segment that holds it."""
    segments = len(lengths)
    _, symbol = np.unique(words, return_inverse=True)
    text = np.zeros(len(words) + segments, np.int64)
    owner = np.repeat(np.arange(segments), lengths + 1)
    begin = np.cumsum(lengths + 1) - (lengths + 1)
    text[_spans(begin, lengths)] = symbol + 1
    index = FMIndex(text)
    count = lengths - window + 1
    ends = _spans(begin, count) + window
    length, low, high = index.statistics(text, ends, window)
    least = np.repeat(ids, count)
    long = np.flatnonzero(length >= window)
    if len(long):
        at_suffix = ids[owner[index.suffixes]]
        lows, of = np.unique(low[long], return_inverse=True)
        highs = np.zeros(len(lows), np.int64)
        highs[of] = high[long]
        # intervals of one length are apart, so every second slot of the reduction is one of them
        cuts = np.empty(2 * len(lows), np.int64)
        cuts[0::2], cuts[1::2] = lows, np.minimum(highs, index.n - 1)
        found = np.minimum.reduceat(at_suffix, cuts)[0::2]
        last = highs == index.n
        found[last] = [at_suffix[a:].min() for a in lows[last].tolist()]
        least[long] = found[of]
    return least


def _search(key: tuple, rows: pa.Table) -> pa.Table:
    trim()
    rows = rows.sort_by("source").to_pylist()
    lengths = np.concatenate([unpacked(r["a"], "<u2") for r in rows]).astype(np.int64)
    words = np.concatenate([np.frombuffer(r["b"], "<u8") for r in rows])
    ids = np.concatenate([unpacked(r["c"], "<i8") for r in rows])
    # equal segments of several chunks are indexed once
    start = np.cumsum(lengths) - lengths
    rank = np.arange(int(lengths.max()))[_spans(np.zeros(len(lengths), np.int64), lengths)]
    digest = np.add.reduceat(mixed(words + (rank.astype(np.uint64) + np.uint64(1)) * BASE), start) + lengths.astype(np.uint64)
    first, of = alike(digest, start, lengths, words)
    smallest = np.full(len(first), FAR)
    np.minimum.at(smallest, of, ids)
    least = smallest_ids(lengths[first], words[_spans(start[first], lengths[first])], smallest)
    windows = lengths[first] - WINDOW + 1
    at = np.cumsum(windows) - windows
    out, done = [], 0
    for r in rows:
        i = of[done : done + r["n"]]
        done += r["n"]
        out.append((SMALLEST, r["source"], key[0].as_py(), r["n"], packed(least[_spans(at[i], windows[i])].astype("<i8")), None, None))
    return pa.Table.from_batches([_batch(out)])


RESULT = "doc_id long, n_words long, n_removed long, kept_sha256 string"


def dedup(docs: DataFrame, with_text: bool = False, hot: int = HOT, only_cut: bool = False) -> DataFrame:
    """doc_id, n_words, n_removed, kept_sha256 and, if asked for, the kept words as a text and docs' row_key (0 if none);
    of all rows, or of those that lose words only."""
    result = RESULT + (", kept_text string, row_key long" if with_text else "")
    corpus = tokenised(docs, lower=False, chunk_words=CHUNK_WORDS)
    total = total_words(corpus)
    anchor_groups, shards = shares(total, ANCHOR_WORDS), shares(total, SHARD_WORDS)

    def send_anchors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for chunk in chunks_of(batches):
            yield Windows(chunk, anchor_groups).anchors()

    def send_segments(key: tuple, chunk_rows: pa.Table, replies: pa.Table) -> pa.Table:
        trim()
        sent = []
        for chunk in chunks_of(chunk_rows):
            w = Windows(chunk, anchor_groups)
            w.segments(replies.to_pylist(), shards)
            sent.append(w.sent())
        return pa.Table.from_batches(sent or [_batch([])])

    def finish(key: tuple, chunk_rows: pa.Table, reply_rows: pa.Table) -> pa.Table:
        trim()
        replies = reply_rows.to_pylist()
        made = []
        for chunk in chunks_of(chunk_rows):
            out = [[], [], [], []]
            w = Windows(chunk, anchor_groups)
            w.segments([r for r in replies if r["kind"] == ANCHOR_CODES], shards)
            goes = w.removed([r for r in replies if r["kind"] == SMALLEST])
            at = 0
            for n in chunk.doc_words.tolist():
                gone = goes[at : at + n]
                kept = chunk.words[at : at + n][~gone] if gone.any() else chunk.words[at : at + n]
                text = b" ".join(map(chunk.vocabulary.__getitem__, kept.tolist()))
                for column, value in zip(out, (n, n - len(kept), hashlib.sha256(text).hexdigest(), text.decode() if with_text else None)):
                    column.append(value)
                at += n
            columns = [pa.array(c, t) for c, t in zip(out, (pa.int64(), pa.int64(), pa.string(), pa.string()))][: 3 + with_text]
            if with_text:
                columns.append(pa.array(chunk.keys, pa.int64()))
            made.append(pa.table([chunk.ids(), *columns], [c.split()[0] for c in result.split(", ")]))
        return pa.concat_tables(made)

    by_chunk = lambda df: df.withColumnRenamed("dest", "chunk_id").groupBy("chunk_id")
    codes = durable(corpus.mapInArrow(send_anchors, MESSAGE).groupBy("dest").applyInArrow(lambda key, rows: _settle_anchors(key, rows, hot), MESSAGE),
        "anchors", "none")
    segments = corpus.groupBy("chunk_id").cogroup(by_chunk(codes)).applyInArrow(send_segments, MESSAGE)
    least = segments.groupBy("dest").applyInArrow(_search, MESSAGE)
    out = corpus.groupBy("chunk_id").cogroup(by_chunk(codes.unionByName(least))).applyInArrow(finish, result)
    out = durable(out.where("n_removed > 0") if only_cut else out, "cut-words")
    discard(corpus, codes)
    return out


def op3_substring_dedup(spark, sf_dir: str) -> DataFrame:
    return dedup(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"))


def stage(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with their kept words as text; texts that lose nothing keep their white space.

    What a row loses follows from its id and text, so rows are found again by both, and rows that repeat both lose the
    same. Every row comes back once, with its own columns.
    """
    key = F.xxhash64("text")
    source = docs.select("doc_id", "text", key.alias("row_key"))
    cut = dedup(source, with_text=True, only_cut=True).select(F.col("doc_id").alias("doc_id"), "row_key", "kept_text").dropDuplicates(["doc_id", "row_key"])
    row = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), F.col("doc_id").alias("own_id"), key.alias("own_key"))
    joined = row.join(cut, F.col("own_id").eqNullSafe(F.col("doc_id")) & (F.col("own_key") == F.col("row_key")), "left")
    kept = F.col("kept_text")
    renewed = {"text": F.coalesce(kept, F.col("row.text")), "n_chars": F.when(kept.isNull(), F.col("row.n_chars")).otherwise(F.length(kept)).cast("long")}
    return joined.select(*[renewed.get(c, F.col(f"row.`{c}`")).alias(c) for c in docs.columns])
