"""Packing token sequences by best-fit decreasing.

Overlong documents are cut into full windows; the pieces are dealt by hash into groups of GROUP_TOKENS tokens or so, and each
group places its pieces, longest first, into the open window with the least room that still holds them. A segment tree over
the remaining capacities, counting open windows, finds that window in log(window) steps. How many groups there are follows
from the number of tokens, and a piece's group from its content and its number among equal pieces, so the sequences depend
on the documents alone, not on files, codecs or the order of rows.

Cases: a null or empty text is its end token alone; ties are broken by document id and start; repeated rows are packed
as rows of their own, and very many of them are dealt to all groups; a null id stays one; extra columns are ignored; an empty table packs into nothing. Long texts are tokenised whole.
"""

from __future__ import annotations

import re
import zlib
from array import array
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import discard, durable, to_python

WINDOW = 2048
END = 1
#: Tokens whose pieces go to one group.
GROUP_TOKENS = 8_000_000
#: Equal pieces that one row stands for, before they are dealt to groups.
COPIES = 100_000
#: Words and parts of words whose ids a task remembers before it begins anew.
MEMO, PARTS = 800_000, 500_000

PIECES = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long"


#: How the tokenizer cuts a word, and the letters that stand for bytes that aren't printable.
CUT = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
PRINTABLE = [*range(33, 127), *range(161, 173), *range(174, 256)]
#: str.split() also cuts at four separators that the tokenizer keeps; texts with one of them are cut at its own white space.
SEPARATORS = "\x1c\x1d\x1e\x1f"
WORDS = re.compile("[^\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]+")


def split(text: str | None) -> list[str]:
    if not text:
        return []
    return WORDS.findall(text) if any(c in text for c in SEPARATORS) else text.split()


def byte_letters() -> list[str]:
    other = iter(range(256, 512))
    return [chr(b) if b in PRINTABLE else chr(next(other)) for b in range(256)]


class WordMemo(dict):
    """Ids of words, as little-endian 32-bit bytes, learned when first asked for; called, ids of texts by way of their words.

    The tokenizer drops white space and joins nothing across it, so a text's ids are its words' ids in order. Words of
    Latin letters and signs are cut here as the tokenizer's file says, and only its merges are asked for; any other word
    goes through the whole tokenizer.
    """

    def __init__(self, path: str):
        import regex
        from tokenizers import Tokenizer

        super().__init__()
        tokenizer = Tokenizer.from_file(path)
        self.whole, self.merge = tokenizer.encode, tokenizer.model.tokenize
        self.cut = regex.compile(CUT).findall
        self.letters = byte_letters()
        self.plain = re.compile(r"[\x21-\x7e\u00a1-\u024f]+").fullmatch
        self.parts: dict[str, bytes] = {}

    def part(self, part: str) -> bytes:
        ids = self.parts.get(part)
        if ids is None:
            asked = part if part.isascii() else "".join(map(self.letters.__getitem__, part.encode()))
            ids = self.parts[part] = array("I", [t.id for t in self.merge(asked)]).tobytes()
        return ids

    def __missing__(self, word: str) -> bytes:
        if self.plain(word) and "<|" not in word:
            found = self.cut(word.lower())
            ids = self.part(found[0]) if len(found) == 1 else b"".join(map(self.part, found))
        else:
            ids = array("I", self.whole(word, add_special_tokens=False).ids).tobytes()
        self[word] = ids
        return ids

    def __call__(self, texts: list[str | None]) -> Iterator[bytes]:
        for text in texts:
            if len(self) > MEMO:
                self.clear()
            if len(self.parts) > PARTS:
                self.parts.clear()
            yield b"".join(map(self.__getitem__, split(text)))


@lru_cache(maxsize=1)
def word_memo(path: str) -> WordMemo:
    """One for a Python worker, which runs many tasks."""
    return WordMemo(path)


def pieces(docs: DataFrame, tokenizer_path: str, window: int = WINDOW) -> DataFrame:
    """Pieces of at most `window` tokens: every full window of a document, then its rest."""
    end = np.array([END], "<u4").tobytes()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        memo = word_memo(tokenizer_path)
        for batch in batches:
            out = [[], [], [], [], []]
            for doc_id, ids in zip(batch.column(0).to_pylist(), memo(batch.column(1).to_pylist())):
                ids += end
                n = len(ids) // 4
                for start in range(0, n, window):
                    length = min(window, n - start)
                    for column, value in zip(out, (doc_id, start, length, zlib.crc32(ids[4 * start : 4 * (start + length)]), n)):
                        column.append(value)
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in out], ["doc_id", "start", "length", "ids_crc32", "doc_tokens"])

    return to_python(docs.select(F.col("doc_id").cast("long"), "text")).mapInArrow(run, PIECES)


class RoomTree:
    """Segment tree over capacities 0..window: each node counts the open windows below it."""

    def __init__(self, window: int):
        self.leaves = 1 << window.bit_length()
        self.count = [0] * (2 * self.leaves)

    def add(self, room: int, by: int) -> None:
        node = room + self.leaves
        while node:
            self.count[node] += by
            node >>= 1

    def tightest(self, room: int) -> int:
        """Least capacity of an open window that is at least `room`, or -1."""
        node, count = room + self.leaves, self.count
        if count[node]:
            return room
        while node > 1:
            if not node & 1 and count[node + 1]:
                node += 1
                while node < self.leaves:
                    node = 2 * node + (not count[2 * node])
                return node - self.leaves
            node >>= 1
        return -1


def best_fit(lengths: np.ndarray, window: int = WINDOW) -> tuple[np.ndarray, np.ndarray]:
    """Window and offset of each length; lengths come in decreasing order."""
    tree, open_at = RoomTree(window), [[] for _ in range(window + 1)]
    where, offset = np.empty(len(lengths), np.int64), np.empty(len(lengths), np.int64)
    windows = 0
    for i, length in enumerate(lengths.tolist()):
        room = tree.tightest(length)
        if room < 0:
            w, room = windows, window
            windows += 1
        else:
            w = open_at[room].pop()
            tree.add(room, -1)
        where[i], offset[i] = w, window - room
        if room > length:
            open_at[room - length].append(w)
            tree.add(room - length, 1)
    return where, offset


def counted(cut: DataFrame) -> DataFrame:
    """Different pieces with how often each occurs; equal ones meet before the shuffle."""
    return cut.groupBy("doc_id", "start", "length", "ids_crc32", "doc_tokens").agg(F.count("*").alias("copies"))


def copied(held: DataFrame) -> DataFrame:
    """Every piece again, with its number among equal ones; a piece with very many copies is dealt out first."""
    runs = lambda df: df.withColumn("copy", F.explode(F.sequence("first", F.least("copies", F.col("first") + COPIES) - 1)))
    few = held.where(F.col("copies") <= COPIES).withColumn("first", F.lit(0).cast("long"))
    many = held.where(F.col("copies") > COPIES).withColumn("first", F.explode(F.sequence(F.lit(0).cast("long"), F.col("copies") - 1, F.lit(COPIES).cast("long"))))
    return runs(few).unionByName(runs(many.repartition("doc_id", "start", "first"))).drop("first", "copies")


def pack(cut: DataFrame, groups: int, window: int = WINDOW) -> DataFrame:
    """Pieces (with their number among equal ones) with sequence_id, offset and padded_length."""
    names = ["doc_id", "start", "length", "ids_crc32", "doc_tokens"]

    def run(key: tuple, table: pa.Table) -> pa.Table:
        ids = table["doc_id"].combine_chunks()
        c = {n: table[n].fill_null(0).to_numpy() for n in names}
        order = np.lexsort((c["ids_crc32"], c["start"], c["doc_id"], -c["length"]))
        where, offset = best_fit(c["length"][order], window)
        filled = np.zeros(int(where.max()) + 1, np.int64)
        np.add.at(filled, where, c["length"][order])
        padded = np.where(filled & (filled - 1), window, filled)
        out = [ids.take(pa.array(order)), *(pa.array(c[n][order]) for n in names[1:])]
        return pa.table([*out, pa.array(where * groups + key[0].as_py()), pa.array(offset), pa.array(padded[where])],
            [*names, "sequence_id", "offset", "padded_length"])

    group = F.pmod(F.xxhash64("doc_id", "start", "ids_crc32", "copy"), F.lit(groups))
    return cut.withColumn("pack_group", group).groupBy("pack_group").applyInArrow(run, PIECES + ", sequence_id long, offset long, padded_length long")


def pack_documents(docs: DataFrame, tokenizer_path: str, window: int = WINDOW) -> DataFrame:
    """The pieces of all documents in sequences of at most `window` tokens."""
    held = durable(counted(pieces(docs, tokenizer_path, window)), "pieces")
    tokens = held.agg(F.sum(F.col("length") * F.col("copies"))).first()[0] or 0
    out = durable(pack(copied(held), max(1, -(-tokens // GROUP_TOKENS)), window), "packed")
    discard(held)
    return out


def tokenizer_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def op5_packing(spark, sf_dir: str) -> DataFrame:
    return pack_documents(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"), tokenizer_path())


def stage(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    return pack_documents(docs, tokenizer_path())
