"""A corpus as a written table of token chunks, the base of operators that count over all words.

A chunk holds the words of some documents: its own vocabulary, most frequent first, and the documents' words as places in
it. The table is written to the shared folder once, so later passes read compact numbers instead of texts, and a chunk's
number keeps its meaning when an executor is lost and its tasks run again.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import durable, to_python, trim

#: Words after which a chunk is closed; a longer document makes a chunk of its own.
CHUNK_WORDS = 2_500_000

SCHEMA = "chunk_id long, n_words long, doc_ids binary, doc_words binary, vocabulary binary, words binary"
PLAIN = SCHEMA.replace("vocabulary binary, ", "")


def packed(array: np.ndarray | bytes) -> bytes:
    return zstandard.ZstdCompressor(level=1).compress(array if isinstance(array, bytes) else np.ascontiguousarray(array).tobytes())


def unpacked(blob: bytes, kind: str) -> np.ndarray:
    return np.frombuffer(zstandard.ZstdDecompressor().decompress(blob), kind)


def bundle(*arrays: np.ndarray) -> bytes:
    """Arrays of whole numbers >= 0 as one blob: each in as few bytes a number as its largest needs, by byte planes."""
    parts = []
    for array in arrays:
        width = max(1, (int(array.max()).bit_length() + 7) // 8) if len(array) else 1
        planes = np.ascontiguousarray(array.astype("<u8")).view("u1").reshape(-1, 8)[:, :width].T
        parts += [np.array([width, len(array)], "<u8").tobytes(), planes.tobytes()]
    return packed(b"".join(parts))


def unbundle(blob: bytes) -> list[np.ndarray]:
    raw = memoryview(zstandard.ZstdDecompressor().decompress(blob))
    at, out = 0, []
    while at < len(raw):
        width, n = np.frombuffer(raw, "<u8", 2, at).tolist()
        made = np.zeros((n, 8), "u1")
        made[:, :width] = np.frombuffer(raw, "u1", width * n, at + 16).reshape(width, n).T
        out.append(made.reshape(-1).view("<i8"))
        at += 16 + width * n
    return out


@dataclass
class Chunk:
    chunk_id: int
    doc_ids: np.ndarray
    keys: np.ndarray
    no_id: np.ndarray
    doc_words: np.ndarray
    vocabulary: list[bytes]
    words: np.ndarray

    @classmethod
    def of(cls, row: dict) -> Chunk:
        ids = unpacked(row["doc_ids"], "u1")
        n = len(ids) // 17
        raw = zstandard.ZstdDecompressor().decompress(row["vocabulary"]) if row.get("vocabulary") else b""
        return cls(
            row["chunk_id"], ids[: 8 * n].view("<i8"), ids[8 * n : 16 * n].view("<i8"), ids[16 * n :].astype(bool), unbundle(row["doc_words"])[0],
                raw.split(b" ") if raw else [],
            unbundle(row["words"])[0].astype(np.int32),
        )

    def ids(self) -> pa.Array:
        """The documents' ids as they came."""
        return pa.array(self.doc_ids, pa.int64(), mask=self.no_id)


def chunks_of(batches: Iterator[pa.RecordBatch] | pa.Table) -> Iterator[Chunk]:
    """Chunks of batches with SCHEMA's columns, with or without the vocabulary, one at a time."""
    for batch in batches if not isinstance(batches, pa.Table) else batches.to_batches():
        for i in range(batch.num_rows):
            yield Chunk.of({n: batch.column(k)[i].as_py() for k, n in enumerate(batch.schema.names)})


class _Places(dict):
    def __missing__(self, word: bytes) -> int:
        self[word] = place = len(self)
        return place


def tokenised(docs: DataFrame, lower: bool, chunk_words: int = CHUNK_WORDS) -> DataFrame:
    """The chunk table of doc_id, text and, where there is one, row_key (a long); null texts have no words, and a null id
    stays one.

    bytes.split() without arguments cuts at exactly the white space of the word rule, and bytes.lower() changes A-Z only.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part, made = TaskContext.get().partitionId(), 0
        places, ids, row_keys, sizes, words, total = _Places(), [], [], [], [], 0

        def close() -> pa.RecordBatch:
            nonlocal places, ids, row_keys, sizes, words, total, made
            flat = np.concatenate(words) if words else np.zeros(0, "<u4")
            order = np.argsort(-np.bincount(flat, minlength=len(places)), kind="stable")
            rank = np.empty(len(order), np.int64)
            rank[order] = np.arange(len(order))
            names = list(places)
            known = np.array([0 if i is None else i for i in ids] + row_keys, "<i8").tobytes() + np.array([i is None for i in ids], "u1").tobytes()
            row = {
                "chunk_id": [(part << 24) + made], "n_words": [total], "doc_ids": [packed(known)], "doc_words": [bundle(np.array(sizes, np.int64))],
                "vocabulary": [packed(b" ".join([names[i] for i in order.tolist()]))], "words": [bundle(rank[flat])],
            }
            made += 1
            places, ids, row_keys, sizes, words, total = _Places(), [], [], [], [], 0
            trim()
            return pa.RecordBatch.from_pydict(row, schema)

        schema = pa.schema([("chunk_id", pa.int64()), ("n_words", pa.int64()), *((n, pa.binary()) for n in ("doc_ids", "doc_words", "vocabulary", "words"))])
        for batch in batches:
            for doc_id, text, row_key in zip(batch.column(0).to_pylist(), batch.column(1).cast(pa.binary()).to_pylist(), batch.column(2).to_pylist()):
                split = (text.lower() if lower else text).split() if text else []
                if total and total + len(split) > chunk_words:
                    yield close()
                ids.append(doc_id)
                row_keys.append(row_key)
                sizes.append(len(split))
                words.append(np.fromiter(map(places.__getitem__, split), "<u4", len(split)))
                total += len(split)
        if ids:
            yield close()

    row_key = F.col("row_key") if "row_key" in docs.columns else F.lit(0).cast("long").alias("row_key")
    # The blobs are compressed already.
    return durable(to_python(docs.select(F.col("doc_id").cast("long"), "text", row_key)).mapInArrow(run, SCHEMA), "chunks", "none", batch_rows=1_000)


def total_words(corpus: DataFrame) -> int:
    return int(corpus.agg(F.sum("n_words")).first()[0] or 0)
