"""SentencePiece BPE with seeded merge-dropout, and its lossless decoder.

Encoding pops merges from an agenda, best score first and leftmost among equals, as the model's own encoder does; a
candidate is skipped when a keyed hash of (seed, document, position, segment, place, left piece, right piece) falls below
the dropout rate. A skipped pair comes back only when one of its sides has changed, so the hash alone decides and any
rerun gives the same pieces. The agenda runs over many segments at once: each round merges the best live candidate of each.

A segment is a word with its leading spaces, or a line feed; no piece of the model reaches over such a boundary. Each
occurrence of a segment is decided by itself. A task remembers a segment's pieces without dropout and the merges that led
to them; an occurrence whose hashes skip none of those has these pieces, and the agenda runs again for the others.

Cases: null text has null ids; an empty text has none; characters that the model lacks become byte pieces; a literal
word mark (U+2581) becomes byte pieces too, so that decoding gives it back; texts of any length are encoded whole; repeated rows
are alike, as an occurrence is told by its document's id and its place; a null id is one id; equal scores go to the leftmost
place; an empty table gives an empty one; other columns play no part, whatever they are called.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import lru_cache
from hashlib import blake2b
from itertools import islice

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import to_python

MARK = "▁"
SEGMENT = re.compile(f"{MARK}*[^{MARK}\n]+|{MARK}+|\n")
RATE, SEED = 0.1, 20_260
#: Segments that a task remembers before it begins anew.
MEMO = 400_000
#: Characters of texts whose segments are encoded together.
BLOCK = 1 << 20
NONE = np.int64(1) << 40


def mixed(x: np.ndarray) -> np.ndarray:
    """A bijective mix of 64-bit words, splitmix64's finaliser."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def character_sums(points: np.ndarray, place: np.ndarray, first: np.ndarray) -> np.ndarray:
    """A number for each segment, from its characters and their places."""
    u = np.uint64
    return np.add.reduceat(mixed(points.astype(u) + (place.astype(u) << u(32)) * u(0x9E3779B97F4A7C15)), first)


def keys(sums: np.ndarray, seed: int, variants: np.ndarray) -> np.ndarray:
    u = np.uint64
    return mixed(sums + (u(seed & 0xFFFFFFFF) << u(32)) + variants.astype(u))


def segment_keys(points: np.ndarray, place: np.ndarray, first: np.ndarray, seed: int, variants: np.ndarray) -> np.ndarray:
    """A key for each segment, from its characters and their places, the seed and the number of its variant or occurrence."""
    return keys(character_sums(points, place, first), seed, variants)


def merge_points(pair: np.ndarray, place: np.ndarray) -> np.ndarray:
    """What a merge adds to its segment's key, from its pair of pieces and its place in the segment."""
    return mixed(pair.astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93) + place.astype(np.uint64))


def bound_of(rate: float) -> np.uint64:
    return np.uint64(min(max(rate, 0.0), 1.0) * (2**64 - 1)) if rate < 1 else np.uint64(2**64 - 1)


class Merges:
    """The model as arrays: ids of characters, and for each pair of pieces the merged one, found in a hash table."""

    SLOTS = 1 << 20

    def __init__(self, path: str):
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=path)
        self.size = model.vocab_size()
        names = [model.id_to_piece(i) for i in range(self.size)]
        usable = {n: i for i, n in enumerate(names) if not (model.is_control(i) or model.is_unknown(i) or model.is_byte(i) or model.is_unused(i))}
        self.char = np.full(0x110000, -1, np.int64)
        pairs = []
        for name, i in usable.items():
            if len(name) == 1:
                self.char[ord(name)] = i
            for k in range(1, len(name)):
                left, right = usable.get(name[:k]), usable.get(name[k:])
                if left is not None and right is not None:
                    pairs.append((left * self.size + right, -model.get_score(i), i))
        order = {s: r for r, s in enumerate(sorted({p[1] for p in pairs}))}
        pairs.sort()
        self.keys = np.array([p[0] for p in pairs], np.int64)
        self.rank = np.array([order[p[1]] for p in pairs], np.int64)
        self.merged = np.array([p[2] for p in pairs], np.int64)
        self.byte = {int(n[3:5], 16): i for i, n in enumerate(names) if model.is_byte(i)}
        self.text = [bytes([int(n[3:5], 16)]) if model.is_byte(i) else b"" if model.is_control(i) else n.replace(MARK, " ").encode() for i,
            n in enumerate(names)]
        # open addressing: each key stands in the first free slot from its own on
        self.slot = np.full(self.SLOTS, -1, np.int32)
        self.slot_key = np.full(self.SLOTS, -1, np.int64)
        waiting, at = np.arange(len(self.keys)), self._own_slot(self.keys)
        while len(waiting):
            free = self.slot[at] < 0
            self.slot[at[free]] = waiting[free]
            self.slot_key[at[free]] = self.keys[waiting[free]]
            left = self.slot_key[at] != self.keys[waiting]
            waiting, at = waiting[left], (at[left] + 1) & (self.SLOTS - 1)

    def _own_slot(self, pair: np.ndarray) -> np.ndarray:
        return ((pair.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(44)).astype(np.int64)

    def find(self, pair: np.ndarray) -> np.ndarray:
        """Places of pairs among the keys, or -1."""
        at = self._own_slot(pair)
        key = self.slot_key[at]
        out = np.where(key == pair, self.slot[at], -1)
        left = np.flatnonzero((key != pair) & (key >= 0))
        while len(left):
            at[left] = (at[left] + 1) & (self.SLOTS - 1)
            key = self.slot_key[at[left]]
            hit = key == pair[left]
            out[left[hit]] = self.slot[at[left[hit]]]
            left = left[~hit & (key >= 0)]
        return out

    def literal(self, text: str) -> bytes:
        return np.array([self.byte[b] for b in text.encode()], "<u4").tobytes()

    def decode(self, ids: np.ndarray) -> str:
        """The text of ids; the dummy first space goes."""
        raw = b"".join(map(self.text.__getitem__, ids.tolist()))
        return (raw[1:] if raw[:1] == b" " else raw).decode()

    def segment(self, segments: list[str], rate: float, seed: int, variants: np.ndarray | int, trace: list | None = None) -> list[bytes]:
        """Piece ids of each segment in its variant, as little-endian 32-bit bytes.

        trace gets the merges of each round: their segments' numbers and their points.
        """
        if not segments:
            return []
        lengths = np.fromiter(map(len, segments), np.int64, len(segments))
        points = np.frombuffer("".join(segments).encode("utf-32-le", "surrogatepass"), "<u4")
        sym = self.char[points]
        place = np.arange(len(points), dtype=np.int64)
        owner = np.repeat(np.arange(len(segments)), lengths)
        first = np.cumsum(lengths) - lengths
        bound = bound_of(rate)
        key = segment_keys(points, place - first[owner], first, seed, np.broadcast_to(np.asarray(variants, np.int64), (len(segments),)))

        def candidates(left: np.ndarray, right: np.ndarray, at: np.ndarray, own: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
            """Agenda order and merged piece; NONE where there is no merge or it is skipped."""
            pair = np.where((left >= 0) & (right >= 0), left * self.size + right, -2)
            i = self.find(pair)
            ok = i >= 0
            if rate > 0:
                w = np.flatnonzero(ok)
                h = mixed(key[own[w]] ^ merge_points(pair[w], at[w] - first[own[w]]))
                ok[w[h < bound]] = False
            return np.where(ok, self.rank[i], NONE), self.merged[i]

        # Live symbols: those of segments that still have a candidate. order[k]: candidate of symbol k and its right neighbour.
        done_place, done_sym = [], []
        order, into = candidates(sym[:-1], sym[1:], place[:-1], owner[:-1])
        order = np.concatenate([np.where(owner[:-1] == owner[1:], order, NONE), [NONE]])
        into = np.concatenate([into, [0]])
        while len(sym):
            starts = np.flatnonzero(np.concatenate([[True], owner[1:] != owner[:-1]]))
            counts = np.diff(np.concatenate([starts, [len(sym)]]))
            # rank first, then place: ranks fit 20 bits and places within a block 40
            agenda = np.where(order == NONE, np.int64(1) << 62, (order << 40) + np.arange(len(sym)))
            best = np.minimum.reduceat(agenda, starts)
            live = best < (np.int64(1) << 62)
            if not live.all():
                stay = np.repeat(live, counts)
                done_place.append(place[~stay])
                done_sym.append(sym[~stay])
                shift = np.cumsum(stay) - 1
                sym, place, owner, order, into = sym[stay], place[stay], owner[stay], order[stay], into[stay]
                best = best[live]
                if not len(sym):
                    break
                at = shift[best & ((np.int64(1) << 40) - 1)]
            else:
                at = best & ((np.int64(1) << 40) - 1)
            if trace is not None:
                trace.append((owner[at], merge_points(sym[at] * self.size + sym[at + 1], place[at] - first[owner[at]])))
            sym[at] = into[at]
            gone = np.zeros(len(sym), bool)
            gone[at + 1] = True
            keep = ~gone
            at = at - np.arange(len(at))  # each earlier removal shifts the place to the left by one
            sym, place, owner, order, into = sym[keep], place[keep], owner[keep], order[keep], into[keep]
            before = at[at > 0] - 1
            touched = np.concatenate([at, before[owner[before] == owner[before + 1]]])  # one merge a segment, so no place twice
            right = np.minimum(touched + 1, len(sym) - 1)
            o, m = candidates(sym[touched], sym[right], place[touched], owner[touched])
            fits = (touched + 1 < len(sym)) & (owner[touched] == owner[right])
            order[touched], into[touched] = np.where(fits, o, NONE), m
        at, ids = np.concatenate([*done_place, place]), np.concatenate([*done_sym, sym])
        by = np.argsort(at, kind="stable")
        at, ids = at[by], ids[by]
        ends = np.searchsorted(at, np.concatenate([first[1:], [len(points)]]))
        ids32 = ids.astype("<u4").tobytes()
        unknown = ids < 0
        out, begin = [], 0
        odd = set(np.repeat(np.arange(len(segments)), np.diff(np.concatenate([[0], ends])))[unknown].tolist()) if unknown.any() else ()
        for s, end in enumerate(ends.tolist()):
            if s in odd:
                parts = [self.literal(chr(points[at[k]])) if unknown[k] else ids32[4 * k : 4 * k + 4] for k in range(begin, end)]
                out.append(b"".join(parts))
            else:
                out.append(ids32[4 * begin : 4 * end])
            begin = end
        return out


class _Numbers(dict):
    """Numbers of segments in the order in which they were first asked for."""

    def __missing__(self, segment: str) -> int:
        self[segment] = number = len(self)
        return number


class Encoder:
    """Texts to piece ids, with each segment's pieces and merges without dropout remembered."""

    def __init__(self, merges: Merges, rate: float = RATE, seed: int = SEED):
        self.merges, self.rate, self.seed, self.bound = merges, rate, seed, bound_of(rate)
        self.forget()

    def forget(self) -> None:
        self.numbers = _Numbers()
        #: by number: ids as bytes, the character sum, and where the merges' points stand in `steps`, and how many
        self.ids: list[bytes] = []
        self.sums, self.steps = np.zeros(0, np.uint64), np.zeros(0, np.uint64)
        self.begin, self.many = np.zeros(0, np.int64), np.zeros(0, np.int64)

    def document_key(self, doc_id) -> int:
        return int.from_bytes(blake2b(f"{self.seed}:{doc_id}".encode(), digest_size=8).digest(), "little")

    def occurrences(self, documents: list[int], counts: list[int]) -> np.ndarray:
        """A number for each occurrence, from its document's key and its position there."""
        counts = np.array(counts, np.int64)
        position = np.arange(counts.sum()) - np.repeat(np.cumsum(counts) - counts, counts)
        return mixed(np.repeat(np.array(documents, np.uint64), counts) + position.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))

    def learn(self, missing: list[str]) -> None:
        trace = []
        self.ids += self.merges.segment(missing, 0.0, self.seed, 0, trace)
        owner = np.concatenate([np.zeros(0, np.int64), *(o for o, _ in trace)])
        steps = np.concatenate([np.zeros(0, np.uint64), *(p for _, p in trace)])[np.argsort(owner, kind="stable")]
        many = np.bincount(owner, minlength=len(missing))
        lengths = np.fromiter(map(len, missing), np.int64, len(missing))
        first = np.cumsum(lengths) - lengths
        points = np.frombuffer("".join(missing).encode("utf-32-le", "surrogatepass"), "<u4")
        sums = character_sums(points, np.arange(len(points)) - np.repeat(first, lengths), first)
        self.begin = np.concatenate([self.begin, len(self.steps) + np.cumsum(many) - many])
        self.sums, self.steps, self.many = np.concatenate([self.sums, sums]), np.concatenate([self.steps, steps]), np.concatenate([self.many, many])

    def encode(self, segments: list[str], occurrence: np.ndarray) -> list[bytes]:
        """Ids of each occurrence of a segment."""
        if len(self.ids) > MEMO:
            self.forget()
        which = np.fromiter(map(self.numbers.__getitem__, segments), np.int64, len(segments))
        if len(self.numbers) > len(self.ids):
            self.learn(list(islice(reversed(self.numbers), len(self.numbers) - len(self.ids)))[::-1])
        out = list(map(self.ids.__getitem__, which.tolist()))
        if self.rate <= 0 or not segments:
            return out
        begin, many = self.begin[which], self.many[which]
        key = keys(self.sums[which], self.seed, occurrence)
        skipped, left, j = [], np.flatnonzero(many > 0), 0
        while len(left):
            below = mixed(key[left] ^ self.steps[begin[left] + j]) < self.bound
            skipped.append(left[below])
            left, j = left[~below], j + 1
            left = left[many[left] > j]
        again = np.concatenate([np.zeros(0, np.int64), *skipped])
        for at, ids in zip(again.tolist(), self.merges.segment([segments[k] for k in again.tolist()], self.rate, self.seed, occurrence[again].view(np.int64))):
            out[at] = ids
        return out

    def __call__(self, doc_ids: list, texts: list[str | None]) -> Iterator[bytes | None]:
        at, mark = 0, self.merges.literal(MARK)
        while at < len(texts):
            block, segments, documents, counts, size = [], [], [], [], 0
            while at < len(texts) and (size < BLOCK or not block):
                text, ends, before = texts[at], [], len(segments)
                for k, part in enumerate(text.split(MARK) if text else ()):
                    segments += SEGMENT.findall(((MARK if not k else "") + part.replace(" ", MARK)) if part or not k else "")
                    ends.append(len(segments))
                block.append((text, before, ends))
                documents.append(self.document_key(doc_ids[at]))
                counts.append(len(segments) - before)
                size += len(text or "")
                at += 1
            ids = self.encode(segments, self.occurrences(documents, counts))
            for text, before, ends in block:
                yield None if text is None else mark.join(b"".join(ids[a:b]) for a, b in zip([before, *ends], ends))


@lru_cache(maxsize=1)
def encoder(path: str, rate: float, seed: int) -> Encoder:
    """One for a Python worker, which runs many tasks."""
    return Encoder(Merges(path), rate, seed)


def encode(docs: DataFrame, model_path: str, rate: float = RATE, seed: int = SEED) -> DataFrame:
    """doc_id, ids (array<int>), and whether decoding them gives the text back."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode_all = encoder(model_path, rate, seed)
        for batch in batches:
            doc_ids, texts = batch.column(0), batch.column(1).to_pylist()
            found = list(encode_all(doc_ids.to_pylist(), texts))
            same = [None if b is None else encode_all.merges.decode(np.frombuffer(b, "<u4")) == t for b, t in zip(found, texts)]
            flat = pa.array(np.frombuffer(b"".join(b or b"" for b in found), "<i4"))
            ends = np.concatenate([[0], np.cumsum([len(b or b"") // 4 for b in found])]).astype(np.int32)
            lists = pa.ListArray.from_arrays(pa.array(ends), flat, mask=pa.array([b is None for b in found]))
            yield pa.RecordBatch.from_arrays([doc_ids.cast(pa.int64()), lists, pa.array(same, pa.bool_())], ["doc_id", "ids", "lossless"])

    return to_python(docs.select(F.col("doc_id").cast("long"), "text")).mapInArrow(run, "doc_id long, ids array<int>, lossless boolean")


def decode(encoded: DataFrame, model_path: str) -> DataFrame:
    """doc_id and text of doc_id and ids."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        merges = Merges(model_path)
        for batch in batches:
            texts = [None if ids is None else merges.decode(np.array(ids, np.int64)) for ids in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.string())], ["doc_id", "text"])

    return to_python(encoded.select("doc_id", "ids")).mapInArrow(run, "doc_id long, text string")


def model_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


def op4_subword_dropout(spark, sf_dir: str) -> DataFrame:
    """Every document's pieces, with their number and whether they decode to the text."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return encode(docs, model_path()).selectExpr("doc_id", "ids", "cast(size(ids) as long) n_pieces", "lossless")
