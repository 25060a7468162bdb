"""Byte-level BPE by prefix-sharing trie traversal, and its decoder.

A text is cut at its special tokens, then into words by the vocabulary's pattern. The distinct words of a batch that the
worker doesn't remember are inserted into a trie of bytes, which is walked depth first. A node's state is the last token
of its prefix's encoding: the one token that ends there, is its own encoding, and may follow the state of the node where
it begins. So a prefix that many words share is encoded once, and a word's tokens are read off backwards from its node.

Two tokens may follow one another when byte-pair merging leaves the boundary between them alone. That is decided on the
left token's right edge and the right token's left edge: as both grow by their own merges in order of rank, no merge over
the boundary may come first (among equal ranks the leftmost comes first).

Cases: a null text counts as empty and has no tokens; repeated rows and ids are each encoded; special tokens in a text
become their own ids; texts and words of any length are encoded whole; an empty table gives an empty one; other columns
play no part, whatever they are called.
"""

from __future__ import annotations

import gc
import heapq
import json
import re
from collections.abc import Iterable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import to_python

#: Fixed value: the pattern that cuts words, of byte-level vocabularies of this family.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: The same of texts that are ASCII only.
ASCII = re.compile(r" ?[A-Za-z]+|'(?:[stmd]|re|ve|ll)| ?[0-9]+| ?[^\sA-Za-z0-9]+|\s+(?!\S)|\s+", re.ASCII)
#: Ranges that are letters or numbers only since a Unicode version later than the vocabulary's library has.
LATER = [
    (0x558, 0x558), (0x58B, 0x58C), (0x88F, 0x88F), (0xC5C, 0xC5C), (0xCDC, 0xCDC), (0x208F, 0x208F), (0x209D, 0x209F), (0xA7CE, 0xA7CF), (0xA7D2, 0xA7D2),
    (0xA7D4, 0xA7D4), (0xA7DD, 0xA7DD), (0xA7E2, 0xA7E2), (0xA7F1, 0xA7F1), (0xAB6C, 0xAB6D), (0x107BB, 0x107BF), (0x10940, 0x10959), (0x10EC5, 0x10EC7),
    (0x10ED9, 0x10EEE), (0x11B0A, 0x11B0A), (0x11DB0, 0x11DDB), (0x11DE0, 0x11DE9), (0x11DF1, 0x11DF1), (0x1246F, 0x1246F), (0x12475, 0x1247F), (0x12550, 0x12686),
    (0x16EA0, 0x16EB8), (0x16EBB, 0x16ED3), (0x16FF2, 0x16FF6), (0x187F8, 0x187FF), (0x18CD6, 0x18CDA), (0x18D09, 0x18D20), (0x18D80, 0x18DF2), (0x18E00, 0x19191),
    (0x191A0, 0x191D2), (0x1B123, 0x1B128), (0x1B168, 0x1B168), (0x1D6A6, 0x1D6A6), (0x1DF1F, 0x1DF24), (0x1DF2B, 0x1DF81), (0x1DF90, 0x1DF96), (0x1DFCD, 0x1DFFF),
    (0x1E6C0, 0x1E6DE), (0x1E6E0, 0x1E6E2), (0x1E6E4, 0x1E6E5), (0x1E6E7, 0x1E6ED), (0x1E6F0, 0x1E6F4), (0x1E6FE, 0x1E6FF), (0x2B73A, 0x2B73F), (0x2B81E, 0x2B81E),
    (0x2CEA2, 0x2CEAD), (0x323B0, 0x33479), (0x3D000, 0x3FC3F),
]
LATER_SET = "[" + "".join(f"{chr(a)}-{chr(b)}" for a, b in LATER) + "]"
HAS_LATER = re.compile(LATER_SET)
WORDS = regex.compile(PATTERN)
WORDS_WITH_LATER = regex.compile(PATTERN.replace(r"[^\s\p{L}\p{N}]", r"[[^\s\p{L}\p{N}]||LATER]").replace(r"?\p{L}", r"?[\p{L}--LATER]").replace(r"?\p{N}", r"?[\p{N}--LATER]").replace("LATER", LATER_SET), regex.V1)
#: Words that a worker remembers, and words of one trie.
MEMO, TRIE = 600_000, 16_384
#: Valid and invalid neighbours that a worker remembers.
PAIRS = 2_000_000
NEVER = 1 << 40


def byte_letters() -> dict[str, int]:
    """The letter that stands for each byte in the vocabulary's file: printable ones for themselves, others from 256 on."""
    shown = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or b >= 174]
    hidden = [b for b in range(256) if b not in set(shown)]
    return {chr(b): b for b in shown} | {chr(256 + k): b for k, b in enumerate(hidden)}


class Vocabulary:
    """Tokens as bytes, merges by rank, and which tokens may be neighbours."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            held = json.load(f)
        byte = byte_letters()
        self.id = {bytes(byte[c] for c in name): i for name, i in held["model"]["vocab"].items()}
        self.special = {t["content"]: t["id"] for t in held["added_tokens"]}
        self.bytes = [b""] * (1 + max([*self.id.values(), *self.special.values()], default=0))
        for name, i in self.id.items():
            self.bytes[i] = name
        for name, i in self.special.items():
            self.bytes[i] = name.encode()
        #: what tokens end with, and the token that this is, or -1
        self.tails = {name[j:]: -1 for name in self.id for j in range(1, len(name))} | self.id
        #: of a pair: its rank and the token it makes; of a token: the pair and rank that make it
        self.merge: dict[tuple[int, int], tuple[int, int]] = {}
        self.made: dict[int, tuple[int, int, int]] = {}
        for rank, pair in enumerate(held["model"]["merges"]):
            left, right = (self.id[bytes(byte[c] for c in part)] for part in (pair.split(" ") if isinstance(pair, str) else pair))
            whole = self.id[self.bytes[left] + self.bytes[right]]
            self.merge.setdefault((left, right), (rank, whole))
            self.made.setdefault(whole, (left, right, rank))
        self.rank = {pair: rank for pair, (rank, _) in self.merge.items()}
        self.edges: dict[tuple[int, int], list[tuple[int, int]]] = {}
        self.sound: dict[int, bool] = {}
        self.pairs: dict[int, bool] = {}

    def merged(self, word: bytes) -> list[int]:
        """Plain byte-pair merging, by an agenda of pairs; used to see whether a token is its own encoding."""
        token = [self.id[word[k : k + 1]] for k in range(len(word))]
        after, before = list(range(1, len(word) + 1)), list(range(-1, len(word) - 1))
        agenda = [(self.rank[p], k) for k, p in enumerate(zip(token, token[1:])) if p in self.rank]
        heapq.heapify(agenda)
        while agenda:
            rank, k = heapq.heappop(agenda)
            n = after[k] if token[k] >= 0 else len(word)
            if n >= len(word) or self.rank.get((token[k], token[n])) != rank:
                continue
            token[k], token[n], after[k] = self.merge[token[k], token[n]][1], -1, after[n]
            if after[k] < len(word):
                before[after[k]] = k
                if (r := self.rank.get((token[k], token[after[k]]))) is not None:
                    heapq.heappush(agenda, (r, k))
            if before[k] >= 0 and (r := self.rank.get((token[before[k]], token[k]))) is not None:
                heapq.heappush(agenda, (r, before[k]))
        return [t for t in token if t >= 0]

    def own(self, token: int) -> bool:
        """Whether the token's bytes are encoded as this token."""
        found = self.sound.get(token)
        if found is None:
            found = self.sound[token] = self.merged(self.bytes[token]) == [token]
        return found

    def edge(self, token: int, side: int) -> list[tuple[int, int]]:
        """The tokens at an edge (0: left, 1: right) while the token is made, smallest first, each with the rank that ends it."""
        found = self.edges.get((token, side))
        if found is None:
            found, at, ends = [(token, NEVER)], token, NEVER
            while at in self.made:
                ends, at = self.made[at][2], self.made[at][side]
                found.append((at, ends))
            found.reverse()
            self.edges[token, side] = found
        return found

    def neighbours(self, left: int, right: int) -> bool:
        """Whether merging the bytes of both leaves them as these two tokens."""
        lefts, rights = self.edge(left, 1), self.edge(right, 0)
        i = j = 0
        while True:
            (a, a_ends), (b, b_ends) = lefts[i], rights[j]
            over = self.rank.get((a, b), NEVER)
            if over < a_ends and over <= b_ends and over < NEVER:
                return False
            if a_ends == b_ends == NEVER:
                return True
            if a_ends <= b_ends:
                i += 1
            else:
                j += 1

    def encode_words(self, words: Iterable[bytes]) -> Iterator[tuple[bytes, list[int]]]:
        """Each distinct word with its tokens, trie by trie; words that begin alike stand in one trie."""
        words, collecting = sorted(set(words)), gc.isenabled()
        for at in range(0, len(words), TRIE):
            gc.disable()  # a trie has no cycles, only many small parts
            try:
                found = list(self._walk(words[at : at + TRIE]))
            finally:
                if collecting:
                    gc.enable()
            yield from found

    def _walk(self, words: list[bytes]) -> Iterator[tuple[bytes, list[int]]]:
        root: dict = {}
        for word in words:
            node = root
            for b in word:
                child = node.get(b)
                if child is None:
                    child = node[b] = {}
                node = child
            node[-1] = word
        ending, pairs, own = self.tails.get, self.pairs, self.own
        if len(pairs) > PAIRS:
            pairs.clear()
        # states along the path: the last token of each prefix's encoding, and where it begins
        last, begins = [-1], [0]
        stack = [(root, b"")]
        while stack:
            node, prefix = stack.pop()
            n = len(prefix)
            if n:
                del last[n:], begins[n:]
                j = n
                while j:
                    j -= 1
                    token = ending(prefix[j:])
                    if token is None:
                        break
                    if token < 0:
                        continue
                    if j:
                        key = last[j] << 32 | token
                        fits = pairs.get(key)
                        if fits is None:
                            fits = pairs[key] = own(token) and self.neighbours(last[j], token)
                    else:
                        fits = own(token)
                    if fits:
                        last.append(token)
                        begins.append(j)
                        break
            for b, child in node.items():
                if b < 0:
                    tokens, k = [], n
                    while k:
                        tokens.append(last[k])
                        k = begins[k]
                    tokens.reverse()
                    yield child, tokens
                else:
                    stack.append((child, prefix + bytes((b,))))

    def decode(self, ids: Iterable[int]) -> str:
        """The text of ids, special tokens as their names; bytes that are no UTF-8 become U+FFFD."""
        return b"".join(map(self.bytes.__getitem__, ids)).decode("utf-8", "replace")


class Encoder:
    """Texts to ids, with the tokens of words remembered."""

    def __init__(self, path: str):
        self.vocabulary = Vocabulary(path)
        special = sorted(self.vocabulary.special, key=len, reverse=True)
        self.special = regex.compile("|".join(map(regex.escape, special))) if special else None
        self.known: dict[str, bytes] = {}

    @staticmethod
    def words(text: str) -> list[str]:
        if text.isascii():
            return ASCII.findall(text)
        return (WORDS_WITH_LATER if HAS_LATER.search(text) else WORDS).findall(text)

    def parts(self, text: str) -> Iterator[tuple[str, str]]:
        """Pieces of ordinary text, each with the special token that follows it."""
        at = 0
        for found in self.special.finditer(text) if self.special else ():
            yield text[at : found.start()], found[0]
            at = found.end()
        yield text[at:], ""

    def learn(self, words: set[str]) -> None:
        for word, tokens in self.vocabulary.encode_words(w.encode() for w in words):
            self.known[word.decode()] = np.array(tokens, "<i4").tobytes()

    def __call__(self, texts: list[str | None]) -> Iterator[bytes]:
        """Ids of each text as little-endian 32-bit bytes; the texts' new words are learned together."""
        cut = [[(self.words(part), name) for part, name in self.parts(text or "")] for text in texts]
        held = {w for parts in cut for words, _ in parts for w in words}
        missing = {w for w in held if w not in self.known}
        if len(self.known) + len(missing) > MEMO:
            self.known, missing = {}, held
        self.learn(missing)
        get = self.known.__getitem__
        for parts in cut:
            yield b"".join(b"".join(map(get, words)) + (np.array([self.vocabulary.special[name]], "<i4").tobytes() if name else b"") for words, name in parts)


@lru_cache(maxsize=1)
def encoder(path: str) -> Encoder:
    """One for a Python worker, which runs many tasks."""
    return Encoder(path)


#: Characters of texts whose words are learned together.
BLOCK = 1 << 21


def blocks(texts: list[str | None]) -> Iterator[list[str | None]]:
    held, size = [], 0
    for text in texts:
        held.append(text)
        size += len(text or "")
        if size >= BLOCK:
            yield held
            held, size = [], 0
    if held:
        yield held


def encode(docs: DataFrame, path: str) -> DataFrame:
    """doc_id, ids (array<int>), and the text that the ids decode to."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode_all = encoder(path)
        for batch in batches:
            texts, at = batch.column(1).to_pylist(), 0
            for block in blocks(texts):
                found = [np.frombuffer(b, "<i4") for b in encode_all(block)]
                ends = np.concatenate([[0], np.cumsum([len(ids) for ids in found])]).astype(np.int32)
                ids = pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate(found)))
                decoded = pa.array([encode_all.vocabulary.decode(x.tolist()) for x in found], pa.string())
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(at, len(block)), ids, decoded], ["doc_id", "ids", "decoded"])
                at += len(block)

    return to_python(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")).mapInArrow(run, "doc_id long, ids array<int>, decoded string")


def decode(encoded: DataFrame, path: str) -> DataFrame:
    """doc_id and text of doc_id and ids; null ids have no text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocabulary = encoder(path).vocabulary
        for batch in batches:
            texts = [None if ids is None else vocabulary.decode(ids) for ids in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.string())], ["doc_id", "text"])

    return to_python(encoded.select(F.col("doc_id").cast("long").alias("doc_id"), "ids")).mapInArrow(run, "doc_id long, text string")


def model_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def op12_trie_bpe(spark, sf_dir: str) -> DataFrame:
    """Every document's number of tokens, and digests of its ids and of the text that they decode to."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    ids = F.array_join(F.col("ids").cast("array<string>"), ",")
    return encode(docs, model_path()).select(
        "doc_id", F.size("ids").cast("long").alias("n_tokens"), F.sha2(ids.cast("binary"), 256).alias("ids_sha256"), F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256")
    )
