"""Toxicity by a weighted lexicon, matched by an Aho-Corasick automaton over folded text.

Folding maps look-alike letters of other scripts, accents, digits and signs to Latin letters, and l to i, alike in
lexicon and text. The lexicon is learned: words and word beginnings (stems) that stand in toxic training texts and
hardly ever in others, picked greedily so that each new entry explains texts that the earlier ones don't; its weight is
its log odds. Exception phrases are an entry with its neighbour as training texts that are not toxic hold them: a match
inside one counts nothing. The matched weight, in total and per word, gives the score by a logistic curve.

The fit reads a bounded number of labelled training rows, chosen by a hash of the id, and of a rare kind the first ones by
that hash; texts stay on the executors, and the driver gets terms, phrases and sums of them. Scoring reads every text whole.

Cases: a null or empty text matches nothing and gets the score of a text without matches; duplicate rows and labels are
scored alike (of several labels of an id the largest holds, and any but 0 is toxic); texts of one id are each a row of the
fit; without both kinds of training rows the score is constant; entries of equal worth go by their spelling; texts of any
length are matched whole; a null id is held out of no fold and has no label; an empty table gives an empty one; other columns
play no part, whatever they are called.
"""

from __future__ import annotations

import bisect
import heapq
import math
import re
import unicodedata
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import discard, durable, remainder, to_python

#: Labelled rows that the fit may read; and of each kind so many at least, where there are so many.
MAX_LABELLED, LEAST_OF_A_KIND = 20_000, 1_000
STEMS = (4, 5, 6, 7)
FOLDS = 5
#: Entries of the lexicon that a toxic training text is explained by, at most.
COVER = 8

#: Letters that look like Latin ones, and signs and digits written for letters.
LOOKALIKES = dict(zip("авеіјкмнорсԁѕтухԛԝɡαβεικνορτυχγω", "abeijkmhopcdstyxqwgabeikvoptyxyw"))
SUBSTITUTES = dict(zip("0134578@$!|+", "oieastbasiit"))


def folding() -> dict[int, str]:
    table = {}
    for code in range(0xC0, 0x250):
        base = unicodedata.normalize("NFD", chr(code))[0]
        if base.isascii():
            table[code] = base.lower()
    for c, to in LOOKALIKES.items():
        table[ord(c)] = table[ord(c.upper())] = to
    table |= {ord(c): to for c, to in SUBSTITUTES.items()}
    table |= {ord("l"): "i", ord("L"): "i"}
    table |= {c: chr(c + 32) for c in range(65, 91) if chr(c) != "L"}
    return table


FOLD = folding()
#: Zero-width and joining characters go; so do marks inside words.
INVISIBLE = re.compile("[​-‍⁠﻿­̀-ͯ]+")
NOT_LETTER = re.compile(r"[\W_]+")


def folded(text: str | None) -> str:
    """Folded words, one space before, between and after them."""
    if not text:
        return " "
    if not text.isascii():
        text = INVISIBLE.sub("", text)
    return f" {NOT_LETTER.sub(' ', text.translate(FOLD)).strip()} "


class Lexicon:
    """Entries (a word with a space on both sides, or a stem with one before it) with weights, and exceptions."""

    def __init__(self, weights: dict[str, float], exceptions: list[str] = (), curve: tuple[float, float, float] = (0.0, 0.0, 0.0)):
        self.weights, self.exceptions, self.curve = weights, list(exceptions), curve
        self._automaton = None

    def __getstate__(self):
        return self.weights, self.exceptions, self.curve

    def __setstate__(self, state):
        self.__init__(*state)

    def automaton(self):
        import ahocorasick

        if self._automaton is None:
            self._automaton = a = ahocorasick.Automaton()
            for entry, weight in self.weights.items():
                a.add_word(entry, (len(entry), weight))
            for phrase in self.exceptions:
                a.add_word(phrase, (len(phrase), None))
            if len(a):
                a.make_automaton()
        return self._automaton

    def matches(self, text: str) -> list[tuple[int, int, float]]:
        """(start, end, weight) in a folded text; the heaviest entry at a place counts, and none inside an exception."""
        a = self.automaton()
        if not len(a):
            return []
        best: dict[int, tuple[int, float]] = {}
        spared: list[tuple[int, int]] = []
        for end, (length, weight) in a.iter(text):
            start = end + 1 - length
            if weight is None:
                spared.append((start, end + 1))
            elif start not in best or best[start][1] < weight:
                best[start] = (end + 1, weight)
        if not spared:
            return [(s, e, w) for s, (e, w) in best.items()]
        # a match is inside an exception if one that begins no later reaches its end
        spared.sort()
        starts, reach, furthest = [x for x, _ in spared], [], 0
        for _, y in spared:
            furthest = max(furthest, y)
            reach.append(furthest)
        inside = lambda s, e: (k := bisect.bisect_right(starts, s)) and reach[k - 1] >= e - 1
        return [(s, e, w) for s, (e, w) in best.items() if not inside(s, e)]

    def measures(self, text: str | None) -> tuple[float, float, int]:
        """Total weight, weight per hundred words, and number of matches."""
        text = folded(text)
        found = self.matches(text)
        total = sum(w for _, _, w in found)
        return total, 100.0 * total / max(1, text.count(" ") - 1), len(found)

    def score(self, total: float, density: float) -> float:
        a, b, c = self.curve
        return 1.0 / (1.0 + math.exp(-max(-40.0, min(40.0, a + b * math.log1p(total) + c * math.log1p(density)))))


def labelled(docs: DataFrame, labels: DataFrame, most: int = MAX_LABELLED, least: int = LEAST_OF_A_KIND) -> DataFrame:
    """doc_id, text, toxic of a bounded number of training rows, the first by a hash of the id."""
    known = labels.where(F.col("toxic").isNotNull() & (F.coalesce(remainder(F.col("doc_id"), FOLDS), F.lit(0)) != 0))
    known = known.groupBy("doc_id").agg(F.max((F.col("toxic") != 0).cast("int")).alias("toxic"))
    first = lambda df, n: df.orderBy(F.xxhash64("doc_id"), "doc_id").limit(n)
    chosen = first(known, most).unionByName(first(known.where("toxic = 1"), least)).unionByName(first(known.where("toxic = 0"), least)).distinct()
    # `most` + 2 `least` rows of two numbers at most
    return docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id")


def terms(text: str | None) -> set[str]:
    """Candidate entries of a text: its folded words, and the stems of the longer ones."""
    found = set()
    for w in set(folded(text).split()):
        if len(w) >= 3:
            found.add(f" {w} ")
        found.update(f" {w[:k]}" for k in STEMS if len(w) > k)
    return found


def learn(docs: DataFrame, labels: DataFrame, most: int = MAX_LABELLED) -> Lexicon:
    sample = durable(labelled(docs, labels, most), "labelled")
    kinds = {r["toxic"]: r["count"] for r in sample.groupBy("toxic").count().collect()}
    toxic, clean = kinds.get(1, 0), kinds.get(0, 0)
    if not toxic or not clean:
        return Lexicon({}, (), (40.0 if toxic else -40.0, 0.0, 0.0) if toxic or clean else (-1.0, 0.0, 0.0))

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count: dict[str, list[int]] = {}
        for batch in batches:
            for text, y in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                for t in terms(text):
                    count.setdefault(t, [0, 0])[y] += 1
            if len(count) > 200_000:
                yield pa.RecordBatch.from_arrays([pa.array(list(count), pa.string()),
                    *(pa.array([c[k] for c in count.values()], pa.int64()) for k in (0, 1))], ["term", "clean", "toxic"])
                count = {}
        yield pa.RecordBatch.from_arrays([pa.array(list(count), pa.string()),
            *(pa.array([c[k] for c in count.values()], pa.int64()) for k in (0, 1))], ["term", "clean", "toxic"])

    odds = F.log((F.col("toxic") + 0.1) / (toxic + 0.2)) - F.log((F.col("clean") + 0.1) / (clean + 0.2))
    least = max(3, min(8, toxic // 50))
    counts = to_python(sample.select("text", "toxic")).mapInArrow(counted,
        "term string, clean long, toxic long").groupBy("term").agg(F.sum("clean").alias("clean"), F.sum("toxic").alias("toxic"))
    good = counts.where((F.col("toxic") >= least) & (F.col("clean") <= F.when(F.col("term").endswith(" "),
        0.25).otherwise(0.05) * F.col("toxic"))).select("term", "clean", "toxic", odds.alias("odds"))
    candidates = {r["term"]: float(r["odds"]) for r in good.collect()}

    # Greedy cover of the toxic texts, each by up to COVER entries. Copies of one text count once, so that its ordinary words
    # aren't taken for toxic ones.
    def terms_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(0).to_pylist()
            held = [[x for x in terms(text) if x in candidates] for text in texts]
            yield pa.RecordBatch.from_arrays([pa.array([_trait(text) for text in texts], pa.int64()), pa.array(held, pa.list_(pa.string()))], ["trait", "held"])

    kinds_of, where = [], {}
    for i, r in enumerate(to_python(sample.where("toxic = 1").select("text")).mapInArrow(terms_of, "trait long, held array<string>").toLocalIterator()):
        kinds_of.append(r["trait"])
        for x in r["held"]:
            where.setdefault(x, []).append(i)
    where = {x: d for x, d in where.items() if len({kinds_of[i] for i in d}) >= least}
    need = [COVER] * len(kinds_of)
    chosen: list[str] = []
    taken: set[str] = set()
    heap = [(-len(d), -len(x), x) for x, d in where.items()]
    heapq.heapify(heap)
    while heap:
        last, _, x = heapq.heappop(heap)
        fresh = sum(need[i] > 0 for i in where[x])
        if fresh < least or any(x[:k] in taken for k in range(2, len(x))) or x in taken:
            continue
        if fresh < -last:
            heapq.heappush(heap, (-fresh, -len(x), x))
            continue
        chosen.append(x)
        # neither a stem of a chosen entry nor a longer form of a chosen stem adds anything
        taken.update([x] if not x.endswith(" ") else [])
        taken.update(y for k in STEMS if (y := x[: k + 1]) in where and len(where[y]) == len(where[x]))
        for i in where[x]:
            need[i] -= 1
    weights = {x: candidates[x] for x in chosen}

    plain = Lexicon(weights)
    seen = to_python(sample.select("text", "toxic")).mapInArrow(lambda batches: _phrases(plain, batches), "phrase string, toxic long")
    seen = seen.groupBy("phrase").agg(F.count("*").alias("n"), F.sum("toxic").alias("toxic")).where("n >= 2 and toxic = 0")
    lexicon = Lexicon(weights, sorted(r["phrase"] for r in seen.collect()))

    def measured(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [lexicon.measures(text)[:2] for text in batch.column(0).to_pylist()]
            yield pa.RecordBatch.from_arrays([*(pa.array([f[k] for f in found], pa.float64()) for k in (0, 1)), batch.column(1)], ["total", "density", "toxic"])

    rows = to_python(sample.select("text", F.col("toxic").cast("long"))).mapInArrow(measured, "total double, density double, toxic long").collect()
    lexicon.curve = _logistic(np.array(sorted(tuple(r) for r in rows), float))
    discard(sample)
    return lexicon


def _phrases(lexicon: Lexicon, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Entries with a neighbour, and whether the text is toxic."""
    for batch in batches:
        phrases, toxic = [], []
        for text, y in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            text = folded(text)
            for s, _, _ in lexicon.matches(text):
                word_end = text.find(" ", s + 1)
                before, after = text.rfind(" ", 0, s), text.find(" ", word_end + 1)
                for phrase in (text[before : word_end + 1] if before >= 0 else "", text[s : after + 1] if after >= 0 else ""):
                    if phrase:
                        phrases.append(phrase)
                        toxic.append(y)
        yield pa.RecordBatch.from_arrays([pa.array(phrases, pa.string()), pa.array(toxic, pa.int64())], ["phrase", "toxic"])


def _trait(text: str | None) -> int:
    """The least hash of a text's word triples: near copies mostly share it."""
    w = folded(text).split()
    return min((zlib.crc32(" ".join(w[i : i + 3]).encode()) for i in range(max(1, len(w) - 2))), default=0)


def _logistic(rows: np.ndarray) -> tuple[float, float, float]:
    """Coefficients by Newton steps with a small ridge; both kinds weigh the same."""
    x = np.column_stack([np.ones(len(rows)), np.log1p(rows[:, 0]), np.log1p(rows[:, 1])])
    y = rows[:, 2]
    weight = np.where(y == 1, 0.5 / max(1, y.sum()), 0.5 / max(1, (1 - y).sum())) * len(rows)
    beta = np.zeros(3)
    for _ in range(30):
        p = 1 / (1 + np.exp(-np.clip(x @ beta, -30, 30)))
        w = weight * p * (1 - p)
        ridge = np.diag([1e-3, 0.1, 0.1])
        beta += np.linalg.solve((x * w[:, None]).T @ x + ridge, x.T @ (weight * (y - p)) - ridge @ beta)
    return tuple(float(b) for b in beta)


def score(docs: DataFrame, lexicon: Lexicon) -> DataFrame:
    """doc_id, score, matched weight and matches of each text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [lexicon.measures(t) for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array([lexicon.score(t, d) for t, d, _ in found], pa.float64()),
                    pa.array([t for t, _, _ in found], pa.float64()), pa.array([n for _, _, n in found], pa.int64())],
                ["doc_id", "score", "weight", "matches"],
            )

    return to_python(docs.select(F.col("doc_id").cast("long"), "text")).mapInArrow(run, "doc_id long, score double, weight double, matches long")


def op7_toxicity(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    lexicon = learn(docs, spark.read.parquet(f"{sf_dir}/labels.parquet").select("doc_id", "toxic"))
    return score(docs, lexicon).select("doc_id", F.coalesce(remainder(F.col("doc_id"), FOLDS) == 0, F.lit(False)).alias("held_out"), "score",
        (F.col("score") >= 0.5).cast("int").alias("predicted"), "weight", "matches")
