"""Operators against versions written on their own: an agenda, a matcher, trees from the model's dump; empty and odd tables."""

import math
import random
import re
from hashlib import blake2b

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessera.llm import bytebpe, exact, negatives, ngram_join, packing, quality, shard, substring, subword, toxicity, urlfilter, whitening
from tests.llm.conftest import SCHEMA

MASK = (1 << 64) - 1


def mix(x):
    x = (x ^ x >> 30) * 0xBF58476D1CE4E5B9 & MASK
    x = (x ^ x >> 27) * 0x94D049BB133111EB & MASK
    return x ^ x >> 31


class Agenda:
    """Merge-dropout over the library's own pieces: the best pair first, leftmost of equals, skipped by the keyed hash."""

    def __init__(self, rate, seed):
        import sentencepiece

        m = sentencepiece.SentencePieceProcessor(model_file=subword.model_path())
        self.size, self.rate, self.seed = m.vocab_size(), rate, seed
        usable = [i for i in range(self.size) if not (m.is_control(i) or m.is_unknown(i) or m.is_byte(i) or m.is_unused(i))]
        self.id = {m.id_to_piece(i): i for i in usable}
        self.score = {m.id_to_piece(i): m.get_score(i) for i in usable}
        self.byte = {int(m.id_to_piece(i)[3:5], 16): i for i in range(self.size) if m.is_byte(i)}

    def encode(self, doc_id, text):
        if text is None:
            return None
        own = int.from_bytes(blake2b(f"{self.seed}:{doc_id}".encode(), digest_size=8).digest(), "little")
        out, position = [], 0
        for k, part in enumerate(text.split("▁") if text else ()):
            if k:
                out += [self.byte[b] for b in "▁".encode()]
            if part or not k:
                for piece in re.findall("▁*[^▁\n]+|▁+|\n", ("▁" if not k else "") + part.replace(" ", "▁")):
                    out += self.segment(piece, mix(own + position * 0x9E3779B97F4A7C15 & MASK))
                    position += 1
        return out

    def segment(self, text, occurrence):
        sums = sum(mix(ord(c) + (k << 32) * 0x9E3779B97F4A7C15 & MASK) for k, c in enumerate(text)) & MASK
        key = mix(sums + ((self.seed & 0xFFFFFFFF) << 32) + occurrence & MASK)
        pieces = [(k, c) for k, c in enumerate(text)]
        while True:
            best = None
            for n, ((at, left), (_, right)) in enumerate(zip(pieces, pieces[1:])):
                if left in self.id and right in self.id and left + right in self.id:
                    point = mix((self.id[left] * self.size + self.id[right]) * 0xD6E8FEB86659FD93 + at & MASK)
                    if mix(key ^ point) < int(self.rate * (2**64 - 1)):
                        continue
                    if best is None or self.score[left + right] > best[0]:
                        best = (self.score[left + right], n)
            if best is None:
                return [i for _, p in pieces for i in ([self.id[p]] if p in self.id else [self.byte[b] for b in p.encode()])]
            n = best[1]
            pieces[n : n + 2] = [(pieces[n][0], pieces[n][1] + pieces[n + 1][1])]


@pytest.mark.parametrize("rate,seed", [(0.1, 20_260), (0.5, 3)])
def test_dropout_equals_an_agenda_of_its_own(rows, rate, seed):
    plain, encoder = Agenda(rate, seed), subword.Encoder(subword.Merges(subword.model_path()), rate, seed)
    some = [r for r in rows if r[1] is None or len(r[1]) < 900]
    got = list(encoder([r[0] for r in some], [r[1] for r in some]))
    for r, ids in zip(some, got):
        assert (None if ids is None else np.frombuffer(ids, "<u4").tolist()) == plain.encode(r[0], r[1]), r
    without = list(subword.Encoder(subword.Merges(subword.model_path()), 0.0, seed)([r[0] for r in some], [r[1] for r in some]))
    assert sum(a != b for a, b in zip(got, without)) > len(some) / 3


def test_matches_equal_a_search_for_each_entry():
    rnd = random.Random(2)
    words = ["ab", "aba", "bab", "abab", "c", "cab", "bac"]
    for _ in range(400):
        text = toxicity.folded(" ".join(rnd.choice(words) for _ in range(rnd.randrange(0, 25))))
        weights = {rnd.choice([f" {w} ", f" {w}"]): float(rnd.randrange(1, 9)) for w in rnd.sample(words, 4)}
        phrases = [f" {rnd.choice(words)} {rnd.choice(words)} " for _ in range(2)]
        places = lambda x: [k for k in range(len(text)) if text.startswith(x, k)]  # noqa: B023, E731
        best = {}
        for entry, weight in weights.items():
            for k in places(entry):
                if k not in best or best[k][1] < weight:
                    best[k] = (k + len(entry), weight)
        spared = [(k, k + len(p)) for p in phrases for k in places(p)]
        want = {(k, w) for k, (end, w) in best.items() if not any(x <= k and y >= end - 1 for x, y in spared)}
        got = toxicity.Lexicon(weights, phrases).matches(text)
        ties = {k for k in best if sum(text.startswith(e, k) and w == best[k][1] for e, w in weights.items()) > 1}
        assert {(s, w) for s, _, w in got if s not in ties} == {(s, w) for s, w in want if s not in ties}


def test_scores_equal_the_trees_of_the_models_dump(spark):
    rnd = random.Random(5)
    hosts = ["".join(rnd.choice("abcdefgh") for _ in range(rnd.randrange(3, 14))) for _ in range(50)]
    urls = [f"http://{rnd.choice(['www.', ''])}{rnd.choice(hosts)}.{rnd.choice(['x.com', 'y.org', 'net'])}/{'d/' * rnd.randrange(4)}{rnd.randrange(999)}?a={rnd.randrange(9)}" for _ in range(500)]
    urls += [f"http://{rnd.choice(hosts)}-casino.x.com/{rnd.randrange(99)}" for _ in range(70)] + [None, "", "no scheme"]
    df = spark.createDataFrame(list(enumerate(urls)), "page_id long, url string")
    rows = urlfilter.featured(df)
    scored, _ = urlfilter.fitted(rows)
    names = [*urlfilter.FEATURES, *(f"suffix_{what}_{k}" for k in urlfilter.LEVELS for what in ("rate", "count"))]

    def tree(lines, depth=0):
        line = lines.pop(0).strip()
        if line.startswith("Predict"):
            return float(line.split()[-1])
        f, op, value = re.match(r"If \(feature (\d+) (<=|>|<|>=) (\S+)\)", line).groups()
        yes = tree(lines)
        assert lines.pop(0).strip().startswith("Else")
        return int(f), float(value), yes, tree(lines)

    def walk(node, x):
        while not isinstance(node, float):
            node = node[2] if x[node[0]] <= node[1] else node[3]
        return node

    trees = [tree(t.toDebugString.strip().splitlines()[1:]) for t in scored.trees.trees]
    for r in scored(rows).collect():
        x = [float(r[n]) for n in names]
        margin = sum(w * walk(t, x) for w, t in zip(scored.trees.treeWeights, trees))
        assert r["score"] == pytest.approx(1 / (1 + math.exp(-2 * margin)), abs=1e-9)
        # the suffix statistics are those of the sample, backed by the shorter suffix
    assert {r["suffix_3"] for r in rows.where("url like 'http://www.%'").collect()} != {r["suffix_2"] for r in rows.collect()}


def test_suffixes_of_short_and_long_hosts(spark):
    urls = ["http://a.b.c.d/", "http://b.c/", "http://c/", "x", None]
    got = urlfilter.featured(spark.createDataFrame(list(enumerate(urls)), "page_id long, url string")).orderBy("page_id").collect()
    assert [(r["suffix_1"], r["suffix_2"], r["suffix_3"]) for r in got] == [("d", "c.d", "b.c.d"), ("c", "b.c", "b.c"), ("c", "c", "c"), ("", "", ""), ("", "", "")]


def test_empty_tables_and_clashing_columns(spark, empty):
    """Every operator on a table without rows, and on one whose other columns have the names that operators use."""
    rows = [(k, f"text of some number {k % 3} and a few words more than ten in all of it", "en", "s", 5) for k in range(12)] + [(None, None, None, None, None)]
    docs = spark.createDataFrame(rows, SCHEMA)
    for name in ("ids", "decoded", "rep", "digest", "keys", "copies", "score", "size", "shard", "curve", "label", "bytes", "g", "own_curve", "of", "r", "x"):
        docs = docs.withColumn(name, docs["doc_id"] * 0)
    none = empty.selectExpr("*", "1 digest", "2 copies")
    path = packing.tokenizer_path()
    made = {
        "near": lambda d: ngram_join.classes(d), "cut": lambda d: substring.dedup(d), "subword": lambda d: subword.encode(d, subword.model_path()), "packed": lambda d: packing.pack_documents(d, path),
        "shards": lambda d: shard.assign(d), "exact": lambda d: exact.dedup(d), "quality": lambda d: quality.verdicts(quality.measures(d)), "bytes": lambda d: bytebpe.encode(d, bytebpe.model_path()),
    }
    for name, f in made.items():
        assert f(none).count() == 0, name
        assert f(docs).count() == len(rows), name
    for stage in (quality.stage, exact.stage, ngram_join.stage, substring.stage):
        out = stage(spark, docs, "")
        assert out.columns == docs.columns and out.count() > 0
    lexicon = toxicity.learn(none, spark.createDataFrame([], "doc_id long, toxic int"))
    assert toxicity.score(none, lexicon).count() == 0 and toxicity.score(docs, lexicon).count() == len(rows)
    pages = spark.createDataFrame([], "page_id long, url string, host int, score int")
    assert urlfilter.judge(pages).count() == 0
    vectors = spark.createDataFrame([], "vec_id long, embedding array<float>, label int, x int")
    assert whitening.whiten(vectors).count() == 0 and negatives.mine(vectors, F.col("vec_id") % 100 == 0).count() == 0
