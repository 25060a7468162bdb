import hashlib
from collections import defaultdict

import numpy as np
import pytest

from tessera.llm import ngram_join, substring
from tessera.llm.fmindex import FMIndex, WaveletMatrix
from tests.llm import brute


@pytest.mark.parametrize("block", [384, 3])
def test_near_duplicates(docs, rows, block):
    want = brute.near([(r[0], r[1]) for r in rows])
    got = {r["doc_id"]: (r["class_id"], r["n_links"]) for r in ngram_join.classes(docs, block=block).collect()}
    assert got == want


def test_near_duplicates_of_one_large_group(spark):
    import random

    rnd = random.Random(5)
    base = [f"w{k}" for k in range(120)]
    texts = []
    for _ in range(150):
        w = list(base)
        for _ in range(rnd.randint(0, 3)):
            w[rnd.randrange(len(w))] = f"z{rnd.random()}"
        texts.append(" ".join(w))
    rows = list(enumerate(texts))
    got = {r["doc_id"]: (r["class_id"], r["n_links"]) for r in ngram_join.classes(spark.createDataFrame(rows, "doc_id long, text string"), block=16).collect()}
    want = brute.near(rows)
    assert {i: c for i, (c, _) in got.items()} == {i: c for i, (c, _) in want.items()}
    assert sum(n for _, n in got.values()) >= 0.995 * sum(n for _, n in want.values())
    assert all(got[i][1] <= want[i][1] for i in got)


def test_near_duplicates_of_nothing(empty):
    assert ngram_join.classes(empty).count() == 0


def test_bands_reach_the_recall():
    bands, rows = ngram_join.bands_and_rows()
    assert bands * rows <= ngram_join.MOST_HASHES and 1 - (1 - 0.8**rows) ** bands >= ngram_join.RECALL


def test_verify_both_ways():
    rng = np.random.default_rng(4)
    sets = [np.unique(rng.integers(0, 60, 40).astype(np.uint64)) for _ in range(20)]
    left, right = np.triu_indices(20, 1)
    lengths = np.array([len(s) for s in sets])
    flat = np.concatenate(sets)
    many = ngram_join.verify(lengths, flat, left, right, 0.5)
    few = np.concatenate([ngram_join.verify(lengths, flat, left[k : k + 5], right[k : k + 5], 0.5) for k in range(0, len(left), 5)])
    want = [len(set(sets[a]) & set(sets[b])) >= 0.5 * len(set(sets[a]) | set(sets[b])) for a, b in zip(left, right)]
    assert many.tolist() == few.tolist() == want


def test_components(spark):
    edges = [(i, i + 1) for i in range(0, 40)] + [(100, 102), (102, 101), (200, 201)]
    got = {r["node"]: r["root"] for r in ngram_join.components(spark.createDataFrame(edges, "u long, v long")).collect()}
    assert all(got[i] == 0 for i in range(1, 41)) and got[101] == got[102] == 100 and got[201] == 200


@pytest.mark.parametrize("hot", [None, 1])
def test_substring(docs, rows, hot, monkeypatch):
    want = brute.substring([(r[0], r[1]) for r in rows])
    got = substring.dedup(docs, with_text=True, hot=hot or substring.HOT).collect()
    assert len(got) == len(rows)
    for r in got:
        n, gone, kept = want[r["doc_id"]]
        assert (r["n_words"], r["n_removed"], r["kept_text"]) == (n, gone, " ".join(kept))
        assert r["kept_sha256"] == hashlib.sha256(" ".join(kept).encode()).hexdigest()


def test_substring_stage(spark, docs, rows, empty):
    out = substring.stage(spark, docs, "")
    assert out.columns == docs.columns and out.count() == len(rows)
    want = brute.substring([(r[0], r[1]) for r in rows])
    for r in out.collect():
        n, gone, kept = want[r["doc_id"]]
        assert r["text"] == (" ".join(kept) if gone else rows[r["doc_id"]][1])
    assert substring.dedup(empty).count() == 0


def test_fm_index_counts():
    rng = np.random.default_rng(6)
    strings = [rng.integers(1, 5, rng.integers(1, 30)) for _ in range(40)]
    text = np.concatenate([np.append(s, 0) for s in strings])
    index = FMIndex(text)
    where = defaultdict(int)
    for s in strings:
        for i in range(len(s)):
            for k in range(1, 7):
                if i + k <= len(s):
                    where[tuple(s[i : i + k])] += 1
    ends = np.flatnonzero(text > 0) + 1
    length, low, high = index.statistics(text, ends, 4)
    for e, n, lo, hi in zip(ends, length, low, high):
        longest = 0
        for k in range(1, 5):
            piece = text[max(0, e - k) : e]
            if len(piece) == k and (piece > 0).all() and where[tuple(piece)] > 1:
                longest = k
            else:
                break
        assert n == longest
        if n == 4:
            assert hi - lo == where[tuple(text[e - 4 : e])]


def test_wavelet_ranks():
    values = np.random.default_rng(7).integers(0, 37, 500)
    w = WaveletMatrix(values, 6)
    for c in range(37):
        at = np.arange(501)
        landed = w.descend(np.full(501, c), at) - w.descend(np.array([c]), np.array([0]))
        assert landed.tolist() == [int((values[:i] == c).sum()) for i in at]
