"""The pruned top-k similarity join against all pairs."""

import io
import math
import random
import re
from collections import Counter
from contextlib import redirect_stdout

import pytest

from tessera.operators import panel
from tessera.operators.similarity import Search

SOURCE = "unit_id int, cluster_id string, stratum string, text string, action string, actions array<string>"


def rows(n=260, seed=1, words=400):
    """Skewed words, topics that some texts share, few and many actions, empty and null texts, copies."""
    rnd = random.Random(seed)
    vocabulary = [f"w{k}" for k in range(words)]
    weights = [1 / (k + 1) for k in range(words)]
    topics = [rnd.sample(vocabulary[30:], 12) for _ in range(12)]
    out = []
    for k in range(n):
        kind = rnd.randrange(12)
        text = " ".join(rnd.choices(vocabulary, weights, k=rnd.randrange(1, 40)) + rnd.choice(topics) * rnd.randrange(3))
        if kind == 0:
            text = rnd.choice(["", None, "zzz", "!!"])
        elif kind == 1 and out:
            text = rnd.choice(out)[3]
        acts = rnd.sample(["go", "look", "take", "a1", "a2", "a3", "a4"], rnd.randrange(1, 6))
        out.append((k, f"c{rnd.randrange(30) if kind else 0}", rnd.choice(["s", "s", "t"]), text, rnd.choice(acts), acts + acts[:1]))
    return out


def plain(sources, targets, k, least, weight):
    bag = lambda t: Counter(re.findall("[a-z0-9]+", (t or "").lower()))
    norm = lambda b: math.sqrt(sum(v * v for v in b.values()))
    bags = {r[0]: bag(r[3]) for r in targets}
    out = {}
    for s in sources:
        mine, found = bag(s[3]), []
        for t in targets:
            if t[2] != s[2] or t[1] == s[1] or (weight < 1 and s[4] not in t[5]):
                continue
            dot = sum(v * bags[t[0]][w] for w, v in mine.items())
            cosine = dot / (norm(mine) * norm(bags[t[0]])) if dot else 0.0
            p, q = set(s[5]) - {s[4]}, set(t[5]) - {s[4]}
            value = cosine if weight == 1 else weight * cosine + (1 - weight) * (len(p & q) / len(p | q) if p | q else 0.0)
            if value >= least:
                found.append((-round(value, 12), t[0]))
        out[s[0]] = sorted(found)
    return out


@pytest.mark.parametrize("weight,least", [(0.5, 0.05), (0.5, 0.0), (1.0, 0.0), (1.0, 0.3), (0.8, 0.6), (0.0, 0.2), (0.2, 0.5)])
def test_equals_all_pairs(spark, weight, least):
    targets = rows()
    sources = [r for r in targets if r[0] % 9 == 0]
    want = plain(sources, targets, 5, least, weight)
    found, few = panel.neighbours(spark.createDataFrame(sources, SOURCE), spark.createDataFrame(targets, SOURCE).drop("action"), 5, 3, least, weight)
    got = {}
    for r in found.orderBy("source_id", "rn").collect():
        got.setdefault(r["source_id"], []).append((r["target_id"], pytest.approx(r["similarity"], abs=1e-9)))
        assert r["eligible"] == min(5, len(want[r["source_id"]]))
    assert got == {s: [(t, -v) for v, t in x[:5]] for s, x in want.items() if len(x) >= 3}
    assert {r["source_id"]: r["eligible"] for r in few.collect()} == {s: len(x) for s, x in want.items() if len(x) < 3}


def test_few_pairs_are_formed(spark):
    """Texts of topics over very common words: nearly all pairs share a token, few are within reach."""
    rnd = random.Random(8)
    topics = [[f"t{k}x{j}" for j in range(10)] for k in range(60)]
    out = []
    for k in range(900):
        words = rnd.choices(["you", "see", "room", "door", "table", "open"], k=6) + rnd.choices(topics[k % 60], k=14)
        out.append((k, f"c{k % 45}", "s", " ".join(words), "go", ["go", "look"]))
    targets, sources = spark.createDataFrame(out, SOURCE), spark.createDataFrame([r for r in out if r[0] % 10 == 0], SOURCE)
    search = Search(sources, targets.drop("action"), 5, 0.05, 0.5)
    formed = search.candidates(search.keep(search.floors(), "floors")).count()
    every = 90 * 900
    assert 90 * 5 <= formed < every / 20
    found, _ = panel.neighbours(sources, targets.drop("action"), 5, 1, 0.05, 0.5)
    want = plain([r for r in out if r[0] % 10 == 0], out, 5, 0.05, 0.5)
    got = {(r["source_id"], r["target_id"]) for r in found.collect()}
    assert got == {(s, t) for s, x in want.items() for _, t in x[:5]}


def test_no_join_on_stratum_and_action_alone(spark):
    targets = spark.createDataFrame(rows(60), SOURCE)
    search = Search(targets, targets.drop("action"), 3, 0.05, 0.5)
    floors = search.keep(search.floors(), "floors")
    for made in (search.candidates(floors), search.by_sets(floors)):
        out = io.StringIO()
        with redirect_stdout(out):
            made.explain()
        keys = re.findall(r"Join \[([^\]]*)\]", out.getvalue())
        assert keys and not any(set(re.sub(r"#\d+", "", k).split(", ")) <= {"stratum", "action"} for k in keys)
        assert "Cartesian" not in out.getvalue() and "NestedLoop" not in out.getvalue()


def test_common_tokens_are_dealt_into_parts(spark, monkeypatch):
    from tessera.operators import similarity

    monkeypatch.setattr(similarity, "PART", 7)
    targets = rows(120, 5)
    want = plain(targets[:20], targets, 4, 0.05, 0.5)
    found, _ = panel.neighbours(spark.createDataFrame(targets[:20], SOURCE), spark.createDataFrame(targets, SOURCE).drop("action"), 4, 1, 0.05, 0.5)
    assert {(r["source_id"], r["target_id"]) for r in found.collect()} == {(s, t) for s, x in want.items() for _, t in x[:4]}


@pytest.mark.parametrize("small", [False, True])
@pytest.mark.parametrize("weight,least", [(0.5, 0.05), (0.5, 0.3), (1.0, 0.0), (1.0, 0.3)])
def test_every_target_at_the_threshold_is_counted(spark, weight, least, small, monkeypatch):
    """Not the first k only; in one block or in many, with few or all tokens in the dense matrix."""
    from tessera.operators import blocks

    if small:
        for name, value in {"ROWS": 13, "BYTES": 900, "WIDE": 4, "DEEP": 3, "DENSE": 6}.items():
            monkeypatch.setattr(blocks, name, value)
    targets = rows(300, 7)
    sources = [r for r in targets if r[0] % 6 == 0]
    want = plain(sources, targets, 5, least, weight)
    assert max(map(len, want.values())) > 30
    found, few = panel.neighbours(spark.createDataFrame(sources, SOURCE), spark.createDataFrame(targets, SOURCE).drop("action"), 5, 3, least, weight, whole_count=True)
    got = {}
    for r in found.orderBy("source_id", "rn").collect():
        got.setdefault(r["source_id"], []).append((r["target_id"], r["eligible"]))
    assert got == {s: [(t, len(x)) for _, t in x[:5]] for s, x in want.items() if len(x) >= 3}
    assert {r["source_id"]: r["eligible"] for r in few.collect()} == {s: len(x) for s, x in want.items() if len(x) < 3}


def test_counts_that_single_precision_cannot_hold():
    import numpy as np
    import pyarrow as pa
    from tessera.operators import blocks

    table = lambda name, ids, clusters, n: pa.table({name: pa.array(ids), "cluster": clusters, "bag": ["a b"] * len(ids), "ns": [np.array(x, "<i4").tobytes() for x in n], "square": [sum(v * v for v in x) for x in n]})
    n, m = [(8191, 4099), (5001, 3)], [(8193, 1), (2, 7)]
    got = blocks.met((), table("source_id", [1, 2], ["x", "y"], n), table("target_id", [5, 6], ["z", None], m), 3, 0.0, 1.0).to_pylist()
    want = {s: sum(p * q for p, q in zip(a, m[0])) / (math.sqrt(sum(v * v for v in a)) * math.sqrt(sum(v * v for v in m[0]))) for s, a in zip((1, 2), n)}
    assert {r["source_id"]: r["similarity"] for r in got if r["target_id"] == 5} == want
    assert [r["n"] for r in got if r["target_id"] is None] == [1, 1] and len(got) == 4
