"""The language model against a plain version: dictionaries, one restaurant at a time, the same hashed random numbers."""

import math
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
import xxhash
from tests.llm import brute

from tessera.llm import pitman_yor as py

D, S = py.DISCOUNT, py.STRENGTH


def lowered(text):
    return [w.encode().lower().decode() for w in brute.words(text)] + [""]


def stirling(count):
    """S(count, t) for t = 0..count by their recursion."""
    row = [1.0]
    for c in range(count):
        row = [(row[t - 1] if t else 0) + ((c - D * t) * row[t] if t <= c else 0) for t in range(c + 2)]
    return row


def tables(count, r, x):
    weights = [r**t * s for t, s in enumerate(stirling(count))]
    total, at = sum(weights), 0.0
    for t, w in enumerate(weights):
        at += w
        if t and at >= x * total:
            return t
    return count


class Plain:
    """The model over texts; probability(u, v, w) is None-safe for unknown words (number 0 stands for the beginning)."""

    def __init__(self, rows, room):
        texts = {k: lowered(t) for k, (i, t, *_) in enumerate(rows)}
        train = {k for k, (i, *_) in enumerate(rows) if i is None or zlib.crc32(str(i).encode()) % 10}
        seen = Counter(w for k in train for w in texts[k])
        vocabulary = sorted({w.encode() for t in texts.values() for w in t}, key=lambda w: (-seen[w.decode()].bit_length(), xxhash.xxh64_intdigest(w), w))
        self.number = {w.decode(): k + 1 for k, w in enumerate(vocabulary)}
        self.count = Counter(self.number[w] for k in train for w in texts[k])
        self.count[0] = len(train)
        self.n, self.v = sum(self.count.values()) - len(train), sum(c > 0 for w, c in self.count.items() if w)
        self.room, self.parts, self.rooms = room, {}, {}
        triples = Counter()
        for k in train:
            w = [0, 0, *(self.number[x] for x in texts[k])]
            triples.update(zip(w, w[1:], w[2:]))
        self.samples = self.sample(triples)
        self.after = Counter()
        for (u, v, _), c in triples.items():
            self.after[u, v] += c

    def bits(self, v):
        return int(np.ceil(np.log2(max(1, self.count[v] / self.room))))

    def of(self, v, w):
        bits = self.bits(v)
        if bits and (w, bits) not in self.rooms:
            self.rooms[w, bits] = int(py.room_of(np.array([w]), np.array([bits]))[0])
        return self.rooms[w, bits] if bits else 0

    def part(self, root, v, w):
        key = id(root[0]), self.bits(v), self.of(v, w)
        if key not in self.parts:
            words = [x for x in self.count if x and self.count[x] and self.of(v, x) == key[2]]
            self.parts[key] = (sum(root[0][x] + py.ROOT for x in words) + py.ROOT) / root[1]
        return self.parts[key]

    def base(self, root, v, w):
        return (root[0][w] + py.ROOT) / root[1] / self.part(root, v, w)

    def sample(self, triples):
        root = (self.count, self.n + py.ROOT * (self.v + 1))
        pair = lambda u, v, w: (u, v, self.of(v, w))
        t3 = {x: 1 for x in triples}
        c2 = Counter((v, w) for _, v, w in triples)
        t2 = {x: 1 for x in c2}
        here = Counter()
        for (_, v, w), c in triples.items():
            here[v, self.of(v, w)] += c
        self.share = lambda v, room: (here[v, room] + 0.5 ** self.bits(v)) / (self.count[v] + 1)
        base = {x: self.base(root, *x) for x in c2}
        out = []
        for sweep in range(py.BURN_IN + py.SAMPLES):
            state = self.state(t3, c2, t2, pair)
            fresh2 = state["fresh2"]
            new = {}
            for x, c in triples.items():
                r = state["fresh3"](*pair(*x)) * self.parent(state, base[x[1:]], *x[1:])
                new[x] = tables(c, r, py.uniform(3, sweep, *(np.array([x[k]]) for k in (1, 0, 2)))[0]) if c > 1 else 1
            t3 = new
            c2 = Counter()
            for x, t in t3.items():
                c2[x[1:]] += t
            t2 = {x: tables(c, fresh2(x[0], self.of(*x)) * base[x], py.uniform(2, sweep, *map(lambda k: np.array([k]), x))[0]) if c > 1 else 1 for x, c in c2.items()}
            if sweep >= py.BURN_IN:
                customers = Counter()
                for (_, w), t in t2.items():
                    customers[w] += t
                out.append((self.state(t3, c2, t2, pair), (customers, sum(customers.values()) + py.ROOT * (self.v + 1)), triples))
        return out

    def state(self, t3, c2, t2, pair):
        at3, at2, in2 = Counter(), Counter(), Counter()
        for x, t in t3.items():
            at3[pair(*x)] += t
        for (v, w), t in t2.items():
            at2[v, self.of(v, w)] += t
            in2[v, self.of(v, w)] += c2[v, w]
        return {
            "t3": dict(t3), "t2": dict(t2), "c2": c2, "in2": in2, "fresh2": lambda v, room: S + D * at2[v, room],
            "fresh3": lambda u, v, room: S * self.share(v, room) + D * at3[u, v, room],
        }

    def parent(self, s, base, v, w):
        room = self.of(v, w)
        return (s["c2"][v, w] - D * s["t2"].get((v, w), 0) + s["fresh2"](v, room) * base) / (s["in2"][v, room] + S)

    def probability(self, u, v, w):
        """Means over samples of what the two lower levels say, of what they leave to the root, and of the root."""
        own = left = base = 0.0
        room, n = self.of(v, w), len(self.samples)
        for s, root, triples in self.samples:
            fresh = s["fresh3"](u, v, room)
            own += (triples[u, v, w] - D * s["t3"].get((u, v, w), 0) + fresh * self.parent(s, 0.0, v, w)) / n
            left += fresh * s["fresh2"](v, room) / (s["in2"][v, room] + S) / n
            base += self.base(root, v, w) / n
        return (own + left * base) / (self.after[u, v] + S)

    def score(self, text):
        w = [0, 0, *(self.number[x] for x in lowered(text))]
        return sum(math.log10(self.probability(*x)) for x in zip(w, w[1:], w[2:]))


@pytest.mark.parametrize("room", [py.ROOM, 40])
def test_scores_equal_the_plain_version(docs, rows, room):
    plain = Plain(rows, room)
    got = {r["doc_id"]: r for r in py.score(docs, room=room).collect()}
    assert len(got) == len(rows)
    for i, text, *_ in rows:
        t, r = lowered(text), got[i]
        numbers = [plain.number[w] for w in t]
        base = sum(math.log10((plain.count[w] + 0.1) / (plain.n + 0.1 * (plain.v + 1))) for w in numbers)
        assert r["held_out"] == (zlib.crc32(str(i).encode()) % 10 == 0)
        assert (r["n_tokens"], r["n_known"], r["train_tokens"]) == (len(t), sum(plain.count[w] > 0 for w in numbers), plain.n)
        assert math.isclose(r["base_score"], base, rel_tol=1e-9, abs_tol=1e-9)
        # values travel with 16 bits of fraction
        assert math.isclose(r["score"], plain.score(text), abs_tol=1e-5 * len(t))


def test_plain_version_sums_to_one(rows):
    for room in (py.ROOM, 40):
        plain = Plain(rows[:60], room)
        words = [w for w in plain.number.values() if plain.count[w]]
        contexts = [(0, 0), *sorted(plain.after, key=str)[:5], (0, words[3]), (words[1], words[2]), (0, max(words, key=plain.count.get))]
        for u, v in contexts:
            known = sum(plain.probability(u, v, w) for w in words)
            slots = 0.0
            for room_number in range(1 << plain.bits(v)):  # an unknown word of each room
                w = next(x for x in range(10**6, 10**6 + 4000) if plain.of(v, x) == room_number)
                slots += plain.probability(u, v, w)
            assert math.isclose(known + slots, 1.0, rel_tol=1e-9), (u, v, known, slots)


def test_layout_changes_no_score(spark, docs, rows, tmp_path):
    want = {r["doc_id"]: r["score"] for r in py.score(docs, room=40).collect()}
    path = str(tmp_path / "other.parquet")
    spark.createDataFrame(rows[::-1], docs.schema).repartition(7).write.option("compression", "uncompressed").parquet(path)
    for groups, chunk_words in ((1, 100), (64, 50_000), (300, 900)):
        before, py.CHUNK_WORDS = py.CHUNK_WORDS, chunk_words
        try:
            got = {r["doc_id"]: r["score"] for r in py.score(spark.read.parquet(path), room=40, groups=groups).collect()}
        finally:
            py.CHUNK_WORDS = before
        assert got.keys() == want.keys() and all(math.isclose(got[i], want[i], abs_tol=1e-9) for i in want)


def test_draws_follow_their_weights():
    n = 40_000
    x = (np.arange(n) + 0.5) / n
    for count, r in ((2, 0.3), (3, 5.0), (12, 0.9), (40, 30.0), (100, 2.5)):
        weights = np.array([r**t * s for t, s in enumerate(stirling(count))])
        got = np.bincount(py.draw(np.full(n, count), np.full(n, r), x), minlength=count + 1) / n
        assert np.abs(got - weights / weights.sum()).max() < 1e-3
    big = py.draw(np.array([10**9, 10**12, 10**6]), np.array([1e-9, 5e4, 1e7]), np.array([0.5, 0.5, 0.5]))
    # far more customers than tables: one and Poisson(2 r); more room than customers: a table each, nearly
    assert big[0] == 1 and abs(big[1] - 1e5) < 500 and 0.9 * 10**6 < big[2] <= 10**6


def test_blocks_agree_with_seating_one_by_one():
    """The mean number of tables of one dish, seated customer by customer with sizes of tables, at a fixed weight r."""
    rng, c, r = np.random.default_rng(5), 6, 0.8
    sizes, seen = [c], []
    for step in range(30_000):
        k = rng.choice(len(sizes), p=np.array(sizes) / c)
        sizes[k] -= 1
        sizes = [s for s in sizes if s]
        weights = np.array([s - D for s in sizes] + [r])
        k = rng.choice(len(weights), p=weights / weights.sum())
        if k == len(sizes):
            sizes.append(1)
        else:
            sizes[k] += 1
        seen.append(len(sizes))
    n = 20_000
    assert abs(np.mean(seen[500:]) - py.draw(np.full(n, c), np.full(n, r), (np.arange(n) + 0.5) / n).mean()) < 0.05


def test_texts_that_occur_twice_score_apart(spark):
    rng = np.random.default_rng(3)
    words = [f"w{k}" for k in range(400)]
    texts = [" ".join(rng.choice(words, 60)) for _ in range(300)]
    rows = [(k, t) for k, t in enumerate(texts + texts[:30])]
    rows = [r for r in rows if zlib.crc32(str(r[0]).encode()) % 10]
    got = {r["doc_id"]: r["score"] / r["n_tokens"] for r in py.score(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    twice = [got[k] for k in range(30) if k in got and 300 + k in got]
    once = [got[k] for k in range(30, 300) if k in got]
    assert min(twice) > max(once)


def test_edges(spark, empty):
    schema = "doc_id long, text string"
    assert py.score(empty).count() == 0
    got = py.score(spark.createDataFrame([(None, "a b"), (None, None), (7, "a b"), (7, ""), (7, " x ")], schema)).collect()
    assert len(got) == 5 and sum(r["doc_id"] is None for r in got) == 2 and not any(r["held_out"] for r in got if r["doc_id"] is None)
    assert all(math.isfinite(r["score"]) and r["score"] < 0 for r in got)
    held = next(k for k in range(1000) if zlib.crc32(str(k).encode()) % 10 == 0)
    only = py.score(spark.createDataFrame([(held, "a b a")], schema)).collect()[0]
    assert only["train_tokens"] == 0 and only["n_known"] == 0 and math.isfinite(only["score"])
    assert py.score(spark.createDataFrame([(1, "y " * 60_000)], schema)).collect()[0]["n_tokens"] == 60_001


def test_perplexity_and_clashing_columns(spark, empty):
    rows = [(k, "a b a c", 7, "x") for k in range(30)] + [(99, None, 7, "x")]
    df = spark.createDataFrame(rows, "doc_id long, text string, n_tokens int, score string")
    got = py.with_perplexity(py.score(df)).collect()
    assert len(got) == 31 and all(math.isclose(r["perplexity"], 10 ** (-r["score"] / r["n_tokens"])) and r["perplexity"] >= 1 for r in got)
    assert py.with_perplexity(py.score(empty)).count() == 0
