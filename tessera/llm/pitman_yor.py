"""A hierarchical Pitman-Yor language model over a corpus of any size.

Every two words in a row have a restaurant, as every one word has; the restaurant of (u, v) has that of v as its parent, so
all contexts that end in v share it, and all of these share the root, the restaurant of no context, over a uniform base
with a slot for unknown words. Training words are customers of the two-word restaurants, tables of a restaurant are
customers of its parent.

Seating is sampled in sweeps of blocks: all customers of one dish in one restaurant are seated anew at once, and the blocks of
a level at the same time, given the state after the last sweep. With discount d a seating of c customers at t tables is drawn with
the weight r^t S_d(c, t), r being (strength + d * tables) * the parent's probability and S_d a generalised Stirling number. With
d = 1/2 these have a closed form, so this number of tables, all that a prediction needs to know of a seating, is drawn
exactly from that weight, whether a dish has two customers or billions. It is an approximation of Gibbs sampling, not the
sampler itself: r counts the dish's own tables of the last sweep, it doesn't rise while they are added, blocks of a restaurant
don't see each other's new tables, and while the lower levels are seated the root has the probabilities of the corpus's counts. The
root has discount 0, so its own seating doesn't enter its predictions. Predictions are averaged over the samples after
burn-in, what the lower levels say, what they leave to the root, and the root's probability each.

A word that is a context more than ROOM times has rooms, twice as many for each doubling: the dish's hash tells the room, the
shares of the rooms are their parts of the training words (with one customer spread evenly), and inside a room restaurants
are as above; that too is an approximation, for very frequent contexts only. Rooms follow from the corpus alone, so no partitioning changes a score: random numbers are hashes of words,
sweep and level, counts are whole numbers, and what two restaurants share is exchanged and not estimated.

How it is dealt out. The corpus becomes a table of chunks. Each chunk sends its different words, as they are, to word
groups, which number all words, by the binary length of the count and then by hash, and send numbers and counts back. Each chunk then sends its
different word triples with counts to the group of (v, room), where all restaurants of two and of one word that are coupled
lie together; the root's probability while they are seated comes from the counts of the whole corpus. Groups send
sampled tables to the word groups, the root's customers, and for each triple of a chunk what the restaurants say. Chunks put
this together with the root. Nothing is broadcast but a number for each word group and the root's part of each room, and
only sums, one row a word group, come to the driver.

Cases: a null or empty text is its end token; with no training rows every word has the base's probability; repeated rows
count as often as they occur; ids may repeat; a null id is a training row; texts are read whole; an empty table gives an
empty one; other columns play no part, whatever they are called.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import discard, durable, mixed, shares, trim
from tessera.llm.corpus import Chunk, bundle, chunks_of, packed, tokenised, total_words, unbundle

#: One half gives the Stirling numbers their closed form; see draw().
DISCOUNT, STRENGTH = 0.5, 1.0
#: The root's strength, for each slot of its base.
ROOT = 0.1
BURN_IN, SAMPLES = 2, 3
FOLDS = 10
#: Occurrences of a context word for each of its rooms.
ROOM = 1_000_000
#: Training words whose restaurants, and words whose counts, go to one group; words of a chunk.
GROUP_WORDS, WORD_GROUP_WORDS, CHUNK_WORDS = 1_200_000, 8_000_000, 1_000_000
#: Numbers of words begin with those of the highest class, the binary length of the count.
CLASSES = 64
SEED = 17

MESSAGE = "kind int, dest long, source long, a binary"
NAMES = ["kind", "dest", "source", "a"]
WORDS, TRIPLES, TABLES, SUMS, VALUES, ROOT_CUSTOMERS = range(6)
#: The end token; no word is empty. The number of the text's beginning, as a context, is 0.
END = b""


def held_out(chunk: Chunk, folds: int) -> np.ndarray:
    found = np.fromiter((zlib.crc32(str(i).encode()) % folds == 0 for i in chunk.doc_ids.tolist()), bool, len(chunk.doc_ids))
    return found & ~chunk.no_id


def uniform(*keys: np.ndarray | int) -> np.ndarray:
    """Numbers in (0, 1), a hash of the keys."""
    h = np.uint64(SEED)
    with np.errstate(over="ignore"):
        for key in keys:
            h = mixed((h + np.asarray(key).astype(np.uint64)) * np.uint64(0x9E3779B97F4A7C15) + np.uint64(1))
    return ((h >> np.uint64(12)).astype(float) + 0.5) / 2.0**52


def room_bits(count: np.ndarray, room: int) -> np.ndarray:
    """Binary logarithm of the number of rooms of a context word."""
    return np.ceil(np.log2(np.maximum(1, count / room))).astype(np.int64)


def room_of(word: np.ndarray, bits: np.ndarray) -> np.ndarray:
    return (mixed(word.astype(np.uint64) + np.uint64(0x5851F42D)) & ((np.uint64(1) << bits.astype(np.uint64)) - np.uint64(1))).astype(np.int64)


def draw(count: np.ndarray, r: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Tables t of `count` customers of a dish with probability in proportion to r^t S(count, t), by inversion at x.

    S(c, t) = (2c - t - 1)! / ((t - 1)! (c - t)! 2^(2c - 2t)), so one more table has 4r(c - t) / ((2c - t - 1)t) times
    the weight. Weights are summed over ten deviations on both sides of the mode, which leaves out less than 10^-20.
    """
    tables = np.ones(len(count), np.int64)
    some = np.flatnonzero(count > 1)
    c, r, x = count[some].astype(float), r[some], x[some]
    b = 2 * c - 1 + 4 * r
    mode = 8 * r * c / (b + np.sqrt(np.maximum(b * b - 16 * r * c, 0)))
    spread = 10 * np.sqrt(np.minimum(mode, c - mode) + 1) + 10
    low = np.floor(np.maximum(1, mode - spread))
    width = (np.minimum(c, np.ceil(mode + spread)) - low + 1).astype(np.int64)
    size = np.ceil(np.log2(width)).astype(np.int64)
    for bits in np.unique(size).tolist():
        wide = 1 << bits
        all_of = np.flatnonzero(size == bits)
        step = max(1, (1 << 20) // wide)
        for at in range(0, len(all_of), step):
            i = all_of[at : at + step]
            t = low[i, None] + np.arange(wide - 1)
            more = c[i, None] - t
            weights = np.ones((len(i), wide))
            # beyond the range a factor is 0, and with it all that follow
            inside = np.arange(wide - 1) < width[i, None] - 1
            np.cumprod(np.where(inside, 4 * r[i, None] * more / np.maximum((c[i, None] + more - 1) * t, 1), 0.0), axis=1, out=weights[:, 1:])
            total = np.cumsum(weights, axis=1)
            tables[some[i]] = (low[i] + (total < x[i, None] * total[:, -1:]).sum(axis=1)).astype(np.int64)
    return tables


class Root:
    """The root's probability of words by their customers, and its part of each room."""

    def __init__(self, customers: float, vocabulary: int, masses: np.ndarray, known: np.ndarray):
        self.total = customers + ROOT * (vocabulary + 1)
        #: by number of rooms, a power of two: the part of each
        self.parts = {}
        whole = masses + ROOT * known
        for bits in range(len(whole).bit_length()):
            # each room has a slot for unknown words
            self.parts[bits] = (whole.reshape(-1, 1 << bits).sum(axis=0) + ROOT) / self.total

    def probability(self, customers: np.ndarray) -> np.ndarray:
        return (customers + ROOT) / self.total

    def part(self, bits: np.ndarray, room: np.ndarray) -> np.ndarray:
        out = np.empty(len(bits))
        for b in np.unique(bits).tolist():
            out[bits == b] = self.parts[b][room[bits == b]]
        return out


def seat(count, triple_pair, triple_dish, pair_context, dish_context, share, base, keys, sweeps=BURN_IN + SAMPLES, burn=BURN_IN):
    """Gibbs sweeps over restaurants that share their parents, yielding each sample.

    count: customers of each triple; triple_pair, triple_dish: its two-word restaurant and its dish in the parent;
    pair_context, dish_context: the parent of a restaurant, and of a dish; share: of a parent's room; base: the root's
    probability of a dish inside the room; keys: what random numbers are hashed from, of triples and of dishes.

    A sample is (a, b, tables of dishes): a triple's probability times its context's customers and strength is
    a + b[restaurant] * base.
    """
    pairs, dishes, contexts = len(pair_context), len(dish_context), len(share)
    tables = (count > 0).astype(np.int64)
    at_pair = np.bincount(triple_pair, tables, minlength=pairs)
    customers = np.bincount(triple_dish, tables, minlength=dishes).astype(np.int64)
    parent_tables = (customers > 0).astype(np.int64)
    several = np.flatnonzero(count > 1)
    for sweep in range(sweeps):
        fresh = STRENGTH * share[pair_context] + DISCOUNT * at_pair
        parent_fresh = STRENGTH + DISCOUNT * np.bincount(dish_context, parent_tables, minlength=contexts)
        in_parent = np.bincount(dish_context, customers, minlength=contexts)
        parent = (customers - DISCOUNT * parent_tables + (parent_fresh[dish_context] * base)) / (in_parent + STRENGTH)[dish_context]
        tables[several] = draw(count[several], (fresh[triple_pair[several]] * parent[triple_dish[several]]), uniform(3, sweep, *(k[several] for k in keys[0])))
        at_pair = np.bincount(triple_pair, tables, minlength=pairs)
        customers = np.bincount(triple_dish, tables, minlength=dishes).astype(np.int64)
        more = np.flatnonzero(customers > 1)
        parent_tables = (customers > 0).astype(np.int64)
        parent_tables[more] = draw(customers[more], parent_fresh[dish_context[more]] * base[more], uniform(2, sweep, *(k[more] for k in keys[1])))
        if sweep >= burn:
            fresh = STRENGTH * share[pair_context] + DISCOUNT * at_pair
            parent_fresh = STRENGTH + DISCOUNT * np.bincount(dish_context, parent_tables, minlength=contexts)
            in_parent = np.bincount(dish_context, customers, minlength=contexts) + STRENGTH
            of_dish = (customers - DISCOUNT * parent_tables) / in_parent[dish_context]
            yield count - DISCOUNT * tables + fresh[triple_pair] * of_dish[triple_dish], fresh * (parent_fresh / in_parent)[pair_context], parent_tables


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    kinds = [pa.int32(), pa.int64(), pa.int64(), pa.binary()]
    return pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], t) for k, t in enumerate(kinds)], NAMES)


def _changes(*arrays: np.ndarray) -> np.ndarray:
    """Places where one of the arrays differs from its last value."""
    fresh = np.zeros(len(arrays[0]), bool)
    fresh[:1] = True
    for a in arrays:
        fresh[1:] |= a[1:] != a[:-1]
    return np.flatnonzero(fresh)


def _runs(begin: np.ndarray, n: int) -> np.ndarray:
    return np.diff(np.append(begin, n))


def _steps(values: np.ndarray, begin: np.ndarray) -> np.ndarray:
    """Differences of values that grow inside each run; a run's first stays."""
    out = np.diff(values, prepend=0)
    out[begin] = values[begin]
    return out


def _walked(steps: np.ndarray, runs: np.ndarray) -> np.ndarray:
    """The values of _steps."""
    total = np.cumsum(steps)
    begin = np.cumsum(runs) - runs
    return total - np.repeat(total[begin] - steps[begin], runs)


def _shortened(values: np.ndarray) -> np.ndarray:
    """Positive numbers as 24 bits of a float: 16 of the fraction."""
    return (values.astype("<f4").view("<u4").astype(np.int64) + 0x80) >> 8


def _lengthened(values: np.ndarray) -> np.ndarray:
    return (values << 8).astype("<u4").view("<f4").astype(float)


def _send_words(folds: int, groups: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import xxhash

        for chunk in chunks_of(batches):
            words = [*chunk.vocabulary, END]
            hashes = np.fromiter(map(xxhash.xxh64_intdigest, words), np.uint64, len(words))
            train = ~held_out(chunk, folds)
            counts = np.append(np.bincount(chunk.words[np.repeat(train, chunk.doc_words)], minlength=len(chunk.vocabulary)), train.sum())
            group = (((hashes >> np.uint64(32)) * np.uint64(groups)) >> np.uint64(32)).astype(np.int64)
            order = np.argsort(group, kind="stable")
            begin = _changes(group[order])
            out = []
            for at, n in zip(begin.tolist(), _runs(begin, len(order)).tolist()):
                i = order[at : at + n]
                listed = b" ".join([words[k] for k in i.tolist()])
                numbers = bundle(i, counts[i])
                out.append((WORDS, int(group[i[0]]), chunk.chunk_id, packed(len(numbers).to_bytes(8, "little") + numbers + listed)))
            yield _batch(out)

    return run


def _number_words(key: tuple, rows: pa.Table) -> pa.Table:
    """Places of words by class and hash, to the chunks with the words' counts; and the group's sums and class sizes."""
    import xxhash
    import zstandard

    trim()
    places: dict[bytes, int] = {}
    asked, total = [], np.zeros(0, np.int64)
    for r in rows.sort_by("source").to_pylist():
        raw = zstandard.ZstdDecompressor().decompress(r["a"])
        cut = 8 + int.from_bytes(raw[:8], "little")
        position, count = unbundle(raw[8:cut])
        of = np.fromiter((places.setdefault(w, len(places)) for w in raw[cut:].split(b" ")), np.int64, len(position))
        total = np.concatenate([total, np.zeros(len(places) - len(total), np.int64)])
        total[of] += count
        asked.append((r["source"], position, of))
    names, kind = list(places), class_of(total)
    by_class = kind.tolist()
    rank = np.empty(len(names), np.int64)
    rank[sorted(range(len(names)), key=lambda i: (by_class[i], xxhash.xxh64_intdigest(names[i]), names[i]))] = np.arange(len(names))
    group = key[0].as_py()
    out = [(WORDS, source, group, bundle(position, rank[of], total[of])) for source, position, of in asked]
    words = [n for n in names if n]
    alone = int(total[places[END]]) if END in places else 0
    greatest = max((int(total[places[w]]) for w in words), default=0)
    out.append((SUMS, -1, group, bundle(np.array([(total > 0).sum(), total.sum(), max(alone, greatest)]), np.bincount(kind, minlength=CLASSES))))
    return pa.Table.from_batches([_batch(out)])


def class_of(count: np.ndarray) -> np.ndarray:
    """0 for the most frequent words that there can be, CLASSES - 1 for unseen ones."""
    return CLASSES - 1 - np.frexp(count.astype(float))[1]


class Numbers:
    """Numbers of all words, from 1 on, by class and hash: what each word group's places stand for."""

    def __init__(self, sizes: np.ndarray):
        """sizes: words by group and class."""
        self.sizes = sizes
        flat = sizes.T.ravel()
        #: words before those of a group in a class, over all, by class and then group; and in the group
        self.before = (np.cumsum(flat) - flat).reshape(sizes.T.shape)
        self.inside = np.cumsum(sizes, axis=1) - sizes

    def of(self, group: int, place: np.ndarray) -> np.ndarray:
        kind = np.searchsorted(self.inside[group], place, side="right") - 1
        return 1 + self.before[kind, group] + place - self.inside[group, kind]

    def home(self, number: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Group and place there."""
        at = np.searchsorted(self.before.ravel(), number - 1, side="right") - 1
        kind, group = np.divmod(at, len(self.sizes))
        return group, number - 1 - self.before[kind, group] + self.inside[group, kind]


def _root_masses(answers: DataFrame, numbers: Numbers, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """Training words and known words in each of 2^bits rooms: sums of at most so many numbers for each word group."""

    def run(key: tuple, rows: pa.Table) -> pa.Table:
        local, count = (np.concatenate(x) for x in zip(*(unbundle(b)[1:] for b in rows["a"].to_pylist())))
        local, first = np.unique(local, return_index=True)
        room = room_of(numbers.of(key[0].as_py(), local), np.full(len(local), bits))
        sums = np.bincount(room, count[first], minlength=1 << bits), np.bincount(room[count[first] > 0], minlength=1 << bits)
        some = np.flatnonzero(sums[1])
        return pa.table({"room": pa.array(some, pa.int64()), "n": pa.array(sums[0][some].astype(np.int64)), "known": pa.array(sums[1][some].astype(np.int64))})

    made = answers.where(F.col("kind") == WORDS).select("source", "a").groupBy("source").applyInArrow(run, "room long, n long, known long")
    out = np.zeros((2, 1 << bits))
    for r in made.groupBy("room").agg(F.sum("n").alias("n"), F.sum("known").alias("known")).toLocalIterator():
        out[:, r["room"]] = r["n"], r["known"]
    return out[0], out[1]


class Stream:
    """A chunk's tokens, each text's end included, and its triples in the order in which they are sent."""

    def __init__(self, chunk: Chunk, answers: list[dict], numbers: Numbers, groups: int, folds: int, room: int):
        made = [(r["source"], *unbundle(r["a"])) for r in sorted(answers, key=lambda r: r["source"])]
        size = sum(len(position) for _, position, _, _ in made)
        number, count = np.zeros(size, np.int64), np.zeros(size, np.int64)
        for source, position, local, n in made:
            number[position], count[position] = numbers.of(source, local), n
        #: where each word group's answers stand among the words
        order = np.argsort(number, kind="stable")
        rank = np.empty(size + 1, np.int64)
        rank[order] = np.arange(1, size + 1)
        self.place = {source: rank[position] for source, position, _, _ in made}
        self.number = np.concatenate([[0], number[order]])
        # a text's beginning is a context as often as its end is a word
        self.count = np.concatenate([[count[size - 1]], count[order]])
        self.held = held_out(chunk, folds)
        self.ends = np.cumsum(chunk.doc_words + 1)
        n = int(self.ends[-1]) if len(self.ends) else 0
        self.tokens = np.full(n, rank[size - 1], np.int64)
        word_at = np.ones(n, bool)
        word_at[self.ends - 1] = False
        self.tokens[word_at] = rank[chunk.words]
        begin = self.ends - chunk.doc_words - 1
        before = np.zeros(n, np.int64)
        before[1:] = self.tokens[:-1]
        before[begin] = 0
        second = np.zeros(n, np.int64)
        second[1:] = before[:-1]
        second[begin] = 0
        train = np.repeat(~self.held, chunk.doc_words + 1)
        self.size = size + 1
        self.pairs, pair_of = np.unique(before * self.size + second, return_inverse=True)
        triples, self.triple_of = np.unique(pair_of * self.size + self.tokens, return_inverse=True)
        self.triple_count = np.bincount(self.triple_of[train], minlength=len(triples))
        self.pair, self.word = triples // self.size, triples % self.size
        self.context, self.first = self.pairs[self.pair] // self.size, self.pairs[self.pair] % self.size
        self.bits = room_bits(self.count, room)
        bits = self.bits[self.context]
        self.room = room_of(self.number[self.word], bits)
        with np.errstate(over="ignore"):
            dest = mixed(self.number[self.context].astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) + self.room.astype(np.uint64))
        group = (dest % np.uint64(groups)).astype(np.int64)
        # triples are in the order of context, first word, word; rooms come before first words
        self.order = np.lexsort((self.first, self.room, self.context, group)) if bits.any() else np.argsort(group, kind="stable")
        begin = _changes(group[self.order])
        self.parts = [(int(group[self.order[a]]), self.order[a : a + m]) for a, m in zip(begin.tolist(), _runs(begin, len(group)).tolist())]

    def messages(self) -> list[tuple[int, bytes]]:
        out = []
        for group, i in self.parts:
            context, first, word, room = self.context[i], self.first[i], self.word[i], self.room[i]
            pair_at, context_at = _changes(context, room, first), _changes(context, room)
            different = np.unique(word)
            out.append((group, bundle(
                self.number[context[context_at]], room[context_at], self.count[context[context_at]], _runs(np.searchsorted(pair_at, context_at), len(pair_at)),
                _steps(self.number[first[pair_at]], np.searchsorted(pair_at, context_at)), _runs(pair_at, len(i)), _steps(self.number[word], pair_at),
                self.triple_count[i], self.count[different],
            )))
        return out


def _seat_group(root: Root, numbers: Numbers, room: int):
    def run(key: tuple, rows: pa.Table) -> pa.Table:
        trim()
        rows = rows.select(["source", "a"]).sort_by("source").to_pylist()
        sources = [r["source"] for r in rows]
        parts = [unbundle(r.pop("a")) for r in rows]
        del rows
        for p in parts:
            p[4], p[6] = _walked(p[4], p[3]), _walked(p[6], p[5])
        cat = lambda k: np.concatenate([p[k] for p in parts])
        # contexts with their rooms, then pairs in them, then triples
        context_key, first_at, context_of = np.unique(cat(0) * (1 << 20) + cat(1), return_index=True, return_inverse=True)
        context_number, context_room, context_count = context_key >> 20, context_key & ((1 << 20) - 1), cat(2)[first_at]
        firsts, first_of = np.unique(cat(4), return_inverse=True)
        pairs, pair_of = np.unique(np.repeat(context_of, cat(3)) * len(firsts) + first_of, return_inverse=True)
        pair_context, pair_first = pairs // len(firsts), firsts[pairs % len(firsts)]
        seen = [np.unique(p[6], return_inverse=True) for p in parts]
        words, at = np.unique(np.concatenate([s[0] for s in seen]), return_index=True)
        word_count = cat(8)[at]
        word_of = np.concatenate([np.searchsorted(words, s[0])[s[1]] for s in seen])
        del seen
        triples, triple_of = np.unique(np.repeat(pair_of, cat(5)) * len(words) + word_of, return_inverse=True)
        count = np.bincount(triple_of, cat(7), minlength=len(triples)).astype(np.int64)
        sizes = [len(p[6]) for p in parts]
        runs = [len(p[4]) for p in parts]
        del parts
        triple_pair, triple_word = triples // len(words), triples % len(words)
        dishes, triple_dish = np.unique(pair_context[triple_pair] * len(words) + triple_word, return_inverse=True)
        dish_context, dish_word = dishes // len(words), dishes % len(words)

        bits = room_bits(context_count, room)
        here = np.bincount(pair_context[triple_pair], count, minlength=len(context_key))
        share = (here + 0.5 ** bits.astype(float)) / (context_count + 1)
        base = root.probability(word_count[dish_word]) / root.part(bits, context_room)[dish_context]
        keys = (context_number[pair_context][triple_pair], pair_first[triple_pair], words[triple_word]), (context_number[dish_context], words[dish_word])
        a, b, tables = np.zeros(len(triples)), np.zeros(len(pairs)), []
        for one, other, sampled in seat(count, triple_pair, triple_dish, pair_context, dish_context, share, base, keys):
            a += one / SAMPLES
            b += other / SAMPLES
            tables.append(np.bincount(dish_word, sampled, minlength=len(words)).astype(np.int64))

        # Where a context has one room, its customers are all here; a chunk divides by those of the others.
        divisor = np.where(bits[pair_context] > 0, 1.0, np.bincount(triple_pair, count, minlength=len(pairs)) + STRENGTH)
        a, b = _shortened(a / divisor[triple_pair]), _shortened(b / divisor)
        often = word_count > room
        followed = np.bincount(triple_dish, count, minlength=len(dishes)).astype(np.int64)
        out, at, run_at = [], 0, 0
        group = key[0].as_py()
        for source, n, m in zip(sources, sizes, runs):
            t = triple_of[at : at + n]
            asked = t[often[triple_word[t]]]
            out.append((VALUES, source, group, bundle(a[t], b[pair_of[run_at : run_at + m]], followed[triple_dish[asked]])))
            at, run_at = at + n, run_at + m
        some = np.flatnonzero(tables[0])  # a dish with customers has a table in each sample
        home, place = numbers.home(words[some])
        order = np.argsort(home, kind="stable")
        some, home, place = some[order], home[order], place[order]
        begin = _changes(home)
        for k, n in zip(begin.tolist(), _runs(begin, len(some)).tolist()):
            out.append((TABLES, int(home[k]), group, bundle(place[k : k + n], *(t[some[k : k + n]] for t in tables))))
        return pa.Table.from_batches([_batch(out)])

    return run


def _seat_root(numbers: Numbers, bits: int):
    """The root's customers of words, to the chunks that asked for their numbers; and sums, by room."""

    def run(key: tuple, rows: pa.Table) -> pa.Table:
        trim()
        group = key[0].as_py()
        size = int(numbers.sizes[group].sum())
        customers, known = np.zeros((SAMPLES, size), np.int64), np.zeros(size, bool)
        rows = rows.to_pylist()
        for r in rows:
            if r["kind"] == TABLES:
                local, *tables = unbundle(r["a"])
                for s, t in enumerate(tables):
                    customers[s, local] += t
            else:
                _, local, count = unbundle(r["a"])
                known[local] = count > 0
        out = []
        for r in rows:
            if r["kind"] == WORDS:
                _, local, _ = unbundle(r["a"])
                out.append((ROOT_CUSTOMERS, r["source"], group, bundle(*customers[:, local])))
        room = room_of(numbers.of(group, np.arange(size)), np.full(size, bits))
        out.append((SUMS, -1, group, bundle(*(np.bincount(room, c, minlength=1 << bits).astype(np.int64) for c in customers),
            np.bincount(room[known], minlength=1 << bits))))
        return pa.Table.from_batches([_batch(out)])

    return run


RESULT = "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double"


def score(docs: DataFrame, folds: int = FOLDS, room: int = ROOM, groups: int | None = None) -> DataFrame:
    """Each document's log10 probability by the model and by the single-word base.

    room: occurrences of a context word for each of its rooms. groups: how many seating groups, by the corpus if None; no
    score depends on it.
    """
    corpus = tokenised(docs, lower=True, chunk_words=CHUNK_WORDS)
    total = total_words(corpus)
    word_groups = shares(total, WORD_GROUP_WORDS, 4) if groups is None else groups
    groups = shares(total, GROUP_WORDS) if groups is None else groups
    listed = durable(corpus.mapInArrow(_send_words(folds, word_groups), MESSAGE).groupBy("dest").applyInArrow(_number_words, MESSAGE), "numbers", "none")
    found, sizes = np.zeros((word_groups, 3), np.int64), np.zeros((word_groups, CLASSES), np.int64)
    for r in listed.where("dest = -1").select("source", "a").toLocalIterator():
        found[r["source"]], sizes[r["source"]] = unbundle(r["a"])
    numbers = Numbers(sizes)
    vocabulary, train_tokens = int(found[:, 0].sum()), int(found[:, 1].sum())
    most = int(room_bits(found[:, 2], room).max())
    answers = listed.where("dest >= 0")
    masses = _root_masses(answers, numbers, most) if most else (np.array([train_tokens]), np.array([vocabulary]))
    first_root = Root(train_tokens, vocabulary, *masses)
    plain = corpus.drop("vocabulary")

    def send_triples(key: tuple, chunk_rows: pa.Table, answer_rows: pa.Table) -> pa.Table:
        trim()
        out = []
        for chunk in chunks_of(chunk_rows):
            s = Stream(chunk, answer_rows.to_pylist(), numbers, groups, folds, room)
            out += [(TRIPLES, group, chunk.chunk_id, blob) for group, blob in s.messages()]
        return pa.Table.from_batches([_batch(out)])

    by_chunk = answers.select(F.col("dest").alias("chunk_id"), "kind", "source", "a")
    sent = plain.groupBy("chunk_id").cogroup(by_chunk.groupBy("chunk_id")).applyInArrow(send_triples, MESSAGE)
    seated = durable(sent.select("dest", "source", "a").groupBy("dest").applyInArrow(_seat_group(first_root, numbers, room), MESSAGE), "seated", "none")
    asked = answers.select("kind", F.col("source").alias("dest"), F.col("dest").alias("source"), "a")
    tables = asked.unionByName(seated.where(F.col("kind") == TABLES))
    customers = durable(tables.groupBy("dest").applyInArrow(_seat_root(numbers, most), MESSAGE), "customers", "none")
    sums, known = np.zeros((SAMPLES, 1 << most)), np.zeros(1 << most)
    for r in customers.where("dest = -1").select("a").toLocalIterator():
        *at_samples, n = unbundle(r["a"])
        sums += np.array(at_samples)
        known += n
    roots = [Root(x.sum(), vocabulary, x, known) for x in sums]

    def finish(key: tuple, chunk_rows: pa.Table, answer_rows: pa.Table) -> pa.Table:
        trim()
        made = []
        by_kind = {kind: [] for kind in (WORDS, VALUES, ROOT_CUSTOMERS)}
        for r in answer_rows.to_pylist():
            by_kind[r["kind"]].append(r)
        for chunk in chunks_of(chunk_rows):
            s = Stream(chunk, by_kind[WORDS], numbers, groups, folds, room)
            of_root = np.zeros((SAMPLES, s.size))
            for r in by_kind[ROOT_CUSTOMERS]:
                of_root[:, s.place[r["source"]]] = np.array(unbundle(r["a"]))
            place = dict(s.parts)
            a, b, followers = np.zeros(len(s.word)), np.zeros(len(s.word)), np.zeros(len(s.pairs))
            followers[s.pairs == 0] = s.count[0]
            often = s.count > room
            for r in by_kind[VALUES]:
                i = place[r["source"]]
                one, other, followed = unbundle(r["a"])
                a[i] = _lengthened(one)
                pair_at = _changes(s.context[i], s.room[i], s.first[i])
                b[i] = np.repeat(_lengthened(other), _runs(pair_at, len(i)))
                asked = i[often[s.word[i]]]
                # (v, w) as a context: w is the word before, v the one before that; the end is none
                pair = s.word[asked] * s.size + s.context[asked]
                at = np.minimum(np.searchsorted(s.pairs, pair), len(s.pairs) - 1)
                hit = s.pairs[at] == pair
                followers[at[hit]] = followed[hit]
            bits = s.bits[s.context]
            root = np.zeros(len(s.word))
            for sample, c in zip(roots, of_root):
                root += sample.probability(c[s.word]) / sample.part(bits, s.room) / SAMPLES
            p = (a + b * root) / np.where(bits > 0, followers[s.pair] + STRENGTH, 1.0)
            base = np.log10((s.count + 0.1) / (train_tokens + 0.1 * (vocabulary + 1)))
            begin = s.ends - chunk.doc_words - 1
            of_docs = lambda x: np.add.reduceat(x, begin) if len(begin) else x
            n = chunk.doc_words + 1
            values = (s.held, n, of_docs((s.count > 0)[s.tokens].astype(np.int64)), np.full(len(n), train_tokens), of_docs(base[s.tokens]),
                of_docs(np.log10(np.maximum(p, 1e-300))[s.triple_of]))
            kinds = [pa.bool_(), pa.int64(), pa.int64(), pa.int64(), pa.float64(), pa.float64()]
            made.append(pa.table([chunk.ids(), *(pa.array(v, t) for v, t in zip(values, kinds))], [x.split()[0] for x in RESULT.split(", ")]))
        return pa.concat_tables(made)

    back = by_chunk.unionByName(seated.where(F.col("kind") == VALUES).unionByName(customers.where("dest >= 0")).select(F.col("dest").alias("chunk_id"),
        "kind", "source", "a"))
    # A row a document, written, so that the tables it was made from can go.
    out = durable(plain.groupBy("chunk_id").cogroup(back.groupBy("chunk_id")).applyInArrow(finish, RESULT), "scores")
    discard(corpus, listed, seated, customers)
    return out


def with_perplexity(scores: DataFrame) -> DataFrame:
    """scores with each text's perplexity: 10 to the mean of minus the log10 probability of its tokens, the end included."""
    return scores.withColumn("perplexity", F.pow(F.lit(10.0), -F.col("score") / F.col("n_tokens")))


def op1_pitman_yor(spark, sf_dir: str) -> DataFrame:
    return with_perplexity(score(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")))
