"""Plain versions of the operators, for small inputs."""

import collections
import hashlib
import re

WORD = re.compile(r"[^\x20\x09-\x0d]+")


def words(text):
    return WORD.findall(text or "")


def substring(docs, window=13):
    """id -> (n_words, n_removed, kept words)."""
    first = {}
    tok = {i: words(t) for i, t in docs}
    for i in sorted(tok):
        for k in range(len(tok[i]) - window + 1):
            first.setdefault(tuple(tok[i][k : k + window]), i)
    out = {}
    for i, w in tok.items():
        gone = set()
        for k in range(len(w) - window + 1):
            if first[tuple(w[k : k + window])] < i:
                gone |= set(range(k, k + window))
        out[i] = (len(w), len(gone), [x for k, x in enumerate(w) if k not in gone])
    return out


def near(docs, n=5, threshold=0.8):
    """id -> (class id, links)."""
    sets = {}
    for i, t in docs:
        w = words(t)
        sets[i] = frozenset(tuple(w[k : k + n]) for k in range(max(1, len(w) - n + 1))) if w else frozenset()
    parent = {i: i for i in sets}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    links = collections.Counter()
    ids = sorted(sets)
    for a in ids:
        for b in ids:
            if a < b and sets[a] and sets[b] and len(sets[a] & sets[b]) >= threshold * len(sets[a] | sets[b]) - 1e-9:
                links[a] += 1
                links[b] += 1
                x, y = find(a), find(b)
                parent[max(x, y)] = min(x, y)
    return {i: (find(i), links[i]) for i in ids}


def exact(docs):
    """id -> (keep id, size, sha256)."""
    norm = {i: re.sub(r"[\x20\x09-\x0d]+", " ", t or "") for i, t in docs}
    groups = collections.defaultdict(list)
    for i, t in norm.items():
        groups[t].append(i)
    return {i: (min(groups[t]), len(groups[t]), hashlib.sha256(t.encode()).hexdigest()) for i, t in norm.items()}


def quality(text):
    """n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words."""
    w, t = words(text), text or ""
    lines = [x for x in t.split("\n") if WORD.search(x)]
    seen = collections.Counter(tuple(w[i : i + 5]) for i in range(len(w) - 4))
    covered = set()
    for i in range(len(w) - 4):
        if seen[tuple(w[i : i + 5])] > 1:
            covered |= set(range(i, i + 5))
    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", t)), len(lines) - len(set(lines)), len(covered)


def quality_verdict(text, thresholds, stop_words):
    """Whether a text passes the base rule and every threshold, each measure worked out word by word."""
    n, chars, symbols, dup, rep = quality(text)
    w, body = words(text), text or ""
    lines = [x for x in body.split("\n") if WORD.search(x)]
    per = lambda a, b: a / b if b else None
    measures = {
        "n_words": n,
        "mean_word_length": per(chars, n),
        "symbols_per_word": per(symbols, n),
        "stop_ratio": per(sum(x.translate({ord(c): None for c in ".,;:!?"}).lower() in stop_words for x in w), n),
        "dup_line_ratio": per(dup, len(lines)),
        "repeat_word_ratio": per(rep, n),
        "upper_word_ratio": per(sum(x.upper() == x and x.lower() != x and len(x) > 1 for x in w), n),
        "stutter_ratio": per(sum(a == b for a, b in zip(w, w[1:])), n),
        "bar_ratio": per(body.count("|"), n),
    }
    if n < 10 or 100 * rep > 20 * n:
        return False
    for _, name, low, high, from_words in thresholds:
        value = measures[name]
        if n >= from_words and value is not None and (low is not None and value < low or high is not None and value > high):
            return False
    return True
