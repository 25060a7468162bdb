import math
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessera.llm import packing, subword, toxicity
from tests.llm import brute


def test_subword_equals_the_library_without_dropout(rows):
    import sentencepiece

    merges = subword.Merges(subword.model_path())
    library = sentencepiece.SentencePieceProcessor(model_file=subword.model_path())
    texts = [r[1] for r in rows]
    for text, ids in zip(texts, subword.Encoder(merges, 0.0)(list(range(len(texts))), texts)):
        if text is None:
            assert ids is None
        elif subword.MARK not in text:
            assert np.frombuffer(ids, "<u4").tolist() == library.encode(text), text


def test_subword_dropout(spark, docs, rows, empty):
    path = subword.model_path()
    first = {r["doc_id"]: r for r in subword.encode(docs, path, 0.3).collect()}
    again = {r["doc_id"]: r["ids"] for r in subword.encode(docs.repartition(2), path, 0.3).collect()}
    other = {r["doc_id"]: r["ids"] for r in subword.encode(docs, path, 0.3, seed=9).collect()}
    assert {k: r["ids"] for k, r in first.items()} == again != other
    assert all(r["lossless"] or r["ids"] is None for r in first.values())
    back = {r["doc_id"]: r["text"] for r in subword.decode(subword.encode(docs, path, 0.3), path).collect()}
    assert back == {r[0]: r[1] for r in rows}
    assert subword.encode(empty, path).count() == 0


def test_subword_agenda():
    """Against one merge at a time, found by looking at every pair."""
    m = subword.Merges(subword.model_path())
    index = {int(k): i for i, k in enumerate(m.keys)}
    words = [f"{subword.MARK}{w}" for w in ("tokenization", "thererear", "aaaaaaaaa", "xyzzy", "internationalisation", "e")]

    def plain(word, variant, rate, seed):
        u = np.uint64
        points = np.array([ord(c) for c in word], np.uint32)
        key = subword.segment_keys(points, np.arange(len(word)), np.array([0]), seed, np.array([variant]))
        sym, at = [int(m.char[ord(c)]) for c in word], list(range(len(word)))
        while True:
            found = []
            for k in range(len(sym) - 1):
                pair = sym[k] * m.size + sym[k + 1]
                if pair in index:
                    h = subword.mixed(key ^ subword.mixed(np.array([pair], u) * u(0xD6E8FEB86659FD93) + u(at[k])))
                    if not h[0] < u(rate * (2**64 - 1)):
                        found.append((int(m.rank[index[pair]]), k, int(m.merged[index[pair]])))
            if not found:
                return sym
            _, k, to = min(found)
            sym[k : k + 2] = [to]
            del at[k + 1]

    for variant in range(4):
        for word, ids in zip(words, m.segment(words, 0.4, 3, variant)):
            assert np.frombuffer(ids, "<u4").tolist() == plain(word, variant, 0.4, 3)


def test_subword_dropout_of_each_occurrence():
    """As many segmentations as there are, a word of one merge at the rate, and the memo as if every agenda were run."""
    m = subword.Merges(subword.model_path())
    e = subword.Encoder(m, 0.1)
    assert len(set(e(list(range(300)), ["internationalisation of tokenization"] * 300))) > 50
    words = [f"{subword.MARK}{c}" for c in "abcdefghijklmnopqrstuvwxyz"]
    short = next(w for w, ids in zip(words, m.segment(words, 0.0, 0, 0)) if len(ids) == 4)
    n = 20_000
    occurrence = e.occurrences([e.document_key(1), e.document_key(2)], [n // 2, n // 2])
    split = sum(len(ids) > 4 for ids in e.encode([short] * n, occurrence))
    assert 0.09 < split / n < 0.11
    segments = ["\u2581internationalisation", "\u2581the", short, "\u2581aaaaaaaaa", "\n", "\u2581\u6c34x"] * 50
    occurrence = e.occurrences([e.document_key(5), e.document_key("z")], [130, 170])
    assert e.encode(segments, occurrence) == m.segment(segments, 0.1, e.seed, occurrence.view(np.int64))


def test_packing_depends_on_documents_alone(spark, tmp_path, monkeypatch):
    """Other codecs, files and orders give the same sequences; copies of a row are dealt to all groups."""
    monkeypatch.setattr(packing, "GROUP_TOKENS", 3_000)
    monkeypatch.setattr(packing, "COPIES", 50)
    rows = [(k, " ".join(f"w{j % 7}" for j in range(k % 60))) for k in range(400)] + [(7, "same row")] * 333 + [(None, None)] * 3
    df = spark.createDataFrame(rows, "doc_id long, text string")
    df.coalesce(1).write.option("compression", "none").parquet(f"{tmp_path}/a")
    df.orderBy(F.rand(1)).repartition(6).write.option("compression", "zstd").parquet(f"{tmp_path}/b")
    a, b = (sorted(map(str, packing.pack_documents(spark.read.parquet(f"{tmp_path}/{x}"), packing.tokenizer_path()).collect())) for x in "ab")
    assert a == b and len(a) == len(rows)
    same = packing.pack_documents(df, packing.tokenizer_path()).where("doc_id = 7 and doc_tokens = 3").collect()
    groups = -(-sum(1 for _ in same) // 1)
    assert groups == 333 and len({r["sequence_id"] % 5 for r in same}) > 1


def test_packing(docs, rows, empty):
    from tokenizers import Tokenizer

    path = packing.tokenizer_path()
    tokenizer = Tokenizer.from_file(path)
    window = 64
    got = packing.pack_documents(docs, path, window).collect()
    by = {}
    for r in got:
        by.setdefault(r["doc_id"], []).append(r)
    for i, text, *_ in rows:
        ids = np.array([*tokenizer.encode(text or "", add_special_tokens=False).ids, 1], "<u4")
        at = 0
        for p in sorted(by[i], key=lambda p: p["start"]):
            assert p["start"] == at and p["doc_tokens"] == len(ids) and p["ids_crc32"] == zlib.crc32(ids[at : at + p["length"]].tobytes())
            at += p["length"]
        assert at == len(ids)
    sequences = {}
    for r in got:
        sequences.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for parts in sequences.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= window
    used = sum(r["length"] for r in got)
    assert used >= 0.9 * window * (len(sequences) - 1)
    assert packing.pack_documents(empty, path).count() == 0


def test_best_fit_is_tightest():
    rng = np.random.default_rng(3)
    lengths = np.sort(rng.integers(1, 65, 400))[::-1]
    where, offset = packing.best_fit(lengths, 64)
    room = []
    for n, w, o in zip(lengths.tolist(), where.tolist(), offset.tolist()):
        fits = [r for r in room if r >= n]
        if fits:
            assert room[w] == min(fits) and o == 64 - room[w]
        else:
            assert w == len(room) and o == 0
            room.append(64)
        room[w] -= n


@pytest.mark.parametrize("text", ["it's don't", "a<|endoftext|>b", "Ünï ßcode", "日本 тест Σίσυφος ΑΣ", "x́y", "123 ½ ²", "", None])
def test_word_memo(text):
    from tokenizers import Tokenizer

    path = packing.tokenizer_path()
    want = Tokenizer.from_file(path).encode(text or "", add_special_tokens=False).ids
    assert np.frombuffer(next(packing.WordMemo(path)([text])), "<u4").tolist() == want


def test_toxicity(spark, empty):
    rows, labels = [], []
    for i in range(400):
        toxic = i % 4 == 0
        filler = " ".join(f"w{(i * 7 + k * 13) % 97}x" for k in range(40))
        bad = f"grumbol{i % 9} " if toxic else ""
        rows.append((i, f"{filler} {bad}{bad.upper()}end"))
        labels.append((i, int(toxic)))
    rows += [(1000, None), (1001, ""), (1002, "you gruмb0l3"), (1003, "clean text here")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    lexicon = toxicity.learn(docs, spark.createDataFrame(labels, "doc_id long, toxic int"))
    got = {r["doc_id"]: r["score"] for r in toxicity.score(docs, lexicon).collect()}
    assert len(got) == len(rows)
    assert sum((got[i] >= 0.5) == bool(y) for i, y in labels) >= 0.97 * len(labels)
    assert got[1000] == got[1001] == got[1003] < 0.5 <= got[1002]
    assert toxicity.score(empty, lexicon).count() == 0
    none = toxicity.learn(docs, spark.createDataFrame([], "doc_id long, toxic int"))
    assert {r["score"] < 0.5 for r in toxicity.score(docs, none).collect()} == {True}


def test_toxicity_exceptions_and_folding():
    lexicon = toxicity.Lexicon({" scum ": 5.0}, [" pond scum "])
    assert lexicon.measures("pond scum")[2] == 0
    assert lexicon.measures("you SCUM, ѕсum s<um 5cum")[2] == 3
    assert toxicity.folded("Lo​ser") == toxicity.folded("1o5er")


def test_packing_cuts_at_the_tokenizers_white_space():
    from tokenizers import Tokenizer

    path = packing.tokenizer_path()
    tokenizer = Tokenizer.from_file(path)
    signs = [*map(chr, range(0x20)), *"\x85\xa0\u1680\u180e\u2003\u200b\u2028\u2029\u202f\u205f\u3000\ufeff"]
    texts = [f"alpha{c}beta {c} {c}\x1c{c}\u00e9" for c in signs] + [f"alpha{c}beta {c}" for c in signs]
    for text, ids in zip(texts, packing.WordMemo(path)(texts)):
        assert np.frombuffer(ids, "<u4").tolist() == tokenizer.encode(text, add_special_tokens=False).ids, repr(text)


def test_word_memo_on_every_odd_character():
    """Every code point up to U+30FF between words, at their ends and inside them."""
    from tokenizers import Tokenizer

    path = packing.tokenizer_path()
    tokenizer, memo = Tokenizer.from_file(path), packing.word_memo(path)
    points = [c for c in range(0x3100) if not 0xD800 <= c < 0xE000]
    texts = [f"ab {chr(c)} c{chr(c)}d e{chr(c)} {chr(c)}f{chr(c)}{chr(c)}" for c in points]
    for c, ids, whole in zip(points, memo(texts), tokenizer.encode_batch(texts, add_special_tokens=False)):
        assert np.frombuffer(ids, "<u4").tolist() == whole.ids, hex(c)
