"""Byte-level BPE by tries against the tokenizers library, and against plain merging."""

import hashlib
import random
from functools import lru_cache

import numpy as np
from pyspark.sql import functions as F

from tessera.llm import bytebpe


@lru_cache
def library():
    from tokenizers import Tokenizer

    made = Tokenizer.from_file(bytebpe.model_path())
    made.no_padding()
    made.no_truncation()
    return made


def odd_texts(n=200):
    rnd = random.Random(3)
    letter = lambda: chr(rnd.choice([rnd.randrange(32, 127), rnd.randrange(160, 0x500), rnd.randrange(0x4E00, 0x4F00), rnd.randrange(0x1F300, 0x1F700), 10, 32, 32]))
    texts = ["".join(letter() for _ in range(rnd.randrange(1, 300))) for _ in range(n)]
    runs = ["aaaa", "aaa", "ababab", "the", " ", "===", "....", "!!!!", "\n\n", "1234567", "000000"]
    texts += [" ".join(rnd.choice(runs) * rnd.randrange(1, 9) for _ in range(30)) for _ in range(n)]
    return texts + [None, "", " ", "<|endoftext|>", "a<|endoftext|>b <|endoftext|><|endoftext|>", "<|endoftext", "x" * 5000, "-" * 3000, " " * 777 + "a", "　 x\x1cy\x85z᠎​﻿", "l'l 's're'VE", "\U000323b0x ࢏"]


def test_ids_and_texts_equal_the_library(spark):
    texts = odd_texts()
    df = spark.createDataFrame([(k % 7 or None, t, k) for k, t in enumerate(texts)], "doc_id long, text string, ids int").repartition(4)
    got = bytebpe.encode(df, bytebpe.model_path())
    assert got.columns == ["doc_id", "ids", "decoded"]
    want = sorted(([x.ids, t or ""] for x, t in zip(library().encode_batch([t or "" for t in texts], add_special_tokens=False), texts)), key=str)
    assert sorted(([r["ids"], r["decoded"]] for r in got.collect()), key=str) == want
    back = bytebpe.decode(got, bytebpe.model_path()).collect()
    assert sorted(r["text"] for r in back) == sorted(t or "" for t in texts)


def test_words_are_cut_alike_for_every_character():
    """All code points, each after and before letters, numbers and signs."""
    encoder, pre = bytebpe.Encoder, library().pre_tokenizer
    for c in [*range(0xD800), *range(0xE000, 0x110000)]:
        text = f"a{chr(c)}1{chr(c)}!{chr(c)} {chr(c)}"
        assert [len(w) for w in encoder.words(text)] == [b - a for _, (a, b) in pre.pre_tokenize_str(text)], hex(c)


def test_trie_equals_plain_merging():
    rnd = random.Random(5)
    vocabulary = bytebpe.encoder(bytebpe.model_path()).vocabulary
    words = {"".join(rnd.choice("abcdehilnorstu ='-0é") for _ in range(rnd.randrange(1, 14))).encode() for _ in range(6000)} | {b"a" * k for k in range(1, 80)}
    got = dict(vocabulary.encode_words(words))
    assert set(got) == words and all(got[w] == vocabulary.merged(w) for w in words)


def test_neighbours_equal_plain_merging():
    rnd = random.Random(6)
    vocabulary = bytebpe.encoder(bytebpe.model_path()).vocabulary
    common = [t for t in range(50_000) if vocabulary.own(t) and len(vocabulary.bytes[t]) < 7]
    for _ in range(20_000):
        a, b = rnd.choice(common), rnd.choice(common)
        assert vocabulary.neighbours(a, b) == (vocabulary.merged(vocabulary.bytes[a] + vocabulary.bytes[b]) == [a, b])


def test_forgotten_words_are_learned_again(monkeypatch):
    monkeypatch.setattr(bytebpe, "MEMO", 50)
    monkeypatch.setattr(bytebpe, "PAIRS", 20)
    encoder, texts = bytebpe.Encoder(bytebpe.model_path()), odd_texts(40)
    for block in ([texts[0]], texts[:3], texts):
        got = [np.frombuffer(b, "<i4").tolist() for b in encoder(block)]
        assert got == [x.ids for x in library().encode_batch([t or "" for t in block], add_special_tokens=False)]


def test_decoding_bytes_that_are_no_utf8(spark):
    rows = [(1, [447, 50256, 220]), (2, []), (3, None), (4, [26525, 250])]
    got = {r["doc_id"]: r["text"] for r in bytebpe.decode(spark.createDataFrame(rows, "doc_id long, ids array<int>"), bytebpe.model_path()).collect()}
    assert got == {i: None if ids is None else library().decode(ids, skip_special_tokens=False) for i, ids in rows}


def test_query_and_empty_table(spark, tmp_path):
    texts = odd_texts(20)
    spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    got = {r["doc_id"]: r for r in bytebpe.op12_trie_bpe(spark, str(tmp_path)).collect()}
    for k, text in enumerate(texts):
        ids = library().encode(text or "", add_special_tokens=False).ids
        decoded = library().decode(ids, skip_special_tokens=False)
        want = (len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256(decoded.encode()).hexdigest())
        assert (got[k]["n_tokens"], got[k]["ids_sha256"], got[k]["decoded_sha256"]) == want
    empty = spark.createDataFrame([], "doc_id long, text string").where(F.lit(True))
    assert bytebpe.encode(empty, bytebpe.model_path()).count() == 0
