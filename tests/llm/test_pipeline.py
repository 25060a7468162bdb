import zlib

import numpy as np

import corpus_pipeline
from tests.llm import brute
from tests.llm.conftest import SCHEMA, make_docs


def test_pipeline_against_plain_stages(spark, tmp_path):
    """Each stage is judged on what the one before it kept."""
    from tokenizers import Tokenizer

    from tessera.llm import packing, quality

    rows = make_docs(seed=11, n=160)
    spark.createDataFrame(rows, SCHEMA).write.parquet(f"{tmp_path}/documents.parquet")
    docs = {r[0]: r[1] for r in rows}
    docs = {i: t for i, t in docs.items() if brute.quality_verdict(t, quality.THRESHOLDS, quality.STOP_WORDS)}
    keep = brute.exact(docs.items())
    docs = {i: t for i, t in docs.items() if keep[i][0] == i}
    classes = brute.near(list(docs.items()))
    docs = {i: t for i, t in docs.items() if classes[i][0] == i}
    cut = brute.substring(list(docs.items()))
    docs = {i: " ".join(cut[i][2]) if cut[i][1] else t for i, t in docs.items()}
    tokenizer = Tokenizer.from_file(packing.tokenizer_path())
    want = {}
    for i, t in docs.items():
        ids = np.array([*tokenizer.encode(t, add_special_tokens=False).ids, 1], "<u4")
        want[i] = (len(ids), zlib.crc32(ids.tobytes()))
    got = corpus_pipeline.run(spark, str(tmp_path)).collect()
    assert {r["doc_id"]: (r["doc_tokens"], r["ids_crc32"]) for r in got} == want
    assert len(corpus_pipeline.STAGES) == 5 and all(len(s) == 2 for s in corpus_pipeline.STAGES)


def test_pipeline_on_an_empty_table(spark, tmp_path):
    spark.createDataFrame([], SCHEMA).write.parquet(f"{tmp_path}/documents.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0


REPEATED = "one two three four five six seven eight nine ten eleven twelve thirteen fourteen fifteen"


def test_stages_with_repeated_rows_ids_nulls_and_clashing_names(spark):
    """Every stage sees rows, not ids: none is lost or multiplied, and columns keep their names and values."""
    from tessera.llm import exact, ngram_join, quality, substring

    taken = ["kept", "base_failed", "failed_rules", "quality_measures", "kept_text", "row_key", "text_sha256", "keep_id", "row", "class_id", "stays", "salt", "place", "whole", "digest"]
    other = "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu nu xi omicron the of and"
    rows = [(5, REPEATED), (5, REPEATED), (5, other), (6, other), (None, REPEATED), (None, "x y"), (7, None), (7, ""), (8, "x y")]
    df = spark.createDataFrame([(i, t, "en", "s", 3, *["mine"] * len(taken)) for i, t in rows], SCHEMA + "".join(f", {c} string" for c in taken))
    texts = lambda out: sorted(((r["doc_id"], r["text"]) for r in out.collect()), key=str)
    once = sorted([(5, REPEATED), (5, other), (7, None), (8, "x y")], key=str)
    for module in (quality, exact, ngram_join, substring):
        out = module.stage(spark, df, "")
        assert out.columns == df.columns and all(r[c] == "mine" for r in out.collect() for c in taken)
    got = texts(exact.stage(spark, df, ""))
    # of the null and the empty text with id 7 either stays
    assert [(i, t or None) for i, t in got] == once
    near = texts(ngram_join.stage(spark, df, ""))
    assert [r for r in near if r[0] != 7] == [r for r in once if r[0] != 7] and len([r for r in near if r[0] == 7]) == 2
    cut = texts(substring.stage(spark, df, ""))
    assert cut == sorted([(5, REPEATED), (5, REPEATED), (5, other), (6, ""), (None, ""), (None, "x y"), (7, None), (7, ""), (8, "x y")], key=str)
    assert len(texts(quality.stage(spark, df, ""))) == 5


def test_classes_of_repeated_and_null_ids(spark):
    from tessera.llm import exact, ngram_join

    words = REPEATED.split()
    near = " ".join([*words, *(f"n{k}" for k in range(30))])
    rows = [(3, near), (3, near + " end"), (9, near), (None, near), (3, "apart from all the others here"), (None, "alone on its own as well")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = sorted(((r["doc_id"], r["class_id"], r["n_links"], r["n_copies"], r["stays"]) for r in ngram_join.classes(df).collect()), key=str)
    want = [(3, 3, 3, 3, True), (3, 3, 3, 1, False), (9, 3, 3, 3, False), (None, 3, 3, 3, False), (3, 3, 0, 1, True), (None, None, 0, 1, True)]
    assert got == sorted(want, key=str)
    kept = sorted(((r["doc_id"], r["keep_id"], r["group_size"], r["kept"]) for r in exact.dedup(df).collect()), key=str)
    assert kept == sorted([(3, 3, 3, True), (3, 3, 1, True), (9, 3, 3, False), (None, 3, 3, False), (3, 3, 1, True), (None, None, 1, True)], key=str)


def test_chunks_follow_content_in_any_script(spark):
    """After a changed beginning the cuts fall where they fell before, in text without spaces too."""
    import random

    from tessera.llm import exact

    rnd = random.Random(4)
    for low, high in ((0x4E00, 0x9000), (0x61, 0x7B), (0x430, 0x450)):
        text = "".join(chr(rnd.randrange(low, high)) for _ in range(30_000))
        df = spark.createDataFrame([(1, text), (2, text[7:])], "doc_id long, text string")
        a, b = (r["c"] for r in df.select(exact.chunks(exact.normalised(df.text)).alias("c"), "doc_id").orderBy("doc_id").collect())
        assert len(a) > 10 and len(set(a) & set(b)) > 0.5 * len(a), (low, len(a), len(set(a) & set(b)))
        assert "".join(a).encode("latin-1").decode() == text
