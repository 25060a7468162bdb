"""Null ids, repeated rows, very long texts, rare kinds and clashing names, for the operators without such tests elsewhere."""

import random

import pytest
from pyspark.sql import functions as F

from tessera.llm import packing, shard, substring, subword, toxicity, urlfilter
from tests.llm.conftest import make_docs

DOC = "doc_id long, text string"


def test_substring_with_null_and_repeated_ids(spark):
    passage = " ".join(f"w{k}" for k in range(20))
    rows = [(None, passage), (None, passage + " x"), (4, passage), (4, passage), (2, "y " + passage), (None, None)]
    got = sorted(((r["doc_id"], r["n_words"], r["n_removed"]) for r in substring.dedup(spark.createDataFrame(rows, DOC)).collect()), key=str)
    assert got == sorted([(None, 20, 20), (None, 21, 20), (4, 20, 20), (4, 20, 20), (2, 21, 0), (None, 0, 0)], key=str)


def test_segments_of_one_digest_are_told_apart():
    import numpy as np

    words = np.array([1, 2, 3, 1, 2, 3, 1, 2, 4, 1, 2], np.uint64)
    start, length = np.array([0, 3, 6, 9]), np.array([3, 3, 3, 2])
    first, of = substring.alike(np.zeros(4, np.uint64), start, length, words)
    assert of[0] == of[1] and len({of[0], of[2], of[3]}) == 3 and len(first) == 3


def test_packing_and_subwords_with_null_ids_and_long_texts(spark):
    rows = [(None, "a b c"), (None, "a b c"), (3, None), (3, "x " * 70_000), (None, None)]
    df = spark.createDataFrame(rows, DOC)
    pieces = packing.pack_documents(df, packing.tokenizer_path()).collect()
    assert sum(r["doc_id"] is None for r in pieces) == 3 and max(r["length"] for r in pieces) == 2048
    assert sum(r["length"] for r in pieces if r["doc_id"] == 3) == 70_002
    encoded = subword.encode(df, subword.model_path()).collect()
    assert len(encoded) == 5 and all(r["lossless"] in (True, None) for r in encoded)


def test_toxicity_with_odd_labels_and_long_texts(spark):
    rnd = random.Random(2)
    rows, labels = [], []
    for k in range(400):
        bad = k % 5 == 0
        words = [rnd.choice(["river", "stone", "cloud", "table", "green", "seven"]) for _ in range(30)] + (["vilename"] * 2 if bad else [])
        rows.append((k, " ".join(rnd.sample(words, len(words)))))
        labels.append((k, 7 if bad else 0))
    rows += [(5, rows[5][1]), (None, "river stone"), (1001, "stone vilename " * 40_000), (1002, None), (1003, "")]
    labels += [(5, None), (5, 0), (None, 1)]
    docs, marks = spark.createDataFrame(rows, DOC), spark.createDataFrame(labels, "doc_id long, toxic int")
    lexicon = toxicity.learn(docs, marks)
    assert any("viiename"[:4] in x for x in lexicon.weights)
    got = [(r["doc_id"], r["score"]) for r in toxicity.score(docs, lexicon).collect()]
    assert len(got) == len(rows) and all(0 <= s <= 1 for _, s in got)
    by = dict(got)
    assert by[1001] > 0.5 and by[1002] == by[1003] < 0.5
    assert sum((by[k] > 0.5) == (k % 5 == 0) for k in range(400)) > 380


def test_matches_inside_exceptions_are_spared_in_linear_time():
    lexicon = toxicity.Lexicon({" bad ": 2.0}, [" not bad ", " bad luck "])
    assert [s for s, _, _ in lexicon.matches(" not bad bad luck bad end ")] == [17]
    text = toxicity.folded("not bad and bad " * 60_000)
    assert len(lexicon.matches(text)) == 60_000


def test_labelled_rows_hold_a_rare_kind(spark):
    docs = spark.range(3000).select(F.col("id").alias("doc_id"), F.lit("t").alias("text"))
    marks = spark.range(3000).select(F.col("id").alias("doc_id"), (F.col("id") % 500 == 3).cast("int").alias("toxic"))
    kinds = {r["toxic"]: r["count"] for r in toxicity.labelled(docs, marks, most=50, least=4).groupBy("toxic").count().collect()}
    assert kinds[1] == 4 and kinds[0] >= 46


def pages(spark, n=900):
    rnd = random.Random(6)
    hosts = ["".join(rnd.choice(["ti", "on", "the", "er", "ha"]) for _ in range(3)) for _ in range(60)]
    urls = [f"http://{rnd.choice(['www.', 'm.', ''])}{rnd.choice(hosts)}.example.{rnd.choice(['com', 'org'])}/{rnd.choice(['fr', 'it'])}/{rnd.randrange(9999)}" for _ in range(n)]
    urls += [f"https://{rnd.choice(['casino-win', 'free-bets', 'cheap-pills'])}.example.com/fr/{rnd.randrange(9999)}" for _ in range(60)]
    return spark.createDataFrame(list(enumerate(urls)), "page_id long, url string")


def test_trees_find_hosts_whose_seed_was_withheld(spark):
    df = pages(spark)
    for seed in ("casino", "pills"):
        r = urlfilter.withheld(df, seed)
        r = r.first()
        assert r["bad"] and r["found"] >= 0.9 * r["bad"] and r["spared"] >= 0.95 * r["good"], (seed, r)


def test_a_rare_kind_of_url_is_in_the_sample(spark):
    rows = urlfilter.featured(pages(spark, 900).where("page_id < 903"))
    kinds = {r["label"]: r["count"] for r in urlfilter.labelled(rows, most=40).groupBy("label").count().collect()}
    assert kinds == {1.0: 3, 0.0: 20}


def test_url_edges(spark):
    rows = [(1, "http://x.test/" + "a/" * 30_000), (1, "http://x.test/" + "a/" * 30_000), (None, None), (None, "http://free-bets.test/?" + "a=b&" * 5_000)]
    got = urlfilter.judge(spark.createDataFrame(rows, "page_id long, url string")).collect()
    assert len(got) == 4 and all(r["verdict"] in ("allow", "block") for r in got)


def test_shards_are_pruned_by_every_dimension(spark, tmp_path):
    rnd = random.Random(9)
    rows = [(k, "x" * rnd.choice([3, 40, 900, 5000]), rnd.choice("abcdefgh"), f"s{rnd.randrange(40)}", 1, "mine") for k in range(2400)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, shard string")
    ranges = shard.written(df, str(tmp_path / "out"))
    assert ranges.count() == 24 and ranges.agg(F.sum("rows")).first()[0] == 2400
    files = spark.read.parquet(str(tmp_path / "out" / "shards"))
    assert set(df.columns) < set(files.columns) and files.count() == 2400
    for wanted in ({"lang": "c"}, {"source": "s7"}, {"size": (0, 20)}, {"lang": "b", "size": (4000, 9000)}):
        read = [r["shard"] for r in shard.pruned(ranges, **wanted).collect()]
        assert len(read) <= 16, (wanted, read)
        test = F.lit(True)
        for name, value in wanted.items():
            c = F.octet_length("text") + 8 if name == "size" else F.col(name)
            test = test & (c.between(*value) if isinstance(value, tuple) else c == value)
        assert files.where(test & F.col("__shard").isin(read)).count() == df.where(test).count() > 0


@pytest.mark.parametrize("few", [10_000, 3])
def test_cells_are_equal_parts_of_the_values(spark, few, monkeypatch):
    monkeypatch.setattr(shard, "FEW", few)
    df = spark.createDataFrame([(k, f"v{k % 62:03}" if k else None) for k in range(400)], "doc_id long, lang string")
    cells = {r["lang"]: r["cell_lang"] for r in shard.with_cells(df, "lang").collect()}
    assert shard.with_cells(df, "lang").count() == 400 and cells[None] == 0
    assert [cells[f"v{k:03}"] for k in range(62)] == [1 + k // 2 for k in range(62)]


def test_docs_of_other_seeds_survive_the_operators(spark):
    df = spark.createDataFrame(make_docs(seed=33, n=40), "doc_id long, text string, lang string, source string, n_chars long")
    assert shard.assign(df).count() == df.count()


def test_toxicity_on_rows_held_out_of_the_fit(spark):
    """On the larger test table: of rows that the fit didn't read, most toxic ones are found and few others are named."""
    from pathlib import Path

    folder = Path("/root/testdata/sf0.1")
    if not folder.exists():
        pytest.skip("no test tables")
    labels = spark.read.parquet(str(folder / "labels.parquet")).select("doc_id", F.col("toxic").alias("truth"))
    got = toxicity.op7_toxicity(spark, str(folder)).join(labels, "doc_id").where("held_out").groupBy("truth", "predicted").count().collect()
    n = {(r["truth"], r["predicted"]): r["count"] for r in got}
    assert n[1, 1] >= 0.8 * (n[1, 1] + n.get((1, 0), 0)) and n[1, 1] >= 0.9 * (n[1, 1] + n.get((0, 1), 0)), n


def test_hosts_paths_and_rules_against_sql(spark):
    """The whole pages table, and odd URLs, judged by SQL over the same rules; the verdict of a ruled URL is its rule's."""
    from pathlib import Path

    import duckdb
    import pyarrow as pa
    from tests.llm.test_native import URLS

    folder = Path("/root/testdata/sf0.01")
    rows = [(-1 - k, u) for k, (u, _, _) in enumerate(URLS)]
    rows += [(-100, "://x.COM/en/7"), (-101, "a://b://c.net/de/8"), (-102, "http://É.example.com/en/7?/en/"), (-103, "http:///en/"), (-104, "http://a.com#/en/"), (-105, "http://x\n.org/es/\ny")]
    if folder.exists():
        rows += [(r["page_id"], r["url"]) for r in spark.read.parquet(str(folder / "pages.parquet")).select("page_id", "url").collect()]
    fits = " ".join(
        f"WHEN (host = '{h}' OR ends_with(host, '.{h}')) AND starts_with(path, '{p}') THEN '{v}|{h}{p}'" for v, h, p in sorted(urlfilter.RULES, key=lambda r: -len(r[1] + r[2]))
    )
    sql = f"""WITH r AS (SELECT page_id, CASE WHEN contains(url, '://') THEN substr(url, instr(url, '://') + 3) END rest FROM pages),
     s AS (SELECT page_id, coalesce(translate(regexp_extract(rest, '^([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '') host, coalesce(regexp_extract(rest, '^[^/?#]*([^?#]*)', 1), '') path FROM r)
     SELECT page_id, host, path, CASE {fits} END told FROM s"""
    duck = duckdb.connect()
    duck.register("pages", pa.table({"page_id": pa.array([k for k, _ in rows], pa.int64()), "url": pa.array([u for _, u in rows], pa.string())}))
    want = {k: (host, path, told) for k, host, path, told in duck.execute(sql).fetchall()}
    got = urlfilter.judge(spark.createDataFrame(rows, "page_id long, url string")).collect()
    assert len(got) == len(want)
    for r in got:
        host, path, told = want[r["page_id"]]
        assert (r["host"], r["path"], r["rule"]) == (host, path, told and told.split("|")[1]), r
        assert told is None or r["verdict"] == told.split("|")[0]
