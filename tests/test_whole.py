"""Queries over all their rows: fixtures with rows that a filter would lose, against plain versions."""

import hashlib
import itertools
import math
import re
from collections import Counter

from tessera.functions.text import STOP_WORDS
from tessera.operators import panel
from tessera.plans import registry


def write(df, folder, name):
    df.write.parquet(f"{folder}/{name}.parquet")


def run(spark, name, folder):
    return registry.queries()[name](spark, str(folder)).collect()


def bag(text, stop=()):
    return Counter(w for w in (t.lower() for t in re.findall("[A-Za-z0-9]+", text)) if w not in stop)


def cosine(a, b):
    dot = sum(n * b[w] for w, n in a.items())
    return dot and dot / math.sqrt(sum(n * n for n in a.values()) * sum(n * n for n in b.values()))


def test_cosine_of_all_pairs(spark, tmp_path):
    items = [(i, f"w{i % 3} common w{i % 5}") for i in (1, 2, 7, 25, 30, 41)]
    write(spark.createDataFrame(items, "item_id long, text string"), tmp_path, "benchmark")
    want = {(a, b): round(cosine(bag(x), bag(y)), 6) for (a, x), (b, y) in itertools.combinations(items, 2)}
    assert {(r["s"], r["t"]): r["cosine"] for r in run(spark, "p20_cosine", tmp_path)} == want


def documents(spark, folder):
    """Long and short texts, and other documents of the query set among the targets."""
    texts = {i: f"word{i % 4} apple {'filler ' * (i % 3) * 100}word{i % 7}" for i in [*range(1, 40), 50, 100, 200, 300]}
    rows = [(i, t, "en" if i % 5 else "de", f"s{i % 4}", len(t)) for i, t in texts.items()]
    write(spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long"), folder, "documents")
    return rows


def scored(rows):
    """Source: (similarity, target) of each eligible document."""
    stop, out = set(STOP_WORDS), {}
    for i, text, lang, source, n in rows:
        if i % 100:
            continue
        act, out[i] = f"b{i % 3}", []
        for j, other, lang2, source2, m in rows:
            if lang2 != lang or source2 == source or f"b{j % 3}" != act:
                continue
            a, b = {lang, f"s{n % 4}"}, {lang2, f"s{m % 4}"}
            similarity = 0.5 * cosine(bag(text, stop), bag(other, stop)) + 0.5 * len(a & b) / len(a | b)
            if similarity >= 0.05:
                out[i].append((-round(similarity, 6), j))
    return out


def test_neighbours_among_all_documents(spark, tmp_path):
    want = scored(documents(spark, tmp_path))
    got = {}
    for r in run(spark, "j6_cross_cluster_neighbours", tmp_path):
        got.setdefault(r["source_id"], []).append((-r["similarity"], r["target_id"], r["eligible"]))
    assert {s: sorted(x) for s, x in got.items()} == {s: [(*p, min(len(x), 10)) for p in sorted(x)[:10]] for s, x in want.items() if len(x) >= 5}
    assert {r["source_id"]: r["eligible"] for r in run(spark, "l4_neighbour_attrition", tmp_path)} == {s: len(x) for s, x in want.items() if len(x) < 5}


def test_neighbours_without_a_common_token(spark, tmp_path):
    """They count by their actions alone; at a threshold of 0, as any of the stratum that admits the action."""
    s = spark.createDataFrame([(1, "g1", "t", "zzz", "go", ["go", "x"])], "unit_id long, cluster_id string, stratum string, text string, action string, actions array<string>")
    t = spark.createDataFrame([(10, "g2", "t", "red", ["go", "x", "go"]), (11, "g2", "t", "", ["go"]), (12, "g1", "t", "red", ["go", "x"]), (13, "g3", "t", "red", ["x"]), (14, "g3", "u", "red", ["go", "x"])], "unit_id long, cluster_id string, stratum string, text string, actions array<string>")
    for least, weight, want in [(0.05, 0.5, [(10, 0.5)]), (0.0, 0.5, [(10, 0.5), (11, 0.0)]), (0.0, 1.0, [(10, 0.0), (11, 0.0), (13, 0.0)]), (0.05, 1.0, [])]:
        found, few = panel.neighbours(s, t, 5, 1, least, weight)
        assert [(r["target_id"], r["similarity"]) for r in found.orderBy("rn").collect()] == want
        assert few.count() == (not want)


def test_random_neighbours_of_other_clusters(spark, tmp_path):
    """Six each, though most customers share the nation of most sources."""
    rows = [(i, f"seg{i % 2}", 0 if i % 3 else i % 5) for i in range(1, 401)]
    write(spark.createDataFrame(rows, "c_custkey long, c_mktsegment string, c_nationkey int"), tmp_path, "customer")
    place = lambda i: (hashlib.sha256(f"42|{i}".encode()).hexdigest(), i)
    want = {(i, t) for i, seg, nat in rows if i % 100 == 0 for t in sorted((j for j, other, n in rows if j % 100 and other == seg and n != nat), key=place)[:6]}
    assert len(want) == 24 and {(r["s"], r["t"]) for r in run(spark, "g15_random_neighbours", tmp_path)} == want


def test_log_of_all_events(spark, tmp_path):
    write(spark.createDataFrame([(i, i / 8) for i in range(0, 400, 7)], "event_id long, value double"), tmp_path, "events")
    got = sorted((r["cluster"], r["step"], r["loss"]) for r in run(spark, "s12_training_log", tmp_path))
    assert got == sorted((f"n{i % 3}", i % 50, i / 8) for i in range(0, 400, 7))


def test_alignment_of_short_and_long_sequences(spark, tmp_path):
    sizes = {1: 1, 2: 2, 3: 8, 4: 12}
    rows = [(o, i, i, i, 1.0, i / 8) for o, n in sizes.items() for i in range(1, n + 1)]
    write(spark.createDataFrame(rows, "l_orderkey long, l_linenumber int, l_partkey long, l_suppkey long, l_quantity double, l_discount double"), tmp_path, "lineitem")
    got = {r["l_orderkey"]: (r["n"], r["total"], r["width"]) for r in run(spark, "p39_score_alignment", tmp_path)}
    assert got == {o: (n, n * (n - 1) / 16, 12) for o, n in sizes.items()}


def test_budgets_are_checked_without_gathering_draws(spark):
    """Units without draws, and with too many; the violations' plan has no arrays of draws."""
    import io
    from contextlib import redirect_stdout

    from tessera.plans import jobs

    units = lambda *ids: spark.createDataFrame([(i,) for i in ids], "unit_id long")
    draws = spark.createDataFrame([(u, k, "a", k % 2 == 0) for u, n in {1: 2, 2: 3, 4: 2}.items() for k in range(n)], "unit_id long, sample int, action string, valid boolean")
    made = jobs.annotate(units(1, 2, 3, 4), units(1, 2, 3, 9), draws, 2)
    assert sorted((r["code"], r["key"]) for r in made["violations"].collect()) == [("absent_from_pool", "9"), ("budget_identity", "2"), ("budget_identity", "3")]
    assert {r["unit_id"]: [d["sample"] for d in r["draws"]] for r in made["records"].collect()} == {1: [0, 1], 2: [0, 1, 2], 3: []}
    out = io.StringIO()
    with redirect_stdout(out):
        made["violations"].explain()
    assert "collect_list" not in out.getvalue()


def shown(df):
    import io
    from contextlib import redirect_stdout

    out = io.StringIO()
    with redirect_stdout(out):
        df.explain()
    return out.getvalue()


def test_scores_are_gathered_in_bounded_parts(spark, tmp_path, monkeypatch):
    """As many parts as the lines need, and once: the checks and the result read what was gathered."""
    from tessera.operators import ranking
    from tessera.plans import jobs

    monkeypatch.setattr(ranking, "GROUPED", 50)
    write(spark.createDataFrame([(k // 4, float(k % 4)) for k in range(400)], "l_orderkey long, l_quantity double"), tmp_path, "lineitem")
    write(spark.createDataFrame([(k, k % 7) for k in range(100)], "o_orderkey long, o_custkey long"), tmp_path, "orders")
    pools, real = [], jobs.score_units
    monkeypatch.setattr(jobs, "score_units", lambda pool: pools.append(pool) or real(pool))
    rows = registry.queries()["q3_score_units"](spark, str(tmp_path))
    assert re.search(r"hashpartitioning\(unit_id#\d+L?, 8\), REPARTITION_BY_NUM", shown(pools[0])) and "collect_list" not in shown(rows)
    assert {(r["actions"], r["score"]) for r in rows.collect()} == {(4, round(-sum(p * math.log(p) for p in (math.exp(x) / sum(map(math.exp, range(4))) for x in range(4))), 6))}


RECORDS = "unit_id long, cluster_id string, base_value string, draws array<struct<action: string, valid: boolean>>"


def test_training_rows_come_from_one_pass_over_the_records(spark):
    """Split passes, checks and both sides read what was written; counts by hand."""
    from tessera.plans import jobs

    rows = [(k, f"c{k % 10}", "a", [("a", True), ("b", k % 3 > 0)]) for k in range(60)]
    made = jobs.build_training(spark.createDataFrame(rows, RECORDS), val_fraction=0.2)
    assert not any("ExistingRDD" in shown(df) for df in made.values())
    told = {name: (df.count(), df.select("cluster_id").distinct().count(), round(df.selectExpr("sum(weight)").first()[0], 6)) for name, df in made.items() if name != "acceptance"}
    assert (told["train"][1:], told["validation"][1:]) == ((8, 8.0), (2, 2.0)) and told["train"][0] + told["validation"][0] == 100


def test_positions_read_their_totals(spark):
    from tessera.plans import jobs

    replays = spark.createDataFrame([(k, f"c{k % 6}", 1.0, k % 2, (k % 4 == 1) + 0) for k in range(48)], "unit_id long, cluster_id string, incl_prob double, disagreement int, consequence int")
    population = replays.groupBy("cluster_id").agg({"unit_id": "count"}).withColumnRenamed("count(unit_id)", "n_units")
    made = jobs.positions(replays, population, 20)
    assert not any("ExistingRDD" in shown(made[name]) for name in ("designed", "given_disagreement", "interval"))
    assert made["given_disagreement"].first()["estimate"] == 0.5
    assert "lineitem" not in shown(registry.queries()["q17_positions"](spark, "/root/testdata/sf0.001"))
