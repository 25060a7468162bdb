"""Values worked out by hand, and properties that hold for any partitioning."""

import math

import pytest
from pyspark.sql import functions as F

from tessera.functions import arrays, canon, rng, text
from tessera.operators import bootstrap, checks, estimators, history, panel, regression, sampling, vectors, weights


def turns(spark, n=8, cluster="g"):
    return spark.createDataFrame([(cluster, f"s{i}", i) for i in range(n)], "cluster_id string, unit_id string, seq int")


def one(df):
    return df.first()[0]


def test_selection_probability_and_nesting(spark):
    t = turns(spark)
    small, large = (sampling.nested_selection(t, k).collect() for k in (1, 3))
    assert {r["incl_prob"] for r in small} == {1 / 8} and {r["incl_prob"] for r in large} == {3 / 8}
    assert {r["unit_id"] for r in small} <= {r["unit_id"] for r in large}
    assert {r["incl_prob"] for r in sampling.nested_selection(turns(spark, 2), 5).collect()} == {1.0}
    assert sampling.nested_selection(t, 0).count() == 0
    moved = sampling.nested_selection(t.repartition(5).orderBy(F.desc("seq")), 3).collect()
    assert {r["unit_id"] for r in moved} == {r["unit_id"] for r in large}


def test_selection_cuts_before_the_shuffle(spark):
    plan = sampling.nested_selection(turns(spark), 3)._jdf.queryExecution().executedPlan().toString()
    assert "WindowGroupLimit" in plan


def test_top_score(spark):
    t = spark.createDataFrame([("g", 0, 0.1), ("g", 1, 0.9), ("g", 2, 0.9)], "cluster_id string, seq int, score double")
    r = sampling.top_score(t, 1, "score", "seq").collect()
    assert [(x["seq"], x["incl_prob"]) for x in r] == [(1, None)]


def test_entropy_of_equal_large_scores(spark):
    df = spark.createDataFrame([([10000.0, 10000.0],), ([3.0],)], "s array<double>").select(arrays.softmax_entropy(F.col("s")).alias("h")).collect()
    assert math.isclose(df[0]["h"], math.log(2)) and abs(df[1]["h"]) < 1e-12


def records(spark):
    go, look, bad = ("go", True), ("look", True), ("x", False)
    rows = [("g1", "t0", "go", [go, look]), ("g1", "t1", "look", [bad, go]), ("g2", "t0b", "go", [go]), ("g3", "t9", "go", [bad])]
    return spark.createDataFrame(rows, "cluster_id string, unit_id string, base_value string, draws array<struct<action:string,valid:boolean>>")


def test_weights(spark):
    rows = weights.training_rows(records(spark)).orderBy("unit_id", "sample_index").collect()
    assert [r["weight"] for r in rows] == [0.25, 0.25, 1.0, 0.5]
    assert [(r["unit_id"], r["sample_index"]) for r in rows] == [("t0", 0), ("t0", 1), ("t0b", 0), ("t1", 1)]
    assert [r["disagreement"] for r in rows] == [False, True, False, True]
    assert checks.sums_to_one(weights.training_rows(records(spark)), "cluster_id", "weight").count() == 0
    assert {r["weight"] for r in weights.training_rows(records(spark), "sample_mean").collect()} == {1.0}
    with pytest.raises(ValueError):
        weights.training_rows(records(spark), "other")


def test_acceptance(spark):
    rows = {r["cluster_id"]: r for r in weights.acceptance(records(spark)).collect()}
    assert rows["g3"]["retained"] is False and rows["g1"]["draw_rate"] == 0.75
    assert rows[None]["is_total"] == 1 and rows[None]["valid_units"] == 3 and rows[None]["calls"] == 6


def test_disagreement_is_null_without_a_valid_draw(spark):
    got = {r["unit_id"]: r["d"] for r in records(spark).select("unit_id", estimators.disagreement(F.col("draws"), F.col("base_value")).alias("d")).collect()}
    assert got == {"t0": True, "t1": True, "t0b": False, "t9": None}


def test_split(spark):
    clusters = spark.createDataFrame([(f"c{i}", i % 2) for i in range(10)], "cluster string, stratum int")
    assert sampling.cluster_split(clusters, 0.25, "cluster").where("is_validation").count() == 2  # 2.5 to even
    by = sampling.cluster_split(clusters, 0.01, "cluster", "stratum").groupBy("stratum").agg(F.count_if("is_validation").alias("n")).collect()
    assert [r["n"] for r in by] == [1, 1]


def test_matching(spark):
    c = spark.createDataFrame([(f"a{i}", "a", 0) for i in range(4)] + [(f"b{i}", "b", 1) for i in range(3)], "sample_id string, task string, depth int")
    t = spark.createDataFrame([("a", 0), ("a", 0), ("b", 1)], "task string, depth int")
    picked, short = sampling.matched_sample(c, t, ["task", "depth"], "sample_id")
    assert {r["task"]: r["count"] for r in picked.groupBy("task").count().collect()} == {"a": 2, "b": 1} and short.count() == 0
    assert sampling.matched_sample(c.where("task = 'a'"), t, ["task", "depth"], "sample_id")[1].count() == 1


@pytest.mark.parametrize("n,replicas", [(5, 2), (1, 4), (8, 4), (3, 7)])
def test_padded_shards(spark, n, replicas):
    rows = sampling.padded_shards(spark.range(n), replicas, "id").collect()
    slots = -(-n // replicas)
    assert len(rows) == slots * replicas and sum(r["multiplier"] for r in rows) == n
    assert all(sum(r["rank"] == k for r in rows) == slots for k in range(replicas))


def test_balanced_pmf_and_js(spark):
    rows = spark.createDataFrame([("g1", "a")] * 100 + [("g2", "b")], "cluster_id string, v string")
    assert {r["v"]: r["p"] for r in estimators.balanced_pmf(rows, "v").collect()} == {"a": 0.5, "b": 0.5}
    p = estimators.balanced_pmf(rows, "v")
    assert one(estimators.jensen_shannon(p, p, "v")) == 0
    apart = estimators.jensen_shannon(p.where("v = 'a'").withColumn("p", F.lit(1.0)), p.where("v = 'b'").withColumn("p", F.lit(1.0)), "v")
    assert math.isclose(one(apart), math.log(2))


def test_common_support(spark):
    rows = spark.createDataFrame([("x", "g1"), ("x", "g2"), ("y", "g2"), ("y", "g3")], "arm string, cluster_id string")
    assert [r[0] for r in estimators.common_support(rows, "arm").collect()] == ["g2"]


def test_indicators_with_missing_values(spark):
    rows = spark.createDataFrame([("a", 1), ("a", None), ("b", 0), ("b", 1)], "cluster_id string, y int")
    r = estimators.balanced_indicator(rows, "y").first()
    assert (r["estimate"], r["clusters"], r["observed"], r["missing"]) == (0.75, 2, 3, 1)
    assert estimators.balanced_ratio(rows.withColumn("d", F.lit(1)), "y", "d").first()["estimate"] is None


def test_horvitz_thompson(spark):
    rows = spark.createDataFrame([("a", 1, 0.5), ("b", 1, 0.25), ("b", 0, 0.25)], "cluster_id string, y int, incl_prob double")
    population = spark.createDataFrame([("a", 4), ("b", 8)], "cluster_id string, n_units int")
    totals = estimators.cluster_totals(rows, population, {"y": "y"})
    assert one(estimators.ht_mean(totals, "y")) == 0.5
    refused = [
        estimators.cluster_totals(rows.withColumn("incl_prob", F.lit(None).cast("double")), population, {"y": "y"}),
        estimators.cluster_totals(rows.where("cluster_id = 'a'"), population, {"y": "y"}),
        estimators.cluster_totals(rows, population.where("cluster_id = 'a'"), {"y": "y"}),
    ]
    assert all(one(estimators.ht_mean(t, "y")) is None for t in refused)


@pytest.mark.parametrize("only_a,only_b,p", [(33, 17, 0.0328391), (4, 6, 0.7539062), (1, 1, 1.0), (0, 0, 1.0)])
def test_mcnemar(spark, only_a, only_b, p):
    rows = [(1, 0)] * only_a + [(0, 1)] * only_b + [(1, 1)] * 2
    got = estimators.mcnemar(spark.createDataFrame(rows, "a int, b int"), "a", "b").first()
    assert math.isclose(got["p_value"], p, abs_tol=1e-6) and got["both"] == 2


def test_crossed_bootstrap(spark):
    panel_rows = spark.createDataFrame([(s, g, 0.5) for s in range(2) for g in range(3)], "seed int, game int, x double")
    r = bootstrap.crossed(spark, panel_rows, "seed", "game", "x", 50).first()
    assert (r["estimate"], r["lower"], r["upper"]) == (0.5, 0.5, 0.5)
    fixed = spark.createDataFrame([(0, 0, 0.0), (0, 1, 1.0)], "seed int, game int, x double")
    r = bootstrap.crossed(spark, fixed, "seed", "game", "x", 400, resample_replicates=False).first()
    assert (r["lower"], r["upper"]) == (0.0, 1.0)


def test_ratio_bootstrap_redraws(spark):
    t = spark.createDataFrame([("a", 1.0, 1.0), ("b", 0.0, 0.0)], "cluster_id string, a double, b double")
    r = bootstrap.ratio(spark, t, "a", "b", "cluster_id", 40).first()
    assert (r["estimate"], r["lower"], r["upper"], r["kept"]) == (1.0, 1.0, 1.0, 40)


def test_draws_are_uniform_enough(spark):
    counts = [r["count"] for r in bootstrap.draws(spark, 400, 10, 1).groupBy("cluster_no").count().collect()]
    assert len(counts) == 10 and all(320 < c < 480 for c in counts)


def test_regression(spark):
    rows = [(i % 7, i % 2, (i * 5 % 11) / 11, i % 3) for i in range(120)]
    df = spark.createDataFrame(rows, "cluster int, c int, s double, k int").withColumn("y", 1 + 3 * F.col("c") + 2 * F.col("s") + 5 * F.col("s") * F.col("c"))
    terms = {"intercept": F.lit(1.0), "c": F.col("c"), "s": F.col("s"), "s_x_c": F.col("s") * F.col("c")}
    found = regression.fit(df, terms, F.col("y"), "cluster")
    assert abs(found["c"] - 3) < 1e-9 and abs(found["s_x_c"] - 5) < 1e-9
    r = regression.bootstrap(df, terms, F.col("y"), "cluster", ["s_x_c"], 30).first()
    assert abs(r["lower"] - 5) < 1e-7 and abs(r["upper"] - 5) < 1e-7 and r["kept"] == 30
    with pytest.raises(ValueError):
        regression.fit(df, terms | {"twice": 2 * F.col("c")}, F.col("y"), "cluster")


CASES = [
    ("Action: take apple", ["take apple 1", "take apple 2"], None, "not_admissible"), ("Action: put apple 1 in fridge 1", ["move apple 1 to fridge 1"], "move apple 1 to fridge 1", None), ("Action: look\nAction: go", ["look", "go"], None, "multiple_action_markers"),
    ("Action: heat apple 1 using microwave 1", ["heat apple 1 with microwave 1"], "heat apple 1 with microwave 1", None), ("", ["look"], None, "empty_content"), (None, ["look"], None, "empty_content"), ("look", ["look"], None, "missing_action_marker"),
    ("thinking\n action : `LOOK.`", [" look "], "look", None), ("Action: look", ["look", "Look"], None, "ambiguous_normalized_action"), ("Action: ..", ["look"], None, "empty_action"),
]


@pytest.mark.parametrize("said,allowed,action,failure", CASES)
def test_parse(spark, said, allowed, action, failure):
    p = spark.createDataFrame([(said, allowed)], "t string, a array<string>").select(text.parse_action(F.col("t"), F.col("a")).alias("p")).first()["p"]
    assert (p["action"], p["failure"], p["valid"]) == (action, failure, failure is None)


def test_parse_by_unique_prefix(spark):
    df = spark.createDataFrame([("Action: take", ["take apple 1", "look"]), ("Action: take", ["take a", "take b"])], "t string, a array<string>")
    got = [r["p"]["action"] for r in df.select(text.parse_action(F.col("t"), F.col("a"), True).alias("p")).collect()]
    assert got == ["take apple 1", None]


def test_similarities(spark):
    docs = spark.createDataFrame([(1, "apple apple fridge"), (2, "apple fridge fridge"), (3, "")], "k int, text string")
    counts = text.token_counts(docs, "k", "text")
    left, right = counts.where("k = 1").withColumnRenamed("k", "a"), counts.where("k = 2").withColumnRenamed("k", "b")
    assert math.isclose(text.cosine_by_index(left, right, "a", "b").first()["cosine"], 0.8)
    sets = spark.createDataFrame([([], []), (["a"], ["a", "b"])], "x array<string>, y array<string>").select(text.jaccard(F.col("x"), F.col("y")).alias("j")).collect()
    assert [r["j"] for r in sets] == [None, 0.5]


def test_neighbours(spark):
    s = spark.createDataFrame([(1, "g1", "t", "red apple", "go", ["go", "x"]), (2, "g1", "t", "zzz", "go", ["go"])], "unit_id long, cluster_id string, stratum string, text string, action string, actions array<string>")
    t = spark.createDataFrame([(10, "g2", "t", "red apple", ["go", "x"]), (11, "g1", "t", "red apple", ["go"]), (12, "g3", "t", "red pear", ["go"]), (13, "g4", "u", "red apple", ["go"]), (14, "g5", "t", "red apple", ["stay"])], "unit_id long, cluster_id string, stratum string, text string, actions array<string>")
    found, few = panel.neighbours(s, t, 5, 1, 0.0, 0.5)
    # at a threshold of 0 every target of the stratum that admits the action counts, with or without a common token
    assert [(r["source_id"], r["target_id"], round(r["similarity"], 6)) for r in found.orderBy("source_id", "rn").collect()] == [(1, 10, 1.0), (1, 12, 0.25), (2, 10, 0.0), (2, 12, 0.0)]
    assert few.count() == 0
    found, few = panel.neighbours(s, t, 5, 1, 0.2, 0.5)
    assert [(r["source_id"], r["target_id"]) for r in found.orderBy("rn").collect()] == [(1, 10), (1, 12)]
    assert [r["source_id"] for r in few.collect()] == [2]


@pytest.mark.parametrize("value,expected", [(-1, 0), (0, 0), (9.9, 4), (10, 4), (11, 4), (2, 1)])
def test_fixed_width_bin(spark, value, expected):
    assert one(spark.range(1).select(arrays.fixed_width_bin(F.lit(value), 0, 10, 5))) == expected


def test_previous_and_truncation(spark):
    t = spark.createDataFrame([("g", 0, "a"), ("g", 1, " "), ("g", 2, " "), ("g", 3, "bbbb")], "c string, seq int, o string")
    rows = history.previous(t, "o", "c", "seq").orderBy("seq").collect()
    assert [(r["repeat"], r["repeat_not_blank"]) for r in rows] == [(0, 0), (0, 0), (1, 0), (0, 0)]
    kept = history.truncated(t, "c", "seq", F.length("o"), 6).orderBy("seq").collect()
    assert [r["kept"] for r in kept] == [True, False, True, True] and not kept[0]["overflow"]
    assert history.truncated(t, "c", "seq", F.length("o"), 3).first()["overflow"]


def test_checks(spark):
    a, b = spark.createDataFrame([(1, 0.5), (2, 0.5)], "k int, p double"), spark.createDataFrame([(2, 0.6), (3, None)], "k int, p double")
    assert {(r["code"], r["key"]) for r in checks.same_rows(a, b, "k", {"p": 1e-12}).collect()} == {("missing", "1"), ("different_p", "2"), ("unexpected", "3")}
    with pytest.raises(checks.Violated):
        checks.enforce(checks.unique(a.unionAll(a), "k"))
    checks.enforce(checks.unique(a, "k"))
    assert checks.disjoint(a, b, "k").count() == 1 and checks.subset(a, b, "k").count() == 1
    assert checks.row_checks(b, F.col("k"), {"positive": F.col("p") > 0}).count() == 1


def test_config_difference():
    assert checks.config_difference({"a": {"b": 1, "c": 2}}, {"a": {"b": 1, "c": 3}, "d": 0}, {"d"}) == ["a.c"]


def test_vectors(spark):
    v = spark.createDataFrame([(1, [1.0, 0.0]), (1, [0.0, 1.0]), (2, [0.0, 0.0])], "g int, v array<double>")
    means = {r["g"]: list(r["mean"]) for r in vectors.mean_vector(v, ["g"], "v").collect()}
    assert means == {1: [0.5, 0.5], 2: [0.0, 0.0]}
    assert [r["c"] for r in v.select(arrays.cosine(F.col("v"), F.col("v")).alias("c")).collect()] == [1.0, 1.0, None]


def test_identities(spark):
    import hashlib
    import json

    value = {"b": None, "a": [1, 1e-05, "\u001f é"]}
    got = one(spark.createDataFrame([(json.dumps(value),)], "j string").select(canon.any_record_hash(F.col("j"))))
    assert got == hashlib.sha256(canon.canonical_json(value).encode()).hexdigest()
    assert canon.without_paths({"path": 1, "x": [{"value": 2, "y": 3}]}) == {"x": [{"y": 3}]}
    seed = one(spark.range(1).select(rng.environment_seed(F.lit("a"), F.lit("b"))))
    assert seed == int.from_bytes(hashlib.sha256(b"a\0b").digest()[:8], "big") % 2**32


def test_messages(spark):
    m = spark.createDataFrame([([("system", "old"), ("user", "hi")],), ([("user", "hi")],)], "m array<struct<role:string,content:string>>")
    got = m.select(arrays.append_action(arrays.replace_system(F.col("m"), F.lit("new")), F.lit("go")).alias("m")).collect()
    assert [tuple(x) for x in got[0]["m"]] == [("system", "new"), ("user", "hi"), ("assistant", "Action: go")] and got[1]["m"] is None
    roles = spark.createDataFrame([(["system", "user", "assistant", "user"],), (["system", "user", "user", "user"],), (["system"],)], "r array<string>").select(arrays.roles_alternate(F.col("r")).alias("ok")).collect()
    assert [r["ok"] for r in roles] == [True, False, False]


def test_audit_of_one_record_at_a_time(spark):
    """A record without faults has no code; each fault gives its own."""
    from tessera.operators import audit as A

    own, other = "o", "t"
    message = lambda r, c: {"role": r, "content": c}
    full = [message("system", own), message("user", "T: start"), message("assistant", "Action: a"), message("user", "see a b")]
    sha = lambda m: __import__("hashlib").sha256(__import__("json").dumps([{"content": x["content"], "role": x["role"]} for x in m], separators=(",", ":")).encode()).hexdigest()
    swapped = [message("system", other), *full[1:]]
    good = {
        "cluster_id": "g", "seq": 1, "task": "T", "observation": "see", "actions": ["a", "b"], "messages": full, "full_messages": full, "truncation": (1, 0, 9, 10), "source": "student", "own_action": "a",
        "draws": [("a", True, 1), ("z", False, 1)], "calls": 2, "attested": (True, True, True, 2, sha(full), sha(swapped), sha(swapped[1:]), __import__("hashlib").sha256(other.encode()).hexdigest()), "incl_prob": 0.5, "full": True,
    }
    schema = (
        "cluster_id string, seq int, task string, observation string, actions array<string>, messages array<struct<role:string,content:string>>, full_messages array<struct<role:string,content:string>>,"
        "truncation struct<kept_pairs:int,dropped_pairs:int,token_count:int,budget:int>, source string, own_action string, draws array<struct<action:string,valid:boolean,calls:long>>, calls long,"
        "attested struct<prompt_replaced:boolean,same_context:boolean,counts_invalid:boolean,samples:int,own_sha:string,other_sha:string,rest_sha:string,prompt_sha:string>, incl_prob double, full boolean"
    )
    note = lambda k, v: tuple(v if i == k else x for i, x in enumerate(good["attested"]))
    wrong_turn = [*full[:3], message("user", "see a b c")]
    faults = {
        "EMPTY_ADMISSIBLE_SET": {"actions": []}, "OBSERVATION_NOT_IN_QUERY": {"observation": "hear"}, "ADMISSIBLE_NOT_IN_QUERY": {"actions": ["a", "b", "q"]}, "STUDENT_ACTION_NOT_EXECUTABLE": {"own_action": None},
        "VALID_TEACHER_ACTION_NOT_EXECUTABLE": {"draws": [("a", True, 1), ("z", True, 1)]}, "NONATOMIC_TEACHER_ATTEMPT": {"draws": [("a", True, 1), ("z", False, 2)], "calls": 3}, "BUDGET_CALL_MISMATCH": {"calls": 5},
        "FULL_HISTORY_TURN_MISMATCH": {"full_messages": full[:2]}, "CURRENT_STATE_MESSAGE_MISMATCH": {"full_messages": wrong_turn}, "FULL_HISTORY_ACTION_FORMAT": {"full_messages": [*full[:2], message("assistant", "a"), full[3]]},
        "TRUNCATION_ATTESTATION_MISSING": {"truncation": (None, 0, 9, 10)}, "TRUNCATED_HISTORY_MISMATCH": {"truncation": (1, 1, 9, 10)}, "STATE_SOURCE_PROMPT_MISMATCH": {"source": "else"}, "TEACHER_PROMPT_NOT_ATTESTED": {"attested": note(0, None)},
        "CONTEXT_IDENTITY_NOT_ATTESTED": {"attested": note(1, False)}, "BUDGET_POLICY_NOT_ATTESTED": {"attested": note(2, False)}, "TEACHER_SAMPLE_COUNT_MISMATCH": {"attested": note(3, 1)}, "STUDENT_QUERY_SHA256_MISMATCH": {"attested": note(4, "x")},
        "TEACHER_QUERY_SHA256_MISMATCH": {"attested": note(5, "x")}, "NON_SYSTEM_QUERY_SHA256_MISMATCH": {"attested": note(6, None)}, "TEACHER_SYSTEM_PROMPT_SHA256_MISMATCH": {"attested": note(7, "x")}, "INVALID_INCLUSION_PROBABILITY": {"incl_prob": 1.5},
        A.ROLES: {"messages": full[:3]},
    }
    assert set(faults) == {A.ROLES, *A.CODES}
    rows = [good | {"cluster_id": "fine"}, *(good | change | {"cluster_id": code} for code, change in faults.items())]
    df = spark.createDataFrame([tuple(r[c.split()[0]] for c in ("cluster_id seq task observation actions messages full_messages truncation source own_action draws calls attested incl_prob full").split()) for r in rows], schema)
    found = {}
    for r in A.audit(df, own, other, lambda t, o, a: F.concat(t, F.lit(": start")), lambda t, o, a: F.concat_ws(" ", o, F.array_join(F.slice(F.array_union(a, F.array(F.lit("a"), F.lit("b"))), 1, 2), " "))).collect():
        found.setdefault(r["key"].split("/")[0], set()).add(r["code"])
    assert "fine" not in found
    for code in faults:
        assert code in found[code], (code, found.get(code))
    assert found[A.ROLES] == {A.ROLES}


def test_configurations(spark):
    from tessera.operators import audit as A

    df = spark.createDataFrame([("a", '{"x": 1, "d": {"e": {"f": 2}}, "l": [1]}'), ("b", '{"x": 1, "d": {"e": {"f": 3}}, "n": null}')], "run string, config string")
    got = {(r["run"], r["path"], r["expected"], r["actual"]) for r in A.differences(df, "run", "config", df.where("run = 'a'"), ("l",)).collect()}
    assert got == {("b", "d.e.f", "2", "3")}
    shared = {r["path"] for r in A.not_shared(df.withColumn("g", F.lit(1)), "g", "config").collect()}
    assert shared == {"d.e.f", "l", "n"}


@pytest.mark.parametrize("n", [0, 1_100])
def test_means_of_vectors_with_null_coordinates(spark, n):
    """Coordinates keep their places and their own weights, in short and long vectors."""
    tail = [1.0] * n
    rows = [("a", [1.0, None, 3.0] + tail, 1.0), ("a", [3.0, 4.0, 5.0] + tail, 3.0), ("b", [1.0, None, 2.0] + tail, 2.0), ("b", [None, None, 4.0], 2.0), ("c", [], 1.0), ("c", None, 1.0), ("d", [5.0, 6.0], None), ("d", [1.0], 2.0), ("e", [1.0], 0.0)]
    df = spark.createDataFrame(rows, "g string, v array<double>, w double")
    got = {r["g"]: r["mean"] for r in vectors.mean_vector(df, ["g"], "v").collect()}
    assert got == {"a": [2.0, 4.0, 4.0] + tail, "b": [1.0, None, 3.0] + tail, "c": [], "d": [3.0, 6.0], "e": [1.0]}
    weighted = {r["g"]: r["mean"] for r in vectors.mean_vector(df, ["g"], "v", "w").collect()}
    assert weighted == {"a": [2.5, 4.0, 4.5] + tail, "b": [1.0, None, 3.0] + tail, "c": [], "d": [1.0, None], "e": [None]}


def test_nearly_collinear_least_squares(spark):
    """Columns that differ by a part in ten million: sums of raw products would lose all digits of the difference."""
    import numpy as np
    from tessera.operators import regression

    rng = np.random.default_rng(3)
    a, noise = rng.integers(-50, 50, 4_000).astype(float), rng.integers(-50, 50, 4_000).astype(float)
    b = a + noise * 2.0**-23
    y = 3.0 + 2.0 * a - 5.0 * (b - a)
    df = spark.createDataFrame([(float(u), float(v), float(w), int(i % 40)) for i, (u, v, w) in enumerate(zip(a, b, y))] + [(None, 1.0, 1.0, 1)], "a double, b double, y double, c int").repartition(7)
    terms = {"one": F.lit(1.0), "a": F.col("a"), "b": F.col("b")}
    got = regression.fit(df, terms, F.col("y"), "c")
    assert abs(got["one"] - 3.0) < 1e-8 and abs(got["a"] - 7.0) < 1e-6 and abs(got["b"] + 5.0) < 1e-6 and abs(got["a"] + got["b"] - 2.0) < 1e-8
    r = regression.bootstrap(df, terms, F.col("y"), "c", ["b"], 20).first()
    assert r["kept"] == 20 and abs(r["lower"] + 5) < 1e-4 and abs(r["upper"] + 5) < 1e-4
    with pytest.raises(ValueError):
        regression.fit(df, terms | {"twice": F.col("a") * 2}, F.col("y"), "c")
