"""Queries: constraints as violation tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from tessera.functions.arrays import softmax_entropy
from tessera.functions.rng import environment_seed
from tessera.operators import checks as C, sampling, weights
from tessera.plans import views as V
from tessera.plans.q_sampling import PRIORITY
from tessera.plans.q_weights import ROWS
from tessera.plans.registry import query


@query(f"""WITH {V.UNIT}, e AS (SELECT unit_id, least(3, n) / n p
 FROM (SELECT *, row_number() OVER (PARTITION BY cluster_id ORDER BY {PRIORITY}, unit_id) rn, count(*) OVER (PARTITION BY cluster_id) n FROM v_unit)
 WHERE rn <= 3),
 a AS (SELECT unit_id, least(3, n) / n + CASE WHEN seq = 2 THEN 0.1 ELSE 0 END p
 FROM (SELECT *, row_number() OVER (PARTITION BY cluster_id ORDER BY {PRIORITY}, unit_id) rn, count(*) OVER (PARTITION BY cluster_id) n FROM v_unit)
 WHERE rn <= 3 AND seq <> 1 OR rn = 4)
 SELECT CASE WHEN a.p IS NULL THEN 'missing' WHEN e.p IS NULL THEN 'unexpected' ELSE 'different_incl_prob' END code, unit_id "key" FROM e FULL
 JOIN a USING (unit_id) WHERE a.p IS NULL OR e.p IS NULL OR abs(a.p - e.p) > 1e-12""")
def c2_selection_rederivation(spark, d):
    """A tampered selection against the one that the pool and the seed give."""
    units = V.unit(spark, d)
    expected = sampling.nested_selection(units, 3)
    four = sampling.nested_selection(units, 4).withColumn("incl_prob", F.least(F.lit(3), F.col("n_units")) / F.col("n_units"))
    tampered = four.where("rn <= 3 and seq <> 1 or rn = 4").withColumn("incl_prob", F.col("incl_prob") + F.when(F.col("seq") == 2, 0.1).otherwise(0.0))
    return C.same_rows(expected, tampered, "unit_id", {"incl_prob": 1e-12}).select("code", "key")


@query("""WITH m AS (SELECT l_orderkey, max(l_quantity) m FROM lineitem GROUP BY 1),
 w AS (SELECT l_orderkey, exp(l_quantity - m) w FROM lineitem JOIN m USING (l_orderkey)), s AS (SELECT l_orderkey, sum(w) s FROM w GROUP BY 1),
 h AS (SELECT l_orderkey, -sum(CASE WHEN w > 0 THEN w / s * ln(w / s) ELSE 0 END) h FROM w JOIN s USING (l_orderkey) GROUP BY 1)
 SELECT 'different_score' code, cast(l_orderkey AS varchar) "key"
 FROM (SELECT *, h + CASE WHEN l_orderkey % 10 = 0 THEN 0.01 ELSE 0 END recorded FROM h) WHERE abs(recorded - h) > 1e-9""")
def c3_score_rederivation(spark, d):
    x = V._t(spark, d, "lineitem").groupBy("l_orderkey").agg(F.collect_list("l_quantity").alias("q")).select(F.col("l_orderkey").alias("unit_id"),
        softmax_entropy(F.array_sort("q")).alias("score"))
    recorded = x.withColumn("score", F.col("score") + F.when(F.col("unit_id") % 10 == 0, 0.01).otherwise(0.0))
    return C.same_rows(x, recorded, "unit_id", {"score": 1e-9}).select("code", "key")


@query(f"WITH {V.DRAW} SELECT count(*) m, cast(sum(calls) AS bigint) b, cast(sum(k) AS bigint) valid, cast(sum(calls - k) AS bigint) invalid, count(DISTINCT cluster_id) clusters, count(*) * 4 = sum(calls) budget_met FROM v_rec")
def c4_manifest_counts(spark, d):
    r = V.draw(spark, d).select("cluster_id", F.size("draws").alias("calls"), weights.n_valid(F.col("draws")).alias("k"))
    return r.agg(F.count("*").alias("m"), F.sum("calls").alias("b"), F.sum("k").alias("valid"), F.sum(F.col("calls") - F.col("k")).alias("invalid"),
        F.count_distinct("cluster_id").alias("clusters"), (F.count("*") * 4 == F.sum("calls")).alias("budget_met"))


@query(f"WITH {V.DRAW} SELECT 'budget_identity' code, cast(unit_id AS varchar) \"key\" FROM v_rec WHERE calls <> 4")
def c5_budget_identity(spark, d):
    r = V.draw(spark, d).select("unit_id", F.size("draws").alias("calls"))
    return C.row_checks(r, F.col("unit_id"), {"budget_identity": F.col("calls") == 4}).select("code", "key")


@query("SELECT 'overlap' code, cast(k AS varchar) \"key\" "
    "FROM (SELECT DISTINCT o_custkey k FROM orders WHERE o_orderkey % 2 = 0 INTERSECT SELECT DISTINCT o_custkey FROM orders WHERE o_orderkey % 2 = 1)")
def c8_cluster_disjoint(spark, d):
    o = V._t(spark, d, "orders").select("o_orderkey", "o_custkey")
    return C.disjoint(o.where("o_orderkey % 2 = 0"), o.where("o_orderkey % 2 = 1"), "o_custkey").select("code", "key")


@query(f"WITH {V.UNIT}, r AS (SELECT *, row_number() OVER (PARTITION BY cluster_id ORDER BY {PRIORITY}, unit_id) rn FROM v_unit) "
    f"SELECT 'not_in_larger' code, unit_id \"key\" FROM r WHERE rn = 1 AND seq > 3")
def c9_nested_arms(spark, d):
    units = V.unit(spark, d)
    return C.subset(sampling.nested_selection(units, 1), sampling.nested_selection(units, 3).where("seq <= 3"), "unit_id").select("code", "key")


@query(f"{ROWS}, s AS (SELECT cluster_id, sum(CASE WHEN cluster_id % 10 = 0 THEN w * 2 ELSE w END) t FROM tv GROUP BY 1) "
    f"SELECT 'weights_do_not_sum_to_1' code, cast(cluster_id AS varchar) \"key\" FROM s WHERE abs(t - 1) > 1e-6")
def c12_dataset_invariants(spark, d):
    rows = weights.training_rows(V.draw(spark, d)).withColumn("weight", F.col("weight") * F.when(F.col("cluster_id") % 10 == 0, 2).otherwise(1))
    return C.all_of(C.unique(rows, "unit_id", "sample_index"), C.sums_to_one(rows, "cluster_id", "weight")).select("code", "key")


@query("SELECT 'bad_weight' code, l_orderkey || '|' || l_linenumber \"key\" FROM lineitem WHERE NOT (l_discount > 0)")
def c13_weight_positive(spark, d):
    lines = V._t(spark, d, "lineitem")
    return C.row_checks(lines, F.concat_ws("|", "l_orderkey", "l_linenumber"),
        {"bad_weight": (F.col("l_discount") > 0) & ~F.isnan("l_discount")}).select("code", "key")


@query(f"WITH {V.OUTCOME} SELECT cluster_id, count(DISTINCT replicate_id) = 4 complete FROM v_eval WHERE NOT (cluster_id = 3 AND replicate_id = 1) GROUP BY 1")
def c14_crossed_completeness(spark, d):
    e = V.outcome(spark, d).where("not (cluster_id = 3 and replicate_id = 1)")
    return e.groupBy("cluster_id").agg((F.size(F.collect_set("replicate_id")) == 4).alias("complete"))


@query("""WITH s AS (SELECT c_custkey, cast(('0x' || substr(sha256('42' || chr(0) || c_name), 9, 8)) AS bigint) derived FROM customer),
 r AS (SELECT *, derived + (c_custkey % 25 = 0)::INT recorded FROM s)
 SELECT c_custkey, recorded = derived AND recorded BETWEEN 0 AND 4294967295 seed_ok FROM r""")
def c19_seed_contract(spark, d):
    derived = environment_seed(F.lit("42"), F.col("c_name"))
    recorded = derived + F.when(F.col("c_custkey") % 25 == 0, 1).otherwise(0)
    return V._t(spark, d, "customer").select("c_custkey", ((recorded == derived) & recorded.between(0, 2**32 - 1)).alias("seed_ok"))


@query("SELECT event_type requested, count(*) n, count(*) FILTER (event_id % 40 = 0) mismatched FROM events GROUP BY 1")
def c21_provider_identity(spark, d):
    e = V._t(spark, d, "events").withColumn("response", F.when(F.col("event_id") % 40 == 0, "other").otherwise(F.col("event_type")))
    return e.groupBy(F.col("event_type").alias("requested")).agg(F.count("*").alias("n"),
        F.count_if(F.col("response") != F.col("event_type")).alias("mismatched"))


@query("""WITH x AS (SELECT event_id id, sha256(props) h FROM events),
 y AS (SELECT event_id id, CASE WHEN event_id % 10 = 0 THEN 'x' ELSE sha256(props) END h FROM events WHERE event_id % 7 <> 0)
 SELECT CASE WHEN y.id IS NULL THEN 'missing' ELSE 'different_h' END code, x.id::VARCHAR "key" FROM x LEFT JOIN y USING (id) WHERE y.h IS DISTINCT FROM x.h""")
def c22_ledger_context(spark, d):
    x = V._t(spark, d, "events").select(F.col("event_id").alias("id"), F.sha2("props", 256).alias("h"))
    y = x.where("id % 7 <> 0").withColumn("h", F.when(F.col("id") % 10 == 0, "x").otherwise(F.col("h")))
    return C.same_rows(x, y, "id", {"h": None}).select("code", "key")


@query(f"WITH {V.UNIT} SELECT count(*) > 0 not_empty, count(*) = count(DISTINCT unit_id) unique_ids FROM v_unit")
def c27_pool_predicates(spark, d):
    return V.unit(spark, d).agg((F.count("*") > 0).alias("not_empty"), (F.count("*") == F.count_distinct("unit_id")).alias("unique_ids"))


@query(f"WITH {V.UNIT}, s AS (SELECT cluster_id, max(seq) >= 4 solved FROM v_unit GROUP BY 1) "
    f"SELECT solved, count(DISTINCT cluster_id) clusters, count(*) turns, count(*) FILTER (NOT valid) invalid_turns FROM v_unit "
        f"JOIN s USING (cluster_id) GROUP BY 1")
def c28_solved_only(spark, d):
    u = V.unit(spark, d)
    s = u.groupBy("cluster_id").agg((F.max("seq") >= 4).alias("solved"))
    return u.join(s, "cluster_id").groupBy("solved").agg(F.count_distinct("cluster_id").alias("clusters"), F.count("*").alias("turns"),
        F.count_if(~F.col("valid")).alias("invalid_turns"))
