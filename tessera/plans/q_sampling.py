"""Queries: selections, splits, shuffles, matching, shards."""

from __future__ import annotations

from pyspark.sql import functions as F

from tessera.functions.rng import environment_seed
from tessera.operators import sampling
from tessera.plans import views as V
from tessera.plans.registry import query

PRIORITY = "sha256('tessera-priority-v1' || chr(0) || '42' || chr(0) || cluster_id || chr(0) || unit_id)"
RANKED = f"WITH {V.UNIT}, r AS (SELECT *, row_number() OVER (PARTITION BY cluster_id ORDER BY {PRIORITY}, unit_id) rn, count(*) OVER (PARTITION BY cluster_id) n FROM v_unit)"


@query(f"{RANKED} SELECT cluster_id, seq, unit_id, cast(rn AS int) rn, round(least(3, n) / n, 6) incl_prob FROM r WHERE rn <= 3")
def l2_nested_selection(spark, d):
    return sampling.nested_selection(V.unit(spark, d), 3).select("cluster_id", "seq", "unit_id", "rn", F.round("incl_prob", 6).alias("incl_prob"))


@query(f"{RANKED} SELECT count(*) FILTER (rn <= 1) n_small, count(*) FILTER (rn <= 3) n_large, count(*) FILTER (rn <= 1 AND rn <= 3) n_common FROM r")
def l2_nestedness(spark, d):
    units = V.unit(spark, d)
    one, three = sampling.nested_selection(units, 1).select("unit_id", F.lit(1).alias("s")), sampling.nested_selection(units, 3).select("unit_id",
        F.lit(1).alias("l"))
    both = one.join(three, "unit_id", "full")
    return both.agg(F.count("s").alias("n_small"), F.count("l").alias("n_large"), F.count_if(F.col("s").isNotNull() & F.col("l").isNotNull()).alias("n_common"))


@query(f"{RANKED}, s AS (SELECT * FROM r WHERE rn <= 2) "
    f"SELECT cluster_id, cast(row_number() OVER (PARTITION BY cluster_id ORDER BY seq) AS int) position, seq, round(least(2, n) / n, 6) incl_prob FROM s")
def l1_uniform_without_replacement(spark, d):
    from pyspark.sql.window import Window

    chosen = sampling.nested_selection(V.unit(spark, d), 2)
    return chosen.select("cluster_id", F.row_number().over(Window.partitionBy("cluster_id").orderBy("seq")).alias("position"), "seq",
        F.round("incl_prob", 6).alias("incl_prob"))


@query(f"WITH {V.UNIT}, r AS (SELECT *, row_number() OVER (PARTITION BY cluster_id ORDER BY length(observation) DESC, seq) rn FROM v_unit) "
    f"SELECT cluster_id, seq, cast(rn AS int) rn, cast(length(observation) AS bigint) score, cast(NULL AS double) incl_prob FROM r WHERE rn <= 2")
def l3_top_score(spark, d):
    units = V.unit(spark, d).withColumn("score", F.length("observation").cast("long"))
    return sampling.top_score(units, 2, "score", "seq").select("cluster_id", "seq", "rn", "score", "incl_prob")


@query(f"WITH {V.LOG}, n AS (SELECT client, count(*) eligible FROM v_log WHERE value > 50 GROUP BY 1), "
    f"r AS (SELECT *, row_number() OVER (PARTITION BY client ORDER BY value DESC, request_id) rn FROM v_log WHERE value > 50) "
        f"SELECT r.client, request_id, cast(rn AS int) rn, eligible FROM r JOIN n USING (client) WHERE rn <= 5 AND eligible >= 3")
def l4_top_k_with_minimum(spark, d):
    rows = V.log(spark, d).where("value > 50")
    counts = rows.groupBy("client").agg(F.count("*").alias("eligible")).where("eligible >= 3")
    return sampling.top_score(rows, 5, "value", "request_id", "client").join(counts, "client").select("client", "request_id", "rn", "eligible")


@query("""WITH c AS (SELECT doc_id, lang, doc_id % 3 b, sha256('42|' || doc_id) k FROM documents WHERE doc_id % 2 = 1),
 t AS (SELECT lang, doc_id % 3 b, count(*) wanted FROM documents WHERE doc_id % 20 = 0 GROUP BY 1, 2),
 r AS (SELECT *, row_number() OVER (PARTITION BY lang, b ORDER BY k, doc_id) rn FROM c) SELECT doc_id, lang, cast(b AS int) b FROM r
 JOIN t USING (lang, b) WHERE rn <= wanted""")
def l5_exact_matching(spark, d):
    docs = V._t(spark, d, "documents").select("doc_id", "lang", (F.col("doc_id") % 3).cast("int").alias("b"))
    picked, _ = sampling.matched_sample(docs.where("doc_id % 2 = 1"), docs.where("doc_id % 20 = 0"), ["lang", "b"], "doc_id")
    return picked.select("doc_id", "lang", "b")


@query(f"WITH {V.UNIT}, g AS (SELECT DISTINCT cluster_id FROM v_unit), "
    f"r AS (SELECT *, row_number() OVER (ORDER BY sha256('42|' || cluster_id), cluster_id) rn, count(*) OVER () n FROM g) "
        f"SELECT cluster_id, rn <= least(n - 1, greatest(1, round_even(n * 0.15, 0))) is_validation FROM r")
def l6_cluster_split(spark, d):
    clusters = V.unit(spark, d).select("cluster_id").distinct()
    return sampling.cluster_split(clusters, 0.15, "cluster_id").select("cluster_id", "is_validation")


@query(f"WITH {V.UNIT}, g AS (SELECT DISTINCT cluster_id, stratum FROM v_unit), "
    f"r AS (SELECT *, row_number() OVER (PARTITION BY stratum "
        f"ORDER BY sha256('42|' || cluster_id), cluster_id) rn, count(*) OVER (PARTITION BY stratum) n FROM g) "
            f"SELECT cluster_id, stratum, rn <= least(n - 1, greatest(1, round_even(n * 0.25, 0))) is_validation FROM r")
def l7_stratified_split(spark, d):
    clusters = V.unit(spark, d).select("cluster_id", "stratum").distinct()
    return sampling.cluster_split(clusters, 0.25, "cluster_id", "stratum").select("cluster_id", "stratum", "is_validation")


@query("SELECT c_custkey, row_number() OVER (ORDER BY sha256('42|' || c_custkey), c_custkey) - 1 place FROM customer")
def l8_stable_shuffle(spark, d):
    from tessera.operators.ranking import global_rank

    keyed = sampling.stable_order(V._t(spark, d, "customer").select("c_custkey"), "c_custkey")
    return global_rank(keyed, ["shuffle_key", "c_custkey"])[0].select("c_custkey", "place")


@query("WITH r AS (SELECT c_custkey, c_mktsegment, row_number() OVER (PARTITION BY c_mktsegment ORDER BY sha256('42|' || c_custkey), c_custkey) rn "
    "FROM customer) SELECT c_custkey, c_mktsegment, cast(rn AS int) rn FROM r WHERE rn <= 7")
def l9_stratum_sample(spark, d):
    return sampling.stratum_sample(V._t(spark, d, "customer"), 7, "c_custkey", "c_mktsegment").select("c_custkey", "c_mktsegment", "rn")


@query("WITH r AS (SELECT c_custkey, c_mktsegment, row_number() OVER (PARTITION BY c_mktsegment ORDER BY sha256('42|' || c_custkey), c_custkey) rn "
    "FROM customer) SELECT c_custkey, c_mktsegment FROM r WHERE rn = 4")
def e2_nth_of_stratum(spark, d):
    return sampling.nth_of_stratum(V._t(spark, d, "customer"), 4, "c_custkey", "c_mktsegment").select("c_custkey", "c_mktsegment")


@query("SELECT c_custkey FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_orderpriority LIKE '1%') "
    "ORDER BY sha256('42|' || c_custkey), c_custkey LIMIT 40")
def l10_freeze_list(spark, d):
    used = V._t(spark, d, "orders").where(F.col("o_orderpriority").startswith("1")).select(F.col("o_custkey").alias("c_custkey"))
    free = V._t(spark, d, "customer").select("c_custkey").join(used, "c_custkey", "left_anti")
    return sampling.first_n(free, 40, "c_custkey").select("c_custkey")


@query("""WITH n AS (SELECT count(*) n FROM supplier), r AS (SELECT s_suppkey, row_number() OVER (ORDER BY s_suppkey) - 1 p FROM supplier),
 e AS (SELECT s_suppkey, p, 1.0::double multiplier FROM r UNION ALL SELECT s_suppkey, i + n, 0.0 FROM n, range(7) q(i), r
 WHERE i < (-n % 7 + 7) % 7 AND p = i % n) SELECT s_suppkey, cast(p % 7 AS int) "rank", cast(p // 7 AS bigint) slot, multiplier FROM e""")
def l11_padded_shards(spark, d):
    return sampling.padded_shards(V._t(spark, d, "supplier"), 7, "s_suppkey")


@query("""WITH n AS (SELECT count(*) n FROM supplier), r AS (SELECT s_suppkey, row_number() OVER (ORDER BY s_suppkey) - 1 p FROM supplier),
 e AS (SELECT s_suppkey, p, 1.0::double multiplier FROM r UNION ALL SELECT s_suppkey, i + n, 0.0 FROM n, range(48) q(i), r
 WHERE i < (-n % 48 + 48) % 48 AND p = i % n) SELECT cast(p // 48 AS bigint) batch, count(*) n_rows, sum(multiplier)::bigint n_real FROM e GROUP BY 1""")
def l12_batch_padding(spark, d):
    rows = sampling.padded_shards(V._t(spark, d, "supplier"), 48, "s_suppkey")
    return rows.groupBy(F.col("slot").alias("batch")).agg(F.count("*").alias("n_rows"), F.sum("multiplier").cast("long").alias("n_real"))


@query(f"WITH {V.UNIT}, g AS (SELECT cluster_id, stratum, count(*) n, count(*) - count(DISTINCT role) rep FROM v_unit GROUP BY 1, 2) "
    f"SELECT stratum, arg_min(cluster_id, struct_pack(a := (rep > 3)::int, b := n, c := cluster_id)) cluster_id FROM g GROUP BY 1")
def l13_best_pick(spark, d):
    g = V.unit(spark, d).groupBy("cluster_id", "stratum").agg(F.count("*").alias("n"), (F.count("*") - F.count_distinct("role")).alias("rep"))
    return g.groupBy("stratum").agg(F.min_by("cluster_id", F.struct((F.col("rep") > 3).cast("int"), "n", "cluster_id")).alias("cluster_id"))


@query(f"WITH {V.UNIT} SELECT unit_id, row_number() OVER (ORDER BY unit_id) - 1 place FROM v_unit")
def l14_canonical_order(spark, d):
    from tessera.operators.ranking import global_rank

    return global_rank(V.unit(spark, d).select("unit_id"), ["unit_id"])[0]


@query(f"WITH {V.UNIT}, r AS (SELECT unit_id, stratum, row_number() OVER (PARTITION BY stratum ORDER BY sha256('42|' || unit_id), unit_id) rn "
    f"FROM v_unit) SELECT unit_id, stratum, cast(rn AS int) rn FROM r ORDER BY rn, stratum, unit_id LIMIT 50")
def w8_round_robin(spark, d):
    return sampling.round_robin(V.unit(spark, d), 50, "unit_id", "stratum").select("unit_id", "stratum", "rn")


@query("""WITH r AS (SELECT o_orderkey, o_custkey % 11 fam, coalesce(sum((o_orderstatus = 'F')::int) OVER w, 0) solved_before, count(*) OVER w tried_before FROM orders
 WINDOW w AS (PARTITION BY o_custkey % 11 ORDER BY o_orderkey ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING))
 SELECT o_orderkey, cast(fam AS int) fam, cast(solved_before AS bigint) solved_before, tried_before FROM r WHERE solved_before < 12 AND tried_before < 30""")
def w9_until_quota(spark, d):
    o = V._t(spark, d, "orders").select("o_orderkey", (F.col("o_custkey") % 11).cast("int").alias("fam"), (F.col("o_orderstatus") == "F").alias("solved"))
    return sampling.until_quota(o, 12, 30, "o_orderkey", "solved", "fam").select("o_orderkey", "fam", "solved_before", "tried_before")


@query("SELECT c_custkey, cast(('0x' || substr(sha256('42' || chr(0) || c_name), 9, 8)) AS bigint) env_seed FROM customer")
def p5_environment_seed(spark, d):
    return V._t(spark, d, "customer").select("c_custkey", environment_seed(F.lit("42"), F.col("c_name")).alias("env_seed"))


@query(f"WITH {V.UNIT} SELECT cluster_id, count(*) n_units FROM v_unit GROUP BY 1")
def a6_population_counts(spark, d):
    return V.unit(spark, d).groupBy("cluster_id").agg(F.count("*").alias("n_units"))
