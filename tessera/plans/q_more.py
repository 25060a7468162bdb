"""Queries: small operators of the inventory's appendix."""

from __future__ import annotations

from pyspark.sql import functions as F

from tessera.functions import arrays as A, canon
from tessera.operators import bootstrap, checks as C
from tessera.operators.selection import quantiles
from tessera.plans import views as V
from tessera.plans.q_estimators import DRAWS, R
from tessera.plans.registry import query


@query("WITH r AS (SELECT l_orderkey, list(CASE WHEN l_quantity < 20 THEN 0 ELSE cast(l_quantity AS int) END "
    "ORDER BY l_linenumber, l_partkey, l_suppkey, l_quantity) ids FROM lineitem GROUP BY 1), "
        "t AS (SELECT l_orderkey, ids, coalesce(list_max(list_filter(range(1, len(ids) + 1), lambda i: ids[i] <> 0)), 0) n FROM r) "
            "SELECT l_orderkey, cast(n AS int) n_kept, array_to_string(ids[1:n], ',') kept FROM t")
def p40_emitted_span(spark, d):
    x = V._t(spark, d, "lineitem").groupBy("l_orderkey").agg(F.array_sort(F.collect_list(F.struct("l_linenumber", "l_partkey", "l_suppkey",
        "l_quantity"))).alias("x"))
    ids = F.transform("x", lambda s: F.when(s["l_quantity"] < 20, 0).otherwise(s["l_quantity"].cast("int")))
    kept = x.select("l_orderkey", A.without_trailing(ids, F.lit(0)).alias("k"))
    return kept.select("l_orderkey", F.size("k").alias("n_kept"), F.array_join(F.transform("k", lambda v: v.cast("string")), ",").alias("kept"))


@query("SELECT c_custkey, 'v' || c_nationkey value FROM customer")
def p42_unwrap_batched(spark, d):
    info = F.create_map(F.lit("a"), F.array(F.concat(F.lit("v"), F.col("c_nationkey").cast("string"))), F.lit("b"), F.array(F.lit("x")))
    return V._t(spark, d, "customer").select("c_custkey", A.unwrapped(info)["a"].alias("value"))


@query("SELECT l_orderkey, round(sum(CASE WHEN l_quantity >= 10 THEN -l_discount ELSE 0 END), 6) + 0.0 log_score, count(*) FILTER (l_quantity >= 10) n_tokens "
    "FROM lineitem GROUP BY 1")
def e9_action_log_score(spark, d):
    x = V._t(spark, d, "lineitem").groupBy("l_orderkey").agg(F.collect_list(F.struct((-F.col("l_discount")).alias("lp"),
        (F.col("l_quantity") >= 10).cast("double").alias("m"))).alias("x"))
    return x.select("l_orderkey", (F.round(A.dot(F.transform("x", lambda s: s["lp"]), F.transform("x", lambda s: s["m"])),
        6) + 0.0).alias("log_score"), A.total(F.transform("x", lambda s: s["m"])).cast("long").alias("n_tokens"))


@query("WITH g AS (SELECT o_orderpriority arm, o_custkey % 7 k, count(*) n FROM orders GROUP BY 1, 2), "
    "t AS (SELECT o_orderpriority arm, count(*) t FROM orders GROUP BY 1) "
        "SELECT arm, cast(k AS int) k, n, sum(n) OVER (PARTITION BY arm) = t total_ok FROM g JOIN t USING (arm)")
def e6_counts_from_manifest(spark, d):
    o = V._t(spark, d, "orders").select(F.col("o_orderpriority").alias("arm"), (F.col("o_custkey") % 7).cast("int").alias("k"))
    counts = o.groupBy("arm", "k").agg(F.count("*").alias("n"))
    recorded = counts.groupBy("arm").agg(F.map_from_entries(F.collect_list(F.struct("k", "n"))).alias("per"))
    total = o.groupBy("arm").agg(F.count("*").alias("t"))
    checked = recorded.join(total, "arm").withColumn("total_ok", F.aggregate(F.map_values("per"), F.lit(0).cast("long"), lambda a, x: a + x) == F.col("t"))
    return checked.select("arm", F.explode("per").alias("k", "n"), "total_ok")


@query("WITH b AS (SELECT CASE WHEN o_orderkey % 5 = 0 THEN '0' || (o_orderkey % 4) ELSE cast(o_orderkey % 4 AS varchar) END seed FROM orders "
    "GROUP BY 1) SELECT cast(seed AS int) seed, count(*) n, count(*) > 1 duplicate FROM b GROUP BY 1")
def e11_duplicate_seed_guard(spark, d):
    seed = F.when(F.col("o_orderkey") % 5 == 0,
        F.concat(F.lit("0"), (F.col("o_orderkey") % 4).cast("string"))).otherwise((F.col("o_orderkey") % 4).cast("string"))
    return V._t(spark, d, "orders").select(seed.alias("seed")).distinct().groupBy(F.col("seed").cast("int").alias("seed")).agg(F.count("*").alias("n"),
        (F.count("*") > 1).alias("duplicate"))


@query("SELECT p_partkey, sha256('{\"a\":{\"name\":\"' || p_name || '\"},\"n\":null,\"x\":0.5}') identity FROM part")
def p27_record_identity(spark, d):
    text = F.concat(F.lit('{"x": 0.5, "n": null, "a": {"name": "'), F.col("p_name"), F.lit('"}}'))
    return V._t(spark, d, "part").select("p_partkey", canon.any_record_hash(text).alias("identity"))


@query("""WITH x AS (SELECT page_id, sha256(html) h, CASE WHEN page_id % 9 = 0 THEN 'stale' ELSE sha256(html) END recorded FROM pages)
 SELECT 'different_h' code, page_id::VARCHAR "key" FROM x WHERE recorded IS DISTINCT FROM h""")
def c20_artifact_rehash(spark, d):
    x = V._t(spark, d, "pages").select("page_id", F.sha2("html", 256).alias("h"))
    recorded = x.withColumn("h", F.when(F.col("page_id") % 9 == 0, F.lit("stale")).otherwise(F.col("h")))
    return C.same_rows(x, recorded, "page_id", {"h": None}).select("code", "key")


@query("SELECT DISTINCT k FROM (SELECT o_custkey k FROM orders WHERE o_orderkey % 3 = 0 UNION ALL SELECT o_custkey FROM orders "
    "WHERE o_orderkey % 5 = 0 UNION ALL SELECT c_custkey FROM customer WHERE c_custkey % 11 = 0)")
def u2_union_of_exclusions(spark, d):
    o = V._t(spark, d, "orders").select("o_orderkey", F.col("o_custkey").alias("k"))
    c = V._t(spark, d, "customer").where("c_custkey % 11 = 0").select(F.col("c_custkey").alias("k"))
    return o.where("o_orderkey % 3 = 0").select("k").union(o.where("o_orderkey % 5 = 0").select("k")).union(c).distinct()


@query("SELECT (SELECT count(*) FROM (SELECT DISTINCT c_nationkey FROM customer EXCEPT SELECT DISTINCT s_nationkey "
    "FROM supplier)) missing, (SELECT count(*) FROM (SELECT DISTINCT s_nationkey FROM supplier EXCEPT SELECT DISTINCT c_nationkey FROM customer)) extra")
def u7_missing_and_extra(spark, d):
    a = V._t(spark, d, "customer").select(F.col("c_nationkey").alias("k")).distinct().withColumn("a", F.lit(1))
    b = V._t(spark, d, "supplier").select(F.col("s_nationkey").alias("k")).distinct().withColumn("b", F.lit(1))
    return a.join(b, "k", "full").agg(F.count_if(F.col("b").isNull()).alias("missing"), F.count_if(F.col("a").isNull()).alias("extra"))


@query("WITH x AS (SELECT l_returnflag g, l_quantity v FROM lineitem) "
    "SELECT g, round(quantile_cont(v, 0.025), 6) lower, round(quantile_cont(v, 0.5), 6) median, round(quantile_cont(v, 0.975), 6) upper FROM x GROUP BY 1")
def e10_linear_quantiles(spark, d):
    lines = V._t(spark, d, "lineitem").select(F.col("l_returnflag").alias("g"), "l_quantity")
    return R(quantiles(lines, ["g"], "l_quantity", {"lower": 0.025, "median": 0.5, "upper": 0.975}).drop("n"), "lower", "median", "upper")


@query(f"""WITH {V.OUTCOME}, g AS (SELECT cluster_id, avg(treatment - control) z FROM v_eval
 GROUP BY 1), dr AS {DRAWS('c', 200, 50)}, x AS (SELECT rep, avg(z) x FROM dr JOIN g ON g.cluster_id = dr.cluster_no GROUP BY 1)
 SELECT round((SELECT avg(z) FROM g), 6) estimate, round(list_sort(list(x))[cast(floor(0.025 * 199) AS bigint) + 1], 6) lower, round(list_sort(list(x))[cast(floor(0.975 * 199) AS bigint) + 1], 6) upper FROM x""")
def g16_fixed_level_bootstrap(spark, d):
    """Clusters are drawn, the levels of the other factor stay as they are."""
    g = V.outcome(spark, d).groupBy("cluster_id").agg(F.avg(F.col("treatment") - F.col("control")).alias("z"))
    return R(bootstrap.mean_difference(spark, g, "z", "cluster_id", 200), "estimate", "lower", "upper")


@query("SELECT doc_id, source game, CASE WHEN doc_id % 2 = 0 THEN 'nested' ELSE 'flat' END origin FROM documents")
def s9_record_cluster(spark, d):
    """The cluster of a record, from whichever of the old and new places holds it."""
    new = F.when(F.col("doc_id") % 2 == 1, F.col("source"))
    old = F.when(F.col("doc_id") % 2 == 0, F.struct(F.col("source").alias("gamefile")))
    return V._t(spark, d, "documents").select("doc_id", F.coalesce(new, old["gamefile"]).alias("game"),
        F.when(new.isNull(), "nested").otherwise("flat").alias("origin"))


@query("SELECT o_orderkey, '{\"k\": ' || o_custkey || '}' = '{\"k\": ' || o_custkey || '}' same, cast(o_custkey AS bigint) k FROM orders")
def s7_typed_parse(spark, d):
    text = F.concat(F.lit('{"k": '), F.col("o_custkey").cast("string"), F.lit("}"))
    parsed = F.from_json(text, "k long", {"mode": "FAILFAST"})
    return V._t(spark, d, "orders").select("o_orderkey", (parsed["k"] == F.col("o_custkey")).alias("same"), parsed["k"].alias("k"))
