"""Queries: shapes that only older analyses use."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tessera.functions.arrays import softmax_entropy
from tessera.functions.rng import shuffle_key
from tessera.operators import estimators as E, history, sampling
from tessera.operators.selection import quantiles
from tessera.operators.single import with_values
from tessera.plans import views as V
from tessera.plans.registry import query


@query("""WITH m AS (SELECT l_orderkey, max(l_quantity) m, count(*) n FROM lineitem GROUP BY 1),
 w AS (SELECT l_orderkey, n, exp(l_quantity - m) w FROM lineitem JOIN m USING (l_orderkey)), s AS (SELECT l_orderkey, sum(w) s FROM w GROUP BY 1)
 SELECT l_orderkey, round(greatest(0, -sum(CASE WHEN w > 0 THEN w / s * ln(w / s) ELSE 0 END)) / greatest(1e-12, ln(greatest(any_value(n), 2))), 6) + 0.0 h
 FROM w JOIN s USING (l_orderkey) GROUP BY 1""")
def g1_normalised_entropy(spark, d):
    x = V._t(spark, d, "lineitem").groupBy("l_orderkey").agg(F.collect_list("l_quantity").alias("q"))
    h = F.greatest(F.lit(0.0), softmax_entropy(F.array_sort("q"))) / F.greatest(F.lit(1e-12), F.log(F.greatest(F.size("q"), F.lit(2)).cast("double")))
    return x.select("l_orderkey", (F.round(h, 6) + 0.0).alias("h"))


BAND = "r AS (SELECT client, request_id, value, row_number() OVER (PARTITION BY client ORDER BY value DESC, request_id) - 1 pos, count(*) OVER (PARTITION BY client) n FROM v_log)"


@query(f"WITH {V.LOG}, {BAND}, b AS (SELECT *, row_number() OVER (PARTITION BY client ORDER BY pos) rn FROM r "
    f"WHERE pos >= cast(floor(n * 0.1) AS bigint) AND pos < cast(floor(n * 0.5) AS bigint)) SELECT client, request_id FROM b WHERE rn <= 4")
def g2_percentile_band(spark, d):
    rows = V.log(spark, d).select("client", "request_id", "value")
    n = rows.groupBy("client").agg(F.count("*").alias("n"))
    r = rows.withColumn("pos", F.row_number().over(Window.partitionBy("client").orderBy(F.desc("value"), "request_id")) - 1).join(n, "client")
    inside = r.where((F.col("pos") >= F.floor(F.col("n") * 0.1)) & (F.col("pos") < F.floor(F.col("n") * 0.5)))
    return sampling._ranked(inside, ["client"], F.col("pos")).where("rn <= 4").select("client", "request_id")


@query(f"""WITH {V.LOG}, {BAND}, b AS (SELECT *, row_number() OVER (PARTITION BY client ORDER BY pos) rn FROM r
 WHERE pos >= cast(floor(n * 0.1) AS bigint) AND pos < cast(floor(n * 0.5) AS bigint)), band AS (SELECT client, request_id, 'band' how FROM b WHERE rn <= 3),
 o AS (SELECT client, request_id, row_number() OVER (PARTITION BY client ORDER BY sha256('42|' || request_id), request_id) rn FROM v_log
 WHERE request_id NOT IN (SELECT request_id FROM band)) SELECT * FROM band UNION ALL SELECT client, request_id, 'random' FROM o WHERE rn = 1""")
def g3_mixed_selection(spark, d):
    rows = V.log(spark, d).select("client", "request_id", "value")
    n = rows.groupBy("client").agg(F.count("*").alias("n"))
    r = rows.withColumn("pos", F.row_number().over(Window.partitionBy("client").orderBy(F.desc("value"), "request_id")) - 1).join(n, "client")
    inside = r.where((F.col("pos") >= F.floor(F.col("n") * 0.1)) & (F.col("pos") < F.floor(F.col("n") * 0.5)))
    band = sampling._ranked(inside, ["client"], F.col("pos")).where("rn <= 3").select("client", "request_id", F.lit("band").alias("how"))
    rest = rows.join(band.select("request_id"), "request_id", "left_anti")
    return band.unionByName(sampling.stratum_sample(rest, 1, "request_id", "client").select("client", "request_id", F.lit("random").alias("how")))


@query(f"WITH {V.UNIT}, r AS (SELECT *, row_number() OVER (PARTITION BY cluster_id "
    f"ORDER BY sha256('42|' || unit_id), unit_id) a, row_number() OVER (PARTITION BY cluster_id ORDER BY length(observation) DESC, seq) b "
        f"FROM v_unit) SELECT unit_id, cluster_id, seq, a <= 2 random_pick, b <= 2 score_pick FROM r WHERE a <= 2 OR b <= 2")
def g4_turn_selection(spark, d):
    u = V.unit(spark, d).withColumn("score", F.length("observation"))
    a = sampling.stratum_sample(u, 2, "unit_id", "cluster_id").select("unit_id", F.lit(True).alias("a"))
    b = sampling.top_score(u, 2, "score", "seq").select("unit_id", F.lit(True).alias("b"))
    both = a.join(b, "unit_id", "full").join(u.select("unit_id", "cluster_id", "seq"), "unit_id")
    return both.select("unit_id", "cluster_id", "seq", F.coalesce("a", F.lit(False)).alias("random_pick"), F.coalesce("b", F.lit(False)).alias("score_pick"))


@query("SELECT l_partkey, count(*) n FROM lineitem "
    "WHERE l_partkey IN (SELECT l_partkey FROM lineitem WHERE l_returnflag = 'A' INTERSECT SELECT l_partkey FROM lineitem WHERE l_returnflag = 'R') GROUP BY 1")
def g5_coverage_alignment(spark, d):
    lines = V._t(spark, d, "lineitem").select("l_partkey", "l_returnflag")
    common = lines.where("l_returnflag = 'A'").select("l_partkey").intersect(lines.where("l_returnflag = 'R'").select("l_partkey"))
    return lines.join(common, "l_partkey", "left_semi").groupBy("l_partkey").agg(F.count("*").alias("n"))


@query("WITH n AS (SELECT count(*) n FROM customer WHERE c_mktsegment = 'BUILDING') SELECT c_custkey "
    "FROM (SELECT c_custkey, row_number() OVER (ORDER BY sha256('42|' || c_custkey), c_custkey) rn FROM customer WHERE c_mktsegment <> 'BUILDING'), n "
        "WHERE rn <= n")
def g6_matched_count(spark, d):
    c = V._t(spark, d, "customer").select("c_custkey", "c_mktsegment")
    n = c.where("c_mktsegment = 'BUILDING'").count()
    return sampling.first_n(c.where("c_mktsegment <> 'BUILDING'"), n, "c_custkey").select("c_custkey")


@query(f"WITH {V.DRAW} SELECT unit_id FROM v_rec WHERE dis = 1")
def g7_disagreement_only(spark, d):
    return V.draw(spark, d).where(E.disagreement(F.col("draws"), F.col("base_value"))).select("unit_id")


@query(f"WITH {V.DRAW}, c AS (SELECT CASE WHEN k = 0 THEN 'invalid' WHEN k < calls / 2.0 THEN 'technical' WHEN dis = 1 THEN 'decision' ELSE 'agreement' END class "
    f"FROM v_rec) SELECT class, count(*) n, round(count(*) / (SELECT count(*) FROM c), 6) share FROM c GROUP BY 1")
def g8_outcome_partition(spark, d):
    r = V.draw(spark, d).select(F.size("draws").alias("calls"), F.size(F.filter("draws", lambda x: x["valid"])).alias("k"),
        E.disagreement(F.col("draws"), F.col("base_value")).alias("dis"))
    c = r.select(F.when(F.col("k") == 0, "invalid").when(F.col("k") < F.col("calls") / 2, "technical").when(F.col("dis"),
        "decision").otherwise("agreement").alias("class"))
    return E.pmf(c, "class").join(c.groupBy("class").agg(F.count("*").alias("n")), "class").select("class", "n", F.round("p", 6).alias("share"))


@query("SELECT quality judged, count(*) FILTER (toxic = 0) clean, count(*) FILTER (toxic = 1) toxic, round(count(*) FILTER (toxic = 1) / count(*), 6) toxic_rate "
    "FROM labels GROUP BY 1")
def g9_confusion_matrix(spark, d):
    wide = V._t(spark, d, "labels").groupBy(F.col("quality").alias("judged")).pivot("toxic", [0, 1]).count().na.fill(0)
    return wide.select("judged", F.col("0").alias("clean"), F.col("1").alias("toxic"), F.round(F.col("1") / (F.col("0") + F.col("1")), 6).alias("toxic_rate"))


@query("SELECT l_returnflag experiment, round(avg(CASE WHEN l_quantity < 10 THEN 0 WHEN l_quantity < 30 THEN 0.5 ELSE 1 END), 6) ordinal_mean, count(*) n "
    "FROM lineitem GROUP BY 1")
def g10_ordinal_mean(spark, d):
    o = F.when(F.col("l_quantity") < 10, 0.0).when(F.col("l_quantity") < 30, 0.5).otherwise(1.0)
    return V._t(spark, d, "lineitem").groupBy(F.col("l_returnflag").alias("experiment")).agg(F.round(F.avg(o), 6).alias("ordinal_mean"),
        F.count("*").alias("n"))


@query(f"""WITH {V.LABEL}, t AS (SELECT cluster_id, cast(sum(toxic) AS double) a, count(toxic) b, row_number() OVER (ORDER BY cluster_id) - 1 cluster_no
 FROM v_label GROUP BY 1), dr AS (SELECT rep, cast(('0x' || substr(sha256('42|c|' || rep || '|' || i), 1, 12)) AS bigint) % 20 cluster_no
 FROM range(400) a(rep), range(20) b(i)),
 s AS (SELECT rep, sum(a) a, sum(b) b FROM dr JOIN t USING (cluster_no) GROUP BY 1 HAVING sum(b) > 0 ORDER BY rep LIMIT 200),
 x AS (SELECT a / b x FROM s) SELECT round((SELECT sum(a) / sum(b)
 FROM t), 6) estimate, round(list_sort(list(x))[cast(floor(0.025 * (count(*) - 1)) AS bigint) + 1], 6) lower, round(list_sort(list(x))[cast(floor(0.975 * (count(*) - 1)) AS bigint) + 1], 6) upper, count(*) kept FROM x""")
def g11_pooled_rate_bootstrap(spark, d):
    from tessera.operators import bootstrap

    t = V.label(spark, d).groupBy("cluster_id").agg(F.sum("toxic").cast("double").alias("a"), F.count("toxic").cast("double").alias("b"))
    return bootstrap.ratio(spark, t, "a", "b", "cluster_id", 200).withColumns({c: F.round(c, 6) for c in ("estimate", "lower", "upper")})


@query("""WITH p AS (SELECT doc_id, 'low' q FROM labels WHERE quality = 0 UNION ALL SELECT doc_id, 'toxic' FROM labels WHERE toxic = 1 UNION ALL
 SELECT doc_id, 'any' FROM labels), r AS (SELECT *, row_number() OVER (PARTITION BY q ORDER BY sha256('42|' || doc_id), doc_id) rn FROM p)
 SELECT doc_id, array_to_string(list_sort(list_distinct(list(q))), '+') predicates FROM r WHERE rn <= 15 GROUP BY 1""")
def g12_audit_sample(spark, d):
    labels = V._t(spark, d, "labels")
    parts = [labels.where(w).select("doc_id", F.lit(n).alias("q")) for w, n in (("quality = 0", "low"), ("toxic = 1", "toxic"), ("true", "any"))]
    picked = sampling.stratum_sample(parts[0].unionByName(parts[1]).unionByName(parts[2]), 15, "doc_id", "q")
    return picked.groupBy("doc_id").agg(F.array_join(F.array_sort(F.collect_set("q")), "+").alias("predicates"))


@query("""WITH a AS (SELECT lang v, count(*) / (SELECT count(*) FROM documents) p FROM documents GROUP BY 1),
 b AS (SELECT lang v, count(*) / (SELECT count(*) FROM documents WHERE n_chars > 1500) q FROM documents WHERE n_chars > 1500 GROUP BY 1),
 j AS (SELECT greatest(coalesce(p, 0), 1e-12) p, greatest(coalesce(q, 0), 1e-12) q FROM a FULL JOIN b USING (v))
 SELECT round(sum(0.5 * p * ln(p / ((p + q) / 2)) + 0.5 * q * ln(q / ((p + q) / 2))), 6) js FROM j""")
def g13_floored_js(spark, d):
    docs = V._t(spark, d, "documents").select("lang", "n_chars")
    both = E.pmf(docs, "lang").withColumnRenamed("p", "a").join(E.pmf(docs.where("n_chars > 1500"), "lang").withColumnRenamed("p", "b"), "lang", "full")
    floor = lambda c: F.greatest(F.coalesce(c, F.lit(0.0)), F.lit(1e-12))
    return both.agg(F.round(F.sum(E.js_terms(floor("a"), floor("b"))), 6).alias("js"))


@query("""WITH c AS (SELECT o_custkey, avg(o_totalprice) x, count(*) n FROM orders GROUP BY 1),
 q AS (SELECT quantile_cont(x, 0.25) a, quantile_cont(x, 0.5) b, quantile_cont(x, 0.75) c FROM c)
 SELECT cast((x > a)::int + (x > b)::int + (x > q.c)::int AS int) bucket, count(*) clusters, round(avg(n), 6) mean_n FROM c, q GROUP BY 1""")
def g14_quantile_buckets(spark, d):
    c = V._t(spark, d, "orders").groupBy("o_custkey").agg(F.avg("o_totalprice").alias("x"), F.count("*").alias("n"))
    cuts = quantiles(c, [], "x", {"p": 0.25, "q": 0.5, "r": 0.75}).drop("n")
    at = sum(((F.col("x") > F.col(k)).cast("int") for k in "pqr"), F.lit(0))
    return with_values(c, cuts).groupBy(at.alias("bucket")).agg(F.count("*").alias("clusters"), F.round(F.avg("n"), 6).alias("mean_n"))


@query("""WITH s AS (SELECT c_custkey s, c_mktsegment seg, c_nationkey nat FROM customer WHERE c_custkey % 100 = 0),
 t AS (SELECT c_custkey t, c_mktsegment seg, c_nationkey nat FROM customer WHERE c_custkey % 100 <> 0),
 o AS (SELECT g.seg, g.nat, t, row_number() OVER (PARTITION BY g.seg, g.nat ORDER BY sha256('42|' || t), t) rn
 FROM (SELECT DISTINCT seg, nat FROM s) g JOIN t ON t.seg = g.seg AND t.nat <> g.nat) SELECT s, t FROM s JOIN o ON o.seg = s.seg AND o.nat = s.nat
 WHERE rn <= 6""")
def g15_random_neighbours(spark, d):
    """The first six transfer targets of other clusters in a shared random order of each stratum.

    The first six of each stratum and cluster hold the first six of any stratum without one cluster.
    """
    c = V._t(spark, d, "customer").select("c_custkey", "c_mktsegment", "c_nationkey")
    first = lambda keys, order: F.row_number().over(Window.partitionBy(*keys).orderBy(*order))
    t = sampling.stable_order(c.where("c_custkey % 100 <> 0"), "c_custkey").select(F.col("c_custkey").alias("t"), "c_mktsegment",
        F.col("c_nationkey").alias("nat"), "shuffle_key")
    t = t.withColumn("rn", first(["c_mktsegment", "nat"], ["shuffle_key", "t"])).where("rn <= 6").drop("rn")
    s = c.where("c_custkey % 100 = 0").select(F.col("c_custkey").alias("s"), "c_mktsegment", "c_nationkey")
    others = s.select("c_mktsegment", "c_nationkey").distinct().join(t, "c_mktsegment").where("c_nationkey <> nat")
    others = others.withColumn("rn", first(["c_mktsegment", "c_nationkey"], ["shuffle_key", "t"])).where("rn <= 6")
    return s.join(others, ["c_mktsegment", "c_nationkey"]).select("s", "t")


@query(f"""WITH {V.UNIT}, h AS (SELECT *, count(*) OVER (PARTITION BY cluster_id ORDER BY seq ROWS UNBOUNDED PRECEDING) history FROM v_unit)
 SELECT unit_id, cluster_id, cast(history AS int) history FROM h WHERE valid AND role = 'assistant'""")
def g17_history_rows(spark, d):
    """Targets are valid replies; invalid turns stay in their histories."""
    line = F.concat("role", F.lit(":"), "observation")
    h = history.told(V.unit(spark, d), "cluster_id", "seq", line, ["unit_id", "valid", "role"])
    return h.where("valid and role = 'assistant'").select("unit_id", "cluster_id", F.col("n_messages").alias("history"))
