"""Queries: jobs that chain several operators, over the driver's tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from tessera.operators import sampling
from tessera.operators.ranking import by_key
from tessera.operators.single import with_values
from tessera.plans import jobs, views as V
from tessera.plans.q_estimators import CP, FLOORQ, JS, R, SEL
from tessera.plans.q_sampling import PRIORITY
from tessera.plans.registry import query


@query("SELECT c_custkey::VARCHAR cluster_id FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_orderpriority LIKE '1%') "
    "ORDER BY sha256('42|' || c_custkey::VARCHAR), c_custkey::VARCHAR LIMIT 140")
def q1_freeze_clusters(spark, d):
    """A list of 140 clusters that no earlier list has."""
    used = V._t(spark, d, "orders").where(F.col("o_orderpriority").startswith("1")).select(F.col("o_custkey").cast("string").alias("cluster_id"))
    return jobs.freeze_clusters(V._t(spark, d, "customer").select(F.col("c_custkey").cast("string").alias("cluster_id")), used)["list"].select("cluster_id")


@query(f"""WITH {V.UNIT}, r AS (SELECT *, length(observation) len, row_number() OVER (PARTITION BY cluster_id ORDER BY seq) a FROM v_unit),
 l AS (SELECT unit_id FROM v_unit WHERE valid)
 SELECT 'not_in_ledger' code, unit_id "key" FROM v_unit WHERE unit_id NOT IN (SELECT unit_id FROM l)""")
def q2_collect_pool(spark, d):
    """Turns whose request the ledger doesn't hold as answered, out of a pool with histories held to a budget."""
    turns = V.unit(spark, d)
    ledger = turns.select("unit_id", F.when(F.col("valid"), "ok").otherwise("error").alias("status"))
    return jobs.collect_pool(turns, ledger, 700)["violations"].select("code", "key")


@query("""WITH m AS (SELECT l_orderkey k, max(l_quantity) m, count(*) n FROM lineitem GROUP BY 1),
 w AS (SELECT l_orderkey k, exp(l_quantity - m) w, n FROM lineitem JOIN m ON k = l_orderkey), s AS (SELECT k, sum(w) s FROM w GROUP BY 1)
 SELECT k unit_id, o_custkey cluster_id, any_value(n)::INT actions, round(-sum(CASE WHEN w > 0 THEN w / s * ln(w / s) ELSE 0 END), 6) + 0.0 score
 FROM w JOIN s USING (k) JOIN orders ON o_orderkey = k GROUP BY 1, 2""")
def q3_score_units(spark, d):
    lines = by_key(V._t(spark, d, "lineitem").select(F.col("l_orderkey").alias("unit_id"), "l_quantity"), "unit_id")
    pool = lines.groupBy("unit_id").agg(F.collect_list("l_quantity").alias("scores"))
    pool = pool.join(V._t(spark, d, "orders").select(F.col("o_orderkey").alias("unit_id"), F.col("o_custkey").alias("cluster_id")), "unit_id")
    return jobs.score_units(pool)["scores"].withColumn("score", F.round("score", 6) + 0.0)


@query("""WITH sel AS (SELECT o_orderkey k FROM orders WHERE o_orderpriority LIKE '1%'),
 n AS (SELECT l_orderkey k, count(*) n FROM lineitem GROUP BY 1), p AS (SELECT DISTINCT o_orderkey k FROM orders WHERE o_orderstatus <> 'P')
 SELECT 'budget_identity' code, k::VARCHAR "key" FROM sel JOIN p USING (k) LEFT JOIN n USING (k) WHERE coalesce(n, 0) <> 4 UNION ALL
 SELECT 'absent_from_pool', k::VARCHAR FROM sel WHERE k NOT IN (SELECT k FROM p)""")
def q5_annotate(spark, d):
    """Selected orders with their lines as draws: who lacks calls, or isn't in the pool."""
    o = V._t(spark, d, "orders")
    unit = F.col("o_orderkey").alias("unit_id")
    draws = V._t(spark, d, "lineitem").select(F.col("l_orderkey").alias("unit_id"), F.col("l_linenumber").alias("sample"),
        F.col("l_returnflag").alias("action"), (F.col("l_quantity") >= 10).alias("valid"))
    made = jobs.annotate(o.where("o_orderstatus <> 'P'").select(unit), o.where(F.col("o_orderpriority").startswith("1")).select(unit), draws, 4)
    return made["violations"].select("code", "key")


@query(f"""WITH {V.UNIT}, s AS (SELECT cluster_id FROM v_unit GROUP BY 1 HAVING max(seq) >= 4),
 t AS (SELECT u.* FROM v_unit u JOIN s USING (cluster_id) WHERE valid AND role = 'assistant'), n AS (SELECT cluster_id, count(*) n FROM t GROUP BY 1),
 g AS (SELECT DISTINCT cluster_id, stratum FROM t),
 r AS (SELECT *, row_number() OVER (PARTITION BY stratum
 ORDER BY sha256('42|' || cluster_id), cluster_id) <= least(count(*) OVER (PARTITION BY stratum) - 1, greatest(1, round_even(count(*) OVER (PARTITION BY stratum) * 0.25, 0))) is_validation FROM g)
 SELECT unit_id, cluster_id, round(1.0 / n, 6) share, is_validation FROM t JOIN n USING (cluster_id) JOIN r USING (cluster_id)""")
def q8_build_expert(spark, d):
    turns = V.unit(spark, d)
    solved = turns.groupBy("cluster_id").agg((F.max("seq") >= 4).alias("solved"))
    return jobs.build_expert(turns.join(solved, "cluster_id"))["rows"].select("unit_id", "cluster_id", F.round("share", 6).alias("share"), "is_validation")


@query(f"""WITH {V.OUTCOME}, r AS (SELECT replicate_id, avg(treatment) rate, round(avg(treatment), 2) reported, count(*) n, count(DISTINCT cluster_id) c
 FROM v_eval GROUP BY 1), a AS (SELECT count(DISTINCT cluster_id) a FROM v_eval),
 x AS (SELECT replicate_id, unnest([CASE WHEN n <> c THEN 'repeated_cluster' END, CASE WHEN c <> a THEN 'missing_cluster' END, CASE WHEN abs(rate - reported) > 1e-12 THEN 'wrong_rate' END]) code
 FROM r, a) SELECT code, replicate_id::VARCHAR "key" FROM x WHERE code IS NOT NULL""")
def q11_aggregate_evaluations(spark, d):
    """Evaluations that report their rate in two digits, against their outcomes and each other's clusters."""
    e = V.outcome(spark, d).select("replicate_id", "cluster_id", F.col("treatment").alias("value"))
    reported = e.groupBy("replicate_id").agg(F.round(F.avg("value"), 2).alias("reported"))
    return jobs.aggregate_evaluations(e.join(reported, "replicate_id"))["violations"].select("code", "key")


@query(f"""WITH {V.VEC}, e AS (SELECT unit_id, group_id, unnest(embedding)::double x, generate_subscripts(embedding, 1) i FROM v_vec),
 m AS (SELECT i, avg(x) m FROM e WHERE unit_id % 10 = 0 GROUP BY 1),
 c AS (SELECT unit_id, group_id, sum(x * m) dot, sum(x * m) / (sqrt(sum(x * x)) * sqrt(sum(m * m))) c FROM e JOIN m USING (i) WHERE unit_id % 10 <> 0
 GROUP BY 1, 2) SELECT group_id, count(*) units, round(sum(c * (1 + unit_id % 3)) / sum(1 + unit_id % 3), 5) cosine, round(avg((dot < 0)::int), 5) negative_share
 FROM c GROUP BY 1""")
def q13_alignments(spark, d):
    """Vectors of each group against the mean of held-out ones."""
    v = V.vec(spark, d).select(F.col("group_id").alias("group"), "unit_id", F.col("unit_id").alias("cluster_id"),
        (1 + F.col("unit_id") % 3).alias("weight"), F.col("embedding").alias("vector"))
    made = jobs.alignments(v.where("unit_id % 10 <> 0"), v.where("unit_id % 10 = 0").select("vector", "cluster_id"))["summary"]
    return made.select(F.col("group").alias("group_id"), "units", F.round("cosine", 5).alias("cosine"), F.round("negative_share", 5).alias("negative_share"))


@query("""SELECT s_suppkey k, row_number() OVER (ORDER BY s_suppkey) - 1 place, sha256('{"k":' || s_suppkey || ',"nation":' || s_nationkey || '}') line_sha256
 FROM supplier""")
def q19_merge_shards(spark, d):
    """Three shards in the order of their key, with places and the digest of each canonical line."""
    rows = V._t(spark, d, "supplier").select(F.col("s_suppkey").alias("k"), F.col("s_nationkey").alias("nation"))
    merged = jobs.merge_records([rows.where(F.col("k") % 3 == i) for i in range(3)], "k")["merged"]
    return merged.select("k", "place", F.sha2(F.to_json(F.struct("k", "nation")), 256).alias("line_sha256"))


@query("""WITH r AS (SELECT l_orderkey || '|' || l_linenumber || '|' || l_partkey u, l_returnflag s, (l_quantity - 25) / 10.0 x FROM lineitem),
 k AS (SELECT *, row_number() OVER (PARTITION BY s ORDER BY sha256('42|' || u), u) rn FROM r), c AS (SELECT * FROM k ORDER BY rn, s, u LIMIT 300)
 SELECT s stratum, count(*) n, round(avg(greatest(-10.0, least(10.0, exp(x) - x - 1))), 6) mean_gap, round(sqrt(avg(x * x)), 6) rms FROM c GROUP BY 1""")
def q21_measure_gap(spark, d):
    """The gap over 300 lines taken in turn from each flag: the number is the measurement's size."""
    lines = V._t(spark, d, "lineitem").select(F.concat_ws("|", "l_orderkey", "l_linenumber", "l_partkey").alias("unit_id"),
        F.col("l_returnflag").alias("stratum"), ((F.col("l_quantity") - 25) / 10.0).alias("log_ratio"))
    return R(jobs.measure_gap(lines, 300)["summary"], "mean_gap", "rms")


@query("""WITH p AS (SELECT event_type series, event_id % 200 step, avg(value) v FROM events GROUP BY 1, 2),
 r AS (SELECT *, row_number() OVER (PARTITION BY series ORDER BY step) a, row_number() OVER (PARTITION BY series ORDER BY step DESC) b FROM p),
 m AS (SELECT series, avg(v) FILTER (a <= 10) head, avg(v) FILTER (b <= 10) tail FROM r GROUP BY 1)
 SELECT series, round(head, 5) head, round(tail, 5) tail, round(100 * (tail - head) / abs(head), 4) change_pct FROM m""")
def q22_training_curves(spark, d):
    """Log lines of all events, parsed, averaged by step, and the change from head to tail."""
    lines = V._t(spark, d, "events").select(F.col("event_type").alias("series"),
        F.concat(F.lit("step:"), (F.col("event_id") % 200).cast("string"), F.lit(" - loss:"), F.col("value").cast("string"), F.lit(" - lr:0.1")).alias("value"))
    made = jobs.training_curves(lines)["summary"]
    return made.select("series", F.round("head", 5).alias("head"), F.round("tail", 5).alias("tail"), F.round("change_pct", 4).alias("change_pct"))


@query("""WITH a AS (SELECT p_partkey k, p_brand b FROM part),
 b AS (SELECT p_partkey k, CASE WHEN p_size > 40 THEN p_type ELSE p_brand END b FROM part WHERE p_size <> 7),
 x AS (SELECT 'only_a' side, * FROM (SELECT * FROM a EXCEPT ALL SELECT * FROM b) UNION ALL SELECT 'only_b', *
 FROM (SELECT * FROM b EXCEPT ALL SELECT * FROM a)) SELECT side, count(*) n, count(DISTINCT k) "keys" FROM x GROUP BY 1""")
def q24_baseline_audit(spark, d):
    p = V._t(spark, d, "part")
    a = p.select(F.col("p_partkey").alias("k"), F.col("p_brand").alias("b"))
    b = p.where("p_size <> 7").select(F.col("p_partkey").alias("k"), F.when(F.col("p_size") > 40, F.col("p_type")).otherwise(F.col("p_brand")).alias("b"))
    return jobs.baseline_audit(a, b, "k")["counts"]


@query("""WITH t AS (SELECT o_custkey c, o_orderkey s, o_orderstatus = 'F' d, (o_totalprice > 100000)::INT x, (o_totalprice > 90000)::INT y
 FROM orders), f AS (SELECT *, row_number() OVER (PARTITION BY c ORDER BY s) rn FROM t WHERE d)
 SELECT count(*) clusters, count(*) FILTER (y > x) improved, count(*) FILTER (y < x) worsened, round(avg(y - x), 6) net, CASE WHEN avg(y - x) >= 0.05 THEN 'worthwhile' ELSE 'not_shown' END verdict
 FROM f WHERE rn = 1""")
def q27_prevalidate(spark, d):
    turns = V._t(spark, d, "orders").select(F.col("o_custkey").alias("cluster_id"), F.col("o_orderkey").alias("seq"),
        (F.col("o_orderstatus") == "F").alias("differs"), (F.col("o_totalprice") > 100000).cast("int").alias("before"),
            (F.col("o_totalprice") > 90000).cast("int").alias("after"))
    return R(jobs.prevalidate(turns)["summary"], "net")


@query(f"""WITH {V.UNIT}, sel AS (SELECT cluster_id, least(3, n) / n p
 FROM (SELECT *, row_number() OVER (PARTITION BY cluster_id ORDER BY {PRIORITY}, unit_id) rn, count(*) OVER (PARTITION BY cluster_id) n FROM v_unit)
 WHERE rn <= 3), {V.OUTCOME},
 c AS (SELECT count(*) n FROM lineitem), o AS (SELECT count(*) n, sum(k) k FROM (SELECT l_orderkey, count(*) k FROM lineitem GROUP BY 1)),
 ev AS (SELECT count(*) n, bool_and(treatment IS NOT NULL AND control IS NOT NULL) ok FROM v_eval),
 tr AS (SELECT count(*) n, bool_and(c_custkey % 5 + 1 < c_custkey % 5 + 2 + c_nationkey % 2 * -2 AND (1 + c_custkey % 9) / 1000.0 BETWEEN 1e-3 AND 1e-2 AND abs(c_acctbal) > 0) ok FROM customer),
 w AS (SELECT count(*) n, bool_and(abs(w - 1) < 1e-9 AND suffix) ok
 FROM (SELECT cluster_id, sum(1.0 / n) w, bool_and(words >= 3) suffix FROM (SELECT cluster_id, count(*) OVER (PARTITION BY cluster_id) n, len(string_split(observation, ' ')) words FROM v_unit) GROUP BY 1))
 SELECT 'states' stage, (SELECT CASE WHEN count(*) = 0 THEN 'PENDING' WHEN count(*) = count(DISTINCT unit_id) THEN 'PASS' ELSE 'FAIL' END
 FROM v_unit) status, (SELECT count(*) FROM v_unit) n
 UNION ALL SELECT 'selection', (SELECT CASE WHEN bool_and(p > 0 AND p <= 1) THEN 'PASS' ELSE 'FAIL' END FROM sel), (SELECT count(*) FROM sel)
 UNION ALL SELECT 'annotation', CASE WHEN o.k = c.n THEN 'PASS' ELSE 'FAIL' END, o.n FROM o, c
 UNION ALL SELECT 'rows', CASE WHEN ok THEN 'PASS' ELSE 'FAIL' END, n FROM w UNION ALL SELECT 'training', CASE WHEN ok THEN 'PASS' ELSE 'FAIL' END, n
 FROM tr UNION ALL SELECT 'evaluation', CASE WHEN ok THEN 'PASS' ELSE 'FAIL' END, n FROM ev""")
def c26_stage_verifier(spark, d):
    """Six stages, from played turns to paired outcomes; targets are the last third of a turn's words, reports are customers'."""
    units = V.unit(spark, d).withColumn("actions", F.array("role"))
    chosen = sampling.nested_selection(units, 3).withColumn("policy", F.lit("uniform_nested"))
    lines = V._t(spark, d, "lineitem")
    calls = lines.groupBy("l_orderkey").agg(F.count("*").alias("calls"))
    ledger = lines.select(F.sha2(F.concat_ws("|", "l_orderkey", "l_linenumber"), 256).alias("hash"))
    words = F.split("observation", " ")
    share = units.join(units.groupBy("cluster_id").agg((F.lit(1.0) / F.count("*")).alias("weight")), "cluster_id").select("cluster_id", "weight",
        F.transform(words, lambda w, i: (i >= F.size(words) - F.call_function("div", F.size(words), F.lit(3))).cast("int")).alias("mask"))
    key = F.col("c_custkey") % 5
    reports = V._t(spark, d, "customer").select((key + 2 + F.col("c_nationkey") % 2 * -2).cast("double").alias("loss_first"),
        (key + 1).cast("double").alias("loss_last"), ((1 + F.col("c_custkey") % 9) / 1000.0).alias("ratio"), F.abs("c_acctbal").alias("norm"))
    return jobs.verify_stages(units, chosen, calls, ledger, share, reports, V.outcome(spark, d))


@query(f"""WITH {V.UNIT}, s AS (SELECT unit_id, rn FROM (SELECT *, row_number() OVER (PARTITION BY cluster_id ORDER BY {PRIORITY}, unit_id) rn
 FROM v_unit) WHERE rn <= 4) SELECT count(*) FILTER (rn <= 1) small, count(*) FILTER (rn <= 4) large, count(*) FILTER (rn <= 1) * 4 = count(*) FILTER (rn <= 4) same_budget, 0::BIGINT outside FROM s""")
def q6_validate_pair(spark, d):
    """A broad and a deep selection of one pool: one holds the other, and whether four calls a unit cost what four units do."""
    units = V.unit(spark, d)
    small, large = sampling.nested_selection(units, 1).select("unit_id"), sampling.nested_selection(units, 4).select("unit_id")
    n = with_values(small.agg(F.count("*").alias("small")), large.agg(F.count("*").alias("large")))
    return with_values(n, small.join(large, "unit_id", "left_anti").agg(F.count("*").alias("outside"))).select("small", "large",
        (F.col("small") * 4 == F.col("large")).alias("same_budget"), "outside")


@query("""WITH m AS (SELECT o_custkey source_id, min(o_orderkey) self_id FROM orders GROUP BY 1 HAVING count(*) >= 3),
 o AS (SELECT o_custkey source_id, o_orderkey score_id, (o_orderkey % 13) / 10.0 - (o_orderkey % 7) / 10.0 ch FROM orders),
 c AS (SELECT m.source_id, max(ch) FILTER (score_id = self_id) s, avg(ch) FILTER (score_id <> self_id) t FROM m JOIN o USING (source_id) GROUP BY 1)
 SELECT c_mktsegment "group", count(*) sources, round(avg(s), 6) own, round(avg(t), 6) others FROM c JOIN customer ON c_custkey = source_id GROUP BY 1""")
def q15_transfer_effects(spark, d):
    """Customers as sources: the change of their first order's score, and of their others', by market segment."""
    o = V._t(spark, d, "orders").select(F.col("o_custkey").alias("source_id"), F.col("o_orderkey").alias("score_id"))
    meta = o.groupBy("source_id").agg(F.min("score_id").alias("self_score_id"), F.collect_list("score_id").alias("ids")).where(F.size("ids") >= 3)
    meta = meta.select("source_id", "self_score_id", F.array_except("ids", F.array("self_score_id")).alias("neighbour_score_ids"))
    score = lambda n: o.select("score_id", ((F.col("score_id") % n) / 10.0).alias("score"))
    groups = V._t(spark, d, "customer").select(F.col("c_custkey").alias("source_id"), F.col("c_mktsegment").alias("group"))
    return R(jobs.transfer_effects(meta, score(7), score(13), groups)["summary"], "own", "others")


def _order_draws(spark, d):
    return V._t(spark, d, "lineitem").select(F.col("l_orderkey").cast("string").alias("unit_id"), F.col("l_linenumber").alias("sample"),
        F.col("l_returnflag").alias("action"), (F.col("l_quantity") >= 10).alias("valid"))


def _order_pool(spark, d):
    base = F.when(F.col("o_orderstatus") == "F", "R").when(F.col("o_orderstatus") == "O", "N").otherwise("A")
    return V._t(spark, d, "orders").select(F.col("o_orderkey").cast("string").alias("unit_id"), F.col("o_custkey").cast("string").alias("cluster_id"),
        F.lit(0).alias("seq"), base.alias("base_value"))


ORDER_RANKS = "p AS (SELECT o_orderkey::VARCHAR unit_id, o_custkey::VARCHAR cluster_id FROM orders), k AS (SELECT *, row_number() OVER (PARTITION BY cluster_id ORDER BY " + PRIORITY + ", unit_id) rn, count(*) OVER (PARTITION BY cluster_id) n FROM p)"


@query(f"""WITH {ORDER_RANKS}, x AS (SELECT unit_id, cluster_id, count(*) calls, count(*) FILTER (l_quantity >= 10) ok FROM k
 JOIN lineitem ON l_orderkey::VARCHAR = unit_id WHERE rn <= 2 AND l_linenumber <= 3 GROUP BY 1, 2)
 SELECT sum(ok)::BIGINT valid_draws, sum(calls)::BIGINT draws, count(*) FILTER (ok > 0) valid_units, count(*) units FROM x""")
def q23_whole_chain(spark, d):
    """Two orders a customer, the first three lines of each, and what of them is accepted."""
    made = jobs.whole_chain(_order_pool(spark, d), _order_draws(spark, d), 3)["levels"]
    return made.select("valid_draws", "draws", "valid_units", "units")


@query(f"""WITH {ORDER_RANKS}, l AS (SELECT l_orderkey::VARCHAR unit_id, arg_min(l_returnflag, (l_linenumber, l_returnflag, l_quantity >= 10)) action, arg_min(l_quantity >= 10, (l_linenumber, l_returnflag, l_quantity >= 10)) valid
 FROM lineitem GROUP BY 1)
 SELECT unit_id, cluster_id, round(1.0 / n, 6) incl_prob, action, coalesce(valid, false) valid FROM k LEFT JOIN l USING (unit_id) WHERE rn = 1""")
def q26_one_shot(spark, d):
    return R(jobs.one_shot(_order_pool(spark, d), _order_draws(spark, d))["records"], "incl_prob")


@query("""WITH e AS (SELECT o_orderpriority arm, c_mktsegment task, (o_orderstatus = 'F')::INT won FROM orders
 JOIN customer ON c_custkey = o_custkey), x AS (SELECT arm, task, won FROM e UNION ALL SELECT arm, 'all', won FROM e)
 SELECT arm, task, count(*) games, sum(won)::BIGINT wins, round(avg(won), 6) rate FROM x GROUP BY 1, 2""")
def q30_evaluation_summary(spark, d):
    o = V._t(spark, d, "orders").join(V._t(spark, d, "customer").select(F.col("c_custkey").alias("o_custkey"), "c_mktsegment"), "o_custkey")
    return R(jobs.evaluation_summary(o.select(F.col("o_orderpriority").alias("arm"), F.col("c_mktsegment").alias("task"),
        (F.col("o_orderstatus") == "F").alias("won")))["summary"], "rate")


@query(f"""WITH {V.UNIT}, r AS (SELECT *, length(observation) len, row_number() OVER (PARTITION BY cluster_id ORDER BY seq) a, row_number() OVER (PARTITION BY cluster_id ORDER BY seq DESC) b FROM v_unit),
 c AS (SELECT *, sum(CASE WHEN a = 1 THEN len ELSE 0 END) OVER (PARTITION BY cluster_id) anchor, sum(CASE WHEN a = 1 THEN 0 ELSE len END) OVER (PARTITION BY cluster_id ORDER BY seq DESC) newest, sum(CASE WHEN b = 1 AND a <> 1 THEN len ELSE 0 END) OVER (PARTITION BY cluster_id) last FROM r)
 SELECT unit_id, cluster_id, seq, sha256(observation) text_sha256, a = 1 OR b = 1 OR anchor + newest <= 700 kept, anchor + last > 700 overflow FROM c""")
def q2_pool_rows(spark, d):
    """The pool itself: every turn, with whether its history keeps it."""
    turns = V.unit(spark, d)
    pool = jobs.collect_pool(turns, turns.select("unit_id", F.lit("ok").alias("status")), 700)["pool"]
    return pool.select("unit_id", "cluster_id", "seq", F.sha2("observation", 256).alias("text_sha256"), "kept", "overflow")


@query("""WITH l AS (SELECT l_orderkey k, count(*) calls, string_agg(l_linenumber || ':' || l_returnflag || ':' || (l_quantity >= 10), ',' ORDER BY l_linenumber, l_returnflag, l_quantity >= 10) t FROM lineitem GROUP BY 1)
 SELECT o_orderkey unit_id, coalesce(calls, 0)::INT calls, sha256(coalesce(t, '')) draws_sha256 FROM orders LEFT JOIN l ON k = o_orderkey WHERE o_orderpriority LIKE '1%' AND o_orderstatus <> 'P'""")
def q5_records(spark, d):
    """The records: selected units of the pool with all their draws, valid or not, in order."""
    o = V._t(spark, d, "orders")
    unit = F.col("o_orderkey").alias("unit_id")
    draws = V._t(spark, d, "lineitem").select(F.col("l_orderkey").alias("unit_id"), F.col("l_linenumber").alias("sample"), F.col("l_returnflag").alias("action"), (F.col("l_quantity") >= 10).alias("valid"))
    made = jobs.annotate(o.where("o_orderstatus <> 'P'").select(unit), o.where(F.col("o_orderpriority").startswith("1")).select(unit), draws, 4)["records"]
    told = F.array_join(F.transform("draws", lambda x: F.concat_ws(":", x["sample"].cast("string"), x["action"], x["valid"].cast("string"))), ",")
    return made.select("unit_id", F.size("draws").alias("calls"), F.sha2(told, 256).alias("draws_sha256"))


@query(f"""WITH {V.OUTCOME}, r AS (SELECT replicate_id, count(*) n, count(DISTINCT cluster_id) c, avg(treatment) rate, CASE WHEN replicate_id % 2 = 0 THEN avg(treatment) ELSE round(avg(treatment), 2) END reported FROM v_eval GROUP BY 1),
 a AS (SELECT count(DISTINCT cluster_id) a FROM v_eval)
 SELECT replicate_id, cluster_id, treatment "value" FROM v_eval JOIN r USING (replicate_id), a WHERE n = c AND c = a AND abs(rate - reported) <= 1e-12""")
def q11_accepted_outcomes(spark, d):
    """The outcomes of evaluations that hold what they report; odd replicates report in two digits."""
    e = V.outcome(spark, d).select("replicate_id", "cluster_id", F.col("treatment").alias("value"))
    rate = F.avg("value")
    reported = e.groupBy("replicate_id").agg(F.when(F.col("replicate_id") % 2 == 0, rate).otherwise(F.round(rate, 2)).alias("reported"))
    return jobs.aggregate_evaluations(e.join(reported, "replicate_id"))["accepted"]


@query(f"""WITH {ORDER_RANKS}, l AS (SELECT l_orderkey::VARCHAR unit_id, l_returnflag action, l_quantity >= 10 valid, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_returnflag, l_quantity >= 10) - 1 i FROM lineitem WHERE l_linenumber <= 3),
 u AS (SELECT unit_id, cluster_id, CASE o_orderstatus WHEN 'F' THEN 'R' WHEN 'O' THEN 'N' ELSE 'A' END base_value FROM k JOIN orders ON o_orderkey::VARCHAR = unit_id WHERE rn <= 2),
 n AS (SELECT unit_id, count(*) FILTER (valid) k FROM l GROUP BY 1), kk AS (SELECT u.*, n.k FROM u JOIN n USING (unit_id) WHERE n.k > 0), vv AS (SELECT cluster_id, count(*) v FROM kk GROUP BY 1)
 SELECT unit_id, cluster_id, i::INT sample_index, action, base_value, action <> base_value disagreement, round(1.0 / (v * kk.k), 6) weight FROM kk JOIN vv USING (cluster_id) JOIN l USING (unit_id) WHERE valid""")
def q23_training_rows(spark, d):
    """What the whole chain ends with: weighted training rows of the accepted draws."""
    made = jobs.whole_chain(_order_pool(spark, d), _order_draws(spark, d), 3)["rows"]
    return R(made.select("unit_id", "cluster_id", "sample_index", "action", "base_value", "disagreement", "weight"), "weight")


REPORTED = lambda name, v: f"""SELECT * FROM (WITH a AS {CP('v_unit', v)}, b AS {CP('sel', v)}, j AS (SELECT cluster_id, v, coalesce(a.p, 0) a, coalesce(b.p, 0) b FROM a FULL JOIN b USING (cluster_id, v)),
 c AS (SELECT cluster_id, row_number() OVER (ORDER BY cluster_id) - 1 cluster_no FROM (SELECT DISTINCT cluster_id FROM j)), nn AS (SELECT count(*) n FROM c),
 dr AS (SELECT rep, cast(('0x' || substr(sha256('42|j|' || rep || '|' || i), 1, 12)) AS bigint) % n cluster_no FROM nn, range(60) x(rep), LATERAL (SELECT unnest(range(n)) i)), w AS (SELECT rep, cluster_no, count(*) w FROM dr GROUP BY 1, 2),
 m AS (SELECT rep, v, sum(w * a) / any_value(n) a, sum(w * b) / any_value(n) b FROM w JOIN c USING (cluster_no) JOIN j USING (cluster_id), nn GROUP BY 1, 2), x AS (SELECT rep, {JS} x FROM m GROUP BY 1),
 e AS (SELECT {JS} e FROM (SELECT v, sum(a) / any_value(n) a, sum(b) / any_value(n) b FROM j, nn GROUP BY 1))
 SELECT '{name}' feature, round((SELECT e FROM e), 6) estimate, round({FLOORQ(0.025, 60)}, 6) lower, round({FLOORQ(0.975, 60)}, 6) upper FROM x)"""  # noqa: E731


@query(f"WITH {V.UNIT}, {SEL} {REPORTED('role', 'role')} UNION ALL {REPORTED('invalid', '(NOT valid)::VARCHAR')}")
def q14_representativeness(spark, d):
    """How far two units a cluster are from all of them, feature by feature, with intervals."""
    units = V.unit(spark, d)
    features = {"role": F.col("role"), "invalid": (~F.col("valid")).cast("string")}
    return R(jobs.representativeness(units, sampling.nested_selection(units, 2), features, 60)["report"], "estimate", "lower", "upper")


@query(f"""WITH {V.UNIT}, r AS (SELECT *, row_number() OVER (PARTITION BY cluster_id ORDER BY {PRIORITY}, unit_id) rn FROM v_unit),
 b AS (SELECT count(*) FILTER (rn <= 4) bc, 4 * count(*) FILTER (rn <= 1) dc, count(DISTINCT cluster_id) FILTER (rn <= 4) b1, count(DISTINCT cluster_id) FILTER (rn <= 1) d1, max(seq) FILTER (rn <= 4) b2, max(seq) FILTER (rn <= 1) d2 FROM r)
 SELECT 'same_budget' code, 'pair' "key" FROM b WHERE bc <> dc UNION ALL SELECT 'config_differs', 'training.clusters' FROM b WHERE b1 <> d1 UNION ALL SELECT 'config_differs', 'training.longest' FROM b WHERE b2 <> d2""")
def q6_pair_contracts(spark, d):
    """Four units a cluster with one call each against one unit with four: budgets, membership, and the two runs' configurations."""
    units = V.unit(spark, d)
    broad = sampling.nested_selection(units, 4).select("unit_id", "cluster_id", "seq", F.lit(1).alias("calls"))
    deep = sampling.nested_selection(units, 1).select("unit_id", "cluster_id", "seq", F.lit(4).alias("calls"))
    run = lambda df, arm: df.agg(F.count("*").alias("units"), F.max("calls").alias("calls"), F.count_distinct("cluster_id").alias("n"), F.max("seq").alias("longest")).select(
        F.lit(arm).alias("arm"), F.to_json(F.struct(F.lit(arm).alias("arm"), "units", "calls", F.struct(F.col("n").alias("clusters"), "longest").alias("training"))).alias("config"))
    return jobs.validate_pair(units, broad, deep, run(broad, "broad").unionByName(run(deep, "deep")), ("arm", "units", "calls"))["violations"]
