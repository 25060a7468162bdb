"""Queries: joins, set operations, merges and the stream's batch twin."""

from __future__ import annotations

from pyspark.sql import functions as F

from tessera.operators import sampling
from tessera.plans import views as V
from tessera.plans.q_sampling import PRIORITY
from tessera.plans.registry import query
from tessera.sources import records, stores
from tessera.streaming import ledger

SEL = f"sel AS (SELECT unit_id FROM (SELECT *, row_number() OVER (PARTITION BY cluster_id ORDER BY {PRIORITY}, unit_id) rn FROM v_unit) WHERE rn <= 1)"


@query(f"WITH {V.UNIT}, {SEL} SELECT unit_id, cluster_id, seq, role FROM v_unit JOIN sel USING (unit_id)")
def j1_selection_join(spark, d):
    units = V.unit(spark, d)
    return units.join(sampling.nested_selection(units, 1).select("unit_id"), "unit_id").select("unit_id", "cluster_id", "seq", "role")


@query("SELECT d.doc_id, d.lang, l.quality, l.toxic FROM documents d JOIN labels l ON d.doc_id = l.doc_id")
def j2_features_join(spark, d):
    return V._t(spark, d, "documents").select("doc_id", "lang").join(V._t(spark, d, "labels"), "doc_id").select("doc_id", "lang", "quality", "toxic")


@query(f"WITH {V.LOG}, x AS (SELECT request_id, sha256(props) h, status FROM v_log), "
    f"y AS (SELECT event_id request_id, sha256(CASE WHEN event_id % 10 = 0 THEN 'x' ELSE props END) h FROM events WHERE event_id % 7 <> 0) "
        f"SELECT request_id, status, x.h = y.h same FROM x JOIN y USING (request_id)")
def j3_ledger_join(spark, d):
    x = V.log(spark, d).select("request_id", F.sha2("props", 256).alias("h"), "status")
    y = V._t(spark, d, "events").where("event_id % 7 <> 0").select(F.col("event_id").alias("request_id"),
        F.sha2(F.when(F.col("event_id") % 10 == 0, "x").otherwise(F.col("props")), 256).alias("g"))
    return x.join(y, "request_id").select("request_id", "status", (F.col("h") == F.col("g")).alias("same"))


@query("""WITH b AS (SELECT o_orderkey score_id, o_totalprice s FROM orders WHERE o_orderkey % 5 <> 0),
 u AS (SELECT o_orderkey score_id, o_totalprice + 1 s FROM orders WHERE o_orderkey % 6 <> 0)
 SELECT score_id, CASE WHEN b.s IS NULL THEN 'only_updated' WHEN u.s IS NULL THEN 'only_base' ELSE 'paired' END side, round(u.s - b.s, 6) change
 FROM b FULL JOIN u USING (score_id)""")
def j4_exact_cover(spark, d):
    o = V._t(spark, d, "orders").select(F.col("o_orderkey").alias("score_id"), F.col("o_totalprice").alias("s"))
    b, u = o.where("score_id % 5 <> 0").withColumnRenamed("s", "b"), o.where("score_id % 6 <> 0").select("score_id", (F.col("s") + 1).alias("u"))
    side = F.when(F.col("b").isNull(), "only_updated").when(F.col("u").isNull(), "only_base").otherwise("paired")
    return b.join(u, "score_id", "full").select("score_id", side.alias("side"), F.round(F.col("u") - F.col("b"), 6).alias("change"))


@query("""WITH b AS (SELECT o_orderkey score_id, o_totalprice s FROM orders WHERE o_orderkey % 5 <> 0), u AS (SELECT o_orderkey score_id, o_totalprice + 1 s FROM orders WHERE o_orderkey % 6 <> 0),
 l AS (SELECT l_orderkey score_id, count(*) n FROM lineitem GROUP BY 1)
 SELECT score_id, CASE WHEN b.s IS NULL THEN 'only_updated' WHEN u.s IS NULL THEN 'only_base' ELSE 'paired' END side, coalesce(n, 0) n FROM b FULL JOIN u USING (score_id) LEFT JOIN l USING (score_id)""")
def j4_stores(spark, d):
    """Three stores of one layout: base and updated scores, and the lines of each, met on the key without moving rows again."""
    o = V._t(spark, d, "orders").select(F.col("o_orderkey").alias("score_id"), F.col("o_totalprice").alias("s"))
    lines = V._t(spark, d, "lineitem").select(F.col("l_orderkey").alias("score_id"), "l_linenumber")
    layout = stores.Layout.of(lines, "score_id")
    base = stores.stored(o.where("score_id % 5 <> 0").select("score_id", F.col("s").alias("b")), layout, "base")
    updated = stores.stored(o.where("score_id % 6 <> 0").select("score_id", (F.col("s") + 1).alias("u")), layout, "updated")
    counts = stores.stored(lines, layout, "lines").groupBy("score_id").agg(F.count("*").alias("n"))
    return stores.covered(base, updated, "score_id").join(counts, "score_id", "left").select("score_id", "side", F.coalesce("n", F.lit(0)).alias("n"))


@query("WITH m AS (SELECT l_orderkey, l_partkey FROM lineitem), p AS (SELECT p_partkey, p_retailprice x FROM part) "
    "SELECT l_orderkey, round(avg(x), 6) mean_score, count(*) n FROM m JOIN p ON l_partkey = p_partkey GROUP BY 1")
def j5_explode_join_aggregate(spark, d):
    meta = V._t(spark, d, "lineitem").groupBy("l_orderkey").agg(F.collect_list("l_partkey").alias("ids"))
    parts = V._t(spark, d, "part").select("p_partkey", "p_retailprice")
    return meta.select("l_orderkey", F.explode("ids").alias("p_partkey")).join(parts,
        "p_partkey").groupBy("l_orderkey").agg(F.round(F.avg("p_retailprice"), 6).alias("mean_score"), F.count("*").alias("n"))


@query("SELECT s_suppkey, s_nationkey, count(*) OVER (PARTITION BY s_suppkey) n FROM supplier")
def j7_unique_index(spark, d):
    s = V._t(spark, d, "supplier").select("s_suppkey", "s_nationkey")
    return s.join(s.groupBy("s_suppkey").agg(F.count("*").alias("n")), "s_suppkey")


@query("""WITH m AS (SELECT l_partkey unit_id, 'A' experiment, l_suppkey payload FROM lineitem WHERE l_returnflag = 'A' UNION ALL
 SELECT l_partkey, 'R', l_suppkey FROM lineitem WHERE l_returnflag = 'R')
 SELECT unit_id, count(*) memberships, array_to_string(list_sort(list_distinct(list(experiment))), ',') experiments, count(DISTINCT payload) = 1 consistent
 FROM m GROUP BY 1""")
def j8_union_memberships(spark, d):
    lines = V._t(spark, d, "lineitem").select(F.col("l_partkey").alias("unit_id"), F.col("l_returnflag").alias("experiment"),
        F.col("l_suppkey").alias("payload"))
    both = lines.where("experiment = 'A'").unionByName(lines.where("experiment = 'R'"))
    return both.groupBy("unit_id").agg(F.count("*").alias("memberships"),
        F.array_join(F.array_sort(F.collect_set("experiment")), ",").alias("experiments"), (F.count_distinct("payload") == 1).alias("consistent"))


@query(f"WITH {V.OUTCOME}, t AS (SELECT * FROM v_eval WHERE cluster_id <> 7), c AS (SELECT * FROM v_eval WHERE cluster_id <> 9) "
    f"SELECT replicate_id, cluster_id, t.treatment, c.control, t.treatment IS NOT NULL AND c.control IS NOT NULL paired FROM t FULL "
        f"JOIN c USING (replicate_id, cluster_id)")
def j9_paired_join(spark, d):
    e = V.outcome(spark, d)
    t, c = e.where("cluster_id <> 7").select("replicate_id", "cluster_id", "treatment"), e.where("cluster_id <> 9").select("replicate_id",
        "cluster_id", "control")
    return t.join(c, ["replicate_id", "cluster_id"], "full").withColumn("paired", F.col("treatment").isNotNull() & F.col("control").isNotNull())


@query(f"WITH {V.OUTCOME}, a AS (SELECT * FROM v_eval WHERE replicate_id = 0 AND cluster_id % 3 <> 0), "
    f"b AS (SELECT * FROM v_eval WHERE replicate_id = 1) SELECT cluster_id, a.treatment first_arm, b.treatment second_arm FROM a JOIN b USING (cluster_id)")
def j10_paired_episodes(spark, d):
    e = V.outcome(spark, d)
    a, b = e.where("replicate_id = 0 and cluster_id % 3 <> 0").select("cluster_id",
        F.col("treatment").alias("first_arm")), e.where("replicate_id = 1").select("cluster_id", F.col("treatment").alias("second_arm"))
    return a.join(b, "cluster_id")


@query(f"WITH {V.UNIT}, {SEL} SELECT unit_id FROM v_unit WHERE valid AND unit_id NOT IN (SELECT unit_id FROM sel)")
def j11_transfer_pool(spark, d):
    units = V.unit(spark, d)
    return units.where("valid").join(sampling.nested_selection(units, 1).select("unit_id"), "unit_id", "left_anti").select("unit_id")


@query("SELECT s_suppkey FROM supplier WHERE s_nationkey NOT IN (SELECT n_nationkey FROM nation WHERE n_regionkey = 1)")
def j12_exclusion(spark, d):
    return V._t(spark, d, "supplier").join(V._t(spark, d, "nation").where("n_regionkey = 1").select(F.col("n_nationkey").alias("s_nationkey")),
        "s_nationkey", "left_anti").select("s_suppkey")


@query(f"WITH {V.UNIT} SELECT x.unit_id, y.unit_id previous_id FROM v_unit x "
    f"JOIN v_unit y ON x.cluster_id = y.cluster_id AND y.seq = (SELECT max(seq) FROM v_unit z WHERE z.cluster_id = x.cluster_id AND z.seq < x.seq)")
def j14_previous_row(spark, d):
    from pyspark.sql.window import Window

    w = Window.partitionBy("cluster_id").orderBy("seq")
    return V.unit(spark, d).select("unit_id", F.lag("unit_id").over(w).alias("previous_id")).where("previous_id is not null")


@query("WITH t AS (SELECT c_mktsegment, c_nationkey % 5 b, count(*) wanted FROM customer WHERE c_custkey % 10 = 0 GROUP BY 1, 2), "
    "c AS (SELECT c_mktsegment, c_nationkey % 5 b, count(*) have FROM customer WHERE c_custkey % 10 <> 0 GROUP BY 1, 2) "
        "SELECT c_mktsegment, cast(b AS int) b, wanted, have, have < wanted short FROM t JOIN c USING (c_mktsegment, b)")
def j15_strata_join(spark, d):
    c = V._t(spark, d, "customer").select("c_custkey", "c_mktsegment", (F.col("c_nationkey") % 5).alias("b"))
    wanted, have = (c.where(w).groupBy("c_mktsegment", "b").agg(F.count("*").alias(n)) for w,
        n in (("c_custkey % 10 = 0", "wanted"), ("c_custkey % 10 <> 0", "have")))
    return wanted.join(have, ["c_mktsegment", "b"]).withColumn("short", F.col("have") < F.col("wanted"))


@query("WITH a AS (SELECT n_nationkey k, n_name FROM nation), "
    "b AS (SELECT n_nationkey k, CASE WHEN n_nationkey = 3 THEN 'X' ELSE n_name END n_name FROM nation WHERE n_nationkey <> 5) "
        "SELECT 'only_a' side, * FROM (SELECT * FROM a EXCEPT ALL SELECT * FROM b) UNION ALL SELECT 'only_b', * "
            "FROM (SELECT * FROM b EXCEPT ALL SELECT * FROM a)")
def j16_identity_comparison(spark, d):
    a = V._t(spark, d, "nation").select(F.col("n_nationkey").alias("k"), "n_name")
    b = a.where("k <> 5").select("k", F.when(F.col("k") == 3, "X").otherwise(F.col("n_name")).alias("n_name"))
    return a.exceptAll(b).select(F.lit("only_a").alias("side"), "*").unionByName(b.exceptAll(a).select(F.lit("only_b").alias("side"), "*"))


@query("WITH s AS (SELECT doc_id, source FROM documents WHERE doc_id % 3 = 0 UNION ALL SELECT doc_id, source FROM documents WHERE doc_id % 3 = 1 "
    "UNION ALL SELECT doc_id, source FROM documents WHERE doc_id % 30 = 0) SELECT doc_id, count(*) n, count(*) > 1 duplicate FROM s GROUP BY 1")
def s18_merge_shards(spark, d):
    docs = V._t(spark, d, "documents").select("doc_id", "source")
    merged, duplicates = records.merge_shards([docs.where("doc_id % 3 = 0"), docs.where("doc_id % 3 = 1"), docs.where("doc_id % 30 = 0")], "doc_id")
    flagged = merged.groupBy("doc_id").agg(F.count("*").alias("n"))
    return flagged.join(duplicates.select(F.col("key").cast("long").alias("doc_id"), F.lit(True).alias("f")), "doc_id", "left").select("doc_id", "n",
        F.coalesce("f", F.lit(False)).alias("duplicate"))


A, B = "SELECT DISTINCT o_custkey k FROM orders WHERE o_orderpriority LIKE '1%'", "SELECT DISTINCT o_custkey k FROM orders WHERE o_orderstatus = 'F'"


def _sets(spark, d):
    o = V._t(spark, d, "orders").select(F.col("o_custkey").alias("k"), "o_orderpriority", "o_orderstatus")
    return o.where("o_orderpriority like '1%'").select("k").distinct(), o.where("o_orderstatus = 'F'").select("k").distinct()


@query(f"SELECT 'union' op, count(*) n FROM ({A} UNION {B}) UNION ALL SELECT 'intersect', count(*) FROM ({A} INTERSECT {B}) UNION ALL "
    f"SELECT 'except', count(*) FROM ({A} EXCEPT {B}) UNION ALL SELECT 'symmetric', (SELECT count(*) FROM ({A} EXCEPT {B})) + (SELECT count(*) "
        f"FROM ({B} EXCEPT {A}))")
def u1_set_operations(spark, d):
    a, b = _sets(spark, d)
    both = a.withColumn("a", F.lit(1)).join(b.withColumn("b", F.lit(1)), "k", "full")
    n = both.agg(F.count("*").alias("union"), F.count_if(F.col("a").isNotNull() & F.col("b").isNotNull()).alias("intersect"),
        F.count_if(F.col("b").isNull()).alias("except"), F.count_if(F.col("a").isNull() | F.col("b").isNull()).alias("symmetric"))
    return n.unpivot([], ["union", "intersect", "except", "symmetric"], "op", "n")


@query(f"SELECT k FROM ({A} INTERSECT {B})")
def u3_intersection(spark, d):
    a, b = _sets(spark, d)
    return a.intersect(b)


@query(f"SELECT k FROM ({A} EXCEPT {B})")
def u4_difference(spark, d):
    a, b = _sets(spark, d)
    return a.subtract(b)


@query(f"SELECT count(*) = 0 is_subset FROM ({A} EXCEPT {B})")
def u5_subset(spark, d):
    a, b = _sets(spark, d)
    return a.join(b, "k", "left_anti").agg((F.count("*") == 0).alias("is_subset"))


@query("""WITH r AS (SELECT l_orderkey, list_distinct(list(l_suppkey) FILTER (l_returnflag = 'N')) a, list_distinct(list(l_suppkey) FILTER (l_returnflag <> 'N')) b
 FROM lineitem GROUP BY 1)
 SELECT l_orderkey, cast(coalesce(len(list_filter(a, lambda x: NOT list_contains(coalesce(b, []), x))), 0) AS int) only_a, cast(coalesce(len(list_filter(a, lambda x: list_contains(coalesce(b, []), x))), 0) AS int) common FROM r""")
def u8_array_set_operations(spark, d):
    r = V._t(spark, d, "lineitem").groupBy("l_orderkey").agg(F.collect_set(F.when(F.col("l_returnflag") == "N", F.col("l_suppkey"))).alias("a"),
        F.collect_set(F.when(F.col("l_returnflag") != "N", F.col("l_suppkey"))).alias("b"))
    return r.select("l_orderkey", F.size(F.array_except("a", "b")).alias("only_a"), F.size(F.array_intersect("a", "b")).alias("common"))


@query("WITH r AS (SELECT 'run' || (p_partkey % 4) run, 'ckpt-' || p_partkey path, p_partkey n FROM part) SELECT run, arg_max(path, n) latest "
    "FROM r GROUP BY 1")
def e3_latest_suffix(spark, d):
    r = V._t(spark, d, "part").select(F.concat(F.lit("run"), (F.col("p_partkey") % 4).cast("string")).alias("run"),
        F.concat(F.lit("ckpt-"), F.col("p_partkey").cast("string")).alias("path"))
    return r.groupBy("run").agg(F.max_by("path", F.regexp_extract("path", r"(\d+)$", 1).cast("long")).alias("latest"))


@query("SELECT doc_id, lang FROM (SELECT doc_id, lang, row_number() OVER (ORDER BY doc_id) rn FROM documents) WHERE rn = 17")
def e4_nth_row(spark, d):
    """The n-th row of a stated order: a top-k report."""
    first = V._t(spark, d, "documents").select("doc_id", "lang").orderBy("doc_id").limit(17)
    return first.orderBy(F.desc("doc_id")).limit(1)


@query("SELECT 'n' || (event_id % 3) cluster, event_id % 50 step, round(value, 3) loss FROM events")
def s12_training_log(spark, d):
    """Every event as a line of a log."""
    lines = V._t(spark, d, "events").select("event_id",
        F.concat(F.lit("step:"), (F.col("event_id") % 50).cast("string"), F.lit(" - loss:"), F.format_string("%.3f", F.round("value", 3)),
            F.lit(" - lr:0.1")).alias("value"))
    parsed = records.training_log(lines.select(F.concat("value", F.lit(" - cluster:"), (F.col("event_id") % 3).cast("string")).alias("value")),
        ["loss", "cluster"])
    return parsed.select(F.concat(F.lit("n"), F.col("cluster").cast("int").cast("string")).alias("cluster"), "step", "loss")


@query("SELECT date_trunc('hour', ts) window_start, event_type status, count(*) n FROM events GROUP BY 1, 2")
def x_tumbling_status_counts(spark, d):
    """The batch twin of the ledger stream's windowed counts; an extension."""
    return ledger.status_counts(V.log(spark, d), "ts", "status")


@query("SELECT c_nationkey, arg_max(c_custkey, struct_pack(a := c_acctbal, b := -c_custkey)) best FROM customer GROUP BY 1")
def l13_lexicographic_best(spark, d):
    return V._t(spark, d, "customer").groupBy("c_nationkey").agg(F.max_by("c_custkey", F.struct("c_acctbal", -F.col("c_custkey"))).alias("best"))
