"""Queries: masks, alignments, entropies, bins, vectors, windows over ordered records."""

from __future__ import annotations

from pyspark.sql import functions as F

from tessera.functions import arrays as A
from tessera.operators import history, vectors
from tessera.operators.single import with_values
from tessera.plans import views as V
from tessera.plans.registry import query

R = lambda df, *cols: df.withColumns({c: F.round(c, 6) for c in cols})


def _lists(spark, d):
    x = V._t(spark, d, "lineitem").groupBy("l_orderkey").agg(F.array_sort(F.collect_list(F.struct("l_linenumber", "l_partkey", "l_suppkey",
        "l_quantity", "l_discount"))).alias("x"))
    return x.select("l_orderkey", F.transform("x", lambda s: s["l_quantity"]).alias("q"), F.transform("x", lambda s: s["l_discount"]).alias("dc"))


@query("WITH m AS (SELECT l_orderkey, max(l_quantity) m FROM lineitem GROUP BY 1), "
    "w AS (SELECT l_orderkey, exp(l_quantity - m) w FROM lineitem JOIN m USING (l_orderkey)), s AS (SELECT l_orderkey, sum(w) s FROM w GROUP BY 1) "
        "SELECT l_orderkey, round(-sum(CASE WHEN w > 0 THEN w / s * ln(w / s) ELSE 0 END), 6) + 0.0 entropy FROM w JOIN s USING (l_orderkey) GROUP BY 1")
def p6_admissible_entropy(spark, d):
    return _lists(spark, d).select("l_orderkey", (F.round(A.softmax_entropy(F.col("q")), 6) + 0.0).alias("entropy"))


@query("WITH r AS (SELECT o_orderkey, o_totalprice v FROM orders) "
    "SELECT o_orderkey, cast(least(9, floor((least(greatest(v, 1000), 200000) - 1000) / 199000.0 * 10)) AS int) bin FROM r")
def p18_fixed_width_bin(spark, d):
    return V._t(spark, d, "orders").select("o_orderkey", A.fixed_width_bin(F.col("o_totalprice"), 1000, 200000, 10).alias("bin"))


@query(f"""WITH {V.UNIT}, l AS (SELECT *, lag(observation) OVER (PARTITION BY cluster_id ORDER BY seq) p FROM v_unit)
 SELECT unit_id, stratum, cast(least(4, floor(least(greatest(seq, 0), 10) / 10.0 * 5)) AS int) depth_bin, coalesce(nullif(lower(split_part(observation, ' ', 1)), ''), 'none') first_word, (NOT valid)::int technical, (trim(observation) = '')::int empty_response, coalesce((observation = p)::int, 0) "repeat", coalesce((observation = p AND trim(observation) <> '')::int, 0) repeat_not_blank FROM l""")
def p17_diagnostic_features(spark, d):
    u = history.previous(V.unit(spark, d), "observation", "cluster_id", "seq")
    word = F.coalesce(F.nullif(F.lower(F.split_part("observation", F.lit(" "), F.lit(1))), F.lit("")), F.lit("none"))
    return u.select("unit_id", "stratum", A.fixed_width_bin(F.col("seq"), 0, 10, 5).alias("depth_bin"), word.alias("first_word"),
        (~F.col("valid")).cast("int").alias("technical"), (F.trim("observation") == "").cast("int").alias("empty_response"), "repeat", "repeat_not_blank")


@query(f"WITH {V.UNIT} SELECT unit_id, sha256(lag(observation) OVER (PARTITION BY cluster_id ORDER BY seq)) previous_sha FROM v_unit")
def w1_lag(spark, d):
    return history.previous(V.unit(spark, d), "observation", "cluster_id", "seq").select("unit_id", F.sha2("previous", 256).alias("previous_sha"))


@query("WITH s AS (SELECT l_orderkey, sum((l_quantity >= 10)::int) n FROM lineitem GROUP BY 1) "
    "SELECT l_orderkey, l_linenumber, round(CASE WHEN n > 0 THEN (l_quantity >= 10)::int * 0.5 / n ELSE 0 END, 6) token_weight FROM lineitem "
        "JOIN s USING (l_orderkey)")
def p32_token_weights(spark, d):
    x = V._t(spark, d, "lineitem").groupBy("l_orderkey").agg(F.array_sort(F.collect_list(F.struct("l_linenumber", "l_partkey", "l_suppkey",
        (F.col("l_quantity") >= 10).cast("int").alias("m")))).alias("x"))
    w = x.select("l_orderkey", "x", A.token_weights(F.transform("x", lambda s: s["m"]), F.lit(0.5)).alias("w"))
    return w.select("l_orderkey", F.explode(F.arrays_zip(F.transform("x", lambda s: s["l_linenumber"]).alias("n"),
        "w")).alias("z")).select("l_orderkey", F.col("z.n").alias("l_linenumber"), F.round("z.w", 6).alias("token_weight"))


@query("WITH r AS (SELECT l_orderkey, list((l_quantity >= 10)::int ORDER BY l_linenumber, l_partkey, l_suppkey, l_quantity, l_discount) m "
    "FROM lineitem GROUP BY 1) SELECT l_orderkey, array_to_string(list_append(m[2:], 0), '') mask FROM r")
def p32_prediction_mask(spark, d):
    x = _lists(spark, d).select("l_orderkey", A.shifted_left(F.transform("q", lambda q: (q >= 10).cast("int"))).alias("m"))
    return x.select("l_orderkey", F.array_join(F.transform("m", lambda v: v.cast("string")), "").alias("mask"))


@query("SELECT o_orderkey, repeat('1', cast(o_custkey % 5 AS int)) || repeat('0', cast(9 - o_custkey % 5 AS int)) mask FROM orders")
def p38_response_mask(spark, d):
    m = A.response_mask(F.col("o_custkey") % 5, F.lit(9))
    return V._t(spark, d, "orders").select("o_orderkey", F.array_join(F.transform(m, lambda v: v.cast("string")), "").alias("mask"))


@query("WITH r AS (SELECT l_orderkey, list(l_discount ORDER BY l_linenumber, l_partkey, l_suppkey, l_quantity, l_discount) s, count(*) n "
    "FROM lineitem GROUP BY 1) SELECT l_orderkey, cast(n AS int) n, round(coalesce(list_sum(s[1:n - 1]), 0), 6) + 0.0 total, cast((SELECT max(n) "
        "FROM r) AS int) width FROM r")
def p39_score_alignment(spark, d):
    """Padded to the longest sequence; one score leaves nothing but padding."""
    x = _lists(spark, d).select("l_orderkey", "dc")
    longest = V._t(spark, d, "lineitem").groupBy("l_orderkey").agg(F.count("*").alias("n")).agg(F.max("n").cast("int").alias("width"))
    a = with_values(x, longest).select("l_orderkey", F.size("dc").alias("n"), A.aligned(F.col("dc"), F.lit(1), F.size("dc") - 1, F.col("width")).alias("a"))
    return a.select("l_orderkey", "n", (F.round(A.total(F.col("a")), 6) + 0.0).alias("total"), F.size("a").alias("width"))


@query("WITH r AS (SELECT l_returnflag arm, (l_quantity - 25) / 10.0 kl FROM lineitem) "
    "SELECT arm, round(avg(greatest(-10.0, least(10.0, exp(kl) - kl - 1))), 6) mean_gap, round(avg((greatest(-10.0, least(10.0, exp(kl) - kl - 1)) >= 2.6)::int), 6) saturated "
        "FROM r GROUP BY 1")
def p43_saturated_gap(spark, d):
    gap = A.saturated_gap((F.col("l_quantity") - 25) / 10.0)
    return R(V._t(spark, d, "lineitem").groupBy(F.col("l_returnflag").alias("arm")).agg(F.avg(gap).alias("mean_gap"),
        F.avg((gap >= 2.6).cast("int")).alias("saturated")), "mean_gap", "saturated")


@query(f"WITH {V.VEC}, e AS (SELECT group_id, unnest(embedding)::double x, generate_subscripts(embedding, 1) i FROM v_vec) "
    f"SELECT group_id, cast(i - 1 AS int) i, round(avg(x), 5) mean FROM e GROUP BY 1, 2")
def a22_mean_vector(spark, d):
    m = vectors.mean_vector(V.vec(spark, d), ["group_id"], "embedding")
    return m.select("group_id", F.posexplode("mean").alias("i", "mean")).withColumn("mean", F.round("mean", 5))


@query(f"""WITH {V.VEC}, e AS (SELECT unit_id, group_id, unnest(embedding)::double x, generate_subscripts(embedding, 1) i FROM v_vec),
 m AS (SELECT group_id, i, avg(x) m FROM e GROUP BY 1, 2)
 SELECT unit_id, group_id, round(sum(x * m), 5) dot, round(sum(x * m) / (sqrt(sum(x * x)) * sqrt(sum(m * m))), 5) cosine FROM e
 JOIN m USING (group_id, i) GROUP BY 1, 2""")
def a21_alignment(spark, d):
    v = V.vec(spark, d)
    # one row a group: embeddings carry a handful of labels, and a larger side is shuffled as any join
    pairs = v.join(vectors.mean_vector(v, ["group_id"], "embedding"), "group_id")
    return vectors.alignment(pairs, "embedding", "mean").select("unit_id", "group_id", F.round("dot", 5).alias("dot"), F.round("cosine", 5).alias("cosine"))


@query(f"""WITH {V.VEC}, e AS (SELECT unit_id, group_id, unnest(embedding)::double x, generate_subscripts(embedding, 1) i FROM v_vec),
 m AS (SELECT i, avg(x) m FROM e GROUP BY 1),
 c AS (SELECT unit_id, group_id, sum(x * m) / (sqrt(sum(x * x)) * sqrt(sum(m * m))) c FROM e JOIN m USING (i) GROUP BY 1, 2)
 SELECT group_id, round(sum(c * (1 + unit_id % 3)) / sum(1 + unit_id % 3), 5) weighted_cosine, round(avg((c < 0)::int), 5) negative_share FROM c GROUP BY 1""")
def a23_weighted_alignment(spark, d):
    v = V.vec(spark, d)
    one = vectors.mean_vector(v.select(F.lit(0).alias("all"), "embedding"), ["all"], "embedding").select("mean")
    pairs = vectors.alignment(with_values(v, one), "embedding", "mean")
    w = 1 + F.col("unit_id") % 3
    return pairs.groupBy("group_id").agg(F.round(F.sum(F.col("cosine") * w) / F.sum(w), 5).alias("weighted_cosine"),
        F.round(F.avg((F.col("cosine") < 0).cast("int")), 5).alias("negative_share"))


@query("WITH r AS (SELECT l_orderkey, sum(l_quantity * l_quantity) a, sum(l_discount * l_discount + 1) b FROM lineitem GROUP BY 1) "
    "SELECT round(sqrt(sum(a)), 4) \"update\", round(sqrt(sum(b)), 4) base, round(sqrt(sum(a)) / sqrt(sum(b)), 6) ratio FROM r")
def p45_frobenius_ratio(spark, d):
    x = _lists(spark, d).select(F.col("q").alias("aat"), F.col("q").alias("btb"), A.total(F.transform("dc", lambda v: v * v + 1)).alias("base_sq"))
    return vectors.frobenius_ratio(x).select(F.round("update", 4).alias("update"), F.round("base", 4).alias("base"), F.round("ratio", 6).alias("ratio"))


DAILY = "v_day AS (SELECT event_type series, cast(date_trunc('day', ts) AS date) AS dy, avg(value) v FROM events GROUP BY 1, 2)"


def _daily(spark, d):
    return V._t(spark, d, "events").groupBy(F.col("event_type").alias("series"), F.to_date("ts").alias("dy")).agg(F.avg("value").alias("v"))


@query(f"WITH {DAILY} SELECT series, dy, round(avg(v) OVER (PARTITION BY series ORDER BY dy ROWS 4 PRECEDING), 6) smooth FROM v_day")
def w4_moving_average(spark, d):
    return history.moving_average(_daily(spark, d), "v", "dy", 5, "series").select("series", "dy", F.round("smooth", 6).alias("smooth"))


@query(f"WITH {DAILY}, r AS (SELECT *, row_number() OVER (PARTITION BY series ORDER BY dy) a, row_number() OVER (PARTITION BY series "
    f"ORDER BY dy DESC) b FROM v_day), m AS (SELECT series, avg(v) FILTER (a <= 10) head, avg(v) FILTER (b <= 10) tail FROM r GROUP BY 1) "
        f"SELECT series, round(head, 6) head, round(tail, 6) tail, round(100 * (tail - head) / abs(head), 6) change_pct FROM m")
def a37_head_tail_change(spark, d):
    return R(history.head_tail_change(_daily(spark, d), "v", "dy", 10, "series"), "head", "tail", "change_pct")


@query(f"WITH {V.UNIT}, l AS (SELECT *, lag(role) OVER (PARTITION BY cluster_id ORDER BY seq) p FROM v_unit) "
    f"SELECT cluster_id, coalesce(max((role = p)::int), 0) has_repeat FROM l GROUP BY 1")
def w6_consecutive_repeat(spark, d):
    return history.previous(V.unit(spark, d), "role", "cluster_id", "seq").groupBy("cluster_id").agg(F.max("repeat").alias("has_repeat"))


@query("SELECT o_custkey, o_orderpriority, count(*) n FROM orders GROUP BY 1, 2 HAVING count(*) > 1")
def w7_duplicate_identity(spark, d):
    return V._t(spark, d, "orders").groupBy("o_custkey", "o_orderpriority").agg(F.count("*").alias("n")).where("n > 1")


@query(f"WITH {V.UNIT}, r AS (SELECT *, row_number() OVER (PARTITION BY cluster_id ORDER BY seq) rn FROM v_unit "
    f"WHERE role = 'assistant' AND length(observation) > 100) SELECT cluster_id, seq, unit_id FROM r WHERE rn = 1")
def w10_first_matching(spark, d):
    return history.first_where(V.unit(spark, d), (F.col("role") == "assistant") & (F.length("observation") > 100), "cluster_id",
        "seq").select("cluster_id", "seq", "unit_id")


@query("SELECT o_orderpriority v, min(o_orderkey) first_seen, row_number() OVER (ORDER BY min(o_orderkey)) place FROM orders GROUP BY 1")
def w11_first_seen_order(spark, d):
    from tessera.operators.ranking import global_rank

    first = V._t(spark, d, "orders").groupBy(F.col("o_orderpriority").alias("v")).agg(F.min("o_orderkey").alias("first_seen"))
    return global_rank(first, ["first_seen"])[0].select("v", "first_seen", (F.col("place") + 1).alias("place"))


@query("SELECT o_orderkey, o_custkey, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) - 1 step FROM orders")
def w12_step_index(spark, d):
    from pyspark.sql.window import Window

    return V._t(spark, d, "orders").select("o_orderkey", "o_custkey",
        (F.row_number().over(Window.partitionBy("o_custkey").orderBy("o_orderdate", "o_orderkey")) - 1).cast("long").alias("step"))
