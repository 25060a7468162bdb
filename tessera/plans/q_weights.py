"""Queries: training rows, weights, acceptance, batches, budgets."""

from __future__ import annotations

from pyspark.sql import functions as F

from tessera.operators import weights
from tessera.operators.ranking import global_rank
from tessera.plans import views as V
from tessera.plans.registry import query

ROWS = f"""WITH {V.DRAW}, kk AS (SELECT * FROM v_rec WHERE k > 0), vv AS (SELECT cluster_id, count(*) v FROM kk GROUP BY 1),
 tr AS (SELECT l.unit_id, l.cluster_id, cast(row_number() OVER (PARTITION BY l.unit_id
 ORDER BY ln) - 1 AS int) sample_index, action, l.base_value, valid, 1.0 / (v * k) w, 1.0 / k ws FROM v_line l JOIN kk USING (unit_id)
 JOIN vv ON vv.cluster_id = l.cluster_id),
 tv AS (SELECT * FROM tr WHERE valid)"""


@query(f"{ROWS} SELECT unit_id, cluster_id, sample_index, action, base_value, action <> base_value disagreement, round(w, 6) weight FROM tv")
def a1_training_rows(spark, d):
    return weights.training_rows(V.draw(spark, d)).withColumn("weight", F.round("weight", 6))


@query(f"{ROWS} SELECT 'state_mean' mode, round(sum(ws), 4) total, count(*) n_rows FROM tv UNION ALL "
    f"SELECT 'sample_mean', cast(count(*) AS double), count(*) FROM tv UNION ALL SELECT 'game_state_mean', round(sum(w), 4), count(*) FROM tv")
def a1_weight_totals(spark, d):
    records = V.draw(spark, d)
    parts = [weights.training_rows(records, m).agg(F.round(F.sum("weight"), 4).alias("total"),
        F.count("*").alias("n_rows")).select(F.lit(m).alias("mode"), "total", "n_rows") for m in ("state_mean", "sample_mean", "game_state_mean")]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


@query(f"""WITH {V.DRAW} SELECT cluster_id, grouping(cluster_id)::int is_total, count(*) selected_units, count(*) FILTER (k > 0) valid_units, cast(sum(calls) AS bigint) calls, cast(sum(k) AS bigint) valid_draws,
 round(count(*) FILTER (k > 0) / count(*), 6) unit_rate, round(sum(k) / sum(calls), 6) draw_rate, count(*) FILTER (k > 0) > 0 retained FROM v_rec
 GROUP BY ROLLUP (cluster_id)""")
def a2_acceptance(spark, d):
    return weights.acceptance(V.draw(spark, d)).withColumns({"unit_rate": F.round("unit_rate", 6), "draw_rate": F.round("draw_rate", 6)})


@query(f"WITH {V.LOG} SELECT status, count(*) n_selected, count(*) FILTER (value >= 20) n_valid, count(DISTINCT client) n_clients FROM v_log GROUP BY 1")
def a3_policy_summary(spark, d):
    return V.log(spark, d).groupBy("status").agg(F.count("*").alias("n_selected"), F.count_if(F.col("value") >= 20).alias("n_valid"),
        F.count_distinct("client").alias("n_clients"))


@query(f"{ROWS} SELECT unit_id, count(*) n_rows, round(sum(w), 6) weight, min(cluster_id) cluster_id, count(DISTINCT cluster_id) n_clusters FROM tv GROUP BY 1")
def a4_unit_groups(spark, d):
    return weights.unit_groups(weights.training_rows(V.draw(spark, d))).withColumn("weight", F.round("weight", 6))


@query(f"WITH {V.UNIT}, r AS (SELECT unit_id, (row_number() OVER (ORDER BY unit_id) - 1) // 32 batch FROM v_unit) "
    f"SELECT cast(batch AS bigint) batch, count(*) n, min(unit_id) first_unit, max(unit_id) last_unit FROM r GROUP BY 1")
def a5_fixed_batches(spark, d):
    placed, _ = global_rank(V.unit(spark, d).select("unit_id"), ["unit_id"])
    return placed.groupBy(F.floor(F.col("place") / 32).cast("long").alias("batch")).agg(F.count("*").alias("n"), F.min("unit_id").alias("first_unit"),
        F.max("unit_id").alias("last_unit"))


@query(f"WITH {V.DRAW} SELECT cast(sum(k) AS bigint) valid_draws, cast(sum(calls) AS bigint) draws, count(*) FILTER (k > 0) valid_units, count(*) units, count(DISTINCT CASE WHEN k > 0 THEN cluster_id END) valid_clusters, count(DISTINCT cluster_id) clusters FROM v_rec")
def a30_levels(spark, d):
    return weights.distinct_levels(V.draw(spark, d))


@query(f"WITH {V.UNIT}, n AS (SELECT cluster_id, count(*) n FROM v_unit GROUP BY 1) SELECT unit_id, cluster_id, round(1.0 / n, 6) share FROM v_unit "
    f"JOIN n USING (cluster_id)")
def a31_prompt_weights(spark, d):
    rows = weights.cluster_share(V.unit(spark, d))
    return rows.select("unit_id", "cluster_id", F.round("share", 6).alias("share"))


@query(f"""WITH {V.UNIT}, s AS (SELECT cluster_id FROM v_unit GROUP BY 1 HAVING max(CASE WHEN valid THEN seq END) >= 3),
 t AS (SELECT u.* FROM v_unit u JOIN s USING (cluster_id) WHERE role = 'assistant'), n AS (SELECT cluster_id, count(*) n FROM t GROUP BY 1)
 SELECT unit_id, cluster_id, cast(row_number() OVER (PARTITION BY cluster_id ORDER BY seq) - 1 AS int) step, round(1.0 / n, 6) share FROM t
 JOIN n USING (cluster_id)""")
def a32_expert_rows(spark, d):
    from pyspark.sql.window import Window

    units = V.unit(spark, d)
    solved = units.groupBy("cluster_id").agg(F.max(F.when(F.col("valid"), F.col("seq"))).alias("m")).where("m >= 3").select("cluster_id")
    turns = weights.cluster_share(units.join(solved, "cluster_id", "left_semi").where("role = 'assistant'"))
    return turns.select("unit_id", "cluster_id", (F.row_number().over(Window.partitionBy("cluster_id").orderBy("seq")) - 1).alias("step"),
        F.round("share", 6).alias("share"))


@query("SELECT l_returnflag arm, round(count(*) FILTER (l_discount > 0.05) * 8.0 / count(*), 6) normalizer, count(*) n FROM lineitem GROUP BY 1")
def a34_sampling_normalizer(spark, d):
    flag = F.col("l_discount") > 0.05
    return V._t(spark, d, "lineitem").groupBy(F.col("l_returnflag").alias("arm")).agg(F.round(F.count_if(flag) * 8.0 / F.count("*"),
        6).alias("normalizer"), F.count("*").alias("n"))


@query("""WITH r AS (SELECT l_orderkey, avg(l_extendedprice) FILTER (l_quantity >= 10) loss, sum(l_discount) w FROM lineitem GROUP BY 1)
 SELECT round(sum(loss * w), 2) numerator, round(sum(w) FILTER (loss IS NOT NULL), 4) denominator, round(sum(loss * w) / sum(w) FILTER (loss IS NOT NULL), 6) loss FROM r""")
def a35_weighted_loss(spark, d):
    lines = V._t(spark, d, "lineitem")
    rows = lines.groupBy("l_orderkey").agg(F.collect_list(F.struct("l_linenumber", "l_extendedprice",
        (F.col("l_quantity") >= 10).cast("double").alias("m"))).alias("x"), F.sum("l_discount").alias("w"))
    rows = rows.select(F.transform("x", lambda s: s["l_extendedprice"]).alias("losses"), F.transform("x", lambda s: s["m"]).alias("mask"), "w")
    return weights.weighted_loss(rows, "losses", "mask", "w").select(F.round("numerator", 2).alias("numerator"),
        F.round("denominator", 4).alias("denominator"), F.round("loss", 6).alias("loss"))


@query("""WITH r AS (SELECT o_orderkey, o_custkey % 5 + 1 n, sum(o_custkey % 5 + 1) OVER (ORDER BY o_orderkey) used FROM orders)
 SELECT o_orderkey, cast(n AS bigint) n, cast(used AS bigint) used FROM r WHERE used <= 500""")
def x2_budget_gate(spark, d):
    """Units in order while the draws asked for stay within the budget; the first of them bounds the rows the window sees."""
    from pyspark.sql.window import Window

    budget = 500
    units = V._t(spark, d, "orders").select("o_orderkey", (F.col("o_custkey") % 5 + 1).alias("n"))
    # every unit asks for at least one draw, so no more than `budget` units fit
    first = units.orderBy("o_orderkey").limit(budget)
    return first.withColumn("used", F.sum("n").over(Window.orderBy("o_orderkey"))).where(F.col("used") <= budget)
