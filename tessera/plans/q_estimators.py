"""Queries: distributions, design-based estimators, bootstraps, paired tests."""

from __future__ import annotations

from pyspark.sql import functions as F

from tessera.operators import bootstrap, estimators as E, sampling
from tessera.operators.selection import at_ranks
from tessera.operators.single import with_values
from tessera.plans import views as V
from tessera.plans.q_sampling import PRIORITY
from tessera.plans.registry import query

R = lambda df, *cols: df.withColumns({c: F.round(c, 6) for c in cols})
DRAWS = lambda tag, reps, n: f"(SELECT rep, cast(('0x' || substr(sha256('42|{tag}|' || rep || '|' || i), 1, 12)) AS bigint) % {n} cluster_no FROM range({reps}) a(rep), range({n}) b(i))"


@query("SELECT lang, round(count(*) / (SELECT count(*) FROM documents), 6) p FROM documents GROUP BY 1")
def a7_pmf(spark, d):
    return R(E.pmf(V._t(spark, d, "documents"), "lang"), "p")


BAL = f"WITH {V.LABEL}, c AS (SELECT cluster_id, stratum, count(*) n FROM v_label GROUP BY 1, 2), p AS (SELECT cluster_id, stratum, n / sum(n) OVER (PARTITION BY cluster_id) p FROM c)"


@query(f"{BAL} SELECT stratum, round(sum(p) / (SELECT count(DISTINCT cluster_id) FROM v_label), 6) p FROM p GROUP BY 1")
def a8_balanced_pmf(spark, d):
    return R(E.balanced_pmf(V.label(spark, d), "stratum"), "p")


def _halves(spark, d):
    u = V.unit(spark, d)
    return u, sampling.nested_selection(u, 2)


SEL = f"sel AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY cluster_id ORDER BY {PRIORITY}, unit_id) rn FROM v_unit) WHERE rn <= 2)"
CP = lambda t, v: f"(SELECT cluster_id, v, n / sum(n) OVER (PARTITION BY cluster_id) p FROM (SELECT cluster_id, {v} v, count(*) n FROM {t} GROUP BY 1, 2))"
JS = "sum(0.5 * (CASE WHEN a > 0 THEN a * ln(a / ((a + b) / 2)) ELSE 0 END + CASE WHEN b > 0 THEN b * ln(b / ((a + b) / 2)) ELSE 0 END))"


@query(f"""WITH {V.UNIT}, {SEL}, g AS (SELECT count(DISTINCT cluster_id) g FROM v_unit),
 p AS (SELECT v, sum(p) / any_value(g) a FROM {CP('v_unit', 'role')}, g GROUP BY 1),
 q AS (SELECT v, sum(p) / any_value(g) b FROM {CP('sel', 'role')}, g GROUP BY 1),
 j AS (SELECT coalesce(a, 0) a, coalesce(b, 0) b FROM p FULL JOIN q USING (v)) SELECT round({JS}, 6) js FROM j""")
def a9_jensen_shannon(spark, d):
    every, chosen = _halves(spark, d)
    return R(E.jensen_shannon(E.balanced_pmf(every, "role"), E.balanced_pmf(chosen, "role"), "role"), "js")


def _features(units):
    from tessera.functions.arrays import fixed_width_bin

    f = {"role": F.col("role"), "depth_bin": fixed_width_bin(F.col("seq"), 0, 10, 5).cast("string"),
        "length_bin": fixed_width_bin(F.length("observation"), 0, 400, 8).cast("string"), "invalid": (~F.col("valid")).cast("int").cast("string")}
    return units.select("cluster_id", F.explode(F.array(*[F.struct(F.lit(k).alias("feature"), c.alias("value")) for k,
        c in f.items()])).alias("x")).select("cluster_id", "x.feature", "x.value")


FEATS = lambda t: f"""(SELECT cluster_id, unnest(['role', 'depth_bin', 'length_bin', 'invalid']) feature, unnest([role, cast(least(4, floor(least(greatest(seq, 0), 10) / 10.0 * 5)) AS int)::varchar, cast(least(7, floor(least(length(observation), 400) / 400.0 * 8)) AS int)::varchar, (NOT valid)::int::varchar]) "value" FROM {t})"""


@query(f"""WITH {V.UNIT}, {SEL}, g AS (SELECT count(DISTINCT cluster_id) g FROM v_unit),
 pa AS (SELECT cluster_id, feature, "value", count(*) / sum(count(*)) OVER (PARTITION BY cluster_id, feature) p FROM {FEATS('v_unit')} GROUP BY 1, 2, 3),
 pb AS (SELECT cluster_id, feature, "value", count(*) / sum(count(*)) OVER (PARTITION BY cluster_id, feature) p FROM {FEATS('sel')} GROUP BY 1, 2, 3),
 a AS (SELECT feature, "value", sum(p) / any_value(g) a FROM pa, g GROUP BY 1, 2),
 b AS (SELECT feature, "value", sum(p) / any_value(g) b FROM pb, g GROUP BY 1, 2),
 j AS (SELECT feature, coalesce(a, 0) a, coalesce(b, 0) b FROM a FULL JOIN b USING (feature, "value"))
 SELECT feature, round({JS}, 6) js FROM j GROUP BY 1""")
def i9_representativeness_report(spark, d):
    every, chosen = _halves(spark, d)
    n = every.agg(F.count_distinct("cluster_id").alias("g"))

    def mass(units, name):
        counts = _features(units).groupBy("cluster_id", "feature", "value").agg(F.count("*").alias("n"))
        size = counts.groupBy("cluster_id", "feature").agg(F.sum("n").alias("s"))
        masses = counts.join(size, ["cluster_id", "feature"]).groupBy("feature", "value").agg(F.sum(F.col("n") / F.col("s")).alias("m"))
        return with_values(masses, n).select("feature", "value", (F.col("m") / F.col("g")).alias(name))

    both = mass(every, "a").join(mass(chosen, "b"), ["feature", "value"], "full").na.fill(0.0, ["a", "b"])
    return R(both.groupBy("feature").agg(F.sum(E.js_terms(F.col("a"), F.col("b"))).alias("js")), "js")


@query("SELECT c_nationkey FROM customer GROUP BY 1 HAVING count(DISTINCT c_mktsegment) = (SELECT count(DISTINCT c_mktsegment) FROM customer)")
def j13_common_support(spark, d):
    return E.common_support(V._t(spark, d, "customer").select("c_mktsegment", "c_nationkey"), "c_mktsegment", "c_nationkey")


@query(f"WITH {V.LABEL}, c AS (SELECT cluster_id, avg(quality) m, count(quality) o, count(*) - count(quality) x FROM v_label GROUP BY 1) "
    f"SELECT round(avg(m), 6) estimate, count(m) clusters, cast(sum(o) AS bigint) observed, cast(sum(x) AS bigint) missing FROM c")
def a10_balanced_indicator(spark, d):
    return R(E.balanced_indicator(V.label(spark, d), "quality"), "estimate")


@query(f"WITH {V.LABEL}, c AS (SELECT cluster_id, avg(toxic * (1 - quality)) a, avg(1 - quality) b, count(*) n FROM v_label WHERE quality IS NOT NULL "
    f"GROUP BY 1) SELECT round(sum(a) / sum(b), 6) estimate, count(*) clusters, cast(sum(n) AS bigint) rows_used FROM c")
def a11_balanced_ratio(spark, d):
    rows = V.label(spark, d).where("quality is not null").select("cluster_id", (F.col("toxic") * (1 - F.col("quality"))).alias("num"),
        (1 - F.col("quality")).alias("den"))
    return R(E.balanced_ratio(rows, "num", "den"), "estimate")


HT = f"""WITH {V.UNIT}, n AS (SELECT cluster_id, count(*) n FROM v_unit
 GROUP BY 1), {SEL}, t AS (SELECT s.cluster_id, sum((NOT valid)::int / (least(2, n) / n)) / any_value(n) a, sum((role = 'user')::int / (least(2, n) / n)) / any_value(n) b, sum((NOT valid AND role = 'user')::int / (least(2, n) / n)) / any_value(n) ab, count(*) m
 FROM sel s JOIN n USING (cluster_id) GROUP BY 1)"""


def _totals(spark, d):
    units = V.unit(spark, d)
    rows = sampling.nested_selection(units, 2).select("cluster_id", "incl_prob", (~F.col("valid")).cast("int").alias("bad"),
        (F.col("role") == "user").cast("int").alias("user"), (~F.col("valid") & (F.col("role") == "user")).cast("int").alias("both"))
    return E.cluster_totals(rows, units.groupBy("cluster_id").agg(F.count("*").alias("n_units")), {"a": "bad", "b": "user", "ab": "both"})


@query(f"{HT} SELECT round(avg(a), 6) estimate, count(*) clusters, cast(sum(m) AS bigint) sampled, cast(0 AS bigint) faults FROM t")
def a12_horvitz_thompson_mean(spark, d):
    return R(E.ht_mean(_totals(spark, d), "a"), "estimate")


@query(f"{HT} SELECT round(sum(ab) / sum(b), 6) estimate, count(*) clusters, cast(0 AS bigint) faults FROM t")
def a13_horvitz_thompson_ratio(spark, d):
    return R(E.ht_ratio(_totals(spark, d), "ab", "b"), "estimate")


@query(f"""WITH {V.LABEL}, x AS (SELECT stratum, cluster_id, quality q, toxic t FROM v_label WHERE quality IS NOT NULL),
 c AS (SELECT stratum, cluster_id, avg(t) t, avg(1 - q) l, avg(t * (1 - q)) tl FROM x GROUP BY 1, 2)
 SELECT stratum, unnest(['toxic', 'low', 'toxic_given_low', 'low_given_toxic']) quantity, unnest([round(avg(t), 6), round(avg(l), 6), round(sum(tl) / nullif(sum(l), 0), 6), round(sum(tl) / nullif(sum(t), 0), 6)]) estimate
 FROM c GROUP BY stratum""")
def a14_conditional_tables(spark, d):
    rows = V.label(spark, d).where("quality is not null").select("stratum", "cluster_id", F.col("toxic").alias("t"), (1 - F.col("quality")).alias("l"))
    per = rows.groupBy("stratum", "cluster_id").agg(F.avg("t").alias("t"), F.avg("l").alias("l"), F.avg(F.col("t") * F.col("l")).alias("tl"))
    wide = per.groupBy("stratum").agg(F.avg("t").alias("toxic"), F.avg("l").alias("low"),
        F.try_divide(F.sum("tl"), F.sum("l")).alias("toxic_given_low"), F.try_divide(F.sum("tl"), F.sum("t")).alias("low_given_toxic"))
    return R(wide.unpivot("stratum", ["toxic", "low", "toxic_given_low", "low_given_toxic"], "quantity", "estimate"), "estimate")


@query(f"WITH {V.DRAW} SELECT count(*) records, count(dis) defined, cast(sum(dis) AS bigint) disagree, count(*) - count(dis) undefined FROM v_rec")
def a15_report_counts(spark, d):
    dis = V.draw(spark, d).select(E.disagreement(F.col("draws"), F.col("base_value")).cast("int").alias("dis"))
    return dis.agg(F.count("*").alias("records"), F.count("dis").alias("defined"), F.sum("dis").alias("disagree"),
        F.count_if(F.col("dis").isNull()).alias("undefined"))


@query(f"WITH {V.DRAW} SELECT unit_id, dis = 1 disagreement FROM v_rec")
def p29_disagreement(spark, d):
    return V.draw(spark, d).select("unit_id", E.disagreement(F.col("draws"), F.col("base_value")).alias("disagreement"))


@query("SELECT doc_id, CASE WHEN d.n_chars < 200 THEN 'Strong' WHEN l.quality IS NULL THEN NULL WHEN l.quality = 1 THEN 'Skip' ELSE 'Weak' END label "
    "FROM documents d LEFT JOIN labels l USING (doc_id)")
def p30_label_resolution(spark, d):
    judged = F.when(F.col("quality") == 1, "Skip").when(F.col("quality") == 0, "Weak")
    return V.label(spark, d).select(F.col("unit_id").alias("doc_id"), E.resolved_label(F.col("n_chars") >= 200, judged).alias("label"))


@query(f"""WITH {V.LABEL}, m AS (SELECT cluster_id, avg(toxic) FILTER (stratum = 'en') a, avg(toxic) FILTER (stratum <> 'en') b FROM v_label
 WHERE toxic IS NOT NULL GROUP BY 1) SELECT count(*) clusters, round(avg(b - a), 6) difference FROM m WHERE a IS NOT NULL AND b IS NOT NULL""")
def a16_group_contrast(spark, d):
    rows = V.label(spark, d).where("toxic is not null")
    per = rows.groupBy("cluster_id").agg(F.avg(F.when(F.col("stratum") == "en", F.col("toxic"))).alias("a"),
        F.avg(F.when(F.col("stratum") != "en", F.col("toxic"))).alias("b")).where("a is not null and b is not null")
    return per.agg(F.count("*").alias("clusters"), F.round(F.avg(F.col("b") - F.col("a")), 6).alias("difference"))


@query(f"WITH {V.DRAW} SELECT unit_id, round(avg((action <> base_value)::int) FILTER (valid), 6) divergence, count(*) FILTER (valid) n_valid, round(avg((action = 'R')::int) FILTER (valid AND action <> base_value), 6) consequence_given_divergence "
    f"FROM v_line GROUP BY 1")
def a17_unit_summary(spark, d):
    x = V.draw(spark, d).select("unit_id", "base_value", F.explode("draws").alias("x"))
    differs = F.col("x.action") != F.col("base_value")
    return x.groupBy("unit_id").agg(F.round(F.avg(F.when(F.col("x.valid"), differs.cast("int"))), 6).alias("divergence"),
        F.count_if(F.col("x.valid")).alias("n_valid"),
            F.round(F.avg(F.when(F.col("x.valid") & differs, (F.col("x.action") == "R").cast("int"))), 6).alias("consequence_given_divergence"))


@query(f"""WITH {V.DRAW}, s AS (SELECT unit_id, any_value(cluster_id) cluster_id, avg((action <> base_value)::int) FILTER (valid) dv, avg((action = 'R' AND action <> base_value)::int) FILTER (valid) cq
 FROM v_line GROUP BY 1), c AS (SELECT cluster_id, avg(dv) dv, avg(cq) cq, count(*) FILTER (dv IS NULL) gaps FROM s GROUP BY 1)
 SELECT round(avg(cq), 6) descriptive, round(sum(cq) / nullif(sum(dv), 0), 6) conditional, cast(sum(gaps) AS bigint) undefined_units, CASE WHEN sum(gaps) > 0 THEN 'undefined_units' WHEN sum(dv) = 0 THEN 'no_divergence' END reason FROM c""")
def a18_population_estimates(spark, d):
    x = V.draw(spark, d).select("unit_id", "cluster_id", "base_value", F.explode("draws").alias("x"))
    differs = F.col("x.action") != F.col("base_value")
    s = x.groupBy("unit_id", "cluster_id").agg(F.avg(F.when(F.col("x.valid"), differs.cast("int"))).alias("dv"),
        F.avg(F.when(F.col("x.valid"), (differs & (F.col("x.action") == "R")).cast("int"))).alias("cq"))
    c = s.groupBy("cluster_id").agg(F.avg("dv").alias("dv"), F.avg("cq").alias("cq"), F.count_if(F.col("dv").isNull()).alias("gaps"))
    gaps = F.sum("gaps")
    return c.agg(F.round(F.avg("cq"), 6).alias("descriptive"), F.round(F.try_divide(F.sum("cq"), F.sum("dv")), 6).alias("conditional"),
        gaps.alias("undefined_units"), F.when(gaps > 0, "undefined_units").when(F.sum("dv") == 0, "no_divergence").alias("reason"))


@query(f"WITH {V.OUTCOME} SELECT replicate_id, count(*) clusters, cast(sum(treatment) AS bigint) successes, round(avg(treatment), 6) success_rate "
    f"FROM v_eval GROUP BY 1")
def a24_evaluation_bundle(spark, d):
    return V.outcome(spark, d).groupBy("replicate_id").agg(F.count("*").alias("clusters"), F.sum("treatment").alias("successes"),
        F.round(F.avg("treatment"), 6).alias("success_rate"))


@query("SELECT o_orderpriority task, grouping(o_orderpriority)::int is_total, count(*) n, count(*) FILTER (o_orderstatus = 'F') wins, round(count(*) FILTER (o_orderstatus = 'F') / count(*), 6) rate "
    "FROM orders GROUP BY ROLLUP (o_orderpriority)")
def a25_summary_by_task(spark, d):
    win = F.col("o_orderstatus") == "F"
    return V._t(spark, d, "orders").withColumnRenamed("o_orderpriority", "task").rollup("task").agg(F.grouping("task").cast("int").alias("is_total"),
        F.count("*").alias("n"), F.count_if(win).alias("wins"), F.round(F.count_if(win) / F.count("*"), 6).alias("rate"))


@query(f"""WITH {V.OUTCOME}, t AS (SELECT count(*) FILTER (treatment = 1 AND control = 1) "both", count(*) FILTER (treatment = 1 AND control = 0) only_a, count(*) FILTER (treatment = 0 AND control = 1) only_b, count(*) FILTER (treatment = 0 AND control = 0) neither FROM v_eval)
 SELECT *, round(least(1.0, 2 * (SELECT sum(exp(lgamma(only_a + only_b + 1) - lgamma(i + 1) - lgamma(only_a + only_b - i + 1) - (only_a + only_b) * ln(2.0)))
 FROM range(least(only_a, only_b) + 1) r(i))), 6) p_value FROM t""")
def a26_paired_table_mcnemar(spark, d):
    return R(E.mcnemar(V.outcome(spark, d), "treatment", "control"), "p_value")


@query(f"""WITH {V.LOG} SELECT status, round(avg(value), 6) mean, round(sqrt(avg(value * value)), 6) rms, round(quantile_cont(value, 0.9), 6) p90_linear, round(list_sort(list(value))[least(count(*) - 1, cast(floor(0.9 * count(*)) AS bigint)) + 1], 6) p90_index, round(list_sort(list(value))[count(*) // 2 + 1], 6) upper_median, round(avg((value >= 80)::int), 6) share_high
 FROM v_log GROUP BY 1""")
def a27_gap_statistics(spark, d):
    v = F.col("value")
    log = V.log(spark, d)
    ranks = {"p90_low": lambda n: F.floor((n - 1) * 0.9), "p90_high": lambda n: F.ceil((n - 1) * 0.9), "p90_index": lambda n: F.least(n - 1, F.floor(n * 0.9)), "upper_median": lambda n: F.floor(n / 2)}
    at = at_ranks(log, ["status"], "value", ranks)
    linear = F.col("p90_low") + (F.col("p90_high") - F.col("p90_low")) * ((F.col("n") - 1) * 0.9 - F.floor((F.col("n") - 1) * 0.9))
    sums = log.groupBy("status").agg(F.avg(v).alias("mean"), F.sqrt(F.avg(v * v)).alias("rms"), F.avg((v >= 80).cast("int")).alias("share_high"))
    columns = ["mean", "rms", "p90_linear", "p90_index", "upper_median", "share_high"]
    return R(sums.join(at.withColumn("p90_linear", linear), "status").select("status", *columns), *columns)


@query("WITH c AS (SELECT o_custkey % 20 grp, o_orderpriority v, count(*) n, min(o_orderkey) f FROM orders GROUP BY 1, 2), "
    "r AS (SELECT *, row_number() OVER (PARTITION BY grp ORDER BY n DESC, f) rn FROM c) SELECT cast(grp AS int) grp, v, n, cast(rn AS int) rn FROM r "
        "WHERE rn <= 3")
def a28_most_common(spark, d):
    from pyspark.sql.window import Window

    c = V._t(spark, d, "orders").groupBy((F.col("o_custkey") % 20).cast("int").alias("grp"),
        F.col("o_orderpriority").alias("v")).agg(F.count("*").alias("n"), F.min("o_orderkey").alias("f"))
    return c.withColumn("rn", F.row_number().over(Window.partitionBy("grp").orderBy(F.desc("n"), "f"))).where("rn <= 3").select("grp", "v", "n", "rn")


@query(f"WITH {V.LOG} SELECT status, count(*) n FROM v_log GROUP BY 1")
def a29_status_counts(spark, d):
    return V.log(spark, d).groupBy("status").agg(F.count("*").alias("n"))


@query(f"""WITH {V.OUTCOME} SELECT count(*) n, count(*) FILTER (treatment > control) improved, count(*) FILTER (treatment < control) worsened, round(avg(treatment - control), 6) net, CASE WHEN avg(treatment - control) >= 0.05 THEN 'worthwhile' ELSE 'not_shown' END verdict
 FROM v_eval""")
def a33_prevalidation(spark, d):
    gap = F.col("treatment") - F.col("control")
    return V.outcome(spark, d).agg(F.count("*").alias("n"), F.count_if(gap > 0).alias("improved"), F.count_if(gap < 0).alias("worsened"),
        F.round(F.avg(gap), 6).alias("net"), F.when(F.avg(gap) >= 0.05, "worthwhile").otherwise("not_shown").alias("verdict"))


@query("SELECT o_orderpriority task, count(*) n, CASE WHEN count(*) = count(CASE WHEN o_totalprice > 1000 THEN 1 END) THEN cast(sum(cast(o_totalprice AS bigint)) AS bigint) END total "
    "FROM orders GROUP BY 1")
def e1_total_unless_gaps(spark, d):
    x = F.when(F.col("o_totalprice") > 1000, F.col("o_totalprice"))
    return V._t(spark, d, "orders").select(F.col("o_orderpriority").alias("task"), x.alias("x"),
        F.bround("o_totalprice", 0).cast("long").alias("y")).groupBy("task").agg(F.count("*").alias("n"),
            F.when(F.count("*") == F.count("x"), F.sum("y")).alias("total"))


@query(f"""WITH {V.OUTCOME}, d AS (SELECT replicate_id, cluster_id, treatment - control x FROM v_eval), dg AS {DRAWS('g', 300, 50)}, ds AS {DRAWS('s', 300, 4)},
 wg AS (SELECT rep, cluster_no, count(*) w FROM dg GROUP BY 1, 2), ws AS (SELECT rep, cluster_no, count(*) w FROM ds GROUP BY 1, 2),
 x AS (SELECT g.rep, sum(g.w * s.w * x) / 200.0 x FROM wg g JOIN d ON d.cluster_id = g.cluster_no
 JOIN ws s ON s.rep = g.rep AND s.cluster_no = d.replicate_id GROUP BY 1)
 SELECT round((SELECT avg(x) FROM d), 6) estimate, round(quantile_cont(x, 0.025), 6) lower, round(quantile_cont(x, 0.975), 6) upper FROM x""")
def i1_crossed_bootstrap(spark, d):
    panel = V.outcome(spark, d).select("replicate_id", "cluster_id", (F.col("treatment") - F.col("control")).alias("x"))
    return R(bootstrap.crossed(spark, panel, "replicate_id", "cluster_id", "x", 300), "estimate", "lower", "upper")


FLOORQ = lambda p, n: f"list_sort(list(x))[cast(floor({p} * ({n} - 1)) AS bigint) + 1]"


@query(f"""WITH {V.LABEL}, en AS (SELECT * FROM v_label WHERE unit_id // 20 % 2 = 0),
 od AS (SELECT * FROM v_label WHERE unit_id // 20 % 2 = 1), a AS {CP('en', 'stratum')}, b AS {CP('od', 'stratum')}, j AS (SELECT cluster_id, v, coalesce(a.p, 0) a, coalesce(b.p, 0) b
 FROM a FULL JOIN b USING (cluster_id, v)),
 c AS (SELECT cluster_id, row_number() OVER (ORDER BY cluster_id) - 1 cluster_no
 FROM (SELECT DISTINCT cluster_id FROM j)), dr AS {DRAWS('j', 200, 20)}, w AS (SELECT rep, cluster_no, count(*) w FROM dr GROUP BY 1, 2),
 m AS (SELECT rep, v, sum(w * a) / 20 a, sum(w * b) / 20 b FROM w JOIN c USING (cluster_no) JOIN j USING (cluster_id) GROUP BY 1, 2),
 x AS (SELECT rep, {JS} x FROM m GROUP BY 1), e AS (SELECT {JS} e FROM (SELECT v, sum(a) / 20 a, sum(b) / 20 b FROM j GROUP BY 1))
 SELECT round((SELECT e FROM e), 6) estimate, round({FLOORQ(0.025, 200)}, 6) lower, round({FLOORQ(0.975, 200)}, 6) upper FROM x""")
def i3_paired_js_bootstrap(spark, d):
    rows = V.label(spark, d)
    a, b = (E.cluster_pmf(rows.where(f"unit_id div 20 % 2 = {k}"), "stratum") for k in (0, 1))
    return R(bootstrap.paired_js(spark, a, b, "stratum", 200), "estimate", "lower", "upper")


@query(f"""{HT}, c AS (SELECT *, row_number() OVER (ORDER BY cluster_id) - 1 cluster_no FROM t), nn AS (SELECT count(*) n FROM c),
 dr AS (SELECT rep, cast(('0x' || substr(sha256('42|c|' || rep || '|' || i), 1, 12)) AS bigint) % n cluster_no
 FROM nn, range(400) a(rep), LATERAL (SELECT unnest(range(n)) i)),
 s AS (SELECT rep, sum(ab) a, sum(b) b FROM dr JOIN c USING (cluster_no) GROUP BY 1 HAVING sum(b) > 0 ORDER BY rep LIMIT 200), x AS (SELECT a / b x FROM s)
 SELECT round((SELECT sum(ab) / sum(b) FROM t), 6) estimate, round({FLOORQ(0.025, 'count(*)')}, 6) lower, round({FLOORQ(0.975, 'count(*)')}, 6) upper, count(*) kept FROM x""")
def i4_ratio_bootstrap(spark, d):
    return R(bootstrap.ratio(spark, _totals(spark, d), "ab", "b", "cluster_id", 200), "estimate", "lower", "upper")


@query(f"""WITH {V.LABEL}, m AS (SELECT cluster_id, avg(toxic) FILTER (unit_id // 20 % 2 = 1) - avg(toxic) FILTER (unit_id // 20 % 2 = 0) z
 FROM v_label WHERE toxic IS NOT NULL GROUP BY 1), c AS (SELECT *, row_number() OVER (ORDER BY cluster_id) - 1 cluster_no FROM m
 WHERE z IS NOT NULL), n AS (SELECT count(*) n FROM c),
 dr AS (SELECT rep, cast(('0x' || substr(sha256('42|c|' || rep || '|' || i), 1, 12)) AS bigint) % n cluster_no
 FROM n, range(300) a(rep), LATERAL (SELECT unnest(range(n)) i)), x AS (SELECT rep, avg(z) x FROM dr JOIN c USING (cluster_no) GROUP BY 1)
 SELECT round((SELECT avg(z) FROM c), 6) estimate, round({FLOORQ(0.025, 'count(*)')}, 6) lower, round({FLOORQ(0.975, 'count(*)')}, 6) upper FROM x""")
def i5_difference_bootstrap(spark, d):
    rows = V.label(spark, d).where("toxic is not null")
    half = lambda k: F.avg(F.when(F.expr("unit_id div 20 % 2") == k, F.col("toxic")))
    per = rows.groupBy("cluster_id").agg((half(1) - half(0)).alias("z")).where("z is not null")
    return R(bootstrap.mean_difference(spark, per, "z", "cluster_id", 300), "estimate", "lower", "upper")


@query(f"""{HT}, c AS (SELECT *, row_number() OVER (ORDER BY cluster_id) - 1 cluster_no FROM t), nn AS (SELECT count(*) n FROM c),
 dr AS (SELECT rep, cast(('0x' || substr(sha256('42|c|' || rep || '|' || i), 1, 12)) AS bigint) % n cluster_no
 FROM nn, range(400) a(rep), LATERAL (SELECT unnest(range(n)) i)),
 s AS (SELECT rep, sum(ab) a, sum(a) b FROM dr JOIN c USING (cluster_no) GROUP BY 1 HAVING sum(a) > 0 ORDER BY rep LIMIT 200), x AS (SELECT a / b x FROM s)
 SELECT round((SELECT sum(ab) / sum(a) FROM t), 6) estimate, round(quantile_cont(x, 0.025), 6) lower, round(quantile_cont(x, 0.975), 6) upper, count(*) kept FROM x""")
def i6_position_bootstrap(spark, d):
    return R(bootstrap.ratio(spark, _totals(spark, d), "ab", "a", "cluster_id", 200, linear=True), "estimate", "lower", "upper")


#: The design of the regression, its columns in order of the names, the outcome last.
TERMS = ["intercept", "urgent", "s", "s_x_urgent", "o_orderstatus[O]", "o_orderstatus[P]"]
DESIGN = """d AS (SELECT o_custkey % 50 cluster, 1.0::DOUBLE x0, (o_orderpriority LIKE '1%')::INT::DOUBLE x1, (o_orderkey % 97) / 97.0::DOUBLE x2, (o_orderkey % 97) / 97.0::DOUBLE * (o_orderpriority LIKE '1%')::INT x3,
 (o_orderstatus = 'O')::INT::DOUBLE x4, (o_orderstatus = 'P')::INT::DOUBLE x5, o_totalprice / 1000 x6 FROM orders)"""


def eliminated(table: str, keep: str, k: int = 6) -> tuple[str, str]:
    """CTEs that solve the normal equations in columns m<i>_<j> of a table by Gauss-Jordan elimination, and the last one's name."""
    steps, last = [], table
    for p in range(k):
        cells = [f"m{i}_{j} - m{i}_{p} / m{p}_{p} * m{p}_{j} m{i}_{j}" if i != p else f"m{i}_{j} / m{p}_{p} m{i}_{j}" for i in range(k) for j in range(k + 1)]
        steps.append(f"{table}{p} AS (SELECT {keep}{', '.join(cells)} FROM {last})")
        last = f"{table}{p}"
    return ", ".join(steps), last


PRODUCTS = lambda w: ", ".join(f"sum({w}x{i} * x{j}) m{i}_{j}" for i in range(6) for j in range(7))
NORMAL, SOLVED = eliminated("e", "")
NORMAL_R, SOLVED_R = eliminated("q", "rep, ")


@query(f"WITH {DESIGN}, e AS (SELECT {PRODUCTS('')} FROM d), {NORMAL} SELECT unnest({TERMS}) term, unnest([{', '.join(f'round(m{i}_6, 6)' for i in range(6))}]) coefficient FROM {SOLVED}")
def a20_interaction_regression(spark, d):
    """Coefficients of a least-squares fit with interactions and indicator columns, by a tree of QR factors."""
    from tessera.operators import regression

    rows, terms = _design(spark, d)
    found = regression.fit(rows, terms, F.col("o_totalprice") / 1000, "cluster")
    return spark.createDataFrame([(k, round(v, 6)) for k, v in found.items()], "term string, coefficient double")


@query(f"""WITH {DESIGN}, e AS (SELECT {PRODUCTS('')} FROM d), {NORMAL}, p AS (SELECT unnest(['s_x_urgent', 's']) coefficient, unnest([m3_6, m2_6]) e FROM {SOLVED}),
 c AS (SELECT cluster, row_number() OVER (ORDER BY cluster) - 1 cluster_no FROM (SELECT DISTINCT cluster FROM d)), nn AS (SELECT count(*) n FROM c),
 dr AS (SELECT rep, cast(('0x' || substr(sha256('42|c|' || rep || '|' || i), 1, 12)) AS bigint) % n cluster_no FROM nn, range(200) a(rep), LATERAL (SELECT unnest(range(n)) i)),
 w AS (SELECT rep, cluster, count(*) w FROM dr JOIN c USING (cluster_no) GROUP BY 1, 2), q AS (SELECT rep, {PRODUCTS('w * ')} FROM w JOIN d USING (cluster) GROUP BY 1), {NORMAL_R},
 x AS (SELECT unnest(['s_x_urgent', 's']) coefficient, unnest([m3_6, m2_6]) x FROM {SOLVED_R})
 SELECT coefficient, round(any_value(e), 6) estimate, round(quantile_cont(x, 0.025), 6) lower, round(quantile_cont(x, 0.975), 6) upper, count(*) kept FROM x JOIN p USING (coefficient) GROUP BY 1""")
def i7_regression_bootstrap(spark, d):
    from tessera.operators import regression

    rows, terms = _design(spark, d)
    return R(regression.bootstrap(rows, terms, F.col("o_totalprice") / 1000, "cluster", ["s_x_urgent", "s"], 200), "estimate", "lower", "upper")


def _design(spark, d):
    from tessera.operators import regression

    rows = V._t(spark, d, "orders").select("o_totalprice", "o_orderstatus", (F.col("o_custkey") % 50).alias("cluster"),
        F.col("o_orderpriority").startswith("1").cast("double").alias("urgent"), ((F.col("o_orderkey") % 97) / 97.0).alias("s"))
    terms = {"intercept": F.lit(1.0), "urgent": F.col("urgent"), "s": F.col("s"), "s_x_urgent": F.col("s") * F.col("urgent"),
        **regression.drop_first(["F", "O", "P"], "o_orderstatus")}
    return rows, terms
