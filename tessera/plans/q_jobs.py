"""Queries: whole jobs over the driver's tables, and the projections that they use."""

from __future__ import annotations

from pyspark.sql import functions as F

from tessera.functions import prompts as P
from tessera.operators import bootstrap, estimators as E, sampling
from tessera.operators.single import with_values
from tessera.plans import jobs, views as V
from tessera.plans.q_estimators import CP, FLOORQ, JS, R
from tessera.plans.q_sampling import PRIORITY, RANKED
from tessera.plans.q_weights import ROWS
from tessera.plans.registry import query
from tessera.sources.shared import durable


@query(f"{RANKED} SELECT unit_id, cluster_id, seq, 'uniform_nested' \"policy\", round(least(3, n) / n, 6) incl_prob, cast(NULL AS double) score "
    f"FROM r WHERE rn <= 3")
def q4_select_units(spark, d):
    return R(jobs.select_units(V.unit(spark, d), 3)["selection"], "incl_prob")


@query(f"""{ROWS}, g AS (SELECT DISTINCT cluster_id FROM tv),
 s AS (SELECT cluster_id, row_number() OVER (ORDER BY sha256('42|' || cluster_id), cluster_id) <= least(count(*) OVER () - 1, greatest(1, round_even(count(*) OVER () * 0.1, 0))) is_validation FROM g)
 SELECT is_validation, count(*) n_rows, count(DISTINCT cluster_id) clusters, count(DISTINCT unit_id) units, round(sum(w), 4) weight FROM tv
 JOIN s USING (cluster_id) GROUP BY 1""")
def q7_build_training(spark, d):
    made = jobs.build_training(V.draw(spark, d))
    # a unit is of one cluster: the job has refused others
    units = lambda df: df.groupBy("cluster_id", "unit_id").agg(F.count("*").alias("n"), F.sum("weight").alias("w"))
    clusters = lambda df: units(df).groupBy("cluster_id").agg(F.sum("n").alias("n"), F.count("unit_id").alias("units"), F.sum("w").alias("w"))
    one = lambda df, v: clusters(df).agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n_rows"), F.count("cluster_id").alias("clusters"),
        F.coalesce(F.sum("units"), F.lit(0)).alias("units"), F.round(F.sum("w"), 4).alias("weight")).select(F.lit(v).alias("is_validation"), "*")
    return one(made["train"], False).unionByName(one(made["validation"], True))


@query(f"""WITH {V.UNIT}, {"sel AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY cluster_id ORDER BY " + PRIORITY + ", unit_id) rn "
    "FROM v_unit) WHERE rn <= 2)"}, n AS (SELECT cluster_id, count(*) n FROM sel GROUP BY 1)
 SELECT unit_id, cluster_id, seq, round(1.0 / n, 6) weight, 'Be exact.' first_content, sha256(observation) last_sha FROM sel JOIN n USING (cluster_id)""")
def q9_build_prompts(spark, d):
    message = lambda role, content: F.struct(F.lit(role).alias("role"), content.alias("content"))
    pool = V.unit(spark, d).withColumn("messages", F.array(message("system", F.lit("Be brief.")), message("user", F.col("observation"))))
    made = jobs.build_prompts(pool, sampling.nested_selection(pool, 2), "Be brief.", "Be exact.")["prompts"]
    return made.select("unit_id", "cluster_id", "seq", F.round("weight", 6).alias("weight"),
        F.col("other_prompt")[0]["content"].alias("first_content"), F.sha2(F.element_at("prompt", -1)["content"], 256).alias("last_sha"))


@query(f"""WITH {V.OUTCOME} SELECT count(*) FILTER (treatment = 1 AND control = 1) "both", count(*) FILTER (treatment = 1 AND control = 0) only_a, count(*) FILTER (treatment = 0 AND control = 1) only_b, count(*) FILTER (treatment = 0 AND control = 0) neither, round(avg(treatment - control), 6) estimate
 FROM v_eval""")
def q12_paired_interval(spark, d):
    e = V.outcome(spark, d)
    arm = lambda c: e.select("replicate_id", "cluster_id", F.col(c).alias("value"))
    made = jobs.paired_interval(arm("treatment"), arm("control"), 100)
    return with_values(made["table"].select("both", "only_a", "only_b", "neither"), made["interval"].select(F.round("estimate", 6).alias("estimate")))


def _memberships(spark, d):
    rows = V.label(spark, d).where("quality is not null")
    judged = F.when(F.col("quality") == 1, "Skip").otherwise("Strong")
    return rows.select(F.when(F.col("stratum") == "en", "A").otherwise("B").alias("experiment"), "unit_id", "cluster_id",
        (F.col("n_chars") >= 200).alias("base_valid"), judged.alias("label"), F.lit(0.5).alias("incl_prob"))


JUDGED = f"x AS (SELECT CASE WHEN stratum = 'en' THEN 'A' ELSE 'B' END experiment, cluster_id, (n_chars < 200 OR quality = 0)::int strong FROM v_label WHERE quality IS NOT NULL)"


@query(f"""WITH {V.LABEL}, {JUDGED}, c AS (SELECT experiment, cluster_id, avg(strong) m, count(*) n FROM x GROUP BY 1, 2)
 SELECT experiment, round(avg(m), 6) estimate, count(*) clusters, cast(sum(n) AS bigint) observed, cast(0 AS bigint) missing FROM c GROUP BY 1""")
def q16_judged_shares(spark, d):
    return R(jobs.judged(_memberships(spark, d), V.label(spark, d).groupBy("cluster_id").agg(F.count("*").alias("n_units")), 50)["observed"], "estimate")


@query(f"""WITH {V.LABEL}, {JUDGED}, c AS (SELECT cluster_id, avg(strong) FILTER (experiment = 'B') - avg(strong) FILTER (experiment = 'A') z FROM x
 GROUP BY 1), t AS (SELECT *, row_number() OVER (ORDER BY cluster_id) - 1 cluster_no FROM c WHERE z IS NOT NULL), nn AS (SELECT count(*) n FROM t),
 dr AS (SELECT rep, cast(('0x' || substr(sha256('42|c|' || rep || '|' || i), 1, 12)) AS bigint) % n cluster_no
 FROM nn, range(200) a(rep), LATERAL (SELECT unnest(range(n)) i)), y AS (SELECT rep, avg(z) x FROM dr JOIN t USING (cluster_no) GROUP BY 1)
 SELECT round((SELECT avg(z) FROM t), 6) estimate, round({FLOORQ(0.025, 'count(*)')}, 6) lower, round({FLOORQ(0.975, 'count(*)')}, 6) upper FROM y""")
def q16_judged_contrast(spark, d):
    return R(jobs.judged(_memberships(spark, d), V.label(spark, d).groupBy("cluster_id").agg(F.count("*").alias("n_units")), 200)["contrast"],
        "estimate", "lower", "upper")


def _replays(spark, d):
    rows = V.draw(spark, d).select("unit_id", F.col("cluster_id"), "base_value", F.explode("draws").alias("x")).where("x.valid")
    differs = (F.col("x.action") != F.col("base_value")).cast("int")
    return rows.select("unit_id", "cluster_id", F.lit(1.0).alias("incl_prob"), differs.alias("disagreement"),
        (differs * (F.col("x.action") == "R").cast("int")).alias("consequence"))


REPLAY = f"{V.DRAW}, s AS (SELECT unit_id, any_value(cluster_id) cluster_id, avg((action <> base_value)::int) d, avg((action <> base_value AND action = 'R')::int) c FROM v_line WHERE valid GROUP BY 1), g AS (SELECT cluster_id, sum(c) / count(*) c, sum(d) / count(*) d FROM s GROUP BY 1)"


@query(f"WITH {REPLAY} SELECT round(sum(c) / sum(d), 6) estimate, count(*) clusters, cast(0 AS bigint) faults FROM g")
def q17_positions(spark, d):
    replays = durable(_replays(spark, d), "replays")
    population = replays.groupBy("cluster_id").agg(F.count_distinct("unit_id").alias("n_units"))
    return R(jobs.positions(replays, population, 20)["given_disagreement"], "estimate")


@query("""WITH r AS (SELECT o_custkey % 11 stratum, o_orderstatus = 'F' solved, coalesce(sum((o_orderstatus = 'F')::int) OVER w, 0) sb, count(*) OVER w tb
 FROM orders WINDOW w AS (PARTITION BY o_custkey % 11 ORDER BY o_orderkey ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING))
 SELECT cast(stratum AS int) stratum, count(*) tried, count(*) FILTER (solved) solved FROM r WHERE sb < 10 AND tb < 100 GROUP BY 1""")
def q25_collection_quota(spark, d):
    attempts = V._t(spark, d, "orders").select((F.col("o_custkey") % 11).cast("int").alias("stratum"), F.col("o_orderkey").alias("seq"),
        (F.col("o_orderstatus") == "F").alias("solved"))
    return jobs.collection_quota(attempts)["summary"]


@query(f"""WITH {V.UNIT}, l AS (SELECT *, lag(role) OVER (PARTITION BY cluster_id ORDER BY seq) p FROM v_unit),
 e AS (SELECT cluster_id, stratum, coalesce(max((role = p)::int), 0) r, count(*) n FROM l GROUP BY 1, 2 HAVING bool_or(valid)),
 b AS (SELECT stratum, arg_min(cluster_id, struct_pack(a := r, b := n, c := cluster_id)) cluster_id FROM e GROUP BY 1) SELECT unit_id, stratum
 FROM v_unit JOIN b USING (stratum, cluster_id)""")
def q28_demonstration(spark, d):
    turns = V.unit(spark, d).withColumns({"action": F.col("role"), "solved": F.col("valid")})
    return jobs.demonstration(turns)["picked"].select("unit_id", "stratum")


@query(f"""WITH {V.LABEL}, en AS (SELECT * FROM v_label WHERE unit_id // 20 % 2 = 0),
 od AS (SELECT * FROM v_label WHERE unit_id // 20 % 3 = 1), a AS {CP('en', 'stratum')}, b AS {CP('od', 'stratum')}, ca AS (SELECT cluster_id, row_number() OVER (ORDER BY cluster_id) - 1 cluster_no
 FROM (SELECT DISTINCT cluster_id FROM en)), cb AS (SELECT cluster_id, row_number() OVER (ORDER BY cluster_id) - 1 cluster_no
 FROM (SELECT DISTINCT cluster_id FROM od)),
 da AS (SELECT rep, cast(('0x' || substr(sha256('42|a|' || rep || '|' || i), 1, 12)) AS bigint) % 20 cluster_no
 FROM range(100) x(rep), range(20) y(i)),
 db AS (SELECT rep, cast(('0x' || substr(sha256('42|b|' || rep || '|' || i), 1, 12)) AS bigint) % 20 cluster_no FROM range(100) x(rep), range(20) y(i)),
 ma AS (SELECT rep, v, sum(p) / 20 a FROM da JOIN ca USING (cluster_no) JOIN a USING (cluster_id) GROUP BY 1, 2),
 mb AS (SELECT rep, v, sum(p) / 20 b FROM db JOIN cb USING (cluster_no) JOIN b USING (cluster_id) GROUP BY 1, 2),
 x AS (SELECT rep, {JS} x FROM (SELECT rep, v, coalesce(a, 0) a, coalesce(b, 0) b FROM ma FULL JOIN mb USING (rep, v)) GROUP BY 1),
 pa AS (SELECT v, sum(p) / 20 a FROM a GROUP BY 1), pb AS (SELECT v, sum(p) / 20 b FROM b GROUP BY 1)
 SELECT round((SELECT {JS} FROM (SELECT coalesce(a, 0) a, coalesce(b, 0) b FROM pa FULL
 JOIN pb USING (v))), 6) estimate, round({FLOORQ(0.025, 100)}, 6) lower, round({FLOORQ(0.975, 100)}, 6) upper FROM x""")
def i2_unpaired_js_bootstrap(spark, d):
    rows = V.label(spark, d)
    a, b = (E.cluster_pmf(rows.where(w), "stratum") for w in ("unit_id div 20 % 2 = 0", "unit_id div 20 % 3 = 1"))
    return R(bootstrap.unpaired_js(spark, a, b, "stratum", 100), "estimate", "lower", "upper")


@query("""SELECT p_partkey, CASE p_partkey % 4 WHEN 0 THEN p_name WHEN 1 THEN p_name WHEN 2 THEN NULL ELSE 'x' END action, p_partkey % 4 <> 2 AND p_partkey % 4 <> 3 valid
 FROM part""")
def p28_normalised_draw(spark, d):
    name = F.col("p_name")
    shapes = F.when(F.col("p_partkey") % 4 == 0,
        F.to_json(F.struct(name.alias("executed_action"), F.lit(True).alias("valid")))).when(F.col("p_partkey") % 4 == 1,
            name).when(F.col("p_partkey") % 4 == 2, " ").otherwise('{"teacher_action": " x ", "teacher_valid": false}')
    return V._t(spark, d, "part").select("p_partkey", P.normalised_draw(shapes).alias("n")).select("p_partkey", "n.action", "n.valid")


@query("""SELECT p_partkey, sha256('{"experiment":"e1","group":"' || p_brand || '","kind":"source","sample":' || p_size || ',"unit":"' || p_name || '"}') source_id
 FROM part""")
def p24_source_id(spark, d):
    return V._t(spark, d, "part").select("p_partkey", P.source_id(F.col("p_brand"), F.lit("e1"), F.col("p_name"), F.col("p_size")).alias("source_id"))


@query("""SELECT p_partkey, sha256('{"action":"look","actions":["look","' || p_type || '"],"observation":"' || p_name || '","task":"t"}') query_hash
 FROM part""")
def p31_judge_query_hash(spark, d):
    return V._t(spark, d, "part").select("p_partkey",
        P.query_hash(F.lit("t"), F.col("p_name"), F.array(F.lit("look"), F.col("p_type")), F.lit("look")).alias("query_hash"))


@query("SELECT p_partkey, 'look|' || p_type choices FROM part")
def s16_constrained_choices(spark, d):
    message = P.first_message(F.lit("t"), F.col("p_name"), F.array(F.lit("look"), F.col("p_type")))
    return V._t(spark, d, "part").select("p_partkey", F.array_join(P.choices(message), "|").alias("choices"))


@query("WITH a AS (SELECT n_name token, n_nationkey id FROM nation), "
    "b AS (SELECT n_name token, CASE WHEN n_nationkey = 4 THEN 99 ELSE n_nationkey END id FROM nation WHERE n_nationkey <> 6) "
        "SELECT token, id, 'only_first' side FROM (SELECT * FROM a EXCEPT ALL SELECT * FROM b) UNION ALL SELECT token, id, 'only_second' "
            "FROM (SELECT * FROM b EXCEPT ALL SELECT * FROM a)")
def p44_vocabulary_difference(spark, d):
    a = V._t(spark, d, "nation").select(F.col("n_name").alias("token"), F.col("n_nationkey").alias("id"))
    return P.vocabulary_difference(a, a.where("id <> 6").select("token", F.when(F.col("id") == 4, 99).otherwise(F.col("id")).alias("id")))


@query("SELECT split_part(p_type, ' ', 1) root, count(*) files, cast(sum(length(p_name)) AS bigint) bytes FROM part GROUP BY 1")
def a36_inventory(spark, d):
    return V._t(spark, d, "part").groupBy(F.split_part("p_type", F.lit(" "), F.lit(1)).alias("root")).agg(F.count("*").alias("files"),
        F.sum(F.length("p_name")).alias("bytes"))
