"""Queries: tokens, similarity, neighbours, action parsing, prompts, histories."""

from __future__ import annotations

from pyspark.sql import functions as F

from tessera.functions import arrays, canon, text as X
from tessera.operators import history, panel
from tessera.plans import views as V
from tessera.plans.registry import query

R = lambda df, *cols: df.withColumns({c: F.round(c, 6) for c in cols})


@query(r"SELECT doc_id, cast(len(regexp_extract_all(text, '[A-Za-z0-9]+')) AS bigint) n_tokens, cast(len(list_distinct(list_transform(regexp_extract_all(text, '[A-Za-z0-9]+'), lambda t: lower(t)))) AS bigint) n_distinct FROM documents")
def t16_ascii_tokens(spark, d):
    t = X.tokens(F.col("text"))
    return V._t(spark, d, "documents").select("doc_id", F.size(t).cast("long").alias("n_tokens"), F.size(F.array_distinct(t)).cast("long").alias("n_distinct"))


STOP = "('the', 'a', 'an', 'you', 'are', 'is', 'in', 'of', 'to', 'and', 'on', 'with', 'at', 'from')"
BOW = lambda table, key, where="true": f"(SELECT {key} k, lower(unnest(regexp_extract_all(text, '[A-Za-z0-9]+'))) token FROM {table} WHERE {where})"


@query(f"SELECT k AS item_id, token, count(*) n FROM {BOW('benchmark', 'item_id')} WHERE token NOT IN {STOP} GROUP BY 1, 2")
def p19_bag_of_words(spark, d):
    return X.token_counts(V._t(spark, d, "benchmark"), "item_id", "text", X.STOP_WORDS).select("item_id", "token", "n")


@query(f"""WITH n AS (SELECT k, token, count(*) n FROM {BOW('benchmark', 'item_id')} GROUP BY 1, 2), z AS (SELECT k, sqrt(sum(n * n)) z FROM n GROUP BY 1), x AS (SELECT a.k s, b.k t, sum(a.n * b.n) dot FROM n a JOIN n b ON a.token = b.token AND a.k < b.k GROUP BY 1, 2)
 SELECT s, t, round(dot / (a.z * b.z), 6) cosine FROM x JOIN z a ON a.k = s JOIN z b ON b.k = t""")
def p20_cosine(spark, d):
    """Every pair of items with a common token, once."""
    b = V._t(spark, d, "benchmark")
    s, t = (X.token_counts(b.withColumnRenamed("item_id", k), k, "text") for k in "st")
    return R(X.cosine_by_index(s, t, "s", "t", once=True), "cosine")


@query(f"""WITH c AS (SELECT conv_id k, turn, list_sort(list_distinct(list_transform(regexp_extract_all(text, '[A-Za-z0-9]+'), lambda t: lower(t)))) a FROM conversations), p AS (SELECT x.k conv_id, x.turn, x.a, y.a b FROM c x JOIN c y ON x.k = y.k AND y.turn = x.turn + 1)
 SELECT conv_id, turn, CASE WHEN len(list_distinct(list_concat(a, b))) = 0 THEN NULL ELSE round(len(list_intersect(a, b)) / len(list_distinct(list_concat(a, b))), 6) END jaccard FROM p""")
def p21_set_jaccard(spark, d):
    c = V._t(spark, d, "conversations").select("conv_id", "turn", F.array_distinct(X.tokens(F.col("text"))).alias("a"))
    nxt = c.select("conv_id", (F.col("turn") - 1).alias("turn"), F.col("a").alias("b"))
    return R(c.join(nxt, ["conv_id", "turn"]).select("conv_id", "turn", X.jaccard(F.col("a"), F.col("b")).alias("jaccard")), "jaccard")


def _panel(spark, d):
    docs = V._t(spark, d, "documents").select(F.col("doc_id").alias("unit_id"), F.col("source").alias("cluster_id"), F.col("lang").alias("stratum"), "text", F.array("lang", F.concat(F.lit("b"), (F.col("doc_id") % 3).cast("string")), F.concat(F.lit("s"), (F.col("n_chars") % 4).cast("string"))).alias("actions"), F.concat(F.lit("b"), (F.col("doc_id") % 3).cast("string")).alias("action"))
    return docs.where("unit_id % 100 = 0"), docs


NB = f"""docs AS (SELECT doc_id, source, lang, text, ['b' || (doc_id % 3), lang, 's' || (n_chars % 4)] acts, 'b' || (doc_id % 3) act FROM documents),
 s AS (SELECT k, token, count(*) n FROM {BOW('docs', 'doc_id', 'doc_id % 100 = 0')} WHERE token NOT IN {STOP} GROUP BY 1, 2), t AS (SELECT k, token, count(*) n FROM {BOW('docs', 'doc_id')} WHERE token NOT IN {STOP} GROUP BY 1, 2),
 ns AS (SELECT k, sqrt(sum(n * n)) z FROM s GROUP BY 1), nt AS (SELECT k, sqrt(sum(n * n)) z FROM t GROUP BY 1), x AS (SELECT s.k s, t.k t, sum(s.n * t.n) dot FROM s JOIN t USING (token) GROUP BY 1, 2),
 met AS (SELECT a.doc_id s, b.doc_id t, list_filter(a.acts, lambda v: v <> a.act) p, list_filter(b.acts, lambda v: v <> a.act) q FROM docs a JOIN docs b ON a.lang = b.lang AND a.source <> b.source AND list_contains(b.acts, a.act) WHERE a.doc_id % 100 = 0),
 sim AS (SELECT s, t, 0.5 * coalesce(dot / (ns.z * nt.z), 0) + 0.5 * coalesce(len(list_intersect(p, q)) / nullif(len(list_distinct(list_concat(p, q))), 0), 0) sim FROM met LEFT JOIN x USING (s, t) LEFT JOIN ns ON ns.k = s LEFT JOIN nt ON nt.k = t),
 r AS (SELECT *, row_number() OVER (PARTITION BY s ORDER BY round(sim, 12) DESC, t) rn, count(*) OVER (PARTITION BY s) eligible FROM sim WHERE sim >= 0.05)"""


@query(f"WITH {NB} SELECT s source_id, t target_id, round(sim, 6) similarity, cast(rn AS int) rn, eligible FROM r WHERE rn <= 10 AND eligible >= 5")
def j6_cross_cluster_neighbours(spark, d):
    """Sources are a stated set of documents; each is compared with every document, and `eligible` counts all that count."""
    sources, targets = _panel(spark, d)
    found, _ = panel.neighbours(sources, targets, 10, 5, 0.05, 0.5, X.STOP_WORDS, whole_count=True)
    return R(found.select("source_id", "target_id", "similarity", "rn", "eligible"), "similarity")


@query(f"WITH {NB}, c AS (SELECT d.doc_id source_id, coalesce(max(eligible), 0) eligible FROM docs d LEFT JOIN r ON r.s = d.doc_id WHERE d.doc_id % 100 = 0 GROUP BY 1) SELECT * FROM c WHERE eligible < 5")
def l4_neighbour_attrition(spark, d):
    sources, targets = _panel(spark, d)
    return panel.neighbours(sources, targets, 10, 5, 0.05, 0.5, X.STOP_WORDS)[1]


@query("""WITH m AS (SELECT o_custkey source_id, min(o_orderkey) self_id, list(o_orderkey ORDER BY o_orderkey) ids FROM orders GROUP BY 1 HAVING count(*) >= 3), o AS (SELECT o_custkey source_id, o_orderkey score_id, (o_orderkey % 13) / 10.0 - (o_orderkey % 7) / 10.0 ch FROM orders)
 SELECT m.source_id, round(max(ch) FILTER (score_id = self_id), 6) + 0.0 S, round(avg(ch) FILTER (score_id <> self_id), 6) + 0.0 T, count(*) FILTER (score_id <> self_id) neighbours FROM m JOIN o USING (source_id) GROUP BY 1""")
def a19_panel_assembly(spark, d):
    o = V._t(spark, d, "orders").select("o_custkey", "o_orderkey")
    meta = o.groupBy(F.col("o_custkey").alias("source_id")).agg(F.min("o_orderkey").alias("self_score_id"), F.collect_list("o_orderkey").alias("ids")).where(F.size("ids") >= 3)
    meta = meta.select("source_id", "self_score_id", F.array_except("ids", F.array("self_score_id")).alias("neighbour_score_ids"))
    base = o.select(F.col("o_orderkey").alias("score_id"), ((F.col("o_orderkey") % 7) / 10.0).alias("score"))
    updated = o.select(F.col("o_orderkey").alias("score_id"), ((F.col("o_orderkey") % 13) / 10.0).alias("score"))
    return R(panel.assemble(meta, base, updated)[0], "S", "T").withColumns({"S": F.col("S") + 0.0, "T": F.col("T") + 0.0})


#: Responses in every way that parsing tells apart, by the row's number.
SPOKEN = "CASE o_orderkey % 9 WHEN 0 THEN '' WHEN 1 THEN 'take apple ' || o_custkey WHEN 2 THEN 'Action: look' || chr(10) || 'Action: go' WHEN 3 THEN 'Action:  ' WHEN 4 THEN 'so ' || chr(10) || 'ACTION : Put apple 1 in fridge ' || (o_custkey % 3) || '.' WHEN 5 THEN 'Action: heat apple 1 using microwave 1' WHEN 6 THEN 'Action: take apple' WHEN 7 THEN 'Action: \"Look;\"' ELSE 'Action: fly' END"
ALLOWED = ["take apple 1", "take apple 2", "move apple 1 to fridge 1", "heat apple 1 with microwave 1", "look", "Look ", "go north"]
NORM = lambda c: f"""lower(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace({c}, '^[`"'' \\t\\r\\n]+|[`"'' \\t\\r\\n]+$', '', 'g'), '\\s+', ' ', 'g'), '[.;]+$', ''), '^put\\s+(.+?)\\s+(?:in|on|into|onto)\\s+(.+)$', 'move \\1 to \\2', 'i'), '^(clean|heat|cool)\\s+(.+?)\\s+using\\s+(.+)$', '\\1 \\2 with \\3', 'i'))"""
PARSED = f"""r AS (SELECT o_orderkey, {SPOKEN} t FROM orders), m AS (SELECT o_orderkey, trim(t) t, len(regexp_extract_all(trim(t), '(?im)^\\s*Action\\s*:\\s*')) k, trim(regexp_extract(trim(t), '(?im)^\\s*Action\\s*:\\s*([^\\r\\n]*)', 1)) cand FROM r),
 n AS (SELECT *, {NORM('cand')} norm FROM m), h AS (SELECT *, list_filter({ALLOWED!r}, lambda a: lower(trim(a)) = norm) hits FROM n)"""


@query(f"""WITH {PARSED} SELECT o_orderkey, CASE WHEN k = 1 THEN norm ELSE '' END normalized, CASE WHEN k = 1 AND norm <> '' AND len(hits) = 1 THEN trim(hits[1]) END action, coalesce(k = 1 AND norm <> '' AND len(hits) = 1, false) valid,
 CASE WHEN t = '' THEN 'empty_content' WHEN k = 0 THEN 'missing_action_marker' WHEN k > 1 THEN 'multiple_action_markers' WHEN norm = '' THEN 'empty_action' WHEN len(hits) = 1 THEN NULL WHEN len(hits) > 1 THEN 'ambiguous_normalized_action' ELSE 'not_admissible' END failure FROM h""")
def p14_parse_action(spark, d):
    spoken = F.expr(SPOKEN.replace("chr(10)", "char(10)").replace('\\"', '"'))
    parsed = V._t(spark, d, "orders").select("o_orderkey", X.parse_action(spoken, F.array(*map(F.lit, ALLOWED))).alias("p"))
    return parsed.select("o_orderkey", "p.normalized", "p.action", "p.valid", "p.failure")


@query(f"""WITH {PARSED} SELECT failure, count(*) n FROM (SELECT CASE WHEN t = '' THEN 'empty_content' WHEN k = 0 THEN 'missing_action_marker' WHEN k > 1 THEN 'multiple_action_markers' WHEN norm = '' THEN 'empty_action' WHEN len(hits) = 1 THEN 'ok' WHEN len(hits) > 1 THEN 'ambiguous_normalized_action' ELSE 'not_admissible' END failure FROM h) GROUP BY 1""")
def e8_sampled_action_fallback(spark, d):
    """Parsed actions, with the default action where the response is invalid, counted by outcome."""
    spoken = F.expr(SPOKEN.replace("chr(10)", "char(10)").replace('\\"', '"'))
    allowed = F.array(*map(F.lit, ALLOWED))
    parsed = V._t(spark, d, "orders").select(X.parse_action(spoken, allowed).alias("p")).select(F.coalesce("p.failure", F.lit("ok")).alias("failure"), F.coalesce("p.action", F.lit("look")).alias("executed"))
    return parsed.where(F.array_contains(allowed, F.col("executed"))).groupBy("failure").agg(F.count("*").alias("n"))


@query(f"WITH r AS (SELECT o_orderkey, {SPOKEN} t, CASE WHEN o_orderkey % 2 = 0 THEN 'look' END done FROM orders) SELECT o_orderkey, coalesce(done, nullif(trim(regexp_extract(t, '(?im)^\\s*Action\\s*:\\s*([^\\r\\n]*)', 1)), '')) action FROM r")
def e7_first_action_line(spark, d):
    spoken = F.expr(SPOKEN.replace("chr(10)", "char(10)").replace('\\"', '"'))
    found = F.nullif(F.trim(F.regexp_extract(spoken, rf"{X.ACTION_MARKER}([^\r\n]*)", 1)), F.lit(""))
    return V._t(spark, d, "orders").select("o_orderkey", F.coalesce(F.when(F.col("o_orderkey") % 2 == 0, "look"), found).alias("action"))


@query(f"SELECT p_partkey, {NORM('p_name')} normalized FROM part")
def p13_normalise_action(spark, d):
    return V._t(spark, d, "part").select("p_partkey", X.normalise_action(F.col("p_name")).alias("normalized"))


@query("WITH r AS (SELECT doc_id, 'Intro.' || chr(10) || CASE WHEN doc_id % 2 = 0 THEN 'Your task is to: find item ' || doc_id || chr(10) || 'x' ELSE chr(10) || 'last ' || doc_id END t FROM documents) SELECT doc_id, CASE WHEN t LIKE '%Your task is to%' THEN 'find item ' || doc_id ELSE 'last ' || doc_id END task FROM r")
def p15_task_description(spark, d):
    i = F.col("doc_id").cast("string")
    t = F.concat(F.lit("Intro.\n"), F.when(F.col("doc_id") % 2 == 0, F.concat(F.lit("Your task is to: find item "), i, F.lit("\nx"))).otherwise(F.concat(F.lit("\nlast "), i)))
    return V._t(spark, d, "documents").select("doc_id", X.task_description(t).alias("task"))


@query("SELECT p_partkey, split_part(split_part('root/' || lower(replace(p_type, ' ', '-')) || '/trial/game.file', '/', -3), '-', 1) type FROM part")
def p16_type_from_path(spark, d):
    path = F.concat(F.lit("root/"), F.lower(F.replace("p_type", F.lit(" "), F.lit("-"))), F.lit("/trial/game.file"))
    return V._t(spark, d, "part").select("p_partkey", X.type_from_path(path).alias("type"))


ACTS = "list('go to ' || l_partkey ORDER BY l_linenumber, l_partkey, l_suppkey)"


def _acts(spark, d):
    lines = V._t(spark, d, "lineitem").groupBy("l_orderkey").agg(F.array_sort(F.collect_list(F.struct("l_linenumber", "l_partkey", "l_suppkey", F.concat(F.lit("go to "), F.col("l_partkey").cast("string")).alias("a")))).alias("x"))
    return lines.select("l_orderkey", F.transform("x", lambda s: s["a"]).alias("acts"))


@query(f"SELECT l_orderkey, array_to_string(list_transform({ACTS}, lambda a: '- ' || a), chr(10)) block FROM lineitem GROUP BY 1")
def p9_admissible_block(spark, d):
    return _acts(spark, d).select("l_orderkey", X.admissible_block(F.col("acts")).alias("block"))


@query(f"SELECT l_orderkey, array_to_string({ACTS}[1:3], '; ') || CASE WHEN count(*) > 3 THEN ' (+' || (count(*) - 3) || ' more)' ELSE '' END listed FROM lineitem GROUP BY 1")
def p10_capped_list(spark, d):
    return _acts(spark, d).select("l_orderkey", X.capped_list(F.col("acts"), 3).alias("listed"))


@query(f"WITH {V.UNIT} SELECT cluster_id, seq, cast(len(list(observation) OVER w) AS int) n_messages, sha256(array_to_string(list(role || ':' || observation) OVER w, chr(10))) digest FROM v_unit WINDOW w AS (PARTITION BY cluster_id ORDER BY seq ROWS UNBOUNDED PRECEDING)")
def w5_cumulative_history(spark, d):
    return _told(spark, d).select("cluster_id", "seq", "n_messages", "digest")


def _told(spark, d):
    line = F.concat("role", F.lit(":"), "observation")
    return history.told(V.unit(spark, d).select("cluster_id", "seq", "role", "observation"), "cluster_id", "seq", line, [])


@query(f"""WITH RECURSIVE {V.UNIT}, r AS (SELECT cluster_id, seq, role || ':' || observation line, row_number() OVER (PARTITION BY cluster_id ORDER BY seq) a FROM v_unit),
 c AS (SELECT cluster_id, seq, a, sha256(chr(10) || line) chain FROM r WHERE a = 1 UNION ALL SELECT r.cluster_id, r.seq, r.a, sha256(c.chain || chr(10) || r.line) FROM c JOIN r ON r.cluster_id = c.cluster_id AND r.a = c.a + 1)
 SELECT cluster_id, seq, chain FROM c""")
def w5_prefix_chain(spark, d):
    """The identity of each history, by a chain that takes every message once."""
    return _told(spark, d).select("cluster_id", "seq", "chain")


@query(f"""WITH {V.UNIT}, r AS (SELECT *, length(observation) len, row_number() OVER (PARTITION BY cluster_id ORDER BY seq) a, row_number() OVER (PARTITION BY cluster_id ORDER BY seq DESC) b FROM v_unit),
 c AS (SELECT *, sum(CASE WHEN a = 1 THEN len ELSE 0 END) OVER (PARTITION BY cluster_id) anchor, sum(CASE WHEN a = 1 THEN 0 ELSE len END) OVER (PARTITION BY cluster_id ORDER BY seq DESC) newest, sum(CASE WHEN b = 1 AND a <> 1 THEN len ELSE 0 END) OVER (PARTITION BY cluster_id) last FROM r)
 SELECT cluster_id, seq, a = 1 OR b = 1 OR anchor + newest <= 700 kept, anchor + last > 700 overflow FROM c""")
def p34_truncation(spark, d):
    t = history.truncated(V.unit(spark, d).select("cluster_id", "seq", "observation"), "cluster_id", "seq", F.length("observation"), 700)
    return t.select("cluster_id", "seq", "kept", "overflow")


@query(f"""WITH {V.UNIT}, c AS (SELECT cluster_id, list(role ORDER BY seq) r FROM v_unit GROUP BY 1) SELECT cluster_id, len(r) >= 2 AND len(r) % 2 = 0 AND len(list_filter(range(1, len(r) + 1), lambda i: r[i] <> CASE WHEN i = 1 THEN 'system' WHEN i % 2 = 0 THEN 'user' ELSE 'assistant' END)) = 0 ok FROM c""")
def p35_role_check(spark, d):
    c = V.unit(spark, d).groupBy("cluster_id").agg(F.array_sort(F.collect_list(F.struct("seq", "role"))).alias("x"))
    return c.select("cluster_id", arrays.roles_alternate(F.transform("x", lambda s: s["role"])).alias("ok"))


@query(f"""WITH {V.UNIT}, c AS (SELECT cluster_id, list('Action: ' || role || seq ORDER BY seq) m FROM v_unit GROUP BY 1) SELECT cluster_id, array_to_string(list_transform(list_filter(range(3, len(m) + 1), lambda i: i % 2 = 1), lambda i: substr(m[i], 9)), ',') actions FROM c""")
def p36_prefix_actions(spark, d):
    c = V.unit(spark, d).groupBy("cluster_id").agg(F.array_sort(F.collect_list(F.struct("seq", F.concat(F.lit("Action: "), F.col("role"), F.col("seq").cast("string")).alias("m")))).alias("x"))
    return c.select("cluster_id", F.array_join(arrays.prefix_actions(F.transform("x", lambda s: s["m"])), ",").alias("actions"))


@query(f"WITH {V.UNIT}, c AS (SELECT cluster_id, list(struct_pack(\"role\" := role, content := observation) ORDER BY seq) m FROM v_unit GROUP BY 1) SELECT cluster_id, cast(len(m) + 1 AS int) n, CASE WHEN m[1].role = 'system' THEN 'Be brief.' END first_content, CASE WHEN m[1].role = 'system' THEN 'Action: look' END last_content FROM c")
def p7_replace_system_and_append(spark, d):
    c = V.unit(spark, d).groupBy("cluster_id").agg(F.array_sort(F.collect_list(F.struct("seq", "role", F.col("observation").alias("content")))).alias("x"))
    m = F.transform("x", lambda s: F.struct(s["role"].alias("role"), s["content"].alias("content")))
    made = c.select("cluster_id", F.size("x").alias("n0"), arrays.append_action(arrays.replace_system(m, F.lit("Be brief.")), F.lit("look")).alias("m"))
    return made.select("cluster_id", (F.col("n0") + 1).alias("n"), F.get("m", F.lit(0))["content"].alias("first_content"), F.element_at("m", -1)["content"].alias("last_content"))


@query("SELECT p_partkey, sha256('{\"brand\":\"' || p_brand || '\",\"name\":\"' || p_name || '\",\"size\":' || p_size || '}') record_hash FROM part")
def p1_record_hash(spark, d):
    return V._t(spark, d, "part").select("p_partkey", canon.record_hash(brand=F.col("p_brand"), name=F.col("p_name"), size=F.col("p_size")).alias("record_hash"))


@query("SELECT doc_id, sha256(text) text_sha256 FROM documents")
def p2_text_sha256(spark, d):
    return V._t(spark, d, "documents").select("doc_id", canon.text_sha256(F.col("text")).alias("text_sha256"))


@query("SELECT l_orderkey, l_linenumber, 'line:' || l_orderkey || ':' || CASE WHEN l_linenumber = 1 THEN '' ELSE l_linenumber::varchar END record_id FROM lineitem")
def p25_record_id(spark, d):
    return V._t(spark, d, "lineitem").select("l_orderkey", "l_linenumber", canon.record_id(F.lit("line"), F.col("l_orderkey"), F.when(F.col("l_linenumber") != 1, F.col("l_linenumber"))).alias("record_id"))


@query("""SELECT p_partkey, CASE p_partkey % 3 WHEN 0 THEN 'empty' WHEN 1 THEN 'action_line' ELSE 'whole_response' END class FROM part""")
def p41_supervision_class(spark, d):
    t = F.when(F.col("p_partkey") % 3 == 0, " ").when(F.col("p_partkey") % 3 == 1, F.concat(F.lit("Action: "), F.col("p_name"))).otherwise(F.concat(F.lit("I think\nAction: "), F.col("p_name")))
    return V._t(spark, d, "part").select("p_partkey", arrays.supervision_class(t).alias("class"))
