"""Queries: the audit of annotated records and the contracts between runs, arms and evaluations."""

from __future__ import annotations

from pyspark.sql import functions as F

from tessera.operators import audit as A, checks as C
from tessera.operators.single import with_values
from tessera.plans import views as V
from tessera.plans.registry import query

OWN, OTHER = "Be brief.", "Be exact."


def records(spark, d):
    """Parts as annotated records, with the faults that their columns happen to have."""
    p = V._t(spark, d, "part")
    k, size = F.col("p_partkey").cast("int"), F.col("p_size")
    task, other_action = F.concat(F.lit("find "), "p_type"), F.concat(F.lit("take "), "p_brand")
    seq = (k % 4).cast("int")
    actions = F.when(size == 50, F.array().cast("array<string>")).otherwise(F.array(F.lit("look"), F.col("p_type"), F.col("p_brand")))
    message = lambda role, content: F.struct(F.lit(role).alias("role"), content.alias("content"))
    block = F.concat_ws(" | ", F.col("p_name"), F.lit("look"), "p_type", "p_brand")
    first = F.when(seq == 0, F.concat_ws(" | ", task, block)).otherwise(F.lit("start"))
    said = F.when(size % 17 == 0, "look").otherwise("Action: look")
    turns = F.flatten(F.transform(F.sequence(F.lit(1), F.greatest(seq, F.lit(1))),
        lambda i: F.array(F.struct(F.lit("assistant").alias("role"), said.alias("content")),
            F.struct(F.lit("user").alias("role"),
                F.when(i < seq, F.concat(F.lit("step "), i.cast("string"))).when(size % 19 == 0,
                    F.concat(block, F.lit("!"))).otherwise(block).alias("content")))))
    source = F.when(size % 23 == 0, "else").when(size % 2 == 0, "student").otherwise("teacher")
    system = F.when(size % 2 == 0, OWN).otherwise(OTHER)
    full = F.concat(F.array(F.struct(F.lit("system").alias("role"), system.alias("content")), message("user", first)),
        F.when(seq == 0, F.array().cast("array<struct<role:string,content:string>>")).otherwise(turns))
    full = F.when(size % 29 == 0, F.slice(full, 1, 1)).otherwise(full)
    kept = F.least(seq, (size % 3).cast("int"))
    base = p.select(
        k.alias("cluster_id"), seq.alias("seq"), task.alias("task"), F.col("p_name").alias("observation"), actions.alias("actions"),
            full.alias("full_messages"), kept.alias("kept"), source.alias("source"),
        F.when(size % 5 == 0, other_action).otherwise(F.col("p_brand")).alias("own_action"), (F.col("p_retailprice") / 1500).alias("incl_prob"),
            size.cast("int").alias("size"), "p_type", other_action.alias("other_action"),
    )
    shown = F.concat(F.slice("full_messages", 1, 2),
        F.when(F.col("kept") > 0, F.slice("full_messages", F.greatest(F.size("full_messages") - 2 * F.col("kept") + 1, F.lit(1)),
            2 * F.greatest(F.col("kept"), F.lit(1)))).otherwise(F.slice("full_messages", 1, 0)))
    draw = lambda action, valid, calls: F.struct(action.alias("action"), valid.alias("valid"), calls.cast("long").alias("calls"))
    s = F.col("size")
    made = base.withColumn("messages", shown).withColumns({
        "draws": F.array(draw(F.lit("look"), F.lit(True), F.lit(1)), draw(F.col("other_action"), s % 7 == 0, F.when(s % 11 == 0, 2).otherwise(1)),
            draw(F.col("p_type"), F.lit(True), F.lit(1))),
        "calls": F.lit(3).cast("long"),
        "truncation": F.struct(F.when(s % 31 != 0, F.col("kept")).alias("kept_pairs"),
            (F.col("seq") - F.col("kept") + (s % 37 == 0).cast("int")).alias("dropped_pairs"), (s * 10).alias("token_count"), F.lit(512).alias("budget")),
        "full": s % 13 != 0,
    })
    other = F.concat(F.array(F.struct(F.lit("system").alias("role"), F.lit(OTHER).alias("content"))), F.slice("messages", 2, F.size("messages")))
    note = F.struct(
        (s % 41 != 0).alias("prompt_replaced"), (s % 43 != 0).alias("same_context"), (s % 47 != 0).alias("counts_invalid"),
            F.when(s == 49, 2).otherwise(3).alias("samples"),
        F.when(s == 48, "x").otherwise(A.messages_sha256(F.col("messages"))).alias("own_sha"),
            F.when(s == 46, "x").otherwise(A.messages_sha256(other)).alias("other_sha"),
        F.when(s == 45, "x").otherwise(A.messages_sha256(F.slice("messages", 2, F.size("messages")))).alias("rest_sha"),
            F.when(s == 44, F.sha2(F.lit(OWN), 256)).otherwise(F.sha2(F.lit(OTHER), 256)).alias("prompt_sha"),
    )
    return made.withColumn("attested", note)


def block(task, observation, actions):
    return F.concat_ws(" | ", observation, F.lit("look"), F.get(actions, F.lit(1)), F.get(actions, F.lit(2)))


def opening(task, observation, actions):
    return F.concat_ws(" | ", task, block(task, observation, actions))


def audited(spark, d):
    return A.audit(records(spark, d), OWN, OTHER, opening, block)


MESSAGES = "list_transform({0}, lambda zz: '{{\"content\":\"' || zz.content || '\",\"role\":\"' || zz.role || '\"}}')"
SHA = lambda m: f"sha256('[' || array_to_string({MESSAGES.format(m)}, ',') || ']')"
CURRENT = "CASE WHEN seq = 0 THEN concat_ws(' | ', task, observation, 'look', actions[2], actions[3]) ELSE concat_ws(' | ', observation, 'look', actions[2], actions[3]) END"
#: The records from the same columns, and every rule worked out again over them.
AUDIT = f"""b AS (SELECT p_partkey cluster_id, (p_partkey % 4)::INT seq, 'find ' || p_type task, p_name observation, p_size s, p_type, 'take ' || p_brand p_container, p_brand, p_retailprice / 1500 incl_prob,
  CASE WHEN p_size = 50 THEN []::VARCHAR[] ELSE ['look', p_type, p_brand] END actions, concat_ws(' | ', p_name, 'look', p_type, p_brand) bl, CASE WHEN p_size % 2 = 0 THEN '{OWN}' ELSE '{OTHER}' END sys FROM part),
 f AS (SELECT *, least(seq, s % 3)::INT kept, [{{'role': 'system', 'content': sys}}, {{'role': 'user', 'content': CASE WHEN seq = 0 THEN concat_ws(' | ', task, bl) ELSE 'start' END}}]
  || flatten(list_transform(range(1, seq + 1), lambda i: [{{'role': 'assistant', 'content': CASE WHEN s % 17 = 0 THEN 'look' ELSE 'Action: look' END}}, {{'role': 'user', 'content': CASE WHEN i < seq THEN 'step ' || i WHEN s % 19 = 0 THEN bl || '!' ELSE bl END}}])) ff FROM b),
 g AS (SELECT * EXCLUDE (ff), CASE WHEN s % 29 = 0 THEN ff[1:1] ELSE ff END fm FROM f),
 h AS (SELECT *, fm[1:2] || CASE WHEN kept > 0 THEN fm[greatest(len(fm) - 2 * kept + 1, 1):greatest(len(fm) - 2 * kept + 1, 1) + 2 * kept - 1] ELSE [] END m,
  CASE WHEN s % 5 = 0 THEN p_container ELSE p_brand END own, CASE WHEN s % 31 <> 0 THEN kept END kp, seq - kept + (s % 37 = 0)::INT dp, s * 10 tc, s % 13 <> 0 fu,
  [{{'a': 'look', 'v': true, 'c': 1}}, {{'a': p_container, 'v': s % 7 = 0, 'c': CASE WHEN s % 11 = 0 THEN 2 ELSE 1 END}}, {{'a': p_type, 'v': true, 'c': 1}}] dr FROM g),
 o AS (SELECT *, [{{'role': 'system', 'content': '{OTHER}'}}] || m[2:] ot, len(m) >= 2 AND m[1].role = 'system' AND m[len(m)].role = 'user' AND len(list_filter(range(2, len(m) + 1), lambda i: m[i].role <> CASE WHEN i % 2 = 0 THEN 'user' ELSE 'assistant' END)) = 0 ord,
  len(fm) = 2 + 2 * seq AND len(list_filter(range(1, len(fm) + 1), lambda i: fm[i].role <> CASE WHEN i = 1 THEN 'system' WHEN i % 2 = 0 THEN 'user' ELSE 'assistant' END)) = 0 tf, m[len(m)].content lc FROM h),
 c AS (SELECT *, CASE WHEN NOT ord THEN [{{'code': 'HISTORY_ROLE_ORDER', 'n': 1}}] ELSE [
  {{'code': 'EMPTY_ADMISSIBLE_SET', 'n': (len(actions) = 0)::INT}}, {{'code': 'OBSERVATION_NOT_IN_QUERY', 'n': (NOT contains(lc, observation))::INT}},
  {{'code': 'ADMISSIBLE_NOT_IN_QUERY', 'n': (len(list_filter(actions, lambda a: NOT contains(lc, a))) > 0)::INT}}, {{'code': 'STUDENT_ACTION_NOT_EXECUTABLE', 'n': (NOT list_contains(actions, own))::INT}},
  {{'code': 'VALID_TEACHER_ACTION_NOT_EXECUTABLE', 'n': len(list_filter(dr, lambda x: x.v AND NOT list_contains(actions, x.a)))::INT}}, {{'code': 'NONATOMIC_TEACHER_ATTEMPT', 'n': len(list_filter(dr, lambda x: x.c <> 1))::INT}},
  {{'code': 'BUDGET_CALL_MISMATCH', 'n': (list_sum(list_transform(dr, lambda x: x.c)) <> 3)::INT}}, {{'code': 'FULL_HISTORY_TURN_MISMATCH', 'n': (fu AND NOT tf)::INT}},
  {{'code': 'CURRENT_STATE_MESSAGE_MISMATCH', 'n': (fu AND tf AND fm[len(fm)].content IS DISTINCT FROM ({CURRENT}))::INT}},
  {{'code': 'FULL_HISTORY_ACTION_FORMAT', 'n': (fu AND tf AND len(list_filter(range(3, len(fm) + 1, 2), lambda i: NOT starts_with(fm[i].content, 'Action: '))) > 0)::INT}},
  {{'code': 'TRUNCATION_ATTESTATION_MISSING', 'n': (fu AND tf AND kp IS NULL)::INT}},
  {{'code': 'TRUNCATED_HISTORY_MISMATCH', 'n': (fu AND tf AND kp IS NOT NULL AND (kp + dp <> seq OR tc <= 0 OR m <> fm[1:2] || CASE WHEN kp > 0 THEN fm[len(fm) - 2 * kp + 1:] ELSE [] END))::INT}},
  {{'code': 'STATE_SOURCE_PROMPT_MISMATCH', 'n': (fu AND (s % 23 = 0 OR m[1].content <> CASE WHEN s % 2 = 0 THEN '{OWN}' ELSE '{OTHER}' END))::INT}},
  {{'code': 'TEACHER_PROMPT_NOT_ATTESTED', 'n': (fu AND s % 41 = 0)::INT}}, {{'code': 'CONTEXT_IDENTITY_NOT_ATTESTED', 'n': (fu AND s % 43 = 0)::INT}}, {{'code': 'BUDGET_POLICY_NOT_ATTESTED', 'n': (fu AND s % 47 = 0)::INT}},
  {{'code': 'TEACHER_SAMPLE_COUNT_MISMATCH', 'n': (fu AND len(dr) <> CASE WHEN s = 49 THEN 2 ELSE 3 END)::INT}},
  {{'code': 'STUDENT_QUERY_SHA256_MISMATCH', 'n': (fu AND {SHA("m")} <> CASE WHEN s = 48 THEN 'x' ELSE {SHA("m")} END)::INT}}, {{'code': 'TEACHER_QUERY_SHA256_MISMATCH', 'n': (fu AND {SHA("ot")} <> CASE WHEN s = 46 THEN 'x' ELSE {SHA("ot")} END)::INT}},
  {{'code': 'NON_SYSTEM_QUERY_SHA256_MISMATCH', 'n': (fu AND {SHA("ot[2:]")} <> CASE WHEN s = 45 THEN 'x' ELSE {SHA("m[2:]")} END)::INT}},
  {{'code': 'TEACHER_SYSTEM_PROMPT_SHA256_MISMATCH', 'n': (fu AND sha256('{OTHER}') <> sha256(CASE WHEN s = 44 THEN '{OWN}' ELSE '{OTHER}' END))::INT}},
  {{'code': 'INVALID_INCLUSION_PROBABILITY', 'n': (NOT (incl_prob > 0 AND incl_prob <= 1))::INT}}] END x FROM o),
 au AS (SELECT x.code, cluster_id || '/t' || seq "key", x.n::BIGINT n FROM (SELECT cluster_id, seq, unnest(x) x FROM c) WHERE x.n > 0)"""


@query(f"WITH {AUDIT} SELECT * FROM au")
def c1_record_audit(spark, d):
    return audited(spark, d)


@query(f"WITH {AUDIT} SELECT code, count(*) records, sum(n)::BIGINT issues FROM au GROUP BY 1")
def q29_audit_summary(spark, d):
    """The audit's report: records and issues of each code."""
    return audited(spark, d).groupBy("code").agg(F.count("*").alias("records"), F.sum("n").alias("issues"))


def arms(spark, d):
    """Suppliers as budget arms of their nation's experiment, configured by their columns."""
    k = F.col("s_suppkey").cast("int")
    games, each = F.lit(12), F.lit(1) + k % 3
    samples = (F.lit(6) / each).cast("int")
    config = F.struct(
        F.concat(F.lit("e"), k.cast("string")).alias("experiment"), games.alias("games"), each.alias("states_per_game"),
            (games * each + (k % 31 == 0).cast("int")).alias("units_m"), samples.alias("draws_n"),
        F.lit(72).alias("budget_b"), F.struct((F.lit(100) + (k % 17 == 0).cast("int")).alias("steps"),
            F.struct((k % 13 == 0).cast("int").alias("split"), F.lit(7).alias("order")).alias("seed")).alias("training"),
    )
    return V._t(spark, d, "supplier").select(F.col("s_nationkey").cast("int").alias("nation"), k.alias("arm"), F.to_json(config).alias("config"))


ARMS = """a AS (SELECT s_nationkey::INT nation, s_suppkey::INT arm, 1 + s_suppkey % 3 each, 12 * (1 + s_suppkey % 3) + (s_suppkey % 31 = 0)::INT m, 6 // (1 + s_suppkey % 3) n, 100 + (s_suppkey % 17 = 0)::INT steps, (s_suppkey % 13 = 0)::INT split
 FROM supplier)"""
LEAVES = """l AS (SELECT nation, arm, unnest(['experiment', 'games', 'states_per_game', 'units_m', 'draws_n', 'budget_b', 'training.steps', 'training.seed.split', 'training.seed.order']) path,
 unnest(['e' || arm, '12', each::VARCHAR, m::VARCHAR, n::VARCHAR, '72', steps::VARCHAR, split::VARCHAR, '7']) "value" FROM a)"""
TRADED = ("experiment", "states_per_game", "units_m", "draws_n")


@query(f"""WITH {ARMS}, x AS (SELECT nation, arm, unnest([CASE WHEN m <> 12 * each THEN 'units_m' END, CASE WHEN m * n <> 72 THEN 'budget_identity' END]) code
 FROM a), {LEAVES},
 y AS (SELECT nation, path FROM l WHERE path IN ('games', 'budget_b', 'training.steps', 'training.seed.split', 'training.seed.order') GROUP BY 1, 2
 HAVING count(DISTINCT "value") > 1),
 z AS (SELECT nation FROM a GROUP BY 1 HAVING count(*) < 2 OR count(DISTINCT m || '|' || n) < 2)
 SELECT nation, arm::VARCHAR arm, code FROM x WHERE code IS NOT NULL UNION ALL SELECT nation, NULL, 'differs: ' || path FROM y UNION ALL
 SELECT nation, NULL, 'no_trade_off' FROM z""")
def c6_arm_compatibility(spark, d):
    """Arms of one experiment: each fits its budget, there is a trade-off of breadth and depth, and nothing else differs."""
    a = arms(spark, d)
    at = lambda path: F.get_json_object("config", f"$.{path}").cast("int")
    m, n, both = at("units_m"), at("draws_n"), F.concat_ws("|", at("units_m"), at("draws_n"))
    own = C.row_checks(a, F.concat_ws("|", "nation", "arm"), {"units_m": m == at("games") * at("states_per_game"), "budget_identity": m * n == at("budget_b")})
    own = own.select(F.split_part("key", F.lit("|"), F.lit(1)).cast("int").alias("nation"), F.split_part("key", F.lit("|"), F.lit(2)).alias("arm"), "code")
    none = F.lit(None).cast("string").alias("arm")
    shared = A.not_shared(a, "nation", "config", TRADED).select("nation", none, F.concat(F.lit("differs: "), "path").alias("code"))
    flat = a.groupBy("nation").agg(F.count("*").alias("k"), F.count_distinct(both).alias("pairs")).where("k < 2 or pairs < 2").select("nation", none,
        F.lit("no_trade_off").alias("code"))
    return C.all_of(own, shared, flat)


@query(f"""WITH {ARMS}, {LEAVES}, w AS (SELECT path, "value" expected FROM l WHERE arm = (SELECT min(arm) FROM a))
 SELECT l.arm, path, expected, "value" actual FROM l JOIN w USING (path) WHERE "value" <> expected AND path NOT IN ('experiment', 'training.seed.split')""")
def c7_config_difference(spark, d):
    """Dotted paths at which each arm's configuration differs from the first arm's, but for two that may."""
    a = arms(spark, d).select("arm", "config")
    return A.differences(a, "arm", "config", a.orderBy("arm").limit(1), ("experiment", "training.seed.split"))


@query(f"""WITH {ARMS}, {LEAVES} SELECT nation, path, count(DISTINCT "value") n_values FROM l
 WHERE path NOT IN ('experiment', 'units_m', 'draws_n', 'states_per_game') GROUP BY 1, 2 HAVING count(DISTINCT "value") > 1""")
def c10_run_compatibility(spark, d):
    """What runs of one nation don't have alike outside the breadth and depth that they trade."""
    return A.not_shared(arms(spark, d), "nation", "config", TRADED)


@query(f"""WITH {ARMS}, {LEAVES}, p AS (SELECT nation, arm, string_agg(path || '=' || "value", ';' ORDER BY path) p FROM l
 WHERE path LIKE 'training.%' GROUP BY 1, 2) SELECT nation, count(DISTINCT p) n_contracts, count(*) runs FROM p GROUP BY 1""")
def c11_training_run_compatibility(spark, d):
    """How many different training contracts the runs of a nation have, all of whose training fields count."""
    leaves = A.flattened(arms(spark, d).select(F.concat_ws("|", "nation", "arm").alias("run"), "config"), "run",
        "config").where(F.col("path").startswith("training."))
    contract = leaves.groupBy("run").agg(F.array_join(F.sort_array(F.collect_list(F.concat_ws("=", "path", "value"))), ";").alias("contract"))
    return contract.groupBy(F.split_part("run", F.lit("|"),
        F.lit(1)).cast("int").alias("nation")).agg(F.count_distinct("contract").alias("n_contracts"), F.count("*").alias("runs"))


@query(f"""WITH {ARMS}, p AS (SELECT nation, min(arm) x, max(arm) y FROM a GROUP BY 1 HAVING count(*) > 1)
 SELECT p.nation, b.m > e.m AND b.n < e.n OR b.m < e.m AND b.n > e.n traded, b.m * b.n = e.m * e.n same_budget, b.steps = e.steps AND b.split = e.split same_training
 FROM p JOIN a b ON b.arm = p.x JOIN a e ON e.arm = p.y""")
def c17_annotation_pair(spark, d):
    """A nation's first and last arm as a pair: one is broader, the other deeper, the budget and the training are shared."""
    at = lambda side, path: F.get_json_object(f"{side}.config", f"$.{path}")
    row = F.struct("arm", "config")
    p = arms(spark, d).groupBy("nation").agg(F.min(row).alias("x"), F.max(row).alias("y"), F.count("*").alias("k")).where("k > 1")
    whole = lambda side, path: at(side, path).cast("int")
    m, n = (whole("x", "units_m"), whole("y", "units_m")), (whole("x", "draws_n"), whole("y", "draws_n"))
    return p.select("nation", ((m[0] > m[1]) & (n[0] < n[1]) | (m[0] < m[1]) & (n[0] > n[1])).alias("traded"),
        (m[0] * n[0] == m[1] * n[1]).alias("same_budget"), (at("x", "training") == at("y", "training")).alias("same_training"))


def evaluations(spark, d):
    """Orders as evaluations: a replicate's games in order with traces of their lines, and what the result says of itself."""
    o = V._t(spark, d, "orders").select((F.col("o_orderkey") % 7).cast("int").alias("replicate_id"), F.col("o_orderkey").alias("game"),
        (F.col("o_orderstatus") == "F").alias("won"))
    turns = V._t(spark, d, "lineitem").groupBy(F.col("l_orderkey").alias("game")).agg(F.count("*").alias("turns"),
        F.count_distinct("l_partkey").alias("states"))
    return o.join(turns, "game", "left").fillna(0, ["turns", "states"])


EVAL = """e AS (SELECT (o_orderkey % 7)::INT replicate_id, o_orderkey game, o_orderstatus = 'F' won, t.turns, t.states FROM orders LEFT
 JOIN (SELECT l_orderkey game, count(*) turns, count(DISTINCT l_partkey) states FROM lineitem GROUP BY 1) t ON t.game = o_orderkey)"""


@query(f"""WITH {EVAL}, r AS (SELECT replicate_id, count(*) games, avg(won::INT) rate, round(avg(won::INT), 3) reported, sum(turns)::BIGINT requests, sum(coalesce(turns, 0) = 0)::BIGINT without_turns, sum(coalesce(turns, 0) <> coalesce(states, 0))::BIGINT repeated
 FROM e GROUP BY 1)
 SELECT replicate_id, games, requests, without_turns, repeated, abs(rate - reported) <= 1e-12 rate_ok, abs(rate - reported) <= 1e-12 AND without_turns = 0 AND repeated = 0 consistent FROM r""")
def c15_evaluation_consistency(spark, d):
    """Each evaluation against its own traces: the reported rate (three digits) against the outcomes, games without turns,
    games whose states repeat, and the number of requests."""
    r = evaluations(spark, d).groupBy("replicate_id").agg(
        F.count("*").alias("games"), F.avg(F.col("won").cast("int")).alias("rate"), F.sum("turns").alias("requests"),
            F.count_if(F.col("turns") == 0).alias("without_turns"), F.count_if(F.col("turns") != F.col("states")).alias("repeated"),
    )
    ok = F.abs(F.col("rate") - F.round("rate", 3)) <= 1e-12
    return r.select("replicate_id", "games", "requests", "without_turns", "repeated", ok.alias("rate_ok"),
        (ok & (F.col("without_turns") == 0) & (F.col("repeated") == 0)).alias("consistent"))


@query(f"""WITH {EVAL}, g AS (SELECT replicate_id, count(*) games, sha256(string_agg((game // 7)::VARCHAR, ',' ORDER BY game // 7)) list FROM e
 GROUP BY 1), b AS (SELECT * FROM g WHERE replicate_id = 0) SELECT g.replicate_id, g.games, g.list = b.list same_games FROM g, b WHERE g.replicate_id > 0""")
def c16_aggregate_contract(spark, d):
    """Whether each evaluation has the first one's list of games, in order, by the digest of the list."""
    place = F.floor(F.col("game") / 7).cast("long")
    listed = evaluations(spark, d).groupBy("replicate_id").agg(F.count("*").alias("games"),
        F.sha2(F.array_join(F.transform(F.sort_array(F.collect_list(place)), lambda x: x.cast("string")), ","), 256).alias("list"))
    first = listed.where("replicate_id = 0").select(F.col("list").alias("first_list"))
    return with_values(listed.where("replicate_id > 0"), first).select("replicate_id", "games", (F.col("list") == F.col("first_list")).alias("same_games"))


@query("""WITH l AS (SELECT event_id id, user_id u, ts, sha256(props) h, event_type k FROM events),
 a AS (SELECT id, u, ts, h FROM l WHERE k = 'view'), b AS (SELECT u, min(ts) ts, min_by(h, (ts, id)) h FROM l WHERE k = 'purchase' GROUP BY 1),
 s AS (SELECT DISTINCT u FROM l WHERE k = 'click')
 SELECT id::VARCHAR "key", CASE WHEN b.u IS NULL THEN 'no_completion' WHEN b.ts < a.ts THEN 'completed_before_launch' WHEN s.u IS NULL THEN 'no_service' WHEN a.h = b.h THEN 'same_manifest' END code
 FROM a LEFT JOIN b USING (u) LEFT JOIN s USING (u) WHERE b.u IS NULL OR b.ts < a.ts OR s.u IS NULL OR a.h = b.h""")
def c18_attestations(spark, d):
    """Launches against completions and services of the same owner: present, in order, and each with a manifest of its own."""
    rows = V._t(spark, d, "events").select(F.col("event_id").alias("id"), F.col("user_id").alias("u"), "ts", F.sha2("props", 256).alias("h"),
        F.col("event_type").alias("k"))
    launch = rows.where("k = 'view'").select("id", "u", "ts", "h")
    done = rows.where("k = 'purchase'").groupBy("u").agg(F.min(F.struct("ts", "id", "h")).alias("c")).select("u", F.col("c.ts").alias("done_ts"),
        F.col("c.h").alias("done_h"))
    service = rows.where("k = 'click'").select("u").distinct().withColumn("served", F.lit(True))
    code = F.when(F.col("done_ts").isNull(), "no_completion").when(F.col("done_ts") < F.col("ts"),
        "completed_before_launch").when(F.col("served").isNull(), "no_service").when(F.col("h") == F.col("done_h"), "same_manifest")
    return launch.join(done, "u", "left").join(service, "u", "left").select(F.col("id").cast("string").alias("key"),
        code.alias("code")).where("code is not null")


@query("""WITH p AS (SELECT p_partkey k, CASE p_partkey % 3 WHEN 0 THEN 'enabled' WHEN 1 THEN 'provider_default' ELSE 'disabled' END mode, CASE WHEN p_size % 2 = 0 THEN (p_size / 20.0) END t, CASE WHEN p_size % 3 = 0 THEN 'low' WHEN p_size % 3 = 1 THEN 'some' END effort, 1 + p_size % 2 * 0 + p_size % 4 n FROM part)
 SELECT k, CASE WHEN mode = 'enabled' THEN t IS NULL AND coalesce(effort IN ('low', 'high', 'max'), false) WHEN mode = 'provider_default' THEN effort IS NULL AND coalesce(t BETWEEN 0 AND 2, false) ELSE effort IS NULL AND coalesce(t BETWEEN 0 AND 2, false) AND NOT (n > 1 AND t = 0) END legal FROM p""")
def c23_sampling_protocol(spark, d):
    size = F.col("p_size")
    mode = F.when(F.col("p_partkey") % 3 == 0, "enabled").when(F.col("p_partkey") % 3 == 1, "provider_default").otherwise("disabled")
    effort = F.when(size % 3 == 0, "low").when(size % 3 == 1, "some")
    return V._t(spark, d, "part").select(F.col("p_partkey").alias("k"),
        A.legal_sampling(mode, F.when(size % 2 == 0, size / 20.0), effort, 1 + size % 4).alias("legal"))


@query("""WITH t AS (SELECT l_suppkey k, l_linenumber model, l_returnflag prompt, l_linestatus url FROM lineitem),
 n AS (SELECT k, model || '|' || prompt || '|' || url c, count(*) n FROM t GROUP BY 1, 2)
 SELECT k, count(*) contracts, arg_max(c, (n, c)) main, (sum(n) - max(n))::BIGINT others FROM n GROUP BY 1""")
def c25_contract_extraction(spark, d):
    """The contract that most rows of a run carry, and the rows that carry another."""
    rows = V._t(spark, d, "lineitem").select(F.col("l_suppkey").alias("k"), F.concat_ws("|", "l_linenumber", "l_returnflag", "l_linestatus").alias("c"))
    n = rows.groupBy("k", "c").agg(F.count("*").alias("n"))
    return n.groupBy("k").agg(F.count("*").alias("contracts"), F.max(F.struct("n", "c")).alias("m"), F.sum("n").alias("all")).select("k", "contracts",
        F.col("m.c").alias("main"), (F.col("all") - F.col("m.n")).alias("others"))
