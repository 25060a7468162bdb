"""The audit of annotated records, and contracts between configurations, as tables of violations.

A record's rules are one projection: each is an expression that gives its code once for every part of the record that
breaks it, and nothing but the broken rows moves.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.functions.arrays import replace_system
from tessera.operators.single import with_values
from tessera.sources.shared import durable

# The codes of the audit.
ROLES = "HISTORY_ROLE_ORDER"
CODES = (
    "EMPTY_ADMISSIBLE_SET", "OBSERVATION_NOT_IN_QUERY", "ADMISSIBLE_NOT_IN_QUERY", "STUDENT_ACTION_NOT_EXECUTABLE", "VALID_TEACHER_ACTION_NOT_EXECUTABLE",
    "NONATOMIC_TEACHER_ATTEMPT", "BUDGET_CALL_MISMATCH", "FULL_HISTORY_TURN_MISMATCH", "CURRENT_STATE_MESSAGE_MISMATCH", "FULL_HISTORY_ACTION_FORMAT",
    "TRUNCATION_ATTESTATION_MISSING", "TRUNCATED_HISTORY_MISMATCH", "STATE_SOURCE_PROMPT_MISMATCH", "TEACHER_PROMPT_NOT_ATTESTED",
    "CONTEXT_IDENTITY_NOT_ATTESTED", "BUDGET_POLICY_NOT_ATTESTED", "TEACHER_SAMPLE_COUNT_MISMATCH", "STUDENT_QUERY_SHA256_MISMATCH",
    "TEACHER_QUERY_SHA256_MISMATCH", "NON_SYSTEM_QUERY_SHA256_MISMATCH", "TEACHER_SYSTEM_PROMPT_SHA256_MISMATCH", "INVALID_INCLUSION_PROBABILITY",
)
ACTION_MARK = "Action: "


def messages_sha256(messages: Column) -> Column:
    """Of the canonical JSON of messages: keys in order, no spaces."""
    return F.sha2(F.to_json(F.transform(messages, lambda m: F.struct(m["content"].alias("content"), m["role"].alias("role")))), 256)


def _alternating(n: Column) -> Column:
    """system, user, then assistant and user in turn: n roles, two at least."""
    turn = F.transform(F.sequence(F.lit(0), F.greatest(n, F.lit(2)) - 1), lambda i: F.when(i == 0, "system").when(i % 2 == 1, "user").otherwise("assistant"))
    return F.slice(turn, 1, F.greatest(n, F.lit(2)))


def _equal(a: Column, b: Column) -> Column:
    return F.coalesce(a == b, F.lit(False))


def audit(records: DataFrame, own_prompt: str, other_prompt: str, first_message, turn_message) -> DataFrame:
    """code, key, n of the rules that each record breaks, n times.

    records: cluster_id, seq, task, observation, actions, messages, full_messages (arrays of role, content), truncation
    (kept_pairs, dropped_pairs, token_count, budget), source, own_action, draws (action, valid, calls), calls, attested
    (prompt_replaced, same_context, counts_invalid, samples, own_sha, other_sha, rest_sha, prompt_sha), incl_prob, and `full`
    for records of the version that keeps its whole history. first_message, turn_message: (task, observation, actions) ->
    what the user says at the first turn, and at others. Records whose roles are out of order get no other code.
    """
    c = F.col
    roles = F.transform("messages", lambda m: m["role"])
    last = F.try_element_at("messages", F.lit(-1))["content"]
    ordered = (F.size("messages") > 0) & _equal(roles, _alternating(F.size("messages"))) & _equal(F.try_element_at(roles, F.lit(-1)), F.lit("user"))
    known = lambda a: F.coalesce(F.array_contains("actions", a), F.lit(False))
    other = replace_system(c("messages"), F.lit(other_prompt))
    full, full_roles = c("full_messages"), F.transform("full_messages", lambda m: m["role"])
    turns_fit = _equal(full_roles, _alternating(2 + 2 * c("seq")))
    current = F.when(c("seq") == 0, first_message(c("task"), c("observation"), c("actions"))).otherwise(turn_message(c("task"), c("observation"), c("actions")))
    spoken = F.filter(F.slice(full, 3, F.greatest(F.size(full), F.lit(3))), lambda m,
        i: (i % 2 == 0) & ~F.coalesce(m["content"].startswith(ACTION_MARK) & (m["role"] == "assistant"), F.lit(False)))
    t = c("truncation")
    attested = t["kept_pairs"].isNotNull() & t["dropped_pairs"].isNotNull() & t["token_count"].isNotNull() & t["budget"].isNotNull()
    tail = F.when(t["kept_pairs"] > 0, F.slice(full, F.greatest(F.size(full) - 2 * t["kept_pairs"] + 1, F.lit(1)),
        2 * F.greatest(t["kept_pairs"], F.lit(1)))).otherwise(F.slice(full, 1, 0))
    query = F.concat(F.slice(full, 1, 2), tail)
    fits = (t["kept_pairs"] >= 0) & (t["dropped_pairs"] >= 0) & (t["kept_pairs"] + t["dropped_pairs"] == c("seq")) & (t["token_count"] > 0) & (t["budget"] > 0)
    prompt = F.when(c("source") == "student", own_prompt).when(c("source") == "teacher", other_prompt)
    note, whole = c("attested"), c("full")
    says = lambda flag: F.coalesce(flag, F.lit(False))
    once = lambda broken: F.when(F.coalesce(broken, F.lit(True)), 1).otherwise(0)
    times = lambda test: F.size(F.filter("draws", test))
    counts = (
        once(F.size("actions") == 0),
        once(~F.contains(last, c("observation"))),
        once(F.exists("actions", lambda a: ~F.contains(last, a))),
        once(~known(c("own_action"))),
        times(lambda x: x["valid"] & ~known(x["action"])),
        times(lambda x: x["calls"] != 1),
        once(c("calls") != F.aggregate("draws", F.lit(0).cast("long"), lambda acc, x: acc + x["calls"])),
        once(whole & ~turns_fit),
        once(whole & turns_fit & ~(_equal(F.try_element_at(full, F.lit(-1))["role"],
            F.lit("user")) & _equal(F.try_element_at(full, F.lit(-1))["content"], current))),
        once(whole & turns_fit & (F.size(spoken) > 0)),
        once(whole & turns_fit & ~attested),
        once(whole & turns_fit & attested & ~(fits & _equal(c("messages"), query))),
        once(whole & ~_equal(F.get("messages", F.lit(0))["content"], prompt)),
        once(whole & ~says(note["prompt_replaced"])),
        once(whole & ~says(note["same_context"])),
        once(whole & ~says(note["counts_invalid"])),
        once(whole & ~_equal(note["samples"], F.size("draws"))),
        once(whole & ~_equal(note["own_sha"], messages_sha256(c("messages")))),
        once(whole & ~_equal(note["other_sha"], messages_sha256(other))),
        once(whole & ~_equal(note["rest_sha"], messages_sha256(F.slice(other, 2, F.greatest(F.size(other) - 1, F.lit(0)))))),
        once(whole & ~_equal(note["prompt_sha"], F.sha2(F.lit(other_prompt), 256))),
        once(c("incl_prob").isNotNull() & ~((c("incl_prob") > 0) & (c("incl_prob") <= 1))),
    )
    found = F.when(~ordered, F.array(F.struct(F.lit(ROLES).alias("code"),
        F.lit(1).alias("n")))).otherwise(F.array(*[F.struct(F.lit(code).alias("code"), n.alias("n")) for code, n in zip(CODES, counts)]))
    key = F.concat(c("cluster_id").cast("string"), F.lit("/t"), c("seq").cast("string"))
    return records.select(key.alias("key"), F.explode(F.filter(found, lambda x: x["n"] > 0)).alias("x")).select("x.code", "key",
        F.col("x.n").cast("long").alias("n"))


def flattened(configs: DataFrame, key: str, json: str) -> DataFrame:
    """key, path, value of each leaf of JSON objects of any depth, by dotted paths; lists and empty objects are leaves.

    Objects are opened level by level until none is left.
    """
    kind = "map<string,string>"
    level, out = configs.select(key, F.explode(F.from_json(json, kind)).alias("path", "value")), None
    while True:
        inside = F.from_json("value", kind)
        nested = F.coalesce(F.col("value").startswith("{") & (F.size(inside) > 0), F.lit(False))
        leaves = level.where(~nested)
        out = leaves if out is None else out.unionByName(leaves)
        below = level.where(nested).select(key, F.col("path").alias("above"), F.explode(inside).alias("name", "value"))
        level = durable(below.select(key, F.concat_ws(".", "above", "name").alias("path"), "value"), "paths")
        if level.isEmpty():
            return out


def allowed_path(path: Column, allowed: tuple[str, ...]) -> Column:
    """Whether a path is one of the allowed ones or lies below one."""
    out = F.lit(False)
    for name in allowed:
        out = out | (path == name) | path.startswith(f"{name}.")
    return out


def _as_map(configs: DataFrame, key: str, json: str, name: str) -> DataFrame:
    """A row for each configuration with its leaves as a map; a configuration is a bounded thing."""
    return flattened(configs, key, json).groupBy(key).agg(F.map_from_entries(F.collect_list(F.struct("path", "value"))).alias(name))


def differences(configs: DataFrame, key: str, json: str, baseline: DataFrame, allowed: tuple[str, ...] = ()) -> DataFrame:
    """key, path, expected, actual where a configuration differs from the baseline's one row, outside the allowed paths."""
    want = _as_map(baseline, key, json, "want").select("want")
    both = with_values(_as_map(configs, key, json, "have"), want)
    paths = F.array_union(F.map_keys("have"), F.map_keys("want"))
    told = both.select(key, F.explode(paths).alias("path"), "have", "want").select(key, "path",
        F.try_element_at("want", F.col("path")).alias("expected"), F.try_element_at("have", F.col("path")).alias("actual"))
    return told.where(~F.col("expected").eqNullSafe(F.col("actual")) & ~allowed_path(F.col("path"), allowed))


def not_shared(configs: DataFrame, group: str, json: str, allowed: tuple[str, ...] = ()) -> DataFrame:
    """group, path, n_values of what members of a group don't all have alike, outside the allowed paths."""
    leaves = flattened(configs, group, json).where(~allowed_path(F.col("path"), allowed))
    members = configs.groupBy(group).agg(F.count("*").alias("members"))
    counted = leaves.groupBy(group, "path").agg(F.count_distinct("value").alias("n_values"), F.count("*").alias("n")).join(members, group)
    return counted.where("n_values > 1 or n < members").select(group, "path",
        (F.col("n_values") + (F.col("n") < F.col("members")).cast("int")).alias("n_values"))


def legal_sampling(mode: Column, temperature: Column, effort: Column, draws: Column) -> Column:
    """Whether a sampling protocol is one: thinking has an effort and no temperature; else there is a temperature from 0 to 2
    and no effort, and several draws of a protocol that doesn't think need one above 0."""
    warm = F.coalesce(temperature.between(0, 2), F.lit(False)) & effort.isNull()
    thinking = temperature.isNull() & F.coalesce(effort.isin("low", "high", "max"), F.lit(False))
    return F.when(mode == "enabled", thinking).when(mode == "provider_default", warm).otherwise(warm & ~((draws > 1) & (temperature == 0)))
