"""Whole jobs: tables in, tables out, refused when a check fails.

A job returns named DataFrames. `python -m tessera JOB key=path ... out=folder` reads its inputs by suffix, runs it, and
writes each result and a manifest; nothing is overwritten.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.functions import arrays, text as X
from tessera.operators import bootstrap, checks as C, estimators as E, history, panel, sampling, vectors, weights
from tessera.operators.ranking import by_key, global_rank
from tessera.operators.single import with_values
from tessera.sources import records
from tessera.sources.shared import discard, durable


def freeze_clusters(clusters: DataFrame, used: DataFrame, limit: int = 140, seed: int = 42) -> dict[str, DataFrame]:
    """A fixed list of clusters that no earlier list has, in a stable random order."""
    free = clusters.select("cluster_id").distinct().join(used.select("cluster_id").distinct(), "cluster_id", "left_anti")
    return {"list": sampling.first_n(free, limit, "cluster_id", seed).orderBy("shuffle_key", "cluster_id")}


def select_units(pool: DataFrame, k: int = 3, policy: str = "nested", score: str | None = None, seed: int = 42) -> dict[str, DataFrame]:
    """A selection of k units a cluster from a pool with unique ids, with its design."""
    C.enforce(C.all_of(C.unique(pool, "unit_id"), C.unique(pool, "cluster_id", "seq", code="duplicate_place")))
    if policy == "nested":
        chosen = sampling.nested_selection(pool, k, seed)
        return {"selection": chosen.select("unit_id", "cluster_id", "seq", F.lit("uniform_nested").alias("policy"), "incl_prob",
            F.lit(None).cast("double").alias("score"))}
    if policy == "top_score" and score:
        chosen = sampling.top_score(pool, k, score, "seq")
        return {"selection": chosen.select("unit_id", "cluster_id", "seq", F.lit("top_score").alias("policy"), "incl_prob",
            F.col(score).cast("double").alias("score"))}
    raise ValueError("policy is nested, or top_score with a score column")


def check_selection(pool: DataFrame, selection: DataFrame, k: int = 3, seed: int = 42) -> DataFrame:
    """Violations of a recorded selection against the one that the pool gives."""
    return C.same_rows(select_units(pool, k, seed=seed)["selection"], selection, "unit_id", {"incl_prob": 1e-12})


def annotation_counts(records: DataFrame, calls_per_unit: int) -> DataFrame:
    """Violations of the budget: every unit has all of its draws, valid or not."""
    sized = records.select("unit_id", F.size("draws").alias("calls"))
    return C.all_of(C.row_checks(sized, F.col("unit_id"), {"budget_identity": F.col("calls") == calls_per_unit}), C.unique(records, "unit_id"))


def build_training(records: DataFrame, weighting: str = "game_state_mean", val_fraction: float = 0.1, seed: int = 42) -> dict[str, DataFrame]:
    """Training and validation rows of whole clusters, with acceptance; each cluster's weights sum to 1."""
    records = durable(records.select("unit_id", "cluster_id", "base_value", "draws"), "records")  # read by every step below
    C.enforce(C.unique(records, "unit_id"))
    rows = durable(weights.training_rows(records, weighting), "training-rows")
    if weighting == "game_state_mean":
        C.enforce(C.sums_to_one(rows, "cluster_id", "weight"))
    clusters = durable(rows.select("cluster_id").distinct(), "clusters")  # the split's passes read it again and again
    split = durable(sampling.cluster_split(clusters, val_fraction, "cluster_id", seed=seed).select("cluster_id", "is_validation"), "split")
    discard(clusters)
    both = rows.join(split, "cluster_id")
    return {"train": both.where("not is_validation").drop("is_validation"), "validation": both.where("is_validation").drop("is_validation"),
        "acceptance": weights.acceptance(records)}


def build_prompts(pool: DataFrame, selection: DataFrame, system_prompt: str, other_prompt: str | None = None) -> dict[str, DataFrame]:
    """Prompt rows of selected units, in both views of one history, with weight 1 / selected units of the cluster."""
    C.enforce(C.all_of(C.unique(selection, "unit_id"), C.subset(selection, pool, "unit_id", "absent_from_pool")))
    joined = selection.select("unit_id").join(pool, "unit_id")
    roles = F.transform("messages", lambda m: m["role"])
    own = F.col("messages")[0]["content"] == system_prompt
    C.enforce(C.row_checks(joined, F.col("unit_id"), {"roles": arrays.roles_alternate(roles), "system_prompt": own}))
    other = arrays.replace_system(F.col("messages"), F.lit(other_prompt)) if other_prompt else F.col("messages")
    return {"prompts": weights.cluster_share(joined).select("unit_id", "cluster_id", "seq", F.col("messages").alias("prompt"),
        other.alias("other_prompt"), F.col("share").alias("weight"))}


def paired_interval(treatment: DataFrame, control: DataFrame, replicates: int = 50_000, seed: int = 42) -> dict[str, DataFrame]:
    """Crossed bootstrap of replicate_id x cluster_id outcomes of two arms, and their 2x2 table."""
    keys = ["replicate_id", "cluster_id"]
    t, c = treatment.select(*keys, F.col("value").alias("t")), control.select(*keys, F.col("value").alias("c"))
    both = t.join(c, keys, "full")
    C.enforce(C.all_of(C.unique(t, *keys), C.unique(c, *keys),
        C.row_checks(both, F.concat_ws("|", *keys), {"paired": F.col("t").isNotNull() & F.col("c").isNotNull()})))
    n = both.agg(F.count_distinct("replicate_id").alias("r"), F.count_distinct("cluster_id").alias("c")).first()
    if n["c"] < 2:
        raise ValueError("at least two clusters are needed")
    interval = bootstrap.crossed(treatment.sparkSession, both.select(*keys, (F.col("t") - F.col("c")).alias("x")), *keys, "x", replicates, seed,
        resample_replicates=n["r"] > 1)
    return {"interval": interval.withColumn("resampled_replicates", F.lit(n["r"] > 1)), "table": E.mcnemar(both, "t", "c")}


def representativeness(pool: DataFrame, selection: DataFrame, features: dict, replicates: int = 10_000, seed: int = 42) -> dict[str, DataFrame]:
    """For each feature the divergence of a selection's balanced distribution from the pool's, with an interval.

    Both sides are held to the clusters that both have.
    """
    # written once, without texts; each feature's distributions and the interval's passes read them
    slim = durable(pool.select("unit_id", "cluster_id", *[column.alias(f"__{k}") for k, column in enumerate(features.values())]), "pool")
    chosen = durable(slim.join(selection.select("unit_id"), "unit_id", "left_semi"), "chosen")
    common = chosen.select("cluster_id").distinct()
    out = []
    for k, name in enumerate(features):
        a, b = (E.cluster_pmf(x.join(common, "cluster_id", "left_semi").select("cluster_id", F.col(f"__{k}").alias("v")), "v") for x in (slim, chosen))
        made = durable(bootstrap.paired_js(pool.sparkSession, a, b, "v", replicates, seed), "divergence")
        out.append(made.select(F.lit(name).alias("feature"), "*"))
    discard(slim, chosen)
    return {"report": C.all_of(*out)}


def transfer_panel(pool: DataFrame, sources: DataFrame, selections: DataFrame, k: int = 10, least: int = 5, min_similarity: float = 0.0,
    text_weight: float = 0.5) -> dict[str, DataFrame]:
    """Neighbours in other clusters, out of what no selection names, and the sources that have too few."""
    targets = pool.where("valid").join(selections.select("unit_id").distinct(), "unit_id", "left_anti")
    found, few = panel.neighbours(sources, targets, k, least, min_similarity, text_weight, X.STOP_WORDS)
    return {"neighbours": found, "attrition": few}


def judged(memberships: DataFrame, population: DataFrame, replicates: int = 10_000, seed: int = 42) -> dict[str, DataFrame]:
    """Shares of resolved labels by experiment, observed and design-based, and the paired contrast of two experiments.

    memberships: experiment, unit_id, cluster_id, base_valid, label, incl_prob. A failed judgement stays missing.
    """
    label = E.resolved_label(F.col("base_valid"), F.col("label"))
    rows = memberships.withColumn("resolved", label).withColumn("strong", (F.col("resolved") == "Strong").cast("int"))
    names = [r[0] for r in rows.select("experiment").distinct().orderBy("experiment").collect()]  # experiments are arms: a few
    observed, designed = [], []
    for name in names:
        mine = rows.where(F.col("experiment") == name)
        observed.append(E.balanced_indicator(mine, "strong").select(F.lit(name).alias("experiment"), "*"))
        designed.append(E.ht_mean(E.cluster_totals(mine, population, {"strong": "strong"}), "strong").select(F.lit(name).alias("experiment"), "*"))
    out = {"observed": C.all_of(*observed), "designed": C.all_of(*designed)}
    if len(names) == 2:
        per = rows.groupBy("cluster_id").pivot("experiment", names).agg(F.avg("strong")).na.drop()
        out["contrast"] = bootstrap.mean_difference(memberships.sparkSession,
            per.select("cluster_id", (F.col(names[1]) - F.col(names[0])).alias("z")), "z", "cluster_id", replicates, seed)
    return out


def positions(replays: DataFrame, population: DataFrame, replicates: int = 10_000, seed: int = 42) -> dict[str, DataFrame]:
    """Consequences of replayed draws: by unit, then by cluster, then over the population, and given disagreement.

    replays: unit_id, cluster_id, incl_prob, disagreement, consequence for each draw.
    """
    d, c = F.col("disagreement").cast("double"), F.col("consequence").cast("double")
    units = replays.groupBy("unit_id", "cluster_id", "incl_prob").agg(F.avg(c).alias("consequence"), F.avg(d).alias("divergence"),
        F.avg(c * d).alias("divergent_consequence"), F.count("*").alias("draws"))
    totals = durable(E.cluster_totals(units, population, {"c": "consequence", "d": "divergence", "cd": "divergent_consequence"}), "totals")  # every estimate reads it
    return {
        "units": units, "observed": E.balanced_indicator(units, "consequence"), "designed": E.ht_mean(totals, "c"),
            "given_disagreement": E.ht_ratio(totals, "cd", "d"),
        "interval": bootstrap.ratio(replays.sparkSession, totals, "cd", "d", "cluster_id", replicates, seed, linear=True),
    }


def alignments(gradients: DataFrame, reference: DataFrame) -> dict[str, DataFrame]:
    """Alignment of each unit's mean vector with a reference direction, weighted by unit.

    gradients: group, unit_id, cluster_id, weight, vector for each draw; reference: vector, cluster_id of held-out rows.
    """
    C.enforce(C.disjoint(gradients, reference, "cluster_id", "reference_in_training"))
    means = vectors.mean_vector(gradients, ["group", "unit_id"], "vector").withColumnRenamed("mean", "unit_vector")
    one = vectors.mean_vector(reference.select(F.lit(0).alias("all"), "vector"), ["all"], "vector").select(F.col("mean").alias("direction"))
    weight = gradients.groupBy("group", "unit_id").agg(F.sum("weight").alias("weight"))
    pairs = vectors.alignment(with_values(means, one), "unit_vector", "direction").join(weight, ["group", "unit_id"])
    summary = pairs.groupBy("group").agg((F.sum(F.col("cosine") * F.col("weight")) / F.sum("weight")).alias("cosine"),
        F.avg((F.col("dot") < 0).cast("int")).alias("negative_share"), F.count("*").alias("units"))
    return {"units": pairs.select("group", "unit_id", "dot", "cosine", "weight"), "summary": summary}


def collection_quota(attempts: DataFrame, quota: int = 10, most: int = 100) -> dict[str, DataFrame]:
    """Attempts that a collector with a quota of successes in each stratum makes, and what it ends with."""
    made = sampling.until_quota(attempts, quota, most, "seq", "solved", "stratum")
    return {"attempts": made, "summary": made.groupBy("stratum").agg(F.count("*").alias("tried"), F.count_if("solved").alias("solved"))}


def demonstration(turns: DataFrame) -> dict[str, DataFrame]:
    """The shortest solved episode of each stratum, one without repeated actions if there is any."""
    marked = history.previous(turns, "action", "cluster_id", "seq")
    episodes = marked.groupBy("cluster_id", "stratum").agg(F.max("repeat").alias("has_repeat"), F.count("*").alias("n"),
        F.max("solved").alias("solved")).where("solved")
    best = episodes.groupBy("stratum").agg(F.min_by("cluster_id", F.struct("has_repeat", "n", "cluster_id")).alias("cluster_id"))
    return {"picked": turns.join(best, ["stratum", "cluster_id"], "left_semi")}


def score_units(pool: DataFrame) -> dict[str, DataFrame]:
    """Entropy of each unit's action scores; a unit without scores, or with one twice, is refused."""
    pool = durable(pool.select("unit_id", "cluster_id", "scores"), "scored-pool")  # gathered once for the checks and the scores
    C.enforce(C.all_of(C.unique(pool, "unit_id"), C.row_checks(pool, F.col("unit_id"), {"scores": F.size("scores") > 0})))
    return {"scores": pool.select("unit_id", "cluster_id", arrays.softmax_entropy(F.array_sort("scores")).alias("score"), F.size("scores").alias("actions"))}


def collect_pool(turns: DataFrame, ledger: DataFrame, budget: int) -> dict[str, DataFrame]:
    """Units of played turns, with their history held to a budget; and violations against the ledger of requests.

    turns: unit_id, cluster_id, seq, observation; ledger: unit_id, status.
    """
    kept = history.truncated(turns.select("cluster_id", "seq", "observation"), "cluster_id", "seq", F.length("observation"),
        budget).select("cluster_id", "seq", "kept", "overflow")
    pool = turns.join(kept, ["cluster_id", "seq"])
    said = ledger.where("status = 'ok'").select("unit_id")
    return {"pool": pool, "violations": C.all_of(C.unique(pool, "unit_id"), C.subset(turns, said, "unit_id", "not_in_ledger"),
        C.subset(said, turns, "unit_id", "no_such_turn"))}


def annotate(pool: DataFrame, selection: DataFrame, draws: DataFrame, calls: int) -> dict[str, DataFrame]:
    """Records of selected units with their draws, and violations: a unit that isn't in the pool, or without all its calls.

    draws: unit_id, sample, action, valid; a failed call is a draw that isn't valid.
    """
    chosen = selection.select("unit_id").join(pool, "unit_id", "left_semi")
    made = by_key(draws, "unit_id").groupBy("unit_id").agg(F.array_sort(F.collect_list(F.struct("sample", "action", "valid"))).alias("draws"))
    found = chosen.join(made, "unit_id", "left").select("unit_id", F.coalesce("draws", F.array().cast(made.schema["draws"].dataType)).alias("draws"))
    # the budget needs numbers only: they are added up where the draws lie, and no draw moves
    counted = chosen.join(draws.groupBy("unit_id").agg(F.count("*").alias("n")), "unit_id", "left").select("unit_id", F.coalesce("n", F.lit(0)).alias("n"))
    short = C.row_checks(counted, F.col("unit_id"), {"budget_identity": F.col("n") == calls})
    return {"records": found, "violations": C.all_of(short, C.subset(selection, pool, "unit_id", "absent_from_pool"))}


def build_expert(turns: DataFrame, val_fraction: float = 0.25, seed: int = 42) -> dict[str, DataFrame]:
    """Valid replies of solved clusters with equal shares inside a cluster, split by cluster within each stratum.

    turns: unit_id, cluster_id, stratum, seq, role, valid, solved.
    """
    rows = weights.cluster_share(turns.where("solved and valid and role = 'assistant'"))
    split = sampling.cluster_split(rows.select("cluster_id", "stratum").distinct(), val_fraction, "cluster_id", "stratum",
        seed=seed).select("cluster_id", "is_validation")
    return {"rows": rows.join(split, "cluster_id")}


def aggregate_evaluations(results: DataFrame, tolerance: float = 1e-12) -> dict[str, DataFrame]:
    """One table of outcomes over replicates that have the same clusters, outcomes of 0 and 1, and the rate they report.

    results: replicate_id, cluster_id, value, reported.
    """
    per = results.groupBy("replicate_id").agg(F.avg("value").alias("rate"), F.max("reported").alias("reported"), F.count("*").alias("n"),
        F.count_distinct("cluster_id").alias("clusters"), F.count_if(~F.col("value").isin(0, 1)).alias("odd"))
    all_clusters = results.select("cluster_id").distinct().agg(F.count("*").alias("all_clusters"))
    told = with_values(per, all_clusters)
    ok = {"repeated_cluster": F.col("n") == F.col("clusters"), "missing_cluster": F.col("clusters") == F.col("all_clusters"),
        "not_binary": F.col("odd") == 0, "wrong_rate": F.abs(F.col("rate") - F.col("reported")) <= tolerance}
    wrong = C.row_checks(told, F.col("replicate_id"), ok)
    sound = results.join(wrong.select(F.col("key").alias("__key")).distinct(), F.col("replicate_id").cast("string") == F.col("__key"), "left_anti")
    return {"bundle": results.select("replicate_id", "cluster_id", "value"), "accepted": sound.select("replicate_id", "cluster_id", "value"), "violations": wrong}


def merge_records(shards: list[DataFrame], key: str) -> dict[str, DataFrame]:
    """All shards' records in the order of their key, with its place; records that two shards hold are refused."""
    merged, twice = records.merge_shards(shards, key)
    C.enforce(twice)
    return {"merged": global_rank(merged, [key])[0]}


def measure_gap(turns: DataFrame, limit: int) -> dict[str, DataFrame]:
    """Saturated gaps of turns taken in turn from each stratum: turns: unit_id, stratum, seed-ordered; log_ratio."""
    chosen = sampling.round_robin(turns, limit, "unit_id", "stratum")
    gap = chosen.withColumn("gap", arrays.saturated_gap(F.col("log_ratio")))
    return {"summary": gap.groupBy("stratum").agg(F.count("*").alias("n"), F.avg("gap").alias("mean_gap"),
        F.sqrt(F.avg(F.col("log_ratio") * F.col("log_ratio"))).alias("rms"))}


def training_curves(lines: DataFrame, width: int = 5, n: int = 10) -> dict[str, DataFrame]:
    """Log lines (series, value) as smoothed losses, and each series' change from its head to its tail."""
    parsed = lines.select("series", F.regexp_extract("value", r"step:(\d+)", 1).cast("long").alias("step"),
        F.expr(r"try_cast(regexp_extract(value, 'loss:([-+0-9.eE]+)', 1) as double)").alias("loss"))
    points = parsed.groupBy("series", "step").agg(F.avg("loss").alias("loss"))
    return {"curves": history.moving_average(points, "loss", "step", width, "series"), "summary": history.head_tail_change(points, "loss", "step", n, "series")}


def baseline_audit(a: DataFrame, b: DataFrame, key: str) -> dict[str, DataFrame]:
    """Whether two runs are of the same model: rows on one side only, and the statuses of each."""
    sides = a.exceptAll(b).select(F.lit("only_a").alias("side"), "*").unionByName(b.exceptAll(a).select(F.lit("only_b").alias("side"), "*"))
    return {"differences": sides, "counts": sides.groupBy("side").agg(F.count("*").alias("n"), F.count_distinct(key).alias("keys"))}


def prevalidate(turns: DataFrame, least: float = 0.05) -> dict[str, DataFrame]:
    """The first disagreement of each cluster, what correcting it changed, and whether that is worth while.

    turns: cluster_id, seq, differs, before, after (outcomes without and with the correction).
    """
    first = history.first_where(turns, F.col("differs"), "cluster_id", "seq")
    gap = F.col("after") - F.col("before")
    net = F.avg(gap)
    return {"summary": first.agg(F.count("*").alias("clusters"), F.count_if(gap > 0).alias("improved"), F.count_if(gap < 0).alias("worsened"),
        net.alias("net"), F.when(net >= least, "worthwhile").otherwise("not_shown").alias("verdict"))}


def transfer_effects(metadata: DataFrame, base: DataFrame, updated: DataFrame, groups: DataFrame) -> dict[str, DataFrame]:
    """Changes of a source's own score and of its neighbours', by group, with the scores that lack a side.

    metadata: source_id, self_score_id, neighbour_score_ids; base, updated: score_id, score; groups: source_id, group.
    """
    changes, faults = panel.assemble(metadata, base, updated)
    summary = changes.join(groups, "source_id").groupBy("group").agg(F.count("*").alias("sources"), F.avg("S").alias("own"), F.avg("T").alias("others"))
    return {"changes": changes, "faults": faults, "summary": summary}


def whole_chain(pool: DataFrame, draws: DataFrame, calls: int, k: int = 2, seed: int = 42) -> dict[str, DataFrame]:
    """From a pool to weighted rows: k units a cluster, their first `calls` draws, what was accepted, and training rows.

    draws: unit_id, sample, action, valid; pool also has base_value.
    """
    chosen = sampling.nested_selection(pool, k, seed).select("unit_id", "cluster_id", "base_value")
    made = draws.where(F.col("sample") <= calls).groupBy("unit_id").agg(F.array_sort(F.collect_list(F.struct("sample", "action", "valid"))).alias("d"))
    found = chosen.join(made, "unit_id").select("unit_id", "cluster_id", "base_value",
        F.transform("d", lambda x: F.struct(x["action"].alias("action"), x["valid"].alias("valid"))).alias("draws"))
    return {"records": found, "levels": weights.distinct_levels(found), "rows": weights.training_rows(found)}


def one_shot(pool: DataFrame, draws: DataFrame, seed: int = 42) -> dict[str, DataFrame]:
    """One unit a cluster, drawn uniformly, with the first of its draws, valid or not, or none."""
    first = draws.groupBy("unit_id").agg(F.min(F.struct("sample", "action", "valid")).alias("d"))
    chosen = sampling.nested_selection(pool, 1, seed).select("unit_id", "cluster_id", "incl_prob")
    return {"records": chosen.join(first, "unit_id", "left").select("unit_id", "cluster_id", "incl_prob", "d.action",
        F.coalesce("d.valid", F.lit(False)).alias("valid"))}


def evaluation_summary(episodes: DataFrame) -> dict[str, DataFrame]:
    """Episodes (arm, task, won) as wins of games by task and arm, with each arm's total."""
    counted = episodes.cube("arm", "task").agg(F.count("*").alias("games"), F.sum(F.col("won").cast("int")).alias("wins"), F.grouping_id().alias("level"))
    return {"summary": counted.where("level < 2").select("arm", F.when(F.col("level") == 1, "all").otherwise(F.col("task")).alias("task"), "games",
        "wins", (F.col("wins") / F.col("games")).alias("rate"))}


def validate_pair(pool: DataFrame, broad: DataFrame, deep: DataFrame, runs: DataFrame, allowed: tuple[str, ...]) -> dict[str, DataFrame]:
    """Faults of a pair of annotation runs, one broad and one deep, of one pool: code, key.

    broad, deep: unit_id and calls of each selected unit; runs: arm (broad, deep) and config (JSON) of the two runs. Their
    units come from the pool, the deep run's from the broad one's; each run has the same calls for all its units; both cost
    the same; outside the allowed paths their configurations are alike.
    """
    from tessera.operators import audit as A

    cost = lambda df: df.agg(F.coalesce(F.sum("calls"), F.lit(0)).alias("cost"), F.count_distinct("calls").alias("kinds"))
    sums = with_values(cost(broad).select(F.col("cost").alias("b"), F.col("kinds").alias("bk")), cost(deep).select(F.col("cost").alias("d"), F.col("kinds").alias("dk")))
    budget = C.row_checks(sums, F.lit("pair"), {"same_budget": F.col("b") == F.col("d"), "calls_differ": (F.col("bk") == 1) & (F.col("dk") == 1)})
    unlike = A.not_shared(runs.select(F.lit(1).alias("pair"), "config"), "pair", "config", allowed).select(F.lit("config_differs").alias("code"), F.col("path").alias("key"), F.lit(None).cast("string").alias("detail"))
    parts = [C.unique(broad, "unit_id"), C.unique(deep, "unit_id"), C.subset(broad, pool, "unit_id", "broad_not_in_pool"), C.subset(deep, pool, "unit_id", "deep_not_in_pool"),
        C.subset(deep, broad, "unit_id", "deep_not_in_broad"), budget]
    return {"violations": C.all_of(*[p.select("code", "key") for p in [*parts, unlike]])}


def verify_stages(units: DataFrame, selection: DataFrame, records_: DataFrame, ledger: DataFrame, rows: DataFrame, training: DataFrame,
    evaluation: DataFrame) -> DataFrame:
    """stage, status, n of six stages: PENDING without rows, else PASS or FAIL.

    units: unit_id, actions; selection: unit_id, policy, incl_prob; records_: unit_id, calls; ledger: request_id, hash; rows:
    cluster_id, weight, mask (of target tokens, a suffix in the second half); training: loss_first, loss_last, ratio, norm;
    evaluation: cluster_id, treatment, control.
    """
    def stage(name: str, df: DataFrame, ok) -> DataFrame:
        found = df.agg(F.count("*").alias("n"), F.coalesce(ok, F.lit(False)).alias("ok"))
        return found.select(F.lit(name).alias("stage"), F.when(F.col("n") == 0, "PENDING").when(F.col("ok"), "PASS").otherwise("FAIL").alias("status"), "n")

    at_ledger = ledger.agg(F.count("*").alias("requests"), F.coalesce(F.bool_and(F.length("hash") == 64), F.lit(False)).alias("hashed"))
    calls = with_values(records_, at_ledger)
    on = F.array_position("mask", 1)
    suffix = (on > 0) & (on - 1 > F.size("mask") * 0.5) & (F.aggregate("mask", F.lit(0), lambda a, x: a + x) == F.size("mask") - on + 1)
    shares = rows.groupBy("cluster_id").agg(F.sum("weight").alias("w"), F.bool_and(suffix).alias("suffix"))
    return C.all_of(
        stage("states", units, (F.count("*") == F.count_distinct("unit_id")) & F.bool_and(F.size("actions") > 0)),
        stage("selection", selection, (F.count_distinct("policy") == 1) & F.bool_and((F.col("incl_prob") > 0) & (F.col("incl_prob") <= 1))),
        stage("annotation", calls, (F.sum("calls") == F.max("requests")) & F.bool_and("hashed")),
        stage("rows", shares, F.bool_and((F.abs(F.col("w") - 1) < 1e-9) & F.col("suffix"))),
        stage("training", training, F.bool_and((F.col("loss_last") < F.col("loss_first")) & F.col("ratio").between(1e-3, 1e-2) & (F.col("norm") > 0))),
        stage("evaluation", evaluation, F.bool_and(F.col("treatment").isNotNull() & F.col("control").isNotNull())),
    )


JOBS = {f.__name__: f for f in (
    freeze_clusters, select_units, build_training, build_prompts, paired_interval, transfer_panel, judged, positions, alignments, collection_quota,
        demonstration,
    score_units, collect_pool, annotate, build_expert, aggregate_evaluations, measure_gap, training_curves, baseline_audit, prevalidate,
    transfer_effects, whole_chain, one_shot, evaluation_summary, representativeness, validate_pair)}
