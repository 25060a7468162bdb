import pytest
from pyspark.sql import functions as F

from tessera import __main__ as cli
from tessera.functions import prompts as P
from tessera.operators.checks import Violated
from tessera.plans import jobs


def pool(spark):
    return spark.createDataFrame([(f"u{c}{s}", f"c{c}", s, s % 3 != 1, f"text {s} common") for c in range(4) for s in range(5)], "unit_id string, cluster_id string, seq int, valid boolean, text string")


def test_selection_job_and_tampering(spark):
    p = pool(spark)
    chosen = jobs.select_units(p, 2)["selection"]
    assert chosen.count() == 8 and jobs.check_selection(p, chosen, 2).count() == 0
    assert {r["code"] for r in jobs.check_selection(p, chosen.withColumn("incl_prob", F.lit(0.5)), 2).collect()} == {"different_incl_prob"}
    top = jobs.select_units(p, 1, "top_score", "seq")["selection"].collect()
    assert {r["seq"] for r in top} == {4} and {r["incl_prob"] for r in top} == {None}
    with pytest.raises(Violated):
        jobs.select_units(p.unionAll(p), 2)


def test_prompts_job(spark):
    message = lambda r, c: F.struct(F.lit(r).alias("role"), c.alias("content"))
    p = pool(spark).withColumn("messages", F.array(message("system", F.lit("a")), message("user", F.col("text"))))
    rows = jobs.build_prompts(p, p.where("seq < 2"), "a", "b")["prompts"].collect()
    assert {r["weight"] for r in rows} == {0.5} and {r["other_prompt"][0]["content"] for r in rows} == {"b"} and {r["prompt"][0]["content"] for r in rows} == {"a"}
    with pytest.raises(Violated):
        jobs.build_prompts(p, p.where("seq < 2"), "another")
    with pytest.raises(Violated):
        jobs.build_prompts(p.where("seq > 0"), p.where("seq < 2"), "a")


def test_paired_interval_refuses_gaps(spark):
    t = spark.createDataFrame([(r, c, 1.0) for r in range(2) for c in range(3)], "replicate_id int, cluster_id int, value double")
    made = jobs.paired_interval(t, t.withColumn("value", F.lit(0.0)), 40)
    assert made["interval"].first()["lower"] == 1.0 and made["table"].first()["only_a"] == 6
    with pytest.raises(Violated):
        jobs.paired_interval(t, t.where("cluster_id > 0"), 40)
    with pytest.raises(ValueError):
        jobs.paired_interval(t.where("cluster_id = 0"), t.where("cluster_id = 0"), 40)


def test_alignment_job(spark):
    g = spark.createDataFrame([("x", "u", "c1", 1.0, [1.0, 0.0]), ("x", "u", "c1", 1.0, [0.0, 1.0]), ("x", "v", "c2", 2.0, [-1.0, -1.0])], "group string, unit_id string, cluster_id string, weight double, vector array<double>")
    r = spark.createDataFrame([("h", [1.0, 1.0])], "cluster_id string, vector array<double>")
    s = jobs.alignments(g, r)["summary"].first()
    assert abs(s["cosine"]) < 1e-12 and s["negative_share"] == 0.5
    with pytest.raises(Violated):
        jobs.alignments(g, r.withColumn("cluster_id", F.lit("c1")))


def test_representativeness_of_everything_is_exact(spark):
    p = pool(spark)
    rows = jobs.representativeness(p, p, {"valid": F.col("valid").cast("string"), "seq": F.col("seq").cast("string")}, 20)["report"].collect()
    assert [(r["estimate"], r["lower"], r["upper"]) for r in rows] == [(0.0, 0.0, 0.0)] * 2


def test_command_line(spark, tmp_path):
    pool(spark).write.parquet(str(tmp_path / "pool.parquet"))
    assert cli.main(["nothing"]) == 2
    assert cli.main(["select_units", f"pool={tmp_path}/pool.parquet", "k=2", f"out={tmp_path}/out"]) == 0
    assert spark.read.parquet(f"{tmp_path}/out/selection.parquet").count() == 8
    assert '"identity"' in "".join(r[0] for r in spark.read.text(f"{tmp_path}/out/manifest").collect())
    with pytest.raises(Exception):
        cli.main(["select_units", f"pool={tmp_path}/pool.parquet", "k=2", f"out={tmp_path}/out"])


@pytest.mark.parametrize("protocol,n,broken", [
    (("enabled", None, "high"), 3, []), (("enabled", 0.5, "high"), 1, ["thinking_with_temperature"]), (("disabled", 0.0), 1, []), (("disabled", 0.0), 2, ["repeats_at_zero_temperature"]),
    (("provider_default", None), 1, ["temperature_out_of_range"]), (("disabled", 0.3, "low"), 0, ["samples_not_positive", "effort_without_thinking"]),
])
def test_sampling_protocol(protocol, n, broken):
    assert P.SamplingProtocol(*protocol).violations(n) == broken


def test_prompt_texts(spark):
    end = "\nRespond with exactly the next action on a single line, in the form 'Action: <command>'.\n"
    assert P.reference_prompt("Do.", None) == "Do." + end
    assert P.reference_prompt("Do.", {"a": ["x", "y"]}) == "Do.\nHere are examples:\nxy\n" + end == P.reference_prompt("Do.", "xy")
    with pytest.raises(ValueError):
        P.prompt_version({"v1": "x"}, "v2")
    message = spark.range(1).select(P.first_message(F.lit(" t "), F.lit("o"), F.array(F.lit("look"), F.lit("go 1"))).alias("m"))
    assert message.first()["m"] == "Task:\nt\n\nObservation:\no\n\nAdmissible actions:\n- look\n- go 1"
    assert message.select(P.choices(F.col("m")).alias("c")).first()["c"] == ["look", "go 1"]
