"""The request ledger as a stream that is stopped and started again, and refusals of repeated requests."""

import random

import pytest

from tessera.sources import files
from tessera.streaming import ledger

SCHEMA = "request_id string, family string, at long, solved boolean, status string"


def requests(n=160, seed=4):
    rnd = random.Random(seed)
    rows = [(f"r{rnd.randrange(n * 3 // 4)}", "hot" if rnd.random() < 0.6 else rnd.choice("ab"), k, rnd.choice([True, False, False, None]), rnd.choice(["ok", "error"])) for k in range(n)]
    return rows


def plain(batches, quota, budget):
    out, state = [], {}
    for batch in batches:
        for r in sorted(batch, key=lambda r: (r[2], r[0])):
            done, keys = state.setdefault(r[1], [0, []])
            verdict = "duplicate" if r[0] in keys else "quota_met" if done >= quota else "budget_spent" if len(keys) >= budget else "admitted"
            if verdict == "admitted":
                keys.append(r[0])
                state[r[1]][0] += bool(r[3])
            out.append((*r, verdict))
    return out


@pytest.mark.parametrize("quota,budget", [(7, 100), (100, 20)])
def test_each_request_is_judged_once_over_restarts(spark, tmp_path, monkeypatch, quota, budget):
    rows = requests()
    batches = [rows[k : k + 40] for k in range(0, 160, 40)]
    source, path, checkpoint = (f"{tmp_path}/{x}" for x in ("in", "out", "checkpoint"))
    for batch in batches[:3]:
        spark.createDataFrame(batch, SCHEMA).coalesce(1).write.mode("append").parquet(source)

    def stream():
        return ledger.judged(ledger.ledger_stream(spark, source, SCHEMA, 1), "request_id", "family", "at", "solved", quota, budget)

    # a writer that fails after it has written the second batch, before the batch is committed
    real = ledger.appended

    def failing(df, out, saved):
        def write(batch, number):
            batch.write.mode("overwrite").parquet(f"{out}/batch={number}")
            if number == 1:
                raise RuntimeError("stopped")

        return df.writeStream.foreachBatch(write).option("checkpointLocation", saved).trigger(availableNow=True).start()

    with pytest.raises(Exception, match="stopped"):
        failing(stream(), path, checkpoint).awaitTermination()
    real(stream(), path, checkpoint).awaitTermination()
    spark.createDataFrame(batches[3], SCHEMA).coalesce(1).write.mode("append").parquet(source)
    real(stream(), path, checkpoint).awaitTermination()
    got = [tuple(r[c] for c in ("request_id", "family", "at", "solved", "status", "verdict")) for r in spark.read.parquet(path).collect()]
    assert sorted(got, key=str) == sorted(plain(batches, quota, budget), key=str)
    assert {g[-1] for g in got} >= {"admitted", "duplicate"}


def test_repeated_requests_are_refused(spark, tmp_path):
    path = f"{tmp_path}/ledger"
    df = spark.createDataFrame([("a", "ok"), ("b", "error")], "request_id string, status string")
    files.append_ledger(df, path, "request_id")
    with pytest.raises(ValueError, match="b"):
        files.append_ledger(spark.createDataFrame([("b", "ok"), ("c", "ok")], df.schema), path, "request_id")
    with pytest.raises(ValueError, match="d"):
        files.append_ledger(spark.createDataFrame([("d", "ok"), ("d", "ok")], df.schema), path, "request_id")
    files.append_ledger(spark.createDataFrame([("c", "ok")], df.schema), path, "request_id")
    assert sorted(r["request_id"] for r in spark.read.parquet(path).collect()) == ["a", "b", "c"]
