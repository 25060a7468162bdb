"""Engine views over the driver tables, as DataFrames and as SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.operators.ranking import by_key


def _t(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


def unit(spark, d):
    """Conversation turns as ordered units of clusters."""
    c, t = F.col("conv_id").cast("string"), F.col("turn").cast("string")
    return _t(spark, d, "conversations").select(
        c.alias("cluster_id"), F.col("turn").cast("int").alias("seq"), F.sha2(F.concat_ws("|", c, t), 256).alias("unit_id"),
            F.col("text").alias("observation"), "role",
        F.concat(F.lit("t"), (F.col("conv_id") % 6).cast("string")).alias("stratum"), (F.length("text") % 7 != 0).alias("valid"),
    )


UNIT = """v_unit AS (SELECT cast(conv_id AS varchar) cluster_id, cast(turn AS int) seq, sha256(cast(conv_id AS varchar) || '|' || cast(turn AS varchar)) unit_id,
 text observation, role, 't' || cast(conv_id % 6 AS varchar) stratum, length(text) % 7 <> 0 valid FROM conversations)"""


def label(spark, d):
    """Documents with their labels, null where there is none."""
    return _t(spark, d, "documents").select("doc_id", "lang", "source", "n_chars").join(_t(spark, d, "labels").select("doc_id", "quality", "toxic"),
        "doc_id", "left").select(F.col("doc_id").alias("unit_id"), F.col("source").alias("cluster_id"), F.col("lang").alias("stratum"), "n_chars",
            "quality", "toxic")


LABEL = """v_label AS (SELECT d.doc_id unit_id, d.source cluster_id, d.lang stratum, d.n_chars, l.quality, l.toxic FROM documents d LEFT
 JOIN labels l ON d.doc_id = l.doc_id)"""


def draw(spark, d):
    """Orders as annotated units: lines are repeated draws, valid from a quantity of 10."""
    lines = _t(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_returnflag", (F.col("l_quantity") >= 10).alias("valid"))
    grouped = by_key(lines, "l_orderkey").groupBy("l_orderkey").agg(F.array_sort(F.collect_list(F.struct("l_linenumber", "l_partkey", "l_suppkey",
        F.col("l_returnflag").alias("action"), "valid"))).alias("d"))
    base = F.when(F.col("o_orderstatus") == "F", "R").when(F.col("o_orderstatus") == "O", "N").otherwise("A")
    orders = _t(spark, d, "orders").select("o_orderkey", "o_custkey", base.alias("base_value"))
    return grouped.join(orders, F.col("l_orderkey") == F.col("o_orderkey")).select(F.col("l_orderkey").alias("unit_id"),
        F.col("o_custkey").alias("cluster_id"), "base_value",
            F.transform("d", lambda x: F.struct(x["action"].alias("action"), x["valid"].alias("valid"))).alias("draws"))


DRAW = """v_line AS (SELECT l_orderkey unit_id, o_custkey cluster_id, CASE o_orderstatus WHEN 'F' THEN 'R' WHEN 'O' THEN 'N' ELSE 'A' END base_value,
 row_number() OVER (PARTITION BY l_orderkey
 ORDER BY l_linenumber, l_partkey, l_suppkey, l_returnflag, l_quantity >= 10) ln, l_returnflag action, l_quantity >= 10 valid FROM lineitem
 JOIN orders ON l_orderkey = o_orderkey),
 v_rec AS (SELECT unit_id, cluster_id, base_value, count(*) calls, count(*) FILTER (valid) k, max((valid AND action <> base_value)::int) FILTER (valid) dis
 FROM v_line GROUP BY ALL)"""


def outcome(spark, d):
    """Paired binary outcomes of two arms for each replicate and cluster."""
    o = _t(spark, d, "orders").select((F.col("o_orderkey") % 4).cast("int").alias("replicate_id"),
        (F.col("o_custkey") % 50).cast("int").alias("cluster_id"), F.col("o_orderkey").alias("k"),
            (F.col("o_orderstatus") == "F").cast("int").alias("t"), F.col("o_orderpriority").substr(1, 1).isin("1", "2").cast("int").alias("c"))
    return o.groupBy("replicate_id", "cluster_id").agg(F.min_by("t", "k").alias("treatment"), F.min_by("c", "k").alias("control"))


OUTCOME = """v_eval AS (SELECT cast(o_orderkey % 4 AS int) replicate_id, cast(o_custkey % 50 AS int) cluster_id, arg_min((o_orderstatus = 'F')::int, o_orderkey) treatment,
 arg_min((substr(o_orderpriority, 1, 1) IN ('1', '2'))::int, o_orderkey) control FROM orders GROUP BY 1, 2)"""


def vec(spark, d):
    return _t(spark, d, "embeddings").select(F.col("vec_id").alias("unit_id"), F.col("label").alias("group_id"), "embedding")


VEC = "v_vec AS (SELECT vec_id unit_id, label group_id, embedding FROM embeddings)"


def log(spark, d):
    return _t(spark, d, "events").select(F.col("event_id").alias("request_id"), "ts", F.col("event_type").alias("status"),
        F.col("user_id").alias("client"), "value", "props")


LOG = "v_log AS (SELECT event_id request_id, ts, event_type status, user_id client, value, props FROM events)"
