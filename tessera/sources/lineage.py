"""Content-addressed lineage of files and tables, read through Spark so that any store works."""

from __future__ import annotations

import hashlib
import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.functions.canon import canonical_json, without_paths


def tree_fingerprint(spark: SparkSession, path: str, pattern: str = "*") -> str:
    """One hash of a folder's files: relative path, size and content hash of each, in path order."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", pattern).load(path)
    facts = files.select("path", "length", F.sha2("content", 256).alias("sha256"))
    folded = hashlib.sha256()
    rows = sorted((r["path"], r["length"], r["sha256"]) for r in facts.toLocalIterator())
    root = rows[0][0][: rows[0][0].rindex("/")] if rows else ""
    while rows and not all(r[0].startswith(root + "/") for r in rows):
        root = root[: root.rindex("/")]
    for name, size, sha in rows:
        folded.update(f"{name[len(root) + 1 :]}\0{size}\0{sha}\n".encode())
    return folded.hexdigest()


def table_digest(df: DataFrame) -> dict:
    """Row count and an order-free digest of a table, one aggregate."""
    row = df.agg(F.count("*").alias("rows"), F.bit_xor(F.xxhash64(*df.columns)).alias("xor"),
        F.sum(F.xxhash64(*df.columns).cast("decimal(38,0)")).alias("sum")).first()
    return {"rows": row["rows"], "xor": row["xor"], "sum": str(row["sum"])}


def manifest(inputs: dict[str, dict], outputs: dict[str, dict], config: dict) -> dict:
    body = {"inputs": inputs, "outputs": outputs, "config": config}
    return body | {"identity": hashlib.sha256(canonical_json(without_paths(body)).encode()).hexdigest()}


def manifest_json(value: dict) -> str:
    return json.dumps(value, indent=2, sort_keys=True, ensure_ascii=False, allow_nan=False)
