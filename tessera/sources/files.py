"""Files as sources and sinks: configurations, folders of episodes, ledgers, commits and cached lists.

Everything is read and written through Spark and its file systems, so any store works.
"""

from __future__ import annotations

import hashlib
import json
from collections.abc import Iterable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessera.sources.shared import durable, shared_folder


def plain(value):
    """A nested value of array libraries as Python's own kinds."""
    if isinstance(value, dict):
        return {str(k): plain(v) for k, v in value.items()}
    if hasattr(value, "tolist"):
        return plain(value.tolist())
    return [plain(v) for v in value] if isinstance(value, (list, tuple)) else value


def parsed_config(text: str) -> dict:
    """YAML where its parser is there, else JSON, which YAML contains."""
    try:
        import yaml
    except ImportError:
        return json.loads(text)
    return yaml.safe_load(text)


def configs(spark: SparkSession, path: str) -> DataFrame:
    """file, config (JSON with keys in order) of each configuration file of a folder: files that people write, so a few."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path).select("path", "content")
    rows = [(r["path"], json.dumps(parsed_config(bytes(r["content"]).decode()), sort_keys=True)) for r in files.toLocalIterator()]
    return spark.createDataFrame(rows, "file string, config string")


def episodes(files: DataFrame, path: str = "path", skipped: Iterable[str] = (), name: str = "game") -> DataFrame:
    """task, trial, path of a listing's episode files, `<task>/<trial>/<name>.<suffix>`, without tasks whose name holds a
    skipped word; folders at other levels aren't episodes."""
    found = files.select(F.col(path).alias("path"), F.regexp_extract(path, rf"([^/]+)/([^/]+)/{name}\.[^/.]+$", 1).alias("task"),
        F.regexp_extract(path, rf"([^/]+)/([^/]+)/{name}\.[^/.]+$", 2).alias("trial"))
    keep = F.col("task") != ""
    for word in skipped:
        keep = keep & ~F.contains(F.col("task"), F.lit(word))
    return found.where(keep).select("task", "trial", "path")


def append_ledger(rows: DataFrame, path: str, key: str | None = None) -> None:
    """Adds requests to a ledger, all of them or none; one whose status is an error is a row like any other.

    With a key, requests that repeat one of their own or of the ledger are refused before anything is written.
    """
    if key:
        spark = rows.sparkSession
        at = spark._jvm.org.apache.hadoop.fs.Path(path)
        twice = rows.groupBy(key).count().where("count > 1").select(key)
        if at.getFileSystem(spark._jsc.hadoopConfiguration()).exists(at):
            held = spark.read.schema(rows.schema).parquet(path).select(key)
            twice = twice.unionByName(rows.select(key).join(held, key, "left_semi"))
        found = [str(r[0]) for r in twice.limit(5).collect()]
        if found:
            raise ValueError(f"requests that the ledger has, or that occur twice: {', '.join(found)}")
    rows.write.mode("append").parquet(path)


def committed(df: DataFrame, path: str) -> DataFrame:
    """df at path, which appears when all of it is there: written beside it and renamed; an existing path is an error."""
    spark = df.sparkSession
    files, at = spark._jvm.org.apache.hadoop.fs, spark._jvm.org.apache.hadoop.fs.Path(path)
    store = at.getFileSystem(spark._jsc.hadoopConfiguration())
    if store.exists(at):
        raise FileExistsError(path)
    df.write.mode("overwrite").parquet(f"{path}.partial")
    if not store.rename(files.Path(f"{path}.partial"), at):
        raise OSError(f"cannot rename {path}.partial")
    return spark.read.schema(df.schema).parquet(path)


_LISTS: dict[tuple, DataFrame] = {}


def cached_list(make, name: str, split: str, spark: SparkSession) -> DataFrame:
    """The listing that make() gives, made once a session and split; a listing with rows of another split is an error."""
    key = (spark.sparkContext.applicationId, name, split)
    if key not in _LISTS:
        made = durable(make(), f"list-{name}")
        if made.where(F.col("split") != split).limit(1).count():
            raise ValueError(f"{name} holds rows of another split than {split}")
        _LISTS[key] = made
    return _LISTS[key]


def tree_facts(spark: SparkSession, path: str, name: Column | None = None) -> DataFrame:
    """name, size, sha256 of each file below a folder."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    return files.select((F.col("path") if name is None else name).alias("name"), F.col("length").alias("size"), F.sha2("content", 256).alias("sha256"))


def folded(facts: DataFrame) -> str:
    """One digest of facts in the order of their names; names, sizes and digests stream to the driver, contents don't."""
    out = hashlib.sha256()
    for r in facts.orderBy("name").toLocalIterator():
        out.update(f"{r['name']}\0{r['size']}\0{r['sha256']}\n".encode())
    return out.hexdigest()


def code_fingerprint(spark: SparkSession, path: str, suffixes: tuple[str, ...] = (".py", ".sh", ".yaml", ".toml"),
    skipped: tuple[str, ...] = ("__pycache__", ".git")) -> str:
    """Of a code tree's source files, by their paths below it."""
    root = path.rstrip("/").removeprefix("file:")
    below = F.regexp_extract("path", rf"{root}/(.*)$", 1)
    facts = tree_facts(spark, path, below)
    source = F.lit(False)
    for s in suffixes:
        source = source | F.col("name").endswith(s)
    for s in skipped:
        source = source & ~F.contains(F.col("name"), F.lit(s))
    return folded(facts.where(source))


def digest_of_lines(df: DataFrame, order: list[str]) -> tuple[int, int, str]:
    """Lines, bytes and SHA-256 of a table's canonical JSON lines in order, streamed."""
    from tessera.sources.records import canonical_lines

    lines = size = 0
    out = hashlib.sha256()
    for line in canonical_lines(df, order):
        raw = f"{line}\n".encode()
        lines, size = lines + 1, size + len(raw)
        out.update(raw)
    return lines, size, out.hexdigest()


def scratch(spark: SparkSession, name: str) -> str:
    """A path of its own in the shared folder."""
    import uuid

    return f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"


JSON_DOCUMENT = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()), T.StructField("lang", T.StringType())])
