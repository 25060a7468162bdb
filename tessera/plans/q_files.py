"""Queries: scans, sinks, fingerprints and digests of files, over whole tables written to the shared folder and read again."""

from __future__ import annotations

from pyspark.sql import functions as F

from tessera.functions import prompts as P
from tessera.plans import views as V
from tessera.plans.registry import query
from tessera.sources import files, records


@query("SELECT doc_id, lang, sha256(coalesce(text, '')) text_sha256 FROM documents")
def s1_jsonl_scan(spark, d):
    """Documents as JSON lines, read again with a schema that a malformed line would break."""
    path = files.scratch(spark, "documents") + ".jsonl"
    records.write_table(V._t(spark, d, "documents").select("doc_id", "text", "lang"), path)
    return records.read_table(spark, path, files.JSON_DOCUMENT).select("doc_id", "lang", F.sha2(F.coalesce("text", F.lit("")), 256).alias("text_sha256"))


@query("""SELECT sha256('{"brand":"' || p_brand || '","key":' || p_partkey || ',"name":"' || p_name || '","size":' || CASE WHEN p_size > 25 THEN p_size::VARCHAR ELSE 'null' END || '}') line_sha256
 FROM part""")
def s2_jsonl_sink(spark, d):
    """Lines as they stand in the file: keys in order, nulls written."""
    path = files.scratch(spark, "parts") + ".jsonl"
    rows = V._t(spark, d, "part").select(F.col("p_brand").alias("brand"), F.col("p_partkey").alias("key"), F.col("p_name").alias("name"),
        F.when(F.col("p_size") > 25, F.col("p_size")).alias("size"))
    records.write_table(rows, path)
    return spark.read.text(path).select(F.sha2("value", 256).alias("line_sha256"))


@query("SELECT 'parquet' kind, count(*) n, sum(doc_id)::BIGINT ids FROM documents UNION ALL SELECT 'jsonl', count(*), sum(doc_id)::BIGINT FROM documents")
def s3_sink_by_suffix(spark, d):
    """One table by both suffixes."""
    docs = V._t(spark, d, "documents").select("doc_id", "text", "lang")
    out = []
    for kind in ("parquet", "jsonl"):
        path = f"{files.scratch(spark, 'sink')}.{kind}"
        records.write_table(docs, path)
        out.append(records.read_table(spark, path, files.JSON_DOCUMENT).agg(F.count("*").alias("n"),
            F.sum("doc_id").alias("ids")).select(F.lit(kind).alias("kind"), "n", "ids"))
    return out[0].unionByName(out[1])


@query("SELECT o_orderkey, o_custkey FROM orders")
def s4_several_files(spark, d):
    """A table in three files, one scan."""
    orders, paths = V._t(spark, d, "orders").select("o_orderkey", "o_custkey"), []
    for k in range(3):
        paths.append(f"{files.scratch(spark, 'orders')}.parquet")
        records.write_table(orders.where(F.col("o_orderkey") % 3 == k), paths[-1])
    return records.read_table(spark, paths)


@query("SELECT source, count(*) n, sum(n_chars)::BIGINT chars FROM documents GROUP BY 1")
def s5_table_by_suffix(spark, d):
    return records.read_table(spark, f"{d}/documents.parquet").groupBy("source").agg(F.count("*").alias("n"), F.sum("n_chars").alias("chars"))


@query("SELECT event_id, sha256(props) hash FROM events")
def s8_verified_scan(spark, d):
    """Every event's recorded hash is computed again on reading; one that differs would end the job."""
    path = f"{files.scratch(spark, 'events')}.parquet"
    records.write_table(V._t(spark, d, "events").select("event_id", "props", F.sha2("props", 256).alias("hash")), path)
    return records.verified(records.read_table(spark, path), "hash", F.sha2("props", 256)).select("event_id", "hash")


@query("SELECT n_name, 'data.region' path, n_regionkey::VARCHAR \"value\" FROM nation UNION ALL SELECT n_name, 'name', n_name FROM nation UNION ALL "
    "SELECT n_name, 'data.steps', '[1,2]' FROM nation")
def s10_configurations(spark, d):
    """Nations as configuration files, a file each, as dotted paths."""
    from tessera.operators.audit import flattened

    path = files.scratch(spark, "configs")
    text = F.concat(F.lit('{"name": "'), "n_name", F.lit('", "data": {"region": '), F.col("n_regionkey").cast("string"), F.lit(', "steps": [1, 2]}}'))
    V._t(spark, d, "nation").select(F.col("n_nationkey").alias("k"), text.alias("value")).repartition("k").write.partitionBy("k").text(path)
    made = files.configs(spark, path).withColumn("n_name", F.get_json_object("config", "$.name"))
    return flattened(made, "n_name", "config").select("n_name", "path", "value")


@query("""WITH f AS (SELECT p_partkey k, '/data/' || replace(p_type, ' ', '_') || '-' || p_brand || '/trial_' || p_size || CASE WHEN p_partkey % 5 = 0 THEN '/sub' ELSE '' END || '/game.' || CASE WHEN p_partkey % 2 = 0 THEN 'z8' ELSE 'json' END path FROM part)
 SELECT regexp_extract(path, '([^/]+)/([^/]+)/game[.][^/.]+$', 1) task, regexp_extract(path, '([^/]+)/([^/]+)/game[.][^/.]+$', 2) trial, path FROM f
 WHERE NOT contains(regexp_extract(path, '([^/]+)/([^/]+)/game[.][^/.]+$', 1), 'STEEL') AND NOT contains(regexp_extract(path, '([^/]+)/([^/]+)/game[.][^/.]+$', 1), 'Brand#1')""")
def s11_episode_listing(spark, d):
    p = V._t(spark, d, "part")
    path = F.concat(F.lit("/data/"), F.replace("p_type", F.lit(" "), F.lit("_")), F.lit("-"), "p_brand", F.lit("/trial_"),
        F.col("p_size").cast("string"), F.when(F.col("p_partkey") % 5 == 0, "/sub").otherwise(""), F.lit("/game."),
            F.when(F.col("p_partkey") % 2 == 0, "z8").otherwise("json"))
    return files.episodes(p.select(path.alias("path")), skipped=("STEEL", "Brand#1"))


@query("SELECT event_type status, count(*) n, count(*) FILTER (event_id % 3 = 2) last_batch FROM events GROUP BY 1")
def s13_ledger_sink(spark, d):
    """Requests in three batches, appended one after another, errors too."""
    path = files.scratch(spark, "ledger")
    rows = V._t(spark, d, "events").select(F.col("event_id").alias("request_id"), F.col("event_type").alias("status"),
        (F.col("event_id") % 3).cast("int").alias("batch"))
    for k in range(3):
        files.append_ledger(rows.where(F.col("batch") == k), path, "request_id")
    return spark.read.schema(rows.schema).parquet(path).groupBy("status").agg(F.count("*").alias("n"), F.count_if(F.col("batch") == 2).alias("last_batch"))


@query("SELECT conv_id, count(*) turns FROM conversations GROUP BY 1")
def s14_commit(spark, d):
    """Turns written beside the place where they are wanted, and moved there when complete."""
    turns = V._t(spark, d, "conversations").select("conv_id", "turn")
    return files.committed(turns, files.scratch(spark, "turns")).groupBy("conv_id").agg(F.count("*").alias("turns"))


@query("SELECT DISTINCT o_custkey cluster_id, 'train' split FROM orders WHERE o_custkey % 10 <> 0")
def s19_cached_list(spark, d):
    make = lambda: V._t(spark, d, "orders").where("o_custkey % 10 <> 0").select(F.col("o_custkey").alias("cluster_id"),
        F.lit("train").alias("split")).distinct()
    files.cached_list(make, d, "train", spark)
    return files.cached_list(make, d, "train", spark)


@query("""WITH f AS (SELECT 'k=' || n_nationkey n, n_name || chr(10) c FROM nation)
 SELECT count(*) files, sum(length(c))::BIGINT bytes, sha256(string_agg(n || chr(0) || length(c) || chr(0) || sha256(c) || chr(10), ''
 ORDER BY n)) digest FROM f""")
def p3_tree_fingerprint(spark, d):
    """A folder with a file for each nation: relative names, sizes and content hashes, folded in order."""
    path = files.scratch(spark, "tree")
    V._t(spark, d, "nation").select(F.col("n_nationkey").alias("k"), F.col("n_name").alias("value")).repartition("k").write.partitionBy("k").text(path)
    facts = files.tree_facts(spark, path, F.regexp_extract("path", r"/(k=\d+)/", 1)).where("name <> ''")
    return facts.agg(F.count("*").alias("files"), F.sum("size").alias("bytes")).withColumn("digest", F.lit(files.folded(facts)))


@query("""WITH l AS (SELECT s_suppkey k, '{"k":' || s_suppkey || ',"nation":' || s_nationkey || '}' || chr(10) l FROM supplier)
 SELECT count(*) lines, sum(length(l))::BIGINT bytes, sha256(string_agg(l, '' ORDER BY k)) digest FROM l""")
def p26_canonical_digest(spark, d):
    rows = V._t(spark, d, "supplier").select(F.col("s_suppkey").alias("k"), F.col("s_nationkey").alias("nation"))
    lines, size, digest = files.digest_of_lines(rows, ["k"])
    return spark.range(1).select(F.lit(lines).cast("long").alias("lines"), F.lit(size).cast("long").alias("bytes"), F.lit(digest).alias("digest"))


HEAD, FORM = "chr(10) || 'Here are examples:' || chr(10)", "chr(10) || 'Respond with exactly the next action on a single line, in the form ''Action: <command>''.' || chr(10)"


@query(f"""SELECT r_name, sha256('Act.' || {HEAD} || (SELECT string_agg(n_name || chr(10), '' ORDER BY n_name) FROM nation
 WHERE n_regionkey = r_regionkey) || {FORM}) prompt_sha256 FROM region""")
def p11_reference_prompt(spark, d):
    """A prompt for each region with its nations as worked examples."""
    n = V._t(spark, d, "nation").groupBy(F.col("n_regionkey").alias("r_regionkey")).agg(F.sort_array(F.collect_list("n_name")).alias("examples"))
    regions = [(r["r_name"], r["examples"]) for r in V._t(spark, d, "region").join(n, "r_regionkey").toLocalIterator()]  # five rows
    prompts = spark.createDataFrame([(name, P.reference_prompt("Act.", examples)) for name, examples in regions], "r_name string, prompt string")
    return prompts.select("r_name", F.sha2("prompt", 256).alias("prompt_sha256"))


@query("SELECT p_partkey, CASE p_size % 3 WHEN 0 THEN 'Be brief.' WHEN 1 THEN 'Be exact.' END prompt FROM part")
def p12_prompt_version(spark, d):
    """Prompts by the name of their version; an unknown name has none."""
    return V._t(spark, d, "part").select("p_partkey",
        P.prompt_of({"v0": "Be brief.", "v1": "Be exact."}, F.concat(F.lit("v"), (F.col("p_size") % 3).cast("string"))).alias("prompt"))


@query("""WITH a AS (SELECT o_custkey k, o_orderstatus s FROM orders),
 b AS (SELECT o_custkey k, CASE WHEN o_totalprice > 150000 THEN 'F' ELSE o_orderstatus END s FROM orders)
 SELECT (SELECT count(*) FROM (SELECT * FROM a EXCEPT ALL SELECT * FROM b)) missing, (SELECT count(*)
 FROM (SELECT * FROM b EXCEPT ALL SELECT * FROM a)) extra""")
def u6_set_equality(spark, d):
    """Two tables as sets with repeats: what each lacks of the other, nothing where they are equal."""
    from tessera.operators.single import with_values

    a = V._t(spark, d, "orders").select(F.col("o_custkey").alias("k"), F.col("o_orderstatus").alias("s"))
    b = V._t(spark, d, "orders").select(F.col("o_custkey").alias("k"), F.when(F.col("o_totalprice") > 150000, "F").otherwise(F.col("o_orderstatus")).alias("s"))
    return with_values(a.exceptAll(b).agg(F.count("*").alias("missing")), b.exceptAll(a).agg(F.count("*").alias("extra")))
