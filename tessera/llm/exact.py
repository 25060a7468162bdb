"""Exact dedup over content-defined chunk recipes.

A text, its white space normalised, is cut by its content: after each three UTF-8 bytes with given remainders, at least
LEAST and at most MOST bytes apart. Nothing but the bytes before a cut decides, so equal passages give equal chunks in any
script and wherever they stand. Chunks are cut once, into a table.

Chunks are deduplicated by content: those that occur more than once get an identifier, in a chunk table with their digest
and their number of occurrences. A text with a chunk of its own has no equal. Of the other texts each becomes its recipe, the
ordered list of its chunks' identifiers, and equal recipes are equal texts. Identifiers are verified: contents are grouped
as they are, not by digest, and each identifier must be met through its digest exactly as often as its content occurs. Whole
texts never move; a different chunk does once for each task that cut it, and after that only identifiers.

Cases: null counts as empty; empty texts are equal to each other, and so are texts of white space only (one space); a null
id comes after all others; of rows that repeat an id and a text one stays; texts of any length are cut into chunks and
compared whole; an empty table gives an empty one; extra columns pass through `stage`, whatever they are called.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import PLACE, SPACE_RUN, discard, durable, placed, without

LEAST, MOST = 512, 8192
#: A chunk ends after three bytes with these (modulus, remainder): one in some 250 to 900 bytes of text, in any script.
CUT = ((7, 4), (9, 1), (5, 2))
#: Parts into which the rows of a frequent chunk or recipe are dealt when they are joined.
SALT = 16


def normalised(text: Column) -> Column:
    return F.regexp_replace(F.coalesce(text, F.lit("")), SPACE_RUN, " ")


def chunks(norm: Column, least: int = LEAST, most: int = MOST) -> Column:
    """The text's chunks, each byte as the character of its number."""
    one = lambda modulus, rest: "[" + "".join(rf"\x{b:02X}" for b in range(rest, 256, modulus)) + "]"
    mark = "".join(one(*c) for c in CUT)
    return F.regexp_extract_all(F.decode(F.encode(norm, "UTF-8"), "ISO-8859-1"), F.lit(rf"(?s).{{{least},{most}}}?{mark}|.{{1,{most}}}"), F.lit(0))


def cut(docs: DataFrame, text: str = "text") -> DataFrame:
    """docs' other columns with a row number, the text's SHA-256, and its chunks with their digests: written."""
    keep = [F.col(f"`{c}`") for c in docs.columns if c != text]
    pieces = F.transform(chunks(F.col("__norm")), lambda c: F.struct(F.unhex(F.sha2(c, 256)).alias("digest"), c.alias("content")))
    made = docs.select(*keep, normalised(F.col(f"`{text}`")).alias("__norm"))
    return durable(made.select(*keep, F.monotonically_increasing_id().alias("row"), F.sha2("__norm", 256).alias("text_sha256"), pieces.alias("pieces")), "cut")


def chunk_table(made: DataFrame) -> DataFrame:
    """id, digest, n of each content that occurs more than once; an identifier is a row of this table: written."""
    contents = made.select(F.explode("pieces.content").alias("content")).groupBy("content").agg(F.count("*").alias("n")).where("n > 1")
    return durable(contents.select(F.monotonically_increasing_id().alias("id"), F.unhex(F.sha2("content", 256)).alias("digest"), "n"), "chunk-table")


def salted(df: DataFrame) -> DataFrame:
    return df.select("*", F.explode(F.sequence(F.lit(0), F.lit(SALT - 1))).alias("salt"))


def recipes(made: DataFrame) -> DataFrame:
    """row, recipe of the rows all of whose chunks occur more than once."""
    table = chunk_table(made)
    at = F.posexplode("pieces.digest").alias("position", "digest")
    used = made.select("row", F.size("pieces").alias("size"), at).withColumn("salt", F.pmod("row", F.lit(SALT)).cast("int"))
    met = durable(used.join(salted(table), ["digest", "salt"]).select("row", "size", "position", "id"), "met")
    wrong = met.groupBy("id").agg(F.count("*").alias("met")).join(table, "id").where("met <> n")
    if wrong.limit(1).count():
        raise ValueError("two chunks of different content share a SHA-256 digest; identifiers can't be trusted")
    listed = met.groupBy("row").agg(F.min("size").alias("size"),
        F.sort_array(F.collect_list(F.struct("position", "id"))).alias("list")).where(F.size("list") == F.col("size"))
    empty = made.where(F.size("pieces") == 0).select("row", F.array().cast("array<long>").alias("recipe"))
    out = durable(listed.select("row", F.col("list.id").alias("recipe")).unionByName(empty), "recipes")
    discard(table, met)
    return out


def dedup(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, keep_id, group_size, kept, text_sha256 and, where docs has one, the place of each row."""
    carried = [F.col(PLACE)] if PLACE in docs.columns else []
    made = cut(docs.select(F.col(f"`{doc_id}`").alias("doc_id"), F.col(f"`{text}`").alias("text"), *carried))
    found = recipes(made)
    ids = made.select("row", "doc_id")
    first = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "row")
    known = found.join(ids, "row")
    groups = known.groupBy("recipe").agg(F.min(first).alias("first"), F.count("*").alias("group_size")).where("group_size > 1")
    dealt = found.withColumn("salt", F.pmod("row", F.lit(SALT)).cast("int")).join(salted(groups), ["recipe", "salt"])
    several = dealt.select("row", "first", "group_size")
    rows = made.drop("pieces").join(several, "row", "left")
    alone = F.col("first").isNull()
    out = rows.select(
        "doc_id",
        F.when(alone, F.col("doc_id")).otherwise(F.col("first.doc_id")).alias("keep_id"),
        F.coalesce("group_size", F.lit(1)).cast("long").alias("group_size"),
        (alone | (F.col("first.row") == F.col("row"))).alias("kept"),
        "text_sha256",
        *carried,
    )
    out = durable(out, "kept")
    discard(made, found)
    return out


def op8_exact_dedup(spark, sf_dir: str) -> DataFrame:
    return dedup(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"))


def stage(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The rows that stay; the places of the others move to the join."""
    docs = placed(docs)
    return without(docs, dedup(docs.select("doc_id", "text", PLACE)).where("not kept").select(PLACE))
