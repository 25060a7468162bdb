"""What the training-data operators share: word rule, durable folders, small expression helpers."""

from __future__ import annotations

import contextlib
import ctypes

import numpy as np
import pyarrow as pa
from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.session import ship
from tessera.sources.shared import discard, durable, shared_folder

__all__ = ["discard", "durable", "shared_folder"]

#: The white space that separates words, as a Java pattern and as characters.
SPACE_RUN = r"[\x20\x09-\x0D]+"
WORD = r"[^\x20\x09-\x0D]+"
SPACE_CHARS = " \t\n\x0b\x0c\r"


def trim() -> None:
    """Gives memory that earlier groups of this Python worker have freed back to the system."""
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):
        ctypes.CDLL("libc.so.6").malloc_trim(0)


def mixed(x: np.ndarray) -> np.ndarray:
    """A bijective mix of 64-bit words, splitmix64's finaliser."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


#: A column that tells the rows of a written table apart, whatever they hold.
PLACE = "__tessera_place"


def placed(docs: DataFrame) -> DataFrame:
    """docs with each row's file and place in it; a table that isn't read from files is written first."""
    place = F.struct(F.col("_metadata.file_path").alias("file"), F.col("_metadata.row_index").alias("row")).alias(PLACE)
    try:
        return docs.select(*[F.col(f"`{c}`") for c in docs.columns], place)
    except AnalysisException:
        docs = durable(docs, "rows")
        return docs.select("*", place)


def without(docs: DataFrame, gone: DataFrame) -> DataFrame:
    """The rows of a placed table whose places `gone` doesn't hold, with their own columns."""
    whole = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns if c != PLACE]).alias("whole"), F.col(PLACE).alias("place"))
    return whole.join(gone.select(F.col(PLACE).alias("gone")), F.col("place") == F.col("gone"), "left_anti").select("whole.*")


def let(value: Column, body) -> Column:
    """body(value) with value computed once."""
    return F.transform(F.array(value), body)[0]


def crc32(text: Column) -> Column:
    return F.crc32(text.cast("binary"))


def remainder(doc_id: Column, modulus: int) -> Column:
    """The fold of a document: crc32 of its id as text, modulo."""
    return F.pmod(F.crc32(doc_id.cast("string").cast("binary")), F.lit(modulus))


def to_python(df: DataFrame) -> DataFrame:
    """df, on whose executors this package can be imported."""
    ship(df.sparkSession)
    return df


def input_bytes(df: DataFrame) -> int:
    """The input's size by Catalyst, from file sizes; where it knows none, the characters of the text column."""
    size = int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    if size < 1 << 55:
        return size
    return int(df.agg(F.sum(F.octet_length("text"))).first()[0] or 0)


def groups_for(df: DataFrame, bytes_per_group: int, least: int = 8) -> int:
    """How many groups work is dealt into. It sets what moves where, never what comes out."""
    return int(max(least, -(-input_bytes(df) // bytes_per_group)))


def shares(total: int, each: int, least: int = 8) -> int:
    return int(max(least, -(-total // each)))
