"""Reproducible randomness: a draw is a hash of its coordinates, so any partitioning gives the same stream."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

PRIORITY_TAG = "tessera-priority-v1"


def priority(seed: int, cluster: Column, unit: Column, tag: str = PRIORITY_TAG) -> Column:
    """Hash priority of a unit in its cluster, as lower-case hex; hex order is byte order."""
    return F.sha2(F.concat_ws("\0", F.lit(tag), F.lit(str(seed)), cluster.cast("string"), unit.cast("string")), 256)


def shuffle_key(seed: int, key: Column) -> Column:
    return F.sha2(F.concat_ws("|", F.lit(str(seed)), key.cast("string")), 256)


def draw(seed: int, *coordinates: Column, below: Column) -> Column:
    """Whole number in 0..below-1 from 48 bits of a hash of seed and coordinates."""
    text = F.concat_ws("|", F.lit(str(seed)), *[c.cast("string") for c in coordinates])
    return F.pmod(F.conv(F.substr(F.sha2(text, 256), F.lit(1), F.lit(12)), 16, 10).cast("bigint"), below.cast("bigint"))


def environment_seed(*parts: Column) -> Column:
    """Unsigned 32-bit seed: the first eight digest bytes modulo 2**32, so bytes five to eight."""
    return F.conv(F.substr(F.sha2(F.concat_ws("\0", *[p.cast("string") for p in parts]), 256), F.lit(9), F.lit(8)), 16, 10).cast("bigint")
