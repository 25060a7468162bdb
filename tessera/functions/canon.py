"""Canonical identities of records."""

from __future__ import annotations

import hashlib
import json

from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessera.session import ship


def record_hash(**fields: Column) -> Column:
    """sha256 of the compact JSON of fields in name order.

    For text, whole numbers, arrays and structs without nulls; to_json drops nulls and prints doubles in its own way,
    so records with either go through `any_record_hash`.
    """
    return F.sha2(F.to_json(F.struct(*[fields[k].alias(k) for k in sorted(fields)])), 256)


def canonical_json(value) -> str:
    """Sorted keys, no spaces, text as it is, nulls kept; NaN is an error."""
    return json.dumps(value, sort_keys=True, separators=(",", ":"), ensure_ascii=False, allow_nan=False)


def text_sha256(text: Column) -> Column:
    return F.sha2(text, 256)


def any_record_hash(json_text: Column) -> Column:
    """sha256 of the canonical form of JSON text with nulls, floats and control characters, by Arrow batches."""

    ship(SparkSession.active())

    @F.pandas_udf(T.StringType())
    def canonical(texts):
        return texts.map(lambda t: None if t is None else hashlib.sha256(canonical_json(json.loads(t)).encode()).hexdigest())

    return canonical(json_text)


def without_paths(value, dropped=("path", "resolved_path", "value")):
    """A nested value without the keys that depend on where files lie."""
    if isinstance(value, dict):
        return {k: without_paths(v, dropped) for k, v in value.items() if k not in dropped}
    return [without_paths(v, dropped) for v in value] if isinstance(value, list) else value


def record_id(namespace: Column, state: Column, sample: Column) -> Column:
    """namespace:state:sample, with an empty part for what is null."""
    return F.concat_ws(":", *[F.coalesce(c.cast("string"), F.lit("")) for c in (namespace, state, sample)])
