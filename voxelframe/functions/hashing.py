"""Stable hashes: split buckets, file digests, content keys and identities."""

from __future__ import annotations

import hashlib
import json
from collections.abc import Sequence
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def stable_bucket(value: Column, seed: int = 0) -> Column:
    """First 8 bytes of SHA-256(seed as 8 little-endian bytes, text), read little-endian.

    As 16 hexadecimal digits, whose order as text is the order of the numbers.
    """
    digest = F.sha2(F.concat(F.unhex(F.lit(seed.to_bytes(8, "little").hex())), F.encode(value.cast("string"), "UTF-8")), 256)
    return F.concat(*[F.substring(digest, 15 - 2 * i, 2) for i in range(8)])


def bucket_number(bucket: Column) -> Column:
    return F.conv(bucket, 16, 10).cast("decimal(20,0)")


def sha256(content: Column) -> Column:
    return F.sha2(content, 256)


def stable_hash(config: Any) -> str:
    """SHA-256 of a configuration as JSON with sorted keys."""
    return hashlib.sha256(json.dumps(config, sort_keys=True, separators=(",", ":")).encode()).hexdigest()


def cache_key(*parts: Column) -> Column:
    """SHA-256 of the parts, with a NUL between them; a null part counts as empty."""
    return F.sha2(F.concat_ws("\x00", *[F.coalesce(p.cast("string"), F.lit("")) for p in parts]), 256)


def content_key(dataset: Column, split: Column, size: Column, kind: Column, digest: Column, digits: int = 16) -> Column:
    return F.concat(dataset, F.lit("-"), split, F.lit("-"), size.cast("string"), F.lit("-"), kind, F.lit("-"), F.substring(digest, 1, digits))


def multiset_hash(df: DataFrame, value: str, by: Sequence[str]) -> DataFrame:
    """A digest of each group's values that does not depend on their order.

    Values are hashed on their own and the hashes added up, so that no group
    is collected: the sum of 128-bit halves, with the count.
    """
    half = lambda i: F.conv(F.substring(F.sha2(F.col(value).cast("string"), 256), i, 15), 16, 10).cast("decimal(38,0)")
    return df.groupBy(*by).agg(F.count(value).alias("n"), F.sum(half(1)).alias("sum_a"), F.sum(half(16)).alias("sum_b"))


def ordered_ids_hash(ids: Column) -> Column:
    return F.sha2(F.to_json(ids), 256)
