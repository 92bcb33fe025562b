"""Deterministic draws and order-free fingerprints."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def hash_rank(seed, *keys) -> Column:
    """Text that orders rows in a reproducible random order."""
    return F.md5(F.concat_ws("|", F.lit(str(seed)), *[k.cast("string") for k in keys]))


def hex_number(digest: Column, start: int, digits: int = 8) -> Column:
    return F.conv(F.substring(digest, start, digits), 16, 10).cast("long")


def draw(seed, *keys) -> Column:
    """Uniform number in [0, 1) fixed by seed and keys."""
    return hex_number(hash_rank(seed, *keys), 1) / F.lit(4294967296.0)


def row_digest(columns: list[Column]) -> Column:
    """Digest of one row; null and empty text differ, and so do moved field borders."""
    fields = [F.coalesce(F.concat(F.length(c.cast("string")).cast("string"), F.lit(":"), c.cast("string")), F.lit("-")) for c in columns]
    return F.md5(F.concat_ws("|", *fields))


def fingerprint(digest: Column) -> Column:
    """Aggregate: digest of a multiset of rows from partial sums only.

    Row order does not matter and nothing is collected, so a table of any size is
    combined map-side into five numbers."""
    parts = [F.sum(hex_number(digest, 1 + 8 * i).cast("decimal(38,0)")).cast("string") for i in range(4)]
    return F.md5(F.concat_ws("-", F.count(F.lit(1)).cast("string"), *parts))
