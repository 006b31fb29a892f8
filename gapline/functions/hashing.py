"""Stable hashes by SHA-256, alike in every engine."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def stable(text: Column) -> Column:
    """The first 16 hex digits of the SHA-256 as a number."""
    return F.conv(F.substring(F.sha2(text, 256), 1, 16), 16, 10).cast("decimal(20,0)")


def bucket(text: Column, buckets: int) -> Column:
    return remainder(F.sha2(text, 256), buckets)


def remainder(digest: Column, buckets: int) -> Column:
    """The first 16 hex digits of a digest, as a number, modulo ``buckets``, in two halves so that longs hold it."""
    half = lambda at: F.conv(F.substring(digest, at, 8), 16, 10).cast("long")
    return F.pmod(F.pmod(half(1), F.lit(buckets)) * ((1 << 32) % buckets) + half(9), F.lit(buckets)).cast("int")


def sign(text: Column) -> Column:
    """-1 or 1, by the parity of the hash of the text with ":sign" behind it."""
    last = F.substring(F.sha2(F.concat(text, F.lit(":sign")), 256), 16, 1)
    return F.when(last.isin(*"13579bdf"), -1.0).otherwise(1.0)
