"""Sharding by jump consistent hashing, with DataFrame functions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import copies, cut, key_digest, running_totals

#: Jumps tried at most. They number ln(n) on average; 256 are never reached in practice, and reaching them is an error, not a wrong shard.
MAX_JUMPS = 256


def jump_shard(digest: Column, shards: int) -> Column:
    """struct<shard, grown>: the shard of ``digest`` among ``shards``, and among one more.

    ``digest`` is a hex string; its first 16 digits are the 64-bit key.  The
    jump hash draws from a linear congruential generator; decimals hold its
    products exactly, since 2**64 * 2862933555777941757 < 10**38.
    """
    if shards < 1:
        raise ValueError("shards must be positive")
    key = F.conv(F.substring(digest, 1, 16), 16, 10).cast("decimal(20,0)")
    start = F.struct(key.alias("key"), F.lit(-1).cast("long").alias("b"), F.lit(0).cast("long").alias("j"))

    def step(s: Column, _: Column) -> Column:
        key = ((s["key"] * F.lit(2862933555777941757).cast("decimal(19,0)") + F.lit(1).cast("decimal(1,0)")) % F.lit("18446744073709551616").cast("decimal(20,0)")).cast("decimal(20,0)")
        high = F.floor(key / F.lit(8589934592).cast("decimal(10,0)")).cast("double")
        jump = F.floor((s["j"] + 1) * (F.lit(2147483648.0) / (high + 1))).cast("long")
        return F.when(s["j"] >= shards, s).otherwise(F.struct(key.alias("key"), s["j"].alias("b"), jump.alias("j")))

    last = F.aggregate(F.sequence(F.lit(1), F.lit(min(shards, MAX_JUMPS))), start, step)
    if shards > MAX_JUMPS:
        last = F.when(last["j"] >= shards, last).otherwise(F.raise_error(F.lit("jump hash: too many jumps")))
    return F.transform(F.array(last), lambda s: F.struct(s["b"].cast("int").alias("shard"), F.when(s["j"] == shards, shards).otherwise(s["b"]).cast("int").alias("grown")))[0]


def assign_shards(df: DataFrame, shards: int, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Deal rows to ``shards`` shards by ``key``; law ``key``: key and shard count alone decide.

    Returns key, size long (UTF-8 bytes of the text and 16), text_crc32 long,
    law, shard int, slot long (gapless from 0 in each shard), grown_shard int
    (with one more shard: unchanged or the new one).  A null key counts as the
    empty string, a null text as no bytes.  Repeated rows share a shard and
    get slots of their own; they are one row until they have them.  Only narrow
    rows are shuffled, by what they hold and by (shard, 1/4096 of the rows), so
    a shard, a key or a row that stands any number of times is numbered in many
    tasks.
    """
    body = F.coalesce(F.col(text), F.lit(""))
    rows = df.select(
        F.col(key).alias("_key"),
        (F.octet_length(body) + 16).cast("long").alias("size"),
        F.crc32(body).cast("long").alias("text_crc32"),
        key_digest(key).alias("_digest"),
    )
    same = ["_key", "size", "text_crc32", "_digest"]
    rows = cut(rows.groupBy(*same).agg(F.count("*").alias("_n")))
    order = F.md5(F.concat_ws(":", F.coalesce(F.col("_key").cast("string"), F.lit("")), "text_crc32", "size"))
    rows = rows.withColumn("_at", jump_shard(F.col("_digest"), shards)).select(
        "_key", "size", "text_crc32", F.col("_at.shard").alias("shard"), F.col("_at.grown").alias("grown_shard"), order.alias("_order"), F.substring(order, 1, 3).alias("_bucket"), "_n",
    )
    rows = copies(running_totals(rows, ["shard"], "_bucket", ["_order", "_key", "text_crc32", "size"], "_n", "_from"), "_n", "_copy")
    return rows.select(F.col("_key").alias(key), "size", "text_crc32", F.lit("key").alias("law"), "shard", (F.col("_from") + F.col("_copy")).cast("long").alias("slot"), "grown_shard")
