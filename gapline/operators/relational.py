"""Plan shapes that many queries share: latest rows, top rows of groups, pages, merges, quarantine."""

from __future__ import annotations

import tempfile
import uuid
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: Tables up to this many bytes by Spark's own estimate may be broadcast. The estimate starts from compressed files and does not grow through
#: ``explode``, so that a table may be several times as large in memory: the bound is low for that.
BROADCAST_BYTES = 8 << 20


def broadcast_if_small(df: DataFrame, limit: int = BROADCAST_BYTES) -> DataFrame:
    """A broadcast hint for ``df`` if its plan's size estimate allows it; else Spark's own choice, a shuffle join for large tables."""
    estimate = int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    return F.broadcast(df) if estimate <= limit else df


def topk_per_group(df: DataFrame, keys: list[str], order: list[Column], k: int = 1, rank: str | None = None) -> DataFrame:
    """The first ``k`` rows of each group; the filter on row_number lets Spark cut groups before the shuffle."""
    ranked = df.withColumn(rank or "_rank", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).filter(F.col(rank or "_rank") <= k)
    return ranked if rank else ranked.drop("_rank")


def latest_per_key(df: DataFrame, keys: list[str], order: list[str], columns: list[str]) -> DataFrame:
    """The row with the greatest ``order`` for each key, by an aggregate that is combined before the shuffle; ties go to the greatest columns."""
    newest = F.max(F.struct(*order, *columns)).alias("_row")
    return df.groupBy(*keys).agg(newest).select(*keys, *[F.col(f"_row.{c}").alias(c) for c in dict.fromkeys([*order, *columns])])


def page(df: DataFrame, order: list[Column], number: int, size: int) -> DataFrame:
    """Rows of one page, from page 1; planned as one top-k with an offset."""
    if number < 1 or not 1 <= size <= 500:
        raise ValueError("a page has a number from 1 and a size from 1 to 500")
    return df.orderBy(*order).offset((number - 1) * size).limit(size)


def page_counts(df: DataFrame, size: int) -> DataFrame:
    """total and total_pages of ``df``."""
    return df.agg(F.count("*").alias("total")).select("total", F.ceil(F.col("total") / size).cast("long").alias("total_pages"))


def merge_latest(old: DataFrame, new: DataFrame, keys: list[str], order: Column | None = None, rules: dict[str, Column] | None = None) -> DataFrame:
    """Upsert: keys of either side; the new row's columns where there is one.

    ``rules`` replace a column by an expression over ``old.*`` and ``new.*``
    for keys on both sides.  Rows of ``new`` that share a key are first cut to
    the one that comes first by ``order``.
    """
    new = new if order is None else topk_per_group(new, keys, [order])
    rest = [c for c in old.columns if c not in keys]
    a = old.select(*keys, F.struct(*rest).alias("old"), F.lit(True).alias("_in_old"))
    b = new.select(*keys, F.struct(*rest).alias("new"), F.lit(True).alias("_in_new"))
    both = a.join(b, keys, "full")
    rules = rules or {}
    one = lambda c: F.when(F.col("_in_new").isNull(), F.col(f"old.{c}")).when(F.col("_in_old").isNull(), F.col(f"new.{c}")).otherwise(rules.get(c, F.col(f"new.{c}"))).alias(c)
    return both.select(*keys, *[one(c) for c in rest])


def insert_absent(old: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """``old`` and those rows of ``new`` whose keys it lacks."""
    return old.unionByName(new.join(old.select(*keys), keys, "left_anti"))


def changed(old: DataFrame, new: DataFrame, keys: list[str], columns: list[str]) -> DataFrame:
    """Rows of ``new`` that differ from ``old`` in any of ``columns``, nulls compared as values, or that it lacks."""
    was = old.select(*keys, *[F.col(c).alias(f"_old_{c}") for c in columns], F.lit(True).alias("_known"))
    differs = reduce(lambda a, b: a | b, [~F.col(c).eqNullSafe(F.col(f"_old_{c}")) for c in columns])
    return new.join(was, keys, "left").filter(F.col("_known").isNull() | differs).select(*new.columns)


def split_quarantine(df: DataFrame, reason: Column, key: str, seen_at: str) -> tuple[DataFrame, DataFrame]:
    """Rows without a reason, and per key and reason of the others: seen_count, first_seen, last_seen."""
    marked = df.withColumn("reason", reason)
    bad = marked.filter(F.col("reason").isNotNull()).groupBy(key, "reason").agg(F.count("*").alias("seen_count"), F.min(seen_at).alias("first_seen"), F.max(seen_at).alias("last_seen"))
    return marked.filter(F.col("reason").isNull()).drop("reason"), bad


def canonical(df: DataFrame, aliases: DataFrame, column: str) -> DataFrame:
    """Replace ids of merged entities, from ``aliases`` (duplicate, canonical)."""
    return df.join(broadcast_if_small(aliases.select(F.col("duplicate").alias(column), "canonical")), column, "left").withColumn(column, F.coalesce("canonical", column)).drop("canonical")


def replace_partitions(df: DataFrame, path: str, by: list[str]) -> None:
    """Write ``df``, replacing just the partitions that it has rows in."""
    df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(*by).parquet(path)


def overlap_join(left: DataFrame, right: DataFrame, left_key: str, right_key: str, left_array: str, right_array: str) -> DataFrame:
    """left_key, right_key, shared: the pairs whose arrays share a value, by an equi join on the values instead of testing all pairs."""
    a = left.select(left_key, F.explode(F.array_distinct(left_array)).alias("_value"))
    b = right.select(right_key, F.explode(F.array_distinct(right_array)).alias("_value"))
    return a.join(b, "_value").groupBy(left_key, right_key).agg(F.count("*").alias("shared"))


def scratch_dir(spark: SparkSession, name: str) -> str:
    """A new folder below ``spark.checkpoint.dir``, which driver and executors share; on one machine, where that is unset, a local one."""
    sc = spark.sparkContext
    shared = sc.getConf().get("spark.checkpoint.dir")
    if shared is None:
        if not sc.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        shared = f"file://{tempfile.mkdtemp(prefix='gapline-')}"
    return f"{shared.rstrip('/')}/{name}-{uuid.uuid4().hex}"


def cleared(spark: SparkSession, path: str) -> None:
    """Replace a table by none of its rows."""
    spark.createDataFrame([], spark.read.parquet(path).schema).write.mode("overwrite").parquet(path)


def saved(df: DataFrame, name: str) -> DataFrame:
    """``df`` written once as a table in the shared folder and read from there, for plans that use it several times."""
    path = scratch_dir(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.parquet(path)
