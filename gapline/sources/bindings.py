"""The driver's tables in the roles of the domain: reviews, user scores, items, activity samples, articles.

Each binding is a projection over Parquet, so that filters and column
selections of what is built on it reach the scan.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def reviews(spark: SparkSession, sf_dir: str) -> DataFrame:
    """critic, outlet (nullable), item, score 0-100 (nullable), published_at, review_id (not unique in the test tables)."""
    lines, orders = table(spark, sf_dir, "lineitem"), table(spark, sf_dir, "orders")
    joined = lines.join(orders.select("o_orderkey", "o_custkey"), lines.l_orderkey == orders.o_orderkey)
    return joined.select(
        F.col("o_custkey").alias("critic"), F.when(F.col("l_linenumber") % 7 != 0, F.col("l_suppkey")).alias("outlet"), F.col("l_partkey").alias("item"),
        F.when((F.col("l_suppkey") + F.col("l_linenumber")) % 19 != 0, F.col("l_quantity") * 2).alias("score"),
        F.col("l_shipdate").alias("published_at"), (F.col("l_orderkey") * 8 + F.col("l_linenumber")).alias("review_id"),
    )


def observations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """obs_id, user_id, source (a, b), score, sample_size (nullable), observed_at: appended user-score observations."""
    events = table(spark, sf_dir, "events").filter(F.col("event_type").isin("view", "purchase"))
    return events.select(
        F.col("event_id").alias("obs_id"), "user_id", F.when(F.col("event_type") == "view", "a").otherwise("b").alias("source"), F.least("value", F.lit(100.0)).alias("score"),
        F.when(F.col("event_id") % 11 != 0, F.col("event_id") % 100).alias("sample_size"), F.col("ts").alias("observed_at"),
    )


def items(spark: SparkSession, sf_dir: str) -> DataFrame:
    part = table(spark, sf_dir, "part")
    released = F.when(F.col("p_partkey") % 13 != 0, F.date_add(F.lit("1995-06-01").cast("date"), F.col("p_size") * 30))
    return part.select(F.col("p_partkey").alias("item"), F.col("p_name").alias("title"), F.col("p_brand").alias("brand"), F.col("p_type").alias("type"), F.col("p_size").alias("size"), F.col("p_retailprice").alias("price"), released.alias("released"))


def user_of(item: str = "item"):
    """Which user-score subject stands in for an item."""
    return F.col(item) % 150


def activity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """item, sample_id, sampled_at, players: with zeros strewn in."""
    events = table(spark, sf_dir, "events")
    return events.select(F.col("user_id").alias("item"), F.col("event_id").alias("sample_id"), F.col("ts").alias("sampled_at"), F.when(F.col("event_id") % 37 == 0, F.lit(0)).otherwise(F.round(F.col("value") * 100).cast("long")).alias("players"))


def articles(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    ago = F.make_dt_interval(hours=(F.col("doc_id") % 97).cast("int"))
    return docs.select(
        F.col("doc_id").alias("article"), "source", "text", F.split_part("text", F.lit("\n"), F.lit(1)).alias("headline"),
        F.when(F.col("doc_id") % 3 == 0, F.col("doc_id") % 20).alias("item"), (F.lit("2024-03-01 00:00:00").cast("timestamp_ntz") - ago).alias("published_at"),
    )
