"""Disparity: how far critics' scores are from the users', by review, entity and day.

Scores and their differences are held as whole thousandths.  Sums of them are
exact, so no result depends on the order in which rows are added.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .relational import broadcast_if_small, latest_per_key

#: The least sample sizes of the two sources.
MIN_SAMPLE_A, MIN_SAMPLE_B = 50, 20
#: Fixed value: reviews that a binary profile has at least.
MIN_BINARY = 10
#: What a leaderboard asks for.
MIN_BOARD_REVIEWS, MIN_BOARD_SPREAD = 10, 10


def thousandths(score: Column) -> Column:
    return F.round(score * 1000).cast("long")


def latest_scores(observations: DataFrame, subject: str = "user_id") -> DataFrame:
    """subject, source, observed_at, obs_id, score, sample_size: the newest observation of each subject and source."""
    return latest_per_key(observations, [subject, "source"], ["observed_at", "obs_id"], ["score", "sample_size"])


def qualifying_scores(latest: DataFrame, subject: str = "user_id") -> DataFrame:
    """subject, score_a, score_b.  Only the newest observation counts, and if its sample is too small there is no score.

    An unknown sample size disqualifies source a but not source b.
    """
    a = (F.col("source") == "a") & (F.coalesce("sample_size", F.lit(0)) >= MIN_SAMPLE_A)
    b = (F.col("source") == "b") & (F.col("sample_size").isNull() | (F.col("sample_size") >= MIN_SAMPLE_B))
    return latest.groupBy(subject).agg(F.max(F.when(a, F.col("score"))).alias("score_a"), F.max(F.when(b, F.col("score"))).alias("score_b"))


def combined(d_a: Column, d_b: Column) -> Column:
    """The mean of the differences there are."""
    return F.coalesce(((d_a + d_b) / 2).cast("long"), d_a, d_b)


def review_disparity(reviews: DataFrame, scores: DataFrame, subject: Column, key: str = "user_id") -> DataFrame:
    """``reviews`` with a score, and s, d_a, d_b, d in thousandths; null where users gave none.

    ``scores`` has a row per subject and is broadcast if its size is bounded low.
    """
    scored = reviews.filter(F.col("score").isNotNull())
    joined = scored.join(broadcast_if_small(scores), subject == scores[key], "left")
    s = thousandths(F.col("score"))
    with_d = joined.withColumns({"s": s, "d_a": s - thousandths(F.col("score_a")), "d_b": s - thousandths(F.col("score_b"))})
    return with_d.withColumn("d", combined(F.col("d_a"), F.col("d_b"))).select(*[c for c in reviews.columns if c != "score"], "s", "d_a", "d_b", "d")


def mean(column: str) -> Column:
    return F.try_divide(F.sum(column).cast("double"), F.count(column)) / 1000


def spread(column: str) -> Column:
    """Sample standard deviation from exact sums; null for fewer than two.

    Squares of thousandths go to 1e10 and more, so a long would overflow near
    a billion rows: their upper and lower bits are added up apart.
    """
    square = F.col(column) * F.col(column)
    n, total = F.count(column), F.sum(column).cast("double")
    squares = F.sum(F.shiftright(square, 20)).cast("double") * (1 << 20) + F.sum(square.bitwiseAND(F.lit((1 << 20) - 1))).cast("double")
    return F.when(n > 1, F.round(F.sqrt(F.greatest(F.lit(0.0), (squares - total * total / n) / (n - 1))) / 1000, 6))


def entity_stats(rows: DataFrame, *by: str) -> DataFrame:
    """Per entity: n_reviews, avg_a, avg_b, avg_d, std_d, min_d, max_d; entities that are null are left out."""
    some = rows
    for c in by:
        some = some.filter(F.col(c).isNotNull())
    return some.groupBy(*by).agg(F.count("*").alias("n_reviews"), mean("d_a").alias("avg_a"), mean("d_b").alias("avg_b"), mean("d").alias("avg_d"), spread("d").alias("std_d"), (F.min("d") / 1000).alias("min_d"), (F.max("d") / 1000).alias("max_d"))


def score_profile(rows: DataFrame, *by: str) -> DataFrame:
    """Per entity: n_reviews, score_spread (0 for one review), is_binary (at least MIN_BINARY reviews, all 0 or 100)."""
    binary = (F.count("*") >= MIN_BINARY) & F.bool_and(F.col("s").isin(0, 100000))
    return rows.groupBy(*by).agg(F.count("*").alias("n_reviews"), F.coalesce(spread("s"), F.lit(0.0)).alias("score_spread"), binary.alias("is_binary"))


def rollups(rows: DataFrame, critic: str = "critic", outlet: str = "outlet", item: str = "item") -> DataFrame:
    """kind, id, second_id and the statistics of critics, outlets, items and critic-outlet pairs, from one scan by grouping sets."""
    sets = [[F.col(critic)], [F.col(outlet)], [F.col(item)], [F.col(critic), F.col(outlet)]]
    found = rows.groupingSets(sets, critic, outlet, item).agg(
        F.grouping_id().alias("_set"), F.count("*").alias("n_reviews"), mean("d_a").alias("avg_a"), mean("d_b").alias("avg_b"), mean("d").alias("avg_d"), spread("d").alias("std_d"), (F.min("d") / 1000).alias("min_d"), (F.max("d") / 1000).alias("max_d"),
    )
    kind = F.when(F.col("_set") == 3, "critic").when(F.col("_set") == 5, "outlet").when(F.col("_set") == 6, "item").otherwise("pair")
    first = F.when(F.col("_set") == 5, F.col(outlet)).when(F.col("_set") == 6, F.col(item)).otherwise(F.col(critic))
    named = found.withColumns({"kind": kind, "id": first.cast("long"), "second_id": F.when(F.col("_set") == 1, F.col(outlet)).cast("long")})
    known = F.col("id").isNotNull() & ((F.col("kind") != "pair") | F.col("second_id").isNotNull())
    return named.filter(known).select("kind", "id", "second_id", "n_reviews", "avg_a", "avg_b", "avg_d", "std_d", "min_d", "max_d")


def timeline(rows: DataFrame, by: str, as_of: str, limit: int = 10_000) -> DataFrame:
    """Per entity and day with reviews up to ``as_of``: running n_reviews and averages, the last ``limit`` days of each entity.

    Days are added up first, so that the window sees a row per day.
    """
    past = rows.filter(F.col("published_at").isNotNull() & (F.col("published_at") <= F.lit(as_of).cast("timestamp")) & F.col(by).isNotNull())
    days = past.groupBy(by, F.to_date("published_at").alias("day")).agg(F.count("*").alias("_n"), *[f(c).alias(f"_{n}_{c}") for c in ("d_a", "d_b", "d") for n, f in (("sum", F.sum), ("n", F.count))])
    sofar = Window.partitionBy(by).orderBy("day").rowsBetween(Window.unboundedPreceding, 0)
    average = lambda c: F.try_divide(F.sum(f"_sum_{c}").over(sofar).cast("double"), F.sum(f"_n_{c}").over(sofar)) / 1000
    running = days.select(by, "day", F.sum("_n").over(sofar).alias("n_reviews"), average("d_a").alias("avg_a"), average("d_b").alias("avg_b"), average("d").alias("avg_d"), F.row_number().over(Window.partitionBy(by).orderBy(F.desc("day"))).alias("_back"))
    return running.filter(F.col("_back") <= limit).drop("_back")


def leaderboard(stats: DataFrame, key: str, sort: str = "highest", limit: int = 20) -> DataFrame:
    """rank and the statistics of entities with enough reviews and spread, by the size of their disparity."""
    allowed = stats.filter((F.col("n_reviews") >= MIN_BOARD_REVIEWS) & (F.coalesce("std_d", F.lit(0.0)) >= MIN_BOARD_SPREAD) & F.col("avg_d").isNotNull())
    size = F.abs("avg_d")
    order = [size.asc_nulls_last() if sort == "lowest" else size.desc_nulls_last(), F.desc("n_reviews"), F.asc(key)]
    top = allowed.orderBy(*order).limit(limit)
    return top.withColumn("rank", F.row_number().over(Window.orderBy(*order)))
