"""Paged lists, searches, detail pages and unions, as the application's endpoints give them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import dates, scores, titles
from ..operators import disparity, relational
from ..sources import bindings as b
from .disparity_queries import scored_reviews, user_scores
from .registry import STATS_SQL, query, views

TODAY = "1996-06-01"


def described_items(spark: SparkSession, d: str) -> DataFrame:
    """Items with their critics' and users' figures: n_reviews, avg_d, score_a, score_b."""
    stats = disparity.entity_stats(scored_reviews(spark, d), "item").select("item", "n_reviews", "avg_a", "avg_b", "avg_d")
    users = user_scores(spark, d)
    return b.items(spark, d).join(stats, "item", "left").join(relational.broadcast_if_small(users), b.user_of() == users.user_id, "left").drop("user_id")


_DESCRIBED = f"""+stats AS (SELECT item, {STATS_SQL} FROM disparity GROUP BY item),
    described AS (SELECT i.*, s.n_reviews, s.avg_a, s.avg_b, s.avg_d, u.score_a, u.score_b FROM items i LEFT JOIN stats s ON i.item = s.item LEFT JOIN user_scores u ON i.item % 150 = u.user_id)"""
_MEANINGFUL = "(score_a IS NOT NULL OR score_b IS NOT NULL OR coalesce(n_reviews, 0) >= 5)"


def meaningful():
    """Items worth listing: with a user score that qualifies or at least five reviews."""
    return F.col("score_a").isNotNull() | F.col("score_b").isNotNull() | (F.coalesce("n_reviews", F.lit(0)) >= 5)


@query("Q-01_items_by_disparity", views("disparity", "items", then=_DESCRIBED + f"""
    SELECT item, title, n_reviews, coalesce((avg_a + avg_b) / 2, avg_a, avg_b) AS gap, released FROM described WHERE {_MEANINGFUL} ORDER BY abs(coalesce((avg_a + avg_b) / 2, avg_a, avg_b)) DESC NULLS LAST, n_reviews DESC NULLS LAST, item LIMIT 20 OFFSET 20"""))
def items_by_disparity(spark, d):
    gap = F.coalesce((F.col("avg_a") + F.col("avg_b")) / 2, "avg_a", "avg_b")
    rows = described_items(spark, d).filter(meaningful()).select("item", "title", "n_reviews", gap.alias("gap"), "released")
    return relational.page(rows, [F.abs("gap").desc_nulls_last(), F.desc_nulls_last("n_reviews"), F.asc("item")], 2, 20)


@query("Q-01_items_released_first", views("items", then=f"""SELECT item, title, released, coalesce(released <= DATE '{TODAY}', FALSE) AS is_out FROM items WHERE coalesce(year(released), 0) IN (1995, 1996) AND title ILIKE '%e%'
    ORDER BY is_out DESC, released DESC NULLS LAST, item DESC LIMIT 24"""))
def items_released_first(spark, d):
    out = F.coalesce(F.col("released") <= F.lit(TODAY).cast("date"), F.lit(False))
    years = F.col("released").between(F.lit("1995-01-01").cast("date"), F.lit("1996-12-31").cast("date"))  # a range reaches the scan, year() would not
    rows = b.items(spark, d).filter(years & F.col("title").ilike("%e%")).select("item", "title", "released", out.alias("is_out"))
    return relational.page(rows, [F.desc("is_out"), F.desc_nulls_last("released"), F.desc("item")], 1, 24)


@query("WIN-06_page_totals", views("items", then="SELECT count(*) AS total, CAST(ceil(count(*) / 24) AS BIGINT) AS total_pages FROM items WHERE title ILIKE '%e%'"))
def page_totals(spark, d):
    return relational.page_counts(b.items(spark, d).filter(F.col("title").ilike("%e%")), 24)


@query("Q-02_item_detail", views("disparity", "items", then=_DESCRIBED + """
    SELECT described.*, (SELECT count(*) FROM disparity r WHERE r.item = 5 AND CAST(r.published_at AS DATE) < described.released) AS early FROM described WHERE item = 5"""))
def item_detail(spark, d):
    one = described_items(spark, d).filter("item = 5")
    timing = scored_reviews(spark, d).filter("item = 5").join(b.items(spark, d).filter("item = 5").select("item", "released"), "item")
    early = timing.agg(F.count_if(F.coalesce(dates.review_timing(F.col("published_at"), F.col("released")) == "early", F.lit(False))).alias("early"))
    return one.crossJoin(early)  # one row each


@query("Q-07_item_reviews", views("disparity", "items", then="""SELECT r.item, r.critic, r.outlet, r.s, r.d, r.published_at FROM disparity r JOIN items i ON r.item = i.item WHERE r.item = 5
    AND CAST(r.published_at AS DATE) - i.released BETWEEN 0 AND 60 ORDER BY r.published_at DESC, r.item, r.review_id, r.critic, r.s DESC LIMIT 50"""))
def item_reviews(spark, d):
    timing = dates.review_timing(F.col("published_at"), F.col("released"))
    rows = scored_reviews(spark, d).filter("item = 5").join(b.items(spark, d).select("item", "released"), "item").filter(timing == "launch_window")
    return relational.page(rows, [F.desc("published_at"), F.asc("item"), F.asc("review_id"), F.asc("critic"), F.desc("s")], 1, 50).select("item", "critic", "outlet", "s", "d", "published_at")


@query("Q-08_critics", views("disparity", then=f"""+stats AS (SELECT critic, {STATS_SQL} FROM disparity GROUP BY critic)
    SELECT critic, c_name AS name, n_reviews, avg_d FROM stats JOIN customer ON critic = c_custkey WHERE n_reviews > 0 AND c_name ILIKE '%1%' ORDER BY n_reviews DESC, critic LIMIT 20 OFFSET 40"""))
def critics(spark, d):
    stats = disparity.entity_stats(scored_reviews(spark, d), "critic").filter("n_reviews > 0").select("critic", "n_reviews", "avg_d")
    names = b.table(spark, d, "customer").select(F.col("c_custkey").alias("critic"), F.col("c_name").alias("name")).filter(F.col("name").ilike("%1%"))
    return relational.page(stats.join(names, "critic"), [F.desc("n_reviews"), F.asc("critic")], 3, 20)


@query("Q-11_outlets", views("disparity", then=f"""+stats AS (SELECT outlet, {STATS_SQL} FROM disparity WHERE outlet IS NOT NULL GROUP BY outlet)
    SELECT outlet, s_name AS name, n_reviews, avg_d FROM stats JOIN supplier ON outlet = s_suppkey WHERE n_reviews >= 10 ORDER BY abs(avg_d) DESC NULLS LAST, outlet LIMIT 20"""))
def outlets(spark, d):
    stats = disparity.entity_stats(scored_reviews(spark, d), "outlet").filter("n_reviews >= 10").select("outlet", "n_reviews", "avg_d")
    names = b.table(spark, d, "supplier").select(F.col("s_suppkey").cast("long").alias("outlet"), F.col("s_name").alias("name"))
    return relational.page(stats.withColumn("outlet", F.col("outlet").cast("long")).join(names, "outlet"), [F.abs("avg_d").desc_nulls_last(), F.asc("outlet")], 1, 20)


_QUERY = "er#00"
_MATCH = f"(contains(lower({{0}}), '{_QUERY}') OR contains(regexp_replace(lower({{0}}), '[^a-z0-9]+', '', 'g'), 'er00'))"


@query("Q-16_search", views("items", then=f"""
    (SELECT 'critic' AS kind, c_custkey AS id, c_name AS name FROM customer WHERE {_MATCH.format('c_name')} ORDER BY c_custkey LIMIT 10) UNION ALL
    (SELECT 'outlet', s_suppkey, s_name FROM supplier WHERE {_MATCH.format('s_name')} ORDER BY s_suppkey LIMIT 10) UNION ALL
    (SELECT 'item', item, title FROM items WHERE {_MATCH.format('title')} ORDER BY released DESC NULLS LAST, item LIMIT 10)"""))
def search(spark, d):
    def top(kind, rows, id, name, *order):
        return rows.filter(titles.search_match(F.col(name), _QUERY)).orderBy(*order, F.asc(id)).limit(10).select(F.lit(kind).alias("kind"), F.col(id).cast("long").alias("id"), F.col(name).alias("name"))

    people, houses = b.table(spark, d, "customer"), b.table(spark, d, "supplier")
    return top("critic", people, "c_custkey", "c_name").unionByName(top("outlet", houses, "s_suppkey", "s_name")).unionByName(top("item", b.items(spark, d), "item", "title", F.desc_nulls_last("released")))


@query("Q-17_news", views("articles", then="SELECT article, source, headline, published_at FROM articles WHERE source NOT IN ('src1', 'src2') AND headline ILIKE '%the%' ORDER BY published_at DESC, article LIMIT 30"))
def news(spark, d):
    rows = b.articles(spark, d).filter(~F.col("source").isin("src1", "src2") & F.col("headline").ilike("%the%"))
    return relational.page(rows.select("article", "source", "headline", "published_at"), [F.desc("published_at"), F.asc("article")], 1, 30)


@query("SET-09_source_groups", views("articles", then="SELECT DISTINCT CASE WHEN source IN ('src0', 'src1', 'src2') THEN 'group one' ELSE source END AS shown FROM articles"))
def source_groups(spark, d):
    groups = spark.createDataFrame([(f"src{i}", "group one") for i in range(3)], "source string, shown string")
    rows = b.articles(spark, d).select("source").distinct()
    return rows.join(F.broadcast(groups), "source", "left").select(F.coalesce("shown", "source").alias("shown")).distinct()  # groups are three rows


@query("Q-18_sitemap", views("reviews", "items", then="""SELECT 'outlet' AS kind, CAST(outlet AS BIGINT) AS id FROM reviews WHERE outlet IS NOT NULL AND score IS NOT NULL GROUP BY outlet UNION ALL SELECT 'critic', critic FROM reviews WHERE score IS NOT NULL GROUP BY critic
    UNION ALL SELECT 'item', item FROM items WHERE item IN (SELECT item FROM reviews WHERE score IS NOT NULL)"""))
def sitemap(spark, d):
    rows = b.reviews(spark, d).filter("score IS NOT NULL")
    known = lambda c: rows.filter(F.col(c).isNotNull()).select(F.lit(c).alias("kind"), F.col(c).cast("long").alias("id")).distinct()
    items = b.items(spark, d).join(rows.select("item"), "item", "left_semi").select(F.lit("item").alias("kind"), F.col("item").alias("id"))
    return known("outlet").unionByName(known("critic")).unionByName(items)


@query("Q-19_tracked_items", views("items", then="SELECT item, title, released FROM items WHERE released IS NOT NULL AND size <= 3 ORDER BY released DESC, item LIMIT 100"))
def tracked_items(spark, d):
    rows = b.items(spark, d).filter("released IS NOT NULL AND size <= 3").select("item", "title", "released")
    return rows.orderBy(F.desc("released"), F.asc("item")).limit(100)


@query("SRC-15_seek_page", views("items", then="SELECT item, title FROM items WHERE item > 100 ORDER BY item LIMIT 50"))
def seek_page(spark, d):
    return b.items(spark, d).filter("item > 100").select("item", "title").orderBy("item").limit(50)


@query("JOI-20_input_order", views("items", then="SELECT i.item, i.title, CAST(n AS INTEGER) AS place FROM (SELECT unnest([9, 3, 7, 3, 100000]) AS item, generate_subscripts([9, 3, 7, 3, 100000], 1) - 1 AS n) w JOIN items i ON i.item = w.item"))
def input_order(spark, d):
    wanted = spark.range(1).select(F.posexplode(F.array(*[F.lit(x).cast("long") for x in (9, 3, 7, 3, 100000)])).alias("place", "item"))
    return b.items(spark, d).select("item", "title").join(wanted, "item").select("item", "title", "place")


# --- client-side aggregates

_LEAN = "CASE WHEN d >= 5000 THEN 'generous' WHEN d <= -5000 THEN 'critical' ELSE 'aligned' END"


@query("CLI-01_monthly_bands", views("disparity", then=f"""SELECT outlet, strftime(published_at, '%Y-%m') AS month, count(*) FILTER ({_LEAN} = 'generous') AS generous, count(*) FILTER ({_LEAN} = 'aligned') AS aligned, count(*) FILTER ({_LEAN} = 'critical') AS critical,
    CAST(sum(d) AS DOUBLE) / count(d) / 1000 AS avg_d, count(DISTINCT critic) AS critics, min(CAST(published_at AS DATE)) AS first_day, max(CAST(published_at AS DATE)) AS last_day FROM disparity WHERE outlet IS NOT NULL AND d IS NOT NULL GROUP BY 1, 2"""))
def monthly_bands(spark, d):
    lean = scores.leaning(F.col("d") / 1000)
    rows = scored_reviews(spark, d).filter("outlet IS NOT NULL AND d IS NOT NULL").withColumn("lean", lean)
    return rows.groupBy("outlet", dates.month_key(F.col("published_at")).alias("month")).agg(
        *[F.count_if(F.col("lean") == x).alias(x) for x in ("generous", "aligned", "critical")], disparity.mean("d").alias("avg_d"), F.countDistinct("critic").alias("critics"),
        F.min(F.to_date("published_at")).alias("first_day"), F.max(F.to_date("published_at")).alias("last_day"),
    )


@query("CLI-02_quarter_range", views("disparity", then="""SELECT year(published_at) || '-Q' || quarter(published_at) AS quarter, count(*) AS n, CAST(sum(d) AS DOUBLE) / nullif(count(d), 0) / 1000 AS avg_d FROM disparity
    WHERE published_at >= TIMESTAMP '1996-01-01' AND published_at < TIMESTAMP '1998-01-01' GROUP BY 1"""))
def quarter_range(spark, d):
    rows = scored_reviews(spark, d).filter("published_at >= TIMESTAMP_NTZ '1996-01-01 00:00:00' AND published_at < TIMESTAMP_NTZ '1998-01-01 00:00:00'")
    return rows.groupBy(dates.quarter_key(F.col("published_at")).alias("quarter")).agg(F.count("*").alias("n"), disparity.mean("d").alias("avg_d"))


@query("CLI-03_heatmap", views("disparity", then=f"SELECT critic, CAST(year(published_at) AS INTEGER) AS year, item, review_id, d / 1000 AS gap, CASE WHEN d IS NULL THEN NULL ELSE {_LEAN} END AS lean  FROM disparity"))
def heatmap(spark, d):
    rows = scored_reviews(spark, d)
    return rows.select("critic", F.year("published_at").alias("year"), "item", "review_id", (F.col("d") / 1000).alias("gap"), scores.leaning(F.col("d") / 1000).alias("lean"))


@query("CLI-05_beeswarm", views("disparity", then="""SELECT item, review_id, critic, s, CAST(round(s / 1000) AS BIGINT) AS axis, round(CAST(round(s / 1000) AS BIGINT) - 0.4::DOUBLE + CASE WHEN n > 1 THEN 0.8::DOUBLE / (n - 1) * (k - 1) ELSE 0.4::DOUBLE END, 6) AS x FROM
    (SELECT *, row_number() OVER (PARTITION BY item, s ORDER BY review_id, critic, outlet NULLS FIRST, d) AS k, count(*) OVER (PARTITION BY item, s) AS n FROM disparity)"""))
def beeswarm(spark, d):
    from pyspark.sql import Window

    group = Window.partitionBy("item", "s")
    rows = scored_reviews(spark, d).withColumns({"k": F.row_number().over(group.orderBy("review_id", "critic", F.asc_nulls_first("outlet"), "d")), "n": F.count("*").over(group)})
    axis = F.round(F.col("s") / 1000).cast("long")
    x = axis - F.lit(0.4) + F.when(F.col("n") > 1, F.try_divide(F.lit(0.8), F.col("n") - 1) * (F.col("k") - 1)).otherwise(0.4)
    return rows.select("item", "review_id", "critic", "s", axis.alias("axis"), F.round(x, 6).alias("x"))


@query("CLI-06_outliers", views("disparity", then="""+m AS (SELECT item, CAST(sum(s) AS DOUBLE) / count(s) AS mean, count(*) AS n FROM disparity GROUP BY item)
    SELECT d.item, max(s) AS highest, min(s) AS lowest FROM disparity d JOIN m ON d.item = m.item WHERE n >= 5 AND abs(s - mean) >= 10000 GROUP BY d.item"""))
def outliers(spark, d):
    rows = scored_reviews(spark, d)
    means = rows.groupBy("item").agg((F.sum("s").cast("double") / F.count("s")).alias("mean"), F.count("*").alias("n")).filter("n >= 5")
    return rows.join(means, "item").filter(F.abs(F.col("s") - F.col("mean")) >= 10000).groupBy("item").agg(F.max("s").alias("highest"), F.min("s").alias("lowest"))


@query("CLI-07_alignment", views("disparity", then="""SELECT item, critic, d, CASE WHEN d > 0 THEN 'above' ELSE 'below' END AS side FROM (SELECT * FROM disparity QUALIFY row_number() OVER (PARTITION BY item, critic ORDER BY published_at, review_id, s, outlet NULLS FIRST) = 1) WHERE d <> 0"""))
def alignment(spark, d):
    first = relational.topk_per_group(scored_reviews(spark, d), ["item", "critic"], [F.asc("published_at"), F.asc("review_id"), F.asc("s"), F.asc_nulls_first("outlet")])
    return first.filter("d <> 0").select("item", "critic", "d", F.when(F.col("d") > 0, "above").otherwise("below").alias("side"))


@query("SET-04_event_timeline", views("disparity", "items", "articles", then="""SELECT item, 'release' AS kind, CAST(released AS TIMESTAMP) AS moment, title AS detail FROM items WHERE released IS NOT NULL
    UNION ALL SELECT item, 'review', published_at, CAST(s AS VARCHAR) FROM disparity UNION ALL SELECT item, 'news', published_at, source FROM articles WHERE item IS NOT NULL"""))
def event_timeline(spark, d):
    shape = lambda rows, kind, at, detail: rows.select(F.col("item").cast("long").alias("item"), F.lit(kind).alias("kind"), F.col(at).cast("timestamp_ntz").alias("moment"), F.col(detail).cast("string").alias("detail"))
    releases = shape(b.items(spark, d).filter("released IS NOT NULL"), "release", "released", "title")
    return releases.unionByName(shape(scored_reviews(spark, d), "review", "published_at", "s")).unionByName(shape(b.articles(spark, d).filter("item IS NOT NULL"), "news", "published_at", "source"))


@query("WIN-16_first_per_key", views("reviews", then="SELECT critic, item, published_at, review_id FROM reviews QUALIFY row_number() OVER (PARTITION BY critic, item ORDER BY published_at DESC, review_id DESC) = 1"))
def first_per_key(spark, d):
    return relational.latest_per_key(b.reviews(spark, d), ["critic", "item"], ["published_at", "review_id"], [])


@query("FLT-09_board_gate", views("disparity", then=f"+stats AS (SELECT critic, {STATS_SQL} FROM disparity GROUP BY critic) SELECT critic, n_reviews, std_d FROM stats WHERE n_reviews >= 10 AND coalesce(std_d, 0) >= 10 AND avg_d IS NOT NULL"))
def board_gate(spark, d):
    stats = disparity.entity_stats(scored_reviews(spark, d), "critic")
    return stats.filter((F.col("n_reviews") >= 10) & (F.coalesce("std_d", F.lit(0.0)) >= 10) & F.col("avg_d").isNotNull()).select("critic", "n_reviews", "std_d")


@query("FLT-17_refresh_candidates", views("reviews", "items", then=f"""+last AS (SELECT item, max(published_at) AS synced FROM reviews GROUP BY item)
    SELECT i.item, i.released, synced FROM items i LEFT JOIN last l ON i.item = l.item WHERE (i.released >= DATE '{TODAY}' OR i.released IS NULL) AND (synced IS NULL OR synced < TIMESTAMP '2001-01-01') ORDER BY synced NULLS FIRST, i.released DESC NULLS LAST, i.item LIMIT 200"""))
def refresh_candidates(spark, d):
    last = b.reviews(spark, d).groupBy("item").agg(F.max("published_at").alias("synced"))
    rows = b.items(spark, d).filter((F.col("released") >= F.lit(TODAY).cast("date")) | F.col("released").isNull()).join(last, "item", "left").filter("synced IS NULL OR synced < TIMESTAMP_NTZ '2001-01-01 00:00:00'")
    return rows.select("item", "released", "synced").orderBy(F.asc_nulls_first("synced"), F.desc_nulls_last("released"), F.asc("item")).limit(200)


@query("FLT-20_not_yet_seen", views("items", then="SELECT item, title FROM items WHERE item NOT IN (SELECT l_partkey FROM lineitem WHERE l_quantity > 40)"))
def not_yet_seen(spark, d):
    seen = b.table(spark, d, "lineitem").filter("l_quantity > 40").select(F.col("l_partkey").alias("item"))
    return b.items(spark, d).select("item", "title").join(seen, "item", "left_anti")
