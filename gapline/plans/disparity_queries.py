"""Queries on disparity: latest scores, statistics, roll-ups, timelines, leaderboards, timing, sinks."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import dates, scores
from ..operators import disparity, relational
from ..sources import bindings as b
from .registry import STATS_SQL, query, views

AS_OF = "1998-01-01 00:00:00"


def scored_reviews(spark: SparkSession, d: str) -> DataFrame:
    users = disparity.qualifying_scores(disparity.latest_scores(b.observations(spark, d)))
    return disparity.review_disparity(b.reviews(spark, d), users, b.user_of())


@query("SRC-01_scored_reviews", views("reviews", then="SELECT critic, outlet, item, score, published_at FROM reviews WHERE score IS NOT NULL"))
def scored(spark, d):
    return b.reviews(spark, d).filter(F.col("score").isNotNull()).select("critic", "outlet", "item", "score", "published_at")


@query("SRC-02_latest_user_scores", views("user_scores", then="SELECT * FROM user_scores"))
def user_scores(spark, d):
    return disparity.qualifying_scores(disparity.latest_scores(b.observations(spark, d)))


@query("WIN-07_latest_observation", views("latest", then="SELECT user_id, source, observed_at, obs_id, score, sample_size FROM latest"))
def latest(spark, d):
    return disparity.latest_scores(b.observations(spark, d))


@query("JOI-01_review_disparity", views("disparity", then="SELECT critic, outlet, item, published_at, review_id, s, d_a, d_b, d FROM disparity"))
def review_disparity(spark, d):
    return scored_reviews(spark, d)


def _stats(by: str) -> str:
    return views("disparity", then=f"SELECT {by}, {STATS_SQL} FROM disparity WHERE {by} IS NOT NULL GROUP BY {by}")


@query("AGG-01_critic_stats", _stats("critic"))
def critic_stats(spark, d):
    return disparity.entity_stats(scored_reviews(spark, d), "critic")


@query("AGG-01_outlet_stats", _stats("outlet"))
def outlet_stats(spark, d):
    return disparity.entity_stats(scored_reviews(spark, d), "outlet")


@query("AGG-01_item_stats", _stats("item"))
def item_stats(spark, d):
    return disparity.entity_stats(scored_reviews(spark, d), "item")


@query("AGG-02_score_profile", views("disparity", then="""
    SELECT outlet, count(*) AS n_reviews,
           coalesce(CASE WHEN count(s) > 1 THEN round(sqrt(greatest(0, (CAST(sum(s * s) AS DOUBLE) - CAST(sum(s) AS DOUBLE) * CAST(sum(s) AS DOUBLE) / count(s)) / (count(s) - 1))) / 1000, 6) END, 0) AS score_spread,
           count(*) >= 10 AND bool_and(s IN (0, 100000)) AS is_binary
    FROM disparity GROUP BY outlet"""))
def score_profile(spark, d):
    return disparity.score_profile(scored_reviews(spark, d), "outlet")


@query("AGG-03_rollups", views("disparity", then=f"""
    SELECT * FROM (SELECT 'critic' AS kind, critic AS id, CAST(NULL AS BIGINT) AS second_id, {STATS_SQL} FROM disparity GROUP BY critic
    UNION ALL SELECT 'outlet', outlet, NULL, {STATS_SQL} FROM disparity WHERE outlet IS NOT NULL GROUP BY outlet
    UNION ALL SELECT 'item', item, NULL, {STATS_SQL} FROM disparity GROUP BY item
    UNION ALL SELECT 'pair', critic, outlet, {STATS_SQL} FROM disparity WHERE outlet IS NOT NULL GROUP BY critic, outlet)"""))
def rollups(spark, d):
    return disparity.rollups(scored_reviews(spark, d))


@query("AGG-04_pair_stats", views("disparity", then=f"SELECT critic, outlet, {STATS_SQL} FROM disparity WHERE outlet IS NOT NULL GROUP BY critic, outlet"))
def pair_stats(spark, d):
    return disparity.entity_stats(scored_reviews(spark, d), "critic", "outlet")


@query("AGG-05_last_review", views("reviews", then=f"SELECT outlet, max(CASE WHEN published_at <= TIMESTAMP '{AS_OF}' + INTERVAL 30 DAY THEN published_at END) AS last_review FROM reviews WHERE outlet IS NOT NULL GROUP BY outlet"))
def last_review(spark, d):
    near = F.col("published_at") <= F.lit(AS_OF).cast("timestamp") + F.expr("INTERVAL 30 DAY")
    return b.reviews(spark, d).filter("outlet IS NOT NULL").groupBy("outlet").agg(F.max(F.when(near, F.col("published_at"))).alias("last_review"))


@query("AGG-06_critics_per_outlet", views("reviews", then="SELECT outlet, count(DISTINCT critic) AS n_critics FROM reviews WHERE outlet IS NOT NULL GROUP BY outlet"))
def critics_per_outlet(spark, d):
    return b.reviews(spark, d).filter("outlet IS NOT NULL").groupBy("outlet").agg(F.countDistinct("critic").alias("n_critics"))


@query("AGG-07_item_critic_aggregates", views("disparity", then="SELECT item, CAST(sum(s) AS DOUBLE) / count(s) / 1000 AS avg_score, count(s) AS n_scores FROM disparity GROUP BY item"))
def item_aggregates(spark, d):
    return scored_reviews(spark, d).groupBy("item").agg(disparity.mean("s").alias("avg_score"), F.count("s").alias("n_scores"))


@query("AGG-08_daily_sums", views("disparity", then="""SELECT CAST(published_at AS DATE) AS day, count(*) AS n_reviews, CAST(sum(d_a) AS BIGINT) AS sum_a, count(d_a) AS n_a, CAST(sum(d_b) AS BIGINT) AS sum_b, count(d_b) AS n_b,
    CAST(sum(d) AS BIGINT) AS sum_d, count(d) AS n_d FROM disparity GROUP BY 1"""))
def daily_sums(spark, d):
    sums = [x for c, n in (("d_a", "a"), ("d_b", "b"), ("d", "d")) for x in (F.sum(c).alias(f"sum_{n}"), F.count(c).alias(f"n_{n}"))]
    return scored_reviews(spark, d).groupBy(F.to_date("published_at").alias("day")).agg(F.count("*").alias("n_reviews"), *sums)


_TIMING = """CASE WHEN i.released IS NULL OR r.published_at IS NULL THEN NULL WHEN CAST(r.published_at AS DATE) < i.released THEN 'early'
    WHEN CAST(r.published_at AS DATE) - i.released <= 60 THEN 'launch_window' ELSE 'late' END"""


@query("AGG-09_timing_counts", views("reviews", "items", then=f"""+
    timed AS (SELECT r.critic, {_TIMING} AS timing FROM reviews r JOIN items i ON r.item = i.item WHERE r.score IS NOT NULL)
    SELECT critic, count(*) FILTER (timing = 'early') AS early, count(*) FILTER (timing = 'launch_window') AS launch_window, count(*) FILTER (timing = 'late') AS late FROM timed GROUP BY critic"""))
def timing_counts(spark, d):
    rows = b.reviews(spark, d).filter("score IS NOT NULL").join(b.items(spark, d).select("item", "released"), "item").withColumn("timing", dates.review_timing(F.col("published_at"), F.col("released")))
    return rows.groupBy("critic").agg(*[F.count_if(F.coalesce(F.col("timing") == t, F.lit(False))).alias(t) for t in ("early", "launch_window", "late")])


@query("AGG-10_score_stats", views("disparity", then="SELECT critic, count(*) AS n, CAST(sum(s) AS DOUBLE) / count(s) / 1000 AS avg_score, min(s) / 1000 AS min_score, max(s) / 1000 AS max_score FROM disparity GROUP BY critic"))
def score_stats(spark, d):
    return scored_reviews(spark, d).groupBy("critic").agg(F.count("*").alias("n"), disparity.mean("s").alias("avg_score"), (F.min("s") / 1000).alias("min_score"), (F.max("s") / 1000).alias("max_score"))


@query("AGG-11_outlet_breakdown", views("reviews", then="SELECT critic, outlet, count(*) AS n, min(CAST(published_at AS DATE)) AS first_day, max(CAST(published_at AS DATE)) AS last_day FROM reviews WHERE outlet IS NOT NULL GROUP BY critic, outlet"))
def outlet_breakdown(spark, d):
    day = F.to_date("published_at")
    return b.reviews(spark, d).filter("outlet IS NOT NULL").groupBy("critic", "outlet").agg(F.count("*").alias("n"), F.min(day).alias("first_day"), F.max(day).alias("last_day"))


@query("AGG-12_site_totals", views("disparity", "items", then=f"""+
    by_critic AS (SELECT critic, {STATS_SQL} FROM disparity GROUP BY critic)
    SELECT (SELECT count(*) FROM disparity) AS n_reviews, (SELECT count(*) FROM items) AS n_items, (SELECT count(*) FROM by_critic) AS n_critics,
           (SELECT count(DISTINCT outlet) FROM disparity) AS n_outlets, (SELECT round(avg(avg_d), 6) FROM by_critic) AS avg_of_critics"""))
def site_totals(spark, d):
    rows = scored_reviews(spark, d)
    critics = disparity.entity_stats(rows, "critic").agg(F.count("*").alias("n_critics"), F.round(F.avg("avg_d"), 6).alias("avg_of_critics"))
    return rows.agg(F.count("*").alias("n_reviews"), F.countDistinct("outlet").alias("n_outlets")).crossJoin(critics).crossJoin(b.items(spark, d).agg(F.count("*").alias("n_items")))  # one row each


@query("AGG-29_coverage", views("reviews", then="SELECT outlet, count(*) AS total, count(score) AS scored, count(*) - count(score) AS remaining, 100.0 * count(score) / count(*) AS percent FROM reviews WHERE outlet IS NOT NULL GROUP BY outlet"))
def coverage(spark, d):
    return b.reviews(spark, d).filter("outlet IS NOT NULL").groupBy("outlet").agg(F.count("*").alias("total"), F.count("score").alias("scored"), (F.count("*") - F.count("score")).alias("remaining"), F.try_divide(F.lit(100.0) * F.count("score"), F.count("*")).alias("percent"))


@query("WIN-08_timeline", views("disparity", then=f"""+
    days AS (SELECT critic, CAST(published_at AS DATE) AS day, count(*) AS n, sum(d_a) AS sa, count(d_a) AS na, sum(d_b) AS sb, count(d_b) AS nb, sum(d) AS sd, count(d) AS nd FROM disparity WHERE published_at <= TIMESTAMP '{AS_OF}' GROUP BY 1, 2)
    SELECT critic, day, CAST(sum(n) OVER w AS BIGINT) AS n_reviews, CAST(sum(sa) OVER w AS DOUBLE) / nullif(sum(na) OVER w, 0) / 1000 AS avg_a, CAST(sum(sb) OVER w AS DOUBLE) / nullif(sum(nb) OVER w, 0) / 1000 AS avg_b,
           CAST(sum(sd) OVER w AS DOUBLE) / nullif(sum(nd) OVER w, 0) / 1000 AS avg_d
    FROM days WINDOW w AS (PARTITION BY critic ORDER BY day ROWS UNBOUNDED PRECEDING) QUALIFY row_number() OVER (PARTITION BY critic ORDER BY day DESC) <= 30"""))
def timeline(spark, d):
    return disparity.timeline(scored_reviews(spark, d), "critic", AS_OF, 30)


_BOARD = "SELECT row_number() OVER (ORDER BY abs(avg_d) DESC NULLS LAST, n_reviews DESC, {key}) AS rank, * FROM stats WHERE n_reviews >= 10 AND coalesce(std_d, 0) >= 10 AND avg_d IS NOT NULL ORDER BY rank LIMIT 20"


@query("Q-15_critic_leaderboard", views("disparity", then=f"+stats AS (SELECT critic, {STATS_SQL} FROM disparity GROUP BY critic) SELECT CAST(rank AS INTEGER) AS rank, * EXCLUDE rank FROM ({_BOARD.format(key='critic')})"))
def critic_leaderboard(spark, d):
    return disparity.leaderboard(disparity.entity_stats(scored_reviews(spark, d), "critic"), "critic")


@query("Q-15_outlet_leaderboard", views("disparity", then=f"+stats AS (SELECT outlet, {STATS_SQL} FROM disparity WHERE outlet IS NOT NULL GROUP BY outlet) SELECT CAST(rank AS INTEGER) AS rank, * EXCLUDE rank FROM ({_BOARD.format(key='outlet').replace('DESC NULLS LAST', 'ASC NULLS LAST')})"))
def outlet_leaderboard(spark, d):
    return disparity.leaderboard(disparity.entity_stats(scored_reviews(spark, d), "outlet"), "outlet", "lowest")


@query("Q-15_item_leaderboard", views("disparity", "items", then=f"""+
    stats AS (SELECT item, {STATS_SQL} FROM disparity GROUP BY item)
    SELECT s.item, i.title, s.n_reviews, s.avg_d, CAST(row_number() OVER (ORDER BY abs(avg_d) DESC NULLS LAST, i.released DESC NULLS LAST, s.item) AS INTEGER) AS rank
    FROM stats s JOIN items i ON s.item = i.item WHERE n_reviews >= 10 AND (avg_a IS NOT NULL OR avg_b IS NOT NULL) ORDER BY rank LIMIT 20"""))
def item_leaderboard(spark, d):
    stats = disparity.entity_stats(scored_reviews(spark, d), "item").filter("n_reviews >= 10 AND (avg_a IS NOT NULL OR avg_b IS NOT NULL)")
    order = [F.abs("avg_d").desc_nulls_last(), F.desc_nulls_last("released"), F.asc("item")]
    top = stats.join(b.items(spark, d), "item").orderBy(*order).limit(20)
    return top.select("item", "title", "n_reviews", "avg_d", F.row_number().over(Window.orderBy(*order)).alias("rank"))


@query("WIN-01_latest_review_per_item", views("reviews", then="""SELECT item, published_at, critic, review_id, score FROM reviews
    QUALIFY row_number() OVER (PARTITION BY item ORDER BY published_at DESC, review_id DESC, critic DESC, score DESC NULLS LAST) = 1"""))
def latest_review_per_item(spark, d):
    order = [F.desc("published_at"), F.desc("review_id"), F.desc("critic"), F.desc_nulls_last("score")]
    return relational.topk_per_group(b.reviews(spark, d).select("item", "published_at", "critic", "review_id", "score"), ["item"], order)


@query("WIN-02_latest_review_per_critic", views("reviews", then="SELECT critic, max(published_at) AS published_at, max_by(item, {'p': published_at, 'r': review_id, 'i': item}) AS item FROM reviews GROUP BY critic"))
def latest_review_per_critic(spark, d):
    return relational.latest_per_key(b.reviews(spark, d), ["critic"], ["published_at", "review_id"], ["item"]).select("critic", "published_at", "item")


@query("WIN-03_latest_review_per_outlet", views("reviews", then="SELECT outlet, max(published_at) AS published_at, max_by(item, {'p': published_at, 'r': review_id, 'i': item}) AS item FROM reviews WHERE outlet IS NOT NULL GROUP BY outlet"))
def latest_review_per_outlet(spark, d):
    return relational.latest_per_key(b.reviews(spark, d).filter("outlet IS NOT NULL"), ["outlet"], ["published_at", "review_id"], ["item"]).select("outlet", "published_at", "item")


_MONTHS = "SELECT item, date_trunc('month', published_at)::DATE AS snapshot_date, count(*) AS n_reviews, CAST(sum(d) AS BIGINT) AS total FROM disparity GROUP BY 1, 2"


def _snapshots(spark, d):
    """Monthly snapshots of items, the history that readers take the newest of."""
    return scored_reviews(spark, d).groupBy("item", F.trunc("published_at", "month").alias("snapshot_date")).agg(F.count("*").alias("n_reviews"), F.sum("d").alias("total"))


@query("WIN-04_latest_snapshot", views("disparity", then=f"+months AS ({_MONTHS}) SELECT * FROM months QUALIFY row_number() OVER (PARTITION BY item ORDER BY snapshot_date DESC) = 1"))
def latest_snapshot(spark, d):
    return relational.latest_per_key(_snapshots(spark, d), ["item"], ["snapshot_date"], ["n_reviews", "total"])


@query("WIN-05_last_samples", views("activity", then="""+
    last AS (SELECT * FROM activity QUALIFY row_number() OVER (PARTITION BY item ORDER BY sampled_at DESC, sample_id DESC) <= 12)
    SELECT item, string_agg(CAST(players AS VARCHAR), ',' ORDER BY sampled_at, sample_id) AS players FROM last GROUP BY item"""))
def last_samples(spark, d):
    last = relational.topk_per_group(b.activity(spark, d), ["item"], [F.desc("sampled_at"), F.desc("sample_id")], 12)
    ordered = F.array_sort(F.collect_list(F.struct("sampled_at", "sample_id", "players")))
    return last.groupBy("item").agg(F.array_join(F.transform(ordered, lambda x: x["players"].cast("string")), ",").alias("players"))


@query("WIN-13_milestones", views("disparity", then="""+
    counted AS (SELECT item, CAST(published_at AS DATE) AS day, count(*) AS n FROM disparity GROUP BY 1, 2),
    running AS (SELECT item, day, CAST(sum(n) OVER (PARTITION BY item ORDER BY day) AS BIGINT) AS upto, n FROM counted)
    SELECT item, day, max(m) AS milestone FROM running, (VALUES (10), (25), (50), (100)) t(m) WHERE upto >= m AND upto - n < m GROUP BY item, day"""))
def milestones(spark, d):
    days = scored_reviews(spark, d).groupBy("item", F.to_date("published_at").alias("day")).agg(F.count("*").alias("n"))
    upto = F.sum("n").over(Window.partitionBy("item").orderBy("day"))
    reached = days.withColumn("upto", upto).withColumn("reached", F.filter(F.array(*map(F.lit, (10, 25, 50, 100))), lambda m: (m <= F.col("upto")) & (m > F.col("upto") - F.col("n"))))
    return reached.filter(F.size("reached") > 0).select("item", "day", F.array_max("reached").alias("milestone"))


@query("JOI-03_reviews_with_dims", views("reviews", then="""SELECT r.critic, c.c_name AS critic_name, s.s_name AS outlet_name, r.item, r.score FROM reviews r JOIN customer c ON r.critic = c.c_custkey LEFT JOIN supplier s ON r.outlet = s.s_suppkey"""))
def reviews_with_dims(spark, d):
    critics = b.table(spark, d, "customer").select(F.col("c_custkey").alias("critic"), F.col("c_name").alias("critic_name"))
    outlets = b.table(spark, d, "supplier").select(F.col("s_suppkey").alias("outlet"), F.col("s_name").alias("outlet_name"))
    rows = b.reviews(spark, d).withColumn("outlet", F.col("outlet").cast("int"))
    return rows.join(critics, "critic").join(outlets, "outlet", "left").select("critic", "critic_name", "outlet_name", "item", "score")


@query("JOI-05_full_reviews", views("reviews", "items", then="""SELECT r.review_id, i.title, c.c_name AS critic_name, s.s_name AS outlet_name, r.score FROM reviews r JOIN items i ON r.item = i.item
    JOIN customer c ON r.critic = c.c_custkey JOIN supplier s ON r.outlet = s.s_suppkey"""))
def full_reviews(spark, d):
    critics = b.table(spark, d, "customer").select(F.col("c_custkey").alias("critic"), F.col("c_name").alias("critic_name"))
    outlets = b.table(spark, d, "supplier").select(F.col("s_suppkey").cast("long").alias("outlet"), F.col("s_name").alias("outlet_name"))
    return b.reviews(spark, d).join(b.items(spark, d).select("item", "title"), "item").join(critics, "critic").join(outlets, "outlet").select("review_id", "title", "critic_name", "outlet_name", "score")


@query("JOI-07_outlet_critics", views("reviews", then="""+
    n AS (SELECT critic, outlet, count(*) AS n_reviews FROM reviews WHERE outlet IS NOT NULL GROUP BY critic, outlet)
    SELECT c.c_name AS critic_name, n.outlet, n.n_reviews FROM customer c JOIN n ON c.c_custkey = n.critic"""))
def outlet_critics(spark, d):
    n = b.reviews(spark, d).filter("outlet IS NOT NULL").groupBy("critic", "outlet").agg(F.count("*").alias("n_reviews"))
    critics = b.table(spark, d, "customer")
    return n.join(critics, F.col("critic") == critics.c_custkey).select(F.col("c_name").alias("critic_name"), "outlet", "n_reviews")


@query("JOI-11_entities_with_reviews", views("reviews", then="SELECT s_suppkey, s_name FROM supplier WHERE s_suppkey IN (SELECT outlet FROM reviews WHERE score IS NOT NULL)"))
def entities_with_reviews(spark, d):
    seen = b.reviews(spark, d).filter("score IS NOT NULL").select(F.col("outlet").cast("int").alias("s_suppkey"))
    return b.table(spark, d, "supplier").select("s_suppkey", "s_name").join(seen, "s_suppkey", "left_semi")


@query("AGG-13_shared_outlets", views("reviews", then="""+
    anchor AS (SELECT DISTINCT outlet FROM reviews WHERE item = 1 AND outlet IS NOT NULL), critics AS (SELECT DISTINCT critic FROM reviews WHERE item = 1)
    SELECT item, count(DISTINCT CASE WHEN outlet IN (SELECT outlet FROM anchor) THEN outlet END) AS shared_outlets, count(DISTINCT CASE WHEN critic IN (SELECT critic FROM critics) THEN critic END) AS shared_critics
    FROM reviews WHERE item <> 1 GROUP BY item"""))
def shared_outlets(spark, d):
    rows = b.reviews(spark, d)
    flag = lambda c: rows.filter("item = 1").select(c).filter(F.col(c).isNotNull()).distinct().withColumn(f"of_{c}", F.lit(True))
    marked = rows.filter("item <> 1").join(flag("outlet"), "outlet", "left").join(flag("critic"), "critic", "left")
    return marked.groupBy("item").agg(F.countDistinct(F.when(F.col("of_outlet"), F.col("outlet"))).alias("shared_outlets"), F.countDistinct(F.when(F.col("of_critic"), F.col("critic"))).alias("shared_critics"))


@query("JOI-21_existence_or_scalar", views("reviews", "items", then="SELECT item, title FROM items WHERE item IN (SELECT item FROM reviews WHERE score >= 98) OR item >= (SELECT max(item) FROM items) - 20"))
def existence(spark, d):
    items = b.items(spark, d)
    high = b.reviews(spark, d).filter("score >= 98").select("item").distinct().withColumn("_high", F.lit(True))
    top = items.agg(F.max("item").alias("_top"))
    return items.join(high, "item", "left").crossJoin(F.broadcast(top)).filter(F.coalesce("_high", F.lit(False)) | (F.col("item") >= F.col("_top") - 20)).select("item", "title")  # top is one row


# --- sinks as merges

@query("SNK-02_release_merge", views("items", then="""+
    new AS (SELECT item + 100 AS item, title || ' II' AS title, released - 200 + CAST(item % 9 AS INTEGER) * 50 AS released FROM items WHERE item % 3 = 0)
    SELECT coalesce(n.item, o.item) AS item, coalesce(n.title, o.title) AS title,
      CASE WHEN n.item IS NULL THEN o.released WHEN o.item IS NULL THEN n.released WHEN n.released IS NULL THEN o.released WHEN o.released IS NULL THEN n.released
           WHEN o.released <= DATE '1998-01-01' AND n.released > DATE '1998-01-01' THEN o.released WHEN n.released < o.released THEN o.released ELSE n.released END AS released
    FROM (SELECT item, title, released FROM items) o FULL JOIN new n ON o.item = n.item"""))
def release_merge(spark, d):
    items = b.items(spark, d).select("item", "title", "released")
    new = items.filter("item % 3 = 0").select((F.col("item") + 100).alias("item"), F.concat("title", F.lit(" II")).alias("title"), F.expr("date_add(released, cast(item % 9 as int) * 50 - 200)").alias("released"))
    keep = dates.guarded_release(F.col("old.released"), F.col("new.released"), F.lit("1998-01-01").cast("date"))
    return relational.merge_latest(items, new, ["item"], rules={"released": keep})


@query("SNK-03_upsert_latest", views("observations", then="""+
    old AS (SELECT user_id, source, max_by(score, {'t': observed_at, 'o': obs_id}) AS score FROM observations WHERE obs_id % 2 = 0 GROUP BY ALL),
    new AS (SELECT user_id, source, max_by(score, {'t': observed_at, 'o': obs_id}) AS score FROM observations WHERE obs_id % 2 = 1 AND user_id % 3 <> 0 GROUP BY ALL)
    SELECT coalesce(n.user_id, o.user_id) AS user_id, coalesce(n.source, o.source) AS source, CASE WHEN n.user_id IS NULL THEN o.score ELSE n.score END AS score FROM old o FULL JOIN new n ON o.user_id = n.user_id AND o.source = n.source"""))
def upsert_latest(spark, d):
    obs = b.observations(spark, d)
    newest = lambda rows: disparity.latest_scores(rows).select("user_id", "source", "score")
    return relational.merge_latest(newest(obs.filter("obs_id % 2 = 0")), newest(obs.filter("obs_id % 2 = 1 AND user_id % 3 <> 0")), ["user_id", "source"])


@query("SNK-04_staff_members", views("reviews", then="SELECT CASE WHEN critic % 10 = 0 THEN -(1000000000 + outlet) ELSE critic END AS critic, count(*) AS n FROM reviews WHERE outlet IS NOT NULL GROUP BY 1"))
def staff_members(spark, d):
    author = F.when(F.col("critic") % 10 != 0, F.col("critic"))
    return b.reviews(spark, d).filter("outlet IS NOT NULL").select(scores.staff_id(author, F.col("outlet")).alias("critic")).groupBy("critic").agg(F.count("*").alias("n"))


@query("SNK-05_quarantine", """SELECT o_custkey AS id, CASE WHEN o_custkey % 50 = 0 THEN 'no name' WHEN o_orderpriority LIKE '1%' THEN 'urgent' END AS reason, count(*) AS seen_count, min(o_orderdate) AS first_seen, max(o_orderdate) AS last_seen
    FROM orders WHERE o_custkey % 50 = 0 OR o_orderpriority LIKE '1%' GROUP BY 1, 2""")
def quarantine(spark, d):
    rows = b.table(spark, d, "orders").select(F.col("o_custkey").alias("id"), "o_orderpriority", "o_orderdate")
    reason = F.when(F.col("id") % 50 == 0, "no name").when(F.col("o_orderpriority").startswith("1"), "urgent")
    return relational.split_quarantine(rows, reason, "id", "o_orderdate")[1]


@query("SNK-07_insert_absent", views("activity", then="""+
    old AS (SELECT item, date_trunc('hour', sampled_at) AS hour, max(players) AS players FROM activity WHERE sample_id % 3 = 0 GROUP BY ALL), new AS (SELECT item, date_trunc('hour', sampled_at) AS hour, max(players) AS players FROM activity GROUP BY ALL)
    SELECT * FROM old UNION ALL SELECT * FROM new n WHERE NOT EXISTS (SELECT 1 FROM old o WHERE o.item = n.item AND o.hour = n.hour)"""))
def insert_absent(spark, d):
    hours = lambda rows: rows.groupBy("item", F.date_trunc("hour", "sampled_at").alias("hour")).agg(F.max("players").alias("players"))
    rows = b.activity(spark, d)
    return relational.insert_absent(hours(rows.filter("sample_id % 3 = 0")), hours(rows), ["item", "hour"])


@query("SNK-08_changed_only", views("disparity", then=f"""+
    new AS (SELECT critic, {STATS_SQL} FROM disparity GROUP BY critic), old AS (SELECT critic, {STATS_SQL} FROM disparity WHERE item % 40 <> 0 GROUP BY critic)
    SELECT n.critic, n.n_reviews, n.avg_d FROM new n LEFT JOIN old o ON n.critic = o.critic WHERE o.critic IS NULL OR n.avg_d IS DISTINCT FROM o.avg_d OR n.n_reviews IS DISTINCT FROM o.n_reviews"""))
def changed_only(spark, d):
    rows = scored_reviews(spark, d)
    new, old = disparity.entity_stats(rows, "critic"), disparity.entity_stats(rows.filter("item % 40 <> 0"), "critic")
    return relational.changed(old, new, ["critic"], ["n_reviews", "avg_d"]).select("critic", "n_reviews", "avg_d")


@query("SNK-12_merged_entities", views("reviews", then="SELECT CASE WHEN outlet BETWEEN 1 AND 9 THEN 10 ELSE outlet END AS outlet, count(*) AS n, count(DISTINCT critic) AS critics FROM reviews WHERE outlet IS NOT NULL GROUP BY 1"))
def merged_entities(spark, d):
    aliases = spark.range(1, 10).select(F.col("id").alias("duplicate"), F.lit(10).cast("long").alias("canonical"))
    rows = b.reviews(spark, d).filter("outlet IS NOT NULL").withColumn("outlet", F.col("outlet").cast("long"))
    return relational.canonical(rows, aliases, "outlet").groupBy("outlet").agg(F.count("*").alias("n"), F.countDistinct("critic").alias("critics"))


@query("SNK-16_orphans_removed", views("observations", then="SELECT obs_id, user_id, source FROM observations o WHERE NOT EXISTS (SELECT 1 FROM observations g WHERE g.user_id = o.user_id AND g.source = 'b' AND g.sample_size < 3)"))
def orphans_removed(spark, d):
    obs = b.observations(spark, d)
    gone = obs.filter("source = 'b' AND sample_size < 3").select("user_id").distinct()
    return obs.join(gone, "user_id", "left_anti").select("obs_id", "user_id", "source")


@query("SNK-19_append_if_changed", views("observations", then="""+
    old AS (SELECT user_id, source, max_by({'s': score, 'n': sample_size}, {'t': observed_at, 'o': obs_id}) AS v FROM observations WHERE obs_id % 2 = 0 GROUP BY ALL),
    new AS (SELECT user_id, source, max_by({'s': score, 'n': sample_size}, {'t': observed_at, 'o': obs_id}) AS v FROM observations WHERE user_id % 2 = 0 OR obs_id % 2 = 0 GROUP BY ALL)
    SELECT n.user_id, n.source, n.v.s AS score, n.v.n AS sample_size FROM new n LEFT JOIN old o ON n.user_id = o.user_id AND n.source = o.source WHERE o.user_id IS NULL OR n.v.s IS DISTINCT FROM o.v.s OR n.v.n IS DISTINCT FROM o.v.n"""))
def append_if_changed(spark, d):
    obs = b.observations(spark, d)
    newest = lambda rows: disparity.latest_scores(rows).select("user_id", "source", "score", "sample_size")
    return relational.changed(newest(obs.filter("obs_id % 2 = 0")), newest(obs.filter("user_id % 2 = 0 OR obs_id % 2 = 0")), ["user_id", "source"], ["score", "sample_size"])
