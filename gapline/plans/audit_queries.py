"""Audits, set operations, sinks and gates that the other modules don't hold."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import scores, titles
from ..operators import disparity, relational, similarity, snapshots, taxonomy
from ..sources import bindings as b
from . import disparity_queries as dq
from . import mining_queries as mq
from .list_queries import _DESCRIBED, described_items
from .registry import STATS_SQL, query, views
from .series_queries import NOW

# --- predicates and projections


@query("FLT-01_meaningful", views("disparity", "items", then=_DESCRIBED + " SELECT item, score_a IS NOT NULL OR score_b IS NOT NULL OR coalesce(n_reviews, 0) >= 5 AS listed, avg_d IS NOT NULL OR score_a IS NOT NULL OR score_b IS NOT NULL AS any_signal FROM described"))
def meaningful(spark, d):
    from .list_queries import meaningful as listed

    any_signal = F.col("avg_d").isNotNull() | F.col("score_a").isNotNull() | F.col("score_b").isNotNull()
    return described_items(spark, d).select("item", listed().alias("listed"), any_signal.alias("any_signal"))


@query("FLT-04_display_masks", views("disparity", "items", then=_DESCRIBED + " SELECT item, CASE WHEN n_reviews >= 20 THEN avg_a END AS shown_a, CASE WHEN n_reviews >= 20 AND score_b >= 0 THEN avg_b END AS shown_b FROM described"))
def display_masks(spark, d):
    enough = F.col("n_reviews") >= 20
    return described_items(spark, d).select("item", F.when(enough, F.col("avg_a")).alias("shown_a"), F.when(enough & scores.known(F.col("score_b")).isNotNull(), F.col("avg_b")).alias("shown_b"))


@query("FLT-10_item_gate", views("disparity", then=f"+stats AS (SELECT item, {STATS_SQL} FROM disparity GROUP BY item) SELECT item FROM stats WHERE n_reviews >= 10 AND (avg_a IS NOT NULL OR avg_b IS NOT NULL)"))
def item_gate(spark, d):
    return disparity.entity_stats(dq.scored_reviews(spark, d), "item").filter("n_reviews >= 10 AND (avg_a IS NOT NULL OR avg_b IS NOT NULL)").select("item")


@query("FLT-15_rejected_payloads", "SELECT p_partkey, CASE WHEN p_partkey % 11 = 0 THEN 'missing id' WHEN trim(v) = '' THEN 'missing name' WHEN regexp_matches(lower(v), '^https?://') THEN 'name is a url' END AS reason FROM (SELECT *, CASE WHEN p_size = 3 THEN ' ' WHEN p_size = 5 THEN 'HTTPS://x.example/' || p_name ELSE p_name END AS v FROM part)")
def rejected(spark, d):
    name = F.when(F.col("p_size") == 3, " ").when(F.col("p_size") == 5, F.concat(F.lit("HTTPS://x.example/"), "p_name")).otherwise(F.col("p_name"))
    reason = F.when(F.col("p_partkey") % 11 == 0, "missing id").when(F.trim(name) == "", "missing name").when(F.lower(name).rlike("^https?://"), "name is a url")
    return b.table(spark, d, "part").select("p_partkey", reason.alias("reason"))


@query("FLT-18_nonstandalone", """SELECT p_partkey FROM (SELECT p_partkey, p_name || CASE p_partkey % 5 WHEN 0 THEN ': Season Pass' WHEN 1 THEN ' DLC' ELSE ' widlc' END AS title, CASE WHEN p_partkey % 5 = 2 THEN 'It requires the full base game to play.' ELSE 'requires nothing' END AS about FROM part)
    WHERE regexp_matches(lower(title), '\\b(dlc|season pass|expansion)\\b') OR regexp_matches(lower(about), 'requires .{0,40}base (game|program)')""")
def nonstandalone(spark, d):
    k = F.col("p_partkey") % 5
    title = F.lower(F.concat("p_name", F.when(k == 0, ": Season Pass").when(k == 1, " DLC").otherwise(" widlc")))
    about = F.lower(F.when(k == 2, "It requires the full base game to play.").otherwise("requires nothing"))
    return b.table(spark, d, "part").filter(title.rlike(r"\b(dlc|season pass|expansion)\b") | about.rlike("requires .{0,40}base (game|program)")).select("p_partkey")


@query("FLT-19_dirty_targets", views("items", then="SELECT item FROM items WHERE CASE WHEN item % 4 = 0 THEN NULL ELSE item % 3 END IS DISTINCT FROM 1 OR size > 40"))
def dirty_targets(spark, d):
    version = F.when(F.col("item") % 4 != 0, F.col("item") % 3)
    return b.items(spark, d).filter(~version.eqNullSafe(F.lit(1)) | (F.col("size") > 40)).select("item")


@query("PRJ-02_combined_ladder", views("disparity", "items", then=_DESCRIBED + " SELECT item, coalesce((avg_a + avg_b) / 2, avg_a, avg_b) AS gap FROM described"))
def combined_ladder(spark, d):
    return described_items(spark, d).select("item", F.coalesce((F.col("avg_a") + F.col("avg_b")) / 2, "avg_a", "avg_b").alias("gap"))


# --- joins and sets


@query("JOI-06_articles_with_items", views("articles", "items", then="SELECT a.article, a.source, i.title, i.released FROM articles a LEFT JOIN items i ON a.item = i.item"))
def articles_with_items(spark, d):
    return b.articles(spark, d).join(b.items(spark, d).select("item", "title", "released"), "item", "left").select("article", "source", "title", "released")


@query("JOI-18_prioritised_match", views("items", then="""+w AS (SELECT o_orderkey AS k, o_custkey AS id, lower(o_orderpriority) AS alias FROM orders), m AS (SELECT k, item, 0 AS priority FROM w JOIN items ON id = item UNION ALL SELECT k, min(item), 1 FROM w JOIN items ON lower(brand) = alias GROUP BY k)
    SELECT k, item, priority FROM m QUALIFY row_number() OVER (PARTITION BY k ORDER BY priority, item) = 1"""))
def prioritised_match(spark, d):
    wanted, items = b.table(spark, d, "orders").select(F.col("o_orderkey").alias("k"), F.col("o_custkey").alias("id"), F.lower("o_orderpriority").alias("alias")), b.items(spark, d)
    by_id = wanted.join(items.select("item"), F.col("id") == F.col("item")).select("k", "item", F.lit(0).alias("priority"))
    by_alias = wanted.join(items.groupBy(F.lower("brand").alias("alias")).agg(F.min("item").alias("item")), "alias").select("k", "item", F.lit(1).alias("priority"))
    return relational.topk_per_group(by_id.unionByName(by_alias), ["k"], [F.asc("priority"), F.asc("item")])


@query("SET-01_candidate_pools", views("items", then="""+a AS (SELECT x.item AS anchor, y.item AS candidate FROM items x JOIN items y ON x.type = y.type AND x.brand = y.brand AND x.item <> y.item WHERE x.item % 50 = 0), c AS (SELECT x.item AS anchor, y.item AS candidate FROM items x JOIN items y ON x.size = y.size AND x.brand = y.brand AND x.item <> y.item WHERE x.item % 50 = 0)
    SELECT anchor, count(*) AS candidates FROM (SELECT * FROM a UNION SELECT * FROM c) GROUP BY anchor"""))
def candidate_pools(spark, d):
    """For a stated set of anchors; all pairs of a group would grow with its square."""
    items = b.items(spark, d).select("item", "type", "brand", "size")
    pool = lambda *on: items.filter("item % 50 = 0").select(F.col("item").alias("anchor"), *on).join(items.select(F.col("item").alias("candidate"), *on), list(on)).filter("anchor <> candidate").select("anchor", "candidate")
    return pool("type", "brand").unionByName(pool("size", "brand")).distinct().groupBy("anchor").agg(F.count("*").alias("candidates"))


@query("SET-05_token_sets", views("items", then="""+w AS (SELECT item, string_split(lower(title), ' ') AS a, string_split(lower(type), ' ') AS b FROM items)
    SELECT item, len(list_intersect(a, b)) AS both, len(list_distinct(list_filter(a, lambda x: NOT list_contains(b, x)))) AS only_title, len(list_distinct(list_concat(a, b))) AS either FROM w"""))
def token_sets(spark, d):
    a, c = F.split(F.lower("title"), " "), F.split(F.lower("type"), " ")
    return b.items(spark, d).select("item", F.size(F.array_intersect(a, c)).cast("long").alias("both"), F.size(F.array_except(a, c)).cast("long").alias("only_title"), F.size(F.array_union(a, c)).cast("long").alias("either"))


@query("SET-07_distinct_sources", views("articles", then="SELECT DISTINCT source FROM articles"))
def distinct_sources(spark, d):
    return b.articles(spark, d).select("source").distinct()


# --- aggregates


@query("AGG-17_unmapped_labels", views("items", then=f"+l AS (SELECT item, unnest({mq._WORDS.format('title')}) AS label FROM items) SELECT label, count(*) AS n, max(item) AS sample FROM l WHERE label NOT IN ('green', 'red', 'steel') GROUP BY label"))
def unmapped_labels(spark, d):
    labels = b.items(spark, d).select("item", F.explode(titles.words(F.col("title"))).alias("label"))
    mapped = spark.createDataFrame([(x,) for x in ("green", "red", "steel")], "label string")
    return labels.join(F.broadcast(mapped), "label", "left_anti").groupBy("label").agg(F.count("*").alias("n"), F.max("item").alias("sample"))  # three rows


@query("AGG-19_missing_axes", views("items", then=f"""+{mq._EVIDENCE}, {mq._HITS}, need AS (SELECT DISTINCT archetype, axis FROM ax WHERE kind = 'required')
    SELECT need.archetype, need.axis, count(*) AS n FROM hits JOIN need ON hits.archetype = need.archetype LEFT JOIN (SELECT * FROM best WHERE kind = 'required') g ON g.item = hits.item AND g.archetype = hits.archetype AND g.axis = need.axis WHERE g.item IS NULL GROUP BY 1, 2"""))
def missing_axes(spark, d):
    axes = mq.axes(spark)
    excluded = spark.createDataFrame(mq.EXCLUDED, "value string, archetype string")
    fp = mq.fingerprints(spark, d)
    hits = taxonomy._hits(fp, axes, "item", excluded)
    need = axes.filter("kind = 'required'").select("archetype", "axis").distinct()
    return hits.select("item", "archetype", "matched").join(F.broadcast(need), "archetype").filter(~F.array_contains("matched", F.col("axis"))).groupBy("archetype", "axis").agg(F.count("*").alias("n"))  # the rules' axes


@query("AGG-22_relationship_confusion", views("items", then=mq._SHARED + " SELECT i.brand AS kind, CASE WHEN score >= 180 THEN 'high' ELSE 'medium' END AS relationship, count(*) AS n FROM s JOIN items i ON s.anchor = i.item WHERE score < 300 GROUP BY 1, 2 ORDER BY n DESC, kind, relationship LIMIT 50"))
def relationship_confusion(spark, d):
    rows = mq.facet_classes(spark, d, a_by=["brand"]).counts().filter("score < 300")
    return rows.groupBy(F.col("a_brand").alias("kind"), F.col("confidence").alias("relationship")).agg(F.sum("pairs").alias("n")).orderBy(F.desc("n"), F.asc("kind"), F.asc("relationship")).limit(50)


@query("AGG-23_payload_states", "SELECT json_extract_string(props, '$.k') AS state, count(*) AS n FROM events GROUP BY 1")
def payload_states(spark, d):
    return b.table(spark, d, "events").groupBy(F.get_json_object("props", "$.k").alias("state")).agg(F.count("*").alias("n"))


@query("AGG-27_title_word_frequency", views("items", then=f"+w AS (SELECT item, unnest(list_distinct({mq._WORDS.format('title')})) AS word FROM items) SELECT word, count(*) AS titles FROM w GROUP BY word"))
def title_word_frequency(spark, d):
    return b.items(spark, d).select(F.explode(F.array_distinct(titles.words(F.col("title")))).alias("word")).groupBy("word").agg(F.count("*").alias("titles"))


@query("AGG-28_table_counts", "SELECT 'customer' AS name, count(*) AS n FROM customer UNION ALL SELECT 'supplier', count(*) FROM supplier UNION ALL SELECT 'part', count(*) FROM part UNION ALL SELECT 'events', count(*) FROM events")
def table_counts(spark, d):
    counts = [b.table(spark, d, t).agg(F.lit(t).alias("name"), F.count("*").alias("n")) for t in ("customer", "supplier", "part", "events")]
    return counts[0].unionByName(counts[1]).unionByName(counts[2]).unionByName(counts[3])


@query("WIN-14_ranked_page", views("disparity", then=f"""+stats AS (SELECT critic, {STATS_SQL} FROM disparity GROUP BY critic), p AS (SELECT critic, n_reviews FROM stats ORDER BY n_reviews DESC, critic LIMIT 25 OFFSET 50)
    SELECT CAST(50 + row_number() OVER (ORDER BY n_reviews DESC, critic) AS INTEGER) AS rank, * FROM p"""))
def ranked_page(spark, d):
    stats = disparity.entity_stats(dq.scored_reviews(spark, d), "critic").select("critic", "n_reviews")
    order = [F.desc("n_reviews"), F.asc("critic")]
    return relational.page(stats, order, 3, 25).withColumn("rank", F.row_number().over(Window.orderBy(*order)) + 50)  # over one page


@query("WIN-15_momentum", views("articles", then=f"""SELECT source, count(*) FILTER (age <= 12) - count(*) FILTER (age > 12 AND age <= 24) AS momentum FROM (SELECT source, (epoch(TIMESTAMP '{NOW}') - epoch(published_at)) / 3600 AS age FROM articles) GROUP BY source"""))
def momentum(spark, d):
    age = (F.unix_timestamp(F.lit(NOW)) - F.unix_timestamp(F.col("published_at").cast("timestamp"))) / 3600
    rows = b.articles(spark, d).select("source", age.alias("age"))
    return rows.groupBy("source").agg(F.count_if(F.col("age") <= 12).alias("a"), F.count_if((F.col("age") > 12) & (F.col("age") <= 24)).alias("p")).select("source", (F.col("a") - F.col("p")).alias("momentum"))


# --- sinks


@query("SNK-06_changed_links", views("articles", then="SELECT article, coalesce(CASE WHEN article % 2 = 0 THEN item END, CASE WHEN article % 5 = 0 THEN 99 END, item) AS item FROM articles"))
def changed_links(spark, d):
    old = b.articles(spark, d).select("article", "item")
    new = old.select("article", F.coalesce(F.when(F.col("article") % 2 == 0, F.col("item")), F.when(F.col("article") % 5 == 0, 99)).alias("item"))
    return relational.merge_latest(old, new, ["article"], rules={"item": F.coalesce("new.item", "old.item")}).select("article", F.col("item").cast("long").alias("item"))


@query("SNK-09_snapshots", views("disparity", then=f"SELECT 'outlet' AS entity_type, CAST(outlet AS BIGINT) AS id, DATE '1998-01-01' AS snapshot_date, {STATS_SQL} FROM disparity WHERE outlet IS NOT NULL AND published_at <= TIMESTAMP '{dq.AS_OF}' GROUP BY outlet"))
def outlet_snapshots(spark, d):
    past = dq.scored_reviews(spark, d).filter(F.col("published_at") <= F.lit(dq.AS_OF).cast("timestamp_ntz"))
    stats = disparity.entity_stats(past, "outlet").withColumnRenamed("outlet", "id")
    return stats.select(F.lit("outlet").alias("entity_type"), F.col("id").cast("long").alias("id"), F.lit("1998-01-01").cast("date").alias("snapshot_date"), *[c for c in stats.columns if c != "id"])


@query("SNK-09_incremental", views("disparity", then=f"""+
    moved AS (SELECT outlet, published_at, CASE WHEN item % 10 = 4 THEN d + 1000 ELSE d END AS d, CASE WHEN item % 10 = 4 THEN d_a + 1000 ELSE d_a END AS d_a, CASE WHEN item % 10 = 4 THEN d_b + 1000 ELSE d_b END AS d_b FROM disparity WHERE item % 10 <> 3)
    SELECT outlet, {STATS_SQL}, max(published_at) AS last FROM moved WHERE outlet IS NOT NULL GROUP BY outlet"""))
def incremental(spark, d):
    """A tenth of the items has come since the first snapshot, the reviews of a tenth were taken back, those of a tenth scored anew."""
    rows = dq.scored_reviews(spark, d)
    k = F.col("item") % 10
    anew = rows.withColumns({c: F.when(k == 4, F.col(c) + 1000).otherwise(F.col(c)) for c in ("d", "d_a", "d_b")})
    states = relational.saved(snapshots.cells(rows.filter(k != 2), "outlet"), "states")
    first = snapshots.stats(states, "outlet")
    touched = relational.saved(snapshots.changed_cells(states, rows.filter(k.isin(3, 4)), anew.filter(k.isin(2, 4)), anew.filter(k != 3), "outlet"), "touched")
    return snapshots.snapshot(first, snapshots.updated(states, touched, "outlet"), touched, "outlet")


@query("SNK-13_backfilled_items", views("disparity", "items", then="""SELECT i.item, i.title, coalesce(r.n, 0) AS n_reviews, r.last_day, s.scores FROM items i LEFT JOIN (SELECT item, count(*) AS n, max(CAST(published_at AS DATE)) AS last_day FROM disparity GROUP BY item) r ON i.item = r.item
    LEFT JOIN (SELECT user_id, count(*) AS scores FROM observations GROUP BY user_id) s ON i.item % 150 = s.user_id"""))
def backfilled_items(spark, d):
    reviews = dq.scored_reviews(spark, d).groupBy("item").agg(F.count("*").alias("n"), F.max(F.to_date("published_at")).alias("last_day"))
    observed = b.observations(spark, d).groupBy("user_id").agg(F.count("*").alias("scores"))
    joined = b.items(spark, d).join(reviews, "item", "left").join(relational.broadcast_if_small(observed), b.user_of() == F.col("user_id"), "left")
    return joined.select("item", "title", F.coalesce("n", F.lit(0)).alias("n_reviews"), "last_day", "scores")


@query("SNK-20_invalidated", views("observations", then="SELECT obs_id, user_id, CASE WHEN user_id % 10 = 3 THEN NULL ELSE score END AS score FROM observations WHERE NOT (user_id % 10 = 3 AND source = 'b')"))
def invalidated(spark, d):
    wrong = F.col("user_id") % 10 == 3
    return b.observations(spark, d).filter(~(wrong & (F.col("source") == "b"))).select("obs_id", "user_id", F.when(~wrong, F.col("score")).alias("score"))


@query("SNK-22_filled_gaps", views("items", then="SELECT item, coalesce(released, DATE '2000-01-01') AS released FROM items"))
def filled_gaps(spark, d):
    old = b.items(spark, d).select("item", "released")
    new = old.select("item", F.lit("2000-01-01").cast("date").alias("released"))
    return relational.merge_latest(old, new, ["item"], rules={"released": F.coalesce("old.released", "new.released")})


@query("SIM-13_served_neighbours", views("items", then=mq._SHARED + """, best AS (SELECT anchor, candidate, CAST(row_number() OVER (PARTITION BY anchor ORDER BY score DESC, candidate) AS INTEGER) AS rank, score FROM s), b2 AS (SELECT anchor, candidate, rank FROM best WHERE rank <= 5 AND score >= 200),
    r AS (SELECT a.item AS anchor, c.item AS candidate, CAST(row_number() OVER (PARTITION BY a.item ORDER BY c.price DESC, c.item) AS INTEGER) AS rank FROM items a JOIN items c ON c.type = a.type AND c.item <> a.item WHERE a.item % 50 = 0 QUALIFY rank <= 5), ok AS (SELECT anchor FROM b2 GROUP BY anchor HAVING count(*) >= 2), ok2 AS (SELECT anchor FROM r GROUP BY anchor HAVING count(*) >= 2)
    SELECT * FROM b2 WHERE anchor IN (SELECT anchor FROM ok) UNION ALL SELECT * FROM r WHERE anchor NOT IN (SELECT anchor FROM ok) AND anchor IN (SELECT anchor FROM ok2)"""))
def served_neighbours(spark, d):
    """Neighbours by shared facets, or by type and brand where there are too few."""
    best = mq.top_similar(spark, d).filter("score >= 200").select("anchor", "candidate", "rank")
    rest = mq.dearest(spark, d, "type", 5).select("anchor", "candidate", "rank")
    return similarity.first_source(best, rest)
