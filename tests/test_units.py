"""Golden values, sequential operators against plain Python, sources and streams."""

import datetime
import json
import random

import pytest
from pyspark.sql import functions as F

from gapline.functions import dates, scores, titles
from gapline.operators import disparity, linking, relational, similarity, taxonomy, timeseries
from gapline.sources import paged, payloads
from gapline.streaming import jobs


def rows_of(df):
    return sorted(map(tuple, df.collect()), key=str)


@pytest.mark.parametrize("raw, scale, score, found", [
    ("8", "10", 80.0, "10"), ("70", "10", 70.0, "100"), ("80", "20", 80.0, "100"), ("0", "10", 0.0, "10"), ("b+", None, 87.0, "letter"), (" 85% ", None, 85.0, "100"), ("4/5", None, 80.0, "5"), ("8.5 / 10", None, 85.0, "10"),
    ("N/A", None, None, None), (None, None, None, None), ("", None, None, None), ("3", None, 60.0, "5"), ("7", None, 70.0, "10"), ("15", None, 75.0, "20"), ("101", "100", None, None), ("10D", None, None, None), ("NaN", None, None, None), ("1/0", None, None, None),
])
def test_normalized_scores(spark, raw, scale, score, found):
    df = spark.createDataFrame([(raw, scale)], "raw string, scale string").select(scores.normalize(F.col("raw"), F.col("scale")).alias("x"))
    assert tuple(df.first().x) == (score, found)


def test_pair_stats_golden(spark):
    reviews = spark.createDataFrame([(1, 1, 1, 80.0), (1, 1, 2, 70.0), (1, None, 2, None)], "critic int, outlet int, item int, score double")
    users = spark.createDataFrame([(1, 70.0, 90.0), (2, 60.0, 50.0)], "user_id int, score_a double, score_b double")
    found = disparity.entity_stats(disparity.review_disparity(reviews, users, F.col("item")), "critic", "outlet").first()
    assert (found.avg_a, found.avg_b, found.avg_d, found.min_d, found.max_d, round(found.std_d, 2)) == (10.0, 5.0, 7.5, 0.0, 15.0, 10.61)


def test_timeline_golden(spark):
    day = lambda n: datetime.datetime(2024, 1, n)
    rows = spark.createDataFrame([(1, day(1), 10_000, 20_000, 15_000), (1, day(2), 5_000, None, 5_000), (1, day(2), None, None, None)], "critic int, published_at timestamp, d_a long, d_b long, d long")
    found = disparity.timeline(rows, "critic", "2024-02-01").orderBy("day").collect()
    assert [(r.n_reviews, r.avg_a, r.avg_b, r.avg_d) for r in found] == [(1, 10.0, 20.0, 15.0), (3, 7.5, 20.0, 10.0)]
    assert disparity.timeline(rows, "critic", "2024-02-01", 1).first().n_reviews == 3


def plain_without_blips(points, gap):
    keep, i = [True] * len(points), 0
    while i < len(points):
        if points[i][1]:
            i += 1
            continue
        j = i
        while j + 1 < len(points) and points[j + 1][1] == 0:
            j += 1
        before = i > 0 and points[i][0] - points[i - 1][0] <= gap and points[i - 1][1] > 0
        after = j + 1 < len(points) and points[j + 1][0] - points[j][0] <= gap and points[j + 1][1] > 0
        if before and after:
            keep[i : j + 1] = [False] * (j + 1 - i)
        i = j + 1
    return [p for p, k in zip(points, keep, strict=True) if k]


def plain_markers(points):
    import statistics

    points = plain_without_blips(points, timeseries.HOUR * 2)
    out, last, drop = [(points[0][0], points[0][1], "first_tracked")], None, None
    for i, (at, v) in enumerate(points):
        prior = [y for x, y in points[:i] if at - x <= timeseries.WINDOW]
        if len(prior) < 2 or (base := statistics.median(prior)) <= 0:
            continue
        if last is None or at - last >= timeseries.COOLDOWN:
            if abs(v - base) >= 5000 and abs(v - base) / base >= 0.3:
                out.append((at, v, "major_surge" if v > base else "major_drop"))
                last, drop = at, ((at, v) if v < base else drop)
                continue
            if drop and v - drop[1] >= 5000 and drop[1] > 0 and (v - drop[1]) / drop[1] >= 0.3:
                out.append((at, v, "rebound"))
                last, drop = at, None
        if drop and at - drop[0] > timeseries.WINDOW:
            drop = None
    return out


def test_series_against_plain_python(spark):
    rng = random.Random(3)
    series = {}
    for item in range(6):
        at, points = 1_700_000_000_000_000, []
        for _ in range(120):
            at += rng.choice([1, 2, 3, 8]) * timeseries.HOUR
            points.append((at, rng.choice([0, 0, 6000, 9000, 12000, 18000, 30000])))
        series[item] = points
    rows = spark.createDataFrame([(i, n, at, v) for i, p in series.items() for n, (at, v) in enumerate(p)], "item int, sample_id int, at long, players long").withColumn("sampled_at", F.timestamp_micros("at"))
    kept = timeseries.without_blips(rows)
    assert rows_of(kept.select("item", "at", "players")) == sorted(((i, *p) for i, s in series.items() for p in plain_without_blips(s, 2 * timeseries.HOUR)), key=str)
    found = [(r.item, int(r.us), r.players, r.marker) for r in timeseries.markers(rows).withColumn("us", F.unix_micros("at")).collect()]
    assert sorted(found) == sorted((i, at, float(v), m) for i, s in series.items() for at, v, m in plain_markers(s))
    for most, even in ((1, True), (7, True), (7, False), (119, True), (500, True)):
        thinned = timeseries.thin(rows, most, ["item"], ["sampled_at"], even)
        half = (lambda x: round(x)) if even else (lambda x: int(x + 0.5))
        want = {n for n in range(120)} if most >= 120 else {119} if most == 1 else {half(k * 119 / (most - 1)) for k in range(most)}
        assert {r.sample_id for r in thinned.filter("item = 2").collect()} == want


def test_diverse_selection(spark):
    pairs = spark.createDataFrame([(1, 10, "x", 500), (1, 11, "x", 490), (1, 12, "y", 400), (1, 13, "x", 480), (1, 14, "z", 341), (2, 9, "x", 1)], "anchor int, candidate int, group string, score int")
    assert rows_of(similarity.diverse(pairs, 4)) == [(1, 10, 1), (1, 11, 4), (1, 12, 2), (1, 14, 3)] + [(2, 9, 1)] or rows_of(similarity.diverse(pairs, 4)) == [(1, 10, 1), (1, 11, 4), (1, 12, 2), (1, 14, 3), (2, 9, 1)]
    both = similarity.first_source(pairs.filter("anchor = 1").select("anchor", "candidate"), pairs.select("anchor", "candidate"), least=2)
    assert {r.anchor for r in both.collect()} == {1}


def test_embeddings_and_neighbours(spark):
    docs = spark.createDataFrame([(1, "open world fantasy world"), (2, "the of and"), (3, None), (4, "open world")], "id int, text string")
    vectors = similarity.dense(similarity.embeddings(docs, "id", "text"), "id")
    found = {r.id: r.vector for r in vectors.collect()}
    assert set(found) == {1, 4} and all(abs(sum(x * x for x in v) - 1) < 1e-12 for v in found.values())
    pair = vectors.alias("a").join(vectors.alias("b"), F.col("a.id") < F.col("b.id")).select(similarity.cosine(F.col("a.vector"), F.col("b.vector")).alias("c")).first()
    assert pair.c == pytest.approx(max(0.0, sum(x * y for x, y in zip(found[1], found[4], strict=True))))
    many = spark.range(200).select(F.col("id"), F.transform(F.sequence(F.lit(1), F.lit(4)), lambda i: F.sin(F.col("id") * i)).alias("v"))
    one, blocks = similarity.nearest(many.filter("id % 20 = 0"), many, 3, "id", "v"), similarity.nearest(many.filter("id % 20 = 0"), many, 3, "id", "v", block=3)
    assert rows_of(one) == rows_of(blocks) and one.count() == 30


def test_linking(spark):
    articles = spark.createDataFrame([(1, "Star Quest review", "x"), (2, "News", "about Star Quest and Moon Base"), (3, "Quest for the Star saga", ""), (4, None, None), (5, "Zebra of many Lakes", "")], "article int, headline string, description string")
    names = spark.createDataFrame([(7, "Star Quest"), (8, "Moon Base"), (9, "Zebra Lakes"), (10, "")], "item int, title string")
    found = linking.phrase_candidates(articles, names)
    assert rows_of(found.select("article", "item", "in_headline", "in_description")) == [(1, 7, True, False), (2, 7, False, True), (2, 8, False, True)]
    assert rows_of(linking.winners(found).select("article", "item")) == [(1, 7)]
    assert rows_of(linking.fallback(articles, names, least_words=2)) == [(1, 7), (5, 9)]
    assert linking.phrase_candidates(articles, names.limit(0)).count() == 0


def test_taxonomy_rules(spark):
    fp = spark.createDataFrame([(1, "a", "x", 0.8), (1, "b", "y", 0.7), (2, "a", "x", 0.9)], "item int, axis string, value string, confidence double")
    out = taxonomy.derived(fp, [([("a", "x"), ("b", "y")], ("c", "z", 0.65)), ([("a", "x")], ("a", "x", 0.1))])
    assert rows_of(out) == sorted([(1, "a", "x", 0.8), (1, "b", "y", 0.7), (1, "c", "z", 0.65), (2, "a", "x", 0.9)], key=str)
    changes = spark.createDataFrame([(1, "a", "replace", "q"), (2, "b", "add", "r"), (1, "b", "remove", "y")], "item int, axis string, action string, value string")
    assert rows_of(taxonomy.overridden(fp, changes)) == sorted([(1, "a", "q", 0.99), (2, "a", "x", 0.9), (2, "b", "r", 0.99)], key=str)
    pairs = spark.createDataFrame([(1, 2, "p", "p", []), (1, 3, "p", "q", []), (1, 4, "p", "z", ["q"]), (1, 5, "p", "z", [])], "anchor int, candidate int, a_primary string, c_primary string, c_secondaries array<string>")
    edges = spark.createDataFrame([("p", "q", "strong"), ("p", "q", "adjacent")], "src string, dst string, relation string")
    assert {r.candidate: r.relationship for r in taxonomy.relationships(pairs, edges).collect()} == {2: "same", 3: "strong_neighbor", 4: "strong_secondary", 5: None}
    parts = taxonomy.segments(spark.createDataFrame([(1, "Short. A sentence that is long enough to stay. A sentence that is long enough to stay.\n\nWrite to us at someone@example.org now")], "id int, text string"), "id", "text")
    assert [r.category for r in taxonomy.flagged_segments(parts, [("contact", "@")], []).orderBy("n").collect()] == [None, "contact"]


def test_titles(spark):
    df = spark.createDataFrame([("Part II: Dawn", "Part 2 Dawn"), ("Part II", "Part 3"), ("Alpha Beta", "Alpha Beta Edition"), (None, "x")], "a string, b string")
    related = df.select(titles.titles_related(F.col("a"), F.col("b"), titles.title_similarity(titles.normalized_title(F.col("a")), titles.normalized_title(F.col("b")))).alias("r"))
    assert [r.r for r in related.collect()] == [True, False, True, None]
    heads = spark.createDataFrame([("Big  news | Site A", "Site A"), (" - Site A", "Site A"), (None, None), ("x (y) + z", "(y) + z")], "t string, s string")
    assert [r[0] for r in heads.select(titles.clean_headline(F.col("t"), F.col("s"))).collect()] == ["Big news", "Untitled", "Untitled", "x (y) + z"]
    labels = spark.createDataFrame([("Café & Bar's – 2",), (None,)], "t string")
    assert [r[0] for r in labels.select(titles.ascii_label("t")).collect()] == ["cafe and bars 2", ""]
    assert [r[0] for r in spark.createDataFrame([("a &amp; &eacute;",)], "t string").select(titles.unescaped("t")).collect()] == ["a & é"]


def test_release_rules(spark):
    d = datetime.date
    rows = [(d(2020, 1, 1), d(2030, 1, 1), d(2020, 1, 1)), (d(2020, 1, 1), d(2019, 1, 1), d(2020, 1, 1)), (None, d(2019, 1, 1), d(2019, 1, 1)), (d(2030, 1, 1), d(2031, 1, 1), d(2031, 1, 1)), (d(2020, 1, 1), None, d(2020, 1, 1))]
    df = spark.createDataFrame(rows, "old date, new date, want date")
    assert all(r.want == r.got for r in df.withColumn("got", dates.guarded_release(F.col("old"), F.col("new"), F.lit(d(2024, 1, 1)))).collect())
    moments = spark.createDataFrame([("1700000000",), ("1700000000000",), ("12",), ("3 days ago",), ("2024-01-02T03:04:05Z",), ("Jan 2, 2024",), ("2 January 2024",), ("soon",), (None,)], "t string")
    got = [r[0] and r[0].isoformat() for r in moments.select(dates.parse_moment(F.col("t"), F.lit("2024-01-10 00:00:00").cast("timestamp"))).collect()]
    assert [g and g.split("+")[0] for g in got] == ["2023-11-14T22:13:20", "2023-11-14T22:13:20", None, "2024-01-07T00:00:00", "2024-01-02T03:04:05", "2024-01-02T00:00:00", "2024-01-02T00:00:00", None, None]


def test_merges(spark, tmp_path):
    old = spark.createDataFrame([(1, "a", 1), (2, "b", 2)], "k int, v string, n int")
    new = spark.createDataFrame([(2, None, 5), (3, "c", 3)], "k int, v string, n int")
    merged = relational.merge_latest(old, new, ["k"], rules={"v": F.coalesce("new.v", "old.v")})
    assert rows_of(merged) == [(1, "a", 1), (2, "b", 5), (3, "c", 3)]
    assert rows_of(relational.changed(old, merged, ["k"], ["v", "n"])) == [(2, "b", 5), (3, "c", 3)]
    path = f"file://{tmp_path}/parts"
    relational.replace_partitions(old, path, ["k"])
    relational.replace_partitions(new, path, ["k"])
    assert sorted((r.k, r.n) for r in spark.read.parquet(path).collect()) == [(1, 1), (2, 5), (3, 3)]


def test_sources(spark, tmp_path):
    for n, page in enumerate([[{"id": 1, "name": "a"}, {"id": 2}], [{"id": 3, "name": "c", "more": 1}]]):
        (tmp_path / f"page-{n}.json").write_text(json.dumps(page))
    spark.dataSource.register(paged.PagedSource)
    read = spark.read.format("pages").schema("id int, name string").options(path=f"file://{tmp_path}", pages=4).load()
    assert rows_of(read) == [(1, "a"), (2, None), (3, "c")]
    payload = {"points": [{"window_ending_at": "2026-04-01T00:00:00Z", "observed_24h_high": 10, "observed_24h_low": "5"}, {"window_ending_at": "bad", "observed_24h_high": 1, "observed_24h_low": 1}, {"bucket_started_at": "2026-04-02T00:00:00Z", "observed_24h_high": "1,200", "observed_24h_low": 0, "latest_players": 7}], "app": {"latest_24h_high": 9, "latest_24h_low": 0}}
    df = spark.createDataFrame([(1, json.dumps(payload)), (2, "no json"), (3, None)], "id int, body string")
    assert [(r.id, r.high, r.low, r.latest) for r in payloads.activity_points(df, "id", "body").orderBy("sampled_at").collect()] == [(1, 10, 5, 10), (1, 1200, 0, 7)]
    assert [(r.high, r.low) for r in payloads.activity_summary(df, "id", "body").filter("id = 1").collect()] == [(9, None)]
    feed = "<rss><channel><item><title> A game review </title><link>u</link><pubDate>Mon, 01 Jan 2024 10:00:00 +0000</pubDate><category>x</category></item><item><title>A puzzle game</title></item><item><title>Cooking</title></item></channel></rss>"
    entries = payloads.feed_entries(spark.createDataFrame([("s", feed)], "source string, xml string"), "source", "xml")
    assert [r.title for r in payloads.relevant(entries, ["game"], ["puzzle"]).collect()] == ["A game review"]
    assert payloads.deep_merge({"a": {"b": 1, "c": [1, {"x": 1}]}, "d": 2}, {"a": {"c": [{"x": 1}, 3]}, "d": 4, "e": 5}) == {"a": {"b": 1, "c": [1, {"x": 1}, 3]}, "d": 4, "e": 5}
    page = '<script type="application/ld+json">{"@graph": [{"name": "G"}, {"datePublished": "2024-01-01"}]}</script><script type="application/ld+json">[{"name": "H", "aggregateRating": {"ratingValue": "8.1"}}]</script>'
    assert rows_of(payloads.json_ld(spark.createDataFrame([(1, page), (2, "<p>")], "id int, html string"), "id", "html")) == [(1, "G", "2024-01-01", "8.1")]


def test_streams(spark, tmp_path):
    rows = [(1, f"2024-01-01 {h:02d}:00:00", v) for h, v in [(0, 10000.0), (1, 30000.0), (2, 31000.0), (3, 10000.0)]] + [(2, "2024-01-01 05:00:00", 5.0)]
    spark.createDataFrame(rows, "item int, t string, players double").select("item", F.col("t").cast("timestamp").alias("sampled_at"), "players").write.parquet(f"{tmp_path}/in")
    stream = lambda: spark.readStream.schema("item int, sampled_at timestamp, players double").parquet(f"{tmp_path}/in")

    def run(df, name, mode):
        q = df.writeStream.format("memory").queryName(name).outputMode(mode).option("checkpointLocation", f"{tmp_path}/{name}").trigger(availableNow=True).start()
        q.awaitTermination()
        return spark.table(name)

    day = run(jobs.rolling_activity(stream()), "day", "complete").filter("item = 1 AND window.start = TIMESTAMP '2024-01-01 00:00:00'").first()
    assert (day.high, day.low, day.n) == (31000.0, 10000.0, 4)
    assert [(r.item, r.players, r.marker) for r in run(jobs.quiet_markers(stream()), "marks", "append").collect()] == [(1, 30000.0, "major_surge")]
    assert run(jobs.once(stream(), ["item"], "sampled_at"), "once", "append").count() == 2
    seen = []
    jobs.upsert_each_batch(stream(), f"{tmp_path}/each", lambda batch, n: seen.append((n, batch.count()))).awaitTermination()
    assert sum(n for _, n in seen) == 5
