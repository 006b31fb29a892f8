"""Queries on activity series and trends."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import labels
from ..operators import timeseries as ts
from ..operators import trending
from ..sources import bindings as b
from .registry import query, views

NOW = "2024-03-01 00:00:00"
_BLIPS = """+
    m AS (SELECT *, epoch_us(sampled_at) AS us, players = 0 AS zero FROM activity),
    g AS (SELECT *, count(*) FILTER (NOT zero) OVER w AS run, lead(us) OVER w AS nxt, lead(players) OVER w AS nxt_v FROM m WINDOW w AS (PARTITION BY item ORDER BY sampled_at, sample_id)),
    r AS (SELECT *, max(CASE WHEN NOT zero THEN us END) OVER p AS before, min(CASE WHEN zero THEN us END) OVER p AS start, last_value(us) OVER q AS last_at, last_value(nxt) OVER q AS last_nxt, last_value(nxt_v) OVER q AS last_v FROM g
          WINDOW p AS (PARTITION BY item, run), q AS (PARTITION BY item, run ORDER BY sampled_at, sample_id ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING)),
    kept AS (SELECT item, sample_id, sampled_at, players FROM r WHERE NOT (zero AND coalesce(start - before <= 7200000000 AND last_nxt - last_at <= 7200000000 AND last_v > 0, FALSE)))"""


@query("TS-01_without_blips", views("activity", then=_BLIPS + " SELECT * FROM kept"))
def without_blips(spark, d):
    return ts.without_blips(b.activity(spark, d))


_ROLL = """ SELECT item, sampled_at, sample_id, max(players) OVER w AS high, min(players) OVER w AS low, players AS latest, epoch_us(sampled_at) - min(epoch_us(sampled_at)) OVER {of} AS age FROM {rows}
    WINDOW w AS (PARTITION BY item ORDER BY epoch_us(sampled_at) RANGE BETWEEN 86400000000 PRECEDING AND CURRENT ROW), s AS (PARTITION BY item) QUALIFY age >= 86400000000"""


@query("TS-02_rolling_day", views("activity", then=_BLIPS + " SELECT * EXCLUDE age FROM (" + _ROLL.format(of="s", rows="kept") + ")"))
def rolling_day(spark, d):
    return ts.rolling_extremes(ts.without_blips(b.activity(spark, d)))


@query("WIN-09_rolling_day_strict", views("activity", then="+hours AS (SELECT item, date_trunc('hour', sampled_at) AS sampled_at, max(sample_id) AS sample_id, max(players) AS players FROM activity GROUP BY 1, 2) SELECT * EXCLUDE age FROM (" + _ROLL.format(of="w", rows="hours") + ")"))
def rolling_day_strict(spark, d):
    hours = b.activity(spark, d).groupBy("item", F.date_trunc("hour", "sampled_at").alias("sampled_at")).agg(F.max("sample_id").alias("sample_id"), F.max("players").alias("players"))
    return ts.rolling_extremes(hours.withColumn("sampled_at", F.col("sampled_at").cast("timestamp_ntz")), coverage="strict")


@query("WIN-10_baseline", views("activity", then="""SELECT item, sample_id, sampled_at, players, CASE WHEN count(players) OVER w >= 2 THEN quantile_cont(CAST(players AS DOUBLE), 0.5) OVER w END AS baseline FROM activity
    WINDOW w AS (PARTITION BY item ORDER BY epoch_us(sampled_at) RANGE BETWEEN 604800000000 PRECEDING AND 1 PRECEDING)"""))
def baseline(spark, d):
    return ts.baselines(b.activity(spark, d))


_STEP = """CASE WHEN s.marked IS NOT NULL AND x.us - s.marked < 172800000000 THEN
      {'us': x.us, 'players': x.players, 'base': x.base, 'marked': s.marked, 'drop_us': CASE WHEN x.us - s.drop_us > 604800000000 THEN NULL ELSE s.drop_us END, 'drop_p': s.drop_p, 'kind': '', 'gap': 0.0::DOUBLE, 'out': s.out}
    WHEN abs(x.players - x.base) >= 5000 AND abs(x.players - x.base) / x.base >= 0.30::DOUBLE THEN
      {'us': x.us, 'players': x.players, 'base': x.base, 'marked': x.us, 'drop_us': CASE WHEN x.players < x.base THEN x.us ELSE s.drop_us END, 'drop_p': CASE WHEN x.players < x.base THEN x.players ELSE s.drop_p END, 'kind': '', 'gap': 0.0::DOUBLE,
       'out': list_append(s.out, {'us': x.us, 'players': x.players, 'kind': CASE WHEN x.players > x.base THEN 'major_surge' ELSE 'major_drop' END, 'gap': abs(x.players - x.base)})}
    WHEN s.drop_us IS NOT NULL AND x.us > s.drop_us AND x.players - s.drop_p >= 5000 AND s.drop_p > 0 AND (x.players - s.drop_p) / s.drop_p >= 0.30::DOUBLE THEN
      {'us': x.us, 'players': x.players, 'base': x.base, 'marked': x.us, 'drop_us': NULL::BIGINT, 'drop_p': NULL::DOUBLE, 'kind': '', 'gap': 0.0::DOUBLE, 'out': list_append(s.out, {'us': x.us, 'players': x.players, 'kind': 'rebound', 'gap': x.players - s.drop_p})}
    ELSE {'us': x.us, 'players': x.players, 'base': x.base, 'marked': s.marked, 'drop_us': CASE WHEN x.us - s.drop_us > 604800000000 THEN NULL ELSE s.drop_us END, 'drop_p': s.drop_p, 'kind': '', 'gap': 0.0::DOUBLE, 'out': s.out} END"""
_EMPTY = "[{'us': 0::BIGINT, 'players': 0.0::DOUBLE, 'kind': '', 'gap': 0.0::DOUBLE}][2:1]"
_MARKERS = _BLIPS + f""", based AS (SELECT item, sample_id, epoch_us(sampled_at) AS us, CAST(players AS DOUBLE) AS players, CASE WHEN count(players) OVER w >= 2 THEN quantile_cont(CAST(players AS DOUBLE), 0.5) OVER w END AS base FROM kept
      WINDOW w AS (PARTITION BY item ORDER BY epoch_us(sampled_at) RANGE BETWEEN 604800000000 PRECEDING AND 1 PRECEDING)),
    walked AS (SELECT item, list_reduce(list({{'us': us, 'players': players, 'base': base, 'marked': NULL::BIGINT, 'drop_us': NULL::BIGINT, 'drop_p': NULL::DOUBLE, 'kind': '', 'gap': 0.0::DOUBLE, 'out': {_EMPTY}}} ORDER BY us, sample_id),
        lambda s, x: {_STEP}, {{'us': 0::BIGINT, 'players': 0.0::DOUBLE, 'base': 0.0::DOUBLE, 'marked': NULL::BIGINT, 'drop_us': NULL::BIGINT, 'drop_p': NULL::DOUBLE, 'kind': '', 'gap': 0.0::DOUBLE, 'out': {_EMPTY}}}).out AS out FROM based WHERE base > 0 GROUP BY item),
    marks AS (SELECT item, m.us, m.players, m.kind, m.gap FROM (SELECT item, unnest(out) AS m FROM walked)
      UNION ALL SELECT item, us, players, 'first_tracked', NULL FROM (SELECT item, us, players FROM based QUALIFY row_number() OVER (PARTITION BY item ORDER BY us, sample_id) = 1)
      UNION ALL SELECT item, us, players, 'all_time_peak', NULL FROM (SELECT item, epoch_us(sampled_at) AS us, CAST(players AS DOUBLE) AS players FROM activity QUALIFY row_number() OVER (PARTITION BY item ORDER BY players DESC, sampled_at) = 1)),
    said AS (SELECT item, us AS "at", players, kind AS marker, format('{{:,}}', CAST(players AS BIGINT)) AS n, format('{{:,}}', CAST(round_even(gap, 0) AS BIGINT)) AS g FROM marks)
    SELECT item, "at", players, marker, CASE marker WHEN 'first_tracked' THEN 'First Activity Sample' WHEN 'all_time_peak' THEN 'All-Time Peak' WHEN 'major_surge' THEN 'Major Surge' WHEN 'major_drop' THEN 'Major Drop' ELSE 'Rebound' END AS label,
      CASE marker WHEN 'first_tracked' THEN 'Started tracking at ' || n || '.' WHEN 'all_time_peak' THEN 'All-time peak reached ' || n || '.' WHEN 'major_surge' THEN n || ' was ' || g || ' above the prior 7-day median.' WHEN 'major_drop' THEN n || ' was ' || g || ' below the prior 7-day median.' ELSE 'Recovered by ' || g || ' players from the recent drop.' END AS detail FROM said"""


@query("TS-03_markers", views("activity", then=_MARKERS))
def markers(spark, d):
    rows = b.activity(spark, d)
    return ts.markers(rows, peaks=ts.peaks(rows)).withColumn("at", F.unix_micros("at"))


@query("TS-04_buckets", views("activity", then="""+
    s AS (SELECT item, greatest(3600, CAST(ceil((max(CAST(floor(epoch(sampled_at)) AS BIGINT)) - min(CAST(floor(epoch(sampled_at)) AS BIGINT))) / 24) AS BIGINT)) AS width FROM activity GROUP BY item)
    SELECT a.item, CAST(floor(floor(epoch(sampled_at)) / width) AS BIGINT) AS bucket, max(players) AS high, min(CASE WHEN players > 0 THEN players END) AS low, max_by(players, {'t': sampled_at, 'i': sample_id}) AS latest
    FROM activity a JOIN s ON a.item = s.item GROUP BY 1, 2"""))
def buckets(spark, d):
    return ts.buckets(b.activity(spark, d), 24)


@query("SRT-10_thinned", views("activity", then="""+
    n AS (SELECT *, row_number() OVER (PARTITION BY item ORDER BY sampled_at, sample_id) - 1 AS n, count(*) OVER (PARTITION BY item) - 1 AS last FROM activity)
    SELECT item, sample_id, sampled_at, players FROM n WHERE last < 16 OR n IN (SELECT CAST(round_even(i * last / 15.0, 0) AS BIGINT) FROM range(16) t(i))"""))
def thinned(spark, d):
    return ts.thin(b.activity(spark, d), 16, ["item"], ["sampled_at", "sample_id"])


@query("CLI-09_thinned_half_up", views("activity", then="""+
    n AS (SELECT *, row_number() OVER (PARTITION BY item ORDER BY sampled_at, sample_id) - 1 AS n, count(*) OVER (PARTITION BY item) - 1 AS last FROM activity)
    SELECT item, sample_id, sampled_at, players FROM n WHERE last < 9 OR n IN (SELECT CAST(floor(i * last / 8.0 + 0.5) AS BIGINT) FROM range(9) t(i))"""))
def thinned_half_up(spark, d):
    return ts.thin(b.activity(spark, d), 9, ["item"], ["sampled_at", "sample_id"], half_even=False)


@query("WIN-12_rolling_mean", views("activity", then="""+
    v AS (SELECT item, sample_id, sampled_at, CASE WHEN players > 0 THEN players END AS v FROM activity)
    SELECT item, sample_id, CASE WHEN v IS NOT NULL THEN CAST(sum(v) OVER w AS DOUBLE) / count(v) OVER w END AS mean FROM v WINDOW w AS (PARTITION BY item ORDER BY sampled_at, sample_id ROWS BETWEEN 4 PRECEDING AND CURRENT ROW)"""))
def rolling_mean(spark, d):
    rows = b.activity(spark, d).withColumn("v", F.when(F.col("players") > 0, F.col("players")))
    return rows.select("item", "sample_id", ts.rolling_mean("v", ["item"], ["sampled_at", "sample_id"], 5).alias("mean"))


@query("FLT-13_trailing_week", views("activity", then="SELECT * FROM activity QUALIFY epoch(sampled_at) >= max(floor(epoch(sampled_at))) OVER (PARTITION BY item) - 604800"))
def trailing_week(spark, d):
    return ts.trailing(b.activity(spark, d), "item", "sampled_at", 604800).select("item", "sample_id", "sampled_at", "players")


@query("AGG-14_series_coverage", views("activity", then="SELECT item, min(sampled_at) AS first_at, max(sampled_at) AS last_at, count(*) AS n FROM activity GROUP BY item"))
def series_coverage(spark, d):
    return b.activity(spark, d).groupBy("item").agg(F.min("sampled_at").alias("first_at"), F.max("sampled_at").alias("last_at"), F.count("*").alias("n"))


@query("JOI-13_aligned_series", views("activity", then="""+
    day AS (SELECT item, CAST(sampled_at AS DATE) AS day, max(players) AS high FROM activity GROUP BY 1, 2), snap AS (SELECT item, CAST(sampled_at AS DATE) AS day, max_by(players, sample_id) AS at_last_id FROM activity WHERE sample_id % 2 = 0 GROUP BY 1, 2)
    SELECT day.item, day.day, high, at_last_id FROM day LEFT JOIN snap ON day.item = snap.item AND day.day = snap.day"""))
def aligned_series(spark, d):
    rows = b.activity(spark, d).withColumn("day", F.to_date("sampled_at"))
    days = rows.groupBy("item", "day").agg(F.max("players").alias("high"))
    return days.join(rows.filter("sample_id % 2 = 0").groupBy("item", "day").agg(F.max_by("players", "sample_id").alias("at_last_id")), ["item", "day"], "left")


_STOP = "['the','a','an','and','or','of','to','in','on','for','with','is','are','at','by','from','new','game','games','review','trailer','news','update','how','why','what','this','that']"
_ROMAN = "['i','ii','iii','iv','v','vi','vii','viii','ix','x','xi','xii','xiii','xiv','xv','xvi','xvii','xviii','xix','xx']"


def topic_sql(title: str) -> str:
    every = f"list_filter(string_split(regexp_replace(lower({title}), '[^a-z0-9]+', ' ', 'g'), ' '), lambda w: w <> '')"
    telling = f"list_filter({every}, lambda w: NOT list_contains({_STOP}, w) AND (length(w) > 2 OR regexp_full_match(w, '\\d+') OR list_contains({_ROMAN}, w)))"
    first = f"list_slice(CASE WHEN len({telling}) > 0 THEN {telling} ELSE {every} END, 1, 3)"
    arabic = f"list_transform({first}, lambda w: CASE WHEN list_contains({_ROMAN}, w) THEN CAST(list_position({_ROMAN}, w) AS VARCHAR) WHEN regexp_full_match(w, '\\d+') THEN coalesce(nullif(ltrim(w, '0'), ''), '0') ELSE w END)"
    return f"coalesce(nullif(array_to_string({arabic}, ' '), ''), 'untitled')"


@query("FN-30_topic_keys", views("articles", then=f"SELECT article, {topic_sql('headline')} AS topic FROM articles"))
def topic_keys(spark, d):
    from ..functions import titles

    return b.articles(spark, d).select("article", titles.topic_key(F.col("headline")).alias("topic"))


_SIGNALS = f"""+
    rows AS (SELECT a.article, a.item, i.released, a.source, a.published_at AS t, CASE WHEN a.item IS NOT NULL THEN 'item:' || a.item ELSE 'topic:' || {topic_sql("trim(regexp_replace(headline, '\\s+', ' ', 'g'))")} END AS trend_key,
        coalesce(i.title, coalesce(nullif(trim(regexp_replace(headline, '\\s+', ' ', 'g')), ''), 'Untitled')) AS title, (epoch(TIMESTAMP '{NOW}') - epoch(a.published_at)) / 3600 AS age
        FROM articles a LEFT JOIN items i ON a.item = i.item WHERE a.published_at >= TIMESTAMP '{NOW}' - INTERVAL 48 HOUR),
    b AS (SELECT trend_key, max(item) AS item, max(released) AS released, max_by(title, {{'a': t, 'b': article, 'c': title}}) AS title, max(t) AS latest_at, count(*) AS mentions, count(DISTINCT source) AS sources,
        sum(exp(-ln(2) * greatest(age, 0) / 24)) AS weighted, count(*) FILTER (age <= 12) - count(*) FILTER (age > 12 AND age <= 24) AS momentum FROM rows GROUP BY trend_key),
    signals AS (SELECT trend_key, item, released, title, latest_at, mentions, sources, round(weighted + least(sources, 5) * 0.35::DOUBLE + greatest(0.0::DOUBLE, least(2.5::DOUBLE, momentum * 0.4::DOUBLE)), 4) AS score FROM b WHERE item IS NOT NULL OR mentions >= 2)"""


@query("TRD-01_news_signals", views("articles", "items", then=_SIGNALS + " SELECT * FROM signals WHERE score > 0"))
def news_signals(spark, d):
    found = trending.news_signals(b.articles(spark, d), b.items(spark, d), NOW)
    return found.withColumn("latest_at", F.col("latest_at").cast("timestamp_ntz"))


def _inferred_sql(headline: str) -> str:
    """CTEs up to inferred (article, title): what a headline seems to begin with."""
    lists = {n: ", ".join(repr(w) for w in getattr(labels, f"HEADLINE_{n}")) for n in ("BREAKS", "STARTS", "REJECTS", "MINOR")}
    words = f"list_filter(string_split(regexp_replace(lower({headline}), '[^a-z0-9]+', ' ', 'g'), ' '), lambda w: w <> '' AND w <> 's')"
    return f"""w AS (SELECT article, {words} AS w FROM recent WHERE item IS NULL), c AS (SELECT article, w, list_min(list_filter(list_transform(w, lambda x, i: CASE WHEN i > 1 AND x IN ({lists['BREAKS']}) THEN i - 1 END), lambda i: i IS NOT NULL)) AS cut FROM w),
    h AS (SELECT article, list_slice(w, 1, coalesce(cut, len(w))) AS h FROM c), p AS (SELECT article, list_slice(h, 1, least(8, coalesce(list_max(list_transform(h, lambda x, i: CASE WHEN x NOT IN ({lists['MINOR']}) THEN i END)), 0))) AS s FROM h),
    inferred AS (SELECT article, array_to_string(list_transform(s, lambda x, i: CASE WHEN regexp_full_match(x, '[ivxlcdm]+') THEN upper(x) WHEN i > 1 AND x IN ({lists['MINOR']}) THEN x ELSE upper(x[1]) || x[2:] END), ' ') AS title FROM p
      WHERE len(s) >= 2 AND s[1] NOT IN ({lists['STARTS']}) AND NOT regexp_full_match(s[1], '[0-9]+') AND len(list_filter(s, lambda x: x IN ({lists['REJECTS']}))) = 0)"""


_INFERRED = f"""+
    recent AS (SELECT * FROM articles WHERE published_at >= TIMESTAMP '{NOW}' - INTERVAL 48 HOUR), {_inferred_sql("trim(regexp_replace(headline, '\\s+', ' ', 'g'))")},
    rows AS (SELECT a.article, a.item, i.released, a.source, a.published_at AS t, CASE WHEN a.item IS NOT NULL THEN 'item:' || a.item ELSE 'topic:' || {topic_sql('n.title')} END AS trend_key,
        coalesce(i.title, n.title, coalesce(nullif(trim(regexp_replace(headline, '\\s+', ' ', 'g')), ''), 'Untitled')) AS title, (epoch(TIMESTAMP '{NOW}') - epoch(a.published_at)) / 3600 AS age
        FROM recent a LEFT JOIN items i ON a.item = i.item LEFT JOIN inferred n ON n.article = a.article WHERE a.item IS NOT NULL OR n.title IS NOT NULL),
    b AS (SELECT trend_key, max(item) AS item, max(released) AS released, max_by(title, {{'a': t, 'b': article, 'c': title}}) AS title, max(t) AS latest_at, count(*) AS mentions, count(DISTINCT source) AS sources,
        sum(exp(-ln(2) * greatest(age, 0) / 24)) AS weighted, count(*) FILTER (age <= 12) - count(*) FILTER (age > 12 AND age <= 24) AS momentum FROM rows GROUP BY trend_key)
    SELECT trend_key, item, released, title, latest_at, mentions, sources, round(weighted + least(sources, 5) * 0.35::DOUBLE + greatest(0.0::DOUBLE, least(2.5::DOUBLE, momentum * 0.4::DOUBLE)), 4) AS score FROM b WHERE item IS NOT NULL OR mentions >= 2"""


@query("TRD-01_inferred", views("articles", "items", then=_INFERRED))
def inferred_signals(spark, d):
    """Unlinked articles by the title that their headline seems to begin with."""
    found = trending.news_signals(b.articles(spark, d), b.items(spark, d), NOW, infer=True)
    return found.withColumn("latest_at", F.col("latest_at").cast("timestamp_ntz"))


@query("TRD-01_spellings")
def spellings(spark, d):
    """The same, and titles that are spelt nearly alike are one topic."""
    found = trending.news_signals(b.articles(spark, d), b.items(spark, d), NOW, infer=True, share=0.6)
    return found.withColumn("latest_at", F.col("latest_at").cast("timestamp_ntz"))


@query("TRD-03_ranked", views("articles", "items", then=_SIGNALS + f""",
    aged AS (SELECT *, date_diff('day', released, DATE '{NOW[:10]}') AS days FROM signals WHERE score > 0),
    weighed AS (SELECT *, round(score * CASE WHEN days IS NULL OR days <= 120 THEN 1.0 ELSE least(1.0::DOUBLE, CASE WHEN days <= 180 THEN 0.75 WHEN days <= 365 THEN 0.25 WHEN days <= 730 THEN 0.2 WHEN days <= 1825 THEN 0.15 ELSE 0.1 END::DOUBLE
        + CASE WHEN mentions >= 10 AND sources >= 5 THEN 0.15 ELSE 0 END::DOUBLE + CASE WHEN mentions >= 16 AND sources >= 6 THEN 0.2 ELSE 0 END::DOUBLE) END, 6) AS s FROM aged)
    SELECT CAST(row_number() OVER (ORDER BY s DESC, latest_at DESC, mentions DESC, lower(title), trend_key) AS INTEGER) AS rank, trend_key, title, mentions, sources, round(s, 4) AS trend_score FROM weighed ORDER BY rank LIMIT 20"""))
def ranked(spark, d):
    return trending.ranked(trending.merge_signals([trending.news_signals(b.articles(spark, d), b.items(spark, d), NOW)]), NOW)
