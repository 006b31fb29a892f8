"""Queries over the scalar functions, on values made from the tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import dates, hashing, scores, titles
from ..sources import bindings as b
from .registry import query, views

_GRADES = "['A+', 'b', 'C-', 'F', ' n/a ', 'Buy It', 'thumbs up', '']"
_RAW = f"""SELECT l_orderkey, l_linenumber, l_partkey, l_quantity AS q, CASE (l_orderkey + l_partkey) % 8 WHEN 0 THEN CAST(CAST(q AS INTEGER) AS VARCHAR) || '/50' WHEN 1 THEN CAST(CAST(q AS INTEGER) AS VARCHAR) || '%'
    WHEN 2 THEN {_GRADES}[CAST(q AS INTEGER) % 8 + 1] WHEN 3 THEN NULL WHEN 4 THEN CAST(CAST(q AS INTEGER) AS VARCHAR) || '.5' WHEN 5 THEN '1D' WHEN 6 THEN ' ' || CAST(CAST(q AS INTEGER) AS VARCHAR) || ' ' ELSE CAST(CAST(q AS INTEGER) AS VARCHAR) || ' / 10' END AS raw,
    CASE l_linenumber % 4 WHEN 0 THEN '10' WHEN 1 THEN NULL WHEN 2 THEN '100' ELSE 'x' END AS scale FROM lineitem"""
_TRY = "CASE WHEN regexp_full_match({0}, '[+-]?(\\d+\\.?\\d*|\\.\\d+)([eE][+-]?\\d+)?') THEN TRY_CAST({0} AS DOUBLE) END"
_NORMAL = f"""
    WITH r AS ({_RAW}), t AS (SELECT *, upper(trim(raw)) AS t, {_TRY.format("trim(scale)")} AS given FROM r),
    p AS (SELECT *, {_TRY.format("regexp_extract(t, '^(.*)%$', 1)")} AS pct, {_TRY.format("regexp_extract(t, '^([\\d.]+)\\s*/\\s*([\\d.]+)$', 1)")} AS top, {_TRY.format("regexp_extract(t, '^([\\d.]+)\\s*/\\s*([\\d.]+)$', 2)")} AS bottom, {_TRY.format("t")} AS v FROM t)"""
_SCORE = """CASE WHEN t IS NULL OR t IN ('N/A', 'BUY IT', 'THUMBS UP', '') THEN NULL WHEN t = 'A+' THEN 97 WHEN t = 'B' THEN 83 WHEN t = 'C-' THEN 70 WHEN t = 'F' THEN 50 WHEN pct IS NOT NULL THEN round(pct, 2) WHEN bottom > 0 THEN round(top / bottom * 100, 2) WHEN v IS NULL THEN NULL
    WHEN given > 0 AND v BETWEEN 0 AND given THEN round(v / given * 100, 2) WHEN given > 0 AND v BETWEEN 0 AND 100 THEN round(v, 2) WHEN given > 0 THEN NULL ELSE round(least(100, v * CASE WHEN v > 20 THEN 1 WHEN v > 10 THEN 5 WHEN v > 5 THEN 10 ELSE 20 END), 2) END"""


def raw_scores(spark, d):
    """Raw scores of all kinds, made from quantities."""
    q = F.col("l_quantity").cast("int").cast("string")
    kind = (F.col("l_orderkey") + F.col("l_partkey")) % 8
    grades = F.array(*map(F.lit, ["A+", "b", "C-", "F", " n/a ", "Buy It", "thumbs up", ""]))
    raw = F.when(kind == 0, F.concat(q, F.lit("/50"))).when(kind == 1, F.concat(q, F.lit("%"))).when(kind == 2, F.element_at(grades, F.col("l_quantity").cast("int") % 8 + 1)).when(kind == 4, F.concat(q, F.lit(".5"))).when(kind == 5, "1D")
    raw = raw.when(kind == 6, F.concat(F.lit(" "), q, F.lit(" "))).when(kind == 7, F.concat(q, F.lit(" / 10")))
    scale = F.when(F.col("l_linenumber") % 4 == 0, "10").when(F.col("l_linenumber") % 4 == 2, "100").when(F.col("l_linenumber") % 4 == 3, "x")
    return b.table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", F.col("l_quantity").alias("q"), raw.alias("raw"), scale.alias("scale"))


@query("FN-01_normalized_scores", _NORMAL + f" SELECT l_orderkey, l_linenumber, l_partkey, raw, CAST({_SCORE} AS DOUBLE) AS score FROM p")
def normalized_scores(spark, d):
    return raw_scores(spark, d).select("l_orderkey", "l_linenumber", "l_partkey", "raw", scores.normalize(F.col("raw"), F.col("scale"))["score"].alias("score"))


@query("FN-06_corrected_scores", _NORMAL + f" SELECT count(*) AS n, count(*) FILTER (corrected) AS changed, round(sum(CAST(coalesce(score, stored) AS DECIMAL(18, 2))), 2)::DOUBLE AS total FROM (SELECT *, score IS NOT NULL AND score IS DISTINCT FROM stored AS corrected FROM (SELECT {_SCORE} AS score, CAST(q * 2 AS DOUBLE) AS stored FROM p))")
def corrected_scores(spark, d):
    fixed = scores.corrected(F.col("raw"), F.col("scale"), F.col("q") * 2)
    rows = raw_scores(spark, d).select(fixed.alias("x")).select("x.*")
    return rows.agg(F.count("*").alias("n"), F.count_if("corrected").alias("changed"), F.sum(F.col("score").cast("decimal(18,2)")).cast("double").alias("total"))


@query("SNK-15_unscored_words", f"WITH r AS ({_RAW}) SELECT upper(trim(raw)) AS word, count(*) AS n FROM r WHERE upper(trim(raw)) IN ('N/A', 'BUY IT', 'THUMBS UP', '') GROUP BY 1")
def unscored_words(spark, d):
    word = F.upper(F.trim("raw"))
    return raw_scores(spark, d).filter(word.isin(*scores.UNSCORED)).groupBy(word.alias("word")).agg(F.count("*").alias("n"))


@query("FN-05_vote_bands", """SELECT p_partkey, CAST(p_size * 2 AS INTEGER) AS share, CASE WHEN p_size * 2 >= 95 THEN 'Overwhelmingly Positive' WHEN p_size * 2 >= 80 THEN 'Very Positive' WHEN p_size * 2 >= 70 THEN 'Mostly Positive' WHEN p_size * 2 >= 40 THEN 'Mixed' WHEN p_size * 2 >= 20 THEN 'Mostly Negative' ELSE 'Overwhelmingly Negative' END AS band FROM part""")
def vote_bands(spark, d):
    return b.table(spark, d, "part").select("p_partkey", (F.col("p_size") * 2).alias("share"), scores.vote_band(F.col("p_size") * 2).alias("band"))


@query("FN-03_positive_share", "SELECT o_custkey, round(100.0::DOUBLE * 1 * (count(*) FILTER (o_orderstatus = 'F')::DOUBLE / nullif(count(*) FILTER (o_orderstatus IN ('F', 'O')), 0)), 2) AS share FROM orders GROUP BY 1")
def positive_share(spark, d):
    counts = b.table(spark, d, "orders").groupBy("o_custkey").agg(F.count_if(F.col("o_orderstatus") == "F").alias("p"), F.count_if(F.col("o_orderstatus") == "O").alias("n"))
    return counts.select("o_custkey", scores.positive_share(F.col("p"), F.col("n")).alias("share"))


@query("FN-10_decay", views("articles", then="SELECT article, round(exp(-ln(2) * greatest((epoch(TIMESTAMP '2024-02-29 00:00:00') - epoch(published_at)) / 3600, 0) / 24), 6) AS weight FROM articles"))
def decay(spark, d):
    hours = (F.unix_timestamp(F.lit("2024-02-29 00:00:00")) - F.unix_timestamp(F.col("published_at").cast("timestamp"))) / 3600
    return b.articles(spark, d).select("article", F.round(scores.decay(hours), 6).alias("weight"))


@query("FN-13_quality_prior", """SELECT p_partkey, round(least(p_size * 4 / 150.0::DOUBLE, 1) * 0.35::DOUBLE + least(greatest(p_retailprice / 20, 0), 100) / 100 * 0.35::DOUBLE + greatest(p_size, coalesce(CASE WHEN p_partkey % 3 > 0 THEN p_size * 2 END, 0)) / 100.0::DOUBLE * 0.3::DOUBLE, 9) AS prior FROM part""")
def quality_prior(spark, d):
    size = F.col("p_size").cast("double")
    return b.table(spark, d, "part").select("p_partkey", F.round(F.least(F.lit(1.0), scores.quality_prior(size * 4, F.col("p_retailprice") / 20, size, F.when(F.col("p_partkey") % 3 > 0, size * 2))), 9).alias("prior"))


@query("FN-17_stable_hash", "SELECT p_partkey, sha256(p_name) AS digest, CAST((('0x' || sha256(p_name)[1:16])::UBIGINT) % 384 AS INTEGER) AS bucket FROM part")
def stable_hash(spark, d):
    return b.table(spark, d, "part").select("p_partkey", F.sha2("p_name", 256).alias("digest"), hashing.bucket(F.col("p_name"), 384).alias("bucket"))


@query("FN-22_normalized_titles", """SELECT p_partkey, trim(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(lower(trim(v)), '\\s*:\\s*', ' ', 'g'), '\\s*-\\s*', ' ', 'g'), '\\s+edition$', ''), '[™®©]', '', 'g'), '\\s+', ' ', 'g')) AS title FROM
    (SELECT p_partkey, p_name || CASE p_partkey % 3 WHEN 0 THEN ' : Two - Edition' WHEN 1 THEN '™  Three' ELSE ' EDITION' END AS v FROM part)""")
def normalized_titles(spark, d):
    k = F.col("p_partkey") % 3
    made = F.concat("p_name", F.when(k == 0, " : Two - Edition").when(k == 1, "™  Three").otherwise(" EDITION"))
    return b.table(spark, d, "part").select("p_partkey", titles.normalized_title(made).alias("title"))


@query("FN-24_title_similarity")
def title_similarity(spark, d):
    a = b.items(spark, d).select("item", titles.normalized_title(F.col("title")).alias("title"))
    pairs = a.join(a.select((F.col("item") - 1).alias("item"), F.col("title").alias("next")), "item")
    return pairs.select("item", F.round(titles.title_similarity("title", "next"), 6).alias("similarity"))


@query("FN-36_compact", "SELECT p_partkey, regexp_replace(lower(p_name), '[^a-z0-9]+', '', 'g') AS compact, regexp_replace(regexp_replace(lower(p_brand || ' & ' || p_type), '&', ' and ', 'g'), '[^a-z0-9]+', '-', 'g') AS slug FROM part")
def compact(spark, d):
    return b.table(spark, d, "part").select("p_partkey", titles.compact(F.col("p_name")).alias("compact"), titles.trimmed_slug(F.concat("p_brand", F.lit(" & "), "p_type")).alias("slug"))


@query("FN-32_html_text", r"""SELECT page_id, trim(regexp_replace(replace(replace(replace(replace(replace(replace(regexp_replace(regexp_replace(html, '(?is)<(?:script|style)\b.*?</(?:script|style)>', ' ', 'g'), '(?s)<[^>]*>', ' ', 'g'), '&nbsp;', ' '), '&lt;', '<'), '&gt;', '>'), '&quot;', '"'), '&#39;', ''''), '&amp;', '&'), '\s+', ' ', 'g')) AS text FROM pages""")
def html_text(spark, d):
    return b.table(spark, d, "pages").select("page_id", titles.strip_html(F.col("html")).alias("text"))


@query("FN-40_timing_modes", views("reviews", "items", then="""SELECT r.review_id, r.item, r.critic, CASE WHEN i.released IS NULL THEN NULL WHEN CAST(published_at AS DATE) < released THEN 'early' WHEN published_at > CAST(released + 60 AS TIMESTAMP) THEN 'late' ELSE 'launch_window' END AS by_time,
    CASE WHEN i.released IS NULL THEN NULL WHEN CAST(published_at + INTERVAL 9 HOUR AS DATE) < released THEN 'early' WHEN CAST(published_at + INTERVAL 9 HOUR AS DATE) - released > 60 THEN 'late' ELSE 'launch_window' END AS in_tokyo FROM reviews r JOIN items i ON r.item = i.item"""))
def timing_modes(spark, d):
    rows = b.reviews(spark, d).join(b.items(spark, d).select("item", "released"), "item")
    at = F.col("published_at").cast("timestamp")
    return rows.select("review_id", "item", "critic", dates.review_timing(at, F.col("released"), "timestamp").alias("by_time"), dates.review_timing(at, F.col("released"), "tokyo").alias("in_tokyo"))


@query("FN-41_local_days", "SELECT event_id, CAST(ts + INTERVAL 9 HOUR AS DATE) AS day, CAST(CAST(ts + INTERVAL 9 HOUR AS DATE) + 1 AS TIMESTAMP) - INTERVAL 9 HOUR AS hidden_from FROM events")
def local_days(spark, d):
    at = F.col("ts").cast("timestamp")
    return b.table(spark, d, "events").select("event_id", dates.local_day(at).alias("day"), dates.next_local_midnight(at).cast("timestamp_ntz").alias("hidden_from"))


@query("FN-42_dates_match", views("items", then="SELECT item, coalesce(abs(released - DATE '1996-06-01') <= 90, TRUE) AS near FROM items"))
def dates_match(spark, d):
    return b.items(spark, d).select("item", dates.dates_match(F.col("released"), F.lit("1996-06-01").cast("date")).alias("near"))


@query("FN-43_parsed_moments", """SELECT o_orderkey, CASE o_orderkey % 5 WHEN 0 THEN o_orderdate WHEN 1 THEN CAST(CAST(o_orderdate AS DATE) AS TIMESTAMP) WHEN 2 THEN TIMESTAMP '2024-01-31 12:00:00' - CAST(o_custkey % 9 AS INTEGER) * INTERVAL 7 DAY WHEN 3 THEN CAST(CAST(o_orderdate AS DATE) AS TIMESTAMP) END AS moment FROM orders""")
def parsed_moments(spark, d):
    k, at = F.col("o_orderkey") % 5, F.col("o_orderdate").cast("timestamp")
    text = F.when(k == 0, F.when(F.unix_timestamp(at) >= 1_000_000_000, (F.unix_timestamp(at) * 1000).cast("string")).otherwise(F.date_format(at, "yyyy-MM-dd HH:mm:ss"))).when(k == 1, F.date_format(at, "MMM d, yyyy"))
    text = text.when(k == 2, F.concat((F.col("o_custkey") % 9).cast("string"), F.lit(" weeks ago"))).when(k == 3, F.date_format(at, "yyyy-MM-dd'T00:00:00Z'")).otherwise("soon")
    return b.table(spark, d, "orders").select("o_orderkey", dates.parse_moment(text, F.lit("2024-01-31 12:00:00").cast("timestamp")).cast("timestamp_ntz").alias("moment"))


@query("FN-46_scraped_release", views("items", then="SELECT item, CASE WHEN released IS NULL THEN DATE '1996-06-01' + size WHEN (DATE '1996-06-01' + size) - released >= 120 THEN DATE '1996-06-01' + size ELSE released END AS released FROM items"))
def scraped_release(spark, d):
    return b.items(spark, d).select("item", dates.scraped_release(F.col("released"), F.date_add(F.lit("1996-06-01").cast("date"), F.col("size"))).alias("released"))
