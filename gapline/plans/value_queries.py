"""More queries over scalar functions: scores, labels, titles, links, payloads."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import dates, labels, scores, titles
from ..operators import similarity
from ..sources import bindings as b
from .registry import query, views

_WORDS = "list_filter(string_split(regexp_replace(lower({}), '[^a-z0-9]+', ' ', 'g'), ' '), lambda w: w <> '')"
_ROMANS = "['" + "', '".join(titles.ROMAN) + "']"
_ARABIC = f"CASE WHEN list_position({_ROMANS}, w) > 0 THEN CAST(list_position({_ROMANS}, w) AS VARCHAR) WHEN regexp_full_match(w, '[0-9]+') THEN CAST(CAST(w AS BIGINT) AS VARCHAR) ELSE w END"


def _in(words: list[str]) -> str:
    return ", ".join(f"'{w}'" for w in words)


@query("FN-02_detected_scale", "SELECT l_orderkey, l_linenumber, l_quantity AS q, CASE WHEN l_quantity > 20 THEN '100' WHEN l_quantity > 10 THEN '20' WHEN l_quantity > 5 THEN '10' ELSE '5' END AS scale FROM lineitem")
def detected_scale(spark, d):
    return b.table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", F.col("l_quantity").alias("q"), scores.detect_scale(F.col("l_quantity")).alias("scale"))


@query("FN-04_tenfold", "SELECT l_orderkey, l_linenumber, l_quantity AS q, round(l_quantity / 8 * 10, 2) AS score FROM lineitem")
def tenfold(spark, d):
    return b.table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", F.col("l_quantity").alias("q"), scores.tenfold(F.col("l_quantity") / 8).alias("score"))


@query("FN-07_review_disparity", views("user_scores", then="""+r AS (SELECT u.user_id, p_partkey AS item, p_size * 2.0 AS critic, score_a, score_b FROM part JOIN user_scores u ON p_partkey % 150 = u.user_id),
    t AS (SELECT *, CAST(round(critic * 1000) - round(score_a * 1000) AS BIGINT) AS a, CAST(round(critic * 1000) - round(score_b * 1000) AS BIGINT) AS c FROM r)
    SELECT item, a AS d_a, c AS d_b, CAST(CASE WHEN a IS NOT NULL AND c IS NOT NULL THEN trunc((a + c) / 2) ELSE coalesce(a, c) END AS BIGINT) AS d FROM t"""))
def one_review_disparity(spark, d):
    from ..operators import disparity
    from .disparity_queries import user_scores

    rows = b.items(spark, d).join(user_scores(spark, d), b.user_of() == F.col("user_id")).withColumn("critic", F.col("size") * 2.0)
    diff = lambda c: disparity.thousandths(F.col("critic")) - disparity.thousandths(F.col(c))
    return rows.select("item", diff("score_a").alias("d_a"), diff("score_b").alias("d_b")).withColumn("d", disparity.combined(F.col("d_a"), F.col("d_b")))


@query("FN-08_recommendations", """SELECT p_partkey, coalesce(regexp_matches(lower(concat_ws(' ', CASE WHEN p_size % 7 = 0 THEN 'Thumbs' ELSE p_type END, p_name)), 'recommend|yes/no|thumb|verdict|binary'), FALSE) OR base IS NULL OR base IN (0, 1) AS is_recommendation
    FROM (SELECT *, CASE WHEN p_partkey % 11 = 0 THEN NULL ELSE p_size % 10 END AS base FROM part)""")
def recommendations(spark, d):
    base = F.when(F.col("size") % 10 >= 0, F.when(F.col("item") % 11 != 0, F.col("size") % 10))
    kind = F.when(F.col("size") % 7 == 0, "Thumbs").otherwise(F.col("type"))
    return b.items(spark, d).select(F.col("item").alias("p_partkey"), scores.recommendation(kind, F.col("title"), base).alias("is_recommendation"))


@query("FN-09_placeholders", "SELECT p_partkey, CASE WHEN p_size - 20 >= 0 THEN p_size - 20 END AS score FROM part")
def placeholders(spark, d):
    return b.table(spark, d, "part").select("p_partkey", scores.known(F.col("p_size") - 20).alias("score"))


@query("FN-11_news_score", "SELECT p_partkey, round(p_size / 4.0::DOUBLE + least(p_partkey % 9, 5) * 0.35::DOUBLE + greatest(0, least(2.5::DOUBLE, (p_size % 13 - 4) * 0.4::DOUBLE)), 9) AS score FROM part")
def news_scores(spark, d):
    return b.table(spark, d, "part").select("p_partkey", F.round(scores.news_score(F.col("p_size") / 4.0, F.col("p_partkey") % 9, F.col("p_size") % 13 - 4), 9).alias("score"))


@query("FN-12_age_weight", views("items", then="""+a AS (SELECT item, CAST(DATE '1999-06-01' - released AS INTEGER) AS age, size AS mentions, size % 9 AS sources FROM items)
    SELECT item, CASE WHEN age IS NULL OR age <= 120 THEN 1 ELSE least(1, round(CASE WHEN age <= 180 THEN 0.75::DOUBLE WHEN age <= 365 THEN 0.25::DOUBLE WHEN age <= 730 THEN 0.2::DOUBLE WHEN age <= 1825 THEN 0.15::DOUBLE ELSE 0.1::DOUBLE END + CASE WHEN mentions >= 10 AND sources >= 5 THEN 0.15::DOUBLE ELSE 0 END
        + CASE WHEN mentions >= 16 AND sources >= 6 THEN 0.2::DOUBLE ELSE 0 END, 9)) END AS weight FROM a"""))
def age_weights(spark, d):
    age = F.datediff(F.lit("1999-06-01").cast("date"), "released")
    return b.items(spark, d).select("item", F.round(scores.age_weight(age, F.col("size"), F.col("size") % 9), 9).alias("weight"))


@query("FN-14_quantized", """SELECT p_partkey, round(least(1, p_size * 8 / 300.0::DOUBLE), 4) AS taxonomy, CASE WHEN p_size * 8 / 300.0::DOUBLE >= 0.82 THEN 'high' WHEN p_size * 8 / 300.0::DOUBLE >= 0.7 THEN 'medium' ELSE 'low' END AS confidence FROM part""")
def quantized(spark, d):
    part = scores.share_of(F.col("p_size") * 8, similarity.DIVISOR)
    return b.table(spark, d, "part").select("p_partkey", scores.quantized(part).alias("taxonomy"), scores.confidence_band(part).alias("confidence"))


@query("FN-15_disparity_bands", """SELECT p_partkey, p_size - 25 AS d, CASE WHEN abs(p_size - 25) >= 15 THEN 'extreme' WHEN abs(p_size - 25) >= 10 THEN 'high' WHEN abs(p_size - 25) >= 5 THEN 'moderate' ELSE 'low' END AS band,
    CASE WHEN p_size - 25 >= 5 THEN 'generous' WHEN p_size - 25 <= -5 THEN 'critical' ELSE 'aligned' END AS leaning FROM part""")
def disparity_bands(spark, d):
    x = F.col("p_size") - 25
    return b.table(spark, d, "part").select("p_partkey", x.alias("d"), scores.disparity_band(x).alias("band"), scores.leaning(x).alias("leaning"))


@query("FN-16_snapshot_key", "SELECT p_partkey, lpad(lower(to_hex(list_reduce(list_transform(string_split(p_name || ':' || p_partkey, ''), lambda c: CAST(ord(c) AS BIGINT)), lambda h, c: (xor(h, c) * 16777619) % 4294967296, CAST(2166136261 AS BIGINT)))), 8, '0') AS key FROM part")
def snapshot_key(spark, d):
    return b.table(spark, d, "part").select("p_partkey", labels.fnv32(F.concat("p_name", F.lit(":"), F.col("p_partkey").cast("string"))).alias("key"))


_LABEL = "trim(regexp_replace(replace(replace(lower({0}), '&', ' and '), '''', ''), '[^a-z0-9]+', ' ', 'g'))"
_RAW = "p_type || ' & ' || p_brand || CASE p_partkey % 4 WHEN 0 THEN ' PvP' WHEN 1 THEN ' mmo''s' ELSE '' END"


@query("FN-21_tokens", f"""WITH t AS (SELECT p_partkey, replace({_LABEL.format(_RAW)}, ' ', '_') AS token FROM part)
    SELECT p_partkey, token, array_to_string(list_transform(list_filter(string_split(token, '_'), lambda p: p <> ''), lambda p: CASE p WHEN 'mmo' THEN 'MMO' WHEN 'pvp' THEN 'PvP' ELSE upper(p[1]) || p[2:] END), ' ') AS shown, 'shop/' || token AS provenance FROM t""")
def tokens(spark, d):
    raw = F.concat("p_type", F.lit(" & "), "p_brand", F.when(F.col("p_partkey") % 4 == 0, " PvP").when(F.col("p_partkey") % 4 == 1, " mmo's").otherwise(""))
    tok = labels.token(raw)
    return b.table(spark, d, "part").select("p_partkey", tok.alias("token"), labels.shown(tok).alias("shown"), labels.provenance(F.concat(F.lit("Shop/"), raw)).alias("provenance"))


_TITLES = "p_name || CASE p_partkey % 6 WHEN 0 THEN ': Delta Two' WHEN 1 THEN ' - Gold Edition' WHEN 2 THEN ' Δ' WHEN 3 THEN ': Chapters 1 & 2' WHEN 4 THEN ' Episode 3 extra' ELSE '' END"


def varied_titles(spark, d):
    k = F.col("p_partkey") % 6
    end = F.when(k == 0, ": Delta Two").when(k == 1, " - Gold Edition").when(k == 2, " Δ").when(k == 3, ": Chapters 1 & 2").when(k == 4, " Episode 3 extra").otherwise("")
    return b.table(spark, d, "part").select("p_partkey", F.concat("p_name", end).alias("title"))


_VARIANTS = r"""[title, CASE WHEN regexp_matches(title, '(?i)\bdelta\b') THEN regexp_replace(title, '(?i)\bdelta\b', 'Δ', 'g') END, CASE WHEN contains(title, 'Δ') THEN replace(title, 'Δ', 'Delta') END, {halves}
    regexp_replace(title, '(?i)\s*[:\-]?\s*(?:chapters?\s+\d+(?:\s*(?:&|and|,)\s*\d+)*.*|episode\s+\d+.*)$', ''), regexp_replace(title, '(?i)\s*[:\-]?\s*(?:collection|bundle|pack|anthology|compilation|(?:complete|definitive|deluxe|ultimate|gold|goty|game\s+of\s+the\s+year)\s+edition)\s*$', '')]"""
_HALVES = "CASE WHEN contains(title, ':') THEN split_part(title, ':', 1) END, CASE WHEN contains(title, ':') THEN substr(title, strpos(title, ':') + 1) END, CASE WHEN contains(title, ' - ') THEN split_part(title, ' - ', 1) END, CASE WHEN contains(title, ' - ') THEN substr(title, strpos(title, ' - ') + 3) END,"
_LISTED = "array_to_string(list_sort(list_distinct(list_filter(list_transform(list_filter({0}, lambda v: v IS NOT NULL), lambda v: trim(v)), lambda v: v <> ''))), '|')"


@query("FN-23_search_queries", f"WITH t AS (SELECT p_partkey, {_TITLES} AS title FROM part) SELECT p_partkey, {_LISTED.format(_VARIANTS.format(halves=_HALVES))} AS queries, {_LISTED.format(_VARIANTS.format(halves=''))} AS similar_titles FROM t")
def search_queries(spark, d):
    listed = lambda v: F.array_join(F.array_sort(v), "|")
    return varied_titles(spark, d).select("p_partkey", listed(labels.search_queries(F.col("title"))).alias("queries"), listed(labels.search_queries(F.col("title"), splits=False)).alias("similar_titles"))


_MARKERS = f"list_sort(list_distinct(list_filter(list_transform({_WORDS.format('{0}')}, lambda w: {_ARABIC}), lambda w: regexp_full_match(w, '[0-9]+') AND NOT regexp_full_match(w, '(19|20)[0-9][0-9]'))))"
_NUMBERED = "p_name || CASE p_partkey % 5 WHEN 0 THEN ' II' WHEN 1 THEN ' 2' WHEN 2 THEN ' 1999' WHEN 3 THEN ' VII 03' ELSE '' END"


def numbered_titles(spark, d):
    k = F.col("p_partkey") % 5
    return b.table(spark, d, "part").select("p_partkey", F.concat("p_name", F.when(k == 0, " II").when(k == 1, " 2").when(k == 2, " 1999").when(k == 3, " VII 03").otherwise("")).alias("title"))


@query("FN-26_series_markers", f"WITH t AS (SELECT p_partkey, {_NUMBERED} AS title FROM part) SELECT p_partkey, array_to_string({_MARKERS.format('title')}, ',') AS markers, array_to_string(list_filter({_WORDS.format('title')}, lambda w: length(w) > 1 AND NOT list_contains([{_in(titles.STOP)}], w)), ' ') AS core FROM t")
def series_markers(spark, d):
    t = F.col("title")
    return numbered_titles(spark, d).select("p_partkey", F.array_join(titles.series_markers(t), ",").alias("markers"), F.array_join(titles.content_words(t), " ").alias("core"))


@query("FN-25_related_titles", f"""WITH t AS (SELECT p_partkey, {_NUMBERED} AS title FROM part), p AS (SELECT a.p_partkey, {_WORDS.format('a.title')} AS x, {_WORDS.format('c.title')} AS y, {_MARKERS.format('a.title')} AS m, {_MARKERS.format('c.title')} AS n FROM t a JOIN t c ON c.p_partkey = a.p_partkey + 5)
    SELECT p_partkey, len(list_filter(m, lambda w: NOT list_contains(n, w))) = 0 AND len(list_intersect(x, y)) / greatest(1, least(len(list_distinct(x)), len(list_distinct(y)))) >= 0.5 AND len(list_filter(list_intersect(x, y), lambda w: length(w) >= 4)) > 0 AS related FROM p""")
def related_titles(spark, d):
    a = numbered_titles(spark, d)
    pairs = a.join(a.select((F.col("p_partkey") - 5).alias("p_partkey"), F.col("title").alias("other")), "p_partkey")
    return pairs.select("p_partkey", titles.titles_related(F.col("title"), F.col("other"), F.lit(0.5)).alias("related"))


_SLUG = "trim(regexp_replace(replace(replace(replace(lower({0}), '&', ' and '), '''', ''), '’', ''), '[^a-z0-9]+', '-', 'g'), '-')"


@query("FN-27_slug_candidates", f"""WITH t AS (SELECT p_partkey, {_NUMBERED} || ' & the ' || p_type AS title FROM part), s AS (SELECT p_partkey, {_SLUG.format('title')} AS s FROM t),
    v AS (SELECT p_partkey, [s, array_to_string(list_filter(string_split(s, '-'), lambda w: w NOT IN ('and', 'the', 'of', 'a')), '-'), array_to_string(list_transform(string_split(s, '-'), lambda w: {_ARABIC}), '-'),
        array_to_string(list_transform(string_split(s, '-'), lambda w: CASE WHEN regexp_full_match(w, '[1-9]|1[0-9]|20') THEN {_ROMANS}[CAST(w AS INTEGER)] ELSE w END), '-')] AS v FROM s) SELECT p_partkey, array_to_string(list_sort(list_distinct(v)), '|') AS slugs FROM v""")
def slug_candidates(spark, d):
    made = numbered_titles(spark, d).join(b.table(spark, d, "part").select("p_partkey", "p_type"), "p_partkey")
    return made.select("p_partkey", F.array_join(F.array_sort(titles.slug_candidates(F.concat("title", F.lit(" & the "), "p_type"))), "|").alias("slugs"))


@query("FN-28_variant_keys", r"""SELECT p_partkey, regexp_replace(trim(regexp_replace(lower(p_name || CASE p_partkey % 3 WHEN 0 THEN ': Gold Edition' WHEN 1 THEN ' (Remastered)' ELSE ' Deluxe!' END), '[^a-z0-9]+', ' ', 'g')), '(?: (?:edition|remastered|definitive|complete|goty|deluxe|ultimate|gold))+$', '') AS key FROM part""")
def variant_keys(spark, d):
    k = F.col("p_partkey") % 3
    return b.table(spark, d, "part").select("p_partkey", titles.variant_key(F.concat("p_name", F.when(k == 0, ": Gold Edition").when(k == 1, " (Remastered)").otherwise(" Deluxe!"))).alias("key"))


@query("FN-29_clean_headlines", views("articles", then=r"""SELECT article, CASE WHEN h = '' THEN 'Untitled' ELSE h END AS headline FROM (SELECT article, trim(regexp_replace(regexp_replace(headline || CASE article % 3 WHEN 0 THEN ' - ' || source WHEN 1 THEN ' |' || upper(source) || ' ' ELSE '' END,
    '(?i)\s*(?:-|\||:|–|—)\s*' || regexp_escape(source) || '\s*$', ''), '\s+', ' ', 'g')) AS h FROM articles WHERE source IS NOT NULL)"""))
def clean_headlines(spark, d):
    k = F.col("article") % 3
    end = F.when(k == 0, F.concat(F.lit(" - "), "source")).when(k == 1, F.concat(F.lit(" |"), F.upper("source"), F.lit(" "))).otherwise("")
    return b.articles(spark, d).filter("source IS NOT NULL").select("article", titles.clean_headline(F.concat("headline", end), F.col("source")).alias("headline"))


_INFER = f"""WITH w AS (SELECT item_id, list_filter({_WORDS.format('text')}, lambda w: w <> 's') AS w FROM benchmark), c AS (SELECT item_id, w, list_min(list_filter(list_transform(w, lambda x, i: CASE WHEN i > 1 AND x IN ({_in(labels.HEADLINE_BREAKS)}) THEN i - 1 END), lambda i: i IS NOT NULL)) AS cut FROM w),
    h AS (SELECT item_id, list_slice(w, 1, coalesce(cut, len(w))) AS h FROM c), s AS (SELECT item_id, list_slice(h, 1, least(8, coalesce(list_max(list_transform(h, lambda x, i: CASE WHEN x NOT IN ({_in(labels.HEADLINE_MINOR)}) THEN i END)), 0))) AS s FROM h)
    SELECT item_id, CASE WHEN len(s) >= 2 AND s[1] NOT IN ({_in(labels.HEADLINE_STARTS)}) AND NOT regexp_full_match(s[1], '[0-9]+') AND len(list_filter(s, lambda x: x IN ({_in(labels.HEADLINE_REJECTS)}))) = 0
        THEN array_to_string(list_transform(s, lambda x, i: CASE WHEN regexp_full_match(x, '[ivxlcdm]+') THEN upper(x) WHEN i > 1 AND x IN ({_in(labels.HEADLINE_MINOR)}) THEN x ELSE upper(x[1]) || x[2:] END), ' ') END AS title FROM s"""


@query("FN-31_inferred_titles", _INFER)
def inferred_titles(spark, d):
    return b.table(spark, d, "benchmark").select("item_id", labels.inferred_title(F.col("text")).alias("title"))


@query("FN-33_page_tags", r"""WITH t AS (SELECT page_id, list_transform(regexp_extract_all(html, '(?s)<li>(.*?)</li>', 1), lambda t: trim(regexp_replace(regexp_replace(t, '<[^>]*>', ' ', 'g'), '\s+', ' ', 'g'))) AS tags FROM pages), k AS (SELECT page_id, list_filter(tags, lambda t, i: t <> '' AND NOT list_contains(list_transform(tags[1:i - 1], lambda x: lower(x)), lower(t))) AS tags FROM t)
    SELECT page_id, array_to_string(tags, '|') AS tags FROM k""")
def page_tags(spark, d):
    return b.table(spark, d, "pages").select("page_id", F.array_join(labels.tag_texts(F.col("html"), r"(?s)<li>(.*?)</li>"), "|").alias("tags"))


@query("FN-34_image_urls", """SELECT page_id, CASE page_id % 5 WHEN 0 THEN url WHEN 1 THEN 'https://cdn.example.org/' || page_id WHEN 2 THEN url ELSE CASE WHEN page_id % 5 = 3 THEN 'HTTP://x.example.net/a.png' END END AS image FROM pages""")
def image_urls(spark, d):
    k = F.col("page_id") % 5
    first = F.when(k == 0, F.concat(F.lit(" "), "url", F.lit(" "))).when(k == 1, F.concat(F.lit("//cdn.example.org/"), F.col("page_id").cast("string"))).when(k == 2, "data:image/png;base64,xx").when(k == 3, "HTTP://x.example.net/a.png").otherwise("/local.png")
    second = F.when(k == 2, F.col("url")).otherwise(F.concat(F.lit("https://"), F.repeat(F.lit("a"), 2050)))
    return b.table(spark, d, "pages").select("page_id", labels.image_url(first, second).alias("image"))


@query("FN-35_metadata_values", r"""SELECT p_partkey, array_to_string(list_filter([p_name, p_type, p_brand, 'x'], lambda v: TRUE), '|') || CASE WHEN p_partkey % 2 = 0 THEN '|last one' ELSE '' END AS found FROM part""")
def metadata_values(spark, d):
    line = F.concat("p_name", F.lit(" • "), "p_type", F.lit(" , 1999 / "), F.upper("p_name"), F.lit(" | "), "p_brand", F.lit(" | Wishlist now | x / y,"), F.repeat(F.lit("z"), 121), F.when(F.col("p_partkey") % 2 == 0, "  |  last   one ").otherwise(" | Add to cart"))
    return b.table(spark, d, "part").select("p_partkey", F.array_join(labels.metadata_values(line), "|").alias("found"))


@query("FN-37_entity_paths", f"SELECT p_partkey, '/items/' || {_SLUG.format('p_name')} || '-' || p_partkey AS path, p_partkey AS id FROM part")
def entity_paths(spark, d):
    path = F.concat(F.lit("/items/"), titles.trimmed_slug(F.col("p_name")), F.lit("-"), F.col("p_partkey").cast("string"))
    return b.table(spark, d, "part").select("p_partkey", path.alias("path"), F.regexp_extract(path, r"-(\d+)$", 1).cast("long").alias("id"))


@query("FN-38_truncated", views("articles", then="SELECT article, CASE WHEN length(headline) <= 30 THEN headline ELSE headline[1:27] || '...' END AS short, format('{:,}', CAST(article * 12345 AS BIGINT)) AS shown FROM articles"))
def truncated(spark, d):
    return b.articles(spark, d).select("article", labels.truncated(F.col("headline"), 30).alias("short"), F.format_number(F.col("article") * 12345, 0).alias("shown"))


@query("FN-44_store_dates", "SELECT o_orderkey, CASE o_orderkey % 4 WHEN 2 THEN CAST(date_trunc('year', o_orderdate) AS DATE) WHEN 3 THEN NULL ELSE CAST(o_orderdate AS DATE) END AS day FROM orders")
def store_dates(spark, d):
    k, at = F.col("o_orderkey") % 4, F.col("o_orderdate")
    text = F.when(k == 0, F.date_format(at, "MMM d, yyyy")).when(k == 1, F.date_format(at, "d MMM, yyyy")).when(k == 2, F.date_format(at, "yyyy")).otherwise("Coming soon")
    return b.table(spark, d, "orders").select("o_orderkey", dates.store_date(text).alias("day"))


@query("FN-45_iso_moments", "SELECT o_orderkey, CASE o_orderkey % 4 WHEN 1 THEN o_orderdate - INTERVAL 2 HOUR WHEN 3 THEN NULL ELSE o_orderdate END AS moment FROM orders")
def iso_moments(spark, d):
    k, at = F.col("o_orderkey") % 4, F.date_format("o_orderdate", "yyyy-MM-dd'T'HH:mm:ss")
    text = F.when(k == 0, F.concat(at, F.lit("Z"))).when(k == 1, F.concat(at, F.lit("+02:00"))).when(k == 2, at).otherwise("soon")
    return b.table(spark, d, "orders").select("o_orderkey", dates.iso_moment(text).cast("timestamp_ntz").alias("moment"))


@query("FN-50_json_names", """SELECT p_partkey, CASE p_partkey % 5 WHEN 0 THEN p_name || '|' || p_type || '|' || p_brand WHEN 1 THEN p_name WHEN 2 THEN p_brand || '|' || p_name WHEN 3 THEN '' ELSE p_type END AS names FROM part""")
def json_names(spark, d):
    k = F.col("p_partkey") % 5
    text = F.when(k == 0, F.to_json(F.struct(F.concat("p_name", F.lit(" / "), "p_type", F.lit(","), "p_brand").alias("v")))).when(k == 1, F.to_json(F.struct(F.lit("q").alias("slug"), F.col("p_name").alias("name"))))
    text = text.when(k == 2, F.concat(F.lit('["'), "p_brand", F.lit('", {"label": {"title": "'), "p_name", F.lit('"}}, 7, null]'))).when(k == 3, "{broken").otherwise(F.to_json(F.struct(F.lit(" ").alias("name"), F.col("p_type").alias("title"))))
    text = F.when(k == 0, F.get_json_object(F.concat(F.lit('{"v": '), F.to_json(F.array(F.concat("p_name", F.lit(" / "), "p_type", F.lit(","), "p_brand"))), F.lit("}")), "$.v")).otherwise(text)
    return b.table(spark, d, "part").select("p_partkey", F.array_join(labels.json_names(text), "|").alias("names"))


@query("FN-51_distinct_labels", "SELECT p_partkey, CASE WHEN lower(p_name) = lower(p_type) THEN p_name ELSE p_name || '|' || p_type END AS kept FROM part")
def distinct_labels(spark, d):
    values = F.array(F.concat(F.lit(" "), "p_name"), F.upper("p_name"), F.lit("  "), F.col("p_type"), F.lower("p_type"))
    return b.table(spark, d, "part").select("p_partkey", F.array_join(labels.distinct_labels(values), "|").alias("kept"))


@query("FN-55_vector_text", "SELECT vec_id, len(embedding) AS n, TRUE AS same FROM embeddings")
def vector_text(spark, d):
    back = labels.parsed_vector(labels.vector_text(F.col("embedding")))
    same = F.forall(F.zip_with(back, "embedding", lambda x, y: x.cast("float") == y.cast("float")), lambda x: x)
    return b.table(spark, d, "embeddings").select("vec_id", F.size(back).cast("long").alias("n"), same.alias("same"))


@query("FN-54_cosine", "SELECT a.vec_id, round(greatest(0, list_cosine_similarity(list_transform(a.embedding, lambda x: CAST(x AS DOUBLE)), list_transform(c.embedding, lambda x: CAST(x AS DOUBLE)))), 6) AS similarity FROM embeddings a JOIN embeddings c ON c.vec_id = a.vec_id + 1")
def cosines(spark, d):
    v = b.table(spark, d, "embeddings").select("vec_id", F.transform("embedding", lambda x: x.cast("double")).alias("v"))
    pairs = v.join(v.select((F.col("vec_id") - 1).alias("vec_id"), F.col("v").alias("w")), "vec_id")
    return pairs.select("vec_id", F.round(similarity.cosine(F.col("v"), F.col("w")), 6).alias("similarity"))


@query("FN-56_human_lists", f"""WITH w AS (SELECT p_partkey, list_slice({_WORDS.format("p_name || ' ' || p_type || ' ' || p_brand")}, 1, p_partkey % 5) AS w FROM part)
    SELECT p_partkey, CASE WHEN len(w) = 0 THEN '' WHEN len(w) <= 2 THEN array_to_string(w, ' and ') ELSE array_to_string(w[1:len(w) - 1], ', ') || ', and ' || w[len(w)] END AS listed FROM w""")
def human_lists(spark, d):
    words = F.slice(titles.words(F.concat_ws(" ", "p_name", "p_type", "p_brand")), F.lit(1), (F.col("p_partkey") % 5).cast("int"))
    return b.table(spark, d, "part").select("p_partkey", labels.human_list(words).alias("listed"))


@query("FN-57_match_payloads", "SELECT p_partkey, CASE WHEN p_partkey % 3 = 0 THEN '' ELSE 'a|' || p_name || '|c' END AS reasons, CASE WHEN p_partkey % 3 > 0 THEN p_type END AS confidence FROM part")
def match_payloads(spark, d):
    payload = F.when(F.col("p_partkey") % 3 == 0, F.lit("{}")).otherwise(F.to_json(F.struct(F.array(F.lit("a"), F.col("p_name"), F.lit("c"), F.lit("d")).alias("match_reasons"), F.col("p_type").alias("confidence"))))
    read = labels.match_payload(payload)
    return b.table(spark, d, "part").select("p_partkey", F.array_join(read["reasons"], "|").alias("reasons"), read["confidence"].alias("confidence"))


@query("FN-58_achievements", "SELECT p_partkey, CASE p_partkey % 4 WHEN 0 THEN p_size WHEN 1 THEN p_size * 1000 END AS total FROM part")
def achievement_totals(spark, d):
    k = F.col("p_partkey") % 4
    shown = F.when(k == 0, F.col("p_size").cast("string")).when(k == 1, F.concat(F.lit('"'), F.col("p_size").cast("string"), F.lit(',000 in all"'))).when(k == 2, F.lit('"none"')).otherwise("null")
    return b.table(spark, d, "part").select("p_partkey", labels.achievements(F.concat(F.lit('{"achievements": {"total": '), shown, F.lit("}}"))).alias("total"))


@query("SNK-14_recomputed", "SELECT count(*) AS seen, count(*) FILTER (was IS DISTINCT FROM now) AS changed, count(now) AS scored FROM (SELECT CASE WHEN l_linenumber % 3 = 0 THEN NULL WHEN l_linenumber % 3 = 1 THEN l_quantity * 2 ELSE 1 END AS was, CASE WHEN l_linenumber = 5 THEN NULL ELSE l_quantity * 2 END AS now FROM lineitem)")
def recomputed(spark, d):
    k = F.col("l_linenumber") % 3
    raw = F.when(F.col("l_linenumber") != 5, F.concat((F.col("l_quantity") * 2).cast("int").cast("string"), F.lit("%")))
    rows = b.table(spark, d, "lineitem").select(F.when(k == 1, F.col("l_quantity") * 2).when(k == 2, 1.0).alias("was"), scores.normalize(raw, F.lit("100"))["score"].alias("now"))
    return rows.agg(F.count("*").alias("seen"), F.count_if(~F.col("was").eqNullSafe(F.col("now"))).alias("changed"), F.count("now").alias("scored"))


@query("CLI-11_derived_scores", views("disparity", then="SELECT review_id, item, critic, s - d_a AS users_a, s - d_b AS users_b FROM disparity"))
def derived_scores(spark, d):
    from .disparity_queries import scored_reviews

    return scored_reviews(spark, d).select("review_id", "item", "critic", *[scores.derived_score(F.col("s"), F.col(f"d_{x}")).alias(f"users_{x}") for x in "ab"])
