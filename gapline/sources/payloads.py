"""Nested payloads to rows: activity points, feeds, JSON-LD, rule catalogs."""

from __future__ import annotations

import json
from typing import Any

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

POINTS = "points array<struct<window_ending_at string, bucket_started_at string, observed_24h_high string, observed_24h_low string, latest_players string>>, app struct<latest_24h_high string, latest_24h_low string, all_time_peak_players string, all_time_peak_at string, last_success_at string>"
FEED = "channel struct<item: array<struct<title: string, link: string, description: string, author: string, pubDate: string, category: array<string>>>>"


def activity_points(payloads: DataFrame, key: str, column: str, since: str | None = None) -> DataFrame:
    """key, sampled_at, high, low, latest: the sound points of JSON payloads; others are left out.

    A point needs a time, a high and a low; the latest value falls back to the high.
    """
    number = lambda c: F.regexp_replace(c, "[^0-9]", "").try_cast("long")
    points = payloads.select(F.col(key), F.explode(F.from_json(column, POINTS)["points"]).alias("p"))
    at = F.try_to_timestamp(F.regexp_replace(F.coalesce("p.window_ending_at", "p.bucket_started_at"), "Z$", "+00:00"))
    out = points.select(key, at.alias("sampled_at"), number(F.col("p.observed_24h_high")).alias("high"), number(F.col("p.observed_24h_low")).alias("low"), number(F.col("p.latest_players")).alias("latest"))
    sound = out.filter("sampled_at IS NOT NULL AND high IS NOT NULL AND low IS NOT NULL").withColumn("latest", F.coalesce("latest", "high"))
    return sound if since is None else sound.filter(F.col("sampled_at") >= F.lit(since).cast("timestamp"))


def activity_summary(payloads: DataFrame, key: str, column: str) -> DataFrame:
    """key, high, low, peak: the payload's own summary, where it has one; a low of zero beside a sound high is a blip and null."""
    number = lambda c: F.regexp_replace(c, "[^0-9]", "").try_cast("long")
    app = payloads.select(key, F.from_json(column, POINTS)["app"].alias("a")).select(key, number(F.col("a.latest_24h_high")).alias("high"), number(F.col("a.latest_24h_low")).alias("low"), number(F.col("a.all_time_peak_players")).alias("peak"))
    return app.withColumn("low", F.when((F.col("low") > 0) | (F.coalesce("high", F.lit(0)) == 0), F.col("low")))


def feed_entries(feeds: DataFrame, source: str, column: str) -> DataFrame:
    """source, title, link, description, author, published_at, tags: the entries of RSS documents, newest first within none."""
    entries = feeds.select(source, F.explode(F.from_xml(F.col(column), FEED, {"rowTag": "rss"})["channel"]["item"]).alias("e"))
    published = F.coalesce(F.try_to_timestamp(F.regexp_replace("e.pubDate", r"^\w{3},\s*", ""), F.lit("d MMM yyyy HH:mm:ss Z")), F.try_to_timestamp("e.pubDate"))
    return entries.select(source, F.trim("e.title").alias("title"), F.trim("e.link").alias("link"), F.col("e.description").alias("description"), F.col("e.author").alias("author"), published.alias("published_at"), F.col("e.category").alias("tags"))


def relevant(entries: DataFrame, needs: list[str], rejects: list[str]) -> DataFrame:
    """Entries in whose title, description or tags one of ``needs`` stands as a word, and in whose title none of ``rejects``."""
    text = F.lower(F.concat_ws(" ", "title", "description", F.array_join("tags", " ")))
    word = lambda terms: r"\b(" + "|".join(terms) + r")\b"
    bad = F.lower("title").rlike(word(rejects)) if rejects else F.lit(False)
    return entries.filter(text.rlike(word(needs)) & ~bad)


def json_ld(pages: DataFrame, key: str, html: str) -> DataFrame:
    """key, name, date_published, rating: the first usable fields of a page's JSON-LD blocks, arrays and @graph included."""
    kind = "name string, datePublished string, description string, aggregateRating struct<ratingValue string>"
    blocks = pages.select(key, F.posexplode(F.regexp_extract_all(F.col(html), F.lit(r'(?is)<script[^>]*application/ld\+json[^>]*>(.*?)</script>'), F.lit(1))).alias("n", "block"))
    one, many, graph = F.from_json("block", kind), F.from_json("block", f"array<struct<{kind.replace('name string', 'name: string').replace('datePublished string', 'datePublished: string').replace('description string', 'description: string').replace('aggregateRating struct<ratingValue string>', 'aggregateRating: struct<ratingValue: string>')}>>"), F.from_json("block", f"`@graph` array<struct<{kind}>>")["@graph"]
    nodes = blocks.select(key, "n", F.posexplode(F.concat(F.coalesce(graph, F.array()), F.when(F.trim("block").startswith("["), F.coalesce(many, F.array())).otherwise(F.array(one)))).alias("m", "node"))
    first = lambda c: F.min(F.when(F.col(c).isNotNull(), F.struct("n", "m", F.col(c).alias("v"))))["v"]
    return nodes.groupBy(key).agg(first("node.name").alias("name"), first("node.datePublished").alias("date_published"), first("node.aggregateRating.ratingValue").alias("rating"))


def deep_merge(base: Any, override: Any) -> Any:
    """Rule documents: objects merge key by key, lists gain the entries they lack, anything else is replaced."""
    if isinstance(base, dict) and isinstance(override, dict):
        return {k: deep_merge(base[k], override[k]) if k in base and k in override else override.get(k, base.get(k)) for k in [*base, *(k for k in override if k not in base)]}
    if isinstance(base, list) and isinstance(override, list):
        seen = {json.dumps(x, sort_keys=True) for x in base}
        out = list(base)
        for x in override:
            if (mark := json.dumps(x, sort_keys=True)) not in seen:
                seen.add(mark)
                out.append(x)
        return out
    return override


def catalog_text(rules: list[dict]) -> str:
    return json.dumps({"rules": rules})


def catalog(spark: SparkSession, text: str, schema: str) -> DataFrame:
    """The rules of a JSON catalogue as a table."""
    kind = ", ".join(f"{n}: {t}" for n, t in (f.split() for f in schema.split(", ")))
    return spark.range(1).select(F.explode(F.from_json(F.lit(text), f"rules array<struct<{kind}>>")["rules"]).alias("r")).select("r.*")


def rule_table(spark: SparkSession, rules: dict) -> DataFrame:
    """path, value: the leaves of a rule document, values as JSON."""
    def leaves(node: Any, path: str) -> list[tuple[str, str]]:
        return [x for k, v in node.items() for x in leaves(v, f"{path}.{k}" if path else k)] if isinstance(node, dict) else [(path, json.dumps(node, separators=(",", ":")))]

    return spark.createDataFrame(leaves(rules, ""), "path string, value string")


def peak_summary(pages: DataFrame, key: str, html: str) -> DataFrame:
    """key, peak_day, peak_all, peak_at: the charts' block of a page, numbers before or behind their labels."""
    text = F.regexp_replace(F.replace(F.col(html), F.lit("&nbsp;"), F.lit(" ")), "[‐-―−]", "-")
    flat = F.trim(F.regexp_replace(F.regexp_replace(text, "<[^>]+>", " "), r"\s+", " "))
    block = F.regexp_extract(flat, r"(?i)steam charts(.*?)(?:store data|twitch stats|owner estimations|monthly players breakdown|$)", 1)
    block = F.when(block == "", flat).otherwise(block)

    def value(label: str) -> Column:
        before, behind = F.regexp_extract(block, rf"(?i)([\d,]+)\s+{label}\b", 1), F.regexp_extract(block, rf"(?i){label}\s+([\d,]+)\b", 1)
        return F.regexp_replace(F.when(before != "", before).otherwise(behind), ",", "").try_cast("long")

    at = F.regexp_extract(block, r"(?i)all[- ]time peak\D{0,3}\s*(\d{1,2} [A-Z][a-z]+ \d{4}|[A-Z][a-z]+ \d{1,2}, \d{4}|\d{4}-\d\d-\d\d)", 1)
    moment = F.coalesce(*[F.try_to_timestamp(at, F.lit(f)) for f in ("d MMM yyyy", "MMM d, yyyy", "yyyy-MM-dd")])
    return pages.select(key, value("24[- ]hour peak").alias("peak_day"), value("all[- ]time peak").alias("peak_all"), moment.alias("peak_at"))
