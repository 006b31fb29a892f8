"""The registry of queries: a name, a function of (session, folder of the tables), and its DuckDB SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    """Register a query under ``name``; ``sql`` may build on the views of ``views``."""
    def register(function):
        if name in QUERIES:
            raise ValueError(f"{name} is registered twice")
        QUERIES[name] = function
        if sql is not None:
            ORACLE_SQL[name] = sql
        return function

    return register


#: The bindings of ``sources.bindings`` once more, as SQL.
VIEWS = {
    "reviews": """SELECT o_custkey AS critic, CASE WHEN l_linenumber % 7 = 0 THEN NULL ELSE l_suppkey END AS outlet, l_partkey AS item,
        CASE WHEN (l_suppkey + l_linenumber) % 19 = 0 THEN NULL ELSE l_quantity * 2 END AS score, l_shipdate AS published_at,
        l_orderkey * 8 + l_linenumber AS review_id FROM lineitem JOIN orders ON l_orderkey = o_orderkey""",
    "observations": """SELECT event_id AS obs_id, user_id, CASE event_type WHEN 'view' THEN 'a' ELSE 'b' END AS source, least(value, 100.0) AS score,
        CASE WHEN event_id % 11 = 0 THEN NULL ELSE event_id % 100 END AS sample_size, ts AS observed_at FROM events WHERE event_type IN ('view', 'purchase')""",
    "latest": """SELECT * FROM observations QUALIFY row_number() OVER (PARTITION BY user_id, source ORDER BY observed_at DESC, obs_id DESC) = 1""",
    "user_scores": """SELECT user_id, max(CASE WHEN source = 'a' AND coalesce(sample_size, 0) >= 50 THEN score END) AS score_a,
        max(CASE WHEN source = 'b' AND (sample_size IS NULL OR sample_size >= 20) THEN score END) AS score_b FROM latest GROUP BY user_id""",
    "items": """SELECT p_partkey AS item, p_name AS title, p_brand AS brand, p_type AS type, p_size AS size, p_retailprice AS price,
        CASE WHEN p_partkey % 13 = 0 THEN NULL ELSE DATE '1995-06-01' + CAST(p_size AS INTEGER) * 30 END AS released FROM part""",
    "disparity": """SELECT r.critic, r.outlet, r.item, r.published_at, r.review_id, CAST(round(r.score * 1000) AS BIGINT) AS s,
        CAST(round(r.score * 1000) - round(u.score_a * 1000) AS BIGINT) AS d_a, CAST(round(r.score * 1000) - round(u.score_b * 1000) AS BIGINT) AS d_b,
        CAST(CASE WHEN u.score_a IS NOT NULL AND u.score_b IS NOT NULL THEN ((round(r.score * 1000) - round(u.score_a * 1000)) + (round(r.score * 1000) - round(u.score_b * 1000))) / 2
             ELSE coalesce(round(r.score * 1000) - round(u.score_a * 1000), round(r.score * 1000) - round(u.score_b * 1000)) END AS BIGINT) AS d
        FROM reviews r LEFT JOIN user_scores u ON r.item % 150 = u.user_id WHERE r.score IS NOT NULL""",
    "activity": """SELECT user_id AS item, event_id AS sample_id, ts AS sampled_at, CASE WHEN event_id % 37 = 0 THEN 0 ELSE CAST(round(value * 100) AS BIGINT) END AS players FROM events""",
    "articles": """SELECT doc_id AS article, source, text, split_part(text, chr(10), 1) AS headline, CASE WHEN doc_id % 3 = 0 THEN doc_id % 20 END AS item,
        TIMESTAMP '2024-03-01 00:00:00' - CAST(doc_id % 97 AS INTEGER) * INTERVAL 1 HOUR AS published_at FROM documents""",
}
#: What each view is made of.
NEEDS = {"latest": ["observations"], "user_scores": ["observations", "latest"], "disparity": ["reviews", "observations", "latest", "user_scores"]}


def views(*names: str, then: str) -> str:
    """``then`` behind the views it names, and those that these need."""
    wanted = list(dict.fromkeys(x for n in names for x in [*NEEDS.get(n, []), n]))
    return "WITH " + ", ".join(f"{n} AS ({VIEWS[n]})" for n in wanted) + (", " if then.lstrip().startswith("+") else " ") + then.lstrip().removeprefix("+")


#: Statistics of a disparity in thousandths, as SQL; as ``operators.disparity.entity_stats`` has them.
STATS_SQL = """count(*) AS n_reviews, CAST(sum(d_a) AS DOUBLE) / nullif(count(d_a), 0) / 1000 AS avg_a, CAST(sum(d_b) AS DOUBLE) / nullif(count(d_b), 0) / 1000 AS avg_b,
    CAST(sum(d) AS DOUBLE) / nullif(count(d), 0) / 1000 AS avg_d,
    CASE WHEN count(d) > 1 THEN round(sqrt(greatest(0, (CAST(sum(d * d) AS DOUBLE) - CAST(sum(d) AS DOUBLE) * CAST(sum(d) AS DOUBLE) / count(d)) / (count(d) - 1))) / 1000, 6) END AS std_d,
    min(d) / 1000 AS min_d, max(d) / 1000 AS max_d"""
