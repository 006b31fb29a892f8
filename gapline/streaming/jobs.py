"""Streaming forms: rolling activity, exactly-once upserts, de-duplication, trending, markers with state."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..operators import timeseries


def rolling_activity(samples: DataFrame, late: str = "2 hours", item: str = "item", ts: str = "sampled_at", value: str = "players") -> DataFrame:
    """item, window, high, low, n per sliding day, hour by hour; samples later than ``late`` don't count."""
    return samples.withWatermark(ts, late).groupBy(item, F.window(ts, "24 hours", "1 hour")).agg(F.max(value).alias("high"), F.min(value).alias("low"), F.count("*").alias("n"))


def trending_mentions(articles: DataFrame, late: str = "6 hours", key: str = "trend_key", ts: str = "published_at") -> DataFrame:
    """trend_key, window, mentions, sources (approximately) per sliding 48 hours."""
    return articles.withWatermark(ts, late).groupBy(key, F.window(ts, "48 hours", "1 hour")).agg(F.count("*").alias("mentions"), F.approx_count_distinct("source").alias("sources"))


def once(records: DataFrame, keys: list[str], ts: str, late: str = "1 day") -> DataFrame:
    """The first record of each key within the watermark: a provider may send one again."""
    return records.withWatermark(ts, late).dropDuplicatesWithinWatermark(keys)


def upsert_each_batch(records: DataFrame, checkpoint: str, merge: Callable[[DataFrame, int], None]) -> StreamingQuery:
    """Work off what has come and stop; ``merge`` gets each batch with its number, and does the same if it comes again."""
    return records.writeStream.foreachBatch(merge).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def quiet_markers(samples: DataFrame, item: str = "item", ts: str = "sampled_at", value: str = "players") -> DataFrame:
    """item, at, players, marker: jumps by JUMP and SHARE against the sample before, silenced for COOLDOWN; the state is two numbers an item."""
    import pandas as pd
    from pyspark.sql.streaming.state import GroupStateTimeout

    kind = samples.schema[item].dataType.simpleString()

    def step(key, frames, state):
        last, marked = state.get if state.exists else (None, None)
        out = []
        for frame in frames:
            for at, players in frame.sort_values("at")[["at", "players"]].itertuples(index=False):
                if last and abs(players - last) >= timeseries.JUMP and abs(players - last) / last >= timeseries.SHARE and (marked is None or at - marked >= timeseries.COOLDOWN):
                    out.append((key[0], at, players, "major_surge" if players > last else "major_drop"))
                    marked = at
                last = players
        state.update((last, marked))
        yield pd.DataFrame(out, columns=["item", "at", "players", "marker"])

    narrow = samples.select(F.col(item).alias("item"), timeseries.micros(ts).alias("at"), F.col(value).cast("double").alias("players"))
    return narrow.groupBy("item").applyInPandasWithState(step, f"item {kind}, at long, players double, marker string", "last double, marked long", "append", GroupStateTimeout.NoTimeout)
