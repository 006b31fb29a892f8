"""Activity series: blips of zero, rolling extremes, baselines, markers, buckets and even thinning."""

from __future__ import annotations

import bisect

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

HOUR, DAY = 3_600_000_000, 86_400_000_000
#: Fixed values of markers: what counts as a surge or drop, how long one silences others, how long a drop can rebound.
JUMP, SHARE, COOLDOWN, WINDOW = 5_000, 0.30, 2 * DAY, 7 * DAY
LABELS = {"first_tracked": "First Activity Sample", "all_time_peak": "All-Time Peak", "major_surge": "Major Surge", "major_drop": "Major Drop", "rebound": "Rebound"}
#: What a marker says: {n} is the number of players, {gap} how far it is from what it is held against.
DETAILS = {"first_tracked": "Started tracking at {n}.", "all_time_peak": "All-time peak reached {n}.", "major_surge": "{n} was {gap} above the prior 7-day median.", "major_drop": "{n} was {gap} below the prior 7-day median.", "rebound": "Recovered by {gap} players from the recent drop."}


def micros(ts: str) -> Column:
    return F.unix_micros(F.col(ts).cast("timestamp"))


def without_blips(rows: DataFrame, item: str = "item", ts: str = "sampled_at", value: str = "players", tie: str = "sample_id", gap: int = 2 * HOUR) -> DataFrame:
    """Leave out runs of zeros that have a positive sample within ``gap`` before their start and one after their end."""
    series = Window.partitionBy(item).orderBy(ts, tie)
    run = Window.partitionBy(item, "_run")
    marked = rows.withColumns({"_at": micros(ts), "_zero": F.col(value) == 0})
    marked = marked.withColumns({"_run": F.count_if(~F.col("_zero")).over(series), "_next": F.lead("_at").over(series), "_next_value": F.lead(value).over(series)})
    last = F.max(F.struct(ts, tie, "_at", "_next", "_next_value")).over(run)
    marked = marked.withColumns({"_before": F.max(F.when(~F.col("_zero"), F.struct("_at", F.col(value).alias("v")))).over(run), "_start": F.min(F.when(F.col("_zero"), F.col("_at"))).over(run), "_last": last})
    before = (F.col("_start") - F.col("_before._at") <= gap) & (F.col("_before.v") > 0)
    after = (F.col("_last._next") - F.col("_last._at") <= gap) & (F.col("_last._next_value") > 0)
    return marked.filter(~(F.col("_zero") & F.coalesce(before & after, F.lit(False)))).select(*rows.columns)


def rolling_extremes(rows: DataFrame, item: str = "item", ts: str = "sampled_at", value: str = "players", tie: str = "sample_id", coverage: str = "series", window: int = DAY) -> DataFrame:
    """item, ts, tie, high, low, latest over the last ``window`` microseconds, its lower end included.

    ``coverage`` strict gives a point only where the oldest sample in the frame
    is exactly that old; series wherever the series began that long ago.

    Time is cut into blocks as long as the window, so that a frame is the
    beginning of a row's own block and the end of the one before.  Extremes of
    beginnings and ends are running ones; those of ends are passed on, shifted
    by the window, to the block behind.  So a series is spread over as many
    tasks as it has blocks, and each row is sorted and passed once or twice
    however many samples its frame holds.
    """
    at = rows.filter(F.col(ts).isNotNull()).withColumn("_at", micros(ts)).withColumn("_block", F.floor(F.col("_at") / window))
    block = Window.partitionBy(item, "_block").orderBy("_at")
    ends = Window.partitionBy(item, "_block").orderBy(F.desc("_at"))
    own = at.select(item, "_block", "_at", ts, tie, F.col(value).alias("_v"), F.max(value).over(block).alias("_high"), F.min(value).over(block).alias("_low"), F.min("_at").over(block).alias("_first"))
    end = F.struct(F.max(value).over(ends).alias("h"), F.min(value).over(ends).alias("l"), F.col("_at").alias("at"))
    shifted = at.select(item, (F.col("_block") + 1).alias("_block"), (F.col("_at") + window).alias("_at"), end.alias("_end"))
    both = own.withColumn("_own", F.lit(True)).unionByName(shifted.withColumn("_own", F.lit(False)), allowMissingColumns=True)
    # Behind the rows of the same time backwards, an end is the first one from there on.
    next_end = F.last("_end", ignorenulls=True).over(Window.partitionBy(item, "_block").orderBy(F.desc("_at"), "_own").rowsBetween(Window.unboundedPreceding, 0))
    out = both.withColumn("_end", next_end).filter("_own")
    oldest = F.coalesce("_end.at", "_first")
    if coverage != "strict":
        out = out.join(at.groupBy(item).agg(F.min("_at").alias("_oldest")), item)
        oldest = F.col("_oldest")
    high, low = F.greatest("_high", "_end.h"), F.least("_low", "_end.l")
    return out.filter(F.col("_at") - oldest >= window).select(item, ts, tie, high.alias("high"), low.alias("low"), F.col("_v").alias("latest"))


def baselines(rows: DataFrame, item: str = "item", ts: str = "sampled_at", value: str = "players", tie: str = "sample_id", window: int = WINDOW) -> DataFrame:
    """``rows`` with baseline: the median of the samples in the ``window`` before, null for fewer than two.

    A series is cut into blocks as long as the window; a block is worked off
    together with the one before it, in a task of its own, and keeps the values
    of its sliding frame in order, so that a row costs two searches.  Null
    values are no samples; rows without a time have no baseline.
    """
    names, schema = rows.columns, T.StructType([*rows.schema.fields, T.StructField("baseline", T.DoubleType())])
    at = rows.withColumn("_at", micros(ts)).withColumn("_block", F.floor(F.col("_at") / window))
    both = at.withColumn("_own", F.lit(True)).unionByName(at.filter("_at IS NOT NULL").withColumns({"_block": F.col("_block") + 1, "_own": F.lit(False)}))
    place = names.index(value)

    def slide(table: pa.Table) -> pa.Table:
        times = table.column("_at").fill_null(0).to_numpy()
        known = table.column("_at").is_valid().to_numpy() & table.column(place).is_valid().to_numpy()
        numbers, own = table.column(place).cast(pa.float64(), safe=False).fill_null(0).to_numpy(), table.column("_own").to_numpy()
        order = np.argsort(times, kind="stable")
        found, frame, first, last = np.full(len(times), np.nan), [], 0, 0
        steps = order.tolist()
        for i in steps:
            while last < len(steps) and times[steps[last]] < times[i]:
                if known[steps[last]]:
                    bisect.insort(frame, numbers[steps[last]])
                last += 1
            while times[steps[first]] < times[i] - window:
                if known[steps[first]]:
                    frame.pop(bisect.bisect_left(frame, numbers[steps[first]]))
                first += 1
            if own[i] and len(frame) >= 2:
                middle = len(frame) // 2
                found[i] = frame[middle] if len(frame) % 2 else frame[middle - 1] + (frame[middle] - frame[middle - 1]) * 0.5
        valid = table.column("_at").is_valid().to_numpy()
        keep = pa.array(np.flatnonzero(own))
        baseline = pa.array(found, mask=np.isnan(found) | ~valid)
        return table.select(names).append_column("baseline", baseline).take(keep)

    return both.groupBy(item, "_block").applyInArrow(slide, schema)


def described(found: DataFrame) -> DataFrame:
    """``found`` (players, marker, gap) with label and detail."""
    named = lambda texts: F.create_map(*[F.lit(x) for kv in texts.items() for x in kv])[F.col("marker")]
    detail = F.replace(F.replace(named(DETAILS), F.lit("{n}"), F.format_number("players", 0)), F.lit("{gap}"), F.coalesce(F.format_number("gap", 0), F.lit("")))
    return found.withColumns({"label": named(LABELS), "detail": detail})


def peaks(rows: DataFrame, item: str = "item", ts: str = "sampled_at", value: str = "players") -> DataFrame:
    """item, players, at (microseconds): the highest sample of each series, the first one of several."""
    best = rows.filter(F.col(value).isNotNull()).groupBy(item).agg(F.max(F.struct(F.col(value).alias("v"), (-micros(ts)).alias("at"))).alias("_p"))
    return best.select(item, F.col("_p.v").cast("double").alias("players"), (-F.col("_p.at")).alias("at"))


def markers(rows: DataFrame, item: str = "item", ts: str = "sampled_at", value: str = "players", tie: str = "sample_id", peaks: DataFrame | None = None) -> DataFrame:
    """item, at, players, marker, label, detail: the first sample, surges, drops and rebounds of each series, and the peaks that are given.

    Baselines come from a window, and so do the rows that can be marked at all:
    far from their baseline, right after one that is, or far enough above a
    recent drop.  Only these few are walked through in order, series by
    series, as each marker silences others for COOLDOWN.
    """
    based = baselines(without_blips(rows, item, ts, value, tie), item, ts, value, tie)
    kind = rows.schema[item].dataType.simpleString()
    narrow = based.select(F.col(item).alias("item"), micros(ts).alias("at"), F.col(value).cast("double").alias("players"), F.col(tie).alias("tie"), F.col("baseline").cast("double").alias("baseline"))
    first = narrow.groupBy("item").agg(F.min(F.struct("at", "tie", "players")).alias("f")).select("item", "f.at", "f.players", F.lit("first_tracked").alias("marker"), F.lit(None).cast("double").alias("gap"))
    if peaks is not None:
        first = first.unionByName(peaks.select(F.col(item).alias("item"), "at", "players", F.lit("all_time_peak").alias("marker"), F.lit(None).cast("double").alias("gap")))

    series = Window.partitionBy("item").orderBy("at", "tie")
    diff = F.col("players") - F.col("baseline")
    judged = narrow.filter("baseline > 0").withColumn("big", (F.abs(diff) >= JUMP) & (F.abs(diff) / F.col("baseline") >= SHARE))
    low = F.min(F.when(F.col("big") & (diff < 0) & (F.col("players") > 0), F.col("players"))).over(Window.partitionBy("item").orderBy("at").rangeBetween(-WINDOW, 0))
    judged = judged.withColumn("low", low).withColumns({"low": F.lag("low").over(series), "after_big": F.coalesce(F.lag("big").over(series), F.lit(False)), "before": F.lag("at").over(series)})
    rebound = (F.col("players") - F.col("low") >= JUMP) & ((F.col("players") - F.col("low")) / F.col("low") >= SHARE)
    judged = judged.withColumn("some", F.col("big") | F.col("after_big") | F.coalesce(rebound, F.lit(False)))
    judged = judged.withColumn("before", F.when(~F.coalesce(F.lag("some").over(series), F.lit(True)), F.col("before"))).filter("some")

    def walk(frame: pd.DataFrame) -> pd.DataFrame:
        out, marked_at, drop = [], None, None
        for at, players, base, before in frame.sort_values(["at", "tie"])[["at", "players", "baseline", "before"]].itertuples(index=False):
            if drop and not pd.isna(before) and before - drop[0] > WINDOW:
                drop = None  # a row that isn't here has ended it
            diff = players - base
            if marked_at is None or at - marked_at >= COOLDOWN:
                if abs(diff) >= JUMP and abs(diff) / base >= SHARE:
                    out.append((at, players, "major_surge" if diff > 0 else "major_drop", abs(diff)))
                    marked_at = at
                    if diff < 0:
                        drop = (at, players)
                    continue
                if drop and at > drop[0] and players - drop[1] >= JUMP and drop[1] > 0 and (players - drop[1]) / drop[1] >= SHARE:
                    out.append((at, players, "rebound", players - drop[1]))
                    marked_at, drop = at, None
            if drop and at - drop[0] > WINDOW:
                drop = None
        return pd.DataFrame([(frame["item"].iloc[0], *x) for x in out], columns=["item", "at", "players", "marker", "gap"])

    found = judged.select("item", "at", "players", "tie", "baseline", "before").groupBy("item").applyInPandas(walk, f"item {kind}, at long, players double, marker string, gap double")
    return described(first.unionByName(found)).select(F.col("item").alias(item), F.timestamp_micros("at").alias("at"), "players", "marker", "label", "detail")


def buckets(rows: DataFrame, most: int, item: str = "item", ts: str = "sampled_at", high: str = "players", low: str = "players", value: str = "players", tie: str = "sample_id") -> DataFrame:
    """item, bucket, high, low (least positive one), latest: at most about ``most`` buckets of an hour or longer per series."""
    seconds = F.unix_timestamp(F.col(ts).cast("timestamp"))
    span = rows.groupBy(item).agg((F.max(seconds) - F.min(seconds)).alias("_span")).withColumn("_width", F.greatest(F.lit(3600).cast("long"), F.ceil(F.col("_span") / most)))
    joined = rows.join(span, item).withColumn("bucket", F.floor(seconds / F.col("_width")))
    return joined.groupBy(item, "bucket").agg(F.max(high).alias("high"), F.min(F.when(F.col(low) > 0, F.col(low))).alias("low"), F.max(F.struct(ts, tie, value))[value].alias("latest"))


def thin(rows: DataFrame, most: int, by: list[str], order: list[str], half_even: bool = True) -> DataFrame:
    """Evenly spaced rows of each series, its ends included: those at round(i * last / (most - 1)).

    Python rounds halves to even, JavaScript up: ``half_even`` says which.
    """
    numbered = rows.withColumn("_n", F.row_number().over(Window.partitionBy(*by).orderBy(*order)) - 1).withColumn("_last", F.count("*").over(Window.partitionBy(*by)) - 1)
    if most == 1:
        return numbered.filter(F.col("_n") == F.col("_last")).drop("_n", "_last")
    exact = lambda i: i * F.col("_last") / F.lit(most - 1)
    step = (lambda i: F.bround(exact(i), 0)) if half_even else (lambda i: F.floor(exact(i) + 0.5))
    # A row is chosen by one of the two steps around it, so nothing is joined.
    near = F.floor(F.col("_n") * F.lit(most - 1) / F.greatest(F.col("_last"), F.lit(1)))
    chosen = F.exists(F.array(*[near + k for k in (-1, 0, 1, 2)]), lambda i: (i >= 0) & (i <= most - 1) & (step(i) == F.col("_n")))
    return numbered.filter((F.col("_last") < most) | chosen).drop("_n", "_last")


def rolling_mean(value: str, by: list[str], order: list[str], rows: int) -> Column:
    """Mean of the last ``rows`` values, nulls left out; null where the value is."""
    return F.when(F.col(value).isNotNull(), F.avg(value).over(Window.partitionBy(*by).orderBy(*order).rowsBetween(-(rows - 1), 0)))


def trailing(rows: DataFrame, item: str, ts: str, seconds: int) -> DataFrame:
    """The rows of each series from ``seconds`` before its last sample on."""
    at = F.unix_timestamp(F.col(ts).cast("timestamp"))
    return rows.withColumn("_end", F.max(at).over(Window.partitionBy(item))).filter(at >= F.col("_end") - seconds).drop("_end")


def clipped(rows: DataFrame, ts: str, since: str, released: Column) -> DataFrame:
    """Samples from the day on which tracking began, and from release on where that is later."""
    return rows.filter(F.col(ts) >= F.greatest(F.lit(since).cast("timestamp_ntz"), released.cast("timestamp_ntz")))
