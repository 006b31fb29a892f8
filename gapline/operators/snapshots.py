"""Statistics kept up by changes: partial states of each entity and day that add up, and can be taken from.

A cell (entity, day) holds counts, exact sums and extremes.  A change adds the
new row and takes the old one away; only cells that a change touches are
written anew, and only a cell whose extreme was taken away is looked up in the
rows again.  Statistics are sums of cells, and are made again for touched
entities alone.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .relational import broadcast_if_small

_LOW = (1 << 20) - 1
_VALUES = ("d_a", "d_b", "d")


def _parts(sign: Column) -> dict[str, Column]:
    """Sums of a cell; ``sign`` is 1 for rows that are there and -1 for rows that are taken away. Squares are added up in two halves."""
    square = F.col("d") * F.col("d")
    out = {"n": F.sum(sign)}
    for v in _VALUES:
        out |= {f"n_{v}": F.coalesce(F.sum(F.when(F.col(v).isNotNull(), sign)), F.lit(0)), f"sum_{v}": F.coalesce(F.sum(F.col(v) * sign), F.lit(0))}
    return out | {"high_squares": F.coalesce(F.sum(F.shiftright(square, 20) * sign), F.lit(0)), "low_squares": F.coalesce(F.sum(square.bitwiseAND(F.lit(_LOW)) * sign), F.lit(0))}


#: The sums of a cell.
SUMS = ["n", *[f"{k}_{v}" for v in _VALUES for k in ("n", "sum")], "high_squares", "low_squares"]


def cells(rows: DataFrame, entity: str, ts: str = "published_at") -> DataFrame:
    """entity, day, the sums, min_d, max_d, last: a row for each entity and day; rows without an entity or a time are left out."""
    known = rows.filter(F.col(entity).isNotNull() & F.col(ts).isNotNull())
    sums = [c.alias(n) for n, c in _parts(F.lit(1)).items()]
    return known.groupBy(entity, F.to_date(ts).alias("day")).agg(*sums, F.min("d").alias("min_d"), F.max("d").alias("max_d"), F.max(ts).alias("last"))


def changed_cells(states: DataFrame, gone: DataFrame, come: DataFrame, current: DataFrame, entity: str, ts: str = "published_at") -> DataFrame:
    """The touched cells of ``states`` as they are after the rows ``gone`` are taken away and ``come`` put in; emptied cells have n 0.

    A row that changed is in both.  ``current`` has all rows after the change;
    of it only cells are read that lost a row as extreme or as late as any of
    theirs.  A row may be in ``gone`` only if it was counted.
    """
    both = come.withColumn("_sign", F.lit(1)).unionByName(gone.withColumn("_sign", F.lit(-1)))
    known = both.filter(F.col(entity).isNotNull() & F.col(ts).isNotNull())
    new = lambda c: F.when(F.col("_sign") > 0, F.col(c))
    old = lambda c: F.when(F.col("_sign") < 0, F.col(c))
    extremes = [f(w(c)).alias(f"_{p}_{n}") for p, w in (("new", new), ("old", old)) for n, f, c in (("min", F.min, "d"), ("max", F.max, "d"), ("last", F.max, ts))]
    delta = known.groupBy(entity, F.to_date(ts).alias("day")).agg(*[c.alias(f"_{n}") for n, c in _parts(F.col("_sign")).items()], *extremes)
    at = [entity, "day"]
    touched = delta.join(states, at, "left")
    lost = (F.col("_old_min") <= F.col("min_d")) | (F.col("_old_max") >= F.col("max_d")) | (F.col("_old_last") >= F.col("last"))
    merged = touched.select(
        *at, *[(F.coalesce(n, F.lit(0)) + F.col(f"_{n}")).alias(n) for n in SUMS], F.least("min_d", "_new_min").alias("min_d"), F.greatest("max_d", "_new_max").alias("max_d"), F.greatest("last", "_new_last").alias("last"), F.coalesce(lost, F.lit(False)).alias("_lost"),
    )
    again = merged.filter("_lost AND n > 0").select(*at)
    read = cells(current.withColumn("day", F.to_date(ts)).join(broadcast_if_small(again), at, "left_semi").drop("day"), entity, ts)
    return merged.filter("NOT _lost OR n = 0").drop("_lost").unionByName(read)


def updated(states: DataFrame, touched: DataFrame, entity: str) -> DataFrame:
    """``states`` with the touched cells in place of theirs; empty ones go."""
    return states.join(touched.select(entity, "day"), [entity, "day"], "left_anti").unionByName(touched.filter("n > 0"))


def stats(states: DataFrame, entity: str) -> DataFrame:
    """Per entity what ``disparity.entity_stats`` has, and last, from its cells."""
    average = lambda v: F.try_divide(F.sum(f"sum_{v}").cast("double"), F.sum(f"n_{v}")) / 1000
    n, total = F.sum("n_d"), F.sum("sum_d").cast("double")
    squares = F.sum("high_squares").cast("double") * (1 << 20) + F.sum("low_squares").cast("double")
    spread = F.when(n > 1, F.round(F.sqrt(F.greatest(F.lit(0.0), (squares - total * total / n) / (n - 1))) / 1000, 6))
    return states.groupBy(entity).agg(F.sum("n").alias("n_reviews"), average("d_a").alias("avg_a"), average("d_b").alias("avg_b"), average("d").alias("avg_d"), spread.alias("std_d"), (F.min("min_d") / 1000).alias("min_d"), (F.max("max_d") / 1000).alias("max_d"), F.max("last").alias("last"))


def snapshot(old: DataFrame, states: DataFrame, touched: DataFrame, entity: str) -> DataFrame:
    """The statistics ``old`` brought up: those of entities with a touched cell are made again from ``states``, as they are after the change."""
    some = touched.select(entity).distinct()
    return old.join(some, entity, "left_anti").unionByName(stats(states.join(some, entity, "left_semi"), entity))
