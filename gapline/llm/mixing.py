"""Mixing sources to target weights along a time-varying curriculum, with DataFrame functions only.

Each source has a weight schedule over training time 0..1, linear between
knots.  The schedules' integrals set the sources' shares of the words; a
source's share is met by going through its documents, in a random fixed order,
up to ``max_passes`` times.  Training time is where the source's cumulative
demand reaches the middle of the words taken: the integral of the schedule,
scaled to the target, is inverted.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import broadcast_if_small, copies, cut, key_digest, merged, row_digest, running_totals

WORD = r"[^\x20\x09-\x0D]+"
Knots = list[tuple[float, float]]


def word_count(text: str) -> Column:
    return F.coalesce(F.regexp_count(F.col(text), F.lit(WORD)), F.lit(0)).cast("long")


def ranked_schedule(rank: Column) -> Column:
    """Sources in code-point order weigh 1, 2, 3, 1, ...: level, rising, falling."""
    shapes: list[Knots] = [[(0.0, 1.0), (1.0, 1.0)], [(0.0, 1.0), (1.0, 3.0)], [(0.0, 5.0), (1.0, 1.0)]]
    literal = [F.array(*[F.struct(F.lit(t).alias("t"), F.lit(w).alias("w")) for t, w in knots]) for knots in shapes]
    return F.when(rank % 3 == 0, literal[0]).when(rank % 3 == 1, literal[1]).otherwise(literal[2])


def _pieces(knots: Column) -> Column:
    """array<struct<t, w, slope, before, area>>: the linear pieces and the integral before each."""
    n = F.size(knots)
    pairs = F.arrays_zip(F.slice(knots, F.lit(1), n - 1).alias("a"), F.slice(knots, F.lit(2), n - 1).alias("b"))
    pieces = F.transform(pairs, lambda p: F.struct(
        p["a"]["t"].alias("t"), p["a"]["w"].alias("w"),
        ((p["b"]["w"] - p["a"]["w"]) / (p["b"]["t"] - p["a"]["t"])).alias("slope"),
        ((p["a"]["w"] + p["b"]["w"]) / 2 * (p["b"]["t"] - p["a"]["t"])).alias("area"),
    ))
    return F.transform(pieces, lambda p, i: F.struct(
        p["t"].alias("t"), p["w"].alias("w"), p["slope"].alias("slope"), p["area"].alias("area"),
        F.aggregate(F.slice(pieces, F.lit(1), i), F.lit(0.0), lambda s, x: s + x["area"]).alias("before"),
    ))


def _time_at(pieces: Column, area: Column) -> Column:
    """The time at which the integral of the schedule reaches ``area``."""
    piece = F.coalesce(F.get(F.filter(pieces, lambda p: p["before"] + p["area"] >= area), F.lit(0)), F.element_at(pieces, -1))
    rest = F.greatest(area - piece["before"], F.lit(0.0))
    root = F.sqrt(F.greatest(piece["w"] * piece["w"] + piece["slope"] * rest * 2, F.lit(0.0)))
    return piece["t"] + F.when(rest == 0, 0.0).otherwise(rest * 2 / (piece["w"] + root))


def source_targets(sized: DataFrame, max_passes: int, schedule: Callable[[Column], Column]) -> DataFrame:
    """One row per source: its size, pieces, weight and target.

    The target is the source's share of all words by weight, but at most
    ``max_passes`` times its size; what lies above is shared anew by weight.
    With sources by rising (cap / weight) the capped ones come first, so the
    level at which sharing ends is found with running sums.  The global
    windows see one row per source.
    """
    by_rank = Window.orderBy("_null", "_source")
    sources = sized.groupBy("_null", "_source").agg(F.sum("_all").alias("source_size"))
    sources = sources.withColumn("_pieces", _pieces(schedule(F.row_number().over(by_rank) - 1)))
    sources = sources.withColumn("_weight", F.aggregate("_pieces", F.lit(0.0), lambda s, p: s + p["area"]))
    sources = sources.withColumn("_cap", F.col("source_size") * F.lit(float(max_passes)))
    ratio = [F.col("_cap") / F.col("_weight"), F.col("_null"), F.col("_source")]
    by_ratio = Window.orderBy(*ratio)
    everything = by_ratio.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    capped = F.coalesce(F.sum("_cap").over(by_ratio.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0))
    free = F.sum("_weight").over(by_ratio.rowsBetween(Window.currentRow, Window.unboundedFollowing))
    sources = sources.withColumn("_level", (F.sum("source_size").over(everything) - capped) / free)
    fits = F.col("_level") * F.col("_weight") <= F.col("_cap")
    sources = sources.withColumn("_k", F.row_number().over(by_ratio))
    sources = sources.withColumn("_final", F.min(F.when(fits, F.struct("_k", "_level"))).over(everything)["_level"])
    return sources.select("_null", "_source", "source_size", "_pieces", "_weight", F.least("_cap", F.col("_weight") * F.col("_final")).alias("target"))


def mix(docs: DataFrame, max_passes: int = 3, whole: bool = False, schedule: Callable[[Column], Column] = ranked_schedule, key: str = "doc_id", text: str = "text", source: str = "source") -> DataFrame:
    """Mix all of ``docs``; one row per row of ``docs``, sorted by first training position.

    Returns key, size long (words), source_size long, target double, taken
    long, passes int (passes that take of it), position double (0..1 of
    training time, of the first words taken; null if none) and takes
    array<struct<pass int, words long, position double>>.

    ``schedule`` maps a source's rank (from 0; sources by code point, null
    last) to its knots array<struct<t double, w double>>, t from 0 to 1.  The
    last document that a source's target reaches is taken in part, or, with
    ``whole``, wholly if the target reaches its middle.  A null text has no
    words and is never taken; null is a source of its own.  Ties in the
    random order are broken by key, size; repeated rows count as documents.
    Nothing is grouped by source alone: running totals are by (source, 1/4096
    of the documents), over rows that agree in key, source and size as one, so
    that of one key, null included, there are no more than there are sizes.
    Only the windows of ``source_targets`` are whole, over a row a source.
    """
    sized = merged(docs).select(
        F.col(key).alias("_key"), F.col(source).isNull().alias("_null"), F.coalesce(F.col(source).cast("string"), F.lit("")).alias("_source"),
        word_count(text).alias("size"), key_digest(key).alias("_digest"),
    )
    sized = sized.groupBy("_key", "_null", "_source", "size", "_digest").agg(F.count("*").alias("_n"))
    sized = cut(sized.withColumns({"_bucket": F.substring("_digest", 1, 3), "_all": F.col("size") * F.col("_n")}))
    targets = source_targets(sized, max_passes, schedule)
    rows = copies(running_totals(sized, ["_null", "_source"], "_bucket", ["_digest", "_key", "size"], "_all", "_from", per_group=targets), "_n", "_copy")
    rows = rows.withColumn("_from", F.col("_from") + F.col("_copy") * F.col("size"))

    goal, size = F.floor(F.col("target") + 0.5), F.col("size")

    def take(n: Column) -> Column:
        start = F.col("_from") + n * F.col("source_size")
        words = F.when((start * 2 + size) <= goal * 2, size).otherwise(F.lit(0)) if whole else F.greatest(F.lit(0), F.least(size, goal - start))
        area = (start + words / 2) / F.col("target") * F.col("_weight")
        return F.struct((n + 1).cast("int").alias("pass"), words.cast("long").alias("words"), F.when(words > 0, _time_at(F.col("_pieces"), area)).alias("position"))

    takes = F.filter(F.transform(F.sequence(F.lit(0), F.lit(max_passes - 1)), take), lambda x: x["words"] > 0)
    rows = rows.withColumn("takes", takes).withColumn("position", F.get("takes", F.lit(0))["position"])
    #: Documents that are not taken follow, spread over 1..2 so that no task gets them all.
    spread = F.pmod(F.xxhash64("_digest", "size", "_copy"), F.lit(1 << 32)).cast("double") / 4294967296.0
    rows = rows.withColumn("_sort", F.coalesce("position", F.lit(1.0) + spread))
    return rows.orderBy("_sort", "_key").select(
        F.col("_key").alias(key), "size", "source_size", "target", F.aggregate("takes", F.lit(0).cast("long"), lambda s, x: s + x["words"]).alias("taken"), F.size("takes").alias("passes"), "position", "takes"
    )


def mixed_documents(docs: DataFrame, key: str = "doc_id", text: str = "text", **more) -> DataFrame:
    """The mix as rows of ``docs``: each as often as the mix takes it, whole; all columns.

    Rows that agree in key and text are one to the join, and appear as often
    as the mix takes all of them together.
    """
    row = row_digest(key, text)
    mixed = mix(docs.withColumn("_gapline_row", row), whole=True, key="_gapline_row", text=text, **more)
    taken = cut(mixed.filter("passes > 0").groupBy("_gapline_row").agg(F.sum("passes").cast("int").alias("_gapline_passes"), F.count("*").alias("_gapline_rows")), docs.count())

    def rows(some: DataFrame) -> DataFrame:
        return merged(docs).withColumn("_gapline_row", row).join(broadcast_if_small(some.drop("_gapline_rows"), 96), "_gapline_row").drop("_gapline_row")

    out, twice = rows(taken.filter("_gapline_rows = 1")), taken.filter("_gapline_rows > 1")
    if not twice.isEmpty():
        out = out.unionByName(rows(twice).dropDuplicates([key, text]))
    return out.withColumn("_gapline_pass", F.explode(F.sequence(F.lit(1), "_gapline_passes"))).select(*docs.columns)
