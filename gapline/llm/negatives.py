"""Hard-negative mining by bit-sliced integer products.

Vectors are integers, cut into bit planes.  The product of an anchor with many
rows is added up plane by plane of the rows, the most significant first: after
each plane a score lies in an interval that the lower planes can still fill,
and rows whose interval cannot qualify any more are dropped.  What is left
after the last plane has its exact score.

Anchors are a stated query set.  They are taken in blocks of bounded size,
each spread to the tasks, which read all rows where they are; a task hands on
only the best few for each anchor, so that no row of the table is shuffled.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import cut, merged

#: Anchors of one block: what the driver holds and spreads at once.
BLOCK = 8192
#: Rows that are sliced at once.
SLICE = 16_384
POSITIVES, NEGATIVES = 5, 5
#: A negative has so many hundredths of the positive's score at least.
LEAST_PERCENT = 80
SCALE = 256
#: Vectors of this length after scaling, or longer, take no part: their products need not fit 64 bits.
LONGEST = 2.0**28
_NONE = np.iinfo(np.int64).min


class Slices:
    """Integer vectors of one length as bit planes in two's complement: ``planes[j]`` has a row of words for each vector."""

    def __init__(self, values: np.ndarray):
        n, d = values.shape
        top = int(max(values.max(initial=0), -1 - values.min(initial=0)))
        self.bits = top.bit_length() + 1
        self.words = -(-d // 64)
        self.planes = np.zeros((self.bits, n, self.words), np.uint64)
        wide = np.zeros((n, self.words * 64), np.int64)
        wide[:, :d] = values
        for j in range(self.bits):
            self.planes[j] = np.packbits(((wide >> j) & 1).astype(np.uint8), axis=1, bitorder="little").view(np.uint64).reshape(n, self.words)

    def weight(self, j: int) -> int:
        return -(1 << j) if j == self.bits - 1 else 1 << j


class Anchor:
    """An integer vector that others are multiplied with."""

    def __init__(self, values: np.ndarray):
        self.slices = Slices(values.reshape(1, -1))
        self.plus, self.minus = int(values[values > 0].sum()), int(values[values < 0].sum())

    def plane(self, rows: np.ndarray) -> np.ndarray:
        """The anchor's components added up over the set bits of each row of a plane."""
        total = np.zeros(len(rows), np.int64)
        for i in range(self.slices.bits):
            total += self.slices.weight(i) * np.bitwise_count(rows & self.slices.planes[i, 0]).sum(axis=1, dtype=np.int64)
        return total

    def products(self, rows: Slices, at: np.ndarray, drop) -> tuple[np.ndarray, np.ndarray]:
        """Positions out of ``at`` that ``drop(lower, upper)`` leaves, and their exact products; it is asked after each plane which rows stay."""
        score = np.zeros(len(at), np.int64)
        for j in range(rows.bits - 1, -1, -1):
            score += rows.weight(j) * self.plane(rows.planes[j][at])
            rest = (1 << j) - 1  # what the lower planes of a component can still add
            stay = drop(score + rest * self.minus, score + rest * self.plus, at)
            at, score = at[stay], score[stay]
            if not len(at):
                break
        return at, score


class Best:
    """The first ``most`` of (score, id, row): larger scores first, then smaller ids, null ids last."""

    def __init__(self, most: int):
        self.most = most
        self.score, self.id, self.row, self.named = (np.zeros(0, np.int64) for _ in range(4))

    @property
    def least(self) -> int:
        return int(self.score[-1]) if len(self.score) == self.most else _NONE

    def add(self, score: np.ndarray, ids: np.ndarray, named: np.ndarray, rows: np.ndarray) -> None:
        score, ids, named, rows = (np.concatenate(x) for x in ((self.score, score), (self.id, ids), (self.named, named), (self.row, rows)))
        first = np.lexsort((rows, ids, 1 - named, -score))[: self.most]
        self.score, self.id, self.named, self.row = score[first], ids[first], named[first], rows[first]


def _integers(column: pa.Array) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """For each length of vector: positions in the column, and floor(SCALE * x) of the vectors; vectors that take no part are left out."""
    lengths = np.diff(column.offsets.to_numpy()) if len(column) else np.zeros(0, np.int64)
    starts = column.offsets.to_numpy()[:-1] if len(column) else lengths
    flat = column.values
    bad = flat.is_null().to_numpy(zero_copy_only=False)
    flat = flat.cast(pa.float64(), safe=False).fill_null(0).to_numpy(zero_copy_only=False)
    there = ~column.is_null().to_numpy(zero_copy_only=False)
    for d in np.unique(lengths[there]).tolist():
        at = np.flatnonzero(there & (lengths == d))
        index = starts[at][:, None] + np.arange(d)
        with np.errstate(over="ignore", invalid="ignore"):
            x = np.floor(flat[index] * SCALE)
            fine = ~bad[index].any(axis=1) & (np.square(x).sum(axis=1) < LONGEST**2)  # NaN and infinities are not below it
        if fine.any():
            yield at[fine], x[fine].astype(np.int64)


def _sliced(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, int, Slices]]:
    """row, id, whether it is named, label, length and bit planes of at most SLICE rows at once."""
    for whole in batches:
        for begin in range(0, whole.num_rows, SLICE):
            batch = whole.slice(begin, SLICE)
            row, ids, label = (batch.column(i).fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64) for i in (0, 1, 2))
            named = batch.column(1).is_valid().to_numpy(zero_copy_only=False).astype(np.int64)
            vectors = batch.column(3)
            vectors = pa.concat_arrays([vectors]) if vectors.offset else vectors
            for at, values in _integers(vectors):
                yield row[at], ids[at], named[at], label[at], values.shape[1], Slices(values)


def _top(k: int) -> Window:
    return Window.partitionBy(*["anchor_row", "positive_row"][:k]).orderBy(F.desc("score"), F.asc_nulls_last("id"), "row")


def _positives(rows: DataFrame, block: list[tuple[int, int, np.ndarray]], most: int) -> DataFrame:
    """anchor_row, id, row, score: the best others of each anchor's label."""
    spread = rows.sparkSession.sparkContext.broadcast(block)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        anchors = [(row, label, len(v), Anchor(v), Best(most)) for row, label, v in spread.value]
        for row, ids, named, label, d, slices in _sliced(batches):
            of = {x: np.flatnonzero(label == x) for x in np.unique(label).tolist()}
            for own, same, length, anchor, best in anchors:
                if length != d or same not in of:
                    continue
                at = of[same]

                def stay(lower, upper, at, best=best):
                    least = max(best.least, int(np.partition(lower, -most)[-most]) if len(lower) > most else _NONE)
                    return upper >= least

                at, score = anchor.products(slices, at[row[at] != own], stay)
                if len(at):
                    best.add(score, ids[at], named[at], row[at])
        yield from _rows([(own, None, best) for own, *_, best in anchors])

    found = rows.mapInArrow(run, "anchor_row long, positive_row long, id long, row long, score long")
    return found.withColumn("rank", F.row_number().over(_top(1))).filter(F.col("rank") <= most)


def _rows(found: list[tuple[int, int | None, Best]]) -> Iterator[pa.RecordBatch]:
    found = [x for x in found if len(x[2].score)]
    for begin in range(0, len(found), 4096):
        some = found[begin : begin + 4096]
        sizes = [len(b.score) for *_, b in some]
        of = np.repeat(np.array([a for a, *_ in some]), sizes)
        by = pa.array([p for (_, p, _), n in zip(some, sizes, strict=True) for _ in range(n)], pa.int64())
        ids, named, row, score = (np.concatenate([getattr(b, k) for *_, b in some]) for k in ("id", "named", "row", "score"))
        yield pa.RecordBatch.from_arrays([pa.array(of), by, pa.array(ids, mask=named == 0), pa.array(row), pa.array(score)], names=["anchor_row", "positive_row", "id", "row", "score"])


def _negatives(rows: DataFrame, block: list[tuple[int, int, np.ndarray, list[tuple[int, int]]]], most: int, percent: int) -> DataFrame:
    """anchor_row, positive_row, id, row, score, rank: the best of other labels within each positive's bounds."""
    spread = rows.sparkSession.sparkContext.broadcast(block)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        anchors = [(own, label, len(v), Anchor(v), [(p, -(-percent * s // 100), s, Best(most)) for p, s in by]) for own, label, v, by in spread.value]
        for row, ids, named, label, d, slices in _sliced(batches):
            other = {x: np.flatnonzero(label != x) for x in {a[1] for a in anchors}}
            for _, same, length, anchor, wanted in anchors:
                if length != d:
                    continue

                def stay(lower, upper, at, wanted=wanted):
                    some = np.zeros(len(lower), bool)
                    for _, low, high, best in wanted:
                        least = max(low, best.least)
                        sure = lower[(lower >= least) & (upper <= high)]
                        if len(sure) > most:
                            least = max(least, int(np.partition(sure, -most)[-most]))
                        some |= (upper >= least) & (lower <= high)
                    return some

                at, score = anchor.products(slices, other[same], stay)
                for _, low, high, best in wanted if len(at) else ():
                    fits = (score >= low) & (score <= high)
                    if fits.any():
                        best.add(score[fits], ids[at[fits]], named[at[fits]], row[at[fits]])
        yield from _rows([(own, p, best) for own, *_, wanted in anchors for p, _, _, best in wanted])

    found = rows.mapInArrow(run, "anchor_row long, positive_row long, id long, row long, score long")
    return found.withColumn("rank", F.row_number().over(_top(2))).filter(F.col("rank") <= most)


def hard_negatives(
    rows: DataFrame, anchors: Column, positives: int = POSITIVES, negatives: int = NEGATIVES, least_percent: int = LEAST_PERCENT, block: int = BLOCK, key: str = "vec_id", vector: str = "embedding", label: str = "label"
) -> DataFrame:
    """anchor_id, positive_id, rank int, negative_id, positive_score, negative_score, all others long.

    Components x count as floor(SCALE * x), scores are exact inner products.
    Of each row for which ``anchors`` holds, the ``positives`` rows of the same
    label with the highest score, ties by smaller key, null keys last; for each
    of them the ``negatives`` rows of other labels with the highest score from
    ``least_percent`` hundredths of the positive's score up to that score.

    Rows with a null label, vector or component, one that is not finite, or a
    length of LONGEST or more take no part.  Vectors of different length have
    no score.  Repeated rows are others of each other, and each is an anchor of
    its own.  Positives without a negative have no row; empty tables give none;
    further columns are not read.
    """
    own = rows.select(F.col(key).cast("long").alias("id"), F.col(label).cast("long").alias("label"), F.col(vector).alias("vector"), F.coalesce(anchors, F.lit(False)).alias("anchor"))
    own = cut(merged(own.filter("label IS NOT NULL AND vector IS NOT NULL")).withColumn("row", F.monotonically_increasing_id()))
    rows = own.select("row", "id", "label", "vector")
    picked = cut(own.filter("anchor").select("row", "id", "label", "vector"))
    out, bounds = None, [picked.agg(F.min("row")).first()[0]]
    while bounds[0] is not None:
        some = picked.filter(F.col("row") >= bounds[0]).orderBy("row").limit(block + 1).toArrow().combine_chunks()
        bounds = some.column("row").to_pylist()[block:] or [None]
        some, listed = some.slice(0, block), []
        if some.num_rows:
            batch = some.to_batches()[0]
            row, of = batch.column(0).to_pylist(), batch.column(2).to_pylist()
            for at, values in _integers(batch.column(3)):
                listed += [(row[i], of[i], v) for i, v in zip(at.tolist(), values, strict=True)]
        if not listed:
            continue
        best = cut(_positives(rows, listed, positives).select("anchor_row", F.col("row").alias("positive_row"), F.col("id").alias("positive_id"), F.col("score").alias("positive_score")))
        by: dict[int, list[tuple[int, int]]] = {}
        for r in best.collect():  # ``positives`` rows an anchor of the block
            by.setdefault(r.anchor_row, []).append((r.positive_row, r.positive_score))
        mined = _negatives(rows, [(r, x, v, by[r]) for r, x, v in listed if r in by], negatives, least_percent)
        now = cut(mined.join(best, ["anchor_row", "positive_row"]))
        out = now if out is None else out.unionByName(now)
    if out is None:
        return rows.limit(0).select(*[F.lit(0).cast(k).alias(n) for n, k in (("anchor_id", "long"), ("positive_id", "long"), ("rank", "int"), ("negative_id", "long"), ("positive_score", "long"), ("negative_score", "long"))])
    named = picked.select(F.col("row").alias("anchor_row"), F.col("id").alias("anchor_id"))
    return out.join(named, "anchor_row").select("anchor_id", "positive_id", "rank", F.col("id").alias("negative_id"), "positive_score", F.col("score").alias("negative_score"))
