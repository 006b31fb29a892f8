"""Nearest neighbours of stated anchors by cosine: exact over all rows, or by an inverted file of which few lists are probed.

Both ways pair blocks of anchors with chunks of rows in an equi join of block
numbers, multiply a pair of blocks as matrices, and keep each anchor's best of
a chunk, so that no (anchor, row) pair is made outside a task.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .relational import saved, topk_per_group

#: Rows of a chunk and anchors of a block that are multiplied at once.
CHUNK, BLOCK = 4096, 1024
#: Centroids are fitted on so many rows at most, drawn by the digests of their keys; there are so many lists at most.
SAMPLE, LISTS, ROUNDS = 20_000, 4096, 12
#: Probes are measured on so many anchors at most.
MEASURED = 200


def _units(column: pa.Array) -> list[np.ndarray]:
    """Unit vectors; null vectors, null or non-finite components and zeros give a vector of zeros."""
    out = []
    for v in column.to_pylist():
        x = np.array([0.0] if v is None or any(c is None for c in v) else v, np.float64)
        norm = np.linalg.norm(x) if len(x) and np.isfinite(x).all() else 0.0
        out.append(x / norm if norm and np.isfinite(norm) else np.zeros(len(x)))
    return out


def _unit_rows(df: DataFrame, key: str, vector: str, name: str) -> DataFrame:
    kind = df.schema[key].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([u.tobytes() for u in _units(batch.column(1))], pa.binary())], names=[name, f"_{name}"])

    return df.select(key, vector).mapInArrow(run, f"`{name}` {kind}, `_{name}` binary")


def _stacked(column: pa.ChunkedArray) -> dict[int, tuple[np.ndarray, np.ndarray]]:
    """Positions and matrix for each length of vector."""
    raw = column.to_pylist()
    lengths = np.array([len(x) // 8 for x in raw])
    return {d: (at, np.frombuffer(b"".join(raw[i] for i in at.tolist()), np.float64).reshape(len(at), d)) for d in np.unique(lengths).tolist() for at in [np.flatnonzero(lengths == d)]}


def _best(anchors: DataFrame, rows: DataFrame, by: list[str], k: int) -> DataFrame:
    """anchor, candidate, similarity, rank: of each anchor's rows under the same ``by`` the best ``k``."""
    a_kind, c_kind = anchors.schema["anchor"].dataType.simpleString(), rows.schema["candidate"].dataType.simpleString()

    def best(left: pa.Table, right: pa.Table) -> pa.Table:
        a, c = left.column("anchor").to_numpy(), right.column("candidate").to_numpy()
        order = np.argsort(c, kind="stable")
        right, c = right.take(pa.array(order)), c[order]
        scores = np.zeros((len(a), len(c)))
        x, y = _stacked(left.column("_anchor")), _stacked(right.column("_candidate"))
        for d in x.keys() & y.keys():
            scores[np.ix_(x[d][0], y[d][0])] = x[d][1] @ y[d][1].T
        scores = np.round(scores, 6) + 0.0
        scores[a[:, None] == c[None, :]] = -np.inf
        most = min(k, len(c))
        first = np.argsort(-scores, axis=1, kind="stable")[:, :most] if len(c) else np.zeros((len(a), 0), np.int64)
        found = np.take_along_axis(scores, first, axis=1)
        i, j = np.nonzero(found > -np.inf)
        return pa.table({"anchor": left.column("anchor").take(pa.array(i)), "candidate": right.column("candidate").take(pa.array(first[i, j])), "similarity": found[i, j]})

    pairs = anchors.groupBy(*by).cogroup(rows.groupBy(*by)).applyInArrow(best, f"anchor {a_kind}, candidate {c_kind}, similarity double")
    return topk_per_group(pairs, ["anchor"], [F.desc("similarity"), F.asc("candidate")], k, "rank")


def _number(name: str, n: int) -> F.Column:
    return F.pmod(F.xxhash64(name), F.lit(max(1, n))).cast("int")


def nearest(anchors: DataFrame, vectors: DataFrame, k: int, key: str, vector: str, block: int = BLOCK) -> DataFrame:
    """anchor, candidate, similarity, rank: the exact ``k`` nearest others by cosine, rounded to six places, ties by candidate.

    Every chunk of rows meets every block of anchors, and is written as often
    as there are blocks.  Vectors that are null, zero or of another length
    have similarity 0.
    """
    blocks, chunks = max(1, -(-anchors.count() // block)), max(1, -(-vectors.count() // CHUNK))
    each = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    a = _unit_rows(anchors, key, vector, "anchor").withColumn("_block", _number("anchor", blocks)).withColumn("_chunk", each(chunks))
    c = _unit_rows(vectors, key, vector, "candidate").withColumn("_chunk", _number("candidate", chunks)).withColumn("_block", each(blocks))
    return _best(a, c, ["_block", "_chunk"], k)


def centroids(vectors: DataFrame, key: str, vector: str, lists: int | None = None, sample: int = SAMPLE, seed: int = 7) -> np.ndarray:
    """Unit centroids by spherical k-means over a bounded sample; by default about the square root of the number of rows, LISTS at most."""
    lists = lists or int(min(LISTS, max(1, round(vectors.count() ** 0.5))))
    drawn = _unit_rows(vectors.orderBy(F.xxhash64(key), key).limit(sample), key, vector, "candidate").toArrow()
    groups = _stacked(drawn.column("_candidate"))
    _, points = max(groups.values(), key=lambda x: len(x[0]), default=(None, np.zeros((0, 1))))
    points = points[np.abs(points).sum(axis=1) > 0]
    if not len(points):
        return np.zeros((1, points.shape[1]))
    random = np.random.default_rng(seed)
    found = points[random.choice(len(points), min(lists, len(points)), replace=False)]
    for _ in range(ROUNDS):
        of = (points @ found.T).argmax(axis=1)
        sums = np.zeros_like(found)
        np.add.at(sums, of, points)
        empty = np.bincount(of, minlength=len(found)) == 0
        sums[empty] = points[random.choice(len(points), int(empty.sum()))]
        norm = np.linalg.norm(sums, axis=1, keepdims=True)
        found = np.where(norm > 0, sums / np.where(norm > 0, norm, 1), found)
    return found


def _in_lists(rows: DataFrame, name: str, found: np.ndarray, probes: int) -> DataFrame:
    """``rows`` once for each of the ``probes`` lists nearest to it, with list and place (from 0)."""
    spread, kind = rows.sparkSession.sparkContext.broadcast(found), rows.schema[name].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        centres = spread.value
        for batch in batches:
            raw = batch.column(1).to_pylist()
            near = np.zeros((len(raw), len(centres)))
            for d, (at, points) in _stacked(pa.chunked_array([batch.column(1)])).items():
                if d == centres.shape[1]:
                    near[at] = points @ centres.T
            first = np.argsort(-near, axis=1, kind="stable")[:, :probes]
            at = np.repeat(np.arange(len(raw)), first.shape[1])
            yield pa.RecordBatch.from_arrays([*(c.take(pa.array(at)) for c in batch.columns), pa.array(first.ravel().astype(np.int32)), pa.array(np.tile(np.arange(first.shape[1], dtype=np.int32), len(raw)))], names=[name, f"_{name}", "list", "place"])

    return rows.select(name, f"_{name}").mapInArrow(run, f"`{name}` {kind}, `_{name}` binary, list int, place int")


class InvertedFile:
    """Every row of ``vectors`` in the list of its nearest centroid, written once; ``search`` reads the lists nearest to an anchor.

    The centroids, LISTS at most, are fitted on a bounded sample; all rows are
    indexed.  A list of any size is cut into chunks, so that a hot one is read
    in many tasks.
    """

    def __init__(self, vectors: DataFrame, key: str, vector: str, lists: int | None = None, sample: int = SAMPLE):
        self.key, self.vector = key, vector
        self.centroids = centroids(vectors, key, vector, lists, sample)
        self.rows = saved(_in_lists(_unit_rows(vectors, key, vector, "candidate"), "candidate", self.centroids, 1).drop("place"), "lists")
        self.sizes = self.rows.groupBy("list").agg(F.ceil(F.count("*") / CHUNK).cast("int").alias("_chunks"))  # LISTS rows at most

    def probes_for(self, anchors: DataFrame, k: int, recall: float = 0.95, measured: int = MEASURED) -> int:
        """How many lists have to be probed so that the ``recall`` share of the exact ``k`` nearest is found; measured on at most ``measured`` anchors."""
        some = anchors.orderBy(F.xxhash64(self.key), self.key).limit(measured)
        exact = nearest(some, self.rows.select(F.col("candidate").alias(self.key), F.col("_candidate")).transform(_as_arrays(self.key, self.vector)), k, self.key, self.vector)
        places = _in_lists(_unit_rows(some, self.key, self.vector, "anchor"), "anchor", self.centroids, len(self.centroids)).select("anchor", "list", "place")
        met = exact.select("anchor", "candidate").join(self.rows.select("candidate", "list"), "candidate").join(places, ["anchor", "list"])
        found = sorted(r.place for r in met.select("place").collect())  # k rows for each measured anchor
        return 1 + found[min(len(found) - 1, int(np.ceil(recall * len(found))) - 1)] if found else 1

    def search(self, anchors: DataFrame, k: int, probes: int) -> DataFrame:
        """anchor, candidate, similarity, rank: the ``k`` nearest others within the ``probes`` lists nearest to the anchor."""
        a = _in_lists(_unit_rows(anchors, self.key, self.vector, "anchor"), "anchor", self.centroids, probes).drop("place")
        chunks = F.broadcast(self.sizes)  # LISTS rows at most
        a = a.join(chunks, "list").withColumn("_chunk", F.explode(F.sequence(F.lit(0), F.col("_chunks") - 1))).drop("_chunks")
        c = self.rows.join(chunks, "list").withColumn("_chunk", F.pmod(F.xxhash64("candidate"), F.col("_chunks")).cast("int")).drop("_chunks")
        return _best(a, c, ["list", "_chunk"], k)


def _as_arrays(key: str, vector: str):
    """Unit vectors in bytes back as arrays."""

    def turn(df: DataFrame) -> DataFrame:
        kind = df.schema[key].dataType.simpleString()

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([np.frombuffer(x, np.float64) for x in batch.column(1).to_pylist()], pa.list_(pa.float64()))], names=[key, vector])

        return df.mapInArrow(run, f"`{key}` {kind}, `{vector}` array<double>")

    return turn
