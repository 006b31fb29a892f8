"""Near-duplicate vectors by sorted projection passes.

Each pass gives a vector a string of random hashes, the signs of its
projections on random directions, and orders all vectors by it; neighbours
within a window are compared, and what the passes find is united.

Equal vectors are one class first.  Then, in the order of a pass of its own,
classes gather in balls: a class joins a ball whose leader it links with, out
of the leaders met last in its task.  The passes order all classes but look
for pairs of balls that can hold a link, and a stretch of one ball's classes
counts as one neighbour, so that a group of near copies, however large, fills
no window.  All members of the pairs of balls that were found, and of wide
balls, are then multiplied in double precision, in chunks of bounded size; no
pair is made as a row.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from hashlib import blake2b

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import broadcast_if_small, cut, merged
from .components import connected_components

COSINE = 0.9
#: Neighbours on either side that a vector is compared with, at least, in a pass.
WINDOW = 128
#: The chance, at least, that a pair right at the threshold comes within a window in some pass; closer pairs have a better one.
RECALL = 0.99
#: Passes that are dealt and sorted in one job.
AT_ONCE = 4
#: Leaders that a task remembers; those not met for longest are forgotten.
LEADERS = 256
#: Members of a ball in one chunk, about.
CHUNK = 256
#: Rows of a sorted partition.
PART = 50_000
SEED = 17
#: What rounding leaders to 16 bits can change an angle by, and more than double precision can.
_HALF, _DOUBLE = 3e-3, 1e-7


def passes_for(vectors: int, cosine: float = COSINE, window: int = WINDOW, recall: float = RECALL) -> int:
    """Passes after which a pair at ``cosine`` has met with the chance ``recall``: both need the same first hashes, until a window's number is left."""
    same = 1 - math.acos(cosine) / math.pi
    meet = same ** max(0.0, math.log2(max(1, vectors) / window))
    return 1 if meet >= recall else math.ceil(math.log(1 - recall) / math.log(1 - meet))


def _unit(values: np.ndarray) -> np.ndarray:
    values = values.astype(np.float64)
    values = values / np.abs(values).max(axis=1, keepdims=True)
    return values / np.linalg.norm(values, axis=1, keepdims=True)


def _read(column: pa.Array) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """For each length of a column of vectors in bytes: positions and unit vectors."""
    raw = column.to_pylist()
    lengths = np.array([len(x) for x in raw], np.int64)
    for n in np.unique(lengths).tolist():
        at = np.flatnonzero(lengths == n)
        yield at, _unit(_numbers([raw[i] for i in at.tolist()]))


def _numbers(raw: list[bytes]) -> np.ndarray:
    """Vectors of one length; the first byte tells single from double precision."""
    kind = np.float64 if raw[0][:1] == b"d" else np.float32
    return np.frombuffer(b"".join(x[1:] for x in raw), kind).reshape(len(raw), -1)


def _digested(df: DataFrame, key: str, vector: str, with_vector: bool) -> DataFrame:
    """Per row key and digest, null if the vector links with nothing; with the vector in bytes on demand."""
    kind = df.schema[key].dataType.simpleString()
    single = df.schema[vector].dataType.elementType.simpleString() == "float"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[bytes | None] = [None] * batch.num_rows
            vectors = pa.concat_arrays([batch.column(1)])
            flat, ends = vectors.values, vectors.offsets.to_numpy()
            bad = flat.is_null().to_numpy(zero_copy_only=False)
            x = flat.cast(pa.float32() if single else pa.float64(), safe=False).fill_null(0).to_numpy(zero_copy_only=False)
            bad, some = bad | ~np.isfinite(x), x != 0
            worse, more = np.concatenate([[0], np.cumsum(bad)]), np.concatenate([[0], np.cumsum(some)])
            for i in np.flatnonzero(vectors.is_valid().to_numpy(zero_copy_only=False)).tolist():
                a, b = ends[i], ends[i + 1]
                if worse[a] == worse[b] and more[a] < more[b]:
                    out[i] = (b"f" if single else b"d") + x[a:b].tobytes()
            columns = [batch.column(0), pa.array([None if v is None else blake2b(v, digest_size=16).digest() for v in out], pa.binary())]
            yield pa.RecordBatch.from_arrays(columns + [pa.array(out, pa.binary())] * with_vector, names=["key", "digest", "vector"][: 2 + with_vector])

    return df.select(F.col(key).alias("key"), vector).mapInArrow(run, f"key {kind}, digest binary" + ", vector binary" * with_vector)


def _hashes(unit: np.ndarray, turn: int, seed: int) -> np.ndarray:
    """64 signs of random projections as a long; the first one counts most."""
    directions = np.random.default_rng([seed, turn, unit.shape[1]]).standard_normal((unit.shape[1], 64))
    return np.packbits(unit @ directions > 0, axis=1).view(">i8").ravel().astype(np.int64)


def _in_balls(classes: DataFrame, cosine: float, parts: int, seed: int) -> DataFrame:
    """``classes`` (rep, n, vector) with dims, ball (a rep), angle to its leader, leader in 16 bits."""

    def keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at, unit in _read(batch.column(2)):
                rep, n, vector = (c.take(pa.array(at)) for c in batch.columns)
                yield pa.RecordBatch.from_arrays([rep, n, vector, pa.array(np.full(len(at), unit.shape[1], np.int32)), pa.array(_hashes(unit, 0, seed))], names=["rep", "n", "vector", "dims", "hash"])

    def gather(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        dims, leaders, ids, met, clock = 0, np.zeros((0, 0)), np.zeros(0, np.int64), np.zeros(0, np.int64), 0
        for batch in batches:
            for at, units in _read(batch.column(2)):
                if units.shape[1] != dims:
                    dims, leaders, ids, met = units.shape[1], np.zeros((LEADERS, units.shape[1])), np.full(LEADERS, -1, np.int64), np.zeros(LEADERS, np.int64)
                ball, angle, lead = np.zeros(len(at), np.int64), np.zeros(len(at)), []
                reps = batch.column(0).to_numpy()[at]
                for i, unit in enumerate(units):
                    near = leaders @ unit
                    k = int(near.argmax())
                    if near[k] < cosine:
                        k = int(met.argmin())
                        leaders[k], ids[k] = unit, reps[i]
                    else:
                        angle[i] = math.acos(min(1.0, near[k]))
                    clock += 1
                    met[k] = clock
                    ball[i] = ids[k]
                    lead.append(leaders[k].astype(np.float16).tobytes())
                rep, n, vector, size = (batch.column(i).take(pa.array(at)) for i in range(4))
                yield pa.RecordBatch.from_arrays([rep, n, vector, size, pa.array(ball), pa.array(angle), pa.array(lead, pa.binary())], names=["rep", "n", "vector", "dims", "ball", "angle", "leader"])

    hashed = classes.select("rep", "n", "vector").mapInArrow(keys, "rep long, n long, vector binary, dims int, hash long")
    dealt = hashed.repartitionByRange(parts, "dims", "hash", "rep").sortWithinPartitions("dims", "hash", "rep")
    return dealt.mapInArrow(gather, "rep long, n long, vector binary, dims int, ball long, angle double, leader binary")


class _Window:
    """Entries (turn, dims, ball, radius, leader) in order; those that follow an entry of the same ball are left out."""

    def __init__(self, theta: float, window: int):
        self.theta, self.window, self.kept = theta, window, None

    def frame(self, batch: pa.RecordBatch, before: list | None = None) -> list:
        """Numbers as one array, leaders as a list; what lies in one stretch of a ball is one entry."""
        numbers = np.column_stack([batch.column(i).to_numpy(zero_copy_only=False).astype(np.float64 if i == 3 else np.int64).view(np.int64) for i in range(4)])
        leaders = batch.column(4).to_pylist()
        if before is not None:
            numbers, leaders = np.concatenate([before[0], numbers]), before[1] + leaders
        new = np.ones(len(numbers), bool)
        new[1:] = (numbers[1:, :3] != numbers[:-1, :3]).any(axis=1)
        return [numbers[new], [leaders[i] for i in np.flatnonzero(new).tolist()]]

    def pairs(self, numbers: np.ndarray, leaders: list[bytes]) -> np.ndarray:
        """Balls (a, b), a < b, that come within a window and can hold a link."""
        out = [np.zeros((0, 2), np.int64)]
        edge = np.flatnonzero((numbers[1:, :2] != numbers[:-1, :2]).any(axis=1)) + 1
        for first, last in zip([0, *edge.tolist()], [*edge.tolist(), len(numbers)], strict=True):
            unit = np.frombuffer(b"".join(leaders[first:last]), np.float16).reshape(last - first, -1).astype(np.float32)
            unit /= np.linalg.norm(unit, axis=1, keepdims=True)
            ball, radius = numbers[first:last, 2], numbers[first:last, 3].copy().view(np.float64)
            for i in range(0, len(unit), self.window):
                these, those = slice(i, i + self.window), slice(i, i + 2 * self.window)
                near = unit[these] @ unit[those].T
                loosest = np.cos(np.minimum(np.pi, self.theta + _HALF + radius[these] + radius[those].max()))
                a, b = np.nonzero(near >= loosest[:, None])
                a, b, near = a[a < b], b[a < b], near[a[a < b], b[a < b]]
                a, b = a + i, b + i
                fits = (near >= np.cos(np.minimum(np.pi, self.theta + _HALF + radius[a] + radius[b]))) & (ball[a] != ball[b])
                out.append(np.column_stack([np.minimum(ball[a], ball[b])[fits], np.maximum(ball[a], ball[b])[fits]]))
        return np.unique(np.concatenate(out), axis=0)


_ENTRY = "turn int, dims int, ball long, radius double, leader binary"


def _found(members: DataFrame, turns: range, theta: float, window: int, parts: int, seed: int) -> DataFrame:
    """a, b long: pairs of balls that meet in one of the passes ``turns``; materialised."""

    def keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at, unit in _read(batch.column(2)):
                ball, radius, leader = (batch.column(i).take(pa.array(at)) for i in (0, 1, 3))
                for turn in turns:
                    fixed = [pa.array(np.full(len(at), x, np.int32)) for x in (turn, unit.shape[1])]
                    yield pa.RecordBatch.from_arrays([*fixed, ball, radius, leader, pa.array(_hashes(unit, turn, seed))], names=["turn", "dims", "ball", "radius", "leader", "hash"])

    def entries(found: list, side: int, border: int) -> pa.RecordBatch:
        numbers, leaders = found
        n = len(leaders)
        columns = [pa.nulls(n, pa.int64()), pa.nulls(n, pa.int64()), pa.array(np.full(n, border, np.int64)), pa.array(np.arange(n) + side * window)]
        columns += [pa.array(numbers[:, 0].astype(np.int32)), pa.array(numbers[:, 1].astype(np.int32)), pa.array(numbers[:, 2].copy()), pa.array(numbers[:, 3].copy().view(np.float64)), pa.array(leaders, pa.binary())]
        return pa.RecordBatch.from_arrays(columns, names=["a", "b", "border", "seq", "turn", "dims", "ball", "radius", "leader"])

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Pairs within the partition; its first and last entries for the borders to the partitions beside it."""
        own, run, head, tail = TaskContext.get().partitionId(), _Window(theta, window), None, None
        for batch in batches:
            if not batch.num_rows:
                continue
            now = run.frame(batch, tail)
            pairs = run.pairs(*now)
            n = len(pairs)
            if n:
                yield pa.RecordBatch.from_arrays([pa.array(pairs[:, 0].copy()), pa.array(pairs[:, 1].copy()), *[pa.nulls(n, k) for k in (pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.int64(), pa.float64(), pa.binary())]], names=["a", "b", "border", "seq", "turn", "dims", "ball", "radius", "leader"])
            if head is None or len(head[1]) < window:
                head = [now[0][:window], now[1][:window]] if head is None or tail is None or len(tail[1]) < window else head
            tail = [now[0][-window:], now[1][-window:]]
        if tail is not None:
            yield entries(tail, 0, own)
            if own:
                yield entries(head, 1, own - 1)

    def across(table: pa.Table) -> pa.Table:
        run = _Window(theta, window)
        batch = table.sort_by("seq").select(["turn", "dims", "ball", "radius", "leader"]).combine_chunks().to_batches()[0]
        pairs = run.pairs(*run.frame(batch))
        return pa.table({"a": pairs[:, 0].copy(), "b": pairs[:, 1].copy()})

    hashed = members.select("ball", "radius", "vector", "leader").mapInArrow(keys, f"{_ENTRY}, hash long")
    dealt = hashed.repartitionByRange(parts, "turn", "dims", "hash", "ball").sortWithinPartitions("turn", "dims", "hash", "ball").drop("hash")
    out = cut(dealt.mapInArrow(compare, f"a long, b long, border long, seq long, {_ENTRY}"))
    borders = out.filter("border IS NOT NULL").groupBy("border").applyInArrow(across, "a long, b long")
    return cut(out.filter("a IS NOT NULL").select("a", "b").union(borders).distinct())


def _verified(members: DataFrame, pairs: DataFrame, large: DataFrame, theta: float, cosine: float) -> DataFrame:
    """rep, links: vectors that a class links with, by cell; a, b: pairs of balls with a link."""
    sizes = broadcast_if_small(large.select("ball", "chunks"), 24)
    for side in ("a", "b"):
        pairs = pairs.join(sizes.select(F.col("ball").alias(side), F.col("chunks").alias(f"n_{side}")), side, "left")
    cells = pairs.select("a", "b", F.explode(F.sequence(F.lit(0), F.coalesce("n_a", F.lit(1)) - 1)).alias("i"), F.coalesce("n_b", F.lit(1)).alias("n_b"))
    cells = cells.select("a", "b", "i", F.explode(F.sequence(F.lit(0), F.col("n_b") - 1)).alias("j"))
    wide = large.filter(2 * F.col("radius") >= theta - _DOUBLE).select(F.col("ball").alias("a"), F.col("ball").alias("b"), F.explode(F.sequence(F.lit(0), F.col("chunks") - 1)).alias("i"), "chunks")
    cells = cells.unionByName(wide.select("a", "b", "i", F.explode(F.sequence("i", F.col("chunks") - 1)).alias("j")))
    of = members.select("ball", F.pmod(F.hash("rep"), F.col("chunks")).alias("chunk"), "rep", "n", "vector")
    left = cells.join(of, (F.col("a") == F.col("ball")) & (F.col("i") == F.col("chunk"))).select("a", "b", "i", "j", F.lit(0).alias("side"), "rep", "n", "vector")
    right = cells.filter("a != b OR i != j").join(of, (F.col("b") == F.col("ball")) & (F.col("j") == F.col("chunk"))).select("a", "b", "i", "j", F.lit(1).alias("side"), "rep", "n", "vector")
    schema = pa.schema([("rep", pa.int64()), ("links", pa.int64()), ("a", pa.int64()), ("b", pa.int64())])

    def count(table: pa.Table) -> pa.RecordBatch:
        """Whole cells, in order."""
        a, b, i, j, side, rep, n = (table.column(k).to_numpy() for k in range(7))
        vector = table.column(7).combine_chunks()
        edge = np.flatnonzero((a[1:] != a[:-1]) | (b[1:] != b[:-1]) | (i[1:] != i[:-1]) | (j[1:] != j[:-1])) + 1
        first, last = np.concatenate([[0], edge]), np.append(edge, len(a))
        units: list[np.ndarray] = [np.zeros(0)] * len(a)
        for at, unit in _read(vector):
            for k, u in zip(at.tolist(), unit, strict=True):
                units[k] = u
        links, linked = np.zeros(len(a), np.int64), np.zeros(len(first), bool)
        for k, (x, z) in enumerate(zip(first.tolist(), last.tolist(), strict=True)):
            y = x + int(np.searchsorted(side[x:z], 1))
            if y == z and a[x] == b[x] and i[x] == j[x]:
                own = np.stack(units[x:z])
                near = own @ own.T >= cosine
                np.fill_diagonal(near, False)
                links[x:z] += near @ n[x:z]
            elif x < y < z:
                near = np.stack(units[x:y]) @ np.stack(units[y:z]).T >= cosine
                links[x:y] += near @ n[y:z]
                links[y:z] += near.T @ n[x:y]
                linked[k] = a[x] != b[x] and bool(near.any())
        some, cell = links > 0, first[linked]
        none = pa.nulls(int(some.sum()), pa.int64())
        columns = [pa.concat_arrays([pa.array(rep[some]), pa.nulls(len(cell), pa.int64())]), pa.concat_arrays([pa.array(links[some]), pa.nulls(len(cell), pa.int64())]), pa.concat_arrays([none, pa.array(a[cell])]), pa.concat_arrays([none, pa.array(b[cell])])]
        return pa.RecordBatch.from_arrays(columns, schema=schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rest = None
        for batch in batches:
            table = pa.Table.from_batches([batch])
            table = table if rest is None else pa.concat_tables([rest, table])
            if not table.num_rows:
                continue
            ids = [table.column(k).to_numpy() for k in range(4)]
            begin = int(np.argmax(np.logical_and.reduce([x == x[-1] for x in ids])))  # the last cell may go on in the next batch
            rest, table = table.slice(begin), table.slice(0, begin)
            if table.num_rows:
                yield count(table)
        if rest is not None and rest.num_rows:
            yield count(rest)

    return left.unionByName(right).repartition("a", "b", "i", "j").sortWithinPartitions("a", "b", "i", "j", "side").mapInArrow(run, "rep long, links long, a long, b long")


def near_vectors(df: DataFrame, cosine: float = COSINE, window: int = WINDOW, recall: float = RECALL, passes: int | None = None, seed: int = SEED, key: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """Per row of ``df``: key, n_links long (other rows linked directly), component (the smallest key reachable).

    Rows link whose vectors have a cosine of ``cosine`` (above 0) or more in
    double precision.  No link is below it; one can be missed, by the chance
    that ``recall`` bounds, if its balls come within no window of any pass.
    The number of passes follows from the number of different vectors.

    Vectors that are null, empty, all zeros, or hold a null or a number that is
    not finite, link with nothing; so do vectors of different length.  Repeated
    rows are rows of their own.  A null key is never the smallest; a component
    of null keys only has null.  Empty tables give no rows; further columns are
    not read.
    """
    theta, df = math.acos(cosine), merged(df)
    classes = _digested(df, key, vector, True).filter("digest IS NOT NULL").groupBy("digest").agg(F.min("key").alias("least"), F.count("*").alias("n"), F.first("vector").alias("vector"))
    classes = cut(classes.withColumn("rep", F.monotonically_increasing_id()))
    number = classes.count()
    members = cut(_in_balls(classes, cosine, max(1, -(-number // PART)), seed))
    balls = cut(members.groupBy("ball").agg(F.count("*").alias("size"), F.sum("n").alias("total"), (F.max("angle") + _DOUBLE).alias("radius")), number)
    large = cut(balls.filter("size > 1").withColumn("chunks", F.ceil(F.col("size") / CHUNK).cast("int")), number)
    placed = members.join(broadcast_if_small(large.select("ball", "radius", "chunks"), 32), "ball", "left").fillna(0.0, ["radius"]).fillna(1, ["chunks"])
    turns, found = passes or passes_for(number, cosine, window, recall), None
    for first in range(1, turns + 1, AT_ONCE):
        some = range(first, min(first + AT_ONCE, turns + 1))
        now = _found(placed, some, theta, window, max(1, -(-number * len(some) // PART)), seed)
        found = now if found is None else found.union(now)
    checked = cut(_verified(placed, cut(found.distinct()), large, theta, cosine))
    roots = connected_components(checked.filter("a IS NOT NULL").select("a", "b"), most_links=number)
    least = classes.select("rep", "least").join(members.select("rep", "ball"), "rep").groupBy("ball").agg(F.min("least").alias("least"))
    joined = least.join(roots, F.col("ball") == F.col("node"), "left").select("ball", F.coalesce("root", "ball").alias("root"), "least")
    component = joined.select("ball", "root").join(joined.groupBy("root").agg(F.min("least").alias("component")), "root").join(balls, "ball")
    links = checked.filter("rep IS NOT NULL").groupBy("rep").agg(F.sum("links").alias("links"))
    within = F.when((F.col("size") > 1) & (2 * F.col("radius") < theta - _DOUBLE), F.col("total") - F.col("n")).otherwise(0)
    each = members.select("rep", "n", "ball").join(links, "rep", "left").join(component.select("ball", "component", "size", "total", "radius"), "ball")
    each = cut(each.select("rep", (F.col("n") - 1 + within + F.coalesce("links", F.lit(0))).alias("n_links"), "component").join(classes.select("rep", "digest"), "rep").select("digest", "n_links", "component"), number)
    rows = _digested(df, key, vector, False).join(each, "digest", "left")
    return rows.select(F.col("key").alias(key), F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), F.when(F.col("digest").isNull(), F.col("key")).otherwise(F.col("component")).alias("component"))
