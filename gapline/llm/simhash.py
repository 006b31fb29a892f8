"""SimHash near-duplicates: fingerprints, pigeonhole blocks, exact Hamming distance, components.

A fingerprint is cut into BLOCKS blocks.  If two differ in at most ``bits`` of
them, at least BLOCKS - bits blocks are equal, so they meet under one of the
choices of that many blocks.  Distinct fingerprints are dealt by each choice's
blocks; those that meet are compared bit by bit.

A group of fingerprints under one key is compared in one task only while it is
small.  The members of a larger one are dealt again, by the same rule, by
blocks of the bits that are still free.  Each round fixes more bits, and once
at most FREE are free, a group has at most 2**FREE members and is compared
whatever its size.  Of the links within a group only a spanning forest is
passed on, as components need no more.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import broadcast_if_small, cut, merged
from .components import connected_components
from .words import spaced_words, utf8

SHINGLE = 3
BITS = 3
BLOCKS = 6
#: Groups of at most so many fingerprints are compared in one task.
GROUP = 256
#: Groups whose fingerprints differ in so few bits are compared in one task at any size.
FREE = 8
SEED = 42
#: Shingles hashed at once; a longer text's bits are counted in turns.
CHUNK = 1 << 16


def fingerprint(raw: bytes, shingle: int = SHINGLE) -> int:
    """Bit by bit whether it is set in over half the XXH64 of the word shingles; 0 without words."""
    text = spaced_words(raw)
    if not text:
        return 0
    gaps = np.flatnonzero(np.frombuffer(text, np.uint8) == 32)
    starts = np.concatenate([[0], gaps + 1])
    ends = np.append(gaps, len(text))
    n = max(1, len(starts) - shingle + 1)
    starts, ends = starts[:n].tolist(), (ends[shingle - 1 :] if len(ends) >= shingle else ends[-1:]).tolist()
    h64, counts = xxhash.xxh64_intdigest, np.zeros(64, np.int64)
    for at in range(0, n, CHUNK):
        hashes = np.array([h64(text[a:b], SEED) for a, b in zip(starts[at : at + CHUNK], ends[at : at + CHUNK], strict=True)], np.uint64)
        counts += np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(counts * 2 > n, bitorder="little").tobytes(), "little")


def fingerprints(docs: DataFrame, shingle: int = SHINGLE, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Per row of ``docs``: key, fingerprint long (the 64 bits, signed)."""
    kind = docs.schema[key].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = np.fromiter((fingerprint(raw, shingle) for raw in utf8(batch.column(1))), np.uint64, batch.num_rows)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found.view(np.int64))], names=[key, "fingerprint"])

    return docs.select(key, text).mapInArrow(run, f"`{key}` {kind}, fingerprint long")


def _split(bits: list[int], parts: int) -> list[list[int]]:
    return [list(map(int, x)) for x in np.array_split(bits, parts)]


def plan(blocks: int = BLOCKS, differ: int = BITS) -> list[list[int]]:
    """The bits that each choice of blocks - differ blocks fixes."""
    return [sorted(sum(chosen, [])) for chosen in combinations(_split(list(range(64)), blocks), blocks - differ)]


def _mask(bits: list[int]) -> int:
    return int(np.array(sum(1 << b for b in bits), np.uint64).view(np.int64))


def _deal(rows: DataFrame, blocks: int, differ: int) -> DataFrame:
    """Deal each fingerprint by every choice of blocks: fingerprint, mask long (the bits fixed)."""
    each = F.array(*[F.lit(_mask(bits)).cast("long") for bits in plan(blocks, differ)])
    return rows.select("fingerprint", F.explode(each).alias("mask"))


def _deal_again(rows: DataFrame, blocks: int, differ: int) -> DataFrame:
    """Deal (fingerprint, mask) once more: the bits of a mask that are still free are cut into blocks anew."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            f, mask = (c.to_numpy(zero_copy_only=False) for c in batch.columns)
            masks, of = np.unique(mask, return_inverse=True)
            for i, m in enumerate(masks.tolist()):
                free = [b for b in range(64) if not (m >> b) & 1]
                next_masks = np.array([m | _mask(sorted(sum(c, []))) for c in combinations(_split(free, blocks), blocks - differ)])
                some = f[of == i]
                yield pa.RecordBatch.from_arrays([pa.array(np.repeat(some, len(next_masks))), pa.array(np.tile(next_masks, len(some)))], names=["fingerprint", "mask"])

    return rows.select("fingerprint", "mask").mapInArrow(run, "fingerprint long, mask long").distinct()


def _forest(values: np.ndarray, differ: int) -> list[tuple[int, int]]:
    """A spanning forest of the links among ``values``: breadth first, each value reached once."""
    left, out = values, []
    while len(left):
        todo, left = [left[0]], left[1:]
        while todo and len(left):
            at = todo.pop()
            near = np.bitwise_count(left ^ at) <= differ
            todo += list(left[near])
            out += [(at, x) for x in left[near]]
            left = left[~near]
    return out


def _links_in(dealt: DataFrame, differ: int) -> DataFrame:
    """a, b long: spanning forests of the links within each (mask, key)."""
    schema = pa.schema([("a", pa.int64()), ("b", pa.int64())])

    def forests(frame: pd.DataFrame) -> list[tuple[int, int]]:
        f = frame["fingerprint"].to_numpy().view(np.uint64)
        k, m = frame["key"].to_numpy(), frame["mask"].to_numpy()
        edge = np.flatnonzero((k[1:] != k[:-1]) | (m[1:] != m[:-1])) + 1
        first, last = np.concatenate([[0], edge]), np.append(edge, len(f))
        size, out = last - first, []
        two = first[size == 2]
        near = two[np.bitwise_count(f[two] ^ f[two + 1]) <= differ]
        out = list(zip(f[near], f[near + 1], strict=True))
        for a, b in zip(first[size > 2], last[size > 2], strict=True):
            out += _forest(f[a:b], differ)
        return out

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rest = None
        for batch in batches:
            frame = batch.to_pandas()
            frame = frame if rest is None else pd.concat([rest, frame], ignore_index=True)
            last = (frame["key"] == frame["key"].iloc[-1]) & (frame["mask"] == frame["mask"].iloc[-1])
            frame, rest = frame[~last], frame[last]  # a group may go on in the next batch; it has GROUP or 2**FREE rows at most
            if found := forests(frame) if len(frame) else []:
                yield pa.RecordBatch.from_arrays(list(pa.array(np.array(x, np.uint64).view(np.int64)) for x in zip(*found, strict=True)), schema=schema)
        if rest is not None and (found := forests(rest)):
            yield pa.RecordBatch.from_arrays(list(pa.array(np.array(x, np.uint64).view(np.int64)) for x in zip(*found, strict=True)), schema=schema)

    return dealt.repartition("mask", "key").sortWithinPartitions("mask", "key").mapInArrow(run, "a long, b long")


def links(distinct: DataFrame, differ: int = BITS, blocks: int = BLOCKS, group: int = GROUP) -> DataFrame:
    """a, b long: links among distinct ``fingerprint`` whose components are those of all pairs at ``differ`` bits or fewer."""
    found, rows = None, _deal(distinct, blocks, differ)
    while True:
        dealt = rows.withColumn("key", F.col("fingerprint").bitwiseAND(F.col("mask")))
        large = F.col("n") > group
        some = cut(dealt.filter(F.bit_count("mask") < 64 - FREE).groupBy("mask", "key").agg(F.count("*").alias("n")).filter(large).select("mask", "key"))
        none = some.isEmpty()
        small = dealt if none else dealt.join(broadcast_if_small(some, 64), ["mask", "key"], "left_anti")
        now = _links_in(small, differ)
        found = now if found is None else found.unionByName(now)
        if none:
            return found.distinct()
        rows = _deal_again(cut(dealt.join(broadcast_if_small(some, 64), ["mask", "key"], "left_semi").select("fingerprint", "mask")), blocks, differ)


def near_duplicates(docs: DataFrame, differ: int = BITS, shingle: int = SHINGLE, blocks: int = BLOCKS, group: int = GROUP, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Per row of ``docs``: key, fingerprint long, component (the smallest key reachable over links).

    Documents link at ``differ`` or fewer differing bits, so texts without
    words, null ones included, are one group, like equal texts.  A null key is
    never the smallest; a component of null keys only has null.  The rows of
    one fingerprint are combined before they are shuffled, and joined back
    from a table with one row per fingerprint, so that Spark can split them.
    """
    prints = cut(fingerprints(merged(docs).select(key, text), shingle, key, text))
    rows = prints.count()
    distinct = cut(prints.groupBy("fingerprint").agg(F.min(key).alias("_least")), rows)
    roots = connected_components(links(distinct, differ, blocks, group), most_links=rows * len(plan(blocks, differ)))
    joined = distinct.join(roots, F.col("fingerprint") == F.col("node"), "left").select("fingerprint", F.coalesce("root", "fingerprint").alias("_root"), "_least")
    least = joined.groupBy("_root").agg(F.min("_least").alias("component"))
    members = joined.join(least, "_root").select("fingerprint", "component")
    return prints.join(members, "fingerprint").select(key, "fingerprint", "component")


def one_of_each(docs: DataFrame, key: str = "doc_id", text: str = "text", **more) -> DataFrame:
    """The row of ``docs`` with the smallest key of each group of near-duplicates; all columns.

    Keys are taken to be unique; of rows that repeat the smallest key one
    stays.  Rows without a key cannot be named as duplicates of others: one of
    each text stays.
    """
    docs = merged(docs)
    kept = near_duplicates(docs, key=key, text=text, **more).filter(F.col(key) == F.col("component"))
    kept = cut(kept.groupBy(F.col(key).alias("_kept")).agg(F.count("*").alias("_n")), docs.count())

    def rows(ids: DataFrame) -> DataFrame:
        return docs.join(broadcast_if_small(ids.select("_kept"), 16), docs[key] == F.col("_kept"), "left_semi")

    out = rows(kept.filter("_n = 1")).unionByName(docs.filter(F.col(key).isNull()).dropDuplicates([text]))
    twice = kept.filter("_n > 1")
    return out if twice.isEmpty() else out.unionByName(rows(twice).dropDuplicates([key]))
