"""Benchmark decontamination with a distributed positional inverted index.

The training documents are indexed in segments, each the documents of one task
up to a bounded number of words: for every word of the test items, the sorted
places at which it stands in the segment.  Segments are rows of a table in the
shared folder.  Test windows are then looked up in each segment: the posting
lists of a window's rarest words, moved by the words' offsets in the window,
are intersected, and what is left is compared with the other words' postings.

Postings stay with their segment, so no word, however frequent, brings rows
together in one task, and only counts per word and segment are shuffled.  The
test items are taken in blocks of a bounded number of words; any number of
blocks is worked through, each against all documents.
"""

from __future__ import annotations

import hashlib
from collections import defaultdict
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import broadcast_if_small, cut, merged, row_digest
from .words import alnum_words, utf8

WINDOW = 13
#: Rare words whose posting lists are intersected first.
RAREST = 3
#: A segment is closed once it has so many words; a longer document has one of its own.
SEGMENT_WORDS = 1_000_000
#: Bytes of test items worked through at once.
BLOCK_BYTES = 8 << 20
#: Words that a proximity match may be moved by, and the share of a window's words it needs.
SLOP, NEAR_SHARE = 2, 0.8
#: Rare words that have to agree before a place is compared.
AGREE = 3
#: Places compared at once.
NEAR_ROWS = 1 << 14

SEGMENT = "segment long, doc array<string>, start array<int>, term array<int>, first array<int>, place array<int>"


def build_index(docs: DataFrame, vocabulary: list[bytes], key: str = "doc_id", text: str = "text") -> DataFrame:
    """The index of ``docs`` for the words of ``vocabulary``: one row per segment.

    ``doc`` holds the keys as strings, ``start`` where each document starts
    (one more at the end), ``term`` the words' numbers, ``first`` where each
    one's places start in ``place``.  Places count all words of the segment,
    with a gap of one after each document.
    """
    number = {w: i for i, w in enumerate(vocabulary)}

    def segment(doc: list, ids: list[np.ndarray]) -> dict:
        start = np.cumsum([0, *(len(x) + 1 for x in ids)])
        words = np.full(start[-1], -1, np.int32)
        for x, at in zip(ids, start, strict=False):
            words[at : at + len(x)] = x
        place = np.flatnonzero(words >= 0)
        place = place[np.argsort(words[place], kind="stable")]
        term, first = np.unique(words[place], return_index=True)
        return {"doc": doc, "start": start, "term": term, "first": np.append(first, len(place)), "place": place}

    schema = pa.schema([("segment", pa.int64()), ("doc", pa.list_(pa.string())), *((c, pa.list_(pa.int32())) for c in ("start", "term", "first", "place"))])

    def index(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        task, n = TaskContext.get().partitionId(), 0

        def row(doc: list, ids: list) -> pa.RecordBatch:
            nonlocal n
            n += 1
            made = segment(doc, ids) | {"segment": (task << 32) + n}
            listed = lambda name: pa.ListArray.from_arrays([0, len(made[name])], pa.array(made[name], schema.field(name).type.value_type))
            return pa.RecordBatch.from_arrays([pa.array([made["segment"]], pa.int64()), *(listed(f.name) for f in schema if f.name != "segment")], schema=schema)

        doc, ids, total = [], [], 0
        for batch in batches:
            for k, raw in zip(batch.column(0).to_pylist(), utf8(batch.column(1)), strict=True):
                words = alnum_words(raw)
                doc.append(k)
                ids.append(np.fromiter((number.get(w, -1) for w in words), np.int32, len(words)))
                total += len(words)
                if total >= SEGMENT_WORDS:
                    yield row(doc, ids)
                    doc, ids, total = [], [], 0
        if doc:
            yield row(doc, ids)

    return docs.select(F.col(key).cast("string"), text).mapInArrow(index, SEGMENT)


def windows_of(items: list[tuple[str, bytes]], length: int) -> dict[tuple[bytes, ...], set[str]]:
    """The distinct windows of the items' words, and the items that have each."""
    found: dict[tuple[bytes, ...], set[str]] = defaultdict(set)
    for item, raw in items:
        words = alnum_words(raw)
        for i in range(max(1, len(words) - length + 1) if words else 0):
            found[tuple(words[i : i + length])].add(item)
    return found


def _places(seg: dict, number: int) -> np.ndarray:
    i = np.searchsorted(seg["term"], number)
    if i == len(seg["term"]) or seg["term"][i] != number:
        return np.empty(0, np.int64)
    return seg["place"][seg["first"][i] : seg["first"][i + 1]]


def _lookup(seg: dict, window: np.ndarray, order: np.ndarray) -> np.ndarray:
    """Where ``window`` starts in the segment: offset-adjusted lists, the rarest (``order``) first."""
    found = None
    for n, j in enumerate(order):
        if n < RAREST or found is None:
            at = _places(seg, window[j]) - j
            found = at if found is None else np.intersect1d(found, at, assume_unique=True)
        else:
            found = found[seg["words"][found + j] == window[j]]
        if not len(found):
            break
        if n == 0:
            found = found[(found >= 0) & (found + len(window) < len(seg["words"]))]
    return found


def _near(seg: dict, window: np.ndarray, order: np.ndarray, slop: int, share: float) -> np.ndarray:
    """Documents with a place at which at least ``share`` of the words stand within ``slop`` of theirs.

    If ``lost`` words may be missing, ``lost + n`` words have ``n`` near their
    places in any match: places at which that many of the rarest (``order``)
    agree are compared, each within one document.
    """
    need = int(np.ceil(share * len(window)))
    lost = len(window) - need
    some = order[: lost + AGREE]
    agree = len(some) - lost
    at = np.sort(np.concatenate([_moved(seg, window[j], slop) - j for j in some]), kind="stable")
    at = np.unique(at[: len(at) - agree + 1][at[: len(at) - agree + 1] == at[agree - 1 :]])
    start, found = seg["start"], []
    reach = np.arange(-slop, len(window) + slop)
    for i in range(0, len(at), NEAR_ROWS):
        place = at[i : i + NEAR_ROWS, None] + reach
        words = seg["words"][np.clip(place, 0, len(seg["words"]) - 1)]
        first, last = (np.clip(np.searchsorted(start, place[:, j], side="right") - 1, 0, len(start) - 2) for j in (0, -1))
        for k in range(int((last - first).max()) + 1):
            d = np.minimum(first + k, last)
            around = np.where((place >= start[d, None]) & (place < start[d + 1, None] - 1), words, -1)
            hit = around[:, : len(window)] == window
            for m in range(1, 2 * slop + 1):
                hit |= around[:, m : m + len(window)] == window
            found.append(d[hit.sum(axis=1) >= need])
    return np.unique(np.concatenate(found)) if found else at


def _moved(seg: dict, number: int, slop: int) -> np.ndarray:
    """The places up to ``slop`` from a word's, sorted; kept for the windows that follow."""
    if number not in seg["moved"]:
        seg["moved"][number] = np.unique(_places(seg, number)[:, None] + np.arange(-slop, slop + 1, dtype=np.int32))
    return seg["moved"][number]


MATCH = "segment long, n int, doc string, n_words long, spans array<struct<start:int,end:int>>, items array<string>, near_items array<string>"


def find_matches(index: DataFrame, windows: list[tuple[tuple[int, ...], list[str]]], order: list[np.ndarray], slop: int = SLOP, share: float = NEAR_SHARE) -> DataFrame:
    """One row per document of the index: its merged spans of words hit, items matched, items near.

    ``windows`` are word numbers with their items; ``order`` has each one's offsets by rarity.
    """
    numbers = [np.array(w, np.int32) for w, _ in windows]
    span = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())]))
    schema = pa.schema([("segment", pa.int64()), ("n", pa.int32()), ("doc", pa.string()), ("n_words", pa.int64()), ("spans", span), ("items", pa.list_(pa.string())), ("near_items", pa.list_(pa.string()))])

    def one(row: pa.RecordBatch, i: int) -> pa.RecordBatch:
        seg = {c: np.asarray(row.column(c)[i].values) for c in ("start", "term", "first", "place")}
        start, docs = seg["start"], row.column("doc")[i].as_py()
        words = np.full(start[-1], -1, np.int32)
        words[seg["place"]] = np.repeat(seg["term"], np.diff(seg["first"]))
        seg["words"], seg["moved"] = words, {}
        hit, items, near = np.zeros(len(words) + 1, np.int32), defaultdict(set), defaultdict(set)
        for w, by, (_, names) in zip(numbers, order, windows, strict=True):
            at = _lookup(seg, w, by)
            if len(at):
                np.add.at(hit, at, 1)
                np.add.at(hit, at + len(w), -1)
                for d in np.unique(np.searchsorted(start, at, side="right") - 1):
                    items[d].update(names)
            if slop:
                for d in _near(seg, w, by, slop, share):
                    near[d].update(names)
        edge = np.flatnonzero(np.diff(np.concatenate([[False], np.cumsum(hit[:-1]) > 0, [False]])))
        spans: dict[int, list] = defaultdict(list)
        for a, b in edge.reshape(-1, 2):
            d = int(np.searchsorted(start, a, side="right") - 1)
            spans[d].append({"start": int(a - start[d]), "end": int(b - start[d])})
        n = len(docs)
        return pa.RecordBatch.from_arrays([
            pa.array([row.column("segment")[i].as_py()] * n, pa.int64()), pa.array(range(n), pa.int32()), pa.array(docs, pa.string()), pa.array(np.diff(start) - 1, pa.int64()),
            pa.array([spans.get(d, []) for d in range(n)], span), pa.array([sorted(items.get(d, ())) for d in range(n)], pa.list_(pa.string())), pa.array([sorted(near.get(d, ())) for d in range(n)], pa.list_(pa.string())),
        ], schema=schema)

    def look(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                yield one(batch, i)

    return index.mapInArrow(look, MATCH)


def _blocks(items: DataFrame, item: str, text: str, block_bytes: int) -> Iterator[list[tuple[str, bytes]]]:
    """The items in blocks of a bounded size; the driver holds one at a time."""
    block, size = [], 0
    for k, t in items.filter(F.col(text).isNotNull()).select(F.coalesce(F.col(item).cast("string"), F.lit("")), text).toLocalIterator():
        block.append((k, t.encode()))
        size += len(block[-1][1])
        if size >= block_bytes:
            yield block
            block, size = [], 0
    yield block


def contaminated_words(docs: DataFrame, items: DataFrame, key: str = "doc_id", text: str = "text", item: str = "item_id", item_text: str = "text", window: int = WINDOW, slop: int = SLOP, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """Per row of ``docs``: key, n_words, spans of words hit (merged, from 0, end open), items, near_items.

    A word is hit inside any occurrence of a window: ``window`` consecutive
    words of an item, or all of a shorter one.  ``items`` are the ids, as
    strings in order, of the items with occurring windows; ``near_items``
    those with a proximity match, exact ones included: any words of a window,
    its rarest too, may be moved by ``slop`` or, up to a fifth of them, be
    missing.  A null text has no words; items without words have no windows.  Repeated rows are kept apart.
    """
    kind = docs.schema[key].dataType
    narrow = merged(docs).select(key, text)
    found = []
    for block in _blocks(items, item, item_text, block_bytes):
        by_words = windows_of(block, window)
        vocabulary = sorted({w for words in by_words for w in words})
        number = {w: i for i, w in enumerate(vocabulary)}
        index = cut(build_index(narrow, vocabulary, key, text))
        each = F.explode(F.arrays_zip("term", F.expr("transform(term, (t, i) -> first[i + 1] - first[i])").alias("n")))
        counts = index.select(each.alias("x")).groupBy("x.term").agg(F.sum("x.n").alias("n")).collect()  # a row per word of the block
        often = np.zeros(len(vocabulary), np.int64)
        for term, n in counts:
            often[term] = n
        windows, order = [], []
        for words, ids in sorted(by_words.items()):
            numbers = tuple(number[w] for w in words)
            by = np.argsort(often[list(numbers)], kind="stable")
            if often[numbers[by[0]]] or slop:
                windows.append((numbers, sorted(ids)))
                order.append(by)
        found.append(find_matches(index, windows, order, slop))
    if len(found) == 1:
        out = found[0]
    else:
        whole = reduce(DataFrame.unionByName, found).groupBy("segment", "n", "doc").agg(
            F.max("n_words").alias("n_words"), F.array_sort(F.flatten(F.collect_list("spans"))).alias("spans"),
            F.array_sort(F.array_distinct(F.flatten(F.collect_list("items")))).alias("items"), F.array_sort(F.array_distinct(F.flatten(F.collect_list("near_items")))).alias("near_items"),
        )
        merge = """aggregate(spans, cast(array() as array<struct<start:int,end:int>>), (a, s) -> if(size(a) > 0 and element_at(a, -1).end >= s.start,
          concat(slice(a, 1, size(a) - 1), array(named_struct('start', element_at(a, -1).start, 'end', greatest(element_at(a, -1).end, s.end)))), concat(a, array(s))))"""
        out = whole.withColumn("spans", F.expr(merge))
    return out.select(F.col("doc").cast(kind).alias(key), "n_words", "spans", "items", "near_items")


def n_hit():
    return F.aggregate("spans", F.lit(0).cast("long"), lambda s, x: s + x["end"] - x["start"])


def contaminated():
    """At least one word in twenty is hit."""
    return (n_hit() > 0) & (n_hit() * 20 >= F.col("n_words"))


def clean_documents(docs: DataFrame, items: DataFrame, key: str = "doc_id", text: str = "text", **more) -> DataFrame:
    """The rows of ``docs`` that aren't contaminated; all columns.  Rows that agree in key and text are judged alike."""
    row = row_digest(key, text)
    rows = docs.select(row.alias("_gapline_row"), F.col(text).alias("text"))
    bad = cut(contaminated_words(rows, items, key="_gapline_row", text="text", **more).filter(contaminated()).select("_gapline_row").distinct(), docs.count())
    return merged(docs).withColumn("_gapline_row", row).join(broadcast_if_small(bad, 96), "_gapline_row", "left_anti").select(*docs.columns)


def brute_force(docs: list[tuple], items: list[tuple], window: int = WINDOW) -> list[tuple]:
    """The same by comparing every window at every word, for tests: (key, n_words, n_hit, items)."""
    by_words, out = windows_of([("" if k is None else str(k), t.encode()) for k, t in items if t is not None], window), []
    lengths = {len(w) for w in by_words}
    for key, text in docs:
        words = alnum_words((text or "").encode())
        hit, ids = set(), set()
        for i in range(len(words)):
            for n in lengths:
                if i + n <= len(words) and (w := tuple(words[i : i + n])) in by_words:
                    hit.update(range(i, i + n))
                    ids |= by_words[w]
        out.append((key, len(words), len(hit), sorted(ids)))
    return out


def digest(items: list[str]) -> str:
    return hashlib.sha256(",".join(items).encode()).hexdigest()
