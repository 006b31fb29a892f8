"""Substring de-duplication by hashing lines, the sentences in them, and anchors among the words.

A text is cut into units: lines, and within them what ends in a full stop,
question or exclamation mark.  Units are normalised (lower-case words, nothing
else) and hashed.  Digests are grouped over all documents; the occurrence that
comes first, by document key and place, stays, and every other is repeated.

Where units are too short or a copy starts and ends within them, anchors find
it: runs of ANCHOR_WORDS words, chosen by their digests alone, so that every
stretch of a passage's least size has one, wherever lines and sentences end.
Anchors are hashed and grouped with the units.

Repeated units and anchors that touch, or that stand equally far apart at
their first occurrence, make up a passage.  Its ends are then compared word by
word with the first occurrence, as far as a copy can reach beyond its outermost
anchors, and it is removed if it has enough words.  All offsets are the
original text's.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import BROADCAST_BYTES, cut, merged, new_dir
from .words import _ALNUM, utf8

#: Units of fewer words are not hashed; they go with the passage around them.
UNIT_WORDS = 4
#: Passages of fewer words stay: a line that many documents share by nature, such as a heading, is no copied text.
PASSAGE_WORDS = 20
#: Whole lines of so many words go wherever they repeat, however short the passage around them; None leaves them to it.
LINE_WORDS = 8
UNIT, WHOLE, LINE = 0, 1, 2
#: Kinds of bytes, by which units are cut; white space last.
_LETTER, _MARK, _BLANK, _NEWLINE = 0, 1, 2, 3
_KINDS = np.array([_NEWLINE if c == 10 else _BLANK if c in b" \t\r\f\v" else _MARK if c in b".!?" else _LETTER for c in range(256)], np.uint8)
#: Letters of scripts that are written without spaces, from kana to Han, by their first bytes.
_DENSE = re.compile(rb"[\xE3-\xE9][\x80-\xBF]{2}")
PIECES = "unit int, word int, n_words int, start int, end int, whole boolean, digest long, fresh boolean"
#: Words of an anchor.
ANCHOR_WORDS = 8
#: Bits of the map by which pieces that stand once are left out early.
MAP_BITS = 1 << 24
#: Places whose words are sent on at once, about.
PLACES = 1 << 14
#: Words hashed at once.
HASH_WORDS = 1 << 18
_BASE = np.uint64(0x9E3779B97F4A7C15)
_BYTES = np.random.default_rng(7).integers(1, 1 << 63, 256, np.uint64)


def units_of(raw: bytes, least: int = UNIT_WORDS, line: int | None = LINE_WORDS) -> list[tuple[int, int, int, int, int]]:
    """(start, end, words, digest, kind) of the units with at least ``least`` words, one at least; offsets in bytes, from the first letter to behind the last.

    Kinds are UNIT, WHOLE for a unit that is a line of at least ``line`` words,
    and LINE for such a line that has several units, besides these.
    """
    return list(zip(*(x.tolist() for x in _units(raw, *word_places(raw), least, line)), strict=True))


def _units(raw: bytes, starts: np.ndarray, ends: np.ndarray, least: int, line: int | None) -> list[np.ndarray]:
    """The columns of ``units_of``, by the places of the text's words."""
    kinds = _KINDS[np.frombuffer(raw + b"x", np.uint8)]
    here, after = kinds[:-1], kinds[1:]
    # Units end behind line ends, and behind marks before other white space; what comes before a line's end goes with it.
    last = np.append(np.flatnonzero(((here == _NEWLINE) & (after != _NEWLINE)) | ((here == _MARK) & (after == _BLANK))) + 1, len(raw))
    first = np.concatenate([[0], last[:-1]])
    closes = np.append(here[last[:-1] - 1] == _NEWLINE, True)
    # The line's first unit: the one behind the last that closes a line.
    begins = np.concatenate([[0], np.flatnonzero(closes[:-1]) + 1])
    begin = first[begins[np.cumsum(closes) - closes]]
    kind = np.where(closes & (first == begin) & (line is not None), WHOLE, UNIT)
    several = np.flatnonzero(closes & (first != begin)) if line is not None else first[:0]
    order = np.argsort(np.concatenate([2 * np.arange(len(last)), 2 * several + 1]), kind="stable")
    a, b = np.concatenate([first, begin[several]])[order], np.concatenate([last, last[several]])[order]
    kind = np.concatenate([kind, np.full(len(several), LINE)])[order]
    w, v = np.searchsorted(starts, a), np.searchsorted(starts, b)
    n = v - w
    kept = (n >= max(1, least)) & ((kind != LINE) | (n >= (line or 0)))
    a, b, n, w, v, kind = a[kept], b[kept], n[kept], w[kept], v[kept], kind[kept]
    kind[(kind == WHOLE) & (n < (line or 0))] = UNIT
    ink = np.flatnonzero(here < _BLANK)
    return [ink[np.searchsorted(ink, a)], ink[np.searchsorted(ink, b) - 1] + 1, n, _unit_digests(raw, a, b, starts, ends, w, v), kind]


def _unit_digests(raw: bytes, a: np.ndarray, b: np.ndarray, starts: np.ndarray, ends: np.ndarray, w: np.ndarray, v: np.ndarray) -> np.ndarray:
    """Digests of the words of each stretch from ``a`` to ``b``, which are the words ``w`` to ``v``, joined by single spaces."""
    words = raw.translate(_ALNUM)
    joined, at = b" ".join(words.split()), np.append(0, np.cumsum(ends - starts + 1))
    if at[-1] == len(joined) + 1:
        of = [joined[i:j] for i, j in zip(at[w].tolist(), (at[v] - 1).tolist(), strict=True)]
    else:  # some of these words have no space between them
        of = [b" ".join(words[i:j].split()) for i, j in zip(a.tolist(), b.tolist(), strict=True)]
    return np.array([xxhash.xxh3_64_intdigest(x) for x in of], np.uint64)


def word_places(raw: bytes) -> tuple[np.ndarray, np.ndarray]:
    """Where the words of a text start and end, in bytes; each letter of a script without spaces is one."""
    letters = np.frombuffer(b" " + raw.translate(_ALNUM) + b" ", np.uint8) != 32
    edge = np.flatnonzero(letters[1:] != letters[:-1])
    start, end = edge[::2], edge[1::2]
    if _DENSE.search(raw) is None:
        return start, end
    more = np.unique(np.array([m.span() for m in _DENSE.finditer(raw)]))
    more = np.setdiff1d(more, np.concatenate([start, end]), assume_unique=True)
    return np.sort(np.concatenate([start, more])), np.sort(np.concatenate([end, more]))


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _word_digests(raw: bytes, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """A digest of each word's letters."""
    lower, out = np.frombuffer(raw.translate(_ALNUM), np.uint8), np.empty(len(start), np.uint64)
    for i in range(0, len(start), HASH_WORDS):
        a, size = start[i : i + HASH_WORDS], (end - start)[i : i + HASH_WORDS]
        first = np.cumsum(size) - size
        within = np.arange(first[-1] + size[-1]) - np.repeat(first, size)
        power = np.cumprod(np.full(size.max(), _BASE))
        out[i : i + HASH_WORDS] = _mix(np.add.reduceat(_BYTES[lower[np.repeat(a, size) + within]] * power[within], first))
    return out


def _run_digests(words: np.ndarray, n: int) -> np.ndarray:
    """A digest of each ``n`` neighbouring words."""
    out = np.zeros(max(0, len(words) - n + 1), np.uint64)
    for i in range(n if len(out) else 0):
        out = out * _BASE + words[i : i + len(out)]
    return _mix(out)


def _sliding(best: np.ufunc, x: np.ndarray, n: int) -> np.ndarray:
    """``best`` of each ``n`` neighbours."""
    out, width = x, 1
    while 2 * width <= n:
        out, width = best(out[:-width], out[width:]), 2 * width
    return best(out[: len(x) - n + 1], out[n - width :])


def anchors_of(words: np.ndarray, passage: int) -> tuple[np.ndarray, np.ndarray]:
    """Where the anchors of a text start, by the digests of its words, and their digests: the runs that are least among those of a stretch of ``passage`` words."""
    n = min(ANCHOR_WORDS, passage)
    runs, wide = _run_digests(words, n), passage - n + 1
    if len(runs) < wide:
        return np.empty(0, np.int64), runs[:0]
    none = np.zeros(wide - 1, np.uint64)  # zero is no stretch's
    least = np.concatenate([none, _sliding(np.minimum, runs, wide), none])
    at = np.flatnonzero(_sliding(np.maximum, least, wide) == runs)  # an anchor is the greatest of its stretches' least ones
    return at, runs[at]


def _code_points(raw: bytes) -> np.ndarray | None:
    """For each byte the code points before it; None if that is the byte's own place."""
    return None if raw.isascii() else np.concatenate([[0], np.cumsum((np.frombuffer(raw, np.uint8) & 0xC0) != 0x80)])


def pieces_of(raw: bytes, least: int = UNIT_WORDS, passage: int | None = PASSAGE_WORDS, line: int | None = LINE_WORDS) -> list[np.ndarray]:
    """unit (its number; -1 for an anchor, -2 for a line of several), word (words before it), n_words, start, end (code points), whole, digest, fresh (first of its digest in the text); without ``passage`` no anchors."""
    starts, ends = word_places(raw)
    a, b, n, digest, kinds = _units(raw, starts, ends, least, line)
    word, unit, whole = np.searchsorted(starts, a), np.where(kinds == LINE, -2, np.cumsum(kinds != LINE) - 1), kinds != UNIT
    if passage and len(starts) >= passage:
        at, found = anchors_of(_word_digests(raw, starts, ends), passage)
        size = min(ANCHOR_WORDS, passage)
        unit, word, n = np.concatenate([unit, np.full(len(at), -1)]), np.concatenate([word, at]), np.concatenate([n, np.full(len(at), size)])
        a, b, digest = np.concatenate([a, starts[at]]), np.concatenate([b, ends[at + size - 1]]), np.concatenate([digest, found])
        whole = np.concatenate([whole, np.zeros(len(at), bool)])
    if (before := _code_points(raw)) is not None:
        a, b = before[a], before[b]
    fresh = np.zeros(len(digest), bool)
    fresh[np.unique(digest, return_index=True)[1]] = True
    return [unit, word, n, a, b, whole, digest.view(np.int64), fresh]


def pieces(docs: DataFrame, least: int = UNIT_WORDS, passage: int | None = PASSAGE_WORDS, key: str = "doc_id", text: str = "text", line: int | None = LINE_WORDS) -> DataFrame:
    """The hashed units and anchors of each row: key and the columns of ``pieces_of``."""
    kind = docs.schema[key].dataType.simpleString()
    names = [key, *(x.split()[0] for x in PIECES.split(", "))]

    def rows(keys: pa.Array, of: list[tuple[int, list[np.ndarray]]]) -> pa.RecordBatch:
        columns = [np.concatenate(c) for c in zip(*(x for _, x in of), strict=True)]
        take = np.repeat([i for i, _ in of], [len(x[0]) for _, x in of])
        return pa.RecordBatch.from_arrays([keys.take(pa.array(take, pa.int64())), *(pa.array(c.astype(np.int32)) for c in columns[:5]), *map(pa.array, columns[5:])], names=names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            of, size = [], 0
            for i, raw in enumerate(utf8(batch.column(1))):
                of.append((i, pieces_of(raw, least, passage, line)))
                size += len(raw)
                if size >= 4 << 20:
                    yield rows(batch.column(0), of)
                    of, size = [], 0
            if of:
                yield rows(batch.column(0), of)

    return docs.select(key, text).mapInArrow(run, f"`{key}` {kind}, {PIECES}")


def repeated_pieces(docs: DataFrame, least: int = UNIT_WORDS, passage: int | None = PASSAGE_WORDS, key: str = "doc_id", text: str = "text", line: int | None = LINE_WORDS) -> DataFrame:
    """The pieces that stand somewhere before: key, unit, word, n_words, start, end, whole, first_key, first_word.

    Pieces are made once and kept in a Parquet table.  Their digests alone are
    counted, combined before they are shuffled.  Few are repeated, and only
    the pieces of these are kept for what follows: those that a bit map of
    bounded size lets through, by a join that has one row per digest on one
    side, so that Spark can split a digest with very many pieces on the other.
    """
    path = new_dir(docs.sparkSession, "pieces")
    pieces(merged(docs).select(key, text), least, passage, key, text, line).write.parquet(path, compression="zstd")
    every = docs.sparkSession.read.parquet(path)
    twice = cut(every.groupBy("digest").agg(F.count("*").alias("_n")).filter("_n > 1").select("digest"))
    found = cut(_let_through(every, twice).join(twice, "digest"))
    place = F.min(F.struct(F.col(key).isNull().alias("null"), F.col(key).alias("key"), "word")).alias("_first")
    some = found.groupBy("digest").agg(place).select("digest", F.col("_first.key").alias("first_key"), F.col("_first.word").alias("first_word"))
    first = F.col(key).eqNullSafe(F.col("first_key"))
    placed = found.join(some, "digest").filter(~(first & F.col("fresh")))
    return placed.select(key, "unit", "word", "n_words", "start", "end", "whole", "first_key", "first_word")


def _let_through(every: DataFrame, wanted: DataFrame) -> DataFrame:
    """The rows whose digest may be ``wanted``: a map of MAP_BITS bits, in rows of 64, has the bits of all wanted digests and is broadcast.

    It lets all wanted rows through, and of the others as large a share as it
    has bits set: few while MAP_BITS is large against the wanted digests, in
    the end all, which costs time but no result.
    """
    row = F.shiftright(F.col("digest").bitwiseAND(F.lit(MAP_BITS - 1)), 6).alias("_row")
    bit = F.expr("shiftleft(1L, cast(digest & 63 AS int))")
    bits = wanted.select(row, bit.alias("_bit")).groupBy("_row").agg(F.bit_or("_bit").alias("_bits"))
    met = every.withColumn("_row", row).join(F.broadcast(bits), "_row")  # at most MAP_BITS / 64 rows of 16 bytes
    return met.filter(F.col("_bits").bitwiseAND(bit) != 0).drop("_row", "_bits")


def _passage_type(kind: str) -> str:
    return f"array<struct<word:int,behind:int,start:int,end:int,n_words:int,keys:array<{kind}>,left_key:{kind},left_word:int,right_key:{kind},right_word:int,whole:boolean>>"


def _put_together(passage: int, kind: str):
    """An Arrow function that puts a text's repeated pieces together."""
    @F.arrow_udf(_passage_type(kind))
    def put(rows: pa.Array) -> pa.Array:
        key_type = rows.type.value_type.field("first_key").type
        whole = [pa.int32()] * 5
        names = ["word", "behind", "start", "end", "n_words", "keys", "left_key", "left_word", "right_key", "right_word", "whole"]
        out_kind = pa.list_(pa.struct(list(zip(names, [*whole, pa.list_(key_type), key_type, pa.int32(), key_type, pa.int32(), pa.bool_()], strict=True))))
        found = list(zip(*(c.to_pylist() for c in rows.flatten().flatten()), strict=True))
        ends = np.concatenate([[0], np.cumsum(pc.list_value_length(rows).fill_null(0).to_numpy(zero_copy_only=False))]).tolist()
        return pa.array([together(found[a:b], passage) for a, b in zip(ends[:-1], ends[1:], strict=True)], out_kind)

    return put


def together(found: list[tuple], passage: int) -> list[dict]:
    """Passages of (word, n_words, unit, start, end, first_key, first_word, whole): runs of pieces that touch or overlap.

    ``whole`` tells those that hold a whole repeated line.

    Between two units, units of too few words may stand, which don't count;
    between two anchors that are equally far apart at their first occurrence,
    as many words as a copy can have there, which do.
    """
    units = sorted(p for p in found if p[2] >= 0)
    anchors = sorted((p for p in found if p[2] == -1), key=lambda p: p[0])
    fill = [(u[0] + u[1], v[0] - u[0] - u[1], False) for u, v in zip(units, units[1:], strict=False) if v[2] == u[2] + 1 and v[3] >= u[4] and v[0] > u[0] + u[1]]
    fill += [(u[0] + u[1], gap, True) for u, v in zip(anchors, anchors[1:], strict=False) if 0 < (gap := v[0] - u[0] - u[1]) <= passage - u[1] and u[5] == v[5] and v[0] - u[0] == v[6] - u[6]]
    every = sorted([(p[0], 0, p) for p in found] + [(w, 1, (w, n, c)) for w, n, c in fill], key=lambda x: x[:2])
    out: list[dict] = []
    behind = counted = -1  # the word behind the passage, and behind the words counted
    for word, filling, p in every:
        if word > behind:
            out.append({"word": word, "behind": word, "start": p[3], "end": p[4], "n_words": 0, "keys": set(), "left_key": p[5], "left_word": p[6], "right_key": p[5], "right_word": p[6] + p[1], "whole": False})
        last = out[-1]
        if not filling or p[2]:
            last["n_words"] += max(0, word + p[1] - max(word, counted))
            counted = max(counted, word + p[1])
        if not filling:
            last["keys"].add(p[5])
            last["whole"] |= p[7]
            if word + p[1] > last["behind"]:
                last |= {"behind": word + p[1], "end": max(last["end"], p[4]), "right_key": p[5], "right_word": p[6] + p[1]}
        behind = max(behind, word + p[1])
    return [x | {"keys": sorted(x["keys"], key=lambda k: (k is None, k))} for x in out]


def _contexts(docs: DataFrame, wanted: DataFrame, reach: int, key: str, text: str) -> DataFrame:
    """_key, word, side, digests, places: of the places ``wanted`` (_key, _at array<long>: 2 * word + side) the words before (side 0, nearest first) or from there on (1), and where these start or end."""
    kind = docs.schema[key].dataType.simpleString()
    names = ["_key", "word", "side", "digests", "places"]

    def around(raw: bytes, at: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        starts, ends = word_places(raw)
        word, side, step = at >> 1, at & 1, np.arange(reach)
        every = np.where(side[:, None] == 0, word[:, None] - 1 - step, word[:, None] + step)
        good = (every >= 0) & (every < len(starts))
        size, where = good.sum(axis=1), every[good]
        asked, place = np.unique(where, return_inverse=True)
        starts, ends = starts[asked], ends[asked]
        digests = _word_digests(raw, starts, ends).view(np.int64) if len(asked) else np.empty(0, np.int64)
        if (before := _code_points(raw)) is not None:
            starts, ends = before[starts], before[ends]
        return size, digests[place], np.where(np.repeat(side, size) == 0, starts[place], ends[place])

    def sent(keys: pa.Array, of: list[tuple]) -> pa.RecordBatch:
        numbers, at, sizes, digests, places = (np.concatenate(c) for c in zip(*of, strict=True))
        offsets = pa.array(np.append(0, np.cumsum(sizes)), pa.int32())
        lists = (pa.ListArray.from_arrays(offsets, pa.array(digests)), pa.ListArray.from_arrays(offsets, pa.array(places.astype(np.int32))))
        return pa.RecordBatch.from_arrays([keys.take(pa.array(numbers)), pa.array((at >> 1).astype(np.int32)), pa.array((at & 1).astype(np.int32)), *lists], names=names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            of, size = [], 0
            for i, raw in enumerate(utf8(batch.column(1))):
                at = batch.column(2)[i].values.to_numpy()
                of.append((np.full(len(at), i), at, *around(raw, at)))
                size += len(at)
                if size >= PLACES:
                    yield sent(batch.column(0), of)
                    of, size = [], 0
            if of:
                yield sent(batch.column(0), of)

    size, rows = wanted.agg(F.sum(F.size("_at")), F.count("*")).first()
    small = F.broadcast(wanted) if (size or 0) * 8 + rows * 96 <= BROADCAST_BYTES else wanted  # else both sides are shuffled
    narrow = docs.select(key, text)
    met = narrow.join(small, narrow[key].eqNullSafe(F.col("_key"))).select(F.col("_key"), text, "_at")
    return met.mapInArrow(run, f"_key {kind}, word int, side int, digests array<long>, places array<int>")


def copied_passages(docs: DataFrame, least: int = UNIT_WORDS, passage: int = PASSAGE_WORDS, key: str = "doc_id", text: str = "text", line: int | None = LINE_WORDS) -> DataFrame:
    """The passages to remove: key, start, end (code points from 0, end open), n_words, first_keys (sorted keys at which its pieces stand first).

    A piece's first occurrence is the one with the least key, and in that text
    the first.  Rows that share a key, null included, count as one document:
    none repeats another of them, but what they repeat of others goes from
    all.  Keys that are null come after all others.  A passage has at least
    ``passage`` words that are in a repeated unit or anchor, between anchors
    of one copy, or like the first occurrence's at its ends; a copied run of
    2 * passage words and more is found whole, a shorter one unless each of
    its few anchors stands somewhere else before.  Null and empty texts have
    no pieces.  Text without spaces, such as a line of Chinese, is one word
    between two marks or line ends.  The pieces of one document are gathered
    in one row, and nothing larger is.
    """
    return _passages(docs, least, passage, key, text, line, anchors=True)


def repeated_passages(docs: DataFrame, least: int = UNIT_WORDS, passage: int = PASSAGE_WORDS, key: str = "doc_id", text: str = "text", line: int | None = LINE_WORDS) -> DataFrame:
    """Passages of whole repeated units alone; columns, and what counts as first, as in ``copied_passages``."""
    return _passages(docs, least, passage, key, text, line, anchors=False)


def _passages(docs: DataFrame, least: int, passage: int, key: str, text: str, line: int | None, anchors: bool) -> DataFrame:
    kind = docs.schema[key].dataType.simpleString()
    found = repeated_pieces(docs, least, passage if anchors else None, key, text, line)
    rows = found.groupBy(F.col(key).alias("_key")).agg(F.collect_list(F.struct("word", "n_words", "unit", "start", "end", "first_key", "first_word", "whole")).alias("_pieces"))
    some = rows.select("_key", F.posexplode(_put_together(passage, kind)(F.col("_pieces"))).alias("_p", "p")).select("_key", "_p", "p.*")
    reach = passage - min(ANCHOR_WORDS, passage)
    if anchors and reach:
        some = _extended(docs, cut(some.filter((F.col("n_words") + 2 * reach >= passage) | F.col("whole"))), reach, key, text)
    rows = some.groupBy("_key").agg(F.collect_list(F.struct("word", "behind", "start", "end", "n_words", "keys", "whole")).alias("_all"))
    out = rows.select("_key", F.explode(_disjoint(kind)(F.col("_all"))).alias("p")).filter((F.col("p.n_words") >= passage) | F.col("p.whole"))
    return out.select(F.col("_key").alias(key), "p.start", "p.end", "p.n_words", "p.first_keys")


def _extended(docs: DataFrame, some: DataFrame, reach: int, key: str, text: str) -> DataFrame:
    """Passages with their ends moved outward while the words are the first occurrence's."""
    ends = some.select("_key", "_p", F.explode(F.array(
        F.struct(F.lit(0).alias("side"), F.col("word").alias("at"), F.col("left_key").alias("first_key"), F.col("left_word").alias("first_at")),
        F.struct(F.lit(1).alias("side"), F.col("behind").alias("at"), F.col("right_key").alias("first_key"), F.col("right_word").alias("first_at")),
    )).alias("e")).select("_key", "_p", "e.*")
    place = lambda at: (F.col(at) * 2 + F.col("side")).cast("long")
    asked = ends.select(F.col("_key"), place("at").alias("a")).union(ends.select("first_key", place("first_at")))
    wanted = cut(asked.groupBy("_key").agg(F.collect_set("a").alias("_at")))
    contexts = _contexts(docs, wanted, reach, key, text).groupBy("_key", "word", "side").agg(F.min(F.struct("digests", "places")).alias("c"))  # rows that share a key
    contexts = cut(contexts)
    own = contexts.select(F.col("_key").alias("_k"), F.col("word").alias("at"), "side", F.col("c").alias("_own"))
    other = contexts.select(F.col("_key").alias("_f"), F.col("word").alias("first_at"), "side", F.col("c.digests").alias("_other"))
    on_own = ends["_key"].eqNullSafe(own["_k"]) & (ends["at"] == own["at"]) & (ends["side"] == own["side"])
    met = ends.join(own, on_own).select("_key", "_p", ends["side"], "first_key", "first_at", "_own")
    on_first = met["first_key"].eqNullSafe(other["_f"]) & (met["first_at"] == other["first_at"]) & (met["side"] == other["side"])
    both = met.join(other, on_first).select("_key", "_p", met["side"], "_own", "_other")
    n = F.least(F.size("_own.digests"), F.size("_other"))
    alike = F.coalesce(F.array_min(F.filter(F.transform(F.sequence(F.lit(1), F.greatest(n, F.lit(1))), lambda i: F.when(~F.get("_own.digests", i - 1).eqNullSafe(F.get("_other", i - 1)) | (i > n), i - 1)), lambda i: i.isNotNull())), n)
    moved = both.select("_key", "_p", "side", alike.alias("n"), "_own.places").select("_key", "_p", "side", "n", F.get("places", F.col("n") - 1).alias("to"))
    by_side = moved.groupBy("_key", "_p").agg(*[F.max(F.when(F.col("side") == s, F.struct("n", "to"))).alias(f"_{s}") for s in (0, 1)])
    joined = some.join(by_side.withColumnsRenamed({"_key": "_k", "_p": "_q"}), some["_key"].eqNullSafe(F.col("_k")) & (some["_p"] == F.col("_q")), "left")
    more = lambda s: F.coalesce(F.col(f"_{s}.n"), F.lit(0))
    return joined.select(
        "_key", (F.col("word") - more(0)).cast("int").alias("word"), (F.col("behind") + more(1)).cast("int").alias("behind"), F.coalesce(F.when(more(0) > 0, F.col("_0.to")), "start").alias("start"),
        F.coalesce(F.when(more(1) > 0, F.col("_1.to")), "end").alias("end"), (F.col("n_words") + more(0) + more(1)).cast("int").alias("n_words"), "keys", "whole",
    )


def _disjoint(kind: str):
    """An Arrow function that makes one passage of those that touch or overlap after their ends were moved."""
    @F.arrow_udf(f"array<struct<start:int,end:int,n_words:int,first_keys:array<{kind}>,whole:boolean>>")
    def disjoint(rows: pa.Array) -> pa.Array:
        key_type = rows.type.value_type.field("keys").type
        out_kind = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32()), ("n_words", pa.int32()), ("first_keys", key_type), ("whole", pa.bool_())]))
        out = []
        for i in range(len(rows)):
            passages: list[dict] = []
            behind = -1
            for p in sorted(rows[i].as_py(), key=lambda p: (p["word"], p["behind"], p["start"])):
                if p["word"] > behind:
                    passages.append({"start": p["start"], "end": p["end"], "n_words": p["n_words"], "first_keys": set(p["keys"]), "whole": p["whole"]})
                else:
                    last, shared = passages[-1], min(behind, p["behind"]) - p["word"]
                    last["end"], last["n_words"] = max(last["end"], p["end"]), last["n_words"] + max(0, p["n_words"] - shared)
                    last["first_keys"] |= set(p["keys"])
                    last["whole"] |= p["whole"]
                behind = max(behind, p["behind"])
            out.append([p | {"first_keys": sorted(p["first_keys"], key=lambda k: (k is None, k))} for p in passages])
        return pa.array(out, out_kind)

    return disjoint


@F.arrow_udf(T.StringType())
def _without(texts: pa.Array, spans: pa.Array) -> pa.Array:
    """Texts without their spans (start, end), which may overlap."""
    def one(text: str | None, cuts: list[dict] | None) -> str | None:
        if text is None or not cuts:
            return text
        kept, at = [], 0
        for c in sorted(cuts, key=lambda c: c["start"]):
            kept.append(text[at : max(at, c["start"])])
            at = max(at, c["end"])
        return "".join([*kept, text[at:]])

    return pa.array(map(one, texts.to_pylist(), spans.to_pylist()), pa.string())


def without_passages(docs: DataFrame, passages: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``docs`` with the passages cut out of their texts; all columns, rows without passages unchanged."""
    spans = cut(passages.groupBy(F.col(key).alias("_key")).agg(F.collect_set(F.struct("start", "end")).alias("_spans")))
    size, rows = spans.agg(F.sum(F.size("_spans")), F.count("*")).first()
    small = F.broadcast(spans) if (size or 0) * 16 + rows * 128 <= BROADCAST_BYTES else spans  # else both sides are shuffled
    joined = docs.join(small, docs[key].eqNullSafe(F.col("_key")), "left")
    return joined.withColumn(text, F.when(F.col("_spans").isNull(), F.col(text)).otherwise(_without(F.col(text), F.col("_spans")))).select(*docs.columns)
