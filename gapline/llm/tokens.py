"""Token-ID output: texts to ids, written as framed binary records in the order of their keys, and read back."""

from __future__ import annotations

import os
import re
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import records
from .common import broadcast_if_small, kept, merged, new_dir

#: Pieces of text whose ids a task remembers; when so many have come, those not seen since the last time are forgotten.
REMEMBERED = 250_000
#: Texts encoded together hold at least so many characters, unless they are the last.
TOGETHER = 1 << 20
#: Bytes of a piece that numpy looks up; longer ones are looked up one by one.
SHORT = 16
#: White space of every definition; text is cut at these characters only.
_SPACE = np.isin(np.arange(256), [9, 10, 13, 32])
#: The first so many bytes of a piece.
_FIRST = np.array([[(1 << 8 * min(8, max(0, n - at))) - 1 for at in (0, 8)] for n in range(SHORT + 1)], np.uint64)
#: The tokenizers file's own rule for words, digits and the rest, for lower-case Latin-1.
_PARTS = re.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[a-zªµºß-öø-ÿ]+|[0-9²³¹¼½¾]|[^\t-\r \x85\xa0a-zªµºß-öø-ÿ0-9²³¹¼½¾]+")


class _Memory(dict):
    """A dict that forgets what has not been asked for during its last ``size`` new keys."""

    def __init__(self, size: int):
        self.size, self.old = size, {}

    def unknown(self, keys: set) -> list:
        """Those of ``keys``, which it lacks, that it hasn't just forgotten."""
        if len(self) + len(keys) > self.size:
            self.old = dict(self)
            self.clear()
        again = keys & self.old.keys()
        for k in again:
            self[k] = self.old[k]
        return list(keys - again)


class _Table:
    """Entries, each a run of ids, by pieces of up to SHORT bytes held as two numbers; all pieces of a batch are looked up at once."""

    def __init__(self, size: int, kind: np.dtype):
        self.size, self.kind = size, kind
        self.bits = (2 * size - 1).bit_length() + 1
        self.clear()

    def clear(self) -> None:
        self.slots = np.full(1 << self.bits, -1, np.int32)
        self.keys, self.n = np.zeros((1024, 2), np.uint64), 0
        self.first, self.length, self.used = np.zeros(1024, np.int64), np.zeros(1024, np.int64), np.zeros(1024, bool)
        self.ids, self.n_ids = np.zeros(4096, self.kind), 0

    def _slot(self, keys: np.ndarray) -> np.ndarray:
        mixed = (keys[:, 0] ^ (keys[:, 1] * np.uint64(0x9E3779B97F4A7C15))) * np.uint64(0xBF58476D1CE4E5B9)
        return ((mixed ^ (mixed >> np.uint64(31))) * np.uint64(0x94D049BB133111EB) >> np.uint64(64 - self.bits)).astype(np.int64)

    def find(self, keys: np.ndarray) -> np.ndarray:
        """Each key's entry, -1 where there is none."""
        out, left, slot = np.full(len(keys), -1, np.int64), np.arange(len(keys)), self._slot(keys)
        while len(left):
            entry = self.slots[slot]
            here = entry >= 0
            same = here & (self.keys[entry, 0] == keys[left, 0]) & (self.keys[entry, 1] == keys[left, 1])
            out[left[same]] = entry[same]
            on = here & ~same
            left, slot = left[on], (slot[on] + 1) & ((1 << self.bits) - 1)
        self.used[out[out >= 0]] = True
        return out

    def add(self, keys: np.ndarray | None, runs: list[bytes]) -> np.ndarray:
        """New entries with these ids; without keys they can't be found, but used in this batch."""
        lengths = np.array([len(r) // self.kind.itemsize for r in runs], np.int64)
        n, total = self.n + len(runs), self.n_ids + int(lengths.sum())
        while n > len(self.first):
            self.keys, self.first, self.length, self.used = (np.concatenate([x, np.zeros_like(x)]) for x in (self.keys, self.first, self.length, self.used))
        while total > len(self.ids):
            self.ids = np.concatenate([self.ids, np.zeros_like(self.ids)])
        made = np.arange(self.n, n)
        self.ids[self.n_ids : total] = np.frombuffer(b"".join(runs), self.kind)
        self.first[made], self.length[made], self.used[made] = self.n_ids + np.cumsum(lengths) - lengths, lengths, False
        self.n, self.n_ids = n, total
        if keys is not None:
            self.keys[made] = keys
            for entry, slot in zip(made.tolist(), self._slot(keys).tolist(), strict=True):
                while self.slots[slot] >= 0:
                    slot = (slot + 1) & ((1 << self.bits) - 1)
                self.slots[slot] = entry
        return made

    def forget(self, more: int) -> bool:
        """Make room for ``more`` entries, if need be, by keeping just those found again since the last time; whether it had to."""
        if self.n + more <= self.size:
            return False
        kept = np.flatnonzero(self.used[: self.n] & (self.keys[: self.n] != 0).any(axis=1))
        kept = kept if len(kept) + more <= self.size else kept[:0]
        keys, width = self.keys[kept], self.kind.itemsize
        raw = self.ids.tobytes()
        runs = [raw[a * width : (a + n) * width] for a, n in zip(self.first[kept].tolist(), self.length[kept].tolist(), strict=True)]
        self.clear()
        self.add(keys, runs)
        return True


class Encoder:
    """A tokenizers file whose pre-tokenizer never joins what white space parts, and which lower-cases.

    Then a text's ids are those of its pieces between spaces, one after the
    other; pieces come again and again, and each is encoded once and
    remembered.  Texts in Latin-1 are looked up by numpy, a batch at a time,
    and their new pieces are parted by the file's own rule, as words come
    again more often than pieces do.  All ids are made by the tokenizers library.
    """

    def __init__(self, path: str, remembered: int = REMEMBERED):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.kind = np.dtype("<u2" if self.tokenizer.get_vocab_size() <= 1 << 16 else "<u4")
        self.table = _Table(remembered, self.kind)
        self.long, self.parts, self.other = (_Memory(remembered // 3) for _ in range(3))
        vocabulary = self.tokenizer.get_vocab()
        self.ends = np.zeros(max(vocabulary.values()) + 1, bool)
        self.ends[[i for word, i in vocabulary.items() if word.endswith("</w>")]] = True

    def _encode(self, texts: list[str]) -> list[np.ndarray]:
        return [np.array(x.ids, self.kind) for x in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def _made(self, pieces: list[bytes]) -> list[bytes]:
        """The ids of new lower-case Latin-1 pieces."""
        found = [_PARTS.findall(p.decode("latin-1")) for p in pieces]
        new = self.parts.unknown({p for x in found for p in x if p not in self.parts})
        ids = self._encode([" ".join(new)])[0]
        cuts = np.flatnonzero(self.ends[ids]) + 1
        if len(cuts) != len(new) or (len(cuts) and cuts[-1] != len(ids)):
            raise ValueError("the tokenizers file parts words in another way")
        raw, cuts = ids.tobytes(), (np.concatenate([[0], cuts]) * self.kind.itemsize).tolist()
        for part, a, b in zip(new, cuts[:-1], cuts[1:], strict=True):
            self.parts[part] = raw[a:b]
        parts = self.parts.old | self.parts if self.parts.old else self.parts
        return [b"".join([parts[p] for p in x]) for x in found]

    def _plain(self, texts: list[bytes]) -> list[np.ndarray]:
        """The ids of lower-case Latin-1 texts."""
        raw = b" ".join([b"", *texts, b" " * SHORT])
        data = np.frombuffer(raw, np.uint8)
        space = _SPACE[data]
        starts, ends = np.flatnonzero(space[:-1] & ~space[1:]) + 1, np.flatnonzero(~space[:-1] & space[1:]) + 1
        lengths = ends - starts
        short = np.flatnonzero(lengths <= SHORT)
        keys = np.ndarray((len(data) - SHORT + 1, 2), "<u8", data, strides=(1, 8))[starts[short]] & _FIRST[lengths[short]]
        entries = np.full(len(starts), -1, np.int64)
        entries[short] = self.table.find(keys)
        if self.table.forget(int((entries < 0).sum())):
            entries[short] = self.table.find(keys)
        lacking = entries[short] < 0
        if lacking.any():
            new, of = np.unique(keys[lacking].view("V16").ravel(), return_inverse=True)
            made = self.table.add(new.view(np.uint64).reshape(-1, 2), self._made([bytes(x).rstrip(b"\0") for x in new]))
            entries[short[lacking]] = made[of]
        rest = np.flatnonzero(lengths > SHORT)
        if len(rest):
            pieces = [raw[a:b] for a, b in zip(starts[rest].tolist(), ends[rest].tolist(), strict=True)]
            new = self.long.unknown({p for p in pieces if p not in self.long})
            self.long.update(zip(new, self._made(new), strict=True))
            known = self.long.old | self.long if self.long.old else self.long
            distinct = list(dict.fromkeys(pieces))
            entry = dict(zip(distinct, self.table.add(None, [known[p] for p in distinct]).tolist(), strict=True))
            entries[rest] = [entry[p] for p in pieces]
        sizes = self.table.length[entries]
        upto = np.concatenate([[0], np.cumsum(sizes)])
        ids = self.table.ids[np.repeat(self.table.first[entries] - upto[:-1], sizes) + np.arange(upto[-1])]
        bounds = np.cumsum([1, *(len(t) + 1 for t in texts)])
        cuts = upto[np.searchsorted(starts, bounds)].tolist()
        return [ids[a:b] for a, b in zip(cuts[:-1], cuts[1:], strict=True)]

    def _others(self, texts: list[str]) -> list[np.ndarray]:
        """The ids of any other texts."""
        pieces = [t.replace("\n", " ").replace("\t", " ").replace("\r", " ").split(" ") for t in texts]
        new = self.other.unknown({p for x in pieces for p in x if p not in self.other})
        self.other.update((p, ids.tobytes()) for p, ids in zip(new, self._encode(new), strict=True))
        known = self.other.old | self.other if self.other.old else self.other
        return [np.frombuffer(b"".join([known[p] for p in x]), self.kind) for x in pieces]

    def __call__(self, texts: list[str], end: int | None = None) -> list[np.ndarray]:
        """The ids of each text, with ``end`` after them."""
        plain = [_latin1(t) for t in texts]
        of_plain = iter(self._plain([p for p in plain if p is not None]))
        of_other = iter(self._others([t for t, p in zip(texts, plain, strict=True) if p is None]))
        found = [next(of_other if p is None else of_plain) for p in plain]
        return found if end is None else [np.append(x, np.array([end], self.kind)) for x in found]


def _latin1(text: str) -> bytes | None:
    """The text in lower case as Latin-1, if it is that and has no special token or zero byte."""
    if "<|" in text or "\0" in text:
        return None
    try:
        return text.lower().encode("latin-1")
    except UnicodeEncodeError:
        return None


def encoder(path: str) -> Encoder:
    return kept(path, lambda: Encoder(path))


@dataclass(frozen=True)
class Written:
    folder: str

    def index(self, spark: SparkSession) -> DataFrame:
        """doc_id, file, file_no (in key order), row_no (in its task), offset, bytes, first_token (in its file), n_tokens."""
        return spark.read.schema(records.INDEX).parquet(f"{self.folder}/index")


def write_tokens(docs: DataFrame, tokenizer: str, end: int | None = 2, key: str = "doc_id", text: str = "text", folder: str | None = None) -> Written:
    """Encode every row's text and write records in ascending order of ``key``, nulls first.

    ``tokenizer`` is a tokenizers file that all executors have, ``end`` an id
    put after each document.  A null text is empty.  Rows of one key are put
    in order of their texts' hashes; equal rows are told apart by their place
    in the input, so that a key of very many rows still goes to many files.
    Keys are whole numbers.
    """
    spark = docs.sparkSession
    folder = folder or new_dir(spark, "tokens")
    rows = merged(docs).select(F.col(key).cast("long").alias("key"), F.coalesce(F.col(text), F.lit("")).alias("text")).withColumn("tie", F.xxhash64("text")).withColumn("place", F.monotonically_increasing_id())
    order = [F.asc_nulls_first("key"), F.asc("tie"), F.asc("place")]
    rows = rows.repartitionByRange(*order).sortWithinPartitions(*order).select("key", "text")
    place = f"{folder}/records"

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        encode, out = encoder(tokenizer), records.Writer(place, TaskContext.get().partitionId())
        keys, texts, size = [], [], 0
        for batch in batches:
            for key, text in zip(batch.column(0), batch.column(1), strict=True):
                keys.append(key.as_py())
                texts.append(text.as_py())
                size += len(texts[-1])
                if size >= TOGETHER:
                    yield out.write(keys, encode(texts, end))
                    keys, texts, size = [], [], 0
        if keys:
            yield out.write(keys, encode(texts, end))
        out.close()

    rows.mapInArrow(write, records.INDEX).write.parquet(f"{folder}/index", compression="zstd")
    return Written(folder)


def read_tokens(spark: SparkSession, written: Written, ids: bool = False) -> DataFrame:
    """Per record, read from the files by way of the index: doc_id, start, n_tokens, ids_crc32, and its ids if asked for.

    ``start`` counts the ids of all records before it.  ``ids_crc32`` is over
    the ids as little-endian uint32.  Lengths and checksums are verified.
    Only the files' sums are added up in one task: a row for each file.
    """
    index = written.index(spark)
    sums = index.groupBy("file_no").agg(F.sum("n_tokens").alias("n"))
    before = Window.orderBy("file_no").rowsBetween(Window.unboundedPreceding, -1)
    base = sums.select("file_no", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base"))
    place, more = f"{written.folder}/records", ", ids array<long>" if ids else ""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys, counts, sums, every = [], [], [], []
            for found in records.read_at(place, batch):
                for key, tokens in found:
                    keys.append(key)
                    counts.append(len(tokens))
                    sums.append(zlib.crc32(tokens.astype("<u4").tobytes()))
                    if ids:
                        every.append(tokens.astype(np.int64))
            columns = [pa.array(keys, pa.int64()), batch.column("file_no"), batch.column("first_token"), pa.array(counts, pa.int64()), pa.array(sums, pa.int64())]
            names = ["doc_id", "file_no", "first_token", "n_tokens", "ids_crc32"]
            yield pa.RecordBatch.from_arrays([*columns, *([pa.array(every, pa.list_(pa.int64()))] if ids else [])], names=[*names, *(["ids"] if ids else [])])

    found = index.select("file", "file_no", "offset", "bytes", "first_token").mapInArrow(read, f"doc_id long, file_no long, first_token long, n_tokens long, ids_crc32 long{more}")
    out = found.join(broadcast_if_small(base, 32), "file_no")
    return out.select("doc_id", (F.col("base") + F.col("first_token")).alias("start"), "n_tokens", "ids_crc32", *(["ids"] if ids else []))
