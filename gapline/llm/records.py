"""Length-delimited binary records with masked checksums, and their offset index.

A record is framed as little-endian uint64 length, masked CRC-32C of these
eight bytes, the body, masked CRC-32C of the body: the framing of TFRecord
files, which its readers understand.  The body is an int64 key, a flags byte
(1: the key is null), a byte that says how many bytes an id takes, and the ids.
A file holds at most about FILE_BYTES.  The index, a Parquet table beside the
files, has a row for each record, so that any order can be read.
"""

from __future__ import annotations

import struct
import uuid
from collections.abc import Iterator
from functools import cache, lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.fs as pafs

MASK_DELTA = 0xA282EAD8
POLYNOMIAL = 0x82F63B78
FILE_BYTES = 64 << 20
#: Bytes of a block whose checksums are computed side by side.
BLOCK = 256
_BODY = struct.Struct("<qBB")
INDEX = "doc_id long, file string, file_no long, row_no long, offset long, bytes long, first_token long, n_tokens long"


@cache
def _tables() -> np.ndarray:
    """The checksum of a byte that is followed by 0 to 3 zero bytes."""
    table = np.zeros((4, 256), np.uint32)
    crc = np.arange(256, dtype=np.uint32)
    for _ in range(8):
        crc = np.where(crc & 1, (crc >> 1) ^ np.uint32(POLYNOMIAL), crc >> 1)
    table[0] = crc
    for k in range(1, 4):
        table[k] = (table[k - 1] >> 8) ^ table[0][table[k - 1] & 255]
    return table


def _step(crc: np.ndarray) -> np.ndarray:
    """Four zero bytes on."""
    t = _tables()
    return t[3][crc & 255] ^ t[2][(crc >> 8) & 255] ^ t[1][(crc >> 16) & 255] ^ t[0][crc >> 24]


@cache
def _block_on() -> np.ndarray:
    """Tables that take a checksum BLOCK zero bytes on, by each of its bytes."""
    at = np.arange(256, dtype=np.uint32)[None, :] << (8 * np.arange(4, dtype=np.uint32))[:, None]
    for _ in range(BLOCK // 4):
        at = _step(at)
    return at


def crc32c(bodies: list[bytes]) -> np.ndarray:
    """CRC-32C of each of ``bodies``, which have at least 4 bytes.

    Blocks of all bodies are summed side by side.  Bodies are filled up with
    zeros in front, which change nothing, as the sum starts at zero; its
    customary start, all ones, is the first four bytes inverted.
    """
    if not bodies:
        return np.empty(0, np.uint32)
    sizes = np.array([len(b) for b in bodies])
    blocks = -(-sizes // BLOCK)
    ends = np.cumsum(blocks) * BLOCK
    data = np.zeros(int(ends[-1]), np.uint8)
    for body, start, end in zip(bodies, (ends - sizes).tolist(), ends.tolist(), strict=True):
        data[start:end] = np.frombuffer(body, np.uint8)
    first = (ends - sizes)[:, None] + np.arange(4)
    data[first] ^= 0xFF
    words = data.view("<u4").reshape(-1, BLOCK // 4)
    part = np.zeros(len(words), np.uint32)
    for k in range(BLOCK // 4):
        part = _step(part ^ words[:, k])
    on, crc, begin = _block_on(), np.zeros(len(bodies), np.uint32), np.cumsum(blocks) - blocks
    order = np.argsort(-blocks, kind="stable")
    going = np.searchsorted(-blocks[order], -np.arange(blocks.max()))
    for k, n in enumerate(going):
        rows = order[:n]
        x = crc[rows]
        crc[rows] = on[0][x & 255] ^ on[1][(x >> 8) & 255] ^ on[2][(x >> 16) & 255] ^ on[3][x >> 24] ^ part[begin[rows] + k]
    return ~crc


def masked(crc: np.ndarray) -> np.ndarray:
    return ((crc >> 15) | (crc << 17)) + np.uint32(MASK_DELTA)


def frames(bodies: list[bytes]) -> list[bytes]:
    """Each body in its frame."""
    lengths = [struct.pack("<Q", len(b)) for b in bodies]
    of_length, of_body = (masked(crc32c(x)).astype("<u4").tobytes() for x in (lengths, bodies))
    return [n + of_length[4 * i : 4 * i + 4] + b + of_body[4 * i : 4 * i + 4] for i, (n, b) in enumerate(zip(lengths, bodies, strict=True))]


def bodies_of(framed: list[bytes]) -> list[bytes]:
    """The bodies of whole frames; a wrong length or checksum is an error."""
    lengths, bodies = [f[:8] for f in framed], [f[12:-4] for f in framed]
    for f, n, b in zip(framed, lengths, bodies, strict=True):
        if len(f) < 16 or struct.unpack("<Q", n)[0] != len(b):
            raise ValueError("a record's length is wrong")
    for parts, at in ((lengths, slice(8, 12)), (bodies, slice(-4, None))):
        want = np.array([int.from_bytes(f[at], "little") for f in framed], np.uint32)
        if (masked(crc32c(parts)) != want).any():
            raise ValueError("a record's checksum is wrong")
    return bodies


def body(key: int | None, ids: np.ndarray) -> bytes:
    """``ids`` is uint16 or uint32."""
    return _BODY.pack(0 if key is None else key, key is None, ids.dtype.itemsize) + ids.tobytes()


def parse(raw: bytes) -> tuple[int | None, np.ndarray]:
    key, null, width = _BODY.unpack_from(raw)
    return None if null else key, np.frombuffer(raw, f"<u{width}", offset=_BODY.size)


@lru_cache(maxsize=8)
def filesystem(uri: str) -> tuple[pafs.FileSystem, str]:
    """The file system of a folder's URI, and the path in it."""
    return pafs.FileSystem.from_uri(uri)


class Writer:
    """Writes records to files named for the task and this attempt at it, and hands out index rows.

    Index rows name the attempt's own files: whichever attempt Spark commits,
    its rows lead to whole files, and another attempt's are never read.
    """

    def __init__(self, folder: str, task: int):
        self.fs, self.path = filesystem(folder)
        self.fs.create_dir(self.path, recursive=True)
        self.task, self.attempt, self.files, self.rows = task, uuid.uuid4().hex, 0, 0
        self.out, self.offset, self.tokens = None, 0, 0

    def write(self, keys: list[int | None], ids: list[np.ndarray]) -> pa.RecordBatch:
        rows = []
        for key, tokens, frame in zip(keys, ids, frames([body(k, x) for k, x in zip(keys, ids, strict=True)]), strict=True):
            if self.out is None or (self.offset and self.offset + len(frame) > FILE_BYTES):
                self.close()
                self.name = f"part-{self.task:06d}-{self.files:04d}-{self.attempt}.records"
                self.out, self.offset, self.tokens, self.files = self.fs.open_output_stream(f"{self.path}/{self.name}"), 0, 0, self.files + 1
            self.out.write(frame)
            rows.append((key, self.name, (self.task << 32) + self.files - 1, self.rows, self.offset, len(frame), self.tokens, len(tokens)))
            self.offset += len(frame)
            self.tokens += len(tokens)
            self.rows += 1
        columns = list(zip(*rows, strict=True)) if rows else [()] * 8
        kinds = [pa.int64(), pa.string(), *[pa.int64()] * 6]
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=[x.split()[0] for x in INDEX.split(", ")])

    def close(self) -> None:
        if self.out is not None:
            self.out.close()
            self.out = None


def read_at(folder: str, batch: pa.RecordBatch) -> Iterator[list[tuple[int | None, np.ndarray]]]:
    """The records of index rows, a few MB at a time, in the order of the rows."""
    fs, path = filesystem(folder)
    name, file, got, size = None, None, [], 0
    for one, offset, length in zip(batch.column("file").to_pylist(), batch.column("offset").to_pylist(), batch.column("bytes").to_pylist(), strict=True):
        if one != name:
            if file is not None:
                file.close()
            name, file = one, fs.open_input_file(f"{path}/{one}")
        got.append(file.read_at(length, offset))
        size += length
        if size >= 4 << 20:
            yield [parse(b) for b in bodies_of(got)]
            got, size = [], 0
    if file is not None:
        file.close()
    yield [parse(b) for b in bodies_of(got)]


def scan(folder: str, name: str) -> Iterator[tuple[int | None, np.ndarray]]:
    """The records of one file in order, without the index."""
    fs, path = filesystem(folder)
    with fs.open_input_stream(f"{path}/{name}") as file:
        while head := file.read(12):
            if len(head) < 12:
                raise ValueError("a record is cut off")
            length = struct.unpack("<Q", head[:8])[0]
            yield parse(bodies_of([head + file.read(length + 4)])[0])
