"""Matroska media columns: a muxer for sample data and a parser into packet tables.

A file is a tree of EBML elements: an id and a size, both of variable length,
then the data.  Clusters hold blocks; a block holds one packet, or several by
lacing (Xiph, fixed-size or EBML).  Cues say where clusters start.  ``packets``
walks this tree and gives each packet's track, timestamp and byte range, so
that a reader fetches just the ranges it needs.
"""

from __future__ import annotations

import struct
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Element ids of the Matroska specification.
EBML, EBML_VERSION, EBML_READ_VERSION, EBML_MAX_ID, EBML_MAX_SIZE = 0x1A45DFA3, 0x4286, 0x42F7, 0x42F2, 0x42F3
DOC_TYPE, DOC_TYPE_VERSION, DOC_TYPE_READ_VERSION = 0x4282, 0x4287, 0x4285
SEGMENT, INFO, TIMESTAMP_SCALE, DURATION, MUXING_APP, WRITING_APP = 0x18538067, 0x1549A966, 0x2AD7B1, 0x4489, 0x4D80, 0x5741
TRACKS, TRACK_ENTRY, TRACK_NUMBER, TRACK_UID, TRACK_TYPE, CODEC_ID, FLAG_LACING = 0x1654AE6B, 0xAE, 0xD7, 0x73C5, 0x83, 0x86, 0x9C
AUDIO, SAMPLING_FREQUENCY, CHANNELS, BIT_DEPTH = 0xE1, 0xB5, 0x9F, 0x6264
CLUSTER, TIMESTAMP, SIMPLE_BLOCK, BLOCK_GROUP, BLOCK, REFERENCE_BLOCK = 0x1F43B675, 0xE7, 0xA3, 0xA0, 0xA1, 0xFB
CUES, CUE_POINT, CUE_TIME, CUE_TRACK_POSITIONS, CUE_TRACK, CUE_CLUSTER_POSITION = 0x1C53BB6B, 0xBB, 0xB3, 0xB7, 0xF7, 0xF1
#: Elements that hold elements.
MASTERS = {SEGMENT, INFO, TRACKS, TRACK_ENTRY, AUDIO, CLUSTER, BLOCK_GROUP, CUES, CUE_POINT, CUE_TRACK_POSITIONS}
#: What may follow a cluster or segment of unknown size in its parent, and so ends it.
TOP = {SEGMENT, EBML}
LEVEL_1 = {INFO, TRACKS, CLUSTER, CUES, 0x114D9B74, 0x1043A770, 0x1254C367, 0x1941A469}

#: Samples of a packet, packets of a laced block, blocks of a cluster; the rate is one sample in 125 microseconds.
PACKET, LACED, BLOCKS, RATE = 512, 8, 8, 8000
NO_LACING, XIPH, FIXED, EBML_LACING = 0, 1, 2, 3


def vint(n: int, width: int = 0) -> bytes:
    """``n`` as a variable-length size of ``width`` bytes, or as few as will do."""
    width = width or next(w for w in range(1, 9) if n < (1 << 7 * w) - 1)
    return (n | 1 << 7 * width).to_bytes(width, "big")


def element(kind: int, data: bytes) -> bytes:
    return kind.to_bytes((kind.bit_length() + 7) // 8, "big") + vint(len(data)) + data


def unsigned(kind: int, n: int) -> bytes:
    return element(kind, n.to_bytes(max(1, (n.bit_length() + 7) // 8), "big"))


def lace(packets: list[bytes], kind: int) -> bytes:
    """The packets of a block, after its head, for a kind of lacing."""
    if kind == NO_LACING:
        return packets[0]
    sizes = [len(p) for p in packets]
    if kind == XIPH:
        head = b"".join(b"\xff" * (n // 255) + bytes([n % 255]) for n in sizes[:-1])
    elif kind == EBML_LACING:
        head = vint(sizes[0])
        for a, b in zip(sizes, sizes[1:-1], strict=False):
            width = next(w for w in range(1, 9) if abs(b - a) < (1 << 7 * w - 1) - 1)
            head += vint(b - a + (1 << 7 * width - 1) - 1, width)
    else:
        head = b""
    return bytes([len(packets) - 1]) + head + b"".join(packets)


def mux(payload: bytes) -> bytes:
    """A Matroska file with ``payload`` as the 8-bit samples of one PCM track, cut into laced blocks, clusters and cues."""
    ms = lambda sample: sample * 1000 // RATE
    head = element(EBML, unsigned(EBML_VERSION, 1) + unsigned(EBML_READ_VERSION, 1) + unsigned(EBML_MAX_ID, 4) + unsigned(EBML_MAX_SIZE, 8) + element(DOC_TYPE, b"matroska") + unsigned(DOC_TYPE_VERSION, 4) + unsigned(DOC_TYPE_READ_VERSION, 2))
    info = element(INFO, unsigned(TIMESTAMP_SCALE, 1_000_000) + element(DURATION, struct.pack(">d", len(payload) * 1000 / RATE)) + element(MUXING_APP, b"gapline") + element(WRITING_APP, b"gapline"))
    audio = element(AUDIO, element(SAMPLING_FREQUENCY, struct.pack(">d", RATE)) + unsigned(CHANNELS, 1) + unsigned(BIT_DEPTH, 8))
    tracks = element(TRACKS, element(TRACK_ENTRY, unsigned(TRACK_NUMBER, 1) + unsigned(TRACK_UID, 1) + unsigned(TRACK_TYPE, 2) + unsigned(FLAG_LACING, 1) + element(CODEC_ID, b"A_PCM/INT/LIT") + audio))
    parts, size, cues = [info, tracks], len(info) + len(tracks), []
    for at in range(0, len(payload), PACKET * LACED * BLOCKS):
        inside = [unsigned(TIMESTAMP, ms(at))]
        for begin in range(at, min(len(payload), at + PACKET * LACED * BLOCKS), PACKET * LACED):
            packets = [payload[i : i + PACKET] for i in range(begin, min(len(payload), begin + PACKET * LACED), PACKET)]
            kind = NO_LACING if len(packets) == 1 else FIXED if len(packets[-1]) == PACKET else EBML_LACING
            inside.append(element(SIMPLE_BLOCK, vint(1) + struct.pack(">hB", ms(begin) - ms(at), 0x80 | kind << 1) + lace(packets, kind)))
        cues.append(element(CUE_POINT, unsigned(CUE_TIME, ms(at)) + element(CUE_TRACK_POSITIONS, unsigned(CUE_TRACK, 1) + unsigned(CUE_CLUSTER_POSITION, size))))
        parts.append(element(CLUSTER, b"".join(inside)))
        size += len(parts[-1])
    return head + element(SEGMENT, b"".join(parts) + element(CUES, b"".join(cues)))


def _vint_at(data: bytes, at: int, keep: bool = False) -> tuple[int, int]:
    """The number at ``at`` (None if its bits are all ones: unknown), with its marker if ``keep``, and where it ends."""
    first = data[at]
    width = 9 - first.bit_length()
    if width > 8 or at + width > len(data):
        raise ValueError("a variable-length number is cut off")
    n = int.from_bytes(data[at : at + width], "big")
    if keep:
        return n, at + width
    n ^= 1 << 7 * width
    return (None if n == (1 << 7 * width) - 1 else n), at + width


def elements(data: bytes, at: int = 0, end: int | None = None) -> Iterator[tuple[int, int, int, int]]:
    """(id, where it starts, where its data start, where they end) of all elements, masters before what they hold.

    An element of unknown size ends where one begins that cannot be in it.
    Data cut off at the end of the file are given as far as they go.
    """
    end = len(data) if end is None else end
    open_until: list[tuple[int, int | None]] = []
    while at < end:
        start = at
        kind, at = _vint_at(data, at, keep=True)
        size, at = _vint_at(data, at)
        while open_until and ((open_until[-1][1] is not None and start >= open_until[-1][1]) or (open_until[-1][1] is None and (kind in TOP or open_until[-1][0] == CLUSTER and kind in LEVEL_1))):
            open_until.pop()
        until = next((e for _, e in reversed(open_until) if e is not None), end) if size is None else min(end, at + size)
        yield kind, start, at, until
        if kind in MASTERS:
            open_until.append((kind, None if size is None else until))
        else:
            at = until


def unlace(data: bytes, at: int, end: int) -> tuple[int, int, int, list[tuple[int, int]]]:
    """Track, relative timestamp, flags and byte ranges of the packets of the block in ``data[at:end]``."""
    track, at = _vint_at(data, at)
    moment, flags = struct.unpack_from(">hB", data, at)
    at += 3
    kind = flags >> 1 & 3
    if kind == NO_LACING:
        return track, moment, flags, [(at, end)]
    n = data[at] + 1
    at += 1
    sizes: list[int] = []
    if kind == XIPH:
        for _ in range(n - 1):
            size = 0
            while data[at] == 255:
                size, at = size + 255, at + 1
            sizes.append(size + data[at])
            at += 1
    elif kind == EBML_LACING:
        if n > 1:
            size, at = _vint_at(data, at)
            sizes.append(size)
        for _ in range(n - 2):
            begin = at
            more, at = _vint_at(data, at)
            width = at - begin
            sizes.append(sizes[-1] + (more if more is not None else (1 << 7 * width) - 1) - (1 << 7 * width - 1) + 1)
    else:
        sizes = [(end - at) // n] * (n - 1)
    if sum(sizes) > end - at or any(s < 0 for s in sizes):
        raise ValueError("laced packets are larger than their block")
    starts = np.cumsum([at, *sizes]).tolist()
    return track, moment, flags, list(zip(starts, [*starts[1:], end], strict=True))


@dataclass
class Media:
    """What a file holds: tracks by number, packets (track, timestamp in ns, start, end, keyframe, cluster), cues (ns, track, cluster's place)."""

    tracks: dict[int, dict] = field(default_factory=dict)
    packets: list[tuple[int, int, int, int, bool, int]] = field(default_factory=list)
    cues: list[tuple[int, int, int]] = field(default_factory=list)
    clusters: list[int] = field(default_factory=list)
    blocks: int = 0
    duration: float = 0.0


def demux(data: bytes) -> Media:
    """Parse a file.  Packets of a laced block follow each other by the track's duration of a packet, where samples tell it."""
    out, scale, base, segment, track, cue, keyframe = Media(), 1_000_000, 0, 0, {}, [0, 0, 0], True
    number = lambda a, b: int.from_bytes(data[a:b], "big")
    real = lambda a, b: struct.unpack(">d" if b - a == 8 else ">f", data[a:b])[0] if b > a else 0.0
    for kind, start, a, b in elements(data):
        if kind == SIMPLE_BLOCK or kind == BLOCK:
            tr, moment, flags, ranges = unlace(data, a, b)
            known = out.tracks.get(tr, {})
            step = 8e9 / known["bits"] / known["channels"] / known["rate"] if known.get("rate") and known.get("bits") and known.get("channels") else 0.0
            first = ranges[0][0]
            key = bool(flags & 0x80) if kind == SIMPLE_BLOCK else keyframe
            cluster = len(out.clusters) - 1
            out.packets += [(tr, (base + moment) * scale + int((x - first) * step), x, y, key, cluster) for x, y in ranges]
            out.blocks += 1
        elif kind == SEGMENT:
            segment = a
        elif kind == CLUSTER:
            out.clusters.append(start - segment)
            base = 0
        elif kind == BLOCK_GROUP:
            keyframe = not any(k == REFERENCE_BLOCK for k, *_ in elements(data, a, b))
        elif kind == TIMESTAMP:
            base = number(a, b)
        elif kind == TIMESTAMP_SCALE:
            scale = number(a, b)
        elif kind == DURATION:
            out.duration = real(a, b)
        elif kind == TRACK_ENTRY:
            track = {"rate": 0.0, "channels": 1, "bits": 0}
        elif kind == TRACK_NUMBER:
            out.tracks[number(a, b)] = track
        elif kind == TRACK_TYPE:
            track["type"] = number(a, b)
        elif kind == CODEC_ID:
            track["codec"] = data[a:b].decode("ascii", "replace").rstrip("\0")
        elif kind == SAMPLING_FREQUENCY:
            track["rate"] = real(a, b)
        elif kind == CHANNELS:
            track["channels"] = number(a, b)
        elif kind == BIT_DEPTH:
            track["bits"] = number(a, b)
        elif kind == CUE_POINT:
            cue = [0, 0, 0]
        elif kind == CUE_TIME:
            cue[0] = number(a, b) * scale
        elif kind == CUE_TRACK:
            cue[1] = number(a, b)
        elif kind == CUE_CLUSTER_POSITION:
            cue[2] = number(a, b)
            out.cues.append(tuple(cue))
    return out


def parsed(data: bytes) -> tuple[Media, str | None]:
    """What ``demux`` finds, or nothing and what is wrong with a broken file."""
    try:
        media = demux(data)
        if any(abs(when) >= 1 << 63 or track >= 1 << 63 for track, when, *_ in media.packets):
            raise ValueError("a time or track is beyond 64 bits")
        return media, None
    except (ValueError, IndexError, TypeError, OverflowError, struct.error) as error:
        return Media(), f"{type(error).__name__}: {error}"


def samples(data: bytes, media: Media, track: int = 1) -> bytes:
    """The packets of a track, put together."""
    return b"".join([data[a:b] for t, _, a, b, *_ in media.packets if t == track])


def feature(media: Media, payload: bytes) -> str:
    """Counts of the file's parts, its span, and the level and zero crossings of its samples around 128."""
    level = np.frombuffer(payload, np.uint8).astype(np.int16) - 128
    clusters = set(media.clusters)
    cued = sum(place in clusters for _, _, place in media.cues)
    last = max((t for _, t, *_ in media.packets), default=0)
    crossings = int(np.count_nonzero((level[1:] < 0) != (level[:-1] < 0)))
    mean = int(np.abs(level).sum(dtype=np.int64)) * 1000 // max(1, len(level))
    return f"tracks={len(media.tracks)};clusters={len(media.clusters)};blocks={media.blocks};packets={len(media.packets)};cues={cued};last_us={last // 1000};level={mean};crossings={crossings}"


#: Bytes of texts or files worked on at once in a task; a longer one is taken alone.
TOGETHER = 8 << 20


def _slices(sizes: list[int]) -> Iterator[tuple[int, int]]:
    """Runs of rows of at most about TOGETHER bytes: first row, number of rows."""
    first, size = 0, 0
    for i, n in enumerate(sizes):
        if size and size + n > TOGETHER:
            yield first, i - first
            first, size = i, 0
        size += n
    if first < len(sizes):
        yield first, len(sizes) - first


def store_media(docs: DataFrame, key: str = "doc_id", text: str = "text", unit: int = 64) -> DataFrame:
    """Per row of ``docs``: key, n_bytes long, media binary: the text's UTF-8, filled up with bytes 0 to a positive multiple of ``unit``, as a Matroska file.

    A null text is empty; repeated rows have files of their own.  Rows stay
    where they are, and few megabytes of them are held at once; one file has
    to fit one row.
    """
    kind = docs.schema[key].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes = pc.binary_length(batch.column(1)).fill_null(0).to_pylist()
            for first, n in _slices(sizes):
                raw = [b"" if t is None else t.encode() for t in batch.column(1).slice(first, n).to_pylist()]
                files = [mux(b + bytes(-len(b) % unit if b else unit)) for b in raw]
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(first, n), pa.array(map(len, raw), pa.int64()), pa.array(files, pa.binary())], names=[key, "n_bytes", "media"])

    return docs.select(key, text).mapInArrow(run, f"`{key}` {kind}, n_bytes long, media binary")


def packets(media: DataFrame, key: str = "doc_id", column: str = "media") -> DataFrame:
    """The packet table of a media column: key, n, track, timestamp_ns, start, end, keyframe, cluster, error; byte ranges from 0, end open.

    A null file has no packets; a broken one has a row with nothing but what is
    wrong with it.
    """
    names = ["track", "timestamp_ns", "start", "end", "keyframe", "cluster"]
    types = [pa.int64()] * 4 + [pa.bool_(), pa.int64()]
    kind = media.schema[key].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes = pc.binary_length(batch.column(1)).fill_null(0).to_pylist()
            for first, n in _slices(sizes):
                read = [parsed(f) if f is not None else (Media(), None) for f in batch.column(1).slice(first, n).to_pylist()]
                found = [media.packets if error is None else [(None,) * len(names)] for media, error in read]
                rows = [p for x in found for p in x]
                errors = pa.array([error for x, (_, error) in zip(found, read, strict=True) for _ in x], pa.string())
                keys = batch.column(0).slice(first, n).take(pa.array([i for i, x in enumerate(found) for _ in x], pa.int64()))
                numbers = pa.array([None if error else i for x, (_, error) in zip(found, read, strict=True) for i in range(len(x))], pa.int32())
                columns = list(zip(*rows, strict=True)) if rows else [()] * len(names)
                yield pa.RecordBatch.from_arrays([keys, numbers, *(pa.array(c, t) for c, t in zip(columns, types, strict=True)), errors], names=[key, "n", *names, "error"])

    return media.select(key, column).mapInArrow(run, f"`{key}` {kind}, n int, track long, timestamp_ns long, start long, end long, keyframe boolean, cluster long, error string")


def media_digest(media: DataFrame, key: str = "doc_id", column: str = "media", keep: tuple[str, ...] = ("n_bytes",)) -> DataFrame:
    """Per row of a media table: key, the columns ``keep``, payload_bytes, payload_sha256, tail_crc32 (of the last 64 bytes), media_bytes, media_sha256, feature, all from the stored bytes, and error; null where there is no file, and but for the stored form's own columns where it is broken."""
    import hashlib
    import zlib

    def one(data: bytes | None) -> tuple:
        if data is None:
            return (None,) * 7
        stored, (found, error) = (len(data), hashlib.sha256(data).hexdigest()), parsed(data)
        if error is not None:
            return None, None, None, *stored, None, error
        payload = samples(data, found)
        return len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-64:]), *stored, feature(found, payload), None

    names = ["payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature", "error"]
    types = [pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string()]
    kept = [key, *keep]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            files = batch.column(len(kept))
            sizes = pc.binary_length(files).fill_null(0).to_pylist()
            for first, n in _slices(sizes):
                columns = list(zip(*map(one, files.slice(first, n).to_pylist()), strict=True))
                yield pa.RecordBatch.from_arrays([*(c.slice(first, n) for c in batch.columns[:-1]), *(pa.array(c, t) for c, t in zip(columns, types, strict=True))], names=[*kept, *names])

    schema = ", ".join(f"`{c}` {media.schema[c].dataType.simpleString()}" for c in kept)
    return media.select(*kept, column).mapInArrow(run, f"{schema}, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string, error string")
