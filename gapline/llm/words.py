"""ASCII-lower-case words of UTF-8 texts, as bytes."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

#: Letters A-Z to lower case; bytes that are neither a-z, 0-9 nor above 0x7F to a space.
_ALNUM = bytes(c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c > 127 else 32 for c in range(256))
#: Letters A-Z to lower case; the bytes 0x09-0x0D to a space.
_SPACED = bytes(c + 32 if 65 <= c <= 90 else 32 if 9 <= c <= 13 else c for c in range(256))


def alnum_words(text: bytes) -> list[bytes]:
    """The words ``[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+`` of the lower-cased text."""
    return text.translate(_ALNUM).split()


def spaced_words(text: bytes) -> bytes:
    """The words ``[^\\x20\\x09-\\x0D]+`` of the lower-cased text, joined by single spaces."""
    return b" ".join(filter(None, text.translate(_SPACED).split(b" ")))


def utf8(column: pa.Array) -> Iterator[bytes]:
    """The texts of a string column as bytes; null is empty."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    _, ends, data = column.buffers()
    ends = np.frombuffer(ends, np.int64 if wide else np.int32, len(column) + 1, column.offset * (8 if wide else 4))
    view = memoryview(data) if data is not None else memoryview(b"")
    null = column.is_null().to_numpy(zero_copy_only=False) if column.null_count else None
    for i in range(len(column)):
        yield b"" if null is not None and null[i] else bytes(view[ends[i] : ends[i + 1]])
