"""Arrow strings as numpy arrays of code points and back, a batch at a time."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401


def _flat(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The UTF-8 bytes of an array of strings and the byte offsets of its rows; a null has no bytes."""
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    texts = texts.cast(pa.large_string())
    if not len(texts):
        return np.empty(0, np.uint8), np.zeros(1, np.int64)
    buffers = texts.buffers()
    offsets = np.frombuffer(buffers[1], np.int64)[texts.offset : texts.offset + len(texts) + 1]
    data = np.frombuffer(buffers[2], np.uint8) if buffers[2] else np.empty(0, np.uint8)
    return data[offsets[0] : offsets[-1]], offsets - offsets[0]


def points_of(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """All code points of the rows as one array, and the row of each."""
    data, offsets = _flat(texts)
    cps = np.frombuffer(data.tobytes().decode("utf-8", "replace").encode("utf-32-le", "surrogatepass"), np.int32)
    heads = np.concatenate(([0], np.cumsum((data & 0xC0) != 0x80)))
    per = np.diff(heads[offsets])
    return cps, np.repeat(np.arange(len(per)), per)


def strings_of(cps: np.ndarray, row: np.ndarray, like: pa.Array) -> pa.Array:
    """Strings of the rows' code points; rows of like that are null stay null."""
    data = cps.astype("<i4").tobytes().decode("utf-32-le").encode("utf-8")
    width = 1 + (cps > 0x7F) + (cps > 0x7FF) + (cps > 0xFFFF)
    size = np.bincount(row, weights=width, minlength=len(like)).astype(np.int64) if len(cps) else np.zeros(len(like), np.int64)
    offsets = np.concatenate(([0], np.cumsum(size)))
    out = pa.LargeStringArray.from_buffers(len(like), pa.py_buffer(offsets.astype(np.int64)), pa.py_buffer(data)).cast(pa.string())
    valid = like.is_valid()
    if isinstance(valid, pa.ChunkedArray):
        valid = valid.combine_chunks()
    return pa.compute.if_else(valid, out, pa.scalar(None, pa.string()))


def slices(batch: pa.RecordBatch, column: int, most: int = 4 << 20):
    """Parts of a batch whose texts have so many bytes together at most, and one text at least."""
    sizes = pa.compute.fill_null(pa.compute.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False).astype(np.int64)
    ends, at = np.cumsum(sizes), 0
    while at < batch.num_rows:
        to = max(int(np.searchsorted(ends, (ends[at - 1] if at else 0) + most, "right")), at + 1)
        yield batch.slice(at, to - at)
        at = to
