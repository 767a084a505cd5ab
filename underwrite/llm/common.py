"""Shared pieces: text batches as byte arrays, word and shingle hashes, held-out folds.

Texts arrive in Arrow batches and are handled in slices of about a megabyte, so the arrays of a task
stay small whatever the partition holds; one text is never cut, a slice is then as long as the text.
A NULL text counts as the empty text everywhere.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Bytes of text handled at once.
SLICE_BYTES = 1 << 20

SPACE = np.zeros(256, dtype=bool)
SPACE[[0x20, *range(0x09, 0x0E)]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32


def _mix_int(x: int) -> int:
    mask = (1 << 64) - 1
    x = (x ^ (x >> 33)) * 0xFF51AFD7ED558CCD & mask
    x = (x ^ (x >> 33)) * 0xC4CEB9FE1A85EC53 & mask
    return x ^ (x >> 33)


def keys(seed: int, n: int) -> np.ndarray:
    """``n`` fixed 64-bit keys of a seed."""
    return np.array([_mix_int(seed * 0x9E3779B97F4A7C15 + i + 1 & (1 << 64) - 1) for i in range(n)], dtype=np.uint64)


BYTE_KEYS = keys(11, 256)
BASE = int(keys(12, 1)[0]) | 1
BASE_INVERSE = pow(BASE, -1, 1 << 64)


def mix(x: np.ndarray) -> np.ndarray:
    """Finalizer of a 64-bit hash, element by element."""
    x = x ^ (x >> np.uint64(33))
    x = x * np.uint64(0xFF51AFD7ED558CCD)
    x = x ^ (x >> np.uint64(33))
    x = x * np.uint64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> np.uint64(33))


_powers: dict[str, np.ndarray] = {}


def _power(name: str, base: int, n: int) -> np.ndarray:
    """base**0 .. base**(n-1); the table of a slice is kept, that of a longer text is not."""
    have = _powers.get(name)
    if have is None or len(have) < n:
        out = np.full(max(n, SLICE_BYTES * 2), base, dtype=np.uint64)
        out[0] = 1
        np.multiply.accumulate(out, out=out)
        have = out
        if n <= SLICE_BYTES * 2:
            _powers[name] = have
    return have[:n]


def span_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit hash of data[s:e] for each span; equal bytes have equal hashes wherever they stand."""
    n = len(data)
    sums = np.zeros(n + 1, dtype=np.uint64)
    np.cumsum(BYTE_KEYS[data] * _power("up", BASE, n), out=sums[1:])
    return mix((sums[ends] - sums[starts]) * _power("down", BASE_INVERSE, n + 1)[starts] + (ends - starts).astype(np.uint64))


def text_buffers(column: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes of all texts and the n+1 offsets into them; NULL is empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if not pa.types.is_large_string(column.type):
        column = column.cast(pa.large_string())
    n = len(column)
    _, offsets, data = column.buffers()
    bounds = np.frombuffer(offsets, dtype=np.int64)[column.offset : column.offset + n + 1] if n else np.zeros(1, np.int64)
    raw = np.frombuffer(data, dtype=np.uint8) if data is not None else np.zeros(0, np.uint8)
    raw = raw[bounds[0] : bounds[-1]]
    bounds = bounds - bounds[0]
    if column.null_count:  # a NULL slot may hold bytes
        length = np.diff(bounds) * np.asarray(column.is_valid())
        if length.sum() != len(raw):
            raw, bounds = text_buffers(column.fill_null(""))
    return raw, bounds


def slices(bounds: np.ndarray, limit: int = SLICE_BYTES) -> Iterator[tuple[int, int]]:
    """Ranges of texts of about ``limit`` bytes."""
    lo, n = 0, len(bounds) - 1
    while lo < n:
        hi = max(lo + 1, int(np.searchsorted(bounds, bounds[lo] + limit, side="right")) - 1)
        yield lo, hi
        lo = hi


def words(data: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of the words of each text, and how many words come before each text (n+1 values)."""
    inside = np.zeros(len(data) + 2, dtype=bool)
    inside[1:-1] = ~SPACE[data]
    first = inside[1:] & ~inside[:-1]
    last = inside[:-1] & ~inside[1:]
    cut = bounds[1:-1]
    cut = cut[(cut > 0) & (cut < len(data))]
    both = cut[inside[cut] & inside[cut + 1]]  # a word ends and another starts where two texts meet
    first[both] = True
    last[both] = True
    starts, ends = np.flatnonzero(first), np.flatnonzero(last)
    return starts, ends, np.searchsorted(starts, bounds, side="left")


def shingle_hashes(word_hashes: np.ndarray, before: np.ndarray, width: int = 5) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the ``width``-word shingles of each text and their text's number, in order.

    A text with fewer words has one shingle of all of them; one without words has none.
    """
    count = np.diff(before)
    n_docs, total = len(count), len(word_hashes)
    if not total:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    doc = np.repeat(np.arange(n_docs), count)
    step = keys(13, width)
    value = np.zeros(total, dtype=np.uint64)
    left = before[1:][doc] - np.arange(total)  # words from here to the end of the text
    for k in range(min(width, total)):
        shifted = np.zeros(total, dtype=np.uint64)
        shifted[: total - k] = word_hashes[k:]
        value += np.where(left > k, (shifted + np.uint64(k)) * (step[k] | np.uint64(1)), np.uint64(0))
    whole = (left >= width) | ((count[doc] < width) & (left == count[doc]))
    return mix(value[whole]), doc[whole]


def per_slice(
    df: DataFrame, text: str, keep: list[str], schema: str, work: Callable[[np.ndarray, np.ndarray], dict[str, object]]
) -> DataFrame:
    """One output row per row of ``df``: the columns ``keep`` and what ``work`` returns for the slice's texts."""
    from pyspark.sql.types import StructType

    kept = ", ".join(f"`{name}` {df.schema[name].dataType.simpleString()}" for name in keep)
    out = StructType.fromDDL(f"{kept}, {schema}" if kept else schema)
    names = [f.name for f in out][len(keep):]

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, bounds = text_buffers(batch.column(len(keep)))
            for lo, hi in slices(bounds):
                part = work(data[bounds[lo] : bounds[hi]], bounds[lo : hi + 1] - bounds[lo])
                arrays = [batch.column(i).slice(lo, hi - lo) for i in range(len(keep))]
                arrays += [v if isinstance(v, pa.Array) else pa.array(v) for v in (part[n] for n in names)]
                yield pa.RecordBatch.from_arrays(arrays, names=[*keep, *names])

    return df.select(*[F.col(f"`{c}`") for c in keep], F.col(f"`{text}`").cast("string").alias(text)).mapInArrow(run, out)


def fold(key: str | Column, folds: int) -> Column:
    """crc32 of the key as text, modulo ``folds``: the held-out rule of the labelled tables."""
    column = F.col(key) if isinstance(key, str) else key
    return F.crc32(column.cast("string").cast("binary")) % F.lit(folds)
