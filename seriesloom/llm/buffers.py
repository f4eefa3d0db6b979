"""Texts of an Arrow batch as flat numpy arrays: spans, word hashes and word windows without a Python loop over words.

A batch's texts are one array of UTF-8 bytes and one of offsets. Work goes slice by slice, so the memory of a task depends on
the slice size and the longest single text, never on the number of texts.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

SLICE_BYTES = 2 << 20
HASH_BYTES = 1 << 19
BASE = np.uint64(0x9E3779B97F4A7C15)
#: BASE times INVERSE is 1 modulo 2**64.
INVERSE = np.uint64(pow(int(BASE), -1, 1 << 64))

LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32


def byte_set(values: Iterable[int]) -> np.ndarray:
    out = np.zeros(256, bool)
    out[list(values)] = True
    return out


#: Bytes of the words `[^\x20\x09-\x0D]+`.
WORD = ~byte_set([32, 9, 10, 11, 12, 13])


def text_arrays(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and offsets of a string column; a null counts as an empty text."""
    if column.null_count:
        column = column.fill_null("")
    n, kind = len(column), np.int64 if pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type) else np.int32
    buffers = column.buffers()
    if not n or buffers[2] is None:
        return np.zeros(0, np.uint8), np.zeros(n + 1, np.int64)
    offsets = np.frombuffer(buffers[1], kind)[column.offset : column.offset + n + 1].astype(np.int64)
    return np.frombuffer(buffers[2], np.uint8)[offsets[0] : offsets[-1]], offsets - offsets[0]


def slices(batches: Iterable[pa.RecordBatch], column: str = "text", limit: int = SLICE_BYTES) -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray]]:
    """Runs of rows of at most `limit` bytes of text (or one longer text), with their bytes and offsets."""
    pool = pa.default_memory_pool()
    for batch in batches:
        data, offsets = text_arrays(batch.column(batch.schema.get_field_index(column)))
        at = 0
        while at < batch.num_rows:
            to = max(at + 1, int(np.searchsorted(offsets, offsets[at] + limit, "right")) - 1)
            yield batch.slice(at, to - at), data[offsets[at] : offsets[to]], offsets[at : to + 1] - offsets[at]
            at = to
            pool.release_unused()  # else a worker keeps the most it ever needed


def spans(inside: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the maximal runs of true bytes; no run crosses from one text into the next."""
    first, last = inside.copy(), inside.copy()
    if len(inside):
        first[1:] &= ~inside[:-1]
        last[:-1] &= ~inside[1:]
        at = offsets[:-1][offsets[:-1] < offsets[1:]]
        first[at] = inside[at]
        at = offsets[1:][offsets[:-1] < offsets[1:]] - 1
        last[at] = inside[at]
    return np.flatnonzero(first), np.flatnonzero(last) + 1


def per_text(starts: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """First span of each text, and one past the last of all."""
    return np.searchsorted(starts, offsets)


def mixed(x: np.ndarray) -> np.ndarray:
    """A bijective scramble of 64-bit values (the finaliser of the published SplitMix64 generator)."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


BYTE_VALUES = mixed((np.arange(256, dtype=np.uint64) + np.uint64(1)) * BASE)


@cache
def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    up, down = np.full(n, BASE, np.uint64), np.full(n, INVERSE, np.uint64)
    up[0] = down[0] = 1
    return np.cumprod(up), np.cumprod(down)


def span_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit hash of each span of bytes: a polynomial over random byte values, scrambled, from prefix sums."""
    out = np.empty(len(starts), np.uint64)
    at = 0
    while at < len(starts):
        low = int(starts[at])
        to = max(at + 1, int(np.searchsorted(ends, low + HASH_BYTES, "right")))
        high = int(ends[to - 1])
        size = max(HASH_BYTES, 1 << (high - low).bit_length())
        up, down = _powers(HASH_BYTES) if size == HASH_BYTES else _powers.__wrapped__(size)
        sums = np.zeros(high - low + 1, np.uint64)
        np.cumsum(BYTE_VALUES[data[low:high]] * up[: high - low], out=sums[1:])
        s, e = starts[at:to] - low, ends[at:to] - low
        out[at:to] = (sums[e] - sums[s]) * down[s]
        at = to
    return mixed(out)


def windows(hashes: np.ndarray, firsts: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all runs of k words that lie in one text, and the index of each run's first word."""
    n = len(hashes) - k + 1
    if n <= 0:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    ends = np.repeat(firsts[1:], np.diff(firsts))
    at = np.flatnonzero(np.arange(len(hashes)) + k <= ends)
    total = hashes[:n].copy()
    for j in range(1, k):
        total *= BASE
        total += hashes[j : n + j]
    return mixed(total[at] + np.uint64(k)), at


def code_points(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Unicode code points of UTF-8 bytes, and the first one of each text."""
    lead = np.flatnonzero((data & 0xC0) != 0x80)
    points = data[lead].astype(np.uint32)
    wide = np.flatnonzero(points >= 0xC0)
    if len(wide):
        padded = np.concatenate([data, np.zeros(3, np.uint8)])
        at, first = lead[wide], points[wide]
        b1, b2, b3 = ((padded[at + i] & 0x3F).astype(np.uint32) for i in (1, 2, 3))
        two, three = (first & 0x1F) << 6 | b1, (first & 0x0F) << 12 | b1 << 6 | b2
        points[wide] = np.where(first < 0xE0, two, np.where(first < 0xF0, three, (first & 0x07) << 18 | b1 << 12 | b2 << 6 | b3))
    return points, np.searchsorted(lead, offsets)


def totals(values: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Sum of the values of each text."""
    sums = np.concatenate([[0], np.cumsum(values, dtype=np.int64)])
    return sums[offsets[1:]] - sums[offsets[:-1]]


def map_texts(df: DataFrame, text_col: str, make: Callable[[], Callable], extra: str, keep: list[str] | None = None, limit: int = SLICE_BYTES) -> DataFrame:
    """The kept columns of every row plus columns computed from its text.

    `make()` runs once a task and returns a function of (batch, bytes, offsets) that gives the extra columns as Arrow arrays, in
    the order of the DDL text `extra`. A kept column with the name of an extra one is replaced.
    """
    added = T.StructType.fromDDL(extra)
    taken = {f.name.lower() for f in added}
    kept = [c for c in (df.columns if keep is None else keep) if c.lower() not in taken]
    rows = df.select(*(quoted(c) for c in kept), quoted(text_col).alias("__text"))
    schema = T.StructType([*rows.schema.fields[:-1], *added.fields])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        work = make()
        for batch, data, offsets in slices(batches, "__text", limit):
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], *work(batch, data, offsets)], names=schema.names)

    return rows.mapInArrow(run, schema)


def quoted(name: str) -> Column:
    return F.col("`" + name.replace("`", "``") + "`")
