"""Helpers shared by the text operators: batches, hashed words, columns that may be null or clash."""

from __future__ import annotations

import contextlib
import ctypes
import os
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

CHUNK = 1 << 20  # bytes of text worked on at once inside a task
SEGMENT = 1 << 18  # bytes whose words are hashed at once for shingles

_R = np.uint64(0x9E3779B97F4A7C15)
_ODD = np.uint64(0xD6E8FEB86659FD93)


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(os.path.join(sf_dir, f"{name}.parquet"))


def texts(docs: DataFrame, *extra: str) -> DataFrame:
    """doc_id and text (null: empty), and the named further columns."""
    return docs.select("doc_id", F.coalesce(F.col("text"), F.lit("")).alias("text"), *extra)


def mix(h: np.ndarray) -> np.ndarray:
    """Spread the bits of 64-bit words; a bijection."""
    h = h ^ (h >> np.uint64(32))
    h = h * _ODD
    h = h ^ (h >> np.uint64(29))
    h = h * _R
    return h ^ (h >> np.uint64(32))


def _inverse(r: int) -> int:
    return pow(r, -1, 1 << 64)


_POWERS: dict[str, np.ndarray] = {}


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    if "up" not in _POWERS or len(_POWERS["up"]) < n + 1:
        size = max(n + 1, 1 << 16)
        for key, base in (("up", int(_R)), ("down", _inverse(int(_R)))):
            a = np.full(size, base, np.uint64)
            a[0] = 1
            _POWERS[key] = np.multiply.accumulate(a)
    return _POWERS["up"], _POWERS["down"]


def lower_table() -> np.ndarray:
    """Byte map that lower-cases A-Z only."""
    t = np.arange(256, dtype=np.uint8)
    t[65:91] += 32
    return t


def white_table() -> np.ndarray:
    """True for the bytes that separate words: blank and \\t to \\r."""
    t = np.zeros(256, bool)
    t[[32, 9, 10, 11, 12, 13]] = True
    return t


class Texts:
    """The text column of some rows as one byte array with row offsets."""

    def __init__(self, column: pa.Array | pa.ChunkedArray):
        if isinstance(column, pa.ChunkedArray):
            column = column.combine_chunks()
        if pa.types.is_large_string(column.type):
            column = column.cast(pa.string())
        if column.null_count:
            column = column.fill_null("")
        n = len(column)
        bufs = column.buffers()
        off = np.frombuffer(bufs[1], np.int32, n + 1, column.offset * 4).astype(np.int64) if n else np.zeros(1, np.int64)
        data = np.frombuffer(bufs[2], np.uint8) if bufs[2] is not None and len(bufs[2]) else np.zeros(0, np.uint8)
        self.data = data[off[0]:off[-1]]
        self.off = off - off[0]

    def __len__(self) -> int:
        return len(self.off) - 1


def chunks(batches: Iterator[pa.RecordBatch], limit: int = CHUNK, column: str = "text") -> Iterator[pa.RecordBatch]:
    """Batches cut so that the texts of one have about ``limit`` bytes; a longer text stands alone."""
    for b in batches:
        if not b.num_rows:
            continue
        sizes = Texts(b.column(b.schema.get_field_index(column))).off
        at = 0
        while at < b.num_rows:
            to = max(at + 1, int(np.searchsorted(sizes, sizes[at] + limit, side="right")) - 1)
            yield b.slice(at, to - at)
            at = to


def release() -> None:
    """Give freed memory back: a worker waits for its next task with what the last one left."""
    _POWERS.clear()
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):  # glibc alone keeps it
        ctypes.CDLL(None).malloc_trim(0)


def freed(run, *frames):
    """The result of ``run`` for one group, whose working memory is given back."""
    out = run(*frames)
    release()
    return out


def words(t: Texts, sep: np.ndarray, segment: int = CHUNK) -> tuple[np.ndarray, np.ndarray]:
    """64-bit hash of each word and the number of words before each row."""
    h, first, _ = word_places(t, sep, segment)
    return h, np.searchsorted(first, t.off)


def word_places(t: Texts, sep: np.ndarray, segment: int = CHUNK) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """64-bit hash, first byte and end of each word.

    A word is a run of bytes that ``sep`` does not mark, with A-Z lower-cased.
    The bytes are worked on in segments that end between words, so a text of
    any length needs little memory.
    """
    low = lower_table()
    cut = np.zeros(len(t.data) + 1, bool)
    cut[t.off] = True
    hashes, firsts, lasts = [], [], []
    at, end = 0, len(t.data)
    while at < end:
        to = min(end, at + segment)
        while to < end and not cut[to] and not sep[t.data[to]]:
            to += 1
        raw = t.data[at:to]
        inside = ~sep[raw]
        begins = inside.copy()
        begins[1:] &= ~inside[:-1] | cut[at + 1:to]
        ends = inside.copy()
        ends[:-1] &= ~inside[1:] | cut[at + 1:to]
        s, e = np.flatnonzero(begins), np.flatnonzero(ends) + 1
        up, down = _powers(len(raw) + 1)
        total = np.zeros(len(raw) + 1, np.uint64)
        np.cumsum((low[raw].astype(np.uint64) + np.uint64(1)) * up[:len(raw)], out=total[1:])
        hashes.append(mix((total[e] - total[s]) * down[s]))
        firsts.append(s + at)
        lasts.append(e + at)
        at = to
    if not hashes:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.int64)
    return np.concatenate(hashes), np.concatenate(firsts), np.concatenate(lasts)


def shingle_sets(t: Texts, k: int = 5) -> list[np.ndarray]:
    """For each row the sorted distinct hashes of its k-word shingles; fewer words make one shingle, none an empty set."""
    h, at = words(t, white_table(), SEGMENT)
    mul = [pow(int(_ODD), i, 1 << 64) for i in range(k)]
    if len(h) >= k:
        run = np.zeros(len(h) - k + 1, np.uint64)
        for i in range(k):
            run += h[i:len(h) - k + 1 + i] * np.uint64(mul[k - 1 - i])
        run = mix(run)
    else:
        run = np.zeros(0, np.uint64)
    out = []
    for a, b in zip(at[:-1], at[1:]):
        n = b - a
        if n >= k:
            out.append(np.unique(run[a:b - k + 1]))
        elif n:
            one = np.array([n], np.uint64)
            for i in range(a, b):
                one = mix(one * _R + h[i:i + 1])
            out.append(one)
        else:
            out.append(np.zeros(0, np.uint64))
    return out


def set_key(s: np.ndarray) -> int:
    """Order-free 63-bit key of a set of hashes; 0 only for the empty set."""
    if not len(s):
        return 0
    with np.errstate(over="ignore"):
        total = np.add.reduce(mix(s + np.uint64(len(s)) * _R))
    return max(1, int(mix(np.array([total], np.uint64))[0] >> np.uint64(1)))
