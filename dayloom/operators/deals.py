"""Random deals without sorting: a keyed permutation of row numbers, evaluated where it is needed.

Swap-or-not shuffle: in each round a key gives a pivot, ``x`` and
``(pivot - x) mod n`` are partners, and one hashed bit, the same for both, says
whether they swap. That is a permutation of 0 .. n-1 for every n and key, so
"the row's image is below m" deals m flags to n rows, and the images of
0 .. k-1 are k different rows. All arithmetic is on whole numbers below 2^63,
so any engine gets the same deal. Groups have fewer than 2^31 rows.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

ROUNDS = 12
REPS = 1000  # replicates that one task works on at once
CELLS = 1 << 15  # row x replicate cells worked on at once, in the cache
TASKS = 3  # for each core
HELD = 256  # groups and blocks of replicates whose sums a task holds
STEP, SPREAD, MASK = 2654435769, 73244475, 0xFFFFFFFF  # odd constants of the mixing; 32 bits


def key_of(*parts: Column | str) -> Column:
    """32 bits from a text key, the same in any engine with MD5."""
    cols = [p if isinstance(p, Column) else F.lit(p) for p in parts]
    return F.conv(F.substring(F.md5(F.concat_ws("|", *[c.cast("string") for c in cols])), 1, 8), 16, 10).cast("long")


def _mix(v: np.ndarray) -> np.ndarray:
    for _ in range(2):
        v = (v ^ (v >> np.uint32(16))) * np.uint32(SPREAD)
    return v


def round_keys(key: np.ndarray, rep: np.ndarray) -> np.ndarray:
    """The keys of all rounds (last axis) for arrays of group keys and replicates."""
    own = _mix((key + rep * STEP).astype(np.uint64).astype(np.uint32))
    return np.stack([_mix(own + np.uint32(t)) for t in range(1, ROUNDS + 1)], -1)


def permuted(x: np.ndarray, n: np.ndarray, keys: np.ndarray) -> np.ndarray:
    """Image of each x in 0 .. n-1 under the permutation of its keys; the arrays broadcast against keys[..., 0]."""
    shape = np.broadcast_shapes(x.shape, n.shape, keys.shape[:-1])
    x, n = np.broadcast_to(x, shape).astype(np.int32), n.astype(np.int32)
    for t in range(ROUNDS):
        k = keys[..., t]
        other = (k % n.astype(np.uint32)).astype(np.int32) - x
        np.add(other, n, out=other, where=other < 0)
        high = np.maximum(x, other).view(np.uint32)
        x = np.where(_mix(high + k) >> np.uint32(31) > 0, other, x)
    return x


@lru_cache(256)
def _rounds(key: int, n: int, first: int, last: int) -> tuple[np.ndarray, np.ndarray]:
    """Keys and pivots of a group's rounds (first axis) for the replicates from ``first`` to ``last``."""
    keys = np.ascontiguousarray(round_keys(np.int64(key), np.arange(first, last + 1, dtype=np.int64)).T)
    return keys, (keys % np.uint32(n)).astype(np.int32)


def images(x: np.ndarray, n: int, keys: np.ndarray, pivots: np.ndarray) -> np.ndarray:
    """``permuted`` for the rows of one group (rows x replicates), in blocks that stay in the cache."""
    reps = keys.shape[1]
    out = np.empty((len(x), reps), np.int32)
    step = max(1, CELLS // max(1, reps))
    other, high, move = (np.empty((min(step, len(x)), reps), np.int32) for _ in range(3))
    for i in range(0, len(x), step):
        at = out[i:i + step]
        at[:] = x[i:i + step, None]
        o, h, v = other[:len(at)], high[:len(at)], move[:len(at)]
        bits, shifted = h.view(np.uint32), v.view(np.uint32)
        for t in range(len(keys)):
            np.subtract(pivots[t], at, out=o)
            np.right_shift(o, 31, out=v)  # all ones where it is negative
            v &= np.int32(n)
            o += v
            np.maximum(at, o, out=h)
            bits += keys[t]
            for _ in range(2):  # _mix in place
                np.right_shift(bits, np.uint32(16), out=shifted)
                bits ^= shifted
                bits *= np.uint32(SPREAD)
            h >>= 31  # all ones where the partners swap
            o ^= at
            o &= h
            at ^= o
    return out


def flags(number: np.ndarray, n: np.ndarray, m: np.ndarray, key: np.ndarray, reps: np.ndarray) -> np.ndarray:
    """Rows x replicates (in unbroken order): whether a row (``number`` of ``n``, from 0) is among the ``m`` flagged ones."""
    out = np.empty((len(number), len(reps)), bool)
    order = np.lexsort((m, n, key))
    number, n, m, key = (c[order] for c in (number, n, m, key))
    start = np.flatnonzero(np.append(True, (key[1:] != key[:-1]) | (n[1:] != n[:-1]) | (m[1:] != m[:-1]))[:len(key)])
    for i, j in zip(start, [*start[1:], len(key)]):
        out[order[i:j]] = images(number[i:j], int(n[i]), *_rounds(int(key[i]), int(n[i]), int(reps[0]), int(reps[-1]))) < m[i]
    return out


def blocks(df: DataFrame, reps: int) -> DataFrame:
    """Every row once for each block of at most REPS replicates from 1 on, dealt out evenly: columns rep_from, rep_to."""
    count = -(-reps // REPS)
    spread = df.withColumn("_b", F.explode(F.sequence(F.lit(0), F.lit(count - 1))))
    # The work is rows times replicates, so it is dealt by row into a fixed number of tasks, whatever the bytes and however few the groups.
    return spread.select("*", (F.col("_b") * REPS + 1).alias("rep_from"), F.least(F.lit(reps), (F.col("_b") + 1) * REPS).alias("rep_to")).drop("_b").repartition(
        TASKS * df.sparkSession.sparkContext.defaultParallelism, *[F.col(c) for c in df.columns], "rep_from")


def _packs(frames: Iterator[pd.DataFrame], rows: int = 256) -> Iterator[tuple]:
    for pdf in frames:
        for (a, b), part in pdf.groupby(["rep_from", "rep_to"], sort=False):
            for at in range(0, len(part), rows):
                yield np.arange(a, b + 1, dtype=np.int64), part.iloc[at:at + rows]


class _Sums:
    """Sums for each group and block of replicates, held for a task and given out once, or when HELD are held."""

    def __init__(self, by: Sequence[str], names: Sequence[str]):
        self.by, self.names, self.held = list(by), list(names), {}

    def add(self, part: pd.DataFrame, reps: np.ndarray, values: dict[str, np.ndarray]) -> None:
        """``values`` are rows x replicates."""
        group = part.groupby(self.by, sort=False, dropna=False).ngroup().to_numpy()
        order = np.argsort(group, kind="stable")
        start = np.flatnonzero(np.append(True, np.diff(group[order]) != 0)[:len(order)])
        sums = [np.add.reduceat(values[c][order], start, axis=0, dtype=np.int64 if values[c].dtype != np.float64 else np.float64) for c in self.names]
        for i, key in enumerate(part[self.by].iloc[order[start]].itertuples(index=False, name=None)):
            own = self.held.setdefault((key, int(reps[0])), [np.zeros_like(x[i]) for x in sums])
            for total, x in zip(own, sums):
                total += x[i]

    def rows(self, last: bool = False) -> Iterator[pd.DataFrame]:
        if len(self.held) < (1 if last else HELD):
            return
        size = [len(v[0]) for v in self.held.values()]
        keys = list(zip(*[k for k, _ in self.held]))
        out = {c: pd.Series(list(k)).repeat(size).to_numpy() for c, k in zip(self.by, keys)}
        out["rep"] = np.concatenate([np.arange(first, first + n) for (_, first), n in zip(self.held, size)])
        out |= {c: np.concatenate([v[i] for v in self.held.values()]) for i, c in enumerate(self.names)}
        self.held = {}
        yield pd.DataFrame(out)


WINDOWS = {"pairs": (2, 2), "triples": (3, 3), "fives": (5, 3)}  # length of the window, flags that it needs
WORD = 56  # slots whose windows begin in a word; a word also holds the next ones
REACH = 8


def word_counts(on: np.ndarray, there: np.ndarray) -> dict[str, np.ndarray]:
    """Windows of 64-bit words ``on`` (flagged slots) inside ``there`` (slots that exist) that begin below WORD."""
    out, begin = {}, np.uint64((1 << WORD) - 1)
    for name, (length, need) in WINDOWS.items():
        whole, layers = there.copy(), [np.full_like(on, ~np.uint64(0))] + [np.zeros_like(on)] * need
        for i in range(length):  # layers[k]: windows with k flags or more so far
            bit = on >> np.uint64(i)
            whole &= there >> np.uint64(i)
            layers = [layers[0]] + [layers[k] | (layers[k - 1] & bit) for k in range(1, need + 1)]
        out[name] = np.bitwise_count(layers[need] & whole & begin).astype(np.int64)
    return out


def window_counts(rows: DataFrame, by: Sequence[str], segment: Sequence[str], reps: int) -> DataFrame:
    """(by, rep, pairs, triples, fives): flagged windows along unbroken slots, observed (rep 0) and dealt out.

    ``rows`` has strong, slot_index, _number, _n, _m, _key. Each segment is cut
    into words of WORD slots; a row stands in its word and, near its beginning,
    in the one before, so every window lies in one word. A word is a bounded
    array; the replicates' bit words are made and counted inside the task.
    """
    word = F.floor(F.col("slot_index") / WORD).cast("long")
    near = F.col("slot_index") - word * WORD < REACH
    placed = rows.withColumn("_w", F.explode(F.when(near, F.array(word, word - 1)).otherwise(F.array(word))))
    cell = F.struct((F.col("slot_index") - F.col("_w") * WORD).cast("int").alias("p"), F.col("_number").cast("long").alias("x"), F.col("_n").cast("long").alias("n"),
                    F.col("_m").cast("long").alias("m"), F.col("_key").alias("k"), F.col("strong").cast("int").alias("s"))
    words = placed.groupBy(*by, *segment, "_w").agg(F.collect_list(cell).alias("cells"))
    spread = blocks(words, reps).select(*by, "cells", "rep_from", "rep_to").sortWithinPartitions(*by)

    def run(batches):
        sums = _Sums(by, list(WINDOWS))
        for b in batches:
            schema = pa.schema([*(b.schema.field(c) for c in by), *((c, pa.int64()) for c in ("rep", *WINDOWS))])
            fixed = b.select([*by, "rep_from", "rep_to"]).to_pandas()  # dates stay dates
            cells = b.column(b.schema.get_field_index("cells"))
            size = np.diff(cells.offsets.to_numpy())
            flat = {f: c.to_numpy() for f, c in zip("pxnmks", cells.flatten().flatten())}
            start = np.cumsum(size) - size
            for reps_, part in _packs([fixed], 64):
                at = part.index.to_numpy()
                of = np.concatenate([np.arange(start[j], start[j] + size[j]) for j in at])
                own = {f: c[of] for f, c in flat.items()}
                first = np.cumsum(size[at]) - size[at]
                bit = np.uint64(1) << own["p"].astype(np.uint64)
                there = np.bitwise_or.reduceat(bit, first)[:, None]

                def count(on, reps_):
                    lit = np.bitwise_or.reduceat(np.where(on, bit[:, None], np.uint64(0)), first, axis=0)
                    sums.add(part, reps_, word_counts(lit, np.broadcast_to(there, lit.shape)))

                count(flags(own["x"], own["n"], own["m"], own["k"], reps_), reps_)
                if reps_[0] == 1:  # the observed flags, once
                    count(own["s"][:, None] > 0, np.zeros(1, np.int64))
                for out in sums.rows():
                    yield pa.RecordBatch.from_pandas(out, schema, preserve_index=False)
        for out in sums.rows(last=True):
            yield pa.RecordBatch.from_pandas(out, schema, preserve_index=False)

    kinds = ", ".join(f"`{c}` {rows.schema[c].dataType.simpleString()}" for c in by)
    fields = f"{kinds}, rep long, " + ", ".join(f"{s} long" for s in WINDOWS)
    return spread.mapInArrow(run, fields).groupBy(*by, "rep").agg(*[F.sum(s).alias(s) for s in WINDOWS])


def flag_sums(rows: DataFrame, by: Sequence[str], reps: int, value: str | None = None) -> DataFrame:
    """(by, rep, q, v): how many rows of each group are flagged, and the sum of their ``value``; rep 0 is observed.

    Rows travel as they are, once for each block of replicates; sums leave a task.
    """
    by = list(by)
    cols = [*by, "strong", "_number", "_n", "_m", "_key", F.col(value).cast("double").alias("_v") if value else F.lit(0.0).alias("_v")]
    spread = blocks(rows.select(*cols), reps).sortWithinPartitions(*by)

    def run(frames):
        sums = _Sums(by, ["q", "v"])
        for reps_, part in _packs(frames):
            number, n, m, key = (part[c].to_numpy(np.int64) for c in ("_number", "_n", "_m", "_key"))
            v = part["_v"].to_numpy(np.float64)[:, None]

            def count(on, reps_):
                sums.add(part, reps_, {"q": on, "v": on * v if value else np.zeros(on.shape)})

            count(flags(number, n, m, key, reps_), reps_)
            if reps_[0] == 1:  # the observed flags, once
                count(part["strong"].to_numpy(bool)[:, None], np.zeros(1, np.int64))
            yield from sums.rows()
        yield from sums.rows(last=True)

    kinds = ", ".join(f"`{c}` {rows.schema[c].dataType.simpleString()}" for c in by)
    out = spread.mapInPandas(run, f"{kinds}, rep long, q long, v double")
    return out.groupBy(*by, "rep").agg(F.sum("q").alias("q"), F.sum("v").alias("v"))


def draws(groups: DataFrame, by: Sequence[str], n: int, reps: int) -> DataFrame:
    """(by, rep, _number): ``n`` different row numbers (from 0) of each group and replicate; all of them if it has fewer."""
    by = list(by)

    def run(frames):
        for reps_, part in _packs(frames, 16):
            for _, r in part.iterrows():
                size = min(n, int(r["_n"]))
                x = permuted(np.arange(size)[None, :], np.array([r["_n"]]), round_keys(np.int64(r["_key"]), reps_)[:, None, :])
                yield pd.DataFrame({**{c: [r[c]] * x.size for c in by}, "rep": np.repeat(reps_, size), "_number": x.ravel().astype(np.int64)})

    kinds = ", ".join(f"`{c}` {groups.schema[c].dataType.simpleString()}" for c in by)
    return blocks(groups.select(*by, "_n", "_key"), reps).mapInPandas(run, f"{kinds}, rep long, _number long")
