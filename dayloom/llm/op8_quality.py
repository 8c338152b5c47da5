"""Quality classifier: a factorisation machine on hashed words, structure and metadata (operator 8)."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from dayloom.llm.common import Texts, chunks, read, release, white_table, words

BUCKETS, RANK, MAX_ROWS, THRESHOLD = 1 << 16, 8, 8000, 0.3
METADATA = ("n_chars",)

# Byte classes whose shares of a text are structure statistics.
CLASSES = [b"abcdefghijklmnopqrstuvwxyz", b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"0123456789", b" ", b"\n", b".,;:", b"!?", b"|", b"#$%&*@^~+=", b"\"'`", b"()[]{}<>", b"-_/\\"]
STATS = len(CLASSES) + 2 + 6


def _class_table() -> np.ndarray:
    t = np.full(256, len(CLASSES), np.int64)
    t[128:] = len(CLASSES) + 1
    for i, c in enumerate(CLASSES):
        t[list(c)] = i
    return t


def _distinct(h: np.ndarray, row: np.ndarray, n: int) -> np.ndarray:
    order = np.lexsort((h, row))
    h, row = h[order], row[order]
    new = np.append(True, (h[1:] != h[:-1]) | (row[1:] != row[:-1]))[:len(h)]
    return np.bincount(row[new], minlength=n)


def features(t: Texts) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Row, word bucket and weight of each distinct word bucket of each text, rows ascending, and the structure statistics.

    Weights of a text are its square-rooted counts, scaled to length 1.
    """
    n, sizes = len(t), np.diff(t.off)
    h, at = words(t, white_table())
    count = np.diff(at)
    row = np.repeat(np.arange(n), count)
    key, times = np.unique((row << 16) | (h & np.uint64(BUCKETS - 1)).astype(np.int64), return_counts=True)
    w_row, bucket, weight = key >> 16, (key & (BUCKETS - 1)).astype(np.int32), np.sqrt(times)
    weight /= np.sqrt(np.maximum(1, count))[w_row]
    kinds = len(CLASSES) + 2
    stats = np.zeros((n, STATS), np.float64)
    owner = np.repeat(np.arange(n), sizes)
    stats[:, :kinds] = np.bincount(owner * kinds + _class_table()[t.data], minlength=n * kinds).reshape(n, kinds) / np.maximum(1, sizes)[:, None]
    line = np.zeros(256, bool)
    line[10] = True
    lh, lat = words(t, line)
    lines = np.diff(lat)
    lrow = np.repeat(np.arange(n), lines)
    one = np.maximum(1, count)
    stats[:, kinds:] = np.stack([np.log1p(sizes), np.log1p(count), sizes / (count + 1), _distinct(h, row, n) / one,
                                 np.log1p(count / np.maximum(1, lines)), _distinct(lh, lrow, n) / np.maximum(1, lines)], 1)
    return w_row, bucket, weight.astype(np.float32), stats


@dataclass
class Model:
    """Bias, linear weights and factors of BUCKETS words, then of the dense inputs, which are centred and scaled."""

    bias: float
    linear: np.ndarray
    factors: np.ndarray
    centre: np.ndarray
    scale: np.ndarray

    def dense(self, x: np.ndarray) -> np.ndarray:
        return np.clip((x - self.centre) / self.scale, -6, 6).astype(np.float32)

    def margins(self, row, bucket, weight, dense, n) -> np.ndarray:
        """Linear-time scores: half of (sum of v x) squared less the sum of (v x) squared, for each factor."""
        d = self.dense(dense)
        vx = self.factors[bucket] * weight[:, None]
        total, squares, line = d @ self.factors[BUCKETS:], (d ** 2) @ (self.factors[BUCKETS:] ** 2), d @ self.linear[BUCKETS:]
        if len(row):
            first = np.flatnonzero(np.append(True, row[1:] != row[:-1]))
            own = row[first]
            total[own] += np.add.reduceat(vx, first)
            squares[own] += np.add.reduceat(vx ** 2, first)
            line[own] += np.add.reduceat(self.linear[bucket] * weight, first)
        return self.bias + line + 0.5 * (total ** 2 - squares).sum(1)


def fit(rows: list[tuple[np.ndarray, np.ndarray]], dense: np.ndarray, label: np.ndarray, epochs: int = 12, batch: int = 64, rate: float = 0.05, decay: float = 1e-5, seed: int = 7) -> Model:
    """AdaGrad on the logistic loss; with one class or no rows the model is the constant of the classes seen."""
    rs, width = np.random.RandomState(seed), BUCKETS + dense.shape[1]
    share = (label.sum() + 0.5) / (len(label) + 1)
    model = Model(float(np.log(share / (1 - share))), np.zeros(width, np.float32), (rs.randn(width, RANK) * 0.02).astype(np.float32),
                  dense.mean(0) if len(label) else np.zeros(dense.shape[1]), np.maximum(dense.std(0), 1e-3) if len(label) else np.ones(dense.shape[1]))
    if len(np.unique(label)) < 2:
        model.factors[:] = 0
        return model
    d = model.dense(dense)
    g_line, g_fact, g_bias = np.full(width, 1e-4, np.float32), np.full((width, RANK), 1e-4, np.float32), 1e-4
    own = np.arange(BUCKETS, width)
    for _ in range(epochs):
        order = rs.permutation(len(label))
        for at in range(0, len(order), batch):
            pick = order[at:at + batch]
            idx = np.concatenate([np.append(rows[i][0], own) for i in pick])
            x = np.concatenate([np.append(rows[i][1], d[i]) for i in pick]).astype(np.float32)
            size = np.array([len(rows[i][0]) + len(own) for i in pick])
            row, first = np.repeat(np.arange(len(pick)), size), np.cumsum(size) - size
            vx = model.factors[idx] * x[:, None]
            total = np.add.reduceat(vx, first)
            m = model.bias + np.add.reduceat(model.linear[idx] * x, first) + 0.5 * (total ** 2 - np.add.reduceat(vx ** 2, first)).sum(1)
            err = (1 / (1 + np.exp(-np.clip(m, -30, 30))) - label[pick]).astype(np.float32) / len(pick)
            e = err[row] * x
            used, back = np.unique(idx, return_inverse=True)
            grad = np.bincount(back, e, len(used)) + decay * model.linear[used]
            g_line[used] += grad ** 2
            model.linear[used] -= rate * grad / np.sqrt(g_line[used])
            slope = e[:, None] * (total[row] - vx)
            for f in range(RANK):
                grad = np.bincount(back, slope[:, f], len(used)) + decay * model.factors[used, f]
                g_fact[used, f] += grad ** 2
                model.factors[used, f] -= rate * grad / np.sqrt(g_fact[used, f])
            g_bias += err.sum() ** 2
            model.bias -= rate * err.sum() / np.sqrt(g_bias)
    return model


def held_out(doc_id="doc_id"):
    """Rows whose CRC-32 of the id as text leaves no remainder by 5; a null id is held out too."""
    return F.coalesce(F.pmod(F.crc32(F.col(doc_id).cast("string").cast("binary")), F.lit(5)) == 0, F.lit(True))


def _inputs(docs: DataFrame, metadata: tuple[str, ...], *extra: str) -> DataFrame:
    """text and one list of metadata: log of each number, and whether it is missing."""
    meta = [c for m in metadata for c in (F.log1p(F.abs(F.coalesce(F.col(m).cast("double"), F.lit(0.0)))), F.col(m).isNull().cast("double"))]
    return docs.select(F.coalesce("text", F.lit("")).alias("text"), F.array(*meta).cast("array<double>").alias("meta"), *extra)


def _dense(b: pa.RecordBatch, stats: np.ndarray) -> np.ndarray:
    meta = np.array(b.column(1).to_pylist(), np.float64).reshape(len(stats), -1)
    return np.hstack([stats, meta])


def train(docs: DataFrame, labels: DataFrame, metadata: tuple[str, ...] = METADATA, max_rows: int = MAX_ROWS) -> Model:
    """Model of ``labels.quality`` from at most ``max_rows`` labelled rows that are not held out, in the order of a hash of their ids.

    The inputs of these rows are made by Spark from whole texts; the driver
    gets their word buckets alone, one row for each id (the least of an id's
    different ones), so its memory is bounded by ``max_rows``.
    """
    known = (labels.where(F.col("quality").isNotNull() & ~held_out()).groupBy("doc_id").agg(F.max("quality").alias("quality"))
             .orderBy(F.xxhash64("doc_id"), "doc_id").limit(max_rows))
    rows = docs.where(~held_out()).join(F.broadcast(known), "doc_id")

    def run(batches):
        for b in chunks(batches):
            t = Texts(b.column(0))
            row, bucket, weight, stats = features(t)
            at, dense = np.searchsorted(row, np.arange(len(t) + 1)), _dense(b, stats)
            cuts = list(zip(at[:-1], at[1:]))
            yield pa.RecordBatch.from_arrays(
                [pa.array([bucket[i:j].tobytes() for i, j in cuts]), pa.array([weight[i:j].tobytes() for i, j in cuts]),
                 pa.array([x.tobytes() for x in dense]), b.column(2), b.column(3)], ["bucket", "weight", "dense", "quality", "doc_id"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    got = _inputs(rows, metadata, F.col("quality").cast("int"), "doc_id").mapInArrow(run, f"bucket binary, weight binary, dense binary, quality int, doc_id {kind}")
    one = got.groupBy("doc_id").agg(F.min(F.struct("quality", "dense", "bucket", "weight")).alias("x"))  # of an id's rows one: at most max_rows
    got = one.select("doc_id", "x.*").collect()
    got.sort(key=lambda r: (r.doc_id, r.quality, r.dense, r.bucket))
    dense = np.array([np.frombuffer(r.dense) for r in got]).reshape(len(got), STATS + 2 * len(metadata))
    return fit([(np.frombuffer(r.bucket, np.int32), np.frombuffer(r.weight, np.float32)) for r in got], dense, np.array([float(r.quality > 0) for r in got]))


def score(docs: DataFrame, model: Model, metadata: tuple[str, ...] = METADATA, threshold: float = THRESHOLD) -> DataFrame:
    """doc_id, held_out, score, predicted for each row, from its whole text and its metadata.

    Null texts count as empty ones; these get the score of their statistics.
    Repeated rows get equal scores. Null metadata is an input of its own.
    """
    kept = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        for b in chunks(batches):
            t = Texts(b.column(0))
            row, bucket, weight, stats = features(t)
            m = kept.value.margins(row, bucket, weight, _dense(b, stats), len(t))
            yield pa.RecordBatch.from_arrays([b.column(2), pa.array(1 / (1 + np.exp(-np.clip(m.astype(np.float64), -30, 30))))], ["doc_id", "score"])
        release()

    kind = docs.schema["doc_id"].dataType.simpleString()
    out = _inputs(docs, metadata, "doc_id").mapInArrow(run, f"doc_id {kind}, score double")
    return out.select("doc_id", held_out().alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))


def keep_good(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """``docs`` without those that the classifier rejects; all rows of an id go if one of them is rejected, rows without an id stay."""
    bad = score(docs, train(docs, labels)).where("predicted = 0").select("doc_id").distinct()
    return docs.join(bad, "doc_id", "left_anti").select(docs.columns)


def query(spark, sf_dir):
    docs = read(spark, sf_dir, "documents")
    return score(docs, train(docs, read(spark, sf_dir, "labels")))
