"""Hard-negative mining by threshold joins over suffix-bounded inverted indexes (operator 12)."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from dayloom.llm.common import read
from dayloom.session import materialise, scratch_path

POSITIVES, NEGATIVES = 5, 3
LOW, HIGH = 50, 95  # percent of the positive's score between which a negative scores
SCALE, MOST = 256, 1 << 26  # of a component, and the greatest that one becomes
ANCHORS, ROWS = 4096, 4096  # anchors that are asked together; rows of one index
DIMS = 8  # neighbouring dimensions that share postings
NEAR = (0.5, 0.25)  # shares of the anchor's length and the longest row's above which positives are sought first
FALL = (0.85, 0.7)  # shares of the positive's score above which negatives are sought first

_ASK = "ask int, slot int, least long, most long"
_HITS = "ask int, slot int, vec_id long, score long"


def usable(vectors: DataFrame) -> DataFrame:
    """vec_id, label, v of the rows that take part: components as whole numbers, labels of ids divisible by 7 shifted."""
    v = F.col("embedding")
    ok = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x.cast("double")) < float("inf")))
    whole = F.transform(v, lambda x: F.greatest(F.lit(-MOST), F.least(F.lit(MOST), F.floor(x.cast("double") * SCALE))).cast("int"))
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label").cast("long") + 1) % 10).otherwise(F.col("label").cast("long"))
    rows = vectors.where(F.col("vec_id").isNotNull() & F.col("label").isNotNull() & v.isNotNull()).where(ok)
    return rows.select(F.col("vec_id").cast("long").alias("vec_id"), label.alias("label"), whole.alias("v")).distinct()


class Index:
    """Rows of one block with postings for groups of dimensions, the heavier groups last.

    A row's first groups are left out of the postings as long as their norm
    times the longest question's stays below ``least``: without the others no
    score reaches it. Rows with more postings stand first, so the list of a
    group is the first ``held[g]`` rows.
    """

    def __init__(self, x: np.ndarray, order: np.ndarray, least: float):
        groups = np.array_split(order, max(1, -(-len(order) // DIMS)))
        before = np.sqrt(np.cumsum([(x[:, g] ** 2).sum(1) for g in groups], 0))  # norm up to and with each group
        left = (before < least).sum(0)  # groups without postings
        self.rows = np.argsort(left, kind="stable")
        self.x = x[self.rows]
        self.groups = groups
        self.before = np.vstack([np.zeros(len(x)), before[:, self.rows]])
        self.left = left[self.rows]
        self.held = [int((self.left <= g).sum()) for g in range(len(groups))]

    def candidates(self, q: np.ndarray, least: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Pairs (question, row) whose score can reach the question's ``least``.

        Partial scores gather from the last group to the first; after each, the
        norms that remain on both sides bound what is still to come.
        """
        rest = np.vstack([np.zeros(len(q)), np.sqrt(np.cumsum([(q[:, g] ** 2).sum(1) for g in self.groups], 0))])
        slack = 1e-9 * (rest[-1].max(initial=0) * self.before[-1].max(initial=0) + 1)
        some = self.held[-1] if self.held else 0
        score = np.zeros((len(q), some))
        for g in range(len(self.groups) - 1, -1, -1):
            n = self.held[g]
            if not n:
                break
            d = self.groups[g]
            score[:, :n] += q[:, d] @ self.x[:n, d].T
            if g & 1 == 0 or g == len(self.groups) - 1:
                alive = score[:, :n] + rest[g][:, None] * self.before[g][None, :n] >= least[:, None] - slack
                if alive.mean() < 0.05:
                    break
        # Groups below a row's own first posting are still to come for it, and those below g for all.
        upto = np.maximum(self.left[:some], min(g, len(self.groups) - 1)) if some else self.left[:0]
        bound = score + rest[upto, :].T * self.before[upto, np.arange(some)][None, :]
        return np.nonzero(bound >= least[:, None] - slack)


def _matrix(col) -> np.ndarray:
    return np.stack(list(col)).astype(np.float64) if len(col) else np.zeros((0, 0))


def _best(ask, slot, vec_id, score, k: int) -> np.ndarray:
    """Places of the first k of each (ask, slot): higher scores, then smaller ids."""
    order = np.lexsort((vec_id, -score, slot, ask))
    a, s = ask[order], slot[order]
    new = np.append(True, (a[1:] != a[:-1]) | (s[1:] != s[:-1]))[:len(order)]
    start = np.flatnonzero(new)
    place = np.arange(len(order)) - np.repeat(start, np.diff(np.append(start, len(order))))
    return order[place < k]


def _meet(rows: DataFrame, anchors: pd.DataFrame, asked: pd.DataFrame, order: np.ndarray, same: bool, k: int) -> DataFrame:
    """ask, slot, vec_id, score: for each window (least to most) of an anchor its first k rows of the same or of another label.

    The anchors are one bounded block; the rows stay where they are, are indexed
    in blocks of ROWS, and leave at most k a window and block.
    """
    asked = asked.sort_values(["ask", "slot"])
    kept = rows.sparkSession.sparkContext.broadcast((anchors, asked))

    def run(frames: Iterator[pd.DataFrame]):
        anchors, asked = kept.value
        a = anchors.iloc[np.unique(asked["ask"])]
        place = {x: i for i, x in enumerate(a.index)}
        q, v_int, names, labels = _matrix(a["v"]), np.stack(list(a["v"])).astype(np.int64), a["vec_id"].to_numpy(), a["label"].to_numpy()
        win = np.array([place[x] for x in asked["ask"]])
        low, high, slot = asked["least"].to_numpy(), asked["most"].to_numpy(), asked["slot"].to_numpy()
        first = np.searchsorted(win, np.arange(len(a) + 1))
        floor = np.minimum.reduceat(low, first[:-1]).astype(np.float64)
        length = np.sqrt((q ** 2).sum(1))
        easy = np.argsort(-floor / np.maximum(length, 1), kind="stable")  # anchors of like thresholds share an index
        reach = low.copy()  # the k-th score that a window has already
        for pdf in frames:
            for at in range(0, len(pdf), ROWS):
                part = pdf.iloc[at:at + ROWS]
                x, x_int = _matrix(part["v"]), np.stack(list(part["v"])).astype(np.int64)
                ids, own = part["vec_id"].to_numpy(), part["label"].to_numpy()
                out = []
                for i in range(0, len(easy), 256):
                    asks = easy[i:i + 256]
                    least = np.minimum.reduceat(reach, first[:-1])[asks].astype(np.float64)
                    index = Index(x, order, float((least / np.maximum(length[asks], 1)).min()))
                    qi, xi = index.candidates(q[asks], least)
                    qi, xi = asks[qi], index.rows[xi]
                    use = (ids[xi] != names[qi]) & ((own[xi] == labels[qi]) == same)
                    qi, xi = qi[use], xi[use]
                    score = np.concatenate([(v_int[qi[j:j + 65536]] * x_int[xi[j:j + 65536]]).sum(1) for j in range(0, len(qi), 65536)] or [np.zeros(0, np.int64)])
                    for w in range(int(np.diff(first)[asks].max(initial=0))):  # the windows of the anchors, one after the other
                        has = first[qi] + w < first[qi + 1]
                        at_w = first[qi[has]] + w
                        s, xs = score[has], xi[has]
                        fit = (s >= reach[at_w]) & (s <= high[at_w])
                        at_w, s, xs = at_w[fit], s[fit], xs[fit]
                        top = _best(at_w, np.zeros(len(s)), ids[xs], s, k)
                        at_w, s, xs = at_w[top], s[top], xs[top]
                        full, many = np.unique(at_w, return_counts=True)
                        last = np.searchsorted(at_w, full, side="right") - 1
                        reach[full] = np.where(many == k, np.maximum(reach[full], s[last]), reach[full])
                        out.append((a.index.to_numpy()[win[at_w]], slot[at_w], ids[xs], s))
                ask, sl, vec, s = (np.concatenate(c) for c in zip(*out))
                if len(ask):
                    yield pd.DataFrame({"ask": ask.astype(np.int32), "slot": sl.astype(np.int32), "vec_id": vec, "score": s})

    found = rows.mapInPandas(run, _HITS)
    w = Window.partitionBy("ask", "slot").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def _until_full(rows, anchors, asked: pd.DataFrame, thresholds, order, same: bool, k: int, name: str) -> DataFrame:
    """The first k of each window, with thresholds that fall until it is full; ``thresholds`` end at the windows' own."""
    path = scratch_path(rows.sparkSession, name)
    for i, least in enumerate(thresholds):
        now = asked.assign(least=np.maximum(asked["least"].to_numpy(), least(asked)))
        hits = f"{path}/turn={i}"
        _meet(rows, anchors, now, order, same, k).write.parquet(hits)
        hits = rows.sparkSession.read.parquet(hits)
        last = (now["least"] <= asked["least"]).to_numpy()
        full = hits.where(F.col("rank") == k).select("ask", "slot").toPandas()  # of one block of anchors
        done = pd.MultiIndex.from_frame(full) if len(full) else pd.MultiIndex.from_arrays([[], []])
        asked = asked[~last & ~pd.MultiIndex.from_frame(asked[["ask", "slot"]]).isin(done)]
        if not len(asked):
            break
    hits = rows.sparkSession.read.parquet(path)
    w = Window.partitionBy("ask", "slot")  # at most k rows for each turn; the last turn holds the earlier ones
    return hits.withColumn("end", F.max("turn").over(w)).where("turn = end").select("ask", "slot", "rank", "vec_id", "score")


def negatives(vectors: DataFrame, is_anchor, positives: int = POSITIVES, k: int = NEGATIVES, low: int = LOW, high: int = HIGH) -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score, negative_score.

    Anchors are asked in blocks of ANCHORS, one block broadcast at a time, against
    all rows, which stay in their partitions. Positives are the windows of the
    same label without an upper end, negatives the windows from ``low`` to
    ``high`` percent of the positive's score. Each window is sought above a
    threshold that falls until it is full, so every result is exact. Rows with
    a null id, label or vector, or with a null or non-finite component take no
    part; equal rows count once; a zero vector scores 0 with all; vectors of
    fewer components end in zeros; an id with several vectors or labels is
    several rows, of which none is another row to the others; components beyond
    2^26 / 256 count as that. Extra columns are not read; an empty table or one
    label alone gives no rows.
    """
    spark = vectors.sparkSession
    rows = usable(vectors)
    width = rows.agg(F.max(F.size("v"))).first()[0] or 0
    pad = F.when(F.size("v") == width, F.col("v")).otherwise(F.concat("v", F.array_repeat(F.lit(0), F.lit(width) - F.size("v"))))
    rows = materialise(rows.withColumn("v", pad), "vectors")
    sums = rows.agg(*[F.sum(F.col("v")[i].cast("double") * F.col("v")[i]).alias(f"d{i}") for i in range(width)], F.count("*").alias("n")).first()
    long = rows.agg(F.max(F.aggregate("v", F.lit(0.0), lambda s, x: s + x.cast("double") * x))).first()[0] or 0.0
    order = np.argsort([sums[i] or 0.0 for i in range(width)], kind="stable")
    asks = rows.where(is_anchor)
    blocks = max(1, -(-asks.count() // ANCHORS))
    asks = materialise(asks.withColumn("block", F.pmod(F.xxhash64("vec_id", "label", "v"), F.lit(2 * blocks))).repartition("block"), "anchors")
    path = scratch_path(spark, "negatives")
    schema = "anchor_id long, positive_id long, rank int, negative_id long, positive_score long, negative_score long"
    spark.createDataFrame([], schema).write.parquet(f"{path}/block=-1")
    for at in range(2 * blocks if sums.n and width else 0):
        anchors = asks.where(F.col("block") == at).toPandas().sort_values(["vec_id", "label"]).reset_index(drop=True)
        if not len(anchors):
            continue
        norm = np.sqrt((_matrix(anchors["v"]) ** 2).sum(1) * long)
        least, most = np.iinfo(np.int64).min // 4, np.iinfo(np.int64).max // 4
        asked = pd.DataFrame({"ask": anchors.index, "slot": 0, "least": least, "most": most})
        turns = [lambda w, s=s: np.ceil(s * norm[w["ask"]]).astype(np.int64) for s in NEAR] + [lambda w: np.full(len(w), least)]
        near = _until_full(rows, anchors, asked, turns, order, True, positives, "positives").withColumnRenamed("vec_id", "positive_id").withColumnRenamed("score", "positive_score")
        pos = near.toPandas().sort_values(["ask", "rank"])  # at most ``positives`` for each anchor of the block
        p = pos["positive_score"].to_numpy()
        windows = pd.DataFrame({"ask": pos["ask"], "slot": pos["rank"], "least": -(-low * p // 100), "most": high * p // 100})
        windows = windows[windows["least"] <= windows["most"]]
        if not len(windows):
            continue
        turns = [lambda w, s=s: np.ceil(s * (w["most"] * 100 / high)).astype(np.int64) for s in FALL] + [lambda w: w["least"].to_numpy()]
        found = _until_full(rows, anchors, windows, turns, order, False, k, "windows")
        names = asks.where(F.col("block") == at)
        names = spark.createDataFrame(anchors[["vec_id"]].reset_index().rename(columns={"index": "ask", "vec_id": "anchor_id"}), "ask int, anchor_id long")
        near = near.select("ask", F.col("rank").alias("slot"), "positive_id", "positive_score")
        out = found.join(near, ["ask", "slot"]).join(names, "ask")
        (out.select("anchor_id", "positive_id", "rank", F.col("vec_id").alias("negative_id"), "positive_score", F.col("score").alias("negative_score"))
         .write.parquet(f"{path}/block={at}"))
    return spark.read.schema(schema).parquet(f"{path}/block=*")


def query(spark, sf_dir):
    return negatives(read(spark, sf_dir, "embeddings"), F.col("vec_id") % 50 == 0)


SQL = """
WITH ok AS (
  SELECT row_number() OVER () AS k, vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, embedding
  FROM embeddings WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL),
comp AS (
  SELECT k, vec_id, label, generate_subscripts(embedding, 1) AS d, unnest(embedding)::DOUBLE AS x FROM ok),
bad AS (SELECT DISTINCT k FROM comp WHERE x IS NULL OR NOT isfinite(x)),
v AS (SELECT k, vec_id, label, d, floor(256 * x)::BIGINT AS x FROM comp WHERE k NOT IN (SELECT k FROM bad)),
s AS (
  SELECT a.vec_id AS anchor_id, a.label AS la, b.vec_id AS vec_id, b.label AS lb, sum(a.x * b.x)::BIGINT AS score
  FROM v a JOIN v b ON a.d = b.d AND a.vec_id % 50 = 0 AND a.vec_id <> b.vec_id GROUP BY ALL),
pos AS (
  SELECT anchor_id, vec_id AS positive_id, score FROM s WHERE la = lb
  QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, vec_id) <= 5),
neg AS (
  SELECT p.anchor_id, p.positive_id, s.vec_id AS negative_id, p.score AS positive_score, s.score AS negative_score,
    row_number() OVER (PARTITION BY p.anchor_id, p.positive_id ORDER BY s.score DESC, s.vec_id) AS rank
  FROM pos p JOIN s ON s.anchor_id = p.anchor_id AND s.la <> s.lb
    AND 50 * p.score <= 100 * s.score AND 100 * s.score <= 95 * p.score)
SELECT anchor_id, positive_id, rank::INTEGER AS rank, negative_id, positive_score, negative_score FROM neg WHERE rank <= 3
"""
