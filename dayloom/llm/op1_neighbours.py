"""Approximate nearest neighbours from a forest of random-projection trees (operator 1)."""

from __future__ import annotations

import heapq
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from dayloom.llm.common import read
from dayloom.session import materialise

K, TREES, LEAF, SAMPLE = 20, 12, 256, 32_768
SEARCH, SHARE, PROBE = 5000, 0.6, 3000  # entries that a query looks at: SEARCH and SHARE of all; PROBE of them first
BLOCK, SIDE = 20_000, 8  # vectors of a leaf that one task holds; leaves that go to one task together


@dataclass
class Forest:
    """``trees`` complete trees of ``depth`` levels: a direction and a threshold for each inner node, in heap order."""

    depth: int
    directions: np.ndarray  # tree, node, dimension + 1
    thresholds: np.ndarray  # tree, node
    longest: float  # the greatest length of all vectors

    def lift(self, x: np.ndarray) -> np.ndarray:
        """Vectors of one length, so that the largest inner product is the nearest."""
        rest = np.maximum(0, self.longest ** 2 - (x ** 2).sum(1, keepdims=True))
        return np.hstack([x, np.sqrt(rest)])

    def leaves(self, x: np.ndarray) -> np.ndarray:
        """Leaf of each vector in each tree."""
        x, rows = self.lift(x), np.arange(len(x))
        out = np.zeros((len(x), len(self.directions)), np.int64)
        for t in range(len(self.directions)):
            node = np.zeros(len(x), np.int64)
            side = x @ self.directions[t].T - self.thresholds[t] if self.depth else None
            for _ in range(self.depth):
                node = 2 * node + 1 + (side[rows, node] > 0)
            out[:, t] = node - ((1 << self.depth) - 1)
        return out

    def search(self, q: np.ndarray, counts: np.ndarray, want: int, least: int, probe: int = 0) -> list[tuple[int, int, bool]]:
        """Leaves (tree, leaf) for one query, nearest margins first, from one queue that all trees share.

        It goes on until the leaves hold ``want`` entries, and ``least`` of one
        tree. The third field marks the first leaves, with ``probe`` entries.
        """
        x = np.append(q, 0.0)
        norm = np.linalg.norm(q) or 1.0
        inner = (1 << self.depth) - 1
        queue = [(-np.inf, t, 0) for t in range(len(self.directions))]
        found, got, of = [], 0, np.zeros(len(self.directions), np.int64)
        margins = (self.directions @ x) * (self.longest / norm) - self.thresholds if self.depth else None
        while queue and (got < want or of.max() < least):
            far, t, node = heapq.heappop(queue)
            while node < inner:
                m = float(margins[t, node])
                near = 2 * node + 1 + (m > 0)
                heapq.heappush(queue, (max(far, abs(m)), t, 4 * node + 3 - near))
                node = near
            leaf = node - inner
            if counts[t, leaf]:
                found.append((t, leaf, got < probe or of.max() < least))
                got += counts[t, leaf]
                of[t] += counts[t, leaf]
        return found


def fit(sample: np.ndarray, n: int, longest: float, trees: int = TREES, leaf: int = LEAF, seed: int = 11) -> Forest:
    """Trees on a sample of ``n`` vectors: random directions, cut at the median of the sample that reaches the node."""
    rs = np.random.RandomState(seed)
    depth = int(np.ceil(np.log2(max(1.0, min(n / leaf, len(sample) / 16)))))
    inner, width = (1 << depth) - 1, sample.shape[1] + 1 if sample.ndim == 2 else 1
    forest = Forest(depth, np.zeros((trees, inner, width)), np.zeros((trees, inner)), longest)
    x = forest.lift(sample) if len(sample) else np.zeros((0, width))
    for t in range(trees):
        w = rs.randn(inner, width)
        w /= np.linalg.norm(w, axis=1, keepdims=True) + 1e-12
        groups = {0: np.arange(len(x))}
        for node in range(inner):
            own = groups.pop(node)
            y = x[own] @ w[node]
            cut = np.median(y) if len(own) else 0.0
            forest.directions[t, node], forest.thresholds[t, node] = w[node], cut
            groups[2 * node + 1], groups[2 * node + 2] = own[y <= cut], own[y > cut]
    return forest


def usable(vectors: DataFrame) -> DataFrame:
    """vec_id and v: neither null nor zero, all components finite, of the commonest dimension (the larger of equals)."""
    v = F.col("embedding")
    ok = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x.cast("double")) < float("inf"))) & F.exists(v, lambda x: x != 0)
    rows = vectors.where(F.col("vec_id").isNotNull() & v.isNotNull()).select("vec_id", v.alias("v")).where(ok).withColumn("d", F.size("v"))
    dim = rows.groupBy("d").count().agg(F.max(F.struct("count", "d")).alias("x")).first().x
    return rows.where(F.col("d") == (dim.d if dim else 0)).drop("d")


def _matrix(col) -> np.ndarray:
    return np.stack(list(col)).astype(np.float64) if len(col) else np.zeros((0, 0))


def neighbours(vectors: DataFrame, is_query, k: int = K, trees: int = TREES, leaf: int = LEAF,
               sample: int = SAMPLE, search: int = SEARCH, share: float = SHARE, probe: int = PROBE) -> DataFrame:
    """query_id, rank, vec_id, score: for each row with ``is_query`` the ``k`` largest inner products among the candidates found.

    Equal vectors are one index entry that keeps its k + 1 smallest distinct ids: ties
    go to the smaller id, so no more can be in a result, and a vector that a
    third of all rows share costs one entry. The forest is fitted on at most
    ``sample`` distinct vectors, in the order of a hash; every distinct vector
    is indexed in every tree. Its depth grows with their number up to 16 sample
    vectors a leaf; larger leaves are cut into blocks. A query meets the blocks
    of the leaves that one queue over all trees gives it, and is ranked exactly
    in double precision; the first leaves give the score that a candidate from
    the others must reach. It looks at ``search`` entries and a ``share`` of
    all: vectors without structure have no neighbours to be found for less. With fewer than k candidates all are returned.
    Vectors that are null, zero, not finite or of another dimension take no
    part, nor do rows without an id; extra columns are not read; a repeated row
    counts once, an id with several vectors once for each score.
    """
    spark = vectors.sparkSession
    rows = usable(vectors)
    keep = Window.partitionBy("v").orderBy("vec_id")
    ids = rows.distinct().withColumn("r", F.row_number().over(keep)).where(F.col("r") <= k + 1)
    index = materialise(ids.groupBy("v").agg(F.sort_array(F.collect_list("vec_id")).alias("ids")).withColumn("id", F.col("ids")[0]), "vectors")
    n, longest = index.agg(F.count("*"), F.max(F.sqrt(F.aggregate("v", F.lit(0.0), lambda a, x: a + x.cast("double") * x)))).first()
    asked = materialise(rows.where(is_query).groupBy("vec_id", "v").agg(F.count("*").alias("n")), "queries")
    fitted = _matrix(pd.Series([r.v for r in index.orderBy(F.xxhash64("v"), "id").limit(sample).select("v").collect()]))
    forest = spark.sparkContext.broadcast(fit(fitted, n or 0, float(longest or 0.0), trees, leaf))
    width = 1 << forest.value.depth

    def place(frames):
        for pdf in frames:
            if len(pdf):
                at = forest.value.leaves(_matrix(pdf["v"])) + np.arange(trees) * width
                yield pd.DataFrame({"id": pdf["id"], "cells": list(at)})

    placed = index.select("id", "v").mapInPandas(place, "id long, cells array<long>").select("id", F.explode("cells").alias("cell"))
    placed = materialise(placed, "cells")
    held = np.zeros(trees * width, np.int64)
    for r in placed.groupBy("cell").count().collect():  # trees x leaves rows
        held[r.cell] = r["count"]
    held = spark.sparkContext.broadcast(held)

    want = search + int(share * (n or 0))

    def visit(frames):
        counts = held.value.reshape(trees, width)
        for pdf in frames:
            out = []
            for q, v in zip(pdf["vec_id"], _matrix(pdf["v"])):
                for t, lf, early in forest.value.search(v, counts, want, k + 2, probe):
                    out += [(q, t * width + lf, b, early) for b in range(-(-counts[t, lf] // BLOCK))]
            yield pd.DataFrame(out, columns=["q", "cell", "block", "early"]).astype({"q": "int64", "cell": "int64", "block": "int64", "early": bool})

    visits = materialise(asked.select("vec_id", "v").mapInPandas(visit, "q long, cell long, block long, early boolean"), "visits")
    per_cell = visits.groupBy("cell").agg((F.max("block") + 1).alias("blocks"))
    cells = placed.join(per_cell, "cell").join(index, "id").select("cell", F.pmod(F.xxhash64("id"), F.col("blocks")).alias("block"), "ids", "v")
    asked = asked.select(F.col("vec_id").alias("q"), F.col("v").alias("qv"))
    first = materialise(_scores(visits.where("early").join(asked, "q").withColumn("floor", F.lit(float("-inf"))), cells, k), "found")
    floor = _ranked(first, k).where(F.col("rank") == k).select(F.col("query_id").alias("q"), F.col("score").alias("floor"))
    rest = visits.where("not early").join(asked.join(floor, "q", "left"), "q").fillna(float("-inf"), "floor")
    return _ranked(first.unionByName(_scores(rest, cells, k)), k)


def _ranked(found: DataFrame, k: int) -> DataFrame:
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return found.distinct().withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def _scores(visits: DataFrame, cells: DataFrame, k: int) -> DataFrame:
    """For each visit the candidates of the leaf's block that reach the query's floor, its k best at most, ranked in double precision."""

    def best(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        out = []
        of_cell = dict(list(right.groupby("cell"))) if len(right) else {}
        for cell, asks in left.groupby("cell"):
            if cell not in of_cell:
                continue
            x, ids = _matrix(of_cell[cell]["v"]), of_cell[cell]["ids"].tolist()
            head, sole = np.array([c[0] for c in ids]), np.array([len(c) == 1 for c in ids])
            second = np.array([c[min(1, len(c) - 1)] for c in ids])
            # The rounding of a product is below this share of the lengths of its vectors.
            rounding = 1e-15 * (x.shape[1] + 8) * np.sqrt((x ** 2).sum(1).max())
            for at in range(0, len(asks), 256):
                part = asks.iloc[at:at + 256]
                q, floors = _matrix(part["qv"]), part["floor"].to_numpy()
                near = q @ x.T
                slack = rounding * np.sqrt((q ** 2).sum(1))
                some = np.flatnonzero(near.max(1) >= floors - slack)
                for i in some:
                    name = part["q"].iat[i]
                    top = np.flatnonzero((near[i] >= floors[i] - slack[i]) & ~(sole & (head == name)))
                    if len(top) > k:  # all that may reach the k-th score, however many
                        kth = np.partition(near[i][top], len(top) - k)[len(top) - k]
                        top = top[near[i][top] >= kth - 2 * slack[i]]
                    exact = (x[top] * q[i]).sum(1)
                    least = np.where(head[top] == name, second[top], head[top])  # the first id that an entry can give
                    first = np.lexsort((least, -exact))[:k]  # k entries give k ids, each before those of all other entries
                    order = sorted((-s, v) for s, c in zip(exact[first].tolist(), top[first]) if s >= floors[i] for v in ids[c] if v != name)[:k]
                    out += [(name, v, -s) for s, v in order]
        return pd.DataFrame(out, columns=["query_id", "vec_id", "score"]).astype({"query_id": "int64", "vec_id": "int64", "score": "float64"})

    side = lambda d: d.withColumn("side", F.expr(f"cell div {SIDE}")).groupBy("side", "block")
    return side(visits).cogroup(side(cells)).applyInPandas(best, "query_id long, vec_id long, score double")


def query(spark, sf_dir):
    return neighbours(read(spark, sf_dir, "embeddings"), F.col("vec_id") % 20 == 0)
