"""Secret scans: a random forest takes the false positives out of pattern findings (operator 9)."""

from __future__ import annotations

import re
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from dayloom.llm.common import chunks, read

MAX_ROWS, TREES, DEPTH, THRESHOLD = 6000, 40, 10, 0.5
NEAR, BUCKETS = 24, 32  # characters looked at on each side; slots of the hashed neighbouring words
COMMON = 4096  # words of the dictionary

# What a candidate looks like, and the formats by which findings are labelled where no labels are given.
CANDIDATE = re.compile(r"(?<![A-Za-z0-9+/_\-])(?=[A-Za-z+/_\-]*[0-9])[A-Za-z0-9+/_\-]{12,}")
KEY_FORMAT = r"^(AKIA[0-9A-Z]{16}|gh[pousr]_[A-Za-z0-9]{36,}|sk_live_[A-Za-z0-9]{16,}|xox[abprs]-[A-Za-z0-9-]{10,})$"
NAMED = r"(?i)(password|passwd|pwd|token|secret|api[_-]?key)\W{0,4}$"
# A value assigned to such a name, of any length and characters: quoted, or up to white space, a quote or the next assignment.
_ASSIGN = r"(?:password|passwd|pwd|token|secret|api[_-]?key)[\"'`]?[ \t]{0,4}(?:=>|:=|==?|:)[ \t]{0,4}"
ASSIGNED = rf"(?i){_ASSIGN}[\"'`]?$"
VALUE = re.compile(rf"(?i){_ASSIGN}(?:(?P<q>[\"'`])(?P<quoted>(?:\\[^\n]|(?!(?P=q))[^\\\n])+)(?P=q)|[\"'`]?(?P<bare>(?:(?![&;,]\w+=)[^\s\"'`])+))")

_WORD = re.compile(r"[^\W\d_]+")
_KINDS = np.full(128, 4, np.int64)
for _i, _c in enumerate(("abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "0123456789")):
    _KINDS[[ord(x) for x in _c]] = _i
_KINDS[[ord(x) for x in "+/_-"]] = 3
WIDTH = 1 + 5 + 25 + 4 + 2 * BUCKETS


def places(text: str) -> list[tuple[int, int]]:
    """Start and end of every candidate: values of named keys whole, and what else looks like one."""
    at = {}
    for m in VALUE.finditer(text):
        i, j = m.span("quoted" if m["quoted"] else "bare")
        if not m["quoted"]:  # the sentence's punctuation is not the value's
            j = i + (len(m["bare"].rstrip(",;.)]}")) or j - i)
        at[i] = j
    for m in CANDIDATE.finditer(text):
        at[m.start()] = max(m.end(), at.get(m.start(), 0))
    return sorted(at.items())


def findings(docs: DataFrame, path: str | None = "source") -> DataFrame:
    """doc_id, start, end (characters), value, before, after, path of every candidate in the whole texts."""

    def scan(batches):
        for b in chunks(batches):
            rows = []
            for d, t, p in zip(b.column(0), b.column(1).to_pylist(), b.column(2).to_pylist()):
                for i, j in places(t):
                    rows.append((d.as_py(), i, j, t[i:j], t[max(0, i - NEAR):i], t[j:j + NEAR], p))
            if rows:
                cols = list(zip(*rows))
                kinds = [b.schema.field(0).type, pa.int64(), pa.int64(), *[pa.string()] * 4]
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds)], ["doc_id", "start", "end", "value", "before", "after", "path"])

    where = F.col(path).cast("string") if path else F.lit(None).cast("string")
    d = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"), F.coalesce(where, F.lit("")).alias("path"))
    return d.mapInArrow(scan, f"doc_id {d.schema['doc_id'].dataType.simpleString()}, start long, end long, value string, before string, after string, path string")


def dictionary(docs: DataFrame, size: int = COMMON) -> list[str]:
    """The commonest words of all texts with 4 to 12 letters: a bounded list, equal counts by the word."""
    words = docs.select(F.explode(F.regexp_extract_all(F.lower(F.coalesce("text", F.lit(""))), F.lit(r"([a-z]{4,12})"))).alias("w"))
    return [r.w for r in words.groupBy("w").count().orderBy(F.desc("count"), "w").limit(size).collect()]


def labelled(found: DataFrame) -> DataFrame:
    """Labels by format: 1 for the known formats of keys and for values named as secrets, else 0."""
    return found.withColumn("label", (F.col("value").rlike(KEY_FORMAT) | F.col("before").rlike(NAMED) | F.col("before").rlike(ASSIGNED)).cast("int"))


def _slot(word: str) -> int:
    h = 0
    for c in word.lower():
        h = (h * 131 + ord(c)) & 0xFFFFFFFF
    return (h ^ (h >> 15)) % BUCKETS


def inputs(frame: pd.DataFrame, words: set[str]) -> np.ndarray:
    """Length; entropy and shares of characters; transitions between character kinds; coverage by dictionary words; neighbouring words; path."""
    out = np.zeros((len(frame), WIDTH), np.float32)
    for r, (value, before, after, path) in enumerate(zip(frame["value"], frame["before"], frame["after"], frame["path"])):
        kinds = _KINDS[np.minimum(np.frombuffer(value.encode("utf-8"), np.uint8), 127)]
        x, n = out[r], len(kinds)
        x[0] = n
        x[1:6] = np.bincount(kinds, minlength=5)[:5] / n
        x[6:31] = np.bincount(kinds[:-1] * 5 + kinds[1:], minlength=25)[:25] / max(1, n - 1)
        share = np.unique(list(value), return_counts=True)[1] / n
        x[31] = -(share * np.log2(share)).sum()
        covered = np.zeros(n, bool)
        for m in _WORD.finditer(value.lower()):
            w, i = m[0], m.start()
            for size in range(4, 13):
                for a in range(len(w) - size + 1):
                    if w[a:a + size] in words:
                        covered[i + a:i + a + size] = True
        x[32] = covered.mean()
        x[33], x[34] = "=" in before[-4:], ":" in before[-4:]
        for side, at in ((before, 35), (after, 35 + BUCKETS)):
            near = _WORD.findall(side)
            for w in (near[-2:] if at == 35 else near[:1]):
                x[at + _slot(w)] = 1
        if path:
            x[35 + BUCKETS + _slot(path)] += 0.5
    return out


@dataclass
class Forest:
    """Trees in flat arrays: input, threshold, left child (0: a leaf; the right one follows) and share of label 1."""

    trees: list[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]

    def score(self, x: np.ndarray) -> np.ndarray:
        total = np.zeros(len(x))
        for col, cut, left, share in self.trees:
            node = np.zeros(len(x), np.int64)
            for _ in range(DEPTH + 1):
                inner = left[node] > 0
                node = np.where(inner, left[node] + (x[np.arange(len(x)), col[node]] > cut[node]), node)
            total += share[node]
        return total / max(1, len(self.trees))


def grow(x: np.ndarray, y: np.ndarray, rs: np.random.RandomState, depth: int = DEPTH):
    """One tree on a bootstrap sample: Gini gain, a random subset of inputs at each node, a few random thresholds of each."""
    pick = rs.randint(0, len(y), len(y))
    col, cut, left, share, todo = [0], [0.0], [0], [y[pick].mean()], [(0, pick, 0)]
    while todo:
        node, own, level = todo.pop()
        p = y[own].mean()
        share[node] = p
        if level == depth or len(own) < 4 or p in (0.0, 1.0):
            continue
        best = (1e-9, None, None)
        for f in rs.choice(x.shape[1], int(np.sqrt(x.shape[1])) + 1, replace=False):
            v = x[own, f]
            if v.min() == v.max():
                continue
            for c in np.unique(rs.uniform(v.min(), v.max(), 4)):
                side = v > c
                k = side.mean()
                if 0 < k < 1:
                    a, b = y[own][side].mean(), y[own][~side].mean()
                    gain = p * (1 - p) - k * a * (1 - a) - (1 - k) * b * (1 - b)
                    if gain > best[0]:
                        best = (gain, f, c)
        if best[1] is None:
            continue
        side = x[own, best[1]] > best[2]
        col[node], cut[node], left[node] = best[1], best[2], len(col)
        for part in (own[~side], own[side]):
            todo.append((len(col), part, level + 1))
            col.append(0)
            cut.append(0.0)
            left.append(0)
            share.append(0.0)
    return np.array(col), np.array(cut), np.array(left), np.array(share)


def train(found: DataFrame, words: list[str], max_rows: int = MAX_ROWS, trees: int = TREES, seed: int = 5) -> Forest:
    """Forest on at most ``max_rows`` / 2 labelled findings of each label, in the order of a hash of their values. None: a forest that scores 0.

    A value counts once for each label, with the place whose hash is least, so
    neither common values nor a common label push the others out.
    """
    place = F.struct(F.xxhash64("value", "before", "doc_id", "start").alias("h"), "doc_id", "start", "before", "after", "path")
    once = found.where(F.col("label").isNotNull()).groupBy("label", "value").agg(F.min(place).alias("p")).select("label", "value", "p.*")
    rows = pd.concat([once.where(side).orderBy("h", "doc_id", "start").limit(max_rows // 2).toPandas() for side in ("label > 0", "label <= 0")], ignore_index=True)
    if not len(rows):
        return Forest([])
    x, y, rs = inputs(rows, set(words)), rows["label"].to_numpy(np.float64), np.random.RandomState(seed)
    return Forest([grow(x, y, rs) for _ in range(trees)])


def secrets(docs: DataFrame, labels: DataFrame | None = None, path: str | None = "source", threshold: float = THRESHOLD) -> DataFrame:
    """doc_id, start, end, value, score, secret: every candidate in the whole texts and the forest's verdict.

    Candidates are the values assigned (= or :) to a name of a secret, whatever
    their length and characters, and elsewhere runs of 12 or more of
    [A-Za-z0-9+/_-] with a digit.
    Learnt from ``labels`` (findings with label 0 or 1), else from the findings
    whose format names them. Null and empty texts have no candidates; a null
    path is empty; repeated rows give repeated findings; without findings the
    result is empty; extra columns are not read.
    """
    found = findings(docs, path)
    words = dictionary(docs)
    kept = docs.sparkSession.sparkContext.broadcast((train(labels if labels is not None else labelled(found), words), set(words)))

    def judge(frames):
        forest, known = kept.value
        for pdf in frames:
            pdf = pdf.assign(score=forest.score(inputs(pdf, known)) if len(pdf) else np.zeros(0))
            yield pdf[["doc_id", "start", "end", "value", "score"]]

    kind = docs.schema["doc_id"].dataType.simpleString()
    return found.mapInPandas(judge, f"doc_id {kind}, start long, end long, value string, score double").withColumn("secret", F.col("score") >= threshold)


def query(spark, sf_dir):
    return secrets(read(spark, sf_dir, "documents"))
