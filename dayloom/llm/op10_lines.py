"""Line dedup by an exact set-similarity join (operator 10)."""

from __future__ import annotations

import zlib

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from dayloom.llm import graph, line_matches, setjoin
from dayloom.llm.common import _R, Texts, chunks, freed, mix, read, release, white_table, word_places
from dayloom.session import materialise

SIMILARITY, MORE = 80, 1  # percent; shared tokens that a pair must have in the prefixes
RARE = 1000  # the longest list of a rare token: places, lengths and signatures sift its pairs
COUNTERS = 20  # bits of the number of counters that order tokens by rarity
FLUSH = 1 << 18  # lines packed at once in a task
CHUNK = 1 << 20  # bytes of text worked on at once
SEGMENT = 1 << 18  # bytes whose words are hashed at once

_PACKED = "p long, kind string, set binary, doc binary, key binary, at binary"


def _lines(t: Texts) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Hash of each word, first word of each line with words, the line's row and its number in the text."""
    h, first, last = word_places(t, white_table(), SEGMENT)
    before = np.searchsorted(first, t.off)
    breaks = np.append(0, np.cumsum(t.data == 10, dtype=np.int32))
    row = np.repeat(np.arange(len(t)), np.diff(before))
    number = breaks[first] - breaks[t.off[row]]
    head = np.flatnonzero(np.append(True, (row[1:] != row[:-1]) | (number[1:] != number[:-1]))[:len(h)])
    return h, head, row[head], number[head].astype(np.int64)


def line_sets(t: Texts, rarity: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Key, size and tokens of each line's set of words, rarest first, and the line's row and number.

    A token is the class of its word's count on top of 58 bits of its hash, so
    sorting by value sorts by rarity.
    """
    h, head, row, number = _lines(t)
    tok = (rarity[(h >> np.uint64(64 - COUNTERS)).astype(np.int64)].astype(np.uint64) << np.uint64(58)) | (h >> np.uint64(6))
    ends = np.append(head[1:], len(tok))
    for a, b in zip(head.tolist(), ends.tolist()):
        tok[a:b].sort()
    line = np.repeat(np.arange(len(head)), ends - head)
    new = np.append(True, (tok[1:] != tok[:-1]) | (line[1:] != line[:-1]))[:len(tok)]
    tok, line = tok[new], line[new]
    size = np.bincount(line, minlength=len(head)).astype(np.int64)
    at = np.cumsum(size) - size
    total = np.add.reduceat(mix(tok + np.repeat(size, size).astype(np.uint64) * _R), at) if len(at) else np.zeros(0, np.uint64)
    return np.maximum(1, (mix(total) >> np.uint64(1)).astype(np.int64)), size, tok, row, number


def rarity(docs: DataFrame) -> np.ndarray:
    """Class of the number of words in all texts for each of 2^COUNTERS slots of their hashes: twice its binary logarithm.

    A fixed number of counters, whatever the input; words that share one share
    their class, which orders tokens but decides nothing.
    """

    def count(batches):
        total = np.zeros(1 << COUNTERS, np.int64)
        for b in chunks(batches, CHUNK):
            h, _, _ = word_places(Texts(b.column(0)), white_table(), SEGMENT)
            total += np.bincount((h >> np.uint64(64 - COUNTERS)).astype(np.int64), minlength=1 << COUNTERS)
        cut = total.reshape(64, -1)
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(64)), pa.array([zlib.compress(c.tobytes(), 1) for c in cut], pa.binary())], ["slice", "n"])

    def add(pdf: pd.DataFrame) -> pd.DataFrame:
        total = sum(np.frombuffer(zlib.decompress(x), np.int64) for x in pdf["n"])
        return pd.DataFrame({"slice": pdf["slice"].iloc[:1].to_numpy(), "n": [np.minimum(63, 2 * np.log2(total + 1)).astype(np.uint8).tobytes()]})

    rows = docs.select(F.coalesce("text", F.lit("")).alias("text")).mapInArrow(count, "slice long, n binary").groupBy("slice").applyInPandas(add, "slice long, n binary").collect()
    out = np.zeros((64, (1 << COUNTERS) // 64), np.uint8)
    for r in rows:  # 64 rows
        out[r.slice] = np.frombuffer(r.n, np.uint8)
    return out.ravel()


def _keyed(docs: DataFrame) -> DataFrame:
    """_text, place in the order (the id; without one last) and a key of id and text that is never null."""
    text = F.coalesce("text", F.lit(""))
    return docs.withColumn("_text", text).withColumn("_rank", F.coalesce(F.col("doc_id").cast("long"), F.lit((1 << 63) - 1))).withColumn("_key", F.xxhash64("doc_id", text))


def _cuts(p: np.ndarray) -> list[tuple[int, int, int]]:
    at = np.flatnonzero(np.append(True, p[1:] != p[:-1])[:len(p)])
    return [(int(p[i]), i, j) for i, j in zip(at, [*at[1:], len(p)])]


def _load(pdf, *cols):
    return [np.frombuffer(b"".join(pdf[c]), "<i8") for c in cols]


def _earliest(s, doc, key, at):
    """Sorted by set and place; whether each is the first of its set, and whether it is later (a repeated row is neither)."""
    order = np.lexsort((key, at, doc, s))
    s, doc, key, at = s[order], doc[order], key[order], at[order]
    one = np.append(True, s[1:] != s[:-1])[:len(s)]
    twin = np.append(False, (s[1:] == s[:-1]) & (key[1:] == key[:-1]) & (at[1:] == at[:-1]))[:len(s)]
    return s, doc, key, at, one, ~one & ~twin


def _by_part(kind, p, *cols):
    order = np.argsort(p, kind="stable")
    p, cols = p[order], [c[order] for c in cols]
    return [(n, kind, *(c[i:j].tobytes() for c in cols)) for n, i, j in _cuts(p)]


def _place_rows(held: list, parts: int) -> list[tuple]:
    """Packed rows (part, kind, set, doc, key, at) of lines: the earliest of each set by part of the set, and the later ones by part of the key."""
    s, doc, key, at, one, late = _earliest(*(np.concatenate(x).astype("<i8") for x in zip(*held)))
    late_ = key[late], at[late]
    return _by_part("line", s[one] % parts, s[one], doc[one], key[one], at[one]) + [(p, k, b"", b"", *x) for p, k, *x in _by_part("late", late_[0] % parts, *late_)]


def _settle(pdf: pd.DataFrame, parts: int) -> pd.DataFrame:
    """Of a part's packed rows the 'first' line of each set, and the 'late' lines by part of the key."""
    s, doc, key, at, one, late = _earliest(*_load(pdf[pdf["kind"] == "line"], "set", "doc", "key", "at"))
    rows = [(0, "first", *(c[one].tobytes() for c in (s, doc, key, at)))]
    old = _load(pdf[pdf["kind"] == "late"], "key", "at")
    key, at = np.concatenate([key[late], old[0]]), np.concatenate([at[late], old[1]])
    rows += [(p, kind, b"", b"", *x) for p, kind, *x in _by_part("late", key % parts, key, at)]
    return pd.DataFrame(rows, columns=["p", "kind", "set", "doc", "key", "at"])


def places(docs: DataFrame, table, parts: int) -> DataFrame:
    """Rows of kind 'first' (set, doc, key, at: the earliest line of each set) and 'late' (key, at: all other lines), packed."""

    def flush(held):
        kinds = [pa.int64(), pa.string(), *[pa.binary()] * 4]
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*_place_rows(held, parts)), kinds)], ["p", "kind", "set", "doc", "key", "at"])

    def scan(batches):
        held, n = [], 0
        for b in chunks(batches, CHUNK, "_text"):
            s, _, _, row, number = line_sets(Texts(b.column(0)), table.value)
            doc, key = (b.column(c).to_numpy(zero_copy_only=False)[row] for c in (1, 2))
            held.append((s, doc, key, number))
            n += len(s)
            if n >= FLUSH:
                yield flush(held)
                held, n = [], 0
        if n:
            yield flush(held)
        del held
        release()

    found = _keyed(docs).select("_text", "_rank", "_key").mapInArrow(scan, _PACKED)
    def part(pdf: pd.DataFrame) -> pd.DataFrame:
        return freed(_settle, pdf, parts)

    return found.groupBy("p").applyInPandas(part, _PACKED)


def _nodes(firsts: DataFrame, roots: DataFrame) -> DataFrame:
    """node, root, doc, key, at: the first lines of linked sets."""
    bits = firsts.sparkSession.sparkContext.broadcast(setjoin._wanted(roots.select("node")))

    def pick(batches):
        for b in batches:
            s, doc, key, at = _load({c: b.column(i).to_pylist() for i, c in enumerate(("set", "doc", "key", "at"))}, "set", "doc", "key", "at")
            use = setjoin._passes(bits.value, s)
            yield pa.RecordBatch.from_arrays([pa.array(x[use]) for x in (s, doc, key, at)], ["node", "doc", "key", "at"])

    return firsts.select("set", "doc", "key", "at").mapInArrow(pick, "node long, doc long, key long, at long").join(roots, "node")


def _linked(rows: DataFrame) -> DataFrame:
    """(key, at): of the first lines of linked sets all but the earliest of each group."""
    least = rows.groupBy("root").agg(F.min(F.struct("doc", "at", "key")).alias("keep"))
    return rows.join(least, "root").where(F.struct("doc", "at", "key") != F.col("keep")).select("key", "at")


def late_lines(docs: DataFrame, similarity: int = SIMILARITY, direct: bool = False) -> DataFrame:
    """(key, at): for each document with such lines their numbers, packed: lines linked to an earlier line; if ``direct``, that match one."""
    keyed = _keyed(docs)
    size = keyed.agg(F.sum(F.octet_length("_text"))).first()[0] or 0
    table = docs.sparkSession.sparkContext.broadcast(rarity(docs))
    parts = max(128, size >> 24)

    def sets(batch: pa.RecordBatch):
        keys, sizes, tokens = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)], [np.zeros(0, np.uint64)]
        for b in chunks(iter([batch]), CHUNK, "_text"):
            k, n, tok, _, _ = line_sets(Texts(b.column(0)), table.value)
            one = np.zeros(len(k), bool)
            one[np.unique(k, return_index=True)[1]] = True
            keys.append(k[one])
            sizes.append(n[one])
            tokens.append(tok[np.repeat(one, n)])
        return np.concatenate(keys), np.concatenate(sizes), np.concatenate(tokens)

    rule = setjoin.Rule(similarity, MORE, signed=True, rare=RARE)
    if direct:
        matched, placed = line_matches.matched(keyed, lambda b: line_sets(b, table.value), sets, rule, parts, _place_rows, lambda pdf: _settle(pdf, parts))
    else:
        placed = materialise(places(docs, table, parts), "places")
    firsts = placed.where("kind = 'first'")
    if direct:
        linked = _nodes(firsts, materialise(matched.withColumn("root", F.col("node")), "matched"))
    else:
        linked = _linked(_nodes(firsts, materialise(graph.components(setjoin.links(keyed.select("_text"), sets, rule, size // 8, graph.components)), "roots")))

    def pack(batches):
        for b in batches:
            key, at = (c.to_numpy(zero_copy_only=False).astype("<i8") for c in b.columns)
            order = np.argsort(key % parts, kind="stable")
            key, at = key[order], at[order]
            cols = list(zip(*[(n, key[i:j].tobytes(), at[i:j].tobytes()) for n, i, j in _cuts(key % parts)]))
            if cols:
                yield pa.RecordBatch.from_arrays([pa.array(cols[0], pa.int64()), *[pa.array(c, pa.binary()) for c in cols[1:]]], ["p", "key", "at"])

    def gather(pdf: pd.DataFrame) -> pd.DataFrame:
        key, at = _load(pdf, "key", "at")
        order = np.lexsort((at, key))
        key, at = key[order], at[order]
        return pd.DataFrame([(n, np.unique(at[i:j]).tobytes()) for n, i, j in _cuts(key)], columns=["key", "at"])

    late = placed.where("kind = 'late'").select("p", "key", "at")
    more = linked.select("key", "at").mapInArrow(pack, "p long, key binary, at binary")
    return late.unionByName(more).groupBy("p").applyInPandas(gather, "key long, at binary")


def dedup(docs: DataFrame, similarity: int = SIMILARITY, direct: bool = False) -> DataFrame:
    """``docs`` with three more columns: _lines and _removed (numbers of lines), and _kept: the text without the removed lines.

    A line's tokens are its distinct words (A-Z lower-cased, between white
    space); two lines match when their sets have a Jaccard similarity of
    ``similarity`` percent or more, so equal lines do. Of lines that are linked
    by matches the earliest by (doc_id, line) stays, and all later ones go; with
    ``direct`` a line goes only if an earlier line matches it itself.
    Lines without words stay. Null texts stay null and have no lines, empty ones
    one; documents without an id come last; a repeated row shares the result of
    its twin. All columns of ``docs`` are kept.
    """
    late = materialise(late_lines(docs, similarity, direct), "late").select(F.col("key").alias("_key"), F.col("at").alias("_at"))
    both = _keyed(docs).drop("_text", "_rank").join(late, "_key", "left").drop("_key")
    fields = docs.columns
    at = both.columns.index("text")

    def cut(batches):
        for b in batches:
            text, n, gone = [], [], []
            for t, packed in zip(b.column(at).to_pylist(), b.column(b.num_columns - 1).to_pylist()):
                lines = [] if t is None else t.split("\n")
                drop = set() if packed is None else set(np.frombuffer(packed, "<i8").tolist())
                text.append(t if not drop else "\n".join(x for i, x in enumerate(lines) if i not in drop))
                n.append(len(lines))
                gone.append(len(drop))
            yield pa.RecordBatch.from_arrays([*b.columns[:-1], pa.array(n, pa.int64()), pa.array(gone, pa.int64()), pa.array(text, pa.string())], [*fields, "_lines", "_removed", "_kept"])

    types = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema) + ", _lines long, _removed long, _kept string"
    return both.mapInArrow(cut, types)


def drop_lines(docs: DataFrame) -> DataFrame:
    """``docs`` without the lines that an earlier line matches; every row stays."""
    return dedup(docs, direct=True).drop("_lines", "_removed").drop("text").withColumnRenamed("_kept", "text").select(docs.columns)


def query(spark, sf_dir):
    return dedup(read(spark, sf_dir, "documents").select("doc_id", "text"), direct=True).select(
        "doc_id", F.col("_lines").alias("n_lines"), F.col("_removed").alias("n_removed"), F.col("_kept").alias("text"))
