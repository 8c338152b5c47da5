"""Substring dedup by hashed text units (operator 4)."""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from dayloom.llm.common import _R, Texts, chunks, mix, read, word_places
from dayloom.session import materialise

MIN_WORDS = 20  # of a run of repeated units that is removed
FLUSH = 1 << 19  # units packed at once in a task
LINE = 1 << 40  # added to the number of a line, to tell it from that of a unit

# Where units end: at these bytes ...
ENDS = {"line": b"\n", "sentence": b"\n.!?", "clause": b"\n.!?;:,"}
# ... and, but for the line break, only before white space or the text's end.

_PACKED = "p long, kind string, d binary, doc binary, key binary, at binary"


def _tables(unit: str) -> tuple[np.ndarray, np.ndarray]:
    apart = np.zeros(256, bool)
    apart[:128] = [not chr(i).isalnum() for i in range(128)]
    ends = np.zeros(256, bool)
    ends[list(ENDS[unit])] = True
    return apart, ends


def units(t: Texts, unit: str) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Digest, number of words and first byte of each unit with words, and the number of units before each row.

    Normalised, a unit is its sequence of words: runs of letters and digits,
    A-Z lower-cased; case, punctuation and spacing do not count.
    """
    apart, ends = _tables(unit)
    h, first, last = word_places(t, apart)
    before = np.searchsorted(first, t.off)
    if not len(h):
        return h, first, first, before
    after = np.append(t.data[1:], np.uint8(10))
    stop = ends[t.data] & ((t.data == 10) | (after == 32) | ((after >= 9) & (after <= 13)))
    stops = np.append(0, np.cumsum(stop, dtype=np.int32))
    new = np.append(True, stops[first[1:]] > stops[last[:-1]])
    new[before[:-1][np.diff(before) > 0]] = True
    head = np.flatnonzero(new)
    many = np.diff(np.append(head, len(h)))
    place = (np.arange(len(h)) - np.repeat(head, many)).astype(np.uint64)
    digest = mix(np.add.reduceat(mix(h + place * _R), head) + many.astype(np.uint64))
    return digest, many, first[head], np.searchsorted(first[head], t.off)


def _with_lines(t: Texts, unit: str) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Digest, row and number of each unit and then of each whole line; a line's digest never equals a unit's."""
    d, _, _, before = units(t, unit)
    lines, _, _, starts = units(t, "line")
    rows, places = [], []
    for at in (before, starts):
        row = np.repeat(np.arange(len(t)), np.diff(at))
        rows.append(row)
        places.append(np.arange(len(row)) - at[row])
    return np.append(d, mix(lines ^ _R)), np.concatenate(rows), np.append(places[0], places[1] + LINE)


def _line_ends(t: Texts, first: np.ndarray, row: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First byte of the line that holds each of the bytes ``first``, and of the line after it (the row's end in its last)."""
    breaks = np.flatnonzero(t.data == 10)
    i = np.searchsorted(breaks, first)
    bounds = np.concatenate([[-1], breaks, [len(t.data)]])
    return np.maximum(t.off[row], bounds[i] + 1), np.minimum(t.off[row + 1], bounds[i + 1] + 1)


def _merged(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out = []
    for a, z in sorted(spans):
        if out and a <= out[-1][1]:
            out[-1] = (out[-1][0], max(z, out[-1][1]))
        else:
            out.append((a, z))
    return out


def _keyed(docs: DataFrame) -> DataFrame:
    """text, place of the document in the order (its id; without one last) and a key of both that is never null."""
    last = F.lit((1 << 63) - 1)
    return docs.withColumn("_text", F.coalesce("text", F.lit(""))).withColumn("_rank", F.coalesce(F.col("doc_id").cast("long"), last)).withColumn("_key", F.xxhash64("doc_id", "_text"))


def _groups(at_p: np.ndarray) -> list[tuple[int, int, int]]:
    cut = np.flatnonzero(np.append(True, at_p[1:] != at_p[:-1])[:len(at_p)])
    return [(int(at_p[i]), i, j) for i, j in zip(cut, [*cut[1:], len(at_p)])]


def repeats(docs: DataFrame, unit: str, parts: int, whole: bool = False) -> DataFrame:
    """(key, at): the units of each document that an earlier one repeats; at is an array of unit numbers, packed.

    With ``whole`` also the lines that repeat an earlier line, as LINE + number.

    The order of units is (doc_id, place in the text). A task settles what
    repeats inside it and sends each digest on once, with its earliest place,
    so a unit that a third of all texts hold costs one entry for each task.
    """

    def pack(kind, p, d, doc, key, at):
        order = np.argsort(p, kind="stable")
        p, d, doc, key, at = p[order], d[order], doc[order], key[order], at[order]
        return [(n, kind, d[i:j].tobytes(), doc[i:j].tobytes(), key[i:j].tobytes(), at[i:j].tobytes()) for n, i, j in _groups(p)]

    def flush(held):
        d, doc, key, at = (np.concatenate(x) for x in zip(*held))
        order = np.lexsort((at, key, doc, d))
        d, doc, key, at = d[order], doc[order], key[order], at[order]
        one = np.append(True, (d[1:] != d[:-1]))
        again = np.append(False, (d[1:] == d[:-1]) & (doc[1:] == doc[:-1]) & (key[1:] == key[:-1]) & (at[1:] == at[:-1]))  # a repeated row
        late = ~one & ~again
        rows = pack("unit", (d[one] % np.uint64(parts)).astype(np.int64), d[one], doc[one], key[one], at[one])
        rows += pack("late", key[late] % parts, d[late], doc[late], key[late], at[late])
        cols = list(zip(*rows))
        kinds = [pa.int64(), pa.string(), *[pa.binary()] * 4]
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds)], ["p", "kind", "d", "doc", "key", "at"])

    def scan(batches):
        held, n = [], 0
        for b in chunks(batches, column="_text"):
            t = Texts(b.column(0))
            if whole:
                d, row, at = _with_lines(t, unit)
            else:
                d, _, _, before = units(t, unit)
                row = np.repeat(np.arange(len(t)), np.diff(before))
                at = np.arange(len(d)) - before[row]
            doc, key = (b.column(c).to_numpy(zero_copy_only=False)[row] for c in (1, 2))
            held.append((d, doc, key, at.astype(np.int64)))
            n += len(d)
            if n >= FLUSH:
                yield flush(held)
                held, n = [], 0
        if n:
            yield flush(held)

    def load(pdf, *cols):
        return [np.frombuffer(b"".join(pdf[c]), "<u8" if c == "d" else "<i8") for c in cols]

    def settle(pdf: pd.DataFrame) -> pd.DataFrame:
        """Of each digest all but the earliest place; and what the tasks have settled."""
        d, doc, key, at = load(pdf[pdf["kind"] == "unit"], "d", "doc", "key", "at")
        order = np.lexsort((at, key, doc, d))
        d, doc, key, at = d[order], doc[order], key[order], at[order]
        late = np.append(False, d[1:] == d[:-1])[:len(d)]
        same = np.append(False, (d[1:] == d[:-1]) & (key[1:] == key[:-1]) & (at[1:] == at[:-1]))[:len(d)]
        late &= ~same
        key2, at2 = load(pdf[pdf["kind"] == "late"], "key", "at")
        key, at = np.concatenate([key[late], key2]), np.concatenate([at[late], at2])
        q = key % parts
        order = np.argsort(q, kind="stable")
        q, key, at = q[order], key[order], at[order]
        return pd.DataFrame([(n, key[i:j].tobytes(), at[i:j].tobytes()) for n, i, j in _groups(q)], columns=["q", "key", "at"])

    def gather(pdf: pd.DataFrame) -> pd.DataFrame:
        key, at = load(pdf, "key", "at")
        order = np.lexsort((at, key))
        key, at = key[order], at[order]
        return pd.DataFrame([(n, np.unique(at[i:j]).tobytes()) for n, i, j in _groups(key)], columns=["key", "at"])

    found = _keyed(docs).select("_text", "_rank", "_key").mapInArrow(scan, _PACKED)
    settled = found.groupBy("p").applyInPandas(settle, "q long, key binary, at binary")
    return settled.groupBy("q").applyInPandas(gather, "key long, at binary")


def dedup(docs: DataFrame, unit: str = "clause", min_words: int = MIN_WORDS, whole: bool = False) -> DataFrame:
    """doc_id, n_units, n_repeated, n_removed (characters), spans and text: each text without the passages that repeat an earlier one.

    Units are hashed; of equal digests the earliest by (doc_id, place) stays.
    A run of repeated units is removed if it has ``min_words`` words, so chance
    repeats of short units inside a line stay. With ``whole`` every line that
    repeats an earlier line goes too, however short, with its line break, and so
    do repeated paragraphs and texts; its units count as repeated. Lines without
    words are no units and stay. ``spans`` are the removed places of the given
    text, in characters, from inclusive, to exclusive. Null and empty texts give
    an empty text and no spans; a document without an id comes last; a repeated
    row shares the result of its twin.
    """
    keyed = _keyed(docs)
    size = keyed.agg(F.sum(F.octet_length("_text"))).first()[0] or 0
    late = materialise(repeats(docs, unit, max(64, size >> 25), whole), "repeats").withColumnRenamed("key", "_key")
    kind = docs.schema["doc_id"].dataType.simpleString()

    def cut(batches):
        for b in chunks(batches):
            t = Texts(b.column(1))
            _, many, first, before = units(t, unit)
            if whole:
                _, _, head, lines = units(t, "line")
                begin, end = _line_ends(t, head, np.repeat(np.arange(len(t)), np.diff(lines)))
            out = []
            for r in range(len(t)):
                raw, i, j = t.data[t.off[r]:t.off[r + 1]].tobytes(), before[r], before[r + 1]
                packed = b.column(2)[r].as_py()
                spans, n = [], 0
                if packed:
                    hit = np.zeros(j - i + 2, np.int8)
                    late = np.frombuffer(packed, "<i8")
                    hit[1 + late[late < LINE]] = 1
                    for x in late[late >= LINE] - LINE:
                        a, z = begin[lines[r] + x], end[lines[r] + x]
                        spans.append((int(a - t.off[r]), int(z - t.off[r])))
                        hit[1 + np.searchsorted(first[i:j], a):1 + np.searchsorted(first[i:j], z)] = 1
                    n = int(hit.sum())
                    edge = np.diff(hit)
                    starts = np.append(first[i:j] - t.off[r], len(raw))
                    total = np.append(0, np.cumsum(many[i:j]))
                    for a, z in zip(np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)):
                        if total[z] - total[a] >= min_words:
                            spans.append((0 if a == 0 else int(starts[a]), int(starts[z])))
                keep, at, shown = [], 0, []
                for a, z in _merged(spans):
                    keep.append(raw[at:a])
                    shown.append({"from": len(raw[:a].decode()), "to": len(raw[:z].decode())})
                    at = z
                keep.append(raw[at:])
                gone = sum(s["to"] - s["from"] for s in shown)
                out.append((j - i, n, gone, shown, b"".join(keep).decode()))
            cols = list(zip(*out))
            kinds = [pa.int64(), pa.int64(), pa.int64(), pa.list_(pa.struct([("from", pa.int64()), ("to", pa.int64())])), pa.string()]
            yield pa.RecordBatch.from_arrays([b.column(0), *[pa.array(c, k) for c, k in zip(cols, kinds)]], ["doc_id", "n_units", "n_repeated", "n_removed", "spans", "text"])

    both = keyed.select("doc_id", F.col("_text").alias("text"), "_key").join(late, "_key", "left").select("doc_id", "text", "at")
    return both.mapInArrow(cut, f"doc_id {kind}, n_units long, n_repeated long, n_removed long, spans array<struct<from: bigint, to: bigint>>, text string")


def query(spark, sf_dir):
    return dedup(read(spark, sf_dir, "documents"), whole=True)
