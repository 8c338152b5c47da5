"""Phrase collocation mining after Toivonen: a sample proposes phrases, full passes count them and their negative border (operator 13)."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from dayloom.llm.common import _ODD, Texts, chunks, lower_table, mix, read, word_places
from dayloom.session import materialise

LEAST, LONGEST, TOP = 10, 3, 2000
SHARE, SAMPLED = 4, 2  # one document in SHARE is in the sample; a phrase that it holds SAMPLED times is proposed
CHUNK = 5 << 20  # bytes of text worked on at once
BITS = (20, 28)  # the least and the greatest logarithm of a filter's size in bits
GROUP = 100_000  # candidates of a language that one task ranks
BREAKS = ".,;:!?\n\v\f\r"  # fixed: they end a piece; blank and tab end a word


def _table(chars: str) -> np.ndarray:
    t = np.zeros(256, bool)
    t[[ord(c) for c in chars]] = True
    return t


BREAK = _table(BREAKS)
APART = _table(BREAKS + " \t")

_COUNTED = "lang string, words int, phrase string, n long"


def _tongue(lang: str) -> int:
    return int.from_bytes(hashlib.blake2b(lang.encode(), digest_size=8).digest(), "little")


def _grown(key: np.ndarray, h: np.ndarray, n: int) -> np.ndarray:
    """Keys of the phrases of ``n`` words from those of n - 1 words and the hashes of all words."""
    return mix(key[:len(h) - n + 1] * _ODD + h[n - 1:])


def _has(bits: np.ndarray, key: np.ndarray) -> np.ndarray:
    at = key & np.uint64(len(bits) * 8 - 1)
    return (bits[at >> np.uint64(3)] >> (at & np.uint64(7)).astype(np.uint8)) & np.uint8(1) > 0


def _word_end(data: np.ndarray, at: int, words: int) -> int:
    """The end of the ``words``-th word from byte ``at`` on, and of the word that ``at`` stands in."""

    def skip(at: int, apart: bool) -> int:
        while at < len(data):
            stop = APART[data[at:at + 4096]] != apart
            if stop.any():
                return at + int(stop.argmax())
            at += 4096
        return len(data)

    at = skip(at, False)
    for _ in range(words):
        at = skip(skip(at, True), False)
    return at


def _segments(t: Texts, longest: int) -> Iterator[tuple[Texts, int]]:
    """A text cut between words, each part with the words that phrases begun in it reach; the byte where the next part begins."""
    if len(t) > 1 or len(t.data) <= 2 * CHUNK:
        yield t, len(t.data)
        return
    at = 0
    while at < len(t.data):
        cut = _word_end(t.data, min(len(t.data), at + CHUNK), 0)
        part = Texts.__new__(Texts)
        part.data = t.data[at:_word_end(t.data, cut, longest - 1)]
        part.off = np.array([0, len(part.data)])
        yield part, cut - at
        at = cut


def _strings(data: np.ndarray, first: np.ndarray, last: np.ndarray, at: np.ndarray, n: int) -> pa.Array:
    """The phrases of ``n`` words that begin with the words ``at``, one blank between words."""
    starts = np.full((len(at), 2 * n - 1), len(data) - 1)  # the blank after the text
    sizes = np.ones_like(starts)
    for i in range(n):
        starts[:, 2 * i], sizes[:, 2 * i] = first[at + i], last[at + i] - first[at + i]
    off = np.append(0, np.cumsum(sizes.sum(1)))
    kind = np.int32 if max(int(off[-1]), len(data)) < 1 << 31 else np.int64
    starts, flat = starts.ravel().astype(kind), sizes.ravel().astype(kind)
    where = np.repeat(starts - np.cumsum(flat, dtype=kind) + flat, flat)
    where += np.arange(len(where), dtype=kind)
    if off[-1] < 1 << 31:
        return pa.StringArray.from_buffers(len(at), pa.py_buffer(off.astype(np.int32)), pa.py_buffer(data[where]))
    return pa.LargeStringArray.from_buffers(len(at), pa.py_buffer(off), pa.py_buffer(data[where]))


def _occurrences(docs: DataFrame, levels: list[int], longest: int, want=None, done=None) -> DataFrame:
    """(lang, words, phrase, n): counts of a chunk's phrases of the given numbers of words; of 0 words: of all words.

    With ``want`` (a broadcast filter for each number of words) a phrase counts
    only if both phrases that are a word shorter pass it and not both pass ``done``.
    """

    def run(batches):
        low, tongues = lower_table(), {}
        for b in chunks(batches, CHUNK):
            names = b.column(1).to_pylist()
            tongue = np.array([tongues.setdefault(x, _tongue(x)) for x in names], np.uint64)
            for t, cut in _segments(Texts(b.column(0)), longest):
                h, first, last = word_places(t, APART)
                if not len(h):
                    continue
                row = np.searchsorted(t.off, first, side="right") - 1
                piece = np.cumsum(BREAK[t.data], dtype=np.int32)[first]
                begins = int(np.searchsorted(first, cut))
                data = np.append(low[t.data], np.uint8(32))
                out, key = [], mix(h ^ tongue[row])
                for n in range(1, longest + 1):
                    if n > 1:
                        if len(h) < n:
                            break
                        below, key = key, _grown(key, h, n)
                    if n not in levels:
                        continue
                    use = np.ones(len(key), bool)
                    use[begins:] = False
                    if n > 1:
                        use &= (row[n - 1:] == row[:len(key)]) & (piece[n - 1:] == piece[:len(key)])
                        if want is not None:
                            passed = _has(want.value[n - 1], below)
                            use &= passed[:-1] & passed[1:]
                            if done is not None:
                                passed = _has(done.value[n - 1], below)
                                use &= ~(passed[:-1] & passed[1:])
                    at = np.flatnonzero(use)
                    _, one, many = np.unique(key[at], return_index=True, return_counts=True)
                    at = at[one]
                    if len(at):
                        out.append((row[at], n, _strings(data, first, last, at, n), many))
                if 0 in levels:
                    each = np.bincount(row[:begins], minlength=len(names))
                    at = np.flatnonzero(each)
                    out.append((at, 0, pa.array([""] * len(at)), each[at]))
                for r, n, phrases, many in out:
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(names).take(pa.array(r)), pa.array(np.full(len(r), n, np.int32)), phrases.cast(pa.string()), pa.array(many.astype(np.int64))],
                        ["lang", "words", "phrase", "n"])

    # A chunk sends each phrase once, so no key is hot, and counting again before the shuffle would save few rows.
    found = docs.mapInArrow(run, _COUNTED).select("lang", "phrase", "n").repartition("lang", "phrase").groupBy("lang", "phrase").agg(F.sum("n").alias("n"))
    return found.withColumn("words", F.when(F.col("phrase") == "", 0).otherwise(F.size(F.split("phrase", " "))))


def _filters(phrases: DataFrame, longest: int, size: int) -> dict[int, np.ndarray]:
    """A filter of ``size`` bits of the keys of the phrases of each number of words below ``longest``."""

    def marks(batches):
        for b in chunks(batches, CHUNK, "phrase"):
            n, t = b.column(1).to_numpy(), Texts(b.column(2))
            h, first, _ = word_places(t, APART)
            at = np.searchsorted(first, t.off[:-1])
            key = mix(h[at] ^ np.array([_tongue(x) for x in b.column(0).to_pylist()], np.uint64))
            for i in range(1, longest - 1):
                more = n > i
                key[more] = mix(key[more] * _ODD + h[at[more] + i])
            place = key & np.uint64(size - 1)
            yield pa.RecordBatch.from_arrays(
                [pa.array(n), pa.array((place >> np.uint64(6)).astype(np.int64)), pa.array((np.uint64(1) << (place & np.uint64(63))).view(np.int64))], ["words", "at", "bits"])

    def block(pdf: pd.DataFrame) -> pd.DataFrame:
        own = np.zeros(1 << 13, np.int64)
        own[pdf["at"].to_numpy() & 8191] = pdf["bits"].to_numpy()
        return pd.DataFrame({"words": [pdf["words"].iat[0]], "block": [int(pdf["at"].iat[0]) >> 13], "bits": [own.tobytes()]})

    found = phrases.where((F.col("words") > 0) & (F.col("words") < longest)).select("lang", "words", "phrase")
    found = found.mapInArrow(marks, "words int, at long, bits long").groupBy("words", "at").agg(F.bit_or("bits").alias("bits"))
    out = {n: np.zeros(size >> 3, np.uint8) for n in range(1, longest)}
    blocks = found.groupBy("words", F.shiftright("at", 13).alias("block")).applyInPandas(block, "words int, block long, bits binary")
    for r in blocks.toLocalIterator():  # at most size / 2^19 rows of 64 KB for each number of words
        part = np.frombuffer(r.bits, np.uint8)
        out[r.words][r.block << 16:(r.block + 1) << 16] |= part[:size >> 3]
    return out


def frequent(docs: DataFrame, least: int = LEAST, longest: int = LONGEST, share: int = SHARE, sampled: int = SAMPLED) -> DataFrame:
    """(lang, words, phrase, n): exact counts of all phrases of 1 to ``longest`` words with ``least`` occurrences; words 0: all words of the language.

    One document in ``share``, by a hash of its id, is the sample; what occurs
    there ``sampled`` times is proposed. The first full pass counts all words,
    and the phrases whose two parts (without the last, without the first word)
    are proposed: these are the proposed ones and their negative border. Where
    phrases of the border turn out frequent, further passes count what they make
    possible, until nothing new is frequent. The sample only decides how many
    passes there are, not what is found. Proposals travel as filters sized by
    their number (2^20 to 2^28 bits); a phrase that only passes a filter by
    chance is counted too, and kept if it is frequent. Counts are kept by the
    phrases themselves and not by hashes.
    """
    spark = docs.sparkSession
    rows = docs.select(F.coalesce("text", F.lit("")).alias("text"), F.coalesce(F.col("lang").cast("string"), F.lit("und")).alias("lang"), "doc_id")
    sample = rows.where(F.pmod(F.xxhash64("doc_id"), F.lit(share)) == 0).select("text", "lang")
    rows = rows.select("text", "lang")
    proposed = materialise(_occurrences(sample, list(range(1, longest)), longest).where(F.col("n") >= sampled), "proposed")
    size = 1 << int(np.clip(np.ceil(np.log2(16 * max(1, proposed.count()))), *BITS))
    bits, done, passes = _filters(proposed, longest, size), None, []
    while True:
        want = spark.sparkContext.broadcast(bits)
        levels = list(range(2, longest + 1)) + ([] if passes else [0, 1])
        counts = _occurrences(rows, levels, longest, want, done)
        passes.append(materialise(counts.where((F.col("n") >= least) | (F.col("words") == 0)), "counted"))
        grown = {n: bits[n] | b for n, b in _filters(passes[-1], longest, size).items()}
        if all(np.array_equal(grown[n], bits[n]) for n in bits):
            break
        bits, done = grown, want
    out = passes[0]
    for p in passes[1:]:
        out = out.unionByName(p)
    return out


def _first_per_language(rows: DataFrame, top: int, order: list) -> DataFrame:
    """The first ``top`` rows of each language with their rank; groups of at most some GROUP rows, then groups of their best ones."""
    n, groups = rows.count(), 1
    while n // groups > GROUP:
        groups *= 32
    while groups > 1:
        w = Window.partitionBy("lang", F.pmod(F.xxhash64("phrase"), F.lit(groups))).orderBy(*order)
        rows = rows.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= top).drop("rank")
        groups //= 32
    w = Window.partitionBy("lang").orderBy(*order)
    return rows.withColumn("rank", F.row_number().over(w).cast("long")).where(F.col("rank") <= top)


def collocations(docs: DataFrame, least: int = LEAST, longest: int = LONGEST, top: int = TOP, share: int = SHARE, sampled: int = SAMPLED) -> DataFrame:
    """lang, rank, phrase, a, l, r, n, score: the first ``top`` phrases of each language.

    A candidate is a phrase of 2 to ``longest`` words with ``least`` occurrences
    inside pieces of its language's texts. Its score is the least of
    floor(10^6 a^2 / (l r)) over its cuts, in decimals of 38 digits. It is
    dropped if a longer candidate that holds it has half its occurrences.
    A null text is empty, a null language ``und``; repeated rows and rows without
    an id count like all others; ties go to the more frequent phrase, then to
    the smaller one in bytes; extra columns are not read; an empty table gives no rows.
    """
    counts = materialise(frequent(docs, least, longest, share, sampled), "phrases")
    f = counts.where("words > 0").select("lang", "phrase", F.col("n").alias("f"), "words")
    found = f.where("words > 1").withColumnRenamed("f", "a")
    part = lambda name, to: f.select("lang", F.col("phrase").alias(name), F.col("f").alias(to))
    cuts = (found.select("lang", "phrase", "a", F.explode(F.sequence(F.lit(1), F.col("words") - 1)).alias("k"))
            .withColumn("left", F.expr("substring_index(phrase, ' ', k)"))
            .withColumn("right", F.expr("substring(phrase, length(left) + 2)"))
            .join(part("left", "l"), ["lang", "left"]).join(part("right", "r"), ["lang", "right"]))
    big = lambda c: f"cast({c} as decimal(19, 0))"
    cuts = cuts.withColumn("score", F.expr(f"({big('a')} * {big('a')} * 1000000BD) div ({big('l')} * {big('r')})"))
    best = cuts.groupBy("lang", "phrase", "a").agg(F.min(F.struct("score", "k", "l", "r")).alias("x"))
    spans = [(i, n) for n in range(2, longest) for i in range(1, longest - n + 2)]
    inside = [F.when(F.col("words") > n, F.when(F.lit(i + n - 1) <= F.col("words"), F.array_join(F.slice(F.split("phrase", " ", -1), i, n), " "))) for i, n in spans]
    if inside:
        held = (found.select("lang", "a", F.explode(F.array(*inside)).alias("phrase")).where("phrase is not null")
                .groupBy("lang", "phrase").agg(F.max("a").alias("held")))
        best = best.join(held, ["lang", "phrase"], "left").where("held is null or 100 * held < 50 * a")
    best = materialise(best.select("lang", "phrase", "a", "x.l", "x.r", "x.score"), "scored")
    ranked = _first_per_language(best, top, [F.desc("score"), F.desc("a"), F.asc("phrase")])
    total = counts.where("words = 0").select("lang", "n")
    return ranked.join(total, "lang").select("lang", "rank", "phrase", "a", "l", "r", "n", "score")


def query(spark, sf_dir):
    return collocations(read(spark, sf_dir, "documents"))


SQL = r"""
WITH docs AS (
  SELECT coalesce(lang, 'und') AS lang, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS text FROM documents),
pieces AS (SELECT lang, unnest(regexp_split_to_array(text, '[.,;:!?\x0A-\x0D]')) AS piece FROM docs),
lists AS (SELECT lang, regexp_extract_all(piece, '[^\x20\x09]+') AS w FROM pieces),
places AS (SELECT lang, w, unnest(generate_series(1, len(w))) AS i FROM lists),
grams AS (
  SELECT lang, 1 AS k, w[i] AS phrase FROM places
  UNION ALL SELECT lang, 2, w[i] || ' ' || w[i + 1] FROM places WHERE i + 1 <= len(w)
  UNION ALL SELECT lang, 3, w[i] || ' ' || w[i + 1] || ' ' || w[i + 2] FROM places WHERE i + 2 <= len(w)),
f AS (SELECT lang, k, phrase, count(*)::HUGEINT AS f FROM grams GROUP BY ALL),
totals AS (SELECT lang, sum(f) AS n FROM f WHERE k = 1 GROUP BY lang),
cand AS (SELECT lang, k, phrase, string_split(phrase, ' ') AS w, f AS a FROM f WHERE k >= 2 AND f >= 10),
cuts AS (
  SELECT lang, phrase, a, k, 1 AS cut, w[1] AS lp, array_to_string(w[2:], ' ') AS rp FROM cand
  UNION ALL SELECT lang, phrase, a, k, 2, array_to_string(w[:2], ' '), w[3] FROM cand WHERE k = 3),
scored AS (
  SELECT c.lang, c.phrase, c.k, c.a, cut, x.f AS l, y.f AS r, (1000000 * c.a * c.a) // (x.f * y.f) AS score
  FROM cuts c JOIN f x ON x.lang = c.lang AND x.phrase = c.lp JOIN f y ON y.lang = c.lang AND y.phrase = c.rp),
best AS (SELECT * FROM scored QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, cut) = 1),
inside AS (
  SELECT lang, sub, max(a) AS a FROM (
    SELECT lang, a, w[1] || ' ' || w[2] AS sub FROM cand WHERE k = 3
    UNION ALL SELECT lang, a, w[2] || ' ' || w[3] FROM cand WHERE k = 3) GROUP BY lang, sub),
kept AS (
  SELECT b.* FROM best b LEFT JOIN inside i ON i.lang = b.lang AND i.sub = b.phrase
  WHERE b.k = 3 OR i.a IS NULL OR 100 * i.a < 50 * b.a)
SELECT lang, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank, phrase,
  a::BIGINT AS a, l::BIGINT AS l, r::BIGINT AS r, n::BIGINT AS n, score::BIGINT AS score
FROM kept JOIN totals USING (lang) QUALIFY rank <= 2000
"""
