"""Language identification: whole words first, then shorter and shorter character n-grams (operator 11)."""

from __future__ import annotations

import re
import sys
from collections import Counter, defaultdict
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from dayloom.llm.common import read
from dayloom.session import materialise

ORDERS = (5, 4, 3, 2, 1)  # lengths of the n-grams, in the order in which they are tried
WORDS, GRAMS = 200_000, 50_000  # entries of the model: words, and n-grams of each length, all languages together
LACKING = 7.0  # score of a word or n-gram that a language lacks, as a negative decimal logarithm
PIECE = 40  # letters; longer runs are read in pieces of so many
CHUNK = 1 << 20  # characters worked on at once
MEMO = 100_000  # words of a language that a task counts before it passes them on; words beyond the model whose scores a worker remembers
LANGS = 8  # languages whose words a task counts side by side
UNKNOWN = "und"

_COUNTED = "lang string, size int, entry string, n long"


def _not_letters() -> str:
    """Characters that count as alphanumeric but are neither letters nor decimal digits, as ranges of a character class."""
    odd = [c for c in range(sys.maxunicode + 1) if chr(c).isalnum() and not chr(c).isalpha() and not chr(c).isdecimal()]
    starts = [c for i, c in enumerate(odd) if not i or odd[i - 1] != c - 1]
    ends = [c for i, c in enumerate(odd) if i + 1 == len(odd) or odd[i + 1] != c + 1]
    return "".join(f"{re.escape(chr(a))}-{re.escape(chr(b))}" for a, b in zip(starts, ends))


_PLAIN = re.compile(rf"[^\W\d_]{{1,{PIECE}}}")
_EXACT: list[re.Pattern] = []


def _found(text: str, at: int, to: int) -> list[str]:
    got = _PLAIN.findall(text, at, to)
    if got and not "".join(got).isalpha():  # a fraction, a raised digit or the like
        if not _EXACT:
            _EXACT.append(re.compile(rf"[^\W\d_{_not_letters()}]{{1,{PIECE}}}"))
        got = _EXACT[0].findall(text, at, to)
    return got


def words(text: str) -> Iterator[list[str]]:
    """The words of a text in lower case, some CHUNK characters at a time: runs of letters, in pieces of at most PIECE."""
    text, at = text.lower(), 0
    while at < len(text):
        to = min(len(text), at + CHUNK)
        while to < len(text) and text[to].isalpha() and to < at + 2 * CHUNK:
            to += 1
        if to < len(text) and text[to].isalpha():  # a cut inside a run falls where a piece ends
            start = to
            while start > at and text[start - 1].isalpha():
                start -= 1
            to = start + (to - start) // PIECE * PIECE
        yield _found(text, at, to)
        at = to


def grams(word: str, n: int) -> list[str]:
    """The n-grams of a word between two blanks; of one character those of the word alone."""
    padded = f" {word} " if n > 1 else word
    return [padded[i:i + n] for i in range(len(padded) - n + 1)]


def held_out(doc_id="doc_id"):
    """Rows whose CRC-32 of the id as text leaves 2 by 4; a null id is held out too."""
    return F.coalesce(F.pmod(F.crc32(F.col(doc_id).cast("string").cast("binary")), F.lit(4)) == 2, F.lit(True))


def _cells(batches: Iterator[pa.RecordBatch], columns: int) -> Iterator[tuple]:
    """The rows of the batches, some at a time, so that few texts are decoded together."""
    for b in batches:
        for at in range(0, b.num_rows, 64):
            part = b.slice(at, 64)
            yield from zip(*[part.column(i).to_pylist() for i in range(columns)])


def counts(docs: DataFrame) -> DataFrame:
    """lang, size, entry, n: how often each word (size 0) and n-gram stands in the texts of each language.

    All rows that are not held out and have a language count. The words are
    counted first; the n-grams come from the counted words, each as often as its word.
    """

    def count(batches):
        held: dict[str, Counter] = {}

        def out(lang):
            own = held.pop(lang)
            return pa.RecordBatch.from_arrays(
                [pa.array([lang] * len(own), pa.string()), pa.array(np.zeros(len(own), np.int32)), pa.array(list(own), pa.string()),
                 pa.array(list(own.values()), pa.int64())], ["lang", "size", "entry", "n"])

        for text, lang in _cells(batches, 2):
            for some in words(text):
                held.setdefault(lang, Counter()).update(some)
                if len(held[lang]) > MEMO:
                    yield out(lang)
            if len(held) > LANGS:
                yield from [out(x) for x in list(held)]
        yield from [out(x) for x in list(held)]

    def split(batches):
        for b in batches:
            for at in range(0, b.num_rows, 4096):
                got: dict[tuple, Counter] = defaultdict(Counter)
                for lang, word, n in zip(*(b.slice(at, 4096).column(i).to_pylist() for i in range(3))):
                    for size in ORDERS:
                        if n == 1:
                            got[lang, size].update(grams(word, size))
                        else:
                            own = got[lang, size]
                            for g in grams(word, size):
                                own[g] += n
                for (lang, size), own in got.items():
                    yield pa.RecordBatch.from_arrays(
                        [pa.array([lang] * len(own), pa.string()), pa.array(np.full(len(own), size, np.int32)), pa.array(list(own), pa.string()), pa.array(list(own.values()), pa.int64())],
                        ["lang", "size", "entry", "n"])

    rows = docs.where(~held_out() & F.col("text").isNotNull() & F.col("lang").isNotNull()).select("text", F.col("lang").cast("string").alias("lang"))
    total = lambda d: d.groupBy("lang", "size", "entry").agg(F.sum("n").alias("n"))
    whole = materialise(total(rows.mapInArrow(count, _COUNTED)), "words")
    return whole.unionByName(total(whole.select("lang", "entry", "n").mapInArrow(split, _COUNTED)))


def _commonest(counted: DataFrame, langs: int, words: int, grams: int) -> DataFrame:
    """The entries of each language and size that are commonest: whole classes of like counts, as many as fit.

    The classes are sixteenths of an octave, so a language and size has some
    hundreds of them, whatever the number of entries.
    """
    entry = counted.withColumn("class", F.floor(F.log2("n") * 16).cast("int"))
    room = F.when(F.col("size") == 0, F.lit(words // langs)).otherwise(F.lit(grams // langs))
    w = Window.partitionBy("lang", "size").orderBy(F.desc("class"))
    least = (entry.groupBy("lang", "size", "class").count().withColumn("upto", F.sum("count").over(w)).where(F.col("upto") <= room)
             .groupBy("lang", "size").agg(F.min("class").alias("least")))
    return entry.join(F.broadcast(least), ["lang", "size"]).where("class >= least").select("lang", "size", "entry", "n")


class Model:
    """Scores of words and n-grams: negative decimal logarithms of their shares in each language, LACKING where it has none."""

    def __init__(self, table: pd.DataFrame):
        self.langs = sorted(table["lang"].unique())
        self.entries: dict[int, dict[str, int]] = {}
        self.rows: dict[int, np.ndarray] = {}
        at = {x: i for i, x in enumerate(self.langs)}
        for size, part in table.groupby("size"):
            share = part["n"] / part.groupby("lang")["n"].transform("sum")
            names = sorted(part["entry"].unique())
            own = {x: i for i, x in enumerate(names)}
            rows = np.full((len(names), len(self.langs)), LACKING, np.float32)
            rows[part["entry"].map(own).to_numpy(), part["lang"].map(at).to_numpy()] = np.minimum(LACKING, -np.log10(share.to_numpy()))
            self.entries[int(size)], self.rows[int(size)] = own, rows
        self.width = len(self.langs)
        self._forget()

    def _forget(self):
        self.memo = dict(self.entries.get(0, {}))
        own = self.rows.get(0, np.zeros((0, self.width), np.float32))
        self.known = np.vstack([own, np.zeros((1024, self.width), np.float32)])

    def __getstate__(self):
        return {k: v for k, v in self.__dict__.items() if k not in ("memo", "known")}

    def __setstate__(self, state):
        self.__dict__.update(state)
        self._forget()

    def unseen(self, w: str) -> np.ndarray:
        """The mean of a word's longest n-grams of which the model has any; else LACKING for all."""
        for n in ORDERS:
            own = self.entries.get(n, {})
            found = [own[g] for g in grams(w, n) if g in own]
            if found:
                return self.rows[n][found].sum(0) / len(found)
        return np.full(self.width, LACKING, np.float32)

    def _places(self, some: list[str]) -> np.ndarray:
        """The row of each word: of the model if it knows the word, else one made from its n-grams."""
        if len(self.memo) > len(self.entries.get(0, {})) + MEMO:
            self._forget()
        memo = self.memo
        for w in {w for w in some if w not in memo}:
            if len(memo) == len(self.known):
                self.known = np.vstack([self.known, np.zeros_like(self.known)])
            self.known[len(memo)] = self.unseen(w)
            memo[w] = len(memo)
        return np.fromiter(map(memo.__getitem__, some), np.int64, len(some))

    def predict(self, text: str | None) -> tuple[str, float]:
        """The language with the least mean score of its words, and how clearly it is ahead of the others."""
        total, n = np.zeros(len(self.langs)), 0
        for some in words(text or ""):
            at, many = np.unique(self._places(some), return_counts=True)
            total += many @ self.known[at].astype(np.float64)
            n += len(some)
        if not n or not self.langs:
            return UNKNOWN, 0.0
        mean = np.round(total / n, 9)
        best = int(np.argmin(mean))
        # Likelihood ratios of as many independent words as the root of their number.
        weight = 10.0 ** (-(mean - mean[best]) * np.sqrt(n))
        return self.langs[best], round(float(1 / weight.sum()), 6)


def train(docs: DataFrame, words: int = WORDS, grams: int = GRAMS) -> Model:
    """Model of the languages of all rows that are not held out.

    Counts come from all these rows. The model holds, of all languages together,
    at most ``words`` words and ``grams`` n-grams of each length, the commonest
    ones of each language; what it lacks is scored by shorter n-grams.
    """
    counted = materialise(counts(docs), "counts")
    langs = counted.where("size = 0").agg(F.count_distinct("lang")).first()[0]
    table = _commonest(counted, max(1, langs), words, grams)
    parts = table.groupBy("size").agg(F.count("*"))  # a row for each length
    assert sum(r[1] for r in parts.collect()) <= words + grams * len(ORDERS)
    rows = [tuple(r) for r in table.toLocalIterator()]  # at most words + grams x len(ORDERS)
    return Model(pd.DataFrame(rows, columns=["lang", "size", "entry", "n"]))


def predict(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, held_out, lang_pred, score for each row, from its whole text.

    A null text or one without letters is ``und`` with score 0, and so is every
    text if nothing was learned. Ties go to the first language by name; repeated
    rows get equal results; extra columns are not read.
    """
    kept = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        for b in batches:
            for at in range(0, b.num_rows, 64):
                part = b.slice(at, 64)
                got = [kept.value.predict(t) for t in part.column(1).to_pylist()]
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array([x[0] for x in got], pa.string()), pa.array([x[1] for x in got])], ["doc_id", "lang_pred", "score"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    out = docs.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, lang_pred string, score double")
    return out.select("doc_id", held_out().alias("held_out"), "lang_pred", "score")


def query(spark, sf_dir):
    docs = read(spark, sf_dir, "documents")
    return predict(docs, train(docs))
