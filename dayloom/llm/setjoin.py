"""Exact self-join of sets of hashes by Jaccard similarity, on prefixes and token combinations.

A pair with similarity t shares at least t * max(n) tokens, so the first K
shared tokens of any global order lie in the first n - ceil(t n) + K tokens of
both sets (the extended prefixes). Tokens whose list of sets is short are the
rare class: each is an index key of its own. The others are the frequent class:
a pair that shares no rare token shares K frequent ones, and so a frequent
token among the first |f| - K + 1 of both frequent parts, which is where the
K-token combinations begin; only sets with K frequent tokens take part. The
counts of shared tokens must reach K too, so most pairs that only share a
passage are never verified.

Sets with K frequent tokens are few. For them the whole sets are counted again:
m is how many tokens of a set occur in another of these sets, and a pair that
shares no rare token overlaps in min(m) tokens at most. That bound leaves of a
large group of near copies the members that can be similar; they are linked to
the fullest member of each token's list, and only what is then still apart
meets in pairs.

Postings travel as packed arrays, a row for each (task, part). A token that is
frequent inside one task never meets in one part: its postings are spread over
the parts, and only a mark goes to the token's own part.
"""

from __future__ import annotations

import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from dayloom.llm.common import chunks, freed, mix, release
from dayloom.session import materialise

RARE = 32  # the longest list of a rare token
FLUSH = 1 << 18  # postings packed at once in a task, and pairs held at once
BITS = 25  # of the filter on wanted sets

# Of a batch the keys of its sets, each once, their sizes, and their tokens one set after the other, in the order of the prefixes.
Sets = Callable[[pa.RecordBatch], tuple[np.ndarray, np.ndarray, np.ndarray]]

SIGN = 58  # bits of a signature, above the place of the token in its set (63: there or later)
_PLACE, _LAST = np.uint64(6), np.uint64(63)

_U, _I, _N = np.dtype("<u8"), np.dtype("<i8"), np.dtype("<i4")


class Rule:
    """Similarity of at least num / 100, and the lengths that follow from it."""

    def __init__(self, num: int = 75, extra: int = 12, signed: bool = False, rare: int = RARE):
        self.num, self.more, self.signed, self.rare = num, extra, signed, rare

    def least(self, n):
        """ceil(t n): the least overlap of a set of n tokens with a similar one."""
        return (self.num * n + 99) // 100

    def extra(self, n):
        """K for a set of n tokens: it grows with n and never exceeds the least overlap."""
        return np.minimum(self.least(n), np.maximum(self.more, n // 24 if self.more > 1 else 1))

    def prefix(self, n):
        return n - self.least(n) + self.extra(n)

    def shared(self, n):
        """Shared tokens that any similar partner has with a set of n tokens inside the prefixes."""
        return self.extra(self.least(n))

    def shared_sql(self, a: str, b: str):
        def extra(c):
            return F.least(F.expr(f"({self.num} * {c} + 99) div 100"), F.greatest(F.lit(self.more), F.expr(f"{c} div 24") if self.more > 1 else F.lit(1)))
        return F.least(extra(a), extra(b))

    def sizes(self, a, b):
        return 100 * np.minimum(a, b) >= self.num * np.maximum(a, b)

    def near(self, a, b, g, h):
        """Sizes, places of the shared token and signatures that a similar pair can have, if this is its first shared token.

        Each token flips one of SIGN bits of its set's signature, so the bits
        that differ are no more than the tokens that only one of the sets has;
        and the pair shares no more than what follows in either set.
        """
        ok = self.sizes(a, b)
        if self.signed:
            ok &= np.bitwise_count((g ^ h) >> _PLACE).astype(np.int64) * (100 + self.num) <= (100 - self.num) * (a + b)
            rest = np.minimum(a - (g & _LAST).astype(np.int64), b - (h & _LAST).astype(np.int64))
            ok &= rest * (100 + self.num) >= self.num * (a + b)
        return ok

    def similar(self, x: np.ndarray, y: np.ndarray) -> bool:
        if len(x) > len(y):
            x, y = y, x
        if not len(x) or 100 * len(x) < self.num * len(y):
            return False
        at = np.minimum(y.searchsorted(x), len(y) - 1)
        both = int((y[at] == x).sum())
        return 100 * both >= self.num * (len(x) + len(y) - both)


_PACKED = "p int, kind string, t binary, k binary, n binary, g binary"
_JOINED = "kind string, a long, b long, na int, nb int, c int, q int, t binary, k binary, n binary"


def _signed(x: np.ndarray) -> np.ndarray:
    return x.astype(_U).view(_I)


def _count_pairs(a, b, na, nb, c=None):
    """Distinct pairs with a < b and how often each comes, or the sum of ``c``."""
    swap = a > b
    a, b, na, nb = np.where(swap, b, a), np.where(swap, a, b), np.where(swap, nb, na), np.where(swap, na, nb)
    order = np.lexsort((b, a))
    a, b, na, nb = a[order], b[order], na[order], nb[order]
    first = np.ones(len(a), bool)
    first[1:] = (a[1:] != a[:-1]) | (b[1:] != b[:-1])
    at = np.flatnonzero(first)
    count = np.diff(np.append(at, len(a))) if c is None else np.add.reduceat(c[order], at) if len(at) else c[:0]
    return a[at], b[at], na[at], nb[at], count


def _small(batches: Iterator[pa.RecordBatch], limit: int = 1 << 21) -> Iterator[pa.RecordBatch]:
    """Slices with about ``limit`` bytes of text, which stands in the first column."""
    for b in batches:
        yield from chunks(iter([b]), limit, b.schema.names[0])


def postings(rows: DataFrame, sets: Sets, take: Callable[[np.ndarray], np.ndarray], parts: int, bits=None, signed: bool = False, rare: int = RARE) -> DataFrame:
    """Packed postings (token, set key, set size, signature if ``signed``) of the first ``take(size)`` tokens of each set, by part of the token.

    With ``bits`` (a broadcast filter) only of sets that pass it.
    """

    def flush(held, salt):
        tok, many, key, n, g = (np.concatenate(x) for x in zip(*held))
        held.clear()
        of = np.repeat(np.arange(len(key), dtype=np.int32), many)  # a posting has its token, set and place in it; the rest stays with the sets
        place = (np.arange(len(of)) - np.repeat(np.cumsum(many) - many, many)).clip(max=63).astype(np.uint8)
        order = np.lexsort((key[of], tok))
        tok, of, place = tok[order], of[order], place[order]
        new = np.ones(len(tok), bool)
        new[1:] = (tok[1:] != tok[:-1]) | (key[of[1:]] != key[of[:-1]])
        tok, of, place = tok[new], of[new], place[new]

        def pack(p, kind, at):
            x = of[at]
            return p, kind, tok[at].astype(_U).tobytes(), key[x].astype(_I).tobytes(), n[x].astype(_N).tobytes(), (g[x] | place[at]).tobytes() if signed else b""

        def by_part(kind, at):
            part = (tok[at] % np.uint64(parts)).astype(np.int64)
            order = np.lexsort((key[of[at]], part))
            part, at = part[order], at[order]
            cuts = np.flatnonzero(np.append(True, part[1:] != part[:-1])) if len(part) else []
            return [pack(int(part[i]), kind, at[i:j]) for i, j in zip(cuts, [*cuts[1:], len(part)])]

        start = np.flatnonzero(np.append(True, tok[1:] != tok[:-1]))
        many = np.diff(np.append(start, len(tok)))
        hot = np.repeat(many > rare, many)
        out = []
        if hot.any():
            at = np.flatnonzero(hot)
            out.append(pack(salt % parts, "hot", at))
            out += by_part("mark", at[np.append(True, tok[at][1:] != tok[at][:-1])])
        return out + by_part("post", np.flatnonzero(~hot))

    def run(batches: Iterator[pa.RecordBatch]):
        names = ["p", "kind", "t", "k", "n", "g"]
        salt, many, held = TaskContext.get().partitionId() * 7919, 0, []

        def out():
            cols = list(zip(*flush(held, salt)))
            types = [pa.int32(), pa.string(), *[pa.binary()] * 4]
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, types)], names)

        for b in _small(batches):
            k, size, s = sets(b)
            m = take(size) if bits is None else np.where(_passes(bits.value, k), take(size), 0)
            use = np.arange(len(s)) - np.repeat(np.cumsum(size) - size, size) < np.repeat(m, size)
            g = np.zeros(len(k), np.uint64)
            if signed and len(s):
                full = size > 0
                g[full] = np.bitwise_xor.reduceat(np.uint64(1) << (mix(s) % np.uint64(SIGN) + _PLACE), (np.cumsum(size) - size)[full])
            held.append((s[use], m, k, size, g))
            many += len(held[-1][0])
            if many >= FLUSH:
                yield out()
                salt, many, held = salt + 1, 0, []
        if many:
            yield out()
        del held
        release()

    return rows.mapInArrow(run, _PACKED)


def _freed(run: Callable[[pd.DataFrame], pd.DataFrame]) -> Callable[[pd.DataFrame], pd.DataFrame]:
    def part(pdf: pd.DataFrame) -> pd.DataFrame:
        return freed(run, pdf)
    return part


def _unpack(frame: pd.DataFrame):
    return (np.frombuffer(b"".join(frame["t"]), _U), np.frombuffer(b"".join(frame["k"]), _I),
            np.frombuffer(b"".join(frame["n"]), _N).astype(np.int64))


_BLANK = {"a": 0, "b": 0, "na": 0, "nb": 0, "c": 0, "q": 0, "t": None, "k": None, "n": None}
_COLUMNS = [x.split()[0] for x in _JOINED.split(", ")]


def _frame(**columns) -> pd.DataFrame:
    """Rows of the joined schema; whole columns, as a mixed one would turn keys into floats."""
    return pd.DataFrame(_BLANK | columns, index=range(max(len(c) for c in columns.values() if not isinstance(c, (str, int)))))[_COLUMNS]


def _pair_frame(kind, a, b, na, nb, c) -> pd.DataFrame:
    return _frame(kind=kind, a=a, b=b, na=na, nb=nb, c=c)


def match(packed: DataFrame, rule: Rule, parts: int) -> DataFrame:
    """Pairs that share rare tokens with their counts, and the postings of frequent tokens by part of the set."""

    def frequent(tok, key, n) -> pd.DataFrame:
        q = (key % parts).astype(np.int64)
        order = np.argsort(q, kind="stable")
        q, tok, key, n = q[order], tok[order], key[order], n[order]
        at = np.flatnonzero(np.append(True, q[1:] != q[:-1]))
        cuts = list(zip(at, [*at[1:], len(q)]))
        return _frame(kind="frequent", q=q[at], t=[tok[i:j].tobytes() for i, j in cuts],
                      k=[key[i:j].tobytes() for i, j in cuts], n=[n[i:j].astype(_N).tobytes() for i, j in cuts])

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        out = []
        hot = pdf[pdf["kind"] == "hot"]
        for _, row in hot.iterrows():  # one row for each flush of a task
            t, k, n = _unpack(hot.loc[[row.name]])
            out.append(frequent(t, k, n))
        marks = _unpack(pdf[pdf["kind"] == "mark"])
        post = pdf[pdf["kind"] == "post"]
        tok, key, n = _unpack(post)
        g = np.frombuffer(b"".join(post["g"]), _U) if rule.signed else np.zeros(len(tok), _U)
        known = np.unique(marks[0])
        order = np.lexsort((key, tok))
        tok, key, n, g = tok[order], key[order], n[order], g[order]
        if len(tok):
            new = np.ones(len(tok), bool)
            new[1:] = (tok[1:] != tok[:-1]) | (key[1:] != key[:-1])
            tok, key, n, g = tok[new], key[new], n[new], g[new]
            start = np.flatnonzero(np.append(True, tok[1:] != tok[:-1]))
            many = np.diff(np.append(start, len(tok)))
            often = (many > rule.rare) | np.isin(tok[start], known)
            each = np.repeat(often, many)
            if each.any():
                out.append(frequent(tok[each], key[each], n[each]))
            found, held, most = [], 0, FLUSH
            for size in np.unique(many[~often]):
                if size < 2:
                    continue
                i, j = np.triu_indices(int(size), 1)
                runs = start[~often & (many == size)]
                step = max(1, (FLUSH >> 1) // len(i))
                for at in range(0, len(runs), step):
                    x = (runs[at:at + step, None] + i).ravel()
                    y = (runs[at:at + step, None] + j).ravel()
                    use = rule.near(n[x], n[y], g[x], g[y])
                    x, y = x[use], y[use]
                    found.append(_count_pairs(key[x], key[y], n[x], n[y]))
                    held += len(found[-1][0])
                    if held > most:
                        found = [_count_pairs(*(np.concatenate(c) for c in zip(*found)))]
                        held = len(found[0][0])
                        most = max(FLUSH, 2 * held)
            if found:
                out.append(_pair_frame("pair", *_count_pairs(*(np.concatenate(c) for c in zip(*found)))))
        return pd.concat(out, ignore_index=True) if out else _frame(kind="", a=[])

    return packed.groupBy("p").applyInPandas(_freed(run), _JOINED)


def frequent_parts(matched: DataFrame, rule: Rule) -> DataFrame:
    """Per set with frequent tokens their number; of kind 'entry' if K-token combinations are among them."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        tok, key, n = _unpack(pdf)
        order = np.lexsort((tok, key))
        tok, key, n = tok[order], key[order], n[order]
        new = np.ones(len(tok), bool)
        new[1:] = (tok[1:] != tok[:-1]) | (key[1:] != key[:-1])
        tok, key, n = tok[new], key[new], n[new]
        start = np.flatnonzero(np.append(True, key[1:] != key[:-1]))
        many = np.diff(np.append(start, len(key)))
        heads = pd.DataFrame({"kind": "count", "key": key[start], "size": n[start], "f": many})
        return heads.assign(kind=np.where(heads["f"] >= rule.shared(heads["size"].to_numpy()), "entry", "count"))

    return matched.where("kind = 'frequent'").groupBy("q").applyInPandas(_freed(run), "kind string, key long, size int, f int")


def rare_pairs(matched: DataFrame, counts: DataFrame, rule: Rule) -> DataFrame:
    """Pairs whose shared rare tokens, with all frequent ones they could share, reach K."""
    f = counts.select("key", "f")
    pairs = (matched.where("kind = 'pair'").groupBy("a", "b").agg(F.max("na").alias("na"), F.max("nb").alias("nb"), F.sum("c").alias("c"))
             .join(f.select(F.col("key").alias("a"), F.col("f").alias("fa")), "a", "left")
             .join(f.select(F.col("key").alias("b"), F.col("f").alias("fb")), "b", "left")
             .where(F.col("c") + F.least(F.coalesce("fa", F.lit(0)), F.coalesce("fb", F.lit(0))) >= rule.shared_sql("na", "nb")))
    return pairs.select("a", "b")


_ENTRIES = "token long, key long, size int, m int, rest int"


def entries(counts: DataFrame, rows: DataFrame, sets: Sets, rule: Rule) -> DataFrame:
    """(token, key, size, m, rest) of the sets that have K frequent tokens, joined anew among themselves.

    The whole sets are indexed, rarest token first. m counts the tokens that
    occur in another of these sets; the others come first in the order and need
    no entry, so of the prefix of n - ceil(t n) + 1 tokens m - ceil(t n) + 1 stay.
    rest counts the m tokens from this one on: all that a pair can share whose
    first shared token this is.
    """
    keys = counts.where("kind = 'entry'").select("key", "size").distinct()
    total = keys.agg(F.sum("size")).first()[0] or 0
    parts = max(64, total >> 20)
    bits = rows.sparkSession.sparkContext.broadcast(_wanted(keys.select("key")))
    often = np.int64(1 << 30)  # stands for the count of a token that is frequent inside one task
    packed = "q int, t binary, k binary, n binary, d binary"

    def count(pdf: pd.DataFrame) -> pd.DataFrame:
        tok, key, n = _unpack(pdf[pdf["kind"] == "post"])
        order = np.lexsort((key, tok))
        tok, key, n = tok[order], key[order], n[order]
        new = np.append(True, (tok[1:] != tok[:-1]) | (key[1:] != key[:-1]))[:len(tok)]
        tok, key, n = tok[new], key[new], n[new]
        start = np.flatnonzero(np.append(True, tok[1:] != tok[:-1])[:len(tok)])
        many = np.diff(np.append(start, len(tok)))
        df = np.where(np.isin(tok[start], _unpack(pdf[pdf["kind"] == "mark"])[0]), often, many)
        df = np.repeat(df, many)
        hot = _unpack(pdf[pdf["kind"] == "hot"])
        use = df > 1
        tok, key, n = (np.concatenate([x[use], y]) for x, y in zip((tok, key, n), hot))
        df = np.concatenate([df[use], np.full(len(hot[0]), often)])
        q = (key % parts).astype(np.int64)
        order = np.argsort(q, kind="stable")
        q, tok, key, n, df = q[order], tok[order], key[order], n[order].astype(_N), df[order].astype(_N)
        at = np.flatnonzero(np.append(True, q[1:] != q[:-1])[:len(q)])
        cuts = list(zip(at, [*at[1:], len(q)]))
        return pd.DataFrame({"q": q[at], **{c: [x[i:j].tobytes() for i, j in cuts] for c, x in (("t", tok), ("k", key), ("n", n), ("d", df))}})

    def order(pdf: pd.DataFrame) -> pd.DataFrame:
        tok, key, n = _unpack(pdf)
        df = np.frombuffer(b"".join(pdf["d"]), _N)
        at = np.lexsort((tok, df, key))
        tok, key, n = tok[at], key[at], n[at]
        new = np.append(True, (tok[1:] != tok[:-1]) | (key[1:] != key[:-1]))[:len(tok)]
        tok, key, n = tok[new], key[new], n[new]
        start = np.flatnonzero(np.append(True, key[1:] != key[:-1])[:len(key)])
        many = np.diff(np.append(start, len(key)))
        m, place = np.repeat(many, many), np.arange(len(key)) - np.repeat(start, many)
        use = place <= m - rule.least(n)
        return pd.DataFrame({"token": _signed(tok[use]), "key": key[use], "size": n[use], "m": m[use], "rest": (m - place)[use]})

    shared = postings(rows, sets, lambda n: n, parts, bits).groupBy("p").applyInPandas(_freed(count), packed)
    return shared.groupBy("q").applyInPandas(_freed(order), _ENTRIES)


def _partner(rule: Rule, a: str, b: str, m: str = "rest"):
    """The pair can be similar if this is the first token that it shares."""
    o = F.least(F.col(a + m), F.col(b + m))
    return (100 + rule.num) * o >= rule.num * (F.col(a + "size") + F.col(b + "size"))


def _side(e: DataFrame, name: str) -> DataFrame:
    return e.select("token", *[F.col(c).alias(name + c) for c in e.columns if c != "token"])


def star_pairs(index: DataFrame, rule: Rule) -> DataFrame:
    """Each set with the fullest set of each of its tokens: the one whose tokens the others share most."""
    best = index.groupBy("token").agg(F.max_by(F.struct("key", "size", "m", "rest"), F.struct(F.col("m") / F.col("size"), "m", "key")).alias("x"))
    best = best.select("token", F.col("x.key").alias("xkey"), F.col("x.size").alias("xsize"), F.col("x.rest").alias("xrest"))
    return (_side(index, "y").join(best, "token").where("xkey <> ykey").where(_partner(rule, "x", "y"))
            .select(F.least("xkey", "ykey").alias("a"), F.greatest("xkey", "ykey").alias("b")))


def frequent_pairs(index: DataFrame, roots: DataFrame, rule: Rule) -> DataFrame:
    """Pairs of different components that share an entry and whose sizes and m allow them to be similar.

    Inside a token's list the members of its largest component meet only the
    others, and these only in the size bands where a partner of theirs can be.
    """
    band = lambda c: F.floor(F.log(c) * 8).cast("int")  # noqa: E731  13 percent wide
    low, high = F.ceil(F.col("xsize") * (rule.num / 100)), F.floor(F.col("xrest") * ((100 + rule.num) / rule.num) - F.col("xsize"))
    e = (index.join(roots.withColumnRenamed("node", "key"), "key", "left")
         .withColumn("comp", F.coalesce("root", "key")).drop("root"))
    each = e.groupBy("token", "comp").count()
    main = (each.groupBy("token").agg(F.max_by("comp", F.struct("count", "comp")).alias("main"), F.count("*").alias("m_comps"))
            .where("m_comps > 1").select("token", "main"))
    e = e.join(main, "token")
    x = _side(e.where("comp <> main").drop("main"), "x").withColumn("high", F.least(high, F.floor(F.col("xsize") / (rule.num / 100)))).where(F.col("high") >= low)
    x = x.withColumn("band", F.explode(F.sequence(band(low) - 1, band(F.col("high")) + 1)))
    y = _side(e, "y").withColumn("band", band(F.col("ysize")))
    return (x.join(y, ["token", "band"]).where("xcomp <> ycomp and (ycomp = ymain or xkey < ykey)")
            .where(rule.num * F.greatest("xsize", "ysize") <= 100 * F.least("xsize", "ysize")).where(_partner(rule, "x", "y"))
            .select(F.least("xkey", "ykey").alias("a"), F.greatest("xkey", "ykey").alias("b")).distinct())


_MASK = (1 << BITS) - 1


def _passes(packed: bytes, key: np.ndarray) -> np.ndarray:
    at = key & _MASK
    return (np.frombuffer(packed, np.uint8)[at >> 3] >> (7 - (at & 7)).astype(np.uint8)) & np.uint8(1) > 0


def _wanted(keys: DataFrame) -> bytes:
    """Bit filter of the keys in all columns: 2^BITS bits at most 16 times, whatever their number."""

    def run(batches):
        bits = np.zeros(1 << BITS, bool)
        for b in batches:
            for c in b.columns:
                bits[c.to_numpy(zero_copy_only=False) & _MASK] = True
        yield pa.RecordBatch.from_arrays([pa.array([zlib.compress(np.packbits(bits).tobytes(), 1)])], ["bits"])

    total = np.zeros(1 << (BITS - 3), np.uint8)
    for row in keys.coalesce(16).mapInArrow(run, "bits binary").toLocalIterator():
        total |= np.frombuffer(zlib.decompress(row.bits), np.uint8)
    return total.tobytes()


def chosen(keys: DataFrame, rows: DataFrame, sets: Sets, docs: DataFrame | None = None) -> DataFrame:
    """(key, s): the sorted tokens of the sets whose keys stand in the columns of ``keys``, and of few others.

    ``docs`` names in its columns values of the second column of ``rows``: the rows in which all these sets occur.
    """
    sc = rows.sparkSession.sparkContext
    bits = sc.broadcast(_wanted(keys))
    only = None if docs is None else sc.broadcast(_wanted(docs))

    def held(batches):
        for b in batches:
            yield b if only is None else b.filter(pa.array(_passes(only.value, b.column(1).to_numpy(zero_copy_only=False))))

    def pick(batches):
        for b in _small(held(batches)):
            k, size, s = sets(b)
            end = np.cumsum(size)
            got = np.flatnonzero(_passes(bits.value, k))
            if len(got):
                packed = [np.sort(s[end[i] - size[i]:end[i]]).tobytes() for i in got]
                yield pa.RecordBatch.from_arrays([pa.array(k[got], pa.int64()), pa.array(packed, pa.binary())], ["key", "s"])
        release()

    return rows.mapInArrow(pick, "key long, s binary").dropDuplicates(["key"])


def verify(pairs: DataFrame, have: DataFrame, rule: Rule, per_cell: int = 20_000) -> DataFrame:
    """The pairs (a, b) whose whole sets, taken from ``have``, are similar.

    Pairs fall into cells by the hash buckets of both sides; a set goes once to
    each cell that needs it, not once to each pair.
    """
    n = pairs.count()
    side = max(8, int(np.ceil(np.sqrt(n / per_cell))))
    cell = lambda: (F.pmod("a", F.lit(side)) * side + F.pmod("b", F.lit(side))).alias("cell")
    placed = pairs.select(F.explode(F.array("a", "b")).alias("key"), cell()).distinct()
    placed = placed.join(have, "key").select("cell", "key", "s")

    def test(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        s = {k: np.frombuffer(x, _U) for k, x in zip(right["key"], right["s"])}
        ok = [rule.similar(s[a], s[b]) for a, b in zip(left["a"], left["b"])]
        return left.loc[np.array(ok, bool), ["a", "b"]]

    def part(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        return freed(test, left, right)

    return pairs.select("a", "b", cell()).groupBy("cell").cogroup(placed.groupBy("cell")).applyInPandas(part, "a long, b long")


def links(rows: DataFrame, sets: Sets, rule: Rule, total: int, components) -> DataFrame:
    """Edges (a, b) of similar sets: as many as keep every component whole."""
    parts = max(64, total // (1 << 21))
    matched = materialise(match(postings(rows, sets, rule.prefix, parts, signed=rule.signed, rare=rule.rare), rule, parts), "matched")
    counts = materialise(frequent_parts(matched, rule), "frequent")
    index = materialise(entries(counts, rows, sets, rule), "entries")
    first = materialise(rare_pairs(matched, counts, rule).unionByName(star_pairs(index, rule)).distinct(), "pairs")
    found = materialise(verify(first, chosen(first.select("a", "b"), rows, sets), rule), "links")
    more = materialise(frequent_pairs(index, components(found), rule).join(first, ["a", "b"], "left_anti"), "pairs")
    if more.isEmpty():
        return found
    return found.unionByName(materialise(verify(more, chosen(more.select("a", "b"), rows, sets), rule), "links"))
