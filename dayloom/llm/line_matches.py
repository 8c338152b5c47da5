"""Which sets of line tokens an earlier set is similar to: prefix lists in order of place, one witness sought for each set.

A posting carries the set's size, signature and earliest place, so a list
knows the earlier sets that a set can be similar to before anything is
written. A list is sorted by size: of each set only the window is looked at whose
sizes its place in the set allows. Larger sets have longer signatures, as those of
one word agree by chance. Only the CLOSE nearest of the sets that are left leave
the part. Long lists are settled in turns: a set meets the few earliest sets of
the list first, and only what finds no partner meets more. The scan that writes
the postings writes the places of all lines too.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from dayloom.llm import setjoin
from dayloom.llm.common import CHUNK, Texts, chunks, freed, mix, release
from dayloom.session import materialise

CLOSE, CLOSEST = 8, 2  # earlier sets of a part, of a long list's block, that a set can be compared with before all are
DOUBT = 32  # times as many where the nearest one is far
SHORT = 4096  # the longest list that is settled where it is gathered
WIDE = (64, 144, 288)  # sizes of sets above which a signature has two words, four, eight
PAIRS = 1 << 18  # pairs of a window looked at once
TURNS = (2, 32, None)  # members of a long list, from its beginning, that the others meet; None: all
BLOCK = 4096  # sets on each side of a meeting
FLUSH = 1 << 15  # lines packed at once in a task

_COLS = ("t", "k", "n", "g", "d", "l")  # token, set, size, signature, and the place: document, line (then the set)
_KINDS = dict(zip(_COLS, ("<u8", "<i8", "<i4", "<u8", "<i8", "<i4")))
_PACKED = "p int, kind string, " + ", ".join(f"{c} binary" for c in (*_COLS, "w"))
_PLACED = dict(zip(("k", "d", "g", "l"), ("set", "doc", "key", "at")))  # columns of the packed rows of kind 'line' and 'late'
_ROWS = "kind string, a long, b long, da long, db long, more boolean, t long, k long, n int, g long, d long, l int, p int, set binary, doc binary, key binary, at binary"
_BLANK = {"kind": "", "a": 0, "b": 0, "da": 0, "db": 0, "more": False, "t": 0, "k": 0, "n": 0, "g": 0, "d": 0, "l": 0,
          "p": 0, "set": None, "doc": None, "key": None, "at": None}


def _plain(a: np.ndarray, kind: str) -> bytes:
    """Bytes of like weight together: most are equal, so shuffle files compress them."""
    a = np.ascontiguousarray(a.astype(kind))
    return a.view(np.uint8).reshape(-1, a.itemsize).T.tobytes()


def _array(cells, kind: str) -> np.ndarray:
    width = np.dtype(kind).itemsize
    parts = [np.ascontiguousarray(np.frombuffer(c, np.uint8).reshape(width, -1).T).view(kind).ravel() for c in cells]
    return np.concatenate([*parts, np.zeros(0, kind)])


def _load(pdf: pd.DataFrame) -> dict[str, np.ndarray]:
    """The columns of packed postings; w: seven words, zero where a signature is shorter."""
    cols = {c: _array(pdf[c], kind) for c, kind in _KINDS.items()}
    more = _more_words(cols["n"])
    cols["w"] = np.zeros((len(more), 7), np.uint64)
    cols["w"][np.arange(7) < more[:, None]] = _array(pdf["w"], "<u8")
    return cols


def _pick(cols: dict, at) -> dict:
    return {c: a[at] for c, a in cols.items()}


def _runs(a: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    start = np.flatnonzero(np.append(True, a[1:] != a[:-1])[:len(a)])
    return start, np.diff(np.append(start, len(a)))


def _more_words(n: np.ndarray) -> np.ndarray:
    """Words that the signature of a set of n tokens has beyond the first."""
    return (1 << np.searchsorted(WIDE, n).astype(np.int64)) - 1


def _signatures(tok: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of each set the signature of one word, and the words that a longer one has beyond its first.

    A token flips one bit of one word. The xor of all words is the signature
    of one word, so the first word need not be kept; and half as many words
    come of the xor of the first half of them with the second.
    """
    h = mix(tok)
    bit = np.uint64(1) << (h % np.uint64(setjoin.SIGN) + np.uint64(6))
    g = np.bitwise_xor.reduceat(bit, np.cumsum(n) - n)
    more = _more_words(n)
    w = np.zeros((len(n), 7), np.uint64)
    use = np.repeat(more > 0, n)
    if use.any():
        word, bit, start = h[use] >> np.uint64(61), bit[use], np.cumsum(n[more > 0]) - n[more > 0]
        for i in range(7):
            w[more > 0, i] = np.bitwise_xor.reduceat(np.where(word == i + 1, bit, np.uint64(0)), start)
        for half in (4, 2):
            short = np.flatnonzero(more < 2 * half - 1)
            w[short, :half - 1] ^= w[short, half:2 * half - 1]
            w[short, half - 1:] = 0
    return g, w


def _apart(cols: dict, x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Bits that differ between the longest signatures that both sets have: no more than the tokens that only one of them has."""
    g = (cols["g"][x] ^ cols["g"][y]) >> np.uint64(6) << np.uint64(6)
    out = np.bitwise_count(g).astype(np.int64)
    both = _more_words(np.minimum(cols["n"][x], cols["n"][y]))
    for more in (1, 3, 7):
        at = np.flatnonzero(both == more)
        if len(at):
            w = cols["w"][x[at]] ^ cols["w"][y[at]]
            w = np.column_stack([g[at] ^ np.bitwise_xor.reduce(w, axis=1), w])
            while w.shape[1] > more + 1:
                w = w[:, :w.shape[1] // 2] ^ w[:, w.shape[1] // 2:]
            out[at] = np.bitwise_count(w).astype(np.int64).sum(axis=1)
    return out


def _postings(keyed: DataFrame, line_sets: Callable, rule: setjoin.Rule, parts: int, place_rows: Callable | None = None, wanted=None) -> DataFrame:
    """Packed postings of the prefixes; of tokens with long lists inside a task the postings are spread and only a mark goes to the token's part.

    With ``place_rows`` the packed places of all lines too, as that function makes them; with ``wanted`` (a broadcast filter) only of tokens that pass it.
    """

    def read(k, n, d, l, tok):
        """Of each set of a chunk its first line, signature, and the tokens of its prefix that are wanted with their places."""
        order = np.lexsort((k, l, d))
        order = order[np.sort(np.unique(k[order], return_index=True)[1])]
        start = (np.cumsum(n) - n)[order]
        k, n, d, l = k[order], n[order], d[order], l[order]
        full = np.arange(int(n.sum())) + np.repeat(start - np.cumsum(n) + n, n)
        sign, wide = _signatures(tok[full], n)
        m = rule.prefix(n)
        place = np.arange(int(m.sum())) - np.repeat(np.cumsum(m) - m, m)
        t = tok[np.repeat(start, m) + place]
        if wanted is not None:
            use = setjoin._passes(wanted.value, t.view(np.int64))
            m = np.bincount(np.repeat(np.arange(len(m)), m)[use], minlength=len(m))
            t, place = t[use], place[use]
        return k, n, d, l, sign, wide, m, t, place.clip(max=63).astype(np.uint8)

    def flush(held, lines, salt):
        rows = [] if place_rows is None else [(p, kind, b"", s, b"", x, doc, at, b"") for p, kind, s, doc, x, at in place_rows(lines, parts)]
        k, n, d, l, sign, wide, m, t, place = (np.concatenate(h) for h in zip(*held))
        held.clear()
        order = np.lexsort((k, l, d))
        one = np.zeros(len(k), bool)
        one[order[np.unique(k[order], return_index=True)[1]]] = True  # the first line of each set
        of = np.repeat(np.arange(len(k), dtype=np.int32), m)  # a posting has its token, set and place in it; the rest stays with the sets
        at = np.flatnonzero(one[of])
        at = at[np.lexsort((l[of[at]], d[of[at]], t[at]))]
        t, of, place = t[at], of[at], place[at]

        def cells(at):
            x = of[at]
            cols = {"t": t[at], "k": k[x], "n": n[x], "g": sign[x] | place[at], "d": d[x], "l": l[x]}
            more = np.arange(7) < _more_words(cols["n"])[:, None]
            return *[_plain(cols[c], _KINDS[c]) for c in _COLS], _plain(wide[x][more], "<u8")

        def by_part(kind, at):
            part = (t[at] % np.uint64(parts)).astype(np.int64)
            order = np.argsort(part, kind="stable")
            at, part = at[order], part[order]
            start, many = _runs(part)
            return [(int(part[i]), kind, *cells(at[i:i + m])) for i, m in zip(start, many)]

        first, many = _runs(t)
        hot = np.repeat(many > SHORT, many)
        if hot.any():
            rows.append((salt % parts, "hot", *cells(np.flatnonzero(hot))))
            rows += by_part("mark", first[many > SHORT])
        rows += by_part("post", np.flatnonzero(~hot))
        types = [pa.int32(), pa.string(), *[pa.binary()] * (len(_COLS) + 1)]
        columns = list(zip(*rows)) or [()] * len(types)
        return pa.RecordBatch.from_arrays([pa.array(c, kind) for c, kind in zip(columns, types)], ["p", "kind", *_COLS, "w"])

    def run(batches):
        held, placed, lines, salt = [], [], 0, TaskContext.get().partitionId() * 7919
        for b in chunks(batches, CHUNK, "_text"):
            k, n, tok, row, number = line_sets(Texts(b.column(0)))
            if not len(k):
                continue
            d, key = (b.column(c).to_numpy(zero_copy_only=False)[row] for c in (1, 2))
            held.append(read(k, n, d, number, tok))
            placed.append((k, d, key, number))
            lines += len(k)
            if lines >= FLUSH:
                yield flush(held, placed, salt)
                held, placed, lines, salt = [], [], 0, salt + 1
        if lines:
            yield flush(held, placed, salt)
        del held, placed
        release()

    return keyed.select("_text", "_rank", "_key").mapInArrow(run, _PACKED)


def _frame(**columns) -> pd.DataFrame:
    size = max(len(c) for c in columns.values() if isinstance(c, np.ndarray))
    return pd.DataFrame(_BLANK | columns, index=range(size))[list(_BLANK)]


def _closest(later, earlier, far, close: int | None):
    """Of each later set the ``close`` nearest earlier ones (None: all), and whether it has more."""
    order = np.lexsort((earlier, far, later))
    later, earlier, far = later[order], earlier[order], far[order]
    start, many = _runs(later)
    rank = np.arange(len(later)) - np.repeat(start, many)
    if close is None:
        return later, earlier, far, np.zeros(len(later), bool)
    use = rank < close
    return later[use], earlier[use], far[use], np.repeat(many > close, many)[use]


def _far(g, h):
    return np.bitwise_count((g ^ h) >> np.uint64(6)).astype(np.int64)


def _near(found: list, close: int | None, size: np.ndarray, rule: setjoin.Rule) -> tuple[np.ndarray, ...]:
    """Of pairs (later, earlier, far, more) each once, and of each later set the ``close`` nearest (None: all); more: it has others.

    Where the nearest one differs in more than half of the bits allowed, DOUBT times as many.
    """
    later, earlier, far, more = (np.concatenate(c) for c in zip(*found))
    order = np.lexsort((earlier, far, later))
    some = np.unique(later[more])
    later, earlier, far = later[order], earlier[order], far[order]
    new = np.append(True, (later[1:] != later[:-1]) | (earlier[1:] != earlier[:-1]))[:len(later)]
    later, earlier, far = later[new], earlier[new], far[new]
    start, many = _runs(later)
    use = np.ones(len(later), bool)
    more = np.isin(later, some)
    if close is not None:
        doubt = 2 * far[start] * (100 + rule.num) > (100 - rule.num) * (size[later[start]] + size[earlier[start]])
        most = np.where(doubt, DOUBT * close, close)
        use = np.arange(len(later)) - np.repeat(start, many) < np.repeat(most, many)
        more |= np.repeat(many > most, many)
    return later[use], earlier[use], far[use], more[use]


def _windows(cols: dict, rule: setjoin.Rule, close: int | None, want: np.ndarray | None) -> tuple[np.ndarray, ...]:
    """Rows (of a later set, of an earlier one, more) of the pairs that can be similar, of postings in the order of token and size."""
    t, n, g = cols["t"], cols["n"].astype(np.int64), cols["g"]
    order = np.lexsort((cols["k"], cols["l"], cols["d"]))
    new = np.append(True, np.any([cols[c][order][1:] != cols[c][order][:-1] for c in ("k", "l", "d")], axis=0))[:len(order)]
    node = np.empty(len(order), np.int64)  # the sets in the order of their places
    node[order] = np.cumsum(new) - 1
    row = order[new]  # a posting of each set
    here = np.cumsum(np.append(False, t[1:] != t[:-1])[:len(t)]) << 32
    low = np.searchsorted(here | n, here | rule.least(n))
    most = (100 + rule.num) * (n - (g & np.uint64(63)).astype(np.int64)) // rule.num - n
    high = np.where(most >= n, np.arange(len(n)), np.searchsorted(here | n, here | np.maximum(0, np.minimum(most, n)), side="right"))
    many = np.maximum(0, high - low)
    total = np.append(0, np.cumsum(many))
    found, held, at = [], 0, 0
    while at < len(many):
        to = max(at + 1, int(np.searchsorted(total, total[at] + PAIRS, side="right")) - 1)
        x = np.repeat(np.arange(at, to), many[at:to])
        y = np.arange(len(x)) + np.repeat(low[at:to] - total[at:to] + total[at], many[at:to])
        at = to
        use = rule.near(n[x], n[y], g[x], g[y])
        x, y = x[use], y[use]
        far = _apart(cols, x, y)
        use = far * (100 + rule.num) <= (100 - rule.num) * (n[x] + n[y])
        later, earlier, far = np.maximum(node[x], node[y])[use], np.minimum(node[x], node[y])[use], far[use]
        if want is not None:
            use = want[row[later]]
            later, earlier, far = later[use], earlier[use], far[use]
        if len(later):
            found.append((later, earlier, far, np.zeros(len(later), bool)))
            held += len(later)
        if held > 4 * PAIRS:
            found = [_near(found, close, n[row], rule)]
            held = 0
    if not found:
        return (np.zeros(0, np.int64),) * 2 + (np.zeros(0, bool),)
    later, earlier, _, more = _near(found, close, n[row], rule)
    return row[later], row[earlier], more


def _gather(packed: DataFrame, rule: setjoin.Rule, close: int | None, bits=None, settle: Callable | None = None) -> DataFrame:
    """Rows of kind 'pair' (a, an earlier b, their documents, more) of short lists, and of kind 'hot': the postings of long ones.

    With ``bits`` (a broadcast filter) only the pairs of sets a that pass it; with ``settle`` the places of that function too.
    """

    def hot(cols) -> pd.DataFrame:
        return _frame(kind="hot", **{c: cols[c].view(np.int64) if cols[c].dtype == np.uint64 else cols[c] for c in _COLS})

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        out = []
        if settle is not None:
            placed = settle(pdf.loc[pdf["kind"].isin(["line", "late"]), ["kind", *_PLACED]].rename(columns=_PLACED))
            out.append(_frame(**{c: placed[c].to_numpy() for c in placed}))
        if bits is None:
            for i in np.flatnonzero((pdf["kind"] == "hot").to_numpy()):
                out.append(hot(_load(pdf.iloc[i:i + 1])))
        marked = np.unique(_array(pdf.loc[pdf["kind"] == "mark", "t"], "<u8"))
        cols = _load(pdf[pdf["kind"] == "post"])
        order = np.lexsort((cols["l"], cols["d"], cols["k"], cols["t"]))
        t, k = cols["t"][order], cols["k"][order]
        cols = _pick(cols, order[np.append(True, (t[1:] != t[:-1]) | (k[1:] != k[:-1]))[:len(t)]])  # the earliest place of each set
        cols = _pick(cols, np.lexsort((cols["k"], cols["n"], cols["t"])))
        start, many = _runs(cols["t"])
        often = (many > SHORT) | np.isin(cols["t"][start], marked)
        each = np.repeat(often, many)
        if each.any() and bits is None:
            out.append(hot(_pick(cols, np.flatnonzero(each))))
        cols = _pick(cols, np.flatnonzero(~each & np.repeat(many > 1, many)))
        later, earlier, more = _windows(cols, rule, close, None if bits is None else setjoin._passes(bits.value, cols["k"]))
        if len(later):
            k, d = cols["k"], cols["d"]
            out.append(_frame(kind="pair", a=k[later], b=k[earlier], da=d[later], db=d[earlier], more=more))
        return pd.concat(out, ignore_index=True) if out else _frame(kind="", a=np.zeros(0, np.int64))

    def part(pdf: pd.DataFrame) -> pd.DataFrame:
        return freed(run, pdf)

    return packed.groupBy("p").applyInPandas(part, _ROWS)


def _meet(hot: DataFrame, late: DataFrame, rule: setjoin.Rule, first: int | None, close: int | None) -> DataFrame:
    """Pairs (a, an earlier b, far, more) of the sets of long lists that are not ``late`` with the ``first`` sets of their lists.

    Both sides are cut into blocks by a hash, so a list of any length is spread.
    """
    place = [F.col(c) for c in ("d", "l", "k")]
    x = hot.join(late.select(F.col("node").alias("k")), "k", "left_anti")
    if first is None:
        y = hot
    else:  # first is small: each task passes on so many of a list at most
        y = hot.withColumn("r", F.row_number().over(Window.partitionBy("t").orderBy(*place))).where(F.col("r") <= first).drop("r")
    count = lambda d, name: d.groupBy("t").agg(F.ceil(F.count("*") / BLOCK).cast("int").alias(name))
    many = materialise(count(x, "xs").join(count(y, "ys"), "t"), "lists")
    block = lambda to: F.pmod(F.xxhash64("k"), F.col(to)).cast("int")
    x = x.join(many, "t").withColumn("i", block("xs")).withColumn("j", F.explode(F.sequence(F.lit(0), F.col("ys") - 1)))
    y = y.join(many, "t").withColumn("j", block("ys")).withColumn("i", F.explode(F.sequence(F.lit(0), F.col("xs") - 1)))
    y = y.toDF(*y.columns)  # both sides come from the same table: columns of its own

    def run(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        out = []
        if len(left) and len(right):
            y = {c: right[c].to_numpy() for c in _COLS}
            ny, gy = y["n"].astype(np.int64), y["g"].view(np.uint64)
            for at in range(0, len(left), 256):
                x = {c: left[c].to_numpy()[at:at + 256] for c in _COLS}
                earlier = y["d"] < x["d"][:, None]
                same = y["d"] == x["d"][:, None]
                if same.any():
                    earlier |= same & ((y["l"] < x["l"][:, None]) | ((y["l"] == x["l"][:, None]) & (y["k"] < x["k"][:, None])))
                use = earlier & rule.near(x["n"].astype(np.int64)[:, None], ny[None, :], x["g"].view(np.uint64)[:, None], gy[None, :])
                i, j = np.nonzero(use)
                if len(i):
                    i, j, far, more = _closest(i, j, _far(x["g"].view(np.uint64)[i], gy[j]), close)
                    out.append(pd.DataFrame({"a": x["k"][i], "b": y["k"][j], "far": far, "more": more}))
        return pd.concat(out) if out else pd.DataFrame({"a": [], "b": [], "far": [], "more": []}).astype({"a": "int64", "b": "int64", "far": "int64", "more": "bool"})

    return x.groupBy("t", "i", "j").cogroup(y.groupBy("t", "i", "j")).applyInPandas(run, "a long, b long, far int, more boolean")


def _prefixes(have: DataFrame, rule: setjoin.Rule) -> DataFrame:
    """The prefix tokens of the sets of ``have``, as longs."""

    def run(batches):
        for b in batches:
            sets = [np.frombuffer(s, "<i8") for s in b.column(0).to_pylist()]
            if sets:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate([s[:rule.prefix(len(s))] for s in sets]))], ["t"])

    return have.select("s").mapInArrow(run, "t long")


def matched(keyed: DataFrame, line_sets: Callable, sets: setjoin.Sets, rule: setjoin.Rule, parts: int, place_rows: Callable, settle: Callable) -> tuple[DataFrame, DataFrame]:
    """node: the keys of the sets that a set of an earlier place is similar to; and the places of all lines.

    A set is compared in full with the CLOSE nearest of its candidates in each
    part, or more where all are far; those that match none of them but have more are compared with all.
    Places are (document, line); of one place the smaller set key comes first.
    """
    rows = keyed.select("_text", "_rank")
    found = materialise(_gather(_postings(keyed, line_sets, rule, parts, place_rows), rule, CLOSE, None, settle), "lists")
    pairs = found.where("kind = 'pair'").select("a", "b", "da", "db", "more")
    # The places of one set are equal in all lists but where a long list was not gathered in one part.
    hot = found.where("kind = 'hot'").select(*_COLS).groupBy("t", "k", "n", "g").agg(F.min(F.struct("d", "l")).alias("at"))
    hot = materialise(hot.select("t", "k", "n", "g", "at.d", "at.l"), "long-lists")

    def late_of(some: DataFrame, docs: DataFrame | None = None) -> DataFrame:
        some = materialise(some.select("a", "b").distinct(), "pairs")
        both = some.select("a", "b")
        return materialise(setjoin.verify(some, setjoin.chosen(both, rows, sets, docs), rule).select(F.col("a").alias("node")).distinct(), "late")

    late = late_of(pairs, pairs.select("da", "db"))
    open_ = pairs.where("more").select("a").distinct().join(late.select(F.col("node").alias("a")), "a", "left_anti")
    open_ = materialise(open_, "open")
    if not open_.isEmpty():
        sc = rows.sparkSession.sparkContext
        docs = pairs.where("more").join(open_, "a", "left_semi").select("da")
        tokens = sc.broadcast(setjoin._wanted(_prefixes(setjoin.chosen(open_, rows, sets, docs), rule)))  # only the lists of these sets are gathered again
        bits = sc.broadcast(setjoin._wanted(open_))
        all_ = _gather(_postings(keyed, line_sets, rule, parts, None, tokens), rule, None, bits).where("kind = 'pair'").join(open_, "a", "left_semi")
        all_ = materialise(all_.select("a", "b", "da", "db"), "pairs")
        late = materialise(late.unionByName(late_of(all_, all_.select("da", "db"))), "late")
    if hot.isEmpty():
        return late, found
    for first in TURNS:
        met = materialise(_meet(hot, late, rule, first, CLOSEST), "met")
        new = late_of(met)  # a few for each set: a pass over all texts costs more than comparing them
        late = materialise(late.unionByName(new), "late")
    open_ = met.where("more").select("a").distinct().join(late.select(F.col("node").alias("a")), "a", "left_anti")
    open_ = materialise(open_.withColumnRenamed("a", "k"), "open")
    if not open_.isEmpty():
        rest = late.unionByName(hot.join(open_, "k", "left_anti").select(F.col("k").alias("node")).distinct())
        late = late.unionByName(late_of(_meet(hot, rest, rule, None, None)))
    return late, found
