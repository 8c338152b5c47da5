"""Operators 2 to 5, 7 and 10 against the libraries or a brute force, and on awkward rows."""

import collections
import hashlib
import re
import zlib

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from dayloom.llm import line_matches, op2_tokens, op3_contamination, op4_substrings, op5_jaccard, op7_packing, op10_lines, setjoin
from dayloom.llm.common import Texts

LOW = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def words(text):
    return re.findall(r"[^\x20\x09-\x0D]+", text.translate(LOW))


def pairs_of(df):
    return df.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).collect()


def groups(items, similar):
    """Least item reachable from each by brute force."""
    root = {i: i for i in items}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    order = sorted(items)
    for i, a in enumerate(order):
        for b in order[:i]:
            if similar(items[a], items[b]):
                x, y = find(a), find(b)
                root[max(x, y)] = min(x, y)
    return {i: find(i) for i in items}


# --- 2: token counts


@pytest.fixture(scope="module")
def pieces_model():
    import sentencepiece

    return sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path(op2_tokens.MODEL))


def test_counts_are_the_librarys(docs, table, pieces_model):
    for df in (docs, table("documents")):
        got = sorted(map(tuple, op2_tokens.token_counts(df, public_tokenizers.path(op2_tokens.MODEL)).collect()), key=str)
        want = []
        for d, t in pairs_of(df):
            n = len(pieces_model.encode(t))
            want.append((d, len(t.encode()), n, n > 4096))
        assert got == sorted(want, key=str)


def test_counts_of_runs_and_odd_strings(pieces_model):
    count = op2_tokens.Counter(public_tokenizers.path(op2_tokens.MODEL))
    rs = np.random.RandomState(3)
    parts = ["a", "b", " ", "  ", "▁", "\n", "é", "the", "ing", "\U0001F600", "中文", "<s>", "\t", "ab" * 20, " " * 90, "a" * 600, "1", "...."]
    texts = ["".join(rs.choice(parts, rs.randint(0, 25))) for _ in range(400)] + [" " * 3000, "a" * 4000, "abc" * 900]
    assert count(texts) == [len(pieces_model.encode(t)) for t in texts]


def test_counts_of_an_empty_table(empty):
    assert op2_tokens.token_counts(empty, public_tokenizers.path(op2_tokens.MODEL)).count() == 0


# --- 3: contamination


def brute_contamination(docs, items, size=13):
    split = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (t or "").translate(LOW))
    out = []
    items = [(i, split(t)) for i, t in items]
    for d, t in docs:
        w, hit, names = split(t), set(), set()
        for i, v in items:
            n = min(size, len(v))
            windows = {tuple(v[s:s + n]) for s in range(len(v) - n + 1)} if v else ()
            for s in range(len(w) - n + 1 if v else 0):
                if tuple(w[s:s + n]) in windows:
                    hit.update(range(s, s + n))
                    names.add(i)
        names = sorted(str(x) for x in names if x is not None)
        out.append((d, len(w), len(hit), len(names), hashlib.sha256(",".join(names).encode()).hexdigest(), len(hit) > 0 and 20 * len(hit) >= len(w)))
    return sorted(out, key=str)


def test_contamination_by_brute_force(spark, docs, rows):
    items = [(1, rows[0][1]), (2, "one"), (3, None), (4, ""), (5, "ONE"), (None, "tail"), (6, "word1 filler1. word2 filler2. word3"), (6, "word1 filler1. word2 filler2. word3"), (7, "never seen words here")]
    bench = spark.createDataFrame(items, "item_id long, text string").withColumn("doc_id", F.lit(1))
    got = sorted(map(tuple, op3_contamination.contamination(docs, bench).collect()), key=str)
    assert got == brute_contamination([(r[0], r[1]) for r in rows], items)


def test_contamination_of_empty_tables(spark, docs, empty):
    none = spark.createDataFrame([], "item_id long, text string")
    assert op3_contamination.contamination(empty, none).count() == 0
    assert op3_contamination.contamination(docs, none).where("n_hit > 0 or contaminated").count() == 0


def test_proximity_in_any_order(spark):
    docs = spark.createDataFrame([(1, "a b river x x silver mountain"), (2, "mountain " + "x " * 40 + "silver river"), (3, "silver river")], "doc_id long, text string")
    bench = spark.createDataFrame([(9, "silver mountain river")], "item_id long, text string")
    near = op3_contamination.proximity_matches(docs, bench)
    keys = {r.doc: r.doc_id for r in docs.withColumn("doc", F.xxhash64("doc_id", "text")).collect()}
    assert {(keys[r.doc], r["item"], r["end"]) for r in near.collect()} == {(1, 9, 6)}


# --- 4: substrings


def brute_substrings(rows, least=20):
    seen, out = set(), {}
    for d, t in sorted({(d, t) for d, t in rows}, key=lambda x: (x[0] is None, x[0] or 0)):
        units = [tuple(re.findall(r"[0-9a-z\x80-\U0010ffff]+", u)) for u in re.split(r"\n|(?<=[.!?;:,])(?=[ \t-\r]|$)", t.translate(LOW))]
        n = run = gone = 0
        for u in [x for x in units if x] + [None]:
            if u is not None and u in seen:
                n, run = n + 1, run + len(u)
            else:
                gone += run if run >= least else 0
                run = 0
            if u is not None:
                seen.add(u)
        out[d] = (sum(map(bool, units)), n, gone > 0)
    return out


def test_substrings_by_brute_force(docs, table):
    for df in (docs, table("documents")):
        got = op4_substrings.dedup(df).collect()
        want = brute_substrings([tuple(x) for x in pairs_of(df)])
        texts = {r.doc_id: r.text or "" for r in pairs_of(df)}
        assert len(got) == df.count()
        for r in got:
            assert (r.n_units, r.n_repeated, r.n_removed > 0) == want[r.doc_id]
            t, kept, at = texts[r.doc_id], "", 0
            for s in r.spans:  # the spans are places in the given text
                kept, at = kept + t[at:s["from"]], s["to"]
            assert kept + t[at:] == r.text and len(t) - len(r.text) == r.n_removed


def test_a_passage_inside_a_line_goes_and_its_first_place_stays(spark):
    passage = "here, we walk along the long road to the far town, past nine white houses, and rest at the inn, then talk for hours about the sea and its ships."
    df = spark.createDataFrame([(2, f"Other words. Well {passage} And more."), (1, f"First. {passage} End.")], "doc_id long, text string")
    got = {r.doc_id: r.text for r in op4_substrings.dedup(df).collect()}
    assert passage in got[1] and "nine white houses" not in got[2] and got[2].endswith("And more.")


def test_every_later_whole_line_goes_however_short(spark, table):
    """By brute force on lines, without a least number of words; what is left repeats no line, and first places stay."""
    split = lambda t: [(x, tuple(re.findall(r"[0-9a-z\x80-\U0010ffff]+", x.translate(LOW)))) for x in t.split("\n")]
    short = [(3, "Accept cookies\nmine, three"), (1, "Accept cookies\n\nmine: one\nShare"), (2, "accept  cookies!\n---\nmine two\n* Share\nShare"), (4, "tiny text"), (5, "tiny text"), (6, "a tiny text")]
    got = {r.doc_id: r.text for r in op4_substrings.dedup(spark.createDataFrame(short, "doc_id long, text string"), whole=True).collect()}
    assert got == {1: short[1][1], 2: "---\nmine two\n", 3: "mine, three", 4: "tiny text", 5: "", 6: "a tiny text"}
    df = table("documents")
    given = {r.doc_id: r.text for r in pairs_of(df)}
    seen, late = set(), {}
    for d in sorted(given):
        late[d] = []
        at = 0
        for x, w in split(given[d]):
            if w and w in seen:
                late[d].append((at, at + len(x)))
            seen.add(w)
            at += len(x) + 1
    assert sum(map(len, late.values())) > 20
    rows = op4_substrings.query(df.sparkSession, "/root/testdata/sf0.001").collect()
    clauses = {r.doc_id: r.n_removed for r in op4_substrings.dedup(df).collect()}
    assert len(rows) == len(given)
    for r in rows:
        spans = [(s["from"], s["to"]) for s in r.spans]
        assert all(any(a <= x and y <= z for a, z in spans) for x, y in late[r.doc_id]) and r.n_removed >= clauses[r.doc_id]
        assert late[r.doc_id] or r.n_removed == clauses[r.doc_id]
        kept = "".join(given[r.doc_id][a:z] for a, z in zip([0, *(z for _, z in spans)], [*(a for a, _ in spans), None]))
        assert kept == r.text


def test_substrings_of_an_empty_table(empty):
    assert op4_substrings.dedup(empty).count() == 0


# --- 5: Jaccard join


def shingles(text, k=5):
    w = words(text)
    return frozenset(tuple(w[i:i + k]) for i in range(len(w) - k + 1)) if len(w) >= k else frozenset([tuple(w)] if w else [])


def test_groups_by_brute_force(docs, table):
    for df in (docs.where("doc_id is not null"), table("documents")):
        sets = {r.doc_id: shingles(r.text) for r in pairs_of(df)}
        want = groups(sets, lambda a, b: bool(a and b) and 100 * len(a & b) >= 75 * len(a | b))
        got = op5_jaccard.near_groups(df).collect()
        assert len(got) == df.count()
        assert {r.doc_id: (r.n_shingles, r.component_id) for r in got} == {d: (len(s), want[d]) for d, s in sets.items()}


def test_groups_of_many_near_copies(spark):
    """More copies than a rare token's list holds: the frequent class, its stars and what they leave."""
    rs = np.random.RandomState(1)
    base = [f"w{i}" for i in range(120)]
    rows = []
    for i in range(150):
        text = list(base)
        for j in rs.choice(120, rs.randint(0, 9), replace=False):
            text[j] = f"x{i}_{j}"
        rows.append((i, " ".join(text)))
    rows += [(1000 + i, " ".join([*base[:40], *(f"y{i}_{j}" for j in range(60))])) for i in range(60)]  # a shared passage only
    sets = {d: shingles(t) for d, t in rows}
    want = groups(sets, lambda a, b: 100 * len(a & b) >= 75 * len(a | b))
    got = {r.doc_id: r.component_id for r in op5_jaccard.near_groups(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == want


def test_rows_without_an_id_and_empty_tables(docs, empty):
    got = [r for r in op5_jaccard.near_groups(docs).collect() if r.doc_id is None]
    assert [r.component_id for r in got] == [1]
    assert op5_jaccard.near_groups(empty).count() == 0
    left = op5_jaccard.keep_one(docs)
    assert left.columns == docs.columns
    assert sorted(r.doc_id for r in left.where("doc_id is not null").collect()) == [1, 2, 4, 5, 6, 7, 8, 10, 12]


def test_rule_bounds():
    rule = setjoin.Rule(75)
    n = np.arange(1, 3000)
    assert (rule.prefix(n) <= n).all() and (rule.prefix(n) >= 1).all()
    assert (rule.shared(n) <= rule.extra(n)).all() and (np.diff(rule.extra(n)) >= 0).all()


# --- 7: packing


def test_pieces_are_the_librarys_and_fill_sequences(docs, table):
    from tokenizers import Tokenizer

    model = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    for df in (docs, table("documents")):
        got = op7_packing.pack_documents(df, public_tokenizers.path(op7_packing.MODEL)).collect()
        want = collections.Counter()
        for d, t in pairs_of(df):
            ids = np.array([*model.encode(t, add_special_tokens=False).ids, 0], "<u4")
            cuts = [0, *range(len(ids) % 2048 or 2048, len(ids) + 1, 2048)] if len(ids) > 2048 else [0, len(ids)]
            want.update((d, i, a, b - a, zlib.crc32(ids[a:b].tobytes())) for i, (a, b) in enumerate(zip(cuts, cuts[1:])))
        assert collections.Counter((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in got) == want
        full = collections.defaultdict(list)
        for r in got:
            full[r.sequence_id].append((r.offset, r.length))
        for spans in full.values():
            ends = np.cumsum([n for _, n in sorted(spans)])
            assert [a for a, _ in sorted(spans)] == [0, *ends[:-1]] and ends[-1] <= 2048
        least = -(-sum(r.length for r in got) // 2048)
        assert len(full) <= least * 1.02 + 1


def test_packing_in_blocks_keeps_rows_and_stays_close(spark):
    rs = np.random.RandomState(2)
    lengths = rs.randint(1, 2049, 3000)
    df = spark.createDataFrame([(i, int(n)) for i, n in enumerate(lengths)], "offset_before long, length long")
    got = op7_packing.pack(df, block=400).collect()
    assert sorted(r.offset_before for r in got) == list(range(3000))
    assert len({r.sequence_id for r in got}) <= 1.03 * lengths.sum() / 2048


def test_packing_of_an_empty_table(empty):
    assert op7_packing.pack_documents(empty, public_tokenizers.path(op7_packing.MODEL)).count() == 0


# --- 10: lines


def brute_lines(rows, num=80):
    lines = [((d is None, d or 0, i), frozenset(words(x))) for d, t in {(d, t) for d, t in rows} for i, x in enumerate(t.split("\n"))]
    first = {}
    for at, s in sorted(lines):
        if s:
            first.setdefault(s, at)
    of = groups({at: s for s, at in first.items()}, lambda a, b: 100 * len(a & b) >= num * len(a | b))
    return {at for at, s in lines if s and of[first[s]] != at}


def test_lines_by_brute_force(spark, docs):
    more = [(20, "alpha beta gamma delta epsilon zeta\nkeep this line for good\n\nalpha beta gamma delta epsilon eta"),
            (21, "Zeta epsilon delta gamma beta alpha\n\n  \nsomething else that is new"), (22, "alpha beta gamma delta epsilon theta alpha")]
    df = docs.select("doc_id", "text").unionByName(spark.createDataFrame(more, "doc_id long, text string")).withColumn("key", F.lit(1))
    rows = [tuple(x) for x in pairs_of(df)]
    gone = brute_lines(rows)
    got = op10_lines.dedup(df).collect()
    assert len(got) == df.count()
    for r in got:
        left = None if r.text is None else "\n".join(x for i, x in enumerate(r.text.split("\n")) if (r.doc_id is None, r.doc_id or 0, i) not in gone)
        assert r._kept == left and r.key == 1


def test_lines_of_the_table_by_brute_force(table):
    df = table("documents").limit(60)
    gone = collections.Counter(at[1] for at in brute_lines([tuple(x) for x in pairs_of(df)]))
    assert {r.doc_id: r._removed for r in op10_lines.dedup(df).collect()} == {r.doc_id: gone[r.doc_id] for r in df.collect()}


@pytest.mark.parametrize("rare", [3, 1000])
def test_lines_of_many_near_copies(spark, monkeypatch, rare):
    """Both ways of the join: lists that are sifted in place, and the frequent class."""
    monkeypatch.setattr(op10_lines, "RARE", rare)
    rs = np.random.RandomState(6)
    base = [[f"{c}{i}" for i in range(30)] for c in "ab"]
    rows = []
    for d in range(40):
        lines = []
        for words_ in base:
            line = list(words_)
            for j in rs.choice(30, rs.randint(0, 5), replace=False):
                line[j] = f"new{rs.randint(60)}"
            lines.append(" ".join(line))
        rows.append((d, "\n".join([*lines, f"alone {d} and its own words x{d} y{d} z{d}"])))
    gone = collections.Counter(at[1] for at in brute_lines(rows))
    got = {r.doc_id: r._removed for r in op10_lines.dedup(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {d: gone[d] for d, _ in rows} and sum(gone.values()) > 20


def brute_matched(rows, num=80):
    """Lines that some earlier line matches itself."""
    lines = sorted(((d, i), frozenset(words(x))) for d, t in rows for i, x in enumerate(t.split("\n")))
    return {at for n, (at, s) in enumerate(lines) if s and any(o and 100 * len(s & o) >= num * len(s | o) for _, o in lines[:n])}


@pytest.mark.parametrize("rare", [3, 1000])
def test_lines_go_only_for_a_match_of_their_own(spark, monkeypatch, rare):
    """Chains with the middle last, and groups in which an edit too many parts two lines that a later one links."""
    monkeypatch.setattr(op10_lines, "RARE", rare)
    rs = np.random.RandomState(8)
    rows = [(d, "\n".join(" ".join(f"g{g}w{i}" if rs.rand() > 0.07 else f"e{rs.randint(40)}" for i in range(30)) for g in range(3))) for d in range(90)]
    base = [f"c{i}" for i in range(20)]
    rows += [(200, " ".join(base)), (201, " ".join(base[3:] + ["x", "y"])), (202, " ".join(base[2:] + ["x"])), (203, " ".join(base))]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    gone = brute_matched(rows)
    got = {r.doc_id: r._kept for r in op10_lines.dedup(df, direct=True).collect()}
    assert got == {d: "\n".join(x for i, x in enumerate(t.split("\n")) if (d, i) not in gone) for d, t in rows}
    assert (201, 0) not in gone and (202, 0) in gone and gone < {at[1:] for at in brute_lines(rows)}
    left = {r.doc_id: r.text for r in op10_lines.drop_lines(df).collect()}
    assert left == got


def test_lines_of_a_long_list(spark):
    """A rare word in more lines than a list is settled with: each line meets the first ones, then the others."""
    rs = np.random.RandomState(9)
    rows = [(d, " ".join(["shared", *[f"g{d % 60}w{i}" if rs.rand() > 0.06 else f"e{rs.randint(900)}" for i in range(8)]])) for d in range(500)]
    gone = brute_matched(rows)
    got = {r.doc_id: r._removed for r in op10_lines.dedup(spark.createDataFrame(rows, "doc_id long, text string").repartition(1), direct=True).collect()}
    assert got == {d: int((d, 0) in gone) for d, _ in rows} and 50 < len(gone) < 450


def test_lines_meet_in_a_long_list(spark):
    """The meeting by itself: both sides are the same table."""
    n = 300
    df = spark.createDataFrame([(7, k, 5, 0, k, 0) for k in range(n)], "t long, k long, n int, g long, d long, l int")
    late = spark.createDataFrame([(5,)], "node long")
    rule = setjoin.Rule(80, 1, signed=True, rare=1000)
    for first in (2, None):
        got = {(r.a, r.b) for r in line_matches._meet(df, late, rule, first, None).collect()}
        assert got == {(a, b) for a in range(n) if a != 5 for b in range(min(a, first or n))}


def test_lines_of_an_empty_table(empty):
    assert op10_lines.dedup(empty).count() == 0 and op10_lines.drop_lines(empty).columns == empty.columns


def test_long_lists_read_the_texts_once_a_turn(spark, monkeypatch):
    monkeypatch.setattr(line_matches, "SHORT", 3)
    reads, meets = [], []
    chosen, meet = setjoin.chosen, line_matches._meet
    monkeypatch.setattr(setjoin, "chosen", lambda *a: reads.append(len(meets)) or chosen(*a))
    monkeypatch.setattr(line_matches, "_meet", lambda *a: meets.append(1) or meet(*a))
    rs = np.random.RandomState(4)
    rows = [(d, " ".join(f"g{d % 8}w{i}" if rs.rand() > 0.08 else f"e{rs.randint(90)}" for i in range(9))) for d in range(120)]
    gone = brute_matched(rows)
    got = {r.doc_id: r._removed for r in op10_lines.dedup(spark.createDataFrame(rows, "doc_id long, text string").repartition(1), direct=True).collect()}
    assert got == {d: int((d, 0) in gone) for d, _ in rows} and gone
    assert len(meets) >= 3 and max(collections.Counter(r for r in reads if r).values()) == 1


def test_signatures_of_any_length_bound_the_difference():
    """Sets of 5 to 700 tokens: the bits that differ are no more than the tokens of one set alone, and tell unlike sets apart."""
    rs = np.random.RandomState(11)
    pool = rs.randint(1, 1 << 62, 6000).astype(np.uint64)
    sets = [rs.choice(pool, n, replace=False) for n in (5, 40, 64, 65, 90, 144, 145, 200, 288, 289, 500, 700) for _ in range(4)]
    sets += [np.append(s[rs.permutation(len(s))[len(s) // 10:]], rs.choice(pool, len(s) // 10)) for s in sets]
    sets = [np.unique(s) for s in sets]
    n = np.array([len(s) for s in sets])
    g, w = line_matches._signatures(np.concatenate(sets), n)
    x, y = (a.ravel() for a in np.meshgrid(np.arange(len(sets)), np.arange(len(sets))))
    far = line_matches._apart({"g": g, "w": w, "n": n}, x, y)
    real = np.array([len(np.setxor1d(sets[i], sets[j])) for i, j in zip(x, y)])
    assert (far <= real).all() and (far[x == y] == 0).all()
    allowed = 20 * (n[x] + n[y]) // 180
    assert not ((real > 2 * allowed) & (n[x] > 30) & (n[x] < 520) & (abs(n[x] - n[y]) < 40) & (far <= allowed)).any()


def test_a_list_leaves_few_pairs_of_unlike_lines(spark):
    """Long lines that share a word alone: their pairs are no candidates, or these grow with the square of the list."""
    rs = np.random.RandomState(12)
    rows = [(d, " ".join(["shared", *[f"w{x}" for x in rs.choice(40000, 110 + d % 3, replace=False)]])) for d in range(150)]
    rows += [(200 + d, t.replace("shared", "shared again")) for d, t in rows[:20]]
    keyed = op10_lines._keyed(spark.createDataFrame(rows, "doc_id long, text string"))
    even = np.zeros(1 << op10_lines.COUNTERS, np.uint8)
    rule = setjoin.Rule(80, 1, signed=True, rare=1000)
    packed = line_matches._postings(keyed, lambda t: op10_lines.line_sets(t, even), rule, 8)
    got = line_matches._gather(packed, rule, 8).where("kind = 'pair'").select("da", "db", "more").distinct().collect()
    assert {(r.da, r.db) for r in got} == {(200 + d, d) for d in range(20)} and not any(r.more for r in got)


@pytest.mark.parametrize("close, doubt, short", [(1, 1, 4096), (2, 3, 3)])
def test_lines_with_more_candidates_than_are_compared_first(spark, monkeypatch, close, doubt, short):
    """The exact way for the rest, in lists settled in place and in long ones."""
    for name, value in (("CLOSE", close), ("DOUBT", doubt), ("SHORT", short), ("PAIRS", 50)):
        monkeypatch.setattr(line_matches, name, value)
    rs = np.random.RandomState(13)
    rows = [(d, " ".join(f"g{d % 3}w{i}" if rs.rand() > 0.1 else f"e{rs.randint(90)}" for i in range(24 if d % 2 else 90))) for d in range(150)]
    gone = brute_matched(rows)
    got = {r.doc_id: r._removed for r in op10_lines.dedup(spark.createDataFrame(rows, "doc_id long, text string"), direct=True).collect()}
    assert got == {d: int((d, 0) in gone) for d, _ in rows} and 10 < len(gone) < 140


@pytest.fixture
def worker(monkeypatch):
    """A task's function in this process: its packed rows, and the most memory in MB that it held."""
    import tracemalloc
    from types import SimpleNamespace

    task = SimpleNamespace(get=lambda: SimpleNamespace(partitionId=lambda: 3))
    monkeypatch.setattr(setjoin, "TaskContext", task)
    monkeypatch.setattr(line_matches, "TaskContext", task)
    rows = SimpleNamespace(mapInArrow=lambda run, _: run)
    rows.select = lambda *_: rows

    def work(made, batch):
        tracemalloc.start()
        try:
            out = [r for b in made(rows)(iter([batch])) for r in b.to_pylist()]
            return out, tracemalloc.get_traced_memory()[1] / 1e6
        finally:
            tracemalloc.stop()

    return work


def task_texts(seed, docs, lines, size):
    rs = np.random.RandomState(seed)
    return ["\n".join(" ".join(f"w{x}" for x in rs.randint(0, 30000, size)) for _ in range(lines)) for _ in range(docs)]


def test_a_task_packs_the_prefixes_of_its_sets_in_little_memory(worker):
    """Postings hold their token alone, what is the set's stays with the sets, and words are hashed by small segments."""
    batch = pa.RecordBatch.from_pydict({"text": task_texts(14, 2500, 10, 36)})
    rule = setjoin.Rule(75)
    out, mb = worker(lambda rows: setjoin.postings(rows, op5_jaccard._sets(5), rule.prefix, 16), batch)
    key, size, tok = op5_jaccard._sets(5)(batch)
    want = {(t, k) for k, n, end in zip(key.tolist(), size.tolist(), np.cumsum(size)) for t in tok[end - n:end - n + rule.prefix(n)].tolist()}
    got = [(t, k) for r in out for t, k in zip(np.frombuffer(r["t"], "<u8").tolist(), np.frombuffer(r["k"], "<i8").tolist())]
    assert len(got) == len(want) and set(got) == want
    assert mb < 45


def test_a_task_packs_the_prefixes_of_its_lines_in_little_memory(worker):
    """Whole sets are read a chunk at a time; prefixes, sizes and signatures are all that is held of them."""
    texts = task_texts(15, 1600, 20, 36)
    batch = pa.RecordBatch.from_pydict({"_text": texts, "_rank": list(range(len(texts))), "_key": list(range(len(texts)))})
    even, rule = np.zeros(1 << op10_lines.COUNTERS, np.uint8), setjoin.Rule(80, 1, signed=True, rare=1000)
    out, mb = worker(lambda rows: line_matches._postings(rows, lambda t: op10_lines.line_sets(t, even), rule, 16, op10_lines._place_rows), batch)
    key, size, tok, *_ = op10_lines.line_sets(Texts(batch.column(0)), even)
    want = {(t, k) for k, n, end in zip(key.tolist(), size.tolist(), np.cumsum(size)) for t in tok[end - n:end - n + rule.prefix(n)].tolist()}
    posts = [r for r in out if r["kind"] == "post"]
    got = [(t, k) for r in posts for t, k in zip(line_matches._array([r["t"]], "<u8").tolist(), line_matches._array([r["k"]], "<i8").tolist())]
    assert len(got) == len(want) and set(got) == want
    assert mb < 60
