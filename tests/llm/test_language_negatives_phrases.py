"""Operators 11, 12 and 13 against brute force, held-out rows and awkward tables."""

import collections
import math
import os
import re

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from dayloom.llm import op11_language, op12_negatives, op13_phrases

SF = "/root/testdata/sf0.001"


def by_sql(sql, name, order):
    if not os.path.isdir(SF):
        pytest.skip("test tables are not here")
    con = duckdb.connect()
    con.sql(f"create view {name} as select * from '{SF}/{name}.parquet'")
    return con.sql(sql).df().sort_values(order).reset_index(drop=True)


def same(got, want, order):
    return got.sort_values(order).reset_index(drop=True)[list(want.columns)].astype(str).equals(want.astype(str))


# --- 11: languages


def test_languages_of_held_out_rows(table):
    docs = table("documents")
    lang = {r.doc_id: r.lang for r in docs.select("doc_id", "lang").collect()}
    got = op11_language.query(docs.sparkSession, SF).collect()
    assert len(got) == len(lang)
    held = [r for r in got if r.held_out]
    assert 20 < len(held) < 90 and sum(r.lang_pred == lang[r.doc_id] for r in held) >= 0.97 * len(held)


def test_a_word_is_scored_by_its_longest_known_parts(spark):
    rows = [(i, "red red blue", "aa", i) for i in range(40)] + [(i, "rot blau blau blau", "bb", i) for i in range(40, 80)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, n long")
    model = op11_language.train(docs)
    known = lambda w: model.rows[0][model.entries[0][w]].tolist()
    assert model.langs == ["aa", "bb"]
    assert known("red") == pytest.approx([-math.log10(2 / 3), 7]) and known("blau") == pytest.approx([7, -math.log10(3 / 4)])
    # " blu" is in neither model as a 5-gram, so "blup" goes by 4-grams: " blu" of "blue" alone.
    four = collections.Counter(g for w, n in (("red", 2), ("blue", 1)) for g in op11_language.grams(w, 4) for _ in range(n))
    assert model.unseen("blup").tolist() == pytest.approx([-math.log10(four[" blu"] / sum(four.values())), 7])
    assert model.unseen("中文").tolist() == [7, 7]
    assert model.predict("blup red")[0] == "aa" and model.predict("rot, BLAU!")[0] == "bb"
    assert model.predict("4711 ² _ ½") == ("und", 0.0) and model.predict(None) == ("und", 0.0) and model.predict("")[0] == "und"
    assert model.predict("中文")[0] == "aa"  # a tie


def test_words_in_pieces_wherever_a_text_is_cut(monkeypatch):
    text = "x" * 95 + " AbÄ c1d²e ١" + "y" * 41 + "." + "z" * 300
    whole = [w for some in op11_language.words(text) for w in some]
    assert whole == ["x" * 40, "x" * 40, "x" * 15, "abä", "c", "d", "e", "y" * 40, "y"] + ["z" * 40] * 7 + ["z" * 20]
    for size in (41, 50, 97, 130):
        monkeypatch.setattr(op11_language, "CHUNK", size)
        assert [w for some in op11_language.words(text) for w in some] == whole


def test_counts_by_hand(spark, monkeypatch):
    monkeypatch.setattr(op11_language, "MEMO", 2)
    rows = [(i, t, x) for i, (t, x) in enumerate([("a b a", "l"), ("A c", "l"), ("a", "m"), (None, "l"), ("b b", None), ("", "m")] * 12)]
    docs = spark.createDataFrame([*rows, (None, "zzz", "l")], "doc_id long, text string, lang string")
    want = collections.Counter()
    kept = {r.doc_id for r in docs.where(~op11_language.held_out()).collect()}
    for i, t, x in rows:
        if i in kept and t is not None and x is not None:
            for w in t.lower().split():
                want[x, 0, w] += 1
                for n in op11_language.ORDERS:
                    for g in op11_language.grams(w, n):
                        want[x, n, g] += 1
    assert {(r.lang, r.size, r.entry): r.n for r in op11_language.counts(docs).collect()} == want


def test_the_model_is_bounded_and_backs_off(spark):
    rows = [(i, " ".join(f"word{chr(97 + j % 26)}{chr(97 + j // 26)}" for j in range(i % 60)), "ab"[i % 2]) for i in range(300)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    model = op11_language.train(docs, words=20, grams=30)
    assert 0 < len(model.entries[0]) <= 20 and all(len(model.entries.get(n, {})) <= 30 for n in op11_language.ORDERS)


def test_languages_of_awkward_tables(docs, empty):
    model = op11_language.train(docs)
    got = op11_language.predict(docs, model).collect()
    assert len(got) == docs.count() and {r.lang_pred for r in got if r.doc_id in (4, 5, 6)} == {"und"}
    assert all(0 <= r.score <= 1 for r in got) and len({(r.lang_pred, r.score) for r in got if r.doc_id in (1, 3)}) == 1
    none = op11_language.train(empty)
    assert {r.lang_pred for r in op11_language.predict(docs, none).collect()} == {"und"}
    assert op11_language.predict(empty, model).count() == 0


# --- 12: hard negatives


def brute_negatives(rows, every=50):
    use = []
    for i, v, label in {(i, None if v is None else tuple(v), x) for i, v, x in rows}:
        if i is None or v is None or label is None or any(x is None or not math.isfinite(x) for x in v):
            continue
        use.append((i, [math.floor(256 * x) for x in v], (label + 1) % 10 if i % 7 == 0 else label))
    out = []
    for a, v, label in use:
        if a % every == 0:
            score = [(-sum(x * y for x, y in zip(v, w)), i, x == label) for i, w, x in use for x in [x] if i != a]
            score.sort()
            for s, p, own in [x for x in score if x[2]][:5]:
                inside = [(-n, i) for n, i, o in score if not o and 50 * -s <= 100 * -n <= 95 * -s][:3]
                out += [(a, p, k + 1, i, -s, n) for k, (n, i) in enumerate(inside)]
    return sorted(out)


def test_negatives_by_sql(table):
    order = ["anchor_id", "positive_id", "rank"]
    got = op12_negatives.query(table("embeddings").sparkSession, SF).toPandas()
    assert same(got, by_sql(op12_negatives.SQL, "embeddings", order), order) and len(got) > 50


@pytest.mark.parametrize("sizes", [(4096, 4096, 8), (3, 16, 2)])
def test_negatives_by_brute_force(spark, monkeypatch, sizes):
    """Clusters with many ties and one vector that a third of all rows share; small blocks of anchors and rows."""
    for name, n in zip(("ANCHORS", "ROWS", "DIMS"), sizes):
        monkeypatch.setattr(op12_negatives, name, n)
    rs = np.random.RandomState(3)
    centre = rs.randn(6, 12)
    rows = []
    for i in range(400):
        v = centre[0] if i % 3 == 0 else np.round(centre[rs.randint(6)] + rs.randn(12) * 0.4, 1)
        rows.append((int(i), [float(x) for x in v], int(rs.randint(4))))
    rows += [(450, [0.0] * 12, 1), (500, [-x for x in rows[1][1]], 2), (550, [0.01] * 5, 3)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")
    got = sorted(tuple(r)[:6] for r in op12_negatives.negatives(df, F.col("vec_id") % 50 == 0).collect())
    want = brute_negatives([(i, list(v) + [0.0] * (12 - len(v)), x) for i, v, x in rows])
    assert got == want and len(got) > 40


def test_negatives_of_awkward_tables(spark):
    nan = float("nan")
    rows = [(0, [1.0, 0.5], 0), (0, [1.0, 0.5], 0), (1, [0.9, 0.5], 1), (2, [0.8, 0.2], 2), (3, None, 2), (4, [nan, 1.0], 2), (5, [None, 1.0], 2),
            (6, [1.0, 1.0], None), (None, [1.0, 1.0], 2), (8, [float("inf"), 0.0], 2), (50, [1e30, -1e30], 3), (9, [], 2)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int").withColumn("score", F.lit("x")).withColumn("v", F.lit(None).cast("int"))
    got = [tuple(r) for r in op12_negatives.negatives(df, F.col("vec_id") % 50 == 0).collect()]
    assert got == [(0, 1, 1, 2, 256 * 230 + 128 * 128, 256 * 204 + 128 * 51)]
    assert op12_negatives.negatives(df.limit(0), F.lit(True)).collect() == []
    assert op12_negatives.negatives(df.where("label = 1"), F.lit(True)).collect() == []  # no other label


def test_no_index_leaves_out_a_row_that_can_reach(monkeypatch):
    rs = np.random.RandomState(5)
    x, q = np.round(rs.randn(300, 24) * 100), np.round(rs.randn(40, 24) * 100)
    order = np.argsort((x ** 2).sum(0), kind="stable")
    exact = q @ x.T
    for share in (0.9, 0.5, 0.2, -0.1):
        least = share * np.sqrt((q ** 2).sum(1)) * 500
        index = op12_negatives.Index(x, order, float((least / np.sqrt((q ** 2).sum(1))).min()))
        i, j = index.candidates(q, least)
        found = set(zip(i.tolist(), index.rows[j].tolist()))
        assert {(a, b) for a, b in zip(*np.nonzero(exact >= least[:, None]))} <= found
        if share == 0.9:
            assert index.held[0] == 0 and len(found) < 0.5 * exact.size  # the first dimensions have no postings


# --- 13: phrases


def brute_phrases(rows, least=10, longest=3, top=2000):
    f = collections.defaultdict(collections.Counter)
    for _, text, lang in rows:
        low = re.sub("[A-Z]", lambda m: m.group().lower(), text or "")
        for piece in re.split("[.,;:!?\n-\r]", low):
            w = re.findall("[^ \t]+", piece)
            for n in range(1, longest + 1):
                for i in range(len(w) - n + 1):
                    f[lang or "und" if lang != "" else ""][tuple(w[i:i + n])] += 1
    out = []
    for lang, c in f.items():
        n = sum(a for w, a in c.items() if len(w) == 1)
        cand = {w: a for w, a in c.items() if len(w) > 1 and a >= least}
        held = collections.Counter()
        for w, a in cand.items():
            for size in range(2, len(w)):
                for i in range(len(w) - size + 1):
                    held[w[i:i + size]] = max(held[w[i:i + size]], a)
        rows_ = []
        for w, a in cand.items():
            if 100 * held[w] < 50 * a or not held[w]:
                score, k = min((10 ** 6 * a * a // (c[w[:k]] * c[w[k:]]), k) for k in range(1, len(w)))
                rows_.append((-score, -a, " ".join(w).encode(), a, c[w[:k]], c[w[k:]]))
        out += [(lang, i + 1, p.decode(), a, l, r, n, -s) for i, (s, _, p, a, l, r) in enumerate(sorted(rows_)[:top])]
    return sorted(out)


def test_phrases_by_sql(table):
    order = ["lang", "rank"]
    got = op13_phrases.query(table("documents").sparkSession, SF).toPandas()
    assert same(got, by_sql(op13_phrases.SQL, "documents", order), order) and len(got) > 50


def zipf(n, words=60, seed=1):
    rs = np.random.RandomState(seed)
    out = []
    for i in range(n):
        w = [f"W{min(words, x)}" for x in rs.zipf(1.3, 60)]
        out.append((i, "".join(x + rs.choice([" ", "  ", "\t", ", ", ".", "\n", " ä "], p=[.7, .05, .05, .05, .05, .05, .05]) for x in w), ["aa", "bb", None, ""][i % 4]))
    return out


@pytest.mark.parametrize("longest, share, top", [(3, 4, 2000), (4, 1, 5), (2, 40, 7), (3, 10 ** 6, 2000)])
def test_phrases_by_brute_force(spark, monkeypatch, longest, share, top):
    """Whatever the sample holds: all documents, some or none; also where the ranking takes several turns."""
    monkeypatch.setattr(op13_phrases, "GROUP", 20)
    rows = zipf(160)
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string").repartition(5)
    got = sorted(tuple(r) for r in op13_phrases.collocations(df, longest=longest, share=share, top=top).collect())
    assert got == brute_phrases(rows, longest=longest, top=top) and len(got) > 10


def test_failures_of_the_border_need_more_passes(spark, monkeypatch):
    """A sample without a word gives a border failure, and what it makes possible is counted in the passes that follow."""
    made = []
    real = op13_phrases._occurrences
    monkeypatch.setattr(op13_phrases, "_occurrences", lambda *a, **k: made.append(a[1]) or real(*a, **k))
    rows = zipf(60)
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    counts = {(r.lang, r.words, r.phrase): r.n for r in op13_phrases.frequent(df, share=10 ** 6).collect()}
    assert len(made) == 4  # the sample, words, pairs of words, phrases of three
    made.clear()
    assert {(r.lang, r.words, r.phrase): r.n for r in op13_phrases.frequent(df, share=1).collect()} == counts
    assert len(made) == 2


def test_long_texts_are_cut_between_words(spark, monkeypatch):
    monkeypatch.setattr(op13_phrases, "CHUNK", 64)
    rows = [*zipf(40), (90, " ".join(["one two three four"] * 300), "aa"), (91, "x" * 1000 + " " + "y z. " * 40, "aa")]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    assert sorted(tuple(r) for r in op13_phrases.collocations(df).collect()) == brute_phrases(rows)


def test_products_beyond_64_bits(spark):
    big = 3 * 10 ** 11
    e = F.expr(f"(cast({big}L as decimal(19, 0)) * cast({big}L as decimal(19, 0)) * 1000000BD) div (cast({big + 7}L as decimal(19, 0)) * cast({big + 9}L as decimal(19, 0)))")
    assert spark.range(1).select(e).first()[0] == 10 ** 6 * big * big // ((big + 7) * (big + 9))


def test_phrases_of_awkward_tables(spark, docs, empty):
    rows = [tuple(r) for r in docs.select("doc_id", "text", "lang").collect()]
    assert sorted(tuple(r) for r in op13_phrases.collocations(docs, least=2).collect()) == brute_phrases(rows, least=2)
    assert op13_phrases.collocations(empty).count() == 0
