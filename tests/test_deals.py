"""Keyed deals, window counts in bit words, blocked weight search and exact sums against brute force."""

import itertools

import numpy as np
import pytest
from pyspark.sql import functions as F

from dayloom.operators import backtest as B
from dayloom.operators import deals as D
from dayloom.operators import resampling as R


@pytest.mark.parametrize("n", [1, 2, 3, 7, 64, 1000])
def test_every_key_gives_a_permutation(n):
    keys = D.round_keys(np.int64(12345), np.arange(1, 40))
    x = D.permuted(np.arange(n)[:, None], np.array([n]), keys[None])
    assert all(sorted(x[:, r]) == list(range(n)) for r in range(39))
    assert n < 7 or len({tuple(x[:, r]) for r in range(39)}) > 35


def test_deals_are_even():
    """Each row, and each pair of neighbours, is flagged about as often as chance has it."""
    reps = np.arange(1, 20_001)
    on = D.flags(np.arange(12), np.full(12, 12), np.full(12, 5), np.full(12, 77), reps)
    assert (on.sum(0) == 5).all()
    assert abs(on.mean(1) - 5 / 12).max() < 5 * np.sqrt(0.25 / len(reps))
    both = np.array([(on[i] & on[j]).mean() for i, j in itertools.combinations(range(12), 2)])
    assert abs(both - 20 / 132).max() < 5 * np.sqrt(0.13 / len(reps))


def test_dealt_flags_keep_their_number_in_every_group(spark, make):
    p = make([(d, i, "AB"[i % 2], i % 3) for d in (1, 2) for i in range(100)]).withColumn("strong", F.col("metric") > 1)
    x = R.dealt(p, ["site", "day", "label"], "entity_id", "x")
    got = D.flag_sums(x, ["site", "day", "label"], 1500, "metric").toPandas()
    assert len(got) == 4 * 1501
    want = p.where("strong").groupBy("day", "label").count().toPandas().set_index(["day", "label"])["count"]
    assert all((g.q == want[k]).all() and g.v.nunique() > 5 for k, g in got.groupby(["day", "label"]))


def brute_windows(cells):
    """cells: {(segment): {slot: flag}}"""
    out = []
    for length, need in ((2, 2), (3, 3), (5, 3)):
        out.append(sum(all(s + i in c for i in range(length)) and sum(c[s + i] for i in range(length)) >= need
                       for c in cells.values() for s in c))
    return tuple(out)


def test_windows_of_long_segments(spark, make):
    """Segments of several words, with gaps, slots below zero, and windows over the borders of words."""
    rs = np.random.RandomState(4)
    slots = {"I": [s for s in range(-30, 200) if s % 37], "J": list(range(50, 70)), "K": [0, 1, 5]}
    place = [(k, s) for k, own in slots.items() for s in own]
    metric = rs.randint(0, 2, len(place))
    p = make([(1, i, "A", int(m)) for i, m in enumerate(metric)])
    lay = spark.createDataFrame([("main", i, k, "N", s, "rect") for i, (k, s) in enumerate(place)],
                                "site string, entity_id bigint, island_id string, side string, slot_index int, shape string")
    got = {r.rep: (r.pairs, r.triples, r.fives) for r in R.spatial_counts(p, lay, 1, 3).collect()}
    n, key = len(place), None
    key = spark.range(1).select(D.key_of(F.lit("2024-01-01"), "x")).first()[0]
    dealt = D.flags(np.arange(n), np.full(n, n), np.full(n, metric.sum()), np.full(n, key), np.arange(1, 4))
    for rep, on in [(0, metric > 0), *((r + 1, dealt[:, r]) for r in range(3))]:
        cells = {}
        for (k, s), f in zip(place, on):
            cells.setdefault(k, {})[s] = int(f)
        assert got[rep] == brute_windows(cells)


def test_rows_without_flags_or_values(spark, make):
    p = make([(1, 1, "A", None), (1, 2, "A", 3), (2, 5, "B", None)])
    lay = spark.createDataFrame([("main", i, "I", "N", i, "rect") for i in (1, 2, 5)],
                                "site string, entity_id bigint, island_id string, side string, slot_index int, shape string")
    got = R.spatial_counts(p, lay, 1, 4).collect()
    assert len(got) == 10 and all(r.pairs == 0 for r in got)
    assert R.spatial_counts(p.limit(0), lay, 1, 4).count() == 0


def test_draws_are_different_rows(spark):
    g = spark.createDataFrame([("a", 30, 5), ("b", 4, 9)], "day string, _n long, _key long")
    got = D.draws(g, ["day"], 6, 1200).toPandas()
    each = got.groupby(["day", "rep"])._number
    assert (each.nunique() == each.size()).all() and set(each.size()["a"]) == {6} and set(each.size()["b"]) == {4}
    assert got[got.day == "a"]._number.nunique() == 30


def test_pattern_picks_by_brute_force(spark, make, monkeypatch):
    """Small blocks of rows and patterns, ties and a day in several partitions."""
    monkeypatch.setattr(B, "ROWS", 7)
    monkeypatch.setattr(B, "PATTERNS", 3)
    rs = np.random.RandomState(2)
    rows = [("main", d, int(i), float(rs.randint(5)), float(rs.randint(4)), float(rs.randint(3))) for d in ("2024-01-01", "2024-01-02") for i in range(40)]
    feats = spark.createDataFrame(rows, "site string, day string, entity_id long, metric double, f double, g double").withColumn("day", F.col("day").cast("date")).repartition(4)
    vectors = B.random_weights(spark, 8, ["f", "g"])
    w = {r.model: r.w for r in vectors.collect()}
    got = B.pattern_picks(feats, vectors, ["f", "g"], 5).toPandas()
    assert len(got) == 2 * 8 * 5
    comp = {}
    for d in ("2024-01-01", "2024-01-02"):
        own = [r for r in rows if r[1] == d]
        z = [(np.array([r[c] for r in own]) - np.mean([r[c] for r in own])) / np.std([r[c] for r in own]) for c in (4, 5)]
        comp[d] = [(r[2], *np.clip(50 + 12.5 * np.array([z[0][i], z[1][i]]), 0, 100)) for i, r in enumerate(own)]
    for (day, model), g in got.groupby(["day", "model"]):
        want = sorted(comp[str(day)], key=lambda r: (-round(r[1] * w[model][0] + r[2] * w[model][1], 9), r[0]))[:5]
        assert list(g.sort_values("rank").entity_id) == [r[0] for r in want]


def sums_p(values, scale):
    ways = {0: 1}
    for v in np.abs(np.round(np.array(values) * scale)).astype(int).tolist():
        new = {}
        for s, c in ways.items():
            for t in (s + v, s - v):
                new[t] = new.get(t, 0) + c
        ways = new
    seen = abs(int(round(sum(values) * scale)))
    return (sum(c for s, c in ways.items() if abs(s) >= seen) + 1) / (2 ** len(values) + 1)


@pytest.mark.parametrize("n, unit, drift", [(29, 100, 44), (200, 0.25, 1), (21, 1e-6, 3), (70, 1700, 2)])
def test_exact_sign_test_of_any_size(spark, n, unit, drift):
    """Whole totals of 130,400 over 29 days and the like: the common divisor is the grid, and a tree joins the leaves."""
    rs = np.random.RandomState(n)
    v = [float(x) * unit for x in rs.randint(-100, 120, n) + drift if x]
    df = spark.createDataFrame([("s", f"d{i}", x) for i, x in enumerate(v)], "site string, day string, v double")
    got = R.exact_sign_test(df, ["site"], "v").first()
    assert got.n == len(v) and got.p_value == pytest.approx(sums_p(v, 1 / unit), abs=1e-9)


def test_sums_leave_a_task_once_and_one_group_meets_all_tasks(spark):
    """Rows in random order, replicates in two blocks: every row of a group is spread over the tasks, and each task gives a group out once."""
    n, reps = 3000, 1001
    df = spark.range(n).select(F.lit("main").alias("site"), (F.col("id") % 40).alias("g"), (F.col("id") % 7 == 0).alias("strong"), F.col("id").alias("_number"),
                               F.lit(n).alias("_n"), F.lit(429).alias("_m"), F.lit(99).alias("_key"))
    spread = D.blocks(df.where("g = 3"), reps).groupBy(F.spark_partition_id().alias("p")).count().collect()
    assert len(spread) == D.TASKS * spark.sparkContext.defaultParallelism
    out = {(r.g, r.rep): r.q for r in D.flag_sums(df, ["site", "g"], reps).collect()}
    on = D.flags(np.arange(n), np.full(n, n), np.full(n, 429), np.full(n, 99), np.arange(1, reps + 1))
    assert len(out) == 40 * (reps + 1) and all(out[g, 0] == sum(i % 7 == 0 for i in range(g, n, 40)) for g in range(40))
    assert all((np.array([out[g, r] for r in range(1, reps + 1)]) == on[g::40].sum(axis=0)).all() for g in range(40))
    x, keys = np.arange(n), D.round_keys(np.int64(99), np.arange(1, 30))
    assert (D.images(x, n, *D._rounds(99, n, 1, 29)) == D.permuted(x[:, None], np.array([n]), keys[None])).all()


def test_pattern_picks_merge_a_bounded_number_of_lists(spark, make, monkeypatch):
    rs = np.random.RandomState(3)
    rows = [("main", i % 3, int(i), float(rs.randint(5)), float(rs.randint(4)), float(rs.randint(3))) for i in range(600)]
    feats = spark.createDataFrame(rows, "site string, day int, entity_id long, metric double, f double, g double").withColumn("day", F.date_add(F.lit("2024-01-01"), F.col("day"))).repartition(4)
    vectors = B.random_weights(spark, 8, ["f", "g"])
    found = []
    for tasks, size in ((32, 32), (1, 1)):  # each task's lists merged alone first, given out one by one
        monkeypatch.setattr(B, "TASKS", tasks)
        monkeypatch.setattr(B, "SLICE", size)
        got = B.pattern_picks(feats, vectors, ["f", "g"], 5)
        plan = got._jdf.queryExecution().analyzed().toString()
        assert plan.count("FlatMapGroupsInPandas") == 2 and "part#" in plan
        found.append(sorted(map(tuple, got.collect())))
    assert found[0] == found[1] and len(found[0]) == 3 * 8 * 5
