"""Epoch policies, session summaries, cross tables and block summaries on small panels."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from dayloom.operators import aggregates as A
from dayloom.operators import backtest as B
from dayloom.operators import scoring as SC


def test_exclusion_ladder_at_its_boundaries(spark):
    n = [6, 7, 13, 14, 20, 21, 30, 31, None, None]
    df = spark.createDataFrame([(i + 1, x is not None, x) for i, x in enumerate(n)], "entity_id int, changed boolean, epoch_n int")
    want = {7: [2, 3, 4, 5, 6, 7, 8, 9, 10], 14: [4, 5, 6, 7, 8, 9, 10], 21: [6, 7, 8, 9, 10], 31: [8, 9, 10]}
    for t, ok in SC._Policies(SC.LADDER).long_enough.items():
        assert [r.entity_id for r in df.where(ok).orderBy("entity_id").collect()] == want[t]


def panel(make):
    return make([(d, e, "N" if e == 1 and d > 5 else "A", (e * 7 + d * d) % 23 - 9) for d in range(1, 9) for e in range(1, 13)])


def test_ranking_and_population_exclusion_are_distinct(make):
    x = {(r.policy, r.entity_id): r for r in SC.epoch_ladder(panel(make), (3, 4)).collect()}
    assert {r.candidate for (p, e), r in x.items() if e == 1} == {True, False} and all(r.candidate for (p, e), r in x.items() if e != 1)
    assert x["EXCLUDE_LT3", 1].candidate and not x["EXCLUDE_LT4", 1].candidate
    assert all(x["EXCLUDE_LT4", e].score == x["EPOCH", e].score for e in range(1, 13))  # out of the ranking only
    assert any(x["EXCLUDE_LT4_POP", e].score != x["EPOCH", e].score for e in range(2, 13))


def test_normalisation_shift_counts_who_is_outside(make):
    got = {(r.moments, r.factor): r for r in SC.normalisation_shift(panel(make), (3, 4)).collect()}
    assert {k[0] for k in got} == {"BASE", "RANK", "POP3", "POP4"}
    assert all(r.population + r.excluded == 12 and r.excluded == (k[0] == "POP4") for k, r in got.items())
    last = got["POP4", "last"]
    assert last.lo <= last["mean"] <= last.hi and last.clipped_low + last.clipped_high <= 12


def test_return_on_what_was_invested(spark):
    df = spark.createDataFrame([("a", 100, 150), ("a", 100, 20), ("a", None, 30), ("b", 0, 0)], "g string, i int, r int")
    got = {r.g: r for r in A.session_summary(df, ["g"], "i", "r").collect()}
    assert (got["a"].sessions, got["a"].profit, got["a"].wins, got["a"].roi) == (3, 0, 2, 100.0)
    assert got["b"].roi is None and got["b"].win_rate == 0


def test_crosstab_has_every_cell(make):
    p = make([(1, 1, "A", 0), (1, 2, "A", 0), (2, 1, "B", 0)])
    got = sorted((r.day.day, r.label, r.n, r.row_total, r.column_total) for r in A.crosstab(p, ["day"], "label").collect())
    assert got == [(1, "A", 2, 2, 2), (1, "B", 0, 2, 1), (2, "A", 0, 1, 2), (2, "B", 1, 1, 1)]


def test_block_summary(spark):
    day = lambda n: dt.date(2024, 1, n)
    df = spark.createDataFrame([("s", day(1), 1, 4.0, 2, 1.0, 10), ("s", day(2), 1, -2.0, 2, 1.0, 10), ("s", day(3), 2, 1.0, 5, 1.0, 10)],
                               "site string, day date, block int, a_mean double, a_n int, b_mean double, b_n int")
    r = B.block_summary(df).where("block = 1").first()
    assert (r.days, r.total, r.base_total, r.difference, r.scaled, r.base_scaled, r.improvement, r.entities) == (2, 4.0, 20.0, -16.0, 20.0, 20.0, 0.0, 2.0)


@pytest.mark.parametrize("fields, share, name", [(("prior_last",), 0.0, "last_positive"), (("prior_last", "prior_last3"), 0.5, "last_and_last3_from_0.5")])
def test_switches_are_named_by_what_they_test(fields, share, name):
    assert B.switch_name(fields, share) == name


def test_group_values_of_an_empty_panel(make, spark):
    empty = spark.createDataFrame([], make([(1, 1, "A", 0)]).schema)
    assert SC.epoch_ladder(empty).count() == 0 and A.crosstab(empty, ["day"], "label").count() == 0
    assert SC.neutral_fill(empty.withColumn("x", F.lit(1.0)), ["x"]).count() == 0
