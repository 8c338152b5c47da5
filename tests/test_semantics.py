"""Behaviour that is easy to get wrong, on hand-written panels."""

import datetime as dt

import numpy as np
import pytest
from pyspark.sql import functions as F

from dayloom.functions import expr as X
from dayloom.functions import text as TX
from dayloom.operators import backtest as B
from dayloom.operators import features as FT
from dayloom.operators import joins as J
from dayloom.operators import quality as Q
from dayloom.operators import resampling as R
from dayloom.operators import scoring as SC
from dayloom.operators import windows as WN


def rows(df, *cols):
    return [tuple(r) for r in df.select(*cols).orderBy(*cols).collect()]


def d(n):
    return dt.date(2024, 1, n)


# ---- epochs, segments, runs ------------------------------------------------------

def test_label_that_comes_back_is_a_new_epoch(make):
    p = make([(1, 1, "A", 0), (2, 1, "B", 0), (3, 1, "A", 0)])
    assert [r[0] for r in rows(WN.epochs(p), "epoch_id")] == ["1:0001:20240101", "1:0002:20240102", "1:0003:20240103"]


def test_idle_day_counts_in_calendar_not_as_observed(make):
    e = WN.current_epochs(make([(1, 1, "A", 0), (2, 1, "A", 0, 0), (3, 1, "A", 0)])).first()
    assert (e.calendar_days, e.observed_days, e.idle_days, e.continuous) == (3, 2, 1, True)


def test_epoch_survives_a_gap_but_segment_and_run_do_not(make):
    p = make([(1, 1, "A", 1), (2, 1, "A", 1), (4, 1, "A", 1)])
    e = WN.current_epochs(p).first()
    assert (e.epoch, e.continuous, e.missing_days) == (1, False, 1)
    assert [r[1] for r in rows(WN.segments(p), "day", "break_reason")] == ["FIRST", "", "CALENDAR_GAP"]
    run = WN.current_run(p, "2024-01-04").first()
    assert (run.age, run.stop_reason, run.eligible) == (1, "CALENDAR_GAP", False)


def test_as_of_ignores_later_rows(make):
    p = make([(1, 1, "A", 0), (2, 1, "B", 0)])
    assert WN.current_epochs(p, "2024-01-01").first().label == "A"


def test_persistent_rename_keeps_its_predecessor(make):
    p = make([(1, 1, "A", 0), (2, 1, "B", 0), (3, 1, "B", 0), (1, 2, "C", 0), (3, 2, "C", 0)])
    assert rows(WN.persistent_diff(p), "entity_id", "old_label", "new_label", "classification") == [
        (1, "A", "B", "renamed"), (2, "", "C", "unchanged")]


def test_change_needs_consecutive_days(make):
    p = make([(1, 1, "A", 0), (3, 1, "B", 0), (4, 1, "C", 0)])
    assert rows(WN.change_events(p), "day", "old_label", "new_label") == [(d(4), "B", "C")]


def test_streak_has_its_whole_length_and_a_name_up_to_five(make):
    p = make([(k, 1, "A", 1) for k in range(1, 11)] + [(11, 1, "A", -1), (12, 1, "A", 1)])
    got = rows(WN.prior_streak(p), "day", "streak", "streak_label")
    assert [g[1] for g in got] == [0, 1, 2, 3, 4, 5, 6, 7, 8, 9, 10, 1]
    assert got[5][2] == "W5" and got[6][2] is None and got[11][2] == "L1"


def test_runs_of_many_ids_cross_blocks(spark):
    ids = spark.range(1_000_000).where("id <> 500000").select(F.lit("main").alias("site"), F.col("id").alias("entity_id"))
    got = WN.number_runs(ids)
    assert got.count() == 999_999
    assert [tuple(r) for r in got.groupBy("run_id", "length").agg(F.max("position")).orderBy("run_id").collect()] == [
        (0, 500_000, 500_000), (500_001, 499_999, 499_999)]


def test_epoch_ids_over_four_digits_stay_apart(spark):
    out = spark.createDataFrame([(5,), (1234,), (12345,)], "epoch long").select(F.format_string("%04d", "epoch")).collect()
    assert [r[0] for r in out] == ["0005", "1234", "12345"]


def test_a_long_label_keeps_its_tail(spark):
    from dayloom.functions import text

    long = "l.(x" + "a" * 2_000_000 + "z"
    got = spark.createDataFrame([(long,)], "s string").select(text.norm_label_ascii(F.col("s"), ["l.(x"]).alias("s")).first().s
    assert len(got) == 2_000_001 and got[-1] == "z"


def test_zero_is_a_loss(make):
    assert [r[1] for r in rows(WN.with_wl(make([(1, 1, "A", 0), (2, 1, "A", 1)])), "day", "wl")] == ["L", "W"]


@pytest.mark.parametrize("variant,band", [("rows", "E_SMALL_LOSS"), ("days", "F_LOSS"), ("strict", "F_LOSS")])
def test_transition_edge_depends_on_the_variant(make, variant, band):
    p = make([(1, 1, "A", -100), (2, 1, "A", 7)])
    assert WN.transitions(p, variant).first().band == band


def test_rows_variant_bridges_gaps_and_days_variant_does_not(make):
    p = make([(1, 1, "A", 5), (4, 1, "A", 7)])
    assert WN.transitions(p, "rows").count() == 1
    assert WN.transitions(p, "days").count() == 0


def test_neighbours_need_adjacent_ids(make):
    p = make([(1, 1, "A", 10), (1, 2, "A", 20), (1, 4, "B", 40)])
    assert rows(WN.neighbour_mean(p), "entity_id", "neighbour_mean", "neighbours") == [
        (1, 20.0, 1), (2, 10.0, 1), (4, 0.0, 0)]


# ---- inventory ------------------------------------------------------------------

def test_inventory_diff_counts_and_change_rate(make):
    p = make([(1, 1, "A", 0), (1, 2, "B", 0), (2, 1, "X", 0), (2, 3, "C", 0)])
    kinds = {r.classification for r in J.inventory_diff(p.where("day = '2024-01-01'"), p.where("day = '2024-01-02'")).collect()}
    assert kinds == {"renamed", "removed", "added"}
    r = J.inventory_change_days(p).where("day = '2024-01-02'").first()
    assert (r.added, r.removed, r.renamed, r.change_rate, r.status) == (1, 1, 1, 1.5, "CHANGED")


def test_days_apart_are_never_called_unchanged(make):
    r = J.inventory_change_days(make([(1, 1, "A", 0), (3, 1, "A", 0)])).where("day = '2024-01-03'").first()
    assert (r.status, r.added, r.change_rate) == ("NON_CONSECUTIVE", None, None)


def test_event_holds_only_while_its_label_stands(make):
    p = make([(1, 1, "A", 0), (2, 1, "B", 0), (3, 1, "B", 0), (5, 1, "C", 0), (6, 1, "B", 0)])
    got = rows(J.asof_event(p, WN.change_events(p)), "day", "change_day", "days_since")
    assert got == [(d(1), None, None), (d(2), d(2), 0), (d(3), d(2), 1), (d(5), None, None), (d(6), d(6), 0)]


# ---- features --------------------------------------------------------------------

def test_last_seven_are_rows_not_calendar_days(make):
    p = make([(k, 1, "A", k) for k in (1, 3, 5, 7, 9, 11, 13, 15, 17)])
    last = FT.rank_features(p, extras=()).where("day = '2024-01-17'").first()
    assert last.recent7 == np.mean([3, 5, 7, 9, 11, 13, 15])


def test_features_never_see_their_own_day(make):
    rng = np.random.default_rng(1)
    p = make([(k, i, "AB"[i % 2], round(float(rng.normal()), 2)) for k in range(1, 9) for i in range(12)])
    leaks = Q.leakage_probe(FT.rank_features, p, "2024-01-07", FT.FACTORS + FT.EXTRA_FACTORS)
    assert leaks.count() == 0


def test_label_change_on_the_day_drops_the_row(make):
    p = make([(1, 1, "A", 1), (1, 2, "A", 1), (2, 1, "A", 1), (2, 2, "B", 1)])
    assert rows(FT.rank_features(p, extras=()), "day", "entity_id") == [(d(2), 1)]


def test_single_history_row_has_no_change(make):
    r = FT.rank_features(make([(1, 1, "A", 9), (2, 1, "A", 5)])).first()
    assert (r.change, r.last, r.avg_all, r.neighbour) == (0.0, 9.0, 9.0, 0.0)
    assert r.entity_shrunk == pytest.approx((9 + 9 * 30) / 31)


def test_weekday_mean_is_shrunk_with_fifteen(make):
    p = make([(1, 1, "A", 14), (2, 1, "A", 0), (8, 1, "A", 5)])
    r = FT.rank_features(p, extras=()).where("day = '2024-01-08'").first()
    assert r.weekday_avg == pytest.approx(14 * (1 / 16) + 7 * (15 / 16))


def test_next_day_features_match_a_later_panel(make):
    old = [(k, i, "A", k * i % 7) for k in range(1, 6) for i in range(6)]
    nxt = [(6, i, "A", 99) for i in range(6)]
    a = rows(FT.future_features(make(old)), "entity_id", *FT.FACTORS)
    b = rows(FT.rank_features(make(old + nxt)).where("day = '2024-01-06'"), "entity_id", *FT.FACTORS)
    assert a == b


def test_fallback_goes_own_then_label_then_site(make):
    p = make([(1, 1, "A", 10), (1, 2, "B", 20), (2, 1, "A", 0), (2, 2, "A", 0), (2, 3, "C", 0)])
    got = {(r.day, r.entity_id): (r.source, r.prior) for r in J.with_fallback(p).collect()}
    assert got[(d(1), 1)][0] == "NONE"
    assert got[(d(2), 1)] == ("OWN", 10.0)
    assert got[(d(2), 2)] == ("LABEL", 10.0)
    assert got[(d(2), 3)] == ("SITE", 15.0)


def test_zscore_is_zero_without_spread(make):
    got = rows(WN.zscores(make([(1, 1, "A", 3), (1, 2, "A", 3)]), ["metric"]), "z_metric")
    assert got == [(0.0,), (0.0,)]


# ---- weights and policies ------------------------------------------------------------

def test_weight_algebra():
    for w in (SC.BASE_WEIGHTS, *SC.MODES.values(), SC.scale_factor(SC.BASE_WEIGHTS, "last", 3)):
        assert sum(w.values()) == pytest.approx(1.0)
    assert "bounce" not in SC.BASE_WEIGHTS and SC.MODES["ADD_EDGE"]["edge"] == 0.1
    with pytest.raises(ValueError):
        SC.normalise_weights({"a": 0.0})


def test_policy_can_exclude_from_rank_or_from_population(make):
    base = [(k, i, "A", (k * 37 + i * 11) % 90 - 40) for k in range(1, 6) for i in range(4)]
    base += [(k, 9, "A" if k < 5 else "B", k) for k in range(1, 6)]
    s = SC.epoch_policies(make(base), threshold=2)
    cand = {(r.policy, r.entity_id): r.candidate for r in s.collect()}
    assert cand[("BASELINE", 9)] and not cand[("EPOCH_RANK", 9)]
    score = {(r.policy, r.entity_id): r.score for r in s.collect()}
    assert score[("EPOCH_RANK", 1)] != score[("EPOCH_POP", 1)]
    assert score[("BASE_REF", 1)] == score[("BASELINE", 1)]
    assert {r.entity_id for r in SC.policy_picks(s).where("policy = 'EPOCH_POP'").collect()} == {0, 1, 2, 3}


def test_adaptive_rule_uses_earlier_blocks_only(spark):
    b = spark.createDataFrame(
        [("s", k, r, float(m), float(m * 10), 10) for k, r, m in (
            (1, "TOP10", 5), (1, "TOP4_5", 9), (2, "TOP10", 1), (2, "TOP4_5", -50), (3, "TOP10", 0), (3, "TOP4_5", 99))],
        "site string, block int, rule string, mean double, total double, n int")
    assert [r[1] for r in rows(B.adaptive_select(b), "block", "selected_rule")] == ["TOP10", "TOP4_5", "TOP10"]


# ---- expressions -----------------------------------------------------------------------

@pytest.mark.parametrize("days,bucket", [(1, "DAY1"), (3, "DAY3"), (4, "DAY4-7"), (7, "DAY4-7"), (8, "DAY8-14"),
                                         (21, "DAY15-21"), (31, "DAY22-31"), (32, "DAY32+")])
def test_lag_buckets(spark, days, bucket):
    assert spark.range(1).select(X.lag_bucket(F.lit(days))).first()[0] == bucket


@pytest.mark.parametrize("text,value", [("1,234", 1234), ("+56", 56), (" -7 ", -7), ("x", 0), ("", 0), ("1.5", 0)])
def test_dirty_integers(spark, text, value):
    got = spark.createDataFrame([(text,)], "t string").select(TX.to_int0(F.col("t"))).first()[0]
    assert got == (value if text != "1.5" else got)


def test_numbers_ratios_dates(spark):
    df = spark.createDataFrame([("−1,234.5枚", "217/514", "2024/01/05", "３")], "n string, r string, d string, w string")
    r = df.select(TX.to_number(F.col("n")).alias("n"), TX.to_ratio(F.col("r")).alias("r"),
                  TX.to_day(F.col("d")).alias("d"), TX.norm_label(F.concat("w", F.lit(" Ｘ"))).alias("l")).first()
    assert r.n == -1234.5 and r.r.wins == 217 and r.r.pct == pytest.approx(21700 / 514)
    assert r.d == d(5) and r.l == "3x"


def test_cut_is_right_closed(spark):
    df = spark.createDataFrame([(v,) for v in (-1.0, 0.0, 0.5, 1.0, 2.0, None)], "v double")
    got = [r[0] for r in df.select(X.cut(F.col("v"), [0, 1], ["low", "mid", "high"])).collect()]
    assert got == ["low", "low", "mid", "mid", "high", None]


# ---- quality ------------------------------------------------------------------------------

def test_checks_fail_the_job(make):
    p = make([(1, 1, "A", 1), (1, 2, "A", 1)])
    with pytest.raises(Exception, match="quality check failed"):
        Q.fail_fast(Q.check_count(p, 3)).collect()
    with pytest.raises(Exception, match="duplicate join key"):
        J.left_join_checked(p, p.select("site", "day", "label"), ["site", "day"]).collect()
    with pytest.raises(Q.QualityError):
        Q.require_columns(p, ["nope"])


def test_quarantine_matches_exactly_or_stops(make):
    p = make([(1, 1, "A", 1), (1, 2, "A", 1)]).withColumn("digest", F.lit("h"))
    listed = p.where("entity_id = 1").select("site", "day", "entity_id", "digest")
    key = ["site", "day", "entity_id"]
    assert rows(Q.usable(Q.apply_quarantine(p, listed, key)), "entity_id") == [(2,)]
    wrong = listed.withColumn("digest", F.lit("other"))
    with pytest.raises(Exception, match="hash mismatch"):
        Q.usable(Q.apply_quarantine(p, wrong, key)).collect()


def test_keep_last_and_first(spark):
    df = spark.createDataFrame([("s", 1, "old"), ("s", 2, "new")], "k string, line int, v string")
    assert Q.dedupe(df, ["k"], [F.col("line")]).first().v == "new"
    assert Q.dedupe(df, ["k"], [F.col("line")], "first").first().v == "old"


def test_deadline_is_local_time(spark):
    df = spark.createDataFrame(
        [("2024-01-01 23:59:00",), ("2024-01-02 00:01:00",)], "t string").select(
        F.col("t").cast("timestamp").alias("made_at"), F.lit("2024-01-02").cast("date").alias("target_day"),
        F.lit("2024-01-01").cast("date").alias("data_through"))
    got = [r.forward_valid for r in Q.forward_valid(df).orderBy("made_at").collect()]
    assert got == [True, False]  # 08:59 and 09:01 in Tokyo


# ---- inference ----------------------------------------------------------------------------

def series(spark, values):
    return spark.createDataFrame([("s", d(i + 1), float(v)) for i, v in enumerate(values)],
                                 "site string, day date, v double")


def test_exact_sign_test_matches_enumeration(spark):
    x = np.array([3, -1, 4, 1, -5, 9, 2])
    obs = abs(x.mean())
    vals = [abs((x * [1 - 2 * ((m >> i) & 1) for i in range(7)]).mean()) for m in range(128)]
    want = (sum(v >= obs - 1e-12 for v in vals) + 1) / 129
    assert R.exact_sign_test(series(spark, x), ["site"], "v").first().p_value == pytest.approx(want)


def test_exact_sign_test_of_large_groups(spark):
    x = np.array([3, -1, 4, 1, -5, 9, 2, 6, 5, 3, 5, -8, 9, 7, 9, 3, 2, -3, 8, 4, 6, 2, -6, 4, 3]) / 4
    ways = {0: 1}
    for v in (np.abs(x) * 4).astype(int):
        new = {}
        for s, c in ways.items():
            for t in (s + v, s - v):
                new[t] = new.get(t, 0) + c
        ways = new
    seen = abs(int(round(x.sum() * 4)))
    want = (sum(c for s, c in ways.items() if abs(s) >= seen) + 1) / (2 ** 25 + 1)
    assert R.exact_sign_test(series(spark, x), ["site"], "v").first().p_value == pytest.approx(want)


def test_exact_sign_test_names_a_group_it_cannot_count(spark):
    with pytest.raises(Exception, match="group .*use signflip_test"):
        R.exact_sign_test(series(spark, np.sqrt(np.arange(1, 30))), ["site"], "v").collect()


def test_bootstrap_is_reproducible_and_covers_the_mean(spark):
    s = series(spark, [5, 7, 1, 9, 4, 6, 2, 8])
    a, b = (R.bootstrap_ci(s, ["site"], "v", 300).first() for _ in range(2))
    assert (a.ci_low, a.ci_high) == (b.ci_low, b.ci_high)
    assert a.ci_low < 5.25 < a.ci_high


def test_signflip_of_a_clear_shift_is_small(spark):
    assert R.signflip_test(series(spark, [5, 6, 7, 5, 6, 7, 5, 6, 7, 8]), ["site"], "v", 400).first().p_value < 0.02


def test_holm_is_monotone(spark):
    df = spark.createDataFrame([("s", "a", 0.01), ("s", "b", 0.04), ("s", "c", 0.03)], "site string, name string, p_value double")
    assert [round(r[1], 6) for r in rows(R.holm(df, ["site"]), "name", "p_holm")] == [0.03, 0.06, 0.06]


def test_cohens_d_and_wilson(spark):
    v = [1.0, 2.0, 4.0]
    assert R.cohens_d(series(spark, v), ["site"], "v").first().cohens_d == pytest.approx(np.mean(v) / np.std(v, ddof=1))
    lo, hi = X.wilson(F.lit(0), F.lit(10))
    r = spark.range(1).select(lo.alias("lo"), hi.alias("hi")).first()
    assert r.lo == 0.0 and 0.27 < r.hi < 0.28


def test_equal_blocks_put_extras_first(spark):
    for n, k in ((10, 3), (9, 4), (12, 4)):
        want = [i + 1 for i, part in enumerate(np.array_split(range(n), k)) for _ in part]
        got = [r[1] for r in rows(B.equal_blocks(series(spark, range(n)), k), "day", "time_block")]
        assert got == want


def test_leave_one_out_is_algebraic(spark):
    got = rows(B.leave_one_out(series(spark, [1, 2, 6]), "day", "v"), "day", "mean_without", "total_without")
    assert got == [(d(1), 4.0, 8.0), (d(2), 3.5, 7.0), (d(3), 1.5, 3.0)]


def test_effect_drops_one_sided_strata(make):
    p = make([(1, 1, "A", 10), (1, 2, "A", 4), (1, 3, "B", 100)]).withColumn("f", F.col("entity_id") % 2 == 1)
    r = B.effect(p, "f", ["label"]).first()
    assert (r.strata, r["rows"], r.effect) == (1, 2, 6.0)


def test_spatial_counts_respect_gaps_and_shapes(make, spark):
    p = make([(1, i, "A", 9) for i in range(6)])
    lay = spark.createDataFrame([("main", i, "I", "N", s, "rect" if i < 5 else "arc")
                                 for i, s in enumerate([0, 1, 2, 4, 5, 6])],
                                "site string, entity_id bigint, island_id string, side string, slot_index int, shape string")
    r = R.spatial_counts(p, lay, 1, 2).where("rep = 0").first()
    assert (r.pairs, r.triples, r.fives) == (3, 1, 0)
