"""Distributed ordering against plain pandas / NumPy on skewed data."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from dayloom.operators import aggregates as A
from dayloom.operators import ordering as O
from dayloom.operators import topk as K
from dayloom.operators import windows as WN


@pytest.fixture(scope="module")
def skewed():
    rng = np.random.default_rng(7)
    n = 3000
    g = np.where(rng.random(n) < 0.6, "hot", rng.choice(list("abc"), n))
    v = np.where(rng.random(n) < 0.4, 0.0, np.round(rng.normal(0, 50, n), 1))
    return pd.DataFrame({"site": "s", "g": g, "v": v, "id": rng.permutation(n)})


def test_position_matches_a_sort(spark, skewed):
    df = spark.createDataFrame(skewed)
    got = O.position(df, ["g"], [F.col("v").desc(), F.col("id").asc()], "rn", "n").toPandas()
    want = skewed.sort_values(["g", "v", "id"], ascending=[True, False, True]).copy()
    want["rn"] = want.groupby("g").cumcount() + 1
    m = got.merge(want[["id", "rn"]], on="id", suffixes=("", "_w"))
    assert (m.rn == m.rn_w).all()
    assert (m.n == m.g.map(skewed.g.value_counts())).all()


def test_exact_quantiles(spark, skewed):
    qs = {"p10": 0.1, "q25": 0.25, "mid": 0.5, "p95": 0.95}
    got = O.exact_quantiles(spark.createDataFrame(skewed), ["g"], "v", qs).toPandas().set_index("g")
    for g, part in skewed.groupby("g"):
        for name, q in qs.items():
            assert got.loc[g, name] == pytest.approx(np.quantile(part.v, q))


def test_average_ranks(spark, skewed):
    got = O.rank_positions(spark.createDataFrame(skewed), ["g"], "v").toPandas().set_index("id")
    want = skewed.set_index("id").groupby("g")["v"].rank()
    assert np.allclose(got["avg_rank"].sort_index(), want.sort_index())


def test_spearman(spark, skewed):
    x = skewed.assign(w=skewed.v * 2 + skewed.id % 17)
    got = A.spearman(spark.createDataFrame(x), "v", "w", ["site"]).toPandas()
    assert got.spearman[0] == pytest.approx(x["v"].rank().corr(x["w"].rank()))


def test_quintiles_follow_qcut_of_first_ranks(spark):
    for n in (5, 7, 23, 100):
        ranks = pd.Series(range(1, n + 1))
        want = (pd.qcut(ranks, 5, labels=False) + 1).tolist()
        df = spark.createDataFrame(pd.DataFrame({"rn": ranks, "n": n}))
        got = df.orderBy("rn").select(A.quintile_of(F.col("rn"), F.col("n")).alias("q")).toPandas().q.tolist()
        assert got == want


def test_islands_cross_block_borders(spark):
    ids = [1, 2, 3, 7, 9, 10, 11, 12, 13, 20]
    df = spark.createDataFrame([("s", i) for i in ids], "site string, entity_id bigint")
    want = {(1, 3), (7, 7), (9, 13), (20, 20)}
    for block in (2, 3, 4, 4096):
        got = {(r.start_id, r.end_id) for r in WN.islands(df, ["site"], block).collect()}
        assert got == want, block
        g = {(r.after_id, r.before_id, r.missing) for r in WN.gaps(df, block).collect()}
        assert g == {(3, 7, 3), (7, 9, 1), (13, 20, 6)}, block


def test_runs_cross_block_borders(make, monkeypatch):
    p = make([(1, i, "A", 5) for i in (4094, 4095, 4096, 4097, 4099)])
    got = sorted((r.start_id, r.end_id) for r in WN.runs(p, 3).collect())
    assert got == [(4094, 4096), (4095, 4097)]


def test_score_bands_are_cumulative_ceilings(spark):
    df = spark.createDataFrame([("s", "2024-01-01", i, float(-i)) for i in range(1, 51)],
                               "site string, day string, entity_id bigint, score double")
    got = K.score_bands(df).groupBy("score_band").count().toPandas().set_index("score_band")["count"].to_dict()
    # ceil of 50 x 1, 2, 5, 10, 20, 30, 50 %: 1, 1, 3, 5, 10, 15, 25
    assert got == {"TOP1": 1, "TOP5": 2, "TOP10": 2, "TOP20": 5, "TOP30": 5, "TOP50": 10, "BOTTOM50": 25}


@pytest.mark.parametrize("hot, values", [(50, 1), (7, 1000), (10 ** 6, 10)])
def test_hot_values_are_dealt_over_copies_of_their_rank(spark, skewed, monkeypatch, hot, values):
    monkeypatch.setattr(O, "HOT", hot)
    monkeypatch.setattr(O, "HOT_VALUES", values)
    x = pd.concat([skewed, skewed.iloc[:5]]).assign(v=lambda d: d.v.where(d.v != d.v.max()))  # repeated rows and nulls
    got = O.rank_positions(spark.createDataFrame(x.astype({"v": "float64"})).withColumn("v", F.nanvl("v", F.lit(None))), ["g"], "v").toPandas()
    assert len(got) == len(x)
    known = got[got.v.notna()]
    nulls = got[got.v.isna()].groupby("g").size().reindex(got.g.unique()).fillna(0)
    want = known.groupby("g")["v"].rank() + known.g.map(nulls)  # nulls stand first
    assert np.allclose(known.avg_rank, want)


@pytest.mark.parametrize("cells", [10 ** 6, 0])
def test_group_values_reach_all_rows(spark, skewed, monkeypatch, cells):
    monkeypatch.setattr(O, "SMALL", cells)
    df = spark.createDataFrame(skewed)
    small = df.groupBy("g").agg(F.count(F.lit(1)).alias("k")).where("g <> 'a'")
    for how in ("inner", "left"):
        got = O.attach(df, small, ["g"], how).toPandas()
        want = skewed.merge(small.toPandas(), on="g", how=how)
        assert list(got.columns) == ["g", "site", "v", "id", "k"]
        assert got.sort_values("id").k.fillna(-1).tolist() == want.sort_values("id").k.fillna(-1).tolist()


def test_no_rows_are_gathered_by_site_alone(spark, make, monkeypatch):
    """With no room for ordinary broadcasts, the plans exchange data on site or day only for tables of one row a group."""
    from dayloom.operators import joins as J
    from dayloom.operators import scoring as SC

    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        p = make([(d, i, "AB"[i % 2], i * d % 7) for d in (1, 2, 3) for i in range(30)])
        blocks = p.groupBy("site").agg(F.min("day").alias("start_day"), F.max("day").alias("end_day")).withColumn("block", F.lit(1))
        for df in (A.median_split(p, "metric"), WN.normalise(p, "metric", 0, 7), WN.zscores(p, ["metric"]), J.assign_blocks(p, blocks),
                   SC.neutral_fill(p, ["metric"]), A.shrunk(p, ["entity_id"])):
            df.collect()
            plan = df._jdf.queryExecution().executedPlan().toString()
            assert "SortMergeJoin" not in plan and "ShuffledHashJoin" not in plan and "BroadcastHashJoin" in plan
            assert "Cartesian" not in plan and "BroadcastNestedLoop" not in plan
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
