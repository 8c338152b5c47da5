"""Out-of-sample evaluation: rolling splits, walk-forward, adaptive rules, weight search, stability."""

from __future__ import annotations

import functools
from collections.abc import Mapping, Sequence

import numpy as np
import pandas as pd
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from dayloom.functions import expr as X
from dayloom.operators import aggregates as A
from dayloom.operators import deals as D
from dayloom.operators import features as FT
from dayloom.operators import joins as J
from dayloom.operators import ordering as O
from dayloom.operators import quality as Q
from dayloom.operators import scoring as SC
from dayloom.operators import windows as WN
from dayloom.operators.aggregates import rate
from dayloom.panel import DAY, KEY, SITE
from dayloom.session import materialise


def daily_models(panel: DataFrame, models: Mapping[str, Mapping[str, float]],
                 bands: Sequence[tuple[str, int, int]] = (("TOP10", 1, 10),), n: int = 10) -> DataFrame:
    """Features of all days once, every model's picks, one evaluation row per (day, model, band)."""
    extras = [f for f in FT.EXTRA_FACTORS if any(f in w for w in models.values())]
    feats = materialise(FT.rank_features(panel, extras=extras))
    picks = O.top_n(SC.score_modes(feats, models), [*DAY, "model"], SC.best_first(), n)
    return A.evaluate_topn(picks, panel, bands, by=["model"])


def split_summary(daily: DataFrame, splits: DataFrame) -> DataFrame:
    return J.assign_blocks(daily, splits).groupBy(*SITE, "block", "model", "band").agg(
        F.count(F.lit(1)).alias("days"), F.avg("mean").alias("mean"), F.avg("win_rate").alias("win_rate"),
        F.sum("total").alias("total"), rate(F.col("total") > 0).alias("positive_days"))


def rolling_oos(daily: DataFrame, splits: DataFrame) -> DataFrame:
    """Overall row per model: averages over test days, worst split and share of positive splits."""
    s = split_summary(daily, splits).groupBy(*SITE, "model", "band").agg(
        F.min("mean").alias("min_split_mean"), rate(F.col("total") > 0).alias("positive_splits"))
    tested = J.assign_blocks(daily, splits)
    o = tested.groupBy(*SITE, "model", "band").agg(
        F.count(F.lit(1)).alias("days"), F.avg("mean").alias("mean"), F.sum("total").alias("total"),
        rate(F.col("total") > 0).alias("positive_days"))
    return o.join(s, [*SITE, "model", "band"])


def walk_forward(df: DataFrame, min_days: int, n: int = 10, t: float = 100) -> DataFrame:
    """Expanding walk-forward of several signals over the days after a warm-up."""
    x = SC.simple_blend(df, t)
    days = df.select(*DAY).distinct().withColumn("_d", F.row_number().over(Window.partitionBy(*SITE).orderBy("day")))
    signals = {"BLEND": "blend", "AVERAGE": "avg_all", "RECENT7": "recent7", "WEEKDAY": "weekday_mean"}
    rows = F.array(*[F.struct(F.lit(m).alias("model"), X.rank_key(F.col(c)).alias("score")) for m, c in signals.items()])
    long = x.join(days, DAY).where(F.col("_d") > min_days).withColumn("_m", F.explode(rows)).select(
        *KEY, "label", "metric", "_m.*")
    picks = O.top_n(long, [*DAY, "model"], SC.best_first(), n)
    return A.evaluate_topn(picks, df, [("TOP", 1, n)], by=["model"])


# ---- blocks and adaptive rules ---------------------------------------------------

RULES = (("TOP10", 1, 10), ("TOP4_10", 4, 10), ("TOP4_5", 4, 5), ("TOP4_8", 4, 8), ("TOP5_10", 5, 10),
         ("TOP6_10", 6, 10))


def with_blocks(daily: DataFrame, size: int = 4) -> DataFrame:
    """Number blocks of ``size`` observed days (calendar gaps do not count)."""
    days = daily.select(*DAY).distinct()
    b = days.withColumn("block", F.floor((F.row_number().over(
        Window.partitionBy(*SITE).orderBy("day")) - 1) / size) + 1)
    return daily.join(b, DAY)


def rule_blocks(daily: DataFrame, size: int = 4) -> DataFrame:
    """One row per (rule, block) from one row per (day, band)."""
    return with_blocks(daily, size).groupBy(*SITE, "block", F.col("band").alias("rule")).agg(
        F.count(F.lit(1)).alias("days"), F.avg("mean").alias("mean"), F.sum("total").alias("total"),
        F.sum("n").alias("n"))


def adaptive_select(blocks: DataFrame, order: Sequence[str] = tuple(r[0] for r in RULES)) -> DataFrame:
    """Rule chosen per block from completed earlier blocks only; the first block takes the first rule.

    Ties go to the larger total, then more positive blocks, then the fixed rule order.
    """
    past = Window.partitionBy(*SITE, "rule").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    place = F.array_position(F.array(*[F.lit(r) for r in order]), F.col("rule"))
    x = blocks.withColumns({
        "prior_mean": X.rank_key(F.avg("mean").over(past)), "prior_total": X.rank_key(F.sum("total").over(past)),
        "prior_positive": F.sum((F.col("mean") > 0).cast("int")).over(past), "prior_blocks": F.count("mean").over(past),
        "_o": place})
    best = Window.partitionBy(*SITE, "block").orderBy(
        F.col("prior_mean").desc_nulls_last(), F.col("prior_total").desc_nulls_last(),
        F.col("prior_positive").desc_nulls_last(), "_o")
    return x.withColumn("_r", F.row_number().over(best)).where("_r = 1").select(
        *SITE, "block", F.col("rule").alias("selected_rule"), "prior_blocks", "mean", "total", "n",
        F.when(F.col("prior_blocks") == 0, "NO_PRIOR").otherwise("PRIOR_BEST").alias("reason"))


def adaptive_summary(blocks: DataFrame) -> DataFrame:
    """The adaptive rule beside every fixed rule."""
    fixed = blocks.select(*SITE, "block", "rule", "mean", "total", "n")
    chosen = adaptive_select(blocks).select(*SITE, "block", F.lit("ADAPTIVE").alias("rule"), "mean", "total", "n")
    return fixed.unionByName(chosen).groupBy(*SITE, "rule").agg(
        F.count(F.lit(1)).alias("blocks"), F.avg("mean").alias("mean"), F.sum("total").alias("total"),
        rate(F.col("mean") > 0).alias("positive_blocks"), (F.sum("total") / F.sum("n")).alias("per_entity"))


def edge_blocks(blocks: DataFrame, rule: str = "TOP4_5", base: str = "TOP10") -> DataFrame:
    """One row per block: edge of a rule over the base rule, with prior-block features."""
    one = lambda r, c: F.max(F.when(F.col("rule") == r, F.col(c)))
    wide = blocks.groupBy(*SITE, "block").agg(
        one(rule, "mean").alias("rule_mean"), one(rule, "total").alias("rule_total"),
        one(base, "mean").alias("base_mean"), one(base, "total").alias("base_total"))
    wide = wide.withColumn("edge", X.rank_key(F.col("rule_mean") - F.col("base_mean")))
    return WN.prior_block_features(wide)


# Parameter rows: the prior-block features that must all reach a share of the threshold (0: be positive).
SWITCHES = [(("prior_last",), 0.0), (("prior_last",), 0.3), (("prior_last",), 0.5), (("prior_last",), 0.75), (("prior_last2",), 0.0),
            (("prior_last2",), 0.3), (("prior_last", "prior_last2"), 0.0), (("prior_last", "prior_last3"), 0.0)]


def switch_name(fields: Sequence[str], share: float) -> str:
    return "_and_".join(f.removeprefix("prior_") for f in fields) + (f"_from_{share:g}" if share else "_positive")


def switch_candidates(edges: DataFrame, t: float = 100, min_prior: int = 2, switches=SWITCHES) -> DataFrame:
    """Triggers on the prior edge, a row of ``switches`` each, against always staying with the base rule."""
    rules = {}
    for fields, share in switches:
        tests = [F.col(f) >= share * t if share else F.col(f) > 0 for f in fields]
        rules[switch_name(fields, share)] = functools.reduce(lambda a, b: a & b, tests)
    ready = F.col("prior_blocks") >= min_prior
    rows = F.array(*[F.struct(F.lit(n).alias("candidate"), F.coalesce(ready & c, F.lit(False)).alias("switch"))
                     for n, c in rules.items()])
    x = edges.withColumn("_c", F.explode(rows)).select("*", "_c.*").withColumn(
        "selected_total", F.when(F.col("switch"), F.col("rule_total")).otherwise(F.col("base_total")))
    gain = F.col("selected_total") - F.col("base_total")
    sw = F.col("switch")
    return x.groupBy(*SITE, "candidate").agg(
        F.count(F.lit(1)).alias("blocks"), F.count_if(sw).alias("switches"), F.sum("selected_total").alias("total"),
        F.sum("base_total").alias("base_total"), F.sum(gain).alias("gain"),
        F.avg(F.when(sw, gain)).alias("mean_gain"), F.count_if(sw & (gain > 0)).alias("good"),
        F.count_if(sw & (gain < 0)).alias("bad"))


# ---- weight search -----------------------------------------------------------------

def random_weights(spark: SparkSession, k: int, factors: Sequence[str], seed: str = "w") -> DataFrame:
    """k points of a flat Dirichlet from hashed uniforms: one array of weights per pattern."""
    raw = F.array(*[-F.log(1 - X.uniform(F.col("model"), f, seed)) for f in factors])
    x = spark.range(k).select(F.col("id").cast("string").alias("model")).withColumn("_r", raw)
    total = F.aggregate("_r", F.lit(0.0), lambda s, v: s + v)
    return x.select("model", F.transform("_r", lambda v: v / total).alias("w"))


PATTERNS = 256  # patterns whose best rows a task keeps together
ROWS = 2048  # rows that one matrix product takes
SLICE = 32  # packed lists that leave a task at once
TASKS = 32  # tasks next to one another whose lists are merged before those of all


def _best_rows(scores: np.ndarray, ids: np.ndarray, n: int) -> np.ndarray:
    """Places of each column's n best scores, ties to the smaller id: rows x columns in, n (or all) x columns out."""
    order = np.argsort(ids, kind="stable")
    first = np.argsort(-scores[order], axis=0, kind="stable")[:n]
    return order[first]


def pattern_picks(feats: DataFrame, vectors: DataFrame, factors: Sequence[str], n: int) -> DataFrame:
    """(day, model, entity_id, metric, score): the n best of each day for each weight vector, packed by blocks of patterns.

    The weights are a table of k short rows. A task multiplies blocks of rows
    with blocks of PATTERNS weight vectors and keeps n rows for each day and
    pattern; only these leave it, as packed arrays, and are merged by (day, block),
    of TASKS tasks first: a merge of all would hold a list for each task.
    """
    spark = feats.sparkSession
    parts = SC.components(feats, factors)
    table = vectors.orderBy(F.col("model").cast("long")).toPandas()  # k vectors of a few factors: a parameter
    kept = spark.sparkContext.broadcast((table["model"].to_numpy(), np.array(table["w"].tolist(), np.float64).reshape(len(table), -1)))

    cols = [*DAY, "block", "part", "ids", "metrics", "scores", "size"]
    kinds = "site string, day date, block int, part int, ids binary, metrics binary, scores binary, size int"

    def pack(key, block, part, ids, metric, score):
        return [*key, block, part, ids.astype(np.int64).tobytes(), metric.astype(np.float64).tobytes(), score.astype(np.float64).tobytes(), ids.shape[0]]

    def emptied(held):
        part = TaskContext.get().partitionId() // TASKS
        while held:
            some = [held.popitem() for _ in range(min(SLICE, len(held)))]
            yield pd.DataFrame([pack(k[:2], k[2], part, *v) for k, v in some], columns=cols)

    def best(frames):
        held: dict[tuple, tuple] = {}
        models, w = kept.value
        for pdf in frames:
            for key, own in pdf.groupby(DAY, sort=False, dropna=False):
                for at in range(0, len(own), ROWS):
                    some = own.iloc[at:at + ROWS]
                    x, ids, metric = np.stack(list(some["comp"])), some["entity_id"].to_numpy(), some["metric"].to_numpy(np.float64)
                    for block in range(0, len(models), PATTERNS):
                        part = w[block:block + PATTERNS]
                        score = np.zeros((len(x), len(part)))
                        for i in range(x.shape[1]):  # one factor after the other, as a row at a time would add them
                            score += x[:, i:i + 1] * part[:, i]
                        score = np.round(score, 9)
                        top = _best_rows(score, ids, n)
                        new = (ids[top], metric[top], np.take_along_axis(score, top, 0))
                        old = held.get((*key, block))
                        held[(*key, block)] = new if old is None else _merged([old, new], n)
            if len(held) * PATTERNS * n > 1 << 22:
                yield from emptied(held)
        yield from emptied(held)

    def joined(pdf: pd.DataFrame) -> tuple:
        lists = (tuple(np.frombuffer(b, t).reshape(r.size, -1) for b, t in ((r.ids, np.int64), (r.metrics, np.float64), (r.scores, np.float64)))
                 for r in pdf.itertuples(index=False, name="Row"))
        return functools.reduce(lambda a, b: _merged([a, b], n), lists)

    def some(key, pdf: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame([pack(key[:2], key[2], key[3], *joined(pdf))], columns=cols)

    def merge(key, pdf: pd.DataFrame) -> pd.DataFrame:
        models = kept.value[0][key[2]:key[2] + PATTERNS]
        ids, metric, score = joined(pdf)
        rank = np.repeat(np.arange(1, len(ids) + 1, dtype=np.int32), len(models))
        return pd.DataFrame({"site": key[0], "day": key[1], "model": np.tile(models, len(ids)), "rank": rank,
                             "entity_id": ids.ravel(), "metric": metric.ravel(), "score": score.ravel()})

    packed = parts.select(*DAY, "entity_id", F.col("metric").cast("double").alias("metric"), "comp").mapInPandas(best, kinds)
    fewer = packed.groupBy(*DAY, "block", "part").applyInPandas(some, kinds)
    return fewer.groupBy(*DAY, "block").applyInPandas(merge, "site string, day date, model string, rank int, entity_id long, metric double, score double")


def _merged(lists: list[tuple], n: int) -> tuple:
    """The n best of several (ids, metric, score) lists of the same patterns."""
    ids, metric, score = (np.concatenate(x) for x in zip(*lists))
    order = np.lexsort((ids, -score), axis=0)[:n]
    return tuple(np.take_along_axis(a, order, 0) for a in (ids, metric, score))


def daily_objective(feats: DataFrame, vectors: DataFrame, factors: Sequence[str], population: DataFrame,
                    n1: int = 10, n2: int = 30) -> DataFrame:
    """Per (pattern, day): lift of the n1 and n2 best over the day and the composite objective."""
    picks = pattern_picks(feats, vectors, factors, n2)
    m = F.col("metric")
    day = population.groupBy(*DAY).agg(F.avg(m).alias("_pop"))
    g = picks.groupBy(*DAY, "model").agg(F.avg(F.when(F.col("rank") <= n1, m)).alias("mean1"), F.avg(m).alias("mean2"))
    x = g.join(day, DAY).withColumns({"lift1": F.col("mean1") - F.col("_pop"), "lift2": F.col("mean2") - F.col("_pop")})
    pos = lambda c: (F.col(c) > 0).cast("int") * 100.0
    return x.withColumn("objective", F.col("lift1") * 0.4 + F.col("lift2") * 0.25 + pos("mean1") * 5 * 0.2
                        + pos("mean2") * 5 * 0.15).drop("_pop")


def weight_search(objective: DataFrame) -> DataFrame:
    """Objective per pattern over all days, best first."""
    g = objective.groupBy(*SITE, "model").agg(
        F.count(F.lit(1)).alias("days"), F.avg("lift1").alias("lift1"), F.avg("lift2").alias("lift2"),
        X.rank_key(F.avg("objective")).alias("objective"))
    w = Window.partitionBy(*SITE).orderBy(F.desc("objective"), F.col("model").cast("int"))  # one row per pattern
    return g.withColumn("position", F.row_number().over(w))


def walk_forward_weights(objective: DataFrame, min_train: int = 5) -> DataFrame:
    """Each day uses the pattern with the best mean objective over earlier days."""
    past = Window.partitionBy(*SITE, "model").orderBy("day").rowsBetween(Window.unboundedPreceding, -1)
    x = objective.withColumns({"train_days": F.count("objective").over(past),
                               "train_objective": X.rank_key(F.avg("objective").over(past))})
    best = F.max_by(F.struct("model", "train_days", "train_objective", "mean1", "lift1"),
                    F.struct("train_objective", -F.col("model").cast("int")))
    return x.where(F.col("train_days") >= min_train).groupBy(*DAY).agg(best.alias("b")).select(*DAY, "b.*")


def overfit_gap(daily: DataFrame, split_day: str) -> DataFrame:
    """Mean before and from the split day, and the gap, per model and band."""
    early = F.col("day") < F.lit(split_day).cast("date")
    m = F.col("mean")
    return daily.groupBy(*SITE, "model", "band").agg(
        F.avg(F.when(early, m)).alias("train_mean"), F.avg(F.when(~early, m)).alias("test_mean")
    ).withColumn("gap", F.col("train_mean") - F.col("test_mean"))


def robust_factors(ranked: DataFrame, vectors: DataFrame, factors: Sequence[str], groups=(5, 10, 20)) -> DataFrame:
    """How steadily each factor is weighted among the best 5 / 10 / 20 patterns."""
    best = ranked.where(F.col("position") <= max(groups)).join(vectors, "model")
    parts = F.array(*[F.struct(F.lit(f).alias("factor"), F.col("w")[i].alias("weight")) for i, f in enumerate(factors)])
    long = best.withColumn("_p", F.explode(parts)).withColumn(
        "group", F.explode(F.array(*[F.lit(g) for g in groups]))).where("position <= group").select(
        *SITE, "group", "_p.*")
    g = long.groupBy(*SITE, "group", "factor").agg(
        F.avg("weight").alias("m"), F.stddev_pop("weight").alias("s"),
        (rate(F.col("weight") >= 0.1) * 100).alias("h"), (rate(F.col("weight") >= 0.15) * 100).alias("v"))
    return g.groupBy(*SITE, "factor").agg(
        F.avg("m").alias("mean_weight"), F.stddev_pop("m").alias("group_sd"), F.avg("s").alias("pattern_sd"),
        F.avg("h").alias("high_rate"), F.avg("v").alias("very_high_rate")
    ).withColumn("robust", F.col("mean_weight") * 100 + F.col("high_rate") * 0.2 + F.col("very_high_rate") * 0.1
                 - F.col("group_sd") * 100 - F.col("pattern_sd") * 50)


def random_baseline(panel: DataFrame, picks: DataFrame, reps: int, n: int = 10, seed: str = "r") -> DataFrame:
    """Share of random n-sets of the day that do worse than the picks.

    Only the n drawn row numbers of each (day, rep) are made and meet the numbered rows.
    """
    rows = O.position(panel.select(*KEY, "metric"), DAY, [F.col("entity_id")], "_number", "_n").withColumn("_number", F.col("_number") - 1)
    groups = panel.groupBy(*DAY).agg(F.count(F.lit(1)).alias("_n")).withColumn("_key", D.key_of(F.col("day"), seed))
    drawn = D.draws(groups, DAY, n, reps).join(rows.select(*DAY, "_number", "metric"), [*DAY, "_number"])
    sample = drawn.groupBy(*DAY, "rep").agg(X.rank_key(F.avg("metric")).alias("sample_mean"))
    real = picks.groupBy(*DAY).agg(X.rank_key(F.avg("metric")).alias("pick_mean"))
    return sample.join(real, DAY).groupBy(*DAY).agg(
        F.count(F.lit(1)).alias("reps"), F.avg("sample_mean").alias("random_mean"),
        F.max("pick_mean").alias("pick_mean"), rate(F.col("sample_mean") < F.col("pick_mean")).alias("percentile"))


# ---- leave-one-out, effects ----------------------------------------------------------

def leave_one_out(series: DataFrame, unit: str, value: str, by: Sequence[str] = SITE) -> DataFrame:
    """Mean and total without each unit, from group totals; marks a change of direction."""
    v = F.col(value)
    tot = series.groupBy(*by).agg(F.sum(v).alias("_s"), F.count(v).alias("_n"))
    x = series.join(tot, list(by))
    return x.select(
        *by, unit, v.alias("value"), F.try_divide(F.col("_s") - v, F.col("_n") - 1).alias("mean_without"),
        (F.col("_s") - v).alias("total_without"),
        (F.signum(X.rank_key(F.col("_s") - v)) != F.signum(X.rank_key(F.col("_s")))).alias("flips"))


def leave_group_out(df: DataFrame, unit: str, by: Sequence[str] = SITE) -> DataFrame:
    """Mean over all rows outside each group, from group sums."""
    g = df.groupBy(*by, unit).agg(F.sum("metric").alias("_gs"), F.count("metric").alias("_gn"))
    t = g.groupBy(*by).agg(F.sum("_gs").alias("_s"), F.sum("_gn").alias("_n"))
    return g.join(t, list(by)).select(
        *by, unit, F.col("_gn").alias("removed"),
        F.try_divide(F.col("_s") - F.col("_gs"), F.col("_n") - F.col("_gn")).alias("mean_without"))


def effect(df: DataFrame, flag: str, strata: Sequence[str] = (), by: Sequence[str] = DAY) -> DataFrame:
    """Flagged minus unflagged mean inside each stratum of the day, weighted by the stratum's rows.

    Strata missing one side are dropped before the weights are formed.
    """
    m, f = F.col("metric"), F.col(flag)
    g = df.groupBy(*by, *strata).agg(
        F.count(F.lit(1)).alias("n"), F.avg(F.when(f, m)).alias("_on"), F.avg(F.when(~f, m)).alias("_off"))
    g = g.where(F.col("_on").isNotNull() & F.col("_off").isNotNull()).withColumn(
        "effect", F.col("_on") - F.col("_off"))
    return g.groupBy(*by).agg(
        F.count(F.lit(1)).alias("strata"), F.sum("n").alias("rows"),
        (F.sum(F.col("effect") * F.col("n")) / F.sum("n")).alias("effect"))


def effect_summary(daily_effect: DataFrame, by: Sequence[str] = SITE) -> DataFrame:
    e = F.col("effect")
    return daily_effect.groupBy(*by).agg(
        F.count(e).alias("days"), F.avg(e).alias("mean_effect"), rate(e > 0).alias("positive_days"),
        F.min(e).alias("lo"), F.max(e).alias("hi"))


def effect_sensitivity(df: DataFrame, flag: str, scenarios: Mapping[str, Column], strata: Sequence[str] = ()) -> DataFrame:
    """The effect with rows kept by each scenario's predicate, all scenarios in one pass."""
    keep = F.array_compact(F.array(*[F.when(c, F.lit(n)) for n, c in scenarios.items()]))
    x = df.withColumn("scenario", F.explode(keep))
    return effect_summary(effect(x, flag, strata, [*DAY, "scenario"]), [*SITE, "scenario"])


def equal_blocks(daily: DataFrame, k: int) -> DataFrame:
    """Split an ordered day series into k nearly equal blocks, larger blocks first."""
    w = Window.partitionBy(*SITE)
    n = F.count(F.lit(1)).over(w)
    r = F.row_number().over(w.orderBy("day")) - 1
    x = daily.withColumns({"_n": n, "_r": r})
    big, small = F.floor(F.col("_n") / k) + 1, F.floor(F.col("_n") / k)
    extra = F.col("_n") % k
    return x.withColumn("time_block", F.when(
        F.col("_r") < extra * big, F.floor(F.col("_r") / big)).otherwise(
        extra + F.floor((F.col("_r") - extra * big) / small)) + 1).drop("_n", "_r")


# ---- comparisons, verdicts, frozen picks -------------------------------------------------

def champion_challenger(pairs: DataFrame, ci: DataFrame, min_days: int) -> DataFrame:
    """Paired summary with bootstrap CI and the review status ladder."""
    s = A.paired_summary(pairs, "change", [*SITE, "model"]).join(ci, [*SITE, "model"])
    return s.withColumn("status", Q.status([
        (F.col("pairs") < min_days, "ACCUMULATING"),
        ((F.col("total_change") > 0) & (F.col("better") > F.col("worse")) & (F.col("ci_low") > 0), "STRONG"),
        (F.col("total_change") > 0, "POSITIVE")], "NO_ADVANTAGE"))


def external_validation(daily: DataFrame, ci: DataFrame, by: Sequence[str] = (*SITE, "band")) -> DataFrame:
    """Lift over the site per band, its bootstrap CI, leave-one-day-out reversal and the verdict."""
    by = list(by)
    lo = leave_one_out(daily, "day", "excess", by).groupBy(*by).agg(
        F.max(F.col("flips").cast("int")).alias("reverses"), F.min("mean_without").alias("loo_min"),
        F.max("mean_without").alias("loo_max"))
    s = daily.groupBy(*by).agg(
        F.count(F.lit(1)).alias("days"), F.avg("mean").alias("mean"), F.avg("excess").alias("mean_lift"),
        rate(F.col("mean") > 0).alias("positive_days"))
    up = F.col("mean_lift") > 0
    return s.join(lo, by).join(ci, by).withColumn("verdict", Q.status([
        (up & (F.col("ci_low") > 0) & (F.col("reverses") == 0), "CONFIRMED"),
        (up & (F.col("reverses") == 0), "SUPPORTIVE"), (up, "FRAGILE")], "NOT_SUPPORTED"))


def ab_compare(a: DataFrame, b: DataFrame, on: Sequence[str] = (*DAY, "band")) -> DataFrame:
    """Paired A/B rows per common day and band."""
    r = b.select(*on, F.col("mean").alias("b_mean"), F.col("total").alias("b_total"))
    return a.select(*on, F.col("mean").alias("a_mean"), F.col("total").alias("a_total")).join(r, list(on)).withColumn(
        "change", F.col("b_total") - F.col("a_total"))


def efficiency(adaptive: DataFrame, base: DataFrame) -> DataFrame:
    """Per-entity and ten-entity-scaled totals of a strategy against the base on common days."""
    a = adaptive.select(*DAY, F.col("mean").alias("a_mean"), F.col("n").alias("a_n"))
    b = base.select(*DAY, F.col("mean").alias("b_mean"), F.col("n").alias("b_n"))
    return a.join(b, DAY).withColumns({
        "scaled": F.col("a_mean") * 10, "base_scaled": F.col("b_mean") * 10,
        "improvement": (F.col("a_mean") - F.col("b_mean")) * 10, "reduction": F.col("b_n") - F.col("a_n"),
        "result": F.when(X.rank_key(F.col("a_mean") - F.col("b_mean")) > 0, "BETTER").when(
            X.rank_key(F.col("a_mean") - F.col("b_mean")) < 0, "WORSE").otherwise("TIE")})


def block_summary(daily: DataFrame) -> DataFrame:
    """Per block: days, totals of both sides and their difference, mean entities, and the totals scaled to ten entities.

    ``daily`` has block, a_mean, a_n, b_mean and b_n for each day.
    """
    a, b = F.col("a_mean") * F.col("a_n"), F.col("b_mean") * F.col("b_n")
    return daily.groupBy(*SITE, "block").agg(
        F.min("day").alias("start"), F.max("day").alias("end"), F.count(F.lit(1)).alias("days"), F.sum(a).alias("total"), F.sum(b).alias("base_total"),
        (F.sum(a) - F.sum(b)).alias("difference"), F.avg("a_mean").alias("mean"), F.avg("b_mean").alias("base_mean"),
        F.avg("a_n").alias("entities"), F.avg("b_n").alias("base_entities"), (F.sum("a_mean") * 10).alias("scaled"),
        (F.sum("b_mean") * 10).alias("base_scaled"), (F.sum(F.col("a_mean") - F.col("b_mean")) * 10).alias("improvement"))


def focus_dependence(detail: DataFrame, focus: Column) -> DataFrame:
    """How much of a replacement advantage comes from the focus labels."""
    signed = F.when(F.col("kind") == "ENTERED", F.col("metric")).otherwise(-F.col("metric"))
    x = detail.where("kind <> 'BOTH'").withColumns({"_v": signed, "_f": focus})
    tot = F.sum("_v")
    part = F.coalesce(F.sum(F.when(F.col("_f"), F.col("_v"))), F.lit(0.0))
    return x.groupBy(*SITE).agg(
        F.count(F.lit(1)).alias("replacements"), F.count_if("_f").alias("focus_rows"), tot.alias("advantage"),
        part.alias("focus_part"), (tot - part).alias("without_focus"), F.try_divide(part, tot).alias("focus_share"))


def assessment(series: DataFrame, warning: int = 20, reasonable: int = 45, strong: int = 90,
               by: Sequence[str] = SITE) -> DataFrame:
    """How far a day series can be trusted, by its length, with a checkpoint text."""
    n = F.col("days")
    return series.groupBy(*by).agg(F.count(F.lit(1)).alias("days"), F.avg("mean").alias("mean")).withColumns({
        "level": F.when(n < warning, "INSUFFICIENT").when(n < reasonable, "SHORT").when(
            n < strong, "REASONABLE").otherwise("STRONGER"),
        "checkpoint": F.concat(F.lit("day "), n.cast("string"), F.lit(" of "), F.when(n < warning, warning).when(
            n < reasonable, reasonable).otherwise(strong).cast("string"))})


def evaluate_frozen(picks: DataFrame, actual: DataFrame, n: int = 10) -> DataFrame:
    """Frozen picks joined to results by identity; a set with any mismatch or defect is rejected whole."""
    ok = Q.check_picks(picks, n).select(*DAY, F.col("ok").alias("_set_ok"))
    act = actual.select(*KEY, F.col("label").alias("_al"), F.col("metric").alias("_am"))
    j = picks.select(*KEY, "rank", "label").join(act, KEY, "left")
    g = j.groupBy(*DAY).agg(
        F.count_if(F.col("_am").isNull()).alias("missing"),
        F.count_if(F.col("_al").isNotNull() & (F.col("_al") != F.col("label"))).alias("identity_mismatch"),
        F.sum("_am").alias("_total"), F.count_if(F.col("_am") > 0).alias("_wins"))
    g = g.join(ok, DAY)
    fine = F.col("_set_ok") & (F.col("missing") == 0) & (F.col("identity_mismatch") == 0)
    return g.select(*DAY, "missing", "identity_mismatch", F.when(fine, "EVALUATED").when(
        ~F.col("_set_ok"), "INVALID_SET").otherwise("REJECTED").alias("status"),
        F.when(fine, F.col("_total")).alias("total"), F.when(fine, F.col("_wins").cast("double")).alias("wins"))


def coverage(days: DataFrame, picks: DataFrame, actual: DataFrame, expected: int) -> DataFrame:
    """Per calendar day: is there a prediction, a result, an eligible day; and the resulting status."""
    p = picks.groupBy(*DAY).agg(F.count(F.lit(1)).alias("picks"))
    a = actual.groupBy(*DAY).agg(F.count(F.lit(1)).alias("actual_rows"))
    j = days.select(*DAY).distinct().join(p, DAY, "full_outer").join(a, DAY, "full_outer")
    j = j.na.fill(0, ["picks", "actual_rows"])
    return j.withColumn("status", Q.status([
        ((F.col("picks") == 0) & (F.col("actual_rows") == 0), "NO_DATA"), (F.col("picks") == 0, "NO_PREDICTION"),
        (F.col("actual_rows") == 0, "WAITING_ACTUAL"), (F.col("actual_rows") < expected, "ACTUAL_INCOMPLETE")],
        "EVALUATED"))
