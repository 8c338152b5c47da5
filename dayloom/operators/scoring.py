"""Weights, weighted z-score ranking and the other score families."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from dayloom.functions import expr as X
from dayloom.operators import features as FT
from dayloom.operators import ordering as O
from dayloom.operators import windows as WN
from dayloom.operators.aggregates import rate
from dayloom.panel import DAY, ENTITY, LABEL, SITE
from dayloom.session import materialise

# The published factor weights of the full model.
FULL_WEIGHTS = {
    "avg_all": 0.0670952025611345,
    "recent7": 0.05164896703284082,
    "recent7_win": 0.06602967770818714,
    "last": 0.12382294629381808,
    "change": 0.10484738021281044,
    "weekday_avg": 0.05672674990073483,
    "label_avg": 0.05843723530102936,
    "rate1": 0.17725354845070532,
    "rate2": 0.13298938481323394,
    "neighbour": 0.06161296683628432,
    "bounce": 0.09953594088922124,
}


# ---- weight algebra -------------------------------------------------------

def normalise_weights(w: Mapping[str, float]) -> dict[str, float]:
    total = sum(w.values())
    if total <= 0:
        raise ValueError("weights must have a positive sum")
    return {k: v / total for k, v in w.items()}


def drop_factor(w: Mapping[str, float], *names: str) -> dict[str, float]:
    return normalise_weights({k: v for k, v in w.items() if k not in names})


def scale_factor(w: Mapping[str, float], name: str, by: float) -> dict[str, float]:
    return normalise_weights({k: v * (by if k == name else 1) for k, v in w.items()})


def add_factor(w: Mapping[str, float], name: str, share: float = 0.1) -> dict[str, float]:
    return {**{k: v * (1 - share) for k, v in w.items()}, name: share}


BASE_WEIGHTS = drop_factor(FULL_WEIGHTS, "recent7_win", "bounce")

MODES = {
    "BASE": BASE_WEIGHTS,
    "ADD_ENTITY_HISTORY": add_factor(BASE_WEIGHTS, "entity_shrunk"),
    "ADD_BAND_10": add_factor(BASE_WEIGHTS, "band10_avg"),
    "ADD_BAND_50": add_factor(BASE_WEIGHTS, "band50_avg"),
    "ADD_EDGE": add_factor(BASE_WEIGHTS, "edge"),
}


def weights_frame(spark: SparkSession, models: Mapping[str, Mapping[str, float]]) -> DataFrame:
    rows = [(m, f, float(v)) for m, w in models.items() for f, v in w.items()]
    return spark.createDataFrame(rows, "model string, factor string, weight double")


def normalised(weights: DataFrame) -> DataFrame:
    total = weights.groupBy("model").agg(F.sum("weight").alias("_t"))
    return weights.join(total, "model").withColumn("weight", F.col("weight") / F.col("_t")).drop("_t")


# ---- weighted z-score ranking --------------------------------------------

def component(z: Column) -> Column:
    return X.clip(50 + 12.5 * z)


def components(feats: DataFrame, factors: Sequence[str], population: Column | None = None,
               by: Sequence[str] = DAY) -> DataFrame:
    """``comp``: one 0..100 value per factor, in the order of ``factors``."""
    z = WN.zscores(feats, list(factors), by, population=population)
    return z.withColumn("comp", F.array(*[component(F.col(f"z_{f}")) for f in factors])).drop(
        *[f"z_{f}" for f in factors])


def dot(a: Column, w: Column) -> Column:
    return F.aggregate(F.zip_with(a, w, lambda x, y: x * y), F.lit(0.0), lambda s, v: s + v)


def score(feats: DataFrame, weights: Mapping[str, float], population: Column | None = None) -> DataFrame:
    factors = list(weights)
    x = components(feats, factors, population)
    return x.withColumn("score", X.rank_key(sum(
        F.col("comp")[i] * F.lit(weights[f]) for i, f in enumerate(factors)))).drop("comp")


BEST_FIRST = ("score", "entity_id")


def best_first() -> list[Column]:
    """Score descending, id ascending."""
    return [F.col("score").desc(), F.col("entity_id").asc()]


def rank_score(feats: DataFrame, weights: Mapping[str, float], n: int = 10) -> DataFrame:
    """The n best entities per day; only n candidates per task reach the shuffle."""
    return O.top_n(score(feats, weights), DAY, best_first(), n)


def weight_vectors(weights: DataFrame, factors: Sequence[str]) -> DataFrame:
    """One array per model in factor order; absent factors weigh 0."""
    return weights.groupBy("model").agg(F.array(*[
        F.coalesce(F.sum(F.when(F.col("factor") == f, F.col("weight"))), F.lit(0.0)) for f in factors]).alias("w"))


def score_models(feats: DataFrame, vectors: DataFrame, ids: Column, factors: Sequence[str]) -> DataFrame:
    """Every row under every model.

    ``ids`` is the array of model ids; the vectors table (models x factors, a
    parameter table) is looked up by id. No shuffle happens before the top-n.
    """
    x = components(feats, factors).withColumn("model", F.explode(ids))
    return x.join(vectors, "model").withColumn("score", X.rank_key(dot(F.col("comp"), F.col("w")))).drop("comp", "w")


def score_modes(feats: DataFrame, models: Mapping[str, Mapping[str, float]]) -> DataFrame:
    factors = sorted({f for w in models.values() for f in w})
    vectors = weight_vectors(weights_frame(feats.sparkSession, models), factors)
    return score_models(feats, vectors, F.array(*[F.lit(m) for m in models]), factors)


def contributions(feats: DataFrame, weights: Mapping[str, float]) -> DataFrame:
    """Weighted component per factor, long form."""
    factors = list(weights)
    x = components(feats, factors)
    parts = F.array(*[F.struct(F.lit(f).alias("factor"), F.col("comp")[i].alias("component"),
                               (F.col("comp")[i] * weights[f]).alias("contribution")) for i, f in enumerate(factors)])
    return x.select(*DAY, "entity_id", F.explode(parts).alias("p")).select(*DAY, "entity_id", "p.*")


# ---- reliability-pulled score -----------------------------------------------

PULL_WEIGHTS = {  # fixed values: factor shares of the reliability-pulled score
    "avg_all": 0.18, "recent7": 0.18, "recent7_win": 0.08, "last": 0.08, "change": 0.07, "weekday_avg": 0.08,
    "label_avg": 0.08, "rate1_eb": 0.04, "rate2_eb": 0.04, "neighbour": 0.04,
}


def pulled_score(panel: DataFrame, t1: float = 100, t2: float = 200, prior_n: float = 15.0) -> DataFrame:
    """Blend of z-components pulled to 50 by history length, with class and reasons, for the next day."""
    feats = FT.future_features(panel, t1=t1, t2=t2, extras=["recent7_win", "bounce"])
    m = F.col("metric")
    site = panel.groupBy(*SITE).agg(rate(m >= t1).alias("_p1"), rate(m >= t2).alias("_p2"))
    x = O.attach(feats, site, SITE).withColumns({
        "rate1_eb": X.shrink(F.col("rate1") * F.col("hist_n"), F.col("hist_n"), F.col("_p1"), prior_n),
        "rate2_eb": X.shrink(F.col("rate2") * F.col("hist_n"), F.col("hist_n"), F.col("_p2"), prior_n)})
    z = WN.zscores(materialise(x), list(PULL_WEIGHTS))
    # a constant factor counts as the neutral 50, the same as z = 0
    raw = sum(component(F.col(f"z_{f}")) * w for f, w in PULL_WEIGHTS.items()) + F.col("bounce") * 3.0
    out = z.withColumn("raw", raw).withColumn(
        "score", X.rank_key(X.clip(50 + (F.col("raw") - 50) * X.confidence_sqrt(F.col("hist_n")))))
    return out.withColumns({
        "confidence": X.step(F.col("hist_n"), [25, 20, 15], ["HIGH", "MEDIUM", "LOW", "REFERENCE"]),
        "reason": X.reasons([
            (F.col("recent7") >= 0.3 * t1, "RECENT7"), (F.col("avg_all") >= 0.3 * t1, "AVERAGE"),
            (F.col("weekday_avg") >= 0.3 * t1, "WEEKDAY"), (F.col("last") <= -0.5 * t1, "DIP"),
            (F.col("rate2_eb") >= 0.15, "BIG_WINS"), (F.col("label_avg") >= 0.2 * t1, "LABEL"),
            (F.col("neighbour") >= 0.3 * t1, "NEIGHBOUR")], 4, "OVERALL")})


# ---- rule and in-label scores ------------------------------------------------

def label_stats(df: DataFrame, by: Sequence[str]) -> DataFrame:
    return df.groupBy(*by).agg(
        F.count(F.lit(1)).alias("label_n"), F.avg("activity").alias("label_activity"),
        F.avg("metric").alias("label_mean"), F.stddev_pop("metric").alias("label_sd"),
        rate(F.col("metric") > 0).alias("label_win"))


def rule_score(df: DataFrame, t: float = 100) -> DataFrame:
    """Points for activity ratio, metric band and distance from the label mean; grade S..D."""
    x = df.join(label_stats(df, [*DAY, "label"]), [*DAY, "label"])
    ratio = X.ratio0(F.col("activity"), F.col("label_activity"))
    m, rel = F.col("metric"), F.col("metric") - F.col("label_mean")
    x = x.withColumns({
        "activity_points": X.step(ratio, [1.3, 1.1, 0.9, 0.7], [20, 15, 10, 5, 0]),
        "metric_points": F.when(m >= 3 * t, 30).when(m >= 2 * t, 25).when(m >= t, 20).when(m > 0, 10).when(
            m >= -t, 3).otherwise(0),
        "relative_points": X.step(rel, [3 * t, 2 * t, t, 0], [20, 15, 10, 5, 0])})
    return x.withColumn("points", F.col("activity_points") + F.col("metric_points") + F.col("relative_points")
                        ).withColumn("grade", X.grade(F.col("points"), [65, 50, 35, 20], list("SABCD")))


def relative_score(df: DataFrame) -> DataFrame:
    """z within the label of the day, damped by activity, mixed with the in-label rank."""
    x = df.join(label_stats(df, [*DAY, "label"]), [*DAY, "label"])
    x = x.withColumn("_neg", -F.col("metric"))
    x = O.position(x, [*DAY, "label"], [F.col("_neg"), F.col("entity_id")], "label_rank")
    rel = X.step(F.col("activity"), [8, 6, 5, 4, 3, 2], [1.0, 0.95, 0.9, 0.82, 0.72, 0.6, 0.45])
    z = X.ratio0(F.col("metric") - F.col("label_mean"), F.col("label_sd"))
    z = F.greatest(F.lit(-3.0), F.least(F.lit(3.0), z))
    perf = (z + 3) / 6 * 100
    n, r = F.col("label_n"), F.col("label_rank")
    rank_part = F.when(n > 1, (n - r) / (n - 1) * 100).otherwise(50.0)
    return x.withColumns({"z": z, "reliability": rel}).withColumn(
        "score", (perf * rel + 50 * (1 - rel)) * 0.5 + rank_part * 0.25 + perf * 0.25).withColumn(
        "grade", X.grade(F.col("score"), [80, 70, 60, 40], ["TOP", "UPPER", "UPPER_MID", "MID", "LOW"])).drop("_neg")


def last_rows(df: DataFrame, by: Sequence[str], n: int) -> DataFrame:
    """Each group's last n rows by day, for groups bounded by the calendar."""
    w = Window.partitionBy(*by).orderBy(F.desc("day"))
    return df.withColumn("_back", F.row_number().over(w)).where(F.col("_back") <= n)


def entity_scores(df: DataFrame, t: float = 100) -> DataFrame:
    m = F.col("metric")
    w = Window.partitionBy(*ENTITY).orderBy(F.desc("day"))
    x = df.withColumn("_b", F.row_number().over(w))
    r3 = F.col("_b") <= 3
    g = x.groupBy(*ENTITY).agg(
        F.max_by("label", "day").alias("label"), F.count(F.lit(1)).alias("n"), F.avg(m).alias("mean"),
        rate(m > 0).alias("win"), rate(m >= t).alias("high"), rate(m >= 2 * t).alias("strong"),
        F.avg(F.when(r3, m)).alias("recent3"), F.avg(F.when(r3, (m > 0).cast("int"))).alias("recent3_win"))
    return g.withColumn("score", X.clip(F.col("mean") / (t / 20) + F.col("win") * 30 + F.col("high") * 20
                                        + F.col("strong") * 15 + F.col("recent3_win") * 15))


def label_scores(df: DataFrame, t: float = 100) -> DataFrame:
    m = F.col("metric")
    g = df.groupBy(*LABEL).agg(
        F.count(F.lit(1)).alias("n"), F.avg(m).alias("mean"), rate(m > 0).alias("win"), rate(m >= t).alias("high"),
        rate(m >= 2 * t).alias("strong"))
    return g.withColumn("score", X.clip(F.col("mean") / (t * 0.06) + F.col("win") * 35 + F.col("high") * 15
                                        + F.col("strong") * 10))


def combination_scores(df: DataFrame, t: float = 100) -> DataFrame:
    days = df.groupBy(*SITE).agg(F.countDistinct("day").alias("_days"))
    m = F.col("metric")
    g = df.groupBy(*ENTITY, "label").agg(F.count(F.lit(1)).alias("n"), F.avg(m).alias("mean"),
                                         rate(m > 0).alias("win"))
    x = O.attach(g, days, SITE).withColumn("continuity", F.least(F.col("n") / F.col("_days"), F.lit(1.0)))
    return x.withColumn("score", X.clip(F.col("mean") / (t * 0.06) + F.col("win") * 40 + F.col("continuity") * 20))


LETTER = ([80, 70, 60, 50, 40], list("SABCDE"))


def invest_score(df: DataFrame, t: float = 100) -> DataFrame:
    """tanh-squashed mean, win and threshold rates, recent form, stability and confidence per entity."""
    m = F.col("metric")
    scale = 2.2 * t
    w = Window.partitionBy(*ENTITY).orderBy(F.desc("day"))
    x = df.withColumn("_b", F.row_number().over(w))
    recent = {}
    for k in (3, 5):
        recent[f"r{k}"] = F.avg(F.when(F.col("_b") <= k, m))
        recent[f"w{k}"] = F.avg(F.when(F.col("_b") <= k, (m > 0).cast("int"))) * 100
    g = x.groupBy(*ENTITY).agg(
        F.max_by("label", "day").alias("label"), F.count(F.lit(1)).alias("n"), F.avg(m).alias("mean"),
        F.stddev_pop(m).alias("sd"), (rate(m > 0) * 100).alias("win"), (rate(m >= t) * 100).alias("p1"),
        (rate(m >= 2 * t) * 100).alias("p2"), (rate(m <= -t) * 100).alias("m1"),
        *[c.alias(k) for k, c in recent.items()])
    conf = X.confidence_exp(F.col("n"), 4.5)
    rec = X.clip(X.squash(F.col("r3"), scale) * 0.55 + X.squash(F.col("r5"), scale) * 0.25 + F.col("w3") * 0.1
                 + F.col("w5") * 0.1)
    stable = F.when(F.abs("mean") > 0.1 * t, 100 / (1 + 0.35 * F.col("sd") / F.abs("mean"))).otherwise(50.0)
    raw = X.clip(X.squash(F.col("mean"), scale) * 0.35 + F.col("win") * 0.2 + F.col("p1") * 0.1 + F.col("p2") * 0.1
                 + rec * 0.15 + X.clip(stable) * 0.1 - F.col("m1") * 0.15)
    return g.withColumns({"confidence": conf * 100, "recent_score": rec, "stability": X.clip(stable), "raw": raw}
                         ).withColumn("score", X.clip(50 + (F.col("raw") - 50) * conf)).withColumn(
        "grade", X.grade(F.col("score"), *LETTER))


def label_outlook(df: DataFrame, t: float = 100) -> DataFrame:
    """Long, recent and previous label form from daily means, with dip bonus and overheating penalty."""
    m = F.col("metric")
    daily = df.groupBy(*LABEL, "day").agg(F.avg(m).alias("day_mean"))
    w = Window.partitionBy(*LABEL).orderBy(F.desc("day"))
    d = daily.withColumn("_b", F.row_number().over(w)).groupBy(*LABEL).agg(
        F.avg(F.when(F.col("_b") <= 3, F.col("day_mean"))).alias("recent3"),
        F.avg(F.when(F.col("_b") == 1, F.col("day_mean"))).alias("previous"),
        F.avg(F.when(F.col("_b") > 3, F.col("day_mean"))).alias("_old"))
    g = df.groupBy(*LABEL).agg(
        F.count(F.lit(1)).alias("n"), F.avg(m).alias("mean"), (rate(m > 0) * 100).alias("win"),
        (rate(m >= t) * 100).alias("p1"), (rate(m >= 2 * t) * 100).alias("p2")).join(d, LABEL)
    change = F.col("recent3") - F.coalesce("_old", "recent3")
    dip = F.when(F.col("mean") <= 0.3 * t, 30.0).when(change < 0, X.clip(50 + F.abs(change) / (2.5 * t) * 50)
                                                      ).otherwise(50.0)
    heat = F.when(F.col("recent3") > 1.5 * t, F.least(F.lit(15.0), (F.col("recent3") - 1.5 * t) / (0.5 * t) * 5)
                  ).otherwise(0.0)
    conf = X.clip(X.confidence_exp(F.col("n"), 50.0) * 100)
    base = (X.squash(F.col("mean"), 1.8 * t) * 0.2 + X.squash(F.col("recent3"), 1.8 * t) * 0.15
            + X.squash(F.col("previous"), 2.0 * t) * 0.1 + F.col("win") * 0.15 + F.col("p1") * 0.1
            + F.col("p2") * 0.05 + dip * 0.2 + 2.5)
    return g.withColumns({"change": change, "dip": dip, "heat": heat, "confidence": conf, "base": base}).withColumn(
        "score", X.clip(50 + (F.col("base") - 50) * (0.6 + F.col("confidence") / 100 * 0.4) - F.col("heat"))).withColumn(
        "grade", X.grade(F.col("score"), [75, 68, 60, 50, 40], list("SABCDE"))).drop("_old")


def robust_scores(df: DataFrame, keys: Sequence[str], parts: Mapping[str, float], t: float = 100) -> DataFrame:
    """Score of labels or entities from 5-95 % scaled mean, recent and dip parts, rates and reliability.

    ``recent`` is the last three observed days of the group, ``trend`` the
    slope of their daily means.
    """
    keys = list(keys)
    m = F.col("metric")
    daily = df.groupBy(*keys, "day").agg(F.sum(m).alias("_s"), F.count(m).alias("_c"))
    w = Window.partitionBy(*keys)
    d = daily.withColumns({
        "_b": F.row_number().over(w.orderBy(F.desc("day"))), "_dm": F.col("_s") / F.col("_c")})
    r3 = F.col("_b") <= 3
    recent = d.groupBy(*keys).agg(
        (F.sum(F.when(r3, F.col("_s"))) / F.sum(F.when(r3, F.col("_c")))).alias("recent3"),
        F.max(F.when(F.col("_b") == 1, F.col("_dm"))).alias("previous"),
        F.coalesce(F.regr_slope(F.when(r3, F.col("_dm")), F.when(r3, -F.col("_b"))), F.lit(0.0)).alias("trend"))
    g = df.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n"), F.avg(m).alias("mean"), (rate(m > 0) * 100).alias("win"),
        (rate(m >= t) * 100).alias("p1"), (rate(m >= 2 * t) * 100).alias("p2")).join(recent, keys).withColumns({
            "change": F.col("recent3") - F.col("mean"), "neg_dip": F.col("previous") - F.col("recent3"),
            "reliability": F.least(F.lit(100.0), X.confidence_exp(F.col("n"), 12.0) * 100)})
    cols = ["mean", "recent3", "neg_dip"]
    long = g.unpivot(SITE, cols, "_c", "_v")
    cuts = O.exact_quantiles(long, [*SITE, "_c"], "_v", {"_lo": 0.05, "_hi": 0.95})
    wide = cuts.groupBy(*SITE).agg(*[F.max(F.when(F.col("_c") == c, F.col(e))).alias(f"{e}_{c}")
                                     for c in cols for e in ("_lo", "_hi")])
    g = O.attach(g, wide, SITE).withColumns({
        f"s_{c}": X.to_range(F.col(c), F.col(f"_lo_{c}"), F.col(f"_hi_{c}")) for c in cols})
    return g.withColumn("score", sum(F.col(c) * v for c, v in parts.items() if c != "const") + parts.get("const", 0.0))


# Shares of the robust scores of labels and entities.
ROBUST_LABEL = {"s_mean": 0.25, "win": 0.15, "p1": 0.1, "p2": 0.05, "s_recent3": 0.15, "s_neg_dip": 0.1,
                "reliability": 0.15, "const": 2.5}
ROBUST_ENTITY = {"s_mean": 0.25, "win": 0.1, "p1": 0.1, "p2": 0.05, "s_recent3": 0.15, "s_neg_dip": 0.15,
                 "reliability": 0.2}


def robust_combined(df: DataFrame, t: float = 100) -> DataFrame:
    labels = robust_scores(df, LABEL, ROBUST_LABEL, t).select(*LABEL, F.col("score").alias("label_score"))
    current = df.groupBy(*ENTITY).agg(F.max_by("label", "day").alias("label"))
    ents = robust_scores(df, ENTITY, ROBUST_ENTITY, t).join(current, ENTITY)
    return ents.withColumnRenamed("score", "entity_score").join(labels, LABEL, "left").withColumn(
        "score", F.coalesce("label_score", F.lit(50.0)) * 0.45 + F.col("entity_score") * 0.55).withColumn(
        "grade", X.grade(F.col("score"), *LETTER))


# ---- band-rule scores ---------------------------------------------------------

def form(df: DataFrame, keys: Sequence[str], daily: bool) -> DataFrame:
    """Mean, win rate, last, change, recent-3 and dip of a group's rows or daily means."""
    keys = list(keys)
    m = F.col("metric")
    rows = df.groupBy(*keys, "day").agg(F.avg(m).alias("v")) if daily else df.withColumn("v", m)
    w = Window.partitionBy(*keys).orderBy(F.desc("day"))
    d = rows.withColumn("_b", F.row_number().over(w)).groupBy(*keys).agg(
        F.max(F.when(F.col("_b") == 1, F.col("v"))).alias("last"),
        F.max(F.when(F.col("_b") == 2, F.col("v"))).alias("_prev"),
        F.avg(F.when(F.col("_b") <= 3, F.col("v"))).alias("recent3"),
        F.min(F.when(F.col("_b") <= 3, F.col("v"))).alias("_low3"))
    g = df.groupBy(*keys).agg(F.avg(m).alias("mean"), (rate(m > 0) * 100).alias("win"))
    return g.join(d, keys).select(
        *keys, "mean", "win", "last", (F.col("last") - F.coalesce("_prev", "last")).alias("change"), "recent3",
        (F.col("mean") - F.col("last")).alias("drawdown"),
        F.when(F.col("_low3") < 0, -F.col("_low3")).otherwise(0.0).alias("dent"))


def swing_points(c: Column, t: float) -> Column:
    """90 for a mild gain, 60 for a mild loss, 55 / 25 for big moves, 45 between; fixed values. Rounded, so that sums in any order agree."""
    c = X.rank_key(c)
    return (F.when((c >= 0) & (c <= t), 90.0).when((c >= -t / 2) & (c < 0), 60.0)
            .when((c > t) & (c <= 2 * t), 55.0).when(c < -t, 25.0).otherwise(45.0))


def band_score(df: DataFrame, t: float = 100, bonus: Column | None = None) -> DataFrame:
    """Rule score for the next day of every entity in the latest inventory."""
    ent, lab = form(df, ENTITY, False), form(df, LABEL, True)
    lab = lab.select(*LABEL, F.col("last").alias("l_last"), F.col("recent3").alias("l_recent3"),
                     F.col("mean").alias("l_mean"))
    latest = df.groupBy(*SITE).agg(F.max("day").alias("_d"))
    daily = df.groupBy(*DAY).agg(F.avg("metric").alias("a"), (rate(F.col("metric") > 0) * 100).alias("p"))
    wd = daily.groupBy(*SITE, F.weekday("day").alias("wd")).agg(F.avg("a").alias("a"), F.avg("p").alias("p")).select(
        *SITE, "wd", (X.to_range(F.col("a"), -0.3 * t, 0.1 * t) * 0.7 + X.to_range(F.col("p"), 20, 45) * 0.3
                      ).alias("wd_score"))
    cand = O.attach(df, latest, SITE).where("day = _d").select(
        *ENTITY, "label", F.weekday(F.date_add("day", 1)).alias("wd"))
    x = O.attach(cand.join(ent, ENTITY).join(lab, LABEL), wd, ["site", "wd"], "left")
    dd = X.rank_key(F.col("drawdown"))
    dd_points = F.when((dd >= -t) & (dd <= 0), 75.0).when(dd < -t, 50.0).when((dd > 0) & (dd <= t), 40.0).otherwise(25.0)
    bonus = F.lit(40.0) if bonus is None else bonus
    parity = F.when(F.pmod("entity_id", F.lit(2)) == 1, 55.0).otherwise(45.0)
    s = (swing_points(F.col("change"), t) * 0.22 + swing_points(F.col("last"), t) * 0.18 + dd_points * 0.12
         + swing_points(F.col("l_last"), t) * 0.18 + X.to_range(F.col("l_recent3"), -t, t) * 0.1
         + X.to_range(F.col("l_mean"), -t, t) * 0.06 + F.coalesce("wd_score", F.lit(50.0)) * 0.06 + bonus * 0.05
         + parity * 0.03)
    return x.withColumn("score", X.clip(s)).withColumn("grade", X.grade(X.rank_key(F.col("score")), [75, 65, 55, 45, 35],
                                                                        list("SABCDE")))


MINMAX_WEIGHTS = {  # fixed values: shares of the min-max score
    "change": 0.20, "dent": 0.15, "l_last": 0.20, "last": 0.12, "l_recent3": 0.10, "recent3": 0.07, "l_dent": 0.05,
    "l_mean": 0.04, "mean": 0.02, "win": 0.03, "l_win": 0.02,
}


def minmax_score(df: DataFrame, t: float = 100) -> DataFrame:
    """Min-max scaled form parts with additive band bonuses, and the two-of-four focus flag."""
    lab = form(df, LABEL, True)
    lab = lab.select(*LABEL, *[F.col(c).alias(f"l_{c}") for c in ("last", "recent3", "dent", "mean", "win")])
    latest = df.groupBy(*SITE).agg(F.max("day").alias("_d"))
    cand = O.attach(df, latest, SITE).where("day = _d").select(*ENTITY, "label")
    x = cand.join(form(df, ENTITY, False), ENTITY).join(lab, LABEL)
    ends = x.groupBy(*SITE).agg(*[f(c).alias(f"_{n}_{c}") for c in MINMAX_WEIGHTS
                                  for n, f in (("a", F.min), ("b", F.max))])
    x = O.attach(x, ends, SITE)
    base = sum(X.to_range(F.col(c), F.col(f"_a_{c}"), F.col(f"_b_{c}")) * w for c, w in MINMAX_WEIGHTS.items())
    h = t / 2
    one = lambda cond, v: F.when(cond, v).otherwise(0.0)
    bonus = (one(F.col("change") >= h, 3.0) + one(F.col("l_last") >= h, 3.0) + one(F.col("last") >= h, 2.0)
             + one(F.col("dent") >= h, 2.0) + one((F.col("last") >= t) & (F.col("change") >= t), -2.0)
             + one(F.col("l_last") <= -t, -2.0))
    focus = sum((F.col(c) >= 0.3 * t).cast("int") for c in ("change", "dent", "l_last", "last")) >= 2
    return x.withColumn("score", X.clip(base + bonus)).withColumn("focus", focus)


def final_selection(inv: DataFrame, t: float = 100) -> DataFrame:
    """Mix of the investment score, recent form, win rate and confidence, with small-sample penalties."""
    recent = X.clip(50 + 50 * F.greatest(F.lit(-1.0), F.least(F.lit(1.0), F.col("r3") / (3 * t))))
    penalty = F.when(F.col("n") <= 2, 8).when(F.col("n") == 3, 5).when(F.col("n") == 4, 3).when(
        F.col("n") == 5, 1).otherwise(0)
    target = X.clip(F.col("score") * 0.6 + recent * 0.15 + F.col("win") * 0.1 + F.col("confidence") * 0.1
                    + F.col("w3") * 0.05 - penalty)
    notes = F.concat_ws(" / ", F.when(F.col("n") <= 2, "FEW_DAYS"), F.when(F.col("mean") >= 2 * t, "STRONG_MEAN"),
                        F.when(F.col("win") >= 70, "HIGH_WIN"), F.when(F.col("r3") >= 2 * t, "STRONG_RECENT"),
                        F.when(F.col("r3") <= -t, "WEAK_RECENT"), F.when(F.col("confidence") < 60, "LOW_CONFIDENCE"))
    return inv.withColumn("target_score", target).withColumn("verdict", X.grade(
        F.col("target_score"), [75, 68, 60, 50], ["◎", "○", "△", "▲", "×"])).withColumn("notes", notes)


# ---- simple signals ------------------------------------------------------------

def recent_win(df: DataFrame, n: int, topn: int, by: Sequence[str] = (), min_days: int = 0) -> DataFrame:
    """Rank by win rate of the last n rows, then support, then id, inside a segment of the day."""
    w = FT.back(ENTITY, n)
    days = df.select(*DAY).distinct().withColumn("_d", F.row_number().over(Window.partitionBy(*SITE).orderBy("day")))
    x = df.withColumns({
        "recent_win": F.coalesce(F.avg((F.col("metric") > 0).cast("int")).over(w), F.lit(-1.0)),
        "recent_n": F.count("metric").over(w)})
    x = O.attach(x, days, DAY).where(F.col("_d") > min_days).drop("_d")
    order = [X.rank_key(F.col("recent_win")).desc(), F.desc("recent_n"), F.asc("entity_id")]
    return O.top_n(x, [*DAY, *by], order, topn)


def neutral_fill(df: DataFrame, columns: Sequence[str], by: Sequence[str] = DAY) -> DataFrame:
    """Missing values become the cross-sectional median of the same day, or 0 if the day has none."""
    by = list(by)
    long = df.unpivot(by, [F.col(c).cast("double").alias(c) for c in columns], "_c", "_v")
    mids = O.exact_quantiles(long, [*by, "_c"], "_v", {"_mid": 0.5})  # all columns in one ordering
    wide = mids.groupBy(*by).agg(*[F.max(F.when(F.col("_c") == c, F.col("_mid"))).alias(f"_mid_{c}") for c in columns])
    out = O.attach(df, wide, by, "left")
    return out.withColumns({c: F.coalesce(c, f"_mid_{c}", F.lit(0.0)) for c in columns}).drop(
        *[f"_mid_{c}" for c in columns])


def weekday_signal(df: DataFrame) -> DataFrame:
    """Mean of the same weekday's earlier days, median-filled."""
    w = Window.partitionBy(*ENTITY, "wd").orderBy("day").rowsBetween(Window.unboundedPreceding, -1)
    x = df.withColumn("wd", F.weekday("day")).withColumns({
        "weekday_mean": F.avg("metric").over(w), "weekday_n": F.count("metric").over(w)})
    return neutral_fill(x, ["weekday_mean"])


BLEND = ["avg_all", "recent7", "recent7_win", "weekday_mean", "rate1"]


def simple_blend(df: DataFrame, t: float = 100) -> DataFrame:
    """Equal blend of five median-filled z-scores."""
    past, m = FT.back(ENTITY), F.col("metric")
    wd = Window.partitionBy(*ENTITY, "wd").orderBy("day").rowsBetween(Window.unboundedPreceding, -1)
    x = df.withColumn("wd", F.weekday("day")).withColumns({
        "avg_all": F.avg(m).over(past), "rate1": F.avg((m >= t).cast("int")).over(past),
        "recent7": F.avg(m).over(FT.back(ENTITY, 7)),
        "recent7_win": F.avg((m > 0).cast("int")).over(FT.back(ENTITY, 7)), "weekday_mean": F.avg(m).over(wd)})
    z = WN.zscores(neutral_fill(x, BLEND), BLEND)
    return z.withColumn("blend", sum(F.col(f"z_{c}") for c in BLEND) / len(BLEND))


def add_external(panel: DataFrame, by_label: DataFrame, by_digit: DataFrame) -> DataFrame:
    """Label-level and last-digit-level outside features joined many-to-one, then median-filled."""
    x = panel.withColumn("digit", F.pmod("entity_id", F.lit(10)))
    x = x.join(by_label, [*DAY, "label"], "left").join(by_digit, [*DAY, "digit"], "left")
    new = [c for c in (*by_label.columns, *by_digit.columns) if c not in (*DAY, "label", "digit")]
    return neutral_fill(x, new)


# ---- class inference ------------------------------------------------------------

RATE_CLASSES = {  # fixed values: events per class (c1, c2) of the six settings
    1: (273.1, 409.6), 2: (270.8, 385.5), 3: (266.4, 336.1), 4: (254.0, 290.0), 5: (240.1, 268.6), 6: (229.1, 229.1),
}


def poisson_posterior(df: DataFrame, spec: Mapping[int, tuple[float, float]] = RATE_CLASSES,
                      exposure: str = "activity") -> DataFrame:
    """Posterior over rate classes from two Poisson counts under a flat prior, per row."""
    g = F.col(exposure)
    ll = [F.col("c1") * F.log(g / a) - g / a + F.col("c2") * F.log(g / b) - g / b for a, b in spec.values()]
    x = df.where(g > 0).withColumn("_ll", F.array(*ll)).withColumn("_top", F.array_max("_ll"))
    x = x.withColumn("_w", F.transform("_ll", lambda v: F.exp(v - F.col("_top"))))
    total = F.aggregate("_w", F.lit(0.0), lambda s, v: s + v)
    x = x.withColumn("posterior", F.transform("_w", lambda v: v / total))
    keys = list(spec)
    expected = sum(F.col("posterior")[i] * k for i, k in enumerate(keys))
    high = sum(F.col("posterior")[i] for i, k in enumerate(keys) if k >= 4)
    best = F.element_at(F.array(*[F.lit(k) for k in keys]), F.array_position(
        "posterior", F.array_max("posterior")).cast("int"))
    return x.withColumns({"expected_class": expected, "p_high": high, "best_class": best}).drop("_ll", "_top", "_w")


def rank_groups(df: DataFrame, value: str, size: int = 5, by: Sequence[str] = DAY) -> DataFrame:
    """Outcome by groups of ``size`` consecutive ranks of an inferred order."""
    x = df.withColumn("_neg", -X.rank_key(F.col(value)))
    x = O.position(x, by, [F.col("_neg"), F.col("entity_id")], "_r")
    return x.withColumn("rank_group", F.ceil(F.col("_r") / size)).groupBy(*SITE, "rank_group").agg(
        F.count(F.lit(1)).alias("n"), F.avg("metric").alias("mean"), rate(F.col("metric") > 0).alias("win_rate"))


# ---- epoch policies ---------------------------------------------------------------

EPOCH_FACTORS = ["avg_all", "recent7", "last", "change", "weekday_avg", "rate1", "rate2"]


def epoch_features(panel: DataFrame, observed_only: bool, t1: float = 100, t2: float = 200) -> DataFrame:
    """Next-day factors of renamed entities from their current label epoch only."""
    ep = WN.reset_history(panel).where("epoch > 1")
    last = panel.groupBy(*SITE).agg(F.max("day").alias("_last"))
    here = O.attach(panel, last, SITE).where("day = _last").select(*ENTITY, F.weekday(F.date_add("day", 1)).alias("_wd"))
    x = ep.join(here, ENTITY)
    if observed_only:
        x = x.where("activity > 0")
    w = Window.partitionBy(*ENTITY).orderBy(F.desc("day"))
    m = F.col("metric")
    x = x.withColumn("_b", F.row_number().over(w))
    wd = F.weekday("day") == F.col("_wd")
    g = x.groupBy(*ENTITY).agg(
        F.count(m).alias("epoch_n"), F.avg(m).alias("avg_all"), F.avg(F.when(F.col("_b") <= 7, m)).alias("recent7"),
        F.max(F.when(F.col("_b") == 1, m)).alias("last"), F.max(F.when(F.col("_b") == 2, m)).alias("_prev"),
        F.count_if(wd).alias("_wn"), F.avg(F.when(wd, m)).alias("_wavg"), rate(m >= t1).alias("rate1"),
        rate(m >= t2).alias("rate2"))
    k = F.col("_wn") / (F.col("_wn") + 15.0)
    return g.select(
        *ENTITY, "epoch_n", "avg_all", "recent7", "last",
        F.coalesce(F.col("last") - F.col("_prev"), F.lit(0.0)).alias("change"),
        (F.coalesce("_wavg", "avg_all") * k + F.col("avg_all") * (1 - k)).alias("weekday_avg"), "rate1", "rate2")


def _epoch_frame(panel: DataFrame, t1: float, t2: float) -> DataFrame:
    """Next-day baseline features, the same with epoch features for entities whose label changed (e_*), changed and epoch_n."""
    base = FT.future_features(panel, t1=t1, t2=t2, extras=())
    ep = epoch_features(panel, True, t1, t2)
    names = {f: f"e_{f}" for f in EPOCH_FACTORS}
    j = base.join(ep.select(*ENTITY, "epoch_n", *[F.col(f).alias(a) for f, a in names.items()]), ENTITY, "left")
    return materialise(j.withColumns({a: F.coalesce(a, f) for f, a in names.items()}).withColumn("changed", F.col("epoch_n").isNotNull()))


class _Policies:
    """Ways to treat entities whose label changed: each has a feature set, a population of its z moments and candidates.

    ``kinds``: name of the moments -> (column of each factor, population); ``rows``: (policy, moments, candidates).
    """

    def __init__(self, thresholds: Sequence[int]):
        plain = {f: f for f in BASE_WEIGHTS}
        epoch = {f: f"e_{f}" if f in EPOCH_FACTORS else f for f in BASE_WEIGHTS}
        self.long_enough = {t: ~F.col("changed") | (F.col("epoch_n") >= t) for t in thresholds}
        self.kinds = {"base": (plain, F.lit(True)), "rank": (epoch, F.lit(True))} | {f"pop{t}": (epoch, ok) for t, ok in self.long_enough.items()}

    def join(self, j: DataFrame) -> DataFrame:
        """All sets of moments from one pass over the features."""
        stats = j.groupBy(*DAY).agg(*[
            f(F.when(cond, F.col(c))).alias(f"_{n}_{k}_{c}") for k, (cols, cond) in self.kinds.items()
            for c in cols.values() for n, f in (("m", F.avg), ("s", F.stddev_pop))])
        return O.attach(j, stats, DAY)

    def component(self, kind: str, factor: str) -> Column:
        c = self.kinds[kind][0][factor]
        return component(F.when(F.coalesce(F.col(f"_s_{kind}_{c}"), F.lit(0.0)) == 0, 0.0).otherwise(
            (F.col(c) - F.col(f"_m_{kind}_{c}")) / F.col(f"_s_{kind}_{c}")))

    def scores(self, j: DataFrame, rows: Sequence[tuple[str, str, Column]]) -> DataFrame:
        total = lambda kind: X.rank_key(sum(self.component(kind, f) * w for f, w in BASE_WEIGHTS.items()))
        parts = F.array(*[F.struct(F.lit(n).alias("policy"), total(k).alias("score"), c.alias("candidate")) for n, k, c in rows])
        keep = [c for c in (*DAY, "entity_id", "label", "changed", "eligible", "epoch_n") if c in j.columns]
        return self.join(j).withColumn("_p", F.explode(parts)).select(*keep, "_p.*")


def epoch_policies(panel: DataFrame, threshold: int = 14, t1: float = 100, t2: float = 200) -> DataFrame:
    """Next-day ranking under four ways to treat entities whose label changed.

    BASELINE keeps all history. EPOCH_RANK uses epoch features for all z
    moments and drops short epochs from the ranking only; EPOCH_POP drops them
    from the z population too; BASE_REF keeps baseline features and moments.
    """
    p = _Policies([threshold])
    ok = p.long_enough[threshold]
    return p.scores(_epoch_frame(panel, t1, t2).withColumn("eligible", ok), [
        ("BASELINE", "base", F.lit(True)), ("EPOCH_RANK", "rank", ok), ("EPOCH_POP", f"pop{threshold}", ok), ("BASE_REF", "base", ok)])


LADDER = (7, 14, 21, 31)  # fixed values: least days of an epoch


def epoch_ladder(panel: DataFrame, thresholds: Sequence[int] = LADDER, t1: float = 100, t2: float = 200) -> DataFrame:
    """Scores without exclusion and with changed entities of fewer days than each threshold left out of the ranking, or of the z population too."""
    p = _Policies(thresholds)
    rows = [("BASELINE", "base", F.lit(True)), ("EPOCH", "rank", F.lit(True))]
    for t, ok in p.long_enough.items():
        rows += [(f"EXCLUDE_LT{t}", "rank", ok), (f"EXCLUDE_LT{t}_POP", f"pop{t}", ok)]
    return p.scores(_epoch_frame(panel, t1, t2), rows)


def normalisation_shift(panel: DataFrame, thresholds: Sequence[int] = LADDER, t1: float = 100, t2: float = 200) -> DataFrame:
    """Per set of moments and factor: population and what is outside it, the population's moments and range, and how many components are clipped."""
    p = _Policies(thresholds)
    x = p.join(_epoch_frame(panel, t1, t2))
    parts = F.array(*[F.struct(F.lit(k.upper()).alias("moments"), F.lit(f).alias("factor"), F.col(cols[f]).cast("double").alias("v"),
                               p.component(k, f).alias("c"), cond.alias("inside")) for k, (cols, cond) in p.kinds.items() for f in BASE_WEIGHTS])
    v = F.when(F.col("inside"), F.col("v"))
    return x.select(*DAY, F.explode(parts).alias("p")).select(*DAY, "p.*").groupBy(*DAY, "moments", "factor").agg(
        F.count_if("inside").alias("population"), F.count_if(~F.col("inside")).alias("excluded"), F.avg(v).alias("mean"), F.stddev_pop(v).alias("sd"),
        F.min(v).alias("lo"), F.max(v).alias("hi"), F.count_if(F.col("c") <= 0).alias("clipped_low"), F.count_if(F.col("c") >= 100).alias("clipped_high"))


def policy_picks(scored: DataFrame, n: int = 10) -> DataFrame:
    return O.top_n(scored.where("candidate"), [*DAY, "policy"], best_first(), n)


def policy_compare(scored: DataFrame, n: int = 10) -> DataFrame:
    """Per policy: picks replaced against BASELINE and the score ripple on unchanged and changed entities."""
    scored = materialise(scored)  # read four times below
    picks = policy_picks(scored, n).select(*DAY, "policy", "entity_id")
    base_picks = picks.where("policy = 'BASELINE'").select(*DAY, "entity_id", F.lit(1).alias("_b"))
    repl = picks.join(base_picks, [*DAY, "entity_id"], "left").groupBy(*DAY, "policy").agg(
        F.count_if(F.col("_b").isNull()).alias("replaced"))
    base = scored.where("policy = 'BASELINE'").select(*DAY, "entity_id", F.col("score").alias("_s"))
    rip = scored.join(base, [*DAY, "entity_id"]).withColumn("delta", F.col("score") - F.col("_s"))
    by = [*DAY, "policy", "changed"]
    agg = rip.groupBy(*by).agg(
        F.count(F.lit(1)).alias("rows"), F.avg("delta").alias("mean_delta"),
        F.avg(F.abs("delta")).alias("mean_abs_delta"), F.max(F.abs("delta")).alias("max_abs_delta"))
    p95 = O.exact_quantiles(rip.withColumn("_a", F.abs("delta")), by, "_a",
                            {"median_abs_delta": 0.5, "p95_abs_delta": 0.95})
    return repl.join(agg, [*DAY, "policy"]).join(p95, by)


def rank_ripple(scored: DataFrame, n: int = 10) -> DataFrame:
    """Per policy: how far ranks move against BASELINE on changed and unchanged entities, and how many of the top n change place."""
    ranked = materialise(O.position(scored.select(*DAY, "policy", "entity_id", "changed", "score"), [*DAY, "policy"], best_first(), "pos", "pop"))
    base = ranked.where("policy = 'BASELINE'").select(*DAY, "entity_id", F.col("pos").alias("_pos"), F.col("pop").alias("_pop"))
    moved = F.abs(F.col("pos") - F.col("_pos"))
    return ranked.join(base, [*DAY, "entity_id"]).groupBy(*DAY, "policy", "changed").agg(
        F.count(F.lit(1)).alias("rows"), F.avg(moved).alias("mean_rank_move"), F.max(moved).alias("max_rank_move"),
        F.count_if((F.least("pos", "_pos") <= n) & (moved > 0)).alias("top_moves"), F.max(F.col("pop") - F.col("_pop")).alias("pop_change"))


def category_rank(scored: DataFrame, rules: Sequence[tuple[str, str, str]], default: str = "NORMAL",
                  n: int = 10) -> DataFrame:
    """Re-rank a frozen score inside label categories; the first matching rule wins."""
    x = WN.classify(scored, F.col("label"), rules).withColumn(
        "category", F.when(F.col("rules") == "", default).otherwise(F.split("rules", r"\+")[0]))
    return O.top_n(x, [*DAY, "category"], best_first(), n, "category_rank")


def inventory_flags(panel: DataFrame, window: int = 7) -> DataFrame:
    """Stability of the latest day's inventory: changed today, stable for the window, new label, mixed history."""
    last = panel.groupBy(*SITE).agg(F.max("day").alias("_last"))
    days = panel.select(*DAY).distinct().withColumn("_rank", F.row_number().over(
        Window.partitionBy(*SITE).orderBy(F.desc("day"))))
    x = O.attach(panel, days.join(last, SITE), DAY)
    latest = x.where("day = _last").select(*ENTITY, F.col("label").alias("now"))
    first_seen = panel.groupBy(*LABEL).agg(F.min("day").alias("_first"))
    first_seen = O.attach(first_seen, last, SITE).select(
        "site", F.col("label").alias("now"), (F.col("_first") == F.col("_last")).alias("new_label"))
    h = x.join(latest, ENTITY)
    same = F.col("label") == F.col("now")
    g = h.groupBy(*ENTITY, "now").agg(
        F.coalesce(F.bool_and(F.when(F.col("_rank") == 2, same)), F.lit(False)).alias("_kept"),
        F.count_if((F.col("_rank") <= window) & same).alias("_stable"),
        F.count_if(~same).alias("_other"))
    return g.join(first_seen, ["site", "now"]).select(
        *ENTITY, F.col("now").alias("label"), (~F.col("_kept")).alias("changed"),
        (F.col("_stable") >= window).alias("stable"), "new_label", (F.col("_other") > 0).alias("mixed_history"))
