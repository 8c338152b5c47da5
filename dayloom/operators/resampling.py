"""Bootstrap, permutation and exact tests with reproducible hashed randomness.

Replicates are exploded beside the rows and aggregated straight back to
(group, replicate), so the work spreads by replicate and nothing is collected.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from dayloom.functions import expr as X
from dayloom.operators import aggregates as A
from dayloom.operators import deals as D
from dayloom.operators import ordering as O
from dayloom.operators.aggregates import rate
from dayloom.panel import DAY, SITE
from dayloom.session import materialise


def replicates(df: DataFrame, reps: int, first: int = 1) -> DataFrame:
    """Every row once per replicate.

    The rows are dealt out evenly first, so a small input does not multiply
    inside one task; that shuffle is 1/reps of what follows.
    """
    tasks = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return df.repartition(tasks).withColumn("rep", F.explode(F.sequence(F.lit(first), F.lit(reps))))


def bootstrap_means(series: DataFrame, by: Sequence[str], value: str, reps: int, seed: str = "b") -> DataFrame:
    """Mean of a with-replacement sample per (group, rep); one row per (group, day) comes in."""
    by = list(by)
    w = Window.partitionBy(*by)
    x = series.where(F.col(value).isNotNull()).select(*by, "day", value).withColumns({
        "_i": F.row_number().over(w.orderBy("day")), "_n": F.count(F.lit(1)).over(w)})
    keys = [F.col(c) for c in by if c != "site"]
    draws = replicates(x.select(*by, "_i", "_n"), reps).withColumn(
        "_pick", (F.floor(X.uniform(*keys, F.col("rep"), F.col("_i"), seed) * F.col("_n")) + 1).cast("int"))
    vals = x.select(*by, F.col("_i").alias("_pick"), F.col(value).alias("_v"))
    return draws.join(vals, [*by, "_pick"]).groupBy(*by, "rep").agg(F.avg("_v").alias("boot_mean"))


def interval(samples: DataFrame, by: Sequence[str], value: str) -> DataFrame:
    """Exact 2.5 / 97.5 % linear quantiles over the replicates of a group."""
    return samples.groupBy(*by).agg(
        F.percentile(value, F.lit(0.025)).alias("ci_low"), F.percentile(value, F.lit(0.975)).alias("ci_high"),
        rate(F.col(value) > 0).alias("p_positive"))


def bootstrap_ci(series: DataFrame, by: Sequence[str], value: str, reps: int, seed: str = "b") -> DataFrame:
    ci = interval(bootstrap_means(series, by, value, reps, seed), by, "boot_mean")
    return series.groupBy(*by).agg(F.count(value).alias("n"), F.avg(value).alias("mean_value")).join(ci, list(by))


def bootstrap_diff_ci(series: DataFrame, group: str, a: str, b: str, value: str, reps: int, seed: str = "b") -> DataFrame:
    """CI of the difference of two group means (a minus b) from two independent bootstrap streams."""
    m = bootstrap_means(series, [*SITE, group], value, reps, seed)
    one = lambda g: F.max(F.when(F.col(group) == g, F.col("boot_mean")))
    d = m.groupBy(*SITE, "rep").agg((one(a) - one(b)).alias("diff"))
    v = lambda g: F.avg(F.when(F.col(group) == g, F.col(value)))
    return series.groupBy(*SITE).agg((v(a) - v(b)).alias("observed")).join(interval(d, SITE, "diff"), SITE)


def p_two_sided(null: str, observed: str, reps: Column) -> Column:
    hits = F.count_if(F.abs(X.rank_key(F.col(null))) >= F.abs(X.rank_key(F.col(observed))))
    return (1 + hits) / (reps + 1)


def signflip_test(series: DataFrame, by: Sequence[str], value: str, reps: int, seed: str = "s") -> DataFrame:
    """Two-sided sign-flip permutation p of a mean, with the null interval."""
    by = list(by)
    keys = [F.col(c) for c in by if c != "site"]
    x = replicates(series.where(F.col(value).isNotNull()), reps)
    sign = F.when(X.uniform(*keys, F.col("day"), F.col("rep"), seed) < 0.5, -1.0).otherwise(1.0)
    null = x.groupBy(*by, "rep").agg(F.avg(sign * F.col(value)).alias("_null"), F.avg(value).alias("_obs"))
    return null.groupBy(*by).agg(
        F.max("_obs").alias("observed"), p_two_sided("_null", "_obs", F.count(F.lit(1))).alias("p_value"),
        F.percentile("_null", F.lit(0.025)).alias("null_low"), F.percentile("_null", F.lit(0.975)).alias("null_high"))


EXACT_LIMIT = 20
LEAVES = 64  # values that one leaf of the convolution tree holds
REACH = 1 << 24  # the longest list of sums that a task holds
GRIDS = (1, 10, 100, 1000, 10_000, 1_000_000)  # parts of a unit in which values may be given


def _signs(steps: np.ndarray) -> np.ndarray:
    """Shares of all sums of the steps with either sign, the least sum first, each next one higher by two."""
    out = np.ones(1)
    for v in steps:  # a shift by v in steps of two
        grown = np.zeros(len(out) + v)
        grown[v:] = 0.5 * out
        grown[:len(out)] += 0.5 * out
        out = grown
    return out


def _joined(lists: list[np.ndarray]) -> np.ndarray:
    """Convolution of the lists, the shortest first; long ones by FFT, with exact zeros below rounding noise."""
    lists = sorted(lists, key=len)
    while len(lists) > 1:
        a, b = lists.pop(0), lists.pop(0)
        if min(len(a), len(b)) <= 256:
            both = np.convolve(a, b)
        else:
            size = 1 << int(np.ceil(np.log2(len(a) + len(b) - 1)))
            both = np.maximum(np.fft.irfft(np.fft.rfft(a, size) * np.fft.rfft(b, size), size)[:len(a) + len(b) - 1], 0.0)
        lists.append(both / both.sum())
        lists.sort(key=len)
    return lists[0]


def _sums_test(x: DataFrame, by: list[str], value: str) -> DataFrame:
    """p of all sign patterns from the shares of each sum, for values on a common grid.

    The grid is the greatest common divisor of a group's values, written in the
    coarsest of GRIDS that holds them, so whole totals of any size cost no more
    than their ratios. Equal values are one entry with a count. A tree of
    convolutions joins leaves of some LEAVES values, spread over the tasks, level
    by level; the shares are exact to 1e-10. Values on no grid, or whose sums are more than REACH steps, stop
    the query with the group's name.
    """
    # The coarsest grid on which all values of the group stand, as whole numbers.
    on = [F.max(F.abs(F.abs(value) * g - F.round(F.abs(value) * g))) <= 1e-6 for g in GRIDS]
    grid = F.coalesce(*[F.when(o, F.lit(float(g))) for o, g in zip(on, GRIDS)])
    grids = x.groupBy(*by).agg(grid.alias("_grid"))
    sizes = x.join(grids, by).withColumn("_g", F.round(F.abs(value) * F.col("_grid")).cast("long"))
    sums = sizes.groupBy(*by, "_g").agg(F.count(F.lit(1)).alias("_m"), F.sum(F.signum(value)).cast("long").alias("_net"))
    fields = ", ".join(f"`{c}` {x.schema[c].dataType.simpleString()}" for c in by)

    def divisor(key, pdf: pd.DataFrame) -> pd.DataFrame:
        steps = pdf["_g"]
        if steps.isna().any():
            raise ValueError(f"group {dict(zip(by, key))}: over {EXACT_LIMIT} values that are on no grid of {GRIDS} parts of a unit; use signflip_test")
        return pd.DataFrame([[*key, int(np.gcd.reduce(steps.to_numpy(np.int64))), int(steps.max())]], columns=[*by, "_d", "_most"])

    # One row for each group: distinct sizes of a group, gathered by a divisor tree of their own.
    part = sums.withColumn("_part", F.pmod(F.xxhash64("_g"), F.lit(64)))
    first = part.groupBy(*by, "_part").applyInPandas(lambda key, pdf: divisor(key[:-1], pdf), f"{fields}, _d long, _most long")
    step = first.groupBy(*by).applyInPandas(
        lambda key, pdf: pd.DataFrame([[*key, int(np.gcd.reduce(pdf["_d"].to_numpy()))]], columns=[*by, "_d"]), f"{fields}, _d long")
    rows = sums.join(step, by).withColumn("_g", F.expr("_g div _d"))
    whole = materialise(rows.groupBy(*by).agg(F.sum(F.col("_g") * F.col("_m")).alias("_top"), F.abs(F.sum(F.col("_g") * F.col("_net"))).alias("_seen"), F.sum("_m").alias("_n")), "sums")
    over = whole.where(F.col("_top") > REACH).select(*by, "_top").limit(1).collect()
    if over:
        raise ValueError(f"group {over[0].asDict()}: over {EXACT_LIMIT} values whose sums reach over {REACH} steps; use signflip_test")
    each = rows.withColumn("_i", F.explode(F.expr(f"sequence(0L, (_m - 1) div {LEAVES})")))
    each = each.select(*by, "_g", F.least(F.lit(LEAVES), F.col("_m") - F.col("_i") * LEAVES).alias("_m"),
                       F.pmod(F.xxhash64("_g", "_i"), F.lit(1 << 30)).alias("_leaf"))
    leaves = whole.select(*by, F.ceil(F.col("_n") / LEAVES).alias("_leaves"))
    kinds = f"{fields}, _leaf long, _leaves long, shares binary"

    def leaf(key, pdf: pd.DataFrame) -> pd.DataFrame:
        made = _joined([_signs(np.repeat(int(g), int(m))) for g, m in zip(pdf["_g"], pdf["_m"])])
        return pd.DataFrame([[*key[:-1], int(key[-1]), int(pdf["_leaves"].iloc[0]), made.tobytes()]], columns=[*by, "_leaf", "_leaves", "shares"])

    def pair(key, pdf: pd.DataFrame) -> pd.DataFrame:
        made = _joined([np.frombuffer(b) for b in pdf["shares"]])
        return pd.DataFrame([[*key[:-1], int(key[-1]), int(pdf["_leaves"].iloc[0]), made.tobytes()]], columns=[*by, "_leaf", "_leaves", "shares"])

    tree = each.join(leaves, by).withColumn("_leaf", F.pmod("_leaf", F.col("_leaves"))).groupBy(*by, "_leaf").applyInPandas(leaf, kinds)
    most = leaves.agg(F.max("_leaves")).first()[0] or 1
    while most > 1:
        most = -(-most // 8)
        tree = tree.withColumn("_leaf", F.pmod("_leaf", F.lit(most))).groupBy(*by, "_leaf").applyInPandas(pair, kinds)

    def share(pdf: pd.DataFrame) -> pd.DataFrame:
        out = []
        for shares, top, seen, n in zip(pdf["shares"], pdf["_top"], pdf["_seen"], pdf["_n"]):
            s = np.frombuffer(shares)
            cut = (top - seen) // 2  # sums -top, -top + 2 ..: the places up to this one, and as many from the end
            far = 1.0 if seen == 0 else s[:cut + 1].sum() + s[len(s) - 1 - cut:].sum()
            patterns = 2.0 ** min(n, 1000)
            out.append((far * patterns + 1) / (patterns + 1))
        return pdf[by].assign(p_value=np.minimum(1.0, out))

    return tree.select(*by, "shares").join(whole, by).mapInPandas(lambda frames: map(share, frames), f"{fields}, p_value double")


def exact_sign_test(series: DataFrame, by: Sequence[str], value: str) -> DataFrame:
    """p over all 2^n sign patterns of the non-zero values.

    Up to 20 values the patterns are enumerated; beyond that their sums are
    counted, which needs values on a grid. A group that allows neither stops
    the query with its name.
    """
    by = list(by)
    x = series.where(F.col(value) != 0)
    size = x.groupBy(*by).agg(F.count(F.lit(1)).alias("n"))
    small = x.join(size.where(F.col("n") <= EXACT_LIMIT), by).groupBy(*by, "n").agg(
        F.collect_list(value).alias("_v"))
    high = F.explode(F.sequence(F.lit(0), F.shiftleft(F.lit(1), 10) - 1))
    masks = small.withColumn("_hi", high).repartition("_hi").withColumn("_lo", F.explode(
        F.sequence(F.lit(0), F.shiftleft(F.lit(1), 10) - 1)))
    mask = F.col("_hi") * 1024 + F.col("_lo")
    masks = masks.withColumn("_mask", mask).where(F.col("_mask") < F.pow(F.lit(2.0), "n"))
    flipped = F.aggregate(F.transform("_v", lambda v, i: F.when(
        (F.floor(F.col("_mask") / F.pow(F.lit(2.0), i)) % 2) == 1, -v).otherwise(v)), F.lit(0.0), lambda s, v: s + v)
    plain = F.aggregate("_v", F.lit(0.0), lambda s, v: s + v)
    g = masks.withColumns({"_s": X.rank_key(F.abs(flipped)), "_o": X.rank_key(F.abs(plain))}).groupBy(*by).agg(
        ((F.count_if(F.col("_s") >= F.col("_o")) + 1) / (F.count(F.lit(1)) + 1)).alias("p_value"))
    g = g.select(*by, "p_value")
    large = x.join(size.where(F.col("n") > EXACT_LIMIT).select(*by), by)
    if not size.where(F.col("n") > EXACT_LIMIT).isEmpty():
        g = g.unionByName(_sums_test(materialise(large.select(*by, value), "values"), by, value))
    return size.join(g, by)


def cohens_d(series: DataFrame, by: Sequence[str], value: str) -> DataFrame:
    sd = F.stddev_samp(value)
    return series.groupBy(*by).agg(
        F.count(value).alias("n"), F.when(F.count(value) >= 2, F.try_divide(F.avg(value), sd)).alias("cohens_d"))


def wilson_rows(df: DataFrame, by: Sequence[str]) -> DataFrame:
    lo, hi = X.wilson(F.col("wins"), F.col("n"))
    return df.groupBy(*by).agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("metric") > 0).alias("wins")
                               ).withColumns({"win_rate": F.col("wins") / F.col("n"), "ci_low": lo, "ci_high": hi})


def dealt(df: DataFrame, group: Sequence[str], order: str, seed: str) -> DataFrame:
    """``df`` (with a flag ``strong``) with what a deal of its flags inside ``group`` needs.

    _number (from 0, along ``order``), _n and _m (rows and flagged rows of the group) and _key.
    """
    group = list(group)
    x = O.position(df, group, [F.col(order)], "_number", "_n").withColumn("_number", F.col("_number") - 1)
    count = df.groupBy(*group).agg(F.count_if("strong").alias("_m"))
    return x.join(count, group).withColumn("_key", D.key_of(*[F.col(c) for c in group if c != "site"], seed))


def perm_diff_test(series: DataFrame, group: str, b: str, value: str, reps: int, seed: str = "p") -> DataFrame:
    """Two-sided p of a difference of means when the group labels are dealt out again; rows without a value are left out."""
    x = series.where(F.col(value).isNotNull()).withColumn("strong", F.coalesce(F.col(group) == b, F.lit(False)))
    total = x.groupBy(*SITE).agg(F.count(F.lit(1)).alias("_all"), F.sum(value).alias("_sum"))
    q, v = F.col("q"), F.col("v")
    diff = F.try_divide(v, q) - F.try_divide(F.col("_sum") - v, F.col("_all") - q)
    null = D.flag_sums(dealt(x, SITE, "day", seed), SITE, reps, value).join(total, SITE).select(*SITE, "rep", diff.alias("_null"))
    obs = null.where("rep = 0").select(*SITE, F.col("_null").alias("_obs"))
    return null.where("rep > 0").join(obs, SITE).groupBy(*SITE).agg(
        F.max("_obs").alias("observed"), p_two_sided("_null", "_obs", F.count(F.lit(1))).alias("p_value"))


# ---- spatial and group permutations ----------------------------------------------

def spatial_counts(panel: DataFrame, layout: DataFrame, threshold: float, reps: int, within: Sequence[str] = (),
                   seed: str = "x") -> DataFrame:
    """Strong pairs, triples and 3-of-5 windows per (day, rep) along unbroken slots of a segment side.

    Rep 0 is observed; each other rep deals the day's flags (or those of each ``within`` group) out again.
    """
    dim = layout.where("shape = 'rect'").select("site", "entity_id", "island_id", "side", "slot_index")
    rows = panel.select(*DAY, *within, "entity_id", "metric").join(dim, ["site", "entity_id"]).withColumn("strong", F.coalesce(F.col("metric") >= threshold, F.lit(False)))
    # one small row per (day, rep), read once as observed and once as null values
    return materialise(D.window_counts(dealt(rows, [*DAY, *within], "entity_id", seed), DAY, ["island_id", "side"], reps))


def null_summary(counts: DataFrame, statistics: Sequence[str], by: Sequence[str]) -> DataFrame:
    """Observed (rep 0) against the permuted values: null mean, interval, upper p, effect and ratio."""
    by = list(by)
    long = counts.unpivot([*by, "rep"], list(statistics), "statistic", "value")
    obs = long.where("rep = 0").select(*by, "statistic", F.col("value").alias("observed"))
    null = long.where("rep > 0").join(obs, [*by, "statistic"])
    v = F.col("value")
    return null.groupBy(*by, "statistic").agg(
        F.max("observed").alias("observed"), F.avg(v).alias("null_mean"),
        F.percentile(v, F.lit(0.025)).alias("null_low"), F.percentile(v, F.lit(0.975)).alias("null_high"),
        ((1 + F.count_if(v >= F.col("observed"))) / (F.count(v) + 1)).alias("p_upper")
    ).withColumns({"effect": F.col("observed") - F.col("null_mean"),
                   "ratio": F.try_divide(F.col("observed").cast("double"), F.col("null_mean"))})


def spatial_test(panel: DataFrame, layout: DataFrame, threshold: float, reps: int, within: Sequence[str] = ()) -> DataFrame:
    return null_summary(spatial_counts(panel, layout, threshold, reps, within), ["pairs", "triples", "fives"], DAY)


def group_event_counts(panel: DataFrame, threshold: float, reps: int, mode: str = "SOFT", seed: str = "g") -> DataFrame:
    """Qualifying label groups per (day, rep), overall and by size stratum; groups under three are left out."""
    hit = F.col("metric") >= threshold if mode == "SOFT" else F.col("metric") > 0
    x = panel.select(*DAY, "label", "entity_id", F.coalesce(hit, F.lit(False)).alias("strong"))
    size = x.groupBy(*DAY, "label").agg(F.count(F.lit(1)).alias("size")).where("size >= 3")
    g = D.flag_sums(dealt(x, DAY, "entity_id", seed), [*DAY, "label"], reps).join(size, [*DAY, "label"])
    need = F.ceil(F.col("size") * 2.0 / 3.0) if mode == "SOFT" else F.col("size")
    g = g.withColumns({"event": F.col("q") >= need, "stratum": A.size_stratum(F.col("size"))})
    return materialise(g.groupBy(*DAY, "rep").agg(
        F.count_if("event").alias("overall"),
        *[F.count_if(F.col("event") & (F.col("stratum") == s)).alias(n) for s, n in (
            ("3-4", "s3_4"), ("5-9", "s5_9"), ("10+", "s10"))]))


def group_event_test(panel: DataFrame, threshold: float, reps: int, mode: str = "SOFT") -> DataFrame:
    return null_summary(group_event_counts(panel, threshold, reps, mode), ["overall", "s3_4", "s5_9", "s10"], DAY)


def period_summary(counts: DataFrame, statistics: Sequence[str], later_from: str) -> DataFrame:
    """FULL, DEV and LATER periods: day counts are summed per rep before they are compared."""
    half = F.when(F.col("day") < F.lit(later_from).cast("date"), "DEV").otherwise("LATER")
    x = counts.withColumn("period", F.explode(F.array(F.lit("FULL"), half)))
    per = x.groupBy(*SITE, "period", "rep").agg(*[F.sum(s).alias(s) for s in statistics])
    return null_summary(per, statistics, [*SITE, "period"])


def holm(tests: DataFrame, by: Sequence[str], p: str = "p_value", tie: str = "name") -> DataFrame:
    """Step-down adjusted p-values inside a family of tests."""
    w = Window.partitionBy(*by)
    order = w.orderBy(p, tie)
    x = tests.withColumn("_raw", F.least(F.lit(1.0), F.col(p) * (
        F.count(F.lit(1)).over(w) - F.row_number().over(order) + 1)))
    return x.withColumn("p_holm", F.max("_raw").over(order.rowsBetween(Window.unboundedPreceding, 0))).drop("_raw")
