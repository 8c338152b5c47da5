"""Grouped summaries of a panel. Every aggregate combines on the map side."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from dayloom.functions import expr as X
from dayloom.operators import ordering as O
from dayloom.panel import DAY, ENTITY, LABEL, SITE

T = (50, 100, 200)


def rate(cond: Column) -> Column:
    """Share of rows for which the condition holds."""
    return F.avg(cond.cast("int"))


def core(t: Sequence[float] = T) -> list[Column]:
    m = F.col("metric")
    out = [
        F.count(F.lit(1)).alias("n"), F.sum(m).alias("total"), F.avg(m).alias("mean"),
        rate(m > 0).alias("win_rate"), F.min(m).alias("lo"), F.max(m).alias("hi"),
    ]
    return out + [F.count_if(m >= v).alias(f"n_{v:g}") for v in t]


def summary(df: DataFrame, by: Sequence[str] = SITE) -> DataFrame:
    m = F.col("metric")
    return df.groupBy(*by).agg(
        F.count(F.lit(1)).alias("n"), F.countDistinct("day").alias("days"), F.sum("activity").alias("activity"),
        F.sum(m).alias("total"), F.avg(m).alias("mean"), F.avg("activity").alias("mean_activity"),
        F.count_if(m > 0).alias("plus"), F.count_if(m == 0).alias("even"), F.count_if(m < 0).alias("minus"),
        rate(m > 0).alias("win_rate"),
    )


def by_label(df: DataFrame, t: Sequence[float] = T) -> DataFrame:
    return df.groupBy(*LABEL).agg(*core(t), F.avg("c1").alias("mean_c1"), F.avg("c2").alias("mean_c2"))


def by_entity(df: DataFrame) -> DataFrame:
    """An entity has at most one row per day, so its label set and median stay small."""
    return df.groupBy(*ENTITY).agg(
        F.countDistinct("day").alias("days"),
        F.concat_ws(" / ", F.array_sort(F.collect_set("label"))).alias("labels"),
        F.sum("metric").alias("total"), F.avg("metric").alias("mean"), rate(F.col("metric") > 0).alias("win_rate"),
        F.median("metric").alias("median"),
    )


def by_day(df: DataFrame, t: Sequence[float] = T) -> DataFrame:
    return df.groupBy(*DAY).agg(*core(t), F.sum("activity").alias("activity"))


def by_weekday(df: DataFrame, extra: Sequence[str] = ()) -> DataFrame:
    return (
        df.withColumn("weekday", F.weekday("day")).groupBy(*SITE, *extra, "weekday")
        .agg(F.countDistinct("day").alias("days"), *core())
    )


def by_entity_label(df: DataFrame) -> DataFrame:
    pair = df.groupBy(*ENTITY, "label").agg(
        F.count(F.lit(1)).alias("n"), F.avg("metric").alias("mean"), F.max("metric").alias("hi"),
        F.min("metric").alias("lo"), F.max("day").alias("last_day"),
    )
    newest = Window.partitionBy(*ENTITY)
    return pair.withColumn("is_current", F.col("last_day") == F.max("last_day").over(newest))


def entity_lifetime(df: DataFrame) -> DataFrame:
    """Labels in first-seen order, number of labels and of label changes per entity."""
    first = df.groupBy(*ENTITY, "label").agg(F.min("day").alias("first_day"))
    order = first.groupBy(*ENTITY).agg(
        F.count(F.lit(1)).alias("labels"),
        F.array_join(F.transform(
            F.array_sort(F.collect_list(F.struct("first_day", "label"))), lambda s: s["label"]
        ), " > ").alias("label_order"),
    )
    w = Window.partitionBy(*ENTITY).orderBy("day")
    life = (
        df.withColumn("_change", (F.col("label") != F.lag("label").over(w)).cast("int"))
        .groupBy(*ENTITY).agg(
            F.count(F.lit(1)).alias("days"), F.coalesce(F.sum("_change"), F.lit(0)).alias("changes"),
            F.max_by("label", "day").alias("current_label"), F.min("day").alias("first_day"),
            F.max("day").alias("last_day"),
        )
    )
    return life.join(order, ENTITY)


def label_strength(df: DataFrame) -> DataFrame:
    m = F.col("metric")
    return df.groupBy(*LABEL).agg(
        F.countDistinct("entity_id").alias("entities"), F.countDistinct("day").alias("days"),
        F.count(F.lit(1)).alias("n"), F.count_if(m > 0).alias("plus"), F.count_if(m == 0).alias("even"),
        F.count_if(m < 0).alias("minus"), F.avg(m).alias("mean"),
    )


def quantiles(df: DataFrame, by: Sequence[str], qs: Mapping[str, float], value: str = "metric") -> DataFrame:
    return O.exact_quantiles(df, by, value, dict(qs))


def spread(df: DataFrame, by: Sequence[str], value: str = "metric") -> DataFrame:
    """Population and sample deviation; the sample form is 0 below two rows."""
    return df.groupBy(*by).agg(
        F.count(value).alias("n"), F.stddev_pop(value).alias("sd_pop"),
        F.when(F.count(value) < 2, 0.0).otherwise(F.stddev_samp(value)).alias("sd_samp"),
    )


def top_values(df: DataFrame, column: str, n: int) -> DataFrame:
    return df.groupBy(column).agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), column).limit(n)


def daily_then_overall(df: DataFrame, by: Sequence[str]) -> DataFrame:
    """Mean per day first, then over days, so each day weighs the same."""
    daily = df.groupBy(*DAY, *by).agg(F.avg("metric").alias("day_mean"), F.count(F.lit(1)).alias("day_n"))
    return daily.groupBy(*SITE, *by).agg(
        F.count(F.lit(1)).alias("days"), F.sum("day_n").alias("n"), F.avg("day_mean").alias("mean_of_days"),
        rate(F.col("day_mean") > 0).alias("positive_day_rate"),
    )


def multi_key(df: DataFrame, keys: Sequence[Column]) -> DataFrame:
    """The same summary over several alternative keys and over everything, in one pass.

    Keys become (dimension, value) pairs, so partial aggregation happens before
    the only shuffle, whatever the number of keys.
    """
    pairs = F.array(F.struct(F.lit("ALL").alias("dimension"), F.lit("ALL").alias("value")), *[
        F.struct(F.lit(name).alias("dimension"), c.cast("string").alias("value")) for name, c in keys
    ])
    return (
        df.withColumn("_p", F.explode(pairs)).groupBy("site", "_p.dimension", "_p.value").agg(
            F.count(F.lit(1)).alias("n"), F.avg("metric").alias("mean"), rate(F.col("metric") > 0).alias("win_rate"))
    )


def by_period(daily: DataFrame, kind: str, block: int = 4) -> DataFrame:
    """Month, ISO week or blocks of N observed days over one row per (site, day)."""
    if kind == "block":
        w = Window.partitionBy(*SITE).orderBy("day")
        period = (F.floor((F.dense_rank().over(w) - 1) / block) + 1).cast("string")
    else:
        period = F.date_trunc(kind, "day").cast("date").cast("string")
    return daily.withColumn("period", period).groupBy(*SITE, "period").agg(
        F.min("day").alias("start"), F.max("day").alias("end"), F.count(F.lit(1)).alias("days"),
        F.avg("mean").alias("mean"), F.sum("total").alias("total"), F.count_if(F.col("mean") > 0).alias("positive"),
        rate(F.col("mean") > 0).alias("positive_rate"),
    )


def half_split(daily: DataFrame) -> DataFrame:
    """First floor(n/2) days against the rest."""
    w = Window.partitionBy(*SITE)
    n = F.count(F.lit(1)).over(w)
    first = F.row_number().over(w.orderBy("day")) <= F.floor(n / 2)
    d = daily.withColumn("_first", first)
    a, b = F.when(F.col("_first"), F.col("mean")), F.when(~F.col("_first"), F.col("mean"))
    return d.groupBy(*SITE).agg(
        F.count(a).alias("first_days"), F.count(b).alias("second_days"), F.avg(a).alias("first_mean"),
        F.avg(b).alias("second_mean"), (F.avg(b) - F.avg(a)).alias("change"),
    )


def trailing(daily: DataFrame, windows: Sequence[int]) -> DataFrame:
    """Summary of the last w days for each w the series is long enough for."""
    w = Window.partitionBy(*SITE)
    d = daily.withColumn("_back", F.row_number().over(w.orderBy(F.desc("day")))).withColumn(
        "_n", F.count(F.lit(1)).over(w))
    d = d.withColumn("window_days", F.explode(F.array(*[F.lit(x) for x in windows])))
    return d.where((F.col("_back") <= F.col("window_days")) & (F.col("window_days") <= F.col("_n"))).groupBy(
        *SITE, "window_days").agg(
        F.min("day").alias("start"), F.max("day").alias("end"), F.avg("mean").alias("mean"),
        F.median("mean").alias("median"), F.sum("total").alias("total"),
        rate(F.col("mean") > 0).alias("positive_rate"))


def unpivot(df: DataFrame, ids: Sequence[str], features: Sequence[str], name="feature", value="x") -> DataFrame:
    return df.unpivot(list(ids), [F.col(f).cast("double").alias(f) for f in features], name, value)


def correlate(df: DataFrame, features: Sequence[str], target: str, min_n: int = 10) -> DataFrame:
    """Pearson correlation of each feature with the target, null below min_n pairs."""
    long = unpivot(df, ["site", target], features).where(F.col("x").isNotNull() & F.col(target).isNotNull())
    return long.groupBy("site", "feature").agg(
        F.count(F.lit(1)).alias("n"),
        F.when(F.count(F.lit(1)) >= min_n, F.corr("x", target)).alias("pearson"))


def spearman(df: DataFrame, x: str, y: str, by: Sequence[str]) -> DataFrame:
    """Pearson correlation of average ranks."""
    clean = df.where(F.col(x).isNotNull() & F.col(y).isNotNull()).select(*by, x, y)
    ranked = O.rank_positions(clean, by, x, "_rx").drop("_rx_min", "_rx_dense")
    ranked = O.rank_positions(ranked, by, y, "_ry")
    return ranked.groupBy(*by).agg(F.count(F.lit(1)).alias("n"), F.corr("_rx", "_ry").alias("spearman"))


def quintile_of(rn: Column, n: Column, k: int = 5) -> Column:
    """Bin of the rn-th of n ordered rows under linear-quantile edges."""
    return F.when(n == 1, 1).otherwise(F.greatest(F.lit(1), F.ceil((rn - 1) * k / (n - 1)))).cast("int")


def quintiles(df: DataFrame, feature: str, target: str = "metric", by: Sequence[str] = SITE) -> DataFrame:
    ranked = O.position(
        df.where(F.col(feature).isNotNull()), by, [F.col(feature), F.col("day"), F.col("entity_id")], "_rn", "_n")
    return ranked.withColumn("quintile", quintile_of(F.col("_rn"), F.col("_n"))).groupBy(*by, "quintile").agg(
        F.count(F.lit(1)).alias("n"), F.avg(feature).alias("mean_feature"), F.avg(target).alias("mean_target"),
        rate(F.col(target) > 0).alias("win_rate"))


def quintile_spread(table: DataFrame, by: Sequence[str] = SITE) -> DataFrame:
    """Q5 minus Q1 and the strength used to order factors."""
    q = lambda k, c: F.max(F.when(F.col("quintile") == k, F.col(c)))
    return table.groupBy(*by).agg(
        (q(5, "mean_target") - q(1, "mean_target")).alias("spread"),
        (q(5, "win_rate") - q(1, "win_rate")).alias("win_spread"),
    ).withColumn("strength", F.abs("spread"))


def median_split(df: DataFrame, x: str, y: str = "metric", inclusive: bool = False) -> DataFrame:
    """Rows above the median of x against the rest (``inclusive`` counts equality as high)."""
    mid = O.exact_quantiles(df, SITE, x, {"_mid": 0.5})
    high = F.col(x) >= F.col("_mid") if inclusive else F.col(x) > F.col("_mid")
    return O.attach(df, mid, SITE).withColumn("half", F.when(high, "HIGH").otherwise("LOW")).groupBy(*SITE, "half").agg(
        F.count(F.lit(1)).alias("n"), F.avg(y).alias("mean"), rate(F.col(y) > 0).alias("win_rate"))


def group_contrast(df: DataFrame, flag: Column, features: Sequence[str]) -> DataFrame:
    long = unpivot(df.withColumn("_flag", flag.cast("int")), ["site", "_flag"], features)
    on, off = F.when(F.col("_flag") == 1, F.col("x")), F.when(F.col("_flag") == 0, F.col("x"))
    return long.groupBy("site", "feature").agg(
        F.avg(on).alias("mean_yes"), F.avg(off).alias("mean_no"), (F.avg(on) - F.avg(off)).alias("difference"))


def risk_stats(daily: DataFrame, by: Sequence[str] = SITE, value: str = "total") -> DataFrame:
    v = F.col(value)
    gain = F.coalesce(F.sum(F.when(v > 0, v)), F.lit(0.0))
    loss = F.coalesce(-F.sum(F.when(v < 0, v)), F.lit(0.0))
    return daily.groupBy(*by).agg(
        F.count(v).alias("days"), gain.alias("gross_gain"), loss.alias("gross_loss"),
        F.try_divide(gain, loss).alias("profit_factor"), F.max(v).alias("best"), F.min(v).alias("worst"),
        F.max_by("day", F.struct(v, F.col("day"))).alias("best_day"),
        F.min_by("day", F.struct(v, F.col("day"))).alias("worst_day"))


def session_summary(df: DataFrame, by: Sequence[str], invested: str, recovered: str) -> DataFrame:
    """Sessions, amounts, wins, mean profit, win rate and return on what was invested, per group; missing amounts count as 0."""
    i, r = (F.coalesce(F.col(c), F.lit(0)) for c in (invested, recovered))
    return df.groupBy(*by).agg(
        F.count(F.lit(1)).alias("sessions"), F.sum(i).alias("invested"), F.sum(r).alias("recovered"), F.sum(r - i).alias("profit"),
        F.count_if(r > i).alias("wins"), F.avg((r - i).cast("double")).alias("mean_profit"), (rate(r > i) * 100).alias("win_rate"),
        (F.try_divide(F.sum(r).cast("double"), F.sum(i).cast("double")) * 100).alias("roi"))


def crosstab(df: DataFrame, row: Sequence[str], column: str) -> DataFrame:
    """Counts of each (row, column) cell in long form, empty cells as 0, with the totals of the row and of the column."""
    cells = df.groupBy(*row, column).agg(F.count(F.lit(1)).alias("n"))
    rows = cells.groupBy(*row).agg(F.sum("n").alias("row_total"))
    columns = cells.groupBy(column).agg(F.sum("n").alias("column_total"))
    names = columns.agg(F.sort_array(F.collect_set(column)).alias("_all"))  # the distinct columns: a cell of the header
    full = O.attach(rows.withColumn("_k", F.lit(1)), names.withColumn("_k", F.lit(1)), ["_k"]).withColumn(column, F.explode("_all")).drop("_k", "_all")
    return O.attach(full.join(cells, [*row, column], "left"), columns, [column]).withColumn("n", F.coalesce("n", F.lit(0)))


def drop_extremes(daily: DataFrame, by: Sequence[str] = SITE, value: str = "total") -> DataFrame:
    """Totals with the best one or two and the worst one day taken out."""
    w = Window.partitionBy(*by)
    d = daily.withColumn("_hi", F.row_number().over(w.orderBy(F.desc(value), "day"))).withColumn(
        "_lo", F.row_number().over(w.orderBy(value, "day")))
    return d.groupBy(*by).agg(
        F.sum(value).alias("total"),
        F.sum(F.when(F.col("_hi") > 1, F.col(value))).alias("without_best1"),
        F.sum(F.when(F.col("_hi") > 2, F.col(value))).alias("without_best2"),
        F.sum(F.when(F.col("_lo") > 1, F.col(value))).alias("without_worst1"),
        F.max(F.when(F.col("_hi") == 1, F.col("day"))).alias("best_day"),
        F.max(F.when(F.col("_lo") == 1, F.col("day"))).alias("worst_day"))


def concentration(daily: DataFrame, by: Sequence[str] = SITE, value: str = "total", ks=(1, 3, 5)) -> DataFrame:
    """Share of all gains made on the k best days."""
    w = Window.partitionBy(*by).orderBy(F.desc(value), "day")
    d = daily.where(F.col(value) > 0).withColumn("_r", F.row_number().over(w))
    return d.groupBy(*by).agg(F.sum(value).alias("gains"), *[
        F.try_divide(F.sum(F.when(F.col("_r") <= k, F.col(value))), F.sum(value)).alias(f"top{k}_share") for k in ks])


def trend(daily: DataFrame, by: Sequence[str], value: str = "mean", last: int | None = None) -> DataFrame:
    """Least-squares slope over the (last) observed days, numbered 0, 1, 2, …"""
    w = Window.partitionBy(*by)
    d = daily.withColumn("_x", F.row_number().over(w.orderBy("day")) - 1).withColumn(
        "_n", F.count(F.lit(1)).over(w))
    if last:
        d = d.where(F.col("_x") >= F.col("_n") - last)
    return d.groupBy(*by).agg(F.count(F.lit(1)).alias("days"), F.regr_slope(value, "_x").alias("slope"))


def condition_table(df: DataFrame, conditions: Sequence[tuple[str, Column]], target: str = "metric") -> DataFrame:
    """One pass over the features; a row counts once for every condition it meets."""
    hits = F.array_compact(F.array(*[F.when(cond, F.lit(name)) for name, cond in conditions]))
    y = F.col(target)
    return df.select("site", target, F.explode(hits).alias("condition")).groupBy("site", "condition").agg(
        F.count(F.lit(1)).alias("n"), F.avg(y).alias("mean"), rate(y > 0).alias("win_rate"),
        rate(y >= T[1]).alias("strong_rate"))


def rank_conditions(table: DataFrame, full_n: int = 30) -> DataFrame:
    """Order by mean damped for small support."""
    return table.withColumn("support", F.least(F.col("n") / full_n, F.lit(1.0))).withColumn(
        "score", F.col("mean") * F.col("support"))


def daily_strength(df: DataFrame, t: float = T[1]) -> DataFrame:
    return df.groupBy(*DAY).agg(
        F.count(F.lit(1)).alias("n"), F.count_if(F.col("metric") >= t).alias("strong")
    ).withColumn("strength", F.col("strong") / F.col("n"))


def special_days(df: DataFrame, t: Sequence[float] = T) -> DataFrame:
    """Weighted z-scores of the daily aggregates, binned at 40 / 50 / 60."""
    m = F.col("metric")
    daily = df.groupBy(*DAY).agg(
        F.avg(m).alias("mean"), rate(m > 0).alias("win"),
        *[F.count_if(m >= v).alias(f"n{i}") for i, v in enumerate(t)])
    w = Window.partitionBy(*SITE)  # one row per day

    def z(c):
        sd = F.stddev_samp(c).over(w)
        return (F.col(c) - F.avg(c).over(w)) / F.when(F.coalesce(sd, F.lit(0.0)) == 0, 1.0).otherwise(sd)

    score = 45 + 20 * z("mean") + 15 * z("win") + 10 * z("n0") + 5 * z("n1") + 5 * z("n2")
    return daily.withColumn("score", score).withColumn(
        "band", X.cut(F.col("score"), [40, 50, 60], ["LOW", "NORMAL", "HIGH", "TOP"]))


def shrunk(df: DataFrame, by: Sequence[str], prior_n: float = 30.0) -> DataFrame:
    """Group means and win rates pulled towards the site's own."""
    m = F.col("metric")
    site = df.groupBy(*SITE).agg(F.avg(m).alias("_site_mean"), rate(m > 0).alias("_site_win"))
    g = df.groupBy(*SITE, *by).agg(
        F.count(F.lit(1)).alias("n"), F.sum(m).alias("_s"), F.count_if(m > 0).alias("_k"))
    return O.attach(g, site, SITE).select(
        *SITE, *by, "n", X.shrink(F.col("_s"), F.col("n"), F.col("_site_mean"), prior_n).alias("eb_mean"),
        X.shrink(F.col("_k"), F.col("n"), F.col("_site_win"), prior_n).alias("eb_rate"))


def pivot_rank_day(picks: DataFrame, value: str = "metric") -> DataFrame:
    """Rank by day matrix in long form, one row for each cell, with the total of the rank: every day of the picks has its cell."""
    cells = picks.groupBy(*DAY, "rank").agg(F.sum(value).alias("value"))
    return cells.withColumn("row_total", F.sum("value").over(Window.partitionBy("site", "rank")))


def evaluate_topn(picks: DataFrame, actual: DataFrame, bands: Sequence[tuple[str, int, int]], t: float = T[1],
                  by: Sequence[str] = ()) -> DataFrame:
    """Picked rows against the whole day: means, win rates, lift and excess per band.

    ``picks`` holds at most N rows per day; the day's population is one row per day.
    """
    m = F.col("metric")
    population = actual.groupBy(*DAY).agg(
        F.count(F.lit(1)).alias("pop_n"), F.avg(m).alias("pop_mean"), rate(m > 0).alias("pop_win"))
    band = F.filter(F.array(*[
        F.struct(F.lit(n).alias("band"), F.lit(lo).alias("lo"), F.lit(hi).alias("hi")) for n, lo, hi in bands
    ]), lambda s: (F.col("rank") >= s["lo"]) & (F.col("rank") <= s["hi"]))
    daily = picks.withColumn("_b", F.explode(band)).withColumn("band", F.col("_b.band")).groupBy(*DAY, *by, "band").agg(
        F.count(F.lit(1)).alias("n"), F.avg(m).alias("mean"), F.median(m).alias("median"),
        rate(m > 0).alias("win_rate"), rate(m >= t).alias("strong_rate"), F.sum(m).alias("total"))
    return daily.join(population, DAY).withColumn("excess", F.col("mean") - F.col("pop_mean")).withColumn(
        "win_lift", F.try_divide(F.col("win_rate"), F.col("pop_win")))


def overall(daily: DataFrame, by: Sequence[str]) -> DataFrame:
    return daily.groupBy(*SITE, *by).agg(
        F.countDistinct("day").alias("days"), F.avg("mean").alias("mean"), F.avg("win_rate").alias("win_rate"),
        rate(F.col("total") > 0).alias("positive_day_rate"), F.sum("total").alias("total"),
        F.min("mean").alias("worst_mean"), F.max("mean").alias("best_mean"))


def by_rank(picks: DataFrame, group: Column | None = None) -> DataFrame:
    key = (group if group is not None else F.col("rank")).alias("rank_group")
    m = F.col("metric")
    return picks.groupBy("site", key).agg(
        F.count(F.lit(1)).alias("n"), F.avg(m).alias("mean"), rate(m > 0).alias("win_rate"), F.sum(m).alias("total"),
        F.min(m).alias("lo"), F.max(m).alias("hi"))


def paired_summary(pairs: DataFrame, change: str, by: Sequence[str] = SITE) -> DataFrame:
    c = F.col(change)
    return pairs.groupBy(*by).agg(
        F.count(c).alias("pairs"), F.count_if(c > 0).alias("better"), F.count_if(c == 0).alias("same"),
        F.count_if(c < 0).alias("worse"), F.avg(c).alias("mean_change"), F.median(c).alias("median_change"),
        F.sum(c).alias("total_change"), F.min(c).alias("min_change"), F.max(c).alias("max_change"))


def extremes(df: DataFrame, n: int, value: str = "metric") -> DataFrame:
    """n lowest and n highest rows."""
    low = df.orderBy(value, "day", "entity_id").limit(n).withColumn("side", F.lit("LOW"))
    high = df.orderBy(F.desc(value), "day", "entity_id").limit(n).withColumn("side", F.lit("HIGH"))
    return low.unionByName(high)




def size_stratum(n: Column) -> Column:
    return F.when(n < 3, "REFERENCE").when(n <= 4, "3-4").when(n <= 9, "5-9").otherwise("10+")


def group_events(df: DataFrame, threshold: float, mode: str = "SOFT", by: Sequence[str] = DAY) -> DataFrame:
    """Label groups of a day in which enough members qualify, counted per size stratum."""
    hit = F.col("metric") >= threshold if mode == "SOFT" else F.col("metric") > 0
    groups = df.groupBy(*by, "label").agg(F.count(F.lit(1)).alias("size"), F.count_if(hit).alias("qualifying"))
    need = F.ceil(F.col("size") * 2.0 / 3.0) if mode == "SOFT" else F.col("size")
    return groups.withColumn("stratum", size_stratum(F.col("size"))).groupBy(*by, "stratum").agg(
        F.count(F.lit(1)).alias("groups"), F.count_if(F.col("qualifying") >= need).alias("events"))
