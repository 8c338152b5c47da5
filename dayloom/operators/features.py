"""Leakage-free history features: every frame ends on the row before the target day."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from dayloom.operators import ordering as O
from dayloom.panel import DAY, ENTITY, SITE
from dayloom.session import materialise

# The same features as window SQL, for the comparison queries.
SQL_PRIOR_BASIC = """prior AS (
  SELECT *, lag(metric) OVER e AS last, lag(activity) OVER e AS last_activity,
    avg(metric) OVER (e ROWS BETWEEN 3 PRECEDING AND 1 PRECEDING) AS mean3,
    avg(metric) OVER (e ROWS BETWEEN 7 PRECEDING AND 1 PRECEDING) AS mean7,
    avg((metric>0)::INT) OVER (e ROWS BETWEEN 7 PRECEDING AND 1 PRECEDING) AS win7
  FROM panel WINDOW e AS (PARTITION BY entity_id ORDER BY day))"""


def back(by: Sequence[str], n: int | None = None, order: str = "day"):
    """The n rows before the current one; all earlier rows when n is None."""
    w = Window.partitionBy(*by).orderBy(order)
    return w.rowsBetween(Window.unboundedPreceding if n is None else -n, -1)


def prior_features(df: DataFrame, by: Sequence[str], value: str, ns: Sequence[int], prefix: str = "") -> DataFrame:
    """History size, last value, and per n the mean, deviation and win rate of the n rows before."""
    w = Window.partitionBy(*by).orderBy("day")
    v = F.col(value)
    cols: dict[str, Column] = {
        f"{prefix}hist": F.count(v).over(back(by)), f"{prefix}last": F.lag(value).over(w),
    }
    for n in ns:
        cols[f"{prefix}mean{n}"] = F.avg(v).over(back(by, n))
        cols[f"{prefix}std{n}"] = F.stddev_pop(v).over(back(by, n))
        cols[f"{prefix}win{n}"] = F.avg((v > 0).cast("int")).over(back(by, n))
    return df.withColumns(cols)


def prior_basic(df: DataFrame) -> DataFrame:
    w = Window.partitionBy(*ENTITY).orderBy("day")
    return df.withColumns({
        "last": F.lag("metric").over(w), "last_activity": F.lag("activity").over(w),
        "mean3": F.avg("metric").over(back(ENTITY, 3)), "mean7": F.avg("metric").over(back(ENTITY, 7)),
        "win7": F.avg((F.col("metric") > 0).cast("int")).over(back(ENTITY, 7)),
    })


# ---- the ranking feature panel ------------------------------------------

FACTORS = ["avg_all", "recent7", "last", "change", "weekday_avg", "label_avg", "rate1", "rate2", "neighbour"]
EXTRA_FACTORS = ["recent7_win", "bounce", "entity_shrunk", "band10_avg", "band50_avg", "edge"]


def means_before(panel: DataFrame, dims: dict[str, Column]) -> DataFrame:
    """Mean over all earlier days for every value of several dimensions.

    One pass turns each row into (dimension, key) cells that combine on the map
    side to one row per cell and day. That table (days x cells) is written
    once, because every dimension is then looked up in it.
    """
    m = F.col("metric")
    cells = F.array(*[F.struct(F.lit(d).alias("dim"), k.cast("string").alias("key")) for d, k in dims.items()])
    daily = panel.select("site", "day", "metric", F.explode(cells).alias("c")).groupBy(
        "site", "c.dim", "c.key", "day").agg(F.sum(m).alias("_s"), F.count(m).alias("_c"))
    past = back(["site", "dim", "key"])
    return materialise(daily.select("site", "dim", "key", "day", (
        F.sum("_s").over(past) / F.sum("_c").over(past)).alias("before")))


def rank_features(panel: DataFrame, t1: float = 100, t2: float = 200, half: float | None = None,
                  extras: Sequence[str] = EXTRA_FACTORS) -> DataFrame:
    """Features of every (entity, day) from the days before it, for all days in one plan.

    Entity history comes from frames over the entity's rows (row tails, not
    calendar windows); label, band and site means from per-day sums. Rows whose
    label differs from the entity's last known label are dropped. ``extras``
    names the optional factors; leaving one out also leaves out its joins.
    """
    from dayloom.operators import windows as WN

    half = t1 / 2 if half is None else half
    m, e = F.col("metric"), F.col("entity_id")
    rows = Window.partitionBy(*ENTITY).orderBy("day")
    past, past7 = back(ENTITY), back(ENTITY, 7)
    same_wd = Window.partitionBy(*ENTITY, "wd").orderBy("day").rowsBetween(Window.unboundedPreceding, -1)
    x = panel.withColumn("wd", F.weekday("day"))
    h = x.withColumns({
        "hist_n": F.count(m).over(past), "_hsum": F.sum(m).over(past), "avg_all": F.avg(m).over(past),
        "recent7": F.avg(m).over(past7), "recent7_win": F.avg((m > 0).cast("int")).over(past7),
        "last": F.lag("metric").over(rows), "_prev": F.lag("metric", 2).over(rows),
        "last_label": F.lag("label").over(rows), "rate1": F.avg((m >= t1).cast("int")).over(past),
        "rate2": F.avg((m >= t2).cast("int")).over(past), "_wn": F.count(m).over(same_wd),
        "_wavg": F.avg(m).over(same_wd),
    }).where("hist_n > 0 AND last_label = label")

    # dimension means the caller needs, keyed by their text form
    dims = {"label": F.col("label")}
    site_needed = {"entity_shrunk", "band10_avg", "band50_avg"} & set(extras)
    if site_needed:
        dims["site"] = F.lit("")
    for k in (10, 50):
        if f"band{k}_avg" in extras:
            dims[f"band{k}"] = e - F.pmod(e, F.lit(k))
    before = means_before(panel, dims)
    names = {"label": "_label_avg", "site": "site_avg", "band10": "_b10", "band50": "_b50"}
    for dim, key in dims.items():
        side = before.where(F.col("dim") == dim).select(
            "site", "day", F.col("key").alias("_key"), F.col("before").alias(names[dim]))
        h = h.withColumn("_key", key.cast("string")).join(side, [*DAY, "_key"], "left").drop("_key")

    days = panel.select(*DAY).distinct()
    following = days.withColumn("next_day", F.lead("day").over(Window.partitionBy(*SITE).orderBy("day")))
    sent = panel.select(*DAY, "entity_id", "metric").join(following, DAY).select(
        "site", F.col("next_day").alias("day"), "metric", F.explode(F.array(e - 1, e + 1)).alias("entity_id"))
    nb = sent.groupBy(*DAY, "entity_id").agg(F.avg("metric").alias("_nb"))
    h = h.join(nb, [*DAY, "entity_id"], "left")
    if "edge" in extras:
        h = h.join(WN.number_runs(panel).select(*ENTITY, "edge_distance"), ENTITY, "left")

    w = F.col("_wn") / (F.col("_wn") + 15.0)
    more = {
        "recent7_win": lambda: F.col("recent7_win"),
        "bounce": lambda: F.when(F.col("last") <= -t1, 1.0).when(F.col("last") <= -half, 0.5).when(
            F.col("last") >= t1, -0.25).otherwise(0.0),
        "entity_shrunk": lambda: (F.col("_hsum") + F.col("site_avg") * 30.0) / (F.col("hist_n") + 30.0),
        "band10_avg": lambda: F.coalesce("_b10", "site_avg"), "band50_avg": lambda: F.coalesce("_b50", "site_avg"),
        "edge": lambda: F.when(F.col("edge_distance") == 0, 1.0).when(F.col("edge_distance") == 1, 0.75).when(
            F.col("edge_distance") == 2, 0.5).when(F.col("edge_distance") <= 4, 0.25).otherwise(0.0),
    }
    return h.select(
        "site", "day", "entity_id", "label", "metric", "activity", "hist_n", "avg_all", "recent7", "last",
        (F.col("last") - F.coalesce("_prev", "last")).alias("change"),
        (F.coalesce("_wavg", "avg_all") * w + F.col("avg_all") * (1 - w)).alias("weekday_avg"),
        F.coalesce("_label_avg", F.lit(0.0)).alias("label_avg"), "rate1", "rate2",
        F.coalesce("_nb", F.lit(0.0)).alias("neighbour"), *[more[c]().alias(c) for c in extras])


def with_next_day(panel: DataFrame) -> DataFrame:
    """The panel plus tomorrow's rows: the latest day's inventory, dated one day on, with no outcome."""
    latest = panel.groupBy(*SITE).agg(F.max("day").alias("_last"))
    tomorrow = O.attach(panel, latest, SITE).where("day = _last").select(
        "site", F.date_add("day", 1).alias("day"), "entity_id", "label",
        *[F.lit(None).cast(t).alias(c) for c, t in (("activity", "double"), ("metric", "double"),
                                                    ("c1", "bigint"), ("c2", "bigint"))])
    return panel.select(tomorrow.columns).unionByName(tomorrow)


def future_features(panel: DataFrame, **kw) -> DataFrame:
    """Features for the day after the latest one; the outcome column stays null."""
    return rank_features(with_next_day(panel), **kw).where("metric IS NULL")
