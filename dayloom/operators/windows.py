"""Ordered operators: transitions, streaks, segments, epochs, runs, neighbours.

Entity windows hold at most one row per calendar day. Day-wide orderings are
never put in one window; adjacency is an equi-join on the id, and runs are cut
into id blocks.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from dayloom.functions import expr as X
from dayloom.operators import ordering as O
from dayloom.operators.aggregates import rate
from dayloom.panel import DAY, ENTITY, LABEL, SITE

def by_day():
    """Rows of one entity in day order: at most one per calendar day."""
    return Window.partitionBy(*ENTITY).orderBy("day")


# ---- columns and labels -------------------------------------------------

def calendar_class(df: DataFrame, holidays: DataFrame) -> DataFrame:
    """WEEKDAY or WEEKEND_HOLIDAY; the holiday list is a few rows per year."""
    h = holidays.select("day").distinct().withColumn("_h", F.lit(True))
    off = (F.weekday("day") >= 5) | F.col("_h").isNotNull()
    return df.join(h, "day", "left").withColumn(
        "calendar_class", F.when(off, "WEEKEND_HOLIDAY").otherwise("WEEKDAY")).drop("_h")


def number_features(df: DataFrame) -> DataFrame:
    e = F.col("entity_id")
    band = lambda k: (e - F.pmod(e, F.lit(k)))
    return df.withColumns({
        "last1": F.pmod(e, F.lit(10)), "last2": F.pmod(e, F.lit(100)), "odd": F.pmod(e, F.lit(2)),
        "band10": band(10), "band50": band(50), "band100": band(100)})


def normalise(df: DataFrame, c: str, lo: float, hi: float) -> DataFrame:
    """Min-max, fixed-range and robust 5-95 % forms of one column, per site."""
    v = F.col(c)
    ends = df.groupBy(*SITE).agg(F.min(c).alias("_mn"), F.max(c).alias("_mx"))
    cuts = O.exact_quantiles(df, SITE, c, {"_p05": 0.05, "_p95": 0.95})
    return O.attach(df, ends.join(cuts, SITE), SITE).withColumns({
        "minmax": X.to_range(v, F.col("_mn"), F.col("_mx")), "fixed": X.to_range(v, lo, hi),
        "robust": X.to_range(v, F.col("_p05"), F.col("_p95"))}).drop("_mn", "_mx", "_p05", "_p95")


def classify(df: DataFrame, text: Column, rules: Sequence[tuple[str, str, str]]) -> DataFrame:
    """Rule names whose include pattern matches and whose exclude pattern does not."""
    names = list(dict.fromkeys(r[0] for r in rules))
    flags = []
    for name in names:
        cond = F.lit(True)
        for n, kind, pattern in rules:
            if n == name:
                hit = text.rlike(pattern)
                cond = cond & (hit if kind == "in" else ~hit)
        flags.append(F.when(cond, name))
    return df.withColumn("rules", F.concat_ws("+", *flags))


def join_distinct(df: DataFrame) -> DataFrame:
    first = df.groupBy(*ENTITY, "label").agg(F.min("day").alias("f"))
    seq = F.array_sort(F.collect_list(F.struct("f", "label")))
    return first.groupBy(*ENTITY).agg(
        F.concat_ws(" / ", F.array_sort(F.collect_list("label"))).alias("sorted_labels"),
        F.concat_ws(" / ", F.transform(seq, lambda s: s["label"])).alias("first_seen"))


def members(df: DataFrame, by: Sequence[str], block: int = 1000) -> DataFrame:
    """Sorted member ids per group, one row per id block, so no row grows past ``block`` ids."""
    b = F.floor(F.col("entity_id") / block).alias("block")
    return df.groupBy(*by, b).agg(
        F.count(F.lit(1)).alias("n"), F.concat_ws("|", F.transform(
            F.array_sort(F.collect_list("entity_id")), lambda x: x.cast("string"))).alias("members"))


def with_wl(df: DataFrame) -> DataFrame:
    """W / L symbol; zero counts as a loss."""
    return df.withColumn("wl", F.when(F.col("metric") > 0, "W").otherwise("L"))


def pattern(df: DataFrame, k: int) -> DataFrame:
    parts = [F.lag("wl", i).over(by_day()) for i in range(k, 0, -1)]
    return with_wl(df).withColumn("pattern", F.concat(*parts))


# ---- previous / next day --------------------------------------------------

def with_prev_next(df: DataFrame) -> DataFrame:
    return df.withColumns({
        "prev": F.lag("metric").over(by_day()), "next": F.lead("metric").over(by_day()),
        "prev_day": F.lag("day").over(by_day()), "next_day": F.lead("day").over(by_day())})


def next_calendar_day(df: DataFrame) -> DataFrame:
    """Rows whose entity is also observed on the following calendar day."""
    return with_prev_next(df).where(F.datediff("next_day", "day") == 1)


def band_of(prev: Column, t: Sequence[float], variant: str) -> Column:
    """Six bands of the previous value.

    Variants differ in whether exactly -t belongs to the loss band: "rows"
    puts it in the mild-loss band with everything down to -t, "days" starts
    that band at -(t-1), "strict" just above -t.
    """
    lo, hi = t
    mild = {"rows": prev >= -lo, "days": prev >= -(lo - 1), "strict": prev > -lo}[variant]
    return (F.when(prev >= hi, "A_BIG_WIN").when(prev >= lo, "B_WIN").when(prev > 0, "C_SMALL_WIN")
            .when(prev == 0, "D_EVEN").when(mild, "E_SMALL_LOSS").otherwise("F_LOSS"))


def transitions(df: DataFrame, variant: str = "rows", t: Sequence[float] = (100, 200)) -> DataFrame:
    """Next result by band of the previous one; consecutive rows or consecutive days."""
    x = with_prev_next(df).where("prev IS NOT NULL")
    if variant != "rows":
        x = x.where(F.datediff("day", "prev_day") == 1)
    m = F.col("metric")
    return x.withColumn("band", band_of(F.col("prev"), t, variant)).groupBy(*SITE, "band").agg(
        F.count(F.lit(1)).alias("n"), F.avg(m).alias("next_mean"), rate(m > 0).alias("next_win"),
        rate(m >= t[0]).alias("next_strong"))


def two_day_relation(df: DataFrame, edges: Sequence[float], labels: Sequence[str]) -> DataFrame:
    """Next-row result by state of the previous row, seen from the row between them."""
    x = with_prev_next(df).where("next IS NOT NULL AND prev IS NOT NULL")
    n = F.col("next")
    return x.withColumn("state", X.cut(F.col("prev"), edges, labels)).groupBy(*SITE, "state").agg(
        F.count(F.lit(1)).alias("n"), F.avg(n).alias("next_mean"), rate(n > 0).alias("next_win"))


def change_classes(df: DataFrame, t: float = 100) -> DataFrame:
    """What follows a rise, a fall or no change of at least t between two rows."""
    x = with_prev_next(df).where("prev IS NOT NULL AND next IS NOT NULL")
    change = F.col("metric") - F.col("prev")
    cls = F.when(change >= t, "RISING").when(change <= -t, "FALLING").otherwise("FLAT")
    n = F.col("next")
    return x.withColumn("change_class", cls).groupBy(*SITE, "change_class").agg(
        F.count(F.lit(1)).alias("n"), F.avg(n).alias("next_mean"), rate(n > 0).alias("next_win"))


def after_extreme(df: DataFrame, t: float = 100) -> DataFrame:
    x = with_prev_next(df).where(F.col("prev").isNotNull() & (F.abs("prev") >= t))
    m = F.col("metric")
    side = F.when(F.col("prev") > 0, "AFTER_WIN").otherwise("AFTER_LOSS")
    return x.groupBy(*SITE, side.alias("side")).agg(
        F.count(F.lit(1)).alias("n"), F.avg(m).alias("mean"), rate(m > 0).alias("win_rate"), F.min(m).alias("lo"),
        F.max(m).alias("hi"))


def entity_transitions(df: DataFrame, t: Sequence[float] = (50, 100)) -> DataFrame:
    """Per entity, mean of the exact next day after a loss of at least t."""
    x = next_calendar_day(df)
    aggs = [F.coalesce(F.avg(F.when(F.col("metric") <= -v, F.col("next"))), F.lit(0.0)).alias(f"next_after_{v:g}")
            for v in t]
    return x.groupBy(*ENTITY).agg(F.count(F.lit(1)).alias("n"), *aggs)


# ---- streaks ---------------------------------------------------------------

def streaks(df: DataFrame, hit: Column, by: Sequence[str] = ENTITY) -> DataFrame:
    """Unbroken stretches of rows meeting ``hit``: length, first and last day."""
    w = Window.partitionBy(*by).orderBy("day")
    x = df.withColumn("_hit", hit).withColumn(
        "_isle", F.sum((~F.col("_hit")).cast("int")).over(w.rowsBetween(Window.unboundedPreceding, 0)))
    return x.where("_hit").groupBy(*by, "_isle").agg(
        F.count(F.lit(1)).alias("length"), F.min("day").alias("from_day"), F.max("day").alias("to_day")).drop("_isle")


def max_streak(df: DataFrame, hit: Column, by: Sequence[str] = ENTITY, minimum: int = 2) -> DataFrame:
    return streaks(df, hit, by).groupBy(*by).agg(F.max("length").alias("max_streak")).where(
        F.col("max_streak") >= minimum)


def drawdown(series: DataFrame, by: Sequence[str] = SITE, value: str = "total") -> DataFrame:
    """Cumulative sum, its running peak and the gap to the peak."""
    w = Window.partitionBy(*by).orderBy("day").rowsBetween(Window.unboundedPreceding, 0)
    c = series.withColumn("cumulative", F.sum(value).over(w)).withColumn("peak", F.max("cumulative").over(w))
    return c.withColumn("drawdown", F.col("cumulative") - F.col("peak"))


def rolling(series: DataFrame, ws: Sequence[int], by: Sequence[str] = SITE, value: str = "mean") -> DataFrame:
    """Rolling mean, sum and positive rate; only full windows are kept."""
    parts = []
    for n in ws:
        w = Window.partitionBy(*by).orderBy("day").rowsBetween(-(n - 1), 0)
        parts.append(F.when(F.count(value).over(w) == n, F.struct(
            F.lit(n).alias("window_days"), F.avg(value).over(w).alias("roll_mean"),
            F.sum(value).over(w).alias("roll_sum"),
            F.avg((F.col(value) > 0).cast("int")).over(w).alias("roll_positive"))))
    full = series.withColumn("_r", F.array_compact(F.array(*parts)))
    return full.select(*by, "day", F.explode("_r").alias("r")).select(*by, "day", "r.*")


# ---- label history, segments, epochs -----------------------------------

def label_history(df: DataFrame) -> DataFrame:
    return df.withColumn("prev_label", F.lag("label").over(by_day())).withColumn(
        "changed", F.coalesce(F.col("label") != F.col("prev_label"), F.lit(False)))


def segments(df: DataFrame) -> DataFrame:
    """Sequence breaks at the first row, a calendar gap or a label change; running segment id."""
    gap = F.datediff("day", F.lag("day").over(by_day()))
    same = F.col("label") == F.lag("label").over(by_day())
    reason = F.when(gap.isNull(), "FIRST").when(gap != 1, "CALENDAR_GAP").when(~same, "LABEL_CHANGE").otherwise("")
    run = by_day().rowsBetween(Window.unboundedPreceding, 0)
    return with_wl(df).withColumn("break_reason", reason).withColumn(
        "segment_id", F.sum((F.col("break_reason") != "").cast("int")).over(run))


def prior_streak(df: DataFrame, named: int = 5) -> DataFrame:
    """Length of the streak before each row inside its segment, and the W/L name of those up to ``named``."""
    w = Window.partitionBy(*ENTITY, "segment_id").orderBy("day")
    x = segments(df).withColumn("_l", F.array(*[F.lag("wl", i).over(w) for i in (1, 2, 3)]))
    turned = F.coalesce(F.col("wl") != F.col("_l")[0], F.lit(True)).cast("int")
    x = x.withColumn("_run", F.sum(turned).over(w.rowsBetween(Window.unboundedPreceding, 0)))
    place = F.row_number().over(Window.partitionBy(*ENTITY, "segment_id", "_run").orderBy("day"))
    x = x.withColumn("_place", place).withColumn("streak", F.lag("_place", 1, 0).over(w).cast("int"))
    name = F.when(F.col("streak").between(1, named), F.concat(F.col("_l")[0], F.col("streak").cast("string")))
    pats = {f"pattern_{k}d": F.when(F.col("_l")[k - 1].isNotNull(), F.concat(
        *[F.col("_l")[i] for i in range(k - 1, -1, -1)])) for k in (2, 3)}
    return x.withColumn("streak_label", name).withColumns(pats).withColumn(
        "has_prior", F.col("_l")[0].isNotNull()).drop("_l", "_run", "_place")


def pattern_summary(df: DataFrame) -> DataFrame:
    """Outcome of every streak and trailing pattern against its family's own baseline."""
    x = prior_streak(df)
    family = F.array_compact(F.array(
        F.when(F.col("has_prior"), F.struct(F.lit("STREAK").alias("family"),
                                            F.coalesce("streak_label", F.lit("")).alias("pattern"))),
        F.when(F.col("pattern_2d").isNotNull(), F.struct(F.lit("2D").alias("family"),
                                                         F.col("pattern_2d").alias("pattern"))),
        F.when(F.col("pattern_3d").isNotNull(), F.struct(F.lit("3D").alias("family"),
                                                         F.col("pattern_3d").alias("pattern")))))
    m = F.col("metric")
    cells = x.select("site", "day", "metric", F.explode(family).alias("f")).select("site", "day", "metric", "f.*")
    sums = [F.count(F.lit(1)).alias("n"), F.count_if(m > 0).alias("wins"), F.sum(m).alias("_s")]
    base = cells.groupBy("site", "family").agg(*[c for c in sums]).select(
        "site", "family", (F.col("wins") / F.col("n")).alias("base_win"), (F.col("_s") / F.col("n")).alias("base_mean"))
    pat = cells.where("pattern <> ''").groupBy("site", "family", "pattern").agg(
        *sums, F.countDistinct("day").alias("days"))
    lo, hi = X.wilson(F.col("wins"), F.col("n"))
    return pat.join(base, ["site", "family"]).withColumns({
        "win_rate": F.col("wins") / F.col("n"), "ci_low": lo, "ci_high": hi, "mean": F.col("_s") / F.col("n"),
    }).withColumns({
        "win_diff": F.col("win_rate") - F.col("base_win"), "mean_diff": F.col("mean") - F.col("base_mean")}).drop("_s")


def replicate(df: DataFrame, label: str) -> DataFrame:
    """One streak pattern against the baseline in the first and second half of the days, with a verdict."""
    x = prior_streak(df).where("has_prior")
    days = x.select(*DAY).distinct()
    w = Window.partitionBy(*SITE)
    halves = days.withColumn("half", F.when(
        F.row_number().over(w.orderBy("day")) <= F.floor(F.count(F.lit(1)).over(w) / 2), 1).otherwise(2))
    hit = F.coalesce(F.col("streak_label") == label, F.lit(False))
    m, won = F.col("metric"), (F.col("metric") > 0).cast("int")
    per = x.join(halves, DAY).groupBy(*SITE, "half").agg(
        F.count_if(hit).alias("n"), (F.avg(F.when(hit, won)) - F.avg(won)).alias("win_lift"),
        (F.avg(F.when(hit, m)) - F.avg(m)).alias("mean_lift"))
    one = lambda h, c: F.max(F.when(F.col("half") == h, F.col(c)))
    wide = per.groupBy(*SITE).agg(*[
        one(h, c).alias(f"{c}{h}") for h in (1, 2) for c in ("n", "win_lift", "mean_lift")])
    up = [F.col(f"win_lift{h}") > 0 for h in (1, 2)], [F.col(f"mean_lift{h}") > 0 for h in (1, 2)]
    down = [(F.col(f"win_lift{h}") < 0) & (F.col(f"mean_lift{h}") < 0) for h in (1, 2)]
    both = [up[0][i] & up[1][i] for i in (0, 1)]
    mixed = (up[0][0] != up[1][0]) | (up[0][1] != up[1][1]) | (both[0] & down[1]) | (down[0] & both[1])
    return wide.withColumn("verdict", F.when(both[0] & both[1], "ROBUST_DIRECTION").when(mixed, "MIXED").otherwise(
        "NO_TEMPORAL_REPLICATION"))


def with_epochs(df: DataFrame) -> DataFrame:
    """Epoch number and start: a new epoch at every label change, calendar gaps do not end one."""
    prev = F.lag("label").over(by_day())
    new = (prev.isNull() | (F.col("label") != prev)).cast("int")
    x = df.withColumn("_new", new).withColumn(
        "epoch", F.sum("_new").over(by_day().rowsBetween(Window.unboundedPreceding, 0)))
    start = F.min("day").over(Window.partitionBy(*ENTITY, "epoch"))
    return x.withColumn("epoch_start", start).drop("_new")


def epochs(df: DataFrame, as_of: str | None = None) -> DataFrame:
    """One row per epoch: id, span, calendar / observed / idle / missing days, continuity."""
    x = df if as_of is None else df.where(F.col("day") <= F.lit(as_of).cast("date"))
    x = with_epochs(x)
    seen = F.col("activity") > 0
    e = x.groupBy(*ENTITY, "epoch", "epoch_start").agg(
        F.max_by("label", "day").alias("label"), F.max("day").alias("epoch_end"),
        F.countDistinct("day").alias("calendar_days"), F.count_if(seen).alias("observed_days"),
        F.count_if(F.col("activity") == 0).alias("idle_days"), F.sum("activity").alias("activity"),
        F.max(F.when(seen, F.col("day"))).alias("last_observed"))
    span = F.datediff("epoch_end", "epoch_start") + 1
    return e.withColumns({
        "epoch_id": F.concat_ws(":", F.col("entity_id").cast("string"), F.format_string("%04d", "epoch"),
                                F.date_format("epoch_start", "yyyyMMdd")),
        "missing_days": span - F.col("calendar_days"), "continuous": span == F.col("calendar_days")})


def current_epochs(df: DataFrame, as_of: str | None = None) -> DataFrame:
    e = epochs(df, as_of)
    last = F.max("epoch").over(Window.partitionBy(*ENTITY))
    return e.withColumn("_last", last).where("epoch = _last").drop("_last")


def persistent_diff(df: DataFrame, as_of: str | None = None) -> DataFrame:
    """Entities whose current epoch is not their first are renamed, with the label before."""
    w = Window.partitionBy(*ENTITY).orderBy("epoch")
    e = epochs(df, as_of).withColumn("old_label", F.coalesce(F.lag("label").over(w), F.lit(""))).withColumn(
        "_last", F.max("epoch").over(Window.partitionBy(*ENTITY)))
    return e.where("epoch = _last").select(
        *ENTITY, "old_label", F.col("label").alias("new_label"),
        F.when(F.col("epoch") > 1, "renamed").otherwise("unchanged").alias("classification"))


def current_run(df: DataFrame, cutoff: str, eligible_age: int = 7) -> DataFrame:
    """The unbroken same-label daily run that ends on the cutoff: age, stop reason, eligibility.

    Entities not observed on the cutoff day have no current run.
    """
    cut = F.lit(cutoff).cast("date")
    s = segments(df.where(F.col("day") <= cut))
    runs = s.groupBy(*ENTITY, "segment_id").agg(
        F.min("day").alias("run_start"), F.max("day").alias("run_end"), F.count(F.lit(1)).alias("age"),
        F.min_by("break_reason", "day").alias("stop_reason"), F.max_by("label", "day").alias("label"))
    return runs.where(F.col("run_end") == cut).withColumn("eligible", F.col("age") >= eligible_age)


def reset_history(df: DataFrame) -> DataFrame:
    """Only the rows of each entity's latest label epoch."""
    x = with_epochs(df)
    return x.withColumn("_last", F.max("epoch").over(Window.partitionBy(*ENTITY))).where("epoch = _last").drop("_last")


def change_events(df: DataFrame) -> DataFrame:
    """Label changes between consecutive calendar days only."""
    x = df.select(*ENTITY, "day", "label", F.lag("label").over(by_day()).alias("old_label"),
                  F.lag("day").over(by_day()).alias("prev_day"))
    return x.where((F.datediff("day", "prev_day") == 1) & (F.col("label") != F.col("old_label"))).withColumnRenamed(
        "label", "new_label")


def event_windows(df: DataFrame, before: Sequence[int] = (3, 7, 14), after: Sequence[int] = (1, 3, 7)) -> DataFrame:
    """Means before and after each label change: the last b rows of the old epoch, the first a of the new."""
    ent = [*ENTITY, "epoch"]
    x = with_epochs(df).withColumns({
        "_asc": F.row_number().over(Window.partitionBy(*ent).orderBy("day")),
        "_desc": F.row_number().over(Window.partitionBy(*ent).orderBy(F.desc("day")))})
    m = F.col("metric")
    per = x.groupBy(*ent, "label", "epoch_start").agg(
        *[F.avg(F.when(F.col("_desc") <= b, m)).alias(f"before{b}") for b in before],
        *[F.avg(F.when(F.col("_asc") <= a, m)).alias(f"after{a}") for a in after], F.avg(m).alias("after_full"))
    w = Window.partitionBy(*ENTITY).orderBy("epoch")
    prev = per.withColumns({"old_label": F.lag("label").over(w), **{
        f"before{b}": F.lag(f"before{b}").over(w) for b in before}})
    return prev.where("old_label IS NOT NULL").withColumnRenamed("label", "new_label").withColumnRenamed(
        "epoch_start", "change_day")


# ---- cross-section ---------------------------------------------------------

def zscores(df: DataFrame, columns: Sequence[str], by: Sequence[str] = DAY, prefix: str = "z_",
            population: Column | None = None) -> DataFrame:
    """(x - mean) / population deviation inside the group, 0 where the deviation is 0.

    Group moments are aggregated (map-side combine) and joined back, so a hot
    day is never sorted or buffered in one task. ``population`` limits the rows
    the moments are taken over.
    """
    pick = (lambda c: F.when(population, F.col(c))) if population is not None else F.col
    stats = df.groupBy(*by).agg(*[
        f(pick(c)).alias(f"_{n}_{c}") for c in columns for n, f in (("m", F.avg), ("s", F.stddev_pop))])
    z = {f"{prefix}{c}": F.when(F.coalesce(F.col(f"_s_{c}"), F.lit(0.0)) == 0, 0.0).otherwise(
        (F.coalesce(F.col(c), F.lit(0.0)) - F.col(f"_m_{c}")) / F.col(f"_s_{c}")) for c in columns}
    out = O.attach(df, stats, by).withColumns(z)
    return out.drop(*[f"_{n}_{c}" for c in columns for n in "ms"])


def ranks(df: DataFrame, value: str, by: Sequence[str] = DAY) -> DataFrame:
    """Row number, min rank, dense rank and average-rank percentile, largest first."""
    x = df.withColumn("_neg", -F.col(value))
    x = O.position(x, by, [F.col("_neg"), F.col("entity_id")], "row_no", "_n")
    x = O.rank_positions(x, by, "_neg", "_avg")
    return x.withColumn("pct_rank", F.col("_avg") / F.col("_n")).withColumnsRenamed({
        "_avg_min": "min_rank", "_avg_dense": "dense_rank"}).drop("_neg", "_n", "_avg")


def relative_state(df: DataFrame) -> DataFrame:
    """Label mean per day relative to the site, its 1/3/7-day history and short trend."""
    site = df.groupBy(*DAY).agg(F.avg("metric").alias("site_mean"))
    lab = df.groupBy(*DAY, "label").agg(F.avg("metric").alias("label_mean"))
    x = lab.join(site, DAY).withColumn("rel", F.col("label_mean") - F.col("site_mean"))
    w = Window.partitionBy(*LABEL).orderBy("day")
    prev = {f"prev{n}": F.avg("rel").over(w.rowsBetween(-n, -1)) for n in (1, 3, 7)}
    return x.withColumns(prev).withColumn("trend", F.col("prev1") - F.col("prev3"))


def prior_block_features(blocks: DataFrame, by: Sequence[str] = SITE, edge: str = "edge") -> DataFrame:
    w = Window.partitionBy(*by).orderBy("block")
    past = w.rowsBetween(Window.unboundedPreceding, -1)
    e = F.col(edge)
    return blocks.withColumns({
        "prior_blocks": F.count(e).over(past), "prior_mean": F.avg(e).over(past), "prior_last": F.lag(edge).over(w),
        "prior_last2": F.avg(e).over(w.rowsBetween(-2, -1)), "prior_last3": F.avg(e).over(w.rowsBetween(-3, -1)),
        "prior_positive": F.avg((e > 0).cast("int")).over(past)})


def day_weighted(groups: DataFrame, effect: str = "effect", n: str = "n") -> DataFrame:
    """Each stratum's effect weighted by its share of the day's rows (strata are few per day)."""
    day = groups.groupBy(*DAY).agg(F.sum(n).alias("_dn"))
    return groups.join(day, DAY).groupBy(*DAY).agg(
        F.count(F.lit(1)).alias("strata"), F.sum(n).alias("rows"),
        F.sum(F.col(effect) * F.col(n) / F.col("_dn")).alias("weighted_effect"))


# ---- adjacency of ids -------------------------------------------------------

def id_block_rows(df: DataFrame, span: int, block: int = 4096) -> DataFrame:
    """Rows keyed by id block, with each block's first ``span`` ids also copied to the block before it.

    A window over (day, block) then sees every run of up to span + 1 ids while
    a day of any size is spread over its blocks.
    """
    e = F.col("entity_id")
    own = F.floor(e / block)
    homes = F.when((F.pmod(e, F.lit(block)) < span), F.array(own, own - 1)).otherwise(F.array(own))
    return df.withColumn("_block", F.explode(homes)).withColumn("_own", F.col("_block") == own)


def runs(df: DataFrame, k: int) -> DataFrame:
    """Every run of k consecutive ids on a day: sums, wins, same-label and all-positive flags."""
    x = id_block_rows(df, k - 1)
    w = Window.partitionBy(*DAY, "_block").orderBy("entity_id")
    frame = w.rowsBetween(0, k - 1)
    m = F.col("metric")
    r = x.withColumns({
        "end_id": F.lead("entity_id", k - 1).over(w), "total": F.sum(m).over(frame),
        "wins": F.sum((m > 0).cast("int")).over(frame), "_lo": F.min("label").over(frame),
        "_hi": F.max("label").over(frame)})
    r = r.where(F.col("_own") & (F.col("end_id") == F.col("entity_id") + k - 1))
    return r.select(
        *DAY, F.col("entity_id").alias("start_id"), "end_id", F.lit(k).alias("k"), "total", "wins",
        (F.col("_lo") == F.col("_hi")).alias("same_label"), (F.col("wins") == k).alias("all_positive"),
        (F.col("wins") >= (k + 1) // 2).alias("majority_positive"))


def repeated_runs(r: DataFrame, minimum: int = 2) -> DataFrame:
    return r.where("all_positive").groupBy("site", "k", "start_id").agg(
        F.count(F.lit(1)).alias("days"), F.avg("total").alias("mean_total"), F.count_if("same_label").alias("same_label_days")
    ).where(F.col("days") >= minimum)


def _pieces(df: DataFrame, by: Sequence[str], block: int) -> DataFrame:
    """``df`` with the id block and the run inside it (``_block``, ``_g``) of each id; ids are distinct in a group."""
    e = F.col("entity_id")
    x = df.withColumn("_block", F.floor(e / block))
    return x.withColumn("_g", e - F.row_number().over(Window.partitionBy(*by, "_block").orderBy("entity_id")))


def islands(df: DataFrame, by: Sequence[str], block: int = 4096) -> DataFrame:
    """Start and end of maximal runs of consecutive ids per group, for groups of any size.

    Runs are found inside id blocks. Only the pieces that touch a block border
    (two per block at most) are then chained across blocks.
    """
    whole = _chained(_pieces(df, by, block), by, block)
    return whole.select(*by, "start_id", "end_id", "length").distinct()


def in_islands(df: DataFrame, by: Sequence[str], block: int = 4096) -> DataFrame:
    """``df`` with the run that holds each id; a run of any length is spread over its id blocks."""
    by = list(by)
    x = _pieces(df, by, block)
    return x.join(_chained(x, by, block), [*by, "_block", "_g"]).drop("_block", "_g")


def _chained(pieces: DataFrame, by: Sequence[str], block: int) -> DataFrame:
    """The run (start_id, end_id, length) of each piece (``_block``, ``_g``)."""
    by = list(by)
    piece = pieces.groupBy(*by, "_block", "_g").agg(F.min("entity_id").alias("start_id"), F.max("entity_id").alias("end_id"))
    border = (F.pmod("start_id", F.lit(block)) == 0) | (F.pmod("end_id", F.lit(block)) == block - 1)
    v = Window.partitionBy(*by).orderBy("start_id")
    new = F.coalesce(F.col("start_id") != F.lag("end_id").over(v) + 1, F.lit(True)).cast("int")
    chained = piece.where(border).withColumn("_new", new).withColumn(
        "_run", F.sum("_new").over(v.rowsBetween(Window.unboundedPreceding, 0)))
    joined = chained.groupBy(*by, "_run").agg(F.min("start_id").alias("start_id"), F.max("end_id").alias("end_id"))
    joined = chained.drop("start_id", "end_id").join(joined, [*by, "_run"])
    cols = [*by, "_block", "_g", "start_id", "end_id"]
    return piece.where(~border).select(*cols).unionByName(joined.select(*cols)).withColumn(
        "length", F.col("end_id") - F.col("start_id") + 1)


def maximal_runs(df: DataFrame, hit: Column, minimum: int = 2) -> DataFrame:
    """Longest runs of adjacent qualifying ids per day, with their totals."""
    good = df.where(hit)
    return in_islands(good, DAY).where(F.col("length") >= minimum).groupBy(*DAY, "start_id", "end_id", "length").agg(
        F.sum("metric").alias("total"), F.avg("metric").alias("mean"))


def neighbour(df: DataFrame, k: int, columns: Sequence[str], prefix: str = "nb_") -> DataFrame:
    """Columns of the entity with id + k on the same day (null if absent)."""
    other = df.select(*DAY, (F.col("entity_id") - k).alias("entity_id"), *[
        F.col(c).alias(f"{prefix}{c}") for c in columns])
    return df.join(other, [*DAY, "entity_id"], "left")


def positive_pairs(df: DataFrame, same_label: bool = False) -> DataFrame:
    x = neighbour(df.where(F.col("metric") > 0), 1, ["metric", "label"]).where("nb_metric IS NOT NULL")
    if same_label:
        x = x.where(F.col("label") == F.col("nb_label"))
    return x.select(*DAY, "entity_id", (F.col("entity_id") + 1).alias("right_id"), "label",
                    (F.col("metric") + F.col("nb_metric")).alias("pair_total"))


def edge_bucket(d: Column) -> Column:
    return X.step_up(d, [0, 1, 2, 4], ["EDGE", "NEXT", "SECOND", "NEAR", "INNER"])


def number_runs(ids: DataFrame) -> DataFrame:
    """Run id, position, run length and distance to the nearer run end for every entity id."""
    out = in_islands(ids.select(*ENTITY).distinct(), SITE).withColumnRenamed("start_id", "run_id").drop("end_id").withColumn(
        "position", F.col("entity_id") - F.col("run_id") + 1)
    dist = F.least(F.col("position") - 1, F.col("length") - F.col("position"))
    return out.withColumn("edge_distance", dist).withColumn("edge_bucket", edge_bucket(F.col("edge_distance")))


def gaps(ids: DataFrame, block: int = 4096) -> DataFrame:
    """Missing id ranges: inside id blocks first, then between neighbouring blocks."""
    x = ids.select(*ENTITY).distinct().withColumn("_block", F.floor(F.col("entity_id") / block))
    w = Window.partitionBy(*SITE, "_block").orderBy("entity_id")
    inside = x.select(*SITE, F.lag("entity_id").over(w).alias("after_id"), F.col("entity_id").alias("before_id"))
    ends = x.groupBy(*SITE, "_block").agg(F.min("entity_id").alias("_a"), F.max("entity_id").alias("_b"))
    v = Window.partitionBy(*SITE).orderBy("_block")  # one row per block
    between = ends.select(*SITE, F.lag("_b").over(v).alias("after_id"), F.col("_a").alias("before_id"))
    return inside.unionByName(between).where(F.col("before_id") > F.col("after_id") + 1).withColumn(
        "missing", F.col("before_id") - F.col("after_id") - 1)


def label_blocks(df: DataFrame) -> DataFrame:
    """Contiguous ids with the same label on the same day."""
    return islands(df, [*DAY, "label"])


def neighbour_mean(df: DataFrame, same_label: bool = False) -> DataFrame:
    """Mean metric of ids one below and one above on the same day; 0 without neighbours."""
    push = F.explode(F.array(F.lit(-1), F.lit(1)))
    sent = df.select("site", "day", "entity_id", "label", "metric", push.alias("_k")).select(
        "site", "day", (F.col("entity_id") + F.col("_k")).alias("entity_id"),
        F.col("label").alias("_nl"), F.col("metric").alias("_nm"))
    j = df.join(sent, [*DAY, "entity_id"], "left")
    ok = F.col("_nm").isNotNull() & ((F.col("_nl") == F.col("label")) if same_label else F.lit(True))
    return j.groupBy(*DAY, "entity_id").agg(
        F.coalesce(F.avg(F.when(ok, F.col("_nm"))), F.lit(0.0)).alias("neighbour_mean"),
        F.count_if(ok).alias("neighbours"))


def neighbour_coverage(df: DataFrame, same_label: bool = False) -> DataFrame:
    """``neighbour_mean`` with the class of what it rests on: BOTH neighbours, ONE or NONE."""
    n = F.col("neighbours")
    return neighbour_mean(df, same_label).withColumn("coverage", F.when(n >= 2, "BOTH").when(n == 1, "ONE").otherwise("NONE"))


def label_position(df: DataFrame) -> DataFrame:
    """Place of an entity among the ids of its label on the day: share, edge distance, centre, end flag."""
    x = O.position(df, [*DAY, "label"], [F.col("entity_id")], "pos", "label_n")
    n, p = F.col("label_n"), F.col("pos")
    return x.withColumns({
        "pct": F.when(n > 1, (p - 1) / (n - 1)).otherwise(0.5), "edge": F.least(p - 1, n - p),
        "centre": F.when(n > 1, 1 - F.abs(2 * (p - 1) / (n - 1) - 1)).otherwise(1.0),
        "is_end": (p == 1) | (p == n)})
