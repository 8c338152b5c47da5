"""Joins of panels, picks and small dimensions. No cross joins: grids are exploded from literal lists."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from dayloom.operators import ordering as O
from dayloom.operators import quality as Q
from dayloom.operators import windows as WN
from dayloom.operators.aggregates import rate
from dayloom.panel import DAY, ENTITY, KEY, SITE


def next_day(df: DataFrame, columns: Sequence[str] = ("metric",)) -> DataFrame:
    """Rows joined to the same entity on the following calendar day."""
    nxt = df.select(*ENTITY, F.date_sub("day", 1).alias("day"), *[F.col(c).alias(f"next_{c}") for c in columns])
    return df.join(nxt, KEY)


def reconcile(a: DataFrame, b: DataFrame, values: Sequence[str] = ("metric", "label"), key: Sequence[str] = KEY
              ) -> DataFrame:
    """Full outer comparison of two sources: presence, deltas and exact-match flags."""
    l = a.select(*key, *[F.col(v).alias(f"{v}_a") for v in values], F.lit(True).alias("in_a"))
    r = b.select(*key, *[F.col(v).alias(f"{v}_b") for v in values], F.lit(True).alias("in_b"))
    j = l.join(r, list(key), "full_outer")
    numeric = {v: t for v, t in a.dtypes if v in values and t in ("double", "bigint", "int", "float")}
    out = j.withColumn("presence", F.when(F.col("in_b").isNull(), "A_ONLY").when(
        F.col("in_a").isNull(), "B_ONLY").otherwise("BOTH")).drop("in_a", "in_b")
    return out.withColumns({
        **{f"delta_{v}": F.col(f"{v}_b") - F.col(f"{v}_a") for v in numeric},
        **{f"same_{v}": (F.col(f"{v}_a") == F.col(f"{v}_b")) for v in values}})


def reconcile_summary(j: DataFrame, value: str = "metric") -> DataFrame:
    both = F.col("presence") == "BOTH"
    return j.groupBy("site").agg(
        F.count_if(both).alias("both"), F.count_if(F.col("presence") == "A_ONLY").alias("a_only"),
        F.count_if(F.col("presence") == "B_ONLY").alias("b_only"), F.count_if(f"same_{value}").alias("exact"),
        F.avg(F.abs(f"delta_{value}")).alias("mae"), F.max(F.abs(f"delta_{value}")).alias("max_abs"),
        F.avg(both.cast("int")).alias("coverage"))


def reconcile_parts(j: DataFrame, part: str, value: str = "metric") -> DataFrame:
    if part == "mismatch":
        return j.where((F.col("presence") == "BOTH") & ~F.col(f"same_{value}"))
    return j.where(F.col("presence") == {"a_only": "A_ONLY", "b_only": "B_ONLY"}[part])


def inventory_diff(prev: DataFrame, cur: DataFrame) -> DataFrame:
    """added / removed / renamed / unchanged between two inventories keyed by entity."""
    p = prev.select(*ENTITY, F.col("label").alias("old_label"))
    c = cur.select(*ENTITY, F.col("label").alias("new_label"))
    return p.join(c, ENTITY, "full_outer").withColumn("classification", F.when(
        F.col("old_label").isNull(), "added").when(F.col("new_label").isNull(), "removed").when(
        F.col("old_label") != F.col("new_label"), "renamed").otherwise("unchanged"))


def inventory_change_days(df: DataFrame) -> DataFrame:
    """Diff of every observed day with the site's previous observed day, all days at once.

    Days that do not follow each other get NON_CONSECUTIVE and no counts.
    """
    days = df.select(*DAY).distinct().withColumn("prev_day", F.lag("day").over(
        Window.partitionBy(*SITE).orderBy("day")))  # one row per day
    cur = df.select(*DAY, "entity_id", F.col("label").alias("new_label")).join(days.where("prev_day IS NOT NULL"), DAY)
    nxt = days.select("site", F.col("prev_day").alias("_d"), F.col("day").alias("next_day"))
    old = df.select("site", F.col("day").alias("_d"), "entity_id", F.col("label").alias("old_label")).join(
        nxt.where("_d IS NOT NULL"), ["site", "_d"]).select("site", F.col("next_day").alias("day"), "entity_id",
                                                             "old_label")
    j = cur.drop("prev_day").join(old, KEY, "full_outer")
    n, o = F.col("new_label"), F.col("old_label")
    g = j.groupBy(*DAY).agg(
        F.count_if(o.isNull()).alias("added"), F.count_if(n.isNull()).alias("removed"),
        F.count_if(n != o).alias("renamed"), F.count_if(n == o).alias("unchanged"), F.count(o).alias("previous"))
    g = g.join(days, DAY)
    ok = F.datediff("day", "prev_day") == 1
    rate_ = (F.col("added") + F.col("removed") + F.col("renamed")) / F.col("previous")
    return g.select(*DAY, "prev_day", *[F.when(ok, F.col(c)).alias(c) for c in (
        "added", "removed", "renamed", "unchanged")], F.when(ok, rate_).alias("change_rate"),
        F.when(~ok, "NON_CONSECUTIVE").when(F.col("added") + F.col("removed") + F.col("renamed") > 0, "CHANGED")
        .otherwise("UNCHANGED").alias("status"))


def asof_event(df: DataFrame, events: DataFrame) -> DataFrame:
    """Latest change event on or before each row's day, kept only while its label still holds.

    Both sides meet in one entity-ordered stream; no range join is needed.
    """
    ev = events.select(*ENTITY, "day", F.lit(None).cast("string").alias("label"),
                       F.struct(F.col("day").alias("change_day"), "new_label").alias("_e"), F.lit(0).alias("_o"))
    rows = df.select(*ENTITY, "day", "label", F.lit(None).cast(ev.schema["_e"].dataType).alias("_e"),
                     F.lit(1).alias("_o"))
    w = Window.partitionBy(*ENTITY).orderBy("day", "_o").rowsBetween(Window.unboundedPreceding, 0)
    x = rows.unionByName(ev).withColumn("_last", F.last("_e", ignorenulls=True).over(w)).where("_o = 1")
    holds = F.col("_last.new_label") == F.col("label")
    return x.select(*KEY, "label", F.when(holds, F.col("_last.change_day")).alias("change_day")).withColumn(
        "days_since", F.datediff("day", "change_day"))


def left_join_checked(a: DataFrame, b: DataFrame, on: Sequence[str]) -> DataFrame:
    """Many-to-one left join; the job fails if the right side repeats a key."""
    counted = b.groupBy(*on).agg(F.count(F.lit(1)).alias("_copies"), *[
        F.first(c).alias(c) for c in b.columns if c not in on])
    ok = counted.where(F.when(F.col("_copies") == 1, True).otherwise(
        F.raise_error(F.concat(F.lit("duplicate join key "), F.to_json(F.struct(*on)))).cast("boolean")))
    return a.join(ok.drop("_copies"), list(on), "left")


def with_layout(df: DataFrame, layout: DataFrame) -> DataFrame:
    """Layout columns for every row; the job fails if an entity has no place."""
    dim = layout.select(*ENTITY, "island_id", "side", "slot_index", "shape")
    j = df.join(dim, ENTITY, "left")
    return j.where(F.when(F.col("slot_index").isNotNull(), True).otherwise(
        F.raise_error(F.lit("entity without layout")).cast("boolean")))


def restrict(df: DataFrame, keep: DataFrame, on: Sequence[str]) -> DataFrame:
    return df.join(keep.select(*on), list(on), "left_semi")


def outside(df: DataFrame, drop: DataFrame, on: Sequence[str]) -> DataFrame:
    return df.join(drop.select(*on), list(on), "left_anti")


def pair_models(daily: DataFrame, base: str, on: Sequence[str] = (*DAY, "band")) -> DataFrame:
    """Every other model beside the base model on common days and bands."""
    b = daily.where(F.col("model") == base).select(*on, F.col("mean").alias("base_mean"), F.col("total").alias(
        "base_total"))
    return daily.where(F.col("model") != base).select(*on, "model", "mean", "total").join(b, list(on)).withColumn(
        "change", F.col("total") - F.col("base_total"))


def common_keys(frames: Mapping[str, DataFrame], on: Sequence[str], value: str = "metric") -> DataFrame:
    """Inner join of several models on the keys all of them have."""
    out = None
    for name, f in frames.items():
        side = f.select(*on, F.col(value).alias(f"{value}_{name}"))
        out = side if out is None else out.join(side, list(on))
    return out


def integrate_rankings(rankings: Mapping[str, DataFrame]) -> DataFrame:
    """Outer union of several rankings with one rank column per kind, overlap and origin."""
    parts = [r.select(*KEY, "label", "score", "rank", F.lit(k).alias("kind")) for k, r in rankings.items()]
    u = parts[0]
    for p in parts[1:]:
        u = u.unionByName(p)
    kinds = list(rankings)
    g = u.groupBy(*KEY).agg(
        F.first("label").alias("label"), F.max("score").alias("score"),
        *[F.min(F.when(F.col("kind") == k, F.col("rank"))).alias(f"rank_{k.lower()}") for k in kinds])
    ranks = [F.col(f"rank_{k.lower()}") for k in kinds]
    return g.withColumns({
        "overlap": sum(r.isNotNull().cast("int") for r in ranks),
        "selected_by": F.concat_ws("+", *[F.when(r.isNotNull(), k) for r, k in zip(ranks, kinds)])})


def pick_join(base: DataFrame, challenger: DataFrame) -> DataFrame:
    """Pick sets side by side per day: BOTH, ENTERED or REMOVED."""
    b = base.select(*KEY, F.col("label").alias("b_label"), F.col("metric").alias("b_metric"), F.lit(1).alias("_b"))
    c = challenger.select(*KEY, F.col("label").alias("c_label"), F.col("metric").alias("c_metric"), F.lit(1).alias("_c"))
    j = b.join(c, KEY, "full_outer")
    return j.select(*KEY, F.coalesce("c_label", "b_label").alias("label"),
                    F.coalesce("c_metric", "b_metric").alias("metric"),
                    F.when(F.col("_b").isNull(), "ENTERED").when(F.col("_c").isNull(), "REMOVED").otherwise(
                        "BOTH").alias("kind"))


def pick_overlap(base: DataFrame, challenger: DataFrame) -> DataFrame:
    j = pick_join(base, challenger)
    part = lambda k: F.col("kind") == k
    tot = lambda k: F.coalesce(F.sum(F.when(part(k), F.col("metric"))), F.lit(0.0))
    return j.groupBy(*DAY).agg(
        F.count_if(part("BOTH")).alias("overlap"), F.count_if(part("ENTERED")).alias("entered"),
        F.count_if(part("REMOVED")).alias("removed"), tot("ENTERED").alias("entered_total"),
        tot("REMOVED").alias("removed_total")
    ).withColumn("replacement_delta", F.col("entered_total") - F.col("removed_total"))


def replacement_detail(base: DataFrame, challenger: DataFrame) -> DataFrame:
    """Entered and removed picks by label."""
    m = F.col("metric")
    return pick_join(base, challenger).where("kind <> 'BOTH'").groupBy("site", "kind", "label").agg(
        F.count(F.lit(1)).alias("n"), F.sum(m).alias("total"), F.avg(m).alias("mean"), rate(m > 0).alias("win_rate"))


def agreement(a: DataFrame, b: DataFrame) -> DataFrame:
    """Set equality of two pick lists per day and the ids only one of them has (lists of at most n picks)."""
    sa = a.groupBy(*DAY).agg(F.array_sort(F.collect_set("entity_id")).alias("_a"))
    sb = b.groupBy(*DAY).agg(F.array_sort(F.collect_set("entity_id")).alias("_b"))
    text = lambda c: F.concat_ws(",", F.transform(c, lambda v: v.cast("string")))
    return sa.join(sb, DAY).select(
        *DAY, (F.col("_a") == F.col("_b")).alias("same"), F.size(F.array_intersect("_a", "_b")).alias("common"),
        text(F.array_except("_a", "_b")).alias("only_a"), text(F.array_except("_b", "_a")).alias("only_b"))


def assign_blocks(df: DataFrame, blocks: DataFrame) -> DataFrame:
    """Block of each row's day, of its own site where the blocks have one. Blocks are day ranges, so they expand to a day table and join by equality."""
    own = [c for c in ("site",) if c in blocks.columns]
    days = blocks.select(*own, "block", F.explode(F.sequence("start_day", "end_day")).alias("day"))
    return O.attach(df, days, [*own, "day"])


def grid(df: DataFrame, **dims: Sequence) -> DataFrame:
    """Every row under every combination of small parameter lists."""
    out = df
    for name, values in dims.items():
        out = out.withColumn(name, F.explode(F.array(*[F.lit(v) for v in values])))
    return out


def with_fallback(df: DataFrame) -> DataFrame:
    """Prior mean from own history under the current label, else the label's history, else the site's.

    The site's history is always there from the second day on; ``source``
    tells which one was used.
    """
    m = F.col("metric")
    past = lambda *by: Window.partitionBy(*by).orderBy("day").rowsBetween(Window.unboundedPreceding, -1)
    own = F.avg(m).over(past(*ENTITY, "label"))
    lab = df.groupBy("site", "label", "day").agg(F.sum(m).alias("_s"), F.count(m).alias("_c"))
    lab = lab.select("site", "label", "day", (F.sum("_s").over(past("site", "label")) / F.sum("_c").over(
        past("site", "label"))).alias("_lab"))
    site = df.groupBy(*DAY).agg(F.sum(m).alias("_s"), F.count(m).alias("_c"))
    site = site.select(*DAY, (F.sum("_s").over(past(*SITE)) / F.sum("_c").over(past(*SITE))).alias("_site"))
    x = df.withColumn("_own", own).join(lab, ["site", "label", "day"]).join(site, DAY)
    return x.withColumns({
        "prior": F.coalesce("_own", "_lab", "_site"),
        "source": F.when(F.col("_own").isNotNull(), "OWN").when(F.col("_lab").isNotNull(), "LABEL").when(
            F.col("_site").isNotNull(), "SITE").otherwise("NONE")}).drop("_own", "_lab", "_site")


def blend(df: DataFrame, clean: str, legacy: str, alphas: Sequence[float]) -> DataFrame:
    """(1 - a) * clean + a * legacy for every a."""
    x = df.withColumn("alpha", F.explode(F.array(*[F.lit(float(a)) for a in alphas])))
    return x.withColumn("blended", (1 - F.col("alpha")) * F.col(clean) + F.col("alpha") * F.col(legacy))


def clean_and_legacy(df: DataFrame) -> DataFrame:
    """Mean before the day inside the current label epoch (clean) and over all history (legacy)."""
    x = WN.with_epochs(df)
    w = lambda *by: Window.partitionBy(*by).orderBy("day").rowsBetween(Window.unboundedPreceding, -1)
    return x.withColumns({"legacy": F.avg("metric").over(w(*ENTITY)), "clean": F.coalesce(
        F.avg("metric").over(w(*ENTITY, "epoch")), F.avg("metric").over(w(*ENTITY)))}).where("legacy IS NOT NULL")


def adjacent(df: DataFrame, offsets: Sequence[int], columns: Sequence[str], group: Sequence[str]) -> DataFrame:
    """Columns of the rows 1, 2, … slots further along the same segment, by equality on the slot."""
    out = df
    for k in offsets:
        other = df.select(*group, (F.col("slot_index") - k).alias("slot_index"), *[
            F.col(c).alias(f"{c}_{k}") for c in columns])
        out = out.join(other, [*group, "slot_index"], "left")
    return out


def condition_compare(pairs: DataFrame, condition: Column) -> DataFrame:
    """Paired differences split by a day-level condition."""
    c = F.col("change")
    return pairs.withColumn("condition", condition).groupBy("site", "model", "condition").agg(
        F.count(F.lit(1)).alias("pairs"), F.avg(c).alias("mean_change"), F.sum(c).alias("total_change"),
        rate(c > 0).alias("better_rate"))


def with_required(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    return Q.require_columns(df, columns)
