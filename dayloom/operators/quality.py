"""Data-quality checks: each returns rows to report or a filtered panel."""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from dayloom.panel import DAY, ENTITY, KEY, SITE


class QualityError(ValueError):
    """A fail-fast check did not hold."""


def status(rules: Sequence[tuple[Column, str]], default: str) -> Column:
    """First matching status in documented precedence."""
    out = F
    for cond, name in rules:
        out = out.when(cond, name)
    return out.otherwise(default)


def check_schema(df: DataFrame, expected: Sequence[str]) -> DataFrame:
    """One row per expected or surplus column; works on metadata only."""
    have = df.columns
    rows = [(c, c in have, c in expected, have.index(c) == i if c in have else False)
            for i, c in enumerate(expected)]
    rows += [(c, True, False, False) for c in have if c not in expected]
    return df.sparkSession.createDataFrame(
        rows, "column string, present boolean, expected boolean, in_place boolean")


def require_columns(df: DataFrame, required: Sequence[str]) -> DataFrame:
    missing = [c for c in required if c not in df.columns]
    if missing:
        raise QualityError(f"missing columns: {missing}")
    return df


def check_blanks(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Blank and null cells per column, in one pass."""
    one = df.agg(*[
        F.struct(F.count_if(F.col(c).isNull()).alias("nulls"),
                 F.count_if(F.trim(F.col(c).cast("string")) == "").alias("blanks"),
                 F.count(F.lit(1)).alias("rows")).alias(c) for c in columns])
    pairs = F.array(*[F.struct(F.lit(c).alias("column"), F.col(c).alias("s")) for c in columns])
    return one.select(F.explode(pairs).alias("p")).select("p.column", "p.s.*")


def check_types(df: DataFrame, types: Mapping[str, str]) -> DataFrame:
    """Cells that are present but cannot be read as the wanted type."""
    one = df.agg(*[
        F.count_if(F.col(c).isNotNull() & F.col(c).try_cast(t).isNull()).alias(c) for c, t in types.items()])
    return one.unpivot([], list(types), "column", "invalid")


def check_duplicates(df: DataFrame, key: Sequence[str] = KEY, line: str = "line") -> DataFrame:
    return df.groupBy(*key).agg(F.count(F.lit(1)).alias("copies"), F.min(line).alias("first_line")).where("copies > 1")


def check_count(df: DataFrame, n: int) -> DataFrame:
    return df.groupBy(*DAY).agg(
        F.count(F.lit(1)).alias("rows"), F.countDistinct("entity_id").alias("entities")
    ).withColumn("ok", (F.col("rows") == n) & (F.col("entities") == n))


def verdict(checks: DataFrame, ok: str = "ok") -> DataFrame:
    return checks.agg(F.count(F.lit(1)).alias("checks"), F.count_if(~F.col(ok)).alias("failed"),
                      F.bool_and(ok).alias("passed"))


def qa_table(df: DataFrame, rules: Mapping[str, tuple[Column, object]]) -> DataFrame:
    """(item, actual, expected, pass) from aggregate expressions, all in one pass."""
    one = df.agg(*[agg.cast("string").alias(f"_{i}") for i, (agg, _) in enumerate(rules.values())])
    items = F.array(*[
        F.struct(F.lit(name).alias("item"), F.col(f"_{i}").alias("actual"), F.lit(str(exp)).alias("expected"))
        for i, (name, (_, exp)) in enumerate(rules.items())])
    return one.select(F.explode(items).alias("q")).select("q.*").withColumn("ok", F.col("actual") == F.col("expected"))


def fail_fast(checks: DataFrame, ok: str = "ok") -> DataFrame:
    """Raise inside the job on the first failed check; otherwise pass the rows through."""
    return checks.where(F.when(F.col(ok), True).otherwise(F.raise_error(
        F.concat(F.lit("quality check failed: "), F.to_json(F.struct(*checks.columns)))).cast("boolean")))


def daily_quality(df: DataFrame, expected: int) -> DataFrame:
    rows = F.count(F.lit(1))
    q = df.groupBy(*DAY).agg(
        rows.alias("rows"), F.countDistinct("entity_id").alias("entities"),
        (rows - F.countDistinct("entity_id")).alias("duplicates"),
        F.count_if(F.col("metric").isNull() | F.col("label").isNull()).alias("missing"),
        F.count_if(F.col("activity") < 0).alias("negative"))
    return q.withColumn("eligible", (F.col("entities") >= expected) & (F.col("duplicates") == 0)
                        & (F.col("missing") == 0) & (F.col("negative") == 0))


def calendar(df: DataFrame) -> DataFrame:
    """Every calendar day between a site's first and last observed day."""
    return df.groupBy(*SITE).agg(F.min("day").alias("a"), F.max("day").alias("b")).select(
        *SITE, F.explode(F.sequence("a", "b")).alias("day"))


def missing_days(df: DataFrame) -> DataFrame:
    return calendar(df).join(df.select(*DAY).distinct(), DAY, "left_anti")


def missing_entity_days(df: DataFrame) -> DataFrame:
    """Per entity, the calendar days missing between its first and last day."""
    w = Window.partitionBy(*ENTITY).orderBy("day")
    gaps = df.select(*ENTITY, F.lag("day").over(w).alias("prev"), "day").where(F.datediff("day", "prev") > 1)
    return gaps.select(*ENTITY, F.explode(F.sequence(F.date_add("prev", 1), F.date_sub("day", 1))).alias("day"))


def completeness(days: DataFrame, sources: Mapping[str, DataFrame]) -> DataFrame:
    """One OK / MISSING column per source over the day list, and the joined to-do text."""
    out = days.select(*DAY).distinct()
    for name, src in sources.items():
        have = src.select(*DAY).distinct().withColumn(f"_{name}", F.lit(1))
        out = out.join(have, DAY, "left").withColumn(
            name, F.when(F.col(f"_{name}").isNotNull(), "OK").otherwise("MISSING")).drop(f"_{name}")
    todo = F.concat_ws(",", *[F.when(F.col(n) == "MISSING", n) for n in sources])
    return out.withColumn("todo", todo)


def presence(df: DataFrame) -> DataFrame:
    return df.groupBy(*ENTITY).agg(
        F.countDistinct("label").alias("labels"), F.countDistinct("day").alias("observed"),
        F.min("day").alias("first_day"), F.max("day").alias("last_day")
    ).withColumn("multi_label", F.col("labels") > 1)


def dedupe(df: DataFrame, key: Sequence[str], order: Sequence[Column], keep: str = "last") -> DataFrame:
    """One row per key, first or last in ingest order; copies combine before the shuffle."""
    rest = [c for c in df.columns if c not in key]
    pick = F.max_by if keep == "last" else F.min_by
    best = df.groupBy(*key).agg(pick(F.struct(*rest), F.struct(*order)).alias("_row"))
    return best.select(*key, "_row.*").select(*df.columns)


def clean(df: DataFrame, start: str | None = None, end: str | None = None,
          required: Sequence[str] = ("day", "entity_id", "label", "metric")) -> DataFrame:
    out = df.na.drop(subset=list(required))
    if start:
        out = out.where(F.col("day") >= F.lit(start).cast("date"))
    if end:
        out = out.where(F.col("day") <= F.lit(end).cast("date"))
    return out


def reject_reasons(df: DataFrame, rules: Sequence[tuple[Column, str]]) -> DataFrame:
    return df.withColumn("reasons", F.concat_ws("; ", *[F.when(c, name) for c, name in rules]))


def primary_sample(eligible_days: DataFrame, n: int) -> DataFrame:
    """First n eligible days of a site, numbered (one row per day comes in)."""
    w = Window.partitionBy(*SITE).orderBy("day")
    return eligible_days.withColumn("sample_index", F.row_number().over(w)).where(F.col("sample_index") <= n)


def progress(sample: DataFrame, target: int) -> DataFrame:
    return sample.groupBy(*SITE).agg(
        F.count(F.lit(1)).alias("collected"), F.min("day").alias("first_day"), F.max("day").alias("last_day")
    ).withColumns({
        "target": F.lit(target), "remaining": F.greatest(F.lit(0), F.lit(target) - F.col("collected")),
        "state": F.when(F.col("collected") >= target, "COMPLETE").otherwise("COLLECTING"),
    })


def apply_quarantine(df: DataFrame, registry: DataFrame, on: Sequence[str], digest: str = "digest") -> DataFrame:
    """Mark rows quarantined on an exact key and hash match; a hash mismatch is flagged, not passed."""
    reg = registry.select(*on, F.col(digest).alias("_expected")).distinct()
    j = df.join(reg, list(on), "left")
    return j.withColumn("quarantine", F.when(F.col("_expected").isNull(), "CLEAR").when(
        F.col("_expected") == F.col(digest), "QUARANTINED").otherwise("HASH_MISMATCH")).drop("_expected")


def usable(marked: DataFrame) -> DataFrame:
    """Rows allowed into aggregates; fails the job on a hash mismatch."""
    bad = F.col("quarantine") == "HASH_MISMATCH"
    return marked.where(F.when(bad, F.raise_error(F.lit("quarantine hash mismatch")).cast("boolean")).otherwise(
        F.col("quarantine") == "CLEAR"))


def forward_valid(df: DataFrame, made_at: str = "made_at", target: str = "target_day", through: str = "data_through",
                  hour: int = 9, zone: str = "Asia/Tokyo") -> DataFrame:
    """A prediction counts only if made for the day after its data and before the local deadline."""
    local = F.from_utc_timestamp(F.col(made_at).cast("timestamp"), zone)
    deadline = F.col(target).cast("timestamp") + F.make_interval(hours=F.lit(hour))
    return df.withColumn("gap", F.datediff(target, through)).withColumn("forward_valid", (
        F.col("gap") == 1) & (local < deadline))


def check_picks(picks: DataFrame, n: int = 10, by: Sequence[str] = DAY) -> DataFrame:
    return picks.groupBy(*by).agg(
        F.count(F.lit(1)).alias("rows"), F.countDistinct("rank").alias("ranks"), F.max("rank").alias("max_rank"),
        F.countDistinct("entity_id").alias("entities")
    ).withColumn("ok", (F.col("rows") == n) & (F.col("ranks") == n) & (F.col("max_rank") == n)
                 & (F.col("entities") == n))


def having_min(df: DataFrame, by: Sequence[str], n: int) -> DataFrame:
    return df.groupBy(*by).agg(F.count(F.lit(1)).alias("n"), F.avg("metric").alias("mean")).where(F.col("n") >= n)


def agreement(a: DataFrame, b: DataFrame, key: Sequence[str], values: Sequence[str]) -> DataFrame:
    """Keys on one side only and differing values per column between two result tables."""
    l, r = a.alias("l"), b.alias("r")
    on = [F.col(f"l.{k}").eqNullSafe(F.col(f"r.{k}")) for k in key]
    j = l.withColumn("_l", F.lit(1)).alias("l").join(r.withColumn("_r", F.lit(1)).alias("r"), on, "full_outer")
    both = F.col("_l").isNotNull() & F.col("_r").isNotNull()
    return j.agg(
        F.count_if(F.col("_r").isNull()).alias("left_only"), F.count_if(F.col("_l").isNull()).alias("right_only"),
        *[F.count_if(both & ~F.col(f"l.{v}").eqNullSafe(F.col(f"r.{v}"))).alias(f"diff_{v}") for v in values])


def leakage_probe(build: Callable[[DataFrame], DataFrame], panel: DataFrame, day: str,
                  features: Sequence[str], key: Sequence[str] = KEY) -> DataFrame:
    """Rows of the target day whose features move when that day's metric is replaced. Must be empty."""
    target = F.col("day") == F.lit(day).cast("date")
    poisoned = panel.withColumn("metric", F.when(target, F.lit(987654321.0)).otherwise(F.col("metric")))
    cols = [*key, *features]
    before, after = (build(p).where(target).select(*cols) for p in (panel, poisoned))
    return before.exceptAll(after)
