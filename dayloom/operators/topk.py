"""Top lists, rank bands, score bands and shortlists; set operations on keys."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from dayloom.operators import ordering as O
from dayloom.operators.scoring import best_first
from dayloom.panel import DAY, SITE


def top(df: DataFrame, n: int, order: Sequence[Column]) -> DataFrame:
    return df.orderBy(*order).limit(n)


def bands(df: DataFrame, table: Sequence[tuple[str, int, int]]) -> DataFrame:
    """A row for every band its rank falls into."""
    hit = F.filter(F.array(*[
        F.struct(F.lit(n).alias("band"), F.lit(a).alias("lo"), F.lit(b).alias("hi")) for n, a, b in table
    ]), lambda s: (F.col("rank") >= s["lo"]) & (F.col("rank") <= s["hi"]))
    return df.withColumn("_b", F.explode(hit)).withColumn("band", F.col("_b.band")).drop("_b")


SHARES = (("TOP1", 0.01), ("TOP2", 0.02), ("TOP5", 0.05), ("TOP10", 0.10), ("TOP20", 0.20), ("TOP30", 0.30),
          ("TOP50", 0.50))


def score_bands(df: DataFrame, shares: Sequence[tuple[str, float]] = SHARES, by: Sequence[str] = DAY) -> DataFrame:
    """Exclusive percentile bands: each ends at ceil(n * share) rows, never below the band before it."""
    x = df.withColumn("_neg", -F.col("score"))
    x = O.position(x, by, [F.col("_neg"), F.col("entity_id")], "_r", "_n").drop("_neg")
    band, edge = F, F.lit(1)
    for name, share in shares:
        edge = F.greatest(edge, F.ceil(F.col("_n") * share))
        band = band.when(F.col("_r") <= edge, name)
    return x.withColumn("score_band", band.otherwise("BOTTOM50")).drop("_r", "_n")


def tiers(df: DataFrame, primary: int = 5, following: int = 10) -> DataFrame:
    return df.withColumn("tier", F.when(F.col("rank") <= primary, "PRIMARY").when(
        F.col("rank") <= following, "NEXT").otherwise("OUTSIDE"))


def nlargest(df: DataFrame, n: int, value: str, tie: str = "day") -> DataFrame:
    return df.orderBy(F.desc(value), tie).limit(n)


def nsmallest(df: DataFrame, n: int, value: str, tie: str = "day") -> DataFrame:
    return df.orderBy(value, tie).limit(n)


def shortlist(scored: DataFrame, unavailable: DataFrame, n: int) -> DataFrame:
    """Best n per day after removing unavailable entities, renumbered."""
    left = scored.join(unavailable.select(*DAY, "entity_id"), [*DAY, "entity_id"], "left_anti")
    return O.top_n(left, DAY, best_first(), n)


def union_all(*frames: DataFrame) -> DataFrame:
    out = frames[0]
    for f in frames[1:]:
        out = out.unionByName(f, allowMissingColumns=True)
    return out


def intersect_days(*frames: DataFrame, on: Sequence[str] = DAY) -> DataFrame:
    out = frames[0].select(*on)
    for f in frames[1:]:
        out = out.intersect(f.select(*on))
    return out


def except_days(a: DataFrame, b: DataFrame, on: Sequence[str] = DAY) -> DataFrame:
    return a.select(*on).exceptAll(b.select(*on).distinct()).distinct()


def distinct_counts(df: DataFrame) -> DataFrame:
    return df.groupBy(*SITE).agg(F.countDistinct("day").alias("days"), F.countDistinct("entity_id").alias("entities"),
                                 F.countDistinct("label").alias("labels"))


def same_rows(a: DataFrame, b: DataFrame) -> DataFrame:
    """Rows (with multiplicity) that only one of two tables has; empty means equal."""
    cols = a.columns
    b = b.select(*cols)
    return a.exceptAll(b).withColumn("side", F.lit("LEFT")).unionByName(
        b.exceptAll(a).withColumn("side", F.lit("RIGHT")))
