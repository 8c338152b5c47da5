"""The panel schema and its projections from event and order-line tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

PANEL = T.StructType([
    T.StructField("site", T.StringType()),
    T.StructField("day", T.DateType()),
    T.StructField("entity_id", T.LongType()),
    T.StructField("label", T.StringType()),
    T.StructField("activity", T.DoubleType()),
    T.StructField("metric", T.DoubleType()),
    T.StructField("c1", T.LongType()),
    T.StructField("c2", T.LongType()),
])

SITE = ["site"]
DAY = ["site", "day"]
ENTITY = ["site", "entity_id"]
LABEL = ["site", "label"]
KEY = ["site", "day", "entity_id"]


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def one_site(key: str) -> Column:
    """All keyed rows belong to one site. Not a bare literal: those fold out of join and window keys."""
    return F.when(F.col(key).isNull(), "unassigned").otherwise("main")


def panel_from_events(events: DataFrame, site: Column | None = None) -> DataFrame:
    """One row per (user, calendar day); errors count against the metric."""
    signed = F.when(F.col("event_type") == "error", -F.col("value")).otherwise(F.col("value"))
    site = one_site("user_id") if site is None else site
    return (
        events.groupBy(site.alias("site"), F.to_date("ts").alias("day"), F.col("user_id").alias("entity_id"))
        .agg(
            F.max_by("event_type", "event_id").alias("label"),
            F.count(F.lit(1)).cast("double").alias("activity"),
            F.round(F.sum(signed - 50), 2).alias("metric"),
            F.count_if(F.col("event_type") == "purchase").alias("c1"),
            F.count_if(F.col("event_type") == "error").alias("c2"),
        )
    )


def panel_from_lines(lineitem: DataFrame, part: DataFrame, site: Column | None = None) -> DataFrame:
    """One row per (supplier, ship day); returned lines count against the metric.

    Money is summed in DECIMAL so the totals do not depend on shuffle order.
    """
    site = one_site("l_suppkey") if site is None else site
    price = F.col("l_extendedprice").cast("decimal(18,2)") * (1 - F.col("l_discount").cast("decimal(4,2)"))
    signed = price * F.when(F.col("l_returnflag") == "R", -1).otherwise(1)
    return (
        lineitem.join(part.select("p_partkey", "p_brand"), F.col("l_partkey") == F.col("p_partkey"))
        .groupBy(site.alias("site"), F.to_date("l_shipdate").alias("day"), F.col("l_suppkey").alias("entity_id"))
        .agg(
            F.max_by("p_brand", F.struct(F.col("l_orderkey") * 10 + F.col("l_linenumber"), "l_partkey")).alias("label"),
            F.sum("l_quantity").alias("activity"),
            F.sum(signed).cast("double").alias("metric"),
            F.count_if(F.col("l_returnflag") == "A").alias("c1"),
            F.count_if(F.col("l_returnflag") == "R").alias("c2"),
        )
    )


def layout_of(panel: DataFrame) -> DataFrame:
    """Physical layout derived from the id: islands of 20 with one gap and one curved island."""
    e, within = F.col("entity_id"), F.col("entity_id") % 20
    island = F.floor(e / 20)
    return panel.select("site", "entity_id").distinct().select(
        "site", "entity_id",
        island.cast("string").alias("island_id"),
        F.when(island % 2 == 0, "N").otherwise("S").alias("side"),
        (within + 1).cast("int").alias("position_order"),
        (within + F.when(within >= 7, 1).otherwise(0)).cast("int").alias("slot_index"),
        F.when(island == 3, "arc").otherwise("rect").alias("shape"),
    )


def second_source(panel: DataFrame) -> DataFrame:
    """A second observer of the same panel: some rows missing, some off by one."""
    return panel.where(F.col("entity_id") % 17 != 0).withColumn(
        "metric", F.when(F.col("entity_id") % 13 == 0, F.col("metric") + 1).otherwise(F.col("metric"))
    )
