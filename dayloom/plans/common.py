"""Inputs used by many registered queries."""

from pyspark.sql import functions as F

from dayloom import panel as P
from dayloom.operators import aggregates as A


def panel(spark, folder):
    return P.panel_from_events(P.table(spark, folder, "events"))


def lines(spark, folder):
    return P.panel_from_lines(P.table(spark, folder, "lineitem"), P.table(spark, folder, "part"))


def daily(spark, folder):
    return A.by_day(panel(spark, folder))


def shuffled_second(spark, folder):
    return P.second_source(panel(spark, folder))


__all__ = ["panel", "lines", "daily", "shuffled_second", "F", "P", "A"]
