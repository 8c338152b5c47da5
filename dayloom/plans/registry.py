"""Named queries over the driver's tables, each with the SQL it must agree with.

An output spec such as ``"day:d label:s n:i mean:f"`` fixes column order and
types on both sides: d = date text, s = string, i = bigint, f = double to six
places, m = large double to three places, b = boolean.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}

_SQL_CAST = {
    "d": "CAST(CAST({c} AS DATE) AS VARCHAR)",
    "s": "CAST({c} AS VARCHAR)",
    "i": "CAST({c} AS BIGINT)",
    "f": "round_even(round(CAST({c} AS DOUBLE), 9) * 1e6::DOUBLE, 0) / 1e6::DOUBLE + 0::DOUBLE",
    "m": "round_even(round(CAST({c} AS DOUBLE), 6) * 1e3::DOUBLE, 0) / 1e3::DOUBLE + 0::DOUBLE",
    "b": "CAST({c} AS BOOLEAN)",
}


def _columns(spec: str) -> list[tuple[str, str]]:
    return [tuple(x.split(":")) for x in spec.split()]


def shape(df: DataFrame, spec: str) -> DataFrame:
    cast = {
        "d": lambda c: c.cast("date").cast("string"),
        "s": lambda c: c.cast("string"),
        "i": lambda c: c.cast("bigint"),
        # The first rounding drops what the order of a sum leaves in the last bits, so a tie of the second is one in any engine.
        "f": lambda c: F.rint(F.round(c.cast("double"), 9) * 1e6) / 1e6 + F.lit(0.0),
        "m": lambda c: F.rint(F.round(c.cast("double"), 6) * 1e3) / 1e3 + F.lit(0.0),
        "b": lambda c: c.cast("boolean"),
    }
    return df.select(*[cast[k](F.col(c)).alias(c) for c, k in _columns(spec)])


def query(name: str, spec: str, sql: str | None = None, ctes: str = ""):
    """Register a query; ``ctes`` is a comma-joined chain placed before the final select."""

    def add(fn):
        QUERIES[name] = lambda spark, folder: shape(fn(spark, folder), spec)
        if sql is not None:
            cols = ", ".join(f"{_SQL_CAST[k].format(c='q.' + c)} AS {c}" for c, k in _columns(spec))
            head = f"WITH {ctes}\n" if ctes else ""
            SQL[name] = f"{head}SELECT {cols} FROM (\n{sql.strip()}\n) q"
        return fn

    return add
