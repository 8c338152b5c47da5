"""Numeric and categorical column expressions shared by all operators."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

Z95 = 1.959963984540054

WEEKDAYS = ["月", "火", "水", "木", "金", "土", "日"]


def weekday_no(day: Column) -> Column:
    """0 = Monday."""
    return F.weekday(day)


def weekday_name(day: Column) -> Column:
    return F.element_at(F.array(*[F.lit(x) for x in WEEKDAYS]), F.weekday(day) + 1)


def win(c: Column) -> Column:
    return (c > 0).cast("int")


def flag_columns(c: Column, t: Sequence[float]) -> dict[str, Column]:
    """win, plus_t and minus_t 0/1 columns."""
    out = {"win": win(c)}
    for v in t:
        out[f"plus_{v:g}"] = (c >= v).cast("int")
        out[f"minus_{v:g}"] = (c <= -v).cast("int")
    return out


def step(c: Column, breaks: Sequence[float], values: Sequence) -> Column:
    """values[i] for the first break with ``c >= break``; last value below all of them."""
    out = F
    for b, v in zip(breaks, values):
        out = out.when(c >= b, v)
    return out.otherwise(values[-1]) if len(values) > len(breaks) else out


def step_up(c: Column, breaks: Sequence[float], values: Sequence) -> Column:
    """values[i] for the first break with ``c <= break``; last value above all of them."""
    out = F
    for b, v in zip(breaks, values):
        out = out.when(c <= b, v)
    return out.otherwise(values[-1])


def grade(c: Column, cuts: Sequence[float], names: Sequence[str]) -> Column:
    return step(c, cuts, names)


def cut(c: Column, inner_edges: Sequence[float], labels: Sequence[str]) -> Column:
    """Right-closed bins (a, b]; the outer bins are open ended. Null stays null."""
    return F.when(c.isNull(), None).otherwise(step_up(c, inner_edges, labels))


def squash(c: Column, scale: float) -> Column:
    return clip(50 + 50 * F.tanh(c / scale))


def clip(c: Column, lo: float = 0.0, hi: float = 100.0) -> Column:
    return F.greatest(F.lit(lo), F.least(F.lit(hi), c))


def to_range(c: Column, lo: Column | float, hi: Column | float) -> Column:
    """Position of c between lo and hi on 0..100; 50 when the range is empty."""
    lo = F.lit(lo) if not isinstance(lo, Column) else lo
    hi = F.lit(hi) if not isinstance(hi, Column) else hi
    return F.when(c.isNull() | (hi <= lo), 50.0).otherwise(clip((c - lo) / (hi - lo) * 100))


def confidence_exp(n: Column, k: float) -> Column:
    return 1 - F.exp(-n / k)


def confidence_sqrt(n: Column, full: int = 31) -> Column:
    return F.sqrt(F.least(n, F.lit(full)) / full)


def ratio(a: Column, b: Column) -> Column:
    """Null on a zero denominator."""
    return F.try_divide(a.cast("double"), b)


def ratio0(a: Column, b: Column) -> Column:
    return F.coalesce(ratio(a, b), F.lit(0.0))


def wilson(k: Column, n: Column, z: float = Z95) -> tuple[Column, Column]:
    """Wilson score interval, clamped to [0, 1]; null for n = 0."""
    p = ratio(k, n)
    denom = 1 + z * z / n
    centre = (p + z * z / (2 * n)) / denom
    half = z * F.sqrt(p * (1 - p) / n + z * z / (4 * n * n)) / denom
    ok = n > 0
    return F.when(ok, F.greatest(F.lit(0.0), centre - half)), F.when(ok, F.least(F.lit(1.0), centre + half))


def shrink(k: Column, n: Column, prior: Column, prior_n: float) -> Column:
    """Empirical-Bayes pull of the sum k over n rows towards a prior mean."""
    return (k + prior * prior_n) / (n + prior_n)


def lag_bucket(days: Column) -> Column:
    """Days since an event: DAY1..DAY3, then widening ranges."""
    return F.when(days <= 3, F.concat(F.lit("DAY"), days.cast("string"))).otherwise(
        step_up(days, [7, 14, 21, 31], ["DAY4-7", "DAY8-14", "DAY15-21", "DAY22-31", "DAY32+"])
    )


def delay_class(days: Column) -> Column:
    """Arrival delay of the latest data: on time, provisional, stale."""
    return (
        F.when(days <= 1, "FORMAL").when(days == 2, "PROVISIONAL").when(days == 3, "LAG_2").otherwise("LAG_3_PLUS")
    )


def uniform(*parts: Column | str | int) -> Column:
    """Reproducible uniform in [0, 1) from a text key; the same in any engine with MD5."""
    cols = [p if isinstance(p, Column) else F.lit(str(p)) for p in parts]
    key = F.concat_ws("|", *[c.cast("string") for c in cols])
    return F.conv(F.substring(F.md5(key), 1, 8), 16, 10).cast("double") / 4294967296.0


def reasons(rules: Sequence[tuple[Column, str]], limit: int, default: str) -> Column:
    """The first ``limit`` matching reason texts, joined."""
    found = F.array_compact(F.array(*[F.when(cond, text) for cond, text in rules]))
    return F.when(F.size(found) == 0, default).otherwise(F.concat_ws(" / ", F.slice(found, 1, limit)))


def rank_key(c: Column) -> Column:
    """Scores are rounded before ranking so ties do not hang on summation order."""
    return F.round(c, 9)
