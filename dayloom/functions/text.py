"""Cleaning expressions for text cells: numbers, ratios, dates, labels."""

from __future__ import annotations

import re
import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Header spellings and their canonical column.
HEADER_ALIASES = {
    "日付": "day", "date": "day", "target_date": "day",
    "台番号": "entity_id", "machine_no": "entity_id", "台番": "entity_id",
    "機種名": "label", "machine_name": "label", "機種": "label",
    "G数": "activity", "games": "activity", "G": "activity",
    "差枚": "metric", "diff": "metric", "差枚数": "metric",
    "BB": "c1", "RB": "c2",
}

# Date spellings accepted in daily files.
DAY_FORMATS = ["yyyyMMdd", "yyyy-MM-dd", "yyyy/MM/dd", "yyyy.MM.dd"]


def to_int0(c: Column) -> Column:
    """Dirty integer; anything unreadable is 0."""
    return F.coalesce(F.translate(F.trim(c), ",+", "").try_cast("bigint"), F.lit(0))


def to_number(c: Column) -> Column:
    """First signed decimal in the text (full-width minus included), else null."""
    flat = F.translate(c, "−－,+", "--")
    return F.regexp_extract(flat, r"-?\d+(\.\d+)?", 0).try_cast("double")


def to_percent(c: Column) -> Column:
    return F.regexp_extract(F.translate(c, "−－,", "--"), r"(-?\d+(\.\d+)?)\s*[%％]", 1).try_cast("double")


def to_ratio(c: Column) -> Column:
    """``"w/n"`` text as struct(wins, total, pct)."""
    pattern = r"(\d+)\s*/\s*(\d+)"
    clean = F.translate(c, ",", "")
    wins = F.regexp_extract(clean, pattern, 1).try_cast("bigint")
    total = F.regexp_extract(clean, pattern, 2).try_cast("bigint")
    return F.struct(wins.alias("wins"), total.alias("total"), F.try_divide(wins * 100.0, total).alias("pct"))


def to_day(c: Column) -> Column:
    """Date in any accepted spelling, else null."""
    text = F.trim(c)
    return F.coalesce(*[F.try_to_timestamp(text, F.lit(fmt)).cast("date") for fmt in DAY_FORMATS])


def norm_label_ascii(c: Column, prefixes: list[str] = ()) -> Column:
    """Whitespace dropped, listed prefixes stripped, lower case."""
    out = F.lower(F.regexp_replace(c, r"\s+", ""))
    for prefix in prefixes:
        quoted = "^" + re.sub(r"(\W)", r"\\\1", prefix)
        out = F.regexp_replace(out, quoted, "")
    return out


@F.pandas_udf(T.StringType())
def nfkc(s: pd.Series) -> pd.Series:
    """Unicode compatibility form; Spark has no built-in for it."""
    return s.map(lambda v: None if v is None else unicodedata.normalize("NFKC", v))


def norm_label(c: Column, prefixes: list[str] = ()) -> Column:
    return norm_label_ascii(nfkc(c), prefixes)


def canonical_header(c: Column) -> Column:
    """Canonical column for a header cell; unknown headers pass through."""
    pairs = [F.lit(x) for kv in HEADER_ALIASES.items() for x in kv]
    return F.coalesce(F.try_element_at(F.create_map(*pairs), F.trim(c)), F.trim(c))
