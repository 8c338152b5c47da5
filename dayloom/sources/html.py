"""Pages to rows: built-in regular expressions where they suffice, a table parser where they do not."""

from __future__ import annotations

import re
from collections.abc import Iterator, Sequence
from html.parser import HTMLParser

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from dayloom.functions import text as TX


def extract_title(pages: DataFrame, html: str = "html") -> DataFrame:
    return pages.withColumn("title", F.regexp_extract(html, r"(?s)<title>(.*?)</title>", 1))


def check_title_day(pages: DataFrame, expected: str, html: str = "html") -> DataFrame:
    """Date in the title against the expected date column."""
    raw = F.regexp_extract("title", r"(20\d{2})[-/](\d{1,2})[-/](\d{1,2})", 0)
    day = F.coalesce(F.try_to_timestamp(F.translate(raw, "/", "-"), F.lit("yyyy-M-d")).cast("date"), F.lit(None))
    return extract_title(pages, html).withColumn("title_day", day).withColumn(
        "title_ok", F.coalesce(F.col("title_day") == F.col(expected), F.lit(False)))


def extract_pattern(pages: DataFrame, pattern: str, groups: Sequence[str], html: str = "html") -> DataFrame:
    """One row per match with the pattern's groups as columns, numbered in page order."""
    found = [F.regexp_extract_all(html, F.lit(pattern), F.lit(i + 1)).alias(n) for i, n in enumerate(groups)]
    keep = [c for c in pages.columns if c != html]
    return pages.select(*keep, F.posexplode(F.arrays_zip(*found)).alias("position", "m")).select(
        *keep, "position", *[F.col(f"m.{n}").alias(n) for n in groups])


LINK = r'<li><a href="([^"]*)">([^<]*)</a></li>'


def extract_links(pages: DataFrame) -> DataFrame:
    return extract_pattern(pages, LINK, ["href", "text"])


def tag_census(pages: DataFrame, tags: Sequence[str], html: str = "html") -> DataFrame:
    """How many pages share the same tag-count signature."""
    counts = [F.concat(F.lit(f"{t}="), F.size(F.regexp_extract_all(html, F.lit(f"<({t})[ >]"), F.lit(1))).cast("string"))
              for t in tags]
    return pages.select(F.concat_ws(",", *counts).alias("signature")).groupBy("signature").agg(
        F.count(F.lit(1)).alias("pages"))


def header_census(rows: DataFrame, by: Sequence[str] = ("page_id",)) -> DataFrame:
    """Tables and pages of each header signature, from the rows of parsed tables."""
    one = rows.where("row_no = 1").select(*by, F.array_join("headers", ",").alias("headers"))
    return one.groupBy("headers").agg(F.count(F.lit(1)).alias("tables"), F.countDistinct(*by).alias("pages"))


def tables_per_entity(rows: DataFrame, entity: str = "entity_id") -> DataFrame:
    """How many entities stand in how many tables."""
    own = table_to_text_rows(rows, [entity]).select("page_id", entity).distinct()
    return own.groupBy(entity).agg(F.count(F.lit(1)).alias("tables")).groupBy("tables").agg(F.count(F.lit(1)).alias("entities"))


class _Tables(HTMLParser):
    """Collects every table of a page as (id, rows of cell texts)."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.tables: list[tuple[str, list[list[str]]]] = []
        self._open: list[int] = []
        self._cell: list[str] | None = None

    def handle_starttag(self, tag, attrs):
        if tag == "table":
            self.tables.append((dict(attrs).get("id") or "", []))
            self._open.append(len(self.tables) - 1)
        elif self._open and tag == "tr":
            self.tables[self._open[-1]][1].append([])
        elif self._open and tag in ("td", "th"):
            rows = self.tables[self._open[-1]][1]
            if not rows:
                rows.append([])
            self._cell = []

    def handle_endtag(self, tag):
        if tag in ("td", "th") and self._cell is not None and self._open:
            rows = self.tables[self._open[-1]][1]
            rows[-1].append(re.sub(r"\s+", " ", "".join(self._cell)).strip())
            self._cell = None
        elif tag == "table" and self._open:
            self._open.pop()

    def handle_data(self, data):
        if self._cell is not None:
            self._cell.append(data)


def main_table(html: str, required: Sequence[str], table_id: str) -> list[list[str]]:
    """The table with the known id, else the largest one whose headers hold all required names."""
    parser = _Tables()
    parser.feed(html or "")
    named = [rows for i, rows in parser.tables if i == table_id and rows]
    if named:
        return named[0]
    canon = lambda h: TX.HEADER_ALIASES.get(h, h)
    fit = [rows for _, rows in parser.tables if rows and set(required) <= {canon(h) for h in rows[0]}]
    return max(fit, key=len, default=[])


PAGES, HELD = 32, 1 << 12  # pages unpacked at once, rows of tables given out at once
TABLE_ROWS = "page_id bigint, row_no int, headers array<string>, cells array<string>"


def extract_tables(pages: DataFrame, required: Sequence[str] = ("day", "entity_id", "label", "metric"),
                   table_id: str = "all_data_table") -> DataFrame:
    """Rows of each page's main table with its canonical headers. A task holds some pages and HELD rows at once, however many a batch has."""
    req = list(required)
    text = pa.list_(pa.string())
    schema = pa.schema([("page_id", pa.int64()), ("row_no", pa.int32()), ("headers", text), ("cells", text)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out = []
        for batch in batches:
            for at in range(0, batch.num_rows, PAGES):
                some = batch.slice(at, PAGES)
                for page_id, html in zip(some.column(0).to_pylist(), some.column(1).to_pylist()):
                    table = main_table(html, req, table_id)
                    if table:
                        headers = [TX.HEADER_ALIASES.get(h, h) for h in table[0]]
                        for i, cells in enumerate(table[1:], start=1):
                            if cells:
                                out.append({"page_id": page_id, "row_no": i, "headers": headers, "cells": cells})
                            if len(out) >= HELD:
                                yield pa.RecordBatch.from_pylist(out, schema)
                                out = []
        if out:
            yield pa.RecordBatch.from_pylist(out, schema)

    return pages.select(F.col("page_id").cast("bigint").alias("page_id"), "html").mapInArrow(run, TABLE_ROWS)


def table_to_text_rows(rows: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Cells by canonical header name, whatever the column order of the page."""
    return rows.select("page_id", "row_no", *[
        F.try_element_at("cells", F.nullif(F.array_position("headers", c), F.lit(0)).cast("int")).alias(c)
        for c in columns])
