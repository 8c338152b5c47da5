"""Raw CSV files read by splits: records, cells and widths without one task per file.

A physical line is a row of Spark's text source, so a file of any size is read
by as many tasks as it has splits. Lines without a quotation mark are records
as they stand. Where a quoted cell holds a line break, the state in which a
line begins follows from all quotation marks before it: each split works out
its lines for both states that it may begin in, a scan over the splits (one
short row each) picks the right one, and only the lines of broken records are
brought together.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from dayloom.functions import text as TX
from dayloom.operators import ordering as O
from dayloom.session import materialise

CELL = r'("(?:[^"]|"")*"|[^,]*),'  # a quoted cell or one without a comma, and its comma


def packed_lines(files: DataFrame) -> DataFrame:
    """(path, block, at, value): the physical lines of files that are rows (path, content), text or bytes of any encoding.

    Very many small files are kept in a table: each file of its own costs a
    folder to list, a task to open it and system calls. A row is one split.
    """
    text = F.decode(F.col("content").cast("binary"), "ISO-8859-1")  # a character for each byte
    bare = F.when(text.endswith("\n"), F.substr(text, F.lit(1), F.length(text) - 1)).otherwise(text)
    lines = files.where(F.octet_length("content") > 0).select("path", F.posexplode(F.split(bare, "\n", -1)).alias("at", "value"))
    return lines.select("path", F.lit(0).cast("long").alias("block"), F.col("at").cast("long").alias("at"), F.encode("value", "ISO-8859-1").alias("value"))


def raw_lines(spark: SparkSession, path: str | DataFrame, glob: str = "*.csv") -> DataFrame:
    """(path, block, at, value): the physical lines below a folder as bytes, with the split they stand in and their place there.

    In the place of a folder there may be a table of ``packed_lines``.
    """
    if isinstance(path, DataFrame):
        return packed_lines(path)
    lines = spark.read.option("lineSep", "\n").option("pathGlobFilter", glob).option("recursiveFileLookup", "true").text(path)
    return lines.select(F.col("_metadata.file_path").alias("path"), F.col("_metadata.file_block_start").alias("block"),
                        F.monotonically_increasing_id().alias("at"), F.col("value").cast("binary").alias("value"))


def numbered(lines: DataFrame) -> DataFrame:
    """Lines with ``line`` (from 1 in the file), ``open`` (it begins inside a quoted cell) and ``flips`` (an odd number of quotation marks)."""
    bare = F.when(F.substring("value", -1, 1) == F.lit(b"\r"), F.expr("substring(value, 1, octet_length(value) - 1)")).otherwise(F.col("value"))
    flip = F.expr("octet_length(value) - octet_length(replace(cast(value AS string), '\"', ''))") % 2 == 1
    marked = materialise(lines.select("path", "block", "at", bare.alias("value"), flip.alias("flips")), "lines")
    splits = marked.groupBy("path", "block").agg(F.min("at").alias("_at"), F.count(F.lit(1)).alias("_n"), F.count_if("flips").alias("_f"))
    of_file = Window.partitionBy("path")  # the splits of one file
    before = of_file.orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    splits = splits.select("path", "block", "_at", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_first"),
                           (F.coalesce(F.sum("_f").over(before), F.lit(0)) % 2).alias("_begins"), (F.sum("_f").over(of_file) > 0).alias("_odd"))
    out = O.attach(marked, splits, ["path", "block"]).withColumn("line", F.col("_first") + F.col("at") - F.col("_at") + 1)
    in_split = Window.partitionBy("path", "block").orderBy("at").rowsBetween(Window.unboundedPreceding, -1)  # bounded by the size of a split
    state = (F.coalesce(F.sum(F.col("flips").cast("int")).over(in_split), F.lit(0)) + F.col("_begins")) % 2 == 1
    columns = ["path", "line", "value", "open", "flips"]
    return out.where("not _odd").withColumn("open", F.lit(False)).select(*columns).unionByName(
        out.where("_odd").withColumn("open", state).select(*columns))


def records(lines: DataFrame) -> DataFrame:
    """(path, line, value): whole records, with the line that they begin in.

    Only the lines of records with a line break in a cell are grouped: a record
    begins where a closed line opens a cell, and its lines are those up to the
    one that closes it. A last record that never closes ends with its file.
    """
    part = F.col("open") | F.col("flips")
    broken = materialise(lines.where(part).select("path", "line", "value", "open"), "broken")
    whole = lines.where(~part).select("path", "line", "value")
    if broken.isEmpty():
        return whole
    # Broken lines are few; a file's are numbered by ranges like any group of any size.
    begin = O.running_totals(broken.withColumn("_one", (~F.col("open")).cast("int")), ["path"], "line", {"_record": "_one"})
    joined = begin.groupBy("path", "_record").agg(
        F.min("line").alias("line"), F.sort_array(F.collect_list(F.struct("line", F.col("value").alias("v")))).alias("_all"))
    text = F.aggregate(F.slice("_all", 2, F.greatest(F.size("_all") - 1, F.lit(0))), F.col("_all")[0]["v"].cast("binary"),
                       lambda t, x: F.concat(t, F.lit(b"\n"), x["v"]))
    return whole.unionByName(joined.select("path", "line", text.alias("value")))


def cells(value: Column) -> Column:
    """The cells of a record in which quotation marks stand around whole cells, doubled inside them."""
    plain = F.split(value, ",", -1)
    found = F.regexp_extract_all(F.concat(value, F.lit(",")), F.lit(CELL), F.lit(1))
    bare = F.transform(found, lambda c: F.when(c.startswith('"') & (F.length(c) > 1), F.replace(F.substr(c, F.lit(2), F.length(c) - 2), F.lit('""'), F.lit('"'))).otherwise(c))
    return F.when(F.instr(value, '"') == 0, plain).otherwise(bare)


def decoded(rows: DataFrame) -> DataFrame:
    """(path, line, text, encoding): files that are UTF-8 throughout as they are (the reader drops a mark), all others as cp932.

    The encoding is decided per file from all its records; only records of
    cp932 files pass through Python, and a file that is neither gives no rows.
    """

    @F.pandas_udf("string")
    def cp932(raw: pd.Series) -> pd.Series:
        def one(b):
            try:
                return None if b is None else bytes(b).decode("cp932")
            except UnicodeDecodeError:
                return None
        return raw.map(one)

    kinds = rows.groupBy("path").agg(F.bool_and(F.is_valid_utf8(F.col("value").cast("string"))).alias("_utf8"))
    known = materialise(O.attach(rows, kinds, ["path"]), "records")
    text = F.col("value").cast("string")
    text = F.when((F.col("line") == 1) & text.startswith("\ufeff"), F.substring(text, 2, 1 << 30)).otherwise(text)
    fine = known.where("_utf8").select("path", "line", text.alias("text"), F.lit("utf-8").alias("encoding"))
    other = known.where("not _utf8")
    if other.isEmpty():
        return fine
    other = materialise(other.select("path", "line", cp932("value").alias("text"), F.lit("cp932").alias("encoding")), "decoded")
    wrong = other.where("text IS NULL").select("path").distinct()
    return fine.unionByName(other.join(wrong, "path", "left_anti").select("path", "line", "text", "encoding"))


def parsed(spark: SparkSession, path: str | DataFrame, glob: str = "*.csv") -> tuple[DataFrame, DataFrame]:
    """Rows (path, line, encoding, cells) behind the header of each file, and the headers (path, header) under canonical names."""
    text = decoded(records(numbered(raw_lines(spark, path, glob))))
    rows = materialise(text.select("path", "line", "encoding", cells(F.col("text")).alias("cells")), "cells")
    names = F.create_map(*[F.lit(x) for pair in TX.HEADER_ALIASES.items() for x in pair])
    header = F.transform("cells", lambda c: F.coalesce(names[F.trim(c)], F.trim(c)))
    return rows.where("line > 1"), rows.where("line = 1").select("path", header.alias("header"))


def daily_rows(spark: SparkSession, path: str | DataFrame, required: list[str], columns: list[str], glob: str = "*.csv") -> DataFrame:
    """(path, line, columns): text cells under canonical names; the cells that a short record lacks are null.

    Files without one of the ``required`` columns, empty files and records of
    blank cells alone give no rows. A null path never occurs; a header alone gives none.
    """
    rows, headers = parsed(spark, path, glob)
    good = headers.where(F.size(F.array_except(F.array(*[F.lit(c) for c in required]), "header")) == 0)
    some = F.exists("cells", lambda c: F.trim(c) != "")
    return O.attach(rows.where(some), good, ["path"]).select(
        "path", "line", *[F.get("cells", F.when(F.array_position("header", c) > 0, F.array_position("header", c) - 1).cast("int")).alias(c) for c in columns])


def row_widths(spark: SparkSession, path: str | DataFrame, glob: str = "*.csv") -> DataFrame:
    """Per file: its columns, data records, records with too few or too many cells, blank records and the first wrong line."""
    rows, headers = parsed(spark, path, glob)
    x = O.attach(rows, headers, ["path"]).withColumns({"_w": F.size("cells"), "_h": F.size("header"), "_blank": F.forall("cells", lambda c: F.trim(c) == "")})
    wrong = (F.col("_w") != F.col("_h")) & ~F.col("_blank")
    return x.groupBy("path", "encoding").agg(
        F.max("_h").alias("columns"), F.count(F.lit(1)).alias("records"), F.count_if(wrong & (F.col("_w") < F.col("_h"))).alias("too_few"),
        F.count_if(wrong & (F.col("_w") > F.col("_h"))).alias("too_many"), F.count_if("_blank").alias("blank"), F.min(F.when(wrong, F.col("line"))).alias("first_wrong"))


def header_check(spark: SparkSession, path: str | DataFrame, expected: list[str], glob: str = "*.csv") -> DataFrame:
    """Per file: whether its header holds the expected names in their order, and what is missing or beyond them."""
    _, headers = parsed(spark, path, glob)
    want = F.array(*[F.lit(c) for c in expected])
    return headers.select("path", (F.col("header") == want).alias("equal"), F.array_join(F.array_except(want, "header"), ",").alias("missing"),
                          F.array_join(F.array_except("header", want), ",").alias("surplus"))
