"""Daily files, registries and snapshots: reading, cleaning, writing once, checking."""

from __future__ import annotations

import csv
import io
from collections.abc import Iterator, Mapping, Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from dayloom.functions import text as TX
from dayloom.operators import quality as Q
from dayloom.panel import DAY, KEY, PANEL
from dayloom.sources import splits as SP

REQUIRED = ("day", "entity_id", "label", "metric")
DECODERS = ("utf-8-sig", "utf-8", "cp932")


def resolve_columns(df: DataFrame, aliases: Mapping[str, Sequence[str]]) -> DataFrame:
    """Canonical columns from the first spelling present; missing ones fail by name."""
    picked, missing = [], []
    for name, spellings in aliases.items():
        hit = next((s for s in spellings if s in df.columns), None)
        if hit is None:
            missing.append(name)
        else:
            picked.append(F.col(f"`{hit}`").alias(name))
    if missing:
        raise Q.QualityError(f"missing columns: {missing}")
    return df.select(*picked)


def decode_text(raw: bytes) -> str | None:
    for enc in DECODERS:
        try:
            return raw.decode(enc)
        except UnicodeDecodeError:
            continue
    return None


ROWS = "path string, line bigint, day string, entity_id string, label string, activity string, metric string, c1 string, c2 string"


def parse_daily(files: DataFrame) -> DataFrame:
    """Rows of small daily CSV documents that stand in a column (path, content), under canonical text columns.

    Each file is decoded with the first encoding that fits and its own header
    decides the column order. Files that are empty or lack a required header
    give no rows. Spark spreads the files; a task holds one file at a time.
    """
    names = [f.split()[0] for f in ROWS.split(", ")]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for path, content in zip(pdf["path"], pdf["content"]):
                text = decode_text(bytes(content)) if content is not None else None
                reader = csv.reader(io.StringIO(text or ""))
                header = [TX.HEADER_ALIASES.get(h.strip(), h.strip()) for h in next(reader, [])]
                if not set(REQUIRED) <= set(header):
                    continue
                at = {n: header.index(n) for n in names[2:] if n in header}
                rows = [[path, i, *[r[at[n]] if n in at and at[n] < len(r) else None for n in names[2:]]]
                        for i, r in enumerate(reader, start=2) if any(c.strip() for c in r)]
                if rows:
                    yield pd.DataFrame(rows, columns=names)

    return files.select("path", "content").mapInPandas(run, ROWS)


def read_daily_files(spark: SparkSession, path: str, glob: str = "*.csv") -> DataFrame:
    """Rows of all daily files below a folder; files are read by splits, so one of any size is read by several tasks."""
    return SP.daily_rows(spark, path, list(REQUIRED), [f.split()[0] for f in ROWS.split(", ")][2:], glob)


UNIQUE = r"[0-9a-f]{8}-?[0-9a-f]{4}-?[0-9a-f]{4}-?[0-9a-f]{4}-?[0-9a-f]{12}"  # generated parts of file and folder names


def file_day(path: Column) -> Column:
    """Date in a file path: yyyy-mm-dd or yyyymmdd, the last one; digits of longer numbers and of generated names are none."""
    named = F.regexp_replace(path, UNIQUE, "")
    return TX.to_day(F.regexp_extract(named, r"(?s).*(?<!\d)(20\d{2}-\d{2}-\d{2}|20\d{6})(?!\d)", 1))


def with_file_day(rows: DataFrame) -> DataFrame:
    return rows.withColumn("file_day", file_day(F.col("path")))


def check_file_day(rows: DataFrame) -> DataFrame:
    """Per file: rows whose own date differs from the file's."""
    x = with_file_day(rows).withColumn("_bad", ~F.coalesce(TX.to_day(F.col("day")) == F.col("file_day"), F.lit(False)))
    return x.groupBy("path", "file_day").agg(F.count(F.lit(1)).alias("rows"), F.count_if("_bad").alias("mismatched"))


def to_panel(rows: DataFrame, site: Column | str, zero_on_error: bool = False) -> DataFrame:
    """Typed panel rows; numbers are null (or 0) where the text cannot be read."""
    site = F.lit(site) if isinstance(site, str) else site
    num = (lambda c: TX.to_int0(F.col(c)).cast("double")) if zero_on_error else (lambda c: TX.to_number(F.col(c)))
    return rows.select(
        site.alias("site"), TX.to_day(F.col("day")).alias("day"), TX.to_int0(F.col("entity_id")).alias("entity_id"),
        F.trim("label").alias("label"), num("activity").alias("activity"), num("metric").alias("metric"),
        TX.to_int0(F.col("c1")).alias("c1"), TX.to_int0(F.col("c2")).alias("c2"))


def read_panel(spark: SparkSession, path: str, site: str | None = None) -> DataFrame:
    """All daily files below a folder; the site comes from a ``site=`` folder or is given."""
    rows = read_daily_files(spark, f"{path}/site={site}" if site else path)
    from_path = F.regexp_extract("path", r"site=([^/]+)", 1)
    return to_panel(rows, from_path)


def as_of(df: DataFrame, cutoff: str) -> DataFrame:
    """Days up to the cutoff; on a table partitioned by day later folders are not opened."""
    return df.where(F.col("day") <= F.lit(cutoff).cast("date"))


def integrate(df: DataFrame) -> DataFrame:
    return df.withColumn("weekday", F.weekday("day")).sortWithinPartitions(*KEY)


def write_partitioned(df: DataFrame, path: str, by: Sequence[str] = ("site", "day")) -> None:
    """One folder per site and day; a rerun replaces only the days it carries.

    Rows are clustered by the folder keys plus a hashed part, so a day is
    written by several tasks without every task opening every folder.
    """
    spread = df.repartition(*by, F.pmod(F.hash("entity_id"), F.lit(8)))
    spread.write.partitionBy(*by).mode("overwrite").option("partitionOverwriteMode", "dynamic").parquet(path)


def write_report(sheets: Mapping[str, DataFrame], path: str) -> None:
    """Named result tables side by side."""
    for name, df in sheets.items():
        df.write.mode("overwrite").parquet(f"{path}/{name}")


# ---- fingerprints, manifests, snapshots ------------------------------------------

def row_text(df: DataFrame, cols: Sequence[str]) -> Column:
    """Row as text; doubles with nine decimals, and zero without a sign: it is left by the order of a sum."""
    kinds = dict(df.dtypes)
    parts = [F.format_string("%.9f", F.col(c) + F.lit(0.0)) if kinds[c] in ("double", "float") else F.col(c).cast("string")
             for c in cols]
    return F.concat_ws("|", *[F.coalesce(p, F.lit("")) for p in parts])


def row_hash(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    return df.withColumn("digest", F.sha2(row_text(df, cols), 256))


def fingerprint(df: DataFrame, cols: Sequence[str], by: Sequence[str] = ()) -> DataFrame:
    """One digest per group that does not depend on row order or partitioning.

    The row hashes are summed word by word (an incremental multiset hash), so
    the work is a map-side combined aggregate and no list of hashes is built.
    """
    h = row_hash(df, cols)
    words = [F.sum(F.conv(F.substring("digest", 1 + 8 * i, 8), 16, 10).cast("decimal(20,0)")) for i in range(8)]
    agg = [F.count(F.lit(1)).alias("rows"), F.concat_ws("|", F.count(F.lit(1)).cast("string"), *[
        w.cast("decimal(38,0)").cast("string") for w in words]).alias("_w")]
    g = h.groupBy(*by).agg(*agg) if by else h.agg(*agg)
    return g.withColumn("fingerprint", F.sha2("_w", 256)).drop("_w")


def verify_manifest(df: DataFrame, manifest: DataFrame, cols: Sequence[str], by: Sequence[str]) -> DataFrame:
    """Recomputed digests beside the manifest's: MATCH, CHANGED, MISSING or UNLISTED."""
    now = fingerprint(df, cols, by).select(*by, F.col("fingerprint").alias("_now"))
    was = manifest.select(*by, F.col("fingerprint").alias("_was"))
    return was.join(now, list(by), "full_outer").withColumn("state", F.when(F.col("_now").isNull(), "MISSING").when(
        F.col("_was").isNull(), "UNLISTED").when(F.col("_now") == F.col("_was"), "MATCH").otherwise("CHANGED"))


def freeze(tables: Mapping[str, DataFrame], path: str, cols: Mapping[str, Sequence[str]]) -> DataFrame:
    """Write a set of tables once. Refuses an existing folder; the manifest is written last.

    A reader takes the set as complete only if the manifest is there, so a
    failed run leaves nothing that counts.
    """
    spark = next(iter(tables.values())).sparkSession
    manifest = None
    for name, df in tables.items():
        df.write.mode("errorifexists").parquet(f"{path}/{name}")
        back = spark.read.schema(df.schema).parquet(f"{path}/{name}")
        row = fingerprint(back, cols[name]).select(F.lit(name).alias("name"), "rows", "fingerprint")
        manifest = row if manifest is None else manifest.unionByName(row)
    manifest.write.mode("errorifexists").parquet(f"{path}/_manifest_table")
    return spark.read.parquet(f"{path}/_manifest_table")


def upsert(base: DataFrame, new: DataFrame, key: Sequence[str] = KEY, replace: bool = False) -> DataFrame:
    """Append rows; a key that is already there fails the job, or is replaced when asked."""
    if replace:
        return base.join(new.select(*key), list(key), "left_anti").unionByName(new)
    seen = base.select(*key).withColumn("_dup", F.lit(True))
    checked = new.join(seen, list(key), "left")
    ok = F.when(F.col("_dup").isNull(), True).otherwise(F.raise_error(F.concat(
        F.lit("duplicate key "), F.to_json(F.struct(*key)))).cast("boolean"))
    return base.unionByName(checked.where(ok).drop("_dup"))


REGISTRY = T.StructType([
    T.StructField("schema_version", T.IntegerType()),
    T.StructField("entries", T.ArrayType(T.StructType([
        T.StructField(n, T.StringType()) for n in (
            "status", "store", "target_date", "category", "prediction_sha256", "reason_code", "created_at")]))),
])


def validate_registry(entries: DataFrame, categories: Sequence[str]) -> DataFrame:
    """Reasons why an entry is not usable; empty means valid. Repeated keys count as defects."""
    key = ["store", "target_date", "category"]
    copies = entries.groupBy(*key).agg(F.count(F.lit(1)).alias("_copies"))
    x = entries.join(copies, key, "left")
    return Q.reject_reasons(x, [
        (~F.coalesce(F.col("status") == "ACTIVE", F.lit(False)), "STATUS"),
        (F.coalesce(F.trim("store"), F.lit("")) == "", "STORE"),
        (TX.to_day(F.col("target_date")).isNull(), "TARGET_DATE"),
        (~F.coalesce(F.col("category").isin(*categories), F.lit(False)), "CATEGORY"),
        (~F.coalesce(F.lower("prediction_sha256").rlike("^[0-9a-f]{64}$"), F.lit(False)), "SHA256"),
        (F.coalesce(F.col("_copies"), F.lit(1)) > 1, "DUPLICATE")]).drop("_copies")


def read_registry(spark: SparkSession, path: str, categories: Sequence[str], version: int = 1) -> DataFrame:
    """Entries of JSON registry files with their reject reasons; another schema version fails the job."""
    docs = spark.read.schema(REGISTRY).json(path, multiLine=True)
    ok = F.when(F.col("schema_version") == version, True).otherwise(
        F.raise_error(F.lit("registry schema version")).cast("boolean"))
    return validate_registry(docs.where(ok).select(F.explode("entries").alias("e")).select("e.*"), categories)
