"""Registered queries: scans, sources and sinks (A01-A18). Files are written from the given tables first."""

from dayloom.functions import text as TX
from dayloom.operators import quality as Q
from dayloom.panel import DAY, KEY, SITE, panel_from_events, second_source, table
from dayloom.plans import sql as S
from dayloom.plans.common import A, F, panel
from dayloom.plans.registry import query
from dayloom.session import scratch_path
from dayloom.sources import files as FI
from dayloom.sources import html as H

P = S.PANEL
COLS = ["day", "entity_id", "label", "activity", "metric", "c1", "c2"]
ROW_SPEC = "day:d entity_id:i label:s activity:f metric:f c1:i c2:i"


def sites(spark, d):
    """The panel of four sites: users belong to site S0..S3."""
    return panel_from_events(table(spark, d, "events"), F.concat(F.lit("S"), (F.col("user_id") % 4).cast("string")))


def daily_files(spark, d):
    """Daily CSV folders of the four sites, written under the native header spellings."""
    path = scratch_path(spark, "daily")
    native = sites(spark, d).withColumn("file_day", F.col("day")).select(
        "site", "file_day", F.col("day").alias("日付"), F.col("entity_id").alias("台番号"),
        F.col("label").alias("機種名"), F.col("activity").alias("G数"), F.col("metric").alias("差枚"),
        F.col("c1").alias("BB"), F.col("c2").alias("RB"))
    native.repartition("site", "file_day").write.partitionBy("site", "file_day").option("header", True).csv(path)
    return path


@query("A01_read_panel", f"site:s {ROW_SPEC}", "SELECT 'S' || entity_id % 4 AS site, * FROM panel", P)
def _(spark, d):
    return FI.read_panel(spark, daily_files(spark, d))


@query("A02_encodings", "encoding:s rows:i total:f", """
SELECT ['utf-8','utf-8-sig','cp932'][1 + (entity_id // 64) % 3] AS encoding, count(*) AS rows, sum(metric) total FROM panel
GROUP BY 1""", P)
def _(spark, d):
    import pandas as pd
    from pyspark.sql import types as T

    @F.pandas_udf(T.BinaryType())
    def encode(s: pd.Series, enc: pd.Series) -> pd.Series:
        return pd.Series([v.encode(e) for v, e in zip(s, enc)])

    # one file per (day, block of 64 ids), in one of three encodings
    e = F.col("entity_id")
    block = F.floor(e / 64)
    enc = F.element_at(F.array(F.lit("utf-8"), F.lit("utf-8-sig"), F.lit("cp932")), (block % 3 + 1).cast("int"))
    line = F.concat_ws(",", e.cast("string"), F.concat(F.lit("機種"), "label"), F.col("day").cast("string"),
                       F.format_string("%.2f", "metric"))
    docs = panel(spark, d).groupBy("day", block.alias("b"), enc.alias("enc")).agg(
        F.concat_ws("\n", F.lit("台番号,機種名,日付,差枚"), F.collect_list(line)).alias("t"))
    files = docs.select(F.concat_ws("/", "enc", F.col("day").cast("string"), F.col("b").cast("string")).alias("path"),
                        encode("t", "enc").alias("content"))
    rows = FI.to_panel(FI.parse_daily(files), F.split("path", "/")[0])
    return rows.where(F.startswith("label", F.lit("機種"))).groupBy(F.col("site").alias("encoding")).agg(
        F.count(F.lit(1)).alias("rows"), F.sum("metric").alias("total"))


@query("A03_resolve_columns", "day:d entity_id:i metric:f", """
SELECT CAST(l_shipdate AS DATE) AS day, l_suppkey entity_id, l_extendedprice metric FROM lineitem""")
def _(spark, d):
    return FI.resolve_columns(table(spark, d, "lineitem"), {
        "day": ["日付", "date", "l_shipdate"], "entity_id": ["台番号", "l_suppkey"], "metric": ["差枚", "diff", "l_extendedprice"]})


@query("A04_file_day", "site:s file_day:d rows:i mismatched:i", """
SELECT 'S' || entity_id % 4 AS site, day AS file_day, count(*) AS rows, 0 mismatched FROM panel GROUP BY 1, 2""", P)
def _(spark, d):
    rows = FI.read_daily_files(spark, daily_files(spark, d))
    x = FI.check_file_day(rows).withColumn("site", F.regexp_extract("path", "site=([^/]+)", 1))
    return x.groupBy("site", "file_day").agg(F.sum("rows").alias("rows"), F.sum("mismatched").alias("mismatched"))


@query("A05_as_of", "day:d entity_id:i metric:f", "SELECT * FROM panel WHERE day<=DATE '2024-01-12'", P)
def _(spark, d):
    path = scratch_path(spark, "asof")
    FI.write_partitioned(panel(spark, d), path)
    return FI.as_of(spark.read.parquet(path), "2024-01-12")


@query("A06_integrate", f"{ROW_SPEC} weekday:i", "SELECT *, isodow(day)-1 weekday FROM panel", P)
def _(spark, d):
    return FI.integrate(panel(spark, d))


@query("A07_read_site", ROW_SPEC, "SELECT * FROM panel WHERE entity_id % 4 = 2", P)
def _(spark, d):
    return FI.read_panel(spark, daily_files(spark, d), site="S2")


@query("A08_extract_links", "page_id:i position:i href:s text:s", """
SELECT page_id, p AS position, h[p+1] href, t[p+1] AS text FROM (
 SELECT page_id, h, t, unnest(range(len(h))) p FROM (SELECT page_id,
  regexp_extract_all(html, '<li><a href="([^"]*)">([^<]*)</a></li>', 1) h,
  regexp_extract_all(html, '<li><a href="([^"]*)">([^<]*)</a></li>', 2) t FROM pages))""")
def _(spark, d):
    return H.extract_links(table(spark, d, "pages").select("page_id", "html"))


def day_pages(spark, d):
    """HTML pages of the panel."""
    # one page per (day, block of 64 ids): a small decoy table and the data table, column order by day
    e = F.col("entity_id")
    cells = lambda *c: F.concat(F.lit("<tr>"), *[F.concat(F.lit("<td>"), x, F.lit("</td>")) for x in c], F.lit("</tr>"))
    day, num, val = F.col("day").cast("string"), e.cast("string"), F.format_string("%,.2f", "metric")
    odd = F.dayofmonth("day") % 2 == 1
    body = F.when(odd, cells(day, num, F.col("label"), val)).otherwise(cells(num, val, day, F.col("label")))
    head = F.when(odd, "<th>日付</th><th>台番号</th><th>機種名</th><th>差枚</th>").otherwise(
        "<th>台番号</th><th>差枚</th><th>日付</th><th>機種名</th>")
    docs = panel(spark, d).groupBy("day", F.floor(e / 64).alias("b")).agg(
        F.first(head).alias("h"), F.concat_ws("", F.collect_list(body)).alias("t"))
    pages = docs.select(F.xxhash64("day", "b").alias("page_id"), F.concat(
        F.lit("<html><body><table><tr><th>menu</th></tr><tr><td>x</td></tr></table><table><tr>"), "h", F.lit("</tr>"),
        "t", F.lit("</table></body></html>")).alias("html"))
    return pages


@query("A08_extract_tables", "day:d entity_id:i label:s metric:f", "SELECT * FROM panel", P)
def _(spark, d):
    text = H.table_to_text_rows(H.extract_tables(day_pages(spark, d)), ["day", "entity_id", "label", "metric"])
    return text.select(TX.to_day(F.col("day")).alias("day"), TX.to_int0(F.col("entity_id")).alias("entity_id"), "label",
                       TX.to_number(F.col("metric")).alias("metric"))


@query("A09_extract_title", "page_id:i title:s", """
SELECT page_id, regexp_extract(html, '(?s)<title>(.*?)</title>', 1) title FROM pages""")
def _(spark, d):
    return H.extract_title(table(spark, d, "pages"))


@query("A09_check_title_day", "day:d title_day:d title_ok:b", """
SELECT day, CASE WHEN day(day) % 3 = 0 THEN NULL ELSE day END title_day, day(day) % 3 <> 0 title_ok
FROM (SELECT DISTINCT day FROM panel)""", P)
def _(spark, d):
    days = panel(spark, d).select("day").distinct()
    title = F.when(F.dayofmonth("day") % 3 == 0, "no date").otherwise(F.date_format("day", "yyyy/M/d"))
    page = F.concat(F.lit("<html><title>Hall report "), title, F.lit(" all</title></html>"))
    return H.check_title_day(days.withColumn("html", page), "day")


@query("A10_extract_pattern", "page_id:i position:i code:s", """
SELECT page_id, p AS position, c[p+1] code FROM (SELECT page_id, c, unnest(range(len(c))) p FROM (
 SELECT page_id, regexp_extract_all(html, 'track\\(([0-9]+)\\)', 1) c FROM pages))""")
def _(spark, d):
    return H.extract_pattern(table(spark, d, "pages").select("page_id", "html"), r"track\(([0-9]+)\)", ["code"])


@query("A11_tag_census", "signature:s pages:i", """
SELECT 'li=' || len(regexp_extract_all(html, '<(li)[ >]', 1)) || ',h1=' || len(regexp_extract_all(html, '<(h1)[ >]', 1)) ||
 ',table=' || len(regexp_extract_all(html, '<(table)[ >]', 1)) AS signature, count(*) pages FROM pages GROUP BY 1""")
def _(spark, d):
    return H.tag_census(table(spark, d, "pages"), ["li", "h1", "table"])


@query("A11_header_census", "headers:s tables:i pages:i", """
SELECT CASE WHEN day(day) % 2 = 1 THEN 'day,entity_id,label,metric' ELSE 'entity_id,metric,day,label' END headers,
 count(DISTINCT (day, entity_id // 64)) AS tables, count(DISTINCT (day, entity_id // 64)) pages FROM panel GROUP BY 1""", P)
def _(spark, d):
    return H.header_census(H.extract_tables(day_pages(spark, d)))


@query("A11_tables_per_entity", "tables:i entities:i",
       "SELECT n AS tables, count(*) entities FROM (SELECT entity_id, count(*) n FROM panel GROUP BY 1) GROUP BY 1", P)
def _(spark, d):
    return H.tables_per_entity(H.extract_tables(day_pages(spark, d)))


@query("A12_write_partitioned", "day:d n:i total:f", "SELECT day, count(*) n, sum(metric) total FROM panel GROUP BY 1", P)
def _(spark, d):
    path = scratch_path(spark, "panel")
    p = panel(spark, d)
    FI.write_partitioned(p, path)
    FI.write_partitioned(p.where("day >= DATE '2024-01-20'"), path)  # a rerun of late days replaces, not doubles
    return spark.read.parquet(path).groupBy("day").agg(F.count(F.lit(1)).alias("n"), F.sum("metric").alias("total"))


@query("A13_write_report", "sheet:s rows:i", """
SELECT 'all' sheet, count(*) AS rows FROM panel UNION ALL SELECT 'by_day', count(DISTINCT day) FROM panel UNION ALL
SELECT 'by_label', count(DISTINCT label) FROM panel""", P)
def _(spark, d):
    path, p = scratch_path(spark, "report"), panel(spark, d)
    FI.write_report({"all": p, "by_day": A.by_day(p), "by_label": A.by_label(p)}, path)
    one = lambda n: spark.read.parquet(f"{path}/{n}").agg(F.count(F.lit(1)).alias("rows")).withColumn("sheet", F.lit(n))
    return one("all").unionByName(one("by_day")).unionByName(one("by_label"))


_text = ("concat_ws('|', CAST(day AS VARCHAR), CAST(entity_id AS VARCHAR), label, printf('%.9f', metric + 0::DOUBLE))")
_words = " || '|' || ".join(
    f"CAST(sum(CAST(('0x' || substr(h, {1 + 8 * i}, 8)) AS BIGINT)) AS VARCHAR)" for i in range(8))
FP = f"fp AS (SELECT *, sha256({_text}) h FROM panel)"
FCOLS = ["day", "entity_id", "label", "metric"]


@query("A14_freeze", "name:s rows:i fingerprint:s", f"""
SELECT 'actual' AS name, count(*) AS rows, sha256(count(*) || '|' || {_words}) fingerprint FROM fp""", S.chain(P, FP))
def _(spark, d):
    return FI.freeze({"actual": panel(spark, d)}, scratch_path(spark, "frozen"), {"actual": FCOLS})


@query("A15_row_hash", "day:d entity_id:i digest:s", "SELECT day, entity_id, h digest FROM fp", S.chain(P, FP))
def _(spark, d):
    return FI.row_hash(panel(spark, d), FCOLS)


@query("A15_fingerprint", "day:d rows:i fingerprint:s", f"""
SELECT day, count(*) AS rows, sha256(count(*) || '|' || {_words}) fingerprint FROM fp GROUP BY 1""", S.chain(P, FP))
def _(spark, d):
    return FI.fingerprint(panel(spark, d), FCOLS, DAY)


@query("A16_verify_manifest", "day:d state:s", """
SELECT day, CASE WHEN day=DATE '2024-01-05' THEN 'UNLISTED' WHEN day=DATE '2024-01-09' THEN 'MISSING'
 WHEN count(*) FILTER (entity_id%13=0 AND day>DATE '2024-01-20')>0 THEN 'CHANGED' ELSE 'MATCH' END state FROM panel GROUP BY 1""", P)
def _(spark, d):
    p = panel(spark, d)
    manifest = FI.fingerprint(p.where("day <> DATE '2024-01-05'"), FCOLS, DAY)
    later = p.where("day <> DATE '2024-01-09'").withColumn("metric", F.when(
        (F.col("entity_id") % 13 == 0) & (F.col("day") > F.lit("2024-01-20").cast("date")), F.col("metric") + 1
    ).otherwise(F.col("metric")))
    return FI.verify_manifest(later, manifest, FCOLS, DAY)


@query("A17_upsert_replace", "day:d entity_id:i metric:f", """
SELECT day, entity_id, CASE WHEN day>=DATE '2024-01-25' AND entity_id%13=0 AND entity_id%17<>0 THEN metric+1 ELSE metric END metric
FROM panel""", P)
def _(spark, d):
    p = panel(spark, d)
    return FI.upsert(p, second_source(p).where("day >= DATE '2024-01-25'"), KEY, replace=True)


@query("A17_upsert_append", "day:d entity_id:i metric:f", "SELECT day, entity_id, metric FROM panel", P)
def _(spark, d):
    p = panel(spark, d)
    return FI.upsert(p.where("day < DATE '2024-01-25'"), p.where("day >= DATE '2024-01-25'"), KEY)


@query("A18_registry", "reasons:s n:i", """
SELECT concat_ws('; ', CASE WHEN event_type='error' THEN 'STATUS' END, CASE WHEN k > 90 THEN 'CATEGORY' END,
 CASE WHEN k % 10 = 0 THEN 'SHA256' END) reasons, count(*) n
FROM (SELECT event_type, CAST(regexp_extract(props, '([0-9]+)', 1) AS INT) k FROM events) GROUP BY 1""")
def _(spark, d):
    # a registry document per event, written as JSON and read back with its schema
    k = F.from_json("props", "k int")["k"]
    e = table(spark, d, "events")
    entry = F.struct(
        F.when(F.col("event_type") == "error", "CLOSED").otherwise("ACTIVE").alias("status"),
        F.col("event_id").cast("string").alias("store"), F.to_date("ts").cast("string").alias("target_date"),
        F.when(k > 90, "OTHER").otherwise("LISTED").alias("category"),
        F.when(k % 10 == 0, "bad").otherwise(F.sha2(F.col("event_id").cast("string"), 256)).alias("prediction_sha256"))
    path = scratch_path(spark, "registry")
    e.select(F.lit(1).alias("schema_version"), F.array(entry).alias("entries")).write.json(path)
    docs = spark.read.schema(FI.REGISTRY).json(path).select(F.explode("entries").alias("e")).select("e.*")
    return FI.validate_registry(docs, ["LISTED"]).groupBy("reasons").agg(F.count(F.lit(1)).alias("n"))
