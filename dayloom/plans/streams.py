"""Registered queries: streaming forms (L01-L08), run to completion over the given tables."""

from dayloom import panel as PN
from dayloom.operators import windows as WN
from dayloom.panel import DAY, KEY, PANEL, table
from dayloom.plans import sql as S
from dayloom.plans.common import F, panel
from dayloom.plans.expressions import HOLIDAYS
from dayloom.plans.registry import query
from dayloom.plans.windows import PE
from dayloom.session import scratch_path
from dayloom.sources import files as FI
from dayloom.streaming import jobs as L

P = S.PANEL


def paths(spark, name):
    root = scratch_path(spark, name)
    return f"{root}/in", f"{root}/out", f"{root}/checkpoint"


def event_stream(spark, d):
    schema = table(spark, d, "events").schema
    return L.file_stream(spark, d, schema, "events.parquet").withColumn("ts", F.col("ts").cast("timestamp"))


def closed(spark, d, name, result):
    """The append-mode ``result`` of the events, after a last row that closes all their windows."""
    src, out, ck = paths(spark, name)
    e = table(spark, d, "events")
    stream = lambda: event_stream(spark, d).unionByName(L.file_stream(spark, src, e.schema).withColumn("ts", F.col("ts").cast("timestamp")))
    L.close_windows(e.limit(0), "ts", "1 DAY").write.parquet(src)  # nothing yet
    L.run_to_table(result(stream()), out, ck)
    L.close_windows(e, "ts", "60 DAYS").write.mode("append").parquet(src)
    L.run_to_table(result(stream()), out, ck)
    return spark.read.parquet(out).withColumn("start", F.col("start").cast("timestamp"))


def land(df, folder):
    """Panel rows as landed files, spread by day."""
    df.select(*PANEL.names).write.mode("append").parquet(folder)


@query("L01_ingest_new_days", "day:d n:i total:f", "SELECT day, count(*) n, sum(metric) total FROM panel GROUP BY 1", P)
def _(spark, d):
    src, out, ck = paths(spark, "ingest")
    p = panel(spark, d)
    for cond in ("day < DATE '2024-01-16'", "day >= DATE '2024-01-16'"):  # two scheduled runs, one checkpoint
        land(p.where(cond), src)
        L.run_to_table(L.stream_panel(spark, src), out, ck)
    L.run_to_table(L.stream_panel(spark, src), out, ck)  # nothing new: nothing is added
    return spark.read.parquet(out).groupBy("day").agg(F.count(F.lit(1)).alias("n"), F.sum("metric").alias("total"))


@query("L02_dedupe", "event_type:s n:i total:f", "SELECT event_type, count(*) n, sum(value) total FROM events GROUP BY 1")
def _(spark, d):
    _, out, ck = paths(spark, "dedupe")
    e = event_stream(spark, d)
    twice = e.unionByName(e)
    L.run_to_table(L.stream_dedupe(twice, ["event_id"], "ts", "40 days"), out, ck)
    return spark.read.parquet(out).groupBy("event_type").agg(F.count(F.lit(1)).alias("n"), F.sum("value").alias("total"))


@query("L03_tumbling_day", "start:s event_type:s n:i total:f", """
SELECT strftime(date_trunc('day', ts), '%Y-%m-%d') AS start, event_type, count(*) n, sum(value) total FROM events GROUP BY 1, 2""")
def _(spark, d):
    return closed(spark, d, "tumbling", lambda e: L.stream_windows(e, "ts", "1 day", late="35 days", by=["event_type"])).withColumn("start", F.date_format("start", "yyyy-MM-dd"))


@query("L03_sliding_week", "start:s n:i total:f", """
SELECT strftime(CAST(ts AS DATE) - CAST(k AS INT), '%Y-%m-%d') AS start, count(*) n, sum(value) total
FROM events, (SELECT unnest(range(7)) k) GROUP BY 1""")
def _(spark, d):
    return closed(spark, d, "sliding", lambda e: L.stream_windows(e, "ts", "7 days", "1 day", late="35 days")).withColumn("start", F.date_format("start", "yyyy-MM-dd"))


@query("L04_sessions", "user_id:i start:s n:i", """
SELECT user_id, strftime(min(ts), '%Y-%m-%d %H:%M:%S') AS start, count(*) n FROM (
 SELECT *, sum(brk) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) s FROM (
 SELECT user_id, ts, (lag(ts) OVER (PARTITION BY user_id ORDER BY ts) IS NULL OR
  ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts) >= INTERVAL 12 HOUR)::INT brk FROM events)) GROUP BY user_id, s""")
def _(spark, d):
    return closed(spark, d, "sessions", lambda e: L.stream_sessions(e, "ts", "12 hours", ["user_id"], "35 days")).withColumn("start", F.date_format("start", "yyyy-MM-dd HH:mm:ss"))


@query("L05_epochs", "entity_id:i epoch:i day:d label:s old_label:s", """
SELECT entity_id, epoch, epoch_start AS day, label, old_label FROM epochs""", PE)
def _(spark, d):
    src, out, ck = paths(spark, "epochs")
    p = panel(spark, d)
    for cond in ("day < DATE '2024-01-12'", "day >= DATE '2024-01-12'"):
        land(p.where(cond), src)
        L.run_to_table(L.stream_epochs(L.stream_panel(spark, src)), out, ck)
    return spark.read.parquet(out).where("kind = 'EPOCH'")


INVENTORY = """inv AS (SELECT user_id % 2 AS entity_id, CAST(ts AS DATE) AS day, CASE WHEN count(*) % 2 = 0 THEN 'A' ELSE 'B' END AS label
 FROM events GROUP BY 1, 2),
days AS (SELECT day, lag(day) OVER (ORDER BY day) AS prev FROM (SELECT DISTINCT day FROM inv)),
diff AS (SELECT d.day, coalesce(n.entity_id, o.entity_id) e, coalesce(o.label, '') || '>' || coalesce(n.label, '') c FROM days d
 JOIN (SELECT DISTINCT entity_id FROM inv) i ON true LEFT JOIN inv n ON n.day = d.day AND n.entity_id = i.entity_id
 LEFT JOIN inv o ON o.day = d.prev AND o.entity_id = i.entity_id WHERE n.label IS DISTINCT FROM o.label),
ch AS (SELECT d.day, CASE WHEN coalesce(d.day - d.prev, 0) = 1 THEN coalesce(n, 0) ELSE 0 END changes,
  CASE WHEN coalesce(d.day - d.prev, 0) = 1 THEN s ELSE 'gap:' || d.day END s FROM days d
 LEFT JOIN (SELECT day, count(*) n, string_agg(e || c, ',' ORDER BY e) s FROM diff GROUP BY 1) USING (day)),
open AS (SELECT s, min(day) AS a, min(day) FILTER (day <= (SELECT min(day) + 24 FROM days)) + 1 AS z FROM ch WHERE s IS NOT NULL GROUP BY s)"""


@query("L05_guard", "day:d changes:i status:s", """
SELECT day, changes, CASE WHEN EXISTS (SELECT 1 FROM open WHERE ch.day >= a AND (z IS NULL OR ch.day <= z)) THEN 'MANUAL_REVIEW'
 WHEN EXISTS (SELECT 1 FROM plan WHERE ch.day = s - 1 OR (ch.day >= s AND NOT plain AND ch.day <= s + 1)) THEN 'MANUAL_REVIEW'
 WHEN s IS NOT NULL THEN 'APPROVED' ELSE 'PASS' END status FROM ch""", INVENTORY + """,
plan AS (SELECT d.day AS s, coalesce(d.day - d.prev, 0) = 1 AS plain FROM days d WHERE d.day IN (SELECT min(day) + k FROM days, (SELECT unnest([6, 20]) k) GROUP BY k))""")
def _(spark, d):
    src, out, ck = paths(spark, "guard")
    stock = table(spark, d, "events").groupBy(
        F.lit("main").alias("site"), F.to_date("ts").alias("day"), (F.col("user_id") % 2).alias("entity_id")).agg(
        F.when(F.count(F.lit(1)) % 2 == 0, "A").otherwise("B").alias("label"))
    ch = L.change_signature(stock)
    ch.write.parquet(f"{src}/changes")
    # what changes in the first 25 days is approved a day later, the rest never; two dates are planned from the first day on
    first = ch.agg(F.min("day")).first()[0]
    done = ch.where((F.datediff("day", F.lit(first)) <= 24) & (F.col("signature") != "")).select(
        "site", F.date_add("day", 1).alias("day"), "signature")
    plans = ch.where(F.datediff("day", F.lit(first)).isin(6, 20)).select("site", F.lit(first).alias("day"), F.col("day").alias("scheduled"))
    late = plans.select("site", F.date_add("scheduled", 1).alias("day"), F.concat(F.lit(L.PLANNED), F.col("scheduled").cast("string")).alias("signature"))
    done.unionByName(late).write.parquet(f"{src}/approvals")
    plans.write.parquet(f"{src}/plans")
    schema = spark.read.parquet(f"{src}/changes").schema
    L.run_to_table(L.stream_guard(
        L.file_stream(spark, f"{src}/changes", schema), L.file_stream(spark, f"{src}/approvals", done.schema),
        L.file_stream(spark, f"{src}/plans", plans.schema)), out, ck)
    return spark.read.parquet(out)


@query("L06_lateness", "delay_class:s n:i", """
SELECT CASE WHEN g<=1 THEN 'FORMAL' WHEN g=2 THEN 'PROVISIONAL' WHEN g=3 THEN 'LAG_2' ELSE 'LAG_3_PLUS' END delay_class,
 count(*) n FROM (SELECT event_id % 5 g FROM events) GROUP BY 1""")
def _(spark, d):
    _, out, ck = paths(spark, "late")
    e = event_stream(spark, d).select(F.to_date("ts").alias("event_day"), F.date_add(
        F.to_date("ts"), (F.col("event_id") % 5).cast("int")).alias("processing_day"))
    L.run_to_table(L.lateness(e, "event_day", "processing_day"), out, ck)
    return spark.read.parquet(out).groupBy("delay_class").agg(F.count(F.lit(1)).alias("n"))


@query("L07_score_then_append", "day:d entity_id:i kind:s history_n:i prior_mean:f", """
SELECT day, entity_id, CASE WHEN entity_id % 3 = 0 AND day IN (SELECT max(day) FROM cut) AND EXISTS (SELECT 1 FROM seen s
  WHERE s.entity_id = p.entity_id AND s.day > p.day AND s.day < (SELECT min(z) FROM cut)) THEN 'LATE' ELSE 'ON_TIME' END kind,
 (SELECT count(metric) FROM seen s WHERE s.entity_id = p.entity_id AND s.day < p.day AND s.came <= p.came) history_n,
 (SELECT avg(metric) FROM seen s WHERE s.entity_id = p.entity_id AND s.day < p.day AND s.came <= p.came) prior_mean FROM seen p""",
       S.chain(P, """span AS (SELECT min(day) a, (max(day) - min(day)) // 3 + 1 AS k FROM panel),
cut AS (SELECT a + (k - 3)::INT AS day, a + k::INT AS z FROM span),
seen AS (SELECT entity_id, day, metric, CASE WHEN entity_id % 3 = 0 AND day = (SELECT day FROM cut) THEN 1 ELSE (day - a) // k END AS came FROM panel, span)"""))
def _(spark, d):
    src, out, ck = paths(spark, "growing")
    p = panel(spark, d)
    first, last = p.agg(F.min("day"), F.max("day")).first()
    step = (last - first).days // 3 + 1 if first else 1
    after = F.datediff("day", F.lit(first))
    # three batches, cut from the data's own days; a day of every third entity comes with the second one
    came = F.when((F.col("entity_id") % 3 == 0) & (after == step - 3), 1).otherwise(F.floor(after / step))
    for k in range(3):
        land(p.where(came == k), src)
        L.run_to_table(L.score_history(L.stream_panel(spark, src)), out, ck)
    return spark.read.parquet(out)


@query("L08_enrich", "day:d calendar_class:s island_id:s n:i", """
SELECT day, CASE WHEN isodow(day)>=6 OR day IN (DATE '2024-01-01', DATE '2024-01-08') THEN 'WEEKEND_HOLIDAY' ELSE 'WEEKDAY' END
 calendar_class, island_id, count(*) n FROM panel JOIN layout USING (entity_id) GROUP BY 1, 2, 3""", S.chain(P, S.LAYOUT))
def _(spark, d):
    src, out, ck = paths(spark, "enrich")
    p = panel(spark, d)
    land(p, src)
    holidays = spark.createDataFrame([(h,) for h in HOLIDAYS], "h string").select(F.to_date("h").alias("day"))
    L.run_to_table(L.enrich(L.stream_panel(spark, src), holidays, PN.layout_of(p)), out, ck)
    return spark.read.parquet(out).groupBy("day", "calendar_class", "island_id").agg(F.count(F.lit(1)).alias("n"))
