"""Registered queries: cleaning and feature expressions."""

from pyspark.sql import Window

from dayloom.functions import expr as X
from dayloom.functions import text as TX
from dayloom.operators import quality as Q
from dayloom.operators import windows as WN
from dayloom.panel import DAY, table
from dayloom.plans import sql as S
from dayloom.plans.common import F, panel
from dayloom.plans.registry import query

P = S.PANEL

# Dirty text derived from the orders table: thousands separators, plus signs, junk, blanks.
DIRTY = """dirty AS (SELECT o_orderkey AS k,
  CASE WHEN o_orderkey % 7 = 0 THEN 'n/a ' || o_orderkey
       WHEN o_orderkey % 5 = 0 THEN '+' || o_orderkey
       WHEN o_orderkey % 3 = 0 THEN ' -' || o_custkey || ',' || lpad(CAST(o_orderkey % 1000 AS VARCHAR), 3, '0')
       WHEN o_orderkey % 11 = 0 THEN ''
       ELSE CAST(o_orderkey AS VARCHAR) || '.5' END AS t FROM orders)"""


def dirty(spark, d):
    k = F.col("o_orderkey")
    s = k.cast("string")
    t = (
        F.when(k % 7 == 0, F.concat(F.lit("n/a "), s)).when(k % 5 == 0, F.concat(F.lit("+"), s))
        .when(k % 3 == 0, F.concat(F.lit(" -"), F.col("o_custkey").cast("string"), F.lit(","),
                                   F.lpad((k % 1000).cast("string"), 3, "0")))
        .when(k % 11 == 0, "").otherwise(F.concat(s, F.lit(".5")))
    )
    return table(spark, d, "orders").select(k.alias("k"), t.alias("t"))


@query("B01_to_int0", "k:i v:i", """SELECT k, CASE WHEN contains(t, '.') THEN 0
  ELSE coalesce(TRY_CAST(replace(replace(trim(t), ',', ''), '+', '') AS BIGINT), 0) END v FROM dirty""", DIRTY)
def _(spark, d):
    clean = TX.to_int0(F.col("t"))
    return dirty(spark, d).select("k", F.when(F.contains("t", F.lit(".")), 0).otherwise(clean).alias("v"))


@query("B02_to_number", "k:i v:f", """SELECT k, TRY_CAST(regexp_extract(
  replace(replace(t, ',', ''), '+', ''), '-?[0-9]+(\\.[0-9]+)?', 0) AS DOUBLE) v FROM dirty""", DIRTY)
def _(spark, d):
    return dirty(spark, d).select("k", TX.to_number(F.col("t")).alias("v"))


@query("B03_to_percent", "doc_id:i v:f", """SELECT doc_id, CASE WHEN n_chars % 3 = 0 THEN NULL
  ELSE CAST(n_chars // 10 || '.' || n_chars % 10 AS DOUBLE) END v FROM documents""")
def _(spark, d):
    n = F.col("n_chars")
    body = F.concat((n / 10).cast("bigint").cast("string"), F.lit("."), (n % 10).cast("string"))
    text = F.when(n % 3 == 0, "no rate").otherwise(F.concat(F.lit("rate: "), body, F.lit(" %")))
    return table(spark, d, "documents").select("doc_id", TX.to_percent(text).alias("v"))


@query("B04_to_ratio", "day:d wins:i total:i pct:f", """
SELECT day, count(*) FILTER (metric>0) wins, count(*) total, 100.0*count(*) FILTER (metric>0)/count(*) pct
FROM panel GROUP BY 1""", P)
def _(spark, d):
    cell = F.concat(F.lit("勝率 "), F.count_if(F.col("metric") > 0).cast("string"), F.lit("/"),
                    F.count(F.lit(1)).cast("string"))
    return panel(spark, d).groupBy(*DAY).agg(cell.alias("cell")).select(
        "day", TX.to_ratio(F.col("cell")).alias("r")).select("day", "r.*")


@query("B05_to_day", "o_orderkey:i v:d", """SELECT o_orderkey, CASE WHEN o_orderkey % 5 = 4 THEN NULL
  ELSE CAST(o_orderdate AS DATE) END v FROM orders""")
def _(spark, d):
    k, day = F.col("o_orderkey") % 5, F.to_date("o_orderdate")
    text = F.when(k == 4, "not a date")
    for i, fmt in enumerate(TX.DAY_FORMATS):
        text = text.when(k == i, F.date_format(day, fmt))
    return table(spark, d, "orders").select("o_orderkey", TX.to_day(text).alias("v"))


@query("B06_weekday", "day:d weekday:i weekday_name:s", """SELECT DISTINCT day, isodow(day)-1 weekday,
  list_extract(['月','火','水','木','金','土','日'], isodow(day)) weekday_name FROM panel""", P)
def _(spark, d):
    day = F.col("day")
    return panel(spark, d).select("day").distinct().select(
        "day", X.weekday_no(day).alias("weekday"), X.weekday_name(day).alias("weekday_name"))


HOLIDAYS = ["2024-01-01", "2024-01-08"]  # fixed values: public holidays inside the test month


@query("B07_calendar_class", "day:d n:i calendar_class:s", """SELECT day, count(*) n,
  CASE WHEN isodow(day)>=6 OR day IN (DATE '2024-01-01', DATE '2024-01-08') THEN 'WEEKEND_HOLIDAY' ELSE 'WEEKDAY' END
  calendar_class FROM panel GROUP BY 1""", P)
def _(spark, d):
    holidays = spark.createDataFrame([(h,) for h in HOLIDAYS], "h string").select(F.to_date("h").alias("day"))
    return WN.calendar_class(panel(spark, d), holidays).groupBy("day", "calendar_class").agg(
        F.count(F.lit(1)).alias("n"))


@query("B08_norm_label_ascii", "p_partkey:i v:s", """SELECT p_partkey, CASE WHEN starts_with(n, 'small')
  THEN substr(n, 6) ELSE n END v FROM (SELECT p_partkey, lower(regexp_replace(p_type || ' ' || p_name, '\\s+', '', 'g'))
  n FROM part)""")
def _(spark, d):
    text = F.concat_ws(" ", "p_type", "p_name")
    return table(spark, d, "part").select("p_partkey", TX.norm_label_ascii(text, ["small"]).alias("v"))


WIDE = "".join(chr(c + 0xFEE0) for c in range(0x21, 0x7F))  # the full-width forms of printable ASCII
ASCII = "".join(chr(c) for c in range(0x21, 0x7F))


@query("B08_norm_label_nfkc", "doc_id:i v:s",
       r"SELECT doc_id, lower(regexp_replace(text, '\s+', '', 'g')) v FROM documents".replace(r"\\s", r"\s"))
def _(spark, d):
    wide = F.translate("text", ASCII, WIDE)  # folded back by the compatibility form
    return table(spark, d, "documents").select("doc_id", TX.norm_label(wide).alias("v"))


@query("B09_canonical_header", "header:s v:s n:i", """
SELECT header, CASE header WHEN 'machine_name' THEN 'label' WHEN '差枚' THEN 'metric' WHEN 'BB' THEN 'c1'
  ELSE header END v, count(*) n
FROM (SELECT CASE event_type WHEN 'click' THEN 'machine_name' WHEN 'error' THEN '差枚' WHEN 'view' THEN 'BB'
  ELSE event_type END header FROM events) GROUP BY 1, 2""")
def _(spark, d):
    h = (F.when(F.col("event_type") == "click", "machine_name").when(F.col("event_type") == "error", "差枚")
         .when(F.col("event_type") == "view", "BB").otherwise(F.col("event_type")))
    return table(spark, d, "events").select(h.alias("header")).withColumn(
        "v", TX.canonical_header(F.col("header"))).groupBy("header", "v").agg(F.count(F.lit(1)).alias("n"))


@query("B10_flags", "day:d entity_id:i win:i plus_50:i minus_50:i plus_100:i minus_100:i", """
SELECT day, entity_id, (metric>0)::INT win, (metric>=50)::INT plus_50, (metric<=-50)::INT minus_50,
 (metric>=100)::INT plus_100, (metric<=-100)::INT minus_100 FROM panel""", P)
def _(spark, d):
    return panel(spark, d).withColumns(X.flag_columns(F.col("metric"), [50, 100]))


@query("B11_grade", "entity_id:i mean:f grade:s", """SELECT entity_id, avg(metric) mean,
 CASE WHEN avg(metric)>=20 THEN 'S' WHEN avg(metric)>=0 THEN 'A' WHEN avg(metric)>=-20 THEN 'B'
  WHEN avg(metric)>=-40 THEN 'C' WHEN avg(metric)>=-60 THEN 'D' ELSE 'E' END grade FROM panel GROUP BY 1""", P)
def _(spark, d):
    return panel(spark, d).groupBy("site", "entity_id").agg(F.avg("metric").alias("mean")).withColumn(
        "grade", X.grade(F.col("mean"), [20, 0, -20, -40, -60], list("SABCDE")))


@query("B12_step", "day:d entity_id:i reliability:f edge:f", """SELECT day, entity_id,
 CASE WHEN activity>=8 THEN 1.0 WHEN activity>=4 THEN 0.8 WHEN activity>=2 THEN 0.5 ELSE 0.3 END reliability,
 CASE WHEN entity_id%10<=0 THEN 1.0 WHEN entity_id%10<=1 THEN 0.75 WHEN entity_id%10<=2 THEN 0.5
  WHEN entity_id%10<=4 THEN 0.25 ELSE 0.0 END edge FROM panel""", P)
def _(spark, d):
    return panel(spark, d).withColumns({
        "reliability": X.step(F.col("activity"), [8, 4, 2], [1.0, 0.8, 0.5, 0.3]),
        "edge": X.step_up(F.col("entity_id") % 10, [0, 1, 2, 4], [1.0, 0.75, 0.5, 0.25, 0.0])})


@query("B13_cut", "bin:s n:i", """SELECT CASE WHEN metric<=-200 THEN 'A' WHEN metric<=-100 THEN 'B' WHEN metric<=-1
 THEN 'C' WHEN metric<=0 THEN 'D' WHEN metric<=99 THEN 'E' WHEN metric<=199 THEN 'F' ELSE 'G' END bin, count(*) n
FROM panel GROUP BY 1""", P)
def _(spark, d):
    b = X.cut(F.col("metric"), [-200, -100, -1, 0, 99, 199], list("ABCDEFG"))
    return panel(spark, d).groupBy(b.alias("bin")).agg(F.count(F.lit(1)).alias("n"))


@query("B14_number_features", "entity_id:i last1:i last2:i odd:i band10:i band50:i band100:i", """
SELECT DISTINCT entity_id, entity_id%10 last1, entity_id%100 last2, entity_id%2 odd, entity_id//10*10 band10,
 entity_id//50*50 band50, entity_id//100*100 band100 FROM panel""", P)
def _(spark, d):
    return WN.number_features(panel(spark, d).select("entity_id").distinct())


@query("B15_squash", "entity_id:i v:f", """SELECT entity_id, greatest(0, least(100, 50+50*tanh(avg(metric)/100))) v
FROM panel GROUP BY 1""", P)
def _(spark, d):
    return panel(spark, d).groupBy("entity_id").agg(X.squash(F.avg("metric"), 100.0).alias("v"))


@query("B16_normalize", "entity_id:i minmax:f fixed:f robust:f", """
SELECT entity_id, (m-mn)/(mx-mn)*100 minmax, greatest(0, least(100, (m+100)/200*100)) fixed,
 greatest(0, least(100, (m-p05)/(p95-p05)*100)) robust
FROM (SELECT entity_id, avg(metric) m FROM panel GROUP BY 1) a, (SELECT min(m) mn, max(m) mx,
  quantile_cont(m,0.05) p05, quantile_cont(m,0.95) p95 FROM (SELECT avg(metric) m FROM panel GROUP BY entity_id)) b""",
       P)
def _(spark, d):
    return WN.normalise(panel(spark, d).groupBy("site", "entity_id").agg(F.avg("metric").alias("m")), "m", -100, 100)


@query("B17_confidence", "entity_id:i n:i by_exp:f by_sqrt:f", """SELECT entity_id, count(*) n,
 1-exp(-count(*)/4.5) by_exp, sqrt(least(count(*),31)/31) by_sqrt FROM panel GROUP BY 1""", P)
def _(spark, d):
    n = F.count(F.lit(1))
    return panel(spark, d).groupBy("entity_id").agg(
        n.alias("n"), X.confidence_exp(n, 4.5).alias("by_exp"), X.confidence_sqrt(n).alias("by_sqrt"))


@query("B18_ratio", "day:d entity_id:i r:f r0:f", """SELECT day, entity_id, metric/nullif(c1,0) r,
 coalesce(metric/nullif(c1,0), 0) r0 FROM panel""", P)
def _(spark, d):
    m, c = F.col("metric"), F.col("c1")
    return panel(spark, d).select("day", "entity_id", X.ratio(m, c).alias("r"), X.ratio0(m, c).alias("r0"))


RULES = [("ALPHA", "in", "(STEEL|TIN)"), ("BETA", "in", "^(PROMO|SMALL)"), ("BETA", "not", "BRASS"),
         ("GAMMA", "in", "BRUSHED"), ("REVIEW", "in", "COPPER$")]


@query("B19_classify", "p_partkey:i rules:s", """SELECT p_partkey, concat_ws('+',
 CASE WHEN regexp_matches(t, '(STEEL|TIN)') THEN 'ALPHA' END,
 CASE WHEN regexp_matches(t, '^(PROMO|SMALL)') AND NOT regexp_matches(t, 'BRASS') THEN 'BETA' END,
 CASE WHEN regexp_matches(t, 'BRUSHED') THEN 'GAMMA' END,
 CASE WHEN regexp_matches(t, 'COPPER$') THEN 'REVIEW' END) rules
FROM (SELECT p_partkey, upper(p_type || ' ' || p_name) t FROM part)""")
def _(spark, d):
    return WN.classify(table(spark, d, "part"), F.upper(F.concat_ws(" ", "p_type", "p_name")), RULES)


@query("B20_join_distinct", "entity_id:i sorted_labels:s first_seen:s", """
SELECT entity_id, string_agg(label, ' / ' ORDER BY label) sorted_labels, string_agg(label, ' / ' ORDER BY f, label)
 first_seen FROM (SELECT entity_id, label, min(day) f FROM panel GROUP BY 1, 2) GROUP BY 1""", P)
def _(spark, d):
    return WN.join_distinct(panel(spark, d))


@query("B21_reasons", "entity_id:i reason:s", """
SELECT entity_id, CASE WHEN t = '' THEN 'NONE' ELSE t END reason FROM (
 SELECT entity_id, array_to_string(list_slice(list_filter([CASE WHEN m>=-10 THEN 'MEAN' END, CASE WHEN w>=0.3 THEN 'WIN' END,
   CASE WHEN n>=20 THEN 'DAYS' END, CASE WHEN x>=100 THEN 'HIGH' END, CASE WHEN l<=-100 THEN 'DIP' END],
   lambda z: z IS NOT NULL), 1, 4), ' / ') t
 FROM (SELECT entity_id, avg(metric) m, avg((metric>0)::INT) w, count(*) n, max(metric) x, min(metric) l
  FROM panel GROUP BY 1))""", P)
def _(spark, d):
    m = F.col("metric")
    rules = [(F.avg(m) >= -10, "MEAN"), (F.avg((m > 0).cast("int")) >= 0.3, "WIN"), (F.count(m) >= 20, "DAYS"),
             (F.max(m) >= 100, "HIGH"), (F.min(m) <= -100, "DIP")]
    return panel(spark, d).groupBy("entity_id").agg(X.reasons(rules, 4, "NONE").alias("reason"))


@query("B22_lag_bucket", "bucket:s delay:s n:i", """
SELECT CASE WHEN g<=3 THEN 'DAY' || g WHEN g<=7 THEN 'DAY4-7' WHEN g<=14 THEN 'DAY8-14' WHEN g<=21 THEN 'DAY15-21'
 WHEN g<=31 THEN 'DAY22-31' ELSE 'DAY32+' END bucket,
 CASE WHEN g<=1 THEN 'FORMAL' WHEN g=2 THEN 'PROVISIONAL' WHEN g=3 THEN 'LAG_2' ELSE 'LAG_3_PLUS' END delay, count(*) n
FROM (SELECT day - lag(day) OVER (PARTITION BY entity_id ORDER BY day) g FROM panel) WHERE g IS NOT NULL GROUP BY 1, 2
""", P)
def _(spark, d):
    w = Window.partitionBy("site", "entity_id").orderBy("day")
    g = F.datediff("day", F.lag("day").over(w))
    return panel(spark, d).select(g.alias("g")).where("g IS NOT NULL").groupBy(
        X.lag_bucket(F.col("g")).alias("bucket"), X.delay_class(F.col("g")).alias("delay")
    ).agg(F.count(F.lit(1)).alias("n"))


@query("B23_half_even", "o_orderkey:i v:f", """SELECT o_orderkey, CASE WHEN x % 10 <> 5 THEN round(x/10.0)
 WHEN (x // 10) % 2 = 0 THEN x // 10 ELSE x // 10 + 1 END v FROM (SELECT o_orderkey, o_custkey x FROM orders)""")
def _(spark, d):
    return table(spark, d, "orders").select("o_orderkey", F.bround(F.col("o_custkey") / 10.0, 0).alias("v"))


@query("B24_status", "day:d status:s", """
SELECT day, CASE WHEN n < 100 THEN 'ACTUAL_INCOMPLETE' WHEN zero > 0.2*n THEN 'REVIEW_REQUIRED'
 WHEN plus = 0 THEN 'NO_WINNER' ELSE 'EVALUATED' END status
FROM (SELECT day, count(*) n, count(*) FILTER (activity<=1) zero, count(*) FILTER (metric>0) plus
 FROM panel GROUP BY 1)""", P)
def _(spark, d):
    n = F.count(F.lit(1))
    return panel(spark, d).groupBy(*DAY).agg(Q.status([
        (n < 100, "ACTUAL_INCOMPLETE"), (F.count_if(F.col("activity") <= 1) > 0.2 * n, "REVIEW_REQUIRED"),
        (F.count_if(F.col("metric") > 0) == 0, "NO_WINNER")], "EVALUATED").alias("status"))


@query("B25_pattern", "pattern:s n:i", """
SELECT pattern, count(*) n FROM (SELECT lag(wl,2) OVER e || lag(wl) OVER e AS pattern
 FROM (SELECT *, CASE WHEN metric>0 THEN 'W' ELSE 'L' END wl FROM panel)
 WINDOW e AS (PARTITION BY entity_id ORDER BY day)) WHERE pattern IS NOT NULL GROUP BY 1""", P)
def _(spark, d):
    return WN.pattern(panel(spark, d), 2).where("pattern IS NOT NULL").groupBy("pattern").agg(
        F.count(F.lit(1)).alias("n"))


@query("B26_members", "day:d label:s block:i n:i members:s", """
SELECT day, label, entity_id // 1000 AS block, count(*) n, string_agg(entity_id::VARCHAR, '|' ORDER BY entity_id)
 members FROM panel GROUP BY 1, 2, 3""", P)
def _(spark, d):
    return WN.members(panel(spark, d), DAY + ["label"])
