"""Registered queries: grouped aggregates (E01-E32, E39, E40; pick-based ones live in backtest)."""

from dayloom.functions import expr as X
from dayloom.operators import aggregates as A
from dayloom.operators import features as FT
from dayloom.panel import DAY, ENTITY, LABEL, SITE, table
from dayloom.plans import sql as S
from dayloom.plans.common import F, daily, lines, panel
from dayloom.plans.registry import query

P = S.PANEL
CORE = ("count(*) n, sum(metric) total, avg(metric) mean, avg((metric>0)::INT) win_rate, min(metric) lo, "
        "max(metric) hi, count(*) FILTER (metric>=50) n_50, count(*) FILTER (metric>=100) n_100, "
        "count(*) FILTER (metric>=200) n_200")
CORE_SPEC = "n:i total:f mean:f win_rate:f lo:f hi:f n_50:i n_100:i n_200:i"
DAILY = f"daily AS (SELECT day, {CORE}, sum(activity) activity FROM panel GROUP BY day)"
PD = S.chain(P, DAILY)


@query("E01_summary", "n:i days:i activity:f total:f mean:f mean_activity:f plus:i even:i minus:i win_rate:f", """
SELECT count(*) n, count(DISTINCT day) AS days, sum(activity) activity, sum(metric) total, avg(metric) mean,
       avg(activity) mean_activity, count(*) FILTER (metric>0) plus, count(*) FILTER (metric=0) even,
       count(*) FILTER (metric<0) minus, avg((metric>0)::INT) win_rate FROM panel""", P)
def _(spark, d):
    return A.summary(panel(spark, d))


@query("E02_by_label", f"label:s {CORE_SPEC} mean_c1:f mean_c2:f",
       f"SELECT label, {CORE}, avg(c1) mean_c1, avg(c2) mean_c2 FROM panel GROUP BY label", P)
def _(spark, d):
    return A.by_label(panel(spark, d))


@query("E02_by_label_lines", f"label:s {CORE_SPEC} mean_c1:f mean_c2:f".replace("total:f", "total:m").replace("mean:f", "mean:m"),
       f"SELECT label, {CORE}, avg(c1) mean_c1, avg(c2) mean_c2 FROM panel GROUP BY label", S.LINES)
def _(spark, d):
    return A.by_label(lines(spark, d))


@query("E03_by_entity", "entity_id:i days:i labels:s total:f mean:f win_rate:f median:f", """
SELECT entity_id, count(DISTINCT day) AS days, array_to_string(list_sort(list(DISTINCT label)), ' / ') labels,
       sum(metric) total, avg(metric) mean, avg((metric>0)::INT) win_rate, median(metric) median
FROM panel GROUP BY 1""", P)
def _(spark, d):
    return A.by_entity(panel(spark, d))


@query("E04_by_day", f"day:d {CORE_SPEC} activity:f", "SELECT * FROM daily", PD)
def _(spark, d):
    return A.by_day(panel(spark, d))


@query("E05_by_weekday", f"weekday:i days:i {CORE_SPEC}",
       f"SELECT isodow(day)-1 weekday, count(DISTINCT day) AS days, {CORE} FROM panel GROUP BY 1", P)
def _(spark, d):
    return A.by_weekday(panel(spark, d))


@query("E06_by_entity_label", "entity_id:i label:s n:i mean:f hi:f lo:f last_day:d is_current:b", """
SELECT *, last_day = max(last_day) OVER (PARTITION BY entity_id) is_current FROM (
  SELECT entity_id, label, count(*) n, avg(metric) mean, max(metric) hi, min(metric) lo, max(day) last_day
  FROM panel GROUP BY 1, 2)""", P)
def _(spark, d):
    return A.by_entity_label(panel(spark, d))


@query("E07_by_label_weekday", f"label:s weekday:i days:i {CORE_SPEC}",
       f"SELECT label, isodow(day)-1 weekday, count(DISTINCT day) AS days, {CORE} FROM panel GROUP BY 1, 2", P)
def _(spark, d):
    return A.by_weekday(panel(spark, d), ["label"])


@query("E07_by_entity_weekday", f"entity_id:i weekday:i days:i {CORE_SPEC}",
       f"SELECT entity_id, isodow(day)-1 weekday, count(DISTINCT day) AS days, {CORE} FROM panel GROUP BY 1, 2", P)
def _(spark, d):
    return A.by_weekday(panel(spark, d), ["entity_id"])


@query("E08_entity_lifetime",
       "entity_id:i days:i changes:i current_label:s first_day:d last_day:d labels:i label_order:s", """
SELECT a.*, b.labels, b.label_order FROM (
  SELECT entity_id, count(*) AS days, coalesce(sum(change),0) changes, arg_max(label, day) current_label,
         min(day) first_day, max(day) last_day
  FROM (SELECT *, (label <> lag(label) OVER (PARTITION BY entity_id ORDER BY day))::INT change FROM panel)
  GROUP BY 1) a JOIN (
  SELECT entity_id, count(*) labels, string_agg(label, ' > ' ORDER BY f, label) label_order
  FROM (SELECT entity_id, label, min(day) f FROM panel GROUP BY 1, 2) GROUP BY 1) b USING (entity_id)""", P)
def _(spark, d):
    return A.entity_lifetime(panel(spark, d))


@query("E09_label_strength", "label:s entities:i days:i n:i plus:i even:i minus:i mean:f", """
SELECT label, count(DISTINCT entity_id) entities, count(DISTINCT day) AS days, count(*) n,
  count(*) FILTER (metric>0) plus, count(*) FILTER (metric=0) even, count(*) FILTER (metric<0) minus,
  avg(metric) mean FROM panel GROUP BY 1""", P)
def _(spark, d):
    return A.label_strength(panel(spark, d))


@query("E10_quantiles", "label:s p10:f q25:f median:f q75:f", """
SELECT label, quantile_cont(metric,0.1) p10, quantile_cont(metric,0.25) q25, median(metric) median,
       quantile_cont(metric,0.75) q75 FROM panel GROUP BY 1""", P)
def _(spark, d):
    return A.quantiles(panel(spark, d), LABEL, {"p10": 0.1, "q25": 0.25, "median": 0.5, "q75": 0.75})


@query("E11_spread", "label:s n:i sd_pop:f sd_samp:f", """
SELECT label, count(metric) n, stddev_pop(metric) sd_pop,
  CASE WHEN count(metric)<2 THEN 0 ELSE stddev_samp(metric) END sd_samp FROM panel GROUP BY 1""", P)
def _(spark, d):
    return A.spread(panel(spark, d), LABEL)


@query("E12_top_values", "label:s n:i",
       "SELECT label, count(*) n FROM panel GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 3", P)
def _(spark, d):
    return A.top_values(panel(spark, d), "label", 3)


@query("E13_daily_then_overall", "label:s days:i n:i mean_of_days:f positive_day_rate:f", """
SELECT label, count(*) AS days, sum(c) n, avg(m) mean_of_days, avg((m>0)::INT) positive_day_rate
FROM (SELECT day, label, avg(metric) m, count(*) c FROM panel GROUP BY 1, 2) GROUP BY 1""", P)
def _(spark, d):
    return A.daily_then_overall(panel(spark, d), ["label"])


@query("E14_multi_key", "dimension:s value:s n:i mean:f win_rate:f", """
SELECT CASE WHEN grouping(label)=0 THEN 'label' WHEN grouping(wd)=0 THEN 'weekday'
            WHEN grouping(digit)=0 THEN 'digit' ELSE 'ALL' END dimension,
       coalesce(label, wd::VARCHAR, digit::VARCHAR, 'ALL') AS value,
       count(*) n, avg(metric) mean, avg((metric>0)::INT) win_rate
FROM (SELECT *, isodow(day)-1 wd, entity_id % 10 digit FROM panel)
GROUP BY GROUPING SETS ((), (label), (wd), (digit))""", P)
def _(spark, d):
    return A.multi_key(panel(spark, d), [
        ("label", F.col("label")), ("weekday", F.weekday("day")), ("digit", F.col("entity_id") % 10)])


PERIOD = ("min(day) AS start, max(day) AS \"end\", count(*) AS days, avg(mean) mean, sum(total) total, "
          "count(*) FILTER (mean>0) positive, avg((mean>0)::INT) positive_rate")
PSPEC = "period:s start:d days:i mean:f total:f positive:i positive_rate:f"


@query("E16_by_month", PSPEC, f"""SELECT CAST(CAST(date_trunc('month', day) AS DATE) AS VARCHAR) period, {PERIOD}
FROM daily GROUP BY 1""", PD)
def _(spark, d):
    return A.by_period(daily(spark, d), "month")


@query("E16_by_week", PSPEC, f"""SELECT CAST(CAST(date_trunc('week', day) AS DATE) AS VARCHAR) period, {PERIOD}
FROM daily GROUP BY 1""", PD)
def _(spark, d):
    return A.by_period(daily(spark, d), "week")


@query("E16_by_block", PSPEC, f"""SELECT CAST((r-1)//4 + 1 AS VARCHAR) period, {PERIOD}
FROM (SELECT *, dense_rank() OVER (ORDER BY day) r FROM daily) GROUP BY 1""", PD)
def _(spark, d):
    return A.by_period(daily(spark, d), "block", 4)


@query("E17_half_split", "first_days:i second_days:i first_mean:f second_mean:f change:f", """
SELECT count(*) FILTER (f) first_days, count(*) FILTER (NOT f) second_days, avg(mean) FILTER (f) first_mean,
  avg(mean) FILTER (NOT f) second_mean, avg(mean) FILTER (NOT f) - avg(mean) FILTER (f) change
FROM (SELECT mean, row_number() OVER (ORDER BY day) <= (count(*) OVER ())//2 f FROM daily)""", PD)
def _(spark, d):
    return A.half_split(daily(spark, d))


@query("E18_trailing", "window_days:i start:d end:d mean:f median:f total:f positive_rate:f", """
SELECT w window_days, min(day) AS start, max(day) AS "end", avg(mean) mean, median(mean) median, sum(total) total,
  avg((mean>0)::INT) positive_rate
FROM (SELECT *, row_number() OVER (ORDER BY day DESC) r, count(*) OVER () c FROM daily),
  (SELECT unnest([7,14,21,30,45,60,90]) w) WHERE r <= w AND w <= c GROUP BY 1""".replace('"end"', "\"end\""), PD)
def _(spark, d):
    return A.trailing(daily(spark, d), [7, 14, 21, 30, 45, 60, 90])


PRIOR = FT.SQL_PRIOR_BASIC
PF = S.chain(P, PRIOR)


@query("E19_correlate", "feature:s n:i pearson:f", "\nUNION ALL ".join(f"""
SELECT '{f}' feature, count({f}) n, CASE WHEN count({f})>=10 THEN corr({f}, metric) END pearson
FROM prior""" for f in ["last", "mean3", "mean7"]), PF)
def _(spark, d):
    return A.correlate(FT.prior_basic(panel(spark, d)), ["last", "mean3", "mean7"], "metric")


RANKED = """SELECT *, rank() OVER ({p} ORDER BY activity) + (count(*) OVER ({pc} activity) - 1)/2.0 rx,
 rank() OVER ({p} ORDER BY metric) + (count(*) OVER ({pc} metric) - 1)/2.0 ry FROM panel"""


@query("E20_spearman_pooled", "n:i spearman:f",
       f"SELECT count(*) n, corr(rx, ry) spearman FROM ({RANKED.format(p='', pc='PARTITION BY')})", P)
def _(spark, d):
    return A.spearman(panel(spark, d), "activity", "metric", SITE)


@query("E20_spearman_daily", "day:d n:i spearman:f",
       f"""SELECT day, count(*) n, corr(rx, ry) spearman
FROM ({RANKED.format(p='PARTITION BY day', pc='PARTITION BY day,')}) GROUP BY 1""", P)
def _(spark, d):
    return A.spearman(panel(spark, d), "activity", "metric", DAY)


QUINT = """quint AS (
SELECT quintile, count(*) n, avg(mean7) mean_feature, avg(metric) mean_target, avg((metric>0)::INT) win_rate
FROM (SELECT *, greatest(1, ceil((row_number() OVER (ORDER BY mean7r, day, entity_id) - 1) * 5.0
        / (count(*) OVER () - 1))) quintile
      FROM (SELECT *, round(mean7, 9) mean7r FROM prior WHERE mean7 IS NOT NULL)) GROUP BY 1)"""


def _quint(spark, d):
    base = FT.prior_basic(panel(spark, d)).withColumn("mean7", X.rank_key(F.col("mean7")))
    return A.quintiles(base, "mean7")


@query("E21_quintiles", "quintile:i n:i mean_feature:f mean_target:f win_rate:f", "SELECT * FROM quint",
       S.chain(PF, QUINT))
def _(spark, d):
    return _quint(spark, d)


@query("E21_quintile_spread", "spread:f win_spread:f strength:f", """
SELECT s spread, w win_spread, abs(s) strength FROM (
 SELECT max(mean_target) FILTER (quintile=5) - max(mean_target) FILTER (quintile=1) s,
        max(win_rate) FILTER (quintile=5) - max(win_rate) FILTER (quintile=1) w FROM quint)""", S.chain(PF, QUINT))
def _(spark, d):
    return A.quintile_spread(_quint(spark, d))


for _name, _op, _inc in (("live", ">", False), ("change", ">=", True)):
    @query(f"E22_median_split_{_name}", "half:s n:i mean:f win_rate:f", f"""
SELECT CASE WHEN activity {_op} m THEN 'HIGH' ELSE 'LOW' END half, count(*) n, avg(metric) mean,
  avg((metric>0)::INT) win_rate
FROM panel, (SELECT median(activity) m FROM panel) GROUP BY 1""", P)
    def _(spark, d, _inc=_inc):
        return A.median_split(panel(spark, d), "activity", inclusive=_inc)


@query("E23_group_contrast", "feature:s mean_yes:f mean_no:f difference:f", "\nUNION ALL ".join(f"""
SELECT '{f}' feature, avg({f}) FILTER (metric>0) mean_yes, avg({f}) FILTER (metric<=0) mean_no,
  avg({f}) FILTER (metric>0) - avg({f}) FILTER (metric<=0) difference FROM panel"""
                                                                                  for f in ["activity", "c1", "c2"]), P)
def _(spark, d):
    return A.group_contrast(panel(spark, d), F.col("metric") > 0, ["activity", "c1", "c2"])


LAB = S.chain(P, "byl AS (SELECT label, day, sum(metric) total, avg(metric) mean FROM panel GROUP BY 1, 2)")


def _label_days(spark, d):
    return panel(spark, d).groupBy("site", "label", "day").agg(
        F.sum("metric").alias("total"), F.avg("metric").alias("mean"))


@query("E24_risk_stats", "label:s days:i gross_gain:f gross_loss:f profit_factor:f best:f worst:f best_day:d "
                         "worst_day:d", """
SELECT label, count(*) AS days, coalesce(sum(total) FILTER (total>0),0) gross_gain,
  coalesce(-sum(total) FILTER (total<0),0) gross_loss,
  coalesce(sum(total) FILTER (total>0),0)/nullif(coalesce(-sum(total) FILTER (total<0),0),0) profit_factor,
  max(total) best, min(total) worst, arg_max(day, (total, day)) best_day, arg_min(day, (total, day)) worst_day
FROM byl GROUP BY 1""", LAB)
def _(spark, d):
    return A.risk_stats(_label_days(spark, d), LABEL)


@query("E24_sessions_roi", "mode:s sessions:i invested:m recovered:m profit:m wins:i mean_profit:f win_rate:f roi:f", """
SELECT l_linestatus || l_returnflag AS mode, count(*) AS sessions, sum(i) invested, sum(r) recovered, sum(r - i) profit, count(*) FILTER (r > i) wins,
 avg((r - i)::DOUBLE) mean_profit, 100 * avg((r > i)::INT) win_rate, 100 * sum(r)::DOUBLE / sum(i)::DOUBLE roi FROM (
 SELECT l_linestatus, l_returnflag, l_extendedprice::DECIMAL(18,2) i, (l_extendedprice::DECIMAL(18,2) * (CASE WHEN l_returnflag = 'R' THEN 1.25 ELSE 0.95 END)::DECIMAL(4,2)) r FROM lineitem)
GROUP BY 1""")
def _(spark, d):
    price = F.col("l_extendedprice").cast("decimal(18,2)")
    back = price * F.when(F.col("l_returnflag") == "R", 1.25).otherwise(0.95).cast("decimal(4,2)")
    x = table(spark, d, "lineitem").select(F.concat("l_linestatus", "l_returnflag").alias("mode"), price.alias("i"), back.alias("r"))
    return A.session_summary(x, ["mode"], "i", "r")


@query("E15_segment_crosstab", "day:d label:s n:i row_total:i column_total:i", """
SELECT day, label, coalesce(n, 0) n, sum(n) OVER (PARTITION BY day) row_total, sum(n) OVER (PARTITION BY label) column_total
FROM (SELECT DISTINCT day FROM panel) CROSS JOIN (SELECT DISTINCT label FROM panel)
LEFT JOIN (SELECT day, label, count(*) n FROM panel GROUP BY 1, 2) USING (day, label)""", P)
def _(spark, d):
    return A.crosstab(panel(spark, d), ["day"], "label")


@query("E25_drop_extremes", "label:s total:f without_best1:f without_best2:f without_worst1:f best_day:d worst_day:d",
       """
SELECT label, sum(total) total, sum(total) FILTER (h>1) without_best1, sum(total) FILTER (h>2) without_best2,
 sum(total) FILTER (l>1) without_worst1, max(day) FILTER (h=1) best_day, max(day) FILTER (l=1) worst_day
FROM (SELECT *, row_number() OVER (PARTITION BY label ORDER BY total DESC, day) h,
             row_number() OVER (PARTITION BY label ORDER BY total, day) l FROM byl) GROUP BY 1""", LAB)
def _(spark, d):
    return A.drop_extremes(_label_days(spark, d), LABEL)


@query("E26_concentration", "label:s gains:f top1_share:f top3_share:f top5_share:f", """
SELECT label, sum(total) gains, sum(total) FILTER (r<=1)/sum(total) top1_share,
 sum(total) FILTER (r<=3)/sum(total) top3_share, sum(total) FILTER (r<=5)/sum(total) top5_share
FROM (SELECT *, row_number() OVER (PARTITION BY label ORDER BY total DESC, day) r FROM byl WHERE total>0)
GROUP BY 1""", LAB)
def _(spark, d):
    return A.concentration(_label_days(spark, d), LABEL)


@query("E27_trend", "label:s days:i slope:f", """
SELECT label, count(*) AS days, regr_slope(mean, x) slope
FROM (SELECT *, row_number() OVER (PARTITION BY label ORDER BY day) - 1 x, count(*) OVER (PARTITION BY label) c
      FROM byl) WHERE x >= c - 7 GROUP BY 1""", LAB)
def _(spark, d):
    return A.trend(_label_days(spark, d), LABEL, last=7)


CONDS = [
    ("ALL", "true"), ("LAST_WIN", "last > 0"), ("LAST_LOSS", "last < 0"), ("LAST_LE_-100", "last <= -100"),
    ("LAST_GE_100", "last >= 100"), ("MEAN3_POS", "mean3 > 0"), ("MEAN3_NEG", "mean3 < 0"),
    ("MEAN7_POS", "mean7 > 0"), ("MEAN7_NEG", "mean7 < 0"), ("DIP_IN_GOOD", "mean7 > 0 AND last < 0"),
    ("HOT_STREAK", "last > 0 AND mean3 > 0"), ("WIN7_GE_HALF", "win7 >= 0.5"), ("WIN7_ZERO", "win7 = 0"),
    ("ODD_ID", "entity_id % 2 = 1"), ("EVEN_ID", "entity_id % 2 = 0"),
    *[(f"DIGIT_{k}", f"entity_id % 10 = {k}") for k in range(10)],
    *[(f"WEEKDAY_{k}", f"wd = {k}") for k in range(7)],
    ("NEW", "last IS NULL"), ("ACTIVE_PREV", "last_activity >= 4"), ("QUIET_PREV", "last_activity < 2"),
]
COND = "cond AS (" + "\nUNION ALL ".join(
    f"SELECT '{n}' condition, count(*) n, avg(metric) mean, avg((metric>0)::INT) win_rate, "
    f"avg((metric>=100)::INT) strong_rate FROM (SELECT *, isodow(day)-1 wd FROM prior) WHERE {c} HAVING count(*)>0"
    for n, c in CONDS) + ")"


def _conds(spark, d):
    base = FT.prior_basic(panel(spark, d)).withColumn("wd", F.weekday("day"))
    return A.condition_table(base, [(n, F.expr(c)) for n, c in CONDS])


@query("E28_condition_table", "condition:s n:i mean:f win_rate:f strong_rate:f", "SELECT * FROM cond",
       S.chain(PF, COND))
def _(spark, d):
    return _conds(spark, d)


@query("E29_rank_conditions", "condition:s n:i mean:f support:f score:f position:i", """
SELECT *, row_number() OVER (ORDER BY round(score, 9) DESC, condition) AS position FROM (
 SELECT condition, n, mean, least(n/30.0, 1.0) support, mean*least(n/30.0, 1.0) score FROM cond)""",
       S.chain(PF, COND))
def _(spark, d):
    ranked = A.rank_conditions(_conds(spark, d))  # one row per condition
    from pyspark.sql import Window
    w = Window.partitionBy("site").orderBy(X.rank_key(F.col("score")).desc(), "condition")
    return ranked.withColumn("position", F.row_number().over(w))


@query("E30_daily_strength", "day:d n:i strong:i strength:f", """
SELECT day, count(*) n, count(*) FILTER (metric>=100) strong, count(*) FILTER (metric>=100)/count(*) strength
FROM panel GROUP BY 1""", P)
def _(spark, d):
    return A.daily_strength(panel(spark, d))


@query("E31_special_days", "day:d score:f band:s", """
SELECT day, score, CASE WHEN score<=40 THEN 'LOW' WHEN score<=50 THEN 'NORMAL' WHEN score<=60 THEN 'HIGH'
  ELSE 'TOP' END band FROM (
 SELECT day, 45 + 20*(mean-avg(mean) OVER ())/stddev_samp(mean) OVER ()
  + 15*(win_rate-avg(win_rate) OVER ())/stddev_samp(win_rate) OVER ()
  + 10*(n_50-avg(n_50) OVER ())/stddev_samp(n_50) OVER ()
  + 5*(n_100-avg(n_100) OVER ())/stddev_samp(n_100) OVER ()
  + 5*(n_200-avg(n_200) OVER ())/coalesce(nullif(stddev_samp(n_200) OVER (),0),1) score FROM daily)""", PD)
def _(spark, d):
    return A.special_days(panel(spark, d))


@query("E32_shrunk", "entity_id:i n:i eb_mean:f eb_rate:f", """
SELECT entity_id, count(*) n, (sum(metric)+any_value(m)*30)/(count(*)+30) eb_mean,
  (count(*) FILTER (metric>0)+any_value(w)*30)/(count(*)+30) eb_rate
FROM panel, (SELECT avg(metric) m, avg((metric>0)::INT) w FROM panel) GROUP BY 1""", P)
def _(spark, d):
    return A.shrunk(panel(spark, d), ["entity_id"])


@query("E39_extremes", "side:s day:d entity_id:i metric:f", """
(SELECT 'LOW' side, day, entity_id, metric FROM panel ORDER BY metric, day, entity_id LIMIT 10) UNION ALL
(SELECT 'HIGH' side, day, entity_id, metric FROM panel ORDER BY metric DESC, day, entity_id LIMIT 10)""", P)
def _(spark, d):
    return A.extremes(panel(spark, d), 10)


for _mode, _hit, _need in (("SOFT", "metric >= 50", "ceil(size*2.0/3.0)"), ("ALL_POSITIVE", "metric > 0", "size")):
    @query(f"E40_group_events_{_mode.lower()}", "day:d stratum:s groups:i events:i", f"""
SELECT day, CASE WHEN size<3 THEN 'REFERENCE' WHEN size<=4 THEN '3-4' WHEN size<=9 THEN '5-9' ELSE '10+' END stratum,
  count(*) groups, count(*) FILTER (k >= {_need}) events
FROM (SELECT day, label, count(*) size, count(*) FILTER ({_hit}) k FROM panel GROUP BY 1, 2) GROUP BY 1, 2""", P)
    def _(spark, d, _mode=_mode):
        return A.group_events(panel(spark, d), 50, _mode)
