"""Registered queries over four sites that share entity ids: mistakes across sites would show."""

from pyspark.sql import functions as F

from dayloom import panel as P
from dayloom.operators import aggregates as A
from dayloom.operators import ordering as O
from dayloom.operators import quality as Q
from dayloom.operators import windows as WN
from dayloom.panel import DAY
from dayloom.plans import sql as S
from dayloom.plans.registry import query

SP = S.PANEL.replace("SELECT user_id", "SELECT 'S' || (event_id % 4) AS site, user_id").replace("GROUP BY 1, 2", "GROUP BY 1, 2, 3")


def panel(spark, d):
    site = F.concat(F.lit("S"), (F.col("event_id") % 4).cast("string"))
    return P.panel_from_events(P.table(spark, d, "events"), site)


@query("E02_by_label_sites", "site:s label:s n:i total:f mean:f",
       "SELECT site, label, count(*) n, sum(metric) total, avg(metric) mean FROM panel GROUP BY 1, 2", SP)
def _(spark, d):
    return A.by_label(panel(spark, d))


@query("F02_change_events_sites", "site:s day:d entity_id:i old_label:s new_label:s", """
SELECT site, day, entity_id, old_label, label new_label FROM (SELECT *, lag(label) OVER w old_label, lag(day) OVER w p FROM panel
 WINDOW w AS (PARTITION BY site, entity_id ORDER BY day)) WHERE day - p = 1 AND label <> old_label""", SP)
def _(spark, d):
    return WN.change_events(panel(spark, d))


@query("F10_prior_streak_sites", "site:s day:d entity_id:i streak:i", """
SELECT site, day, entity_id, coalesce(lag(place) OVER (PARTITION BY site, entity_id, sid ORDER BY day), 0) streak FROM (
 SELECT *, row_number() OVER (PARTITION BY site, entity_id, sid, wl, g ORDER BY day) place FROM (
  SELECT *, row_number() OVER (PARTITION BY site, entity_id, sid ORDER BY day)
   - row_number() OVER (PARTITION BY site, entity_id, sid, wl ORDER BY day) g FROM (
   SELECT *, metric > 0 wl, sum(cut) OVER (PARTITION BY site, entity_id ORDER BY day) sid FROM (
    SELECT *, (lag(day) OVER w IS NULL OR day - lag(day) OVER w <> 1 OR label <> lag(label) OVER w)::INT cut FROM panel
    WINDOW w AS (PARTITION BY site, entity_id ORDER BY day)))))""", SP)
def _(spark, d):
    return WN.prior_streak(panel(spark, d))


@query("F24_maximal_runs_sites", "site:s day:d start_id:i end_id:i length:i total:f", """
SELECT site, day, min(entity_id) start_id, max(entity_id) end_id, count(*) AS length, sum(metric) total FROM (
 SELECT *, entity_id - row_number() OVER (PARTITION BY site, day ORDER BY entity_id) g FROM panel WHERE metric > 0)
GROUP BY site, day, g HAVING count(*) >= 2""", SP)
def _(spark, d):
    return WN.maximal_runs(panel(spark, d), F.col("metric") > 0)


@query("F28_neighbour_coverage_sites", "site:s day:d coverage:s n:i mean:f", """
SELECT site, day, CASE k WHEN 2 THEN 'BOTH' WHEN 1 THEN 'ONE' ELSE 'NONE' END coverage, count(*) n, avg(m) mean FROM (
 SELECT a.site, a.day, a.entity_id, count(b.metric) k, coalesce(avg(b.metric), 0) m FROM panel a LEFT JOIN panel b
  ON a.site = b.site AND a.day = b.day AND b.entity_id IN (a.entity_id - 1, a.entity_id + 1) GROUP BY 1, 2, 3) GROUP BY 1, 2, 3""", SP)
def _(spark, d):
    return WN.neighbour_coverage(panel(spark, d)).groupBy(*DAY, "coverage").agg(F.count(F.lit(1)).alias("n"), F.avg("neighbour_mean").alias("mean"))


@query("C09_missing_entity_days_sites", "site:s entity_id:i day:d", """
SELECT site, entity_id, unnest(generate_series(p + 1, day - 1, INTERVAL 1 DAY))::DATE AS day FROM (
 SELECT site, entity_id, day, lag(day) OVER (PARTITION BY site, entity_id ORDER BY day) p FROM panel) WHERE day - p > 1""", SP)
def _(spark, d):
    return Q.missing_entity_days(panel(spark, d))


@query("G02_topn_sites", "site:s day:d rank:i entity_id:i metric:f", """
SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY site, day ORDER BY metric DESC, entity_id) AS rank FROM panel)
WHERE rank <= 5""", SP)
def _(spark, d):
    return O.top_n(panel(spark, d), DAY, [F.desc("metric"), F.asc("entity_id")], 5)
