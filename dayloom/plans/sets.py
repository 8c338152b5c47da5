"""Registered queries: set operations."""

from dayloom.operators import topk as K
from dayloom.panel import DAY, KEY
from dayloom.plans import sql as S
from dayloom.plans.common import F, lines, panel, shuffled_second
from dayloom.plans.registry import query

P2 = S.chain(S.PANEL, S.SECOND)


@query("H01_union_all", "day:d n:i total:f", """
SELECT day, count(*) n, sum(metric) total FROM (SELECT day, metric FROM panel UNION ALL SELECT day, metric FROM second)
GROUP BY 1""", P2)
def _(spark, d):
    return K.union_all(panel(spark, d), shuffled_second(spark, d)).groupBy("day").agg(
        F.count(F.lit(1)).alias("n"), F.sum("metric").alias("total"))


@query("H02_intersect_days", "day:d entity_id:i", """
SELECT day, entity_id FROM panel WHERE metric>0 INTERSECT SELECT day, entity_id FROM second""", P2)
def _(spark, d):
    return K.intersect_days(panel(spark, d).where("metric > 0"), shuffled_second(spark, d), on=KEY)


@query("H03_except_days", "day:d entity_id:i", "SELECT day, entity_id FROM panel EXCEPT SELECT day, entity_id FROM second", P2)
def _(spark, d):
    return K.except_days(panel(spark, d), shuffled_second(spark, d), KEY)


@query("H04_distinct_counts", "days:i entities:i labels:i", """
SELECT count(DISTINCT day) AS days, count(DISTINCT entity_id) entities, count(DISTINCT label) labels FROM panel""", S.LINES)
def _(spark, d):
    return K.distinct_counts(lines(spark, d))


@query("H05_same_rows", "side:s n:i", """
SELECT side, count(*) n FROM (SELECT 'LEFT' side, * FROM (SELECT day, entity_id, metric FROM panel EXCEPT ALL
 SELECT day, entity_id, metric FROM second) UNION ALL SELECT 'RIGHT', * FROM (SELECT day, entity_id, metric FROM second
 EXCEPT ALL SELECT day, entity_id, metric FROM panel)) GROUP BY 1""", P2)
def _(spark, d):
    cols = ["day", "entity_id", "metric"]
    return K.same_rows(panel(spark, d).select(*cols), shuffled_second(spark, d).select(*cols)).groupBy("side").agg(
        F.count(F.lit(1)).alias("n"))
