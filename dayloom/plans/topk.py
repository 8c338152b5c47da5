"""Registered queries: sort, limit and top-k (G01-G08), and pick-based checks and aggregates."""

from dayloom.functions import expr as X
from dayloom.operators import aggregates as A
from dayloom.operators import joins as J
from dayloom.operators import ordering as O
from dayloom.operators import quality as Q
from dayloom.operators import scoring as SC
from dayloom.operators import topk as K
from dayloom.panel import DAY, SITE
from dayloom.plans import sql as S
from dayloom.plans.aggregates import PD
from dayloom.plans.common import F, daily, panel
from dayloom.plans.joins import MDAILY, MPAIRS, PJ, mode_daily, mode_picks, two_models
from dayloom.plans.registry import query
from dayloom.plans.scoring import BANDS, EVAL_SPEC, PICKS, POP, PSC, bands_sql, eval_sql, feats, picks

P = S.PANEL


@query("C19_check_picks", "day:d rows:i ranks:i max_rank:i entities:i ok:b", """
SELECT day, count(*) AS rows, count(DISTINCT rank) ranks, max(rank) max_rank, count(DISTINCT entity_id) entities,
 count(*)=10 AND count(DISTINCT rank)=10 AND max(rank)=10 AND count(DISTINCT entity_id)=10 ok FROM picks GROUP BY 1""", PICKS)
def _(spark, d):
    return Q.check_picks(picks(spark, d))


@query("G01_top", "day:d entity_id:i metric:f", "SELECT * FROM panel ORDER BY metric DESC, day, entity_id LIMIT 20", P)
def _(spark, d):
    return K.top(panel(spark, d), 20, [F.desc("metric"), F.asc("day"), F.asc("entity_id")])


@query("G02_topn", "label:s rank:i day:d entity_id:i metric:f", """
SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY label ORDER BY metric DESC, entity_id, day) AS rank FROM panel)
WHERE rank<=5""", P)
def _(spark, d):
    return O.top_n(panel(spark, d), ["site", "label"], [F.desc("metric"), F.asc("entity_id"), F.asc("day")], 5)


@query("G03_topn_multi", "label:s rank:i entity_id:i win:f n:i", """
SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY label ORDER BY round(win,9) DESC, n DESC, entity_id) AS rank FROM (
 SELECT label, entity_id, avg((metric>0)::INT) win, count(*) n FROM panel GROUP BY 1, 2)) WHERE rank<=5""", P)
def _(spark, d):
    g = panel(spark, d).groupBy("site", "label", "entity_id").agg(
        A.rate(F.col("metric") > 0).alias("win"), F.count(F.lit(1)).alias("n"))
    return O.top_n(g, ["site", "label"], [X.rank_key(F.col("win")).desc(), F.desc("n"), F.asc("entity_id")], 5)


@query("G04_bands", "band:s n:i mean:f", f"""SELECT band, count(*) n, avg(metric) mean FROM picks, {bands_sql()}
WHERE rank BETWEEN lo AND hi GROUP BY 1""", PICKS)
def _(spark, d):
    return K.bands(picks(spark, d), BANDS).groupBy("band").agg(F.count(F.lit(1)).alias("n"), F.avg("metric").alias("mean"))


_edges = []
for _name, _share in K.SHARES:
    _prev = _edges[-1][1] if _edges else "1"
    _edges.append((_name, f"greatest({_prev}, ceil(n*{_share}))"))


@query("G05_score_bands", "score_band:s n:i mean:f", "SELECT score_band, count(*) n, avg(metric) mean FROM (SELECT metric, CASE "
       + " ".join(f"WHEN r<={e} THEN '{n}'" for n, e in _edges) + """ ELSE 'BOTTOM50' END score_band FROM (
SELECT *, row_number() OVER (PARTITION BY day ORDER BY score DESC, entity_id) r, count(*) OVER (PARTITION BY day) n FROM scored))
GROUP BY 1""", PSC)
def _(spark, d):
    b = K.score_bands(SC.score(feats(spark, d, ()), SC.BASE_WEIGHTS))
    return b.groupBy("score_band").agg(F.count(F.lit(1)).alias("n"), F.avg("metric").alias("mean"))


@query("G06_tiers", "day:d rank:i entity_id:i tier:s", """
SELECT day, rank, entity_id, CASE WHEN rank<=3 THEN 'PRIMARY' WHEN rank<=8 THEN 'NEXT' ELSE 'OUTSIDE' END tier FROM picks""",
       PICKS)
def _(spark, d):
    return K.tiers(picks(spark, d), 3, 8)


@query("G07_nlargest", "day:d mean:f", "SELECT day, mean FROM daily ORDER BY mean DESC, day LIMIT 5", PD)
def _(spark, d):
    return K.nlargest(daily(spark, d), 5, "mean")


@query("G07_nsmallest", "day:d mean:f", "SELECT day, mean FROM daily ORDER BY mean, day LIMIT 5", PD)
def _(spark, d):
    return K.nsmallest(daily(spark, d), 5, "mean")


@query("G08_shortlist", "day:d rank:i entity_id:i score:f", """
SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY day ORDER BY score DESC, entity_id) AS rank FROM scored
 WHERE (day, entity_id) NOT IN (SELECT day, entity_id FROM panel WHERE activity>=5)) WHERE rank<=3""", PSC)
def _(spark, d):
    busy = panel(spark, d).where("activity >= 5")
    return K.shortlist(SC.score(feats(spark, d, ()), SC.BASE_WEIGHTS), busy, 3)


@query("E15_pivot_rank_day", "rank:i day:d value:f row_total:f",
       "SELECT rank, day, sum(metric) AS value, sum(sum(metric)) OVER (PARTITION BY rank) row_total FROM picks GROUP BY 1, 2", PICKS)
def _(spark, d):
    return A.pivot_rank_day(picks(spark, d))


@query("E33_evaluate_topn", EVAL_SPEC, eval_sql("picks"), S.chain(PICKS, POP))
def _(spark, d):
    return A.evaluate_topn(picks(spark, d), panel(spark, d), BANDS)


@query("E34_overall", "model:s band:s days:i mean:f win_rate:f positive_day_rate:f total:f worst_mean:f best_mean:f", """
SELECT model, band, count(DISTINCT day) AS days, avg(mean) mean, avg(win_rate) win_rate, avg((total>0)::INT) positive_day_rate,
 sum(total) total, min(mean) worst_mean, max(mean) best_mean FROM mdaily GROUP BY 1, 2""", MDAILY)
def _(spark, d):
    return A.overall(mode_daily(spark, d), ["model", "band"])


for _n, _e, _c in (("rank", "rank", None), ("group", "CASE WHEN rank<=3 THEN 1 WHEN rank<=6 THEN 2 ELSE 3 END", 1)):
    @query(f"E35_by_{_n}", "rank_group:i n:i mean:f win_rate:f total:f lo:f hi:f", f"""
SELECT {_e} rank_group, count(*) n, avg(metric) mean, avg((metric>0)::INT) win_rate, sum(metric) total, min(metric) lo,
 max(metric) hi FROM picks GROUP BY 1""", PICKS)
    def _(spark, d, _c=_c):
        g = F.when(F.col("rank") <= 3, 1).when(F.col("rank") <= 6, 2).otherwise(3) if _c else None
        return A.by_rank(picks(spark, d), g)


@query("E36_label_contribution", "label:s entered:i total:f share:f frequency:f", """
SELECT *, total/sum(total) OVER () share, entered/sum(entered) OVER () frequency FROM (
 SELECT label, count(*) entered, sum(metric) total FROM pj WHERE kind='ENTERED' GROUP BY 1)""", PJ)
def _(spark, d):
    g = J.pick_join(*two_models(spark, d)).where("kind = 'ENTERED'").groupBy("site", "label").agg(
        F.count(F.lit(1)).alias("entered"), F.sum("metric").alias("total"))
    s = g.groupBy("site").agg(F.sum("entered").alias("_e"), F.sum("total").alias("_t"))
    return g.join(s, "site").withColumns({
        "share": F.try_divide("total", "_t"), "frequency": F.col("entered") / F.col("_e")})


@query("E37_outcome_profile", "outcome:s days:i mean_delta:f overlap:f entered:f", """
SELECT CASE WHEN replacement_delta>0 THEN 'SUCCESS' WHEN replacement_delta<0 THEN 'FAILURE' ELSE 'SAME' END outcome,
 count(*) AS days, avg(replacement_delta) mean_delta, avg(overlap) overlap, avg(entered) entered FROM povl GROUP BY 1""", PJ)
def _(spark, d):
    o = J.pick_overlap(*two_models(spark, d))
    c = F.col("replacement_delta")
    return o.groupBy(F.when(c > 0, "SUCCESS").when(c < 0, "FAILURE").otherwise("SAME").alias("outcome")).agg(
        F.count(F.lit(1)).alias("days"), F.avg(c).alias("mean_delta"), F.avg("overlap").alias("overlap"),
        F.avg("entered").alias("entered"))


@query("E38_paired_summary", "model:s band:s pairs:i better:i same:i worse:i mean_change:f median_change:f total_change:f "
                             "min_change:f max_change:f", """
SELECT model, band, count(*) pairs, count(*) FILTER (c>0) better, count(*) FILTER (c=0) same,
 count(*) FILTER (c<0) worse, avg(c) mean_change, median(c) median_change, sum(c) total_change,
 min(c) min_change, max(c) max_change FROM (SELECT *, round(change, 9) c FROM mpairs) GROUP BY 1, 2""", MPAIRS)
def _(spark, d):
    pairs = J.pair_models(mode_daily(spark, d), "BASE").withColumn("change", X.rank_key(F.col("change")))
    return A.paired_summary(pairs, "change", ["model", "band"])
