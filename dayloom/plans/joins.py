"""Registered queries: joins."""

from dayloom import panel as PN
from dayloom.operators import aggregates as A
from dayloom.operators import joins as J
from dayloom.operators import scoring as SC
from dayloom.operators import windows as WN
from dayloom.panel import DAY, ENTITY, KEY, SITE
from dayloom.plans import sql as S
from dayloom.plans.aggregates import PD
from dayloom.plans.common import F, daily, panel, shuffled_second
from dayloom.plans.registry import query
from dayloom.plans.scoring import BANDS, CATS, PCOMP, PMODES, POP, PSC, bands_sql, eval_sql, feats
from dayloom.plans.windows import PE

P = S.PANEL
P2 = S.chain(P, S.SECOND)


@query("D01_next_day", "day:d entity_id:i metric:f next_metric:f next_label:s", """
SELECT a.day, a.entity_id, a.metric, b.metric next_metric, b.label next_label FROM panel a
JOIN panel b ON a.entity_id=b.entity_id AND b.day=a.day+1""", P)
def _(spark, d):
    return J.next_day(panel(spark, d), ["metric", "label"])


REC = S.chain(P2, """rec AS (SELECT coalesce(a.day,b.day) AS day, coalesce(a.entity_id,b.entity_id) entity_id,
 a.metric metric_a, b.metric metric_b, b.metric-a.metric delta_metric, a.metric=b.metric same_metric, a.label=b.label same_label,
 CASE WHEN b.day IS NULL THEN 'A_ONLY' WHEN a.day IS NULL THEN 'B_ONLY' ELSE 'BOTH' END presence
 FROM panel a FULL JOIN second b ON a.day=b.day AND a.entity_id=b.entity_id)""")


def _rec(spark, d):
    return J.reconcile(panel(spark, d), shuffled_second(spark, d))


@query("D02_reconcile", "day:d entity_id:i presence:s metric_a:f metric_b:f delta_metric:f same_metric:s same_label:s",
       "SELECT * FROM rec", REC)
def _(spark, d):
    return _rec(spark, d)


@query("D02_reconcile_summary", "both:i a_only:i b_only:i exact:i mae:f max_abs:f coverage:f", """
SELECT count(*) FILTER (presence='BOTH') AS both, count(*) FILTER (presence='A_ONLY') a_only,
 count(*) FILTER (presence='B_ONLY') b_only, count(*) FILTER (same_metric) exact, avg(abs(delta_metric)) mae,
 max(abs(delta_metric)) max_abs, avg((presence='BOTH')::INT) coverage FROM rec""", REC)
def _(spark, d):
    return J.reconcile_summary(_rec(spark, d))


for _p, _c in (("mismatch", "presence='BOTH' AND NOT same_metric"), ("a_only", "presence='A_ONLY'")):
    @query(f"D03_reconcile_{_p}", "day:d entity_id:i metric_a:f metric_b:f", f"SELECT * FROM rec WHERE {_c}", REC)
    def _(spark, d, _p=_p):
        return J.reconcile_parts(_rec(spark, d), _p)


@query("D03_reconcile_b_only", "day:d entity_id:i metric_a:f metric_b:f", """
SELECT day, entity_id, NULL metric_a, metric metric_b FROM panel WHERE entity_id%17=0""", P)
def _(spark, d):
    return J.reconcile_parts(J.reconcile(shuffled_second(spark, d), panel(spark, d)), "b_only")


@query("D04_inventory_diff", "entity_id:i old_label:s new_label:s classification:s", """
SELECT coalesce(a.entity_id,b.entity_id) entity_id, a.label old_label, b.label new_label,
 CASE WHEN a.label IS NULL THEN 'added' WHEN b.label IS NULL THEN 'removed' WHEN a.label<>b.label THEN 'renamed'
 ELSE 'unchanged' END classification FROM (SELECT * FROM panel WHERE day=DATE '2024-01-10') a
FULL JOIN (SELECT * FROM panel WHERE day=DATE '2024-01-11') b USING (entity_id)""", P)
def _(spark, d):
    p = panel(spark, d)
    return J.inventory_diff(p.where("day = DATE '2024-01-10'"), p.where("day = DATE '2024-01-11'"))


@query("D04_inventory_change_days", "day:d prev_day:d added:i removed:i renamed:i unchanged:i change_rate:f status:s", """
SELECT day, prev_day, added, removed, renamed, unchanged, (added+removed+renamed)/previous change_rate,
 CASE WHEN added+removed+renamed>0 THEN 'CHANGED' ELSE 'UNCHANGED' END status FROM (
 SELECT coalesce(c.day, o.day) AS day, coalesce(c.day, o.day)-1 prev_day, count(*) FILTER (o.label IS NULL) added,
  count(*) FILTER (c.label IS NULL) removed, count(*) FILTER (c.label<>o.label) renamed,
  count(*) FILTER (c.label=o.label) unchanged, count(o.label) previous
 FROM (SELECT * FROM panel WHERE day>(SELECT min(day) FROM panel)) c
 FULL JOIN (SELECT day+1 AS day, entity_id, label FROM panel WHERE day<(SELECT max(day) FROM panel)) o
  ON c.day=o.day AND c.entity_id=o.entity_id GROUP BY 1)""", P)
def _(spark, d):
    return J.inventory_change_days(panel(spark, d))


EV = S.chain(P, """ev AS (SELECT entity_id, day, old_label, label new_label FROM (SELECT *, lag(label) OVER e AS old_label,
 lag(day) OVER e AS pd FROM panel WINDOW e AS (PARTITION BY entity_id ORDER BY day)) WHERE day-pd=1 AND label<>old_label)""")


@query("D05_change_events", "entity_id:i day:d old_label:s new_label:s", "SELECT * FROM ev", EV)
def _(spark, d):
    return WN.change_events(panel(spark, d))


@query("D06_asof_event", "day:d entity_id:i label:s change_day:d days_since:f", """
SELECT day, entity_id, label, CASE WHEN nl=label THEN ed END change_day, CASE WHEN nl=label THEN day-ed END days_since FROM (
 SELECT p.day, p.entity_id, p.label, e.day ed, e.new_label nl FROM panel p ASOF LEFT JOIN ev e
 ON p.entity_id=e.entity_id AND p.day>=e.day)""", EV)
def _(spark, d):
    p = panel(spark, d)
    return J.asof_event(p, WN.change_events(p))


@query("D07_left_join_checked", "day:d entity_id:i day_mean:f", """
SELECT day, entity_id, avg(metric) OVER (PARTITION BY day) day_mean FROM panel""", P)
def _(spark, d):
    p = panel(spark, d)
    return J.left_join_checked(p, p.groupBy(*DAY).agg(F.avg("metric").alias("day_mean")), DAY)


LAY = S.chain(P, S.LAYOUT)


@query("D08_with_layout", "island_id:s side:s shape:s n:i mean:f", """
SELECT island_id, side, shape, count(*) n, avg(metric) mean FROM panel JOIN layout USING (entity_id) GROUP BY 1, 2, 3""", LAY)
def _(spark, d):
    p = panel(spark, d)
    return J.with_layout(p, PN.layout_of(p)).groupBy("island_id", "side", "shape").agg(
        F.count(F.lit(1)).alias("n"), F.avg("metric").alias("mean"))


for _n, _op in (("restrict", "IN"), ("outside", "NOT IN")):
    @query(f"D09_{_n}", "day:d entity_id:i metric:f", f"""
SELECT day, entity_id, metric FROM panel WHERE entity_id {_op} (SELECT entity_id FROM panel GROUP BY 1 HAVING count(*)>=27)""", P)
    def _(spark, d, _n=_n):
        p = panel(spark, d)
        often = p.groupBy(*ENTITY).agg(F.count(F.lit(1)).alias("n")).where("n >= 27")
        return getattr(J, _n)(p, often, ENTITY)


MDAILY = S.chain(PMODES, S.picks("modes", "mpicks", 10, "model, day"), POP,
                 "mdaily AS (" + eval_sql("mpicks", "model", [("TOP10", 1, 10), ("TOP5", 1, 5)]) + ")")


def mode_picks(spark, d, n=10):
    """Top n per day under every weight mode."""
    from dayloom.operators import ordering as O
    return O.top_n(SC.score_modes(feats(spark, d), SC.MODES), [*DAY, "model"], SC.best_first(), n)


def mode_daily(spark, d):
    return A.evaluate_topn(mode_picks(spark, d), panel(spark, d), [("TOP10", 1, 10), ("TOP5", 1, 5)], by=["model"])


MPAIRS = S.chain(MDAILY, """mpairs AS (SELECT c.day, c.band, c.model, c.mean, c.total, b.mean base_mean, b.total base_total,
 c.total-b.total change FROM mdaily c JOIN mdaily b ON c.day=b.day AND c.band=b.band AND b.model='BASE' AND c.model<>'BASE')""")


@query("D10_pair_models", "day:d band:s model:s mean:f base_mean:f total:f base_total:f change:f", "SELECT * FROM mpairs",
       MPAIRS)
def _(spark, d):
    return J.pair_models(mode_daily(spark, d), "BASE")


@query("D11_common_keys", "day:d entity_id:i score_base:f score_edge:f", """
SELECT a.day, a.entity_id, a.score score_base, b.score score_edge FROM mpicks a JOIN mpicks b
ON a.day=b.day AND a.entity_id=b.entity_id AND a.model='BASE' AND b.model='ADD_EDGE'""",
       S.chain(PMODES, S.picks("modes", "mpicks", 10, "model, day")))
def _(spark, d):
    m = mode_picks(spark, d)
    return J.common_keys({"base": m.where("model='BASE'"), "edge": m.where("model='ADD_EDGE'")}, KEY, "score")


CATSQL = """catp AS (SELECT *, CASE WHEN label='purchase' THEN 'SALES' WHEN label IN ('error','login') THEN 'SYSTEM'
 ELSE 'NORMAL' END category FROM scored),
r_all AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY day ORDER BY score DESC, entity_id) AS rank FROM scored)
 WHERE rank<=10),
r_cat AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY day, category ORDER BY score DESC, entity_id) AS rank
 FROM catp) WHERE rank<=10)"""


@query("D12_integrate_rankings", "day:d entity_id:i label:s rank_all:f rank_sales:f rank_system:f overlap:i selected_by:s", """
SELECT *, (rank_all IS NOT NULL)::INT+(rank_sales IS NOT NULL)::INT+(rank_system IS NOT NULL)::INT overlap,
 concat_ws('+', CASE WHEN rank_all IS NOT NULL THEN 'ALL' END, CASE WHEN rank_sales IS NOT NULL THEN 'SALES' END,
  CASE WHEN rank_system IS NOT NULL THEN 'SYSTEM' END) selected_by FROM (
 SELECT day, entity_id, any_value(label) label, min(rank) FILTER (k='ALL') rank_all, min(rank) FILTER (k='SALES') rank_sales,
  min(rank) FILTER (k='SYSTEM') rank_system FROM (SELECT day, entity_id, label, rank, 'ALL' k FROM r_all UNION ALL
  SELECT day, entity_id, label, rank, category FROM r_cat WHERE category<>'NORMAL') GROUP BY 1, 2)""", S.chain(PSC, CATSQL))
def _(spark, d):
    scored = SC.score(feats(spark, d, ()), SC.BASE_WEIGHTS)
    cats = SC.category_rank(scored, CATS).withColumnRenamed("category_rank", "rank")
    from dayloom.operators import ordering as O
    return J.integrate_rankings({
        "ALL": O.top_n(scored, DAY, SC.best_first(), 10), "SALES": cats.where("category='SALES'"),
        "SYSTEM": cats.where("category='SYSTEM'")})


PJ = S.chain(PMODES, S.picks("modes", "mpicks", 10, "model, day"), """pj AS (SELECT coalesce(a.day,b.day) AS day,
 coalesce(a.entity_id,b.entity_id) entity_id, coalesce(b.label,a.label) label, coalesce(b.metric,a.metric) metric,
 CASE WHEN a.day IS NULL THEN 'ENTERED' WHEN b.day IS NULL THEN 'REMOVED' ELSE 'BOTH' END kind
 FROM (SELECT * FROM mpicks WHERE model='BASE') a FULL JOIN (SELECT * FROM mpicks WHERE model='ADD_BAND_10') b
 ON a.day=b.day AND a.entity_id=b.entity_id),
povl AS (SELECT *, entered_total-removed_total replacement_delta FROM (SELECT day, count(*) FILTER (kind='BOTH') overlap,
 count(*) FILTER (kind='ENTERED') entered, count(*) FILTER (kind='REMOVED') removed,
 coalesce(sum(metric) FILTER (kind='ENTERED'),0) entered_total, coalesce(sum(metric) FILTER (kind='REMOVED'),0) removed_total
 FROM pj GROUP BY 1))""")


def two_models(spark, d):
    from dayloom.session import materialise
    m = materialise(mode_picks(spark, d))
    return m.where("model='BASE'"), m.where("model='ADD_BAND_10'")


@query("D13_pick_overlap", "day:d overlap:i entered:i removed:i entered_total:f removed_total:f replacement_delta:f",
       "SELECT * FROM povl", PJ)
def _(spark, d):
    return J.pick_overlap(*two_models(spark, d))


@query("D14_replacement_detail", "kind:s label:s n:i total:f mean:f win_rate:f", """
SELECT kind, label, count(*) n, sum(metric) total, avg(metric) mean, avg((metric>0)::INT) win_rate FROM pj
WHERE kind<>'BOTH' GROUP BY 1, 2""", PJ)
def _(spark, d):
    return J.replacement_detail(*two_models(spark, d))


@query("D15_agreement", "day:d same:b common:i only_a:s only_b:s", """
SELECT day, count(*) FILTER (kind<>'BOTH')=0 same, count(*) FILTER (kind='BOTH') common,
 coalesce(string_agg(entity_id::VARCHAR, ',' ORDER BY entity_id) FILTER (kind='REMOVED'), '') only_a,
 coalesce(string_agg(entity_id::VARCHAR, ',' ORDER BY entity_id) FILTER (kind='ENTERED'), '') only_b FROM pj GROUP BY 1""", PJ)
def _(spark, d):
    return J.agreement(*two_models(spark, d))


SPLITS = [(i + 1, f"2024-01-{8 + 4 * i:02d}", f"2024-01-{11 + 4 * i:02d}") for i in range(6)]
SPLIT_SQL = "splits AS (SELECT * FROM (VALUES " + ", ".join(
    f"({b}, DATE '{a}', DATE '{e}')" for b, a, e in SPLITS) + ") v(block, start_day, end_day))"


def splits(spark):
    return spark.createDataFrame(SPLITS, "block int, a string, b string").select(
        "block", F.to_date("a").alias("start_day"), F.to_date("b").alias("end_day"))


@query("D16_assign_blocks", "block:i n:i mean:f first_day:d last_day:d", """
SELECT block, count(*) n, avg(metric) mean, min(day) first_day, max(day) last_day FROM panel
JOIN splits ON day BETWEEN start_day AND end_day GROUP BY 1""", S.chain(P, SPLIT_SQL))
def _(spark, d):
    return J.assign_blocks(panel(spark, d), splits(spark)).groupBy("block").agg(
        F.count(F.lit(1)).alias("n"), F.avg("metric").alias("mean"), F.min("day").alias("first_day"),
        F.max("day").alias("last_day"))


@query("D17_grid", "mode:s threshold:f rep:i n:i hits:i", """
SELECT mode, threshold, rep, count(*) n, count(*) FILTER (CASE WHEN mode='UP' THEN metric>=threshold ELSE metric<=-threshold END)
 hits FROM panel, (SELECT unnest(['UP','DOWN']) AS mode), (SELECT unnest([50.0,100.0,200.0]) threshold),
 (SELECT unnest([1,2]) rep) GROUP BY 1, 2, 3""", P)
def _(spark, d):
    g = J.grid(panel(spark, d), mode=["UP", "DOWN"], threshold=[50.0, 100.0, 200.0], rep=[1, 2])
    hit = F.when(F.col("mode") == "UP", F.col("metric") >= F.col("threshold")).otherwise(
        F.col("metric") <= -F.col("threshold"))
    return g.groupBy("mode", "threshold", "rep").agg(F.count(F.lit(1)).alias("n"), F.count_if(hit).alias("hits"))


PASTF = "ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING"


@query("D18_with_fallback", "day:d entity_id:i prior:f source:s", f"""
SELECT day, entity_id, coalesce(own, lab, st) prior, CASE WHEN own IS NOT NULL THEN 'OWN' WHEN lab IS NOT NULL THEN 'LABEL'
 WHEN st IS NOT NULL THEN 'SITE' ELSE 'NONE' END source FROM (SELECT *, avg(metric) OVER (PARTITION BY entity_id, label
 ORDER BY day {PASTF}) own FROM panel) JOIN (SELECT label, day, sum(s) OVER w/sum(c) OVER w AS lab FROM (SELECT label, day,
 sum(metric) s, count(*) c FROM panel GROUP BY 1, 2) WINDOW w AS (PARTITION BY label ORDER BY day {PASTF})) USING (label, day)
JOIN (SELECT day, sum(s) OVER w/sum(c) OVER w AS st FROM (SELECT day, sum(metric) s, count(*) c FROM panel GROUP BY 1)
 WINDOW w AS (ORDER BY day {PASTF})) USING (day)""", P)
def _(spark, d):
    return J.with_fallback(panel(spark, d))


@query("D19_blend", "day:d entity_id:i alpha:f blended:f", f"""
SELECT day, entity_id, alpha, (1-alpha)*clean+alpha*legacy blended FROM (SELECT day, entity_id,
 avg(metric) OVER (PARTITION BY entity_id ORDER BY day {PASTF}) legacy,
 coalesce(avg(metric) OVER (PARTITION BY entity_id, epoch ORDER BY day {PASTF}),
  avg(metric) OVER (PARTITION BY entity_id ORDER BY day {PASTF})) clean FROM ep), (SELECT unnest([0.0,0.25,0.5,0.75,1.0]) alpha)
WHERE legacy IS NOT NULL""", PE)
def _(spark, d):
    return J.blend(J.clean_and_legacy(panel(spark, d)), "clean", "legacy", [0.0, 0.25, 0.5, 0.75, 1.0])


@query("D20_adjacent", "day:d entity_id:i island_id:s metric_1:f metric_2:f metric_4:f", """
SELECT a.day, a.entity_id, a.island_id, b.metric metric_1, c.metric metric_2, e.metric metric_4 FROM pl a
LEFT JOIN pl b ON a.day=b.day AND a.island_id=b.island_id AND b.slot_index=a.slot_index+1
LEFT JOIN pl c ON a.day=c.day AND a.island_id=c.island_id AND c.slot_index=a.slot_index+2
LEFT JOIN pl e ON a.day=e.day AND a.island_id=e.island_id AND e.slot_index=a.slot_index+4""",
       S.chain(LAY, "pl AS (SELECT * FROM panel JOIN layout USING (entity_id))"))
def _(spark, d):
    p = panel(spark, d)
    return J.adjacent(J.with_layout(p, PN.layout_of(p)), [1, 2, 4], ["metric"], [*DAY, "island_id"])


@query("D21_condition_compare", "model:s condition:s pairs:i mean_change:f total_change:f better_rate:f", """
SELECT model, CASE WHEN isodow(day)>=6 THEN 'OFF' ELSE 'WORK' END condition, count(*) pairs, avg(change) mean_change,
 sum(change) total_change, avg((change>0)::INT) better_rate FROM mpairs WHERE band='TOP10' GROUP BY 1, 2""", MPAIRS)
def _(spark, d):
    pairs = J.pair_models(mode_daily(spark, d), "BASE").where("band = 'TOP10'")
    return J.condition_compare(pairs, F.when(F.weekday("day") >= 5, "OFF").otherwise("WORK"))
