"""Registered queries: back-tests."""

from dayloom import panel as PN
from dayloom.operators import aggregates as A
from dayloom.operators import backtest as B
from dayloom.operators import features as FT
from dayloom.operators import joins as J
from dayloom.operators import quality as Q
from dayloom.operators import resampling as R
from dayloom.operators import scoring as SC
from dayloom.operators import windows as WN
from dayloom.panel import DAY, KEY, LABEL, SITE, table
from dayloom.plans import sql as S
from dayloom.plans.aggregates import PD
from dayloom.plans.common import F, daily, panel
from dayloom.plans.joins import MDAILY, MPAIRS, PJ, SPLIT_SQL, mode_daily, splits, two_models
from dayloom.plans.registry import query
from dayloom.plans.scoring import PF, PICKS, POP, PSC, WDM, _bl, _fill, bands_sql, eval_sql, feats, picks
from dayloom.session import materialise

P = S.PANEL


# ---- J01-J02 ----------------------------------------------------------------

@query("J01_rolling_oos", "model:s band:s days:i mean:f total:f positive_days:f min_split_mean:f positive_splits:f", """
SELECT * FROM (SELECT model, band, count(*) AS days, avg(mean) mean, sum(total) total, avg((total>0)::INT) positive_days
 FROM mdaily JOIN splits ON day BETWEEN start_day AND end_day GROUP BY 1, 2) JOIN (
 SELECT model, band, min(m) min_split_mean, avg((t>0)::INT) positive_splits FROM (SELECT block, model, band, avg(mean) m,
  sum(total) t FROM mdaily JOIN splits ON day BETWEEN start_day AND end_day GROUP BY 1, 2, 3) GROUP BY 1, 2)
 USING (model, band)""", S.chain(MDAILY, SPLIT_SQL))
def _(spark, d):
    bands = [("TOP10", 1, 10), ("TOP5", 1, 5)]
    return B.rolling_oos(materialise(B.daily_models(materialise(panel(spark, d)), SC.MODES, bands)), splits(spark))


@query("J01_split_summary", "block:i model:s band:s days:i mean:f win_rate:f total:f positive_days:f", """
SELECT block, model, band, count(*) AS days, avg(mean) mean, avg(win_rate) win_rate, sum(total) total,
 avg((total>0)::INT) positive_days FROM mdaily JOIN splits ON day BETWEEN start_day AND end_day GROUP BY 1, 2, 3""",
       S.chain(MDAILY, SPLIT_SQL))
def _(spark, d):
    return B.split_summary(mode_daily(spark, d), splits(spark))


WF = S.chain(P, WDM, f"""wfx AS (SELECT *, ({_bl})/5.0 blend FROM (SELECT day, entity_id, metric, dr, {_fill} FROM (
 SELECT day, entity_id, metric, dense_rank() OVER (ORDER BY day) dr,
 avg(metric) OVER (e ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) avg_all,
 avg((metric>=100)::INT) OVER (e ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) rate1,
 avg(metric) OVER (e ROWS BETWEEN 7 PRECEDING AND 1 PRECEDING) recent7,
 avg((metric>0)::INT) OVER (e ROWS BETWEEN 7 PRECEDING AND 1 PRECEDING) recent7_win, raw_mean weekday_mean
 FROM wdm WINDOW e AS (PARTITION BY entity_id ORDER BY day))) WINDOW d AS (PARTITION BY day)),
wfm AS (SELECT day, entity_id, metric, 'BLEND' AS model, round(blend,9) score FROM wfx WHERE dr>7 UNION ALL
 SELECT day, entity_id, metric, 'AVERAGE', round(avg_all,9) FROM wfx WHERE dr>7 UNION ALL
 SELECT day, entity_id, metric, 'RECENT7', round(recent7,9) FROM wfx WHERE dr>7 UNION ALL
 SELECT day, entity_id, metric, 'WEEKDAY', round(weekday_mean,9) FROM wfx WHERE dr>7)""",
             S.picks("wfm", "wfp", 10, "day, model"), POP)


@query("J02_walk_forward", "model:s day:d n:i mean:f win_rate:f total:f excess:f",
       eval_sql("wfp", "model", [("TOP", 1, 10)]), WF)
def _(spark, d):
    return B.walk_forward(materialise(panel(spark, d)), 7)


# ---- J03-J04 -----------------------------------------------------------------

BLK = S.chain(PICKS, POP, "rdaily AS (" + eval_sql("picks", bands=B.RULES) + ")", """
blk AS (SELECT block, band AS rule, count(*) AS n_days, avg(mean) mean, sum(total) total, sum(n) n FROM rdaily JOIN (
 SELECT day, (row_number() OVER (ORDER BY day)-1)//4+1 AS block FROM (SELECT DISTINCT day FROM rdaily)) USING (day)
 GROUP BY 1, 2),
ada AS (SELECT block, rule selected_rule, prior_blocks, mean, total, n, CASE WHEN prior_blocks=0 THEN 'NO_PRIOR' ELSE
 'PRIOR_BEST' END reason FROM (SELECT *, row_number() OVER (PARTITION BY block ORDER BY pm DESC NULLS LAST,
  pt DESC NULLS LAST, pp DESC NULLS LAST, o) r FROM (SELECT *, round(avg(mean) OVER w, 9) pm, round(sum(total) OVER w, 9) pt,
  sum((mean>0)::INT) OVER w AS pp, count(mean) OVER w AS prior_blocks,
  list_position(['TOP10','TOP4_10','TOP4_5','TOP4_8','TOP5_10','TOP6_10'], rule) o FROM blk
  WINDOW w AS (PARTITION BY rule ORDER BY block ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING))) WHERE r=1)""")


def rule_daily(spark, d):
    return A.evaluate_topn(picks(spark, d), panel(spark, d), B.RULES)


def blocks(spark, d):
    """One row per (rule, block): small, and read several times below."""
    return materialise(B.rule_blocks(rule_daily(spark, d)))


@query("J03_adaptive_select", "block:i selected_rule:s prior_blocks:i mean:f total:f reason:s", "SELECT * FROM ada", BLK)
def _(spark, d):
    return B.adaptive_select(blocks(spark, d))


@query("J03_adaptive_summary", "rule:s blocks:i mean:f total:f positive_blocks:f per_entity:f", """
SELECT rule, count(*) blocks, avg(mean) mean, sum(total) total, avg((mean>0)::INT) positive_blocks, sum(total)/sum(n) per_entity
FROM (SELECT rule, mean, total, n FROM blk UNION ALL SELECT 'ADAPTIVE', mean, total, n FROM ada) GROUP BY 1""", BLK)
def _(spark, d):
    return B.adaptive_summary(blocks(spark, d))


EDG = S.chain(BLK, """edg AS (SELECT *, count(edge) OVER (w ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) prior_blocks,
 lag(edge) OVER w AS pl, avg(edge) OVER (w ROWS BETWEEN 2 PRECEDING AND 1 PRECEDING) p2,
 avg(edge) OVER (w ROWS BETWEEN 3 PRECEDING AND 1 PRECEDING) p3 FROM (SELECT block,
 max(total) FILTER (rule='TOP4_5') rt, max(total) FILTER (rule='TOP10') bt,
 round(max(mean) FILTER (rule='TOP4_5')-max(mean) FILTER (rule='TOP10'), 9) edge FROM blk GROUP BY 1)
 WINDOW w AS (ORDER BY block))""")
_PRIOR = {"prior_last": "pl", "prior_last2": "p2", "prior_last3": "p3"}
_CANDS = {B.switch_name(f, v): " AND ".join(f"{_PRIOR[x]}>={v * 100:g}" if v else f"{_PRIOR[x]}>0" for x in f) for f, v in B.SWITCHES}


@query("J04_switch_candidates", "candidate:s blocks:i switches:i total:f base_total:f gain:f mean_gain:f good:i bad:i",
       "\nUNION ALL ".join(f"""SELECT '{n}' candidate, count(*) blocks, count(*) FILTER (s) switches,
 sum(CASE WHEN s THEN rt ELSE bt END) total, sum(bt) base_total, sum(CASE WHEN s THEN rt-bt ELSE 0 END) gain,
 avg(rt-bt) FILTER (s) mean_gain, count(*) FILTER (s AND rt>bt) good, count(*) FILTER (s AND rt<bt) bad
FROM (SELECT *, coalesce(prior_blocks>=2 AND {c}, false) s FROM edg)""" for n, c in _CANDS.items()), EDG)
def _(spark, d):
    return B.switch_candidates(B.edge_blocks(blocks(spark, d)))


# ---- J05-J09 -------------------------------------------------------------------

K, BOOT = 3000, 20_000  # weight vectors, bootstrap replicates
FACT = sorted(SC.BASE_WEIGHTS)
WV = "wv AS (SELECT i::VARCHAR AS model, " + ", ".join(
    f"-ln(1-{S.u('i', repr(f), repr('w'))}) r_{f}" for f in FACT) + f" FROM (SELECT unnest(range({K})) i)),\nwn AS (SELECT *, " \
    + "+".join(f"r_{f}" for f in FACT) + " rt FROM wv)"
OBJ = S.chain(PF, S.components(FACT), POP, WV, f"""wsp AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY model, day
 ORDER BY score DESC, entity_id) AS rank FROM (SELECT model, day, entity_id, metric, round({' + '.join(
    f'k_{f}*(r_{f}/rt)' for f in FACT)}, 9) score FROM comps, wn)) WHERE rank<=30),
obj AS (SELECT *, lift1*0.4+lift2*0.25+(mean1>0)::INT*100*5*0.2+(mean2>0)::INT*100*5*0.15 objective FROM (
 SELECT model, day, avg(metric) FILTER (rank<=10) mean1, avg(metric) mean2, avg(metric) FILTER (rank<=10)-any_value(pop_mean) lift1,
 avg(metric)-any_value(pop_mean) lift2 FROM wsp JOIN pop USING (day) GROUP BY 1, 2)),
wrank AS (SELECT *, row_number() OVER (ORDER BY objective DESC, model::INT) AS position FROM (SELECT model, count(*) AS n_days,
 avg(lift1) lift1, avg(lift2) lift2, round(avg(objective), 9) objective FROM obj GROUP BY 1))""")


def objective(spark, d):
    p = materialise(panel(spark, d))
    f = materialise(FT.rank_features(p, extras=()))
    return B.daily_objective(f, B.random_weights(spark, K, FACT), FACT, p, 10, 30)


@query("J05_weight_search", "model:s lift1:f lift2:f objective:f position:i", "SELECT * FROM wrank", OBJ)
def _(spark, d):
    return B.weight_search(objective(spark, d))


@query("J06_walk_forward_weights", "day:d model:s train_days:i train_objective:f mean1:f lift1:f", """
SELECT day, model, train_days, train_objective, mean1, lift1 FROM (SELECT *, row_number() OVER (PARTITION BY day
 ORDER BY train_objective DESC, model::INT) r FROM (SELECT *, count(*) OVER w AS train_days,
 round(avg(objective) OVER w, 9) train_objective FROM obj WINDOW w AS (PARTITION BY model ORDER BY day
 ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)) WHERE train_days>=5) WHERE r=1""", OBJ)
def _(spark, d):
    return B.walk_forward_weights(objective(spark, d))


@query("J07_overfit_gap", "model:s band:s train_mean:f test_mean:f gap:f", """
SELECT model, band, avg(mean) FILTER (day<DATE '2024-01-16') train_mean, avg(mean) FILTER (day>=DATE '2024-01-16') test_mean,
 avg(mean) FILTER (day<DATE '2024-01-16')-avg(mean) FILTER (day>=DATE '2024-01-16') gap FROM mdaily GROUP BY 1, 2""", MDAILY)
def _(spark, d):
    return B.overfit_gap(mode_daily(spark, d), "2024-01-16")


@query("J08_robust_factors", "factor:s mean_weight:f group_sd:f pattern_sd:f high_rate:f very_high_rate:f robust:f", """
SELECT *, mean_weight*100+high_rate*0.2+very_high_rate*0.1-group_sd*100-pattern_sd*50 robust FROM (
 SELECT factor, avg(m) mean_weight, stddev_pop(m) group_sd, avg(s) pattern_sd, avg(h) high_rate, avg(v) very_high_rate FROM (
 SELECT g, factor, avg(weight) m, stddev_pop(weight) s, 100*avg((weight>=0.1)::INT) h, 100*avg((weight>=0.15)::INT) v
 FROM (""" + " UNION ALL ".join(f"SELECT position, '{f}' factor, r_{f}/rt weight FROM wrank JOIN wn USING (model)" for f in FACT)
       + """), (SELECT unnest([5,10,20]) g) WHERE position<=g GROUP BY 1, 2) GROUP BY 1)""", OBJ)
def _(spark, d):
    return B.robust_factors(B.weight_search(objective(spark, d)), B.random_weights(spark, K, FACT), FACT)


BASELINES = 5000  # random sets of a day


@query("J09_random_baseline", "day:d reps:i random_mean:f pick_mean:f percentile:f", """
SELECT day, count(*) reps, avg(sm) random_mean, max(pm) pick_mean, avg((sm<pm)::INT) percentile FROM (
 SELECT day, rep, round(avg(metric),9) sm FROM dealt JOIN numbered USING (day, x) WHERE rep>0 GROUP BY 1, 2)
JOIN (SELECT day, round(avg(metric),9) pm FROM picks GROUP BY 1) USING (day) GROUP BY 1""",
       S.chain(PICKS, "numbered AS (SELECT day, metric, row_number() OVER (PARTITION BY day ORDER BY entity_id) - 1 AS x FROM panel)",
               "flagged AS (SELECT day, entity_id, true strong FROM panel)", S.deal("flagged", BASELINES, "day", "entity_id", "r", "dealt", 10)))
def _(spark, d):
    return B.random_baseline(panel(spark, d), picks(spark, d), BASELINES)


# ---- J22-J25 ---------------------------------------------------------------------

LOO = """SELECT {k} unit, {v} AS value, (sum({v}) OVER ({w})-{v})/nullif(count(*) OVER ({w})-1,0) mean_without,
 sum({v}) OVER ({w})-{v} total_without, sign(round(sum({v}) OVER ({w})-{v},9))<>sign(round(sum({v}) OVER ({w}),9)) flips"""


@query("J22_leave_one_day_out", "model:s day:d value:f mean_without:f total_without:f flips:b",
       LOO.format(k="model, day AS", v="total", w="PARTITION BY model").replace("AS unit", "AS day, day AS unit")
       + " FROM mdaily WHERE band='TOP10'", MDAILY)
def _(spark, d):
    return B.leave_one_out(mode_daily(spark, d).where("band = 'TOP10'"), "day", "total", [*SITE, "model"])


for _u, _e in (("label", "label"), ("island_id", "island_id")):
    @query(f"J23_leave_{_u}_out", f"{_u}:s removed:i mean_without:f", f"""
SELECT {_u}, count(*) removed, (any_value(s)-sum(metric))/nullif(any_value(n)-count(*),0) mean_without
FROM panel JOIN layout USING (entity_id), (SELECT sum(metric) s, count(*) n FROM panel) GROUP BY 1""", S.chain(P, S.LAYOUT))
    def _(spark, d, _u=_u):
        p = panel(spark, d)
        return B.leave_group_out(J.with_layout(p, PN.layout_of(p)), _u)


COR = S.chain(P, S.LAYOUT, """cor AS (SELECT *, slot_index IN (0, 6, 8, 20) corner, slot_index IN (6, 8) gap_adjacent
 FROM panel JOIN layout USING (entity_id) WHERE shape='rect')""")


def corners(spark, d):
    p = panel(spark, d)
    x = J.with_layout(p, PN.layout_of(p)).where("shape = 'rect'")
    return x.withColumns({"corner": F.col("slot_index").isin(0, 6, 8, 20), "gap_adjacent": F.col("slot_index").isin(6, 8)})


def eff_sql(strata="", by="day", src="cor"):
    g = f"{by}, {strata}" if strata else by
    return f"""SELECT {by}, count(*) strata, sum(n) AS rows, sum(e*n)/sum(n) effect FROM (SELECT {g}, count(*) n,
 avg(metric) FILTER (corner)-avg(metric) FILTER (NOT corner) e FROM {src} GROUP BY {g}) WHERE e IS NOT NULL GROUP BY {by}"""


for _n, _s in (("raw", ""), ("segment", "island_id"), ("label", "label"), ("within_label_segment", "label, island_id")):
    @query(f"J24_effect_{_n}", "day:d strata:i rows:i effect:f", eff_sql(_s), COR)
    def _(spark, d, _s=_s):
        return B.effect(corners(spark, d), "corner", [x.strip() for x in _s.split(",") if x])


_SCN = {"NONE": "true", "EXCLUDE_GAP_ADJACENT": "NOT gap_adjacent", "EXCLUDE_ISLAND_0": "island_id<>'0'",
        "EXCLUDE_LABEL_VIEW": "label<>'view'"}


@query("J25_effect_sensitivity", "scenario:s days:i mean_effect:f positive_days:f lo:f hi:f", "\nUNION ALL ".join(
    f"SELECT '{n}' scenario, count(*) AS days, avg(effect) mean_effect, avg((effect>0)::INT) positive_days, min(effect) lo, "
    f"max(effect) hi FROM ({eff_sql('island_id', src=f'(SELECT * FROM cor WHERE {c})')}) HAVING count(*)>0" for n, c in _SCN.items()), COR)
def _(spark, d):
    return B.effect_sensitivity(corners(spark, d), "corner", {n: F.expr(c) for n, c in _SCN.items()}, ["island_id"])


@query("J25_effect_time_blocks", "time_block:i days:i mean_effect:f positive_days:f lo:f hi:f", f"""
SELECT tb time_block, count(*) AS days, avg(effect) mean_effect, avg((effect>0)::INT) positive_days, min(effect) lo,
 max(effect) hi FROM (SELECT effect, ntile(4) OVER (ORDER BY day) tb FROM ({eff_sql('island_id')})) GROUP BY 1""", COR)
def _(spark, d):
    e = B.equal_blocks(B.effect(corners(spark, d), "corner", ["island_id"]), 4)
    return B.effect_summary(e, [*SITE, "time_block"])


# ---- J26-J32 ----------------------------------------------------------------------

def boot_sql(src, by, value, reps, name, seed="b"):
    """bootstrap_means and bootstrap_ci over rows of ``src`` (one per group and day)."""
    keys = [k.strip() for k in by.split(",")] if by else []
    part = f"PARTITION BY {by} " if by else ""
    g = f"{by}, " if by else ""
    on = " AND ".join([f"a.{k}=v.{k}" for k in keys] + ["a.pick=v.i"])
    ak = "".join(f"a.{k}, " for k in keys)
    return f"""{name}_x AS (SELECT {g}day, {value} v, row_number() OVER ({part}ORDER BY day) i,
  count(*) OVER ({part}) n FROM {src} WHERE {value} IS NOT NULL),
{name}_d AS (SELECT *, floor({S.u(*keys, 'rep', 'i', repr(seed))}*n)::INT+1 AS pick FROM {name}_x,
  (SELECT unnest(range(1,{reps + 1})) rep)),
{name}_m AS (SELECT {ak}rep, avg(v.v) boot_mean FROM {name}_d a JOIN {name}_x v ON {on} GROUP BY ALL),
{name} AS (SELECT {g}quantile_cont(boot_mean,0.025) ci_low, quantile_cont(boot_mean,0.975) ci_high,
  avg((boot_mean>0)::INT) p_positive FROM {name}_m {'GROUP BY ' + by if by else ''})"""


CC = S.chain(MPAIRS, "cpair AS (SELECT day, model, round(change,9) change FROM mpairs WHERE band='TOP10')",
             boot_sql("cpair", "model", "change", BOOT, "ccb"))


@query("J26_champion_challenger", "model:s pairs:i better:i worse:i total_change:f ci_low:f ci_high:f status:s", """
SELECT *, CASE WHEN pairs<20 THEN 'ACCUMULATING' WHEN total_change>0 AND better>worse AND ci_low>0 THEN 'STRONG'
 WHEN total_change>0 THEN 'POSITIVE' ELSE 'NO_ADVANTAGE' END status FROM (SELECT model, count(*) pairs,
 count(*) FILTER (change>0) better, count(*) FILTER (change<0) worse, sum(change) total_change FROM cpair GROUP BY 1)
JOIN ccb USING (model)""", CC)
def _(spark, d):
    from dayloom.functions import expr as X
    pairs = J.pair_models(mode_daily(spark, d), "BASE").where("band = 'TOP10'")
    pairs = materialise(pairs.withColumn("change", X.rank_key(F.col("change"))))
    return B.champion_challenger(pairs, R.bootstrap_ci(pairs, [*SITE, "model"], "change", BOOT), 20)


XV = S.chain(PICKS, POP, "xdaily AS (" + eval_sql("picks") + ")", boot_sql("xdaily", "band", "excess", BOOT, "xvb"))


@query("J27_external_validation", "band:s days:i mean:f mean_lift:f positive_days:f reverses:i loo_min:f loo_max:f ci_low:f "
                                  "ci_high:f verdict:s", """
SELECT *, CASE WHEN mean_lift>0 AND ci_low>0 AND reverses=0 THEN 'CONFIRMED' WHEN mean_lift>0 AND reverses=0 THEN 'SUPPORTIVE'
 WHEN mean_lift>0 THEN 'FRAGILE' ELSE 'NOT_SUPPORTED' END verdict FROM (
 SELECT band, count(*) AS days, avg(mean) mean, avg(excess) mean_lift, avg((mean>0)::INT) positive_days, max(f) reverses,
  min(mw) loo_min, max(mw) loo_max FROM (SELECT *, (sum(excess) OVER w-excess)/nullif(count(*) OVER w-1,0) mw,
  (sign(round(sum(excess) OVER w-excess,9))<>sign(round(sum(excess) OVER w,9)))::INT f FROM xdaily
  WINDOW w AS (PARTITION BY band)) GROUP BY 1) JOIN xvb USING (band)""", XV)
def _(spark, d):
    from dayloom.plans.scoring import BANDS
    x = materialise(A.evaluate_topn(picks(spark, d), panel(spark, d), BANDS))
    return B.external_validation(x, R.bootstrap_ci(x, [*SITE, "band"], "excess", BOOT))


RST = S.chain(PICKS, POP, S.feats("panel2", name="feats2"),
              S.scored(SC.BASE_WEIGHTS, "feats2", "scored2"), S.picks("scored2", "picks2"))
EPO = """panel2 AS (SELECT * EXCLUDE (pl, epoch, le) FROM (SELECT *, max(epoch) OVER (PARTITION BY entity_id) le FROM (SELECT *,
 sum((pl IS NULL OR label<>pl)::INT) OVER (PARTITION BY entity_id ORDER BY day ROWS UNBOUNDED PRECEDING) epoch FROM (
 SELECT *, lag(label) OVER (PARTITION BY entity_id ORDER BY day) pl FROM panel))) WHERE epoch=le)"""


@query("J27_ab_compare", "day:d band:s a_mean:f b_mean:f change:f", f"""
SELECT a.day, a.band, a.mean a_mean, b.mean b_mean, b.total-a.total change FROM ({eval_sql('picks')}) a
JOIN ({eval_sql('picks2')}) b USING (day, band)""", RST.replace("x_feats2 AS", EPO + ",\nx_feats2 AS"))
def _(spark, d):
    from dayloom.plans.scoring import BANDS
    p = materialise(panel(spark, d))
    a = A.evaluate_topn(picks(spark, d), p, BANDS)
    reset = materialise(WN.reset_history(p).select(p.columns))
    f2 = materialise(FT.rank_features(reset, extras=()))
    b = A.evaluate_topn(SC.rank_score(f2, SC.BASE_WEIGHTS), p, BANDS)
    return B.ab_compare(a, b)


@query("J28_efficiency", "day:d scaled:f base_scaled:f improvement:f reduction:i result:s", """
SELECT a.day, a.mean*10 scaled, b.mean*10 base_scaled, (a.mean-b.mean)*10 improvement, b.n-a.n reduction,
 CASE WHEN round(a.mean-b.mean,9)>0 THEN 'BETTER' WHEN round(a.mean-b.mean,9)<0 THEN 'WORSE' ELSE 'TIE' END result
FROM rdaily a JOIN rdaily b ON a.day=b.day AND a.band='TOP4_5' AND b.band='TOP10'""", BLK)
def _(spark, d):
    r = materialise(rule_daily(spark, d))
    return B.efficiency(r.where("band = 'TOP4_5'"), r.where("band = 'TOP10'"))


@query("J28_block_summary", "block:i start:d end:d days:i total:f base_total:f difference:f mean:f base_mean:f entities:f base_entities:f scaled:f "
                            "base_scaled:f improvement:f", """
SELECT (a.day - (SELECT min(day) FROM rdaily)) // 7 + 1 AS block, min(a.day) AS start, max(a.day) AS "end", count(*) AS days, sum(a.mean*a.n) total, sum(b.mean*b.n) base_total,
 sum(a.mean*a.n) - sum(b.mean*b.n) difference, avg(a.mean) mean, avg(b.mean) base_mean, avg(a.n) entities, avg(b.n) base_entities,
 10*sum(a.mean) scaled, 10*sum(b.mean) base_scaled, 10*sum(a.mean-b.mean) improvement
FROM rdaily a JOIN rdaily b ON a.day=b.day AND a.band='TOP4_5' AND b.band='TOP10' GROUP BY 1""", BLK)
def _(spark, d):
    r = materialise(rule_daily(spark, d))
    first = r.agg(F.min("day")).first()[0]
    x = B.efficiency(r.where("band = 'TOP4_5'"), r.where("band = 'TOP10'"))
    return B.block_summary(x.withColumn("block", F.floor(F.datediff("day", F.lit(first)) / 7) + 1))


@query("J29_focus_dependence", "replacements:i focus_rows:i advantage:f focus_part:f without_focus:f focus_share:f", """
SELECT count(*) replacements, count(*) FILTER (f) focus_rows, sum(v) advantage, coalesce(sum(v) FILTER (f),0) focus_part,
 sum(v)-coalesce(sum(v) FILTER (f),0) without_focus, coalesce(sum(v) FILTER (f),0)/nullif(sum(v),0) focus_share FROM (
 SELECT CASE WHEN kind='ENTERED' THEN metric ELSE -metric END v, label='click' f FROM pj WHERE kind<>'BOTH') HAVING count(*)>0""", PJ)
def _(spark, d):
    return B.focus_dependence(J.pick_join(*two_models(spark, d)), F.col("label") == "click")


@query("J30_assessment", "band:s days:i mean:f level:s checkpoint:s", """
SELECT band, count(*) AS days, avg(mean) mean, CASE WHEN count(*)<20 THEN 'INSUFFICIENT' WHEN count(*)<45 THEN 'SHORT'
 WHEN count(*)<90 THEN 'REASONABLE' ELSE 'STRONGER' END AS level, 'day ' || count(*) || ' of ' || CASE WHEN count(*)<20 THEN 20
 WHEN count(*)<45 THEN 45 ELSE 90 END checkpoint FROM rdaily GROUP BY 1""", BLK)
def _(spark, d):
    return B.assessment(rule_daily(spark, d), by=[*SITE, "band"])


# Frozen picks: tomorrow's top ten of every day by recent form, before tomorrow's labels are known.
FRZ = S.chain(P, """fz AS (SELECT day, entity_id, label, row_number() OVER (PARTITION BY day ORDER BY round(m,9) DESC, entity_id)
 AS rank FROM (SELECT day+1 AS day, entity_id, label, avg(metric) OVER (PARTITION BY entity_id ORDER BY day
 ROWS BETWEEN 6 PRECEDING AND CURRENT ROW) m FROM panel)),
frozen AS (SELECT * FROM fz WHERE rank<=10)""")


def frozen(spark, d):
    from pyspark.sql import Window

    from dayloom.functions import expr as X
    from dayloom.operators import ordering as O
    w = Window.partitionBy("site", "entity_id").orderBy("day").rowsBetween(-6, 0)
    x = panel(spark, d).withColumn("score", X.rank_key(F.avg("metric").over(w))).withColumn("day", F.date_add("day", 1))
    return O.top_n(x, DAY, SC.best_first(), 10).select(*DAY, "entity_id", "label", "rank", "score")


@query("J31_evaluate_frozen", "day:d missing:i identity_mismatch:i status:s total:f wins:f", """
SELECT day, missing, identity_mismatch, CASE WHEN missing=0 AND identity_mismatch=0 THEN 'EVALUATED' ELSE 'REJECTED' END status,
 CASE WHEN missing=0 AND identity_mismatch=0 THEN t END total, CASE WHEN missing=0 AND identity_mismatch=0 THEN w END wins
FROM (SELECT f.day, count(*) FILTER (p.metric IS NULL) missing, count(*) FILTER (p.label<>f.label) identity_mismatch,
 sum(p.metric) t, count(*) FILTER (p.metric>0) w FROM frozen f LEFT JOIN panel p ON f.day=p.day AND f.entity_id=p.entity_id
 GROUP BY 1)""", FRZ)
def _(spark, d):
    return B.evaluate_frozen(frozen(spark, d), panel(spark, d))


@query("J31_evaluate_frozen_by_pick", "day:d matched:i total:f wins:i", """
SELECT f.day, count(*) matched, sum(p.metric) total, count(*) FILTER (p.metric>0) wins FROM frozen f
JOIN panel p ON f.day=p.day AND f.entity_id=p.entity_id AND f.label=p.label GROUP BY 1""", FRZ)
def _(spark, d):
    p = panel(spark, d).select(*KEY, "label", "metric")
    return frozen(spark, d).drop("metric").join(p, [*KEY, "label"]).groupBy("day").agg(
        F.count(F.lit(1)).alias("matched"), F.sum("metric").alias("total"),
        F.count_if(F.col("metric") > 0).alias("wins"))


@query("J32_coverage", "day:d picks:i actual_rows:i status:s", """
SELECT day, coalesce(n,0) picks, coalesce(a,0) actual_rows, CASE WHEN n IS NULL AND a IS NULL THEN 'NO_DATA'
 WHEN n IS NULL THEN 'NO_PREDICTION' WHEN a IS NULL THEN 'WAITING_ACTUAL' WHEN a<132 THEN 'ACTUAL_INCOMPLETE' ELSE 'EVALUATED'
 END status FROM (SELECT unnest(generate_series(min(day), max(day)+1, INTERVAL 1 DAY))::DATE AS day FROM panel)
LEFT JOIN (SELECT day, count(*) n FROM frozen GROUP BY 1) USING (day)
LEFT JOIN (SELECT day, count(*) a FROM panel GROUP BY 1) USING (day)""", FRZ)
def _(spark, d):
    p = panel(spark, d)
    return B.coverage(Q.calendar(p), frozen(spark, d), p, 132)
