"""Registered queries: feature panel, ranking and score families."""

from dayloom.functions import expr as X
from dayloom.operators import aggregates as A
from dayloom.operators import features as FT
from dayloom.operators import ordering as O
from dayloom.operators import scoring as SC
from dayloom.operators import windows as WN
from dayloom.panel import DAY, ENTITY, LABEL, SITE
from dayloom.plans import sql as S
from dayloom.session import materialise
from dayloom.plans.common import F, panel
from dayloom.plans.registry import query
from dayloom.plans.windows import EPOCH

P = S.PANEL
PF = S.chain(P, S.feats())
PSC = S.chain(PF, S.scored(SC.BASE_WEIGHTS))
PICKS = S.chain(PSC, S.picks())
ALL = FT.FACTORS + FT.EXTRA_FACTORS
MODE_FACTORS = sorted({f for w in SC.MODES.values() for f in w})
PCOMP = S.chain(PF, S.components(MODE_FACTORS))
PMODES = S.chain(PCOMP, S.models(SC.MODES))


def feats(spark, d, extras=FT.EXTRA_FACTORS):
    """Feature panel of all days; panel and features are each used several times, so each is written once."""
    return materialise(FT.rank_features(materialise(panel(spark, d)), extras=extras))


def picks(spark, d, n=10):
    return SC.rank_score(feats(spark, d, ()), SC.BASE_WEIGHTS, n)


BANDS = [("TOP1", 1, 1), ("TOP3", 1, 3), ("TOP5", 1, 5), ("TOP10", 1, 10), ("R4_5", 4, 5), ("R4_10", 4, 10),
         ("R6_10", 6, 10), ("R7_9", 7, 9)]


def bands_sql(bands=BANDS):
    return "(VALUES " + ", ".join(f"('{n}',{a},{b})" for n, a, b in bands) + ") v(band, lo, hi)"


POP = "pop AS (SELECT day, count(*) pop_n, avg(metric) pop_mean, avg((metric>0)::INT) pop_win FROM panel GROUP BY 1)"


def eval_sql(src, extra="", bands=BANDS):
    g = f"{extra}, " if extra else ""
    return f"""SELECT *, mean-pop_mean excess, win_rate/nullif(pop_win,0) win_lift FROM (
 SELECT day, {g}band, count(*) n, avg(metric) mean, median(metric) median, avg((metric>0)::INT) win_rate,
  avg((metric>=100)::INT) strong_rate, sum(metric) total FROM {src}, {bands_sql(bands)} WHERE rank BETWEEN lo AND hi
 GROUP BY ALL) JOIN pop USING (day)"""


EVAL_SPEC = ("day:d band:s n:i mean:f median:f win_rate:f strong_rate:f total:f pop_n:i pop_mean:f pop_win:f excess:f "
             "win_lift:f")


@query("I01_rank_features", "day:d entity_id:i label:s hist_n:i " + " ".join(f"{f}:f" for f in ALL),
       "SELECT * FROM feats", PF)
def _(spark, d):
    return feats(spark, d)


@query("I02_rank_score", "day:d rank:i entity_id:i label:s score:f metric:f", "SELECT * FROM picks", PICKS)
def _(spark, d):
    return picks(spark, d)


@query("I02_ranked_top10_lift", EVAL_SPEC, eval_sql("picks", bands=[("TOP10", 1, 10)]), S.chain(PICKS, POP))
def _(spark, d):
    return A.evaluate_topn(picks(spark, d), panel(spark, d), [("TOP10", 1, 10)])


WSQL = "(VALUES " + ", ".join(f"('{m}','{f}',{w!r}::DOUBLE)" for m, ww in {
    "FULL": SC.FULL_WEIGHTS, "BASE": SC.BASE_WEIGHTS, "DROP_LAST": SC.drop_factor(SC.BASE_WEIGHTS, "last"),
    "DOUBLE_LABEL": SC.scale_factor(SC.BASE_WEIGHTS, "label_avg", 2.0), "ADD_EDGE": SC.MODES["ADD_EDGE"]}.items()
    for f, w in ww.items()) + ") v(model, factor, weight)"


@query("I03_weight_algebra", "model:s factor:s weight:f factor_mean:f",
       f"""SELECT w.*, m.factor_mean FROM (SELECT model, factor, weight/sum(weight) OVER (PARTITION BY model) weight FROM {WSQL}) w
JOIN (SELECT factor, avg(x) factor_mean FROM (UNPIVOT (SELECT {', '.join(f'{f}::DOUBLE AS {f}' for f in ALL)} FROM feats)
 ON COLUMNS(*) INTO NAME factor VALUE x) GROUP BY 1) m USING (factor)""", PF)
def _(spark, d):
    sets = {"FULL": SC.FULL_WEIGHTS, "BASE": SC.BASE_WEIGHTS, "DROP_LAST": SC.drop_factor(SC.BASE_WEIGHTS, "last"),
            "DOUBLE_LABEL": SC.scale_factor(SC.BASE_WEIGHTS, "label_avg", 2.0), "ADD_EDGE": SC.MODES["ADD_EDGE"]}
    means = A.unpivot(feats(spark, d), ["site"], ALL, "factor").groupBy("factor").agg(F.avg("x").alias("factor_mean"))
    return SC.normalised(SC.weights_frame(spark, sets)).join(means, "factor")


@query("I04_score_models", "model:s day:d entity_id:i score:f", "SELECT * FROM modes", PMODES)
def _(spark, d):
    return SC.score_modes(feats(spark, d), SC.MODES)


@query("I05_contributions", "day:d entity_id:i factor:s component:f contribution:f", "\nUNION ALL ".join(
    f"SELECT day, entity_id, '{f}' factor, k_{f} component, k_{f}*{w!r}::DOUBLE contribution FROM comps"
    for f, w in SC.BASE_WEIGHTS.items()), PCOMP)
def _(spark, d):
    return SC.contributions(feats(spark, d), SC.BASE_WEIGHTS)


NEXT = """plus1 AS (SELECT entity_id, day, label, activity, metric FROM panel UNION ALL
 SELECT entity_id, day + 1, label, NULL, NULL FROM panel WHERE day=(SELECT max(day) FROM panel))"""
PNEXT = S.chain(P, NEXT, S.feats("plus1", name="ffall"),
                "ffeats AS (SELECT * FROM ffall WHERE day=(SELECT max(day)+1 FROM panel))")
PULL = S.chain(PNEXT, """pull AS (SELECT *, (rate1*hist_n+p1*15)/(hist_n+15) rate1_eb, (rate2*hist_n+p2*15)/(hist_n+15) rate2_eb
 FROM ffeats, (SELECT avg((metric>=100)::INT) p1, avg((metric>=200)::INT) p2 FROM panel))""")
_raw = " + ".join(f"{w}*{S.comp(f)}" for f, w in SC.PULL_WEIGHTS.items())


@query("I06_pulled_score", "day:d entity_id:i hist_n:i raw:f score:f confidence:s reason:s", f"""
SELECT *, round(greatest(0, least(100, 50+(raw-50)*sqrt(least(hist_n,31)/31))), 9) score,
 CASE WHEN hist_n>=25 THEN 'HIGH' WHEN hist_n>=20 THEN 'MEDIUM' WHEN hist_n>=15 THEN 'LOW' ELSE 'REFERENCE' END confidence,
 CASE WHEN rs='' THEN 'OVERALL' ELSE rs END reason FROM (SELECT *, {_raw} + bounce*3.0 raw,
 array_to_string(list_slice(list_filter([CASE WHEN recent7>=30 THEN 'RECENT7' END, CASE WHEN avg_all>=30 THEN 'AVERAGE' END,
  CASE WHEN weekday_avg>=30 THEN 'WEEKDAY' END, CASE WHEN last<=-50 THEN 'DIP' END, CASE WHEN rate2_eb>=0.15 THEN 'BIG_WINS' END,
  CASE WHEN label_avg>=20 THEN 'LABEL' END, CASE WHEN neighbour>=30 THEN 'NEIGHBOUR' END], lambda z: z IS NOT NULL), 1, 4),
  ' / ') rs FROM pull)""", PULL)
def _(spark, d):
    return SC.pulled_score(materialise(panel(spark, d)))


@query("I07_rule_score", "day:d entity_id:i activity_points:i metric_points:i relative_points:i points:i grade:s", """
SELECT *, CASE WHEN points>=65 THEN 'S' WHEN points>=50 THEN 'A' WHEN points>=35 THEN 'B' WHEN points>=20 THEN 'C' ELSE 'D' END
 grade FROM (SELECT *, activity_points+metric_points+relative_points points FROM (SELECT day, entity_id,
 CASE WHEN r>=1.3 THEN 20 WHEN r>=1.1 THEN 15 WHEN r>=0.9 THEN 10 WHEN r>=0.7 THEN 5 ELSE 0 END activity_points,
 CASE WHEN metric>=300 THEN 30 WHEN metric>=200 THEN 25 WHEN metric>=100 THEN 20 WHEN metric>0 THEN 10
  WHEN metric>=-100 THEN 3 ELSE 0 END metric_points,
 CASE WHEN q>=300 THEN 20 WHEN q>=200 THEN 15 WHEN q>=100 THEN 10 WHEN q>=0 THEN 5 ELSE 0 END relative_points
 FROM (SELECT *, activity/avg(activity) OVER w AS r, metric-avg(metric) OVER w AS q FROM panel
  WINDOW w AS (PARTITION BY day, label))))""", P)
def _(spark, d):
    return SC.rule_score(panel(spark, d))


@query("I08_relative_score", "day:d entity_id:i z:f reliability:f label_rank:i score:f grade:s", """
SELECT *, CASE WHEN score>=80 THEN 'TOP' WHEN score>=70 THEN 'UPPER' WHEN score>=60 THEN 'UPPER_MID' WHEN score>=40 THEN 'MID'
 ELSE 'LOW' END grade FROM (SELECT *, ((z+3)/6*100*reliability+50*(1-reliability))*0.5
  + (CASE WHEN n>1 THEN (n-label_rank)/(n-1)*100 ELSE 50 END)*0.25 + (z+3)/6*100*0.25 score FROM (
 SELECT day, entity_id, greatest(-3, least(3, coalesce((metric-avg(metric) OVER w)/nullif(stddev_pop(metric) OVER w,0),0))) z,
 CASE WHEN activity>=8 THEN 1.0 WHEN activity>=6 THEN 0.95 WHEN activity>=5 THEN 0.9 WHEN activity>=4 THEN 0.82
  WHEN activity>=3 THEN 0.72 WHEN activity>=2 THEN 0.6 ELSE 0.45 END reliability,
 row_number() OVER (PARTITION BY day, label ORDER BY metric DESC, entity_id) label_rank, count(*) OVER w AS n
 FROM panel WINDOW w AS (PARTITION BY day, label)))""", P)
def _(spark, d):
    return SC.relative_score(panel(spark, d))


CLIP = "greatest(0, least(100, {}))"
RATES = "avg((metric>0)::INT) win, avg((metric>=100)::INT) high, avg((metric>=200)::INT) strong"


@query("I09_entity_scores", "entity_id:i label:s n:i mean:f recent3:f recent3_win:f score:f", f"""
SELECT *, {CLIP.format('mean/5.0+win*30+high*20+strong*15+recent3_win*15')} score FROM (
 SELECT entity_id, arg_max(label, day) label, count(*) n, avg(metric) mean, {RATES}, avg(metric) FILTER (b<=3) recent3,
  avg((metric>0)::INT) FILTER (b<=3) recent3_win FROM (
  SELECT *, row_number() OVER (PARTITION BY entity_id ORDER BY day DESC) b FROM panel) GROUP BY 1)""", P)
def _(spark, d):
    return SC.entity_scores(panel(spark, d))


@query("I09_label_scores", "label:s n:i mean:f score:f", f"""
SELECT *, {CLIP.format('mean/6.0+win*35+high*15+strong*10')} score FROM (
 SELECT label, count(*) n, avg(metric) mean, {RATES} FROM panel GROUP BY 1)""", P)
def _(spark, d):
    return SC.label_scores(panel(spark, d))


@query("I09_combination_scores", "entity_id:i label:s n:i mean:f continuity:f score:f", f"""
SELECT *, {CLIP.format('mean/6.0+win*40+continuity*20')} score FROM (
 SELECT entity_id, label, count(*) n, avg(metric) mean, avg((metric>0)::INT) win,
  least(count(*)/(SELECT count(DISTINCT day) FROM panel), 1) continuity FROM panel GROUP BY 1, 2)""", P)
def _(spark, d):
    return SC.combination_scores(panel(spark, d))


SQ = "greatest(0, least(100, 50+50*tanh({})))"
INV = f"""inv AS (SELECT *, greatest(0, least(100, 50+(raw-50)*conf)) score, conf*100 confidence FROM (
 SELECT *, {CLIP.format(SQ.format('mean/220.0') + '*0.35+win*0.2+p1*0.1+p2*0.1+recent_score*0.15+stability*0.1-m1*0.15')} raw
 FROM (SELECT *, 1-exp(-n/4.5) conf,
  {CLIP.format(SQ.format('r3/220.0') + '*0.55+' + SQ.format('r5/220.0') + '*0.25+w3*0.1+w5*0.1')} recent_score,
  CASE WHEN abs(mean)>10 THEN 100/(1+0.35*sd/abs(mean)) ELSE 50 END stability FROM (
  SELECT entity_id, count(*) n, avg(metric) mean, stddev_pop(metric) sd, 100*avg((metric>0)::INT) win,
   100*avg((metric>=100)::INT) p1, 100*avg((metric>=200)::INT) p2, 100*avg((metric<=-100)::INT) m1,
   avg(metric) FILTER (b<=3) r3, avg(metric) FILTER (b<=5) r5, 100*avg((metric>0)::INT) FILTER (b<=3) w3,
   100*avg((metric>0)::INT) FILTER (b<=5) w5 FROM (
   SELECT *, row_number() OVER (PARTITION BY entity_id ORDER BY day DESC) b FROM panel) GROUP BY 1))))"""
GRADE = ("CASE WHEN score>=80 THEN 'S' WHEN score>=70 THEN 'A' WHEN score>=60 THEN 'B' WHEN score>=50 THEN 'C' "
         "WHEN score>=40 THEN 'D' ELSE 'E' END grade")


@query("I10_invest_score", "entity_id:i n:i recent_score:f stability:f confidence:f raw:f score:f grade:s",
       f"SELECT *, {GRADE} FROM inv", S.chain(P, INV))
def _(spark, d):
    return SC.invest_score(panel(spark, d))


@query("I11_label_outlook", "label:s n:i change:f dip:f heat:f confidence:f base:f score:f", f"""
SELECT *, {CLIP.format('50+(base-50)*(0.6+confidence/100*0.4)-heat')} score FROM (
SELECT *, {SQ.format('mean/180.0')}*0.2+{SQ.format('recent3/180.0')}*0.15+{SQ.format('previous/200.0')}*0.1+win*0.15+p1*0.1
 +p2*0.05+dip*0.2+2.5 base FROM (
SELECT *, CASE WHEN mean<=30 THEN 30 WHEN change<0 THEN {CLIP.format('50+abs(change)/250*50')} ELSE 50 END dip,
 CASE WHEN recent3>150 THEN least(15, (recent3-150)/50*5) ELSE 0 END heat, 100*(1-exp(-n/50.0)) confidence FROM (
SELECT a.*, recent3, previous, recent3-coalesce(old,recent3) change FROM (
 SELECT label, count(*) n, avg(metric) mean, 100*avg((metric>0)::INT) win, 100*avg((metric>=100)::INT) p1,
  100*avg((metric>=200)::INT) p2 FROM panel GROUP BY 1) a JOIN (
 SELECT label, avg(m) FILTER (b<=3) recent3, max(m) FILTER (b=1) previous, avg(m) FILTER (b>3) AS old FROM (
  SELECT label, avg(metric) m, row_number() OVER (PARTITION BY label ORDER BY day DESC) b FROM panel GROUP BY label, day)
 GROUP BY 1) USING (label))))""", P)
def _(spark, d):
    return SC.label_outlook(panel(spark, d))


def robust_sql(key, parts, name):
    q = lambda c: (f"(CASE WHEN hi_{c}<=lo_{c} THEN 50 ELSE greatest(0, least(100, ({c}-lo_{c})/(hi_{c}-lo_{c})*100)) END)")
    total = "+".join(f"{v}*{q(c[2:]) if c.startswith('s_') else c}" if c != "const" else str(v) for c, v in parts.items())
    lohi = ", ".join(f"quantile_cont({c},0.05) lo_{c}, quantile_cont({c},0.95) hi_{c}" for c in ("mean", "recent3", "neg_dip"))
    return f"""{name}0 AS (SELECT *, recent3-mean change, previous-recent3 neg_dip, least(100, 100*(1-exp(-n/12.0))) reliability FROM (
 SELECT {key}, count(*) n, avg(metric) mean, 100*avg((metric>0)::INT) win, 100*avg((metric>=100)::INT) p1,
  100*avg((metric>=200)::INT) p2 FROM panel GROUP BY 1) JOIN (
 SELECT {key}, sum(s) FILTER (b<=3)/sum(c) FILTER (b<=3) recent3, max(s/c) FILTER (b=1) previous,
  coalesce(regr_slope(s/c, -b) FILTER (b<=3), 0) trend FROM (SELECT {key}, sum(metric) s, count(*) c,
   row_number() OVER (PARTITION BY {key} ORDER BY day DESC) b FROM panel GROUP BY {key}, day) GROUP BY 1) USING ({key})),
{name} AS (SELECT *, {total} score FROM {name}0, (SELECT {lohi} FROM {name}0))"""


RL, RE = robust_sql("label", SC.ROBUST_LABEL, "rl"), robust_sql("entity_id", SC.ROBUST_ENTITY, "re")
RSPEC = "n:i mean:f recent3:f previous:f change:f trend:f reliability:f score:f"


@query("I12_robust_labels", f"label:s {RSPEC}", "SELECT * FROM rl", S.chain(P, RL))
def _(spark, d):
    return SC.robust_scores(panel(spark, d), LABEL, SC.ROBUST_LABEL)


@query("I12_robust_entities", f"entity_id:i {RSPEC}", "SELECT * FROM re", S.chain(P, RE))
def _(spark, d):
    return SC.robust_scores(panel(spark, d), ENTITY, SC.ROBUST_ENTITY)


@query("I12_robust_combined", "entity_id:i label:s score:f grade:s", f"""
SELECT *, {GRADE} FROM (SELECT re.entity_id, c.label, coalesce(rl.score,50)*0.45+re.score*0.55 score FROM re
 JOIN (SELECT entity_id, arg_max(label, day) label FROM panel GROUP BY 1) c USING (entity_id)
 LEFT JOIN rl ON rl.label=c.label)""", S.chain(P, RL, RE))
def _(spark, d):
    return SC.robust_combined(panel(spark, d))


def form_sql(key, name, daily):
    rows = (f"(SELECT {key}, day, avg(metric) v FROM panel GROUP BY 1, 2)" if daily
            else f"(SELECT {key}, day, metric v FROM panel)")
    return f"""{name} AS (SELECT {key}, mean, win, last, last-coalesce(prv,last) change, recent3, mean-last drawdown,
 CASE WHEN low3<0 THEN -low3 ELSE 0 END dent FROM (SELECT {key}, avg(metric) mean, 100*avg((metric>0)::INT) win FROM panel
 GROUP BY 1) JOIN (SELECT {key}, max(v) FILTER (b=1) AS last, max(v) FILTER (b=2) prv, avg(v) FILTER (b<=3) recent3,
 min(v) FILTER (b<=3) low3 FROM (SELECT *, row_number() OVER (PARTITION BY {key} ORDER BY day DESC) b FROM {rows})
 GROUP BY 1) USING ({key}))"""


FE, FL = form_sql("entity_id", "fe", False), form_sql("label", "fl", True)
CAND = "cand AS (SELECT entity_id, label, isodow(day+1)-1 wd FROM panel WHERE day=(SELECT max(day) FROM panel))"
SW = lambda c: _sw(f"round({c}, 9)")
_sw = lambda c: (f"(CASE WHEN {c} BETWEEN 0 AND 100 THEN 90 WHEN {c}>=-50 AND {c}<0 THEN 60 WHEN {c}>100 AND {c}<=200 THEN 55 "  # noqa: E731
                f"WHEN {c}<-100 THEN 25 ELSE 45 END)")
RG = lambda c, a, b: f"greatest(0, least(100, ({c}-({a}))/(({b})-({a}))*100))"
WDS = f"""wds AS (SELECT wd, {RG('avg(a)', -30, 10)}*0.7+{RG('avg(p)', 20, 45)}*0.3 wd_score FROM (
 SELECT isodow(day)-1 wd, avg(metric) a, 100*avg((metric>0)::INT) p FROM panel GROUP BY day) GROUP BY 1)"""


@query("I13_band_score", "entity_id:i label:s change:f drawdown:f l_last:f score:f grade:s", f"""
SELECT *, CASE WHEN round(score, 9)>=75 THEN 'S' WHEN round(score, 9)>=65 THEN 'A' WHEN round(score, 9)>=55 THEN 'B'
 WHEN round(score, 9)>=45 THEN 'C' WHEN round(score, 9)>=35 THEN 'D' ELSE 'E' END grade FROM (SELECT c.entity_id, c.label, fe.change, fe.drawdown, fl.last l_last,
 {SW('fe.change')}*0.22+{SW('fe.last')}*0.18+(CASE WHEN round(fe.drawdown, 9) BETWEEN -100 AND 0 THEN 75 WHEN round(fe.drawdown, 9)<-100 THEN 50
  WHEN round(fe.drawdown, 9)<=100 THEN 40 ELSE 25 END)*0.12+{SW('fl.last')}*0.18+{RG('fl.recent3', -100, 100)}*0.1
 +{RG('fl.mean', -100, 100)}*0.06+coalesce(wd_score,50)*0.06+40*0.05+(CASE WHEN c.entity_id%2=1 THEN 55 ELSE 45 END)*0.03 score
 FROM cand c JOIN fe USING (entity_id) JOIN fl USING (label) LEFT JOIN wds USING (wd))""", S.chain(P, FE, FL, CAND, WDS))
def _(spark, d):
    return SC.band_score(panel(spark, d))


_mm = "+".join(f"{w}*coalesce(({c}-min({c}) OVER ())/nullif(max({c}) OVER ()-min({c}) OVER (),0)*100,50)"
               for c, w in SC.MINMAX_WEIGHTS.items())


@query("I13_minmax_score", "entity_id:i label:s score:f focus:b", f"""
SELECT entity_id, label, greatest(0, least(100, {_mm} + (change>=50)::INT*3 + (l_last>=50)::INT*3 + (last>=50)::INT*2
 + (dent>=50)::INT*2 - (last>=100 AND change>=100)::INT*2 - (l_last<=-100)::INT*2)) score,
 (change>=30)::INT+(dent>=30)::INT+(l_last>=30)::INT+(last>=30)::INT >= 2 focus FROM (
 SELECT c.entity_id, c.label, fe.* EXCLUDE (entity_id), fl.last l_last, fl.recent3 l_recent3, fl.dent l_dent, fl.mean l_mean,
  fl.win l_win FROM cand c JOIN fe USING (entity_id) JOIN fl USING (label))""", S.chain(P, FE, FL, CAND))
def _(spark, d):
    return SC.minmax_score(panel(spark, d))


@query("I14_final_selection", "entity_id:i target_score:f verdict:s notes:s", f"""
SELECT *, CASE WHEN target_score>=75 THEN '◎' WHEN target_score>=68 THEN '○' WHEN target_score>=60 THEN '△'
 WHEN target_score>=50 THEN '▲' ELSE '×' END verdict FROM (SELECT entity_id, {CLIP.format(
    "score*0.6+greatest(0,least(100,50+50*greatest(-1,least(1,r3/300.0))))*0.15+win*0.1+confidence*0.1+w3*0.05"
    "-(CASE WHEN n<=2 THEN 8 WHEN n=3 THEN 5 WHEN n=4 THEN 3 WHEN n=5 THEN 1 ELSE 0 END)")} target_score,
 concat_ws(' / ', CASE WHEN n<=2 THEN 'FEW_DAYS' END, CASE WHEN mean>=200 THEN 'STRONG_MEAN' END,
  CASE WHEN win>=70 THEN 'HIGH_WIN' END, CASE WHEN r3>=200 THEN 'STRONG_RECENT' END,
  CASE WHEN r3<=-100 THEN 'WEAK_RECENT' END, CASE WHEN confidence<60 THEN 'LOW_CONFIDENCE' END) notes FROM inv)""",
       S.chain(P, INV))
def _(spark, d):
    return SC.final_selection(SC.invest_score(panel(spark, d)))


@query("I15_recent_win", "day:d segment:s rank:i entity_id:i recent_win:f recent_n:i", """
SELECT * FROM (SELECT day, segment, entity_id, recent_win, recent_n, row_number() OVER (PARTITION BY day, segment
 ORDER BY round(recent_win,9) DESC, recent_n DESC, entity_id) AS rank FROM (
 SELECT *, CASE WHEN entity_id%3=0 THEN 'A' ELSE 'B' END segment, dense_rank() OVER (ORDER BY day) dr,
  coalesce(avg((metric>0)::INT) OVER w, -1) recent_win, count(metric) OVER w AS recent_n FROM panel
 WINDOW w AS (PARTITION BY entity_id ORDER BY day ROWS BETWEEN 7 PRECEDING AND 1 PRECEDING)) WHERE dr>7) WHERE rank<=3""", P)
def _(spark, d):
    p = panel(spark, d).withColumn("segment", F.when(F.col("entity_id") % 3 == 0, "A").otherwise("B"))
    return SC.recent_win(p, 7, 3, ["segment"], 7)


WDM = """wdm AS (SELECT *, isodow(day)-1 wd, avg(metric) OVER w AS raw_mean, count(metric) OVER w AS weekday_n FROM panel
 WINDOW w AS (PARTITION BY entity_id, isodow(day) ORDER BY day ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING))"""


@query("I16_weekday_signal", "day:d entity_id:i weekday_mean:f weekday_n:i", """
SELECT day, entity_id, coalesce(raw_mean, median(raw_mean) OVER (PARTITION BY day), 0) weekday_mean, weekday_n FROM wdm""",
       S.chain(P, WDM))
def _(spark, d):
    return SC.weekday_signal(panel(spark, d))


_bl = "+".join(f"coalesce(({c}-avg({c}) OVER d)/nullif(stddev_pop({c}) OVER d,0),0)" for c in SC.BLEND)
_fill = ", ".join(f"coalesce({c}, median({c}) OVER (PARTITION BY day), 0) {c}" for c in SC.BLEND)


@query("I17_simple_blend", "day:d entity_id:i blend:f", f"""
SELECT day, entity_id, ({_bl})/5.0 blend FROM (SELECT day, entity_id, {_fill} FROM (SELECT day, entity_id,
 avg(metric) OVER (e ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) avg_all,
 avg((metric>=100)::INT) OVER (e ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) rate1,
 avg(metric) OVER (e ROWS BETWEEN 7 PRECEDING AND 1 PRECEDING) recent7,
 avg((metric>0)::INT) OVER (e ROWS BETWEEN 7 PRECEDING AND 1 PRECEDING) recent7_win, raw_mean weekday_mean
 FROM wdm WINDOW e AS (PARTITION BY entity_id ORDER BY day))) WINDOW d AS (PARTITION BY day)""", S.chain(P, WDM))
def _(spark, d):
    return SC.simple_blend(panel(spark, d))


@query("I18_neutral_fill", "day:d entity_id:i v:f", """
SELECT day, entity_id, coalesce(v, median(v) OVER (PARTITION BY day), 0) v FROM (
 SELECT day, entity_id, CASE WHEN c1>0 THEN metric END v FROM panel)""", P)
def _(spark, d):
    return SC.neutral_fill(panel(spark, d).withColumn("v", F.when(F.col("c1") > 0, F.col("metric"))), ["v"])


@query("I19_add_external", "day:d entity_id:i ext_label:f ext_digit:f", """
SELECT day, entity_id, coalesce(a, median(a) OVER (PARTITION BY day), 0) ext_label,
 coalesce(b, median(b) OVER (PARTITION BY day), 0) ext_digit FROM (SELECT p.day, p.entity_id, l.a, g.b FROM panel p
 LEFT JOIN (SELECT day, label, avg(activity) a FROM panel WHERE label<>'view' GROUP BY 1, 2) l USING (day, label)
 LEFT JOIN (SELECT day, entity_id%10 digit, avg(c1) b FROM panel WHERE entity_id%10<>3 GROUP BY 1, 2) g
  ON g.day=p.day AND g.digit=p.entity_id%10)""", P)
def _(spark, d):
    p = panel(spark, d)
    lab = p.where("label <> 'view'").groupBy(*DAY, "label").agg(F.avg("activity").alias("ext_label"))
    dig = p.where("entity_id % 10 <> 3").groupBy(*DAY, (F.col("entity_id") % 10).alias("digit")).agg(
        F.avg("c1").alias("ext_digit"))
    return SC.add_external(p, lab, dig)


SPEC = {1: (9.0, 11.0), 2: (8.0, 10.0), 3: (7.0, 8.0), 4: (6.0, 6.5), 5: (5.0, 5.5), 6: (4.0, 4.0)}
POST = """post AS (SELECT *, """ + ", ".join(f"exp(l{k}-top)/tot p{k}" for k in SPEC) + """ FROM (SELECT *, """ + "+".join(
    f"exp(l{k}-top)" for k in SPEC) + """ tot FROM (SELECT *, greatest(""" + ",".join(f"l{k}" for k in SPEC) + """) top FROM (
 SELECT *, """ + ", ".join(
    f"c1*ln(activity/{a})-activity/{a}+c2*ln(activity/{b})-activity/{b} l{k}" for k, (a, b) in SPEC.items()) + """
 FROM panel WHERE activity>0))))"""


@query("I20_poisson_posterior", "day:d entity_id:i expected_class:f p_high:f best_class:i", """
SELECT day, entity_id, p1+2*p2+3*p3+4*p4+5*p5+6*p6 expected_class, p4+p5+p6 p_high,
 CASE top WHEN l1 THEN 1 WHEN l2 THEN 2 WHEN l3 THEN 3 WHEN l4 THEN 4 WHEN l5 THEN 5 ELSE 6 END best_class FROM post""",
       S.chain(P, POST))
def _(spark, d):
    return SC.poisson_posterior(panel(spark, d), SPEC)


@query("I21_rank_groups", "rank_group:i n:i mean:f win_rate:f", """
SELECT ceil(r/5.0) rank_group, count(*) n, avg(metric) mean, avg((metric>0)::INT) win_rate FROM (
 SELECT metric, row_number() OVER (PARTITION BY day ORDER BY round(p1+2*p2+3*p3+4*p4+5*p5+6*p6,9) DESC, entity_id) r FROM post)
GROUP BY 1""", S.chain(P, POST))
def _(spark, d):
    return SC.rank_groups(SC.poisson_posterior(panel(spark, d), SPEC), "expected_class")


EPF = """epf AS (SELECT entity_id, count(metric) epoch_n, avg(metric) e_avg_all, avg(metric) FILTER (b<=7) e_recent7,
 max(metric) FILTER (b=1) e_last, coalesce(max(metric) FILTER (b=1)-max(metric) FILTER (b=2), 0) e_change,
 coalesce(avg(metric) FILTER (same), avg(metric))*(count(*) FILTER (same)/(count(*) FILTER (same)+15.0::DOUBLE))
  + avg(metric)*(1-count(*) FILTER (same)/(count(*) FILTER (same)+15.0::DOUBLE)) e_weekday_avg,
 avg((metric>=100)::INT) e_rate1, avg((metric>=200)::INT) e_rate2 FROM (
 SELECT ep.*, row_number() OVER (PARTITION BY entity_id ORDER BY day DESC) b,
  isodow(day)=isodow((SELECT max(day)+1 FROM panel)) same
 FROM ep JOIN (SELECT entity_id, max(epoch) le FROM ep GROUP BY 1) USING (entity_id)
 WHERE epoch=le AND le>1 AND activity>0 AND entity_id IN (SELECT entity_id FROM panel WHERE day=(SELECT max(day) FROM panel)))
 GROUP BY 1),
bj AS (SELECT ffeats.*, epoch_n IS NOT NULL changed, epoch_n IS NULL OR epoch_n>=4 eligible, epf.* EXCLUDE (entity_id)
 FROM ffeats LEFT JOIN epf USING (entity_id)),
ej AS (SELECT * REPLACE (""" + ", ".join(f"coalesce(e_{f},{f}) AS {f}" for f in SC.EPOCH_FACTORS) + """) FROM bj),
""" + ",\n".join([
    S.scored(SC.BASE_WEIGHTS, "bj", "s_base"), S.scored(SC.BASE_WEIGHTS, "ej", "s_rank"),
    S.scored(SC.BASE_WEIGHTS, "ej", "s_pop", where="eligible")]) + """,
pol AS (""" + "\nUNION ALL ".join(
    f"SELECT '{n}' policy, day, entity_id, label, score, changed, eligible, {c} AS candidate FROM {s}" for n, s, c in (
        ("BASELINE", "s_base", "true"), ("EPOCH_RANK", "s_rank", "eligible"), ("EPOCH_POP", "s_pop", "eligible"),
        ("BASE_REF", "s_base", "eligible"))) + """),
polp AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY policy ORDER BY score DESC, entity_id) AS rank FROM pol
 WHERE candidate) WHERE rank<=10)"""
PEPOCH = S.chain(PNEXT, EPOCH, EPF)


def _policies(spark, d):
    return SC.epoch_policies(materialise(panel(spark, d)), threshold=4)


@query("I22_epoch_policies", "policy:s day:d entity_id:i score:f changed:b candidate:b", "SELECT * FROM pol", PEPOCH)
def _(spark, d):
    return _policies(spark, d)


@query("I22_policy_picks", "policy:s day:d rank:i entity_id:i score:f", "SELECT * FROM polp", PEPOCH)
def _(spark, d):
    return SC.policy_picks(_policies(spark, d))


STEPS = (2, 3, 4, 7)  # the test panel's epochs are short
LADDER = S.chain(PEPOCH, ",\n".join(
    f"""ej{t} AS (SELECT * EXCLUDE (eligible), epoch_n IS NULL OR epoch_n>={t} eligible FROM ej),
{S.scored(SC.BASE_WEIGHTS, f"ej{t}", f"s_pop{t}", where="eligible")}, {S.scored(SC.BASE_WEIGHTS, f"ej{t}", f"s_rank{t}")}""" for t in STEPS))


@query("I22_epoch_ladder", "policy:s day:d entity_id:i score:f candidate:b", "\nUNION ALL ".join(
    f"SELECT '{n}' policy, day, entity_id, score, {c} AS candidate FROM {src}" for n, src, c in [
        ("BASELINE", "s_base", "true"), ("EPOCH", "s_rank", "true"),
        *[(f"EXCLUDE_LT{t}", f"s_rank{t}", "eligible") for t in STEPS], *[(f"EXCLUDE_LT{t}_POP", f"s_pop{t}", "eligible") for t in STEPS]]), LADDER)
def _(spark, d):
    return SC.epoch_ladder(materialise(panel(spark, d)), STEPS)


_SETS = [("BASE", "bj", "true"), ("RANK", "ej", "true"), *[(f"POP{t}", f"ej{t}", "eligible") for t in STEPS]]


@query("I24_normalisation_shift", "day:d moments:s factor:s population:i excluded:i mean:f sd:f lo:f hi:f clipped_low:i clipped_high:i", "\nUNION ALL ".join(
    f"""SELECT day, '{k}' moments, '{f}' factor, count(*) FILTER ({w}) population, count(*) FILTER (NOT {w}) excluded, avg(v) FILTER ({w}) mean,
 stddev_pop(v) FILTER ({w}) sd, min(v) FILTER ({w}) lo, max(v) FILTER ({w}) hi, count(*) FILTER (c<=0) clipped_low, count(*) FILTER (c>=100) clipped_high
FROM (SELECT *, {f} v, {S.comp(f, where=w)} c FROM {src}) GROUP BY 1""" for k, src, w in _SETS for f in SC.BASE_WEIGHTS), LADDER)
def _(spark, d):
    return SC.normalisation_shift(materialise(panel(spark, d)), STEPS)


CATS = [("SALES", "in", "purchase"), ("SYSTEM", "in", "error|login")]


@query("I23_category_rank", "day:d category:s category_rank:i entity_id:i score:f", """
SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY day, category ORDER BY score DESC, entity_id) category_rank FROM (
 SELECT *, CASE WHEN label='purchase' THEN 'SALES' WHEN label IN ('error','login') THEN 'SYSTEM' ELSE 'NORMAL' END category
 FROM scored)) WHERE category_rank<=10""", PSC)
def _(spark, d):
    return SC.category_rank(SC.score(feats(spark, d), SC.BASE_WEIGHTS), CATS)


@query("I24_policy_compare", "policy:s changed:b replaced:i rows:i mean_delta:f mean_abs_delta:f max_abs_delta:f "
                             "median_abs_delta:f p95_abs_delta:f", """
SELECT * FROM (SELECT policy, count(*) FILTER (entity_id NOT IN (SELECT entity_id FROM polp WHERE policy='BASELINE')) replaced
 FROM polp GROUP BY 1) JOIN (SELECT p.policy, p.changed, count(*) AS rows, avg(p.score-b.score) mean_delta,
 avg(abs(p.score-b.score)) mean_abs_delta, max(abs(p.score-b.score)) max_abs_delta, median(abs(p.score-b.score)) median_abs_delta,
 quantile_cont(abs(p.score-b.score),0.95) p95_abs_delta FROM pol p JOIN pol b ON b.policy='BASELINE' AND p.entity_id=b.entity_id
 GROUP BY 1, 2) USING (policy)""", PEPOCH)
def _(spark, d):
    return SC.policy_compare(_policies(spark, d))


@query("I24_rank_ripple", "policy:s changed:b rows:i mean_rank_move:f max_rank_move:i top_moves:i pop_change:i", """
SELECT p.policy, p.changed, count(*) AS rows, avg(abs(p.pos-b.pos)) mean_rank_move, max(abs(p.pos-b.pos)) max_rank_move,
 count(*) FILTER (least(p.pos, b.pos) <= 10 AND p.pos <> b.pos) top_moves, max(p.pop - b.pop) pop_change
FROM rk p JOIN rk b ON b.policy='BASELINE' AND p.entity_id=b.entity_id GROUP BY 1, 2""",
       S.chain(PEPOCH, """rk AS (SELECT *, row_number() OVER (PARTITION BY policy ORDER BY round(score, 9) DESC, entity_id) pos,
  count(*) OVER (PARTITION BY policy) pop FROM pol)"""))
def _(spark, d):
    return SC.rank_ripple(_policies(spark, d))


@query("I25_future_rank", "day:d rank:i entity_id:i label:s score:f", "SELECT * FROM fpicks",
       S.chain(PNEXT, S.scored(SC.BASE_WEIGHTS, "ffeats", "fscored"), S.picks("fscored", "fpicks")))
def _(spark, d):
    return SC.rank_score(materialise(FT.future_features(materialise(panel(spark, d)), extras=())), SC.BASE_WEIGHTS)


@query("I26_inventory_flags", "entity_id:i label:s changed:b stable:b new_label:b mixed_history:b", """
SELECT n.entity_id, n.label, NOT coalesce(bool_and(p.label=n.label) FILTER (r=2), false) changed,
 count(*) FILTER (r<=7 AND p.label=n.label)>=7 stable,
 n.label NOT IN (SELECT label FROM panel WHERE day<(SELECT max(day) FROM panel)) new_label, count(*) FILTER (p.label<>n.label)>0 mixed_history
FROM (SELECT entity_id, label FROM panel WHERE day=(SELECT max(day) FROM panel)) n JOIN (
 SELECT *, dense_rank() OVER (ORDER BY day DESC) r FROM panel) p USING (entity_id) GROUP BY 1, 2""", P)
def _(spark, d):
    return SC.inventory_flags(panel(spark, d), 7)
