"""Registered queries: ordered operators."""

from dayloom import panel as PN
from dayloom.operators import aggregates as A
from dayloom.operators import features as FT
from dayloom.operators import windows as WN
from dayloom.panel import DAY, ENTITY, LABEL, SITE, table
from dayloom.plans import sql as S
from dayloom.plans.common import F, daily, lines, panel
from dayloom.plans.aggregates import PD
from dayloom.plans.registry import query

P = S.PANEL
PN_SQL = S.chain(P, """pn AS (SELECT *, lag(metric) OVER e AS prev, lead(metric) OVER e AS next, lag(day) OVER e AS prev_day,
 lead(day) OVER e AS next_day FROM panel WINDOW e AS (PARTITION BY entity_id ORDER BY day))""")


@query("F01_prev_next", "day:d entity_id:i prev:f next:f prev_day:d next_day:d", "SELECT * FROM pn", PN_SQL)
def _(spark, d):
    return WN.with_prev_next(panel(spark, d))


BAND = """CASE WHEN prev>=200 THEN 'A_BIG_WIN' WHEN prev>=100 THEN 'B_WIN' WHEN prev>0 THEN 'C_SMALL_WIN'
 WHEN prev=0 THEN 'D_EVEN' WHEN {mild} THEN 'E_SMALL_LOSS' ELSE 'F_LOSS' END"""
for _v, _mild, _day in (("rows", "prev>=-100", ""), ("days", "prev>=-99", "AND day-prev_day=1"),
                        ("strict", "prev>-100", "AND day-prev_day=1")):
    @query(f"F02_transitions_{_v}", "band:s n:i next_mean:f next_win:f next_strong:f", f"""
SELECT {BAND.format(mild=_mild)} band, count(*) n, avg(metric) next_mean, avg((metric>0)::INT) next_win,
 avg((metric>=100)::INT) next_strong FROM pn WHERE prev IS NOT NULL {_day} GROUP BY 1""", PN_SQL)
    def _(spark, d, _v=_v):
        return WN.transitions(panel(spark, d), _v)


@query("F02_two_day_relation", "state:s n:i next_mean:f next_win:f", """
SELECT CASE WHEN prev<=-100 THEN 'LOSS' WHEN prev<=0 THEN 'SMALL_LOSS' WHEN prev<=99 THEN 'SMALL_WIN' ELSE 'WIN' END state,
 count(*) n, avg(next) next_mean, avg((next>0)::INT) next_win FROM pn WHERE prev IS NOT NULL AND next IS NOT NULL
GROUP BY 1""", PN_SQL)
def _(spark, d):
    return WN.two_day_relation(panel(spark, d), [-100, 0, 99], ["LOSS", "SMALL_LOSS", "SMALL_WIN", "WIN"])


@query("F03_change_classes", "change_class:s n:i next_mean:f next_win:f", """
SELECT CASE WHEN metric-prev>=100 THEN 'RISING' WHEN metric-prev<=-100 THEN 'FALLING' ELSE 'FLAT' END change_class,
 count(*) n, avg(next) next_mean, avg((next>0)::INT) next_win
FROM pn WHERE prev IS NOT NULL AND next IS NOT NULL GROUP BY 1""", PN_SQL)
def _(spark, d):
    return WN.change_classes(panel(spark, d), 100)


@query("F04_after_extreme", "side:s n:i mean:f win_rate:f lo:f hi:f", """
SELECT CASE WHEN prev>0 THEN 'AFTER_WIN' ELSE 'AFTER_LOSS' END side, count(*) n, avg(metric) mean,
 avg((metric>0)::INT) win_rate, min(metric) lo, max(metric) hi FROM pn WHERE abs(prev)>=100 GROUP BY 1""", PN_SQL)
def _(spark, d):
    return WN.after_extreme(panel(spark, d), 100)


@query("F05_max_streak", "entity_id:i max_streak:i", """
SELECT entity_id, max(n) max_streak FROM (SELECT entity_id, isle, count(*) n FROM (
  SELECT *, sum((metric<=0)::INT) OVER (PARTITION BY entity_id ORDER BY day ROWS UNBOUNDED PRECEDING) isle FROM panel)
 WHERE metric>0 GROUP BY 1, 2) GROUP BY 1 HAVING max(n)>=2""", P)
def _(spark, d):
    return WN.max_streak(panel(spark, d), F.col("metric") > 0)


LD = S.chain(P, "ld AS (SELECT label, day, avg(metric) mean, sum(metric) total FROM panel GROUP BY 1, 2)")


def label_days(spark, d):
    return panel(spark, d).groupBy(*LABEL, "day").agg(F.avg("metric").alias("mean"), F.sum("metric").alias("total"))


for _n, _op, _not in (("losing", "<", ">="), ("winning", ">", "<=")):
    @query(f"F06_series_streaks_{_n}", "label:s max_streak:i", f"""
SELECT label, max(n) max_streak FROM (SELECT label, isle, count(*) n FROM (
  SELECT *, sum((mean{_not}0)::INT) OVER (PARTITION BY label ORDER BY day ROWS UNBOUNDED PRECEDING) isle FROM ld)
 WHERE mean{_op}0 GROUP BY 1, 2) GROUP BY 1""", LD)
    def _(spark, d, _n=_n):
        hit = F.col("mean") < 0 if _n == "losing" else F.col("mean") > 0
        return WN.max_streak(label_days(spark, d), hit, LABEL, 1)


@query("F07_drawdown", "label:s day:d cumulative:f peak:f drawdown:f", """
SELECT label, day, cumulative, max(cumulative) OVER w AS peak, cumulative - max(cumulative) OVER w AS drawdown
FROM (SELECT *, sum(total) OVER (PARTITION BY label ORDER BY day ROWS UNBOUNDED PRECEDING) cumulative FROM ld)
WINDOW w AS (PARTITION BY label ORDER BY day ROWS UNBOUNDED PRECEDING)""", LD)
def _(spark, d):
    return WN.drawdown(label_days(spark, d), LABEL)


@query("F07_max_drawdown", "label:s max_drawdown:f", """
SELECT label, min(cumulative-peak) max_drawdown FROM (SELECT *, max(cumulative) OVER (PARTITION BY label ORDER BY day
 ROWS UNBOUNDED PRECEDING) peak FROM (SELECT *, sum(total) OVER (PARTITION BY label ORDER BY day
  ROWS UNBOUNDED PRECEDING) cumulative FROM ld)) GROUP BY 1""", LD)
def _(spark, d):
    return WN.drawdown(label_days(spark, d), LABEL).groupBy(*LABEL).agg(F.min("drawdown").alias("max_drawdown"))


@query("F08_label_history", "day:d entity_id:i label:s prev_label:s changed:b", """
SELECT day, entity_id, label, p prev_label, coalesce(label<>p, false) changed FROM (
 SELECT *, lag(label) OVER (PARTITION BY entity_id ORDER BY day) p FROM panel)""", P)
def _(spark, d):
    return WN.label_history(panel(spark, d))


SEG = """seg AS (SELECT *, sum((reason<>'')::INT) OVER (PARTITION BY entity_id ORDER BY day ROWS UNBOUNDED PRECEDING) sid
FROM (SELECT *, CASE WHEN g IS NULL THEN 'FIRST' WHEN g<>1 THEN 'CALENDAR_GAP' WHEN label<>pl THEN 'LABEL_CHANGE' ELSE '' END
  reason, CASE WHEN metric>0 THEN 'W' ELSE 'L' END wl FROM (
  SELECT *, day-lag(day) OVER e AS g, lag(label) OVER e AS pl FROM panel WINDOW e AS (PARTITION BY entity_id ORDER BY day))))"""
PSEG = S.chain(P, SEG)


@query("F09_segments", "day:d entity_id:i wl:s break_reason:s segment_id:i",
       "SELECT day, entity_id, wl, reason break_reason, sid segment_id FROM seg", PSEG)
def _(spark, d):
    return WN.segments(panel(spark, d))


STREAK = """strk AS (SELECT *, CASE WHEN streak BETWEEN 1 AND 5 THEN l1 || streak END streak_label,
  l2 || l1 AS p2, l3 || l2 || l1 AS p3 FROM (
 SELECT *, coalesce(lag(place) OVER (PARTITION BY entity_id, sid ORDER BY day), 0) streak FROM (
  SELECT *, row_number() OVER (PARTITION BY entity_id, sid, grp ORDER BY day) place FROM (
   SELECT *, row_number() OVER s - row_number() OVER (PARTITION BY entity_id, sid, wl ORDER BY day) || wl AS grp,
    lag(wl,1) OVER s AS l1, lag(wl,2) OVER s AS l2, lag(wl,3) OVER s AS l3
   FROM seg WINDOW s AS (PARTITION BY entity_id, sid ORDER BY day)))))"""
PSTR = S.chain(PSEG, STREAK)


@query("F10_prior_streak", "day:d entity_id:i streak:i streak_label:s", "SELECT * FROM strk", PSTR)
def _(spark, d):
    return WN.prior_streak(panel(spark, d))


@query("F11_trailing_patterns", "pattern_2d:s pattern_3d:s n:i",
       "SELECT p2 pattern_2d, p3 pattern_3d, count(*) n FROM strk GROUP BY 1, 2", PSTR)
def _(spark, d):
    return WN.prior_streak(panel(spark, d)).groupBy("pattern_2d", "pattern_3d").agg(F.count(F.lit(1)).alias("n"))


_lo, _hi = S.wilson("wins", "n")


@query("F12_pattern_summary", "family:s pattern:s n:i wins:i days:i win_rate:f ci_low:f ci_high:f base_win:f win_diff:f "
                              "mean:f base_mean:f mean_diff:f", f"""
SELECT family, pattern, n, wins, dd AS days, wins/n win_rate, {_lo} ci_low, {_hi} ci_high, bw base_win,
 wins/n-bw win_diff, mean, bm base_mean, mean-bm mean_diff FROM (
 SELECT family, pattern, count(*) n, count(*) FILTER (metric>0) wins, count(DISTINCT day) dd, avg(metric) mean
 FROM cells WHERE pattern<>'' GROUP BY 1, 2) JOIN (
 SELECT family, avg((metric>0)::INT) bw, avg(metric) bm FROM cells GROUP BY 1) USING (family)""",
       S.chain(PSTR, """cells AS (SELECT 'STREAK' family, coalesce(streak_label,'') AS pattern, day, metric FROM strk
  WHERE l1 IS NOT NULL UNION ALL SELECT '2D', p2, day, metric FROM strk WHERE p2 IS NOT NULL
  UNION ALL SELECT '3D', p3, day, metric FROM strk WHERE p3 IS NOT NULL)"""))
def _(spark, d):
    return WN.pattern_summary(panel(spark, d))


@query("F13_replicate", "n1:i n2:i win_lift1:f mean_lift1:f win_lift2:f mean_lift2:f verdict:s", """
SELECT *, CASE WHEN win_lift1>0 AND mean_lift1>0 AND win_lift2>0 AND mean_lift2>0 THEN 'ROBUST_DIRECTION'
 WHEN (win_lift1>0)<>(mean_lift1>0) OR (win_lift2>0)<>(mean_lift2>0)
  OR (win_lift1>0 AND mean_lift1>0 AND win_lift2<0 AND mean_lift2<0)
  OR (win_lift1<0 AND mean_lift1<0 AND win_lift2>0 AND mean_lift2>0) THEN 'MIXED' ELSE 'NO_TEMPORAL_REPLICATION' END verdict
FROM (SELECT max(n) FILTER (h=1) n1, max(n) FILTER (h=2) n2, max(w) FILTER (h=1) win_lift1, max(m) FILTER (h=1) mean_lift1,
  max(w) FILTER (h=2) win_lift2, max(m) FILTER (h=2) mean_lift2 FROM (
 SELECT h, count(*) FILTER (streak_label='L2') n,
  avg((metric>0)::INT) FILTER (streak_label='L2') - avg((metric>0)::INT) w,
  avg(metric) FILTER (streak_label='L2') - avg(metric) m
 FROM strk JOIN (SELECT day, CASE WHEN row_number() OVER (ORDER BY day) <= (count(*) OVER ())//2 THEN 1 ELSE 2 END h
   FROM (SELECT DISTINCT day FROM strk WHERE l1 IS NOT NULL)) USING (day) WHERE l1 IS NOT NULL GROUP BY 1))""", PSTR)
def _(spark, d):
    return WN.replicate(panel(spark, d), "L2")


EPOCH = """ep AS (SELECT *, sum((pl IS NULL OR label<>pl)::INT) OVER (PARTITION BY entity_id ORDER BY day
  ROWS UNBOUNDED PRECEDING) epoch FROM (SELECT *, lag(label) OVER (PARTITION BY entity_id ORDER BY day) pl FROM panel)),
epochs AS (SELECT *, entity_id || ':' || lpad(epoch::VARCHAR, 4, '0') || ':' || strftime(epoch_start, '%Y%m%d') epoch_id,
  epoch_end-epoch_start+1-calendar_days missing_days, epoch_end-epoch_start+1=calendar_days continuous,
  max(epoch) OVER (PARTITION BY entity_id) last_epoch, lag(label) OVER (PARTITION BY entity_id ORDER BY epoch) old_label
 FROM (SELECT entity_id, epoch, any_value(label) label, min(day) epoch_start, max(day) epoch_end,
  count(DISTINCT day) calendar_days, count(*) FILTER (activity>0) observed_days, count(*) FILTER (activity=0) idle_days,
  sum(activity) activity, max(day) FILTER (activity>0) last_observed FROM ep GROUP BY 1, 2))"""
PE = S.chain(P, EPOCH)


@query("F14_epochs", "entity_id:i epoch:i label:s epoch_id:s epoch_start:d epoch_end:d calendar_days:i observed_days:i "
                     "idle_days:i activity:f last_observed:d missing_days:i continuous:b", "SELECT * FROM epochs", PE)
def _(spark, d):
    return WN.epochs(panel(spark, d))


@query("F14_current_epochs", "entity_id:i epoch_id:s calendar_days:i continuous:b",
       "SELECT * FROM epochs WHERE epoch=last_epoch",
       PE.replace("FROM events GROUP BY", "FROM events WHERE CAST(ts AS DATE)<=DATE '2024-01-20' GROUP BY"))
def _(spark, d):
    return WN.current_epochs(panel(spark, d), "2024-01-20")


@query("F15_persistent_diff", "entity_id:i old_label:s new_label:s classification:s", """
SELECT entity_id, coalesce(old_label,'') old_label, label new_label,
 CASE WHEN epoch>1 THEN 'renamed' ELSE 'unchanged' END classification FROM epochs WHERE epoch=last_epoch""", PE)
def _(spark, d):
    return WN.persistent_diff(panel(spark, d))


@query("F16_current_run", "entity_id:i run_start:d age:i stop_reason:s label:s eligible:b", """
SELECT entity_id, min(day) run_start, count(*) age, arg_min(reason, day) stop_reason, any_value(label) label,
 count(*)>=3 eligible FROM seg WHERE day<=DATE '2024-01-25' GROUP BY entity_id, sid HAVING max(day)=DATE '2024-01-25'""",
       PSEG)
def _(spark, d):
    return WN.current_run(panel(spark, d), "2024-01-25", 3)


@query("F17_reset_history", "day:d entity_id:i label:s metric:f", """
SELECT day, entity_id, label, metric FROM (SELECT *, max(epoch) OVER (PARTITION BY entity_id) le FROM ep)
WHERE epoch=le""", PE)
def _(spark, d):
    return WN.reset_history(panel(spark, d))


def _prior_sql(by, src, value):
    w = f"PARTITION BY {by} ORDER BY day" if by else "ORDER BY day"
    cols = ", ".join(
        f"avg({value}) OVER (e ROWS BETWEEN {n} PRECEDING AND 1 PRECEDING) mean{n}, "
        f"stddev_pop({value}) OVER (e ROWS BETWEEN {n} PRECEDING AND 1 PRECEDING) std{n}, "
        f"avg(({value}>0)::INT) OVER (e ROWS BETWEEN {n} PRECEDING AND 1 PRECEDING) win{n}" for n in (3, 5, 7))
    return (f"SELECT *, count({value}) OVER (e ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) hist, "
            f"lag({value}) OVER e AS last, {cols} FROM {src} WINDOW e AS ({w})")


PSPEC = "hist:i last:f " + " ".join(f"mean{n}:f std{n}:f win{n}:f" for n in (3, 5, 7))


@query("F18_prior_entity", f"day:d entity_id:i {PSPEC}", _prior_sql("entity_id", "panel", "metric"), P)
def _(spark, d):
    return FT.prior_features(panel(spark, d), ENTITY, "metric", [3, 5, 7])


@query("F18_prior_site", f"day:d {PSPEC}", _prior_sql("", "daily", "mean"), PD)
def _(spark, d):
    return FT.prior_features(daily(spark, d), SITE, "mean", [3, 5, 7])


@query("F18_prior_label", f"day:d label:s {PSPEC}", _prior_sql("label", "ld", "mean"), LD)
def _(spark, d):
    return FT.prior_features(label_days(spark, d), LABEL, "mean", [3, 5, 7])


@query("F18_prior_digit", f"day:d digit:i {PSPEC}", _prior_sql(
    "digit", "(SELECT entity_id%10 digit, day, avg(metric) mean FROM panel GROUP BY 1, 2)", "mean"), P)
def _(spark, d):
    g = panel(spark, d).groupBy("site", (F.col("entity_id") % 10).alias("digit"), "day").agg(
        F.avg("metric").alias("mean"))
    return FT.prior_features(g, ["site", "digit"], "mean", [3, 5, 7])


@query("F19_rolling", "day:d window_days:i roll_mean:f roll_sum:f roll_positive:f", "\nUNION ALL ".join(f"""
SELECT day, {n} window_days, m roll_mean, s roll_sum, p roll_positive FROM (SELECT day, avg(mean) OVER w AS m,
 sum(mean) OVER w AS s, avg((mean>0)::INT) OVER w AS p, count(*) OVER w AS c FROM daily
 WINDOW w AS (ORDER BY day ROWS BETWEEN {n - 1} PRECEDING AND CURRENT ROW)) WHERE c={n}""" for n in (7, 14, 30)), PD)
def _(spark, d):
    return WN.rolling(daily(spark, d), [7, 14, 30])


@query("F20_zscore", "day:d entity_id:i z_metric:f z_activity:f", """
SELECT day, entity_id, coalesce((metric-avg(metric) OVER d)/nullif(stddev_pop(metric) OVER d,0),0) z_metric,
 coalesce((activity-avg(activity) OVER d)/nullif(stddev_pop(activity) OVER d,0),0) z_activity
FROM panel WINDOW d AS (PARTITION BY day)""", P)
def _(spark, d):
    return WN.zscores(panel(spark, d), ["metric", "activity"])


@query("F21_ranks", "day:d entity_id:i row_no:i min_rank:i dense_rank:i pct_rank:f", """
SELECT day, entity_id, row_number() OVER (PARTITION BY day ORDER BY activity DESC, entity_id) row_no,
 rank() OVER w AS min_rank, dense_rank() OVER w AS dense_rank,
 (rank() OVER w + (count(*) OVER (PARTITION BY day, activity)-1)/2.0)/count(*) OVER (PARTITION BY day) pct_rank
FROM panel WINDOW w AS (PARTITION BY day ORDER BY activity DESC)""", P)
def _(spark, d):
    return WN.ranks(panel(spark, d), "activity")


RUNS = """runs AS (SELECT day, entity_id start_id, end_id, k, total, wins, lo=hi same_label, wins=k all_positive,
 wins>=(k+1)//2 majority_positive FROM (""" + "\nUNION ALL ".join(f"""
SELECT day, entity_id, {k} AS k, lead(entity_id,{k - 1}) OVER w AS end_id, sum(metric) OVER f AS total,
 sum((metric>0)::INT) OVER f AS wins, min(label) OVER f AS lo, max(label) OVER f AS hi FROM panel
WINDOW w AS (PARTITION BY day ORDER BY entity_id),
 f AS (PARTITION BY day ORDER BY entity_id ROWS BETWEEN CURRENT ROW AND {k - 1} FOLLOWING)""" for k in (2, 3, 4)) + """
) WHERE end_id=entity_id+k-1)"""
PR = S.chain(P, RUNS)


def _runs(spark, d):
    p = panel(spark, d)
    return WN.runs(p, 2).unionByName(WN.runs(p, 3)).unionByName(WN.runs(p, 4))


@query("F22_runs", "day:d start_id:i end_id:i k:i total:f wins:i same_label:b all_positive:b majority_positive:b",
       "SELECT * FROM runs", PR)
def _(spark, d):
    return _runs(spark, d)


@query("F23_repeated_runs", "k:i start_id:i days:i mean_total:f same_label_days:i", """
SELECT k, start_id, count(*) AS days, avg(total) mean_total, count(*) FILTER (same_label) same_label_days
FROM runs WHERE all_positive GROUP BY 1, 2 HAVING count(*)>=2""", PR)
def _(spark, d):
    return WN.repeated_runs(_runs(spark, d))


for _t, _c in ((0, "metric > 0"), (50, "metric >= 50")):
    @query(f"F24_maximal_runs_{_t}", "day:d start_id:i end_id:i length:i total:f mean:f", f"""
SELECT day, min(entity_id) start_id, max(entity_id) end_id, count(*) length, sum(metric) total, avg(metric) mean
FROM (SELECT *, entity_id-row_number() OVER (PARTITION BY day ORDER BY entity_id) g FROM panel WHERE {_c})
GROUP BY day, g HAVING count(*)>=2""", P)
    def _(spark, d, _c=_c):
        return WN.maximal_runs(panel(spark, d), F.expr(_c))


for _same in (False, True):
    @query(f"F25_positive_pairs{'_same_label' if _same else ''}", "day:d entity_id:i right_id:i pair_total:f", f"""
SELECT a.day, a.entity_id, b.entity_id right_id, a.metric+b.metric pair_total FROM panel a JOIN panel b
ON a.day=b.day AND b.entity_id=a.entity_id+1 WHERE a.metric>0 AND b.metric>0 {'AND a.label=b.label' if _same else ''}""", P)
    def _(spark, d, _same=_same):
        return WN.positive_pairs(panel(spark, d), _same)


# Only some documents carry labels, so the labelled ids have natural holes.
IDS = "ids AS (SELECT DISTINCT doc_id AS entity_id FROM labels)"


def some_ids(spark, d):
    return table(spark, d, "labels").select(PN.one_site("doc_id").alias("site"), F.col("doc_id").alias("entity_id")).distinct()


@query("F26_number_runs", "entity_id:i run_id:i position:i length:i edge_distance:i edge_bucket:s", """
SELECT *, CASE WHEN edge_distance<=0 THEN 'EDGE' WHEN edge_distance<=1 THEN 'NEXT' WHEN edge_distance<=2 THEN 'SECOND'
 WHEN edge_distance<=4 THEN 'NEAR' ELSE 'INNER' END edge_bucket FROM (
SELECT entity_id, min(entity_id) OVER g AS run_id, entity_id-min(entity_id) OVER g + 1 AS position,
 count(*) OVER g AS length, least(entity_id-min(entity_id) OVER g, max(entity_id) OVER g-entity_id) edge_distance
FROM (SELECT entity_id, entity_id-row_number() OVER (ORDER BY entity_id) k FROM ids) WINDOW g AS (PARTITION BY k))""", IDS)
def _(spark, d):
    return WN.number_runs(some_ids(spark, d))


@query("F27_gaps", "after_id:i before_id:i missing:i", """
SELECT p after_id, entity_id before_id, entity_id-p-1 missing FROM (
 SELECT entity_id, lag(entity_id) OVER (ORDER BY entity_id) p FROM ids) WHERE entity_id-p>1""", IDS)
def _(spark, d):
    return WN.gaps(some_ids(spark, d))


@query("F27_label_blocks", "day:d label:s start_id:i end_id:i length:i", """
SELECT day, label, min(entity_id) start_id, max(entity_id) end_id, count(*) length FROM (
 SELECT *, entity_id-row_number() OVER (PARTITION BY day, label ORDER BY entity_id) g FROM panel)
GROUP BY day, label, g""", P)
def _(spark, d):
    return WN.label_blocks(panel(spark, d))


for _same in (False, True):
    @query(f"F28_neighbour_mean{'_same_label' if _same else ''}", "day:d entity_id:i neighbour_mean:f neighbours:i", f"""
SELECT a.day, a.entity_id, coalesce(avg(b.metric),0) neighbour_mean, count(b.metric) neighbours FROM panel a
LEFT JOIN panel b ON a.day=b.day AND b.entity_id IN (a.entity_id-1, a.entity_id+1)
 {'AND a.label=b.label' if _same else ''} GROUP BY 1, 2""", P)
    def _(spark, d, _same=_same):
        return WN.neighbour_mean(panel(spark, d), _same)


@query("F29_label_position", "day:d entity_id:i label_n:i pct:f edge:i centre:f is_end:b", """
SELECT day, entity_id, n label_n, CASE WHEN n>1 THEN (p-1)/(n-1) ELSE 0.5 END pct, least(p-1, n-p) edge,
 CASE WHEN n>1 THEN 1-abs(2*(p-1)/(n-1)-1) ELSE 1 END centre, p=1 OR p=n is_end FROM (
 SELECT day, entity_id, row_number() OVER (PARTITION BY day, label ORDER BY entity_id) p,
  count(*) OVER (PARTITION BY day, label) n FROM panel)""", P)
def _(spark, d):
    return WN.label_position(panel(spark, d))


@query("F30_entity_transitions", "entity_id:i n:i next_after_50:f next_after_100:f", """
SELECT entity_id, count(*) n, coalesce(avg(next) FILTER (metric<=-50),0) next_after_50,
 coalesce(avg(next) FILTER (metric<=-100),0) next_after_100 FROM pn WHERE next_day-day=1 GROUP BY 1""", PN_SQL)
def _(spark, d):
    return WN.entity_transitions(panel(spark, d))


@query("F31_relative_state", "day:d label:s rel:f prev1:f prev3:f prev7:f trend:f", """
SELECT *, prev1-prev3 trend FROM (SELECT day, label, rel, lag(rel) OVER e AS prev1,
 avg(rel) OVER (e ROWS BETWEEN 3 PRECEDING AND 1 PRECEDING) prev3,
 avg(rel) OVER (e ROWS BETWEEN 7 PRECEDING AND 1 PRECEDING) prev7 FROM (
 SELECT day, label, ld.mean-s.m rel FROM ld JOIN (SELECT day, avg(metric) m FROM panel GROUP BY 1) s USING (day))
WINDOW e AS (PARTITION BY label ORDER BY day))""", LD)
def _(spark, d):
    return WN.relative_state(panel(spark, d))


EDGE = S.chain(PD, """edges AS (SELECT (r-1)//4+1 AS block, avg(e) edge FROM (
 SELECT row_number() OVER (ORDER BY day) r, mean-(SELECT avg(mean) FROM daily) e FROM daily) GROUP BY 1)""")


@query("F32_prior_block_features", "block:i edge:f prior_blocks:i prior_mean:f prior_last:f prior_last2:f prior_last3:f "
                                   "prior_positive:f", """
SELECT *, count(edge) OVER (w ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) prior_blocks,
 avg(edge) OVER (w ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) prior_mean, lag(edge) OVER w AS prior_last,
 avg(edge) OVER (w ROWS BETWEEN 2 PRECEDING AND 1 PRECEDING) prior_last2,
 avg(edge) OVER (w ROWS BETWEEN 3 PRECEDING AND 1 PRECEDING) prior_last3,
 avg((edge>0)::INT) OVER (w ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) prior_positive
FROM edges WINDOW w AS (ORDER BY block)""", EDGE)
def _(spark, d):
    from pyspark.sql import Window
    s = daily(spark, d)  # one row per day
    site = s.groupBy(*SITE).agg(F.avg("mean").alias("_m"))
    w = Window.partitionBy(*SITE).orderBy("day")
    b = s.join(site, SITE).withColumn("block", F.floor((F.row_number().over(w) - 1) / 4) + 1)
    return WN.prior_block_features(b.groupBy(*SITE, "block").agg(F.avg(F.col("mean") - F.col("_m")).alias("edge")))


@query("F33_event_windows", "entity_id:i change_day:d old_label:s new_label:s before3:f before7:f before14:f after1:f "
                            "after3:f after7:f after_full:f", """
SELECT * FROM (SELECT entity_id, epoch_start change_day, lag(label) OVER e AS old_label, label new_label,
 lag(b3) OVER e AS before3, lag(b7) OVER e AS before7, lag(b14) OVER e AS before14, after1, after3, after7, after_full
FROM (SELECT entity_id, epoch, any_value(label) label, min(day) epoch_start, avg(metric) FILTER (dsc<=3) b3,
  avg(metric) FILTER (dsc<=7) b7, avg(metric) FILTER (dsc<=14) b14, avg(metric) FILTER (asc_<=1) after1,
  avg(metric) FILTER (asc_<=3) after3, avg(metric) FILTER (asc_<=7) after7, avg(metric) after_full
 FROM (SELECT *, row_number() OVER (PARTITION BY entity_id, epoch ORDER BY day) asc_,
   row_number() OVER (PARTITION BY entity_id, epoch ORDER BY day DESC) dsc FROM ep) GROUP BY 1, 2)
WINDOW e AS (PARTITION BY entity_id ORDER BY epoch)) WHERE old_label IS NOT NULL""", PE)
def _(spark, d):
    return WN.event_windows(panel(spark, d))


@query("F34_day_weighted", "day:d strata:i rows:i weighted_effect:f", """
SELECT day, count(*) strata, sum(n) AS rows, sum(effect*n)/sum(n) weighted_effect FROM (
 SELECT day, label, count(*) n, avg(metric) effect FROM panel GROUP BY 1, 2) GROUP BY 1""", P)
def _(spark, d):
    return WN.day_weighted(panel(spark, d).groupBy(*DAY, "label").agg(
        F.count(F.lit(1)).alias("n"), F.avg("metric").alias("effect")))
