"""Registered queries: resampling and inference."""

from dayloom import panel as PN
from dayloom.functions import expr as X
from dayloom.operators import aggregates as A
from dayloom.operators import resampling as R
from dayloom.panel import DAY, LABEL, SITE
from dayloom.plans import sql as S
from dayloom.plans.aggregates import PD
from dayloom.plans.backtest import boot_sql
from dayloom.plans.common import F, daily, panel
from dayloom.plans.registry import query
from dayloom.plans.windows import LD, label_days

P = S.PANEL
BOOT, DIFF, FLIPS = 20_000, 10_000, 20_000  # replicates


@query("J10_bootstrap_ci", "label:s n:i mean_value:f ci_low:f ci_high:f p_positive:f",
       "SELECT * FROM (SELECT label, count(*) n, avg(mean) mean_value FROM ld GROUP BY 1) JOIN bt USING (label)",
       S.chain(LD, boot_sql("ld", "label", "mean", BOOT, "bt")))
def _(spark, d):
    return R.bootstrap_ci(label_days(spark, d), LABEL, "mean", BOOT)


CLS = S.chain(P, """cls AS (SELECT day, CASE WHEN isodow(day)>=6 THEN 'OFF' ELSE 'WORK' END grp,
 avg((metric>=50)::INT) strength FROM panel GROUP BY 1)""")


def day_strength(spark, d):
    return A.daily_strength(panel(spark, d), 50).withColumn(
        "grp", F.when(F.weekday("day") >= 5, "OFF").otherwise("WORK"))


@query("J11_bootstrap_diff_ci", "observed:f ci_low:f ci_high:f p_positive:f", """
SELECT o.observed, quantile_cont(diff,0.025) ci_low, quantile_cont(diff,0.975) ci_high, avg((diff>0)::INT) p_positive FROM (
 SELECT rep, max(boot_mean) FILTER (grp='OFF')-max(boot_mean) FILTER (grp='WORK') diff FROM bd_m GROUP BY 1),
 (SELECT avg(strength) FILTER (grp='OFF')-avg(strength) FILTER (grp='WORK') observed FROM cls) o GROUP BY 1""",
       S.chain(CLS, boot_sql("cls", "grp", "strength", DIFF, "bd")))
def _(spark, d):
    return R.bootstrap_diff_ci(day_strength(spark, d), "grp", "OFF", "WORK", "strength", DIFF)


@query("J12_signflip_test", "label:s observed:f p_value:f null_low:f null_high:f", f"""
SELECT label, max(obs) observed, (1+count(*) FILTER (abs(round(nul,9))>=abs(round(obs,9))))/(count(*)+1) p_value,
 quantile_cont(nul,0.025) null_low, quantile_cont(nul,0.975) null_high FROM (
 SELECT label, rep, avg(CASE WHEN {S.u('label', 'day', 'rep', "'s'")}<0.5 THEN -mean ELSE mean END) nul, avg(mean) obs
 FROM ld, (SELECT unnest(range(1,{FLIPS + 1})) rep) GROUP BY 1, 2) GROUP BY 1""", LD)
def _(spark, d):
    return R.signflip_test(label_days(spark, d), LABEL, "mean", FLIPS)


WKS = S.chain(LD, """wks AS (SELECT label, date_trunc('week', day)::DATE AS day, avg(mean) mean FROM ld GROUP BY 1, 2)""")


def weeks(spark, d):
    return label_days(spark, d).groupBy(*LABEL, F.date_trunc("week", "day").cast("date").alias("day")).agg(
        F.avg("mean").alias("mean"))


@query("J13_exact_sign_test", "label:s n:i p_value:f", """
SELECT label, n, (count(*) FILTER (round(abs(s),9)>=round(abs(o),9))+1)/(count(*)+1) p_value FROM (
 SELECT label, any_value(n) n, m, sum(CASE WHEN (m >> i) & 1 = 1 THEN -mean ELSE mean END) s, sum(mean) o FROM (
 SELECT label, mean, row_number() OVER (PARTITION BY label ORDER BY day)-1 i, count(*) OVER (PARTITION BY label) n FROM wks
 WHERE mean<>0), (SELECT unnest(range(32)) m) WHERE m < (1 << n::INT) GROUP BY label, m) GROUP BY 1, 2""", WKS)
def _(spark, d):
    return R.exact_sign_test(weeks(spark, d), LABEL, "mean")


@query("J14_cohens_d", "label:s n:i cohens_d:f",
       "SELECT label, count(*) n, avg(mean)/nullif(stddev_samp(mean),0) cohens_d FROM ld GROUP BY 1", LD)
def _(spark, d):
    return R.cohens_d(label_days(spark, d), LABEL, "mean")


_lo, _hi = S.wilson("wins", "n")


@query("J15_wilson", "entity_id:i n:i wins:i win_rate:f ci_low:f ci_high:f", f"""
SELECT *, wins/n win_rate, {_lo} ci_low, {_hi} ci_high FROM (SELECT entity_id, count(*) n, count(*) FILTER (metric>0) wins
FROM panel GROUP BY 1)""", P)
def _(spark, d):
    return R.wilson_rows(panel(spark, d), ["site", "entity_id"])


DEALS, DEALS_OF_DAYS = 1000, 10_000


@query("J16_perm_diff_test", "observed:f p_value:f", """
SELECT max(obs) observed, (1+count(*) FILTER (abs(round(nul,9))>=abs(round(obs,9))))/(count(*)+1) p_value FROM (
 SELECT nul, max(nul) FILTER (rep=0) OVER () obs, rep FROM (
 SELECT rep, avg(strength) FILTER (strong)-avg(strength) FILTER (NOT strong) nul FROM prm GROUP BY 1)) WHERE rep>0""",
       S.chain(CLS, "off AS (SELECT *, grp='OFF' strong FROM cls)", S.deal("off", DEALS_OF_DAYS, "", "day", "p", "prm")))
def _(spark, d):
    return R.perm_diff_test(day_strength(spark, d), "grp", "OFF", "strength", DEALS_OF_DAYS)


_AT = range(21)  # slots of a segment of the test layout
SPA = f"""seg AS (SELECT day, rep, island_id, side, sum(1 << slot_index) e, sum(CASE WHEN strong THEN 1 << slot_index ELSE 0 END) b
 FROM prm GROUP BY ALL),
cnt AS (SELECT day, rep, {", ".join(f"sum({' + '.join(f'(((e::BIGINT >> {i}) & {(1 << n) - 1}) = {(1 << n) - 1} AND bit_count((b::BIGINT >> {i}) & {(1 << n) - 1}) >= {k})::INT' for i in _AT)}) AS {c}"
                                    for c, n, k in (("pairs", 2, 2), ("triples", 3, 3), ("fives", 5, 3)))} FROM seg GROUP BY 1, 2)"""
RECT = S.chain(P, S.LAYOUT, "rect AS (SELECT *, metric>=0 strong FROM panel JOIN layout USING (entity_id) WHERE shape='rect')")
NULL_SPEC = "statistic:s observed:f null_mean:f null_low:f null_high:f p_upper:f effect:f ratio:f"


def null_sql(src, stats, by):
    long = " UNION ALL ".join(f"SELECT {by}, rep, '{s}' statistic, {s} AS v FROM {src}" for s in stats)
    return f"""SELECT *, observed-null_mean effect, observed/nullif(null_mean,0) ratio FROM (
 SELECT {by}, statistic, max(v) FILTER (rep=0) observed, avg(v) FILTER (rep>0) null_mean,
 quantile_cont(v,0.025) FILTER (rep>0) null_low, quantile_cont(v,0.975) FILTER (rep>0) null_high,
 (1+count(*) FILTER (rep>0 AND v>=ob))/(count(*) FILTER (rep>0)+1) p_upper FROM (
 SELECT *, max(v) FILTER (rep=0) OVER (PARTITION BY {by}, statistic) ob FROM ({long})) GROUP BY ALL)"""


STATS = ["pairs", "triples", "fives"]
for _n, _w in (("spatial", ""), ("within_label", "label")):
    @query(f"J{17 if not _w else 18}_{_n}_test", f"day:d {NULL_SPEC}", null_sql("cnt", STATS, "day"),
           S.chain(RECT, S.deal("rect", DEALS, f"day, {_w}" if _w else "day", "entity_id", "x", "prm"), SPA))
    def _(spark, d, _w=_w):
        p = panel(spark, d)
        return R.spatial_test(p, PN.layout_of(p), 0, DEALS, [_w] if _w else [])


GEV = """gev AS (SELECT day, rep, count(*) FILTER (e) overall, count(*) FILTER (e AND size<=4) s3_4,
 count(*) FILTER (e AND size BETWEEN 5 AND 9) s5_9, count(*) FILTER (e AND size>=10) s10 FROM (
 SELECT day, rep, label, count(*) size, count(*) FILTER (strong)>=ceil(count(*)*2.0/3.0) e FROM prm GROUP BY 1, 2, 3
 HAVING count(*)>=3) GROUP BY 1, 2)"""


@query("J19_group_event_test", f"day:d {NULL_SPEC}", null_sql("gev", ["overall", "s3_4", "s5_9", "s10"], "day"),
       S.chain(P, "gx AS (SELECT *, metric>=-60 strong FROM panel)", S.deal("gx", DEALS, "day", "entity_id", "g", "prm"), GEV))
def _(spark, d):
    return R.group_event_test(panel(spark, d), -60, DEALS)


@query("J20_period_summary", f"period:s {NULL_SPEC}", null_sql("per", STATS, "period"),
       S.chain(RECT, S.deal("rect", DEALS, "day", "entity_id", "x", "prm"), SPA, """per AS (SELECT period, rep, sum(pairs) pairs, sum(triples) triples,
 sum(fives) fives FROM (SELECT *, 'FULL' AS period FROM cnt UNION ALL SELECT *, CASE WHEN day<DATE '2024-01-16' THEN 'DEV'
 ELSE 'LATER' END FROM cnt) GROUP BY 1, 2)"""))
def _(spark, d):
    p = panel(spark, d)
    return R.period_summary(R.spatial_counts(p, PN.layout_of(p), 0, DEALS), STATS, "2024-01-16")


@query("J21_holm", "name:s p_value:f p_holm:f", f"""
SELECT name, p_value, max(raw) OVER (ORDER BY p_value, name ROWS UNBOUNDED PRECEDING) p_holm FROM (
 SELECT *, least(1, p_value*(count(*) OVER ()-row_number() OVER (ORDER BY p_value, name)+1)) raw FROM (
 SELECT label AS name, (1+count(*) FILTER (abs(round(nul,9))>=abs(round(obs,9))))/(count(*)+1) p_value FROM (
 SELECT label, rep, avg(CASE WHEN {S.u('label', 'day', 'rep', "'s'")}<0.5 THEN -mean ELSE mean END) nul, avg(mean) obs
 FROM (SELECT label, day, mean-(SELECT avg(mean) FROM ld) mean FROM ld), (SELECT unnest(range(1,{FLIPS + 1})) rep) GROUP BY 1, 2)
 GROUP BY 1))""", LD)
def _(spark, d):
    x = label_days(spark, d)
    centre = x.groupBy(*SITE).agg(F.avg("mean").alias("_c"))
    x = x.join(centre, SITE).withColumn("mean", F.col("mean") - F.col("_c"))
    t = R.signflip_test(x, LABEL, "mean", FLIPS).withColumnRenamed("label", "name")
    return R.holm(t, SITE)
