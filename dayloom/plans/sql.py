"""Common table expressions shared by the comparison SQL."""

from dayloom.operators import deals as D

PANEL = """panel AS (
  SELECT user_id AS entity_id, CAST(ts AS DATE) AS day, arg_max(event_type, event_id) AS label,
         CAST(count(*) AS DOUBLE) AS activity,
         round(sum(CASE WHEN event_type = 'error' THEN -value ELSE value END - 50), 2) AS metric,
         count(*) FILTER (WHERE event_type = 'purchase') AS c1,
         count(*) FILTER (WHERE event_type = 'error') AS c2
  FROM events GROUP BY 1, 2)"""

LINES = """panel AS (
  SELECT l_suppkey AS entity_id, CAST(l_shipdate AS DATE) AS day,
         arg_max(p_brand, (l_orderkey * 10 + l_linenumber, l_partkey)) AS label, sum(l_quantity) AS activity,
         CAST(sum(CAST(l_extendedprice AS DECIMAL(18,2)) * (1 - CAST(l_discount AS DECIMAL(4,2)))
              * (CASE WHEN l_returnflag = 'R' THEN -1 ELSE 1 END)) AS DOUBLE) AS metric,
         count(*) FILTER (WHERE l_returnflag = 'A') AS c1, count(*) FILTER (WHERE l_returnflag = 'R') AS c2
  FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY 1, 2)"""

LAYOUT = """layout AS (
  SELECT DISTINCT entity_id, CAST(entity_id // 20 AS VARCHAR) AS island_id,
         CASE WHEN (entity_id // 20) % 2 = 0 THEN 'N' ELSE 'S' END AS side,
         entity_id % 20 + 1 AS position_order,
         entity_id % 20 + (CASE WHEN entity_id % 20 >= 7 THEN 1 ELSE 0 END) AS slot_index,
         CASE WHEN entity_id // 20 = 3 THEN 'arc' ELSE 'rect' END AS shape
  FROM panel)"""

SECOND = """second AS (
  SELECT entity_id, day, label, activity,
         CASE WHEN entity_id % 13 = 0 THEN metric + 1 ELSE metric END AS metric, c1, c2
  FROM panel WHERE entity_id % 17 <> 0)"""


def chain(*parts: str) -> str:
    return ",\n".join(parts)


def u(*parts: str) -> str:
    """The MD5 uniform of functions.expr.uniform, in SQL."""
    key = " || '|' || ".join(f"CAST({p} AS VARCHAR)" for p in parts)
    return f"(CAST(('0x' || substr(md5({key}), 1, 8)) AS BIGINT) / 4294967296.0::DOUBLE)"


def wilson(k: str, n: str, z: str = "1.959963984540054::DOUBLE") -> tuple[str, str]:
    p = f"(({k})::DOUBLE / ({n}))"
    den = f"(1 + {z}*{z}/({n}))"
    centre = f"(({p} + {z}*{z}/(2*({n}))) / {den})"
    half = f"({z} * sqrt({p}*(1-{p})/({n}) + {z}*{z}/(4.0::DOUBLE*({n})*({n}))) / {den})"
    return f"greatest(0.0::DOUBLE, {centre} - {half})", f"least(1.0::DOUBLE, {centre} + {half})"


def feats(src: str = "panel", t1: int = 100, t2: int = 200, name: str = "feats") -> str:
    """operators.features.rank_features as window SQL over the CTE ``src``."""
    past = "ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING"

    def before(key: str, cte: str, col: str) -> str:
        by = f"PARTITION BY {key} " if key else ""
        k = f"{key}, " if key else ""
        return (f"{cte} AS (SELECT {k}day, sum(s) OVER w / sum(c) OVER w AS {col} FROM (SELECT {k}day, sum(metric) s, "
                f"count(metric) c FROM x_{name} GROUP BY ALL) WINDOW w AS ({by}ORDER BY day {past}))")

    return f"""x_{name} AS (SELECT *, isodow(day)-1 wd, entity_id//10*10 band10, entity_id//50*50 band50 FROM {src}),
h_{name} AS (SELECT * FROM (SELECT *, count(metric) OVER (e {past}) hist_n, sum(metric) OVER (e {past}) hsum,
  avg(metric) OVER (e {past}) avg_all, avg(metric) OVER (e ROWS BETWEEN 7 PRECEDING AND 1 PRECEDING) recent7,
  avg((metric>0)::INT) OVER (e ROWS BETWEEN 7 PRECEDING AND 1 PRECEDING) recent7_win, lag(metric) OVER e AS last,
  lag(metric,2) OVER e AS prev2, lag(label) OVER e AS last_label, avg((metric>={t1})::INT) OVER (e {past}) rate1,
  avg((metric>={t2})::INT) OVER (e {past}) rate2, count(metric) OVER (ew {past}) wn, avg(metric) OVER (ew {past}) wavg
  FROM x_{name} WINDOW e AS (PARTITION BY entity_id ORDER BY day), ew AS (PARTITION BY entity_id, wd ORDER BY day))
  WHERE hist_n>0 AND last_label=label),
{before('label', 'la_' + name, 'label_avg')},
{before('band10', 'b1_' + name, 'band10_avg')},
{before('band50', 'b5_' + name, 'band50_avg')},
{before('', 'sa_' + name, 'site_avg')},
nd_{name} AS (SELECT day, lead(day) OVER (ORDER BY day) next_day FROM (SELECT DISTINCT day FROM {src})),
nb_{name} AS (SELECT next_day AS day, entity_id + k AS entity_id, avg(metric) nb FROM {src} JOIN nd_{name} USING (day),
  (SELECT unnest([-1,1]) k) GROUP BY 1, 2),
ed_{name} AS (SELECT entity_id, least(entity_id-min(entity_id) OVER g, max(entity_id) OVER g-entity_id) dist FROM (
  SELECT entity_id, entity_id-row_number() OVER (ORDER BY entity_id) k FROM (SELECT DISTINCT entity_id FROM {src}))
  WINDOW g AS (PARTITION BY k)),
{name} AS (SELECT day, entity_id, label, metric, activity, hist_n, avg_all, recent7, last,
  last-coalesce(prev2,last) change, coalesce(wavg,avg_all)*(wn/(wn+15.0::DOUBLE))+avg_all*(1-wn/(wn+15.0::DOUBLE)) weekday_avg,
  coalesce(label_avg,0) label_avg, rate1, rate2, coalesce(nb,0) neighbour, recent7_win,
  CASE WHEN last<={-t1} THEN 1.0 WHEN last<={-t1 / 2} THEN 0.5 WHEN last>={t1} THEN -0.25 ELSE 0 END bounce,
  (hsum+site_avg*30)/(hist_n+30) entity_shrunk, coalesce(band10_avg,site_avg) band10_avg,
  coalesce(band50_avg,site_avg) band50_avg,
  CASE WHEN dist=0 THEN 1.0 WHEN dist=1 THEN 0.75 WHEN dist=2 THEN 0.5 WHEN dist<=4 THEN 0.25 ELSE 0 END AS edge
  FROM h_{name} JOIN la_{name} USING (label, day) LEFT JOIN b1_{name} USING (band10, day)
  LEFT JOIN b5_{name} USING (band50, day) JOIN sa_{name} USING (day) LEFT JOIN nb_{name} USING (day, entity_id)
  LEFT JOIN ed_{name} USING (entity_id))"""


def comp(f: str, by: str = "day", where: str = "") -> str:
    """0..100 component of one factor."""
    flt = f"FILTER ({where})" if where else ""
    w = f"OVER (PARTITION BY {by})"
    z = f"coalesce(({f}-avg({f}) {flt} {w})/nullif(stddev_pop({f}) {flt} {w},0),0)"
    return f"greatest(0, least(100, 50+12.5*{z}))"


def scored(weights: dict, src: str = "feats", name: str = "scored", by: str = "day", where: str = "",
           keep: str = "*") -> str:
    total = " + ".join(f"{w!r}::DOUBLE*{comp(f, by, where)}" for f, w in weights.items())
    return f"{name} AS (SELECT {keep}, round({total}, 9) AS score FROM {src})"


def components(factors, src: str = "feats", name: str = "comps") -> str:
    cols = ", ".join(f"{comp(f)} AS k_{f}" for f in factors)
    return f"{name} AS (SELECT *, {cols} FROM {src})"


def models(modes: dict, name: str = "modes", src: str = "comps") -> str:
    """Long table of scores: one row per (model, day, entity)."""
    parts = []
    for m, w in modes.items():
        total = " + ".join(f"{v!r}::DOUBLE*k_{f}" for f, v in w.items())
        parts.append(f"SELECT '{m}' AS model, * EXCLUDE (score), score FROM (SELECT *, round({total}, 9) score FROM {src})")
    return f"{name} AS (" + "\nUNION ALL ".join(parts) + ")"


def picks(src: str = "scored", name: str = "picks", n: int = 10, by: str = "day") -> str:
    return (f"{name} AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY {by} ORDER BY score DESC, entity_id) "
            f"AS rank FROM {src}) WHERE rank<={n})")


def deal(src: str, reps: int, group: str, order: str, seed: str, name: str, first: int | None = None) -> str:
    """operators.deals in SQL: CTE ``name`` has the rows of ``src`` once for each rep from 0 on, with the image x of their number.

    ``src`` has a flag strong, which is the dealt one from rep 1 on. With ``first`` only the images of the first numbers are made.
    """
    def mix(v):
        for _ in range(2):
            v = f"((xor({v}, ({v}) >> 16) * {D.SPREAD}) & {D.MASK})"
        return v

    rounds = range(1, D.ROUNDS + 1)
    key = " || '|' || ".join(f"CAST({p} AS VARCHAR)" for p in [*group.split(", "), f"'{seed}'"] if p)
    keys = f"SELECT {group + ', ' if group else ''}n, m, rep, [{', '.join(mix(f'((own + {t}) & {D.MASK})') for t in rounds)}] AS ks FROM grid_{name}"
    other = "((k % n + n - x) % n)"
    swap = f"lambda x, k: CASE WHEN {mix(f'((greatest(x, {other}) + k) & {D.MASK})')} >= 2147483648 THEN {other} ELSE x END"
    join = f"nrs_{name} JOIN keys_{name} USING ({group})" if group else f"nrs_{name}, keys_{name}"
    x = f"SELECT * EXCLUDE (ks), list_reduce(list_prepend(nr, ks), {swap}) AS x FROM {join}"
    over = f"PARTITION BY {group} " if group else ""
    return f"""nrs_{name} AS (SELECT *, row_number() OVER ({over}ORDER BY {order}) - 1 AS nr FROM {src}{f' QUALIFY nr < {first}' if first else ''}),
grid_{name} AS (SELECT *, {mix(f"((key + rep * {D.STEP}) & {D.MASK})")} AS own FROM (
 SELECT {group + ', ' if group else ''}count(*) n, count(*) FILTER (strong) m, CAST(('0x' || substr(md5({key}), 1, 8)) AS BIGINT) AS key FROM {src} {'GROUP BY ' + group if group else ''}),
 (SELECT unnest(range(0, {reps + 1})) rep)),
keys_{name} AS ({keys}),
{name} AS (SELECT * EXCLUDE (strong, x, m, n, nr), CASE WHEN rep = 0 THEN strong ELSE x < m END AS strong, x, n FROM ({x}))"""
