"""Run registered queries against DuckDB on the same tables.

    python tests/parity.py [sf] [name-prefix ...]
"""

import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

TABLES = ("region nation customer supplier part orders lineitem events documents embeddings pages "
          "benchmark labels conversations").split()


def duck(folder):
    import duckdb

    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{folder}/{t}.parquet'")
    return con


def rows_of(pdf):
    import math

    def norm(v):
        if v is None or (isinstance(v, float) and math.isnan(v)) or str(v) in ("NaT", "<NA>"):
            return None
        if hasattr(v, "item"):
            v = v.item()
        return float(v) if isinstance(v, int) and not isinstance(v, bool) else v

    cols = sorted(pdf.columns)
    out = [tuple(norm(v) for v in r) for r in pdf[cols].itertuples(index=False, name=None)]
    return cols, sorted(out, key=lambda r: tuple((x is not None, str(type(x)), x) for x in r))


def compare(spark, con, folder, fn, sql):
    """(ok, rows, message)"""
    got = fn(spark, folder).toPandas()
    if sql is None:
        return True, len(got), "rows only"
    want = con.execute(sql).df()
    gc, g = rows_of(got)
    wc, w = rows_of(want)
    if gc != wc:
        return False, len(got), f"columns {gc} vs {wc}"
    if len(g) != len(w):
        return False, len(got), f"rows {len(g)} vs {len(w)}"
    bad = [(a, b) for a, b in zip(g, w) if a != b]
    if bad:
        return False, len(got), f"{len(bad)} rows differ, first\n   {gc}\n   spark {bad[0][0]}\n   duck  {bad[0][1]}"
    dtypes = [(c, str(a), str(b)) for c, a, b in zip(gc, got[gc].dtypes, want[gc].dtypes) if str(a) != str(b)]
    return True, len(got), f"dtypes {dtypes}" if dtypes and len(g) else ""


def main(argv):
    import importlib

    from dayloom import plans
    from dayloom.plans import registry
    from dayloom.session import local_session

    sf = argv[0] if argv else "0.01"
    prefixes = argv[1:]
    folder = sf if sf.startswith("/") else f"/root/testdata/sf{sf}"
    for fam in plans.FAMILIES:
        if importlib.util.find_spec(f"dayloom.plans.{fam}"):
            importlib.import_module(f"dayloom.plans.{fam}")
    spark = local_session(8)
    con = duck(folder)
    failed, slow = [], []
    names = [n for n in registry.QUERIES if not prefixes or any(n.startswith(p) for p in prefixes)]
    for name in names:
        t0 = time.time()
        try:
            ok, n, msg = compare(spark, con, folder, registry.QUERIES[name], registry.SQL.get(name))
        except Exception as e:  # noqa: BLE001 - report and go on
            ok, n, msg = False, -1, f"{type(e).__name__}: {str(e)[:700]}"
        dt = time.time() - t0
        if dt > 4:
            slow.append((name, round(dt, 1)))
        empty = " EMPTY" if n == 0 else ""
        if not ok or msg or empty:
            print(f"{'ok  ' if ok else 'FAIL'} {name} rows={n}{empty} {dt:.1f}s {msg}", flush=True)
        if not ok:
            failed.append(name)
    print(f"{len(names)} queries, {len(failed)} failed: {failed}\nslow: {slow}")
    return 1 if failed else 0


if __name__ == "__main__":
    sys.exit(main(sys.argv[1:]))
