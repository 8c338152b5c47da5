"""Files, pages, snapshots and stateful streams."""

import datetime as dt

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from dayloom.panel import KEY, PANEL
from dayloom.session import scratch_path
from dayloom.sources import files as FI
from dayloom.sources import html as H
from dayloom.sources import splits as SP
from dayloom.streaming import jobs as L

HEAD = "日付,台番号,機種名,G数,差枚,BB,RB"


def test_daily_files_in_three_encodings_and_bad_ones(spark, tmp_path):
    (tmp_path / "20240101.csv").write_text(HEAD + '\n2024-01-01,1,機種Ａ,"5,307","-1,200",3,4\n', encoding="utf-8-sig")
    (tmp_path / "20240102.csv").write_text("台番号,差枚,日付,機種名\n2,+50,2024/01/02,機種Ｂ\n", encoding="cp932")
    (tmp_path / "20240103.csv").write_text(HEAD + "\n2024-01-04,3,C,x,10,0,0\n\n", encoding="utf-8")
    (tmp_path / "empty.csv").write_text("")
    (tmp_path / "foreign.csv").write_text("a,b\n1,2\n")
    raw = FI.read_daily_files(spark, str(tmp_path))
    got = {r.entity_id: r for r in FI.to_panel(raw, "s").collect()}
    assert set(got) == {1, 2, 3}
    assert (got[1].activity, got[1].metric, got[1].c2) == (5307.0, -1200.0, 4)
    assert (got[2].label, got[2].metric, got[2].activity, got[2].day) == ("機種Ｂ", 50.0, None, dt.date(2024, 1, 2))
    assert FI.to_panel(raw, "s", zero_on_error=True).where("entity_id = 3").first().activity == 0.0
    bad = {r.file_day: r.mismatched for r in FI.check_file_day(raw).collect()}
    assert bad == {dt.date(2024, 1, 1): 0, dt.date(2024, 1, 2): 0, dt.date(2024, 1, 3): 1}


def test_the_day_of_a_file_is_not_in_its_folders(spark):
    """Numbers of applications and generated names hold digits that look like days."""
    day = "2024-01-05"
    paths = ["/x/dayloom-app-20261130134412-0000/daily/site=S0/file_day=2024-01-05/part-0.csv", "/x/local-1792013045612/2024-01-05.csv",
             "/x/daily-0b20481130ff4c0da0b1f2a3b4c5d6e7/file_day=2024-01-05/part-00000-20261130-1f2a-4c0d-a0b1-f2a3b4c5d6e7.c000.csv",
             "/x/20231231/20240105.csv", "/x/hall_20240105_v2.csv"]
    df = spark.createDataFrame([(p, day) for p in paths], "path string, day string")
    got = FI.check_file_day(df).collect()
    assert {r.path: (str(r.file_day), r.mismatched) for r in got} == {p: (day, 0) for p in paths}


def test_files_are_read_by_splits(spark, tmp_path):
    """Splits of some bytes, line breaks and commas in cells, doubled marks, CRLF, short and long records, cp932 among them."""
    import csv
    import io

    from dayloom.sources import splits as SP

    rs = __import__("random").Random(3)
    names, want, widths = ["20240101.csv", "20240102.csv", "20240103.csv"], {}, {}
    for k, name in enumerate(names):
        out = io.StringIO()
        w = csv.writer(out, lineterminator="\r\n" if k == 1 else "\n")
        w.writerow(["日付", "台番号", "機種名", "差枚"])
        few = many = blank = 0
        for i in range(30):
            row = ["2024-01-0%d" % (k + 1), str(i), rs.choice(["機種,ア", 'say "hi"', "two\nlines", "plain", '"', "a\n\n,b", ""]) if k < 2 else "plain", str(rs.randint(-9, 9))]
            if k == 2 and i % 10 == 0:
                row = row[:2] if i % 20 else row + ["extra", "more"]
                few, many = few + (i % 20 > 0), many + (i % 20 == 0)
            if k == 2 and i == 5:
                row, blank = ["", " ", "", ""], blank + 1
            w.writerow(row)
        raw = out.getvalue().encode("cp932" if k == 1 else "utf-8")
        (tmp_path / name).write_bytes(raw)
        rows = list(csv.reader(io.StringIO(raw.decode("cp932" if k == 1 else "utf-8"), newline="")))
        want[name] = sorted((r[1] if len(r) > 1 else None, r[2].replace("\r\n", "\n") if len(r) > 2 else None, r[3] if len(r) > 3 else None) for r in rows[1:] if any(c.strip() for c in r))
        widths[name] = (4, 30, few, many, blank)
    (tmp_path / "20240104.csv").write_bytes(b"\x81\xff\xfe,\n")
    (tmp_path / "20240105.csv").write_bytes(b"")
    old = spark.conf.get("spark.sql.files.maxPartitionBytes")
    for size in ("300", "128m"):
        spark.conf.set("spark.sql.files.maxPartitionBytes", size)
        try:
            rows = FI.read_daily_files(spark, str(tmp_path)).collect()
            tasks = SP.raw_lines(spark, str(tmp_path)).rdd.getNumPartitions()
            report = SP.row_widths(spark, str(tmp_path)).collect()
        finally:
            spark.conf.set("spark.sql.files.maxPartitionBytes", old)
        assert tasks > 6 or size != "300"
        got = {}
        for r in rows:
            got.setdefault(r.path.rsplit("/", 1)[1], []).append((r.entity_id, r.label, r.metric))
        assert {k: sorted(v, key=str) for k, v in got.items()} == {k: sorted(v, key=str) for k, v in want.items()}, size
        assert {r.path.rsplit("/", 1)[1]: (r["columns"], r.records, r.too_few, r.too_many, r.blank) for r in report} == widths
    check = {r.path.rsplit("/", 1)[1]: (r.equal, r.missing, r.surplus) for r in SP.header_check(spark, str(tmp_path), ["day", "entity_id", "label", "metric"]).collect()}
    assert check == {n: (True, "", "") for n in names}


def test_columns_resolve_by_first_spelling(spark):
    df = spark.createDataFrame([(1, 2)], "`差枚` int, diff int")
    assert FI.resolve_columns(df, {"metric": ["差枚", "diff"]}).first().metric == 1
    with pytest.raises(Exception, match="missing columns"):
        FI.resolve_columns(df, {"label": ["機種名"]})


def test_main_table_by_id_else_largest_fit(spark):
    head = "<tr><th>台番号</th><th>日付</th><th>機種名</th><th>差枚</th></tr>"
    row = lambda i: f"<tr><td>{i}</td><td>2024-01-01</td><td>A &amp; B</td><td>-5<br></td></tr>"
    small, big = f"<table>{head}{row(1)}</table>", f"<table>{head}{row(2)}{row(3)}</table>"
    named = f"<table id='all_data_table'>{head}{row(9)}</table>"
    pages = spark.createDataFrame([(1, small + big), (2, big + named), (3, "<table><tr><td>x</td></tr></table>")],
                                  "page_id bigint, html string")
    t = H.table_to_text_rows(H.extract_tables(pages), ["entity_id", "label", "c1"])
    got = sorted((r.page_id, r.entity_id, r.label, r.c1) for r in t.collect())
    assert got == [(1, "2", "A & B", None), (1, "3", "A & B", None), (2, "9", "A & B", None)]


def test_freeze_is_write_once_and_tampering_shows(spark, make):
    p = make([(1, 1, "A", 1), (1, 2, "B", 2), (2, 1, "A", 3)])
    path = scratch_path(spark, "freeze")
    cols = ["day", "entity_id", "metric"]
    FI.freeze({"actual": p}, path, {"actual": cols})
    with pytest.raises(Exception, match="(?i)already exists"):
        FI.freeze({"actual": p}, path, {"actual": cols})
    m = FI.fingerprint(p, cols, ["day"])
    changed = p.withColumn("metric", F.when(F.col("entity_id") == 2, 9.0).otherwise(F.col("metric")))
    states = {r.day.day: r.state for r in FI.verify_manifest(changed, m, cols, ["day"]).collect()}
    assert states == {1: "CHANGED", 2: "MATCH"}


def test_fingerprint_ignores_order_but_not_copies(make):
    a = make([(1, 1, "A", 1), (1, 2, "B", 2)])
    cols = ["entity_id", "metric"]
    one = lambda df: FI.fingerprint(df, cols).first().fingerprint
    assert one(a) == one(a.orderBy(F.desc("entity_id")).repartition(3))
    assert one(a) != one(a.unionByName(a))


def test_tables_leave_a_task_in_small_batches(spark):
    """A batch of 600 pages is not held as rows: none given out has more than HELD of them."""
    rows = "".join(f"<tr><td>{i}</td><td>2024-01-01</td><td>A</td><td>{i}</td></tr>" for i in range(20))
    html = f"<table><tr><th>entity_id</th><th>day</th><th>label</th><th>metric</th></tr>{rows}</table>"

    class Pages:
        """Hands out the function that runs in a task."""

        select = lambda self, *columns: self
        mapInArrow = mapInPandas = lambda self, run, fields: run

    batch = pa.RecordBatch.from_pydict({"page_id": list(range(600)), "html": [html] * 600})
    got = list(H.extract_tables(Pages())(iter([batch])))
    assert sum(len(b) for b in got) == 12_000 and max(len(b) for b in got) <= H.HELD
    assert H.extract_tables(spark.range(600).select(F.col("id").alias("page_id"), F.lit(html).alias("html"))).count() == 12_000


def test_zero_has_one_text_whatever_its_sign(spark, make, tmp_path):
    """Two values whose sum is a hair below zero: rounding leaves a minus sign in one engine and none in the other."""
    import duckdb

    from dayloom.plans import load_all, registry

    a, b = make([(1, 1, "A", 0.0)]), make([(1, 1, "A", -0.0)])
    assert FI.row_hash(a, ["metric"]).first().digest == FI.row_hash(b, ["metric"]).first().digest
    load_all()
    x, y = next((x / 100, y / 100) for x in range(1, 20_000) for y in [10_000 - x] if 0 > (x / 100 - 50) + (y / 100 - 50) > -1e-9)
    rows = [(1, dt.datetime(2024, 1, 1), 7, "view", x), (2, dt.datetime(2024, 1, 1), 7, "view", y)]
    spark.createDataFrame(rows, "event_id long, ts timestamp_ntz, user_id long, event_type string, value double").write.parquet(str(tmp_path / "events.parquet"))
    con = duckdb.connect()
    con.execute(f"CREATE VIEW events AS SELECT * FROM '{tmp_path}/events.parquet/*.parquet'")
    con.execute("CREATE MACRO round_even(x, n) AS round(x, n)")
    for name in ("A14_freeze", "A15_row_hash", "A15_fingerprint"):
        assert [tuple(r) for r in registry.QUERIES[name](spark, str(tmp_path)).collect()] == con.execute(registry.SQL[name]).fetchall()


def test_upsert_rejects_or_replaces(make):
    base, new = make([(1, 1, "A", 1)]), make([(1, 1, "A", 5)])
    with pytest.raises(Exception, match="duplicate key"):
        FI.upsert(base, new).collect()
    assert [r.metric for r in FI.upsert(base, new, replace=True).collect()] == [5.0]


def test_registry_defects(spark, tmp_path):
    good = "a" * 64
    (tmp_path / "r.json").write_text(
        '{"schema_version": 1, "entries": ['
        f'{{"status":"ACTIVE","store":"s","target_date":"2024-01-01","category":"X","prediction_sha256":"{good}"}},'
        f'{{"status":"ACTIVE","store":" ","target_date":"bad","category":"Z","prediction_sha256":"1"}},'
        f'{{"status":"OPEN","store":"s","target_date":"2024-01-01","category":"X","prediction_sha256":"{good}"}}]}}')
    got = sorted(r.reasons for r in FI.read_registry(spark, str(tmp_path / "r.json"), ["X"]).collect())
    assert got == ["DUPLICATE", "STATUS; DUPLICATE", "STORE; TARGET_DATE; CATEGORY; SHA256"]
    (tmp_path / "v.json").write_text('{"schema_version": 2, "entries": []}')
    with pytest.raises(Exception, match="schema version"):
        FI.read_registry(spark, str(tmp_path / "v.json"), ["X"]).collect()


def test_guard_fails_closed(spark):
    root = scratch_path(spark, "guard-test")
    cs = "site string, day date, changes bigint, signature string, comparable boolean"
    day = lambda n: dt.date(2024, 1, n)

    def run(changes, approvals):
        spark.createDataFrame(changes, cs).write.mode("append").parquet(f"{root}/c")
        spark.createDataFrame(approvals, "site string, day date, signature string").write.mode("append").parquet(f"{root}/a")
        s = L.stream_guard(
            L.file_stream(spark, f"{root}/c", spark.createDataFrame([], cs).schema),
            L.file_stream(spark, f"{root}/a", spark.createDataFrame([], "site string, day date, signature string").schema))
        L.run_to_table(s, f"{root}/out", f"{root}/ck")

    run([("s", day(1), 0, "gap:1", False), ("s", day(2), 3, "x", True), ("s", day(3), 0, "", True)], [("s", day(1), "gap:1"), ("s", day(1), "x")])
    run([("s", day(4), 2, "y", True), ("s", day(5), 0, "", True)], [("s", day(4), "x")])  # y came while x was open
    run([("s", day(6), 3, "x", True), ("s", day(7), 0, "", True), ("s", day(8), 5, "x", True)], [("s", day(6), "y")])
    run([("s", day(10), 0, "gap:10", False), ("s", day(11), 7, "z", True)], [("s", day(9), "planned:2024-01-11"), ("s", day(10), "gap:10")])  # no plan: nothing to approve
    got = {r.day.day: r.status for r in spark.read.parquet(f"{root}/out").collect()}
    assert got == {1: "MANUAL_REVIEW", 2: "MANUAL_REVIEW", 3: "MANUAL_REVIEW", 4: "MANUAL_REVIEW", 5: "MANUAL_REVIEW", 6: "MANUAL_REVIEW",
                   7: "PASS", 8: "APPROVED", 10: "MANUAL_REVIEW", 11: "MANUAL_REVIEW"}


def test_change_signature_sees_added_and_removed_ids_and_gaps(make):
    p = make([(1, 1, "A", 0), (1, 2, "A", 0), (2, 1, "A", 0), (3, 1, "A", 0), (3, 3, "B", 0), (4, 1, "B", 0), (4, 3, "B", 0), (6, 1, "B", 0), (7, 1, "B", 0)])
    got = {r.day.day: (r.changes, r.comparable) for r in L.change_signature(p).collect()}
    assert got == {1: (0, False), 2: (1, True), 3: (1, True), 4: (1, True), 6: (0, False), 7: (0, True)}


def test_stream_epochs_reports_late_rows(spark, make):
    root = scratch_path(spark, "epoch-test")
    for part in ([(1, 1, "A", 0), (3, 1, "B", 0)], [(2, 1, "C", 0), (4, 1, "B", 0), (5, 1, "A", 0)]):
        make(part).write.mode("append").parquet(f"{root}/in")
        L.run_to_table(L.stream_epochs(L.stream_panel(spark, f"{root}/in")), f"{root}/out", f"{root}/ck")
    got = sorted((r.day.day, r.kind, r.epoch) for r in spark.read.parquet(f"{root}/out").collect())
    assert got == [(1, "EPOCH", 1), (2, "LATE", 2), (3, "EPOCH", 2), (5, "EPOCH", 3)]


PLAN = dt.date(2024, 10, 6)


def guard_days(spark, *runs):
    """Each run: rows (day, changes, signature), approvals (day, signature), confirmed (day, changes, signature), plans (days of October 2024)."""
    root = scratch_path(spark, "guard-plan")
    day = lambda n: dt.date(2024, 10, n)
    kinds = {"c": "site string, day date, changes bigint, signature string, comparable boolean", "a": "site string, day date, signature string",
             "k": "site string, day date, changes bigint, signature string", "p": "site string, day date, scheduled date"}
    for run in runs:
        land = {"c": [("s", day(d), n, x, True) for d, n, x in run.get("rows", [])], "a": [("s", day(d), x) for d, x in run.get("approvals", [])],
                "k": [("s", day(d), n, x) for d, n, x in run.get("confirmed", [])], "p": [("s", day(1), day(d)) for d in run.get("plans", [])]}
        for k, v in land.items():
            spark.createDataFrame(v, kinds[k]).write.mode("append").parquet(f"{root}/{k}")
        streams = [L.file_stream(spark, f"{root}/{k}", spark.createDataFrame([], kinds[k]).schema) for k in "capk"]
        L.run_to_table(L.stream_guard(*streams), f"{root}/out", f"{root}/ck")
    return {r.day.day: (r.status, r.incident, r.scheduled) for r in spark.read.parquet(f"{root}/out").collect()}


OK, BLOCK = "PASS", "MANUAL_REVIEW"
FREE = (OK, None, None)


def test_a_planned_date_without_inventory_blocks_and_closes_without_a_change(spark):
    got = guard_days(spark, {"plans": [6], "rows": [(4, 0, ""), (5, 0, "")]}, {"rows": [(6, 0, ""), (7, 0, "")]})
    assert got == {4: FREE, 5: (BLOCK, L.UNCONFIRMED, PLAN), 6: FREE, 7: FREE}


def test_a_planned_change_is_filled_in_and_stays_blocked_until_it_is_approved(spark):
    got = guard_days(spark, {"plans": [6], "rows": [(5, 0, "")]}, {"rows": [(6, 3, "x"), (7, 0, "")]}, {"approvals": [(7, "x")], "rows": [(8, 0, "")]})
    assert got == {5: (BLOCK, L.UNCONFIRMED, PLAN), 6: (BLOCK, L.ACTUAL, PLAN), 7: (BLOCK, L.ACTUAL, PLAN), 8: FREE}


def test_a_change_a_day_early_is_that_of_the_planned_date(spark):
    """It is kept as seen, and the planned date opens nothing beside it."""
    got = guard_days(spark, {"plans": [6], "rows": [(5, 3, "x")]}, {"rows": [(6, 0, ""), (7, 0, "")]}, {"approvals": [(7, "x")], "rows": [(8, 0, "")]})
    assert {d: r[:2] for d, r in got.items()} == {5: (BLOCK, L.ACTUAL), 6: (BLOCK, L.ACTUAL), 7: (BLOCK, L.ACTUAL), 8: FREE[:2]}


def test_an_older_change_is_not_that_of_the_planned_date(spark):
    got = guard_days(spark, {"plans": [6], "rows": [(4, 2, "old"), (5, 0, "")]}, {"approvals": [(5, "old")], "rows": [(6, 2, "new")]}, {"approvals": [(6, "new")], "rows": [(7, 0, "")]})
    assert got == {4: (BLOCK, L.ACTUAL, None), 5: (BLOCK, L.ACTUAL, None), 6: (BLOCK, L.ACTUAL, PLAN), 7: FREE}


def test_approving_a_planned_date_does_not_let_a_change_pass(spark):
    got = guard_days(spark, {"plans": [6], "approvals": [(3, "planned:2024-10-06")], "rows": [(5, 0, "")]},
                     {"approvals": [(5, "planned:2024-10-06")], "rows": [(6, 7, "z")]})
    assert got == {5: (BLOCK, L.UNCONFIRMED, PLAN), 6: (BLOCK, L.ACTUAL, None)}


def test_a_confirmed_inventory_is_checked_in_place_of_the_plan(spark):
    same = guard_days(spark, {"plans": [6], "confirmed": [(6, 0, "")]}, {"rows": [(5, 0, ""), (6, 0, "")]})
    assert same == {5: FREE, 6: FREE}
    other = guard_days(spark, {"plans": [6], "confirmed": [(6, 2, "c")]}, {"rows": [(5, 0, "")]}, {"rows": [(6, 2, "c")]}, {"approvals": [(6, "c")], "rows": [(7, 0, "")]})
    assert other == {5: (BLOCK, L.ACTUAL, PLAN), 6: (BLOCK, L.ACTUAL, PLAN), 7: FREE}


def test_approvals_lapse(spark, monkeypatch):
    monkeypatch.setattr(L, "APPROVAL_DAYS", 3)
    guard = L._Guard(None)
    row = lambda n, k, x: type("Row", (), {"day": dt.date(2024, 1, n), "changes": k, "signature": x, "comparable": True})
    status = lambda n, k, x: guard.assess(row(n, k, x), "-", "-")[3]
    assert status(1, 1, "x") == BLOCK
    guard.approve("x", "2024-01-02")
    assert [status(3, 1, "x"), status(5, 1, "x"), status(6, 1, "x")] == ["APPROVED", "APPROVED", BLOCK]
    assert L._Guard(guard.stored()).stored() == guard.stored()


def test_late_rows_never_see_later_days(spark, make):
    root = scratch_path(spark, "history")
    parts = [[(1, 1, "A", 4), (3, 1, "A", 8), (9, 1, "A", 0), (1, 2, "A", 5)], [(8, 1, "A", 100), (10, 1, "A", 2), (2, 2, "B", None)],
             [(1, 1, "A", 7), (11, 1, "A", 6), (3, 2, "B", 7)]]
    for part in parts:
        make(part).write.mode("append").parquet(f"{root}/in")
        L.run_to_table(L.score_history(L.stream_panel(spark, f"{root}/in")), f"{root}/out", f"{root}/ck")
    got = sorted((r.entity_id, r.day.day, r.metric, r.history_n, r.prior_mean, r.kind) for r in spark.read.parquet(f"{root}/out").where("entity_id = 1").collect())
    assert got == [(1, 1, 4.0, 0, None, "ON_TIME"), (1, 1, 7.0, None, None, "TOO_LATE"), (1, 3, 8.0, 1, 4.0, "ON_TIME"), (1, 8, 100.0, 2, 6.0, "LATE"),
                   (1, 9, 0.0, 2, 6.0, "ON_TIME"), (1, 10, 2.0, 4, 28.0, "ON_TIME"), (1, 11, 6.0, 5, 22.8, "ON_TIME")]
    other = sorted((r.day.day, r.history_n, r.prior_mean) for r in spark.read.parquet(f"{root}/out").where("entity_id = 2").collect())
    assert other == [(1, 0, None), (2, 1, 5.0), (3, 1, 5.0)]


def test_windows_leave_the_state_once_they_are_written(spark):
    root = scratch_path(spark, "evict")
    kind = "ts timestamp, value double"
    rows = lambda *days: spark.createDataFrame([(dt.datetime(2024, 1, d, 12), 1.0) for d in days], kind)

    def run(df):
        df.write.mode("append").parquet(f"{root}/in")
        stream = L.stream_windows(L.file_stream(spark, f"{root}/in", df.schema), "ts", "1 day", late="2 days")
        progress = L.run_to_table(stream, f"{root}/out", f"{root}/ck")
        return progress[-1]["stateOperators"][0]["numRowsTotal"]

    assert run(rows(1, 2, 3)) == 3
    assert run(rows(9, 9, 10)) == 2  # the first three are written and gone
    assert run(rows(1)) == 2  # too late: dropped
    run(L.close_windows(rows(9, 9, 10), "ts", "9 DAYS"))
    got = sorted((r.start.day, r.n) for r in spark.read.parquet(f"{root}/out").collect())
    assert got == [(1, 1), (2, 1), (3, 1), (9, 2), (10, 1)]


def test_packed_files_give_the_lines_of_folders(spark, tmp_path):
    files = {"a.csv": "日付,台番号,memo\n2024-01-01,1,\"two\nlines\"\n2024-01-01,2\n".encode(), "b.csv": "日付,台番号\r\n2024-01-02,ア\r\n , ".encode("cp932"),
             "c.csv": "﻿日付,台番号\n\n1,2,3\n\n".encode(), "d.csv": b"", "e.csv": b"\n", "f.csv": b"\x81\xff\xfe,\n"}
    for name, raw in files.items():
        (tmp_path / name).write_bytes(raw)
    table = spark.createDataFrame([("x/" + n, bytearray(b)) for n, b in files.items()], "path string, content binary")
    want = ["day", "entity_id"]
    for report in (lambda p: SP.row_widths(spark, p), lambda p: SP.header_check(spark, p, want), lambda p: SP.daily_rows(spark, p, want, [*want, "memo"])):
        rows = [sorted(str((r.path.rsplit("/", 1)[1], *r[1:])) for r in report(p).collect()) for p in (str(tmp_path), table)]
        assert rows[0] == rows[1] and rows[0]


def test_landed_files_are_not_a_folder_each(spark, make, monkeypatch, tmp_path):
    from pyspark.sql import DataFrameWriter

    from dayloom.plans import quality as PQ

    monkeypatch.setattr(PQ, "panel", lambda spark, d: make([(day, e, "L", 1.5) for day in (1, 2) for e in range(200)]))
    by = []
    old = DataFrameWriter.partitionBy
    monkeypatch.setattr(DataFrameWriter, "partitionBy", lambda self, *c: by.append(c) or old(self, *c))
    out = PQ.by_file(SP.row_widths(spark, PQ.landed(spark, ""))).collect()
    assert not by and len(out) == 8 and sum(r.records for r in out) == 400


def test_history_of_many_ids_is_kept_by_blocks(spark, make):
    root = scratch_path(spark, "blocks")
    ids = [*range(-3, 600), None]
    for days in ((1, 3), (2, 4)):
        make([(d, e, "A", d * (e or 0)) for d in days for e in ids]).coalesce(1).write.mode("append").parquet(f"{root}/in")
        progress = L.run_to_table(L.score_history(L.stream_panel(spark, f"{root}/in")), f"{root}/out", f"{root}/ck")
    assert progress[-1]["stateOperators"][0]["numRowsTotal"] <= 5  # not one for each of 604 ids
    got = {(r.entity_id, r.day.day): (r.history_n, r.prior_mean, r.kind) for r in spark.read.parquet(f"{root}/out").collect()}
    want = {1: (0, None, "ON_TIME"), 2: (1, 1, "LATE"), 3: (1, 1, "ON_TIME"), 4: (3, 2, "ON_TIME")}
    assert got == {(e, d): (n, m if m is None else m * (e or 0), kind) for e in ids for d, (n, m, kind) in want.items()}
