"""Incremental forms of the daily jobs as Structured Streaming queries.

All run with ``availableNow``: a scheduler starts them, they take what is new,
and the checkpoint remembers what was taken. Checkpoints and sinks live in the
shared folder.
"""

from __future__ import annotations

import bisect
import datetime as dt
import json
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from dayloom.functions import expr as X
from dayloom.panel import ENTITY, KEY, PANEL


def file_stream(spark: SparkSession, folder: str, schema: T.StructType, glob: str = "*.parquet") -> DataFrame:
    """New Parquet files below a folder, each once."""
    return (spark.readStream.schema(schema).option("pathGlobFilter", glob).option("recursiveFileLookup", "true")
            .parquet(folder))


def run_to_table(stream: DataFrame, path: str, checkpoint: str) -> list[dict]:
    """Append whatever is new to a Parquet table, exactly once; the progress of the batches, state rows among it.

    The sink's own log names the files of each batch, so a batch that runs again replaces itself.
    """
    query = (stream.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint)
             .outputMode("append").trigger(availableNow=True).start())
    query.awaitTermination()
    return [json.loads(p.json) if not isinstance(p, dict) else p for p in query.recentProgress]


def close_windows(events: DataFrame, ts: str, after: str) -> DataFrame:
    """One row of the events' schema that stands ``after`` behind the last one and is null elsewhere.

    Landed behind the last file of a backfill it moves the watermark past every
    open window; its own window stays open and is never written.
    """
    last = events.agg((F.max(ts) + F.expr(f"INTERVAL {after}")).alias(ts)).where(F.col(ts).isNotNull())
    return last.select(*[F.col(ts).cast(f.dataType).alias(ts) if f.name == ts else F.lit(None).cast(f.dataType).alias(f.name) for f in events.schema])


def stream_panel(spark: SparkSession, folder: str) -> DataFrame:
    """New-day ingest of panel files."""
    return file_stream(spark, folder, PANEL)


def stream_dedupe(events: DataFrame, key: list[str], ts: str, late: str) -> DataFrame:
    """First copy of each key; state is dropped once the watermark has passed."""
    return events.withWatermark(ts, late).dropDuplicatesWithinWatermark(key)


def stream_windows(events: DataFrame, ts: str, length: str, slide: str | None = None, late: str = "1 day",
                   by: list[str] = ()) -> DataFrame:
    """Tumbling or sliding counts and sums; written in append mode, each window once, when the watermark has passed its end.

    A row that comes later than ``late`` behind the newest one seen is dropped, and so is the state of written windows.
    """
    w = F.window(ts, length, slide) if slide else F.window(ts, length)
    return events.withWatermark(ts, late).groupBy(w.alias("w"), *by).agg(
        F.count(F.lit(1)).alias("n"), F.sum("value").alias("total")).select(
        F.col("w.start").alias("start"), F.col("w.end").alias("end"), *by, "n", "total")


def stream_sessions(events: DataFrame, ts: str, gap: str, by: list[str], late: str = "1 day") -> DataFrame:
    """Activity sessions per entity that end after a silent gap; each is written once, when the watermark has passed its end."""
    return events.withWatermark(ts, late).groupBy(F.session_window(ts, gap).alias("w"), *by).agg(
        F.count(F.lit(1)).alias("n")).select(F.col("w.start").alias("start"), F.col("w.end").alias("end"), *by, "n")


# ---- stateful epochs and guard ------------------------------------------------------

EPOCH_OUT = "site string, entity_id bigint, epoch int, day date, label string, old_label string, kind string"
EPOCH_STATE = "epoch int, day date, label string"


def _epochs(key, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
    epoch, last, label = state.get if state.exists else (0, None, None)
    out = []
    rows = pd.concat(list(batches)).sort_values("day")
    for day, new in zip(rows["day"], rows["label"]):
        if last is not None and day <= last:
            out.append((epoch, day, new, label, "LATE"))
        elif new != label:
            epoch += 1
            out.append((epoch, day, new, label, "EPOCH"))
            last, label = day, new
        else:
            last = day
    state.update((epoch, last, label))
    pdf = pd.DataFrame(out, columns=["epoch", "day", "label", "old_label", "kind"])
    pdf.insert(0, "entity_id", key[1])
    pdf.insert(0, "site", key[0])
    yield pdf


def stream_epochs(panel: DataFrame) -> DataFrame:
    """A row whenever an entity starts a new label epoch; rows older than the state are reported LATE.

    State is three values per entity. A micro-batch hands a task only the new
    days of one entity.
    """
    return panel.select(*ENTITY, "day", "label").groupBy(*ENTITY).applyInPandasWithState(
        _epochs, EPOCH_OUT, EPOCH_STATE, "append", GroupStateTimeout.NoTimeout)


GUARD_OUT = "site string, day date, changes bigint, signature string, status string, incident string, scheduled date"
GUARD_STATE = "open string, approved string, plans string, confirmed string"  # short lists as JSON
PLANNED = "planned:"  # signature of an open planned date
APPROVAL_DAYS = 400  # an approval is remembered so long; then the same change blocks again
ACTUAL, UNCONFIRMED = "ACTUAL_CHANGE", "KNOWN_CHANGE_UNCONFIRMED"
_EVENTS = ("plan", "confirmed", "change", "approval")  # in this order on one day


class _Guard:
    """Incidents of one site, the oldest first: [kind, signature, day of the change, scheduled day]."""

    def __init__(self, stored):
        self.open, self.approved, self.plans, self.confirmed = ([json.loads(x) for x in stored] if stored else ([], {}, [], {}))

    def stored(self):
        return tuple(json.dumps(x) for x in (self.open, self.approved, self.plans, self.confirmed))

    def known(self, signature: str) -> bool:
        return signature in self.approved or any(i[1] == signature for i in self.open)

    def planned(self, days: set[str]):
        return next((i for i in self.open if i[0] == UNCONFIRMED and i[3] in days), None)

    def change(self, signature: str, day: str, near: set[str]) -> None:
        """An actual change: it fills in the incident of a planned date ``near`` it, else waits behind those that are open."""
        incident = self.planned(near)
        if signature in self.approved:
            if incident:  # the planned change came, and it is one that was approved
                self.open.remove(incident)
        elif any(i[1] == signature for i in self.open):
            pass
        elif incident:
            incident[:3] = [ACTUAL, signature, day]
        else:
            self.open.append([ACTUAL, signature, day, None])

    def approve(self, signature: str, day: str) -> None:
        """Only what waits can be approved; a planned date is released, not what may still change on it."""
        if any(i[1] == signature for i in self.open):
            self.open = [i for i in self.open if i[1] != signature]
            if not signature.startswith(PLANNED):
                self.approved[signature] = day

    def assess(self, row, target: str, early: str) -> tuple:
        """The day's status: the actual change first, then the plan for the next day, then what still waits."""
        day = str(row.day)
        self.approved = {s: d for s, d in self.approved.items() if (row.day - dt.date.fromisoformat(d)).days <= APPROVAL_DAYS}
        blocked = row.changes > 0 or not row.comparable
        if not row.comparable:  # a gap says nothing about a planned date
            self.change(row.signature, day, set())
        elif blocked:
            self.change(row.signature, day, {day, early})
        elif incident := self.planned({day}):
            self.open.remove(incident)  # the planned day came and changed nothing
        if target in self.plans:
            seen = self.confirmed.get(target)
            if seen is None:
                if not any(i[3] == target for i in self.open):
                    self.open.append([UNCONFIRMED, f"{PLANNED}{target}", target, target])
            elif seen[0] > 0 and not self.known(seen[1]):
                self.open.append([ACTUAL, seen[1], target, target])
        self.plans = [p for p in self.plans if p >= day]
        self.confirmed = {d: c for d, c in self.confirmed.items() if d >= day}
        first = self.open[0] if self.open else None
        status = "MANUAL_REVIEW" if first else "APPROVED" if blocked else "PASS"
        scheduled = dt.date.fromisoformat(first[3]) if first and first[3] else None
        return row.day, row.changes, row.signature, status, first[0] if first else None, scheduled


def _guard(key, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
    guard, out = _Guard(state.get if state.exists else None), []
    rows = pd.concat(list(batches))
    rows["_order"] = rows["event"].map(_EVENTS.index)
    for row in rows.sort_values(["day", "_order", "signature"]).itertuples():
        if row.event == "approval":
            guard.approve(row.signature, str(row.day))
        elif row.event == "plan":
            guard.plans = sorted({*guard.plans, row.signature})
        elif row.event == "confirmed":
            guard.confirmed[str(row.day)] = [row.changes, row.signature]
        else:
            tomorrow = str(row.day + dt.timedelta(days=1))
            out.append(guard.assess(row, tomorrow, tomorrow))
    state.update(guard.stored())
    pdf = pd.DataFrame(out, columns=["day", "changes", "signature", "status", "incident", "scheduled"])
    pdf.insert(0, "site", key[0])
    yield pdf


def stream_guard(changes: DataFrame, approvals: DataFrame, plans: DataFrame | None = None, confirmed: DataFrame | None = None) -> DataFrame:
    """Guard status per site and day; it fails closed.

    A change, and a day that cannot be compared with the day before, block
    (MANUAL_REVIEW) until their signature is approved; a further change waits
    behind the first. A signature approved once is APPROVED when it comes again,
    for APPROVAL_DAYS. An approval of nothing that waits has no effect.

    ``plans`` (site, day, scheduled): a date on which a change is expected, known
    from ``day`` on. The day before it opens an incident unless ``confirmed``
    (site, day, changes, signature: the inventory confirmed for the planned date)
    has come. A change seen on the planned date or a day early fills the incident
    in, which stays blocked until that change is approved; a planned date that
    changes nothing closes it; nothing else does, but its own approval
    (``planned:`` and the date). An older change waits beside it. A confirmed
    inventory with a change blocks like an actual one.

    All streams carry a row per site and day, so a site's state and its share of
    a batch stay small: incidents that wait, approvals and plans that still hold.
    """
    none = F.lit(None).cast("string")

    def rows(df, event, changes, signature, comparable):
        return df.select("site", "day", changes.cast("bigint").alias("changes"), signature.alias("signature"), comparable.alias("comparable"), F.lit(event).alias("event"))

    zero, yes = F.lit(0), F.lit(True)
    x = rows(changes, "change", F.col("changes"), F.col("signature"), F.col("comparable")).unionByName(rows(approvals, "approval", zero, F.col("signature"), yes))
    if plans is not None:
        x = x.unionByName(rows(plans, "plan", zero, F.coalesce(F.col("scheduled").cast("string"), none), yes))
    if confirmed is not None:
        x = x.unionByName(rows(confirmed, "confirmed", F.col("changes"), F.col("signature"), yes))
    return x.groupBy("site").applyInPandasWithState(_guard, GUARD_OUT, GUARD_STATE, "append", GroupStateTimeout.NoTimeout)


def change_signature(panel: DataFrame) -> DataFrame:
    """Per site and day: labels changed and ids added or removed since the site's day before, and an order-free digest of which.

    The first day and a day after a gap are not comparable; their signature names the day.
    """
    from pyspark.sql import Window

    w = Window.partitionBy("site").orderBy("day")  # one row per day
    days = panel.select("site", "day").distinct().withColumns({"_prev": F.lag("day").over(w), "_next": F.lead("day").over(w)})
    now = panel.select("site", "day", "entity_id", "label")
    old = now.join(days, ["site", "day"]).where("_next IS NOT NULL").select(
        "site", F.col("_next").alias("day"), "entity_id", F.col("label").alias("_old"))
    diff = now.join(old, ["site", "day", "entity_id"], "full").where(~F.col("label").eqNullSafe(F.col("_old")))
    h = F.xxhash64("entity_id", F.coalesce("_old", F.lit("")), F.coalesce("label", F.lit(""))).cast("decimal(38,0)")
    g = diff.groupBy("site", "day").agg(F.count(F.lit(1)).alias("changes"), F.sum(h).cast("string").alias("signature"))
    comparable = F.coalesce(F.datediff("day", "_prev") == 1, F.lit(False))
    return days.join(g, ["site", "day"], "left").select(
        "site", "day", F.when(comparable, F.coalesce("changes", F.lit(0))).otherwise(0).cast("bigint").alias("changes"),
        F.when(comparable, F.coalesce("signature", F.lit(""))).otherwise(F.concat(F.lit("gap:"), F.col("day").cast("string"))).alias("signature"),
        comparable.alias("comparable"))


# ---- lateness ----------------------------------------------------------------------------

def lateness(df: DataFrame, event_day: str, processing_day: str) -> DataFrame:
    """Delay of each row and its class; works the same on a batch and on a stream."""
    d = F.datediff(processing_day, event_day)
    return df.withColumn("delay_days", d).withColumn("delay_class", X.delay_class(d))


# ---- growing history --------------------------------------------------------------------

HISTORY_OUT = "site string, entity_id bigint, day date, metric double, history_n bigint, prior_mean double, kind string"
HISTORY_STATE = "ids array<bigint>, n array<bigint>, total array<double>, settled array<date>, width array<int>, days array<date>, metrics array<double>"
LATE_DAYS = 7  # a row that is so many days behind the entity's newest one is still placed in its history
IDS = 256  # ids next to one another whose histories are one entry of the state


def _scored(history: tuple, rows: Iterator[tuple], out: list) -> tuple:
    """One entity's history (count and sum of the settled days, the last of them, later days and their metrics) after its rows by day."""
    n, total, settled, days, metrics = history
    for at_row, day, m in rows:
        m = None if m != m else m
        if settled is not None and day <= settled:
            out.append((at_row, None, None, "TOO_LATE"))
            continue
        before = [x for d, x in zip(days, metrics) if d < day and x is not None]
        seen = n + len(before)
        late = bool(days) and day < days[-1]
        out.append((at_row, seen, (total + sum(before)) / seen if seen else None, "LATE" if late else "ON_TIME"))
        at = bisect.bisect_right(days, day)
        days.insert(at, day)
        metrics.insert(at, m)
        while (days[-1] - days[0]).days > LATE_DAYS:  # these days cannot come again
            settled, old = days.pop(0), metrics.pop(0)
            n, total = n + (old is not None), total + (old or 0.0)
    return n, total, settled, days, metrics


def _history(key, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
    held: dict = {}
    if state.exists:
        ids, n, total, settled, width, days, metrics = state.get
        at = 0
        for e, c, s, last, w in zip(ids, n, total, settled, width):
            held[e] = (c, s, last, list(days[at:at + w]), [None if m is None or m != m else m for m in metrics[at:at + w]])
            at += w
    rows = pd.concat(list(batches))[["entity_id", "day", "metric"]].sort_values("day", kind="stable", ignore_index=True)
    ids = [None] * len(rows) if pd.isna(key[1]) else rows["entity_id"].tolist()  # no id: a block of its own
    own: dict = {}
    for row in zip(ids, range(len(rows)), rows["day"], rows["metric"]):
        own.setdefault(row[0], []).append(row[1:])
    out = []
    for e, some in own.items():
        held[e] = _scored(held.get(e, (0, 0.0, None, [], [])), some, out)
    every = list(held.values())
    state.update((list(held), [h[0] for h in every], [h[1] for h in every], [h[2] for h in every], [len(h[3]) for h in every],
                  [d for h in every for d in h[3]], [float("nan") if m is None else m for h in every for m in h[4]]))
    at, seen, mean, kind = zip(*out)
    found = rows.iloc[list(at)]
    yield pd.DataFrame({
        "site": key[0], "entity_id": pd.array([ids[i] for i in at], "Int64"), "day": found["day"].to_numpy(), "metric": found["metric"].astype("float64").to_numpy(),
        "history_n": pd.array(seen, "Int64"), "prior_mean": pd.array(mean, "Float64").to_numpy("float64", na_value=float("nan")), "kind": kind})


def score_history(panel: DataFrame) -> DataFrame:
    """Each row with the number and mean of its entity's earlier days, seen so far; then it joins that history.

    State is kept by the state store for blocks of IDS neighbouring ids, so a
    batch reads and writes the blocks that it touches and no others: of each
    entity sums of the settled days and the last LATE_DAYS days one by one. A
    call costs far more than a row, so there is one for a block and not for an
    entity. A late row among the last days (kind LATE) is scored from earlier
    days alone and counts for later ones that follow; an even later one
    (TOO_LATE) is only reported. Rows already written stay.
    """
    block = F.floor(F.col("entity_id") / IDS).cast("bigint")
    return panel.select(*KEY, "metric").withColumn("_block", block).groupBy("site", "_block").applyInPandasWithState(
        _history, HISTORY_OUT, HISTORY_STATE, "append", GroupStateTimeout.NoTimeout)


def enrich(stream: DataFrame, holidays: DataFrame, layout: DataFrame) -> DataFrame:
    """Stream rows with calendar class and layout from static tables."""
    from dayloom.operators.windows import calendar_class

    return calendar_class(stream, holidays).join(
        layout.select(*ENTITY, "island_id", "side", "shape"), ENTITY, "left")
