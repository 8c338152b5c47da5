"""Exact ordering inside groups of any size.

A plain ``row_number`` over (day) or (label) puts a whole group into one task.
``position`` range-partitions the rows by (group, order) instead, so one hot
group is spread over many tasks, and adds each task's offset afterwards.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from dayloom.session import materialise


def position(
    df: DataFrame, by: Sequence[str], order: Sequence[Column], name: str = "rn", total: str | None = None
) -> DataFrame:
    """Add the 1-based row number inside ``by`` (and optionally the group size).

    One range shuffle, one written table so that both uses of the ranged
    rows see the same bounds, then a table of one row per (group, task) that
    carries the offsets.
    """
    by = list(by)
    keys = [F.col(c) for c in by]
    spread = df.repartitionByRange(*keys, *order) if keys or order else df
    ranged = materialise(
        spread.sortWithinPartitions(*keys, *order).withColumn("_at", F.monotonically_increasing_id())
    )
    ranged = ranged.withColumn("_task", F.shiftright("_at", 33))
    parts = ranged.groupBy(*by, "_task").agg(F.min("_at").alias("_from"), F.count(F.lit(1)).alias("_n"))
    across = Window.partitionBy(*by)
    before = across.orderBy("_task").rowsBetween(Window.unboundedPreceding, -1)
    offsets = parts.select(
        *by, "_task", "_from",
        F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"),
        F.sum("_n").over(across).alias("_total"),
    )
    # offsets has one row per (group, task): thousands, never data-sized; AQE picks the join
    out = ranged.join(offsets, [*by, "_task"]).withColumn(name, F.col("_at") - F.col("_from") + 1 + F.col("_before"))
    if total:
        out = out.withColumn(total, F.col("_total"))
    return out.drop("_at", "_task", "_from", "_before", "_total")


HOT = 100_000  # rows of one value that one task takes
HOT_VALUES = 10_000  # values that can be hotter than that: HOT grows so that there are no more
SMALL = 1_000_000  # cells of a table that is broadcast
SALTS = 64  # parts of every group when the values of the groups are too many to broadcast


def attach(df: DataFrame, small: DataFrame, on: Sequence[str], how: str = "inner") -> DataFrame:
    """Values per group joined to all rows of the groups, without gathering a group's rows in one task.

    ``small`` has one row per group. It is written first, so its size is known:
    with up to SMALL cells it is broadcast and the rows stay where they are.
    Beyond that its rows are copied SALTS times and each group's rows dealt over the copies.
    """
    small = materialise(small, "groups")
    if small.count() * len(small.columns) <= SMALL:
        return df.join(F.broadcast(small), list(on), how)
    parts = small.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    rows = df.withColumn("_salt", F.pmod(F.xxhash64(*df.columns), F.lit(SALTS)).cast("int"))
    return rows.join(parts, [*on, "_salt"], how).drop("_salt")


def counted(df: DataFrame, by: Sequence[str], value: str) -> DataFrame:
    """The multiset of each group: its distinct values with their count _n, _upto (rows up to and with it) and _dense.

    Rows are counted where they stand; only distinct values are ordered.
    """
    counts = df.groupBy(*by, value).agg(F.count(F.lit(1)).alias("_n"), F.lit(1).alias("_one"))
    return running_totals(counts, by, value, {"_upto": "_n", "_dense": "_one"})


def exact_quantiles(df: DataFrame, by: Sequence[str], value: str, qs: dict[str, float]) -> DataFrame:
    """Exact linear-interpolation quantiles per group, for groups and ties of any size.

    The order statistics around a quantile are found on the counted multiset,
    so a value that a third of all rows share is one row there.
    """
    by = list(by)
    ranked = materialise(counted(df.where(F.col(value).isNotNull()).select(*by, value), by, value), "multiset")
    size = ranked.groupBy(*by).agg(F.max("_upto").alias("_size"))
    picks = [F.struct(F.lit(k).alias("name"), ((F.col("_size") - 1) * q).alias("at")) for k, q in qs.items()]
    # A value stands at the places _upto - _n .. _upto - 1; a quantile weighs the two places around it.
    ends = F.array(F.struct(F.floor("_q.at").alias("place"), (1 - (F.col("_q.at") - F.floor("_q.at"))).alias("w")),
                   F.struct((F.floor("_q.at") + 1).alias("place"), (F.col("_q.at") - F.floor("_q.at")).alias("w")))
    near = attach(ranked, size, by).withColumn("_q", F.explode(F.filter(F.array(*picks), lambda s: (
        (F.col("_upto") - F.col("_n") <= F.ceil(s["at"])) & (F.col("_upto") - 1 >= F.floor(s["at"]))))))
    near = near.withColumn("_w", F.aggregate(F.filter(ends, lambda e: (e["place"] >= F.col("_upto") - F.col("_n")) & (e["place"] < F.col("_upto"))),
                                             F.lit(0.0), lambda t, e: t + e["w"]))
    return near.groupBy(*by).agg(*[
        F.sum(F.when((F.col("_q.name") == k) & (F.col("_w") > 0), F.col(value) * F.col("_w"))).alias(k) for k in qs
    ])


def top_n(df: DataFrame, by: Sequence[str], order: Sequence[Column], n: int, name: str = "rank") -> DataFrame:
    """First n rows per group; Spark limits each task's share before the shuffle."""
    w = Window.partitionBy(*by).orderBy(*order)
    return df.withColumn(name, F.row_number().over(w)).where(F.col(name) <= n)


def rank_positions(df: DataFrame, by: Sequence[str], value: str, name: str = "avg_rank") -> DataFrame:
    """Average, lowest and dense rank of tied values (1-based), worked out on distinct values only.

    Rows meet the rank of their value in a join. A value with more than HOT rows
    has its rank copied, and its rows are dealt over the copies.
    """
    by = list(by)
    ranked = materialise(counted(df, by, value), "multiset")
    ranks = ranked.select(
        *[F.col(c).alias(f"_by_{c}") for c in by], F.col(value).alias("_v"), "_n",
        (F.col("_upto") - (F.col("_n") - 1) / 2.0).alias(name),
        (F.col("_upto") - F.col("_n") + 1).alias(f"{name}_min"), F.col("_dense").alias(f"{name}_dense"),
    )
    total = ranked.agg(F.sum("_n")).first()[0] or 0
    each = max(HOT, -(-total // HOT_VALUES))
    hot = ranks.where(F.col("_n") > each).select(*[c for c in ranks.columns if c.startswith("_by_")], "_v", F.ceil(F.col("_n") / each).cast("int").alias("_copies"))
    same = lambda d: [df[c].eqNullSafe(d[f"_by_{c}"]) for c in by] + [df[value].eqNullSafe(d["_v"])]
    found = [F.col(name), F.col(f"{name}_min"), F.col(f"{name}_dense")]
    if hot.isEmpty():
        return df.join(ranks, same(ranks), "left").select(df["*"], *found)
    # At most HOT_VALUES rows: their counts add up to no more than all rows.
    dealt = df.join(F.broadcast(hot), same(hot), "left").select(
        df["*"], F.pmod(F.xxhash64(*[df[c] for c in df.columns]), F.coalesce("_copies", F.lit(1))).cast("int").alias("_salt"))
    copies = ranks.withColumn("_copy", F.explode(F.sequence(F.lit(0), F.greatest(F.lit(0), F.when(F.col("_n") > each, F.ceil(F.col("_n") / each)).otherwise(1) - 1).cast("int"))))
    on = [dealt[c].eqNullSafe(copies[f"_by_{c}"]) for c in by] + [dealt[value].eqNullSafe(copies["_v"]), dealt["_salt"] == copies["_copy"]]
    return dealt.join(copies, on, "left").select(*[dealt[c] for c in df.columns], *found)


def running_totals(df: DataFrame, by: Sequence[str], order: str, sums: dict[str, str]) -> DataFrame:
    """Inclusive running sums (new name -> column) along ``order`` for groups of any size."""
    by = list(by)
    ranged = materialise(
        df.repartitionByRange(*by, order).sortWithinPartitions(*by, order)
        .withColumn("_task", F.spark_partition_id())
    )
    parts = ranged.groupBy(*by, "_task").agg(*[F.sum(c).alias(f"_s{n}") for n, c in sums.items()])
    before = Window.partitionBy(*by).orderBy("_task").rowsBetween(Window.unboundedPreceding, -1)
    offsets = parts.select(*by, "_task", *[
        F.coalesce(F.sum(f"_s{n}").over(before), F.lit(0)).alias(f"_b{n}") for n in sums])
    inside = Window.partitionBy(*by, "_task").orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    return (
        ranged.join(offsets, [*by, "_task"])
        .withColumns({n: F.sum(c).over(inside) + F.col(f"_b{n}") for n, c in sums.items()})
        .drop("_task", *[f"_b{n}" for n in sums])
    )
