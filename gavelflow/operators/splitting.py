"""Ordering inside groups that may be too large for one task, and size-checked broadcasts.

A group can hold a large share of all rows. Ranking it with one window would put that share into
one task, so heavy groups are cut into value bins: per-bin totals are summed before the shuffle,
running totals are taken over the bins, and rows are ranked only inside a bin.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Sequence
from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from gavelflow.session import durable


def heavy_keys(df: DataFrame, keys: Sequence[str], floor: int) -> DataFrame | None:
    """All groups with at least ``floor`` rows, or None when there is none.

    One pass over the key columns with map-side combine. There are at most rows / ``floor`` of them;
    they are written to the shared root, so that the joins that follow do not count again.
    """
    counts = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("_rows")).where(F.col("_rows") >= floor)
    found = durable(counts.select(*[F.col(k).alias(f"_h_{k}") for k in keys]))
    return None if found.isEmpty() else found


def same_keys(pairs: Sequence[tuple[str, str]]) -> Column:
    """Equality of column pairs in which missing equals missing."""
    return reduce(and_, [F.col(a).eqNullSafe(F.col(b)) for a, b in pairs])


def split_heavy(
    df: DataFrame, keys: Sequence[str], floor: int | None, fn: Callable[[DataFrame, bool], DataFrame],
) -> DataFrame:
    """``fn(rows, split)`` over ordinary groups with split=False and over heavy ones with split=True.

    ``floor=None`` says that every group is known to be small.
    """
    heavy = None if floor is None else heavy_keys(df, keys, floor)
    if heavy is None:
        return fn(df, False)
    on = same_keys([(k, f"_h_{k}") for k in keys])
    light = fn(df.join(heavy, on, "left_anti"), False)
    return light.unionByName(fn(durable(df.join(heavy, on, "left_semi")), True))


def first_rows(df: DataFrame, order: Sequence[Column | str], n: int | None) -> DataFrame:
    """The first ``n`` rows of the whole table, or all of it."""
    return df if n is None else df.orderBy(*order).limit(n)


def top_per_group(df: DataFrame, keys: Sequence[str], order: Sequence[Column], n: int) -> DataFrame:
    """First ``n`` rows of each group. The limit is also applied before the shuffle, so a task
    receives at most ``n`` rows per group from each map task."""
    ranked = df.withColumn("_rn", F.row_number().over(W.partitionBy(*keys).orderBy(*order)))
    return ranked.where(F.col("_rn") <= n).drop("_rn")


def positions(
    df: DataFrame, keys: Sequence[str], value: str, ties: Sequence[str], weight: str | None = None,
    slices: Sequence[Column] = (), split: bool = False,
) -> DataFrame:
    """Adds ``pos`` (1-based), ``group_n`` and, with a weight, ``cum`` and ``cum_total`` per group.

    ``slices`` are columns that grow with ``ties``; they cut a heavy run of equal values further.
    ``split`` ranks in value bins and is meant for groups too large for one task.
    """
    if split:
        return _positions_in_bins(df, keys, value, ties, weight, slices)
    return _positions_in_window(df, keys, value, ties, weight)


def _positions_in_window(df, keys, value, ties, weight) -> DataFrame:
    ordered = W.partitionBy(*keys).orderBy(value, *ties)
    whole = W.partitionBy(*keys)
    out = df.withColumn("pos", F.row_number().over(ordered).cast("long")).withColumn(
        "group_n", F.count(F.lit(1)).over(whole))
    if weight:
        running = ordered.rowsBetween(W.unboundedPreceding, 0)
        out = out.withColumn("cum", F.sum(weight).over(running)).withColumn("cum_total", F.sum(weight).over(whole))
    return out


def _positions_in_bins(df, keys, value, ties, weight, slices) -> DataFrame:
    w = F.col(weight) if weight else F.lit(0).cast("decimal(18,9)")
    octave = F.floor(F.log2(F.greatest(F.col(value), F.lit(1e-9))) * 64)
    cuts = [F.coalesce(s.cast("string"), F.lit("")).alias(f"_s{i}") for i, s in enumerate(slices)]
    binned = df.select("*", octave.alias("_b"), *cuts)
    fine = [value, *[f"_s{i}" for i in range(len(slices))]]
    cell = [*keys, "_b", *fine]
    cells = binned.groupBy(*cell).agg(F.count(F.lit(1)).alias("_n"), F.sum(w).alias("_w"))
    before = W.partitionBy(*keys, "_b").orderBy(*fine).rowsBetween(W.unboundedPreceding, -1)
    cells = cells.withColumn("_n0", F.coalesce(F.sum("_n").over(before), F.lit(0))).withColumn(
        "_w0", F.coalesce(F.sum("_w").over(before), F.lit(0)))
    bins = cells.groupBy(*keys, "_b").agg(F.sum("_n").alias("_bn"), F.sum("_w").alias("_bw"))
    up_to = W.partitionBy(*keys).orderBy("_b").rowsBetween(W.unboundedPreceding, -1)
    whole = W.partitionBy(*keys)
    bins = bins.select(
        *keys, "_b", F.coalesce(F.sum("_bn").over(up_to), F.lit(0)).alias("_bn0"),
        F.coalesce(F.sum("_bw").over(up_to), F.lit(0)).alias("_bw0"),
        F.sum("_bn").over(whole).alias("group_n"), F.sum("_bw").over(whole).alias("cum_total"),
    )
    placed = bins.select(*[F.col(c).alias(f"_k_{c}") for c in [*keys, "_b"]], "_bn0", "_bw0", "group_n", "cum_total")
    offsets = cells.join(placed, same_keys([(c, f"_k_{c}") for c in [*keys, "_b"]])).select(
        *[F.col(c).alias(f"_k_{c}") for c in cell], (F.col("_n0") + F.col("_bn0")).alias("_n1"),
        (F.col("_w0") + F.col("_bw0")).alias("_w1"), "group_n", "cum_total")
    inside = W.partitionBy(*cell).orderBy(*ties)
    out = binned.join(offsets, same_keys([(c, f"_k_{c}") for c in cell])).withColumn("pos", (F.row_number().over(inside) + F.col("_n1")).cast("long"))
    if weight:
        running = inside.rowsBetween(W.unboundedPreceding, 0)
        out = out.withColumn("cum", F.sum(w).over(running) + F.col("_w1"))
    else:
        out = out.drop("cum_total")
    kept = [*df.columns, "pos", "group_n", *(["cum", "cum_total"] if weight else [])]
    return out.select(*kept)


# --- running values over time --------------------------------------------------------------------
def previous_in_time(df: DataFrame, key: str, ts: str, tie: str, value: Column, name: str, step: str = "day") -> DataFrame:
    """The value of the preceding row per key. Windows run inside (key, step) slices; the last
    value of the previous slice is carried over a window that has one row per slice."""
    work = df.withColumn("_slice", F.date_trunc(step, F.col(ts))).withColumn("_v", value)
    last = work.groupBy(key, "_slice").agg(F.max_by("_v", F.struct(ts, tie)).alias("_last"))
    carried = last.select(
        F.col(key).alias("_k"), F.col("_slice").alias("_s"), F.lag("_last").over(W.partitionBy(key).orderBy("_slice")).alias("_carry"))
    inside = W.partitionBy(key, "_slice").orderBy(ts, tie)
    ranked = work.withColumn("_lag", F.lag("_v").over(inside)).withColumn("_rn", F.row_number().over(inside))
    joined = ranked.join(carried, same_keys([(key, "_k"), ("_slice", "_s")]))
    return joined.withColumn(name, F.when(F.col("_rn") == 1, F.col("_carry")).otherwise(F.col("_lag"))).select(*df.columns, name)


def running_max_in_time(df: DataFrame, key: str, ts: str, tie: str, columns: Sequence[str], step: str = "day") -> DataFrame:
    """Adds ``max_<column>``: the highest value seen so far per key, by the same slicing."""
    work = df.withColumn("_slice", F.date_trunc(step, F.col(ts)))
    tops = work.groupBy(key, "_slice").agg(*[F.max(c).alias(f"_t_{c}") for c in columns])
    before = W.partitionBy(key).orderBy("_slice").rowsBetween(W.unboundedPreceding, -1)
    tops = tops.select(
        F.col(key).alias("_k"), F.col("_slice").alias("_s"), *[F.max(f"_t_{c}").over(before).alias(f"_p_{c}") for c in columns])
    inside = W.partitionBy(key, "_slice").orderBy(ts, tie).rowsBetween(W.unboundedPreceding, 0)
    out = work.join(tops, same_keys([(key, "_k"), ("_slice", "_s")]))
    for c in columns:
        out = out.withColumn(f"max_{c}", F.greatest(F.max(c).over(inside), F.col(f"_p_{c}")))
    return out.select(*df.columns, *[f"max_{c}" for c in columns])


# --- costly columns ------------------------------------------------------------------------------------
def pin(df: DataFrame, **columns: Column) -> DataFrame:
    """Adds costly columns so that they are worked out once per row.

    The optimizer moves a filter below the projection it tests and then repeats the projected
    expression inside the filter. It does not do so through a generator, so the columns come out of
    a one-element ``inline``.
    """
    made = F.struct(*[c.alias(name) for name, c in columns.items()])
    kept = [c for c in df.columns if c not in columns]
    return df.select(*kept, F.inline_outer(F.array(made)))


def unfold(df: DataFrame, prefix: str, struct: Column, fields: Sequence[str]) -> DataFrame:
    """Like ``pin`` for one struct: its fields become flat columns ``<prefix>_<field>``."""
    names = [f"{prefix}_{f}" for f in fields]
    return df.select("*", F.inline_outer(F.array(struct)).alias(*names))


def dealt_out(df: DataFrame, key: str) -> DataFrame:
    """The same rows dealt to as many tasks as shuffles have: costly columns of a small file are not left to one task."""
    return df.repartition(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), key)


# --- broadcasts --------------------------------------------------------------------------------------
def bounded_count(df: DataFrame, limit: int) -> int:
    """Row count, counting no further than one past the limit."""
    return df.limit(limit + 1).count()


def maybe_broadcast(df: DataFrame, limit: int) -> DataFrame:
    """Broadcast hint only when the table is at most ``limit`` rows; otherwise a shuffle join."""
    return F.broadcast(df) if bounded_count(df, limit) <= limit else df


def theta_join(left: DataFrame, small: DataFrame, on: Callable[[], Column], small_id: str, limit: int) -> DataFrame:
    """Join on a general condition with the small side broadcast in slices of checked size."""
    n = bounded_count(small, limit)
    if n <= limit:
        return left.join(F.broadcast(small), on())
    slices = 2 * math.ceil(small.count() / limit)
    bucket = F.pmod(F.xxhash64(small_id), F.lit(slices))
    parts = [left.join(F.broadcast(small.where(bucket == i)), on()) for i in range(slices)]
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out
