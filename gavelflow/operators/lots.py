"""Lot state from observations, bid history, closing, refresh selection."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gavelflow.functions import text
from gavelflow.operators.splitting import first_rows, previous_in_time, running_max_in_time, top_per_group
from gavelflow.params import Params

# attributes whose newest non-null value wins
ATTRIBUTES = [
    "title", "description", "category", "brand", "model", "upc", "condition_name", "condition_notes",
    "retail_price", "buyers_premium_rate", "location", "location_zip", "open_at", "close_at", "images", "url",
]


def discount(bid: Column, retail: Column) -> Column:
    return F.greatest(F.lit(0.0), F.lit(1.0) - bid / F.nullif(retail, F.lit(0.0)))


def change_only(observations: DataFrame) -> DataFrame:
    """Observations whose (bid, bid_count) differs from the lot's preceding one."""
    pair = F.struct(F.col("current_bid"), F.col("bid_count"))
    before = previous_in_time(observations, "lot_id", "observed_at", "obs_id", pair, "_prev")
    changed = F.col("_prev").isNull() | ~F.col("_prev").eqNullSafe(pair)
    return before.where(changed).drop("_prev")


def ratcheted(observations: DataFrame) -> DataFrame:
    """Bid and bid count as the lot showed them: the highest seen so far, a late read never lowers them."""
    raised = running_max_in_time(observations, "lot_id", "observed_at", "obs_id", ["current_bid", "bid_count"])
    return raised.withColumn("current_bid", F.coalesce("max_current_bid", F.lit(0.0))).withColumn(
        "bid_count", F.coalesce("max_bid_count", F.lit(0))).drop("max_current_bid", "max_bid_count")


def fold_observations(observations: DataFrame, previous: DataFrame | None = None) -> DataFrame:
    """Current state per lot from its observations and, if given, the state before them.

    Newest non-null value of each attribute, highest bid and bid count, first and last sight, and
    the final price fixed by the first closed observation: its own, else the bid so far. All but
    the close price is one hash aggregate with map-side combine. ``observations`` has lot_id,
    obs_id, observed_at, current_bid, bid_count, is_closed, final_price and any attributes.
    """
    rows = observations
    if previous is not None:
        before = _state_as_observation(previous, observations)
        rows = before.unionByName(observations, allowMissingColumns=True)
    present = [a for a in ATTRIBUTES if a in rows.columns]
    order = F.struct("observed_at", "obs_id")

    def newest(name: str) -> Column:
        c = F.col(name)
        filled = c.isNotNull() & (F.size(c) > 0) if name == "images" else c.isNotNull()
        return F.max_by(c, F.when(filled, order)).alias(name)

    closing = F.when(F.col("is_closed"), order)
    aggs = [
        *[newest(a) for a in present],
        F.coalesce(F.max("current_bid"), F.lit(0.0)).alias("current_bid"),
        F.coalesce(F.max("bid_count"), F.lit(0)).alias("bid_count"),
        F.min("observed_at").alias("first_seen"), F.max("observed_at").alias("last_seen"),
        F.coalesce(F.bool_or("is_closed"), F.lit(False)).alias("is_closed"),
        F.min(closing).alias("_close"), F.min_by("final_price", closing).alias("_final"),
        F.count_if(F.col("obs_id") >= 0).alias("observations"),
    ]
    if "raw" in rows.columns:
        aggs.append(F.max_by("raw", F.when(F.col("raw").isNotNull(), order)).alias("raw"))
    state = rows.groupBy("lot_id").agg(*aggs)
    bids = _bid_at_close(rows, state.where(F.col("_close").isNotNull()).select("lot_id", "_close"))
    out = state.join(bids, "lot_id", "left")
    closed_at = F.col("_close.observed_at")
    price = F.coalesce(F.nullif(F.col("_final"), F.lit(0.0)), F.col("_bid_then"))
    out = out.withColumn("closed_at", closed_at).withColumn("final_price", F.when(F.col("is_closed"), price))
    if previous is not None:
        known = previous.select("lot_id", F.lit(False).alias("is_new"))
        out = out.join(known, "lot_id", "left").withColumn("is_new", F.coalesce("is_new", F.lit(True)))
    return out.drop("_close", "_final", "_bid_then")


def _bid_at_close(rows: DataFrame, closes: DataFrame) -> DataFrame:
    """Highest bid up to the first closed observation, for lots that closed.

    Days before the closing day are summed up per (lot, day) first; single rows are only needed
    inside the closing day, so a busy lot is never read as one group.
    """
    day = F.date_trunc("day", F.col("observed_at"))
    slim = rows.select("lot_id", "observed_at", "obs_id", "current_bid", day.alias("day"))
    daily = slim.groupBy("lot_id", "day").agg(F.max("current_bid").alias("top"))
    at = closes.withColumn("close_day", F.date_trunc("day", F.col("_close.observed_at")))
    earlier = daily.join(at, "lot_id").where(F.col("day") < F.col("close_day")).select("lot_id", "top")
    same_day = slim.join(at.withColumnRenamed("close_day", "day"), ["lot_id", "day"]).where(
        F.struct("observed_at", "obs_id") <= F.col("_close")).groupBy("lot_id").agg(F.max("current_bid").alias("top"))
    return earlier.unionByName(same_day).groupBy("lot_id").agg(F.coalesce(F.max("top"), F.lit(0.0)).alias("_bid_then"))


def _state_as_observation(state: DataFrame, like: DataFrame) -> DataFrame:
    """The earlier state as two pseudo observations: its first and last sight (close included)."""
    kept = [c for c in state.columns if c in {*ATTRIBUTES, "lot_id", "current_bid", "bid_count", "is_closed", "final_price", "raw"}]
    last = state.select(
        *kept, F.when(F.col("is_closed"), F.coalesce("closed_at", "last_seen")).otherwise(F.col("last_seen")).alias("observed_at"),
        F.lit(-1).cast("long").alias("obs_id"))
    first = state.select("lot_id", F.col("first_seen").alias("observed_at"), F.lit(-2).cast("long").alias("obs_id"))
    seen = state.select("lot_id", F.col("last_seen").alias("observed_at"), F.lit(-2).cast("long").alias("obs_id"))
    out = last.unionByName(first, allowMissingColumns=True).unionByName(seen, allowMissingColumns=True)
    for name in like.columns:
        if name not in out.columns:
            out = out.withColumn(name, F.lit(None).cast(like.schema[name].dataType))
    return out.select(*dict.fromkeys([*like.columns, *out.columns]))


def bid_history_tail(snapshots: DataFrame, n: int = 25) -> DataFrame:
    """Newest ``n`` snapshots per lot."""
    return top_per_group(snapshots, ["lot_id"], [F.col("observed_at").desc(), F.col("obs_id").desc()], n)


def closed_to_comps(lots: DataFrame, stored: DataFrame, inferred: bool = False) -> DataFrame:
    """House comps for closed lots with a price, once per (key, url)."""
    sold = lots.where(F.col("is_closed") & F.col("final_price").isNotNull())
    comps = sold.select(
        F.lit("house").alias("source"), text.normalize_item_key("title", "brand", "model", "upc").alias("query_key"),
        "title", F.col("final_price").alias("price"), F.lit(0.0).alias("shipping"),
        F.col("condition_name").alias("condition"), F.lit(True).alias("is_sold"),
        F.col("closed_at").alias("sold_at"), F.col("closed_at").alias("observed_at"), "url",
        F.col("retail_price"), F.col("category"), F.lit(inferred).alias("inferred_final"),
    )
    known = stored.where(F.col("source") == "house").select("query_key", "url").distinct()
    # a lot seen closed twice counts once: its earliest close, then the lowest price
    once = top_per_group(comps, ["query_key", "url"], [F.col("sold_at").asc_nulls_last(), F.col("price"), F.col("title")], 1)
    return once.join(known, ["query_key", "url"], "left_anti")


def sweep_expired(lots: DataFrame, as_of: Column, params: Params = Params()) -> DataFrame:
    """Open lots past close by the grace time, closed at the last bid seen."""
    cutoff = as_of - F.expr(f"INTERVAL {params.grace_minutes} MINUTES")
    expired = lots.where(~F.col("is_closed") & (F.col("close_at") <= cutoff))
    return (
        expired.withColumn("is_closed", F.lit(True)).withColumn("closed_at", as_of)
        .withColumn("final_price", F.coalesce("current_bid", "final_price"))
    )


def due_for_refresh(lots: DataFrame, as_of: Column, params: Params = Params(), limit: int | None = None) -> DataFrame:
    """Open lots worth reading again: past close, closing soon, or stale; all, or the ``limit`` nearest
    to their close."""
    open_lots = lots.where(~F.col("is_closed"))
    nearest = [F.col("close_at").asc_nulls_first(), F.col("lot_id")]
    soon = as_of + F.expr(f"INTERVAL {params.closing_soon_minutes} MINUTES")
    stale = as_of - F.expr(f"INTERVAL {params.stale_minutes} MINUTES")
    due = open_lots.where(
        F.coalesce(F.col("close_at") <= soon, F.lit(False)) | F.col("last_seen").isNull() | (F.col("last_seen") <= stale))
    return first_rows(due, nearest, limit)


def align_schema(stored: DataFrame, wanted) -> DataFrame:
    """An older table read with today's schema: missing columns appear as nulls, none is dropped
    or retyped."""
    have = set(stored.columns)
    missing = [F.lit(None).cast(f.dataType).alias(f.name) for f in wanted.fields if f.name not in have]
    return stored.select("*", *missing)


def missing_fields() -> Column:
    """Names of the fields without which a lot cannot be valued."""
    return F.array_compact(F.array(
        F.when(F.coalesce(F.col("title"), F.lit("")) == "", F.lit("title")),
        F.when(F.col("retail_price").isNull(), F.lit("retail_price")),
        F.when(F.col("close_at").isNull() & ~F.col("is_closed"), F.lit("close_at")),
    ))
