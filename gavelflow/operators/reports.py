"""Read side: feed, queue, digest, alert ledger, close-price analytics."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gavelflow.functions import alerts, money
from gavelflow.operators.books import latest_valuation
from gavelflow.operators.splitting import first_rows, positions, split_heavy, top_per_group
from gavelflow.params import Params


def _statuses(include_blocked: bool) -> list[str]:
    return ["pending", "blocked"] if include_blocked else ["pending"]


def read_queue(queue: DataFrame, lots: DataFrame, as_of: Column, include_blocked: bool = False, limit: int | None = None) -> DataFrame:
    """Suggestions by rank, all or the first ``limit``. Lots past close are dropped before the limit
    is taken."""
    live = queue.where(F.col("status").isin(_statuses(include_blocked)))
    rows = live.join(lots.select("lot_id", "title", "url", "current_bid", "retail_price", "condition_name", "close_at"), "lot_id")
    rows = rows.where(F.col("close_at").isNull() | (F.col("close_at") >= as_of))
    ranked = rows.orderBy(F.desc("rank_score"), "lot_id")
    return ranked if limit is None else ranked.limit(limit)


def queue_items(queue: DataFrame, lots: DataFrame, valuations: DataFrame) -> DataFrame:
    """Queue entries with their lot and newest valuation; entries without a valuation are kept."""
    v = latest_valuation(valuations).select(
        "lot_id", "projected_margin", "comp_value", "comp_count", F.col("confidence"), "repair_notes", "missing_parts", "reason")
    lot = lots.select("lot_id", "title", "url", "current_bid", "retail_price", F.col("condition_name").alias("condition"), "close_at")
    out = queue.join(lot, "lot_id").join(v, "lot_id", "left")
    return out.withColumn("confidence", F.coalesce("confidence", F.lit("none"))).na.fill(0, ["comp_count"])


def feed(
    queue: DataFrame, lots: DataFrame, valuations: DataFrame, as_of: Column,
    min_profit: float = 0.0, confidence: str = "", sort: str = "efficiency", include_blocked: bool = False,
) -> DataFrame:
    live = queue.where(F.col("status").isin(_statuses(include_blocked))).select("lot_id", "rank_score", "status")
    v = latest_valuation(valuations).where(F.coalesce("projected_profit", F.lit(0.0)) >= min_profit)
    if confidence:
        v = v.where(F.col("confidence") == confidence)
    v = v.select("lot_id", "projected_profit", "confidence", "walk_away_max_bid")
    open_lots = lots.where(~F.col("is_closed")).select("lot_id", "title", "close_at")
    rows = live.join(open_lots, "lot_id").join(v, "lot_id").withColumn("closes_in", alerts.time_to_close(F.col("close_at"), as_of))
    orders = {
        "profit": F.coalesce("projected_profit", F.lit(0.0)).desc(), "closing": F.col("close_at").asc_nulls_last(),
        "efficiency": F.col("rank_score").desc(),
    }
    return rows.orderBy(orders.get(sort, orders["efficiency"]), "lot_id")


# --- digest ------------------------------------------------------------------------------------
def digest_picks(valuations: DataFrame, as_of: Column, newest: bool = True, limit: int | None = None) -> DataFrame:
    """Recommended valuations of the last day, one per lot: the newest, or the most profitable. A
    ``limit`` keeps the most profitable lots."""
    recent = valuations.where(
        F.col("recommended") & (F.col("computed_at") >= as_of - F.expr("INTERVAL 24 HOURS")))
    by_profit = [F.desc("projected_profit"), F.col("lot_id"), F.col("valuation_id")]
    one = latest_valuation(recent) if newest else top_per_group(recent, ["lot_id"], by_profit, 1)
    return first_rows(one, by_profit, limit)


def unsent(candidates: DataFrame, ledger: DataFrame, as_of: Column | None = None, within_hours: int | None = None) -> DataFrame:
    """Candidates whose dedupe key was not sent: ever, or within the given hours."""
    sent = ledger
    if within_hours is not None:
        sent = ledger.where(F.col("sent_at") > as_of - F.expr(f"INTERVAL {within_hours} HOURS"))
    return candidates.join(sent.select("dedupe_key").distinct(), "dedupe_key", "left_anti")


def deal_alerts(valued: DataFrame, ledger: DataFrame, params: Params = Params()) -> DataFrame:
    """Recommended lots over the notice floor not yet announced at this bid level."""
    hot = valued.where(F.col("recommended") & (F.col("projected_profit") >= params.notify_min_profit))
    keyed = hot.withColumn("dedupe_key", alerts.deal_key("lot_id", F.col("walk_away_max_bid"))).withColumn("kind", F.lit("deal"))
    return unsent(keyed, ledger)


def closing_alerts(valued: DataFrame, ledger: DataFrame) -> DataFrame:
    keyed = valued.withColumn("dedupe_key", alerts.closing_key("lot_id")).withColumn("kind", F.lit("closing"))
    return unsent(keyed, ledger)


def alert_bodies(rows: DataFrame) -> DataFrame:
    """Adds the plain-text block of each announced lot."""
    body = alerts.deal_text(
        "title", F.col("current_bid"), F.col("walk_away_max_bid"), F.col("projected_profit"),
        F.col("projected_margin"), F.col("confidence"), F.col("url"))
    return rows.withColumn("body", body)


def digest_summary(deals: DataFrame, exposure: DataFrame | None = None) -> DataFrame:
    """One row: number of deals, projected profit, headroom and the subject line."""
    out = deals.agg(F.count(F.lit(1)).alias("deals"), F.coalesce(F.sum("projected_profit"), F.lit(0.0)).alias("total_profit"))
    if exposure is not None:
        out = out.join(F.broadcast(exposure.select("headroom")))
    else:
        out = out.withColumn("headroom", F.lit(0.0))
    n = F.col("deals")
    subject = F.when(n == 0, F.lit("Digest · no qualifying deals")).otherwise(F.concat(
        n.cast("string"), F.lit(" deal"), F.when(n == 1, "").otherwise("s"), F.lit(" · $"),
        F.format_number(F.col("total_profit"), 0), F.lit(" projected profit")))
    return out.withColumn("subject", subject)


def ledger_rows(sent: DataFrame, as_of: Column) -> DataFrame:
    return sent.select("kind", "dedupe_key", "lot_id", as_of.alias("sent_at"))


# --- analytics ------------------------------------------------------------------------------------
def closed_with_price(lots: DataFrame, limit: int | None = None) -> DataFrame:
    closed = lots.where(F.col("is_closed") & F.col("final_price").isNotNull())
    return first_rows(closed, [F.desc("closed_at"), "lot_id"], limit)


def _medians(rows: DataFrame, key: str, value: str, name: str, heavy_rows: int) -> DataFrame:
    """Median per group; a group too large for one task is ranked in value bins."""
    middle = F.abs(2 * F.col("pos") - F.col("group_n") - 1) <= 1

    def rank(part: DataFrame, split: bool) -> DataFrame:
        ranked = positions(part, [key], value, ["lot_id"], slices=[F.substring(F.col("lot_id").cast("string"), 1, 6)], split=split)
        return ranked.groupBy(key).agg(F.avg(F.when(middle, F.col(value))).alias(name))

    return split_heavy(rows.where(F.col(value).isNotNull()), [key], heavy_rows, rank)


def close_price_by_category(
    lots: DataFrame, limit: int | None = None, top: int | None = None, params: Params = Params(),
) -> DataFrame:
    """Closes, all or the newest, by category: count, median price, median share of retail."""
    rows = closed_with_price(lots, limit).select(
        "lot_id", F.coalesce(F.nullif(F.col("category"), F.lit("")), F.lit("uncategorized")).alias("category"), "final_price",
        F.when(F.col("retail_price") > 0, F.col("final_price") / F.col("retail_price")).alias("ratio"))
    grouped = rows.groupBy("category").agg(F.count(F.lit(1)).alias("lots"))
    for value, name in (("final_price", "median_price"), ("ratio", "pct_of_retail")):
        grouped = grouped.join(_medians(rows.select("lot_id", "category", value), "category", value, name, params.heavy_rows), "category", "left")
    return first_rows(grouped, [F.desc("lots"), "category"], top)


def recent_closes(lots: DataFrame, n: int | None = None) -> DataFrame:
    pct = F.col("final_price") / F.nullif(F.col("retail_price"), F.lit(0.0))
    return closed_with_price(lots, n).select("lot_id", "title", "retail_price", "final_price", pct.alias("pct"), "closed_at")


def table_counts(lots: DataFrame, comps: DataFrame) -> DataFrame:
    """One row of totals for the analytics head."""
    c = comps.agg(
        F.count_if(F.col("source") == "house").alias("house_comps"), F.count_if(F.col("source") != "house").alias("external_comps"),
        F.countDistinct("query_key").alias("distinct_items"))
    n = lots.agg(F.count(F.lit(1)).alias("lots"), F.count_if(~F.col("is_closed")).alias("open_lots"))
    return c.join(F.broadcast(n))


def landed_breakdown(lots: DataFrame, valuations: DataFrame, params: Params = Params()) -> DataFrame:
    """Cost lines of each lot at its newest walk-away bid."""
    v = latest_valuation(valuations).select("lot_id", "walk_away_max_bid")
    rows = lots.select("lot_id", "buyers_premium_rate").join(v, "lot_id", "left")
    bp = money.positive_or(F.col("buyers_premium_rate"), params.premium_rate)
    parts = money.landed_parts(F.coalesce("walk_away_max_bid", F.lit(0.0)), bp, params.tax_rate, params.pickup)
    return rows.withColumn("cost", parts).select("lot_id", "cost.*")
