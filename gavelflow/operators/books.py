"""Purchases: savings, totals, spend by purpose, portfolio statistics, decisions and sales."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from gavelflow.functions import books as fb
from gavelflow.functions import money
from gavelflow.params import Params

DEFENSIBLE = ["comps", "retail_verified"]
PURPOSE_LABELS = {
    "org_expense": "Company expense", "resell": "Resell", "personal": "Personal", "undecided": "Uncategorised",
}


def spent() -> Column:
    return F.coalesce("landed_cost", F.lit(0.0)) + F.coalesce("repair_spend", F.lit(0.0))


def realized_profit() -> Column:
    return F.when(
        F.col("sold_price").isNotNull(),
        F.col("sold_price") - F.coalesce("sold_fees", F.lit(0.0)) - F.col("landed_cost") - F.coalesce("repair_spend", F.lit(0.0)))


def latest_valuation(valuations: DataFrame) -> DataFrame:
    """Newest valuation row per lot, by one hash aggregate."""
    rest = [c for c in valuations.columns if c != "lot_id"]
    order = F.struct("computed_at", "valuation_id") if "valuation_id" in rest else F.col("computed_at")
    newest = valuations.groupBy("lot_id").agg(F.max_by(F.struct(*rest), order).alias("v"))
    return newest.select("lot_id", *[F.col(f"v.{c}").alias(c) for c in rest])


def backfill_savings(items: DataFrame, lots: DataFrame, valuations: DataFrame) -> DataFrame:
    """Reference value, basis and savings for purchases that have none yet."""
    value = latest_valuation(valuations).select("lot_id", F.col("comp_value").alias("_cv"), F.col("comp_count").alias("_cc"))
    retail = lots.select("lot_id", F.col("retail_price").alias("_retail"))
    joined = items.join(retail, "lot_id", "left").join(value, "lot_id", "left")
    todo = F.col("savings").isNull() & (F.col("value_basis") == "none")
    ref = fb.choose_reference(F.col("_retail"), F.col("_cv"), F.coalesce("_cc", F.lit(0)))
    gain = fb.savings(ref["reference_value"], F.col("landed_cost"), F.col("repair_spend"))
    made = {"reference_value": ref["reference_value"], "value_basis": ref["basis"], "savings": gain["savings"]}
    return joined.select(*[
        F.when(todo, made[c]).otherwise(F.col(c)).alias(c) if c in made else F.col(c) for c in items.columns])


def savings_totals(items: DataFrame) -> DataFrame:
    """One row; comps-backed and unverified savings stay apart."""
    has, good = F.col("savings").isNotNull(), F.col("value_basis").isin(DEFENSIBLE)
    zero = F.lit(0.0)
    out = items.agg(
        F.coalesce(F.sum(F.when(has & good, F.col("savings"))), zero).alias("defensible_savings"),
        F.coalesce(F.sum(F.when(has & ~good, F.col("savings"))), zero).alias("unverified_savings"),
        F.coalesce(F.sum(spent()), zero).alias("total_spent"), F.count(F.lit(1)).alias("items"),
        F.count_if(has & good).alias("defensible_items"), F.count_if(has & ~good).alias("unverified_items"),
        F.count_if(~has).alias("unpriced_items"),
    )
    basis = F.col("total_spent") + F.col("defensible_savings")
    return out.withColumn("effective_discount", F.when(basis > 0, F.col("defensible_savings") / basis))


def spend_by_purpose(items: DataFrame) -> DataFrame:
    """Spend, savings and share of all spend per (purpose, sub-category), biggest first."""
    groups = items.groupBy("purpose", "sub_category").agg(
        F.count(F.lit(1)).alias("items"), F.sum(spent()).alias("spent"),
        F.sum(F.coalesce("savings", F.lit(0.0))).alias("savings"))
    # the window runs over one row per purpose and sub-category
    grand = F.sum("spent").over(W.partitionBy())
    return groups.withColumn("share", F.col("spent") / F.when(grand == 0, F.lit(1.0)).otherwise(grand)).orderBy(
        F.desc("spent"), "purpose", "sub_category")


def portfolio_stats(items: DataFrame) -> DataFrame:
    sold = F.col("sold_price").isNotNull()
    zero = F.lit(0.0)

    def total(c: Column) -> Column:
        return F.coalesce(F.sum(c), zero)

    out = items.agg(
        F.count_if(sold).alias("sold_count"), F.count_if(~sold).alias("held_count"),
        total(F.when(~sold, F.col("landed_cost"))).alias("held_cost"),
        total(F.when(sold, F.col("sold_price"))).alias("revenue"),
        total(F.when(sold, spent())).alias("sold_cost"), total(realized_profit()).alias("realized_profit"),
        total(F.when(sold, F.col("projected_profit"))).alias("projected_on_sold"),
    )
    return out.withColumn(
        "realized_margin", F.when(F.col("revenue") != 0, F.col("realized_profit") / F.col("revenue")).otherwise(zero)
    ).withColumn("forecast_delta", F.col("realized_profit") - F.col("projected_on_sold"))


def forecast_check(items: DataFrame) -> DataFrame:
    """Projected against realized profit of each sold purchase."""
    sold = items.where(F.col("sold_price").isNotNull())
    return sold.select(
        "item_id", "lot_id", "projected_profit", realized_profit().alias("realized_profit"),
        (realized_profit() - F.coalesce("projected_profit", F.lit(0.0))).alias("forecast_delta"))


def filter_purchases(items: DataFrame, purpose: str = "", status: str = "") -> DataFrame:
    out = items.where(F.col("purpose") == purpose) if purpose else items
    if status == "sold":
        out = out.where(F.col("sold_price").isNotNull())
    elif status == "held":
        out = out.where(F.col("sold_price").isNull())
    return out


def add_purchases(bought: DataFrame, lots: DataFrame, valuations: DataFrame, params: Params = Params()) -> DataFrame:
    """Portfolio rows for (lot_id, hammer_price, purpose): landed cost, savings, and a purpose that
    is locked when given by hand and guessed otherwise. Unknown lots add nothing."""
    value = latest_valuation(valuations).select("lot_id", "projected_profit", "comp_value", "comp_count")
    rows = bought.join(lots.select("lot_id", "title", "category", "description", "retail_price", "buyers_premium_rate"), "lot_id")
    rows = rows.join(value, "lot_id", "left")
    bp = money.positive_or(F.col("buyers_premium_rate"), params.premium_rate)
    landed = money.landed_cost(F.col("hammer_price"), bp, params.tax_rate, params.pickup)
    guess = fb.categorise("title", "category", "description", F.col("projected_profit"))
    by_hand = F.coalesce(F.col("purpose"), F.lit("")) != ""
    ref = fb.choose_reference(F.col("retail_price"), F.col("comp_value"), F.coalesce("comp_count", F.lit(0)))
    rows = rows.withColumn("landed_cost", landed).withColumn("_g", guess).withColumn("_r", ref)
    return rows.select(
        "lot_id", "hammer_price", "landed_cost", "projected_profit",
        F.when(by_hand, F.col("purpose")).otherwise(F.col("_g.purpose")).alias("purpose"),
        F.when(~by_hand, F.col("_g.sub_category")).alias("sub_category"), by_hand.alias("purpose_locked"),
        F.col("_r.reference_value").alias("reference_value"), F.col("_r.basis").alias("value_basis"),
        (F.col("_r.reference_value") - F.col("landed_cost")).alias("savings"))


def record_sales(items: DataFrame, sales: DataFrame) -> DataFrame:
    """Sale fields from the newest sale row per lot."""
    s = sales.groupBy("lot_id").agg(
        F.max_by(F.struct("sold_price", "sold_fees", "repair_spend", "sold_channel", "sold_at"), "sold_at").alias("_s"))
    joined = items.join(s, "lot_id", "left")
    for name in ("sold_price", "sold_fees", "repair_spend", "sold_channel", "sold_at"):
        joined = joined.withColumn(name, F.when(F.col("_s").isNotNull(), F.col(f"_s.{name}")).otherwise(F.col(name)))
    return joined.select(*items.columns)


def recategorise(items: DataFrame, choices: DataFrame) -> DataFrame:
    """Purposes chosen by hand (lot_id, purpose, sub_category); they lock the row."""
    c = choices.select("lot_id", F.col("purpose").alias("_p"), F.col("sub_category").alias("_s"))
    joined = items.join(c, "lot_id", "left")
    chosen = F.col("_p").isNotNull()
    return (
        joined.withColumn("purpose", F.coalesce("_p", "purpose"))
        .withColumn("sub_category", F.when(chosen, F.col("_s")).otherwise(F.col("sub_category")))
        .withColumn("purpose_locked", chosen | F.col("purpose_locked")).select(*items.columns)
    )


# --- decisions ------------------------------------------------------------------------------------
def commitments_from_decisions(decisions: DataFrame, lots: DataFrame, queue: DataFrame, params: Params = Params()) -> DataFrame:
    """Commitments from an append-only table of (lot_id, action, max_bid, hammer_price, decided_at).

    The newest confirm sets the bid, the newest of confirm/won/lost the state; skips book nothing.
    """
    confirm = F.when(F.col("action") == "confirm", F.col("decided_at"))
    state = F.when(F.col("action").isin("confirm", "won", "lost"), F.col("decided_at"))
    per_lot = decisions.groupBy("lot_id").agg(
        F.max_by("max_bid", confirm).alias("max_bid"), F.max(confirm).alias("confirmed_at"),
        F.max_by("action", state).alias("last_action"),
        F.max(F.when(F.col("action").isin("won", "lost"), F.col("decided_at"))).alias("resolved_at"),
        F.max_by("hammer_price", F.when(F.col("action") == "won", F.col("decided_at"))).alias("hammer_price"),
    ).where(F.col("confirmed_at").isNotNull())
    info = lots.select("lot_id", "category", "buyers_premium_rate")
    suggested = queue.select("lot_id", F.col("suggested_max_bid").alias("_suggested"))
    rows = per_lot.join(info, "lot_id").join(suggested, "lot_id", "left")
    rows = rows.withColumn("max_bid", F.coalesce("max_bid", "_suggested"))
    bp = money.positive_or(F.col("buyers_premium_rate"), params.premium_rate)
    status = F.when(F.col("last_action") == "confirm", "leading").otherwise(F.col("last_action"))
    return rows.select(
        "lot_id", "max_bid", money.landed_cost(F.col("max_bid"), bp, params.tax_rate, params.pickup).alias("landed_at_max"),
        "category", status.alias("status"), "confirmed_at",
        F.when(status != "leading", F.col("resolved_at")).alias("resolved_at"),
        F.coalesce(F.nullif(F.col("hammer_price"), F.lit(0.0)), F.col("max_bid")).alias("hammer_price"), bp.alias("bp_rate"))


def queue_after_decisions(queue: DataFrame, decisions: DataFrame) -> DataFrame:
    acted = decisions.where(F.col("action").isin("confirm", "skip")).groupBy("lot_id").agg(
        F.max_by("action", "decided_at").alias("_a"), F.max("decided_at").alias("acted_at"))
    joined = queue.join(acted, "lot_id", "left")
    status = F.when(F.col("_a") == "confirm", "confirmed").when(F.col("_a") == "skip", "skipped").otherwise(F.col("status"))
    return joined.withColumn("status", status).drop("_a")


def portfolio_from_wins(commitments: DataFrame, valuations: DataFrame, params: Params = Params()) -> DataFrame:
    won = commitments.where(F.col("status") == "won")
    profit = latest_valuation(valuations).select("lot_id", "projected_profit")
    return won.join(profit, "lot_id", "left").select(
        "lot_id", "hammer_price",
        money.landed_cost(F.col("hammer_price"), F.col("bp_rate"), params.tax_rate, params.pickup).alias("landed_cost"),
        "projected_profit", F.lit("undecided").alias("purpose"), F.lit(False).alias("purpose_locked"))
