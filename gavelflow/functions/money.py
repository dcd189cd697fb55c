"""Fees, bids, resale proceeds, recency and confidence as column arithmetic."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from gavelflow import lexicon as lx
from gavelflow.functions.text import as_col
from gavelflow.params import Params


def lit_or_col(v) -> Column:
    return v if isinstance(v, Column) else F.lit(v)


def positive_or(c: Column, default) -> Column:
    """The column, or the default when it is null or zero."""
    return F.coalesce(F.nullif(c, F.lit(0.0)), lit_or_col(default))


def half_up(c: Column, digits: int = 2) -> Column:
    """Round by plain double arithmetic, the same in every engine."""
    scale = F.lit(float(10**digits))
    return F.floor(c * scale + F.lit(0.5)).cast("double") / scale


# --- coercion of loose text ------------------------------------------------------------------
def parse_money(c: Column | str) -> Column:
    digits = F.regexp_extract(F.replace(as_col(c), F.lit(",")), lx.MONEY_TEXT, 1)
    return digits.try_cast("double")


def parse_rate(c: Column | str) -> Column:
    raw = parse_money(c)
    rate = F.when(raw > 1.0, raw / 100.0).otherwise(raw)
    return F.when((rate >= 0.0) & (rate < 1.0), rate)


def parse_price(c: Column | str) -> Column:
    """A ``$`` amount anywhere in the text, else the whole text as a number."""
    text = as_col(c)
    found = F.replace(F.regexp_extract(text, lx.PRICE_TEXT, 1), F.lit(","))
    plain = F.trim(F.replace(F.replace(text, F.lit("$")), F.lit(",")))
    return F.coalesce(found.try_cast("double"), plain.try_cast("double"))


def parse_percent(c: Column | str) -> Column:
    """40 or 0.40, both meaning forty percent; blank is null."""
    n = F.trim(as_col(c)).try_cast("double")
    return F.when(n > 1, n / 100.0).otherwise(n)


def parse_when(c: Column | str) -> Column:
    """ISO text or epoch seconds/milliseconds; naive times are UTC."""
    text = F.trim(as_col(c))
    epoch = text.try_cast("double")
    seconds = F.when(epoch > 1e11, epoch / 1000.0).otherwise(epoch)
    numeric = text.rlike(r"^[0-9]{9,}(\.[0-9]+)?$")
    parsed = F.coalesce(
        F.try_to_timestamp(text),
        F.try_to_timestamp(text, F.lit("M/d/yyyy")),
        F.try_to_timestamp(text, F.lit("MMMM d, yyyy")),
        F.try_to_timestamp(text, F.lit("MMM d, yyyy")),
        F.try_to_timestamp(text, F.lit("d MMM yyyy HH:mm:ss Z")),
        F.try_to_timestamp(F.regexp_replace(text, r"^[A-Za-z]{3}, ", ""), F.lit("d MMM yyyy HH:mm:ss Z")),
        F.try_to_timestamp(F.regexp_replace(text, r"^[A-Za-z]{3}, ", ""), F.lit("d MMM yyyy HH:mm:ss z")),
    )
    return F.when(numeric, F.timestamp_micros((seconds * 1e6).cast("long"))).otherwise(parsed)


# --- bids ----------------------------------------------------------------------------------------
def bid_increment(amount: Column) -> Column:
    out = None
    for ceiling, step in lx.BID_STEPS:
        cond = amount < ceiling
        out = F.when(cond, F.lit(step)) if out is None else out.when(cond, F.lit(step))
    return out.otherwise(F.lit(lx.BID_STEP_TOP))


def floor_to_increment(amount: Column) -> Column:
    step = bid_increment(amount)
    return F.when(amount <= 0, F.lit(0.0)).otherwise(F.floor(amount / step).cast("double") * step)


def cost_multiplier(bp: Column, tax: float) -> Column:
    return (F.lit(1.0) + bp) * F.lit(1.0 + tax)


def landed_cost(hammer: Column, bp: Column, tax: float, pickup: float = 0.0) -> Column:
    premium = hammer * bp
    return hammer + premium + (hammer + premium) * F.lit(tax) + F.lit(pickup)


def landed_parts(hammer: Column, bp: Column, tax: float, pickup: float = 0.0) -> Column:
    premium = hammer * bp
    return F.struct(
        hammer.alias("hammer"), premium.alias("buyers_premium"),
        ((hammer + premium) * F.lit(tax)).alias("tax"), F.lit(pickup).alias("pickup"),
        landed_cost(hammer, bp, tax, pickup).alias("total"),
    )


def walk_away_max_bid(net: Column, margin: Column, bp: Column, tax: float, pickup: float = 0.0, snap: bool = True) -> Column:
    budget = net * (F.lit(1.0) - margin) - F.lit(pickup)
    raw = budget / cost_multiplier(bp, tax)
    bid = floor_to_increment(raw) if snap else F.greatest(F.lit(0.0), raw)
    return F.when((net <= 0) | (budget <= 0), F.lit(0.0)).otherwise(bid)


def profit_at(hammer: Column, net: Column, bp: Column, tax: float, pickup: float = 0.0) -> Column:
    return net - landed_cost(hammer, bp, tax, pickup)


def margin_at(hammer: Column, net: Column, bp: Column, tax: float, pickup: float = 0.0) -> Column:
    return F.when(net <= 0, F.lit(0.0)).otherwise(profit_at(hammer, net, bp, tax, pickup) / net)


# --- resale --------------------------------------------------------------------------------------
def channel_terms(channel: Column) -> Column:
    """Fee terms of a channel as a struct; unknown names fall back to the default channel."""
    name = F.lower(F.coalesce(channel, F.lit("ebay")))

    def pick(i: int) -> Column:
        out = None
        for key, terms in lx.CHANNELS.items():
            if key != "ebay":
                hit = F.lit(terms[i])
                out = F.when(name == key, hit) if out is None else out.when(name == key, hit)
        return out.otherwise(F.lit(lx.CHANNELS["ebay"][i]))

    key = F.when(name.isin(list(lx.CHANNELS)), name).otherwise(F.lit("ebay"))
    return F.struct(
        key.alias("key"), pick(0).alias("fee_rate"), pick(1).alias("fixed_fee"),
        pick(2).alias("ships"), pick(3).alias("packaging"),
    )


def shipping_estimate(weight_lb: Column, category: Column) -> Column:
    by_category = F.when(
        F.lower(F.trim(category)).isin(lx.HEAVY_CATEGORIES), F.lit(lx.SHIPPING_HEAVY)
    ).otherwise(F.lit(lx.SHIPPING_PLAIN))
    by_weight = F.when(weight_lb.isNull(), by_category)
    for limit, cost in lx.SHIPPING_BY_WEIGHT:
        by_weight = by_weight.when(weight_lb <= limit, F.lit(cost))
    return by_weight.otherwise(F.lit(lx.SHIPPING_OVER))


def net_proceeds(
    gross: Column, channel: Column, category: Column, weight_lb: Column | None = None,
    parts_cost: Column | None = None, labor_hours: Column | None = None,
    labor_rate: float = 25.0, shipping_override: Column | None = None,
) -> Column:
    """Struct of gross, fees, shipping, packaging, parts, labor and net."""
    weight = F.lit(None).cast("double") if weight_lb is None else weight_lb
    parts = F.lit(0.0) if parts_cost is None else parts_cost
    labor = (F.lit(0.0) if labor_hours is None else labor_hours) * F.lit(labor_rate)
    terms = channel_terms(channel)
    estimate = shipping_estimate(weight, category)
    if shipping_override is not None:
        estimate = F.coalesce(shipping_override, estimate)
    sells = gross > 0
    shipping = F.when(sells & terms["ships"], estimate).otherwise(F.lit(0.0))
    fees = F.when(sells, (gross + shipping) * terms["fee_rate"] + terms["fixed_fee"]).otherwise(F.lit(0.0))
    packaging = F.when(sells, terms["packaging"]).otherwise(F.lit(0.0))
    kept = F.when(sells, gross).otherwise(F.lit(0.0))
    net = F.greatest(F.lit(0.0), kept - fees - shipping - packaging - parts - labor)
    return F.struct(
        kept.alias("gross"), fees.alias("fees"), shipping.alias("shipping"),
        packaging.alias("packaging"), parts.alias("parts_cost"), labor.alias("labor_cost"), net.alias("net"),
    )


# --- recency and confidence ---------------------------------------------------------------------
def days_between(as_of: Column, then: Column) -> Column:
    return (F.unix_micros(as_of) - F.unix_micros(then)) / F.lit(86_400_000_000.0)


def recency_weight(sold_at: Column, as_of: Column, half_life_days: float = 45.0) -> Column:
    age = F.greatest(F.lit(0.0), days_between(as_of, sold_at))
    return F.when(sold_at.isNull(), F.lit(0.5)).otherwise(F.pow(F.lit(0.5), age / F.lit(half_life_days)))


def source_weight(source: Column) -> Column:
    out = None
    for name, weight in lx.SOURCE_WEIGHTS.items():
        out = F.when(source == name, F.lit(weight)) if out is None else out.when(source == name, F.lit(weight))
    return out.otherwise(F.lit(lx.OTHER_SOURCE_WEIGHT))


def whole(c: Column) -> Column:
    """Nearest whole number as text, for messages."""
    return F.format_string("%.0f", c)


def score_confidence(value: Column, count: Column, spread: Column, age_days: Column, sources: Column, params: Params) -> Column:
    """Struct of score, level, margin bump and reasons from a comp aggregate."""
    sample = (
        F.when(count >= 12, 1.0).when(count >= 6, 0.75).when(count >= params.min_sample, 0.5).otherwise(0.25)
    )
    dispersion = (
        F.when(spread.isNull(), 0.6).when(spread <= 0.25, 1.0).when(spread <= 0.5, 0.75)
        .when(spread <= 0.9, 0.45).otherwise(0.2)
    )
    freshness = (
        F.when(age_days.isNull(), 0.5).when(age_days <= 30, 1.0).when(age_days <= 60, 0.8)
        .when(age_days <= 90, 0.6).otherwise(0.35)
    )
    sold = F.arrays_overlap(sources, F.array(*[F.lit(s) for s in lx.SOLD_SOURCES]))
    agreement = F.when(sold & (F.size(sources) > 1), 1.0).when(sold, 0.85).otherwise(0.45)
    raw = F.lit(0.40) * sample + F.lit(0.25) * dispersion + F.lit(0.20) * freshness + F.lit(0.15) * agreement
    nothing = value.isNull() | (count == 0)
    # nine decimals keep threshold tests stable under reordered additions
    score = F.when(nothing, F.lit(0.0)).otherwise(F.round(raw, 9))
    level = (
        F.when(nothing, "none").when(score >= 0.78, "high").when(score >= 0.55, "medium").otherwise("low")
    )
    bump = (
        F.when(level == "none", F.lit(params.low_bump * 2)).when(level == "high", F.lit(0.0))
        .when(level == "medium", F.lit(params.med_bump)).otherwise(F.lit(params.low_bump))
    )
    doubts = F.array_compact(F.array(
        F.when(count < F.least(F.lit(params.min_sample), F.lit(6)), F.concat(F.lit("few comps: "), count.cast("string"))),
        F.when(spread > 0.5, F.concat(F.lit("middle half of prices spans "), whole(spread * 100), F.lit("% of value"))),
        F.when(age_days > 90, F.concat(F.lit("median age in days: "), whole(age_days))),
        F.when(~sold, F.lit("asking prices, nothing sold")),
    ))
    clustered = F.array(F.concat(F.lit("comps: "), count.cast("string"), F.lit(", of "), F.array_join(sources, ", ")))
    reasons = (
        F.when(nothing, F.array(F.lit("no comps")))
        .when(F.size(doubts) == 0, clustered).otherwise(doubts)
    )
    return F.struct(score.alias("score"), level.alias("level"), bump.alias("margin_bump"), reasons.alias("reasons"))


def rank_score(profit: Column, landed: Column, level: Column) -> Column:
    weight = F.when(level == "high", 1.0).when(level == "medium", 0.8).when(level == "low", 0.55).when(
        level == "none", 0.2).otherwise(0.5)
    return F.when(landed <= 0, F.lit(0.0)).otherwise(profit / landed * weight)


def dollars(c: Column, digits: int = 2) -> Column:
    return F.concat(F.lit("$"), F.format_number(c, digits))
