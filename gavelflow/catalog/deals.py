"""Registered queries: market, risk, valuation, lot state, watches, feed and digest, books."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gavelflow.catalog import oracle as o
from gavelflow.catalog import pricing as pr
from gavelflow.catalog.given import EVENTS_AS_OF, Given
from gavelflow.catalog.oracle import AS_OF, LONG, P, r2
from gavelflow.catalog.pricing import h, identity
from gavelflow.catalog.registry import query
from gavelflow.functions import alerts
from gavelflow.functions import books as fb
from gavelflow.operators import books, market, reports, risk, watch
from gavelflow.operators import lots as ol
from gavelflow.plans import maintained, sweep, valuation

EV = f"timestamp '{EVENTS_AS_OF}'"
# caps wide enough that every outcome of the exposure test occurs
CAPS = LONG.with_(max_total_exposure=2200.0, max_open_lots=45, max_category_exposure=700.0)


def dsum(c):
    """Order-free sum of money."""
    return F.sum((F.col(c) if isinstance(c, str) else c).cast("decimal(18,4)")).cast("double")


def qsum(expr: str) -> str:
    return f"sum(cast({expr} as decimal(18, 4)))::double"


# --- market -----------------------------------------------------------------------------------
@query("p6_fresh_prices", f"""
  select query_key, count(*) as fresh, {r2('min(price + shipping)')} as cheapest from v_prices
  where observed_at >= {AS_OF} - to_days(365) and in_stock and price + shipping > 0 group by 1""")
def p6(g: Given) -> DataFrame:
    fresh = g.prices.where(market.is_fresh(g.as_of, P.with_(fresh_days=365)))
    return fresh.groupBy("query_key").agg(F.count(F.lit(1)).alias("fresh"), h(F.min(F.col("price") + F.col("shipping"))).alias("cheapest"))


@query("p7_substitute_quality_gate", """
  select kind, count(*) filter (where coalesce(rating >= 4.0 and review_count >= 25, false)) as qualified,
    count(*) filter (where not coalesce(rating >= 4.0 and review_count >= 25, false)) as failed
  from v_prices where kind in ('sub_new', 'sub_used') group by 1""")
def p7(g: Given) -> DataFrame:
    good = market.qualifies()
    subs = g.prices.where(F.col("kind").isin(market.SUBSTITUTE_KINDS))
    return subs.groupBy("kind").agg(F.count_if(good).alias("qualified"), F.count_if(~good).alias("failed"))


def _cards_sql() -> str:
    from gavelflow import lexicon as lx

    ref = "concat_ws(' ', nullif(lot_brand, ''), nullif(lot_model, ''), nullif(lot_title, ''))"
    word = f"regexp_extract(low, {o.lit(lx.ACCESSORY_WORDS)})"
    return f"""
      k0 as (select *, trim(coalesce(title, '')) as tt, lower(trim(coalesce(title, ''))) as low, try_cast(price as double) as pv, {ref} as ref from v_cards),
      kt as (select distinct x, {o.title_parts('x', 'x')} from (select ref as x from k0 union select tt from k0)),
      k1 as (select k0.*, {o.similarity('a.xm', 'a.xw', 'b.xm', 'b.xw')} as sim, list_has_any(a.xm, b.xm) as shared,
          {word} as word, coalesce({o.sig(o.tokens(o.fold_plain('lot_brand')), 1)}[1], '') as btok,
          regexp_matches(lower(coalesce(condition, '') || ' ' || tt), {o.lit(lx.USED_WORDS)}) as used,
          try_cast(regexp_extract(low, {o.lit(lx.MULTIPACK)}, 1) as int) as pk
        from k0 join kt a on a.x = ref join kt b on b.x = tt),
      k2 as (select *, sim >= 0.72 or shared as looks, case when pk between 2 and 24 then pk else 1 end as pack from k1),
      cards as (select *, case when tt = '' or regexp_matches(low, {o.lit(lx.JUNK_TITLE)}) then 'no usable title' when pv is null then 'no parseable price'
            when pv <= 0 then 'non-positive price'
            when word <> '' and not contains(lower(coalesce(lot_title, '')), string_split(word, ' ')[1]) then 'accessory or replacement part, not the item'
            when not looks and sim < 0.22 then 'different product class (similarity ' || printf('%.2f', sim) || ')' end as reject_reason,
          case when looks and (btok = '' or contains(low, btok)) then case when used then 'exact_used' else 'exact_new' end
            else case when used then 'sub_used' else 'sub_new' end end as kind,
          {r2('pv / pack')} as unit_price, {r2('sim', 3)} as sim3 from k2)"""


@query("p8_card_classification", f"""
  with {_cards_sql()} select job_id, position, reject_reason, case when reject_reason is null then kind end as kind,
    case when reject_reason is null then unit_price end as price, case when reject_reason is null then sim3 end as similarity from cards""")
def p8(g: Given) -> DataFrame:
    return market.classify_cards(g.cards).select("job_id", "position", "reject_reason", "kind", "price", "similarity")


_KEPT = """kept as (select * from (select * from cards where reject_reason is null and url is null union all
      select * from cards where reject_reason is null and url is not null qualify row_number() over (partition by job_id, url order by position) = 1))"""


@query("p9_page_of_cards", f"""
  with {_cards_sql()}, {_KEPT},
  lines as (select job_id, string_agg(case when tt = '' then '?' else tt end || ': ' || reject_reason, '|' order by position) as rejects
    from cards where reject_reason is not null group by 1)
  select c.job_id, count(*) as results, (select count(*) from kept k where k.job_id = c.job_id) as recorded,
    case when (select count(*) from kept k where k.job_id = c.job_id) > 0 then 'done' else 'empty' end as status, any_value(rejects) as rejects
  from cards c left join lines l on l.job_id = c.job_id group by 1""")
def p9(g: Given) -> DataFrame:
    out = market.page_summary(market.classify_pages(g.cards))
    rejects = F.when(F.size("rejects") > 0, F.array_join("rejects", "|"))
    return out.select("job_id", "results", "recorded", "status", rejects.alias("rejects"))


@query("s12_market_price_load", """
  with b as (select * from v_prices where observed_at >= timestamp '1999-01-01'), s as (select * from v_prices where observed_at < timestamp '1999-01-01')
  select kind_known, count(*) as appended from (
    select url is not null as kind_known from b where url is null
    union all select true from (select distinct url, query_key from b where url is not null and price > 0) x
      where not exists (select 1 from s where s.url = x.url and s.query_key = x.query_key)) group by 1""")
def s12(g: Given) -> DataFrame:
    late = F.col("observed_at") >= F.lit("1999-01-01").cast("timestamp")
    fresh = market.new_prices(g.prices.where(late), g.prices.where(~late))
    return fresh.groupBy(F.col("url").isNotNull().alias("kind_known")).agg(F.count(F.lit(1)).alias("appended"))


@query("j4_market_price_join", f"""
  select lot_id, kind, count(*) as prices, {r2(qsum('total'))} as total from o_market_rows group by 1, 2""")
def j4(g: Given) -> DataFrame:
    rows = market.market_prices_for(identity(g), g.prices)
    return rows.groupBy("lot_id", "kind").agg(
        F.count(F.lit(1)).alias("prices"), h(dsum(F.col("price") + F.col("shipping"))).alias("total"))




@query("a3_retail_verification", f"select lot_id, verification, {r2('street')} as verified_retail from o_view")
def a3(g: Given) -> DataFrame:
    view = market.market_view(identity(g), g.prices, g.as_of, LONG)
    return view.select("lot_id", "verification", h("verified_retail").alias("verified_retail"))


@query("a4_market_view", f"""
  select lot_id, {r2('exact_new_price')} as exact_new_price, {r2('best_price')} as best_alternative_price, {r2('ceiling')} as opportunity_ceiling,
    considered as alternatives_considered, rejected as rejected_for_quality from o_view""")
def a4(g: Given) -> DataFrame:
    view = market.market_view(identity(g), g.prices, g.as_of, LONG)
    return view.select(
        "lot_id", *[h(c).alias(c) for c in ("exact_new_price", "best_alternative_price", "opportunity_ceiling")],
        "alternatives_considered", "rejected_for_quality")


@query("f23_ceiling_rule", f"""
  select lot_id, coalesce(not (landed > best_price or landed > ceiling), true) as allowed,
    case when ceiling is null then 'no verified' when landed > best_price then 'landed cost' when landed > ceiling then 'only' else 'comfortably' end as says
  from (select v.*, current_bid * 1.2261875 as landed from o_view v join v_lots using (lot_id))""")
def f23(g: Given) -> DataFrame:
    lots = identity(g)
    view = market.market_view(lots, g.prices, g.as_of, LONG).join(lots.select("lot_id", (F.col("current_bid") * 1.2261875).alias("landed")), "lot_id")
    d = market.ceiling_decision(F.col("landed"), F.col("best_alternative_price"), F.col("opportunity_ceiling"), F.col("best_alternative_note"))
    says = F.when(F.col("d.code") == "unknown", "no verified").when(F.col("d.code") == "dearer", "landed cost").when(
        F.col("d.code") == "too close", "only").otherwise("comfortably")
    return view.withColumn("d", d).select("lot_id", F.col("d.allowed").alias("allowed"), says.alias("says"))


@query("j9_price_check_candidates", f"""
  select l.lot_id, s.site, {r2('case when m is null then stake when m <= 0 then 0.0 when m <= 60 then stake * 4 when m <= 360 then stake * 2 else stake end')} as priority
  from (select *, greatest(coalesce(current_bid, 0), coalesce(retail_price, 0) * 0.25, 10.0) as stake,
      (epoch_us(close_at) - epoch_us({AS_OF})) / 60e6 as m from o_lots) l, (values ('amazon'), ('walmart'), ('facebook')) s(site)
  where not exists (select 1 from v_prices p where starts_with(p.query_key, l.family) and p.observed_at >= {AS_OF} - to_days(150))
    and not exists (select 1 from v_jobs j where j.query_key = l.item_key and j.site = s.site and j.status in ('pending', 'leased'))""")
def j9(g: Given) -> DataFrame:
    out = market.lookup_candidates(identity(g), g.prices, g.jobs, g.as_of, P.with_(fresh_days=150))
    return out.select("lot_id", "site", h("priority").alias("priority"))


@query("o3_lookup_priority", f"""
  select lot_id, {r2('case when m is null then stake when m <= 0 then 0.0 when m <= 60 then stake * 4 when m <= 360 then stake * 2 else stake end')} as priority
  from (select *, greatest(coalesce(current_bid, 0), coalesce(retail_price, 0) * 0.25, 10.0) as stake,
      (epoch_us(close_at) - epoch_us({AS_OF})) / 60e6 as m from v_lots)""")
def o3(g: Given) -> DataFrame:
    ranked = g.lots.withColumn("p", market.lookup_priority(g.as_of)).orderBy(F.desc("p"), "lot_id")
    return ranked.select("lot_id", h("p").alias("priority"))


@query("a13_lookup_queue_status", """
  select s.status, count(j.job_id) as jobs from (values ('pending'), ('leased'), ('done'), ('empty'), ('blocked'), ('failed')) s(status)
  left join v_jobs j on j.status = s.status group by 1""")
def a13(g: Given) -> DataFrame:
    return market.queue_status(g.jobs)


@query("a13_lookup_site_status", """
  select site, epoch_us(max(leased_at)) as last_search, count(*) filter (where leased_at >= timestamp '2000-06-01' - to_days(1)) as searches_24h,
    epoch_us(case when max(finished_at) filter (where status = 'blocked') + to_minutes(360) > timestamp '2000-06-01'
      then max(finished_at) filter (where status = 'blocked') + to_minutes(360) end) as blocked_until
  from v_jobs group by 1""")
def a13_sites(g: Given) -> DataFrame:
    out = market.site_status(g.jobs, F.lit("2000-06-01").cast("timestamp"))
    return out.select("site", F.unix_micros("last_search").alias("last_search"), "searches_24h", F.unix_micros("blocked_until").alias("blocked_until"))


# --- risk ---------------------------------------------------------------------------------------
@query("a5_exposure_by_category", f"""
  select lower(coalesce(category, 'uncategorized')) as category, {r2('sum(landed_at_max)')} as exposure, count(*) as open_lots from o_live group by 1""")
def a5(g: Given) -> DataFrame:
    return risk.exposure_by_category(g.commit).select("category", h("exposure").alias("exposure"), "open_lots")


@query("a5_exposure_totals", f"""
  select {r2('sum(landed_at_max)')} as total_exposure, count(*) as open_lots, {r2('greatest(0.0, 1500.0 - sum(landed_at_max))')} as headroom from o_live""")
def a5_totals(g: Given) -> DataFrame:
    return risk.exposure_totals(g.commit).select(h("total_exposure").alias("total_exposure"), "open_lots", h("headroom").alias("headroom"))


@query("j6_close_time_overlap", "select lot_id, other as other_lot_id from o_overlap")
def j6(g: Given) -> DataFrame:
    return risk.overlapping(g.lots, g.lots, g.commit)


@query("j6_overlap_ranges", """
  with held as (select distinct l.lot_id, l.close_at from o_live join v_lots l using (lot_id) where not is_closed and close_at is not null)
  select a.lot_id, (select count(*) from held h where epoch_us(h.close_at) < epoch_us(a.close_at) - 1800000000) + 1 as first,
    (select count(*) from held h where epoch_us(h.close_at) <= epoch_us(a.close_at) + 1800000000) as last
  from v_lots a where a.close_at is not null""")
def j6_ranges(g: Given) -> DataFrame:
    """Neighbours in close time as one run per lot of the held lots in order of close time."""
    return risk.overlap_ranges(g.lots, g.lots, g.commit)[0]


_TRY = "(select lot_id, category, 20.0 + current_bid as landed_try from v_lots)"


@query("f24_exposure_decision", f"""
  select lot_id, allowed, why, {r2('worst')} as worst_case_total, n_over as overlapping from ({o.exposure_sql(_TRY, 'landed_try', CAPS)})""")
def f24(g: Given) -> DataFrame:
    lots = g.lots.withColumn("landed_try", F.col("current_bid") + 20.0)
    out = risk.check_exposure(lots, g.lots, g.commit, CAPS, "landed_try")
    return out.select(
        "lot_id", F.col("exposure_allowed").alias("allowed"), F.col("exposure_code").alias("why"), h("worst_case_total").alias("worst_case_total"), "overlapping")


@query("j10_rebid_replaces", f"""
  select lot_id, {r2('(select sum(landed_at_max) from o_live) - landed_at_max + max_bid')} as worst_case_total
  from v_commit join v_lots using (lot_id)""")
def j10(g: Given) -> DataFrame:
    held = g.lots.join(g.commit.select("lot_id", "max_bid"), "lot_id")
    out = risk.check_exposure(held, g.lots, g.commit, CAPS, "max_bid")
    return out.select("lot_id", h("worst_case_total").alias("worst_case_total"))


@query("o2_capital_efficiency", f"""
  select lot_id, {r2('case when exposure_if_won > 0 then projected_profit / exposure_if_won else 0 end', 4)} as efficiency from v_queue""")
def o2(g: Given) -> DataFrame:
    entries = g.queue.withColumnRenamed("exposure_if_won", "landed_at_max")
    return risk.by_capital_efficiency(entries).select("lot_id", h("efficiency", 4).alias("efficiency"))


# --- valuation -------------------------------------------------------------------------------------
def valued_sql(lots: str = "v_lots", extra: str = "", p=CAPS) -> str:
    """CTEs ending in ``valued``: one row per lot."""
    c = o.confidence("comp_value", "n", "spread", "median_age_days", "sources")
    cond = pr.condition_sql(pr._LOT_TEXT, pr._LOT_GRADE, "lot_id, title, category, retail_price, current_bid, buyers_premium_rate, close_at, is_closed", lots)
    chan, margin, cap = ("resale_channel", "coalesce(target_margin, 0.4)::double", "max_repair_cost") if extra else ("'ebay'", "0.4::double", "null::double")
    return f"""
      {pr.quotes_sql()},
      z0 as (select c.*, comp_value, coalesce(comp_count, 0) as n, spread, median_age_days, coalesce(sources, '') as sources,
          case when t.lot_id is null then 0 else parts_cost end as pc, coalesce(priced_hours, 0) + 0.35::double * len(coalesce(unpriced, [])) as hours,
          case when incomplete then len({pr.missing_sql('x')}) else 0 end as n_missing, w.ceiling, w.best_price {', k.*exclude (lot_id)' if extra else ''}
        from ({cond}) c left join o_values using (lot_id) left join totals t on t.lot_id = c.lot_id join o_view w on w.lot_id = c.lot_id {extra}),
      z1 as (select *, coalesce(comp_value, retail_price * 0.35::double, 0.0) as fv, {c['level']} as level, {c['bump']} as bump, {o.bp_rate()} as bp from z0),
      z2 as (select *, (n_missing > 0 or fatal) and not fatal and fv * 0.94::double - pc - hours * 25.0 - fv * multiplier > 0
          and (nullif({cap}, 0) is null or pc <= {cap}) as worth from z1),
      z3 as (select *, fv * case when worth then 0.94::double else multiplier end as gross, {o.channel(chan, 0)} as rate, {o.channel(chan, 1)} as fixed,
          case when {o.channel(chan, 2)} then {o.shipping('null::double', 'category')} else 0.0 end as ship, {o.channel(chan, 3)} as pack,
          least(0.95, {margin} + bump) as margin from z2),
      z4 as (select *, case when gross <= 0 then greatest(0.0, 0.0 - case when worth then pc + hours * 25.0 else 0 end)
          else greatest(0.0, gross - ((gross + ship) * rate + fixed) - ship - pack - case when worth then pc else 0.0 end - case when worth then hours * 25.0 else 0.0 end) end as net from z3),
      z5 as (select *, case when fatal then 0.0 else {o.max_bid('net', 'margin', 'bp')} end as bid0 from z4),
      z6 as (select *, case when fatal then 0.0 else {o.landed('bid0', 'bp')} end as land0 from z5),
      z7 as (select *, coalesce(land0 > best_price or land0 > ceiling, false) as cut, least(net, ceiling / greatest(1e-9, 1.0 - margin)) as capnet from z6),
      z8 as (select *, case when cut then {o.max_bid('capnet', 'margin', 'bp')} end as capped from z7),
      z9 as (select *, case when cut then greatest(0.0, case when capped > 0 and {o.landed('capped', 'bp')} > ceiling then capped - ({o.increment('capped')}) else capped end)
          else bid0 end as bid from z8),
      z10 as (select *, case when cut then {o.landed('bid', 'bp')} else land0 end as land from z9),
      z11 as (select *, case when cut and bid <= 0 then 0.0 when not cut and fatal then 0.0 else net - land end as profit from z10),
      z12 as ({o.exposure_sql('z11', 'land', p)}),
      valued as (select *, case when cut and bid <= current_bid then 'ceiling' when fatal then 'fatal' when bid <= 0 then 'no bid'
          when bid <= current_bid then 'past max' when profit < 20 then 'thin' when level = 'none' then 'no comps'
          when not allowed then 'exposure' else 'bid' end as verdict from z12)"""


def verdict_class():
    return F.col("reason_code")


def value_all(g: Given, lots: DataFrame | None = None, **kw) -> DataFrame:
    return valuation.value_lots(
        g.lots if lots is None else lots, g.comps, g.prices, g.commit, g.as_of, CAPS, part_prices=g.part_prices, all_lots=g.lots, **kw)


_V = f"""lot_id, {r2('comp_value')} as comp_value, cast(n as bigint) as comp_count, level as confidence, {r2('net')} as net_resale,
  bid as walk_away_max_bid, {r2('land')} as landed_at_max, {r2('profit')} as projected_profit, verdict"""


def show_valued(df: DataFrame, *more) -> DataFrame:
    return df.select(
        "lot_id", h("comp_value").alias("comp_value"), "comp_count", "confidence", h("net_resale").alias("net_resale"), "walk_away_max_bid",
        h("landed_at_max").alias("landed_at_max"), h("projected_profit").alias("projected_profit"), verdict_class().alias("verdict"), *more)


@query("v1_lot_valuation", f"with {valued_sql()} select {_V} from valued")
def v1(g: Given) -> DataFrame:
    return show_valued(value_all(g))


@query("f25_verdict", f"with {valued_sql()} select verdict, count(*) as lots, {r2(qsum('profit'))} as profit from valued group by 1")
def f25(g: Given) -> DataFrame:
    rows = value_all(g).withColumn("verdict", verdict_class())
    return rows.groupBy("verdict").agg(F.count(F.lit(1)).alias("lots"), h(dsum("projected_profit")).alias("profit"))


@query("v3_revalue_open_lots", f"with {valued_sql()} select {_V} from valued where not is_closed and close_at is not null")
def v3(g: Given) -> DataFrame:
    return show_valued(valuation.revalue_open_lots(
        g.lots, g.comps, g.prices, g.commit, g.as_of, CAPS, part_prices=g.part_prices))


@query("v3_maintained_revaluation", f"with {valued_sql()} select {_V} from valued where not is_closed and close_at is not null")
def v3_maintained(g: Given) -> DataFrame:
    """Valued before the last of the comps and prices came in, then kept up to date: as one full run."""
    early = F.col("observed_at") < F.lit("1998-06-01").cast("timestamp")
    lots, tables = valuation.open_lots_nearest(g.lots), {"part_prices": g.part_prices, "all_lots": g.lots}
    first = maintained.revalue(None, lots, g.comps.where(early), g.prices.where(early), g.commit, g.as_of, CAPS, **tables)
    return show_valued(maintained.revalue(first.inputs, lots, g.comps, g.prices, g.commit, g.as_of, CAPS, **tables).valuations)


@query("p5_closing_soon", f"""
  with {valued_sql()}
  select lot_id, bid as walk_away_max_bid from valued
  where not is_closed and close_at > {AS_OF} and close_at <= {AS_OF} + to_minutes(1440) and verdict = 'bid' and bid > current_bid""")
def p5(g: Given) -> DataFrame:
    near = valuation.closing_soon(g.lots, g.as_of, CAPS.with_(closing_soon_minutes=1440), limit=None)
    rows = value_all(g, near)
    return rows.where(F.col("recommended") & (F.col("walk_away_max_bid") > F.col("current_bid"))).select("lot_id", "walk_away_max_bid")


@query("s14_valuation_rows", f"with {valued_sql()} select level as confidence, count(*) as lots, count(*) filter (where verdict = 'bid') as recommended from valued group by 1")
def s14(g: Given) -> DataFrame:
    from gavelflow.sources import sinks

    rows = sinks.valuation_rows(value_all(g))
    return rows.groupBy("confidence").agg(F.count(F.lit(1)).alias("lots"), F.count_if("recommended").alias("recommended"))


@query("j7_latest_valuation", f"""
  select q.lot_id, q.status, v.valuation_id, {r2('v.comp_value')} as comp_value, coalesce(v.confidence, 'none') as confidence, coalesce(v.comp_count, 0) as comp_count
  from v_queue q join v_lots l using (lot_id) left join (select * from v_valuations qualify row_number() over (partition by lot_id order by computed_at desc, valuation_id desc) = 1) v using (lot_id)""")
def j7(g: Given) -> DataFrame:
    latest = books.latest_valuation(g.valuations)
    rows = g.queue.select("lot_id", "status").join(g.lots.select("lot_id"), "lot_id").join(latest, "lot_id", "left")
    return rows.select(
        "lot_id", "status", "valuation_id", h("comp_value").alias("comp_value"), F.coalesce("confidence", F.lit("none")).alias("confidence"),
        F.coalesce("comp_count", F.lit(0)).alias("comp_count"))


# --- lot state --------------------------------------------------------------------------------------
@query("w1_change_only_snapshots", """
  select obs_id, lot_id, current_bid, bid_count from (select *, lag(current_bid) over w as pb, lag(bid_count) over w as pc, row_number() over w as rn
    from v_obs window w as (partition by lot_id order by observed_at, obs_id))
  where rn = 1 or pb is distinct from current_bid or pc is distinct from bid_count""")
def w1(g: Given) -> DataFrame:
    return ol.change_only(g.obs).select("obs_id", "lot_id", "current_bid", "bid_count")


FOLD = """
  select o.lot_id, arg_max(title, {'t': observed_at, 'i': obs_id}) filter (where title is not null) as title,
    arg_max(condition_name, {'t': observed_at, 'i': obs_id}) filter (where condition_name is not null) as condition_name,
    arg_max(retail_price, {'t': observed_at, 'i': obs_id}) filter (where retail_price is not null) as retail_price, any_value(url) as url,
    max(current_bid) as current_bid, max(bid_count) as bid_count, max(close_at) as close_at, max(observed_at) as last_seen, bool_or(is_closed) as is_closed,
    any_value(c.closed_at) as closed_at, any_value(coalesce(nullif(c.final_price, 0), c.top)) as final_price, count(*) as observations
  from {obs} o left join (select lot_id, observed_at as closed_at, final_price, top from (select *, max(current_bid) over w as top, sum(is_closed::int) over w as nth
      from {obs} window w as (partition by lot_id order by observed_at, obs_id)) where is_closed and nth = 1) c using (lot_id)
  group by 1"""
_STATE = f"""lot_id, title, condition_name, {r2('retail_price')} as retail_price, current_bid, bid_count, is_closed, {r2('final_price')} as final_price,
  epoch_us(closed_at) as closed_at, epoch_us(last_seen) as last_seen"""


def show_state(df: DataFrame) -> DataFrame:
    return df.select(
        "lot_id", "title", "condition_name", h("retail_price").alias("retail_price"), "current_bid", "bid_count", "is_closed",
        h("final_price").alias("final_price"), F.unix_micros("closed_at").alias("closed_at"), F.unix_micros("last_seen").alias("last_seen"))


@query("w2_lot_state_fold", f"select {_STATE} from ({FOLD.replace('{obs}', 'v_obs')})")
def w2(g: Given) -> DataFrame:
    return show_state(ol.fold_observations(g.obs))


_HALF = "timestamp '2024-01-16'"


@query("w2_fold_onto_earlier_state", f"""
  select {_STATE}, lot_id not in (select lot_id from v_obs where observed_at < {_HALF}) as is_new from ({FOLD.replace('{obs}', 'v_obs')})""")
def w2_incremental(g: Given) -> DataFrame:
    """Two loads must give what one load gives."""
    cut = F.lit("2024-01-16").cast("timestamp")
    first = ol.fold_observations(g.obs.where(F.col("observed_at") < cut))
    both = ol.fold_observations(g.obs.where(F.col("observed_at") >= cut), first)
    return show_state(both).join(both.select("lot_id", "is_new"), "lot_id")


@query("w4_bid_history_tail", """
  select lot_id, obs_id, current_bid from v_obs qualify row_number() over (partition by lot_id order by observed_at desc, obs_id desc) <= 25""")
def w4(g: Given) -> DataFrame:
    return ol.bid_history_tail(g.obs).select("lot_id", "obs_id", "current_bid")


@query("p2_discount", f"select lot_id, {r2('greatest(0.0, 1.0 - current_bid / nullif(retail_price, 0))', 4)} as discount from (select * from v_lots where retail_price is not null) union all select lot_id, null from v_lots where retail_price is null")
def p2(g: Given) -> DataFrame:
    off = ol.discount(F.col("current_bid"), F.col("retail_price"))
    return g.lots.select("lot_id", F.when(F.col("retail_price").isNotNull(), h(off, 4)).alias("discount"))


@query("p4_due_for_refresh", f"""
  select lot_id from v_lots where not is_closed and (coalesce(close_at <= {AS_OF} + to_minutes(90), false) or last_seen is null or last_seen <= {AS_OF} - to_minutes(15))""")
def p4(g: Given) -> DataFrame:
    return ol.due_for_refresh(g.lots, g.as_of, P, limit=None).select("lot_id")


@query("p4_due_for_refresh_batch", f"""
  select lot_id from (select * from v_lots where not is_closed and (coalesce(close_at <= {AS_OF} + to_minutes(90), false) or last_seen is null or last_seen <= {AS_OF} - to_minutes(15)) order by close_at nulls first, lot_id limit 120)""")
def p4_batch(g: Given) -> DataFrame:
    return ol.due_for_refresh(g.lots, g.as_of, P, limit=120).select("lot_id")


@query("p11_missing_fields", """
  select lot_id, concat_ws(',', case when coalesce(title, '') = '' then 'title' end, case when retail_price is null then 'retail_price' end,
    case when close_at is null and not is_closed then 'close_at' end) as missing from v_lots""")
def p11(g: Given) -> DataFrame:
    return g.lots.select("lot_id", F.array_join(ol.missing_fields(), ",").alias("missing"))


@query("u2_close_to_comp", f"""
  select item_key as query_key, url, {r2('final_price')} as price from o_lots l where is_closed and final_price is not null
    and not exists (select 1 from v_comps c where c.source = 'house' and c.query_key = l.item_key and c.url = l.url)""")
def u2(g: Given) -> DataFrame:
    return ol.closed_to_comps(g.lots, g.comps).select("query_key", "url", h("price").alias("price"))


@query("u3_expired_lot_sweep", f"""
  select lot_id, coalesce(current_bid, final_price) as final_price from v_lots where not is_closed and close_at <= {AS_OF} - to_minutes(20)""")
def u3(g: Given) -> DataFrame:
    return ol.sweep_expired(g.lots, g.as_of).select("lot_id", "final_price")


@query("v4_refresh_and_harvest", f"""
  with st as ({FOLD.replace('{obs}', 'v_obs')})
  select lot_id, is_closed or coalesce(close_at <= {EV} - to_minutes(20), false) as is_closed,
    {r2(f"case when is_closed then final_price when close_at <= {EV} - to_minutes(20) then current_bid end")} as final_price from st""")
def v4(g: Given) -> DataFrame:
    cut = F.lit("2024-01-16").cast("timestamp")
    known = ol.fold_observations(g.obs.where(F.col("observed_at") < cut)).withColumn("brand", F.lit(None).cast("string"))
    known = known.withColumn("model", F.lit(None).cast("string")).withColumn("upc", F.lit(None).cast("string")).withColumn(
        "category", F.lit(None).cast("string"))
    out = sweep.refresh_and_harvest(known, g.obs.where(F.col("observed_at") >= cut), g.comps, g.events_as_of, P)
    return out.lots.select("lot_id", "is_closed", h("final_price").alias("final_price"))


# --- watches ------------------------------------------------------------------------------------------
def reasons_sql() -> str:
    def lst(col: str) -> str:
        return f"list_filter(list_transform(string_split(lower(coalesce({col}, '')), ','), lambda t: trim(t)), lambda t: t <> '')"

    def none_of(col: str, text: str) -> str:
        return f"(len({lst(col)}) > 0 and len(list_filter({lst(col)}, lambda t: contains({text}, t))) = 0)"

    def low(c: str) -> str:
        return f"lower(coalesce(l.{c}, ''))"

    brand = f"(len({lst('w.brands')}) > 0 and len(list_filter({lst('w.brands')}, lambda t: contains({low('brand')}, t) or contains({low('title')}, t))) = 0)"
    off = "greatest(0.0, 1.0 - l.current_bid / nullif(l.retail_price, 0))"
    damaged = f"regexp_matches(x, {o.any_of(pr_lex('fatal'))}) or regexp_matches(x, {o.any_of(pr_lex('incomplete'))})"
    singles = [
        (none_of("w.categories", low("category")), "'category mismatch'"), (none_of("w.conditions", low("condition_name")), "'condition mismatch'"),
        (none_of("w.locations", low("location")), "'location mismatch'"), (brand, "'brand mismatch'"),
        ("w.min_retail is not null and (l.retail_price is null or l.retail_price < w.min_retail)", "'retail below $' || format('{:,.0f}', w.min_retail)"),
        ("w.max_retail is not null and (l.retail_price is null or l.retail_price > w.max_retail)", "'retail above $' || format('{:,.0f}', w.max_retail)"),
        ("l.current_bid < w.min_current_bid", "'current bid too low'"),
        ("l.current_bid > w.max_current_bid", "'current bid above $' || format('{:,.0f}', w.max_current_bid)"),
        (f"w.min_discount_pct is not null and (l.retail_price is null or {off} < w.min_discount_pct)", "'discount under ' || format('{:.0f}', w.min_discount_pct * 100) || '%'"),
        ("w.closes_within_minutes is not null and (m is null or m > w.closes_within_minutes or m < 0)", "'not closing within ' || w.closes_within_minutes || ' min'"),
        ("w.closes_after_minutes is not null and (m is null or m < w.closes_after_minutes)", "'closes sooner than ' || w.closes_after_minutes || ' min'"),
        (f"coalesce(not w.include_damaged, false) and ({damaged})", "'damaged/incomplete excluded by watch'"),
    ]
    tail = "[" + ", ".join(f"case when {c} then {t} end" for c, t in singles) + "]"
    return f"""
      select w.watch_id, l.lot_id, w.enabled, w.name, l.category, array_to_string(list_concat(
          case when {none_of('w.keywords', 'hay')} then ['no keyword matched'] else [] end,
          list_transform(list_filter({lst('w.require_all')}, lambda t: not contains(hay, t)), lambda t: 'missing required term ''' || t || ''''),
          list_transform(list_filter({lst('w.exclude_terms')}, lambda t: contains(hay, t)), lambda t: 'excluded term ''' || t || ''' present'),
          list_filter({tail}, lambda t: t is not null)), '|') as reasons
      from v_watches w, (select *, lower(concat_ws(' ', title, description, brand, model, category, condition_name, condition_notes)) as hay,
        {pr._LOT_TEXT} as x, (epoch_us(close_at) - epoch_us({AS_OF})) / 60e6 as m from v_lots) l"""


def pr_lex(kind: str) -> list[str]:
    from gavelflow import lexicon as lx

    return next(p for k, _, p in lx.SIGNAL_FAMILIES if k == kind)


@query("p1_watch_reasons", f"select watch_id, lot_id, reasons from ({reasons_sql()}) r join v_links using (watch_id, lot_id)")
def p1(g: Given) -> DataFrame:
    out = watch.explain_matches(g.lots, g.watches, g.links, g.as_of)
    return out.select("watch_id", "lot_id", F.array_join("reasons", "|").alias("reasons"))


@query("j1_watch_lot_matches", f"""
  select watch_id, lot_id from ({reasons_sql()}) r where enabled and reasons = '' and not exists (select 1 from v_earlier k where k.watch_id = r.watch_id and k.lot_id = r.lot_id)""")
def j1(g: Given) -> DataFrame:
    return watch.match_watches(g.lots, g.watches.where("enabled"), g.as_of, g.earlier).select("watch_id", "lot_id")


@query("a12_watch_match_counts", "select w.watch_id, w.name, count(k.lot_id) as match_count from v_watches w left join v_links k using (watch_id) group by 1, 2")
def a12(g: Given) -> DataFrame:
    return watch.match_counts(g.watches, g.links).select("watch_id", "name", "match_count")


_FRESHQ = f"""
  fresh as (select lot_id, walk_away_max_bid as bid, projected_profit as profit, walk_away_max_bid * 1.2 as land, confidence, recommended
    from v_valuations qualify row_number() over (partition by lot_id order by computed_at desc, valuation_id desc) = 1),
  kept as (select *, not recommended as blocked from fresh where recommended or confidence = 'low')"""


def latest_runs(g: Given) -> DataFrame:
    """Newest stored valuation per lot, in the shape a run has; low confidence plays 'blocked'."""
    v = books.latest_valuation(g.valuations)
    return v.select(
        "lot_id", "walk_away_max_bid", "projected_profit", (F.col("walk_away_max_bid") * 1.2).alias("landed_at_max"), "confidence", "recommended",
        (F.col("confidence") != "low").alias("exposure_allowed"), F.lit("cap reached").alias("exposure_reason"))


@query("u4_queue_upsert", f"""
  with {_FRESHQ}
  select coalesce(q.lot_id, k.lot_id) as lot_id,
    case when take then case when blocked then 'blocked' else 'pending' end else status end as status,
    case when take then bid else suggested_max_bid end as suggested_max_bid,
    {r2("case when take then case when land <= 0 then 0.0 else profit / land * case confidence when 'high' then 1.0 when 'medium' then 0.8 when 'low' then 0.55 else 0.2 end end else rank_score end", 4)} as rank_score,
    case when take then case when blocked then 'cap reached' end else block_reason end as block_reason,
    q.lot_id is null and not coalesce(blocked, true) as newly_queued
  from (select q.*, k.lot_id as k_lot, k.bid, k.profit, k.land, k.confidence, k.blocked, k.lot_id is not null and coalesce(status, '') not in ('confirmed', 'skipped') as take
    from (select * from v_queue where lot_id not like '%7') q full outer join kept k on k.lot_id = q.lot_id) q left join (select lot_id from kept) k on k.lot_id = q.k_lot""")
def u4(g: Given) -> DataFrame:
    out = watch.upsert_queue(g.queue.where("lot_id not like '%7'"), latest_runs(g), g.as_of)
    return out.select("lot_id", "status", "suggested_max_bid", h("rank_score", 4).alias("rank_score"), "block_reason", "newly_queued")


def sweep_sql() -> str:
    runs = f"(select watch_id, lot_id as run_lot, w.target_margin, w.resale_channel, w.max_repair_cost from ({reasons_sql()}) r join v_watches w using (watch_id) where r.enabled and reasons = '')"
    return valued_sql(extra=f"join (select run_lot as lot_id, * exclude (run_lot) from {runs}) k on k.lot_id = c.lot_id")


def swept(g: Given) -> tuple[DataFrame, DataFrame]:
    active = g.watches.where("enabled")
    matched = watch.match_watches(g.lots, active, g.as_of)
    asked = g.lots.join(matched.select("lot_id").distinct(), "lot_id", "left_semi")
    return active, value_all(g, asked, runs=matched)


@query("v2_watch_sweep", f"""
  with {sweep_sql()} select watch_id, lot_id, level as confidence, {r2('net')} as net_resale, bid as walk_away_max_bid, {r2('profit')} as projected_profit, verdict from valued""")
def v2(g: Given) -> DataFrame:
    _, runs = swept(g)
    return runs.select(
        "watch_id", "lot_id", "confidence", h("net_resale").alias("net_resale"), "walk_away_max_bid", h("projected_profit").alias("projected_profit"),
        verdict_class().alias("verdict"))


@query("a17_sweep_report", f"""
  with {sweep_sql()}, kept as (select watch_id, lot_id, verdict = 'bid' as rec from valued where verdict = 'bid' or (bid > 0 and not allowed)),
  firsts as (select lot_id, min(watch_id) as watch_id, arg_min(rec, watch_id) as rec from kept group by 1),
  per as (select w.name as watch_name, (select count(*) from v_lots) as seen, (select count(*) from v_lots where bid_count = 0) as new_lots,
    (select count(*) from valued v where v.watch_id = w.watch_id) as matched, (select count(*) from valued v where v.watch_id = w.watch_id and verdict = 'bid') as recommended,
    (select count(*) from firsts f where f.watch_id = w.watch_id and rec and lot_id not in (select lot_id from v_queue where status <> 'pending')) as queued,
    (select count(*) from valued v where v.watch_id = w.watch_id and verdict <> 'bid' and bid > 0 and not allowed) as blocked
    from v_watches w where enabled)
  select watch_name, sum(seen)::bigint as seen, sum(new_lots)::bigint as new_lots, sum(matched)::bigint as matched, sum(matched)::bigint as valued,
    sum(recommended)::bigint as recommended, sum(queued)::bigint as queued, sum(blocked)::bigint as blocked from per group by rollup(watch_name)""")
def a17(g: Given) -> DataFrame:
    active, runs = swept(g)
    seen = g.lots.withColumn("is_new", F.col("bid_count") == 0)
    return watch.sweep_report(runs, active, seen, g.queue.where("status <> 'pending'"))


# --- feed, queue, digest --------------------------------------------------------------------------------
@query("o1_queue_ranking", f"""
  select lot_id, status, {r2('rank_score', 4)} as rank_score from v_queue join v_lots using (lot_id)
  where status in ('pending', 'blocked') and (close_at is null or close_at >= {AS_OF})""")
def o1_queue(g: Given) -> DataFrame:
    out = reports.read_queue(g.queue, g.lots, g.as_of, include_blocked=True)
    return out.select("lot_id", "status", h("rank_score", 4).alias("rank_score"))


@query("o1_queue_expiry", f"""
  select case when status in ('pending', 'blocked') and close_at < {AS_OF} then 'expired' else status end as status, count(*) as entries
  from v_queue left join v_lots using (lot_id) group by 1""")
def o1_expiry(g: Given) -> DataFrame:
    return watch.expire_queue(g.queue, g.lots, g.as_of).groupBy("status").agg(F.count(F.lit(1)).alias("entries"))


@query("p3_feed", f"""
  select q.lot_id, q.status, {r2('v.projected_profit')} as projected_profit, v.confidence,
    case when s < 0 then 'closed' when s < 3600 then (floor(s / 60)::bigint) || 'm' when s < 86400 then (floor(s / 3600)::bigint) || 'h ' || (floor((s % 3600) / 60)::bigint) || 'm'
      when s is not null then (floor(s / 86400)::bigint) || 'd ' || (floor((s % 86400) / 3600)::bigint) || 'h' end as closes_in
  from v_queue q join (select *, (epoch_us(close_at) - epoch_us({AS_OF})) / 1e6 as s from v_lots where not is_closed) l using (lot_id)
  join (select * from v_valuations qualify row_number() over (partition by lot_id order by computed_at desc, valuation_id desc) = 1) v using (lot_id)
  where q.status in ('pending', 'blocked') and coalesce(v.projected_profit, 0) >= 5 and v.confidence = 'high'""")
def p3(g: Given) -> DataFrame:
    out = reports.feed(g.queue, g.lots, g.valuations, g.as_of, 5.0, "high", "profit", include_blocked=True)
    return out.select("lot_id", "status", h("projected_profit").alias("projected_profit"), "confidence", "closes_in")


@query("f26_time_to_close", f"""
  select lot_id, case when s < 0 then 'closed' when s < 3600 then (floor(s / 60)::bigint) || 'm' when s < 86400 then (floor(s / 3600)::bigint) || 'h ' || (floor((s % 3600) / 60)::bigint) || 'm'
      when s is not null then (floor(s / 86400)::bigint) || 'd ' || (floor((s % 86400) / 3600)::bigint) || 'h' end as closes_in
  from (select lot_id, (epoch_us(close_at) - epoch_us({AS_OF})) / 1e6 as s from v_lots)""")
def f26(g: Given) -> DataFrame:
    return g.lots.select("lot_id", alerts.time_to_close(F.col("close_at"), g.as_of).alias("closes_in"))


@query("f27_dedupe_keys", """
  select valuation_id, 'deal:' || lot_id || ':' || (floor(walk_away_max_bid / 5)::bigint) as deal, 'closing:' || lot_id as closing,
    'digest:' || strftime(computed_at, '%Y-%m-%d') as digest, 'outbid:' || lot_id || ':' || (floor(comp_value)::bigint) as outbid from v_valuations""")
def f27(g: Given) -> DataFrame:
    return g.valuations.select(
        "valuation_id", alerts.deal_key("lot_id", F.col("walk_away_max_bid")).alias("deal"), alerts.closing_key("lot_id").alias("closing"),
        alerts.digest_key(F.col("computed_at")).alias("digest"), alerts.outbid_key("lot_id", F.col("comp_value")).alias("outbid"))


_DAY = "timestamp '2001-03-01'"


@query("w3_digest_newest_per_lot", f"""
  select lot_id, valuation_id from (select * from v_valuations where recommended and computed_at >= {_DAY} - to_hours(24)
    qualify row_number() over (partition by lot_id order by computed_at desc, valuation_id desc) = 1)""")
def w3(g: Given) -> DataFrame:
    return reports.digest_picks(g.valuations, F.lit("2001-03-01").cast("timestamp")).select("lot_id", "valuation_id")


@query("w3_digest_most_profitable", f"""
  select lot_id, valuation_id from (select * from v_valuations where recommended and computed_at >= {_DAY} - to_hours(24)) qualify row_number() over (partition by lot_id order by projected_profit desc, valuation_id) = 1""")
def w3_profit(g: Given) -> DataFrame:
    return reports.digest_picks(g.valuations, F.lit("2001-03-01").cast("timestamp"), newest=False).select("lot_id", "valuation_id")


@query("j8_unsent_alerts", """
  select lot_id, 'deal:' || lot_id || ':' || (floor(suggested_max_bid / 5)::bigint) as dedupe_key from v_queue
  where 'deal:' || lot_id || ':' || (floor(suggested_max_bid / 5)::bigint) not in (select dedupe_key from v_ledger)""")
def j8(g: Given) -> DataFrame:
    keyed = g.queue.select("lot_id", alerts.deal_key("lot_id", F.col("suggested_max_bid")).alias("dedupe_key"))
    return reports.unsent(keyed, g.ledger)


@query("j8_unsent_within_hours", f"""
  select lot_id from v_queue where 'deal:' || lot_id || ':' || (floor(suggested_max_bid / 5)::bigint) not in
    (select dedupe_key from v_ledger where sent_at > {AS_OF} - to_hours(24))""")
def j8_hours(g: Given) -> DataFrame:
    keyed = g.queue.select("lot_id", alerts.deal_key("lot_id", F.col("suggested_max_bid")).alias("dedupe_key"))
    return reports.unsent(keyed, g.ledger, g.as_of, 24).select("lot_id")


@query("f28_digest_summary", f"""
  with {valued_sql()}, d as (select * from valued where verdict = 'bid' and profit >= 25
    and 'deal:' || lot_id || ':' || (floor(bid / 5)::bigint) not in (select dedupe_key from v_ledger))
  select count(*) as deals, {r2(qsum('profit'))} as total_profit, {r2('(select greatest(0.0, 2200.0 - sum(landed_at_max)) from o_live)')} as headroom from d""")
def f28(g: Given) -> DataFrame:
    deals = reports.deal_alerts(value_all(g), g.ledger, P)
    deals = deals.withColumn("projected_profit", F.col("projected_profit").cast("decimal(18,4)"))
    out = reports.digest_summary(deals, risk.exposure_totals(g.commit, CAPS))
    return out.select("deals", h(F.col("total_profit").cast("double")).alias("total_profit"), h("headroom").alias("headroom"))


@query("s15_alert_rows", f"""
  with {valued_sql()} select lot_id, 'deal:' || lot_id || ':' || (floor(bid / 5)::bigint) as dedupe_key from valued where verdict = 'bid' and profit >= 25
    and 'deal:' || lot_id || ':' || (floor(bid / 5)::bigint) not in (select dedupe_key from v_ledger)""")
def s15(g: Given) -> DataFrame:
    deals = reports.alert_bodies(reports.deal_alerts(value_all(g), g.ledger, P))
    return reports.ledger_rows(deals.where(F.length("body") > 0), g.as_of).select("lot_id", "dedupe_key")


@query("a10_close_price_by_category", f"""
  select coalesce(category, 'uncategorized') as category, count(*) as lots, {r2('median(final_price)')} as median_price,
    {r2('median(case when retail_price > 0 then final_price / retail_price end)', 4)} as pct_of_retail
  from v_lots where is_closed and final_price is not null group by 1""")
def a10(g: Given) -> DataFrame:
    out = reports.close_price_by_category(g.lots)
    return out.select("category", "lots", h("median_price").alias("median_price"), h("pct_of_retail", 4).alias("pct_of_retail"))


@query("a10_recent_closes", f"""
  select lot_id, {r2('final_price')} as final_price, {r2('final_price / nullif(retail_price, 0)', 4)} as pct from v_lots
  where is_closed and final_price is not null""")
def a10_recent(g: Given) -> DataFrame:
    return reports.recent_closes(g.lots).select("lot_id", h("final_price").alias("final_price"), h("pct", 4).alias("pct"))


@query("a10_table_counts", """
  select count(*) filter (where source = 'house') as house_comps, count(*) filter (where source <> 'house') as external_comps, count(distinct query_key) as distinct_items,
    (select count(*) from v_lots) as lots, (select count(*) from v_lots where not is_closed) as open_lots from v_comps""")
def a10_counts(g: Given) -> DataFrame:
    return reports.table_counts(g.lots, g.comps)


# --- books ------------------------------------------------------------------------------------------------
@query("f18_savings", f"""
  select valuation_id, case when comps and retail_price <= comp_value * 2.5 then 'retail_verified' when comps then 'comps' when retail_price > 0 then 'retail_stated' else 'none' end as basis,
    {r2('case when comps then comp_value when retail_price > 0 then retail_price * 0.7::double end')} as reference_value,
    {r2('case when comps then comp_value when retail_price > 0 then retail_price * 0.7::double end - (walk_away_max_bid + 2.5)')} as savings
  from (select v.*, retail_price, comp_value > 0 and comp_count >= 3 as comps from v_valuations v join v_lots using (lot_id))""")
def f18(g: Given) -> DataFrame:
    rows = g.valuations.join(g.lots.select("lot_id", "retail_price"), "lot_id")
    ref = fb.choose_reference(F.col("retail_price"), F.col("comp_value"), F.col("comp_count"))
    rows = rows.withColumn("r", ref)
    gain = fb.savings(F.col("r.reference_value"), F.col("walk_away_max_bid"), F.lit(2.5))
    return rows.select(
        "valuation_id", F.col("r.basis").alias("basis"), h("r.reference_value").alias("reference_value"), h(gain["savings"]).alias("savings"))


def categorise_sql(text: str, profit: str) -> str:
    from gavelflow import lexicon as lx

    def hit(terms) -> str:
        return f"regexp_matches(x, {o.term_regex(terms)})"

    def case(vals: list[str]) -> str:
        toy, child, fix, off, sup, prof, bulk, none = vals
        return (
            f"case when {hit(lx.TOY_TERMS)} then {toy} when regexp_matches(x, {o.lit(lx.CHILD_WORDING)}) and not {hit(lx.OFFICE_TERMS)} then {child}"
            f" when {hit(lx.FIXTURE_TERMS)} then {fix} when {hit(lx.OFFICE_TERMS)} then {off} when {hit(lx.SUPPLY_TERMS)} then {sup}"
            f" when {profit} > 0 then {prof} when {hit(lx.BULK_TERMS)} then {bulk} else {none} end")

    def said(label: str, terms) -> str:
        return f"'{label} (' || {o.first_term('x', terms)} || ')'"

    purpose = case(["'org_expense'"] * 5 + ["'resell'", "'resell'", "'undecided'"])
    sub = case(["'inventory_toys'", "'inventory_toys'", "'fixtures'", "'office'", "'supplies'", "null", "null", "null"])
    conf = case(["0.9", "0.65", "0.7", "0.7", "0.7", "0.75", "0.5", "0.0"])
    reason = case([
        said("reads as toy-library stock", lx.TOY_TERMS), "'reads as toy-library stock (child-directed wording)'", said("storage/room fit-out", lx.FIXTURE_TERMS),
        said("office or admin equipment", lx.OFFICE_TERMS), said("operating supplies", lx.SUPPLY_TERMS),
        f"'resale engine projected $' || format('{{:,.2f}}', {profit}) || ' profit'", "'bulk/assorted wording suggests a flip'",
        "'no clear signal — needs categorising by hand'"])
    return f"{purpose} as purpose, {sub} as sub_category, {conf}::double as confidence, {reason} as reason"


_CAT_TEXT = "concat_ws(' ', nullif(lower(title), ''), nullif(lower(category), ''), nullif(lower(description), ''))"


@query("f19_purpose_categoriser", f"""
  select lot_id, {categorise_sql('x', 'profit')} from (select lot_id, {_CAT_TEXT} as x, current_bid - 200 as profit from v_lots)""")
def f19(g: Given) -> DataFrame:
    rows = g.lots.withColumn("c", fb.categorise("title", "category", "description", F.col("current_bid") - 200))
    return rows.select("lot_id", "c.purpose", "c.sub_category", "c.confidence", "c.reason")


_SPENT = "(coalesce(landed_cost, 0) + coalesce(repair_spend, 0))"
_GOOD = "value_basis in ('comps', 'retail_verified')"


@query("a7_savings_totals", f"""
  select {r2(f"sum(savings) filter (where {_GOOD})", 0)} as defensible_savings, {r2(f"sum(savings) filter (where not {_GOOD})", 0)} as unverified_savings,
    {r2(f"sum{_SPENT}", 0)} as total_spent, count(*) as items, count(savings) filter (where {_GOOD}) as defensible_items,
    count(savings) filter (where not {_GOOD}) as unverified_items, count(*) - count(savings) as unpriced_items,
    {r2(f"sum(savings) filter (where {_GOOD}) / (sum{_SPENT} + sum(savings) filter (where {_GOOD}))", 4)} as effective_discount from v_portfolio""")
def a7(g: Given) -> DataFrame:
    t = books.savings_totals(g.portfolio)
    return t.select(
        *[h(c, 0).alias(c) for c in ("defensible_savings", "unverified_savings", "total_spent")], "items", "defensible_items", "unverified_items",
        "unpriced_items", h("effective_discount", 4).alias("effective_discount"))


@query("a8_spend_by_purpose", f"""
  select purpose, sub_category, count(*) as items, {r2(f"sum{_SPENT}", 0)} as spent, {r2('sum(coalesce(savings, 0))', 0)} as savings,
    {r2(f"sum{_SPENT} / (select sum{_SPENT} from v_portfolio)", 4)} as share from v_portfolio group by 1, 2""")
def a8(g: Given) -> DataFrame:
    out = books.spend_by_purpose(g.portfolio)
    return out.select("purpose", "sub_category", "items", h("spent", 0).alias("spent"), h("savings", 0).alias("savings"), h("share", 4).alias("share"))


_REAL = "(sold_price - coalesce(sold_fees, 0) - landed_cost - coalesce(repair_spend, 0))"


@query("a9_portfolio_stats", f"""
  select count(sold_price) as sold_count, count(*) - count(sold_price) as held_count, {r2('sum(case when sold_price is null then landed_cost end)', 0)} as held_cost,
    {r2('sum(sold_price)', 0)} as revenue, {r2(f'sum{_REAL}', 0)} as realized_profit, {r2(f'sum{_REAL} / sum(sold_price)', 4)} as realized_margin,
    {r2(f'sum{_REAL} - sum(case when sold_price is not null then projected_profit end)', 0)} as forecast_delta from v_portfolio""")
def a9(g: Given) -> DataFrame:
    s = books.portfolio_stats(g.portfolio)
    return s.select(
        "sold_count", "held_count", h("held_cost", 0).alias("held_cost"), h("revenue", 0).alias("revenue"), h("realized_profit", 0).alias("realized_profit"),
        h("realized_margin", 4).alias("realized_margin"), h("forecast_delta", 0).alias("forecast_delta"))


@query("v6_forecast_check", f"select item_id, lot_id, {r2(_REAL)} as realized_profit, {r2(f'{_REAL} - projected_profit')} as forecast_delta from v_portfolio where sold_price is not null")
def v6(g: Given) -> DataFrame:
    out = books.forecast_check(g.portfolio)
    return out.select("item_id", "lot_id", h("realized_profit").alias("realized_profit"), h("forecast_delta").alias("forecast_delta"))


@query("p10_purchase_filters", "select item_id, lot_id from v_portfolio where purpose = 'resell' and sold_price is null")
def p10(g: Given) -> DataFrame:
    return books.filter_purchases(g.portfolio, "resell", "held").select("item_id", "lot_id")


@query("u9_savings_backfill", f"""
  with v as (select * from v_valuations qualify row_number() over (partition by lot_id order by computed_at desc, valuation_id desc) = 1),
  j as (select p.*, retail_price, comp_value, comp_value > 0 and comp_count >= 3 as comps, savings is null and value_basis = 'none' as todo
    from v_portfolio p join v_lots l using (lot_id) left join v using (lot_id)),
  k as (select *, case when comps then comp_value when retail_price > 0 then retail_price * 0.7::double end as ref,
    case when comps and retail_price <= comp_value * 2.5 then 'retail_verified' when comps then 'comps' when retail_price > 0 then 'retail_stated' else 'none' end as basis from j)
  select item_id, lot_id, case when todo then basis else value_basis end as value_basis, {r2(f'case when todo then ref - {_SPENT} else savings end')} as savings from k""")
def u9(g: Given) -> DataFrame:
    out = books.backfill_savings(g.portfolio, g.lots, g.valuations)
    return out.select("item_id", "lot_id", "value_basis", h("savings").alias("savings"))


@query("u10_purchase_add", f"""
  with v as (select * from v_valuations qualify row_number() over (partition by lot_id order by computed_at desc, valuation_id desc) = 1),
  b as (select lot_id, suggested_max_bid as hammer, case when status = 'confirmed' then 'personal' else '' end as given from v_queue),
  j as (select b.*, {_CAT_TEXT} as x, projected_profit, {o.bp_rate()} as bp from b join v_lots using (lot_id) left join v using (lot_id))
  select lot_id, {r2(o.landed('hammer', 'bp'))} as landed_cost, case when given <> '' then given else purpose end as purpose,
    case when given = '' then sub_category end as sub_category, given <> '' as purpose_locked
  from (select *, {categorise_sql('x', 'projected_profit')} from j)""")
def u10(g: Given) -> DataFrame:
    by_hand = F.when(F.col("status") == "confirmed", "personal").otherwise("")
    bought = g.queue.select("lot_id", F.col("suggested_max_bid").alias("hammer_price"), by_hand.alias("purpose"))
    out = books.add_purchases(bought, g.lots, g.valuations)
    return out.select("lot_id", h("landed_cost").alias("landed_cost"), "purpose", "sub_category", "purpose_locked")


@query("u5_commitments_from_decisions", f"""
  with d as (select lot_id, arg_max({{'v': max_bid}}, decided_at) filter (where action = 'confirm') as mbs, max(decided_at) filter (where action = 'confirm') as c,
      arg_max(action, decided_at) filter (where action in ('confirm', 'won', 'lost')) as last,
      arg_max({{'v': hammer_price}}, decided_at) filter (where action = 'won') as hs from v_decisions group by 1)
  select lot_id, {r2('mb2')} as max_bid, {r2(o.landed('mb2', 'bp'))} as landed_at_max, case when last = 'confirm' then 'leading' else last end as status,
    {r2('coalesce(nullif(hs.v, 0), mb2)')} as hammer_price
  from (select d.*, coalesce(mbs.v, suggested_max_bid) as mb2, {o.bp_rate()} as bp from d join v_lots using (lot_id) left join v_queue using (lot_id) where c is not null)""")
def u5(g: Given) -> DataFrame:
    out = books.commitments_from_decisions(g.decisions, g.lots, g.queue)
    return out.select("lot_id", h("max_bid").alias("max_bid"), h("landed_at_max").alias("landed_at_max"), "status", h("hammer_price").alias("hammer_price"))


