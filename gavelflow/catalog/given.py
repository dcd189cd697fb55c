"""The given tables read as auction data.

Each view is one SQL text that Spark and DuckDB both run, so a query and its oracle start from the
same rows. Views cover whole tables; nothing is sampled.
"""

from __future__ import annotations

import re
from functools import cached_property

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

LOTS_AS_OF = "2001-11-05 00:00:00"
EVENTS_AS_OF = "2024-01-31 00:00:00"


class Dialect:
    """The few spots in which the two engines spell things differently."""

    def __init__(self, sf_dir: str | None = None):
        self.sf_dir = sf_dir

    def table(self, name: str) -> str:
        return name if self.sf_dir is None else f"parquet.`{self.sf_dir}/{name}.parquet`"

    def plus(self, ts: str, seconds: str, micros: str = "0") -> str:
        if self.sf_dir is None:
            return f"make_timestamp(epoch_us({ts}) + cast(({seconds}) as bigint) * 1000000 + ({micros}))"
        return f"timestamp_micros(unix_micros(cast({ts} as timestamp)) + cast(({seconds}) as bigint) * 1000000 + ({micros}))"

    def ts(self, column: str) -> str:
        return column if self.sf_dir is None else f"cast({column} as timestamp)"


def cents(expr: str) -> str:
    return f"(floor(({expr}) * 100 + 0.5) / 100)"


def views(d: Dialect) -> dict[str, str]:
    as_of, ev_as_of = f"timestamp '{LOTS_AS_OF}'", f"timestamp '{EVENTS_AS_OF}'"
    part, lineitem, orders = d.table("part"), d.table("lineitem"), d.table("orders")
    events, supplier, customer = d.table("events"), d.table("supplier"), d.table("customer")
    stem = "concat('XR', lpad(cast(cast(floor(p_partkey / 2) as bigint) as string), 7, '0'))"
    brand_part = "case when length(p_brand) >= 8 then concat('bm:', substr(p_brand, 7), ':') else 'm:' end"
    suffix = "case l_linenumber % 4 when 0 then '' when 1 then 'B' when 2 then 'C' else 'CD' end"
    unit = "l_extendedprice / l_quantity"
    line_id = "concat(cast(l_orderkey as string), '-', cast(l_linenumber as string), '-', cast(l_partkey as string), '-', cast(l_suppkey as string))"
    v = {}
    v["v_parts"] = f"""
      select *, concat({stem}, case when p_partkey % 2 = 1 then 'B' else '' end) as model, {stem} as stem,
        {brand_part} as key_head,
        case p_type when 'ECONOMY' then 'Tools' when 'SMALL' then 'Kitchen' when 'MEDIUM' then 'Electronics'
          when 'PROMO' then null when 'LARGE' then 'Outdoor' else 'Home' end as category
      from {part}"""
    v["v_lots"] = f"""
      select cast(p_partkey as string) as lot_id, concat('https://lots.example/p/', cast(p_partkey as string)) as url,
        case when p_partkey % 3 = 0 then concat(p_name, ' ', lower(p_type)) else concat(p_brand, ' ', model, ' ', p_name) end as title,
        case p_partkey % 9 when 0 then 'Storage bin with lid for kids' when 1 then 'Case of assorted office paper'
          when 2 then 'Cordless drill, no charger' when 3 then 'Toy train set ages 3' when 4 then 'Battery pack and cable'
          when 5 then 'Microwave oven, light scratches' when 6 then null else 'Sturdy and plain' end as description,
        category, p_brand as brand, model,
        case when p_partkey % 50 = 7 then concat('0-12345-', lpad(cast(p_partkey as string), 9, '0')) end as upc,
        case p_partkey % 7 when 0 then 'Like New' when 1 then 'Open Box' when 2 then 'Used' when 3 then 'Damaged'
          when 4 then 'Brand New' when 6 then 'Good' end as condition_name,
        case p_partkey % 8 when 0 then 'Missing lid' when 1 then 'does not power on' when 2 then 'scratches on the side, untested'
          when 3 then 'Missing charger and remote control' when 5 then 'Complete in box' when 6 then 'no battery, worn grip'
          when 7 then 'without the small widget bolt' end as condition_notes,
        case when p_partkey % 11 <> 0 then p_retailprice end as retail_price,
        cast(p_partkey % 400 as double) as current_bid, cast(p_partkey % 23 as int) as bid_count,
        cast(case p_partkey % 5 when 0 then null when 1 then 0.0 when 2 then 0.12 else 0.15 end as double) as buyers_premium_rate,
        case p_partkey % 3 when 0 then 'Philadelphia, PA' when 1 then 'Cherry Hill, NJ' else 'Bensalem, PA' end as location,
        case when p_partkey % 97 <> 0 then {d.plus(as_of, '(p_partkey * 7919 % 2880 - 90) * 60')} end as close_at,
        p_partkey % 13 = 0 as is_closed,
        case when p_partkey % 13 = 0 and p_partkey % 7 <> 0 then {cents('p_retailprice * 0.4')} end as final_price,
        case when p_partkey % 13 = 0 then {d.plus(as_of, '-(p_partkey % 500) * 3600')} end as closed_at,
        {d.plus(as_of, '-(p_partkey % 45) * 60')} as last_seen,
        cast(case when p_partkey % 2 = 0 then 6.0 else 0.4 end as double) as weight_lb
      from v_parts"""
    v["v_lines"] = f"""
      select {line_id} as line_id, l_orderkey, l_partkey, l_suppkey, l_linenumber, l_quantity, l_extendedprice,
        l_discount, l_tax, l_returnflag, l_linestatus, {d.ts('l_shipdate')} as shipdate, {unit} as unit,
        p_name, p_brand, p_type, category, stem, {suffix} as suffix, concat(key_head, lower(stem), lower({suffix})) as query_key
      from {lineitem} join v_parts on l_partkey = p_partkey"""
    line_title = "case when l_linenumber % 3 = 0 then concat(p_name, ' ', lower(p_type)) else concat(p_brand, ' ', stem, suffix, ' ', p_name) end"
    v["v_comps"] = f"""
      select line_id as comp_id,
        case when l_returnflag = 'R' and l_partkey % 10 <> 7 then 'house' when l_returnflag <> 'N' then 'csv'
          when l_suppkey % 2 = 0 then 'ebay' else 'ebay_sold' end as source,
        query_key, {line_title} as title, {cents('unit / 20')} as price,
        cast(case when l_suppkey % 5 = 0 then 5.0 else 0.0 end as double) as shipping, cast(null as string) as condition,
        l_linestatus = 'F' as is_sold, case when l_suppkey % 17 <> 0 then shipdate end as sold_at,
        {d.plus('shipdate', '86400')} as observed_at,
        case when l_suppkey % 3 <> 0 then concat('https://c.example/', cast(l_orderkey % 5000 as string), '/', cast(l_partkey as string)) end as url
      from v_lines"""
    v["v_prices"] = f"""
      select line_id as price_id, query_key,
        case l_linenumber % 4 when 0 then 'exact_new' when 1 then 'exact_used' when 2 then 'sub_new' else 'sub_used' end as kind,
        case l_suppkey % 3 when 0 then 'amazon' when 1 then 'walmart' else 'facebook' end as source,
        {line_title} as title, {cents('unit / 4')} as price, cast(case when l_suppkey % 5 = 0 then 5.0 else 0.0 end as double) as shipping,
        case when l_suppkey % 3 <> 0 then concat('https://m.example/', cast(l_orderkey % 5000 as string), '/', cast(l_partkey as string)) end as url,
        l_suppkey % 10 <> 0 as in_stock, case when l_suppkey % 13 <> 0 then l_discount * 20 + 3.05 end as rating,
        cast(l_quantity as int) as review_count, p_brand as brand, cast(1.0 as double) as similarity, shipdate as observed_at
      from v_lines"""
    v["v_obs"] = f"""
      select event_id as obs_id, cast(user_id as string) as lot_id, {d.ts('ts')} as observed_at,
        floor(value / 50) * 50 as current_bid, cast(floor(value / 100) as int) as bid_count,
        {d.plus("timestamp '2024-01-20 00:00:00'", 'user_id * 7200')} as close_at,
        event_type = 'purchase' and value > 150 as is_closed,
        case when event_type = 'purchase' and value > 200 then value end as final_price,
        case when event_type <> 'error' then concat('item UX', lpad(cast(user_id as string), 5, '0'), ' seen ', event_type) end as title,
        case event_type when 'view' then 'Used' when 'click' then 'Open Box' end as condition_name,
        case when event_type = 'signup' then value * 3 end as retail_price,
        concat('https://lots.example/p/', cast(user_id as string)) as url
      from {events}"""
    v["v_signals_in"] = f"""
      select event_id,
        case event_type when 'purchase' then case when event_id % 2 = 0 then 'house_purchase' else 'amazon_order' end
          when 'error' then 'house_return' when 'click' then 'house_watchlist'
          when 'view' then case when event_id % 2 = 0 then 'amazon_cart' else 'amazon_saved' end
          else case when event_id % 2 = 0 then 'alexa_list' else 'manual' end end as source,
        case when event_id % 41 = 0 then ' ' else concat('Acme UX', lpad(cast(user_id as string), 5, '0'),
          case event_id % 3 when 0 then 'B' else '' end, case user_id % 4 when 0 then ' storage bin' when 1 then ' microwave'
          when 2 then ' drill' else ' gadget' end) end as title,
        cast(event_id % 4 as int) as quantity, value as price_paid, 'Acme' as brand, cast(null as string) as category,
        {d.ts('ts')} as occurred_at, case when event_id % 4 <> 0 then concat('e', cast(cast(floor(event_id / 2) as bigint) as string)) end as external_id,
        user_id
      from {events}"""
    v["v_wants"] = f"""
      select c_custkey as want_id, concat(p_name, case c_custkey % 5 when 0 then ' microwave' when 1 then ' screws' when 2 then ' shelf'
          when 3 then ' drill' else '' end) as label,
        concat(key_head, lower(stem)) as query_key,
        case when c_custkey % 3 = 0 then concat(p_brand, ' ', model) when c_custkey % 3 = 1 then concat(p_name, ', ', lower(p_type), ' ', p_name) end as keywords,
        case when c_custkey % 4 = 0 then 'scratch, rusted' end as exclude_terms,
        case when c_custkey % 6 = 0 then 'tools' end as want_category,
        case when c_custkey % 2 = 0 then floor(c_acctbal / 10) end as max_worth_to_me,
        cast(0.5 as double) as target_discount_vs_retail,
        case c_custkey % 4 when 0 then 'consumable' when 1 then 'stockable' when 2 then 'durable_multi' else 'durable_single' end as replenishment,
        c_custkey % 7 = 0 as replenishment_locked,
        case c_custkey % 3 when 0 then 'manual' when 1 then 'amazon_cart' else 'alexa_list' end as source,
        cast(1.0 as double) as priority, c_custkey % 2 = 0 as accept_damaged, c_custkey % 9 <> 0 as active
      from {customer} join v_parts on c_custkey = p_partkey"""
    v["v_order_signals"] = f"""
      select case o_orderkey % 6 when 0 then 'amazon_cart' when 1 then 'alexa_list' when 2 then 'house_purchase' when 3 then 'amazon_saved'
          when 4 then 'house_return' else 'house_watchlist' end as source,
        concat(p_brand, ' ', model, ' ', p_name) as title, cast(1 as int) as quantity, o_totalprice / 1000 as price_paid, p_brand as brand, category,
        {d.ts('o_orderdate')} as occurred_at, concat('o', cast(o_orderkey as string)) as external_id, concat(key_head, lower(model)) as query_key
      from {orders} join v_parts on o_custkey = p_partkey"""
    v["v_commit"] = f"""
      select cast(s_suppkey * 20 as string) as lot_id, cast(10.0 + s_suppkey % 40 as double) as max_bid,
        {cents('cast(10.0 + s_suppkey % 40 as double) * 1.2261875')} as landed_at_max,
        case s_suppkey % 4 when 0 then 'Tools' when 1 then 'kitchen' when 2 then null else 'Electronics' end as category,
        case s_suppkey % 5 when 0 then 'leading' when 1 then 'outbid' when 2 then 'won' when 3 then 'lost' else 'cancelled' end as status
      from {supplier}"""
    v["v_valuations"] = f"""
      select line_id as valuation_id, cast(l_partkey as string) as lot_id, {d.plus('shipdate', 'l_orderkey % 86400')} as computed_at,
        {cents('unit / 10')} as comp_value, cast(l_quantity as int) as comp_count,
        {cents('unit / 40 - 20')} as projected_profit, l_discount * 5 as projected_margin,
        cast(floor(unit / 30) as double) as walk_away_max_bid,
        case l_linenumber % 4 when 0 then 'high' when 1 then 'medium' when 2 then 'low' else 'none' end as confidence,
        l_returnflag <> 'N' as recommended, cast(null as string) as repair_notes, l_linestatus as reason
      from v_lines"""
    v["v_queue"] = f"""
      select cast(p_partkey as string) as lot_id, cast(floor(p_retailprice / 9) as double) as suggested_max_bid,
        {cents('p_retailprice / 13')} as projected_profit, {cents('p_retailprice / 7')} as exposure_if_won,
        cast(p_partkey * 7919 % 1009 as double) / 1000 as rank_score,
        case p_partkey % 6 when 0 then 'confirmed' when 1 then 'skipped' when 2 then 'blocked' when 3 then 'expired' else 'pending' end as status,
        case when p_partkey % 6 = 2 then 'cap' end as block_reason, {as_of} as updated_at
      from {part}"""
    v["v_portfolio"] = f"""
      select l_orderkey * 10 + l_linenumber as item_id, cast(l_partkey as string) as lot_id, {cents('unit / 30')} as hammer_price,
        {cents('unit / 30 * 1.2261875')} as landed_cost, {cents('unit / 100')} as projected_profit,
        cast(case when l_suppkey % 4 = 0 then 7.5 else 0.0 end as double) as repair_spend,
        case when l_returnflag = 'R' then {cents('unit / 20')} end as sold_price, cast(case when l_returnflag = 'R' then 3.25 else 0.0 end as double) as sold_fees,
        case p_type when 'ECONOMY' then 'org_expense' when 'SMALL' then 'resell' when 'MEDIUM' then 'personal' else 'undecided' end as purpose,
        case when p_type = 'ECONOMY' then case l_linenumber % 3 when 0 then 'fixtures' when 1 then 'office' else 'inventory_toys' end end as sub_category,
        l_linenumber = 1 as purpose_locked,
        case when l_linenumber % 2 = 0 then {cents('unit / 15')} end as reference_value,
        case when l_linenumber % 2 = 0 then case l_suppkey % 3 when 0 then 'comps' when 1 then 'retail_verified' else 'retail_stated' end else 'none' end as value_basis,
        case when l_linenumber % 2 = 0 then {cents('unit / 15 - unit / 30 * 1.2261875')} end as savings
      from v_lines"""
    v["v_jobs"] = f"""
      select o_orderkey as job_id, concat(key_head, lower(model)) as query_key,
        case o_orderkey % 3 when 0 then 'amazon' when 1 then 'walmart' else 'facebook' end as site,
        case when o_orderstatus = 'P' then case when o_orderkey % 2 = 0 then 'pending' else 'leased' end
          when o_orderstatus = 'F' then 'done' when o_orderpriority = '1-URGENT' then 'blocked' else 'empty' end as status,
        {d.ts('o_orderdate')} as leased_at, {d.plus('o_orderdate', '600 + o_orderkey % 1000')} as finished_at
      from {orders} join v_parts on o_custkey = p_partkey"""
    v["v_cards"] = f"""
      select l_orderkey as job_id, case l_orderkey % 3 when 0 then 'amazon' when 1 then 'walmart' else 'facebook' end as site,
        cast(l_linenumber as bigint) * 1000000000 + l_partkey * 1000 + l_suppkey % 1000 as position,
        case l_suppkey % 10 when 0 then concat('Sponsored ', x.p_name) when 1 then concat('case for ', o.p_brand, ' ', o.model)
          when 2 then concat(o.p_brand, ' ', o.model, ' ', o.p_name, ' (', cast(l_linenumber as string), '-pack)')
          when 3 then concat('Used ', o.p_brand, ' ', o.model) when 4 then concat(x.p_name, ' ', lower(x.p_type))
          when 5 then concat(o.p_name, ' renewed ', lower(o.p_type)) when 6 then '' when 7 then concat(o.model, ' ', o.p_name)
          else concat(o.p_name, ' deluxe') end as title,
        case when l_suppkey % 19 = 0 then 'n/a' when l_suppkey % 23 = 0 then '-4' else cast({cents('unit / 20')} as string) end as price,
        case when l_suppkey % 7 = 0 then 'Open-box' end as condition, '4.5' as shipping,
        case when l_suppkey % 3 <> 0 then concat('u', cast(l_suppkey % 4 as string)) end as url, true as in_stock,
        '4.2' as rating, '31' as review_count, cast(null as string) as brand,
        case when o.p_partkey % 2 = 0 then concat(o.p_name, ' ', lower(o.p_type)) else concat(o.p_brand, ' ', o.model, ' ', o.p_name) end as lot_title,
        case when o.p_partkey % 4 < 3 then o.p_brand end as lot_brand, case when o.p_partkey % 4 < 2 then o.model end as lot_model
      from v_lines x join {orders} on l_orderkey = o_orderkey join v_parts o on o_custkey = o.p_partkey"""
    v["v_ledger"] = f"""
      select 'deal' as kind, cast(p_partkey as string) as lot_id,
        concat('deal:', cast(p_partkey as string), ':', cast(cast(floor(p_retailprice / 9 / 5) as bigint) as string)) as dedupe_key,
        {d.plus(as_of, '-(p_partkey % 96) * 3600')} as sent_at
      from {part} where p_size % 2 = 0"""
    v["v_links"] = f"""
      select cast(l_suppkey % 6 + 1 as bigint) as watch_id, cast(l_partkey as string) as lot_id
      from {lineitem} group by 1, 2"""
    v["v_earlier"] = f"""
      select cast(l_suppkey % 6 + 1 as bigint) as watch_id, cast(l_partkey as string) as lot_id
      from {lineitem} where l_shipdate < timestamp '1996-01-01' and l_quantity < 10 group by 1, 2"""
    v["v_decisions"] = f"""
      select cast(l_partkey as string) as lot_id,
        case l_linenumber % 5 when 0 then 'skip' when 1 then 'won' when 2 then 'lost' else 'confirm' end as action,
        case when l_linenumber % 5 = 3 then {cents('l_extendedprice / l_quantity / 30')} end as max_bid,
        case when l_suppkey % 2 = 0 then {cents('l_extendedprice / l_quantity / 35')} end as hammer_price,
        {d.plus('l_shipdate', 'l_orderkey', 'l_suppkey * 10 + l_linenumber')} as decided_at
      from {lineitem}"""
    v["v_part_prices"] = f"""
      select case s_suppkey % 6 when 0 then 'lid' when 1 then 'charger' when 2 then 'small widget bolt' when 3 then 'battery' when 4 then 'remote control' else 'filter' end as part,
        case when s_suppkey % 3 = 0 then 'ebay' else 'typical' end as source, {cents('s_acctbal / 500 + 3')} as price,
        {d.plus(as_of, '-s_suppkey * 60')} as updated_at
      from {supplier}"""
    v["v_listings"] = f"""
      select line_id as listing_id, case when l_linenumber % 2 = 0 then p_name else lower(p_type) end as part,
        {cents('unit / 200')} as price, cast(case when l_suppkey % 5 = 0 then 5.0 else 0.0 end as double) as shipping
      from v_lines"""
    v["v_watches"] = f"""
      select cast(watch_id as bigint) as watch_id, name, enabled, keywords, require_all, exclude_terms, categories, conditions, locations, brands,
        cast(min_retail as double) as min_retail, cast(max_retail as double) as max_retail, cast(min_bid as double) as min_current_bid,
        cast(max_bid as double) as max_current_bid, cast(min_disc as double) as min_discount_pct,
        cast(within_min as int) as closes_within_minutes, cast(after_min as int) as closes_after_minutes,
        cast(margin as double) as target_margin, channel as resale_channel, inc as include_damaged, cast(cap as double) as max_repair_cost,
        {d.plus(ev_as_of, 'watch_id * 60')} as created_at
      from (values
        (1, 'bolts', true, 'bolt, gear', null, 'scratch', null, null, null, null, null, null, null, 150, null, null, null, 0.3, null, true, null),
        (2, 'tools', true, null, 'red,small', null, 'tools,kitchen', null, null, null, null, 1050, null, null, null, null, null, null, 'local', null, 15),
        (3, 'phila', true, 'widget', null, 'drill,kids', null, 'used, new', 'philadelphia', null, 950, null, null, null, null, null, null, 0.5, 'mercari', false, null),
        (4, 'cheap', true, null, null, null, null, null, null, '17, #25', null, null, 5, 90, 0.9, null, null, null, null, null, null),
        (5, 'soon', true, '', null, null, null, 'open', null, null, null, null, null, null, null, 240, 30, null, 'offerup', false, null),
        (6, 'off', false, 'ring', null, null, null, null, null, null, null, null, null, null, null, null, null, null, null, null, null)
      ) as t(watch_id, name, enabled, keywords, require_all, exclude_terms, categories, conditions, locations, brands, min_retail, max_retail,
        min_bid, max_bid, min_disc, within_min, after_min, margin, channel, inc, cap)"""
    return v


def with_views(body: str, defs: dict[str, str]) -> str:
    """``body`` preceded by the views it uses, directly or through other views, in order."""
    needed: list[str] = []

    def visit(text: str) -> None:
        for name, sql in defs.items():
            if name not in needed and re.search(rf"\b{name}\b", text):
                visit(sql)
                if name not in needed:
                    needed.append(name)

    visit(body)
    if not needed:
        return body
    ctes = ",\n".join(f"{name} as ({defs[name]})" for name in needed)
    head = body.lstrip()
    if head[:5].lower() == "with ":
        return f"with {ctes},\n{head[5:]}"
    return f"with {ctes}\n{body}"


class Given:
    """Views of one scale-factor folder as DataFrames: ``given.lots``, ``given.comps``, ..."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        spark.conf.set("spark.sql.session.timeZone", "UTC")
        self.spark, self.sf_dir = spark, sf_dir
        self.defs = views(Dialect(sf_dir))

    def __getattr__(self, name: str) -> DataFrame:
        if f"v_{name}" not in self.defs:
            raise AttributeError(name)
        return self.spark.sql(with_views(f"select * from v_{name}", self.defs))

    def table(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.sf_dir}/{name}.parquet")

    @cached_property
    def as_of(self) -> Column:
        return F.lit(LOTS_AS_OF).cast("timestamp")

    @cached_property
    def events_as_of(self) -> Column:
        return F.lit(EVENTS_AS_OF).cast("timestamp")
