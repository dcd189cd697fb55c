"""Registered queries: comps, value, bids, text identity, condition and repair."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gavelflow import lexicon as lx
from gavelflow.catalog import oracle as o
from gavelflow.catalog.given import Given
from gavelflow.catalog.oracle import LONG, P, r2
from gavelflow.catalog.registry import query
from gavelflow.functions import condition, money, text
from gavelflow.operators import comps as oc
from gavelflow.operators import parts
from gavelflow.operators import scopes as sc
from gavelflow.session import shared_dir
from gavelflow.sources import providers, sinks
from gavelflow.sources.append_once import read_table


def h(c, digits: int = 2):
    """Rounded for comparison across engines."""
    return money.half_up(F.col(c) if isinstance(c, str) else c, digits)


def part_points(g: Given) -> DataFrame:
    """Every comp as a point of its part, similarity by its line number."""
    return g.comps.withColumn("part", F.split("comp_id", "-")[2]).withColumn(
        "similarity", F.when(F.split("comp_id", "-")[1].cast("int") == 7, 0.4).otherwise(1.0))


POINTS = """(select *, string_split(comp_id, '-')[3] as part,
  case when string_split(comp_id, '-')[2] = '7' then 0.4 else 1.0 end as similarity from v_comps)"""

AGG_COLS = f"""part, {r2('comp_value')} as comp_value, cast(comp_count as bigint) as comp_count, {r2('spread', 4)} as spread,
  median_age_days, sources"""


def show_aggregate(df: DataFrame) -> DataFrame:
    return df.select(
        "part", h("comp_value").alias("comp_value"), "comp_count", h("spread", 4).alias("spread"), "median_age_days",
        F.array_join("sources", ",").alias("sources"))


@query("a1_comp_aggregate", f"select {AGG_COLS} from ({o.comp_aggregate(POINTS, 'part', LONG)})")
def a1(g: Given) -> DataFrame:
    return show_aggregate(oc.aggregate_comps(part_points(g), ["part"], g.as_of, LONG))


@query("a1_comp_aggregate_default_window", f"select {AGG_COLS} from ({o.comp_aggregate(POINTS, 'part', P)})")
def a1_default(g: Given) -> DataFrame:
    return show_aggregate(oc.aggregate_comps(part_points(g), ["part"], g.as_of, P))


@query("a2_weighted_median", """
  select l_partkey as part, min(case when cum * 2 >= tot then unit end) as weighted_median, cast(max(n) as bigint) as n
  from (select *, sum(w) over (partition by l_partkey order by unit, line_id) as cum, sum(w) over (partition by l_partkey) as tot,
      count(*) over (partition by l_partkey) as n
    from (select l_partkey, line_id, unit, cast(l_quantity as decimal(18, 9)) as w from v_lines)) group by 1""")
def a2(g: Given) -> DataFrame:
    out = oc.weighted_median(g.lines, ["l_partkey"], "unit", "l_quantity", ["line_id"], LONG, [F.substring("line_id", 1, 6)])
    return out.withColumnRenamed("l_partkey", "part")


# --- value and bid of every item ----------------------------------------------------------------
_C = o.confidence("comp_value", "comp_count", "spread", "median_age_days", "sources")
VALUED = f"""
  with agg as ({o.comp_aggregate(POINTS, 'part', LONG)}),
  c as (select *, {_C['score']} as score, {_C['level']} as level, {_C['bump']} as bump from agg),
  n as (select c.*, category, greatest(0.0, comp_value - ((comp_value + ship) * 0.1325 + 0.4) - ship - 2.5) as net
    from (select c.*, category, {o.shipping('cast(null as double)', 'category')} as ship from c join v_parts on part = cast(p_partkey as varchar)) c),
  b as (select *, {o.max_bid('net', '(least(0.95, 0.4::double + bump))', '0.15::double')} as bid from n),
  r as (select *, net - {o.landed('bid', '0.15::double')} as profit, {o.landed('bid', '0.15::double')} as landed from b)"""


@query("f20_confidence", VALUED + f" select part, level, {r2('score', 4)} as score, {r2('bump', 4)} as margin_bump from r")
def f20(g: Given) -> DataFrame:
    agg = oc.aggregate_comps(part_points(g), ["part"], g.as_of, LONG)
    conf = money.score_confidence(*[F.col(c) for c in ("comp_value", "comp_count", "spread", "median_age_days", "sources")], P)
    return agg.withColumn("c", conf).select(
        "part", F.col("c.level").alias("level"), h("c.score", 4).alias("score"), h("c.margin_bump", 4).alias("margin_bump"))


@query("o1_walk_away_ranking", VALUED + f"""
  select part, {r2('comp_value')} as comp_value, level, {r2('net')} as net_resale, bid as walk_away_max_bid, {r2('profit')} as projected_profit,
    {r2('rank', 4)} as rank_score
  from (select *, case when landed <= 0 then 0.0 else profit / landed * case level when 'high' then 1.0 when 'medium' then 0.8 when 'low' then 0.55 else 0.2 end end as rank from r)""")
def o1_walk_away(g: Given) -> DataFrame:
    agg = oc.aggregate_comps(part_points(g), ["part"], g.as_of, LONG)
    conf = money.score_confidence(*[F.col(c) for c in ("comp_value", "comp_count", "spread", "median_age_days", "sources")], P)
    category = g.parts.select(F.col("p_partkey").cast("string").alias("part"), "category")
    rows = agg.withColumn("c", conf).join(category, "part")
    rows = rows.withColumn("net", money.net_proceeds(F.col("comp_value"), F.lit("ebay"), F.col("category"))["net"])
    margin, bp = F.least(F.lit(0.95), F.lit(P.target_margin) + F.col("c.margin_bump")), F.lit(P.premium_rate)
    rows = rows.withColumn("bid", money.walk_away_max_bid(F.col("net"), margin, bp, P.tax_rate))
    rows = rows.withColumn("landed", money.landed_cost(F.col("bid"), bp, P.tax_rate))
    rows = rows.withColumn("profit", F.col("net") - F.col("landed")).withColumn(
        "rank", money.rank_score(F.col("profit"), F.col("landed"), F.col("c.level")))
    best = rows.orderBy(F.desc("rank"), "part")
    return best.select(
        "part", h("comp_value").alias("comp_value"), F.col("c.level").alias("level"), h("net").alias("net_resale"),
        F.col("bid").alias("walk_away_max_bid"), h("profit").alias("projected_profit"), h("rank", 4).alias("rank_score"))


_CH = "case l_linenumber % 6 when 0 then 'ebay' when 1 then 'local' when 2 then 'fb_shipped' when 3 then 'OfferUp' when 4 then 'mercari' else 'flea' end"
_WT = "case when l_suppkey % 4 <> 0 then l_quantity * 1.3 end"


@query("f12_resale_net", f"""
  select line_id, {r2('fees', 4)} as fees, ship as shipping, {r2('greatest(0.0, unit - fees - ship - pack - 3.5 - 0.25 * 25.0)', 4)} as net
  from (select *, (unit + ship) * rate + fixed as fees from (select *, case when ships then est else 0.0 end as ship
    from (select line_id, unit, {o.channel(_CH, 0)} as rate, {o.channel(_CH, 1)} as fixed, {o.channel(_CH, 2)} as ships, {o.channel(_CH, 3)} as pack,
      {o.shipping(f'({_WT})', 'category')} as est from v_lines)))""")
def f12(g: Given) -> DataFrame:
    rows = g.lines.withColumn("n", money.net_proceeds(
        F.col("unit"), F.expr(_CH), F.col("category"), F.expr(f"cast({_WT} as double)"), F.lit(3.5), F.lit(0.25)))
    return rows.select("line_id", h("n.fees", 4).alias("fees"), F.col("n.shipping").alias("shipping"), h("n.net", 4).alias("net"))


_BP = "cast(case l_linenumber % 3 when 0 then null when 1 then 0.0 else 0.12 end as double)"


@query("f13_bid_solver", f"""
  select line_id, bid as max_bid, {r2(o.landed('bid', 'bp'), 4)} as landed, {r2('net - ' + o.landed('bid', 'bp'), 4)} as profit,
    {r2('case when net <= 0 then 0.0 else (net - ' + o.landed('unit', 'bp') + ') / net end', 4)} as margin_at_unit
  from (select *, {o.max_bid('net', 'margin', 'bp')} as bid
    from (select line_id, unit, unit / 3 - 20 as net, {o.bp_rate(_BP)} as bp, l_discount + 0.35::double as margin from v_lines))""")
def f13(g: Given) -> DataFrame:
    rows = g.lines.select(
        "line_id", "unit", (F.col("unit") / 3 - 20).alias("net"),
        money.positive_or(F.expr(_BP), P.premium_rate).alias("bp"), (F.col("l_discount") + F.lit(0.35)).alias("margin"))
    net, bp = F.col("net"), F.col("bp")
    rows = rows.withColumn("bid", money.walk_away_max_bid(net, F.col("margin"), bp, P.tax_rate))
    bid = F.col("bid")
    return rows.select(
        "line_id", bid.alias("max_bid"), h(money.landed_cost(bid, bp, P.tax_rate), 4).alias("landed"),
        h(money.profit_at(bid, net, bp, P.tax_rate), 4).alias("profit"),
        h(money.margin_at(F.col("unit"), net, bp, P.tax_rate), 4).alias("margin_at_unit"))


@query("f21_recency_weight", f"""
  select l_partkey as part, {r2(f"sum(cast({o.recency('sold_at', 45.0)} as decimal(18, 9)))", 4)} as weight
  from (select l_partkey, case when l_suppkey % 17 <> 0 then shipdate end as sold_at from v_lines) group by 1""")
def f21(g: Given) -> DataFrame:
    sold = F.when(F.col("l_suppkey") % 17 != 0, F.col("shipdate"))
    w = F.sum(money.recency_weight(sold, g.as_of, P.half_life_days).cast("decimal(18,9)")).cast("double")
    return g.lines.groupBy(F.col("l_partkey").alias("part")).agg(h(w, 4).alias("weight"))


# --- text identity ------------------------------------------------------------------------------
def _doc_tokens(extra: str) -> str:
    return f"select doc_id, {extra} from (select doc_id, {o.tokens(o.fold('text'))} as t from documents)"


@query("f1_tokenize", _doc_tokens("cast(len(t) as bigint) as n_tokens, md5(array_to_string(t, ' ')) as digest"))
def f1(g: Given) -> DataFrame:
    t = text.tokenize("text")
    return g.table("documents").select("doc_id", F.size(t).cast("long").alias("n_tokens"), F.md5(F.array_join(t, " ")).alias("digest"))


@query("f2_significant_tokens", _doc_tokens(f"array_to_string({o.sig('t', 6)}, ' ') as words"))
def f2(g: Given) -> DataFrame:
    return g.table("documents").select("doc_id", F.array_join(text.significant_tokens("text", 6), " ").alias("words"))


@query("f3_model_numbers", _doc_tokens(f"array_to_string({o.sorted_models(o.models('t'))}, ' ') as models"))
def f3(g: Given) -> DataFrame:
    return g.table("documents").select("doc_id", F.array_join(text.extract_model_numbers("text"), " ").alias("models"))


@query("f4_item_key", "select lot_id, item_key from o_lots")
def f4(g: Given) -> DataFrame:
    return g.lots.select("lot_id", text.normalize_item_key("title", "brand", "model", "upc").alias("item_key"))


@query("f5_key_family", f"select query_key, {o.family('query_key')} as family from v_lines")
def f5(g: Given) -> DataFrame:
    return g.lines.select("query_key", text.key_family("query_key").alias("family"))


@query("f6_search_query", f"""
  select lot_id, array_to_string(q, ' ') as query, 'https://www.amazon.com/s?k=' || replace(array_to_string(q, ' '), ' ', '+') as url
  from (select lot_id, list_concat(lead, list_filter(words, lambda w: not list_contains(lead, w)))[1:5] as q
    from (select lot_id, words, list_filter([nullif(btok, ''), top], lambda x: x is not null) as lead
      from (select *, coalesce({o.sorted_models(o.models(o.tokens(o.fold_plain('model'))))}[1],
        {o.sorted_models(o.models(o.tokens(o.fold_plain('title'))))}[1]) as top from o_lots)))""")
def f6(g: Given) -> DataFrame:
    rows = g.lots.select("lot_id", text.search_query("title", "brand", "model").alias("query"))
    return rows.withColumn("url", text.search_url("amazon", "query"))


@query("f7_title_similarity", f"""
  select c.comp_id, {r2(o.similarity('a.tm', 'a.tw', 'b.tm', 'b.tw'), 4)} as similarity
  from v_comps c join v_lots l on l.lot_id = string_split(c.comp_id, '-')[3]
  join o_titles a on a.t = l.title join o_titles b on b.t = c.title""")
def f7(g: Given) -> DataFrame:
    lots = g.lots.select("lot_id", text.title_features("title").alias("a"))
    comps = g.comps.select("comp_id", F.split("comp_id", "-")[2].alias("lot_id"), text.title_features("title").alias("b"))
    return comps.join(lots, "lot_id").select("comp_id", h(text.feature_similarity(F.col("a"), F.col("b")), 4).alias("similarity"))


@query("f22_pack_count", f"""
  select job_id, position, cast(case when n between 2 and 24 then n else 1 end as int) as pack
  from (select job_id, position, try_cast(regexp_extract(lower(title), {o.lit(lx.MULTIPACK)}, 1) as int) as n from v_cards)""")
def f22(g: Given) -> DataFrame:
    return g.cards.select("job_id", "position", text.multipack_count("title").alias("pack"))


# --- comps lookups --------------------------------------------------------------------------------
def identity(g: Given) -> DataFrame:
    return oc.with_identity(g.lots)


_SCOPE = """case tier when 1 then 'k|' || item_key when 2 then 'f|' || family else 'b|' || brand_key end"""


@query("j2_tiered_comp_lookup", f"""
  select t.item_key, cast(t.tier as int) as tier, {_SCOPE} as scope, comp_id, coalesce(n, 0) as comps, price_sum
  from (select item_key, family, brand_key, tier from o_tiers) t
  left join (select item_key as k, comp_id, count(*) over (partition by item_key) as n,
    {r2('(sum(cast(price as decimal(18, 4))) over (partition by item_key))::double')} as price_sum from o_house_rows) r on k = t.item_key""")
def j2(g: Given) -> DataFrame:
    """Every comp of every item, the scope it draws on, and what all its comps come to; an item without comps
    keeps a row."""
    asked = sc.lookup_scopes(identity(g), g.comps)
    members = sc.house_members(asked, g.comps)
    summed = members.groupBy("scope").agg(h(F.sum(F.col("price").cast("decimal(18,4)")).cast("double")).alias("price_sum"))
    listed = members.select("scope", "comp_id")
    return asked.join(summed, "scope", "left").join(listed, "scope", "left").select("item_key", "tier", "scope", "comp_id", "comps", "price_sum")


@query("j2_scope_members", f"""
  select distinct {_SCOPE} as scope, comp_id from o_house_rows r join (select item_key, family, brand_key from o_tiers) t using (item_key)""")
def j2_members(g: Given) -> DataFrame:
    return sc.house_members(sc.lookup_scopes(identity(g), g.comps), g.comps).select("scope", "comp_id")


@query("j2_newest_forty", "select item_key, cast(tier as int) as tier, comp_id from n_house_rows")
def j2_newest(g: Given) -> DataFrame:
    return oc.house_comps(identity(g), g.comps, P.with_(comps_limit=o.NEWEST)).select("item_key", "tier", "comp_id")


@query("s9_stored_comps", "select item_key, comp_id, source from o_stored_rows")
def s9(g: Given) -> DataFrame:
    return oc.stored_comps(identity(g), g.comps).select("item_key", "comp_id", "source")


@query("s9_newest_forty", "select item_key, comp_id, source from n_stored_rows")
def s9_newest(g: Given) -> DataFrame:
    return oc.stored_comps(identity(g), g.comps, P.with_(comps_limit=o.NEWEST)).select("item_key", "comp_id", "source")


@query("j3_fuzzy_title_pairs", f"""
  select a, b, {r2('s', 4)} as similarity from (select a.t as a, b.t as b, {o.similarity('a.tm', 'a.tw', 'b.tm', 'b.tw')} as s
    from o_titles a, o_titles b where a.t in (select title from v_lots) and b.t in (select title from v_comps where source = 'csv'))
  where s >= 0.45""")
def j3(g: Given) -> DataFrame:
    pairs = oc.similar_titles(g.lots, g.comps.where("source = 'csv'"), P.min_similarity)
    return pairs.select("a", "b", h("similarity", 4).alias("similarity"))


@query("s6_price_sheet_comps", f"""
  with sheet as (select c.*, {o.family('key')} as row_family from (select c.*, tm, tw,
      case when len(tm) > 0 then 'm:' || {o.sorted_models('tm')}[1] when len(w5) > 0 then 't:' || array_to_string(list_sort(w5), '-') else 't:unknown' end as key
      from v_comps c join (select *, {o.sig(o.tokens(o.fold_plain('t')), 5)} as w5 from o_titles) on t = c.title where source = 'csv') c),
  pair as (select a.t as ta, b.t as tb, {o.similarity('a.tm', 'a.tw', 'b.tm', 'b.tw')} as s from o_titles a, o_titles b
    where a.t in (select title from v_lots) and b.t in (select title from sheet)),
  asked as (select distinct item_key, family, title from o_lots)
  select item_key, title as asked_title, count(*) as comps, min(comp_id) as first_comp, {r2('sum(cast(price as decimal(18, 4)))')} as price_sum
  from (select a.item_key, a.title, s.comp_id, s.price from asked a join pair on ta = a.title join sheet s on s.title = tb
      where s >= 0.45 or row_family = a.family) group by 1, 2""")
def s6(g: Given) -> DataFrame:
    totals = oc.sheet_totals(identity(g), sheet_rows(g))
    return totals.select("item_key", "asked_title", "comps", "first_comp", h(F.col("price_sum").cast("double")).alias("price_sum"))


@query("s6_first_forty", f"""
  with sheet as (select c.*, {o.family('key')} as row_family from (select c.*, tm, tw,
      case when len(tm) > 0 then 'm:' || {o.sorted_models('tm')}[1] when len(w5) > 0 then 't:' || array_to_string(list_sort(w5), '-') else 't:unknown' end as key
      from v_comps c join (select *, {o.sig(o.tokens(o.fold_plain('t')), 5)} as w5 from o_titles) on t = c.title where source = 'csv') c),
  pair as (select a.t as ta, b.t as tb, {o.similarity('a.tm', 'a.tw', 'b.tm', 'b.tw')} as s from o_titles a, o_titles b
    where a.t in (select title from v_lots) and b.t in (select title from sheet)),
  asked as (select distinct item_key, family, title from o_lots)
  select item_key, title as asked_title, count(*) as comps, min(comp_id) as first_comp, {r2('sum(cast(price as decimal(18, 4)))')} as price_sum
  from (select a.item_key, a.title, s.comp_id, s.price from asked a join pair on ta = a.title join sheet s on s.title = tb
      where s >= 0.45 or row_family = a.family
      qualify row_number() over (partition by a.item_key, a.title order by s.comp_id) <= {o.NEWEST}) group by 1, 2""")
def s6_first(g: Given) -> DataFrame:
    hits = oc.sheet_comps(identity(g), sheet_rows(g), P.with_(comps_limit=o.NEWEST))
    total = F.sum(F.col("price").cast("decimal(18,4)")).cast("double")
    return hits.groupBy("item_key", "asked_title").agg(
        F.count(F.lit(1)).alias("comps"), F.min("comp_id").alias("first_comp"), h(total).alias("price_sum"))


def sheet_rows(g: Given) -> DataFrame:
    return g.comps.where("source = 'csv'").select("comp_id", "title", "price", "shipping", "condition", "sold_at", "url")


@query("u1_comp_union", "select lot_id, count(*) as points, count(distinct source) as sources from o_points group by 1")
def u1(g: Given) -> DataFrame:
    keyed = identity(g)
    scopes, rows = sc.scopes_and_members(keyed, g.comps)
    per_scope = rows.groupBy("scope").agg(F.count(F.lit(1)).alias("points"), F.collect_set("source").alias("sources"))
    per_item = scopes.join(per_scope, "scope").groupBy("item_key").agg(
        F.sum("points").alias("points"), F.size(F.array_distinct(F.flatten(F.collect_list("sources")))).cast("long").alias("sources"))
    return keyed.select("lot_id", "item_key").join(per_item, "item_key").select("lot_id", "points", "sources")


_LATE = "timestamp '1999-01-01 00:00:00'"


@query("s13_comps_append", f"""
  select source, count(*) as appended, count(url) as with_url from (
    select source, url from v_comps where url is null and observed_at >= {_LATE}
    union all select distinct source, url from v_comps b where url is not null and observed_at >= {_LATE}
      and not exists (select 1 from v_comps s where s.observed_at < {_LATE} and s.source = b.source and s.url = b.url)) group by 1""")
def s13(g: Given) -> DataFrame:
    late = F.col("observed_at") >= F.lit("1999-01-01").cast("timestamp")
    fresh = oc.new_comps(g.comps.where(late), g.comps.where(~late))
    return fresh.groupBy("source").agg(F.count(F.lit(1)).alias("appended"), F.count("url").alias("with_url"))


@query("s13_comps_appended_once", f"""
  with late as (select * from v_comps where observed_at >= {_LATE}), early as (select * from v_comps where observed_at < {_LATE}),
  first as (select * from early where url is null union all
    select * from early where url is not null qualify row_number() over (partition by source, url order by observed_at, comp_id) = 1),
  rest as (select * from late where url is null union all
    select * from (select * from late where url is not null qualify row_number() over (partition by source, url order by observed_at, comp_id) = 1) b
      where not exists (select 1 from first f where f.source = b.source and f.url = b.url))
  select run, comp_id, source, query_key, title, price, shipping, is_sold, epoch_us(sold_at) as sold_at, epoch_us(observed_at) as observed_at, url
  from (select 'early' as run, * from first union all select 'late' as run, * from rest)""")
def s13_once(g: Given) -> DataFrame:
    """Two runs into a new table, the second one twice, read back with all columns."""
    late = F.col("observed_at") >= F.lit("1999-01-01").cast("timestamp")
    table = f"{shared_dir(g.spark).rstrip('/')}/gavelflow/comps-{uuid.uuid4().hex}"
    sinks.append_comps_once(g.comps.where(~late), table, "early")
    for _ in range(2):
        sinks.append_comps_once(g.comps.where(late), table, "late")
    rows = read_table(g.spark, table, g.comps.schema)
    return rows.select(
        "run", "comp_id", "source", "query_key", "title", "price", "shipping", "is_sold", F.unix_micros("sold_at").alias("sold_at"),
        F.unix_micros("observed_at").alias("observed_at"), "url")


_ASKED_KEYS = "(select distinct query_key as k from v_comps where exists (select 1 from o_asked a where starts_with(query_key, a.family)))"


def three_sources(g: Given) -> list[providers.CompSource]:
    """Two that answer, one that breaks off while Spark runs it."""
    broken = g.comps.where("source = 'ebay'").withColumn("price", F.when(F.col("is_sold") | F.lit(True), F.raise_error(F.lit("no answer"))).cast("double"))
    return [
        providers.table_source("house", g.comps.where("source = 'house'").drop("condition")), providers.CompSource("ebay", lambda queries: broken),
        providers.table_source("csv", g.comps.where("source = 'csv'").withColumn("extra", F.lit(1)))]


@query("x2_comp_sources", f"""
  select comp_id, source, query_key, price from v_comps join {_ASKED_KEYS} on k = query_key where source in ('house', 'csv')""")
def x2(g: Given) -> DataFrame:
    """Comps of all sources that answered."""
    return providers.gather(three_sources(g), identity(g))[0].select("comp_id", "source", "query_key", "price")


@query("x2_source_report", f"""
  select source, count(*) as rows, false as failed from v_comps join {_ASKED_KEYS} on k = query_key where source in ('house', 'csv') group by 1
  union all select 'ebay', 0, count(*) > 0 from v_comps where source = 'ebay'""")
def x2_report(g: Given) -> DataFrame:
    report = providers.gather(three_sources(g), identity(g))[1]
    return report.select("source", "rows", F.col("error").isNotNull().alias("failed"))


@query("a11_comps_by_source", "select source, count(*) as comps, count(distinct query_key) as distinct_items from v_comps group by 1")
def a11(g: Given) -> DataFrame:
    return oc.comps_by_source(g.comps)


# --- condition and repair ---------------------------------------------------------------------------
def condition_sql(text_expr: str, grade_text: str, extra: str, source: str) -> str:

    cells = []
    for kind, _, patterns in lx.SIGNAL_FAMILIES:
        cells += [f"case when regexp_matches(x, {o.lit(p)}) then '{kind}=' || trim(regexp_extract(x, {o.lit(p)})) end" for p in patterns]
    flags = ", ".join(f"regexp_matches(x, {o.any_of(p)}) as {k}" for k, _, p in lx.SIGNAL_FAMILIES)
    grade = " ".join(f"when regexp_matches(gt, {o.lit(p)}) then {v}" for p, v in lx.GRADES)
    return f"""
      select {extra}, round(greatest(0.05, least(1.0, case when fatal then least(grade, 0.25)
          else grade * case when untested then 0.88::double else 1.0 end * case when cosmetic then 0.94::double else 1.0 end end)), 4) as multiplier,
        array_to_string(list_filter([{', '.join(cells)}], lambda s: s is not null), '|') as signals, fatal, untested, incomplete, cosmetic, x
      from (select *, {flags}, case {grade} else 0.80 end::double as grade
        from (select *, {text_expr} as x, {grade_text} as gt from {source}))"""


def missing_sql(x: str) -> str:

    known = "[" + o.quoted(sorted(lx.PART_PRICES, key=lambda p: -len(p))) + "]"
    found = f"regexp_extract_all({x}, {o.lit(lx.MISSING_PHRASE)}, 1)"
    clean = (
        f"list_transform({found}, lambda m: regexp_replace(trim(regexp_replace(regexp_replace(trim(lower(m)), '\\s+', ' ', 'g'),"
        f" {o.lit(lx.PHRASE_TAIL)}, '')), '[.,;:/\\- ]+$', ''))"
    )
    pick = (
        f"list_transform({clean}, lambda m: coalesce(list_filter({known}, lambda k: contains(m, k))[1],"
        " case when len(m) between 3 and 24 and len(string_split(m, ' ')) <= 3 then m end))"
    )
    return f"list_distinct(list_filter({pick}, lambda m: m is not null))"


_LOT_TEXT = "lower(concat_ws(' ', nullif(title, ''), nullif(condition_name, ''), nullif(condition_notes, ''), nullif(description, '')))"
_LOT_GRADE = "lower(coalesce(condition_name, '') || ' ' || coalesce(title, ''))"
DOC_CONDITION = condition_sql("lower(text)", "lower(' ' || text)", "doc_id", "documents")
_REPORT = "multiplier, signals, fatal as is_fatal, untested as is_untested, incomplete as is_incomplete, cosmetic as is_cosmetic"


def show_report(df: DataFrame, key: str) -> DataFrame:
    said = F.transform("r.signals", lambda s: F.concat(s["kind"], F.lit("="), s["phrase"]))
    return df.select(
        key, F.col("r.multiplier").alias("multiplier"), F.array_join(said, "|").alias("signals"),
        *[F.col(f"r.{c}").alias(c) for c in ("is_fatal", "is_untested", "is_incomplete", "is_cosmetic")])


@query("f9_condition_of_lots", f"select lot_id, {_REPORT} from ({condition_sql(_LOT_TEXT, _LOT_GRADE, 'lot_id', 'v_lots')})")
def f9(g: Given) -> DataFrame:
    report = condition.analyze_condition("title", "condition_name", "condition_notes", "description")
    return show_report(g.lots.withColumn("r", report), "lot_id")


@query("f9_condition_of_documents", f"select doc_id, {_REPORT} from ({DOC_CONDITION})")
def f9_documents(g: Given) -> DataFrame:
    return show_report(g.table("documents").withColumn("r", condition.analyze_condition("text")), "doc_id")


@query("f10_missing_parts", f"""
  select lot_id, case when incomplete then array_to_string(list_sort({missing_sql('x')}), '|') else '' end as parts
  from ({condition_sql(_LOT_TEXT, _LOT_GRADE, 'lot_id', 'v_lots')})""")
def f10(g: Given) -> DataFrame:
    report = condition.analyze_condition("title", "condition_name", "condition_notes", "description")
    return g.lots.select("lot_id", F.array_join(F.array_sort(report["missing_parts"]), "|").alias("parts"))


@query("f10_missing_parts_in_documents", f"select doc_id, array_to_string(list_sort({missing_sql('lower(text)')}), '|') as parts from documents")
def f10_documents(g: Given) -> DataFrame:
    return g.table("documents").select(
        "doc_id", F.array_join(F.array_sort(condition.missing_phrases(F.lower("text"))), "|").alias("parts"))


def quotes_sql() -> str:

    known = "[" + o.quoted(sorted(lx.PART_PRICES, key=lambda p: -len(p))) + "]"
    prices = "map {" + ", ".join(f"'{k}': {v}" for k, v in lx.PART_PRICES.items()) + "}"
    hours = "map {" + ", ".join(f"'{k}': {v}" for k, v in lx.LABOR_HOURS.items()) + "}"
    return f"""
      need as (select lot_id, unnest({missing_sql('x')}) as part from ({condition_sql(_LOT_TEXT, _LOT_GRADE, 'lot_id', 'v_lots')}) where incomplete),
      cat as (select part, price, source from v_part_prices qualify row_number() over (partition by part order by updated_at desc, source) = 1),
      typ as (select *, coalesce({prices}[part], {prices}[list_filter({known}, lambda k: contains(part, k))[1]])::double as typical from need),
      quote as (select lot_id, n.part, coalesce(case when c.source <> 'typical' then c.price end, case when c.source = 'typical' then c.price end, typical) as price,
          coalesce(c.source, case when typical is not null then 'typical' end) as source
        from typ n left join cat c on c.part = n.part),
      timed as (select *, case when price is not null then coalesce({hours}[part], {lx.DEFAULT_LABOR})::double end as hours from quote),
      totals as (select lot_id, coalesce(sum(price), 0) as parts_cost, coalesce(sum(hours), 0) as priced_hours,
        list_sort(list(part) filter (where price is null)) as unpriced from timed group by 1)"""


@query("j11_part_quotes", f"with {quotes_sql()} select lot_id, part, {r2('price')} as price, source, hours from timed")
def j11(g: Given) -> DataFrame:
    report = condition.analyze_condition("title", "condition_name", "condition_notes", "description")
    needs = g.lots.select("lot_id", F.explode(report["missing_parts"]).alias("part"))
    quoted = parts.quote_parts(needs, parts.catalog_provider(g.part_prices))
    return quoted.select("lot_id", "part", h("price").alias("price"), "source", "hours")


@query("x3_parts_provider_order", """
  with l as (select part, count(*) as n from v_listings where price + shipping > 0 group by 1)
  select part, case when part in (select part from v_part_prices where source = 'ebay') then 'ebay' when n % 2 = 0 then 'listings' else 'typical' end as source
  from (select distinct part from v_part_prices where source = 'ebay' union select part from l) left join l using (part)
  where part in (select part from v_part_prices where source = 'ebay') or n % 2 = 0""")
def x3(g: Given) -> DataFrame:
    """Two providers: the catalog's confident rows first, then listings with an even count."""
    first = parts.catalog_provider(g.part_prices.where("source = 'ebay'"), 1)
    found = parts.lower_quartile_prices(g.listings).where("listings % 2 = 0")
    second = found.select("part", "price", F.lit("listings").alias("source"), F.lit(True).alias("confident"),
                          F.lit(2).alias("rank"), F.lit(None).cast("timestamp").alias("updated_at"))
    both = first.unionByName(second)
    needs = both.select(F.lit("all").alias("lot_id"), "part").distinct()
    return parts.quote_parts(needs, both).select("part", "source")


@query("a16_lower_quartile_price", f"""
  select part, {r2('max(case when pos = case when n >= 4 then greatest(n // 4 - 1, 0) else 0 end + 1 then total end)')} as price, max(n) as listings
  from (select part, total, row_number() over (partition by part order by total, listing_id) as pos, count(*) over (partition by part) as n
    from (select *, price + shipping as total from v_listings) where total > 0) group by 1""")
def a16(g: Given) -> DataFrame:
    return parts.lower_quartile_prices(g.listings).select("part", h("price").alias("price"), "listings")


@query("f11_repair_economics", f"""
  with {quotes_sql()},
  c as ({condition_sql(_LOT_TEXT, _LOT_GRADE, 'lot_id, retail_price, current_bid', 'v_lots')}),
  j as (select c.*, coalesce(parts_cost, 0) as pc, coalesce(priced_hours, 0) + {0.35} * len(coalesce(unpriced, [])) as hours, coalesce(unpriced, []) as unpriced,
    current_bid + 50 as value from c left join totals using (lot_id)),
  k as (select *, pc + hours * 25.0 as total, value * 0.94 - pc - hours * 25.0 - value * multiplier as uplift from j)
  select lot_id, {r2('pc')} as parts_cost, {r2('hours', 4)} as labor_hours, not fatal and uplift > 0 as worth,
    {r2('case when fatal then 0.0 else greatest(0.0, uplift) end')} as value_uplift,
    {r2('case when not fatal and total > 0.5 then uplift / total end', 4)} as easy_fix_score,
    case when fatal then 'fatal' when len(unpriced) > 0 then 'unpriced' when uplift > 0 and total > 0.5 and uplift / total >= 2 then 'easy' when uplift > 0 then 'marginal' else 'as is' end as note
  from k""")
def f11(g: Given) -> DataFrame:
    report = condition.analyze_condition("title", "condition_name", "condition_notes", "description")
    rows = g.lots.withColumn("r", report)
    needs = rows.select("lot_id", F.explode("r.missing_parts").alias("part"))
    totals = parts.quote_totals(parts.quote_parts(needs, parts.catalog_provider(g.part_prices)))
    rows = rows.join(totals, "lot_id", "left").na.fill(0.0, ["parts_cost", "priced_hours"])
    rows = rows.withColumn("unpriced", F.coalesce("unpriced", F.array().cast("array<string>")))
    done = condition.assess_repair(
        F.col("current_bid") + 50, F.col("r.multiplier"), F.col("parts_cost"), F.col("priced_hours"), F.col("unpriced"),
        F.col("r.is_fatal"), P.labor_rate)
    note = (
        F.when(F.col("a.notes").startswith("Fatal"), "fatal").when(F.col("a.notes").startswith("Could"), "unpriced")
        .when(F.col("a.notes").startswith("Easy"), "easy").when(F.col("a.notes").startswith("Repair is"), "marginal").otherwise("as is")
    )
    return rows.withColumn("a", done).select(
        "lot_id", h("a.parts_cost").alias("parts_cost"), h("a.labor_hours", 4).alias("labor_hours"), F.col("a.worth").alias("worth"),
        h("a.value_uplift").alias("value_uplift"), h("a.easy_fix_score", 4).alias("easy_fix_score"), note.alias("note"))
