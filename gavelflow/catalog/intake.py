"""Registered queries: payloads, pages, files, redaction, and the streams' results."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gavelflow.catalog.deals import FOLD
from gavelflow.catalog.given import Given
from gavelflow.catalog.oracle import r2
from gavelflow.catalog.pricing import h
from gavelflow.catalog.registry import query
from gavelflow.functions import money
from gavelflow.operators.lots import align_schema
from gavelflow.schemas import LOT
from gavelflow.session import shared_dir
from gavelflow.sources import files, pages, payloads
from gavelflow.streaming import streams

BASE = "https://lots.example"


def payload_texts(g: Given) -> DataFrame:
    """Each lot as nested JSON in which names, depth and money forms vary."""
    price = F.when(F.col("n") % 3 == 0, F.concat(F.lit('"$'), F.format_number("retail_price", 2), F.lit('"'))).when(
        F.col("n") % 3 == 1, F.concat(F.lit('{"amount": '), F.col("retail_price").cast("string"), F.lit("}"))).otherwise(F.col("retail_price").cast("string"))
    value = F.concat(
        F.lit('{"meta": {"lot_id": '), F.col("lot_id"), F.lit(', "token": "abc"}, "view": [{"productName": "'), F.col("title"),
        F.lit('", "pricing": {"retail_price": '), F.coalesce(price, F.lit("null")), F.lit(', "highBid": '), F.col("current_bid").cast("string"),
        F.lit(', "numBids": '), F.col("bid_count").cast("string"), F.lit('}, "buyersPremium": 15, "manufacturer": {"name": "'), F.col("brand"),
        F.lit('"}, "user_id": 7, "endTime": "2001-11-06T10:00:00Z"}]}'))
    return g.lots.withColumn("n", F.col("lot_id").cast("long")).select("lot_id", value.alias("value"))


@query("s1_listing_payloads", f"""
  select lot_id, title, {r2('retail_price')} as retail_price, current_bid, bid_count, 0.15::double as premium, brand,
    epoch_us(timestamp '2001-11-06 10:00:00') as close_at from v_lots""")
def s1(g: Given) -> DataFrame:
    rows = payloads.listings(payload_texts(g).select("value"), BASE)
    return rows.select(
        "lot_id", "title", h("retail_price").alias("retail_price"), "current_bid", "bid_count", F.col("buyers_premium_rate").alias("premium"), "brand",
        F.unix_micros("close_at").alias("close_at"))


@query("x1_deep_find", "select lot_id, cast(bid_count as varchar) as found from v_lots")
def x1(g: Given) -> DataFrame:
    return payloads.deep_find(payload_texts(g), "value", ["bidCount", "num_bids"]).select("lot_id", "found")


@query("s16_redaction", """select lot_id, '<redacted>' as token, '<redacted>' as user_id, title from v_lots""")
def s16(g: Given) -> DataFrame:
    clean = payloads.redact(payload_texts(g), "value")
    return clean.select(
        "lot_id", F.get_json_object("value", "$.meta.token").alias("token"), F.get_json_object("value", "$.view[0].user_id").alias("user_id"),
        F.get_json_object("value", "$.view[0].productName").alias("title"))


def page_texts(g: Given) -> DataFrame:
    """The given pages, and one page per lot: JSON and card, card only, or typed script only."""
    n, bid = F.col("lot_id").cast("long"), F.format_string("%.2f", "current_bid")
    retail = F.when(F.col("retail_price").isNotNull(), F.concat(F.lit("<span>Retail: $"), F.format_string("%.2f", "retail_price"), F.lit("</span>"))).otherwise("")
    card = F.concat(
        F.lit('<div class="card"><a href="/p/'), F.col("lot_id"), F.lit('">'), F.col("title"), F.lit("</a><span>Current Bid: $"), bid, F.lit("</span>"), retail, F.lit("</div>"))
    price = F.coalesce(F.col("retail_price").cast("string"), F.lit("null"))
    poor = F.concat(F.lit('{"id": '), F.col("lot_id"), F.lit(', "title": "'), F.col("title"), F.lit('"}'))
    rich = F.concat(
        F.lit('{"id": '), F.col("lot_id"), F.lit(', "title": "'), F.col("title"), F.lit('", "currentPrice": '), F.col("current_bid").cast("string"),
        F.lit(', "retailPrice": '), price, F.lit("}"))
    context = F.concat(F.lit('<script>window.__remixContext = {"state": {"teaser": '), poor, F.lit(', "lots": ['), rich, F.lit("]}};</script>"))
    typed = F.concat(
        F.lit('<script type="application/ld+json">{"productId": "'), F.col("lot_id"), F.lit('", "name": "'), F.col("title"), F.lit('", "msrp": '), price,
        F.lit(', "bidAmount": '), F.col("current_bid").cast("string"), F.lit("}</script>"))
    body = F.when(n % 3 == 0, F.concat(card, context)).when(n % 3 == 1, card).otherwise(typed)
    made = g.lots.select(
        (n + 1_000_000_000).alias("page_id"), F.when(n % 2 == 0, F.col("lot_id")).alias("requested_id"),
        F.concat(F.lit("<html><body>"), body, F.lit("</body></html>")).alias("html"))
    given = g.table("pages").select("page_id", F.lit(None).cast("string").alias("requested_id"), "html")
    return given.unionByName(made)


_N = "cast(lot_id as bigint)"
_SHOWN = f"lot_id, title, current_bid, {r2('retail_price')} as retail_price"
# a card shows the retail price only where the lot has one; a missing one stays unknown
_CARD = f"select {_SHOWN} from v_lots"


def shown(df: DataFrame) -> DataFrame:
    return df.select("lot_id", "title", "current_bid", h("retail_price").alias("retail_price"))


@query("s2_embedded_json_listings", f"{_CARD} where {_N} % 3 in (0, 2)")
def s2(g: Given) -> DataFrame:
    return shown(pages.embedded_listings(page_texts(g), BASE))


@query("s3_page_cards", f"{_CARD} where {_N} % 3 in (0, 1)")
def s3(g: Given) -> DataFrame:
    # pages asked for by id also yield their body as a card, which is the detail rule (S5)
    return shown(pages.page_cards(page_texts(g).withColumn("requested_id", F.lit(None).cast("string")), BASE))


@query("s4_extraction_fallback", f"select lot_id, title, case when {_N} % 3 = 1 then 'html-dom' else 'embedded-json' end as strategy from v_lots")
def s4(g: Given) -> DataFrame:
    return pages.extract(page_texts(g), BASE).select("lot_id", "title", "strategy")


@query("s5_detail_pages", f"select lot_id, title from v_lots where {_N} % 2 = 0")
def s5(g: Given) -> DataFrame:
    return pages.detail(page_texts(g), BASE).select("lot_id", "title")


@query("a14_extraction_coverage", f"""
  select case when {_N} % 3 = 1 then 'html-dom' else 'embedded-json' end as strategy, count(*) as lots_found, 4 as resolved from v_lots group by 1""")
def a14(g: Given) -> DataFrame:
    out = pages.coverage(pages.extract(page_texts(g), BASE))
    return out.select("strategy", "lots_found", F.size("resolved").alias("resolved"))


@query("a15_richest_duplicate", f"select lot_id, retail_price is not null as has_retail from v_lots where {_N} % 3 in (0, 2)")
def a15(g: Given) -> DataFrame:
    return pages.embedded_listings(page_texts(g), BASE).select("lot_id", F.col("retail_price").isNotNull().alias("has_retail"))


@query("s7_feed_comps", f"""
  select source, {r2('price')} as price, url from (select 'feed' as source, price, comp_id as url from v_comps where is_sold)""")
def s7(g: Given) -> DataFrame:
    """Comps written as feed items; unsold ones name no price."""
    tag = F.when(F.col("is_sold"), F.format_string(" $%.2f", "price")).otherwise("")
    in_title = F.col("shipping") > 0
    items = g.comps.select(
        F.concat(F.col("title"), F.when(in_title, tag).otherwise("")).alias("title"), F.when(~in_title, F.concat(F.lit("asking"), tag)).alias("description"),
        F.lit(None).cast("string").alias("summary"), F.lit(None).cast("string").alias("content"), F.col("comp_id").alias("link"),
        F.lit("Tue, 04 Jan 2000 10:00:00 GMT").alias("pubDate"))
    return files.feed_comps(items).select("source", h("price").alias("price"), "url")


@query("s8_marketplace_comps", f"""
  select source, title, {r2('price')} as price, shipping, epoch_us(sold_at) as sold_at from (
    select 'ebay_sold' as source, title, price, shipping, date_trunc('day', observed_at) as sold_at from v_comps where source = 'ebay_sold'
    union all select 'ebay', title, price, shipping, null from v_comps where source = 'ebay')""")
def s8(g: Given) -> DataFrame:
    def answers(source: str, array: str) -> DataFrame:
        cost = F.struct(F.col("shipping").cast("string").alias("value"))
        item = F.struct(
            "title", F.struct(F.col("price").cast("string").alias("value")).alias("price"), F.array(F.struct(cost.alias("shippingCost"))).alias("shippingOptions"),
            F.date_format("observed_at", "yyyy-MM-dd").alias("lastSoldDate"))
        return g.comps.where(F.col("source") == source).select(F.to_json(F.struct(F.array(item).alias(array))).alias("value"))

    both = files.marketplace_comps(answers("ebay_sold", "itemSales"), True).unionByName(files.marketplace_comps(answers("ebay", "itemSummaries"), False))
    return both.select("source", "title", h("price").alias("price"), "shipping", F.unix_micros("sold_at").alias("sold_at"))


@query("s6_price_sheet_rows", f"select comp_id, title, {r2('price')} as price, shipping from v_comps")
def s6_rows(g: Given) -> DataFrame:
    """Comps as a price sheet with loose headers and money texts."""
    raw = g.comps.select(
        "comp_id", F.col("title").alias(" Title"), F.concat(F.lit("$"), F.format_number("price", 2)).alias("PRICE"),
        F.col("shipping").cast("string").alias("shipping "), F.lit("x").alias("other"))
    return files.sheet_rows(raw).select("comp_id", "title", h("price").alias("price"), "shipping")


@query("f8_value_coercion", f"""
  select line_id, {r2('unit')} as price, {r2('l_tax * 100', 4)} as percent, l_tax as rate, epoch_us(shipdate) as at_iso, epoch_us(shipdate) as at_epoch, epoch_us(shipdate) as at_millis from v_lines""")
def f8(g: Given) -> DataFrame:
    day = F.unix_seconds("shipdate")
    rows = g.lines.select(
        "line_id", "l_tax", F.concat(F.lit("about $"), F.format_number(h("unit"), 2)).alias("p"), F.date_format("shipdate", "yyyy-MM-dd").alias("iso"),
        day.cast("string").alias("sec"), (day * 1000).cast("string").alias("ms"))
    return rows.select(
        "line_id", h(money.parse_money("p")).alias("price"), h(money.parse_percent((F.col("l_tax")).cast("string")) * 100, 4).alias("percent"),
        money.parse_rate(F.col("l_tax").cast("string")).alias("rate"), F.unix_micros(money.parse_when("iso")).alias("at_iso"),
        F.unix_micros(money.parse_when("sec")).alias("at_epoch"), F.unix_micros(money.parse_when("ms")).alias("at_millis"))


@query("s18_schema_evolution", "select lot_id, title, null::varchar as location_zip, null::timestamp as first_seen from v_lots")
def s18(g: Given) -> DataFrame:
    return align_schema(g.lots, LOT).select("lot_id", "title", "location_zip", "first_seen")


# --- streams: the given events as a stream, drained -------------------------------------------------
def event_stream(g: Given) -> DataFrame:
    """v_obs over a stream of the events file."""
    schema = g.table("events").schema
    # one file or a folder of part files; a few files per batch
    raw = g.spark.readStream.schema(schema).option("maxFilesPerTrigger", 16).parquet(f"{g.sf_dir}/[e]vents.parquet")
    raw.createOrReplaceTempView("gavelflow_event_stream")
    sql = g.defs["v_obs"].replace(f"parquet.`{g.sf_dir}/events.parquet`", "gavelflow_event_stream")
    return g.spark.sql(sql)


def _folder(g: Given) -> str:
    return f"{shared_dir(g.spark).rstrip('/')}/stream-{g.spark.sparkContext.applicationId}-{next(_COUNTER)}"


_COUNTER = iter(range(1_000_000))


def drained(g: Given, stream: DataFrame) -> DataFrame:
    folder = _folder(g)
    streams.run_to_end(stream, f"{folder}/out", f"{folder}/checkpoint")
    return g.spark.read.parquet(f"{folder}/out")


@query("t2_change_only_stream", """
  select obs_id, lot_id, current_bid, bid_count from (select *, lag(current_bid) over w as pb, lag(bid_count) over w as pc, row_number() over w as rn
    from v_obs window w as (partition by lot_id order by observed_at, obs_id))
  where rn = 1 or pb is distinct from current_bid or pc is distinct from bid_count""")
def t2(g: Given) -> DataFrame:
    streams.use_rocksdb(g.spark)
    return drained(g, streams.change_only(event_stream(g))).select("obs_id", "lot_id", "current_bid", "bid_count")


@query("t1_lot_state_stream", """
  select lot_id, max(current_bid) as current_bid, max(bid_count) as bid_count, bool_or(is_closed) as is_closed, epoch_us(max(observed_at)) as last_seen
  from v_obs group by 1""")
def t1(g: Given) -> DataFrame:
    folder = _folder(g)
    streams.current_lots(event_stream(g), f"{folder}/state", f"{folder}/checkpoint").awaitTermination()
    state = streams.read_state(g.spark, f"{folder}/state")
    return state.select("lot_id", "current_bid", "bid_count", "is_closed", F.unix_micros("last_seen").alias("last_seen"))


_MARK = "(select max(ts) - to_hours(1) from events)"


@query("t3_close_detection_stream", f"""
  with st as ({FOLD.replace('{obs}', 'v_obs')})
  select lot_id, {r2('case when is_closed then final_price else current_bid end')} as final_price,
    epoch_us(case when is_closed then closed_at else close_at + to_minutes(20) end) as closed_at, not is_closed as inferred
  from st where is_closed or close_at + to_minutes(20) <= {_MARK}""")
def t3(g: Given) -> DataFrame:
    streams.use_rocksdb(g.spark)
    out = drained(g, streams.detect_closes(event_stream(g)))
    return out.select("lot_id", h("final_price").alias("final_price"), F.unix_micros("closed_at").alias("closed_at"), "inferred")


@query("t4_dedupe_stream", "select lot_id, current_bid from v_obs group by 1, 2")
def t4(g: Given) -> DataFrame:
    streams.use_rocksdb(g.spark)
    slim = event_stream(g).select("lot_id", "current_bid", "observed_at")
    return drained(g, streams.once(slim, ["lot_id", "current_bid"], "observed_at", "90 days")).select("lot_id", "current_bid")


