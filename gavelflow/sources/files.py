"""Comps from files: price sheets, feeds, marketplace answers; landed beforehand, no network."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from gavelflow import lexicon as lx
from gavelflow.functions import money, text
from gavelflow.operators.splitting import pin


def sheet_rows(raw: DataFrame) -> DataFrame:
    """Price-sheet rows with loose headers: names trimmed and lowered, byte-order mark dropped,
    rows without title or readable price left out, other columns ignored."""
    rows = raw.toDF(*[c.strip().lower().replace("﻿", "") for c in raw.columns])

    def col(name: str) -> Column:
        return F.nullif(F.trim(F.col(name).cast("string")), F.lit("")) if name in rows.columns else F.lit(None).cast("string")

    def number(name: str) -> Column:
        return F.trim(F.replace(F.replace(col(name), F.lit("$")), F.lit(","))).try_cast("double")

    keep = ["comp_id"] if "comp_id" in rows.columns else []
    out = rows.select(
        *keep, col("title").alias("title"), number("price").alias("price"), F.coalesce(number("shipping"), F.lit(0.0)).alias("shipping"),
        col("condition").alias("condition"), money.parse_when(col("sold_at")).alias("sold_at"), col("url").alias("url"))
    return out.where(F.col("title").isNotNull() & F.col("price").isNotNull())


def read_sheets(spark: SparkSession, folder: str) -> DataFrame:
    """All ``*.csv`` of a folder. ``comp_id`` orders rows by file and position in it."""
    raw = spark.read.option("header", True).option("pathGlobFilter", "*.csv").csv(folder)
    tagged = raw.select("*", F.concat(F.input_file_name(), F.format_string("#%020d", F.monotonically_increasing_id())).alias("comp_id"))
    return sheet_rows(tagged)


def sheet_import(sheet: DataFrame, as_of: Column) -> DataFrame:
    """Sheet rows as stored comps, keyed by title alone and without a sale date."""
    keyed = pin(sheet, query_key=text.normalize_item_key("title"))
    return keyed.select(
        F.lit("csv").alias("source"), "query_key", "title", "price", "shipping", "condition", F.lit(True).alias("is_sold"),
        F.lit(None).cast("timestamp").alias("sold_at"), as_of.alias("observed_at"), "url")


ITEM = "title string, description string, summary string, content string, link string, pubDate string"


def feed_comps(items: DataFrame) -> DataFrame:
    """Asking prices from feed items (columns of ``ITEM``): the first ``$`` amount of the title,
    else of the body. Items without one are left out."""
    def price(c: Column) -> Column:
        return F.replace(F.regexp_extract(c, lx.PRICE_TEXT, 1), F.lit(",")).try_cast("double")

    title = F.coalesce("title", F.lit(""))
    body = F.concat_ws(" ", "description", "summary", "content")
    out = items.select(
        F.lit("feed").alias("source"), title.alias("title"), F.coalesce(price(title), price(body)).alias("price"),
        F.lit(0.0).alias("shipping"), F.lit(False).alias("is_sold"), money.parse_when("pubDate").alias("sold_at"), F.col("link").alias("url"))
    return out.where(F.col("price") > 0)


def read_feed(spark: SparkSession, path: str, row_tag: str = "item") -> DataFrame:
    """RSS items, or Atom entries with ``row_tag='entry'``."""
    reader = spark.read.format("xml").option("rowTag", row_tag).option("ignoreNamespace", True)
    if row_tag == "entry":
        raw = reader.schema(ITEM.replace("link string", "link struct<_href:string,_VALUE:string>").replace("pubDate", "published")).load(path)
        return feed_comps(raw.withColumn("link", F.coalesce("link._VALUE", "link._href")).withColumn("pubDate", F.lit(None).cast("string")))
    return feed_comps(reader.schema(ITEM).load(path))


_MONEY = "struct<value:string,amount:string>"
_SALE = (
    f"array<struct<title:string,price:{_MONEY},shippingOptions:array<struct<shippingCost:{_MONEY}>>,"
    "condition:string,lastSoldDate:string,itemWebUrl:string>>"
)
MARKETPLACE = f"itemSales {_SALE}, itemSummaries {_SALE}"


def marketplace_comps(answers: DataFrame, sold: bool, json_column: str = "value") -> DataFrame:
    """Comps from marketplace search answers (JSON text): sales or open listings."""
    doc = F.from_json(F.col(json_column), MARKETPLACE)
    filled = F.when(F.size(doc["itemSales"]) > 0, doc["itemSales"]).otherwise(doc["itemSummaries"])
    item = answers.select(F.explode(filled).alias("i"))

    def amount(m: Column) -> Column:
        return F.coalesce(F.nullif(m["value"], F.lit("")), m["amount"]).try_cast("double")

    first_option = F.get(F.col("i.shippingOptions"), F.lit(0))["shippingCost"]
    when = money.parse_when(F.col("i.lastSoldDate")) if sold else F.lit(None).cast("timestamp")
    out = item.select(
        F.lit("ebay_sold" if sold else "ebay").alias("source"), F.col("i.title").alias("title"), amount(F.col("i.price")).alias("price"),
        F.coalesce(amount(first_option), F.lit(0.0)).alias("shipping"), F.col("i.condition").alias("condition"), F.lit(sold).alias("is_sold"),
        when.alias("sold_at"), F.col("i.itemWebUrl").alias("url"))
    return out.where(F.col("price").isNotNull())


def read_evolving(spark: SparkSession, path: str) -> DataFrame:
    """A table written over time with growing schemas, read as their union."""
    return spark.read.option("mergeSchema", True).parquet(path)
