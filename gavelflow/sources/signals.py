"""Demand signals from loose records and plain lists."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from gavelflow import lexicon as lx
from gavelflow.functions import money


def _text(rows: DataFrame, *names: str) -> Column:
    """First filled column of several alternatives, as text."""
    found = [F.nullif(F.trim(F.col(n).cast("string")), F.lit("")) for n in names if n in rows.columns]
    return F.coalesce(*found) if found else F.lit(None).cast("string")


def loose_records(rows: DataFrame, source: str | Column, as_of: Column) -> tuple[DataFrame, DataFrame]:
    """(signals, errors) from records whose column names vary in spelling.

    title or name, price or price_paid, date or occurred_at, id or external_id; headers in any
    case. A row with an unreadable quantity goes to the errors and does not stop the load.
    """
    if isinstance(source, str):
        if source not in lx.SOURCE_INTENT:
            raise ValueError(f"unknown source {source!r}; expected one of {sorted(lx.SOURCE_INTENT)}")
        source = F.lit(source)
    rows = rows.toDF(*[c.strip().lower() for c in rows.columns])
    amount = _text(rows, "quantity")
    out = rows.select(
        source.alias("source"), F.coalesce(_text(rows, "title", "name"), F.lit("")).alias("title"),
        F.coalesce(F.nullif(money.parse_price(amount), F.lit(0.0)).cast("int"), F.lit(1)).alias("quantity"),
        money.parse_price(_text(rows, "price", "price_paid")).alias("price_paid"), _text(rows, "condition").alias("condition"),
        _text(rows, "category").alias("category"), _text(rows, "brand").alias("brand"),
        F.coalesce(money.parse_when(_text(rows, "date", "occurred_at")), as_of).alias("occurred_at"),
        _text(rows, "id", "external_id").alias("external_id"), amount.alias("_amount"))
    broken = F.col("_amount").isNotNull() & money.parse_price(F.col("_amount")).isNull()
    errors = out.where(broken).select("source", "title", F.concat(F.lit("bad quantity: "), F.col("_amount")).alias("error"))
    return out.where(~broken).drop("_amount"), errors


def read_signal_csv(spark: SparkSession, path: str, source: str, as_of: Column) -> tuple[DataFrame, DataFrame]:
    rows = spark.read.option("header", True).option("mode", "PERMISSIVE").csv(path)
    return loose_records(rows, source, as_of)


def plain_list(lines: DataFrame, source: str | Column, as_of: Column) -> DataFrame:
    """One item per line (column ``value``): bullets and headings dropped, quantity from ``qty N``
    or ``xN`` or a leading count, an inline ``$`` price, the rest is the title."""
    marker = r"(?i)(?:qty|quantity|x)\s*[:.]?\s*(\d{1,3})\b"
    text = F.regexp_replace(F.trim("value"), r"^[-•*·]+", "")
    rows = lines.withColumn("t", F.trim(text)).where(
        (F.col("t") != "") & ~F.lower("t").isin("shopping list", "to-do", "to do"))
    rows = rows.withColumn("q", F.regexp_extract("t", marker, 1))
    rows = rows.withColumn("t", F.trim(F.regexp_replace("t", marker, "")))
    lead = F.when(F.col("q") == "", F.regexp_extract("t", r"^(\d{1,3})\s+(?=[a-zA-Z])", 1)).otherwise("")
    rows = rows.withColumn("n", lead)
    rows = rows.withColumn("t", F.when(F.col("n") != "", F.trim(F.regexp_replace("t", r"^\d{1,3}\s+", ""))).otherwise(F.col("t")))
    price = F.replace(F.regexp_extract("t", lx.PRICE_TEXT, 1), F.lit(",")).try_cast("double")
    bare = F.regexp_replace(F.regexp_replace("t", lx.PRICE_TEXT, ""), r"^[ \-–—,]+|[ \-–—,]+$", "")
    quantity = F.coalesce(F.nullif(F.col("q"), F.lit("")), F.nullif(F.col("n"), F.lit(""))).try_cast("int")
    kept = [c for c in lines.columns if c != "value"]
    none = F.lit(None).cast("string")
    return rows.select(
        *kept, (F.lit(source) if isinstance(source, str) else source).alias("source"), bare.alias("title"),
        F.coalesce(quantity, F.lit(1)).alias("quantity"), price.alias("price_paid"), none.alias("condition"), none.alias("category"),
        none.alias("brand"), as_of.alias("occurred_at"), none.alias("external_id"),
    ).where("title <> ''")


def read_plain_list(spark: SparkSession, path: str, source: str, as_of: Column) -> DataFrame:
    return plain_list(spark.read.text(path), source, as_of)
