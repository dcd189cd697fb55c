"""A small reproducible auction data set for trying the whole flow."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from gavelflow.functions import text
from gavelflow.schemas import LOT

SEED = 20260809
# fixed values: title, brand, model, category, retail, lowest close, highest close, closes
FAMILIES = [
    ("DeWalt DCD999B 20V MAX XR Hammer Drill (Tool Only)", "DeWalt", "DCD999B", "Tools", 299.00, 84.0, 108.0, 16),
    ("Milwaukee 2767-20 M18 FUEL High Torque Impact Wrench", "Milwaukee", "2767-20", "Tools", 349.00, 118.0, 146.0, 15),
    ("Dyson V8 Animal Cordless Stick Vacuum", "Dyson", "V8", "Home", 329.99, 118.0, 152.0, 13),
    ("Sony WH-1000XM5 Wireless Noise Cancelling Headphones", "Sony", "WH-1000XM5", "Electronics", 399.99, 148.0, 182.0, 18),
    ("Ninja BL660 Professional Blender 1100W", "Ninja", "BL660", "Kitchen", 129.99, 28.0, 44.0, 12),
    ("Instant Pot Duo 7-in-1 Electric Pressure Cooker 6qt", "Instant Pot", "Duo60", "Kitchen", 99.95, 26.0, 41.0, 12),
    ("Weber Spirit II E-310 3-Burner Propane Grill", "Weber", "E-310", "Outdoor", 549.00, 182.0, 238.0, 11),
    ("Samsung RF28R7351SG French Door Refrigerator", "Samsung", "RF28R7351SG", "Appliances", 2399.00, 520.0, 780.0, 9),
]
# fixed values: family number (from 0), bid, condition, notes, resale channel
OPEN_LOTS = [
    (0, 12.0, "Open Box", "Box opened, tool appears unused. All accessories present.", "ebay"),
    (0, 46.0, "Used", "Light wear on chuck. Functional.", "ebay"),
    (1, 31.0, "Like New", "Complete in box.", "ebay"),
    (1, 22.0, "Damaged", "Missing battery and charger. Tool itself untested.", "ebay"),
    (2, 19.0, "Like New", "Complete with attachments.", "ebay"),
    (2, 14.0, "Damaged", "Missing filter and one attachment. Motor runs.", "ebay"),
    (3, 38.0, "Like New", "Complete in box with case.", "ebay"),
    (3, 214.0, "Open Box", "Complete.", "ebay"),
    (4, 4.0, "Damaged", "Missing lid. Pitcher, base and blades all included. Untested.", "local"),
    (5, 3.0, "Damaged", "Missing sealing ring and steam rack. Otherwise complete.", "ebay"),
    (6, 55.0, "Open Box", "Assembled, never used. Local pickup only.", "local"),
    (7, 25.0, "Damaged", "Compressor is shot. Does not power on. Cosmetic dents on door.", "local"),
]
ORPHANS = [
    ("Assorted Craft Supplies Mixed Lot", "Home", 64.99, 7.0, "Used", "Contents vary. Untested."),
    ("Unbranded Bluetooth Shower Speaker", "Electronics", 24.99, 2.0, "New", ""),
]


def demo_comps(spark: SparkSession, as_of: Column) -> DataFrame:
    """Closed sales of each family: prices uniform in its band, 1 to 55 days old."""
    families = spark.createDataFrame(
        [(i, *f) for i, f in enumerate(FAMILIES)],
        "family int, title string, brand string, model string, category string, retail double, low double, high double, closes int")
    sales = families.select("*", F.explode(F.expr("sequence(1, closes)")).alias("n"))

    def uniform(salt: str) -> Column:
        return F.pmod(F.xxhash64(F.lit(SEED), F.lit(salt), "family", "n"), F.lit(1_000_000)) / 1_000_000.0

    price = F.round(F.col("low") + (F.col("high") - F.col("low")) * uniform("price"), 2)
    minutes = ((F.lit(1) + 54 * uniform("age")) * 1440).cast("int")
    sold = F.timestamp_micros(F.unix_micros(as_of) - minutes.cast("long") * 60_000_000)
    comp_id = F.concat_ws("-", F.lit("demo"), "family", F.format_string("%03d", "n"))
    return sales.select(
        comp_id.alias("comp_id"), F.lit("house").alias("source"), text.normalize_item_key("title", "brand", "model").alias("query_key"), "title",
        price.alias("price"), F.lit(0.0).alias("shipping"), F.lit("Open Box").alias("condition"), F.lit(True).alias("is_sold"),
        sold.alias("sold_at"), sold.alias("observed_at"), F.concat(F.lit("https://lots.example/p/"), comp_id).alias("url"))


def demo_lots(spark: SparkSession, as_of: Column) -> DataFrame:
    """Fourteen open lots, some of which must be turned down."""
    rows = [(str(700_001 + i), f[0], f[1], f[2], f[3], f[4], bid, cond, notes, channel, 35 + 140 * i)
            for i, (n, bid, cond, notes, channel) in enumerate(OPEN_LOTS) for f in [FAMILIES[n]]]
    rows += [(str(700_101 + i), title, None, None, cat, retail, bid, cond, notes, "ebay", 1800 + 60 * i)
             for i, (title, cat, retail, bid, cond, notes) in enumerate(ORPHANS)]
    lots = spark.createDataFrame(
        rows, "lot_id string, title string, brand string, model string, category string, retail_price double, current_bid double,"
        " condition_name string, condition_notes string, resale_channel string, minutes int")
    close = F.timestamp_micros(F.unix_micros(as_of) + F.col("minutes").cast("long") * 60_000_000)
    lots = lots.withColumn("close_at", close).withColumn("is_closed", F.lit(False)).withColumn(
        "url", F.concat(F.lit("https://lots.example/p/"), "lot_id")).drop("minutes")
    missing = [F.lit(None).cast(f.dataType).alias(f.name) for f in LOT.fields if f.name not in lots.columns]
    return lots.select("*", *missing)
