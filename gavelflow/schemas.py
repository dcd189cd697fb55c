"""Table schemas. Built without a session, so modules can be imported before one exists."""

from __future__ import annotations

from pyspark.sql import types as T

_TYPES = {
    "STRING": T.StringType(), "DOUBLE": T.DoubleType(), "INT": T.IntegerType(), "LONG": T.LongType(),
    "BOOLEAN": T.BooleanType(), "TIMESTAMP": T.TimestampType(), "ARRAY<STRING>": T.ArrayType(T.StringType()),
}


def _schema(columns: str) -> T.StructType:
    pairs = (c.split() for c in columns.split(","))
    return T.StructType([T.StructField(name, _TYPES[kind]) for name, kind in pairs])


LOT = _schema("""
lot_id STRING, url STRING, title STRING, description STRING, category STRING, brand STRING, model STRING,
upc STRING, condition_name STRING, condition_notes STRING, retail_price DOUBLE, current_bid DOUBLE,
bid_count INT, buyers_premium_rate DOUBLE, location STRING, location_zip STRING, open_at TIMESTAMP,
close_at TIMESTAMP, images ARRAY<STRING>, is_closed BOOLEAN, final_price DOUBLE, closed_at TIMESTAMP,
first_seen TIMESTAMP, last_seen TIMESTAMP
""")
# what one read of a listing yields
LISTING = _schema("""
lot_id STRING, url STRING, title STRING, description STRING, category STRING, brand STRING, model STRING,
upc STRING, condition_name STRING, condition_notes STRING, retail_price DOUBLE, current_bid DOUBLE,
bid_count INT, buyers_premium_rate DOUBLE, location STRING, location_zip STRING, open_at TIMESTAMP,
close_at TIMESTAMP, images ARRAY<STRING>, is_closed BOOLEAN, final_price DOUBLE, raw STRING
""")
OBSERVATION = _schema("""
obs_id LONG, lot_id STRING, observed_at TIMESTAMP, current_bid DOUBLE, bid_count INT, close_at TIMESTAMP,
is_closed BOOLEAN, final_price DOUBLE
""")
COMP = _schema("""
comp_id STRING, source STRING, query_key STRING, title STRING, price DOUBLE, shipping DOUBLE,
condition STRING, is_sold BOOLEAN, sold_at TIMESTAMP, observed_at TIMESTAMP, url STRING
""")
PRICE = _schema("""
price_id STRING, query_key STRING, kind STRING, source STRING, title STRING, price DOUBLE, shipping DOUBLE,
url STRING, in_stock BOOLEAN, rating DOUBLE, review_count INT, brand STRING, similarity DOUBLE, observed_at TIMESTAMP
""")
WATCH = _schema("""
watch_id LONG, name STRING, enabled BOOLEAN, keywords STRING, require_all STRING, exclude_terms STRING,
categories STRING, conditions STRING, locations STRING, brands STRING, min_retail DOUBLE, max_retail DOUBLE,
min_current_bid DOUBLE, max_current_bid DOUBLE, min_discount_pct DOUBLE, closes_within_minutes INT,
closes_after_minutes INT, target_margin DOUBLE, resale_channel STRING, include_damaged BOOLEAN,
max_repair_cost DOUBLE, created_at TIMESTAMP
""")
COMMITMENT = _schema("lot_id STRING, max_bid DOUBLE, landed_at_max DOUBLE, category STRING, status STRING")
QUEUE = _schema("""
lot_id STRING, suggested_max_bid DOUBLE, projected_profit DOUBLE, exposure_if_won DOUBLE, rank_score DOUBLE,
status STRING, block_reason STRING, updated_at TIMESTAMP
""")
SIGNAL = _schema("""
source STRING, query_key STRING, title STRING, quantity INT, price_paid DOUBLE, condition STRING, category STRING,
brand STRING, occurred_at TIMESTAMP, external_id STRING
""")
WANT = _schema("""
want_id LONG, label STRING, query_key STRING, keywords STRING, exclude_terms STRING, category STRING,
max_worth_to_me DOUBLE, target_discount_vs_retail DOUBLE, replenishment STRING, replenishment_locked BOOLEAN,
source STRING, priority DOUBLE, accept_damaged BOOLEAN, active BOOLEAN
""")
PORTFOLIO = _schema("""
item_id LONG, lot_id STRING, hammer_price DOUBLE, landed_cost DOUBLE, projected_profit DOUBLE, repair_spend DOUBLE,
sold_price DOUBLE, sold_fees DOUBLE, sold_channel STRING, sold_at TIMESTAMP, purpose STRING, sub_category STRING,
purpose_locked BOOLEAN, reference_value DOUBLE, value_basis STRING, savings DOUBLE
""")
CARD = _schema("""
job_id LONG, site STRING, position INT, title STRING, price STRING, condition STRING, shipping STRING, url STRING,
in_stock BOOLEAN, rating STRING, review_count STRING, brand STRING, lot_title STRING, lot_brand STRING, lot_model STRING
""")
LOOKUP_JOB = _schema("""
job_id LONG, query_key STRING, site STRING, status STRING, leased_at TIMESTAMP, finished_at TIMESTAMP
""")
DECISION = _schema("lot_id STRING, action STRING, max_bid DOUBLE, hammer_price DOUBLE, decided_at TIMESTAMP")
LEDGER = _schema("kind STRING, dedupe_key STRING, lot_id STRING, sent_at TIMESTAMP")
PAGE = _schema("page_id LONG, url STRING, requested_id STRING, html STRING")
