import json

import pandas as pd
from pyspark.sql import functions as F

from gavelflow.schemas import OBSERVATION
from gavelflow.sources import files, pages, payloads, signals
from gavelflow.streaming import streams

NOW = F.lit("2026-08-09 12:00:00").cast("timestamp")
BASE = "https://lots.example"


def page(spark, html, asked=None):
    return spark.createDataFrame([(1, asked, html)], "page_id long, requested_id string, html string")


CARDS = ('<html><body><article><a href="/p/11">Oak garden chair</a><div>Current Bid $41.00</div><div>Retail $299.00</div></article>'
         '<article><a href="/p/12"><img alt="Steel desk lamp" src="x.jpg"></a><p>$5.00</p><p>$20.00</p></article></body></html>')


def test_cards_split_bid_and_retail(spark):
    got = {r["lot_id"]: r for r in pages.page_cards(page(spark, CARDS), BASE).collect()}
    assert (got["11"]["current_bid"], got["11"]["retail_price"]) == (41.0, 299.0)
    assert (got["12"]["title"], got["12"]["current_bid"], got["12"]["retail_price"]) == ("Steel desk lamp", 5.0, 20.0)


def test_json_wins_over_cards_and_richest_record_is_kept(spark):
    state = {"a": {"id": 11, "title": "Oak chair"}, "lots": [{"id": 11, "title": "Oak chair", "retailPrice": "$1,299.00", "conditionName": {"name": "Used"}}]}
    html = CARDS.replace("</body>", f"<script>window.__APP_STATE__ = {json.dumps(state)};</script></body>")
    got = pages.extract(page(spark, html), BASE).collect()
    assert [(r["strategy"], r["lot_id"], r["retail_price"], r["condition_name"]) for r in got] == [("embedded-json", "11", 1299.0, "Used")]


def test_detail_page_without_self_link(spark):
    html = "<html><body><h1>Blue kettle</h1><p>Current Bid: $12.00</p><p>Retail Price: $30.00</p></body></html>"
    got = pages.detail(page(spark, html, "77"), BASE).first()
    assert (got["lot_id"], got["title"], got["current_bid"], got["retail_price"]) == ("77", "Blue kettle", 12.0, 30.0)


def test_listing_payload(spark):
    body = {"x": {"lotId": 5}, "y": [{"name": "Lamp", "buyersPremium": 15, "endTime": 1785607200, "soldPrice": {"cents": 1250}, "images": [{"url": "a"}, "b"]}]}
    df = spark.createDataFrame([(json.dumps(body),), ("not json",), ('{"id": 3}',)], "value string")
    (got,) = payloads.listings(df, BASE).collect()
    assert got["lot_id"] == "5" and got["buyers_premium_rate"] == 0.15 and got["final_price"] == 12.5 and got["is_closed"]
    assert got["images"] == ["a", "b"] and got["close_at"].year == 2026


def test_redaction(spark):
    df = spark.createDataFrame([(json.dumps({"a": [{"access_token": "x", "b": 1}], "Email": "y"}),)], "value string")
    assert json.loads(payloads.redact(df, "value").first()["value"]) == {"a": [{"access_token": "<redacted>", "b": 1}], "Email": "<redacted>"}


def test_nothing_is_cut_from_payloads(spark):
    deep: object = {"Api_Key": "s3cret", "msrp": 7}
    for _ in range(40):
        deep = [{"level": deep}]
    body = {"id": 1, "title": "x" * 70_000, "photos": [f"u{i}" for i in range(40)], "list": [{"n": i} for i in range(300)] + [{"secret": "s3cret", "highBid": 9}], "deep": deep}
    bad = ["{not json", "[" * 100_000, '{"a": 1} tail', None]
    df = spark.createDataFrame([(json.dumps(body),), *[(b,) for b in bad]], "value string")
    clean = payloads.redact(df, "value").collect()
    assert len(clean) == 5 and "s3cret" not in clean[0]["value"] and len(json.loads(clean[0]["value"])["list"]) == 301
    assert [r["value"] for r in clean[1:]] == [None] * 4 and [r["redaction_error"] is None for r in clean] == [True, False, False, False, True]
    (got,) = payloads.listings(df, BASE).collect()
    assert (got["retail_price"], got["current_bid"], len(got["images"]), len(got["title"])) == (7.0, 9.0, 40, 70_000)
    assert json.loads(got["raw"]) == body
    assert payloads.deep_find(df, "value", ["highbid"]).first()["found"] == "9"
    assert len(payloads.find_listings(spark.createDataFrame([(json.dumps({"lots": [{"id": i, "title": f"lot {i}"} for i in range(120)]}),)], "value string"), "value", [], nested=True).collect()) == 120


def test_odd_pages_do_not_stop_the_job(spark):
    deep = "<html><body>" + "<div>" * 5000 + '<a href="/p/9">Deep garden chair</a> $4.00' + "<p>" * 3000
    rows = [(1, None, deep), (2, None, None), (3, None, "<![bad"), (4, "8", "<h1>no body"), (5, None, CARDS)]
    df = spark.createDataFrame(rows, "page_id long, requested_id string, html string")
    got = sorted((r["page_id"], r["lot_id"], r["current_bid"]) for r in pages.page_cards(df, BASE).collect())
    assert got == [(1, "9", 4.0), (5, "11", 41.0), (5, "12", 5.0)]
    assert {r["page_id"] for r in pages.page_cards(df, BASE, errors=True).collect()} <= {3}
    assert pages.extract(df, BASE).count() == 3


def test_price_sheets(spark, tmp_path):
    (tmp_path / "a.csv").write_text('﻿Title , PRICE,Shipping,extra\nOak chair,"$1,200.50",5,z\n,9,,\nLamp,cheap,,\n', encoding="utf-8")
    (tmp_path / "note.txt").write_text("no")
    (got,) = files.read_sheets(spark, str(tmp_path)).collect()
    assert (got["title"], got["price"], got["shipping"]) == ("Oak chair", 1200.5, 5.0)
    assert files.sheet_import(files.read_sheets(spark, str(tmp_path)), NOW).first()["query_key"] == "t:chair-oak"


def test_feeds(spark, tmp_path):
    rss = tmp_path / "f.xml"
    rss.write_text("<rss><channel><item><title>Lamp $40</title><link>l1</link></item><item><title>Desk</title><description>only $1,100.00</description></item>"
                   "<item><title>Free</title></item></channel></rss>")
    assert sorted(r["price"] for r in files.read_feed(spark, str(rss)).collect()) == [40.0, 1100.0]
    atom = tmp_path / "a.xml"
    atom.write_text('<feed xmlns="http://www.w3.org/2005/Atom"><entry><title>Lamp $7</title><link href="h"/></entry></feed>')
    (got,) = files.read_feed(spark, str(atom), "entry").collect()
    assert (got["price"], got["url"], got["is_sold"]) == (7.0, "h", False)


def test_plain_list(spark, tmp_path):
    p = tmp_path / "list.txt"
    p.write_text("Shopping list\n- 3 boxes of screws\nmilk x2\n• drill $40\n\nhose qty: 4\n")
    got = {r["title"]: (r["quantity"], r["price_paid"]) for r in signals.read_plain_list(spark, str(p), "alexa_list", NOW).collect()}
    assert got == {"boxes of screws": (3, None), "milk": (2, None), "drill": (1, 40.0), "hose": (4, None)}


def test_bad_signal_rows_do_not_stop_the_load(spark):
    df = spark.createDataFrame([("a", "2", "$3.50"), ("b", "many", "1"), ("", "1", "1")], "Name string, quantity string, price string")
    good, bad = signals.loose_records(df, "manual", NOW)
    assert [(r["title"], r["quantity"], r["price_paid"]) for r in good.collect()] == [("a", 2, 3.5), ("", 1, 1.0)]
    assert [r["title"] for r in bad.collect()] == ["b"]


def test_stream_in_several_batches_equals_the_batch_fold(spark, tmp_path):
    times = pd.date_range("2026-08-01", periods=40, freq="7min")
    rows = [(i, str(i % 3), t.to_pydatetime(), float(i * 13 % 29), i % 5, t.to_pydatetime(), i == 30, None) for i, t in enumerate(times)]
    src = str(tmp_path / "in")
    for part in (rows[:15], rows[15:28], rows[28:]):
        spark.createDataFrame(part, OBSERVATION).coalesce(1).write.mode("append").parquet(src)
    stream = spark.readStream.schema(OBSERVATION).option("maxFilesPerTrigger", 1).parquet(src)
    streams.current_lots(stream, str(tmp_path / "state"), str(tmp_path / "cp")).awaitTermination()
    from gavelflow.operators import lots as ol

    want = ol.fold_observations(spark.read.parquet(src))
    cols = ["lot_id", "current_bid", "bid_count", "is_closed", "final_price", "closed_at", "last_seen"]
    got = streams.read_state(spark, str(tmp_path / "state"))
    assert sorted(map(tuple, got.select(*cols).collect())) == sorted(map(tuple, want.select(*cols).collect()))
