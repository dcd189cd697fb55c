import datetime as dt

import pytest
from pyspark.sql import functions as F

from gavelflow import lexicon as lx
from gavelflow.functions import alerts, books, condition, money, text, wants
from gavelflow.params import Params

L = F.lit
NOW = F.lit("2026-08-09 12:00:00").cast("timestamp")


def test_landed_cost_counts_tax_on_the_premium(value):
    assert value(money.landed_cost(L(100.0), L(0.15), 0.06625)) == pytest.approx(122.61875)


@pytest.mark.parametrize("amount, floored", [
    (0.0, 0), (-3.0, 0), (47.9, 47), (99.99, 99), (103.0, 100), (104.99, 100), (499.0, 495), (507.0, 500), (1013.0, 1000), (1026.0, 1025)])
def test_floor_to_increment(value, amount, floored):
    assert value(money.floor_to_increment(L(amount))) == floored


def test_max_bid_clears_the_margin_and_one_step_more_breaks_it(spark):
    grid = spark.range(5, 3000, 7).select((F.col("id") * 1.0).alias("net")).crossJoin(
        spark.createDataFrame([(0.1,), (0.25,), (0.4,), (0.55,), (0.8,)], "m double"))
    net, m, bp = F.col("net"), F.col("m"), L(0.15)
    bid = money.walk_away_max_bid(net, m, bp, 0.06625)
    rows = grid.withColumn("bid", bid).withColumn("at", money.margin_at(F.col("bid"), net, bp, 0.06625))
    step = money.bid_increment(F.col("bid"))
    rows = rows.withColumn("over", money.margin_at(F.col("bid") + step, net, bp, 0.06625))
    assert rows.where("bid > 0 and at < m - 1e-9").count() == 0
    assert rows.where("over >= m + 1e-9").count() == 0


def test_params_refuse_bad_rates():
    with pytest.raises(ValueError):
        Params(tax_rate=1.2)


@pytest.mark.parametrize("raw, want", [
    ("DeWalt DCD999B 20V MAX XR Hammer Drill", ["dcd999b"]), ("Ryobi (2-Pack) 18V", []), ("Model from 2019", []),
    ("WH-1000XM5 and M18", ["wh-1000xm5", "m18"]), ("12qt bin", [])])
def test_model_numbers(value, raw, want):
    assert value(text.extract_model_numbers(L(raw))) == want


def test_item_keys_and_families(value):
    key = text.normalize_item_key(L("DeWalt DCD999B Drill"), L("DeWalt"), L("DCD999B"))
    assert value(key) == "bm:dewalt:dcd999b"
    assert value(text.key_family(key)) == "bm:dewalt:dcd999"
    assert value(text.normalize_item_key(L("x"), upc=L("0 12345-678905"))) == "upc:012345678905"
    assert value(text.normalize_item_key(L("Dyson V8 Animal"), L("Dyson"), L("V8"))) == "bm:dyson:v8"
    assert value(text.normalize_item_key(L("Plastic Storage Bin"))) == "t:bin-plastic-storage"
    assert value(text.normalize_item_key(L(""))) == "t:unknown"
    assert value(text.key_family(L("upc:12345678ab"))) == "upc:12345678ab"


def test_similarity(value):
    assert value(text.title_similarity(L("DeWalt DCD999B drill"), L("dcd999b kit"))) == 1.0
    assert value(text.title_similarity(L("DeWalt DCD999B drill"), L("DeWalt DCD777 drill"))) == 0.15
    assert value(text.title_similarity(L("steel garden rake"), L("steel garden hoe"))) == pytest.approx(0.5)
    assert value(text.title_similarity(L(""), L("steel"))) == 0.0
    assert value(text.tokenize(L("Crème Brûlée-Set, ½"))) == ["creme", "brulee-set", "12"]


def test_condition_of_fatal_and_incomplete_lots(value):
    dead = value(condition.analyze_condition(L("Samsung fridge"), L("Damaged"), L("Compressor is shot. Does not power on.")))
    assert dead["is_fatal"] and dead["multiplier"] == 0.25
    thin = value(condition.analyze_condition(L("Blender"), L("Like New"), L("Missing lid and the base is fine. Untested. Scratches.")))
    assert thin["missing_parts"] == ["lid"] and thin["multiplier"] == pytest.approx(0.92 * 0.88 * 0.94, abs=1e-4)
    assert {s["kind"] for s in thin["signals"]} == {"cosmetic", "untested", "incomplete"}
    assert not value(condition.analyze_condition(L("molded case"), strict=True))["is_fatal"]


def test_repair_pays_only_when_it_lifts_value(value):
    good = value(condition.assess_repair(L(100.0), L(0.4), L(12.0), L(0.05), F.array().cast("array<string>"), L(False), 25.0))
    assert good["worth"] and good["notes"].startswith("Easy fix")
    assert good["value_uplift"] == pytest.approx(94 - 12 - 1.25 - 40)
    capped = condition.assess_repair(L(100.0), L(0.4), L(12.0), L(0.05), F.array().cast("array<string>"), L(False), 25.0, L(5.0))
    assert not value(capped)["worth"]


def test_channels(value):
    local = value(money.net_proceeds(L(100.0), L("local"), L("Tools")))
    assert local["net"] == 100.0
    ebay = value(money.net_proceeds(L(100.0), L("nowhere"), L("Tools")))
    assert ebay["net"] == pytest.approx(100 - (118 * 0.1325 + 0.4) - 18 - 2.5)
    assert value(money.net_proceeds(L(0.0), L("ebay"), L(None).cast("string")))["net"] == 0.0


def test_confidence_levels(value):
    src = F.array(L("house"), L("csv"))
    high = value(money.score_confidence(L(50.0), L(14), L(0.2), L(20.0), src, Params()))
    assert (high["level"], high["margin_bump"]) == ("high", 0.0)
    none = value(money.score_confidence(L(None).cast("double"), L(0), L(None).cast("double"), L(None).cast("double"), src, Params()))
    assert (none["level"], none["margin_bump"]) == ("none", 0.3)


@pytest.mark.parametrize("title, price, want", [
    ("Box of wood screws", 900.0, "consumable"), ("Cordless drill", 99.0, "durable_multi"), ("Storage shed", 600.0, "durable_multi"),
    ("Microwave", 60.0, "durable_single"), ("Thing", 9.0, "consumable"), ("Thing", 40.0, "stockable"), ("Thing", 300.0, "durable_single")])
def test_replenishment_class(value, title, price, want):
    assert value(wants.infer_class(L(title), price=L(price))) == want


def test_recovery_is_monotone(spark):
    days = spark.range(0, 2000, 50).select(F.col("id").cast("double").alias("d"))
    for floor, half, _, _ in lx.REPLENISHMENT.values():
        got = [r[0] for r in days.select(wants.recovery(L(floor), L(half), F.col("d"))).collect()]
        assert got == sorted(got) and got[-1] <= 1.0


def test_savings_reference(value):
    assert value(books.choose_reference(L(200.0), L(100.0), L(5)))["basis"] == "retail_verified"
    assert value(books.choose_reference(L(500.0), L(100.0), L(5)))["basis"] == "comps"
    assert value(books.choose_reference(L(500.0), L(100.0), L(2)))["reference_value"] == pytest.approx(350)
    assert value(books.choose_reference(L(None).cast("double"), L(None).cast("double"), L(0)))["basis"] == "none"


def test_purposes(value):
    assert value(books.categorise(L("Lego train set")))["sub_category"] == "inventory_toys"
    assert value(books.categorise(L("Steel shelf")))["sub_category"] == "fixtures"
    assert value(books.categorise(L("Widget"), profit=L(40.0)))["purpose"] == "resell"
    assert value(books.categorise(L("Widget"), matched_want=L(True)))["purpose"] == "personal"
    assert value(books.categorise(L("Baggage")))["purpose"] == "undecided"


def test_time_texts_and_keys(value):
    def plus(minutes):
        return NOW + F.expr(f"INTERVAL {minutes} MINUTES")

    assert value(alerts.time_to_close(plus(-5), NOW)) == "closed"
    assert value(alerts.time_to_close(plus(59), NOW)) == "59m"
    assert value(alerts.time_to_close(plus(150), NOW)) == "2h 30m"
    assert value(alerts.time_to_close(plus(1500), NOW)) == "1d 1h"
    assert value(alerts.deal_key(L("7"), L(44.0))) == "deal:7:8"


@pytest.mark.parametrize("raw, want", [("$1,234.00", 1234.0), ("about 12", 12.0), ("none", None), ("-5", 5.0)])
def test_parse_money(value, raw, want):
    assert value(money.parse_money(L(raw))) == want


def test_parse_when(value):
    want = dt.datetime(2026, 8, 1, 18, 0)
    for raw in ("2026-08-01T18:00:00Z", "1785607200", "1785607200000", "Sat, 01 Aug 2026 18:00:00 GMT"):
        assert value(F.date_format(money.parse_when(L(raw)), "yyyy-MM-dd HH:mm")) == want.strftime("%Y-%m-%d %H:%M"), raw
    assert value(money.parse_when(L("soon"))) is None
