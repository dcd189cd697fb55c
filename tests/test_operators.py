import datetime as dt

import pytest
from pyspark.sql import functions as F

from gavelflow.functions import text
from gavelflow.operators import comps as oc
from gavelflow.operators import lots as ol
from gavelflow.operators import market, scopes, splitting, watch
from gavelflow.params import Params
from gavelflow.plans import valuation
from gavelflow.schemas import CARD, COMMITMENT, COMP, LOT, OBSERVATION, PRICE, WATCH
from gavelflow.sources import demo

T0 = dt.datetime(2026, 8, 9, 12, 0)
NOW = F.lit("2026-08-09 12:00:00").cast("timestamp")


def rows_of(spark, schema, rows):
    names = schema.names
    return spark.createDataFrame([tuple(r.get(n) for n in names) for r in rows], schema)


def comp(i, key, title="DeWalt drill", price=50.0, source="house", days=10, url=None, **kw):
    when = T0 - dt.timedelta(days=days)
    return {"comp_id": f"c{i:04d}", "source": source, "query_key": key, "title": title, "price": price, "shipping": 0.0, "is_sold": True,
            "sold_at": when, "observed_at": when, "url": url or f"u{i}", **kw}


@pytest.mark.parametrize("n_exact, tier", [(0, 2), (2, 2), (4, 2), (5, 1), (6, 1)])
def test_tier_choice(spark, n_exact, tier):
    rows = [comp(i, "bm:dewalt:dcd999b") for i in range(n_exact)] + [comp(100 + i, "bm:dewalt:dcd999") for i in range(4)]
    lots = spark.createDataFrame([("DeWalt DCD999B drill", "DeWalt", "DCD999B", None)], "title string, brand string, model string, upc string")
    got = oc.house_comps(oc.with_identity(lots), rows_of(spark, COMP, rows)).collect()
    assert {r["tier"] for r in got} == {tier}
    assert len(got) == (n_exact if tier == 1 else n_exact + 4)


def test_brand_tier_when_everything_else_is_thin(spark):
    rows = [comp(i, "bm:dewalt:xyz100") for i in range(130)]
    lots = spark.createDataFrame([("DeWalt DCD999B drill", "DeWalt", "DCD999B", None)], "title string, brand string, model string, upc string")
    keyed, comps = oc.with_identity(lots), rows_of(spark, COMP, rows)
    got = oc.house_comps(keyed, comps).collect()
    assert {r["tier"] for r in got} == {3} and len(got) == 130
    got = oc.house_comps(keyed, comps, Params(comps_limit=40)).collect()
    assert {r["tier"] for r in got} == {3} and len(got) == 120
    assert [tuple(r) for r in scopes.lookup_scopes(keyed, comps).select("tier", "scope", "comps").collect()] == [(3, "b|dewalt", 130)]


def test_family_matches_equal_a_prefix_scan(spark):
    keys = ["bm:a:xr20", "bm:a:xr200", "bm:a:xr2", "m:xr2b", "t:bin-box", "t:unknown", "upc:12345678", "bm:b:xr20"]
    fams = ["bm:a:xr2", "m:xr2", "t:bin", "upc:12345678", "t:unknown"]
    df = spark.createDataFrame([(k,) for k in keys], "query_key string")
    got = {tuple(r) for r in oc.family_matches(spark.createDataFrame([(f,) for f in fams], "family string"), df).select("family", "query_key").collect()}
    assert got == {(f, k) for f in fams for k in keys if k.startswith(f)}


def test_similar_titles_equal_all_pairs(spark):
    words = ["steel", "garden", "rake", "hose", "lamp", "chair", "oak"]
    titles = [" ".join(words[(i * j) % 7] for j in range(1, 2 + i % 5)) + (f" ab{i % 4}1x" if i % 3 == 0 else "") for i in range(60)]
    df = spark.createDataFrame([(t,) for t in titles], "title string").distinct()
    got = {(r["a"], r["b"]) for r in oc.similar_titles(df, df, 0.45).collect()}
    a, b = df.withColumnRenamed("title", "a"), df.withColumnRenamed("title", "b")
    want = {(r["a"], r["b"]) for r in a.crossJoin(b).where(text.title_similarity("a", "b") >= 0.45).collect()}
    assert got == want and want


def test_titles_of_one_form_are_compared_once(spark, monkeypatch):
    """Many titles that differ in their model number only meet the plain ones as one form."""
    made = [f"steel rake XR{i:05d}" for i in range(300)]
    left = spark.createDataFrame([(t,) for t in ["steel rake", "steel rake oak", "oak lamp"]], "title string")
    right = spark.createDataFrame([(t,) for t in made], "title string")
    forms = []
    written = oc.written
    monkeypatch.setattr(oc, "written", lambda df, what: forms.append(df.select("_m", "_n", "_ws").distinct().count()) or written(df, what) if what == "forms" else written(df, what))
    got = {(r["a"], r["b"], round(r["similarity"], 6)) for r in oc.similar_titles(left, right, 0.45).collect()}
    assert got == {("steel rake", t, round(2 / 3, 6)) for t in made} | {("steel rake oak", t, 0.5) for t in made}
    assert forms[1] == 1


def test_sheet_rows_with_a_limit_equal_those_cut_per_item(spark):
    sheet = [(f"c{i:03d}", ["DeWalt DCD999 drill", "steel rake", "steel rake oak", None, "oak lamp"][i % 5], 10.0 + i) for i in range(120)]
    sheet = spark.createDataFrame([(c, t, p, 0.0, None, None, None) for c, t, p in sheet],
                                  "comp_id string, title string, price double, shipping double, condition string, sold_at timestamp, url string")
    lots = oc.with_identity(spark.createDataFrame(
        [("DeWalt DCD999B drill", None, "DCD999B", None), ("steel rake", None, None, None), ("steel oak rake", None, None, None)], "title string, brand string, model string, upc string"))
    every = oc.sheet_comps(lots, sheet).select("item_key", "asked_title", "comp_id").collect()
    want = {}
    for r in sorted(every, key=lambda r: r["comp_id"]):
        want.setdefault((r["item_key"], r["asked_title"]), []).append(r["comp_id"])
    got = {}
    for r in oc.sheet_comps(lots, sheet, Params(comps_limit=7)).orderBy("comp_id").collect():
        got.setdefault((r["item_key"], r["asked_title"]), []).append(r["comp_id"])
    assert got == {k: v[:7] for k, v in want.items()} and max(map(len, want.values())) > 7
    totals = {(r["item_key"], r["asked_title"]): (r["comps"], r["first_comp"]) for r in oc.sheet_totals(lots, sheet).collect()}
    assert totals == {k: (len(v), v[0]) for k, v in want.items()}


def points(spark, n):
    rows = [comp(i, "k", price=20.0 + (i * 37 % 100) / 3, days=i % 90, source=["house", "ebay", "csv"][i % 3], similarity=1.0) for i in range(n)]
    df = rows_of(spark, COMP, rows)
    return df.withColumn("similarity", F.lit(1.0)).withColumn("is_sold", F.col("source") != "ebay").withColumn("g", F.lit("one"))


@pytest.mark.parametrize("n", [1, 3, 4, 8, 41])
def test_the_three_ways_to_aggregate_agree(spark, n):
    pts = points(spark, n)
    plain = oc.aggregate_comps(pts, ["g"], NOW).first()
    split = oc.aggregate_comps(pts, ["g"], NOW, Params(heavy_rows=1)).first()
    packed = oc.aggregate_packed(pts.groupBy("g").agg(F.collect_list(F.struct(*[c for c in pts.columns if c != "g"])).alias("rows")), NOW).first()
    assert plain == split
    assert packed["sources"] == plain["sources"]
    for name in ("comp_value", "comp_count", "spread", "median_age_days"):
        assert packed[name] == (None if plain[name] is None else pytest.approx(plain[name])), name


def test_one_absurd_price_does_not_move_the_value(spark):
    rows = [comp(i, "k", price=100.0 + i) for i in range(9)] + [comp(99, "k", price=9999.0)]
    df = rows_of(spark, COMP, rows).withColumn("similarity", F.lit(1.0))
    got = oc.aggregate_comps(df, ["query_key"], NOW).first()
    assert 100 <= got["comp_value"] <= 109 and got["comp_count"] == 8


def test_weighted_median_without_weight_is_the_median(spark):
    df = spark.createDataFrame([(1, 10.0, 0.0), (2, 20.0, 0.0), (3, 90.0, 0.0), (4, 40.0, 0.0)], "id int, v double, w double").withColumn("g", F.lit(1))
    assert oc.weighted_median(df, ["g"], "v", "w", ["id"]).first()["weighted_median"] == 30.0


def test_heavy_groups_give_what_plain_ones_give(spark):
    rows = [(g, i, v, 1.0 + i % 3) for g in (*range(300), None) for i, v in enumerate([None, -5.0, 0.0, 2.0, 2.0, 7.5][:4 + (g or 0) % 3])]
    df = spark.createDataFrame(rows, "g int, id int, v double, w double")
    plain = oc.weighted_median(df, ["g"], "v", "w", ["id"]).collect()
    heavy = oc.weighted_median(df, ["g"], "v", "w", ["id"], Params(heavy_rows=1)).collect()  # 301 heavy groups
    assert len(plain) == 301 and sorted(map(repr, plain)) == sorted(map(repr, heavy))


def test_rows_without_a_time_are_kept(spark):
    seen = [obs(1, 0, 10.0), {**obs(2, 5, 11.0), "observed_at": None}, obs(3, 9, 10.0)]
    assert [r["obs_id"] for r in ol.change_only(rows_of(spark, OBSERVATION, seen)).orderBy("obs_id").collect()] == [1, 2]


def test_theta_join_in_slices_gives_the_same_pairs(spark):
    left, small = spark.range(50).withColumnRenamed("id", "a"), spark.range(9).withColumnRenamed("id", "b")
    on = lambda: (F.col("a") % 7) > F.col("b")
    one = splitting.theta_join(left, small, on, "b", 100)
    many = splitting.theta_join(left, small, on, "b", 3)
    assert sorted(map(tuple, one.collect())) == sorted(map(tuple, many.collect()))


def obs(i, minute, bid, count=0, closed=False, final=None, lot="1"):
    return {"obs_id": i, "lot_id": lot, "observed_at": T0 + dt.timedelta(minutes=minute), "current_bid": bid, "bid_count": count,
            "close_at": T0 + dt.timedelta(minutes=600), "is_closed": closed, "final_price": final}


def test_bid_only_rises_and_first_close_fixes_the_price(spark):
    seen = [obs(1, 0, 10.0, 1), obs(2, 5, 40.0, 3), obs(3, 9, 30.0, 2), obs(4, 2000, 30.0, 3, True), obs(5, 2100, 90.0, 9, True, 99.0)]
    got = ol.fold_observations(rows_of(spark, OBSERVATION, seen)).first()
    assert got["current_bid"] == 90.0 and got["bid_count"] == 9 and got["final_price"] == 40.0
    backwards = ol.fold_observations(rows_of(spark, OBSERVATION, seen[::-1])).first()
    assert backwards == got


def test_change_only_across_days(spark):
    seen = [obs(1, 0, 10.0), obs(2, 5, 10.0), obs(3, 1500, 10.0), obs(4, 1510, 12.0), obs(5, 4000, 12.0)]
    assert [r["obs_id"] for r in ol.change_only(rows_of(spark, OBSERVATION, seen)).orderBy("obs_id").collect()] == [1, 4]


def card(i, title, price="50", **kw):
    return {"job_id": 1, "site": "amazon", "position": i, "title": title, "price": price, "url": f"u{i}",
            "lot_title": "DeWalt DCD999B 20V Hammer Drill", "lot_brand": "DeWalt", "lot_model": "DCD999B", **kw}


def test_cards(spark):
    cards = [card(1, "DeWalt DCD999B Hammer Drill"), card(2, "Used DeWalt DCD999B"), card(3, "Battery for DeWalt DCD999B"), card(4, "Sponsored drill"),
             card(5, "DeWalt DCD999B (2-Pack)", "100"), card(6, "Oak chair"), card(7, "Bosch DCD999B clone"), card(8, "DeWalt DCD999B", "x"),
             card(9, "DeWalt DCD999B again", url="u1")]
    rows = market.classify_pages(rows_of(spark, CARD, cards))
    got = {r["position"]: (r["kind"], r["reject_reason"]) for r in rows.collect()}
    assert got[1] == ("exact_new", None) and got[2] == ("exact_used", None) and got[7] == ("sub_new", None)
    assert got[3][1].startswith("accessory") and got[4][1] == "no usable title" and got[8][1] == "no parseable price"
    assert got[6][1].startswith("different product class")
    kept = market.keep_page(rows).collect()
    assert {r["position"] for r in kept} == {1, 2, 5, 7} and next(r["price"] for r in kept if r["position"] == 5) == 50.0


def test_unrated_substitute_never_sets_the_ceiling(spark):
    lots = oc.with_identity(rows_of(spark, LOT, [{"lot_id": "1", "title": "DeWalt DCD999B Drill", "brand": "DeWalt", "model": "DCD999B", "retail_price": 500.0}]))
    price = {"query_key": "bm:dewalt:dcd999b", "source": "amazon", "shipping": 0.0, "in_stock": True, "observed_at": T0 - dt.timedelta(days=2), "similarity": 1.0}
    rows = [{**price, "price_id": "1", "kind": "exact_new", "title": "DeWalt DCD999B", "price": 400.0},
            {**price, "price_id": "2", "kind": "sub_new", "title": "DeWalt DCD999B like", "price": 19.0},
            {**price, "price_id": "3", "kind": "sub_new", "title": "DeWalt drill", "price": 300.0, "rating": 4.5, "review_count": 90},
            {**price, "price_id": "4", "kind": "exact_new", "title": "DeWalt DCD999B", "price": 1.0, "observed_at": T0 - dt.timedelta(days=60)}]
    got = market.market_view(lots, rows_of(spark, PRICE, rows), NOW).first()
    assert got["best_alternative_price"] == 300.0 and got["opportunity_ceiling"] == pytest.approx(210.0)
    assert got["verification"] == "verified" and got["rejected_for_quality"] == 1


def test_watch_reasons(spark):
    lot = {"lot_id": "1", "title": "Red bolt", "category": "Tools", "retail_price": 90.0, "current_bid": 10.0, "is_closed": False}
    watches = rows_of(spark, WATCH, [
        {"watch_id": 1, "keywords": "bolt, gear", "categories": "tool"}, {"watch_id": 2, "require_all": "blue", "exclude_terms": "red", "min_retail": 100.0}])
    pairs = spark.createDataFrame([(1, "1"), (2, "1"), (2, "1"), (9, "1")], "watch_id long, lot_id string")
    said = watch.explain_matches(rows_of(spark, LOT, [lot]), watches, pairs, NOW)
    got = {r["watch_id"]: r["reasons"] for r in said.collect()}
    assert got[1] == []
    assert got[2] == ["missing required term 'blue'", "excluded term 'red' present", "retail below $100"]


def test_demo_verdicts(spark):
    comps, lots = demo.demo_comps(spark, NOW), demo.demo_lots(spark, NOW)
    empty_prices, none = rows_of(spark, PRICE, []), rows_of(spark, COMMITMENT, [])
    assert comps.count() == 106 and lots.count() == 14
    got = {r["lot_id"]: r for r in valuation.value_lots(lots, comps, empty_prices, none, NOW, check_exposure=False).collect()}
    by_bid = {(r["title"].split()[0], r["current_bid"]): r for r in got.values()}
    for title, bid in (("Dyson", 19.0), ("Dyson", 14.0), ("Weber", 55.0)):
        assert by_bid[title, bid]["recommended"], by_bid[title, bid]["reason"]
    assert by_bid["Sony", 214.0]["reason_code"] == "past max" and "bidding at $214.00" in by_bid["Sony", 214.0]["reason"]
    # this one's profit sits at the floor, so the drawn sale prices decide on which side it falls
    assert by_bid["Milwaukee", 22.0]["projected_profit"] < 30
    assert set(by_bid["Milwaukee", 22.0]["missing_parts"]) >= {"battery"}
    fridge = by_bid["Samsung", 25.0]
    assert fridge["walk_away_max_bid"] == 0 and fridge["reason_code"] == "fatal"
    assert not by_bid["Assorted", 7.0]["recommended"] and not by_bid["Unbranded", 2.0]["recommended"]
    assert all(r["landed_at_max"] <= r["net_resale"] for r in got.values())


def test_words_of_a_long_title_decide_its_class(spark):
    from gavelflow.operators import wants

    long = "bulk lot of mixed goods " * 30 + "AA batteries"
    rows = [(long, None, "x1", "amazon_cart", dt.datetime(2026, 1, 1), None, None, 1)]
    signals = spark.createDataFrame(rows, "title string, brand string, external_id string, source string, occurred_at timestamp, category string, price_paid double, quantity int")
    want = wants.create_wants(wants.clean_signals(signals)).first()
    assert len(long) > 512 and want.label == want.keywords == long
    from gavelflow.functions import wants as fw

    classes = signals.select(fw.infer_class(F.col("title"), "category", F.col("price_paid")), fw.infer_class(F.substring("title", 1, 512), "category", F.col("price_paid"))).first()
    assert classes[0] != classes[1] and want.replenishment == classes[0]
