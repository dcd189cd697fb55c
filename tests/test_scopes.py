"""Lookups without a limit: the two ways of valuing an item against one another and against plain rows."""

import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from gavelflow.operators import comps as oc
from gavelflow.operators import scopes, splitting
from gavelflow.params import Params
from gavelflow.schemas import COMP
from tests.test_operators import NOW, T0, comp, rows_of

LOTS = "title string, brand string, model string, upc string"


def many_comps(n, seed=4):
    rng = random.Random(seed)
    keys = ["bm:acme:xr200", "bm:acme:xr200b", "bm:acme:zz100", "bm:bolt:qq300", "t:box-red-steel"]
    titles = ["Acme XR200 drill", "Acme red steel box", "red steel box small", "", None, "steel box lid", "Bolt QQ300"]
    out = []
    for i in range(n):
        row = comp(i, rng.choice(keys), title=rng.choice(titles), price=float(rng.choice([20, 20, 20, 25, 31.5, 40, 80, rng.randint(1, 90)])),
                   source=rng.choice(["house", "house", "csv", "ebay", "ebay_sold"]), days=rng.choice([1, 1, 1, 5, 40, 119, 130]),
                   url=rng.choice([None, f"u{rng.randrange(n)}"]))
        row["is_sold"] = rng.random() < 0.6
        if rng.random() < 0.1:
            row["sold_at"] = None
            row["observed_at"] = T0 - dt.timedelta(days=3, minutes=rng.randrange(3))
        out.append(row)
    return out


ASKED = [
    ("Acme XR200B drill kit", "Acme", "XR200B", None), ("Acme XR200 drill", "Acme", "XR200", None), ("red steel box", "Acme", "YY999", None),
    ("red steel box", "Bolt", "QQ300C", None), ("steel box red", None, None, None), ("nothing like it", "Nobody", None, None),
    ("Acme XR200 drill", "Acme", "XR200", None)]


def shown(df):
    return {(r.item_key, r.title): (round(r.comp_value, 9), r.comp_count, r.spread and round(r.spread, 9), r.median_age_days, tuple(r.sources))
            for r in df.withColumn("median_age_days", F.col("median_age_days").cast("double")).collect()}


def plain(keyed, comps, params):
    """Every (item, comp) pair written out and put in order in one window."""
    rows = oc.house_comps(keyed, comps).unionByName(oc.stored_comps(keyed, comps))
    rows = oc.union_comps([rows], keys=["item_key"])
    rows = keyed.select("item_key", F.col("title").alias("asked")).distinct().join(rows, "item_key")
    exact = (F.col("source") == "house") & (F.col("query_key") == F.col("item_key"))
    from gavelflow.functions import text

    rows = rows.withColumn("similarity", F.when(exact, 1.0).otherwise(text.score_similarity("asked", "title")))
    points = rows.drop("title").withColumnRenamed("asked", "title")
    return oc.aggregate_comps(points, ["item_key", "title"], NOW, params)


@pytest.mark.parametrize("n", [0, 900])
def test_packed_descended_and_plain_values_agree(spark, n):
    comps = rows_of(spark, COMP, many_comps(n)).cache()
    keyed = oc.with_identity(spark.createDataFrame(ASKED, LOTS))
    packed = shown(scopes.comp_values(keyed, comps, NOW))
    assert packed == shown(plain(keyed, comps, Params()))
    # runs of equal values too long for one task, too
    assert packed == shown(scopes.comp_values(keyed, comps, NOW, Params(packed_points=0, heavy_rows=3)))
    assert len(packed) == 0 if n == 0 else len(packed) >= 3


def test_a_hot_key_is_summed_before_it_meets_an_item(spark):
    """Half of all comps on one key: the rows that meet items grow with bins, not with comps."""
    rng = random.Random(1)
    hot = [comp(i, "bm:acme:xr200", price=10.0 + rng.random() * 50) for i in range(3000)]
    comps = rows_of(spark, COMP, hot + many_comps(300)).cache()
    keyed = oc.with_identity(spark.createDataFrame(ASKED, LOTS))
    params = Params(packed_points=500)
    assert shown(scopes.comp_values(keyed, comps, NOW, params)) == shown(plain(keyed, comps, params))
    sizes = scopes.lookup_scopes(keyed, comps)
    assert sizes.count() == keyed.select("item_key").distinct().count()


def test_asks_valued_together_agree_with_plain_rows(spark, monkeypatch):
    """Every ask is valued with the others of its scope in one task, several tasks to a scope."""
    comps = rows_of(spark, COMP, many_comps(400)).cache()
    keyed = oc.with_identity(spark.createDataFrame(ASKED, LOTS))
    seen = []
    monkeypatch.setattr(scopes, "RANKED", 0)
    monkeypatch.setattr(scopes, "FEW_CLASSES", 1)
    monkeypatch.setattr(scopes, "TASK_WORK", 100)
    gathered = scopes.gathered_values
    monkeypatch.setattr(scopes, "gathered_values", lambda dealt, *a: seen.append(dealt.count()) or gathered(dealt, *a))
    assert shown(scopes.comp_values(keyed, comps, NOW)) == shown(plain(keyed, comps, Params()))
    assert seen and seen[0] >= 3


def test_costly_columns_are_dealt_to_as_many_tasks_as_shuffles(spark):
    rows = spark.range(0, 400, 1, 1).withColumnRenamed("id", "lot_id")
    assert splitting.dealt_out(rows, "lot_id").rdd.getNumPartitions() == int(spark.conf.get("spark.sql.shuffle.partitions"))
