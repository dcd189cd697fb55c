import duckdb
import pytest

import __spark_entry__ as entry
from scripts.check import TABLES, rows

SF = "/root/testdata/sf0.001"
FAST = ["a1_comp_aggregate", "f4_item_key", "f9_condition_of_documents", "j2_tiered_comp_lookup", "w1_change_only_snapshots", "w2_lot_state_fold",
        "p8_card_classification", "u4_queue_upsert", "a6_satiation", "s2_embedded_json_listings"]


def test_every_oracle_belongs_to_a_query():
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_flagship_query(spark):
    assert entry.entry(spark).count() > 0


@pytest.mark.parametrize("name", FAST)
def test_query_equals_its_oracle(spark, name):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from '{SF}/{t}.parquet'")
    df = entry.queries()[name](spark, SF)
    got = rows(df.columns, [tuple(r) for r in df.collect()])
    con.execute(entry.oracle_sql()[name])
    assert got == rows([c[0] for c in con.description], con.fetchall())


def test_tiered_lookup_lists_every_comp_of_every_item(spark):
    from types import SimpleNamespace

    from gavelflow.catalog import pricing
    from gavelflow.schemas import COMP
    from tests.test_operators import comp, rows_of

    keys = ["bm:makita:xr1", "bm:makita:xr2", "bm:bosch:q9"]
    lots = spark.createDataFrame([(k, k, k.split(":")[1]) for k in keys], "item_key string, family string, brand_key string")
    comps = rows_of(spark, COMP, [comp(i, keys[0], price=i + 1.0) for i in range(130)] + [comp(200, keys[1], price=7.0), comp(201, keys[1], source="csv")])
    got = pricing.j2(SimpleNamespace(lots=lots, comps=comps)).collect()
    by = {k: [r for r in got if r.item_key == k] for k in keys}
    assert {len(by[k]) for k in keys[:2]} == {130, 131} and len(by[keys[2]]) == 1
    assert len({r.comp_id for r in by[keys[0]]}) == 130 and {r.comp_id for r in by[keys[0]]} < {r.comp_id for r in by[keys[1]]}
    assert {(r.tier, r.scope, r.comps, r.price_sum) for r in by[keys[0]]} == {(1, "k|bm:makita:xr1", 130, 8515.0)}
    assert {(r.tier, r.scope, r.comps, r.price_sum) for r in by[keys[1]]} == {(3, "b|makita", 131, 8522.0)}
    assert [(r.tier, r.comp_id, r.comps, r.price_sum) for r in by[keys[2]]] == [(3, None, 0, None)]
