"""Comp sources: one that fails leaves the others."""

from pyspark.sql import functions as F

from gavelflow.operators import comps as oc
from gavelflow.operators import reports
from gavelflow.params import Params
from gavelflow.schemas import COMP
from gavelflow.sources.providers import CompSource, gather, table_source
from tests.test_operators import comp, rows_of


def test_a_failing_source_gives_an_error_row(spark):
    lots = spark.createDataFrame([("DeWalt DCD999 drill", "DeWalt", "DCD999", None)], "title string, brand string, model string, upc string")
    rows = rows_of(spark, COMP, [comp(1, "bm:dewalt:dcd999"), comp(2, "bm:dewalt:dcd999b"), comp(3, "bm:sony:x1")])

    def refuses(queries):
        raise ConnectionError("refused\nlong story")

    sources = [
        table_source("own", rows), CompSource("asks", refuses), CompSource("off", refuses, enabled=False),
        CompSource("late", lambda q: rows.withColumn("price", F.raise_error(F.lit("timed out")).cast("double"))),
        CompSource("odd", lambda q: spark.createDataFrame([("9", 5)], "comp_id string, price int")),
        CompSource("bad", lambda q: None), CompSource("none", lambda q: rows.limit(0))]
    comps, report = gather(sources, oc.with_identity(lots))
    assert sorted((r.comp_id, r.source, r.price) for r in comps.collect()) == [("9", "odd", 5.0), ("c0001", "house", 50.0), ("c0002", "house", 50.0)]
    said = {r.source: (r["rows"], r.error) for r in report.collect()}
    assert set(said) == {"own", "asks", "late", "odd", "bad", "none"} and said["own"] == (2, None) and said["none"] == (0, None)
    assert said["asks"] == (0, "ConnectionError: refused") and "\n" not in said["late"][1] and said["bad"][0] == 0 and said["bad"][1]
    assert comps.schema.names == oc.COMP_COLUMNS
    assert gather([], oc.with_identity(lots))[0].count() == 0


def test_category_medians_in_bins_equal_plain_medians(spark):
    rows = [(f"l{i}", "Tools" if i % 3 else None, True, float(i * 7 % 11), 20.0 if i % 4 else None) for i in range(80)]
    lots = spark.createDataFrame(rows, "lot_id string, category string, is_closed boolean, final_price double, retail_price double")
    lots = lots.withColumn("closed_at", F.lit("2026-01-01").cast("timestamp"))
    want = lots.groupBy(F.coalesce("category", F.lit("uncategorized")).alias("category")).agg(
        F.count("*").alias("lots"), F.median("final_price").alias("m"), F.median(F.col("final_price") / F.col("retail_price")).alias("r"))
    want = {r.category: (r.lots, round(r.m, 9), round(r.r, 9)) for r in want.collect()}
    for params in (Params(), Params(heavy_rows=30)):
        got = reports.close_price_by_category(lots, params=params).collect()
        assert {r.category: (r.lots, round(r.median_price, 9), round(r.pct_of_retail, 9)) for r in got} == want
