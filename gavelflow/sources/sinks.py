"""Writers: append-only tables, partitioned by day, with idempotent batch paths."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gavelflow.operators.comps import new_comps
from gavelflow.sources.append_once import append_once, is_committed, read_table

VALUATION_COLUMNS = [
    "lot_id", "computed_at", "comp_value", "comp_count", "comp_sources", "comp_spread", "confidence", "damage_signals",
    "missing_parts", "parts_cost", "labor_hours", "easy_fix_score", "repair_notes", "resale_channel", "net_resale",
    "walk_away_max_bid", "landed_at_max", "projected_profit", "projected_margin", "profit_at_current_bid", "recommended",
    "reason", "market_verification", "verified_retail", "best_alternative_price", "best_alternative_note", "opportunity_ceiling",
]


def valuation_rows(valued: DataFrame) -> DataFrame:
    """The stored columns of a valuation run, with its day."""
    return valued.select(*VALUATION_COLUMNS, F.to_date("computed_at").alias("computed_date"))


def append_valuations(valued: DataFrame, path: str) -> None:
    """One more run in the valuation history."""
    append_by_day(valuation_rows(valued), path, "computed_date")


def append_valuations_once(valued: DataFrame, table: str, run: str) -> bool:
    """The same as a named run, which a repeated job does not add again."""
    return append_once(valuation_rows(valued), table, run)


def append_comps_once(batch: DataFrame, table: str, run: str) -> bool:
    """New comps of a batch as a named run: those whose (source, url) no earlier run holds."""
    spark = batch.sparkSession
    if is_committed(spark, table, run):
        return False
    known = read_table(spark, table, batch.schema).drop("run")
    return append_once(new_comps(batch, known), table, run)


def append_alerts_once(ledger: DataFrame, table: str, run: str) -> bool:
    """Ledger rows of announced lots as a named run."""
    return append_once(ledger, table, run)


def append_by_day(rows: DataFrame, path: str, day: str) -> None:
    """Rows of one day are shuffled together first, so a run writes few files per day."""
    rows.repartition(F.col(day), F.pmod(F.xxhash64(rows.columns[0]), F.lit(32))).write.mode("append").partitionBy(day).parquet(path)


def write_batch(rows: DataFrame, path: str, batch_id: int) -> None:
    """Output of one stream batch under its own folder; a repeated batch replaces itself."""
    rows.write.mode("overwrite").parquet(f"{path}/batch={batch_id}")


def send_alerts(rows: DataFrame, ledger_path: str, batch_id: int) -> None:
    """Ledger rows of announced lots; call after the notice went out."""
    write_batch(rows, ledger_path, batch_id)
