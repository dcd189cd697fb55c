"""Comp sources behind one contract, each isolated from the others.

A source has a name and a ``fetch(queries)`` that returns comps for the items asked for (``item_key``,
``family``, ``title``). Its rows are brought to the comp columns and types: columns it lacks are missing values,
columns it has besides are left out, ``source`` is its name unless it sets one. They are written before they
are used, so whatever fails, when the source is asked or when Spark runs what it returned, fails there: the
source then gives an error in the report and no rows, and all others stay.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gavelflow.operators.comps import COMP_COLUMNS, family_matches
from gavelflow.schemas import COMP
from gavelflow.session import written

REPORT = "source string, rows long, error string"


@dataclass(frozen=True)
class CompSource:
    name: str
    fetch: Callable[[DataFrame], DataFrame]
    enabled: bool = True


def table_source(name: str, table: DataFrame) -> CompSource:
    """Stored comps of the families asked for; only their keys are read into the join."""

    def fetch(queries: DataFrame) -> DataFrame:
        keys = family_matches(queries, table).select("query_key").distinct()
        return table.join(keys, "query_key", "left_semi")

    return CompSource(name, fetch)


def _conformed(rows: DataFrame, name: str) -> DataFrame:
    kinds = {f.name: f.dataType for f in COMP.fields}
    made = [(F.col(c) if c in rows.columns else F.lit(None)).cast(kinds[c]).alias(c) for c in COMP_COLUMNS]
    return rows.select(*made).withColumn("source", F.coalesce("source", F.lit(name))).select(*COMP_COLUMNS)


def _said(error: Exception) -> str:
    lines = str(error).strip().splitlines() or [""]
    return f"{type(error).__name__}: {lines[0]}"


def gather(sources: Sequence[CompSource], queries: DataFrame) -> tuple[DataFrame, DataFrame]:
    """All comps of the sources that answered, and ``source, rows, error`` of every enabled source."""
    spark = queries.sparkSession
    parts, report = [], []
    for source in sources:
        if not source.enabled:
            continue
        try:
            rows = written(_conformed(source.fetch(queries), source.name), "source")
            report.append((source.name, rows.count(), None))
            parts.append(rows)
        except Exception as error:  # the contract: any failure is the source's own
            report.append((source.name, 0, _said(error)))
    comps = reduce(DataFrame.unionByName, parts) if parts else spark.createDataFrame([], COMP).select(*COMP_COLUMNS)
    return comps, spark.createDataFrame(report, REPORT)
