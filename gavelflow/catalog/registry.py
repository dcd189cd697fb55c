"""Registered queries with the SQL that must give the same rows."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession

from gavelflow.catalog.given import Dialect, Given, views, with_views
from gavelflow.catalog.oracle import oracle_views
from gavelflow.session import ship_package


@dataclass(frozen=True)
class Entry:
    run: Callable[[Given], DataFrame]
    sql: str | None


ENTRIES: dict[str, Entry] = {}


def query(name: str, sql: str | None = None):
    def register(fn: Callable[[Given], DataFrame]):
        if name in ENTRIES:
            raise ValueError(f"{name} registered twice")
        ENTRIES[name] = Entry(fn, sql)
        return fn

    return register


def load() -> None:
    from gavelflow.catalog import deals, intake, people, pricing  # noqa: F401


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    load()

    def bind(fn):
        def run(spark, sf_dir):
            ship_package(spark)
            return fn(Given(spark, sf_dir))

        return run

    return {name: bind(e.run) for name, e in ENTRIES.items()}


def oracle_sql() -> dict[str, str]:
    load()
    defs = {**views(Dialect()), **oracle_views()}
    return {name: with_views(e.sql, defs) for name, e in ENTRIES.items() if e.sql is not None}
