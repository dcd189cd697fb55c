"""A run is in the table once, whenever and wherever it broke off."""

import pytest

from gavelflow.sources import append_once as ao
from gavelflow.sources import sinks
from gavelflow.schemas import COMP
from tests.test_operators import comp, rows_of


class Killed(Exception):
    pass


def kill():
    raise Killed


def test_killed_before_during_and_after_the_commit(spark, tmp_path, monkeypatch):
    table = str(tmp_path / "t")
    rows = spark.createDataFrame([(i, f"x{i}") for i in range(50)], "a long, b string")
    read = lambda: sorted(tuple(r) for r in ao.read_table(spark, table, rows.schema).collect())
    assert read() == [] and ao.clear_attempts(spark, table) == []
    with pytest.raises(Killed):  # files are there, no record
        ao.append_once(rows, table, "r1", before_commit=kill)
    assert read() == [] and not ao.is_committed(spark, table, "r1")
    commit = ao._commit
    monkeypatch.setattr(ao, "_commit", lambda *a: kill())
    with pytest.raises(Killed):
        ao.append_once(rows, table, "r1")
    assert read() == []
    monkeypatch.setattr(ao, "_commit", commit)
    assert ao.append_once(rows, table, "r1")
    want = sorted((*r, "r1") for r in rows.collect())
    assert read() == want
    assert not ao.append_once(rows, table, "r1") and read() == want  # killed after the record: the repeat adds nothing
    # a second attempt that overtakes the first between its files and its record
    assert not ao.append_once(rows, table, "r2", before_commit=lambda: ao.append_once(rows, table, "r2"))
    assert [r[2] for r in read()] == ["r1", "r2"] * 50
    assert len(ao.clear_attempts(spark, table)) == 3 and len(read()) == 100
    assert {(r.run, r["rows"]) for r in ao.runs(spark, table).collect()} == {("r1", 50), ("r2", 50)}


def test_names_and_empty_runs(spark, tmp_path):
    table = str(tmp_path / "t")
    none = spark.createDataFrame([], "a long")
    assert ao.append_once(none, table, "day=2026-08-09")
    assert ao.read_table(spark, table, none.schema).count() == 0
    for bad in ("", "../x", "a/b", "_r"):
        with pytest.raises(ValueError):
            ao.append_once(none, table, bad)


def test_comps_of_repeated_batches(spark, tmp_path):
    table = str(tmp_path / "comps")
    one = rows_of(spark, COMP, [comp(i, "k", url=f"u{i % 3}") for i in range(6)])
    two = rows_of(spark, COMP, [comp(10 + i, "k", url=f"u{i}") for i in range(6)])
    for batch, run in ((one, "a"), (one, "a"), (two, "b"), (one, "c"), (two, "b")):
        sinks.append_comps_once(batch, table, run)
    got = ao.read_table(spark, table, one.schema)
    assert sorted((r.run, r.comp_id) for r in got.select("run", "comp_id").collect()) == [
        ("a", "c0000"), ("a", "c0001"), ("a", "c0002"), ("b", "c0013"), ("b", "c0014"), ("b", "c0015")]
