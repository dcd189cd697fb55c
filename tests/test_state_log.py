"""The lot state as a log: equal to one fold, cheap per batch, safe where a batch breaks off."""

import datetime as dt
import os

import pytest

from gavelflow.operators import lots as ol
from gavelflow.schemas import OBSERVATION
from gavelflow.streaming import state_log as sl

T = dt.datetime(2026, 8, 1)
COLS = ["lot_id", "current_bid", "bid_count", "is_closed", "final_price", "closed_at", "last_seen"]


def observed(lots, start, n):
    return [(i, f"l{i % lots}", T + dt.timedelta(minutes=i), float(i * 13 % 97), i % 7, T + dt.timedelta(days=9), i % 41 == 40, None) for i in range(start, start + n)]


def size(folder):
    return sum(os.path.getsize(os.path.join(d, f)) for d, _, names in os.walk(folder) for f in names if f.endswith(".parquet"))


def shown(df):
    return sorted(tuple(r) for r in df.select(*COLS).collect())


def test_batches_equal_one_fold_and_write_what_they_bring(spark, tmp_path):
    path, rows = str(tmp_path / "state"), []
    assert sl.read_state(spark, path) is None
    wrote, at = [], 0
    for batch_id, n in enumerate([3000, 20, 20, 0, 20, 20, 20, 20]):
        part = observed(2000, at, n)
        rows, at = rows + part, at + n
        before = size(path)
        held = sl.fold_batch(spark.createDataFrame(part, OBSERVATION).coalesce(1), batch_id, path)
        wrote.append(size(path) - before)
        assert len(held["deltas"]) <= 2 * sl.FANOUT
        if batch_id in (0, 4, 7):
            assert shown(sl.read_state(spark, path)) == shown(ol.fold_observations(spark.createDataFrame(rows, OBSERVATION)))
    assert max(wrote[2:]) < wrote[0] / 3  # a small batch does not write the state anew
    gone = sl.clear_state(spark, path, keep=1)
    assert gone and shown(sl.read_state(spark, path)) == shown(ol.fold_observations(spark.createDataFrame(rows, OBSERVATION)))


def test_a_batch_that_breaks_off_leaves_the_state_before_it(spark, tmp_path, monkeypatch):
    path = str(tmp_path / "state")
    one, two = (spark.createDataFrame(observed(5, s, 30), OBSERVATION) for s in (0, 30))
    sl.fold_batch(one, 0, path)
    want = shown(sl.read_state(spark, path))
    put = sl.put_text

    def broken(*args):
        raise RuntimeError("lost between the data and the manifest")

    monkeypatch.setattr(sl, "put_text", broken)
    with pytest.raises(RuntimeError):
        sl.fold_batch(two, 1, path)
    assert shown(sl.read_state(spark, path)) == want
    monkeypatch.setattr(sl, "put_text", put)
    sl.fold_batch(two, 1, path)
    sl.fold_batch(two, 1, path)  # and once more, as a stream may
    assert shown(sl.read_state(spark, path)) == shown(ol.fold_observations(one.unionByName(two)))
    assert sl.clear_state(spark, path, keep=1)
    assert shown(sl.read_state(spark, path)) == shown(ol.fold_observations(one.unionByName(two)))
