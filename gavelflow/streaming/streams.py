"""Streams: current lots, change-only bid history, close detection, duplicate suppression."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.streaming.query import StreamingQuery

from gavelflow.operators import lots as ol
from gavelflow.params import Params
from gavelflow.sources.sinks import write_batch
from gavelflow.streaming import state_log
from gavelflow.streaming.state_log import read_state

ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def use_rocksdb(spark: SparkSession) -> None:
    """State larger than memory; set before a stateful query starts."""
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKSDB)


# --- current lots -----------------------------------------------------------------------------------
def current_lots(observations: DataFrame, path: str, checkpoint: str, **trigger) -> StreamingQuery:
    """Keeps the lot state up to date from a stream of observations; see ``state_log`` and ``read_state``."""
    return (
        observations.writeStream.foreachBatch(lambda df, i: state_log.fold_batch(df, i, path))
        .option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start()
    )


# --- change-only history ------------------------------------------------------------------------------
SNAPSHOT = "lot_id string, obs_id long, observed_at timestamp, current_bid double, bid_count int"


class _Changes(StatefulProcessor):
    """Keeps the last (bid, count) per lot and passes on what differs from it."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.last = handle.getValueState("last", "current_bid double, bid_count int")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        batch = pd.concat(list(rows)).sort_values(["observed_at", "obs_id"], na_position="first")
        now = batch[["current_bid", "bid_count"]].astype({"current_bid": "float64", "bid_count": "Int64"})
        before = now.shift()
        seen = self.last.get()
        first = seen is None
        if not first:
            before.iloc[0] = [float("nan") if seen[0] is None else seen[0], pd.NA if seen[1] is None else seen[1]]
        same = (before == now).fillna(False) | (before.isna() & now.isna())
        changed = ~same.all(axis=1).to_numpy()
        if first:
            changed[0] = True
        last = now.iloc[-1]
        self.last.update(tuple(None if pd.isna(x) else kind(x) for x, kind in zip(last, (float, int), strict=True)))
        yield batch[changed].assign(lot_id=key[0])[["lot_id", "obs_id", "observed_at", "current_bid", "bid_count"]]

    def close(self) -> None:
        pass


def change_only(observations: DataFrame) -> DataFrame:
    slim = observations.select("lot_id", "obs_id", "observed_at", "current_bid", "bid_count")
    return slim.groupBy("lot_id").transformWithStateInPandas(
        statefulProcessor=_Changes(), outputStructType=SNAPSHOT, outputMode="Append", timeMode="None")


# --- close detection ------------------------------------------------------------------------------------
CLOSED = "lot_id string, final_price double, closed_at timestamp, inferred boolean"


def _millis(ts: pd.Timestamp) -> int:
    return int(ts.value // 1_000_000)


class _Closes(StatefulProcessor):
    """Highest bid per open lot; a timer at close plus grace closes the lots nobody saw end."""

    def __init__(self, grace_ms: int):
        self.grace_ms = grace_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.lot = handle.getValueState("lot", "bid double, timer long, done boolean")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        bid, timer, done = self.lot.get() or (0.0, 0, False)
        out = []
        if not done:
            batch = pd.concat(list(rows)).sort_values(["observed_at", "obs_id"])
            ended = batch["is_closed"].fillna(False).astype(bool).to_numpy()
            done = bool(ended.any())
            seen = batch.iloc[:ended.argmax() + 1] if done else batch
            bid = max(bid, seen["current_bid"].max(skipna=True)) if seen["current_bid"].notna().any() else bid
            due = seen["close_at"][~seen["is_closed"].fillna(False).astype(bool)].dropna()
            if done:
                price = seen["final_price"].iloc[-1]
                out.append((key[0], bid if pd.isna(price) or price == 0 else float(price), seen["observed_at"].iloc[-1], False))
            moved = 0 if done else _millis(due.iloc[-1]) + self.grace_ms if len(due) else timer
            if moved != timer:
                if timer:
                    self.handle.deleteTimer(timer)
                if moved:
                    self.handle.registerTimer(moved)
                timer = moved
        self.lot.update((float(bid), timer, done))
        yield _closed_frame(out)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        bid, timer, done = self.lot.get() or (0.0, 0, True)
        out = [] if done else [(key[0], bid, pd.Timestamp(timer, unit="ms"), True)]
        self.lot.update((bid, 0, True))
        yield _closed_frame(out)

    def close(self) -> None:
        pass


def _closed_frame(rows: list[tuple]) -> pd.DataFrame:
    return pd.DataFrame(rows, columns=["lot_id", "final_price", "closed_at", "inferred"]).astype({"closed_at": "datetime64[ns]"})


def detect_closes(observations: DataFrame, params: Params = Params(), lateness: str = "1 hour") -> DataFrame:
    """One row per lot that ended: seen closed, or not seen for the grace time after its close."""
    slim = observations.select("lot_id", "obs_id", "observed_at", "current_bid", "close_at", "is_closed", "final_price")
    return slim.withWatermark("observed_at", lateness).groupBy("lot_id").transformWithStateInPandas(
        statefulProcessor=_Closes(params.grace_minutes * 60_000), outputStructType=CLOSED, outputMode="Append", timeMode="EventTime")


def closes_twin(observations: DataFrame, watermark, params: Params = Params()) -> DataFrame:
    """The batch result a finished close stream must equal, given its last watermark."""
    state = ol.fold_observations(observations)
    grace = F.expr(f"INTERVAL {params.grace_minutes} MINUTES")
    inferred = ~F.col("is_closed") & (F.col("close_at") + grace <= watermark)
    return state.where(F.col("is_closed") | inferred).select(
        "lot_id", F.when(F.col("is_closed"), F.col("final_price")).otherwise(F.col("current_bid")).alias("final_price"),
        F.when(F.col("is_closed"), F.col("closed_at")).otherwise(F.col("close_at") + grace).alias("closed_at"), inferred.alias("inferred"))


# --- duplicates ---------------------------------------------------------------------------------------
def once(stream: DataFrame, keys: list[str], time: str | None = None, within: str = "24 hours") -> DataFrame:
    """One row per key: within a time span by default, for ever when no time column is given.

    For ever means that the state only grows; prefer the bounded form."""
    if time is None:
        return stream.dropDuplicates(keys)
    return stream.withWatermark(time, within).dropDuplicatesWithinWatermark(keys)


def run_to_end(stream: DataFrame, path: str, checkpoint: str) -> None:
    """Drains the input that is there now into parquet."""
    query = stream.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()


def alert_stream(alerts: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """Alert rows, once per key, written per batch for the sender."""
    fresh = once(alerts, ["dedupe_key"], "sent_at")
    return (
        fresh.writeStream.foreachBatch(lambda df, i: write_batch(df, path, i))
        .option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    )
