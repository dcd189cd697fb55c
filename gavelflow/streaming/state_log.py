"""The lot state as a log: what a batch writes grows with the batch, not with the state.

    <path>/data/delta-...     the observations of one batch, or of several merged ones
    <path>/data/base-...      the folded state of all observations before the deltas
    <path>/manifests/<batch>.json   the base and the deltas that make up the state after a batch

A batch appends its observations as a delta. Deltas of similar size are merged, ``FANOUT`` at a time, so
their number grows with the logarithm of what they hold; when they hold as many rows as the base, they are
folded into a new one. Every row is thus written a logarithmic number of times. The state is the fold of the
deltas onto the base.

Data go to folders named by attempt, and the manifest, renamed into place, is the last thing written: a
batch that dies before it leaves the state of the batch before, and running it again starts from there.
``clear_state`` removes folders that no recent manifest names.
"""

from __future__ import annotations

import json
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gavelflow.operators import lots as ol
from gavelflow.sources.append_once import hadoop_path, put_text

FANOUT = 4
BASE_FILE_ROWS = 4_000_000

EMPTY = {"base": None, "base_rows": 0, "deltas": []}


def _manifests(spark: SparkSession, path: str) -> list[int]:
    fs, folder = hadoop_path(spark, f"{path}/manifests")
    if not fs.exists(folder):
        return []
    names = [s.getPath().getName() for s in fs.listStatus(folder)]
    return sorted(int(n.removesuffix(".json")) for n in names if n.endswith(".json"))


def manifest(spark: SparkSession, path: str, before: int | None = None) -> dict:
    """The newest manifest, or the newest before a batch."""
    known = [b for b in _manifests(spark, path) if before is None or b < before]
    if not known:
        return dict(EMPTY)
    text = spark.read.text(f"{path}/manifests/{known[-1]}.json", wholetext=True).first()[0]
    return json.loads(text)


def _level(rows: int) -> int:
    level = 0
    while rows >= FANOUT:
        rows, level = rows // FANOUT, level + 1
    return level


def _write(df: DataFrame, path: str, kind: str, batch_id: int) -> list:
    name = f"{kind}-{batch_id}-{uuid.uuid4().hex}"
    df.write.mode("errorifexists").parquet(f"{path}/data/{name}")
    rows = df.sparkSession.read.schema(df.schema).parquet(f"{path}/data/{name}").count()
    return [name, rows]


def _read(spark: SparkSession, path: str, names: list[str]) -> DataFrame | None:
    return spark.read.parquet(*[f"{path}/data/{n}" for n in names]) if names else None


def _folded(spark: SparkSession, path: str, held: dict) -> DataFrame | None:
    base = _read(spark, path, [held["base"]] if held["base"] else [])
    deltas = _read(spark, path, [n for n, _ in held["deltas"]])
    if deltas is None:
        return base
    state = ol.fold_observations(deltas, base)
    return state.withColumn("is_new", F.lit(True)) if base is None else state


def fold_batch(batch: DataFrame, batch_id: int, path: str) -> dict:
    """The log after one batch; the manifest it wrote."""
    spark = batch.sparkSession
    held = manifest(spark, path, batch_id)
    deltas = [list(d) for d in held["deltas"]] + [_write(batch, path, "delta", batch_id)]
    deltas = [d for d in deltas if d[1]]
    while True:
        levels: dict[int, list] = {}
        for d in deltas:
            levels.setdefault(_level(d[1]), []).append(d)
        full = next((some for _, some in sorted(levels.items()) if len(some) >= FANOUT), None)
        if full is None:
            break
        names = {n for n, _ in full}
        deltas = [d for d in deltas if d[0] not in names] + [_write(_read(spark, path, sorted(names)), path, "delta", batch_id)]
    held = {"base": held["base"], "base_rows": held["base_rows"], "deltas": deltas}
    rows = sum(n for _, n in deltas)
    if rows and rows >= held["base_rows"] and held["base_rows"] + rows > 0 and (held["base"] or len(deltas) > 1):
        state = _folded(spark, path, held).drop("is_new")
        parts = max(1, -(-(held["base_rows"] + rows) // BASE_FILE_ROWS))
        name, n = _write(state.repartition(parts, "lot_id"), path, "base", batch_id)
        held = {"base": name, "base_rows": n, "deltas": []}
    put_text(spark, f"{path}/manifests/{batch_id}.json", json.dumps(held))
    return held


def read_state(spark: SparkSession, path: str) -> DataFrame | None:
    """The lots after the newest batch."""
    return _folded(spark, path, manifest(spark, path))


def clear_state(spark: SparkSession, path: str, keep: int = 2) -> list[str]:
    """Removes data that none of the last ``keep`` manifests names, and the manifests before them; call
    while no batch is being written."""
    batches = _manifests(spark, path)
    named: set[str] = set()
    for b in batches[-keep:]:
        held = manifest(spark, path, b + 1)
        named |= {n for n, _ in held["deltas"]} | ({held["base"]} if held["base"] else set())
    gone = []
    fs, data = hadoop_path(spark, f"{path}/data")
    for status in fs.listStatus(data) if fs.exists(data) else []:
        if status.getPath().getName() not in named:
            fs.delete(status.getPath(), True)
            gone.append(status.getPath().getName())
    for b in batches[:-keep]:
        fs.delete(hadoop_path(spark, f"{path}/manifests/{b}.json")[1], False)
    return gone
