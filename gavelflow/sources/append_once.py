"""Appending a run's rows to a table exactly once.

    <table>/data/<attempt>/...   Parquet files of one attempt
    <table>/runs/<run>.json      the commit record: the attempt that counts for the run, and its rows

An attempt writes files nobody reads until the record names them; the record is written aside and renamed
into place. A run that is repeated finds its record and adds nothing. If it died before its record,
its files are never read, and the next attempt writes its own. Should two attempts of one run finish at the
same moment, the record names one of them, so one copy counts whichever it is. ``clear_attempts`` removes
what no record names.

The driver reads one short record per run. Paths go through Hadoop's file systems, as Spark's own do.
"""

from __future__ import annotations

import re
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

RECORD = "run string, attempt string, rows long"


def hadoop_path(spark: SparkSession, path: str):
    """``(file system, path)`` as Hadoop names them."""
    made = spark._jvm.org.apache.hadoop.fs.Path(path)
    return made.getFileSystem(spark._jsc.hadoopConfiguration()), made


def _record(table: str, run: str) -> str:
    if not re.fullmatch(r"[A-Za-z0-9][A-Za-z0-9_.=-]*", run):
        raise ValueError(f"a run is named by letters, digits and _ . = -, got {run!r}")
    return f"{table.rstrip('/')}/runs/{run}.json"


def is_committed(spark: SparkSession, table: str, run: str) -> bool:
    fs, path = hadoop_path(spark, _record(table, run))
    return bool(fs.exists(path))


def put_text(spark: SparkSession, path: str, text: str) -> None:
    """A small file that is there whole or not at all: written aside and renamed. A file of that name that
    another attempt put there may stay or be replaced."""
    fs, final = hadoop_path(spark, path)
    _, aside = hadoop_path(spark, f"{path.rpartition('/')[0]}/_{uuid.uuid4().hex}.tmp")
    out = fs.create(aside, True)
    try:
        out.write(bytearray(text.encode()))
    finally:
        out.close()
    if not fs.rename(aside, final):
        # some file systems refuse to replace a file
        fs.delete(final, False)
        if not fs.rename(aside, final) and not fs.exists(final):
            raise OSError(f"{path} was not written")


def _commit(spark: SparkSession, table: str, run: str, attempt: str, rows: int) -> None:
    put_text(spark, _record(table, run), f'{{"run":"{run}","attempt":"{attempt}","rows":{rows}}}\n')


def append_once(rows: DataFrame, table: str, run: str, before_commit: Callable[[], None] | None = None) -> bool:
    """Adds the rows as ``run``, unless that run is in the table already; whether they were added.
    ``before_commit`` is called between the files and the record, where a failure must leave no trace."""
    spark = rows.sparkSession
    if is_committed(spark, table, run):
        return False
    attempt = f"{run}-{uuid.uuid4().hex}"
    folder = f"{table.rstrip('/')}/data/{attempt}"
    rows.write.mode("errorifexists").parquet(folder)
    n = spark.read.schema(rows.schema).parquet(folder).count()
    if before_commit is not None:
        before_commit()
    if is_committed(spark, table, run):
        return False
    _commit(spark, table, run, attempt, n)
    return True


def runs(spark: SparkSession, table: str) -> DataFrame:
    """``run, attempt, rows`` of every committed run."""
    folder = f"{table.rstrip('/')}/runs"
    fs, path = hadoop_path(spark, folder)
    if not fs.exists(path):
        return spark.createDataFrame([], RECORD)
    return spark.read.schema(RECORD).option("pathGlobFilter", "*.json").json(folder)


def read_table(spark: SparkSession, table: str, schema: StructType) -> DataFrame:
    """All rows of committed runs, with ``run``."""
    known = runs(spark, table).orderBy("run").collect()
    paths = [f"{table.rstrip('/')}/data/{r.attempt}" for r in known]
    if not paths:
        return spark.createDataFrame([], schema).withColumn("run", F.lit(None).cast("string"))
    attempt = F.regexp_extract(F.col("_metadata.file_path"), r"/data/([^/]+)/", 1)
    rows = spark.read.schema(schema).parquet(*paths).select("*", F.regexp_replace(attempt, "-[0-9a-f]{32}$", "").alias("run"))
    return rows


def clear_attempts(spark: SparkSession, table: str) -> list[str]:
    """Removes the files of attempts that no record names; call while no run is being written."""
    fs, data = hadoop_path(spark, f"{table.rstrip('/')}/data")
    if not fs.exists(data):
        return []
    named = {r.attempt for r in runs(spark, table).collect()}
    gone = []
    for status in fs.listStatus(data):
        name = status.getPath().getName()
        if name not in named:
            fs.delete(status.getPath(), True)
            gone.append(name)
    return gone
