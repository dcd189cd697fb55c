"""Session defaults for local runs, the shared folder, and the package on the workers."""

from __future__ import annotations

import os
import tempfile
import uuid
import zipfile

from pyspark.sql import DataFrame, SparkSession


def local_session(cores: str | int = "*", shuffle_partitions: int = 8, app: str = "gavelflow") -> SparkSession:
    return (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", "12g")
        .config("spark.ui.enabled", "false")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .getOrCreate()
    )


_LOCAL_ROOT: list[str] = []


def shared_dir(spark: SparkSession) -> str:
    """Folder every executor can reach: the one the cluster names in ``spark.checkpoint.dir``.
    Where that is unset, a local master, whose one machine is the cluster, gets a folder of its
    own for the process; any other master is refused."""
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if configured:
        return configured
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder all executors can reach")
    if not _LOCAL_ROOT:
        _LOCAL_ROOT.append(tempfile.mkdtemp(prefix="gavelflow-shared-"))
    return _LOCAL_ROOT[0]


def durable(df: DataFrame) -> DataFrame:
    """The same rows with their lineage cut, kept in the shared folder so a lost executor loses
    nothing. Without a shared folder on a cluster it fails, as ``shared_dir`` does."""
    sc = df.sparkSession.sparkContext
    if sc.getCheckpointDir() is None:
        sc.setCheckpointDir(shared_dir(df.sparkSession))
    return df.checkpoint()


def written(df: DataFrame, what: str) -> DataFrame:
    """The same rows as Parquet in the shared folder: as ``durable``, but later reads take only the columns
    they need and know the table's size."""
    spark = df.sparkSession
    path = f"{shared_dir(spark).rstrip('/')}/gavelflow/{what}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def ship_package(spark: SparkSession) -> None:
    """Gives the workers this package, once per context, so that Python functions of it run there
    however the driver was started. A cluster that has it installed is not harmed."""
    sc = spark.sparkContext
    if getattr(sc, "_gavelflow_shipped", False):
        return
    here = os.path.dirname(os.path.abspath(__file__))
    target = os.path.join(tempfile.mkdtemp(prefix="gavelflow-zip-"), "gavelflow.zip")
    with zipfile.ZipFile(target, "w", zipfile.ZIP_DEFLATED) as z:
        for folder, _, names in os.walk(here):
            for name in names:
                if name.endswith(".py"):
                    full = os.path.join(folder, name)
                    z.write(full, os.path.join("gavelflow", os.path.relpath(full, here)))
    sc.addPyFile(target)
    sc._gavelflow_shipped = True
