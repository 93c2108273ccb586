"""Session set-up and the one place where intermediate tables are written."""

from __future__ import annotations

import os
import tempfile
import uuid
import zipfile

from pyspark.sql import DataFrame, SparkSession


def build_session(app: str = "tillwise", master: str | None = None, **conf: str) -> SparkSession:
    """Session with adaptive execution, skew-join splitting and UTC time."""
    builder = (
        SparkSession.builder.appName(app)
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.adaptive.coalescePartitions.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        # recording the call site of every column expression slows plan building
        .config("spark.python.sql.dataFrameDebugging.enabled", "false")
    )
    if master:
        builder = builder.master(master)
    for key, value in conf.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def shared_folder(spark: SparkSession) -> str:
    """Folder for written intermediates: the cluster's ``spark.checkpoint.dir``.

    A folder of our own is made only where the setting is absent and Spark runs
    in local mode; a cluster without the setting is refused, because a
    machine-local folder would not survive the loss of an executor.
    """
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if folder:
        return folder
    if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
        raise RuntimeError("spark.checkpoint.dir must name a shared folder on a cluster")
    folder = tempfile.mkdtemp(prefix="tillwise-")
    spark.sparkContext.setCheckpointDir(folder)
    return spark.sparkContext.getCheckpointDir()


def write_stage(df: DataFrame, name: str = "stage") -> str:
    """Write ``df`` as Parquet under a fresh name in the shared folder; returns the path."""
    path = os.path.join(shared_folder(df.sparkSession), f"{name}-{uuid.uuid4().hex}")
    df.write.parquet(path)
    return path


def materialize(df: DataFrame, name: str = "stage") -> DataFrame:
    """Write ``df`` once as Parquet in the shared folder and read it back.

    Used where an operator scans its input more than once (two-pass quantiles,
    iterative training). The written table cuts the lineage, survives executor
    loss, keeps column pruning and gives Spark exact sizes for later joins.
    """
    return df.sparkSession.read.schema(df.schema).parquet(write_stage(df, name))


def remove_folder(spark: SparkSession, path: str) -> None:
    """Delete a written stage that nothing reads any more, through Hadoop's file system."""
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark._jsc.hadoopConfiguration()).delete(target, True)


class Stages:
    """Written stages of an iterative operator. ``with Stages(spark) as stages`` removes what is left at the end."""

    def __init__(self, spark: SparkSession):
        self.spark = spark
        self.paths: list[str] = []

    def keep(self, df: DataFrame, name: str = "stage") -> DataFrame:
        """Write ``df`` and read it back, as :func:`materialize` does."""
        schema, path = df.schema, write_stage(df, name)
        self.paths.append(path)
        return self.spark.read.schema(schema).parquet(path)

    def drop(self, but: int = 0) -> None:
        """Remove all stages but the last ``but``."""
        cut = len(self.paths) - but
        for path in self.paths[:cut]:
            remove_folder(self.spark, path)
        self.paths = self.paths[cut:]

    def __enter__(self) -> Stages:
        return self

    def __exit__(self, *_) -> None:
        self.drop()


_shipped: set[str] = set()


def ship_package(spark: SparkSession) -> None:
    """Give the executors this package, once per application, so that Python tasks can import it."""
    app = spark.sparkContext.applicationId
    if app in _shipped:
        return
    root = os.path.dirname(os.path.abspath(__file__))
    path = os.path.join(tempfile.mkdtemp(prefix="tillwise-ship-"), "tillwise_modules.zip")
    with zipfile.ZipFile(path, "w") as archive:
        for folder, _, names in os.walk(root):
            for name in names:
                if name.endswith(".py"):
                    full = os.path.join(folder, name)
                    archive.write(full, os.path.relpath(full, os.path.dirname(root)))
    spark.sparkContext.addPyFile(path)
    _shipped.add(app)
