"""Session settings and the shared folder that written intermediates go to."""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_local_dirs: dict[str, str] = {}


def local_session(cores: int | str = "*", app: str = "barloom", **conf: str) -> SparkSession:
    """A session for tests and the bench; on a cluster spark-submit sets these."""
    n = os.cpu_count() if cores == "*" else int(cores)
    builder = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", str(n))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", "8g")
        .config("spark.ui.enabled", "false")
        # without TCP's delayed acknowledgements, which cost a short Python job half its time
        .config("spark.python.unix.domain.socket.enabled", "true")
        # plans here have hundreds of columns: skip recording a Python call site for each of them
        .config("spark.python.sql.dataFrameDebugging.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
    )
    for key, value in conf.items():
        builder = builder.config(key, value)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def shared_dir(spark: SparkSession) -> str:
    """The folder every executor can reach, from ``spark.checkpoint.dir``.

    Only a local master may do without the setting: it gets a fresh temporary folder.
    """
    path = spark.conf.get("spark.checkpoint.dir", None)
    if path is None:
        context = spark.sparkContext
        if not context.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        if context.applicationId not in _local_dirs:
            _local_dirs[context.applicationId] = tempfile.mkdtemp(prefix="barloom-")
        path = _local_dirs[context.applicationId]
    return path.rstrip("/")


def scratch_path(spark: SparkSession, name: str) -> str:
    """A path under the shared folder that no other run uses."""
    return f"{shared_dir(spark)}/barloom/{name}-{uuid.uuid4().hex}"


def settle(df: DataFrame, sort_by: str | None = None) -> DataFrame:
    """Write ``df`` to the shared folder and read it back.

    Iterative fits scan their input many times; the table makes each scan cheap, keeps column
    pruning and filter pushdown, and survives the loss of any executor. ``sort_by`` orders the rows
    inside each file, without a shuffle, so that range filters on that column skip row groups.
    """
    path = scratch_path(df.sparkSession, "table")
    (df.sortWithinPartitions(sort_by) if sort_by else df).write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
