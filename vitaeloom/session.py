"""Session helpers shared by every module."""

from __future__ import annotations

import tempfile
import zipfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession


def build_session(app: str = "vitaeloom", master: str | None = None, **conf: str) -> SparkSession:
    """A session with the settings the operators are designed for; `conf` overrides any of them."""
    settings = {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
        "spark.sql.mapKeyDedupPolicy": "LAST_WIN",
        "spark.ui.enabled": "false",
    } | {k.replace("__", "."): v for k, v in conf.items()}
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    return ship(builder.config(map=settings).getOrCreate())


def durable(df: DataFrame, eager: bool = True) -> DataFrame:
    """Cut the lineage of `df` with a checkpoint in the folder that all executors share.

    The folder is `spark.checkpoint.dir` of the session. Only where that is unset and the master is
    local (tests, single machine) a temporary folder is set instead.

    The result has no size estimate. The one that Spark carries over from the plan before the checkpoint
    can be too small by orders of magnitude (a file's compressed bytes, arrays counted as one element),
    and joins would broadcast by it; without it joins shuffle, and the adaptive planner turns those into
    broadcasts whose measured size allows it.
    """
    spark = df.sparkSession
    context = spark.sparkContext
    if context.getCheckpointDir() is None:
        folder = spark.conf.get("spark.checkpoint.dir", None)
        if folder is None:
            if not context.master.startswith("local[") and context.master != "local":
                raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
            folder = tempfile.mkdtemp(prefix="vitaeloom-checkpoint-")
        context.setCheckpointDir(folder)
    saved = df.checkpoint(eager)
    rows = saved._jdf.queryExecution().toRdd()
    return DataFrame(spark._jsparkSession.internalCreateDataFrame(rows, saved._jdf.schema(), False), spark)


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """The Parquet table `name` of a folder."""
    return spark.read.parquet(f"{folder.rstrip('/')}/{name}.parquet")


def spread(df: DataFrame, *keys: str) -> DataFrame:
    """The rows in `spark.sql.shuffle.partitions` partitions by keys: work on a small file uses all cores, and windows over the keys need no further shuffle."""
    return df.repartition(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), *keys)


_shipped: set[str] = set()


def ship(spark: SparkSession) -> SparkSession:
    """Send this package to the Python workers of a session, once for each application."""
    context = spark.sparkContext
    if context.applicationId not in _shipped:
        root = Path(__file__).resolve().parent
        archive = Path(tempfile.mkdtemp(prefix="vitaeloom-")) / "vitaeloom.zip"
        with zipfile.ZipFile(archive, "w") as z:
            for p in sorted(root.rglob("*.py")):
                z.write(p, str(p.relative_to(root.parent)))
        context.addPyFile(str(archive))
        _shipped.add(context.applicationId)
    return spark
