"""Session settings and the shared scratch folder."""

from __future__ import annotations

import gc
import os
import re
import tempfile
import time
import uuid
import zipfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession


def local_session(cores: str = "*", shuffle_partitions: int = 8) -> SparkSession:
    """A session for tests and the bench; a cluster brings its own settings."""
    return (
        SparkSession.builder.master(f"local[{cores}]")
        .appName("cellweave")
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", os.environ.get("CELLWEAVE_DRIVER_MEMORY", "8g"))
        .config("spark.ui.enabled", "false")
        .getOrCreate()
    )


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors see: `spark.checkpoint.dir` of the session.

    Only where that is unset and all runs on one machine (tests, a laptop) a
    temporary folder is made; on a cluster the setting is required.
    """
    ship_package(spark)
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if named is None:
        if not re.fullmatch(r"local(\[[^\]]*\])?", spark.sparkContext.master):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        named = tempfile.mkdtemp(prefix="cellweave-")
    if spark.sparkContext.getCheckpointDir() is None:
        spark.sparkContext.setCheckpointDir(named)
    return named


def ship_package(spark: SparkSession) -> None:
    """Let tasks import this package where it is not installed on the workers: it is sent to them once per session.

    Tasks import it, rather than get its functions along with each job, so that what a worker keeps between tasks stays.
    """
    context, package = spark.sparkContext, Path(__file__).parent
    if getattr(context, "_cellweave_shipped", False):
        return
    archive = Path(tempfile.mkdtemp(prefix="cellweave-")) / f"{package.name}.zip"
    with zipfile.ZipFile(archive, "w") as out:
        for file in sorted(package.rglob("*.py")):
            out.write(file, file.relative_to(package.parent))
    context.addPyFile(str(archive))
    context._cellweave_shipped = True


def scratch_path(spark: SparkSession, name: str) -> str:
    """A fresh path below the shared folder."""
    return f"{shared_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"


def cut_lineage(df: DataFrame) -> DataFrame:
    """Write `df` to the shared folder once, so that later uses read it back."""
    shared_dir(df.sparkSession)
    done = df.checkpoint(eager=True)
    _release(df.sparkSession)
    return done


def written(df: DataFrame) -> DataFrame:
    """As `cut_lineage`, for many or wide rows: as Parquet, which is compressed and read by column."""
    path = scratch_path(df.sparkSession, "rows")
    df.write.parquet(path)
    _release(df.sparkSession)
    return df.sparkSession.read.schema(df.schema).parquet(path)


#: Seconds between two calls of the driver's collector.
RELEASE_EVERY = 2.0
_released = {"at": 0.0}


def _release(spark: SparkSession) -> None:
    """Let Spark remove the shuffle files, and checkpoints, of what nothing refers to any more.

    It does so once the driver's collector has found them, which a driver with
    memory to spare seldom runs, while executors' disks fill in a job of many rounds.
    """
    if time.monotonic() - _released["at"] >= RELEASE_EVERY:
        gc.collect()
        spark.sparkContext._jvm.System.gc()
        _released["at"] = time.monotonic()
