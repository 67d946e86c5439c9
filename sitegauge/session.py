"""Session helpers: where reliable intermediate data goes."""

from __future__ import annotations

import shutil
import tempfile
import uuid
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession) -> str:
    """Folder every executor can reach, named by ``spark.checkpoint.dir``.

    Only a local session may fall back to a temporary folder of this machine.
    """
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if configured:
        return configured.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder all executors share")
    folder = tempfile.mkdtemp(prefix="sitegauge-")
    spark.conf.set("spark.checkpoint.dir", folder)
    return folder


def scratch_path(spark: SparkSession, name: str) -> str:
    """A fresh path below the shared folder."""
    return f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"


def spread(df: DataFrame, *keys: str) -> DataFrame:
    """Hash-partition rows that are about to grow into the session's full partition count.

    Naming the count keeps adaptive execution from merging small partitions of text that
    will be many times bigger, and costly to make, right after the shuffle.
    """
    count = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return df.repartition(count, *keys)


def materialize(df: DataFrame) -> DataFrame:
    """Reliable checkpoint: later jobs and lost executors read the files, not the lineage."""
    context = df.sparkSession.sparkContext
    if context.getCheckpointDir() is None:
        context.setCheckpointDir(shared_folder(df.sparkSession))
    return df.checkpoint(eager=True)


def let_go(spark: SparkSession) -> None:
    """Let Spark's cleaner drop shuffles, broadcasts and checkpoints of steps that are over.

    It learns of them when the driver's JVM collects garbage. Left alone that is when the heap is full: a query of
    hundreds of short jobs then holds all the heap it may, most of it garbage, and the scratch files of all its steps.
    """
    spark.sparkContext._jvm.System.gc()


def stored(df: DataFrame, name: str) -> DataFrame:
    """:func:`materialize` for rows of many terms: compressed columns take a fraction of a checkpoint's disk."""
    path = scratch_path(df.sparkSession, name)
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.parquet(path)


def ship_package(spark: SparkSession) -> None:
    """Send this package to the Python workers, for sessions started without --py-files."""
    context = spark.sparkContext
    if _shipped.get(context.applicationId):
        return
    package = Path(__file__).resolve().parent
    archive = shutil.make_archive(
        f"{tempfile.mkdtemp(prefix='sitegauge-')}/{package.name}", "zip", package.parent, package.name
    )
    context.addPyFile(archive)
    _shipped[context.applicationId] = True


_shipped: dict[str, bool] = {}
