"""Processing status per project from a log of ``project, url, status, error_message, ts``.

Every URL counts once, by its latest event.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

# Final states.
PROCESSED = ("completed", "skipped")
FAILED = ("failed",)

_COUNTS = "project string, total bigint, processed bigint, pending bigint, failed bigint"
_DELTA = "project string, total bigint, processed bigint, failed bigint"


def _pending(total: Column, processed: Column, failed: Column) -> Column:
    return F.greatest(total - processed - failed, F.lit(0).cast("bigint"))


def latest_status(events: DataFrame) -> DataFrame:
    """The current status of every URL."""
    newest = F.struct("ts", "status")
    return events.groupBy("project", "url").agg(
        F.max_by("status", newest).alias("status"),
        F.max_by("error_message", newest).alias("error_message"),
        F.max("ts").alias("ts"),
    )


def status_rollup(events: DataFrame) -> DataFrame:
    """Counts per project over a finished log."""
    counts = (
        latest_status(events)
        .groupBy("project")
        .agg(
            F.count(F.lit(1)).alias("total"),
            F.count_if(F.col("status").isin(*PROCESSED)).alias("processed"),
            F.count_if(F.col("status").isin(*FAILED)).alias("failed"),
        )
    )
    return counts.select(
        "project",
        "total",
        "processed",
        _pending(F.col("total"), F.col("processed"), F.col("failed")).alias("pending"),
        "failed",
    )


def is_complete() -> Column:
    return (F.col("pending") == 0) & (F.col("processed") + F.col("failed") == F.col("total"))


def _class_of(status: str | None) -> tuple[int, int]:
    return int(status in PROCESSED), int(status in FAILED)


def _url_deltas(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState):
    """How one URL's new events change its project's counts."""
    seen = state.exists
    ts, status = state.get if seen else (None, None)
    before = _class_of(status) if seen else (0, 0)
    for batch in batches:
        for event_ts, event_status in zip(batch["ts_us"], batch["status"]):
            # a null status comes before every other one of its time, as in the batch roll-up
            if ts is None or (event_ts, event_status or "") > (ts, status or ""):
                ts, status = int(event_ts), event_status
    state.update((ts, status))
    after = _class_of(status)
    change = (int(not seen), after[0] - before[0], after[1] - before[1])
    if any(change):
        yield pd.DataFrame(
            {
                "project": [key[0]],
                "total": [change[0]],
                "processed": [change[1]],
                "failed": [change[2]],
            }
        )


def count_deltas(events: DataFrame) -> DataFrame:
    """Stream of count changes, with one small state per URL."""
    return (
        events.select("project", "url", "status", F.unix_micros("ts").alias("ts_us"))
        .groupBy("project", "url")
        .applyInPandasWithState(
            _url_deltas,
            _DELTA,
            "ts_us bigint, status string",
            "update",
            GroupStateTimeout.NoTimeout,
        )
    )


def _versions(spark: SparkSession, path: str) -> list[int]:
    """Batch numbers that have a complete snapshot below *path*."""
    hadoop = spark._jvm.org.apache.hadoop.fs
    folder = hadoop.Path(path)
    files = folder.getFileSystem(spark._jsc.hadoopConfiguration())
    if not files.exists(folder):
        return []
    names = [s.getPath().getName() for s in files.listStatus(folder)]
    done = [
        n for n in names if n.startswith("batch=") and files.exists(hadoop.Path(path, n + "/_SUCCESS"))
    ]
    return sorted(int(n.split("=")[1]) for n in done)


def _forget(spark: SparkSession, path: str, versions: list[int]) -> None:
    hadoop = spark._jvm.org.apache.hadoop.fs
    for version in versions:
        folder = hadoop.Path(f"{path}/batch={version}")
        folder.getFileSystem(spark._jsc.hadoopConfiguration()).delete(folder, True)


def status_stream(events: DataFrame, folder: str, **trigger) -> StreamingQuery:
    """Maintain, below *folder*, three tables by micro-batch:

    ``counts`` (all projects, the two newest snapshots), ``changes`` (projects whose four
    counts changed) and ``completions`` (a project's first completion). Each micro-batch
    overwrites its own folder and reads only older ones, so a repeated one is harmless.
    """
    counts_path, changes_path, done_path = (
        f"{folder}/{name}" for name in ("counts", "changes", "completions")
    )

    def fold(deltas: DataFrame, batch_id: int) -> None:
        spark = deltas.sparkSession
        older = [v for v in _versions(spark, counts_path) if v < batch_id]
        if older:
            before = spark.read.schema(_COUNTS).parquet(f"{counts_path}/batch={older[-1]}")
        else:
            before = spark.createDataFrame([], _COUNTS)
        change = deltas.groupBy("project").agg(
            *[F.sum(c).alias("d_" + c) for c in ("total", "processed", "failed")]
        )
        total, processed, failed = (
            F.coalesce(c, F.lit(0)) + F.coalesce("d_" + c, F.lit(0))
            for c in ("total", "processed", "failed")
        )
        merged = before.join(change, "project", "full_outer").select(
            "project",
            total.alias("total"),
            processed.alias("processed"),
            _pending(total, processed, failed).alias("pending"),
            failed.alias("failed"),
            (
                F.coalesce(F.abs("d_total") + F.abs("d_processed") + F.abs("d_failed"), F.lit(0)) > 0
            ).alias("changed"),
        )
        merged.write.mode("overwrite").parquet(f"{counts_path}/batch={batch_id}")
        # the later steps read the written snapshot, so state is evaluated once
        now = spark.read.schema(_COUNTS + ", changed boolean").parquet(
            f"{counts_path}/batch={batch_id}"
        )
        now.filter("changed").drop("changed").write.mode("overwrite").parquet(
            f"{changes_path}/batch={batch_id}"
        )
        complete = now.filter(F.col("changed") & is_complete()).drop("changed")
        earlier = [v for v in _versions(spark, done_path) if v < batch_id]
        if earlier:
            known = spark.read.schema(_COUNTS).parquet(
                *[f"{done_path}/batch={v}" for v in earlier]
            )
            complete = complete.join(known.select("project"), "project", "left_anti")
        complete.write.mode("overwrite").parquet(f"{done_path}/batch={batch_id}")
        _forget(spark, counts_path, older[:-1])

    return (
        count_deltas(events)
        .writeStream.foreachBatch(fold)
        .outputMode("update")
        .option("checkpointLocation", f"{folder}/checkpoint")
        .trigger(**(trigger or {"availableNow": True}))
        .start()
    )


def current_counts(spark: SparkSession, folder: str) -> DataFrame:
    """The newest snapshot."""
    path = f"{folder}/counts"
    versions = _versions(spark, path)
    if not versions:
        return spark.createDataFrame([], _COUNTS)
    return spark.read.schema(_COUNTS).parquet(f"{path}/batch={versions[-1]}")


def completions(spark: SparkSession, folder: str) -> DataFrame:
    """One final row per completed project."""
    path = f"{folder}/completions"
    versions = _versions(spark, path)
    if not versions:
        return spark.createDataFrame([], _COUNTS)
    return spark.read.schema(_COUNTS).parquet(*[f"{path}/batch={v}" for v in versions])


def changes(spark: SparkSession, folder: str) -> DataFrame:
    """Every emitted status row with the micro-batch it belongs to."""
    return spark.read.schema(_COUNTS + ", batch bigint").parquet(f"{folder}/changes")
