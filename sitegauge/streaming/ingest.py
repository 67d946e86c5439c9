"""Continuous ingestion of page vectors into the store."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from sitegauge.sources.store import BUCKETS, skip_processed, stored_beside, upsert_vectors


def ingest_stream(
    pages: DataFrame, store: str, checkpoint: str, buckets: int = BUCKETS, **trigger
) -> StreamingQuery:
    """Store every usable page once per project; pages already stored are skipped.

    A row without text or without a vector is not stored, so that a later one can be. Of rows
    of one page in a batch the one greatest by text, then vector, is taken. A batch reads only the buckets
    of the store that it touches.
    The store itself is the memory of what was seen, so the stream keeps no state. A
    repeated micro-batch finds its own rows stored and changes nothing.
    """

    def add(batch: DataFrame, _batch_id: int) -> None:
        session = batch.sparkSession
        order = Window.partitionBy("project", "url").orderBy(F.desc("content_md"), F.desc("embedding"))
        usable = usable_pages(batch).withColumn("rank", F.row_number().over(order))
        single = usable.filter(F.col("rank") == 1).drop("rank")
        upsert_vectors(session, store, skip_processed(single, stored_beside(session, store, single)), buckets)

    return (
        pages.writeStream.foreachBatch(add)
        .option("checkpointLocation", checkpoint)
        .trigger(**(trigger or {"availableNow": True}))
        .start()
    )


def usable_pages(pages: DataFrame) -> DataFrame:
    """Rows that can be stored: with text and a vector."""
    return pages.filter(
        (F.coalesce(F.length("content_md"), F.lit(0)) > 0)
        & (F.coalesce(F.size("embedding"), F.lit(0)) > 0)
    )
