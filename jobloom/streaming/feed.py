"""The change feed: which types of job have something to claim, as snapshots of rows arrive.

A stream's checkpoint plays the part of a resume token: after a restart nothing is missed, and
what arrived meanwhile comes with the first batch.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..sources import datasource

#: Wait between batches when rows are polled for, and when they are pushed besides.
POLL_MS, POLL_WITH_PUSH_MS = 5_000, 60_000


def job_changes(spark: SparkSession, path: str, schema: str, files_per_batch: int = 1) -> DataFrame:
    """Job rows as files with new states of jobs arrive under path."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch).parquet(path)


def store_changes(spark: SparkSession, path: str, latest: bool = False) -> DataFrame:
    """Job rows as the batches of the store under path change them: all that its change log holds, or those from now on."""
    datasource.register(spark)
    return spark.readStream.format(datasource.NAME).option("from", "latest" if latest else "earliest").load(path)


def pending_feed(changes: DataFrame) -> DataFrame:
    """Changes that leave a job pending: its id, type and run_at."""
    return changes.filter("status = 'pending'").select("id", "type", "run_at")


def on_job_available(feed: DataFrame, listener: Callable[[list[str]], None], checkpoint: str, poll_ms: int | None = None, once: bool = False) -> StreamingQuery:
    """Call the listener with the types that each batch has work for; stop() ends the subscription.

    A batch's types are the names of handlers, a handful whatever the number of rows.
    """

    def batch(rows: DataFrame, _: int) -> None:
        types = [r[0] for r in rows.select("type").distinct().orderBy("type").collect()]
        if types:
            listener(types)

    writer = feed.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if once else writer.trigger(processingTime=f"{poll_ms or POLL_WITH_PUSH_MS} milliseconds")).start()


def cdc_counts(feed: DataFrame) -> DataFrame:
    """Pending changes so far, by type."""
    return feed.groupBy("type").agg(F.count("id").alias("n_changes"), F.min("run_at").alias("first_run_at"))
