"""Listeners to lifecycle events: a stream over the event log, which a batch adds to after its jobs are written."""

from __future__ import annotations

import logging
from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..sources import schemas
from ..sources.store import ParquetStore
from .feed import POLL_MS

log = logging.getLogger(__name__)


def on_job_event(store: ParquetStore, listener: Callable[[DataFrame], None], checkpoint: str, kinds: list[str] | None = None, once: bool = False) -> StreamingQuery:
    """Call the listener with each batch of events, of all kinds or those given; stop() ends the subscription.

    No event comes before what it tells of is written. What the listener raises is logged, and
    the stream goes on. After a restart with the same checkpoint no event comes twice or is left
    out, but for a batch during which the listener's process died.
    """

    def batch(rows: DataFrame, number: int) -> None:
        found = rows if kinds is None else rows.filter(F.col("kind").isin(kinds))
        if found.isEmpty():
            return
        try:
            listener(found)
        except Exception:  # noqa: BLE001  a listener's fault is none of the queue's
            log.exception("a listener failed on batch %s", number)

    events = store.spark.readStream.schema(schemas.EVENTS).option("recursiveFileLookup", True).parquet(f"{store.path}/events")
    writer = events.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if once else writer.trigger(processingTime=f"{POLL_MS} milliseconds")).start()
