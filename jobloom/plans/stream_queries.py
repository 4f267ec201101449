"""Queries that run a stream to its end and read what it wrote."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

from ..sources.fixtures import jobs_from_orders, table
from ..streaming import feed


def _folder(spark: SparkSession) -> str:
    """A new folder below the cluster's shared one; in local mode, where none is set, below a temporary one. It goes when the application ends."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir has to name a folder that the driver and all executors share")
        base = f"file://{tempfile.mkdtemp(prefix='jobloom-')}"
    folder = spark._jvm.org.apache.hadoop.fs.Path(f"{base}/stream-{uuid.uuid4().hex}")
    folder.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(folder)
    return str(folder.toString())


def cdc_pending_feed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The change feed over orders as job changes, run once over all that is there."""
    folder = _folder(spark)
    # a pattern, as a stream's plain path has to be a folder
    orders = spark.readStream.schema(table(spark, sf_dir, "orders").schema).parquet(f"{sf_dir}/orders.parque[t]")
    pending = feed.pending_feed(jobs_from_orders(orders))
    query = pending.writeStream.format("parquet").option("path", f"{folder}/feed").option("checkpointLocation", f"{folder}/offsets").trigger(availableNow=True).start()
    query.awaitTermination()
    return feed.cdc_counts(spark.read.schema(pending.schema).parquet(f"{folder}/feed"))


QUERIES = {"cdc_pending_feed": cdc_pending_feed}
ORACLES = {"cdc_pending_feed": "SELECT 't' || (o_orderkey % 4) AS type, count(*) AS n_changes, min(o_orderdate) AS first_run_at FROM orders WHERE o_orderstatus = 'P' GROUP BY 1"}
