"""Continuous ingest: micro-batches run the batch operators against the library tables."""

from __future__ import annotations

import hashlib

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.streaming import StreamingQuery

from mementa.operators import consolidation as C
from mementa.plans.library import Library, Store, mark_run, record_run, run_index
from mementa.session import reliable_checkpoint


def inventory_stream(spark: SparkSession, path: str, schema: str, files_per_trigger: int = 1000) -> DataFrame:
    """Inventory files arriving in a folder."""
    return (
        spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger).parquet(path)
    )


def _newest_per_path(batch: DataFrame) -> DataFrame:
    """One row per path of a batch: the latest modification wins."""
    columns = [c for c in batch.columns if c != "absolute_path"]
    latest = F.max_by(F.struct(*columns), F.coalesce("modified_unix", F.lit(0))).alias("_l")
    return batch.groupBy("absolute_path").agg(latest).select("absolute_path", "_l.*")


def incremental_index(stream: DataFrame, library: Library, hasher: Callable[[DataFrame], DataFrame],
                      checkpoint: str, signer: Callable[[DataFrame], DataFrame] | None = None) -> StreamingQuery:
    """Hash (and with a signer, sign) only new or changed files of each batch and upsert them into the index.

    A batch rewrites the index partitions of its own paths.  A replayed batch finds its files unchanged.
    """
    name = hashlib.sha256(checkpoint.encode()).hexdigest()[:16]

    def handle(batch: DataFrame, batch_id: int) -> None:
        run_index(library, _newest_per_path(batch), hasher, signer, run=f"stream-{name}-{batch_id}")

    return (
        stream.writeStream.foreachBatch(handle)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )


def dedup_ingest(stream: DataFrame, library: Library, destination: str, checkpoint: str,
                 stream_id: str | None = None, store: Store | None = None) -> StreamingQuery:
    """First content wins, later copies are duplicates; the contents table is the only state.

    A run is named by stream and batch, and every table is partitioned by run.  A batch that is replayed after a
    failure therefore writes its own partitions again and nothing else, and streams that share a library do not meet.
    ``stream_id`` defaults to the checkpoint, which is what makes two streams different to Spark.  Files without a hash
    go to ``unread_files``, so one of them does not stop the stream.  ``store`` reads the bytes of new contents.
    """
    name = stream_id or hashlib.sha256(checkpoint.encode()).hexdigest()[:16]

    def handle(batch: DataFrame, batch_id: int) -> None:
        run = f"stream-{name}-{batch_id}"
        mark_run(library, run, "stream", destination, "running")
        batch = reliable_checkpoint(batch.select(*C.INVENTORY))
        unread = batch.filter("content_hash IS NULL").withColumns({"run_id": F.lit(run), "found_at": F.current_timestamp()})
        library.replace("unread_files", unread)
        record_run(library, batch.filter("content_hash IS NOT NULL"), destination, run, store)
        mark_run(library, run, "stream", destination, "completed")

    return (
        stream.writeStream.foreachBatch(handle)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )
