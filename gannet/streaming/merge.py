"""Merging a stream of journal records into a current state, exactly once for each record."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from gannet.sources.storage import Store

_ORDER = ("journal_id", "sequence")


def fold(state: DataFrame | None, records: DataFrame, fields: tuple[str, ...]) -> DataFrame:
    """State after more records: for each key the fields of its greatest (journal_id, sequence), and how far it got.

    The maximum doesn't depend on arrival, so late and repeated records change nothing twice.
    """
    last = records.select("rel_key", *_ORDER, *fields)
    whole = last if state is None else state.select("rel_key", *_ORDER, *fields).unionByName(last)
    return whole.groupBy("rel_key").agg(F.max_by(F.struct(*_ORDER, *fields), F.struct(*_ORDER)).alias("r")).select("rel_key", "r.*")


def start(stream: DataFrame, store: Store, checkpoint: str, fields: tuple[str, ...]) -> StreamingQuery:
    """Folds what has come since the last time into the store, a run for each batch, and stops."""

    def merge(batch: DataFrame, number: int) -> None:
        run = f"batch-{number:012d}"
        parent = store.latest()
        if parent == run:
            return  # this batch was published before the checkpoint could say so
        prior = None if parent is None else store.read(parent)
        new = fold(prior, batch, fields)
        for name, kind in (("deleted_at", "timestamp_ntz"), ("etag", "string")):  # a store counts by these
            if name not in new.columns:
                kept = None if prior is None or name not in prior.columns else prior.select("rel_key", name)
                new = new.withColumn(name, F.lit(None).cast(kind)) if kept is None else new.join(kept, "rel_key", "left")
        store.publish(new, run, parent)

    return stream.writeStream.foreachBatch(merge).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def windowed_counts(events: DataFrame, length: str = "1 hour", lateness: str = "10 minutes", at: str = "ts", by: str = "event_type") -> DataFrame:
    """Events by window and kind, with a watermark: for batch and streaming alike."""
    return events.withWatermark(at, lateness).groupBy(F.window(at, length), by).agg(F.count("*").alias("events"))


def read_events(spark: SparkSession, folder: str, schema: str) -> DataFrame:
    return spark.readStream.schema(schema).parquet(folder)
