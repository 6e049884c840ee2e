"""Structured Streaming forms of first-wins, latest-wins, windowed counts, message intake and incremental import."""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from strandwise.operators.reviews import message_kind
from strandwise.sources.collections import append_unique


def read_stream(spark: SparkSession, path: str, like: DataFrame, files_per_batch: int = 1) -> DataFrame:
    """File-source stream over Parquet files with the schema of `like`."""
    return spark.readStream.schema(like.schema).option("maxFilesPerTrigger", files_per_batch).parquet(path)


def first_decision(stream: DataFrame, keys: Sequence[str], at: str, delay: str) -> DataFrame:
    """The first row of each key; the state of a key is dropped once the watermark has passed it."""
    return stream.withColumn(at, F.col(at).cast("timestamp")).withWatermark(at, delay).dropDuplicatesWithinWatermark(list(keys))


def windowed_counts(stream: DataFrame, at: str, by: Sequence[str], width: str, delay: str) -> DataFrame:
    """Counts by time window and key; rows later than `delay` are left out."""
    return stream.withColumn(at, F.col(at).cast("timestamp")).withWatermark(at, delay).groupBy(F.window(at, width), *by).agg(F.count("*").alias("n"))


def run_available(stream: DataFrame, checkpoint: str, each: Callable[[DataFrame, int], None], mode: str = "append") -> None:
    """Process what is there and stop. `each` must be idempotent by batch number: a batch may come twice after a failure."""
    query = stream.writeStream.outputMode(mode).option("checkpointLocation", checkpoint).trigger(availableNow=True).foreachBatch(each).start()
    query.awaitTermination()


def latest_state(stream: DataFrame, keys: Sequence[str], at: str) -> DataFrame:
    """The last row of each key so far, for decisions that replace each other; equal times are settled by the greatest row."""
    rest = [c for c in stream.columns if c not in keys]
    return stream.groupBy(*keys).agg(F.max(F.struct(F.col(at).alias("_at"), *rest)).alias("x")).select(*keys, *[f"x.{c}" for c in rest])


def allowed_messages(stream: DataFrame, senders: DataFrame, sender: str = "chat_id", text: str = "text", document: str | None = None) -> DataFrame:
    """Messages of the listed senders with their `kind`; those of unknown ones are dropped without an answer."""
    known = stream.join(senders.select(sender).distinct(), sender, "left_semi")
    return known.withColumn("kind", message_kind(F.col(text), F.col(document) if document else None))


def routed(handlers: Mapping[str, Callable[[DataFrame, int], None]], column: str = "kind") -> Callable[[DataFrame, int], None]:
    """A sink that hands the rows of each kind to its handler, if it has one and there are any; a batch may come twice after a failure."""

    def each(batch: DataFrame, number: int) -> None:
        kept = batch.persist()
        try:
            for kind, handle in handlers.items():
                own = kept.where(F.col(column) == kind)
                if not own.isEmpty():
                    handle(own, number)
        finally:
            kept.unpersist()

    return each


def appended(path: str, key: Column, order: Sequence[str] = (), admit: Callable[[DataFrame], DataFrame] | None = None) -> Callable[[DataFrame, int], None]:
    """A sink that adds the rows of each batch whose key the table at `path` lacks; running a batch again adds nothing."""

    def each(batch: DataFrame, number: int) -> None:
        append_unique(batch.sparkSession, admit(batch) if admit else batch, path, key, order)

    return each
