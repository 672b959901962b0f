"""Structured Streaming: rollups by event time and sinks that may be replayed."""

from __future__ import annotations

import argparse
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import DataStreamWriter, StreamingQuery

from tidemark.operators import transform
from tidemark.operators.hot import HotTable
from tidemark.operators.rollups import REVENUE
from tidemark.settings import Stream, load
from tidemark.sources import readers
from tidemark.sources.store import Store

WATERMARK = f"{Stream().watermark_seconds} seconds"
TRIGGER = f"{Stream().trigger_ms} milliseconds"


def windowed(events: DataFrame, width: str = "1 minute", watermark: str | None = WATERMARK) -> DataFrame:
    """The rollup of a stream of enriched events by tumbling window; state goes as the watermark passes a window's end."""
    if watermark:
        events = events.withWatermark("ts", watermark)
    sums = events.groupBy(F.window("ts", width), "region", "event_type").agg(
        F.count("*").alias("events"), F.coalesce(F.sum("revenue"), F.lit(0)).cast(REVENUE).alias("revenue")
    )
    return sums.select(F.col("window.start").alias("window_start"), "region", "event_type", "events", "revenue")


def replace_sink(store: Store, name: str) -> Callable[[DataFrame, int], None]:
    """Update-mode output holds totals, so rows replace those of equal key; a replayed batch changes nothing."""

    def write(batch: DataFrame, batch_id: int) -> None:
        store.replace(name, batch)

    return write


def events_sink(store: Store, hot: HotTable | None = None, latencies: list[dict] | None = None) -> Callable[[DataFrame, int], None]:
    """All tables of a batch in one place: events once each, the delta they make, the hot table, and how long they took to be visible.

    A batch costs what its own rows cost: the delta is of these alone, and ``Store.current`` adds it to the rollups.
    """

    def write(batch: DataFrame, batch_id: int) -> None:
        delta = store.insert_batch(batch, batch_id)
        if hot is not None:
            hot.feed(delta, delta=True)
        if latencies is not None and "created_ns" in batch.columns:
            from tidemark.operators.metrics import latency_percentiles

            latencies.append(latency_percentiles(with_latency(batch), "latency_ms").first().asDict())

    return write


def hot_sink(hot: HotTable) -> Callable[[DataFrame, int], None]:
    """Update-mode rollups into the hot table: totals, so a replayed batch changes nothing."""

    def write(batch: DataFrame, batch_id: int) -> None:
        hot.feed(batch)

    return write


def with_latency(batch: DataFrame) -> DataFrame:
    """Milliseconds from an event's creation to now, when its batch is visible."""
    return batch.withColumn("latency_ms", (F.unix_micros(F.current_timestamp()) * 1000 - F.col("created_ns")) / 1e6)


def start(stream: DataFrame, checkpoint: str, sink: Callable[[DataFrame, int], None] | None = None, mode: str = "update", once: bool = False, trigger: str = TRIGGER, name: str | None = None) -> StreamingQuery:
    """Start a query into a batch sink, or the console without one. ``once`` reads what there is and stops."""
    writer: DataStreamWriter = stream.writeStream.outputMode(mode).option("checkpointLocation", checkpoint)
    writer = writer.foreachBatch(sink) if sink else writer.format("console").option("truncate", "false")
    writer = writer.trigger(availableNow=True) if once else writer.trigger(processingTime=trigger)
    return (writer.queryName(name) if name else writer).start()


def stop(query: StreamingQuery, drain: bool = True) -> None:
    """Finish what has arrived, then stop."""
    if drain and query.isActive:
        query.processAllAvailable()
    query.stop()


def main(args: list[str] | None = None) -> None:
    settings = load()
    p = argparse.ArgumentParser(description=__doc__)
    p.add_argument("--source", choices=("kafka", "file"), default="file")
    p.add_argument("--bootstrap", default="localhost:9092")
    p.add_argument("--topic", default="events")
    p.add_argument("--input-dir", default="data/incoming")
    p.add_argument("--checkpoint", default="data/checkpoints/rollup")
    p.add_argument("--sink", choices=("store", "console"), default="console")
    p.add_argument("--warehouse", default=settings.storage.warehouse)
    p.add_argument("--trigger", default=f"{settings.stream.trigger_ms} milliseconds")
    p.add_argument("--once", action="store_true", help="read what there is and stop")
    a = p.parse_args(args)
    from tidemark.session import session

    spark: SparkSession = session("tidemark-stream", streaming=True)
    if a.source == "kafka":
        raw = readers.kafka_stream(spark, a.bootstrap, a.topic, settings.stream.rows_per_trigger)
    else:
        raw = readers.json_stream(spark, a.input_dir, settings.stream.files_per_trigger)
    sink = replace_sink(Store(spark, a.warehouse), "aggregates_1m") if a.sink == "store" else None
    rollup = windowed(transform.transform(raw), watermark=f"{settings.stream.watermark_seconds} seconds")
    start(rollup, a.checkpoint, sink, once=a.once, trigger=a.trigger).awaitTermination()


if __name__ == "__main__":
    main()
