"""Scans and streams by format."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.operators.aggregates import closed_range
from tidemark.schemas import EVENT_COLUMNS, RAW_EVENT


def parse_json(values: DataFrame, column: str = "value") -> DataFrame:
    """Raw events of a column of JSON texts."""
    return values.select(F.from_json(F.col(column).cast("string"), RAW_EVENT).alias("e")).select("e.*")


def to_json(events: DataFrame) -> DataFrame:
    """A key and a JSON text for each event, as the Kafka sink wants them."""
    return events.select(F.col("user_id").alias("key"), F.to_json(F.struct(*events.columns)).alias("value"))


def kafka_writer(events: DataFrame, bootstrap: str, topic: str, checkpoint: str | None = None):
    """Send events to a topic, keyed by user: a table at once, a stream as a query that is returned. Needs the connector."""
    rows = to_json(events)
    if events.isStreaming:
        writer = rows.writeStream.format("kafka").option("checkpointLocation", checkpoint)
        return writer.option("kafka.bootstrap.servers", bootstrap).option("topic", topic).start()
    return rows.write.format("kafka").option("kafka.bootstrap.servers", bootstrap).option("topic", topic).save()


def kafka_stream(spark: SparkSession, bootstrap: str, topic: str, per_trigger: int = 50_000, starting: str = "latest") -> DataFrame:
    """Raw events of a topic; needs the Kafka connector on the class path. The rate limit holds back, it loses nothing."""
    reader = spark.readStream.format("kafka").option("kafka.bootstrap.servers", bootstrap).option("subscribe", topic)
    return parse_json(reader.option("startingOffsets", starting).option("maxOffsetsPerTrigger", per_trigger).load())


def json_stream(spark: SparkSession, path: str, files_per_trigger: int = 10) -> DataFrame:
    """Raw events of a folder of JSON files, oldest first, so that the watermark does not outrun a backlog."""
    return spark.readStream.schema(RAW_EVENT).option("maxFilesPerTrigger", files_per_trigger).option("latestFirst", "false").json(path)


def parquet_stream(spark: SparkSession, path: str, files_per_trigger: int = 10) -> DataFrame:
    return spark.readStream.schema(RAW_EVENT).option("maxFilesPerTrigger", files_per_trigger).option("latestFirst", "false").parquet(path)


def jdbc_predicates(column: str, bounds: Iterable) -> list[str]:
    """One half-open range for each task, over a real column."""
    edges = [f"'{b}'" for b in bounds]
    return [f"{column} >= {a} AND {column} < {b}" for a, b in zip(edges[:-1], edges[1:])]


def jdbc_scan(spark: SparkSession, url: str, table: str, column: str, bounds: Iterable, properties: dict[str, str] | None = None) -> DataFrame:
    """A scan in as many tasks as there are ranges between ``bounds``; the first and last bound limit it."""
    return spark.read.jdbc(url, table, predicates=jdbc_predicates(column, bounds), properties=properties or {})


def range_rows(events: DataFrame, start, end) -> DataFrame:
    """All columns of the events of a closed time range."""
    return closed_range(events, start, end).select(*EVENT_COLUMNS)
