"""The stores: events, rollups and insights, laid out for pruning."""

from __future__ import annotations

import json
from datetime import datetime, timezone

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.operators import rollups, transform
from tidemark.schemas import ENRICHED_EVENT, INSIGHT, ROLLUP
from tidemark.settings import Storage

SCHEMAS = {"events": ENRICHED_EVENT, "aggregates_1m": ROLLUP, "summary_hourly": ROLLUP, "region_daily": ROLLUP, "insights": INSIGHT}
TIME = {"events": "ts", "aggregates_1m": "window_start", "summary_hourly": "window_start", "region_daily": "window_start", "insights": "window_start"}


class Store:
    """Tables are folders partitioned by date. Every write names the dates it touches and replaces those only.

    Deltas of a stream lie beside them in a folder for each batch, written over when the batch is replayed, and count along when
    a rollup is read with ``current``.
    """

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")

    def path(self, name: str) -> str:
        if name not in SCHEMAS:
            raise ValueError(f"unknown table: {name!r}")
        return f"{self.root}/{name}"

    def create(self) -> None:
        """Idempotent: empty folders where there are none."""
        for name in SCHEMAS:
            if not self.exists(name):
                self._write(self.spark.createDataFrame([], SCHEMAS[name]), name, "append")

    def exists(self, name: str) -> bool:
        return self._there(self.path(name))

    def _files(self, place: str):
        path = self.spark._jvm.org.apache.hadoop.fs.Path(place)
        return path.getFileSystem(self.spark._jsparkSession.sessionState().newHadoopConf()), path

    def _there(self, place: str) -> bool:
        files, path = self._files(place)
        return files.exists(path)

    def _remove(self, place: str) -> None:
        files, path = self._files(place)
        files.delete(path, True)

    def ping(self) -> bool:
        return self.spark.range(1).count() == 1

    def read(self, name: str) -> DataFrame:
        from pyspark.sql import types as T

        if not self.exists(name):
            return self.spark.createDataFrame([], SCHEMAS[name]).withColumn("date", F.to_date(TIME[name]))
        schema = T.StructType([*SCHEMAS[name].fields, T.StructField("date", T.DateType())])
        return self.spark.read.schema(schema).parquet(self.path(name))

    def _write(self, df: DataFrame, name: str, mode: str) -> None:
        """A day's rows are split among tasks by size, and sorted so that row groups can be skipped."""
        columns = SCHEMAS[name].fieldNames()
        out = df.select(*(F.col(f.name).cast(f.dataType).alias(f.name) for f in SCHEMAS[name].fields)).withColumn("date", F.to_date(TIME[name]))
        order = ["date", "user_id", "ts"] if name == "events" else ["date", columns[0]]
        writer = out.hint("rebalance", "date").sortWithinPartitions(*order).write.mode(mode)
        writer.option("partitionOverwriteMode", "dynamic").partitionBy("date").parquet(self.path(name))

    def new_events(self, events: DataFrame) -> DataFrame:
        """Those whose id is not there yet; the first of equal ids wins. Only the days of ``events`` are read: an id belongs to one time."""
        if not self.exists("events"):
            return transform.dedupe(events)
        days = [r["day"] for r in events.select(F.to_date("ts").alias("day")).distinct().collect()]  # of one batch
        return transform.dedupe(events, self.read("events").where(F.col("date").isin(days) if days else F.lit(False)))

    def insert_events(self, events: DataFrame) -> None:
        self._write(self.new_events(events), "events", "append")

    def insert_batch(self, events: DataFrame, batch_id: int) -> DataFrame:
        """Events of a stream's batch and the delta that they make, which is returned; a replay changes nothing.

        The delta is written first: a replay finds either no event of the batch, and makes the same delta, or all, and leaves it.
        """
        new = self.new_events(events).checkpoint()
        place = f"{self.root}/deltas/batch={batch_id:012d}"
        delta = rollups.rollup(new, "minute")
        if not new.isEmpty():
            delta.write.mode("overwrite").parquet(place)
            self._write(new, "events", "append")
        return delta

    def current(self, grain: str = "minute") -> DataFrame:
        """The minute or hour rollup with all deltas that came since it was written."""
        name = {"minute": "aggregates_1m", "hour": "summary_hourly"}[grain]
        base = self.read(name).drop("date")
        if not self._there(f"{self.root}/deltas"):
            return base
        deltas = self.spark.read.schema(ROLLUP).parquet(f"{self.root}/deltas")
        return rollups.merge_delta(base, deltas if grain == "minute" else rollups.coarsen(deltas, grain))

    def replace(self, name: str, changed: DataFrame) -> None:
        """Replace rows by key, within the dates of ``changed`` only."""
        dates = changed.select(F.to_date("window_start").alias("date")).distinct()
        before = self.read(name).join(dates, "date", "left_semi")
        # The result is cut off from the files that it overwrites.
        after = rollups.replace_by_key(before, changed).checkpoint()
        self._write(after, name, "overwrite")

    def add(self, name: str, delta: DataFrame) -> None:
        """Add the counts and revenue of a true delta to the rows of equal key."""
        dates = delta.select(F.to_date("window_start").alias("date")).distinct()
        before = self.read(name).join(dates, "date", "left_semi")
        self._write(rollups.merge_delta(before, delta).checkpoint(), name, "overwrite")

    def replace_range(self, name: str, rows: DataFrame, start, end) -> None:
        """Put ``rows`` in place of those of ``start <= window_start < end``; the rest of the days that the range touches stays."""
        inside = (F.col("window_start") >= F.lit(start).cast("timestamp")) & (F.col("window_start") < F.lit(end).cast("timestamp"))
        days = F.col("date").between(F.to_date(F.lit(start).cast("timestamp")), F.to_date(F.lit(end).cast("timestamp")))
        before = self.read(name).where(days)
        touched = [r["date"] for r in before.select("date").distinct().collect()]  # the days of the range
        after = before.where(~inside).drop("date").unionByName(rows.select(*SCHEMAS[name].fieldNames())).checkpoint()
        left = {r["date"] for r in after.select(F.to_date("window_start").alias("date")).distinct().collect()}
        self._write(after, name, "overwrite")
        for day in set(touched) - left:  # a write replaces days that have rows
            self._remove(f"{self.path(name)}/date={day}")

    def insert_insights(self, insights: DataFrame) -> None:
        """Append those that are not there yet, by window, kind and entity."""
        keys = ["window_start", "kind", "entity"]
        if self.exists("insights"):
            insights = insights.join(self.read("insights").select(*keys), keys, "left_anti")
        self._write(insights, "insights", "append")

    def rebuild_rollups(self) -> None:
        """Minute, hour and day rollups of all events; each coarser one from the finer. Deltas are in the events, so they go."""
        self._remove(f"{self.root}/deltas")
        minutes = rollups.rollup(self.read("events"), "minute")
        self._write(minutes, "aggregates_1m", "overwrite")
        hours = rollups.coarsen(self.read("aggregates_1m"), "hour")
        self._write(hours, "summary_hourly", "overwrite")
        self._write(rollups.coarsen(self.read("summary_hourly"), "day"), "region_daily", "overwrite")

    def counts(self) -> DataFrame:
        from tidemark.operators.aggregates import table_counts

        return table_counts({name: self.read(name) for name in ("events", "aggregates_1m", "summary_hourly", "insights")})

    def write_jdbc(self, name: str, url: str, table: str, properties: dict[str, str] | None = None) -> None:
        """Copy a table out, overwriting: a rebuilt summary is not appended to its old self."""
        self.read(name).drop("date").write.jdbc(url, table, mode="overwrite", properties=properties or {})

    def health(self) -> str:
        return json.dumps({"ok": self.ping(), "at": datetime.now(timezone.utc).isoformat()})


class JdbcStore:
    """The same tables in a database: scans by ranges of time in parallel, appends and overwrites through Spark's JDBC source."""

    def __init__(self, spark: SparkSession, url: str, properties: dict[str, str] | None = None):
        self.spark, self.url, self.properties = spark, url, properties or {}

    def ping(self) -> bool:
        return self.spark.range(1).count() == 1

    def write(self, df: DataFrame, name: str, mode: str = "append") -> None:
        df.select(*SCHEMAS[name].fieldNames()).write.jdbc(self.url, name, mode=mode, properties=self.properties)

    def read(self, name: str, bounds: list | None = None) -> DataFrame:
        """A table; between ``bounds`` of its time, one task for each range, where given."""
        if bounds is None:
            return self.spark.read.jdbc(self.url, name, properties=self.properties)
        from tidemark.sources.readers import jdbc_scan

        return jdbc_scan(self.spark, self.url, name, f'"{TIME[name]}"', bounds, self.properties)

    def counts(self) -> DataFrame:
        from tidemark.operators.aggregates import table_counts

        return table_counts({name: self.read(name) for name in ("events", "summary_hourly")})


def open_store(spark: SparkSession, storage: Storage = Storage(), properties: dict[str, str] | None = None) -> Store | JdbcStore:
    """The store that the settings name."""
    backend = storage.backend if storage.backend != "auto" else "jdbc" if storage.jdbc_url else "parquet"
    if backend == "parquet":
        return Store(spark, storage.warehouse)
    if backend == "jdbc" and storage.jdbc_url:
        return JdbcStore(spark, storage.jdbc_url, properties)
    raise ValueError(f"no store for backend {storage.backend!r} and URL {storage.jdbc_url!r}")
