"""Streams against batch."""

import json
from datetime import datetime, timedelta

from pyspark.sql import functions as F

from tidemark.operators import rollups, transform
from tidemark.operators.hot import HotTable
from tidemark.operators.metrics import ProgressLog, RequestLog, described
from tidemark.sources import generator, readers
from tidemark.sources.store import Store
from tidemark.streaming import detectors, jobs


def files(spark, path, n=3, rows=900):
    raw = generator.bulk(spark, rows, seed=5, spread_seconds=1800, ordered=False)
    for i in range(n):
        low, high = (datetime(2024, 1, 1) + timedelta(seconds=1800 * k / n) for k in (i, i + 1))
        part = raw.where((F.col("ts") >= F.lit(low)) & (F.col("ts") < F.lit(high)))
        part.coalesce(1).write.mode("append").json(path)
    return raw


def test_stream_equals_batch_and_replays(spark, tmp_path):
    raw = files(spark, f"{tmp_path}/in")
    store = Store(spark, f"file://{tmp_path}/store")
    stream = jobs.windowed(transform.transform(readers.json_stream(spark, f"{tmp_path}/in", 1)))
    sink = jobs.replace_sink(store, "aggregates_1m")
    jobs.start(stream, f"{tmp_path}/check", sink, once=True).awaitTermination()
    expected = sorted(map(tuple, rollups.rollup(transform.transform(raw), "minute").collect()))
    got = store.read("aggregates_1m").drop("date")
    assert sorted(map(tuple, got.collect())) == expected
    sink(got.limit(5).checkpoint(), 99)  # a replayed batch
    assert sorted(map(tuple, store.read("aggregates_1m").drop("date").collect())) == expected


def test_events_sink_is_idempotent(spark, tmp_path):
    raw = transform.transform(generator.bulk(spark, 300, seed=9, spread_seconds=600))
    store, hot, latencies = Store(spark, f"file://{tmp_path}/store"), HotTable(), []
    write = jobs.events_sink(store, hot, latencies)
    half = F.crc32(F.col("event_id").cast("binary")) % 2 == 0
    for batch, i in ((raw.where(half), 0), (raw.where(half), 0), (raw, 1), (raw, 1)):
        write(batch, i)
    assert store.read("events").count() == 300
    expected = sorted(map(tuple, rollups.rollup(raw, "minute").collect()))
    assert sorted(map(tuple, store.current().collect())) == expected
    assert store.current("hour").agg(F.sum("events")).first()[0] == 300
    assert hot.totals(0)["events"] == 300
    store.rebuild_rollups()
    assert sorted(map(tuple, store.current().collect())) == expected


def test_latency_from_creation_to_visibility(spark, tmp_path):
    """Created a second before the batch: no event takes less until it is in the tables."""
    raw = generator.bulk(spark, 50, seed=2).withColumn("created_ns", F.unix_micros(F.current_timestamp()) * 1000 - 1_000_000_000)
    kept = transform.transform(raw).join(raw.select("event_id", "created_ns"), "event_id")
    latencies = []
    jobs.events_sink(Store(spark, f"file://{tmp_path}/store"), None, latencies)(kept.checkpoint(), 0)
    assert latencies[0]["n"] == 50 and 1000 <= latencies[0]["p50"] <= latencies[0]["max"] < 120_000


def test_a_stream_feeds_the_hot_table(spark, tmp_path):
    raw = files(spark, f"{tmp_path}/in")
    hot = HotTable()
    stream = jobs.windowed(transform.transform(readers.json_stream(spark, f"{tmp_path}/in", 1)))
    jobs.start(stream, f"{tmp_path}/check", jobs.hot_sink(hot), once=True).awaitTermination()
    minutes = rollups.rollup(transform.transform(raw), "minute")
    from tidemark.operators.hot import recent_aggregate

    assert hot.aggregate(20) == [r.asDict() for r in recent_aggregate(minutes, 20).collect()]


def test_late_rows_are_dropped_and_duplicates_too(spark, tmp_path):
    def write(i, seconds, ids):
        rows = [{"event_id": e, "ts": f"2024-01-01T00:{s // 60:02d}:{s % 60:02d}.000Z", "user_id": "u1", "session_id": "s", "event_type": "view", "region": "latam", "device": "mobile"} for e, s in zip(ids, seconds)]
        (tmp_path / "in").mkdir(exist_ok=True)
        (tmp_path / "in" / f"{i}.json").write_text("\n".join(map(json.dumps, rows)))

    out = []

    def run():
        stream = jobs.windowed(transform.dedupe_stream(transform.transform(readers.json_stream(spark, f"{tmp_path}/in", 1))), watermark=None)
        jobs.start(stream, f"{tmp_path}/check", lambda df, i: out.extend(df.collect()), mode="append", once=True).awaitTermination()

    write(0, [10, 20, 20], ["a", "b", "b"])
    run()
    write(1, [600], ["c"])
    run()
    write(2, [30], ["late"])
    run()
    assert [(r.window_start.minute, r.events) for r in out] == [(0, 2)]


def test_detectors_on_a_stream(spark, tmp_path):
    """All four kinds, in micro-batches, with the messages; a replayed batch adds nothing."""
    values = [100.0] * 9 + [900.0]
    rows = [(datetime(2024, 1, 1, 0, i), "latam", "purchase", 40, v) for i, v in enumerate(values)]
    rows += [(datetime(2024, 1, 1, 0, i), "us-east", "purchase", 1, 100.0) for i in range(10)] + [(datetime(2024, 1, 1, 0, 9), "latam", "refund", 9, 0.0)]
    df = spark.createDataFrame(rows, "window_start timestamp, region string, event_type string, events long, revenue double").withColumn("revenue", F.col("revenue").cast("decimal(24,4)"))
    for low, high in ((0, 4), (4, 8), (8, 10)):
        df.where((F.minute("window_start") >= low) & (F.minute("window_start") < high)).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
    store = Store(spark, f"file://{tmp_path}/store")
    sink = detectors.detect_sink(store)
    stream = spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in")
    jobs.start(stream, f"{tmp_path}/check", sink, mode="append", once=True).awaitTermination()
    sink(df.where(F.minute("window_start") >= 8), 2)
    got = sorted((r.kind, r.entity, r.window_start.minute) for r in store.read("insights").collect())
    assert got == [("anomaly_spike", "latam", 9), ("threshold", "refund_rate", 9), ("top_mover", "us-east", 9), ("trend_up", "latam", 9)]
    assert all(r.message for r in store.read("insights").collect())


def test_rate_and_bursts(spark):
    """Of each second's rows at the peak rate, all are kept in a burst and one in four outside; event time is scaled."""
    rows = 30 * 8  # of the rate source, at two events a second with bursts of four times as many
    rate = spark.range(rows).select(F.timestamp_seconds(F.col("id") / 8).alias("timestamp"), F.col("id").alias("value"))
    got = generator.paced_rows(rate, 2, burst_every=15, burst_duration=5, burst_multiplier=4, time_scale=10.0)
    seconds = [int((r.ts - datetime(2024, 1, 1)).total_seconds() // 10) for r in got.collect()]
    counts = [seconds.count(i) for i in range(30)]
    assert counts[:15] == [2] * 15 and counts[15:20] == [8] * 5 and counts[20:] == [2] * 10


def test_paced_generator_and_json(spark):
    stream = generator.paced(spark, 100)
    assert stream.isStreaming and stream.columns[-1] == "created_ns"
    raw = generator.bulk(spark, 20)
    back = readers.parse_json(readers.to_json(raw).select("value"))
    assert sorted(r.event_id for r in back.collect()) == sorted(r.event_id for r in raw.collect())


def test_logs(spark, tmp_path):
    log = ProgressLog(keep=2)
    spark.streams.addListener(log)
    try:
        files(spark, f"{tmp_path}/in")
        kept, _ = transform.observed_transform(readers.json_stream(spark, f"{tmp_path}/in", 1))
        jobs.start(kept, f"{tmp_path}/check", lambda df, i: df.write.format("noop").mode("overwrite").save(), mode="append", once=True).awaitTermination()
        spark._jsc.sc().listenerBus().waitUntilEmpty()
        import time

        for _ in range(50):
            if log.totals["queries_ended"]:
                break
            time.sleep(0.1)
    finally:
        spark.streams.removeListener(log)
    assert log.totals["rows"] == 900 == log.totals["events_in"] and log.totals["bad_region"] == 0
    assert len(log.reports) == 2 and log.summary()["batch_ms"]["count"] == 2
    requests = RequestLog(keep=3)
    for _ in range(5):
        requests.add("point", "store", 0.0)
    assert requests.answered["point", "store"] == 5 and requests.summary()["ms"]["store"]["count"] == 3
    assert described([1.0, 2.0, 3.0])["p50"] == 2.0 and described([])["max"] == 0.0
