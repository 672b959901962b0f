"""The queries of the event engine and their oracle SQL.

Times are given out as texts, so that no session's zone can change them. Oracles are built from the definitions of the
operators in plain SQL over the tables, not from the Spark code.
"""

from __future__ import annotations

from collections.abc import Callable
from datetime import datetime, timedelta

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.constants import AMOUNT_BANDS, DEVICES, EVENT_TYPES, REGION_FX, REGIONS, TYPE_MARGIN
from tidemark.operators import aggregates, hot, insights, metrics, rollups, transform
from tidemark.plans import batch
from tidemark.schemas import ROLLUP
from tidemark.session import scratch
from tidemark.settings import Detection
from tidemark.sources import fixtures, generator
from tidemark.sources.store import Store

START, END = datetime(2024, 1, 8), datetime(2024, 1, 9)
ODD_START, ODD_END = datetime(2024, 1, 8, 3, 17, 30), datetime(2024, 1, 19, 21, 42, 5)
USER = "u00007"
DETECT = Detection(z_warning=2.0)
COOLED = Detection(z_warning=2.0, cooldown_seconds=3 * 86_400)


def _time(c: str) -> Column:
    return F.date_format(c, "yyyy-MM-dd HH:mm:ss").alias(c)


def _told(df: DataFrame) -> DataFrame:
    return df.select(*(_time(c) if c in ("ts", "window_start", "day") else F.col(c) for c in df.columns))


def _events(spark: SparkSession, d: str) -> DataFrame:
    return transform.transform(fixtures.raw_events(spark, d))


def _rollup(grain: str) -> Callable[[SparkSession, str], DataFrame]:
    return lambda s, d: _told(rollups.rollup(_events(s, d), grain))


def _hours(s: SparkSession, d: str) -> DataFrame:
    return rollups.rollup(_events(s, d), "hour")


def _days(s: SparkSession, d: str) -> DataFrame:
    return rollups.rollup(_events(s, d), "day")


def _enrich(s: SparkSession, d: str) -> DataFrame:
    return transform.transform(fixtures.dirty_events(s, d)).drop("session_id").withColumn("ts", F.date_format("ts", "yyyy-MM-dd HH:mm:ss.SSSSSS"))


def _delta_merge(s: SparkSession, d: str) -> DataFrame:
    e = _events(s, d)
    odd = F.crc32(F.col("event_id").cast("binary")) % 2 == 1
    return _told(rollups.merge_delta(rollups.rollup(e.where(odd), "hour"), rollups.rollup(e.where(~odd), "hour")))


def _replace(s: SparkSession, d: str) -> DataFrame:
    """Totals of the views so far, then of all events: the later ones stand."""
    e = _events(s, d)
    return _told(rollups.replace_by_key(rollups.rollup(e.where("event_type = 'view'"), "hour"), rollups.rollup(e, "hour")))


def _dedup(s: SparkSession, d: str) -> DataFrame:
    e = _events(s, d)
    return transform.dedupe(e.unionByName(e).unionByName(e.where("hour < 6"))).groupBy("event_type").agg(F.count("*").alias("events"), F.sum("revenue").cast(rollups.REVENUE).alias("revenue"))


def _insert_ignore(s: SparkSession, d: str) -> DataFrame:
    """Of all events, those that a store with the first half of the month would take."""
    e = _events(s, d)
    there = aggregates.half_open_range(e, datetime(2024, 1, 1), datetime(2024, 1, 16))
    return transform.dedupe(e, there).groupBy("event_type").agg(F.count("*").alias("events"))


def _detector(find: Callable[[DataFrame, Detection], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    return lambda s, d: _told(find(_days(s, d), DETECT).drop("message"))


def _cooldown(s: SparkSession, d: str) -> DataFrame:
    return _told(insights.cooldown(insights.trends(_days(s, d), DETECT), 3 * 86_400).drop("message"))


def _table_counts(s: SparkSession, d: str) -> DataFrame:
    e = _events(s, d)
    return aggregates.table_counts({"events": e, "aggregates_1m": rollups.rollup(e, "minute"), "summary_hourly": rollups.rollup(e, "hour"), "region_daily": rollups.rollup(e, "day")})


def _fx_join(s: SparkSession, d: str) -> DataFrame:
    e = transform.enrich_by_join(fixtures.raw_events(s, d))
    return e.groupBy(F.col("region").alias("dim")).agg(F.sum("revenue").cast(rollups.REVENUE).alias("revenue"))


def _latency(s: SparkSession, d: str) -> DataFrame:
    return metrics.latency_percentiles(fixtures.table(s, d, "events"), "value")


def _raw_files(s: SparkSession, d: str, folder: str) -> None:
    """The events in three files in order of time, the older first."""
    raw = fixtures.raw_events(s, d).drop("eid").withColumn("ts", F.col("ts").cast("timestamp"))
    for low, high in ((1, 10), (11, 20), (21, 31)):
        raw.where(F.dayofmonth("ts").between(low, high)).coalesce(1).write.mode("append").parquet(f"{folder}/in")


def _streamed(s: SparkSession, d: str, width: str, watermark: str | None, mode: str) -> DataFrame:
    """The rollup of a stream over the events in three micro-batches of an available-now query; later totals stand for earlier ones."""
    from tidemark.sources.readers import parquet_stream
    from tidemark.streaming import jobs

    folder = scratch(s, "tidemark-stream")
    _raw_files(s, d, folder)

    def sink(batch_df: DataFrame, batch_id: int) -> None:
        batch_df.write.mode("overwrite").parquet(f"{folder}/out/batch={batch_id:05d}")

    stream = jobs.windowed(transform.transform(parquet_stream(s, f"{folder}/in", 1)), width, watermark)
    jobs.start(stream, f"{folder}/checkpoint", sink, mode=mode, once=True).awaitTermination()
    rows = s.read.parquet(f"{folder}/out")
    if mode == "append":  # each window once
        return _told(rows.select(*rollups.KEYS, "events", "revenue"))
    last = rows.groupBy(*rollups.KEYS).agg(F.max("batch").alias("batch"))
    return _told(rows.join(last, [*rollups.KEYS, "batch"]).select(*rollups.KEYS, "events", "revenue"))


def _stored(s: SparkSession, d: str) -> Store:
    store = Store(s, scratch(s, "tidemark-store"))
    store.insert_events(_events(s, d).withColumn("ts", F.col("ts").cast("timestamp")))
    return store


def _batch_rebuild(s: SparkSession, d: str) -> DataFrame:
    """A summary that is stale for some hours inside a day, rebuilt for these; all others stay."""
    store = _stored(s, d)
    hours = rollups.rollup(store.read("events"), "hour")
    first, last = datetime(2024, 1, 8, 3), datetime(2024, 1, 9, 5)
    stale = (F.col("window_start") >= F.lit(first)) & (F.col("window_start") < F.lit(last))
    store._write(hours.withColumn("revenue", F.when(stale, F.lit(-1)).otherwise(F.col("revenue"))), "summary_hourly", "overwrite")
    batch.rebuild(store, first + timedelta(minutes=12), last - timedelta(minutes=5))
    return _told(store.read("summary_hourly").drop("date"))


def _rebuild_rollups(s: SparkSession, d: str) -> DataFrame:
    store = _stored(s, d)
    store.rebuild_rollups()
    return _told(store.read("region_daily").drop("date"))


def _thirds(events: DataFrame) -> list[DataFrame]:
    return [events.where(F.dayofmonth("ts").between(low, high)) for low, high in ((1, 10), (11, 20), (21, 31))]


def _store_deltas(s: SparkSession, d: str) -> DataFrame:
    """Events in three batches, one of them twice and one overlapping; a rebuild after the first. The rollup of base and deltas."""
    from tidemark.streaming import jobs

    events = _events(s, d).withColumn("ts", F.col("ts").cast("timestamp"))
    store = Store(s, scratch(s, "tidemark-deltas"))
    write = jobs.events_sink(store)
    for i, part in enumerate(_thirds(events)):
        write(part, i)
        write(part, i)
        if not i:
            store.rebuild_rollups()
    write(events.where(F.dayofmonth("ts") > 15), 3)
    return _told(store.current("hour"))


def _hot_table(s: SparkSession, d: str) -> DataFrame:
    """The hot table after three batches of deltas, the last third first, and a batch of totals."""
    minutes = rollups.rollup(_events(s, d).withColumn("ts", F.col("ts").cast("timestamp")), "minute")
    table = hot.HotTable()
    for part in _thirds(minutes.withColumnRenamed("window_start", "ts"))[::-1]:
        table.feed(part.withColumnRenamed("ts", "window_start"), delta=True)
    table.feed(minutes.where("event_type = 'view'"))
    return s.createDataFrame([(r["dim"], r["events"], r["revenue"]) for r in table.aggregate(30)], f"dim string, events bigint, revenue {rollups.REVENUE}")


def _route(s: SparkSession, d: str) -> DataFrame:
    """Each kind of request through the planner, with the backend that answered."""
    from tidemark.plans.router import QuerySpec, Router, Tables

    e = _events(s, d).withColumn("ts", F.col("ts").cast("timestamp"))
    router = Router(Tables(e, hot.HotTable().feed(rollups.rollup(e, "minute")), rollups.rollup(e, "hour")))
    day = {"start": START, "end": END}
    specs = {
        "point": QuerySpec("point", user_id=USER), "recent": QuerySpec("recent_agg", minutes=30), "recent_long": QuerySpec("recent_agg", minutes=500, **day),
        "heavy": QuerySpec("heavy_agg", **day), "repeat": QuerySpec("heavy_agg", **day), "heavy_device": QuerySpec("heavy_agg", group_by="device", **day), "filtered": QuerySpec("heavy_agg", group_by="event_type", region="latam", **day),
    }
    rows = []
    for name, spec in specs.items():
        found = router.route(spec)
        if name == "point":
            rows.append((name, found.backend, spec.user_id, len(found.rows), sum(r["revenue"] for r in found.rows)))
        else:
            rows += [(name, found.backend, r["dim"], r["events"], r["revenue"]) for r in found.rows]
    return s.createDataFrame(rows, f"request string, backend string, dim string, events bigint, revenue {rollups.REVENUE}")


def _detected(settings: Detection, message: bool, cool: bool) -> Callable[[SparkSession, str], DataFrame]:
    def run(s: SparkSession, d: str) -> DataFrame:
        found = insights.detect(_days(s, d), settings, cool)
        return _told(found if message else found.drop("message"))

    return run


def _insight_store(s: SparkSession, d: str) -> Store:
    """Closed days in three micro-batches of a stream, one file each, through the sink that detects."""
    from tidemark.streaming import detectors, jobs

    folder = scratch(s, "tidemark-insights")
    days = _days(s, d).withColumn("window_start", F.col("window_start").cast("timestamp")).withColumnRenamed("window_start", "ts")
    for part in _thirds(days):
        part.withColumnRenamed("ts", "window_start").coalesce(1).write.mode("append").parquet(f"{folder}/in")
    store = Store(s, f"{folder}/store")
    stream = s.readStream.schema(ROLLUP).option("maxFilesPerTrigger", 1).parquet(f"{folder}/in")
    sink = detectors.detect_sink(store, COOLED, lookback=timedelta(days=40))
    jobs.start(stream, f"{folder}/checkpoint", sink, mode="append", once=True).awaitTermination()
    return store


def _stream_insights(s: SparkSession, d: str) -> DataFrame:
    return _told(_insight_store(s, d).read("insights").drop("date", "message"))


def _latest_insights(s: SparkSession, d: str) -> DataFrame:
    return _told(aggregates.latest_insights(_insight_store(s, d).read("insights"), 7).drop("date", "message"))


def _generated(s: SparkSession, d: str) -> DataFrame:
    """What holds of generated events whatever the seed: as many as asked for in any partitioning, all valid, within their time, with amounts where money moves."""
    one, other = (transform.transform(generator.bulk(s, 20_000, seed=5, partitions=n, ordered=False)) for n in (3, 8))
    both = one.select("event_id", "ts", "amount").exceptAll(other.select("event_id", "ts", "amount"))
    money = F.col("event_type").isin("purchase", "refund")
    return one.agg(
        F.count("*").alias("events"), F.count_distinct("event_id").alias("ids"), F.count_if(F.col("amount").isNotNull() != money).alias("odd_amounts"),
        F.count_if(~F.date_format("ts", "yyyy-MM-dd").eqNullSafe(F.lit("2024-01-01"))).alias("other_days"), F.count_distinct("region", "device", "event_type").alias("kinds"),
    ).withColumn("unlike", both.agg(F.count("*")).scalar())


def _range_rows(s: SparkSession, d: str) -> DataFrame:
    rows = aggregates.closed_range(_events(s, d), ODD_START, datetime(2024, 1, 8, 9))
    return rows.drop("session_id").withColumn("ts", F.date_format("ts", "yyyy-MM-dd HH:mm:ss.SSSSSS"))


def _lines(s: SparkSession, d: str) -> DataFrame:
    return _told(rollups.rollup(transform.transform(fixtures.line_events(s, d)), "day"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "summary_agg_region": lambda s, d: aggregates.summary_aggregate(_hours(s, d), START, END),
    "summary_agg_event_type": lambda s, d: aggregates.summary_aggregate(_hours(s, d), START, END, "event_type"),
    "enrich_events": _enrich,
    "drop_reasons": lambda s, d: transform.drop_counts(fixtures.dirty_events(s, d)),
    **{f"raw_agg_{g}": (lambda s, d, g=g: aggregates.raw_aggregate(_events(s, d), START, END, g)) for g in ("region", "event_type", "device", "hour")},
    "raw_agg_filtered": lambda s, d: aggregates.raw_aggregate(_events(s, d), ODD_START, ODD_END, "device", "us-east", "purchase"),
    **{f"rollup_{g}": _rollup(g) for g in ("minute", "hour", "day")},
    "rollup_day_from_hour": lambda s, d: _told(rollups.coarsen(_hours(s, d), "day")),
    "rollup_lines": _lines,
    "summary_exact_edges": lambda s, d: aggregates.exact_aggregate(_events(s, d), _hours(s, d), ODD_START, ODD_END),
    "delta_merge": _delta_merge,
    "replace_by_key": _replace,
    "dedup_events": _dedup,
    "insert_ignore": _insert_ignore,
    "point_user_events": lambda s, d: _told(aggregates.user_events(_events(s, d), USER).select("event_id", "ts", "user_id", "event_type", "region", "device", "amount", "revenue")),
    "sample_user": lambda s, d: _events(s, d).agg(F.min("user_id").alias("user_id")),
    "hot_recent_30": lambda s, d: hot.recent_aggregate(rollups.rollup(_events(s, d), "minute"), 30),
    "hot_totals": lambda s, d: hot.recent_totals(rollups.rollup(_events(s, d), "minute"), 60, event_type="purchase"),
    "hot_last_window": lambda s, d: _told(hot.last_window(rollups.rollup(_events(s, d), "minute"))),
    "table_counts": _table_counts,
    "refund_rate": lambda s, d: aggregates.refund_rate(_events(s, d)),
    "top_region": lambda s, d: aggregates.top_region(_hours(s, d)),
    "batch_report": lambda s, d: batch.report(batch.summarize(_events(s, d), START, datetime(2024, 1, 20))),
    "fx_broadcast_join": _fx_join,
    "insight_anomaly": _detector(insights.anomalies),
    "insight_trend": _detector(insights.trends),
    "insight_threshold": _detector(insights.refund_rates),
    "insight_top_mover": _detector(insights.top_movers),
    "insight_cooldown": _cooldown,
    "latency_percentiles": _latency,
    "range_rows": _range_rows,
    "batch_half_open": lambda s, d: _told(batch.summarize(_events(s, d), START, END)),
    "stream_rollup_minute": lambda s, d: _streamed(s, d, "1 minute", None, "update"),
    "stream_rollup_hour": lambda s, d: _streamed(s, d, "1 hour", "30 seconds", "update"),
    "stream_closed_minutes": lambda s, d: _streamed(s, d, "1 minute", "30 seconds", "append"),
    "stream_insights": _stream_insights,
    "latest_insights": _latest_insights,
    "detect_messages": _detected(DETECT, True, False),
    "detect_cooled": _detected(COOLED, False, True),
    "batch_rebuild": _batch_rebuild,
    "rebuild_rollups": _rebuild_rollups,
    "store_deltas": _store_deltas,
    "hot_table": _hot_table,
    "route_kinds": _route,
    "generated_events": _generated,
}


def _oracles() -> dict[str, str]:
    case = lambda c, values: "CASE " + c + " " + " ".join(f"WHEN '{k}' THEN CAST({v} AS DECIMAL(3,2))" for k, v in values.items()) + " END"
    pick = lambda values: "[" + ", ".join(f"'{v}'" for v in values) + "]"
    among = lambda c, values: f"coalesce({c} IN (" + ", ".join(f"'{v}'" for v in values) + "), false)"
    money = "DECIMAL(12,2)"
    raw = f"""raw AS (
  SELECT event_id AS eid, CAST(event_id AS VARCHAR) AS event_id, ts, printf('u%05d', user_id) AS user_id, kind AS event_type, {pick(REGIONS)}[n_regionkey + 1] AS region,
         {pick(DEVICES)}[event_id % 3 + 1] AS device, CASE WHEN kind IN ('purchase', 'refund') THEN CAST(value AS {money}) END AS amount
  FROM (SELECT *, CASE event_type WHEN 'signup' THEN 'add_to_cart' WHEN 'error' THEN CASE WHEN event_id % 7 = 0 THEN 'refund' ELSE 'view' END ELSE event_type END AS kind FROM events) e
  JOIN customer ON c_custkey = e.user_id JOIN nation ON n_nationkey = c_nationkey)"""
    dirty = f"""dirty AS (
  SELECT eid, event_id, ts, CASE WHEN eid % 101 = 0 THEN '' ELSE user_id END AS user_id, CASE WHEN eid % 89 = 0 THEN 'hack' WHEN eid % 83 = 0 THEN NULL ELSE event_type END AS event_type,
         CASE WHEN eid % 97 = 0 THEN 'mars' ELSE region END AS region, CASE WHEN eid % 103 = 0 THEN 'fridge' ELSE device END AS device,
         CASE WHEN eid % 107 = 0 THEN CAST(-5 AS {money}) WHEN eid % 109 = 0 THEN CAST(0 AS {money}) WHEN eid % 113 = 0 THEN NULL ELSE amount END AS amount
  FROM raw)"""

    def judged(source: str) -> str:
        return f"""judged AS (
  SELECT *, CASE WHEN NOT {among("event_type", EVENT_TYPES)} THEN 'bad_event_type' WHEN NOT {among("region", REGIONS)} THEN 'bad_region' WHEN NOT {among("device", DEVICES)} THEN 'bad_device'
    WHEN user_id IS NULL OR user_id = '' THEN 'missing_user' WHEN amount < 0 THEN 'negative_amount'
    WHEN event_type IN ('purchase', 'refund') AND (amount IS NULL OR amount = 0) THEN 'missing_amount' END AS reason FROM {source})"""

    bands = " ".join(f"WHEN amount < {below} THEN '{name}'" for name, below in AMOUNT_BANDS)
    enriched = f"""e AS (
  SELECT event_id, ts, user_id, event_type, region, device, amount,
         CAST(round(coalesce(amount, CAST(0 AS {money})) * {case("event_type", TYPE_MARGIN)} * {case("region", REGION_FX)}, 4) AS DECIMAL(14,4)) AS revenue,
         CAST(hour(ts) AS INTEGER) AS hour, CAST(isodow(ts) - 1 AS INTEGER) AS day_of_week,
         CASE WHEN amount IS NULL THEN 'none' {bands} ELSE 'premium' END AS amount_band
  FROM judged WHERE reason IS NULL)"""
    clean = f"WITH {raw}, {judged('raw')}, {enriched}"
    soiled = f"WITH {raw}, {dirty}, {judged('dirty')}, {enriched}"
    sums = "CAST(count(*) AS BIGINT) AS events, CAST(coalesce(sum(revenue), 0) AS DECIMAL(24,4)) AS revenue"
    text = "strftime({}, '%Y-%m-%d %H:%M:%S')"
    at = lambda t: f"TIMESTAMP '{t}'"

    def grouped(dim: str, where: str) -> str:
        return f"{clean} SELECT CAST({dim} AS VARCHAR) AS dim, {sums} FROM e WHERE {where} GROUP BY {dim}"

    def rolled(grain: str, where: str = "true") -> str:
        return f"SELECT date_trunc('{grain}', ts) AS window_start, region, event_type, {sums} FROM e WHERE {where} GROUP BY ALL"

    def rolled_text(grain: str, where: str = "true", head: str = clean) -> str:
        return f"{head} SELECT {text.format('window_start')} AS window_start, region, event_type, events, revenue FROM ({rolled(grain, where)})"

    closed = lambda a, b: f"ts BETWEEN {at(a)} AND {at(b)}"
    hours = f"date_trunc('hour', ts) BETWEEN {at(START)} AND {at(END)}"
    minutes = f"{clean}, m AS ({rolled('minute')}), last AS (SELECT *, dense_rank() OVER (ORDER BY window_start DESC) AS r FROM m)"
    regions = f"{clean}, v AS (SELECT date_trunc('day', ts) AS w, region, CAST(sum(revenue) AS DOUBLE) AS v FROM e GROUP BY ALL)"
    c = DETECT
    out = f"{text.format('w')} AS window_start"
    trend = f"""t AS (
  SELECT w, region, v, n, CASE WHEN mean = 0 THEN 1 ELSE mean END AS mean, slope FROM (
    SELECT w, region, v, count(*) OVER f AS n, avg(v) OVER f AS mean, regr_slope(v, i) OVER f AS slope
    FROM (SELECT *, row_number() OVER (PARTITION BY region ORDER BY w) AS i FROM v) WINDOW f AS (PARTITION BY region ORDER BY w ROWS BETWEEN {c.baseline_windows - 1} PRECEDING AND CURRENT ROW))
  WHERE n >= {c.trend_least}),
tr AS (SELECT w, CASE WHEN slope > 0 THEN 'trend_up' ELSE 'trend_down' END AS kind, 'info' AS severity, region AS entity, 'revenue' AS metric, round(v, 2) AS value, round(mean, 2) AS baseline,
  printf('revenue of %s is %s: %+.0f%% over %d windows', region, CASE WHEN slope > 0 THEN 'rising' ELSE 'falling' END, slope * n / abs(mean) * 100, n) AS message
  FROM t WHERE abs(slope * n / abs(mean)) >= {c.trend_share})"""
    columns = "kind, severity, entity, metric, value, baseline"
    line_raw = f"""raw AS (
  SELECT l_orderkey || '-' || l_linenumber AS event_id, l_shipdate AS ts, printf('u%05d', c_custkey) AS user_id, CASE WHEN l_returnflag = 'R' THEN 'refund' ELSE 'purchase' END AS event_type,
         {pick(REGIONS)}[n_regionkey + 1] AS region, {pick(DEVICES)}[l_linenumber % 3 + 1] AS device, CAST(round(CAST(l_extendedprice AS {money}) * (1 - CAST(l_discount AS DECIMAL(4,2))), 2) AS {money}) AS amount
  FROM lineitem JOIN orders ON o_orderkey = l_orderkey JOIN customer ON c_custkey = o_custkey JOIN nation ON n_nationkey = c_nationkey)"""
    lines = f"WITH {line_raw}, {judged('raw')}, {enriched}"
    ranks = ", ".join(f"min(CASE WHEN i = 1 + CAST(round_even({p} / 100.0 * (n - 1), 0) AS BIGINT) THEN value END) AS p{p}" for p in metrics.PERCENTILES)
    counts = " UNION ALL ".join(f"SELECT '{name}' AS table_name, count(*) AS n FROM ({body})" for name, body in (("events", "SELECT * FROM e"), ("aggregates_1m", rolled("minute")), ("summary_hourly", rolled("hour")), ("region_daily", rolled("day"))))
    anomaly = f"""b AS (
  SELECT w, region, v, count(*) OVER f AS n, avg(v) OVER f AS mean, stddev_pop(v) OVER f AS std FROM v
  WINDOW f AS (PARTITION BY region ORDER BY w ROWS BETWEEN {c.baseline_windows} PRECEDING AND 1 PRECEDING)),
z AS (SELECT *, (v - mean) / greatest(std, 0.01 * abs(mean), 1e-6) AS z FROM b WHERE n >= {c.baseline_least}),
an AS (SELECT w, CASE WHEN z > 0 THEN 'anomaly_spike' ELSE 'anomaly_drop' END AS kind, CASE WHEN abs(z) >= {c.z_critical} THEN 'critical' ELSE 'warning' END AS severity, region AS entity,
  'revenue' AS metric, round(v, 2) AS value, round(mean, 2) AS baseline,
  printf('revenue of %s stands %.1f deviations %s its mean (%.2f, mean %.2f)', region, abs(z), CASE WHEN z > 0 THEN 'above' ELSE 'below' END, v, mean) AS message FROM z WHERE abs(z) >= {c.z_warning})"""
    threshold = f"""k AS (SELECT date_trunc('day', ts) AS w, count(*) FILTER (event_type = 'purchase') AS p, count(*) FILTER (event_type = 'refund') AS r FROM e GROUP BY 1),
th AS (SELECT w, 'threshold' AS kind, 'warning' AS severity, 'refund_rate' AS entity, 'refund_rate' AS metric, round(r / p, 4) AS value, CAST({c.refund_rate} AS DOUBLE) AS baseline,
  printf('%d refunds for %d purchases: %.1f%%, over the limit of %.0f%%', r, p, r / p * 100, {c.refund_rate * 100}) AS message FROM k WHERE p >= {c.refund_purchases} AND r / p > {c.refund_rate})"""
    mover = f"""tot AS (SELECT w, sum(v) AS total, row_number() OVER (ORDER BY w) AS i FROM v GROUP BY w),
s AS (SELECT i, v.w, region, v / total AS share FROM v JOIN tot USING (w) WHERE total > 0),
pairs AS (SELECT s.*, coalesce(p.share, 0) AS was FROM s JOIN tot q ON q.i = s.i - 1 AND q.total > 0 LEFT JOIN s p ON p.i = s.i - 1 AND p.region = s.region),
first AS (SELECT *, row_number() OVER (PARTITION BY w ORDER BY list_position({pick(REGIONS)}, region)) AS r FROM pairs WHERE abs(share - was) >= {c.mover_share}),
mv AS (SELECT w, 'top_mover' AS kind, 'info' AS severity, region AS entity, 'revenue_share' AS metric, round(share, 4) AS value, round(was, 4) AS baseline,
  printf('%s %s revenue share: %.1f%% after %.1f%%', region, CASE WHEN share > was THEN 'gained' ELSE 'lost' END, share * 100, was * 100) AS message FROM first WHERE r = 1)"""
    detected = f"{anomaly}, {trend}, {threshold}, {mover}, found AS (SELECT * FROM an UNION ALL SELECT * FROM tr UNION ALL SELECT * FROM th UNION ALL SELECT * FROM mv)"
    daily = "v AS (SELECT date_trunc('day', ts) AS w, region, CAST(sum(revenue) AS DOUBLE) AS v FROM e GROUP BY ALL)"
    cooled = f"""WITH RECURSIVE {raw}, {judged("raw")}, {enriched}, {daily}, {detected},
keyed AS (
  SELECT *, CASE WHEN kind LIKE 'anomaly%' THEN 'anomaly' WHEN kind LIKE 'trend%' THEN 'trend' ELSE kind END || metric || CASE WHEN kind = 'top_mover' THEN '' ELSE entity END AS key FROM found),
kept AS (
  SELECT key, min(w) AS w FROM keyed GROUP BY key
  UNION ALL
  SELECT key, w FROM (SELECT f.key, f.w, row_number() OVER (PARTITION BY f.key ORDER BY f.w) AS r FROM keyed f JOIN kept k ON k.key = f.key AND f.w >= k.w + INTERVAL 3 DAY) WHERE r = 1)
SELECT {out}, {columns} FROM (SELECT DISTINCT key, w FROM kept) JOIN keyed USING (key, w)"""
    routed = lambda name, backend, dim, where: f"SELECT '{name}' AS request, '{backend}' AS backend, {dim} AS dim, {sums} FROM e WHERE {where} GROUP BY {dim}"
    exact = closed(START, END)
    routes = " UNION ALL ".join((
        f"SELECT 'point' AS request, 'store.indexed' AS backend, '{USER}' AS dim, count(*) AS events, CAST(sum(revenue) AS DECIMAL(24,4)) AS revenue FROM (SELECT revenue FROM e WHERE user_id = '{USER}' ORDER BY e.ts DESC, event_id DESC LIMIT 50)",
        "SELECT 'recent', 'memory.hot_layer', region, CAST(sum(events) AS BIGINT), CAST(sum(revenue) AS DECIMAL(24,4)) FROM last WHERE r <= 30 GROUP BY region",
        routed("recent_long", "store.summary", "region", hours), routed("heavy", "store.summary", "region", hours), routed("repeat", "cache", "region", hours),
        routed("heavy_device", "store.raw_scan", "device", exact), routed("filtered", "store.summary", "event_type", hours + " AND region = 'latam'"),
    ))
    return {
        "summary_agg_region": grouped("region", hours),
        "summary_agg_event_type": grouped("event_type", hours),
        "enrich_events": f"{soiled} SELECT * REPLACE (strftime(ts, '%Y-%m-%d %H:%M:%S.%f') AS ts) FROM e",
        "drop_reasons": f"{soiled} SELECT coalesce(reason, 'valid') AS reason, count(*) AS n FROM judged GROUP BY 1",
        **{f"raw_agg_{g}": grouped(g, closed(START, END)) for g in ("region", "event_type", "device", "hour")},
        "raw_agg_filtered": grouped("device", closed(ODD_START, ODD_END) + " AND region = 'us-east' AND event_type = 'purchase'"),
        **{f"rollup_{g}": rolled_text(g) for g in ("minute", "hour", "day")},
        "rollup_day_from_hour": rolled_text("day"),
        "rollup_lines": rolled_text("day", head=lines),
        "summary_exact_edges": grouped("region", closed(ODD_START, ODD_END)),
        "delta_merge": rolled_text("hour"),
        "replace_by_key": rolled_text("hour"),
        "dedup_events": f"{clean} SELECT event_type, {sums} FROM e GROUP BY event_type",
        "insert_ignore": f"{clean} SELECT event_type, count(*) AS events FROM e WHERE ts >= TIMESTAMP '2024-01-16' GROUP BY event_type",
        "point_user_events": f"{clean} SELECT event_id, {text.format('ts')} AS ts, user_id, event_type, region, device, amount, revenue FROM (SELECT * FROM e WHERE user_id = '{USER}' ORDER BY e.ts DESC, event_id DESC LIMIT 50)",
        "sample_user": f"{clean} SELECT min(user_id) AS user_id FROM e",
        "hot_recent_30": f"{minutes} SELECT region AS dim, CAST(sum(events) AS BIGINT) AS events, CAST(sum(revenue) AS DECIMAL(24,4)) AS revenue FROM last WHERE r <= 30 GROUP BY region",
        "hot_totals": f"{minutes} SELECT CAST(coalesce(sum(events) FILTER (event_type = 'purchase'), 0) AS BIGINT) AS events, CAST(coalesce(sum(revenue) FILTER (event_type = 'purchase'), 0) AS DECIMAL(24,4)) AS revenue, count(DISTINCT window_start) AS windows FROM last WHERE r <= 60",
        "hot_last_window": f"{minutes} SELECT {text.format('window_start')} AS window_start, region, event_type, events, revenue FROM last WHERE r = 1",
        "table_counts": f"{clean} {counts}",
        "refund_rate": f"{clean} SELECT count(*) FILTER (event_type = 'purchase') AS purchases, count(*) FILTER (event_type = 'refund') AS refunds, round(count(*) FILTER (event_type = 'refund') / nullif(count(*) FILTER (event_type = 'purchase'), 0), 6) AS refund_rate FROM e",
        "top_region": f"{clean} SELECT region, {sums} FROM e GROUP BY region ORDER BY revenue DESC, region LIMIT 1",
        "batch_report": f"""{clean}, s AS (SELECT * FROM e WHERE ts >= {at(START)} AND ts < TIMESTAMP '2024-01-20'),
top AS (SELECT region, CAST(sum(revenue) AS DECIMAL(24,4)) AS revenue FROM s GROUP BY region ORDER BY revenue DESC, region DESC LIMIT 1)
SELECT count(*) AS events, (SELECT region FROM top) AS top_region, (SELECT revenue FROM top) AS top_revenue, count(*) FILTER (event_type = 'purchase') AS purchases, count(*) FILTER (event_type = 'refund') AS refunds,
  round(count(*) FILTER (event_type = 'refund') / nullif(count(*) FILTER (event_type = 'purchase'), 0), 6) AS refund_rate FROM s""",
        "fx_broadcast_join": f"{clean} SELECT region AS dim, CAST(sum(revenue) AS DECIMAL(24,4)) AS revenue FROM e GROUP BY region",
        "insight_anomaly": f"{regions}, {anomaly} SELECT {out}, {columns} FROM an",
        "insight_trend": f"{regions}, {trend} SELECT {out}, {columns} FROM tr",
        "insight_threshold": f"{clean}, {threshold} SELECT {out}, {columns} FROM th",
        "insight_top_mover": f"{regions}, {mover} SELECT {out}, {columns} FROM mv",
        "insight_cooldown": f"""WITH RECURSIVE {raw}, {judged("raw")}, {enriched}, v AS (SELECT date_trunc('day', ts) AS w, region, CAST(sum(revenue) AS DOUBLE) AS v FROM e GROUP BY ALL), {trend},
kept AS (
  SELECT entity, min(w) AS w FROM tr GROUP BY entity
  UNION ALL
  SELECT entity, w FROM (SELECT tr.entity, tr.w, row_number() OVER (PARTITION BY tr.entity ORDER BY tr.w) AS r FROM tr JOIN kept k ON k.entity = tr.entity AND tr.w >= k.w + INTERVAL 3 DAY) WHERE r = 1)
SELECT {out}, {columns} FROM tr JOIN kept USING (entity, w)""",
        "latency_percentiles": f"""WITH r AS (SELECT value, row_number() OVER (ORDER BY value) AS i, count(*) OVER () AS n FROM events WHERE value IS NOT NULL)
SELECT max(n) AS n, round(avg(value), 6) AS mean, max(value) AS max, {ranks} FROM r""",
        "range_rows": f"{clean} SELECT * REPLACE (strftime(ts, '%Y-%m-%d %H:%M:%S.%f') AS ts) FROM e WHERE {closed(ODD_START, '2024-01-08 09:00:00')}",
        "batch_half_open": rolled_text("hour", f"ts >= {at(START)} AND ts < {at(END)}"),
        "stream_rollup_minute": rolled_text("minute"),
        "stream_rollup_hour": rolled_text("hour"),
        "stream_closed_minutes": rolled_text("minute", "date_trunc('minute', ts) + INTERVAL 1 MINUTE <= (SELECT date_trunc('milliseconds', max(ts)) - INTERVAL 30 SECOND FROM e)"),
        "detect_messages": f"{regions}, {detected} SELECT {out}, {columns}, message FROM found",
        "detect_cooled": cooled,
        "stream_insights": cooled,
        "latest_insights": f"{cooled} ORDER BY window_start DESC, kind, entity LIMIT 7",
        "batch_rebuild": rolled_text("hour"),
        "rebuild_rollups": rolled_text("day"),
        "store_deltas": rolled_text("hour"),
        "hot_table": f"{minutes} SELECT region AS dim, CAST(sum(events) AS BIGINT) AS events, CAST(sum(revenue) AS DECIMAL(24,4)) AS revenue FROM last WHERE r <= 30 GROUP BY region",
        "route_kinds": f"{minutes} {routes}",
        "generated_events": "SELECT " + ", ".join(f"CAST({n} AS BIGINT) AS {name}" for name, n in (("events", 20_000), ("ids", 20_000), ("odd_amounts", 0), ("other_days", 0), ("kinds", 75), ("unlike", 0))),
    }


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    return _oracles()
