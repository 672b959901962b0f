"""Rollups, the hot layer, aggregates, the store and the planner."""

from datetime import datetime, timedelta
from decimal import Decimal

import pytest

from tidemark.operators import aggregates, hot, metrics, rollups, transform
from tidemark.plans import batch
from tidemark.plans.router import Answers, QuerySpec, Router, RouteResult, Tables, plan
from tidemark.schemas import ENRICHED_EVENT, INSIGHT, ROLLUP
from tidemark.settings import Detection, Serving, Settings, Storage, load
from tidemark.sources import generator
from tidemark.sources.seed import seed
from tidemark.sources.store import JdbcStore, Store, open_store

START = datetime(2026, 9, 4, 12, 30)


def events(spark, n=5, step=timedelta(minutes=1)):
    rows = [(f"e{i}", START + i * step, f"u{i % 2}", "s", "purchase", "us-east", "mobile", Decimal(10), Decimal("3.2"), 12, 4, "mid") for i in range(n)]
    return spark.createDataFrame(rows, ENRICHED_EVENT)


@pytest.fixture(scope="module")
def generated(spark):
    return transform.transform(generator.bulk(spark, 5000, seed=3, partitions=4)).cache()


def test_upsert_twice_adds_up(spark):
    row = spark.createDataFrame([(START, "us-east", "purchase", 2, Decimal(64))], ROLLUP)
    r = rollups.merge_delta(row, row).collect()
    assert [(x.events, x.revenue) for x in r] == [(4, Decimal("128.0000"))]
    assert [(x.events, x.revenue) for x in rollups.replace_by_key(row, row).collect()] == [(2, Decimal("64.0000"))]


def test_coarser_rollups_agree(spark, generated):
    minutes = rollups.rollup(generated, "minute")
    assert sorted(map(tuple, rollups.coarsen(minutes, "hour").collect())) == sorted(map(tuple, rollups.rollup(generated, "hour").collect()))
    with pytest.raises(ValueError):
        rollups.rollup(generated, "week")


def test_exact_edges_equal_raw(generated):
    hours = rollups.rollup(generated, "hour")
    for a, b in ((0, 24 * 3600), (1800, 7300), (3600, 7200), (100, 200), (3599, 3601)):
        start, end = datetime(2024, 1, 1) + timedelta(seconds=a), datetime(2024, 1, 1) + timedelta(seconds=b)
        got = aggregates.exact_aggregate(generated, hours, start, end, "event_type").collect()
        assert sorted(map(tuple, got)) == sorted(map(tuple, aggregates.raw_aggregate(generated, start, end, "event_type").collect()))


def test_hot_layer(spark):
    minutes = rollups.rollup(events(spark), "minute")
    assert [tuple(r) for r in hot.recent_aggregate(minutes, 30).collect()] == [("us-east", 5, Decimal("16.0000"))]
    assert [r.events for r in hot.recent_aggregate(minutes, 2).collect()] == [2]
    assert hot.recent_aggregate(minutes, 0).first().events == 5
    assert hot.recent_totals(minutes, 3, event_type="view").first().asDict() == {"events": 0, "revenue": Decimal("0.0000"), "windows": 3}
    assert hot.last_window(minutes).first().window_start == START + timedelta(minutes=4)
    with pytest.raises(ValueError):
        hot.recent_aggregate(minutes, 5, group_by="device")


def test_hot_table_equals_the_expressions(spark, generated):
    minutes = rollups.rollup(generated.where("hour < 3"), "minute").cache()
    for serving in (Serving(), Serving(hot_minutes=7)):
        table = hot.HotTable(serving)
        for low in (0, 1, 2):
            table.feed(minutes.where(f"hour(window_start) = {low}"), delta=True)
        table.feed(minutes.where("minute(window_start) > 55 and region = 'latam'"))  # totals: no change
        for n in (1, 5, 7):
            for extra in ({}, {"region": "latam"}, {"event_type": "view"}):
                expected = hot.recent_aggregate(minutes, n, **extra, group_by="event_type").collect()
                assert table.aggregate(n, **extra, group_by="event_type") == [r.asDict() for r in expected]
                assert table.totals(n, **extra) == hot.recent_totals(minutes, n, **extra).first().asDict()
        assert table.rows.num_rows == hot.newest_windows(minutes, serving.hot_minutes).count()
        assert len(table.last_window()) == hot.last_window(minutes).count()
    table.feed(minutes.where("window_start is null"), delta=True)
    assert hot.HotTable().aggregate(5) == [] and hot.HotTable().totals(5)["windows"] == 0
    with pytest.raises(ValueError):
        table.aggregate(5, group_by="device")


def test_generator(spark, generated):
    again = generator.bulk(spark, 5000, seed=3, partitions=7)
    assert sorted(r.event_id for r in again.select("event_id").collect()) == sorted(r.event_id for r in generated.select("event_id").collect())
    ts = [r.ts for r in generator.bulk(spark, 500).select("ts").collect()]
    assert ts == sorted(ts)
    assert generator.bulk(spark, 500).where("(amount is not null) != (event_type in ('purchase', 'refund'))").count() == 0


def test_latency_percentiles_are_nearest_rank(spark):
    values = [float(x) / 3 for x in (5, 1, 9, 9, 2, 7, 30, 4)]
    row = metrics.latency_percentiles(spark.createDataFrame([(v,) for v in values] + [(None,)], "x double"), "x").first()
    assert [row[f"p{p}"] for p in metrics.PERCENTILES] == [metrics.nearest_rank(values, p) for p in metrics.PERCENTILES]
    assert (row["n"], row["max"]) == (8, 10.0)
    small = [i / 100_000 for i in range(3000)] + [5.0] * 40  # all but one within one unit
    row = metrics.latency_percentiles(spark.createDataFrame([(v,) for v in small], "x double"), "x").first()
    assert [row[f"p{p}"] for p in metrics.PERCENTILES] == [metrics.nearest_rank(small, p) for p in metrics.PERCENTILES]
    row = metrics.latency_percentiles(spark.createDataFrame([], "x double"), "x").first()
    assert (row["n"], row["mean"], row["p50"]) == (0, None, None)


def test_store_and_planner(spark, tmp_path):
    store = Store(spark, f"file://{tmp_path}/store")
    store.create()
    store.create()
    assert store.counts().where("n > 0").count() == 0
    store.insert_events(events(spark))
    store.insert_events(events(spark, 6))
    store.rebuild_rollups()
    assert {r.table_name: r.n for r in store.counts().collect()} == {"events": 6, "aggregates_1m": 6, "summary_hourly": 1, "insights": 0}
    delta = spark.createDataFrame([(START, "us-east", "purchase", 2, Decimal(1))], ROLLUP)
    store.replace("aggregates_1m", delta)
    store.replace("aggregates_1m", delta)
    assert store.read("aggregates_1m").where("events = 2").count() == 1
    store.add("aggregates_1m", delta)
    assert store.read("aggregates_1m").where("events = 4 and revenue = 2").count() == 1
    store.insert_insights(spark.createDataFrame([(START, "threshold", "warning", "refund_rate", "refund_rate", 0.1, 0.05, "m")], INSIGHT))
    assert aggregates.latest_insights(store.read("insights"), 5).count() == 1
    assert aggregates.sample_user(store.read("events")) == "u0"

    clock = [0.0]
    router = Router(Tables(store.read("events"), store.read("aggregates_1m"), store.read("summary_hourly")), Serving(), lambda: clock[0])
    day = {"start": datetime(2026, 9, 4), "end": datetime(2026, 9, 5)}
    assert [e["event_id"] for e in router.route(QuerySpec("point", user_id="u1")).rows] == ["e5", "e3", "e1"]
    assert router.route(QuerySpec("recent_agg", minutes=30)).backend == "memory.hot_layer"
    assert router.route(QuerySpec("recent_agg", minutes=500, **day)).backend == "store.summary"
    first, second = router.route(QuerySpec("heavy_agg", **day)), router.route(QuerySpec("heavy_agg", **day))
    assert (first.backend, second.backend, second.cache_hit, second.rows) == ("store.summary", "cache", True, first.rows)
    clock[0] = 16
    assert router.route(QuerySpec("heavy_agg", **day)).backend == "store.summary"
    assert router.route(QuerySpec("heavy_agg", group_by="device", **day)).backend == "store.raw_scan"
    empty = {"start": datetime(2020, 1, 1), "end": datetime(2020, 1, 2)}
    assert router.route(QuerySpec("heavy_agg", **empty)).backend == "store.raw_scan"
    for bad in (QuerySpec("other"), QuerySpec("point"), QuerySpec("heavy_agg"), QuerySpec("recent_agg", group_by="device"), QuerySpec("heavy_agg", group_by="x", **day)):
        with pytest.raises(ValueError):
            router.route(bad)
    assert router.log.answered["heavy_agg", "store.summary"] == 2
    assert router.log.summary()["ms"]["cache"]["count"] == 1
    report = batch.rebuild(store, "2026-09-04 00:00:00", "2026-09-05 00:00:00").first()
    assert (report.events, report.top_region, report.refund_rate) == (6, "us-east", 0.0)


def test_a_plan_reads_nothing():
    """What answers a request is decided without tables."""
    day = {"start": datetime(2026, 9, 4), "end": datetime(2026, 9, 5)}
    backends = lambda q, **s: [p.backend for p in plan(q, Serving(**s))]
    assert backends(QuerySpec("heavy_agg", **day)) == ["store.summary", "store.raw_scan"]
    assert backends(QuerySpec("heavy_agg", group_by="hour", **day)) == ["store.raw_scan"]
    assert backends(QuerySpec("recent_agg", minutes=60)) == ["memory.hot_layer"]
    assert backends(QuerySpec("recent_agg", minutes=60), hot_minutes=59) == ["store.summary"]
    assert backends(QuerySpec("point", user_id="u")) == ["store.indexed"]


def test_rebuild_of_some_hours_leaves_the_others(spark, tmp_path):
    """A range inside a day: hours it touches are whole, all others stay, also those of a day that ends empty."""
    store = Store(spark, f"file://{tmp_path}/store")
    hourly = events(spark, 48, timedelta(hours=1))  # from 12:30 on, two days and a half
    store.insert_events(hourly)
    store.rebuild_rollups()
    before = sorted(map(tuple, store.read("summary_hourly").drop("date").collect()))
    report = batch.rebuild(store, datetime(2026, 9, 5, 3, 10), datetime(2026, 9, 5, 4, 50)).first()
    assert report.events == 2
    assert sorted(map(tuple, store.read("summary_hourly").drop("date").collect())) == before
    gone = spark.createDataFrame([], ROLLUP)
    store.replace_range("summary_hourly", gone, datetime(2026, 9, 5), datetime(2026, 9, 6))
    left = store.read("summary_hourly")
    assert left.count() == 24 and left.where("date = '2026-09-05'").count() == 0


def test_answers_go_by_age_and_use():
    clock = [0.0]
    kept = Answers(10, 2, lambda: clock[0])
    a, b, c = (QuerySpec("heavy_agg", region=x) for x in "abc")
    kept[a], kept[b] = RouteResult([{"n": 1}], "", ""), RouteResult([{"n": 2}], "", "")
    assert kept[a].rows == [{"n": 1}]
    kept[c] = RouteResult([{"n": 3}], "", "")
    assert (kept[a].rows, kept[b], kept[c].rows) == ([{"n": 1}], None, [{"n": 3}])
    clock[0] = 10.5
    assert kept[a] is None and kept[c] is None


def test_settings_layers(tmp_path):
    assert load(None, {}) == Settings()
    assert load(None, {"TIDEMARK_DETECTION__Z_WARNING": "7", "TIDEMARK_DETECTION__COOLDOWN_STRICT": "true", "TIDEMARK_OTHER__X": "1"}).detection == Detection(z_warning=7.0, cooldown_strict=True)
    assert load(str(tmp_path / "none.yaml"), {}) == Settings()
    pytest.importorskip("yaml")
    f = tmp_path / "c.yaml"
    f.write_text("serving:\n  cache_seconds: 3\n  unknown: 1\nother: 5\nstream:\n")
    assert load(str(f), {}).serving == Serving(cache_seconds=3.0)
    assert load(str(f), {"TIDEMARK_SERVING__CACHE_SECONDS": "4"}).serving.cache_seconds == 4.0
    f.write_text("")
    assert load(str(f), {}) == Settings()


def test_the_settings_name_the_store(spark, tmp_path):
    assert open_store(spark, Storage(warehouse=f"{tmp_path}/w")).root == f"{tmp_path}/w"
    assert open_store(spark, Storage(jdbc_url="jdbc:x:y")).url == "jdbc:x:y"
    assert isinstance(open_store(spark, Storage(backend="parquet", jdbc_url="jdbc:x:y")), Store)
    for bad in (Storage(backend="jdbc"), Storage(backend="other")):
        with pytest.raises(ValueError):
            open_store(spark, bad)


def test_seed(spark, tmp_path):
    store = seed(spark, f"file://{tmp_path}/w", 400, hours=2)
    assert {r.table_name: r.n for r in store.counts().collect()}["events"] == 400
    assert store.read("summary_hourly").agg({"events": "sum"}).first()[0] == 400


def test_jdbc_round_trip(spark, tmp_path):
    from tidemark.sources.readers import jdbc_scan

    url, driver = f"jdbc:derby:{tmp_path}/db;create=true", {"driver": "org.apache.derby.jdbc.EmbeddedDriver"}
    try:
        events(spark).select("event_id", "ts", "revenue").write.jdbc(url, "events", mode="overwrite", properties=driver)
    except Exception as e:  # no driver on the class path
        pytest.skip(str(e)[:80])
    got = jdbc_scan(spark, url, "events", '"ts"', ["2026-09-04 12:31:00", "2026-09-04 12:33:00", "2026-09-04 12:35:00"], driver)
    assert got.count() == 4 and got.rdd.getNumPartitions() == 2


def test_batch_between_databases(spark, tmp_path):
    store = JdbcStore(spark, f"jdbc:derby:{tmp_path}/db;create=true", {"driver": "org.apache.derby.jdbc.EmbeddedDriver"})
    try:
        store.write(events(spark, 40, timedelta(minutes=7)), "events", "overwrite")
    except Exception as e:  # no driver on the class path
        pytest.skip(str(e)[:80])
    report = batch.between_databases(store, "2026-09-04 13:00:00", "2026-09-04 15:00:00", 3).first()
    inside = sum(datetime(2026, 9, 4, 13) <= START + i * timedelta(minutes=7) < datetime(2026, 9, 4, 15) for i in range(40))
    assert (report.events, report.top_region) == (inside, "us-east")
    assert store.read("summary_hourly").count() == 2 and {r.table_name: r.n for r in store.counts().collect()}["events"] == 40
