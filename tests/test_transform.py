"""Validation and enrichment, by example and at the edges."""

from datetime import datetime
from decimal import Decimal

import pytest

from tidemark.operators import transform
from tidemark.schemas import EVENT_COLUMNS, RAW_EVENT

BASE = {
    "event_id": "e1", "ts": datetime(2026, 9, 4, 12, 30), "user_id": "u00001", "session_id": "s123", "event_type": "purchase",
    "region": "us-east", "device": "mobile", "amount": Decimal("100.00"), "created_ns": 0,
}


def raw(spark, *changes):
    return spark.createDataFrame([tuple((BASE | c)[f] for f in RAW_EVENT.fieldNames()) for c in changes], RAW_EVENT)


def test_purchase_is_enriched(spark):
    row = transform.transform(raw(spark, {})).first()
    assert row.asDict().keys() == dict.fromkeys(EVENT_COLUMNS).keys()
    assert (row.revenue, row.hour, row.day_of_week, row.amount_band) == (Decimal("32.0000"), 12, 4, "high")


@pytest.mark.parametrize(
    ("change", "reason"),
    [
        ({"event_type": "hack"}, "bad_event_type"), ({"event_type": None}, "bad_event_type"), ({"region": "mars"}, "bad_region"), ({"region": None}, "bad_region"),
        ({"device": "fridge"}, "bad_device"), ({"user_id": ""}, "missing_user"), ({"user_id": None}, "missing_user"), ({"amount": Decimal("-5")}, "negative_amount"),
        ({"amount": None}, "missing_amount"), ({"amount": Decimal(0)}, "missing_amount"), ({"event_type": "hack", "region": "mars"}, "bad_event_type"), ({"region": "mars", "amount": None}, "bad_region"),
    ],
)
def test_first_failing_rule(spark, change, reason):
    df = raw(spark, change)
    assert transform.classify(df).first()["reason"] == reason
    assert transform.transform(df).count() == 0


def test_view_without_amount_is_kept(spark):
    row = transform.transform(raw(spark, {"event_type": "view", "amount": None})).first()
    assert (row.revenue, row.amount_band, row.amount) == (Decimal("0.0000"), "none", None)


def test_refund_is_negative(spark):
    row = transform.transform(raw(spark, {"event_type": "refund", "region": "eu-central", "amount": Decimal(50)})).first()
    assert row.revenue == Decimal("-18.9000")


def test_drop_counts(spark):
    rows = raw(spark, *({"event_id": str(i)} for i in range(50)), {"region": "mars"})
    assert {r["reason"]: r["n"] for r in transform.drop_counts(rows).collect()} == {"valid": 50, "bad_region": 1}
    kept, seen = transform.observed_transform(rows)
    assert kept.count() == 50
    assert (seen.get["events_in"], seen.get["bad_region"], seen.get["bad_device"]) == (51, 1, 0)


def test_band_edges(spark):
    amounts = ["9.99", "10", "99.99", "100", "999.99", "1000"]
    rows = transform.transform(raw(spark, *({"event_id": str(i), "amount": Decimal(a)} for i, a in enumerate(amounts)))).orderBy("amount").collect()
    assert [r["amount_band"] for r in rows] == ["low", "mid", "mid", "high", "high", "premium"]


def test_join_form_is_equal(spark):
    df = raw(spark, {}, {"event_id": "e2", "region": "latam"}, {"event_id": "e3", "region": "mars"})
    assert sorted(map(tuple, transform.enrich_by_join(df).collect())) == sorted(map(tuple, transform.transform(df).collect()))


def test_dedupe_keeps_the_first_and_respects_what_is_there(spark):
    df = raw(spark, {"ts": datetime(2026, 1, 2)}, {"ts": datetime(2026, 1, 1)}, {"event_id": "e2"})
    assert {(r.event_id, r.ts.day) for r in transform.dedupe(df).collect()} == {("e1", 1), ("e2", 4)}
    assert [r.event_id for r in transform.dedupe(df, df.where("event_id = 'e1'")).collect()] == ["e2"]
