"""Column expressions of the event model, for batch and streaming alike."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from tidemark.constants import AMOUNT_BANDS, DEVICES, EVENT_TYPES, MONETARY, REGION_FX, REGIONS, TYPE_MARGIN


def _within(c: Column, values: tuple[str, ...]) -> Column:
    """Membership that is false, not null, for null."""
    return F.coalesce(c.isin(*values), F.lit(False))


def drop_reason() -> Column:
    """The first rule that an event breaks, in order; null for a valid event."""
    amount = F.col("amount")
    return (
        F.when(~_within(F.col("event_type"), EVENT_TYPES), "bad_event_type")
        .when(~_within(F.col("region"), REGIONS), "bad_region")
        .when(~_within(F.col("device"), DEVICES), "bad_device")
        .when(F.col("user_id").isNull() | (F.col("user_id") == ""), "missing_user")
        .when(amount < 0, "negative_amount")
        .when(F.col("event_type").isin(*MONETARY) & (amount.isNull() | (amount == 0)), "missing_amount")
    )


def _lookup(key: Column, values: dict[str, str]) -> Column:
    out = F.lit(None).cast("decimal(3,2)")
    for name, value in values.items():
        out = F.when(key == name, F.lit(value).cast("decimal(3,2)")).otherwise(out)
    return out


def fx_rate() -> Column:
    return _lookup(F.col("region"), REGION_FX)


def margin() -> Column:
    return _lookup(F.col("event_type"), TYPE_MARGIN)


def normal_amount() -> Column:
    return F.col("amount").cast("decimal(12,2)")


def revenue(rate: Column | None = None) -> Column:
    """Amount times margin times exchange rate in exact decimals, rounded half up to four digits; 0 without amount."""
    amount = F.coalesce(normal_amount(), F.lit(0).cast("decimal(12,2)"))
    return F.round(amount * margin() * (fx_rate() if rate is None else rate), 4).cast("decimal(14,4)")


def amount_band() -> Column:
    out = F.when(normal_amount().isNull(), "none")
    for name, below in AMOUNT_BANDS:
        out = out.when(normal_amount() < below, name)
    return out.otherwise("premium")


def hour_of_day() -> Column:
    return F.hour("ts").cast("int")


def day_of_week() -> Column:
    """Monday is 0."""
    return F.weekday("ts").cast("int")
