"""Table schemas."""

from pyspark.sql import types as T

RAW_EVENT = T.StructType(
    [
        T.StructField("event_id", T.StringType()),
        T.StructField("ts", T.TimestampType()),
        T.StructField("user_id", T.StringType()),
        T.StructField("session_id", T.StringType()),
        T.StructField("event_type", T.StringType()),
        T.StructField("region", T.StringType()),
        T.StructField("device", T.StringType()),
        T.StructField("amount", T.DecimalType(12, 2)),
        T.StructField("created_ns", T.LongType()),
    ]
)
ENRICHED_EVENT = T.StructType(
    [
        *RAW_EVENT.fields[:8],
        T.StructField("revenue", T.DecimalType(14, 4)),
        T.StructField("hour", T.IntegerType()),
        T.StructField("day_of_week", T.IntegerType()),
        T.StructField("amount_band", T.StringType()),
    ]
)
EVENT_COLUMNS = ENRICHED_EVENT.fieldNames()
ROLLUP = T.StructType(
    [
        T.StructField("window_start", T.TimestampType()),
        T.StructField("region", T.StringType()),
        T.StructField("event_type", T.StringType()),
        T.StructField("events", T.LongType()),
        T.StructField("revenue", T.DecimalType(24, 4)),
    ]
)
INSIGHT = T.StructType(
    [
        T.StructField("window_start", T.TimestampType()),
        *(T.StructField(c, T.StringType()) for c in ("kind", "severity", "entity", "metric")),
        T.StructField("value", T.DoubleType()),
        T.StructField("baseline", T.DoubleType()),
        T.StructField("message", T.StringType()),
    ]
)
