"""Domain values shared by batch and streaming."""

# Fixed values of the event model.
EVENT_TYPES = ("view", "click", "add_to_cart", "purchase", "refund")
REGIONS = ("us-east", "us-west", "eu-central", "ap-south", "latam")
DEVICES = ("mobile", "desktop", "tablet")
REGION_FX = {"us-east": "1.00", "us-west": "1.00", "eu-central": "1.08", "ap-south": "0.93", "latam": "1.12"}
TYPE_MARGIN = {"view": "0.00", "click": "0.01", "add_to_cart": "0.02", "purchase": "0.32", "refund": "-0.35"}
TYPE_WEIGHTS = {"view": 0.45, "click": 0.25, "add_to_cart": 0.12, "purchase": 0.15, "refund": 0.03}
MONETARY = ("purchase", "refund")
#: Upper bounds, exclusive, of the amount bands; above the last is "premium".
AMOUNT_BANDS = (("low", 10), ("mid", 100), ("high", 1000))
DROP_REASONS = ("bad_event_type", "bad_region", "bad_device", "missing_user", "negative_amount", "missing_amount")
# Fixed values of the generator: log-normal amounts and the number of users.
AMOUNT_MU, AMOUNT_SIGMA, USERS = 3.6, 0.9, 5000

GRAINS = ("minute", "hour", "day")
#: Dimensions a raw aggregate may group by, and those that the rollups keep.
GROUPABLE = ("region", "event_type", "device", "hour")
ROLLUP_DIMENSIONS = ("region", "event_type")

# Defaults of detection, serving and streaming.
Z_WARNING, Z_CRITICAL = 3.0, 5.0
BASELINE_WINDOWS, BASELINE_LEAST = 20, 5
TREND_LEAST, TREND_SHARE = 8, 0.15
REFUND_RATE, REFUND_PURCHASES = 0.05, 20
MOVER_SHARE = 0.05
COOLDOWN_SECONDS = 30
HOT_MINUTES, CACHE_SECONDS, CACHE_ENTRIES = 60, 15, 256
WATERMARK_SECONDS, TRIGGER_MS = 30, 200
