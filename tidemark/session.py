"""Session presets and logging."""

from __future__ import annotations

import logging
import tempfile
import uuid

from pyspark.sql import SparkSession

COMMON = {"spark.sql.session.timeZone": "UTC", "spark.sql.sources.partitionOverwriteMode": "dynamic", "spark.sql.adaptive.enabled": "true"}


def session(name: str = "tidemark", streaming: bool = False, partitions: int | None = None, **settings: str) -> SparkSession:
    """Streaming keeps a small fixed number of state partitions and reports metrics; batch leaves sizes to adaptive execution."""
    builder = SparkSession.builder.appName(name)
    values = dict(COMMON)
    if streaming:
        values |= {"spark.sql.shuffle.partitions": str(partitions or 8), "spark.sql.streaming.metricsEnabled": "true"}
    elif partitions:
        values["spark.sql.shuffle.partitions"] = str(partitions)
    for k, v in (values | settings).items():
        builder = builder.config(k, v)
    return builder.getOrCreate()


def scratch(spark: SparkSession, name: str) -> str:
    """A fresh path in the shared folder of ``spark.checkpoint.dir``; a temporary one of this machine only where Spark runs on it alone."""
    place = spark.conf.get("spark.checkpoint.dir", None)
    if not place:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        place = "file://" + tempfile.mkdtemp(prefix="tidemark-")
        spark.conf.set("spark.checkpoint.dir", place)
    return f"{place.rstrip('/')}/{name}-{uuid.uuid4().hex}"


def setup_logging(level: int = logging.INFO) -> None:
    logging.basicConfig(level=level, format="%(asctime)s %(levelname)-7s %(name)s: %(message)s")
