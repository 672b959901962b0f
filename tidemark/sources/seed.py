"""Fill a warehouse with generated events and their rollups."""

from __future__ import annotations

import argparse

from pyspark.sql import SparkSession

from tidemark.operators import transform
from tidemark.settings import load
from tidemark.sources import generator
from tidemark.sources.store import Store


def seed(spark: SparkSession, warehouse: str, events: int, seed: int = 42, hours: int = 24) -> Store:
    store = Store(spark, warehouse)
    store.create()
    store.insert_events(transform.transform(generator.bulk(spark, events, seed, spread_seconds=3600 * hours, ordered=False)))
    store.rebuild_rollups()
    return store


def main(args: list[str] | None = None) -> None:
    p = argparse.ArgumentParser(description=__doc__)
    p.add_argument("--events", type=int, default=50_000)
    p.add_argument("--hours", type=int, default=24)
    p.add_argument("--seed", type=int, default=42)
    p.add_argument("--warehouse", default=load().storage.warehouse)
    a = p.parse_args(args)
    from tidemark.session import session

    seed(session("tidemark-seed"), a.warehouse, a.events, a.seed, a.hours).counts().show()


if __name__ == "__main__":
    main()
