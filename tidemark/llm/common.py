"""Shared pieces: durable intermediate tables, Arrow text access, connected components."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

CHECKPOINT_DIR = "spark.checkpoint.dir"


def checkpoint_dir(spark: SparkSession) -> str:
    """The shared folder of the session; a temporary one where none is set (tests, one machine)."""
    place = spark.conf.get(CHECKPOINT_DIR, None) or spark.sparkContext.getConf().get(CHECKPOINT_DIR)
    if not place:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError(f"set {CHECKPOINT_DIR} to a folder that all executors share")
        place = "file://" + tempfile.mkdtemp(prefix="tidemark-")
        spark.conf.set(CHECKPOINT_DIR, place)
    return place.rstrip("/")


def workspace(spark: SparkSession, name: str) -> str:
    """A fresh path under the shared folder."""
    return f"{checkpoint_dir(spark)}/{name}-{uuid.uuid4().hex}"


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` as Parquet to the shared folder and read it back: the lineage is cut and no executor holds state.

    Shuffle files of the writing query go when it ends, so steps of one operator do not pile up on disk.
    """
    spark = df.sparkSession
    key = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(key, "false")
    path = workspace(spark, name)
    spark.conf.set(key, "true")
    try:
        df.write.option("compression", "zstd").parquet(path)
    finally:
        spark.conf.set(key, before)
    return spark.read.schema(df.schema).parquet(path)


def discard(df: DataFrame) -> None:
    """Delete the files of a materialized table that nothing will read again."""
    jvm = df.sparkSession._jvm
    conf = df.sparkSession._jsparkSession.sessionState().newHadoopConf()
    parents = {f.rpartition("/")[0] for f in df.inputFiles()}
    for place in parents:
        path = jvm.org.apache.hadoop.fs.Path(place)
        path.getFileSystem(conf).delete(path, True)


def give_back() -> None:
    """Return what Arrow keeps of freed memory, so that the driver does not go on holding the most that a fit took."""
    pa.default_memory_pool().release_unused()


def text_rows(column: pa.Array) -> Iterator[np.ndarray | None]:
    """The UTF-8 bytes of each string of an Arrow column without copying; None for null."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type):
        kind = np.int64
    else:
        kind = np.int32
    _, offsets, data = column.buffers()
    ends = np.frombuffer(offsets, kind)[column.offset : column.offset + len(column) + 1]
    whole = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    valid = column.is_valid().to_numpy(zero_copy_only=False)
    for ok, a, b in zip(valid.tolist(), ends[:-1].tolist(), ends[1:].tolist()):
        yield whole[a:b] if ok else None


def _is_star_forest(edges: DataFrame) -> bool:
    """Whether each u of the ``edges`` (u, v) has one v, and no v is a u."""
    ends = edges.select(F.col("u").alias("id"), F.lit(1).alias("out"), F.lit(0).alias("in")).unionByName(edges.select(F.col("v").alias("id"), F.lit(0).alias("out"), F.lit(1).alias("in")))
    other = ends.groupBy("id").agg(F.sum("out").alias("out"), F.max("in").alias("in")).where("out > 1 or (out = 1 and in = 1)")
    return not other.agg(F.count("*")).first()[0]


def connected_components(edges: DataFrame, name: str = "components") -> DataFrame:
    """``(id, component)`` for every id in the two bigint columns of ``edges``; component is the smallest id reachable.

    Alternates large-star and small-star steps. Each step takes least neighbours with partial aggregation and joins them
    back; they are written first, so that both sides of the join come straight from a shuffle and the adaptive skew join can split a hub.
    Every edge points to the smaller id, so it ends as soon as the edges are stars. The number of rounds grows with the logarithm
    of the longest path. Ids without an edge to another id do not appear. Null ends are ignored; repeated and reversed edges count once.
    """
    a, b = (F.col(c) for c in edges.columns[:2])
    current = materialize(
        edges.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).where(a.isNotNull() & b.isNotNull() & (a != b)).distinct(), name
    )
    while not _is_star_forest(current):
        both = current.unionByName(current.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = materialize(both.groupBy(F.col("u").alias("v")).agg(F.least("u", F.min("v")).alias("m")), f"{name}-low")
        large = materialize(current.join(low.hint("merge"), "v").select("u", F.col("m").alias("v")), f"{name}-large")  # a row for each edge
        discard(low)
        low = materialize(large.groupBy("u").agg(F.min("v").alias("m")), f"{name}-low")
        joined = large.join(low.hint("merge"), "u").where("v != m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        after = materialize(joined.unionByName(low.select("u", F.col("m").alias("v"))).distinct(), name)
        for old in (low, large, current):
            discard(old)
        current = after
    roots = current.select(F.col("v").alias("id"), F.col("v").alias("component")).distinct()
    return current.select(F.col("u").alias("id"), F.col("v").alias("component")).unionByName(roots)


def forest(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Which of the edges ``a[i]-b[i]`` a spanning forest keeps, as a boolean mask; same components, fewer rows."""
    if not len(a):
        return np.zeros(0, bool)
    _, codes = np.unique(np.concatenate([a, b]), return_inverse=True)
    parent = list(range(int(codes.max()) + 1))
    keep = np.zeros(len(a), bool)
    for i, (x, y) in enumerate(zip(codes[: len(a)].tolist(), codes[len(a) :].tolist())):
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        while parent[y] != y:
            parent[y] = parent[parent[y]]
            y = parent[y]
        if x != y:
            parent[max(x, y)] = min(x, y)
            keep[i] = True
    return keep
