"""Embedding near-duplicates by sorted projection passes (operator 5).

Each pass gives every vector a row of random hashes, sorts all vectors lexicographically by it and compares each with its neighbours
in that order, in double precision; the pairs that reach the threshold unite across passes. A hash is the number of the nearest
of pivots, vectors drawn from the rows anew for each pass, so that a dense part of the space is cut as finely as the rest;
the last one is a projection on a random direction. Windows follow from the global rank: a vector of block b, BLOCK
ranks wide, meets all of the blocks b - 1 to b + 1, whatever the partitions are.

The passes only have to connect a cluster: links are then counted exactly among all vectors of each component, block by
block, without emitting them. Equal vectors are one class throughout and count with their number.

Recall: a pair is missed only if no pass puts its component's vectors into one window. How often that happens depends on the number
and the density of the rows, so passes are added until TARGET of the plants have met their originals: rows of the table, each
with a made-up partner just at the threshold, off in a random direction or along its neighbourhood, go through each pass along with the
table and take no other part.

Defined results: a vector that is null, zero, or holds null or non-finite components, and one whose length differs from
another's, links with nothing there; it is a component of its own and kept. Repeated rows are judged each by their id.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import connected_components, discard, materialize

THRESHOLD = 0.95
#: Ranks of a block; and blocks that a task compares.
BLOCK, SUPER = 1024, 16
#: Share of the plants that meet before passes end, the number of plants, and the most passes.
TARGET, PLANTS, PASSES = 0.995, 2000, 48
#: Pivots of one hash, numbers in the pivots of one pass, of all lengths of vectors together, and pivots of a second hash that only orders within a block.
PIVOTS, PIVOT_NUMBERS, FINE = 4096, 1 << 22, 64
#: Vectors of one component that a task compares with as many others.
CHUNK = 2048


def _matrix(column: pa.Array) -> np.ndarray:
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    flat = column.flatten().to_numpy(zero_copy_only=False)
    return flat.reshape(len(column), -1) if len(column) else flat.reshape(0, 0)


def usable(embeddings: DataFrame) -> DataFrame:
    """(vec_id, v, dim): vectors in doubles that can link, with their number of components."""
    v = embeddings.select(F.col("vec_id").cast("bigint").alias("vec_id"), F.col("embedding").cast("array<double>").alias("v"))
    finite = F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return v.where(F.col("vec_id").isNotNull() & F.col("v").isNotNull() & finite & F.exists("v", lambda x: x != 0)).withColumn("dim", F.size("v"))


def _classes(good: DataFrame) -> DataFrame:
    """One row for each distinct vector: its least id, how many ids have it, the vector scaled to length 1."""
    rows = good.groupBy("v", "dim").agg(F.min("vec_id").alias("rep"), F.count_distinct("vec_id").alias("copies"))

    def unit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = []
            for x in b.column("v").to_pylist():
                x = np.array(x) / np.max(np.abs(x))  # so that squares neither vanish nor overflow
                out.append(x / np.linalg.norm(x))
            yield pa.RecordBatch.from_arrays([b.column("rep"), b.column("dim"), b.column("copies"), pa.array(out, pa.list_(pa.float64()))], ["rep", "dim", "copies", "u"])

    return rows.select("rep", "dim", "copies", "v").mapInArrow(unit, "rep bigint, dim int, copies bigint, u array<double>")


def nearest(u: np.ndarray, pivots: np.ndarray) -> np.ndarray:
    """The index of the nearest pivot of each row."""
    out = [np.argmax(u[at : at + 4096].astype(np.float32) @ pivots.T, axis=1) for at in range(0, len(u), 4096)]
    return np.concatenate(out) if out else np.zeros(0, np.int64)


def partners(rows: np.ndarray, threshold: float, seed: int = 5) -> np.ndarray:
    """A partner of each row at cosine ``threshold``: by turns off at random and along the difference of two close rows."""
    rng = np.random.default_rng(seed)
    off = rng.standard_normal(rows.shape)
    if len(rows) > 16:
        close = np.argpartition(-(rows @ rows.T), 16, axis=1)[:, :17]
        pick = np.argsort(rng.random(close.shape), axis=1)[:, :2]
        x, y = (rows[close[np.arange(len(rows)), pick[:, k]]] for k in (0, 1))
        off[1::2] = (x - y)[1::2]
    off -= (off * rows).sum(1, keepdims=True) * rows
    size = np.linalg.norm(off, axis=1, keepdims=True)
    off /= np.where(size > 1e-9, size, 1)
    return threshold * rows + np.sqrt(max(0.0, 1 - threshold**2)) * off


def _drawn(classes: DataFrame, wanted: dict[int, int], counts: dict[int, int], seed: int) -> dict[int, tuple[np.ndarray, np.ndarray]]:
    """Ids and vectors of about ``wanted`` rows of each length, one at least, chosen by a hash of the id."""
    share = F.create_map(*(F.lit(x) for d, n in wanted.items() for x in (d, min(1.0, 1.2 * (n + 10) / counts[d]))))
    hash_ = F.pmod(F.xxhash64("rep", F.lit(seed)), F.lit(1 << 30))
    rows = classes.where(hash_ < share[F.col("dim")] * (1 << 30)).select("dim", "u", hash_.alias("hash"), "rep").toArrow().sort_by([("hash", "ascending"), ("rep", "ascending")])
    dims = rows.column("dim").to_numpy()
    chosen = {int(d): pa.array(np.flatnonzero(dims == d)[: wanted[d]]) for d in np.unique(dims)}
    return {d: (rows.column("rep").take(at).to_numpy(), _matrix(rows.column("u").take(at))) for d, at in chosen.items()}


def spanning(near: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Edges of a spanning forest of a symmetric boolean matrix, breadth first."""
    left, a, b = np.ones(len(near), bool), [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
    for i in np.flatnonzero(near.any(1)).tolist():
        front = np.array([i])
        if not left[i]:
            continue
        left[i] = False
        while len(front):
            rows = near[front] & left
            found = np.flatnonzero(rows.any(0))
            a.append(front[rows[:, found].argmax(0)])
            b.append(found)
            left[found] = False
            front = found
    return np.concatenate(a), np.concatenate(b)


def _sorted(rows: DataFrame, hashes: dict[int, tuple[np.ndarray, ...]]) -> DataFrame:
    """``rows`` (rep, dim, plant, u) with ``rank``, their place in the lexicographic order of the hashes.

    ``hashes``: for each length the pivots of two hashes and a direction.
    """
    shared = rows.sparkSession.sparkContext.broadcast(hashes)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            dims = b.column("dim").to_numpy()
            one, two, along = np.zeros(len(dims), np.int32), np.zeros(len(dims), np.int32), np.zeros(len(dims))
            for d in np.unique(dims):
                if int(d) in shared.value:  # a length of which no pivot was drawn has few vectors
                    at = np.flatnonzero(dims == d)
                    u = _matrix(b.column("u").take(pa.array(at)))
                    first, second, direction = shared.value[int(d)]
                    one[at], two[at], along[at] = nearest(u, first), nearest(u, second), u @ direction
            yield pa.RecordBatch.from_arrays([*(b.column(c) for c in ("rep", "dim", "plant", "u")), pa.array(one), pa.array(two), pa.array(along)], ["rep", "dim", "plant", "u", "one", "two", "along"])

    keys = ["dim", "one", "two", "along", "rep", "plant"]
    hashed = rows.select("rep", "dim", "plant", "u").mapInArrow(run, "rep bigint, dim int, plant boolean, u array<double>, one int, two int, along double")
    place = F.monotonically_increasing_id()  # the partition above 33 bits that count its rows
    ordered = hashed.repartitionByRange(*keys).sortWithinPartitions(*keys).select("rep", "dim", "plant", "u", F.shiftright(place, 33).alias("range"), place.bitwiseAND(F.lit((1 << 33) - 1)).alias("at"))
    ordered = materialize(ordered, "vectors-sorted")
    counts = sorted((r["range"], r["count"]) for r in ordered.groupBy("range").count().collect())  # a row for each task
    before = np.cumsum([0, *(n for _, n in counts)]).tolist()
    starts = rows.sparkSession.createDataFrame([(part, n) for (part, _), n in zip(counts, before)], "range bigint, start bigint")
    return ordered.join(F.broadcast(starts), "range").withColumn("rank", F.col("start") + F.col("at")).drop("range", "start", "at")


def window_edges(reps: np.ndarray, u: np.ndarray, plant: np.ndarray, block: np.ndarray, own: np.ndarray, threshold: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Links (a, b) of the rows of each ``own`` block among themselves and with the block after it, as spanning forests, and the plants that meet their originals.

    Rows are in order of their ranks and of one length.
    """
    a, b, met = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
    for k in np.unique(block[own]).tolist():
        mine, rest = np.flatnonzero(block == k), np.flatnonzero(block == k + 1)
        every = np.concatenate([mine, rest])
        near = np.zeros((len(every),) * 2, bool)
        near[: len(mine)] = u[mine] @ u[every].T >= threshold
        near[:, plant[every]] = False
        near[plant[every]] = False
        np.fill_diagonal(near, False)
        x, y = spanning(near | near.T)
        a.append(reps[every[x]])
        b.append(reps[every[y]])
        for here, there in ((mine, every), (every, mine)):
            met.append(np.intersect1d(reps[here[plant[here]]], reps[there[~plant[there]]]))
    return np.concatenate(a), np.concatenate(b), np.unique(np.concatenate(met))


def _pass(rows: DataFrame, hashes: dict[int, tuple[np.ndarray, ...]], threshold: float, block: int) -> DataFrame:
    """(a, b) of one pass: spanning forests of the links found in each window, and (a, null) for a plant of a that met it."""
    ranked = _sorted(rows, hashes)
    width = block * SUPER
    group = F.floor(F.col("rank") / width).cast("bigint")
    into = F.when((F.col("rank") % width < block) & (F.col("rank") >= width), F.array(group, group - 1)).otherwise(F.array(group))
    met = ranked.withColumn("block", F.floor(F.col("rank") / block).cast("bigint")).select("rep", "dim", "plant", "u", "rank", "block", group.alias("home"), F.explode(into).alias("group"))

    def compare(key: tuple, t: pa.Table) -> pa.Table:
        t = t.sort_by("rank")
        dims, reps, plant, blocks = (t.column(c).to_numpy() for c in ("dim", "rep", "plant", "block"))
        own = t.column("home").to_numpy() == key[0].as_py()
        a, b = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
        found = []
        for d in np.unique(dims):
            at = np.flatnonzero(dims == d)
            x, y, z = window_edges(reps[at], _matrix(t.column("u").take(pa.array(at))), plant[at].astype(bool), blocks[at], own[at], threshold)
            a.append(x)
            b.append(y)
            found.append(z)
        z = np.concatenate(found)
        return pa.table({"a": pa.array(np.concatenate([*a, z]), pa.int64()), "b": pa.array([*np.concatenate(b).tolist(), *[None] * len(z)], pa.int64())})

    out = materialize(met.groupBy("group").applyInArrow(compare, "a bigint, b bigint"), "vectors-pass")
    discard(ranked)
    return out


def _edges(classes: DataFrame, threshold: float, block: int) -> tuple[DataFrame | None, float]:
    """Edges of as many passes as it takes for TARGET of the plants to meet their originals; and the share that did."""
    spark = classes.sparkSession
    counts = {r["dim"]: r["count"] for r in classes.groupBy("dim").count().collect()}
    total = sum(counts.values())
    if not total:
        return None, 1.0
    drawn = _drawn(classes, {d: min(n, max(1, PLANTS * n // max(total, 8 * PLANTS))) for d, n in counts.items()}, counts, -1)
    planted = [(int(i), d, True, x.tolist()) for d, (ids, u) in drawn.items() for i, x in zip(ids, partners(u, threshold))]
    rows = classes.select("rep", "dim", F.lit(False).alias("plant"), "u").unionByName(spark.createDataFrame(planted, "rep bigint, dim int, plant boolean, u array<double>"))
    rows = materialize(rows, "vectors-planted")
    most = {d: max(1, min(PIVOTS, PIVOT_NUMBERS // (2 * d * len(counts)))) for d in counts}
    coarse = {d: min(most[d], -(-n // block)) for d, n in counts.items()}
    fine = {d: most[d] if counts[d] > block * most[d] else min(most[d], FINE) for d in counts}
    edges, met = None, set()
    for seed in range(PASSES):
        pivots = _drawn(classes, {d: coarse[d] + fine[d] for d in counts}, counts, seed)
        direction = np.random.default_rng(seed)
        hashes = {d: (u[: coarse[d]].astype(np.float32), u[coarse[d] :].astype(np.float32) if len(u) > coarse[d] else u[:1].astype(np.float32), direction.standard_normal(u.shape[1])) for d, (_, u) in sorted(pivots.items())}
        found = _pass(rows, hashes, threshold, block)
        edges = found if edges is None else edges.unionByName(found)
        met |= {r["a"] for r in found.where("b is null").select("a").distinct().collect()}  # PLANTS at most
        if len(met) >= TARGET * len(planted):
            break
    return edges.where("b is not null"), len(met) / len(planted)


def _link_counts(classes: DataFrame, components: DataFrame, threshold: float) -> DataFrame:
    """(rep, others): exact number of ids of other vectors of the component within the threshold.

    A component is cut into chunks; a chunk meets every chunk of its component, and only counts leave a task.
    """
    placed = classes.join(components, F.col("rep") == F.col("id")).select("rep", "dim", "copies", "u", "component")
    size = placed.groupBy("component").agg(F.ceil(F.count("*") / CHUNK).cast("int").alias("chunks"))
    cut = placed.join(size, "component").withColumn("chunk", F.pmod(F.xxhash64("rep"), F.col("chunks")).cast("int"))
    every = F.sequence(F.lit(0), F.col("chunks") - 1)
    probes = cut.select("component", F.col("chunk").alias("i"), F.explode(every).alias("j"), F.lit(0).alias("role"), "rep", "dim", "copies", "u")
    others = cut.select("component", F.explode(every).alias("i"), F.col("chunk").alias("j"), F.lit(1).alias("role"), "rep", "dim", "copies", "u")
    met = probes.unionByName(others).repartition("component", "i", "j").sortWithinPartitions("component", "i", "j", "role", "rep")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, group = None, []

        def close() -> pa.RecordBatch:
            ids, n = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
            t = pa.Table.from_batches(group)
            role, dims, reps, copies, lists = (t.column(c).to_numpy() if c != "u" else t.column(c).combine_chunks() for c in ("role", "dim", "rep", "copies", "u"))
            for d in np.unique(dims):
                p, o = np.flatnonzero((role == 0) & (dims == d)), np.flatnonzero((role == 1) & (dims == d))
                if len(p) and len(o):
                    others = _matrix(lists.take(pa.array(o))).T
                    for at in range(0, len(p), 512):
                        q = p[at : at + 512]
                        near = _matrix(lists.take(pa.array(q))) @ others >= threshold
                        near &= reps[q][:, None] != reps[o][None, :]
                        ids.append(reps[q])
                        n.append(near @ copies[o])
            return pa.RecordBatch.from_arrays([pa.array(np.concatenate(ids), pa.int64()), pa.array(np.concatenate(n), pa.int64())], ["rep", "others"])

        for batch in batches:
            keys = np.stack([batch.column(c).to_numpy() for c in ("component", "i", "j")]) if batch.num_rows else np.zeros((3, 0))
            cuts = [0, *(np.flatnonzero((keys[:, 1:] != keys[:, :-1]).any(0)) + 1).tolist(), batch.num_rows]
            for a, b in zip(cuts[:-1], cuts[1:]):
                if a == b:
                    continue
                key = tuple(keys[:, a].tolist())
                if key != now and group:
                    yield close()
                    group = []
                now = key
                group.append(batch.slice(a, b - a))
        if group:
            yield close()

    counted = met.mapInArrow(run, "rep bigint, others bigint")
    return counted.groupBy("rep").agg(F.sum("others").alias("others"))


def near_duplicates(embeddings: DataFrame, threshold: float = THRESHOLD, block: int = BLOCK) -> DataFrame:
    """vec_id, n_links, component_id and kept of every vector."""
    good = usable(embeddings)
    classes = materialize(_classes(good), "vectors")
    edges, _ = _edges(classes, threshold, block)
    if edges is None:
        edges = embeddings.sparkSession.createDataFrame([], "a bigint, b bigint")
    components = materialize(connected_components(edges), "vector-components")
    counts = _link_counts(classes, components, threshold)
    told = classes.select("rep", "copies").join(components, F.col("rep") == F.col("id"), "left").join(counts, "rep", "left")
    told = told.select("rep", (F.col("copies") - 1 + F.coalesce("others", F.lit(0))).alias("n_links"), F.coalesce("component", "rep").alias("component"))
    member = good.groupBy("v").agg(F.min("vec_id").alias("rep"))
    of_id = good.join(member, "v").select("vec_id", "rep").distinct().join(told, "rep").groupBy("vec_id").agg(F.max("n_links").alias("n_links"), F.min("component").alias("component"))
    every = embeddings.select(F.col("vec_id").cast("bigint").alias("vec_id"))
    out = every.join(of_id, "vec_id", "left")
    component = F.coalesce("component", "vec_id")
    return out.select("vec_id", F.coalesce("n_links", F.lit(0)).cast("bigint").alias("n_links"), component.alias("component_id"), F.coalesce(component == F.col("vec_id"), F.lit(True)).alias("kept"))
