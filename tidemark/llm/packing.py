"""Best-fit packing of token sequences by bin completion (operator 10).

How to fill the bins depends only on how many pieces there are of each length, a histogram with one cell for each length up to the
capacity. The search therefore runs over lengths on the driver, at a cost that does not grow with the corpus, and its
result, a few thousand kinds of filled bins with how often each occurs, is dealt out to the pieces by their rank within
their length. Ranks are numbered within each task and shifted by counts per task, so no length is gathered in one task.

Defined results: a null text is an empty one, a single end token; repeated rows are packed each; an empty table gives no
rows; other columns are ignored.
"""

from __future__ import annotations

import zlib
from bisect import bisect_right
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tidemark.llm.common import materialize, text_rows

CAPACITY = 2048
END_ID = 0
#: Completions tried before the best packing so far is taken, fillings compared around one largest document, and steps spent on finding them.
#: ``EXACT`` has no such bounds and tries every number of pieces of a length: it ends with the fewest bins, in time that may grow without limit.
BOUNDS = (20_000, 3, 400)
EXACT = (None, None, None)

#: A kind of bin: lengths with how often each occurs in it, and how many such bins there are.
Kind = tuple[tuple[tuple[int, int], ...], int]


def lower_bound(counts: np.ndarray, capacity: int) -> int:
    """No packing has fewer bins: total length, and for each k the items over capacity - k, over half, and from k on."""
    size = np.arange(len(counts))
    n, total = np.cumsum(counts), np.cumsum(counts * size)
    best = -(-int(total[-1]) // capacity)
    half = capacity // 2
    k = np.arange(0, half + 1)
    large = n[-1] - n[capacity - k]
    middle, middle_sum = n[capacity - k] - n[half], total[capacity - k] - total[half]
    small_sum = total[half] - np.where(k > 0, total[np.maximum(k - 1, 0)], 0)
    more = np.maximum(0, -(-(small_sum - (middle * capacity - middle_sum)) // capacity))
    return max(best, int((large + middle + more).max()))


def best_fit(counts: np.ndarray, capacity: int) -> list[Kind]:
    """Best-fit decreasing, all pieces of a length at once: equal open bins are one group."""
    open_: dict[int, list[list]] = {}
    rooms: list[int] = []
    done: list[Kind] = []

    def put(items: list[tuple[int, int]], many: int, room: int) -> None:
        if not many:
            return
        if not room:
            done.append((tuple(items), many))
            return
        if room not in open_:
            open_[room] = []
            rooms.insert(bisect_right(rooms, room), room)
        open_[room].append([items, many])

    for size in range(capacity, 0, -1):
        left = int(counts[size])
        while left:
            at = bisect_right(rooms, size - 1)
            if at == len(rooms):
                each = capacity // size
                put([(size, each)], left // each, capacity - each * size)
                if left % each:
                    put([(size, left % each)], 1, capacity - left % each * size)
                break
            room = rooms[at]
            items, many = open_[room].pop()
            if not open_[room]:
                del open_[room]
                rooms.pop(at)
            each = room // size
            full = min(many, left // each)
            put([*items, (size, each)], full, room - each * size)
            left -= full * each
            many -= full
            if many and 0 < left < each:
                put([*items, (size, left)], 1, room - left * size)
                left, many = 0, many - 1
            put(items, many, room)
    return done + [(tuple(items), many) for groups in open_.values() for items, many in groups]


def _available(counts: np.ndarray) -> list[int]:
    return np.flatnonzero(counts).tolist()


def completions(counts: np.ndarray, capacity: int, width: int | None = BOUNDS[1], most: int | None = BOUNDS[2]) -> list[list[tuple[int, int]]]:
    """Undominated ways to fill a bin around the largest piece, least waste first: ``width`` of those found in ``most`` steps, or all."""
    sizes = _available(counts)
    largest = sizes[-1]
    left = dict(zip(sizes, (int(counts[s]) for s in sizes)))
    left[largest] -= 1
    found: list[tuple[int, list[tuple[int, int]]]] = []
    steps = np.inf if most is None else most
    width = np.inf if width is None else width

    def fill(room: int, below: int, chosen: list[tuple[int, int]]) -> None:
        nonlocal steps
        steps -= 1
        if room and room <= below and left.get(room, 0):  # an exact end; one piece dominates any set of its total
            found.append((0, [*chosen, (room, 1)]))
            return
        at = bisect_right(sizes, min(room, below)) - 1
        fits = False
        while at >= 0 and steps > 0:
            size = sizes[at]
            many = min(left[size], room // size)
            if many:
                fits = True
                for n in range(many, 0, -1) if most is None else dict.fromkeys((many, 1)):
                    if steps > 0:
                        fill(room - n * size, size - 1, [*chosen, (size, n)])
                    if len([w for w, _ in found[-1:] if w == 0]) and len([w for w, _ in found if w == 0]) >= width:
                        return
            at -= 1
        if not fits:
            found.append((room, chosen))

    fill(capacity - largest, largest, [])
    found.sort(key=lambda x: (x[0], -max((s for s, _ in x[1]), default=0)))
    out: list[list[tuple[int, int]]] = []
    for waste, chosen in found:
        if len(out) < width and not _dominated(waste, chosen, left, sizes) and chosen not in out:
            out.append(chosen)
    chosen = out or [found[0][1]] if found else [[]]
    return [_with(largest, c) for c in chosen]


def _with(largest: int, chosen: list[tuple[int, int]]) -> list[tuple[int, int]]:
    many = {largest: 1}
    for size, n in chosen:
        many[size] = many.get(size, 0) + n
    return sorted(many.items(), reverse=True)


def _dominated(waste: int, chosen: list[tuple[int, int]], left: dict[int, int], sizes: list[int]) -> bool:
    """One piece of the filling, or two together, could give way to a larger piece that is left."""
    used = dict(chosen)

    def larger(total: int, least: int) -> bool:
        at = bisect_right(sizes, total + waste) - 1
        while at >= 0 and sizes[at] >= least:
            if left[sizes[at]] > used.get(sizes[at], 0):
                return True
            at -= 1
        return False

    items = [s for s, n in chosen for _ in range(min(n, 2))]
    if waste and any(larger(s, s + 1) for s in items):
        return True
    return any(larger(a + b, a + b) for i, a in enumerate(items) for b in items[i + 1 :])


def bin_completion(counts: np.ndarray, capacity: int = CAPACITY, bounds: tuple[int | None, int | None, int | None] = BOUNDS) -> list[Kind]:
    """Kinds of bins that hold all pieces, as few bins as the search finds within ``bounds`` (nodes, width, steps), or the fewest with EXACT.

    Branch and bound: around the largest piece try the undominated fillings, each as often as the pieces allow (with EXACT once);
    leave a branch whose bins and lower bound do not beat the incumbent, at first the best-fit packing.
    """
    nodes, width, steps = bounds
    nodes = np.inf if nodes is None else nodes
    counts = np.asarray(counts, np.int64)
    best = best_fit(counts, capacity)
    fewest, least = sum(n for _, n in best), lower_bound(counts, capacity)
    stack: list[tuple[np.ndarray, int, tuple | None]] = [(counts, 0, None)]  # pieces left, bins so far, the kinds as a linked list
    while stack and nodes > 0 and fewest > least:
        nodes -= 1
        left, bins, path = stack.pop()
        if not left.any():
            if bins < fewest:
                fewest, best = bins, []
                while path is not None:
                    best.append(path[0])
                    path = path[1]
            continue
        if bins + lower_bound(left, capacity) >= fewest:
            continue
        for chosen in reversed(completions(left, capacity, width, steps)):
            many = min(int(left[s]) // n for s, n in chosen) if steps else 1
            after = left.copy()
            for s, n in chosen:
                after[s] -= n * many
            stack.append((after, bins + many, ((tuple(chosen), many), path)))
    return best


def _pieces(documents: DataFrame, path: str, capacity: int) -> DataFrame:
    """A row for each piece with its rank among those of its length in the task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from tidemark.llm.byte_bpe import ByteBpe

        coder = ByteBpe(path)
        block = TaskContext.get().partitionId()
        seen = np.zeros(capacity + 1, np.int64)
        names = ["doc_id", "piece", "start", "length", "ids_crc32", "block", "rank"]
        for batch in batches:
            docs = batch.column("doc_id").to_pylist()
            rows: list[tuple] = []
            for doc, ids in zip(docs, coder(x if x is not None else np.zeros(0, np.uint8) for x in text_rows(batch.column("text")))):
                raw = np.append(ids, END_ID).astype("<u4").tobytes()
                n = len(raw) // 4
                first = n % capacity or capacity
                start, piece = 0, 0
                while start < n:
                    size = first if not piece else capacity
                    rows.append((doc, piece, start, size, zlib.crc32(raw[4 * start : 4 * (start + size)]), block, int(seen[size])))
                    seen[size] += 1
                    start += size
                    piece += 1
            columns = list(zip(*rows)) or [()] * 7
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int32() if n in ("piece", "block") else pa.int64()) for n, c in zip(names, columns)], names)

    return documents.mapInArrow(run, "doc_id bigint, piece int, start bigint, length bigint, ids_crc32 bigint, block int, rank bigint")


def _slots(kinds: list[Kind]) -> np.ndarray:
    """For each length, which ranks go to which bins: rows (length, first rank, per bin, first sequence, offset)."""
    rows, given, sequence = [], {}, 0
    for items, many in kinds:
        offset = 0
        for size, each in items:
            rows.append((size, given.get(size, 0), each, sequence, offset))
            given[size] = given.get(size, 0) + each * many
            offset += size * each
        sequence += many
    return np.array(sorted(rows), np.int64).reshape(-1, 5)


def pack(documents: DataFrame, path: str, capacity: int = CAPACITY, bounds: tuple[int | None, int | None, int | None] = BOUNDS) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32, sequence_id and offset of every piece of every document."""
    d = documents.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text"))
    pieces = materialize(_pieces(d, path, capacity), "pack-pieces")
    per_block = pieces.groupBy("length", "block").agg(F.count("*").alias("n"))
    counts = np.zeros(capacity + 1, np.int64)
    for row in per_block.groupBy("length").agg(F.sum("n").alias("n")).collect():  # a row for each length at most
        counts[row["length"]] = row["n"]
    slots = _slots(bin_completion(counts, capacity, bounds))
    before = F.sum("n").over(Window.partitionBy("length").orderBy("block").rowsBetween(Window.unboundedPreceding, -1))
    shift = per_block.select("length", "block", F.coalesce(before, F.lit(0)).alias("shift"))
    ranked = pieces.join(shift, ["length", "block"]).withColumn("rank", F.col("rank") + F.col("shift"))
    span = int(counts.sum()) + 1
    keys = slots[:, 0] * span + slots[:, 1]  # within 64 bits up to 2**52 pieces
    shared = documents.sparkSession.sparkContext.broadcast((keys, slots, span))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys, slots, span = shared.value
        for batch in batches:
            size, rank = (batch.column(c).to_numpy() for c in ("length", "rank"))
            at = np.searchsorted(keys, size * span + rank, side="right") - 1
            _, first, each, sequence, offset = slots[at].T if len(at) else np.zeros((5, 0), np.int64)
            nth = rank - first
            yield pa.RecordBatch.from_arrays(
                [*(batch.column(c) for c in ("doc_id", "piece", "start", "length", "ids_crc32")), pa.array(sequence + nth // np.maximum(each, 1)), pa.array(offset + nth % np.maximum(each, 1) * size)],
                ["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"],
            )

    columns = ["doc_id", "piece", "start", "length", "ids_crc32", "rank"]
    return ranked.select(*columns).mapInArrow(run, "doc_id bigint, piece int, start bigint, length bigint, ids_crc32 bigint, sequence_id bigint, offset bigint")
