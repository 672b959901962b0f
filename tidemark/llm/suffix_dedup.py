"""Removal of repeated passages by a hash-compared suffix sort (operator 7).

A byte goes if a string of ``LENGTH`` bytes that covers it also starts earlier, in a document of smaller id or before in
the same one. Equal strings share their minimizer, the k-gram of least hash, so strings meet by their minimizer: each document
names the runs of consecutive starts with one minimizer, and only runs whose minimizer occurs twice go on.

Runs of equal bytes, told by 128 bits of BLAKE2b, are one class, of which all but the first occurrence go at once; that settles the inside
of every repeated passage, however often it occurs.

What is left are first runs of a minimizer with several classes, the rims of passages. Their bytes are gathered by minimizer and
the suffixes that start at the minimizers are sorted by mergesort, as are the reversed ones that end there. Two suffixes compare by a binary
search for their common extension over prefix polynomial hashes; afterwards the bytes of all neighbours are compared, and
a block in which two hashes collide is sorted by its bytes. A string with o bytes before its minimizer has an equal
in another run if the reversed suffixes agree for o bytes and the others for the rest: the common extensions of neighbours in the
two orders cut the runs into classes for each o, and all but the first of equal classes go.

Very frequent minimizers are split among tasks; the strings that are first in their part then meet by their bytes, with
partial aggregation.

Defined results: a null text is empty; texts under ``LENGTH`` bytes keep all; rows of equal doc_id and text are one document,
judged alike; different texts of one doc_id are documents in the order of a hash of their text; a null doc_id comes
before all others.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm import hashing
from tidemark.llm.common import discard, materialize, text_rows

LENGTH = 100
GRAM = 16
#: Bytes of a text that are looked at together; parts overlap by LENGTH - 1 bytes.
PART = 1 << 20
#: Runs of one minimizer that meet in one task, and runs that one suffix sort holds (at least a minimizer's).
GROUP, SORTED = 1 << 15, 1 << 12

RUN = "h bigint, doc_id bigint, at bigint, n int, off int, span1 bigint, span2 bigint"


def minimizer_runs(data: np.ndarray, length: int = LENGTH, gram: int = GRAM) -> tuple[np.ndarray, ...]:
    """Minimizer hash, first start, number of starts and place of the minimizer after the first start, of each run."""
    n = len(data) - length + 1
    prefix = hashing.prefix_hashes(hashing.byte_table()[data])
    at = np.arange(len(data) - gram + 1)
    grams = hashing.mix(hashing.range_hashes(prefix, at, at + gram))
    # The low bits give way to the place, so that the least key names the leftmost of equal hashes.
    key = (grams >> np.uint64(21) << np.uint64(21)) | at.astype(np.uint64)
    width, span = length - gram + 1, 1
    while 2 * span <= width:
        key = np.minimum(key[:-span], key[span:])
        span *= 2
    if span < width:
        key = np.minimum(key[: n], key[width - span : width - span + n])
    place = (key[:n] & np.uint64((1 << 21) - 1)).astype(np.int64)
    start = np.concatenate([[0], np.flatnonzero(place[1:] != place[:-1]) + 1])
    end = np.append(start[1:], n)
    return grams[place[start]], start, end - start, place[start] - start


def _digests(raw: bytes, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """128 bits of BLAKE2b of each stretch, as two columns."""
    found = b"".join([hashlib.blake2b(raw[a:b], digest_size=16).digest() for a, b in zip(start.tolist(), end.tolist())])
    return np.frombuffer(found, np.int64).reshape(-1, 2)


def _runs(documents: DataFrame, length: int, gram: int, whole: bool) -> DataFrame:
    """The runs of every document; without ``whole`` their minimizers only."""
    part_bytes = PART
    names = [c.split()[0] for c in RUN.split(", ")][: None if whole else 1]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column("doc_id").to_numpy()
            held: list[tuple[np.ndarray, ...]] = []
            size = 0
            for i, x in zip(ids.tolist(), text_rows(batch.column("text"))):
                if x is None or len(x) < length:
                    continue
                for a in range(0, len(x) - length + 1, part_bytes):
                    part = x[a : a + part_bytes + length - 1]
                    h, at, n, off = minimizer_runs(part, length, gram)
                    row = (h.view(np.int64),)
                    if whole:
                        spans = _digests(part.tobytes(), at, at + n + length - 1)
                        row += (np.full(len(h), i), at + a, n.astype(np.int32), off.astype(np.int32), spans[:, 0], spans[:, 1])
                    held.append(row)
                    size += len(h)
                if size > 100_000:
                    yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(c)) for c in zip(*held)], names)
                    held, size = [], 0
            if held:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(c)) for c in zip(*held)], names)

    return documents.mapInArrow(run, ", ".join(RUN.split(", ")[: len(names)]))


def suffix_order(data: np.ndarray, starts: np.ndarray, limits: np.ndarray, groups: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Indices that sort the suffixes at ``starts``, of ``limits`` bytes at most, by group, bytes and index; and how many bytes each
    has in common with the one before it in that order, -1 across groups.

    ``groups`` does not decrease. All merges of one width are done together: a suffix finds its place in the other half by
    binary search, and two suffixes compare by the byte after their common extension. Neighbours are verified by their bytes.
    """
    up, down = hashing.powers(len(data) + 1)
    prefix = np.zeros(len(data) + 1, np.uint64)
    sums = prefix[1:]
    sums[:] = hashing.byte_table()[data]
    sums *= up[: len(data)]
    np.cumsum(sums, out=sums)
    del up
    most = int(limits.max()) if len(limits) else 0

    def extension(i: np.ndarray, j: np.ndarray) -> np.ndarray:
        low, high = np.zeros(len(i), np.int64), np.minimum(limits[i], limits[j])
        x, y = starts[i], starts[j]
        px, py, dx, dy = prefix[x], prefix[y], down[x], down[y]
        for _ in range(most.bit_length()):
            mid = (low + high + 1) >> 1
            same = (prefix[x + mid] - px) * dx == (prefix[y + mid] - py) * dy
            low = np.where(same, mid, low)
            high = np.maximum(np.where(same, high, mid - 1), low)
        return low

    def before(i: np.ndarray, j: np.ndarray) -> np.ndarray:
        """Suffix i comes before j; false where they agree."""
        at, li, lj = extension(i, j), limits[i], limits[j]
        inside = (at < li) & (at < lj)
        last = len(data) - 1
        return np.where(inside, data[np.minimum(starts[i] + at, last)] < data[np.minimum(starts[j] + at, last)], li < lj)

    first = np.flatnonzero(np.concatenate([[True], groups[1:] != groups[:-1]])) if len(groups) else np.zeros(0, np.int64)
    sizes = np.diff(np.append(first, len(groups)))
    group_start, size = np.repeat(first, sizes), np.repeat(sizes, sizes)
    order = np.arange(len(starts))
    width = 1
    while len(sizes) and width < sizes.max():
        position = np.flatnonzero(size > width)  # groups that are not in order yet
        begin, end = group_start[position], group_start[position] + size[position]
        rank = position - begin
        right = (rank // width) % 2 == 1
        left_start = position - rank % width - np.where(right, width, 0)
        middle = np.minimum(left_start + width, end)
        low, high = np.where(right, left_start, middle), np.where(right, middle, np.minimum(left_start + 2 * width, end))
        base = low.copy()
        open_ = np.flatnonzero(low < high)
        while len(open_):
            mid = (low[open_] + high[open_]) >> 1
            # A suffix of the right half goes behind its equals of the left half, and one of the left half before those.
            own, other, of_right = order[position[open_]], order[mid], right[open_]
            smaller = before(np.where(of_right, own, other), np.where(of_right, other, own))
            go = smaller ^ of_right
            low[open_] = np.where(go, mid + 1, low[open_])
            high[open_] = np.where(go, high[open_], mid)
            open_ = open_[low[open_] < high[open_]]
        to = left_start + (position - np.where(right, middle, left_start)) + (low - base)
        merged = order.copy()
        merged[to] = order[position]
        order = merged
        width *= 2
    common = np.full(len(order), -1)
    pairs = np.flatnonzero(groups[order[1:]] == groups[order[:-1]]) + 1
    common[pairs] = extension(order[pairs - 1], order[pairs])
    if not _in_order(data, starts, limits, order, common, pairs):
        return _order_by_bytes(data, starts, limits, groups)
    return order, common


def _in_order(data: np.ndarray, starts: np.ndarray, limits: np.ndarray, order: np.ndarray, common: np.ndarray, pairs: np.ndarray) -> bool:
    """Neighbours agree in just the bytes they are said to have in common, and are in order: then all suffixes are."""
    for at in range(0, len(pairs), 1 << 14):
        p = pairs[at : at + (1 << 14)]
        x, y, n = order[p - 1], order[p], common[p]
        reach = np.arange(int(n.max()) if len(n) else 0)
        last = len(data) - 1
        differ = data[np.minimum(starts[x][:, None] + reach, last)] != data[np.minimum(starts[y][:, None] + reach, last)]
        if (differ & (reach < n[:, None])).any():
            return False
        inside = (n < limits[x]) & (n < limits[y])
        if not np.where(inside, data[np.minimum(starts[x] + n, last)] < data[np.minimum(starts[y] + n, last)], limits[x] <= limits[y]).all():
            return False
    return True


def _order_by_bytes(data: np.ndarray, starts: np.ndarray, limits: np.ndarray, groups: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The same without hashes, for the rare block in which two of them collide."""
    raw = data.tobytes()
    keys = [(g, raw[a : a + n]) for g, a, n in zip(groups.tolist(), starts.tolist(), limits.tolist())]
    order = sorted(range(len(keys)), key=lambda i: (*keys[i], i))
    common = np.full(len(order), -1)
    for at, (i, j) in enumerate(zip(order[:-1], order[1:]), 1):
        if keys[i][0] == keys[j][0]:
            x, y = keys[i][1], keys[j][1]
            n = min(len(x), len(y))
            common[at] = next((k for k in range(n) if x[k] != y[k]), n)
    return np.array(order, np.int64), common


def repeated_windows(spans: list[bytes], groups: np.ndarray, offsets: np.ndarray, length: int = LENGTH) -> np.ndarray:
    """Whether the string of ``length`` bytes with o bytes before the minimizer also starts in an earlier span of the group, as rows of o.

    The ``spans`` are in order of occurrence within each group; ``offsets``: the place of the minimizer in each.
    """
    sizes = np.array([len(s) for s in spans])
    bounds = np.concatenate([[0], np.cumsum(sizes)])
    data = np.frombuffer(b"".join(spans), np.uint8)
    at = bounds[:-1] + offsets
    later = np.zeros((len(spans), int(offsets.max()) + 1 if len(spans) else 0), bool)
    after, after_common = suffix_order(data, at, np.minimum(sizes - offsets, length), groups)
    ahead, ahead_common = suffix_order(np.ascontiguousarray(data[::-1]), len(data) - at, np.minimum(offsets, length), groups)
    of_after, of_ahead = np.empty(len(spans), np.int64), np.empty(len(spans), np.int64)
    for o in range(later.shape[1]):
        mine = np.flatnonzero((offsets >= o) & (offsets - o <= sizes - length))
        of_after[after] = np.cumsum(after_common < length - o)
        of_ahead[ahead] = np.cumsum(ahead_common < o)
        _, first, which = np.unique(of_ahead[mine] * (len(spans) + 1) + of_after[mine], return_index=True, return_inverse=True)
        later[mine, o] = first[which] != np.arange(len(mine))
    return later


def _intervals(later: np.ndarray, at: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Span, start and end of the bytes that the marked strings cover, neighbouring ones joined. ``at``: places of the minimizers."""
    edge = np.diff(np.pad(later.astype(np.int8), ((0, 0), (1, 1))), axis=1)
    span, least = np.nonzero(edge == 1)
    _, beyond = np.nonzero(edge == -1)
    return span, at[span] - beyond + 1, at[span] - least + length


def _cut(documents: DataFrame, wanted: DataFrame, length: int) -> DataFrame:
    """The ``wanted`` runs (doc_id, h, part, parts, at, n, off) with their bytes."""
    fields = ["h", "part", "parts", "at", "n", "off"]
    lists = wanted.groupBy("doc_id").agg(F.collect_list(F.struct(*fields)).alias("runs"))  # as many as the text has
    texts = documents.join(lists.hint("merge"), "doc_id").select("doc_id", "text", "runs")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column("runs")
            bounds, flat = lists.offsets.to_pylist(), lists.values
            columns = [flat.field(c) for c in fields]
            docs = np.repeat(batch.column("doc_id").to_numpy(), np.diff(bounds))
            begin, spans, held = bounds[0], [], 0
            for x, a, b in zip(text_rows(batch.column("text")), bounds[:-1], bounds[1:]):
                raw = x.tobytes()
                found = [raw[p : p + n + length - 1] for p, n in zip(*(columns[k].slice(a, b - a).to_pylist() for k in (3, 4)))]
                spans += found
                held += sum(map(len, found))
                if held > 1 << 24 or b == bounds[-1]:
                    mine = [c.slice(begin, b - begin) for c in columns]
                    yield pa.RecordBatch.from_arrays([pa.array(docs[begin - bounds[0] : b - bounds[0]]), *mine, pa.array(spans, pa.binary())], ["doc_id", *fields, "span"])
                    begin, spans, held = b, [], 0

    return texts.mapInArrow(run, "doc_id bigint, h bigint, part int, parts int, at bigint, n int, off int, span binary")


def _sort(spans: DataFrame, length: int) -> DataFrame:
    """(doc_id, s, e): bytes of the ``spans`` (h, part, parts, doc_id, at, off, span) under strings that occur earlier in a span of the same h."""
    met = spans.repartition("h", "part").sortWithinPartitions("h", "part", "doc_id", "at").select("h", "part", "parts", "doc_id", "at", "off", "span")
    sorted_at_once = SORTED

    def sort(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows: list[tuple] = []

        def close() -> pa.RecordBatch:
            h, part, parts, doc, at, off, span = zip(*rows)
            keys = np.array([h, part])
            groups = np.cumsum(np.concatenate([[0], (keys[:, 1:] != keys[:, :-1]).any(0)]))
            doc, at, off = (np.array(c, np.int64) for c in (doc, at, off))
            later = repeated_windows(list(span), groups, off, length)
            which, s, e = _intervals(later, at + off, length)
            # Strings that are first in a part of a split group, to be held against those of the other parts.
            apart = [(i, p) for i, many in enumerate(parts) if many > 1 for p in range(len(span[i]) - length + 1) if not later[i, off[i] - p]]
            i, p = np.array(apart, np.int64).reshape(-1, 2).T
            strings = [None] * len(s) + [span[x][y : y + length] for x, y in apart]
            return pa.RecordBatch.from_arrays(
                [pa.array(np.concatenate([doc[which], doc[i]])), pa.array(np.concatenate([s, at[i] + p])), pa.array(np.concatenate([e, at[i] + p + length])), pa.array(strings, pa.binary())], ["doc_id", "s", "e", "string"]
            )

        for batch in batches:
            for r in zip(*(batch.column(c).to_pylist() for c in ("h", "part", "parts", "doc_id", "at", "off", "span"))):
                if len(rows) >= sorted_at_once and r[:2] != rows[-1][:2]:
                    yield close()
                    rows = []
                rows.append(r)
        if rows:
            yield close()

    found = materialize(met.mapInArrow(sort, "doc_id bigint, s bigint, e bigint, string binary"), "suffix-windows")
    apart = found.where("string is not null")
    order = F.struct("doc_id", "s")
    least = materialize(apart.groupBy("string").agg(F.min(order).alias("least")), "suffix-least")
    late = apart.join(least.hint("merge"), "string").where(order > F.col("least"))
    return found.where("string is null").select("doc_id", "s", "e").unionByName(late.select("doc_id", "s", "e"))


def removed_intervals(documents: DataFrame, length: int = LENGTH, gram: int = GRAM) -> DataFrame:
    """(doc_id, s, e): byte ranges that go; they may overlap. ``documents``: doc_id, text, without null ids."""
    # Small tables are written before they are joined, so that a frequent minimizer can be split where it is joined.
    twice = _runs(documents, length, gram, whole=False).groupBy("h").agg(F.count("*").alias("times")).where("times > 1").select("h")
    twice = materialize(twice, "suffix-twice")
    again = materialize(_runs(documents, length, gram, whole=True).join(twice.hint("merge"), "h"), "suffix-runs")
    span = ["h", "span1", "span2"]
    classes = materialize(again.groupBy(*span).agg(F.min(F.struct("doc_id", "at")).alias("first"), F.count("*").alias("times")), "suffix-classes")
    kinds = materialize(classes.groupBy("h").agg(F.count("*").alias("kinds")).where("kinds > 1"), "suffix-kinds")
    marked = materialize(classes.join(kinds.hint("merge"), "h", "left").where("times > 1 or kinds > 1").select(*span, "first", F.coalesce("kinds", F.lit(1)).alias("kinds")), "suffix-marked")
    judged = again.join(marked.hint("merge"), span).withColumn("late", F.struct("doc_id", "at") > F.col("first")).where("late or kinds > 1")
    judged = materialize(judged.select("h", "doc_id", "at", "n", "off", "kinds", "late"), "suffix-judged")
    discard(again)
    parts = F.ceil(F.col("kinds") / GROUP).cast("int")
    rims = judged.where("not late").select("doc_id", "h", F.pmod(F.xxhash64("doc_id", "at"), parts).cast("int").alias("part"), parts.alias("parts"), "at", "n", "off")
    found = _sort(_cut(documents, rims, length), length)
    return judged.where("late").select("doc_id", F.col("at").alias("s"), (F.col("at") + F.col("n") + length - 1).alias("e")).unionByName(found)


def _merged(spans: np.ndarray) -> np.ndarray:
    """Disjoint maximal ranges, in order, of the union of some; touching ones are one."""
    if not len(spans):
        return np.zeros((0, 2), np.int64)
    spans = spans[np.argsort(spans[:, 0], kind="stable")]
    reach = np.maximum.accumulate(spans[:, 1])
    new = np.concatenate([[True], spans[1:, 0] > reach[:-1]])
    first = np.flatnonzero(new)
    return np.stack([spans[first, 0], reach[np.append(first[1:], len(spans)) - 1]], axis=1)


#: Least bigint: stands for a null doc_id, which comes before all others.
NULL_ID = -(1 << 63)


def row_keys(documents: DataFrame) -> tuple[DataFrame, DataFrame]:
    """``documents`` with a bigint ``row_key``, and (doc_id, text) of the distinct rows with the key as doc_id.

    The key is the doc_id where that is unique. Else it numbers the distinct (doc_id, text) in order of doc_id and a hash of the
    text: they are sorted by ranges, and counts per range (a row for each task) give the number its offset.
    """
    if documents.groupBy("doc_id").count().where("count > 1").isEmpty():
        return documents.withColumn("row_key", F.col("doc_id")), documents.select("doc_id", "text")
    hashed = documents.withColumn("text_hash", F.xxhash64("text", F.col("text").isNull()))
    ids = hashed.select("doc_id", "text_hash").distinct().repartitionByRange("doc_id", "text_hash").sortWithinPartitions("doc_id", "text_hash")
    placed = F.monotonically_increasing_id()  # the partition above 33 bits that count its rows
    ids = materialize(ids.select("doc_id", "text_hash", F.shiftright(placed, 33).alias("range"), placed.bitwiseAND(F.lit((1 << 33) - 1)).alias("at")), "suffix-keys")
    counts = sorted((r["range"], r["count"]) for r in ids.groupBy("range").count().collect())
    before = np.cumsum([0, *(n for _, n in counts)]).tolist()
    offset = F.create_map(*(F.lit(x) for (part, _), n in zip(counts, before) for x in (part, n)))
    keys = ids.select("doc_id", "text_hash", (offset[F.col("range")] + F.col("at")).cast("bigint").alias("row_key"))
    keyed = hashed.join(keys, ["doc_id", "text_hash"]).drop("text_hash")
    single = hashed.select("doc_id", "text_hash", "text").dropDuplicates(["doc_id", "text_hash"]).join(keys, ["doc_id", "text_hash"])
    return keyed, single.select(F.col("row_key").alias("doc_id"), "text")


def remove_repeats(documents: DataFrame, keep_text: bool = False, length: int = LENGTH) -> DataFrame:
    """n_bytes, n_removed, n_spans and kept_sha256 of every document, after its columns but for ``text``.

    With ``keep_text`` the kept text is a column too; characters of which some bytes go, go whole there.
    """
    names = [c for c in documents.columns if c not in ("doc_id", "text")]
    d = documents.select(F.coalesce(F.col("doc_id").cast("bigint"), F.lit(NULL_ID)).alias("doc_id"), F.col("text").cast("string").alias("text"), *names)
    d, single = row_keys(d)
    gone = removed_intervals(single, length)
    gone = gone.groupBy("doc_id").agg(F.collect_set(F.struct("s", "e")).alias("gone")).withColumnRenamed("doc_id", "row_key")  # as many as the text has
    joined = d.join(gone.hint("merge"), "row_key", "left").select(*names, F.when(F.col("doc_id") != NULL_ID, F.col("doc_id")).alias("doc_id"), "text", "gone")
    made = ["n_bytes", "n_removed", "n_spans", "kept_sha256", *(["kept_text"] if keep_text else [])]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for x, g in zip(text_rows(batch.column("text")), batch.column("gone")):
                data = np.zeros(0, np.uint8) if x is None else x
                flat = g.values
                cut = np.zeros((0, 2), np.int64) if flat is None else _merged(np.stack([flat.field("s").to_numpy(), flat.field("e").to_numpy()], axis=1))
                stay = np.ones(len(data), bool)
                for a, b in cut.tolist():
                    stay[a:b] = False
                row = (len(data), int((~stay).sum()), len(cut), hashlib.sha256(data[stay].tobytes()).hexdigest())
                if keep_text:
                    lead = (data & 0xC0) != 0x80
                    char = np.cumsum(lead) - 1
                    broken = np.zeros(int(lead.sum()), bool)
                    broken[char[~stay]] = True
                    row += (None if x is None else data[~broken[char]].tobytes().decode("utf-8") if len(data) else "",)
                out.append(row)
            cols = list(zip(*out)) or [()] * len(made)
            kinds = [pa.int64()] * 3 + [pa.string()] * (len(made) - 3)
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in [*names, "doc_id"]), *(pa.array(c, k) for c, k in zip(cols, kinds))], [*names, "doc_id", *made])

    kinds = dict(d.dtypes)
    schema = ", ".join([*(f"`{c}` {kinds[c]}" for c in [*names, "doc_id"]), "n_bytes bigint, n_removed bigint, n_spans bigint, kept_sha256 string", *(["kept_text string"] if keep_text else [])])
    return joined.mapInArrow(run, schema)


def suffix_dedup(documents: DataFrame) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans and kept_sha256 of every document."""
    return remove_repeats(documents.select("doc_id", "text")).select("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256")
