"""N-gram Jaccard join: a prefix-tree join over globally ordered shingle sets (operator 3).

Texts with equal sets are one class. Shingles are ordered by a corpus-wide count sketch, rare ones first. Two sets whose
similarity reaches the threshold share a shingle within their prefixes of that order, so prefixes alone are shuffled.
Candidates are then compared by a prefix tree: the candidates of one probe, as ordered sequences, are walked depth first; the
overlap of a shared beginning is counted once, and a subtree is left as soon as what remains cannot reach the threshold.

Where the first shared shingle stands bounds the overlap: neither set has more than what follows it. A set of n shingles
that has it at place p can so meet sets of up to ``reach`` = (n - p) * (100 + percent) / percent - n shingles, and two sets may be
linked only if the size of each is within the reach of the other.

 - A shingle that few classes share gives out the pairs that size, place and the number of shared shingles allow.
 - A shingle that many share gives out no pairs. Among its classes in order of size, each is joined to the one of largest reach so far;
   as all whose reach lasts can meet each other, these edges, one a class, connect whatever pairs are possible.

Classes connected by either are a cluster, so every possible link lies within one. The sets of a cluster meet in blocks of bounded
size that give out spanning links only. In a cluster of many, those linked with its first member need no comparison among
themselves, and by the triangle inequality of the Jaccard distance only sets at twice the allowed distance from that member or
closer are compared with them.

Defined results: a null, empty or blank text has an empty set and is linked with nothing; equal sets have similarity 1;
a row repeated in full is judged like its copy. A row without doc_id is counted but joins no component. Other columns
are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.llm import hashing
from tidemark.llm.common import connected_components, discard, materialize, text_rows

WORDS = 4
PERCENT = 85
#: Cells of the count sketch that orders shingles: fixed, so its size does not follow the corpus; and cells of one row of it.
SKETCH_BITS, SLICE_BITS = 20, 13
#: Classes that share a shingle up to this number are paired; more are joined through the one of largest reach.
FEW = 32
#: Rows of one frequent shingle that a task reads.
PART = 1 << 16
#: Sets of a chunk and shingles of a chunk; a block holds two chunks.
GROUP, TOKENS = 512, 1 << 18


def _sets(batch: pa.RecordBatch, k: int) -> Iterator[np.ndarray]:
    for x in text_rows(batch.column("text")):
        yield np.zeros(0, np.uint64) if x is None else hashing.shingles(hashing.word_hashes(x, fold=True), k)


def _cell(tokens: np.ndarray) -> np.ndarray:
    return (tokens >> np.uint64(64 - SKETCH_BITS)).astype(np.int64)


def _order(tokens: np.ndarray, sketch: np.ndarray) -> np.ndarray:
    """Tokens in the global order: by the count of their cell, then by value."""
    return tokens[np.lexsort((tokens, sketch[_cell(tokens)]))]


def _fingerprint(tokens: np.ndarray) -> tuple[np.int64, np.int64]:
    """Two sums of mixed shingles that name a set."""
    return hashing.mix(tokens + np.uint64(1)).sum(dtype=np.uint64).astype(np.int64), hashing.mix(tokens ^ np.uint64(hashing.BASE)).sum(dtype=np.uint64).astype(np.int64)


def prefix_length(n: np.ndarray | int, percent: int = PERCENT):
    return n - (percent * n + 99) // 100 + 1


def _prefix(n: Column, percent: int) -> Column:
    return n - F.floor((percent * n + 99) / 100) + 1


def _summaries(documents: DataFrame, k: int) -> DataFrame:
    """Of each document the size and a 128-bit fingerprint of its set; of each task its sketch, in slices of cells."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cells = np.zeros(1 << SKETCH_BITS, np.int32)
        names = ["doc_id", "n", "fp1", "fp2", "slice", "lot", "hits"]
        for batch in batches:
            size, one, two = (np.zeros(batch.num_rows, np.int64) for _ in range(3))
            hits = [np.zeros(0, np.int64)]
            for i, tokens in enumerate(_sets(batch, k)):
                size[i] = len(tokens)
                one[i], two[i] = _fingerprint(tokens)
                hits.append(_cell(tokens))
            cells += np.bincount(np.concatenate(hits), minlength=len(cells)).astype(np.int32)
            none = pa.nulls(batch.num_rows, pa.int32())
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(size), pa.array(one), pa.array(two), none, none, pa.nulls(batch.num_rows, pa.binary())], names)
        slices = cells.reshape(-1, 1 << min(SLICE_BITS, SKETCH_BITS))
        hit = np.flatnonzero(slices.any(1))
        lot = TaskContext.get().partitionId() % 64
        none = pa.nulls(len(hit), pa.int64())
        yield pa.RecordBatch.from_arrays([none, none, none, none, pa.array(hit.astype(np.int32)), pa.array(np.full(len(hit), lot, np.int32)), pa.array([slices[i].tobytes() for i in hit], pa.binary())], names)

    return documents.mapInArrow(run, "doc_id bigint, n bigint, fp1 bigint, fp2 bigint, slice int, lot int, hits binary")


def _added_up(slices: DataFrame, kind: type, *keys: str) -> DataFrame:
    """Sums, in 64 bits, of the counts (of type ``kind``) of equal keys; a task holds one slice at a time."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, total = None, None
        out = lambda: pa.RecordBatch.from_arrays([*(pa.array([x], pa.int32()) for x in now), pa.array([total.tobytes()], pa.binary())], [*keys, "hits"])
        for batch in batches:
            for *key, hits in zip(*(batch.column(c).to_pylist() for c in (*keys, "hits"))):
                if key != now:
                    if now:
                        yield out()
                    now, total = key, np.zeros(len(hits) // np.dtype(kind).itemsize, np.int64)
                total += np.frombuffer(hits, kind)
        if now:
            yield out()

    return slices.select(*keys, "hits").repartition(*keys).sortWithinPartitions(*keys).mapInArrow(run, ", ".join(f"{k} int" for k in keys) + ", hits binary")


def _sketch(summary: DataFrame) -> np.ndarray:
    """The counts of all cells: tasks are added up by lots first, then lots."""
    lots = _added_up(summary.where("slice is not null"), np.int32, "slice", "lot")
    out = np.zeros((1 << max(SKETCH_BITS - SLICE_BITS, 0), 1 << min(SLICE_BITS, SKETCH_BITS)), np.int64)
    for row in _added_up(lots, np.int64, "slice").collect():  # the cells of the sketch, whatever the input
        out[row["slice"]] = np.frombuffer(row["hits"], np.int64)
    return np.minimum(out.ravel(), np.iinfo(np.int32).max).astype(np.int32)


def _prefixes(documents: DataFrame, k: int, percent: int, sketch) -> DataFrame:
    """(token, cls, n, pos): the prefix tokens of every document and their places; cls is half of its set's fingerprint, n the set's size."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            held: list[tuple] = []
            size = 0

            def out() -> pa.RecordBatch:
                return pa.RecordBatch.from_arrays([pa.array(np.concatenate(x)) for x in zip(*held)], ["token", "cls", "n", "pos"])

            for x in _sets(batch, k):
                if not len(x):
                    continue
                p = prefix_length(len(x), percent)
                held.append((_order(x, sketch.value)[:p].astype(np.int64), np.full(p, _fingerprint(x)[0]), np.full(p, len(x), np.int32), np.arange(p, dtype=np.int32)))
                size += p
                if size > 200_000:
                    yield out()
                    held, size = [], 0
            if held:
                yield out()

    return documents.select("text").mapInArrow(run, "token bigint, cls bigint, n int, pos int")


class PrefixTree:
    """Sets as sequences in one global order, sorted: the common beginning with the set before is the depth of the branch."""

    def __init__(self, sets: list[np.ndarray], sketch: np.ndarray):
        """``sets``: tokens in the global order."""
        self.sizes = [len(x) for x in sets]
        tokens, where = np.unique(np.concatenate(sets), return_inverse=True)
        rank = np.empty(len(tokens), np.int64)
        rank[np.lexsort((tokens, sketch[_cell(tokens)]))] = np.arange(len(tokens))
        codes = rank[where]
        bounds = np.cumsum([0, *self.sizes])
        self.rows = [codes[a:b] for a, b in zip(bounds[:-1], bounds[1:])]
        self.codes = len(tokens)
        self.order = sorted(range(len(sets)), key=lambda j: self.rows[j].astype(">u4").tobytes())
        self.depth = [0]
        for a, b in zip(self.order[:-1], self.order[1:]):
            m = min(self.sizes[a], self.sizes[b])
            differ = np.flatnonzero(self.rows[a][:m] != self.rows[b][:m])
            self.depth.append(int(differ[0]) if len(differ) else m)

    def linked(self, probe: int, wanted: list[bool], percent: int = PERCENT) -> list[int]:
        """Which of the ``wanted`` sets reach the similarity with set ``probe``.

        Depth first; the overlap of a shared beginning is counted once. A subtree is left where the overlap so far and all
        that the probe has beyond cannot make ``percent`` of the probe itself.
        """
        n = self.sizes[probe]
        in_probe = np.zeros(self.codes, bool)
        in_probe[self.rows[probe]] = True
        after = n - np.cumsum(in_probe)
        least = (percent * n + 99) // 100
        found, overlap, cut, shared = [], np.zeros(0, np.int64), None, 0
        for i, depth in zip(self.order, self.depth):
            shared = min(shared, depth)  # with the set that was walked last
            size = self.sizes[i]
            if not wanted[i] or (cut is not None and shared > cut) or 100 * min(n, size) < percent * max(n, size):
                continue
            row = self.rows[i]
            start = overlap[shared - 1] if shared else 0
            overlap = np.concatenate([overlap[:shared], start + np.cumsum(in_probe[row[shared:]])])
            hopeless = np.flatnonzero(overlap + after[row] < least)
            cut, shared = (int(hopeless[0]) if len(hopeless) else None), size
            if cut is None and size:
                o = int(overlap[-1])
                if 100 * o >= percent * (n + size - o):
                    found.append(i)
        return found


def _ordered_sets(documents: DataFrame, members: DataFrame, k: int, sketch) -> DataFrame:
    """(grp, id, n, tokens): the sets of the ``members`` (grp, id), as bytes of tokens in the global order."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sets = [_order(x, sketch.value) for x in _sets(batch, k)]
            yield pa.RecordBatch.from_arrays([batch.column("grp"), batch.column("id"), pa.array([len(x) for x in sets], pa.int32()), pa.array([x.tobytes() for x in sets], pa.binary())], ["grp", "id", "n", "tokens"])

    # Always shuffled by id, so that the plan is the same however few or many candidates there are.
    rows = documents.select(F.col("doc_id").alias("id"), "text").join(members.hint("merge"), "id").select("grp", "id", "text")
    return rows.mapInArrow(run, "grp bigint, id bigint, n int, tokens binary").where("n > 0")


def _chunks(count: Column, tokens: Column) -> Column:
    return F.ceil(F.greatest(count / GROUP, tokens / TOKENS)).cast("int")


def _near_first(sets: DataFrame, percent: int) -> DataFrame:
    """(grp, id, inner, close) of the ``sets`` (grp, id, chunks, tokens): whether a set is linked with the one whose id is grp, and
    whether it may be with those that are. Each chunk has a copy of that set."""
    lead = sets.where("id = grp").dropDuplicates(["grp"]).select("grp", F.explode(F.sequence(F.lit(0), F.col("chunks") - 1)).alias("chunk"), "id", F.lit(0).alias("role"), "tokens")
    rest = sets.select("grp", F.pmod(F.xxhash64("id"), F.col("chunks")).cast("int").alias("chunk"), "id", F.lit(1).alias("role"), "tokens")
    met = lead.unionByName(rest).repartition("grp", "chunk").sortWithinPartitions("grp", "chunk", "role")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        first = np.zeros(0, np.uint64)
        for batch in batches:
            out = []
            for grp, i, role, raw in zip(*(batch.column(c).to_pylist() for c in ("grp", "id", "role", "tokens"))):
                tokens = np.frombuffer(raw, np.uint64)
                if not role:
                    first = np.sort(tokens)
                    continue
                o = len(np.intersect1d(first, tokens, assume_unique=True))
                union = len(first) + len(tokens) - o
                out.append((grp, i, 100 * o >= percent * union, 100 * o >= (2 * percent - 100) * union))
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(list(zip(*out)) or [()] * 4, (pa.int64(), pa.int64(), pa.bool_(), pa.bool_()))], ["grp", "id", "inner", "close"])

    return met.mapInArrow(run, "grp bigint, id bigint, inner boolean, close boolean")


def _placed(sets: DataFrame, percent: int) -> tuple[DataFrame, DataFrame]:
    """Rows (grp, i, j, chunk, id, tokens) of all blocks of the ``sets``, and links (a, b) found on the way.

    A group of one chunk is one block. In a larger one there are chunks of the sets that are close to the first one, of those that
    are not, and of those linked with it, numbered in this order. Any two of the first two kinds meet, and the first
    kind meets the last.
    """
    count = sets.groupBy("grp").agg(F.count("*").alias("count"), F.sum("n").alias("sum"))
    sized = materialize(count.select("grp", _chunks(F.col("count"), F.col("sum")).alias("chunks")), "jaccard-sizes")
    sets = sets.join(sized.hint("merge"), "grp")
    single = sets.where("chunks = 1").select("grp", F.lit(0).alias("i"), F.lit(0).alias("j"), F.lit(0).alias("chunk"), "id", "tokens")
    large = sets.where("chunks > 1")
    told = materialize(_near_first(large, percent), "jaccard-first")
    links = told.where("inner").select(F.col("id").alias("a"), F.col("grp").alias("b"))
    kind = F.when(F.col("inner"), 2).when(F.col("close"), 0).otherwise(1)
    kinds = large.join(told.hint("merge"), ["grp", "id"]).select("grp", "id", "n", "tokens", kind.alias("kind"))
    parts = kinds.groupBy("grp", "kind").agg(F.count("*").alias("count"), F.sum("n").alias("sum")).select("grp", "kind", _chunks(F.col("count"), F.col("sum")).alias("parts"))
    of = lambda k: F.coalesce(F.max(F.when(F.col("kind") == k, F.col("parts"))), F.lit(0)).alias(f"parts{k}")
    parts = materialize(parts.groupBy("grp").agg(*(of(k) for k in range(3))).where("parts0 + parts1 > 0"), "jaccard-parts")
    cut = kinds.join(parts.hint("merge"), "grp")
    before = F.when(F.col("kind") == 0, 0).when(F.col("kind") == 1, F.col("parts0")).otherwise(F.col("parts0") + F.col("parts1"))
    mine = F.when(F.col("kind") == 0, F.col("parts0")).when(F.col("kind") == 1, F.col("parts1")).otherwise(F.col("parts2"))
    meets = F.when(F.col("kind") == 0, F.col("parts0") + F.col("parts1") + F.col("parts2")).when(F.col("kind") == 1, F.col("parts0") + F.col("parts1")).otherwise(F.col("parts0"))
    cut = cut.select("grp", "id", "tokens", (before + F.pmod(F.xxhash64("id"), mine)).cast("int").alias("chunk"), meets.alias("meets")).where("meets > 0")
    cut = cut.select("grp", "id", "tokens", "chunk", F.explode(F.sequence(F.lit(0), F.col("meets") - 1)).alias("other"))
    cut = cut.select("grp", F.least("chunk", "other").alias("i"), F.greatest("chunk", "other").alias("j"), "chunk", "id", "tokens")
    return single.unionByName(cut), links


def _blocks(rows: DataFrame, percent: int, sketch) -> DataFrame:
    """Links (a, b) within each block of ``rows``, as a spanning forest. A block of two chunks compares sets of different chunks only."""
    rows = rows.repartition("grp", "i", "j").sortWithinPartitions("grp", "i", "j", "chunk", "id").select("grp", "i", "j", "chunk", "id", "tokens")

    def block(key: tuple, group: list[tuple[int, int, np.ndarray]]) -> Iterator[tuple[int, int]]:
        if len(group) < 2:
            return
        tree, root = PrefixTree([g[2] for g in group], sketch.value), list(range(len(group)))
        across = key[1] != key[2]

        def find(x: int) -> int:
            while root[x] != x:
                root[x] = root[root[x]]
                x = root[x]
            return x

        for p, (chunk, a, _) in enumerate(group):
            # Each pair once, with a later one. Those already joined need no comparison.
            mine = find(p)
            wanted = [q > p and (not across or chunk != c) and a != b and find(q) != mine for q, (c, b, _) in enumerate(group)]
            for q in tree.linked(p, wanted, percent) if any(wanted) else ():
                x, y = find(p), find(q)
                if x != y:
                    root[max(x, y)] = min(x, y)
                    yield a, group[q][1]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, group, links = None, [], []
        out = lambda: pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in (zip(*links) if links else ((), ()))], ["a", "b"])
        for batch in batches:
            for grp, i, j, chunk, doc, raw in zip(*(batch.column(c).to_pylist() for c in ("grp", "i", "j", "chunk", "id", "tokens"))):
                if (grp, i, j) != now:
                    links.extend(block(now, group) if now else ())
                    now, group = (grp, i, j), []
                group.append((chunk, doc, np.frombuffer(raw, np.uint64)))
            yield out()
            links = []
        links.extend(block(now, group) if now else ())
        yield out()

    return rows.mapInArrow(run, "a bigint, b bigint")


def _few_pairs(few: DataFrame, often: DataFrame, percent: int) -> DataFrame:
    """Pairs (one, two) of classes that share shingles of few classes, where size, place and number of these allow a link.

    ``few``: token, cls, n, pos; ``often``: cls and h, the number of shared shingles of many classes in its prefix. Common shingles up to
    the lesser of the two prefixes' ends lie in both prefixes, so the overlap is at most their number plus what one set has
    beyond its prefix.
    """
    one, two = (few.select("token", F.col("cls").alias(name), F.col("n").alias(f"n{i}"), F.col("pos").alias(f"p{i}")) for i, name in ((1, "one"), (2, "two")))
    n1, n2 = F.col("n1"), F.col("n2")
    met = one.join(two.hint("merge"), "token").where((F.col("one") < F.col("two")) & (100 * F.least(n1, n2) >= percent * F.greatest(n1, n2)))
    place = (100 + percent) * F.least(n1 - F.col("p1"), n2 - F.col("p2")) >= percent * (n1 + n2)
    pairs = met.groupBy("one", "n1", "two", "n2").agg(F.count("*").alias("k"), F.max(place).alias("fits")).where("fits")
    for i, name in ((1, "one"), (2, "two")):
        pairs = pairs.join(often.select(F.col("cls").alias(name), F.col("h").alias(f"h{i}")), name, "left")
    shared = F.col("k") + F.least(F.coalesce("h1", F.lit(0)), F.coalesce("h2", F.lit(0)))
    most = shared + F.greatest(n1 - _prefix(n1, percent), n2 - _prefix(n2, percent))
    return pairs.where((100 + percent) * most >= percent * (n1 + n2)).select("one", "two")


def _many_edges(many: DataFrame, percent: int) -> DataFrame:
    """Edges (one, two) that connect any two classes which share a token of ``many`` (token, g, cls, n, pos) within each other's reach.

    Of the classes of one size that of largest reach stands for all; a row of one token is read in parts, each with those.
    """
    reach = F.expr(f"cast(({100 + percent} * (n - pos) - {percent} * n) div {percent} as int)")
    parts = F.ceil(F.col("g") / PART).cast("int")
    rows = many.select("token", "cls", "n", reach.alias("reach"), parts.alias("parts"))
    best = rows.where("reach >= n").groupBy("token", "n", "parts").agg(F.max(F.struct("reach", "cls")).alias("best"))
    best = best.select("token", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"), F.col("n").alias("at"), F.lit(0).alias("role"), "n", "best.reach", "best.cls")
    each = rows.select("token", F.pmod(F.xxhash64("cls"), F.col("parts")).cast("int").alias("part"), F.least("n", "reach").alias("at"), F.lit(1).alias("role"), "n", "reach", "cls")
    met = best.unionByName(each).repartition("token", "part").sortWithinPartitions("token", "part", "at", "role").select("token", "part", "role", "n", "reach", "cls")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, top, top_cls = None, -1, None  # the largest reach so far, and whose it is
        for batch in batches:
            one, two = [], []
            for token, part, role, n, far, cls in zip(*(batch.column(c).to_pylist() for c in ("token", "part", "role", "n", "reach", "cls"))):
                if (token, part) != now:
                    now, top, top_cls = (token, part), -1, None
                if top >= n and cls != top_cls and (role or not part):
                    one.append(cls)
                    two.append(top_cls)
                if not role and far > top:
                    top, top_cls = far, cls
            yield pa.RecordBatch.from_arrays([pa.array(one, pa.int64()), pa.array(two, pa.int64())], ["one", "two"])

    return met.mapInArrow(run, "one bigint, two bigint")


def _clusters(prefixes: DataFrame, classes: DataFrame, percent: int) -> DataFrame:
    """(grp, id): classes, by their representatives, that may be linked within a group and not beyond it."""
    common = prefixes.groupBy("token").agg(F.min("cls").alias("low"), F.max("cls").alias("high")).where("low != high")
    # Written first, so that a token of many rows can be split where it is joined.
    common = materialize(common.select("token"), "jaccard-common")
    shared = materialize(prefixes.join(common.hint("merge"), "token").groupBy("token", "cls").agg(F.max("n").alias("n"), F.min("pos").alias("pos")), "jaccard-shared")
    discard(prefixes)
    counts = materialize(shared.groupBy("token").agg(F.count("*").alias("g")).where(F.col("g") > FEW), "jaccard-frequent")
    many = materialize(shared.join(counts.hint("merge"), "token"), "jaccard-many")
    few = shared.join(counts.select("token").hint("merge"), "token", "left_anti")
    pairs = _few_pairs(few, many.groupBy("cls").agg(F.count("*").alias("h")), percent)
    edges = materialize(pairs.unionByName(_many_edges(many, percent)), "jaccard-edges")
    discard(shared)
    discard(many)
    side = lambda name: classes.select(F.col("fp1").alias(name), F.col("rep").alias(f"{name}_rep"))
    named = edges.join(side("one"), "one").join(side("two"), "two").select(F.col("one_rep").alias("a"), F.col("two_rep").alias("b"))
    return connected_components(named).select(F.col("component").alias("grp"), "id")


def ngram_jaccard_join(documents: DataFrame, k: int = WORDS, percent: int = PERCENT) -> DataFrame:
    """doc_id, n_shingles and component_id of every document."""
    d = documents.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text"))
    summary = materialize(_summaries(d, k), "jaccard-sets")
    sketch = documents.sparkSession.sparkContext.broadcast(_sketch(summary))

    sets = summary.where("slice is null").select("doc_id", "n", "fp1", "fp2")
    classes = materialize(sets.where("n > 0 and doc_id is not null").groupBy("fp1", "fp2", "n").agg(F.min("doc_id").alias("rep")), "jaccard-classes")
    prefixes = materialize(_prefixes(d.where("doc_id is not null"), k, percent, sketch), "jaccard-prefixes")
    members = materialize(_clusters(prefixes, classes, percent), "jaccard-clusters")
    ordered = materialize(_ordered_sets(d, members, k, sketch), "jaccard-ordered")
    rows, links = _placed(ordered, percent)
    links = links.unionByName(materialize(_blocks(rows, percent, sketch), "jaccard-links"))
    components = materialize(connected_components(links), "jaccard-components")

    known = classes.join(components, F.col("rep") == F.col("id"), "left").select("fp1", "fp2", "n", F.coalesce("component", "rep").alias("component"))
    rows = sets.join(known, ["fp1", "fp2", "n"], "left")
    return rows.select("doc_id", F.col("n").alias("n_shingles"), F.when(F.col("doc_id").isNotNull(), F.coalesce("component", "doc_id")).alias("component_id"))
