"""Operators 3, 5 and 7 against brute force."""

import hashlib
import random

import numpy as np
import pytest

from tidemark.llm import common, embedding_dedup, jaccard_join, suffix_dedup


def components(n, links):
    parent = list(range(n))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in links:
        a, b = find(a), find(b)
        parent[max(a, b)] = min(a, b)
    return [find(i) for i in range(n)]


def test_connected_components(spark):
    rng = random.Random(3)
    for n, m in ((30, 20), (200, 150), (60, 59)):
        links = [(rng.randrange(n), rng.randrange(n)) for _ in range(m)] if n != 60 else [(i, i + 1) for i in range(59)]
        df = spark.createDataFrame(links + [(None, 1)], "a bigint, b bigint")
        got = {r.id: r.component for r in common.connected_components(df).collect()}
        expected = components(n, links)
        assert all(got.get(i, i) == expected[i] for i in range(n)) and len(got) == len({x for e in links if e[0] != e[1] for x in e})


def test_forest_keeps_components():
    rng = np.random.default_rng(1)
    a, b = rng.integers(0, 40, 100), rng.integers(0, 40, 100)
    keep = common.forest(a, b)
    assert components(40, zip(a[keep].tolist(), b[keep].tolist())) == components(40, zip(a.tolist(), b.tolist()))
    assert keep.sum() < 40


def shingle_set(text):
    words = [w.lower() for w in (text or "").encode().split()]
    if len(words) < 4:
        return {tuple(words)} - {()}
    return {tuple(words[i : i + 4]) for i in range(len(words) - 3)}


def variants(rng, n=60):
    """Chains and groups of near copies, short texts, passages shared by unrelated texts."""
    words = [f"w{i}" for i in range(400)]
    passage = [rng.choice(words) for _ in range(40)]
    out = []
    for _ in range(n // 6):
        base = [rng.choice(words) for _ in range(rng.choice([5, 30, 80, 200]))]
        for k in range(4):
            base = list(base)
            for _ in range(k):
                base[rng.randrange(len(base))] = rng.choice(words)
            out.append(" ".join(base))
        out.append(" ".join(base[:20] + passage + [rng.choice(words) for _ in range(30)]))
        out.append(" ".join(base).upper())
    return out


@pytest.mark.parametrize(("seed", "group", "few", "part"), [(1, 512, 32, 1 << 16), (2, 2, 32, 1 << 16), (3, 3, 1, 4), (4, 512, 1, 1 << 16)])
def test_jaccard_join(docs, monkeypatch, seed, group, few, part):
    for name, value in (("GROUP", group), ("FEW", few), ("PART", part)):
        monkeypatch.setattr(jaccard_join, name, value)
    rng = random.Random(seed)
    texts = variants(rng) + [None, "", " \n", "a b", "A  b", "a b c", "x" * 5000]
    texts += [texts[0]] * 5
    order = list(range(len(texts)))
    rng.shuffle(order)
    texts = [texts[i] for i in order]
    sets = [shingle_set(t) for t in texts]
    links = [(i, j) for i in range(len(sets)) for j in range(i) if sets[i] and 100 * len(sets[i] & sets[j]) >= 85 * len(sets[i] | sets[j])]
    expected = components(len(sets), links)
    rows = {r.doc_id: r for r in jaccard_join.ngram_jaccard_join(docs(texts)).collect()}
    assert [(rows[i].n_shingles, rows[i].component_id) for i in range(len(texts))] == [(len(s), c) for s, c in zip(sets, expected)]


@pytest.mark.parametrize(("group", "few"), [(512, 4), (8, 4), (8, 32)])
def test_jaccard_join_of_near_misses(docs, monkeypatch, group, few):
    """A family whose members lie on both sides of the limit to each other and to the first one, and share many shingles."""
    monkeypatch.setattr(jaccard_join, "GROUP", group)
    monkeypatch.setattr(jaccard_join, "FEW", few)
    rng = random.Random(21)
    base = [f"b{rng.randrange(10**6)}" for _ in range(120)]
    texts = []
    for i in range(70):
        words = list(base) if i % 7 else list(base[: 100 + i // 7])
        for e in range(i % 6):
            words[rng.randrange(len(words))] = f"x{i}e{e}" if i % 3 else f"x{e}"
        texts.append(" ".join(words))
    sets = [shingle_set(t) for t in texts]
    links = [(i, j) for i in range(len(sets)) for j in range(i) if 100 * len(sets[i] & sets[j]) >= 85 * len(sets[i] | sets[j])]
    near = sum(100 * len(sets[i] & sets[j]) >= 70 * len(sets[i] | sets[j]) for i in range(len(sets)) for j in range(i))
    expected = components(len(sets), links)
    assert 5 < len(set(expected)) < 60 and near > 1.5 * len(links) > 100
    got = {r.doc_id: r.component_id for r in jaccard_join.ngram_jaccard_join(docs(texts)).collect()}
    assert [got[i] for i in range(len(texts))] == expected


def test_pipeline_near_duplicates(spark, docs):
    """Which documents stay, at five words and 0.8; spread one-word edits lie between that and the limits of op3."""
    import corpus_pipeline

    rng = random.Random(9)
    texts = variants(rng, 30) + [None, "", "a b c d"]
    for n, edits in ((50, 1), (100, 2), (150, 3), (1000, 21)):
        base = [f"u{rng.randrange(10**6)}" for _ in range(n)]
        copy = list(base)
        for e in range(edits):
            copy[(2 * e + 1) * n // (2 * edits)] = f"edit{e}"
        texts += [" ".join(base), " ".join(copy)]
    sets = []
    for t in texts:
        w = (t or "").lower().split()
        sets.append({tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} - {()})
    near = lambda i, j: sets[i] and 100 * len(sets[i] & sets[j]) >= 80 * len(sets[i] | sets[j])
    expected = components(len(texts), [(i, j) for i in range(len(texts)) for j in range(i) if near(i, j)])
    got = corpus_pipeline.near_duplicates(spark, docs(texts), "").collect()
    assert sorted((r.doc_id, r.text) for r in got) == [(i, t) for i, t in enumerate(texts) if expected[i] == i]


def test_pipeline_near_duplicates_of_repeated_ids(spark, docs):
    """Rows of one id and different texts are judged each by itself."""
    import corpus_pipeline

    a, b, c = (" ".join(f"{x}{i}" for i in range(30)) for x in "abc")
    rows = [(1, a), (2, a), (2, b), (2, b), (3, b), (3, c), (3, None), (None, a)]
    got = corpus_pipeline.near_duplicates(spark, docs(rows), "").collect()
    assert sorted((r.doc_id or 0, r.text or "") for r in got) == [(0, a), (1, a), (2, b), (3, ""), (3, c)]


def test_jaccard_edges(spark, docs):
    assert jaccard_join.ngram_jaccard_join(docs([]).limit(0)).count() == 0
    rows = jaccard_join.ngram_jaccard_join(docs([(None, "a b c d e"), (5, "a b c d e"), (5, "a b c d e"), (4, "A b c d e"), (7, None)])).collect()
    assert sorted((r.doc_id or 0, r.n_shingles, r.component_id or 0) for r in rows) == [(0, 2, 0), (4, 2, 4), (5, 2, 4), (5, 2, 4), (7, 0, 7)]


def test_prefix_tree_equals_set_arithmetic():
    rng = np.random.default_rng(4)
    sketch = rng.integers(1, 5, 1 << jaccard_join.SKETCH_BITS)
    make = lambda values: jaccard_join._order(np.unique(np.array(values, np.uint64) * np.uint64(0x9E3779B97F4A7C15)), sketch)
    base = rng.integers(0, 1000, 60)
    members = []
    for i in range(80):
        m = base.copy()
        m[rng.integers(0, 60, i % 16)] = rng.integers(0, 1000, i % 16)
        members.append(make(m[: rng.integers(45, 61)]))
    sets = [make(base), *members]
    tokens = [set(x.tolist()) for x in sets]
    tree = jaccard_join.PrefixTree(sets, sketch)
    for p in (30, 1, 0):
        expected = {i for i, t in enumerate(tokens) if 100 * len(tokens[p] & t) >= 85 * len(tokens[p] | t)}
        assert set(tree.linked(p, [True] * len(sets))) == expected
        odd = [bool(i % 2) for i in range(len(sets))]
        assert set(tree.linked(p, odd)) == {i for i in expected if i % 2}
    assert 1 < len(expected) < len(sets)


def plain_dedup(texts):
    """Per text: bytes kept, removed and removed runs; texts in order of their ids."""
    seen, out = set(), []
    for t in texts:
        b = (t or "").encode()
        stay = [True] * len(b)
        for p in range(len(b) - 99):
            w = b[p : p + 100]
            if w in seen:
                stay[p : p + 100] = [False] * 100
            else:
                seen.add(w)
        runs = sum(1 for i, s in enumerate(stay) if not s and (i == 0 or stay[i - 1]))
        out.append((len(b), stay.count(False), runs, hashlib.sha256(bytes(c for c, s in zip(b, stay) if s)).hexdigest()))
    return out


def passages(rng):
    alphabet = "abcdefgh é"
    text = lambda n: "".join(rng.choice(alphabet) for _ in range(n))
    shared = [text(n) for n in (99, 100, 101, 150, 400)]
    out = [None, "", "x" * 99, "x" * 100, "x" * 101, "x" * 450, "ab" * 300]
    for _ in range(60):
        parts = [text(rng.randint(0, 120))]
        for _ in range(rng.randint(0, 3)):
            p = rng.choice(shared)
            if rng.random() < 0.4:
                k = rng.randrange(len(p))
                p = p[:k] + rng.choice(alphabet) + p[k + 1 :]
            parts += [p, text(rng.randint(0, 60))]
        out.append("".join(parts))
    return out + out[10:20]


@pytest.mark.parametrize("group", [8192, 2])
def test_suffix_dedup(docs, monkeypatch, group):
    monkeypatch.setattr(suffix_dedup, "GROUP", group)
    texts = passages(random.Random(5))
    rows = {r.doc_id: r for r in suffix_dedup.suffix_dedup(docs(texts)).collect()}
    assert [(rows[i].n_bytes, rows[i].n_removed, rows[i].n_spans, rows[i].kept_sha256) for i in range(len(texts))] == plain_dedup(texts)


def test_suffix_dedup_parts_and_edges(docs, monkeypatch):
    monkeypatch.setattr(suffix_dedup, "PART", 64)
    texts = passages(random.Random(6))[:30]
    rows = {r.doc_id: r for r in suffix_dedup.suffix_dedup(docs(texts)).collect()}
    assert [(rows[i].n_removed, rows[i].kept_sha256) for i in range(len(texts))] == [(x[1], x[3]) for x in plain_dedup(texts)]
    assert suffix_dedup.suffix_dedup(docs([]).limit(0)).count() == 0
    got = suffix_dedup.suffix_dedup(docs([(3, "q" * 100), (None, "q" * 100), (3, "q" * 100)])).collect()
    assert sorted((r.doc_id or 0, r.n_removed) for r in got) == [(0, 0), (3, 100), (3, 100)]


def test_suffix_dedup_repeated_and_null_ids(docs):
    """Rows of equal id and text are judged alike; different texts of one id, or of none, each have their own ranges."""
    rng = random.Random(8)
    text = lambda n: "".join(rng.choice("abcdefgh") for _ in range(n))
    phrase = text(60)
    # The phrase stands in all of them with other surroundings, so that their runs of one minimizer differ.
    own = [text(150) + phrase + text(150) for _ in range(8)]
    shared = text(300)
    rows = [(1, own[0]), (2, own[1]), (2, own[1]), (5, own[2]), (5, own[3]), (None, own[4]), (None, own[5]), (None, own[5]), (None, None), (9, own[6] + shared), (9, own[7] + shared), (9, text(20))]
    got = suffix_dedup.remove_repeats(docs(rows), keep_text=True).collect()
    assert len(got) == len(rows)
    unique = [r for r in got if r.doc_id != 9]
    assert all(r.n_removed == 0 for r in unique)
    key = lambda x: (x[0] or 0, x[1] or "")
    assert sorted(((r.doc_id, r.kept_text) for r in unique), key=key) == sorted([r for r in rows if r[0] != 9], key=key)
    assert sorted(r.n_removed for r in got if r.doc_id == 9)[:2] == [0, 0]
    both = [r.kept_text for r in got if r.doc_id == 9]
    assert 300 <= max(r.n_removed for r in got) <= 302 and sum(shared in t for t in both) == 1
    assert all(any(t.startswith(o[:300]) for t in both) for o in own[6:])


def test_kept_text_has_whole_characters(docs):
    text = "é" * 60
    rows = {r.doc_id: r for r in suffix_dedup.remove_repeats(docs([text, "abc" + text + "def"]), keep_text=True).collect()}
    assert rows[1].kept_text.startswith("abc") and rows[1].kept_text.endswith("def") and "score" in rows[1].asDict()


def test_suffix_order_sorts():
    rng = np.random.default_rng(7)
    data = rng.integers(97, 99, 600).astype(np.uint8)
    starts, groups = rng.permutation(580), np.sort(rng.integers(0, 5, 580))
    limits = rng.integers(0, 13, 580)
    order, common = suffix_dedup.suffix_order(data, starts, limits, groups)
    keys = [(int(groups[i]), data[starts[i] : starts[i] + limits[i]].tobytes(), i) for i in range(580)]
    assert [keys[i] for i in order] == sorted(keys)
    for x, y, n in zip(order[:-1], order[1:], common[1:]):
        (g, a, _), (h, b, _) = keys[x], keys[y]
        assert n == (-1 if g != h else next((k for k in range(min(len(a), len(b))) if a[k] != b[k]), min(len(a), len(b))))


def runs_of_one_gram(rng, n=60):
    """Spans around one gram whose contexts agree to various lengths."""
    gram = b"0123456789abcdef"
    left, right = bytes(rng.integers(97, 123, 84).tolist()), bytes(rng.integers(97, 123, 84).tolist())
    spans, offsets = [], []
    for _ in range(n):
        a, b = (int(x) for x in rng.integers(30, 85, 2))
        if a + b < 84:
            b = 84
        own = lambda k: bytes(rng.integers(65, 68, k).tolist())
        i, j = int(rng.integers(0, a + 1)), int(rng.integers(0, b + 1))
        spans.append(own(a - i) + left[84 - i :] + gram + right[:j] + own(b - j))
        offsets.append(a)
    return spans, np.array(offsets)


@pytest.mark.parametrize("collide", [False, True])
def test_windows_are_those_of_plain_comparison(monkeypatch, collide):
    """Also where all hashes are equal: a collision is noticed and the bytes decide."""
    spans, offsets = runs_of_one_gram(np.random.default_rng(3))
    groups = np.repeat([0, 1], 30)
    if collide:
        monkeypatch.setattr(suffix_dedup.hashing, "byte_table", lambda fold=False, seed=1: np.zeros(256, np.uint64))
    later = suffix_dedup.repeated_windows(spans, groups, offsets)
    seen, marked = set(), 0
    for i, span in enumerate(spans):
        for p in range(len(span) - 99):
            key = (groups[i], offsets[i] - p, span[p : p + 100])
            assert later[i, offsets[i] - p] == (key in seen)
            marked += key in seen
            seen.add(key)
    assert marked > 50 and later.sum() == marked


@pytest.mark.parametrize("gram", [1, 2])
def test_suffix_dedup_of_common_minimizers(docs, gram):
    """Minimizers of a byte or two: runs of very many kinds share one, and only their bytes tell them apart."""
    texts = passages(random.Random(12))
    rows = docs([(i, t or "") for i, t in enumerate(texts)]).select("doc_id", "text")
    stay = [[True] * len((t or "").encode()) for t in texts]
    for r in suffix_dedup.removed_intervals(rows, gram=gram).collect():
        stay[r.doc_id][r.s : r.e] = [False] * (r.e - r.s)
    assert [s.count(False) for s in stay] == [x[1] for x in plain_dedup(texts)]


def vectors(rng, n=600, dim=16):
    x = rng.standard_normal((n, dim))
    for i in range(0, 200, 4):
        x[i + 1 : i + 4] = x[i] + 0.05 * rng.standard_normal((3, dim))
    x[300:420] = x[299] + 0.08 * rng.standard_normal((120, dim))
    x[500:510] = x[499]
    return x


def test_embeddings(spark):
    x = vectors(np.random.default_rng(8))
    rows = [(i, v.tolist(), 0) for i, v in enumerate(x)]
    odd = [(1000, None), (1001, [0.0] * 16), (1002, [float("nan")] + [1.0] * 15), (1003, [None] + [1.0] * 15), (1004, [1.0, 2.0]), (1005, []), (1006, [float("inf")] * 16)]
    df = spark.createDataFrame(rows + [(i, v, 1) for i, v in odd], "vec_id bigint, embedding array<double>, label int").repartition(4)
    got = {r.vec_id: r for r in embedding_dedup.near_duplicates(df, block=64).collect()}
    u = x / np.linalg.norm(x, axis=1, keepdims=True)
    near = u @ u.T >= 0.95
    np.fill_diagonal(near, False)
    links = sum(r.n_links for r in got.values())
    assert 0.99 * near.sum() <= links <= near.sum()
    expected = components(len(x), np.argwhere(near).tolist())
    assert np.mean([got[i].component_id == expected[i] for i in range(len(x))]) >= 0.99
    assert all((got[i].n_links, got[i].component_id, got[i].kept) == (0, i, True) for i, _ in odd)
    assert all(r.kept == (r.component_id == r.vec_id) for r in got.values())


def test_embeddings_dense_range(spark):
    """Pairs at 0.96 within a third of the rows that are at 0.8 to each other, with small blocks."""
    rng = np.random.default_rng(12)
    unit = lambda x: x / np.linalg.norm(x, axis=1, keepdims=True)
    n, dim, pairs = 4000, 32, 300
    c = unit(rng.standard_normal((1, dim)))
    off = lambda k: unit((r := rng.standard_normal((k, dim))) - r @ c.T * c)
    one = off(n // 3)
    w = off(pairs)
    w = unit(w - (w * one[:pairs]).sum(1, keepdims=True) * one[:pairs])
    two = 0.8 * one[:pairs] + 0.6 * w
    x = np.concatenate([np.sqrt(0.8) * c + np.sqrt(0.2) * one, unit(rng.standard_normal((n - n // 3, dim))), np.sqrt(0.8) * c + np.sqrt(0.2) * two])
    order = rng.permutation(len(x))
    df = spark.createDataFrame([(int(i), x[k].tolist()) for i, k in enumerate(order)], "vec_id bigint, embedding array<double>").repartition(4)
    got = {r.vec_id: r.n_links for r in embedding_dedup.near_duplicates(df, block=8).collect()}
    near = x[order] @ x[order].T >= 0.95
    np.fill_diagonal(near, False)
    expected = near.sum(1)
    assert expected.sum() >= 2 * pairs
    assert 0.99 * expected.sum() <= sum(got.values()) <= expected.sum()


def test_embeddings_do_not_depend_on_partitions(spark):
    """Windows follow from the global rank: the edges of a pass are the same in any partitioning, and small ranges lose none."""
    rng = np.random.default_rng(14)
    x = rng.standard_normal((3000, 16))
    x[1::2] = x[::2] + 0.06 * rng.standard_normal((1500, 16))
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id bigint, embedding array<double>")
    before, out = spark.conf.get("spark.sql.shuffle.partitions"), []
    coalesce = "spark.sql.adaptive.coalescePartitions.enabled"
    try:
        spark.conf.set(coalesce, "false")
        for n in ("3", "61"):
            spark.conf.set("spark.sql.shuffle.partitions", n)
            out.append(sorted(map(tuple, embedding_dedup.near_duplicates(df.repartition(int(n)), block=16).collect())))
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
        spark.conf.unset(coalesce)
    assert out[0] == out[1]
    u = x / np.linalg.norm(x, axis=1, keepdims=True)
    near = u @ u.T >= 0.95
    np.fill_diagonal(near, False)
    assert near.sum() > 2000 and sum(r[1] for r in out[0]) >= 0.97 * near.sum()


def test_plants_measure_recall(spark):
    """The share of plants that meet is the share of such pairs that passes find."""
    rng = np.random.default_rng(15)
    x = rng.standard_normal((2000, 24))
    good = embedding_dedup.usable(spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id bigint, embedding array<double>"))
    edges, share = embedding_dedup._edges(common.materialize(embedding_dedup._classes(good), "test-vectors"), 0.95, 16)
    assert edges.where("a < 0 or b < 0 or a >= 2000").count() == 0
    assert share >= embedding_dedup.TARGET
    assert np.allclose((embedding_dedup.partners(x / np.linalg.norm(x, axis=1, keepdims=True), 0.95) * x).sum(1) / np.linalg.norm(x, axis=1), 0.95)


def test_spanning_forest_of_a_matrix():
    rng = np.random.default_rng(2)
    near = rng.random((90, 90)) < 0.01
    near = (near | near.T) & ~np.eye(90, dtype=bool)
    a, b = embedding_dedup.spanning(near)
    assert near[a, b].all()
    assert components(90, zip(a.tolist(), b.tolist())) == components(90, np.argwhere(near).tolist())
    assert len(a) == 90 - len(set(components(90, np.argwhere(near).tolist())))


def test_embeddings_empty_and_repeated(spark):
    schema = "vec_id bigint, embedding array<float>, label int"
    assert embedding_dedup.near_duplicates(spark.createDataFrame([], schema)).count() == 0
    rows = embedding_dedup.near_duplicates(spark.createDataFrame([(2, [1.0, 0.0], 0), (2, [1.0, 0.0], 0), (1, [2.0, 0.0], 0), (None, [1.0, 0.0], 0)], schema)).collect()
    assert sorted((r.vec_id or 0, r.n_links, r.component_id or 0) for r in rows) == [(0, 0, 0), (1, 1, 1), (2, 1, 1), (2, 1, 1)]
