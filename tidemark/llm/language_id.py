"""Language identification by averaged hashed subword embeddings (operator 6).

Each run of 2 to 4 bytes of the case-folded text hashes to a row of an embedding table; a document is the mean of its
rows, and a linear softmax reads the language off it. Table and softmax are trained together by stochastic gradient
descent in numpy on a bounded sample per language. A temperature fitted on a part of the sample kept from training
calibrates the probabilities; its targets are smoothed, so that a part without an error does not make every score 1. The
rejection threshold is a low quantile of the winning probability over the documents of that part that were read rightly.

Defined results: a null text, or one without a letter, is ``und`` with score 0 and rejected. With no language to learn
from, every document is ``und``. Rows without doc_id are predicted and never train, nor do texts without a letter.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from tidemark.llm.common import give_back, text_rows

BUCKETS, DIM, SIZES = 1 << 13, 16, (2, 3, 4)
#: The fit reads at most this many documents of each language, those with the smallest hashes of their ids.
PER_LANGUAGE = 1_200
#: The fit learns at most this many languages, those of most documents.
LANGUAGES = 1_000
EPOCHS, BATCH, RATE = 12, 32, 0.5
#: Of documents like those of the calibration part, this share is rejected.
REJECTED_SHARE = 0.005
#: So many of the lowest calibration scores never decide the threshold; it is at most HIGHEST.
SPARED, HIGHEST = 2, 0.9
UNDETERMINED = "und"


def folded(data: np.ndarray) -> np.ndarray:
    """ASCII and Latin-1 letters in lower case, other ASCII characters as spaces."""
    table = np.full(256, 32, np.uint8)
    table[97:123] = np.arange(97, 123)
    table[65:91] = np.arange(97, 123)
    table[128:] = np.arange(128, 256)
    out = table[data]
    latin = np.zeros(len(out), bool)
    latin[1:] = (out[:-1] == 0xC3) & (out[1:] >= 0x80) & (out[1:] <= 0x9E) & (out[1:] != 0x97)
    out[latin] += 0x20
    return out


def has_letter(data: np.ndarray) -> bool:
    if (((data | 32) >= 97) & ((data | 32) <= 122)).any():
        return True
    return bool((data >= 128).any()) and any(map(str.isalpha, data.tobytes().decode("utf-8", "ignore")))


def subword_counts(data: np.ndarray) -> np.ndarray:
    """How often each bucket is hit by the runs of SIZES bytes; runs of spaces alone do not count."""
    x = np.concatenate([[32], folded(data), [32]]).astype(np.uint32)
    out = np.zeros(BUCKETS, np.int64)
    code, spaces = x.copy(), x == 32
    for n in range(2, max(SIZES) + 1):
        if len(x) < n:
            break
        code = code[:-1] * np.uint32(0x01000193) ^ x[n - 1 :]
        spaces = spaces[:-1] & (x[n - 1 :] == 32)
        if n in SIZES:
            spread = (code ^ (code >> np.uint32(15))) * np.uint32(0x2C1B3C6D)
            hit = (spread >> np.uint32(32 - BUCKETS.bit_length() + 1)).astype(np.int64)
            out += np.bincount(hit[~spaces] if spaces.any() else hit, minlength=BUCKETS)
    return out


@dataclass(frozen=True)
class LanguageModel:
    languages: tuple[str, ...]
    embeddings: np.ndarray
    softmax: np.ndarray
    bias: np.ndarray
    temperature: float = 1.0
    threshold: float = 0.0

    def table(self) -> np.ndarray:
        """Embedding table times softmax weights: the mean of rows and the linear layer commute."""
        return self.embeddings @ self.softmax

    def probabilities(self, counts: np.ndarray, table: np.ndarray) -> np.ndarray:
        z = (counts @ table / np.maximum(counts.sum(-1, keepdims=True), 1) + self.bias) / self.temperature
        z = np.exp(z - z.max(-1, keepdims=True))
        return z / z.sum(-1, keepdims=True)


def _log_loss(z: np.ndarray, y: np.ndarray, temperature: float) -> float:
    """Against targets that give 1 / (rows + 2) to all languages alike."""
    z = z / temperature
    z = z - z.max(1, keepdims=True)
    smooth = 1 / (len(y) + 2)
    return float((np.log(np.exp(z).sum(1)) - (1 - smooth) * z[np.arange(len(y)), y] - smooth * z.mean(1)).mean())


def _threshold(p: np.ndarray, y: np.ndarray) -> float:
    """A low quantile of the winning probability where the winner is right; a few odd rows do not move it."""
    top = np.sort(p.max(1)[p.argmax(1) == y])
    if not len(top):
        return 0.0
    return min(float(top[min(max(int(REJECTED_SHARE * len(top)), SPARED), len(top) - 1)]), HIGHEST)


#: The buckets a document hits, and how often.
Sparse = tuple[np.ndarray, np.ndarray]


def _dense(rows: list[Sparse]) -> np.ndarray:
    """Shares of the buckets, a row for each document."""
    out = np.zeros((len(rows), BUCKETS), np.float32)
    for i, (bucket, n) in enumerate(rows):
        out[i, bucket] = n / max(n.sum(), 1)
    return out


def fit(docs: list[Sparse], langs: list[str], seed: int = 11) -> LanguageModel:
    """Train, then calibrate on every fifth document of the shuffled sample. Only a batch at a time is made dense."""
    names = tuple(sorted(set(langs)))
    if not names:
        return LanguageModel((), np.zeros((BUCKETS, DIM)), np.zeros((DIM, 0)), np.zeros(0))
    rng = np.random.default_rng(seed)
    y = np.array([names.index(x) for x in langs])
    order = rng.permutation(len(y))
    kept, aside = (order[np.arange(len(y)) % 5 != 0], order[np.arange(len(y)) % 5 == 0]) if len(y) >= 20 else (order, order)
    e = (rng.standard_normal((BUCKETS, DIM)) / DIM).astype(np.float32)
    w = (rng.standard_normal((DIM, len(names))) / np.sqrt(DIM)).astype(np.float32)
    b = np.zeros(len(names), np.float32)
    weight = (len(y) / len(names) / np.maximum(np.bincount(y, minlength=len(names)), 1)).astype(np.float32)
    for epoch in range(EPOCHS):
        rate = np.float32(RATE * (1 - epoch / EPOCHS))
        for at in range(0, len(kept), BATCH):
            rows = rng.permutation(kept)[:BATCH] if len(kept) <= BATCH else kept[at : at + BATCH]
            xb, yb = _dense([docs[i] for i in rows]), y[rows]
            h = xb @ e
            z = h @ w + b
            p = np.exp(z - z.max(1, keepdims=True))
            p /= p.sum(1, keepdims=True)
            p[np.arange(len(rows)), yb] -= 1
            p *= weight[yb][:, None] / len(rows)
            back = p @ w.T
            w -= rate * (h.T @ p)
            b -= rate * p.sum(0)
            e -= rate * BUCKETS / 32 * (xb.T @ back)
        kept = rng.permutation(kept)
    e, w, b = e.astype(float), w.astype(float), b.astype(float)
    table = e @ w
    z = np.stack([docs[i][1] @ table[docs[i][0]] / max(docs[i][1].sum(), 1) for i in aside]) + b
    grid = np.geomspace(0.02, 5, 60)
    temperature = float(grid[np.argmin([_log_loss(z, y[aside], t) for t in grid])])
    p = np.exp((z - z.max(1, keepdims=True)) / temperature)
    p /= p.sum(1, keepdims=True)
    threshold = _threshold(p, y[aside])
    return LanguageModel(names, e, w, b, temperature, threshold)


def held_out(doc_id: Column) -> Column:
    """crc32 of the id as text, modulo 4, is 2."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 4 == 2, F.lit(False))


def train(documents: DataFrame, per_language: int = PER_LANGUAGE) -> LanguageModel:
    """Fit on at most ``per_language`` documents of each language outside the held-out fold.

    Counts per language (a row for each language) give the share of hashes that leaves about twice as many, so the
    ranked window reads a bounded number of rows however many documents and tasks there are.
    """
    ids = documents.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("lang").cast("string").alias("lang"))
    ids = ids.where(F.col("doc_id").isNotNull() & F.col("lang").isNotNull() & ~held_out(F.col("doc_id")))
    counts = ids.groupBy("lang").count().orderBy(F.desc("count"), "lang").limit(LANGUAGES).collect()
    if counts:
        share = F.create_map(*(F.lit(x) for r in counts for x in (r["lang"], min(1.0, (2 * per_language + 50) / r["count"]))))
        ids = ids.where(F.pmod(F.xxhash64("doc_id"), F.lit(1 << 30)) < share[F.col("lang")] * (1 << 30))
    rank = F.row_number().over(Window.partitionBy("lang").orderBy(F.pmod(F.xxhash64("doc_id"), F.lit(1 << 30)), "doc_id"))
    chosen = ids.withColumn("rank", rank).where(F.col("rank") <= per_language).select("doc_id", "lang").distinct()
    texts = documents.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text"))
    # Bounded by per_language ids for each language.
    texts = texts.where(F.col("text").isNotNull()).join(F.broadcast(chosen), "doc_id")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            batch = batch.filter(pa.array([has_letter(x) for x in text_rows(batch.column("text"))], pa.bool_()))
            found = [subword_counts(x) for x in text_rows(batch.column("text"))]
            hit = [np.flatnonzero(c) for c in found]
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), batch.column("lang"), pa.array([h.astype(np.int16) for h in hit], pa.list_(pa.int16())), pa.array([c[h].astype(np.int32) for c, h in zip(found, hit)], pa.list_(pa.int32()))],
                ["doc_id", "lang", "bucket", "n"],
            )

    rows = texts.mapInArrow(run, "doc_id bigint, lang string, bucket array<smallint>, n array<int>")
    # One row an id and language, however often it stands there.
    rows = rows.groupBy("doc_id", "lang").agg(F.min(F.struct("bucket", "n")).alias("x")).select("doc_id", "lang", "x.*").toArrow()
    order = pc.sort_indices(rows, [("doc_id", "ascending"), ("lang", "ascending")]).to_pylist()  # the rows themselves are not copied
    docs = [(b.values.to_numpy(), n.values.to_numpy()) for b, n in zip(rows.column("bucket"), rows.column("n"))]
    langs = rows.column("lang").to_pylist()
    model = fit([docs[i] for i in order], [langs[i] for i in order])
    del rows, docs
    give_back()
    return model


def predict(documents: DataFrame, model: LanguageModel) -> DataFrame:
    """``documents`` with ``lang_pred``, ``score`` and ``rejected``; the other columns pass through."""
    schema = T.StructType([*documents.schema.fields, T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType()), T.StructField("rejected", T.BooleanType())])
    table = model.table()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            langs, scores = [], []
            for x in text_rows(batch.column("text")):
                if x is None or not model.languages or not has_letter(x):
                    langs.append(UNDETERMINED)
                    scores.append(0.0)
                    continue
                p = model.probabilities(subword_counts(x).astype(float), table)
                best = int(p.argmax())
                langs.append(model.languages[best])
                scores.append(float(p[best]))
            rejected = [lang == UNDETERMINED or s < model.threshold for lang, s in zip(langs, scores)]
            yield pa.RecordBatch.from_arrays(
                [*batch.columns, pa.array(langs, pa.string()), pa.array(scores, pa.float64()), pa.array(rejected, pa.bool_())],
                schema=pa.schema([*batch.schema, ("lang_pred", pa.string()), ("score", pa.float64()), ("rejected", pa.bool_())]),
            )

    return documents.mapInArrow(run, schema)


def language_id(documents: DataFrame) -> DataFrame:
    """doc_id, held_out, lang_pred, score and rejected of every document."""
    model = train(documents)
    d = documents.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return predict(d, model).select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score", "rejected")
