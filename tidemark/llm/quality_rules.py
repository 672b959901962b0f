"""Quality rules whose thresholds adapt to each language and source (operator 1).

One pass over the whole texts takes plain counts. A mergeable quantile sketch of each ratio, per language and source,
then gives the fences that a document must keep. The sketch is a log-linear histogram: integer buckets at most 1/32
wide, so two sketches merge by adding counts, and building one is a partial aggregation however large a source is.

A fence stands where quantiles of the group put it: from the 90th percentile a share of the way to the 99th, or beyond it; a low one
likewise from the 10th to the 1st. The quantiles of a group are averaged with those of its language, and these with those
of all documents, with the weight of PRIOR documents: so a small source leans on its parent and a large one stands for itself.

Defined results: a null or empty text has zero words and fails the base rule; null language and null source are groups
of their own; each repeated row is judged by itself; other columns of the input are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tidemark.llm import hashing
from tidemark.llm.common import materialize, text_rows

#: Symbol characters of the base statistics.
SYMBOLS = "#*$%&|<>"
STATS = "doc_id bigint, lang string, source string, n_words bigint, word_chars bigint, n_symbols bigint, n_dup_lines bigint, n_repeat_words bigint, n_lines bigint"


@dataclass(frozen=True)
class Rule:
    """A ratio in thousandths, and how far the fences stand beyond the 90th and 10th percentile, in eighths of the way to the 99th and 1st."""

    name: str
    top: str
    bottom: str
    high: int
    low: int | None = None


RULES = (
    Rule("mean_word", "word_chars", "n_words", 4, 12),
    Rule("symbols", "n_symbols", "n_words", 1),
    Rule("dup_lines", "n_dup_lines", "n_lines", 12),
    Rule("repeats", "n_repeat_words", "n_words", 16),
)
#: Percentiles of the sketches: from low buckets the lower edge, from high ones the upper edge is taken.
PERCENTS = (1, 10, 90, 99)
#: Weight, in documents, of the quantiles of the language for a source, and of all documents for a language.
PRIOR = 200
#: Each row of the small threshold table is repeated for so many parts of a source, so that one source is not one task.
SALTS = 16


def text_stats(data: np.ndarray) -> tuple[int, int, int, int, int, int]:
    """n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words and lines with a word, of one text in UTF-8."""
    kinds = _kinds()[data]
    n_symbols, gaps = int((kinds == 1).sum()), int((kinds == 2).sum())
    word_chars = len(data) - int((kinds == 3).sum()) - gaps
    words = hashing.word_hashes(data)
    lines = [x for x in data.tobytes().split(b"\n") if x.strip(hashing.SPACES)]
    repeats = 0
    if len(words) >= 3:
        grams = hashing.windows(words, 3)
        _, where, counts = np.unique(grams, return_inverse=True, return_counts=True)
        if len(counts) < len(grams):
            twice = counts[where] > 1
            covered = np.zeros(len(words), bool)
            for i in range(3):
                covered[i : i + len(grams)] |= twice
            repeats = int(covered.sum())
    return len(words), word_chars, n_symbols, len(lines) - len(set(lines)), repeats, len(lines)


def _kinds(made: list = []) -> np.ndarray:  # noqa: B006  one table for each worker
    """For each byte: 1 symbol, 2 space, 3 continuation byte of UTF-8, else 0."""
    if not made:
        table = np.zeros(256, np.uint8)
        table[list(SYMBOLS.encode())] = 1
        table[list(hashing.SPACES)] = 2
        table[0x80:0xC0] = 3
        made.append(table)
    return made[0]


def _stats_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    names = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines"]
    for batch in batches:
        rows = [(0,) * 6 if x is None else text_stats(x) for x in text_rows(batch.column("text"))]
        counts = np.array(rows, np.int64).reshape(-1, 6)
        yield pa.RecordBatch.from_arrays(
            [batch.column("doc_id"), batch.column("lang"), batch.column("source"), *(pa.array(counts[:, i]) for i in range(6))],
            ["doc_id", "lang", "source", *names],
        )


def statistics(documents: DataFrame) -> DataFrame:
    """The counts of every document, and ``base_failed``."""
    d = documents.select(F.col("doc_id").cast("bigint"), F.col("text").cast("string"), F.col("lang").cast("string"), F.col("source").cast("string"))
    failed = (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))
    return d.mapInArrow(_stats_batches, STATS).withColumn("base_failed", failed)


def _value(rule: Rule) -> Column:
    return F.when(F.col(rule.bottom) > 0, F.expr(f"(1000 * {rule.top}) div {rule.bottom}")).otherwise(F.lit(0).cast("bigint"))


def sketches(stats: DataFrame) -> DataFrame:
    """(lang, source, rule, bucket, n): the quantile sketches of the documents that pass the base rule."""
    parts = ", ".join(f"'{r.name}', v_{r.name}" for r in RULES)
    values = stats.where("not base_failed").select("lang", "source", *(_value(r).alias(f"v_{r.name}") for r in RULES))
    long = values.select("lang", "source", F.expr(f"stack({len(RULES)}, {parts}) as (rule, v)"))
    shift = F.greatest(F.length(F.bin("v")) - 6, F.lit(0))
    long = long.withColumn("shift", shift).select("lang", "source", "rule", F.expr("cast(32 * shift + shiftright(v, shift) as bigint)").alias("bucket"))
    return long.groupBy("lang", "source", "rule", "bucket").agg(F.count("*").alias("n"))


def _quantiles(sketch: DataFrame, keys: list[str]) -> DataFrame:
    """``total`` and the PERCENTS of each rule, ``q1`` to ``q99``, for the sketches merged over ``keys``."""
    merged = sketch.groupBy(*keys, "rule", "bucket").agg(F.sum("n").alias("n"))
    w = Window.partitionBy(*keys, "rule")
    ranked = merged.select("*", F.sum("n").over(w.orderBy("bucket")).alias("upto"), F.sum("n").over(w).alias("total"))
    shift = "cast(greatest(bucket div 32 - 1, 0) as int)"
    low = f"shiftleft(bucket - 32 * {shift}, {shift})"
    edge = lambda p: F.expr(low if p < 50 else f"{low} + shiftleft(1L, {shift}) - 1")
    return ranked.groupBy(*keys, "rule").agg(F.max("total").alias("total"), *(F.min(F.when(F.col("upto") * 100 >= F.col("total") * p, edge(p))).alias(f"q{p}") for p in PERCENTS))


def thresholds(stats: DataFrame, sketch: DataFrame, prior: int = PRIOR) -> DataFrame:
    """One row per language and source: the fences ``lo_<rule>`` and ``hi_<rule>``."""
    rules = F.array(*(F.struct(F.lit(r.name).alias("rule"), F.lit(r.high).alias("high"), F.lit(r.low).alias("low")) for r in RULES))
    out = stats.select("lang", "source").distinct().select("lang", "source", F.inline(rules))
    levels = (["lang", "source"], ["lang"], [])
    for i, keys in enumerate(levels):
        q = _quantiles(sketch, keys)
        q = q.select(*(F.col(k).alias(f"{k}_{i}") for k in keys), F.col("rule").alias(f"rule_{i}"), *(F.col(c).alias(f"{c}_{i}") for c in ("total", *(f"q{p}" for p in PERCENTS))))
        same = F.col("rule") == F.col(f"rule_{i}")
        for k in keys:
            same &= F.col(k).eqNullSafe(F.col(f"{k}_{i}"))
        out = out.join(q, same, "left")
    for p in PERCENTS:
        out = out.withColumn(f"q{p}", F.col(f"q{p}_2"))
        for i in (1, 0):
            out = out.withColumn(f"q{p}", F.coalesce(F.expr(f"(total_{i} * q{p}_{i} + {prior} * q{p}) div (total_{i} + {prior})"), F.col(f"q{p}")))
    high, low = F.expr("q90 + (high * (q99 - q90)) div 8"), F.expr("q10 - (low * (q10 - q1)) div 8")
    out = out.select("lang", "source", "rule", high.alias("hi"), low.alias("lo"))
    return out.groupBy("lang", "source").agg(*(F.max(F.when(F.col("rule") == r.name, F.col(c))).alias(f"{c}_{r.name}") for r in RULES for c in ("hi", "lo")))


def quality_rules(documents: DataFrame, prior: int = PRIOR) -> DataFrame:
    """Every document with its counts, ``base_failed``, the rules it breaks and ``kept``."""
    stats = materialize(statistics(documents), "quality-stats")
    sketch = materialize(sketches(stats), "quality-sketch")
    fences = thresholds(stats, sketch, prior)
    fences = fences.select(F.col("lang").alias("f_lang"), F.col("source").alias("f_source"), *(c for c in fences.columns if c not in ("lang", "source")))
    fences = fences.withColumn("f_salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    salted = stats.withColumn("salt", F.pmod(F.xxhash64("doc_id"), F.lit(SALTS)).cast("int"))
    same = (F.col("salt") == F.col("f_salt")) & F.col("lang").eqNullSafe(F.col("f_lang")) & F.col("source").eqNullSafe(F.col("f_source"))
    joined = salted.join(fences, same, "left")
    broken = [F.when((_value(r) > F.col(f"hi_{r.name}")) | (_value(r) < F.col(f"lo_{r.name}")), F.lit(r.name)) for r in RULES]
    out = joined.withColumn("broken", F.array_join(F.array_compact(F.array(*broken)), ","))
    return out.select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", (~F.col("base_failed") & (F.col("broken") == "")).alias("kept"), "broken"
    )
