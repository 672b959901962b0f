"""The training-data pipeline: documents in, packed sequences out.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame. All but the last return the columns of ``documents``.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm import jaccard_join, language_id, packing, quality_classifier, suffix_dedup
from tidemark.llm.common import materialize

COLUMNS = {"doc_id": "bigint", "text": "string", "lang": "string", "source": "string", "n_chars": "bigint"}
#: Near duplicates of the pipeline: wider than the op3 query, so that copies with spread one-word edits go too.
NEAR_WORDS, NEAR_PERCENT = 5, 80


def _documents(docs: DataFrame) -> DataFrame:
    return docs.select(*(F.col(c).cast(kind).alias(c) for c, kind in COLUMNS.items()))


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier takes for good; it learns from the labels of those that are not held out."""
    docs = _documents(docs)
    model = quality_classifier.train(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return quality_classifier.score_documents(docs, model, list(COLUMNS)).where("predicted = 1").select(*COLUMNS)


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language is told with confidence; ``lang`` stays as given."""
    docs = _documents(docs)
    return language_id.predict(docs, language_id.train(docs)).where(~F.col("rejected")).select(*COLUMNS)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group that shingles of NEAR_WORDS words link at NEAR_PERCENT, the one of smallest id; once where it stands in several rows.

    Documents are the distinct (doc_id, text), so rows of one id and different texts are judged each by itself. Rows without an id stay.
    """
    docs = _documents(docs)
    keyed, single = suffix_dedup.row_keys(docs.where("doc_id is not null"))
    groups = jaccard_join.ngram_jaccard_join(single, k=NEAR_WORDS, percent=NEAR_PERCENT)
    drop = materialize(groups.where("component_id != doc_id").select(F.col("doc_id").alias("row_key")).distinct(), "pipeline-near")
    # Rows repeated in full are near duplicates too.
    twice = materialize(keyed.groupBy("row_key").count().where("count > 1").select("row_key"), "pipeline-twice")
    kept = keyed.join(drop.hint("merge"), "row_key", "left_anti")
    if not twice.isEmpty():
        kept = kept.join(twice, "row_key", "left_anti").unionByName(kept.join(twice, "row_key", "left_semi").dropDuplicates(["row_key"]))
    return kept.select(*COLUMNS).unionByName(docs.where("doc_id is null"))


def repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents without their repeated passages. A character of which some bytes go, goes whole."""
    out = suffix_dedup.remove_repeats(_documents(docs), keep_text=True)
    out = out.withColumn("text", F.col("kept_text")).withColumn("n_chars", F.when(F.col("text").isNull(), F.col("n_chars")).otherwise(F.length("text").cast("bigint")))
    return out.select(*COLUMNS)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents in sequences of 2048 tokens."""
    import public_tokenizers

    return packing.pack(_documents(docs), public_tokenizers.path("byte_bpe_50k.json"))


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("quality classifier", quality),
    ("language identification", language),
    ("n-gram Jaccard join", near_duplicates),
    ("suffix-array deduplication", repeats),
    ("best-fit packing", pack),
]

#: Trained models and tokenizers are beyond SQL; tests hold the stages against brute force.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir), "pipeline-" + name.split()[0].lower())
    return STAGES[-1][1](spark, docs, sf_dir)
