"""A training corpus from ``documents``: quality, language, near-duplicates, personal data, packing.

Every stage is a function (spark, docs, sf_dir) -> DataFrame that uses one
operator of ``wordmine.llm`` and works on all rows that its predecessor kept.
All but the last return the columns of the documents table.

Defined results: rows with a null text are scored as empty ones by the quality
stage and go at the language stage at the latest, as no language can be told;
rows without a doc_id stay until packing, each a document of its own; of rows
that share a doc_id one passes the near-duplicate stage; further columns pass
through, whatever their names, but for those that begin with an underscore.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from wordmine.llm import jaccard, langid, packing, pii, quality
from wordmine.llm.common import held_out
from wordmine.session import materialise

LEAST_QUALITY = 0.3
LEAST_LANGUAGE_SCORE = 0.5


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose quality score is at least LEAST_QUALITY."""
    model = quality.train(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"), ~held_out())
    return quality.with_quality(docs, model).filter(F.col("_quality") >= LEAST_QUALITY).drop("_quality")


def language_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language is told with a score of at least LEAST_LANGUAGE_SCORE; a null lang is filled in."""
    model = langid.train(docs, ~held_out())
    found = langid.with_language(docs, model)
    known = (F.col("_language.label") != "und") & (F.col("_language.score") >= LEAST_LANGUAGE_SCORE)
    return found.filter(known).withColumn("lang", F.coalesce("lang", "_language.label")).drop("_language")


def near_duplicate_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document, that of the smallest id, of each group linked by a Jaccard similarity of 0.8 of five-word shingles."""
    groups = jaccard.linked_groups(docs, p=4, q=5, words_each=5)
    first = (groups.filter("doc_id = component_id").select(F.col("doc_id").alias("_id")).distinct())
    kept = docs.join(first, F.col("doc_id") == F.col("_id"), "left_semi").dropDuplicates(["doc_id"])
    return kept.unionByName(docs.filter("doc_id is null"))


def pii_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Personal data replaced by its kind in brackets."""
    clean = pii.redact(docs, pii.find_spans(docs)).select(*docs.columns)
    return clean.withColumn("n_chars", F.length("text").cast("bigint")) if "n_chars" in docs.columns else clean


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of the documents' token ids in sequences of at most 2048."""
    return packing.pack_documents(docs, public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.PATTERN, size=2048)


STAGES = [
    ("quality", quality_stage),
    ("language", language_stage),
    ("near_duplicates", near_duplicate_stage),
    ("pii", pii_stage),
    ("packing", packing_stage),
]

#: Trained models and a tokenizer: no SQL for this; see tests/llm/test_pipeline.py.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages one after the other, each written as Parquet and read again by the next."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = materialise(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
