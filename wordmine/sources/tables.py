"""The driver's parquet tables and the corpora / lexicons derived from them.

Every reader names only the columns it needs, so the parquet scan prunes the
rest (``ReadSchema`` in the plan).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import lexicon_words

TABLES = ["region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events",
          "documents", "embeddings", "pages", "benchmark", "labels", "conversations"]


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def documents_corpus(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Corpus ``(doc_ix, text, shard, metadata)`` from ``documents``; ``source`` is the shard."""
    d = read_table(spark, sf_dir, "documents")
    return d.select(F.col("doc_id").cast("bigint").alias("doc_ix"), "text",
                    F.col("source").alias("shard"),
                    F.concat(F.lit('{"lang":"'), F.col("lang"), F.lit('","source":"'),
                             F.col("source"), F.lit('"}')).alias("metadata"))


def conversations_corpus(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Second corpus: one document per conversation turn; the role is the shard."""
    c = read_table(spark, sf_dir, "conversations")
    return c.select((F.shiftleft(F.col("conv_id").cast("bigint"), 32) + F.col("turn")).alias("doc_ix"), "text",
                    F.col("role").alias("shard"),
                    F.concat(F.lit('{"conv_id":'), F.col("conv_id").cast("string"),
                             F.lit(',"turn":'), F.col("turn").cast("string"), F.lit("}")).alias("metadata"))


def word_list(spark: SparkSession, sf_dir: str, source: str = "benchmark") -> DataFrame:
    """A17 stand-in: lower-cased a-z words of ``benchmark.text`` as ``(word, source)``."""
    b = read_table(spark, sf_dir, "benchmark").select("text")
    return (b.select(F.explode(lexicon_words("text")).alias("word"))
            .distinct().withColumn("source", F.lit(source)))


def title_list(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Encyclopedia-title stand-in: the ``<title>`` of every page, one row per page."""
    p = read_table(spark, sf_dir, "pages").select("html")
    title = F.regexp_extract("html", r"(?is)<title[^>]*>(.*?)</title>", 1)
    return (p.select(title.alias("title")).where(F.col("title") != "").distinct())


def title_words(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Single-word titles: lower-cased a-z runs of every page title, as ``(word, source)``."""
    t = title_list(spark, sf_dir)
    return (t.select(F.explode(lexicon_words("title")).alias("word"))
            .distinct().withColumn("source", F.lit("titles")))


# Which turns make up which stand-in dictionary; turns of other roles are in none.
DICTIONARY_ROLES = {"assistant": "collegiate", "user": "medical"}


def dictionary_entries(spark: SparkSession, sf_dir: str, roles: dict[str, str] = DICTIONARY_ROLES) -> DataFrame:
    """Dictionary stand-in: the words of the turns of each role in ``roles``, under its dictionary's name."""
    c = read_table(spark, sf_dir, "conversations").select("role", "text").where(F.col("role").isin(list(roles)))
    src = F.coalesce(*[F.when(F.col("role") == r, d) for r, d in roles.items()])
    return (c.select(src.alias("source"), F.explode(lexicon_words("text")).alias("word"))
            .distinct().select("word", "source"))
