"""File sources and sinks with explicit schemas.

No reader infers a schema: a column of nulls can never change type.
"""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import lexicon_words
from ..session import fresh_path

# Landed documents as the acquisition step writes them: spans are [text, label] pairs.
# ``shard``/``rank``/``pos`` record the fetch order; files without them read as null.
LANDED_JSON_SCHEMA = ("doc_ix bigint, metadata string, spans array<array<string>>, "
                      "shard string, rank bigint, pos bigint")
# The extraction ("total") table.
TOTAL_CSV_SCHEMA = "idx bigint, span_id bigint, doc_ix bigint, word string, sentence string, query string"
# Morphology lexicon: word, lemma, features (tab separated, no header).
LEMMA_TSV_SCHEMA = "word string, lemma string, features string"
# Expression work list.
WORKLIST_SCHEMA = "expression string, status string"


def query_slug(c="query"):
    """The phrase with blanks replaced by ``_`` (one folder per expression)."""
    return F.regexp_replace(F.col(c), r"\s+", "_")


def spans_to_structs(c="spans"):
    return F.transform(F.col(c), lambda s: F.struct(s[0].alias("text"), s[1].alias("label")))


def spans_to_arrays(c="spans"):
    return F.transform(F.col(c), lambda s: F.array(s["text"], s["label"]))


def read_landed_json(spark: SparkSession, path: str, multi_line: bool = True) -> DataFrame:
    """Landed documents from JSON (a JSON array per file when ``multi_line``).

    A multi-line file is read by one task; land such files once as Parquet.
    Partition folders ``query_slug=...`` become a column, so a filter on it
    prunes folders.
    """
    df = (spark.read.schema(LANDED_JSON_SCHEMA + ", query_slug string")
          .option("multiLine", multi_line).json(path))
    return df.withColumn("spans", spans_to_structs())


def write_landed_json(landed: DataFrame, path: str) -> None:
    """JSON lines, one folder per expression."""
    (landed.select("doc_ix", "metadata", spans_to_arrays().alias("spans"), "shard", "rank", "pos",
                   query_slug().alias("query_slug"))
     .write.mode("overwrite").partitionBy("query_slug").json(path))


#: Windows of an array file.
ARRAY_WINDOWS = 10_000


def write_landed_json_arrays(landed: DataFrame, path: str) -> None:
    """A JSON array per file, one folder per expression; a file holds at most ARRAY_WINDOWS of a bucket's windows.

    Ranks are dense inside (expression, shard), so a stretch of them bounds an array.
    """
    doc = F.struct("doc_ix", "metadata", spans_to_arrays().alias("spans"), "shard", "rank", "pos")
    arrays = landed.groupBy(query_slug().alias("query_slug"), "bucket", "shard", F.floor(F.col("rank") / ARRAY_WINDOWS)).agg(F.to_json(F.collect_list(doc)).alias("value"))
    (arrays.select("query_slug", "value").write.mode("overwrite").option("maxRecordsPerFile", 1)
     .partitionBy("query_slug").text(path))


CSV_OPTS = {"header": "true", "multiLine": "true", "escape": '"', "quote": '"'}


def write_csv(df: DataFrame, path: str, partition_by: list[str] | None = None) -> None:
    """CSV with header; sentences may hold quotes and newlines (RFC-4180 quoting)."""
    writer = df.write.mode("overwrite").options(**CSV_OPTS)
    (writer.partitionBy(*partition_by) if partition_by else writer).csv(path)


def read_total_csv(spark: SparkSession, path: str, schema: str = TOTAL_CSV_SCHEMA) -> DataFrame:
    """The extraction table from CSV, explicit schema."""
    return spark.read.schema(schema).options(**CSV_OPTS).csv(path)


def write_tsv(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").option("sep", "\t").option("header", "false").csv(path)


def read_lemma_tsv(spark: SparkSession, path: str) -> DataFrame:
    """Morphology lexicon ``word<TAB>lemma<TAB>features`` (no header)."""
    return spark.read.schema(LEMMA_TSV_SCHEMA).option("sep", "\t").option("header", "false").csv(path)


def read_word_list(spark: SparkSession, path: str, source: str) -> DataFrame:
    """A word list from plain text (any file of words), as ``(word, source)``."""
    t = spark.read.text(path)
    return (t.select(F.explode(lexicon_words("value")).alias("word")).distinct()
            .withColumn("source", F.lit(source)))


def read_worklist(spark: SparkSession, path: str) -> DataFrame:
    """A12 source: ``expression,status`` CSV with header."""
    return spark.read.schema(WORKLIST_SCHEMA).option("header", "true").csv(path)


def table_complete(spark: SparkSession, path: str) -> bool:
    """True if a finished write (its ``_SUCCESS`` marker) exists at ``path``."""
    try:
        spark.read.text(path.rstrip("/") + "/_SUCCESS")
        return True
    except AnalysisException as e:
        if e.getCondition() == "PATH_NOT_FOUND":
            return False
        raise


def materialise_once(spark: SparkSession, path: str, build, fmt: str = "parquet",
                     partition_by: list[str] | None = None) -> DataFrame:
    """Reuse the table at ``path`` if a complete one exists, else build and write it."""
    if not table_complete(spark, path):
        w = build().write.mode("overwrite").format(fmt)
        if partition_by:
            w = w.partitionBy(*partition_by)
        w.save(path)
    return spark.read.format(fmt).load(path)


def scratch(spark: SparkSession, name: str) -> str:
    """A fresh folder under the shared checkpoint folder."""
    return fresh_path(spark, name)
