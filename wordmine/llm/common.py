"""Shared DataFrame helpers of this subpackage."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from wordmine.session import fresh_path

def vocabulary(name: str) -> str:
    """Path of a public vocabulary file; every operator takes such a path as a parameter."""
    import public_tokenizers

    return public_tokenizers.path(name)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def held_out(id_col: str = "doc_id", fold: int = 0, folds: int = 5) -> Column:
    """Whether crc32 of the id as text falls into the fold kept out of training.

    A null id counts as the text ``null``, so every row has a fold.
    """
    return F.crc32(F.coalesce(F.col(id_col).cast("string"), F.lit("null")).cast("binary")) % folds == fold


#: Rows of whole texts that pass between Spark and a Python worker at once.
ROWS_AT_ONCE = 1000


def bound_batches(spark: SparkSession) -> None:
    """Set the session's Arrow batches to ROWS_AT_ONCE rows, where no smaller number is set.

    Spark's own 10,000 rows of documents are held four times by a task: as Arrow
    buffers and as a message in the JVM, and as both in the Python worker.
    """
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(spark.conf.get(name)) <= ROWS_AT_ONCE:
        spark.conf.set(name, str(ROWS_AT_ONCE))


def id_and_text(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Only the id and the text, as ``doc_id`` and ``text``: further columns of ``docs`` cannot clash."""
    bound_batches(docs.sparkSession)
    return docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text"))


def shared_uri(spark: SparkSession, name: str) -> str:
    """A new folder below the shared one, as a URI if it has no scheme."""
    path = fresh_path(spark, name)
    return path if "://" in path else f"file://{path}"
