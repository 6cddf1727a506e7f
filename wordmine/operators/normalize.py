"""Word normalisation and shape stages (C1-C6, C23) as per-row expressions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..constants import MAX_WORD_LEN, MIN_WORD_LEN
from ..functions.text import length_ok, letters_only, no_triple_run, normalise_word


def preprocess(total: DataFrame) -> DataFrame:
    """Keep the extracted form as ``org``; ``word`` = normalised form or null."""
    return total.withColumn("org", F.col("word")).withColumn("word", normalise_word("org"))


def shape_ok(c="word", lo: int = MIN_WORD_LEN, hi: int = MAX_WORD_LEN) -> Column:
    """C5 and C6 together."""
    return length_ok(c, lo, hi) & no_triple_run(c)


def shape_filter(rows: DataFrame, col: str = "word", variant: str = "current") -> DataFrame:
    """Keep words of the right shape; ``variant='older'`` also demands letters only."""
    cond = shape_ok(col)
    if variant == "older":
        cond = letters_only(col) & cond
    return rows.where(cond)
