"""Exact lexicon stages.

A lexicon is a DataFrame ``(word string, source string)``. Membership tests
are semi/anti joins on the word. Spark broadcasts a lexicon if its measured size
allows it; else the join shuffles on the word (and AQE splits a skewed word
partition).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..constants import DICTIONARY_SOURCES, MORPHY_RULES
from ..functions.text import clean_text, col_of


def morph_bases(c) -> Column:
    """Base-form candidates of a word under the detachment rules (word itself first)."""
    w = col_of(c)
    cands = [w]
    for suffix, repl in MORPHY_RULES:
        cands.append(F.when(w.endswith(suffix) & (F.length(w) > len(suffix)),
                            F.concat(F.substring(w, F.lit(1), F.length(w) - len(suffix)), F.lit(repl))))
    return F.array_distinct(F.array_compact(F.array(*cands)))


def in_lexicon(words: DataFrame, lexicon: DataFrame, flag: str, col: str = "word") -> DataFrame:
    """Add boolean ``flag`` = the word is listed (case-sensitive).

    ``words`` is a table of distinct words; the lexicon side is de-duplicated,
    so the left join keeps one row per word.
    """
    lex = lexicon.select(F.col("word").alias("_lw")).distinct()
    return (words.join(lex, F.col(col) == F.col("_lw"), "left")
            .withColumn(flag, F.col("_lw").isNotNull()).drop("_lw"))


def base_in_lexicon(words: DataFrame, lexicon: DataFrame, flag: str, col: str = "word") -> DataFrame:
    """``flag`` = the word or one of its base forms is listed (``words`` distinct)."""
    lex = lexicon.select(F.col("word").alias("_lw")).distinct()
    bases = words.select(F.col(col).alias("_bw"), F.explode(morph_bases(col)).alias("_b"))
    hit = (bases.join(lex, F.col("_b") == F.col("_lw"), "left_semi")
           .groupBy("_bw").agg(F.lit(True).alias(flag)))
    return (words.join(hit, F.col(col) == F.col("_bw"), "left")
            .withColumn(flag, F.coalesce(F.col(flag), F.lit(False))).drop("_bw"))


def read_lemma_lexicon(df: DataFrame) -> DataFrame:
    """A16 + C23: clean ``word`` and ``lemma`` of a morphology table, drop nulls."""
    return (df.select(clean_text("word").alias("word"), clean_text("lemma").alias("lemma"), "features")
            .na.drop("any"))


def lemma_exclude(rows: DataFrame, lemmas: DataFrame, col: str = "word") -> DataFrame:
    """Drop rows whose word is a listed form or lemma."""
    listed = (lemmas.select(F.col("word").alias("_lw"))
              .unionByName(lemmas.select(F.col("lemma").alias("_lw"))).where(F.col("_lw") != "").distinct())
    return rows.join(listed, F.col(col) == F.col("_lw"), "left_anti")


def dictionary_reason(words: DataFrame, entries: DataFrame, col: str = "word",
                      sources: list[str] = DICTIONARY_SOURCES) -> DataFrame:
    """Per word, the first dictionary (in ``sources`` order) that lists it, else null."""
    prio = F.array_position(F.array(*[F.lit(s) for s in sources]), F.col("source"))
    e = (entries.where(F.col("source").isin(sources))
         .groupBy(F.col("word").alias("_dw"))
         .agg(F.min_by("source", prio).alias("dict_source")))
    return words.join(e, F.col(col) == F.col("_dw"), "left").drop("_dw")


def valid_responses(responses: DataFrame) -> DataFrame:
    """C17: stored responses ``(word, api, status, body)`` that count as an entry.

    Valid = status 200 and the body parses to a non-empty JSON array whose
    first element is an object with a ``meta`` key.
    """
    first = F.get_json_object(F.col("body"), "$[0]")
    has_meta = F.coalesce(F.array_contains(F.json_object_keys(first), "meta"), F.lit(False))
    ok = (F.col("status") == 200) & F.ltrim(F.col("body")).startswith("[") & has_meta
    return responses.where(ok).select("word", F.col("api").alias("source"))
