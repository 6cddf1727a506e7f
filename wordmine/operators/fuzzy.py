"""Near-match stages (C10-C13, C15) as equi-joins.

A bare ``levenshtein(a, b) <= 1`` join condition plans as a nested-loop join.
Instead both sides are exploded into their *deletion neighbourhood* (the
string itself and every string with one character deleted); two strings are
within distance 1 only if their neighbourhoods share a key, so an equi-join
on the key followed by an exact ``levenshtein`` check finds every pair.

Size of the join: a word of length L has at most L+1 keys. For one key the
partners are strings equal to it or one insertion away, at most
1 + |alphabet| * (L+1) of them, so the pairs per key are bounded by a
constant independent of the data size; both sides are de-duplicated first.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..constants import TYPO_DISTANCE
from ..functions.text import col_of, lexicon_words


def deletion_keys(c) -> Column:
    """The string and every string obtained by deleting one character."""
    w = col_of(c)
    dels = F.transform(F.sequence(F.lit(1), F.greatest(F.length(w), F.lit(1))),
                       lambda i: F.concat(F.substring(w, F.lit(1), i - 1), F.substring(w, i + 1, 1 << 30)))
    return F.array_distinct(F.concat(F.array(w), F.when(F.length(w) > 0, dels).otherwise(F.array())))


def near_pairs(words: DataFrame, lexicon: DataFrame, col: str = "word",
               max_dist: int = TYPO_DISTANCE, lex_col: str = "word") -> DataFrame:
    """All (word, entry) pairs with Levenshtein distance <= ``max_dist`` (0 or 1).

    ``words`` and ``lexicon`` may carry extra columns; the lexicon's are kept.
    """
    if max_dist not in (0, 1):
        raise ValueError("deletion neighbourhoods cover distance 0 and 1 only")
    w = words.select(F.col(col).alias("_w")).distinct()
    lex = lexicon.withColumnRenamed(lex_col, "_e")
    if max_dist == 0:
        return w.join(lex, F.col("_w") == F.col("_e"))
    wk = w.select("_w", F.explode(deletion_keys("_w")).alias("_k"))
    lk = lex.select("*", F.explode(deletion_keys("_e")).alias("_k"))
    pairs = (wk.join(lk, "_k")
             .where(F.levenshtein(F.col("_w"), F.col("_e"), max_dist) >= 0)
             .drop("_k").distinct())
    return pairs


def near_flag(words: DataFrame, lexicon: DataFrame, flag: str, col: str = "word",
              max_dist: int = TYPO_DISTANCE) -> DataFrame:
    """``flag`` = some lexicon entry lies within ``max_dist`` (``words`` distinct)."""
    hit = (near_pairs(words, lexicon.select("word").distinct(), col, max_dist)
           .groupBy("_w").agg(F.lit(True).alias(flag)))
    return (words.join(hit, F.col(col) == F.col("_w"), "left")
            .withColumn(flag, F.coalesce(F.col(flag), F.lit(False))).drop("_w"))


def checker_cascade(words: DataFrame, checkers: list[tuple[str, DataFrame]], col: str = "word",
                    max_dist: int = TYPO_DISTANCE) -> DataFrame:
    """The first checker (in list order) that knows the word or a word
    within ``max_dist`` of it; one neighbourhood join for all checkers.

    Adds ``spell_checker`` (name or null).
    """
    lex = None
    for pos, (name, df) in enumerate(checkers):
        part = df.select("word").distinct().select("word", F.lit(pos).alias("_cp"), F.lit(name).alias("_cn"))
        lex = part if lex is None else lex.unionByName(part)
    hit = (near_pairs(words, lex, col, max_dist)
           .groupBy("_w").agg(F.min_by("_cn", "_cp").alias("spell_checker")))
    return words.join(hit, F.col(col) == F.col("_w"), "left").drop("_w")


def title_substrings(titles: DataFrame, lo: int, hi: int) -> DataFrame:
    """Every substring of length lo..hi of the a-z runs of the lower-cased titles."""
    runs = titles.select(F.explode(lexicon_words("title")).alias("_r")).distinct()
    starts = runs.select("_r", F.explode(F.sequence(F.lit(1), F.length("_r"))).alias("_s"))
    subs = starts.select("_r", "_s", F.explode(F.sequence(F.lit(lo), F.lit(hi))).alias("_n"))
    return (subs.where(F.col("_s") + F.col("_n") - 1 <= F.length("_r"))
            .select(F.substring("_r", F.col("_s"), F.col("_n")).alias("_sub")).distinct())


def title_contains_flag(words: DataFrame, titles: DataFrame, flag: str, col: str = "word",
                        lo: int = 4, hi: int = 22) -> DataFrame:
    """C15 (older variant): ``flag`` = some lower-cased title contains the word.

    ``words`` must be a-z strings of length lo..hi (what the shape stage
    keeps; a word of another length is an error); such a word occurs in a title
    only inside one a-z run, so an equi-join with the run substrings is exact.
    """
    subs = title_substrings(titles, lo, hi)
    return (words.join(subs, F.col(col) == F.col("_sub"), "left")
            .withColumn(flag, F.when(F.length(col).between(lo, hi), F.col("_sub").isNotNull())
                        .otherwise(F.raise_error(F.lit(f"words must have {lo} to {hi} letters")))).drop("_sub"))
