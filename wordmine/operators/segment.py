"""Subword segmentation.

E1 derives piece statistics from a weighted word table ``(word, n)``: every
substring of 1..``MAX_PIECE_LEN`` letters is a unigram, every pair of
adjacent substrings (and ``<s>`` before a word-initial piece) a bigram, each
weighted by the word's count. Pure explodes and grouped sums.

E2 segments each distinct word with a beam search. Spark builds and scores
the word's lattice with joins against the statistics; the beam is an aggregate
over the lattice's places inside the word's row: no Python, one shuffle by word.
A word has at most ``MAX_PIECE_LEN**2`` lattice entries for each of its letters.

Scoring (ours; the segmenter binary is not part of the mined project):
``log((c(prev, piece) + K * c(piece) / N) / (c(prev) + K))``, a bigram
estimate interpolated with the unigram distribution. Scores are kept in whole
billionths, so sums are exact and equal segmentations tie on every engine; ties
go to the segmentation whose pieces come first.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..constants import BEAM_SIZE, MAX_PIECE_LEN

START = "<s>"
SMOOTHING_K = 1.0
SCORE_UNIT = 1_000_000_000


def _pieces(words: DataFrame, max_len: int) -> DataFrame:
    """(word, n, s, l, piece): every substring, 1-based start s, length l."""
    starts = words.select("word", "n", F.explode(F.sequence(F.lit(1), F.length("word"))).alias("s"))
    lens = starts.select("word", "n", "s", F.explode(F.sequence(F.lit(1), F.lit(max_len))).alias("l"))
    return (lens.where(F.col("s") + F.col("l") - 1 <= F.length("word"))
            .withColumn("piece", F.substring("word", F.col("s"), F.col("l"))))


def unigram_stats(words: DataFrame, max_len: int = MAX_PIECE_LEN) -> DataFrame:
    """(piece, n) summed over all words' substrings."""
    return (_pieces(words, max_len).groupBy("piece")
            .agg(F.sum("n").cast("bigint").alias("n")))


def _pairs(words: DataFrame, max_len: int) -> DataFrame:
    """(word, n, ps, pl, s, l, prev, piece): adjacent substrings; ps = 0 marks the start symbol."""
    a = _pieces(words, max_len)
    nxt = a.select("word", "n", F.col("s").alias("ps"), F.col("l").alias("pl"), F.col("piece").alias("prev"),
                   F.explode(F.sequence(F.lit(1), F.lit(max_len))).alias("l"))
    nxt = (nxt.withColumn("s", F.col("ps") + F.col("pl"))
              .where(F.col("s") + F.col("l") - 1 <= F.length("word"))
              .withColumn("piece", F.substring("word", F.col("s"), F.col("l"))))
    first = (a.where(F.col("s") == 1)
             .select("word", "n", F.lit(0).alias("ps"), F.lit(0).alias("pl"), F.lit(START).alias("prev"),
                     "l", "s", "piece"))
    return nxt.unionByName(first)


def bigram_stats(words: DataFrame, max_len: int = MAX_PIECE_LEN) -> DataFrame:
    """(prev, piece, n) for adjacent substrings, ``<s>`` before a word-initial piece."""
    return (_pairs(words, max_len).groupBy("prev", "piece")
            .agg(F.sum("n").cast("bigint").alias("n")))


def scored_lattice(words: DataFrame, unigram: DataFrame, bigram: DataFrame, max_len: int = MAX_PIECE_LEN) -> DataFrame:
    """(word, s, pl, l, piece, score): every piece of every word after every piece that can stand before it."""
    total = unigram.agg(F.sum("n")).scalar()
    starts = bigram.where(F.col("prev") == START).agg(F.sum("n")).scalar()
    w = words.select("word").distinct().withColumn("n", F.lit(1))
    lattice = _pairs(w, max_len).drop("n")
    uni = unigram.select(F.col("piece").alias("_u"), F.col("n").alias("_cu"))
    uprev = unigram.select(F.col("piece").alias("_up"), F.col("n").alias("_cp"))
    bi = bigram.select(F.col("prev").alias("_bp"), F.col("piece").alias("_bq"), F.col("n").alias("_cb"))
    scored = (lattice
              .join(bi, (F.col("prev") == F.col("_bp")) & (F.col("piece") == F.col("_bq")), "left")
              .join(uni, F.col("piece") == F.col("_u"), "left"))
    # the start symbol is in no statistics of pieces: its rows need no join
    inner = scored.where(F.col("prev") != START).join(uprev, F.col("prev") == F.col("_up"), "left").drop("_up")
    scored = inner.unionByName(scored.where(F.col("prev") == START).withColumn("_cp", starts))
    num = F.coalesce("_cb", F.lit(0)) + F.lit(SMOOTHING_K) * F.coalesce("_cu", F.lit(0)) / F.greatest(F.coalesce(total, F.lit(1)), F.lit(1))
    score = F.log(F.greatest(num, F.lit(1e-12)) / (F.coalesce("_cp", F.lit(0)) + F.lit(SMOOTHING_K)))
    return scored.select("word", "s", "pl", "l", "piece", F.round(score * SCORE_UNIT).cast("bigint").alias("score"))


def beam_segment(words: DataFrame, unigram: DataFrame, bigram: DataFrame,
                 beam: int = BEAM_SIZE, max_len: int = MAX_PIECE_LEN) -> DataFrame:
    """Best segmentation of every distinct word: (word, pieces, score).

    The aggregate walks over a word's letters and holds, for the place it is at
    and the ``max_len - 1`` places after it, the segmentations that end there.
    At each place the ``beam`` best of them are carried on by every piece that
    begins there.
    """
    rows = scored_lattice(words, unigram, bigram, max_len)
    entry = F.struct("s", "pl", "l", "piece", "score")
    grouped = rows.groupBy("word").agg(F.collect_list(entry).alias("lattice"))
    state = "array<struct<cost: bigint, pieces: array<string>, l: int>>"
    nothing = f"CAST(array() AS {state})"
    begin = f"CAST(array(named_struct('cost', 0, 'pieces', array(), 'l', 0)) AS {state})"
    waiting = f"transform(sequence(1, {max_len}), k -> IF(k = 1, {begin}, {nothing}))"
    carried = (f"flatten(transform(slice(array_sort(element_at(held, 1)), 1, {beam}), st -> transform(filter(here, t -> t.pl = st.l), "
               "t -> named_struct('cost', st.cost - t.score, 'pieces', concat(st.pieces, array(t.piece)), 'l', t.l))))")
    step = (f"(held, here) -> element_at(transform(array({carried}), more -> transform(sequence(1, {max_len}), "
            f"k -> concat(coalesce(try_element_at(held, k + 1), {nothing}), filter(more, e -> e.l = k)))), 1)")
    places = "transform(sequence(1, length(word)), p -> filter(lattice, t -> t.s = p))"
    best = f"aggregate({places}, {waiting}, {step}, held -> element_at(array_sort(element_at(held, 1)), 1))"
    out = grouped.filter("length(word) > 0").select("word", F.expr(best).alias("_b"))
    return out.select("word", "_b.pieces", (-F.col("_b.cost") / F.lit(float(SCORE_UNIT))).alias("score"))
