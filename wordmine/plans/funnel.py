"""The mining funnel as one lazy plan (current pipeline, with older-variant switches).

Per-row stages (normalise, shape, arcs) are expressions on the row stream.
Word-level stages (lexicon, base forms, spelling, encyclopedia, dictionary)
run once per *distinct* word, a flag column each, and the first flag that is set
is the verdict ``(word, removed_by)``; the rows meet it in a single join on the
word. ``removed_by`` is the first failing stage, null for a
survivor, so kept + removed = input for every stage.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import arcs as A
from ..operators import fuzzy, lexicon
from ..operators.audit import keep_first
from ..operators.normalize import preprocess, shape_ok


@dataclass
class Lexicons:
    """Inputs of the word-level stages; each is ``(word, source)``."""
    word_list: DataFrame                      # C7
    base_list: DataFrame | None               # C8 (base forms looked up here)
    checkers: list[tuple[str, DataFrame]]     # C10/C11, in order
    titles: DataFrame                         # C13/C14 single-word titles (word) / C15 titles (title)
    dictionary: DataFrame | None              # C16 (word, source)
    variant: str = "current"                  # "older": C4 shape, C15 title-contains


def word_verdicts(words: DataFrame, lx: Lexicons) -> DataFrame:
    """First word-level stage removing each distinct word: ``(word, removed_by)``, null for none.

    One chain of joins over the distinct words, no stage built on another's
    survivors.
    """
    v = lexicon.in_lexicon(words, lx.word_list, "_f_list")
    listed = F.col("_f_list")
    if lx.base_list is not None:
        v = lexicon.base_in_lexicon(v, lx.base_list, "_f_base")
        listed = listed | F.col("_f_base")
    v = fuzzy.checker_cascade(v, lx.checkers)
    near_title = fuzzy.title_contains_flag if lx.variant == "older" else fuzzy.near_flag
    v = near_title(v, lx.titles, "_f_enc")
    reasons = [F.when(listed, "words"),
               F.when(F.col("spell_checker").isNotNull(), F.concat(F.lit("spell:"), "spell_checker")),
               F.when(F.col("_f_enc"), "encyclopedia")]
    if lx.dictionary is not None:
        v = lexicon.dictionary_reason(v, lx.dictionary)
        reasons.append(F.when(F.col("dict_source").isNotNull(), F.concat(F.lit("dictionary:"), "dict_source")))
    return v.select("word", F.coalesce(*reasons).alias("removed_by"))


def with_sentence_id(rows: DataFrame) -> DataFrame:
    """``sent_id``: a hash of the sentence, the key under which a parser lands its token arcs."""
    return rows if "sent_id" in rows.columns else rows.withColumn("sent_id", F.xxhash64("sentence"))


def audit_rows(total: DataFrame, lx: Lexicons, phrases: list[str], arcs=None) -> DataFrame:
    """Every extracted row with ``org``, normalised ``word`` and ``removed_by``.

    ``arcs``: None (stage skipped), ``"pattern"`` (regex approximation) or a
    token-arc DataFrame keyed by ``sent_id`` (see ``with_sentence_id``).
    """
    pre = preprocess(total)
    if lx.variant == "older":
        pre = pre.withColumn("word", F.when(F.col("org").rlike(r"^[a-zA-Z]+\z"), F.lower("org")))
    ok_shape = shape_ok("word")
    words = pre.where(F.col("word").isNotNull() & ok_shape).select("word").distinct()
    verdicts = word_verdicts(words, lx).withColumnRenamed("removed_by", "_v").withColumnRenamed("word", "_vw")
    rows = pre.join(verdicts, F.col("word") == F.col("_vw"), "left").drop("_vw")
    if arcs is None:
        arc_fail = F.lit(False)
    elif isinstance(arcs, str) and arcs == "pattern":
        arc_fail = ~A.arc_pattern(phrases)
    else:
        asked = with_sentence_id(rows.select("sentence", "query"))
        keep = A.arc_keep(asked.select("sent_id", "query").distinct(), arcs).select(
            F.col("sent_id").alias("_ak"), F.col("query").alias("_aq"), F.lit(True).alias("_arc_ok"))
        rows = rows.join(keep, (F.xxhash64("sentence") == F.col("_ak")) & (F.col("query") == F.col("_aq")), "left").drop("_ak", "_aq")
        arc_fail = F.col("_arc_ok").isNull()
    removed_by = (F.when(F.col("word").isNull(), "normalise")
                  .when(~ok_shape, "words")
                  .when(F.col("_v") == "words", "words")
                  .when(arc_fail, "arcs")
                  .otherwise(F.col("_v")))
    out = rows.withColumn("removed_by", removed_by).drop("_v")
    return out.drop("_arc_ok") if "_arc_ok" in out.columns else out


def final_words(audited: DataFrame) -> DataFrame:
    """The survivors (the "non-words" table)."""
    return audited.where(F.col("removed_by").isNull()).drop("removed_by")


def dedup_words(final: DataFrame) -> DataFrame:
    """One row per word, the first by (query_pos, idx); columns word, sentence + order."""
    return keep_first(final, "word", ["query_pos", "idx"], ["word", "sentence"])
