"""Grammatical-arc stage (C9): keep rows whose sentence says "X is ... <target>".

With a token-arc table ``(sent_id, i, text, dep, head_i)`` (the output of any
dependency parser, landed as a table) the test is exact: a token equal to
the phrase's last word with dependency ``attr``, whose head is the word "is"
at a position > 0, and which has no child to its right. It is three joins on
``sent_id`` and a semi join, so a row is kept once even when two tokens match.
They are sort-merge joins: a row of arcs is a token, which the estimated size of
the rows that the arcs were made from says nothing about, so Spark would send
whole arc tables through the driver.

Without arcs, ``arc_pattern`` approximates the same shape with a regular
expression on the sentence (documented approximation, not a parser).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def target_word(query_col: str = "query") -> Column:
    return F.element_at(F.split(F.col(query_col), " "), -1)


def arc_keep(rows: DataFrame, arcs: DataFrame, sent_col: str = "sent_id") -> DataFrame:
    """Rows (with ``sent_col`` and ``query``) whose sentence has the arc shape."""
    t = arcs.alias("t")
    h = arcs.alias("h")
    c = arcs.alias("c")
    tg = rows.select(F.col(sent_col).alias("_sid"), target_word().alias("_tg")).distinct()
    cand = (t.join(tg.hint("merge"), F.col("t.sent_id") == F.col("_sid"))
            .where((F.lower(F.col("t.text")) == F.col("_tg")) & (F.col("t.dep") == "attr"))
            .join(h.hint("merge"), (F.col("h.sent_id") == F.col("t.sent_id")) & (F.col("h.i") == F.col("t.head_i")))
            .where((F.lower(F.col("h.text")) == "is") & (F.col("h.i") > 0))
            .select(F.col("t.sent_id").alias("_sid"), F.col("t.i").alias("_ti"), F.col("_tg")))
    no_right = cand.join(c.hint("merge"), (F.col("c.sent_id") == F.col("_sid")) & (F.col("c.head_i") == F.col("_ti"))
                         & (F.col("c.i") > F.col("_ti")), "left_anti")
    return rows.join(no_right.select("_sid", "_tg").distinct().hint("merge"),
                     (F.col(sent_col) == F.col("_sid")) & (target_word() == F.col("_tg")), "left_semi")


def rule_arcs(sentences: DataFrame) -> DataFrame:
    """A token-arc table ``(sent_id, i, text, dep, head_i)`` from ``(sent_id, sentence)`` by a rule.

    A stand-in for a parser on sentences that have none: a token after an "is"
    hangs on the last such "is" before it, as ``attr``; other tokens hang on the
    token before them. Punctuation at a token's ends is not part of it.
    """
    words = F.transform(F.filter(F.split("sentence", r"\s+"), lambda t: t != ""),
                        lambda t: F.regexp_replace(t, r"^[^\p{L}\p{N}]+|[^\p{L}\p{N}]+$", ""))
    is_at = F.array_compact(F.transform("w", lambda t, j: F.when(F.lower(t) == "is", j)))
    toks = (sentences.select("sent_id", words.alias("w")).distinct().withColumn("is_at", is_at)
            .select("sent_id", "is_at", F.posexplode("w").alias("i", "text")))
    head = F.coalesce(F.array_max(F.filter("is_at", lambda j: j < F.col("i"))), F.lit(-1))
    toks = toks.withColumn("verb", head)
    return toks.select("sent_id", "i", "text", F.when(F.col("verb") >= 0, "attr").otherwise("dep").alias("dep"),
                       F.when(F.col("verb") >= 0, F.col("verb")).otherwise(F.col("i") - 1).alias("head_i"))


def arc_regex(target: str) -> str:
    """"X is [up to four words] target" closed by punctuation or the end."""
    return r"(?i)\S\s+is(\s+[a-z-]+){0,4}\s+" + target + r"""(\s*[.!?;:,)"']|\s*$)"""


def arc_pattern(phrases: list[str], sentence: str = "sentence", query: str = "query") -> Column:
    """Boolean column: the sentence matches the arc pattern of its row's phrase."""
    expr = None
    for ph in phrases:
        tgt = ph.split()[-1].lower()
        cond = F.col(sentence).rlike(arc_regex(tgt))
        expr = (F.when(F.col(query) == ph, cond) if expr is None
                else expr.when(F.col(query) == ph, cond))
    return expr.otherwise(F.lit(False)) if expr is not None else F.lit(False)
