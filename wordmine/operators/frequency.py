"""Frequencies of the surviving words.

Collected frequency is a grouped count with the word's own first row as
provenance. Corpus frequency tokenises the corpus once: whitespace tokens,
each edge-stripped like the extracted words (so ``E-mail`` stays whole), case
kept; tokens are counted with map-side partial aggregation, and only those equal
to an asked surface form are kept, by a semi join that Spark broadcasts if the
measured size of the forms allows it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import edge_strip, surface_forms
from ..session import materialise


def collected_frequency(final: DataFrame) -> DataFrame:
    """Rows per word; idx/span_id/doc_ix/org of the word's first row (by query_pos, idx)."""
    first = F.min(F.struct("query_pos", "idx", "span_id", "doc_ix", "org")).alias("_f")
    return (final.groupBy("word").agg(F.count(F.lit(1)).cast("bigint").alias("count"), first)
            .select("word", "count", F.col("_f.query_pos").alias("query_pos"), F.col("_f.idx").alias("idx"),
                    F.col("_f.span_id").alias("span_id"), F.col("_f.doc_ix").alias("doc_ix"),
                    F.col("_f.org").alias("org")))


# From a token's first to its last ASCII letter: the same string as stripping
# non-letters at both edges, in one pass whatever the token holds.
RX_LETTER_TO_LETTER = r"(?s)[a-zA-Z](?:.*[a-zA-Z])?"


def _is_letter(c: Column) -> Column:
    return c.between("a", "z") | c.between("A", "Z")


def corpus_tokens(corpus: DataFrame) -> DataFrame:
    """Edge-stripped whitespace tokens of the corpus, case kept: ``(form)``.

    Texts are cut at white space; a token that begins and ends with a letter is
    its own form, and a regular expression looks at the others only.
    """
    tok = F.col("_tok")
    begins, ends = _is_letter(F.substring(tok, 1, 1)), _is_letter(F.substring(tok, -1, 1))
    # *_outer: no filter is inferred from the generator, which would split each text twice
    toks = corpus.select(F.explode_outer(F.split(F.col("text"), r"\s+")).alias("_tok"))
    return (toks.where(begins | tok.rlike("[a-zA-Z]"))
            .select(F.when(begins & ends, tok).otherwise(F.regexp_extract(tok, RX_LETTER_TO_LETTER, 0)).alias("form")))


def form_tokens(form: str = "form"):
    """The edge-stripped whitespace tokens of a form."""
    return F.filter(F.transform(F.split(F.col(form), r"\s+"), edge_strip), lambda t: t != "")


def long_form_counts(corpus: DataFrame, forms: DataFrame, longest: int) -> DataFrame:
    """D5 for forms of up to ``longest`` tokens: as many whitespace tokens in a row that equal the form's, edge-stripped.

    A place of the corpus becomes a row only if some form begins with its token
    (an equi join on the first token, which brings the lengths that are asked
    for); it then makes one n-gram for each of those lengths, and n-grams are
    counted map-side before they meet the forms. A token without letters ends a run.
    """
    asked = forms.select("form").distinct().withColumn("_t", form_tokens()).filter("size(_t) > 0")
    asked = asked.select("form", F.array_join("_t", " ").alias("_gram"), F.element_at("_t", 1).alias("_first"), F.size("_t").alias("_n"))
    firsts = asked.groupBy("_first").agg(F.collect_set("_n").alias("_lengths"))  # at most ``longest`` numbers
    toks = corpus.select(F.transform(F.split(F.col("text"), r"\s+"), edge_strip).alias("_t"))
    places = F.expr(f"filter(transform(sequence(1, size(_t)), i -> slice(_t, i, {longest})), w -> w[0] != '')")
    rows = toks.select(F.explode(places).alias("_w")).select(F.col("_w")[0].alias("_first"), "_w")
    grams = rows.join(firsts, "_first").select(
        F.explode(F.expr("transform(filter(_lengths, k -> k <= size(_w) AND NOT exists(slice(_w, 1, k), t -> t = '')), "
                         "k -> array_join(slice(_w, 1, k), ' '))")).alias("_gram"))
    counts = grams.groupBy("_gram").agg(F.count(F.lit(1)).cast("bigint").alias("cnt"))
    return asked.join(counts, "_gram").select("form", "cnt")


def form_counts(corpus: DataFrame, forms: DataFrame) -> DataFrame:
    """Occurrences in the corpus of each distinct form in ``forms(form)``; a form may have several tokens."""
    asked = forms.select("form").distinct()
    longest = forms.agg(F.max(F.size(form_tokens()))).first()[0] or 0
    if longest > 1:
        return long_form_counts(corpus, forms, longest)
    hits = corpus_tokens(corpus).join(asked, "form", "left_semi")
    return hits.groupBy("form").agg(F.count(F.lit(1)).cast("bigint").alias("cnt"))


def corpus_frequency(collected: DataFrame, corpus: DataFrame) -> DataFrame:
    """Per word, the summed corpus count of its distinct surface forms (absent = 0)."""
    # written once: their measured size decides the corpus join, and the funnel
    # upstream runs once
    forms = materialise(collected.select("word", "query_pos", "idx", "span_id", "doc_ix",
                                         F.explode(surface_forms("word", "org")).alias("form")))
    counts = form_counts(corpus, forms)
    joined = forms.join(counts, "form", "left")
    return (joined.groupBy("word", "query_pos", "idx", "span_id", "doc_ix")
            .agg(F.sum(F.coalesce("cnt", F.lit(0))).cast("bigint").alias("count")))


def sort_by_count(freq: DataFrame) -> DataFrame:
    """Count descending, word ascending as the tie-break."""
    return freq.orderBy(F.desc("count"), F.asc("word"))


def top_words(freq: DataFrame, k: int) -> DataFrame:
    """D8 top-k (planned as TakeOrderedAndProject: no global sort)."""
    return sort_by_count(freq).limit(k)


def cardinality_report(final: DataFrame, collected: DataFrame, counted: DataFrame) -> DataFrame:
    """Rows of the final table, distinct words, words with a corpus count (and
    with a non-zero one), in one aggregation over the three tables tagged and unioned."""
    tagged = (final.select(F.lit(0).alias("_t"), F.lit(0).cast("bigint").alias("_c"))
              .unionByName(collected.select(F.lit(1).alias("_t"), F.lit(0).cast("bigint").alias("_c")))
              .unionByName(counted.select(F.lit(2).alias("_t"), F.col("count").cast("bigint").alias("_c"))))
    return tagged.agg(
        F.count(F.when(F.col("_t") == 0, 1)).cast("bigint").alias("n_rows"),
        F.count(F.when(F.col("_t") == 1, 1)).cast("bigint").alias("n_words"),
        F.count(F.when(F.col("_t") == 2, 1)).cast("bigint").alias("n_counted"),
        F.count(F.when((F.col("_t") == 2) & (F.col("_c") > 0), 1)).cast("bigint").alias("n_nonzero"))
