"""Spans -> words and sentences.

Input rows are landed documents ``(query_pos, query, shard, rank, doc_ix,
metadata, spans)`` where ``spans`` is ``array<struct<text,label>>`` and label
``'0'`` marks a phrase hit. Everything per row is an array expression inside
the row (no join, no shuffle); only the document dedup (B3) and the dense ids
(B4, B13) shuffle.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..constants import RX_ALNUM, RX_EDGE, RX_SENT
from ..functions.text import sql_str
from .ids import dense_index, dense_index_bucketed


def span_text(spans: str = "spans") -> str:
    """B1: span texts joined by one blank."""
    return f"array_join(transform({spans}, s -> s.text), ' ')"


def with_texts(landed: DataFrame) -> DataFrame:
    return landed.withColumn("texts", F.expr(span_text()))


def dedup_documents(landed: DataFrame) -> DataFrame:
    """One row per (query, doc_ix, metadata, texts), the first in (shard, rank) order.

    A grouped ``min`` of a struct led by the ordering key (partial aggregation
    before the shuffle) instead of a window sort of whole rows.
    """
    df = with_texts(landed)
    # shard is a function of doc_ix; keeping it in the key lets a landed table
    # range-partitioned on (query, shard, doc_ix) be grouped without a shuffle
    keys = ["query_pos", "query", "shard", "doc_ix", "metadata", "texts"]
    first = F.min(F.struct("rank", "pos", "spans")).alias("_f")
    return (df.groupBy(*keys).agg(first)
            .select(*keys, "_f.rank", "_f.pos", "_f.spans"))


def drop_repeated_windows(landed: DataFrame) -> DataFrame:
    """B3 for rows from ``landed_documents``: drop the windows flagged ``repeat``
    (same text as an earlier window of the same phrase and document). A filter,
    so the landed rows stay where the bucket shuffle put them."""
    return (with_texts(landed).where(~F.col("repeat"))
            .select("query_pos", "query", "shard", "doc_ix", "metadata", "texts", "rank", "pos", "spans",
                    "bucket"))


def assign_span_ids(docs: DataFrame, partitioned: bool = False) -> DataFrame:
    """Dense 0-based span_id per query, in (shard, rank) order.

    ``partitioned``: ``docs`` carries the landed rows' order-preserving
    ``bucket`` (rank follows doc_ix inside a shard), so numbering stays inside
    buckets.
    """
    if partitioned:
        return dense_index_bucketed(docs, ["query"], ["shard", "rank"], "span_id", store=False)
    return dense_index(docs, ["query"], ["shard", "rank"], "span_id")


# --- per-row expressions --------------------------------------------------

def _bind(value: str, var: str, body: str) -> str:
    """``body`` with ``var`` bound to ``value``, evaluated once per row.

    Chained ``withColumn``s that refer to an earlier column inside a lambda may
    be collapsed by the optimiser, which then re-evaluates the earlier
    expression at every lambda call; binding it as a lambda variable cannot be
    inlined.
    """
    return f"element_at(transform(array({value}), {var} -> {body}), 1)"


def _span_offsets() -> str:
    """Character offset of every span in the joined text (+1 per separator)."""
    return _bind("transform(spans, x -> length(x.text))", "lens",
                 "transform(lens, (l0, i) -> aggregate(slice(lens, 1, i), 0, (a, l) -> a + l + 1))")


# A text from the token with its last letter or digit on; group 1 is what stands before that token.
RX_LAST_WORD = r"(?s)^(.*)(?<!\S)\S*" + RX_ALNUM + RX_ALNUM.replace("[", "[^") + r"*\z"


def _hit_words() -> str:
    """For every hit span i >= 1, the preceding word and its absolute offset.

    The word is the last token of span i-1 with a letter or digit, and what
    follows it there, one blank apart. One match from the span's end finds it,
    whatever the span's length.
    """
    rx = sql_str(RX_LAST_WORD)
    hit_ix = "filter(sequence(1, size(spans) - 1), i -> element_at(spans, i + 1).label = '0')"
    step1 = (f"transform(IF(size(spans) > 1, {hit_ix}, array()), i -> named_struct('i', i, 't', element_at(spans, i).text, "
             f"'before', IF(element_at(spans, i).text RLIKE {sql_str(RX_ALNUM)}, "
             f"length(regexp_extract(element_at(spans, i).text, {rx}, 1)), -1)))")
    step2 = (f"transform(filter({step1}, x -> x.before >= 0), x -> named_struct("
             f"'span_ix', x.i, "
             f"'raw', regexp_replace(regexp_replace(substring(x.t, x.before + 1), '\\\\s+\\\\z', ''), '\\\\s+', ' '), "
             f"'offset', element_at(ofs, x.i) + x.before))")
    return _bind(_span_offsets(), "ofs", step2)


def _sentences() -> str:
    """Sentence pieces of ``texts`` with [start, start + len) offsets; trailing
    blanks are outside."""
    pieces = f"regexp_extract_all(texts, {sql_str(RX_SENT)}, 0)"
    body = ("transform(pcs, (s, k) -> named_struct('k', k, 's', s, "
            "'start', aggregate(slice(lens, 1, k), 0, (a, l) -> a + l), "
            "'len', length(regexp_replace(s, '\\\\s+$', ''))))")
    return _bind(pieces, "pcs", _bind("transform(pcs, x -> length(x))", "lens", body))


def extract_hits(docs: DataFrame) -> DataFrame:
    """One row per hit with a word and a sentence.

    Columns: query_pos, query, span_id, doc_ix, hit_no, word, word_offset, sentence.
    """
    strip = "regexp_replace({0}, '^\\\\s+|\\\\s+$', '')"
    df = docs.withColumn("_hw", F.expr(_hit_words())).withColumn("_sents", F.expr(_sentences()))
    extra = ["bucket"] if "bucket" in docs.columns else []
    # *_outer: no filter is inferred from the generator, which would copy the
    # whole hit-word expression into a pushed-down Filter; empty rows go below
    rows = (df.select("query_pos", "query", "span_id", "doc_ix", *extra, "_sents",
                      F.posexplode_outer("_hw").alias("hit_no", "_h"))
            .where(F.col("_h").isNotNull()))
    word = F.regexp_replace(F.col("_h.raw"), RX_EDGE, "")
    rows = (rows.select("query_pos", "query", "span_id", "doc_ix", *extra, "_sents",
                        F.col("hit_no").cast("bigint").alias("hit_no"),
                        word.alias("word"), F.col("_h.offset").cast("bigint").alias("word_offset"))
                .where(F.col("word") != ""))
    pick = "try_element_at(filter(_sents, x -> x.start <= word_offset AND word_offset < x.start + x.len), 1)"
    choose = (f"CASE WHEN sk IS NULL THEN NULL "
              f"WHEN contains(lower(sk.s), query) AND contains(lower(sk.s), lower(word)) "
              f"THEN {strip.format('sk.s')} "
              f"WHEN sk.k + 1 < size(_sents) THEN concat({strip.format('sk.s')}, ' ', "
              f"{strip.format('element_at(_sents, sk.k + 2).s')}) "
              f"ELSE {strip.format('sk.s')} END")
    sent = F.expr(_bind(pick, "sk", choose))
    return (rows.select("query_pos", "query", "span_id", "doc_ix", "hit_no", "word", "word_offset",
                        sent.alias("sentence"), *extra)
            .where(F.col("sentence").isNotNull()))


def hit_words(docs: DataFrame) -> DataFrame:
    """Every hit's preceding word, raw and edge-stripped, with its offset (before B9's drop)."""
    df = docs.withColumn("_hw", F.expr(_hit_words()))
    rows = (df.select("query_pos", "query", "span_id", "doc_ix", F.posexplode_outer("_hw").alias("hit_no", "_h"))
            .where(F.col("_h").isNotNull()))
    return rows.select("query_pos", "query", "span_id", "doc_ix", F.col("hit_no").cast("bigint").alias("hit_no"),
                       F.col("_h.raw").alias("raw"), F.regexp_replace(F.col("_h.raw"), RX_EDGE, "").alias("word"),
                       F.col("_h.offset").cast("bigint").alias("word_offset"))


def sentence_table(docs: DataFrame) -> DataFrame:
    """One row per sentence piece with its [start, start + len) offsets."""
    df = docs.withColumn("_sents", F.expr(_sentences()))
    return (df.select("query_pos", "query", "span_id", F.explode_outer("_sents").alias("_s"))
            .where(F.col("_s").isNotNull())
            .select("query_pos", "query", "span_id", F.col("_s.k").cast("bigint").alias("k"),
                    F.col("_s.start").cast("bigint").alias("start"), F.col("_s.len").cast("bigint").alias("len"),
                    F.col("_s.s").alias("piece")))


def extraction_table(docs: DataFrame, partitioned: bool = False) -> DataFrame:
    """The "total" table; idx = dense 0-based row index per query.

    Columns: query_pos, query, idx, span_id, doc_ix, hit_no, word, word_offset, sentence.
    """
    hits = extract_hits(docs).na.drop("any")
    if partitioned:
        return dense_index_bucketed(hits, ["query"], ["span_id", "hit_no"], "idx").drop("bucket")
    return dense_index(hits, ["query"], ["span_id", "hit_no"], "idx")


def spans_to_words(landed: DataFrame, partitioned: bool = False) -> DataFrame:
    """B1-B15 end to end: landed documents -> extraction table.

    With ``partitioned`` (landed rows from ``landed_documents``, carrying their
    order-preserving ``bucket``) the whole chain runs on the landed table's
    single shuffle by bucket.
    """
    return extraction_table(unique_windows(landed, partitioned), partitioned=partitioned)


def unique_windows(landed: DataFrame, partitioned: bool = False) -> DataFrame:
    """B3 + B4. ``partitioned``: ``landed`` comes from ``landed_documents``
    (bucketed, repeat-flagged): dedup is a filter and ids number inside buckets."""
    if partitioned:
        return assign_span_ids(drop_repeated_windows(landed), partitioned=True)
    return assign_span_ids(dedup_documents(landed))


def expression_counts(landed: DataFrame, total: DataFrame) -> DataFrame:
    """Per query, documents landed, unique documents, and extracted rows."""
    a = landed.groupBy("query").agg(F.count(F.lit(1)).cast("bigint").alias("n_landed"))
    b = dedup_documents(landed).groupBy("query").agg(F.count(F.lit(1)).cast("bigint").alias("n_unique"))
    c = total.groupBy("query").agg(F.count(F.lit(1)).cast("bigint").alias("n_rows"))
    return (a.join(b, "query", "full").join(c, "query", "full")
            .select("query", *[F.coalesce(x, F.lit(0)).cast("bigint").alias(x)
                               for x in ["n_landed", "n_unique", "n_rows"]]))


# --- older variant (first span / first sentence) -------------------------

def first_span_rows(landed: DataFrame) -> DataFrame:
    """word = last token of the first span, lower-cased; sentence = first
    sentence containing the query (case-sensitive, null when none); full-row distinct.
    """
    rx = sql_str(RX_SENT)
    strip = "regexp_replace({0}, '^\\\\s+|\\\\s+$', '')"
    df = with_texts(landed)
    word = F.expr("lower(try_element_at(filter(split(element_at(spans, 1).text, '\\\\s+'), t -> t != ''), -1))")
    sent = F.expr(f"{strip.format(f'try_element_at(filter(regexp_extract_all(texts, {rx}, 0), s -> contains(s, query)), 1)')}")
    out = (df.where(F.col("texts") != "")
             .select("query_pos", "query", "doc_ix", word.alias("word"), sent.alias("sentence")))
    return out.na.drop("any").distinct()
