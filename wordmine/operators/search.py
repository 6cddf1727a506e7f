"""Acquisition re-aimed as Spark jobs over a corpus table.

A corpus is any DataFrame ``(doc_ix bigint, text string, shard string,
metadata string)``. A phrase matches a run of whitespace tokens whose
lower-cased forms equal the phrase tokens; the last token may carry trailing
punctuation (``word.`` ends ``is not a word``).

One pass over a document's tokens finds the places where a phrase can begin;
there the phrase keys of every length are looked up in a set of literals, all in
the document row: no join and no shuffle, and the same code for every length of
the phrase list.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..constants import MAX_DISP_LEN
from ..functions.text import sql_str
from ..session import materialise
from .ids import bucket_of, dense_index, dense_index_bucketed, key_boundaries

SPAN_TYPE = "array<struct<text:string,label:string>>"


# Hits of a document that are cut into windows together: bounds the size of a row.
HITS_PER_SEGMENT = 256


def phrase_tokens(phrase: str) -> list[str]:
    return phrase.lower().split()


def _bare(token: str) -> str:
    """SQL: a token without what is neither letter nor digit at its end (the token itself if nothing is left)."""
    return f"coalesce(nullif(regexp_replace({token}, '[^\\\\p{{L}}\\\\p{{N}}]+$', ''), ''), {token})"


def _bare_text(token: str) -> str:
    """The same rule for a phrase's last token."""
    end = len(token)
    while end and not (token[end - 1].isalpha() or token[end - 1].isnumeric()):
        end -= 1
    return token[:end] or token


def _one_of(expr: str, values: list[str]) -> str:
    return f"{expr} IN ({', '.join(sql_str(v) for v in values)})"


def phrase_hits(corpus: DataFrame, phrases: list[str]) -> DataFrame:
    """A1: one row per (phrase, document) with the phrase's hit positions.

    A phrase that is listed twice gives rows for both places in the list.
    Columns: query_pos, query, n_tok, doc_ix, shard, metadata, tokens, hits.
    """
    keys: dict[str, list[int]] = {}
    for i, p in enumerate(phrases):
        tokens = phrase_tokens(p)
        keys.setdefault(" ".join([*tokens[:-1], _bare_text(tokens[-1])]), []).append(i)
    by_length: dict[int, list[str]] = {}
    for k in keys:
        by_length.setdefault(len(k.split()), []).append(k)
    first = sorted({k.split()[0] for n, ks in by_length.items() if n > 1 for k in ks})
    begins = [_one_of("element_at(_lk, p)", first)] if first else []
    if 1 in by_length:
        begins.append(_one_of(_bare("element_at(_lk, p)"), by_length[1]))
    docs = corpus.select("doc_ix", "shard", "metadata",
                         F.filter(F.split(F.col("text"), r"\s+"), lambda t: t != "").alias("tokens"),
                         # the lower-cased text has the same token boundaries
                         F.filter(F.split(F.lower("text"), r"\s+"), lambda t: t != "").alias("_lk"))
    docs = docs.withColumn("_cand", F.expr(
        f"IF(size(_lk) > 0, filter(sequence(1, size(_lk)), p -> {' OR '.join(begins)}), array())"))
    found = [f"filter(transform(filter(_cand, p -> p + {n - 1} <= size(_lk)), p -> named_struct('p', p, 'k', "
             f"concat_ws(' ', slice(_lk, p, {n - 1}), {_bare(f'element_at(_lk, p + {n - 1})')}))), "
             f"x -> {_one_of('x.k', ks)})" for n, ks in sorted(by_length.items())]
    docs = docs.withColumn("_found", F.expr(f"concat({', '.join(found)})"))
    listed = F.create_map(*[x for k, at in keys.items() for x in (F.lit(k), F.array(*[
        F.struct(F.lit(i).cast("bigint").alias("query_pos"), F.lit(phrases[i]).alias("query"), F.lit(len(k.split())).alias("n_tok"))
        for i in at]))])
    by_key = F.expr("transform(array_distinct(transform(_found, x -> x.k)), q -> named_struct('k', q, "
                    "'hits', array_sort(transform(filter(_found, x -> x.k = q), x -> x.p))))")
    rows = (docs.select("doc_ix", "shard", "metadata", "tokens", F.explode_outer(by_key).alias("_m")).where("_m IS NOT NULL")
            .select("doc_ix", "shard", "metadata", "tokens", F.col("_m.hits").alias("_h"),
                    F.explode(F.element_at(listed, F.col("_m.k"))).alias("_q")))
    # a hit that begins inside the one before it does not count
    apart = "filter(_h, (h, i) -> i = 0 OR h >= element_at(_h, i) + _q.n_tok)"
    return rows.select("_q.query_pos", "_q.query", F.col("_q.n_tok").cast("int").alias("n_tok"), "doc_ix", "shard", "metadata",
                       "tokens", F.expr(apart).alias("hits"))


def occurrence_windows(hits: DataFrame, max_disp_len: int = MAX_DISP_LEN) -> DataFrame:
    """A4: one row per occurrence with its display window cut into spans.

    The window holds up to ``max_disp_len // 2`` tokens on each side of the
    hit; spans alternate context / hit (label ``'0'``) and mark every hit of
    the phrase that lies fully inside the window. A document's hits are cut
    into segments, each with the tokens and hits that its windows can reach, so
    neither a row nor the work grows with the square of a document's hits: the
    hits in a window are looked for among the ``max_disp_len // 2`` before and
    after it.
    """
    half, size = max_disp_len // 2, HITS_PER_SEGMENT
    own = f"slice(hits, g * {size} + 1, {size})"
    reach = (f"named_struct('own', {own}, 'at', g * {size} + 1 - greatest(1, g * {size} + 1 - {half}), "
             f"'near', slice(hits, greatest(1, g * {size} + 1 - {half}), {size + 2 * half}), "
             f"'lo', greatest(1, element_at({own}, 1) - {half}), "
             f"'hi', least(size(tokens), element_at({own}, -1) + n_tok - 1 + {half}))")
    parts = (f"transform(transform(sequence(0, CAST((size(hits) - 1) DIV {size} AS INT)), g -> {reach}), s -> "
             f"named_struct('own', s.own, 'at', s.at, 'near', s.near, 'lo', s.lo, 'n', size(tokens), "
             f"'toks', slice(tokens, s.lo, s.hi - s.lo + 1)))")
    extra = ["bucket"] if "bucket" in hits.columns else []
    keep = ["query_pos", "query", "n_tok", "doc_ix", "shard", "metadata", *extra]
    seg = hits.select(*keep, F.explode(F.expr(parts)).alias("s")).select(*keep, "s.*")
    span = "named_struct('text', array_join(slice(toks, {s} - lo + 1, {ln}), ' '), 'label', {lab})"
    none = "CAST(NULL AS STRING)"
    first_ctx = span.format(s="o.lo", ln="element_at(o.wh, 1) - o.lo", lab=none)
    hit_sp = span.format(s="h", ln="n_tok", lab="'0'")
    next_ctx = span.format(s="h + n_tok", ln="coalesce(try_element_at(o.wh, j + 2), o.hi + 1) - h - n_tok", lab=none)
    bounds = (f"transform(own, (p, j) -> named_struct('p', p, 'j', j, 'lo', greatest(1, p - {half}), "
              f"'hi', least(n, p + n_tok - 1 + {half})))")
    windows = (f"transform({bounds}, o -> named_struct('p', o.p, 'lo', o.lo, 'hi', o.hi, 'wh', "
               f"filter(slice(near, greatest(1, o.j + at + 1 - {half}), {2 * half + 1}), "
               f"h -> h >= o.lo AND h + n_tok - 1 <= o.hi)))")
    occ = (f"transform({windows}, o -> named_struct('pos', o.p, 'spans', "
           f"concat(array({first_ctx}), flatten(transform(o.wh, (h, j) -> array({hit_sp}, {next_ctx}))))))")
    return (seg.select("query_pos", "query", "doc_ix", "shard", "metadata", *extra, F.explode(F.expr(occ)).alias("_o"))
            .select("query_pos", "query", "doc_ix", "shard", "metadata", *extra,
                    F.col("_o.pos").cast("bigint").alias("pos"),
                    F.col("_o.spans").cast(SPAN_TYPE).alias("spans")))


def flag_repeats(occ: DataFrame) -> DataFrame:
    """``repeat`` marks a window whose text an earlier one of its phrase and document has.

    A window function inside the bucket, where all windows of a document are.
    """
    text = F.expr("array_join(transform(spans, s -> s.text), ' ')")
    same = Window.partitionBy("bucket", "query_pos", "doc_ix", "_hash", "_text").orderBy("pos")
    marked = occ.withColumn("_text", text).withColumn("_hash", F.xxhash64("_text"))
    return marked.withColumn("repeat", F.row_number().over(same) > 1).drop("_text", "_hash")


def landed_documents(corpus: DataFrame, phrases: list[str], max_disp_len: int = MAX_DISP_LEN,
                     buckets: int | None = None) -> DataFrame:
    """A1-A4 + A3: every occurrence as a landed document with its (shard, rank).

    Columns: query_pos, query, doc_ix, shard, metadata, bucket, pos, spans,
    repeat, rank. ``bucket`` is an order-preserving slice of (shard, doc_ix)
    fixed from a sample of the corpus keys, three for each shuffle partition.
    The landed rows are shuffled once, by bucket, and written: the text is read
    and matched once, by the job that this call starts, and everything
    downstream - ranks, document dedup, span ids, row ids - reads that table and
    numbers inside buckets. A null shard sorts first.
    """
    n = int(corpus.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    shard = F.coalesce("shard", F.lit("")).alias("_shard")
    cuts = key_boundaries(corpus.select(shard, "doc_ix"), ["_shard", "doc_ix"], buckets or 3 * n)
    hits = phrase_hits(corpus, phrases).withColumn("_shard", F.coalesce("shard", F.lit("")))
    hits = hits.withColumn("bucket", bucket_of(["_shard", "doc_ix"], cuts)).drop("_shard")
    occ = flag_repeats(occurrence_windows(hits, max_disp_len).repartition(n, "bucket"))
    return rank_occurrences(occ)


def rank_occurrences(occ: DataFrame) -> DataFrame:
    """A3: rank = 0-based position of the occurrence in its (phrase, shard), by (doc_ix, pos)."""
    group = ["query_pos", "query", "shard"]
    if "bucket" in occ.columns:
        return dense_index_bucketed(occ, group, ["doc_ix", "pos"], "rank")
    return dense_index(occ, group, ["doc_ix", "pos"], "rank")


def shard_counts(corpus: DataFrame, phrases: list[str]) -> DataFrame:
    """A2: occurrences per (phrase, shard) plus per-phrase and grand totals (rollup).

    Counted from the hit arrays, so no occurrence row is materialised.
    """
    h = phrase_hits(corpus, phrases).select("query", "shard", F.size("hits").alias("n"))
    return (h.rollup("query", "shard")
            .agg(F.sum("n").cast("bigint").alias("occurrences"),
                 F.count(F.lit(1)).cast("bigint").alias("documents"), F.grouping_id().alias("_g"))
            .select("query", "shard", "occurrences", "documents",
                    F.when(F.col("_g") == 3, "all").when(F.col("_g") == 1, "phrase").otherwise("shard").alias("level")))


def missing_ranks(requested: DataFrame, retrieved: DataFrame) -> DataFrame:
    """A10: (phrase, shard, rank) requested but not retrieved."""
    keys = ["query", "shard", "rank"]
    return requested.select(*keys).join(retrieved.select(*keys), keys, "left_anti")


def landed_counts(landed: DataFrame, phrases: list[str]) -> DataFrame:
    """Landed windows and distinct documents per phrase; phrases with none show 0."""
    spark = landed.sparkSession
    plist = spark.createDataFrame(list(enumerate(phrases)), "query_pos bigint, query string")
    counts = landed.groupBy("query").agg(F.count(F.lit(1)).alias("n_landed"),
                                         F.count_distinct("doc_ix").alias("n_docs"))
    return (plist.join(counts, "query", "left")
            .select("query_pos", "query",
                    F.coalesce("n_landed", F.lit(0)).cast("bigint").alias("n_landed"),
                    F.coalesce("n_docs", F.lit(0)).cast("bigint").alias("n_docs")))
