"""Registered queries: name -> (spark builder, oracle SQL or None).

Every builder reads the driver's tables under ``sf_dir`` and returns a lazy
DataFrame whose work grows with them.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..constants import BEAM_SIZE, RX_EDGE, STANDIN_PHRASES
from ..operators import extract, search
from ..session import materialise
from ..sources import tables
from . import oracle as O

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def register(name: str, sql: str | None = None):
    def deco(fn):
        QUERIES[name] = fn
        if sql is not None:
            ORACLES[name] = sql
        return fn
    return deco


def landed(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search.landed_documents(tables.documents_corpus(spark, sf_dir), STANDIN_PHRASES)


def total(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract.spans_to_words(landed(spark, sf_dir), partitioned=True)


def total_m(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The extraction table, written once to the shared folder (the funnel reads it many times)."""
    return materialise(total(spark, sf_dir), "extraction")


# --- A1-A4 ------------------------------------------------------------------

@register("phrase_search", "WITH " + O.corpus_ctes() + """
SELECT query_pos, query, shard, rank, doc_ix, pos, len(spans)::BIGINT AS n_spans,
       len(list_filter(spans, lambda s: s.label = '0'))::BIGINT AS n_hits, texts
FROM wm_landed""")
def phrase_search(spark, sf_dir):
    d = landed(spark, sf_dir)
    return d.select("query_pos", "query", "shard", "rank", "doc_ix", "pos",
                    F.size("spans").cast("bigint").alias("n_spans"),
                    F.size(F.filter("spans", lambda s: s.label == "0")).cast("bigint").alias("n_hits"),
                    F.expr(extract.span_text()).alias("texts"))


# --- B1-B15 -----------------------------------------------------------------

@register("extraction_table", "WITH " + O.extraction_ctes() + """
SELECT query_pos, query, idx, span_id, doc_ix, hit_no, word, word_offset, sentence FROM wm_total""")
def extraction_table(spark, sf_dir):
    return total(spark, sf_dir)


# --- C: normalisation and the funnel -----------------------------------------

from ..functions.text import clean_text as _clean_text  # noqa: E402
from ..functions.text import normalise_word  # noqa: E402
from ..operators import audit as AU  # noqa: E402
from ..operators import frequency as FQ  # noqa: E402
from ..operators import fuzzy, lexicon  # noqa: E402
from ..operators.arcs import arc_keep, arc_pattern, rule_arcs  # noqa: E402
from ..operators.normalize import preprocess, shape_ok  # noqa: E402
from . import funnel  # noqa: E402


def lexicons(spark: SparkSession, sf_dir: str, variant: str = "current") -> funnel.Lexicons:
    """The funnel's lexicons, each derived once and written (they are read by several
    stages and their size checks)."""
    wl = materialise(tables.word_list(spark, sf_dir), "word-list")
    titles = tables.title_list(spark, sf_dir) if variant == "older" else tables.title_words(spark, sf_dir)
    return funnel.Lexicons(word_list=wl, base_list=wl, checkers=[("benchmark", wl)],
                           titles=materialise(titles, "titles"),
                           dictionary=materialise(tables.dictionary_entries(spark, sf_dir), "dictionary"),
                           variant=variant)


def audited(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every extracted row with the stage that removed it, written once (the
    per-stage kept/removed output) so audit, final table and frequencies read it."""
    return materialise(funnel.audit_rows(total_m(spark, sf_dir), lexicons(spark, sf_dir), STANDIN_PHRASES),
                       "audited")


def stage_words(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Distinct normalised words of the right shape (input of the word-level stages)."""
    pre = preprocess(total_m(spark, sf_dir))
    return pre.where(F.col("word").isNotNull() & shape_ok("word")).select("word").distinct()


def after_words_stage(spark: SparkSession, sf_dir: str) -> DataFrame:
    wl = tables.word_list(spark, sf_dir)
    v = lexicon.base_in_lexicon(lexicon.in_lexicon(stage_words(spark, sf_dir), wl, "f_list"), wl, "f_base")
    return v.where(~(F.col("f_list") | F.col("f_base"))).select("word")


def after_spell_stage(spark: SparkSession, sf_dir: str) -> DataFrame:
    wl = tables.word_list(spark, sf_dir)
    s = fuzzy.near_flag(after_words_stage(spark, sf_dir), wl, "f_spell")
    return s.where(~F.col("f_spell")).select("word")


_EX = "WITH " + O.extraction_ctes() + "\n"
_FN = "WITH " + O.funnel_ctes() + "\n"
_FQ = "WITH " + O.frequency_ctes() + "\n"


@register("normalise_words", _EX + f"""
SELECT query_pos, query, idx, word AS org, {O.normalise_sql('word')} AS word FROM wm_total""")
def normalise_words(spark, sf_dir):
    return preprocess(total(spark, sf_dir)).select("query_pos", "query", "idx", "org", "word")


@register("shape_filter", f"""
SELECT word, count(*)::BIGINT AS n, (length(word) BETWEEN 4 AND 22) AS length_ok,
       (NOT regexp_matches(word, '{O.TRIPLES}')) AS no_run, {O.shape_sql('word')} AS keep
FROM (SELECT {O.normalise_sql('t')} AS word FROM (
        SELECT regexp_replace(unnest(regexp_split_to_array(text, '\\s+')), '{O.RX_EDGE}', '', 'g') AS t
        FROM documents) WHERE t <> '')
WHERE word IS NOT NULL GROUP BY word""")
def shape_filter_all_tokens(spark, sf_dir):
    """C2 + C5/C6 over every token of the corpus (the extracted words hold no triple runs)."""
    from ..functions.text import length_ok, no_triple_run
    toks = FQ.corpus_tokens(tables.documents_corpus(spark, sf_dir))
    w = toks.select(normalise_word("form").alias("word")).where(F.col("word").isNotNull())
    return (w.groupBy("word").agg(F.count(F.lit(1)).cast("bigint").alias("n"))
            .select("word", "n", length_ok("word").alias("length_ok"), no_triple_run("word").alias("no_run"),
                    shape_ok("word").alias("keep")))


@register("clean_text", """
SELECT conv_id::BIGINT AS conv_id, turn::BIGINT AS turn,
       coalesce(regexp_replace(lower(text), '[^a-z]', '', 'g'), '') AS cleaned
FROM conversations""")
def clean_text_turns(spark, sf_dir):
    c = tables.read_table(spark, sf_dir, "conversations")
    return c.select(F.col("conv_id").cast("bigint").alias("conv_id"), F.col("turn").cast("bigint").alias("turn"),
                    _clean_text("text").alias("cleaned"))


@register("lexicon_exclude", _FN + """
SELECT p.query_pos, p.query, p.idx, p.nword AS word, v.f_words AS listed
FROM wm_pre p JOIN wm_v1 v ON p.nword = v.word""")
def lexicon_exclude(spark, sf_dir):
    """C7/C8 on the rows: is the word (or a base form of it) in the word list."""
    wl = tables.word_list(spark, sf_dir)
    pre = preprocess(total_m(spark, sf_dir))
    words = pre.where(F.col("word").isNotNull() & shape_ok("word")).select("word").distinct()
    v = lexicon.base_in_lexicon(lexicon.in_lexicon(words, wl, "f_list"), wl, "f_base")
    v = v.select(F.col("word").alias("_w"), (F.col("f_list") | F.col("f_base")).alias("listed"))
    return (pre.join(v, F.col("word") == F.col("_w"))
            .select("query_pos", "query", "idx", "word", "listed"))


@register("typo_exclude", _FN + "SELECT word, f_spell FROM wm_v2")
def typo_exclude(spark, sf_dir):
    wl = tables.word_list(spark, sf_dir)
    return fuzzy.near_flag(after_words_stage(spark, sf_dir), wl, "f_spell")


@register("checker_cascade", _FN + """
SELECT v.word, CASE WHEN EXISTS (SELECT 1 FROM wm_wordlist l WHERE levenshtein(v.word, l.word) <= 1) THEN 'benchmark'
                    WHEN EXISTS (SELECT 1 FROM wm_convwords l WHERE levenshtein(v.word, l.word) <= 1) THEN 'conversations'
               END AS spell_checker
FROM (SELECT word FROM wm_v1 WHERE NOT f_words) v""")
def checker_cascade(spark, sf_dir):
    wl = tables.word_list(spark, sf_dir)
    conv = tables.read_table(spark, sf_dir, "conversations").select(
        F.explode(tables.lexicon_words("text")).alias("word")).distinct()
    return fuzzy.checker_cascade(after_words_stage(spark, sf_dir), [("benchmark", wl), ("conversations", conv)])


@register("title_exclude", _FN + "SELECT word, f_enc FROM wm_v3")
def title_exclude(spark, sf_dir):
    return fuzzy.near_flag(after_spell_stage(spark, sf_dir), tables.title_words(spark, sf_dir), "f_enc")


@register("title_contains", _FN + """
SELECT w.word, EXISTS (SELECT 1 FROM wm_titles t WHERE contains(lower(t.title), w.word)) AS f_contains
FROM wm_w w""")
def title_contains(spark, sf_dir):
    return fuzzy.title_contains_flag(stage_words(spark, sf_dir), tables.title_list(spark, sf_dir), "f_contains")


@register("dictionary_exclude", _FN + "SELECT word, dsrc AS dict_source FROM wm_v4")
def dictionary_exclude(spark, sf_dir):
    w = fuzzy.near_flag(after_spell_stage(spark, sf_dir), tables.title_words(spark, sf_dir), "f_enc")
    w4 = w.where(~F.col("f_enc")).select("word")
    return lexicon.dictionary_reason(w4, tables.dictionary_entries(spark, sf_dir))


@register("kept_removed", _FN + """
SELECT query_pos, query, idx, span_id, doc_ix, org, word, removed_by FROM wm_audit""")
def kept_removed(spark, sf_dir):
    return audited(spark, sf_dir).select("query_pos", "query", "idx", "span_id", "doc_ix", "org", "word",
                                         "removed_by")


_STAGE_VALUES = ", ".join(f"({i}, {O.q(s)})" for i, s in enumerate(AU.STAGES))


@register("stage_audit", _FN + f""",
wm_st AS (SELECT * FROM (VALUES {_STAGE_VALUES}) s(stage_pos, stage)),
wm_rm AS (
  SELECT s.stage_pos, s.stage,
         (SELECT count(*) FROM wm_audit a WHERE split_part(a.removed_by, ':', 1) = s.stage) AS n_removed
  FROM wm_st s)
SELECT stage_pos::BIGINT AS stage_pos, stage,
       ((SELECT count(*) FROM wm_audit) - coalesce(sum(n_removed) OVER (ORDER BY stage_pos
          ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))::BIGINT AS n_in,
       n_removed::BIGINT AS n_removed,
       ((SELECT count(*) FROM wm_audit) - sum(n_removed) OVER (ORDER BY stage_pos
          ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW))::BIGINT AS n_kept
FROM wm_rm""".replace(_FN + ",", _FN.rstrip() + ","))
def stage_audit(spark, sf_dir):
    return AU.stage_audit(audited(spark, sf_dir))


@register("final_dedup", _FN + """
SELECT word, sentence, query_pos, idx FROM wm_first""")
def final_dedup(spark, sf_dir):
    return funnel.dedup_words(funnel.final_words(audited(spark, sf_dir)))


# --- D: frequency --------------------------------------------------------------

def collected(spark, sf_dir):
    return FQ.collected_frequency(funnel.final_words(audited(spark, sf_dir)))


def corpus_freq(spark, sf_dir):
    return FQ.corpus_frequency(collected(spark, sf_dir), tables.documents_corpus(spark, sf_dir))


@register("collected_frequency", _FQ + "SELECT * FROM wm_collected")
def collected_frequency(spark, sf_dir):
    return collected(spark, sf_dir)


@register("corpus_frequency", _FQ + "SELECT * FROM wm_corpusfreq")
def corpus_frequency(spark, sf_dir):
    return FQ.sort_by_count(corpus_freq(spark, sf_dir))


@register("top_words", _FQ + "SELECT word, count FROM wm_corpusfreq ORDER BY count DESC, word LIMIT 25")
def top_words(spark, sf_dir):
    return FQ.top_words(corpus_freq(spark, sf_dir), 25).select("word", "count")


@register("cardinality_report", _FQ + """
SELECT (SELECT count(*) FROM wm_final)::BIGINT AS n_rows, (SELECT count(*) FROM wm_collected)::BIGINT AS n_words,
       (SELECT count(*) FROM wm_corpusfreq)::BIGINT AS n_counted,
       (SELECT count(*) FROM wm_corpusfreq WHERE count > 0)::BIGINT AS n_nonzero""")
def cardinality_report(spark, sf_dir):
    fin = funnel.final_words(audited(spark, sf_dir))
    col = FQ.collected_frequency(fin)
    return FQ.cardinality_report(fin, col, FQ.corpus_frequency(col, tables.documents_corpus(spark, sf_dir)))


@register("mine_coined_words", _FQ + """,
wm_dedup AS (SELECT word, sentence FROM wm_first)
SELECT c.word, c.count AS n_collected, f.count AS n_corpus, d.sentence, c.org, c.doc_ix
FROM wm_collected c JOIN wm_corpusfreq f ON c.word = f.word JOIN wm_dedup d ON c.word = d.word""")
def mine_coined_words(spark, sf_dir):
    """Flagship: every surviving coined word with its collected and corpus counts and first sentence."""
    fin = funnel.final_words(audited(spark, sf_dir))
    col = FQ.collected_frequency(fin)
    cf = FQ.corpus_frequency(col, tables.documents_corpus(spark, sf_dir)).select(
        F.col("word").alias("_cw"), F.col("count").alias("n_corpus"))
    dd = funnel.dedup_words(fin).select(F.col("word").alias("_dw"), "sentence")
    return (col.join(cf, F.col("word") == F.col("_cw")).join(dd, F.col("word") == F.col("_dw"))
            .select("word", F.col("count").alias("n_collected"), "n_corpus", "sentence", "org", "doc_ix"))


# --- A: acquisition bookkeeping -------------------------------------------------

from ..operators import collect as CO  # noqa: E402

_CO = "WITH " + O.corpus_ctes() + "\n"
_UNIQUE = """,
wm_unique AS (
  SELECT query_pos, query, doc_ix, shard, rank, pos FROM (
    SELECT *, row_number() OVER (PARTITION BY query, doc_ix ORDER BY shard, rank) AS rn FROM wm_landed)
  WHERE rn = 1)
"""
CAP = 100          # A6 stand-in target per phrase
PART_SIZE = 25     # A9 part size
DONE_AT = 100      # A12 stand-in: a phrase with this many documents counts as done
_PHRASE_VALUES = ", ".join(f"({i}, {O.q(p)})" for i, p in enumerate(STANDIN_PHRASES))


def labelled(spark, sf_dir):
    """Documents present in ``labels``: the stand-in for 'retrieved before'."""
    return tables.read_table(spark, sf_dir, "labels").select(F.col("doc_id").cast("bigint").alias("doc_ix")).distinct()


def unique_docs(spark, sf_dir):
    return CO.unique_collect(landed(spark, sf_dir))


@register("shard_counts", _CO + """
SELECT query, shard, sum(len(hits))::BIGINT AS occurrences, count(*)::BIGINT AS documents,
       CASE grouping(query, shard) WHEN 3 THEN 'all' WHEN 1 THEN 'phrase' ELSE 'shard' END AS level
FROM wm_hits WHERE len(hits) > 0 GROUP BY ROLLUP (query, shard)""")
def shard_counts(spark, sf_dir):
    return search.shard_counts(tables.documents_corpus(spark, sf_dir), STANDIN_PHRASES)


@register("unique_collect", _CO + _UNIQUE + "SELECT * FROM wm_unique")
def unique_collect(spark, sf_dir):
    return unique_docs(spark, sf_dir)


@register("target_cap", _CO + _UNIQUE + f"""
SELECT * FROM (
  SELECT *, (row_number() OVER (PARTITION BY query ORDER BY shard, rank) - 1)::BIGINT AS n FROM wm_unique)
WHERE n < {CAP}""")
def target_cap(spark, sf_dir):
    return CO.target_cap(unique_docs(spark, sf_dir), {p: CAP for p in STANDIN_PHRASES})


@register("resume_union", _CO + _UNIQUE + """
SELECT *, true AS prior FROM wm_unique u WHERE EXISTS (SELECT 1 FROM labels l WHERE l.doc_id = u.doc_ix)
UNION ALL
SELECT *, false AS prior FROM wm_unique u WHERE NOT EXISTS (SELECT 1 FROM labels l WHERE l.doc_id = u.doc_ix)""")
def resume_union(spark, sf_dir):
    u = unique_docs(spark, sf_dir)
    before = u.join(labelled(spark, sf_dir), "doc_ix", "left_semi").withColumn("prior", F.lit(True))
    return CO.resume_union(u.withColumn("prior", F.lit(False)), before)


@register("split_manifest", _CO + _UNIQUE + f"""
SELECT query, floor(n / {PART_SIZE})::BIGINT AS part, min(n) AS start, max(n) AS "end", count(*)::BIGINT AS n
FROM (SELECT *, (row_number() OVER (PARTITION BY query ORDER BY shard, rank) - 1)::BIGINT AS n FROM wm_unique)
GROUP BY query, floor(n / {PART_SIZE})""")
def split_manifest(spark, sf_dir):
    return CO.split_manifest(unique_docs(spark, sf_dir), PART_SIZE)


@register("missing_ranks", _CO + """
SELECT query, shard, rank FROM wm_landed w
WHERE NOT EXISTS (SELECT 1 FROM labels l WHERE l.doc_id = w.doc_ix)""")
def missing_ranks(spark, sf_dir):
    req = landed(spark, sf_dir)
    got = req.join(labelled(spark, sf_dir), "doc_ix", "left_semi")
    return search.missing_ranks(req, got)


@register("landed_counts", _CO + f"""
SELECT p.query_pos::BIGINT AS query_pos, p.query, coalesce(c.n_landed, 0)::BIGINT AS n_landed,
       coalesce(c.n_docs, 0)::BIGINT AS n_docs
FROM (VALUES {_PHRASE_VALUES}) p(query_pos, query)
LEFT JOIN (SELECT query, count(*) AS n_landed, count(DISTINCT doc_ix) AS n_docs FROM wm_landed GROUP BY query) c
  ON p.query = c.query""")
def landed_counts(spark, sf_dir):
    return search.landed_counts(landed(spark, sf_dir), STANDIN_PHRASES)


@register("pending_worklist", _CO + f"""
SELECT expression, status FROM (
  SELECT p.query AS expression,
         CASE WHEN coalesce(c.n_docs, 0) >= {DONE_AT} THEN 'o' WHEN coalesce(c.n_docs, 0) > 0 THEN 'x' END AS status
  FROM (VALUES {_PHRASE_VALUES}) p(query_pos, query)
  LEFT JOIN (SELECT query, count(DISTINCT doc_ix) AS n_docs FROM wm_landed GROUP BY query) c ON p.query = c.query)
WHERE status IS DISTINCT FROM 'o'""")
def pending_worklist(spark, sf_dir):
    counts = search.landed_counts(landed(spark, sf_dir), STANDIN_PHRASES)
    status = F.when(F.col("n_docs") >= DONE_AT, "o").when(F.col("n_docs") > 0, "x")
    work = counts.select(F.col("query").alias("expression"), status.alias("status"))
    return CO.pending_worklist(work)


# --- B: spans, words, sentences ------------------------------------------------

def span_docs(spark, sf_dir):
    return extract.unique_windows(landed(spark, sf_dir), partitioned=True)


@register("span_ids", _EX + "SELECT query_pos, query, span_id, doc_ix, shard, rank, pos FROM wm_udocs")
def span_ids(spark, sf_dir):
    return span_docs(spark, sf_dir).select("query_pos", "query", "span_id", "doc_ix", "shard", "rank", "pos")


@register("preceding_words", _EX + "SELECT query_pos, query, span_id, doc_ix, hit_no, raw, word, word_offset::BIGINT AS word_offset FROM wm_hit4")
def preceding_words(spark, sf_dir):
    return extract.hit_words(span_docs(spark, sf_dir))


@register("sentence_split", _EX + f"""
SELECT query_pos, query, span_id, (k - 1)::BIGINT AS k,
       coalesce(list_sum(list_transform(pieces[1:k - 1], lambda x: length(x))), 0)::BIGINT AS start,
       length(regexp_replace(pieces[k], '\\s+$', ''))::BIGINT AS len, pieces[k] AS piece
FROM (SELECT query_pos, query, span_id, pieces, unnest(generate_series(1, len(pieces))) AS k
      FROM (SELECT query_pos, query, span_id, regexp_extract_all(texts, {O.q(O.RX_SENT)}) AS pieces FROM wm_udocs))""")
def sentence_split(spark, sf_dir):
    return extract.sentence_table(span_docs(spark, sf_dir))


@register("expression_counts", _EX + """
SELECT a.query, a.n_landed, coalesce(b.n_unique, 0)::BIGINT AS n_unique, coalesce(c.n_rows, 0)::BIGINT AS n_rows
FROM (SELECT query, count(*)::BIGINT AS n_landed FROM wm_landed GROUP BY query) a
LEFT JOIN (SELECT query, count(*)::BIGINT AS n_unique FROM wm_udocs GROUP BY query) b ON a.query = b.query
LEFT JOIN (SELECT query, count(*)::BIGINT AS n_rows FROM wm_total GROUP BY query) c ON a.query = c.query""")
def expression_counts(spark, sf_dir):
    ld = landed(spark, sf_dir)
    return extract.expression_counts(ld, extract.spans_to_words(ld, partitioned=True))


@register("first_span_variant", _CO.rstrip() + "," + O.first_span_cte() + "\nSELECT * FROM wm_spanrows")
def first_span_variant(spark, sf_dir):
    return extract.first_span_rows(landed(spark, sf_dir))


# --- C9: grammatical arcs (pattern approximation; the driver has no parser output) ---

def _arc_case_sql() -> str:
    # "something is", at most four words of letters or hyphens, the phrase's last word, then a mark or the end
    rule = r"(?i)\S\s+is(?:\s+[-a-z]+){0,4}\s+%s(?:\s*[]!?.,:;)" + "\"'" + r"]|\s*$)"
    parts = " ".join(f"WHEN {O.q(p)} THEN regexp_matches(sentence, {O.q((rule % p.split()[-1]).replace('[]!', '[!'))})"
                     for p in STANDIN_PHRASES)
    return f"CASE query {parts} ELSE false END"


@register("arc_filter", _EX + f"SELECT query_pos, query, idx, word, {_arc_case_sql()} AS arc_ok FROM wm_total")
def arc_filter(spark, sf_dir):
    t = total(spark, sf_dir)
    return t.select("query_pos", "query", "idx", "word", arc_pattern(STANDIN_PHRASES).alias("arc_ok"))


@register("arc_kept_removed", "WITH " + O.funnel_ctes(arc_ok=_arc_case_sql()) + """
SELECT query_pos, query, idx, org, word, removed_by FROM wm_audit""")
def arc_kept_removed(spark, sf_dir):
    """The funnel with its arc stage on (pattern form)."""
    rows = funnel.audit_rows(total_m(spark, sf_dir), lexicons(spark, sf_dir), STANDIN_PHRASES, arcs="pattern")
    return rows.select("query_pos", "query", "idx", "org", "word", "removed_by")


@register("arc_table_keep", _EX + """,
wm_arct AS (SELECT DISTINCT query, sentence, list_transform(
    list_filter(regexp_split_to_array(sentence, '\\s+'), lambda t: t <> ''),
    lambda t: lower(regexp_replace(t, '^[^\\p{L}\\p{N}]+|[^\\p{L}\\p{N}]+$', '', 'g'))) AS w FROM wm_total),
wm_arck AS (SELECT query, sentence, list_max(list_transform(w, lambda t, j: CASE WHEN t = 'is' THEN j END)) AS last_is, w,
    string_split(query, ' ')[-1] AS tg FROM wm_arct),
wm_arcp AS (SELECT query, sentence, w, tg, unnest(generate_series(1, len(w))) AS i FROM wm_arck)
SELECT DISTINCT query, sentence FROM (
  SELECT query, sentence, w, tg, i, list_max(list_filter(generate_series(1, greatest(i - 1, 1)), lambda j: j < i AND w[j] = 'is')) AS h FROM wm_arcp)
WHERE w[i] = tg AND h > 1
  AND NOT (i < len(w) AND list_max(list_filter(generate_series(1, i), lambda j: w[j] = 'is')) = i)
  AND NOT (i < len(w) AND h IS NULL)""".replace(_EX + ",", _EX.rstrip() + ","))
def arc_table_keep(spark, sf_dir):
    """C9 with a token-arc table: the (phrase, sentence) pairs that have the arc shape under rule-made arcs."""
    rows = materialise(funnel.with_sentence_id(total_m(spark, sf_dir).select("query", "sentence").distinct()), "sentences")
    # written once: three joins read the arcs
    arcs = materialise(rule_arcs(rows.select("sent_id", "sentence")), "arcs")
    return arc_keep(rows, arcs).select("query", "sentence")


# --- A13-A19: file sources and sinks; C24 lemma lexicon --------------------------

from ..constants import STANDIN_INFLECTIONS  # noqa: E402
from ..sources import files as FS  # noqa: E402


def _read_back_landed(spark, path):
    back = FS.read_landed_json(spark, path, multi_line=False)
    phrases = F.array(*[F.lit(p) for p in STANDIN_PHRASES])
    query = F.regexp_replace("query_slug", "_", " ")
    return back.select((F.array_position(phrases, query) - 1).cast("bigint").alias("query_pos"),
                       query.alias("query"), "doc_ix", "shard", "rank", "pos", "metadata", "spans")


@register("json_csv_roundtrip", _EX + "SELECT idx, span_id, doc_ix, word, sentence, query FROM wm_total")
def json_csv_roundtrip(spark, sf_dir):
    """Landed documents -> JSON (one folder per expression) -> read back -> extraction
    table -> CSV -> read back with an explicit schema."""
    jpath = FS.scratch(spark, "landed-json")
    FS.write_landed_json(landed(spark, sf_dir), jpath)
    tot = extract.spans_to_words(_read_back_landed(spark, jpath))
    cpath = FS.scratch(spark, "total-csv")
    FS.write_csv(tot.select("idx", "span_id", "doc_ix", "word", "sentence", "query"), cpath)
    return FS.read_total_csv(spark, cpath)


@register("partitioned_reuse", _CO + _UNIQUE + "SELECT * FROM wm_unique")
def partitioned_reuse(spark, sf_dir):
    """The unique collection written once, partitioned by expression, then reused."""
    path = FS.scratch(spark, "unique-by-query")

    def build():
        return unique_docs(spark, sf_dir).withColumn("query_slug", FS.query_slug())

    FS.materialise_once(spark, path, build, partition_by=["query_slug"])
    back = FS.materialise_once(spark, path, build, partition_by=["query_slug"])  # second call reuses
    return back.select("query_pos", "query", "doc_ix", "shard", "rank", "pos")


@register("json_array_source", _CO + """
SELECT query, doc_ix, shard, rank, pos, len(spans)::BIGINT AS n_spans, metadata FROM wm_landed""")
def json_array_source(spark, sf_dir):
    """A13 on files that each hold one JSON array."""
    path = FS.scratch(spark, "landed-arrays")
    FS.write_landed_json_arrays(landed(spark, sf_dir), path)
    back = FS.read_landed_json(spark, path, multi_line=True)
    return back.select(F.regexp_replace("query_slug", "_", " ").alias("query"), "doc_ix", "shard", "rank", "pos",
                       F.size("spans").cast("bigint").alias("n_spans"), "metadata")


@register("lexicon_load", "WITH " + O.lexicon_ctes() + "\nSELECT word, 'benchmark' AS source FROM wm_wordlist")
def lexicon_load(spark, sf_dir):
    """The word list written as plain text and read back."""
    path = FS.scratch(spark, "word-list-text")
    tables.read_table(spark, sf_dir, "benchmark").select("text").write.text(path)
    return FS.read_word_list(spark, path, "benchmark")


@register("part_files", _CO + _UNIQUE + "SELECT query, doc_ix, shard, rank, pos FROM wm_unique")
def part_files(spark, sf_dir):
    """A9 sink: part files per expression, read back."""
    path = FS.scratch(spark, "parts")
    CO.write_parts(unique_docs(spark, sf_dir).select("query", "doc_ix", "shard", "rank", "pos"), path, PART_SIZE)
    back = spark.read.schema("query string, doc_ix bigint, shard string, rank bigint, pos bigint").json(path)
    return back.select("query", "doc_ix", "shard", "rank", "pos")


@register("response_validity", """
SELECT conv_id::VARCHAR || '-' || turn::VARCHAR AS word, role AS source FROM conversations
WHERE (conv_id + turn) % 5 IN (0, 4) AND (conv_id + turn) % 7 <> 3""")
def response_validity(spark, sf_dir):
    """C17: stored responses made from conversation turns - entries, suggestion lists, objects, broken bodies, error codes."""
    c = tables.read_table(spark, sf_dir, "conversations")
    k, quoted = F.col("conv_id") + F.col("turn"), F.to_json(F.struct(F.substring("text", 1, 20).alias("id")))
    body = (F.when(k % 5 == 0, F.concat(F.lit('[{"meta":'), quoted, F.lit("}]")))
            .when(k % 5 == 1, F.lit('["suggestion", "other"]'))
            .when(k % 5 == 2, F.concat(F.lit('{"meta":'), quoted, F.lit("}")))
            .when(k % 5 == 3, F.lit("[]"))
            .otherwise(F.concat(F.lit(' [{"hom": 1, "meta":'), quoted, F.lit('}, "x"]'))))
    responses = c.select(F.concat_ws("-", F.col("conv_id").cast("string"), F.col("turn").cast("string")).alias("word"),
                         F.col("role").alias("api"), F.when(k % 7 == 3, 404).otherwise(200).alias("status"), body.alias("body"))
    return lexicon.valid_responses(responses)


def _inflection_sql() -> str:
    return " UNION ALL ".join(f"SELECT word || {O.q(suf)} AS form, word AS lemma FROM wm_wordlist"
                              for suf, _ in STANDIN_INFLECTIONS)


@register("lemma_exclude", _FN + f""",
wm_morph AS ({_inflection_sql()}),
wm_listed AS (SELECT form AS w FROM wm_morph UNION SELECT lemma FROM wm_morph)
SELECT query_pos, query, idx, nword AS word FROM wm_pre p
WHERE nword IS NOT NULL AND {O.shape_sql('nword')}
  AND NOT EXISTS (SELECT 1 FROM wm_listed l WHERE l.w = p.nword)""")
def lemma_exclude(spark, sf_dir):
    """A15 TSV sink + A16 reader + C23 cleaning + C24 exclusion on the extracted rows."""
    wl = tables.word_list(spark, sf_dir)
    rows = F.array(*[F.struct(F.concat(F.col("word"), F.lit(suf)).alias("word"), F.col("word").alias("lemma"),
                              F.lit(feat).alias("features")) for suf, feat in STANDIN_INFLECTIONS])
    morph = wl.select(F.explode(rows).alias("_m")).select("_m.*")
    path = FS.scratch(spark, "lemmas-tsv")
    FS.write_tsv(morph, path)
    lem = lexicon.read_lemma_lexicon(FS.read_lemma_tsv(spark, path))
    pre = preprocess(total_m(spark, sf_dir))
    cand = pre.where(F.col("word").isNotNull() & shape_ok("word"))
    return lexicon.lemma_exclude(cand, lem).select("query_pos", "query", "idx", "word")


# --- A8: streaming unique collection --------------------------------------------

from ..streaming import collect as ST  # noqa: E402


@register("stream_collect", _CO + "SELECT DISTINCT query, doc_ix FROM wm_landed")
def stream_collect(spark, sf_dir):
    """Every landed occurrence written as files (several polls' worth), then deduplicated
    by a Structured Streaming query; equals the batch unique collection's keys."""
    src, sink, ckpt = (FS.scratch(spark, n) for n in ("stream-src", "stream-sink", "stream-ckpt"))
    ev = landed(spark, sf_dir).select("query", "doc_ix", "shard", "rank", "pos")
    ev.write.mode("overwrite").json(src)
    out = ST.unique_stream(spark, src, sink, ckpt)
    return out.select("query", "doc_ix")


# --- E: subword segmentation -------------------------------------------------------

from ..operators import segment as SG  # noqa: E402

_SEGW = """,
wm_segw AS (SELECT lower(word) AS word, count(*)::BIGINT AS n FROM wm_total
            WHERE regexp_full_match(word, '[a-zA-Z]+') GROUP BY lower(word)),
wm_p AS (
  SELECT word, n, s, l, substr(word, s, l) AS piece FROM (
    SELECT word, n, s, unnest(generate_series(1, 6)) AS l FROM (
      SELECT word, n, unnest(generate_series(1, length(word))) AS s FROM wm_segw))
  WHERE s + l - 1 <= length(word))
"""


def seg_words(spark, sf_dir):
    """Letters-only extracted words, lower-cased, weighted by their row count."""
    t = total(spark, sf_dir)
    return (t.where(F.col("word").rlike(r"^[a-zA-Z]+\z")).groupBy(F.lower("word").alias("word"))
            .agg(F.count(F.lit(1)).cast("bigint").alias("n")))


@register("piece_stats", _EX + _SEGW + "SELECT piece, sum(n)::BIGINT AS n FROM wm_p GROUP BY piece")
def piece_stats(spark, sf_dir):
    return SG.unigram_stats(seg_words(spark, sf_dir))


@register("bigram_stats", _EX + _SEGW + """
SELECT prev, piece, sum(n)::BIGINT AS n FROM (
  SELECT a.n, a.piece AS prev, b.piece FROM wm_p a JOIN wm_p b ON a.word = b.word AND b.s = a.s + a.l
  UNION ALL SELECT n, '<s>' AS prev, piece FROM wm_p WHERE s = 1)
GROUP BY prev, piece""")
def bigram_stats(spark, sf_dir):
    return SG.bigram_stats(seg_words(spark, sf_dir))


_BEAM = _SEGW + f""",
wm_u AS (SELECT piece, sum(n) AS c FROM wm_p GROUP BY piece),
wm_pair AS (
  SELECT b.word, b.n, b.s, a.l AS pl, b.l, a.piece AS prev, b.piece FROM wm_p a JOIN wm_p b ON a.word = b.word AND b.s = a.s + a.l
  UNION ALL SELECT word, n, s, 0 AS pl, l, '<s>' AS prev, piece FROM wm_p WHERE s = 1),
wm_b AS (SELECT prev, piece, sum(n) AS c FROM wm_pair GROUP BY prev, piece),
wm_lat AS (
  SELECT x.word, x.s, x.pl, x.l, x.piece, CAST(round(1e9 * ln(greatest(
      coalesce(b.c, 0) + coalesce(u.c, 0)::DOUBLE / (SELECT sum(c) FROM wm_u)::DOUBLE, 1e-12)
    / (CASE WHEN x.prev = '<s>' THEN (SELECT sum(c) FROM wm_b WHERE prev = '<s>') ELSE coalesce(v.c, 0) END + 1.0::DOUBLE))) AS BIGINT) AS score
  FROM wm_pair x LEFT JOIN wm_b b ON b.prev = x.prev AND b.piece = x.piece
    LEFT JOIN wm_u u ON u.piece = x.piece LEFT JOIN wm_u v ON v.piece = x.prev),
wm_beam(step, word, ends, pieces, score, l) AS (
  SELECT 0::BIGINT, word, 0::BIGINT, []::VARCHAR[], 0::BIGINT, 0::BIGINT FROM wm_segw
  UNION ALL (
  SELECT c.step + 1, c.word, c.ends + t.l, list_append(c.pieces, t.piece), c.score + t.score, t.l
  FROM (SELECT *, row_number() OVER (PARTITION BY word ORDER BY score DESC, pieces) AS k FROM wm_beam WHERE ends = step) c
    JOIN wm_lat t ON t.word = c.word AND t.s = c.ends + 1 AND t.pl = c.l WHERE c.k <= {BEAM_SIZE}
  UNION ALL SELECT step + 1, word, ends, pieces, score, l FROM wm_beam WHERE ends > step))
SELECT word, array_to_string(pieces, ' ') AS pieces, score / 1e9::DOUBLE AS score FROM (
  SELECT *, row_number() OVER (PARTITION BY word ORDER BY score DESC, pieces) AS k FROM wm_beam
  WHERE ends = step AND ends = length(word)) WHERE k = 1"""


@register("beam_segment", _EX.replace("WITH", "WITH RECURSIVE", 1) + _BEAM)
def beam_segment(spark, sf_dir):
    """Best segmentation of every distinct extracted word."""
    w = materialise(seg_words(spark, sf_dir))
    seg = SG.beam_segment(w, SG.unigram_stats(w), SG.bigram_stats(w))
    return seg.select("word", F.array_join("pieces", " ").alias("pieces"), "score")


# --- older pipeline variant: letters-only words (C4), title-contains stage (C15) ---

@register("older_kept_removed", "WITH " + O.funnel_ctes(older=True) + """
SELECT query_pos, query, doc_ix, sentence, org, word, removed_by FROM wm_audit""")
def older_kept_removed(spark, sf_dir):
    """The older pipeline end to end: first-span rows (B17-B19) through the older funnel."""
    first = materialise(extract.first_span_rows(landed(spark, sf_dir)), "first-span")
    rows = funnel.audit_rows(first, lexicons(spark, sf_dir, variant="older"), STANDIN_PHRASES)
    return rows.select("query_pos", "query", "doc_ix", "sentence", "org", "word", "removed_by")


# --- the second corpus: conversation turns -------------------------------------

@register("conversation_search", "WITH " + O.corpus_ctes(source="conversations") + """
SELECT query_pos, query, shard, rank, doc_ix, pos, len(spans)::BIGINT AS n_spans,
       len(list_filter(spans, lambda s: s.label = '0'))::BIGINT AS n_hits, texts
FROM wm_landed""")
def conversation_search(spark, sf_dir):
    """A1-A4 over the conversations corpus (one document per turn, the role as shard)."""
    d = search.landed_documents(tables.conversations_corpus(spark, sf_dir), STANDIN_PHRASES)
    return d.select("query_pos", "query", "shard", "rank", "doc_ix", "pos",
                    F.size("spans").cast("bigint").alias("n_spans"),
                    F.size(F.filter("spans", lambda s: s.label == "0")).cast("bigint").alias("n_hits"),
                    F.expr(extract.span_text()).alias("texts"))


# --- D5 with forms of several tokens -----------------------------------------------

@register("phrase_frequency", f"""
WITH tk AS (SELECT list_filter(regexp_split_to_array(text, '\\s+'), lambda t: t <> '') AS tk FROM benchmark),
f AS (SELECT DISTINCT array_to_string(tk[1:k], ' ') AS form FROM (SELECT tk, unnest(generate_series(1, 4)) AS k FROM tk) WHERE len(tk) >= k),
g AS (SELECT form, array_to_string(list_filter(list_transform(regexp_split_to_array(form, '\\s+'),
        lambda t: regexp_replace(t, {O.q(RX_EDGE)}, '', 'g')), lambda t: t <> ''), ' ') AS gram FROM f),
d AS (SELECT list_transform(regexp_split_to_array(text, '\\s+'), lambda t: regexp_replace(t, {O.q(RX_EDGE)}, '', 'g')) AS t FROM documents),
i AS (SELECT t[p:p + k - 1] AS w, k FROM (SELECT t, p, unnest(generate_series(1, 4)) AS k FROM (
        SELECT t, unnest(generate_series(1, len(t))) AS p FROM d)) WHERE p + k - 1 <= len(t)),
c AS (SELECT array_to_string(w, ' ') AS gram, count(*) AS n FROM i WHERE len(list_filter(w, lambda x: x = '')) = 0 GROUP BY 1)
SELECT g.form, coalesce(c.n, 0)::BIGINT AS count FROM g LEFT JOIN c ON c.gram = g.gram""")
def phrase_frequency(spark, sf_dir):
    """How often the first one to four tokens of the benchmark texts occur in the corpus."""
    tokens = F.filter(F.split("text", r"\s+"), lambda t: t != "")
    first = F.expr("transform(sequence(1, least(4, size(tk))), k -> array_join(slice(tk, 1, k), ' '))")
    forms = materialise(tables.read_table(spark, sf_dir, "benchmark").select(tokens.alias("tk")).filter("size(tk) > 0")
                        .select(F.explode(first).alias("form")).distinct(), "forms")
    counts = FQ.form_counts(tables.documents_corpus(spark, sf_dir), forms)
    return forms.join(counts, "form", "left").select("form", F.coalesce("cnt", F.lit(0)).alias("count"))


# --- A2, A3, A10: ranges of ranks, fetch by rank, the ledger -------------------------

from ..operators import ranks as RK  # noqa: E402

_MISSING = """, wm_missing AS (SELECT query, shard, rank, doc_ix, pos, spans FROM wm_landed w
  WHERE NOT EXISTS (SELECT 1 FROM labels l WHERE l.doc_id = w.doc_ix))"""


def missing(spark, sf_dir):
    """The landed table and the ranks whose document is not in ``labels``."""
    every = materialise(landed(spark, sf_dir), "landed")
    return every, search.missing_ranks(every, every.join(labelled(spark, sf_dir), "doc_ix", "left_semi"))


@register("rank_ranges", _CO.rstrip() + _MISSING + """
SELECT query, shard, min(rank)::BIGINT AS start, (max(rank) + 1)::BIGINT AS "end" FROM (
  SELECT *, rank - row_number() OVER (PARTITION BY query, shard ORDER BY rank) AS island FROM wm_missing)
GROUP BY query, shard, island""")
def rank_ranges(spark, sf_dir):
    """A2: the missing ranks as ranges."""
    return RK.ranks_to_ranges(missing(spark, sf_dir)[1])


@register("rank_expansion", _CO.rstrip() + _MISSING + "SELECT query, shard, rank FROM wm_missing")
def rank_expansion(spark, sf_dir):
    """A2: ranks to ranges and back to the same ranks."""
    return RK.ranges_to_ranks(RK.ranks_to_ranges(missing(spark, sf_dir)[1]))


@register("fetch_by_rank", _CO.rstrip() + _MISSING + """
SELECT query, shard, rank, doc_ix, pos, len(spans)::BIGINT AS n_spans FROM wm_missing""")
def fetch_by_rank(spark, sf_dir):
    """A3: the landed documents of the missing ranks, from the bucketed table."""
    every, ranks = missing(spark, sf_dir)
    found = RK.fetch_by_rank(RK.rank_table(every), ranks)
    return found.select("query", "shard", "rank", "doc_ix", "pos", F.size("spans").cast("bigint").alias("n_spans"))


def ledger(spark, sf_dir):
    """Two passes over all landed ranks: the first source has the documents of good quality, the second all that are labelled."""
    every = materialise(landed(spark, sf_dir), "landed")
    good = (tables.read_table(spark, sf_dir, "labels").filter("quality = 1")
            .select(F.col("doc_id").cast("bigint").alias("doc_ix")).distinct())
    sources = [RK.rank_table(every.join(docs, "doc_ix", "left_semi")) for docs in (good, labelled(spark, sf_dir))]
    fetches = [lambda pending, t=t: RK.fetch_by_rank(t, pending) for t in sources]
    return RK.retrieval_ledger(every, fetches, FS.scratch(spark, "ledger"))


@register("retrieval_ledger", _CO + """
SELECT query, shard, rank, CASE WHEN EXISTS (SELECT 1 FROM labels l WHERE l.doc_id = w.doc_ix AND l.quality = 1) THEN 1 ELSE 2 END::BIGINT AS attempts,
       EXISTS (SELECT 1 FROM labels l WHERE l.doc_id = w.doc_ix) AS retrieved FROM wm_landed w""")
def retrieval_ledger(spark, sf_dir):
    """A10: attempts and outcome of every rank over two passes."""
    return ledger(spark, sf_dir)


@register("ledger_leftovers", _CO.rstrip() + _MISSING + """
SELECT replace(query, ' ', '_') AS query_slug, shard, rank FROM wm_missing""")
def ledger_leftovers(spark, sf_dir):
    """A10: what no pass retrieved, as CSV per expression, read back."""
    path = FS.scratch(spark, "leftovers")
    RK.write_leftovers(ledger(spark, sf_dir), path)
    back = spark.read.schema("query string, shard string, rank bigint, query_slug string").options(**FS.CSV_OPTS).csv(path)
    return back.select("query_slug", "shard", "rank")


@register("manifest_files", _CO + _UNIQUE + f"""
SELECT query, replace(query, ' ', '_') || '_' || (n // {PART_SIZE} * {PART_SIZE})::VARCHAR || '_' ||
       (least(n // {PART_SIZE} * {PART_SIZE} + {PART_SIZE}, total) - 1)::VARCHAR || '.json' AS file, doc_ix, shard, rank, pos
FROM (SELECT *, (row_number() OVER (PARTITION BY query ORDER BY shard, rank) - 1)::BIGINT AS n,
        count(*) OVER (PARTITION BY query) AS total FROM wm_unique)""")
def manifest_files(spark, sf_dir):
    """One file for each manifest row, read back with its name."""
    path = FS.scratch(spark, "manifest-files")
    CO.write_manifest_files(unique_docs(spark, sf_dir).select("query", "doc_ix", "shard", "rank", "pos"), path, PART_SIZE)
    back = spark.read.schema("query string, doc_ix bigint, shard string, rank bigint, pos bigint").json(f"{path}/*/*.json")
    return back.withColumn("file", F.substring_index(F.input_file_name(), "/", -1)).select("query", "file", "doc_ix", "shard", "rank", "pos")
