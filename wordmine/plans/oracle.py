"""Oracle SQL (DuckDB dialect) for every registered query.

The logic is written independently of the Spark plans, with plain window
functions and list lambdas (the fixed values are those of ``constants``), over
the driver's views ``documents``, ``benchmark``,
``pages``, ``conversations``, ``labels``. Every number is cast to BIGINT on
both sides.
"""

from __future__ import annotations

from ..constants import MAX_DISP_LEN, MORPHY_RULES, RX_ALNUM, RX_EDGE, RX_SENT, STANDIN_PHRASES


def q(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def _phrase_hits_sql(phrases: list[str]) -> str:
    parts = []
    for i, ph in enumerate(phrases):
        tk = ph.lower().split()
        n = len(tk)
        conds = [f"lk[x + {j}] = {q(t)}" for j, t in enumerate(tk[:-1])]
        end = f"lk[x + {n - 1}]"
        conds.append(f"coalesce(nullif(regexp_replace({end}, '[^\\p{{L}}\\p{{N}}]+$', ''), ''), {end}) = {q(tk[-1])}")
        raw = (f"CASE WHEN len(lk) >= {n} THEN list_filter(generate_series(1, len(lk) - {n - 1}), "
               f"lambda x: {' AND '.join(conds)}) ELSE [] END")
        if any(tk[:k] == tk[n - k:] for k in range(1, n)):
            raw = (f"list_transform([{raw}], lambda r: list_filter(r, lambda h, i: i = 1 OR h >= r[i - 1] + {n}))[1]")
        parts.append(f"SELECT {i}::BIGINT AS query_pos, {q(ph)} AS query, {n} AS n_tok, doc_ix, shard, "
                     f"metadata, tokens, {raw} AS hits FROM wm_docs")
    return "\nUNION ALL\n".join(parts)


_CORPUS_SQL = {
    "documents": """SELECT doc_id::BIGINT AS doc_ix, source AS shard,
         '{"lang":"' || lang || '","source":"' || source || '"}' AS metadata, text FROM documents""",
    "conversations": """SELECT (conv_id * 4294967296 + turn)::BIGINT AS doc_ix, role AS shard,
         '{"conv_id":' || conv_id::VARCHAR || ',"turn":' || turn::VARCHAR || '}' AS metadata, text
         FROM conversations""",
}


def corpus_ctes(phrases: list[str] = STANDIN_PHRASES, max_disp_len: int = MAX_DISP_LEN,
                source: str = "documents") -> str:
    """CTEs: wm_docs, wm_hits, wm_landed (one row per occurrence, with rank)."""
    half = max_disp_len // 2
    return f"""
wm_corpus AS ({_CORPUS_SQL[source]}),
wm_docs0 AS (
  SELECT doc_ix, shard, metadata,
         list_filter(regexp_split_to_array(text, '\\s+'), lambda t: t <> '') AS tokens
  FROM wm_corpus
),
wm_docs AS (SELECT *, list_transform(tokens, lambda t: lower(t)) AS lk FROM wm_docs0),
wm_hits AS (
{_phrase_hits_sql(phrases)}
),
wm_occ AS (
  SELECT query_pos, query, n_tok, doc_ix, shard, metadata, tokens, hits, unnest(hits) AS p
  FROM wm_hits WHERE len(hits) > 0
),
wm_win AS (
  SELECT *, greatest(1, p - {half}) AS lo, least(len(tokens), p + n_tok - 1 + {half}) AS hi FROM wm_occ
),
wm_win2 AS (
  SELECT *, list_filter(hits, lambda h: h >= lo AND h + n_tok - 1 <= hi) AS wh FROM wm_win
),
wm_landed0 AS (
  SELECT query_pos, query, doc_ix, shard, metadata, p::BIGINT AS pos,
    list_concat(
      [{{'text': array_to_string(tokens[lo:wh[1] - 1], ' '), 'label': NULL::VARCHAR}}],
      flatten(list_transform(wh, lambda h, j: [
        {{'text': array_to_string(tokens[h:h + n_tok - 1], ' '), 'label': '0'}},
        {{'text': array_to_string(tokens[h + n_tok:coalesce(wh[j + 1], hi + 1) - 1], ' '), 'label': NULL::VARCHAR}}
      ]))) AS spans
  FROM wm_win2
),
wm_landed AS (
  SELECT *, (row_number() OVER (PARTITION BY query, shard ORDER BY doc_ix, pos) - 1)::BIGINT AS rank,
         array_to_string(list_transform(spans, lambda s: s.text), ' ') AS texts
  FROM wm_landed0
)"""


def extraction_ctes(phrases: list[str] = STANDIN_PHRASES) -> str:
    """CTEs after ``corpus_ctes``: wm_udocs (B3/B4), wm_total."""
    return corpus_ctes(phrases) + f""",
wm_udocs0 AS (
  SELECT * FROM (
    SELECT *, row_number() OVER (PARTITION BY query, doc_ix, metadata, texts ORDER BY shard, rank) AS rn
    FROM wm_landed) WHERE rn = 1
),
wm_udocs AS (
  SELECT *, (row_number() OVER (PARTITION BY query ORDER BY shard, rank) - 1)::BIGINT AS span_id
  FROM wm_udocs0
),
wm_hit0 AS (
  SELECT query_pos, query, span_id, doc_ix, texts, spans, unnest(
    list_filter(generate_series(2, greatest(len(spans), 2)), lambda i: spans[i].label = '0')) AS si
  FROM wm_udocs
),
wm_hit1 AS (
  SELECT *, regexp_extract_all(spans[si - 1].text, '\\s*\\S+') AS tk,
         coalesce(list_sum(list_transform(spans[1:si - 2], lambda x: length(x.text) + 1)), 0) AS soff
  FROM wm_hit0
),
wm_hit2 AS (
  SELECT *, list_transform(tk, lambda t: regexp_replace(t, '^\\s+', '')) AS core,
         coalesce(list_max(list_transform(tk, lambda t, j: CASE WHEN regexp_matches(t, {q(RX_ALNUM)}) THEN j ELSE 0 END)), 0) AS pp
  FROM wm_hit1
),
wm_hit3 AS (
  SELECT query_pos, query, span_id, doc_ix, texts, si,
         array_to_string(core[pp:], ' ') AS raw,
         soff + length(array_to_string(tk[1:pp - 1], '')) + length(tk[pp]) - length(core[pp]) AS word_offset
  FROM wm_hit2 WHERE pp > 0
),
wm_hit4 AS (
  SELECT *, (row_number() OVER (PARTITION BY query, span_id ORDER BY si) - 1)::BIGINT AS hit_no,
         regexp_replace(raw, {q(RX_EDGE)}, '', 'g') AS word
  FROM wm_hit3
),
wm_hit5 AS (
  SELECT *, regexp_extract_all(texts, {q(RX_SENT)}) AS pieces FROM wm_hit4 WHERE word <> ''
),
wm_hit6 AS (
  SELECT *, list_filter(generate_series(1, greatest(len(pieces), 1)), lambda k:
      coalesce(list_sum(list_transform(pieces[1:k - 1], lambda x: length(x))), 0) <= word_offset
      AND word_offset < coalesce(list_sum(list_transform(pieces[1:k - 1], lambda x: length(x))), 0)
                        + length(regexp_replace(pieces[k], '\\s+$', '')))[1] AS sk
  FROM wm_hit5
),
wm_hit7 AS (
  SELECT query_pos, query, span_id, doc_ix, hit_no, word, word_offset::BIGINT AS word_offset,
    CASE WHEN contains(lower(pieces[sk]), query) AND contains(lower(pieces[sk]), lower(word))
           THEN regexp_replace(pieces[sk], '^\\s+|\\s+$', '', 'g')
         WHEN sk < len(pieces)
           THEN regexp_replace(pieces[sk], '^\\s+|\\s+$', '', 'g') || ' ' || regexp_replace(pieces[sk + 1], '^\\s+|\\s+$', '', 'g')
         ELSE regexp_replace(pieces[sk], '^\\s+|\\s+$', '', 'g') END AS sentence
  FROM wm_hit6 WHERE sk IS NOT NULL
),
wm_total AS (
  SELECT *, (row_number() OVER (PARTITION BY query ORDER BY span_id, hit_no) - 1)::BIGINT AS idx
  FROM wm_hit7
  WHERE query_pos IS NOT NULL AND query IS NOT NULL AND span_id IS NOT NULL AND doc_ix IS NOT NULL
    AND hit_no IS NOT NULL AND word IS NOT NULL AND word_offset IS NOT NULL AND sentence IS NOT NULL
)"""


def first_span_cte() -> str:
    """After ``corpus_ctes``: wm_spanrows."""
    return f"""
wm_spanrows AS (SELECT DISTINCT * FROM (
  SELECT query_pos, query, doc_ix,
         lower(list_filter(regexp_split_to_array(spans[1].text, '\\s+'), lambda t: t <> '')[-1]) AS word,
         regexp_replace(list_filter(regexp_extract_all(texts, {q(RX_SENT)}), lambda s: contains(s, query))[1],
                        '^\\s+|\\s+$', '', 'g') AS sentence
  FROM wm_landed WHERE texts <> '')
WHERE word IS NOT NULL AND sentence IS NOT NULL)"""


# --- lexicons and the funnel ------------------------------------------------

TRIPLES = "|".join(c * 3 for c in "abcdefghijklmnopqrstuvwxyz")


def _azwords(expr: str) -> str:
    return f"list_filter(regexp_split_to_array(lower({expr}), '[^a-z]+'), lambda w: w <> '')"


def lexicon_ctes() -> str:
    """wm_wordlist(word), wm_convwords(word), wm_titles(title), wm_titlewords(word), wm_dict(word, source)."""
    return f"""
wm_wordlist AS (SELECT DISTINCT unnest({_azwords('text')}) AS word FROM benchmark),
wm_convwords AS (SELECT DISTINCT unnest({_azwords('text')}) AS word FROM conversations),
wm_titles AS (
  SELECT DISTINCT title FROM (
    SELECT regexp_extract(html, '(?is)<title[^>]*>(.*?)</title>', 1) AS title FROM pages) WHERE title <> ''),
wm_titlewords AS (SELECT DISTINCT unnest({_azwords('title')}) AS word FROM wm_titles),
wm_dict AS (
  SELECT DISTINCT unnest({_azwords('text')}) AS word,
         CASE role WHEN 'assistant' THEN 'collegiate' WHEN 'user' THEN 'medical' END AS source
  FROM conversations WHERE role IN ('assistant', 'user'))"""


def normalise_sql(c: str) -> str:
    lw = f"lower({c})"
    return (f"CASE WHEN length({lw}) - length(replace({lw}, '-', '')) <= 1 "
            f"AND regexp_full_match(replace({lw}, '-', ''), '[a-z]+') THEN replace({lw}, '-', '') END")


def shape_sql(c: str) -> str:
    return f"(length({c}) BETWEEN 4 AND 22 AND NOT regexp_matches({c}, '{TRIPLES}'))"


def bases_sql(c: str) -> str:
    cands = [c]
    for suffix, repl in MORPHY_RULES:
        cands.append(f"CASE WHEN ends_with({c}, {q(suffix)}) AND length({c}) > {len(suffix)} "
                     f"THEN left({c}, length({c}) - {len(suffix)}) || {q(repl)} END")
    return "[" + ", ".join(cands) + "]"


def near_sql(c: str, table: str) -> str:
    return f"EXISTS (SELECT 1 FROM {table} l WHERE levenshtein({c}, l.word) <= 1)"


def funnel_ctes(phrases: list[str] = STANDIN_PHRASES, older: bool = False, arc_ok: str | None = None) -> str:
    """After extraction + lexicons: wm_pre, wm_w, wm_v1..wm_v4, wm_verdict, wm_audit, wm_final."""
    word = ("CASE WHEN regexp_full_match(word, '[a-zA-Z]+') THEN lower(word) END" if older
            else normalise_sql("word"))
    enc = ("EXISTS (SELECT 1 FROM wm_titles t WHERE contains(lower(t.title), v.word))" if older
           else near_sql("v.word", "wm_titlewords"))
    rows = extraction_ctes(phrases)
    source, cols = "wm_total", "p.query_pos, p.query, p.idx, p.span_id, p.doc_ix, p.hit_no, p.word_offset, p.sentence, p.org"
    if older:
        rows, source = corpus_ctes(phrases) + "," + first_span_cte(), "wm_spanrows"
        cols = "p.query_pos, p.query, p.doc_ix, p.sentence, p.org"
    arcs = f"WHEN v.v IS DISTINCT FROM 'words' AND NOT ({arc_ok}) THEN 'arcs'" if arc_ok else ""
    tail = "" if older else """,
wm_final AS (SELECT * FROM wm_audit WHERE removed_by IS NULL),
wm_first AS (
  SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY word ORDER BY query_pos, idx) AS rn FROM wm_final)
  WHERE rn = 1)"""
    return rows + "," + lexicon_ctes() + f""",
wm_pre AS (SELECT *, word AS org, {word} AS nword FROM {source}),
wm_w AS (SELECT DISTINCT nword AS word FROM wm_pre WHERE nword IS NOT NULL AND {shape_sql('nword')}),
wm_v1 AS (
  SELECT word, (word IN (SELECT word FROM wm_wordlist)
                OR EXISTS (SELECT 1 FROM wm_wordlist l WHERE list_contains({bases_sql('w.word')}, l.word))) AS f_words
  FROM wm_w w),
wm_v2 AS (SELECT word, {near_sql('v.word', 'wm_wordlist')} AS f_spell FROM wm_v1 v WHERE NOT f_words),
wm_v3 AS (SELECT word, {enc} AS f_enc FROM wm_v2 v WHERE NOT f_spell),
wm_v4 AS (
  SELECT word, (SELECT d.source FROM wm_dict d WHERE d.word = v.word
                ORDER BY CASE d.source WHEN 'collegiate' THEN 1 ELSE 2 END LIMIT 1) AS dsrc
  FROM wm_v3 v WHERE NOT f_enc),
wm_verdict AS (
  SELECT word, 'words' AS v FROM wm_v1 WHERE f_words
  UNION ALL SELECT word, 'spell:benchmark' FROM wm_v2 WHERE f_spell
  UNION ALL SELECT word, 'encyclopedia' FROM wm_v3 WHERE f_enc
  UNION ALL SELECT word, 'dictionary:' || dsrc FROM wm_v4 WHERE dsrc IS NOT NULL),
wm_audit AS (
  SELECT {cols},
         p.nword AS word,
         CASE WHEN p.nword IS NULL THEN 'normalise'
              WHEN NOT {shape_sql('p.nword')} THEN 'words'
              {arcs}
              ELSE v.v END AS removed_by
  FROM wm_pre p LEFT JOIN wm_verdict v ON p.nword = v.word)""" + tail


def frequency_ctes(phrases: list[str] = STANDIN_PHRASES) -> str:
    """After the funnel: wm_collected, wm_forms, wm_tokcounts, wm_corpusfreq."""
    return funnel_ctes(phrases) + f""",
wm_collected AS (
  SELECT f.word, n.count, f.query_pos, f.idx, f.span_id, f.doc_ix, f.org
  FROM wm_first f JOIN (SELECT word, count(*)::BIGINT AS count FROM wm_final GROUP BY word) n
    ON f.word = n.word),
wm_forms AS (
  SELECT DISTINCT word, query_pos, idx, span_id, doc_ix, unnest(list_distinct(list_filter(
    [word, upper(left(word, 1)) || lower(substr(word, 2)), org], lambda f: f IS NOT NULL))) AS form
  FROM wm_collected),
wm_tokcounts AS (
  SELECT form, count(*)::BIGINT AS cnt FROM (
    SELECT regexp_replace(t, {q(RX_EDGE)}, '', 'g') AS form
    FROM (SELECT unnest(regexp_split_to_array(text, '\\s+')) AS t FROM documents))
  WHERE form IN (SELECT form FROM wm_forms) GROUP BY form),
wm_corpusfreq AS (
  SELECT f.word, f.query_pos, f.idx, f.span_id, f.doc_ix, sum(coalesce(c.cnt, 0))::BIGINT AS count
  FROM wm_forms f LEFT JOIN wm_tokcounts c ON f.form = c.form
  GROUP BY f.word, f.query_pos, f.idx, f.span_id, f.doc_ix)"""
