"""Registered queries of this subpackage: op1 .. op13."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from wordmine.llm import align, bpe, jaccard, katz, langid, neardup_vectors, packing, pii, prefixtrie, quality, tokenfiles, topk, urlfilter
from wordmine.llm import oracle as sql
from wordmine.llm.common import held_out, shared_uri, table, vocabulary
from wordmine.llm.vectors import usable_vectors


def _pattern() -> str:
    import public_tokenizers

    return public_tokenizers.PATTERN


def op1_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard.linked_groups(table(spark, sf_dir, "documents"), p=9, q=10, words_each=3)


def byte_bpe_digests(docs: DataFrame, folder: str) -> DataFrame:
    ranks, pattern = vocabulary("byte_bpe_50k.tiktoken"), _pattern()
    decoded = bpe.decode_documents(bpe.encode_documents(docs, folder, ranks, pattern), ranks, digest="ids_sha256")
    return decoded.select("doc_id", "n_tokens", "ids_sha256", F.sha2("decoded", 256).alias("decoded_sha256"))


def op2_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return byte_bpe_digests(table(spark, sf_dir, "documents"), shared_uri(spark, "bpe-blocks"))


def op3_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    found = langid.identify(docs, langid.train(docs, ~held_out()))
    return found.select("doc_id", held_out().alias("held_out"), "lang_pred", "score", "ambiguous")


def op4_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = usable_vectors(table(spark, sf_dir, "embeddings"))
    return topk.top_inner_products(vectors, "vec_id % 50 = 0", k=5, scale=256.0)


def op6_katz(spark: SparkSession, sf_dir: str) -> DataFrame:
    scored = katz.score_documents(table(spark, sf_dir, "documents"), ~held_out(fold=1), shared_uri(spark, "lm"))
    return scored.select("doc_id", held_out(fold=1).alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score")


def op7_embedding_neardup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neardup_vectors.near_duplicates(table(spark, sf_dir, "embeddings"), threshold=0.95)


def op5_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = shared_uri(spark, "token-files")
    tokenfiles.write_token_files(table(spark, sf_dir, "documents"), folder, vocabulary("word_bpe_49k.json"))
    return tokenfiles.read_token_files(spark, folder).select("doc_id", "start", "n_tokens", F.crc32("ids").alias("ids_crc32"))


def op8_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = pii.find_spans(table(spark, sf_dir, "documents"))
    counts = [F.size(F.filter("spans", pii.of_kind(k))).cast("bigint").alias(f"n_{k}") for k in pii.KINDS]
    return found.select("doc_id", *counts, F.sha2(pii.spans_text(F.col("spans")), 256).alias("base_sha256"),
                        pii.spans_text(F.concat("spans", "added")).alias("spans"))


def op9_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    pieces = packing.pack_documents(table(spark, sf_dir, "documents"), vocabulary("byte_bpe_50k.json"), _pattern())
    return pieces.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")


def op10_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = quality.train(docs, table(spark, sf_dir, "labels"), ~held_out())
    scored = quality.score(docs, model)
    return scored.select("doc_id", held_out().alias("held_out"), "score", (F.col("score") >= 0.3).cast("int").alias("predicted"))


def op11_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prefixtrie.prefix_trie(table(spark, sf_dir, "conversations"))


URL_RULES = [("allow", "org", "/"), ("block", "example.org", "/es/"), ("block", "example.org", "/en/1"), ("allow", "com", "/fr/"),
             ("block", "com", "/de/")]


def op12_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    weights = urlfilter.train(urlfilter.url_table(spark, urlfilter.labelled_urls()))
    return urlfilter.judge(table(spark, sf_dir, "pages"), URL_RULES, weights).drop("chance")


def op13_token_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    return align.align_documents(table(spark, sf_dir, "documents"), shared_uri(spark, "alignment"), vocabulary("byte_bpe_50k.json"),
                                 _pattern(), vocabulary("piece_bpe_32k.model"))


QUERIES = {
    "op1_jaccard_join": op1_jaccard_join,
    "op2_byte_bpe": op2_byte_bpe,
    "op3_language": op3_language,
    "op4_top_k": op4_top_k,
    "op5_token_files": op5_token_files,
    "op6_katz": op6_katz,
    "op7_embedding_neardup": op7_embedding_neardup,
    "op8_pii": op8_pii,
    "op9_packing": op9_packing,
    "op10_quality": op10_quality,
    "op11_prefix_trie": op11_prefix_trie,
    "op12_url_filter": op12_url_filter,
    "op13_token_alignment": op13_token_alignment,
}

_USABLE = """embedding IS NOT NULL AND len(embedding) > 0 AND vec_id IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0"""

ORACLES: dict[str, str] = {
    "op11_prefix_trie": sql.PREFIX_TRIE,
    "op12_url_filter": sql.url_filter(URL_RULES, urlfilter.labelled_urls()),
    "op1_jaccard_join": """
WITH RECURSIVE w AS (SELECT doc_id, list_filter(regexp_split_to_array(
        translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\\x20\\x09-\\x0D]+'), lambda x: x <> '') AS t FROM documents),
s AS (SELECT DISTINCT doc_id, unnest(CASE WHEN len(t) >= 3
        THEN list_transform(range(1, len(t) - 1), lambda i: t[i] || ' ' || t[i + 1] || ' ' || t[i + 2])
        WHEN len(t) > 0 THEN [array_to_string(t, ' ')] ELSE [] END) AS g FROM w),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
b AS (SELECT x.doc_id AS i, y.doc_id AS j, count(*) AS c FROM s x JOIN s y ON x.g = y.g AND x.doc_id <> y.doc_id GROUP BY ALL),
l AS (SELECT i, j FROM b JOIN n p ON p.doc_id = i JOIN n q ON q.doc_id = j WHERE 100 * c >= 90 * (p.n + q.n - c)),
reach AS (SELECT doc_id AS i, doc_id AS j FROM documents UNION SELECT r.i, l.j FROM reach r JOIN l ON r.j = l.i),
m AS (SELECT i, min(j) AS component_id FROM reach GROUP BY i)
SELECT d.doc_id, coalesce(n.n, 0) AS n_shingles, m.component_id
FROM documents d JOIN m ON m.i = d.doc_id LEFT JOIN n ON n.doc_id = d.doc_id""",
    "op4_top_k": f"""
WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS e FROM embeddings WHERE {_USABLE}),
s AS (SELECT q.vec_id AS query_id, c.vec_id, CAST(list_dot_product(q.e, c.e) AS BIGINT) AS score
      FROM v q JOIN v c ON q.vec_id <> c.vec_id WHERE q.vec_id % 50 = 0),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS n FROM s)
SELECT query_id, CAST(n AS INTEGER) AS rank, vec_id, score FROM r WHERE n <= 5""",
    "op7_embedding_neardup": f"""
WITH RECURSIVE v AS (SELECT vec_id, list_transform(embedding, lambda x: x::DOUBLE) AS e FROM embeddings
      WHERE {_USABLE} AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
l AS (SELECT a.vec_id AS i, b.vec_id AS j FROM v a JOIN v b ON a.vec_id <> b.vec_id
      WHERE list_cosine_similarity(a.e, b.e) >= 0.95),
reach AS (SELECT vec_id AS i, vec_id AS j FROM embeddings UNION SELECT r.i, l.j FROM reach r JOIN l ON r.j = l.i),
c AS (SELECT i, min(j) AS component_id FROM reach GROUP BY i),
d AS (SELECT i, count(*) AS n FROM l GROUP BY i)
SELECT c.i AS vec_id, coalesce(d.n, 0) AS n_links, c.component_id, c.i = c.component_id AS kept
FROM c LEFT JOIN d ON c.i = d.i""",
}
