"""Frequency, bookkeeping, search, ids, streaming, segmentation, the driver contract."""

from pyspark.sql import functions as F

from wordmine.operators import collect, frequency, search, segment
from wordmine.operators.ids import dense_index
from wordmine.session import fresh_path


def test_corpus_frequency_over_surface_forms(spark):
    final = spark.createDataFrame([("email", "E-mail", 0, 0, 0, 1), ("wugs", "wugs", 0, 1, 1, 2),
                                   ("zork", "zork", 0, 2, 2, 3)],
                                  "word string, org string, query_pos bigint, idx bigint, span_id bigint, doc_ix bigint")
    corpus = spark.createDataFrame([(1, "email email Email (E-mail), E-mail E-mail E-mail. " + "EMAIL " * 9),
                                    (2, "wugs wugs")], "doc_ix bigint, text string")
    col = frequency.collected_frequency(final)
    got = {r.word: r["count"] for r in frequency.corpus_frequency(col, corpus).collect()}
    assert got == {"email": 7, "wugs": 2, "zork": 0}


def test_stripped_tokens_match_split_and_strip(spark):
    text = "  (E-mail), --  x1y 123 a.b. ¡hola! end.\nnext\tline "
    import re
    expect = [t for t in (re.sub(r"^[^a-zA-Z]+|[^a-zA-Z]+$", "", t) for t in text.split()) if t]
    df = spark.createDataFrame([(text,)], "text string")
    got = [r.form for r in frequency.corpus_tokens(df).collect()]
    assert got == expect


def test_tokens_are_cut_without_a_regex_per_text(spark):
    """Only a token that does not begin and end with a letter meets the stripping expression."""
    import re
    texts = ["", None, "  ", "a", "é", "aé b", "ab\u2028 .c\x85", "\xa0x\xa0 y\x1cz", "-" * 1000 + "a" + "-" * 1000 + "a.", "\r\n(Ab-c)\x0bD", "1 2b 3c4"]
    ws = r"[ \t\n\x0b\f\r]+"
    expect = [f for t in texts for f in (re.sub(r"^[^a-zA-Z]+|[^a-zA-Z]+\Z", "", x) for x in re.split(ws, t or "")) if f]
    toks = frequency.corpus_tokens(spark.createDataFrame([(t,) for t in texts], "text string"))
    assert sorted(r.form for r in toks.collect()) == sorted(expect)
    assert "regexp_extract_all" not in toks._jdf.queryExecution().optimizedPlan().toString()


def test_worklist_ledger_and_split(spark):
    wl = spark.createDataFrame([("a", "o"), ("b", "x"), ("c", None)], "expression string, status string")
    assert sorted(r.expression for r in collect.pending_worklist(wl).collect()) == ["b", "c"]
    req = spark.createDataFrame([("p", "0", r) for r in range(3, 6)] + [("p", "1", r) for r in range(0, 2)],
                                "query string, shard string, rank bigint")
    got = spark.createDataFrame([("p", "0", 3), ("p", "0", 5), ("p", "1", 0)], "query string, shard string, rank bigint")
    miss = sorted((r.shard, r.rank) for r in search.missing_ranks(req, got).collect())
    assert miss == [("0", 4), ("1", 1)] and req.count() == 5
    docs = spark.createDataFrame([("p", "s", i, i) for i in range(7)], "query string, shard string, rank bigint, doc_ix bigint")
    man = sorted((r.start, r["end"], r.n) for r in collect.split_manifest(docs, 3).collect())
    assert man == [(0, 2, 3), (3, 5, 3), (6, 6, 1)]


def test_dense_index_independent_of_partitions(spark):
    df = spark.range(0, 500).select((F.col("id") % 3).alias("g"), (F.col("id") * 7 % 500).alias("k"))
    base = None
    for n in (1, 4, 13):
        got = sorted(tuple(r) for r in dense_index(df, ["g"], ["k"], "rn", num_partitions=n).collect())
        if base is None:
            base = got
        assert got == base
    per_g = {}
    for g, k, rn in base:
        per_g.setdefault(g, []).append((k, rn))
    for g, items in per_g.items():
        assert [rn for _, rn in sorted(items)] == list(range(len(items)))


def test_phrase_hits_windows_and_punctuation(spark):
    corpus = spark.createDataFrame([(1, "So wug is not a word. And dax is not a word, truly.", "s", "{}"),
                                    (2, "nothing here", "s", "{}")],
                                   "doc_ix bigint, text string, shard string, metadata string")
    occ = search.landed_documents(corpus, ["is not a word"], max_disp_len=4).orderBy("pos").collect()
    assert [(r.doc_ix, r.pos, r.rank) for r in occ] == [(1, 3, 0), (1, 9, 1)]
    spans = [(s.text, s.label) for s in occ[0].spans]
    assert spans == [("So wug", None), ("is not a word.", "0"), ("And dax", None)]


def _hits(spark, text, phrases):
    corpus = spark.createDataFrame([(1, text, "s", "{}")], "doc_ix bigint, text string, shard string, metadata string")
    return sorted((r.query_pos, r.query, tuple(r.hits)) for r in search.phrase_hits(corpus, phrases).collect())


def test_phrases_in_lists_of_any_length(spark):
    text = "A wug is the b. wug Of  the, c un café! top 40. is the the the"
    few = ["is the", "of the", "un café", "top 40", "the the", "wug", "is the"]
    want = [(0, "is the", (3, 14)), (1, "of the", (7,)), (2, "un café", (10,)), (3, "top 40", (12,)),
            (4, "the the", (15,)), (5, "wug", (2, 6)), (6, "is the", (3, 14))]
    assert _hits(spark, text, few) == want
    assert _hits(spark, text, ["is the"]) == want[:1]
    assert _hits(spark, text, [*few, *(f"nothing like {i}" for i in range(300))]) == want


def test_many_hits_in_one_document(spark):
    n = 20_000
    corpus = spark.createDataFrame([(1, "x is the " * n, None, "{}"), (2, "y is the end", None, "{}")],
                                   "doc_ix bigint, text string, shard string, metadata string")
    got = search.landed_documents(corpus, ["is the"])
    assert got.count() == n + 1
    # all windows in the middle are alike: the first one counts
    assert got.where("doc_ix = 1 AND NOT repeat").count() < 250
    assert sorted(r["rank"] for r in got.select("rank").collect()) == list(range(n + 1))
    levels = {(r.level, r.occurrences) for r in search.shard_counts(corpus, ["is the"]).collect()}
    assert levels == {("shard", n + 1), ("phrase", n + 1), ("all", n + 1)}


def test_window_hits_match_their_definition(spark):
    import random
    rnd = random.Random(2)
    words = [rnd.choice(["the", "is", "a", "b", "c."]) for _ in range(3000)]
    corpus = spark.createDataFrame([(1, " ".join(words), "s", "{}")], "doc_ix bigint, text string, shard string, metadata string")
    hits = [i for i in range(len(words) - 1) if words[i:i + 2] == ["is", "the"]]
    for r in search.landed_documents(corpus, ["is the"], max_disp_len=60).collect():
        at = r.pos - 1
        lo, hi = max(0, at - 30), min(len(words), at + 2 + 30)
        inside = [h for h in hits if h >= lo and h + 2 <= hi]
        assert [s.text for s in r.spans if s.label == "0"] == ["is the"] * len(inside)
        assert " ".join(" ".join(s.text for s in r.spans).split()) == " ".join(words[lo:hi])


def test_streaming_equals_batch(spark):
    ev = spark.createDataFrame([("q", d, "s", r, 1) for r, d in enumerate([1, 2, 1, 3, 2, 2])],
                               "query string, doc_ix bigint, shard string, rank bigint, pos bigint")
    from wordmine.streaming.collect import unique_stream
    src, sink, ck = (fresh_path(spark, n) for n in ("t-src", "t-sink", "t-ck"))
    ev.repartition(3).write.json(src)
    out = unique_stream(spark, src, sink, ck)
    assert sorted(r.doc_ix for r in out.collect()) == [1, 2, 3]


def test_segmentation_pieces_concatenate(spark):
    w = spark.createDataFrame([("wugging", 3), ("dax", 1), ("wugs", 2)], "word string, n bigint")
    seg = segment.beam_segment(w, segment.unigram_stats(w), segment.bigram_stats(w)).collect()
    assert {r.word for r in seg} == {"wugging", "dax", "wugs"}
    for r in seg:
        assert "".join(r.pieces) == r.word and all(1 <= len(p) <= 6 for p in r.pieces)


def test_entry_contract(spark):
    import __spark_entry__ as e
    df = e.entry(spark)
    assert df.count() >= 0 and len(df.columns) > 0
    qs, sql = e.queries(), e.oracle_sql()
    assert set(sql) <= set(qs)
    from wordmine.plans import registry
    assert set(registry.QUERIES) == set(registry.ORACLES)


def test_bucketed_index_with_a_hot_group(spark):
    """One group holds ~90% of the rows and buckets are uneven: ids equal a plain
    row_number, whatever the physical partitioning."""
    from pyspark.sql import Window
    from wordmine.operators.ids import bucket_of, dense_index_bucketed, key_boundaries
    df = spark.range(0, 2000).select(
        F.when(F.col("id") % 10 == 0, "cold").otherwise("hot").alias("g"),
        (F.col("id") * 37 % 2000).alias("k"))
    cuts = key_boundaries(df, ["k"], 7)
    b = df.withColumn("bucket", bucket_of(["k"], cuts))
    expect = sorted(tuple(r) for r in df.select(
        "g", "k", (F.row_number().over(Window.partitionBy("g").orderBy("k")) - 1).alias("rn")).collect())
    for parts, store in ((1, True), (5, True), (5, False)):
        got = dense_index_bucketed(b.repartition(parts), ["g"], ["k"], "rn", store=store).select("g", "k", "rn")
        assert sorted(tuple(r) for r in got.collect()) == expect
    assert b.select("bucket").distinct().count() > 3


def test_dense_index_on_rows_beyond_the_range_sample(spark):
    """Enough wide rows that a range sampler does not see them all: still a plain row_number."""
    n = 300_000
    df = spark.range(n).select(F.when(F.col("id") % 10 < 3, "hot").otherwise(F.concat(F.lit("g"), F.col("id") % 7)).alias("g"),
                               (F.col("id") * 7919 % n).alias("k"), F.repeat(F.lit("payload"), 5).alias("payload"))
    from pyspark.sql import Window
    want = df.select("g", "k", (F.row_number().over(Window.partitionBy("g").orderBy("k")) - 1).cast("bigint").alias("rn"))
    for parts in (2, 8):
        got = dense_index(df, ["g"], ["k"], "rn", num_partitions=parts).select("g", "k", "rn")
        assert got.count() == n and got.exceptAll(want).count() == 0


def test_bucket_binary_search_equals_bisect(spark):
    import bisect
    import random
    from wordmine.operators.ids import bucket_of
    rnd = random.Random(3)
    for ncuts in (1, 2, 7, 100):
        cuts = sorted({(rnd.choice("abcd"), rnd.randint(0, 1000)) for _ in range(ncuts * 2)})[:ncuts]
        keys = [(rnd.choice("abcde"), rnd.randint(-5, 1005)) for _ in range(200)] + cuts
        df = spark.createDataFrame(keys, "shard string, doc_ix bigint")
        for r in df.select("shard", "doc_ix", bucket_of(["shard", "doc_ix"], cuts).alias("b")).collect():
            assert r.b == bisect.bisect_right(cuts, (r.shard, r.doc_ix))


def test_mine_end_to_end_on_driver_tables(spark):
    from conftest import SF_SMALL
    from wordmine import Lexicons, mine
    from wordmine.constants import STANDIN_PHRASES
    from wordmine.sources import tables
    wl = tables.word_list(spark, SF_SMALL)
    lx = Lexicons(word_list=wl, base_list=wl, checkers=[("benchmark", wl)],
                  titles=tables.title_words(spark, SF_SMALL), dictionary=tables.dictionary_entries(spark, SF_SMALL))
    out = mine(tables.documents_corpus(spark, SF_SMALL), lx, phrases=STANDIN_PHRASES)
    audit = sorted(out["stage_audit"].collect(), key=lambda r: r.stage_pos)
    n_total = out["total"].count()
    assert audit[0].n_in == n_total > 0
    assert audit[-1].n_kept == out["final"].count()
    card = out["cardinality"].first()
    assert card.n_words == out["final_dedup"].count() == out["collected_frequency"].count()
    from wordmine.operators.arcs import rule_arcs
    from wordmine.plans.funnel import with_sentence_id
    arcs = rule_arcs(with_sentence_id(out["total"]).select("sent_id", "sentence"))
    with_arcs = mine(tables.documents_corpus(spark, SF_SMALL), lx, phrases=STANDIN_PHRASES, arcs=arcs)
    stages = {r.stage: r for r in with_arcs["stage_audit"].collect()}
    assert stages["arcs"].n_removed > 0 and stages["arcs"].n_in - stages["arcs"].n_removed == stages["arcs"].n_kept
