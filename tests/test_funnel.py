"""Normalisation and the filter funnel (C1-C24), rows from FIXTURES.md section 3."""

import itertools

from wordmine.functions.text import clean_text, normalise_word
from wordmine.operators import fuzzy, lexicon
from wordmine.operators.arcs import arc_keep, arc_pattern, rule_arcs
from wordmine.operators.audit import STAGES, keep_first, stage_audit
from wordmine.operators.normalize import shape_ok


def _col(spark, values, name="word"):
    return spark.createDataFrame([(v,) for v in values], f"{name} string")


def test_normalise(spark):
    src = ["E-mail", "Wug", "a-b-c", "it's", "wug2", "-", "naïve", "null"]
    got = dict((r.w, r.n) for r in _col(spark, src, "w").select("w", normalise_word("w").alias("n")).collect())
    assert got == {"E-mail": "email", "Wug": "wug", "a-b-c": None, "it's": None, "wug2": None,
                   "-": None, "naïve": None, "null": "null"}


def test_shape(spark):
    src = ["wug", "wugs", "a" * 0 + "abcdefghijklmnopqrstuv", "abcdefghijklmnopqrstuvw", "hmmm", "hmmer"]
    got = {r.word: r.ok for r in _col(spark, src).select("word", shape_ok("word").alias("ok")).collect()}
    assert got == {"wug": False, "wugs": True, "abcdefghijklmnopqrstuv": True,
                   "abcdefghijklmnopqrstuvw": False, "hmmm": False, "hmmer": True}


def test_clean_text(spark):
    df = spark.createDataFrame([("Ab-C 12d!",), (None,)], "t string")
    assert [r.c for r in df.select(clean_text("t").alias("c")).collect()] == ["abcd", ""]


def test_word_list_and_base_forms(spark):
    # the list is case-sensitive; base forms come from suffix rules only
    # ("running" -> "run" needs the lemma table, see test_lemma_table)
    words = _col(spark, ["aaron", "table", "tables", "running", "wugs"])
    lex = spark.createDataFrame([("Aaron",), ("table",), ("run",)], "word string")
    v = lexicon.base_in_lexicon(lexicon.in_lexicon(words, lex, "f_list"), lex, "f_base")
    got = {r.word: (r.f_list, r.f_base) for r in v.collect()}
    assert got == {"aaron": (False, False), "table": (True, True), "tables": (False, True),
                   "running": (False, False), "wugs": (False, False)}


def test_lemma_table(spark):
    rows = _col(spark, ["aaron", "table", "running", "wugs"])
    lem = lexicon.read_lemma_lexicon(spark.createDataFrame(
        [("running", "run", "V"), ("Table", "table", "N"), (None, "x", "N")], "word string, lemma string, features string"))
    got = sorted(r.word for r in lexicon.lemma_exclude(rows, lem).collect())
    assert got == ["aaron", "wugs"]


def test_typo_stage(spark):
    words = _col(spark, ["kitten", "kiten", "kittten", "kitton", "from", "zzyzx"])
    lex = _col(spark, ["kitten", "form"])
    got = {r.word: r.f for r in fuzzy.near_flag(words, lex, "f").collect()}
    assert got == {"kitten": True, "kiten": True, "kittten": True, "kitton": True, "from": False, "zzyzx": False}


def test_neighbourhood_join_equals_brute_force(spark):
    alpha = "abc"
    words = ["".join(p) for n in range(1, 4) for p in itertools.product(alpha, repeat=n)]
    lex = words[::3]

    def lev(a, b):
        d = list(range(len(b) + 1))
        for i, ca in enumerate(a, 1):
            prev, d[0] = d[0], i
            for j, cb in enumerate(b, 1):
                prev, d[j] = d[j], min(d[j] + 1, d[j - 1] + 1, prev + (ca != cb))
        return d[-1]

    expect = {(w, e) for w in words for e in lex if lev(w, e) <= 1}
    got = {(r._w, r._e) for r in fuzzy.near_pairs(_col(spark, words), _col(spark, lex)).collect()}
    assert got == expect


def test_checker_cascade_first_checker_wins(spark):
    words = _col(spark, ["kiten", "dax", "zzyzx"])
    a = _col(spark, ["kitten"])
    b = _col(spark, ["kitten", "dux"])
    got = {r.word: r.spell_checker for r in fuzzy.checker_cascade(words, [("a", a), ("b", b)]).collect()}
    assert got == {"kiten": "a", "dax": "b", "zzyzx": None}


def test_titles_near_exact_and_contains(spark):
    words = _col(spark, ["kittem", "kitten", "wugs"])
    titles = spark.createDataFrame([("Kitten",), ("Wugs Test",)], "title string")
    tw = titles.select(__import__("pyspark.sql.functions", fromlist=["x"]).explode(
        __import__("wordmine.functions.text", fromlist=["x"]).lexicon_words("title")).alias("word"))
    near = {r.word: r.f for r in fuzzy.near_flag(words, tw, "f").collect()}
    assert near == {"kittem": True, "kitten": True, "wugs": True}
    sub = {r.word: r.f for r in fuzzy.title_contains_flag(_col(spark, ["itte", "wugst", "test"]), titles, "f").collect()}
    assert sub == {"itte": True, "wugst": False, "test": True}


def test_dictionary_first_source_and_responses(spark):
    resp = spark.createDataFrame([
        ("alpha", "collegiate", 200, '[{"meta":{}}]'),
        ("beta", "collegiate", 200, '["kit","kin"]'),
        ("gamma", "collegiate", 200, "[]"),
        ("delta", "collegiate", 200, "{}"),
        ("eps", "collegiate", 200, "[{broken"),
        ("zeta", "collegiate", 500, '[{"meta":{}}]'),
        ("eta", "medical", 200, '[{"meta":{"id":"x"}}]'),
        ("alpha", "medical", 200, '[{"meta":{}}]'),
    ], "word string, api string, status int, body string")
    valid = lexicon.valid_responses(resp)
    words = _col(spark, ["alpha", "beta", "gamma", "delta", "eps", "zeta", "eta"])
    got = {r.word: r.dict_source for r in lexicon.dictionary_reason(words, valid).collect()}
    assert got == {"alpha": "collegiate", "beta": None, "gamma": None, "delta": None, "eps": None,
                   "zeta": None, "eta": "medical"}


def test_arc_table(spark):
    rows = spark.createDataFrame([(1, "is not a word"), (2, "is not a word"), (3, "is not a word"),
                                  (4, "is not a word"), (5, "is not a word")], "sent_id bigint, query string")
    # 1: wug is not a word (word attr, head is@1, no right child)        -> kept
    # 2: wug is a word for dax (right child 'for' of 'word')             -> not kept
    # 3: is a word (head 'is' at position 0)                              -> not kept
    # 4: wug was a word (head 'was')                                      -> not kept
    # 5: two matching tokens                                              -> kept once
    arcs = spark.createDataFrame([
        (1, 0, "wug", "nsubj", 1), (1, 1, "is", "ROOT", 1), (1, 2, "not", "neg", 1), (1, 3, "a", "det", 4),
        (1, 4, "word", "attr", 1),
        (2, 0, "wug", "nsubj", 1), (2, 1, "is", "ROOT", 1), (2, 2, "a", "det", 3), (2, 3, "word", "attr", 1),
        (2, 4, "for", "prep", 3), (2, 5, "dax", "pobj", 4),
        (3, 0, "is", "ROOT", 0), (3, 1, "a", "det", 2), (3, 2, "word", "attr", 0),
        (4, 0, "wug", "nsubj", 1), (4, 1, "was", "ROOT", 1), (4, 2, "a", "det", 3), (4, 3, "word", "attr", 1),
        (5, 0, "wug", "nsubj", 1), (5, 1, "is", "ROOT", 1), (5, 2, "word", "attr", 1), (5, 3, "word", "attr", 1),
    ], "sent_id bigint, i int, text string, dep string, head_i int")
    got = sorted(r.sent_id for r in arc_keep(rows, arcs).collect())
    assert got == [1, 5]


def test_arc_joins_broadcast_no_arcs(spark):
    """A token table is many times its sentences: its joins may not send it through the driver."""
    rows = spark.createDataFrame([(k, "is not a word", f"Token {k} is, as they say, a word.") for k in range(20)],
                                 "sent_id bigint, query string, sentence string")
    kept = arc_keep(rows, rule_arcs(rows.select("sent_id", "sentence")))
    assert "BroadcastHashJoin" not in kept._jdf.queryExecution().executedPlan().toString()
    assert sorted(r.sent_id for r in kept.collect()) == list(range(20))
    heads = {(r.i, r.text): (r.dep, r.head_i) for r in rule_arcs(spark.createDataFrame(
        [(1, "Is it so? It IS what is. --")], "sent_id bigint, sentence string")).collect()}
    assert heads == {(0, "Is"): ("dep", -1), (1, "it"): ("attr", 0), (2, "so"): ("attr", 0), (3, "It"): ("attr", 0),
                     (4, "IS"): ("attr", 0), (5, "what"): ("attr", 4), (6, "is"): ("attr", 4), (7, ""): ("attr", 6)}


def test_arc_pattern(spark):
    df = spark.createDataFrame([("wug is not a word.", "is not a word"), ("wug is a word for dax", "is not a word"),
                                ("is a word", "is not a word"), ("wug was a word", "is not a word")],
                               "sentence string, query string")
    got = [r.k for r in df.select(arc_pattern(["is not a word"]).alias("k")).collect()]
    assert got == [True, False, False, False]


def test_keep_first_and_audit(spark):
    rows = spark.createDataFrame([
        ("wug", 1, 0, "late", None), ("wug", 0, 5, "early", None), ("dax", 0, 1, "d", "spell:x"),
        ("bad", 0, 2, "b", "normalise"), ("zz", 0, 3, "z", "words"), ("qq", 2, 0, "q", "dictionary:medical"),
    ], "word string, query_pos bigint, idx bigint, sentence string, removed_by string")
    first = {r.word: r.sentence for r in keep_first(rows.where("removed_by IS NULL"), "word",
                                                      ["query_pos", "idx"], ["word", "sentence"]).collect()}
    assert first == {"wug": "early"}
    audit = sorted(stage_audit(rows).collect(), key=lambda r: r.stage_pos)
    assert [r.stage for r in audit] == STAGES
    for a, b in zip(audit, audit[1:]):
        assert a.n_kept == b.n_in and a.n_in == a.n_kept + a.n_removed
    assert audit[0].n_in == 6 and audit[-1].n_kept == 2
