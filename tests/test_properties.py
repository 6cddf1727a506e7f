"""Column expressions against plain Python statements of the same rules (hypothesis)."""

import re

from hypothesis import given, settings
from hypothesis import strategies as st

from wordmine.functions.text import clean_text, edge_strip, normalise_word
from wordmine.operators.fuzzy import deletion_keys
from wordmine.operators.normalize import shape_ok

ALPHA = "abcAB-'é1 .z"
words = st.lists(st.text(alphabet=ALPHA, min_size=0, max_size=12), min_size=1, max_size=40)


def py_edge(w):
    return re.sub(r"^[^a-zA-Z]+|[^a-zA-Z]+$", "", w)


def py_norm(w):
    w = w.lower()
    if w.count("-") > 1:
        return None
    c = w.replace("-", "")
    return c if re.fullmatch(r"[a-z]+", c) else None


def py_shape(w):
    return 4 <= len(w) <= 22 and not re.search(r"(.)\1{2,}", w)


@settings(max_examples=5, deadline=None)
@given(words)
def test_text_functions_match_python(spark, ws):
    df = spark.createDataFrame([(w,) for w in ws], "w string")
    got = df.select("w", edge_strip("w").alias("e"), normalise_word("w").alias("n"),
                    clean_text("w").alias("c"), shape_ok("w").alias("s")).collect()
    for r in got:
        assert r.e == py_edge(r.w)
        assert r.n == py_norm(r.w)
        assert r.c == re.sub(r"[^a-z]", "", r.w.lower())
        assert r.s == py_shape(r.w)


@settings(max_examples=5, deadline=None)
@given(st.lists(st.text(alphabet="abc", min_size=0, max_size=7), min_size=1, max_size=20))
def test_deletion_keys_match_python(spark, ws):
    df = spark.createDataFrame([(w,) for w in ws], "w string")
    for r in df.select("w", deletion_keys("w").alias("k")).collect():
        expect = {r.w} | {r.w[:i] + r.w[i + 1:] for i in range(len(r.w))}
        assert set(r.k) == expect
