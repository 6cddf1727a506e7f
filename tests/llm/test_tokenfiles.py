import zlib

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st

from wordmine.llm import simple8b, tokenfiles
from wordmine.llm.common import vocabulary
from wordmine.llm.queries import QUERIES

SF = "/root/testdata/sf0.001"


@settings(max_examples=150, deadline=None)
@given(st.lists(st.one_of(st.integers(0, 3), st.integers(0, 50000), st.integers(0, 2**60 + 5), st.integers(2**63, 2**64 - 1), st.just(0)), max_size=400))
def test_round_trip(values):
    v = np.array(values, np.uint64)
    for block in (7, 64, 512):
        words, offsets = simple8b.encode(v, block)
        assert simple8b.decode(words, offsets, len(v), block).tolist() == values


def test_size_of_small_ids():
    words, _ = simple8b.encode(np.arange(4096) % 32)
    assert len(words) <= 4096 / 12 + 8


def greedy(values, block):
    """The words' (start, selector) by the plainest loop."""
    out, n = [], len(values)
    for begin in range(0, n, block):
        at, end = begin, min(begin + block, n)
        while at < end:
            fit = [s for s in range(1, 15) if all(v < 1 << int(simple8b.BITS[s]) for v in values[at:min(at + int(simple8b.COUNTS[s]), end)])]
            out.append((at, fit[0] if fit else 0))
            at += max(1, int(simple8b.COUNTS[out[-1][1]]))
    return out


@settings(max_examples=100, deadline=None)
@given(st.lists(st.one_of(st.integers(0, 3), st.integers(0, 50000), st.integers(0, 2**64 - 1), st.just(0)), min_size=1, max_size=300))
def test_selectors_are_those_of_the_greedy_coder(values):
    for block in (7, 64, 512):
        found = simple8b._selectors(np.array(values, np.uint64), block)
        assert all(found[at] == s for at, s in greedy(values, block))


def test_pieces_of_plain_words(monkeypatch):
    """Letters, or letters and a mark, need no regular expression; every id is the library's."""
    import pyarrow as pa
    from wordmine.llm import textcells as T

    encoder = T.WordBpe(vocabulary("word_bpe_49k.json"))
    odd = ["don't", "'s", "'S.", "a.b", "..", ".", "x1", "12.", "²,", "(où)", "İx", "İ.", "it's!", "ªb", "ŉ", "straße,", "Éa?", "it'll", "a-b:"]
    plain = ["Wort", "Éçole", "end.", "où,", "ſo;", "Why?", "no!", "A:"]
    ids, offsets = encoder.encode_texts(pa.array([*odd, " ".join([*odd, *plain, *odd])]))
    for i, text in enumerate([*odd, " ".join([*odd, *plain, *odd])]):
        assert ids[offsets[i]:offsets[i + 1]].tolist() == library().encode(text, add_special_tokens=False).ids
    encoder.forget()

    def refuse(*_):
        raise AssertionError("a regular expression ran over plain words")

    monkeypatch.setattr(T.pc, "replace_substring_regex", refuse)
    ids, _ = encoder.encode_texts(pa.array([" ".join(plain)]))
    assert ids.tolist() == library().encode(" ".join(plain), add_special_tokens=False).ids


def library():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(vocabulary("word_bpe_49k.json"))


def expect(rows):
    t, at, out = library(), 0, []
    for d, text in rows:
        ids = np.array([*t.encode(text or "", add_special_tokens=False).ids, 1], "<u4")
        out.append((d, at, len(ids), zlib.crc32(ids.tobytes())))
        at += len(ids)
    return out


def test_query_against_library(spark):
    docs = sorted((r["doc_id"], r["text"]) for r in spark.read.parquet(f"{SF}/documents.parquet").collect())
    got = sorted(tuple(r) for r in QUERIES["op5_token_files"](spark, SF).collect())
    assert got == expect(docs)


def test_edges(spark, tmp_path):
    from pyspark.sql import functions as F

    rows = [(None, "null id"), (1, ""), (2, None), (3, "Ünï ΣΑΣ 漢字 á " * 4000), (4, "x" * 9000), (7, "<|endoftext|> it's"), (8, "Say<|startoftext|>x <|ENDOFTEXT|> <| y"),
            (9, "<|endoftext|>")]
    docs = spark.createDataFrame([(*r, "f", 1) for r in rows], "doc_id bigint, text string, file string, ids int")
    for k, size in enumerate((1 << 21, 50)):
        folder = f"file://{tmp_path}/t{k}"
        files = tokenfiles.write_token_files(docs, folder, vocabulary("word_bpe_49k.json"), file_ids=size).collect()
        assert sum(f["documents"] for f in files) == len(rows)
        got = tokenfiles.read_token_files(spark, folder).withColumn("c", F.crc32("ids")).orderBy("start").collect()
        assert [(r["doc_id"], r["start"], r["n_tokens"], r["c"]) for r in got] == expect(rows)
    folder = f"file://{tmp_path}/none"
    assert tokenfiles.write_token_files(docs.limit(0), folder, vocabulary("word_bpe_49k.json")).count() == 0
    assert tokenfiles.read_token_files(spark, folder).count() == 0
