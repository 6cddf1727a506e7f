import zlib

import numpy as np
import pytest

from wordmine.llm import packing
from wordmine.llm.common import vocabulary
from wordmine.llm.queries import QUERIES, _pattern

SF = "/root/testdata/sf0.001"


def brute_cost(pos, pen, size):
    best = {0: 0.0}
    for p, c in zip(pos, pen):
        best[p] = min(best[q] + size - (p - q) + c for q in best if 0 < p - q <= size)
    return best[pos[-1]]


def test_cuts_are_cheapest():
    rng = np.random.default_rng(5)
    for _ in range(60):
        pos = np.unique(np.cumsum(rng.integers(1, 9, rng.integers(1, 60)))).tolist()
        pen = rng.integers(0, 6, len(pos)).astype(float).tolist()
        cuts = packing.choose_cuts(pos, pen, 16)
        cost, at = 0.0, 0
        for k in cuts:
            assert 0 < pos[k] - at <= 16
            cost += 16 - (pos[k] - at) + pen[k]
            at = pos[k]
        assert at == pos[-1] and cost == pytest.approx(brute_cost(pos, pen, 16))


def check(rows, texts_by_id, size):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(vocabulary("byte_bpe_50k.json"))
    by_doc, by_seq = {}, {}
    for r in rows:
        by_doc.setdefault(r["doc_id"], []).append(r)
        by_seq.setdefault(r["sequence_id"], []).append(r)
    assert set(by_doc) == set(texts_by_id)
    for d, text in texts_by_id.items():
        ids = np.array([*t.encode(text or "", add_special_tokens=False).ids, 1], "<u4")
        at = 0
        for r in sorted(by_doc[d], key=lambda r: r["start"]):
            assert r["start"] == at and r["doc_tokens"] == len(ids)
            assert r["ids_crc32"] == zlib.crc32(ids[at:at + r["length"]].tobytes())
            at += r["length"]
        assert at == len(ids)
    padding = 0
    for pieces in by_seq.values():
        at = 0
        for r in sorted(pieces, key=lambda r: r["offset"]):
            assert r["offset"] == at
            at += r["length"]
        assert 0 < at <= size
        padding += 0 if at & (at - 1) == 0 else size - at
    return padding / (size * len(by_seq))


def test_query_against_library(spark):
    docs = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    assert check(QUERIES["op9_packing"](spark, SF).collect(), docs, 2048) < 0.01


def test_edges(spark):
    from pyspark.sql import functions as F

    long = "word thble. " * 9000
    rows = [(1, "", "x", 5), (2, None, None, 1), (3, long, "s", 2), (4, "a\n\n  b", "t", 3), (5, "x" * 30000, "t", 3),
            (6, "one <|endoftext|> two<|endoftext|>", "t", 3), (7, "<|endoftext|>", "t", 3), (8, "a <|endo of|> <|startoftext|>", "t", 3)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, sequence_id string, ids int")
    for settle in (1 << 21, 6000):
        out = packing.pack_documents(docs, vocabulary("byte_bpe_50k.json"), _pattern(), settle=settle)
        got = out.withColumn("ids_crc32", F.crc32("ids")).collect()
        check(got, {r[0]: r[1] for r in rows}, 2048)
    assert packing.pack_documents(docs.limit(0), vocabulary("byte_bpe_50k.json"), _pattern()).count() == 0
    twice = packing.pack_documents(docs.filter("doc_id = 1").union(docs.filter("doc_id = 1")), vocabulary("byte_bpe_50k.json"), _pattern())
    assert sum(r["length"] for r in twice.collect()) == 2
