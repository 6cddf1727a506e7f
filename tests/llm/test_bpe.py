import hashlib
from functools import lru_cache

from wordmine.llm import bpe
from wordmine.llm.common import vocabulary
from wordmine.llm.queries import QUERIES, _pattern

SF = "/root/testdata/sf0.001"
ODD = ["", None, " ", "  a  b \n c", "Ünïcode x\x00y   z", "\n\n x", "<|endoftext|> hi", "it's don't I'LL 12345 ,,,",
       "日本語 text 한국어", "tab\there\r\n", "a​b c﻿ d", "x" * 5000, "a b " * 30000]


@lru_cache
def library():
    import base64

    import tiktoken

    with open(vocabulary("byte_bpe_50k.tiktoken"), "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("own", pat_str=_pattern(), mergeable_ranks=ranks, special_tokens={})


def reference(text):
    return library().encode_ordinary(text or "")


def expect(rows):
    out = []
    for d, text in rows:
        ids = reference(text)
        out.append((d, len(ids), hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest(),
                    hashlib.sha256((text or "").encode()).hexdigest()))
    return sorted(out, key=str)


def test_query_against_library(spark):
    rows = [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]
    assert sorted((tuple(r) for r in QUERIES["op2_byte_bpe"](spark, SF).collect()), key=str) == expect(rows)


def test_edges(spark, tmp_path):
    from wordmine.llm import queries

    rows = [(i if i else None, t) for i, t in enumerate([*ODD, ODD[3]])]
    docs = spark.createDataFrame([(*r, 1, "w") for r in rows], "doc_id bigint, text string, block int, word string")
    got = queries.byte_bpe_digests(docs, f"file://{tmp_path}/a")
    assert sorted((tuple(r) for r in got.collect()), key=str) == expect(rows)
    assert queries.byte_bpe_digests(docs.limit(0), f"file://{tmp_path}/b").count() == 0


def test_decode_joins_token_bytes(spark):
    ids = reference("Grüße, world")
    import numpy as np

    frame = spark.createDataFrame([(1, len(ids), bytearray(np.array(ids, "<u4").tobytes()))], "doc_id bigint, n_tokens bigint, ids binary")
    row = bpe.decode_documents(frame, vocabulary("byte_bpe_50k.tiktoken")).collect()[0]
    assert bytes(row["decoded"]).decode() == "Grüße, world"
