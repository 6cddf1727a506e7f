import hashlib
from collections import Counter, defaultdict
from functools import lru_cache

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from wordmine.llm import align
from wordmine.llm.common import vocabulary
from wordmine.llm.queries import QUERIES, _pattern

SF = "/root/testdata/sf0.001"
ODD = ["", None, " ", "  a  b \n c", "Ünïcode x\x00y   z", "\n\n x", "<|endoftext|> hi <s> </s> <unk>", "it's don't I'LL 12345 ,,,",
       "日本語 text 한국어 😃🧿", "tab\there\r\n", "a​b c﻿ d", "x" * 5000, "a b " * 30000, "▁low line", "e" * 97 + "=" * 301,
       "🧿" * 400, "ﬁ é é"]


@lru_cache
def libraries():
    import sentencepiece
    from tokenizers import Tokenizer

    a = Tokenizer.from_file(vocabulary("byte_bpe_50k.json"))
    a.encode_special_tokens = True
    return a, sentencepiece.SentencePieceProcessor(model_file=vocabulary("piece_bpe_32k.model"))


@lru_cache
def byte_of():
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


def tokens(text):
    """[(id, bytes)] of both tokenizers, or two empty lists."""
    if not text:
        return [], []
    a, b = libraries()
    by_a = a.encode(" " + text, add_special_tokens=False)
    of_a = [(i, bytes(byte_of()[c] for c in t)) for i, t in zip(by_a.ids, by_a.tokens)]
    of_b = []
    for i in b.encode(text):
        p = b.id_to_piece(i)
        of_b.append((i, bytes([int(p[3:5], 16)]) if b.is_byte(i) else p.replace("▁", " ").encode()))
    whole = (" " + text).encode()
    same = b"".join(x for _, x in of_a) == whole == b"".join(x for _, x in of_b)
    return (of_a, of_b) if same else ([], [])


def groups(of_a, of_b):
    out, i, j, at_a, at_b = [], 0, 0, 0, 0
    while i < len(of_a):
        x, y = [], []
        while not x or at_a != at_b:
            if at_a <= at_b and (at_a < at_b or not x):
                x.append(of_a[i][0])
                at_a += len(of_a[i][1])
                i += 1
            else:
                y.append(of_b[j][0])
                at_b += len(of_b[j][1])
                j += 1
        out.append((x, y))
    return out


def expect(rows):
    aligned = [(d, *tokens(t)) for d, t in rows]
    grouped = [groups(a, b) for _, a, b in aligned]
    links = [Counter((p, q) for x, y in g for p in x for q in y) for g in grouped]
    docs = Counter(pair for c in links for pair in c)
    most = defaultdict(int)
    for (p, _), n in docs.items():
        most[p] = max(most[p], n)
    out = []
    for (d, a, b), g, c in zip(aligned, grouped, links):
        text = ";".join(",".join(map(str, x)) + "|" + ",".join(map(str, y)) for x, y in g)
        out.append((d, len(a), len(b), len(g), sum(c.values()), sum(n for k, n in c.items() if docs[k] == most[k[0]]),
                    sum(n * docs[k] for k, n in c.items()), hashlib.sha256(text.encode()).hexdigest() if g else ""))
    return sorted(out, key=str)


@settings(max_examples=200, deadline=None)
@given(st.lists(st.integers(1, 4), min_size=1, max_size=60), st.data())
def test_groups_are_the_common_ends(sizes, data):
    a = np.cumsum(sizes)
    b = np.array(sorted({*data.draw(st.sets(st.integers(1, int(a[-1])))), int(a[-1])}))
    to_a, to_b = align.diagonal_groups(a, b)
    common = sorted(set(a.tolist()) & set(b.tolist()))
    assert a[to_a - 1].tolist() == b[to_b - 1].tolist() == common


def test_long_runs_and_wide_groups():
    a = np.arange(1, 10_001)
    assert [x.tolist() for x in align.diagonal_groups(a, a)] == [a.tolist(), a.tolist()]
    group, codes, times = align.group_links(np.arange(100) % 7, np.arange(90) % 5, np.array([100]), np.array([90]), 10)
    assert len(codes) == 35 and times.sum() == 9000 and set(group) == {0}


def test_query_against_brute_force(spark):
    rows = [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]
    assert sorted((tuple(r) for r in QUERIES["op13_token_alignment"](spark, SF).collect()), key=str) == expect(rows)


@pytest.mark.parametrize("most", [1 << 21, 50])
def test_edges(spark, tmp_path, most):
    rows = [(i if i else None, t) for i, t in enumerate([*ODD, ODD[3], ODD[8]])]
    docs = spark.createDataFrame([(*r, 1, "w", 2) for r in rows], "doc_id bigint, text string, block int, kind string, n int")
    files = [vocabulary("byte_bpe_50k.json"), _pattern(), vocabulary("piece_bpe_32k.model")]
    written = align.write_links(docs, f"file://{tmp_path}/a", *files, pairs_per_block=most)
    assert sorted((tuple(r) for r in align.count_links(written).collect()), key=str) == expect(rows)
    assert align.align_documents(docs.limit(0), f"file://{tmp_path}/b", *files).count() == 0
