import re

import numpy as np

from wordmine.llm import jaccard
from wordmine.llm.queries import QUERIES

SF = "/root/testdata/sf0.001"


def shingles(text, k=3):
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    w = re.findall("[^\x20\x09-\x0D]+", low)
    return {tuple(w[i:i + k]) for i in range(len(w) - k + 1)} if len(w) >= k else {tuple(w)} if w else set()


def brute(rows, p=9, q=10, k=3):
    sets = [(d, shingles(t, k)) for d, t in rows]
    ids = sorted({d for d, _ in sets if d is not None})
    near = {d: set() for d in ids}
    for i, (a, x) in enumerate(sets):
        for b, y in sets[:i]:
            if None not in (a, b) and x and y and q * len(x & y) >= p * len(x | y):
                near[a].add(b)
                near[b].add(a)
    part = {}
    for d in ids:
        todo = [] if d in part else [d]
        while todo:
            e = todo.pop()
            if e not in part:
                part[e] = d
                todo += near[e]
    return sorted(((d, len(x), part.get(d)) for d, x in sets), key=str)


def got(frame, **kw):
    return sorted((tuple(r) for r in jaccard.linked_groups(frame, **kw).collect()), key=str)


def edited(rng, words, n):
    out = list(words)
    for at in rng.choice(len(out), n, replace=False):
        out[at] = f"e{rng.integers(1 << 30)}"
    return out


def corpus(seed):
    rng = np.random.default_rng(seed)
    rows = []
    passage = [f"p{i}" for i in range(60)]
    for size in (3, 4, 9, 10, 11, 12, 19, 20, 21, 22, 29, 30, 31, 39, 60, 120, 400):
        base = [f"v{rng.integers(5000)}" for _ in range(size)]
        for n in (0, 0, 1, 1, 2, 3, 4, size // 12, size // 20):
            rows.append(" ".join(edited(rng, base, min(n, size))))
        rows.append(" ".join(base[:-1]))
        rows.append(" ".join(base + base[:2]))
        rows.append(" ".join(passage + base))
    chain = [f"c{i}" for i in range(300)]
    for _ in range(25):  # a chain of copies of copies
        chain = edited(rng, chain, 3)
        rows.append(" ".join(chain))
    return list(enumerate(rows))


def test_against_brute_force(spark):
    rows = corpus(1)
    docs = spark.createDataFrame([(*r, 1, "s") for r in rows], "doc_id bigint, text string, n int, sig string")
    want = brute(rows)
    assert got(docs) == want
    assert got(docs, rounds=0) == want


def test_light_and_heavy_agree(spark, monkeypatch):
    rows = corpus(3)
    docs = spark.createDataFrame(rows, "doc_id bigint, text string")
    monkeypatch.setattr(jaccard, "boundary", lambda sizes, p, q: 25)
    assert got(docs) == brute(rows)


def test_other_threshold(spark):
    rows = corpus(4)[60:]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string")
    assert got(docs, p=4, q=5, words_each=5) == brute(rows, 4, 5, 5)


def test_edges(spark):
    rows = [(5, None), (6, ""), (7, " \n"), (8, "one two"), (4, "ONE\ttwo"), (None, "a b c d"), (9, "a b c d"), (3, "a b c d"),
            (3, "a b c d"), (10, "x y z " * 40_000), (11, "x y z " * 30_000), (2, "Ä b c"), (1, "ä b c")]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string")
    assert got(docs) == brute(rows)
    assert got(docs.limit(0)) == []


def test_query_whole_table(spark):
    rows = [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]
    assert sorted((tuple(r) for r in QUERIES["op1_jaccard_join"](spark, SF).collect()), key=str) == brute(rows)


def test_blocks_are_dealt_to_all_tasks(spark, tmp_path):
    from pyspark.sql import functions as F

    from wordmine.llm import blocks

    docs = spark.range(240).select(F.col("id").alias("doc_id"), F.lit("a b c d e").alias("text"), F.lit(True).alias("train"))
    blocks.write_blocks(docs.repartition(12), jaccard.lower_words, f"file://{tmp_path}/b", 4)
    ids = blocks.block_ids(spark, f"file://{tmp_path}/b", 4)
    assert [r["count"] for r in ids.groupBy(F.spark_partition_id()).count().collect()] == [3] * 4


def test_long_lists_in_chunks(spark, monkeypatch):
    """Lists that are left after the last round: chunks of a few members, one of them far larger than a chunk may be."""
    rng = np.random.default_rng(31)
    shared = [f"s{i}" for i in range(90)]
    texts = [" ".join(shared + [f"o{rng.integers(1 << 30)}" for _ in range(k % 14)]) for k in range(60)]
    texts += [" ".join(edited(rng, shared, k % 4)) for k in range(30)] + [" ".join(shared * 2 + [f"l{i}" for i in range(900)])] + ["", None]
    rows = [(i * 3, t) for i, t in enumerate(texts)] + [(9, " ".join(shared[:80])), (None, " ".join(shared))]
    used = []
    of_chunks = jaccard.chunk_links

    def spied(*args):
        used.append(1)
        return of_chunks(*args)

    monkeypatch.setattr(jaccard, "chunk_links", spied)
    monkeypatch.setattr(jaccard, "CHUNK_MEMBERS", 7)
    frame = spark.createDataFrame(rows, "doc_id bigint, text string")
    assert got(frame, rounds=0) == brute(rows)
    assert used
    assert got(frame, rounds=0, p=4, q=5, words_each=5) == brute(rows, 4, 5, 5)
