import numpy as np

from wordmine.llm import neardup_vectors, topk
from wordmine.llm.queries import QUERIES
from wordmine.llm.vectors import usable_vectors

SCHEMA = "vec_id bigint, embedding array<float>, v string, rank int"


def frame(spark, x, extra=()):
    rows = [(i, [float(c) for c in v]) for i, v in enumerate(x)] + list(extra)
    return spark.createDataFrame([(*r, "v", 0) for r in rows], SCHEMA), rows


BAD = [(9001, None), (9002, []), (9003, [0.0] * 8), (9004, [1.0, None] + [0.0] * 6), (9005, [float("nan")] + [1.0] * 7),
       (9006, [float("inf")] + [1.0] * 7), (None, [1.0] * 8), (9007, [1.0, 2.0])]


def ok(v):
    return v is not None and len(v) > 0 and all(c is not None and np.isfinite(c) for c in v)


def brute_top(rows, k, every):
    rows = [(i, np.floor(256 * np.array(v, np.float32).astype(float))) for i, v in rows if i is not None and ok(v)]
    dims = max(len(v) for _, v in rows)
    rows = {i: np.pad(v, (0, dims - len(v))) for i, v in sorted(rows, key=lambda r: r[0])}
    out = []
    for q in (i for i in rows if i % every == 0):
        found = sorted((-int(rows[q] @ v), i) for i, v in rows.items() if i != q)[:k]
        out += [(q, n + 1, i, -s) for n, (s, i) in enumerate(found)]
    return sorted(out)


def test_top_k_against_brute_force(spark):
    rng = np.random.default_rng(3)
    x = rng.standard_normal((300, 8))
    x[40:120] = x[39]  # ties
    x[200:] = x[10] * rng.uniform(0.5, 2, (100, 1))
    for extra in ([], BAD):
        df, rows = frame(spark, x, extra)
        for size in (0, 16):
            got = topk.top_inner_products(usable_vectors(df), "vec_id % 10 = 0", rows_per_block=size, queries_per_group=7)
            assert sorted(tuple(r) for r in got.collect()) == brute_top(rows, 5, 10)


def test_top_k_few_and_none(spark):
    df, rows = frame(spark, np.ones((3, 4)))
    got = topk.top_inner_products(usable_vectors(df), "vec_id % 50 = 0").collect()
    assert sorted(tuple(r) for r in got) == brute_top(rows, 5, 50) and len(got) == 2
    assert topk.top_inner_products(usable_vectors(df.limit(0)), "vec_id % 50 = 0").count() == 0


def brute_links(rows, t=0.95):
    use = {i: np.array(v, np.float32).astype(float) for i, v in rows if i is not None and ok(v) and any(v)}
    links = {i: set() for i, _ in rows if i is not None}
    for i, a in use.items():
        for j, b in use.items():
            if i != j and len(a) == len(b) and a @ b / np.linalg.norm(a) / np.linalg.norm(b) >= t:
                links[i].add(j)
    part = {}
    for i in sorted(links):
        todo = [] if i in part else [i]
        while todo:
            k = todo.pop()
            if k not in part:
                part[k] = i
                todo += links[k]
    return sorted((i, len(links[i]), part[i], part[i] == i) for i in links)


def test_near_duplicates_against_brute_force(spark):
    rng = np.random.default_rng(4)
    x = rng.standard_normal((400, 8))
    x[50:90] = x[49]
    x[100:200] = x[99] + 0.12 * rng.standard_normal((100, 8)) * np.linalg.norm(x[99]) / 8 ** 0.5
    x[200:220] = 3 * x[5]
    df, rows = frame(spark, x, BAD)
    for chunk in (1024, 8):
        got = neardup_vectors.near_duplicates(df, recall=0.99999, chunk=chunk, eps=6.0)
        assert sorted(tuple(r) for r in got.collect()) == brute_links(rows)
    assert neardup_vectors.near_duplicates(df.limit(0)).count() == 0


def test_queries_whole_table(spark):
    sf = "/root/testdata/sf0.001"
    rows = [(r["vec_id"], r["embedding"]) for r in spark.read.parquet(f"{sf}/embeddings.parquet").collect()]
    assert sorted(tuple(r) for r in QUERIES["op4_top_k"](spark, sf).collect()) == brute_top(rows, 5, 50)
    assert sorted(tuple(r) for r in QUERIES["op7_embedding_neardup"](spark, sf).collect()) == brute_links(rows)
