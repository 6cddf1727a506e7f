import math
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from wordmine.llm import katz
from wordmine.llm.common import held_out
from wordmine.llm.queries import QUERIES

SF = "/root/testdata/sf0.001"


def lower(text):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")


def tokens_of(text):
    return [*re.findall("[^\x20\x09-\x0D]+", lower(text)), None]


def fold(doc_id):
    return zlib.crc32(str("null" if doc_id is None else doc_id).encode()) % 5


class Brute:
    """The model by its definition, in plain Python."""

    def __init__(self, texts):
        seqs = [tokens_of(t) for t in texts]
        self.c1 = Counter(w for s in seqs for w in s)
        self.c2 = Counter(p for s in seqs for p in zip([None, *s[:-1]], s))
        self.n = sum(self.c1.values())
        self.d1, self.d2 = (katz.good_turing(Counter(c.values())) for c in (self.c1, self.c2))
        kept = sum(self.disc(self.d1, c) for c in self.c1.values())
        self.scale1 = 1 / self.n if self.n and kept < self.n - 1e-9 else 1 / (self.n + 1)
        self.unknown = 1 - kept * self.scale1
        self.after = {}
        for (h, w), c in self.c2.items():
            self.after.setdefault(h, {})[w] = c

    @staticmethod
    def disc(d, c):
        return (d[c] if c <= 5 else 1.0) * c

    def p1(self, w):
        return self.disc(self.d1, self.c1[w]) * self.scale1 if w in self.c1 else self.unknown

    def p(self, h, w):
        seen = self.after.get(h)
        if not seen:
            return self.p1(w)
        kept, count, low = sum(self.disc(self.d2, c) for c in seen.values()), self.c1[h], sum(map(self.p1, seen))
        s = 1.0 if kept < count * (1 - 1e-12) else count / (count + 1)
        if 1 - low <= 1e-9:
            s = count / kept
        if w in seen:
            return s * self.disc(self.d2, seen[w]) / count
        return (1 - s * kept / count) / (1 - low)

    def prob(self, h, w):
        seen = self.after.get(h)
        return self.p(h, w) if not seen or w in seen else self.p(h, w) * self.p1(w)

    def score(self, text):
        s = tokens_of(text)
        return sum(math.log10(self.prob(h, w)) for h, w in zip([None, *s[:-1]], s))


def expect(rows):
    b = Brute([t for d, t in rows if fold(d) != 1])
    v = len(b.c1)
    out = []
    for d, t in rows:
        s = tokens_of(t)
        base = sum(math.log10((b.c1[w] + 0.5) / (b.n + 0.5 * (v + 1))) for w in s)
        out.append((d, fold(d) == 1, len(s), sum(w in b.c1 for w in s), b.n, base, b.score(t)))
    return b, sorted(out, key=str)


def same(got, want):
    assert len(got) == len(want)
    for g, w in zip(sorted(got, key=str), want):
        assert tuple(g[:5]) == w[:5]
        assert g[5] == pytest.approx(w[5], rel=1e-9, abs=1e-9) and g[6] == pytest.approx(w[6], rel=1e-9, abs=1e-9)


def test_query_against_definition(spark):
    rows = [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]
    got = [tuple(r) for r in QUERIES["op6_katz"](spark, SF).collect()]
    b, want = expect(rows)
    same(got, want)
    held = [g for g in got if g[1]]
    assert sum(g[6] for g in held) > sum(g[5] for g in held)
    for h in [None, *list(b.after)[:40]]:
        total = sum(b.prob(h, w) for w in b.c1) + (b.prob(h, "never seen") if b.unknown else 0)
        assert total == pytest.approx(1, abs=1e-9)


def run(spark, rows, folder, **kw):
    docs = spark.createDataFrame([(*r, "t", 1.0) for r in rows], "doc_id bigint, text string, train string, score double")
    out = katz.score_documents(docs, ~held_out(fold=1), folder, **kw)
    return [tuple(r) for r in out.select("doc_id", held_out(fold=1).alias("h"), "n_tokens", "n_known", "train_tokens", "base_score", "score").collect()]


def test_edges(spark, tmp_path, monkeypatch):
    rng = np.random.default_rng(6)
    words = [f"w{int(k)}" for k in rng.zipf(1.3, 6000) if k < 500]
    rows = [(i, " ".join(words[20 * i:20 * i + 20])) for i in range(200)]
    rows += [(300, ""), (301, None), (302, " \t\n"), (303, "the " * 60_000), (None, "w1 w2"), (5, rows[5][1]), (304, "Ünï ÄÖ w1 İ"), (305, "X" * 9000)]
    for k, size in enumerate((1 << 21, 900)):
        same(run(spark, rows, f"file://{tmp_path}/k{k}", words_per_block=size), expect(rows)[1])
    only_held = [(d, t) for d, t in rows if d is not None and fold(d) == 1]
    same(run(spark, only_held, f"file://{tmp_path}/h"), expect(only_held)[1])
    tiny = [(d, "a a a a a a a") for d in range(40) if fold(d) != 1]
    same(run(spark, tiny, f"file://{tmp_path}/t"), expect(tiny)[1])
    assert run(spark, rows[:0], f"file://{tmp_path}/e") == []


def test_frequent_histories_are_dealt_out(spark, tmp_path):
    """A word followed by thousands of different ones, above the limit for one partition."""
    rows = [(i, " ".join(f"the x{i}_{j}" for j in range(30))) for i in range(120)]
    same(run(spark, rows, f"file://{tmp_path}/f"), expect(rows)[1])
