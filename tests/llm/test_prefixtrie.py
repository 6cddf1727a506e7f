import hashlib
import random
import zlib
from collections import defaultdict

import pytest

from wordmine.llm import prefixtrie
from wordmine.llm.queries import QUERIES

SF = "/root/testdata/sf0.001"


def digest(role, text):
    return hashlib.sha256(f"{len(role)}:{role}{text}".encode()).digest()


def expect(rows):
    """Brute force: every rebuilt conversation as a tuple of turns, every prefix in a dictionary."""
    turns = defaultdict(list)
    for c, turn, role, text in rows:
        if c is not None:
            turns[c].append((turn is not None, turn or 0, digest(role or "", text or ""), role or "", text or ""))
    original = {c: [(r, t) for *_, r, t in sorted(x)] for c, x in turns.items()}
    rebuilt = {}
    for c, own in original.items():
        h = zlib.crc32(str(c).encode()) % 6
        base = c - c % 100 if c >= 0 else c + (-c) % 100
        rebuilt[c] = tuple(original.get(base, [])[:h] + own[h:])
    members = defaultdict(list)
    for c, seq in rebuilt.items():
        for d in range(len(seq) + 1):
            members[seq[:d]].append(c)
    children = defaultdict(list)
    for node in members:
        if node:
            children[node[:-1]].append(node)
    leaves, saved = defaultdict(int), defaultdict(int)
    for node in sorted(members, key=len, reverse=True):
        leaves[node] = sum(leaves[k] for k in children[node]) or 1
        own = (len(members[node]) - 1) * len(node[-1][1]) if node else 0
        saved[node] = own + sum(saved[k] for k in children[node])
    out = []
    for node, cs in members.items():
        ends = ",".join(map(str, sorted(c for c in cs if len(rebuilt[c]) == len(node))))
        out.append((min(cs), len(node), min(members[node[:-1]]) if node else None, len(cs), len(children[node]), leaves[node],
                    saved[node], hashlib.sha256(ends.encode()).hexdigest()))
    return sorted(out, key=str)


def result(frame):
    return sorted((tuple(r) for r in frame.collect()), key=str)


def test_query_against_brute_force(spark):
    rows = [tuple(r) for r in spark.read.parquet(f"{SF}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    assert result(QUERIES["op11_prefix_trie"](spark, SF)) == expect(rows)


def some_rows(n, seed):
    rng = random.Random(seed)
    rows = []
    for c in range(n):
        for turn in range(rng.choice([0, 1, 2, 5, 6, 9])):
            rows.append((c, turn, rng.choice(["user", "bot"]), rng.choice(["a", "bb", "", "é😃"])))
    return rows


@pytest.mark.parametrize("chunk, piece", [(512, 1 << 16), (2, 4)])
def test_edges(spark, monkeypatch, chunk, piece):
    monkeypatch.setattr(prefixtrie, "CHUNK", chunk)
    monkeypatch.setattr(prefixtrie, "PIECE", piece)
    rows = some_rows(130, 5)
    rows += [(7, None, None, None), (7, None, "user", "x"), (300, 1, "user", "x"), (300, 1, "user", "x"), (300, 1, "bot", "x"),
             (None, 1, "user", "lost"), (-5, 0, "user", "a"), (-100, 0, "bot", "a")]
    rows += [(900, t, "user", "long" * (t % 3)) for t in range(40)] + [(c, 0, "user", "only") for c in range(1000, 1040)]
    frame = spark.createDataFrame([(*r, "x", 3) for r in rows], "conv_id bigint, turn bigint, role string, text string, digest string, depth int")
    assert result(prefixtrie.prefix_trie(frame)) == expect(rows)


def test_empty_and_rootless(spark):
    empty = spark.createDataFrame([], "conv_id bigint, turn bigint, role string, text string")
    assert prefixtrie.prefix_trie(empty).count() == 0
    # conversations whose turns all fall to an absent first one: a root and nothing else
    turnless = [c for c in range(101, 200) if zlib.crc32(str(c).encode()) % 6 > 1][:5]
    rows = [(c, 0, "user", "gone") for c in turnless]
    frame = spark.createDataFrame(rows, "conv_id bigint, turn bigint, role string, text string")
    assert result(prefixtrie.prefix_trie(frame)) == expect(rows)
