import hashlib
import re

import pyarrow as pa

from wordmine.llm import pii
from wordmine.llm.queries import QUERIES

SF = "/root/testdata/sf0.01"


def brute_base(text):
    """The four patterns as they are stated, one by one."""
    text, out = text or "", []
    for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", text):
        out.append((m.start(), 0, m.end()))
    for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", text):
        if max(map(int, m[0].split("."))) <= 255:
            out.append((m.start(), 1, m.end()))
    for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", text):
        d = [int(c) for c in m[0] if c in "0123456789"]
        if 12 <= len(d) <= 19 and (sum(d[-1::-2]) + sum(sum(divmod(2 * x, 10)) for x in d[-2::-2])) % 10 == 0:
            out.append((m.start(), 2, m.end()))
    for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", text):
        if 9 <= sum(c in "0123456789" for c in m[0]) <= 15:
            out.append((m.start(), 3, m.end()))
    return [(pii.KINDS[k], a, b) for a, k, b in sorted(out)]


def joined(spans):
    return ",".join(f"{k}:{a}:{b}" for k, a, b in spans)


def test_query_base_part(spark):
    docs = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    got = QUERIES["op8_pii"](spark, SF).collect()
    assert sorted(r["doc_id"] for r in got) == sorted(docs)
    for r in got:
        base = brute_base(docs[r["doc_id"]])
        assert [r[f"n_{k}"] for k in pii.KINDS] == [sum(s[0] == k for s in base) for k in pii.KINDS]
        assert r["base_sha256"] == hashlib.sha256(joined(base).encode()).hexdigest()
        assert set(joined(base).split(",")) <= set(r["spans"].split(","))


def test_fixed_patterns():
    cases = ["a@b.c.d-e x@y", "999.1.1.1 1.2.3.4.5 010.0.0.255", "4111 1111 1111 1111 4111-1111-1111-1112", "+1 (988) 555-2485, +12",
             "ü 😀 a@b.co +49 30 1234567", "1" * 5000, "+" * 50, "@" * 50, "0004111111111111111100", "99999999999999999999.1.1.1", "a@b.c@d.e"]
    for text in cases:
        assert pii.base_spans(text) == brute_base(text)


def test_bootstrapping_finds_unseen_identifiers(spark):
    rows = [(i, f"filler w{i} please ring me on +1 (555) 000-{1000 + i} any time") for i in range(40)]
    rows += [(100 + i, f"other text please ring me on 555 01{i} any time") for i in range(5)]  # no base pattern
    rows += [(200 + i, f"nothing on the {i}th of it, room 12{i} here, total 44{i}") for i in range(40)]
    rows += [(300, None), (301, ""), (302, "x " * 100_000), (None, "please ring me on 555 777 any time"), (0, rows[0][1])]
    docs = spark.createDataFrame([(*r, "k", 1) for r in rows], "doc_id bigint, text string, key string, start int")
    out = {}
    for r in pii.find_spans(docs).collect():
        out.setdefault(r["doc_id"], []).append([dict(rows).get(r["doc_id"], "")[s["start"]:s["end"]] for s in r["added"]])
    assert sorted(len(v) for v in out.values())[-1] == 2 and len(out) == len({r[0] for r in rows})
    for i in range(5):
        assert out[100 + i] == [[f"555 01{i}"]]
    assert out[None] == [["555 777"]]
    assert not any(x for d, v in out.items() if d is not None and not 100 <= d < 105 for x in v)


def letters(i):
    return "".join("abcdefghij"[int(c)] for c in str(i))


def test_right_contexts_of_several_words(spark):
    rows = [(i, f"{letters(i)} ref +1 (555) 000-{1000 + i} done") for i in range(40)]  # no word stands alone between both
    rows += [(100 + i, f"{letters(100 + i)} ref 555 01{i} done") for i in range(5)]
    rows += [(200 + i, f"{letters(200 + i)} on +1 (555) 000-{2000 + i} any") for i in range(100)]
    rows += [(300 + i, f"{letters(300 + i)} on Monday any") for i in range(100)]  # the same frame in prose
    rows += [(400 + i, f"{letters(400 + i)} on {i} any") for i in range(5)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string")
    got = {r["doc_id"]: [dict(rows)[r["doc_id"]][s["start"]:s["end"]] for s in r["added"]] for r in pii.find_spans(docs).collect()}
    assert {d: a for d, a in got.items() if a} == {100 + i: [f"555 01{i}"] for i in range(5)}


def test_totals_of_right_contexts_cover_their_instances(spark):
    text = "so x on +1 (555) 000-1000 any, on Tue any, on 4111 1111 1111 1111 any on 7 any"
    pattern = "on _ any"
    bloom = pii.bloom_filter(spark.createDataFrame([(pattern,)], "pattern string"))
    batch = pa.record_batch([pa.array([1]), pa.array([text]), pa.array([9])], names=["doc_id", "text", "key"])
    got = [r for b in pii._occurrences(bloom)([batch]) for r in b.to_pylist() if r["pattern"] == pattern]
    assert sum(r["n"] or 0 for r in got) == 4
    assert [r["instance"] for r in got if r["instance"]] == ["+1 (555) 000-1000", "4111 1111 1111 1111", "7"]


def test_redaction(spark):
    rows = [(1, "mail a@b.co now", 5), (2, None, 1), (3, "clean", 2), (1, "other 1.2.3.4", 3), (None, "+1 (555) 000-1000", 4)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, n bigint")
    got = sorted((tuple(r) for r in pii.redact(docs, pii.find_spans(docs)).collect()), key=str)
    assert got == sorted([(1, "mail [EMAIL] now", 5), (2, None, 1), (3, "clean", 2), (1, "other [IP]", 3), (None, "[PHONE]", 4)], key=str)
    assert pii.find_spans(docs.limit(0)).count() == 0


def test_words_before_a_span_are_whole():
    for word, blank in (("w" * 500, " "), ("w" * 126, " "), ("w" * 127, " "), ("w" * 128, " "), ("mail", " " * 700), ("v" * 3000, "\n" * 3000)):
        text = f"first {word}{blank}Second-one{blank}me@example.org after"
        at = text.index("me@")
        assert pii._around(text, at, at + 14) == (word, "second-one", "after", at, at + 14)
    assert pii._around("me@example.org", 0, 14)[:3] == ("", "", "")
    assert pii._around("x" * 200 + "me@example.org now", 200, 214)[3:] == (0, 214)
