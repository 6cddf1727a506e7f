import os
import random

from pyspark.sql import functions as F

from wordmine.operators import collect, frequency, ranks, segment
from wordmine.session import fresh_path

SCHEMA = "query string, shard string, rank bigint"


def rows_of(frame):
    return sorted(tuple(r) for r in frame.collect())


def test_ranges_hold_exactly_the_ranks(spark):
    rng = random.Random(3)
    asked = {("p", s, r) for s in ("a", "b") for r in range(300) if rng.random() < 0.7} | {("q", "a", 5), ("q", "", 0)}
    frame = spark.createDataFrame([*asked, *list(asked)[:40]], SCHEMA)
    ranges = ranks.ranks_to_ranges(frame)
    got = rows_of(ranges)
    assert sorted((q, s, r) for q, s, a, b in got for r in range(a, b)) == sorted(asked)
    ends = {(q, s, b) for q, s, _, b in got}
    assert not any((q, s, a) in ends for q, s, a, _ in got)  # none of them could be joined
    for fan_out in (1 << 12, 2, 7):
        assert rows_of(ranks.ranges_to_ranks(ranges, fan_out)) == sorted(asked)


def test_ranges_edges(spark):
    none = spark.createDataFrame([], SCHEMA)
    assert ranks.ranks_to_ranges(none).count() == 0
    ranges = spark.createDataFrame([("p", None, 4, 4), ("p", None, 7, 5), ("p", None, 0, 2)], "query string, shard string, start bigint, end bigint")
    assert rows_of(ranks.ranges_to_ranks(ranges)) == [("p", "", 0), ("p", "", 1)]


def test_long_range_is_dealt_out(spark):
    ranges = spark.createDataFrame([("p", "s", 0, 5000)], "query string, shard string, start bigint, end bigint")
    out = ranks.ranges_to_ranks(ranges, 16)
    per_task = [r["count"] for r in out.groupBy(F.spark_partition_id()).count().collect()]
    assert sum(per_task) == 5000 and len(per_task) == int(spark.conf.get("spark.sql.shuffle.partitions"))


def test_fetch_does_not_shuffle_the_landed_table(spark):
    landed = spark.range(500).select(F.lit("p").alias("query"), F.when(F.col("id") % 2 == 0, "s").alias("shard"),
                                     F.floor(F.col("id") / 2).cast("bigint").alias("rank"), F.col("id").alias("doc_ix"))
    table = ranks.rank_table(landed, 4)
    asked = spark.createDataFrame([("p", "s", 3), ("p", None, 4), ("p", "s", 3), ("p", "t", 3)], SCHEMA)
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        found = ranks.fetch_by_rank(table, asked)
        assert sorted(r["doc_ix"] for r in found.collect()) == [6, 9]
        plan = found._jdf.queryExecution().executedPlan().toString().split("Initial Plan")[0]
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    side = plan[plan.index("SortMergeJoin"):]
    scan = side.index("FileScan") if "FileScan" in side else side.index("Scan parquet")
    assert "Exchange" not in side[:scan] and "Bucketed: true" in side


def test_ledger_goes_on_where_it_stopped(spark):
    requested = spark.createDataFrame([("p", s, r) for s in ("a", "b") for r in range(6)], SCHEMA)
    folder, asked = fresh_path(spark, "ledger"), []

    def source(keep, fail=False):
        def fetch(pending):
            asked.append(sorted((r["shard"], r["rank"]) for r in pending.collect()))
            if fail:
                raise OSError("the source is away")
            return pending.filter(keep).unionByName(pending.filter(keep))
        return fetch

    try:
        ranks.retrieval_ledger(requested, [source("rank < 3"), source("true", fail=True)], folder)
    except OSError:
        pass
    ledger = ranks.retrieval_ledger(requested, [source("rank < 1"), source("shard = 'a' and rank < 5")], folder)
    want = [("p", s, r, 1 if r < 3 else 2, r < 3 or (s == "a" and r < 5)) for s in "ab" for r in range(6)]
    assert rows_of(ledger) == want
    # the first pass ran once, and the second was asked for nothing that the first had found
    assert [len(x) for x in asked] == [12, 6, 6] and asked[1] == asked[2]
    path = fresh_path(spark, "left")
    ranks.write_leftovers(ledger, path)
    left = spark.read.schema("query string, shard string, rank bigint, query_slug string").option("header", True).csv(path)
    assert rows_of(left.select("query_slug", "shard", "rank")) == [("p", "a", 5), ("p", "b", 3), ("p", "b", 4), ("p", "b", 5)]


def test_files_match_their_manifest(spark):
    docs = spark.createDataFrame([(q, "s", i, i * 10) for q, n in (("is a", 7), ("of the", 3), ("odd", 1)) for i in range(n)],
                                 "query string, shard string, rank bigint, doc_ix bigint")
    path = fresh_path(spark, "files")
    contents = []
    for _ in range(2):  # a second run leaves the same files
        manifest = collect.write_manifest_files(docs.repartition(5), path, 3).collect()
        found = {}
        for folder, _, names in os.walk(path):
            for name in names:
                if name.endswith(".json"):
                    with open(os.path.join(folder, name)) as f:
                        found[name] = f.read()
        contents.append(found)
    assert contents[0] == contents[1]
    assert set(found) == {f"{r['query'].replace(' ', '_')}_{r['start']}_{r['end']}.json" for r in manifest} and len(manifest) == 5
    for r in manifest:
        lines = spark.read.json(f"{path}/{r['query'].replace(' ', '_')}/{r['query'].replace(' ', '_')}_{r['start']}_{r['end']}.json")
        assert [x["rank"] for x in lines.collect()] == list(range(r["start"], r["end"] + 1))


def test_forms_of_several_tokens(spark):
    texts = ["The big, dog barks - the big dog", "big dog big dog big", None, "", "the \"big\" (dog) 5 dog", "dog"]
    forms = ["dog", "big dog", "the big dog", "The big dog barks", "dog big dog", "big  dog", "- !", "dog dog", "zzz zzz"]
    got = {r["form"]: r["cnt"] for r in frequency.form_counts(spark.createDataFrame([(t,) for t in texts], "text string"),
                                                               spark.createDataFrame([(f,) for f in forms], "form string")).collect()}

    def strip(t):
        while t and not (t[0].isascii() and t[0].isalpha()):
            t = t[1:]
        while t and not (t[-1].isascii() and t[-1].isalpha()):
            t = t[:-1]
        return t

    want = {}
    for f in forms:
        g = [x for x in map(strip, f.split()) if x]
        n = sum([strip(t) for t in (text or "").split()][i:i + len(g)] == g for text in texts for i in range(len((text or "").split()))) if g else 0
        if n:
            want[f] = n
    assert got == want and got["big dog"] == 5


def brute_beam(word, trans, beam):
    """The beam as plain lists: the best ``beam`` segmentations that end at each letter."""
    states = {0: [(0, (), 0, 0)]}
    for b in range(len(word)):
        for cost, pieces, ls, ll in sorted(states.get(b, []))[:beam]:
            for ln, piece, score in trans.get((ls, ll), []):
                states.setdefault(b + ln, []).append((cost - score, (*pieces, piece), b + 1, ln))
    return min(states[len(word)])[:2]


def test_beam_equals_lists(spark):
    rng = random.Random(8)
    words = [("".join(rng.choice("abc") for _ in range(rng.randrange(1, 18))), rng.randrange(1, 9)) for _ in range(40)] + [("a" * 50, 2)]
    w = spark.createDataFrame(words, "word string, n bigint")
    uni, bi = segment.unigram_stats(w), segment.bigram_stats(w)
    trans = {}
    for r in segment.scored_lattice(w, uni, bi).collect():
        before = (r["s"] - r["pl"], r["pl"]) if r["pl"] else (0, 0)
        trans.setdefault(r["word"], {}).setdefault(before, []).append((r["l"], r["piece"], r["score"]))
    for beam in (1, 5):
        out = segment.beam_segment(w, uni, bi, beam)
        assert "Python" not in out._jdf.queryExecution().executedPlan().toString()
        got = {r["word"]: (round(-r["score"] * segment.SCORE_UNIT), tuple(r["pieces"])) for r in out.collect()}
        assert got == {x: brute_beam(x, trans[x], beam) for x in {x for x, _ in words}}
