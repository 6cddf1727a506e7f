import test_jaccard
import test_packing
import test_pii
from pyspark.sql import functions as F

import corpus_pipeline as pipeline
from wordmine.llm import langid, pii, quality
from wordmine.llm.common import held_out
from wordmine.session import materialise

SF = "/root/testdata/sf0.001"


def rows(df):
    return {r["doc_id"]: r for r in df.collect()}


def test_stages_against_brute_force(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    steps = {"": docs}
    for name, stage in pipeline.STAGES[:-1]:
        steps[name] = materialise(stage(spark, docs, SF), f"test-{name}")
        assert steps[name].schema.simpleString() == docs.schema.simpleString()
        docs = steps[name]
    first, good, told, single, clean = (rows(s) for s in steps.values())
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    scores = quality.score(steps[""], quality.train(steps[""], labels, ~held_out())).collect()
    assert set(good) == {r["doc_id"] for r in scores if r["score"] >= 0.3}
    marked = {r["doc_id"]: r["quality"] for r in labels.collect()}
    lost = [d for d in first if marked.get(d) == 1 and d not in good]
    assert len(lost) <= 0.05 * sum(marked.values())
    found = langid.identify(steps["quality"], langid.train(steps["quality"], ~held_out())).collect()
    assert set(told) == {r["doc_id"] for r in found if r["lang_pred"] != "und" and r["score"] >= 0.5}
    texts = [(d, r["text"]) for d, r in told.items()]
    assert set(single) == {d for d, _, c in test_jaccard.brute(texts, 4, 5, 5) if c == d}
    for d, r in single.items():
        base = [{"kind": k, "start": a, "end": b} for k, a, b in test_pii.brute_base(r["text"])]
        assert clean[d]["text"] == (pii._replaced(r["text"], base) if base else r["text"])
        assert clean[d]["n_chars"] == len(clean[d]["text"])
    packed = pipeline.packing_stage(spark, steps["pii"], SF).withColumn("ids_crc32", F.crc32("ids"))
    assert test_packing.check(packed.collect(), {d: r["text"] for d, r in clean.items()}, 2048) < 0.01


def test_edges(spark, tmp_path):
    docs = spark.read.parquet(f"{SF}/documents.parquet").withColumn("text_key", F.lit(1)).withColumn("score", F.lit("s"))
    odd = docs.limit(1).select(F.lit(None).cast("bigint").alias("doc_id"), "text", F.lit(None).cast("string").alias("lang"), "source", "n_chars", "text_key", "score")
    null = docs.limit(1).select(F.lit(9001).cast("bigint").alias("doc_id"), F.lit(None).cast("string").alias("text"), "lang", "source", "n_chars", "text_key", "score")
    docs = docs.unionByName(odd).unionByName(null).unionByName(docs.filter("doc_id < 20"))
    empty = docs.limit(0)
    for _, stage in pipeline.STAGES:
        assert stage(spark, empty, SF).count() == 0
    for name, stage in pipeline.STAGES[:-1]:
        docs = materialise(stage(spark, docs, SF), f"test-edge-{name}")
    ids = [r["doc_id"] for r in docs.select("doc_id").collect()]
    assert 9001 not in ids and len(ids) == len(set(ids))
    assert pipeline.packing_stage(spark, docs, SF).select("doc_id").distinct().count() == len(ids)
