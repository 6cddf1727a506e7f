"""Physical-plan properties the scale design relies on."""

import re

from conftest import SF_SMALL

from wordmine.plans import registry as R


def _plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def _text_scans(spark, run):
    """Scans of a ``text`` column in all plans that ``run`` executes, by Spark's own event of each execution."""
    import json
    import os
    import subprocess
    import sys
    import tempfile

    folder = tempfile.mkdtemp(prefix="wm-events-")
    code = f"""
import os, sys
sys.path.insert(0, {os.getcwd()!r})
from pyspark.sql import SparkSession
s = (SparkSession.builder.master("local[2]").config("spark.ui.enabled", "false").config("spark.sql.shuffle.partitions", "4")
     .config("spark.eventLog.enabled", "true").config("spark.eventLog.dir", "file://{folder}").config("spark.eventLog.rolling.enabled", "false")
     .config("spark.eventLog.compress", "false").getOrCreate())
from wordmine.plans import registry as R
R.QUERIES[{run!r}](s, {SF_SMALL!r}).write.format("noop").mode("overwrite").save()
s.stop()
"""
    subprocess.run([sys.executable, "-c", code], check=True, capture_output=True)
    plans = {}

    def scans(node):
        meta = node.get("metadata", {})
        own = "Scan parquet" in node["nodeName"] and "documents.parquet" in meta.get("Location", "") and ",text:" in meta.get("ReadSchema", "")
        return own + sum(map(scans, node["children"]))

    for name in os.listdir(folder):
        for line in open(os.path.join(folder, name)):
            e = json.loads(line)
            if "sparkPlanInfo" in e:
                plans[e["executionId"]] = scans(e["sparkPlanInfo"])  # the last is the plan that ran
    return sum(plans.values())


def test_one_text_scan_for_each_search(spark):
    for name in ("phrase_search", "extraction_table", "expression_counts"):
        assert _text_scans(spark, name) == 1, name


def test_corpus_scan_prunes_columns(spark):
    plan = _plan(R.search.phrase_hits(R.tables.documents_corpus(spark, SF_SMALL), R.STANDIN_PHRASES))
    schemas = re.findall(r"ReadSchema: (struct<[^>]*>)", plan)
    assert schemas and all("n_chars" not in s for s in schemas)


def test_phrase_search_has_no_join_against_phrases(spark):
    plan = _plan(R.search.phrase_hits(R.tables.documents_corpus(spark, SF_SMALL), R.STANDIN_PHRASES))
    assert "NestedLoopJoin" not in plan and "CartesianProduct" not in plan and "Exchange" not in plan


def test_extraction_independent_of_partition_count(spark):
    """Ranks, span ids and row ids number inside buckets whose count follows the
    shuffle partitions; the extraction table must not depend on it."""
    before = spark.conf.get("spark.sql.shuffle.partitions")
    results = []
    try:
        for n in ("3", "11"):
            spark.conf.set("spark.sql.shuffle.partitions", n)
            results.append(sorted(tuple(r) for r in R.total(spark, SF_SMALL).collect()))
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
    assert results[0] == results[1] and len(results[0]) > 0
