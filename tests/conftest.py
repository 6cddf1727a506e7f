import os
import sys
import tempfile

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

SF_SMALL = "/root/testdata/sf0.001"

SPAN_SCHEMA = ("query_pos bigint, query string, shard string, rank bigint, doc_ix bigint, pos bigint, "
               "metadata string, spans array<struct<text:string,label:string>>")


@pytest.fixture(scope="session")
def spark():
    from pyspark.sql import SparkSession
    s = (SparkSession.builder.master("local[2]").appName("wordmine-tests")
         .config("spark.sql.shuffle.partitions", "4")
         .config("spark.ui.enabled", "false")
         .config("spark.ui.showConsoleProgress", "false")
         .config("spark.sql.adaptive.enabled", "true")
         .getOrCreate())
    s.sparkContext.setLogLevel("ERROR")
    if not s.sparkContext.getCheckpointDir():
        s.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="wordmine-test-ckpt-"))
    yield s


def landed_rows(spark, docs, query="is not a word"):
    """docs: list of (doc_ix, [[text, label], ...]) -> landed DataFrame."""
    rows = [(0, query, "s0", i, d, 1, "{}", [(t, lab) for t, lab in spans]) for i, (d, spans) in enumerate(docs)]
    return spark.createDataFrame(rows, SPAN_SCHEMA)
