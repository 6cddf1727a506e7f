"""File sources (A13, A14, A16, A17, A18) and the older shape variant (C4)."""

import json
import os
import tempfile

from wordmine.operators.normalize import shape_filter
from wordmine.sources import files


def test_landed_json_array_with_null_labels(spark):
    d = tempfile.mkdtemp(prefix="wm-json-")
    docs = [{"doc_ix": 7, "metadata": "{}", "spans": [["so wug", None], ["is not a word", "0"]]},
            {"doc_ix": 8, "spans": [["x", None]]}]
    with open(os.path.join(d, "is_not_a_word.json"), "w") as f:
        json.dump(docs, f, indent=4)
    df = files.read_landed_json(spark, d, multi_line=True)
    rows = sorted(df.collect(), key=lambda r: r.doc_ix)
    assert [r.doc_ix for r in rows] == [7, 8]
    assert [(s.text, s.label) for s in rows[0].spans] == [("so wug", None), ("is not a word", "0")]
    assert rows[1].metadata is None


def test_csv_round_trip_keeps_quotes_and_newlines(spark):
    df = spark.createDataFrame([(0, 0, 1, "wug", 'He said "wug"\nis not a word.', "is not a word")],
                               files.TOTAL_CSV_SCHEMA)
    path = os.path.join(tempfile.mkdtemp(prefix="wm-csv-"), "t")
    files.write_csv(df, path)
    assert files.read_total_csv(spark, path).collect() == df.collect()


def test_lemma_tsv_and_word_list(spark):
    d = tempfile.mkdtemp(prefix="wm-tsv-")
    with open(os.path.join(d, "eng.txt"), "w") as f:
        f.write("run\trunning\tV;V.PTCP;PRS\nTable\ttables\tN;PL\n")
    t = files.read_lemma_tsv(spark, d).collect()
    assert [(r.word, r.lemma) for r in t] == [("run", "running"), ("Table", "tables")]
    w = tempfile.mkdtemp(prefix="wm-words-")
    with open(os.path.join(w, "words"), "w") as f:
        f.write("Aaron\ntable run\n")
    got = sorted(r.word for r in files.read_word_list(spark, w, "list").collect())
    assert got == ["aaron", "run", "table"]


def test_materialise_once_reuses(spark):
    path = os.path.join(tempfile.mkdtemp(prefix="wm-once-"), "t")
    calls = []

    def build():
        calls.append(1)
        return spark.createDataFrame([(1, "a")], "x bigint, q string")

    files.materialise_once(spark, path, build, partition_by=["q"])
    again = files.materialise_once(spark, path, build, partition_by=["q"])
    assert len(calls) == 1 and again.count() == 1


def test_older_letters_only_shape(spark):
    df = spark.createDataFrame([("wugs",), ("e-mail",), ("Wugs",), ("wug2s",)], "word string")
    assert sorted(r.word for r in shape_filter(df, variant="older").collect()) == ["Wugs", "wugs"]
