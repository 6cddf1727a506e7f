import numpy as np
import pyarrow as pa
import pytest

from wordmine.llm import langid, quality
from wordmine.llm.common import held_out
from wordmine.llm.queries import QUERIES

SF = "/root/testdata/sf0.01"


def test_language_held_out_accuracy(spark):
    docs = {r["doc_id"]: r for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    got = QUERIES["op3_language"](spark, SF).collect()
    assert sorted(r["doc_id"] for r in got) == sorted(docs)
    assert all(0 <= r["score"] <= 1 for r in got)
    held = [r for r in got if r["held_out"] and docs[r["doc_id"]]["lang"]]
    assert np.mean([r["lang_pred"] == docs[r["doc_id"]]["lang"] for r in held]) > 0.97


def test_language_inputs_are_texts_only(spark):
    rows = [(i, ("the of and that " if i % 2 else "der die und das ") * 5, "en" if i % 2 else "de", "l") for i in range(60)]
    docs = spark.createDataFrame([(*r, "x") for r in rows], "doc_id bigint, text string, lang string, lang_pred string, score string")
    model = langid.train(docs, ~held_out())
    odd = [(1, None), (2, ""), (3, "12 34 !"), (4, "und " * 100_000), (4, "und " * 100_000), (None, "the that")]
    frame = spark.createDataFrame([(*r, "zz", 1.0) for r in odd], "doc_id bigint, text string, lang string, score double")
    got = sorted(((r["doc_id"], r["lang_pred"], r["score"] > 0.5) for r in langid.identify(frame, model).collect()), key=str)
    assert got == sorted([(1, "und", False), (2, "und", False), (3, "und", False), (4, "de", True), (4, "de", True), (None, "en", True)], key=str)
    assert langid.identify(frame.limit(0), model).count() == 0
    for keep, answer in (("false", "und"), ("lang = 'de'", "de")):
        few = langid.train(docs.filter(keep), ~held_out())
        assert {r["lang_pred"] for r in langid.identify(frame.filter("doc_id = 4"), few).collect()} == {answer}
    with_cols = langid.with_language(frame, model)
    assert with_cols.columns[:4] == frame.columns and with_cols.count() == len(odd)


def test_samples_have_one_row_of_an_id(spark, monkeypatch):
    def word(i):
        return "".join("abcdefghij"[int(c)] for c in str(i))

    rows = [(i, f"the {word(i)} and", "en") for i in range(40) for _ in range(30)] + [(None, "of that", "en")] * 300
    rows += [(100 + i, f"der {word(i)} und", "de") for i in range(40)] + [(100 + i, None, "de") for i in range(40)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, lang string")
    seen, fit, network = [], langid.fit_logistic, quality.fit_network
    monkeypatch.setattr(langid, "fit_logistic", lambda x, y: seen.append((x, y[:, 0])) or fit(x, y))
    langid.train(docs, ~held_out(), max_documents=16)
    x, y = seen.pop()
    assert len(x) == 12 and len(np.unique(x, axis=0)) == 12 and len(np.unique(y)) == 2  # three quarters of 2 x 8
    labels = spark.createDataFrame([(i, int(i < 100)) for i in [*range(40), *range(100, 140)]], "doc_id bigint, quality int")
    monkeypatch.setattr(quality, "fit_network", lambda x, y: seen.append((x, y)) or network(x, y))
    quality.train(docs, labels, ~held_out(), max_documents=20)
    assert len(seen[0][0]) == 16  # four fifths of 2 x 10


@pytest.mark.parametrize("n", [2, 3, 4, 6, 9, 30])
def test_codewords(n):
    code = langid.codewords(n)
    assert len({tuple(c) for c in code}) == n and set(np.unique(code)) <= {-1.0, 1.0}
    assert (np.abs(code.sum(0)) < n).all()


def test_feature_sums_match_documents():
    texts = pa.array(["the cat sat", "", "thé x", "the the"])
    rng = np.random.default_rng(1)
    model = langid.Model(["a", "b"], langid.codewords(2), rng.standard_normal((langid.BUCKETS, 1)).astype(np.float32), np.zeros(1), np.ones((2, 1)), 1.0)
    assert np.allclose(langid._margins(model, texts), langid.document_features(texts) @ model.weights, atol=1e-4)


def auc(score, label):
    order = np.argsort(score)
    rank = np.empty(len(score))
    rank[order] = np.arange(1, len(score) + 1)
    one = label == 1
    return (rank[one].sum() - one.sum() * (one.sum() + 1) / 2) / (one.sum() * (~one).sum())


def test_quality_held_out(spark):
    labels = {r["doc_id"]: r["quality"] for r in spark.read.parquet(f"{SF}/labels.parquet").collect()}
    got = QUERIES["op10_quality"](spark, SF).collect()
    assert len(got) == spark.read.parquet(f"{SF}/documents.parquet").count()
    held = [r for r in got if r["held_out"] and r["doc_id"] in labels]
    y, s = np.array([labels[r["doc_id"]] for r in held]), np.array([r["score"] for r in held])
    assert auc(s, y) > 0.95
    assert np.mean(np.array([r["predicted"] for r in held]) == y) > 0.9
    assert all(r["predicted"] == int(r["score"] >= 0.3) and 0 <= r["score"] <= 1 for r in got)


def test_quality_edges(spark):
    rows = [(i, ("plain words here " if i % 2 else "LOUD!! WORDS!! ") * 4) for i in range(80)]
    docs = spark.createDataFrame([(*r, 1) for r in rows], "doc_id bigint, text string, quality int")
    labels = spark.createDataFrame([(i, i % 2, "t") for i, _ in rows] + [(None, 1, "t"), (3, None, "t")], "doc_id bigint, quality int, text string")
    model = quality.train(docs, labels, ~held_out())
    odd = spark.createDataFrame([(1, None), (2, ""), (3, "plain words " * 50_000), (3, "plain words " * 50_000), (None, "LOUD!!")], "doc_id bigint, text string")
    got = quality.score(odd, model).collect()
    assert len(got) == 5 and all(0 <= r["score"] <= 1 for r in got)
    assert {round(r["score"]) for r in got if r["doc_id"] == 3} == {1}
    assert quality.score(odd.limit(0), model).count() == 0
    assert quality.score(odd, quality.train(docs, labels.limit(0), ~held_out())).first()["score"] == 0.5
    one = quality.train(docs, labels.filter("quality = 1"), ~held_out())
    assert quality.score(odd, one).first()["score"] == 1.0
    assert quality.with_quality(odd, model).columns == ["doc_id", "text", "_quality"]


def test_quality_keeps_the_share_of_the_labels_beyond_the_bound(spark):
    rng = np.random.default_rng(4)
    words = np.array("stone river cloud paper glass green quiet seven".split())
    rows = [(i, " ".join(rng.choice(words, 12)), int(i % 10 > 0)) for i in range(2000)]  # texts say nothing: 9 of 10 are good
    docs = spark.createDataFrame([r[:2] for r in rows], "doc_id bigint, text string")
    labels = spark.createDataFrame([(r[0], r[2]) for r in rows], "doc_id bigint, quality int")
    model = quality.train(docs, labels, ~held_out(), max_documents=200)
    assert np.mean([r["score"] for r in quality.score(docs, model).collect()]) == pytest.approx(0.9, abs=0.05)


def test_context_vectors_of_all_training_texts(spark):
    rng = np.random.default_rng(5)
    rows = [(i, " ".join(f"w{x}" for x in rng.integers(0, 300, 8)) if i % 7 else "") for i in range(400)] + [(None, "null id"), (500, None)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string")
    labels = spark.createDataFrame([(i, i % 2) for i in range(0, 300)], "doc_id bigint, quality int")
    model = quality.train(docs.repartition(5), labels, ~held_out(), max_documents=40)
    index = quality.index_vectors()
    sums = np.zeros((quality.BUCKETS, quality.DIMS))
    for r in docs.filter(~held_out()).collect():  # one place after the other
        words = (r["text"] or "").split()
        for i, w in enumerate(words):
            near = pa.array(words[max(0, i - quality.WINDOW):i] + words[i + 1:i + 1 + quality.WINDOW], pa.string())
            around = np.rint(quality.word_vectors(near, index).astype(float) * quality.SCALE).sum(0)
            for buckets, _ in quality._features(pa.array([w])):
                np.add.at(sums, buckets, around)
    assert np.array_equal(model.table[:, :quality.DIMS], quality.unit_rows(sums.T))


def test_temperature_calibrates():
    rng = np.random.default_rng(2)
    z = rng.normal(0, 2, 4000)
    y = (rng.random(4000) < 1 / (1 + np.exp(-z))).astype(float)
    assert quality.fit_temperature(4 * z, y) == pytest.approx(4, rel=0.15)
