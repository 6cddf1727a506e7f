"""Language identification by error-correcting output codes.

Every language has a codeword; for each of its bits a binary classifier over
hashed character n-grams (orders 1 to 3 and whole words, inside words) says on
which side a text lies. A text is given the language whose codeword costs least:
the logistic loss of each bit's margin, weighted by how often that classifier is
right on documents of that language. Texts whose two best languages cost nearly
the same are flagged as ambiguous.

A document's features are the mean over its n-grams, so its margins are sums
over its words, and words are scored once per distinct word of a batch.

The classifiers are fitted on at most ``max_documents`` labelled documents,
spread evenly over the languages; everything else reads whole texts of all rows.

Defined results: a null text, or one without a letter, is ``und`` with score 0,
as is every text if nothing was learned; one known language is always
predicted; repeated rows and null ids are kept, a row each; equal costs go to
the first language in text order; an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wordmine.llm import textcells as T
from wordmine.llm.common import bound_batches, id_and_text
from wordmine.llm.wordfeatures import bounded_sample, ngram_buckets, segment_sums
from wordmine.session import materialise

BUCKETS, ORDERS = 4096, (1, 2, 3)


def codewords(labels: int, seed: int = 5) -> np.ndarray:
    """A codeword of -1 and 1 for each label.

    Up to 6 labels: all different non-trivial splits. More: ten bits a doubling
    of the labels, the best of 200 random matrices by its least distance.
    """
    if labels < 2:
        return np.zeros((labels, 0))
    if labels <= 6:
        bits = [[1 if (s >> k) & 1 else -1 for k in range(labels)] for s in range(1, 1 << labels, 2) if s != (1 << labels) - 1]
        return np.array(bits, float).T
    rng, length = np.random.default_rng(seed), int(np.ceil(10 * np.log2(labels)))
    best, far = None, -1.0
    for _ in range(200):
        m = rng.choice([-1.0, 1.0], (labels, length))
        distance = (length - m @ m.T) / 2 + length * np.eye(labels)
        mixed = np.abs(m.sum(0)).max() < labels  # no bit is the same for all
        if mixed and distance.min() > far:
            best, far = m, distance.min()
    return best if best is not None else m


@dataclass(frozen=True)
class Model:
    labels: list[str]
    code: np.ndarray     # labels x bits
    weights: np.ndarray  # buckets x bits
    bias: np.ndarray     # bits
    trust: np.ndarray    # labels x bits, rows add up to 1
    sharpness: float


def _words_of(texts: pa.Array):
    return T.ascii_words(pc.utf8_lower(texts), lower=False)


def document_features(texts: pa.Array) -> np.ndarray:
    """Share of each bucket among a text's features (rows: texts)."""
    offsets, index, words = _words_of(texts)
    out = np.zeros(len(texts) * BUCKETS)
    doc = np.repeat(np.arange(len(texts)), np.diff(offsets))
    for buckets, begin in ngram_buckets(words, ORDERS, BUCKETS):
        n = np.diff(np.append(begin, len(buckets)))
        features, ends = T.gather_ragged(buckets, begin, n, index)
        out += np.bincount(np.repeat(doc, n[index]) * BUCKETS + features, minlength=len(out))
    out = out.reshape(len(texts), BUCKETS).astype(np.float32)
    total = out.sum(1, keepdims=True)
    return out / np.maximum(total, 1)


def _sparse_features(batches):
    for batch in batches:
        for part, texts in T.text_slices(batch, rows=200):
            x = document_features(texts)
            at = [np.flatnonzero(r) for r in x]
            yield pa.record_batch([
                part.column(0), part.column(1), pa.array([a.astype("<u2").tobytes() for a in at], pa.binary()),
                pa.array([r[a].astype("<f4").tobytes() for r, a in zip(x, at, strict=True)], pa.binary()),
            ], names=["doc_id", "label", "at", "value"])


def fit_logistic(x: np.ndarray, y: np.ndarray, steps: int = 150, rate: float = 0.1, decay: float = 1e-4) -> tuple[np.ndarray, np.ndarray]:
    """Weights and biases of independent logistic classifiers (columns of y in -1, 1), by Adam over all rows."""
    w, b = np.zeros((x.shape[1], y.shape[1]), np.float32), np.zeros(y.shape[1], np.float32)
    m, v = [np.zeros_like(w), np.zeros_like(b)], [np.zeros_like(w), np.zeros_like(b)]
    y = y.astype(np.float32)
    for t in range(1, steps + 1):
        z = x @ w + b
        pull = -y / (1 + np.exp(np.clip(y * z, -30, 30))) / len(x)
        for k, (p, g) in enumerate(((w, x.T @ pull + decay * w), (b, pull.sum(0)))):
            m[k] += 0.1 * (g - m[k])
            v[k] += 0.01 * (g * g - v[k])
            p -= rate * (m[k] / (1 - 0.9**t)) / (np.sqrt(v[k] / (1 - 0.99**t)) + 1e-8)
    return w, b


def _losses(margins: np.ndarray, code: np.ndarray, trust: np.ndarray) -> np.ndarray:
    """Weighted logistic loss of each codeword (rows: documents, columns: labels)."""
    return np.stack([(trust[k] * np.logaddexp(0, -margins * code[k])).sum(1) for k in range(len(code))], 1)


def train(docs: DataFrame, is_training, max_documents: int = 2400, id_col: str = "doc_id", text_col: str = "text",
          label_col: str = "lang") -> Model:
    """Fit on a bounded sample of the rows for which ``is_training`` holds and the label is not null.

    At most ``max_documents`` documents (at least 8 for each label), taken in
    the order of a hash of their ids, reach the driver as hashed features of
    whole texts, one row of each id and label.
    """
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text"),
                       F.col(label_col).cast("string").alias("label"))
    usable = rows.filter(is_training).filter("label is not null and text is not null").filter(F.col("text").rlike(r"\p{L}"))
    labelled = rows.filter(is_training).filter("label is not null").select("doc_id", "label")
    counts = {r["label"]: r["n"] for r in labelled.groupBy("label").agg(F.count(F.lit(1)).alias("n")).orderBy("label").collect()}
    labels = list(counts)
    if len(labels) < 2:
        empty = np.zeros((len(labels), 0))
        return Model(labels, empty, np.zeros((BUCKETS, 0)), np.zeros(0), empty, 1.0)
    per_label = max(8, max_documents // len(labels))
    ids = materialise(usable.filter("doc_id is not null").select("doc_id", "label").distinct(), "language-ids")
    counts = {r["label"]: r["n"] for r in ids.groupBy("label").agg(F.count(F.lit(1)).alias("n")).collect()}
    if not counts:
        return train_none(labels)
    chosen = bounded_sample(ids, "doc_id", "label", per_label, counts)
    picked = usable.join(F.broadcast(chosen), ["doc_id", "label"], "left_semi").select("doc_id", "label", "text")
    features = picked.mapInArrow(T.tidy(_sparse_features), "doc_id bigint, label string, at binary, value binary")
    one_each = features.groupBy("doc_id", "label").agg(F.min(F.struct("at", "value")).alias("x"))
    sample = one_each.select("label", "x.at", "x.value").toArrow()  # bounded by max_documents
    names = sample.column("label").to_pylist()
    if not names:
        return train_none(labels)
    order = sorted(range(len(names)), key=lambda k: (names[k], sample.column("at")[k].as_py(), sample.column("value")[k].as_py()))
    x = np.zeros((len(names), BUCKETS), np.float32)
    for row, k in enumerate(order):
        x[row, np.frombuffer(sample.column("at")[k].as_py(), "<u2")] = np.frombuffer(sample.column("value")[k].as_py(), "<f4")
    of = np.array([labels.index(names[k]) for k in order])
    mean, spread = x.mean(0), x.std(0) + 1e-4
    x -= mean
    x /= spread
    code = codewords(len(labels))
    # a quarter of the rows is kept for the classifiers' trust and the sharpness of the score
    kept = np.arange(len(x)) % 4 == 3
    fit = ~kept if len(set(of[~kept])) == len(labels) else np.ones(len(x), bool)
    w, b = fit_logistic(x[fit], code[of[fit]])
    check = kept if kept.any() else fit
    margins = x[check] @ w + b
    right = (np.sign(margins) == code[of[check]]).astype(float)
    trust = np.stack([(right[of[check] == k].sum(0) + 1) / ((of[check] == k).sum() + 2) for k in range(len(labels))])
    trust /= trust.sum(1, keepdims=True)
    loss = _losses(margins, code, trust)

    def wrong(sharp):
        z = -sharp * loss
        z -= z.max(1, keepdims=True)
        return -(z[np.arange(len(z)), of[check]] - np.log(np.exp(z).sum(1))).mean()

    sharpness = min((0.5 * 2**k for k in range(7)), key=wrong)
    w = w / spread[:, None]
    return Model(labels, code, w.astype(np.float32), (b - mean @ w).astype(np.float32), trust, float(sharpness))


def train_none(labels: list[str]) -> Model:
    empty = np.zeros((0, 0))
    return Model([], empty, np.zeros((BUCKETS, 0)), np.zeros(0), empty, 1.0)


def _margins(model: Model, texts: pa.Array) -> np.ndarray:
    offsets, index, words = _words_of(texts)
    score, count = np.zeros((len(words), len(model.bias)), np.float32), np.zeros(len(words), np.int64)
    for at in range(0, len(words), 20_000):
        part = words.slice(at, 20_000)
        for buckets, begin in ngram_buckets(part, ORDERS, BUCKETS):
            score[at:at + len(part)] += np.add.reduceat(model.weights[buckets], begin, axis=0)
            count[at:at + len(part)] += np.diff(np.append(begin, len(buckets)))
    total = segment_sums(count[index], offsets)
    sums = segment_sums(score[index].astype(np.float64), offsets)
    return sums / np.maximum(total, 1)[:, None] + model.bias


def predict_texts(model: Model, texts: pa.Array) -> tuple[list, np.ndarray, np.ndarray]:
    """(label, score, ambiguity) of each text of an array without nulls."""
    n = len(texts)
    letters = pc.match_substring_regex(texts, r"\p{L}").to_numpy(zero_copy_only=False)
    if not model.labels:
        return ["und"] * n, np.zeros(n), np.ones(n)
    if len(model.labels) == 1:
        return [model.labels[0] if x else "und" for x in letters], letters.astype(float), 1.0 - letters
    loss = _losses(_margins(model, texts).astype(float), model.code, model.trust)
    z = -model.sharpness * loss
    p = np.exp(z - z.max(1, keepdims=True))
    p /= p.sum(1, keepdims=True)
    best = loss.argmin(1)
    second = np.sort(p, 1)[:, -2]
    score = p[np.arange(n), best]
    return ([model.labels[b] if x else "und" for b, x in zip(best.tolist(), letters, strict=True)],
            np.where(letters, score, 0.0), np.where(letters, second / score, 1.0))


def _predictor(model: Model):
    def run(batches):
        for batch in batches:
            for part, texts in T.text_slices(batch):
                label, score, ambiguity = predict_texts(model, texts)
                yield pa.record_batch([part.column(0), pa.array(label, pa.string()), pa.array(score), pa.array(ambiguity > 0.5)],
                                      names=["doc_id", "lang_pred", "score", "ambiguous"])

    return run


def identify(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, lang_pred, score, ambiguous: a row for each row of ``docs``; only its text is looked at.

    ``ambiguous``: the second language is more than half as probable as the first.
    """
    return id_and_text(docs, id_col, text_col).mapInArrow(
        T.tidy(_predictor(model)), "doc_id bigint, lang_pred string, score double, ambiguous boolean")


def with_language(docs: DataFrame, model: Model, text_col: str = "text") -> DataFrame:
    """``docs`` with its columns unchanged and the prediction in a struct column ``_language``."""
    bound_batches(docs.sparkSession)

    @F.pandas_udf("struct<label: string, score: double, ambiguous: boolean>")
    def predict(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for text in batches:
            texts = pc.fill_null(pa.Array.from_pandas(text, type=pa.string()), "")
            found = [predict_texts(model, texts.slice(k, T.BATCH_ROWS)) for k in range(0, len(texts), T.BATCH_ROWS)]
            yield pd.DataFrame({"label": [x for f in found for x in f[0]], "score": np.concatenate([f[1] for f in found]) if found else [],
                                "ambiguous": np.concatenate([f[2] for f in found]) > 0.5 if found else []})
        T.give_back()

    # not to be repeated for every use of the column, in filters above all
    return docs.withColumn("_language", predict.asNondeterministic()(F.col(text_col).cast("string")))
