"""Quality scores from random-indexing word vectors and a small calibrated network.

Random indexing: every word feature (runs of one, two and three characters, the
whole word, the shape of the word) owns a fixed sparse ternary index vector, a word's
index vector is the sum over its features, and a feature's context vector is
the sum of the index vectors of the words that stand within ``WINDOW`` places
of its words. Through the features words that were never seen have vectors too.
A document is pooled into the means of its words' vectors over its tokens and
over its distinct words, with its number of words and the share of distinct
ones. A two-layer numpy network scores it, and a temperature chosen on rows
kept out of the fit turns its output into a probability.

Vectors are summed over the whole texts of all training rows, labelled or not.
Network and temperature are fitted on at most ``max_documents`` labelled
documents; scoring reads whole texts of all rows.

Defined results: null and empty texts are scored as documents without words;
without training rows of both labels every score is the share of label 1 (0.5
without any rows); repeated rows and null ids are kept, a row each; an empty
table gives no rows.
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
from wordmine.llm.wordfeatures import bounded_sample, ngram_buckets, segment_sums, shape_buckets
from wordmine.session import materialise

DIMS, BUCKETS, WINDOW, ORDERS = 32, 1 << 14, 2, (1, 2, 3)
POOLED = 4 * DIMS + 3
SCALE = 1 << 12
_SUMS = [f"s{k}" for k in range(DIMS)]


def index_vectors(seed: int = 8, nonzero: int = 4) -> np.ndarray:
    """A sparse ternary vector for each feature bucket."""
    rng = np.random.default_rng(seed)
    out = np.zeros((BUCKETS, DIMS), np.float32)
    at = np.argsort(rng.random((BUCKETS, DIMS)), axis=1)[:, :nonzero]
    np.put_along_axis(out, at, rng.choice(np.array([-1, 1], np.float32), (BUCKETS, nonzero)), 1)
    return out


def _features(words: pa.Array) -> list[tuple[np.ndarray, np.ndarray]]:
    """(buckets, first feature of each word) of the runs of each order, of whole words and of shapes."""
    one_each = np.arange(len(words))
    return [*ngram_buckets(words, ORDERS, BUCKETS), (shape_buckets(words, BUCKETS), one_each)] if len(words) else []


def _places(runs: list[tuple[np.ndarray, np.ndarray]], n_words: int) -> tuple[list[np.ndarray], np.ndarray, np.ndarray]:
    """The runs that begin at each place of the words, the shortest at every place.

    Returns (for each order the buckets of the distinct combinations, BUCKETS
    for a run beyond its word's end; the combination of each place; its word).
    Few combinations occur, so what belongs to them is made once for all orders.
    """
    codes, begin = runs[0]
    owner = np.repeat(np.arange(n_words), np.diff(np.append(begin, len(codes))))
    place = np.arange(len(codes)) - begin[owner]
    for buckets, first in runs[1:]:
        here = np.full(len(codes), BUCKETS)
        here[place < np.diff(np.append(first, len(buckets)))[owner]] = buckets
        codes = codes * (BUCKETS + 1) + here
    coded = pa.array(codes).dictionary_encode()
    distinct = coded.dictionary.to_numpy()
    split = [distinct // (BUCKETS + 1)**k % (BUCKETS + 1) for k in reversed(range(len(runs)))]
    return split, coded.indices.to_numpy(), owner


def _described(words: pa.Array):
    """(as _places; first place and number of places of each word; buckets of whole words and of shapes)."""
    *runs, (whole, _), (shape, _) = _features(words)
    split, index, owner = _places(runs, len(words))
    return split, index, owner, runs[0][1], np.diff(np.append(runs[0][1], len(index))), whole, shape


def _means(described, table: np.ndarray, a: int, b: int) -> np.ndarray:
    """The vectors of the words from a to b."""
    split, index, _, begin, n, whole, shape = described
    with_none = np.concatenate([table, np.zeros((1, table.shape[1]), table.dtype)])
    rows = sum(with_none[buckets] for buckets in split)
    # the words with most places first: the k-th place is added for a stretch of words at once
    order = a + np.argsort(-n[a:b], kind="stable")
    n, begin = n[order], begin[order]
    sums = rows[index[begin]]
    for k in range(1, int(n[0])):
        more = np.searchsorted(-n, -k)
        sums[:more] += rows[index[begin[:more] + k]]
    sums /= n.astype(np.float32)[:, None]
    out = table[whole[a:b]] + table[shape[a:b]]
    out[order - a] += sums
    return out / np.float32(len(ORDERS) + 2)


def word_vectors(words: pa.Array, table: np.ndarray, step: int = 4000) -> np.ndarray:
    """Mean over kinds of features of the table's rows: those of an order's runs are summed and divided by the word's places."""
    out = np.zeros((len(words), table.shape[1]), np.float32)
    for at in range(0, len(words), step):
        part = words.slice(at, step)
        out[at:at + step] = _means(_described(part), table, 0, len(part))
    return out


def context_sums(texts: pa.Array, index: np.ndarray) -> np.ndarray:
    """Sums (dimensions x buckets) of the vectors of the words that stand around each feature's words.

    Vectors are rounded to whole multiples of 1 / SCALE, so that sums are exact
    and do not depend on how the texts are dealt out.
    """
    sums = np.zeros((DIMS, BUCKETS))
    offsets, word, words = T.ascii_words(texts, lower=False)
    if not len(word):
        return sums
    described = _described(words)
    vectors = np.concatenate([_means(described, index, at, min(at + 8000, len(words))) for at in range(0, len(words), 8000)])
    vectors = np.rint(vectors.T.astype(float) * SCALE)
    vectors = np.concatenate([vectors, np.zeros((DIMS, 1))], 1)
    # WINDOW places of a word without a vector behind every text, and before the first
    doc = np.repeat(np.arange(len(texts)), np.diff(offsets))
    padded = np.full(len(word) + WINDOW * (len(texts) + 1), len(words))
    padded[np.arange(len(word)) + WINDOW * (doc + 1)] = word
    inner = padded[WINDOW:-WINDOW]
    split, index_of, owner, _, _, whole, shape = described
    most = len(split[0])
    order = np.argsort(index_of.astype(np.uint16) if most <= 1 << 16 else index_of, kind="stable")
    index_of, owner = index_of[order], owner[order]
    first = np.flatnonzero(np.diff(index_of, prepend=-1))
    for k in range(DIMS):
        at = vectors[k][padded]
        around = at[:len(inner)].copy()
        for step in range(1, 2 * WINDOW + 1):
            if step != WINDOW:
                around += at[step:step + len(inner)]
        of_word = np.bincount(inner, around, len(words) + 1)
        of_code = np.add.reduceat(of_word[owner], first)
        for buckets in split:
            sums[k] += np.bincount(buckets, of_code, BUCKETS + 1)[:BUCKETS]
        for buckets in (whole, shape):
            sums[k] += np.bincount(buckets, of_word[:-1], BUCKETS)
    return sums


def _context_rows(index: np.ndarray):
    """The sums of all texts of a task: a row for each bucket that occurs."""
    def run(batches):
        sums = np.zeros((DIMS, BUCKETS))
        for batch in batches:
            for _, texts in T.text_slices(batch, most_bytes=1 << 20):
                sums += context_sums(texts, index)
        used = np.flatnonzero(sums.any(0))
        yield pa.record_batch([pa.array(used), *(pa.array(row[used].astype(np.int64)) for row in sums)], names=["bucket", *_SUMS])

    return run


def unit_rows(sums: np.ndarray) -> np.ndarray:
    """Unit context vectors of the feature buckets (buckets x dimensions)."""
    return (sums.T / np.maximum(np.linalg.norm(sums, axis=0), 1e-9)[:, None]).astype(np.float32)


def context_table(texts: DataFrame, index: np.ndarray) -> np.ndarray:
    """Unit context vectors from all rows of ``texts``, added up by bucket; the driver gets BUCKETS x DIMS numbers."""
    rows = texts.select("text").mapInArrow(T.tidy(_context_rows(index)), ", ".join(["bucket bigint", *(f"{c} bigint" for c in _SUMS)]))
    found = rows.groupBy("bucket").agg(*(F.sum(c).alias(c) for c in _SUMS)).toArrow()
    sums = np.zeros((DIMS, BUCKETS))
    for k, c in enumerate(_SUMS):
        sums[k, found.column("bucket").to_numpy()] = found.column(c).to_numpy()
    return unit_rows(sums)


def pooled(texts: pa.Array, table: np.ndarray) -> np.ndarray:
    """A row of POOLED features for each text."""
    offsets, word, words = T.ascii_words(texts, lower=False)
    n = np.diff(offsets)
    out = np.zeros((len(texts), POOLED), np.float32)
    out[:, -3] = np.log1p(n)
    if not len(word):
        return out
    vector = word_vectors(words, table)
    doc = np.repeat(np.arange(len(texts)), n)
    distinct, times = np.unique(doc * np.int64(len(words)) + word, return_counts=True)
    in_doc, at = distinct // len(words), distinct % len(words)
    m = np.bincount(in_doc, minlength=len(texts))
    every, once = _vector_sums(vector, at, times, np.concatenate([[0], np.cumsum(m)]))
    out[:, :2 * DIMS] = every / np.maximum(n, 1)[:, None]
    out[:, 2 * DIMS:4 * DIMS] = once / np.maximum(m, 1)[:, None]
    out[:, -2] = m / np.maximum(n, 1)
    out[:, -1] = n == 0
    return out


def _vector_sums(vector: np.ndarray, word: np.ndarray, times: np.ndarray, offsets: np.ndarray, most: int = 1 << 14):
    """Sums of the vectors of each text's words, as often as they occur and once each, for so many words (or one text) at once."""
    every, once = (np.zeros((len(offsets) - 1, vector.shape[1]), vector.dtype) for _ in range(2))
    a = 0
    while a < len(once):
        b = max(a + 1, int(np.searchsorted(offsets, offsets[a] + most, side="right")) - 1)
        rows, ends = vector[word[offsets[a]:offsets[b]]], offsets[a:b + 1] - offsets[a]
        once[a:b] = segment_sums(rows, ends)
        rows *= times[offsets[a]:offsets[b], None].astype(np.float32)
        every[a:b] = segment_sums(rows, ends)
        a = b
    return every, once


@dataclass(frozen=True)
class Model:
    table: np.ndarray                       # buckets x (context and index vectors)
    layers: tuple[np.ndarray, ...] | None   # None: only the base rate
    mean: np.ndarray
    spread: np.ndarray
    temperature: float
    base_rate: float
    offset: float = 0.0                     # log-odds of the true share of the labels less those of the sample's

    def score(self, texts: pa.Array) -> np.ndarray:
        if self.layers is None:
            return np.full(len(texts), self.base_rate)
        z = _forward(self.layers, (pooled(texts, self.table) - self.mean) / self.spread)[1] / self.temperature + self.offset
        return 1 / (1 + np.exp(-np.clip(z.astype(float), -500, 500)))


def _forward(layers, x):
    w1, b1, w2, b2 = layers
    hidden = np.maximum(x @ w1 + b1, 0)
    return hidden, (hidden @ w2 + b2)[:, 0]


def fit_network(x: np.ndarray, y: np.ndarray, hidden: int = 24, steps: int = 400, rate: float = 0.01, decay: float = 1e-3, seed: int = 3):
    """Two-layer network for labels 0 and 1: Adam on the logistic loss of all rows."""
    rng = np.random.default_rng(seed)
    p = [(rng.standard_normal((x.shape[1], hidden)) / np.sqrt(x.shape[1])).astype(np.float32), np.zeros(hidden, np.float32),
         (rng.standard_normal((hidden, 1)) / np.sqrt(hidden)).astype(np.float32), np.zeros(1, np.float32)]
    m, v = [np.zeros_like(a) for a in p], [np.zeros_like(a) for a in p]
    for t in range(1, steps + 1):
        h, z = _forward(p, x)
        pull = ((1 / (1 + np.exp(-np.clip(z, -30, 30))) - y) / len(x)).astype(np.float32)[:, None]
        back = (pull @ p[2].T) * (h > 0)
        grads = [x.T @ back + decay * p[0], back.sum(0), h.T @ pull + decay * p[2], pull.sum(0)]
        for k, g in enumerate(grads):
            m[k] += 0.1 * (g - m[k])
            v[k] += 0.01 * (g * g - v[k])
            p[k] -= rate * (m[k] / (1 - 0.9**t)) / (np.sqrt(v[k] / (1 - 0.99**t)) + 1e-8)
    return tuple(p)


def fit_temperature(z: np.ndarray, y: np.ndarray) -> float:
    """The temperature with the least logistic loss, from exp(-3) to exp(4)."""
    grid = np.exp(np.linspace(-3, 4, 281))
    return float(min(grid, key=lambda t: np.logaddexp(0, -np.where(y == 1, z, -z) / t).mean()))


def _pooler(table: np.ndarray):
    def run(batches):
        for batch in batches:
            for part, texts in T.text_slices(batch, rows=200):
                x = [row.astype("<f4").tobytes() for row in pooled(texts, table)]
                yield pa.record_batch([part.column(0), part.column(1), pa.array(x, pa.binary())], names=["doc_id", "label", "x"])

    return run


def train(docs: DataFrame, labels: DataFrame, is_training, max_documents: int = 3000, id_col: str = "doc_id",
          text_col: str = "text", label_col: str = "quality") -> Model:
    """Fit on the rows for which ``is_training`` holds: vectors on all, the network on a bounded sample of labelled ones.

    At most half of ``max_documents`` documents of each label, in the order of a
    hash of their ids, reach the driver as pooled features of whole texts. Where that takes
    a smaller part of one label than of the other, the difference of the
    log-odds is added to the logit, so that scores are probabilities at the true
    share of the labels whatever the bound.
    """
    marked = (labels.select(F.col(id_col).alias("doc_id"), F.col(label_col).cast("int").alias("label"))
              .filter(is_training).filter("label in (0, 1) and doc_id is not null").distinct())
    counts = {r["label"]: r["n"] for r in marked.groupBy("label").agg(F.count(F.lit(1)).alias("n")).collect()}
    total = sum(counts.values())
    base = counts.get(1, 0) / total if total else 0.5
    index = index_vectors()
    none = Model(index, None, np.zeros(POOLED), np.ones(POOLED), 1.0, base)
    if len(counts) < 2:
        return none
    chosen = materialise(bounded_sample(marked, "doc_id", "label", max_documents // 2, counts), "quality-sample")
    taken = {r["label"]: r["n"] for r in chosen.groupBy("label").agg(F.count(F.lit(1)).alias("n")).collect()}
    if len(taken) < 2:
        return none
    offset = float(np.log(counts[1] / taken[1]) - np.log(counts[0] / taken[0]))
    texts = id_and_text(docs, id_col, text_col).select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    table = np.concatenate([context_table(texts.filter(is_training), index), index], axis=1)
    picked = texts.join(F.broadcast(chosen), "doc_id").select("doc_id", "label", "text")
    features = picked.mapInArrow(T.tidy(_pooler(table)), "doc_id bigint, label int, x binary")
    sample = features.groupBy("doc_id", "label").agg(F.min("x").alias("x")).toArrow()  # bounded by max_documents
    if not sample.num_rows:
        return none
    sample = sample.sort_by([("doc_id", "ascending"), ("x", "ascending"), ("label", "ascending")]).combine_chunks()
    # hashed order, so that neither ids nor time decide what is kept out of the fit
    order = np.argsort(np.random.default_rng(17).random(sample.num_rows), kind="stable")
    x = np.frombuffer(b"".join(sample.column("x").to_pylist()), "<f4").reshape(-1, POOLED)[order]
    y = sample.column("label").to_numpy()[order].astype(np.float32)
    kept = np.arange(len(y)) % 5 == 4
    if len(set(y[~kept])) < 2 or not kept.any():
        return none
    mean, spread = x[~kept].mean(0), x[~kept].std(0) + 1e-4
    x = (x - mean) / spread
    layers = fit_network(x[~kept], y[~kept])
    z = _forward(layers, x[kept])[1].astype(float)
    return Model(table, layers, mean, spread, fit_temperature(z, y[kept]), base, offset)


def _scorer(model: Model):
    def run(batches):
        for batch in batches:
            for part, texts in T.text_slices(batch):
                yield pa.record_batch([part.column(0), pa.array(model.score(texts))], names=["doc_id", "score"])

    return run


def score(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, score: a row for each row of ``docs``; only its text is looked at."""
    return id_and_text(docs, id_col, text_col).mapInArrow(T.tidy(_scorer(model)), "doc_id bigint, score double")


def with_quality(docs: DataFrame, model: Model, text_col: str = "text") -> DataFrame:
    """``docs`` with its columns unchanged and the score in a column ``_quality``."""
    bound_batches(docs.sparkSession)

    @F.pandas_udf("double")
    def scored(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for text in batches:
            texts = pc.fill_null(pa.Array.from_pandas(text, type=pa.string()), "")
            yield pd.Series(np.concatenate([np.empty(0), *(model.score(texts.slice(k, T.BATCH_ROWS)) for k in range(0, len(texts), T.BATCH_ROWS))]))
        T.give_back()

    return docs.withColumn("_quality", scored(F.col(text_col).cast("string")))
