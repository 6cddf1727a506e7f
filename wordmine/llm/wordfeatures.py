"""Hashed features of words, vectorised over the bytes of many words, and sums over documents."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

_MIX = np.uint64(0x9E3779B97F4A7C15)


def _mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(31))) * _MIX
    return h ^ (h >> np.uint64(29))


def word_bytes(words: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of the words, each between a mark for its begin and one for its end."""
    marked = pc.binary_join_element_wise(pa.scalar("\x02"), words, pa.scalar("\x03"), "").cast(pa.large_binary())
    offsets = np.frombuffer(marked.buffers()[1], np.int64)[marked.offset:marked.offset + len(marked) + 1]
    data = np.frombuffer(marked.buffers()[2], np.uint8)[offsets[0]:offsets[-1]] if len(marked) else np.empty(0, np.uint8)
    return data, offsets - offsets[0]


def ngram_buckets(words: pa.Array, orders: tuple[int, ...], buckets: int) -> list[tuple[np.ndarray, np.ndarray]]:
    """For each order up to 3, and once for whole words: (bucket of each feature, first feature of each word).

    Every word has a feature of every order, as its marks count as characters.
    """
    data, offsets = word_bytes(words)
    if not len(words):
        return []
    n = len(data)
    out, h = [], np.zeros(n, np.uint64)
    word = np.repeat(np.arange(len(words)), np.diff(offsets))
    for order in range(1, max(orders) + 1):
        h = h[: n - order + 1] * np.uint64(0x100000001B3) + data[order - 1:] + np.uint64(1)
        if order in orders:
            whole = word[: n - order + 1] == word[order - 1:]
            begin = offsets[:-1] - np.arange(len(words)) * (order - 1)
            out.append(((_mixed(h[whole] + np.uint64(order)) % np.uint64(buckets)).astype(np.int64), begin))
    place = np.arange(n) - offsets[:-1][word]
    power = np.cumprod(np.full(256, 0x100000001B3, np.uint64))
    parts = (data + np.uint64(1)) * power[place & 255] * (place.astype(np.uint64) + np.uint64(1))
    out.append(((_mixed(np.add.reduceat(parts, offsets[:-1])) % np.uint64(buckets)).astype(np.int64), np.arange(len(words))))
    return out


_CLASS = np.full(256, 1, np.uint8)  # lower-case letters and the bytes of non-ASCII ones
_CLASS[[*range(65, 91)]] = 2
_CLASS[[*range(48, 58)]] = 3
_CLASS[[b for b in range(33, 127) if not chr(b).isalnum()]] = 4
_CLASS[[2, 3]] = 0


def shape_buckets(words: pa.Array, buckets: int) -> np.ndarray:
    """Bucket of each word's shape: its runs of character classes, and the punctuation itself."""
    data, offsets = word_bytes(words)
    kind = _CLASS[data].astype(np.uint64)
    code = np.where(kind == 4, data.astype(np.uint64) + np.uint64(8), kind)
    first = np.diff(code.astype(np.int64), prepend=-1) != 0
    first[offsets[:-1]] = True
    run = np.cumsum(first)
    place = run - run[offsets[:-1]][np.repeat(np.arange(len(words)), np.diff(offsets))]
    power = np.cumprod(np.full(64, 0xD6E8FEB86659FD93, np.uint64))
    parts = np.where(first, (code + np.uint64(1)) * power[place & 63], np.uint64(0))
    return (_mixed(np.add.reduceat(parts, offsets[:-1])) % np.uint64(buckets)).astype(np.int64)


def segment_sums(values: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Sums of values[offsets[i]:offsets[i + 1]] along the first axis; empty segments give 0."""
    out = np.zeros((len(offsets) - 1, *values.shape[1:]), values.dtype)
    full = np.flatnonzero(np.diff(offsets) > 0)
    if len(full):
        out[full] = np.add.reduceat(values, offsets[:-1][full], axis=0)
    return out


def bounded_sample(rows: DataFrame, id_col: str, label_col: str, per_label: int, counts: dict) -> DataFrame:
    """At most ``per_label`` rows (id, label) of each label, by a hash of the id.

    ``counts`` has the number of rows of each label; rows whose hash lies beyond
    twice the share that is wanted stay where they are, so hardly more than
    2 * per_label rows of a label meet in its window.
    """
    mark = F.pmod(F.xxhash64(id_col, F.lit(11)), F.lit(1 << 30))
    shares = [F.when(F.col(label_col) == label, F.lit(int(min(1.0, 2 * per_label / n) * (1 << 30)))) for label, n in counts.items()]
    by_label = Window.partitionBy(label_col).orderBy("_mark", id_col)
    return (rows.select(id_col, label_col, mark.alias("_mark")).filter(F.col("_mark") < F.coalesce(*shares))
            .withColumn("n", F.row_number().over(by_label)).filter(F.col("n") <= per_label).drop("n", "_mark"))
