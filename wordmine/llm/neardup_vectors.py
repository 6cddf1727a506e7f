"""Embedding near-duplicates by randomised-rotation binary codes.

A unit vector is rotated by a random orthogonal matrix and keeps the signs of
its coordinates: the code. With its stored correction factor f = <code, vector>
the estimate <code, q> / f of an inner product is unbiased, and its error lies
within eps * sqrt((1 - f^2) / (f^2 * (D - 1))) but for a chance that falls as
exp(-eps^2 / 2). Bits of the codes of several rotations also make the buckets:
two vectors meet in a band of ``width`` bits with chance (1 - angle / pi) ^
width, and the number of bands is derived from ``recall`` at the threshold
itself. Pairs of a bucket whose estimate plus bound is below the threshold are
left out, all others are computed exactly in double precision.

Equal vectors are one vector with a weight. A bucket of more than ``chunk``
vectors is compared in pairs of chunks, each a group of its own; a pair counts
in the first band in which it meets. A group returns a row per linked vector -
its number of links there and a smaller linked vector - never its pairs.

Defined results: rows whose vector is null, empty, zero or holds a null or
non-finite component link with nothing (``n_links`` 0, a component of their
own); the same holds for vectors of different lengths among each other. Rows of
one id count once, with the smallest usable vector. A null id is left out. An
empty table gives no rows.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wordmine.llm import textcells as T
from wordmine.llm.components import connected_components
from wordmine.llm.vectors import usable_vectors
from wordmine.session import materialise

BUCKETED = "band int, bucket bigint, rep bigint, weight bigint, v binary"
LINKED = "rep bigint, other bigint, links bigint"


def rotation(seed: int, dims: int) -> np.ndarray:
    """A random orthogonal matrix (the Q of a Gaussian matrix, signs made unique)."""
    q, r = np.linalg.qr(np.random.default_rng([seed, dims]).standard_normal((dims, dims)))
    return q * np.sign(np.diag(r))


def bands_for(n: int, threshold: float, recall: float) -> tuple[int, int]:
    """(bits of a band, bands): buckets of some 16 unrelated vectors, ``recall`` at the threshold."""
    width = int(np.clip(math.ceil(math.log2(max(n, 2) / 16)), 8, 60))
    meet = (1 - math.acos(min(threshold, 1.0)) / math.pi) ** width
    return width, max(1, math.ceil(math.log(1 - recall) / math.log1p(-meet))) if meet < 1 else 1


class Codes:
    """Codes, correction factors and band keys for vectors of one length."""

    def __init__(self, dims: int, width: int, bands: int, seed: int):
        self.dims, self.width, self.bands = dims, width, bands
        self.each = max(1, dims // width)
        self.rotations = [rotation(seed + r, dims) for r in range(-(-bands // self.each))]

    def rotated(self, unit: np.ndarray, band: int) -> np.ndarray:
        return unit @ self.rotations[band // self.each]

    def key(self, turned: np.ndarray, band: int) -> np.ndarray:
        """The band's bits as a number; short vectors give fewer bits."""
        at = band % self.each * self.width
        bits = turned[:, at:at + self.width] > 0
        return bits @ (1 << np.arange(bits.shape[1], dtype=np.int64))


def _unit(raw: list[bytes], kind: str) -> np.ndarray:
    """Unit vectors in double precision; ``kind`` is the stored type, single where the table's is."""
    x = np.frombuffer(b"".join(raw), kind).reshape(len(raw), -1).astype(float)
    x = x / np.abs(x).max(1, keepdims=True)
    return x / np.sqrt((x * x).sum(1, keepdims=True))


def _bucketer(width, bands, seed, kind):
    """Rows (rep, weight, v) to a row for each band."""

    def run(batches):
        for batch in batches:
            if not batch.num_rows:
                continue
            lists = T.as_array(batch.column(2))
            sizes = np.diff(np.asarray(lists.offsets))
            for dims in np.unique(sizes).tolist():
                of = np.flatnonzero(sizes == dims)
                part = lists.take(pa.array(of))
                x = part.flatten().to_numpy().reshape(-1, dims).astype(kind)
                raw = [r.tobytes() for r in x]
                unit, codes = _unit(raw, kind), T.once(Codes, dims, width, bands, seed)
                rep, weight = (T.as_array(batch.column(c)).take(pa.array(of)) for c in (0, 1))
                turned = None
                for band in range(bands):
                    if turned is None or band % codes.each == 0:
                        turned = codes.rotated(unit, band)
                    # vectors of another length never meet: the length is part of the key
                    key = codes.key(turned, band) ^ (dims * 0x9E3779B97F4A7C15 & (1 << 62) - 1)
                    yield pa.record_batch([
                        pa.array(np.full(len(of), band, np.int32)), pa.array(key), rep, weight, pa.array(raw, pa.binary()),
                    ], names=["band", "bucket", "rep", "weight", "v"])

    return run


def _links_of_groups(threshold, eps, width, bands, seed, kind, at_once=1 << 16):
    """Rows sorted by group to (rep, a smaller linked rep or itself, weight of those linked to it)."""

    def compare(group, side, band, rep, weight, raw):
        n = len(group)
        begin = np.flatnonzero(np.diff(group, prepend=group[0] - 1))
        size = np.diff(np.append(begin, n))
        # rows after each row in its group: all pairs of a group, dealt out in steps
        ahead = np.repeat(begin + size, size) - np.arange(n) - 1
        if not ahead.any():
            return
        unit = _unit(raw, kind)
        codes = T.once(Codes, unit.shape[1], width, bands, seed)
        dims = codes.dims
        turned = np.empty_like(unit)
        for r in np.unique(band // codes.each).tolist():
            of = band // codes.each == r
            turned[of] = codes.rotated(unit[of], r * codes.each)
        sign = np.where(turned > 0, 1.0, -1.0).astype(np.float32) / np.float32(math.sqrt(dims))
        factor = (np.abs(turned).sum(1) / math.sqrt(dims))
        error = eps * np.sqrt(np.maximum(1 - factor * factor, 0) / (factor * factor * max(dims - 1, 1)))
        turned32 = turned.astype(np.float32)
        found_a, found_b = [], []
        upto = np.cumsum(ahead)
        a0 = 0
        while a0 < n:
            a1 = max(a0 + 1, int(np.searchsorted(upto, (upto[a0 - 1] if a0 else 0) + at_once, side="right")))
            a = np.repeat(np.arange(a0, a1), ahead[a0:a1])
            first = np.cumsum(ahead[a0:a1]) - ahead[a0:a1]
            b = a + 1 + np.arange(len(a)) - np.repeat(first, ahead[a0:a1])
            cross = side[a] != side[b]  # both sides of a pair of chunks; side -1 marks a single chunk
            cross |= side[a] == -1
            a, b = a[cross], b[cross]
            # <code of a, b> / f estimates <a, b>
            guess = np.einsum("ij,ij->i", sign[a], turned32[b]) / factor[a] + error[a]
            near = guess >= threshold - 1e-6
            a, b = a[near], b[near]
            exact = np.einsum("ij,ij->i", unit[a], unit[b]) >= threshold
            a, b = a[exact], b[exact]
            for e in range(int(band.max()) if len(a) else 0):  # met in an earlier band: counted there
                ta, tb = codes.rotated(unit[a], e), codes.rotated(unit[b], e)
                new = (band[a] <= e) | (codes.key(ta, e) != codes.key(tb, e))
                a, b = a[new], b[new]
            found_a.append(a)
            found_b.append(b)
            a0 = a1
        a, b = np.concatenate(found_a), np.concatenate(found_b)
        if not len(a):
            return
        label = np.arange(n)
        while True:
            low = np.minimum(label[a], label[b])
            before = label.copy()
            np.minimum.at(label, a, low)
            np.minimum.at(label, b, low)
            label = label[label]
            if (label == before).all():
                break
        links = np.zeros(n, np.int64)
        np.add.at(links, a, weight[b])
        np.add.at(links, b, weight[a])
        of = np.flatnonzero(links)
        yield pa.record_batch([pa.array(rep[of]), pa.array(rep[label[of]]), pa.array(links[of])], names=["rep", "other", "links"])

    def run(batches):
        held: list = []

        def ready(rows, whole):
            """The rows up to the last group that is known to be complete."""
            columns = [T.as_array(c) for c in pa.Table.from_batches(rows).combine_chunks().columns]
            group = np.column_stack([np.asarray(columns[k]) for k in (0, 1, 2, 3)])
            new = np.any(np.diff(group, axis=0) != 0, axis=1)
            number = np.concatenate([[0], np.cumsum(new)])
            end = len(number) if whole else int(np.searchsorted(number, number[-1]))
            return columns, number, end

        def work(columns, number, end):
            raw = columns[7].slice(0, end).to_pylist()
            width_of = np.fromiter(map(len, raw), np.int64, end)
            args = (number[:end], np.asarray(columns[4])[:end], np.asarray(columns[0])[:end].astype(np.int64),
                    np.asarray(columns[5])[:end], np.asarray(columns[6])[:end])
            for w in np.unique(width_of).tolist():
                of = np.flatnonzero(width_of == w)
                yield from compare(*(x[of] for x in args), [raw[k] for k in of.tolist()])

        for batch in batches:
            if batch.num_rows:
                held.append(batch)
                if sum(b.num_rows for b in held) >= 8192:
                    columns, number, end = ready(held, False)
                    if end:
                        yield from work(columns, number, end)
                        rest = pa.Table.from_batches(held).slice(end)
                        held = rest.combine_chunks().to_batches()
        if held:
            yield from work(*ready(held, True))

    return run


def near_duplicates(df: DataFrame, threshold: float = 0.95, recall: float = 0.999, eps: float = 4.0, chunk: int = 1024,
                    seed: int = 20, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """vec_id, n_links, component_id, kept: one row per id of ``df``."""
    ids = df.select(F.col(id_col).cast("bigint").alias("vec_id")).filter("vec_id is not null").distinct()
    usable = usable_vectors(df, id_col, vector_col).filter(F.exists("v", lambda x: x != 0))
    # adding 0.0 makes -0.0 and 0.0 the same vector
    usable = materialise(usable.withColumn("v", F.transform("v", lambda x: x + F.lit(0.0))), "vectors")
    same = materialise(usable.groupBy("v").agg(F.min("vec_id").alias("rep"), F.count(F.lit(1)).alias("weight"))
                       .select("rep", "weight", "v"), "vector-classes")
    # vectors of a single-precision table travel as such
    kind = "<f4" if "float" in df.schema[vector_col].dataType.simpleString() else "<f8"
    width, bands = bands_for(same.count(), threshold, recall)
    rows = materialise(same.mapInArrow(_bucketer(width, bands, seed, kind), BUCKETED), "vector-buckets")
    big = rows.groupBy("band", "bucket").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") > chunk)
    parts = rows.join(big, ["band", "bucket"], "left").withColumn("parts", F.ceil(F.coalesce("n", F.lit(1)) / chunk).cast("int"))
    mine = F.pmod(F.xxhash64("rep"), F.col("parts")).cast("int")
    parts = parts.withColumn("mine", mine)
    # chunk i of a big bucket goes to the groups (i, i) and (min, max) of it and every other chunk
    dealt = (parts.withColumn("to", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
             .select("band", "bucket", F.least("mine", "to").alias("i"), F.greatest("mine", "to").alias("j"),
                     F.when(F.col("mine") == F.col("to"), -1).otherwise(F.col("mine")).alias("side"), "rep", "weight", "v"))
    n = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    grouped = dealt.repartition(n, "band", "bucket", "i", "j").sortWithinPartitions("band", "bucket", "i", "j", "rep")
    links = materialise(grouped.mapInArrow(_links_of_groups(threshold, eps, width, bands, seed, kind), LINKED), "vector-links")
    counts = links.groupBy("rep").agg(F.sum("links").alias("links"))
    parts_of = connected_components(links.select(F.col("rep").alias("a"), F.col("other").alias("b")))
    classes = (same.select("rep", "weight", "v").join(counts, "rep", "left")
               .join(parts_of.withColumnRenamed("node", "rep"), "rep", "left")
               .select("v", (F.coalesce("links", F.lit(0)) + F.col("weight") - 1).alias("n_links"),
                       F.coalesce("component", "rep").alias("component_id")))
    linked = usable.join(classes, "v").select("vec_id", "n_links", "component_id")
    return (ids.join(linked, "vec_id", "left")
            .select("vec_id", F.coalesce("n_links", F.lit(0)).alias("n_links"),
                    F.coalesce("component_id", "vec_id").alias("component_id"))
            .withColumn("kept", F.col("vec_id") == F.col("component_id")))
