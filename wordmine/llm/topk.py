"""Exact top-k inner products by a pivot-distance index.

Every vector is keyed by its nearest pivot and its distance to it; sorted by
that key, the rows form annuli around the pivots, cut into blocks of bounded
size. For a query q and a block around pivot p whose distances lie in
[low, high] and whose squared norms are at most M, the triangle inequality
gives |q - x| >= gap = max(0, low - |q - p|, |q - p| - high), and therefore

    <q, x> = (|q|^2 + |x|^2 - |q - x|^2) / 2 <= (|q|^2 + M - gap^2) / 2.

Round one looks at the blocks at the queries' own distances, which gives each
query a k-th score; round two expands to the other blocks and leaves out those
whose bound is below it for every query of a group. All else is compared, so
the result is exact. Queries travel in groups of bounded size, and a comparison
is a row holding one group and one block: no task gathers more.

Defined results: see ``vectors.usable_vectors`` for rows that take no part;
shorter vectors count as padded with zeros; equal scores go to the smaller id;
an empty table gives no rows.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from wordmine.llm import textcells as T
from wordmine.session import materialise

KEYED = "vec_id bigint, pivot int, dist double, v binary"
BLOCKS = "block bigint, pivot int, low double, high double, norm2 double, ids binary, v binary"
FOUND = "group bigint, query_id bigint, vec_id bigint, score bigint"


def _matrix(column, dims: int) -> np.ndarray:
    lists = T.as_array(column)
    lengths = np.diff(np.asarray(lists.offsets))
    flat = lists.flatten().to_numpy()
    if (lengths == dims).all():
        return flat.reshape(-1, dims)
    out = np.zeros((len(lists), dims))
    row = np.repeat(np.arange(len(lists)), lengths)
    out[row, np.arange(len(flat)) - np.repeat(np.cumsum(lengths) - lengths, lengths)] = flat
    return out


def _distances(x: np.ndarray, pivots: np.ndarray) -> np.ndarray:
    d2 = (x * x).sum(1)[:, None] + (pivots * pivots).sum(1)[None] - 2 * (x @ pivots.T)
    return np.sqrt(np.maximum(d2, 0))


def _key(scale: float, pivots: np.ndarray, dims: int):
    def run(batches):
        for batch in batches:
            if not batch.num_rows:
                continue
            x = np.floor(scale * _matrix(batch.column(1), dims))
            d = _distances(x, pivots)
            nearest = d.argmin(1)
            data, w = x.astype("<f8").tobytes(), 8 * dims
            yield pa.record_batch([
                batch.column(0), pa.array(nearest.astype(np.int32)), pa.array(d[np.arange(len(x)), nearest]),
                pa.array([data[k * w:(k + 1) * w] for k in range(len(x))], pa.binary()),
            ], names=["vec_id", "pivot", "dist", "v"])

    return run


def _cut(rows_per_block: int, dims: int):
    """Sorted keyed rows to blocks: a new one at each pivot and after ``rows_per_block`` rows."""

    def run(batches):
        from pyspark import TaskContext

        number = TaskContext.get().partitionId() << 32
        held: list = []

        def block():
            x = np.frombuffer(b"".join(h[3] for h in held), "<f8").reshape(-1, dims)
            return pa.record_batch([
                [number], pa.array([held[0][1]], pa.int32()), [held[0][2]], [held[-1][2]], [float((x * x).sum(1).max())],
                pa.array([np.array([h[0] for h in held], "<i8").tobytes()], pa.binary()), pa.array([x.tobytes()], pa.binary()),
            ], names=[c.split()[0] for c in BLOCKS.split(", ")])

        for batch in batches:
            for row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if held and (row[1] != held[0][1] or len(held) >= rows_per_block):
                    yield block()
                    number, held = number + 1, []
                held.append(row)
        if held:
            yield block()

    return run


def _compare(k: int, dims: int):
    """Rows (group, query ids, query vectors, block ids, block vectors) to each query's k best of the block."""

    def run(batches):
        for batch in batches:
            for group, qi, qv, bi, bv in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                q, x = (np.frombuffer(v, "<f8").reshape(-1, dims) for v in (qv, bv))
                query, ids = np.frombuffer(qi, "<i8"), np.frombuffer(bi, "<i8")
                most = np.abs(q).max(initial=0) * np.abs(x).max(initial=0) * dims
                scores = q @ x.T if most < 2**52 else q.astype(np.int64) @ x.astype(np.int64).T
                scores = scores.astype(np.int64)
                own = query[:, None] == ids[None]
                order = np.argsort(ids, kind="stable")
                ids, scores, own = ids[order], scores[:, order], own[:, order]
                low = np.iinfo(np.int64).min
                scores[own] = low
                best = np.argsort(-scores.astype(np.float64) if most < 2**52 else np.negative(scores), axis=1, kind="stable")[:, :k]
                row = np.repeat(np.arange(len(query)), best.shape[1])
                at = best.ravel()
                keep = ~own[row, at]
                yield pa.record_batch([
                    pa.array(np.full(int(keep.sum()), group)), pa.array(query[row[keep]]), pa.array(ids[at[keep]]),
                    pa.array(scores[row[keep], at[keep]]),
                ], names=["group", "query_id", "vec_id", "score"])

    return run


def _survivors(meta: dict, pivots: np.ndarray, dims: int):
    """Rows (group, ids, vectors, queries' k-th scores or null) to (group, block) pairs that must be compared.

    Without k-th scores: the blocks at the queries' own distances.
    """
    order = np.lexsort((meta["low"], meta["pivot"]))
    block, pivot, low, high, norm2 = (meta[c][order] for c in ("block", "pivot", "low", "high", "norm2"))

    def home(q):
        """For each query the block that holds its key."""
        d = _distances(q, pivots)
        nearest = d.argmin(1)
        dist = d[np.arange(len(q)), nearest]
        out = []
        for p, x in zip(nearest.tolist(), dist.tolist(), strict=True):
            a, b = np.searchsorted(pivot, [p, p + 1])
            out.append(min(max(int(np.searchsorted(low[a:b], x, side="right")) - 1, 0) + a, len(block) - 1))
        return np.unique(out)

    def run(batches):
        for batch in batches:
            for group, ids, qv, kth in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                q = np.frombuffer(qv, "<f8").reshape(-1, dims)
                at = home(q)
                if kth is not None:
                    least = dict((x["query_id"], x["score"]) for x in kth)
                    tau = np.array([least.get(i, -np.inf) for i in np.frombuffer(ids, "<i8").tolist()], np.float64)
                    d = _distances(q, pivots)[:, pivot]
                    gap = np.maximum(0, np.maximum(low[None] - d, d - high[None]))
                    bound = ((q * q).sum(1)[:, None] + norm2[None] - gap * gap) / 2
                    # slack for rounding, far below the distance of two scores
                    needed = (bound + 1e-6 * (1 + np.abs(bound)) >= tau[:, None]).any(0)
                    needed[at] = False
                    at = np.flatnonzero(needed)
                yield pa.record_batch([pa.array(np.full(len(at), group)), pa.array(block[at])], names=["group", "block"])

    return run


def top_inner_products(vectors: DataFrame, is_query, k: int = 5, scale: float = 256.0, pivots: int = 0,
                       rows_per_block: int = 0, queries_per_group: int = 256) -> DataFrame:
    """query_id, rank, vec_id, score: each query's ``k`` highest inner products of ``floor(scale * v)``.

    ``vectors`` comes from ``usable_vectors``; ``is_query`` is a condition on
    vec_id; a query's own row is no candidate. ``pivots`` (half the square root
    of the row count, 4 to 256) and ``rows_per_block`` (1,024, more only beyond
    67 million rows) are derived when 0, so the blocks' key table that tasks
    receive has at most 65,536 rows and one more for each pivot.
    """
    vectors = materialise(vectors, "topk-vectors")
    n, dims = vectors.agg(F.count(F.lit(1)), F.max(F.size("v"))).first()
    pivots = pivots or int(np.clip(np.sqrt(n) / 2, 4, 256))
    per_block = rows_per_block or max(1024, -(-n // 65536))
    dims = dims or 1
    sample = vectors.orderBy(F.xxhash64("vec_id"), "vec_id").limit(pivots).toArrow()
    if not sample.num_rows:
        return vectors.sparkSession.createDataFrame([], "query_id bigint, rank int, vec_id bigint, score bigint")
    centre = np.floor(scale * _matrix(sample.column("v"), dims))
    keyed = materialise(vectors.mapInArrow(_key(scale, centre, dims), KEYED), "topk-keyed")
    sorted_rows = keyed.repartitionByRange("pivot", "dist").sortWithinPartitions("pivot", "dist", "vec_id")
    index = materialise(sorted_rows.mapInArrow(_cut(per_block, dims), BLOCKS), "topk-index")
    asked = keyed.filter(is_query).repartitionByRange("pivot", "dist").sortWithinPartitions("pivot", "dist", "vec_id")
    groups = materialise(asked.mapInArrow(_cut(queries_per_group, dims), BLOCKS).select(F.col("block").alias("group"), F.col("ids").alias("query_ids"), F.col("v").alias("q")), "topk-queries")
    keys = index.select("block", "pivot", "low", "high", "norm2").toArrow()
    meta = {c: keys.column(c).to_numpy() for c in keys.column_names}
    pairs = _survivors(meta, centre, dims)
    compare = _compare(k, dims)

    def compared(which: DataFrame) -> DataFrame:
        rows = which.join(groups, "group").join(index.select("block", "ids", "v"), "block")
        return rows.select("group", "query_ids", "q", "ids", "v").mapInArrow(compare, FOUND)

    by_query = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")

    def best(found: DataFrame) -> DataFrame:
        return found.withColumn("rank", F.row_number().over(by_query)).filter(F.col("rank") <= k)

    none = F.lit(None).cast("array<struct<query_id: bigint, score: bigint>>")
    near = materialise(best(compared(groups.select("group", "query_ids", "q", none.alias("kth")).mapInArrow(pairs, "group bigint, block bigint"))), "topk-near")
    kth = near.filter(F.col("rank") == k).groupBy("group").agg(F.collect_list(F.struct("query_id", "score")).alias("kth"))
    empty = F.array().cast("array<struct<query_id: bigint, score: bigint>>")
    rest = groups.join(kth, "group", "left").select("group", "query_ids", "q", F.coalesce("kth", empty).alias("kth"))
    far = compared(rest.mapInArrow(pairs, "group bigint, block bigint"))
    every = near.drop("rank").unionByName(far)
    return best(every).select("query_id", F.col("rank").cast("int"), "vec_id", "score")
