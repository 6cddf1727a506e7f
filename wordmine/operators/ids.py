"""Dense 0-based row numbers per group without a one-task window.

``row_number().over(Window.partitionBy(g).orderBy(k))`` sends each group to a
single task; a phrase or shard holding a third of all rows would then run in
one task. ``dense_index`` range-partitions the rows on ``(g, k)``, so a hot group
is spread over many balanced partitions, and writes each row with its partition
and its place there. Both the numbering and the per-(partition, group) counts
that give the offsets read those written rows: they cannot disagree, however
the range was sampled. ``dense_index_bucketed`` does the same for rows that
carry an order-preserving bucket. Spark decides by measured size whether the
offsets are broadcast.
"""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import materialise

_POS_BITS = 33


def _with_offsets(local: DataFrame, counts: DataFrame, part: str, group_cols: list[str], place: Column, name: str) -> DataFrame:
    """Add ``name`` = rows of the group in earlier parts + ``place``."""
    before = F.sum("_cnt").over(Window.partitionBy(*group_cols).orderBy(part)
                                .rowsBetween(Window.unboundedPreceding, -1))
    keys = [part, *group_cols]
    offsets = counts.select(*[F.col(k).alias(f"_o_{k}") for k in keys], F.coalesce(before, F.lit(0)).alias("_before"))
    cond = [F.col(k).eqNullSafe(F.col(f"_o_{k}")) for k in keys]
    return (local.join(offsets, on=cond, how="inner").drop(*[f"_o_{k}" for k in keys])
            .withColumn(name, (F.col("_before") + place).cast("bigint")).drop("_before"))


def dense_index(df: DataFrame, group_cols: list[str], order_cols: list[str], name: str,
                num_partitions: int | None = None) -> DataFrame:
    """Add ``name`` = 0-based position of the row inside its group, in ``order_cols`` order.

    ``group_cols + order_cols`` must be a total order (unique per row), which
    makes the numbering the same for every partitioning.
    """
    n = num_partitions or int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    keys = [F.col(c) for c in [*group_cols, *order_cols]]
    placed = materialise(df.repartitionByRange(n, *keys).sortWithinPartitions(*keys)
                         .withColumn("_mid", F.monotonically_increasing_id()), "ranged")
    placed = (placed.withColumn("_pid", F.shiftright("_mid", _POS_BITS))
              .withColumn("_pos", F.col("_mid").bitwiseAND(F.lit((1 << _POS_BITS) - 1))).drop("_mid"))
    counts = placed.groupBy("_pid", *group_cols).agg(F.count(F.lit(1)).alias("_cnt"), F.min("_pos").alias("_first"))
    before = F.sum("_cnt").over(Window.partitionBy(*group_cols).orderBy("_pid").rowsBetween(Window.unboundedPreceding, -1))
    # one column for both: what comes before the partition, less the place of the group's first row there
    shifted = counts.select("_pid", *group_cols, (F.coalesce(before, F.lit(0)) - F.col("_first")).alias("_shift"))
    renamed = shifted.select(*[F.col(k).alias(f"_o_{k}") for k in ["_pid", *group_cols]], "_shift")
    cond = [F.col(k).eqNullSafe(F.col(f"_o_{k}")) for k in ["_pid", *group_cols]]
    return (placed.join(renamed, on=cond, how="inner")
            .withColumn(name, (F.col("_shift") + F.col("_pos")).cast("bigint"))
            .drop("_shift", "_pid", "_pos", *[f"_o_{k}" for k in ["_pid", *group_cols]]))


def key_boundaries(keys: DataFrame, cols: list[str], buckets: int, per_bucket_sample: int = 64,
                   seed: int = 17) -> list[tuple]:
    """Split points of ``cols`` (lexicographic, without nulls) into ``buckets`` ranges of similar size.

    Starts two small jobs when called: both read the key columns only, and about
    ``buckets * per_bucket_sample`` keys reach the driver, whatever the data size.
    """
    n = keys.count()
    if n == 0 or buckets <= 1:
        return []
    frac = min(1.0, buckets * per_bucket_sample / n)
    sample = (keys.select(*cols).na.drop("any").sample(False, frac, seed=seed)
              .orderBy(*cols).collect())
    if not sample:
        return []
    step = len(sample) / buckets
    cuts = []
    for i in range(1, buckets):
        k = tuple(sample[min(len(sample) - 1, int(i * step))])
        if not cuts or k > cuts[-1]:
            cuts.append(k)
    return cuts


def bucket_of(cols: list[str], cuts: list[tuple]) -> Column:
    """Bucket number = count of split points <= the row's key (order preserving).

    A binary search inside the expression: ceil(log2(#cuts + 1)) halving steps
    of an ``aggregate``, so the cost per row grows with the log of the bucket
    count, not with the count.
    """
    if not cuts:
        return F.lit(0)
    key = F.struct(*[F.col(c).alias(f"k{i}") for i, c in enumerate(cols)])
    # one JSON literal for all split points (folded once by the optimiser), not
    # one expression per point: the plan stays small for tens of thousands
    def sql_type(v):
        return "string" if isinstance(v, str) else "double" if isinstance(v, float) else "bigint"
    schema = "array<struct<" + ",".join(f"k{i}:{sql_type(v)}" for i, v in enumerate(cuts[0])) + ">>"
    payload = json.dumps([{f"k{i}": v for i, v in enumerate(cut)} for cut in cuts])
    lits = F.from_json(F.lit(payload), schema)
    steps = max(1, (len(cuts)).bit_length())
    start = F.struct(F.lit(0).alias("lo"), F.lit(len(cuts)).alias("hi"))

    def step(acc, _):
        mid = F.floor((acc["lo"] + acc["hi"]) / 2).cast("int")
        go_right = F.element_at(lits, mid + 1) <= key
        moving = acc["lo"] < acc["hi"]
        lo = F.when(moving & go_right, mid + 1).otherwise(acc["lo"])
        hi = F.when(moving & ~go_right, mid).otherwise(acc["hi"])
        return F.struct(lo.alias("lo"), hi.alias("hi"))

    found = F.aggregate(F.sequence(F.lit(1), F.lit(steps)), start, step)
    return found["lo"]


def dense_index_bucketed(df: DataFrame, group_cols: list[str], order_cols: list[str], name: str,
                         bucket: str = "bucket", store: bool = True) -> DataFrame:
    """Dense 0-based row number per group, for rows carrying an order-preserving ``bucket``.

    ``bucket`` must never decrease along ``order_cols`` inside a group. Rows
    are numbered inside (bucket, group) by a window (a bucket is one slice of
    the key range, so no group lands whole in one task), and the counts of the
    (bucket, group) pairs give the offsets. ``store`` writes the rows with their
    numbers inside the bucket once, and both branches read them; without it both
    read ``df``, which should then be a written table.
    """
    w = Window.partitionBy(bucket, *group_cols).orderBy(*order_cols)
    local = df.withColumn("_local", F.row_number().over(w) - 1)
    if store:
        local = materialise(local, "numbered")
        df = local
    counts = df.groupBy(bucket, *group_cols).agg(F.count(F.lit(1)).alias("_cnt"))
    return _with_offsets(local, counts, bucket, group_cols, F.col("_local"), name).drop("_local")
