"""Kept/removed bookkeeping, stage audit and keep-first dedup."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Stage order of the funnel (first failing stage wins).
STAGES = ["normalise", "words", "arcs", "spell", "encyclopedia", "dictionary"]


def stage_of(removed_by: str = "removed_by"):
    """Stage name of a ``removed_by`` value (``spell:benchmark`` -> ``spell``)."""
    return F.split(F.col(removed_by), ":").getItem(0)


def stage_audit(rows: DataFrame, stages: list[str] = STAGES) -> DataFrame:
    """C20: per stage, rows in, removed, kept; kept + removed = in.

    One aggregation pass (a conditional count per stage) yields a single row;
    the running survivor counts are sums of those counts, so the per-stage
    rows come from one explode, with no window and no join.
    """
    st = stage_of()
    agg = rows.agg(F.count(F.lit(1)).alias("n_total"),
                   *[F.count(F.when(st == s, 1)).alias(f"_n{i}") for i, s in enumerate(stages)])
    per_stage = []
    for i, s in enumerate(stages):
        before = sum((F.col(f"_n{j}") for j in range(i)), F.lit(0))
        n_in = F.col("n_total") - before
        per_stage.append(F.struct(F.lit(i).cast("bigint").alias("stage_pos"), F.lit(s).alias("stage"),
                                  n_in.cast("bigint").alias("n_in"),
                                  F.col(f"_n{i}").cast("bigint").alias("n_removed"),
                                  (n_in - F.col(f"_n{i}")).cast("bigint").alias("n_kept")))
    return agg.select(F.explode(F.array(*per_stage)).alias("_s")).select("_s.*")


def keep_first(rows: DataFrame, key: str, order_cols: list[str], cols: list[str]) -> DataFrame:
    """One row per ``key``, the first in ``order_cols`` order.

    ``min`` of a struct led by the order columns, grouped by the key: partial
    aggregation runs before the shuffle, so a key held by a third of all rows
    is collapsed map-side instead of being sorted in one task.
    """
    other = [c for c in cols if c != key and c not in order_cols]
    first = F.min(F.struct(*order_cols, *other)).alias("_f")
    return rows.groupBy(key).agg(first).select(key, *[F.col(f"_f.{c}").alias(c) for c in order_cols + other])
