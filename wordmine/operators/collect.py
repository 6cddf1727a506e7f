"""Collection bookkeeping (A5-A7, A9, A12) over landed documents.

Landed documents carry ``(query_pos, query, shard, rank, doc_ix, pos, ...)``;
(shard, rank) is the order in which they would have been fetched.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..constants import COLLECTION_TARGETS
from ..session import fresh_path, materialise
from .ids import dense_index


def unique_collect(landed: DataFrame, extra: list[str] | None = None) -> DataFrame:
    """A5: one landed document per (query, doc_ix), the first in (shard, rank) order.

    Grouped ``min`` of a struct led by the order key; partial aggregation
    collapses repeats of a document before the shuffle.
    """
    cols = ["shard", "rank", "pos", *(extra or [])]
    first = F.min(F.struct(*cols)).alias("_f")
    return (landed.groupBy("query_pos", "query", "doc_ix").agg(first)
            .select("query_pos", "query", "doc_ix", *[F.col(f"_f.{c}").alias(c) for c in cols]))


def target_cap(unique: DataFrame, targets: dict[str, int] = COLLECTION_TARGETS, default: int | None = None) -> DataFrame:
    """At most ``targets[query]`` documents per query, the first in (shard, rank) order.

    The per-query position comes from the distributed dense index, so a query
    holding most documents is not numbered in one task.
    """
    spark = unique.sparkSession
    t = spark.createDataFrame(list(targets.items()), "query string, target bigint")
    numbered = dense_index(unique, ["query"], ["shard", "rank"], "n")
    joined = numbered.join(t, "query", "left")
    cap = F.coalesce(F.col("target"), F.lit(default)) if default is not None else F.col("target")
    return joined.where(cap.isNull() | (F.col("n") < cap)).drop("target")


def resume_union(new: DataFrame, landed_before: DataFrame, keys: tuple[str, ...] = ("query", "doc_ix")) -> DataFrame:
    """Previously landed documents plus the new ones not seen before."""
    fresh = new.join(landed_before.select(*keys), list(keys), "left_anti")
    return landed_before.unionByName(fresh)


def split_manifest(unique: DataFrame, part_size: int) -> DataFrame:
    """Part files of at most ``part_size`` documents per query, as a manifest
    ``(query, part, start, end, n)`` with 0-based inclusive document ranges."""
    numbered = dense_index(unique, ["query"], ["shard", "rank"], "n")
    part = F.floor(F.col("n") / part_size).cast("bigint")
    return (numbered.groupBy("query", part.alias("part"))
            .agg(F.min("n").alias("start"), F.max("n").alias("end"),
                 F.count(F.lit(1)).cast("bigint").alias("n")))


def write_parts(unique: DataFrame, path: str, part_size: int, fmt: str = "json") -> None:
    """A9 sink: one folder per query, files of at most ``part_size`` records."""
    (unique.withColumn("query_slug", F.regexp_replace("query", r"\s+", "_"))
     .write.mode("overwrite").option("maxRecordsPerFile", part_size)
     .partitionBy("query_slug").format(fmt).save(path))


def write_manifest_files(unique: DataFrame, path: str, part_size: int) -> DataFrame:
    """Exactly one JSON-lines file for each manifest row, ``<query>/<query>_<start>_<end>.json``; returns the manifest.

    The rows of a part meet in one task, in order, and are written to a staging
    folder of their own; when all are there, each file is moved to its final
    name. The content and the names follow from the rows alone, so a run that
    starts again leaves the same files.
    """
    spark = unique.sparkSession
    numbered = materialise(dense_index(unique, ["query"], ["shard", "rank"], "n"), "numbered-parts")
    part = F.floor(F.col("n") / part_size).cast("bigint")
    manifest = materialise(numbered.groupBy("query", part.alias("part"))
                           .agg(F.min("n").alias("start"), F.max("n").alias("end"), F.count(F.lit(1)).cast("bigint").alias("n")), "manifest")
    slug = F.regexp_replace("query", r"\s+", "_")
    named = manifest.select("query", "part", slug.alias("query_slug"), F.concat_ws("_", slug, "start", "end").alias("file"))
    rows = (numbered.withColumn("part", part).join(named, ["query", "part"])
            .repartition("query_slug", "file").sortWithinPartitions("query_slug", "file", "n").drop("n", "part"))
    staging = fresh_path(spark, "staging")
    rows.write.partitionBy("query_slug", "file").json(staging)
    _move_files(spark, staging, path)
    return manifest


def _move_files(spark, staging: str, path: str) -> None:
    """Every ``query_slug=<q>/file=<f>/part-*`` below ``staging`` to ``<path>/<q>/<f>.json``."""
    jvm, conf = spark._jvm, spark._jsc.hadoopConfiguration()
    to_path = jvm.org.apache.hadoop.fs.Path
    fs = to_path(staging).getFileSystem(conf)
    for status in fs.globStatus(to_path(f"{staging}/query_slug=*/file=*/part-*")) or []:
        of = status.getPath().getParent()
        folder = to_path(path, of.getParent().getName().split("=", 1)[1])
        target = to_path(folder, of.getName().split("=", 1)[1] + ".json")
        fs.mkdirs(folder)
        if fs.exists(target):
            fs.delete(target, False)
        if not fs.rename(status.getPath(), target):
            raise OSError(f"could not move {status.getPath()} to {target}")


def pending_worklist(worklist: DataFrame) -> DataFrame:
    """Expressions not marked done (``'o'``); a null status is pending too."""
    return worklist.where(~F.col("status").eqNullSafe("o"))
