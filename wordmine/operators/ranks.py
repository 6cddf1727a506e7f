"""Retrieval by rank: ranges of ranks, a landed table that is fetched by rank, and a ledger of attempts (A2, A3, A10).

A rank names an occurrence of a phrase in a shard. Everything here is an equi
join on (query, shard, rank) or a numbering that is spread over many tasks: a
phrase or shard that holds most of the ranks is dealt out by rank. A null shard
counts as the empty one.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import fresh_path
from ..sources.files import materialise_once, query_slug, write_csv
from .ids import dense_index

KEYS = ["query", "shard", "rank"]
GROUP = ["query", "shard"]
# Ranks are made from ranges in steps, each dealt out anew: no row grows into more than this many.
FAN_OUT = 1 << 12


def _keyed(ranks: DataFrame) -> DataFrame:
    return ranks.select("query", F.coalesce("shard", F.lit("")).alias("shard"), F.col("rank").cast("bigint").alias("rank"))


def ranks_to_ranges(ranks: DataFrame) -> DataFrame:
    """A2: the fewest ranges ``[start, end)`` that hold exactly the given ranks: (query, shard, start, end).

    A rank whose predecessor is missing begins a range, one whose successor is
    missing ends it (two anti joins on the rank). The n-th begin of a shard
    belongs to the n-th end.
    """
    own = _keyed(ranks).distinct()
    after = own.select("query", "shard", (F.col("rank") + 1).alias("rank"))
    before = own.select("query", "shard", (F.col("rank") - 1).alias("rank"))
    starts = dense_index(own.join(after, KEYS, "left_anti").withColumnRenamed("rank", "start"), GROUP, ["start"], "n")
    ends = dense_index(own.join(before, KEYS, "left_anti").select("query", "shard", (F.col("rank") + 1).alias("end")), GROUP, ["end"], "n")
    return starts.join(ends, [*GROUP, "n"]).select("query", "shard", "start", "end")


def ranges_to_ranks(ranges: DataFrame, fan_out: int = FAN_OUT) -> DataFrame:
    """A2: every rank of the ranges ``[start, end)``; an empty range has none.

    A long range is cut into ever shorter ones, dealt out to all tasks in
    between, so that a shard whose range holds most ranks is no single task's work.
    """
    rows = (ranges.filter("start < end").select("query", F.coalesce("shard", F.lit("")).alias("shard"),
                                                F.col("start").cast("bigint").alias("start"), F.col("end").cast("bigint").alias("end")))
    n = int(ranges.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    for step in (fan_out ** 2, fan_out):
        cuts = F.explode(F.sequence("start", F.col("end") - 1, F.lit(step).cast("bigint"))).alias("cut")
        rows = (rows.select("query", "shard", "end", cuts)
                .select("query", "shard", F.col("cut").alias("start"), F.least("end", F.col("cut") + step).alias("end")).repartition(n))
    return rows.select("query", "shard", F.explode(F.sequence("start", F.col("end") - 1)).alias("rank"))


def rank_table(landed: DataFrame, buckets: int | None = None) -> DataFrame:
    """A3: the landed documents as a table bucketed and sorted by (query, shard, rank) below the shared folder.

    Written once; a fetch then shuffles the ranks that are asked for and reads
    the landed rows where they lie.
    """
    spark = landed.sparkSession
    n = buckets or int(spark.conf.get("spark.sql.shuffle.partitions"))
    name = f"landed_{uuid.uuid4().hex[:12]}"
    (landed.withColumn("shard", F.coalesce("shard", F.lit(""))).repartition(n, *KEYS)
     .write.bucketBy(n, *KEYS).sortBy(*KEYS).option("path", fresh_path(spark, name)).saveAsTable(name))
    return spark.table(name)


def fetch_by_rank(table: DataFrame, ranks: DataFrame) -> DataFrame:
    """A3: the landed documents of the asked ranks, a row for each (rank asked twice or not)."""
    return table.join(_keyed(ranks).distinct(), KEYS)


def retrieval_ledger(requested: DataFrame, fetches: list[Callable[[DataFrame], DataFrame]], folder: str) -> DataFrame:
    """A10: (query, shard, rank, attempts, retrieved) after one pass for each of ``fetches``.

    A pass asks for the ranks that no earlier one retrieved; ``fetch(pending)``
    gives rows with the keys of those that it found. What a pass retrieved is
    written below ``folder``: a run that starts again with the same folder reads
    the finished passes and goes on with the first unfinished one.
    """
    spark = requested.sparkSession
    asked = _keyed(requested).distinct()
    found = None
    for number, fetch in enumerate(fetches, 1):
        pending = asked if found is None else asked.join(found, KEYS, "left_anti")

        def run(pending=pending, fetch=fetch):
            return _keyed(fetch(pending)).distinct().join(pending, KEYS, "left_semi")

        one = materialise_once(spark, f"{folder}/pass-{number}", run).withColumn("attempts", F.lit(number))
        found = one if found is None else found.unionByName(one)
    ledger = asked.join(found, KEYS, "left")
    return ledger.select(*KEYS, F.coalesce("attempts", F.lit(len(fetches))).cast("bigint").alias("attempts"),
                         F.col("attempts").isNotNull().alias("retrieved"))


def write_leftovers(ledger: DataFrame, folder: str) -> None:
    """A10: the ranks that no pass retrieved as CSV (shard, rank), one folder per expression."""
    left = ledger.filter(~F.col("retrieved")).select(query_slug().alias("query_slug"), "query", "shard", "rank")
    write_csv(left.sortWithinPartitions("query", "shard", "rank"), folder, partition_by=["query_slug"])
