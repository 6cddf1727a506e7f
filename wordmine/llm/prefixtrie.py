"""Trie of the prefixes that rebuilt conversations share, by whole-sequence collapse.

Conversations that are equal from end to end are grouped into one weighted
sequence with the list of the conversations that end there; everything after
that works on distinct sequences. A sequence that is a proper prefix of another
falls out in an anti-join against the others' prefixes, so the rest are the
leaves; the sequences' prefixes, added up with their weights, are the nodes.

A prefix is known by 128 bits: the exclusive or of two 64-bit hashes of every
turn's SHA-256 digest together with its depth. That makes it a running
aggregate, and texts never travel: a turn is its digest and its length.

What is summed over subtrees needs no ancestor-descendant pairs. Each node
belongs to the leaf of smallest conversation below it, a leaf's own nodes are a
path that ends in it, and a subtree is the whole paths of the leaves in it,
less what the path of its top's own leaf has above that top.

Runs of turns and of paths are added up in chunks of bounded length, so that a
conversation of any length is spread over many tasks. The digest of an end list
is sequential by nature: the ids of a list are put in order and written into
pieces of text by many tasks, and one task hashes the pieces as they stream by.

Defined results: turns are ordered by turn, null first, ties by the digest of
role and text; repeated rows are turns of their own; null roles and texts are
empty; rows without a conv_id belong to no conversation; an empty table gives no
nodes; other columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from wordmine.operators.ids import dense_index
from wordmine.session import materialise

CHUNK = 512
PIECE = 1 << 16
KEY = ["depth", "k1", "k2"]
GROUP_OF = 100
HEADS = 6


def turns_in_order(conversations: DataFrame) -> DataFrame:
    """conv_id, place (from 0), digest of role and text, chars (code points of the text)."""
    role, text = (F.coalesce(F.col(c).cast("string"), F.lit("")) for c in ("role", "text"))
    said = F.concat(F.length(role).cast("string"), F.lit(":"), role, text)
    rows = conversations.filter("conv_id is not null").select(
        F.col("conv_id").cast("bigint").alias("conv_id"), F.col("turn").cast("bigint").alias("turn"),
        F.unhex(F.sha2(said, 256)).alias("digest"), F.length(text).cast("bigint").alias("chars"))
    return dense_index(rows, ["conv_id"], ["turn", "digest"], "place").drop("turn")


def _own_start(conv: Column) -> Column:
    """How many turns of its group's first conversation stand before a conversation's own: crc32(id) mod 6."""
    return (F.crc32(conv.cast("string").cast("binary")) % HEADS).cast("int")


def rebuild(turns: DataFrame) -> DataFrame:
    """conv_id, depth, digest, chars of the rebuilt conversations, and a row of depth 0 for each of them.

    A conversation begins with the first turns of its group's first one; the
    group is a hundred ids, so those few turns are copied a bounded number of times.
    """
    first = F.col("conv_id") - F.col("conv_id") % GROUP_OF
    head = F.struct("place", "digest", "chars")
    heads = (turns.filter((F.col("conv_id") == first) & (F.col("place") < HEADS - 1)).groupBy(F.col("conv_id").alias("first"))
             .agg(F.sort_array(F.collect_list(head)).alias("head")))
    convs = (turns.select("conv_id").distinct().withColumn("first", first).join(heads, "first", "left")
             .select("conv_id", F.coalesce(F.slice("head", 1, _own_start(F.col("conv_id"))), F.array()).alias("head")))
    copied = convs.select("conv_id", F.explode("head").alias("t")).select(
        "conv_id", (F.col("t.place") + 1).alias("depth"), "t.digest", "t.chars")
    shift = heads.select("first", F.size("head").alias("n_head"))
    skip = _own_start(F.col("conv_id"))
    own = (turns.withColumn("skip", skip).filter("place >= skip").withColumn("first", first).join(shift, "first", "left")
           .select("conv_id", (F.col("place") - F.col("skip") + F.least("skip", F.coalesce("n_head", F.lit(0))) + 1).alias("depth"),
                   "digest", "chars"))
    root = convs.select("conv_id", F.lit(0).cast("bigint").alias("depth"), F.lit(None).cast("binary").alias("digest"),
                        F.lit(0).cast("bigint").alias("chars"))
    return copied.unionByName(own).unionByName(root)


def running(rows: DataFrame, group: str, values: list[str], total, add) -> DataFrame:
    """``values`` replaced by their running totals by depth inside ``group``, the row's own included.

    Totals run inside chunks of ``CHUNK`` depths and over the chunks: no task
    has a whole group. ``rows`` is read twice and should be a written table.
    """
    chunked = rows.withColumn("_chunk", F.floor(F.col("depth") / CHUNK))
    inside = Window.partitionBy(group, "_chunk").orderBy("depth")
    before = Window.partitionBy(group).orderBy("_chunk").rowsBetween(Window.unboundedPreceding, -1)
    local = chunked.select(*[c for c in chunked.columns if c not in values], *[total(v).over(inside).alias(v) for v in values])
    chunks = chunked.groupBy(group, "_chunk").agg(*[total(v).alias(v) for v in values])
    earlier = (chunks.select(group, "_chunk", *[total(v).over(before).alias(f"_before_{v}") for v in values])
               .filter(F.col(f"_before_{values[0]}").isNotNull()))
    out = local.join(earlier, [group, "_chunk"], "left")
    return out.select(*[add(F.col(c), F.coalesce(f"_before_{c}", F.lit(0))).alias(c) if c in values else F.col(c) for c in rows.columns])


def prefixes(rebuilt: DataFrame) -> DataFrame:
    """conv_id, depth, key (k1, k2) and parent's key (p1, p2) of every prefix, chars of its last text."""
    hashed = rebuilt.select(
        "conv_id", "depth", "chars", F.when(F.col("depth") > 0, F.xxhash64("depth", "digest")).otherwise(0).alias("h1"),
        F.when(F.col("depth") > 0, F.xxhash64("digest", F.lit("second"), "depth")).otherwise(0).alias("h2"))
    hashed = materialise(hashed.withColumn("k1", F.col("h1")).withColumn("k2", F.col("h2")), "rebuilt")
    keyed = running(hashed, "conv_id", ["k1", "k2"], F.bit_xor, lambda a, b: a.bitwiseXOR(b))
    return keyed.select("conv_id", "depth", "k1", "k2", F.col("k1").bitwiseXOR(F.col("h1")).alias("p1"),
                        F.col("k2").bitwiseXOR(F.col("h2")).alias("p2"), "chars")


def _pieces_of_lists(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Ordered (key, conv_id) rows to pieces of the keys' lists: key, first id, text."""
    key, first, held, size = None, None, [], 0

    def piece():
        return pa.record_batch([[key[0]], [key[1]], [key[2]], [first], [",".join(held)]],
                               schema=pa.schema([("depth", pa.int64()), ("k1", pa.int64()), ("k2", pa.int64()), ("first", pa.int64()), ("ids", pa.string())]))

    for batch in batches:
        out = []
        for *of, conv in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            if of != key or size >= PIECE:
                if held:
                    out.append(piece())
                key, first, held, size = of, conv, [], 0
            held.append(str(conv))
            size += len(held[-1]) + 1
        if out:
            yield pa.Table.from_batches(out).combine_chunks().to_batches()[0]
    if held:
        yield piece()


def _digests_of_lists(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Ordered pieces to one digest a key; a list is never held whole."""
    key, digest = None, None

    def rows(done):
        columns = list(zip(*done, strict=True))
        return pa.record_batch([pa.array(c, t) for c, t in zip(columns, [pa.int64()] * 3 + [pa.string()], strict=True)], names=[*KEY, "ends_sha256"])

    for batch in batches:
        done = []
        for *of, _, ids in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            if of == key:
                digest.update(b",")
            else:
                if digest:
                    done.append((*key, digest.hexdigest()))
                key, digest = of, hashlib.sha256()
            digest.update(ids.encode())
        if done:
            yield rows(done)
    if digest:
        yield rows([(*key, digest.hexdigest())])


def end_digests(whole: DataFrame) -> DataFrame:
    """For each key of ``whole`` (conv_id, key): SHA-256 of its conv_ids, ascending, joined by commas."""
    n = int(whole.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    order = [*KEY, "conv_id"]
    pieces = (whole.select(*order).repartitionByRange(n, *order).sortWithinPartitions(*order)
              .mapInArrow(_pieces_of_lists, "depth bigint, k1 bigint, k2 bigint, first bigint, ids string"))
    return (pieces.repartition(n, *KEY).sortWithinPartitions(*KEY, "first")
            .mapInArrow(_digests_of_lists, "depth bigint, k1 bigint, k2 bigint, ends_sha256 string"))


def prefix_trie(conversations: DataFrame) -> DataFrame:
    """One row per node: conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256."""
    every = materialise(prefixes(rebuild(turns_in_order(conversations))), "prefixes")
    last = F.max(F.struct("depth", "k1", "k2")).alias("last")
    whole = materialise(every.groupBy("conv_id").agg(last).select("conv_id", "last.*"), "whole")
    sequences = (whole.groupBy(*KEY).agg(F.min("conv_id").alias("conv_id"), F.count(F.lit(1)).alias("weight"))
                 .withColumnRenamed("depth", "length"))
    distinct = materialise(every.join(sequences.select("conv_id", "weight", "length"), "conv_id"), "sequences")
    inner = distinct.filter("depth < length").select(*KEY).distinct()
    leaves = (distinct.filter("depth = length").join(inner, KEY, "left_anti").select("conv_id", F.lit(1).alias("leaf")))
    weighted = materialise(distinct.join(leaves, "conv_id", "left"), "weighted")
    nodes = materialise(
        weighted.groupBy(*KEY).agg(
            F.min("conv_id").alias("conv_id"), F.sum("weight").alias("n_convs"), F.count("leaf").alias("n_leaves"),
            F.min(F.when(F.col("leaf") == 1, F.col("conv_id"))).alias("owner"), F.max(F.struct("p1", "p2", "chars")).alias("_"))
        .select(*KEY, "conv_id", "n_convs", "n_leaves", "owner", "_.*")
        .withColumn("own", (F.col("n_convs") - 1) * F.col("chars")), "nodes")
    paths = nodes.groupBy(F.col("owner").alias("conv_id")).agg(F.sum("own").alias("path"))
    below = (weighted.filter("leaf = 1").select(*KEY, "conv_id").join(paths, "conv_id")
             .groupBy(*KEY).agg(F.sum("path").alias("paths")))
    upto = running(nodes.select(*KEY, "owner", "own"), "owner", ["own"], F.sum, lambda a, b: a + b)
    saved = (upto.select(*KEY, F.col("own").alias("upto")).join(below, KEY)
             .select(*KEY, (F.col("paths") - F.col("upto")).alias("rest")))
    children = (nodes.filter("depth > 0").groupBy((F.col("depth") - 1).alias("depth"), F.col("p1").alias("k1"), F.col("p2").alias("k2"))
                .agg(F.count(F.lit(1)).alias("n_children")))
    parents = nodes.select((F.col("depth") + 1).alias("depth"), F.col("k1").alias("p1"), F.col("k2").alias("p2"),
                           F.col("conv_id").alias("parent_conv_id"))
    out = (nodes.join(saved, KEY).join(children, KEY, "left").join(end_digests(whole), KEY, "left")
           .join(parents, ["depth", "p1", "p2"], "left"))
    return out.select(
        "conv_id", "depth", F.when(F.col("depth") > 0, F.col("parent_conv_id")).alias("parent_conv_id"), "n_convs",
        F.coalesce("n_children", F.lit(0)).cast("bigint").alias("n_children"), "n_leaves",
        (F.col("rest") + F.col("own")).cast("bigint").alias("saved_tokens"),
        F.coalesce("ends_sha256", F.sha2(F.lit(""), 256)).alias("ends_sha256"))
