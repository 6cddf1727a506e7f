"""N-gram Jaccard join by a size-aware heavy-light scheme, and the groups it links.

A document's set is that of its distinct word shingles, as 64-bit hashes. Equal
sets are one class. Two different sets of a and b shingles link when
``q * |intersection| >= p * |union|``, so they share at least
o(a, b) = ceil(p (a + b) / (p + q)) shingles.

Light: sets of at most x shingles name all their o-subsets for each size of a
partner up to x (by leaving out a - o shingles). Sets that name the same subset
for the same two sizes link; no pair is formed, each set gets an edge to the
smallest class of the other size.

Heavy: pairs with a larger set meet in inverted lists. A set is listed under
its first shingles in an order that puts rare ones first, so many that a linked
set must share one (prefix filter); shingles that no other set has need no list.
The order is by the logarithm of the document frequency, then by hash. To find
it, each block of documents (see ``blocks``) sends its shingles, cut to
``HASH_BITS`` bits, sorted and packed, to partitions of the hash range, which
count them and answer with the logarithms; any function of the hash gives a right
result, a good estimate of the frequency a fast one. Lists are scanned in
rounds: the member with the fewest rarer shingles leads its list and is compared
with the others, and members that are in one group by then need no comparison
among themselves. When few comparisons are left between groups, all of them are
made; lists that still have many after the last round are cut into chunks of
bounded size, and each two chunks are compared inside a task, which returns only
links that join groups. Sizes and places in the order bound the overlap and leave out pairs before
their texts are compared exactly.

x is the boundary with the least cost over the sizes that occur (``boundary``).

Defined results: null and empty texts have no shingles and link with nothing; a
text of fewer words than a shingle is one shingle; rows of one id are one
document (a row each is returned); rows without an id link with nothing and have
no component; an empty table gives no rows.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from itertools import combinations
from math import comb

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wordmine.llm import blocks
from wordmine.llm import textcells as T
from wordmine.llm.common import id_and_text, shared_uri
from wordmine.llm.components import connected_components
from wordmine.session import materialise

LIGHT_MOST = 48    # sets above this size are never light
HASH_BITS = 44     # of a shingle's hash, for its document frequency
WORDS_PER_BLOCK = 1 << 21
#: Shingle hashes that a task remembers of texts it has met in pairs.
KNOWN_HASHES = 1 << 20
#: Members of a chunk of a long list, and shingles of all their sets.
CHUNK_MEMBERS, CHUNK_SHINGLES = 1 << 10, 1 << 18
SETS = ("doc_id bigint, n bigint, sig binary, kept binary, block bigint, part int, m bigint, hashes binary, counts binary")
ANSWERS = "block bigint, part int, logs binary"
LISTED = "shingle bigint, rep bigint, n bigint, pos int"


def _finish(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def _sets_of_words(hashed: np.ndarray, offsets: np.ndarray, words_each: int) -> list[np.ndarray]:
    """Sorted distinct shingle hashes of each document from its words' hashes."""
    whole = np.full(max(len(hashed) - words_each + 1, 0), np.uint64(words_each))
    for k in range(words_each):
        whole = _finish(whole + hashed[k:k + len(whole)]) + np.uint64(k + 1)
    out = []
    for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist(), strict=True):
        if b - a >= words_each:
            out.append(np.unique(whole[a:b - words_each + 1]))
        elif b > a:
            h = np.full(1, np.uint64(b - a))
            for k in range(a, b):
                h = _finish(h + hashed[k:k + 1]) + np.uint64(k - a + 1)
            out.append(h)
        else:
            out.append(np.empty(0, np.uint64))
    return out


def _hashes(words: list) -> np.ndarray:
    import xxhash

    return np.fromiter((xxhash.xxh3_64_intdigest(w) for w in words), np.uint64, len(words))


def shingle_sets(texts: pa.Array, words_each: int) -> list[np.ndarray]:
    """Sorted distinct shingle hashes of each text."""
    offsets, index, words = T.ascii_words(texts, lower=True)
    return _sets_of_words(_hashes(T.strings(words))[index], offsets, words_each)


def block_sets(folder: str, block: int, words_each: int) -> Iterator[tuple[list, list[np.ndarray]]]:
    """(ids, sets) of a block's documents, in steps."""
    hashed = _hashes(blocks.read_words(folder, block))
    for ids, _, offsets, numbers in blocks.read_documents(folder, block):
        yield ids, _sets_of_words(hashed[numbers], offsets, words_each)


def prefix_length(n: int, p: int, q: int) -> int:
    return n - -(-n * p // q) + 1


def overlap(a: int, b: int, p: int, q: int) -> int:
    return -(-p * (a + b) // (p + q))


def partners(n: int, p: int, q: int) -> range:
    """Sizes of sets that a set of n may link with."""
    return range(-(-n * p // q), n * q // p + 1)


def light_rows(n: int, most: int, p: int, q: int) -> int:
    return sum(comb(n, n - overlap(n, b, p, q)) for b in partners(n, p, q)
               if b <= most and (b != n or overlap(n, n, p, q) < n) and overlap(n, b, p, q) <= n)


def boundary(sizes: dict[int, int], p: int, q: int) -> int:
    """The largest light size with the least cost, from the number of sets of each size up to LIGHT_MOST.

    A named subset is a row that is shuffled twice. A listed set costs half a row
    for each shingle that is counted, and each shingle of its prefix the scan of
    a list, taken as 8 rows.
    """
    def heavy(n):
        return n / 2 + 8 * prefix_length(n, p, q)

    def cost(x):
        return (sum(c * 2 * light_rows(n, x, p, q) for n, c in sizes.items() if n <= x)
                + sum(c * heavy(n) for n, c in sizes.items() if n * q // p > x))

    return min(range(1, LIGHT_MOST + 1), key=cost)


def _signature(h: np.ndarray) -> bytes:
    return hashlib.blake2b(h.tobytes(), digest_size=16).digest()


def _cut(h: np.ndarray) -> np.ndarray:
    return (h >> np.uint64(64 - HASH_BITS)).astype(np.int64)


def _batch(kinds: dict, rows: int, **columns) -> pa.RecordBatch:
    return pa.record_batch([pa.array(columns.get(c, [None] * rows), t) for c, t in kinds.items()], names=list(kinds))


_SETS = {"doc_id": pa.int64(), "n": pa.int64(), "sig": pa.binary(), "kept": pa.binary(), "block": pa.int64(), "part": pa.int32(),
         "m": pa.int64(), "hashes": pa.binary(), "counts": pa.binary()}


def _describe(folder: str, words_each: int, parts: int):
    """Blocks to a row (doc_id, n, sig, kept) for each document and packed rows of their shingles for the partitions."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block in (b for batch in batches for b in batch.column(0).to_pylist()):
            known, cut = set(), []
            for ids, sets in block_sets(folder, block, words_each):
                sigs = [_signature(h) for h in sets]
                yield _batch(_SETS, len(ids), doc_id=ids, n=[len(h) for h in sets], sig=sigs,
                             kept=[h.tobytes() if len(h) <= LIGHT_MOST else b"" for h in sets])
                for i, sig, h in zip(ids, sigs, sets, strict=True):
                    if i is not None and len(h) and sig not in known:
                        known.add(sig)
                        cut.append(_cut(h))
            if not cut:
                continue
            values, counts = np.unique(np.concatenate(cut), return_counts=True)
            ends = np.searchsorted(values, [-(-(p << HASH_BITS) // parts) for p in range(parts + 1)])
            rows = [(p, values[a:b], counts[a:b]) for p, (a, b) in enumerate(zip(ends[:-1].tolist(), ends[1:].tolist(), strict=True)) if b > a]
            yield _batch(_SETS, len(rows), block=[block] * len(rows), part=[r[0] for r in rows], m=[len(r[1]) for r in rows],
                         hashes=[blocks.pack_ascending(r[1]) for r in rows], counts=[blocks.pack(r[2]) for r in rows])

    return run


def _count(table: pa.Table) -> pa.Table:
    """A partition's packed hashes to the logarithm of each one's count over all blocks, for the blocks that asked."""
    rows = list(zip(*(table.column(c).to_pylist() for c in ("block", "part", "m", "hashes", "counts")), strict=True))
    hashes = [blocks.unpack_ascending(r[3], r[2]) for r in rows]
    every, at = np.unique(np.concatenate(hashes), return_inverse=True)
    total = np.bincount(at, np.concatenate([blocks.unpack(r[4], r[2]) for r in rows]), len(every))
    logs = np.split(np.log2(total).astype(np.uint8)[at], np.cumsum([r[2] for r in rows])[:-1])
    return pa.table([pa.array([r[0] for r in rows], pa.int64()), pa.array([r[1] for r in rows], pa.int32()),
                     pa.array([blocks.compressed(x.tobytes()) for x in logs], pa.binary())], names=["block", "part", "logs"])


def _list(folder: str, words_each: int, parts: int, most: int, p: int, q: int):
    """The answers to one block to the listed shingles of its sets, each set under the smallest id that has it there."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = pa.Table.from_batches(list(batches))
        block = table.column("block")[0].as_py()
        found: dict[bytes, tuple] = {}
        for ids, sets in block_sets(folder, block, words_each):
            for i, h in zip(ids, sets, strict=True):
                if len(h) and i is not None:
                    sig = _signature(h)
                    if sig not in found or i < found[sig][0]:
                        found[sig] = (i, h if sig not in found else found[sig][1])
        if not found:
            return
        ids, sets = zip(*found.values(), strict=True)
        cut = _cut(np.concatenate(sets))
        every, at = np.unique(cut, return_inverse=True)
        log = np.zeros(len(every), np.uint8)
        ends = np.searchsorted(every, [-(-(k << HASH_BITS) // parts) for k in range(parts + 1)])
        for part, data in zip(table.column("part").to_pylist(), table.column("logs").to_pylist(), strict=True):
            a, b = int(ends[part]), int(ends[part + 1])
            log[a:b] = np.frombuffer(pa.decompress(data, decompressed_size=b - a, codec="zstd", asbytes=True), np.uint8)
        log = log[at]
        out: list[list] = [[], [], [], []]
        begin = 0
        for i, h in zip(ids, sets, strict=True):
            n = len(h)
            rarity = log[begin:begin + n]
            begin += n
            if n * q // p <= most:
                continue
            order = np.lexsort((h, rarity))[:prefix_length(n, p, q)]
            pos = np.flatnonzero(rarity[order])
            for column, value in zip(out, (h[order[pos]].view(np.int64), np.full(len(pos), i), np.full(len(pos), n), pos), strict=True):
                column.append(value)
            if len(out[0]) >= 2000:
                yield _listed(out)
                out = [[], [], [], []]
        if out[0]:
            yield _listed(out)
        del cut, every, at, log, sets
        T.give_back()

    return run


def _listed(out: list[list]) -> pa.RecordBatch:
    shingle, rep, n, pos = (np.concatenate(x) for x in out)
    return pa.record_batch([pa.array(shingle), pa.array(rep), pa.array(n), pa.array(pos.astype(np.int32))], names=["shingle", "rep", "n", "pos"])


def _subsets(most: int, p: int, q: int):
    """Rows (rep, n, kept) to their subsets: (lo, hi, k1, k2, rep, n)."""
    names = ["lo", "hi", "k1", "k2", "rep", "n"]

    def run(batches):
        for batch in batches:
            for rep, n, kept in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                h = np.frombuffer(kept, np.uint64)
                one, two = _finish(h), _finish(h + np.uint64(0x51ED2701A5B4C3D9))
                for b in partners(n, p, q):
                    o = overlap(n, b, p, q)
                    if b > most or o > n or (b == n and o == n):
                        continue
                    gone = np.array(list(combinations(range(n), n - o)), np.int64).reshape(comb(n, o), n - o)
                    k1, k2 = one.sum() - one[gone].sum(1), two.sum() - two[gone].sum(1)
                    m = len(gone)
                    yield pa.record_batch([
                        pa.array(np.full(m, min(n, b))), pa.array(np.full(m, max(n, b))),
                        pa.array(k1.astype(np.uint64).view(np.int64)), pa.array(k2.astype(np.uint64).view(np.int64)),
                        pa.array(np.full(m, rep)), pa.array(np.full(m, n)),
                    ], names=names)

    return run


def light_edges(classes: DataFrame, most: int, p: int, q: int) -> DataFrame:
    """Edges between classes of at most ``most`` shingles, from their common subsets."""
    keys = ["lo", "hi", "k1", "k2"]
    named = (classes.filter(F.col("n") <= most).select("rep", "n", "kept")
             .mapInArrow(T.tidy(_subsets(most, p, q)), "lo bigint, hi bigint, k1 bigint, k2 bigint, rep bigint, n bigint"))
    least = (named.groupBy(*keys).agg(F.min(F.when(F.col("n") == F.col("lo"), F.col("rep"))).alias("of_lo"),
                                      F.min(F.when(F.col("n") == F.col("hi"), F.col("rep"))).alias("of_hi"), F.count(F.lit(1)).alias("c"))
             .filter("c > 1 and of_lo is not null and of_hi is not null"))
    met = named.join(least, keys).withColumn("b", F.when(F.col("n") == F.col("lo"), F.col("of_hi")).otherwise(F.col("of_lo")))
    return met.select(F.col("rep").alias("a"), "b").filter("a <> b").distinct()


def lower_words(texts: pa.Array):
    offsets, index, words = T.ascii_words(texts, lower=True)
    return offsets, index, T.strings(words)


def _may_link(a: str, b: str, p: int, q: int):
    """Whether sizes and places of a common listed shingle allow a link."""
    na, nb, pa_, pb = (F.col(x) for x in (f"{a}.n", f"{b}.n", f"{a}.pos", f"{b}.pos"))
    return (F.least(na, nb) * q >= F.greatest(na, nb) * p) & (F.least(na - pa_, nb - pb) * (p + q) >= (na + nb) * p)


def _linked(words_each: int, p: int, q: int):
    """Rows (a, b, text of a, text of b) to those that link."""

    def run(batches):
        known: dict = {}
        held = 0

        def sets(ids, texts):
            nonlocal held
            if held > KNOWN_HASHES:
                known.clear()
                held = 0
            new = {}
            for i, t in zip(ids, texts, strict=True):
                if (i, t) not in known:
                    new[i, t] = None
            if new:
                for key, h in zip(new, shingle_sets(pa.array([t for _, t in new], pa.string()), words_each), strict=True):
                    known[key] = h
                    held += len(h) + 16
            return [known[i, t] for i, t in zip(ids, texts, strict=True)]

        for batch in batches:
            for at in range(0, batch.num_rows, 100):
                a, b, ta, tb = (c.to_pylist() for c in batch.slice(at, 100).columns)
                keep = []
                for x, y in zip(sets(a, ta), sets(b, tb), strict=True):
                    both = len(np.intersect1d(x, y, assume_unique=True))
                    keep.append(q * both >= p * (len(x) + len(y) - both))
                yield pa.record_batch([pa.array(a, pa.int64()), pa.array(b, pa.int64())], names=["a", "b"]).filter(pa.array(keep, pa.bool_()))

    return run


def verified(pairs: DataFrame, texts: DataFrame, words_each: int, p: int, q: int) -> DataFrame:
    """The pairs (a, b) whose texts link; only the texts that are asked for are shuffled."""
    asked = pairs.select(F.explode(F.array("a", "b")).alias("doc_id")).distinct()
    needed = materialise(texts.join(asked, "doc_id", "left_semi"), "asked-texts")
    with_b = pairs.join(needed.select(F.col("doc_id").alias("b"), F.col("text").alias("tb")), "b")
    both = with_b.join(needed.select(F.col("doc_id").alias("a"), F.col("text").alias("ta")), "a")
    return both.select("a", "b", "ta", "tb").mapInArrow(T.tidy(_linked(words_each, p, q)), "a bigint, b bigint")


def _hashed_rows(words_each: int):
    """Rows (rep, text) to (rep, hashes), for texts that have shingles."""

    def run(batches):
        for batch in batches:
            for part, texts in T.text_slices(batch, most_bytes=1 << 20):
                sets = shingle_sets(texts, words_each)
                out = pa.record_batch([part.column(0), pa.array([h.tobytes() for h in sets], pa.binary())], names=["rep", "hashes"])
                yield out.filter(pa.array([len(h) > 0 for h in sets], pa.bool_()))

    return run


def _compare_chunks(p: int, q: int):
    """Two chunks of a list to links that join groups: at most one less than there are members."""

    def run(table: pa.Table) -> pa.Table:
        rep, n, pos, part, c, x = (table.column(k).to_numpy() for k in ("rep", "n", "pos", "part", "c", "x"))
        sets = [np.frombuffer(h, np.uint64) for h in table.column("hashes").to_pylist()]
        size = np.array([len(h) for h in sets])
        begin = np.cumsum(size) - size
        every, codes = np.unique(np.concatenate(sets), return_inverse=True)
        group = np.unique(part, return_inverse=True)[1]
        inside = table.column("x")[0] == table.column("y")[0]
        number, a, b = np.arange(len(rep)), [], []
        for i in np.flatnonzero(c == x):
            may = (number > i) if inside else (c != x)
            may &= (group != group[i]) & (np.minimum(n, n[i]) * q >= np.maximum(n, n[i]) * p)
            may &= np.minimum(n - pos, n[i] - pos[i]) * (p + q) >= (n + n[i]) * p
            if not may.any():
                continue
            of_i = np.zeros(len(every), bool)
            of_i[codes[begin[i]:begin[i] + size[i]]] = True
            both = np.add.reduceat(of_i[codes].astype(np.int64), begin)
            for j in np.flatnonzero(may & (q * both >= p * (size + size[i] - both))):
                if group[j] != group[i]:
                    a.append(rep[i])
                    b.append(rep[j])
                    group[group == group[j]] = group[i]
        return pa.table([pa.array(a, pa.int64()), pa.array(b, pa.int64())], names=["a", "b"])

    return run


def chunk_links(members: DataFrame, texts: DataFrame, words_each: int, p: int, q: int) -> DataFrame:
    """Links (a, b) between groups of each list's members, found between chunks of it.

    A member travels once for each chunk of its list, with its set; no row is
    made for a pair that does not link.
    """
    chunks = F.greatest(F.ceil(F.sum("n") / CHUNK_SHINGLES), F.ceil(F.count(F.lit(1)) / CHUNK_MEMBERS))
    dealt = (members.join(members.groupBy("shingle").agg(chunks.alias("chunks")), "shingle")
             .withColumn("c", F.pmod(F.xxhash64("rep", F.lit(29)), "chunks"))
             .withColumn("o", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("chunks") - 1))))
    placed = dealt.select("shingle", F.least("c", "o").alias("x"), F.greatest("c", "o").alias("y"), "c", "rep", "n", "pos", "part")
    asked = texts.join(members.select(F.col("rep").alias("doc_id")).distinct(), "doc_id", "left_semi").select("doc_id", "text")
    sets = materialise(asked.mapInArrow(T.tidy(_hashed_rows(words_each)), "rep bigint, hashes binary").distinct(), "list-sets")
    return (placed.join(sets, "rep").groupBy("shingle", "x", "y")
            .applyInArrow(_compare_chunks(p, q), "a bigint, b bigint").distinct())


def linked_groups(docs: DataFrame, p: int = 9, q: int = 10, words_each: int = 3, id_col: str = "doc_id",
                  text_col: str = "text", rounds: int = 6) -> DataFrame:
    """doc_id, n_shingles, component_id: a row for each row of ``docs``.

    Two documents link when q * intersection >= p * union of their sets of
    shingles of ``words_each`` words; component_id is the smallest id that links
    reach. Lists are led by single members for at most ``rounds`` rounds before
    all comparisons that are left are made, between chunks if they are many.
    """
    spark = docs.sparkSession
    texts = id_and_text(docs, id_col, text_col)
    store, parts_n = shared_uri(spark, "shingle-blocks"), blocks.default_parts(spark)
    blocks.write_blocks(texts.withColumn("train", F.lit(True)), lower_words, store, parts_n, WORDS_PER_BLOCK)
    n_tasks = int(spark.conf.get("spark.sql.shuffle.partitions"))
    described = materialise(blocks.block_ids(spark, store, n_tasks)
                            .mapInArrow(T.tidy(_describe(store, words_each, parts_n)), SETS), "shingle-sets")
    sets = described.filter("sig is not null").select("doc_id", "n", "sig", "kept")
    usable = sets.filter("n > 0 and doc_id is not null")
    classes = materialise(usable.groupBy("sig").agg(F.min("doc_id").alias("rep"), F.first("n").alias("n"), F.first("kept").alias("kept")), "shingle-classes")
    sizes = {r["n"]: r["c"] for r in classes.filter(F.col("n") <= LIGHT_MOST * q // p).groupBy("n").agg(F.count(F.lit(1)).alias("c")).collect()}
    most = boundary(sizes, p, q)
    edges = materialise(light_edges(classes, most, p, q), "light-links")
    asked = described.filter("part is not null").select("block", "part", "m", "hashes", "counts")
    answers = asked.groupBy("part").applyInArrow(_count, ANSWERS)
    listed = materialise(answers.groupBy("block").applyInArrow(_list(store, words_each, parts_n, most, p, q), LISTED), "listed")
    # a class is listed where its smallest id is
    lists = materialise(listed.join(classes.select("rep"), "rep", "left_semi"), "inverted-lists")
    parts = connected_components(edges)

    for number in range(rounds + 1):
        # lists whose members are in more than one group
        placed = lists.join(parts.select(F.col("node").alias("rep"), "component"), "rep", "left")
        placed = placed.select("shingle", "rep", "n", "pos", F.coalesce("component", "rep").alias("part"))
        open_lists = (placed.groupBy("shingle").agg(F.min("part").alias("x"), F.max("part").alias("y"), F.count(F.lit(1)).alias("m"),
                                                    F.min(F.struct("pos", "rep", "n", "part")).alias("lead")).filter("x <> y"))
        open_lists = materialise(open_lists.select("shingle", "m", "lead"), "open-lists")
        rows, left = open_lists.agg(F.sum("m"), F.sum(F.col("m") * (F.col("m") - 1) / 2)).first()
        if not rows:
            break
        few = left <= 2 * rows
        last = number == rounds or few
        members = materialise(placed.join(open_lists.select("shingle", "lead"), "shingle"), "list-members")
        if last and not few:
            edges = materialise(edges.unionByName(chunk_links(members.drop("lead"), texts, words_each, p, q)), "links")
            parts = connected_components(edges)
            break
        if last:
            a, b = members.alias("a"), members.alias("b")
            pairs = a.join(b, (F.col("a.shingle") == F.col("b.shingle")) & (F.col("a.rep") < F.col("b.rep"))
                           & (F.col("a.part") != F.col("b.part")) & _may_link("a", "b", p, q))
            pairs = pairs.select(F.col("a.rep").alias("a"), F.col("b.rep").alias("b"))
        else:
            rows = members.select("shingle", F.struct("rep", "n", "pos", "part").alias("b"), F.col("lead").alias("a"))
            pairs = rows.filter((F.col("a.rep") != F.col("b.rep")) & (F.col("a.part") != F.col("b.part")) & _may_link("a", "b", p, q))
            pairs = pairs.select(F.col("a.rep").alias("a"), F.col("b.rep").alias("b"))
            # the leader has been compared with all members: it leaves the list
            lists = members.filter(F.col("lead.rep") != F.col("rep")).select("shingle", "rep", "n", "pos")
        new = verified(materialise(pairs.distinct(), "list-pairs"), texts, words_each, p, q)
        edges = materialise(edges.unionByName(new), "links")
        parts = connected_components(edges)
        if last:
            break

    of_class = (classes.select("sig", "rep").join(parts.withColumnRenamed("node", "rep"), "rep", "left")
                .select("sig", F.coalesce("component", "rep").alias("component_id"), F.lit(True).alias("known")))
    out = sets.select("doc_id", F.col("n").alias("n_shingles"), "sig").join(of_class, "sig", "left")
    linked = F.col("known") & (F.col("n_shingles") > 0) & F.col("doc_id").isNotNull()
    return out.select("doc_id", "n_shingles", F.when(linked, F.col("component_id")).otherwise(F.col("doc_id")).alias("component_id"))
