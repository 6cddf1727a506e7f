"""Blocks: documents stored as word numbers of a dictionary of their own.

An operator that looks every word of a corpus up in a table that grows with the
corpus would have to shuffle every occurrence. Instead the documents of a task
are cut into blocks of bounded size, and each block's distinct words get numbers
(most frequent first). Only the dictionaries travel, dealt out by a hash of the
word: a row packs the words that a block sends to one part. The occurrences stay, as numbers, in a Parquet folder per
block below the cluster's shared folder; the task that gathers what the table
says about a block's words reads the block's documents there.

Blocks are fixed when the table is written, so nothing that reads it depends on
how the documents were split into tasks, and a task that runs again finds the
same blocks.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wordmine.llm import textcells as T

SCHEMA = "block bigint, doc_id bigint, train boolean, index binary, part int, n bigint, numbers binary, sizes binary, words binary, counts binary"
_DOC_ROWS = 1000


def compressed(data: bytes) -> bytes:
    return pa.compress(data, codec="zstd", asbytes=True)


def pack(values: np.ndarray) -> bytes:
    """Whole numbers, byte plane by byte plane, compressed."""
    planes = np.ascontiguousarray(np.asarray(values, "<i8").view(np.uint8).reshape(-1, 8).T)
    return compressed(planes.tobytes())


def _planes(values: np.ndarray) -> bytes:
    """32-bit numbers as their lowest bytes, their second bytes and so on: short under compression."""
    return np.ascontiguousarray(values.view(np.uint8).reshape(-1, 4).T).tobytes()


def pack_ascending(values: np.ndarray) -> bytes:
    return pack(np.diff(values, prepend=0))


def unpack_ascending(data: bytes, n: int) -> np.ndarray:
    return np.cumsum(unpack(data, n))


def unpack(data: bytes, n: int) -> np.ndarray:
    if not n:
        return np.empty(0, np.int64)
    planes = np.frombuffer(pa.decompress(data, decompressed_size=8 * n, codec="zstd", asbytes=True), np.uint8)
    return np.ascontiguousarray(planes.reshape(8, n).T).view("<i8")[:, 0]


class _Block:
    def __init__(self):
        self.numbers: dict[str, int] = {}
        self.index, self.sizes, self.doc_ids, self.train = [], [], [], []
        self.held = 0

    def add(self, offsets, index, words, doc_ids, train):
        numbers = self.numbers
        for w in words:
            if w not in numbers:
                numbers[w] = len(numbers)
        as_block = np.fromiter((numbers[w] for w in words), np.int32, len(words))
        self.index.append(as_block[index])
        self.sizes.append(np.diff(offsets))
        self.doc_ids += doc_ids
        self.train += train
        self.held += len(index)

    def rows(self, block: int, parts: int, count_train: bool) -> Iterator[pa.RecordBatch]:
        import xxhash

        index, sizes = np.concatenate(self.index), np.concatenate(self.sizes)
        known, n_words = list(self.numbers), len(self.numbers)
        self.index, self.numbers = [], {}  # what is not needed any more goes first
        of_train = index[np.repeat(np.array(self.train, bool), sizes)] if count_train else index
        order = np.argsort(-np.bincount(index, minlength=n_words), kind="stable")
        rank = np.empty(len(order), np.int32)
        rank[order] = np.arange(len(order))
        counts = np.bincount(of_train, minlength=len(order))[order]
        ranked, ends = rank[index].astype("<i4"), np.cumsum(sizes)
        del index, of_train, rank
        begins = ends - sizes
        for at in range(0, len(sizes), _DOC_ROWS):
            part = slice(at, at + _DOC_ROWS)
            n = len(self.doc_ids[part])
            yield _batch(block, n, doc_id=self.doc_ids[part], train=self.train[part],
                         index=[_planes(ranked[a:b]) for a, b in zip(begins[part].tolist(), ends[part].tolist(), strict=True)])
        del ranked
        words = [known[k].encode() for k in order.tolist()]
        del known
        part = np.fromiter((xxhash.xxh3_64_intdigest(w) % parts for w in words), np.int64, len(words))
        by_part = np.argsort(part, kind="stable")
        cuts = np.flatnonzero(np.diff(part[by_part], prepend=-1))
        out: dict[str, list] = {c: [] for c in ("part", "n", "numbers", "sizes", "words", "counts")}
        for of in np.split(by_part, cuts[1:]):
            mine = [words[k] for k in of.tolist()]
            for column, value in zip(out.values(), (int(part[of[0]]), len(of), pack_ascending(of), pack(np.fromiter(map(len, mine), np.int64, len(mine))),
                                                    compressed(b"".join(mine)), pack(counts[of]) if count_train else None), strict=True):
                column.append(value)
        yield _batch(block, len(out["part"]), **out)
        pa.default_memory_pool().release_unused()


_TYPES = {"block": pa.int64(), "doc_id": pa.int64(), "train": pa.bool_(), "index": pa.binary(), "part": pa.int32(), "n": pa.int64(),
          "numbers": pa.binary(), "sizes": pa.binary(), "words": pa.binary(), "counts": pa.binary()}


def _batch(block: int, rows: int, **columns) -> pa.RecordBatch:
    columns["block"] = [block] * rows
    return pa.record_batch([pa.array(columns.get(c, [None] * rows), t) for c, t in _TYPES.items()], names=list(_TYPES))


def _cutter(split, words_per_block: int, parts: int, count_train: bool):
    def run(batches):
        part, number, block = TaskContext.get().partitionId(), 0, _Block()
        for batch in batches:
            for rows, texts in T.text_slices(batch):
                block.add(*split(texts), rows.column(0).to_pylist(), rows.column(2).to_pylist())
                if block.held >= words_per_block:
                    yield from block.rows((part << 24) + number, parts, count_train)
                    number, block = number + 1, _Block()
        if block.doc_ids:
            yield from block.rows((part << 24) + number, parts, count_train)

    return run


def write_blocks(docs: DataFrame, split, folder: str, parts: int, words_per_block: int = 1 << 22, count_train: bool = False) -> None:
    """Write ``docs`` (doc_id, text, train) as blocks below ``folder``, a Parquet folder per block.

    ``split(texts)`` gives (offsets, index, words) of an array of texts. A block
    closes at ``words_per_block`` words; a document is never cut. ``parts`` is
    the number of parts that the words are dealt to; a part meets in one task.
    """
    rows = docs.select("doc_id", "text", "train").mapInArrow(T.tidy(_cutter(split, words_per_block, parts, count_train)), SCHEMA)
    (rows.withColumn("kind", F.when(F.col("part").isNull(), "docs").otherwise("words"))
     .write.partitionBy("kind", "block").option("compression", "zstd").parquet(folder))


def default_parts(spark) -> int:
    """Three times the session's shuffle partitions, so that parts spread evenly over tasks."""
    return 3 * int(spark.conf.get("spark.sql.shuffle.partitions"))


def block_words(spark, folder: str) -> DataFrame:
    """Packed rows (block, part, n, numbers, sizes, words, counts) of the blocks' dictionaries."""
    rows = spark.read.schema(SCHEMA + ", kind string").parquet(folder).filter("kind = 'words'")
    return rows.select("block", "part", "n", "numbers", "sizes", "words", "counts")


class PartWords:
    """The words of a part: distinct ones, and for each packed row its block, numbers and places among them."""

    def __init__(self, table: pa.Table):
        blocks, sizes, data, numbers, counts = [], [], [], [], []
        for block, n, number, size, words, count in zip(*(table.column(c).to_pylist() for c in ("block", "n", "numbers", "sizes", "words", "counts")), strict=True):
            blocks.append(block)
            numbers.append(unpack_ascending(number, n))
            sizes.append(unpack(size, n))
            data.append(pa.decompress(words, decompressed_size=int(sizes[-1].sum()), codec="zstd", asbytes=True))
            counts.append(unpack(count, n) if count is not None else None)
        offsets = np.concatenate([[0], *sizes]).cumsum().astype(np.int64)
        words = pa.Array.from_buffers(pa.large_binary(), len(offsets) - 1, [None, pa.py_buffer(offsets.tobytes()), pa.py_buffer(b"".join(data))])
        coded = words.dictionary_encode()
        self.words = coded.dictionary.cast(pa.large_string())
        cuts = np.cumsum([len(n) for n in numbers])[:-1]
        places = np.split(coded.indices.to_numpy(), cuts)
        self.rows = list(zip(blocks, numbers, places, counts, strict=True))


def block_ids(spark, folder: str, tasks: int) -> DataFrame:
    """The numbers of all blocks, a row each, dealt out evenly to ``tasks`` tasks.

    Dealt in turn, not by a key: by their key the rows would stay where
    ``distinct`` left them, in as few tasks as their few bytes ask for.
    """
    rows = spark.read.schema(SCHEMA + ", kind string").parquet(folder).filter("kind = 'words'")
    return rows.select("block").distinct().repartition(tasks)


def read_words(folder: str, block: int) -> list[bytes]:
    """Inside a task: the words of a block in the order of their numbers."""
    import pyarrow.dataset as ds

    from wordmine.llm.tokenfiles import _open

    system, path = _open(f"{folder}/kind=words/block={block}")
    table = ds.dataset(path, filesystem=system, format="parquet").to_table(columns=["n", "numbers", "sizes", "words"], use_threads=False)
    words: list[bytes] = [b""] * sum(table.column("n").to_pylist())
    for n, numbers, sizes, data in zip(*(table.column(c).to_pylist() for c in table.column_names), strict=True):
        ends = np.cumsum(unpack(sizes, n))
        raw = pa.decompress(data, decompressed_size=int(ends[-1]), codec="zstd", asbytes=True)
        for k, a, b in zip(unpack_ascending(numbers, n).tolist(), [0, *ends[:-1].tolist()], ends.tolist(), strict=True):
            words[k] = raw[a:b]
    return words


def read_documents(folder: str, block: int, rows: int = _DOC_ROWS) -> Iterator[tuple[list, list, np.ndarray, np.ndarray]]:
    """Inside a task: (doc ids, train flags, offsets, word numbers) of a block's documents, in steps."""
    import pyarrow.dataset as ds

    from wordmine.llm.tokenfiles import _open

    system, path = _open(f"{folder}/kind=docs/block={block}")
    found = ds.dataset(path, filesystem=system, format="parquet")
    for batch in found.to_batches(columns=["doc_id", "train", "index"], batch_size=rows, batch_readahead=1, fragment_readahead=1, use_threads=False):
        if batch.num_rows:
            raw = batch.column(2).to_pylist()
            sizes = np.fromiter(map(len, raw), np.int64, len(raw)) // 4
            numbers = [np.ascontiguousarray(np.frombuffer(r, np.uint8).reshape(4, -1).T).view("<i4")[:, 0] for r in raw if r]
            yield (batch.column(0).to_pylist(), batch.column(1).to_pylist(), np.concatenate([[0], np.cumsum(sizes)]),
                   np.concatenate([np.empty(0, np.int32), *numbers]))
