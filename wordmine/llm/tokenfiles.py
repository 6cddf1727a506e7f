"""Token-id files: documents in ascending id order, ids in Simple-8b words.

``write_token_files`` range-partitions the documents by id, encodes the texts
and writes files of a bounded number of ids into a folder that all executors
reach; the job's rows are the files' manifest, kept as Parquet in the same
folder. ``read_token_files`` deals the manifest out and decodes the files.

A file, all numbers little-endian 64-bit:
  magic, documents, ids, blocks, words (unsigned)
  id of each document (signed) and, after all of them, its validity (0 or 1)
  number of ids of each document
  first word of each block
  Simple-8b words

Files are named by range partition and number, so their order is that of the
documents, and a task that runs again writes the same files again. A file
becomes visible by a rename.

Defined results: a null text is an empty one (only the end id); null ids come
first; repeated rows and ties of the id are kept, ordered by the text's hash; an
empty table gives no files; other columns are ignored.
"""

from __future__ import annotations

import io
import uuid

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from wordmine.llm import simple8b
from wordmine.llm import textcells as T
from wordmine.llm.common import id_and_text

MAGIC = int.from_bytes(b"S8BTOKEN", "little")
MANIFEST = "part bigint, number bigint, file string, documents bigint, ids bigint, bytes bigint"
ROWS = "doc_id bigint, start bigint, n_tokens bigint, ids binary"


def _open(folder: str):
    """(file system, path) of a folder given as a URI or a local path."""
    from pyarrow import fs

    if folder.startswith("file:"):
        return fs.LocalFileSystem(), "/" + folder[5:].lstrip("/")
    return fs.FileSystem.from_uri(folder) if "://" in folder else (fs.LocalFileSystem(), folder)


def file_bytes(doc_ids: list, lengths: np.ndarray, ids: np.ndarray) -> bytes:
    words, offsets = simple8b.encode(ids)
    head = np.array([MAGIC, len(doc_ids), len(ids), len(offsets), len(words)], "<u8")
    out = io.BytesIO()
    out.write(head.tobytes())
    out.write(np.array([d or 0 for d in doc_ids], "<i8").tobytes())
    out.write(np.array([d is not None for d in doc_ids], "<i8").tobytes())
    out.write(lengths.astype("<i8").tobytes())
    out.write(offsets.astype("<i8").tobytes())
    out.write(words.astype("<u8").tobytes())
    return out.getvalue()


def parse_file(data: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(document ids, their validity, their numbers of ids, all ids) of a file."""
    numbers = np.frombuffer(data, "<i8")
    magic, docs, n, blocks, n_words = numbers[:5].tolist()
    if magic != MAGIC or len(numbers) != 5 + 3 * docs + blocks + n_words:
        raise ValueError("not a whole token file")
    doc_ids, valid, lengths, offsets, words = np.split(numbers[5:], np.cumsum([docs, docs, docs, blocks]))
    return doc_ids, valid.astype(bool), lengths, simple8b.decode(words.view("<u8"), offsets, n)


def _writer(folder, vocabulary, end_id, file_ids):
    def run(batches):
        bpe = T.once(T.WordBpe, vocabulary)
        system, path = _open(folder)
        part = TaskContext.get().partitionId()
        doc_ids, lengths, ids, held, number = [], [], [], 0, 0

        def write():
            name = f"tokens-{part:08d}-{number:06d}.s8b"
            data = file_bytes(doc_ids, np.concatenate(lengths), np.concatenate(ids))
            hidden = f"{path}/.{name}-{uuid.uuid4().hex[:8]}"
            with system.open_output_stream(hidden) as f:
                f.write(data)
            system.move(hidden, f"{path}/{name}")
            return pa.record_batch([[part], [number], [name], [len(doc_ids)], [held], [len(data)]],
                                   names=[x.split()[0] for x in MANIFEST.split(", ")])

        for batch in batches:
            for rows, texts in T.text_slices(batch):
                body, offsets = bpe.encode_texts(texts)
                n = np.diff(offsets) + 1
                all_ids = np.empty(len(body) + len(n), np.uint32)
                inside = np.ones(len(all_ids), bool)
                inside[np.cumsum(n) - 1] = False
                all_ids[inside], all_ids[~inside] = body, end_id
                doc_ids += rows.column(0).to_pylist()
                lengths.append(n)
                ids.append(all_ids)
                held += len(all_ids)
                if held >= file_ids:
                    yield write()
                    doc_ids, lengths, ids, held, number = [], [], [], 0, number + 1
        if doc_ids:
            yield write()

    return run


def write_token_files(docs: DataFrame, folder: str, vocabulary: str, end_id: int = 1, file_ids: int = 1 << 21,
                      id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Write the documents' ids below ``folder`` and return the manifest, one row per file.

    ``vocabulary`` is a word-end BPE file; ``end_id`` closes each document. A
    file holds whole documents, about ``file_ids`` ids (a longer document has a
    file of its own).
    """
    system, path = _open(folder)
    system.create_dir(path, recursive=True)
    ordered = (id_and_text(docs, id_col, text_col)
               .withColumn("_tie", F.xxhash64("text"))
               # rows of one id, or without one, are dealt out by their texts
               .repartitionByRange("doc_id", "_tie").sortWithinPartitions("doc_id", "_tie").drop("_tie"))
    files = ordered.mapInArrow(T.tidy(_writer(folder, vocabulary, end_id, file_ids)), MANIFEST)
    files.write.mode("overwrite").parquet(f"{folder}/manifest")
    return docs.sparkSession.read.parquet(f"{folder}/manifest")


def _reader(folder):
    def run(batches):
        system, path = _open(folder)
        for batch in batches:
            for file, before in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                with system.open_input_stream(f"{path}/{file}") as f:
                    doc_ids, valid, lengths, ids = parse_file(f.read())
                data, ends = ids.astype("<u4").tobytes(), np.cumsum(lengths)
                starts = ends - lengths
                yield pa.record_batch([
                    pa.array(doc_ids, pa.int64(), mask=~valid), pa.array(before + starts), pa.array(lengths),
                    pa.array([data[4 * a:4 * b] for a, b in zip(starts.tolist(), ends.tolist(), strict=True)], pa.binary()),
                ], names=[x.split()[0] for x in ROWS.split(", ")])

    return run


def read_token_files(spark: SparkSession, folder: str) -> DataFrame:
    """The documents of a folder: doc_id, start (ids of all documents before it), n_tokens, ids.

    ``ids`` are little-endian unsigned 32-bit integers. Starts come from the
    manifest: the sums of the files are added up by partition first, so only one
    row per range partition meets in one task.
    """
    files = spark.read.parquet(f"{folder}/manifest")
    parts = files.groupBy("part").agg(F.sum("ids").alias("part_ids"))
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    parts = parts.select("part", F.coalesce(F.sum("part_ids").over(before), F.lit(0)).alias("part_start"))
    inside = Window.partitionBy("part").orderBy("number").rowsBetween(Window.unboundedPreceding, -1)
    starts = (files.withColumn("inside", F.coalesce(F.sum("ids").over(inside), F.lit(0))).join(parts, "part")
              .select("file", (F.col("part_start") + F.col("inside")).alias("before")))
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    return starts.repartition(n, "file").mapInArrow(_reader(folder), ROWS)
