"""Byte-level BPE over a corpus: each distinct word of the corpus is encoded once.

Texts are cut before single spaces between two non-space characters, where the
pre-token pattern always cuts; the stretches (a pre-token, or a few that stand
together) are the words. Their distinct forms are shuffled with their places
(``blocks``), encoded, and the ids are joined back to the blocks; a block's
documents are put together by position. Decoding looks every id up in the
table of the tokens' bytes, whose size is the vocabulary's.

Defined results: a null text is an empty one and has no ids; null document ids
and repeated rows are kept, a row each; an empty table gives no rows; other
columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wordmine.llm import blocks
from wordmine.llm import textcells as T
from wordmine.llm.common import id_and_text

ENCODED = "block bigint, n bigint, n_ids bigint, numbers binary, lengths binary, ids binary"
ROWS = "doc_id bigint, n_tokens bigint, ids binary"


def _encode_words(path: str, pattern: str):
    """The words of one part to packed rows for the blocks; each distinct word is encoded once."""

    def run(table: pa.Table) -> pa.Table:
        part = blocks.PartWords(table)
        # a part has each word once: nothing is worth remembering for the next part
        flat, starts, lengths = T.once(T.ByteBpe, path, pattern, 1).encode_chunks(T.strings(part.words))
        out: dict[str, list] = {c.split()[0]: [] for c in ENCODED.split(", ")}
        for block, numbers, places, _ in part.rows:
            ids, _ = T.gather_ragged(flat, starts, lengths, places)
            row = (block, len(numbers), len(ids), blocks.pack_ascending(numbers), blocks.pack(lengths[places]), blocks.pack(ids))
            for column, value in zip(out.values(), row, strict=True):
                column.append(value)
        types = [pa.int64()] * 3 + [pa.binary()] * 3
        return pa.table([pa.array(v, t) for v, t in zip(out.values(), types, strict=True)], names=list(out))

    return run


def _reassemble(folder: str):
    """The packed words of one block to the rows of its documents."""

    def column(table, name, size):
        unpack = blocks.unpack_ascending if name == "numbers" else blocks.unpack
        return np.concatenate([unpack(v, n) for v, n in zip(table.column(name).to_pylist(), table.column(size).to_pylist(), strict=True)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = pa.Table.from_batches(list(batches))
        block = table.column("block")[0].as_py()
        number, length, flat = column(table, "numbers", "n"), column(table, "lengths", "n"), column(table, "ids", "n_ids")
        flat = flat.astype("<u4")
        starts, lengths = np.zeros(len(number), np.int64), np.zeros(len(number), np.int64)
        starts[number], lengths[number] = np.cumsum(length) - length, length
        del table, number, length
        for doc_ids, _, offsets, index in blocks.read_documents(folder, block):
            ids, ends = T.gather_ragged(flat, starts, lengths, index)
            ends = np.concatenate([[0], ends])[offsets]
            data = ids.tobytes()
            yield pa.record_batch([
                pa.array(doc_ids, pa.int64()), pa.array(np.diff(ends)),
                pa.array([data[4 * a:4 * b] for a, b in zip(ends[:-1].tolist(), ends[1:].tolist(), strict=True)], pa.binary()),
            ], names=["doc_id", "n_tokens", "ids"])

    return run


def encode_documents(docs: DataFrame, folder: str, vocabulary: str, pattern: str,
                     id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Ids of every text: doc_id, n_tokens, ids (little-endian unsigned 32-bit integers).

    ``vocabulary`` is a rank file, ``pattern`` its pre-token pattern and
    ``folder`` a new folder that all executors reach.
    """
    spark = docs.sparkSession
    texts = id_and_text(docs, id_col, text_col).withColumn("train", F.lit(True))
    blocks.write_blocks(texts, T.space_chunks, folder, blocks.default_parts(spark))
    words = blocks.block_words(spark, folder).select("block", "part", "n", "numbers", "sizes", "words", "counts")
    encoded = words.groupBy("part").applyInArrow(_encode_words(vocabulary, pattern), ENCODED)
    return encoded.groupBy("block").applyInArrow(_reassemble(folder), ROWS)


class TokenBytes:
    """The table of the tokens' bytes, and one of their decimal numbers, for vectorised look-ups."""

    def __init__(self, path: str):
        ranks = T.byte_ranks(path)
        tokens = [b""] * (max(ranks.values()) + 1)
        for token, i in ranks.items():
            tokens[i] = token
        self.tokens = self._flat(tokens)
        self.decimals = self._flat([b" %d" % i for i in range(len(tokens))])

    @staticmethod
    def _flat(values: list[bytes]):
        lengths = np.fromiter(map(len, values), np.int64, len(values))
        return np.frombuffer(b"".join(values), np.uint8), np.cumsum(lengths) - lengths, lengths

    def look_up(self, table, ids: np.ndarray, offsets: np.ndarray) -> list[bytes]:
        """For each slice of ids, its entries' bytes one after the other."""
        out = []
        for a, b in _runs(offsets, 1 << 20):
            part = ids[offsets[a]:offsets[b]]
            data, ends = T.gather_ragged(*table, part)
            at = np.concatenate([[0], ends])[offsets[a:b + 1] - offsets[a]].tolist()
            data = data.tobytes()
            out += [data[x:y] for x, y in zip(at[:-1], at[1:], strict=True)]
        return out


def _runs(offsets: np.ndarray, most: int):
    """Consecutive ranges of slices of about ``most`` entries (a longer slice alone)."""
    a = 0
    while a < len(offsets) - 1:
        b = max(a + 1, int(np.searchsorted(offsets, offsets[a] + most, side="right")) - 1)
        yield a, b
        a = b


def _decoder(path: str, digest: str | None):
    import hashlib

    def run(batches):
        table = T.once(TokenBytes, path)
        for batch in batches:
            for at in range(0, batch.num_rows, 200):
                part = batch.slice(at, 200)
                raw = part.column(part.schema.get_field_index("ids")).to_pylist()
                offsets = np.cumsum([0, *(len(x or b"") // 4 for x in raw)])
                ids = np.frombuffer(b"".join(x or b"" for x in raw), "<u4").astype(np.int64)
                part = part.append_column("decoded", pa.array(table.look_up(table.tokens, ids, offsets), pa.binary()))
                if digest:
                    texts = table.look_up(table.decimals, ids, offsets)
                    part = part.append_column(digest, pa.array([hashlib.sha256(x[1:]).hexdigest() for x in texts], pa.string()))
                yield part

    return run


def decode_documents(encoded: DataFrame, vocabulary: str, digest: str | None = None) -> DataFrame:
    """Adds ``decoded``, the bytes of the ids' tokens.

    ``digest``, if given, names a further column: the SHA-256 of the decimal ids
    joined by one space.
    """
    schema = encoded.schema.simpleString()[7:-1].replace(":", " ") + ", decoded binary" + (f", {digest} string" if digest else "")
    return encoded.mapInArrow(_decoder(vocabulary, digest), schema)
