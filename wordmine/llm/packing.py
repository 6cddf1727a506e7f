"""Order-preserving packing of tokenised documents into fixed-size sequences.

The documents are put in id order by one range shuffle; each range partition is
one stream of token ids. A dynamic program chooses where to cut the stream:

    f(j) = min over i with pos[j] - size <= pos[i] < pos[j] of
           f(i) + (size - (pos[j] - pos[i])) + penalty[j]

Cut places are document ends (no penalty), sentence ends and, where both are
far apart, places inside a sentence (truncation penalties). As the padding is
linear in pos[i], the minimum over the window is that of f(i) + pos[i], kept in
a monotone queue: linear time. Partitions are planned in pieces of bounded
size; what follows the last settled cut of a piece opens the next one, so only
a partition's end pays for the border.

Defined results: a null text is an empty one (its only token is the end id);
null ids and repeated rows are kept, each row being a document of its own; ties
of the id are ordered by the text's hash; an empty table gives no rows; other
columns of the input are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wordmine.llm import textcells as T
from wordmine.llm.common import id_and_text

SCHEMA = "doc_id bigint, start bigint, length bigint, doc_tokens bigint, sequence_id bigint, offset bigint, ids binary"


def choose_cuts(pos: list[int], penalty: list[float], size: int, last_cost=None) -> list[int]:
    """Indexes into ``pos`` of the cheapest cuts of the stream 0..pos[-1].

    ``pos`` ascends strictly and starts after 0; no gap may exceed ``size``.
    The last place is always a cut; ``last_cost(n)`` is what a last sequence of
    n tokens costs (its padding, if not given).
    """
    back, cost = [0] * len(pos), [0.0] * (len(pos) + 1)  # cost[j] = f(j); cost[-1] = f(start)
    queue_pos, queue_key, queue_at = [0], [0.0], [-1]
    head = 0
    for j, p in enumerate(pos):
        while queue_pos[head] < p - size:
            head += 1
        back[j] = queue_at[head]
        key = queue_key[head] + size + penalty[j]  # = f(j) + pos[j]
        cost[j] = key - p
        while len(queue_key) > head and queue_key[-1] >= key:
            queue_key.pop()
            queue_pos.pop()
            queue_at.pop()
        if len(queue_key) < head:
            head = len(queue_key)
        queue_key.append(key)
        queue_pos.append(p)
        queue_at.append(j)
    cuts, j = [], len(pos) - 1
    if last_cost:
        begins = [*(k for k in range(len(pos) - 1) if pos[k] >= pos[j] - size), *([-1] if pos[j] <= size else [])]
        back[j] = min(begins, key=lambda k: (cost[k] + last_cost(pos[j] - (pos[k] if k >= 0 else 0)), k))
    while j >= 0:
        cuts.append(j)
        j = back[j]
    return cuts[::-1]


def tail_lengths(n: int, size: int, cut: float) -> list[int]:
    """Lengths for the last ``n <= size`` tokens: powers of two need no padding, each further cut costs ``cut``."""
    out: list[int] = []
    while n & (n - 1):
        part = 1 << (n.bit_length() - 1)
        further = bin(n).count("1") - 1
        if size - n <= cut * further:
            break
        out.append(part)
        n -= part
    return [*out, n] if n else out


def tail_cost(n: int, size: int, cut: float) -> float:
    lengths = tail_lengths(n, size, cut)
    return cut * (len(lengths) - 1) + (0 if lengths[-1] & (lengths[-1] - 1) == 0 else size - lengths[-1])


class _Stream:
    """Token ids of documents in order, planned piece by piece."""

    def __init__(self, size, sentence_penalty, truncation_penalty, settle):
        self.size, self.sentence, self.truncation, self.settle = size, sentence_penalty, truncation_penalty, settle
        self.ids, self.docs, self.sequence = [], [], TaskContext.get().partitionId() << 33 if TaskContext.get() else 0
        self.held = 0
        self.sentence_ends: list[np.ndarray] = []

    def add(self, ids: np.ndarray, lengths: np.ndarray, doc_ids: list, ends: np.ndarray):
        """ids of whole documents, their lengths and ids, and the sentence ends as places in ``ids``."""
        self.ids.append(ids)
        self.docs += [[d, 0, n, n] for d, n in zip(doc_ids, lengths.tolist(), strict=True)]  # id, start, left here, all
        self.sentence_ends.append(ends + self.held)
        self.held += len(ids)
        if self.held >= self.settle:
            yield self.emit(False)

    def emit(self, last: bool) -> pa.RecordBatch:
        ids, ends = np.concatenate(self.ids), np.concatenate(self.sentence_ends)
        doc_ends = np.cumsum(np.fromiter((d[2] for d in self.docs), np.int64, len(self.docs)))
        total = len(ids)
        pos = np.unique(np.concatenate([ends, doc_ends]))
        gaps = np.diff(pos, prepend=0)
        step = self.size // 64
        wide = np.flatnonzero(gaps > step)
        inner = [np.arange(pos[k] - gaps[k] + step, pos[k], step) for k in wide.tolist()]
        if inner:
            pos = np.unique(np.concatenate([pos, *inner]))
        penalty = np.full(len(pos), float(self.truncation))
        penalty[np.searchsorted(pos, ends)] = self.sentence
        penalty[np.searchsorted(pos, doc_ends)] = 0.0
        end = (lambda n: tail_cost(n, self.size, self.truncation)) if last else None
        cuts = pos[choose_cuts(pos.tolist(), penalty.tolist(), self.size, end)]
        if last:
            begin = int(cuts[-2]) if len(cuts) > 1 else 0
            tail = begin + np.cumsum(tail_lengths(total - begin, self.size, self.truncation))
            cuts = np.concatenate([cuts[:-1], tail])
        else:
            cuts = cuts[cuts <= total - 2 * self.size]
        upto = int(cuts[-1])
        out = self._pieces(ids[:upto], cuts, doc_ends)
        # what lies behind the last settled cut opens the next round
        first = int(np.searchsorted(doc_ends, upto, side="right"))
        gone = upto - (int(doc_ends[first - 1]) if first else 0)
        self.docs = self.docs[first:]
        if self.docs and gone:
            d, start, left, n = self.docs[0]
            self.docs[0] = [d, start + gone, left - gone, n]
        self.ids, self.sentence_ends, self.held = [ids[upto:]], [ends[ends > upto] - upto], total - upto
        return out

    def _pieces(self, ids, cuts, doc_ends) -> pa.RecordBatch:
        bounds = np.unique(np.concatenate([cuts, doc_ends[doc_ends < len(ids)]]))
        begin = np.concatenate([[0], bounds[:-1]])
        doc, seq = np.searchsorted(doc_ends, begin, side="right"), np.searchsorted(cuts, begin, side="right")
        doc_begin, seq_begin = np.concatenate([[0], doc_ends]), np.concatenate([[0], cuts])
        known = [self.docs[k] for k in doc.tolist()]
        data = ids.astype("<u4").tobytes()
        out = pa.record_batch([
            pa.array([d[0] for d in known], pa.int64()),
            pa.array(begin - doc_begin[doc] + np.array([d[1] for d in known], np.int64)),
            pa.array(bounds - begin), pa.array([d[3] for d in known], pa.int64()),
            pa.array(self.sequence + seq), pa.array(begin - seq_begin[seq]),
            pa.array([data[4 * a:4 * b] for a, b in zip(begin.tolist(), bounds.tolist(), strict=True)], pa.binary()),
        ], names=[x.split()[0] for x in SCHEMA.split(", ")])
        self.sequence += len(cuts)
        return out


def _sentence_tables(bpe: T.ByteBpe) -> tuple[np.ndarray, np.ndarray]:
    """By id: whether a token closes a sentence, and whether it may open what follows one."""
    closes, opens = (np.zeros(max(bpe.ranks.values()) + 2, bool) for _ in range(2))
    for token, i in bpe.ranks.items():
        closes[i] = token.endswith((b".", b"!", b"?", b"\n"))
        opens[i] = token[:1] in b" \n\t\r" or closes[i] and token.endswith(b"\n")
    return closes, opens


def _task(path, pattern, end_id, size, sentence_penalty, truncation_penalty, settle):
    def run(batches):
        bpe = T.once(T.ByteBpe, path, pattern)
        closes, opens = T.once(_sentence_tables, bpe)
        stream = _Stream(size, sentence_penalty, truncation_penalty, settle)
        for batch in batches:
            for part, texts in T.text_slices(batch):
                body, offsets = bpe.encode_texts(texts)
                lengths = np.diff(offsets) + 1
                ids = np.empty(len(body) + len(lengths), np.uint32)
                doc_ends = np.cumsum(lengths)
                inside = np.ones(len(ids), bool)
                inside[doc_ends - 1] = False
                ids[inside], ids[doc_ends - 1] = body, end_id
                ends = np.flatnonzero(closes[ids[:-1]] & opens[ids[1:]]) + 1
                yield from stream.add(ids, lengths, part.column(0).to_pylist(), ends)
        if stream.held:
            yield stream.emit(True)

    return run


def pack_documents(docs: DataFrame, vocabulary: str, pattern: str, size: int = 2048, end_id: int = 1,
                   sentence_penalty: float = 2.0, truncation_penalty: float = 8.0, settle: int = 1 << 21,
                   id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Pieces of documents laid into sequences of at most ``size`` tokens, one row per piece.

    ``vocabulary`` is a byte-level vocabulary file, ``pattern`` its pre-token
    pattern; ``end_id`` closes each document. ``ids`` holds the piece's ids as
    little-endian unsigned 32-bit integers, ``start`` counts the document's ids
    before it, ``offset`` the sequence's. ``settle`` bounds the tokens that a
    task holds (plus one document). Sequences of a power of two tokens need no
    padding; only the end of a partition makes use of that.
    """
    ordered = (id_and_text(docs, id_col, text_col)
               .withColumn("_tie", F.xxhash64("text"))
               # rows of one id, or without one, are dealt out by their texts
               .repartitionByRange("doc_id", "_tie").sortWithinPartitions("doc_id", "_tie").drop("_tie"))
    return ordered.mapInArrow(
        T.tidy(_task(vocabulary, pattern, end_id, size, sentence_penalty, truncation_penalty, settle)), SCHEMA)
