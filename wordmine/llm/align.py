"""Cross-tokenizer alignment: where two tokenizers' tokens of a text end together.

Tokenizer A is byte-level, tokenizer B a sentencepiece model that puts a space
before a text; both then spell ``space + text``. Byte offsets where a token of
each ends cut the tokens into groups. The cuts are found by *diagonal run
skipping*: as long as the tokens go one to one, entry i of A's ends equals entry
i + shift of B's, and stretches of that kind are jumped by comparing the two end
arrays in windows that double; where they part, the smaller end is advanced
until both meet again (an irregular group), and the shift is what is left
between the two indexes.

Neither tokenizer has a token across a single space between two other
characters, so a text is a sequence of stretches cut there, of which a task
encodes and aligns each distinct one once. Only distinct (A id, B id) pairs are
counted over the corpus: documents stay in blocks of bounded size, as numbers of
the block's own pairs, a block's pairs are shuffled with their number of
documents, and the counts go back to the block (see ``count_links``).

Defined results: a text that is null, empty, or not spelt by the tokens of one
of the tokenizers (white space, say, that the model writes otherwise) has no
tokens: all its numbers are zero and its digest is the empty string. Null ids
and repeated rows are kept, a row each and each a document of its own; an empty
table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from wordmine.llm import textcells as T
from wordmine.llm.common import id_and_text

_COUNTS = ["n_a", "n_b", "n_groups", "n_links"]
_DOC = {"doc_id": pa.int64(), **dict.fromkeys(_COUNTS, pa.int64()), "groups_sha256": pa.string(),
        "n": pa.int64(), "numbers": pa.binary(), "links": pa.binary()}
_PAIR = {"a": pa.int64(), "b": pa.int64(), "number": pa.int64(), "docs": pa.int64()}
_ROW = {"kind": pa.string(), "block": pa.int64(), **_DOC, **_PAIR}
_SQL = {pa.int64(): "bigint", pa.string(): "string", pa.binary(): "binary"}
SCHEMA = ", ".join(f"{k} {_SQL[t]}" for k, t in _ROW.items())
ALIGNED = "doc_id bigint, n_a bigint, n_b bigint, n_groups bigint, n_links bigint, n_best bigint, count_sum bigint, groups_sha256 string"
_FIRST_WINDOW = 8
_WIDE = 4096


def diagonal_groups(ends_a: np.ndarray, ends_b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Ends of the groups as numbers of tokens of A and of B.

    Both arrays ascend strictly and have the same last value. Group k holds the
    tokens from the (k-1)th to the k-th entry of the two results.
    """
    a, b = ends_a.tolist(), ends_b.tolist()
    n_a, n_b = len(a), len(b)
    closes_a, closes_b = bytearray(b"\1") * n_a, bytearray(b"\1") * n_b
    i = j = 0
    while i < n_a:
        window = _FIRST_WINDOW
        while i < n_a:  # one to one: entry i of A against entry i + shift of B, the shift being j - i
            m = min(window, n_a - i, n_b - j)
            same = ends_a[i:i + m] == ends_b[j:j + m]
            step = m if same.all() else int(same.argmin())
            i, j = i + step, j + step
            if step < m:
                break
            window *= 2
        if i == n_a:
            break
        x, y = i, j
        while a[x] != b[y]:
            if a[x] < b[y]:
                x += 1
            else:
                y += 1
        closes_a[i:x] = bytes(x - i)
        closes_b[j:y] = bytes(y - j)
        i, j = x + 1, y + 1
    return (np.flatnonzero(np.frombuffer(closes_a, np.uint8)) + 1, np.flatnonzero(np.frombuffer(closes_b, np.uint8)) + 1)


def group_links(ids_a: np.ndarray, ids_b: np.ndarray, to_a: np.ndarray, to_b: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The links of each group as (group, code, times), with code = A id * width + B id.

    Every occurrence of A in a group is linked with every one of B. Small groups
    are written out; in a large one equal pairs are counted before that.
    """
    from_a, from_b = np.concatenate([[0], to_a[:-1]]), np.concatenate([[0], to_b[:-1]])
    size_a, size_b = to_a - from_a, to_b - from_b
    links = size_a * size_b
    small = np.flatnonzero(links <= _WIDE)
    n = links[small]
    group = np.repeat(small, n)
    place = np.arange(int(n.sum())) - np.repeat(np.cumsum(n) - n, n)
    in_a, in_b = np.divmod(place, size_b[group])
    codes = [ids_a[from_a[group] + in_a] * width + ids_b[from_b[group] + in_b]]
    groups, times = [group], [np.ones(len(group), np.int64)]
    for k in np.flatnonzero(links > _WIDE).tolist():
        of_a, n_of_a = np.unique(ids_a[from_a[k]:to_a[k]], return_counts=True)
        of_b, n_of_b = np.unique(ids_b[from_b[k]:to_b[k]], return_counts=True)
        codes.append((of_a[:, None] * width + of_b[None, :]).ravel())
        times.append((n_of_a[:, None] * n_of_b[None, :]).ravel())
        groups.append(np.full(len(codes[-1]), k))
    return np.concatenate(groups), np.concatenate(codes), np.concatenate(times)


class PieceModel:
    """A sentencepiece model: ids of texts and the bytes of its pieces."""

    def __init__(self, path: str):
        import sentencepiece

        self.model = sentencepiece.SentencePieceProcessor(model_file=path)
        self.size = self.model.vocab_size()
        self.tokens = [self._bytes(i) for i in range(self.size)]
        # a piece across a single space would make the cuts at such spaces unsafe
        self.crosses = any("▁" in self.model.id_to_piece(i).lstrip("▁") for i in range(self.size))

    def _bytes(self, i: int) -> bytes:
        piece = self.model.id_to_piece(i)
        if self.model.is_byte(i):
            return bytes([int(piece[3:-1], 16)])
        return piece.replace("▁", " ").encode()

    def encode(self, stretches: list[str]) -> list[list[int]]:
        """Ids of stretches that begin with their space (the model puts it there itself) or are empty."""
        out = self.model.encode([s[1:] for s in stretches], num_threads=1)
        space = [self.model.piece_to_id("▁")]  # alone only at a text's end: the model has no tokens for an empty text
        return [space if s == " " else x for s, x in zip(stretches, out, strict=True)]


class _Tokens:
    """Both tokenizers with their token bytes as flat tables and their ids as decimals."""

    def __init__(self, vocabulary: str, pattern: str, pieces: str):
        self.bpe = T.ByteBpe(vocabulary, pattern, 1)
        self.model = PieceModel(pieces)
        tokens = [b""] * (max(self.bpe.ranks.values()) + 1)
        for token, i in self.bpe.ranks.items():
            tokens[i] = token
        self.bytes_a, self.bytes_b = self._flat(tokens), self._flat(self.model.tokens)
        self.decimals = [str(i) for i in range(max(len(tokens), self.model.size))]

    @staticmethod
    def _flat(tokens: list[bytes]):
        lengths = np.fromiter(map(len, tokens), np.int64, len(tokens))
        return np.frombuffer(b"".join(tokens), np.uint8), np.cumsum(lengths) - lengths, lengths


class Stretches:
    """What is known of the distinct stretches a task has met; emptied when it holds ``most`` of them."""

    def __init__(self, tokens: _Tokens, most: int = 400_000):
        self.tokens, self.most = tokens, most
        self._clear()

    def _clear(self) -> None:
        self.slots: dict[str, int] = {}
        self.texts: list[str] = []
        self.sizes = np.empty((0, 5), np.int64)  # n_a, n_b, n_groups, n_links, spelt
        self.codes = self.times = np.empty(0, np.int64)
        self.starts = self.lengths = np.empty(0, np.int64)

    def look_up(self, stretches: list[str]) -> np.ndarray:
        """The slots of the stretches; unknown ones are encoded and aligned."""
        if len(self.slots) + len(stretches) > self.most:
            self._clear()
        new = [s for s in dict.fromkeys(stretches) if s not in self.slots]
        if new:
            first = len(self.texts)
            self._add(new)
            self.slots.update(zip(new, range(first, first + len(new)), strict=True))
        return np.fromiter((self.slots[s] for s in stretches), np.int64, len(stretches))

    def _add(self, new: list[str]) -> None:
        t, width = self.tokens, self.tokens.model.size
        ids_a, start_a, n_a = t.bpe.encode_chunks(new)
        by_b = t.model.encode(new)
        n_b = np.fromiter(map(len, by_b), np.int64, len(new))
        ids_a, ids_b = ids_a.astype(np.int64), T.flat_ints(by_b)
        start_b = np.cumsum(n_b) - n_b
        raw = [s.encode() for s in new]
        size = np.fromiter(map(len, raw), np.int64, len(raw))
        spelt = self._spelt(t.bytes_a, ids_a, start_a, n_a, raw) & self._spelt(t.bytes_b, ids_b, start_b, n_b, raw)
        # the tokens of all stretches that are spelt, one stretch after the other
        good = np.flatnonzero(spelt & (size > 0))
        a, to_a = T.gather_ragged(ids_a, start_a, n_a, good)
        b, to_b = T.gather_ragged(ids_b, start_b, n_b, good)
        groups_a, groups_b = diagonal_groups(np.cumsum(t.bytes_a[2][a]), np.cumsum(t.bytes_b[2][b]))
        group, codes, times = group_links(a, b, groups_a, groups_b, width)
        stretch_of_group = np.searchsorted(to_a, groups_a, side="left")  # a stretch's end is a cut of both
        texts = self._group_texts(a, b, groups_a, groups_b)
        n_groups = np.bincount(stretch_of_group, minlength=len(good))
        at = np.concatenate([[0], np.cumsum(n_groups)]).tolist()
        as_text = [""] * len(new)
        for k, x, y in zip(good.tolist(), at[:-1], at[1:], strict=True):
            as_text[k] = ";".join(texts[x:y])
        of = good[stretch_of_group[group]] if len(good) else group
        order = np.argsort(of, kind="stable")
        sizes = np.zeros((len(new), 5), np.int64)
        sizes[good, 0], sizes[good, 1], sizes[good, 2] = n_a[good], n_b[good], n_groups
        sizes[:, 3] = np.bincount(of, weights=times, minlength=len(new)).astype(np.int64)
        sizes[:, 4] = spelt
        lengths = np.bincount(of, minlength=len(new))
        self.starts = np.concatenate([self.starts, len(self.codes) + np.cumsum(lengths) - lengths])
        self.lengths = np.concatenate([self.lengths, lengths])
        self.codes, self.times = np.concatenate([self.codes, codes[order]]), np.concatenate([self.times, times[order]])
        self.sizes = np.concatenate([self.sizes, sizes])
        self.texts += as_text

    @staticmethod
    def _spelt(table, ids, starts, n, raw: list[bytes]) -> np.ndarray:
        """Whether the bytes of each stretch's ids are those of the stretch."""
        data, ends = T.gather_ragged(*table, ids)
        data, ends = data.tobytes(), np.concatenate([[0], ends])
        if data == b"".join(raw):  # all of them, if the borders agree too
            return (ends[starts + n] - ends[starts]) == np.fromiter(map(len, raw), np.int64, len(raw))
        return np.fromiter((data[x:y] == r for x, y, r in zip(ends[starts].tolist(), ends[starts + n].tolist(), raw, strict=True)), bool, len(raw))

    def _group_texts(self, a, b, to_a, to_b) -> list[str]:
        names_a, names_b = ([self.tokens.decimals[i] for i in ids.tolist()] for ids in (a, b))
        out, i, j = [], 0, 0
        for x, y in zip(to_a.tolist(), to_b.tolist(), strict=True):
            out.append(f"{names_a[i] if x == i + 1 else ','.join(names_a[i:x])}|{names_b[j] if y == j + 1 else ','.join(names_b[j:y])}")
            i, j = x, y
        return out


class _Block:
    """Documents that are numbered together: their distinct pairs get the block's own numbers."""

    def __init__(self):
        self.docs: list[dict] = []
        self.codes, self.links, self.sizes, self.held = [], [], [], 0

    def add(self, known: Stretches, offsets: np.ndarray, slots: np.ndarray, doc_ids: list) -> None:
        n = len(doc_ids)
        doc = np.repeat(np.arange(n), np.diff(offsets))
        per_stretch = known.sizes[slots]
        whole = np.ones(n, bool)
        whole[doc[per_stretch[:, 4] == 0]] = False
        kept = whole[doc]
        doc, slots, per_stretch = doc[kept], slots[kept], per_stretch[kept]
        counts = [np.bincount(doc, weights=per_stretch[:, k], minlength=n).astype(np.int64).tolist() for k in range(4)]
        at = np.searchsorted(doc, np.arange(n + 1)).tolist()
        texts = known.texts
        names = [texts[s] for s in slots.tolist()]
        digests = ["" if not a else hashlib.sha256(";".join(filter(None, names[x:y])).encode()).hexdigest()
                   for a, x, y in zip(counts[0], at[:-1], at[1:], strict=True)]
        codes, _ = T.gather_ragged(known.codes, known.starts, known.lengths, slots)
        times, _ = T.gather_ragged(known.times, known.starts, known.lengths, slots)
        owner = np.repeat(doc, known.lengths[slots])
        order = np.lexsort((codes, owner))
        codes, owner, times = codes[order], owner[order], times[order]
        new = np.ones(len(codes), bool)
        new[1:] = (codes[1:] != codes[:-1]) | (owner[1:] != owner[:-1])
        first = np.flatnonzero(new)
        self.codes.append(codes[first])
        self.links.append(np.add.reduceat(times, first) if len(first) else times)
        self.sizes.append(np.bincount(owner[first], minlength=n))
        self.held += len(first)
        self.docs += [dict(zip(("doc_id", *_COUNTS, "groups_sha256"), row, strict=True)) for row in zip(doc_ids, *counts, digests, strict=True)]

    def rows(self, block: int, width: int) -> Iterator[pa.RecordBatch]:
        codes, place = np.unique(np.concatenate(self.codes), return_inverse=True)
        links, sizes = np.concatenate(self.links), np.concatenate(self.sizes)
        ends = np.cumsum(sizes)
        for at in range(0, len(self.docs), 1000):
            docs = self.docs[at:at + 1000]
            for d, x, y in zip(docs, (ends - sizes)[at:at + 1000].tolist(), ends[at:at + 1000].tolist(), strict=True):
                d.update(n=y - x, numbers=_planes(place[x:y], 4), links=_planes(links[x:y], 8))
            yield _rows("doc", block, len(docs), {k: [d[k] for d in docs] for k in _DOC})
        a, b = np.divmod(codes, width)
        for at in range(0, len(codes), 1 << 16):
            part = slice(at, at + (1 << 16))
            yield _rows("pair", block, len(codes[part]), {"a": a[part], "b": b[part], "number": np.arange(len(codes))[part],
                                                          "docs": np.bincount(place, minlength=len(codes))[part]})


def _planes(values: np.ndarray, width: int) -> bytes:
    """Numbers byte plane by byte plane, without the high planes that hold nothing."""
    planes = values.astype(f"<i{width}").view(np.uint8).reshape(-1, width).T
    used = 1 + max((k for k in range(width) if planes[k].any()), default=0)
    return np.ascontiguousarray(planes[:used]).tobytes()


def _from_planes(data: bytes, n: int) -> np.ndarray:
    out = np.zeros((n, 8), np.uint8)
    if n:
        planes = np.frombuffer(data, np.uint8).reshape(-1, n)
        out[:, :len(planes)] = planes.T
    return out.view("<i8")[:, 0]


def _rows(kind: str, block: int, n: int, columns: dict) -> pa.RecordBatch:
    columns |= {"kind": [kind] * n, "block": [block] * n}
    return pa.record_batch([pa.array(columns[k], t) if k in columns else pa.nulls(n, t) for k, t in _ROW.items()], names=list(_ROW))


def _task(vocabulary: str, pattern: str, pieces: str, pairs_per_block: int):
    def run(batches):
        tokens = T.once(_Tokens, vocabulary, pattern, pieces)
        known, part, number, block = Stretches(tokens), TaskContext.get().partitionId(), 0, _Block()
        for batch in batches:
            for rows, texts in T.text_slices(batch, most_bytes=1 << 20):
                # a text without characters has no tokens: not even the space's
                spelt = [f" {t}" if t else "" for t in T.strings(texts)]
                if tokens.model.crosses:
                    offsets, index, chunks = np.arange(len(spelt) + 1), np.arange(len(spelt)), spelt
                else:
                    offsets, index, chunks = T.space_chunks(pa.array(spelt, pa.string()))
                block.add(known, offsets, known.look_up(chunks)[index], rows.column(0).to_pylist())
                if block.held >= pairs_per_block:
                    yield from block.rows((part << 24) + number, tokens.model.size)
                    number, block = number + 1, _Block()
        if block.docs:
            yield from block.rows((part << 24) + number, tokens.model.size)

    return run


def write_links(docs: DataFrame, folder: str, vocabulary: str, pattern: str, pieces: str,
                pairs_per_block: int = 1 << 20, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Align every text and write documents and pairs of each block below ``folder``; returns them as read again."""
    rows = id_and_text(docs, id_col, text_col).mapInArrow(T.tidy(_task(vocabulary, pattern, pieces, pairs_per_block)), SCHEMA)
    rows.write.partitionBy("kind").option("compression", "zstd").parquet(folder)
    return docs.sparkSession.read.schema(SCHEMA).parquet(folder)


def pair_counts(rows: DataFrame) -> DataFrame:
    """Over the corpus: a, b, count (documents that hold the pair linked) and whether it is its A id's highest.

    An A id has at most as many pairs as B has ids, however many documents hold it.
    """
    counts = rows.filter("kind = 'pair'").groupBy("a", "b").agg(F.sum("docs").alias("count"))
    return counts.withColumn("best", F.col("count") == F.max("count").over(Window.partitionBy("a")))


def _judge(docs: pa.Table, answers: pa.Table) -> pa.Table:
    """The documents of a block with what the corpus says about its pairs."""
    number = answers.column("number").to_numpy()
    count, best = (np.zeros(len(number), np.int64) for _ in range(2))
    count[number], best[number] = answers.column("count").to_numpy(), answers.column("best").to_numpy()
    n_best, count_sum = [], []
    for n, numbers, links in zip(*(docs.column(c).to_pylist() for c in ("n", "numbers", "links")), strict=True):
        of, times = _from_planes(numbers, n), _from_planes(links, n)
        n_best.append(int((times * best[of]).sum()))
        count_sum.append(int((times * count[of]).sum()))
    out = {k: docs.column(k) for k in ("doc_id", *_COUNTS)}
    return pa.table({**out, "n_best": pa.array(n_best, pa.int64()), "count_sum": pa.array(count_sum, pa.int64()),
                     "groups_sha256": docs.column("groups_sha256")})


def count_links(rows: DataFrame) -> DataFrame:
    """Per document of ``write_links``: its numbers and how its links rank in the corpus.

    A block's distinct pairs are joined with the corpus-wide counts and meet the
    block's documents: what travels is a block's distinct pairs, not its links.
    """
    n = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    pairs = rows.filter("kind = 'pair'").select("block", "number", "a", "b")
    answers = (pairs.join(pair_counts(rows), ["a", "b"])
               .select("block", "number", "count", F.col("best").cast("bigint").alias("best")).repartition(n, "block"))
    docs = rows.filter("kind = 'doc'").select(F.col("block").alias("of_block"), *_DOC).repartition(n, "of_block")
    return docs.groupBy("of_block").cogroup(answers.groupBy("block")).applyInArrow(_judge, ALIGNED)


def align_documents(docs: DataFrame, folder: str, vocabulary: str, pattern: str, pieces: str,
                    id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per document: tokens of A and B, groups, links, links that are their A id's commonest, the sum of the links'
    document counts and the digest of the groups (``a1,a2|b1;a3|b2,b3``).

    ``vocabulary`` with ``pattern`` is the byte-level tokenizer A, ``pieces`` the
    sentencepiece model B; ``folder`` is a new folder that all executors reach.
    """
    return count_links(write_links(docs, folder, vocabulary, pattern, pieces, id_col=id_col, text_col=text_col))
