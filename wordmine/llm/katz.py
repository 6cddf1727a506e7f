"""Katz back-off language model over words, learned and evaluated on a cluster.

    P(w | h) = s(h) d(c(h, w)) c(h, w) / c(h)    if (h, w) was seen in training
             = a(h) P(w)                         else
    P(w)     = s d(c(w)) c(w) / N                if w was seen, else P(unknown)

c counts training tokens, d is the Good-Turing discount for counts up to 5, and
a(h) is the mass that the seen words leave divided by the P(w) of the unseen
ones, so each distribution adds up to 1 over the vocabulary and one unknown
word. s is 1 but where the discounts leave nothing for unseen words (there
c / (c + 1)), or where no word is unseen (there the seen ones share all). A
document is its words and one end, which is also what precedes its first word.

How it runs. Documents are blocks of word numbers (see ``blocks``). The blocks'
dictionaries are shuffled by word; there each word gets its count and an id.
Each block then counts its distinct pairs (h, w) and sends them, packed, to
partitions: those of one h together, those of a very frequent h dealt out by
(h, w). A partition adds up the counts of the pairs and the parts of s(h) and
a(h), and returns both to the blocks that asked, where every
token is looked up recursively: pair, else back-off weight times word. Only
parameters of the frequent h, at most ``8 * partitions`` rows, are collected.

Defined results: a null text is an empty one (only the end); without training
rows every token is the unknown word, with probability 1; repeated rows and null
ids are kept, a row each; an empty table gives no rows.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wordmine.llm import blocks
from wordmine.llm import textcells as T
from wordmine.llm.blocks import pack, pack_ascending, unpack, unpack_ascending
from wordmine.llm.common import id_and_text
from wordmine.session import materialise

END = " "  # no word holds white space
MOST_DISCOUNTED = 5
WORDS_PER_BLOCK = 1 << 21
PAIRS_PER_PARTITION = 1 << 21

NUMBERED = "block bigint, n bigint, numbers binary, ids binary, counts binary, r bigint, n_r bigint, tokens bigint, words bigint"
ASKED = "part int, block bigint, n bigint, runs bigint, h binary, h_count binary, h_size binary, w binary, w_count binary, seen binary"
ANSWERED = ("block bigint, part int, seen binary, runs bigint, by_count binary, rest binary, lower binary, "
            "h bigint, h_by_count array<bigint>, h_rest bigint, h_lower double, h_count bigint, r bigint, n_r bigint")
ROWS = "doc_id bigint, train boolean, n_tokens bigint, n_known bigint, base_score double, score double"


def words_and_end(texts: pa.Array):
    """Lower-cased words of each text and one end after them."""
    offsets, index, words = T.ascii_words(texts, lower=True)
    n = len(offsets) - 1
    all_offsets = offsets + np.arange(n + 1)
    out = np.full(all_offsets[-1], len(words), np.int64)
    inside = np.ones(len(out), bool)
    inside[all_offsets[1:] - 1] = False
    out[inside] = index
    return all_offsets, out, [*T.strings(words), END]


# -- words: counts and ids ---------------------------------------------------

def _number_words(parts: int):
    """The words of one part to packed rows (block, numbers, ids, counts), and rows of statistics."""

    def run(table: pa.Table) -> pa.Table:
        part = blocks.PartWords(table)
        number = table.column("part")[0].as_py()
        count = np.zeros(len(part.words), np.int64)
        for _, _, places, counts in part.rows:
            count[places] += counts  # a block names a word once
        ids = np.empty(len(count), np.int64)
        ids[np.argsort(-count, kind="stable")] = np.arange(len(count)) * parts + number
        out: dict[str, list] = {c.split()[0]: [] for c in NUMBERED.split(", ")}

        def add(**row):
            for name, column in out.items():
                column.append(row.get(name))

        for block, numbers, places, _ in part.rows:
            add(block=block, n=len(numbers), numbers=pack_ascending(numbers), ids=pack(ids[places]), counts=pack(count[places]))
        for r in range(1, MOST_DISCOUNTED + 2):
            add(r=r, n_r=int((count == r).sum()), tokens=0, words=0)
        add(r=0, n_r=0, tokens=int(count.sum()), words=int((count > 0).sum()))
        types = [pa.int64()] * 2 + [pa.binary()] * 3 + [pa.int64()] * 4
        return pa.table([pa.array(v, t) for v, t in zip(out.values(), types, strict=True)], names=list(out))

    return run


def good_turing(n_r: dict[int, int]) -> np.ndarray:
    """Discounts by count (0 to 5, then 1): Katz's formula, or (r - 1/2) / r for all where it gives none in (0, 1]."""
    d = np.ones(MOST_DISCOUNTED + 2)
    d[0] = 0.0
    k, n1 = MOST_DISCOUNTED, n_r.get(1, 0)
    far = (k + 1) * n_r.get(k + 1, 0) / n1 if n1 else 1.0
    for r in range(1, k + 1):
        if n_r.get(r, 0) and far < 1:
            d[r] = ((r + 1) * n_r.get(r + 1, 0) / (r * n_r[r]) - far) / (1 - far)
        else:
            d[r] = -1.0
    if not ((d[1:k + 1] > 0) & (d[1:k + 1] <= 1)).all():
        d[1:k + 1] = (np.arange(1, k + 1) - 0.5) / np.arange(1, k + 1)
    return d


def _discounted(d: np.ndarray, c: np.ndarray) -> np.ndarray:
    return d[np.minimum(c, MOST_DISCOUNTED + 1)] * c


class Words:
    """The distribution of single words."""

    def __init__(self, tokens: int, words: int, n_r: dict[int, int]):
        self.tokens, self.words, self.discounts = tokens, words, good_turing(n_r)
        kept = tokens - sum(r * n_r.get(r, 0) * (1 - self.discounts[r]) for r in range(1, MOST_DISCOUNTED + 1))
        self.scale = 1.0 / tokens if tokens and kept < tokens else 1.0 / (tokens + 1)
        self.unknown = 1.0 - kept * self.scale

    def probability(self, c: np.ndarray) -> np.ndarray:
        return np.where(c > 0, _discounted(self.discounts, c) * self.scale, self.unknown)

    def base(self, c: np.ndarray) -> np.ndarray:
        return np.log10((c + 0.5) / (self.tokens + 0.5 * (self.words + 1)))


# -- pairs -------------------------------------------------------------------

def _mix(a: np.ndarray) -> np.ndarray:
    a = a.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    return a ^ (a >> np.uint64(32))


class _Pairs:
    """The distinct pairs of a block, and where they stand in its documents."""

    def __init__(self, folder: str, block: int, numbers, ids, counts, parts: int, hot: int):
        size = int(numbers.max()) + 1
        self.id, self.count = np.zeros(size, np.int64), np.zeros(size, np.int64)
        self.id[numbers], self.count[numbers] = ids, counts
        self.doc_ids, self.train, sizes, tokens = [], [], [], []
        for doc_ids, train, offsets, index in blocks.read_documents(folder, block):
            self.doc_ids += doc_ids
            self.train += train
            sizes.append(np.diff(offsets))
            tokens.append(index)
        self.tokens, sizes = np.concatenate(tokens).astype(np.int64), np.concatenate(sizes)
        self.offsets = np.concatenate([[0], np.cumsum(sizes)])
        before = np.empty_like(self.tokens)
        before[1:] = self.tokens[:-1]  # the end of a document stands before the next one's first word
        before[0] = self.tokens[-1]
        key, self.at = np.unique(before * size + self.tokens, return_inverse=True)
        self.h, self.w = key // size, key % size
        of_train = np.repeat(np.array(self.train, bool), sizes)
        self.own = np.bincount(self.at[of_train], minlength=len(key))
        spread = np.where(self.count[self.h] > hot, _mix(self.id[self.w]), np.uint64(0))
        self.part = (_mix(_mix(self.id[self.h]) + spread) % np.uint64(parts)).astype(np.int64)
        # pairs by partition, in the order of h and w
        self.order = np.argsort(self.part, kind="stable")
        self.cuts = np.searchsorted(self.part[self.order], np.arange(parts + 1))

    def of_part(self, p: int):
        """(pairs, where a new h begins among them) of a partition."""
        of = self.order[self.cuts[p]:self.cuts[p + 1]]
        return of, np.flatnonzero(np.diff(self.h[of], prepend=-1))


def _dictionary(table: pa.Table):
    sizes = table.column("n").to_pylist()
    return tuple(np.concatenate([read(v, n) for v, n in zip(table.column(c).to_pylist(), sizes, strict=True)])
                 for c, read in (("numbers", unpack_ascending), ("ids", unpack), ("counts", unpack)))


def _ask(folder: str, parts: int, hot: int):
    def run(table: pa.Table) -> pa.Table:
        block = table.column("block")[0].as_py()
        pairs = _Pairs(folder, block, *_dictionary(table), parts, hot)
        out: dict[str, list] = {c.split()[0]: [] for c in ASKED.split(", ")}
        for p in range(parts):
            of, first = pairs.of_part(p)
            if len(of):
                h = pairs.h[of[first]]
                row = (p, block, len(of), len(first), pack(pairs.id[h]), pack(pairs.count[h]), pack(np.diff(np.append(first, len(of)))),
                       pack(pairs.id[pairs.w[of]]), pack(pairs.count[pairs.w[of]]), pack(pairs.own[of]))
                for column, value in zip(out.values(), row, strict=True):
                    column.append(value)
        types = [pa.int32(), pa.int64(), pa.int64(), pa.int64(), *[pa.binary()] * 6]
        return pa.table([pa.array(v, t) for v, t in zip(out.values(), types, strict=True)], names=list(out))

    return run


def _weights(count, kept, lower):
    """(s, a) of histories: their counts, the discounted counts and the P(w) of their seen words."""
    none = kept <= 0
    count, lower = np.maximum(count, 1).astype(float), np.where(none, 0.0, lower)
    scale = np.where(kept < count * (1 - 1e-12), 1.0, count / (count + 1))
    left, unseen = 1 - scale * kept / count, 1 - lower
    full = unseen <= 1e-9  # nothing is unseen
    with np.errstate(divide="ignore"):
        scale = np.where(full, count / np.where(none, 1.0, kept), scale)
    back = np.where(full, 0.0, left / np.where(full, 1.0, unseen))
    return np.where(none, 0.0, scale), np.where(none, 1.0, back)


def _answer(words: Words, hot: int):
    """A partition's pairs: their counts over all blocks, and what the weights of the histories are made of.

    For a history: how many of its pairs were seen 1 to 5 times, the tokens of
    the others, and the sum of P(w) over its seen words. The discounts follow
    from the rows (r, n_r) of all partitions.
    """

    def run(table: pa.Table) -> pa.Table:
        rows = [dict(zip(table.column_names, r, strict=True)) for r in zip(*(c.to_pylist() for c in table.columns), strict=True)]
        rows.sort(key=lambda r: r["block"])
        h, w, w_count, own, h_count = [], [], [], [], []
        for r in rows:
            size = unpack(r["h_size"], r["runs"])
            h.append(np.repeat(unpack(r["h"], r["runs"]), size))
            h_count.append(np.repeat(unpack(r["h_count"], r["runs"]), size))
            w.append(unpack(r["w"], r["n"]))
            w_count.append(unpack(r["w_count"], r["n"]))
            own.append(unpack(r["seen"], r["n"]))
        h, w, w_count, own, h_count = map(np.concatenate, (h, w, w_count, own, h_count))
        order = np.lexsort((w, h))
        first = np.flatnonzero((np.diff(h[order], prepend=-1) != 0) | (np.diff(w[order], prepend=-1) != 0))
        run_of = np.empty(len(h), np.int64)
        run_of[order] = np.repeat(np.arange(len(first)), np.diff(np.append(first, len(h))))
        seen = np.add.reduceat(own[order], first)
        h_first = np.flatnonzero(np.diff(h[order][first], prepend=-1))
        by_count = np.stack([np.add.reduceat((seen == r).astype(np.int64), h_first) for r in range(1, MOST_DISCOUNTED + 1)])
        rest = np.add.reduceat(np.where(seen > MOST_DISCOUNTED, seen, 0), h_first)
        lower = np.add.reduceat(np.where(seen > 0, words.probability(w_count[order][first]), 0.0), h_first)
        count_h, id_h = h_count[order][first][h_first], h[order][first][h_first]
        cold = count_h <= hot
        h_of = np.repeat(np.arange(len(h_first)), np.diff(np.append(h_first, len(first))))
        out: dict[str, list] = {c: [] for c in _ANSWERED}

        def add(**row):
            for name, column in out.items():
                column.append(row.get(name))

        at = 0
        for r in rows:
            of = run_of[at:at + r["n"]]
            begins = np.cumsum(unpack(r["h_size"], r["runs"]))
            history = h_of[of[np.concatenate([[0], begins[:-1]])]]
            add(block=r["block"], part=r["part"], seen=pack(seen[of] - own[at:at + r["n"]]), runs=r["runs"],
                by_count=pack(by_count[:, history].ravel()), rest=pack(rest[history]),
                lower=blocks.compressed(np.where(cold[history], lower[history], np.nan).astype("<f8").tobytes()))
            at += r["n"]
        for k in np.flatnonzero(~cold).tolist():
            add(h=int(id_h[k]), h_by_count=by_count[:, k].tolist(), h_rest=int(rest[k]), h_lower=float(lower[k]), h_count=int(count_h[k]))
        for r in range(1, MOST_DISCOUNTED + 2):
            add(r=r, n_r=int((seen == r).sum()))
        return pa.table([pa.array(v, t) for v, t in zip(out.values(), _ANSWERED.values(), strict=True)], names=list(out))

    return run


_ANSWERED = {"block": pa.int64(), "part": pa.int32(), "seen": pa.binary(), "runs": pa.int64(), "by_count": pa.binary(), "rest": pa.binary(),
             "lower": pa.binary(), "h": pa.int64(), "h_by_count": pa.list_(pa.int64()), "h_rest": pa.int64(), "h_lower": pa.float64(),
             "h_count": pa.int64(), "r": pa.int64(), "n_r": pa.int64()}


def _kept(discounts: np.ndarray, by_count: np.ndarray, rest: np.ndarray) -> np.ndarray:
    """Discounted tokens of histories, from their numbers of pairs by count and the tokens of the others."""
    return discounts[1:MOST_DISCOUNTED + 1] * np.arange(1, MOST_DISCOUNTED + 1) @ by_count + rest


def _evaluate(folder: str, parts: int, hot: int, words: Words, discounts: np.ndarray, frequent: dict[int, tuple[float, float]]):
    def run(numbered: pa.Table, answered: pa.Table) -> pa.Table:
        block = numbered.column("block")[0].as_py()
        pairs = _Pairs(folder, block, *_dictionary(numbered), parts, hot)
        seen = pairs.own.astype(np.int64)
        scale, back = np.zeros(len(pairs.id)), np.ones(len(pairs.id))
        columns = ("part", "seen", "runs", "by_count", "rest", "lower")
        for p, more, runs, by_count, rest, lower in zip(*(answered.column(x).to_pylist() for x in columns), strict=True):
            of, first = pairs.of_part(p)
            seen[of] += unpack(more, len(of))
            h = pairs.h[of[first]]
            low = np.frombuffer(pa.decompress(lower, decompressed_size=8 * runs, codec="zstd", asbytes=True), "<f8")
            kept = _kept(discounts, unpack(by_count, MOST_DISCOUNTED * runs).reshape(MOST_DISCOUNTED, runs), unpack(rest, runs))
            cold = ~np.isnan(low)
            scale[h[cold]], back[h[cold]] = (x[cold] for x in _weights(pairs.count[h], kept, low))
        for k in np.flatnonzero(pairs.count > hot).tolist():
            scale[k], back[k] = frequent[int(pairs.id[k])]
        with np.errstate(divide="ignore"):
            of_pair = np.where(seen > 0, scale[pairs.h] * _discounted(discounts, seen) / np.maximum(pairs.count[pairs.h], 1),
                               back[pairs.h] * words.probability(pairs.count[pairs.w]))
            token = np.log10(of_pair)[pairs.at]
        base, known = words.base(pairs.count)[pairs.tokens], (pairs.count > 0).astype(np.int64)[pairs.tokens]
        begin = pairs.offsets[:-1]
        return pa.table([
            pa.array(pairs.doc_ids, pa.int64()), pa.array(pairs.train, pa.bool_()), pa.array(np.diff(pairs.offsets)),
            pa.array(np.add.reduceat(known, begin)), pa.array(np.add.reduceat(base, begin)), pa.array(np.add.reduceat(token, begin)),
        ], names=[c.split()[0] for c in ROWS.split(", ")])

    return run


def score_documents(docs: DataFrame, is_training, folder: str, id_col: str = "doc_id", text_col: str = "text",
                    words_per_block: int = WORDS_PER_BLOCK) -> DataFrame:
    """doc_id, train, n_tokens, n_known, train_tokens, base_score, score: a row for each row of ``docs``.

    ``is_training`` is a condition on the column doc_id. ``score`` is the log10
    probability of the document; ``base_score`` that of a unigram model with 0.5
    added to each count. ``folder`` is a new folder that all executors reach.
    """
    spark = docs.sparkSession
    texts = id_and_text(docs, id_col, text_col).withColumn("train", F.coalesce(is_training, F.lit(False)))
    store, word_parts = f"{folder}/blocks", blocks.default_parts(spark)
    blocks.write_blocks(texts, words_and_end, store, word_parts, words_per_block, count_train=True)
    by_part = blocks.block_words(spark, store).groupBy("part")
    numbered = materialise(by_part.applyInArrow(_number_words(word_parts), NUMBERED), "lm-words")
    stats = numbered.filter("r is not null").groupBy("r").agg(F.sum("n_r").alias("n"), F.sum("tokens").alias("t"), F.sum("words").alias("v")).collect()
    tokens, known = sum(s["t"] for s in stats), sum(s["v"] for s in stats)
    words = Words(tokens, known, {s["r"]: s["n"] for s in stats if s["r"]})
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-tokens // PAIRS_PER_PARTITION))
    hot = max(1000, tokens // (8 * parts))  # at most 8 * parts words are more frequent
    dictionaries = numbered.filter("block is not null").select("block", "n", "numbers", "ids", "counts")
    asked = dictionaries.groupBy("block").applyInArrow(_ask(store, parts, hot), ASKED)
    answered = materialise(asked.groupBy("part").applyInArrow(_answer(words, hot), ANSWERED), "lm-answers")
    n_r = {x["r"]: x["n"] for x in answered.filter("r is not null").groupBy("r").agg(F.sum("n_r").alias("n")).collect()}
    discounts = good_turing(n_r)
    by_count = [F.sum(F.col("h_by_count")[r]).alias(f"k{r}") for r in range(MOST_DISCOUNTED)]
    frequent = {}
    for x in (answered.filter("h is not null").groupBy("h")
              .agg(*by_count, F.sum("h_rest").alias("rest"), F.sum("h_lower").alias("lower"), F.max("h_count").alias("c")).collect()):
        kept = _kept(discounts, np.array([[x[f"k{r}"]] for r in range(MOST_DISCOUNTED)]), np.array([x["rest"]]))
        scale, back = _weights(np.array([x["c"]]), kept, np.array([x["lower"]]))
        frequent[x["h"]] = (float(scale[0]), float(back[0]))
    answers = answered.filter("block is not null").select("block", "part", "seen", "runs", "by_count", "rest", "lower")
    scored = dictionaries.groupBy("block").cogroup(answers.groupBy("block")).applyInArrow(
        _evaluate(store, parts, hot, words, discounts, frequent), ROWS)
    return scored.withColumn("train_tokens", F.lit(tokens).cast("bigint"))

