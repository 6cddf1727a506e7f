"""Personal data: fixed patterns, and contextual patterns bootstrapped from what they find.

Base spans (``base_spans``) are e-mail addresses, IP addresses, card and phone
numbers by regular expression and check. They are the seed entities. The words
around a seed induce lexical patterns: the two words before it, and the word
before with the word after it. Spark counts how often each pattern occurs at
all and which identifier-like strings it meets, and scores the graph of
patterns and instances in rounds: a pattern is as good as the share of its
occurrences that are instances believed in, an instance as believable as the
patterns that meet it (noisy-or). Patterns that meet enough different instances
with enough precision then add spans that no regular expression found.

The corpus is read twice, first for seeds, then for the occurrences of patterns.
Patterns are looked up by a Bloom filter of ``BLOOM_BITS`` bits, the only thing
that tasks receive, and joined exactly afterwards. Occurrences are counted in
each task before they are shuffled, and copies of a text add no support, which
counts different instances.

Defined results: null and empty texts have no spans; rows of the same id and
text have the same spans; null ids are kept; an empty table gives no rows.
"""

from __future__ import annotations

import re
from bisect import bisect_left

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wordmine.llm import textcells as T
from wordmine.llm.common import bound_batches, id_and_text
from wordmine.session import materialise

# Kinds in the order of their names in results, and their patterns.
KINDS = ("email", "ip", "card", "phone")
EMAIL = re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
IP = re.compile(r"[0-9]+\.[0-9]+\.[0-9]+\.[0-9]+")
CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")

BLOOM_BITS = 1 << 24
_WORD = re.compile("[^\x20\x09-\x0D]+")
_RUN = re.compile("(?:[\x20\x09-\x0D]+[0-9(][^\x20\x09-\x0D]*)*")
_EDGE = "\"'([{<>}]),.;:!?"

SPAN = "array<struct<kind: string, start: bigint, end: bigint>>"


def _digits(text: str) -> str:
    return "".join(c for c in text if "0" <= c <= "9")


def _luhn(digits: str) -> bool:
    total = 0
    for k, c in enumerate(reversed(digits)):
        d = int(c) * (1 + k % 2)
        total += d - 9 * (d > 9)
    return total % 10 == 0


def base_spans(text: str) -> list[tuple[str, int, int]]:
    """(kind, start, end) in code points, by start and then kind."""
    out = []
    if "@" in text:
        out += [("email", *m.span()) for m in EMAIL.finditer(text)]
    out += [("ip", *m.span()) for m in IP.finditer(text) if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or 0) <= 255 for p in m[0].split("."))]
    for m in CARD.finditer(text):
        if m.end() - m.start() >= 12:
            d = _digits(m[0])
            if 12 <= len(d) <= 19 and _luhn(d):
                out.append(("card", *m.span()))
    if "+" in text:
        out += [("phone", *m.span()) for m in PHONE.finditer(text) if 9 <= len(_digits(m[0])) <= 15]
    return sorted(out, key=lambda s: (s[1], KINDS.index(s[0]), s[2]))


def context_word(word: str) -> str:
    """A word as patterns see it: lower case, without edge punctuation, digits as 0."""
    return re.sub("[0-9]+", "0", word.strip(_EDGE).lower())


def _word_begin(text: str, at: int) -> int:
    """Where the word begins that holds, or ends at, place ``at``; looked for backwards in steps that grow."""
    reach = 64
    while True:
        low = max(0, at - reach)
        found = max(text.rfind(c, low, at) for c in " \t\n\x0b\x0c\r")
        if found >= 0 or not low:
            return found + 1
        reach *= 4


def _words_before(text: str, at: int) -> list[str]:
    """The last two words, whole, of those that end before ``at``, however long they or the blanks between them are."""
    reach = 128
    while True:
        low = max(0, at - reach)
        found = list(_WORD.finditer(text, low, at))
        # a word at the border of what was looked at may begin before it
        whole = found if not low else [m for m in found if m.start() > low]
        if len(whole) >= 2 or not low:
            return [m[0] for m in whole[-2:]]
        reach *= 4


def _around(text: str, start: int, end: int) -> tuple[str, str, str, int, int]:
    """Two words before and one after the words that a span lies in, and where these begin and end."""
    begin = _word_begin(text, start)
    found = _WORD.search(text, max(end - 1, begin))
    stop = found.end() if found else end
    before = _words_before(text, begin)
    after = _WORD.search(text, stop)
    left = ["", "", *before][-2:]
    return context_word(left[0]), context_word(left[1]), context_word(after[0]) if after else "", begin, stop


def patterns_of(two: str, one: str, right: str) -> list[str]:
    """The lexical patterns of a place, the thing itself written as _."""
    return [f"{two} {one} _", f"{one} _ {right}"] if one else []


def _text_key(text):
    """A 64-bit hash of a text, the empty one for a null: with the id it names a row."""
    return F.xxhash64(F.coalesce(text.cast("string"), F.lit("")))


def _texts(batches, rows=T.BATCH_ROWS):
    """(ids, keys, texts) of slices of batches (doc_id, text, key)."""
    for batch in batches:
        for part, texts in T.text_slices(batch, rows=rows):
            yield part.column(0), part.column(2), texts


def _seeds(batches):
    """doc_id, key, spans, seeds (kind, instance, pattern)."""
    for ids, keys, texts in _texts(batches):
        digits = pc.match_substring_regex(texts, "[0-9@]").to_numpy(zero_copy_only=False)
        spans, seeds = [[] for _ in range(len(texts))], [[] for _ in range(len(texts))]
        for i in np.flatnonzero(digits).tolist():
            text = texts[i].as_py()
            spans[i] = base_spans(text)
            for kind, a, b in spans[i]:
                two, one, right, _, _ = _around(text, a, b)
                seeds[i] += [{"kind": kind, "instance": text[a:b], "pattern": p} for p in patterns_of(two, one, right)]
        spans = [[{"kind": k, "start": a, "end": b} for k, a, b in s] for s in spans]
        yield pa.record_batch([
            ids, keys,
            pa.array(spans, pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())]))),
            pa.array(seeds, pa.list_(pa.struct([("kind", pa.string()), ("instance", pa.string()), ("pattern", pa.string())]))),
        ], names=["doc_id", "key", "spans", "seeds"])


# -- looking patterns up -----------------------------------------------------

def _word_hash(words: list[str]) -> np.ndarray:
    import xxhash

    return np.fromiter((xxhash.xxh3_64_intdigest(w) for w in words), np.uint64, len(words))


def _pair_hash(a: np.ndarray, b: np.ndarray, side: int) -> np.ndarray:
    h = (a + np.uint64(side)) * np.uint64(0x9E3779B97F4A7C15)
    h = (h ^ (h >> np.uint64(29)) ^ b) * np.uint64(0xBF58476D1CE4E5B9)
    return h ^ (h >> np.uint64(32))


def _pattern_hash(patterns: list[str]) -> np.ndarray:
    parts = [p.split(" ") for p in patterns]
    side = np.array([p[2] == "_" for p in parts], bool)
    a = _word_hash([p[0] for p in parts])
    b = _word_hash([p[1] if s else p[2] for p, s in zip(parts, side.tolist(), strict=True)])
    return np.where(side, _pair_hash(a, b, 1), _pair_hash(a, b, 2))


def _bits(h: np.ndarray) -> list[np.ndarray]:
    return [((h >> np.uint64(s)) % np.uint64(BLOOM_BITS)).astype(np.int64) for s in (0, 24)]


def _bloom_words(batches):
    """Patterns to the 64-bit words of the filter and their bits."""
    for batch in batches:
        if batch.num_rows:
            at = np.concatenate(_bits(_pattern_hash(batch.column(0).to_pylist())))
            bits = (np.uint64(1) << (at % 64).astype(np.uint64)).view(np.int64)
            yield pa.record_batch([pa.array(at // 64), pa.array(bits)], names=["at", "bits"])


def bloom_filter(patterns: DataFrame) -> np.ndarray:
    """The filter as bytes of bits: at most BLOOM_BITS / 8 bytes, whatever the number of patterns."""
    words = (patterns.mapInArrow(_bloom_words, "at bigint, bits bigint").groupBy("at").agg(F.bit_or("bits").alias("bits"))).toArrow()
    out = np.zeros(BLOOM_BITS // 64, np.int64)
    out[words.column("at").to_numpy()] = words.column("bits").to_numpy()
    return out.view(np.uint64)


def _occurrences(bloom: np.ndarray):
    """Rows (pattern, n) of all places, and (pattern, instance, kind, doc_id, key, start, end) of identifier-like ones."""
    names = ["pattern", "n", "instance", "kind", "doc_id", "key", "start", "end"]

    def known(h):
        return np.logical_and.reduce([(bloom[at // 64] >> (at % 64).astype(np.uint64)) & np.uint64(1) != 0 for at in _bits(h)])

    def run(batches):
        if not bloom.any():
            return
        for ids, keys, texts in _texts(batches):
            offsets, index, words = T.ascii_words(texts, lower=False)
            if not len(index):
                continue
            like = pc.match_substring_regex(words, "[0-9@]").to_numpy(zero_copy_only=False)
            plain = [context_word(w) for w in T.strings(words)]
            h = _word_hash(plain)
            doc = np.repeat(np.arange(len(texts)), np.diff(offsets))
            n = len(index)
            word = h[index]
            none = _word_hash([""])[0]
            before = np.full(n, none)
            before[1:] = np.where(doc[1:] == doc[:-1], word[:-1], none)
            two = np.full(n, none)
            two[2:] = np.where(doc[2:] == doc[:-2], word[:-2], none)
            after = np.full(n, none)
            after[:-1] = np.where(doc[1:] == doc[:-1], word[1:], none)
            usable = before != none
            slots = _slots(texts, np.unique(doc[like[index]]))
            runs = [s for s in slots if s[2]]
            one_word = np.ones(n, bool)  # a run of words is one place with what follows it, not its first word
            one_word[[offsets[s[0]] + s[1] for s in runs]] = False
            pattern = [p for s in runs for p in patterns_of(*s[6:])[1:]]
            if pattern:
                pattern = [p for p, k in zip(pattern, known(_pattern_hash(pattern)).tolist(), strict=True) if k]
            for side, (a, b), places in ((1, (two, before), usable), (2, (before, after), usable & one_word)):
                at = np.flatnonzero(places & known(_pair_hash(a, b, side)))
                first = doc[at]

                def text_of(i, d):
                    return plain[index[i]] if 0 <= i < n and doc[i] == d else ""

                for i, d in zip(at.tolist(), first.tolist(), strict=True):
                    one = text_of(i - 1, d)
                    pattern.append(f"{text_of(i - 2, d)} {one} _" if side == 1 else f"{one} _ {text_of(i + 1, d)}")
            if pattern:
                coded = pa.array(pattern).dictionary_encode()
                count = np.bincount(coded.indices.to_numpy(), minlength=len(coded.dictionary))
                m = len(coded.dictionary)
                yield pa.record_batch([coded.dictionary, pa.array(count), *(pa.nulls(m, pa.string()) for _ in range(2)), *(pa.nulls(m, pa.int64()) for _ in range(4))], names=names)
            yield from _instances(ids, keys, texts, slots, known, names)

    return run


def _slots(texts, which) -> list[tuple]:
    """Places of identifier-like strings: (text, its first word's number, whether it spans words, kind or None, start, end, two, one, right)."""
    out: list[tuple] = []
    for i in which.tolist():
        text = texts[i].as_py()
        base, done = base_spans(text), 0
        words = list(_WORD.finditer(text))
        begins = [m.start() for m in words]
        for m in words:
            if m.start() < done or not re.search("[0-9@]", m[0]):
                continue
            end = _RUN.match(text, m.end()).end()
            inside = [s for s in base if s[1] < end and s[2] > m.start()]
            if inside:
                start, end = inside[0][1], inside[0][2]
            else:
                start = m.end() - len(m[0].lstrip(_EDGE))
                end = m.start() + len(text[m.start():end].rstrip(_EDGE.replace(")", "")))
            two, one, right, begin, stop = _around(text, start, max(end, start + 1))
            done = stop
            if end > start:
                first = bisect_left(begins, begin)
                out.append((i, first, words[first].end() < stop, inside[0][0] if inside else None, start, end, two, one, right))
    return out


def _instances(ids, keys, texts, slots, known, names):
    """Identifier-like strings of some texts, with the patterns around them that the filter knows."""
    found = [(p, texts[i].as_py()[start:end], kind, i, start, end) for i, _, _, kind, start, end, *around in slots for p in patterns_of(*around)]
    if found:
        keep = known(_pattern_hash([f[0] for f in found]))
        found = [f for f, k in zip(found, keep.tolist(), strict=True) if k]
    if found:
        at = pa.array([f[3] for f in found])
        yield pa.record_batch([
            pa.array([f[0] for f in found]), pa.nulls(len(found), pa.int64()), pa.array([f[1] for f in found]), pa.array([f[2] for f in found], pa.string()),
            T.as_array(ids).take(at).cast(pa.int64()), T.as_array(keys).take(at), pa.array([f[4] for f in found]), pa.array([f[5] for f in found]),
        ], names=names)


def believed(places: DataFrame, totals: DataFrame, rounds: int, precision: float, support: int) -> tuple[DataFrame, DataFrame]:
    """Scores of (pattern, kind) and of (instance, kind) after ``rounds`` rounds over their graph.

    ``places`` (pattern, instance, kind or null), ``totals`` (pattern, total).
    """
    edges = materialise(places.groupBy("pattern", "instance").agg(F.count(F.lit(1)).alias("n"), F.max("kind").alias("kind")), "pii-edges")
    seeds = edges.filter("kind is not null").groupBy("instance", "kind").agg(F.lit(1.0).alias("belief"))
    beliefs, patterns = seeds, None
    for _ in range(rounds):
        patterns = materialise(
            edges.select("pattern", "instance", "n").join(beliefs, "instance")
            .groupBy("pattern", "kind").agg(F.sum(F.col("n") * F.col("belief")).alias("met"), F.sum(F.when(F.col("belief") >= precision, 1).otherwise(0)).alias("support"))
            .join(totals, "pattern").select("pattern", "kind", "support", F.least(F.lit(1.0), F.col("met") / F.col("total")).alias("share")), "pii-patterns")
        good = patterns.filter((F.col("share") >= precision) & (F.col("support") >= support))
        doubt = F.sum(F.log(F.greatest(1 - F.col("share") * F.col("support") / (F.col("support") + 1), F.lit(1e-12))))
        found = (edges.filter("kind is null").select("pattern", "instance").join(good, "pattern")
                 .groupBy("instance", "kind").agg((1 - F.exp(doubt)).alias("belief")))
        beliefs = materialise(seeds.unionByName(found), "pii-beliefs")
    return patterns.filter((F.col("share") >= precision) & (F.col("support") >= support)), beliefs


def find_spans(docs: DataFrame, rounds: int = 3, precision: float = 0.75, support: int = 5, id_col: str = "doc_id",
               text_col: str = "text") -> DataFrame:
    """doc_id, key, spans, added: a row for each row of ``docs``.

    ``spans`` are the base spans, ``added`` those that high-confidence patterns
    found: patterns that meet at least ``support`` different believed instances,
    at ``precision`` of all their occurrences or more. ``key`` is a hash of the
    text; with doc_id it names a row.
    """
    texts = id_and_text(docs, id_col, text_col).withColumn("key", _text_key(F.col("text")))
    base = materialise(texts.mapInArrow(T.tidy(_seeds), f"doc_id bigint, key bigint, spans {SPAN}, seeds array<struct<kind: string, instance: string, pattern: string>>"), "pii-base")
    seeds = base.select(F.explode("seeds").alias("s")).select("s.*").distinct()
    enough = materialise(seeds.groupBy("pattern", "kind").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") >= support).select("pattern").distinct(), "pii-induced")
    filtered = texts.mapInArrow(T.tidy(_occurrences(bloom_filter(enough))), "pattern string, n bigint, instance string, kind string, doc_id bigint, key bigint, start bigint, end bigint")
    met = materialise(filtered.join(enough, "pattern", "left_semi"), "pii-occurrences")
    totals = met.filter("n is not null").groupBy("pattern").agg(F.sum("n").alias("total"))
    places = met.filter("instance is not null")
    good, beliefs = believed(places, totals, rounds, precision, support)
    new = (places.filter("kind is null").drop("kind", "n").join(good.select("pattern", "kind"), "pattern")
           .join(beliefs.filter(F.col("belief") >= precision), ["instance", "kind"])
           .select("doc_id", "key", "kind", "start", "end").distinct()
           .groupBy("doc_id", "key").agg(F.collect_list(F.struct("kind", "start", "end")).alias("added")))
    new = new.withColumnRenamed("doc_id", "_id").withColumnRenamed("key", "_key")
    out = base.select("doc_id", "key", "spans").join(new, F.col("doc_id").eqNullSafe(F.col("_id")) & (F.col("key") == F.col("_key")), "left")
    return out.select("doc_id", "key", "spans", F.coalesce("added", F.array().cast(SPAN)).alias("added"))


def of_kind(kind: str):
    """Whether a span is of a kind, for the higher-order array functions."""
    return lambda span: span["kind"] == kind


def spans_text(spans):
    """Spans as kind:start:end by start, then kind as listed, joined by commas."""
    order = F.array(*[F.lit(k) for k in KINDS])
    placed = F.transform(spans, lambda s: F.struct(s["start"].alias("start"), F.array_position(order, s["kind"]).alias("k"), s["end"].alias("end"), s["kind"].alias("kind")))
    return F.array_join(F.transform(F.array_sort(placed), lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def redact(docs: DataFrame, spans: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` with every span of ``find_spans`` in its text replaced by its kind in brackets."""
    every = F.concat("spans", "added")
    marked = (spans.select(F.col("doc_id").alias("_id"), F.col("key").alias("_key"), every.alias("_spans")).filter(F.size("_spans") > 0)
              .dropDuplicates(["_id", "_key"]))

    bound_batches(docs.sparkSession)

    @F.pandas_udf("string")
    def replaced(text: pd.Series, spans: pd.Series) -> pd.Series:
        return pd.Series([t if s is None or t is None else _replaced(t, s) for t, s in zip(text, spans, strict=True)], dtype=object)

    keyed = docs.withColumn("_text_key", _text_key(F.col(text_col)))
    joined = keyed.join(marked, F.col(id_col).eqNullSafe(F.col("_id")) & (F.col("_text_key") == F.col("_key")), "left")
    return joined.withColumn(text_col, replaced(F.col(text_col).cast("string"), "_spans")).drop("_id", "_key", "_spans", "_text_key")


def _replaced(text: str, spans) -> str:
    out, at = [], 0
    for s in sorted(spans, key=lambda s: (s["start"], -s["end"])):
        if s["start"] >= at:
            out += [text[at:s["start"]], f"[{s['kind'].upper()}]"]
            at = s["end"]
        else:  # overlaps the one before: both are gone
            at = max(at, s["end"])
    return "".join([*out, text[at:]])
