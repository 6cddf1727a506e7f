"""Vectorised text helpers used inside tasks by the operators of this subpackage.

A *chunk* is a stretch of a text between two places where it may be cut without
changing how the text is tokenised. Splitting a batch of texts into chunks and
dictionary-encoding them is native Arrow code, so per-chunk Python work (the BPE
merges, a classifier's features) runs once per distinct chunk of a batch and the
per-document results are gathered with numpy.
"""

from __future__ import annotations

import json
import re
import unicodedata
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

# White space of any regex dialect, and characters on which dialects differ. A
# single space next to one of these is not used as a cutting place.
_ODD = r"\s\x1c-\x1f\x85\xa0\u180e\u200b\u2060\ufeff"
_ODD_RE2 = r"\s\x0b\x1c-\x1f\x{85}\x{a0}\x{1680}\x{180e}\x{2000}-\x{200b}\x{2028}\x{2029}\x{202f}\x{205f}\x{2060}\x{3000}\x{feff}"
_UNSAFE_RE2 = f"[{_ODD_RE2}] | [{_ODD_RE2}]"
_SAFE_CUT = re.compile(f"(?<![{_ODD}]) (?![{_ODD}])")

# Special tokens begin with this; the library finds them inside texts.
_SPECIAL = "<|"

BATCH_ROWS = 1000
BATCH_BYTES = 8 << 20


def as_array(column) -> pa.Array:
    """A chunked or plain Arrow column as one array."""
    if isinstance(column, pa.ChunkedArray):
        return column.combine_chunks() if column.num_chunks != 1 else column.chunk(0)
    return column


def text_slices(batch: pa.RecordBatch, column: str = "text", rows: int = BATCH_ROWS, most_bytes: int = BATCH_BYTES):
    """Slices of a batch with the null texts replaced by empty ones: (batch slice, text array).

    A slice has at most ``rows`` rows and ``most_bytes`` bytes of text; a longer text is alone.
    """
    size = pc.binary_length(batch.column(batch.schema.get_field_index(column)))
    ends = np.cumsum(pc.fill_null(size, 0).to_numpy(zero_copy_only=False).astype(np.int64))
    at = 0
    while at < batch.num_rows:
        before = int(ends[at - 1]) if at else 0
        upto = min(at + rows, max(at + 1, int(np.searchsorted(ends, before + most_bytes, side="right"))))
        part = batch.slice(at, upto - at)
        yield part, pc.fill_null(part.column(part.schema.get_field_index(column)).cast(pa.string()), "")
        at = upto


def strings(values: pa.Array) -> list[str]:
    return values.to_numpy(zero_copy_only=False).tolist()


def space_chunks(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, list[str]]:
    """Cut texts before single spaces between two non-space characters.

    Returns (offsets, index, chunks): text i is the concatenation of
    ``chunks[k] for k in index[offsets[i]:offsets[i + 1]]``. Each chunk but a
    text's first starts with its space, as byte-level pre-tokenisers want it:
    none of their tokens crosses such a place. ``chunks`` may repeat.
    """
    unsafe = pc.match_substring_regex(texts, _UNSAFE_RE2).to_numpy(zero_copy_only=False)
    lists = pc.split_pattern(texts, " ")
    flat, offsets = lists.flatten(), np.asarray(lists.offsets).astype(np.int64)
    offsets = offsets - offsets[0]
    coded = pc.dictionary_encode(flat)
    index = coded.indices.to_numpy().astype(np.int64)
    chunks = [" " + x for x in strings(coded.dictionary)]
    heads = offsets[:-1]
    index[heads] = len(chunks) + np.arange(len(heads))
    chunks += strings(flat.take(pa.array(heads)))
    if not unsafe.any():
        return offsets, index, chunks
    # texts with runs of white space: cut only at the places that are safe
    parts, lengths = [], np.diff(offsets)
    for i in range(len(texts)):
        if not unsafe[i]:
            parts.append(index[offsets[i]:offsets[i + 1]])
            continue
        pieces = _SAFE_CUT.split(texts[i].as_py())
        pieces = pieces[:1] + [" " + x for x in pieces[1:]]
        parts.append(len(chunks) + np.arange(len(pieces)))
        chunks += pieces
        lengths[i] = len(pieces)
    return np.concatenate([[0], np.cumsum(lengths)]), np.concatenate(parts), chunks


def ascii_words(texts: pa.Array, lower: bool) -> tuple[np.ndarray, np.ndarray, pa.Array]:
    """Words ``[^\\x20\\x09-\\x0D]+`` of each text: (offsets, index, distinct words)."""
    flat_text = pc.ascii_lower(texts) if lower else texts
    lists = pc.ascii_split_whitespace(flat_text)
    flat, offsets = lists.flatten(), np.asarray(lists.offsets).astype(np.int64)
    offsets = offsets - offsets[0]
    coded = pc.dictionary_encode(flat)
    index = coded.indices.to_numpy().astype(np.int64)
    words = coded.dictionary
    empty = pc.index(words, pa.scalar("", words.type)).as_py()
    if empty >= 0:  # leading or trailing white space leaves empty strings
        kept = index != empty
        before = np.concatenate([[0], np.cumsum(kept)])
        offsets, index = before[offsets], index[kept]
        index -= index > empty
        words = pa.concat_arrays([words.slice(0, empty), words.slice(empty + 1)])
    return offsets, index, words


def gather_ragged(flat: np.ndarray, starts: np.ndarray, lengths: np.ndarray, index: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Concatenate the pieces ``flat[starts[k]:starts[k] + lengths[k]] for k in index``.

    Returns (values, ends): ``ends[j]`` is the end of the j-th piece in values.
    """
    n = lengths[index]
    ends = np.cumsum(n)
    total = int(ends[-1]) if len(ends) else 0
    place = np.arange(total, dtype=np.int64)
    place += np.repeat(starts[index] - (ends - n), n)
    return flat[place], ends


def _byte_alphabet() -> dict[str, int]:
    """The printable characters that byte-level vocabulary files write for bytes."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    table = {chr(b): b for b in plain}
    for n, b in enumerate(b for b in range(256) if b not in set(plain)):
        table[chr(0x100 + n)] = b
    return table


def byte_ranks(path: str) -> dict[bytes, int]:
    """The ranks of a byte-level vocabulary file (``.tiktoken`` or ``.json``), without special tokens."""
    import base64

    if not path.endswith(".json"):
        with open(path, "rb") as f:
            return {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    alphabet = _byte_alphabet()
    with open(path, encoding="utf-8") as f:
        vocab = json.load(f)
    special = {x["content"] for x in vocab["added_tokens"]}
    return {bytes(alphabet[c] for c in token): i for token, i in vocab["model"]["vocab"].items() if token not in special}


class _Remembering:
    """Ids of distinct chunks, remembered up to ``remember`` entries per Python worker."""

    def __init__(self, remember: int):
        self._known: dict[str, bytes] = {}
        self._remember = remember

    def _missing(self, chunks: list[str]) -> None:
        raise NotImplementedError

    def _store(self, chunks: list[str], ids: np.ndarray, mark: int) -> None:
        """``ids`` holds the ids of the chunks, each followed by ``mark``."""
        ends, data = np.flatnonzero(ids == mark) * 4, ids.tobytes()
        starts = np.concatenate([[0], ends[:-1] + 4])
        self._known.update(zip(chunks, (data[a:b] for a, b in zip(starts.tolist(), ends.tolist(), strict=True)), strict=True))

    def _store_one(self, chunk: str, ids: list[int]) -> None:
        self._known[chunk] = np.array(ids, np.uint32).tobytes()

    def forget(self) -> None:
        self._known = {}

    def encode_chunks(self, chunks: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(flat ids, starts, lengths) of the chunks, in order."""
        known = self._known
        if len(known) + len(chunks) > self._remember:
            known.clear()
        missing = [c for c in chunks if c not in known]
        if missing:
            self._missing(missing)
        parts = list(map(known.__getitem__, chunks))
        lengths = np.fromiter(map(len, parts), np.int64, len(parts)) // 4
        return np.frombuffer(b"".join(parts), np.uint32), np.cumsum(lengths) - lengths, lengths


class ByteBpe(_Remembering):
    """Ids of byte-level chunks by the ranks of a vocabulary file (``.tiktoken`` or ``.json``).

    Merges run in tiktoken. Chunks whose only white space is single and not at
    their end go through one call for the whole batch: there the pattern needs
    no look-ahead, and a byte 0 between chunks is a token of its own. All other
    chunks are encoded one by one with the full pattern.
    """

    _ONE_SPACE = r"\x00|'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}\x00]+|\s"
    _FULL_CALL = re.compile(r"[\s\x1c-\x1f\x85][\s\x1c-\x1f\x85\x00]|\x00\x00")

    def __init__(self, path: str, pattern: str, remember: int = 500_000):
        import tiktoken

        super().__init__(remember)
        self._path = path
        ranks = byte_ranks(path)
        self.ranks = ranks
        self._encode = tiktoken.Encoding("ranks", pat_str=pattern, mergeable_ranks=ranks, special_tokens={}).encode_ordinary
        self._encode_many = tiktoken.Encoding("batch", pat_str=self._ONE_SPACE, mergeable_ranks=ranks, special_tokens={}).encode_ordinary

    def _missing(self, chunks: list[str]) -> None:
        joined = "\0".join(chunks) + "\0"
        if joined.count("\0") != len(chunks) or self._FULL_CALL.search(joined) or joined[0] == "\0":
            alone = [c for c in chunks if "\0" in c or not c or self._FULL_CALL.search(c + "\0")]
            for c in alone:
                self._store_one(c, self._encode(c))
            chunks = [c for c in chunks if c not in self._known]
            joined = "\0".join(chunks) + "\0"
        if chunks:
            self._store(chunks, np.array(self._encode_many(joined), np.uint32), self.ranks[b"\0"])

    def encode_texts(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """(ids, offsets): the ids of text i are ``ids[offsets[i]:offsets[i + 1]]``."""
        def plain(part):
            return _per_text(*space_chunks(part), self.encode_chunks)

        # a rank file has no special tokens
        return _with_specials(texts, _SPECIAL, plain, lambda: once(_library, self._path)) if self._path.endswith(".json") else plain(texts)


class WordBpe(_Remembering):
    """Ids of the lower-casing word-end BPE of a tokenizers ``.json`` file.

    White space never lies inside one of its tokens, so texts are cut at ASCII
    white space. Chunks of Latin letters, digits and punctuation are normalised
    and split here, and merged by tiktoken's merge loop over the file's own
    vocabulary (a word end is the byte 0 there); any other chunk goes through
    the tokenizers library itself.
    """

    _PIECES = r"('s|'t|'re|'ve|'m|'ll|'d|\p{L}+|\p{N}|[^\s\p{L}\p{N}]+)"
    _NOT_PLAIN = re.compile("[^\n\x21-\x7e\xa1-\xac\xae-\u017f]")
    _MARKS = ".,;:!?"
    _END = "</w>"

    def __init__(self, path: str, remember: int = 500_000):
        import tiktoken
        from tokenizers import Tokenizer

        super().__init__(remember)
        self._path = path
        self._library = Tokenizer.from_file(path)
        self._library.encode_special_tokens = True
        alphabet = _byte_alphabet()
        with open(path, encoding="utf-8") as f:
            vocab = json.load(f)
        special = {x["content"] for x in vocab["added_tokens"]}
        ranks = {}
        for token, i in vocab["model"]["vocab"].items():
            if token not in special:
                body, end = (token[: -len(self._END)], b"\0") if token.endswith(self._END) else (token, b"")
                ranks[bytes(alphabet[c] for c in body) + end] = i
        self._line = ranks[b"\n"]
        self._encode = tiktoken.Encoding("words", pat_str=r"[^\x00\n]+\x00|\n", mergeable_ranks=ranks, special_tokens={}).encode_ordinary

    def _missing(self, chunks: list[str]) -> None:
        joined = "\n".join(chunks) + "\n"
        if joined.count("\n") != len(chunks) or self._NOT_PLAIN.search(joined) or joined[0] == "\n":
            for c in chunks:
                if not c or "\n" in c or self._NOT_PLAIN.search(c):
                    self._store_one(c, self._library.encode(c, add_special_tokens=False).ids)
            chunks = [c for c in chunks if c not in self._known]
            joined = "\n".join(chunks) + "\n"
        if chunks:
            lower = unicodedata.normalize("NFC", joined).lower().split("\n")[:-1]
            # the pieces of most chunks are plain to see: letters, or letters and a mark
            marked = [c + "\0" if c.isalpha() else f"{c[:-1]}\0{c[-1]}\0" if c[-1:] in self._MARKS and c[:-1].isalpha() else ""
                      for c in lower]
            others = [c for c, m in zip(lower, marked, strict=True) if not m]
            if others:
                pieces = pc.replace_substring_regex(pa.array(["\n".join(others)]), self._PIECES, "\\1\0")[0].as_py()
                cut = iter(pieces.split("\n"))
                marked = [m or next(cut) for m in marked]
            self._store(chunks, np.array(self._encode("\n".join(marked) + "\n"), np.uint32), self._line)

    def encode_texts(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        def plain(part):
            offsets, index, words = ascii_words(part, lower=False)
            return _per_text(offsets, index, strings(words), self.encode_chunks)

        return _with_specials(texts, _SPECIAL, plain, lambda: once(_library, self._path))


def _with_specials(texts: pa.Array, mark: str, encode, library) -> tuple[np.ndarray, np.ndarray]:
    """``encode(texts)``, but texts that hold ``mark``, as all special tokens do, go through the library's own way."""
    flags = pc.match_substring(texts, mark).to_numpy(zero_copy_only=False)
    if not flags.any():
        return encode(texts)
    ids, offsets = encode(pc.if_else(pa.array(flags), "", texts))
    parts, at = [], 0
    sizes = np.diff(offsets)
    for i in np.flatnonzero(flags).tolist():
        own = np.array(library().encode(texts[i].as_py(), add_special_tokens=False).ids, ids.dtype)
        parts += [ids[at:offsets[i]], own]
        at, sizes[i] = offsets[i], len(own)
    return np.concatenate([*parts, ids[at:]]), np.concatenate([[0], np.cumsum(sizes)])


def _library(path: str):
    from tokenizers import Tokenizer

    return Tokenizer.from_file(path)


def _per_text(offsets, index, chunks, encode) -> tuple[np.ndarray, np.ndarray]:
    flat, starts, lengths = encode(chunks)
    ids, ends = gather_ragged(flat, starts, lengths, index)
    return ids, np.concatenate([[0], ends])[offsets]


_MADE: dict = {}


def once(kind, *args):
    """One object per Python worker: ``kind(*args)``, built on first use."""
    key = (kind, *args)
    if key not in _MADE:
        _MADE[key] = kind(*args)
    return _MADE[key]


def give_back() -> None:
    """Give the system back what a task leaves in its Python worker, which later stages use again.

    What tokenizers remember goes; the tokenizers themselves stay, as building them is dear.
    """
    import ctypes
    import gc

    for made in _MADE.values():
        if isinstance(made, _Remembering):
            made.forget()
    gc.collect()
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError):  # another C library: it keeps what it keeps
        pass


def tidy(run):
    """``run``, a generator over batches, that gives memory back when its task ends."""
    def tidied(batches):
        try:
            yield from run(batches)
        finally:
            give_back()

    return tidied


def tidy_group(run):
    """``run``, a function of a group's table, that gives memory back after every group."""
    def tidied(table):
        try:
            return run(table)
        finally:
            give_back()

    return tidied


def flat_ints(lists) -> np.ndarray:
    return np.fromiter(chain.from_iterable(lists), np.int64)
