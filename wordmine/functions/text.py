"""Column expressions on words and texts.

All of them are built-in Spark SQL expressions (JVM side, inside whole-stage
codegen); none is a Python UDF.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..constants import MAX_WORD_LEN, MIN_WORD_LEN, RX_EDGE


def sql_str(value: str) -> str:
    """A Spark SQL string literal (for expressions built as text)."""
    return "'" + value.replace("\\", "\\\\").replace("'", "\\'") + "'"


def col_of(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def edge_strip(c) -> Column:
    """Strip every non-ASCII-letter from both ends; case is kept."""
    return F.regexp_replace(col_of(c), RX_EDGE, "")


def clean_text(c) -> Column:
    """Lower-case, keep a-z only; null becomes the empty string."""
    return F.coalesce(F.regexp_replace(F.lower(col_of(c)), "[^a-z]", ""), F.lit(""))


def normalise_word(c) -> Column:
    """Lower; one hyphen is removed, two or more reject; then ASCII letters only.

    Returns null for a rejected word.
    """
    w = F.lower(col_of(c))
    hyphens = F.length(w) - F.length(F.replace(w, F.lit("-"), F.lit("")))
    cleaned = F.replace(w, F.lit("-"), F.lit(""))
    return F.when((hyphens <= 1) & cleaned.rlike(r"^[a-z]+\z"), cleaned)


def letters_only(c) -> Column:
    """C4 (older variant): ASCII letters only, hyphens not repaired."""
    return col_of(c).rlike(r"^[a-zA-Z]+\z")


def length_ok(c, lo: int = MIN_WORD_LEN, hi: int = MAX_WORD_LEN) -> Column:
    """Length between ``lo`` and ``hi`` inclusive."""
    return F.length(col_of(c)).between(lo, hi)


def no_triple_run(c) -> Column:
    """No character three or more times in a row."""
    return ~col_of(c).rlike(r"(.)\1{2,}")


def capitalise(c) -> Column:
    """First character upper, the rest lower (Python ``str.capitalize``)."""
    w = col_of(c)
    return F.concat(F.upper(F.substring(w, 1, 1)), F.lower(F.substring(w, 2, 1 << 30)))


def surface_forms(word, org) -> Column:
    """Distinct of {word, Capitalised word, original form}, in that order."""
    w = col_of(word)
    return F.array_distinct(F.array_compact(F.array(w, capitalise(w), col_of(org))))


def lexicon_words(c) -> Column:
    """Lower-cased a-z runs of a text: the words of a word list."""
    return F.filter(F.split(F.lower(col_of(c)), "[^a-z]+"), lambda t: t != "")
