from .text import (capitalise, clean_text, edge_strip, length_ok, letters_only,
                   lexicon_words, no_triple_run, normalise_word, sql_str,
                   surface_forms)

__all__ = [
    "capitalise", "clean_text", "edge_strip", "length_ok", "letters_only",
    "lexicon_words", "no_triple_run", "normalise_word", "sql_str",
    "surface_forms",
]
