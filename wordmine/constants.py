"""Fixed values that must equal the mined behaviour, stated once, in order.

Everything else in the package is derived from these or from parameters.
"""

# ---------------------------------------------------------------------------
# FIXED VALUES (trigger phrases, patterns, limits) -- do not reorder.
# ---------------------------------------------------------------------------

# Trigger phrases an author uses to say a string is not a word.
TRIGGER_PHRASES = [
    "is a made up word",
    "is a made-up word",
    "is a created word",
    "is not a common word",
    "is an invented word",
    "is not a real word",
    "is not a term",
    "is not a word",
]

# Collection targets per phrase (documents to land).
COLLECTION_TARGETS = {
    "is not a word": 173269,
    "is a made-up word": 4700,
    "is a made up word": 4754,
    "is not a common word": 2479,
    "is a created word": 169,
    "is an invented word": 1977,
}

MAX_DISP_LEN = 200          # tokens shown around a hit
MIN_WORD_LEN = 4            # shape filter, inclusive
MAX_WORD_LEN = 22           # shape filter, inclusive
TYPO_DISTANCE = 1           # Levenshtein threshold of the typo stage
BEAM_SIZE = 5               # segmentation beam
MAX_PIECE_LEN = 6           # longest subword piece

# Strip everything but ASCII letters from both ends of a word.
RX_EDGE = r"^[^a-zA-Z]+|[^a-zA-Z]+$"
# Rule-based sentence pieces; the pieces concatenate back to the text.
RX_SENT = r"(?s)[^.!?]*[.!?]+\s*|[^.!?]+$"
# A character that makes a token count as a word candidate.
RX_ALNUM = r"[\p{L}\p{N}]"

# Dictionary sources, in the order they are consulted.
DICTIONARY_SOURCES = ["collegiate", "medical"]

# Inflection detachment rules (suffix, replacement) of the public WordNet
# "morphy" procedure: noun, then verb, then adjective rules.
MORPHY_RULES = [
    ("s", ""), ("ses", "s"), ("xes", "x"), ("zes", "z"), ("ches", "ch"),
    ("shes", "sh"), ("men", "man"), ("ies", "y"),
    ("s", ""), ("ies", "y"), ("es", "e"), ("es", ""), ("ed", "e"),
    ("ed", ""), ("ing", "e"), ("ing", ""),
    ("er", ""), ("est", ""), ("er", "e"), ("est", "e"),
]

# ---------------------------------------------------------------------------
# Stand-ins used on the driver's synthetic tables (their prose never uses the
# trigger phrases above, so the registered queries mine these instead).
# ---------------------------------------------------------------------------
STANDIN_PHRASES = [
    "is the", "of the", "is a", "is of", "was the", "is that", "to the", "is in",
]

# Stand-in morphology table built from the word list: (suffix, features).
STANDIN_INFLECTIONS = [
    ("", "V;NFIN"), ("s", "V;3;SG;PRS"), ("ed", "V;PST"), ("ing", "V;V.PTCP;PRS"),
]
