"""Text clean-up and tokens, as built-in column expressions (no Python code runs in tasks)."""

from __future__ import annotations

import string

from pyspark.sql import Column
from pyspark.sql import functions as F

# These three characters become a blank before all others outside 32..126 go.
BLANKED = '\n"\\'

_SEPARATORS = BLANKED + "".join(c for c in string.punctuation if c not in BLANKED)
_CONTROLS = "".join(chr(i) for i in range(32) if chr(i) != "\n") + chr(127)


def clean_text(col) -> Column:
    """Newline, double quote and backslash to a blank, then drop every character outside 32..126."""
    return F.regexp_replace(blank_text(col), r"[^\x20-\x7E]+", "")


def blank_text(col) -> Column:
    """Newline, double quote and backslash to a blank; all other characters stay."""
    return F.translate(col, BLANKED, " " * len(BLANKED))


def tokenize(col) -> Column:
    """Lower-case tokens ``[a-z0-9]+`` of the cleaned text, in their order, repeats kept.

    Same tokens as ``regexp_extract_all(lower(clean_text(col)), '[a-z0-9]+')``, by one character
    translation and a split, which is cheaper than matching each token.
    """
    plain = F.translate(
        col,
        _SEPARATORS + string.ascii_uppercase + _CONTROLS,
        " " * len(_SEPARATORS) + string.ascii_lowercase,
    )
    return F.array_remove(F.split(F.regexp_replace(plain, r"[^\x20-\x7E]+", ""), " "), "")


def join_tokens(tokens) -> Column:
    """Tokens joined by a blank, with a blank before the first one; empty for no tokens."""
    tokens = F.col(tokens) if isinstance(tokens, str) else tokens
    return F.when(F.size(tokens) > 0, F.concat(F.lit(" "), F.concat_ws(" ", tokens))).otherwise("")


def keyword(col) -> Column:
    """The whole value as its only token."""
    return F.array(col)


def parent_folder(path) -> Column:
    """Name of the folder that holds the file; ``path`` may be URL-encoded."""
    return F.element_at(F.split(F.url_decode(path), "/"), -2)


def room_name(path) -> Column:
    """Parent folder without blanks and ``#``."""
    return F.translate(parent_folder(path), " #", "")
