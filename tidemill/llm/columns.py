"""Column expressions shared by native operators."""

from __future__ import annotations

import string

from pyspark.sql import Column
from pyspark.sql import functions as F

#: What separates words that are runs of [0-9a-z] and of characters beyond ASCII, in text without A-Z.
NOT_WORD = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
NOT_SPACE = r"[^\x20\x09-\x0D]+"


def ascii_lower(text: Column) -> Column:
    """text with A-Z, and no other letters, in lower case."""
    return F.when(F.length(text) == F.octet_length(text), F.lower(text)).otherwise(F.translate(text, string.ascii_uppercase, string.ascii_lowercase))


def word_array(text: Column) -> Column:
    """The words of text, which holds no A-Z."""
    return F.array_remove(F.split(text, NOT_WORD), "")
