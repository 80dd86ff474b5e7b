"""Column expressions on text that several operators share."""

from __future__ import annotations

import string

from pyspark.sql import Column
from pyspark.sql import functions as F

#: A word, by the contract of the operators that count words.
WORD = r"[^\x20\x09-\x0D]+"


def ascii_lower(text: Column) -> Column:
    """Lower-case A-Z only. lower() does the same on ASCII texts, and faster."""
    ascii_only = F.octet_length(text) == F.char_length(text)
    return F.when(ascii_only, F.lower(text)).otherwise(
        F.translate(text, string.ascii_uppercase, string.ascii_lowercase)
    )


def filled(text: Column) -> Column:
    """Null counts as the empty text."""
    return F.coalesce(text.cast("string"), F.lit(""))
