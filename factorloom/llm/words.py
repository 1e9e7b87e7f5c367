"""Words, as every operator here cuts them: runs of bytes outside [\\x20\\x09-\\x0D]."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

SPACE = r"[\x20\x09-\x0D]+"


def lower_words(text: str | None) -> list[bytes]:
    """UTF-8 words with only A-Z lower-cased; bytes.split and bytes.lower know exactly those ASCII rules."""
    return text.encode("utf-8", "replace").lower().split() if text else []


def word_count(text: Column) -> Column:
    """Number of words as a native expression; null counts as empty."""
    return F.size(F.filter(F.split(F.coalesce(text, F.lit("")), SPACE), lambda w: w != "")).cast("long")
