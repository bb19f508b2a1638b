"""Column helpers shared by the text operators."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Separators between words: space and the ASCII controls from tab to carriage return.
BLANKS = r"\x20\x09-\x0D"
WORD = f"[^{BLANKS}]+"


def words(text: Column) -> Column:
    """Words of a text; null gives an empty array."""
    return F.array_remove(F.split(F.coalesce(text, F.lit("")), f"[{BLANKS}]+"), "")


def crc_of_id(doc_id: Column) -> Column:
    """crc32 of the id written as text (null stays null)."""
    return F.crc32(doc_id.cast("string").cast("binary"))
