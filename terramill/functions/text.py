"""Text folding as built-in column expressions."""

from __future__ import annotations

import unicodedata
from functools import cache

from pyspark.sql import Column
from pyspark.sql import functions as F


@cache
def accent_table() -> tuple[str, str]:
    """Accented characters and their bases, by the rule of canonical decomposition.

    A character is entered if its decomposition without nonspacing marks is
    one other character; marks that stand alone are removed by ``deaccent``.
    """
    source, base = [], []
    for code in range(0xC0, 0x10000):
        char = chr(code)
        if 0xAC00 <= code <= 0xD7A3 or 0xD800 <= code <= 0xDFFF:
            continue
        bare = "".join(c for c in unicodedata.normalize("NFD", char) if unicodedata.category(c) != "Mn")
        if len(bare) == 1 and bare != char:
            source.append(char)
            base.append(bare)
    return "".join(source), "".join(base)


def deaccent(text: Column) -> Column:
    """Accents removed, composed and decomposed ones alike; null stays null."""
    source, base = accent_table()
    return F.regexp_replace(F.translate(text, source, base), r"\p{Mn}+", "")


def strip(text: Column) -> Column:
    """White space of any kind removed at both ends."""
    return F.regexp_replace(text, r"^[\s\p{Z}]+|[\s\p{Z}]+$", "")


def fold_category(text: Column) -> Column:
    """Folded category: stripped, lower case, without accents, blanks and hyphens as ``_``.

    Null stays null; a blank category becomes ''.
    """
    return F.translate(deaccent(F.lower(strip(text))), " -", "__")


def fold_label(text: Column) -> Column:
    """A label (split, source, author) without case and surrounding blanks; blank becomes null."""
    return F.nullif(F.lower(strip(text)), F.lit(""))


def words(text: Column) -> Column:
    """Longest runs of letters and digits after lower-casing and removing accents."""
    return F.regexp_extract_all(deaccent(F.lower(text)), F.lit(r"[\p{L}\p{N}]+"), 0)


def blank_to_null(text: Column) -> Column:
    return F.nullif(strip(text), F.lit(""))
