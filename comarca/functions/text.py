"""Text and key column functions: comparison keys, encoding repair, period ids, padded codes."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

# Accented capitals and the letters they compare as.
ACCENTED = "ÁÉÍÓÚÜÑÀÈÌÒÙÂÊÎÔÛ"
PLAIN = "AEIOUUNAEIOUAEIOU"

# Letters whose capital form has several characters. They are not letters of a key, so they separate
# words exactly as punctuation does.
EXPANDING = "ßŉǰΐΰևﬀﬁﬂﬃﬄﬅﬆ"

# Code points of text decoded with the wrong character set, and the letter meant.
# The order matters; code points are used because some of the characters are invisible.
REPAIRS: list[tuple[tuple[int, ...], str]] = [
    ((195, 161), "á"),
    ((195, 169), "é"),
    ((195, 173), "í"),
    ((195, 179), "ó"),
    ((195, 186), "ú"),
    ((195, 177), "ñ"),
    ((195, 188), "ü"),
    ((195, 8216), "Ñ"),
    ((195, 145), "Ñ"),
    ((195, 129), "Á"),
    ((195, 8240), "É"),
    ((195, 137), "É"),
    ((195, 141), "Í"),
    ((195, 8220), "Ó"),
    ((195, 147), "Ó"),
    ((195, 353), "Ú"),
    ((195, 154), "Ú"),
    ((65425,), "Ñ"),
    ((65427,), "Ó"),
]

# Spanish link words written in lower case inside a name.
LINK_WORDS = ["de", "del", "la", "las", "los", "el", "y", "e", "en"]


def normalize_name(value: Column) -> Column:
    """Comparison key: upper case, no accents, anything else a single space, trimmed."""
    plain = F.translate(F.upper(F.translate(value, EXPANDING, " " * len(EXPANDING))), ACCENTED, PLAIN)
    return F.trim(F.regexp_replace(plain, "[^A-Z0-9]+", " "))


def repair_text(value: Column) -> Column:
    def fix(col: Column, pair: tuple[tuple[int, ...], str]) -> Column:
        return F.replace(col, F.lit("".join(map(chr, pair[0]))), F.lit(pair[1]))

    return reduce(fix, REPAIRS, value)


def period_id(day: Column, freq: str) -> Column:
    """``YYYY``, ``YYYYQn`` or ``YYYY-MM`` for freq A, Q or M."""
    year = F.year(day).cast("string")
    if freq == "A":
        return year
    if freq == "Q":
        return F.concat(year, F.lit("Q"), F.quarter(day).cast("string"))
    if freq == "M":
        return F.concat(year, F.lit("-"), F.lpad(F.month(day).cast("string"), 2, "0"))
    raise ValueError(f"unknown frequency {freq!r}: use A, Q or M")


def pad_code(value: Column, width: int) -> Column:
    """Zero-padded code as text. A code longer than the width is kept whole, not cut."""
    text = value.cast("string")
    return F.when(F.length(text) <= width, F.lpad(text, width, "0")).otherwise(text)


def member_key(parent: Column, line: Column, total_line: int = 999) -> Column:
    """Parent code followed by the three-digit line; NULL on the parent's total row."""
    return F.when(line != total_line, F.concat(pad_code(parent, 2), pad_code(line, 3)))


def recode(value: Column, mapping: dict[str, str]) -> Column:
    """Replace the listed values, pass every other value through."""
    out = value
    for old, new in mapping.items():
        out = F.when(value == old, F.lit(new)).otherwise(out)
    return out


def title_case(value: Column) -> Column:
    """Names stored in capitals as they are written: dotted abbreviations kept, link words lowered."""

    def word(w: Column, i: Column) -> Column:
        bare = F.regexp_replace(F.lower(w), "^,+|,+$", "")
        kept = w.contains(".") | w.isin("-", "(")
        lowered = (i > 0) & bare.isin(LINK_WORDS)
        capital = F.concat(F.upper(F.substring(w, 1, 1)), F.lower(F.substring(w, 2, 1_000_000)))
        return F.when(kept, w).when(lowered, F.lower(w)).otherwise(capital)

    titled = F.array_join(F.transform(F.split(value, " "), word), " ")
    return F.when(value == F.upper(value), titled).otherwise(value)


def draw_hex(seed: int, *parts: Column) -> Column:
    """Reproducible pseudo-random hex text that depends on the keys only, never on partitioning."""
    return F.md5(F.concat_ws("|", F.lit(str(seed)), *[p.cast("string") for p in parts]))


def hex_to_long(text: Column, digits: int = 8) -> Column:
    return F.conv(F.substring(text, 1, digits), 16, 10).cast("long")
