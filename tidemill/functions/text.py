"""Words and letters as columns."""

from __future__ import annotations

import unicodedata

from pyspark.sql import Column
from pyspark.sql import functions as F

TOKEN = r"[\p{L}\p{N}]+"


def _folding() -> tuple[str, str]:
    """Latin, Greek and Cyrillic letters with a mark, and the bare letter of each, by Unicode's own rule."""
    marked, bare = [], []
    for code in range(0xC0, 0x530):
        base = unicodedata.normalize("NFD", chr(code))
        if len(base) > 1 and unicodedata.category(base[0]).startswith("L"):
            marked.append(chr(code))
            bare.append(base[0])
    return "".join(marked), "".join(bare)


_MARKED, _BARE = _folding()


def unaccent(text: Column) -> Column:
    """Letters without their diacritics, composed or combining; texts in ASCII are only looked at."""
    bare = F.translate(F.regexp_replace(text, r"\p{Mn}", ""), _MARKED, _BARE)
    return F.when(text.rlike(r"[^\x00-\x7f]"), bare).otherwise(text)


def tokens(text: Column, fold: bool = True) -> Column:
    """The lower-case runs of letters and digits of a text, in order; diacritics folded unless told not to."""
    lowered = F.lower(text)
    return F.regexp_extract_all(unaccent(lowered) if fold else lowered, F.lit(TOKEN), F.lit(0))


def lines(text: Column) -> Column:
    return F.split(text, "\n", -1)


def content_hash(text: Column) -> Column:
    """The first 12 hex digits of the MD5 of a text's UTF-8 bytes."""
    return F.substring(F.md5(F.encode(text, "utf-8")), 1, 12)


def path_date(path: Column) -> Column:
    """The first ``dddd-dd-dd`` anywhere in a path, or null."""
    return F.nullif(F.regexp_extract(path, r"(\d{4}-\d{2}-\d{2})", 1), F.lit(""))


def path_stem(path: Column) -> Column:
    """The file name without its last suffix."""
    return F.regexp_replace(F.element_at(F.split(path, "/"), -1), r"(.)\.[^.]*$", "$1")


def tier(source: Column) -> Column:
    return F.when(source == "transcript", "secondary").otherwise("primary")
