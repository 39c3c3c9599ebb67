"""Folding and tokenising of page text."""

from __future__ import annotations

import unicodedata

from pyspark.sql import Column
from pyspark.sql import functions as F

TOKEN_PATTERN = r"[\p{L}\p{N}]+"


def _accent_table() -> tuple[str, str]:
    """Lower-case Latin letters whose canonical decomposition starts with an ASCII letter."""
    source, target = [], []
    for code in [*range(0xE0, 0x250), *range(0x1E00, 0x1F00)]:
        letter = chr(code)
        base = unicodedata.normalize("NFD", letter)[0]
        if letter == letter.lower() and base != letter and base.isascii():
            source.append(letter)
            target.append(base)
    return "".join(source), "".join(target)


_ACCENTED, _PLAIN = _accent_table()
_MARKS = "".join(chr(code) for code in range(0x300, 0x370))
_FOLDING = str.maketrans(_ACCENTED, _PLAIN, _MARKS)


def _is_ascii(text: Column) -> Column:
    return F.octet_length(text) == F.char_length(text)


def fold(text: Column) -> Column:
    """Lower-case and strip Latin diacritics; letters such as ß without a base stay as they are."""
    lowered = F.lower(text)
    return F.when(_is_ascii(text), lowered).otherwise(F.translate(lowered, _ACCENTED + _MARKS, _PLAIN))


def tokens(text: Column) -> Column:
    """Folded word tokens of a text, in order. Plain ASCII takes a cheaper pattern."""
    plain = F.regexp_extract_all(F.lower(text), F.lit("[a-z0-9]+"), F.lit(0))
    folded = F.translate(F.lower(text), _ACCENTED + _MARKS, _PLAIN)
    return F.when(_is_ascii(text), plain).otherwise(
        F.regexp_extract_all(folded, F.lit(TOKEN_PATTERN), F.lit(0))
    )


def query_terms(query: Column) -> Column:
    """Prefix terms of a search query; repeats are kept."""
    return tokens(query)


def literal_tokens(text: str) -> list[str]:
    """``tokens`` of a text known to the driver."""
    folded = text.lower().translate(_FOLDING)
    return "".join(c if unicodedata.category(c)[0] in "LN" else " " for c in folded).split()


def match_expression(query: Column) -> Column:
    """Quoted prefix terms joined by AND; null when the query has no token."""
    raw = F.regexp_extract_all(query, F.lit(TOKEN_PATTERN), F.lit(0))
    quoted = F.transform(raw, lambda t: F.concat(F.lit('"'), t, F.lit('"*')))
    return F.when(F.size(raw) > 0, F.array_join(quoted, " AND "))


def word_count(text: Column) -> Column:
    """Whitespace-separated words; zero for blank text."""
    return F.regexp_count(text, F.lit(r"(?U)\S+"))
