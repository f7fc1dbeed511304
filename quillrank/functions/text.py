"""Markup cleaning and text analysis as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed value: decides which characters go. Single brackets share a class, which matches the same and runs faster.
MARKUP = r"[\[\]]|'{2,3}|\{\{|\}\}"
# Defaults of the length filter and of the analyzer.
MIN_BODY_CHARS = 50
MAX_TOKEN_BYTES = 39

# Unicode white space; Java's class leaves out four separators.
_SPACE = r"[\s\x1c-\x1f]"
# The same characters spelled out, for trimming.
_BLANKS = "".join(
    map(chr, [*range(0x09, 0x0E), *range(0x1C, 0x21), 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000])
)
_NON_WORD = r"[^\p{IsAlphabetic}\p{N}]+"


def clean_markup(raw: Column, max_chars: int | None = None) -> Column:
    """Strip wiki markup, collapse white space, trim; keep all, or the first ``max_chars`` code points.

    Runs of white space, and single line breaks and tabs, become one blank.
    """
    text = F.regexp_replace(raw, MARKUP, "")
    text = F.regexp_replace(text, rf"(?U){_SPACE}{{2,}}|[\n\t]", " ")
    return strip(text) if max_chars is None else F.substring(strip(text), 1, max_chars)


def strip(text: Column) -> Column:
    """Remove white space of any kind from both ends."""
    return F.btrim(text, F.lit(_BLANKS))


def is_long_enough(body: Column, min_chars: int = MIN_BODY_CHARS) -> Column:
    return F.length(body) >= min_chars


def word_slots(text: Column, max_bytes: int = MAX_TOKEN_BYTES) -> Column:
    """Lower-cased words by position; over-long words leave a null so positions keep their gap."""
    words = F.split(F.coalesce(text, F.lit("")), _NON_WORD)
    return F.transform(words, lambda w: F.when(F.octet_length(w).between(1, max_bytes), F.lower(w)))


def words(text: Column, max_bytes: int = MAX_TOKEN_BYTES) -> Column:
    """Lower-cased words of ``text`` in order, without the over-long ones."""
    split = F.split(F.coalesce(text, F.lit("")), _NON_WORD)
    kept = F.filter(split, lambda w: F.octet_length(w).between(1, max_bytes))
    return F.transform(kept, lambda w: F.lower(w))


def cache_key(text: Column) -> Column:
    """Key under which texts share one embedding: trimmed and lower-cased."""
    return F.lower(strip(text))
