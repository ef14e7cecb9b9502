"""Text as column expressions: folding, tokens, normal forms of terms, domains, titles and breadcrumbs."""

from __future__ import annotations

import functools
import unicodedata

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Trailing words that a term's normal form drops, one at most.
SUFFIXES = ("model", "method", "framework", "dataset", "benchmark", "system", "approach")
WORD = r"[^\p{L}\p{N}_]+"


@functools.cache
def _accents() -> tuple[str, str]:
    """Letters below U+2000 that decompose to one base letter and marks, and those base letters."""
    marked, plain = [], []
    for i in range(0xC0, 0x2000):
        base = [c for c in unicodedata.normalize("NFD", chr(i)) if not unicodedata.combining(c)]
        if len(base) == 1 and base[0] != chr(i):
            marked.append(chr(i))
            plain.append(base[0])
    return "".join(marked), "".join(plain)


def strip_accents(x: Column) -> Column:
    """Without diacritics, for precomposed letters and for letters followed by combining marks."""
    bare = F.regexp_replace(F.translate(x, *_accents()), r"\p{Mn}+", "")
    return F.when(F.octet_length(x) == F.char_length(x), x).otherwise(bare)  # ASCII has none, and translate goes letter by letter


def tokens(x: Column) -> Column:
    """array<string>: maximal runs of letters and numbers, lower-cased, without diacritics; null has none."""
    return F.regexp_extract_all(F.lower(strip_accents(F.coalesce(x, F.lit("")))), F.lit(r"([\p{L}\p{N}]+)"), F.lit(1))


def spaced(x: Column) -> Column:
    """A text whose maximal runs of a-z, 0-9 and signs beyond ASCII are its tokens(); ASCII texts are lower-cased only."""
    own = F.coalesce(x, F.lit(""))
    ascii_only = F.is_valid_utf8(own) & (F.octet_length(own) == F.char_length(own))
    return F.when(ascii_only, F.lower(own)).otherwise(F.regexp_replace(F.lower(strip_accents(own)), r"[^\p{L}\p{N}]+", " "))


def normalize_term(x: Column) -> Column:
    """Lower case, other signs to single spaces, one trailing type word dropped."""
    clean = F.trim(F.regexp_replace(F.lower(x), WORD, " "))
    return F.regexp_replace(clean, rf" (?:{'|'.join(SUFFIXES)})$", "")


def sanitize_domain(x: Column) -> Column:
    """Lower case, white space and slashes to `_`, only a-z 0-9 _ -, 64 signs at most, no `_` or `-` at the ends."""
    clean = F.regexp_replace(F.regexp_replace(F.lower(x), r"[\s/]+", "_"), "[^a-z0-9_-]", "")
    return F.regexp_replace(F.substring(clean, 1, 64), "^[_-]+|[_-]+$", "")


def breadcrumb_token(x: Column) -> Column:
    """A heading as it is compared: no bold or italic marks, number prefix or trailing colon, single spaces, lower case."""
    bare = F.regexp_replace(F.trim(x), r"^(\*\*|__|\*|_)(.*)\1$", "$2")
    bare = F.regexp_replace(bare, r"^\d+(?:\.\d+)*\.?\s+", "")
    return F.lower(F.trim(F.regexp_replace(F.regexp_replace(F.trim(bare), r":+$", ""), r"\s+", " ")))


def first_line(x: Column) -> Column:
    return F.substring_index(x, "\n", 1)


def head(x: Column, most: int) -> Column:
    return F.substring(x, 1, most)


def figure_refs(x: Column) -> Column:
    """array<int>: numbers of a text's `(figure:N)` references, each once, in the order of their first places."""
    return F.array_distinct(F.transform(F.regexp_extract_all(x, F.lit(r"\(figure:(\d{1,9})\)"), F.lit(1)), lambda n: n.cast("int")))
