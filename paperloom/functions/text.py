"""Text functions as column expressions (no Python in the row path)."""

from __future__ import annotations

import unicodedata

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Unicode white space as a class of Java's regular expressions.
SPACE_CLASS = r"\t-\r \x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}"


def accent_table() -> tuple[str, str]:
    """Letters that are another letter with marks, and that letter in lower case, by the canonical decompositions of
    the Latin, Greek and Cyrillic blocks."""
    marked, plain = "", ""
    for code in [*range(0xC0, 0x530), *range(0x1E00, 0x1F00)]:
        low = chr(code).lower()
        parts = unicodedata.normalize("NFD", low)
        if len(low) == 1 and len(parts) > 1 and parts[0].isalpha() and all(unicodedata.combining(c) for c in parts[1:]):
            marked, plain = marked + chr(code), plain + parts[0]
    return marked, plain


_MARKED, _PLAIN = accent_table()


def once(df: DataFrame, **columns: Column) -> DataFrame:
    """`df` with computed columns that are evaluated once per row: the optimizer neither copies a generator into later
    expressions nor pushes a filter through it."""
    return df.select("*", F.inline(F.array(F.struct(*[c.alias(n) for n, c in columns.items()]))))


def fold(text: Column) -> Column:
    """Lower case without the marks of Latin letters."""
    return F.translate(F.lower(text), _MARKED, _PLAIN)


def tokenize(text: Column) -> Column:
    """Folded runs of letters and digits, in order; an empty array for null."""
    return F.coalesce(F.regexp_extract_all(fold(text), F.lit(r"[\p{L}\p{N}]+"), F.lit(0)), F.array().cast("array<string>"))


def squeeze(text: Column) -> Column:
    """Runs of white space become one blank, none at the ends."""
    return F.regexp_replace(F.regexp_replace(text, f"[{SPACE_CLASS}]+", " "), r"\A | \z", "")


def trim_all(text: Column) -> Column:
    return F.regexp_replace(text, rf"\A[{SPACE_CLASS}]+|[{SPACE_CLASS}]+\z", "")


def visible_chars(text: Column) -> Column:
    return F.length(F.regexp_replace(text, f"[{SPACE_CLASS}]", ""))


def token_estimate(text: Column) -> Column:
    """Runs of other than white space, at least 1."""
    return F.greatest(F.regexp_count(text, F.lit(f"[^{SPACE_CLASS}]+")), F.lit(1))


def first_non_empty(*texts: Column) -> Column:
    return F.coalesce(*[F.nullif(trim_all(t), F.lit("")) for t in texts])


def preview(text: Column, limit: int) -> Column:
    """The text if its bytes fit, else its first `limit` characters and three dots."""
    return F.when(F.octet_length(text) <= limit, text).otherwise(F.concat(F.left(text, F.lit(limit)), F.lit("...")))


def page_text(text: Column) -> Column:
    """Lines without white space at their ends, the whole without blank ends."""
    lines = F.transform(F.split(text, "\n"), lambda x: F.regexp_replace(x, rf"[{SPACE_CLASS}]+\z", ""))
    return trim_all(F.array_join(lines, "\n"))


def slug(text: Column) -> Column:
    """ASCII letters and digits in lower case, everything else one dash, none at the ends."""
    return F.regexp_replace(F.regexp_replace(F.lower(text), "[^a-z0-9]+", "-"), r"\A-|-\z", "")


def chunk_id(number: Column) -> Column:
    """`chunk-` and at least four digits, from 1."""
    return F.format_string("chunk-%04d", number)


def title_from_id(source_id: Column) -> Column:
    """Last part of a path without extension, words with capitals."""
    last = F.regexp_extract(source_id, r"([^/]+?)(?:\.[A-Za-z0-9]{1,5})?/?\z", 1)
    return F.initcap(squeeze(F.regexp_replace(last, r"[-_+]|%20", " ")))
