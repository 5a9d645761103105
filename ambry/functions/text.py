"""Text columns: folding, slugs, words, windows of words, summaries."""

from __future__ import annotations

import unicodedata

from pyspark.sql import Column
from pyspark.sql import functions as F

# White space as web clients understand it: Java's \s, the Unicode separators and
# the byte-order mark. Spelling the separators out as ranges is four times slower.
BLANK = r"[\s\p{Z}\x{feff}]"


def _accent_table() -> tuple[str, str]:
    """Latin letters that decompose to one base letter, and the marks to drop."""
    source, target = [], []
    for block in (range(0x00C0, 0x0250), range(0x1E00, 0x1F00)):
        for code in block:
            plain = "".join(
                c for c in unicodedata.normalize("NFD", chr(code)) if not unicodedata.combining(c)
            )
            if len(plain) == 1 and plain != chr(code):
                source.append(chr(code))
                target.append(plain)
    marks = [chr(code) for code in range(0x0300, 0x0370)]
    return "".join(source + marks), "".join(target)


_ACCENTED, _PLAIN = _accent_table()


def strip_accents(col: Column) -> Column:
    """Letters without their marks; combining marks are removed. ASCII passes untouched."""
    ascii_only = F.octet_length(col) == F.length(col)
    return F.when(ascii_only, col).otherwise(F.translate(col, _ACCENTED, _PLAIN))


def fold(col: Column) -> Column:
    """Accent- and case-insensitive form that keeps white space as it is."""
    return F.lower(strip_accents(col))


def squeeze(col: Column) -> Column:
    """Runs of white space become one space; none is left at the ends."""
    return F.trim(F.regexp_replace(col, BLANK + "+", " "))


def fold_squeeze(col: Column) -> Column:
    """``fold`` for names and titles: white space is collapsed as well."""
    return squeeze(fold(col))


def slugify(col: Column) -> Column:
    """URL form: folded, every other run of characters is one dash."""
    dashed = F.regexp_replace(fold(col), "[^a-z0-9]+", "-")
    return F.regexp_replace(dashed, "^-+|-+$", "")


def words(col: Column) -> Column:
    """The white-space separated words of a text, in order."""
    return F.filter(F.split(col, BLANK + "+"), lambda w: w != "")


def count_words(col: Column) -> Column:
    return F.size(words(col))


def tokens(col: Column) -> Column:
    """Folded alphanumeric tokens, in order, with repeats."""
    return F.filter(F.split(fold(col), "[^a-z0-9]+"), lambda t: t != "")


def opening_words(col: Column, limit: int = 2500) -> Column:
    """The first ``limit`` words, single-spaced."""
    return F.array_join(F.slice(words(col), 1, limit), " ")


def sample_text(
    word_list: Column, head: int = 1500, middle: int = 1500, tail: int = 800
) -> Column:
    """Head, middle and tail of a long word list; short ones are kept whole."""
    n = F.size(word_list)
    mid_start = F.floor((n - middle) / 2).cast("int")
    parts = F.array(
        F.array_join(F.slice(word_list, 1, head), " "),
        F.array_join(F.slice(word_list, mid_start + 1, F.lit(middle)), " "),
        F.array_join(F.slice(word_list, n - tail + 1, F.lit(tail)), " "),
    )
    return F.when(n <= head + middle + tail, F.array_join(word_list, " ")).otherwise(
        F.array_join(parts, "\n[…]\n")
    )


# Marks that a shortened text does not end in.
LOOSE_ENDS = " .,;:\u2014\u2013-"


def summarise(col: Column, limit: int = 160) -> Column:
    """A description of at most ``limit`` characters: whole words, if they fill more than half of it."""
    flat = squeeze(col)
    cut = F.left(flat, F.lit(limit))
    whole = F.regexp_extract(cut, f"^(.{{{limit // 2 + 1},}}) ", 1)
    body = F.rtrim(F.coalesce(F.nullif(whole, F.lit("")), cut), F.lit(LOOSE_ENDS))
    return F.when(F.length(flat) <= limit, flat).otherwise(F.concat(body, F.lit("\u2026")))


# The five characters markup must escape, ampersand first.
_MARKUP = [("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;")]


def _escape(col: Column, apostrophe: str) -> Column:
    for raw, entity in [*_MARKUP, ("'", apostrophe)]:
        col = F.replace(col, F.lit(raw), F.lit(entity))
    return col


def escape_html(col: Column) -> Column:
    return _escape(col, "&#39;")


def escape_xml(col: Column) -> Column:
    return _escape(col, "&apos;")


def url_segment(col: Column) -> Column:
    """Percent-encoding of one path segment; a blank is %20, never a plus."""
    encoded = F.replace(F.url_encode(col), F.lit("+"), F.lit("%20"))
    # the marks browsers leave alone in a path segment
    for code, char in [("%21", "!"), ("%27", "'"), ("%28", "("), ("%29", ")"), ("%7E", "~")]:
        encoded = F.replace(encoded, F.lit(code), F.lit(char))
    return encoded


def reading_minutes(word_count: Column, per_minute: int = 200) -> Column:
    return F.greatest(F.lit(1), F.floor(word_count / per_minute + 0.5)).cast("int")


def title_of(col: Column) -> Column:
    """The opening sentence or line of a text, used where no title is stored."""
    return F.trim(F.regexp_extract(col, r"^[^.\n]*", 0))
