"""Text expressions: white space, fallbacks, metadata heuristics, headings, formulas and labels."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: White space in the wide sense (all Unicode spaces and line ends), for use inside a character class.
WIDE_SPACE = r"\s\u000B   -     　﻿"

# The five heading forms (numbered, capitals, named, Chinese chapter, Chinese numbered).
HEADINGS = (
    r"(?m)^(\d+\.?\d*\.?[WS]+)[A-Z][a-zA-Z[WS]]{2,}$",
    r"(?m)^[A-Z][A-Z[WS]]{3,30}$",
    r"(?im)^(Abstract|Introduction|Methods?|Results?|Discussion|Conclusion|References|Acknowledgements?|Appendix)$",
    r"(?m)^第[一二三四五六七八九十\d]+[章节]",
    r"(?m)^\d+(?:\.\d+)*[[WS]]+[一-龥]{2,10}$",
)


def _wide(pattern: str) -> str:
    return pattern.replace("[[WS]]", f"[{WIDE_SPACE}]").replace("[a-zA-Z[WS]]", f"[a-zA-Z{WIDE_SPACE}]").replace("[A-Z[WS]]", f"[A-Z{WIDE_SPACE}]").replace("[WS]", f"[{WIDE_SPACE}]")


def trimmed(c: Column) -> Column:
    """Without white space of any kind at either end."""
    return F.regexp_replace(c, f"^[{WIDE_SPACE}]+|[{WIDE_SPACE}]+$", "")


def filled(c: Column, fallback: Column) -> Column:
    """``fallback`` where ``c`` is null or empty."""
    return F.coalesce(F.nullif(c, F.lit("")), fallback)


def preview(c: Column, n: int) -> Column:
    """The first n characters, with an ellipsis if there are more."""
    text = F.coalesce(c, F.lit(""))
    return F.concat(F.substring(text, 1, n), F.when(F.length(text) > n, "…").otherwise(""))


def title_of(title: Column, file_name: Column) -> Column:
    return filled(title, F.regexp_replace(file_name, r"(?i)\.pdf$", ""))


def split_authors(c: Column) -> Column:
    """Author list from free text with commas or semicolons."""
    return F.filter(F.transform(F.split(F.coalesce(c, F.lit("")), "[,;]+"), trimmed), lambda x: x != "")


def abstract_of(text: Column) -> Column:
    """100 to 600 characters after the word abstract, or empty."""
    return trimmed(F.regexp_extract(F.coalesce(text, F.lit("")), f"(?i)abstract[:{WIDE_SPACE}]+(.{{100,600}})", 1))


def year_of(text: Column) -> Column:
    """The first year from 1900 to 2099 that is no part of a longer word or number, or 0."""
    return F.coalesce(F.regexp_extract(F.coalesce(text, F.lit("")), r"(?<![A-Za-z0-9_])((?:19|20)\d{2})(?![A-Za-z0-9_])", 1).try_cast("int"), F.lit(0))


def is_heading(text: Column) -> Column:
    """Whether a page holds a section heading on a line of its own."""
    out = F.lit(False)
    for pattern in HEADINGS:
        out = out | text.rlike(_wide(pattern))
    return F.coalesce(out, F.lit(False))


def without_fences(c: Column) -> Column:
    return trimmed(F.regexp_replace(c, "```json\n?|```", ""))


def page_label(start: Column, end: Column) -> Column:
    """One-based page range with an en dash."""
    return F.concat(F.lit("Pages "), (start + 1).cast("string"), F.lit("–"), (end + 1).cast("string"))


def source_label(start: Column, end: Column, title: Column) -> Column:
    return F.concat(page_label(start, end), F.lit(": "), F.coalesce(title, F.lit("")))


def display_math(c: Column) -> Column:
    """\\[…\\] as a block of double dollars."""
    return F.regexp_replace(c, f"(?s)\\\\\\[[{WIDE_SPACE}]*(.*?)[{WIDE_SPACE}]*\\\\\\]", "\n\\$\\$\n$1\n\\$\\$\n")


def inline_math(c: Column) -> Column:
    """\\(…\\) as single dollars, within a line."""
    return F.regexp_replace(c, r"\\\((.*?)\\\)", r"\$$1\$")


def ordered_join(order: list[str], text: str, separator: str) -> Column:
    """Aggregate: the texts in the given order, joined."""
    rows = F.array_sort(F.collect_list(F.struct(*order, F.coalesce(text, F.lit("")).alias("_t"))))
    return F.array_join(F.transform(rows, lambda r: r["_t"]), separator)


def allowed_url(c: Column) -> Column:
    """Whether a link may be opened: http and https only."""
    return F.coalesce(F.lower(F.regexp_extract(c, r"^([A-Za-z][A-Za-z0-9+.-]*):", 1)).isin("http", "https"), F.lit(False))


def clamped(c: Column, low: float, high: float) -> Column:
    return F.greatest(F.lit(low), F.least(F.lit(high), c))
