"""Text expressions: boilerplate, lengths, years, fences, redaction."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import tables as T
from .patterns import may_hit


#: White space of every kind, in a form that all engines read alike.
WHITE = r"[\s\x{0B}\x{1C}-\x{1F}\x{85}\p{Z}]"


def truthy(c: Column) -> Column:
    """The text unless it is empty (empty counts as missing, as null does)."""
    return F.when(c != "", c)


def strip_boilerplate(c: Column) -> Column:
    return F.regexp_replace(c, "(?i)" + "|".join(T.BOILERPLATE), "")


def meaningful_length(c: Column) -> Column:
    """Characters left without boilerplate, white space collapsed and trimmed; 0 for null."""
    return F.coalesce(F.length(F.trim(F.regexp_replace(strip_boilerplate(c), f"{WHITE}+", " "))), F.lit(0))


def page_type(c: Column) -> Column:
    return F.when(meaningful_length(c) >= T.TEXT_PAGE_CHARS, "text").otherwise("image")


def word_density(c: Column) -> Column:
    """Share of letters and digits; null for null and empty texts."""
    return F.when(F.length(c) > 0, F.length(F.regexp_replace(c, r"[^\p{L}\p{N}]", "")) / F.length(c))


def nonprintable_ratio(c: Column) -> Column:
    return F.when(F.length(c) > 0, F.length(F.regexp_replace(c, r"[^\p{Cc}\p{Cs}\p{Co}\p{Cn}]|[\n\t\r]", "")) / F.length(c))


def anchor_hits(c: Column) -> Column:
    low = F.lower(c)
    out = F.lit(0)
    for w in T.ANCHORS:
        out = out + F.coalesce(low.contains(w).cast("int"), F.lit(0))
    return out


def tax_year(c: Column, low: Column | None = None) -> Column:
    """The year after the first fitting mark that lies in the window, else the first year of this century in the window.

    ``low``: the text in lower case, where it is at hand; marks whose words it lacks aren't searched for.
    """
    lo, hi = T.YEARS
    tries = []
    for p in T.YEAR_PATTERNS:
        y = F.regexp_extract(c, f"(?id){p}", 1).try_cast("int")
        near = None if low is None else may_hit(low, p)
        tries.append(F.when(y.between(lo, hi) if near is None else near & y.between(lo, hi), y))
    rest = F.filter(F.transform(F.regexp_extract_all(c, F.lit(r"\b(20\d{2})\b"), 1), lambda x: x.cast("int")), lambda y: y.between(lo, hi))
    return F.coalesce(*tries, F.get(rest, F.lit(0)))


def period_year(year: Column, end: Column, start: Column) -> Column:
    """Tax year of a statement: as given, else the first four digits of the period's end, then start, within the window."""
    lo, hi = T.YEARS
    tries = [year.try_cast("int")]
    for c in (end, start):
        y = F.regexp_extract(c, r"^(\d{4})", 1).try_cast("int")
        tries.append(F.when(y.between(lo, hi), y))
    return F.coalesce(*tries)


def strip_fence(c: Column) -> Column:
    """Text without a leading code fence (with or without the word json) and a trailing one, trimmed."""
    return F.trim(F.regexp_replace(F.regexp_replace(F.trim(c), r"^```(?:json)?\s*", ""), r"\s*```$", ""))


def redact_ssn(c: Column) -> Column:
    """Dashed social security numbers keep their last four digits; employer numbers stay."""
    return F.regexp_replace(c, T.SSN_DASHED, "XXX-XX-$3")


def percent_text(c: Column) -> Column:
    return F.format_string("%.0f%%", F.bround(c * 100, 0))


def masked_last4(c: Column) -> Column:
    return F.when(c.isNull() | (c == ""), "").otherwise(F.concat(F.lit("XXXXX"), F.right(c, F.lit(4))))


def checkbox(c: Column) -> Column:
    return F.when(c.isNull(), "").when(c, "Y").otherwise("N")


def total_label(c: Column) -> Column:
    return F.initcap(F.replace(c, F.lit("_"), F.lit(" ")))


def brief(c: Column, limit: int = 500) -> Column:
    return F.substring(c, 1, limit)
