"""Amount expressions: text in the forms that statements use, to exact decimals."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Texts that stand for "no amount".
BLANKS = ("", "***", "-", "—", "N/A", "n/a")


def parse_amount(c: Column, kind: str = "decimal(18,2)") -> Column:
    """A text or number as a decimal; null where it is blank or no amount.

    Brackets or a trailing minus make it negative, and turn the sign of an amount that is negative already; one trailing
    minus, commas, dollar signs and brackets are dropped.
    """
    t = F.trim(c.cast("string"))
    negative = (t.startswith("(") & t.endswith(")")) | t.endswith("-")
    bare = F.trim(F.regexp_replace(F.regexp_replace(F.regexp_replace(t, r"[()]", ""), r"-$", ""), r"[,$]", ""))
    value = bare.try_cast(kind)
    return F.when(t.isin(*BLANKS), F.lit(None).cast(kind)).when(negative, -value).otherwise(value).cast(kind)


def parse_amount_map(c: Column) -> Column:
    """A map of texts with each value as an amount; null values stay null (null isn't zero)."""
    return F.transform_values(c, lambda _, v: parse_amount(v))


def money_text(c: Column, blank: str = "") -> Column:
    """Two decimals; ``blank`` for null; text that isn't a number as it is."""
    n = c.cast("string").try_cast("double")
    return F.when(c.isNull(), F.lit(blank)).when(n.isNull(), c.cast("string")).otherwise(F.format_string("%.2f", n))


def import_money_text(c: Column) -> Column:
    """Two decimals; ``0.00`` for null, empty and unreadable."""
    n = F.trim(c.cast("string")).try_cast("double")
    return F.when(n.isNull(), F.lit("0.00")).otherwise(F.format_string("%.2f", n))
