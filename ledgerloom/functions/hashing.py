"""Invented replacements, chosen by the MD5 of the original.

The hash is a 128-bit number; remainders are folded over its hex digits, so everything stays in SQL expressions. A shift
by 4k bits drops the last k hex digits. The ``*_of`` functions give the same values for single texts.
"""

from __future__ import annotations

import hashlib

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import tables as T


def md5_mod(c: Column, modulus: int, drop: int = 0) -> Column:
    """``(md5(c) >> 4 * drop) mod modulus``, from the upper 64 bits and the rest."""
    h = F.md5(c.cast("binary"))
    wide = lambda part: F.conv(part, 16, 10).cast("decimal(20,0)")
    m = F.lit(modulus).cast("decimal(12,0)")
    upper = (wide(F.substring(h, 1, 16)) % m).cast("long") * F.lit(pow(16, 16 - drop, modulus))
    rest = (wide(F.substring(h, 17, 16 - drop)) % m).cast("long")
    if modulus > 2**31:  # the product needs more than a long
        upper = (wide(F.substring(h, 1, 16)) % m).cast("decimal(12,0)") * F.lit(pow(16, 16 - drop, modulus)).cast("decimal(12,0)")
        return ((upper + rest) % m).cast("long")
    return (upper + rest) % F.lit(modulus).cast("long")


def pick(pool: list[str], c: Column, offset: int) -> Column:
    at = md5_mod(F.concat(c, F.lit(str(offset))), len(pool))
    return F.element_at(F.array(*[F.lit(x) for x in pool]), (at + 1).cast("int"))


def fake_ssn(c: Column) -> Column:
    return F.when(c.isNotNull(), F.format_string("%03d-%02d-%04d", md5_mod(c, 99) + 900, md5_mod(c, 99, 2) + 1, md5_mod(c, 9999, 4) + 1))


def fake_phone(c: Column) -> Column:
    return F.when(c.isNotNull(), F.format_string("(555) %03d-%04d", md5_mod(c, 900) + 100, md5_mod(c, 10000, 3)))


def fake_zip(c: Column) -> Column:
    return (md5_mod(c, 90000) + 10000).cast("string")


def fake_address(c: Column) -> Column:
    return F.concat((md5_mod(c, 9999) + 1).cast("string"), F.lit(" "), pick(T.STREETS, c, 0), F.lit(", "), pick(T.CITIES, c, 1), F.lit(", "), pick(T.STATES, c, 2), F.lit(" "), fake_zip(c))


def fake_name(c: Column) -> Column:
    return F.concat(pick(T.FIRST_NAMES, c, 0), F.lit(" "), pick(T.LAST_NAMES, c, 1))


def fake_company(c: Column) -> Column:
    return F.concat(pick(T.COMPANY_WORDS, c, 0), F.lit(" "), pick(T.COMPANY_SUFFIXES, c, 1))


def fake_account_number(c: Column) -> Column:
    """6 to 11 digits."""
    size = md5_mod(c, 6) + 6
    out = F.lit(None).cast("string")
    for n in range(6, 12):
        out = F.when(size == n, F.lpad(md5_mod(c, 10**n).cast("string"), n, "0")).otherwise(out)
    return out


# --- single texts -------------------------------------------------------------------------------------------------------


def _number(text: str) -> int:
    return int(hashlib.md5(text.encode("utf-8", "surrogatepass"), usedforsecurity=False).hexdigest(), 16)


def _pick_of(pool: list[str], text: str, offset: int) -> str:
    return pool[_number(f"{text}{offset}") % len(pool)]


def ssn_of(text: str) -> str:
    n = _number(text)
    return f"{n % 99 + 900:03d}-{(n >> 8) % 99 + 1:02d}-{(n >> 16) % 9999 + 1:04d}"


def phone_of(text: str) -> str:
    n = _number(text)
    return f"(555) {n % 900 + 100:03d}-{(n >> 12) % 10000:04d}"


def name_of(text: str) -> str:
    return f"{_pick_of(T.FIRST_NAMES, text, 0)} {_pick_of(T.LAST_NAMES, text, 1)}"


def address_of(text: str) -> str:
    n = _number(text)
    return f"{n % 9999 + 1} {_pick_of(T.STREETS, text, 0)}, {_pick_of(T.CITIES, text, 1)}, {_pick_of(T.STATES, text, 2)} {n % 90000 + 10000}"
