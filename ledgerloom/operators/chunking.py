"""Chunks under a character budget, by tiers: whole text, account blocks, page breaks, overlapping windows.

All tiers are array expressions over one row's text; nothing is shuffled.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

CHARS_PER_TOKEN = 3.5
OVERLAP = 0.1
#: A page or sheet marker line, of either line end; lines end at newlines only.
PAGE_BREAK = r"^-{3}\s*(?:PAGE BREAK|PAGE \d+|SHEET: .*?)\s*-{3}[ \t]*\r?$"
#: Before a blank line, an account number and a capital.
ACCOUNT_START = r"\n\s*\n(?=[\w-]{4,15}[ ]+[A-Z])"
LEDGERS = ("GENERAL_LEDGER", "QB_GENERAL_LEDGER")


def max_chars(tokens: Column) -> Column:
    return (tokens * F.lit(CHARS_PER_TOKEN)).cast("int")


def fixed_windows(text: Column, size: Column) -> Column:
    """Windows of ``size`` characters, each beginning nine tenths of that after the last; none for null or empty text."""
    step = F.greatest(F.lit(1), F.floor(size * F.lit(1 - OVERLAP)).cast("int"))
    starts = F.when(F.length(text) > 0, F.sequence(F.lit(0), F.length(text) - 1, step)).otherwise(F.array().cast("array<int>"))
    return F.transform(starts, lambda s: F.substring(text, s + 1, size))


def pack(parts: Column, size: Column, joint: str) -> Column:
    """Greedy packing in order: a part opens a new chunk where it doesn't fit; a part over the size is a chunk by itself."""
    empty = F.struct(F.array().cast("array<string>").alias("done"), F.lit(None).cast("string").alias("open"))

    def step(acc: Column, part: Column) -> Column:
        whole = F.concat(acc["open"], F.lit(joint), part)
        fits = acc["open"].isNotNull() & (F.length(whole) <= size)
        return F.struct(
            F.when(fits | acc["open"].isNull(), acc["done"]).otherwise(F.array_append(acc["done"], acc["open"])).alias("done"),
            F.when(fits, whole).otherwise(part).alias("open"),
        )

    return F.aggregate(parts, empty, step, lambda a: F.when(a["open"].isNull(), a["done"]).otherwise(F.array_append(a["done"], a["open"])))


def account_parts(text: Column) -> Column:
    """Text cut before each account block; the blank line goes with the part before."""
    gaps, blanks = F.split(text, ACCOUNT_START, -1), F.regexp_extract_all(text, F.lit(ACCOUNT_START), 0)
    return F.zip_with(gaps, blanks, lambda g, b: F.concat(g, F.coalesce(b, F.lit(""))))


def page_parts(text: Column) -> Column:
    return F.filter(F.split(text, f"(?dm){PAGE_BREAK}"), lambda x: F.trim(F.regexp_replace(x, r"\s+", " ")) != "")


def chunk_array(text: Column, kind: Column, size: Column) -> Column:
    """``array<struct<text, account_context, tier>>`` of a text's chunks."""
    accounts, parts = account_parts(text), page_parts(text)
    head = lambda t: F.when(F.regexp_extract(t, r"^\s*([\w-]{4,15}[ ]+[A-Z])", 1) != "", F.substring(F.trim(F.regexp_extract(t, r"^\s*([^\n]*)", 1)), 1, 80))
    as_is = lambda tier, c: F.transform(c, lambda t: F.struct(t.alias("text"), (head(t) if tier == "account" else F.lit(None).cast("string")).alias("account_context"), F.lit(tier).alias("tier")))
    return (
        F.when(text.isNull(), None)
        .when(F.length(text) <= size, as_is("whole", F.array(text)))
        .when(kind.isin(*LEDGERS) & (F.size(accounts) >= 3), as_is("account", pack(accounts, size, "")))
        .when(F.size(parts) >= 2, as_is("page", pack(parts, size, "\n")))
        .otherwise(as_is("window", fixed_windows(text, size)))
    )


def chunks_of(text: str, kind: str, size: int) -> list[tuple[str, str | None, str]]:
    """``(text, account_context, tier)`` of one text's chunks: ``chunk_array`` for a single text."""

    def packed(parts: list[str], joint: str) -> list[str]:
        out: list[str] = []
        held: str | None = None
        for p in parts:
            if held is not None and len(held) + len(joint) + len(p) <= size:
                held += joint + p
            else:
                out += [] if held is None else [held]
                held = p
        return out + ([] if held is None else [held])

    if len(text) <= size:
        return [(text, None, "whole")]
    starts = [0, *(m.end() for m in re.finditer(ACCOUNT_START, text)), len(text)]
    if kind in LEDGERS and len(starts) > 3:
        heads = [(t, re.match(r"\s*([\w-]{4,15}[ ]+[A-Z])", t)) for t in packed([text[a:b] for a, b in zip(starts, starts[1:])], "")]
        return [(t, re.match(r"\s*([^\n]*)", t)[1].strip(" ")[:80] if m else None, "account") for t, m in heads]
    pages = [p for p in re.split(f"(?m){PAGE_BREAK}", text) if re.sub(r"\s+", " ", p).strip(" ")]
    if len(pages) >= 2:
        return [(t, None, "page") for t in packed(pages, "\n")]
    step = max(1, int(size * (1 - OVERLAP)))
    return [(text[i : i + size], None, "window") for i in range(0, len(text), step)]


def chunk(df: DataFrame, id_col: str, text_col: str = "text", type_col: str = "document_type", max_tokens: int = 6000) -> DataFrame:
    """``(id, chunk_index, total_chunks, text, account_context, tier)``. Null texts have no chunk; an empty one has one."""
    size = max_chars(F.lit(max_tokens))
    c = df.select(id_col, chunk_array(F.col(text_col), F.coalesce(F.col(type_col), F.lit("")), size).alias("c"))
    # outer: else the optimizer infers a filter on the array and computes it twice
    k = c.select(id_col, F.size("c").alias("total_chunks"), F.posexplode_outer("c").alias("chunk_index", "k"))
    return k.filter("k is not null").select(id_col, "chunk_index", "total_chunks", "k.text", "k.account_context", "k.tier")


def prompt_text(chunks: DataFrame, type_col: str = "document_type") -> DataFrame:
    """Adds ``prompt``: the chunk under a line that names its number, type and account, where there are several."""
    context = F.when(F.col("account_context").isNotNull(), F.concat(F.lit(", account: "), F.col("account_context"))).otherwise("")
    head = F.concat(F.lit("[chunk "), (F.col("chunk_index") + 1).cast("string"), F.lit(" of "), F.col("total_chunks").cast("string"), F.lit(", "), F.coalesce(F.col(type_col), F.lit("UNKNOWN")), context, F.lit("]\n"))
    return chunks.withColumn("prompt", F.when(F.col("total_chunks") > 1, F.concat(head, F.col("text"))).otherwise(F.col("text")))
