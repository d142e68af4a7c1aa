"""Deterministic replacement of personal data by patterns, in free text and in record trees.

Passes run one after the other (social security numbers, phones, addresses), each over the result of the one before.
A pattern's matches are cut out, replaced by expressions of the match itself, and joined again, so equal originals get equal
replacements in every document without any lookup.
"""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as K

from ..functions import hashing as H
from ..functions import tables as T
from . import nested, trees



def replace_matches(text: Column, pattern: str, make) -> Column:
    """``text`` with each match of ``pattern`` replaced by ``make(match)``."""
    found = F.regexp_extract_all(text, F.lit(pattern), 0)
    gaps = F.split(text, pattern, -1)
    # zipped, so that the pattern runs once for a text, not for each match; the last gap has no match
    joined = F.array_join(F.zip_with(gaps, found, lambda g, m: F.concat(g, F.when(m.isNotNull(), make(m)).otherwise(F.lit("")))), "")
    return F.when(text.isNull(), None).when(F.size(found) == 0, text).otherwise(joined)


PASSES = (("ssn", T.SSN, H.fake_ssn), ("phone", T.PHONE, H.fake_phone), ("address", "(?i)" + T.ADDRESS, H.fake_address))


def sanitize_text(df: DataFrame, text_col: str = "text", out: str = "sanitized") -> DataFrame:
    """Adds the text after all passes. Employer numbers, names and amounts stay."""
    df = df.withColumn(out, F.col(text_col))
    for _, pattern, make in PASSES:
        df = df.withColumn(out, replace_matches(F.col(out), pattern, make))
    return df


def replacement_log(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(id, ord, kind, original, replacement)``: each distinct original once, in order of the passes and of first appearance."""
    df = df.select(id_col, F.col(text_col).alias("_t0"))
    parts = []
    for k, (kind, pattern, make) in enumerate(PASSES):
        originals = F.array_distinct(F.regexp_extract_all(F.col(f"_t{k}"), F.lit(pattern), 0))
        parts.append(F.transform(originals, _entry(kind, make)))
        df = df.withColumn(f"_t{k + 1}", replace_matches(F.col(f"_t{k}"), pattern, make))
    found = df.select(id_col, F.posexplode_outer(F.concat(*parts)).alias("ord", "x")).filter("x is not null")
    return found.select(id_col, "ord", "x.kind", "x.original", "x.replacement")


def _entry(kind: str, make):
    return lambda m: F.struct(F.lit(kind).alias("kind"), m.alias("original"), make(m).alias("replacement"))


def sanitize_name(c: Column) -> Column:
    """Blank names stay."""
    return F.when(F.coalesce(F.trim(c), F.lit("")) == "", c).otherwise(H.fake_name(c))


def sanitize_field(field: str, c: Column) -> Column | None:
    """One text field of a record tree by its name: skipped keys stay, names and addresses are replaced whole, last four digits are
    replaced inside their mask; None for other text, which goes through the patterns."""
    if field in T.SKIP_KEYS:
        return c
    if field == "name":
        return sanitize_name(c)
    if field == "address":
        return F.when(F.coalesce(F.trim(c), F.lit("")) == "", c).otherwise(H.fake_address(c))
    if field in ("ssn_last4", "tin_last4"):
        return F.when(F.coalesce(c, F.lit("")) == "", c).otherwise(F.concat(F.lit("XXX-XX-"), F.right(H.fake_ssn(c), F.lit(4))))
    return None


def sanitize_records(df: DataFrame, fields: list[str]) -> DataFrame:
    """The record table with the named text columns sanitised by their names; all others unchanged."""
    for f in fields:
        by_name = sanitize_field(f, F.col(f))
        df = sanitize_text(df, f, f) if by_name is None else df.withColumn(f, by_name)
    return df


_DASHED = re.compile(T.SSN_DASHED)


@F.pandas_udf(K.StringType())
def _redacted(texts: pd.Series) -> pd.Series:
    def one(text: str | None) -> str | None:
        if text is None or not _DASHED.search(text):
            return text
        record = nested.complete_record(text)
        return _DASHED.sub(r"XXX-XX-\3", text) if record is None else nested.dumps(trees.map_texts(record, lambda _, v: _DASHED.sub(r"XXX-XX-\3", v)))

    return texts.map(one)


def redact_records(df: DataFrame, fields: list[str]) -> DataFrame:
    """Dashed social security numbers in the values of JSON records keep their last four digits; field names stay. Text that holds no
    complete record is redacted as it is, and text with nothing to redact stays."""
    return df.withColumns({f: _redacted(F.col(f)) for f in fields})


_PASSES = tuple((kind, re.compile(p), make) for kind, p, make in (("ssn", T.SSN, H.ssn_of), ("phone", T.PHONE, H.phone_of), ("address", "(?i)" + T.ADDRESS, H.address_of)))


def sanitized_tree(record: object) -> tuple[object, list[tuple[str, str, str]]]:
    """A record with its texts sanitised, and the replacements ``(original, replacement, kind)`` in order of first appearance.

    By field name: skipped names stay, names and addresses are replaced whole, last four digits inside their mask; other texts go
    through the patterns. One original has one replacement in the whole record.
    """
    seen: dict[str, str] = {}
    log: list[tuple[str, str, str]] = []

    def once(text: str, make, kind: str) -> str:
        if text not in seen:
            seen[text] = make(text)
            log.append((text, seen[text], kind))
        return seen[text]

    def one(field: str | None, text: str) -> str:
        if field in T.SKIP_KEYS:
            return text
        if field == "name":
            return once(text, H.name_of, "name") if text.strip() else text
        if field == "address":
            return once(text, H.address_of, "address") if text.strip() else text
        if field in ("ssn_last4", "tin_last4"):
            return once(text, lambda t: "XXX-XX-" + H.ssn_of(t)[-4:], "ssn")
        for kind, pattern, make in _PASSES:
            text = pattern.sub(lambda m: once(m[0], make, kind), text)
        return text

    return trees.map_texts(record, one, T.SKIP_KEYS), log


LOG = "array<struct<original:string,replacement:string,kind:string>>"


def sanitize_extractions(records: DataFrame, data_col: str = "data") -> DataFrame:
    """Adds ``sanitized`` (the record as JSON text) and ``replacements``; both null where there is no complete record."""

    @F.pandas_udf(f"sanitized string, replacements {LOG}")
    def run(texts: pd.Series) -> pd.DataFrame:
        out = []
        for text in texts:
            record = nested.complete_record(text)
            if record is None:
                out.append((None, None))
            else:
                tree, log = sanitized_tree(record)
                out.append((nested.dumps(tree), [dict(zip(("original", "replacement", "kind"), x)) for x in log]))
        return pd.DataFrame(out, columns=["sanitized", "replacements"])

    return records.withColumn("_s", run(F.col(data_col))).withColumns({"sanitized": F.col("_s.sanitized"), "replacements": F.col("_s.replacements")}).drop("_s")


def longest_first(replacements: Column) -> Column:
    """Replacements in the order in which a writer must apply them: long originals before those they may hold, ties in first order."""
    placed = F.transform(replacements, lambda r, i: F.struct((-F.length(r["original"])).alias("n"), i.alias("i"), r.alias("r")))
    return F.transform(F.array_sort(placed), lambda x: x["r"])


def apply_replacements(text: Column, replacements: Column) -> Column:
    """The text with each original replaced, longest first: what a document writer does page by page."""
    return F.aggregate(longest_first(replacements), text, lambda acc, r: F.replace(acc, r["original"], r["replacement"]))


def sanitize(df: DataFrame, mode: str = "regex", text_col: str = "text", backend=None) -> DataFrame:
    """``regex``, ``llm`` or ``hybrid`` (patterns first, then the model); the latter two need an inference backend."""
    if mode not in ("regex", "llm", "hybrid"):
        raise ValueError(f"unknown sanitize mode {mode!r}")
    if mode == "regex":
        return sanitize_text(df, text_col)
    if backend is None:
        raise ValueError(f"sanitize mode {mode!r} needs a backend")
    source = df if mode == "llm" else sanitize_text(df, text_col, "_masked")
    return backend.rewrite(source, text_col if mode == "llm" else "_masked", "sanitized").drop("_masked")


def sanitize_trees(records: DataFrame, mode: str = "regex", backend=None, data_col: str = "data") -> DataFrame:
    """``sanitize`` for records: ``regex`` walks the tree, ``llm`` rewrites the record's text, ``hybrid`` both in turn; where the model's
    answer is no record, the tree walk's result stands."""
    if mode not in ("regex", "llm", "hybrid"):
        raise ValueError(f"unknown sanitize mode {mode!r}")
    walked = sanitize_extractions(records, data_col)
    if mode == "regex":
        return walked
    if backend is None:
        raise ValueError(f"sanitize mode {mode!r} needs a backend")
    asked = backend.rewrite(walked, data_col if mode == "llm" else "sanitized", "_answer")
    return asked.withColumn("sanitized", F.coalesce(_record_text(F.col("_answer")), "sanitized")).drop("_answer")


@F.pandas_udf(K.StringType())
def _record_text(texts: pd.Series) -> pd.Series:
    return texts.map(lambda t: None if t is None or (r := nested.complete_record(t)) is None else nested.dumps(r))
