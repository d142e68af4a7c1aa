"""Merging of the partial results of a document's chunks, and keep-first de-duplication.

Everything is an aggregation over explicit ordinals, so the order in which chunks finish never shows. The ``merge_*`` of rows
and ``fold`` of whole records keep the same rules.
"""

from __future__ import annotations

import json

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .chunking import LEDGERS
from .nested import complete_record

#: Types whose line items are distinct by number and name, under columns that stand once.
MULTICOLUMN = ("INCOME_STATEMENT_COMPARISON", "BUDGET_VS_ACTUAL", "QB_PROFIT_LOSS")
FLAGS = ("encoding_broken", "is_corrected", "is_void", "is_summary_sheet")


def keep_first(df: DataFrame, keys: list[Column | str], order: list[Column | str]) -> DataFrame:
    """The first row of each key; null keys are one key."""
    return df.withColumn("_rn", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).filter("_rn = 1").drop("_rn")


def first_value(value: str, order: str, where: Column | None = None) -> Column:
    """The value of the first row in order that isn't null (or meets ``where``)."""
    ok = F.col(value).isNotNull() if where is None else where
    return F.min_by(value, F.when(ok, F.col(order)))


def last_value(value: str, order: str) -> Column:
    return F.max_by(value, F.when(F.col(value).isNotNull(), F.col(order)))


def ordered(value: str | Column, *order: str) -> Column:
    """Array of the values in order."""
    v = F.col(value) if isinstance(value, str) else value
    return F.transform(F.array_sort(F.collect_list(F.struct(*order, v.alias("_v")))), lambda x: x["_v"])


def merge_ledger(parts: DataFrame, doc: str = "doc", order: str = "chunk_index") -> DataFrame:
    """Accounts of all chunks by number, else name: first beginning balance, last known ending balance, all transactions.

    ``parts`` has a row for each account of a chunk: ``doc, chunk_index, account_number, account_name, beginning_balance,
    ending_balance, n_transactions``; the result is ordered by ``first_chunk``.
    """
    key = F.coalesce(F.nullif("account_number", F.lit("")), F.col("account_name"))
    return parts.groupBy(doc, key.alias("account_key")).agg(
        F.min(order).alias("first_chunk"),
        F.min_by("account_name", order).alias("account_name"),
        F.min_by("beginning_balance", order).alias("beginning_balance"),
        last_value("ending_balance", order).alias("ending_balance"),
        F.sum("n_transactions").alias("n_transactions"),
    )


def merge_transactions(lines: DataFrame, doc: str = "doc", order: tuple[str, ...] = ("chunk_index", "ord")) -> DataFrame:
    """The transactions of all chunks under their merged accounts: the lines with ``account_key`` and ``ord``, their place in the account.

    Long form, a row for each line, so that an account of any size is sorted and never gathered; a line without number and name
    belongs to the account without key.
    """
    key = F.coalesce(F.nullif("account_number", F.lit("")), F.col("account_name"))
    d = lines.withColumn("account_key", key)
    return d.withColumn("ord", F.row_number().over(Window.partitionBy(doc, "account_key").orderBy(*order)) - 1)


def merge_sections(parts: DataFrame, doc: str = "doc", order: str = "chunk_index") -> DataFrame:
    """Sections of all chunks by name: accounts together, last known total, in order of first appearance."""
    return parts.groupBy(doc, "side", "section_name").agg(F.min(order).alias("first_chunk"), F.sum("n_accounts").alias("n_accounts"), last_value("section_total", order).alias("section_total"))


def merge_scalars(parts: DataFrame, columns: list[str], doc: str = "doc", order: str = "chunk_index") -> DataFrame:
    """For each column, the first value that isn't null, in chunk order."""
    return parts.groupBy(doc).agg(*[first_value(c, order).alias(c) for c in columns])


def merge_entity(parts: DataFrame, doc: str = "doc", order: str = "chunk_index") -> DataFrame:
    """The first named entity, else the first chunk's."""
    named = F.when(F.coalesce(F.col("entity_name"), F.lit("")) != "", F.col(order))
    return parts.groupBy(doc).agg(F.coalesce(F.min_by("entity_name", named), F.min_by("entity_name", order)).alias("entity_name"))


def merge_lines(parts: DataFrame, doc: str = "doc", order: tuple[str, ...] = ("chunk_index", "ord")) -> DataFrame:
    """Line items by number and name, first kept."""
    return keep_first(parts, [doc, "account_number", "account_name"], list(order))


def merge_notes(parts: DataFrame, doc: str = "doc", order: tuple[str, ...] = ("chunk_index", "ord"), value: str = "note") -> DataFrame:
    """Distinct notes in order of first appearance: ``(doc, ord, note)``."""
    first = keep_first(parts.filter(F.col(value).isNotNull()), [doc, value], list(order))
    return first.select(doc, (F.row_number().over(Window.partitionBy(doc).orderBy(*order)) - 1).alias("ord"), value)


def merge_flags(parts: DataFrame, flags: list[str], doc: str = "doc") -> DataFrame:
    """True where any chunk says so."""
    return parts.groupBy(doc).agg(*[F.coalesce(F.bool_or(f), F.lit(False)).alias(f) for f in flags])


def merge_usage(parts: DataFrame, doc: str = "doc", order: str = "chunk_index") -> DataFrame:
    """Totals of calls, retries and tokens; the last chunk's reason to finish."""
    return parts.groupBy(doc).agg(*[F.sum(c).alias(c) for c in ("prompt_tokens", "completion_tokens", "retries")], F.count("*").alias("calls"), F.max_by("finish_reason", order).alias("finish_reason"))


# --- whole records --------------------------------------------------------------------------------------------------


def _list(value: object) -> list:
    return value if isinstance(value, list) else [] if value is None else [value]


def _concat(values: list) -> list:
    return [x for v in values for x in _list(v)]


def _distinct(values: list) -> list:
    seen: dict = {}
    for x in values:
        if x is not None:
            seen.setdefault(json.dumps(x, sort_keys=True), x)
    return list(seen.values())


def _known(values: list) -> object:
    return next((v for v in values if v is not None), None)


def _any(values: list) -> object:
    """Objects and arrays of all chunks together, of anything else the first known value."""
    first = _known(values)
    if isinstance(first, dict):
        return _together([v for v in values if isinstance(v, dict)])
    return _concat(values) if isinstance(first, list) else first


def _together(objects: list[dict], **rules) -> dict:
    """One object with the fields of all, each by its rule, else by ``_any``."""
    names = dict.fromkeys(k for o in objects for k in o)
    return {k: rules.get(k, _any)([o[k] for o in objects if k in o]) for k in names}


def _grouped(values: list, key, unite) -> list:
    """Elements of all chunks by key in order of first appearance; those that aren't objects stay as they are."""
    groups: dict = {}
    for x in _concat(values):
        groups.setdefault(key(x) if isinstance(x, dict) else ("", len(groups)), []).append(x)
    return [g[0] if len(g) == 1 else unite(g) for g in groups.values()]


def _account(parts: list[dict]) -> dict:
    out = _together(parts, transactions=_concat, ending_balance=lambda v: _known(v[::-1]))
    if "beginning_balance" in out:  # a later part begins at the balance carried, not at the account's
        out["beginning_balance"] = parts[0].get("beginning_balance")
    return out


def _accounts(values: list) -> list:
    return _grouped(values, lambda a: str(a.get("account_number") or a.get("account_name") or ""), _account)


def _section(parts: list[dict]) -> dict:
    return _together(parts, accounts=_concat, sections=_sections, subsections=_sections, section_total=lambda v: _known(v[::-1]))


def _sections(values: list) -> list:
    return _grouped(values, lambda s: str(s.get("section_name") or ""), _section)


def _side(values: list) -> object:
    sides = [v for v in values if isinstance(v, dict)]
    return _section(sides) if any("sections" in s for s in sides) else _any(values)


def _lines(values: list) -> list:
    return _grouped(values, lambda x: json.dumps([x.get("account_number"), x.get("account_name")]), lambda g: g[0])


def _entity(values: list) -> object:
    return next((v for v in values if isinstance(v, dict) and v.get("name")), values[0])


def _metadata(values: list) -> dict:
    flags = dict.fromkeys(FLAGS, lambda v: True if any(v) else _known(v))
    rotated = lambda v: sorted(_distinct(_concat(v)), key=lambda x: (str(type(x)), x if isinstance(x, (int, float)) else str(x)))
    return _together([v for v in values if isinstance(v, dict)], notes=lambda v: _distinct(_concat(v)), pages_rotated=rotated, **flags)


def fold(records: list[dict], kind: str | None) -> dict:
    """One record of a document's partial records in chunk order; a single one stays as it is.

    Ledger accounts meet by number, else name, and sections and subsections by name (as in ``merge_ledger`` and
    ``merge_sections``); line items are distinct; the entity is the first named; notes are distinct, flags true where any chunk
    says so; other arrays are concatenated, and of other values the first known stays.
    """
    if len(records) < 2:
        return records[0] if records else {}
    rules = dict(entity=_entity, metadata=_metadata, **dict.fromkeys(("assets", "liabilities", "equity", "income", "expenses", "other_income", "other_expenses"), _side), sections=_sections)
    if kind in LEDGERS:
        rules["accounts"] = _accounts
    if kind in MULTICOLUMN:
        rules |= {"columns": lambda v: next((x for x in v if x), v[0]), "line_items": _lines}
    return _together(records, **rules)


def merge_records(parts: DataFrame, keys: list[str], kind: str = "document_type", order: str = "chunk_index", data: str = "json") -> DataFrame:
    """``(keys, n_parts, data)``: the partial records of each key as one (see ``fold``). All parts of a key come to one task."""

    @F.pandas_udf("string")
    def folded(kinds: pd.Series, texts: pd.Series) -> pd.Series:
        return pd.Series([json.dumps(fold([r for r in map(complete_record, t) if r is not None], k), ensure_ascii=False) for k, t in zip(kinds, texts)], dtype=object)

    held = parts.filter(F.col(data).isNotNull()).groupBy(*keys).agg(F.count("*").alias("n_parts"), ordered(data, order).alias("_t"))
    one = held.filter("n_parts = 1").select(*keys, "n_parts", F.col("_t")[0].alias("data"))
    return one.unionByName(held.filter("n_parts > 1").select(*keys, "n_parts", folded(kind, "_t").alias("data")))


def failed_documents(docs: DataFrame, parts: DataFrame, doc: str = "doc") -> DataFrame:
    """Documents of which no chunk gave a result, as placeholders."""
    return docs.join(parts.select(doc).distinct(), doc, "left_anti").select(doc, F.lit("EXTRACTION FAILED").alias("entity_name"))


def dedup_w2(records: DataFrame, scope: list[str] | None = None, order: str = "record_id") -> DataFrame:
    """W-2 records once for each employer, employee and year, first kept; other types stay as they are.

    ``records`` has ``document_type, employer_ein, employer_name, employee_ssn_last4, employee_name, tax_year``; empty text
    counts as missing.
    """
    pair = lambda a, b: F.coalesce(F.nullif(a, F.lit("")), F.nullif(b, F.lit("")))
    w2 = keep_first(records.filter("document_type = 'W2'"), [*(scope or []), pair("employer_ein", "employer_name"), pair("employee_ssn_last4", "employee_name"), "tax_year"], [order])
    return w2.unionByName(records.filter("document_type is null or document_type <> 'W2'"))
