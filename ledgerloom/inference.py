"""Opaque inference: prompts to answers by a pluggable backend, written before anything relational reads them.

A backend is a picklable callable ``(prompt, max_tokens) -> Answer``. Calls run in map partitions with retries; failures
become rows with an error. No endpoint or credential has a default.
"""

from __future__ import annotations

import inspect
import json
from dataclasses import dataclass
from typing import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .functions import tables as T
from .operators import trees, validate
from .operators.nested import complete_record, dumps
from .operators.sanitize import _DASHED
from .session import written
from .sinks import layouts

#: What the model is asked for, by family; a deployment may pass its own.
INSTRUCTIONS = {
    "tax": "Return one JSON object with the boxes, parties, state and local rows of this tax form. Use null for what is not on it.",
    "financial_simple": "Return one JSON object with the entity, sides, sections, accounts and totals of this statement, amounts as printed.",
    "financial_multicolumn": "Return one JSON object with the entity, columns and line items; each item has a value for each column, null where blank.",
    "financial_transaction": "Return one JSON object with the entity and its accounts, transactions or aging rows in printed order.",
    "financial_reserve": "Return one JSON object with the entity, reserve components and bank accounts.",
}
_ENTITY = {"name": "text", "accounting_basis": "Cash or Accrual", "period_start": "YYYY-MM-DD", "period_end": "YYYY-MM-DD", "software": "text"}
_ACCOUNT = {"account_number": "text or null", "account_name": "text"}


def _side(total: str, value: str) -> dict:
    return {"sections": [{"section_name": "text", "accounts": [{**_ACCOUNT, value: 0.0}], "subsections": [], "section_total": 0.0}], total: 0.0}


def _shapes() -> dict[str, dict]:
    lines = [{**_ACCOUNT, "section": "text", "row_type": "account or total", "values": {"key of a column": 0.0}}]
    columns = [{"key": "short name", "label": "as printed", "column_type": "actual, budget or variance"}]
    entry = {"date": "YYYY-MM-DD", "type": "text", "number": "text", "name": "text", "memo": "text", "split": "text", "debit": 0.0, "credit": 0.0, "balance": 0.0}
    aging = {"as_of": "YYYY-MM-DD", "aging_buckets": layouts.AGING_BUCKETS, "rows": [{"name": "text", **dict.fromkeys(layouts.AGING_BUCKETS, 0.0), "total": 0.0}], "totals": {"total": 0.0}}
    return {
        "BALANCE_SHEET": {"assets": _side("total_assets", "balance"), "liabilities": _side("total_liabilities", "balance"), "equity": _side("total_equity_reported", "balance")},
        "INCOME_STATEMENT": {"income": _side("total", "amount"), "expenses": _side("total", "amount"), "other_income": None},
        "INCOME_STATEMENT_COMPARISON": {"columns": columns, "line_items": lines},
        "BUDGET_VS_ACTUAL": {"columns": columns, "line_items": lines},
        "TRIAL_BALANCE": {"accounts": [{**_ACCOUNT, "debit": 0.0, "credit": 0.0}], "total_debits": 0.0, "total_credits": 0.0},
        "GENERAL_LEDGER": {"accounts": [{**_ACCOUNT, "beginning_balance": 0.0, "transactions": [entry], "ending_balance": 0.0}]},
        "ACCOUNTS_RECEIVABLE_AGING": {"report_type": "AR", **aging},
        "ACCOUNTS_PAYABLE_AGING": {"report_type": "AP", **aging},
        "RESERVE_ALLOCATION": {"components": [{"account_number": "text or null", "component_name": "text", "current_balance": 0.0}], "bank_accounts": [{**_ACCOUNT, "balance": 0.0}]},
    }


def schema_hint(kind: str) -> str:
    """The shape that a record of the type should have, as JSON; '' for a type without one."""
    shape = _shapes().get(kind)
    if shape is not None:
        return json.dumps({"entity": _ENTITY, **shape, "metadata": {"notes": []}})
    for f in layouts.forms():
        if f[0] == kind:
            shape = {f[1]: {"name": "text", "tin": "text", "address": "text"}, f[2]: {"name": "text", "tin_last4": "last four digits", "address": "text"}}
            *path, leaf = f[3].split(".")
            shape.update({path[0]: {leaf: 0.0}} if path else {leaf: 0.0})
            return json.dumps({"tax_year": 2024, **shape, "state": [{"state_abbr": "text", "state_id": "text"}]})
    return ""


ANSWER_SCHEMA = "json string, finish_reason string, prompt_tokens long, completion_tokens long, retries int, error string"


@dataclass(frozen=True)
class Answer:
    text: str
    finish_reason: str = "stop"
    prompt_tokens: int = 0
    completion_tokens: int = 0


Backend = Callable[[str, int], Answer]


def token_budget(kind: Column, override: int | None = None) -> Column:
    """Tokens that an answer may take, by document type."""
    if override:
        return F.lit(override)
    out = F.lit(T.DEFAULT_BUDGET)
    for size in sorted(set(T.BUDGETS.values())):
        out = F.when(kind.isin(*[k for k, n in T.BUDGETS.items() if n == size]), F.lit(size)).otherwise(out)
    return out


def instruction(family: Column, templates: dict[str, str] | None = None, kind: Column | None = None) -> Column:
    """The instruction of a family, with the shape of the type's records; that of simple statements for an unknown family."""
    texts = templates or INSTRUCTIONS
    out = F.lit(texts["financial_simple"])
    for name, text in texts.items():
        out = F.when(family == name, F.lit(text)).otherwise(out)
    if kind is None:
        return out
    hint = F.lit("")
    for k in validate.known_types():
        if shape := schema_hint(k):
            hint = F.when(kind == k, F.lit("\nShape: " + shape)).otherwise(hint)
    return F.concat(out, hint)


def ask(backend: Backend, prompt: str, max_tokens: int, retries: int = 2, kind: str | None = None, redact: bool = False) -> tuple[str | None, str | None, int, int, int, str | None]:
    """One prompt to a valid record: what was wrong with an answer is appended to the prompt; a cut-off answer gets half as many tokens more.

    With a ``kind``, the record must hold what its type requires, before numbers are redacted and after.
    """
    error, sent, answer = None, prompt, None
    for attempt in range(retries + 1):
        try:
            answer = backend(sent, max_tokens)
        except Exception as e:  # noqa: BLE001
            error = f"{type(e).__name__}: {e}"[:500]
            continue
        if answer.finish_reason == "length":
            max_tokens, error = int(max_tokens * 1.5), "cut off"
            continue
        record = complete_record(answer.text)
        problems = ["no complete JSON object"] if record is None else validate.problems_of(record, kind)
        if not problems and redact:
            record = trees.map_texts(record, lambda _, v: _DASHED.sub(r"XXX-XX-\3", v))
            problems = validate.problems_of(record, kind)
        if not problems:
            return dumps(record), answer.finish_reason, answer.prompt_tokens, answer.completion_tokens, attempt, None
        error = "; ".join(problems)[:500]
        sent = f"{prompt}\n\nThe last answer was invalid: {error}"
    return None, answer.finish_reason if answer else None, answer.prompt_tokens if answer else 0, answer.completion_tokens if answer else 0, retries, error


def infer(prompts: DataFrame, backend: Backend, keys: list[str], prompt_col: str = "prompt", budget_col: str = "max_tokens", retries: int = 2, parallel: int | None = None, kind_col: str | None = None, redact: bool = False) -> DataFrame:
    """``(keys, json, finish_reason, tokens, retries, error)`` for every prompt, written once so that no retry downstream calls again.

    ``kind_col`` names the type whose requirements an answer must meet; null for none.
    """
    kind = F.col(kind_col) if kind_col else F.lit(None).cast("string")
    src = prompts.select(*keys, F.col(prompt_col).alias("_p"), F.col(budget_col).cast("int").alias("_n"), kind.alias("_k"))
    if parallel:
        src = src.repartition(parallel)

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        names = [x.split()[0] for x in ANSWER_SCHEMA.split(", ")]
        for f in frames:
            out = pd.DataFrame([ask(backend, p, int(n), retries, k, redact) if p is not None and p.strip() else (None, None, 0, 0, 0, "empty prompt") for p, n, k in zip(f["_p"], f["_n"], f["_k"])], columns=names, index=f.index)
            yield pd.concat([f[keys], out], axis=1)

    schema = ", ".join(f"`{k}` {src.schema[k].dataType.simpleString()}" for k in keys)
    return written(src.mapInPandas(run, f"{schema}, {ANSWER_SCHEMA}"), "answers")


class Rewriter:
    """A backend that rewrites text, for sanitising by a model.

    Each distinct text is asked once, with retries and a budget that follows its length; answers are written before they are
    read. ``rewrite`` takes the text, and the tokens that the answer may take if it has a second parameter. A text whose calls all fail gets a null answer, and ``error`` says why; ``usage`` sums up calls and retries.
    """

    def __init__(self, rewrite: Callable[..., str], retries: int = 2, chars_per_token: float = 3.5):
        budgeted = len(inspect.signature(rewrite).parameters) > 1
        self._rewrite, self._retries, self._per = rewrite if budgeted else lambda text, _: rewrite(text), retries, chars_per_token
        self.usage: DataFrame | None = None

    def rewrite(self, df: DataFrame, text_col: str, out: str) -> DataFrame:
        fn, retries, per = self._rewrite, self._retries, self._per

        def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for f in frames:
                rows = []
                for text in f["_t"]:
                    answer = error = None
                    for attempt in range(retries + 1):
                        try:
                            answer, error = fn(text, int(len(text) / per * 1.5) + 64), None
                            break
                        except Exception as e:  # noqa: BLE001
                            error = f"{type(e).__name__}: {e}"[:500]
                    rows.append((text, answer, attempt, error))
                yield pd.DataFrame(rows, columns=["_t", "_a", "retries", "error"])

        texts = df.select(F.col(text_col).alias("_t")).filter("_t is not null and trim(_t) <> ''").distinct()
        answers = written(texts.mapInPandas(run, "_t string, _a string, retries int, error string"), "rewritten")
        self.usage = answers.agg(F.count("*").alias("calls"), F.coalesce(F.sum("retries"), F.lit(0)).alias("retries"), F.count("error").alias("failed"))
        held = df.join(answers.select("_t", "_a"), df[text_col] == F.col("_t"), "left")
        return held.withColumn(out, F.when(F.col("_t").isNull(), F.col(text_col)).otherwise(F.col("_a"))).drop("_t", "_a")
