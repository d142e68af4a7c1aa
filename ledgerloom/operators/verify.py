"""Verification and derived values of statements, in exact decimals.

Inputs are the flat tables: sections ``(doc, path, section_total)``, accounts ``(doc, path, value)`` with the path of the
section that holds them, and totals ``(doc, total_assets, total_liabilities, total_equity)``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.amounts import parse_amount

TOLERANCE = "0.02"
MONEY = "decimal(28,6)"


def account_value(balance: Column, amount: Column) -> Column:
    """Balance, else amount, else 0."""
    return F.coalesce(balance.cast(MONEY), amount.cast(MONEY), F.lit(0).cast(MONEY))


def section_check(sections: DataFrame, accounts: DataFrame, keys: tuple[str, ...] = ("doc", "path")) -> DataFrame:
    """``(keys, computed, reported, delta, matches)`` of every section with a reported total.

    Only the section's own accounts count, not those of its subsections; a section without accounts sums to 0.
    """
    sums = accounts.groupBy(*keys).agg(F.sum(F.col("value").cast(MONEY)).alias("computed"))
    reported = sections.filter("section_total is not null").select(*keys, F.col("section_total").cast(MONEY).alias("reported"))
    d = reported.join(sums, list(keys), "left").withColumn("computed", F.coalesce("computed", F.lit(0)).cast(MONEY))
    return d.withColumn("delta", (F.col("computed") - F.col("reported")).cast(MONEY)).withColumn("matches", F.abs(F.col("delta")) <= F.lit(TOLERANCE).cast(MONEY))


def mismatches(checked: DataFrame) -> DataFrame:
    return checked.filter(~F.col("matches"))


def balance_equation(totals: DataFrame) -> DataFrame:
    """Adds ``difference`` and the tri-state ``balanced``: null where one of the three totals is missing."""
    diff = F.col("total_assets").cast(MONEY) - (F.col("total_liabilities").cast(MONEY) + F.col("total_equity").cast(MONEY))
    note = F.concat(F.lit("Assets differ from liabilities and equity by "), F.col("difference").cast("decimal(28,2)").cast("string"))
    d = totals.withColumn("difference", diff.cast(MONEY)).withColumn("balanced", F.abs(F.col("difference")) <= F.lit(TOLERANCE).cast(MONEY))
    return d.withColumn("note", F.when(~F.col("balanced"), note))


def verified(docs: DataFrame, checked: DataFrame, equation: DataFrame | None = None, key: str = "doc") -> DataFrame:
    """``(doc, n_checked, n_mismatches, verified)``: true without any mismatch, so for documents with nothing to check too."""
    bad = checked.groupBy(key).agg(F.count("*").alias("n_checked"), F.count_if(~F.col("matches")).alias("n_mismatches"))
    d = docs.select(key).distinct().join(bad, key, "left")
    if equation is not None:
        d = d.join(equation.select(key, F.coalesce((~F.col("balanced")).cast("long"), F.lit(0)).alias("off")), key, "left")
    off = F.coalesce("off", F.lit(0)) if equation is not None else F.lit(0)
    return d.select(key, F.coalesce("n_checked", F.lit(0)).alias("n_checked"), (F.coalesce("n_mismatches", F.lit(0)) + off).alias("n_mismatches")).withColumn("verified", F.col("n_mismatches") == 0)


def retained_earnings(totals: DataFrame, equity_accounts: DataFrame, key: str = "doc") -> DataFrame:
    """``(doc, retained_earnings)``: total equity less the equity accounts of top-level sections; 0 for a missing total."""
    own = equity_accounts.groupBy(key).agg(F.sum(F.col("value").cast(MONEY)).alias("explicit"))
    return totals.join(own, key, "left").select(key, (F.coalesce("total_equity", F.lit(0)).cast(MONEY) - F.coalesce("explicit", F.lit(0)).cast(MONEY)).cast(MONEY).alias("retained_earnings"))


def net_income(totals: DataFrame, key: str = "doc") -> DataFrame:
    """``(doc, net_income)``: income less expenses where both are known, else null."""
    return totals.select(key, (F.col("total_income").cast(MONEY) - F.col("total_expenses").cast(MONEY)).cast(MONEY).alias("net_income"))


def reserve_totals(components: DataFrame, bank_accounts: DataFrame, key: str = "doc") -> DataFrame:
    """``(doc, reserve_total, bank_total)``, 0 where a document has none of the kind."""
    r = components.groupBy(key).agg(F.sum(F.col("current_balance").cast(MONEY)).alias("reserve_total"))
    b = bank_accounts.groupBy(key).agg(F.sum(F.col("balance").cast(MONEY)).alias("bank_total"))
    return r.join(b, key, "full").select(key, *[F.coalesce(c, F.lit(0)).cast(MONEY).alias(c) for c in ("reserve_total", "bank_total")])


def trial_balance(accounts: DataFrame, key: str = "doc") -> DataFrame:
    """``(doc, debits, credits, balanced)``."""
    d = accounts.groupBy(key).agg(*[F.coalesce(F.sum(F.col(c).cast(MONEY)), F.lit(0)).cast(MONEY).alias(f"{c}s") for c in ("debit", "credit")])
    return d.withColumn("balanced", F.abs(F.col("debits") - F.col("credits")) <= F.lit(TOLERANCE).cast(MONEY))


def running_balance(lines: DataFrame, by: list[str], order: list[str]) -> DataFrame:
    """Adds ``running``: debits less credits up to the line, and ``agrees`` with the line's own balance (null where it has none)."""
    from pyspark.sql.window import Window

    w = Window.partitionBy(*by).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    step = F.coalesce(F.col("debit").cast(MONEY), F.lit(0)) - F.coalesce(F.col("credit").cast(MONEY), F.lit(0))
    d = lines.withColumn("running", F.sum(step.cast(MONEY)).over(w).cast(MONEY))
    return d.withColumn("agrees", F.abs(F.col("running") - F.col("balance").cast(MONEY)) <= F.lit(TOLERANCE).cast(MONEY))


# --- whole records ------------------------------------------------------------------------------------------------------


def _at(path: str, v: str | Column = "v", kind: str = "string") -> Column:
    return F.try_variant_get(v, f"$.{path}", kind)


def _amount(path: str, v: str | Column = "v") -> Column:
    return parse_amount(_at(path, v)).cast(MONEY)


def _list(path: str, v: str | Column = "v") -> Column:
    return F.coalesce(_at(path, v, "array<variant>"), F.array().cast("array<variant>"))


def _total(path: str, *keys: str) -> Column:
    """A total at the root of the record, else in its side; the first of the keys that is there."""
    return F.coalesce(*[c for k in keys for c in (_amount(k), _amount(f"{path}.{k}"))])


def _sum(values: Column, value) -> Column:
    return F.aggregate(values, F.lit(0).cast(MONEY), lambda acc, x: (acc + F.coalesce(value(x), F.lit(0).cast(MONEY))).cast(MONEY))


def statement_totals(parsed: DataFrame, key: str = "record_id") -> DataFrame:
    """``(key, total_assets, total_liabilities, total_equity)`` of parsed balance sheets (column ``v``): totals at the root stand before
    those of the sides, reported equity before the other."""
    return parsed.select(key, _total("assets", "total_assets").alias("total_assets"), _total("liabilities", "total_liabilities").alias("total_liabilities"), _total("equity", "total_equity_reported", "total_equity").alias("total_equity"))


def derived_fields(parsed: DataFrame, key: str = "record_id") -> DataFrame:
    """What is computed and not read, by type: ``(key, retained_earnings, net_income, reserve_total, bank_total)``, null for other types.

    Retained earnings: equity less the accounts of its top-level sections, those below them not counted; a missing equity is 0. Net
    income: income less expenses where both are known, totals at the root first. Reserves: the sums of the components' and of the
    bank accounts' balances. ``parsed`` has ``document_type`` and the parsed record ``v``; no join, no shuffle.
    """
    kind = F.col("document_type")
    own = F.flatten(F.transform(_list("equity.sections"), lambda s: _list("accounts", s)))
    value = lambda a: F.coalesce(_amount("balance", a), _amount("amount", a))
    falsy = lambda c: F.nullif(c, F.lit(0).cast(MONEY))
    equity = F.coalesce(falsy(_amount("equity.total_equity_reported")), _amount("equity.total_equity"), F.lit(0).cast(MONEY))
    income, expenses = (F.coalesce(_amount("total"), _amount(f"{s}.total"), _amount(f"total_{s}")) for s in ("income", "expenses"))
    return parsed.select(
        key,
        F.when(kind == "BALANCE_SHEET", (equity - _sum(own, value)).cast(MONEY)).alias("retained_earnings"),
        F.when(kind.isin("INCOME_STATEMENT", "INCOME_STATEMENT_COMPARISON"), (income - expenses).cast(MONEY)).alias("net_income"),
        F.when(kind == "RESERVE_ALLOCATION", _sum(_list("components"), lambda c: _amount("current_balance", c))).alias("reserve_total"),
        F.when(kind == "RESERVE_ALLOCATION", _sum(_list("bank_accounts"), value)).alias("bank_total"),
    )


def verify_statements(parsed: DataFrame, sections: DataFrame, accounts: DataFrame, key: str = "record_id") -> dict[str, DataFrame]:
    """``checks`` (section totals), ``equation`` (balance sheets), ``verified`` (a row for each record) and ``derived``.

    ``sections`` has ``key, path, section_total``, ``accounts`` has ``key, path, value`` (see ``section_check``).
    """
    checks = section_check(sections, accounts, (key, "path"))
    equation = balance_equation(statement_totals(parsed.filter("document_type = 'BALANCE_SHEET'"), key))
    return {"checks": checks, "equation": equation, "verified": verified(parsed.select(key), checks, equation, key), "derived": derived_fields(parsed, key)}
