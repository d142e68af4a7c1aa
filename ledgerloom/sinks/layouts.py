"""Records flattened to analysis and import layouts: CSV shapes, tab-delimited import rows, tax exchange records, JSON.

Records come as ``record_id, document_type, tax_year, metadata, data`` with ``data`` as JSON text; text around the record is
dropped and the rest is parsed to VARIANT once. Layouts are projections; statements, whose sections nest to any depth, are walked
in one map. Nothing is joined.
"""

from __future__ import annotations

from typing import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.amounts import import_money_text, money_text, parse_amount
from ..functions.text import checkbox, masked_last4, total_label
from ..operators import nested

# --- fixed values: shapes by document type ------------------------------------------------------------------------------

ACCOUNT_TYPES = "BALANCE_SHEET INCOME_STATEMENT INCOME_STATEMENT_COMPARISON BUDGET_VS_ACTUAL TRIAL_BALANCE RESERVE_ALLOCATION QB_PROFIT_LOSS QB_BALANCE_SHEET".split()
LEDGER_TYPES = "GENERAL_LEDGER QB_GENERAL_LEDGER QB_TRANSACTION_LIST".split()
AGING_TYPES = "ACCOUNTS_RECEIVABLE_AGING ACCOUNTS_PAYABLE_AGING QB_AR_AGING QB_AP_AGING".split()
SIDES = "assets liabilities equity income expenses other_income other_expenses components bank_accounts accounts".split()
TOTAL_KEYS = "section_total total_assets total_liabilities total_equity_reported total_equity total total_income total_expenses".split()
PERIOD_COLUMNS = {"BALANCE_SHEET": ["balance"], "RESERVE_ALLOCATION": ["balance"], "TRIAL_BALANCE": ["debit", "credit"]}
OTHER_PERIOD_COLUMNS = ["amount"]
LEDGER_FIELDS = "date type number name memo split".split()
AGING_BUCKETS = "current 1_to_30 31_to_60 61_to_90 over_90".split()
#: Bucket names of rows that stand for those of the header.
BUCKET_FIELDS = {"1_to_30": "days_1_30", "31_to_60": "days_31_60", "61_to_90": "days_61_90"}

# --- fixed values: parties and main amount of each tax form -------------------------------------------------------------

#: (type, party that pays, party that receives, path of the main amount, its label)
TAX_FORMS = (
    ("W2", "employer", "employee", "federal.box1_wages", "Box 1 wages"),
    ("1099-NEC", "payer", "recipient", "box1_nonemployee_compensation", "Box 1 nonemployee comp"),
    ("1099-MISC", "payer", "recipient", "box1_rents", "Box 1 rents"),
    ("1099-INT", "payer", "recipient", "box1_interest_income", "Box 1 interest"),
    ("1099-DIV", "payer", "recipient", "box1a_total_ordinary_dividends", "Box 1a ordinary dividends"),
    ("1099-B", "payer", "recipient", "summary.total_proceeds", "Total proceeds"),
    ("1099-R", "payer", "recipient", "box1_gross_distribution", "Box 1 gross distribution"),
    ("1099-G", "payer", "recipient", "box1_unemployment_compensation", "Box 1 unemployment"),
    ("1099-SA", "payer", "recipient", "box1_gross_distribution", "Box 1 gross distribution"),
    ("1099-K", "payer", "recipient", "box1a_gross_payment_card_transactions", "Box 1a gross payments"),
    ("1099-S", "filer", "transferor", "box2_gross_proceeds", "Box 2 gross proceeds"),
    ("1099-C", "creditor", "debtor", "box2_amount_of_debt_discharged", "Box 2 debt discharged"),
    ("1099-A", "lender", "borrower", "box2_balance_of_principal_outstanding", "Box 2 principal"),
    ("1098", "recipient", "payer", "box1_mortgage_interest", "Box 1 mortgage interest"),
    ("1098-T", "filer", "student", "box1_payments_received", "Box 1 tuition payments"),
    ("1098-E", "recipient", "borrower", "box1_student_loan_interest", "Box 1 student loan interest"),
    ("SSA-1099", "payer", "beneficiary", "box5_net_benefits", "Box 5 net benefits"),
    ("RRB-1099", "payer", "recipient", "box1_railroad_retirement_tier1", "Box 1 tier 1"),
    ("K-1 1065", "partnership", "partner", "box1_ordinary_business_income", "Box 1 ordinary bus. income"),
    ("K-1 1120-S", "corporation", "shareholder", "box1_ordinary_business_income", "Box 1 ordinary bus. income"),
    ("K-1 1041", "estate_or_trust", "beneficiary", "box1_interest_income", "Box 1 interest income"),
)

# --- fixed values: federal boxes and import fields ----------------------------------------------------------------------

FEDERAL = "box1_wages box2_federal_withheld box3_ss_wages box4_ss_withheld box5_medicare_wages box6_medicare_withheld box7_ss_tips box8_allocated_tips box10_dependent_care box11_nonqualified_plans".split()
#: Fields of a line after the parties: (path, how it is written).
IMPORT_FORMS = {
    "1099-NEC": (
        ("box1_nonemployee_compensation", "money"),
        ("box4_federal_withheld", "money"),
        ("state[0].state_abbr", "text"),
        ("state[0].state_id", "text"),
        ("state[0].box5_state_income", "money"),
        ("state[0].box6_state_withheld", "money"),
    ),
    "1099-INT": (
        ("box1_interest_income", "money"),
        ("box2_early_withdrawal_penalty", "money"),
        ("box3_us_savings_bond_interest", "money"),
        ("box4_federal_withheld", "money"),
        ("box8_tax_exempt_interest", "money"),
        ("state[0].state_abbr", "text"),
        ("state[0].state_id", "text"),
        ("state[0].box16_state_income", "money"),
        ("state[0].box17_state_withheld", "money"),
    ),
    "1099-DIV": (
        ("box1a_total_ordinary_dividends", "money"),
        ("box1b_qualified_dividends", "money"),
        ("box2a_total_capital_gain", "money"),
        ("box4_federal_withheld", "money"),
        ("box5_section199a_dividends", "money"),
        ("state[0].state_abbr", "text"),
        ("state[0].state_id", "text"),
        ("state[0].box14_state_income", "money"),
        ("state[0].box15_state_withheld", "money"),
    ),
    "1099-R": (
        ("box1_gross_distribution", "money"),
        ("box2a_taxable_amount", "money"),
        ("box4_federal_withheld", "money"),
        ("box7_distribution_code", "text"),
        ("box7_ira_sep_simple", "flag"),
        ("", "blank"),
        ("box15_state_id", "text"),
        ("box14_state_withheld", "money"),
        ("box16_state_distribution", "money"),
    ),
}
#: (code, path)
EXCHANGE = {
    "W2": (("0511", "federal.box1_wages"), ("0512", "federal.box2_federal_withheld"), ("0513", "federal.box3_ss_wages"), ("0514", "federal.box4_ss_withheld"), ("0515", "federal.box5_medicare_wages"), ("0516", "federal.box6_medicare_withheld")),
    "1099-INT": (("0612", "box1_interest_income"), ("0613", "box2_early_withdrawal_penalty"), ("0614", "box3_us_savings_bond_interest"), ("0617", "box4_federal_withheld"), ("0620", "box8_tax_exempt_interest")),
    "1099-DIV": (("0624", "box1a_total_ordinary_dividends"), ("0625", "box1b_qualified_dividends"), ("0627", "box2a_total_capital_gain"), ("0630", "box4_federal_withheld")),
    "1099-R": (("0521", "box1_gross_distribution"), ("0522", "box2a_taxable_amount"), ("0523", "box4_federal_withheld")),
}


def forms() -> tuple[tuple[str, ...], ...]:
    return TAX_FORMS


@F.pandas_udf(T.StringType())
def _first_record(texts: pd.Series) -> pd.Series:
    return texts.map(lambda t: None if t is None or (r := nested.complete_record(t)) is None else nested.dumps(r))


def parsed(records: DataFrame, data_col: str = "data") -> DataFrame:
    """Records with ``v``, the parsed object; records without a complete one are left out.

    The first complete object counts, as in ``nested.complete_record``. Where the text from the first brace to the last is no JSON
    (notes with braces), that reader finds it; other texts don't reach Python.
    """
    text = F.regexp_extract(data_col, r"(?s)\{.*\}", 0)
    d = records.withColumn("_v", F.try_parse_json(text)).withColumn("_w", _first_record(F.when(F.col("_v").isNull() & (text != ""), F.col(data_col))))
    return d.withColumn("v", F.coalesce("_v", F.try_parse_json("_w"))).drop("_v", "_w").filter("v is not null and schema_of_variant(v) like 'OBJECT%'")


def at(path: str, kind: str = "string", v: str = "v") -> Column:
    """The value at a dotted path; null where anything on the way is missing or of another kind."""
    return F.try_variant_get(v, f"$.{path}", kind)


def _blank(c: Column) -> Column:
    return F.coalesce(c, F.lit(""))


def _by_type(kind: Column, index: int, make) -> Column:
    out = F.lit(None).cast("string")
    for f in reversed(forms()):
        out = F.when(kind == f[0], make(f[index])).otherwise(out)
    return out


def shape(records: DataFrame) -> str:
    """``account``, ``ledger``, ``aging`` or ``tax``: the layout that all document types of the records allow; tax for none."""
    kinds = {r[0] for r in records.select("document_type").distinct().collect()}  # at most the registered types
    for name, types in (("account", ACCOUNT_TYPES), ("ledger", LEDGER_TYPES), ("aging", AGING_TYPES)):
        if kinds and kinds <= set(types):
            return name
    return "tax"


def w2_flat(records: DataFrame) -> DataFrame:
    """One row for each W-2: parties, boxes 1 to 11, four box 12 and box 14 slots, two state and two local rows, all as text."""
    d = parsed(records.filter("document_type = 'W2'"))
    cols: dict[str, Column] = {"record_id": F.col("record_id"), "document_type": F.col("document_type"), "tax_year": F.col("tax_year").cast("string"), "is_corrected": checkbox(F.col("metadata.is_corrected"))}
    for party, fields in (("employer", ("name", "ein", "address")), ("employee", ("name", "ssn_last4", "address"))):
        cols |= {f"{party}_{f}": _blank(at(f"{party}.{f}")) for f in fields}
    cols |= {b: money_text(at(f"federal.{b}")) for b in FEDERAL}
    for i, letter in enumerate("abcd"):
        cols[f"box12{letter}_code"] = _blank(at(f"box12[{i}].code"))
        cols[f"box12{letter}_amount"] = money_text(at(f"box12[{i}].amount"))
    cols |= {f"box13_{b}": checkbox(at(f"box13.{b}", "boolean")) for b in ("statutory_employee", "retirement_plan", "third_party_sick_pay")}
    for i in range(4):
        cols[f"box14_{i + 1}_label"] = _blank(at(f"box14_other[{i}].label"))
        cols[f"box14_{i + 1}_amount"] = money_text(at(f"box14_other[{i}].amount"))
    for i in range(2):
        cols[f"state{i + 1}_abbr"], cols[f"state{i + 1}_id"] = _blank(at(f"state[{i}].state_abbr")), _blank(at(f"state[{i}].state_id"))
        cols[f"state{i + 1}_wages"], cols[f"state{i + 1}_withheld"] = money_text(at(f"state[{i}].box16_state_wages")), money_text(at(f"state[{i}].box17_state_withheld"))
        cols[f"local{i + 1}_name"] = _blank(at(f"local[{i}].locality_name"))
        cols[f"local{i + 1}_wages"], cols[f"local{i + 1}_withheld"] = money_text(at(f"local[{i}].box18_local_wages")), money_text(at(f"local[{i}].box19_local_withheld"))
    cols["notes"] = _blank(F.array_join("metadata.notes", "; "))
    return d.select(*[c.alias(n) for n, c in cols.items()])


def generic_tax(records: DataFrame) -> DataFrame:
    """One row for each tax form: both parties and the form's main amount, as text."""
    d = parsed(records.filter(F.col("document_type").isin(*[f[0] for f in forms()])))
    kind = F.col("document_type")
    last4 = lambda p: F.coalesce(at(f"{p}.ssn_last4"), at(f"{p}.tin_last4"))
    return d.select(
        "record_id",
        "document_type",
        F.col("tax_year").cast("string").alias("tax_year"),
        _blank(_by_type(kind, 1, lambda p: at(f"{p}.name"))).alias("party_a_name"),
        _blank(_by_type(kind, 1, lambda p: F.coalesce(at(f"{p}.ein"), at(f"{p}.tin")))).alias("party_a_tin"),
        _blank(_by_type(kind, 2, lambda p: at(f"{p}.name"))).alias("party_b_name"),
        _blank(_by_type(kind, 2, last4)).alias("party_b_last4"),
        money_text(_by_type(kind, 3, lambda p: at(p))).alias("primary_amount"),
        _by_type(kind, 4, F.lit).alias("primary_label"),
    )


def import_w2(records: DataFrame) -> DataFrame:
    """``(record_id, state_no, line)``: tab-delimited rows, one for each state (one blank one without any), federal boxes repeated."""
    d = parsed(records.filter("document_type = 'W2'"))
    head = [masked_last4(at("employee.ssn_last4")), _blank(at("employer.name")), _blank(at("employer.ein"))]
    head += [import_money_text(at(f"federal.{b}")) for b in FEDERAL[:6]]
    for i in range(4):
        head += [_blank(at(f"box12[{i}].code")), import_money_text(at(f"box12[{i}].amount"))]
    for i in range(3):
        head += [_blank(at(f"box14_other[{i}].label")), import_money_text(at(f"box14_other[{i}].amount"))]
    rows = lambda name: F.coalesce(at(name, "array<variant>"), F.array().cast("array<variant>"))
    d = d.withColumn("states", rows("state")).withColumn("locals", rows("local")).withColumn("head", F.concat_ws("\t", *head))
    d = d.select("record_id", "head", F.explode(F.sequence(F.lit(0), F.greatest(F.size("states") - 1, F.lit(0)))).alias("state_no"), "states", "locals")
    d = d.withColumn("s", F.get("states", "state_no")).withColumn("l", F.get("locals", "state_no"))
    tail = [_blank(at("state_abbr", v="s")), _blank(at("state_id", v="s")), import_money_text(at("box16_state_wages", v="s")), import_money_text(at("box17_state_withheld", v="s"))]
    tail += [_blank(at("locality_name", v="l")), import_money_text(at("box18_local_wages", v="l")), import_money_text(at("box19_local_withheld", v="l"))]
    return d.select("record_id", "state_no", F.concat_ws("\t", "head", *tail).alias("line"))


def import_1099(records: DataFrame) -> DataFrame:
    """``(record_id, line)`` of 1099-NEC, INT, DIV and R; state fields from the first state row."""
    d = parsed(records.filter(F.col("document_type").isin(*IMPORT_FORMS)))

    def cell(path: str, how: str) -> Column:
        if how == "blank":
            return F.lit("")
        if how == "flag":
            return F.when(at(path, "boolean"), "Y").otherwise("")
        return import_money_text(at(path)) if how == "money" else _blank(at(path))

    party = [masked_last4(at("recipient.tin_last4")), _blank(at("payer.name")), _blank(at("payer.tin"))]
    line = F.lit(None).cast("string")
    for kind, fields in IMPORT_FORMS.items():
        line = F.when(F.col("document_type") == kind, F.concat_ws("\t", *party, *[cell(*f) for f in fields])).otherwise(line)
    return d.select("record_id", line.alias("line"))


def check_importable(records: DataFrame) -> None:
    """Raises where a record's type has no import layout, naming all such types."""
    bad = sorted(str(r[0]) for r in records.select("document_type").distinct().collect() if r[0] not in ("W2", *IMPORT_FORMS))
    if bad:
        raise ValueError("no import layout for: " + ", ".join(bad))


def exchange_records(records: DataFrame) -> DataFrame:
    """``(record_id, ord, code, payer, amount)`` of the tax exchange format."""
    d = parsed(records.filter(F.col("document_type").isin(*EXCHANGE)))
    entries = F.lit(None).cast("array<struct<code:string,amount:string>>")
    for kind, table in EXCHANGE.items():
        entries = F.when(F.col("document_type") == kind, F.array(*[F.struct(F.lit(c).alias("code"), import_money_text(at(p)).alias("amount")) for c, p in table])).otherwise(entries)
    payer = F.when(F.col("document_type") == "W2", at("employer.name")).otherwise(at("payer.name"))
    return d.select("record_id", _blank(payer).alias("payer"), F.posexplode(entries).alias("ord", "e")).select("record_id", "ord", "e.code", "payer", "e.amount")


def exchange_lines(records: DataFrame, made_on: str, program: str = "ledgerloom") -> DataFrame:
    """``(record_id, ord, lines)``: the header (record_id null) and each record's lines; ``made_on`` is mm/dd/yyyy."""
    spark = records.sparkSession
    body = exchange_records(records).select("record_id", "ord", F.concat(F.lit("T"), "code", F.lit("\nP"), "payer", F.lit("\n$"), "amount", F.lit("\n^")).alias("lines"))
    head = spark.range(1).select(F.lit(None).cast(body.schema["record_id"].dataType).alias("record_id"), F.lit(-1).alias("ord"), F.lit(f"V042\nA{program}\nD{made_on}\n^").alias("lines"))
    return head.unionByName(body)


def json_text(records: DataFrame) -> DataFrame:
    """``(record_id, json)``: whole documents with nulls, indented."""
    d = parsed(records)
    doc = F.struct("document_type", "tax_year", F.col("v").alias("data"), "metadata")
    return d.select("record_id", F.to_json(doc, {"ignoreNullFields": "false", "pretty": "true"}).alias("json"))


# --- statements ---------------------------------------------------------------------------------------------------------

_ROW = "record_id {id}, document_type string, entity_name string, software string, accounting_basis string, period_start string, period_end string, section string, subsection string, account_number string, account_name string, row_type string, cells map<string,string>, node_path string"
_NAMES = ("account_number", "account_name", "component_name")


def _cells(account: dict) -> dict[str, str | None]:
    out = {k: nested._text(v) for k, v in account.items() if v is not None and not isinstance(v, (dict, list)) and k not in _NAMES}
    if "balance" not in out and "current_balance" in out:
        out["balance"] = out["current_balance"]
    return out


def _title(key: str) -> str:
    return key.replace("_", " ").title()


def _str(value: object) -> str:
    return "" if value is None or isinstance(value, (dict, list)) else str(value)


def statement_rows(record: dict) -> Iterator[tuple[str, str, str, str, str, dict, str]]:
    """``(section, subsection, account_number, account_name, row_type, cells, node_path)`` of one record, in reading order.

    Line items stand alone, without totals. Else each side in turn: its sections with their accounts, subsections to any depth and
    subtotal, its own accounts, its totals. Totals go to the balance and to the amount column.
    """
    items = record.get("line_items")
    if isinstance(items, list):
        for i, x in enumerate(items):
            if isinstance(x, dict):
                values = x.get("values") if isinstance(x.get("values"), dict) else {}
                yield _str(x.get("section")), _str(x.get("subsection")), _str(x.get("account_number")), _str(x.get("account_name")), _str(x.get("row_type") or "account"), {k: nested._text(v) for k, v in values.items() if v is not None}, f"line_items[{i}]"
        return
    total = lambda v: {"balance": nested._text(v), "amount": nested._text(v)}

    def accounts(side: str, name: str, holder: object, path: str):
        for i, x in enumerate(nested._elements(holder) or []):
            if isinstance(x, dict):
                yield side, name, _str(x.get("account_number")), _str(x.get("account_name") or x.get("component_name")), "account", _cells(x), f"{path}[{i}]"

    for key in SIDES:
        side, value = key.upper(), record.get(key)
        if key in ("components", "bank_accounts", "accounts"):
            yield from accounts(side, "", value, key)
            continue
        if isinstance(value, list):
            yield from accounts(side, "", value, key)
            continue
        if not isinstance(value, dict):
            continue
        # sections still to open, last first; a finished section comes again as its subtotal
        todo = [("open", f"{key}.{f}[{i}]", x) for f in ("sections", "subsections") for i, x in enumerate(nested._elements(value.get(f)) or []) if isinstance(x, dict)][::-1]
        while todo:
            what, path, x = todo.pop()
            name = _str(x.get("section_name"))
            if what == "close":
                yield side, name, "", f"Total {name}", "subtotal", total(x["section_total"]), path
                continue
            yield from accounts(side, name, x.get("accounts"), f"{path}.accounts")
            if x.get("section_total") is not None:
                todo.append(("close", path, x))
            below = [("open", f"{path}.{f}[{i}]", y) for f in ("sections", "subsections") for i, y in enumerate(nested._elements(x.get(f)) or []) if isinstance(y, dict)]
            todo += below[::-1]
        yield from accounts(side, "", value.get("accounts"), f"{key}.accounts")
        for k in TOTAL_KEYS:
            if value.get(k) is not None:
                yield side, "", "", _title(k), "total", total(value[k]), f"{key}.{k}"


def account_cells(records: DataFrame) -> DataFrame:
    """Statement rows in long form: fixed columns, ``cells`` (text by column) and ``node_path``. One map over the records, no shuffle.

    ``section`` is the side, ``subsection`` the name of the section that holds the account; a null or unreadable record has no rows.
    """
    src = records.filter(F.col("document_type").isin(*ACCOUNT_TYPES)).select("record_id", "document_type", "data").filter("data is not null")
    schema = _ROW.format(id=src.schema["record_id"].dataType.simpleString())
    names = [c.split()[0] for c in schema.split(", ")]

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            rows = []
            for i, kind, text in zip(f["record_id"], f["document_type"], f["data"]):
                record = nested.complete_record(text)
                if record is not None:
                    entity = record.get("entity") if isinstance(record.get("entity"), dict) else {}
                    head = (i, kind, *(_str(entity.get(k)) for k in ("name", "software", "accounting_basis", "period_start", "period_end")))
                    rows += [(*head, *r) for r in statement_rows(record)]
                if len(rows) > 20_000:
                    yield pd.DataFrame(rows, columns=names)
                    rows = []
            yield pd.DataFrame(rows, columns=names)

    return src.mapInPandas(run, schema)


def statement_columns(records: DataFrame, most: int = 1000) -> list[str]:
    """The period columns of all statements, in order of first appearance by record: the keys that a record lists, else those of its
    type. More than ``most`` is an error, as no table has so many columns."""
    d = parsed(records.filter(F.col("document_type").isin(*ACCOUNT_TYPES)).select("record_id", "document_type", "data"))
    listed = F.filter(F.transform(F.coalesce(at("columns", "array<variant>"), F.array().cast("array<variant>")), lambda c: F.try_variant_get(c, "$.key", "string")), lambda k: k.isNotNull() & (k != ""))
    usual = F.array(*map(F.lit, OTHER_PERIOD_COLUMNS))
    for kind, cols in PERIOD_COLUMNS.items():
        usual = F.when(F.col("document_type") == kind, F.array(*map(F.lit, cols))).otherwise(usual)
    keys = d.select(F.col("record_id").alias("doc"), F.posexplode(F.when(F.size(listed) > 0, listed).otherwise(usual)).alias("ord", "key"))
    found = period_columns(keys).limit(most + 1).collect()
    if len(found) > most:
        raise ValueError(f"more than {most} period columns")
    return [r["key"] for r in sorted(found, key=lambda r: r["ord"])]


def account_rows(records: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """Statement rows with a column for each period (``statement_columns`` where none are given), as amounts."""
    d = account_cells(records)
    columns = statement_columns(records) if columns is None else columns
    return d.select(*[c for c in d.columns if c not in ("cells", "node_path")], *[parse_amount(F.col("cells")[c]).alias(c) for c in columns], "node_path")


def line_items(records: DataFrame) -> DataFrame:
    """Multi-column statements: ``record_id, node_path, account_number, account_name, row_type, period, value``, a row for each line
    item and period; periods without a value have no row (null isn't zero)."""
    long = account_cells(records).filter(F.col("node_path").startswith("line_items["))
    return long.select("record_id", "node_path", "account_number", "account_name", "row_type", F.explode("cells").alias("period", "raw")).select("record_id", "node_path", "account_number", "account_name", "row_type", "period", parse_amount(F.col("raw")).alias("value"))


def period_columns(columns: DataFrame) -> DataFrame:
    """``(key, ord)``: period keys of all documents in order of first appearance; ``columns`` has ``doc, ord, key``."""
    first = columns.filter("key is not null").groupBy("key").agg(F.min(F.struct("doc", "ord")).alias("first"))
    from pyspark.sql.window import Window

    return first.select("key", (F.row_number().over(Window.orderBy("first", "key")) - 1).alias("ord"))  # as many rows as there are period keys


def ledger_records(records: DataFrame) -> DataFrame:
    """Rows of ledger records in the 13 columns of the transaction layout, with ``record_id, ord``: of each account its beginning
    balance, its transactions and its ending balance, amounts as text."""
    d = parsed(records.filter(F.col("document_type").isin(*LEDGER_TYPES)))
    d = d.select("record_id", _blank(at("entity.name")).alias("entity_name"), F.posexplode(at("accounts", "array<variant>")).alias("_a", "a")).filter("schema_of_variant(a) like 'OBJECT%'")
    text = lambda v, p: F.coalesce(F.try_variant_get(v, f"$.{p}", "string"), F.lit(""))
    none = {k: F.lit("") for k in (*LEDGER_FIELDS, "debit", "credit", "balance")}
    line = lambda kind, cells: F.struct(*[c.alias(k) for k, c in {**none, **cells}.items()], kind.alias("row_type"))
    entry = lambda t: line(F.coalesce(F.try_variant_get(t, "$.row_type", "string"), F.lit("transaction")), {k: text(t, k) for k in (*LEDGER_FIELDS, "debit", "credit", "balance")})
    txns = F.filter(F.coalesce(at("transactions", "array<variant>", "a"), F.array().cast("array<variant>")), lambda t: F.schema_of_variant(t).startswith("OBJECT"))
    rows = F.concat(F.array(line(F.lit("balance_header"), {"balance": text("a", "beginning_balance")})), F.transform(txns, entry), F.array(line(F.lit("balance_footer"), {"balance": text("a", "ending_balance")})))
    d = d.select("record_id", "entity_name", text("a", "account_number").alias("account_number"), text("a", "account_name").alias("account_name"), "_a", F.posexplode(rows).alias("_t", "t"))
    return d.select("record_id", F.struct(F.col("_a").alias("account"), F.col("_t").alias("line")).alias("ord"), "entity_name", "account_number", "account_name", "t.*")


def aging_records(records: DataFrame, buckets: list[str] | None = None) -> DataFrame:
    """Rows of aging records, and of their totals: ``record_id, ord, entity_name, report_type, name, <buckets>, total, row_type``,
    amounts as text. A bucket may go by its field name too."""
    d = parsed(records.filter(F.col("document_type").isin(*AGING_TYPES)))
    cell = lambda v, k: F.coalesce(F.try_variant_get(v, f"$['{k}']", "string"), *([F.try_variant_get(v, f"$.{BUCKET_FIELDS[k]}", "string")] if k in BUCKET_FIELDS else []), F.lit(""))
    buckets = buckets or AGING_BUCKETS
    line = lambda v, name, kind: F.struct(name.alias("name"), *[cell(v, b).alias(b) for b in buckets], cell(v, "total").alias("total"), F.lit(kind).alias("row_type"))
    kept = F.filter(F.coalesce(at("rows", "array<variant>"), F.array().cast("array<variant>")), lambda r: F.schema_of_variant(r).startswith("OBJECT"))
    totals = at("totals", "variant")
    end = F.when(F.schema_of_variant(totals).startswith("OBJECT"), F.array(line(totals, F.lit("TOTAL"), "total"))).otherwise(F.array().cast(f"array<struct<name:string,{''.join(f'`{b}`:string,' for b in buckets)}total:string,row_type:string>>"))
    rows = F.concat(F.transform(kept, lambda r: line(r, F.coalesce(F.try_variant_get(r, "$.name", "string"), F.lit("")), "row")), end)
    return d.select("record_id", _blank(at("entity.name")).alias("entity_name"), F.coalesce(at("report_type"), F.lit("AR")).alias("report_type"), F.posexplode(rows).alias("ord", "r")).select("record_id", "ord", "entity_name", "report_type", "r.*")


def aging_buckets(records: DataFrame) -> list[str]:
    """The buckets that the first record by id lists, else the usual five."""
    d = parsed(records.filter(F.col("document_type").isin(*AGING_TYPES)))
    first = d.select(at("aging_buckets", "array<string>").alias("b"), "record_id").agg(F.min_by("b", "record_id").alias("b")).first()
    return list(first["b"]) if first and first["b"] else AGING_BUCKETS


def ledger_rows(lines: DataFrame, entity: str = "client_code") -> DataFrame:
    """Ledger lines in the 13 columns of the transaction layout, amounts as text; blank where a line has none."""
    text = lambda c: _blank(F.col(c).cast("string"))
    return lines.select(
        "txn_id", _blank(F.col(entity)).alias("entity_name"), text("account_number").alias("account_number"), text("account_name").alias("account_name"), text("txn_date").alias("date"), text("txn_type").alias("type"),
        text("txn_number").alias("number"), text("name").alias("name"), text("memo").alias("memo"), text("split_account").alias("split"), *[money_text(F.col(c)).alias(c) for c in ("debit", "credit", "balance")], "row_type",
    )


def aging_rows(items: DataFrame, by: list[str]) -> DataFrame:
    """A row for each name with the sums of its buckets and their total, and a TOTAL row for each report.

    ``items`` has the columns ``by``, ``name, bucket, amount``; buckets may go by their field names too.
    """
    for header, name in BUCKET_FIELDS.items():
        items = items.replace(name, header, subset=["bucket"])
    sums = [F.coalesce(F.sum(F.when(F.col("bucket") == b, F.col("amount"))), F.lit(0)).cast("decimal(18,2)").alias(f"b_{b}") for b in AGING_BUCKETS]
    total = F.sum("amount").cast("decimal(18,2)").alias("total")
    rows = items.groupBy(*by, "name").agg(*sums, total).withColumn("row_type", F.lit("row"))
    ends = items.groupBy(*by).agg(*sums, total).withColumn("name", F.lit("TOTAL")).withColumn("row_type", F.lit("total"))
    return rows.unionByName(ends)


FORMATS = ("json", "csv", "lacerte", "txf")
MEDIA_TYPES = {"json": "application/json", "csv": "text/csv", "lacerte": "text/plain", "txf": "text/plain"}


def format_records(records: DataFrame, fmt: str, made_on: str = "01/01/2025") -> dict[str, DataFrame]:
    """The tables of a format by name; mixed tax records give both the W-2 and the generic table."""
    if fmt == "json":
        return {"json": json_text(records)}
    if fmt == "csv":
        kind = shape(records)
        if kind == "account":
            return {"accounts": account_rows(records)}
        if kind == "ledger":
            return {"ledger": ledger_records(records)}
        if kind == "aging":
            return {"aging": aging_records(records, aging_buckets(records))}
        return {"w2": w2_flat(records), "tax": generic_tax(records.filter("document_type <> 'W2'"))}
    if fmt == "lacerte":
        check_importable(records)
        return {"w2": import_w2(records), "1099": import_1099(records)}
    if fmt == "txf":
        return {"txf": exchange_lines(records, made_on)}
    raise ValueError(f"unknown format {fmt!r}; one of {', '.join(FORMATS)}")
