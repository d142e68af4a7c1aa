import json

import pytest
from pyspark.sql import functions as F

from ledgerloom.sinks import layouts as L

W2 = {
    "employer": {"name": "Acme", "ein": None}, "employee": {"name": "Ann", "ssn_last4": "XXX-XX-1234"}, "federal": {"box1_wages": 5, "box2_federal_withheld": "1,0"},
    "box12": [{"code": "D", "amount": 1.5}], "box13": {"retirement_plan": True}, "state": [{"state_abbr": "TX", "box16_state_wages": 5}, {"state_abbr": "CA"}], "local": [{"locality_name": "Elk"}],
}
SCHEMA = "record_id long, document_type string, tax_year int, data string, metadata struct<is_corrected:boolean,is_void:boolean,is_summary_sheet:boolean,payer_tin_type:string,notes:array<string>>"


def records(spark, *rows):
    return spark.createDataFrame([(i, t, 2024, d if isinstance(d, str) or d is None else json.dumps(d), (False, None, None, None, ["a", "b"])) for i, (t, d) in enumerate(rows)], SCHEMA)


def test_w2(spark):
    r = records(spark, ("W2", W2), ("W2", None), ("W2", "broken {"), ("W2", "```json\n" + json.dumps({"state": {"state_abbr": "NY"}}) + "\n```"))
    rows = {x.record_id: x for x in L.w2_flat(r).collect()}
    assert set(rows) == {0, 3} and len(rows[0]) == 54
    a = rows[0]
    assert (a.employer_name, a.employer_ein, a.box1_wages, a.box2_federal_withheld, a.box12a_code, a.box12a_amount, a.box13_retirement_plan, a.box13_statutory_employee, a.state2_abbr, a.local1_name, a.notes) == ("Acme", "", "5.00", "1,0", "D", "1.50", "Y", "", "CA", "Elk", "a; b")
    lines = {(x.record_id, x.state_no): x.line.split("\t") for x in L.import_w2(r).collect()}
    assert set(lines) == {(0, 0), (0, 1), (3, 0)} and all(len(v) == 30 for v in lines.values())
    assert lines[0, 0][0] == "XXXXX1234" and lines[0, 0][-7:] == ["TX", "", "5.00", "0.00", "Elk", "0.00", "0.00"] and lines[0, 1][-7] == "CA" and lines[0, 1][-3] == ""


def test_exchange_and_generic(spark):
    r = records(spark, ("W2", W2), ("1099-INT", {"payer": {"name": "B"}, "recipient": {"tin_last4": "9876"}, "box1_interest_income": 7}), ("K-1 1065", {"partnership": {"name": "P"}}), ("BALANCE_SHEET", {}))
    x = L.exchange_records(r).filter("record_id = 1").orderBy("ord").collect()
    assert [(e.code, e.payer, e.amount) for e in x] == [("0612", "B", "7.00"), ("0613", "B", "0.00"), ("0614", "B", "0.00"), ("0617", "B", "0.00"), ("0620", "B", "0.00")]
    text = [e.lines for e in L.exchange_lines(r, "01/02/2026").orderBy(F.col("record_id").asc_nulls_first(), "ord").collect()]
    assert text[0] == "V042\nAledgerloom\nD01/02/2026\n^" and text[1] == "T0511\nPAcme\n$5.00\n^"
    g = {e.record_id: e for e in L.generic_tax(r).collect()}
    assert g[1].primary_amount == "7.00" and g[1].party_b_last4 == "9876" and g[2].party_a_name == "P" and g[2].primary_amount == "" and 3 not in g
    assert L.import_1099(r).first().line.split("\t")[:4] == ["XXXXX9876", "B", "", "7.00"]
    with pytest.raises(ValueError, match="BALANCE_SHEET, K-1 1065"):
        L.format_records(r, "lacerte")
    with pytest.raises(ValueError):
        L.format_records(r, "pdf")
    assert set(L.format_records(r, "csv")) == {"w2", "tax"} and L.shape(r.limit(0)) == "tax"
    assert json.loads(L.json_text(r).filter("record_id = 1").first().json)["data"]["box1_interest_income"] == 7


def test_account_rows(spark):
    deep = {"section_name": "Deep", "accounts": [{"account_name": "d", "current_balance": 3}], "section_total": "n/a"}
    sections = [{"section_name": "Cash", "accounts": [{"account_number": 1, "account_name": "Op", "balance": "(5.00)"}, "n/a"], "subsections": [deep], "section_total": 5}, None]
    data = {"entity": {"name": "E", "software": "S", "period_end": "2024-12-31"}, "assets": {"sections": sections, "accounts": {"account_name": "own", "balance": 1}, "total_assets": 5}, "equity": [{"component_name": "C", "balance": "x"}], "liabilities": None}
    income = {"income": {"sections": [], "total": "7"}, "bank_accounts": [{"account_name": "B", "balance": 2}], "accounts": "none"}
    r = records(spark, ("BALANCE_SHEET", data), ("INCOME_STATEMENT", income), ("BALANCE_SHEET", None), ("BALANCE_SHEET", "{broken"))
    assert L.shape(r) == "account" and L.statement_columns(r) == ["balance", "amount"]
    got = [(x.row_type, x.section, x.subsection, x.account_number, x.account_name, None if x.balance is None else float(x.balance), None if x.amount is None else float(x.amount), x.node_path) for x in L.account_rows(r).filter("record_id = 0").collect()]
    assert got == [
        ("account", "ASSETS", "Cash", "1", "Op", -5.0, None, "assets.sections[0].accounts[0]"),
        ("account", "ASSETS", "Deep", "", "d", 3.0, None, "assets.sections[0].subsections[0].accounts[0]"),
        ("subtotal", "ASSETS", "Deep", "", "Total Deep", None, None, "assets.sections[0].subsections[0]"),
        ("subtotal", "ASSETS", "Cash", "", "Total Cash", 5.0, 5.0, "assets.sections[0]"),
        ("account", "ASSETS", "", "", "own", 1.0, None, "assets.accounts[0]"),
        ("total", "ASSETS", "", "", "Total Assets", 5.0, 5.0, "assets.total_assets"),
        ("account", "EQUITY", "", "", "C", None, None, "equity[0]"),
    ]
    first = L.account_rows(r).first()
    assert (first.entity_name, first.software, first.accounting_basis, first.period_end) == ("E", "S", "", "2024-12-31")
    assert [(x.section, x.row_type, x.balance, x.amount) for x in L.account_rows(r).filter("record_id = 1").collect()] == [("INCOME", "total", 7, 7), ("BANK_ACCOUNTS", "account", 2, None)]
    assert L.account_rows(r.limit(0)).count() == 0 and L.statement_columns(r.limit(0)) == []
    with pytest.raises(ValueError):
        L.statement_columns(r, most=1)


def test_a_note_with_braces_after_the_record(spark):
    r = records(spark, ("W2", json.dumps(W2) + " see {note}"), ("W2", "{it}: " + json.dumps(W2)), ("W2", "{it}"))
    assert [x.record_id for x in L.w2_flat(r).orderBy("record_id").collect()] == [0, 1] and L.w2_flat(r).first().employer_name == "Acme"


def test_line_items_and_aging(spark):
    data = {"columns": [{"key": "a"}, {"key": "b"}, {}], "line_items": [{"account_name": "Rent", "section": "Expense", "values": {"a": "1,000", "b": None}}, {"account_number": 7, "row_type": "total", "values": {"b": 2}}, "n/a"], "income": {"total": 5}}
    r = records(spark, ("BUDGET_VS_ACTUAL", data), ("BUDGET_VS_ACTUAL", {}), ("W2", data))
    got = sorted((x.node_path, x.account_number, x.account_name, x.period, None if x.value is None else float(x.value)) for x in L.line_items(r).collect())
    assert got == [("line_items[0]", "", "Rent", "a", 1000.0), ("line_items[1]", "7", "", "b", 2.0)]
    wide = L.format_records(r.filter("document_type <> 'W2'"), "csv")["accounts"].collect()
    assert [(x.section, x.account_name, x.row_type, x.a, x.b) for x in wide] == [("Expense", "Rent", "account", 1000, None), ("", "", "total", None, 2)]
    items = spark.createDataFrame([("AR", "X", "days_1_30", 5.0), ("AR", "X", "1_to_30", 1.0), ("AR", "Y", "over_90", 2.0)], "report string, name string, bucket string, amount double")
    rows = {(x.name, x.row_type): (float(x.b_1_to_30), float(x.b_over_90), float(x.total)) for x in L.aging_rows(items, ["report"]).collect()}
    assert rows == {("X", "row"): (6.0, 0.0, 6.0), ("Y", "row"): (0.0, 2.0, 2.0), ("TOTAL", "total"): (6.0, 2.0, 8.0)}


def test_trial_balance_ledger_and_aging_records(spark):
    tb = records(spark, ("TRIAL_BALANCE", {"accounts": [{"account_number": "1", "account_name": "Cash", "debit": 5, "credit": 0}]}))
    assert [(x.section, x.debit, x.credit) for x in L.format_records(tb, "csv")["accounts"].collect()] == [("ACCOUNTS", 5, 0)]
    gl = {"entity": {"name": "E"}, "accounts": [{"account_name": "Bank", "beginning_balance": 1.5, "transactions": [{"date": "d", "debit": "2.00", "row_type": None}, "x"], "ending_balance": None}, "n/a", {"account_number": 9}]}
    rows = L.format_records(records(spark, ("GENERAL_LEDGER", gl), ("GENERAL_LEDGER", {})), "csv")["ledger"].orderBy("record_id", "ord").collect()
    assert [(x.account_number, x.account_name, x.date, x.debit, x.balance, x.row_type) for x in rows] == [
        ("", "Bank", "", "", "1.5", "balance_header"), ("", "Bank", "d", "2.00", "", "transaction"), ("", "Bank", "", "", "", "balance_footer"), ("9", "", "", "", "", "balance_header"), ("9", "", "", "", "", "balance_footer"),
    ]
    aging = {"aging_buckets": ["current", "91+"], "rows": [{"name": "X", "current": 5, "91+": "7", "total": 12}, 3], "totals": {"current": 5}}
    r = records(spark, ("QB_AR_AGING", aging), ("QB_AR_AGING", {"rows": [{"name": "Y", "days_1_30": 1}]}))
    rows = L.format_records(r, "csv")["aging"].orderBy("record_id", "ord").collect()
    assert [(x.name, x.report_type, x.current, x["91+"], x.total, x.row_type) for x in rows] == [("X", "AR", "5", "7", "12", "row"), ("TOTAL", "AR", "5", "", "", "total"), ("Y", "AR", "", "", "", "row")]
    assert L.aging_records(r).filter("name = 'Y'").first()["1_to_30"] == "1" and L.aging_buckets(r.limit(0)) == L.AGING_BUCKETS


def test_validation(spark):
    from ledgerloom.operators import validate

    assert len(validate.known_types()) == 30
    r = records(spark, ("W2", W2), ("W2", {"employer": {}}), ("BALANCE_SHEET", {"entity": {"name": ""}}), ("X", {}), ("K-1 1041", "broken {"), (None, None), ("TRIAL_BALANCE", {"entity": {"name": "E"}}))
    got = {x.record_id: x.problems for x in validate.validated(r).collect()}
    assert got == {0: [], 1: ["missing employee"], 2: ["missing entity.name"], 3: ["unknown type"], 4: ["no record"], 5: ["unknown type", "no record"], 6: []}


def test_page_confidence(spark):
    from ledgerloom.sources.files import page_confidence

    w = spark.createDataFrame([(1, 0.9), (1, 0.1), (2, None)], "page int, confidence double")
    assert {x.page: (x.confidence, x.doubtful) for x in page_confidence(w, ["page"]).collect()} == {1: (0.5, True), 2: (None, False)}
