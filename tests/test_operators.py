import json
from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from ledgerloom.operators import chunking as C
from ledgerloom.operators import merging as M
from ledgerloom.operators import sanitize as Z
from ledgerloom.operators import sectionize as S
from ledgerloom.operators import verify as V

# --- sections ---------------------------------------------------------------------------------------------------------


def files(spark, *page_lists):
    return spark.createDataFrame([(i, p) for i, p in enumerate(page_lists)], "file_id long, pages array<struct<page:int,text:string>>")


def sections(spark, *page_lists):
    rows = S.sections(S.pages(files(spark, *page_lists))).orderBy("file_id", "section_no").collect()
    return [(r.file_id, r.document_type, r.start_position, r.end_position) for r in rows]


def test_sections(spark):
    two = [(3, "more"), (0, "Balance Sheet\nx"), (1, "continued"), (2, "\n\nIncome Statement\ny")]
    one = [(1, "Balance Sheet"), (2, "Balance Sheet as of 01/01/2024")]
    none = [(1, "hello"), (2, None)]
    late = [(1, "cover"), (2, "Form W-2 Wage and Tax Statement"), (3, "Form 1099-NEC")]
    got = sections(spark, two, one, none, [], None, late)
    assert got == [
        (0, "BALANCE_SHEET", 0, 1), (0, "INCOME_STATEMENT", 2, 3), (1, "BALANCE_SHEET", 0, 1), (2, "UNKNOWN", 0, 1), (5, "W2", 1, 1), (5, "1099-NEC", 2, 2),
    ]
    p = S.pages(files(spark, two, one, none, [], None, late))
    s = S.sections(p)
    assert S.unassigned_pages(p, s).count() == 1 and S.section_pages(p, s).count() == 11 - 1
    text = {r.file_id: r.text for r in S.concat_pages(p).collect()}
    assert text[0].startswith("--- PAGE 0 ---\nBalance Sheet\nx\n--- PAGE 1 ---") and text[2] == "--- PAGE 1 ---\nhello"


# --- chunks -----------------------------------------------------------------------------------------------------------


def chunks(spark, text, kind=None, tokens=100):
    df = spark.createDataFrame([(1, text, kind)], "id long, text string, document_type string")
    return C.chunk(df, "id", max_tokens=tokens).orderBy("chunk_index").collect()


def test_chunks(spark):
    assert [c.text for c in chunks(spark, "short")] == ["short"] and [c.text for c in chunks(spark, "")] == [""] and chunks(spark, None) == []
    pages = "\n--- PAGE BREAK ---\n".join("p" * 100 + str(i) for i in range(9))
    got = chunks(spark, pages)
    assert [c.chunk_index for c in got] == list(range(len(got))) and {c.total_chunks for c in got} == {len(got)} and got[0].tier == "page" and all(len(c.text) <= 350 for c in got)
    ledger = "".join(f"10{i}0-0000 Cash\n{'entry ' * 20}\n\n" for i in range(10, 20))
    got = chunks(spark, ledger, "GENERAL_LEDGER")
    assert "".join(c.text for c in got) == ledger and got[0].tier == "account" and all(c.account_context for c in got) and len(got) > 2
    got = chunks(spark, "w" * 1000)
    assert got[0].tier == "window" and [len(c.text) for c in got] == [350, 350, 350, 55]
    text = "".join(chr(97 + i % 26) for i in range(1000))
    assert "".join(c.text[: 315 if i < 3 else None] for i, c in enumerate(chunks(spark, text))) == text


def test_prompts(spark):
    df = spark.createDataFrame([(0, 2, "t", "1010 Cash", "GENERAL_LEDGER"), (0, 1, "t", None, None)], "chunk_index int, total_chunks int, text string, account_context string, document_type string")
    assert [r.prompt for r in C.prompt_text(df).collect()] == ["[chunk 1 of 2, GENERAL_LEDGER, account: 1010 Cash]\nt", "t"]


# --- verification -----------------------------------------------------------------------------------------------------


def test_section_check(spark):
    acc = spark.createDataFrame([(1, "a", "1000"), (1, "a", "2000"), (1, "a", "500"), (2, "a", "300.01"), (3, "a", "300"), (3, "b", None)], "doc int, path string, v string").select("doc", "path", F.col("v").cast("decimal(18,2)").alias("value"))
    sec = spark.createDataFrame([(1, "a", "3500"), (2, "a", "300"), (3, "a", "500"), (3, "b", "0"), (3, "c", None), (4, "a", "0.03")], "doc int, path string, t string").select("doc", "path", F.col("t").cast("decimal(18,2)").alias("section_total"))
    chk = V.section_check(sec, acc)
    got = {(r.doc, r.path): (r.matches, r.delta) for r in chk.collect()}
    assert got[1, "a"] == (True, 0) and got[2, "a"][0] and got[3, "a"] == (False, Decimal(-200)) and got[3, "b"][0] and (3, "c") not in got and not got[4, "a"][0]
    docs = spark.createDataFrame([(i,) for i in range(1, 6)], "doc int")
    assert {r.doc: r.verified for r in V.verified(docs, chk).collect()} == {1: True, 2: True, 3: False, 4: False, 5: True}


def test_equation_and_derived(spark):
    t = spark.createDataFrame([(1, 10000.0, 4000.0, 6000.0), (2, 10000.0, 4000.0, 5950.0), (3, None, 1.0, 1.0)], "doc int, total_assets double, total_liabilities double, total_equity double")
    got = {r.doc: (r.balanced, r.note) for r in V.balance_equation(t).collect()}
    assert got[1] == (True, None) and got[2] == (False, "Assets differ from liabilities and equity by 50.00") and got[3] == (None, None)
    assert V.verified(t, V.section_check(spark.createDataFrame([], "doc int, path string, section_total decimal(18,2)"), spark.createDataFrame([], "doc int, path string, value decimal(18,2)")), V.balance_equation(t)).filter("not verified").count() == 1
    eq = spark.createDataFrame([(1, 900000.0)], "doc int, value double")
    tot = spark.createDataFrame([(1, 1000000.0), (2, None)], "doc int, total_equity double")
    assert {r.doc: r.retained_earnings for r in V.retained_earnings(tot, eq).collect()} == {1: 100000, 2: 0}
    ni = spark.createDataFrame([(1, 50000.0, 35000.0), (2, None, 1.0)], "doc int, total_income double, total_expenses double")
    assert {r.doc: r.net_income for r in V.net_income(ni).collect()} == {1: 15000, 2: None}
    r = V.reserve_totals(spark.createDataFrame([(1, 50000.0), (1, -10000.0)], "doc int, current_balance double"), spark.createDataFrame([(1, 30000.0), (1, 15000.0), (2, 1.0)], "doc int, balance double"))
    assert {x.doc: (x.reserve_total, x.bank_total) for x in r.collect()} == {1: (40000, 45000), 2: (0, 1)}
    assert V.account_value is not None and spark.range(1).select(V.account_value(F.lit(None), F.lit(None)).alias("v")).first().v == 0


def test_running_balance(spark):
    rows = [("a", 1, 5.0, None, 5.0), ("a", 2, None, 2.0, 3.0), ("a", 3, 1.0, None, None), ("a", 4, None, None, 9.0)]
    d = V.running_balance(spark.createDataFrame(rows, "k string, i int, debit double, credit double, balance double"), ["k"], ["i"])
    assert [(r.running, r.agrees) for r in d.orderBy("i").collect()] == [(5, True), (3, True), (4, None), (4, False)]


# --- merging ----------------------------------------------------------------------------------------------------------


def test_merges(spark):
    p = spark.createDataFrame([(1, 0, "10", "Cash", 1.0, None, 2), (1, 1, "10", "Cash!", 9.0, 5.0, 3), (1, 2, "10", "Cash", None, None, 1), (1, 1, None, "Petty", 0.0, 0.0, 1), (1, 2, "", "Petty", 3.0, 4.0, 1)], "doc int, chunk_index int, account_number string, account_name string, beginning_balance double, ending_balance double, n_transactions int")
    got = {r.account_key: (r.first_chunk, r.account_name, r.beginning_balance, r.ending_balance, r.n_transactions) for r in M.merge_ledger(p).collect()}
    assert got == {"10": (0, "Cash", 1.0, 5.0, 6), "Petty": (1, "Petty", 0.0, 4.0, 2)}
    s = spark.createDataFrame([(1, 0, "assets", "A", 2, None), (1, 1, "assets", "A", 1, 7.0), (1, 2, "assets", "A", 1, None)], "doc int, chunk_index int, side string, section_name string, n_accounts int, section_total double")
    assert [tuple(r) for r in M.merge_sections(s).collect()] == [(1, "assets", "A", 0, 4, 7.0)]
    e = spark.createDataFrame([(1, 0, ""), (1, 1, "X"), (2, 0, None), (2, 1, "")], "doc int, chunk_index int, entity_name string")
    assert {r.doc: r.entity_name for r in M.merge_entity(e).collect()} == {1: "X", 2: None}
    n = spark.createDataFrame([(1, 1, 0, "b"), (1, 0, 0, "a"), (1, 0, 1, "b"), (1, 2, 0, None)], "doc int, chunk_index int, ord int, note string")
    assert [(r.ord, r.note) for r in M.merge_notes(n).orderBy("ord").collect()] == [(0, "a"), (1, "b")]
    f = spark.createDataFrame([(1, True), (1, None), (2, None)], "doc int, void boolean")
    assert {r.doc: r.void for r in M.merge_flags(f, ["void"]).collect()} == {1: True, 2: False}
    u = spark.createDataFrame([(1, 0, 5, 1, 0, "length"), (1, 1, 6, 2, 1, "stop")], "doc int, chunk_index int, prompt_tokens int, completion_tokens int, retries int, finish_reason string")
    assert tuple(M.merge_usage(u).first()) == (1, 11, 3, 1, 2, "stop")
    assert [r.doc for r in M.failed_documents(spark.createDataFrame([(1,), (9,)], "doc int"), u).collect()] == [9]


def test_dedup(spark):
    rows = [(1, "W2", "9", "A", "1", "x", 2024), (2, "W2", "9", "B", "1", "y", 2024), (3, "W2", "", "A", "1", "x", 2024), (4, "W2", None, "A", None, None, 2024), (5, "W2", None, "A", "", None, 2024), (6, "K", "9", "A", "1", "x", 2024), (7, "K", "9", "A", "1", "x", 2024), (8, None, None, None, None, None, None)]
    df = spark.createDataFrame(rows, "record_id int, document_type string, employer_ein string, employer_name string, employee_ssn_last4 string, employee_name string, tax_year int")
    assert sorted(r.record_id for r in M.dedup_w2(df).collect()) == [1, 3, 4, 6, 7, 8]


# --- sanitising -------------------------------------------------------------------------------------------------------


def test_sanitize(spark):
    text = "SSN 123-45-6789 and 123-45-6789, EIN 12-3456789, call (415) 555-1234, lives at 456 Elm St"
    df = spark.createDataFrame([(1, text), (2, None), (3, ""), (4, "nothing")], "doc_id long, text string")
    got = {r.doc_id: r.sanitized for r in Z.sanitize_text(df).collect()}
    elm = "lives at 9282 "  # the house number of the rule; pools follow
    assert got[1].startswith("SSN 987-45-1735 and 987-45-1735, EIN 12-3456789, call (555) 348-5052, " + elm) and got[1].endswith(" 98832")
    assert (got[2], got[3], got[4]) == (None, "", "nothing")
    log = [(r.ord, r.kind, r.original) for r in Z.replacement_log(df).orderBy("doc_id", "ord").collect()]
    assert log == [(0, "ssn", "123-45-6789"), (1, "phone", "(415) 555-1234"), (2, "address", "456 Elm St")]
    with pytest.raises(ValueError):
        Z.sanitize(df, "other")
    with pytest.raises(ValueError):
        Z.sanitize(df, "llm")


def test_sanitize_fields(spark):
    df = spark.createDataFrame([("Ann", "1 Oak St", "XXX-XX-1234", "D", "call 415-555-1234"), (None, "", None, None, None)], "name string, address string, ssn_last4 string, code string, memo string")
    a, b = Z.sanitize_records(df, df.columns).collect()
    assert a.name not in ("Ann", None) and a.address != "1 Oak St" and a.ssn_last4.startswith("XXX-XX-") and a.code == "D" and "415" not in a.memo
    assert tuple(b) == (None, "", None, None, None)
    assert Z.redact_records(spark.createDataFrame([("1 123-45-6789",)], "m string"), ["m"]).first().m == "1 XXX-XX-6789"


def test_model_sanitising(spark):
    from ledgerloom.inference import Rewriter

    df = spark.createDataFrame([("Ann 123-45-6789",), (None,)], "text string")
    up = Rewriter(lambda s: s.replace("Ann", "[NAME]"))
    assert [r.sanitized for r in Z.sanitize(df, "hybrid", backend=up).collect()] == ["[NAME] 987-45-1735", None]


# --- inference --------------------------------------------------------------------------------------------------------


def test_inference(spark):
    from ledgerloom import inference as I

    calls = []

    def backend(prompt, n):
        calls.append(n)
        if "cut" in prompt and n < 150:
            return I.Answer("{", "length", 1, 1)
        if "bad" in prompt and "invalid" not in prompt:
            return I.Answer("no json")
        if "never" in prompt:
            return I.Answer("no json")
        return I.Answer("Sure:\n```json\n" + json.dumps({"p": n}) + "\n```", "stop", 5, 6)

    assert I.ask(backend, "x", 100)[0] == '{"p": 100}'
    assert I.ask(backend, "cut", 100)[0] == '{"p": 150}'
    assert I.ask(backend, "bad", 100)[4] == 1
    assert I.ask(backend, "never", 100)[0] is None and I.ask(backend, "never", 100)[5]

    def stub(prompt, n):
        return I.Answer(json.dumps({"p": prompt}), "stop", 1, 2)

    df = spark.createDataFrame([(1, "a", "W2"), (2, None, "GENERAL_LEDGER"), (3, "b", None)], "id long, prompt string, t string").withColumn("max_tokens", I.token_budget(F.col("t")))
    assert {r.id: r.max_tokens for r in df.collect()} == {1: 2048, 2: 8000, 3: 4096}
    got = {r.id: (r.json, r.error) for r in I.infer(df, stub, ["id"]).collect()}
    assert got == {1: ('{"p": "a"}', None), 2: (None, "empty prompt"), 3: ('{"p": "b"}', None)}


# --- record trees -----------------------------------------------------------------------------------------------------


def test_sanitised_trees(spark):
    import json

    from ledgerloom.functions import hashing as H

    record = {
        "document_type": "call 415-555-1234", "entity": {"name": "Ann", "address": "1 Oak St", "phone": "415-555-1234"}, "rows": ["415-555-1234", {"name": "Ann", "label": "123-45-6789", "ssn_last4": "XXX-XX-1234"}, 5, None, True],
        "name": " ", "address": 7, "123-45-6789": "x 123-45-6789", "description": {"name": "Bob"},
    }
    got, log = Z.sanitized_tree(record)
    phone = H.phone_of("415-555-1234")
    assert got["document_type"] == record["document_type"] and got["name"] == " " and got["address"] == 7 and got["description"] == {"name": "Bob"}
    assert got["entity"] == {"name": H.name_of("Ann"), "address": H.address_of("1 Oak St"), "phone": phone}
    assert got["rows"] == [phone, {"name": H.name_of("Ann"), "label": "123-45-6789", "ssn_last4": "XXX-XX-" + H.ssn_of("XXX-XX-1234")[-4:]}, 5, None, True]
    assert got["123-45-6789"] == "x " + H.ssn_of("123-45-6789")
    assert [x[2] for x in log] == ["name", "address", "phone", "ssn", "ssn"] and list(got) == list(record)
    df = spark.createDataFrame([(json.dumps(record),), ("note " + json.dumps({"name": "Ann"}) + " end",), (None,), ("broken {",)], "data string")
    rows = Z.sanitize_trees(df).collect()
    assert json.loads(rows[0].sanitized) == got and [tuple(r) for r in rows[1].replacements] == [("Ann", H.name_of("Ann"), "name")] and (rows[2].sanitized, rows[3].replacements) == (None, None)
    text = spark.createDataFrame([("Ann Annex Ann",)], "t string").select(Z.apply_replacements(F.col("t"), F.expr("array(named_struct('original', 'Ann', 'replacement', 'X', 'kind', ''), named_struct('original', 'Annex', 'replacement', 'Y', 'kind', ''))")).alias("t"))
    assert text.first().t == "X Y X"


def test_model_sanitising_of_trees(spark):
    from ledgerloom.inference import Rewriter

    df = spark.createDataFrame([(1, '{"name": "Ann", "memo": "of Bob"}'), (2, '{"memo": "fails"}'), (3, None)], "id long, data string")

    def model(text, tokens):
        if "fails" in text:
            raise RuntimeError("down")
        return "Sure: " + text.replace("Bob", "[NAME]")

    up = Rewriter(model, retries=1)
    got = {r.id: r.sanitized for r in Z.sanitize_trees(df, "hybrid", up).collect()}
    assert "[NAME]" in got[1] and "Ann" not in got[1] and got[2] == '{"memo": "fails"}' and got[3] is None
    assert tuple(up.usage.first()) == (2, 1, 1)
    assert "Ann" in {r.id: r.sanitized for r in Z.sanitize_trees(df, "llm", up).collect()}[1]
    for bad in (("llm", None), ("other", up)):
        with pytest.raises(ValueError):
            Z.sanitize_trees(df, *bad)


def test_redaction_leaves_field_names(spark):
    got = Z.redact_records(spark.createDataFrame([('{"123-45-6789": ["123-45-6789", {"a": "12-3456789"}]}',), (None,)], "m string"), ["m"]).collect()
    assert [r.m for r in got] == ['{"123-45-6789": ["XXX-XX-6789", {"a": "12-3456789"}]}', None]


def test_pages_without_a_number_come_last(spark):
    rows = [(1, [(None, "x"), (2, "b"), (None, "y"), (1, None)]), (2, None), (3, [])]
    got = [(r.file_id, r.position, r.page, r.text) for r in S.pages(spark.createDataFrame(rows, "file_id long, pages array<struct<page:int,text:string>>")).orderBy("file_id", "position").collect()]
    assert got == [(1, 0, 1, None), (1, 1, 2, "b"), (1, 2, None, "x"), (1, 3, None, "y")]
    assert S.concat_pages(S.pages(spark.createDataFrame(rows, "file_id long, pages array<struct<page:int,text:string>>"))).first().text == "--- PAGE 2 ---\nb\n--- PAGE ? ---\nx\n--- PAGE ? ---\ny"


def test_table_function_gives_the_same_chunks(spark):
    from ledgerloom.functions import udtf

    udtf.register(spark)
    ledger = "".join(f"\n\n10{i}0-0000 Cash\n{'entry ' * 60}" for i in range(10, 16))
    paged = "".join(f"--- PAGE {i} ---\r\n{'word ' * 40}\n" for i in range(1, 8))
    rows = [(1, ledger, "GENERAL_LEDGER"), (2, paged, None), (3, "x" * 2000, "GENERAL_LEDGER"), (4, "", "A"), (5, None, "A"), (6, ledger, "OTHER"), (7, "short", None), (8, "a\x00b" * 300, None)]
    df = spark.createDataFrame(rows, "id long, text string, document_type string")
    df.createOrReplaceTempView("texts")
    want = sorted(map(tuple, C.chunk(df, "id", max_tokens=100).select("id", "chunk_index", "total_chunks", "text", "account_context", "tier").collect()))
    got = sorted(map(tuple, spark.sql("SELECT id, c.* FROM texts, LATERAL chunk_text(text, document_type, 100) c").collect()))
    assert got == want and {r[5] for r in got} == {"account", "page", "window", "whole"}


def test_answers_are_validated_before_and_after_redaction():
    from ledgerloom import inference as I
    from ledgerloom.operators import validate

    asked = []

    def backend(prompt, tokens):
        asked.append(prompt)
        return I.Answer('{"employer": "x"}' if len(asked) == 1 else '{"employer": {"tin": "123-45-6789"}, "employee": {}}')

    text, _, _, _, retries, error = I.ask(backend, "p", 10, 2, "W2", True)
    assert text == '{"employer": {"tin": "XXX-XX-6789"}, "employee": {}}' and retries == 1 and error is None and "missing employer; missing employee" in asked[1]
    assert I.ask(lambda p, n: I.Answer("{}"), "p", 10, 0, "BALANCE_SHEET")[5] == "missing entity.name" and I.ask(lambda p, n: I.Answer("{}"), "p", 10, 0)[5] is None
    assert all(I.schema_hint(k).startswith("{") for k in ("W2", "1099-B", "K-1 1041", "BALANCE_SHEET", "GENERAL_LEDGER", "RESERVE_ALLOCATION")) and I.schema_hint("X") == ""
    assert validate.problems_of([], "W2") == ["no record"]


def test_statements_are_verified_and_derived(spark):
    import json

    from ledgerloom import pipeline as P
    from ledgerloom.sinks import layouts as L

    acc = lambda n, v: {"account_name": n, "balance": v}
    section = {"section_name": "S", "accounts": [acc("a", "10.00")], "section_total": 10, "subsections": [{"section_name": "T", "accounts": [acc("b", 99)], "section_total": 98}]}
    sheet = {"total_assets": 50, "assets": {"total_assets": 7}, "liabilities": {"total_liabilities": 20}, "equity": {"sections": [section], "total_equity_reported": None, "total_equity": "30.00"}}
    rows = [
        (1, "BALANCE_SHEET", json.dumps(sheet)), (2, "INCOME_STATEMENT", '{"income": {"total": 9}, "total_expenses": 4}'), (3, "INCOME_STATEMENT", '{"income": {"total": 9}}'),
        (4, "RESERVE_ALLOCATION", '{"components": [{"current_balance": 5}, {"current_balance": null}], "bank_accounts": [{"balance": "2"}]}'), (5, "BALANCE_SHEET", None), (6, "BALANCE_SHEET", "{}"),
    ]
    r = spark.createDataFrame(rows, "record_id long, document_type string, data string")
    out = {k: {x.record_id: x for x in d.collect()} for k, d in P.verified(L.parsed(r), r).items() if k != "checks"}
    d = out["derived"]
    assert (d[1].retained_earnings, d[2].net_income, d[3].net_income, d[4].reserve_total, d[4].bank_total, d[6].retained_earnings) == (20, 5, None, 5, 2, 0) and 5 not in d
    assert out["equation"][1].balanced and out["equation"][6].balanced is None
    assert (out["verified"][1].n_checked, out["verified"][1].n_mismatches, out["verified"][1].verified) == (2, 1, False) and out["verified"][3].verified
