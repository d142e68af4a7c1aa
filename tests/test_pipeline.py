import json

from ledgerloom import __main__ as cli
from ledgerloom import pipeline as P
from ledgerloom.inference import Answer
from ledgerloom.operators import merging as M

W2 = {"tax_year": 2024, "employer": {"name": "Acme", "ein": "1"}, "employee": {"name": "Ann", "ssn_last4": "1234"}, "note": "123-45-6789"}
BS = {"assets": {"sections": [{"section_name": "Cash", "accounts": [{"account_name": "a", "balance": 5}], "section_total": 6}]}}


def stub():
    """Made here, so that workers get it by value."""
    bs, w2 = json.dumps(BS), json.dumps(W2)

    def backend(prompt, tokens):
        if "Balance Sheet" in prompt:
            return Answer(bs, "stop", 2, 3)
        if "W-2" in prompt:
            return Answer("```json\n" + w2 + "\n```", "stop", 2, 3)
        raise RuntimeError("no such page")

    return backend


def files(spark):
    rows = [(1, [(1, "Form W-2 Wage and Tax Statement"), (2, "Balance Sheet\nTotal assets")]), (2, [(1, "hello there")]), (3, None), (4, [(1, " ")])]
    return spark.createDataFrame(rows, "file_id long, pages array<struct<page:int,text:string>>")


def test_extract(spark):
    out = P.extract(files(spark), stub(), P.Options(hints={"W2": "Mind box 12."}))
    parts = {(r.file_id, r.section_no): r for r in out["partials"].collect()}
    assert set(parts) == {(1, 0), (1, 1), (2, 0)} and parts[2, 0].error.startswith("RuntimeError") and parts[1, 0].family == "tax"
    rec = {r.document_type: r for r in out["records"].collect()}
    assert set(rec) == {"W2", "BALANCE_SHEET"} and "XXX-XX-6789" in rec["W2"].data and rec["W2"].tax_year == 2024 and rec["BALANCE_SHEET"].tax_year is None
    assert [r.matches for r in out["checks"].collect()] == [False]
    assert sum(r.calls for r in out["usage"].collect()) == 3


def long_stub():
    def backend(prompt, tokens):
        import json as j

        from ledgerloom.inference import Answer as A

        if "never" in prompt:
            return A("no json", "stop", 1, 1)
        n = int(prompt.split("[chunk ")[1].split()[0])
        if "General Ledger" in prompt or "GENERAL_LEDGER" in prompt:
            acc = {"account_number": "1010", "account_name": "Cash", "beginning_balance": 5 if n == 1 else 9, "transactions": [{"n": n}], "ending_balance": n if n < 3 else None}
            return A(j.dumps({"entity": {"name": None if n == 1 else f"E{n}"}, "accounts": [acc, {"account_number": f"2{n}", "transactions": [{"n": n}]}], "metadata": {"notes": ["x", f"n{n}"], "is_void": n == 2}}))
        cash = {"section_name": "Cash", "accounts": [{"account_name": f"a{n}", "balance": n}], "section_total": 3 if n == 2 else None}
        return A(j.dumps({"assets": {"sections": [cash], "total_assets": 3 if n == 2 else None}}))

    return backend


def test_partials_of_a_section_are_one_record(spark):
    ledger = "General Ledger\n\n" + "".join(f"10{i}0-0000 Cash\n{'entry ' * 50}\n\n" for i in range(10, 13))
    rows = [(1, [(1, ledger)]), (2, [(1, "Balance Sheet\nTotal assets\n" + "w " * 200)]), (3, [(1, "Balance Sheet never\n" + "never " * 90)])]
    out = P.extract(spark.createDataFrame(rows, "file_id long, pages array<struct<page:int,text:string>>"), long_stub(), P.Options(max_input_tokens=100, retries=0))
    n = {r.file_id: r["count"] for r in out["partials"].groupBy("file_id").count().collect()}
    rec = {r.file_id: r for r in out["records"].collect()}
    assert n[1] > 2 and n[2] == 2 and n[3] > 1 and out["records"].count() == 3
    got = json.loads(rec[1].data)
    numbers = list(range(1, n[1] + 1))
    assert got["entity"] == {"name": "E2"} and got["metadata"] == {"notes": ["x", *(f"n{i}" for i in numbers)], "is_void": True}
    assert [a["account_number"] for a in got["accounts"]] == ["1010", *(f"2{i}" for i in numbers)] and (rec[1].n_parts, rec[1].total_chunks) == (n[1], n[1])
    assert got["accounts"][0] == {"account_number": "1010", "account_name": "Cash", "beginning_balance": 5, "transactions": [{"n": i} for i in numbers], "ending_balance": 2}
    assert json.loads(rec[2].data)["assets"]["total_assets"] == 3 and [(r.reported, r.matches) for r in out["checks"].collect()] == [(3, True)]
    assert [(r.file_id, r.entity_name, r.calls) for r in out["failed"].collect()] == [(3, "EXTRACTION FAILED", n[3])]
    assert json.loads(rec[3].data)["entity"]["name"] == "EXTRACTION FAILED" and rec[3].n_parts == 0


def test_fold():
    sub = lambda t, *a: {"section_name": "S", "section_total": None, "subsections": [{"section_name": "T", "accounts": list(a), "section_total": t}]}
    got = M.fold([{"assets": {"sections": [sub(None, 1)]}}, {"assets": {"sections": [sub(4, 2), {"section_name": "U"}], "total": 9}}], "BALANCE_SHEET")
    assert got == {"assets": {"sections": [{"section_name": "S", "section_total": None, "subsections": [{"section_name": "T", "accounts": [1, 2], "section_total": 4}]}, {"section_name": "U"}], "total": 9}}
    line = lambda n, v: {"account_number": n, "account_name": "a", "values": v}
    got = M.fold([{"columns": [], "line_items": [line("1", 1)]}, {"columns": ["Q"], "line_items": [line("1", 2), line("2", 3)], "net": 7}], "BUDGET_VS_ACTUAL")
    assert got == {"columns": ["Q"], "line_items": [line("1", 1), line("2", 3)], "net": 7}
    assert M.fold([{"rows": [1], "total": None}, {"rows": [2], "total": 3}], "TRIAL_BALANCE") == {"rows": [1, 2], "total": 3}
    assert M.fold([{"accounts": None}, {"accounts": {"account_name": "a"}, "entity": "x", "metadata": None}, {"accounts": [{"account_name": "a"}, "t"]}], "GENERAL_LEDGER") == {"accounts": [{"account_name": "a"}, "t"], "entity": "x", "metadata": {}}


def test_detect_and_boundaries(spark):
    assert {r.file_id: r.document_type for r in P.detect(files(spark)).collect()} == {1: "W2", 2: "UNKNOWN"}
    assert P.boundaries(files(spark)).count() == 4
    assert "csv" in P.capabilities()["formats"]


def test_command_line(spark, tmp_path, capsys):
    src = str(tmp_path / "files")
    files(spark).write.parquet(src)
    for what in ("detect", "boundaries", "sanitize"):
        assert cli.main([what, src, str(tmp_path / what)]) == 0
    assert spark.read.parquet(str(tmp_path / "detect")).count() == 2
    assert cli.main(["capabilities"]) == 0 and "formats" in capsys.readouterr().out


def test_extract_and_batch_on_the_command_line(spark, tmp_path, capsys):
    src = str(tmp_path / "files")
    files(spark).write.parquet(src)
    backend = ["--backend", "tests.stub_backend:answer", "--retries", "0"]
    assert cli.main(["extract", src, str(tmp_path / "out"), *backend]) == 0
    read = lambda name: spark.read.parquet(str(tmp_path / name))
    assert [(r.document_type, r.tax_year) for r in read("out/records").collect()] == [("BALANCE_SHEET", 2023)] and read("out/partials").count() == 3
    assert [r.verified for r in read("out/verified").collect()] == [True]
    folder = tmp_path / "pdf"
    folder.mkdir()
    text = "Balance Sheet\n" + "Total assets " * 10
    for name, content in (("a.pdf", text.encode()), ("bad.pdf", b"bad"), ("blank.pdf", b" "), ("note.txt", b"x")):
        (folder / name).write_bytes(content)
    args = ["batch", str(folder), str(tmp_path / "batch"), "--reader", "stub-pages", "--plugin", "tests.stub_backend", *backend, "--no-verify", "--format", "csv"]
    assert cli.main(args) == 0
    assert sorted((r.path.rsplit("/", 1)[1], r.error) for r in read("batch/errors").collect()) == [("bad.pdf", "ValueError: unreadable"), ("blank.pdf", "no text")]
    csv = spark.read.option("header", True).csv(str(tmp_path / "batch" / "csv" / "accounts")).collect()
    assert [(r.row_type, r.account_name, r.balance) for r in csv] == [("account", "a", "5.00"), ("subtotal", "Total Cash", "5.00"), ("total", "Total Assets", "5.00")]
    records = str(tmp_path / "records")
    P.formattable(read("out/records")).write.parquet(records)
    assert cli.main(["verify", records, str(tmp_path / "v")]) == 0 and read("v/checks").first().matches
    assert cli.main(["sanitize-records", records, str(tmp_path / "s")]) == 0 and json.loads(read("s").first().sanitized)["entity"]["name"] != "E"
    assert cli.main([*args[:3], "--reader", "nobody", *backend]) == 1 and "nobody" in capsys.readouterr().err
