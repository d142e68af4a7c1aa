from pyspark.sql import functions as F

from ledgerloom.operators import classify as C

TEXTS = {
    "w2": ("Form W-2 Wage and Tax Statement 2025\nSocial security wages\n123-45-6789 123-45-6789 123-45-6789 123-45-6789", "W2"),
    "nec": ("Form 1099-NEC Nonemployee compensation 1099-MISC", "1099-NEC"),
    "misc": ("Form 1099-MISC Box 1 Rents", "1099-MISC"),
    "t": ("Form 1098-T Tuition Statement", "1098-T"),
    "m": ("Form 1098 Mortgage Interest Statement", "1098"),
    "k": ("Schedule K-1 (Form 1065) Partner's Share of Income beneficiary's share of income", "K-1 1065"),
    "invoice": ("Invoice 5, thank you", "UNKNOWN"),
    "null": (None, "UNKNOWN"),
    "bs": ("Balance Sheet\nTotal assets\nCurrent assets", "BALANCE_SHEET"),
    "cmp": ("Total income total expenses net income Jan - Dec 25 $ Change", "INCOME_STATEMENT_COMPARISON"),
}


def detected(spark, fn):
    df = spark.createDataFrame([(k, t) for k, (t, _) in TEXTS.items()], "id string, text string")
    return {r.id: r for r in fn(df).collect()}


def test_detect(spark):
    got = detected(spark, C.detect)
    assert {k: r.document_type for k, r in got.items()} == {k: w for k, (_, w) in TEXTS.items()}
    assert got["w2"].estimated_record_count == 1 and got["w2"].tax_year == 2025 and got["w2"].confidence == 1.0
    assert got["bs"].confidence == 0.8 and got["bs"].document_family == "financial_simple" and got["null"].confidence == 0.0


def test_scores_and_notes(spark):
    got = detected(spark, C.detect_tax)
    k = {s["type"]: s["score"] for s in got["k"].scores}
    assert k["K-1 1065"] == 1.0 and k["K-1 1041"] == 0.0
    assert "1099-MISC" not in {s["type"] for s in got["nec"].scores}
    assert got["invoice"].notes == [] and got["null"].scores == []


def test_routing(spark):
    got = detected(spark, C.route_family)
    assert got["w2"].family == "tax" and got["invoice"].family == "tax" and got["cmp"].family == "financial_multicolumn"
    df = spark.createDataFrame([("x", None)], "id string, text string")
    assert C.route_family(df, "financial_reserve").first().family == "financial_reserve"


def test_keywords(spark):
    df = spark.createDataFrame([("Form W-2 wage and tax statement; 1098-T tuition statement 1098",), (None,), ("",)], "text string")
    assert [r[0] for r in df.select(C.keyword_types(F.col("text"))).collect()] == [["W2", "1098-T"], [], []]


def test_strategy(spark):
    rows = [(1, 0, "x"), (2, 0, "total balance account " * 30), (3, 0, "qqq zzz " * 60), (4, 0, "total balance" + " " * 60 + "." * 99), (5, 0, "\u0001" * 60 + "a" * 100), (6, 0, None)]
    got = {r.file_id: r.strategy for r in C.strategy(spark.createDataFrame(rows, "file_id long, position int, text string")).collect()}
    assert got == {1: "ocr", 2: "text", 3: "ocr", 4: "pdfplumber", 5: "ocr", 6: "ocr"}
