import hashlib
import re
from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from ledgerloom.functions import amounts, hashing, patterns, tables, text


def one(spark, value, expr, kind="string"):
    return spark.createDataFrame([(value,)], f"x {kind}").select(expr(F.col("x")).alias("y")).first().y


@pytest.mark.parametrize(
    "value,want",
    [("1,234.56", "1234.56"), ("(5.00)", "-5.00"), ("5.00-", "-5.00"), ("$1,000", "1000"), ("***", None), ("-", None), ("N/A", None), ("", None), (None, None), ("(-5)", "5"), ("12x", None), (" 7.5 ", "7.5"), ("(1,041.90)-", "-1041.90")],
)
def test_parse_amount(spark, value, want):
    assert one(spark, value, amounts.parse_amount) == (None if want is None else Decimal(want))


def test_required_literals():
    wanted = {
        r"nonemployee\s+compensation": (("compensation",), ("nonemployee",)),
        r"form\s+w-?2\b": (("form",),),
        r"(?:ytd|year.to.date)\s+(?:actual|budget)": (("actual", "budget"),),
        r"(?:ytd|x)\s+b": (),
        r"abc|bcd": (("abc", "bcd"),),
        r"soc(?:ial)?x*": (("soc",),),
        r"(?:abc)+d{0,2}(?!xyz)": (("abc",),),
        r"net\s+benefits\s+for\s+\d{4}": (("benefits",), ("for",), ("net",)),
    }
    for p, want in wanted.items():
        assert sorted(patterns.required(p)) == sorted(want), p
    texts = ["form w2 2024", "ytd  actual", "year to date budget", "1099-nec", "total assets", ""]
    for p in [p for _, _, p in tables.TAX_SIGNATURES] + [p for _, ps in tables.FINANCIAL_SIGNATURES for p in ps]:
        for t in texts:
            assert not re.search(p, t) or all(any(x in t for x in g) for g in patterns.required(p)), (p, t)


@pytest.mark.parametrize("seed", ["123-45-6789", "(415) 555-1234", "456 Elm St", "", "ñ"])
def test_replacements_match_the_rule(spark, seed):
    h = int(hashlib.md5(seed.encode()).hexdigest(), 16)
    pick = lambda pool, k: pool[int(hashlib.md5(f"{seed}{k}".encode()).hexdigest(), 16) % len(pool)]
    assert one(spark, seed, hashing.fake_ssn) == f"{900 + h % 99:03d}-{(h >> 8) % 99 + 1:02d}-{(h >> 16) % 9999 + 1:04d}"
    assert one(spark, seed, hashing.fake_phone) == f"(555) {h % 900 + 100:03d}-{(h >> 12) % 10000:04d}"
    assert one(spark, seed, hashing.fake_address) == f"{h % 9999 + 1} {pick(tables.STREETS, 0)}, {pick(tables.CITIES, 1)}, {pick(tables.STATES, 2)} {h % 90000 + 10000}"
    assert one(spark, seed, hashing.fake_name) == f"{pick(tables.FIRST_NAMES, 0)} {pick(tables.LAST_NAMES, 1)}"
    assert one(spark, seed, hashing.fake_account_number) == str(h % 10 ** (h % 6 + 6)).zfill(h % 6 + 6)


def test_known_vector(spark):
    assert one(spark, "123-45-6789", hashing.fake_ssn) == "987-45-1735" and one(spark, "(415) 555-1234", hashing.fake_phone) == "(555) 348-5052"


def test_text(spark):
    assert one(spark, "Form W-2 2024 wages", text.tax_year) == 2024
    assert one(spark, "year 1999, then 2050 and 2021", text.tax_year) == 2021
    assert one(spark, "none", text.tax_year) is None
    assert one(spark, '```json\n{"a":1}\n```', text.strip_fence) == '{"a":1}'
    assert one(spark, "123-45-6789 and 12-3456789", text.redact_ssn) == "XXX-XX-6789 and 12-3456789"
    assert one(spark, "OMB No. 1545-0008 VOID  a  b ", text.meaningful_length) == 3
    assert one(spark, None, text.meaningful_length) == 0 and one(spark, None, text.word_density) is None
    assert one(spark, "ab\u0001\n", text.nonprintable_ratio) == 0.25
    assert one(spark, 0.125, text.percent_text, "double") == "12%"
    assert one(spark, 1234.5, amounts.money_text, "double") == "1234.50" and one(spark, "x", amounts.money_text) == "x" and one(spark, "x", amounts.import_money_text) == "0.00"


@pytest.mark.parametrize("seed", ["123-45-6789", "(415) 555-1234", "456 Elm St", "", "ñ"])
def test_single_texts_have_the_same_replacements(spark, seed):
    for column, text in ((hashing.fake_ssn, hashing.ssn_of), (hashing.fake_phone, hashing.phone_of), (hashing.fake_name, hashing.name_of), (hashing.fake_address, hashing.address_of)):
        assert one(spark, seed, column) == text(seed)
