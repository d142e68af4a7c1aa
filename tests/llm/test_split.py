import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from ledgerloom.llm import split as S


@settings(max_examples=100, deadline=None)
@given(st.lists(st.integers(1, 6), min_size=1, max_size=80), st.integers(0, 300), st.integers(0, 300))
def test_range_maximum_is_brute_force(strength, lo, hi):
    pos = np.cumsum(np.arange(len(strength)) % 4 + 1)
    got = S.Cuts(pos, np.array(strength, np.int8)).strongest(lo, hi)
    inside = [(v, p) for v, p in zip(strength, pos.tolist()) if lo <= p <= hi]
    assert got == (max(inside)[1] if inside else None)


@settings(max_examples=100, deadline=None)
@given(st.lists(st.integers(1, 7), max_size=80), st.integers(1, 8))
def test_cuts_of_a_strength_are_all_found(strength, least):
    pos = np.cumsum(np.arange(len(strength)) % 4 + 1)
    assert S.Cuts(pos, np.array(strength, np.int8)).all_of(least) == [p for v, p in zip(strength, pos.tolist()) if v >= least]


def test_evidence_outweighs_a_title():
    """An account numbered like a year, named like a report: a balance and a total of its own make it one."""
    entry = "01/02/2020  Check  1  Somebody  1.00  2.00\n"
    title, account = "2024 Annual Report Costs\n", "2024 Annual Report Costs   Beginning Balance  5.00\n"
    assert S.headings(title + entry) == [] == S.headings(account + entry)
    assert [h[1:] for h in S.headings(account + entry + "Total 2024-0000 Annual Report Costs   6.00\n")] == [("2024 Annual Report Costs", S.HEADING)]
    assert S.split_text("2010 Receivables\n" + entry, 10, 0, None, True)[1] == [0]


@settings(max_examples=150, deadline=None)
@given(st.text(alphabet="ab. \n\r\té‍", max_size=300), st.integers(1, 60), st.integers(0, 70))
def test_pieces_rebuild_the_text(text, limit, overlap):
    parts, _ = S.split_text(text, limit, overlap)
    lap = min(overlap, limit - 1)
    assert parts[0][0] == 0 and parts[-1][1] == len(text)
    assert all(0 <= e - s <= limit for s, e, _ in parts)
    for (_, e, _), (s2, e2, _) in zip(parts, parts[1:]):
        assert s2 == e - lap and e2 > e
    assert "".join(text[s + (lap if i else 0) : e] for i, (s, e, _) in enumerate(parts)) == text


def test_endless_line():
    parts, _ = S.split_text("x" * 5000, 1400, 140)
    assert [(s, e) for s, e, _ in parts] == [(0, 1400), (1260, 2660), (2520, 3920), (3780, 5000)]


HEADS = [
    "1010-0000 OPERATING CASH",
    "[1020-0000] RESERVE MONEY MARKET   Beginning Balance  50,911.92",
    "1500 Equipment - Selacote Quarry Painting and Drywall consolidated property holding and tenant improvements, phase 5",
    "GL1200 Accounts Receivable (Ledger)",
    "Account: 1010-0000 - Operating Cash",
    "Acct No. 1010-0000\tOperating Cash",
    "1310.00 · Prepaid Insurance",
    "*** 6110-0000  Landscape Contract ***   Beginning Balance  $59.32",
    "Accounts Receivable (1200-0000)",
    "\f2300 Payroll Liabilities",
]
OTHERS = [
    "Total 1010-0000 Operating Cash  393.34",
    "Ending Balance 1020-0000 Reserve Money Market  80,252.97",
    "39635 Lanidon Copper Engineering  1,088,152.10",
    "9727 Lorenbridge Valley Community Bank $875.01",
    "2025 Annual Report Balileigh Pioneer Real Estate Partners",
    "REF-8946 Reclass to 6500-0000 71,119.21",
    "01/12/2022  Invoice  51704  Garormore Compass  365.49  18,033.44-",
    "  Beginning Balance 31,624.31",
    "--- PAGE BREAK ---",
    "2024 January through December",
    "2021 Fiscal Year",
    "General Ledger",
    "      memo: Bank confirmation 217928 agrees to $4,955.53, less outstanding items of 92,605.30.",
]
MORE = ["1010-0000 OPERATING CASH (cont.)", "Acct No. 2010-0000\tAccounts Payable – Contd", "GL6010 Electricity (Ledger) - Continued", "Operating Cash (1010-0000) (continued)"]


@pytest.mark.parametrize("end", ["\n", "\r\n", "\r"])
def test_headings(end):
    lines = [x for t in zip(HEADS, OTHERS) for x in t] + OTHERS[len(HEADS) :] + MORE
    text = end.join(lines)
    found = S.headings(text)
    assert [h for _, h, m in found if m == S.HEADING] == [h.lstrip("\f").split("   Beginning")[0] for h in HEADS]
    assert sum(m == S.CARRIED for _, _, m in found) == len(MORE)
    for s, h, _ in found:
        assert text[s:].startswith(h)


def test_prefers_the_stronger_cut_and_carries_the_account():
    body = "".join(f"01/02/2020  Check  {i}  Somebody  1.00  2.00\n" for i in range(20))
    text = "1010-0000 CASH\n" + body + "\n1020-0000 RESERVE\n" + body * 2
    parts, begun = S.split_text(text, 1000, 100, None, True)
    assert parts[0][1] == text.index("1020-0000") and parts[0][2] == "1010-0000 CASH"
    assert parts[1][2] == "1010-0000 CASH" and parts[-1][2] == "1020-0000 RESERVE"
    assert begun == [0, text.index("1020-0000")]


def test_missing_context_comes_from_the_text():
    assert S.split_text("x  1.00\n1010 Cash (cont.)\ny", 99, 0, None, True)[0][0][2] == "1010 Cash"
    assert S.split_text("x  1.00\nTotal for 1010-0000 Operating Cash  5.00\n", 99, 0, None, True)[0][0][2] == "1010-0000 Operating Cash"
    assert S.split_text("x  1.00\n1010 Cash\n", 99, 0, None, True)[0][0][2] is None
    assert S.split_text("x", 99, 0, "given", True)[0][0][2] == "given"


def test_dataframe(spark):
    gl, text = "GENERAL_LEDGER", "1010 Cash\nentry  1.00\n" * 20
    rows = [(1, gl, 50, 5, text, None, "x"), (1, gl, 50, 5, text, None, "x"), (2, gl, 50, None, None, None, "x"), (3, None, None, 5, "t", None, "x"), (4, "K-1", 50, 80, "w" * 200, "c", None), (5, gl, 50, 5, "", None, None), (None, gl, 9999, 0, text, None, None)]
    df = spark.createDataFrame(rows, "chunk_id long, document_type string, max_chars int, overlap_chars int, text string, account_context string, piece_no string")
    out = S.split_oversized(df).collect()
    by = {}
    for r in out:
        by.setdefault(r.chunk_id, []).append(r)
    assert set(by) == {1, 4, 5, None} and len(by[5]) == 1 and len(by[None]) == 1
    assert all(len(r.text) <= 50 and r.text == (text if r.chunk_id in (1, None) else "w" * 200)[r.start_char : r.end_char] for r in out if r.chunk_id in (1, 4))
    assert sorted(r.start_char for r in S.account_blocks(df).collect()) == sorted(2 * list(range(0, len(text), 22)))
    assert S.split_oversized(df.limit(0)).count() == 0


def test_whole_table(spark, sf):
    df = spark.read.parquet(f"{sf}/chunks.parquet")
    src = {r.chunk_id: r for r in df.collect() if r.text is not None}
    out = S.split_oversized(df).collect()
    assert {r.chunk_id for r in out} == set(src)
    for r in out:
        assert r.end_char - r.start_char <= max(src[r.chunk_id].max_chars, 0) and r.text == src[r.chunk_id].text[r.start_char : r.end_char]


def test_accounts_with_the_word_report():
    text = "6120-00 Credit Report Fees\nx 1.00\n2010 Credit Report Fees\n6130-00 Office\n2023 Annual Report of the Board\n2023 Quarterly Financial Report\n2023 Report\n"
    assert [h for _, h, _ in S.headings(text)] == ["6120-00 Credit Report Fees", "2010 Credit Report Fees", "6130-00 Office"]
