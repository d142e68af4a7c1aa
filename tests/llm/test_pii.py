import os

import numpy as np
import pytest

from ledgerloom.llm import pii as P
from ledgerloom.llm import pii_pages

HELD_OUT = os.path.join(os.path.dirname(__file__), "pii_held_out.txt")


@pytest.fixture(scope="module")
def model():
    return P.field()


def _f1(pages, model):
    got = P.find_in([t for t, _ in pages], model)
    out = {}
    for kind in P.KINDS:
        want = {(i, *x) for i, (_, s) in enumerate(pages) for x in s if x[0] == kind}
        have = {(i, *x) for i, s in enumerate(got) for x in s if x[0] == kind}
        out[kind] = 2 * len(want & have) / (len(want) + len(have))
    return out


def test_held_out_accuracy(model, tmp_path):
    """Pages of the maker's other chances, and prose written by hand that shares nothing with its patterns."""
    other = tmp_path / "other.txt"
    other.write_text("\n%%%%\n".join(pii_pages.pages(80, 99)), encoding="utf-8")
    made = _f1(P.labelled(str(other)), model)
    assert all(v > 0.93 for v in made.values()), made
    prose = _f1(P.labelled(HELD_OUT), model)
    assert all(v > 0.85 for v in prose.values()), prose


def test_kept_weights_are_those_of_the_table(model):
    """The table is what the maker gives; another table has other weights; what is kept is loaded bit for bit."""
    with open(P.TABLE, encoding="utf-8") as f:
        assert f.read() == "\n%%%%\n".join(pii_pages.pages())
    assert P.Field.load(P.WEIGHTS, P._key(P.TABLE)) is not None and P.Field.load(P.WEIGHTS, "other") is None


def test_small_table_trains(tmp_path):
    t = tmp_path / "small.txt"
    t.write_text("\n%%%%\n".join(pii_pages.pages(12, 5)), encoding="utf-8")
    small = P.train(P.labelled(str(t)), rounds=30)
    assert [k for k, *_ in P.find_in(["Phone: (555) 555-0100 x12"], small)[0]] == ["PHONE"]
    small.save(str(tmp_path / "w.npz"), "k")
    again = P.Field.load(str(tmp_path / "w.npz"), "k")
    page = P.labelled(str(t))[0][0]
    assert P.find_in([page], again) == P.find_in([page], small)


def test_viterbi_is_the_best_of_all_paths(model):
    """Against the same maximum taken one position at a time for one text alone."""
    texts = ["Employee: Jane Roe   SSN: 912-34-5678", "", "\n", "Tel. (555) 555-0100", "x"]
    t = P.Tokens(texts)
    s, trans = model.scores(t), model.pairs + P._allowed()
    got = model.decode(t, batch=2)
    for i in range(len(texts)):
        at = np.flatnonzero(t.text == i)
        if not len(at):
            continue
        best = s[at[0]] + np.where([x[0] == "I" for x in P.LABELS], -1e4, 0)
        back = []
        for a in at[1:]:
            via = best[:, None] + trans
            back.append(via.argmax(0))
            best = via.max(0) + s[a]
        path = [int(best.argmax())]
        for b in reversed(back):
            path.append(int(b[path[-1]]))
        assert got[at].tolist() == path[::-1]


def test_tokens_cover_the_text():
    text = "Ann O'Hara,\r\n12–14 Élan St.  x9"
    t = P.Tokens([text, "", "é"])
    assert t.words == ["Ann", "O", "'", "Hara", ",", "\r\n", "12", "–", "14", "Élan", "St", ".", "x", "9", "é"]
    assert all(text[a:b] == w for a, b, w in list(zip(t.start, t.end, t.words))[:-1])


def test_ends_of_addresses():
    c = lambda text, piece: (lambda r: text[r[0] : r[1]])(P._checked("ADDRESS", text, text.index(piece), text.index(piece) + len(piece)))
    assert c("lives at 12 Oak Pl..\n", "12 Oak Pl.") == "12 Oak Pl."
    assert c("lives at 12 Oak Street.\n", "12 Oak Street.") == "12 Oak Street"
    assert c("Street address 12 Oak Rd.\n", "12 Oak Rd") == "12 Oak Rd."
    assert c("to 12 Oak Rd., attention", "12 Oak Rd") == "12 Oak Rd."
    assert c("at 12 Oak Rd, Elk, NY 12345.\n", "12 Oak Rd, Elk, NY 12345.") == "12 Oak Rd, Elk, NY 12345"


def test_mask():
    assert P.mask("call Ann at 555.", [("NAME", 5, 8), ("PHONE", 12, 15)]) == "call [NAME] at [PHONE]."


def test_dataframe(spark):
    page = "Recipient's name Robert Sillagarth\nStreet address 5821 Willow Acre Ct. Suite 19, Sageburg, AZ 82675 \nEmployee SSN XXX-XX-0562 (masked)\n"
    rows = [(1, [(0, page), (1, None), (2, "")], "k"), (1, [(0, page)], "k"), (2, None, "k"), (3, [], None), (None, [(None, page)], None), (4, [(5, page * 300)], "x")]
    df = spark.createDataFrame(rows, "file_id long, pages array<struct<page int, text string>>, kind string")
    out = P.find(df).collect()
    ones = sorted((r.kind, r.start_char, r.end_char) for r in out if r.file_id == 1)
    assert ones == sorted(2 * [("NAME", 17, 34), ("ADDRESS", 50, page.index(" \n"))])
    assert len([r for r in out if r.file_id == 4]) == 600 and len([r for r in out if r.file_id is None and r.page is None]) == 2
    masked = {(r.file_id, r.position): r.text for r in P.mask_pages(df).collect()}
    assert masked[1, 0].startswith("Recipient's name [NAME]\nStreet address [ADDRESS] \nEmployee SSN XXX") and masked[1, 1] is None and masked[1, 2] == ""
    assert P.find(df.limit(0)).count() == 0
