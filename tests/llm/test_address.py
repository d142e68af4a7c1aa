import pytest

from ledgerloom.llm import address as A
from ledgerloom.llm import strings

FULL = dict(number="4743", point="", street="lower ridge", kind="road", unit="5C", city="copperview", state="co", zip="20047", box="")


@pytest.mark.parametrize(
    "text",
    [
        "4743 Lower Ridge Road Apt 5C\nCopperview, CO 20047",
        "Apt. 5C, 4743 LOWER RIDGE RD; COPPERVIEW; COLORADO; 20047-1234, USA",
        "20047 Copperview, CO - 4743 Lower Ridge Rd. #5C",
        "C/O Walter, 4743 lower ridge road #5C, copperview co 2OO47.",
        "Copperview CO 20047, 4743  Lower  Ridge  Rd,  No. 5C",
    ],
)
def test_orders_and_forms(text):
    assert A.parse(text) == FULL


def test_parts():
    p = A.parse("6059 No. 21st Ct, Ottergrove FL")
    assert (p["number"], p["point"], p["street"], p["kind"], p["unit"]) == ("6059", "n", "21", "court", "")
    assert A.parse("4876 S. Third Way, Ashbrook")["street"] == A.parse("Ashbrook 05311, 4876 So. 3rd Wy")["street"] == "3"
    assert A.parse("2048 CHESTNUT BLVD. S, TIMBERPORT")["point"] == "s" and A.parse("515 S.E. Lantern Mill Pl")["point"] == "se"
    assert A.parse("Granitereach, OR 40309-5719, Box 169897")["box"] == A.parse("P O Box 169897, Granitereach")["box"] == "169897"
    assert A.parse("2384 Orchard Creek, Ferncrest FL")["kind"] == ""
    for t in (None, "", " ", "N/A", "same as above", "on file", "unknown", "Copperview, CO 20047"):
        assert A.parse(t) is None


def cost(a, b):
    return A.cost(A.parse(a), A.parse(b))


def test_vetoes_and_typos():
    base = "4743 Lower Ridge Road Apt 5C, Copperview, CO 20047"
    assert cost(base, "4743 Lowr Rigde Rd Unit 5c Coperview CO 20074") is not None
    assert cost(base, "4743 Lower Ridge #5C, CO") is not None
    for other in (
        "4742 Lower Ridge Road Apt 5C, Copperview, CO 20047",
        "4743 N Lower Ridge Road Apt 5C, Copperview, CO 20047",
        "4743 Lower Ridge Road Apt 5D, Copperview, CO 20047",
        "4743 Lower Ridge Road, Copperview, CO 20047",
        "4743 Lower Ridge Lane Apt 5C, Copperview, CO 20047",
        "4743 Amber Creek Road Apt 5C, Copperview, CO 20047",
        "4743 Lower Ridge Road Apt 5C, Elkmead, NY 11111",
    ):
        assert cost(base, other) is None


def test_assignment_is_the_best_of_all():
    from itertools import permutations

    from ledgerloom.llm.strings import assign, distance

    a, b = ["alpha", "beta", "gamma"], ["gama", "alpah", "betta"]
    c = lambda x, y: 9 if y is None else distance(x, y, 5)
    assert assign(a, b, c) == min(sum(c(x, y) for x, y in zip(a, p)) for p in permutations(b)) == 3
    assert assign(a[:2], b, c) == 2 + 9


def test_pairs(spark):
    rows = [
        (1, "12 Oak St Apt 1, Elkmead, NY 11111", "x"),
        (2, "Elkmead NY 11111, 12 Oak Street #1", "x"),
        (2, "Elkmead NY 11111, 12 Oak Street #1", "x"),
        (3, "12 Oka St Unit 1; Elkmead", "x"),
        (4, "12 Oak St Apt 2, Elkmead, NY 11111", "x"),
        (5, None, "x"),
        (6, "N/A", None),
        (7, "PO Box 77, Elkmead", None),
        (8, "Elkmead NY 11111, P.O. Box 77", None),
        (9, "12 Oak Ave Apt 1, Elkmead, NY 11111", None),
        (10, "12 Oak Apt 1, NY 11111", None),
        (None, "12 Oak St Apt 1, Elkmead, NY 11111", None),
        (11, "x" * 20000, None),
    ]
    df = spark.createDataFrame(rows, "party_id long, address string, location_id string")
    got = {tuple(r) for r in A.same_location(df).collect()}
    assert got == {(1, 2), (1, 3), (2, 3), (1, 10), (2, 10), (3, 10), (7, 8)}
    assert A.same_location(df.limit(0)).count() == 0


def test_same_as_all_against_all(spark, sf):
    """Whole forms against brute force over every pair of forms."""
    df = spark.read.parquet(f"{sf}/parties.parquet")
    loc = {r.address: r.location_id for r in A.locations(df.select("address")).collect()}
    read = {a: A.parse(a) for a in loc}
    whole = [a for a, p in read.items() if (p["box"] or p["kind"]) and (p["zip"] or p["city"])]
    near = 0
    for i, a in enumerate(whole):
        for b in whole[i + 1 :]:
            if A.cost(read[a], read[b]) is not None:
                near += 1
                assert loc[a] == loc[b], (a, b)
    assert near > 10


def test_units_with_any_designator_are_vetoes():
    base = "12 Oak St{}, Elkmead, NY 11111"
    units = ["", " Floor 3", " Fl 4", ", 5th Floor", " Bldg 3", " Building 4", " Lot 3", " Bldg 3 Apt 5", ", Bsmt", " Apt 3"]
    for i, u in enumerate(units):
        for v in units[i + 1 :]:
            assert cost(base.format(u), base.format(v)) is None, (u, v)
    assert cost(base.format(" Floor 3"), base.format(", 3rd Fl.")) == 0 and cost(base.format(" Bldg. 3, #5"), base.format(" Apt 5, Building 3")) == 0
    assert A.parse("Larkholm FL 12 Timber Bend Pl")["unit"] == A.parse("Graniteport FL 3816O 816 East Fallen Oak Wy")["unit"] == ""


def test_assignment_of_many_parts_is_exact():
    import random
    from itertools import permutations

    from ledgerloom.llm.strings import assign, distance, joined_cost

    rnd = random.Random(5)
    c = lambda x, y: 9.0 if y is None or distance(x, y, 2) > 2 else float(distance(x, y, 2))
    word = lambda n: "".join(rnd.choice("ab") for _ in range(rnd.randint(2, n)))
    for n in (3, 5, 6, 8):
        for _ in range(40 if n < 8 else 4):
            a, b = [word(5) for _ in range(n)], [word(5) for _ in range(n)]
            b[: n // 2] = a[: n // 2]
            assert assign(a, b, c) == min(sum(c(x, y) for x, y in zip(a, p)) for p in permutations(b))
    long = [f"w{i:05d}" for i in range(2000)]
    assert assign(long, [*reversed(long[1:]), "w0000"], c) == 1
    assert joined_cost("alderbirhcedardogwoodelm", ["elm", "dogwood", "cedar", "birch", "alder"], 1) == 1
    assert joined_cost("alderbirchcedardogwood", ["oak", "dogwood", "cedar", "birch"], 2) == 3 and joined_cost("a" * 40, ["a"] * 40, 1) == 0


def test_index_reaches_what_is_accepted(spark):
    """Random spellings of one street and city: every pair that the comparison accepts shares a key."""
    import random

    rnd = random.Random(3)

    def typo(w):
        w, i = list(w), rnd.randrange(len(w) - 1)
        kind = rnd.randrange(4)
        w[i : i + 2] = [[w[i + 1], w[i]], [w[i + 1]], [w[i], "q", w[i + 1]], ["q", w[i + 1]]][kind]
        return "".join(w)

    texts = set()
    for k in range(400):
        words = ["hidden", "lantern"] if k % 3 else ["lorancombe"]
        words = [typo(w) if rnd.random() < 0.7 else w for w in words]
        city = "copperview" if k % 2 else "elkmead"
        for _ in range(rnd.randrange(3)):
            city = typo(city)
        where = [f"{city}, NY 11111", f"{city} NY", "NY 11111", city, "NY 11101", ""][rnd.randrange(6)]
        texts.add(f"12 {' '.join(words)} St, {where}")
    df = spark.createDataFrame([(t,) for t in sorted(texts)], "address string")
    forms = A.read(df).select("form_id", *A.FIELDS).distinct()
    near = {tuple(r) for r in A.candidates(forms).collect()}
    rows = {r.form_id: r.asDict() for r in forms.collect()}
    lone = lambda x: bool(x["zip"]) != bool(x["city"])
    wanted = {(a, b) for a in rows for b in rows if a < b and A.cost(rows[a], rows[b]) is not None and not (lone(rows[a]) and lone(rows[b]) and bool(rows[a]["zip"]) != bool(rows[b]["zip"]))}
    assert len(wanted) > 1000 and wanted <= near


def test_chains_do_not_drift(spark):
    """Each step is two edits of the city: neighbours fit, the ends don't, and no centre has both."""
    steps = ["Copperview", "Coppervi", "Copperqqvi", "Copqqperqqvi"]
    rows = [(i, f"12 Oak St, {c}, NY") for i, c in enumerate(steps, 1)] + [(9, "12 Oak Street, Copperview, NY")]
    got = {tuple(r) for r in A.same_location(spark.createDataFrame(rows, "party_id long, address string")).collect()}
    assert (1, 9) in got and got & {(1, 2), (2, 3), (3, 4)} and (1, 4) not in got


def test_nothing_is_broadcast_by_the_driver(spark, monkeypatch):
    """Broadcast tables lie in the driver's memory and these grow with the rows: no written table and no result joins by one."""
    plans = []

    class Seen(A.Written):
        def __init__(self, df, name="t", **counts):
            plans.append((name, df._jdf.queryExecution().executedPlan().toString()))
            super().__init__(df, name, **counts)

    monkeypatch.setattr(A, "Written", Seen)
    monkeypatch.setattr(strings, "Written", Seen)
    steps = ["Copperview", "Coppervi", "Copperqqvi", "Copqqperqqvi"]
    rows = [(i, f"12 Oak St, {c}, NY") for i, c in enumerate(steps, 1)] + [(9, "12 Oak Street, Copperview, NY"), (10, "12 Oak, Copperview NY 11111"), (11, "7 Elm")]
    found = A.same_location(spark.createDataFrame(rows, "party_id long, address string"))
    assert (1, 9) in {tuple(r) for r in found.collect()}
    plans.append(("found", found._jdf.queryExecution().executedPlan().toString()))
    assert int(spark.conf.get("spark.sql.autoBroadcastJoinThreshold").rstrip("b")) > 0
    assert [n for n, p in plans if "BroadcastHashJoin" in p or "BroadcastNestedLoopJoin" in p] == []
    assert {"marked", "labels", "off", "kept", "placed"} <= {n for n, _ in plans}
