from ledgerloom.llm import names as N
from ledgerloom.llm.strings import components, distance


def test_persons():
    assert N.person("Lorancombe, Bill S.") == N.person("MR. Bill S LORANCOMBE") == dict(first="bill", mid="s", last="lorancombe", suffix="")
    assert N.person("jorloton benjamin u.")["last"] == "jorloton" and N.person("OliverJorloton") == N.person("OLIVERJORLOTON") == N.person("Oliver Jorloton")
    assert N.person("Calarbridge Sr, Pete") == N.person("Pete Calarbridge, SR") and N.person("Falimcroft Sr C")["first"] == "c"
    assert N.given("bill") == ("william",) and N.given("fredercik") == ("frederick",) and len(N.given("nat")) == 2
    assert N.person("...") is None


def test_organisations():
    want = N.organisation("Salnostrom Thistle Painting and Drywall Inc")
    for t in ("painting + drywall of Salnostrom Thistle, inc.", "SALNOSTROM-THISTLE PAINTING AND DRYWALL INCORPORATED", "Painting & Drywall - Salnostrom Thistle (payroll)", "SalnostromThistle Ptg and Drywall L.L.C."):
        assert N.organisation(t) == want, t
    assert N.organisation("Yaromgrave Beacon H/O Assn")["trades"] == N.organisation("Yaromgrave Beacon Homeowner's Association")["trades"]


def fit(a, b, evidence=False, common=5):
    r = lambda t: {"kind": "p", "own": "", "trades": "", "common": common, **N.person(t)}
    return N.fits(r(a), r(b), evidence)


def test_what_fits():
    assert fit("Peter Brenolkirk", "Brenolkirk, Pete I.") and fit("Peter Brenolkirk", "Petr Brenolkirk")
    assert not fit("P Brenolkirk", "Peter Brenolkirk") and fit("P Brenolkirk", "Peter Brenolkirk", True)
    assert not fit("Nat Brenolkirk", "Natalie Brenolkirk") and fit("Nat Brenolkirk", "Natalie Brenolkirk", True)
    assert not fit("Peter Brenolkirk Jr", "Peter Brenolkirk Sr", True) and not fit("Peter A Brenolkirk", "Peter B Brenolkirk", True)
    assert not fit("Peter Brenolkirk", "Peter Brenolkirt", common=9) and fit("Peter Brenolkirk", "Peter Brenolkirt", common=2)
    assert not fit("Peter Brenolkirk", "Daniel Brenolkirk", True)


def test_distance():
    assert distance("abcd", "abdc") == 1 and distance("abc", "abc") == 0 and distance("abc", "xyzw") == 3 and distance("", "ab") == 2


def test_components(spark):
    edges = [(i, i + 1) for i in range(40)] + [(100, 101), (7, 7), (200, 100)]
    got = {r.id: r.root for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {**{i: 0 for i in range(41)}, 100: 100, 101: 100, 200: 100}


SCHEMA = "party_id long, role string, name string, address string, phone string, ssn_last4 string, tin_last4 string, profile string"


def pairs(spark, rows):
    full = [(*r, *[None] * (7 - len(r)), "x") for r in rows]
    return {tuple(r) for r in N.same_party(spark.createDataFrame(full, SCHEMA)).collect()}


def test_merge_and_rematch(spark):
    """3 meets 1 only by the phone that 2 brings; 4 only by the number that 3 brings."""
    rows = [
        (1, "employee", "Catherine Lorancombe", "12 Oak St, Elkmead, NY 11111"),
        (2, "partner", "Lorancombe, Kate M", "12 Oak Street, Elkmead NY", "(555) 555-0101"),
        (3, "borrower", "C. Lorancombe", "N/A", "555.555.0101", None, "XXX-XX-1234"),
        (4, "recipient", "C Lorancobme", None, None, "XXX-XX-1234"),
        (5, "employee", "C Lorancombe", "99 Elm Rd, Foxburg"),
        (6, "employer", "Lorancombe Cedar Bakery LLC", "12 Oak St, Elkmead, NY 11111"),
        (7, "payer", "BAKERY OF LORANCOMBE CEDAR"),
        (8, "payer", "Lorancombe Amber Bakery LLC", "12 Oak St, Elkmead, NY 11111"),
        (7, "payer", "BAKERY OF LORANCOMBE CEDAR"),
        (9, "employee", None, "12 Oak St, Elkmead, NY 11111"),
        (10, "employee", "  "),
        (None, "employee", "Catherine Lorancombe"),
        (11, None, "Lorancombe Cedar Bkry Inc"),
        (12, "employee", "Catherine Lorancombe Jr", "12 Oak St, Elkmead, NY 11111", "(555) 555-0101"),
        (13, "employee", "y" * 5000),
    ]
    assert pairs(spark, rows) == {(1, 2), (1, 3), (1, 4), (2, 3), (2, 4), (3, 4), (6, 7), (6, 11), (7, 11)}


def test_chain_with_conflicting_numbers_is_divided(spark):
    rows = [(1, "employee", "Peter Elk", None, None, "1111"), (2, "employee", "Peter Elk", None, None, "2222"), (3, "employee", "Peter Elk"), (4, "partner", "Pete Elk", None, None, "2222")]
    got = pairs(spark, rows)
    assert (2, 4) in got and (1, 2) not in got and (1, 4) not in got


def test_empty(spark):
    assert pairs(spark, [(1, "employee", "A B")]) == set()
    assert N.same_party(spark.createDataFrame([], SCHEMA)).count() == 0


def test_division_keeps_profiles_and_observed_parts(spark):
    """Digits 1 have the initials A once and B twice by different people; what has no initial isn't cut off into (1, B)."""
    cols = "a long, b long, sure boolean, short long, backed boolean, l4a string, l4b string, mida string, midb string, na long, nb long"
    row = lambda a, b, backed=False: (a, b, True, None, backed, *[m for x in zip(marks[a], marks[b]) for m in x])
    marks = {1: ("1", "a", 1), 2: ("1", None, 1), 3: ("2", "b", 2), 4: (None, None, 1), 5: (None, None, 1), 6: (None, None, 1)}
    edges = [row(1, 2), row(1, 4), row(3, 4), row(4, 5), row(3, 5, True)]
    got = {r.id: r.root for r in N._without_conflict(spark.createDataFrame(edges, cols)).collect()}
    assert got == {1: 1, 2: 1, 3: 3, 4: 3, 5: 3}
    assert {r.id: r.root for r in N._without_conflict(spark.createDataFrame([row(1, 4), row(4, 6)], cols)).collect()} == {1: 1, 4: 1, 6: 1}


def test_stuck_conflict_leaves_nicknames_linked(spark):
    """1 to 4 fit 5 alike but not each other (the commonest digits and the commonest initial are no one's pair); the nickname of
    several names, 6, still finds the one name that fits."""
    people = [("A", "1111"), ("C", "1111"), ("B", "2222"), ("B", "3333")]
    rows = [(i, "employee", f"Peter {mid} Elk", None, None, l4) for i, (mid, l4) in enumerate(people, 1)]
    got = pairs(spark, [*rows, (5, "employee", "Peter Elk"), (6, "employee", "Nat Brenolkirk"), (7, "employee", "Nathaniel Brenolkirk")])
    assert (6, 7) in got and len(got) == 2 and len(got & {(i, 5) for i in range(1, 5)}) == 1


def test_rare_spellings_do_not_depend_on_size(spark):
    r = lambda t, rows, common: {"kind": "p", "own": "", "trades": "", "common": common, "rows": rows, **N.person(t)}
    for k in (1, 10, 1000):
        assert N.fits(r("Peter Oaobourne", 2 * k, 9), r("Peter Oakobourne", 15 * k, 15), False) and not N.fits(r("Peter Oaobourne", 9 * k, 9), r("Peter Oakobourne", 15 * k, 15), False)
    rows = [("Peter Oaobourne", 1), ("Peter Oakobourne", 2), ("Daniel Oakobourne", 3)]
    for k in (1, 10):
        some = [(i + 10 * j, "employee", name) for name, i in rows for j in range(k)]
        assert {(a % 10, b % 10) for a, b in pairs(spark, some) if a % 10 < b % 10} == {(1, 2)}, k


def test_words_run_together_at_any_number():
    o = lambda t: {"kind": "o", "common": 0, **N.organisation(t)}
    for n in range(2, 8):
        words = "alder birch cedar dogwood elmwood fir ginkgo".split()[:n]
        a, b = o("".join(words) + " llc"), o(" ".join(reversed(words)) + " inc")
        assert N.fits(a, b, False) and set(N.name_keys(a)) & set(N.name_keys(b)), n


def test_index_reaches_what_fits():
    """Random misspellings: whatever fits by the name alone shares a name key, whatever fits beside evidence an evidence key."""
    import random

    rnd = random.Random(8)

    def typo(w):
        i = rnd.randrange(max(1, len(w) - 1))
        return [w[:i] + w[i + 1 :], w[:i] + "q" + w[i:], w[:i] + "q" + w[i + 1 :], w[:i] + w[i + 1 : i + 2] + w[i : i + 1] + w[i + 2 :]][rnd.randrange(4)]

    def spell(w):
        for _ in range(rnd.choice([0, 0, 1, 1, 2])):
            w = typo(w)
        return w

    kinds = [["lorancombe", "thistle"], ["lorancombe"], ["alder", "birch", "cedarwood"]]
    made = []
    for k in range(500):
        words = [spell(w) for w in kinds[k % 3]]
        rnd.shuffle(words)
        made.append({"kind": "o", "own": " ".join(sorted(("".join(words) if rnd.random() < 0.1 else " ".join(words)).split())), "trades": "bakery", "common": 9})
    for k in range(300):
        made.append({"kind": "p", "first": rnd.choice(["peter", "p", "", "petr", "daniel"]), "mid": "", "last": spell("lorancombe"), "suffix": "", "own": "", "trades": "", "common": rnd.choice([1, 9])})
    alone, beside = [set(N.name_keys(r)) for r in made], [set(N.evidence_keys(r)) for r in made]
    seen = 0
    for i, a in enumerate(made):
        for j in range(i + 1, len(made)):
            b = made[j]
            if N.fits(a, b, True):
                seen += 1
                assert beside[i] & beside[j], (a, b)
                if N.fits(a, b, False):
                    assert alone[i] & alone[j], (a, b)
    assert seen > 3000


def test_merged_profile_enters_with_what_is_new(spark):
    """1 and 2 merge by the name; only then 2's phone meets 3's surname, two edits from 1's; 3's place brings 4."""
    rows = [
        (1, "employee", "Catherine Lorancombe"),
        (2, "partner", "Lorancombe, Catherine", None, "(555) 555-0101"),
        (3, "borrower", "C. Lorncomeb", "12 Oak St, Elkmead, NY 11111", "555.555.0101"),
        (4, "recipient", "Lorncomeb", "12 Oak Street, Elkmead"),
        (5, "recipient", "Lorncomeb", "14 Oak Street, Elkmead"),
    ]
    assert pairs(spark, rows) == {(i, j) for i in range(1, 5) for j in range(i + 1, 5)}
