"""Variant spellings of the names of persons and organisations, by merging and rematching.

Names are read into parts: a person's given name (nicknames stand for the full names they may mean), middle initial,
surname and Sr/Jr; an organisation's own words and its trade words, without legal form. Equal readings are one profile from
the start. Then rounds: each profile enters blocking with all its spellings, initials, phones, numbers and places;
profiles with fitting names merge; the merged profile unites what both had, so it meets spellings and places that neither
met alone. Rounds end when nothing merges. Names are compared by themselves once; after the first round only profiles that have
merged enter again, with the keys that are new to them, against all that ever entered.

The index reaches all that the comparison accepts (``name_keys``, ``evidence_keys``): by the name alone one edit in a surname or
in each of up to two words of an organisation, or in words run together; beside evidence two edits in long words, short forms
that begin a word, and initials.

A full given name and surname identify a person by themselves (spellings one edit apart too, where one of the surnames has at
most a fifth of the other's rows, or is seen with one or two given names whatever its rows: neither changes when the table is
repeated); an initial or a nickname of several names only with a shared phone, last four digits or place. Sr and
Jr, different middle initials and different last four digits are vetoes.
"""

from __future__ import annotations

import re
import unicodedata
from functools import lru_cache
from itertools import product
from typing import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import Written, spread
from . import address as places
from .strings import FAR, assign, components, distance, ends, joined_cost, records, variants

ORGANISATION_ROLES = ("employer", "payer", "filer", "lender")
PERSON_ROLES = ("employee", "recipient", "partner", "borrower")

# Given names with their common short forms.
GIVEN = """
abigail: abby gail; alexandra: alex lexi sandra sasha; alexander: alex al; andrew: andy drew; anthony: tony; barbara: barb babs; benjamin: ben benny; bernard: bernie; catherine: cathy kate katie cate cat;
charles: charlie chuck chas; christopher: chris kit topher; christina: chris tina; daniel: dan danny; david: dave davey; deborah: deb debbie; edward: ed eddie ted ned; elizabeth: liz beth betty eliza lizzie;
eugene: gene; frances: fran frankie franny; francis: frank fran; francisco: paco frank pancho cisco; frederick: fred freddie freddy; gabrielle: gabby gabi; geraldine: geri gerry; gregory: greg; harold: hal harry;
henrietta: hetty etta; henry: hank harry; howard: howie; ignatius: iggy; isabella: bella izzy isa; jacqueline: jackie; james: jim jimmy jamie; jennifer: jen jenny; john: jack johnny; joseph: joe joey;
kenneth: ken kenny; kimberly: kim kimmy; kristina: kris tina krissy; lawrence: larry lars; leonard: len lenny leo; louisa: lou lulu; louis: lou; margaret: peggy maggie meg marge; matthew: matt; michael: mike mick mickey;
natalie: nat nattie talia; nathaniel: nat nate nathan; nicholas: nick nicky; oliver: ollie; olivia: liv livvy ollie; patricia: pat patty trish tricia; patrick: pat paddy; peter: pete; philip: phil pip;
raymond: ray; rebecca: becky becca; richard: rich rick dick ricky; robert: bob bobby rob robbie; samuel: sam sammy; samantha: sam; stephen: steve stevie; susan: sue susie suzy; theodore: ted theo teddy;
theresa: terry tess tessa; thomas: tom tommy; timothy: tim timmy; victoria: vicky tori vic; vincent: vince vinny; walter: walt wally; william: will bill billy willy liam; winifred: winnie freddie
"""
TITLES = "mr mrs ms miss mx dr prof rev".split()
SUFFIXES = {"jr": "jr", "junior": "jr", "sr": "sr", "senior": "sr", "ii": "ii", "iii": "iii", "iv": "iv"}
#: Trade words with their short forms.
TRADES = """
accounting: acctg acct; assoc: association associates assn assoc assocs; bakery: bkry; bank: bk; brothers: bros; center: centre ctr; community: comm cmty commty; construction: constr const cont; drywall:; electric: elec;
elevator: elev; engineering: engrg eng engr; estate: est; group: grp; homeowners: homeowner hoa; importers: imp; insurance: ins; international: intl; landscape: lndscp landsc; maintenance: maint mtce; management: mgmt mgt;
manufacturing: mfg manuf mfrg; medical: med; painting: ptg; partners: ptnrs; plumbing: plbg plumb; pool:; property: prop; real:; recycling: recyc; roofing: rfg; service: services svc svcs serv; software: sftw; tea:;
transportation: transp transport; waste:
"""
#: Short forms of words that may be part of an organisation's own name.
WORDS = {"n": "north", "s": "south", "e": "east", "w": "west", "ctrl": "central", "pac": "pacific", "lk": "lake", "vly": "valley", "mtn": "mountain", "st": "saint", "ft": "fort"}
LEGAL = "llc inc incorporated corp corporation lp llp ltd limited partnership liability co company plc the of and payroll".split()


def _table(text: str) -> dict[str, set[str]]:
    out: dict[str, set[str]] = {}
    for entry in re.split(r"[;\n]", text):
        if ":" in entry:
            full, short = entry.split(":")
            for w in [full.strip(), *short.split()]:
                out.setdefault(w, set()).add(full.strip())
    return out


_GIVEN, _TRADES = _table(GIVEN), {k: next(iter(v)) for k, v in _table(TRADES).items()}


def _near(word: str, known) -> list[str]:
    return [k for k in known if abs(len(k) - len(word)) <= 1 and len(k) > 3 and distance(word, k, 1) <= 1]


@lru_cache(maxsize=200_000)
def given(word: str) -> tuple[str, ...]:
    """Full names that a given name may stand for; a misspelling within one edit counts; itself where it is none known."""
    if word in _GIVEN:
        return tuple(sorted(_GIVEN[word]))
    near = {g for k in (_near(word, _GIVEN) if len(word) > 3 else []) for g in _GIVEN[k]}
    return tuple(sorted(near)) if near else (word,)


@lru_cache(maxsize=200_000)
def trade(word: str) -> str | None:
    if word in _TRADES:
        return _TRADES[word]
    if len(word) > 4:
        for k in _TRADES:
            if len(k) > 4 and abs(len(k) - len(word)) <= 2 and distance(word, k, 2 if len(k) > 8 else 1) <= (2 if len(k) > 8 else 1):
                return _TRADES[k]
    return None


def _plain(text: str) -> str:
    return "".join(c for c in unicodedata.normalize("NFKD", text) if not unicodedata.combining(c))


def person(text: str) -> dict | None:
    """``first, mid, last, suffix`` in lower case; None for a text without a name."""
    t = re.sub(r"(?<=[a-z])(?=[A-Z])", " ", _plain(text))
    if "," in t and not re.match(r"^[^,]+,\s*(?:jr|sr|ii|iii|iv)\b\.?\s*$", t, re.I):
        head, tail = t.split(",", 1)
    else:
        head, tail = "", t.replace(",", " ")
    words = lambda s: [w.strip("'-").lower() for w in re.findall(r"[^\W\d_][\w'-]*", s)]
    a, b = words(head), words(tail)
    suffix = next((SUFFIXES[w] for w in a + b if w in SUFFIXES), "")
    a, b = ([w for w in x if w not in SUFFIXES and w not in TITLES] for x in (a, b))
    if a and b:
        last, rest = "".join(a), b
    else:
        w = a or b
        if not w:
            return None
        if len(w) == 1:  # run together: split after a given name
            g = max((k for k in _GIVEN if w[0].startswith(k) and len(w[0]) - len(k) > 3), key=len, default="")
            if not g:
                return {"first": "", "mid": "", "last": w[0], "suffix": suffix}
            last, rest = w[0][len(g) :], [g]
        else:
            known = [x in _GIVEN for x in w]
            fuzzy = [k or (len(x) > 3 and bool(_near(x, _GIVEN))) for x, k in zip(w, known)]
            ends = [i for i in range(len(w)) if len(w[i]) > 1]
            forward = (known[0] or (fuzzy[0] and not known[1]) or len(w[0]) == 1 or not any(fuzzy[1:])) and len(w[-1]) > 1
            if forward or not ends:
                last, rest = w[-1], w[:-1]
            else:
                last, rest = w[0], w[1:]
    return {"first": rest[0] if rest else "", "mid": rest[1][0] if len(rest) > 1 else "", "last": last.replace("-", ""), "suffix": suffix}


def organisation(text: str) -> dict | None:
    """``own`` words and ``trades``, each in order of the alphabet; None for a text without words."""
    t = re.sub(r"(?<=[a-z]{3})(?=[A-Z][a-z]{2})", " ", _plain(text)).lower()
    t = re.sub(r"\(\s*(?:payroll|main office|hq)\s*\)|\bmain office\b|\bc/o\b", " ", t)
    t = re.sub(r"\bh\s*/\s*o\b", "homeowners", t)
    t = re.sub(r"\b([a-z])\.(?=[a-z]\.)", r"\1", t)
    t = t.replace("'s", "s").replace("'", "")
    words = [WORDS.get(w, w) for w in re.findall(r"[a-z0-9]+", t)]
    own, trades = [], []
    for w in words:
        if w in LEGAL:
            continue
        k = trade(w)
        if k:
            trades.append(k)
        else:
            own.append(w)
    if len(own) > 2:  # misspelt short trade words
        for w in [w for w in own if 2 < len(w) < 6]:
            k = next((v for t, v in _TRADES.items() if 3 <= len(t) < 5 and t == v and distance(w, t, 1) <= 1), None)
            if k and len(own) > 2:
                own.remove(w)
                trades.append(k)
    if not own and not trades:
        return None
    return {"own": " ".join(sorted(own)), "trades": " ".join(sorted(set(trades)))}


# --- comparison ----------------------------------------------------------------------------------------------------


def _edits(word: str) -> int:
    return 0 if len(word) < 4 else 1 if len(word) < 7 else 2


def _alone_cost(a: str, b: str | None) -> float:
    """Edits between two own words: one at most."""
    if b is None:
        return FAR
    d = distance(a, b, 1)
    return float(d) if d <= min(1, _edits(a), _edits(b)) else FAR


def _edited_cost(a: str, b: str | None) -> float:
    """Edits between the only own words of names that share evidence: two at most."""
    d = FAR if b is None else distance(a, b, 2)
    return float(d) if b is not None and d <= min(_edits(a), _edits(b)) else FAR


def _backed_cost(a: str, b: str | None) -> float:
    """Edits between two own words of names that share evidence: two at most; a word's first letters, three or more, count as one."""
    if b is None:
        return FAR
    d = distance(a, b, 2)
    if d <= min(_edits(a), _edits(b)):
        return float(d)
    return 1.0 if min(len(a), len(b)) >= 3 and (a.startswith(b) or b.startswith(a)) else FAR


def unsure(a: dict, b: dict) -> bool:
    """Whether two readings fit but for a nickname that several full names have: not enough by itself."""
    ga, gb = given(a["first"]), given(b["first"])
    return a["kind"] == "p" and a["last"] == b["last"] and len(a["first"]) > 1 < len(b["first"]) and (len(ga) > 1) != (len(gb) > 1) and fits(a, b, True)


def fits(a: dict, b: dict, evidence: bool) -> bool:
    """Whether two readings may be one party's. ``common``: with how many given names the surname is written so; ``rows``: how
    often, where it is known."""
    if a["kind"] != b["kind"]:
        return False
    if a["kind"] == "o":
        x, y = a["own"].split(), b["own"].split()
        if len(x) != len(y):
            # words run together or apart
            few, many = sorted((x, y), key=len)
            most = 2 if evidence else 1
            if len(few) != 1 or joined_cost(few[0], many, most) > most:
                return False
        elif (assign(x, y, _backed_cost if len(x) > 1 else _edited_cost) > 3) if evidence else (assign(x, y, _alone_cost) > 2):
            return False
        return a["trades"] == b["trades"] or (evidence and bool(a["trades"]) and bool(b["trades"]) and (set(a["trades"].split()) <= set(b["trades"].split()) or set(b["trades"].split()) <= set(a["trades"].split())))
    if a["suffix"] != b["suffix"] or (a["mid"] and b["mid"] and a["mid"] != b["mid"]):
        return False
    d = distance(a["last"], b["last"], 2)
    if d > min(_edits(a["last"]), _edits(b["last"])) or (d > 1 and not evidence):
        return False
    f, g = a["first"], b["first"]
    if not f or not g:
        return evidence and d == 0
    if len(f) == 1 or len(g) == 1:
        return evidence and bool({f[0], *(x[0] for x in given(f))} & {g[0], *(x[0] for x in given(g))})
    ga, gb = given(f), given(g)
    if not set(ga) & set(gb):
        return evidence and f[0] == g[0] and distance(f, g, 2) <= min(_edits(f), _edits(g))
    if evidence:
        return True
    if len(ga) > 1 or len(gb) > 1:
        return f == g and d == 0
    if d == 0:
        return True
    low, high = sorted((a.get("rows", a["common"]), b.get("rows", b["common"])))
    return low * 5 <= high or min(a["common"], b["common"]) <= 2


def name_keys(r: dict) -> list[str]:
    """Blocking by the name alone: given name and surname up to an edit; an organisation's words up to an edit in each of two, or, with
    more words, one of them up to an edit and another as it is; all its letters in order of the alphabet up to one, for words run
    together."""
    if r["kind"] == "o":
        own = r["own"].split()
        letters = "".join(sorted("".join(own)))
        out = {letters, *(letters.replace(c, "", 1) for c in set(letters))}
        if len(own) == 2:
            out |= {"|".join(sorted(p)) for p in product(variants(own[0]), variants(own[1]))}
        elif len(own) > 2:
            out |= {f"{v}|{y}" for i, x in enumerate(own) for v in variants(x) for y in {*own[:i], *own[i + 1 :]}}
        return sorted(f"o|{r['trades']}|{v}" for v in out)
    return [f"p|{r['suffix']}|{g}|{v}" for g in given(r["first"]) for v in variants(r["last"])] if len(r["first"]) > 1 else []


def evidence_keys(r: dict) -> list[str]:
    """What is appended to a shared phone, number or place: ends of the words of which a fitting name shares one."""
    if r["kind"] == "o":
        return sorted({f"o|{v}" for w in r["own"].split() or [""] for v in ends(w)})
    firsts = {g[0] for g in given(r["first"])} | {r["first"][0]} if r["first"] else set()
    return sorted({f"p|{r['suffix']}|?|{r['last']}", *(f"p|{r['suffix']}|{i}|{v}" for i in firsts for v in ends(r["last"]))})


PARTS = ["kind", "first", "mid", "last", "suffix", "own", "trades"]


def readings(rows: DataFrame) -> DataFrame:
    """``name, organisation`` to the parts of the name, with ``full``, the full given name (the first of several); names without
    words are left out."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            out = []
            for name, org in zip(f["name"], f["org"]):
                if org is None or pd.isna(org):
                    o = organisation(name)
                    org = bool(o and (o["trades"] or set(re.findall(r"[a-z]+", name.lower())) & {"llc", "inc", "corp", "lp"}))
                p = organisation(name) if org else person(name)
                if p:
                    p = {"kind": "o" if org else "p", **p}
                    first = p.get("first", "")
                    out.append((name, bool(org), given(first)[0] if len(first) > 1 else "", *(p.get(k, "") for k in PARTS)))
            yield pd.DataFrame(out, columns=["name", "org", "full", *PARTS])

    names = spread(rows.select("name", "org").distinct())
    return names.mapInPandas(run, "name string, org boolean, full string, " + ", ".join(f"{k} string" for k in PARTS))


def _keyed(forms: DataFrame) -> DataFrame:
    """``(node, alone, beside)``: the name's keys, and those that go with evidence."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            rows = [(r["node"], name_keys(r), evidence_keys(r)) for r in f.to_dict("records")]
            yield pd.DataFrame(rows, columns=["node", "alone", "beside"])

    return spread(forms.select("node", *PARTS)).mapInPandas(run, "node long, alone array<string>, beside array<string>")


def _fitting(pairs: DataFrame, forms: DataFrame) -> DataFrame:
    """Of the pairs of nodes ``(a, b, evidence)``, those whose names fit: ``(a, b, sure, short, backed)``."""
    f = forms.select("node", F.struct(*PARTS, "common", "rows").alias("r"))
    both = pairs.join(f.withColumnsRenamed({"node": "a", "r": "ra"}), "a").join(f.withColumnsRenamed({"node": "b", "r": "rb"}), "b")

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for x in frames:
            a, b = records(x["ra"]), records(x["rb"])
            sure = [fits(i, j, bool(e)) for i, j, e in zip(a, b, x["evidence"])]
            # the name with the nickname of several names, where that is all there is
            short = [None if s or not unsure(i, j) else p if len(given(i["first"])) > 1 else q for s, i, j, p, q in zip(sure, a, b, x["a"], x["b"])]
            out = pd.DataFrame({"a": x["a"], "b": x["b"], "sure": sure, "short": pd.array(short, dtype="Int64"), "backed": [s and bool(e) for s, e in zip(sure, x["evidence"])]})
            yield out[out["sure"] | out["short"].notna()]

    return both.select("ra", "rb", "evidence", "a", "b").mapInPandas(run, "a long, b long, sure boolean, short long, backed boolean")


def _meeting(entries: DataFrame) -> DataFrame:
    """``(a, b)``, ``a < b``: nodes that share a key."""
    return entries.alias("l").join(entries.alias("r"), F.expr("l.key = r.key and l.node < r.node")).select(F.col("l.node").alias("a"), F.col("r.node").alias("b"))


def place_keys(addresses: DataFrame) -> DataFrame:
    """``(address, place)``: box number, or house number, direction, unit and the initials of the street's words. With a name that
    fits, that is evidence enough; misspelt streets and missing cities don't matter to it."""
    initials = F.array_join(F.array_sort(F.transform(F.split("street", " "), lambda w: F.left(w, F.lit(1)))), "")
    return places.read(addresses).select("address", F.when(F.col("box") != "", F.concat(F.lit("box "), "box")).otherwise(F.concat_ws("|", "number", "point", "unit", initials)).alias("place"))


def _organisation(role: str) -> F.Column:
    return F.when(F.col(role).isin(*ORGANISATION_ROLES), True).when(F.col(role).isin(*PERSON_ROLES), False)


def entities(df: DataFrame, more: DataFrame | None = None, id_col: str = "party_id") -> DataFrame:
    """``(id, location_id)`` of every row with a name: rows with one ``location_id`` mean the same party.

    ``df`` has ``name, role, address, phone, ssn_last4, tin_last4``; ``more`` has ``name, address`` of further organisations.
    """
    last4 = lambda c: F.nullif(F.regexp_extract(F.col(c), r"(\d{4})\s*$", 1), F.lit(""))
    own = df.select(
        df[id_col].cast("long").alias("id"), "name", _organisation("role").alias("org"), "address",
        F.nullif(F.right(F.regexp_replace("phone", r"\D", ""), F.lit(10)), F.lit("")).alias("phone"), F.coalesce(last4("ssn_last4"), last4("tin_last4")).alias("l4"),
    )
    if more is not None:
        none = F.lit(None).cast("string")
        own = own.unionByName(more.select(F.lit(None).cast("long").alias("id"), "name", F.lit(True).alias("org"), "address", none.alias("phone"), none.alias("l4")).distinct())
    own = Written(own.filter("trim(name) <> ''"), "rows").df
    read = Written(readings(own), "readings").df
    placed = own.join(Written(place_keys(own.select("address")), "places").df, "address", "left")
    rows = placed.join(read.withColumnRenamed("org", "is_org"), "name").filter("org is null or org = is_org")
    # equal readings are one profile; a reading without full given name, or one seen with several numbers, only with equal evidence
    weak = F.expr("kind = 'p' and length(first) < 2")
    numbers = rows.groupBy(*PARTS).agg((F.min("l4") != F.max("l4")).alias("several"), F.count("*").alias("n"))
    common = rows.filter("kind = 'p'").groupBy("last", "full").agg(F.count("*").alias("n")).groupBy("last").agg(F.count_if(F.col("full") != "").alias("common"), F.sum("n").alias("rows"))
    rows = rows.join(numbers, PARTS).withColumn("apart", F.when(weak, F.xxhash64("l4", "phone", "place", "address")).when(F.coalesce("several", F.lit(False)), F.xxhash64("l4")))
    rows = Written(rows.withColumn("node", F.xxhash64(*PARTS, "apart")).select("id", "node", "l4", "phone", "place", *PARTS), "nodes").df
    forms = Written(rows.select("node", *PARTS).distinct().join(common, "last", "left").fillna(0, ["common", "rows"]), "forms").df
    evidence = rows.select("node", F.explode(F.array(F.concat(F.lit("t"), "phone"), F.concat(F.lit("n"), "l4"), F.concat(F.lit("a"), "place"))).alias("ev")).filter("ev is not null").distinct()
    evidence = Written(evidence, "evidence").df
    numbered = rows.filter("l4 is not null").select("node", "l4").distinct()
    marked = Written(forms.select("node", F.nullif("mid", F.lit("")).alias("mid")).join(numbered, "node", "left"), "marks").df
    keyed = Written(_keyed(forms), "keys").df
    alone = keyed.select("node", F.explode("alone").alias("key")).select("node", F.xxhash64("key").alias("key"))
    beside = keyed.select("node", F.explode("beside").alias("key"))
    #: all that ever entered beside evidence: the node, or the profile's first node, with evidence and key
    entered = Written(evidence.join(keyed, "node").select("node", "ev", F.explode("beside").alias("key")).select("node", F.xxhash64("ev", "key").alias("met")), "entered").df
    met = _meeting(entered.select("node", F.col("met").alias("key")))
    pairs = _meeting(alone).withColumn("evidence", F.lit(False)).unionByName(met.withColumn("evidence", F.lit(True)))
    edges = Written(_fitting(pairs.groupBy("a", "b").agg(F.max("evidence").alias("evidence")), forms), "edges").df

    def members(profiles: DataFrame) -> DataFrame:
        return rows.filter("id is not null").join(profiles, "node").select("id", F.col("profile").alias("location_id")).distinct()

    label = Written(forms.select("node", F.col("node").alias("profile")), "profiles")
    # ends: each round with links unites at least two profiles, takes none apart, and leaves no link that a veto refuses to be found again
    while True:
        p = label.df
        marks = p.join(marked, "node").groupBy("profile").agg(F.min("mid").alias("m1"), F.max("mid").alias("m2"), F.min("l4").alias("n1"), F.max("l4").alias("n2"), F.count("*").alias("n"))
        of = lambda n: p.withColumnsRenamed({"node": n, "profile": f"p{n}"})
        fit = edges.join(of("a"), "a").join(of("b"), "b").filter("pa <> pb").withColumn("ps", F.expr("if(short = a, pa, if(short = b, pb, null))"))
        fit = fit.groupBy(F.least("pa", "pb").alias("pa"), F.greatest("pa", "pb").alias("pb")).agg(F.max("sure").alias("sure"), F.max("ps").alias("short"), F.max("backed").alias("backed"))
        for x in "ab":
            fit = fit.join(marks.withColumnsRenamed({"profile": f"p{x}", **{n: n + x for n in ("m1", "m2", "n1", "n2", "n")}}), f"p{x}")
        clear = "coalesce(least(m1a, m1b) = greatest(m2a, m2b) or m1a is null or m1b is null, true) and coalesce(least(n1a, n1b) = greatest(n2a, n2b) or n1a is null or n1b is null, true)"
        found = Written(fit.filter(clear).select(F.col("pa").alias("a"), F.col("pb").alias("b"), "sure", "short", "backed", *[F.col(f"{n}1{x}").alias(f"{c}{x}") for n, c in (("n", "l4"), ("m", "mid")) for x in "ab"], "na", "nb"), "merges", sure=F.col("sure"), short=F.col("short").isNotNull())
        links = found.df.filter("sure")
        if not found.seen["sure"]:
            if not found.seen["short"]:
                return members(p)
            # at the end, a nickname of several names counts where only one profile fits it
            one = found.df.filter("not sure").groupBy("short").agg(F.count("*").alias("n")).filter("n = 1").select("short")
            links = found.df.join(one, "short", "left_semi")
        merged = Written(_without_conflict(links), "merged", moved=F.col("id") != F.col("root"))
        if not merged.seen["moved"]:
            return members(p)
        old, label = label, Written(p.join(merged.df, p["profile"] == merged.df["id"], "left").select("node", F.coalesce("root", "profile").alias("profile")), "profiles")
        # the merged profiles enter again: every spelling of a profile meets every phone, number and place of the profile
        grown = label.df.join(merged.df.filter("id <> root").select(F.col("root").alias("profile")).distinct(), "profile", "left_semi")
        spelt = grown.join(beside, "node").select("profile", "key").distinct()
        united = grown.join(evidence, "node").select("profile", "ev").distinct()
        again = Written(united.join(spelt, "profile").select("profile", "key", F.xxhash64("ev", "key").alias("met")), "entered").df
        entered = entered.unionByName(again.select(F.col("profile").alias("node"), "met"))
        near = again.join(entered, "met").join(label.df.withColumnRenamed("profile", "other"), "node").filter("profile <> other").select("profile", "other", "key").distinct()
        spelling = beside.join(label.df, "node")
        near = near.join(spelling.withColumnRenamed("node", "x"), ["profile", "key"]).join(spelling.select(F.col("node").alias("y"), F.col("profile").alias("other"), "key"), ["other", "key"])
        near = near.select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).distinct().withColumn("evidence", F.lit(True))
        edges = edges.unionByName(Written(_fitting(near, forms), "edges").df)
        for done in (old, found, merged):
            done.drop()


def _divide(edges: pd.DataFrame) -> pd.DataFrame:
    """``(id, root)``: the profiles of ``edges`` in parts without different last four digits or middle initials; root is the
    least profile of the part.

    Parts grow along the edges: first where both ends have the same digits or initial, then from what has most evidence and
    most nodes, ties by least id. Profiles stay whole, and no edge is left between two parts that could be one.
    """
    edges = edges.astype({c: object for c in ("l4a", "l4b", "mida", "midb")}).where(edges.notna(), None)
    root: dict[int, int] = {}
    marks: dict[int, list] = {}
    for x in "ab":
        for i, *mark in zip(*(edges[f"{c}{x}" if c != "id" else x] for c in ("id", "l4", "mid", "n"))):
            root[i], marks[i] = i, mark

    def find(i: int) -> int:
        while root[i] != i:
            root[i] = i = root[root[i]]
        return i

    def unite(i: int, j: int) -> None:
        i, j = sorted((find(i), find(j)))
        a, b = marks[i], marks[j]
        if i != j and not any(u is not None and v is not None and u != v for u, v in zip(a[:2], b[:2])):
            root[j], marks[i] = i, [b[0] if a[0] is None else a[0], b[1] if a[1] is None else a[1], a[2] + b[2]]

    rows = list(zip(edges["a"], edges["b"], edges["backed"]))
    alike = lambda k: [r for r in rows if marks[r[0]][k] is not None and marks[r[0]][k] == marks[r[1]][k]]
    for group in (alike(0), alike(1), [r for r in rows if r[2]], rows):
        parts = [(*sorted((find(i), find(j))), i, j) for i, j, _ in group]
        for *_, i, j in sorted((-marks[x][2] - marks[y][2], x, y, i, j) for x, y, i, j in parts):
            unite(i, j)
    return pd.DataFrame({"id": list(root), "root": [find(i) for i in root]}, dtype="int64")


def _without_conflict(edges: DataFrame) -> DataFrame:
    """``(id, root)`` of the profiles of the edges. Where a chain of merges would join different last four digits or middle
    initials, it is divided (``_divide``, one task for each such chain); no profile is taken apart again, so every round with edges
    has fewer profiles after it."""
    roots = components(edges.select("a", "b"))
    held = edges.join(roots, edges["a"] == roots["id"]).drop("id")
    differ = lambda c: F.coalesce(F.least(F.min(f"{c}a"), F.min(f"{c}b")) != F.greatest(F.max(f"{c}a"), F.max(f"{c}b")), F.lit(False))
    torn = held.groupBy("root").agg((differ("l4") | differ("mid")).alias("torn")).filter("torn").select("root")
    parts = held.join(torn, "root", "left_semi").groupBy("root").applyInPandas(_divide, "id long, root long")
    return roots.join(torn, "root", "left_anti").select("id", "root").unionByName(parts)


def same_party(df: DataFrame, more: DataFrame | None = None, id_col: str = "party_id") -> DataFrame:
    """``(id_a, id_b)``, smaller id first, of all pairs of rows that mean the same person or organisation.

    Null and blank names are in no pair, nor rows without an id; a repeated row pairs as one; null roles are told by the
    name's words; null phones, numbers and addresses are no evidence either way.
    """
    return places.pairs_within(entities(df, more, id_col), id_col)
