"""Postal addresses that denote the same location.

An address is read into house number, direction, street words, street kind, unit, city, state and postal code (or box
number), whatever their order. Forms that agree in the hard parts (number, direction, unit) are compared where they share a
street word up to one deletion inside a postal-code or neighbouring-locality block. Street words are paired by the
optimal assignment under edit distance; a different number, direction, unit or street kind is a veto. Complete forms make
up the locations; a form without street kind or locality is assigned to the location that fits it best.

The index reaches all that the comparison accepts: of a street's words at least one is within one edit; a city of eight
letters and more may have two edits, one of fewer one; a postal code without a city to back it may have digits swapped. A
form with the code alone meets forms with the city alone by the city that the code has most often elsewhere, and a form with
neither meets all forms of its hard parts and street.

Every join is asked to be a sort-merge join. The sides grow with the rows, and a broadcast is built on the driver from sizes
that say little: those of packed files before words and blocks are exploded.
"""

from __future__ import annotations

import re
import unicodedata
from typing import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import Written, spread
from .strings import END, LONG, assign, components, distance, records

# Words of postal writing.
KINDS = {
    "street": "street st str", "avenue": "avenue ave av", "boulevard": "boulevard blvd boul", "road": "road rd", "drive": "drive dr drv", "lane": "lane ln", "court": "court ct",
    "place": "place pl", "parkway": "parkway pkwy pky", "way": "way wy", "circle": "circle cir", "terrace": "terrace ter", "highway": "highway hwy", "trail": "trail trl", "square": "square sq",
}
POINTS = {
    "n": "n no north", "s": "s so south", "e": "e east", "w": "w west", "ne": "ne northeast", "nw": "nw northwest", "se": "se southeast", "sw": "sw southwest",
}
UNITS = "apt apartment unit suite ste room rm"
#: Designators that are part of the unit's label, with their short forms.
PARTS = {"floor": "floor fl flr", "building": "building bldg", "lot": "lot", "space": "space spc", "trailer": "trailer trlr", "department": "dept", "hangar": "hangar hngr", "slip": "slip", "pier": "pier"}
#: Units that stand without a label.
WHOLE_UNITS = {"basement": "basement bsmt", "front": "frnt", "lobby": "lbby", "lower": "lowr", "upper": "uppr", "penthouse": "penthouse ph"}
STATES = {
    "alabama": "al", "alaska": "ak", "arizona": "az", "arkansas": "ar", "california": "ca", "colorado": "co", "connecticut": "ct", "delaware": "de", "florida": "fl", "georgia": "ga",
    "hawaii": "hi", "idaho": "id", "illinois": "il", "indiana": "in", "iowa": "ia", "kansas": "ks", "kentucky": "ky", "louisiana": "la", "maine": "me", "maryland": "md", "massachusetts": "ma",
    "michigan": "mi", "minnesota": "mn", "mississippi": "ms", "missouri": "mo", "montana": "mt", "nebraska": "ne", "nevada": "nv", "new hampshire": "nh", "new jersey": "nj", "new mexico": "nm",
    "new york": "ny", "north carolina": "nc", "north dakota": "nd", "ohio": "oh", "oklahoma": "ok", "oregon": "or", "pennsylvania": "pa", "rhode island": "ri", "south carolina": "sc",
    "south dakota": "sd", "tennessee": "tn", "texas": "tx", "utah": "ut", "vermont": "vt", "virginia": "va", "washington": "wa", "west virginia": "wv", "wisconsin": "wi", "wyoming": "wy",
}
ONES = "first second third fourth fifth sixth seventh eighth ninth tenth eleventh twelfth thirteenth fourteenth fifteenth sixteenth seventeenth eighteenth nineteenth".split()
TENS = "twent thirt fort fift sixt sevent eight ninet".split()

_KIND = {w: k for k, ws in KINDS.items() for w in ws.split()}
_POINT = {w: k for k, ws in POINTS.items() for w in ws.split()}
_ABBR = set(STATES.values())
_ORDINAL = {w: str(i + 1) for i, w in enumerate(ONES)}
for _i, _t in enumerate(TENS, 2):
    _ORDINAL[f"{_t}ieth"] = str(_i * 10)
    for _j, _o in enumerate(ONES[:9], 1):
        _ORDINAL[f"{_t}y-{_o}"] = str(_i * 10 + _j)

_BOX = re.compile(r"\b(?:p\.? ?o\.? ?box|p\.? ?o\.? ?b|post office box|box)\W{0,3}(\d[\do]*)\b")
_UNIT = re.compile(rf"(?:\b(?:{'|'.join(UNITS.split())})\b\.?\s*#?\s*|#\s*|\b(?:no|num|number)\b\.?\s*(?=\d+[a-z]?\b)(?!\d+(?:st|nd|rd|th)\b))([a-z]?\d+[a-z]?|[a-z])\b")
_PART = {w: k for k, ws in PARTS.items() for w in ws.split()}
_WHOLE = {w: k for k, ws in WHOLE_UNITS.items() for w in ws.split()}
_PART_UNIT = re.compile(
    rf"\b(?:(?P<nth>\d{{1,3}})(?:st|nd|rd|th)\s+(?P<after>floor|flr|fl)\b\.?"
    rf"|(?P<part>{'|'.join(w for w in _PART if w != 'fl')}|fl(?=\.?\s*#?\s*\d{{1,2}}\s*(?:[,;\n]|$)))\b\.?\s*(?:#|\b(?:no|num|number)\b\.?)?\s*(?P<label>[a-z]?-?\d{{1,4}}-?[a-z]?|[a-z](?=\s*(?:[,;\n]|$)))(?![\w-])"
    rf"|(?P<whole>{'|'.join(_WHOLE)})\b\.?(?=\s*(?:[,;\n]|$)))"
)
_ZIP = re.compile(r"(?<![\w-])([\doil]{5})(?:\s?-\s?([\doil]{4}))?(?![\w-])")
_CARE = re.compile(r"^\s*(?:c/o|attn|attention|care of)\b[^,;\n]*[,;\n]+")
_STATE_NAME = re.compile(r"\b(" + "|".join(sorted(STATES, key=len, reverse=True)) + r")\b")
FIELDS = ["number", "point", "street", "kind", "unit", "city", "state", "zip", "box"]


def _digits(s: str) -> str:
    return s.translate(str.maketrans("oil", "011"))


def parse(text: str | None) -> dict[str, str] | None:
    """The parts of an address in lower case, '' where unknown; None for a text that names no place."""
    if not text:
        return None
    t = "".join(c for c in unicodedata.normalize("NFKD", text) if not unicodedata.combining(c)).lower()
    t = re.sub(r"\b([nsew])\.\s?([nsew])\b\.?", r"\1\2", t)
    t = re.sub(r"\bp\.\s?o\.", "po", t)
    t = re.sub(r"[\t ]+", " ", t)
    t = _CARE.sub("", t)
    t = re.sub(r"[,\s]*\b(?:usa|u\.s\.a|united states)\b\.?[\s,.]*$", "", t)
    out = dict.fromkeys(FIELDS, "")
    if m := _BOX.search(t):
        out["box"] = _digits(m[1])
        t = f"{t[: m.start()]} , {t[m.end() :]}"
    units = []
    while m := _PART_UNIT.search(t):
        units.append(_WHOLE[m["whole"]] if m["whole"] else f"{_PART[m['part'] or m['after']]} {(m['nth'] or m['label']).replace('-', '').upper()}")
        t = f"{t[: m.start()]} , {t[m.end() :]}"
    if m := _UNIT.search(t):
        units.append(m[1].upper())
        t = f"{t[: m.start()]} , {t[m.end() :]}"
    out["unit"] = " ".join(sorted(units))
    zips = [m for m in _ZIP.finditer(t) if sum(c.isdigit() for c in m[1]) >= 2]
    if zips:
        # first of all where the locality comes first, else the last; a lone number before street words is the house's
        m = zips[0] if len(zips) > 1 and re.match(r"\s*$", t[: zips[0].start()]) and re.search(r"\s-\s", t) else zips[-1]
        if not (re.match(r"\s*$", t[: m.start()]) and not out["box"] and not re.search(r"\d", t[m.end() :])):
            out["zip"] = _digits(m[1])
            t = f"{t[: m.start()]} , {t[m.end() :]}"
    if names := list(_STATE_NAME.finditer(t)):
        m = names[-1]
        rest = t[m.end() :].strip(" ,.;-\n")
        if not rest or not re.match(r"(?:%s)\b" % "|".join(_KIND), rest):
            out["state"] = STATES[m[1]]
            t = f"{t[: m.start()]} , {t[m.end() :]}"
    segments = [re.findall(r"[\w'-]+", s.replace("'", "")) for s in re.split(r"[,;\n]|\s-\s", t)]
    segments = [[w for w in s if w != "-"] for s in segments]
    segments = [s for s in segments if s]
    if not out["state"]:
        for s in reversed(segments):
            at = [i for i, w in enumerate(s) if w in _ABBR]
            # a point of the compass or street kind next to street words is none
            at = [i for i in at if not (s[i] in _POINT or s[i] in _KIND) or (i == len(s) - 1 and not any(w[0].isdigit() for w in s))]
            if at:
                out["state"] = s.pop(at[-1])
                break
        segments = [s for s in segments if s]
    rest: list[str] = []
    for s in segments:
        at = next((i for i, w in enumerate(s) if re.fullmatch(r"\d[\doil]*[a-z]?", w) and not re.fullmatch(r"\d+(?:st|nd|rd|th)", w)), None)
        if at is not None and not out["number"] and not out["box"]:
            out["number"] = _digits(s[at]) if s[at][-1] in "oil0123456789" else s[at]
            rest += s[:at]
            _street(out, s[at + 1 :], rest)
        else:
            rest += s
    if out["number"] and not out["street"] and rest:
        _street(out, rest, rest := [])
    if not (out["box"] or (out["number"] and out["street"])):
        return None
    # a direction that stands apart belongs to the street
    if not out["point"] and not out["box"]:
        for w in rest:
            if w in _POINT:
                out["point"] = _POINT[w]
                rest.remove(w)
                break
    out["city"] = " ".join(w for w in rest if not w.isdigit())
    return out


def _street(out: dict[str, str], words: list[str], rest: list[str]) -> None:
    """Words after the house number: direction, street words, kind, direction, then what isn't street."""
    if len(words) > 1 and words[0] in _POINT and words[1] not in _KIND:
        out["point"] = _POINT[words[0]]
        words = words[1:]
    kinds = [i for i, w in enumerate(words) if i and w in _KIND]
    if not kinds:
        kinds = [i for i, w in enumerate(words) if i and len(w) > 4 and any(len(k) > 4 and distance(w, k, 1) <= 1 for k in KINDS)]
    if kinds:
        k = kinds[0] if len(kinds) == 1 or not all(w in _KIND or w in _POINT for w in words[kinds[0] : kinds[-1] + 1]) else kinds[-1]
        name, after = words[:k], words[k + 1 :]
        out["kind"] = _KIND.get(words[k]) or next(x for x in KINDS if len(x) > 4 and distance(words[k], x, 1) <= 1)
    else:
        # without a kind, a third word is the city's
        name, after = words, []
        points = [i for i, w in enumerate(words) if i and w in _POINT]
        if points:
            name, after = words[: points[0]], words[points[0] :]
        ordinal = name and (re.fullmatch(r"\d+(?:st|nd|rd|th)", name[0]) or name[0] in _ORDINAL)
        keep = 1 if ordinal else 2
        name, after = name[:keep], name[keep:] + after
    if after and after[0] in _POINT and not out["point"]:
        out["point"] = _POINT[after[0]]
        after = after[1:]
    out["street"] = " ".join(_ORDINAL.get(w) or (m[1] if (m := re.fullmatch(r"(\d+)(?:st|nd|rd|th)", w)) else w) for w in name)
    rest += after


# --- comparison ----------------------------------------------------------------------------------------------------


def _word_cost(a: str, b: str | None) -> float:
    if b is None:
        return 9.0
    if a == b:
        return 0.0
    if a.isdigit() or b.isdigit():
        return 9.0
    d = distance(a, b, 2)
    return float(d) if d <= (1 if min(len(a), len(b)) < 4 else 2) else 9.0


def _locality(a: dict, b: dict) -> float | None:
    """Cost of the localities' difference, None where they can't be one: postal code, city and state, each if both know it."""
    cost, known = 0.0, 0
    if a["state"] and b["state"]:
        if a["state"] != b["state"]:
            return None
        known += 1
    city = distance(a["city"].replace(" ", ""), b["city"].replace(" ", ""), 3) if a["city"] and b["city"] else None
    code = distance(a["zip"], b["zip"], 2) if a["zip"] and b["zip"] else None
    if city is not None and city > (2 if min(len(a["city"]), len(b["city"])) > 7 else 1):
        return None
    if code is not None and (code > 2 or (city is None and (code > 1 or sorted(a["zip"]) != sorted(b["zip"])))):
        return None
    if (city or 0) > 0 and (code or 0) > 1:
        return None
    for d in (city, code):
        if d is not None:
            cost += d
            known += 1
    return cost + (3 - known) * 0.5


def cost(a: dict, b: dict) -> float | None:
    """How far two forms are apart; None where a hard part, the kind, the street or the locality forbids one location."""
    if a["box"] != b["box"]:
        return None
    far = _locality(a, b)
    if far is None or a["box"]:
        return far
    if (a["number"], a["point"], a["unit"]) != (b["number"], b["point"], b["unit"]) or (a["kind"] and b["kind"] and a["kind"] != b["kind"]):
        return None
    x, y = a["street"].split(), b["street"].split()
    if len(x) == len(y):
        street = assign(x, y, _word_cost)
        if street > 4 or (street > 1 and not any(_word_cost(i, j) <= 1 for i in x for j in y)):
            return None
    else:
        street = float(distance("".join(x), "".join(y), 1)) + 1
        if street > 2:
            return None
    return far + street + (0 if a["kind"] and b["kind"] else 0.5)


def _word_variants(words: F.Column) -> F.Column:
    """Index words of an array of words: each word, and each with one character less (long ones: their ends; digits: as they are)."""
    n = F.length
    cut = lambda w: F.transform(F.sequence(F.lit(1), n(w)), lambda i: F.concat(F.substring(w, F.lit(1), i - 1), F.substring(w, i + 1, n(w))))
    few = lambda w: F.when(w.rlike(r"^\d+$") | (n(w) == 0), F.array(w)).when(n(w) <= LONG + 1, F.array_append(cut(w), w)).otherwise(F.array().cast("array<string>"))
    both = lambda w: F.when((n(w) >= LONG) & ~w.rlike(r"^\d+$"), F.array(F.concat(F.lit("<"), F.left(w, F.lit(END))), F.concat(F.lit(">"), F.right(w, F.lit(END))))).otherwise(F.array().cast("array<string>"))
    return F.array_distinct(F.flatten(F.transform(words, lambda w: F.concat(few(w), both(w)))))


def _city_blocks(city: F.Column) -> F.Column:
    """Neighbouring-locality blocks: the first four letters up to a deletion, and the last four (see ``strings.ends``)."""
    c = F.replace(city, F.lit(" "), F.lit(""))
    head = F.left(c, F.lit(4))
    heads = F.transform(F.array_append(F.transform(F.sequence(F.lit(1), F.length(head)), lambda i: F.concat(F.left(head, i - 1), F.substring(head, i + 1, F.lit(4)))), head), lambda h: F.concat(F.lit("p"), h))
    return F.when(city != "", F.array_distinct(F.array_append(heads, F.concat(F.lit("s"), F.right(c, F.lit(4)))))).otherwise(F.array().cast("array<string>"))


def _code_blocks(code: F.Column) -> F.Column:
    """Postal-code block: digits in order of size, so that swapped digits stay."""
    return F.when(code != "", F.array(F.concat(F.lit("z"), F.array_join(F.array_sort(F.split(code, "")), "")))).otherwise(F.array().cast("array<string>"))


def read(addresses: DataFrame) -> DataFrame:
    """Distinct forms of the distinct addresses: ``address, form_id`` and the parts; addresses that name no place are left out."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            rows = [(x, *(p[k] for k in FIELDS)) for x in f["address"] if (p := parse(x))]
            yield pd.DataFrame(rows, columns=["address", *FIELDS])

    texts = spread(addresses.select("address").filter("address is not null").distinct())
    parsed = texts.mapInPandas(run, "address string, " + ", ".join(f"{k} string" for k in FIELDS))
    return parsed.withColumn("form_id", F.xxhash64(*FIELDS))


def candidates(forms: DataFrame) -> DataFrame:
    """``(a, b)``, ``a < b``, of the pairs of forms that share hard parts, a street word up to a deletion, and a block."""
    usual = forms.filter("zip <> '' and city <> ''").groupBy("zip", "city").agg(F.count("*").alias("n")).groupBy("zip").agg(F.max_by("city", F.struct("n", "city")).alias("usual"))
    lone = forms.filter("zip <> '' and city = ''").join(usual.hint("merge"), "zip", "left").select("form_id", *FIELDS, F.coalesce("usual", F.lit("")).alias("near"))
    placed = forms.filter("zip = '' or city <> ''").select("form_id", *FIELDS, F.col("city").alias("near")).unionByName(lone)
    words = F.array_append(F.split("street", " "), F.replace("street", F.lit(" "), F.lit("")))
    hard = F.when(F.col("box") != "", F.concat(F.lit("box|"), "box")).otherwise(F.concat_ws("|", "number", "point", "unit"))
    indexed = placed.select(
        "form_id", hard.alias("hard"), F.when(F.col("box") != "", F.array(F.lit(""))).otherwise(_word_variants(words)).alias("words"),
        F.concat(_code_blocks(F.col("zip")), _city_blocks(F.col("near"))).alias("blocks"), F.expr("zip = '' and city = ''").alias("adrift"),
    )
    indexed = Written(indexed, "indexed").df
    entries = indexed.select("form_id", "hard", F.explode("words").alias("word"), "blocks").select("form_id", "hard", "word", F.explode("blocks").alias("block")).select(F.xxhash64("hard", "block", "word").alias("key"), "form_id")
    near = entries.alias("l").join(entries.alias("r").hint("merge"), F.expr("l.key = r.key and l.form_id < r.form_id")).select(F.col("l.form_id").alias("a"), F.col("r.form_id").alias("b"))
    # a form without any locality asks everywhere; no other form does
    anywhere = indexed.select("form_id", "adrift", "hard", F.explode("words").alias("word")).select(F.xxhash64("hard", "word").alias("key"), "form_id", "adrift")
    far = anywhere.filter("adrift").alias("l").join(anywhere.alias("r").hint("merge"), F.expr("l.key = r.key and l.form_id <> r.form_id")).select(F.least("l.form_id", "r.form_id").alias("a"), F.greatest("l.form_id", "r.form_id").alias("b"))
    return near.unionByName(far).distinct()


def _costs(pairs: DataFrame, forms: DataFrame) -> DataFrame:
    """``(a, b, ..., cost)``: the pairs with how far the two forms are apart, null where they can't be one location."""
    f = forms.select("form_id", F.struct(*FIELDS).alias("p")).hint("merge")
    both = pairs.join(f.withColumnsRenamed({"form_id": "a", "p": "pa"}), "a").join(f.withColumnsRenamed({"form_id": "b", "p": "pb"}), "b")

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for x in frames:
            c = [cost(a, b) for a, b in zip(records(x["pa"]), records(x["pb"]))]
            yield pd.DataFrame({"a": x["a"], "b": x["b"], "cost": pd.array(c, dtype="Float64")})

    return both.mapInPandas(run, "a long, b long, cost double")


def compared(forms: DataFrame) -> DataFrame:
    """``(a, b, cost)`` of the pairs of forms that may denote one location."""
    return _costs(candidates(forms), forms).filter("cost is not null")


def _centred(core: DataFrame, edges: DataFrame, forms: DataFrame) -> DataFrame:
    """``(form_id, location_id, n)`` of whole forms: components of the edges in which every form fits the centre, the form with most
    edges (of equals the one written most, then the one with most parts, then the least id). Forms that don't are taken out and
    make up components of their own, so a chain of typos doesn't drift."""
    parts = sum((F.col(c) != "").cast("int") for c in FIELDS)
    ends = edges.select(F.col("a").alias("form_id")).unionByName(edges.select(F.col("b").alias("form_id"))).groupBy("form_id").agg(F.count("*").alias("edges"))
    weight = forms.select("form_id", parts.alias("parts")).join(ends.hint("merge"), "form_id").hint("merge")
    done: DataFrame | None = None
    while True:
        held = core.join(weight, "form_id")
        centre = held.groupBy("location_id").agg(F.min_by("form_id", F.struct(-F.col("edges"), -F.col("n"), -F.col("parts"), "form_id")).alias("b"), F.count("*").alias("forms")).filter("forms > 2")
        asked = core.join(centre.hint("merge"), "location_id").select(F.col("form_id").alias("a"), "b").filter("a <> b")
        off = Written(_costs(asked, forms).filter("cost is null").select(F.col("a").alias("form_id")), "off", any=F.lit(True))
        if not off.seen["any"]:
            return core if done is None else Written(done.unionByName(core), "centred").df
        out = off.df.hint("merge")
        kept = Written(core.join(out, "form_id", "left_anti"), "kept").df
        done = kept if done is None else done.unionByName(kept)
        among = edges.join(out.withColumnRenamed("form_id", "a"), "a", "left_semi").join(out.withColumnRenamed("form_id", "b"), "b", "left_semi")
        roots = components(among).hint("merge")
        again = core.join(out, "form_id", "left_semi").select("form_id", "n")
        core = Written(again.join(roots, again["form_id"] == roots["id"], "left").select("form_id", F.coalesce("root", "form_id").alias("location_id"), "n"), "core").df


def locations(addresses: DataFrame) -> DataFrame:
    """``(address, location_id)`` of every address that names a place; addresses with one ``location_id`` denote one location."""
    parsed = Written(read(addresses), "parsed").df
    forms = Written(parsed.groupBy("form_id", *FIELDS).agg(F.count("*").alias("n")).withColumn("whole", F.expr("(box <> '' or kind <> '') and (zip <> '' or city <> '')")), "forms").df
    pairs = Written(compared(forms), "pairs").df
    whole = forms.select(F.col("form_id").alias("a"), F.col("whole").alias("wa")).hint("merge")
    marked = Written(pairs.join(whole, "a").join(whole.withColumnsRenamed({"a": "b", "wa": "wb"}), "b"), "marked").df
    sure = marked.filter("wa and wb").select("a", "b")
    core = components(sure).hint("merge")
    core = Written(forms.filter("whole").join(core, forms["form_id"] == core["id"], "left").select("form_id", F.coalesce("root", "form_id").alias("location_id"), "n"), "core").df
    core = _centred(core, sure, forms)
    size = core.groupBy("location_id").agg(F.sum("n").alias("size")).hint("merge")
    part = marked.filter("wa <> wb").select(F.expr("if(wa, b, a)").alias("form_id"), F.expr("if(wa, a, b)").alias("to"), "cost")
    best = (
        part.join(core.select(F.col("form_id").alias("to"), "location_id").hint("merge"), "to")
        .groupBy("form_id", "location_id")
        .agg(F.min("cost").alias("cost"))
        .join(size, "location_id")
        .groupBy("form_id")
        .agg(F.min_by("location_id", F.struct("cost", -F.col("size"), "location_id")).alias("location_id"))
    )
    taken = Written(core.select("form_id", "location_id").unionByName(best.select("form_id", "location_id")), "taken").df
    rest = forms.join(taken.hint("merge"), "form_id", "left_anti").select("form_id")
    loose = marked.join(rest.select(F.col("form_id").alias("a")).hint("merge"), "a", "left_semi").join(rest.select(F.col("form_id").alias("b")).hint("merge"), "b", "left_semi").select("a", "b")
    own = components(loose).hint("merge")
    rest = rest.join(own, rest["form_id"] == own["id"], "left").select("form_id", F.coalesce("root", "form_id").alias("location_id"))
    return parsed.select("address", "form_id").join(taken.unionByName(rest).hint("merge"), "form_id").select("address", "location_id")


def same_location(df: DataFrame, more: DataFrame | None = None, id_col: str = "party_id", address_col: str = "address") -> DataFrame:
    """``(id_a, id_b)``, smaller id first, of all pairs of rows whose addresses denote one location.

    ``more``: further addresses (column ``address``) that take part as evidence. Null addresses and texts that name no place
    are in no pair; rows without an id neither; a repeated row pairs as one.
    """
    own = df.select(df[id_col].alias("id"), df[address_col].alias("address"))
    texts = own.select("address") if more is None else own.select("address").unionByName(more.select("address"))
    placed = own.filter("id is not null").join(locations(texts).hint("merge"), "address").select("id", "location_id").distinct()
    return pairs_within(Written(placed, "placed").df, id_col)


def pairs_within(members: DataFrame, id_col: str) -> DataFrame:
    """All pairs of ids of one group ``(id, location_id)``."""
    a, b = members.alias("a"), members.alias("b").hint("merge")
    return a.join(b, F.expr("a.location_id = b.location_id and a.id < b.id")).select(F.col("a.id").alias(f"{id_col}_a"), F.col("b.id").alias(f"{id_col}_b")).distinct()
