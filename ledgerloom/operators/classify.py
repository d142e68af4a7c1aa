"""Document classification: keyword labels, weighted tax signatures, counted financial signatures, extraction strategy.

Every signature is a literal pattern in one projection; no pattern table is joined.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import tables as T
from ..functions import text as X
from ..functions.patterns import any_hit, hit

K1 = ["K-1 1065", "K-1 1120-S", "K-1 1041"]


def keyword_types(text: Column) -> Column:
    """All types whose every phrase occurs, in table order."""
    low = F.lower(text)
    labels = []
    for kind, phrases in T.KEYWORDS:
        both = low.contains(phrases[0])
        for p in phrases[1:]:
            both = both & low.contains(p)
        labels.append(F.when(both, F.lit(kind)))
    return F.array_compact(F.array(*labels))


def _raw_scores() -> dict[str, Column]:
    """Sum of the weights of the type's matching patterns (columns ``_h0, _h1 ...``), at most 1; 0 where none matches."""
    out: dict[str, Column] = {}
    for i, (kind, weight, _) in enumerate(T.TAX_SIGNATURES):
        w = F.when(F.col(f"_h{i}"), F.lit(weight)).otherwise(F.lit(0.0))
        out[kind] = out[kind] + w if kind in out else w
    return {k: F.least(c, F.lit(1.0)) for k, c in out.items()}


def tax_scores(df: DataFrame, text_col: str = "text") -> DataFrame:
    """Adds ``scores``: array of ``(type, score, ord)`` after the resolvers, in table order; types without a match are absent.

    A decided specific 1098 zeroes the general one; nonemployee compensation drops 1099-MISC; box 1 rents drop 1099-NEC; of
    the K-1 forms only the best keeps its score (the first of equals).
    """
    low = F.col("_low")
    raw = df.withColumn("_low", F.lower(F.col(text_col)))
    kinds = list(dict.fromkeys(k for k, _, _ in T.TAX_SIGNATURES))
    names = {k: f"_s{i}" for i, k in enumerate(kinds)}
    # a column for each pattern: so wide a projection is compiled in small methods, which the JVM optimises; one fused method isn't
    hits = {f"_h{i}": hit(low, p) for i, (_, _, p) in enumerate(T.TAX_SIGNATURES)}
    raw = raw.withColumns(hits).withColumns({names[k]: c for k, c in _raw_scores().items()}).drop(*hits)
    s = {k: F.when(F.col(n) > 0, F.col(n)) for k, n in names.items()}
    zero = lambda k: F.col(names[k])
    fixed = dict(s)
    fixed["1098"] = F.when(s["1098"].isNotNull() & ((zero("1098-T") >= 0.7) | (zero("1098-E") >= 0.7)), F.lit(0.0)).otherwise(s["1098"])
    fixed["1099-MISC"] = F.when(~hit(low, r"nonemployee\s+compensation"), s["1099-MISC"])
    fixed["1099-NEC"] = F.when(~hit(low, r"box\s*1\b.*rents\b"), s["1099-NEC"])
    best = F.greatest(*[zero(k) for k in K1])
    for i, k in enumerate(K1):
        first = zero(k) == best
        for b in K1[:i]:
            first = first & (zero(b) < best)
        fixed[k] = F.when(s[k].isNull(), None).when(first, s[k]).otherwise(F.lit(0.0))
    entries = [F.when(fixed[k].isNotNull(), F.struct(F.lit(k).alias("type"), fixed[k].alias("score"), F.lit(i).alias("ord"))) for i, k in enumerate(kinds)]
    return raw.withColumn("scores", F.array_compact(F.array(*entries))).drop(*names.values())


def _ranked(scores: Column) -> Column:
    return F.array_sort(scores, lambda a, b: F.when(a["score"] > b["score"], -1).when(a["score"] < b["score"], 1).when(a["ord"] < b["ord"], -1).when(a["ord"] > b["ord"], 1).otherwise(0))


def record_count(text: Column, kind: Column) -> Column:
    """Records by their social security numbers: W-2 copies repeat a number about four times; others count once each."""
    found = F.regexp_extract_all(text, F.lit(r"\b\d{3}-\d{2}-\d{4}\b"), 0)
    n, unique = F.size(found), F.size(F.array_distinct(found))
    w2 = F.when(n == unique, unique).otherwise(F.greatest(F.lit(1), F.bround(n / 4, 0).cast("int")))
    return F.when((kind == "UNKNOWN") | text.isNull() | (n == 0), 1).when(kind == "W2", w2).otherwise(unique)


def issuer(low: Column) -> Column:
    return F.coalesce(*[F.when(hit(low, p), F.lit(name)) for name, p in T.ISSUERS])


def detect_tax(df: DataFrame, text_col: str = "text") -> DataFrame:
    """Adds type, confidence, year, issuer, summary flag, record count, runner-up and notes. Null texts are UNKNOWN."""
    d = tax_scores(df, text_col).withColumn("_ranked", _ranked(F.col("scores")))
    top = F.get("_ranked", F.lit(0))
    sure = F.coalesce(top["score"] >= 0.5, F.lit(False))
    d = d.withColumn("document_type", F.when(sure, top["type"]).otherwise("UNKNOWN")).withColumn("confidence", F.when(sure, top["score"]).otherwise(F.lit(0.0)))
    second = F.get(F.filter("_ranked", lambda x: x["type"] != F.col("document_type")), F.lit(0))
    d = d.withColumns(
        {
            "tax_year": X.tax_year(F.col(text_col), F.col("_low")),
            "issuer_software": issuer(F.col("_low")),
            "is_summary_sheet": any_hit(F.col("_low"), T.SUMMARY_SIGNS),
            "estimated_record_count": record_count(F.col(text_col), F.col("document_type")),
            "runner_up": second["type"],
            "runner_up_score": second["score"],
        }
    )
    kind, conf = F.col("document_type"), F.col("confidence")
    said = lambda texts, *values: F.concat(*[x for i, t in enumerate(texts) for x in ((F.lit(t), values[i]) if i < len(values) else (F.lit(t),))])
    notes = F.array(
        F.when((conf < 0.7) & (kind != "UNKNOWN"), said(T.NOTE_LOW_CONFIDENCE, X.percent_text(conf), kind)),
        F.when(F.col("is_summary_sheet"), F.lit(T.NOTE_SUMMARY)),
        F.when(F.col("estimated_record_count") > 1, said(T.NOTE_RECORDS, F.col("estimated_record_count").cast("string"))),
        F.when(F.col("runner_up_score") > 0.4, said(T.NOTE_RUNNER_UP, F.col("runner_up"), X.percent_text(F.col("runner_up_score")))),
    )
    return d.withColumn("notes", F.array_compact(notes)).drop("_low", "_ranked")


def financial_counts(low: Column) -> dict[str, Column]:
    out = {}
    for kind, patterns in T.FINANCIAL_SIGNATURES:
        n = F.lit(0)
        for p in patterns:
            n = n + hit(low, p).cast("int")
        out[kind] = n
    return out


def detect_financial(df: DataFrame, text_col: str = "text", out: str = "financial_type") -> DataFrame:
    """Adds the type with most matching patterns, the most specific of equals; FINANCIAL_UNKNOWN without any.

    A specific type with two matches or more overtakes its general one.
    """
    counts = financial_counts(F.col("_low"))
    d = df.withColumn("_low", F.lower(F.col(text_col))).withColumns({f"_n_{k}": c for k, c in counts.items()})
    n = {k: F.col(f"_n_{k}") for k in counts}
    base = n["INCOME_STATEMENT"]
    for k in ("INCOME_STATEMENT_COMPARISON", "BUDGET_VS_ACTUAL"):
        n[k] = F.when((n[k] >= 2) & (base > 0) & (n[k] < base), base + 1).otherwise(n[k])
    best = F.greatest(*n.values())
    kind = F.when(best < 1, F.lit("FINANCIAL_UNKNOWN"))
    for k, c in n.items():
        kind = kind.when(c == best, F.lit(k))
    return d.withColumn(out, kind).drop("_low", *[f"_n_{k}" for k in counts])


def family(kind: Column, default: str = "unknown") -> Column:
    """Family of a document type; the default differs by use (detection: unknown, routing: tax)."""
    out = F.lit(default)
    for fam, kinds in reversed(T.FAMILIES.items()):
        out = F.when(kind.isin(*kinds), F.lit(fam)).otherwise(out)
    return out


def detect(df: DataFrame, text_col: str = "text") -> DataFrame:
    """Tax first (at 0.5 or more), then financial (at a fixed 0.8), else UNKNOWN (0.0)."""
    d = detect_financial(detect_tax(df, text_col), text_col)
    tax, fin = F.col("document_type") != "UNKNOWN", F.col("financial_type") != "FINANCIAL_UNKNOWN"
    d = d.withColumn("confidence", F.when(tax, F.col("confidence")).when(fin, 0.8).otherwise(0.0))
    return d.withColumn("document_type", F.when(tax, F.col("document_type")).when(fin, F.col("financial_type")).otherwise("UNKNOWN")).withColumn("document_family", family(F.col("document_type")))


def route_family(df: DataFrame, force: str | None = None, text_col: str = "text") -> DataFrame:
    """The family that decides the processing path: forced, else by tax type, else by financial type, else tax."""
    if force:
        return df.withColumn("family", F.lit(force))
    d = detect_financial(detect_tax(df, text_col), text_col)
    fin = family(F.col("financial_type"), "")
    return d.withColumn("family", F.when(F.col("document_type") != "UNKNOWN", "tax").when(fin != "", fin).otherwise("tax"))


def strategy(pages: DataFrame, id_col: str = "file_id", broken_fonts: str | None = None) -> DataFrame:
    """``(id, strategy, reason)`` from the first two pages (density: three), by ordered rules.

    ``pages`` has ``id, position, text``; ``broken_fonts`` names a boolean column that tells fonts without a character map.
    """
    first = pages.filter("position < 3").groupBy(id_col).agg(
        F.array_sort(F.collect_list(F.struct("position", F.coalesce("text", F.lit("")).alias("text")))).alias("p"), *([F.bool_or(broken_fonts).alias("broken")] if broken_fonts else [])
    )
    sample = F.array_join(F.transform(F.slice("p", 1, 2), lambda x: x["text"]), "\n")
    three = F.array_join(F.transform("p", lambda x: x["text"]), "\n")
    d = first.select(id_col, sample.alias("t"), three.alias("t3"), (F.col("broken") if broken_fonts else F.lit(False)).alias("broken"))
    t = F.col("t")
    is_ = lambda name, why: F.struct(F.lit(name).alias("strategy"), F.lit(why).alias("reason"))
    rules = (
        F.when(F.col("broken"), is_("ocr", "fonts without character map"))
        .when(F.length(F.trim(t)) < T.TEXT_PAGE_CHARS, is_("ocr", "little text"))
        .when(X.nonprintable_ratio(t) > 0.15, is_("ocr", "unprintable characters"))
        .when((F.length(t) > 300) & (X.anchor_hits(t) < 2), is_("ocr", "no known words"))
        .when(X.word_density(F.col("t3")) < 0.4, is_("pdfplumber", "sparse layout"))
        .otherwise(is_("text", "text layer"))
    )
    return d.select(id_col, rules.alias("r")).select(id_col, "r.strategy", "r.reason")
