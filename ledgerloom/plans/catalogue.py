"""The query catalogue: one entry per operator, each over its whole tables, with the SQL that must give the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import inference
from ..functions import hashing as H
from ..functions import tables as T
from ..functions import text as X
from ..functions.amounts import parse_amount, parse_amount_map
from ..operators import chunking, classify, merging, nested, sanitize, sectionize, validate, verify
from ..session import fan_out
from ..sinks import layouts as L
from ..sources import files as S
from ..sources import xlsx
from ..streaming import watch
from . import sql as Q

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}


def _t(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def query(sql: str | None = None, name: str | None = None) -> Callable[[Query], Query]:
    def add(f: Query) -> Query:
        QUERIES[name or f.__name__] = f
        if sql:
            SQL[name or f.__name__] = sql
        return f

    return add


def queries() -> dict[str, Query]:
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(SQL)


# --- nested records -----------------------------------------------------------------------------------------------------


@query(nested.LINKS_SQL)
def p3_found(spark: SparkSession, sf: str) -> DataFrame:
    return nested.links(nested.nodes(_t(spark, sf, "extractions")))


def _p3(table: str) -> Query:
    return lambda spark, sf: nested.typed_table(nested.nodes(_t(spark, sf, "extractions")), table)


def _p3_variant(variant: str) -> Query:
    return lambda spark, sf: nested.subtype_table(nested.nodes(_t(spark, sf, "extractions")), variant)


for _table in ("box12", "box14_other", "state", "local", "sections", "accounts"):
    query(Q.typed_table(_table), name=f"p3_{_table}")(_p3(_table))
for _variant in ("section_group", "section_leaf", "section_empty", "account_balance", "account_amount", "account_bare"):
    query(Q.typed_table(nested.SUBTYPES[_variant][0], _variant), name=f"p3_{_variant}")(_p3_variant(_variant))


# --- classification -----------------------------------------------------------------------------------------------------


def _docs(spark: SparkSession, sf: str) -> DataFrame:
    return fan_out(_t(spark, sf, "documents").select("doc_id", "text"))


@query(Q.meaningful())
def meaningful_chars(spark: SparkSession, sf: str) -> DataFrame:
    return _docs(spark, sf).select("doc_id", X.meaningful_length(F.col("text")).alias("meaningful_chars"), X.page_type(F.col("text")).alias("page_type"))


@query(Q.keyword_types())
def keyword_doc_types(spark: SparkSession, sf: str) -> DataFrame:
    return _docs(spark, sf).select("doc_id", F.array_join(classify.keyword_types(F.col("text")), ";").alias("types"))


@query(Q.tax_scores())
def tax_scores(spark: SparkSession, sf: str) -> DataFrame:
    return classify.tax_scores(_docs(spark, sf)).select("doc_id", F.inline_outer("scores")).filter("type is not null")


@query(Q.tax_detect())
def tax_detect(spark: SparkSession, sf: str) -> DataFrame:
    return classify.detect_tax(_docs(spark, sf)).drop("text", "scores", "notes")


@query(Q.tax_notes())
def tax_notes(spark: SparkSession, sf: str) -> DataFrame:
    # outer: else the optimizer infers a filter on the array and computes all signatures twice
    return classify.detect_tax(_docs(spark, sf)).select("doc_id", F.posexplode_outer("notes").alias("ord", "note")).filter("note is not null")


@query(Q.financial_detect())
def financial_type(spark: SparkSession, sf: str) -> DataFrame:
    return classify.detect_financial(_docs(spark, sf)).select("doc_id", "financial_type")


@query(Q.master_detect())
def master_detect(spark: SparkSession, sf: str) -> DataFrame:
    return classify.detect(_docs(spark, sf)).select("doc_id", "document_type", "document_family", "confidence")


@query(f"SELECT doc_id, {Q.year_sql()} AS tax_year FROM documents")
def tax_year(spark: SparkSession, sf: str) -> DataFrame:
    return _docs(spark, sf).select("doc_id", X.tax_year(F.col("text")).alias("tax_year"))


@query(Q.route_family())
def resolve_family(spark: SparkSession, sf: str) -> DataFrame:
    return classify.route_family(_docs(spark, sf)).select("doc_id", "family")


_ANCHORS_SQL = lambda c: " + ".join(f"CAST(contains(lower({c}), {Q.q(w)}) AS INTEGER)" for w in T.ANCHORS)
_DENSITY_SQL = lambda c: f"CASE WHEN length({c}) > 0 THEN length(regexp_replace({c}, '[^\\p{{L}}\\p{{N}}]', '', 'g')) / length({c}) END"
_UNPRINTED_SQL = lambda c: f"CASE WHEN length({c}) > 0 THEN length(regexp_replace({c}, '[^\\p{{Cc}}\\p{{Cs}}\\p{{Co}}]|[\\n\\t\\r]', '', 'g')) / length({c}) END"


@query(f"SELECT doc_id, {_DENSITY_SQL('text')} AS density, {_UNPRINTED_SQL('text')} AS unprinted, CAST(coalesce({_ANCHORS_SQL('text')}, 0) AS INTEGER) AS anchors FROM documents")
def text_quality(spark: SparkSession, sf: str) -> DataFrame:
    t = F.col("text")
    return _docs(spark, sf).select("doc_id", X.word_density(t).alias("density"), X.nonprintable_ratio(t).alias("unprinted"), X.anchor_hits(t).alias("anchors"))


@query(
    f"WITH {Q.pages_cte()}, f AS (SELECT file_id, coalesce(string_agg(coalesce(text, ''), chr(10) ORDER BY position) FILTER (position < 2), '') AS t, string_agg(coalesce(text, ''), chr(10) ORDER BY position) AS t3 FROM pg WHERE position < 3 GROUP BY file_id), "
    f"r AS (SELECT file_id, CASE WHEN length(trim(t)) < {T.TEXT_PAGE_CHARS} THEN 1 WHEN {_UNPRINTED_SQL('t')} > 0.15 THEN 2 WHEN length(t) > 300 AND {_ANCHORS_SQL('t')} < 2 THEN 3 WHEN {_DENSITY_SQL('t3')} < 0.4 THEN 4 ELSE 5 END AS k FROM f) "
    "SELECT file_id, CASE WHEN k < 4 THEN 'ocr' WHEN k = 4 THEN 'pdfplumber' ELSE 'text' END AS strategy, (['little text', 'unprintable characters', 'no known words', 'sparse layout', 'text layer'])[k] AS reason FROM r"
)
def extraction_strategy(spark: SparkSession, sf: str) -> DataFrame:
    return classify.strategy(sectionize.pages(_t(spark, sf, "files")))


@query(
    "SELECT coalesce(document_type, '') AS document_type, "
    + Q.family_case("document_type", "tax")
    + " AS family, CAST(CASE "
    + " ".join(f"WHEN document_type = {Q.q(k)} THEN {n}" for k, n in T.BUDGETS.items())
    + f" ELSE {T.DEFAULT_BUDGET} END AS INTEGER) AS max_tokens, count(*) AS n FROM documents GROUP BY ALL"
)
def token_budget(spark: SparkSession, sf: str) -> DataFrame:
    d = _t(spark, sf, "documents")
    kind = F.coalesce("document_type", F.lit(""))
    return d.groupBy(kind.alias("document_type"), classify.family(F.col("document_type"), "tax").alias("family"), inference.token_budget(F.col("document_type")).alias("max_tokens")).agg(F.count("*").alias("n"))


# --- sections and chunks ------------------------------------------------------------------------------------------------


def _pages(spark: SparkSession, sf: str) -> DataFrame:
    return sectionize.pages(fan_out(_t(spark, sf, "files").select("file_id", "pages")))


@query(f"WITH {Q.headers_cte()} SELECT file_id, position, page, title, header_type, header_confidence FROM hs")
def header_scan(spark: SparkSession, sf: str) -> DataFrame:
    return sectionize.header_scan(_pages(spark, sf)).drop("text")


@query(f"WITH {Q.sections_cte()} SELECT * FROM sec")
def boundaries(spark: SparkSession, sf: str) -> DataFrame:
    return sectionize.sections(_pages(spark, sf))


@query(f"WITH {Q.sections_cte()} SELECT file_id, pg.position, page, section_no, document_type FROM pg JOIN sec USING (file_id) WHERE pg.position BETWEEN start_position AND end_position")
def section_pages(spark: SparkSession, sf: str) -> DataFrame:
    p = _pages(spark, sf)
    return sectionize.section_pages(p, sectionize.sections(p)).drop("text")


@query(f"WITH {Q.sections_cte()}, f AS (SELECT file_id, min(start_position) AS start FROM sec GROUP BY file_id) SELECT file_id, position, page FROM pg JOIN f USING (file_id) WHERE position < start")
def unassigned_pages(spark: SparkSession, sf: str) -> DataFrame:
    p = _pages(spark, sf)
    return sectionize.unassigned_pages(p, sectionize.sections(p)).drop("text")


@query(
    f"WITH {Q.pages_cte()} SELECT file_id, string_agg('--- PAGE ' || coalesce(CAST(page AS VARCHAR), '?') || ' ---' || chr(10) || text, chr(10) ORDER BY position) AS text FROM pg "
    "WHERE trim(regexp_replace(text, '\\s+', ' ', 'g')) <> '' GROUP BY file_id"
)
def concat_pages(spark: SparkSession, sf: str) -> DataFrame:
    return sectionize.concat_pages(_pages(spark, sf))


@query(
    "WITH s AS (SELECT doc_id, text, unnest(range(0, length(text), 630)) AS start FROM documents WHERE text <> '') "
    "SELECT doc_id, CAST(row_number() OVER (PARTITION BY doc_id ORDER BY start) - 1 AS INTEGER) AS chunk_index, substring(text, start + 1, 700) AS text FROM s"
)
def chunk_windows(spark: SparkSession, sf: str) -> DataFrame:
    return _docs(spark, sf).select("doc_id", F.posexplode(chunking.fixed_windows(F.col("text"), F.lit(700))).alias("chunk_index", "text"))


_SIZE = 2100
_TIERS_SQL = (
    "WITH RECURSIVE c AS (SELECT chunk_id AS id, text, coalesce(document_type, '') AS kind FROM chunks WHERE text IS NOT NULL), "
    "p AS (SELECT *, string_split(regexp_replace(text, '(\\n\\s*\\n)([\\w-]{4,15}[ ]+[A-Z])', '\\1' || chr(1) || '\\2', 'g'), chr(1)) AS accounts, list_filter(string_split_regex(text, "
    + Q.q(f"(?m){chunking.PAGE_BREAK}")
    + "), lambda x: trim(regexp_replace(x, '\\s+', ' ', 'g')) <> '') AS pages FROM c), "
    f"k AS (SELECT id, text, CASE WHEN length(text) <= {_SIZE} THEN 'whole' WHEN kind IN ('GENERAL_LEDGER', 'QB_GENERAL_LEDGER') AND len(accounts) >= 3 THEN 'account' WHEN len(pages) >= 2 THEN 'page' ELSE 'window' END AS tier, accounts, pages FROM p), "
    "pk AS (SELECT id, tier, CASE tier WHEN 'account' THEN accounts ELSE pages END AS parts, CASE tier WHEN 'account' THEN '' ELSE chr(10) END AS joint, 1 AS i, CAST([] AS VARCHAR[]) AS done, CAST(NULL AS VARCHAR) AS held FROM k WHERE tier IN ('account', 'page') "
    f"UNION ALL SELECT id, tier, parts, joint, i + 1, CASE WHEN held IS NULL OR length(held || joint || parts[i]) <= {_SIZE} THEN done ELSE list_append(done, held) END, CASE WHEN held IS NOT NULL AND length(held || joint || parts[i]) <= {_SIZE} THEN held || joint || parts[i] ELSE parts[i] END FROM pk WHERE i <= len(parts)), "
    "l AS (SELECT id, tier, list_append(done, held) AS xs FROM pk WHERE i = len(parts) + 1 UNION ALL SELECT id, tier, [text] FROM k WHERE tier = 'whole' "
    f"UNION ALL SELECT id, tier, list_transform(range(0, length(text), {int(_SIZE * (1 - chunking.OVERLAP))}), lambda s: substring(text, CAST(s + 1 AS BIGINT), {_SIZE})) FROM k WHERE tier = 'window'), "
    "x AS (SELECT id, tier, len(xs) AS n, generate_subscripts(xs, 1) AS i, unnest(xs) AS text FROM l) "
    "SELECT id AS chunk_id, CAST(i - 1 AS INTEGER) AS chunk_index, CAST(n AS INTEGER) AS total_chunks, text, CASE WHEN tier = 'account' AND regexp_matches(text, '^\\s*[\\w-]{4,15}[ ]+[A-Z]') THEN substring(trim(regexp_extract(text, '^\\s*([^\\n]*)', 1)), 1, 80) END AS account_context, tier FROM x"
)


@query(_TIERS_SQL)
def chunk_tiers(spark: SparkSession, sf: str) -> DataFrame:
    return chunking.chunk(_t(spark, sf, "chunks").select("chunk_id", "text", "document_type"), "chunk_id", max_tokens=600)


# --- scalars ------------------------------------------------------------------------------------------------------------

_TOTALS = ("assets.total_assets", "liabilities.total_liabilities", "equity.total_equity_reported", "income.total", "expenses.total", "other_income.total")


@query(
    f"WITH {Q.record_cte('document_type <> ' + Q.q('W2'))}, t AS ("
    + " UNION ALL ".join(f"SELECT record_id, {Q.q(p)} AS field, {Q.scalar_at(p)} AS raw FROM v WHERE json_type(v) = 'OBJECT'" for p in _TOTALS)
    + f") SELECT record_id, field, {Q.amount('raw')} AS amount FROM t WHERE raw IS NOT NULL"
)
def parse_amounts(spark: SparkSession, sf: str) -> DataFrame:
    d = L.parsed(_t(spark, sf, "extractions").filter("document_type <> 'W2'"))
    pairs = F.array(*[F.struct(F.lit(p).alias("field"), L.at(p).alias("raw")) for p in _TOTALS])
    return d.select("record_id", F.inline(pairs)).filter("raw is not null").select("record_id", "field", parse_amount(F.col("raw")).alias("amount"))


@query(
    f"WITH {Q.record_cte('document_type = ' + Q.q('BALANCE_SHEET'))}, t AS (SELECT record_id, {Q.amount(Q.scalar_at(_TOTALS[0]))} AS total_assets, {Q.amount(Q.scalar_at(_TOTALS[1]))} AS total_liabilities, "
    f"{Q.amount(Q.scalar_at(_TOTALS[2]))} AS total_equity FROM v WHERE json_type(v) = 'OBJECT') SELECT *, total_assets - (total_liabilities + total_equity) AS difference, abs(total_assets - (total_liabilities + total_equity)) <= 0.02 AS balanced FROM t"
)
def statement_equation(spark: SparkSession, sf: str) -> DataFrame:
    d = L.parsed(_t(spark, sf, "extractions").filter("document_type = 'BALANCE_SHEET'"))
    totals = d.select("record_id", *[parse_amount(L.at(p)).alias(n) for p, n in zip(_TOTALS, ("total_assets", "total_liabilities", "total_equity"))])
    return verify.balance_equation(totals).drop("note")


@query(
    f"WITH {Q.record_cte('document_type = ' + Q.q('INCOME_STATEMENT'))} SELECT record_id, {Q.amount(Q.scalar_at(_TOTALS[3]))} - {Q.amount(Q.scalar_at(_TOTALS[4]))} AS net_income FROM v WHERE json_type(v) = 'OBJECT'"
)
def statement_net_income(spark: SparkSession, sf: str) -> DataFrame:
    d = L.parsed(_t(spark, sf, "extractions").filter("document_type = 'INCOME_STATEMENT'"))
    return verify.net_income(d.select("record_id", parse_amount(L.at(_TOTALS[3])).alias("total_income"), parse_amount(L.at(_TOTALS[4])).alias("total_expenses")), "record_id")


@query(
    f"WITH {Q.record_cte('document_type = ' + Q.q('W2'))}, k AS (SELECT record_id, json_extract(v, '$.federal') AS f, unnest(json_keys(v, '$.federal')) AS box FROM v WHERE json_type(v, '$.federal') = 'OBJECT'), "
    f"t AS (SELECT record_id, box, json_extract_string(f, '$.' || box) AS raw FROM k) SELECT record_id, box, {Q.amount('raw')} AS amount FROM t"
)
def amount_map(spark: SparkSession, sf: str) -> DataFrame:
    d = L.parsed(_t(spark, sf, "extractions").filter("document_type = 'W2'"))
    return d.select("record_id", F.explode(parse_amount_map(L.at("federal", "map<string,string>"))).alias("box", "amount"))


@query(
    "WITH r AS (SELECT record_id, document_type, regexp_extract(data, '(?s)[{].*[}]') AS rec FROM extractions), v AS (SELECT record_id, document_type, CASE WHEN rec <> '' AND json_valid(rec) THEN rec::JSON END AS v FROM r) "
    "SELECT record_id, concat_ws(';', CASE WHEN document_type IS NULL OR document_type NOT IN ("
    + ", ".join(map(Q.q, validate.known_types()))
    + ") THEN 'unknown type' END, CASE WHEN v IS NULL THEN 'no record' END, "
    + ", ".join(
        f"CASE WHEN document_type = {Q.q(k)} AND v IS NOT NULL AND "
        + (f"coalesce({Q.scalar_at(p)}, '') = ''" if p == "entity.name" else f"coalesce(json_type(v, '$.{p}'), '') <> 'OBJECT'")
        + f" THEN 'missing {p}' END"
        for k in validate.known_types()
        for p in validate.required(k)
    )
    + ") AS problems FROM v"
)
def validation(spark: SparkSession, sf: str) -> DataFrame:
    return validate.validated(_t(spark, sf, "extractions")).select("record_id", F.array_join("problems", ";").alias("problems"))


def _sum_sql(array: str, value: str) -> str:
    return f"(SELECT coalesce(sum(CAST({value} AS DECIMAL(28,6))), 0) FROM (SELECT unnest(CASE WHEN json_type({array}) = 'ARRAY' THEN CAST(json_extract({array}, '$[*]') AS JSON[]) ELSE [] END) AS a))"


_ACCOUNT_SQL = "coalesce(" + ", ".join(Q.amount(f"CASE WHEN json_type(a, '$.{f}') NOT IN ('ARRAY', 'OBJECT') THEN json_extract_string(a, '$.{f}') END") for f in ("balance", "amount")) + ")"
_EQUITY_SQL = f"coalesce(nullif({Q.amount(Q.scalar_at('equity.total_equity_reported'))}, 0), {Q.amount(Q.scalar_at('equity.total_equity'))}, 0)"
_SIDE_SQL = lambda s: f"coalesce({Q.amount(Q.scalar_at('total'))}, {Q.amount(Q.scalar_at(s + '.total'))}, {Q.amount(Q.scalar_at('total_' + s))})"


@query(
    f"WITH {Q.record_cte('document_type <> ' + Q.q('W2'))}, d AS (SELECT * FROM v WHERE json_type(v) = 'OBJECT'), s AS (SELECT record_id, unnest(CAST(json_extract(v, '$.equity.sections[*]') AS JSON[])) AS s FROM d WHERE document_type = 'BALANCE_SHEET' AND json_type(v, '$.equity.sections') = 'ARRAY'), "
    "a AS (SELECT record_id, unnest(CAST(json_extract(s, '$.accounts[*]') AS JSON[])) AS a FROM s WHERE json_type(s, '$.accounts') = 'ARRAY'), "
    f"e AS (SELECT record_id, sum(CAST({_ACCOUNT_SQL} AS DECIMAL(28,6))) AS own FROM a GROUP BY record_id) "
    f"SELECT record_id, CAST(CASE WHEN document_type = 'BALANCE_SHEET' THEN {_EQUITY_SQL} - coalesce(own, 0) END AS DECIMAL(28,6)) AS retained_earnings, CAST(CASE WHEN document_type = 'INCOME_STATEMENT' THEN {_SIDE_SQL('income')} - {_SIDE_SQL('expenses')} END AS DECIMAL(28,6)) AS net_income FROM d LEFT JOIN e USING (record_id)"
)
def derived_fields(spark: SparkSession, sf: str) -> DataFrame:
    return verify.derived_fields(L.parsed(_t(spark, sf, "extractions").filter("document_type <> 'W2'"))).drop("reserve_total", "bank_total")


@query(
    "SELECT p_partkey // 50 AS record_id, CAST(sum(CAST(p_retailprice AS DECIMAL(18,2))) AS DECIMAL(28,6)) AS reserve_total, CAST(sum(p_size) AS DECIMAL(28,6)) AS bank_total FROM part GROUP BY 1"
)
def derived_reserves(spark: SparkSession, sf: str) -> DataFrame:
    components = _sorted("p_partkey", F.col("p_retailprice").cast("decimal(18,2)").alias("current_balance"))
    bank = _sorted("p_partkey", F.col("p_size").alias("balance"))
    g = _grouped(_t(spark, sf, "part"), "p_partkey", "RESERVE_ALLOCATION", F.struct(components.alias("components"), bank.alias("bank_accounts")))
    return verify.derived_fields(L.parsed(g)).select("record_id", "reserve_total", "bank_total")


_ROOT_SQL = lambda side, *keys: "coalesce(" + ", ".join(Q.amount(Q.scalar_at(p)) for k in keys for p in (k, f"{side}.{k}")) + ")"


@query(
    f"WITH c AS ({Q.section_check()}), {Q.record_cte('document_type <> ' + Q.q('W2'))}, d AS (SELECT record_id, document_type, {_ROOT_SQL('assets', 'total_assets')} AS ta, {_ROOT_SQL('liabilities', 'total_liabilities')} AS tl, {_ROOT_SQL('equity', 'total_equity_reported', 'total_equity')} AS te FROM v WHERE json_type(v) = 'OBJECT'), "
    "n AS (SELECT record_id, count(*) AS n_checked, count(*) FILTER (NOT matches) AS bad FROM c GROUP BY record_id), f AS (SELECT record_id, coalesce(n_checked, 0) AS n_checked, coalesce(bad, 0) + CASE WHEN document_type = 'BALANCE_SHEET' AND abs(ta - (tl + te)) > 0.02 THEN 1 ELSE 0 END AS n_mismatches FROM d LEFT JOIN n USING (record_id)) "
    "SELECT record_id, n_checked, n_mismatches, n_mismatches = 0 AS verified FROM f"
)
def verified_statements(spark: SparkSession, sf: str) -> DataFrame:
    e = _t(spark, sf, "extractions").filter("document_type <> 'W2'")
    n = nested.nodes(e)
    accounts = nested.typed_table(n, "accounts").select("record_id", F.col("parent_path").alias("path"), verify.account_value(F.col("balance"), F.col("amount")).alias("value"))
    return verify.verify_statements(L.parsed(e), nested.typed_table(n, "sections").select("record_id", F.col("node_path").alias("path"), "section_total"), accounts)["verified"]


@query("SELECT record_id, trim(regexp_replace(regexp_replace(trim(data), '^```(?:json)?\\s*', ''), '\\s*```$', '')) AS text FROM extractions")
def strip_fence(spark: SparkSession, sf: str) -> DataFrame:
    return _t(spark, sf, "extractions").select("record_id", X.strip_fence(F.col("data")).alias("text"))


@query(f"WITH {Q.pages_cte()} SELECT file_id, position, regexp_replace(text, '\\b(\\d{{3}})-(\\d{{2}})-(\\d{{4}})\\b', 'XXX-XX-\\3', 'g') AS text FROM pg")
def redact_ssn(spark: SparkSession, sf: str) -> DataFrame:
    return _pages(spark, sf).select("file_id", "position", X.redact_ssn(F.col("text")).alias("text"))


_HASH = "('0x' || md5({}))::UHUGEINT"


def _pool(pool: list[str], col: str, k: int) -> str:
    return f"([{', '.join(map(Q.q, pool))}])[CAST({_HASH.format(f'{col} || {Q.q(str(k))}')} % {len(pool)} AS INTEGER) + 1]"


_H = _HASH.format("name")
_A = _HASH.format("address")


@query(
    f"SELECT party_id, printf('%03d-%02d-%04d', CAST(900 + {_H} % 99 AS INTEGER), CAST(({_H} // 256) % 99 + 1 AS INTEGER), CAST(({_H} // 65536) % 9999 + 1 AS INTEGER)) AS fake_ssn, "
    f"printf('(555) %03d-%04d', CAST({_H} % 900 + 100 AS INTEGER), CAST(({_H} // 4096) % 10000 AS INTEGER)) AS fake_phone, "
    f"{_pool(T.FIRST_NAMES, 'name', 0)} || ' ' || {_pool(T.LAST_NAMES, 'name', 1)} AS fake_name, {_pool(T.COMPANY_WORDS, 'name', 0)} || ' ' || {_pool(T.COMPANY_SUFFIXES, 'name', 1)} AS fake_company, "
    f"CAST({_A} % 9999 + 1 AS VARCHAR) || ' ' || {_pool(T.STREETS, 'address', 0)} || ', ' || {_pool(T.CITIES, 'address', 1)} || ', ' || {_pool(T.STATES, 'address', 2)} || ' ' || CAST({_A} % 90000 + 10000 AS VARCHAR) AS fake_address "
    "FROM parties WHERE name IS NOT NULL AND address IS NOT NULL"
)
def fake_values(spark: SparkSession, sf: str) -> DataFrame:
    n, a = F.col("name"), F.col("address")
    d = _t(spark, sf, "parties").filter("name is not null and address is not null")
    return d.select("party_id", H.fake_ssn(n).alias("fake_ssn"), H.fake_phone(n).alias("fake_phone"), H.fake_name(n).alias("fake_name"), H.fake_company(n).alias("fake_company"), H.fake_address(a).alias("fake_address"))


@query(
    f"SELECT party_id, CASE WHEN trim(coalesce(name, '')) = '' THEN name ELSE {_pool(T.FIRST_NAMES, 'name', 0)} || ' ' || {_pool(T.LAST_NAMES, 'name', 1)} END AS name, "
    f"CASE WHEN coalesce(ssn_last4, '') = '' THEN ssn_last4 ELSE 'XXX-XX-' || printf('%04d', CAST(({_HASH.format('ssn_last4')} // 65536) % 9999 + 1 AS INTEGER)) END AS ssn_last4 FROM parties"
)
def sanitize_records(spark: SparkSession, sf: str) -> DataFrame:
    return sanitize.sanitize_records(_t(spark, sf, "parties").select("party_id", "name", "ssn_last4"), ["name", "ssn_last4"])


_NAME_SQL = f"{_pool(T.FIRST_NAMES, '{x}', 0)} || ' ' || {_pool(T.LAST_NAMES, '{x}', 1)}"
_ADDRESS_SQL = (
    f"CAST({_HASH.format('{x}')} % 9999 + 1 AS VARCHAR) || ' ' || {_pool(T.STREETS, '{x}', 0)} || ', ' || {_pool(T.CITIES, '{x}', 1)} || ', ' || {_pool(T.STATES, '{x}', 2)} || ' ' || CAST({_HASH.format('{x}')} % 90000 + 10000 AS VARCHAR)"
)
_SSN_SQL = f"printf('%03d-%02d-%04d', CAST(900 + {_HASH.format('{x}')} % 99 AS INTEGER), CAST(({_HASH.format('{x}')} // 256) % 99 + 1 AS INTEGER), CAST(({_HASH.format('{x}')} // 65536) % 9999 + 1 AS INTEGER))"
_PHONE_SQL = f"printf('(555) %03d-%04d', CAST({_HASH.format('{x}')} % 900 + 100 AS INTEGER), CAST(({_HASH.format('{x}')} // 4096) % 10000 AS INTEGER))"


def _fill(template: str, x: str) -> str:
    return template.replace("{x}", x)


def _tree_sql(path: str, how: str) -> str:
    x = Q.at(path)
    return f"CASE WHEN json_type(v, '$.{path}') IN ('ARRAY', 'OBJECT') THEN NULL WHEN json_type(v, '$.{path}') = 'VARCHAR' AND trim({x}) <> '' THEN {_fill(how, x)} ELSE {x} END AS {path.replace('.', '_')}"


def _replaced_sql(col: str, pattern: str, how: str) -> str:
    """A pass of function-valued replacement: gaps and matches, zipped."""
    m = f"regexp_extract_all({col}, {Q.q(pattern)})"
    g = f"string_split_regex({col}, {Q.q(pattern)})"
    return f"CASE WHEN {col} IS NULL OR len({m}) = 0 THEN {col} ELSE array_to_string(list_transform(list_zip({g}, {m}), lambda z: z[1] || CASE WHEN z[2] IS NULL THEN '' ELSE {_fill(how, 'z[2]')} END), '') END"


_PASS_SQL = (("ssn", T.SSN, "_SSN"), ("phone", T.PHONE, "_PHONE"), ("address", "(?i)" + T.ADDRESS, "_ADDRESS"))


def _passes_cte() -> str:
    out, col = [f"{Q.pages_cte()}, t0 AS (SELECT file_id, position, text AS x FROM pg)"], 0
    for i, (_, pattern, how) in enumerate(_PASS_SQL):
        out.append(f"t{i + 1} AS (SELECT file_id, position, {_replaced_sql('x', pattern, {'_SSN': _SSN_SQL, '_PHONE': _PHONE_SQL, '_ADDRESS': _ADDRESS_SQL}[how])} AS x FROM t{i})")
    return ", ".join(out)


@query(f"WITH {_passes_cte()} SELECT file_id, position, x AS sanitized FROM t3")
def sanitize_text(spark: SparkSession, sf: str) -> DataFrame:
    return sanitize.sanitize_text(_pages(spark, sf)).select("file_id", "position", "sanitized")


def _log_sql() -> str:
    parts = []
    for i, (kind, pattern, how) in enumerate(_PASS_SQL):
        m = f"regexp_extract_all(x, {Q.q(pattern)})"
        parts.append(f"SELECT file_id, position, {i} AS pass, unnest({m}) AS original, generate_subscripts({m}, 1) AS k FROM t{i}")
    made = {"_SSN": _SSN_SQL, "_PHONE": _PHONE_SQL, "_ADDRESS": _ADDRESS_SQL}
    case = "CASE pass " + " ".join(f"WHEN {i} THEN {_fill(made[how], 'original')}" for i, (_, _, how) in enumerate(_PASS_SQL)) + " END"
    kind = "CASE pass " + " ".join(f"WHEN {i} THEN {Q.q(k)}" for i, (k, _, _) in enumerate(_PASS_SQL)) + " END"
    return (
        f"WITH {_passes_cte()}, m AS ({' UNION ALL '.join(parts)}), d AS (SELECT file_id, position, pass, original, min(k) AS k FROM m GROUP BY ALL) "
        f"SELECT file_id, position, CAST(row_number() OVER (PARTITION BY file_id, position ORDER BY pass, k) - 1 AS INTEGER) AS ord, {kind} AS kind, original, {case} AS replacement FROM d"
    )


@query(_log_sql())
def replacement_log(spark: SparkSession, sf: str) -> DataFrame:
    return sanitize.replacement_log(_pages(spark, sf).withColumn("id", F.struct("file_id", "position")), "id").select("id.file_id", "id.position", "ord", "kind", "original", "replacement")


_TREE = {"employer.name": _NAME_SQL, "employer.address": _ADDRESS_SQL, "employee.name": _NAME_SQL, "employee.address": _ADDRESS_SQL, "employee.ssn_last4": "'XXX-XX-' || right(" + _SSN_SQL + ", 4)"}


@query(f"WITH {Q.record_cte('document_type = ' + Q.q('W2'))} SELECT record_id, {', '.join(_tree_sql(p, how) for p, how in _TREE.items())} FROM v WHERE json_type(v) = 'OBJECT'")
def sanitize_extractions(spark: SparkSession, sf: str) -> DataFrame:
    d = sanitize.sanitize_extractions(_t(spark, sf, "extractions").filter("document_type = 'W2'").select("record_id", "data")).filter("sanitized is not null")
    return L.parsed(d, "sanitized").select("record_id", *[L.at(p).alias(p.replace(".", "_")) for p in _TREE])


# --- verification -------------------------------------------------------------------------------------------------------

_ACCOUNTS_SQL = "acc AS (SELECT n_regionkey AS doc, n_nationkey AS path, CAST(c_acctbal AS DECIMAL(28,6)) AS value FROM customer JOIN nation ON n_nationkey = c_nationkey)"
_SECTIONS_SQL = f"{_ACCOUNTS_SQL}, sec AS (SELECT doc, path, CASE path % 4 WHEN 0 THEN sum(value) WHEN 1 THEN sum(value) + 0.02 WHEN 2 THEN sum(value) + 0.03 END AS section_total FROM acc GROUP BY doc, path)"
_CHECK_SQL = f"{_SECTIONS_SQL}, chk AS (SELECT doc, path, CAST(sum(value) AS DECIMAL(28,6)) AS computed, CAST(any_value(section_total) AS DECIMAL(28,6)) AS reported FROM acc JOIN sec USING (doc, path) WHERE section_total IS NOT NULL GROUP BY doc, path)"


def _accounts(spark: SparkSession, sf: str) -> DataFrame:
    n = F.broadcast(_t(spark, sf, "nation").select("n_nationkey", "n_regionkey"))  # 25 rows at every scale
    return _t(spark, sf, "customer").join(n, F.col("c_nationkey") == F.col("n_nationkey")).select(F.col("n_regionkey").alias("doc"), F.col("n_nationkey").alias("path"), F.col("c_acctbal").cast(verify.MONEY).alias("value"))


def _sections(accounts: DataFrame) -> DataFrame:
    s = accounts.groupBy("doc", "path").agg(F.sum("value").cast(verify.MONEY).alias("s"))
    k = F.col("path") % 4
    return s.select("doc", "path", F.when(k == 0, F.col("s")).when(k == 1, F.col("s") + F.lit("0.02").cast(verify.MONEY)).when(k == 2, F.col("s") + F.lit("0.03").cast(verify.MONEY)).cast(verify.MONEY).alias("section_total"))


@query(f"WITH {_CHECK_SQL} SELECT doc, path, computed, reported, computed - reported AS delta, abs(computed - reported) <= 0.02 AS matches FROM chk")
def section_check(spark: SparkSession, sf: str) -> DataFrame:
    a = _accounts(spark, sf)
    return verify.section_check(_sections(a), a)


@query(f"WITH {_CHECK_SQL} SELECT doc, path, computed, reported, computed - reported AS delta, false AS matches FROM chk WHERE abs(computed - reported) > 0.02")
def mismatches(spark: SparkSession, sf: str) -> DataFrame:
    return verify.mismatches(section_check(spark, sf))


@query(f"WITH {_CHECK_SQL} SELECT doc, count(*) AS n_checked, count(*) FILTER (abs(computed - reported) > 0.02) AS n_mismatches, bool_and(abs(computed - reported) <= 0.02) AS verified FROM chk GROUP BY doc")
def verified_flag(spark: SparkSession, sf: str) -> DataFrame:
    a = _accounts(spark, sf)
    return verify.verified(a.select("doc"), verify.section_check(_sections(a), a))


@query(Q.section_check())
def statement_section_check(spark: SparkSession, sf: str) -> DataFrame:
    """Section totals of the extracted statements against their own accounts."""
    n = nested.nodes(_t(spark, sf, "extractions").filter("document_type <> 'W2'"))
    sections = nested.typed_table(n, "sections").select("record_id", F.col("node_path").alias("path"), "section_total")
    accounts = nested.typed_table(n, "accounts").select("record_id", F.col("parent_path").alias("path"), verify.account_value(F.col("balance"), F.col("amount")).alias("value"))
    return verify.section_check(sections, accounts, ("record_id", "path"))


@query(
    "SELECT CAST(n_regionkey AS INTEGER) AS doc, CAST(100000 - sum(CAST(s_acctbal AS DECIMAL(28,6))) AS DECIMAL(28,6)) AS retained_earnings FROM supplier JOIN nation ON s_nationkey = n_nationkey GROUP BY n_regionkey"
)
def retained_earnings(spark: SparkSession, sf: str) -> DataFrame:
    n = F.broadcast(_t(spark, sf, "nation").select("n_nationkey", "n_regionkey"))
    own = _t(spark, sf, "supplier").join(n, F.col("s_nationkey") == F.col("n_nationkey")).select(F.col("n_regionkey").alias("doc"), F.col("s_acctbal").alias("value"))
    return verify.retained_earnings(own.select("doc").distinct().withColumn("total_equity", F.lit(100000).cast(verify.MONEY)), own)


@query(
    "WITH r AS (SELECT s_nationkey AS doc, sum(CAST(s_acctbal AS DECIMAL(28,6))) AS reserve_total FROM supplier GROUP BY 1), b AS (SELECT c_nationkey AS doc, sum(CAST(c_acctbal AS DECIMAL(28,6))) AS bank_total FROM customer GROUP BY 1) "
    "SELECT doc, CAST(coalesce(reserve_total, 0) AS DECIMAL(28,6)) AS reserve_total, CAST(coalesce(bank_total, 0) AS DECIMAL(28,6)) AS bank_total FROM r FULL JOIN b USING (doc)"
)
def reserve_totals(spark: SparkSession, sf: str) -> DataFrame:
    return verify.reserve_totals(
        _t(spark, sf, "supplier").select(F.col("s_nationkey").alias("doc"), F.col("s_acctbal").alias("current_balance")), _t(spark, sf, "customer").select(F.col("c_nationkey").alias("doc"), F.col("c_acctbal").alias("balance"))
    )


@query(
    "WITH t AS (SELECT s_nationkey AS doc, CASE WHEN s_acctbal > 0 THEN CAST(s_acctbal AS DECIMAL(28,6)) END AS debit, CASE WHEN s_acctbal <= 0 THEN CAST(-s_acctbal AS DECIMAL(28,6)) END AS credit FROM supplier) "
    "SELECT doc, CAST(coalesce(sum(debit), 0) AS DECIMAL(28,6)) AS debits, CAST(coalesce(sum(credit), 0) AS DECIMAL(28,6)) AS credits, abs(coalesce(sum(debit), 0) - coalesce(sum(credit), 0)) <= 0.02 AS balanced FROM t GROUP BY doc"
)
def trial_balance(spark: SparkSession, sf: str) -> DataFrame:
    b = F.col("s_acctbal")
    return verify.trial_balance(_t(spark, sf, "supplier").select(F.col("s_nationkey").alias("doc"), F.when(b > 0, b).alias("debit"), F.when(b <= 0, -b).alias("credit")))


_LEDGER_KEY = "account_number"


@query(
    "WITH d AS (SELECT DISTINCT txn_id, client_code, account_number, posted_at, debit, credit, balance FROM gl_transactions WHERE row_type = 'transaction'), k AS (SELECT *, row_number() OVER (PARTITION BY txn_id ORDER BY posted_at, debit, credit, balance) AS rn FROM d), "
    "w AS (SELECT txn_id, client_code, account_number, CAST(sum(coalesce(CAST(debit AS DECIMAL(28,6)), 0) - coalesce(CAST(credit AS DECIMAL(28,6)), 0)) OVER (PARTITION BY client_code, account_number ORDER BY posted_at, txn_id ROWS UNBOUNDED PRECEDING) AS DECIMAL(28,6)) AS running, "
    "CAST(balance AS DECIMAL(28,6)) AS balance FROM k WHERE rn = 1) SELECT txn_id, running, abs(running - balance) <= 0.02 AS agrees FROM w"
)
def running_balance_check(spark: SparkSession, sf: str) -> DataFrame:
    d = _t(spark, sf, "gl_transactions").filter("row_type = 'transaction'").select("txn_id", "client_code", "account_number", "posted_at", "debit", "credit", "balance").distinct()
    once = merging.keep_first(d, ["txn_id"], ["posted_at", "debit", "credit", "balance"])
    return verify.running_balance(once, ["client_code", "account_number"], ["posted_at", "txn_id"]).select("txn_id", "running", "agrees")


# --- merging ------------------------------------------------------------------------------------------------------------

_PARTS_SQL = (
    "p AS (SELECT client_code AS doc, CAST(txn_id % 7 AS INTEGER) AS chunk_index, account_number, min(account_name) AS account_name, CAST(min(balance) AS DECIMAL(18,2)) AS beginning_balance, "
    "CAST(max(CASE WHEN row_type = 'balance_footer' THEN balance END) AS DECIMAL(18,2)) AS ending_balance, count(*) AS n_transactions FROM gl_transactions GROUP BY 1, 2, 3)"
)


def _parts(spark: SparkSession, sf: str) -> DataFrame:
    g = _t(spark, sf, "gl_transactions")
    return g.groupBy(F.col("client_code").alias("doc"), (F.col("txn_id") % 7).cast("int").alias("chunk_index"), "account_number").agg(
        F.min("account_name").alias("account_name"), F.min("balance").cast("decimal(18,2)").alias("beginning_balance"), F.max(F.when(F.col("row_type") == "balance_footer", F.col("balance"))).cast("decimal(18,2)").alias("ending_balance"), F.count("*").alias("n_transactions")
    )


@query(
    f"WITH {_PARTS_SQL}, k AS (SELECT *, coalesce(nullif(account_number, ''), account_name) AS account_key FROM p), o AS (SELECT *, row_number() OVER (PARTITION BY doc, account_key ORDER BY chunk_index) AS rn, "
    "row_number() OVER (PARTITION BY doc, account_key, ending_balance IS NULL ORDER BY chunk_index DESC) AS re FROM k) "
    "SELECT doc, account_key, min(chunk_index) AS first_chunk, max(CASE WHEN rn = 1 THEN beginning_balance END) AS beginning_balance, max(CASE WHEN re = 1 THEN ending_balance END) AS ending_balance, CAST(sum(n_transactions) AS BIGINT) AS n_transactions FROM o GROUP BY doc, account_key"
)
def merge_ledger(spark: SparkSession, sf: str) -> DataFrame:
    return merging.merge_ledger(_parts(spark, sf)).drop("account_name")


@query(
    "WITH g AS (SELECT client_code AS doc, CAST(txn_id % 7 AS INTEGER) AS chunk_index, *, coalesce(nullif(account_number, ''), account_name) AS account_key FROM gl_transactions) "
    "SELECT doc, account_key, txn_id, CAST(row_number() OVER (PARTITION BY doc, account_key ORDER BY chunk_index, txn_id, posted_at, row_type, debit, credit, balance, memo, name) - 1 AS INTEGER) AS ord, debit, credit FROM g"
)
def merge_transactions(spark: SparkSession, sf: str) -> DataFrame:
    g = _t(spark, sf, "gl_transactions").withColumn("doc", F.col("client_code")).withColumn("chunk_index", (F.col("txn_id") % 7).cast("int"))
    # nulls last, as in SQL
    order = [F.col(c).asc_nulls_last() for c in ("chunk_index", "txn_id", "posted_at", "row_type", "debit", "credit", "balance", "memo", "name")]
    return merging.merge_transactions(g, order=tuple(order)).select("doc", "account_key", "txn_id", "ord", "debit", "credit")


_SEC_PARTS_SQL = "p AS (SELECT o_custkey AS doc, CAST(o_orderkey % 5 AS INTEGER) AS chunk_index, o_orderstatus AS side, o_orderpriority AS section_name, count(*) AS n_accounts, max(CASE WHEN o_orderkey % 3 = 0 THEN CAST(o_totalprice AS DECIMAL(18,2)) END) AS section_total FROM orders GROUP BY 1, 2, 3, 4)"


@query(
    f"WITH {_SEC_PARTS_SQL} SELECT doc, side, section_name, min(chunk_index) AS first_chunk, CAST(sum(n_accounts) AS BIGINT) AS n_accounts, arg_max(section_total, chunk_index) FILTER (section_total IS NOT NULL) AS section_total FROM p GROUP BY ALL"
)
def merge_sections(spark: SparkSession, sf: str) -> DataFrame:
    o = _t(spark, sf, "orders")
    parts = o.groupBy(F.col("o_custkey").alias("doc"), (F.col("o_orderkey") % 5).cast("int").alias("chunk_index"), F.col("o_orderstatus").alias("side"), F.col("o_orderpriority").alias("section_name")).agg(
        F.count("*").alias("n_accounts"), F.max(F.when(F.col("o_orderkey") % 3 == 0, F.col("o_totalprice").cast("decimal(18,2)"))).alias("section_total")
    )
    return merging.merge_sections(parts)


@query(
    "WITH p AS (SELECT client_code AS doc, record_id, CASE WHEN record_id % 3 = 0 THEN document_type WHEN record_id % 3 = 1 THEN '' END AS entity_name FROM extractions) "
    "SELECT doc, coalesce(arg_min(entity_name, record_id) FILTER (entity_name <> ''), (arg_min([entity_name], record_id))[1]) AS entity_name FROM p GROUP BY doc"
)
def merge_entity(spark: SparkSession, sf: str) -> DataFrame:
    m = F.col("record_id") % 3
    p = _t(spark, sf, "extractions").select("record_id", F.col("client_code").alias("doc"), F.when(m == 0, F.col("document_type")).when(m == 1, "").alias("entity_name"))
    return merging.merge_entity(p, order="record_id")


@query(
    "SELECT o_custkey AS doc, CAST(sum(o_orderkey % 100) AS BIGINT) AS prompt_tokens, CAST(sum(o_orderkey % 7) AS BIGINT) AS completion_tokens, CAST(sum(o_orderkey % 2) AS BIGINT) AS retries, count(*) AS calls, arg_max(o_orderstatus, o_orderkey) AS finish_reason FROM orders GROUP BY o_custkey"
)
def merge_usage(spark: SparkSession, sf: str) -> DataFrame:
    k = F.col("o_orderkey")
    p = _t(spark, sf, "orders").select(F.col("o_custkey").alias("doc"), k.alias("chunk_index"), (k % 100).alias("prompt_tokens"), (k % 7).alias("completion_tokens"), (k % 2).alias("retries"), F.col("o_orderstatus").alias("finish_reason"))
    return merging.merge_usage(p)


@query("SELECT c_custkey AS doc, 'EXTRACTION FAILED' AS entity_name FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders)")
def failed_documents(spark: SparkSession, sf: str) -> DataFrame:
    return merging.failed_documents(_t(spark, sf, "customer").select(F.col("c_custkey").alias("doc")), _t(spark, sf, "orders").select(F.col("o_custkey").alias("doc")))


@query(
    "WITH g AS (SELECT txn_id // 50 AS doc, CAST(txn_id % 7 AS INTEGER) AS c, *, coalesce(nullif(coalesce(account_number, ''), ''), account_name, '') AS k FROM gl_transactions), "
    "o AS (SELECT *, row_number() OVER (PARTITION BY doc, k ORDER BY c, txn_id, posted_at, debit, credit, balance, memo, name) AS rn FROM g) "
    "SELECT doc, k AS account_key, count(*) AS n_transactions, CAST(max(CASE WHEN rn = 1 THEN CAST(balance AS DECIMAL(18,2)) END) AS VARCHAR) AS beginning_balance FROM o GROUP BY doc, k"
)
def merge_documents(spark: SparkSession, sf: str) -> DataFrame:
    """Ledger records of seven chunks each, folded to one: accounts meet by number, else name, with the transactions of all chunks."""
    cents = lambda c: F.col(c).cast("decimal(18,2)").cast("string")
    g = _t(spark, sf, "gl_transactions")
    order = F.struct("txn_id", *[F.struct(F.col(c).isNull().alias("n"), F.col(c).alias("v")).alias(c) for c in ("posted_at", "debit", "credit", "balance", "memo", "name")])
    account = F.struct("account_number", "account_name", cents("balance").alias("beginning_balance"), F.array(F.struct("txn_id")).alias("transactions"))
    chunk = g.groupBy(F.expr("txn_id div 50").alias("doc"), (F.col("txn_id") % 7).cast("int").alias("chunk_index")).agg(F.transform(F.array_sort(F.collect_list(F.struct(order.alias("o"), account.alias("a")))), lambda x: x["a"]).alias("accounts"))
    parts = chunk.select("doc", "chunk_index", F.lit("GENERAL_LEDGER").alias("document_type"), F.to_json(F.struct("accounts"), {"ignoreNullFields": "false"}).alias("json"))
    merged = merging.merge_records(parts, ["doc", "document_type"])
    accounts = F.from_json(F.get_json_object("data", "$.accounts"), "array<struct<account_number:string,account_name:string,beginning_balance:string,transactions:array<struct<txn_id:long>>>>")
    d = merged.select("doc", F.inline(accounts))
    return d.select("doc", F.coalesce(F.nullif(F.coalesce("account_number", F.lit("")), F.lit("")), "account_name", F.lit("")).alias("account_key"), F.size("transactions").cast("long").alias("n_transactions"), "beginning_balance")


@query(
    f"WITH {_PARTS_SQL} SELECT doc, account_number, account_name, chunk_index, n_transactions FROM (SELECT *, row_number() OVER (PARTITION BY doc, account_number, account_name ORDER BY chunk_index) AS rn FROM p) WHERE rn = 1"
)
def merge_lines(spark: SparkSession, sf: str) -> DataFrame:
    parts = _parts(spark, sf).withColumn("ord", F.lit(0))
    return merging.merge_lines(parts).select("doc", "account_number", "account_name", "chunk_index", "n_transactions")


@query(
    "WITH p AS (SELECT record_id, client_code AS doc, unnest(metadata.notes) AS note, generate_subscripts(metadata.notes, 1) - 1 AS ord FROM extractions), f AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY doc, note ORDER BY record_id, ord) AS rn FROM p WHERE note IS NOT NULL) WHERE rn = 1) "
    "SELECT doc, row_number() OVER (PARTITION BY doc ORDER BY record_id, ord) - 1 AS ord, note FROM f"
)
def merge_notes(spark: SparkSession, sf: str) -> DataFrame:
    p = _t(spark, sf, "extractions").select("record_id", F.col("client_code").alias("doc"), F.posexplode("metadata.notes").alias("ord", "note"))
    return merging.merge_notes(p, order=("record_id", "ord"))


@query(
    "SELECT client_code AS doc, coalesce(bool_or(metadata.is_corrected), false) AS is_corrected, coalesce(bool_or(metadata.is_void), false) AS is_void FROM extractions GROUP BY client_code"
)
def merge_flags(spark: SparkSession, sf: str) -> DataFrame:
    p = _t(spark, sf, "extractions").select(F.col("client_code").alias("doc"), "metadata.is_corrected", "metadata.is_void")
    return merging.merge_flags(p, ["is_corrected", "is_void"])


@query(
    "WITH o AS (SELECT client_code AS doc, first(document_type ORDER BY record_id) FILTER (document_type IS NOT NULL) AS document_type, first(tax_year ORDER BY record_id) FILTER (tax_year IS NOT NULL) AS tax_year FROM extractions GROUP BY client_code) SELECT * FROM o"
)
def merge_scalars(spark: SparkSession, sf: str) -> DataFrame:
    return merging.merge_scalars(_t(spark, sf, "extractions").withColumnRenamed("client_code", "doc"), ["document_type", "tax_year"], order="record_id")


def _w2_parties(spark: SparkSession, sf: str) -> DataFrame:
    d = L.parsed(_t(spark, sf, "extractions").filter("document_type = 'W2'"))
    return d.select("record_id", "document_type", "tax_year", *[L.at(p).alias(p.replace(".", "_")) for p in ("employer.ein", "employer.name", "employee.ssn_last4", "employee.name")])


@query(
    f"WITH {Q.record_cte('document_type = ' + Q.q('W2'))}, p AS (SELECT record_id, document_type, tax_year, {', '.join(f'{Q.scalar_at(x)} AS ' + x.replace('.', '_') for x in ('employer.ein', 'employer.name', 'employee.ssn_last4', 'employee.name'))} FROM v WHERE json_type(v) = 'OBJECT'), "
    "k AS (SELECT *, row_number() OVER (PARTITION BY coalesce(nullif(employer_ein, ''), nullif(employer_name, '')), coalesce(nullif(employee_ssn_last4, ''), nullif(employee_name, '')), tax_year ORDER BY record_id) AS rn FROM p) SELECT * EXCLUDE (rn) FROM k WHERE rn = 1"
)
def w2_dedup(spark: SparkSession, sf: str) -> DataFrame:
    return merging.dedup_w2(_w2_parties(spark, sf))


# --- layouts ------------------------------------------------------------------------------------------------------------


@query(Q.w2_flat())
def csv_w2_flat(spark: SparkSession, sf: str) -> DataFrame:
    return L.w2_flat(_t(spark, sf, "extractions"))


@query(Q.generic_tax())
def csv_generic_tax(spark: SparkSession, sf: str) -> DataFrame:
    return L.generic_tax(_t(spark, sf, "extractions"))


@query(Q.account_rows())
def csv_account_rows(spark: SparkSession, sf: str) -> DataFrame:
    return L.account_rows(_t(spark, sf, "extractions"))


def _grouped(df: DataFrame, key: str, kind: str, data: F.Column) -> DataFrame:
    """Records of a type made of each fifty rows, to exercise layouts of types that the extractions don't hold."""
    return df.groupBy(F.expr(f"{key} div 50").alias("record_id")).agg(F.to_json(data, {"ignoreNullFields": "false"}).alias("data")).select("record_id", F.lit(kind).alias("document_type"), "data")


def _sorted(order: str, *cells: F.Column) -> F.Column:
    return F.transform(F.array_sort(F.collect_list(F.struct(F.col(order).alias("_o"), F.struct(*cells).alias("_c")))), lambda x: x["_c"])


_HEAD_SQL = "'' AS software, 'Accrual' AS accounting_basis, '' AS period_start, '2024-12-31' AS period_end"


def _entity(name: F.Column) -> F.Column:
    return F.struct(name.alias("name"), F.lit("Accrual").alias("accounting_basis"), F.lit("2024-12-31").alias("period_end"))


@query(
    f"SELECT s_suppkey // 50 AS record_id, 'TRIAL_BALANCE' AS document_type, 'Suppliers' AS entity_name, {_HEAD_SQL}, 'ACCOUNTS' AS section, '' AS subsection, CAST(s_suppkey AS VARCHAR) AS account_number, s_name AS account_name, 'account' AS row_type, "
    "CASE WHEN s_acctbal > 0 THEN CAST(s_acctbal AS DECIMAL(18,2)) END AS debit, CASE WHEN s_acctbal <= 0 THEN CAST(-s_acctbal AS DECIMAL(18,2)) END AS credit, "
    "'accounts[' || (row_number() OVER (PARTITION BY s_suppkey // 50 ORDER BY s_suppkey) - 1) || ']' AS node_path FROM supplier"
)
def csv_trial_balance(spark: SparkSession, sf: str) -> DataFrame:
    b = F.col("s_acctbal").cast("decimal(18,2)")
    accounts = _sorted("s_suppkey", F.col("s_suppkey").cast("string").alias("account_number"), F.col("s_name").alias("account_name"), F.when(b > 0, b).alias("debit"), F.when(b <= 0, -b).alias("credit"))
    return L.account_rows(_grouped(_t(spark, sf, "supplier"), "s_suppkey", "TRIAL_BALANCE", F.struct(_entity(F.lit("Suppliers")).alias("entity"), accounts.alias("accounts"))))


@query(
    f"WITH p AS (SELECT *, row_number() OVER (PARTITION BY p_partkey // 50 ORDER BY p_partkey) - 1 AS i FROM part), h AS (SELECT p_partkey // 50 AS record_id, 'RESERVE_ALLOCATION' AS document_type, 'Parts' AS entity_name, {_HEAD_SQL}, * FROM p) "
    "SELECT record_id, document_type, entity_name, software, accounting_basis, period_start, period_end, 'COMPONENTS' AS section, '' AS subsection, CAST(p_partkey AS VARCHAR) AS account_number, p_name AS account_name, 'account' AS row_type, CAST(p_retailprice AS DECIMAL(18,2)) AS balance, 'components[' || i || ']' AS node_path FROM h "
    "UNION ALL SELECT record_id, document_type, entity_name, software, accounting_basis, period_start, period_end, 'BANK_ACCOUNTS', '', '', p_brand, 'account', CAST(p_size AS DECIMAL(18,2)), 'bank_accounts[' || i || ']' FROM h"
)
def csv_reserve(spark: SparkSession, sf: str) -> DataFrame:
    components = _sorted("p_partkey", F.col("p_partkey").cast("string").alias("account_number"), F.col("p_name").alias("component_name"), F.col("p_retailprice").cast("decimal(18,2)").alias("current_balance"))
    bank = _sorted("p_partkey", F.col("p_brand").alias("account_name"), F.col("p_size").alias("balance"))
    return L.account_rows(_grouped(_t(spark, sf, "part"), "p_partkey", "RESERVE_ALLOCATION", F.struct(_entity(F.lit("Parts")).alias("entity"), components.alias("components"), bank.alias("bank_accounts"))))


@query(
    f"WITH o AS (SELECT *, row_number() OVER (PARTITION BY o_orderkey // 50 ORDER BY o_orderkey) - 1 AS i FROM orders) SELECT o_orderkey // 50 AS record_id, 'BUDGET_VS_ACTUAL' AS document_type, 'Orders' AS entity_name, {_HEAD_SQL}, o_orderpriority AS section, '' AS subsection, "
    "CAST(o_orderkey AS VARCHAR) AS account_number, o_orderstatus AS account_name, CASE WHEN o_orderkey % 3 = 0 THEN 'total' ELSE 'account' END AS row_type, CAST(o_totalprice AS DECIMAL(18,2)) AS ytd_actual, CASE WHEN o_orderkey % 2 = 0 THEN CAST(o_totalprice + 1 AS DECIMAL(18,2)) END AS ytd_budget, 'line_items[' || i || ']' AS node_path FROM o"
)
def csv_line_items(spark: SparkSession, sf: str) -> DataFrame:
    price = F.col("o_totalprice").cast("decimal(18,2)")
    values = F.struct(price.alias("ytd_actual"), F.when(F.col("o_orderkey") % 2 == 0, (price + 1).cast("decimal(18,2)")).alias("ytd_budget"))
    items = _sorted("o_orderkey", F.col("o_orderkey").cast("string").alias("account_number"), F.col("o_orderstatus").alias("account_name"), F.col("o_orderpriority").alias("section"), F.when(F.col("o_orderkey") % 3 == 0, "total").alias("row_type"), values.alias("values"))
    columns = F.array(*[F.struct(F.lit(k).alias("key")) for k in ("ytd_actual", "ytd_budget")])
    return L.account_rows(_grouped(_t(spark, sf, "orders"), "o_orderkey", "BUDGET_VS_ACTUAL", F.struct(_entity(F.lit("Orders")).alias("entity"), columns.alias("columns"), items.alias("line_items"))))


_GL_LINES = "SELECT txn_id // 50 AS record_id, client_code, row_number() OVER (PARTITION BY txn_id // 50 ORDER BY txn_id, posted_at, debit, credit, balance, memo, name) - 1 AS i, g.* EXCLUDE (client_code) FROM gl_transactions g"


@query(
    f"WITH g AS ({_GL_LINES}), m AS (SELECT CAST(debit AS DECIMAL(18,2)) AS d, CAST(credit AS DECIMAL(18,2)) AS c, CAST(balance AS DECIMAL(18,2)) AS b, 'Ledger' AS entity_name, coalesce(account_number, '') AS n, coalesce(account_name, '') AS a, * FROM g) "
    "SELECT record_id, entity_name, n AS account_number, a AS account_name, '' AS date, '' AS type, '' AS number, '' AS name, '' AS memo, '' AS split, '' AS debit, '' AS credit, coalesce(CAST(b AS VARCHAR), '') AS balance, 'balance_header' AS row_type FROM m "
    "UNION ALL SELECT record_id, entity_name, n, a, coalesce(txn_date, ''), coalesce(txn_type, ''), coalesce(txn_number, ''), coalesce(name, ''), coalesce(memo, ''), coalesce(split_account, ''), coalesce(CAST(d AS VARCHAR), ''), coalesce(CAST(c AS VARCHAR), ''), coalesce(CAST(b AS VARCHAR), ''), coalesce(row_type, 'transaction') FROM m "
    "UNION ALL SELECT record_id, entity_name, n, a, '', '', '', '', '', '', '', '', '', 'balance_footer' FROM m"
)
def csv_ledger_records(spark: SparkSession, sf: str) -> DataFrame:
    cents = lambda c: F.col(c).cast("decimal(18,2)").cast("string")
    fields = {"date": "txn_date", "type": "txn_type", "number": "txn_number", "name": "name", "memo": "memo", "split": "split_account", "row_type": "row_type"}
    txn = F.struct(*[F.col(c).alias(k) for k, c in fields.items()], *[cents(c).alias(c) for c in ("debit", "credit", "balance")])
    accounts = _sorted("txn_id", F.col("account_number"), F.col("account_name"), cents("balance").alias("beginning_balance"), F.array(txn).alias("transactions"))
    g = _grouped(_t(spark, sf, "gl_transactions"), "txn_id", "GENERAL_LEDGER", F.struct(_entity(F.lit("Ledger")).alias("entity"), accounts.alias("accounts")))
    return L.ledger_records(g).drop("ord")


@query(
    "WITH c AS (SELECT c_custkey // 50 AS record_id, CAST(c_acctbal AS DECIMAL(18,2)) AS v, * FROM customer) SELECT record_id, 'Customers' AS entity_name, 'AP' AS report_type, c_name AS name, CAST(v AS VARCHAR) AS current, '' AS \"1_to_30\", CAST(v + 1 AS VARCHAR) AS \"31_to_60\", '' AS \"61_to_90\", '' AS over_90, CAST(v AS VARCHAR) AS total, 'row' AS row_type FROM c "
    "UNION ALL SELECT record_id, 'Customers', 'AP', 'TOTAL', CAST(sum(v) AS VARCHAR), '', '', '', '', '', 'total' FROM c GROUP BY record_id"
)
def csv_aging_records(spark: SparkSession, sf: str) -> DataFrame:
    v = F.col("c_acctbal").cast("decimal(18,2)")
    rows = _sorted("c_custkey", F.col("c_name").alias("name"), v.cast("string").alias("current"), (v + 1).cast("decimal(18,2)").cast("string").alias("days_31_60"), v.cast("string").alias("total"))
    data = F.struct(_entity(F.lit("Customers")).alias("entity"), F.lit("AP").alias("report_type"), rows.alias("rows"), F.struct(F.sum(v).cast("string").alias("current")).alias("totals"))
    return L.aging_records(_grouped(_t(spark, sf, "customer"), "c_custkey", "ACCOUNTS_PAYABLE_AGING", data)).drop("ord")


@query(Q.import_w2())
def lacerte_w2(spark: SparkSession, sf: str) -> DataFrame:
    return L.import_w2(_t(spark, sf, "extractions"))


@query(Q.exchange())
def txf_records(spark: SparkSession, sf: str) -> DataFrame:
    return L.exchange_records(_t(spark, sf, "extractions"))


@query(Q.exchange_lines("01/31/2026", "ledgerloom"))
def txf_lines(spark: SparkSession, sf: str) -> DataFrame:
    return L.exchange_lines(_t(spark, sf, "extractions"), "01/31/2026")


@query()
def json_documents(spark: SparkSession, sf: str) -> DataFrame:
    return L.json_text(_t(spark, sf, "extractions"))


_FORMS_1099 = ("1099-NEC", "1099-INT", "1099-DIV", "1099-R")


def _orders_as_1099(spark: SparkSession, sf: str) -> DataFrame:
    """1099 records made of orders, to exercise the import layouts."""
    o = _t(spark, sf, "orders").join(_t(spark, sf, "customer"), F.col("o_custkey") == F.col("c_custkey"))
    amount = F.col("o_totalprice").cast("decimal(18,2)")
    data = F.struct(
        F.struct(F.col("c_name").alias("name"), F.lpad(F.col("c_custkey").cast("string"), 9, "0").alias("tin")).alias("payer"),
        F.struct(F.right(F.col("o_orderkey").cast("string"), F.lit(4)).alias("tin_last4")).alias("recipient"),
        *[amount.alias(f) for f in ("box1_nonemployee_compensation", "box1_interest_income", "box1a_total_ordinary_dividends", "box1_gross_distribution")],
        F.array(F.struct(F.lit("TX").alias("state_abbr"), amount.alias("box6_state_withheld"))).alias("state"),
    )
    kind = F.element_at(F.array(*[F.lit(k) for k in _FORMS_1099]), (F.col("o_orderkey") % 4 + 1).cast("int"))
    return o.select(F.col("o_orderkey").alias("record_id"), kind.alias("document_type"), F.lit(2024).alias("tax_year"), F.to_json(data).alias("data"))


def _line_1099(kind: str) -> str:
    money = "printf('%.2f', CAST(CAST(o_totalprice AS DECIMAL(18,2)) AS DOUBLE))"
    known = ("box1_nonemployee_compensation", "box1_interest_income", "box1a_total_ordinary_dividends", "box1_gross_distribution", "state[0].box6_state_withheld")
    cells = [money if how == "money" and path in known else "'0.00'" if how == "money" else "'TX'" if path == "state[0].state_abbr" else "''" for path, how in L.IMPORT_FORMS[kind]]
    return f"WHEN {Q.q(kind)} THEN concat_ws(chr(9), 'XXXXX' || right(CAST(o_orderkey AS VARCHAR), 4), c_name, lpad(CAST(c_custkey AS VARCHAR), 9, '0'), {', '.join(cells)})"


@query(
    f"WITH r AS (SELECT *, ([{', '.join(map(Q.q, _FORMS_1099))}])[o_orderkey % 4 + 1] AS kind FROM orders JOIN customer ON o_custkey = c_custkey) SELECT o_orderkey AS record_id, CASE kind {' '.join(map(_line_1099, _FORMS_1099))} END AS line FROM r"
)
def lacerte_1099(spark: SparkSession, sf: str) -> DataFrame:
    return L.import_1099(_orders_as_1099(spark, sf))


_NUMBER_OF = lambda n: f"lpad(CAST({_HASH.format('name')} % {10**n} AS VARCHAR), {n}, '0')"


@query("SELECT party_id, CASE CAST(" + _H + " % 6 + 6 AS INTEGER) " + " ".join(f"WHEN {n} THEN {_NUMBER_OF(n)}" for n in range(6, 12)) + " END AS number FROM parties")
def fake_account_number(spark: SparkSession, sf: str) -> DataFrame:
    return _t(spark, sf, "parties").select("party_id", H.fake_account_number(F.col("name")).alias("number"))


@query(
    "SELECT o_orderkey, CAST(CASE WHEN o_orderkey % 4 = 0 THEN 1999 WHEN TRY_CAST(regexp_extract(e, '^(\\d{4})', 1) AS INTEGER) BETWEEN 2010 AND 2035 THEN TRY_CAST(regexp_extract(e, '^(\\d{4})', 1) AS INTEGER) WHEN TRY_CAST(regexp_extract(s, '^(\\d{4})', 1) AS INTEGER) BETWEEN 2010 AND 2035 THEN TRY_CAST(regexp_extract(s, '^(\\d{4})', 1) AS INTEGER) END AS INTEGER) AS tax_year "
    "FROM (SELECT o_orderkey, CASE WHEN o_orderkey % 3 = 0 THEN (2000 + o_orderkey % 40) || '-12-31' ELSE 'n/a' END AS e, CAST(o_orderdate AS DATE) + INTERVAL 7300 DAY AS d, strftime(CAST(o_orderdate AS DATE) + INTERVAL 7300 DAY, '%Y-%m-%d') AS s FROM orders)"
)
def period_year(spark: SparkSession, sf: str) -> DataFrame:
    k = F.col("o_orderkey")
    end = F.when(k % 3 == 0, F.concat((2000 + k % 40).cast("string"), F.lit("-12-31"))).otherwise("n/a")
    start = F.date_format(F.date_add(F.col("o_orderdate").cast("date"), 7300), "yyyy-MM-dd")
    return _t(spark, sf, "orders").select("o_orderkey", X.period_year(F.when(k % 4 == 0, "1999"), end, start).alias("tax_year"))


@query(
    f"WITH {Q.sections_cte()}, j AS (SELECT file_id, section_no, document_type, pg.position, page, text FROM pg JOIN sec USING (file_id) WHERE pg.position BETWEEN start_position AND end_position AND trim(regexp_replace(text, '\\s+', ' ', 'g')) <> '') "
    "SELECT file_id, section_no, document_type, string_agg('--- PAGE ' || coalesce(CAST(page AS VARCHAR), '?') || ' ---' || chr(10) || text, chr(10) ORDER BY position) AS text FROM j GROUP BY ALL"
)
def section_texts(spark: SparkSession, sf: str) -> DataFrame:
    return sectionize.section_texts(_t(spark, sf, "files"))


@query(
    "SELECT txn_id, coalesce(client_code, '') AS entity_name, coalesce(account_number, '') AS account_number, coalesce(account_name, '') AS account_name, coalesce(txn_date, '') AS date, coalesce(txn_type, '') AS type, coalesce(txn_number, '') AS number, "
    "coalesce(name, '') AS name, coalesce(memo, '') AS memo, coalesce(split_account, '') AS split, coalesce(printf('%.2f', debit), '') AS debit, coalesce(printf('%.2f', credit), '') AS credit, coalesce(printf('%.2f', balance), '') AS balance, row_type FROM gl_transactions"
)
def csv_ledger_rows(spark: SparkSession, sf: str) -> DataFrame:
    return L.ledger_rows(_t(spark, sf, "gl_transactions"))


_AGE = "date_diff('day', CAST(o_orderdate AS DATE), DATE '1998-08-02')"
_AGING_SQL = (
    f"i AS (SELECT c_mktsegment AS report, c_name AS name, CAST(o_totalprice AS DECIMAL(18,2)) AS amount, CASE WHEN {_AGE} <= 0 THEN 'current' WHEN {_AGE} <= 30 THEN '1_to_30' WHEN {_AGE} <= 60 THEN '31_to_60' WHEN {_AGE} <= 90 THEN '61_to_90' ELSE 'over_90' END AS bucket "
    "FROM orders JOIN customer ON o_custkey = c_custkey)"
)
_AGING_COLS = ", ".join(f"CAST(coalesce(sum(CASE WHEN bucket = {Q.q(b)} THEN amount END), 0) AS DECIMAL(18,2)) AS b_{b}" for b in L.AGING_BUCKETS)


@query(
    f"WITH {_AGING_SQL} SELECT report, name, {_AGING_COLS}, CAST(sum(amount) AS DECIMAL(18,2)) AS total, 'row' AS row_type FROM i GROUP BY report, name UNION ALL SELECT report, 'TOTAL' AS name, {_AGING_COLS}, CAST(sum(amount) AS DECIMAL(18,2)) AS total, 'total' AS row_type FROM i GROUP BY report"
)
def csv_aging_rows(spark: SparkSession, sf: str) -> DataFrame:
    age = F.date_diff(F.lit("1998-08-02").cast("date"), F.col("o_orderdate").cast("date"))
    bucket = F.when(age <= 0, "current").when(age <= 30, "1_to_30").when(age <= 60, "31_to_60").when(age <= 90, "61_to_90").otherwise("over_90")
    o = _t(spark, sf, "orders").join(_t(spark, sf, "customer"), F.col("o_custkey") == F.col("c_custkey"))
    return L.aging_rows(o.select(F.col("c_mktsegment").alias("report"), F.col("c_name").alias("name"), bucket.alias("bucket"), F.col("o_totalprice").cast("decimal(18,2)").alias("amount")), ["report"])


@query(
    "SELECT CAST(row_number() OVER (ORDER BY min(l_orderkey), min(l_linenumber), l_returnflag || l_linestatus) - 1 AS INTEGER) AS ord, l_returnflag || l_linestatus AS key FROM (SELECT *, min(l_linenumber) OVER (PARTITION BY l_returnflag, l_linestatus, l_orderkey) AS ml FROM lineitem) "
    "WHERE (l_returnflag || l_linestatus, l_orderkey) IN (SELECT l_returnflag || l_linestatus, min(l_orderkey) FROM lineitem GROUP BY 1) GROUP BY l_returnflag, l_linestatus"
)
def period_columns(spark: SparkSession, sf: str) -> DataFrame:
    li = _t(spark, sf, "lineitem").select(F.col("l_orderkey").alias("doc"), F.col("l_linenumber").alias("ord"), F.concat("l_returnflag", "l_linestatus").alias("key"))
    return L.period_columns(li)


# --- sources ------------------------------------------------------------------------------------------------------------

_CELLS = "SELECT p_brand AS sheet, CAST(p_partkey AS INTEGER) AS row, CAST(p_size % 3 AS INTEGER) AS col, p_name AS text, CAST(NULL AS DOUBLE) AS number FROM part UNION ALL SELECT p_brand, CAST(p_partkey AS INTEGER), CAST(p_size % 3 + 1 AS INTEGER), NULL, CAST(p_size AS DOUBLE) FROM part"


@query("SELECT p_brand AS sheet, CAST(p_partkey AS INTEGER) AS row, repeat('  ', CAST(p_size % 3 AS INTEGER)) || trim(p_name) || chr(9) || CAST(p_size AS VARCHAR) AS line FROM part")
def xlsx_lines(spark: SparkSession, sf: str) -> DataFrame:
    p = _t(spark, sf, "part")
    base = p.select(F.col("p_brand").alias("sheet"), F.col("p_partkey").cast("int").alias("row"), (F.col("p_size") % 3).cast("int").alias("col"), "p_name", F.col("p_size").cast("double").alias("n"))
    cells = base.select("sheet", "row", "col", F.col("p_name").alias("text"), F.lit(None).cast("double").alias("number")).unionByName(base.select("sheet", "row", (F.col("col") + 1).alias("col"), F.lit(None).cast("string").alias("text"), F.col("n").alias("number")))
    return xlsx.sheet_lines(cells, ["sheet"])


@query(
    "WITH w AS (SELECT l_orderkey AS page, CAST(round_even(l_quantity / 3, 0) * 3 AS INTEGER) AS y, l_linenumber AS ord, l_discount AS x0, l_shipmode AS text FROM (SELECT *, l_returnflag || l_linestatus AS l_shipmode FROM lineitem)) "
    "SELECT page, y, string_agg(text, '  ' ORDER BY x0, ord, text) AS line FROM w GROUP BY page, y"
)
def word_lines(spark: SparkSession, sf: str) -> DataFrame:
    words = _t(spark, sf, "lineitem").select(F.col("l_orderkey").alias("page"), F.col("l_quantity").alias("top"), F.col("l_discount").alias("x0"), F.col("l_linenumber").alias("ord"), F.concat("l_returnflag", "l_linestatus").alias("text"))
    return S.word_lines(words, ["page"])


@query("SELECT l_orderkey AS page, avg(l_discount) AS confidence, avg(l_discount) < 0.05 AS doubtful FROM lineitem GROUP BY 1")
def page_confidence(spark: SparkSession, sf: str) -> DataFrame:
    return S.page_confidence(_t(spark, sf, "lineitem").select(F.col("l_orderkey").alias("page"), F.col("l_discount").cast("double").alias("confidence")), ["page"], 0.05)


@query("SELECT o_orderkey, concat_ws('  ', o_orderstatus, '', o_orderpriority) || chr(10) || concat_ws('  ', CAST(o_custkey AS VARCHAR), coalesce(o_clerk, '')) AS text FROM (SELECT *, CASE WHEN o_orderkey % 2 = 0 THEN o_orderpriority END AS o_clerk FROM orders)")
def table_text(spark: SparkSession, sf: str) -> DataFrame:
    rows = F.array(F.array("o_orderstatus", F.lit(None).cast("string"), "o_orderpriority"), F.array(F.col("o_custkey").cast("string"), F.when(F.col("o_orderkey") % 2 == 0, F.col("o_orderpriority"))))
    return _t(spark, sf, "orders").select("o_orderkey", S.table_text(rows).alias("text"))


@query(
    "SELECT p_partkey, p_size % 3 = 0 AND p_partkey % 2 = 0 AS bad FROM part"
)
def bad_fonts(spark: SparkSession, sf: str) -> DataFrame:
    """Font listings of a probe: broken where a two-byte font has no character map."""
    p = F.col("p_partkey")
    font = F.when(F.col("p_size") % 3 == 0, "Identity-H").otherwise("WinAnsi")
    listing = F.concat(F.lit("name type encoding emb sub uni object ID\n----\nABC+Font CID TrueType "), font, F.lit(" yes yes "), F.when(p % 2 == 0, "no").otherwise("yes"), F.lit(" 12 0\nOther Type 1 WinAnsi no no no 5 0"))
    return _t(spark, sf, "part").select("p_partkey", S.bad_fonts(listing).alias("bad"))


_MADE_PAGES = "SELECT o_orderkey // 7 AS file, CAST(o_orderkey % 7 AS INTEGER) AS page, CASE WHEN o_orderkey % 3 = 0 THEN '' ELSE repeat(o_orderpriority || ' ', 12) END AS text FROM orders"


@query(f"WITH p AS ({_MADE_PAGES}), m AS (SELECT *, length(trim(regexp_replace(text, '\\s+', ' ', 'g'))) >= {T.TEXT_PAGE_CHARS} AS ok FROM p) SELECT file, page, CASE WHEN ok THEN text ELSE 'image ' || file || '/' || page END AS text, CASE WHEN ok THEN 'text' ELSE 'ocr' END AS route FROM m")
def gathered_pages(spark: SparkSession, sf: str) -> DataFrame:
    """Text pages from the text reader, the others from the image reader, as one table; the readers here read made-up files."""
    o = _t(spark, sf, "orders").select(F.expr("o_orderkey div 7").alias("file"), (F.col("o_orderkey") % 7).cast("int").alias("page"), F.when(F.col("o_orderkey") % 3 == 0, "").otherwise(F.repeat(F.concat("o_orderpriority", F.lit(" ")), 12)).alias("text"))
    files = o.groupBy("file").agg(F.to_json(F.collect_list(F.struct("page", "text"))).cast("binary").alias("content")).select(F.col("file").cast("string").alias("path"), F.to_binary(F.concat(F.lit("{\"file\":"), F.col("file").cast("string"), F.lit(",\"pages\":"), F.col("content").cast("string"), F.lit("}")), F.lit("utf-8")).alias("content"))

    def text_layer(content: bytes) -> list:
        import json

        return [(p["page"], p["text"], None, None) for p in json.loads(content)["pages"]]

    def images(content: bytes) -> list:
        import json

        d = json.loads(content)
        return [(p["page"], f"image {d['file']}/{p['page']}", 0.9, False) for p in d["pages"]]

    S.register_reader("made-text", text_layer)
    S.register_reader("made-image", images)
    return S.gather(files, "made-text", "made-image").select(F.col("path").cast("long").alias("file"), "page", "text", "route")


@query(f"WITH {Q.pages_cte()}, m AS (SELECT *, {Q.meaningful_length()} AS n FROM pg) SELECT file_id, position, page, CASE WHEN n >= {T.TEXT_PAGE_CHARS} THEN 'text' ELSE 'image' END AS page_type, CASE WHEN n >= {T.TEXT_PAGE_CHARS} THEN 'text' ELSE 'ocr' END AS route FROM m")
def page_routes(spark: SparkSession, sf: str) -> DataFrame:
    return S.route(_pages(spark, sf)).drop("text")


# --- event windows (an extension) ----------------------------------------------------------------------------------------


@query("SELECT time_bucket(INTERVAL 1 HOUR, ts) AS window_start, event_type, count(*) AS n, sum(value) AS total FROM events GROUP BY ALL")
def events_tumbling(spark: SparkSession, sf: str) -> DataFrame:
    return watch.tumbling(_t(spark, sf, "events"))


@query(
    "WITH s AS (SELECT event_type, unnest([time_bucket(INTERVAL 15 MINUTE, ts) - k * INTERVAL 15 MINUTE for k in range(4)]) AS window_start FROM events) SELECT window_start, event_type, count(*) AS n FROM s GROUP BY ALL"
)
def events_sliding(spark: SparkSession, sf: str) -> DataFrame:
    return watch.sliding(_t(spark, sf, "events"))


@query(
    "WITH g AS (SELECT *, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts) < INTERVAL 30 MINUTE THEN 0 ELSE 1 END AS new FROM events), s AS (SELECT *, sum(new) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS k FROM g) "
    "SELECT user_id, min(ts) AS session_start, max(ts) + INTERVAL 30 MINUTE AS session_end, count(*) AS n FROM s GROUP BY user_id, k"
)
def events_sessions(spark: SparkSession, sf: str) -> DataFrame:
    return watch.sessions(_t(spark, sf, "events"))


# --- flagship -----------------------------------------------------------------------------------------------------------


@query(Q.flagship())
def detect_documents(spark: SparkSession, sf: str) -> DataFrame:
    return flagship(spark, sf)


def flagship(spark: SparkSession, sf: str) -> DataFrame:
    """Type, family, year, records and phone numbers of every document: one scan, no shuffle."""
    d = classify.detect(_docs(spark, sf))
    phones = F.size(F.regexp_extract_all(F.coalesce("text", F.lit("")), F.lit(T.PHONE), 0))
    return d.select("doc_id", "document_type", "document_family", "confidence", "tax_year", "estimated_record_count", phones.alias("n_phones"))
