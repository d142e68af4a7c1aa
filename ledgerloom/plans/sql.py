"""SQL texts that must give the same rows as the queries, made from the same fixed tables."""

from __future__ import annotations

from ..functions import tables as T
from ..functions.text import WHITE
from ..operators import nested, sectionize
from ..sinks import layouts as L


def q(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def _re2(pattern: str) -> str:
    """The one look-ahead of the tables written out."""
    return pattern.replace("(?!.(?:t|e|c|f|ma|q))", r"(?:$|\n|.(?:$|[^tecfqm]|m(?:$|[^a])))")


def hit(pattern: str, col: str = "low") -> str:
    return f"coalesce(regexp_matches({col}, {q(_re2(pattern))}), false)"


def number(w: float) -> str:
    return f"CAST({w} AS DOUBLE)"


def tax_cte() -> str:
    """``raw`` (sums), then ``fixed`` (after the resolvers): one column s0.. for each type, null where absent."""
    kinds = list(dict.fromkeys(k for k, _, _ in T.TAX_SIGNATURES))
    sums = {k: " + ".join(f"CASE WHEN {hit(p)} THEN {number(w)} ELSE {number(0.0)} END" for kk, w, p in T.TAX_SIGNATURES if kk == k) for k in kinds}
    raw = ", ".join(f"least({number(1.0)}, {s}) AS r{i}" for i, s in enumerate(sums.values()))
    at = {k: f"r{i}" for i, k in enumerate(kinds)}
    fixed = {k: f"CASE WHEN {at[k]} > 0 THEN {at[k]} END" for k in kinds}
    fixed["1098"] = f"CASE WHEN {at['1098']} > 0 AND ({at['1098-T']} >= 0.7 OR {at['1098-E']} >= 0.7) THEN {number(0.0)} WHEN {at['1098']} > 0 THEN {at['1098']} END"
    fixed["1099-MISC"] = f"CASE WHEN {at['1099-MISC']} > 0 AND NOT {hit(r'nonemployee\s+compensation')} THEN {at['1099-MISC']} END"
    fixed["1099-NEC"] = f"CASE WHEN {at['1099-NEC']} > 0 AND NOT {hit(r'box\s*1\b.*rents\b')} THEN {at['1099-NEC']} END"
    k1 = ["K-1 1065", "K-1 1120-S", "K-1 1041"]
    best = f"greatest({', '.join(at[k] for k in k1)})"
    for i, k in enumerate(k1):
        first = " AND ".join([f"{at[k]} = {best}", *[f"{at[b]} < {best}" for b in k1[:i]]])
        fixed[k] = f"CASE WHEN {at[k]} > 0 THEN CASE WHEN {first} THEN {at[k]} ELSE {number(0.0)} END END"
    cols = ", ".join(f"{c} AS s{i}" for i, c in enumerate(fixed.values()))
    long = " UNION ALL ".join(f"SELECT doc_id, {q(k)} AS type, s{i} AS score, {i} AS ord FROM fixed WHERE s{i} IS NOT NULL" for i, k in enumerate(kinds))
    return f"""d AS (SELECT doc_id, text, lower(text) AS low FROM documents), raw AS (SELECT *, {raw} FROM d), fixed AS (SELECT *, {cols} FROM raw), long AS ({long})"""


def year_sql(col: str = "text") -> str:
    lo, hi = T.YEARS
    tries = ", ".join(f"CASE WHEN TRY_CAST(regexp_extract({col}, {q('(?i)' + p)}, 1) AS INTEGER) BETWEEN {lo} AND {hi} THEN TRY_CAST(regexp_extract({col}, {q('(?i)' + p)}, 1) AS INTEGER) END" for p in T.YEAR_PATTERNS)
    rest = f"list_filter(list_transform(regexp_extract_all({col}, {q(chr(92) + 'b(20' + chr(92) + 'd{2})' + chr(92) + 'b')}, 1), lambda x: CAST(x AS INTEGER)), lambda y: y BETWEEN {lo} AND {hi})[1]"
    return f"coalesce({tries}, {rest})"


def tax_detect() -> str:
    issuer = "coalesce(" + ", ".join(f"CASE WHEN {hit(p, 'd.low')} THEN {q(n)} END" for n, p in T.ISSUERS) + ")"
    summary = " OR ".join(hit(p, "d.low") for p in T.SUMMARY_SIGNS)
    ssn = r"regexp_extract_all(d.text, '\b\d{3}-\d{2}-\d{4}\b')"
    return f"""WITH {tax_cte()},
ranked AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY score DESC, ord) AS rn FROM long),
top AS (SELECT doc_id, type, score FROM ranked WHERE rn = 1 AND score >= 0.5),
t AS (SELECT d.doc_id, coalesce(top.type, 'UNKNOWN') AS document_type, coalesce(top.score, 0.0::DOUBLE) AS confidence, {year_sql('d.text')} AS tax_year, {issuer} AS issuer_software, ({summary}) AS is_summary_sheet,
  len({ssn}) AS n, len(list_distinct({ssn})) AS u FROM d LEFT JOIN top USING (doc_id)),
c AS (SELECT *, CAST(CASE WHEN document_type = 'UNKNOWN' OR n IS NULL OR n = 0 THEN 1 WHEN document_type = 'W2' AND n <> u THEN greatest(1, round_even(n / 4, 0)) ELSE u END AS INTEGER) AS estimated_record_count FROM t),
run AS (SELECT c.doc_id, arg_min(r.type, r.rn) AS runner_up, arg_min(r.score, r.rn) AS runner_up_score FROM c JOIN ranked r ON r.doc_id = c.doc_id AND r.type <> c.document_type GROUP BY c.doc_id)
SELECT c.doc_id, document_type, confidence, tax_year, issuer_software, is_summary_sheet, estimated_record_count, runner_up, runner_up_score FROM c LEFT JOIN run USING (doc_id)"""


def tax_notes() -> str:
    percent = lambda c: f"printf('%.0f%%', round_even({c} * 100, 0))"
    return f"""WITH x AS ({tax_detect()}), n AS (
SELECT doc_id, 0 AS k, 'Low-confidence detection (' || {percent('confidence')} || '). Verify document type is ' || document_type || '.' AS note FROM x WHERE confidence < 0.7 AND document_type <> 'UNKNOWN'
UNION ALL SELECT doc_id, 1, 'Employer/issuer summary sheet detected. Individual employee copies may be in a separate file.' FROM x WHERE is_summary_sheet
UNION ALL SELECT doc_id, 2, 'Estimated ' || estimated_record_count || ' records in this PDF.' FROM x WHERE estimated_record_count > 1
UNION ALL SELECT doc_id, 3, 'Secondary match: ' || runner_up || ' (' || {percent('runner_up_score')} || '). Verify if extraction looks wrong.' FROM x WHERE runner_up_score > 0.4)
SELECT doc_id, CAST(row_number() OVER (PARTITION BY doc_id ORDER BY k) - 1 AS INTEGER) AS ord, note FROM n"""


def tax_scores() -> str:
    return f"WITH {tax_cte()} SELECT doc_id, type, score, ord FROM long"


def financial_cte() -> str:
    counts = ", ".join(f"{' + '.join(f'CAST({hit(p)} AS INTEGER)' for p in ps)} AS n{i}" for i, (_, ps) in enumerate(T.FINANCIAL_SIGNATURES))
    names = [k for k, _ in T.FINANCIAL_SIGNATURES]
    base = names.index("INCOME_STATEMENT")
    cols = [f"CASE WHEN n{i} >= 2 AND n{base} > 0 AND n{i} < n{base} THEN n{base} + 1 ELSE n{i} END AS m{i}" if i < 2 else f"n{i} AS m{i}" for i in range(len(names))]
    best = f"greatest({', '.join(f'm{i}' for i in range(len(names)))})"
    case = " ".join(f"WHEN m{i} = {best} THEN {q(k)}" for i, k in enumerate(names))
    return f"fc AS (SELECT doc_id, {counts} FROM (SELECT doc_id, lower(text) AS low FROM documents)), fm AS (SELECT doc_id, {', '.join(cols)} FROM fc), fin AS (SELECT doc_id, CASE WHEN {best} < 1 THEN 'FINANCIAL_UNKNOWN' {case} END AS financial_type FROM fm)"


def financial_detect() -> str:
    return f"WITH {financial_cte()} SELECT doc_id, financial_type FROM fin"


def family_case(col: str, default: str) -> str:
    whens = " ".join(f"WHEN {col} IN ({', '.join(map(q, ks))}) THEN {q(f)}" for f, ks in T.FAMILIES.items())
    return f"CASE {whens} ELSE {q(default)} END"


def master_detect() -> str:
    return f"""WITH {tax_cte()}, {financial_cte()},
top AS (SELECT doc_id, arg_max(type, (score, -ord)) AS type, max(score) AS score FROM long GROUP BY doc_id),
m AS (SELECT d.doc_id, CASE WHEN top.score >= 0.5 THEN top.type WHEN financial_type <> 'FINANCIAL_UNKNOWN' THEN financial_type ELSE 'UNKNOWN' END AS document_type,
  CASE WHEN top.score >= 0.5 THEN top.score WHEN financial_type <> 'FINANCIAL_UNKNOWN' THEN 0.8::DOUBLE ELSE 0.0::DOUBLE END AS confidence FROM d LEFT JOIN top USING (doc_id) JOIN fin USING (doc_id))
SELECT doc_id, document_type, {family_case('document_type', 'unknown')} AS document_family, confidence FROM m"""


def route_family() -> str:
    return f"""WITH {tax_cte()}, {financial_cte()}, top AS (SELECT doc_id, max(score) AS score FROM long GROUP BY doc_id)
SELECT d.doc_id, CASE WHEN top.score >= 0.5 THEN 'tax' ELSE {family_case('financial_type', 'tax')} END AS family FROM d LEFT JOIN top USING (doc_id) JOIN fin USING (doc_id)"""


def import_w2() -> str:
    def dyn(array: str, field: str) -> str:
        path = f"'$.{array}[' || i || '].{field}'"
        return f"CASE WHEN json_type(v, '$.{array}') = 'ARRAY' AND json_type(v, {path}) NOT IN ('ARRAY', 'OBJECT') THEN json_extract_string(v, {path}) END"

    last4 = scalar_at("employee.ssn_last4")
    cells = [f"CASE WHEN coalesce({last4}, '') = '' THEN '' ELSE 'XXXXX' || right({last4}, 4) END", blank(scalar_at("employer.name")), blank(scalar_at("employer.ein"))]
    cells += [import_money(scalar_at(f"federal.{b}")) for b in L.FEDERAL[:6]]
    for i in range(4):
        cells += [blank(scalar_at(f"box12[{i}].code")), import_money(scalar_at(f"box12[{i}].amount"))]
    for i in range(3):
        cells += [blank(scalar_at(f"box14_other[{i}].label")), import_money(scalar_at(f"box14_other[{i}].amount"))]
    cells += [blank(dyn("state", "state_abbr")), blank(dyn("state", "state_id")), import_money(dyn("state", "box16_state_wages")), import_money(dyn("state", "box17_state_withheld"))]
    cells += [blank(dyn("local", "locality_name")), import_money(dyn("local", "box18_local_wages")), import_money(dyn("local", "box19_local_withheld"))]
    return f"""WITH {record_cte("document_type = 'W2'")}, n AS (SELECT record_id, v, unnest(range(0, CASE WHEN json_type(v, '$.state') = 'ARRAY' THEN greatest(json_array_length(v, '$.state'), 1) ELSE 1 END::INT)) AS i FROM v WHERE json_type(v) = 'OBJECT')
SELECT record_id, CAST(i AS INTEGER) AS state_no, concat_ws(chr(9), {', '.join(cells)}) AS line FROM n"""


def keyword_types() -> str:
    parts = ", ".join(f"CASE WHEN {' AND '.join(f'contains(low, {q(p)})' for p in ps)} THEN {q(k)} END" for k, ps in T.KEYWORDS)
    return f"SELECT doc_id, concat_ws(';', {parts}) AS types FROM (SELECT doc_id, lower(text) AS low FROM documents)"


def meaningful_length() -> str:
    return f"CAST(coalesce(length(trim(regexp_replace(regexp_replace(text, {q('|'.join(T.BOILERPLATE))}, '', 'gi'), {q(WHITE + '+')}, ' ', 'g'))), 0) AS INTEGER)"


def meaningful() -> str:
    n = meaningful_length()
    return f"SELECT doc_id, {n} AS meaningful_chars, CASE WHEN {n} >= {T.TEXT_PAGE_CHARS} THEN 'text' ELSE 'image' END AS page_type FROM documents"


def pages_cte() -> str:
    return """u AS (SELECT file_id, unnest(pages) AS p, generate_subscripts(pages, 1) AS k FROM files), pg AS (SELECT file_id, CAST(row_number() OVER (PARTITION BY file_id ORDER BY p.page NULLS LAST, k) - 1 AS INTEGER) AS position, p.page AS page, p.text AS text FROM u WHERE p IS NOT NULL)"""


def headers_cte() -> str:
    order = sorted(enumerate(T.HEADERS), key=lambda x: (-x[1][0], x[0]))
    kind = " ".join(f"WHEN regexp_matches(head, {q('(?m)' + p)}) THEN {q(k)}" for _, (_, k, p) in order)
    conf = " ".join(f"WHEN regexp_matches(head, {q('(?m)' + p)}) THEN {number(c)}" for _, (c, _, p) in order)
    return f"""{pages_cte()}, b AS (SELECT *, trim(regexp_replace(coalesce(text, ''), '^\\s+|\\s+$', '', 'g')) AS body FROM pg),
h AS (SELECT *, lower(array_to_string(string_split(body, chr(10))[1:{sectionize.HEADER_LINES}], chr(10))) AS head, coalesce(trim(string_split(body, chr(10))[1]), '') AS title FROM b),
hs AS (SELECT file_id, position, page, title, CASE {kind} END AS header_type, CASE {conf} ELSE 0.0::DOUBLE END AS header_confidence FROM h)"""


def sections_cte() -> str:
    return f"""{headers_cte()}, e AS (SELECT file_id, min(position) AS first, max(position) AS last FROM hs GROUP BY file_id),
st AS (SELECT *, lag(header_type) OVER (PARTITION BY file_id ORDER BY position) AS before FROM hs WHERE header_confidence >= {T.STRONG}),
op AS (SELECT *, row_number() OVER (PARTITION BY file_id ORDER BY position) - 1 AS section_no, lead(position) OVER (PARTITION BY file_id ORDER BY position) AS next FROM st WHERE before IS NULL OR before <> header_type),
sec AS (SELECT e.file_id, CAST(coalesce(section_no, 0) AS INTEGER) AS section_no, CAST(coalesce(position, first) AS INTEGER) AS start_position, CAST(coalesce(next - 1, last) AS INTEGER) AS end_position,
  coalesce(header_type, 'UNKNOWN') AS document_type, CASE WHEN position IS NULL THEN '' ELSE title END AS title, coalesce(header_confidence, 0.0::DOUBLE) AS confidence FROM e LEFT JOIN op USING (file_id))"""


def amount(expr: str) -> str:
    """The amount rule as SQL over a text expression."""
    t = f"trim({expr})"
    bare = f"trim(replace(replace(regexp_replace(regexp_replace({t}, '[()]', '', 'g'), '-$', ''), ',', ''), '$', ''))"
    value = f"TRY_CAST({bare} AS DECIMAL(18,2))"
    return f"CASE WHEN {t} IN ('', '***', '-', '—', 'N/A', 'n/a') THEN NULL WHEN (starts_with({t}, '(') AND ends_with({t}, ')')) OR ends_with({t}, '-') THEN -{value} ELSE {value} END"


def record_cte(where: str) -> str:
    return f"r AS (SELECT * EXCLUDE (data), regexp_extract(data, '(?s)[{{].*[}}]') AS rec FROM extractions WHERE {where}), v AS (SELECT *, rec::JSON AS v FROM r WHERE rec <> '' AND json_valid(rec))"


def at(path: str) -> str:
    return f"(v->>'$.{path}')"


def scalar_at(path: str) -> str:
    """Text of a value that isn't an array or object."""
    return f"CASE WHEN json_type(v, '$.{path}') NOT IN ('ARRAY', 'OBJECT') THEN {at(path)} END"


def money(expr: str, blank: str = "''") -> str:
    return f"CASE WHEN {expr} IS NULL THEN {blank} WHEN TRY_CAST({expr} AS DOUBLE) IS NULL THEN {expr} ELSE printf('%.2f', TRY_CAST({expr} AS DOUBLE)) END"


def import_money(expr: str) -> str:
    return f"CASE WHEN TRY_CAST(trim({expr}) AS DOUBLE) IS NULL THEN '0.00' ELSE printf('%.2f', TRY_CAST(trim({expr}) AS DOUBLE)) END"


def check(expr: str) -> str:
    return f"CASE {expr} WHEN 'true' THEN 'Y' WHEN 'false' THEN 'N' ELSE '' END"


def blank(expr: str) -> str:
    return f"coalesce({expr}, '')"


def w2_flat() -> str:
    c = {"document_type": "document_type", "tax_year": "CAST(tax_year AS VARCHAR)", "is_corrected": "CASE WHEN metadata.is_corrected THEN 'Y' WHEN NOT metadata.is_corrected THEN 'N' ELSE '' END"}
    for party, fields in (("employer", ("name", "ein", "address")), ("employee", ("name", "ssn_last4", "address"))):
        c |= {f"{party}_{f}": blank(scalar_at(f"{party}.{f}")) for f in fields}
    c |= {b: money(scalar_at(f"federal.{b}")) for b in L.FEDERAL}
    for i, letter in enumerate("abcd"):
        c[f"box12{letter}_code"], c[f"box12{letter}_amount"] = blank(scalar_at(f"box12[{i}].code")), money(scalar_at(f"box12[{i}].amount"))
    c |= {f"box13_{b}": check(scalar_at(f"box13.{b}")) for b in ("statutory_employee", "retirement_plan", "third_party_sick_pay")}
    for i in range(4):
        c[f"box14_{i + 1}_label"], c[f"box14_{i + 1}_amount"] = blank(scalar_at(f"box14_other[{i}].label")), money(scalar_at(f"box14_other[{i}].amount"))
    for i in range(2):
        c[f"state{i + 1}_abbr"], c[f"state{i + 1}_id"] = blank(scalar_at(f"state[{i}].state_abbr")), blank(scalar_at(f"state[{i}].state_id"))
        c[f"state{i + 1}_wages"], c[f"state{i + 1}_withheld"] = money(scalar_at(f"state[{i}].box16_state_wages")), money(scalar_at(f"state[{i}].box17_state_withheld"))
        c[f"local{i + 1}_name"] = blank(scalar_at(f"local[{i}].locality_name"))
        c[f"local{i + 1}_wages"], c[f"local{i + 1}_withheld"] = money(scalar_at(f"local[{i}].box18_local_wages")), money(scalar_at(f"local[{i}].box19_local_withheld"))
    c["notes"] = "coalesce(array_to_string(metadata.notes, '; '), '')"
    return f"WITH {record_cte(chr(34) + 'document_type' + chr(34) + ' = ' + q('W2'))} SELECT record_id, {', '.join(f'{e} AS {n}' for n, e in c.items())} FROM v WHERE json_type(v) = 'OBJECT'"


def generic_tax() -> str:
    case = lambda i, make: "CASE document_type " + " ".join(f"WHEN {q(f[0])} THEN {make(f[i])}" for f in L.forms()) + " END"
    last4 = lambda p: f"coalesce({scalar_at(p + '.ssn_last4')}, {scalar_at(p + '.tin_last4')})"
    tin = lambda p: f"coalesce({scalar_at(p + '.ein')}, {scalar_at(p + '.tin')})"
    kinds = ", ".join(q(f[0]) for f in L.forms())
    return f"""WITH {record_cte(f'document_type IN ({kinds})')}, p AS (SELECT *, {case(3, scalar_at)} AS main FROM v WHERE json_type(v) = 'OBJECT')
SELECT record_id, document_type, CAST(tax_year AS VARCHAR) AS tax_year, {blank(case(1, lambda p: scalar_at(p + '.name')))} AS party_a_name, {blank(case(1, tin))} AS party_a_tin,
{blank(case(2, lambda p: scalar_at(p + '.name')))} AS party_b_name, {blank(case(2, last4))} AS party_b_last4, {money('main')} AS primary_amount, {case(4, q)} AS primary_label FROM p"""


def exchange_lines(made_on: str, program: str) -> str:
    nl = "chr(10)"
    return f"""SELECT record_id, ord, 'T' || code || {nl} || 'P' || payer || {nl} || '$' || amount || {nl} || '^' AS lines FROM ({exchange()})
UNION ALL SELECT NULL, -1, 'V042' || {nl} || 'A{program}' || {nl} || 'D{made_on}' || {nl} || '^'"""


def typed_table(table: str, variant: str | None = None) -> str:
    """A kind's table, or that of one of its variants; variants by the fields an object has and the elements below it."""
    feeds = {"sections": ("sections", "subsections")}.get(table, (table,))
    has = lambda *names: f"list_has_any(keys, [{', '.join(map(q, names))}])"
    case = {
        "box12": f"CASE WHEN {has('code')} THEN 'box12_coded' ELSE 'box12_bare' END",
        "box14_other": f"CASE WHEN {has('label')} THEN 'box14_labelled' ELSE 'box14_bare' END",
        "state": f"CASE WHEN {has('state_abbr')} THEN 'state_named' ELSE 'state_bare' END",
        "local": f"CASE WHEN {has('locality_name')} THEN 'local_named' ELSE 'local_bare' END",
        "sections": "CASE WHEN holds_sections THEN 'section_group' WHEN holds_accounts THEN 'section_leaf' ELSE 'section_empty' END",
        "accounts": f"CASE WHEN {has('balance')} THEN 'account_balance' WHEN {has('amount')} THEN 'account_amount' WHEN {has('debit', 'credit')} THEN 'account_sides' ELSE 'account_bare' END",
    }[table]
    raw = lambda f: f"CASE WHEN json_type(obj, '$.{f}') <> 'NULL' THEN json_extract_string(obj, '$.{f}') END"
    columns = nested.SUBTYPES[variant][1] if variant else nested.TABLES[table]
    cols = ", ".join(f"{amount(raw(f)) if k == 'money' else raw(f)} AS {c}" for c, f, k in columns)
    below = ", below AS (SELECT record_id, parent_path AS node_path, bool_or(field IN ('sections', 'subsections')) AS holds_sections, bool_or(field = 'accounts') AS holds_accounts FROM nodes GROUP BY ALL)" if table == "sections" else ""
    join = " LEFT JOIN below USING (record_id, node_path)" if below else ""
    return f"""WITH {nested.NODES_CTE}{below}, k AS (SELECT *, json_keys(obj) AS keys FROM nodes{join} WHERE field IN ({', '.join(map(q, feeds))})), v AS (SELECT *, {case} AS variant FROM k)
SELECT record_id, node_path, parent_path, CAST(regexp_extract(node_path, '([0-9]+)\\]$', 1) AS INTEGER) AS position, CAST(CASE WHEN parent_path = '' THEN 0 ELSE len(string_split(parent_path, '.')) END AS INTEGER) AS depth, variant, {cols} FROM v{f" WHERE variant = {q(variant)}" if variant else ""}"""


def section_check() -> str:
    value = lambda f: amount(f"CASE WHEN json_type(obj, '$.{f}') NOT IN ('ARRAY', 'OBJECT') THEN json_extract_string(obj, '$.{f}') END")
    return f"""WITH {nested.NODES_CTE}, st AS (SELECT n.* FROM nodes n JOIN extractions e USING (record_id) WHERE e.document_type <> 'W2'),
a AS (SELECT record_id, parent_path AS path, sum(CAST(coalesce({value('balance')}, {value('amount')}, 0) AS DECIMAL(28,6))) AS s FROM st WHERE field = 'accounts' GROUP BY ALL),
c AS (SELECT record_id, node_path AS path, CAST({value('section_total')} AS DECIMAL(28,6)) AS reported FROM st WHERE field IN ('sections', 'subsections')),
d AS (SELECT record_id, path, CAST(coalesce(s, 0) AS DECIMAL(28,6)) AS computed, reported FROM c LEFT JOIN a USING (record_id, path) WHERE reported IS NOT NULL)
SELECT record_id, path, computed, reported, CAST(computed - reported AS DECIMAL(28,6)) AS delta, abs(computed - reported) <= 0.02 AS matches FROM d"""


def flagship() -> str:
    return f"""SELECT m.doc_id, m.document_type, m.document_family, m.confidence, t.tax_year, t.estimated_record_count, CAST(len(regexp_extract_all(coalesce(d.text, ''), {q(T.PHONE)})) AS INTEGER) AS n_phones
FROM ({master_detect()}) m JOIN ({tax_detect()}) t USING (doc_id) JOIN documents d USING (doc_id)"""


def exchange() -> str:
    rows = []
    for kind, table in L.EXCHANGE.items():
        payer = "employer.name" if kind == "W2" else "payer.name"
        for i, (code, path) in enumerate(table):
            rows.append(f"SELECT record_id, {i} AS ord, {q(code)} AS code, {blank(scalar_at(payer))} AS payer, {import_money(scalar_at(path))} AS amount FROM v WHERE document_type = {q(kind)} AND json_type(v) = 'OBJECT'")
    kinds = ", ".join(map(q, L.EXCHANGE))
    return f"WITH {record_cte(f'document_type IN ({kinds})')} {' UNION ALL '.join(rows)}"


def account_rows() -> str:
    """Statement rows from the nodes: accounts with the name of the section that holds them, subtotals, totals of the sides."""
    sides = [x for x in L.SIDES if x not in ("components", "bank_accounts", "accounts")]
    side = "|".join(sides)
    text = lambda f, o="n.obj": f"CASE WHEN json_type({o}, '$.{f}') NOT IN ('ARRAY', 'OBJECT', 'NULL') THEN json_extract_string({o}, '$.{f}') END"
    head = ", ".join(f"coalesce({text('entity.' + k, 'rec')}, '') AS {n}" for k, n in (("name", "entity_name"), ("software", "software"), ("accounting_basis", "accounting_basis"), ("period_start", "period_start"), ("period_end", "period_end")))
    totals = " UNION ALL ".join(
        f"SELECT record_id, {q(s.upper())} AS section, '' AS subsection, '' AS account_number, {q(k.replace('_', ' ').title())} AS account_name, 'total' AS row_type, {text(f'{s}.{k}', 'rec')} AS balance, {text(f'{s}.{k}', 'rec')} AS amount, {q(f'{s}.{k}')} AS node_path FROM d WHERE json_type(rec, '$.{s}') = 'OBJECT' AND coalesce(json_type(rec, '$.{s}.{k}'), 'NULL') <> 'NULL'"
        for s in sides
        for k in L.TOTAL_KEYS
    )
    kinds = ", ".join(map(q, L.ACCOUNT_TYPES))
    return f"""WITH {nested.NODES_CTE}, d AS (SELECT e.record_id, e.document_type, b.rec::JSON AS rec FROM extractions e JOIN base b USING (record_id) WHERE e.document_type IN ({kinds}) AND b.rec <> '' AND json_valid(b.rec) AND json_type(b.rec::JSON) = 'OBJECT'),
secs AS (SELECT n.record_id, n.node_path, coalesce({text('section_name')}, '') AS name, n.obj FROM nodes n WHERE regexp_matches(n.node_path, '^({side})(\\.(sections|subsections)\\[[0-9]+\\])+$')),
acc AS (SELECT n.record_id, upper(regexp_extract(n.node_path, '^[a-z_]+')) AS section, coalesce(secs.name, '') AS subsection, coalesce({text('account_number')}, '') AS account_number, coalesce(nullif({text('account_name')}, ''), {text('component_name')}, '') AS account_name, 'account' AS row_type,
  coalesce({text('balance')}, {text('current_balance')}) AS balance, {text('amount')} AS amount, n.node_path FROM nodes n LEFT JOIN secs ON secs.record_id = n.record_id AND secs.node_path = n.parent_path WHERE regexp_matches(n.node_path, '^(({side})(\\.(sections|subsections)\\[[0-9]+\\])*\\.)?accounts\\[[0-9]+\\]$')),
subt AS (SELECT n.record_id, upper(regexp_extract(n.node_path, '^[a-z_]+')) AS section, name AS subsection, '' AS account_number, 'Total ' || name AS account_name, 'subtotal' AS row_type, {text('section_total')} AS balance, {text('section_total')} AS amount, n.node_path FROM secs n WHERE coalesce(json_type(n.obj, '$.section_total'), 'NULL') <> 'NULL'),
u AS (SELECT * FROM acc UNION ALL SELECT * FROM subt UNION ALL {totals})
SELECT u.record_id, document_type, {head}, section, subsection, account_number, account_name, row_type, {amount('balance')} AS balance, {amount('amount')} AS amount, node_path FROM u JOIN d USING (record_id)"""
