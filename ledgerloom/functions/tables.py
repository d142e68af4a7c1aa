"""The patterns, word lists and lookup tables that results depend on.

Plain tables, in the order that decides ties.
"""

from __future__ import annotations

# --- fixed values: boilerplate on forms ------------------------------------------------------------------------------

BOILERPLATE = [
    r"Copy [A-Z0-9]",
    r"OMB No\.?\s*\d+-\d+",
    r"Dept\.? of the Treasury",
    r"Internal Revenue Service",
    r"Department of the Treasury",
    r"Cat\.? No\.?\s*\w+",
    r"\bFor Official Use Only\b",
    r"\bVOID\b",
    r"\bCORRECTED\b",
]
TEXT_PAGE_CHARS = 100

# --- fixed values: keyword labels, all phrases of a line must occur ----------------------------------------------------

#: (type, phrases)
KEYWORDS = (
    ("W2", ("wage and tax statement", "form w-2")),
    ("1099-NEC", ("1099-nec", "nonemployee compensation")),
    ("1099-MISC", ("1099-misc", "miscellaneous information", "miscellaneous income")),
    ("1099-INT", ("1099-int", "interest income")),
    ("1099-DIV", ("1099-div", "dividends and distributions")),
    ("1099-B", ("1099-b", "proceeds from broker")),
    ("1099-R", ("1099-r", "distributions from pensions", "annuities, retirement")),
    ("1099-G", ("1099-g", "certain government payments")),
    ("1099-SA", ("1099-sa", "distributions from an hsa", "distributions from hsa")),
    ("1099-K", ("1099-k", "payment card and third party network")),
    ("1099-S", ("1099-s", "proceeds from real estate")),
    ("1099-C", ("1099-c", "cancellation of debt")),
    ("1099-A", ("1099-a", "acquisition or abandonment")),
    ("1098-T", ("1098-t", "tuition statement")),
    ("1098-E", ("1098-e", "student loan interest")),
    ("1098", ("1098", "mortgage interest statement")),
    ("SSA-1099", ("ssa-1099", "social security benefit statement")),
    ("RRB-1099", ("rrb-1099", "railroad retirement")),
    ("K-1 1065", ("schedule k-1", "form 1065", "partner's share")),
    ("K-1 1120-S", ("schedule k-1", "form 1120-s", "shareholder's share")),
    ("K-1 1041", ("schedule k-1", "form 1041", "beneficiary's share")),
)

# --- fixed values: weighted tax signatures ------------------------------------------------------

#: (type, weight, pattern)
TAX_SIGNATURES = (
    ("W2", 0.9, "wage and tax statement"),
    ("W2", 0.9, r"form\s+w-?2\b"),
    ("W2", 0.8, r"box\s+1\b.*wages.*tips.*other\s+comp"),
    ("W2", 0.7, "social security wages"),
    ("W2", 0.7, "medicare wages and tips"),
    ("W2", 0.4, r"employer.s\s+(?:id|ein)\s+number"),
    ("W2", 0.4, r"employee.s\s+soc(?:ial)?\s*sec"),
    ("W2", 0.5, r"statutory\s+employee"),
    ("W2", 0.5, r"third.party\s+sick\s+pay"),
    ("W2", 0.95, r"w-?2\s+and\s+earnings\s+summary"),
    ("W2", 0.85, r"balancing\s+form\s+w-?2"),
    ("1099-NEC", 0.95, r"1099.nec\b"),
    ("1099-NEC", 0.85, r"nonemployee\s+compensation"),
    ("1099-NEC", 0.95, r"form\s+1099.nec"),
    ("1099-NEC", 0.9, r"box\s+1\b.*nonemployee"),
    ("1099-MISC", 0.95, r"1099.misc\b"),
    ("1099-MISC", 0.95, r"form\s+1099.misc"),
    ("1099-MISC", 0.85, r"box\s+1\b.*rents\b"),
    ("1099-MISC", 0.9, r"fishing\s+boat\s+proceeds"),
    ("1099-MISC", 0.85, r"crop\s+insurance\s+proceeds"),
    ("1099-INT", 0.95, r"1099.int\b"),
    ("1099-INT", 0.95, r"form\s+1099.int\b"),
    ("1099-INT", 0.8, r"interest\s+income.*1099"),
    ("1099-INT", 0.7, r"early\s+withdrawal\s+penalty"),
    ("1099-INT", 0.65, r"tax.exempt\s+interest"),
    ("1099-INT", 0.6, r"bond\s+premium"),
    ("1099-DIV", 0.95, r"1099.div\b"),
    ("1099-DIV", 0.95, r"form\s+1099.div\b"),
    ("1099-DIV", 0.85, r"dividends\s+and\s+distributions"),
    ("1099-DIV", 0.75, r"qualified\s+dividends"),
    ("1099-DIV", 0.8, r"total\s+ordinary\s+dividends"),
    ("1099-DIV", 0.8, r"section\s*199a\s+dividends"),
    ("1099-B", 0.95, r"1099.b\b"),
    ("1099-B", 0.95, r"form\s+1099.b\b"),
    ("1099-B", 0.85, r"proceeds\s+from\s+broker"),
    ("1099-B", 0.7, r"date\s+(?:acquired|sold)"),
    ("1099-B", 0.75, r"cost\s+or\s+other\s+basis"),
    ("1099-B", 0.85, r"wash\s+sale\s+loss\s+disallowed"),
    ("1099-B", 0.65, r"covered\s+security"),
    ("1099-R", 0.95, r"1099.r\b"),
    ("1099-R", 0.95, r"form\s+1099.r\b"),
    ("1099-R", 0.85, r"distributions\s+from\s+pensions"),
    ("1099-R", 0.7, r"gross\s+distribution"),
    ("1099-R", 0.8, r"taxable\s+amount\s+not\s+determined"),
    ("1099-R", 0.7, r"distribution\s+code"),
    ("1099-R", 0.75, r"ira\s*/\s*sep\s*/\s*simple"),
    ("1099-G", 0.95, r"1099.g\b"),
    ("1099-G", 0.95, r"form\s+1099.g\b"),
    ("1099-G", 0.85, r"unemployment\s+compensation"),
    ("1099-G", 0.8, r"state\s+or\s+local\s+income\s+tax\s+refund"),
    ("1099-G", 0.75, r"taxable\s+grants"),
    ("1099-G", 0.85, r"rtaa\s+payments"),
    ("1099-SA", 0.95, r"1099.sa\b"),
    ("1099-SA", 0.95, r"form\s+1099.sa\b"),
    ("1099-SA", 0.85, r"distributions\s+from\s+an?\s+hsa"),
    ("1099-SA", 0.8, r"archer\s+msa"),
    ("1099-SA", 0.8, r"medicare\s+advantage\s+msa"),
    ("1099-K", 0.95, r"1099.k\b"),
    ("1099-K", 0.95, r"form\s+1099.k\b"),
    ("1099-K", 0.85, r"payment\s+card\s+and\s+(?:third.party\s+)?network"),
    ("1099-K", 0.8, r"merchant\s+category\s+code"),
    ("1099-K", 0.85, r"gross\s+payment\s+card\s+transactions"),
    ("1099-S", 0.95, r"1099.s\b"),
    ("1099-S", 0.95, r"form\s+1099.s\b"),
    ("1099-S", 0.85, r"proceeds\s+from\s+real\s+estate"),
    ("1099-S", 0.75, r"date\s+of\s+closing"),
    ("1099-S", 0.8, r"gross\s+proceeds.*real\s+estate"),
    ("1099-C", 0.95, r"1099.c\b"),
    ("1099-C", 0.95, r"form\s+1099.c\b"),
    ("1099-C", 0.9, r"cancellation\s+of\s+debt"),
    ("1099-C", 0.85, r"amount\s+of\s+debt\s+discharged"),
    ("1099-C", 0.8, r"identifiable\s+event\s+code"),
    ("1099-A", 0.95, r"1099.a\b"),
    ("1099-A", 0.95, r"form\s+1099.a\b"),
    ("1099-A", 0.9, r"acquisition\s+or\s+abandonment"),
    ("1099-A", 0.8, r"balance\s+of\s+principal\s+outstanding"),
    ("1098", 0.9, r"\bform\s+1098\b(?!.(?:t|e|c|f|ma|q))"),
    ("1098", 0.9, r"mortgage\s+interest\s+statement"),
    ("1098", 0.85, r"mortgage\s+interest\s+received"),
    ("1098", 0.75, r"outstanding\s+mortgage\s+principal"),
    ("1098", 0.7, r"points\s+paid\s+on\s+purchase"),
    ("1098", 0.65, r"mortgage\s+insurance\s+premiums"),
    ("1098-T", 0.95, r"1098.t\b"),
    ("1098-T", 0.95, r"form\s+1098.t\b"),
    ("1098-T", 0.9, r"tuition\s+statement"),
    ("1098-T", 0.75, r"qualified\s+tuition"),
    ("1098-T", 0.8, r"at\s+least\s+half.time\s+student"),
    ("1098-T", 0.65, r"scholarships\s+or\s+grants"),
    ("1098-E", 0.95, r"1098.e\b"),
    ("1098-E", 0.95, r"form\s+1098.e\b"),
    ("1098-E", 0.9, r"student\s+loan\s+interest\s+statement"),
    ("1098-E", 0.85, r"student\s+loan\s+interest\s+received"),
    ("SSA-1099", 0.95, r"ssa.1099\b"),
    ("SSA-1099", 0.9, r"social\s+security\s+benefit\s+statement"),
    ("SSA-1099", 0.8, r"net\s+benefits\s+for\s+\d{4}"),
    ("SSA-1099", 0.85, r"benefit\s+statement.*social\s+security"),
    ("RRB-1099", 0.95, r"rrb.1099\b"),
    ("RRB-1099", 0.85, r"railroad\s+retirement\s+(?:board|benefits)"),
    ("RRB-1099", 0.75, r"tier\s+[12]\s+(?:tax|benefit)"),
    ("K-1 1065", 0.95, r"schedule\s+k.1.*1065"),
    ("K-1 1065", 0.85, r"partner.s\s+share\s+of\s+income"),
    ("K-1 1065", 0.85, r"partnership.*schedule\s+k.?1"),
    ("K-1 1065", 0.75, r"partner.s\s+capital\s+account"),
    ("K-1 1065", 0.7, r"guaranteed\s+payments"),
    ("K-1 1120-S", 0.95, r"schedule\s+k.1.*1120.?s"),
    ("K-1 1120-S", 0.85, r"shareholder.s\s+share\s+of\s+income"),
    ("K-1 1120-S", 0.85, r"s\s+corporation.*schedule\s+k.?1"),
    ("K-1 1120-S", 0.75, r"shareholder.s\s+(?:pro.rata|percentage)"),
    ("K-1 1041", 0.95, r"schedule\s+k.1.*1041"),
    ("K-1 1041", 0.85, r"beneficiary.s\s+share\s+of\s+income"),
    ("K-1 1041", 0.85, r"estate\s+or\s+trust.*schedule\s+k.?1"),
    ("K-1 1041", 0.55, "fiduciary"),
)

# --- fixed values: issuing software, first match counts ----------------------------------------------------------------

#: (software, pattern)
ISSUERS = (
    ("ADP", r"\badp\b"),
    ("ADP", r"automatic\s+data\s+processing"),
    ("ADP", r"w-?2\s+and\s+earnings\s+summary"),
    ("ADP", r"balancing\s+form\s+w-?2"),
    ("Paychex", r"\bpaychex\b"),
    ("Intuit", r"\bintuit\b"),
    ("Intuit", r"\bquickbooks\b"),
    ("Gusto", r"\bgusto\b"),
    ("BambooHR", r"\bbamboohr\b"),
    ("Rippling", r"\brippling\b"),
    ("Justworks", r"\bjustworks\b"),
    ("TurboTax", r"\bturbotax\b"),
    ("H&R Block", r"\bhr\s*block\b"),
    ("Fidelity", r"\bfidelity\b"),
    ("Vanguard", r"\bvanguard\b"),
    ("Schwab", r"\bcharles\s+schwab\b"),
    ("TD Ameritrade", r"\btd\s+ameritrade\b"),
    ("E*Trade", r"\betrade\b"),
    ("Navient", r"\bnavient\b"),
    ("Great Lakes", r"\bgreat\s+lakes\b"),
    ("Nelnet", r"\bnelnet\b"),
)

# --- fixed values: signs of an employer's summary sheet ----------------------------------------------------------------

SUMMARY_SIGNS = [
    r"total\s+employees",
    r"total\s+forms\s+(?:count|processed)",
    r"batch\s+no",
    r"for\s*:\s*batch",
    r"w-?2/w-?3\s+totals",
    r"balancing\s+form\s+w-?2",
    r"total\s+eforms",
    r"\btotals\b.*\bfor\b.*\bcompany\b",
]

# --- fixed values: notes of a detection -------------------------------------------------------------------------------

NOTE_LOW_CONFIDENCE = ("Low-confidence detection (", "). Verify document type is ", ".")
NOTE_SUMMARY = "Employer/issuer summary sheet detected. Individual employee copies may be in a separate file."
NOTE_RECORDS = ("Estimated ", " records in this PDF.")
NOTE_RUNNER_UP = ("Secondary match: ", " (", "). Verify if extraction looks wrong.")

# --- fixed values: tax year, in order of trust -------------------------------------------------------------------------

YEAR_PATTERNS = [
    r"(?:tax\s+year|year)\s+(\d{4})",
    r"wage\s+and\s+tax\s+statement\s+(\d{4})",
    r"form\s+w-?2\s+.*?(\d{4})",
    r"(\d{4})\s+form\s+w-?2",
    r"(?:for\s+)?(?:calendar\s+)?year\s+(\d{4})",
    r"(?:january|december)\s+\d{1,2},\s+(\d{4})",
]
YEARS = (2010, 2035)

# --- fixed values: financial signatures, most specific type first ------------------------------------------------------

#: (type, patterns)
FINANCIAL_SIGNATURES = (
    (
        "INCOME_STATEMENT_COMPARISON",
        (
            r"(?:ytd|year.to.date)\s+(?:actual|budget)",
            r"(?:current|this)\s+(?:month|period)\s+(?:actual|budget)",
            r"(?:prior year|last year)\s+(?:actual|budget)",
            r"\$\s+var(?:iance)?",
            r"%\s+var(?:iance)?",
            r"jan\s*-\s*dec\s*\d{2,4}",
            r"\$\s*change",
            r"dec\s+\d{1,2},\s+\d{2,4}.*dec\s+\d{1,2},\s+\d{2,4}",
        ),
    ),
    (
        "BUDGET_VS_ACTUAL",
        (
            "annual budget",
            "ytd budget",
            "ytd actual",
            r"\$\s+var(?:iance)?",
        ),
    ),
    (
        "ACCOUNTS_RECEIVABLE_AGING",
        (
            r"a(?:ccounts)?\s*r(?:eceivable)?\s*aging",
            r"current\s+(?:1-30|0-30)\s+(?:31-60|30-60)",
        ),
    ),
    (
        "ACCOUNTS_PAYABLE_AGING",
        (
            r"a(?:ccounts)?\s*p(?:ayable)?\s*aging",
        ),
    ),
    (
        "GENERAL_LEDGER",
        (
            "general ledger",
            "transaction detail",
            r"(?:date|memo|ref)\s+(?:debit|credit)\s+balance",
            r"\btype\b.*\bdate\b.*\bnum\b.*\bsplit\b.*\bdebit\b.*\bcredit\b",
            r"\bmemo\b.*\bsplit\b.*\bdebit\b",
        ),
    ),
    (
        "TRIAL_BALANCE",
        (
            "trial balance",
            r"debit\s+credit",
            "total debits",
        ),
    ),
    (
        "RESERVE_ALLOCATION",
        (
            "reserve allocation",
            "reserve fund",
            r"(?:component|item)\s+(?:cost|balance|funded)",
            r"(?:tile|shake)\s+roof",
            "asphalt replacement",
            "contingency",
        ),
    ),
    (
        "BALANCE_SHEET",
        (
            "balance sheet",
            "total assets",
            r"liabilities\s+[&and]+\s+(?:capital|equity|stockholders)",
            "current assets",
            "accounts receivable",
            r"total\s+liabilities\s*&\s*equity",
            r"total\s+current\s+assets",
            r"total\s+fixed\s+assets",
            r"total\s+other\s+assets",
        ),
    ),
    (
        "INCOME_STATEMENT",
        (
            r"(?:income|profit)\s+(?:and\s+loss|statement|p&l)",
            "total (?:income|revenue)",
            "total expenses",
            "net (?:income|loss|operating)",
            "operating income",
            r"ordinary\s+income/expense",
            r"cost\s+of\s+goods\s+sold",
            r"gross\s+profit",
            r"net\s+ordinary\s+income",
            r"total\s+cogs",
        ),
    ),
)

# --- fixed values: families of document types --------------------------------------------------------------------------

FAMILIES = {
    "tax": ("W2", "1099-NEC", "1099-MISC", "1099-INT", "1099-DIV", "1099-B", "1099-R", "1099-G", "1099-SA", "1099-K", "1099-S", "1099-C", "1099-A", "1098", "1098-T", "1098-E", "SSA-1099", "RRB-1099", "K-1 1065", "K-1 1120-S", "K-1 1041"),
    "financial_simple": ("BALANCE_SHEET", "INCOME_STATEMENT", "TRIAL_BALANCE"),
    "financial_multicolumn": ("INCOME_STATEMENT_COMPARISON", "BUDGET_VS_ACTUAL"),
    "financial_transaction": ("ACCOUNTS_RECEIVABLE_AGING", "ACCOUNTS_PAYABLE_AGING", "GENERAL_LEDGER"),
    "financial_reserve": ("RESERVE_ALLOCATION",),
}

# --- fixed values: anchor words of readable text -----------------------------------------------------------------------

ANCHORS = "total balance account income expense asset wages tax amount date name net gross paid cash revenue debit credit equity liability".split()

# --- fixed values: section headers ----------------------------------------------------------

#: (confidence, type, pattern)
HEADERS = (
    (0.95, "BALANCE_SHEET", "^balance sheet"),
    (0.95, "INCOME_STATEMENT", "^income statement"),
    (0.95, "INCOME_STATEMENT", r"^profit\s+(?:and\s+)?loss"),
    (0.95, "TRIAL_BALANCE", "^trial balance"),
    (0.95, "GENERAL_LEDGER", "^general ledger"),
    (0.95, "ACCOUNTS_RECEIVABLE_AGING", "^accounts? receivable aging"),
    (0.95, "ACCOUNTS_PAYABLE_AGING", "^accounts? payable aging"),
    (0.95, "CASH_FLOW_STATEMENT", "^cash flow"),
    (0.9, "BUDGET_VS_ACTUAL", r"^budget\s+vs\.?\s+actual"),
    (0.9, "APPFOLIO_OWNER_STATEMENT", "^owner statement"),
    (0.9, "RESERVE_ALLOCATION", "^reserve allocation"),
    (0.9, "W2", r"form\s+w-?2\b"),
    (0.9, "W2", "wage and tax statement"),
    (0.92, "1099-NEC", r"form\s+1099.nec"),
    (0.92, "1099-MISC", r"form\s+1099.misc"),
    (0.92, "1099-INT", r"form\s+1099.int"),
    (0.92, "1099-DIV", r"form\s+1099.div"),
    (0.92, "1099-B", r"form\s+1099.b\b"),
    (0.92, "1099-R", r"form\s+1099.r\b"),
    (0.92, "K-1 1065", r"schedule\s+k.1.*1065"),
    (0.92, "K-1 1120-S", r"schedule\s+k.1.*1120.?s"),
    (0.92, "K-1 1041", r"schedule\s+k.1.*1041"),
    (0.6, "BALANCE_SHEET", r"as of\s+\d{2}/\d{2}/\d{4}"),
    (0.6, "INCOME_STATEMENT", r"for the (?:month|period|year)\s+(?:ended|ending)"),
    (0.6, "INCOME_STATEMENT", r"from\s+\d{2}/\d{2}/\d{4}\s+to\s+\d{2}/\d{2}/\d{4}"),
)
STRONG = 0.85

# --- fixed values: pools of invented replacements ----------------------------------------------------------------------

FIRST_NAMES = (
    "James Mary Robert Patricia John Jennifer Michael Linda David Elizabeth William Barbara Richard Susan Joseph Jessica Thomas Sarah Charles Karen Daniel Lisa Matthew Nancy Anthony "
    "Betty Mark Margaret Donald Sandra Steven Ashley Andrew Dorothy Paul Kimberly Joshua Emily Kenneth Donna Kevin Michelle Brian Carol George Amanda Timothy Melissa Ronald Deborah"
).split()
LAST_NAMES = (
    "Smith Johnson Williams Brown Jones Garcia Miller Davis Rodriguez Martinez Hernandez Lopez Gonzalez Wilson Anderson Thomas Taylor Moore Jackson Martin Lee Perez Thompson White Harris "
    "Sanchez Clark Ramirez Lewis Robinson Walker Young Allen King Wright Scott Torres Nguyen Hill Flores Green Adams Nelson Baker Hall Rivera Campbell Mitchell Carter Roberts"
).split()
STREETS = (
    "Main St|Oak Ave|Maple Dr|Cedar Ln|Pine St|Elm St|Washington Blvd|Park Ave|Lake Dr|Hill Rd|River Rd|Forest Ave|Spring St|Valley Dr|Sunset Blvd|Highland Ave|Church St|Center St|Mill Rd|"
    "Academy Dr|Broadway|Lincoln Ave|Union St|Franklin Dr|Jefferson Ln"
).split("|")
CITIES = "Springfield Riverside Fairview Georgetown Clinton Greenville Bristol Oakland Madison Arlington Burlington Franklin Milton Salem Chester Lexington Ashland Dover Manchester Newport".split()
STATES = "CA TX FL NY IL PA OH GA NC MI NJ VA WA AZ MA TN IN MO MD WI".split()
COMPANY_SUFFIXES = "Corp Inc LLC Ltd Group Holdings Services Solutions Associates Partners Enterprises Co".split()
COMPANY_WORDS = "Alpha Beta Delta Sigma Apex Summit Nova Atlas Pinnacle Horizon Meridian Pacific National United Federal Liberty Heritage Premier Sterling Cascade Keystone Cornerstone Landmark Vanguard".split()

# --- fixed values: personal data in free text --------------------------------------------------------------------------

SSN = r"\b(\d{3})[-\s](\d{2})[-\s](\d{4})\b"
SSN_DASHED = r"\b(\d{3})-(\d{2})-(\d{4})\b"
PHONE = r"\(?\d{3}\)?[-.\s]\d{3}[-.\s]\d{4}"
ADDRESS = (
    r"\b\d{1,5}\s+[A-Z][a-zA-Z\s]+(?:St|Ave|Dr|Ln|Rd|Blvd|Way|Ct|Pl|Cir|Ter|Pkwy)"
    r"(?:\.?(?:\s*(?:#|Apt|Suite|Ste|Unit)\s*\S+)?)"
    r"(?:\s*,\s*[A-Z][a-zA-Z\s]+,\s*[A-Z]{2}\s+\d{5}(?:-\d{4})?)?"
)
SKIP_KEYS = "document_type tax_year document_family confidence row_type section_name subsection column_type key label accounting_basis software period_start period_end code description".split()

# --- fixed values: answer sizes in tokens ------------------------------------------------------------------------------

BUDGETS = {
    "1099-NEC": 1024,
    "1099-MISC": 1024,
    "1099-INT": 1024,
    "1099-DIV": 1024,
    "1099-R": 1024,
    "1099-G": 1024,
    "1099-SA": 1024,
    "1099-K": 1024,
    "1099-S": 1024,
    "1099-C": 1024,
    "1099-A": 1024,
    "1098": 1024,
    "1098-T": 1024,
    "1098-E": 1024,
    "SSA-1099": 1024,
    "RRB-1099": 1024,
    "W2": 2048,
    "K-1 1065": 3000,
    "K-1 1120-S": 3000,
    "K-1 1041": 3000,
    "CASH_FLOW_STATEMENT": 3000,
    "1099-B": 4096,
    "BALANCE_SHEET": 4096,
    "INCOME_STATEMENT": 4096,
    "ACCOUNTS_RECEIVABLE_AGING": 4096,
    "ACCOUNTS_PAYABLE_AGING": 4096,
    "TRIAL_BALANCE": 6000,
    "RESERVE_ALLOCATION": 6000,
    "GENERAL_LEDGER": 8000,
    "QB_GENERAL_LEDGER": 8000,
    "FINANCIAL_UNKNOWN": 8000,
    "QB_PROFIT_LOSS": 16000,
    "INCOME_STATEMENT_COMPARISON": 24000,
    "BUDGET_VS_ACTUAL": 24000,
}
DEFAULT_BUDGET = 4096
