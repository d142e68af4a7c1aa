"""Labelled pages of invented content, the table that the field of ``pii`` is trained on.

Every page is made here, from the word lists and sentence patterns below, which were written for this purpose: no line comes
from a corpus. ``python -m ledgerloom.llm.pii_pages`` writes ``pii_labelled.txt`` anew; the same seed gives the same pages.

Slots in braces become pieces: ``{N}`` a person's name, ``{L}`` a surname, ``{A}`` an address, ``{P}`` a phone number, ``{E}`` an
e-mail address, ``{I}`` an identity number. Slots of lower-case letters become what only looks like one.
"""

from __future__ import annotations

import random
import re

PAGES, SEED = 560, 20

FIRST = (
    "Aaron Abena Adele Ahmed Aiko Alan Alejandra Alice Amara Amir Ana Anders Andrea Anita Anton Arjun Astrid Beatriz Ben Bianca Bjorn Bridget Bruno Camille Carla Carlos Cecilia Chen Chloe Clara Colin Dana Darius Deepa "
    "Denise Diego Dmitri Dolores Edith Elena Elias Emma Enrique Erik Esther Eva Fatima Felix Fiona Gemma George Gerald Gina Giulia Grace Graham Hannah Hans Hassan Helen Hiroshi Hugo Ian Ibrahim Ingrid Irene Isaac Ivan "
    "Jan Jasmin Javier Jin Joanna Jonas Jorge Juan Judith Julia Kamal Karen Karl Katya Keiko Kofi Kurt Laila Lars Laura Leila Lena Liam Lin Linda Lorenzo Lucia Luis Magda Maja Manuel Marco Maria Marta Martin Maya Mehmet Mei "
    "Miguel Mina Mohammed Monica Nadia Naomi Neil Nina Nora Olga Omar Oscar Pablo Paula Pavel Pedro Petra Pierre Priya Rachel Rafael Raj Ravi Rita Roberto Rosa Ruth Sally Sanjay Sara Sean Simon Sofia Stefan Sunita Svetlana "
    "Tariq Tess Tim Tomas Ursula Vera Viktor Wei Wendy Xavier Yara Yusuf Zoe"
).split()
#: Given names that are common in English forms, long and short.
ENGLISH = (
    "James Mary John Jennifer Michael Linda David Elizabeth William Barbara Richard Susan Joseph Jessica Thomas Sarah Charles Nancy Christopher Margaret Daniel Lisa Matthew Betty Anthony Dorothy Mark Sandra Donald Ashley "
    "Steven Kimberly Paul Donna Andrew Emily Joshua Carol Kenneth Michelle Kevin Amanda Brian Melissa Edward Deborah Ronald Stephanie Timothy Rebecca Jason Sharon Jeffrey Ryan Jacob Kathleen Gary Amy Nicholas Shirley Eric "
    "Angela Jonathan Anna Stephen Brenda Larry Pamela Justin Scott Samantha Brandon Katherine Frank Christine Benjamin Catherine Gregory Samuel Virginia Raymond Debra Patrick Alexander Janet Jack Dennis Carolyn Bob Liz Kate "
    "Peg Bill Dick Ted Ned Gus Hal Peter Walter Henry Oliver Vincent Eugene Harold Howard Abigail Victoria Natalie Theresa Winifred Gabrielle Louisa Theodore Philip Lawrence Leonard Francis Frances Fred Nat Chuck Meg"
).split()
LAST = (
    "Abbott Acosta Adeyemi Ahmad Andersson Baker Banerjee Bauer Becker Bell Bennett Berg Bianchi Bishop Blanc Brandt Brooks Bryant Campos Carter Castillo Chan Chandra Chapman Chavez Cho Choi Cohen Cole Cooper Cruz Dalton "
    "Das Dean Diaz Dixon Dubois Duncan Dunn Ellis Eriksen Espinoza Evans Farrell Fernandes Fischer Fleming Foster Fraser Fuentes Garcia Gibbs Goldberg Gomez Grant Gray Griffin Gupta Haas Hansen Hayes Henry Hoffman Hossain "
    "Huang Hughes Ito Ivanov Iyer Jansen Jensen Johansson Joshi Kapoor Kaya Keller Kelly Kim Klein Kowalski Kumar Lambert Larsen Lee Levy Li Lindgren Lopez Maier Marin Marsh Mbeki Mehta Mendes Meyer Moreau Morgan Muller "
    "Murphy Nakamura Navarro Nguyen Novak Obi Okafor Olsen Ortega Osei Park Patel Pereira Petrov Pham Popov Price Quinn Rahman Ramos Reyes Ricci Rossi Roy Ruiz Russo Sato Schmidt Shah Sharma Silva Singh Smirnov Sousa Stone "
    "Suzuki Tan Tanaka Tran Turner Usman Vargas Vega Vogel Wagner Walsh Wang Ward Weber Wong Wu Yamamoto Yang Yilmaz Young Zhang Zimmerman"
).split()
HEADS = "Bar Cal Dor Fen Gal Har Jel Kor Lom Mar Nor Ost Pel Quar Ran Sel Tor Ul Ver Wel Yor Zan Bryn Crat Drun Eld Fros".split()
MIDDLES = "a e i o u al en ir om un ad el is or ".split(" ")
TAILS = "beck borne bridge bury combe croft dale den field ford garth gate grave hurst land leigh low man mere mont mouth quist shaw sted strand thorpe vale wick worth yard".split()
STREETS = "Maple Elm Birch Juniper Chestnut Walnut Poplar Prospect Jefferson Lincoln Garden Bridge Mill Station Church College Market Harbor Hill Lake Ocean Summit Meadow Orchard Quarry Railroad River School Spring Sunset Valley Vine Windmill Old New Upper Lower Stone Fallen Hidden Quiet Broken Silver Golden Amber Painted".split()
KINDS = "Street St St. Str Avenue Ave Ave. Av Boulevard Blvd Blvd. Boul Road Rd Rd. Drive Dr Dr. Drv Lane Ln Ln. Court Ct Ct. Place Pl Pl. Parkway Pkwy Pky Way Wy Circle Cir Terrace Ter Trail Trl Highway Hwy Square Sq".split()
POINTS = "N S E W N. S. E. W. North South East West NE SW N.E. N.W. S.E. S.W. Northeast Southwest Northwest Southeast No. So.".split()
CITIES = "Ashford Bellmont Cedarville Dunmore Eastbrook Fairhaven Glenwood Highmoor Kingsport Lakewood Millbrook Newbury Oakdale Pinehurst Quincy Redfield Stonebridge Thornton Underhill Westfield Ravenport Copperton Elkridge Foxborough Briarfield Heronsgate Coldwater".split()
STATES = "AL AK AZ AR CA CO CT DE FL GA HI ID IL IN IA KS KY LA ME MD MA MI MN MS MO MT NE NV NH NJ NM NY NC ND OH OK OR PA RI SC SD TN TX UT VT VA WA WV WI WY DC".split()
STATE_NAMES = "Ohio Texas Georgia Oregon Maine Utah Nevada Florida Arizona Colorado California Washington|New York|New Jersey|North Carolina|West Virginia".replace(" ", "|", 11).split("|")
TRADES = "Painting and Drywall|Plumbing Services|Community Bank|Medical Center|Insurance Group|Homeowners Association|Bakery|Software International|Elevator Maintenance|Tea Importers|Roofing|Engineering|Waste and Recycling|Accounting Associates|Property Management|Brothers Construction|Landscape|Electric|Trucking|Dental Clinic|Press|Foods|Hotel Group|Law Offices|Auto Parts|Real Estate Partners|Pool Service|Transportation|Manufacturing|Capital Fund".split("|")
LEGAL = ["LLC", "Inc", "Inc.", "Corp", "LP", "Ltd", "L.L.C.", "", "", "Company", "Co.", "GmbH", "Limited Partnership"]
MONTHS = "January February March April May June July August September October November December".split()
WORDS = "ledger balance account deposit wages statement invoice payment transfer reserve budget refund premium schedule figures totals receipt adjustment entry closing audit notice".split()
#: Small words that may stand beside a piece.
SMALL = (
    "owes pays holds called wrote sent asked left alone again later says said told gave took kept found moved drew sold bought lent owed signed filed mailed agreed refused resigned retired inherited donated forgot "
    "confirmed disputed returned reported claimed expects wants needs handles manages keeps leads joined over under until before since because while although about against around within without toward "
    "principal appraised valued vacant rented leased insured mortgaged attention care value interest equity term loan note balance due open paid void final draft extra plus minus net gross both only still already"
).split()
SECOND = "Central Pacific Falcon Keystone Beacon Compass Harbor Lantern Thistle Granite Valley Lake Mountain Cedar Heron Amber Prairie Pioneer Liberty Crown Eagle Star North Union National First Metro Delta Alpine".split()
TITLED = "Prepaid Insurance|General Repairs|Accounts Receivable|Office Supplies|Legal Fees|Accrued Payroll|Rent Income|Utility Expense|Retained Earnings|Operating Cash|Travel Meals|Late Charges|Common Area|Bank Charges|Roof Replacement|Deferred Revenue|Snow Removal|Interest Income|Federal Withholding|Owner Equity".split("|")
TITLES = "Mr. Mrs. Ms. Miss Dr. Prof. Mx. Mr Mrs Ms Dr Rev.".split()
HOSTS = "example.com example.org example.net mail.example.com firm.example inbox.test post.example.co.uk office.example.org.au books.invalid accounts.firm.example hr.corp.test uni.example.edu web.example.de".split()

#: Lines with pieces.
LINES = """
Client: {N}
Name {N}
Taxpayer name: {N}
Spouse: {N}
Employee {N} ({I})
Recipient {N}, {A}
Contact {N}, {P}, {E}
Contact person {N} <{E}>
To: {N} <{E}>
Cc: {E}; {E}
Reply to {E} or phone {P}.
Our records show that {N} moved to {A} in {month}.
Please send the duplicate to {A}.
Please send the duplicate to {A}, care of {N}.
Please forward the {word} to {N} at {A}.
Ship to\\n{N}\\n{A}
{N}\\n{A}\\n{P}
{N}\\n{org}\\n{A}
Home address {A}
Mailing address: {A}
Residence: {A} since {date}
Property at {A} was appraised at {amt}.
The property at {A}, held by {N}, is worth {amt}.
Lender {org}, borrower {N}, collateral {A}, balance {amt}
SSN {I}
Social security number: {I}
Taxpayer ID {I}
TIN of recipient {I}, withheld {amt}
Identification number {I} belongs to {N}.
ids {I} and {I}
Dependents: {N} ({I}) and {N} ({I})
Children: {N}, id {I}; {N}, id {I}
Partners {N} / {N}, numbers {I} / {I}
{N} {I} {amt}
{N}   {I}   {A}   {amt}
{N}  {A}  {amt}
{N}, {I}, {date}
Call {N} on {P} before {date}.
Call {P} and ask for {N}.
Phone {P}, extension {n}
Phone: {P} x{n}; mobile: {P}
Telephone {P} ext {n}, fax {P}
Fax {P}
Mobile {P} (evenings)
My number is {P}, thanks.
You can reach me at {P} or {E}.
Write to {E} by {date}.
E-mail: {E}
Email {E}, tel {P}
Questions go to {E}.
Signed by {N} on {date}
Signed: {N}
Reviewed by {N}, {date}
Approved by {title} {L} on {date}
{title} {L} confirmed the {amt} {word}.
{title} {L} has not replied about the {word}.
{title} {N} asked for a copy of the {word}.
Dear {title} {L},
Dear {N},
Dear {title} {L}: thank you for your letter of {date}.
Regards,\\n{N}
Sincerely,\\n{N}\\n{org}
{N} wrote that the {word} was short by {amt}.
{N} holds {n}% of the shares and lives at {A}.
{N} and {N} opened the account together.
{N} paid {amt} on {date}.
{N} is our bookkeeper; the fee of {amt} is due {date}.
{N} owes {amt}, the largest part of the receivables.
{N} (tel. {P}) disputes the {word}.
The {word} of {amt} was returned by {N}.
The {word} that {N} sent shows {amt}, ours {amt}.
The partner's share began at {amt}; {N} drew {amt}.
The amount of {amt} which {N} moved on {date} is not taxable.
A new {word} went to {N} because {amt} was missing.
Cancel check {n} for {N} and issue it again for {amt}.
Check {n} came back; {N} ({E}, {P}) will send a new one.
As {N} noted on {date}, "the {word} will follow".
It was {N} who entered the {word}.
{verb} {N} about the {word}.
{verb} {N}.
{verb} {N} and {N} before the {word} closes.
We met {N} of {org} on {date}.
We could not match {amt} that {N} booked on {date}.
They moved {amt} to the reserve, says {N}.
Prepared by {N} for {org} on {date}
Prepared for {N} by {org}
Preparer {N}, firm {org}, EIN {ein}
Landlord {N}; tenant {org}; rent {amt}
From: {N}
From: {E}
Attention {N}
Attn: {N}, {org}
Beneficiary {N}, born {date}
Tenant in unit {n}: {N}
{N} lives at {A}.
{N} lives at {A}. The {word} is there too.
Deliver to {A}; ring {P}.
Until {month} the office was at {A}
Send mail to {A}
{A} is the address on file.
Señora {L}, su número es {P}.
Bitte rufen Sie {N} unter {P} an.
Veuillez contacter {N} à {E}.
Estimado {N}: el saldo es {amt}.
Frau {L} bestätigte den Betrag von {amt}.
Name: {N} Phone: {P} Email: {E}
Payee {N} TIN {I} Amount {amt}
Street address {A}
Guarantor {N} of {A} (id {I})
The form lists {I} twice.
Wages of {amt} were reported under {I}.
The {word} that {N} {small} on {date} is {small}.
{N} {small} {small} the {word} of {amt}.
{N} {small} {amt}.
{N} {small} why box {n} shows {amt}.
{N} {small} {amt} {small} {word}.
{n} days {small} total {amt}; {N} {small} {small} {amt}.
Code {code} applies to what {N} {small} {small} on {date}.
Unit {n} ({N}) is {small} {small} {amt}.
Unit {n} ({N}) {small} {amt}
The copy {N} {small}, {amt} on ours.
{small} {N}, {word} {A}, {small} {amt}
{word} {A}, {small} {amt}
{A}, {small} {amt}
{A} {small} {small} {amt}
{A}, {small} {N}
{word} to {A}, {small} {N}.
{N}, property {A}, {small} {amt}
{N} {I} {A} {amt}
{N}  {I}  {amt}
{I}  {N}  {A}
{word} {I} {small} {amt} of {word}.
Id number {I} {small} {amt}
({E}, {P})
{N} ({E})
{N} ({P}, {E}) {small} it.
<{E}>
tel {P}, {small} {E}
{P} / {P}
Mr and Mrs {N}
{N}, {N} and {N} {small} the {word}.
{small} {small} {N}, {N} and {N}.
{N}, {small} {small} {small}, {small} {word}.
I'm {N} and I {small} the {word}.
I {small} the {word} at {A} to {N} for {amt}.
We {small} {small} at {A} {small} {date}.
The {word} at {A} {small} {N} {small}.
Hi, {N} {small} {small} {word}
Hello {N},
Yours, {N}
Thanks, {N}
The old {word} {small} {N}, {A}.
The {role}, {N}, {small} at {n} {small}.
It {small} {N}, {A}, {small} {word}.
{small} {small} {P} if {small} {word} {amt}
please {small} {P} if it's {small}
{verb} {N} at {P} {small} the {word}.
{small} {verb} {N} at {P} {small} {date}
{small} {N} at {P}, {small} {word}
at {P} {small} the {small} {word}
{role} {N}
{role} {N}, {word} {A}
{role} {N}, {word} {A}, {small} {amt}
{role} {N} {small} {amt}
The {role} {N} {small} {n}% and {small} {small} {A}.
{role} {title} {L} {small} {amt}
{N}  {I}  {A}  {amt}
{N}  {I}  {A}
{N}   {I}
{title} {L} {small} the {amt} {word}.
{title} {L} {small} {word}
{title} {L}
{N}
{N}
{A}
{P}
{E}
"""

#: Lines without any.
PLAIN = """
{titled}   {amt}
{acct} {titled}   {amt}
{acct} {titled}  {amt}  {amt}
{org}   {amt}
{org} reported {amt} for {year}.
{org}, {date}, {amt}
Invoice {longref} from {org}
Invoice {invoice}
Invoice {invoice} of {date}
Order {ref}, lot {ref}
Parcel {parcel}, lot {lotno}
Lot {lotno}
Serial {lotno}, model {ref}
Batch {batch} closed on {date}
Batch {batch}
Document {docno}
Document no. {docno}, page {n}
Employer identification number {ein}
EIN {ein}
Employer's ID {ein}
Federal tax no. {ein} of {org}
SSN {masked}
SSN {masked} (hidden)
Taxpayer ID ending in {four}
Recipient's number {masked}
Routing {nine}
Routing no. {nine}, account {nine2}
Account {nine2}
Account no. {nine2} at {org}
Bank account {nine2}, branch {n}
Tracking {longref}
Confirmation {nine2}
Reference {longref}
Reference {nine2}
Control number {control}
Control no. {control}
Policy {policy} ends {date}
Policy {policy} costs {amt}
Entry {je} moves {amt} to {acct}.
Booked {amt} to {acct} under {je}.
Box {n} shows {amt} while the ledger has {amt}.
Box {n} code {code}: {amt}
Form W-2 Wage and Tax Statement {year}
Form 1099-NEC Nonemployee Compensation
Form 1099-INT Interest Income
Schedule K-1 (Form 1065)
Balance Sheet
Balance Sheet as of {date}
Balance Sheet as of {date}: {amt}
Income Statement for the year ended {date}
{acct} {capped}   {amt}
{acct} {capped}   {amt}
{acct} {capped}  {amt}  {small}
{capped}   {amt}
Income Statement
Profit and Loss
Cash Flow
Statement of {word}
Routing {nine}  Account {any9}
Account {any9}
Account number {any9}, {small} {amt}
The {small} of {org} {small} {n}.
{small} {amt} for {org}, {small} {n}.
For {org} {small} {date}
General Ledger
Trial Balance
Continued from the last page
Continuation of General Ledger
Cover letter
Correspondence
Page {n} of {n}
Total assets {amt}
Total wages {amt}  withheld {amt}
Gross {amt}  Net {amt}
{n} payments of {amt} remain.
{n} units at {amt}
Qty {n} at {amt} each
Qty {n} @ {amt}
The office on {street} is closed until {date}.
The shop on {street} reopens in {month}.
Our branch in {city} moved.
The {word} for {month} {year} is ready.
The {word} was {amt} too high.
The {word} is {amt}.
It is not clear whether {org} filed for {year}; {amt} is open.
Roof work reached {amt} by {date}; {org} expected {amt}.
Depreciation of {amt} was entered on {date}.
Insurance of {amt} runs out on {date}.
Dues are {amt} a month.
Check {n}, {date}, {amt}
Check {four} cleared on {date}.
Rate {n}.5% on {amt}
Version {n}.{n}.{n} of the report
See note {n} to the {word}.
No {word} was found.
Visit the {city} office or {org}.
https://www.example.com/{word}/{n}
Approved budget {year}: {amt}
Meeting of {date} in {city}
Debit {amt} Credit {amt}
{date}  {titled}  {amt}
{date} {je} {titled} {amt} {amt}
Call the office about the {word}.
Please see the {word} of {date}.
We thank {org} for the {word}.
The study by {org} {small} {amt}.
The audit of {org} {small} {n} items.
The board {small} {amt} for {org}, check {n}.
The board of {org} {small} on {date}.
Paid {amt} to {org} for {word}
{small} {org} {small} {word}
{org} {small} {amt} {small} {date}
We {small} {org} and {org}.
Escrow of {amt} at {org} {small} {date}.
{word} of {org}
Funds at {org}: {amt}
Work by {org}, {city}
{thing} {phonelike}
{thing} {phonelike}, {small} {parcel}
{thing} {phonelike}, {thing} {parcel}
{thing} no. {phonelike}
{thing} {batch} {small} {date}
{thing} {batch} {small} {date}
Batch {batch} {small} {date}
{thing} {docno}
{thing} {invoice}
{thing} {nine2} {small} {nine}
{small} {n} {small} {amt} {small}
{n} {small} {word} of {amt} {small}.
{titled} of {amt} {small} {date}
{titled} {small} {amt}
{small} {titled}: {amt}
State {titled} {amt}
{city}, {date}
{city} {word} {year}
The {titled} {word} {small} {amt}.
Dear Sir or Madam,
Hello,
Thanks
Hi all,
{capped1},
{capped1}
{capped1}: {small} {small} {word}, {date}
I'm {small} {small} {small} {word}.
I've {small} the {word}.
I {small} {small} the {word} {small}.
We'll {small} {small} {word}.
It's {small} {word}, {amt}
Her {word}, {small} {date}, {small} {small}.
{capped1} {word}, {thing} {code}
{capped1} {small} {word} {n}
{org}, EIN {ein}
Employer: {org}, EIN {ein}
{word}: {org}
Dear Customer,
Best regards,
Accounts Payable Department
Human Resources
Tax Department
"""
VERBS = "Meet Ask Thank Call See Tell Remind Pay Email Phone Contact Invite Visit Notify Bill Refund Credit Charge Reimburse Invoice With Since When If Also Today Yesterday Then However Because Both After Before Let Did Has Is".split()


class Maker:
    """Pieces and whole pages from one stream of chance."""

    def __init__(self, seed: int):
        self.r = random.Random(seed)

    def pick(self, xs):
        return xs[int(self.r.random() * len(xs))]

    def digits(self, n: int, first: str = "0123456789") -> str:
        return self.pick(first) + "".join(self.pick("0123456789") for _ in range(n - 1))

    # --- pieces ---

    def surname(self) -> str:
        made = lambda: self.pick(HEADS) + self.pick(MIDDLES) + self.pick(MIDDLES) + self.pick(TAILS)
        w = made() if self.r.random() < 0.65 else self.pick(LAST)
        x = self.r.random()
        return f"{w}-{made()}" if x < 0.03 else f"O'{w}" if x < 0.04 else f"{self.pick(['de', 'van', 'von'])} {w}" if x < 0.05 else w

    def first(self) -> str:
        return self.pick(ENGLISH if self.r.random() < 0.5 else FIRST)

    def name(self) -> str:
        f, last, x = self.first(), self.surname(), self.r.random()
        initial = self.pick("ABCDEFGHIJKLMNOPRSTUW")
        if x < 0.1:
            f = f"{f[0]}."
        elif x < 0.13:
            f = f[0]
        elif x < 0.22:
            f = f"{f} {initial}."
        elif x < 0.29:
            f = f"{f} {initial}"
        elif x < 0.33:
            f = f"{f} {self.first()}"
        elif x < 0.35:
            f = f"{f[0]}. {initial}."
        y = self.r.random()
        out = f"{last}, {f}" if y < 0.2 else f"{f} {last}"
        if y > 0.95:
            out += self.pick([" Jr", " Jr.", ", Jr.", " Sr.", " III"])
        z = self.r.random()
        return out.upper() if z < 0.14 else out

    def street(self) -> str:
        x = self.r.random()
        if x < 0.12:
            w = self.pick("1st 2nd 3rd 4th 5th 8th 10th 14th 21st 22nd 23rd 42nd First Second Third Fourth Eleventh Twelfth".split())
        else:
            w = " ".join(dict.fromkeys([*([self.pick(STREETS)] if x < 0.7 else []), self.pick(STREETS)]))
        return w

    def address(self) -> str:
        r = self.r.random
        number = str(int(10 ** (1 + 3.7 * r())))
        city, state = self.pick(CITIES), self.pick(STATES) if r() < 0.85 else self.pick(STATE_NAMES)
        code = self.digits(5) + (f"-{self.digits(4)}" if r() < 0.12 else "")
        unit = ""
        if r() < 0.3:
            label = self.pick([str(int(1 + 40 * r())), f"{int(1 + 40 * r())}{self.pick('ABCD')}", self.pick("ABCDE")])
            unit = self.pick(["Apt", "Apt.", "Suite", "Unit", "Ste", "Ste.", "#", "# ", "No.", "Apartment", "Room", "Floor", "Fl", "Bldg", "Lot"])
            unit += label if unit in ("#", "# ") else f" {label}"
        if r() < 0.14:
            line = self.pick(["PO Box", "P.O. Box", "P O Box", "Post Office Box", "Box", "P.O. BOX", "POB"]) + f" {self.digits(int(2 + 5 * r()), '123456789')}"
        else:
            point, kind = (self.pick(POINTS) if r() < 0.3 else ""), (self.pick(KINDS) if r() < 0.95 else "")
            line = " ".join(x for x in ((number, point, self.street(), kind) if r() < 0.75 else (number, self.street(), kind, point)) if x)
            if unit:
                line += self.pick([", ", " ", ", "]) + unit
        x = r()
        if x < 0.12:
            out = line
        elif x < 0.16:
            out = f"{line}, {city}"
        elif x < 0.22:
            out = line + self.pick([", ", "\n"]) + self.pick([f"London {self.pick('NSEW')}W{self.digits(1, '123456789')} {self.digits(1)}{self.pick('ABDEF')}{self.pick('GHJLN')}", f"Leeds LS{self.digits(1, '123456789')} {self.digits(1)}QP", f"Ottawa ON K{self.digits(1)}A {self.digits(1)}B{self.digits(1)}", f"{city}, VIC {self.digits(4, '23')}"])
        else:
            end = self.pick([f"{city}, {state} {code}", f"{city} {state} {code}", f"{city}, {state}", f"{city} {state}", f"{city} {code}", f"{city}, {state}, {code}"])
            out = line + self.pick([", ", ", ", "\n", " ", "; "]) + end
            if r() < 0.03:
                out += self.pick([", USA", " USA"])
        return out.upper() if r() < 0.12 else out

    def phone(self) -> str:
        a, b, c = self.digits(3, "23456789"), self.pick(["555", self.digits(3, "23456789")]), self.digits(4)
        forms = [f"({a}) {b}-{c}", f"({a}) {b}-{c}", f"({a}){b}-{c}", f"{a}-{b}-{c}", f"{a}-{b}-{c}", f"{a}.{b}.{c}", f"{a}.{b}.{c}", f"{a} {b} {c}", f"+1 {a} {b} {c}", f"+1-{a}-{b}-{c}", f"+1 ({a}) {b}-{c}", f"1-{a}-{b}-{c}", f"+1{a}{b}{c}", f"{a}/{b}-{c}", f"+44 20 7{self.digits(3)} {self.digits(4)}", f"+49 30 {self.digits(8)}", f"+33 1 {self.digits(2)} {self.digits(2)} {self.digits(2)} {self.digits(2)}", f"+44 {self.digits(4, '1')} {self.digits(6)}", f"{a}–{b}–{c}", f"{a}{b}{c}"]
        return self.pick(forms)

    def email(self) -> str:
        f, last, host = self.first().lower(), re.sub(r"[^a-z]", "", self.surname().lower()), self.pick(HOSTS)
        if self.r.random() < 0.4:
            host = self.pick(["", "mail.", "post.", "payroll."]) + self.pick([*WORDS, last]) + self.pick(["desk", "post", "books", "line", ""]) + self.pick([".example", ".test", ".invalid", ".com", ".co.uk", ".org", ".net"])
        user = self.pick([f"{f}.{last}", f"{f}.{last}", f"{f[0]}{last}", f"{f}_{last}", f"{last}_{f}", f"{f}-{last}", f"{f[0]}-{last}", f"{f[0]}.{last}", f"{f}{self.digits(2)}", f"{f}{self.digits(1)}", f"{last}{self.digits(1)}", f"{last}.{f}", f"{f}.{last}{self.digits(2)}", f"{f}{last}", f"{f}.{last}+{self.pick(WORDS)}", f"{f}.{last}+tax{self.year()}", f"{f[0]}.{last}+{self.digits(2)}"])
        x = self.r.random()
        if x < 0.14:
            return user + self.pick([" (at) ", " [at] ", " at ", "(at)", " @ "]) + (host if self.r.random() < 0.7 else host.replace(".", " (dot) " if "(" in host else " dot ", 1) if x < 0.03 else host) if x > 0.03 else f"{user} (at) {host}"
        return f"{user}@{host}".upper() if x > 0.93 else f"{user}@{host}"

    def identity(self) -> str:
        a, b, c = self.digits(3, "9990"), self.digits(2), self.digits(4)
        a = a if a[0] == "9" else "000" if self.r.random() < 0.3 else f"9{a[1:]}"
        return self.pick([f"{a}-{b}-{c}"] * 5 + [f"{a} {b} {c}", f"{a} {b} {c}", f"{a}.{b}.{c}", f"{a}–{b}–{c}", f"{a} - {b} - {c}", f"{a}{b}{c}", f"{a}{b}{c}", f"{a}{b}{c}"])

    # --- what only looks like a piece ---

    def year(self) -> str:
        return str(2015 + int(11 * self.r.random()))

    def fill(self, slot: str) -> str:
        r, d = self.r.random, self.digits
        m, day, year = int(1 + 12 * r()), int(1 + 28 * r()), self.year()
        whole = d(int(1 + 6.99 * r()), "123456789")
        if slot == "amt":
            text = (f"{int(whole):,}" if r() < 0.85 else whole) + f".{d(2)}"
            return self.pick([text] * 8 + [f"${text}", f"({text})", f"{text}-", f"-{text}", f"$({text})"])
        if slot == "date":
            return self.pick([f"{m:02}/{day:02}/{year}", f"{year}-{m:02}-{day:02}", f"{MONTHS[m - 1]} {day}, {year}", f"{day} {MONTHS[m - 1]} {year}", f"{day:02}.{m:02}.{year}"])
        if slot == "org":
            last, way = re.sub(r"[^A-Za-z]", "", self.surname()), r()
            words = self.pick([last, f"{last} {self.pick(STREETS)}", f"{last} {self.pick(SECOND)}", f"{last} {self.pick(SECOND)}", self.pick(CITIES), f"{last} & {self.pick(LAST)}", f"{self.pick(SECOND)} {self.pick(SECOND)}"])
            text = f"{words} {self.pick(TRADES)} {self.pick(LEGAL)}".strip()
            return text.upper() if way < 0.12 else f"The {text}" if way < 0.16 else text
        made = {
            "month": lambda: MONTHS[m - 1], "year": lambda: year, "word": lambda: self.pick(WORDS), "titled": lambda: self.pick(TITLED), "title": lambda: self.pick(TITLES), "verb": lambda: self.pick(VERBS),
            "n": lambda: d(int(1 + 3.5 * r()), "123456789"), "four": lambda: d(4), "acct": lambda: self.pick([f"{d(4, '1234567')}-0000", f"{d(4, '1234567')}", f"{d(5, '1234567')}"]), "ein": lambda: f"{d(2)}-{d(7)}",
            "masked": lambda: self.pick(["XXX-XX-", "***-**-", "xxx-xx-", "XXXXX", "###-##-", "•••-••-"]) + d(4), "nine": lambda: d(9, "0123"), "nine2": lambda: d(self.pick([9, 9, 9, 8, 10, 12]), "12345678"),
            "longref": lambda: self.pick([f"{d(3)}-{d(2)}-{d(5)}", f"{d(4)}-{d(6)}", f"1Z{d(10)}", f"{d(4)} {d(4)} {d(4)}", f"{d(3)}-{d(7)}"]), "invoice": lambda: self.pick([f"{d(3, '9')}-{d(2)}-{d(5)}", f"{d(3)}-{d(2)}-{d(5)}", f"{d(6)}", f"INV-{d(5)}"]),
            "ref": lambda: self.pick([f"{d(6)}", f"A-{d(5)}", f"{d(2)}/{d(4)}", f"{d(3)}.{d(2)}"]), "parcel": lambda: f"{d(2)}-{d(self.pick([1, 2, 3]))}", "lotno": lambda: self.pick([f"{d(2)}.{d(3)}.{d(4)}", f"{d(3)}.{d(2)}.{d(4)}", f"{d(2)}-{d(4)}-{d(3)}", f"{d(3)}.{d(4)}"]),
            "batch": lambda: self.pick([f"{d(4)}-555-{d(3)}", f"{d(4)}-{d(3)}-{d(3)}", f"{d(6)}"]), "docno": lambda: self.pick([f"{year}-{m:02}-{d(4)}", f"{year}/{d(5)}", f"{year}-{d(6)}"]), "control": lambda: self.pick([f"{d(6)}-{d(2)}", f"{d(7)}", f"{d(5)}-{d(3)}"]),
            "policy": lambda: self.pick([f"{re.sub(r'[^A-Z]', '', self.surname().upper())}-{d(5)}", f"P{d(7)}"]), "je": lambda: f"JE-{d(5)}", "code": lambda: self.pick(["D", "DD", "W", "C", "AA"]), "street": lambda: f"{self.street()} {self.pick(['Road', 'Street', 'Avenue', 'Lane', 'Drive'])}",
            "city": lambda: self.pick(CITIES), "small": lambda: self.pick(SMALL), "capped": lambda: f"{self.pick(STREETS + SMALL + WORDS).capitalize()} {self.pick(SMALL + WORDS).capitalize()}{self.pick(['s', '', 'ing'])}", "capped1": lambda: self.pick(SMALL + WORDS).capitalize(), "any9": lambda: d(9), "role": lambda: self.pick("Borrower Lender Partner Tenant Owner Trustee Agent Manager Officer Buyer Seller Payer Donor Member Director borrower partner tenant owner trustee manager".split()), "thing": lambda: self.pick("Lot Part Item Model Serial Parcel Catalog Key Bin Batch Case File Unit Crate Shelf Meter".split()),
            "phonelike": lambda: self.pick([f"{d(3)}.{d(3)}.{d(4)}", f"{d(3)}.{d(3)}.{d(4)}", f"{d(3)}-{d(3)}-{d(4)}", f"{d(3)} {d(3)} {d(4)}", f"{d(2)}.{d(3)}.{d(4)}", f"{d(10)}"]),
        }
        return made[slot]()

    def line(self, pattern: str) -> str:
        kinds = {"N": ("NAME", self.name), "L": ("NAME", self.surname), "A": ("ADDRESS", self.address), "P": ("PHONE", self.phone), "E": ("EMAIL", self.email), "I": ("ID_NUMBER", self.identity)}

        def slot(m: re.Match) -> str:
            k = kinds.get(m[1])
            return f"⟦{k[0]}|{k[1]()}⟧" if k else self.fill(m[1])

        return re.sub(r"\{(\w+)\}", slot, pattern).replace("\\n", "\n")

    def page(self) -> str:
        r, out = self.r.random, []
        lines, plain = LINES.strip().split("\n"), PLAIN.strip().split("\n")
        for _ in range(int(4 + 26 * r())):
            text = self.line(self.pick(lines) if r() < 0.56 else self.pick(plain))
            out.append(text + (" " if r() < 0.15 else "") + ("\n" if r() < 0.2 else ""))
        return "\n".join(out)


def pages(n: int = PAGES, seed: int = SEED) -> list[str]:
    """``n`` pages with their pieces marked as in the table."""
    made = Maker(seed)
    return [made.page() for _ in range(n)]


def main(path: str) -> None:
    with open(path, "w", encoding="utf-8") as f:
        f.write("\n%%%%\n".join(pages()))


if __name__ == "__main__":
    from .pii import TABLE

    main(TABLE)
