"""Splitting of oversized texts at natural boundaries.

Every position where a piece may begin has a strength: account heading > heading that carries an account on > page break >
paragraph > line > sentence > word. A sparse table over the strengths answers, for any window of permissible piece ends,
which cut is strongest (the rightmost of equals) in constant time. The next piece steps back from the cut by the overlap.

Ledger texts are divided by account headings. How strong a line is follows from evidence: the form of its number, a balance
that opens it, a total that names it further on, and what speaks for a report's title. The cuts of heading strength are read
off the same table, by range-maximum queries on either side of each one found; they are reported with the pieces, as each
piece carries the heading of the account in which it begins.
"""

from __future__ import annotations

import re
from typing import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

LEDGERS = ("GENERAL_LEDGER", "QB_GENERAL_LEDGER")
CONTEXT_CHARS = 80
WORD, SENTENCE, LINE, PARAGRAPH, PAGE, CARRIED, HEADING = range(1, 8)

_NUMBER = r"\d{4}(?:-\d{2,4}|\.\d{2})"
_AMOUNT = r"\(?-?\$?\(?\d[\d,]*(?:\.\d+)?\)?-?"
#: A line that heads an account, by the ways ledgers write one: number first, bracketed, starred, with a label, with a
#: prefix letter code, or name first. The heading proper is group "head"; a carry-on mark is group "more".
_HEAD = re.compile(
    r"^(?P<ff>\f*)(?P<head>(?:"
    rf"(?:Account|Acct|A/C)\b(?:\s+No)?[.:]?[ \t]+{_NUMBER}[^\n]*?"
    rf"|\[{_NUMBER}\][ \t]+[^\n]*?"
    rf"|\*{{2,}}[ \t]*{_NUMBER}[^\n]*?\*{{2,}}[^\n]*?"
    rf"|GL[ ]?\d{{4}}(?:-\d{{4}})?[ \t]+[^\n]*?\(Ledger\)[^\n]*?"
    rf"|{_NUMBER}[ \t]+(?:[·•|-][ \t]+)?[A-Za-z][^\n]*?"
    r"|(?P<bare>\d{4})[ \t]+[A-Za-z][^\n]*?"
    rf"|[A-Za-z][^\n()]*?[ ]\({_NUMBER}\)[^\n]*?"
    r"))"
    r"(?P<more>[ \t]*(?:\((?:cont(?:inued|'?d|\.)?)\)|[-–—][ \t]*(?:cont(?:inued|'?d|\.)?))\.?)?"
    rf"(?P<open>[ \t]+(?:Beginning|Opening) Balance[ \t]+{_AMOUNT})?[ \t]*$",
    re.M | re.I,
)
#: Lines that begin like a heading but are totals, entries with an amount or references to an account.
_NOT_HEAD = re.compile(r"^(?:Sub-?total|Total|Ending Balance|Closing Balance|Beginning Balance|Opening Balance|REF\b|memo\b|Balance\b|Reclass)", re.I)
_MONTH = "(?:Jan|Feb|Mar|Apr|May|Jun|Jul|Aug|Sep|Oct|Nov|Dec)[a-z]*"
#: What follows a year in a report's title: what kind of report, or the period it is of.
_TITLE = re.compile(rf"^(?:19|20)\d{{2}}[ \t]+(?:(?:(?:Interim|Annual|Quarterly|Monthly|Yearly|Financial)[ \t]+)*Report\b|(?:Annual|Fiscal|Calendar)\b|{_MONTH}\.?(?:[ \t]+\d{{1,2}},?)?[ \t]*(?:through|thru|to|until|-|–|$)|(?:First|Second|Third|Fourth|Q[1-4])\b[^\n]*\bQuarter|Year[ \t]+End)", re.I)
_TRAILING_AMOUNT = re.compile(r"[ \t](?=[($\d-]*\d[\d,]*\.\d\d[)-]?$)")
_TOTAL = re.compile(rf"^(?:Total(?: for)?|Ending Balance)[ \t]+(?P<acct>{_NUMBER}[ \t]+[^\n]*?)[ \t]{{2,}}{_AMOUNT}[ \t]*$", re.M | re.I)
_OPENS = re.compile(rf"\s*(?:Beginning|Opening) Balance[ \t]+{_AMOUNT}", re.I)
_PAGE = re.compile(r"^(?:-{2,}[ \t]*(?:PAGE|SHEET)\b[^\n]*-{2,}|[-=_*]{5,})[ \t]*$", re.M | re.I)


def _flat(text: str) -> str:
    """Same length, with every line end as one newline."""
    return text.replace("\r\n", " \n").replace("\r", "\n") if "\r" in text else text


def headings(text: str) -> list[tuple[int, str, int]]:
    """``(start, heading, strength)`` of the lines that may head an account, in order: ``HEADING``, or ``CARRIED`` for one that goes on.

    ``start`` is the first character of the line, after form feeds. Two points for a number in parts or beside a label, one for a
    bare number; one more for a balance that opens the account, on the line or the next, and one for a total that names the
    number further on; two less for what reads as a report's title. A line with a point left heads an account.
    """
    flat = _flat(text)
    out = []
    totals: dict[str, int] | None = None
    for m in _HEAD.finditer(flat):
        head = m["head"].rstrip()
        if _NOT_HEAD.search(head) or _TRAILING_AMOUNT.search(head):
            continue
        points = 1 if m["bare"] else 2
        if m["bare"] and _TITLE.search(head):
            points -= 2
            points += bool(m["open"]) or bool(_OPENS.match(flat, m.end()))
            if totals is None:
                totals = {t["acct"][:4]: t.start() for t in _TOTAL.finditer(flat)}
            points += totals.get(m["bare"], -1) > m.start()
        if points > 0:
            out.append((m.start("head"), head, CARRIED if m["more"] is not None else HEADING))
    return out


class Cuts:
    """A sparse table over the cuts of one text: ``strongest(lo, hi)`` is the best cut position in ``[lo, hi]``."""

    def __init__(self, positions: np.ndarray, strength: np.ndarray):
        self.positions = positions
        self.levels = [(strength.astype(np.int64) << 32) | np.arange(len(positions), dtype=np.int64)]

    def _level(self, k: int) -> np.ndarray:
        while len(self.levels) <= k:
            last, half = self.levels[-1], 1 << (len(self.levels) - 1)
            self.levels.append(np.maximum(last[:-half], last[half:]))
        return self.levels[k]

    def strongest(self, lo: int, hi: int) -> int | None:
        a, b = np.searchsorted(self.positions, (lo, hi + 1))
        if a >= b:
            return None
        k = int(b - a).bit_length() - 1
        row = self._level(k)
        best = max(row[a], row[b - (1 << k)])
        return int(self.positions[best & 0xFFFFFFFF])

    def all_of(self, least: int) -> list[int]:
        """Positions of all cuts of strength ``least`` or more, in order: the strongest, then those on either side of it."""
        out, open_ranges = [], [(0, len(self.positions))]
        while open_ranges:
            a, b = open_ranges.pop()
            if a >= b:
                continue
            k = int(b - a).bit_length() - 1
            row = self._level(k)
            best = int(max(row[a], row[b - (1 << k)]))
            if best >> 32 >= least:
                at = best & 0xFFFFFFFF
                out.append(int(self.positions[at]))
                open_ranges += [(a, at), (at + 1, b)]
        return sorted(out)


def cuts(text: str, heads: list[tuple[int, str, int]]) -> Cuts:
    """All positions of ``text`` where a piece may begin, with their strengths."""
    flat = _flat(text)
    c = np.frombuffer(flat.encode("utf-32-le", "surrogatepass"), np.uint32)
    n = len(c)
    nl = c == 10
    white = nl | (c == 32) | (c == 9) | (c == 11) | (c == 12) | (c == 13) | (c == 0xA0) | (c == 0x3000) | ((c >= 0x2000) & (c <= 0x200A)) | (c == 0x2028) | (c == 0x2029)
    strength = np.zeros(n, np.int8)
    strength[1:][white[:-1] & ~white[1:]] = WORD
    end = (c == 46) | (c == 33) | (c == 63) | (c == 59) | (c == 0x3002)
    if n > 2:
        strength[2:][end[:-2] & white[1:-1] & ~white[2:]] = SENTENCE
    strength[1:][nl[:-1]] = LINE
    starts = np.flatnonzero(nl[:-1]) + 1
    if len(starts):
        # a line is blank if no visible character lies between its start and the next newline
        visible = np.r_[0, np.cumsum(~white)]
        prev = np.r_[0, starts[:-1]]
        strength[starts[visible[starts] == visible[prev]]] = PARAGRAPH
        strength[starts[nl[starts]]] = LINE
    for m in _PAGE.finditer(flat):
        if m.start():
            strength[m.start()] = PAGE
    for h, _, how in heads:
        strength[h] = how
    at = np.flatnonzero(strength)
    return Cuts(at, strength[at])


def _hard(text: str, at: int, low: int) -> int:
    """A cut inside a word, moved back off combining marks, joiners and the middle of a line end."""
    from unicodedata import combining

    p = at
    while p > low and (combining(text[p]) or text[p] in "‍️" or text[p - 1] == "‍" or text[p - 1 : p + 1] == "\r\n"):
        p -= 1
    return p if p > low else at


def pieces(text: str, limit: int, overlap: int, table: Cuts) -> list[tuple[int, int]]:
    """``(start, end)`` of the pieces: each at most ``limit`` long, each but the first beginning ``overlap`` before the end of the last."""
    n, out, start, last = len(text), [], 0, 0
    limit = max(1, limit)
    overlap = min(max(0, overlap), limit - 1)
    while n - start > limit:
        low, high = max(start + (limit + 1) // 2, last + 1), start + limit
        cut = table.strongest(low, high) or _hard(text, high, low)
        out.append((start, cut))
        start, last = cut - overlap, cut
    out.append((start, n))
    return out


def _context(first: str | None, heads: list[tuple[int, str, int]], text: str, ledger: bool) -> str | None:
    """Heading of the account in which the text begins: as given; else from a carry-on heading or total that comes first."""
    if first or not ledger:
        return first
    m = _TOTAL.search(_flat(text))
    if heads and (not m or heads[0][0] < m.start()):
        return heads[0][1][:CONTEXT_CHARS] if heads[0][2] == CARRIED else None
    return m["acct"].rstrip()[:CONTEXT_CHARS] if m else None


def split_text(text: str, limit: int, overlap: int, context: str | None = None, ledger: bool = False) -> tuple[list[tuple[int, int, str | None]], list[int]]:
    """Pieces as ``(start, end, account context)``, and the starts of the account blocks that begin in the text."""
    heads = headings(text) if ledger else []
    table = cuts(text, heads) if heads or len(text) > limit else None
    begun = table.all_of(HEADING) if heads else []
    spans = pieces(text, limit, overlap, table) if len(text) > limit else [(0, len(text))]
    opening = _context(context, heads, text, ledger)
    at = np.array([h[0] for h in heads])
    out = []
    for s, e in spans:
        k = int(np.searchsorted(at, s, "right")) - 1 if heads else -1
        out.append((s, e, opening if k < 0 else heads[k][1][:CONTEXT_CHARS]))
    return out, begun


def split_oversized(
    df: DataFrame,
    id_col: str = "chunk_id",
    text_col: str = "text",
    limit_col: str = "max_chars",
    overlap_col: str = "overlap_chars",
    context_col: str = "account_context",
    type_col: str = "document_type",
    ledgers: tuple[str, ...] = LEDGERS,
    with_text: bool = True,
) -> DataFrame:
    """One row for each piece: ``id, piece_no, n_pieces, start_char, end_char, [text,] account_context, blocks``.

    ``blocks`` is the array of starts of account blocks (in the whole text) that begin in the part of the text which the
    piece adds to the piece before. A null text or limit gives no piece; an empty text, and any text within its limit, is
    one piece; a null overlap is 0; an overlap of the limit or more is cut to the limit less one. A word longer than the
    limit is cut at the limit. Repeated rows are split each. Map-only: no shuffle.
    """
    src = df.select(
        df[id_col].alias("id"),
        df[text_col].alias("text"),
        df[limit_col].cast("int").alias("size"),
        F.coalesce(df[overlap_col].cast("int"), F.lit(0)).alias("lap"),
        df[context_col].alias("ctx"),
        F.coalesce(df[type_col].isin(*ledgers), F.lit(False)).alias("ledger"),
    ).filter("text is not null and size is not null")
    kind = src.schema["id"].dataType.simpleString()
    schema = f"id {kind}, piece_no int, n_pieces int, start_char int, end_char int, " + "text string, " * with_text + "account_context string, blocks array<int>"

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            rows = []
            for i, text, size, lap, ctx, ledger in zip(f["id"], f["text"], f["size"], f["lap"], f["ctx"], f["ledger"]):
                parts, begun = split_text(text, int(size), int(lap), ctx, bool(ledger))
                done = -1
                for k, (s, e, c) in enumerate(parts):
                    mine = [b for b in begun if done <= b < e] if begun else []
                    done = e
                    rows.append((i, k, len(parts), s, e, *([text[s:e]] if with_text else []), c, mine))
            yield pd.DataFrame(rows, columns=["id", "piece_no", "n_pieces", "start_char", "end_char", *["text"] * with_text, "account_context", "blocks"])

    return src.mapInPandas(run, schema).withColumnRenamed("id", id_col)


def account_blocks(df: DataFrame, **kw) -> DataFrame:
    """``(id, start_char)`` of each account block that begins in a ledger text over its limit, from the splitter's pieces."""
    id_col = kw.get("id_col", "chunk_id")
    over = df.filter(F.col(kw.get("type_col", "document_type")).isin(*kw.get("ledgers", LEDGERS)) & (F.length(kw.get("text_col", "text")) > F.col(kw.get("limit_col", "max_chars"))))
    return split_oversized(over, with_text=False, **kw).select(id_col, F.explode("blocks").alias("start_char"))
