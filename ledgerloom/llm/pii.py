"""Personal information in free text, by a linear-chain conditional random field over word shapes.

The field is trained from a small labelled table (``pii_labelled.txt``, 560 pages of invented content made by ``pii_pages``) by
maximum likelihood. Its weights are kept beside the table under the table's hash (``python -m ledgerloom.llm.pii`` writes
them; with another table, training runs on the driver), and broadcast: their size follows the table's, not the corpus. Executors
cut pages into tokens, look up the weights of each distinct token window and decode pages in batches with a vectorised Viterbi.

Labels are B/I tags of NAME, ADDRESS, PHONE, EMAIL and ID_NUMBER. A short exact check on the decoded pieces follows: it
trims punctuation and drops pieces that can't be of their kind (a phone with too few or too many digits, see ``PHONE_DIGITS``;
an identity number without nine digits).
"""

from __future__ import annotations

import hashlib
import os
import re
import unicodedata
from functools import lru_cache
from typing import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

KINDS = ("NAME", "ADDRESS", "PHONE", "EMAIL", "ID_NUMBER")
LABELS = ("O", *(f"{p}-{k}" for k in KINDS for p in "BI"))
TABLE = os.path.join(os.path.dirname(__file__), "pii_labelled.txt")
WEIGHTS = os.path.join(os.path.dirname(__file__), "pii_weights.npz")
#: Digits that a phone number may have: a national number with its area code, up to the longest international one.
PHONE_DIGITS = (10, 15)

# Word lists of postal and personal writing.
STATES = "AL AK AZ AR CA CO CT DE FL GA HI ID IL IN IA KS KY LA ME MD MA MI MN MS MO MT NE NV NH NJ NM NY NC ND OH OK OR PA RI SC SD TN TX UT VT VA WA WV WI WY DC".split()
STREETS = "street str st avenue ave av boulevard boul blvd road rd drive drv dr lane ln court ct place pl parkway pkwy pky way wy circle cir terrace ter highway hwy trail trl square sq".split()
POINTS = "n s e w ne nw se sw no so north south east west northeast northwest southeast southwest".split()
UNITS = "apt apartment unit suite ste room rm floor fl lot".split()
TITLES = "mr mrs ms miss mx dr prof rev".split()
MONTHS = "january february march april may june july august september october november december".split()
FIRMS = "llc inc lp llp corp corporation company co ltd group associates association partners services service bank bakery roofing electric engineering manufacturing transportation insurance management construction importers".split()
BOXES = "po p.o pob box".split()
_CLASSES = [STATES, STREETS, POINTS, UNITS, TITLES, MONTHS, FIRMS, BOXES]
_CLASS = {w.lower(): i + 1 for i, ws in reversed(list(enumerate(_CLASSES))) for w in ws}

_SPACE, _LINE, _LETTER, _DIGIT, _PUNCT = range(5)


@lru_cache(maxsize=1)
def _char_classes() -> np.ndarray:
    """Class of every code point below 0x3000; higher ones count as letters."""
    out = np.full(0x3001, _LETTER, np.uint8)
    for i in range(0x3000):
        c = chr(i)
        k = unicodedata.category(c)
        out[i] = _LINE if c in "\n\r" else _SPACE if c.isspace() or k in ("Cc", "Cf") else _LETTER if k[0] in "LM" else _DIGIT if k == "Nd" else _PUNCT
    return out


class Tokens:
    """Tokens of several texts laid end to end: runs of letters, runs of digits, single marks, line ends."""

    def __init__(self, texts: list[str]):
        joined = "".join(texts)
        c = np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), np.uint32)
        size = np.fromiter(map(len, texts), np.int64, len(texts))
        self.text_end = np.cumsum(size)
        self.text_start = self.text_end - size
        k = _char_classes()[np.minimum(c, 0x3000)]
        new = np.ones(len(c), bool)
        new[1:] = (k[1:] != k[:-1]) | (k[1:] == _PUNCT) | (k[1:] == _LINE)
        new[self.text_start[size > 0]] = True
        if len(c) > 1:
            new[1:] &= ~((c[1:] == 10) & (c[:-1] == 13))  # one line end
        at = np.flatnonzero(new)
        end = np.r_[at[1:], len(c)]
        keep = k[at] != _SPACE if len(at) else np.zeros(0, bool)
        self.start, self.end = at[keep], end[keep]
        self.text = np.searchsorted(self.text_end, self.start, "right")
        before = np.r_[0, self.end[:-1]] if len(self.start) else self.start
        self.gap = np.minimum(self.start - np.maximum(before, self.text_start[self.text] if len(self.text) else 0), 2).astype(np.int32)
        self.words = [joined[a:b] for a, b in zip(self.start.tolist(), self.end.tolist())]


def shape(w: str) -> str:
    """``Xx``, ``XX``, ``xx``, ``d5``, a mark itself, or a line end."""
    if w[0] in "\r\n":
        return "\n"
    if w[0].isdigit():
        n = len(w)
        return ("9" if n in (3, 9) and w[0] == "9" else "") + (f"d{n}" if n < 6 else "d9" if n == 9 else "d6" if n < 9 else "d10")
    if not w[0].isalpha():
        return "-" if w in "-–—‑‐" else w if ord(w) < 128 else "?"
    if len(w) == 1:
        return "X" if w.isupper() else "x"
    return ("xx" if w.islower() else "XX" if w.isupper() else "Xx" if w[0].isupper() and w[1:].islower() else "xX") + ("2" if len(w) == 2 else "")


class Lexicon:
    """Numbers of words, shapes and word classes; a word that the table doesn't hold often enough is known by its shape."""

    def __init__(self, known: list[str], shapes: list[str]):
        self.word = {w: i for i, w in enumerate(known)}
        self.shape = {s: i for i, s in enumerate(shapes)}
        self.sizes = (len(self.word) + len(self.shape) + 2, len(self.shape) + 2, len(_CLASSES) + 2)  # the last number is beyond a page's ends
        self._clear()

    @classmethod
    def of(cls, words: list[str], least: int = 3) -> "Lexicon":
        counts: dict[str, int] = {}
        for w in words:
            counts[w.lower()] = counts.get(w.lower(), 0) + 1
        return cls(sorted(w for w, n in counts.items() if n >= least and not w[0].isdigit()), sorted({shape(w) for w in words}))

    def _clear(self) -> None:
        self._seen: dict[str, int] = {}
        self._number: dict[tuple[int, int, int], int] = {}
        self.triples = np.array([[n - 1 for n in self.sizes]], np.int32)  # 0 is beyond a page's ends

    def ids(self, words: list[str]) -> np.ndarray:
        """The number of each word's row of ``triples``: word, shape, class."""
        if len(self._seen) > 500_000:
            self._clear()
        seen, number = self._seen, self._number
        for w in set(words) - seen.keys():
            s = self.shape.get(shape(w), len(self.shape))
            low = w.lower()
            triple = (self.word.get(low, len(self.word) + s), s, _CLASS.get(low, 0))
            seen[w] = number.setdefault(triple, len(number) + 1)
        if len(number) >= len(self.triples):
            self.triples = np.array([[n - 1 for n in self.sizes], *number], np.int32)
        return np.fromiter(map(seen.__getitem__, words), np.int32, len(words))


#: Feature templates: offsets of words, shapes and classes alone and in pairs; the gap before a token.
_ONES = [(a, o) for a, reach in ((0, 3), (1, 2), (2, 2)) for o in range(-reach, reach + 1)]
_TWOS = [((1, -1), (1, 0)), ((1, 0), (1, 1)), ((0, -1), (1, 0)), ((1, 0), (0, 1)), ((0, -2), (0, -1)), ((0, 1), (0, 2)), ((1, -2), (1, -1)), ((1, 1), (1, 2)), ((2, 0), (1, 1)), ((2, 0), (2, 1)), ((2, -1), (2, 0))]


_REACH = 3
_MIX = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F, 0xE7037ED1A0B428DB, 0x8EBC6AF09C88C6E3, 0x589965CC75374CC3], np.uint64)


def windows(lex: Lexicon, t: Tokens) -> np.ndarray:
    """``(8, n)``: the numbers of the tokens from three before to three after each token, and the gaps around it."""
    ids = lex.ids(t.words)
    n = len(ids)
    out = np.zeros((2 * _REACH + 2, n), np.int32)
    for o in range(-_REACH, _REACH + 1):
        if o == 0:
            out[_REACH] = ids
        elif abs(o) < n:
            src, dst = (slice(0, n + o), slice(-o, n)) if o < 0 else (slice(o, n), slice(0, n - o))
            out[o + _REACH, dst] = np.where(t.text[src] == t.text[dst], ids[src], 0)
    out[-1] = t.gap * 3 + (np.r_[t.gap[1:], 0].astype(np.int32) if n else t.gap)
    return out


def features(lex: Lexicon, w: np.ndarray) -> Iterator[tuple[np.ndarray, int]]:
    """For each template, the number of every window's feature, and how many numbers there are."""
    code = {(a, o): lex.triples[w[o + _REACH], a] for a in range(3) for o in range(-_REACH, _REACH + 1)}
    for a, o in _ONES:
        yield code[a, o], lex.sizes[a]
    for (a, o), (b, p) in _TWOS:
        yield code[a, o] * lex.sizes[b] + code[b, p], lex.sizes[a] * lex.sizes[b]
    yield w[-1], 9
    yield code[1, 0] * 9 + w[-1], lex.sizes[1] * 9


def _allowed() -> np.ndarray:
    """Scores of label pairs: an I tag follows its own B or I only."""
    out = np.zeros((len(LABELS), len(LABELS)), np.float32)
    for j, to in enumerate(LABELS):
        if to[0] == "I":
            for i, frm in enumerate(LABELS):
                if frm[2:] != to[2:]:
                    out[i, j] = -1e4
    return out


class Field:
    """A conditional random field: weights of features by label, and of label pairs."""

    def __init__(self, lex: Lexicon, index: list[np.ndarray], weights: np.ndarray, pairs: np.ndarray):
        self.lex, self.index, self.weights, self.pairs = lex, index, weights, pairs

    def scores(self, t: Tokens) -> np.ndarray:
        """Scores of every token's labels: those of each distinct window, looked up once."""
        w = windows(self.lex, t)
        key = (w.astype(np.uint64) * _MIX[:, None]).sum(0)
        _, first, which = np.unique(key ^ (key >> np.uint64(29)), return_index=True, return_inverse=True)
        out = np.zeros((len(first), len(LABELS)), np.float32)
        for (col, _), index in zip(features(self.lex, w[:, first]), self.index):
            out += self.weights[index[col]]
        return out[which]

    def save(self, path: str, key: str) -> None:
        seen = [np.flatnonzero(x).astype(np.int32) for x in self.index]
        rank = np.concatenate([x[s] for x, s in zip(self.index, seen)])
        np.savez_compressed(path, key=np.array(key), words=np.array("\0".join(self.lex.word)), shapes=np.array("\0".join(self.lex.shape)), seen=np.concatenate(seen), size=np.array([len(s) for s in seen]), weights=self.weights[rank].astype(np.float16), pairs=self.pairs)

    @classmethod
    def load(cls, path: str, key: str) -> "Field | None":
        """The field saved under ``key``; None where there is none."""
        if not os.path.exists(path):
            return None
        with np.load(path) as z:
            if str(z["key"]) != key:
                return None
            lex = Lexicon(str(z["words"]).split("\0"), str(z["shapes"]).split("\0"))
            weights = np.r_[np.zeros((1, len(LABELS)), np.float32), z["weights"].astype(np.float32)]
            index, made = [], 1
            empty = np.zeros((_REACH * 2 + 2, 0), np.int32)
            for (_, size), seen in zip(features(lex, empty), np.split(z["seen"], np.cumsum(z["size"])[:-1])):
                look = np.zeros(size, np.int32)
                look[seen] = np.arange(made, made + len(seen))
                made += len(seen)
                index.append(look)
            return cls(lex, index, weights, z["pairs"])

    def decode(self, t: Tokens, batch: int = 1024) -> np.ndarray:
        """The best label of every token: Viterbi over all texts of a batch at once, longest texts first."""
        scores = self.scores(t)
        labels = np.zeros(len(scores), np.int8)
        n = np.bincount(t.text, minlength=len(t.text_start)) if len(scores) else np.zeros(0, int)
        first = np.r_[0, np.cumsum(n)[:-1]] if len(n) else n
        order = np.argsort(-n, kind="stable")
        order = order[n[order] > 0]
        trans = (self.pairs + _allowed()).astype(np.float32)
        onward = np.ascontiguousarray(trans.T)[:, :, None]
        start = np.where([x[0] == "I" for x in LABELS], -1e4, 0).astype(np.float32)
        for at in range(0, len(order), batch):
            some = order[at : at + batch]
            length, base = n[some], first[some]
            best = (scores[base] + start).T
            past = []  # best scores by label of the texts alive at each position: the way back is found from them
            final = np.zeros((len(LABELS), len(some)), np.float32)
            alive = len(some)
            for i in range(1, length[0] + 1):
                still = int(np.searchsorted(-length, -i, "left"))  # texts with more than i tokens
                final[:, still:alive] = best[:, still:alive]
                alive = still
                if not alive:
                    break
                best = best[:, :alive]
                past.append(best)
                best = (best[None] + onward).max(1) + scores[base[:alive] + i].T
            last = final.argmax(0)
            for i in range(length[0] - 1, -1, -1):
                live = int(np.searchsorted(-length, -i, "left"))
                labels[base[:live] + i] = last[:live]
                if i:
                    last[:live] = (past[i - 1][:, :live] + trans[:, last[:live]]).argmax(0)
        return labels


# --- training ------------------------------------------------------------------------------------------------------

_MARK = re.compile(r"⟦([A-Z_]+)\|(.*?)⟧", re.S)


def labelled(path: str = TABLE) -> list[tuple[str, list[tuple[str, int, int]]]]:
    """``(text, [(kind, start, end)])`` of the pages of a labelled table: pieces are written ``⟦KIND|piece⟧``, pages divided by ``%%%%``."""
    with open(path, encoding="utf-8") as f:
        pages = f.read().split("\n%%%%\n")
    out = []
    for page in pages:
        text, spans, at = "", [], 0
        for m in _MARK.finditer(page):
            text += page[at : m.start()]
            spans.append((m[1], len(text), len(text) + len(m[2])))
            text += m[2]
            at = m.end()
        out.append((text + page[at:], spans))
    return out


def augmented(pages: list[tuple[str, list[tuple[str, int, int]]]]) -> list[tuple[str, list[tuple[str, int, int]]]]:
    """Lines of the pages as pages of their own: those that begin with a name, as a text's first words may, and those with an
    identity number, its digits run together, as few of the table are; in every fourth line, names turn to surname first."""
    out, seen = [], 0
    for text, spans in pages:
        cuts = [0, *(i + 1 for i, c in enumerate(text) if c == "\n" and not any(s <= i < e for _, s, e in spans)), len(text)]
        for a, b in zip(cuts, cuts[1:]):
            mine = [(k, s, e) for k, s, e in spans if a <= s and e <= b]
            plain = [text[s:e] for k, s, e in mine if k == "NAME" and re.fullmatch(r"\w+ \w+", text[s:e])]
            seen += bool(plain)
            turn = bool(plain) and seen % 4 == 0
            if not (turn or any(k == "ID_NUMBER" or (k == "NAME" and s == a) for k, s, _ in mine)):
                continue
            line, moved, at = "", [], a
            for k, s, e in mine:
                line += text[at:s]
                piece = text[s:e]
                if k == "ID_NUMBER":
                    piece = re.sub(r"\D", "", piece)
                elif turn and piece in plain:
                    piece = ", ".join(reversed(piece.split()))
                moved.append((k, len(line), len(line) + len(piece)))
                line += piece
                at = e
            out.append((line + text[at:b], moved))
    return out


def train(pages: list[tuple[str, list[tuple[str, int, int]]]], rounds: int = 90, penalty: float = 0.02) -> Field:
    """Maximum likelihood by full-batch gradient steps with adaptive rates; deterministic."""
    pages = pages + augmented(pages)
    t = Tokens([p for p, _ in pages])
    lex = Lexicon.of(t.words)
    gold = np.zeros(len(t.words), np.int64)
    for i, (_, spans) in enumerate(pages):
        base = t.text_start[i]
        for kind, s, e in spans:
            a, b = np.searchsorted(t.start, (base + s, base + e))
            gold[a:b] = LABELS.index(f"I-{kind}")
            gold[a] = LABELS.index(f"B-{kind}")
    index, columns, made = [], [], 1
    for col, size in features(lex, windows(lex, t)):
        seen = np.unique(col)
        look = np.zeros(size, np.int32)
        look[seen] = np.arange(made, made + len(seen))
        made += len(seen)
        index.append(look)
        columns.append(look[col])
    m, n_tok = len(LABELS), len(gold)
    cols = np.stack(columns)
    n = np.bincount(t.text, minlength=len(pages))
    order = np.argsort(-n, kind="stable")
    first = np.r_[0, np.cumsum(n)[:-1]][order]
    length = n[order]
    live = [int(np.searchsorted(-length, -i, "left")) for i in range(length[0] + 1)]
    w, pairs = np.zeros((made, m)), np.zeros((m, m))
    follow = gold[1:][t.text[1:] == t.text[:-1]], gold[:-1][t.text[1:] == t.text[:-1]]
    gold_pairs = np.zeros((m, m))
    np.add.at(gold_pairs, (follow[1], follow[0]), 1)
    gold_w = np.zeros((made, m))
    for c in cols:
        np.add.at(gold_w, (c, gold), 1)
    low = [int(c.min()) for c in cols]  # a template's features are numbered together
    ends = [int(c.max()) + 1 for c in cols]
    allowed = _allowed().astype(float)
    begin = np.where([x[0] == "I" for x in LABELS], -1e4, 0.0)
    state = [(np.zeros_like(x), np.zeros_like(x)) for x in (w, pairs)]
    for step in range(1, rounds + 1):
        s = np.zeros((n_tok, m))
        for c in cols:
            s += w[c]
        trans = pairs + allowed
        # forward and backward over all pages at once, normalised at each position
        alpha = np.zeros((n_tok, m))
        beta = np.zeros((n_tok, m))
        expt = np.exp(trans)
        exps = np.exp(s - s.max(1, keepdims=True))
        a = exps[first] * np.exp(begin)
        a /= a.sum(1, keepdims=True)
        alpha[first] = a
        for i in range(1, length[0]):
            k = live[i]
            a = (a[:k] @ expt) * exps[first[:k] + i]
            a /= a.sum(1, keepdims=True)
            alpha[first[:k] + i] = a
        expected = np.zeros((m, m))
        b = np.ones((len(first), m))
        for i in range(length[0] - 1, -1, -1):
            k = live[i]
            k2 = live[i + 1] if i + 1 < len(live) else 0
            b[k2:k] = 1
            if k2:
                nxt = b[:k2] * exps[first[:k2] + i + 1]
                al = alpha[first[:k2] + i]
                z = np.einsum("bi,ij,bj->b", al, expt, nxt)
                expected += np.einsum("bi,bj->ij", al / z[:, None], nxt) * expt
                nb = nxt @ expt.T
                b[:k2] = nb / nb.sum(1, keepdims=True)
            beta[first[:k] + i] = b[:k]
        p = alpha * beta
        p /= p.sum(1, keepdims=True)
        exp_w = np.zeros((made, m))
        columns_p = np.ascontiguousarray(p.T)
        for c, a0, b0 in zip(cols, low, ends):
            for j in range(m):
                exp_w[a0:b0, j] = np.bincount(c - a0, columns_p[j], b0 - a0)
        rate = 0.15 * (1 - step / (rounds + 1))
        for x, g, (m1, m2) in ((w, gold_w - exp_w - penalty * w, state[0]), (pairs, gold_pairs - expected - penalty * pairs, state[1])):
            m1 += 0.1 * (g - m1)
            m2 += 0.01 * (g * g - m2)
            x += rate * (m1 / (1 - 0.9**step)) / (np.sqrt(m2 / (1 - 0.99**step)) + 1e-8)
    w[0] = 0
    return Field(lex, index, w.astype(np.float16).astype(np.float32), pairs.astype(np.float32))


def _key(path: str) -> str:
    """Hash of the table and of the features, under which weights are kept."""
    with open(path, "rb") as f:
        return hashlib.sha256(f.read() + repr((LABELS, _ONES, _TWOS, _CLASSES)).encode()).hexdigest()


@lru_cache(maxsize=2)
def field(path: str = TABLE, weights: str = WEIGHTS) -> Field:
    """The field of a labelled table: its kept weights, else trained here."""
    return Field.load(weights, _key(path)) or train(labelled(path))


# --- pieces --------------------------------------------------------------------------------------------------------

_SHORT = [w for w in STREETS + POINTS if w not in "street avenue boulevard road drive lane court place parkway way circle terrace highway trail square north south east west northeast northwest southeast southwest".split()]
_STREET_END = re.compile(rf"\b(?:{'|'.join(_SHORT)}|[NSEW]\.[EW])$", re.I)
_JOINT = re.compile(r"\s+(?:and|&|und|et|y)\s+|\.[ \t]*[\r\n]+")
_AMOUNT_AFTER = re.compile(r"[ \t]{2,}\$?\(?\d{1,7}$")
_TAIL = re.compile(r",\s+[a-z]+$")
_SENTENCE = re.compile(r"\b(?:at|in|to|of|near)\s+$")


def _checked(kind: str, text: str, s: int, e: int) -> tuple[int, int] | None:
    """The exact check: the piece without outer punctuation; None if it can't be of its kind."""
    marks = " \t\r\n,;:<>|\"" + ("" if kind in ("PHONE",) else "()" if kind != "EMAIL" else "")
    while s < e and text[s] in marks + ("." if kind != "EMAIL" else ""):
        s += 1
    while s < e and text[e - 1] in marks:
        e -= 1
    if kind == "ADDRESS":
        if m := _AMOUNT_AFTER.search(text, s, e):
            e = m.start()
        while e > s and text[e - 1] in "., $(\t\r\n":
            e -= 1
        # the full stop of an abbreviation stays, unless it is the only one at the end of a sentence
        if text[e : e + 1] == "." and _STREET_END.search(text, s, e):
            alone = not re.match(r"\.[ \t]*[.,]", text[e:]) and re.match(r"\.[ \t]*(?:[\r\n]|$)", text[e:])
            if not (alone and _SENTENCE.search(text[max(0, s - 8) : s])):
                e += 1
    elif kind == "NAME" and (m := _TAIL.search(text[s:e])) and not text[s:e].islower():
        e = s + m.start()
    elif text[s:e].endswith(".") and not (kind == "NAME" and re.search(r"(?:\b[A-Z]|Jr|Sr)\.$", text[s:e])):
        e -= 1
    piece = text[s:e]
    digits = sum(map(str.isdigit, piece))
    if kind == "PHONE":
        ok = PHONE_DIGITS[0] <= digits <= PHONE_DIGITS[1]
    elif kind == "ID_NUMBER":
        ok = digits == 9
    elif kind == "EMAIL":
        ok = bool(re.search(r"\S\s*(?:@|[\[(]\s*at\s*[\])])\s*\S", piece, re.I))
    elif kind == "ADDRESS":
        ok = digits > 0
    else:
        ok = digits == 0 and any(c.isalpha() for c in piece)
    return (s, e) if ok and s < e else None


def find_in(texts: list[str], model: Field) -> list[list[tuple[str, int, int]]]:
    """``(kind, start, end)`` of the pieces of each text, in order."""
    t = Tokens(texts)
    tags = model.decode(t)
    out: list[list[tuple[str, int, int]]] = [[] for _ in texts]
    begin = np.flatnonzero((tags > 0) & (tags % 2 == 1))
    inner = np.r_[(tags > 0) & (tags % 2 == 0), False]
    stop = np.flatnonzero(~inner)
    last = stop[np.searchsorted(stop, begin + 1)] - 1 if len(begin) else begin
    for b, e in zip(begin.tolist(), last.tolist()):
        i = t.text[b]
        base = int(t.text_start[i])
        kind = KINDS[(tags[b] - 1) // 2]
        at, upto = int(t.start[b]) - base, int(t.end[e]) - base
        # two names joined by a word are two
        joints = [m.span() for m in _JOINT.finditer(texts[i], at, upto)] if kind == "NAME" else []
        for s, u in zip([at, *(j[1] for j in joints)], [*(j[0] for j in joints), upto]):
            got = _checked(kind, texts[i], s, u)
            if got:
                out[i].append((kind, *got))
    return out


def mask(text: str, found: list[tuple[str, int, int]]) -> str:
    """The text with each piece replaced by ``[KIND]``, all else unchanged."""
    out, at = [], 0
    for kind, s, e in found:
        out += [text[at:s], f"[{kind}]"]
        at = e
    return "".join([*out, text[at:]])


def _pages(df: DataFrame, id_col: str, pages_col: str) -> DataFrame:
    return df.select(df[id_col].alias("id"), F.posexplode(df[pages_col]).alias("position", "p")).select("id", "position", F.col("p.page").cast("int").alias("page"), F.col("p.text").alias("text"))


def _run(df: DataFrame, table: str, masked: bool) -> DataFrame:
    shared = df.sparkSession.sparkContext.broadcast(field(table))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for at in range(0, b.num_rows, 2000):
                part = b.slice(at, 2000)
                texts = part.column(3).to_pylist()
                found = find_in([x or "" for x in texts], shared.value)
                if masked:
                    yield pa.RecordBatch.from_arrays([*part.columns[:3], pa.array([x if x is None else mask(x, f) for x, f in zip(texts, found)], pa.string())], ["id", "position", "page", "text"])
                else:
                    rows = [(i, *f) for i, fs in enumerate(found) for f in fs]
                    i = pa.array([r[0] for r in rows], pa.int32())
                    yield pa.RecordBatch.from_arrays([part.column(0).take(i), part.column(2).take(i), pa.array([r[1] for r in rows], pa.string()), *(pa.array([r[k] for r in rows], pa.int32()) for k in (2, 3))], ["id", "page", "kind", "start_char", "end_char"])

    kind = df.schema["id"].dataType.simpleString()
    return df.mapInArrow(run, f"id {kind}, position int, page int, text string" if masked else f"id {kind}, page int, kind string, start_char int, end_char int")


def find(df: DataFrame, id_col: str = "file_id", pages_col: str = "pages", table: str = TABLE) -> DataFrame:
    """``(id, page, kind, start_char, end_char)`` of every piece of personal information. Map-only.

    Null and empty page lists and null or empty texts have none; repeated rows are searched each; a null page number stays null.
    """
    return _run(_pages(df, id_col, pages_col), table, False).withColumnRenamed("id", id_col)


def mask_pages(df: DataFrame, id_col: str = "file_id", pages_col: str = "pages", table: str = TABLE) -> DataFrame:
    """``(id, position, page, text)``: every page, in its place of the list, with typed placeholders. Null texts stay null."""
    return _run(_pages(df, id_col, pages_col), table, True).withColumnRenamed("id", id_col)


if __name__ == "__main__":
    train(labelled()).save(WEIGHTS, _key(TABLE))
