"""Flat tables of deeply nested records, by structural variants.

A bottom-up tree automaton gives every JSON value a state. Leaves have a state by their type, an array the set of its elements'
states, an object's state follows from its fields and their states, and, for an element of one of ``ARRAYS``, from the array
that holds it. The states of elements are the structural variants (``section_group``, ``account_balance``, ``box12_coded`` ...):
they decide what becomes a row, and each is routed to its own typed subtype table. The subtypes of a kind make up the kind's
table, and all share the keys of the common supertype: record, own path, parent's path, index, depth and variant.

Records are walked where they lie (a map without shuffle), to any depth, without recursion; the typed tables are projections of
that one node table.
"""

from __future__ import annotations

import json
import re
from typing import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.amounts import parse_amount

#: The arrays whose elements become rows.
ARRAYS = ("box12", "box14_other", "state", "local", "sections", "subsections", "accounts")
#: Further arrays of statements, for the layouts.
STATEMENT_ARRAYS = (*ARRAYS, "components", "bank_accounts")

NODE_SCHEMA = (
    "record_id {id}, node_path string, parent_path string, field string, position int, depth int, variant string, fields map<string,string>"
)

_SECTION = [("section_name", "section_name", "text"), ("section_total", "section_total", "money")]
_ACCOUNT = [("account_number", "account_number", "text"), ("account_name", "account_name", "text")]
#: Subtypes: variant -> (kind, typed columns (column, field, type)).
SUBTYPES: dict[str, tuple[str, list[tuple[str, str, str]]]] = {
    "box12_coded": ("box12", [("code", "code", "text"), ("amount", "amount", "money"), ("description", "description", "text")]),
    "box12_bare": ("box12", [("amount", "amount", "money"), ("description", "description", "text")]),
    "box14_labelled": ("box14_other", [("label", "label", "text"), ("amount", "amount", "money")]),
    "box14_bare": ("box14_other", [("amount", "amount", "money")]),
    "state_named": ("state", [("state_abbr", "state_abbr", "text"), ("state_id", "state_id", "text"), ("state_wages", "box16_state_wages", "money"), ("state_withheld", "box17_state_withheld", "money")]),
    "state_bare": ("state", [("state_id", "state_id", "text"), ("state_wages", "box16_state_wages", "money"), ("state_withheld", "box17_state_withheld", "money")]),
    "local_named": ("local", [("locality_name", "locality_name", "text"), ("local_wages", "box18_local_wages", "money"), ("local_withheld", "box19_local_withheld", "money")]),
    "local_bare": ("local", [("local_wages", "box18_local_wages", "money"), ("local_withheld", "box19_local_withheld", "money")]),
    "section_group": ("sections", _SECTION),
    "section_leaf": ("sections", _SECTION),
    "section_empty": ("sections", _SECTION),
    "account_balance": ("accounts", [*_ACCOUNT, ("balance", "balance", "money"), ("amount", "amount", "money")]),
    "account_amount": ("accounts", [*_ACCOUNT, ("amount", "amount", "money")]),
    "account_sides": ("accounts", [*_ACCOUNT, ("debit", "debit", "money"), ("credit", "credit", "money")]),
    "account_bare": ("accounts", _ACCOUNT),
    "component": ("components", [("component_name", "component_name", "text"), ("current_balance", "current_balance", "money"), ("annual_funding", "annual_funding", "money"), ("ytd_funding", "ytd_funding", "money")]),
    "bank_account": ("bank_accounts", [*_ACCOUNT, ("balance", "balance", "money")]),
}
#: Columns of a kind's table: those of its subtypes, first come first; a subtype without a column has null in it.
TABLES: dict[str, list[tuple[str, str, str]]] = {}
for _kind, _columns in SUBTYPES.values():
    TABLES.setdefault(_kind, []).extend(c for c in _columns if c not in TABLES[_kind])
TABLES["accounts"] = [c for c in TABLES["accounts"] if c[0] not in ("debit", "credit")] + [c for c in TABLES["accounts"] if c[0] in ("debit", "credit")]


# --- the automaton -------------------------------------------------------------------------------------------------

#: Transitions for elements, by holding array and first fit: (variant, fields of which the object has one, whether that field must
#: hold an element).
_TRANSITIONS: dict[str, tuple[tuple[str, tuple[str, ...], bool], ...]] = {
    "box12": (("box12_coded", ("code",), False), ("box12_bare", (), False)),
    "box14_other": (("box14_labelled", ("label",), False), ("box14_bare", (), False)),
    "state": (("state_named", ("state_abbr",), False), ("state_bare", (), False)),
    "local": (("local_named", ("locality_name",), False), ("local_bare", (), False)),
    "sections": (("section_group", ("sections", "subsections"), True), ("section_leaf", ("accounts",), True), ("section_empty", (), False)),
    "accounts": (("account_balance", ("balance",), False), ("account_amount", ("amount",), False), ("account_sides", ("debit", "credit"), False), ("account_bare", (), False)),
    "components": (("component", (), False),),
    "bank_accounts": (("bank_account", (), False),),
}
_TRANSITIONS["subsections"] = _TRANSITIONS["sections"]


class Automaton:
    """Deterministic, bottom-up; a transition is looked up once for each shape and kept."""

    def __init__(self) -> None:
        self._known: dict[tuple, str] = {}

    def leaf(self, value: object) -> str:
        return "null" if value is None else "flag" if isinstance(value, bool) else "number" if isinstance(value, (int, float)) else "text"

    def obj(self, children: frozenset, field: str | None = None) -> str:
        """State of an object from its ``(field, state of the value)`` pairs, the state of an array being the set of its elements';
        ``field``: the array whose element it is. An object that is no element is in the state ``object``."""
        if field is None:
            return "object"
        state = self._known.get((field, children))
        if state is None:
            if len(self._known) > 100_000:  # unusual field names must not fill a worker's memory
                self._known.clear()
            state = self._known[field, children] = self._decide(children, field)
        return state

    @staticmethod
    def _decide(children: frozenset, field: str) -> str:
        for variant, any_of, element in _TRANSITIONS[field]:
            if not any_of or any(n in any_of and (not element or (isinstance(s, frozenset) and bool(s & SUBTYPES.keys()))) for n, s in children):
                return variant
        raise AssertionError(field)


# --- reading -------------------------------------------------------------------------------------------------------

_TOKEN = re.compile(r'[ \t\n\r]*(?:([{}\[\],:])|(")|(-?(?:0|[1-9][0-9]*)(?:\.[0-9]+)?(?:[eE][-+]?[0-9]+)?)|(true|false|null))')
_CONSTANTS = {"true": True, "false": False, "null": None}


def read_deep(text: str, at: int = 0) -> tuple[object, int]:
    """The JSON value at ``at`` and where it ends, however deep it is; ValueError where there is none."""
    stack: list[list] = []  # [container, pending key]
    want = "value"
    while True:
        m = _TOKEN.match(text, at)
        if not m:
            raise ValueError("no JSON value")
        mark, at = m[1], m.end()
        closed = mark is not None and mark in "}]"
        if want == "key" or want == "first key":
            if m[2]:
                stack[-1][1], at = json.decoder.scanstring(text, at)
                m = _TOKEN.match(text, at)
                if not m or m[1] != ":":
                    raise ValueError("no colon")
                at, want = m.end(), "value"
                continue
            if not (mark == "}" and want == "first key"):
                raise ValueError("no key")
        elif want == "after":
            if mark == ",":
                want = "key" if isinstance(stack[-1][0], dict) else "value"
                continue
            if mark != ("}" if isinstance(stack[-1][0], dict) else "]"):
                raise ValueError("no end")
        elif mark == "{" or mark == "[":
            stack.append([{} if mark == "{" else [], None])
            want = "first key" if mark == "{" else "first"
            continue
        elif mark is not None and not (mark == "]" and want == "first"):
            raise ValueError("no value")
        if closed:
            value = stack.pop()[0]
        elif m[2]:
            value, at = json.decoder.scanstring(text, at)
        elif m[3] is not None:
            value = float(m[3]) if any(c in m[3] for c in ".eE") else int(m[3])
        else:
            value = _CONSTANTS[m[4]]
        if not stack:
            return value, at
        holder, key = stack[-1]
        if isinstance(holder, dict):
            holder[key] = value
        else:
            holder.append(value)
        want = "after"


def dump_deep(value: object) -> str:
    """JSON text of a value, however deep it is."""
    out: list[str] = []
    open_values: list = [value]
    while open_values:
        v = open_values.pop()
        if isinstance(v, _Raw):
            out.append(v)
        elif isinstance(v, (dict, list)) and v:
            ends = "{}" if isinstance(v, dict) else "[]"
            out.append(ends[0])
            open_values.append(_Raw(ends[1]))
            rows = [[x] for x in v] if isinstance(v, list) else [[_Raw(json.dumps(k, ensure_ascii=False) + ": "), x] for k, x in v.items()]
            for i in range(len(rows) - 1, -1, -1):
                open_values += [*reversed(rows[i]), *([_Raw(", ")] if i else [])]
        else:
            out.append(json.dumps(v, ensure_ascii=False))
    return "".join(out)


class _Raw(str):
    """Text that is JSON already."""


def loads(text: str, at: int = 0) -> tuple[object, int]:
    """The JSON value at ``at`` and its end: by the fast reader, else, where it is too deep, by the one without recursion."""
    try:
        return json.JSONDecoder().raw_decode(text, at)
    except RecursionError:
        return read_deep(text, at)


def dumps(value: object) -> str:
    try:
        return json.dumps(value, ensure_ascii=False)
    except RecursionError:
        return dump_deep(value)


def complete_record(text: str | None) -> dict | None:
    """The first complete JSON object in ``text``; None where there is none.

    Braces are matched outside strings. Balanced braces that aren't JSON are skipped; an object that never closes ends the
    search, so a cut-off record gives nothing, not its inner objects.
    """
    if not text:
        return None
    at = text.find("{")
    while at >= 0:
        try:
            return loads(text, at)[0]
        except ValueError:
            end = _closing(text, at)
            if end < 0:
                return None
            at = text.find("{", end)
    return None


def _closing(text: str, at: int) -> int:
    depth, quoted, i = 0, False, at
    while i < len(text):
        c = text[i]
        if quoted:
            if c == "\\":
                i += 1
            elif c == '"':
                quoted = False
        elif c == '"':
            quoted = True
        elif c == "{":
            depth += 1
        elif c == "}":
            depth -= 1
            if not depth:
                return i + 1
        i += 1
    return -1


def _elements(value: object) -> list | None:
    """The array that stands in an array field: itself, an object as its only element, or an array given as JSON text."""
    if isinstance(value, list):
        return value
    if isinstance(value, dict):
        return [value]
    if isinstance(value, str) and value.lstrip()[:1] == "[":
        text = value.strip()
        try:
            got, end = loads(text)
        except ValueError:
            return None
        return got if isinstance(got, list) and end == len(text) else None
    return None


def _text(value: object) -> str | None:
    return value if value is None or isinstance(value, str) else dumps(value)


class _Frame:
    """An object on the way: its open children, the states found so far, and its place in the object that holds it."""

    __slots__ = ("obj", "segment", "name", "field", "position", "children", "states", "arrays")

    def __init__(self, obj: dict, segment: str, name: str | None, field: str | None, position: int, automaton: Automaton, arrays: frozenset):
        self.obj, self.segment, self.name, self.field, self.position = obj, segment, name, field, position
        self.children: list[tuple] = []
        self.states: set = set()
        self.arrays: dict[str, set] = {}
        for key, value in obj.items():
            items = _elements(value) if key in arrays else None
            element = items is not None
            if items is None and isinstance(value, list):
                items = value
            if items is not None:
                held = self.arrays[key] = set()
                for i, x in enumerate(items):
                    if isinstance(x, dict):
                        self.children.append((x, f"{key}[{i}]", key, key if element else None, i))
                    else:
                        held.add("items" if isinstance(x, list) else automaton.leaf(x))
            elif isinstance(value, dict):
                self.children.append((value, key, key, None, 0))
            else:
                self.states.add((key, automaton.leaf(value)))
        self.children.reverse()


def walk(record: dict, automaton: Automaton, arrays: tuple[str, ...] = ARRAYS) -> Iterator[tuple[str, str, str, int, int, str, dict]]:
    """``(node path, parent path, field, position, depth, variant, scalar fields)`` of every element object of ``arrays``, children
    before the object that holds them."""
    known = frozenset(arrays)
    stack = [_Frame(record, "", None, None, 0, automaton, known)]
    while True:
        top = stack[-1]
        if top.children:
            stack.append(_Frame(*top.children.pop(), automaton, known))
            continue
        children = frozenset(top.states | {(n, frozenset(s)) for n, s in top.arrays.items()})
        state = automaton.obj(children, top.field)
        stack.pop()
        if not stack:
            return
        if top.field is not None:
            holder = ".".join(f.segment for f in stack[1:])
            path = f"{holder}.{top.segment}" if holder else top.segment
            yield path, holder, top.field, top.position, len(stack) - 1, state, {k: _text(v) for k, v in top.obj.items() if k not in known}
        above = stack[-1]
        if top.name in above.arrays:
            above.arrays[top.name].add(state)
        else:
            above.states.add((top.name, state))


#: Characters of paths after which rows are handed on: paths grow with the depth.
_BATCH_CHARS = 8_000_000


def nodes(df: DataFrame, id_col: str = "record_id", data_col: str = "data", arrays: tuple[str, ...] = ARRAYS) -> DataFrame:
    """One row for each element object of ``arrays``, with the supertype's keys and its scalar fields as text.

    Text around the record is ignored; null, empty and unreadable data give no rows. Elements that aren't objects keep
    their index and give no row. Rows that repeat are walked each. No shuffle.
    """
    src = df.select(df[id_col].alias("record_id"), df[data_col].alias("data")).filter("data is not null")
    columns = ["record_id", "node_path", "parent_path", "field", "position", "depth", "variant", "fields"]

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        automaton = Automaton()
        for f in frames:
            rows, chars = [], 0
            for i, text in zip(f["record_id"], f["data"]):
                record = complete_record(text)
                if record is None:
                    continue
                for n in walk(record, automaton, arrays):
                    rows.append((i, *n))
                    chars += len(n[0])
                    if chars > _BATCH_CHARS:
                        yield pd.DataFrame(rows, columns=columns)
                        rows, chars = [], 0
            yield pd.DataFrame(rows, columns=columns)

    return src.mapInPandas(run, NODE_SCHEMA.format(id=src.schema["record_id"].dataType.simpleString())).withColumnRenamed("record_id", id_col)


def party_blocks(df: DataFrame, field: str, data_col: str = "data") -> DataFrame:
    """``(name, address)`` of the object in ``field`` of each record, where it is an object; values that aren't text are null."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            rows = []
            for text in f["data"]:
                block = (complete_record(text) or {}).get(field)
                if isinstance(block, dict):
                    rows.append(tuple(v if isinstance(v, str) else None for v in (block.get("name"), block.get("address"))))
            yield pd.DataFrame(rows, columns=["name", "address"])

    return df.select(df[data_col].alias("data")).filter("data is not null").mapInPandas(run, "name string, address string")


def _typed(field: str, kind: str) -> Column:
    raw = F.col("fields")[field]
    return parse_amount(raw) if kind == "money" else raw


def subtype_table(node_rows: DataFrame, variant: str) -> DataFrame:
    """The table of one variant: the supertype's keys, then the subtype's own columns."""
    keys = [c for c in node_rows.columns if c not in ("fields", "field")]
    return node_rows.filter(F.col("variant") == variant).select(*keys, *[_typed(f, k).alias(c) for c, f, k in SUBTYPES[variant][1]])


def typed_table(node_rows: DataFrame, table: str) -> DataFrame:
    """A kind's table, all its subtypes together: the supertype's keys, then the kind's columns (null where a subtype has none)."""
    keys = [c for c in node_rows.columns if c not in ("fields", "field")]
    variants = [v for v, (kind, _) in SUBTYPES.items() if kind == table]
    has = lambda c: [v for v in variants if c in SUBTYPES[v][1]]
    cells = [(_typed(c[1], c[2]) if has(c) == variants else F.when(F.col("variant").isin(*has(c)), _typed(c[1], c[2]))).alias(c[0]) for c in TABLES[table]]
    return node_rows.filter(F.col("variant").isin(*variants)).select(*keys, *cells)


def links(node_rows: DataFrame, id_col: str = "record_id") -> DataFrame:
    """``(record, node_path, parent_path)``: the tree as an adjacency table."""
    return node_rows.select(id_col, "node_path", "parent_path")


#: The same nodes in SQL, as common table expressions that end with ``nodes``.
NODES_CTE = """
RECURSIVE base AS (
  SELECT record_id, regexp_extract(data, '(?s)[{].*[}]') AS rec FROM extractions
), t AS (
  SELECT record_id, '' AS path, '' AS parent, rec::JSON AS obj, false AS el FROM base WHERE rec <> '' AND json_valid(rec)
  UNION ALL
  SELECT record_id, base_path || CASE WHEN is_el THEN '[' || i || ']' ELSE '' END, holder, o, is_el FROM (
    SELECT record_id, holder, base_path, arr IS NOT NULL AS is_el,
      unnest(CASE WHEN arr IS NULL THEN [v] ELSE CAST(json_extract(arr, '$[*]') AS JSON[]) END) AS o,
      unnest(CASE WHEN arr IS NULL THEN [0] ELSE range(0, json_array_length(arr)::INT) END) AS i
    FROM (
      SELECT record_id, path AS holder, CASE WHEN path = '' THEN k ELSE path || '.' || k END AS base_path, v,
        CASE WHEN k NOT IN ('box12', 'box14_other', 'state', 'local', 'sections', 'subsections', 'accounts') THEN NULL
          WHEN json_type(v) = 'ARRAY' THEN v
          WHEN json_type(v) = 'OBJECT' THEN json_array(v)
          WHEN json_type(v) = 'VARCHAR' AND json_valid(v->>'$') AND left(ltrim(v->>'$'), 1) = '[' THEN (v->>'$')::JSON END AS arr
      FROM (
        SELECT record_id, path, k, json_extract(obj, '$."' || k || '"') AS v
        FROM (SELECT record_id, path, obj, unnest(json_keys(obj)) AS k FROM t WHERE json_type(obj) = 'OBJECT')
      )
    )
  ) WHERE json_type(o) = 'OBJECT'
)
, nodes AS (SELECT record_id, path AS node_path, parent AS parent_path, regexp_extract(path, '([a-z0-9_]+)\\[[0-9]+\\]$', 1) AS field, obj FROM t WHERE el)
"""
LINKS_SQL = f"WITH {NODES_CTE} SELECT record_id, node_path, parent_path FROM nodes"
