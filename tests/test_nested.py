import json
from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from ledgerloom.operators import nested as N


def paths(text):
    r = N.complete_record(text)
    return None if r is None else sorted((n[0], n[1]) for n in N.walk(r, N.Automaton()))


def test_paths_and_odd_forms():
    data = {
        "entity": {"name": "x", "state": "TX"},
        "assets": {"sections": [{"section_name": "a", "accounts": {"account_name": "n"}, "subsections": [None, {"accounts": json.dumps([1, {"account_name": "m"}])}]}, "n/a", 7]},
        "box12": None,
        "state": '{"state_abbr": "x"}',
        "local": "[broken",
        "extra": {"tags": [{"accounts": [{"z": 1}]}]},
    }
    assert paths("Here is {it}:\n```json\n" + json.dumps(data) + "\n``` {\"local\": [{}]}") == [
        ("assets.sections[0]", "assets"),
        ("assets.sections[0].accounts[0]", "assets.sections[0]"),
        ("assets.sections[0].subsections[1]", "assets.sections[0]"),
        ("assets.sections[0].subsections[1].accounts[1]", "assets.sections[0].subsections[1]"),
        ("extra.tags[0].accounts[0]", "extra.tags[0]"),
    ]


def test_cut_off_or_missing_records():
    assert paths('{"assets": {"sections": [{"accounts": [{"a": 1}]}') is None
    assert paths('{"a": "unclosed } ') is None
    assert paths(None) is None and paths("") is None and paths("null") is None and paths("[1]") is None
    assert paths('{"a": "}{", "local": [{}]}') == [("local[0]", "")]
    assert paths("{" * 5000) is None


def test_states_follow_the_shape():
    a = N.Automaton()
    leaf = {"section_name": "s", "accounts": [{"account_name": "n", "balance": 1}]}
    odd = {"box12": [{"code": "D"}, {"x": 1}], "box14_other": {"amount": 1}, "subsections": [{"accounts": [None, "x"], "sections": "n/a"}, {"subsections": [[], {}]}]}
    assert {n[0]: n[5] for n in N.walk(odd, a)} == {"box12[0]": "box12_coded", "box12[1]": "box12_bare", "box14_other[0]": "box14_bare", "subsections[0]": "section_empty", "subsections[1]": "section_group", "subsections[1].subsections[1]": "section_empty"}
    got = {n[0]: n[5] for n in N.walk({"sections": [{"subsections": [leaf]}, leaf, {"section_total": 1}, {}], "accounts": [{"account_name": "n", "amount": 1}, {"account_number": "1"}]}, a)}
    assert got == {
        "sections[0]": "section_group",
        "sections[0].subsections[0]": "section_leaf",
        "sections[0].subsections[0].accounts[0]": "account_balance",
        "sections[1]": "section_leaf",
        "sections[1].accounts[0]": "account_balance",
        "sections[2]": "section_empty",
        "sections[3]": "section_empty",
        "accounts[0]": "account_amount",
        "accounts[1]": "account_bare",
    }


def test_typed_tables(spark):
    w2 = {"box12": [{"code": "D", "amount": "(1,234.50)"}, {"code": None}], "state": {"state_abbr": "TX", "box16_state_wages": 5}, "local": []}
    rows = [(1, json.dumps(w2), "x"), (1, json.dumps(w2), "x"), (2, None, "x"), (None, json.dumps(w2), None)]
    df = spark.createDataFrame(rows, "record_id long, data string, variant string")
    n = N.nodes(df)
    box = N.typed_table(n, "box12").collect()
    assert len(box) == 6 and {(r.position, r.code, r.amount) for r in box} == {(0, "D", Decimal("-1234.50")), (1, None, None)}
    assert [r.state_wages for r in N.typed_table(n, "state").filter("record_id = 1").collect()] == [Decimal("5.00")] * 2
    assert N.nodes(df.limit(0)).count() == 0 and N.typed_table(n, "accounts").count() == 0


def test_every_node_has_its_parent(spark, sf):
    n = N.nodes(spark.read.parquet(f"{sf}/extractions.parquet")).collect()
    known = {(r.record_id, r.node_path) for r in n}
    assert len(known) == len(n) > 500
    for r in n:
        if r.parent_path.endswith("]"):
            assert (r.record_id, r.parent_path) in known
    assert {r.variant for r in n} >= {"section_group", "section_leaf", "account_balance", "account_amount", "box12_coded", "box14_labelled", "state_named", "local_named"}


def test_party_blocks(spark):
    rows = [(json.dumps({"employer": {"name": "A", "address": 5}}),), (json.dumps({"employer": None}),), ("broken {",), (None,)]
    assert [tuple(r) for r in N.party_blocks(spark.createDataFrame(rows, "data string"), "employer").collect()] == [("A", None)]


def test_variants_route_to_their_tables(spark):
    """An account that looks like a box 12 item is an account; each variant has a table of its own, which together make up the kind's."""
    df = spark.createDataFrame([(1, '{"accounts": [{"code": "D", "balance": 1}, {"code": "D"}, {"amount": "(2)"}, {"debit": 3}]}')], "record_id long, data string")
    n = N.nodes(df)
    rows = N.typed_table(n, "accounts").orderBy("position").collect()
    assert [r.variant for r in rows] == ["account_balance", "account_bare", "account_amount", "account_sides"] and N.typed_table(n, "box12").count() == 0
    assert [(r.balance, r.amount, r.debit) for r in rows] == [(1, None, None), (None, None, None), (None, -2, None), (None, None, 3)]
    split = [r.asDict() for v, (kind, _) in N.SUBTYPES.items() if kind == "accounts" for r in N.subtype_table(n, v).collect()]
    assert sorted(r["position"] for r in split) == [0, 1, 2, 3] and [r["debit"] for r in split if "debit" in r] == [3]
    assert "balance" not in N.subtype_table(n, "account_amount").columns


def deep(levels):
    text = '{"section_name": "end", "accounts": [{"account_name": "n", "balance": 1}]}'
    return '{"assets": {"sections": [' + '{"x": {"y": [1, "}"]}, "subsections": [' * levels + text + "]}" * levels + "]}}"


def test_any_depth(spark):
    """Deeper than the readers and the walk could recurse."""
    for levels in (900, 1100, 20000):
        record = N.complete_record("note " + deep(levels) + " end {")
        last = next(iter(N.walk(record, N.Automaton())))
        assert last[0].count(".subsections[0]") == levels and last[0].endswith(".accounts[0]") and last[4] == levels + 2 and last[5] == "account_balance"
    df = spark.createDataFrame([(1, deep(3000)), (2, '{"local": [{"a": ' + "[" * 5000 + "]" * 5000 + "}]}"), (3, '{"sections": ' + json.dumps("[" + deep(1500) + "]") + "}")], "record_id long, data string")
    got = {(r.record_id, r.n, r.d) for r in N.nodes(df).groupBy("record_id").agg(F.count("*").alias("n"), F.max("depth").alias("d")).collect()}
    assert got == {(1, 3002, 3002), (2, 1, 0), (3, 1503, 1503)}


def test_deep_reader_and_writer_agree_with_the_others():
    samples = [{}, [], {"a": [1, -2.5e3, "x\\\"\u00e9", None, True, False, {}, []], "b": {"c": [[{}], {"d": ""}]}}, "t", 5, None]
    for v in samples:
        text = json.dumps(v)
        assert N.read_deep(" " + text + " ", 0) == (v, len(text) + 1) and json.loads(N.dump_deep(v)) == v and N.dump_deep(v) == json.dumps(v, ensure_ascii=False)
    for bad in ("{", "[1,]", '{"a" 1}', '{"a":1,}', "[1 2]", "}", "", "tru", '{"a":]', "[}", '{1:2}', '{"a":1]'):
        with pytest.raises(ValueError):
            N.read_deep(bad)
