from collections import defaultdict

from hypothesis import given, settings
from hypothesis import strategies as st

from ledgerloom.llm import pack as P


def unroll(counts, capacity, plan=P.plan):
    """Each rank of each length placed as the workers place it."""
    slots, made = plan(counts, capacity)
    bins = defaultdict(list)
    by = defaultdict(list)
    for s in slots.tolist():
        by[s[0]].append(s)
    for length, n in counts.items():
        for rank in range(n):
            s = [x for x in by[length] if x[1] <= rank][-1]
            far = rank - s[1]
            bins[s[2] + far // s[3]].append((s[4] + far % s[3], s[5] + far % s[3] * length, length))
    return bins, made


@settings(max_examples=200, deadline=None)
@given(st.dictionaries(st.integers(1, 100), st.integers(0, 30), max_size=25))
def test_plan_fills_no_container_over_its_capacity(counts):
    bins, made = unroll(counts, 100)
    assert set(bins) == set(range(made))
    total = 0
    for held in bins.values():
        held.sort()
        at = 0
        for k, (order, offset, length) in enumerate(held):
            assert order == k and offset == at
            at += length
        assert at <= 100
        total += at
    assert total == sum(k * n for k, n in counts.items())
    # at most one container is half empty or more
    assert sum(sum(x[2] for x in held) * 2 <= 100 for held in bins.values()) <= 1


@settings(max_examples=200, deadline=None)
@given(st.dictionaries(st.integers(1, 100), st.integers(0, 30), max_size=25))
def test_classes_alone_hold_a_fixed_count(counts):
    bins, made = unroll(counts, 100, P.harmonic)
    assert set(bins) == set(range(made))
    short = defaultdict(int)
    for held in bins.values():
        held.sort()
        assert [h[0] for h in held] == list(range(len(held))) and all(a[1] + a[2] == b[1] for a, b in zip(held, held[1:])) and held[0][1] == 0
        (k,) = {100 // x[2] for x in held}
        assert len(held) <= k and sum(x[2] for x in held) <= 100
        short[k] += len(held) < k
    assert all(n <= 1 for n in short.values()) and sum(map(len, bins.values())) == sum(counts.values())


def test_harmonic_class_fills_with_a_fixed_count():
    slots, made = P.plan({40: 7}, 100)
    assert made == 4 and slots.tolist() == [[40, 0, 0, 2, 0, 0], [40, 6, 3, 1, 0, 0]]


def test_dataframe(spark):
    rows = [(1, "word " * 3000, "x"), (2, "a b c", "x"), (2, "a b c", "x"), (3, None, "x"), (4, "", "x"), (5, " \n ", None), (None, "z", None)]
    df = spark.createDataFrame(rows, "doc_id long, text string, size string")
    out = P.pack(df, capacity=500).collect()
    by = defaultdict(list)
    for r in out:
        by[r.container].append((r.item_order, r.container_offset, r.end_token - r.start_token))
    for held in by.values():
        held.sort()
        assert [h[0] for h in held] == list(range(len(held))) and sum(h[2] for h in held) <= 500
    assert sorted(by) == list(range(len(by)))
    ones = sorted((r.start_token, r.end_token) for r in out if r.doc_id == 1)
    assert ones[0][0] == 0 and all(a[1] == b[0] for a, b in zip(ones, ones[1:])) and all(e - s == 500 for s, e in ones[:-1])
    assert sum(r.doc_id == 2 for r in out) == 2 and {r.doc_id for r in out} == {1, 2, 5, None}
    assert P.pack(df.limit(0)).count() == 0
    salted = sorted(tuple(r)[:3] + tuple(r)[4:] for r in P.pack(df, capacity=500, salt_rows=2).collect())
    assert salted == sorted(tuple(r)[:3] + tuple(r)[4:] for r in out)
    assert sum(r.doc_id == 1 for r in P.pack(df, capacity=500, rooms=False).collect()) == len(ones)


def test_whole_table_leaves_little_room(spark, sf):
    df = spark.read.parquet(f"{sf}/documents.parquet")
    out = P.pack(df).collect()
    tokens = sum(r.end_token - r.start_token for r in out)
    n = max(r.container for r in out) + 1
    assert n <= -(-tokens // 2048) + 1
    assert {r.doc_id for r in out} == {r.doc_id for r in df.filter("length(text) > 0").collect()}
