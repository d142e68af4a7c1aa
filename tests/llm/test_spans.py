import random
from collections import defaultdict

import pytest

from ledgerloom.llm import spans as S

ALPHABET = "abcdefghij klmno. pqr\nstu "


def brute(rows, n=S.LENGTH):
    """Every window of every text, literally."""
    where = defaultdict(set)
    for d, t in rows:
        if d is not None and t:
            for i in range(len(t) - n + 1):
                where[t[i : i + n]].add(d)
    out = set()
    for d, t in rows:
        if d is None or not t:
            continue
        hit = [False] * len(t)
        for i in range(len(t) - n + 1):
            if len(where[t[i : i + n]]) > 1:
                hit[i : i + n] = [True] * n
        s = None
        for i, x in enumerate([*hit, False]):
            if x and s is None:
                s = i
            elif not x and s is not None:
                out.add((d, s, i))
                s = None
    return out


def made(seed, n_docs=60):
    r = random.Random(seed)
    text = lambda k: "".join(r.choice(ALPHABET) for _ in range(k))
    passages = [text(r.choice([150, 199, 200, 201, 230, 260, 400, 900])) for _ in range(12)] + ["ab" * 300, "x" * 450, "é😀 " * 120, "no spaces at all".replace(" ", "") * 30]
    rows = []
    for d in range(n_docs):
        parts = []
        for _ in range(r.randint(0, 4)):
            parts.append(text(r.randint(0, 150)))
            if r.random() < 0.7:
                p = r.choice(passages)
                a = r.randint(0, max(0, len(p) - 205)) if r.random() < 0.4 else 0
                parts.append(p[a : a + r.choice([199, 200, 210, 300, 2000])])
        rows.append((d, "".join(parts)))
    rows += [(1000, rows[3][1]), (1001, rows[3][1]), (3, rows[3][1]), (1002, None), (1003, ""), (None, rows[4][1]), (1004, "x" * 2000), (1005, "x" * 199)]
    edited = rows[5][1]
    rows.append((1006, edited[: len(edited) // 2] + "#" + edited[len(edited) // 2 :]))
    return rows


@pytest.mark.parametrize("seed", range(1, 7))
def test_same_as_brute_force(spark, seed):
    rows = made(seed)
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = [tuple(r) for r in S.shared_spans(df).collect()]
    assert len(got) == len(set(got)) and set(got) == brute(rows) and got


def test_hot_passage(spark):
    """A third of all rows holds one passage, each in other surroundings."""
    r = random.Random(9)
    text = lambda k: "".join(r.choice(ALPHABET) for _ in range(k))
    hot = text(333)
    rows = [(d, text(r.randint(30, 300)) + (hot if d % 3 == 0 else "") + text(r.randint(30, 300))) for d in range(240)]
    got = {tuple(x) for x in S.shared_spans(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == brute(rows) and len(got) == 80


def test_data_and_shares(spark, sf):
    df = spark.read.parquet(f"{sf}/documents.parquet")
    rows = [(r.doc_id, r.text) for r in df.select("doc_id", "text").collect()]
    want = brute(rows)
    assert {tuple(r) for r in S.shared_spans(df).collect()} == want and want
    chars = defaultdict(int)
    for d, s, e in want:
        chars[d] += e - s
    out = S.shared_shares(df).collect()
    assert len(out) == len(rows) and {r.doc_id: r.shared_chars for r in out if r.shared_chars} == dict(chars)
    assert all((r.shared_share is None) == (not r.n_chars) for r in out)


def test_empty(spark):
    df = spark.createDataFrame([(1, "x" * 300)], "doc_id long, text string")
    assert S.shared_spans(df).count() == 0 and S.shared_spans(df.limit(0)).count() == 0


def test_boundaries_depend_on_near_characters_only():
    r = random.Random(5)
    text = lambda k: "".join(r.choice(ALPHABET) for _ in range(k))
    for _ in range(30):
        p, a, b = text(400), text(r.randint(100, 400)), text(r.randint(100, 400))
        x, y = S.Block([a + p + text(90)]), S.Block([b + p + text(300)])
        inner = lambda k, o: {int(q) - o for q, f, l in zip(k.at, k.first, k.last) if l >= o + S.CONTEXT and f + S.WIDTH + S.CONTEXT <= o + 400}
        assert inner(x, len(a)) == inner(y, len(b))


def brute_later(rows, n=S.LENGTH):
    """Sentences that lie in characters which a smaller id holds too, dropped literally."""
    import re

    least = {}
    for d, t in rows:
        if d is not None and t:
            for i in range(len(t) - n + 1):
                w = t[i : i + n]
                least[w] = min(least.get(w, d), d)
    out = []
    for d, t in rows:
        kept, hit = t, [False] * len(t or "")
        if d is not None and t:
            for i in range(len(t) - n + 1):
                if least[t[i : i + n]] < d:
                    hit[i : i + n] = [True] * n
            kept = "".join(m[0] for m in re.finditer(S.SENTENCE, t) if not all(hit[m.start() : m.end()]))
        out.append((d, kept, len(t or "") - len(kept or "")))
    return out


@pytest.mark.parametrize("seed", [1, 4])
def test_later_repeats_are_dropped(spark, seed):
    rows = made(seed)
    got = [tuple(r) for r in S.without_repeats(spark.createDataFrame([(*r, 1) for r in rows], "doc_id long, text string, spans int")).collect()]
    key = lambda r: (r[0] is None, r[0] or 0, r[1] or "")
    assert sorted(got, key=key) == sorted(brute_later(rows), key=key) and sum(r[2] for r in got) > 1000
    assert {r[0]: r[1] for r in got}[1000] == ""


def test_second_hash_is_independent():
    k = S.Block(["abcabcabd" * 50])
    a = S.np.arange(0, 300, 3)
    one, two = k.hash(a, a + 9), k.hash(a, a + 9, S._C)
    assert (one != two).all() and len(set(one)) == len(set(two)) == len({("abcabcabd" * 50)[i : i + 9] for i in a})
