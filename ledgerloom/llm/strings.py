"""String distances and graph components shared by the entity-resolution operators."""

from __future__ import annotations

from collections import Counter

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import Written


def records(column) -> list:
    """Rows of a struct column as it comes to a pandas function: a frame, or a series of mappings."""
    return column.to_dict("records") if hasattr(column, "columns") else list(column)


def distance(a: str, b: str, most: int = 2) -> int:
    """Edits between ``a`` and ``b`` (insert, delete, replace, swap of neighbours); ``most + 1`` where there are more.

    Only the diagonals within ``most`` are filled, so long words cost their length.
    """
    if a == b:
        return 0
    if abs(len(a) - len(b)) > most:
        return most + 1
    lo, ha, hb = 0, len(a), len(b)
    while lo < ha and lo < hb and a[lo] == b[lo]:
        lo += 1
    while ha > lo and hb > lo and a[ha - 1] == b[hb - 1]:
        ha, hb = ha - 1, hb - 1
    a, b = a[lo:ha], b[lo:hb]
    far = most + 1
    m = len(b)
    before, last = [], [min(j, far) for j in range(m + 1)]
    for i, x in enumerate(a, 1):
        row = [far] * (m + 1)
        if i <= most:
            row[0] = i
        best = row[0]
        for j in range(max(1, i - most), min(m, i + most) + 1):
            y = b[j - 1]
            d = min(last[j] + 1, row[j - 1] + 1, last[j - 1] + (x != y))
            if i > 1 and j > 1 and x == b[j - 2] and a[i - 2] == y:
                d = min(d, before[j - 2] + 1)
            row[j] = d if d < far else far
            if d < best:
                best = d
        if best > most:
            return far
        before, last = last, row
    return min(last[-1], far)


def deletions(word: str) -> set[str]:
    """The word and all words with one character less: two words within one edit share one of these."""
    return {word, *(word[:i] + word[i + 1 :] for i in range(len(word)))}


#: Words from ``LONG`` characters on are known by their ends, shorter ones and those of ``LONG`` or one more by deletions.
LONG, END = 40, 16


def variants(word: str) -> set[str]:
    """Index words: two words within one edit share one. An edit of a long word leaves one of its ends as it is."""
    out = deletions(word) if len(word) <= LONG + 1 else set()
    if len(word) >= LONG:
        out |= {f"<{word[:END]}", f">{word[-END:]}"}
    return out


def ends(word: str, size: int = 3) -> set[str]:
    """Index words: two words within two edits share one, for words over twice ``size``; within one edit, for any.

    Either at most one edit falls among the first ``size`` characters, then these share a deletion, or none among the last.
    """
    return {*(f"<{v}" for v in deletions(word[:size])), f">{word[-size:]}"}


FAR = 9.0


def assign(a: list[str], b: list[str], cost) -> float:
    """Least total cost of pairing the parts of ``a`` with parts of ``b``; parts left over cost what ``cost(part, None)`` says.

    Exact at every size. Parts that both sides hold pair with each other, unless they are near (``cost`` under ``FAR``) to a
    part that only one side holds, directly or by a chain of such parts; these are settled by the Hungarian method. ``cost`` is
    symmetric, 0 for equal parts and at most ``FAR``.
    """
    if len(a) > len(b):
        a, b = b, a
    left, right = list(a), list(b)
    common: list[str] = []
    for x in a:
        if x in right:
            right.remove(x)
            left.remove(x)
            common.append(x)
    if not right:
        return 0.0
    if common and left:
        reach, known = [*left, *right], set(common)
        while reach and known:
            w = reach.pop()
            near = {c for c in known if cost(w, c) < FAR}
            known -= near
            reach += near
            for c in near:
                n = common.count(c)
                left += [c] * n
                right += [c] * n
    if len(left) == 1 == len(right):
        return float(cost(left[0], right[0]))
    spare = [float(cost(y, None)) for y in right]
    table = [[float(cost(x, y)) for y in right] for x in left] + [spare] * (len(right) - len(left))
    return _hungarian(table)


def _hungarian(table: list[list[float]]) -> float:
    """Least total of one entry from each row and column of a square table: shortest augmenting paths with potentials."""
    n = len(table)
    row_of = [-1] * n
    u, v = [0.0] * n, [0.0] * n
    for i in range(n):
        slack, came, done = [float("inf")] * n, [-1] * n, [False] * n
        at, r = -1, i
        while True:
            delta, nxt = float("inf"), -1
            for j in range(n):
                if not done[j]:
                    c = table[r][j] - u[r] - v[j]
                    if c < slack[j]:
                        slack[j], came[j] = c, at
                    if slack[j] < delta:
                        delta, nxt = slack[j], j
            u[i] += delta
            for j in range(n):
                if done[j]:
                    u[row_of[j]] += delta
                    v[j] -= delta
                else:
                    slack[j] -= delta
            at = nxt
            done[at] = True
            if row_of[at] < 0:
                break
            r = row_of[at]
        while at >= 0:
            back = came[at]
            row_of[at] = row_of[back] if back >= 0 else i
            at = back
    return sum(table[row_of[j]][j] for j in range(n))


def joined_cost(whole: str, parts: list[str], most: int) -> int:
    """Least edits between ``whole`` and the parts run together in any order, each edit within one part; ``most + 1`` beyond.

    The characters are counted first; then parts are laid along ``whole``, each way to reach a place once.
    """
    if abs(len(whole) - sum(map(len, parts))) > most or not whole:
        return most + 1
    have, want = Counter(whole), Counter("".join(parts))
    if (have - want).total() > most or (want - have).total() > most:
        return most + 1
    state = {(0, tuple(sorted(parts))): 0}
    for _ in parts:
        new: dict = {}
        for (at, rest), spent in state.items():
            for k, w in enumerate(rest):
                if k and rest[k - 1] == w:
                    continue
                left = (*rest[:k], *rest[k + 1 :])
                for end in range(max(at, at + len(w) - most + spent), min(len(whole), at + len(w) + most - spent) + 1):
                    d = spent + distance(whole[at:end], w, most - spent)
                    if d <= most and d < new.get((end, left), most + 1):
                        new[end, left] = d
        state = new
    return min((d for (at, _), d in state.items() if at == len(whole)), default=most + 1)


def components(edges: DataFrame) -> DataFrame:
    """``(id, root)``: each id of the edges ``(a, b)`` with the least id of its component.

    Labels fall to the least neighbour's label, then to that label's own label, until nothing changes: rounds grow with the
    logarithm of a component's width. Each round is written, so lost executors cost one round at most. No join is a broadcast,
    which the driver would have to hold.
    """
    both = Written(edges.select("a", "b").union(edges.select("b", "a")).filter("a <> b").distinct(), "edges")
    labels = both.df.groupBy(F.col("a").alias("id")).agg(F.least(F.min("b"), F.first("a")).alias("root"))
    held: Written | None = None
    while True:
        near = both.df.join(labels.hint("merge"), both.df["b"] == labels["id"]).groupBy(F.col("a").alias("id")).agg(F.min("root").alias("near"))
        step = labels.join(near.hint("merge"), "id").select("id", F.col("root").alias("old"), F.least("root", "near").alias("root"))
        up = labels.select(F.col("id").alias("root"), F.col("root").alias("top")).hint("merge")
        jumped = step.join(up, "root", "left").select("id", F.least("root", F.coalesce("top", "root")).alias("root"), "old")
        new = Written(jumped, "labels", moved=F.col("root") != F.col("old"))
        if held:
            held.drop()
        held, labels = new, new.df.select("id", "root")
        if not new.seen["moved"]:
            both.drop()
            return labels
