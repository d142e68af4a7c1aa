"""Long exact spans shared between records, by sliding sentence spans.

Texts are cut into sentences at boundaries that depend on nearby characters only: in every window of ``WIDTH`` positions
the best boundary is taken (a sentence or line end, else a word start, else any position; hashed context breaks ties), so
a passage is cut alike wherever it stands, and a passage without sentence ends is cut too. Every run of ``RUN``
consecutive sentences is hashed and joined globally. A stretch of ``length`` characters can occur elsewhere only if every
sentence run that it fully determines does; what remains is settled exactly:

* the remaining window starts are grouped into blocks by the sentence boundary they share; a block whose whole stretch
  occurs in another document is shared throughout;
* where blocks of one boundary differ, each window of ``length`` characters is hashed and looked up. Of the documents that
  hold the same block only the first and last enter its windows; other repeats follow from these.

No group of equal spans is ever gathered: all global steps are aggregations (with partial aggregation before the shuffle)
and joins back. Runs are told apart by 64 bits, which only leave too many windows open where they clash; what is reported
is equal by two independent hashes of its characters, 128 bits.

``without_repeats`` drops the sentences that later spans cover: those that an earlier document, by id, holds too.
"""

from __future__ import annotations

import re
from typing import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..session import Written

LENGTH, WIDTH, RUN, CONTEXT, ANCHOR = 200, 60, 2, 4, 64
_B = np.uint64(0x9E3779B97F4A7C15 | 1)
_C = np.uint64(0xC2B2AE3D27D4EB4F)
_M1, _M2, _M3 = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB), np.uint64(0xD6E8FEB86659FD93)


def _mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser, so that every bit of the sum counts in every bit of the hash."""
    x = (x ^ (x >> np.uint64(30))) * _M1
    x = (x ^ (x >> np.uint64(27))) * _M2
    return x ^ (x >> np.uint64(31))


class Block:
    """Texts laid end to end, with hashes of any stretch and the sentence boundaries of each text."""

    _pow: dict[int, np.ndarray] = {}
    _inv: dict[int, np.ndarray] = {}

    def __init__(self, texts: list[str], length: int = LENGTH, width: int = WIDTH):
        self.length, self.width = length, width
        raw = "".join(texts).encode("utf-32-le", "surrogatepass")
        self.chars = np.frombuffer(raw, np.uint32)
        size = np.fromiter(map(len, texts), np.int64, len(texts))
        self.end = np.cumsum(size)
        self.start = self.end - size
        n = len(self.chars)
        self.code = _mix((self.chars.astype(np.uint64) + np.uint64(1)) * _M3)
        self._sums: dict[int, np.ndarray] = {}
        self._select()

    @classmethod
    def _powers(cls, base: np.uint64, n: int) -> None:
        k = int(base)
        if len(cls._pow.get(k, ())) < n:
            inverse = np.uint64(pow(k, -1, 1 << 64))
            cls._pow[k] = np.cumprod(np.r_[np.uint64(1), np.full(n - 1, base, np.uint64)])
            cls._inv[k] = np.cumprod(np.r_[np.uint64(1), np.full(n - 1, inverse, np.uint64)])

    def hash(self, a: np.ndarray, b: np.ndarray, base: np.uint64 = _B) -> np.ndarray:
        """Hash of the characters in ``[a, b)``, as signed 64-bit numbers; another base and other codes give an independent one."""
        k, n = int(base), len(self.chars)
        if k not in self._sums:
            self._powers(base, n + 1)
            code = self.code if base == _B else _mix(self.code + base)
            self._sums[k] = np.r_[np.uint64(0), np.cumsum(code * Block._pow[k][:n])]
        sums = self._sums[k]
        return _mix((sums[b] - sums[a]) * self._inv[k][a] + (b - a).astype(np.uint64)).view(np.int64)

    def _select(self) -> None:
        """``at``, ``first``, ``last``, ``text``: each boundary, the first and last window start that selects it, and its text."""
        n, w = len(self.chars), self.width
        if n < w + 2 * CONTEXT:
            self.at = self.first = self.last = self.text = np.zeros(0, np.int64)
            return
        c = self.chars
        nl = (c == 10) | (c == 13)
        white = nl | (c == 32) | (c == 9) | (c == 0xA0)
        end = (c == 46) | (c == 33) | (c == 63) | (c == 59)
        rank = np.full(n, 2, np.uint64)
        word = np.zeros(n, bool)
        word[1:] = white[:-1] & ~white[1:]
        rank[word] = 1
        rank[2:][word[2:] & (nl[1:-1] | end[:-2])] = 0
        near = self.code
        for step in (1, 2, 4):  # context of 8 characters
            near = near[:-step] * (_B ** np.uint64(step)) + near[step:]
        hashed = np.zeros(n, np.uint64)
        hashed[CONTEXT : CONTEXT + len(near)] = _mix(near) >> np.uint64(34)
        key = (rank << np.uint64(62)) | (hashed << np.uint64(32)) | np.arange(n - 1, -1, -1, dtype=np.uint64)
        best, have = key, 1
        while have * 2 <= w:
            best = np.minimum(best[:-have], best[have:])
            have *= 2
        if have < w:
            best = np.minimum(best[: n - w + 1], best[w - have :][: n - w + 1])
        lo, hi = self.start + CONTEXT, self.end - CONTEXT - w + 2
        edge = np.zeros(n + 2, np.int32)
        fit = hi > lo
        np.add.at(edge, lo[fit], 1)
        np.add.at(edge, hi[fit], -1)
        ok = np.cumsum(edge)[: n - w + 1] > 0
        s = np.flatnonzero(ok)
        q = n - 1 - (best[s] & np.uint64(0xFFFFFFFF)).astype(np.int64)
        new = np.r_[True, q[1:] != q[:-1]] if len(q) else np.zeros(0, bool)
        i = np.flatnonzero(new)
        self.at, self.first = q[i], s[i]
        self.last = s[np.r_[i[1:], len(s)] - 1] if len(i) else s[i]
        self.text = np.searchsorted(self.end, self.at, "right")

    def runs(self) -> tuple[np.ndarray, np.ndarray]:
        """``(index of its first boundary, hash)`` of every run of ``RUN`` consecutive sentences."""
        j = np.arange(max(0, len(self.at) - RUN))
        j = j[self.text[j] == self.text[j + RUN]] if len(j) else j
        return j, self.hash(self.at[j], self.at[j + RUN])

    def open_windows(self, shared: np.ndarray) -> np.ndarray:
        """Starts of all windows that no unshared sentence run rules out. ``shared``: by boundary, whether its run is shared."""
        n, size = len(self.chars), self.length
        edge = np.zeros(n + 2, np.int32)
        lo, hi = self.start, self.end - size + 1
        fit = hi > lo
        np.add.at(edge, lo[fit], 1)
        np.add.at(edge, hi[fit], -1)
        inside = np.cumsum(edge)[:n] > 0
        j, _ = self.runs()
        j = j[~shared[j]]
        # the run is determined in windows i with first[j+RUN] + width + CONTEXT - 1 - size <= i <= last[j] - CONTEXT
        a = np.maximum(self.first[j + RUN] + self.width + CONTEXT - 1 - size, self.start[self.text[j]])
        b = self.last[j] - CONTEXT
        k = a <= b
        out = np.zeros(n + 2, np.int32)
        np.add.at(out, a[k], 1)
        np.add.at(out, b[k] + 1, -1)
        return np.flatnonzero(inside & (np.cumsum(out)[:n] == 0))

    def blocks(self, windows: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """``(boundary, first window, last window)`` of the stretches of consecutive windows that share their first boundary."""
        if not len(windows):
            return windows, windows, windows
        anchor = np.searchsorted(self.last, windows + CONTEXT)
        cut = np.r_[True, (windows[1:] != windows[:-1] + 1) | (anchor[1:] != anchor[:-1])]
        i = np.flatnonzero(cut)
        return anchor[i], windows[i], windows[np.r_[i[1:], len(windows)] - 1]


def _batched(rows: Iterator[pa.RecordBatch], text_at: int, limit: int = 4_000_000) -> Iterator[pa.RecordBatch]:
    """Slices of the batches with about ``limit`` bytes of text each."""
    for b in rows:
        at = 0
        col = b.column(text_at)
        off = np.frombuffer(col.buffers()[1], np.int32 if pa.types.is_string(col.type) else np.int64)[col.offset : col.offset + len(b) + 1] if len(b) else [0]
        while at < len(b):
            to = max(at + 1, int(np.searchsorted(off, off[at] + limit, "right")) - 1)
            yield b.slice(at, to - at)
            at = to


def _runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in _batched(batches, 1):
        k = Block(b.column(1).to_pylist())
        j, h = k.runs()
        first = np.searchsorted(k.text, np.arange(b.num_rows))
        doc = b.column(0).to_numpy(zero_copy_only=False)[k.text[j]]
        yield pa.RecordBatch.from_arrays([pa.array(h), pa.array(doc), pa.array((j - first[k.text[j]]).astype(np.int32))], ["h", "doc", "j"])


def _regions(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of each text with shared runs, the stretches with open windows, each with its blocks."""
    for b in _batched(batches, 1):
        k = Block(b.column(1).to_pylist())
        shared = np.zeros(len(k.at), bool)
        first = np.searchsorted(k.text, np.arange(b.num_rows))
        js = b.column(2)
        n = np.diff(js.offsets.to_numpy())
        shared[np.repeat(first, n) + js.flatten().to_numpy(zero_copy_only=False)] = True
        anchor, lo, hi = k.blocks(k.open_windows(shared))
        if not len(lo):
            continue
        text = np.searchsorted(k.end, lo, "right")
        q = k.at[anchor]
        a = k.hash(q, q + ANCHOR)
        h = k.hash(lo, hi + k.length) ^ (_mix((q - lo).astype(np.uint64)).view(np.int64))
        g = k.hash(lo, hi + k.length, _C)
        cut = np.flatnonzero(np.r_[True, (lo[1:] != hi[:-1] + 1) | (text[1:] != text[:-1])])
        upto = np.r_[cut[1:], len(lo)]
        base = k.start[text[cut]]
        begin, stop = lo[cut], hi[upto - 1] + k.length
        raw = k.chars.tobytes()
        parts = [raw[4 * s : 4 * e].decode("utf-32-le", "surrogatepass") for s, e in zip(begin.tolist(), stop.tolist())]
        off = np.repeat(begin, upto - cut)
        part = pa.StructArray.from_arrays([pa.array(a), pa.array(h), pa.array(g), pa.array((lo - off).astype(np.int32)), pa.array((hi - off).astype(np.int32))], ["a", "h", "g", "lo", "hi"])
        lists = pa.ListArray.from_arrays(pa.array(np.r_[cut, len(lo)].astype(np.int32)), part)
        doc = b.column(0).to_numpy(zero_copy_only=False)[text[cut]]
        yield pa.RecordBatch.from_arrays([pa.array(doc), pa.array((begin - base).astype(np.int32)), pa.array(parts), lists], ["doc", "at", "part", "blocks"])


def _windows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Hash of each window of the blocks given."""
    for b in _batched(batches, 2):
        k = Block(b.column(2).to_pylist())
        rows = b.column(3)
        n = np.diff(rows.offsets.to_numpy())
        r = np.repeat(np.arange(b.num_rows), n)
        lo, hi = (rows.flatten().field(x).to_numpy(zero_copy_only=False).astype(np.int64) for x in (0, 1))
        m = hi - lo + 1
        i = np.repeat(lo + k.start[r] - np.r_[0, np.cumsum(m)[:-1]], m) + np.arange(int(m.sum()))
        r = np.repeat(r, m)
        at = b.column(1).to_numpy(zero_copy_only=False).astype(np.int64)[r] + i - k.start[r]
        doc = b.column(0).to_numpy(zero_copy_only=False)[r]
        yield pa.RecordBatch.from_arrays([pa.array(k.hash(i, i + k.length)), pa.array(k.hash(i, i + k.length, _C)), pa.array(doc), pa.array(at.astype(np.int32))], ["w", "v", "doc", "i"])


def _elsewhere(rows: DataFrame, *keys: str) -> DataFrame:
    """The keys that occur in more than one document."""
    return rows.groupBy(*keys).agg(F.min("doc").alias("lo_doc"), F.max("doc").alias("hi_doc")).filter("lo_doc <> hi_doc")


def _ranges(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """``(doc, s, e, later)``: ranges of characters that another document holds too, which together cover all that is shared;
    ``later`` tells whether a document with a smaller id is among those."""
    docs = df.select(df[id_col].cast("long").alias("doc"), df[text_col].alias("text")).filter(f"doc is not null and length(text) >= {LENGTH}")
    runs = Written(docs.mapInArrow(_runs, "h long, doc long, j int"), "runs").df
    repeated = runs.join(_elsewhere(runs, "h").select("h"), "h", "left_semi")
    by_doc = repeated.groupBy("doc").agg(F.collect_set("j").alias("js"))  # at most a text's own sentences
    regions = Written(docs.join(by_doc, "doc").select("doc", "text", "js").mapInArrow(_regions, "doc long, at int, part string, blocks array<struct<a: long, h: long, g: long, lo: int, hi: int>>"), "regions").df

    blocks = regions.select("doc", "at", F.inline("blocks"))
    kinds = blocks.groupBy("a", "h", "g").agg(F.min("doc").alias("lo_doc"), F.max("doc").alias("hi_doc"))
    several = kinds.groupBy("a").agg(F.count("*").alias("n")).filter("n > 1").select("a", F.lit(True).alias("several"))
    state = (
        blocks.join(kinds.join(several, "a", "left"), ["a", "h", "g"])
        .select("doc", "at", "lo", "hi", (F.col("lo_doc") != F.col("hi_doc")).alias("whole"), (F.col("several") & F.col("doc").isin(F.col("lo_doc"), F.col("hi_doc"))).alias("enters"), (F.col("doc") > F.col("lo_doc")).alias("later"))
        .filter("whole or enters")
    )
    state = Written(state, "blocks").df
    entering = state.filter("enters").groupBy("doc", "at").agg(F.collect_set(F.struct("lo", "hi")).alias("blocks"))
    windows = regions.select("doc", "at", "part").join(entering, ["doc", "at"]).select("doc", "at", "part", "blocks").mapInArrow(_windows, "w long, v long, doc long, i int")
    found = windows.join(_elsewhere(windows, "w", "v").select("w", "v", "lo_doc"), ["w", "v"])
    whole = state.filter("whole").select("doc", (F.col("at") + F.col("lo")).alias("s"), (F.col("at") + F.col("hi") + LENGTH).alias("e"), "later")
    return whole.unionByName(found.select("doc", F.col("i").alias("s"), (F.col("i") + LENGTH).alias("e"), (F.col("doc") > F.col("lo_doc")).alias("later")))


def shared_spans(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(id, start_char, end_char)`` of each maximal run of characters that lie in 200 or more consecutive characters found
    verbatim in the text of another id too.

    Ids are whole numbers; rows without an id, null texts and texts under 200 characters have no run. A row repeated with
    its id is one record and isn't shared by that; copies under other ids are shared throughout. One id is expected to have
    one text.
    """
    return merge_ranges(_ranges(df, id_col, text_col).drop("later")).withColumnsRenamed({"doc": id_col})


#: A sentence with its ends and the blanks after them; the rest of a text without an end is one too.
SENTENCE = r"[^.!?;\n\r]*[.!?;\n\r]+[ \t\n\r]*|[^.!?;\n\r]+"


def without_repeats(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(id, text, removed_chars)`` for every row: the text without the sentences that lie wholly in a later span, a run of characters
    in 200 or more consecutive ones that a document with a smaller id holds verbatim too. The first document keeps them.

    Null texts stay null, with 0 removed; an exact copy under a larger id of 200 characters or more becomes empty. Rows without
    an id stay as they are, repeated rows are each cut alike.
    """
    later = merge_ranges(_ranges(df, id_col, text_col).filter("later").select("doc", "s", "e")).groupBy("doc").agg(F.array_sort(F.collect_list(F.struct("start_char", "end_char"))).alias("spans"))
    rows = df.select(df[id_col].alias("id"), df[text_col].alias("text"))
    held = rows.join(later, rows["id"].cast("long") == later["doc"], "left").select("id", "text", "spans")

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        find = re.compile(SENTENCE).finditer
        for b in batches:
            texts, gone = [], []
            for text, spans in zip(b.column(1).to_pylist(), b.column(2).to_pylist()):
                kept = text
                if text and spans:
                    starts = np.array([x["start_char"] for x in spans])
                    ends = np.array([x["end_char"] for x in spans])
                    at = np.array([m.span() for m in find(text)])
                    k = np.searchsorted(starts, at[:, 0], "right") - 1
                    out = (k >= 0) & (at[:, 1] <= ends[k])
                    kept = "".join(text[s:e] for s, e in at[~out].tolist())
                texts.append(kept)
                gone.append(len(text or "") - len(kept or ""))
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(texts, pa.string()), pa.array(gone, pa.int32())], ["id", "text", "removed_chars"])

    kind = rows.schema["id"].dataType.simpleString()
    return held.mapInArrow(cut, f"id {kind}, text string, removed_chars int").withColumnRenamed("id", id_col)


#: Ranges are first united within stretches of so many characters, so that a long text's ranges don't meet in one task one by one.
STRETCH = 65_536


def merge_ranges(ranges: DataFrame) -> DataFrame:
    """``(doc, start_char, end_char)``: the union of each document's ranges ``(s, e)`` as maximal runs.

    Ranges unite by the stretch of the text in which they begin, then the few runs of each stretch by document.
    """

    def united(r: DataFrame, *by: str) -> DataFrame:
        order = Window.partitionBy(*by).orderBy("s", "e")
        before = F.max("e").over(order.rowsBetween(Window.unboundedPreceding, -1))
        run = F.sum(F.when(F.col("s") <= F.col("before"), 0).otherwise(1)).over(order)
        return r.withColumn("before", before).withColumn("run", run).groupBy(*by, "run").agg(F.min("s").alias("s"), F.max("e").alias("e")).drop("run")

    parts = united(ranges.select("doc", "s", "e", F.expr(f"s div {STRETCH}").alias("stretch")), "doc", "stretch")
    return united(parts.drop("stretch"), "doc").select("doc", F.col("s").cast("int").alias("start_char"), F.col("e").cast("int").alias("end_char"))


def shared_shares(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(id, n_chars, shared_chars, shared_share)`` for every row: 0 shared where there is none, null share for null and empty texts."""
    spans = shared_spans(df, id_col, text_col).groupBy(id_col).agg(F.sum(F.col("end_char") - F.col("start_char")).alias("c"))
    base = df.select(df[id_col], F.length(df[text_col]).alias("n_chars"))
    return base.join(spans, id_col, "left").select(
        id_col, "n_chars", F.coalesce("c", F.lit(0)).cast("long").alias("shared_chars"), F.when(F.col("n_chars") > 0, F.coalesce("c", F.lit(0)) / F.col("n_chars")).alias("shared_share")
    )


#: The same rows in SQL: every window of 200 characters against all others.
FOUND_SQL = """
WITH w AS (SELECT doc_id, unnest(range(1, length(text) - 198)) AS i, text FROM documents WHERE length(text) >= 200),
h AS (SELECT doc_id, i, md5_number(substring(text, i, 200)) AS k FROM w),
r AS (SELECT k FROM h GROUP BY k HAVING min(doc_id) <> max(doc_id)),
s AS (SELECT DISTINCT doc_id, i FROM h SEMI JOIN r USING (k)),
g AS (SELECT doc_id, i, CASE WHEN i - lag(i) OVER (PARTITION BY doc_id ORDER BY i) <= 200 THEN 0 ELSE 1 END AS new FROM s),
n AS (SELECT doc_id, i, sum(new) OVER (PARTITION BY doc_id ORDER BY i) AS run FROM g)
SELECT doc_id, CAST(min(i) - 1 AS INTEGER) AS start_char, CAST(max(i) + 199 AS INTEGER) AS end_char FROM n GROUP BY doc_id, run
"""
SHARES_SQL = f"""
WITH f AS ({FOUND_SQL}), s AS (SELECT doc_id, sum(end_char - start_char) AS c FROM f GROUP BY doc_id)
SELECT doc_id, length(text) AS n_chars, CAST(coalesce(c, 0) AS BIGINT) AS shared_chars, CASE WHEN length(text) > 0 THEN coalesce(c, 0) / length(text) END AS shared_share FROM documents LEFT JOIN s USING (doc_id)
"""
#: Sentences by running length; those within a later span are dropped.
DEDUPED_SQL = """
WITH w AS (SELECT doc_id, unnest(range(1, length(text) - 198)) AS i, text FROM documents WHERE length(text) >= 200),
h AS (SELECT doc_id, i, md5_number(substring(text, i, 200)) AS k FROM w),
r AS (SELECT k, min(doc_id) AS lo FROM h GROUP BY k HAVING min(doc_id) <> max(doc_id)),
s AS (SELECT DISTINCT doc_id, i FROM h JOIN r USING (k) WHERE doc_id > lo),
g AS (SELECT doc_id, i, CASE WHEN i - lag(i) OVER (PARTITION BY doc_id ORDER BY i) <= 200 THEN 0 ELSE 1 END AS new FROM s),
n AS (SELECT doc_id, i, sum(new) OVER (PARTITION BY doc_id ORDER BY i) AS run FROM g),
f AS (SELECT doc_id, min(i) - 1 AS a, max(i) + 199 AS b FROM n GROUP BY doc_id, run),
x AS (SELECT doc_id, regexp_extract_all(text, '[^.!?;\\n\\r]*[.!?;\\n\\r]+[ \\t\\n\\r]*|[^.!?;\\n\\r]+') AS xs FROM documents WHERE doc_id IN (SELECT doc_id FROM f)),
y AS (SELECT doc_id, generate_subscripts(xs, 1) AS o, unnest(xs) AS x FROM x),
z AS (SELECT doc_id, o, x, sum(length(x)) OVER (PARTITION BY doc_id ORDER BY o) AS b FROM y),
kept AS (SELECT doc_id, string_agg(x, '' ORDER BY o) AS text FROM z WHERE NOT EXISTS (SELECT 1 FROM f WHERE f.doc_id = z.doc_id AND f.a <= z.b - length(z.x) AND z.b <= f.b) GROUP BY doc_id)
SELECT d.doc_id, CASE WHEN d.doc_id IN (SELECT doc_id FROM f) THEN coalesce(kept.text, '') ELSE d.text END AS text,
  CAST(CASE WHEN d.doc_id IN (SELECT doc_id FROM f) THEN length(d.text) - length(coalesce(kept.text, '')) ELSE 0 END AS INTEGER) AS removed_chars FROM documents d LEFT JOIN kept USING (doc_id)
"""
