"""Corpus encoding with a public byte-level BPE tokenizer, by a pair occurrence index.

A partition's texts are pre-tokenised; each distinct piece is laid out once in one symbol array. An index maps every
mergeable adjacent pair to all its positions in the partition. Pairs are applied in ascending rank: all positions of the
lowest active pair merge in one vectorised step, and the pairs this creates are entered under their own (higher) ranks.
A pair that holds a merged symbol always ranks above the merge that made the symbol, so one ascending sweep is exact.

The result equals the sequential algorithm's for every text; special-token strings in a text are ordinary text.
Null and empty texts have the empty list of ids (never null).
"""

from __future__ import annotations

import json
from collections import defaultdict
from heapq import heapify, heappop, heappush
from typing import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import types as T

TOKENIZER_DIR = "/opt/tokenizers"
#: Fixed value: the published pre-tokenisation pattern of the byte-level vocabulary.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""


def _byte_chars() -> dict[str, int]:
    """The published printable stand-in of each byte: printable Latin-1 stands for itself, others shift above 255."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    out, extra = {chr(b): b for b in plain}, 256
    for b in range(256):
        if b not in set(plain):
            out[chr(extra)] = b
            extra += 1
    return out


class Merges:
    """The merge table in arrays: ``left[r] + right[r] -> made[r]`` for rank ``r``; ``byte_id`` gives a byte's first id."""

    def __init__(self, left: np.ndarray, right: np.ndarray, made: np.ndarray, byte_id: np.ndarray):
        self.left, self.right, self.made, self.byte_id = left, right, made, byte_id
        key = (left.astype(np.int64) << 20) | right
        order = np.argsort(key)
        self._key, self._rank = key[order], order.astype(np.int32)

    @classmethod
    def load(cls, path: str) -> "Merges":
        with open(path, encoding="utf-8") as f:
            model = json.load(f)["model"]
        vocab, merges = model["vocab"], model["merges"]
        pairs = [m if isinstance(m, list) else m.split(" ") for m in merges]
        arr = lambda it: np.fromiter(it, np.int32, len(pairs))
        byte_id = np.zeros(256, np.int32)
        for c, b in _byte_chars().items():
            byte_id[b] = vocab[c]
        return cls(arr(vocab[a] for a, _ in pairs), arr(vocab[b] for _, b in pairs), arr(vocab[a + b] for a, b in pairs), byte_id)

    def rank(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Rank of each pair, -1 where the pair doesn't merge."""
        key = (a.astype(np.int64) << 20) | b
        at = np.searchsorted(self._key, key)
        at[at == len(self._key)] = 0
        return np.where(self._key[at] == key, self._rank[at], -1)

    def encode_pieces(self, pieces: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all pieces laid end to end, and the offsets of each piece's ids."""
        lens = np.fromiter(map(len, pieces), np.int64, len(pieces))
        n = int(lens.sum())
        if not n:
            return np.zeros(0, np.int32), np.zeros(len(pieces) + 1, np.int64)
        sym = self.byte_id[np.frombuffer(b"".join(pieces), np.uint8)]
        ends = np.cumsum(lens)
        after = np.arange(1, n + 1, dtype=np.int32)
        before = np.arange(-1, n - 1, dtype=np.int32)
        after[ends[lens > 0] - 1] = -1
        before[(ends - lens)[lens > 0]] = -1
        alive = np.ones(n, bool)
        places: dict[int, list[np.ndarray]] = {}

        def enter(at: np.ndarray, rank: np.ndarray) -> list[int]:
            ok = rank >= 0
            at, rank = at[ok], rank[ok]
            if not len(at):
                return []
            order = np.argsort(rank, kind="stable")
            at, rank = at[order], rank[order]
            cut = np.flatnonzero(rank[1:] != rank[:-1]) + 1
            new = []
            lo = 0
            for hi, r in zip([*cut.tolist(), len(rank)], rank[np.r_[0, cut]].tolist()):
                if r in places:
                    places[r].append(at[lo:hi])
                else:
                    places[r] = [at[lo:hi]]
                    new.append(r)
                lo = hi
            return new

        first = np.flatnonzero(after >= 0).astype(np.int32)
        active = enter(first, self.rank(sym[first], sym[first + 1]))
        heapify(active)
        while active:
            r = heappop(active)
            lists = places.pop(r)
            at = np.unique(np.concatenate(lists)) if len(lists) > 1 else lists[0]
            a, b = self.left[r], self.right[r]
            nx = after[at]
            ok = alive[at] & (sym[at] == a) & (nx >= 0)
            ok &= sym[nx] == b
            if not ok.all():
                at, nx = at[ok], nx[ok]
            if a == b and len(at) > 1:
                at = np.sort(at)
                nx = after[at]
                start = np.r_[True, nx[:-1] != at[1:]]
                i = np.arange(len(at))
                even = (i - np.maximum.accumulate(np.where(start, i, 0))) % 2 == 0
                at, nx = at[even], nx[even]
            if not len(at):
                continue
            sym[at] = self.made[r]
            alive[nx] = False
            then = after[nx]
            after[at] = then
            has = then >= 0
            before[then[has]] = at[has]
            left = before[at]
            left = left[left >= 0]
            right = at[has]
            here = np.concatenate([left, right])
            if len(here):
                here = np.unique(here)
                for x in enter(here, self.rank(sym[here], sym[after[here]])):
                    heappush(active, x)
        owner = np.repeat(np.arange(len(pieces)), lens)[alive]
        return sym[alive], np.r_[0, np.cumsum(np.bincount(owner, minlength=len(pieces)))]


class Encoder:
    """Encodes blocks of texts; ``block_chars`` bounds a worker's memory, not the result."""

    def __init__(self, merges: Merges, pattern: str = PATTERN, block_chars: int = 24_000_000):
        self.merges, self.block_chars = merges, block_chars
        self._find = regex.compile(pattern).findall

    def block(self, texts: list[str | None]) -> tuple[list[np.ndarray], np.ndarray, np.ndarray]:
        """Per text the numbers of its pieces; ids of all distinct pieces, and their offsets."""
        number: dict[str, int] = defaultdict()
        number.default_factory = number.__len__
        get, find = number.__getitem__, self._find
        docs = []
        for t in texts:
            if t:
                p = find(t)
                docs.append(np.fromiter(map(get, p), np.int32, len(p)))
            else:
                docs.append(np.zeros(0, np.int32))
        ids, offsets = self.merges.encode_pieces([w.encode() for w in number])
        return docs, ids, offsets

    def encode(self, texts: list[str | None]) -> list[np.ndarray]:
        docs, ids, offsets = self.block(texts)
        return [_gather(d, ids, offsets) for d in docs]


def _gather(pieces: np.ndarray, ids: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    n = (offsets[1:] - offsets[:-1])[pieces]
    total = int(n.sum())
    if not total:
        return np.zeros(0, np.int32)
    shift = offsets[pieces] - np.r_[0, np.cumsum(n)[:-1]]
    return ids[np.arange(total) + np.repeat(shift, n)]


def _blocks(batches: Iterator[pa.RecordBatch], text_at: int, limit: int) -> Iterator[list[pa.RecordBatch]]:
    held, size = [], 0
    for b in batches:
        held.append(b)
        size += b.column(text_at).nbytes
        if size >= limit:
            yield held
            held, size = [], 0
    if held:
        yield held


def _merges(df: DataFrame, tokenizer: str, tokenizer_dir: str):
    """The merge table, read once on the driver and broadcast: its size is the vocabulary's, whatever the corpus."""
    return df.sparkSession.sparkContext.broadcast(Merges.load(f"{tokenizer_dir}/{tokenizer}.json"))


def encode_corpus(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", tokenizer: str = "byte_bpe_50k", tokenizer_dir: str = TOKENIZER_DIR) -> DataFrame:
    """``(id_col, ids array<int>)`` for every row, without special tokens. Map-only: no shuffle.

    Nulls and empty texts give the empty list; blank texts give the ids of their white space. Rows repeat as they come.
    """
    shared = _merges(df, tokenizer, tokenizer_dir)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = Encoder(shared.value)
        for held in _blocks(batches, 1, enc.block_chars):
            docs, ids, offsets = enc.block([t for b in held for t in b.column(1).to_pylist()])
            done = 0
            for b in held:
                mine = docs[done : done + b.num_rows]
                done += b.num_rows
                n = np.fromiter(map(len, mine), np.int64, len(mine))
                pieces = np.concatenate(mine) if mine else np.zeros(0, np.int32)
                flat = _gather(pieces, ids, offsets)
                per = np.r_[0, np.cumsum((offsets[1:] - offsets[:-1])[pieces])]
                at = per[np.r_[0, np.cumsum(n)]].astype(np.int32)
                yield pa.RecordBatch.from_arrays([b.column(0), pa.ListArray.from_arrays(pa.array(at), pa.array(flat, pa.int32()))], ["id", "ids"])

    src = df.select(df[id_col].alias("id"), df[text_col].cast("string").alias("text"))
    schema = T.StructType([T.StructField("id", src.schema["id"].dataType), T.StructField("ids", T.ArrayType(T.IntegerType()))])
    return src.mapInArrow(run, schema).withColumnRenamed("id", id_col)


def count_tokens(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", tokenizer: str = "byte_bpe_50k", tokenizer_dir: str = TOKENIZER_DIR) -> DataFrame:
    """``(id_col, n_tokens int)`` for every row; 0 for null and empty texts. The same encoder, without its ids."""
    shared = _merges(df, tokenizer, tokenizer_dir)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = Encoder(shared.value)
        for held in _blocks(batches, 1, enc.block_chars):
            docs, _, offsets = enc.block([t for b in held for t in b.column(1).to_pylist()])
            per = offsets[1:] - offsets[:-1]
            n = np.fromiter((per[d].sum() for d in docs), np.int32, len(docs))
            done = 0
            for b in held:
                yield pa.RecordBatch.from_arrays([b.column(0), pa.array(n[done : done + b.num_rows])], ["id", "n_tokens"])
                done += b.num_rows

    src = df.select(df[id_col].alias("id"), df[text_col].cast("string").alias("text"))
    schema = T.StructType([T.StructField("id", src.schema["id"].dataType), T.StructField("n_tokens", T.IntegerType())])
    return src.mapInArrow(run, schema).withColumnRenamed("id", id_col)
