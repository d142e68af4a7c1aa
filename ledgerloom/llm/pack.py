"""Filling containers of fixed capacity with texts sized in tokens, by harmonic classes.

Lengths fall into reciprocal-capacity classes: a length in ``(C/(k+1), C/k]`` opens containers that hold exactly ``k`` texts
of that length. Plain harmonic packing leaves the rest of each container empty, so the room left is given to lower
classes: the counts by length (at most ``C`` numbers, whatever the corpus) are planned on the driver, longest first, each
length filling the smallest sufficient room before it opens containers of its own. Workers then place texts independently:
a text's rank within its length names its container and order.

Lengths are salted by their counts, one salt for every ``SALT_ROWS`` texts of a length, so that no task ranks more than about
as many: ranks are counted within (length, salt) and shifted by the counts of the salts before.

``rooms=False`` leaves the plan of rooms away and packs by the classes alone (``harmonic``).
"""

from __future__ import annotations

from bisect import bisect_left, insort
from typing import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from ..session import Written
from . import encode

SALT_ROWS = 1_000_000


def harmonic(counts: dict[int, int], capacity: int) -> tuple[np.ndarray, int]:
    """The slots of plain harmonic packing (as of ``plan``), and how many containers: of each class, ``k`` texts to a container."""
    slots: list[tuple[int, int, int, int, int, int]] = []
    made, k, order, used = 0, 0, 0, 0
    for length in sorted((x for x, n in counts.items() if n > 0), reverse=True):
        if capacity // length != k:
            made, k, order, used = made + (order > 0), capacity // length, 0, 0
        left, rank = counts[length], 0
        if order:  # the class's container that isn't full yet
            n = min(k - order, left)
            slots.append((length, 0, made, n, order, used))
            rank, left, order, used = n, left - n, order + n, used + n * length
            if order == k:
                made, order, used = made + 1, 0, 0
        for each in (k, left % k):
            use = left // each if each else 0
            if use:
                slots.append((length, rank, made, each, 0, 0))
                rank, left = rank + use * each, left - use * each
                if each == k:
                    made += use
                else:
                    order, used = each, each * length
    return np.array(sorted(slots), np.int64).reshape(-1, 6), made + (order > 0)


def plan(counts: dict[int, int], capacity: int) -> tuple[np.ndarray, int]:
    """Slots ``(length, first rank, first container, texts per container, first order, first offset)``, and how many containers.

    Ranks ``first rank ..`` of a length up to its next slot go to consecutive containers, so many in each.
    """
    slots: list[tuple[int, int, int, int, int, int]] = []
    rooms: list[tuple[int, int, int, int]] = []  # (room, first container, containers, texts in each), by room
    made = 0
    for length in sorted((x for x, n in counts.items() if n > 0), reverse=True):
        left, rank = counts[length], 0
        while left and (at := bisect_left(rooms, (length, -1, -1, -1))) < len(rooms):
            room, first, n, held = rooms.pop(at)
            each = min(room // length, left)
            use = min(n, left // each)
            slots.append((length, rank, first, each, held, capacity - room))
            if room - each * length:
                insort(rooms, (room - each * length, first, use, held + each))
            if n > use:
                insort(rooms, (room, first + use, n - use, held))
            rank += use * each
            left -= use * each
        each = capacity // length
        for k in (each, left % each):
            use = left // k if k else 0
            if use:
                slots.append((length, rank, made, k, 0, 0))
                if capacity - k * length:
                    insort(rooms, (capacity - k * length, made, use, k))
                made += use
                rank += use * k
                left -= use * k
    return np.array(sorted(slots), np.int64).reshape(-1, 6), made


def items(tokens: DataFrame, capacity: int) -> DataFrame:
    """``(id, start, size)``: each text whole, or, where it exceeds the capacity, in stretches of it and a rest."""
    return (
        tokens.filter("n_tokens > 0")
        .select("id", "n_tokens", F.explode(F.sequence(F.lit(0), F.expr(f"(n_tokens - 1) div {capacity}").cast("int"))).alias("k"))
        .select("id", (F.col("k") * capacity).cast("int").alias("start"), F.least(F.lit(capacity), F.col("n_tokens") - F.col("k") * capacity).cast("int").alias("size"))
    )


def pack(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", capacity: int = 2048, tokenizer: str = "byte_bpe_50k", tokenizer_dir: str = encode.TOKENIZER_DIR, rooms: bool = True, salt_rows: int = SALT_ROWS) -> DataFrame:
    """``container, item_order, container_offset, id, start_token, end_token``: one row for each text, or piece of a text over the capacity.

    Texts without tokens (null, empty) are left out; blank texts count by their tokens. Repeated rows are packed each.
    Containers are numbered from 0 without gaps; orders within a container from 0.
    """
    spark = df.sparkSession
    tokens = Written(encode.count_tokens(df.select(df[id_col].alias("id"), df[text_col].alias("text")), "id", "text", tokenizer, tokenizer_dir), "tokens").df
    cut = items(tokens, capacity)
    total = np.zeros(capacity + 1, np.int64)
    for r in cut.groupBy("size").count().collect():  # at most capacity rows
        total[r["size"]] = r["count"]
    salts = -(-total // salt_rows)
    first = np.cumsum(salts) - salts  # where a length's salts begin in the table
    slots, _ = (plan if rooms else harmonic)({k: int(n) for k, n in enumerate(total) if n}, capacity)
    by_size = spark.createDataFrame([(k, int(n)) for k, n in enumerate(salts) if n], "size int, salts int")
    salted = cut.join(F.broadcast(by_size), "size").withColumn("salt", F.pmod(F.xxhash64("id", "start"), F.col("salts")).cast("int"))  # at most capacity rows
    held = np.zeros(int(salts.sum()), np.int64)
    for r in salted.groupBy("size", "salt").count().collect():  # a row for each length and million of texts
        held[first[r["size"]] + r["salt"]] = r["count"]
    before = np.cumsum(held) - held
    shift = before - before[np.repeat(first[salts > 0], salts[salts > 0])] if len(held) else held
    shared = spark.sparkContext.broadcast((slots, first, shift))

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        slots, first, shift = shared.value
        key = (slots[:, 0] << 44) | slots[:, 1] if len(slots) else np.zeros(0, np.int64)
        for b in batches:
            size, salt, nth = (b.column(k).to_numpy(zero_copy_only=False).astype(np.int64) for k in (2, 3, 4))
            rank = shift[first[size] + salt] + nth
            s = slots[np.searchsorted(key, (size << 44) | rank, "right") - 1]
            far = rank - s[:, 1]
            start = b.column(1).to_numpy(zero_copy_only=False)
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(s[:, 2] + far // s[:, 3]),
                    pa.array((s[:, 4] + far % s[:, 3]).astype(np.int32)),
                    pa.array((s[:, 5] + far % s[:, 3] * size).astype(np.int32)),
                    b.column(0),
                    pa.array(start),
                    pa.array((start + size).astype(np.int32)),
                ],
                ["container", "item_order", "container_offset", "id", "start_token", "end_token"],
            )

    nth = F.row_number().over(Window.partitionBy("size", "salt").orderBy("id", "start")) - 1
    placed = salted.select("id", "start", "size", "salt", nth.alias("nth"))
    schema = T.StructType(
        [
            T.StructField("container", T.LongType()),
            T.StructField("item_order", T.IntegerType()),
            T.StructField("container_offset", T.IntegerType()),
            T.StructField("id", cut.schema["id"].dataType),
            T.StructField("start_token", T.IntegerType()),
            T.StructField("end_token", T.IntegerType()),
        ]
    )
    return placed.mapInArrow(place, schema).withColumnRenamed("id", id_col)
