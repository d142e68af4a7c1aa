"""Table functions for SQL: ``register(spark)``, then ``SELECT ... FROM t, LATERAL chunk_text(text, type, 6000)``."""

from __future__ import annotations

import re
from typing import Iterator

from pyspark.sql import SparkSession
from pyspark.sql.functions import udtf

from ..operators import chunking
from ..sources import xlsx


@udtf(returnType="chunk_index int, total_chunks int, text string, account_context string, tier string")
class ChunkText:
    """The chunks of one text, as ``chunking.chunk`` gives them."""

    def eval(self, text: str, kind: str, max_tokens: int) -> Iterator[tuple]:
        if text is None:
            return
        chunks = chunking.chunks_of(text, kind or "", int(max_tokens * chunking.CHARS_PER_TOKEN))
        for i, (part, context, tier) in enumerate(chunks):
            yield i, len(chunks), part, context, tier


@udtf(returnType="sheet_no int, sheet string, row int, line string")
class XlsxLines:
    """The lines of one workbook's sheets, as ``xlsx.sheet_lines`` gives them."""

    def eval(self, content: bytes) -> Iterator[tuple]:
        rows: dict[tuple, list] = {}
        for no, sheet, row, col, number, text in xlsx.read_cells(bytes(content)) if content is not None else ():
            value = text.strip(" ") if number is None and text is not None else "" if number is None else str(int(number)) if number == int(number) and abs(number) < 1e15 else re.sub(r"e\+?(-?)0*", r"E\1", repr(number))
            if value.strip(" ") and sheet not in xlsx.SKIPPED_SHEETS:
                rows.setdefault((no, sheet, row), []).append((col, value))
        for (no, sheet, row), cells in sorted(rows.items()):
            cells.sort()
            yield no, sheet, row, "  " * cells[0][0] + "\t".join(v for _, v in cells)


def register(spark: SparkSession) -> None:
    """Makes both functions known to SQL."""
    spark.udtf.register("chunk_text", ChunkText)
    spark.udtf.register("xlsx_lines", XlsxLines)
