"""Workbooks as rows: a Python data source that reads cells with the standard library, and their text layout.

    cells = read_workbooks(spark, "/folder")                            # path, sheet_no, sheet, row, col, number, text
    spark.dataSource.register(XlsxSource)
    cells = spark.read.format("xlsx_cells").load("/shared/book.xlsx")
"""

from __future__ import annotations

import io
import re
import zipfile
from typing import Iterator
from xml.etree import ElementTree

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

# Sheets that hold hints, not data.
SKIPPED_SHEETS = ("QuickBooks Desktop Export Tips", "QuickBooks Export Tips", "Export Tips")
SUFFIXES = (".xlsx", ".xlsm", ".xltx", ".xltm")
_NS = "{http://schemas.openxmlformats.org/spreadsheetml/2006/main}"
_REL = "{http://schemas.openxmlformats.org/officeDocument/2006/relationships}id"


def read_cells(content: bytes) -> Iterator[tuple[int, str, int, int, float | None, str | None]]:
    """``(sheet_no, sheet, row, col, number, text)`` of every cell with a value; rows and columns count from 0."""
    with zipfile.ZipFile(io.BytesIO(content)) as z:
        names = set(z.namelist())
        shared: list[str] = []
        if "xl/sharedStrings.xml" in names:
            for si in ElementTree.fromstring(z.read("xl/sharedStrings.xml")):
                shared.append("".join(t.text or "" for t in si.iter(f"{_NS}t")))
        rels = {r.get("Id"): r.get("Target") for r in ElementTree.fromstring(z.read("xl/_rels/workbook.xml.rels"))}
        for no, sheet in enumerate(ElementTree.fromstring(z.read("xl/workbook.xml")).iter(f"{_NS}sheet")):
            target = rels[sheet.get(_REL)].lstrip("/")
            path = target if target.startswith("xl/") else f"xl/{target}"
            for c in ElementTree.fromstring(z.read(path)).iter(f"{_NS}c"):
                m = re.fullmatch(r"([A-Z]+)(\d+)", c.get("r", ""))
                if not m:
                    continue
                col = 0
                for letter in m[1]:
                    col = col * 26 + ord(letter) - 64
                kind, v = c.get("t", "n"), c.find(f"{_NS}v")
                number = text = None
                if kind == "inlineStr":
                    text = "".join(t.text or "" for t in c.iter(f"{_NS}t"))
                elif v is None or v.text is None:
                    continue
                elif kind == "s":
                    text = shared[int(v.text)]
                elif kind == "n":
                    number = float(v.text)
                elif kind == "b":
                    text = "True" if v.text == "1" else "False"
                else:
                    text = v.text
                yield no, sheet.get("name"), int(m[2]) - 1, col - 1, number, text


CELL_SCHEMA = "path string, sheet_no int, sheet string, row int, col int, number double, text string"


def cells_of(files: DataFrame) -> DataFrame:
    """Cells of workbooks given as rows ``path, content`` (the binary file source, on any file system that Spark reads).

    A workbook that can't be read gives one row with its error in ``text`` and no sheet.
    """

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        columns = [c.split()[0] for c in CELL_SCHEMA.split(", ")]
        for f in frames:
            for path, content in zip(f["path"], f["content"]):
                try:
                    rows = [(path, *cell) for cell in read_cells(bytes(content))]
                except Exception as e:  # noqa: BLE001  one bad file must not end the job
                    rows = [(path, None, None, None, None, None, f"{type(e).__name__}: {e}"[:500])]
                yield pd.DataFrame(rows, columns=columns).astype({"sheet_no": "Int64", "row": "Int64", "col": "Int64"})

    return files.select("path", "content").mapInPandas(run, CELL_SCHEMA)


def read_workbooks(spark: SparkSession, root: str, max_bytes: int = 50 * 1024 * 1024) -> DataFrame:
    """Cells of all workbooks below ``root``."""
    glob = "*.{" + ",".join(s[1:] for s in SUFFIXES) + "}"
    return cells_of(spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", glob).load(root).filter(F.col("length") <= max_bytes))


class _Whole(InputPartition):
    def __init__(self, path: str):
        self.path = path


class XlsxReader(DataSourceReader):
    """The cells of one workbook on a path that every machine sees; folders and object stores go through ``read_workbooks``."""

    def __init__(self, path: str):
        self.path = path

    def partitions(self) -> list[InputPartition]:
        return [_Whole(self.path.removeprefix("file:"))]

    def read(self, partition: _Whole) -> Iterator[tuple]:
        with open(partition.path, "rb") as f:
            for cell in read_cells(f.read()):
                yield (partition.path, *cell)


class XlsxSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "xlsx_cells"

    def schema(self) -> str:
        return CELL_SCHEMA

    def reader(self, schema) -> DataSourceReader:
        return XlsxReader(self.options["path"])


def cell_text(number: Column, text: Column) -> Column:
    """Whole numbers without a point, other numbers as they round-trip, text trimmed."""
    whole = (number == F.floor(number)) & (F.abs(number) < 1e15)
    return F.when(number.isNull(), F.trim(text)).when(whole, number.cast("bigint").cast("string")).otherwise(number.cast("string"))


def sheet_lines(cells: DataFrame, keys: list[str] | None = None) -> DataFrame:
    """``(keys, row, line)``: the first cell indented by two blanks for each column before it, then the others after tabs.

    Blank cells and rows without others are skipped, sheets with hints too.
    """
    keys = keys or ["path", "sheet_no", "sheet"]
    kept = cells.filter(~F.col("sheet").isin(*SKIPPED_SHEETS)).withColumn("value", cell_text(F.col("number"), F.col("text"))).filter("trim(value) <> ''")
    rows = kept.groupBy(*keys, "row").agg(F.array_sort(F.collect_list(F.struct("col", "value"))).alias("c"))
    first = F.get("c", F.lit(0))
    return rows.select(*keys, "row", F.concat(F.repeat(F.lit("  "), first["col"]), F.array_join(F.transform("c", lambda x: x["value"]), "\t")).alias("line"))


def workbook_text(cells: DataFrame, key: str = "path") -> DataFrame:
    """``(path, text)``: sheets in order under ``--- SHEET: name ---`` lines; sheets without lines are skipped."""
    lines = sheet_lines(cells, [key, "sheet_no", "sheet"])
    sheets = lines.groupBy(key, "sheet_no", "sheet").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("row", "line"))), lambda x: x["line"]), "\n").alias("body"))
    marked = F.concat(F.lit("--- SHEET: "), F.col("sheet"), F.lit(" ---\n"), F.col("body"))
    return sheets.groupBy(key).agg(F.concat(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("sheet_no", marked.alias("t")))), lambda x: x["t"]), "\n"), F.lit("\n")).alias("text"))
