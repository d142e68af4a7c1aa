"""Files as rows, and the plug-ins that turn their content into pages.

Readers for page formats (text layer, tables, OCR, vision models) depend on libraries that a cluster may lack. Each is a
named plug-in ``bytes -> [(page, text, confidence, rotated)]``; a missing one is an error when it is asked for, not before.
"""

from __future__ import annotations

import importlib.util
from typing import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import page_type
from ..session import written

MAX_BYTES = 50 * 1024 * 1024
PAGE_SCHEMA = "path string, page int, text string, confidence double, rotated boolean, error string"
PageReader = Callable[[bytes], list[tuple[int, str, float | None, bool | None]]]
_READERS: dict[str, PageReader] = {}


def register_reader(name: str, reader: PageReader) -> None:
    """Makes a page reader known by name, for ``read_pages`` and the routing."""
    _READERS[name] = reader


def engines() -> dict[str, bool]:
    """Which OCR engines could run here."""
    libs = {"tesseract": "pytesseract", "easyocr": "easyocr", "paddleocr": "paddleocr"}
    return {e: e in _READERS or importlib.util.find_spec(m) is not None for e, m in libs.items()}


def choose_engine(wanted: str = "auto", accelerator: bool = False, available: dict[str, bool] | None = None) -> str:
    """The wanted engine if there is one; else easyocr with an accelerator, tesseract, paddleocr; an error without any."""
    have = engines() if available is None else available
    if wanted != "auto" and have.get(wanted):
        return wanted
    order = (["easyocr"] if accelerator else []) + ["tesseract", "paddleocr"]
    for e in order:
        if have.get(e):
            return e
    raise RuntimeError("no OCR engine is available")


def list_files(spark: SparkSession, root: str, pattern: str = "*.pdf", max_bytes: int = MAX_BYTES) -> DataFrame:
    """``path, modificationTime, length, content`` of all files below ``root`` that fit the pattern and the size.

    The size filter reaches the scan, so larger files' contents aren't read; nor are any where only the other columns are used.
    """
    return spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", pattern).load(root).filter(F.col("length") <= max_bytes)


def in_order(files: DataFrame) -> DataFrame:
    """Files by path, for output that is read in order; the rest of a run doesn't depend on it."""
    return files.orderBy("path")


def read_pages(files: DataFrame, reader: str) -> DataFrame:
    """Pages of each file by a registered reader. A file that fails gives one row with its error and no text."""
    if reader not in _READERS:
        raise KeyError(f"no page reader {reader!r} is registered")
    read = _READERS[reader]

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        columns = ["path", "page", "text", "confidence", "rotated", "error"]
        for f in frames:
            rows = []
            for path, content in zip(f["path"], f["content"]):
                try:
                    rows += [(path, p, t, c, r, None) for p, t, c, r in read(bytes(content))]
                except Exception as e:  # noqa: BLE001  one bad file must not end the job
                    rows.append((path, None, None, None, None, f"{type(e).__name__}: {e}"[:500]))
            yield pd.DataFrame(rows, columns=columns)

    return files.select("path", "content").mapInPandas(run, PAGE_SCHEMA)


def route(pages: DataFrame, broken: Column | None = None, vision: bool = False) -> DataFrame:
    """Adds ``page_type`` and ``route``: vision takes all pages, broken text layers go to OCR whole, image pages to OCR, others stay."""
    d = pages.withColumn("page_type", page_type(F.col("text")))
    if vision:
        return d.withColumn("route", F.lit("vision"))
    ocr = F.col("page_type") == "image"
    return d.withColumn("route", F.when(ocr if broken is None else (ocr | F.coalesce(broken, F.lit(False))), "ocr").otherwise("text"))


def gather(files: DataFrame, reader: str, image_reader: str | None = None, vision_reader: str | None = None, broken: Callable[[DataFrame], Column] | None = None) -> DataFrame:
    """Pages of each file, each from the reader that its route names, as one table with ``route``.

    With a ``vision_reader`` it reads all pages. Else ``reader`` reads the text layer; pages with little text, and all pages of
    files where ``broken`` (a column made from the pages) says so, come from ``image_reader`` where there is one. Files are read
    by the second reader only where a page of theirs needs it.
    """
    if vision_reader:
        return read_pages(files, vision_reader).withColumn("route", F.lit("vision"))
    layer = written(read_pages(files, reader), "layer")
    layer = route(layer, broken(layer) if broken else None)
    if not image_reader:
        return layer.drop("page_type").withColumn("route", F.lit("text"))
    wanted = layer.filter("route = 'ocr' and error is null").select("path", "page").distinct()
    images = read_pages(files.join(wanted.select("path").distinct(), "path", "left_semi"), image_reader)
    images = images.join(wanted, [images["path"] == wanted["path"], images["page"].eqNullSafe(wanted["page"]) | images["error"].isNotNull()], "left_semi")
    kept = layer.filter("route = 'text' or error is not null").drop("page_type")
    return kept.unionByName(images.withColumn("route", F.lit("ocr")))


def word_lines(words: DataFrame, keys: list[str]) -> DataFrame:
    """``(keys, y, line)``: words on nearly one height, from left to right, two blanks between. ``words`` has ``top, x0, ord, text``."""
    y = (F.bround(F.col("top") / 3, 0) * 3).cast("int")
    return words.groupBy(*keys, y.alias("y")).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("x0", "ord", "text"))), lambda w: w["text"]), "  ").alias("line"))


def page_confidence(words: DataFrame, keys: list[str], low: float = 0.6) -> DataFrame:
    """``(keys, confidence, doubtful)``: mean of the words' confidences; null, and not doubtful, where an engine gives none."""
    return words.groupBy(*keys).agg(F.avg("confidence").alias("confidence")).withColumn("doubtful", F.coalesce(F.col("confidence") < low, F.lit(False)))


def table_text(rows: Column) -> Column:
    """Text of a table given as rows of cells: cells two blanks apart (null as empty), rows on lines."""
    return F.array_join(F.transform(rows, lambda r: F.array_join(r, "  ", "")), "\n")


def bad_fonts(listing: Column) -> Column:
    """Whether a font listing names a two-byte font without character map."""
    fonts = F.filter(F.split(listing, "\n"), lambda x: x.rlike(r"\bIdentity-[HV]\b"))
    cells = lambda x: F.split(F.trim(x), r"\s+")
    return F.exists(fonts, lambda x: F.array_contains(F.slice(cells(x), F.greatest(F.lit(1), F.size(cells(x)) - 3), 2), "no"))
