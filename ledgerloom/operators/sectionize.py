"""Files to sections: page headers are scored one by one, sections open where a strong header changes the type.

Pages are ordered by their place in the file's list; all windows are by file, one shuffle in all.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import tables as T
from ..session import written

HEADER_LINES = 20


def pages(files: DataFrame, id_col: str = "file_id", pages_col: str = "pages") -> DataFrame:
    """``(id, position, page, text)`` of every page of the files' lists, in order of page number; null lists and null pages give none.

    Positions count from 0 by page number, whatever the list's order and wherever its numbers start. Pages without a number come
    last, in the list's order.
    """
    placed = F.transform(F.filter(pages_col, lambda p: p.isNotNull()), lambda p, i: F.struct(p["page"].isNull().alias("lost"), p["page"].alias("page"), i.alias("i"), p["text"].alias("text")))
    before = lambda a, b, c: F.when(a[c] < b[c], -1).when(a[c] > b[c], 1)
    order = F.array_sort(placed, lambda a, b: F.coalesce(before(a, b, "lost"), before(a, b, "page"), before(a, b, "i"), F.lit(0)))
    return files.select(id_col, F.posexplode(order).alias("position", "p")).select(id_col, "position", F.col("p.page").alias("page"), F.col("p.text").alias("text"))


def header_scan(pages_df: DataFrame, text_col: str = "text") -> DataFrame:
    """Adds ``header_type, header_confidence, title``: best header in the first lines (first of equals), first line that isn't blank."""
    body = F.trim(F.regexp_replace(F.coalesce(F.col(text_col), F.lit("")), r"^\s+|\s+$", ""))
    first = F.lower(F.array_join(F.slice(F.split(body, "\n"), 1, HEADER_LINES), "\n"))
    d = pages_df.withColumn("_head", first).withColumn("title", F.coalesce(F.trim(F.get(F.split(body, "\n"), F.lit(0))), F.lit("")))
    best = F.lit(None).cast("string")
    conf = F.lit(0.0)
    # from the least confident and last of the table to the first of the most confident
    for c, kind, pattern in sorted(reversed(T.HEADERS), key=lambda x: x[0]):
        found = F.col("_head").rlike(f"(?dm){pattern}")
        best = F.when(found, F.lit(kind)).otherwise(best)
        conf = F.when(found, F.lit(c)).otherwise(conf)
    return d.withColumn("header_type", best).withColumn("header_confidence", conf).drop("_head")


def sections(pages_df: DataFrame, id_col: str = "file_id") -> DataFrame:
    """``(id, section_no, start_position, end_position, document_type, title, confidence)``.

    A page opens a section if its best header is strong and of another type than the current section. A file without one
    is a single UNKNOWN section over all its pages; pages before the first strong header belong to none.
    """
    return sections_of(header_scan(pages_df), id_col)


def sections_of(scanned: DataFrame, id_col: str = "file_id") -> DataFrame:
    """``sections`` of pages whose headers are scanned already."""
    by = Window.partitionBy(id_col).orderBy("position")
    ends = scanned.groupBy(id_col).agg(F.min("position").alias("first"), F.max("position").alias("last"), F.max_by("title", -F.col("position")).alias("first_title"))
    strong = scanned.filter(F.col("header_confidence") >= T.STRONG).withColumn("before", F.lag("header_type").over(by)).filter("before is null or before <> header_type")
    opened = strong.withColumn("section_no", F.row_number().over(by) - 1).withColumn("next", F.lead("position").over(by))
    return (
        ends.join(opened.select(id_col, "position", "section_no", "next", "header_type", "title", "header_confidence"), id_col, "left")
        .select(
            id_col,
            F.coalesce("section_no", F.lit(0)).alias("section_no"),
            F.coalesce("position", "first").alias("start_position"),
            F.coalesce(F.col("next") - 1, "last").alias("end_position"),
            F.coalesce("header_type", F.lit("UNKNOWN")).alias("document_type"),
            F.when(F.col("position").isNull(), "").otherwise(F.col("title")).alias("title"),
            F.coalesce("header_confidence", F.lit(0.0)).alias("confidence"),
        )
    )


def section_pages(pages_df: DataFrame, sections_df: DataFrame, id_col: str = "file_id") -> DataFrame:
    """Pages with the section they lie in (a range join within the file); pages of no section are left out."""
    s = sections_df.select(id_col, "section_no", "start_position", "end_position", "document_type")
    return pages_df.join(s, id_col).filter("position between start_position and end_position").drop("start_position", "end_position")


def unassigned_pages(pages_df: DataFrame, sections_df: DataFrame, id_col: str = "file_id") -> DataFrame:
    """Pages before a file's first strong header, where it has one."""
    first = sections_df.groupBy(id_col).agg(F.min("start_position").alias("start"))
    return pages_df.join(first, id_col).filter("position < start").drop("start")


def concat_pages(pages_df: DataFrame, keys: list[str] | None = None) -> DataFrame:
    """``(keys, text)``: pages in order under ``--- PAGE n ---`` lines; blank pages are skipped; no row without any text."""
    keys = keys or ["file_id"]
    kept = pages_df.filter(F.trim(F.regexp_replace("text", r"\s+", " ")) != "")
    marked = F.concat(F.lit("--- PAGE "), F.coalesce(F.col("page").cast("string"), F.lit("?")), F.lit(" ---\n"), F.col("text"))
    return kept.groupBy(*keys).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("position", marked.alias("t")))), lambda x: x["t"]), "\n").alias("text"))


def section_texts(files: DataFrame, id_col: str = "file_id") -> DataFrame:
    """``(id, section_no, document_type, text)`` of every section with text. The scan of the pages is written once, as three steps read it."""
    scanned = written(header_scan(pages(files, id_col)), "scanned")
    held = section_pages(scanned.select(id_col, "position", "page", "text"), sections_of(scanned, id_col), id_col)
    return concat_pages(held, [id_col, "section_no", "document_type"])
