import os
import zipfile

import pytest
from pyspark.sql import functions as F

from ledgerloom.functions import udtf
from ledgerloom.sources import files as S
from ledgerloom.sources import xlsx


def workbook(path, sheets):
    """A minimal workbook: sheets of rows of values."""
    with zipfile.ZipFile(path, "w") as z:
        z.writestr("xl/workbook.xml", '<workbook xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main" xmlns:r="http://schemas.openxmlformats.org/officeDocument/2006/relationships"><sheets>' + "".join(f'<sheet name="{n}" sheetId="{i}" r:id="r{i}"/>' for i, n in enumerate(sheets)) + "</sheets></workbook>")
        z.writestr("xl/_rels/workbook.xml.rels", '<Relationships xmlns="http://schemas.openxmlformats.org/package/2006/relationships">' + "".join(f'<Relationship Id="r{i}" Target="worksheets/s{i}.xml"/>' for i in range(len(sheets))) + "</Relationships>")
        z.writestr("xl/sharedStrings.xml", '<sst xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main"><si><t>Shared</t></si></sst>')
        for i, rows in enumerate(sheets.values()):
            cells = ""
            for r, row in enumerate(rows):
                cells += f'<row r="{r + 1}">'
                for c, v in enumerate(row):
                    ref = f"{chr(65 + c)}{r + 1}"
                    if v == "@0":
                        cells += f'<c r="{ref}" t="s"><v>0</v></c>'
                    elif isinstance(v, str):
                        cells += f'<c r="{ref}" t="inlineStr"><is><t>{v}</t></is></c>'
                    elif v is not None:
                        cells += f'<c r="{ref}"><v>{v}</v></c>'
                cells += "</row>"
            z.writestr(f"xl/worksheets/s{i}.xml", f'<worksheet xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main"><sheetData>{cells}</sheetData></worksheet>')


def test_workbook(spark, tmp_path):
    workbook(tmp_path / "a.xlsx", {"Export Tips": [["skip me"]], "BS": [["@0"], [None, "Cash", 195243.33, 0.0], [None, " ", None], [None, None, "Sub", 2454.0]], "Empty": [[" "]]})
    (tmp_path / "sub").mkdir()
    (tmp_path / "sub" / "bad.xlsx").write_bytes(b"no zip")
    (tmp_path / "note.txt").write_bytes(b"x")
    cells = xlsx.read_workbooks(spark, str(tmp_path))
    assert [r.text.split(":")[0] for r in cells.filter("sheet is null").collect()] == ["BadZipFile"]
    cells = cells.filter("sheet is not null")
    assert cells.count() == 9
    spark.dataSource.register(xlsx.XlsxSource)
    one = spark.read.format("xlsx_cells").load(str(tmp_path / "a.xlsx"))
    assert sorted(map(tuple, one.drop("path").collect()), key=str) == sorted(map(tuple, cells.drop("path").collect()), key=str)
    udtf.register(spark)
    spark.read.format("binaryFile").load(str(tmp_path / "a.xlsx")).createOrReplaceTempView("books")
    sql = spark.sql("SELECT l.sheet, l.row, l.line FROM books, LATERAL xlsx_lines(content) l ORDER BY l.row").collect()
    assert [tuple(r) for r in sql] == [tuple(r) for r in xlsx.sheet_lines(cells).orderBy("row").select("sheet", "row", "line").collect()]
    assert [r.text for r in xlsx.workbook_text(cells).collect()] == ["--- SHEET: BS ---\nShared\n  Cash\t195243.33\t0\n    Sub\t2454\n"]
    os.makedirs(tmp_path / "none")
    assert xlsx.read_workbooks(spark, str(tmp_path / "none")).count() == 0


def test_files_and_readers(spark, tmp_path):
    (tmp_path / "x").mkdir()
    (tmp_path / "x" / "a.pdf").write_bytes(b"one\ftwo")
    (tmp_path / "b.pdf").write_bytes(b"bad")
    (tmp_path / "c.txt").write_bytes(b"no")
    (tmp_path / "big.pdf").write_bytes(b"x" * 200)
    found = S.list_files(spark, str(tmp_path), max_bytes=100)
    assert sorted(os.path.basename(r.path) for r in found.collect()) == ["a.pdf", "b.pdf"]

    def reader(content):
        if content == b"bad":
            raise ValueError("broken")
        return [(i + 1, t, None, None) for i, t in enumerate(content.decode().split("\f"))]

    S.register_reader("plain", reader)
    got = sorted((os.path.basename(r.path), r.page or 0, r.text, r.error) for r in S.read_pages(found, "plain").collect())
    assert got == [("a.pdf", 1, "one", None), ("a.pdf", 2, "two", None), ("b.pdf", 0, None, "ValueError: broken")]
    with pytest.raises(KeyError):
        S.read_pages(found, "missing")
    assert [os.path.basename(r.path) for r in S.in_order(found).collect()] == ["b.pdf", "a.pdf"]
    long = "words that make a page of text " * 5

    def layer(content):
        return reader(content) if content == b"bad" else [(1, long, None, None), (2, "", None, None)]

    S.register_reader("layer", layer)
    S.register_reader("image", lambda content: [(1, "image 1", 0.5, False), (2, "image 2", 0.6, True)])
    rows = lambda d: sorted((os.path.basename(r.path), r.page or 0, r.text, r.route) for r in d.collect())
    assert rows(S.gather(found, "layer", "image")) == [("a.pdf", 1, long, "text"), ("a.pdf", 2, "image 2", "ocr"), ("b.pdf", 0, None, "ocr")]
    assert [r[3] for r in rows(S.gather(found, "layer"))] == ["text", "text", "text"]
    assert {r[2] for r in rows(S.gather(found, "layer", "image", broken=lambda d: F.lit(True)))} == {"image 1", "image 2", None}
    assert {r[3] for r in rows(S.gather(found, "layer", vision_reader="image"))} == {"vision"}


def test_engines():
    have = {"tesseract": True, "easyocr": True, "paddleocr": True}
    assert S.choose_engine("auto", True, have) == "easyocr" and S.choose_engine("auto", False, have) == "tesseract" and S.choose_engine("paddleocr", False, have) == "paddleocr"
    assert S.choose_engine("easyocr", False, {"tesseract": True}) == "tesseract"
    with pytest.raises(RuntimeError):
        S.choose_engine("auto", True, {})


def test_routes_and_layout(spark):
    p = spark.createDataFrame([(1, "x" * 200, False), (2, "", False), (3, "y" * 200, True)], "id int, text string, broken boolean")
    assert [r.route for r in S.route(p, F.col("broken")).orderBy("id").collect()] == ["text", "ocr", "ocr"] and S.route(p, vision=True).filter("route = 'vision'").count() == 3
    words = spark.createDataFrame([(1, 10.0, 5.0, 0, "b"), (1, 10.4, 1.0, 1, "a"), (1, 30.0, 0.0, 2, "c")], "page int, top double, x0 double, ord int, text string")
    assert [r.line for r in S.word_lines(words, ["page"]).orderBy("y").collect()] == ["a  b", "c"]
    t = spark.createDataFrame([([["a", None], ["b", "c"]],)], "rows array<array<string>>")
    assert t.select(S.table_text(F.col("rows")).alias("t")).first().t == "a  \nb  c"
    f = spark.createDataFrame([("name\n---\nABC+F CID Identity-H yes yes no 5 0",), ("ABC WinAnsi yes yes no 5 0",)], "l string")
    assert [r.b for r in f.select(S.bad_fonts(F.col("l")).alias("b")).collect()] == [True, False]


def test_stream(spark, tmp_path):
    from ledgerloom.streaming import watch

    src, out = str(tmp_path / "in"), []
    spark.createDataFrame([(1, "c", None, [(1, "Balance Sheet")])], "file_id long, client_code string, received_at timestamp, pages array<struct<page:int,text:string>>").write.parquet(src)
    q = watch.write_batches(watch.watch_pages(spark, src), str(tmp_path / "ck"), lambda batch, _: out.extend(batch.collect()))
    q.awaitTermination(60)
    assert [r.file_id for r in out] == [1]
