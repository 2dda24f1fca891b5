"""Workbooks as a data source: a partition per sheet, rows one at a time."""

from __future__ import annotations

import io
import tracemalloc
import zipfile

import pytest

from weblode.sources.books import Book, BookReader, BookSource

M = "http://schemas.openxmlformats.org/spreadsheetml/2006/main"
R = "http://schemas.openxmlformats.org/officeDocument/2006/relationships"
P = "http://schemas.openxmlformats.org/package/2006/relationships"


def packed(sheets, shared=()):
    parts = {
        "xl/workbook.xml": f'<workbook xmlns="{M}" xmlns:r="{R}"><sheets>' + "".join(f'<sheet name="{n}" r:id="r{i}"/>' for i, n in enumerate(sheets)) + "</sheets></workbook>",
        "xl/_rels/workbook.xml.rels": f'<Relationships xmlns="{P}">' + "".join(f'<Relationship Id="r{i}" Target="/xl/worksheets/{i}.xml"/>' for i in range(len(sheets))) + "</Relationships>",
    }
    if shared:
        parts["xl/sharedStrings.xml"] = f'<sst xmlns="{M}">' + "".join(f"<si><r><t>{s}</t></r></si>" for s in shared) + "</sst>"
    for i, rows in enumerate(sheets.values()):
        parts[f"xl/worksheets/{i}.xml"] = f'<worksheet xmlns="{M}"><sheetData>{rows}</sheetData></worksheet>'
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as package:
        for name, text in parts.items():
            package.writestr(name, text)
    return out.getvalue()


def test_rows_through_the_data_source(spark, tmp_path):
    cells = '<row><c r="B1" t="s"><v>1</v></c><c r="D1"><v>7</v></c></row><row/><row><c t="b"><v>1</v></c></row>'
    (tmp_path / "a.xlsx").write_bytes(packed({"One": cells, "Two": ""}, ["x", "y"]))
    (tmp_path / "b.xlsx").write_bytes(packed({"Three": '<row><c r="A1"><v>1.50</v></c></row>'}))
    (tmp_path / "note.txt").write_text("no book")
    spark.dataSource.register(BookSource)
    frame = spark.read.format("xlsx").load(str(tmp_path))
    got = sorted((r.path.rpartition("/")[2], r.sheet, r.row, r.cells) for r in frame.collect())
    assert got == [("a.xlsx", "One", 1, [None, "y", None, "7"]), ("a.xlsx", "One", 2, []), ("a.xlsx", "One", 3, ["True"]), ("b.xlsx", "Three", 1, ["1.5"])]
    assert len(BookReader(str(tmp_path)).partitions()) == 3
    assert spark.read.format("xlsx").load(f"{tmp_path}/none*.xlsx").count() == 0
    (tmp_path / "c.xlsx").write_bytes(b"no zip")
    with pytest.raises(Exception, match="zip"):
        spark.read.format("xlsx").load(str(tmp_path)).count()


def test_long_sheets_need_little_memory():
    """A million rows: what is held is a row, not the sheet."""
    row = '<row><c r="A1"><v>1</v></c><c r="B1" t="inlineStr"><is><t>text</t></is></c></row>'
    data = packed({"Long": row * 1_000_000})
    tracemalloc.start()
    with Book(io.BytesIO(data)) as book:
        count = sum(cells == ["1", "text"] for cells in book.rows(book.sheets[0][1]))
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert count == 1_000_000 and peak < 5_000_000


def test_narrow_rows_are_spread_over_tasks(spark):
    from pyspark.sql import functions as F

    from weblode.plans.enrich_queries import _workbooks
    from weblode.sources.tables import spread

    rows = spread(spark.range(0, 5_000, 1, 1), "id", 1_000)
    assert rows.select(F.spark_partition_id().alias("p")).distinct().count() == 5 and rows.count() == 5_000
    # 15,000 customers in one small file.
    books = _workbooks(spark, "/root/testdata/sf0.1").select(F.spark_partition_id().alias("p"))
    assert books.distinct().count() == 8
