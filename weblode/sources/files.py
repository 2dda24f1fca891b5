"""Files as rows, and the text inside them."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from weblode.functions.text import strip
from weblode.functions.url import extension_of_name
from weblode.lookups import PLAIN_TEXT_EXTENSIONS
from weblode.session import materialize
from weblode.sources.books import Book

PACKED_EXTENSIONS = ["pdf", "docx", "doc", "xlsx", "xls"]


def read_files(spark: SparkSession, path: str, pattern: str = "*") -> DataFrame:
    """``path, filename, extension, size, content`` of the files below a folder."""
    found = spark.read.format("binaryFile").option("pathGlobFilter", pattern).option("recursiveFileLookup", "true").load(path)
    named = found.withColumn("filename", F.url_decode(F.replace(F.substring_index("path", "/", -1), F.lit("+"), F.lit("%2B"))))
    return named.select("path", "filename", extension_of_name(F.col("filename")).alias("extension"), F.col("length").alias("size"), "content")


def decode_text(content: Column) -> Column:
    """UTF-8, or Latin-1 where the bytes are no valid UTF-8 (which never fails)."""
    text = content.cast("string")
    return F.when(F.is_valid_utf8(text), text).otherwise(F.decode(content, "ISO-8859-1"))


# --- packed formats: small readers, run per file inside tasks -----------------------------------


def _docx_text(data: bytes) -> str:
    import io
    import zipfile
    from xml.etree import ElementTree

    w = "{http://schemas.openxmlformats.org/wordprocessingml/2006/main}"
    with zipfile.ZipFile(io.BytesIO(data)) as package:
        body = ElementTree.fromstring(package.read("word/document.xml")).find(f"{w}body")
    written = {f"{w}t": lambda node: node.text or "", f"{w}tab": lambda _: "\t", f"{w}br": lambda _: "\n"}
    paragraphs = (
        "".join(written[node.tag](node) for node in paragraph.iter() if node.tag in written)
        for paragraph in body.findall(f"{w}p")
    )
    return "\n\n".join(text for text in paragraphs if text.strip())


def _xlsx_rows(data: bytes) -> list[tuple[str, list[list[str | None]]]]:
    import io

    with Book(io.BytesIO(data)) as book:
        return [(name, list(book.rows(part))) for name, part in book.sheets]


def _xls_rows(data: bytes) -> list[tuple[str, list[list[str | None]]]]:
    import xlrd  # optional; without it the file counts as failed

    book = xlrd.open_workbook(file_contents=data)
    return [
        (s.name, [[None if v in (None, "") else str(v) for v in s.row_values(r)] for r in range(s.nrows)])
        for s in book.sheets()
    ]


def _book_text(book: list[tuple[str, list[list[str | None]]]]) -> str:
    lines = []
    for name, rows in book:
        lines.append(f"[Sheet: {name}]")
        lines.extend(" | ".join(c for c in row if c is not None) for row in rows if any(c is not None for c in row))
    return "\n".join(lines)


def _pdf_text(data: bytes) -> str:
    import io

    from pypdf import PdfReader  # optional; without it the file counts as failed

    return "\n\n".join(text for text in (page.extract_text() for page in PdfReader(io.BytesIO(data)).pages) if text)


def _packed_text(data: bytes, extension: str) -> str:
    if extension == "pdf":
        return _pdf_text(data)
    if extension in ("docx", "doc"):
        return _docx_text(data)
    return _book_text(_xlsx_rows(data) if extension == "xlsx" else _xls_rows(data))


@F.pandas_udf(T.StringType())
def _read_packed(content: pd.Series, extension: pd.Series) -> pd.Series:
    def one(data, ext):
        try:
            return None if data is None else _packed_text(bytes(data), ext)
        except Exception:  # an unreadable file is a failed extraction, not a failed job
            return ""

    return pd.Series([one(d, e) for d, e in zip(content, extension)], dtype="object")


def extract_text(files: DataFrame) -> DataFrame:
    """Add ``extracted_text`` and ``text_extraction_status`` to rows with ``content`` and ``extension``.

    Plain formats are decoded by expressions.  Packed formats go through Arrow to small readers; all
    other rows pass nulls there.  Unknown extensions are ``unsupported``, blank or unreadable files
    ``failed``.
    """
    extension = F.lower(F.ltrim(F.col("extension"), F.lit(".")))
    staged = files.withColumn("_ext", extension)
    packed, plain = F.col("_ext").isin(PACKED_EXTENSIONS), F.col("_ext").isin(PLAIN_TEXT_EXTENSIONS)
    staged = staged.withColumn("_packed", _read_packed(F.when(packed, F.col("content")), F.col("_ext")))
    text = F.when(packed, F.col("_packed")).when(plain, decode_text(F.col("content")))
    staged = staged.withColumn("extracted_text", F.coalesce(strip(text), F.lit("")))
    status = (
        F.when(~packed & ~plain, F.lit("unsupported"))
        .when(F.col("extracted_text") == "", F.lit("failed"))
        .otherwise(F.lit("complete"))
    )
    return staged.withColumn("text_extraction_status", status).drop("_ext", "_packed")


_BOOK_ROWS = T.ArrayType(
    T.StructType()
    .add("sheet_index", "integer")
    .add("sheet", "string")
    .add("row_index", "long")
    .add("cells", T.ArrayType(T.StringType()))
)


@F.pandas_udf(_BOOK_ROWS)
def _book_rows(content: pd.Series, extension: pd.Series) -> pd.Series:
    def one(data, ext):
        try:
            book = _xls_rows(bytes(data)) if ext == "xls" else _xlsx_rows(bytes(data))
        except Exception:
            return None
        return [
            {"sheet_index": n, "sheet": name, "row_index": i, "cells": row}
            for n, (name, rows) in enumerate(book)
            for i, row in [(-1, None), *enumerate(rows)]
        ]

    return pd.Series([one(d, e) for d, e in zip(content, extension)], dtype="object")


def sheet_rows(files: DataFrame, keep: list[str]) -> DataFrame:
    """``keep`` columns plus ``sheet_index, sheet, row_index, cells`` of every row of every spreadsheet file.

    Each sheet also has a row ``-1`` without cells, so empty sheets are not lost.
    """
    extension = F.lower(F.ltrim(F.col("extension"), F.lit(".")))
    books = files.withColumn("_rows", _book_rows(F.col("content"), extension))
    return books.select(*keep, F.inline_outer("_rows"))


def spreadsheet_profiles(files: DataFrame, key: str) -> DataFrame:
    """``key, profile`` of tabular files: CSV and TSV as text, everything else as a workbook.

    Workbooks that cannot be opened have no profile.
    """
    from weblode.operators.sheets import csv_profile, workbook_profile

    extension = F.lower(F.ltrim(F.col("extension"), F.lit(".")))
    flat = extension.isin("csv", "tsv")
    texts = files.filter(flat).select(key, decode_text(F.col("content")).alias("text"), "extension")
    # Counts and samples both need the rows: written once, so that no workbook is opened twice.
    books = materialize(sheet_rows(files.filter(~flat), [key]).filter(F.col("sheet").isNotNull()), "sheet-rows")
    return csv_profile(texts, [key]).select(key, "profile").unionByName(workbook_profile(books, key))
