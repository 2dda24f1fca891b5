"""Profiles and text of tabular data."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from weblode.lookups import WHITESPACE

SAMPLE_ROWS = 5


def row_text(cells: Column) -> Column:
    """Cells of a row joined with `` | ``; nulls are left out."""
    return F.array_join(cells, " | ")


def sheet_text(rows: DataFrame, sheet: str = "sheet", order: str = "row_index") -> DataFrame:
    """Text form of sheets as ordered lines: a heading line per sheet, then one line per row with cells.

    ``rows``: sheet, row_index, cells.  The lines stay rows; joining a whole sheet into one value is
    left to the reader, since a sheet may be larger than a task's memory.
    """
    heads = rows.select(sheet).distinct().select(
        sheet, F.lit(-1).cast("bigint").alias(order), F.concat(F.lit("[Sheet: "), F.col(sheet), F.lit("]")).alias("line")
    )
    body = rows.filter(F.exists("cells", lambda c: c.isNotNull())).select(
        sheet, F.col(order).cast("bigint").alias(order), row_text(F.col("cells")).alias("line")
    )
    return heads.unionByName(body)


def sheet_profile(
    rows: DataFrame, sheet: str = "sheet", order: str = "row_index", keys: list[str] | None = None
) -> DataFrame:
    """Per sheet: ``row_count, headers, samples, more_rows`` and the ``profile`` lines.

    ``keys`` are further columns that tell sheets apart, such as the file.  Blank rows do not count.
    The header is the first row, then come up to five samples.  The count combines map-side, and the
    first six rows are a grouped top-k, which Spark cuts down inside each task before the shuffle: a
    sheet holding most of the data moves six rows per task.
    """
    group = [*(keys or []), sheet]
    cells = F.transform("cells", lambda c: F.coalesce(c, F.lit("")))
    filled = rows.filter(F.exists("cells", lambda c: F.coalesce(c, F.lit("")) != "")).select(
        *group, F.col(order).cast("bigint").alias(order), row_text(cells).alias("line")
    )
    # Grouping all rows, blank ones too, keeps empty sheets in the result.
    has_cells = F.exists("cells", lambda c: F.coalesce(c, F.lit("")) != "")
    counts = rows.groupBy(*group).agg(F.count_if(has_cells).alias("row_count"))
    w = Window.partitionBy(*group).orderBy(order)
    first = filled.withColumn("_rank", F.row_number().over(w)).filter(F.col("_rank") <= SAMPLE_ROWS + 1)
    heads = first.groupBy(*group).agg(
        F.max(F.when(F.col("_rank") == 1, F.col("line"))).alias("headers"),
        F.transform(
            F.array_sort(F.collect_list(F.when(F.col("_rank") > 1, F.struct("_rank", "line")))), lambda x: x["line"]
        ).alias("samples"),
    )
    joined = counts.join(heads, group, "left")
    count, shown = F.col("row_count"), F.size("samples")
    none = F.array().cast("array<string>")
    lines = F.concat(
        F.array(F.format_string("--- Sheet: %s (%d rows) ---", F.col(sheet), count)),
        F.when(count == 0, F.array(F.lit("  (empty sheet)"))).otherwise(
            F.concat(
                F.array(F.concat(F.lit("  Column headers: "), F.col("headers"))),
                F.when(shown > 0, F.array(F.format_string("  Sample data (%d of %d data rows):", shown, count - 1))).otherwise(none),
                F.coalesce(F.transform("samples", lambda s: F.concat(F.lit("    "), s)), none),
                F.when(count > 6, F.array(F.format_string("  ... and %d more rows", count - 6))).otherwise(none),
            )
        ),
    )
    return joined.select(
        *group,
        "row_count",
        "headers",
        "samples",
        F.greatest(count - 6, F.lit(0)).alias("more_rows"),
        F.array_join(lines, "\n").alias("profile"),
    )


def workbook_profile(rows: DataFrame, key: str, sheet: str = "sheet", position: str = "sheet_index") -> DataFrame:
    """``key, profile`` per file: the list of its sheets, then each sheet's profile in order.

    ``rows``: the key, ``sheet_index``, ``sheet``, ``row_index`` and ``cells``.
    """
    profiles = sheet_profile(rows, sheet, keys=[key, position])
    # One entry per sheet, so a file's list is as long as its sheets are many, not its rows.
    entries = F.array_sort(F.collect_list(F.struct(position, F.col(sheet).alias("name"), "profile")))
    books = profiles.groupBy(key).agg(entries.alias("_sheets"))
    names = F.array_join(F.transform("_sheets", lambda x: x["name"]), ", ")
    bodies = F.array_join(F.transform("_sheets", lambda x: F.concat(F.lit("\n"), x["profile"])), "\n")
    head = F.concat(F.format_string("Spreadsheet with %d sheet(s): ", F.size("_sheets")), names)
    return books.select(key, F.concat(head, F.lit("\n"), bodies).alias("profile"))


_ROWS = T.ArrayType(T.ArrayType(T.StringType()))


def _quoted_rows(text: str, delimiter: str) -> list[list[str]]:
    import csv
    import io
    import itertools

    records = csv.reader(io.StringIO(text, newline=""), delimiter=delimiter)
    filled = (row for row in records if any(cell.strip() for cell in row))
    return list(itertools.islice(filled, 1 + SAMPLE_ROWS))


@F.pandas_udf(_ROWS)
def _parse_quoted(text: pd.Series, delimiter: pd.Series) -> pd.Series:
    return pd.Series(
        [None if t is None else _quoted_rows(t, d) for t, d in zip(text, delimiter)], dtype="object"
    )


def csv_profile(files: DataFrame, keep: list[str], text: str = "text", extension: str = "extension") -> DataFrame:
    """``keep`` columns plus ``line_count, headers, samples`` and ``profile`` of CSV and TSV texts.

    The line count is the number of line breaks in the whole text.  Header and samples are the first
    six records that are not blank, wherever they stand.  Text without quotes is split by expressions; quoted text goes to the standard
    CSV reader through Arrow.
    """
    delimiter = F.when(F.lower(F.ltrim(F.col(extension), F.lit("."))) == "tsv", F.lit("\t")).otherwise(F.lit(","))
    source = files.select(*keep, F.col(text).alias("_text"), delimiter.alias("_delimiter"))
    tricky = F.contains("_text", F.lit('"')) | F.col("_text").rlike(r"\r(?!\n)")
    source = source.withColumn("_tricky", tricky)
    source = source.withColumn("_parsed", _parse_quoted(F.when(F.col("_tricky"), F.col("_text")), F.col("_delimiter")))
    # A line is blank if nothing but white space and delimiters is on it; only shown lines are split.
    marks = F.concat(F.lit(WHITESPACE), F.col("_delimiter"))
    filled = F.filter(F.split("_text", "\r?\n"), lambda line: F.btrim(line, marks) != "")
    plain = F.transform(F.slice(filled, 1, 1 + SAMPLE_ROWS), lambda line: F.split(line, F.col("_delimiter")))
    source = source.withColumn("_rows", F.when(F.col("_tricky"), F.col("_parsed")).otherwise(plain))
    breaks = F.length("_text") - F.length(F.replace("_text", F.lit("\n"), F.lit("")))
    shown = source.select(
        *keep,
        breaks.cast("bigint").alias("line_count"),
        F.array_join(F.get("_rows", F.lit(0)), " | ").alias("headers"),
        F.transform(F.slice("_rows", 2, SAMPLE_ROWS), lambda row: F.array_join(row, " | ")).alias("samples"),
    )
    none = F.array().cast("array<string>")
    parts = F.concat(
        F.array(
            F.format_string("CSV file with approximately %d rows", "line_count"),
            F.concat(F.lit("Column headers: "), F.col("headers")),
        ),
        F.when(F.size("samples") > 0, F.array(F.format_string("Sample data (%d rows):", F.size("samples")))).otherwise(none),
        F.transform("samples", lambda s: F.concat(F.lit("  "), s)),
        F.when(
            F.col("line_count") > 6,
            F.array(F.format_string("... and approximately %d more rows", F.col("line_count") - 6)),
        ).otherwise(none),
    )
    return shown.withColumn(
        "profile", F.when(F.col("headers").isNull(), F.lit("")).otherwise(F.array_join(parts, "\n"))
    )
