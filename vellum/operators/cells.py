"""Spreadsheet cells: values by type, formats, dense rows, summaries."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from vellum.functions import numbers

NUMERIC = ("Number", "Rk")
TEXT = ("LabelSSt", "LabelBIFF8", "LabelBIFF5", "BoolErr")
BLANK = ("Blank", "FakeBlank")
#: XF that stands in for a missing one.
DEFAULT_XF = 15


def values(cells: DataFrame) -> DataFrame:
    """numeric, string and kept for each cell: numbers by their value, texts
    by theirs, blanks not kept; an unknown type is a text if it has any."""
    kind = F.col("cell_type")
    number, blank = kind.isin(*NUMERIC), kind.isin(*BLANK)
    text = ~number & ~blank & (kind.isin(*TEXT) | (F.coalesce(F.length("str_val"), F.lit(0)) > 0))
    return cells.withColumns({"numeric": F.when(number, F.col("num_val")), "string": F.when(text, F.col("str_val")), "kept": number | text})


def with_strings(cells: DataFrame, strings: DataFrame) -> DataFrame:
    """Shared strings put in for their numbers; a number out of range gives
    null."""
    own = strings.select("path", "sst_idx", F.col("text").alias("__text"))
    out = cells.join(own, ["path", "sst_idx"], "left")
    return out.withColumn("str_val", F.coalesce("__text", "str_val")).drop("__text")


def with_formats(cells: DataFrame, xfs: DataFrame, formats: DataFrame) -> DataFrame:
    """ifmt and pattern of each cell through its XF; a number beyond the XFs
    takes XF 15, a format without a record no pattern."""
    last = xfs.groupBy("path").agg(F.max("xf_idx").alias("__last"))
    out = cells.join(last, "path", "left")
    out = out.withColumn("__xf", F.when(F.col("xf_idx") > F.col("__last"), DEFAULT_XF).otherwise(F.col("xf_idx")))
    out = out.join(xfs.select("path", F.col("xf_idx").alias("__xf"), "ifmt"), ["path", "__xf"], "left")
    return out.join(formats.select("path", "ifmt", "pattern"), ["path", "ifmt"], "left").drop("__xf", "__last")


def shown(cells: DataFrame) -> DataFrame:
    """The text that each cell shows, by type and format."""
    number = F.col("cell_type").isin(*NUMERIC)
    return cells.withColumn("shown", F.when(number, numbers.render(F.col("num_val"), F.col("pattern"), F.col("ifmt"))).otherwise(F.coalesce("str_val", F.lit(""))))


def sizes(cells: DataFrame) -> DataFrame:
    """Rows and columns of each sheet; of a sheet without cells none is given."""
    return cells.groupBy("path", "sheet_id").agg((F.max("row_idx") + 1).alias("n_rows"), (F.max("col_idx") + 1).alias("n_columns"), F.count(F.lit(1)).alias("n_cells"))


def first_appearance(cells: DataFrame) -> DataFrame:
    """(path, string, idx): each workbook's distinct texts in the order in
    which its sheets, rows and columns bring them."""
    at = F.min(F.struct("sheet_id", "row_idx", "col_idx")).alias("__at")
    seen = cells.where(F.col("string").isNotNull()).groupBy("path", "string").agg(at)
    return seen.select("path", "string", (F.row_number().over(Window.partitionBy("path").orderBy("__at")) - 1).alias("idx"))
