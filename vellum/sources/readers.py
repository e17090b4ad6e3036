"""Office files as DataFrames: one table of one kind of file at a time.

Files come through Spark's ``binaryFile``, so any file system that Spark reads
will do, and go to their parser one by one: a task holds one file. Only the
asked-for table is parsed for, or several of them from one read. What a file yields before an error stays; with
``mode`` PERMISSIVE the error is a row of its own with ``_error``, with
DROPMALFORMED it is left out, with FAILFAST it ends the query.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import _parse_datatype_string

from vellum.sources import biff, ole, slides, word

#: Table to schema behind the path, and the function from bytes to its rows.
TABLES = {
    "ole_streams": ("entry_id int, name string, object_type int, start_sector bigint, size bigint, data binary", ole.stream_rows),
    "xls_books": ("version int, codepage int, date1904 boolean, n_sheets int, n_strings int", biff.book_rows),
    "xls_sheets": ("sheet_id int, sheet_name string, position bigint", biff.sheet_rows),
    "xls_cells": ("sheet_id int, sheet_name string, row_idx int, col_idx int, cell_type string, xf_idx int, sst_idx bigint, str_val string, num_val double, int_val bigint", biff.cell_rows),
    "xls_sst": ("sst_idx bigint, text string, runs array<struct<ich:int,ifnt:int>>", biff.string_rows),
    "xls_xf": ("xf_idx int, font_idx int, ifmt int", biff.xf_rows),
    "xls_formats": ("ifmt int, pattern string", biff.format_rows),
    "biff_records": ("seq int, offset bigint, rec_type int, len int, body binary", biff.record_rows),
    **word.TABLES,
    **slides.TABLES,
}
MODES = ("PERMISSIVE", "DROPMALFORMED", "FAILFAST")
#: Rows that a parser hands over at once.
ROWS = 4096


def files(spark: SparkSession, path: str | list[str], pattern: str | None = None) -> DataFrame:
    """(path, content) of the files under a path."""
    reader = spark.read.format("binaryFile").option("recursiveFileLookup", "true")
    if pattern:
        reader = reader.option("pathGlobFilter", pattern)
    return reader.load(path).select("path", "content")


def parse(source: DataFrame, table: str, mode: str = "PERMISSIVE", **options) -> DataFrame:
    """A table of the files in ``source`` (path, content), with ``_error``.
    A null content is a file that can't be parsed."""
    if table not in TABLES:
        raise ValueError(f"no table {table}; there are {', '.join(TABLES)}")
    if mode not in MODES:
        raise ValueError(f"mode is one of {', '.join(MODES)}")
    fields, rows_of = TABLES[table]
    schema = _parse_datatype_string(f"path string, {fields}, _error string")
    from pyspark.sql.pandas.types import to_arrow_schema

    target = to_arrow_schema(schema)
    width = len(target) - 2

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, content in zip(batch.column(0).to_pylist(), batch.column(1)):
                held: list[tuple] = []
                error = None
                try:
                    data = content.as_py()
                    if data is None:
                        raise ole.ParseError("file: no content")
                    for row in rows_of(data, **options):
                        held.append(row)
                        if len(held) == ROWS:
                            yield _batch(path, held, target)
                            held = []
                except Exception as e:  # noqa: BLE001  (any bytes may come)
                    if mode == "FAILFAST":
                        raise
                    error = str(e) if isinstance(e, ole.ParseError) else f"{table}: {type(e).__name__}: {e}"
                if held:
                    yield _batch(path, held, target)
                if error and mode == "PERMISSIVE":
                    yield _batch(path, [(None,) * width], target, error)

    return source.select("path", "content").mapInArrow(run, schema)


def _batch(path: str, rows: list[tuple], target: pa.Schema, error: str | None = None) -> pa.RecordBatch:
    columns = [[path] * len(rows), *zip(*rows), [error] * len(rows)]
    return pa.RecordBatch.from_arrays([pa.array(c, type=f.type) for c, f in zip(columns, target)], schema=target)


def parse_all(source: DataFrame, tables: tuple[str, ...], mode: str = "PERMISSIVE", **options) -> DataFrame:
    """Several tables of the files in ``source`` from one read of each file:
    (path, table, _error) and a struct column for each table, filled in the
    rows of that table. ``of`` takes one table out."""
    for t in tables:
        if t not in TABLES:
            raise ValueError(f"no table {t}; there are {', '.join(TABLES)}")
    if mode not in MODES:
        raise ValueError(f"mode is one of {', '.join(MODES)}")
    schema = _parse_datatype_string("path string, table string, _error string, " + ", ".join(f"{t} struct<{_nested(TABLES[t][0])}>" for t in tables))
    from pyspark.sql.pandas.types import to_arrow_schema

    target = to_arrow_schema(schema)

    def made(path: str, table: str, rows: list[tuple], error: str | None = None) -> pa.RecordBatch:
        cols = [pa.array([path] * len(rows)), pa.array([table] * len(rows)), pa.array([error] * len(rows), pa.string())]
        for f in list(target)[3:]:
            if f.name == table and error is None:
                fields = list(f.type)
                cols.append(pa.StructArray.from_arrays([pa.array(c, x.type) for c, x in zip(zip(*rows), fields)], fields=fields))
            else:
                cols.append(pa.nulls(len(rows), f.type))
        return pa.RecordBatch.from_arrays(cols, schema=target)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, content in zip(batch.column(0).to_pylist(), batch.column(1)):
                data = content.as_py()
                for t in tables:
                    held: list[tuple] = []
                    error = None
                    try:
                        if data is None:
                            raise ole.ParseError("file: no content")
                        for row in TABLES[t][1](data, **options):
                            held.append(row)
                            if len(held) == ROWS:
                                yield made(path, t, held)
                                held = []
                    except Exception as e:  # noqa: BLE001  (any bytes may come)
                        if mode == "FAILFAST":
                            raise
                        error = str(e) if isinstance(e, ole.ParseError) else f"{t}: {type(e).__name__}: {e}"
                    if held:
                        yield made(path, t, held)
                    if error and mode == "PERMISSIVE":
                        yield made(path, t, [()], error)

    return source.select("path", "content").mapInArrow(run, schema)


def _nested(fields: str) -> str:
    """Fields of a table as those of a struct."""
    return ",".join(f"{f.name}:{f.dataType.simpleString()}" for f in _parse_datatype_string(fields))


def of(parsed: DataFrame, table: str) -> DataFrame:
    """One table of what ``parse_all`` gave, without its errors."""
    return parsed.where((F.col("table") == table) & F.col("_error").isNull()).select("path", f"{table}.*")


def load(spark: SparkSession, path: str | list[str], table: str, mode: str = "PERMISSIVE", pattern: str | None = None, **options) -> DataFrame:
    """A table of all files under a path."""
    return parse(files(spark, path, pattern), table, mode, **options)


def errors(parsed: DataFrame) -> DataFrame:
    return parsed.where(F.col("_error").isNotNull()).select("path", "_error")


def good(parsed: DataFrame) -> DataFrame:
    return parsed.where(F.col("_error").isNull()).drop("_error")
