"""The readers as Spark data sources and table functions.

``register(spark)`` makes ``spark.read.format("legacy_office")`` known, with
options ``table`` and ``mode`` and a path or URI that the executors reach, and
for SQL one table function for each table, from a file's bytes to its rows.
"""

from __future__ import annotations

from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition
from pyspark.sql.functions import udtf
from pyspark.sql.types import StructType, _parse_datatype_string

from vellum.sources import ole, readers

#: Bytes of files that one task reads, about.
TASK_BYTES = 128 << 20


class Files(InputPartition):
    def __init__(self, paths: list[str]):
        self.paths = paths


class LegacyOffice(DataSource):
    @classmethod
    def name(cls) -> str:
        return "legacy_office"

    def schema(self) -> str:
        table = self.options.get("table", "ole_streams")
        if table not in readers.TABLES:
            raise ValueError(f"no table {table}; there are {', '.join(readers.TABLES)}")
        return f"path string, {readers.TABLES[table][0]}, _error string"

    def reader(self, schema: StructType) -> DataSourceReader:
        return Reader(self.options, len(schema.fields) - 2)


class Reader(DataSourceReader):
    def __init__(self, options, width: int):
        self.path, self.table, self.mode, self.width = options["path"], options.get("table", "ole_streams"), options.get("mode", "PERMISSIVE").upper(), width

    def partitions(self) -> list[InputPartition]:
        """Files in groups of about ``TASK_BYTES``."""
        from pyarrow import fs

        store, root = _store(self.path)
        info = store.get_file_info(root)
        found = [info] if info.type == fs.FileType.File else store.get_file_info(fs.FileSelector(root, recursive=True))
        out, now, held = [], [], 0
        for f in sorted((f for f in found if f.type == fs.FileType.File), key=lambda f: f.path):
            if now and held + f.size > TASK_BYTES:
                out.append(Files(now))
                now, held = [], 0
            now.append(f.path)
            held += f.size
        return [*out, Files(now)] if now else out or [Files([])]

    def read(self, partition: Files):
        rows_of = readers.TABLES[self.table][1]
        store, _ = _store(self.path)
        for path in partition.paths:
            try:
                with store.open_input_stream(path) as f:
                    for row in rows_of(f.read()):
                        yield (path, *row, None)
            except Exception as e:  # noqa: BLE001  (any bytes may come)
                if self.mode == "FAILFAST":
                    raise
                if self.mode == "PERMISSIVE":
                    yield (path, *[None] * self.width, str(e) if isinstance(e, ole.ParseError) else f"{self.table}: {e}")


def _store(path: str):
    import os

    from pyarrow import fs

    return fs.FileSystem.from_uri(path if "://" in path else f"file://{os.path.abspath(path)}")


def table_function(table: str):
    """A table function from a file's bytes to its rows; bytes that can't be
    parsed give what comes before the fault."""
    fields, rows_of = readers.TABLES[table]

    class Function:
        def eval(self, content: bytes):
            if content is None:
                return
            try:
                yield from (tuple(row) for row in rows_of(bytes(content)))
            except Exception:  # noqa: BLE001
                return

    return udtf(Function, returnType=_parse_datatype_string(fields).simpleString())


def register(spark: SparkSession) -> None:
    spark.dataSource.register(LegacyOffice)
    for table in readers.TABLES:
        spark.udtf.register(table, table_function(table))
