import pytest
from pyspark.sql import functions as F

from vellum.plans import samples as b
from vellum.plans import convert
from vellum.sources import datasource
from vellum.streaming import arrivals


def book(text):
    return b.workbook([("S", [b.label(0, 0, text), b.number(1, 0, 2.5)])])


def test_files_are_converted_as_they_arrive(spark, tmp_path):
    src, out = tmp_path / "in", tmp_path / "out"
    src.mkdir()
    (src / "a.xls").write_bytes(book("one"))
    (src / "bad.xls").write_bytes(b"nothing")
    start = lambda: arrivals.convert(spark, str(src), convert.xls_to_xlsx, str(out), ".xlsx", str(tmp_path / "ckpt"), "*.xls").awaitTermination(120)
    assert start()
    (src / "b.xls").write_bytes(book("two"))
    assert start()
    assert sorted(p.name.split("-")[0] for p in out.glob("*.xlsx")) == ["a", "b"]
    assert [r._error[:4] for r in spark.read.parquet(str(out / "_errors")).collect()] == ["cfb:"]


def test_windows_close_behind_the_watermark(spark, sf_small, tmp_path):
    events = spark.read.parquet(f"{sf_small}/events.parquet")
    stream = spark.readStream.schema(events.schema).parquet(f"{sf_small}/events.parquet*")
    q = arrivals.windowed(stream).writeStream.format("memory").queryName("win").outputMode("complete").trigger(availableNow=True).start()
    assert q.awaitTermination(120)
    want = events.groupBy(F.window("ts", "1 hour"), "event_type").count()
    got = spark.table("win")
    assert got.count() == want.count() and got.agg(F.sum("n")).first()[0] == events.count()
    batch = arrivals.sessions(events)
    assert batch.agg(F.sum("n")).first()[0] == events.count()


@pytest.fixture(scope="module")
def folder(tmp_path_factory):
    path = tmp_path_factory.mktemp("office")
    (path / "a.xls").write_bytes(book("hello"))
    (path / "b.xls").write_bytes(b"junk")
    return str(path)


def test_format_and_table_functions(spark, folder):
    datasource.register(spark)
    rows = spark.read.format("legacy_office").option("table", "xls_cells").load(folder)
    assert rows.where("_error IS NULL").count() == 2 and rows.where("_error IS NOT NULL").count() == 1
    spark.read.format("binaryFile").load(folder).createOrReplaceTempView("office_files")
    out = spark.sql("SELECT c.str_val FROM office_files f, LATERAL xls_cells(f.content) c ORDER BY c.row_idx").collect()
    assert [r.str_val for r in out] == ["hello", "2.5"]
