import io
import math
import random
import struct
import xml.dom.minidom
import zipfile

import pytest
from pyspark.sql import functions as F

from vellum.plans import samples as b
from vellum.functions import numbers
from vellum.operators import cells as cl
from vellum.operators import packages as pk
from vellum.plans import catalog
from vellum.sinks import xlsx
from vellum.sources import biff, ole, readers

GOLDEN = ["3", "4", "2.1", "String 3", "http://x.org/", "", "", "String 3", "3", "TRUE", "9/3/19", "09/03/2019 13:12:59", "55.00%", "#DIV/0!"]


def golden():
    when = 43711 + (13 * 3600 + 12 * 60 + 59) / 86400
    xfs = [0] * 16 + [164, 165, 166]
    row = [b.mul_rk(2, 0, [3, 4]), b.number(2, 2, 2.1), b.label_sst(2, 3, 0), b.label(2, 4, "http://x.org/"), b.mul_blank(2, 5, 2), b.label_sst(2, 7, 0), b.rk_cell(2, 8, 3), b.bool_err(2, 9, 1), b.rk_cell(2, 10, 43711, 16), b.number(2, 11, when, 17), b.rk_cell(2, 12, 0.55, 18, True), b.bool_err(2, 13, 7, 1)]
    return b.workbook([("Sheet1", row), ("Empty", [])], ["String 3"], {164: "M/D/YY", 165: "MM/DD/YYYY HH:MM:SS", 166: "0.00%"}, xfs)


def source(spark, **files):
    return spark.createDataFrame([(k, bytearray(v) if v is not None else None) for k, v in files.items()], "path string, content binary")


def table(spark, name, **files):
    return readers.good(readers.parse(source(spark, **files), name))


def test_golden_row(spark):
    t = lambda name: table(spark, name, book=golden())
    rows = cl.shown(cl.with_formats(cl.with_strings(t("xls_cells"), t("xls_sst")), t("xls_xf"), t("xls_formats"))).orderBy("col_idx").collect()
    assert [r.shown for r in rows] == GOLDEN
    assert [r.cell_type for r in rows][:5] == ["Rk", "Rk", "Number", "LabelSSt", "LabelBIFF8"]
    assert [tuple(r) for r in cl.sizes(t("xls_cells")).collect()] == [("book", 0, 3, 14, 14)]


@pytest.mark.parametrize("version,scatter", [(3, False), (3, True), (4, False), (4, True)])
def test_streams_of_both_versions_and_scattered_chains(version, scatter):
    rng = random.Random(version)
    streams = {f"S{i}": rng.randbytes(n) for i, n in enumerate((0, 1, 63, 64, 65, 4095, 4096, 5000, 70_000))}
    rows = {r[1]: r[5] for r in ole.stream_rows(b.compound(streams, version, scatter)) if r[2] == 2}
    assert rows == streams


def test_many_fat_sectors():
    data = random.Random(1).randbytes(1_000_000)
    assert ole.CompoundFile(b.compound({"Big": data})).stream("Big") == data


@pytest.mark.parametrize("cut", range(16, 80))
def test_strings_split_anywhere(cut):
    strings = ["plain", "ünï", "Ω wide", ("rich", [(0, 1), (2, 3)]), "", "x" * 100, "я" * 60, "é"]
    found = biff.Workbook(b.workbook([("S", [])], strings, cut=cut)).strings
    assert [s[0] for s in found] == [s[0] if isinstance(s, tuple) else s for s in strings]
    assert found[3][1] == [(0, 1), (2, 3)]


def test_packed_numbers(spark):
    values = [0.0, 1.0, -1.0, 123456.0, -536870912.0, 536870911.0, 0.5, -2.25, 1e100, 1.0e-5]
    packed = [(b.rk(v), v) for v in values] + [(b.rk(v, True), v) for v in (0.55, -12.34, 1.0)]
    for raw, v in packed:
        assert math.isclose(biff.rk_number(raw)[0], v, rel_tol=1e-5)
    df = spark.createDataFrame([(raw, biff.rk_number(raw)[0]) for raw, _ in packed], "raw long, want double")
    assert df.where(F.abs(numbers.decode_rk(F.col("raw")) - F.col("want")) > F.abs("want") * 1e-12).count() == 0


def test_every_order_is_packed(spark, tmp_path):
    keys = [None, -7, 0, 1, 499, 8191, 8192, 14999, 123457, (1 << 19) - 1, 1 << 19, (1 << 19) + 1, (1 << 21) - 1, 31_000_003, (1 << 29) - 1, (1 << 29) + 500, 1 << 40]
    orders = [(4 * i + k, key) for i, key in enumerate(keys) for k in range(4)]
    spark.createDataFrame(orders, "o_orderkey long, o_custkey long").write.parquet(f"{tmp_path}/orders.parquet")

    def want(order, key):
        n = key if key is None or order % 4 < 2 else key - 500
        if n is None or not -(1 << 29) <= n < 1 << 29:
            return None
        return n / 100 if order % 2 else float(n)

    rows = catalog.queries()["packed_numbers"](spark, str(tmp_path)).collect()
    assert len(rows) == len(orders) and {r.o_orderkey: r.value for r in rows} == {o: want(o, key) for o, key in orders}


def test_older_workbook_and_code_page(spark):
    book = b.workbook([("Лист", [b.label(0, 0, "Привет", codec="cp1251"), b.number(1, 1, 2.5)])], biff8=False, codepage=1251)
    rows = table(spark, "xls_cells", old=book).orderBy("row_idx").collect()
    assert (rows[0].sheet_name, rows[0].str_val, rows[0].cell_type) == ("Лист", "Привет", "LabelBIFF5") and rows[1].num_val == 2.5


def test_errors_are_rows(spark):
    rng = random.Random(9)
    bad = {f"r{i}": rng.randbytes(rng.randrange(1, 257)) for i in range(40)} | {"cut": golden()[:700], "null": None, "good": golden(), "other": b.compound({"WordDocument": b"x"})}
    out = readers.parse(source(spark, **bad), "xls_cells")
    errors = {r.path: r._error for r in readers.errors(out).collect()}
    assert errors.keys() == bad.keys() - {"good"} and all(e for e in errors.values())
    assert errors["other"] == "xls: no workbook stream" and errors["r0"].startswith("cfb: ")
    assert readers.good(out).select("path").distinct().count() == 1
    assert readers.parse(source(spark, **bad), "xls_cells", "DROPMALFORMED").where("_error IS NOT NULL").count() == 0
    with pytest.raises(Exception, match="cfb: "):
        readers.parse(source(spark, **bad), "xls_cells", "FAILFAST").count()


def test_loops_end(spark):
    data = bytearray(b.compound({"A": b"x" * 5000}))
    # the stream's first sector follows itself
    fat = struct.unpack_from("<I", data, 76)[0]
    struct.pack_into("<I", data, (fat + 1) * 512, 0)
    with pytest.raises(ole.ParseError, match="comes back"):
        list(ole.stream_rows(bytes(data)))


def test_package_round_trip(spark, tmp_path):
    t = lambda name: table(spark, name, book=golden(), two=b.workbook([("A & B", [b.label(0, 27, "<x> & \x01y"), b.number(0, 0, 1e21)])]))
    out = {r.path: bytes(r.content) for r in xlsx.packages(t("xls_cells"), t("xls_sst"), t("xls_sheets")).collect()}
    assert out.keys() == {"book", "two"}
    for data in out.values():
        with zipfile.ZipFile(io.BytesIO(data)) as z:
            assert z.testzip() is None and z.namelist()[0] == "[Content_Types].xml"
            for n in z.namelist():
                xml.dom.minidom.parseString(z.read(n))
    parts = pk.unzipped(source(spark, **out))
    assert pk.broken_relations(parts).count() == 0
    assert pk.missing_parts(parts, ["[Content_Types].xml", "_rels/.rels", "xl/workbook.xml", "xl/sharedStrings.xml", "xl/styles.xml", "xl/worksheets/sheet1.xml"]).count() == 0
    assert pk.missing_parts(parts, ["xl/none.xml"]).count() == 2
    texts = {(r.path, r.text) for r in pk.texts(parts.where("part_name = 'xl/sharedStrings.xml'"), "t").collect()}
    assert ("two", "<x> & y") in texts and ("book", "String 3") in texts
    sheet = parts.where("path = 'two' AND part_name = 'xl/worksheets/sheet1.xml'").first().content.decode()
    assert '<c r="AB1" t="s"><v>0</v></c>' in sheet and "<v>1000000000000000000000</v>" in sheet


def test_save_writes_files_again_under_the_same_name(spark, tmp_path):
    rows = source(spark, **{"dir/a.xls": b"one", "other/a.xls": b"two"})
    for _ in range(2):
        out = [r.file for r in pk.save(rows, str(tmp_path / "out"), ".xlsx").collect()]
    assert len(set(out)) == 2 and sorted(p.read_bytes() for p in (tmp_path / "out").iterdir()) == [b"one", b"two"]


def test_files_through_binary_file(spark, tmp_path):
    for n in ("a.xls", "b.xls"):
        (tmp_path / n).write_bytes(golden())
    (tmp_path / "c.txt").write_bytes(b"no")
    assert readers.good(readers.load(spark, str(tmp_path), "xls_sheets", pattern="*.xls")).count() == 4
    assert readers.good(readers.load(spark, str(tmp_path), "biff_records", pattern="a.xls")).where("rec_type = 2057").count() == 3


def test_what_a_package_lacks_is_told(spark):
    from vellum.plans import convert

    whole = golden()
    at = whole.index(struct.pack("<HBB", 8, 0, ord("S")))  # the length of "String 3" in the table
    broken = whole[:at] + struct.pack("<H", 9000) + whole[at + 2 :]
    rows = {r.path: r for r in convert.xls_to_xlsx(source(spark, whole=whole, broken=broken, bad=b"x")).collect()}
    assert rows["whole"].content and rows["whole"]._error is None and rows["whole"]._partial is None
    assert rows["broken"].content and rows["broken"]._error is None and rows["broken"]._partial == "xls_sst: xls: 0 of 1 shared strings can be read"
    assert rows["bad"].content is None and rows["bad"]._error.startswith("cfb: ") and rows["bad"]._partial is None


def test_tables_from_one_read_equal_tables_alone(spark):
    src = source(spark, a=golden(), bad=b"x", none=None)
    names = ("xls_cells", "xls_sst", "xls_sheets", "xls_xf", "xls_formats", "ole_streams")
    both = readers.parse_all(src, names).cache()
    for t in names:
        assert sorted(map(str, readers.of(both, t).collect())) == sorted(map(str, readers.good(readers.parse(src, t)).collect()))
        assert both.where(f"table = '{t}' AND _error IS NOT NULL").count() == 2


def test_formats_in_spark_equal_those_in_python(spark):
    rng = random.Random(9)
    values = [0.125, 0.375, 2.5, 0.5, -0.5, -0.001, 1e14, 1e16, -1e22, 0.005, 1.005, 2.675, 1e-300, 0.0, -0.0, float("inf"), float("nan"), None]
    values += [rng.uniform(-1, 1) * 10 ** rng.randrange(-6, 18) for _ in range(600)] + [round(rng.uniform(0, 1000), 3) for _ in range(600)]
    rows = [(v, p, i) for v in values for p, i in (("0.00%", 164), ("#,##0", 165), ("0.00", 170), ("0", 164), ("0", 3), ("General", 200), (None, 164), ("0%", None))]
    df = spark.createDataFrame([(k, *r) for k, r in enumerate(rows)], "k int, v double, p string, i int")
    got = {r.k: r.x for r in df.select("k", numbers.render(F.col("v"), F.col("p"), F.col("i")).alias("x")).collect()}
    want = {k: None if v is None or v != v else numbers.rendered(v, p, i) for k, (v, p, i) in enumerate(rows)}
    assert [(rows[k], got[k], want[k]) for k in want if got[k] != want[k]] == []
