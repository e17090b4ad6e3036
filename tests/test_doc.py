import io
import random
import struct
import xml.dom.minidom
import zipfile

import pytest
from pyspark.sql import functions as F

from vellum.plans import samples as b
from vellum.operators import document as dm
from vellum.operators import packages as pk
from vellum.plans import convert

from vellum.sources import ole, readers, word


def source(spark, **files):
    return spark.createDataFrame([(k, bytearray(v)) for k, v in files.items()], "path string, content binary")


def tables(spark, *names, **files):
    src = source(spark, **files)
    return [readers.good(readers.parse(src, n)) for n in names]


def paras(spark, **files):
    t = dict(zip(convert.DOC_TABLES, tables(spark, *convert.DOC_TABLES, **files)))
    return dm.paragraphs(t["doc_text"], t["doc_para_runs"], t["doc_styles"], t["doc_lists"], t["doc_list_overrides"], t["doc_sections"]), t


STYLES = [b.style("Normal", 0, chars=b.sprm(0x4A43, 24) + b.sprm(0x4A4F, 0)), b.style("heading 1", 1, 0, paras=b.sprm(0x2461, 1) + b.sprm(0xA413, 240), chars=b.sprm(0x0835, 1)), b.style("toc 1", 19, 0), b.style("Strong", 90, kind=2, chars=b.sprm(0x0835, 1))]


def test_text_of_mixed_pieces_and_code_pages():
    d = word.Document(b.document([("Plain é", False), ("広いテキスト", True), (" end\r", False)]))
    assert d.text == "Plain é広いテキスト end\r" and [p[3] for p in d.pieces] == [False, True, False]
    with pytest.raises(ole.ParseError, match="doc: no WordDocument"):
        word.Document(b.compound({"X": b"1"}))


def test_property_runs_decode():
    props = b.sprm(0x2461, 1) + b.sprm(0x845E, 720) + b.sprm(0x845D, 360) + b.sprm(0x8460, -240) + b.sprm(0xA413, 120) + b.sprm(0xA414, 60) + b.sprm(0x6412, 240 | 1 << 16) + b.sprm(0xD608, bytes([2]) + struct.pack("<3h", 0, 1000, 2500)) + b.sprm(0x2416, 1)
    assert word.para_props(b.sprm(0x9999, 5) + props) == {"alignment": 1, "indent_left": 720, "indent_right": 360, "indent_first": -240, "space_before": 120, "space_after": 60, "line_spacing": 240, "line_rule": 0, "cell_widths": [1000, 1500], "in_table": True}
    assert word.para_props(b.sprm(0x6412, -200 & 0xFFFF)) == {"line_spacing": 200, "line_rule": 2}
    assert word.char_props(b.sprm(0x6870, 0x332211) + b.sprm(0x2A3E, 3) + b.sprm(0x4A4F, 7), ["A"]) == {"color": "112233", "underline": 3, "font_name": "font7"}
    rng = random.Random(2)
    for _ in range(200):
        word.para_props(rng.randbytes(rng.randrange(40)))


@pytest.fixture(scope="module")
def sample():
    text = "Title\rBody text here\rItem\rA\x07B\x07\x07C\x07D\x07\x07Last\x0c\r"
    at = lambda s: text.index(s)
    para = [(0, 6, (1, b"")), (6, 21, (0, b.sprm(0x2461, 3))), (21, 26, (0, b.sprm(0x460B, 1)))]
    a, c, last = at("A"), at("C"), at("Last")
    row = b.sprm(0x2416, 1) + b.sprm(0x2417, 1) + b.sprm(0xD608, bytes([2]) + struct.pack("<3h", 0, 900, 2000))
    para += [(a, a + 2, (0, b.sprm(0x2416, 1))), (a + 2, a + 4, (0, b.sprm(0x2416, 1))), (a + 4, a + 5, (0, row)), (c, c + 2, (0, b.sprm(0x2416, 1))), (c + 2, c + 4, (0, b.sprm(0x2416, 1))), (c + 4, c + 5, (0, row)), (last, len(text), (0, b""))]
    chars = [(6, 11, b.sprm(0x0836, 1)), (11, 16, b.sprm(0x2A42, 6) + b.sprm(0x4A43, 40))]
    return b.document([text], chars, para, STYLES, ["Arial"], [(100, 0, "\0."), (200, 23, "•")], [200, 100], [(6, b.sprm(0x3009, 2)), (len(text), b"")], ["even\r", "Top \x13 PAGE \x14" + "1\x15\r", "", "Foot\r"])


def test_paragraphs_styles_lists_tables(spark, sample):
    out, _ = paras(spark, d=sample)
    rows = out.orderBy("para_idx").collect()
    assert [r.text for r in rows] == ["Title", "Body text here", "Item", "A", "B", "", "C", "D", "", "Last\x0c"]
    assert [r.heading_level for r in rows] == [1] + [0] * 9
    assert [r.alignment for r in rows[:3]] == [1, 3, None] and rows[0].space_before == 240
    assert [r.list_item for r in rows] == [False, False, True] + [False] * 7 and rows[2].nfc == 23 and not rows[2].ordered
    assert [r.in_table for r in rows] == [False] * 3 + [True] * 6 + [False]
    assert [r.para_idx for r in rows if r.row_end] == [5, 8] and rows[5].cell_widths == [900, 1100]
    assert rows[9].page_break and [r.para_idx for r in rows if r.section_break] == [0]
    assert [r.cp_start for r in rows] == [0, 6, 21, 26, 28, 30, 31, 33, 35, 36]


def test_runs_are_clipped_filled_and_merged(spark, sample):
    out, t = paras(spark, d=sample)
    rows = dm.runs(out, t["doc_char_runs"]).orderBy("para_idx", "run_idx").collect()
    body = [(r.text, r.italic, r.color, r.font_size, r.font_name, r.bold) for r in rows if r.para_idx == 1]
    assert body == [("Body ", True, None, 24, "Arial", False), ("text ", False, "FF0000", 40, "Arial", False), ("here", False, None, 24, "Arial", False)]
    title = next(r for r in rows if r.para_idx == 0)
    assert title.bold and title.text == "Title" and title.font_size == 24
    assert [r.text for r in rows if r.para_idx in (5, 9)] == ["", "Last"]


def test_fields_over_runs_and_overlapping_runs(spark):
    text = "see \x13 HYPERLINK x \x14the\x13IN\x14ner\x15\x15 end\r"
    chars = [(0, 12, b.sprm(0x0835, 1)), (8, len(text), b.sprm(0x0836, 1))]
    out, t = paras(spark, d=b.document([text], chars))
    rows = dm.runs(out, t["doc_char_runs"]).orderBy("run_idx").collect()
    assert "".join(r.text for r in rows) == "see thener end" and [(r.text, r.bold, r.italic) for r in rows][0] == ("see ", True, False)


def test_style_chains_stop_at_loops(spark):
    styles = [b.style("a", 0, 1, chars=b.sprm(0x4A43, 30)), b.style("b", 0, 2), b.style("c", 0, 0, paras=b.sprm(0x845E, 5)), b.style("d", 0, 99, paras=b.sprm(0x6412, 300 | 1 << 16))]
    table, = tables(spark, "doc_styles", d=b.document(["x\r"], styles=styles))
    got = {r.name: (r.font_size, r.indent_left, r.line_spacing) for r in dm.styles(table).collect()}
    assert got == {"a": (30, 5, None), "b": (30, 5, None), "c": (30, 5, None), "d": (None, None, 300)}


def test_missing_row_ends_are_set(spark):
    text = "a\x07b\x07\x07c\x07d\x07\x07e\x07f\x07\x07"
    cell, row = b.sprm(0x2416, 1), b.sprm(0x2416, 1) + b.sprm(0x2417, 1)
    runs = [(i, j, (0, p)) for i, j, p in [(0, 2, cell), (2, 4, cell), (4, 5, row), (5, 7, cell), (7, 9, cell), (9, 10, row), (10, 12, cell), (12, 14, cell), (14, 15, cell)]]
    out, _ = paras(spark, d=b.document([text], [], runs))
    assert [r.para_idx for r in out.orderBy("para_idx").collect() if r.row_end] == [2, 5]
    assert [r.para_idx for r in dm.repaired_tables(out).orderBy("para_idx").collect() if r.row_end] == [2, 5, 8]


def test_stories_sections_pictures(spark, sample):
    stories, sections, fonts = tables(spark, "doc_stories", "doc_sections", "doc_fonts", d=sample)
    assert [(r.kind, r.story_type, r.text) for r in dm.stories(stories).orderBy("story_idx").collect()] == [("header", "even", "even"), ("header", "default", "Top 1"), ("footer", "default", "Foot")]
    assert [r.bkc for r in sections.orderBy("section_idx").collect()] == [2, 2] and fonts.first().name == "Arial"
    data = b.picture("PNG", b"png!") + b.drawing(0xF01E, b"x", 0x6E0) + b.picture("EMF", b"emf data", True) + b.picture("TIFF", b"t")
    images, = tables(spark, "doc_images", d=b.document(["x\r"], pictures=data))
    assert [(r.format, bytes(r.data)) for r in images.orderBy("image_idx").collect()] == [("PNG", b"png!"), ("EMF", b"emf data"), ("TIFF", b"t")]


def test_layout_rules(spark):
    rows = [("", 0)] * 12 + [("cover", 0)] + [("", 0)] * 5 + [("second", 0)] + [("", 0)] * 3 + [("Head", 1)] + [("", 0)] * 4 + [("body", 0), ("", 0), ("Next", 1)]
    df = spark.createDataFrame([("p", i, t, h) for i, (t, h) in enumerate(rows)], "path string, para_idx int, text string, heading_level int")
    none = {c: F.lit(False) for c in ("section_break", "page_break", "page_break_before", "in_table", "list_item", "ordered")}
    df = df.withColumns({**none, "toc_level": F.lit(0), "ilfo": F.lit(0)})
    out = dm.laid_out(df).orderBy("para_idx").collect()
    kept = [(r.text, r.break_before) for r in out if not r.skip]
    assert kept == [("", False), ("cover", False), ("second", True), ("", False), ("Head", False), ("", False), ("body", False), ("Next", False)]


def test_package(spark, sample):
    png = b.picture("PNG", b"\x89PNG....")
    src = source(spark, d=sample, e=b.document(["One & <two>\r", ("thréé\r", False)], pictures=png), broken=b"nothing")
    out = convert.doc_to_docx(src)
    rows = {r.path: r for r in out.collect()}
    assert rows.keys() == {"d", "e", "broken"} and rows["broken"].content is None and rows["broken"]._error.startswith("cfb: ")
    parts = pk.unzipped(source(spark, d=bytes(rows["d"].content), e=bytes(rows["e"].content)))
    assert pk.broken_relations(parts).count() == 0
    for n in ("d", "e"):
        with zipfile.ZipFile(io.BytesIO(bytes(rows[n].content))) as z:
            for name in z.namelist():
                if name.endswith((".xml", ".rels")):
                    xml.dom.minidom.parseString(z.read(name))
    texts = pk.texts(parts.where("part_name = 'word/document.xml'"), "w:t").orderBy("path", "idx").collect()
    assert [t.text for t in texts if t.path == "e"] == ["One & <two>", "thréé"]
    assert "".join(t.text for t in texts if t.path == "d") == "TitleBody text hereItemABCDLast"
    body = parts.where("path = 'd' AND part_name = 'word/document.xml'").first().content.decode()
    assert body.count("<w:tr>") == 2 and body.count("<w:tc>") == 4 and 'w:val="Heading1"' in body and "<w:numPr>" in body and 'w:w="900"' in body
    media = parts.where("part_name LIKE 'word/media/%'").collect()
    assert [(m.path, bytes(m.content)) for m in media] == [("e", b"\x89PNG....")] and parts.where("path = 'e' AND part_name = 'word/document.xml'").first().content.decode().count("<w:drawing>") == 1



def test_random_bytes_end_as_errors(spark):
    rng = random.Random(5)
    bad = {f"r{i}": b.compound({"WordDocument": rng.randbytes(rng.randrange(1, 3000)), "0Table": rng.randbytes(300), "1Table": rng.randbytes(300)}) for i in range(20)}
    bad |= {f"s{i}": b.compound({"WordDocument": b"\xec\xa5\xc1\0" + rng.randbytes(2000), "0Table": rng.randbytes(300), "1Table": rng.randbytes(300)}) for i in range(20)}
    for name in ("doc_text", "doc_para_runs", "doc_lists", "doc_images"):
        out = readers.parse(source(spark, **bad), name)
        assert out.where("_error IS NOT NULL").count() >= 20


def test_pictures_and_boxes_find_their_place(spark):
    paras = spark.createDataFrame([("p", 0, "a\x08b", 0, 3), ("p", 1, "\x08\x08", 4, 6), ("p", 2, "end", 7, 10)], "path string, para_idx int, text string, cp_start long, cp_end long")
    spa = spark.createDataFrame([("p", "main", c, s) for c, s in ((1, 11), (4, 12), (5, 13), (8, 14))], "path string, story string, cp long, spid long")
    pics = spark.createDataFrame([("p", 11, 5, 1), ("p", 11, 3, 0), ("p", 13, 4, 0)], "path string, spid long, image_idx int, source int")
    slots = dm.shape_slots(spa, pics)
    drawn = dm.drawn_pictures(paras, slots)
    assert sorted((r.para_idx, r.image_idx) for r in drawn.collect()) == [(0, 3), (1, 4)]
    boxes = spark.createDataFrame([("p", 0, "first\r"), ("p", 1, "second\r")], "path string, box_idx int, raw_text string")
    assert {(r.para_idx, r.text.strip()) for r in dm.boxes_at(paras, boxes, slots).collect()} == {(1, "first"), (2, "second")}
    images = spark.createDataFrame([("p", 3, bytearray(b"xx")), ("p", 4, bytearray(b"yyyy"))], "path string, image_idx int, data binary")
    many = spark.createDataFrame([("p", 0, 1, 3), ("p", 0, 2, 4)], "path string, para_idx int, ord int, image_idx int")
    assert [tuple(r) for r in dm.largest_picture(many, images).select("para_idx", "image_idx").collect()] == [(0, 4)]
    stories = spark.createDataFrame([("p", 1, "x\x08")], "path string, story_idx int, raw_text string")
    starts = spark.createDataFrame([("p", 1, 0)], "path string, story_idx int, cp long")
    assert [r.images for r in dm.header_pictures(stories, slots, starts).collect()] == [[3]]


def test_picture_sizes(spark):
    from vellum.functions.images import picture_size, size_of

    png = b"\x89PNG\r\n\x1a\n\0\0\0\rIHDR" + struct.pack(">II", 200, 100) + bytes(5)
    jpeg = b"\xff\xd8\xff\xe0\x00\x04ab\xff\xc0\x00\x0b\x08" + struct.pack(">HH", 50, 80) + bytes(9)
    emf = struct.pack("<II", 1, 100) + bytes(16) + struct.pack("<iiii", 0, 0, 1000, 500) + b" EMF"
    assert size_of(png) == (200 * 9525, 100 * 9525) and size_of(jpeg) == (80 * 9525, 50 * 9525) and size_of(emf) == (360000, 180000)
    dense = png + b"\0\0\0\x09pHYs" + struct.pack(">IIB", 11811, 11811, 1)
    assert size_of(dense) == (200 * 3048, 100 * 3048) and size_of(b"") is None and size_of(b"\xff\xd8") is None and size_of(png[:20]) is None
    df = spark.createDataFrame([(bytearray(png),), (bytearray(b"no"),), (None,)], "d binary")
    assert [r[0].cx for r in df.select(picture_size("d")).collect()] == [1905000, None, None]


def _text_of(spark, content, name):
    with zipfile.ZipFile(io.BytesIO(bytes(content))) as z:
        for n in z.namelist():
            if n.endswith((".xml", ".rels")):
                xml.dom.minidom.parseString(z.read(n))
        return z.read(name).decode()


def test_marks_without_a_place_take_pictures_in_turn(spark):
    runs = spark.createDataFrame([("d", 0, 0, "a\x01b\x01", None), ("d", 1, 0, "\x01", 70), ("d", 2, 0, "x", None), ("d", 2, 1, "\x01", 99), ("e", 0, 0, "\x01", None)], "path string, para_idx int, run_idx int, text string, pic_location long")
    table = spark.createDataFrame([("d", 70, 5), ("d", 71, 6)], "path string, pic_location long, pic_idx int")
    got = [(r.path, r.para_idx, r.image_idx) for r in dm.inline_pictures(runs, table).orderBy("path", "para_idx", "ord").collect()]
    assert got == [("d", 0, 0), ("d", 0, 1), ("d", 1, dm.INLINE + 5), ("d", 2, 3), ("e", 0, 0)]


def test_fields_and_tabs_of_stories(spark):
    from vellum.sinks import docx

    raw = ["Page \x13 PAGE \x14" + "1\x15 of\t\x13 NUMPAGES \x15", "a & b\x14c", ""]
    rows = [r.x for r in spark.createDataFrame(list(enumerate(raw)), "i int, t string").orderBy("i").select(docx.story_xml(F.col("t")).alias("x")).collect()]
    for x in rows:
        xml.dom.minidom.parseString(f'<p xmlns:w="w">{x}</p>')
    assert '<w:fldSimple w:instr=" PAGE "><w:r><w:t xml:space="preserve">1</w:t></w:r></w:fldSimple>' in rows[0] and '<w:fldSimple w:instr=" NUMPAGES "/>' in rows[0] and "<w:tab/>" in rows[0]
    assert "a &amp; bc" in rows[1]


def test_story_texts_once_in_order(spark):
    table = spark.createDataFrame([("d", 3, "header", "even", "B\r"), ("d", 1, "header", "default", "A\r"), ("d", 5, "header", "first", "B"), ("d", 7, "footer", "first", "\r")], "path string, story_idx int, kind string, story_type string, raw_text string")
    assert [(r.kind, r.texts) for r in dm.story_texts(table).collect()] == [("header", ["A", "B"])]
    assert {(r.story_idx, r.cp) for r in dm.story_starts(table).collect()} == {(1, 0), (3, 2), (5, 4), (7, 5)}


def test_header_pictures_boxes_and_used_styles(spark, sample):
    from vellum.sinks import docx

    png = b"\x89PNG\r\n\x1a\n" + bytes(8) + struct.pack(">II", 100, 200) + bytes(20)
    text = lambda content, name: _text_of(spark, content, name)
    whole = convert.doc_to_docx(source(spark, d=sample)).first().content
    styles = text(whole, "word/styles.xml")
    assert 'w:styleId="Heading1"' in styles and "Heading2" not in styles and "TOC1" not in styles
    assert "fldSimple" in text(whole, "word/header2.xml")
    paras_, t = paras(spark, d=sample)
    laid = dm.laid_out(paras_)
    stories = spark.createDataFrame([("d", 0, "header", "first", "", ""), ("d", 1, "footer", "default", "f", "f")], "path string, story_idx int, kind string, story_type string, text string, raw_text string")
    images = spark.createDataFrame([("d", 0, "PNG", bytearray(png)), ("d", 1, "PNG", bytearray(png))], "path string, image_idx int, format string, data binary")
    boxes = spark.createDataFrame([("d", 1, "boxed\n<line>")], "path string, para_idx int, text string")
    placed = spark.createDataFrame([], "path string, para_idx int, ord int, image_idx int")
    pictured = spark.createDataFrame([("d", 0, [1])], "path string, story_idx int, images array<int>")
    parts = docx.parts(laid, dm.runs(laid, t["doc_char_runs"]), stories, images, dm.contents(laid), placed, boxes, pictured)
    content = pk.zipped(parts).first().content
    body, head = text(content, "word/document.xml"), text(content, "word/header1.xml")
    assert 'behindDoc="1"' in head and 'r:embed="rIdImg2"' in head and "image2.png" in text(content, "word/_rels/header1.xml.rels")
    assert body.count("<wp:inline") == 1 and "rIdImg1" in body and "<w:txbxContent><w:p><w:r><w:t" in body and "&lt;line&gt;" in body
    assert pk.broken_relations(pk.unzipped(source(spark, d=bytes(content)))).count() == 0


def test_plain_packages(spark, sample):
    src = source(spark, d=sample, e=b.document(["One & <two>\r", ("thréé\r", False)], pictures=b.picture("PNG", b"\x89PNG....")), broken=b"x")
    rows = {r.path: r for r in convert.doc_to_docx(src, plain=True).collect()}
    assert rows["broken"]._error.startswith("cfb: ") and rows["d"]._error is None
    parts = pk.unzipped(source(spark, d=bytes(rows["d"].content), e=bytes(rows["e"].content)))
    assert pk.broken_relations(parts).count() == 0
    got = pk.texts(parts.where("part_name = 'word/document.xml'"), "w:t").orderBy("path", "idx").collect()
    assert [r.text for r in got if r.path == "e"] == ["One & <two>", "thréé"] and "".join(r.text for r in got if r.path == "d") == "TitleBody text hereItemABCDLast"
    assert _text_of(spark, rows["e"].content, "word/document.xml").count("<w:drawing>") == 1
