import io
import random
import struct
import xml.dom.minidom
import zipfile

from vellum.plans import samples as b
from vellum.operators import packages as pk
from vellum.operators import slides as sl
from vellum.plans import convert
from vellum.sources import readers, slides

SCHEME = ["FFFFFF", "000000", "111111", "222222", "333333", "444444", "555555", "666666"]


def source(spark, **files):
    return spark.createDataFrame([(k, bytearray(v)) for k, v in files.items()], "path string, content binary")


def table(spark, name, **files):
    return readers.good(readers.parse(source(spark, **files), name))


def chars(mask, *fields):
    return struct.pack("<I", mask) + b"".join(struct.pack("<H", f) if f < 65536 else struct.pack("<I", f) for f in fields)


def sample():
    style = b.text_style([(6, 0, struct.pack("<IH", 1 << 11, 1)), (7, 1, struct.pack("<I", 0))], [(6, chars(1 | 1 << 17, 1, 40)), (7, chars(1 << 16, 0) + b"")])
    scheme_run = b.text_style([(4, 0, struct.pack("<I", 0))], [(4, struct.pack("<II", 1 << 18, 0x04000000))])
    box = b.shape(202, (100, 200, 500, 400), b.text_box(1, "Hello\rWorld!", style), b.properties(p181=0x00FF8040, p1bf=0x00100010))
    group = b.group((0, 0, 1000, 1000), (0, 0, 100, 100), b.shape(3, (10, 20, 60, 70), child=True))
    picture = b.shape(75, (0, 0, 100, 100), b.properties(p104=1))
    colored = b.shape(1, (0, 0, 8, 8), b.text_box(4, "abc", scheme_run, wide=False))
    title = b.drawing(0xFA3, struct.pack("<H", 1) + struct.pack("<I", 0) + struct.pack("<IH", 1 << 17, 44), 1)
    return b.presentation([[box, group, picture, colored], []], [[b.shape(1, (0, 0, 10, 10))]], ["Arial"], [[], [b.drawing(0xF9F, struct.pack("<I", 0)), b.drawing(0xFA8, b"Listed & more")]], [b.picture("PNG", b"png")], SCHEME, title, b.properties(p181=0x08000005))


def test_newest_edit_wins_and_chains_end(spark):
    d = bytearray(sample())
    rows = table(spark, "ppt_persist", d=bytes(d)).collect()
    assert {r.persist_id for r in rows} == {1, 10, 11, 100} and {r.edit_seq for r in rows} == {0}
    p = slides.Presentation(bytes(d))
    at = struct.unpack_from("<I", p.user, 16)[0]
    p.data = bytearray(p.data)
    struct.pack_into("<I", p.data, at + 16, at)  # the edit before is itself
    assert len(list(p.persist())) == 4


def test_slides_texts_and_positions(spark):
    t = lambda n: table(spark, n, d=sample())
    assert [(r.slide_idx, r.text) for r in t("ppt_texts").orderBy("slide_idx", "text_idx").collect()] == [(0, "Hello\rWorld!"), (0, "abc"), (1, "Listed & more")]
    rows = {r.shape_type: r for r in sl.placed(t("ppt_shapes")).where("owner_kind = 'slide'").collect()}
    box = rows[202]
    assert (box.x, box.y, box.cx, box.cy) == tuple(v * 12700 // 8 for v in (100, 200, 400, 200)) and box.fill_color == "4080FF" and box.no_fill is False
    assert (rows[3].x, rows[3].y, rows[3].cx, rows[3].cy) == tuple(v * 12700 // 8 for v in (100, 200, 500, 500))
    assert rows[75].image_idx == 0
    assert [(r.width, r.height, r.n_slides, r.n_masters, r.fonts) for r in t("ppt_presentations").collect()] == [(5760, 4320, 2, 1, ["Arial"])]


def test_runs_take_masters_styles_and_schemes(spark):
    t = lambda n: table(spark, n, d=sample())
    scheme = sl.schemes(t("ppt_slides"), t("ppt_schemes"))
    rows = sl.styled(t("ppt_runs"), t("ppt_shapes"), t("ppt_slides"), scheme, t("ppt_master_styles")).orderBy("z", "para_idx", "run_idx").collect()
    assert [(r.text, r.font_size, r.bold, r.alignment, r.level) for r in rows][:2] == [("Hello", 40, True, 1, 0), ("World!", 44, None, None, 1)]
    assert rows[1].font_name == "Arial" and rows[2].text == "abc" and rows[2].color == "333333"
    assert [r.slide_idx for r in sl.empty_slides(t("ppt_slides"), t("ppt_runs")).collect()] == [1]
    assert [(r.layout_idx) for r in sl.layouts(t("ppt_slides")).collect()] == [0]


def test_own_paths():
    points = struct.pack("<HHH", 2, 2, 0xFFF0) + struct.pack("<hhhh", 1, 2, -3, 4)
    steps = struct.pack("<HHH", 2, 2, 2) + struct.pack("<HH", 0x4000, 0x2001)
    body = struct.pack("<HIHI", 0x8145, len(points), 0x8146, len(steps)) + points + steps
    d = b.presentation([[b.shape(0, (0, 0, 9, 9), b.drawing(0xF00B, body, 2))]])
    (row,) = slides.TABLES["ppt_geometry"][1](d)
    assert row[3:5] == (21600, 21600) and row[5] == [{"x": 1, "y": 2}, {"x": -3, "y": 4}] and row[6] == [{"seg_type": 2, "count": 0}, {"seg_type": 1, "count": 1}]


def test_path_and_line_xml(spark):
    from vellum.sinks import pptx

    xy = [{"x": x, "y": y} for x, y in ((0, 0), (10, 0), (10, 10), (1, 1), (2, 2), (3, 3))]
    steps = [{"seg_type": t, "count": n} for t, n in ((2, 0), (0, 2), (1, 1), (3, 0), (4, 0))]
    text = pptx.path_of(100, 50, xy, steps)
    assert text == '<a:custGeom><a:avLst/><a:rect l="0" t="0" r="r" b="b"/><a:pathLst><a:path w="100" h="50"><a:moveTo><a:pt x="0" y="0"/></a:moveTo><a:lnTo><a:pt x="10" y="0"/></a:lnTo><a:lnTo><a:pt x="10" y="10"/></a:lnTo><a:cubicBezTo><a:pt x="1" y="1"/><a:pt x="2" y="2"/><a:pt x="3" y="3"/></a:cubicBezTo><a:close/></a:path></a:pathLst></a:custGeom>'
    assert "<a:lnTo>" in pptx.path_of(1, 1, xy, []) and pptx.path_of(1, 1, [], steps) is None
    assert pptx.path_of(1, 1, xy[:1], steps).count("<a:pt ") == 1
    points = struct.pack("<HHH", 2, 2, 0xFFF0) + struct.pack("<hhhh", 1, 2, 3, 4)
    body = struct.pack("<HI", 0x1C0, 0) + struct.pack("<HI", 0x1CE, 6) + struct.pack("<HI", 0x1D1, 1) + struct.pack("<HI", 0x8145, len(points)) + points
    d = b.presentation([[b.shape(0, (0, 0, 9, 9), b.drawing(0xF00B, body, 4))]])
    data = bytes(convert.ppt_to_pptx(source(spark, d=d)).first().content)
    with zipfile.ZipFile(io.BytesIO(data)) as z:
        slide = z.read("ppt/slides/slide1.xml").decode()
    xml.dom.minidom.parseString(slide)
    assert "<a:custGeom>" in slide and '<a:prstDash val="dash"/>' in slide and '<a:tailEnd type="triangle"/>' in slide


def test_styled_lines_cover_the_text():
    rng = random.Random(1)
    for _ in range(300):
        text = "".join(rng.choice("ab\r\n ") for _ in range(rng.randrange(12)))
        cuts = [(rng.randrange(1, 6), {"bold": bool(i % 2)}) for i in range(rng.randrange(4))]
        rows = list(slides.styled_lines(text, [], cuts, []))
        lines = {}
        for k, _, t, *_ in rows:
            lines[k] = lines.get(k, "") + t
        want = text.replace("\r\n", "\n").replace("\r", "\n").split("\n")
        if len(want) > 1 and want[-1] == "":
            want.pop()
        assert list(lines.values()) == want


def test_package(spark):
    rng = random.Random(2)
    files = {"d": sample(), "bad": rng.randbytes(100), "none": b.compound({"PowerPoint Document": b"xx", "Current User": b""})}
    rows = {r.path: r for r in convert.ppt_to_pptx(source(spark, **files)).collect()}
    assert rows["bad"]._error.startswith("cfb: ") and rows["none"]._error.startswith("ppt: ") and rows["d"]._error is None
    data = bytes(rows["d"].content)
    with zipfile.ZipFile(io.BytesIO(data)) as z:
        for n in z.namelist():
            if n.endswith((".xml", ".rels")):
                xml.dom.minidom.parseString(z.read(n))
        assert z.read("ppt/media/image1.png") == b"png"
        slide = z.read("ppt/slides/slide1.xml").decode()
    parts = pk.unzipped(source(spark, d=data))
    assert pk.broken_relations(parts).count() == 0
    texts = [r.text for r in pk.texts(parts.where("part_name LIKE 'ppt/slides/slide%.xml'"), "a:t").orderBy("part_name", "idx").collect()]
    assert texts == ["Hello", "World!", "abc", "Listed & more"]
    assert '<p:bg><p:bgPr><a:solidFill><a:srgbClr val="444444"/>' in slide
    assert 'prst="ellipse"' in slide and "<p:pic>" in slide and 'val="4080FF"' in slide and 'sz="4400"' in slide


def test_random_records_end_as_errors_or_rows(spark):
    rng = random.Random(3)
    files = {f"r{i}": b.compound({"PowerPoint Document": rng.randbytes(500), "Current User": rng.randbytes(40)}) for i in range(20)}
    for n in ("ppt_shapes", "ppt_records", "ppt_images"):
        assert readers.parse(source(spark, **files), n).select("path").distinct().count() == 20


def test_presets_beyond_type_100(spark):
    from pyspark.sql import functions as F

    from vellum.sinks import pptx

    want = {100: "flowChartMultidocument", 101: "flowChartMerge", 104: "flowChartMagneticTape", 112: "callout3", 113: "rect", 116: "accentCallout2", 122: "blockArc", 183: "leftBrace", 186: "rightBracket", 202: "rect"}
    rows = spark.createDataFrame([(k,) for k in want], "k int").select("k", pptx._map(pptx.PRESETS, F.col("k"), "rect").alias("v")).collect()
    assert {r.k: r.v for r in rows} == want
    kinds = {*range(101, 113), *range(114, 117), *range(120, 123), *range(183, 187), 202}
    assert kinds <= pptx.PRESETS.keys()


def _parts_of(spark, data):
    row = convert.ppt_to_pptx(source(spark, d=data)).first()
    assert row._error is None and row._partial is None
    with zipfile.ZipFile(io.BytesIO(bytes(row.content))) as z:
        out = {n: z.read(n).decode() for n in z.namelist() if n.endswith((".xml", ".rels"))}
    for text in out.values():
        xml.dom.minidom.parseString(text)
    assert pk.broken_relations(pk.unzipped(source(spark, d=bytes(row.content)))).count() == 0
    return out


def test_masters_become_layouts_with_pictures_watermarks_and_title_grounds(spark):
    hint = b.shape(1, (0, 0, 100, 100), b.text_box(1, "Click to edit Master title"))
    line = b.shape(20, (0, 1000, 5000, 1000))
    full = b.shape(75, (0, 0, 5760, 4320), b.properties(p104=1))
    mark = b.shape(75, (100, 3500, 400, 4200), b.properties(p104=2))
    logo = b.shape(75, (100, 100, 400, 400), b.properties(p104=2))
    white = chars(1 | 1 << 17 | 1 << 18, 1, 30) + struct.pack("<I", 0xFE203040)
    title = b.text_style([(6, 0, struct.pack("<I", 0))], [(6, white)])
    head = b.shape(202, (10, 10, 2000, 500), b.text_box(0, "Title", title))
    scheme = ["FFFFFF", "102030", *SCHEME[2:]]
    data = b.presentation([[head], [b.shape(3, (0, 2000, 90, 2090))]], [[hint, line, full, mark, logo]], ["Arial"], pictures=[b.picture("PNG", b"one"), b.picture("JPEG", b"two")], scheme=scheme)
    out = _parts_of(spark, data)
    layout, slide = out["ppt/slideLayouts/slideLayout1.xml"], out["ppt/slides/slide1.xml"]
    assert "Click to edit" not in "".join(out.values())
    assert 'r:embed="rIdImg1"' in layout.split("</p:bg>")[0] and layout.count("<p:pic>") == 1 and layout.count("<p:cxnSp>") == 1
    assert slide.count("<p:pic>") == 1 and slide.index("<p:pic>") < slide.index("Title")  # the watermark lies below
    assert all(f"image{k}" in out["ppt/slideLayouts/_rels/slideLayout1.xml.rels"] for k in (1, 2)) and "image2" in out["ppt/slides/_rels/slide2.xml.rels"]
    assert "ppt/slideLayouts/slideLayout2.xml" not in out


def test_white_titles_name_the_ground_of_their_layout(spark):
    line = b.shape(20, (0, 1000, 5000, 1000))
    style = b.text_style([(6, 0, struct.pack("<I", 0))], [(6, chars(1 | 1 << 17 | 1 << 18, 1, 30) + struct.pack("<I", 0xFEFFFFFF))])
    head = b.shape(202, (10, 10, 2000, 500), b.text_box(0, "Title", style))
    out = _parts_of(spark, b.presentation([[head]], [[line]], ["Arial"], scheme=["FFFFFF", "102030", *SCHEME[2:]]))
    layout = out["ppt/slideLayouts/slideLayout1.xml"]
    assert "Title ground" in layout and f'cy="{1000 * 12700 // 8}"' in layout and 'val="FFFFFF"' in layout
    assert '<a:srgbClr val="FFFFFF"/>' in out["ppt/slides/slide1.xml"]


def test_sizes_fonts_and_spacing_of_texts_without(spark):
    from pyspark.sql import functions as F

    rows = [(0, 0, "given", 20, "Arial", None), (0, 1, "late", None, None, None), (1, 0, "nothing at all is given here and the text is long enough to wrap", None, None, None), (2, 0, "tiny", None, None, 300), (3, 0, "", None, "", None), (3, 1, "b", 9, "Calibri", None)]
    runs = spark.createDataFrame([("d", "slide", 0, z, p, 0, t, s, f, sp) for z, p, t, s, f, sp in rows], "path string, owner_kind string, owner_id long, z int, para_idx int, run_idx int, text string, font_size int, font_name string, line_spacing int")
    boxes = [(0, 10**6, 10**6), (1, 10**6, 10**6), (2, 10**6, 250_000), (3, 0, 0)]
    shapes = spark.createDataFrame([("d", "slide", 0, z, cx, cy) for z, cx, cy in boxes], "path string, owner_kind string, owner_id long, z int, cx long, cy long")
    shapes = shapes.select("*", F.lit(None).cast("string").alias("fill_color"), F.lit(None).cast("boolean").alias("no_fill"), *[F.lit(None).cast("long").alias(f"inset_{c}") for c in ("left", "top", "right", "bottom")])
    got = {(r.z, r.para_idx): (r.font_size, r.font_name) for r in sl.sized(runs, shapes).collect()}

    def largest(text, cx, cy, most, spacing=1.0):
        w, h = (cx - 182_880, cy - 91_440) if cy >= 500_000 else (cx - 50_800, cy - 25_400)
        for size in (20, 18, 16, 14, 12, 11, 10, 9, 8, 7, 6):
            per = max(1, int(w / (size * 12700 * 0.85)))
            if size <= most and max(1, -(-len(text) // per)) * size * 12700 * (spacing if spacing > 1 else 1.2) <= h:
                return size
        return 6

    assert got[0, 0] == got[0, 1] == (20, "Arial") and got[3, 0] == got[3, 1] == (9, "Calibri")
    assert got[1, 0] == (largest(rows[2][2], 10**6, 10**6, 20), sl.FONT) and got[2, 0] == (largest("tiny", 10**6, 250_000, 14, 3.0), sl.FONT)


def test_colors_that_show(spark):
    from pyspark.sql import functions as F

    s = ["FFFFFF", "101010"]
    cases = [  # color, raw, fill, filled, dark behind, picture behind, scheme, in title, what shows
        (None, 0, None, False, False, False, s, False, "101010"), (None, 0, "000080", True, False, False, s, False, "FFFFFF"), ("AA0000", 0, None, False, True, False, s, False, "FFFFFF"),
        (None, 0, None, False, False, True, s, False, "FFFFFF"), (None, 0, None, False, False, False, s, True, "FFFFFF"), (None, 0, None, False, False, False, [], False, None),
        ("FFFFFF", 0xFE000000, None, False, False, False, s, False, "101010"), ("FFFFFF", 0xFE000000, "FFD966", True, False, False, s, False, "FFFFFF"), ("FFFFFF", 0x08000000, "E9EBF5", True, False, False, s, False, "101010"),
        ("FFFFFF", 0xFE000000, None, False, True, False, s, False, "FFFFFF"), ("FFFFFF", 0xFE000000, None, False, False, True, s, False, "FFFFFF"), ("111111", 0xFE111111, "000000", True, False, False, s, False, "FFFFFF"),
        ("FFD966", 0xFE66D9FF, "FFD966", True, False, False, s, False, "101010"), ("000000", 0xFE000001, None, False, True, False, s, False, "FFFFFF"), ("FF0000", 0xFE0000FF, None, False, True, False, s, False, "FF0000"),
        ("FFFFFF", 0xFEFFFFFF, None, False, False, False, s, False, "101010"), ("FFFFFF", 0xFEFFFFFF, None, False, False, False, s, True, "FFFFFF"), ("FEFEFE", 0xFEFEFEFE, "E9EBF5", True, False, False, s, False, "101010"),
        ("FEFEFE", 0xFEFEFEFE, "E9EBF5", True, False, False, [], False, "000000"), ("003296", 0xFE963200, None, False, False, False, s, False, "003296"),
    ]
    df = spark.createDataFrame([(i, *c) for i, c in enumerate(cases)], "i int, t string, raw long, fill string, filled boolean, dark boolean, image boolean, scheme array<string>, title boolean, want string")
    rows = df.select("i", "want", sl.visible_color(*[F.col(c) for c in ("t", "raw", "fill", "filled", "dark", "image", "scheme", "title")]).alias("got")).collect()
    assert [(r.i, r.got) for r in rows if r.got != r.want] == []


def test_frames_arrows_and_bodies(spark):
    turned = b.shape(3, (100, 100, 300, 200), b.properties(p4=90 << 16))
    arrow = b.shape(32, (0, 0, 400, 0), b.properties(p1c0=0, p1d0=1, p1d1=2, p1d2=0, p1d3=2, p1d5=1))
    box = b.shape(202, (0, 0, 800, 800), b.text_box(1, "x"), b.properties(p81=1000, p84=0, p85=0, p87=4))
    bare = b.shape(20, (0, 0, 400, 0))
    slide = _parts_of(spark, b.presentation([[turned, arrow, box, bare]]))["ppt/slides/slide1.xml"]
    emu = lambda v: v * 12700 // 8
    assert f'rot="5400000"><a:off x="{emu(100) + emu(200) // 2 - emu(100) // 2}" y="{emu(100) + emu(100) // 2 - emu(200) // 2}"/><a:ext cx="{emu(100)}" cy="{emu(200)}"/>' in slide
    assert '<a:headEnd type="triangle" w="sm" len="lg"/><a:tailEnd type="stealth" len="med"/>' in slide
    assert '<a:bodyPr lIns="1000" bIns="0" anchor="ctr" anchorCtr="1" wrap="none"><a:normAutofit/></a:bodyPr>' in slide
    assert slide.count('<a:ln><a:solidFill><a:srgbClr val="000000"/></a:solidFill></a:ln>') == 1


def test_plain_packages(spark):
    row = convert.ppt_to_pptx(source(spark, d=sample()), plain=True).first()
    parts = pk.unzipped(source(spark, d=bytes(row.content)))
    assert pk.broken_relations(parts).count() == 0
    slides_ = parts.where("part_name LIKE 'ppt/slides/slide%.xml'")
    assert [r.text for r in pk.texts(slides_, "a:t").orderBy("part_name", "idx").collect()] == ["Hello", "World!", "abc", "Listed & more"]
    assert not [r for r in slides_.collect() if b"<p:pic>" in bytes(r.content)]


def plan(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_the_plan_of_packages_holds_what_they_share_once(spark):
    # the driver plans and compiles this: 322,861 characters when every kind of part held all of it
    assert len(plan(convert.ppt_to_pptx(source(spark, d=sample())))) < 40_000


def test_texts_are_sized_and_colored_by_small_expressions(spark):
    from pyspark.sql import functions as F

    c = {"text": "string", "raw": "long", "fill": "string", "filled": "boolean", "dark": "boolean", "image": "boolean", "scheme": "array<string>", "title": "boolean"}
    df = spark.createDataFrame([], ", ".join(f"{k} {v}" for k, v in c.items()))
    assert len(plan(df.select(sl.visible_color(*map(F.col, c)).alias("ink")))) < 10_000
    t = dict(zip(convert.PPT_TABLES, (table(spark, n, d=sample()) for n in convert.PPT_TABLES)))
    runs = t["ppt_runs"].withColumn("color", F.lit(None).cast("string"))
    assert len(plan(sl.sized(runs, sl.placed(t["ppt_shapes"])))) < 25_000
