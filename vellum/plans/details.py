"""Smaller operators of documents and slides over the tables, and what the
conversions write of them."""

from __future__ import annotations

import struct

from pyspark.sql import Window
from pyspark.sql import functions as F

from vellum.functions import images, numbers
from vellum.functions import text as tx
from vellum.operators import audit, tables
from vellum.operators import document as dm
from vellum.operators import packages as pk
from vellum.operators import slides as sl
from vellum.plans import convert, legacy, samples
from vellum.plans.legacy import _SLIDES, _TURNS, DECK, files_of
from vellum.plans.registry import query, table

# --- classes and facts of rows


@query("""WITH b AS (SELECT p_partkey AS k, (p_partkey * 7919 % 9144000)::BIGINT AS l, (p_partkey * 6101 % 6858000)::BIGINT AS t, (p_partkey * 4999 % 9144000)::BIGINT AS w, (p_partkey * 3571 % 6858000)::BIGINT AS h, p_size % 3 = 0 AS cropped, p_size AS kind FROM part)
SELECT k, kind = 20 OR kind BETWEEN 32 AND 40 AS connector, w * 10 > 64008000 AND h * 10 > 48006000 AS full_page, NOT cropped AND w * 10 <= 36576000 AND t * 2 > 6858000 AND (t + h) * 4 > 20574000 AS watermark FROM b""")
def shape_classes(spark, sf_dir):
    k = F.col("p_partkey")
    at = [(k * a % n).cast("long") for a, n in ((7919, 9144000), (6101, 6858000), (4999, 9144000), (3571, 6858000))]
    page = F.lit(9144000), F.lit(6858000)
    return table(spark, sf_dir, "part").select(k.alias("k"), sl.is_connector(F.col("p_size")).alias("connector"), sl.is_full_page(*at[2:], *page).alias("full_page"), sl.is_watermark(*at, *page, F.col("p_size") % 3 == 0).alias("watermark"))


@query("""WITH c AS (SELECT p_partkey AS k, CASE p_size % 5 WHEN 0 THEN NULL WHEN 1 THEN 'FFFFFF' WHEN 2 THEN '000000' WHEN 3 THEN 'FFD966' ELSE '003296' END AS t, CASE WHEN p_size % 5 = 0 THEN 0 WHEN p_size % 5 = 1 AND p_partkey % 2 = 0 THEN 4261412864 ELSE 4261412865 END AS raw,
 CASE p_partkey % 4 WHEN 0 THEN 'E9EBF5' WHEN 1 THEN 'FFD966' WHEN 2 THEN '000080' ELSE NULL END AS fill, p_partkey % 3 = 0 AS dark, p_partkey % 5 = 0 AS pic, p_partkey % 7 = 0 AS title FROM part),
d AS (SELECT *, fill IS NOT NULL AS filled, coalesce(fill = '000080', false) AS dfill, fill IS NULL AND (dark OR pic) AS behind FROM c),
f AS (SELECT *, CASE WHEN dfill AND t = '003296' THEN 'FFFFFF' WHEN filled AND NOT dfill AND t = fill THEN '101010' WHEN behind AND t = '000000' THEN 'FFFFFF' ELSE t END AS fixed FROM d)
SELECT k, CASE WHEN raw = 0 THEN CASE WHEN dfill OR behind OR (NOT filled AND title) THEN 'FFFFFF' ELSE '101010' END
 WHEN raw = 4261412864 AND t = 'FFFFFF' THEN CASE WHEN dfill OR coalesce(fill = 'FFD966', false) OR behind THEN 'FFFFFF' ELSE '101010' END
 WHEN fixed = 'FFFFFF' AND ((NOT filled AND NOT dark AND NOT pic AND NOT title) OR coalesce(fill = 'E9EBF5', false)) THEN '101010' ELSE fixed END AS shown FROM f""")
def visible_colors(spark, sf_dir):
    """Colors of texts so that they show on what lies behind."""
    k, s = F.col("p_partkey"), F.col("p_size") % 5
    t = F.when(s == 0, None).when(s == 1, "FFFFFF").when(s == 2, "000000").when(s == 3, "FFD966").otherwise("003296")
    raw = F.when(s == 0, 0).when((s == 1) & (k % 2 == 0), 0xFE000000).otherwise(0xFE000001).cast("long")
    fill = F.when(k % 4 == 0, "E9EBF5").when(k % 4 == 1, "FFD966").when(k % 4 == 2, "000080")
    scheme = F.array(F.lit("FFFFFF"), F.lit("101010"))
    return table(spark, sf_dir, "part").select(k.alias("k"), sl.visible_color(t, raw, fill, fill.isNotNull(), k % 3 == 0, k % 5 == 0, scheme, k % 7 == 0).alias("shown"))


@query("""SELECT p_partkey AS k, (p_partkey % 4000 + 1) * 9525::BIGINT AS cx, (p_size + 1) * 9525::BIGINT AS cy FROM part""")
def picture_sizes(spark, sf_dir):
    """Sizes of pictures from their first bytes, put together from rows."""
    four = lambda c: F.unhex(F.lpad(F.hex(c.cast("long")), 8, "0"))
    head = F.unhex(F.lit("89504E470D0A1A0A0000000D49484452"))
    data = F.concat(head, four(F.col("p_partkey") % 4000 + 1), four(F.col("p_size") + 1), F.unhex(F.lit("0806000000")))
    rows = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("k"), images.picture_size(data).alias("s"))
    return rows.select("k", F.col("s.cx").alias("cx"), F.col("s.cy").alias("cy"))


@query("""WITH f AS (SELECT p_partkey AS k, CASE p_size % 5 WHEN 0 THEN 'SimSun' WHEN 1 THEN '黑体' WHEN 2 THEN 'Arial' WHEN 3 THEN '' ELSE 'Bad' || chr(7) END AS name FROM part) SELECT k, p.m IN (0, 1) AS cjk, p.m < 3 AS valid FROM f JOIN (SELECT p_partkey AS k, p_size % 5 AS m FROM part) p USING (k)""")
def font_names(spark, sf_dir):
    m = F.col("p_size") % 5
    name = F.when(m == 0, "SimSun").when(m == 1, "黑体").when(m == 2, "Arial").when(m == 3, "").otherwise("Bad\x07")
    return table(spark, sf_dir, "part").select(F.col("p_partkey").alias("k"), tx.is_cjk_font(name).alias("cjk"), tx.is_font_name(name).alias("valid"))


@query("""SELECT o_orderkey, regexp_replace(o_totalprice::VARCHAR, '\\.0$', '') AS shown, (o_custkey * 1000000000000)::VARCHAR || '0000000000' AS large FROM orders""")
def shortest_texts(spark, sf_dir):
    """Least digits that read back as the same number, never an exponent."""
    rows = table(spark, sf_dir, "orders")
    return rows.select("o_orderkey", numbers.number_text("o_totalprice").alias("shown"), F.when(F.col("o_custkey") == 0, "00000000000").otherwise(numbers.number_text(F.col("o_custkey").cast("double") * 1e22)).alias("large"))


@query("""WITH a AS (SELECT conv_id, count(*) AS n_a FROM conversations WHERE role = 'user' GROUP BY 1), b AS (SELECT conv_id, count(*) AS n_b FROM conversations WHERE role <> 'user' GROUP BY 1)
SELECT conv_id, coalesce(n_a, 0)::BIGINT AS n_a, coalesce(n_b, 0)::BIGINT AS n_b FROM a FULL JOIN b USING (conv_id) WHERE coalesce(n_a, 0) <> coalesce(n_b, 0)""")
def counts_that_differ(spark, sf_dir):
    rows = table(spark, sf_dir, "conversations").select("conv_id", "role")
    return audit.counts_differ(rows.where("role = 'user'"), rows.where("role <> 'user'"), ["conv_id"])


@query("""WITH t AS (SELECT conv_id, turn, split_part(text, '.', 1) AS text, length(trim(split_part(text, '.', 1))) AS n FROM conversations), u AS (SELECT t.*, trim(regexp_replace(text, '\\s+', ' ', 'g')) AS s FROM t WHERE n > 0),
o AS (SELECT conv_id, trim(regexp_replace(CASE turn % 3 WHEN 0 THEN '' WHEN 1 THEN text ELSE 'x ' || text || ' y' END, '\\s+', ' ', 'g')) AS s FROM conversations)
SELECT u.conv_id, u.text FROM u WHERE NOT EXISTS (SELECT 1 FROM o WHERE o.conv_id = u.conv_id AND contains(o.s, u.s))""")
def lost_texts(spark, sf_dir):
    """First sentences that the output of their group lacks."""
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "text")
    first = rows.select("conv_id", F.split_part("text", F.lit("."), F.lit(1)).alias("text"))
    output = rows.select("conv_id", F.when(F.col("turn") % 3 == 0, "").when(F.col("turn") % 3 == 1, F.col("text")).otherwise(F.concat(F.lit("x "), "text", F.lit(" y"))).alias("text"))
    return audit.lost_texts(first, output, ["conv_id"]).select("conv_id", "text")


@query("""SELECT conv_id, turn, text FROM conversations WHERE turn BETWEEN 1 AND 3 AND contains(text, 'the')""")
def texts_in_range(spark, sf_dir):
    return audit.in_range(table(spark, sf_dir, "conversations").select("conv_id", "turn", "text"), "turn", 1, 3, "the")


# --- documents


@query(f"""WITH {_TURNS}, m AS (SELECT path, para_idx, unnest(list_filter(range(length(text)), lambda i: substr(text, (i + 1)::INTEGER, 1) = 'x')) AS place FROM r),
n AS (SELECT *, row_number() OVER (PARTITION BY path ORDER BY para_idx, place) - 1 AS nth FROM m) SELECT path, para_idx, (CASE WHEN para_idx % 2 = 0 THEN 1000000 + para_idx ELSE nth END)::INTEGER AS image_idx, count(*)::BIGINT AS n FROM n GROUP BY ALL""")
def picture_marks(spark, sf_dir):
    """Pictures at the places that runs name, others in the turn of their marks
    in the whole document; the letter x stands for a mark."""
    order = Window.partitionBy("conv_id").orderBy("turn", "role", "text")
    rows = table(spark, sf_dir, "conversations").select(F.concat(F.lit("c"), "conv_id").alias("path"), (F.row_number().over(order) - 1).alias("para_idx"), F.translate("text", "x\n", "\x01 ").alias("text"))
    rows = rows.withColumns({"run_idx": F.lit(0), "pic_location": F.when(F.col("para_idx") % 2 == 0, F.col("para_idx").cast("long"))})
    places = rows.where("pic_location IS NOT NULL").select("path", "pic_location", F.col("para_idx").alias("pic_idx"))
    return dm.inline_pictures(rows, places).groupBy("path", "para_idx", "image_idx").agg(F.count(F.lit(1)).alias("n"))


@query("""WITH s AS (SELECT user_id AS path, event_id AS spid, (event_id * 37 % 1000)::BIGINT AS cp, event_id % 3 <> 0 AS pictured FROM events)
SELECT path, spid, cp, row_number() OVER (PARTITION BY path ORDER BY cp, spid)::INTEGER AS slot, (CASE WHEN pictured THEN spid % 50 END)::INTEGER AS image_idx FROM s""")
def shape_order(spark, sf_dir):
    """Shapes by place, equal places by number, with the picture of the better
    of two sources."""
    k = F.col("event_id")
    rows = table(spark, sf_dir, "events").select(F.col("user_id").alias("path"), k.alias("spid"), (k * 37 % 1000).alias("cp"), F.lit("main").alias("story"))
    pictures = rows.where("spid % 3 <> 0").select("path", "spid", F.explode(F.array(F.struct((F.col("spid") % 50).cast("int").alias("image_idx"), F.lit(0).alias("source")), F.struct(F.lit(99).alias("image_idx"), F.lit(1).alias("source")))).alias("p")).select("path", "spid", "p.*")
    return dm.shape_slots(rows, pictures).select("path", "spid", "cp", "slot", "image_idx")


@query(f"""WITH {_TURNS}, p AS (SELECT path, para_idx, coalesce(sum(length(text) + 1) OVER (PARTITION BY path ORDER BY para_idx ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS s, length(text) AS n FROM r),
b AS (SELECT path, para_idx AS box, s + n // 2 AS cp FROM p) SELECT p.path, p.para_idx, 'box ' || box AS text FROM b JOIN p USING (path) WHERE b.cp >= p.s AND b.cp < p.s + p.n + 1""")
def boxes_in_paragraphs(spark, sf_dir):
    """Text boxes by the paragraph that their shape's place lies in."""
    order = Window.partitionBy("conv_id").orderBy("turn", "role", "text")
    rows = table(spark, sf_dir, "conversations").select(F.concat(F.lit("c"), "conv_id").alias("path"), (F.row_number().over(order) - 1).alias("para_idx"), F.char_length("text").cast("long").alias("n"))
    start = F.coalesce(F.sum(F.col("n") + 1).over(Window.partitionBy("path").orderBy("para_idx").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    paras = rows.withColumn("cp_start", start).withColumn("cp_end", F.col("cp_start") + F.col("n"))
    boxes = paras.select("path", F.col("para_idx").alias("box_idx"), F.concat(F.lit("box "), "para_idx").alias("raw_text"))
    slots = paras.select("path", (F.col("para_idx") + 1).alias("slot"), (F.col("cp_start") + F.floor(F.col("n") / 2)).alias("cp"), F.lit(None).cast("int").alias("image_idx"))
    return dm.boxes_at(paras, boxes, slots)


def _grid(path: str, rows: list[dict]) -> bytes:
    """A table of two columns with a row for each part; the last row's end is
    not marked."""
    s = samples
    text, paras = "", []
    cell = s.sprm(0x2416, 1)
    for i, r in enumerate(rows):
        k, last = r["p_partkey"], i == len(rows) - 1
        end = cell if last and len(rows) > 1 else s.sprm(0x2416, 1) + s.sprm(0x2417, 1) + s.sprm(0xD608, bytes([2]) + struct.pack("<3h", 0, 500 + k % 100, 1500 + k % 7))
        for body, props in ((r["p_name"] + "\x07", cell), (r["p_type"] + "\x07", cell), ("\x07", end)):
            paras.append((len(text), len(text) + len(body), (0, props)))
            text += body
    return s.document([text], [], paras, lid=(0x409, 0x419, 0x804, 0x411)[int(path[1:]) % 4])


@query(f"""WITH {_SLIDES}, n AS (SELECT path, max(slide_idx) AS last FROM r GROUP BY path) SELECT path, (slide_idx * 3 + 2)::INTEGER AS para_idx, (CASE WHEN slide_idx = last AND last > 0 THEN NULL ELSE 500 + k % 100 END)::INTEGER AS w0, (CASE WHEN slide_idx = last AND last > 0 THEN NULL ELSE 1000 + k % 7 - k % 100 END)::INTEGER AS w1 FROM r JOIN n USING (path)""")
def table_rows(spark, sf_dir):
    """Row ends of tables with the widths of their cells; the one that isn't
    marked is inferred from the columns."""
    src = tables.stored(files_of(legacy._parts(spark, sf_dir), F.concat(F.lit("p"), F.floor(F.col("p_partkey") / DECK)), "p_partkey", _grid), "grids")
    paras = tables.stored(legacy._paragraphs(src), "paragraphs")
    rows = dm.repaired_tables(paras).where("row_end")
    return rows.select("path", "para_idx", F.get("cell_widths", 0).alias("w0"), F.get("cell_widths", 1).alias("w1"))


@query(f"""WITH {_SLIDES} SELECT DISTINCT path, (CASE (p_partkey // {DECK}) % 4 WHEN 0 THEN 1252 WHEN 1 THEN 1251 WHEN 2 THEN 936 ELSE 932 END)::INTEGER AS codepage FROM r""")
def document_codepages(spark, sf_dir):
    src = files_of(legacy._parts(spark, sf_dir), F.concat(F.lit("p"), F.floor(F.col("p_partkey") / DECK)), "p_partkey", _grid)
    (fib,) = legacy._tables(src, "doc_fib")
    return fib.select("path", "codepage")


@query(f"""WITH {_TURNS}, p AS (SELECT path, bool_or(role = 'user') AS headed, (count(*) FILTER (turn % 3 = 2 AND role <> 'user'))::BIGINT AS plain FROM r GROUP BY path) SELECT path, CASE WHEN headed THEN 'Heading1' ELSE '' END AS styles, 'Head ' || path AS head, 'Foot ' || path AS foot, 1::BIGINT AS parts FROM p""")
def doc_to_docx_parts(spark, sf_dir):
    """Documents converted: the styles of used heading levels, headers and
    footers, and that no required part or target is missing."""
    out = convert.doc_to_docx(legacy._documents(spark, sf_dir)).where("_error IS NULL AND _partial IS NULL")
    parts = tables.stored(pk.unzipped(out), "docx")
    body = F.decode("content", "UTF-8")
    styles = parts.where("part_name = 'word/styles.xml'").select("path", F.array_join(F.regexp_extract_all(body, F.lit('styleId="((?:Heading|TOC)[0-9])"'), F.lit(1)), ",").alias("styles"))
    said = lambda kind, name: pk.texts(parts.where(f"part_name LIKE 'word/{kind}%.xml'"), "w:t").groupBy("path").agg(F.max("text").alias(name))
    wrong = pk.missing_parts(parts, ["[Content_Types].xml", "_rels/.rels", "word/document.xml", "word/styles.xml", "word/numbering.xml"]).select("path").union(pk.broken_relations(parts).select("path")).distinct()
    rows = styles.join(said("header", "head"), "path").join(said("footer", "foot"), "path").join(wrong.withColumn("wrong", F.lit(0)), "path", "left")
    return rows.select("path", "styles", "head", "foot", F.coalesce("wrong", F.lit(1)).cast("long").alias("parts"))


# --- presentations


@query(f"""WITH {_SLIDES}, s AS (SELECT *, 3 + k % 120 AS kind FROM r) SELECT path, slide_idx, (2 - (kind = 20 OR kind BETWEEN 32 AND 40)::INTEGER)::BIGINT AS forms, ((kind = 20 OR kind BETWEEN 32 AND 40)::INTEGER)::BIGINT AS connectors, 1::BIGINT AS pictures, '2,3,4' AS ids, 'image' || (slide_idx + 1) || '.png' AS image, 'slideLayout1.xml' AS layout FROM s""")
def ppt_to_pptx_shapes(spark, sf_dir):
    """Presentations converted: kinds and numbers of each slide's shapes, its
    picture and its layout."""
    out = convert.ppt_to_pptx(legacy._decks(spark, sf_dir)).where("_error IS NULL AND _partial IS NULL")
    parts = tables.stored(pk.unzipped(out), "pptx")
    body = F.decode("content", "UTF-8")
    number = F.regexp_extract("part_name", r"slide(\d+)\.xml", 1).cast("int") - 1
    count = lambda tag: F.size(F.regexp_extract_all(body, F.lit(f"<p:{tag}>"), F.lit(0))).cast("long")
    ids = F.array_join(F.regexp_extract_all(body, F.lit('<p:cNvPr id="(\\d+)" name="Shape'), F.lit(1)), ",")
    slides = parts.where("part_name LIKE 'ppt/slides/slide%.xml'").select("path", number.alias("slide_idx"), count("sp").alias("forms"), count("cxnSp").alias("connectors"), count("pic").alias("pictures"), ids.alias("ids"))
    rels = parts.where("part_name LIKE 'ppt/slides/_rels/%.rels'").select("path", number.alias("slide_idx"), F.regexp_extract(body, "media/([^\"]*)", 1).alias("image"), F.regexp_extract(body, "slideLayouts/([^\"]*)", 1).alias("layout"))
    return slides.join(rels, ["path", "slide_idx"])


@query(f"""WITH {_SLIDES} SELECT path, slide_idx, printf('%02X', k % 256) || '8040' AS color FROM r WHERE slide_idx = 0""")
def slide_backgrounds(spark, sf_dir):
    """Backgrounds of slides, from their masters."""

    def make(path: str, rows: list[dict]) -> bytes:
        return samples.presentation([[samples.shape(1, (0, 0, 9, 9))]], [[samples.shape(1, (0, 0, 10, 10))]], scheme=legacy.SCHEME, background=samples.properties(p181=rows[0]["p_partkey"] % 256 | 0x408000))

    src = files_of(legacy._parts(spark, sf_dir), F.concat(F.lit("p"), F.floor(F.col("p_partkey") / DECK)), "p_partkey", make)
    slides, table_, schemes = legacy._tables(src, "ppt_slides", "ppt_backgrounds", "ppt_schemes")
    return sl.backgrounds(slides, table_, sl.schemes(slides, schemes)).select("path", "slide_idx", "color")


@query("""WITH s AS (SELECT l_orderkey AS o, l_linenumber AS p, CASE WHEN l_linenumber % 3 = 0 THEN l_quantity::INTEGER END AS sz, CASE WHEN l_linenumber % 2 = 0 THEN l_shipmode END AS f FROM (SELECT l_orderkey, l_linenumber, min(l_quantity) AS l_quantity, min(l_returnflag) AS l_shipmode FROM lineitem GROUP BY ALL)),
w AS (SELECT o, arg_min(sz, p) FILTER (sz IS NOT NULL) AS first_size, arg_min(f, p) FILTER (f IS NOT NULL) AS first_font FROM s GROUP BY o)
SELECT o, p, coalesce(sz, first_size)::INTEGER AS size, coalesce(f, first_font, '微软雅黑') AS font FROM s JOIN w USING (o) WHERE first_size IS NOT NULL""")
def inherited_sizes(spark, sf_dir):
    """Texts without a size or font take the first that their shape has."""
    k = F.col("l_linenumber")
    rows = table(spark, sf_dir, "lineitem").groupBy("l_orderkey", "l_linenumber").agg(F.min("l_quantity").alias("q"), F.min("l_returnflag").alias("f"))
    runs = rows.select(F.lit("d").alias("path"), F.lit("slide").alias("owner_kind"), F.col("l_orderkey").alias("owner_id"), F.lit(0).alias("z"), k.cast("int").alias("para_idx"), F.lit(0).alias("run_idx"), F.lit("t").alias("text"), F.when(k % 3 == 0, F.col("q").cast("int")).alias("font_size"), F.when(k % 2 == 0, F.col("f")).alias("font_name"), F.lit(None).cast("int").alias("line_spacing"))
    shapes = runs.select("path", "owner_kind", "owner_id", "z").distinct().select("*", F.lit(10**6).cast("long").alias("cx"), F.lit(10**6).cast("long").alias("cy"), F.lit(None).cast("string").alias("fill_color"), F.lit(None).cast("boolean").alias("no_fill"), *[F.lit(None).cast("long").alias(f"inset_{c}") for c in ("left", "top", "right", "bottom")])
    given = runs.where("font_size IS NOT NULL").select("owner_id").distinct()
    return sl.sized(runs.join(given, "owner_id", "left_semi"), shapes).select(F.col("owner_id").alias("o"), F.col("para_idx").alias("p"), F.col("font_size").alias("size"), F.col("font_name").alias("font"))
