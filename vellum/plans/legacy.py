"""Legacy files made of the tables' rows, read by the parsers and converted.

A file holds a bounded number of rows (parts of one number range, the turns of
one conversation), so no group grows with the tables.
"""

from __future__ import annotations

import struct
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vellum.operators import cells as cl
from vellum.operators import document as dm
from vellum.operators import packages as pk
from vellum.operators import slides as sl
from vellum.operators import tables
from vellum.plans import convert, samples
from vellum.plans.registry import query, table
from vellum.sources import readers

#: Parts of one workbook, and of one presentation.
BOOK, DECK = 40, 8


def files_of(df: DataFrame, path: Column, order: str, make: Callable[[str, list[dict]], bytes]) -> DataFrame:
    """(path, content): a file of the rows of each path, in order."""
    rest = [c for c in df.columns if c != order]
    rows = df.groupBy(path.alias("path")).agg(F.sort_array(F.collect_list(F.struct(order, *rest))).alias("rows"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for name, own in zip(batch.column(0).to_pylist(), batch.column(1)):
                yield pa.RecordBatch.from_arrays([pa.array([name]), pa.array([make(name, own.as_py())], pa.binary())], names=["path", "content"])

    return rows.mapInArrow(run, "path string, content binary")


# --- workbooks


def _parts(spark, sf_dir) -> DataFrame:
    return table(spark, sf_dir, "part").select("p_partkey", "p_name", "p_type", "p_size", "p_retailprice")


def _books(spark, sf_dir, make) -> DataFrame:
    return files_of(_parts(spark, sf_dir), F.concat(F.lit("b"), F.floor(F.col("p_partkey") / BOOK)), "p_partkey", make)


def _shape(path: str) -> dict:
    """Version and order of sectors, by the file's number."""
    k = int(path[1:])
    return {"version": 3 + k % 2, "scatter": k % 3 == 0}


def _cells_book(path: str, rows: list[dict]) -> bytes:
    s = samples
    strings = list(dict.fromkeys(r["p_type"] for r in rows))
    first, second = [], []
    for r in rows:
        at, size, price = r["p_partkey"] % BOOK, r["p_size"], r["p_retailprice"]
        first += [s.label_sst(at, 0, strings.index(r["p_type"])), s.number(at, 1, price, 16 + size % 2), s.rk_cell(at, 2, size), s.mul_rk(at, 3, [size, -size]), s.mul_blank(at, 5, 2), s.blank(at, 7)]
        first += [s.bool_err(at, 8, size % 2), s.bool_err(at, 9, 7, 1), s.label(at, 10, r["p_name"]), s.rk_cell(at, 11, size / 100, 15, True)]
        second.append(s.number(at, 0, size))
    return s.workbook([("Parts", first), ("Sizes", second)], strings, {164: "0.00%", 165: "MM/DD/YYYY"}, [0] * 16 + [164, 165], cut=16 + int(path[1:]) % 60, **_shape(path))


_ROWS = f"r AS (SELECT *, 'b' || (p_partkey // {BOOK}) AS path, (p_partkey % {BOOK})::INTEGER AS row_idx FROM part)"


@query(f"""WITH {_ROWS}, c AS (SELECT path, row_idx, unnest(range(12))::INTEGER AS col_idx, p_type, p_name, p_size, p_retailprice FROM r)
SELECT path, 'Parts' AS sheet_name, row_idx, col_idx, CASE WHEN col_idx = 0 THEN 'LabelSSt' WHEN col_idx = 1 THEN 'Number' WHEN col_idx IN (2, 3, 4, 11) THEN 'Rk' WHEN col_idx IN (5, 6, 7) THEN 'Blank' WHEN col_idx IN (8, 9) THEN 'BoolErr' ELSE 'LabelBIFF8' END AS cell_type,
 (CASE WHEN col_idx = 1 THEN 16 + p_size % 2 ELSE 15 END)::INTEGER AS xf_idx,
 CASE col_idx WHEN 0 THEN p_type WHEN 8 THEN CASE WHEN p_size % 2 = 1 THEN 'TRUE' ELSE 'FALSE' END WHEN 9 THEN '#DIV/0!' WHEN 10 THEN p_name END AS text,
 (CASE col_idx WHEN 1 THEN p_retailprice WHEN 2 THEN p_size WHEN 3 THEN p_size WHEN 4 THEN -p_size WHEN 11 THEN p_size / 100.0 END)::DOUBLE AS num_val FROM c
UNION ALL SELECT path, 'Sizes', row_idx, 0, 'Number', 15, NULL, p_size::DOUBLE FROM r""")
def legacy_cells(spark, sf_dir):
    """Every kind of cell of workbooks of both sector sizes, chains in falling
    order, shared strings cut anywhere."""
    cells = readers.good(readers.parse(_books(spark, sf_dir, _cells_book), "xls_cells"))
    text = F.when(F.col("cell_type").isin("LabelSSt", "LabelBIFF8", "BoolErr"), F.col("str_val"))
    return cells.select("path", "sheet_name", "row_idx", "col_idx", "cell_type", "xf_idx", text.alias("text"), "num_val")


@query(f"""WITH {_ROWS} SELECT path, row_idx, CASE p_size % 2 WHEN 0 THEN '0.00%' ELSE 'MM/DD/YYYY' END AS pattern, (164 + p_size % 2)::INTEGER AS ifmt FROM r""")
def legacy_formats(spark, sf_dir):
    """Formats of cells by two hops, cell to format record to pattern."""
    src = tables.stored(_books(spark, sf_dir, _cells_book), "books")
    t = {n: readers.good(readers.parse(src, n)) for n in ("xls_cells", "xls_xf", "xls_formats")}
    out = cl.with_formats(t["xls_cells"].where("sheet_id = 0 AND col_idx = 1"), t["xls_xf"], t["xls_formats"])
    return out.select("path", "row_idx", "pattern", "ifmt")


@query(f"""WITH {_ROWS} SELECT path, 1536 AS version, 1252 AS codepage, false AS date1904, 2 AS n_sheets, count(DISTINCT p_type)::INTEGER AS n_strings FROM r GROUP BY path""")
def legacy_books(spark, sf_dir):
    return readers.good(readers.parse(_books(spark, sf_dir, _cells_book), "xls_books"))


def _strings_book(path: str, rows: list[dict]) -> bytes:
    texts = []
    for r in rows:
        text = f"{r['p_name']} {r['p_type']}" + ("Ωж" if r["p_size"] % 3 == 0 else "é" if r["p_size"] % 3 == 1 else "")
        texts.append((text, [(0, 1), (2, 3)]) if r["p_size"] % 2 else text)
    return samples.workbook([("S", [])], texts, cut=16 + int(path[1:]) % 60, **_shape(path))


@query(f"""WITH {_ROWS} SELECT path, row_idx::BIGINT AS sst_idx, p_name || ' ' || p_type || CASE p_size % 3 WHEN 0 THEN 'Ωж' WHEN 1 THEN 'é' ELSE '' END AS text, (CASE WHEN p_size % 2 = 1 THEN 2 ELSE 0 END)::INTEGER AS n_runs FROM r""")
def legacy_strings(spark, sf_dir):
    """Shared strings of one and two bytes a character, some rich, their
    records cut at any byte."""
    rows = readers.good(readers.parse(_books(spark, sf_dir, _strings_book), "xls_sst"))
    return rows.select("path", "sst_idx", "text", F.size("runs").alias("n_runs"))


def _old_book(path: str, rows: list[dict]) -> bytes:
    cells = [samples.label(r["p_partkey"] % BOOK, 0, "Дом " + r["p_name"], codec="cp1251") for r in rows]
    return samples.workbook([("Лист", cells)], biff8=False, codepage=1251, date1904=True, **_shape(path))


@query(f"""WITH {_ROWS} SELECT path, 'Лист' AS sheet_name, row_idx, 'LabelBIFF5' AS cell_type, 'Дом ' || p_name AS text FROM r""")
def legacy_old_books(spark, sf_dir):
    """Workbooks of the older version, text by code page."""
    rows = readers.good(readers.parse(_books(spark, sf_dir, _old_book), "xls_cells"))
    return rows.select("path", "sheet_name", "row_idx", "cell_type", F.col("str_val").alias("text"))


def _streams_file(path: str, rows: list[dict]) -> bytes:
    return samples.compound({f"S{r['p_partkey'] % BOOK}": r["p_name"].encode() * (r["p_size"] ** 2) for r in rows}, **_shape(path))


@query(f"""WITH {_ROWS}, d AS (SELECT path, 'S' || row_idx AS name, repeat(p_name, (p_size * p_size)::BIGINT) AS data FROM r) SELECT path, name, strlen(data)::BIGINT AS size, md5(data) AS digest FROM d""")
def legacy_streams(spark, sf_dir):
    """Streams of compound files, from none of a sector to many."""
    rows = readers.good(readers.parse(_books(spark, sf_dir, _streams_file), "ole_streams")).where("object_type = 2")
    return rows.select("path", "name", "size", F.md5("data").alias("digest"))


@query(f"""WITH {_ROWS}, n AS (SELECT path, count(DISTINCT p_type) AS k FROM r GROUP BY path), t AS (SELECT path, row_idx * 2 AS place, p_type AS text FROM r UNION ALL SELECT path, row_idx * 2 + 1, p_name FROM r),
f AS (SELECT path, text, min(place) AS first FROM t GROUP BY ALL) SELECT path, (row_number() OVER (PARTITION BY path ORDER BY first) - 1)::INTEGER AS idx, text FROM f""")
def xls_to_xlsx_strings(spark, sf_dir):
    """Workbooks converted: the shared strings of the packages."""

    def make(path: str, rows: list[dict]) -> bytes:
        strings = [r["p_type"] for r in rows]
        cells = [x for k, r in enumerate(rows) for x in (samples.label_sst(r["p_partkey"] % BOOK, 0, k), samples.label(r["p_partkey"] % BOOK, 1, r["p_name"]))]
        return samples.workbook([("Parts", cells)], strings, **_shape(path))

    out = convert.xls_to_xlsx(_books(spark, sf_dir, make)).where("_error IS NULL AND _partial IS NULL")
    return pk.texts(pk.unzipped(out).where("part_name = 'xl/sharedStrings.xml'"), "t").select("path", "idx", "text")


# --- documents


def _turn(r: dict) -> str:
    return r["text"].replace("\n", " ")


def _document(path: str, rows: list[dict]) -> bytes:
    """A paragraph for each turn: the user's are headings, every third is a
    list item; the first letters stand out."""
    s = samples
    pieces, chars, paras, at = [], [], [], 0
    for r in rows:
        text = _turn(r)
        pieces.append((text + "\r", not text.isascii()))
        end = at + len(text) + 1
        own = b"" if r["role"] == "user" else s.sprm(0x2461, r["turn"] % 4) + s.sprm(0xA413, 20 * r["turn"])
        own += s.sprm(0x460B, 1) if r["turn"] % 3 == 2 else b""
        paras.append((at, end, (1 if r["role"] == "user" else 0, own)))
        chars += [(at, at + 3, s.sprm(0x0835, 1) + s.sprm(0x4A43, 30 + r["turn"])), (at + 3, end, None)]
        at = end
    styles = [s.style("Normal", 0, chars=s.sprm(0x4A43, 24) + s.sprm(0x4A4F, 0)), s.style("heading 1", 1, 0, paras=s.sprm(0x2461, 1), chars=s.sprm(0x0835, 1))]
    cut = len(_turn(rows[0])) + 1
    sections = [(cut, s.sprm(0x3009, 2)), (at, s.sprm(0x3009, 1))] if len(rows) > 1 else [(at, b"")]
    stories = [""] * 6 + ["", f"Head {path}\r", "", f"Foot {path}\r", "", ""]
    pictures = b"".join(s.picture("PNG" if r["turn"] % 2 else "JPEG", f"{r['role']}{r['turn']}".encode()) for r in rows)
    return s.document(pieces, chars, paras, styles, ["Arial"], [(7, 0, "\0.")], [7], sections, stories, pictures=pictures, align=1, **{k: v for k, v in _shape(path).items() if k == "version"})


def _documents(spark, sf_dir) -> DataFrame:
    rows = table(spark, sf_dir, "conversations").select("turn", "conv_id", "role", "text")
    return tables.stored(files_of(rows, F.concat(F.lit("c"), F.col("conv_id")), "turn", _document), "docs")


def _tables(src: DataFrame, *names: str) -> list[DataFrame]:
    raw = tables.stored(readers.parse_all(src, names), "read", by=["table"])
    return [readers.of(raw, n) for n in names]


def _paragraphs(src: DataFrame) -> DataFrame:
    return dm.paragraphs(*_tables(src, "doc_text", "doc_para_runs", "doc_styles", "doc_lists", "doc_list_overrides", "doc_sections"))


_TURNS = "r AS (SELECT 'c' || conv_id AS path, (row_number() OVER (PARTITION BY conv_id ORDER BY turn, role, text) - 1)::INTEGER AS para_idx, turn, role, replace(text, chr(10), ' ') AS text FROM conversations)"


@query(f"""WITH {_TURNS} SELECT path, para_idx, text, (CASE role WHEN 'user' THEN 1 ELSE 0 END)::INTEGER AS heading_level, (CASE role WHEN 'user' THEN 1 ELSE turn % 4 END)::INTEGER AS alignment, (CASE WHEN role = 'user' THEN NULL WHEN turn > 0 THEN turn * 20 END)::INTEGER AS space_before,
turn % 3 = 2 AS list_item, turn % 3 = 2 AS ordered, CASE turn % 3 WHEN 2 THEN '%1.' ELSE '' END AS lvl_text, para_idx = 0 AND max(para_idx) OVER (PARTITION BY path) > 0 AS section_break FROM r""")
def legacy_paragraphs(spark, sf_dir):
    """Paragraphs of text documents: pieces of one and two bytes a character,
    property pages, styles, list levels, sections."""
    return _paragraphs(_documents(spark, sf_dir)).select("path", "para_idx", "text", "heading_level", "alignment", "space_before", "list_item", "ordered", "lvl_text", "section_break")


@query(f"""WITH {_TURNS} SELECT path, para_idx, 0 AS run_idx, substr(text, 1, 3) AS text, (30 + turn)::INTEGER AS font_size, true AS bold, 'Arial' AS font_name FROM r
UNION ALL SELECT path, para_idx, 1, substr(text, 4), 24, role = 'user', 'Arial' FROM r WHERE length(text) > 3""")
def legacy_runs(spark, sf_dir):
    """Character runs clipped to their paragraphs, with sizes, fonts and flags
    of their own or their style's."""
    src = _documents(spark, sf_dir)
    paras = tables.stored(_paragraphs(src), "paragraphs")
    (chars,) = _tables(src, "doc_char_runs")
    return dm.runs(paras, chars).select("path", "para_idx", "run_idx", "text", "font_size", "bold", "font_name")


@query(f"""WITH {_TURNS}, p AS (SELECT DISTINCT path FROM r) SELECT path, 'header' AS kind, 'Head ' || path AS text FROM p UNION ALL SELECT path, 'footer', 'Foot ' || path FROM p""")
def legacy_stories(spark, sf_dir):
    (stories,) = _tables(_documents(spark, sf_dir), "doc_stories")
    return dm.stories(stories).select("path", "kind", "text")


@query(f"""WITH {_TURNS}, e AS (SELECT path, para_idx, (sum(length(text) + 1) OVER (PARTITION BY path ORDER BY para_idx))::BIGINT AS e, max(para_idx) OVER (PARTITION BY path) AS last FROM r),
s AS (SELECT path, 0 AS section_idx, 0::BIGINT AS cp_start, e AS cp_end FROM e WHERE para_idx = 0 UNION ALL SELECT a.path, 1, a.e, b.e FROM e a JOIN e b USING (path) WHERE a.para_idx = 0 AND b.para_idx = b.last AND b.last > 0) SELECT path, section_idx::INTEGER AS section_idx, cp_start, cp_end FROM s""")
def legacy_sections(spark, sf_dir):
    (sections,) = _tables(_documents(spark, sf_dir), "doc_sections")
    return sections.select("path", "section_idx", "cp_start", "cp_end")


@query(f"""WITH {_TURNS} SELECT path, para_idx AS image_idx, CASE turn % 2 WHEN 1 THEN 'PNG' ELSE 'JPEG' END AS format, md5(role || turn) AS digest, CASE turn % 2 WHEN 1 THEN '.png' ELSE '.jpg' END AS suffix FROM r""")
def legacy_images(spark, sf_dir):
    """Pictures of documents, found in the picture stream."""
    from vellum.functions import text as tx

    (images,) = _tables(_documents(spark, sf_dir), "doc_images")
    return images.select("path", "image_idx", "format", F.md5("data").alias("digest"), tx.extension(F.col("format")).alias("suffix"))


@query(f"""WITH {_TURNS} SELECT path, string_agg(text, '' ORDER BY para_idx) AS text, (count(*) FILTER (turn % 3 = 2))::BIGINT AS n_listed FROM r GROUP BY path""")
def doc_to_docx_texts(spark, sf_dir):
    """Documents converted: the text of each package, and its list items."""
    out = convert.doc_to_docx(_documents(spark, sf_dir)).where("_error IS NULL AND _partial IS NULL")
    body = tables.stored(pk.unzipped(out).where("part_name = 'word/document.xml'"), "bodies")
    rows = F.sort_array(F.collect_list(F.struct("idx", "text")))
    text = pk.texts(body, "w:t").groupBy("path").agg(F.array_join(F.transform(rows, lambda r: r["text"]), "").alias("text"))
    listed = body.select("path", F.size(F.regexp_extract_all(F.decode("content", "UTF-8"), F.lit("<w:numPr>"), F.lit(0))).cast("long").alias("n_listed"))
    return text.join(listed, "path")


# --- presentations


SCHEME = ["FFFFFF", "101010", "111111", "222222", "333333", "444444", "555555", "666666"]


def _box(k: int) -> tuple[int, int, int, int]:
    return k % 97, k % 89, k % 97 + 100 + k % 11, k % 89 + 50 + k % 7


def _deck(path: str, rows: list[dict]) -> bytes:
    """A slide for each part: a text box, a group with a shape, a picture."""
    s = samples
    slides = []
    for i, r in enumerate(rows):
        k, n = r["p_partkey"], len(r["p_name"])
        style = s.text_style([(n + 1, 0, struct.pack("<IH", 1 << 11, 1)), (len(r["p_type"]) + 1, 1, struct.pack("<I", 0))], [(n + 1, struct.pack("<IHH", 1 | 1 << 17, 1, 20 + k % 30)), (len(r["p_type"]) + 1, struct.pack("<II", 1 << 18, 0x04000000))])
        box = s.shape(202, _box(k), s.text_box(1, f"{r['p_name']}\r{r['p_type']}", style, wide=k % 2 == 0), s.properties(p181=k % 256 | 0x40FF00, p1bf=0x00100010))
        group = s.group((0, 0, 1000, 500), (0, 0, 100 + k % 3 * 50, 100), s.shape(3 + k % 120, (10, 20, 60, 70), child=True))
        slides.append([box, group, s.shape(75, _box(k + 1), s.properties(p104=i + 1))])
    title = s.drawing(0xFA3, struct.pack("<H", 1) + struct.pack("<I", 0) + struct.pack("<IH", 1 << 17, 44), 1)
    pictures = [s.picture("PNG", r["p_name"].encode()) for r in rows]
    return s.presentation(slides, [[s.shape(1, (0, 0, 10, 10))]], ["Arial"], pictures=pictures, scheme=SCHEME, master_styles=title)


def _decks(spark, sf_dir) -> DataFrame:
    src = files_of(_parts(spark, sf_dir), F.concat(F.lit("p"), F.floor(F.col("p_partkey") / DECK)), "p_partkey", _deck)
    return tables.stored(src, "decks")


_SLIDES = f"r AS (SELECT *, 'p' || (p_partkey // {DECK}) AS path, (p_partkey % {DECK})::INTEGER AS slide_idx, p_partkey AS k FROM part)"


@query(f"""WITH {_SLIDES}, b AS (SELECT path, slide_idx, k, p_partkey % 97 AS l, p_partkey % 89 AS t, 100 + p_partkey % 11 AS w, 50 + p_partkey % 7 AS h, (k + 1) % 97 AS l2, (k + 1) % 89 AS t2, 100 + (k + 1) % 11 AS w2, 50 + (k + 1) % 7 AS h2, 100 + k % 3 * 50 AS gw FROM r),
s AS (SELECT path, slide_idx, 202 AS shape_type, l AS x, t AS y, w AS cx, h AS cy, lower(printf('%02X', k % 256)) AS red FROM b
UNION ALL SELECT path, slide_idx, 3 + k % 120, 10 * 1000 // gw, 20 * 500 // 100, 50 * 1000 // gw, 50 * 500 // 100, NULL FROM b
UNION ALL SELECT path, slide_idx, 75, l2, t2, w2, h2, NULL FROM b)
SELECT path, slide_idx, shape_type::INTEGER AS shape_type, (x * 12700 // 8)::BIGINT AS x, (y * 12700 // 8)::BIGINT AS y, (cx * 12700 // 8)::BIGINT AS cx, (cy * 12700 // 8)::BIGINT AS cy, upper(red) || 'FF40' AS fill FROM s""")
def legacy_shapes(spark, sf_dir):
    """Shapes of slides, those in groups moved through them, and their fills."""
    (shapes,) = _tables(_decks(spark, sf_dir), "ppt_shapes")
    out = sl.placed(shapes).where("owner_kind = 'slide'")
    return out.select("path", F.col("owner_id").cast("int").alias("slide_idx"), "shape_type", "x", "y", "cx", "cy", F.when(F.col("shape_type") == 202, F.col("fill_color")).alias("fill"))


@query(f"""WITH {_SLIDES} SELECT path, slide_idx, 0 AS para_idx, p_name AS text, (20 + k % 30)::INTEGER AS font_size, true AS bold, 1 AS alignment, 0 AS level, NULL::VARCHAR AS color FROM r
UNION ALL SELECT path, slide_idx, 1, p_type, 44, NULL, NULL, 1, '333333' FROM r""")
def legacy_slide_runs(spark, sf_dir):
    """Runs of slides by their styles, else their master's, colors through the
    scheme."""
    t = dict(zip(names := ("ppt_runs", "ppt_shapes", "ppt_slides", "ppt_schemes", "ppt_master_styles"), _tables(_decks(spark, sf_dir), *names)))
    rows = sl.styled(t["ppt_runs"], t["ppt_shapes"], t["ppt_slides"], sl.schemes(t["ppt_slides"], t["ppt_schemes"]), t["ppt_master_styles"]).where("owner_kind = 'slide'")
    return rows.select("path", F.col("owner_id").cast("int").alias("slide_idx"), "para_idx", "text", "font_size", "bold", "alignment", "level", "color")


@query(f"""WITH {_SLIDES} SELECT path, slide_idx, 0 AS layout_idx, count(*) OVER (PARTITION BY path)::INTEGER AS n_slides, 5760 AS width, 4320 AS height FROM r""")
def legacy_slides(spark, sf_dir):
    """Slides in the order of their list, found through the persist directory,
    with their layouts."""
    slides, info = _tables(_decks(spark, sf_dir), "ppt_slides", "ppt_presentations")
    return slides.join(sl.layouts(slides), ["path", "master_ref"]).join(info, "path").select("path", "slide_idx", "layout_idx", "n_slides", "width", "height")


@query(f"""WITH {_SLIDES} SELECT path, slide_idx AS image_idx, 'PNG' AS format, md5(p_name) AS digest FROM r""")
def legacy_slide_images(spark, sf_dir):
    (images,) = _tables(_decks(spark, sf_dir), "ppt_images")
    return images.select("path", "image_idx", "format", F.md5("data").alias("digest"))


@query(f"""WITH {_SLIDES} SELECT path, slide_idx, 0 AS idx, p_name AS text FROM r UNION ALL SELECT path, slide_idx, 1, p_type FROM r""")
def ppt_to_pptx_texts(spark, sf_dir):
    """Presentations converted: the texts of each slide of the packages."""
    out = convert.ppt_to_pptx(_decks(spark, sf_dir)).where("_error IS NULL AND _partial IS NULL")
    rows = pk.texts(pk.unzipped(out).where("part_name LIKE 'ppt/slides/slide%.xml'"), "a:t")
    number = F.regexp_extract("part_name", r"slide(\d+)\.xml", 1).cast("int") - 1
    return rows.select("path", number.alias("slide_idx"), "idx", "text")
