"""Text packages from paragraphs and runs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from vellum.functions import text as tx
from vellum.functions import units
from vellum.functions.images import picture_size
from vellum.operators import packages as pk
from vellum.operators import sequence as seq

_HEAD = '<?xml version="1.0" encoding="UTF-8" standalone="yes"?>\n'
_W = "http://schemas.openxmlformats.org/wordprocessingml/2006/main"
_R = "http://schemas.openxmlformats.org/officeDocument/2006/relationships"
_PACKAGE = "http://schemas.openxmlformats.org/package/2006"
_TYPE = "application/vnd.openxmlformats-officedocument.wordprocessingml"

# Names of alignments, number formats, break kinds.
ALIGNMENTS = {0: "left", 1: "center", 2: "right", 3: "both", 4: "distribute"}
NUMBERS = {0: "decimal", 1: "upperRoman", 2: "lowerRoman", 3: "upperLetter", 4: "lowerLetter", 5: "ordinal", 22: "chineseCounting", 38: "chineseCountingThousand", 23: "bullet"}
RULES = {0: "auto", 1: "atLeast", 2: "exact"}
SECTION = '<w:pgSz w:w="11906" w:h="16838"/><w:pgMar w:top="1440" w:right="1800" w:bottom="1440" w:left="1800" w:header="851" w:footer="992" w:gutter="0"/>'  # page and margins
BOX, SHEET, TALL = (5486400, 914400), 7560310, 5000000  # a text box, a page's width, what counts as a cover
# End of fixed values.
#: Stand for a field's begin, middle and end while text is made ready for XML.
_FIELD = "\ue000\ue001\ue002"


_PICTURE_KINDS = "".join(f'<Default Extension="{e}" ContentType="image/{t}"/>' for e, t in (("png", "png"), ("jpg", "jpeg"), ("emf", "x-emf"), ("wmf", "x-wmf"), ("pict", "pict"), ("dib", "bmp"), ("tiff", "tiff")))


def _named(table: dict[int, str], c: str, default: str) -> Column:
    return F.coalesce(F.try_element_at(F.create_map(*[F.lit(x) for kv in table.items() for x in kv]), F.col(c)), F.lit(default))


def _tag(given: Column, *parts: Column | str) -> Column:
    return F.when(given, F.concat(*[F.lit(p) if isinstance(p, str) else p.cast("string") for p in parts])).otherwise("")


def run_xml() -> Column:
    """One run; pictures' and fields' marks are not text."""
    size = F.col("font_size")
    props = F.concat(
        _tag((F.length("font_name") > 0) & tx.is_cjk_font(F.col("font_name")), '<w:rFonts w:eastAsia="', pk.xml(F.col("font_name")), '"/>'),
        _tag((F.length("font_name") > 0) & ~tx.is_cjk_font(F.col("font_name")), '<w:rFonts w:ascii="', pk.xml(F.col("font_name")), '" w:hAnsi="', pk.xml(F.col("font_name")), '"/>'),
        _tag(F.col("bold"), "<w:b/>"),
        _tag(F.col("italic"), "<w:i/>"),
        _tag(F.length("color") > 0, '<w:color w:val="', F.col("color"), '"/>'),
        _tag(size > 0, '<w:sz w:val="', size, '"/><w:szCs w:val="', size, '"/>'),
        _tag(F.col("underline") > 0, '<w:u w:val="single"/>'),
    )
    text = pk.xml(F.translate("text", "\x01", ""))
    body = F.replace(F.replace(text, F.lit("\t"), F.lit('</w:t><w:tab/><w:t xml:space="preserve">')), F.lit("\x0b"), F.lit('</w:t><w:br/><w:t xml:space="preserve">'))
    return F.when(F.length("text") > 0, F.concat(F.lit("<w:r><w:rPr>"), props, F.lit('</w:rPr><w:t xml:space="preserve">'), body, F.lit("</w:t></w:r>"))).otherwise("")


def paragraph_xml() -> Column:
    """One paragraph around its runs."""
    n = lambda c: F.coalesce(F.col(c), F.lit(0))
    spacing = (n("space_before") > 0) | (n("space_after") > 0) | (n("line_spacing") > 0)
    indent = (n("indent_left") != 0) | (n("indent_right") != 0) | (n("indent_first") != 0)
    first = F.when(n("indent_first") < 0, F.concat(F.lit(' w:hanging="'), -n("indent_first"), F.lit('"'))).otherwise(F.concat(F.lit(' w:firstLine="'), n("indent_first"), F.lit('"')))
    props = F.concat(
        _tag(F.col("heading_level") > 0, '<w:pStyle w:val="Heading', F.col("heading_level"), '"/>'),
        _tag(F.col("toc_level") > 0, '<w:pStyle w:val="TOC', F.col("toc_level"), '"/>'),
        _tag(F.col("page_break_before"), "<w:pageBreakBefore/>"),
        _tag(F.col("num_id").isNotNull(), '<w:numPr><w:ilvl w:val="', n("ilvl"), '"/><w:numId w:val="', F.coalesce("num_id", F.lit(0)), '"/></w:numPr>'),
        _tag(spacing, '<w:spacing w:before="', n("space_before"), '" w:after="', n("space_after"), '"', _tag(n("line_spacing") > 0, ' w:line="', n("line_spacing"), '" w:lineRule="', _named(RULES, "line_rule", "auto"), '"'), "/>"),
        _tag(indent, '<w:ind w:left="', n("indent_left"), '" w:right="', n("indent_right"), '"', first, "/>"),
        _tag(F.col("alignment").isNotNull(), '<w:jc w:val="', _named(ALIGNMENTS, "alignment", "left"), '"/>'),
    )
    broken = _tag(F.col("page_break"), '<w:r><w:br w:type="page"/></w:r>')
    before = _tag(F.col("break_before"), '<w:p><w:r><w:br w:type="page"/></w:r></w:p>')
    mark = _tag(F.col("bookmark").isNotNull(), '<w:bookmarkStart w:id="', F.coalesce("bookmark", F.lit(0)), '" w:name="_Toc', F.coalesce("bookmark", F.lit(0)), '"/><w:bookmarkEnd w:id="', F.coalesce("bookmark", F.lit(0)), '"/>')
    link = F.col("target").isNotNull()
    runs = F.concat(_tag(link, '<w:hyperlink w:anchor="_Toc', F.coalesce("target", F.lit(0)), '">'), F.coalesce("runs", F.lit("")), _tag(link, "</w:hyperlink>"))
    return F.concat(before, F.lit("<w:p><w:pPr>"), props, F.lit("</w:pPr>"), mark, runs, broken, F.lit("</w:p>"))


def blocks(rows: DataFrame) -> DataFrame:
    """(path, para_idx, xml) with each table one block at its first paragraph:
    paragraphs to cells by cell ends, cells to rows by row ends."""
    by, order = ["path"], ["para_idx"]
    rows = seq.islands(rows, by, order, [F.col("in_table")], "__table")
    plain = rows.where("NOT in_table").select("path", "para_idx", "xml")
    inside = rows.where("in_table")
    inside = seq.group_by_ends(inside, ["path", "__table"], order, F.col("row_end"), "__row", "__in_row")
    inside = seq.group_by_ends(inside.drop("__in_row"), ["path", "__table", "__row"], order, F.col("cell_end") & ~F.col("row_end"), "__cell", "__in_cell")
    widths = F.first("cell_widths", ignorenulls=True).over(Window.partitionBy("path", "__table", "__row").orderBy(F.desc("para_idx")).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
    inside = inside.withColumn("__widths", widths).where("NOT row_end")
    cells = inside.groupBy("path", "__table", "__row", "__cell").agg(pk.ordered_text("xml", "para_idx").alias("body"), F.min("para_idx").alias("para_idx"), F.any_value("__widths").alias("widths"))
    width = F.get("widths", F.col("__cell").cast("int"))
    cell = F.concat(F.lit("<w:tc><w:tcPr>"), _tag(width.isNotNull(), '<w:tcW w:w="', F.coalesce(width, F.lit(0)), '" w:type="dxa"/>'), F.lit("</w:tcPr>"), "body", F.lit("</w:tc>"))
    lines = cells.withColumn("cell", cell).groupBy("path", "__table", "__row").agg(pk.ordered_text("cell", "__cell").alias("cells"), F.min("para_idx").alias("para_idx"))
    lines = lines.withColumn("line", F.concat(F.lit("<w:tr>"), "cells", F.lit("</w:tr>")))
    tables = lines.groupBy("path", "__table").agg(pk.ordered_text("line", "__row").alias("lines"), F.min("para_idx").alias("para_idx"))
    edge = "".join(f'<w:{s} w:val="single" w:sz="4"/>' for s in ("top", "left", "bottom", "right", "insideH", "insideV"))
    whole = F.concat(F.lit(f'<w:tbl><w:tblPr><w:tblW w:w="0" w:type="auto"/><w:tblBorders>{edge}</w:tblBorders></w:tblPr><w:tblGrid/>'), "lines", F.lit("</w:tbl>"))
    return plain.unionByName(tables.select("path", "para_idx", whole.alias("xml")))


#: Width of the text on a page, and of pictures that tell no size.
PAGE, UNKNOWN = 5_274_310, (3_600_000, 2_700_000)


def images_size(images: DataFrame) -> DataFrame:
    """(path, image_idx, cx, cy) of pictures, in EMU, no wider than the page."""
    rows = images.where(F.col("data").isNotNull()).select("path", "image_idx", picture_size("data").alias("s"))
    rows = rows.select("path", "image_idx", F.coalesce("s.cx", F.lit(UNKNOWN[0])).alias("cx"), F.coalesce("s.cy", F.lit(UNKNOWN[1])).alias("cy"))
    cx, cy = units.fit_width(F.col("cx"), F.col("cy"), PAGE)
    return rows.select("path", "image_idx", cx.alias("cx"), cy.alias("cy"))


def _drawing() -> Column:
    """A picture in line with text, of image_idx, cx and cy."""
    k = F.col("image_idx") + 1
    size = F.concat(F.lit('cx="'), F.col("cx"), F.lit('" cy="'), F.col("cy"), F.lit('"'))
    return F.concat(
        F.lit('<w:drawing><wp:inline xmlns:wp="http://schemas.openxmlformats.org/drawingml/2006/wordprocessingDrawing"><wp:extent '), size, F.lit('/><wp:docPr id="'), k, F.lit('" name="Picture"/><a:graphic xmlns:a="http://schemas.openxmlformats.org/drawingml/2006/main"><a:graphicData uri="http://schemas.openxmlformats.org/drawingml/2006/picture"><pic:pic xmlns:pic="http://schemas.openxmlformats.org/drawingml/2006/picture"><pic:nvPicPr><pic:cNvPr id="0" name="Picture"/><pic:cNvPicPr/></pic:nvPicPr><pic:blipFill><a:blip r:embed="rIdImg'), k, F.lit('"/><a:stretch><a:fillRect/></a:stretch></pic:blipFill><pic:spPr><a:xfrm><a:off x="0" y="0"/><a:ext '), size, F.lit('/></a:xfrm><a:prstGeom prst="rect"><a:avLst/></a:prstGeom></pic:spPr></pic:pic></a:graphicData></a:graphic></wp:inline></w:drawing>')
    )


def _box() -> Column:
    """A text box of ``text``, a paragraph a line, that floats at its place."""
    cx, cy = BOX
    lines = F.transform(F.split("text", "\n"), lambda t: F.concat(F.lit('<w:p><w:r><w:t xml:space="preserve">'), pk.xml(t), F.lit("</w:t></w:r></w:p>")))
    return F.concat(
        F.lit('<w:r><w:drawing><wp:anchor xmlns:wp="http://schemas.openxmlformats.org/drawingml/2006/wordprocessingDrawing" distT="0" distB="0" distL="114300" distR="114300" simplePos="0" relativeHeight="251659264" behindDoc="0" locked="0" layoutInCell="1" allowOverlap="1"><wp:simplePos x="0" y="0"/><wp:positionH relativeFrom="column"><wp:align>center</wp:align></wp:positionH><wp:positionV relativeFrom="paragraph"><wp:posOffset>0</wp:posOffset></wp:positionV>'),
        F.lit(f'<wp:extent cx="{cx}" cy="{cy}"/><wp:effectExtent l="0" t="0" r="0" b="0"/><wp:wrapNone/><wp:docPr id="'), F.col("para_idx") + 1_000_000, F.lit('" name="Text box"/><a:graphic xmlns:a="http://schemas.openxmlformats.org/drawingml/2006/main"><a:graphicData uri="http://schemas.microsoft.com/office/word/2010/wordprocessingShape"><wps:wsp xmlns:wps="http://schemas.microsoft.com/office/word/2010/wordprocessingShape"><wps:cNvSpPr txBox="1"/>'),
        F.lit(f'<wps:spPr><a:xfrm><a:off x="0" y="0"/><a:ext cx="{cx}" cy="{cy}"/></a:xfrm><a:prstGeom prst="rect"><a:avLst/></a:prstGeom><a:noFill/><a:ln><a:noFill/></a:ln></wps:spPr><wps:txbx><w:txbxContent>'), F.array_join(lines, ""), F.lit("</w:txbxContent></wps:txbx><wps:bodyPr/></wps:wsp></a:graphicData></a:graphic></wp:anchor></w:drawing></w:r>"),
    )


def _cover() -> Column:
    """A picture of image_idx, cx and cy behind the text, as wide as the page."""
    tall = F.floor(F.col("cy") * SHEET / F.col("cx"))
    size = F.concat(F.lit(f'cx="{SHEET}" cy="'), tall, F.lit('"'))
    k = F.col("image_idx") + 1
    return F.concat(
        F.lit('<w:drawing><wp:anchor xmlns:wp="http://schemas.openxmlformats.org/drawingml/2006/wordprocessingDrawing" distT="0" distB="0" distL="0" distR="0" simplePos="0" relativeHeight="0" behindDoc="1" locked="1" layoutInCell="1" allowOverlap="1"><wp:simplePos x="0" y="0"/><wp:positionH relativeFrom="page"><wp:posOffset>0</wp:posOffset></wp:positionH><wp:positionV relativeFrom="page"><wp:posOffset>0</wp:posOffset></wp:positionV><wp:extent '), size,
        F.lit('/><wp:effectExtent l="0" t="0" r="0" b="0"/><wp:wrapNone/><wp:docPr id="'), k, F.lit('" name="Picture"/><a:graphic xmlns:a="http://schemas.openxmlformats.org/drawingml/2006/main"><a:graphicData uri="http://schemas.openxmlformats.org/drawingml/2006/picture"><pic:pic xmlns:pic="http://schemas.openxmlformats.org/drawingml/2006/picture"><pic:nvPicPr><pic:cNvPr id="'), k, F.lit('" name="Picture"/><pic:cNvPicPr/></pic:nvPicPr><pic:blipFill><a:blip r:embed="rIdImg'), k,
        F.lit('"/><a:stretch><a:fillRect/></a:stretch></pic:blipFill><pic:spPr><a:xfrm><a:off x="0" y="0"/><a:ext '), size, F.lit('/></a:xfrm><a:prstGeom prst="rect"><a:avLst/></a:prstGeom></pic:spPr></pic:pic></a:graphicData></a:graphic></wp:anchor></w:drawing>'),
    )


def story_xml(raw: Column) -> Column:
    """The runs of a header or footer: fields as fields with the result they
    had, tabs as tabs; marks of what isn't closed go."""
    text = pk.xml(F.translate(raw, "\x13\x14\x15", _FIELD))
    begin, middle, end = _FIELD
    field = F.regexp_replace(text, f"{begin}([^{_FIELD}]*){middle}([^{_FIELD}]*){end}", '</w:t></w:r><w:fldSimple w:instr="$1"><w:r><w:t xml:space="preserve">$2</w:t></w:r></w:fldSimple><w:r><w:t xml:space="preserve">')
    bare = F.regexp_replace(field, f"{begin}([^{_FIELD}]*){end}", '</w:t></w:r><w:fldSimple w:instr="$1"/><w:r><w:t xml:space="preserve">')
    whole = F.replace(F.translate(bare, _FIELD, ""), F.lit("\t"), F.lit('</w:t></w:r><w:r><w:tab/></w:r><w:r><w:t xml:space="preserve">'))
    return F.concat(F.lit('<w:r><w:t xml:space="preserve">'), whole, F.lit("</w:t></w:r>"))


def plain_parts(texts: DataFrame, images: DataFrame) -> DataFrame:
    """(path, part_name, content) of packages with the text alone, a paragraph
    a line (path, text), and the pictures behind it."""
    fine = images.where(F.col("data").isNotNull()).withColumn("file", F.concat(F.lit("image"), F.col("image_idx") + 1, tx.extension(F.col("format"))))
    drawn = images_size(images).withColumn("drawing", F.concat(F.lit("<w:p><w:r>"), _drawing(), F.lit("</w:r></w:p>")))
    relation = F.concat(F.lit('<Relationship Id="rIdImg'), F.col("image_idx") + 1, F.lit(f'" Type="{_R}/image" Target="media/'), "file", F.lit('"/>'))
    pictures = fine.select("path", "image_idx", relation.alias("relation")).join(drawn, ["path", "image_idx"], "left").na.fill("", ["drawing"])
    pictures = pictures.groupBy("path").agg(pk.ordered_text("drawing", "image_idx").alias("drawings"), pk.ordered_text("relation", "image_idx").alias("relations"))
    shown = F.regexp_replace(F.translate(tx.strip_field_codes(F.col("text"), keep_pictures=False), "\x07\x0c", "\r\r"), "\r$", "")
    lines = F.transform(F.split(shown, "\r"), lambda t: F.concat(F.lit('<w:p><w:r><w:t xml:space="preserve">'), pk.xml(t), F.lit("</w:t></w:r></w:p>")))
    rows = texts.select("path", F.array_join(lines, "").alias("body")).join(pictures, "path", "left").na.fill("", ["drawings", "relations"])
    wrap = lambda a, c, b: F.concat(F.lit(_HEAD + a), c, F.lit(b))
    kinds = '<Default Extension="rels" ContentType="application/vnd.openxmlformats-package.relationships+xml"/><Default Extension="xml" ContentType="application/xml"/>' + _PICTURE_KINDS + "".join(f'<Override PartName="/word/{n}.xml" ContentType="{_TYPE}.{t}+xml"/>' for n, t in (("document", "document.main"), ("styles", "styles")))
    out = [
        pk.part(rows, "word/document.xml", wrap(f'<w:document xmlns:w="{_W}" xmlns:r="{_R}"><w:body>', F.concat("body", "drawings"), f"<w:sectPr>{SECTION}</w:sectPr></w:body></w:document>")),
        pk.part(rows, "word/_rels/document.xml.rels", wrap(f'<Relationships xmlns="{_PACKAGE}/relationships"><Relationship Id="rId1" Type="{_R}/styles" Target="styles.xml"/>', F.col("relations"), "</Relationships>")),
        pk.part(rows, "word/styles.xml", F.lit(f'{_HEAD}<w:styles xmlns:w="{_W}"><w:style w:type="paragraph" w:default="1" w:styleId="Normal"><w:name w:val="Normal"/></w:style></w:styles>')),
        pk.part(rows, "[Content_Types].xml", F.lit(f'{_HEAD}<Types xmlns="{_PACKAGE}/content-types">{kinds}</Types>')),
        pk.part(rows, "_rels/.rels", F.lit(f'{_HEAD}<Relationships xmlns="{_PACKAGE}/relationships"><Relationship Id="rId1" Type="{_R}/officeDocument" Target="word/document.xml"/></Relationships>')),
        fine.join(rows.select("path"), "path", "left_semi").select("path", F.concat(F.lit("word/media/"), "file").alias("part_name"), F.col("data").alias("content")),
    ]
    whole = out[0]
    for p in out[1:]:
        whole = whole.unionByName(p)
    return whole


def parts(paras: DataFrame, runs: DataFrame, stories: DataFrame, images: DataFrame, targets: DataFrame, placed: DataFrame, boxes: DataFrame, story_pictures: DataFrame | None = None) -> DataFrame:
    """(path, part_name, content) of a package for every document, from laid
    out paragraphs, their runs, headers and footers, pictures, headings of
    table-of-contents entries, pictures' places (path, para_idx, ord,
    image_idx) and text boxes (path, para_idx, text). A picture without a
    place stands at the end in a paragraph of its own; one wider than the page
    is scaled down."""
    texts = runs.withColumn("run", run_xml()).groupBy("path", "para_idx").agg(pk.ordered_text("run", "run_idx").alias("runs"))
    marks = targets.select("path", F.col("target").alias("para_idx")).distinct().withColumn("bookmark", F.col("para_idx"))
    wide = images_size(images)
    inside = placed.join(wide, ["path", "image_idx"]).withColumn("drawing", F.concat(F.lit("<w:r>"), _drawing(), F.lit("</w:r>")))
    inside = inside.groupBy("path", "para_idx").agg(pk.ordered_text("drawing", "ord").alias("pictures"))
    boxed = boxes.select("path", "para_idx", _box().alias("box"))
    texts = texts.join(inside, ["path", "para_idx"], "full_outer").join(boxed, ["path", "para_idx"], "full_outer")
    texts = texts.select("path", "para_idx", F.concat(*[F.coalesce(c, F.lit("")) for c in ("runs", "pictures", "box")]).alias("runs"))
    rows = paras.where("NOT skip").join(texts, ["path", "para_idx"], "left").join(marks, ["path", "para_idx"], "left").join(targets, ["path", "para_idx"], "left")
    body = blocks(rows.withColumn("xml", paragraph_xml())).groupBy("path").agg(pk.ordered_text("xml", "para_idx").alias("body"))
    body = paras.select("path").distinct().join(body, "path", "left")

    fine = images.where(F.col("data").isNotNull()).withColumn("file", F.concat(F.lit("image"), F.col("image_idx") + 1, tx.extension(F.col("format"))))
    media = fine.select("path", F.concat(F.lit("word/media/"), "file").alias("part_name"), F.col("data").alias("content"))
    in_stories = (story_pictures if story_pictures is not None else stories.sparkSession.createDataFrame([], "path string, story_idx int, images array<int>")).select("path", "story_idx", F.posexplode("images").alias("place", "image_idx"))
    used = placed.select("path", "image_idx").union(in_stories.select("path", "image_idx")).distinct()
    loose = wide.join(used, ["path", "image_idx"], "left_anti").select("path", "image_idx", F.concat(F.lit("<w:p><w:r>"), _drawing(), F.lit("</w:r></w:p>")).alias("drawing"))
    relation = F.concat(F.lit('<Relationship Id="rIdImg'), F.col("image_idx") + 1, F.lit(f'" Type="{_R}/image" Target="media/'), "file", F.lit('"/>'))
    pictures = fine.select("path", "image_idx", relation.alias("relation")).join(loose, ["path", "image_idx"], "left").na.fill("", ["drawing"])
    pictures = pictures.groupBy("path").agg(pk.ordered_text("drawing", "image_idx").alias("drawings"), pk.ordered_text("relation", "image_idx").alias("image_relations"))

    first = seq.first_wins(stories, ["path", "kind", "story_type"], [F.col("story_idx")])
    first = first.withColumn("n", F.row_number().over(Window.partitionBy("path").orderBy("story_idx")))
    tag = F.when(F.col("kind") == "header", "hdr").otherwise("ftr")
    file = F.concat("kind", "n", F.lit(".xml"))
    # pictures of a story, each once; the size is the picture's own where it covers the page
    drawn = in_stories.join(wide, ["path", "image_idx"]).join(fine.select("path", "image_idx", "file"), ["path", "image_idx"]).join(first.select("path", "story_idx", "kind", "story_type"), ["path", "story_idx"])
    covers = (F.col("kind") == "header") & (F.col("story_type") == "first") & (F.col("cx") > 0) & (F.col("cy") * SHEET / F.col("cx") > TALL)
    drawn = drawn.withColumn("drawing", F.concat(F.lit("<w:r>"), F.when(covers, _cover()).otherwise(_drawing()), F.lit("</w:r>")))
    drawn = drawn.withColumn("relation", F.concat(F.lit('<Relationship Id="rIdImg'), F.col("image_idx") + 1, F.lit(f'" Type="{_R}/image" Target="media/'), "file", F.lit('"/>')))
    at = drawn.groupBy("path", "story_idx").agg(pk.ordered_text("drawing", "place").alias("pictures"))
    links = drawn.select("path", "story_idx", "image_idx", "relation").distinct().groupBy("path", "story_idx").agg(pk.ordered_text("relation", "image_idx").alias("relations"))
    told = first.join(at, ["path", "story_idx"], "left").join(links, ["path", "story_idx"], "left")
    raw = F.col("raw_text") if "raw_text" in stories.columns else F.col("text")
    inner = F.concat(F.coalesce("pictures", F.lit("")), F.when(F.length("text") > 0, story_xml(F.translate(raw, "\r\n", ""))).otherwise(""))
    story = pk.part(told, F.concat(F.lit("word/"), file), F.concat(F.lit(f"{_HEAD}<w:"), tag, F.lit(f' xmlns:w="{_W}" xmlns:r="{_R}"><w:p>'), inner, F.lit("</w:p></w:"), tag, F.lit(">")))
    linked = told.where("relations IS NOT NULL")
    story = story.unionByName(pk.part(linked, F.concat(F.lit("word/_rels/"), file, F.lit(".rels")), F.concat(F.lit(f'{_HEAD}<Relationships xmlns="{_PACKAGE}/relationships">'), "relations", F.lit("</Relationships>"))))
    first = first.select(
        "path",
        "n",
        F.concat(F.lit("<w:"), "kind", F.lit('Reference w:type="'), "story_type", F.lit('" r:id="rIdStory'), "n", F.lit('"/>')).alias("reference"),
        F.concat(F.lit('<Relationship Id="rIdStory'), "n", F.lit(f'" Type="{_R}/'), "kind", F.lit('" Target="'), file, F.lit('"/>')).alias("relation"),
        F.concat(F.lit('<Override PartName="/word/'), file, F.lit(f'" ContentType="{_TYPE}.'), "kind", F.lit('+xml"/>')).alias("kind_tag"),
    )
    heads = first.groupBy("path").agg(pk.ordered_text("reference", "n").alias("references"), pk.ordered_text("relation", "n").alias("story_relations"), pk.ordered_text("kind_tag", "n").alias("story_kinds"))

    items = paras.where("num_id IS NOT NULL AND NOT skip").groupBy("path", "num_id").agg(F.min_by(F.struct("nfc", "lvl_text"), "para_idx").alias("kind"))
    items = items.select("path", "num_id", "kind.*")
    text = F.when(F.col("nfc") == 23, "•").when(F.length("lvl_text") > 0, pk.xml(F.col("lvl_text"))).otherwise("%1.")
    levels = F.concat(*[F.concat(F.lit(f'<w:lvl w:ilvl="{i}"><w:start w:val="1"/><w:numFmt w:val="'), _named(NUMBERS, "nfc", "decimal"), F.lit('"/><w:lvlText w:val="'), text, F.lit(f'"/><w:lvlJc w:val="left"/><w:pPr><w:ind w:left="{720 * (i + 1)}" w:hanging="360"/></w:pPr></w:lvl>')) for i in range(9)])
    items = items.withColumns({"abstract": F.concat(F.lit('<w:abstractNum w:abstractNumId="'), "num_id", F.lit('">'), levels, F.lit("</w:abstractNum>")), "num": F.concat(F.lit('<w:num w:numId="'), "num_id", F.lit('"><w:abstractNumId w:val="'), "num_id", F.lit('"/></w:num>'))})
    numbering = items.groupBy("path").agg(F.concat(pk.ordered_text("abstract", "num_id"), pk.ordered_text("num", "num_id")).alias("numbering"))

    whole = body.join(pictures, "path", "left").join(heads, "path", "left").join(numbering, "path", "left").na.fill("", ["body", "drawings", "image_relations", "references", "story_relations", "story_kinds", "numbering"])
    levels_of = lambda c: F.array_sort(F.collect_set(F.when(F.col(c) > 0, F.col(c))))
    named = paras.where("NOT skip").groupBy("path").agg(levels_of("heading_level").alias("headings"), levels_of("toc_level").alias("tocs"))
    heading = F.transform("headings", lambda i: F.concat(F.lit('<w:style w:type="paragraph" w:styleId="Heading'), i, F.lit('"><w:name w:val="heading '), i, F.lit('"/><w:pPr><w:outlineLvl w:val="'), i - 1, F.lit('"/></w:pPr></w:style>')))
    toc = F.transform("tocs", lambda i: F.concat(F.lit('<w:style w:type="paragraph" w:styleId="TOC'), i, F.lit('"><w:name w:val="toc '), i, F.lit('"/></w:style>')))
    whole = whole.join(named.select("path", F.concat(F.array_join(heading, ""), F.array_join(toc, "")).alias("styles")), "path", "left").na.fill("", ["styles"])
    wrap = lambda a, c, b: F.concat(F.lit(_HEAD + a), c, F.lit(b))
    fixed = '<Default Extension="rels" ContentType="application/vnd.openxmlformats-package.relationships+xml"/><Default Extension="xml" ContentType="application/xml"/>' + "".join(f'<Default Extension="{e}" ContentType="image/{t}"/>' for e, t in (("png", "png"), ("jpg", "jpeg"), ("emf", "x-emf"), ("wmf", "x-wmf"), ("pict", "pict"), ("dib", "bmp"), ("tiff", "tiff")))
    fixed += "".join(f'<Override PartName="/word/{n}.xml" ContentType="{_TYPE}.{t}+xml"/>' for n, t in (("document", "document.main"), ("styles", "styles"), ("numbering", "numbering"), ("settings", "settings")))
    base = "".join(f'<Relationship Id="rId{i}" Type="{_R}/{t}" Target="{t}.xml"/>' for i, t in enumerate(("styles", "numbering", "settings"), 1))
    document = F.concat("body", "drawings", F.lit("<w:sectPr>"), "references", F.lit(f"{SECTION}</w:sectPr>"))
    out = [
        pk.part(whole, "word/document.xml", wrap(f'<w:document xmlns:w="{_W}" xmlns:r="{_R}"><w:body>', document, "</w:body></w:document>")),
        pk.part(whole, "word/_rels/document.xml.rels", wrap(f'<Relationships xmlns="{_PACKAGE}/relationships">{base}', F.concat("image_relations", "story_relations"), "</Relationships>")),
        pk.part(whole, "word/numbering.xml", wrap(f'<w:numbering xmlns:w="{_W}">', F.col("numbering"), "</w:numbering>")),
        pk.part(whole, "word/styles.xml", wrap(f'<w:styles xmlns:w="{_W}"><w:style w:type="paragraph" w:default="1" w:styleId="Normal"><w:name w:val="Normal"/></w:style>', F.col("styles"), "</w:styles>")),
        pk.part(whole, "word/settings.xml", F.lit(f'{_HEAD}<w:settings xmlns:w="{_W}"/>')),
        pk.part(whole, "[Content_Types].xml", wrap(f'<Types xmlns="{_PACKAGE}/content-types">{fixed}', F.col("story_kinds"), "</Types>")),
        pk.part(whole, "_rels/.rels", F.lit(f'{_HEAD}<Relationships xmlns="{_PACKAGE}/relationships"><Relationship Id="rId1" Type="{_R}/officeDocument" Target="word/document.xml"/></Relationships>')),
        story,
        media,
    ]
    rows = out[0]
    for p in out[1:]:
        rows = rows.unionByName(p)
    return rows
