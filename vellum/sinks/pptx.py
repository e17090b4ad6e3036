"""Presentation packages from slides, shapes and runs."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from vellum.functions import text as tx
from vellum.functions import units
from vellum.operators import packages as pk
from vellum.operators import slides as sl
from vellum.operators import tables

_HEAD = '<?xml version="1.0" encoding="UTF-8" standalone="yes"?>\n'
_P = "http://schemas.openxmlformats.org/presentationml/2006/main"
_A = "http://schemas.openxmlformats.org/drawingml/2006/main"
_R = "http://schemas.openxmlformats.org/officeDocument/2006/relationships"
_PACKAGE = "http://schemas.openxmlformats.org/package/2006"
_TYPE = "application/vnd.openxmlformats-officedocument.presentationml"
_NS = f'xmlns:a="{_A}" xmlns:r="{_R}" xmlns:p="{_P}"'

# Preset shapes by shape type, alignments.
PRESETS = {
    0: "rect", 1: "rect", 2: "roundRect", 3: "ellipse", 4: "diamond", 5: "triangle", 6: "rtTriangle", 7: "parallelogram", 8: "trapezoid", 9: "hexagon", 10: "octagon", 11: "mathPlus", 12: "star5", 13: "rightArrow", 14: "rightArrow", 15: "homePlate",
    16: "cube", 17: "wedgeRoundRectCallout", 19: "arc", 20: "line", 21: "plaque", 22: "can", 23: "donut", 32: "straightConnector1", 33: "bentConnector2", 34: "bentConnector3", 35: "bentConnector4", 36: "bentConnector5", 37: "curvedConnector2",
    38: "curvedConnector3", 39: "curvedConnector4", 40: "curvedConnector5", 55: "noSmoking", 56: "rightArrow", 57: "leftArrow", 58: "upArrow", 59: "downArrow", 60: "leftRightArrow", 61: "upDownArrow", 66: "irregularSeal1", 67: "wedgeRectCallout",
    68: "wedgeRoundRectCallout", 69: "wedgeEllipseCallout", 72: "cloudCallout", 75: "rect", 84: "bevel", 85: "foldedCorner", 87: "smileyFace", 91: "heart", 92: "lightningBolt", 93: "sun", 94: "flowChartProcess", 95: "flowChartDecision",
    96: "flowChartInputOutput", 97: "flowChartPredefinedProcess", 98: "flowChartInternalStorage", 99: "flowChartDocument", 100: "flowChartMultidocument",
    101: "flowChartMerge", 102: "flowChartOnlineStorage", 103: "flowChartDelay", 104: "flowChartMagneticTape", 105: "flowChartMagneticDisk", 106: "flowChartTerminator", 107: "flowChartPunchedTape", 108: "flowChartSummingJunction", 109: "flowChartOr",
    110: "callout1", 111: "callout2", 112: "callout3", 114: "ribbon2", 115: "ribbon", 116: "accentCallout2", 120: "chevron", 121: "pentagon", 122: "blockArc", 183: "leftBrace", 184: "rightBrace", 185: "leftBracket", 186: "rightBracket", 202: "rect",
}
DASHES = {0: "solid", 1: "sysDash", 2: "sysDot", 3: "sysDashDot", 4: "sysDashDotDot", 5: "dot", 6: "dash", 7: "lgDash", 8: "dashDot", 9: "lgDashDot", 10: "lgDashDotDot"}
ENDS = {1: "triangle", 2: "stealth", 3: "diamond", 4: "oval", 5: "arrow"}
ALIGNMENTS = {0: "l", 1: "ctr", 2: "r", 3: "just"}
ANCHORS = {0: "t", 1: "ctr", 2: "b", 3: "t", 4: "ctr", 5: "b"}
STEPS = {0: "sm", 1: "med", 2: "lg"}
THEME = ("FFFFFF", "000000", "EEECE1", "1F497D", "4F81BD", "C0504D", "0000FF", "800080")
THEME_ORDER = ("dk1", "lt1", "dk2", "lt2", "accent1", "accent2", "accent3", "accent4", "accent5", "accent6", "hlink", "folHlink")
COLOR_MAP = '<p:clrMap bg1="lt1" tx1="dk1" bg2="lt2" tx2="dk2" accent1="accent1" accent2="accent2" accent3="accent3" accent4="accent4" accent5="accent5" accent6="accent6" hlink="hlink" folHlink="folHlink"/>'
# End of fixed values.
_THEME_COLORS = ("lt1", "dk1", "lt2", "dk2", "accent1", "accent2", "hlink", "folHlink")


def _map(table: dict[int, str], key: Column, default: str) -> Column:
    return F.coalesce(F.try_element_at(F.create_map(*[F.lit(x) for kv in table.items() for x in kv]), key), F.lit(default))


def _if(given: Column, *parts: Column | str) -> Column:
    return F.when(F.coalesce(given, F.lit(False)), F.concat(*[F.lit(p) if isinstance(p, str) else F.coalesce(p.cast("string"), F.lit("")) for p in parts])).otherwise("")


def path_of(width: int, height: int, vertices, segments) -> str | None:
    """A path of a shape's own, from points and runs of steps: lines (0),
    curves of three points (1), moves (2), closings (3). Without steps the
    points are joined by lines; steps without points left are passed over."""
    if vertices is None or not len(vertices):
        return None
    points = [f'<a:pt x="{v["x"]}" y="{v["y"]}"/>' for v in vertices]
    out, at = [], 0
    steps = [(s["seg_type"], s["count"]) for s in segments] if segments is not None and len(segments) else [(2, 0), (0, len(points) - 1)]
    for kind, count in steps:
        if kind == 3:
            out.append("<a:close/>")
            continue
        if kind not in (0, 1, 2):
            continue
        tag, width_ = (("lnTo", 1), ("cubicBezTo", 3), ("moveTo", 1))[kind]
        for _ in range(max(1, count)):
            if at + width_ > len(points):
                break
            out.append(f"<a:{tag}>{''.join(points[at : at + width_])}</a:{tag}>")
            at += width_
    return f'<a:custGeom><a:avLst/><a:rect l="0" t="0" r="r" b="b"/><a:pathLst><a:path w="{width}" h="{height}">{"".join(out)}</a:path></a:pathLst></a:custGeom>'


@F.pandas_udf(StringType())
def path_xml(width: pd.Series, height: pd.Series, vertices: pd.Series, segments: pd.Series) -> pd.Series:
    return pd.Series([path_of(*row) for row in zip(width, height, vertices, segments)], dtype=object)


def _texts(runs: DataFrame) -> DataFrame:
    """(owner, z, body): a text body of paragraphs and runs."""
    flag = lambda c, n: _if(F.col(c), f' {n}="1"')
    fill = _if(F.length("color") == 6, '<a:solidFill><a:srgbClr val="', F.col("color"), '"/></a:solidFill>')
    font = _if(F.length("font_name") > 0, '<a:latin typeface="', pk.xml(F.col("font_name")), '"/><a:ea typeface="', pk.xml(F.col("font_name")), '"/>')
    props = F.concat(F.lit('<a:rPr lang="en-US"'), _if(F.col("font_size") > 0, ' sz="', F.col("font_size") * 100, '"'), flag("bold", "b"), flag("italic", "i"), _if(F.col("underline"), ' u="sng"'), F.lit(">"), fill, font, F.lit("</a:rPr>"))
    pieces = F.transform(F.split(pk.xml(F.col("text")), "\x0b"), lambda t: F.concat(F.lit("<a:r>"), props, F.lit("<a:t>"), t, F.lit("</a:t></a:r>")))
    rows = runs.withColumn("run", F.when(F.length("text") > 0, F.array_join(pieces, "<a:br/>")).otherwise(""))
    paras = rows.groupBy(*sl.OWNER, "z", "para_idx").agg(pk.ordered_text("run", "run_idx").alias("runs"), F.first("level").alias("level"), F.first("alignment").alias("alignment"), F.first("bullet").alias("bullet"))
    head = F.concat(F.lit('<a:p><a:pPr lvl="'), F.least(F.coalesce("level", F.lit(0)), F.lit(8)), F.lit('"'), _if(F.col("alignment").isNotNull(), ' algn="', _map(ALIGNMENTS, F.col("alignment"), "l"), '"'), F.lit(">"), F.when(F.col("bullet"), '<a:buChar char="•"/>').otherwise("<a:buNone/>"), F.lit("</a:pPr>"))
    paras = paras.withColumn("para", F.concat(head, "runs", F.lit("</a:p>")))
    return paras.groupBy(*sl.OWNER, "z").agg(pk.ordered_text("para", "para_idx").alias("body"))


def _framed(rows: DataFrame) -> DataFrame:
    """Shapes with their place, ``__frame``. A shape's box is that of the turned
    shape, so near a quarter turn the sides change places around the center."""
    rows = rows.withColumns({"__turn": units.rotation(F.coalesce("rotation_raw", F.lit(0))), "__w": F.greatest("cx", F.lit(0)), "__h": F.greatest("cy", F.lit(0))})
    turn, w, h, swap = (F.col(c) for c in ("__turn", "__w", "__h", "__swap"))
    rows = rows.withColumn("__swap", units.is_quarter_turn(turn) & ~turn.isin(45 * 60000, 135 * 60000, 225 * 60000, 315 * 60000))
    x = F.when(swap, F.col("x") + F.floor(w / 2) - F.floor(h / 2)).otherwise(F.col("x"))
    y = F.when(swap, F.col("y") + F.floor(h / 2) - F.floor(w / 2)).otherwise(F.col("y"))
    cx, cy = F.when(swap, h).otherwise(w), F.when(swap, w).otherwise(h)
    flips = [_if(F.col(c), f' {n}="1"') for c, n in (("flip_h", "flipH"), ("flip_v", "flipV"))]
    return rows.withColumn("__frame", F.concat(F.lit("<a:xfrm"), _if(turn != 0, ' rot="', turn, '"'), *flips, F.lit('><a:off x="'), x, F.lit('" y="'), y, F.lit('"/><a:ext cx="'), cx, F.lit('" cy="'), cy, F.lit('"/></a:xfrm>')))


def _body_props() -> Column:
    """Insets, anchor and wrapping of a text, as far as they are given."""
    inset = [_if(F.col(f"inset_{c}") >= 0, f' {n}="', F.col(f"inset_{c}"), '"') for c, n in (("left", "lIns"), ("top", "tIns"), ("right", "rIns"), ("bottom", "bIns"))]
    anchor = _if(F.col("anchor").between(0, 5), ' anchor="', _map(ANCHORS, F.col("anchor").cast("int"), "t"), '"')
    return F.concat(F.lit("<a:bodyPr"), *inset, anchor, _if(F.col("anchor").between(3, 5), ' anchorCtr="1"'), _if(F.col("wrap") == 0, ' wrap="none"'), F.lit("><a:normAutofit/></a:bodyPr>"))


def _shaped(rows: DataFrame) -> DataFrame:
    """Shapes with their ``xml``, of number ``n``: a picture, a connector or a
    form with text. Pieces that stand in several kinds are columns, so that
    each is in the plan once."""
    k = F.col("n").cast("string")
    geometry = F.coalesce(F.col("own_path"), F.concat(F.lit('<a:prstGeom prst="'), _map(PRESETS, F.col("shape_type"), "rect"), F.lit('"><a:avLst/></a:prstGeom>')))
    step = lambda c, n: _if(F.col(c).between(0, 2), f' {n}="', _map(STEPS, F.col(c).cast("int"), "med"), '"')
    end = lambda c, n: _if(F.col(f"line_{c}").between(1, 5), f'<a:{n} type="', _map(ENDS, F.col(f"line_{c}").cast("int"), "none"), '"', step(f"{c}_width", "w"), step(f"{c}_length", "len"), "/>")
    style = F.concat(_if(F.col("line_dash") > 0, '<a:prstDash val="', _map(DASHES, F.col("line_dash").cast("int"), "solid"), '"/>'), end("start", "headEnd"), end("end", "tailEnd"))
    alpha = _if(F.col("fill_opacity") < 65536, '<a:alpha val="', units.crop(F.col("fill_opacity")), '"/>')
    filled = sl.is_filled(F.col("fill_color"), F.col("no_fill"), F.col("fill_opacity"))
    fill = F.when(filled, F.concat(F.lit('<a:solidFill><a:srgbClr val="'), "fill_color", F.lit('">'), alpha, F.lit("</a:srgbClr></a:solidFill>"))).otherwise("<a:noFill/>")
    told = (F.length("line_color") > 0) | (sl.is_connector(F.col("shape_type")) & ((F.col("line_width") > 0) | (F.col("line_start") > 0) | (F.col("line_end") > 0)))
    drawn = F.coalesce(told, F.lit(False)) & ~F.coalesce("no_line", F.lit(False))
    line = F.when(drawn, F.concat(F.lit('<a:ln w="'), F.coalesce("line_width", F.lit(9525)), F.lit('"><a:solidFill><a:srgbClr val="'), F.coalesce("line_color", F.lit("000000")), F.lit('"/></a:solidFill>'), style, F.lit("</a:ln>"))).when(sl.is_connector(F.col("shape_type")) & ~F.coalesce("no_line", F.lit(False)), '<a:ln><a:solidFill><a:srgbClr val="000000"/></a:solidFill></a:ln>').otherwise("<a:ln><a:noFill/></a:ln>")
    rows = _framed(rows).withColumns({"__geometry": geometry, "__fill": fill, "__line": line})
    frame, geometry, fill, line = (F.col(c) for c in ("__frame", "__geometry", "__fill", "__line"))
    form = F.concat(frame, geometry, fill, line)
    name = F.concat(F.lit('<p:cNvPr id="'), k, F.lit('" name="Shape '), k, F.lit('"/>'))
    cut = lambda c: units.crop(F.coalesce(F.col(c), F.lit(0)))
    crop = F.concat(F.lit('<a:srcRect l="'), cut("crop_left"), F.lit('" t="'), cut("crop_top"), F.lit('" r="'), cut("crop_right"), F.lit('" b="'), cut("crop_bottom"), F.lit('"/>'))
    picture = F.concat(F.lit("<p:pic><p:nvPicPr>"), name, F.lit('<p:cNvPicPr/><p:nvPr/></p:nvPicPr><p:blipFill><a:blip r:embed="rIdImg'), F.col("image_idx") + 1, F.lit('"/>'), crop, F.lit("<a:stretch><a:fillRect/></a:stretch></p:blipFill><p:spPr>"), frame, F.lit('<a:prstGeom prst="rect"><a:avLst/></a:prstGeom></p:spPr></p:pic>'))
    connector = F.concat(F.lit("<p:cxnSp><p:nvCxnSpPr>"), name, F.lit("<p:cNvCxnSpPr/><p:nvPr/></p:nvCxnSpPr><p:spPr>"), frame, geometry, line, F.lit("</p:spPr></p:cxnSp>"))
    plain = F.concat(F.lit("<p:sp><p:nvSpPr>"), name, F.lit("<p:cNvSpPr/><p:nvPr/></p:nvSpPr><p:spPr>"), form, F.lit("</p:spPr><p:txBody>"), _body_props(), F.lit("<a:lstStyle/>"), F.coalesce("body", F.lit("<a:p/>")), F.lit("</p:txBody></p:sp>"))
    return rows.withColumn("xml", F.when(F.col("file").isNotNull(), picture).when(sl.is_connector(F.col("shape_type")), connector).otherwise(plain))


def _ground(rows: DataFrame) -> Column:
    """A background of ``color`` or of the picture ``file``, which goes first."""
    cut = lambda c: units.crop(F.coalesce(F.col(c), F.lit(0)))
    crops = [F.col(c) for c in ("crop_left", "crop_top", "crop_right", "crop_bottom")] if "crop_left" in rows.columns else []
    crop = _if(F.greatest(*[F.coalesce(c, F.lit(0)) for c in crops]) > 0, '<a:srcRect l="', cut("crop_left"), '" t="', cut("crop_top"), '" r="', cut("crop_right"), '" b="', cut("crop_bottom"), '"/>') if crops else F.lit("")
    picture = F.concat(F.lit('<a:blipFill><a:blip r:embed="rIdImg'), F.col("image_idx") + 1, F.lit('"/>'), crop, F.lit("<a:stretch><a:fillRect/></a:stretch></a:blipFill>"))
    solid = F.concat(F.lit('<a:solidFill><a:srgbClr val="'), F.col("color"), F.lit('"/></a:solidFill>'))
    fill = F.when(F.col("file").isNotNull(), picture).when(F.length("color") == 6, solid)
    return F.coalesce(F.concat(F.lit("<p:bg><p:bgPr>"), fill, F.lit("<a:effectLst/></p:bgPr></p:bg>")), F.lit(""))


def _relations(used: DataFrame, by: list[str]) -> DataFrame:
    """(by, relations): each picture that a part uses once, by number."""
    one = F.concat(F.lit('<Relationship Id="rIdImg'), F.col("image_idx") + 1, F.lit(f'" Type="{_R}/image" Target="../media/'), "file", F.lit('"/>'))
    rows = used.where("file IS NOT NULL").select(*by, "image_idx", one.alias("relation")).distinct()
    return rows.groupBy(*by).agg(pk.ordered_text("relation", "image_idx").alias("relations"))


def parts(info: DataFrame, slides: DataFrame, shapes: DataFrame, runs: DataFrame, images: DataFrame, scheme: DataFrame, texts: DataFrame, backgrounds: DataFrame, geometry: DataFrame, layers: DataFrame, master_grounds: DataFrame, titles: DataFrame) -> DataFrame:
    """(path, part_name, content) of a package for every presentation, from
    slides with their layouts' numbers, placed shapes and styled runs. A slide
    without shapes shows its listed texts in one box; one without a background
    of its own takes its master's (backgrounds: path, slide_idx, color,
    image_idx, already chosen).

    Each master that slides refer to makes a layout of its shapes (layers), its
    background (master_grounds) and, if there is one, the ground of its titles;
    its watermarks stand on its slides, below their own shapes.

    What several kinds of parts are made of is stored, so that the plan of the
    result holds each of it as one scan and the driver's memory no copies."""
    fine = images.where(F.col("data").isNotNull()).withColumn("file", F.concat(F.lit("image"), F.col("image_idx") + 1, tx.extension(F.col("format"))))
    media = fine.select("path", F.concat(F.lit("ppt/media/"), "file").alias("part_name"), F.col("data").alias("content"))
    fine = fine.select("path", "image_idx", "file")
    owner = [*sl.OWNER, "z"]
    said = tables.stored(_texts(runs), "said")
    dressed = lambda rows: rows.join(fine, ["path", "image_idx"], "left").join(said, owner, "left").join(geometry.select(*owner, path_xml("geo_w", "geo_h", "vertices", "segments").alias("own_path")), owner, "left")

    page = ["path", "slide_idx"]
    own = dressed(shapes.where("owner_kind = 'slide'")).withColumns({"slide_idx": F.col("owner_id").cast("int"), "layer": F.lit(1)})
    marks = dressed(layers.where("layer = 'over'")).join(slides.select(*page, "layout_idx"), ["path", "layout_idx"]).withColumn("layer", F.lit(0)).drop("layout_idx")
    drawn = own.unionByName(marks.select(*own.columns))
    drawn = drawn.withColumn("n", F.row_number().over(Window.partitionBy(*page).orderBy("layer", "z")) + 1)
    drawn = tables.stored(_shaped(drawn).select(*page, "n", "layer", "image_idx", "file", "xml"), "drawn")
    listed = texts.join(drawn.where("layer = 1").select(*page).distinct(), page, "left_anti")
    lines = F.transform(tx.lines(F.col("text")), lambda t: F.concat(F.lit('<a:p><a:r><a:rPr lang="en-US"/><a:t>'), pk.xml(t), F.lit("</a:t></a:r></a:p>")))
    listed = listed.withColumn("line", F.array_join(lines, "")).groupBy(*page).agg(pk.ordered_text("line", "text_idx").alias("lines"))
    box = F.concat(F.lit('<p:sp><p:nvSpPr><p:cNvPr id="1000" name="Text"/><p:cNvSpPr/><p:nvPr/></p:nvSpPr><p:spPr><a:xfrm><a:off x="457200" y="457200"/><a:ext cx="8229600" cy="5943600"/></a:xfrm><a:prstGeom prst="rect"><a:avLst/></a:prstGeom></p:spPr><p:txBody><a:bodyPr/><a:lstStyle/>'), "lines", F.lit("</p:txBody></p:sp>"))
    body = drawn.groupBy(*page).agg(pk.ordered_text("xml", "n").alias("body")).join(listed.select(*page, box.alias("box")), page, "full_outer")
    body = body.select(*page, F.concat(F.coalesce("body", F.lit("")), F.coalesce("box", F.lit(""))).alias("body"))
    grounds = tables.stored(backgrounds.join(fine, ["path", "image_idx"], "left"), "backgrounds")
    used = _relations(drawn.select(*page, "image_idx", "file").unionByName(grounds.select(*page, "image_idx", "file")), page)
    rows = slides.select(*page, "layout_idx").join(body, page, "left").join(used, page, "left").join(grounds.select(*page, _ground(grounds).alias("ground")), page, "left").na.fill("", ["body", "relations", "ground"])
    rows = tables.stored(rows, "slidexml")
    tables.drop(grounds)
    tree = lambda c, bg=F.lit(""): F.concat(F.lit("<p:cSld>"), bg, F.lit('<p:spTree><p:nvGrpSpPr><p:cNvPr id="1" name=""/><p:cNvGrpSpPr/><p:nvPr/></p:nvGrpSpPr><p:grpSpPr/>'), c, F.lit("</p:spTree></p:cSld>"))
    n, m = F.col("slide_idx") + 1, F.col("layout_idx") + 1
    wrap = lambda a, c, b: F.concat(F.lit(_HEAD + a), c, F.lit(b))
    rels = lambda c: wrap(f'<Relationships xmlns="{_PACKAGE}/relationships">', c, "</Relationships>")
    rel = lambda i, t, target: f'<Relationship Id="{i}" Type="{_R}/{t}" Target="{target}"/>'

    layout = ["path", "layout_idx"]
    sheets = slides.select("path", "layout_idx", "master_ref").distinct().groupBy(*layout).agg(F.min("master_ref").alias("owner_id"))
    sheets = info.select("path").join(sheets, "path", "left").na.fill(0, ["layout_idx"])
    plain = dressed(layers.where("layer = 'plain'"))
    plain = plain.withColumn("n", F.row_number().over(Window.partitionBy(*layout).orderBy("z")) + 2)
    plain = tables.stored(_shaped(plain).select(*layout, "n", "image_idx", "file", "xml"), "plain")
    crops = ["crop_left", "crop_top", "crop_right", "crop_bottom"]
    full = layers.where("layer = 'back'").groupBy(*layout).agg(F.min_by(F.struct("image_idx", *crops), "z").alias("f")).select(*layout, F.col("f.image_idx").alias("full_idx"), *[F.col(f"f.{c}").alias(c) for c in crops])
    back = sheets.join(master_grounds, ["path", "owner_id"], "left").join(full, layout, "left").select(*layout, "color", F.coalesce("full_idx", "image_idx").alias("image_idx"), *crops).join(fine, ["path", "image_idx"], "left")
    back = tables.stored(back, "back")
    on_layout = _relations(plain.select(*layout, "image_idx", "file").unionByName(back.select(*layout, "image_idx", "file")), layout)
    size = info.select("path", units.from_master(F.col("width")).alias("__w"))
    shade = F.concat(F.lit('<p:sp><p:nvSpPr><p:cNvPr id="2" name="Title ground"/><p:cNvSpPr/><p:nvPr/></p:nvSpPr><p:spPr><a:xfrm><a:off x="0" y="0"/><a:ext cx="'), "__w", F.lit('" cy="'), "bottom", F.lit('"/></a:xfrm><a:prstGeom prst="rect"><a:avLst/></a:prstGeom><a:gradFill><a:gsLst><a:gs pos="0"><a:srgbClr val="'), "color", F.lit('"/></a:gs><a:gs pos="100000"><a:srgbClr val="'), "color", F.lit('"><a:tint val="60000"/></a:srgbClr></a:gs></a:gsLst><a:lin ang="0" scaled="1"/></a:gradFill><a:ln><a:noFill/></a:ln></p:spPr></p:sp>'))
    shaded = titles.join(size, "path").select(*layout, shade.alias("shade"))
    sheets = sheets.join(plain.groupBy(*layout).agg(pk.ordered_text("xml", "n").alias("body")), layout, "left").join(on_layout, layout, "left").join(back.select(*layout, _ground(back).alias("ground")), layout, "left").join(shaded, layout, "left")
    sheets = tables.stored(sheets.na.fill("", ["body", "relations", "ground", "shade"]), "sheets")
    tables.drop(said, drawn, plain, back)
    sheet = sheets.select(
        *layout,
        F.concat(F.lit('<p:sldLayoutId id="'), F.lit(2147483649) + F.col("layout_idx"), F.lit('" r:id="rIdL'), m, F.lit('"/>')).alias("entry"),
        F.concat(F.lit('<Relationship Id="rIdL'), m, F.lit(f'" Type="{_R}/slideLayout" Target="../slideLayouts/slideLayout'), m, F.lit('.xml"/>')).alias("relation"),
        F.concat(F.lit('<Override PartName="/ppt/slideLayouts/slideLayout'), m, F.lit(f'.xml" ContentType="{_TYPE}.slideLayout+xml"/>')).alias("kind"),
    )
    sheet = sheet.groupBy("path").agg(pk.ordered_text("entry", "layout_idx").alias("layout_entries"), pk.ordered_text("relation", "layout_idx").alias("layout_relations"), pk.ordered_text("kind", "layout_idx").alias("layout_kinds"))
    each = rows.select(
        *page,
        F.concat(F.lit('<p:sldId id="'), F.col("slide_idx") + 256, F.lit('" r:id="rIdS'), n, F.lit('"/>')).alias("entry"),
        F.concat(F.lit('<Relationship Id="rIdS'), n, F.lit(f'" Type="{_R}/slide" Target="slides/slide'), n, F.lit('.xml"/>')).alias("relation"),
        F.concat(F.lit('<Override PartName="/ppt/slides/slide'), n, F.lit(f'.xml" ContentType="{_TYPE}.slide+xml"/>')).alias("kind"),
    )
    book = each.groupBy("path").agg(pk.ordered_text("entry", "slide_idx").alias("entries"), pk.ordered_text("relation", "slide_idx").alias("slide_relations"), pk.ordered_text("kind", "slide_idx").alias("kinds"))
    used_scheme = scheme.where("owner_kind = 'slide' AND colors IS NOT NULL").groupBy("path", "colors").agg(F.count(F.lit(1)).alias("n"), F.min("owner_id").alias("first"))
    used_scheme = used_scheme.groupBy("path").agg(F.max_by("colors", F.struct("n", -F.col("first"))).alias("colors"))
    book = info.join(book, "path", "left").join(sheet, "path", "left").join(used_scheme, "path", "left").na.fill("", ["entries", "slide_relations", "kinds", "layout_entries", "layout_relations", "layout_kinds"])
    book = tables.stored(book, "book")
    slide_size = F.concat(F.lit('<p:sldSz cx="'), units.from_master(F.col("width")), F.lit('" cy="'), units.from_master(F.col("height")), F.lit('"/><p:notesSz cx="6858000" cy="9144000"/>'))
    names = dict(zip(_THEME_COLORS, range(8)))
    theme_color = lambda n, k: F.concat(F.lit(f'<a:{n}><a:srgbClr val="'), F.coalesce(F.get("colors", k), F.lit(THEME[k])), F.lit(f'"/></a:{n}>'))
    colors = F.concat(*[theme_color(n, names.get(n, 4 + i % 2)) for i, n in enumerate(THEME_ORDER)])
    fills = '<a:fillStyleLst>{0}</a:fillStyleLst><a:lnStyleLst>{1}</a:lnStyleLst><a:effectStyleLst>{2}</a:effectStyleLst><a:bgFillStyleLst>{0}</a:bgFillStyleLst>'.format('<a:solidFill><a:schemeClr val="phClr"/></a:solidFill>' * 3, '<a:ln w="9525"><a:solidFill><a:schemeClr val="phClr"/></a:solidFill></a:ln>' * 3, "<a:effectStyle><a:effectLst/></a:effectStyle>" * 3)
    face = '<a:latin typeface="Calibri"/><a:ea typeface=""/><a:cs typeface=""/>'
    theme = wrap(f'<a:theme xmlns:a="{_A}" name="Theme"><a:themeElements><a:clrScheme name="Scheme">', colors, f'</a:clrScheme><a:fontScheme name="Fonts"><a:majorFont>{face}</a:majorFont><a:minorFont>{face}</a:minorFont></a:fontScheme><a:fmtScheme name="Format">{fills}</a:fmtScheme></a:themeElements></a:theme>')
    fixed = '<Default Extension="rels" ContentType="application/vnd.openxmlformats-package.relationships+xml"/><Default Extension="xml" ContentType="application/xml"/>' + "".join(f'<Default Extension="{e}" ContentType="image/{t}"/>' for e, t in (("png", "png"), ("jpg", "jpeg"), ("emf", "x-emf"), ("wmf", "x-wmf"), ("pict", "pict"), ("dib", "bmp"), ("tiff", "tiff")))
    fixed += f'<Override PartName="/ppt/presentation.xml" ContentType="{_TYPE}.presentation.main+xml"/><Override PartName="/ppt/slideMasters/slideMaster1.xml" ContentType="{_TYPE}.slideMaster+xml"/><Override PartName="/ppt/theme/theme1.xml" ContentType="application/vnd.openxmlformats-officedocument.theme+xml"/>'
    style = lambda name, points: f'<p:{name}><a:lvl1pPr><a:defRPr sz="{points}00"><a:latin typeface="{sl.FONT}"/><a:ea typeface="{sl.FONT}"/></a:defRPr></a:lvl1pPr></p:{name}>'
    styles = style("titleStyle", 32) + style("bodyStyle", 18) + style("otherStyle", 18)
    out = [
        pk.part(rows, F.concat(F.lit("ppt/slides/slide"), n, F.lit(".xml")), wrap(f"<p:sld {_NS}>", tree(F.col("body"), F.col("ground")), "<p:clrMapOvr><a:masterClrMapping/></p:clrMapOvr></p:sld>")),
        pk.part(rows, F.concat(F.lit("ppt/slides/_rels/slide"), n, F.lit(".xml.rels")), rels(F.concat(F.lit(f'<Relationship Id="rIdL" Type="{_R}/slideLayout" Target="../slideLayouts/slideLayout'), m, F.lit('.xml"/>'), "relations"))),
        pk.part(book, "ppt/presentation.xml", wrap(f'<p:presentation {_NS}><p:sldMasterIdLst><p:sldMasterId id="2147483648" r:id="rIdM"/></p:sldMasterIdLst><p:sldIdLst>', F.concat("entries", F.lit("</p:sldIdLst>"), slide_size), "</p:presentation>")),
        pk.part(book, "ppt/_rels/presentation.xml.rels", rels(F.concat(F.lit(rel("rIdM", "slideMaster", "slideMasters/slideMaster1.xml") + rel("rIdT", "theme", "theme/theme1.xml")), "slide_relations"))),
        pk.part(book, "ppt/slideMasters/slideMaster1.xml", wrap(f"<p:sldMaster {_NS}>", F.concat(tree(F.lit("")), F.lit(f"{COLOR_MAP}<p:sldLayoutIdLst>"), "layout_entries"), f"</p:sldLayoutIdLst><p:txStyles>{styles}</p:txStyles></p:sldMaster>")),
        pk.part(book, "ppt/slideMasters/_rels/slideMaster1.xml.rels", rels(F.concat("layout_relations", F.lit(rel("rIdT", "theme", "../theme/theme1.xml"))))),
        pk.part(sheets, F.concat(F.lit("ppt/slideLayouts/slideLayout"), m, F.lit(".xml")), wrap(f'<p:sldLayout {_NS} type="blank" preserve="1" showMasterSp="0">', tree(F.concat("shade", "body"), F.col("ground")), "</p:sldLayout>")),
        pk.part(sheets, F.concat(F.lit("ppt/slideLayouts/_rels/slideLayout"), m, F.lit(".xml.rels")), rels(F.concat(F.lit(rel("rIdM", "slideMaster", "../slideMasters/slideMaster1.xml")), "relations"))),
        pk.part(book, "ppt/theme/theme1.xml", theme),
        pk.part(book, "[Content_Types].xml", wrap(f'<Types xmlns="{_PACKAGE}/content-types">{fixed}', F.concat("kinds", "layout_kinds"), "</Types>")),
        pk.part(book, "_rels/.rels", rels(F.lit(rel("rId1", "officeDocument", "ppt/presentation.xml")))),
        media,
    ]
    whole = out[0]
    for p in out[1:]:
        whole = whole.unionByName(p)
    return whole
