"""Slide shapes: classes, sizes that fit, colors that show."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from vellum.functions import color, units
from vellum.functions import text as tx
from vellum.operators import joins, recursion

# Candidate sizes in 1/100 point, connector shape types.
SIZES = (2000, 1800, 1600, 1400, 1200, 1100, 1000, 900, 800, 700, 600)
CONNECTORS = (20, *range(32, 41))
FONT = "微软雅黑"  # the font of texts that name none
# End of fixed values.
#: EMU of 1/100 point; line height and character width as shares of the size.
EMU, LINE, GLYPH = 127, 1.2, 0.85
#: Width of the cells, in EMU, by which shapes meet what lies behind them.
CELL = 2_000_000


def largest_fit(width: Column, height: Column, lengths: Column, spacing: Column | None = None, most: Column | None = None) -> Column:
    """The largest candidate, ``most`` at most, at which lines of the given
    lengths, wrapped to the width, stay within the height; the least where none
    does. No join and no rows for candidates: each is a test on the same row."""
    line = F.lit(LINE) if spacing is None else F.when(spacing > 1, spacing).otherwise(LINE)

    def fits(size: int) -> Column:
        per_line = F.greatest(F.lit(1), F.floor(width / (size * EMU * GLYPH)))
        n = F.aggregate(lengths, F.lit(0).cast("double"), lambda acc, x: acc + F.greatest(F.lit(1.0), F.ceil(x / per_line).cast("double")))
        return n * size * EMU * line <= height

    out = F.lit(SIZES[-1])
    for size in reversed(SIZES):
        out = F.when(fits(size) if most is None else (most >= size) & fits(size), size).otherwise(out)
    return out


def is_connector(shape_type: Column) -> Column:
    return shape_type.isin(*CONNECTORS)


def is_full_page(width: Column, height: Column, page_width: Column, page_height: Column) -> Column:
    """An image over more than seven tenths of the page both ways."""
    return (width * 10 > page_width * 7) & (height * 10 > page_height * 7)


def is_watermark(left: Column, top: Column, width: Column, height: Column, page_width: Column, page_height: Column, cropped: Column) -> Column:
    """A small whole image in the lower part of the page."""
    return ~cropped & (width * 10 <= page_width * 4) & (top * 2 > page_height) & ((top + height) * 4 > page_height * 3)


def is_filled(fill: Column, no_fill: Column, opacity: Column) -> Column:
    """A fill that shows: less than a fifth of full opacity counts as none."""
    faint = opacity.between(0, 13106)
    return (F.coalesce(F.length(fill), F.lit(0)) > 0) & ~F.coalesce(no_fill, F.lit(False)) & ~F.coalesce(faint, F.lit(False))


def _let(value: Column, then: Callable[[Column], Column]) -> Column:
    """``then`` of a value that stands in the expression once, however often
    ``then`` uses it."""
    return F.get(F.transform(F.array(value), then), 0)


def visible_color(text: Column, raw: Column, fill: Column, filled: Column, dark_behind: Column, image_behind: Column, scheme: Column, in_title: Column) -> Column:
    """A text's color so that it shows on what lies behind.

    What isn't set is white on dark and the scheme's ink on light. The scheme's
    own paper color, as a reference to it, stays on dark and colored ground
    and becomes ink on light. Of colors as such, dark ones that can't be told
    from a dark fill and black on dark ground become white, those of the fill
    itself ink, and near white ones on white ground ink."""
    some = lambda c: F.coalesce(c, F.lit(False))
    paper, ink = F.get(scheme, 0), F.get(scheme, 1)
    ink_at_least = F.coalesce(ink, F.lit("000000"))
    high, low = F.shiftrightunsigned(raw.cast("long"), 24).bitwiseAND(F.lit(255)), raw.bitwiseAND(F.lit(0xFFFFFF))
    unset = (F.coalesce(F.length(text), F.lit(0)) == 0) | (F.coalesce(raw, F.lit(0)) == 0)
    of_paper = some(((high == 0xFE) & (low == 0)) | ((high == 8) & (low.bitwiseAND(F.lit(255)) == 0))) & some(text == paper)

    def on_ground(g: Column) -> Column:
        dark_fill, pale_fill, behind = g["dark"], g["pale"], g["behind"]
        colored = filled & (paper.isNull() | (fill != paper)) & ~pale_fill
        on_paper = F.when(dark_fill | colored | behind, text).otherwise(ink_at_least)
        fixed = F.when(dark_fill & color.is_dark(text) & color.is_low_contrast(text, fill), "FFFFFF").when(filled & ~dark_fill & some(text == fill), ink_at_least).when(behind & (text == "000000"), "FFFFFF").otherwise(text)
        open_ = ~filled & ~dark_behind & ~image_behind & ~in_title
        told = _let(fixed, lambda c: F.when(color.is_near_white(c) & (open_ | (filled & ~dark_fill & pale_fill)), ink_at_least).otherwise(c))
        return (
            F.when(unset & (dark_fill | behind | (~filled & in_title)), "FFFFFF")
            .when(unset, F.coalesce(ink, text))
            .when(of_paper, on_paper)
            .otherwise(told)
        )

    ground = F.struct((filled & color.is_dark(fill)).alias("dark"), color.is_near_white(fill).alias("pale"), (~filled & (dark_behind | image_behind)).alias("behind"))
    return _let(ground, on_ground)


#: Keys of a slide or master.
OWNER = ["path", "owner_kind", "owner_id"]


def placed(shapes: DataFrame) -> DataFrame:
    """Shapes, groups left out, with their boxes in EMU of the slide: x, y,
    cx, cy. A shape in a group is moved through all groups around it; one with
    an anchor of its own is where that says."""
    long = lambda c: F.coalesce(F.col(c), F.lit(0)).cast("long")
    boxes = shapes.select(
        *OWNER,
        F.col("z").cast("long").alias("id"),
        F.when(~F.col("own_anchor"), F.col("group_z")).cast("long").alias("parent"),
        *[long(a).alias(b) for a, b in (("l", "x"), ("t", "y"), ("w", "w"), ("h", "h"), ("gx", "gx"), ("gy", "gy"), ("gw", "gw"), ("gh", "gh"))],
    )
    moved = recursion.nested_boxes(boxes, OWNER).withColumnsRenamed({"id": "z", "w": "cx", "h": "cy"}).withColumn("z", F.col("z").cast("int"))
    emu = {c: units.from_master(F.col(c)) for c in ("x", "y", "cx", "cy")}
    return shapes.where("NOT is_group").join(moved.drop("level").withColumns(emu), [*OWNER, "z"])


def schemes(slides: DataFrame, table: DataFrame) -> DataFrame:
    """(path, owner_kind, owner_id, colors): each slide's scheme is that of its
    master, else its own."""
    of_master = table.where("owner_kind = 'master'").select("path", F.col("owner_id").alias("master_ref"), "colors")
    of_slide = table.where("owner_kind = 'slide'").select("path", F.col("owner_id").alias("slide_id"), F.col("colors").alias("own"))
    rows = slides.join(of_master, ["path", "master_ref"], "left").join(of_slide, ["path", "slide_id"], "left")
    rows = rows.select("path", F.lit("slide").alias("owner_kind"), F.col("slide_idx").cast("long").alias("owner_id"), F.coalesce("colors", "own").alias("colors"))
    return rows.unionByName(table.where("owner_kind = 'master'").select(*OWNER, "colors"))


def styled(runs: DataFrame, shapes: DataFrame, slides: DataFrame, scheme: DataFrame, master_styles: DataFrame) -> DataFrame:
    """Runs with size, font, flags and color: their own, else those of the
    master's style for the text's type and level, else of its level 0, else of
    the environment; colors through the scheme."""
    kinds = shapes.select(*OWNER, "z", "text_type")
    rows = runs.join(kinds, [*OWNER, "z"], "left").join(scheme, OWNER, "left")
    refs = slides.select("path", F.lit("slide").alias("owner_kind"), F.col("slide_idx").cast("long").alias("owner_id"), F.col("master_ref").alias("master_id"))
    rows = rows.join(refs, OWNER, "left").withColumn("master_id", F.when(F.col("owner_kind") == "master", F.col("owner_id")).otherwise(F.col("master_id")))
    rows = rows.withColumn("level", F.least(F.coalesce("level", F.lit(0)), F.lit(4)))
    props = ("font_size", "font_name", "bold", "italic", "color_raw")
    first = F.struct(*[F.col(p) for p in props])
    table = master_styles.groupBy("path", "master_id", "text_type", "level").agg(F.first(first, ignorenulls=True).alias("style"))
    env = table.where("master_id IS NULL").drop("master_id")
    own = table.where("master_id IS NOT NULL")
    for name, t, on in (("m", own, ["path", "master_id", "text_type", "level"]), ("m0", own.where("level = 0").drop("level"), ["path", "master_id", "text_type"]), ("e", env, ["path", "text_type", "level"]), ("e0", env.where("level = 0").drop("level"), ["path", "text_type"])):
        rows = rows.join(t.withColumnRenamed("style", name), on, "left")
    pick = lambda p: F.coalesce(F.when(F.col(p) != 0, F.col(p)) if p in ("font_size", "color_raw") else F.col(p), *[F.col(f"{s}.{p}") for s in ("m", "m0", "e", "e0")])
    rows = rows.withColumns({p: pick(p) for p in props})
    raw = F.col("color_raw")
    rgb = F.when(raw.isNotNull() & (raw != 0), color.from_reference(raw.cast("long")))
    none = F.array().cast("array<string>")
    # a scheme's index stands in the high byte, the color itself below 254
    return rows.withColumn("color", color.resolve(rgb, raw, F.coalesce("colors", none))).drop("m", "m0", "e", "e0", "colors", "master_id")


def colored(shapes: DataFrame, scheme: DataFrame) -> DataFrame:
    """Placed shapes with the colors of fills and lines through the scheme."""
    none = F.array().cast("array<string>")
    rows = shapes.join(scheme, OWNER, "left")
    found = {c: color.resolve(F.col(c), F.col(r), F.coalesce("colors", none)) for c, r in (("fill_color", "fill_raw"), ("line_color", "line_raw"))}
    return rows.withColumns(found).drop("colors")


def sized(runs: DataFrame, shapes: DataFrame) -> DataFrame:
    """Runs with a size and a font: their own, else the first that their
    paragraph has, else the first of their shape; a shape without any size
    takes the largest candidate at which its text fits."""
    by, order = [*OWNER, "z"], ["para_idx", "run_idx"]
    given = F.when(F.col("font_size") > 0, F.col("font_size"))
    name = F.when(F.length("font_name") > 0, F.col("font_name"))
    whole = lambda keys: Window.partitionBy(*keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    rows = runs.withColumns({"__para": F.first(given, ignorenulls=True).over(whole([*by, "para_idx"])), "__shape": F.first(given, ignorenulls=True).over(whole(by)), "__font": F.first(name, ignorenulls=True).over(whole(by))})
    # lines that a break ends count as one each, the last of a paragraph by its length
    text = F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("run_idx", "text"))), lambda r: r["text"]), "")
    paras = rows.where("__shape IS NULL").groupBy(*by, "para_idx").agg(text.alias("text"), F.max("line_spacing").alias("spacing"))
    cuts = F.split("text", "[\x0b\n]")
    lengths = F.transform(cuts, lambda t, i: F.when(i < F.size(cuts) - 1, 1).otherwise(F.char_length(t)))
    paras = paras.withColumns({"lengths": lengths, "chars": F.char_length(F.translate("text", "\x0b\n", ""))})
    bare = paras.groupBy(*by).agg(F.flatten(F.collect_list("lengths")).alias("lengths"), F.sum("chars").alias("chars"), F.count(F.lit(1)).alias("paras"), F.max("spacing").alias("spacing"))
    bare = bare.join(shapes.select(*by, "cx", "cy", "fill_color", "no_fill", "inset_left", "inset_top", "inset_right", "inset_bottom"), by)
    small = F.col("cy") < 500_000
    inset = lambda c, little, usual: F.coalesce(F.when(F.col(c) >= 0, F.col(c)), F.when(small, little).otherwise(usual))
    room = lambda size, a, b: F.when(size - a - b > 0, size - a - b).otherwise(size)
    # what every candidate is tried with is a column, not a part of each test
    bare = bare.withColumns({f"__{c}": inset(f"inset_{c}", *usual) for c, usual in (("top", (12700, 45720)), ("bottom", (12700, 45720)), ("left", (25400, 91440)), ("right", (25400, 91440)))})
    height = room(F.col("cy"), F.col("__top"), F.col("__bottom"))
    width = room(F.col("cx"), F.col("__left"), F.col("__right"))
    n, filled = F.col("chars"), (F.coalesce(F.length("fill_color"), F.lit(0)) > 0) & ~F.coalesce("no_fill", F.lit(False))
    wide = (F.col("cx") > F.col("cy") * 4) & (n > 20) & ((F.col("paras") > 1) | (n > 40))
    most = F.when((n.between(1, 14) & (F.col("paras") <= 1)) | (filled & (n > 40)) | wide, 1400).when(n.between(15, 40) & (F.col("paras") >= 2), 1600).otherwise(2000)
    bare = bare.withColumns({"__height": height, "__width": width, "__most": most, "__spacing": F.coalesce(F.col("spacing"), F.lit(0)) / 100})
    fit = F.when(F.col("cy") <= 0, 1400).otherwise(largest_fit(F.col("__width"), F.col("__height"), F.col("lengths"), F.col("__spacing"), F.col("__most")))
    rows = rows.join(bare.select(*by, (fit / 100).cast("int").alias("__fit")), by, "left")
    size = F.coalesce(given, F.col("__para"), F.col("__shape"), F.col("__fit"))
    return rows.withColumns({"font_size": size, "font_name": F.coalesce(name, F.col("__font"), F.lit(FONT))}).drop("__para", "__shape", "__font", "__fit")


def _center(c: str, size: str) -> Column:
    return F.col(c) + F.floor(F.col(size) / 2)


def grounds(shapes: DataFrame, slides: DataFrame, masters_back: DataFrame) -> DataFrame:
    """(owner, z, dark_behind, image_behind, in_title) of shapes of slides: a
    dark ground is the master's or a colored shape drawn before and under the
    center; a picture of the layout counts if it is large and begins at the
    left; a title stands above a line of the layout that is as good as whole.
    ``masters_back`` has (path, owner_id, color, image_idx) of masters."""
    own = shapes.where("owner_kind = 'slide'")
    fill = is_filled(F.col("fill_color"), F.col("no_fill"), F.col("fill_opacity"))
    rows = own.withColumns({"__filled": fill, "__shown": fill & ~color.is_near_white(F.col("fill_color"))})
    x, y = _center("x", "cx"), _center("y", "cy")
    under = joins.in_front_of(rows, OWNER, "z", (x, y), ("x", "y", "cx", "cy"), ~F.col("__filled"), F.col("__shown"), CELL).select(*OWNER, "z", F.lit(True).alias("under"))
    refs = slides.select("path", F.lit("slide").alias("owner_kind"), F.col("slide_idx").cast("long").alias("owner_id"), F.col("master_ref").alias("__master"))
    at = own.join(refs, OWNER, "left").select(*OWNER, "z", "__master", x.alias("__x"), y.alias("__y"))
    of_master = shapes.where("owner_kind = 'master'").withColumnRenamed("owner_id", "__master")
    back = masters_back.select("path", F.col("owner_id").alias("__master"), (F.col("image_idx").isNotNull() | color.is_dark(F.col("color"))).alias("dark"))
    large = of_master.where("image_idx IS NOT NULL AND cx >= 3000000 AND cy >= 2000000 AND x <= 500000")
    large = large.select("path", "__master", F.col("x").alias("l"), F.col("y").alias("t"), (F.col("x") + F.col("cx")).alias("r"), (F.col("y") + F.col("cy")).alias("b"))
    on = ["path", "__master"]
    shown = at.join(large, on).where(F.col("__x").between(F.col("l"), F.col("r")) & F.col("__y").between(F.col("t"), F.col("b"))).select(*OWNER, "z", F.lit(True).alias("image")).distinct()
    line = of_master.where(is_connector(F.col("shape_type")) & (F.col("cy") == 0) & (F.col("cx") > 6_000_000)).groupBy(*on).agg(F.max_by("y", "z").alias("line"))
    out = at.join(back, on, "left").join(line, on, "left").join(under, [*OWNER, "z"], "left").join(shown, [*OWNER, "z"], "left")
    some = lambda c: F.coalesce(c, F.lit(False))
    return out.select(*OWNER, "z", (some(F.col("dark")) | some(F.col("under"))).alias("dark_behind"), some(F.col("image")).alias("image_behind"), some((F.col("line") > 0) & (F.col("__y") < F.col("line"))).alias("in_title"))


def shown(runs: DataFrame, shapes: DataFrame, scheme: DataFrame, ground: DataFrame) -> DataFrame:
    """Runs in colors that show; see ``visible_color``. Shapes of masters
    have no ground but their own fill."""
    fill = is_filled(F.col("fill_color"), F.col("no_fill"), F.col("fill_opacity"))
    about = shapes.select(*OWNER, "z", F.col("fill_color").alias("__fill"), fill.alias("__filled"))
    rows = runs.join(about, [*OWNER, "z"], "left").join(scheme, OWNER, "left").join(ground, [*OWNER, "z"], "left")
    some = lambda c: F.coalesce(c, F.lit(False))
    ink = visible_color(F.col("color"), F.col("color_raw"), F.col("__fill"), some(F.col("__filled")), some(F.col("dark_behind")), some(F.col("image_behind")), F.coalesce("colors", F.array().cast("array<string>")), some(F.col("in_title")))
    return rows.withColumn("color", ink).drop("__fill", "__filled", "colors", "dark_behind", "image_behind", "in_title")


def layered(shapes: DataFrame, runs: DataFrame, layouts_of: DataFrame, info: DataFrame) -> DataFrame:
    """Shapes of masters by the layout they belong to, with their layer: back
    (a picture as good as whole, the first of a layout), plain, or over (a
    watermark, drawn on the slides). What only invites to edit is left out."""
    hints = runs.where(F.col("owner_kind") == "master").where(tx.is_edit_hint(F.trim("text"))).select(*OWNER, "z").distinct()
    rows = shapes.where("owner_kind = 'master'").join(hints, [*OWNER, "z"], "left_anti")
    rows = rows.join(layouts_of.select("path", F.col("master_ref").alias("owner_id"), "layout_idx"), ["path", "owner_id"])
    rows = rows.join(info.select("path", units.from_master(F.col("width")).alias("__w"), units.from_master(F.col("height")).alias("__h")), "path")
    picture = F.col("image_idx").isNotNull()
    cropped = F.greatest(*[F.coalesce(c, F.lit(0)) for c in ("crop_top", "crop_bottom", "crop_left", "crop_right")]) > 1000
    box = [F.col(c) for c in ("x", "y", "cx", "cy", "__w", "__h")]
    kind = F.when(picture & is_full_page(*box[2:]), "back").when(picture & is_watermark(*box, cropped), "over").otherwise("plain")
    return rows.withColumn("layer", kind).drop("__w", "__h")


def title_grounds(shapes: DataFrame, runs: DataFrame, slides: DataFrame, info: DataFrame) -> DataFrame:
    """(path, layout_idx, color, bottom): layouts whose titles are white and
    name a ground of their own: above the layout's first line of over half the
    slide, the first bold white run of at least 24 points without a fill whose
    reference holds a color."""
    pages = slides.select("path", "slide_idx", "layout_idx", F.col("master_ref").alias("__master"))
    line = shapes.where((F.col("owner_kind") == "master") & is_connector(F.col("shape_type")) & (F.col("cy") == 0)).join(info.select("path", units.from_master(F.col("width")).alias("__w")), "path")
    line = line.where("cx > __w / 2").groupBy("path", F.col("owner_id").alias("__master")).agg(F.min_by("y", "z").alias("bottom")).where("bottom > 0")
    filled = (F.coalesce(F.length("fill_color"), F.lit(0)) > 0) & ~F.coalesce("no_fill", F.lit(False))
    heads = shapes.where("owner_kind = 'slide'").where(~filled).select("path", F.col("owner_id").cast("int").alias("slide_idx"), "z", _center("y", "cy").alias("__y"))
    heads = heads.join(pages, ["path", "slide_idx"]).join(line, ["path", "__master"]).where("__y < bottom")
    low = F.col("color_raw").bitwiseAND(F.lit(0xFFFFFF))
    bright = runs.where("owner_kind = 'slide'").where((F.col("color") == "FFFFFF") & F.col("bold") & (F.col("font_size") >= 24) & (F.shiftrightunsigned(F.col("color_raw").cast("long"), 24) == 0xFE) & (low.bitwiseAND(F.lit(0xFFFF00)) != 0))
    bright = bright.select("path", F.col("owner_id").cast("int").alias("slide_idx"), "z", "para_idx", "run_idx", color.from_reference(low.cast("long")).alias("ground"))
    met = heads.join(bright, ["path", "slide_idx", "z"])
    return met.groupBy("path", "layout_idx").agg(F.min_by(F.struct(F.col("ground").alias("color"), "bottom"), F.struct("slide_idx", "z", "para_idx", "run_idx")).alias("g")).select("path", "layout_idx", "g.*")


def empty_slides(slides: DataFrame, runs: DataFrame) -> DataFrame:
    """Slides without a text that is more than a placeholder or decoration."""
    said = runs.where("owner_kind = 'slide'").withColumn("t", F.trim("text")).where((F.length("t") > 0) & ~tx.is_placeholder(F.col("t")))
    said = said.select("path", F.col("owner_id").cast("int").alias("slide_idx")).distinct()
    return slides.join(said, ["path", "slide_idx"], "left_anti")


def layouts(slides: DataFrame) -> DataFrame:
    """(path, master_ref, layout_idx): masters by their first slide, from 0."""
    first = slides.where("master_ref IS NOT NULL").groupBy("path", "master_ref").agg(F.min("slide_idx").alias("first"))
    return first.select("path", "master_ref", (F.dense_rank().over(Window.partitionBy("path").orderBy("first")) - 1).alias("layout_idx"))


def backgrounds(slides: DataFrame, table: DataFrame, scheme: DataFrame) -> DataFrame:
    """(path, slide_idx, color, image_idx): each slide's background, its own
    before its master's, colors through the scheme."""
    part = F.struct("color", "color_raw", "image_idx")
    own = table.where("owner_kind = 'slide'").select("path", F.col("owner_id").cast("int").alias("slide_idx"), part.alias("own"))
    master = table.where("owner_kind = 'master'").select("path", F.col("owner_id").alias("master_ref"), part.alias("inherited"))
    colors = scheme.where("owner_kind = 'slide'").select("path", F.col("owner_id").cast("int").alias("slide_idx"), "colors")
    rows = slides.join(own, ["path", "slide_idx"], "left").join(master, ["path", "master_ref"], "left").join(colors, ["path", "slide_idx"], "left")
    fill = F.coalesce("own", "inherited")
    none = F.array().cast("array<string>")
    return rows.where(fill.isNotNull()).select("path", "slide_idx", color.resolve(fill["color"], fill["color_raw"], F.coalesce("colors", none)).alias("color"), fill["image_idx"].alias("image_idx"))


def master_backgrounds(table: DataFrame, scheme: DataFrame) -> DataFrame:
    """(path, owner_id, color, image_idx) of masters."""
    rows = table.where("owner_kind = 'master'").join(scheme.where("owner_kind = 'master'").select("path", "owner_id", "colors"), ["path", "owner_id"], "left")
    return rows.select("path", "owner_id", color.resolve(F.col("color"), F.col("color_raw"), F.coalesce("colors", F.array().cast("array<string>"))).alias("color"), "image_idx")
