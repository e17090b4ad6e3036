"""From files to packages: the three conversions, each from (path, content) to
(path, content, _error, _partial) with a row for every file. A file is read
once; what its tables hold goes to the shared folder."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vellum.operators import document as dm
from vellum.operators import packages, tables
from vellum.operators import slides as sl
from vellum.sinks import docx, pptx, xlsx
from vellum.sources import readers

XLS_TABLES = ("xls_cells", "xls_sst", "xls_sheets")
DOC_TABLES = ("doc_text", "doc_para_runs", "doc_char_runs", "doc_styles", "doc_lists", "doc_list_overrides", "doc_sections", "doc_stories", "doc_images", "doc_inline_pictures", "doc_spa", "doc_shape_pictures", "doc_textboxes")


def _parsed(source: DataFrame, names: tuple[str, ...], **options) -> tuple[DataFrame, dict[str, DataFrame]]:
    """All tables of the files, dealt by table, and each without its errors."""
    raw = tables.stored(readers.parse_all(source, names, **options), "parsed", by=["table"])
    return raw, {t: readers.of(raw, t) for t in names}


def _with_errors(source: DataFrame, packages: DataFrame, raw: DataFrame, first: str) -> DataFrame:
    """A row for each file: its package, or what is wrong with it; _partial
    says what else of it couldn't be read, so that the package lacks it."""
    wrong = raw.where(F.col("_error").isNotNull()).groupBy("path").agg(
        F.first(F.when(F.col("table") == first, F.col("_error")), ignorenulls=True).alias("_error"),
        F.array_join(F.array_sort(F.collect_set(F.when(F.col("table") != first, F.concat_ws(": ", "table", "_error")))), "; ").alias("_partial"),
    )
    out = source.select("path").join(wrong, "path", "left").join(packages, "path", "left")
    failed = F.col("_error").isNotNull()
    error = F.when(failed, F.col("_error")).when(F.col("content").isNull(), "nothing to write")
    return out.select("path", F.when(~failed, F.col("content")).alias("content"), error.alias("_error"), F.when(~failed & (F.col("_partial") != ""), F.col("_partial")).alias("_partial"))


def xls_to_xlsx(source: DataFrame, **options) -> DataFrame:
    """Workbooks to spreadsheet packages."""
    raw, t = _parsed(source, XLS_TABLES, **options)
    return _with_errors(source, xlsx.packages(t["xls_cells"], t["xls_sst"], t["xls_sheets"]), raw, "xls_cells")


def doc_to_docx(source: DataFrame, plain: bool = False, **options) -> DataFrame:
    """Documents to text packages: paragraphs, runs, tables, lists, contents,
    headers and footers, pictures. A side table that can't be read counts as
    empty, so what there is of text always comes out; with ``plain`` the text
    alone, and the pictures behind it."""
    if plain:
        raw, t = _parsed(source, ("doc_text", "doc_images"), **options)
        return _with_errors(source, packages.zipped(docx.plain_parts(t["doc_text"].select("path", "text"), t["doc_images"])), raw, "doc_text")
    raw, t = _parsed(source, DOC_TABLES, **options)
    paras = dm.paragraphs(t["doc_text"], t["doc_para_runs"], t["doc_styles"], t["doc_lists"], t["doc_list_overrides"], t["doc_sections"])
    paras = tables.stored(dm.repaired_tables(tables.stored(paras, "paragraphs")), "repaired")
    paras = tables.stored(dm.laid_out(paras), "laidout")
    runs = tables.stored(dm.runs(paras, t["doc_char_runs"]), "runs")
    targets = tables.stored(dm.contents(paras), "contents")
    slots = tables.stored(dm.shape_slots(t["doc_spa"], t["doc_shape_pictures"]), "slots")
    inline = t["doc_inline_pictures"].select("path", (F.col("pic_idx") + dm.INLINE).alias("image_idx"), "format", "data")
    images = tables.stored(t["doc_images"].unionByName(inline), "images")
    # of the pictures drawn in one paragraph the largest counts
    placed = dm.largest_picture(dm.drawn_pictures(paras, slots), images).select("path", "para_idx", "ord", "image_idx")
    placed = tables.stored(placed.unionByName(dm.inline_pictures(runs, t["doc_inline_pictures"])), "placed")
    boxes = tables.stored(dm.boxes_at(paras, t["doc_textboxes"], slots), "boxes")
    heads = t["doc_stories"]
    pictured = dm.header_pictures(heads, dm.shape_slots(t["doc_spa"], t["doc_shape_pictures"], "header"), dm.story_starts(heads))
    pictured = tables.stored(pictured, "pictured")
    parts = docx.parts(paras, runs, dm.stories(heads, pictured), images, targets, placed, boxes, pictured)
    return _with_errors(source, packages.zipped(parts), raw, "doc_text")


PPT_TABLES = ("ppt_presentations", "ppt_slides", "ppt_shapes", "ppt_runs", "ppt_schemes", "ppt_master_styles", "ppt_texts", "ppt_images", "ppt_backgrounds", "ppt_geometry")


def ppt_to_pptx(source: DataFrame, keep_empty: bool = True, plain: bool = False) -> DataFrame:
    """Presentations to slide packages: shapes in place, runs with their
    masters' styles and schemes, pictures. ``keep_empty`` off leaves out
    slides without a text that says something; ``plain`` puts each slide's
    texts into one box and leaves out all else."""
    raw, t = _parsed(source, PPT_TABLES)
    slides = t["ppt_slides"]
    if not keep_empty:
        slides = tables.stored(slides.join(sl.empty_slides(slides, t["ppt_runs"]).select("path", "slide_idx"), ["path", "slide_idx"], "left_anti"), "slides")
    # slides without a master share a layout of their own
    slides = slides.withColumn("master_ref", F.coalesce("master_ref", F.lit(0)))
    slides = tables.stored(slides.join(sl.layouts(slides), ["path", "master_ref"]), "pages")
    scheme = tables.stored(sl.schemes(slides, t["ppt_schemes"]), "schemes")
    placed = tables.stored(sl.colored(sl.placed(t["ppt_shapes"]), scheme), "placed")
    styled = tables.stored(sl.styled(t["ppt_runs"], placed, slides, scheme, t["ppt_master_styles"]), "styled")
    runs = tables.stored(sl.sized(styled, placed), "sized")
    masters = tables.stored(sl.master_backgrounds(t["ppt_backgrounds"], scheme), "grounds")
    ground = tables.stored(sl.grounds(placed, slides, masters), "behind")
    runs = tables.stored(sl.shown(runs, placed, scheme, ground), "shown")
    layers = tables.stored(sl.layered(placed, runs, slides.select("path", "master_ref", "layout_idx").distinct(), t["ppt_presentations"]), "layers")
    titles = sl.title_grounds(placed, runs, slides, t["ppt_presentations"])
    kept = slides.select("path", F.lit("slide").alias("owner_kind"), F.col("slide_idx").cast("long").alias("owner_id"))
    drawn = placed.join(kept, sl.OWNER, "left_semi")
    if plain:
        drawn, layers, masters, titles = (x.where("false") for x in (drawn, layers, masters, titles))
    listed = t["ppt_texts"].join(slides.select("path", "slide_idx"), ["path", "slide_idx"], "left_semi")
    parts = pptx.parts(t["ppt_presentations"], slides, drawn, runs, t["ppt_images"], scheme, listed, sl.backgrounds(slides, t["ppt_backgrounds"], scheme), t["ppt_geometry"], layers, masters, titles)
    return _with_errors(source, packages.zipped(parts), raw, "ppt_presentations")
