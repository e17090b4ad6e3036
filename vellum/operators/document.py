"""Documents: paragraphs and runs from text and property runs, tables, styles,
lists, stories. Every step is a join or a window by ``path``."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from vellum.functions import text as tx
from vellum.operators import joins, recursion
from vellum.operators import sequence as seq

CHAR = ["font_name", "font_size", "bold", "italic", "underline", "color"]
PARA = ["alignment", "indent_left", "indent_right", "indent_first", "space_before", "space_after", "line_spacing", "line_rule"]
#: Half-points of text whose styles give no size.
SIZE = 21
BODY = 9
BY, ORDER = ["path"], ["para_idx"]


def styles(table: DataFrame) -> DataFrame:
    """Each style with its properties inherited: the nearest value that is
    set wins, flags that are off and sizes of zero count as not set, and the
    line rule comes from where the line spacing does."""
    flat = table.select("path", "istd", "name", "sti", "istd_base", *[F.col(f"char_props.{c}").alias(c) for c in CHAR], *[F.col(f"para_props.{c}").alias(c) for c in PARA])
    for c in ("bold", "italic"):
        flat = flat.withColumn(c, F.when(F.col(c), True))
    for c in ("font_size", "underline", *PARA[1:7]):
        flat = flat.withColumn(c, F.when(F.col(c) != 0, F.col(c)))
    for c in ("font_name", "color"):
        flat = flat.withColumn(c, F.when(F.length(c) > 0, F.col(c)))
    flat = flat.withColumn("line", F.when(F.col("line_spacing").isNotNull(), F.struct("line_spacing", "line_rule")))
    props = [*CHAR, *PARA[:6], "line"]
    got = recursion.inherit(flat, BY, "istd", "istd_base", props)
    got = got.withColumns({"line_spacing": F.col("line.line_spacing"), "line_rule": F.col("line.line_rule"), "istd": F.col("istd").cast("int")}).drop("line")
    return flat.select("path", "istd", "name", "sti").join(got, ["path", "istd"])


def lists(table: DataFrame, overrides: DataFrame) -> DataFrame:
    """(path, ilfo, ilvl, ordered, nfc, lvl_text): two hops from a list's
    number in a paragraph to each of its levels."""
    levels = table.select("path", "list_id", F.col("level").alias("ilvl"), "ordered", "nfc", "lvl_text")
    return overrides.join(levels, ["path", "list_id"]).drop("list_id")


def paragraphs(texts: DataFrame, para_runs: DataFrame, style_table: DataFrame, list_table: DataFrame, overrides: DataFrame, sections: DataFrame) -> DataFrame:
    """doc_paragraphs: para_idx, place, text, flags and properties.

    A paragraph takes the first property run that meets it, its style by that,
    and its list by two hops; without a run it is plain text of style 0. A
    property of its own wins over its style's.
    """
    rows = seq.split_paragraphs(texts, "text", "\r\x07", path="path")
    rows = rows.withColumn("cp_end", F.col("cp_start") + F.char_length("text"))
    runs = para_runs.select("path", "run_idx", F.col("cp_start").alias("r_start"), F.col("cp_end").alias("r_end"), "istd", "in_table", "row_end", "ilfo", "ilvl", "page_break_before", "out_lvl", "cell_widths", *[F.col(c).alias(f"own_{c}") for c in PARA])
    spans = rows.withColumn("p_end", F.greatest(F.col("cp_end"), F.col("cp_start") + 1))
    met = joins.overlaps(spans.select("path", "para_idx", "cp_start", "p_end"), runs, BY, "cp_start", "p_end", "r_start", "r_end")
    met = seq.first_wins(met, ["path", "para_idx"], [F.col("run_idx")]).drop("cp_start", "p_end", "clip_start", "clip_end", "r_start", "r_end", "run_idx")
    rows = rows.join(met, ["path", "para_idx"], "left").withColumn("istd", F.coalesce("istd", F.lit(0)))
    rows = rows.join(styles(style_table).withColumnsRenamed({c: f"style_{c}" for c in [*CHAR, *PARA]}), ["path", "istd"], "left")
    rows = rows.withColumn("ilvl", F.coalesce("ilvl", F.lit(0))).join(lists(list_table, overrides), ["path", "ilfo", "ilvl"], "left")
    # the section that ends in a paragraph, but for the last of the document
    ends = sections.withColumn("__last", F.max("section_idx").over(Window.partitionBy("path"))).where(F.col("section_idx") < F.col("__last"))
    ends = ends.select("path", (F.col("cp_end") - 1).alias("mark"), "bkc")
    hit = joins.points_in_ranges(ends, rows.select("path", "para_idx", F.col("cp_start").alias("s"), (F.col("cp_end") + 1).alias("e")), BY, "mark", "s", "e", ["para_idx"], ["para_idx"])
    hit = hit.where(F.col("para_idx").isNotNull()).groupBy("path", "para_idx").agg(F.max("bkc").alias("section_kind"))
    rows = rows.join(hit, ["path", "para_idx"], "left")
    flag = lambda c: F.coalesce(F.col(c), F.lit(False))
    cell = F.coalesce(F.col("separator") == 7, F.lit(False))
    empty = F.col("text") == ""
    level = tx.heading_level(F.coalesce("out_lvl", F.lit(BODY)), F.coalesce("sti", F.lit(0)), F.coalesce("name", F.lit("")))
    toc = tx.toc_level(F.coalesce("sti", F.lit(0)))
    own = [F.coalesce(F.when(F.col(f"own_{c}") != 0, F.col(f"own_{c}")) if c != "alignment" else F.col("own_alignment"), F.col(f"style_{c}")).alias(c) for c in PARA[:6]]
    line = F.coalesce(F.when(F.col("own_line_spacing") != 0, F.struct(F.col("own_line_spacing").alias("a"), F.col("own_line_rule").alias("b"))), F.struct(F.col("style_line_spacing").alias("a"), F.col("style_line_rule").alias("b")))
    return rows.select(
        "path",
        "para_idx",
        "cp_start",
        "cp_end",
        "text",
        "separator",
        "istd",
        (flag("in_table") | cell).alias("in_table"),
        cell.alias("cell_end"),
        (empty & (flag("row_end") | (F.coalesce(F.size("cell_widths"), F.lit(0)) > 0))).alias("row_end"),
        "cell_widths",
        F.col("text").contains("\x0c").alias("page_break"),
        flag("page_break_before").alias("page_break_before"),
        F.col("section_kind").isNotNull().alias("section_break"),
        "section_kind",
        F.when(toc > 0, 0).otherwise(level).alias("heading_level"),
        toc.alias("toc_level"),
        (F.coalesce("ilfo", F.lit(0)) > 0).alias("list_item"),
        "ilfo",
        "ilvl",
        F.coalesce("ordered", F.lit(False)).alias("ordered"),
        F.coalesce("nfc", F.lit(23)).alias("nfc"),
        F.coalesce("lvl_text", F.lit("")).alias("lvl_text"),
        *own,
        line["a"].alias("line_spacing"),
        line["b"].alias("line_rule"),
        *[F.col(f"style_{c}").alias(f"default_{c}") for c in CHAR],
    )


def visible(text: Column) -> Column:
    """Stretches (start, end) of a paragraph that show: outside of field
    instructions, marks left out by ``runs``."""
    cuts = F.regexp_extract_all(text, F.lit("([\x13\x14\x15]|[^\x13\x14\x15]+)"), F.lit(1))
    none = F.array().cast("array<struct<start:int,end:int>>")
    start = F.struct(F.lit(0).alias("at"), F.lit(0).alias("depth"), F.lit(False).alias("hidden"), none.alias("shown"))

    def step(acc: Column, cut: Column) -> Column:
        depth = F.when(cut == "\x13", acc["depth"] + 1).when(cut == "\x15", F.greatest(acc["depth"] - 1, F.lit(0))).otherwise(acc["depth"])
        hidden = F.when(cut == "\x13", True).when(cut == "\x14", False).when((cut == "\x15") & (depth == 0), False).otherwise(acc["hidden"])
        end = acc["at"] + F.char_length(cut)
        skip = cut.isin("\x13", "\x14", "\x15") | ((acc["depth"] > 0) & acc["hidden"])
        shown = F.when(skip, acc["shown"]).otherwise(F.concat(acc["shown"], F.array(F.struct(acc["at"].alias("start"), end.alias("end")))))
        return F.struct(end.alias("at"), depth.alias("depth"), hidden.alias("hidden"), shown.alias("shown"))

    return F.aggregate(cuts, start, step)["shown"]


def runs(paras: DataFrame, char_runs: DataFrame) -> DataFrame:
    """doc_runs: (path, para_idx, run_idx, text, properties, pic_location).

    Character runs that meet a paragraph are clipped to it, begin no earlier
    than what earlier ones cover, and what none covers takes the defaults. A
    run's own properties win over the defaults, but on flags stay on. Runs
    that show nothing go; a paragraph that shows nothing keeps an empty one.
    """
    spans = paras.where(F.col("cp_end") > F.col("cp_start")).select("path", "para_idx", "cp_start", "cp_end")
    own = char_runs.select("path", "run_idx", F.col("cp_start").alias("r_start"), F.col("cp_end").alias("r_end"), *CHAR, "pic_location")
    met = joins.overlaps(spans, own, BY, "cp_start", "cp_end", "r_start", "r_end")
    w = Window.partitionBy("path", "para_idx").orderBy("r_start", "run_idx")
    reach = F.coalesce(F.max("clip_end").over(seq.before(w)), F.col("cp_start"))
    met = met.withColumn("reach", reach).withColumn("from", F.greatest("clip_start", "reach")).where(F.col("from") < F.col("clip_end"))
    shown = met.select("path", "para_idx", F.col("from").alias("a"), F.col("clip_end").alias("b"), *CHAR, "pic_location")
    blank = [F.lit(None).cast(t).alias(c) for c, t in zip([*CHAR, "pic_location"], ["string", "int", "boolean", "boolean", "int", "string", "bigint"])]
    gaps = met.where(F.col("from") > F.col("reach")).select("path", "para_idx", F.col("reach").alias("a"), F.col("from").alias("b"), *blank)
    ends = spans.join(met.groupBy("path", "para_idx").agg(F.max("clip_end").alias("a")), ["path", "para_idx"], "left")
    ends = ends.select("path", "para_idx", F.coalesce("a", "cp_start").alias("a"), F.col("cp_end").alias("b")).where("a < b").select("*", *blank)
    whole = shown.unionByName(gaps).unionByName(ends)
    defaults = [F.col(f"default_{c}") for c in CHAR]
    text = paras.select("path", "para_idx", "cp_start", F.col("text").alias("body"), visible(F.col("text")).alias("shown"), *defaults)
    rows = whole.join(text, ["path", "para_idx"])
    lo, hi = F.col("a") - F.col("cp_start"), F.col("b") - F.col("cp_start")
    parts = F.transform(F.filter("shown", lambda s: (s["start"] < hi) & (s["end"] > lo)), lambda s: F.substring(F.col("body"), (F.greatest(s["start"], lo) + 1).cast("int"), (F.least(s["end"], hi) - F.greatest(s["start"], lo)).cast("int")))
    rows = rows.withColumn("text", F.translate(F.array_join(parts, ""), "\x02\x03\x04\x05\x07\x08\x0c", "")).where(F.length("text") > 0)
    set_ = {"font_name": F.length("font_name") > 0, "font_size": F.col("font_size") != 0, "bold": F.col("bold"), "italic": F.col("italic"), "underline": F.col("underline") != 0, "color": F.length("color") > 0}
    zero = {"font_size": SIZE, "bold": False, "italic": False, "underline": 0}
    merged = lambda c: F.coalesce(F.when(set_[c], F.col(c)), F.col(f"default_{c}"), *([F.lit(zero[c])] if c in zero else [])).alias(c)
    rows = rows.select("path", "para_idx", "a", "text", *[merged(c) for c in CHAR], "pic_location")
    bare = text.join(rows.select("path", "para_idx").distinct(), ["path", "para_idx"], "left_anti")
    bare = bare.select("path", "para_idx", F.col("cp_start").alias("a"), F.lit("").alias("text"), *[F.coalesce(F.col(f"default_{c}"), F.lit(zero.get(c)).cast(dict(rows.dtypes)[c])).alias(c) for c in CHAR], F.lit(None).cast("bigint").alias("pic_location"))
    rows = rows.unionByName(bare)
    order = Window.partitionBy("path", "para_idx").orderBy("a")
    return rows.withColumn("run_idx", F.row_number().over(order) - 1).drop("a")


def repaired_tables(paras: DataFrame) -> DataFrame:
    """Single gaps in tables filled, and row ends that a table lacks set: an
    empty unmarked paragraph right behind as many cells as the table has
    columns, with the widths of the next marked row. Each table repeats from
    its last row end on, so places count from there."""
    rows = seq.fill_single_gaps(paras, BY, ORDER, "in_table")
    columns = seq.table_columns(rows, BY, ORDER, F.col("in_table"), F.col("row_end"), F.col("text") != "")
    rows = rows.join(columns, "path")
    rows = seq.islands(rows, BY, ORDER, [F.col("in_table")], "__table")
    w = seq.ordered([*BY, "__table"], ORDER)
    rows = rows.withColumn("__row", F.coalesce(F.sum(F.col("row_end").cast("int")).over(seq.before(w)), F.lit(0)))
    place = F.row_number().over(seq.ordered([*BY, "__table", "__row"], ORDER))
    # with every row end in its place, each row takes the columns and one more
    due = F.col("in_table") & ~F.col("row_end") & (F.col("n_columns") > 0) & (F.col("text") == "") & (place % (F.col("n_columns") + 1) == 0)
    rows = rows.withColumn("__due", due)
    widths = F.first(F.when(F.col("row_end") & (F.size("cell_widths") > 0), F.col("cell_widths")), ignorenulls=True).over(seq.onward(seq.ordered(BY, ORDER)))
    rows = rows.withColumn("cell_widths", F.when(F.col("__due"), widths).otherwise(F.col("cell_widths")))
    return rows.withColumn("row_end", F.col("row_end") | F.col("__due")).drop("__table", "__row", "__due", "n_columns")


def laid_out(paras: DataFrame) -> DataFrame:
    """Paragraphs as they go into a package: list numbers, page breaks before
    cover sections, empty runs reduced. The cover is what comes before the
    first heading."""
    whole = Window.partitionBy("path")
    w = seq.ordered(BY, ORDER)
    empty = tx.is_blank(tx.strip_field_codes(F.col("text"))) & ~F.col("text").contains("\x08") & ~F.col("text").contains("\x01")
    rows = paras.withColumn("empty", empty)
    rows = rows.withColumn("structural", F.col("section_break") | F.col("page_break") | F.col("page_break_before") | (F.col("heading_level") > 0) | (F.col("toc_level") > 0) | F.col("in_table") | F.col("list_item"))
    head = F.coalesce(F.min(F.when(F.col("heading_level") > 0, F.col("para_idx"))).over(whole), F.max("para_idx").over(whole) + 1)
    last_toc = F.max(F.when(F.col("toc_level") > 0, F.col("para_idx"))).over(whole)
    rows = rows.withColumns({"__head": head, "__toc": last_toc})
    rows = rows.withColumn("cover", F.col("para_idx") < F.col("__head"))
    gone = F.col("empty") & ~F.col("structural")
    rows = seq.run_places(rows, ["path", "cover"], ORDER, gone, "gone_place")
    rows = seq.page_breaks(rows, ["path", "cover"], ORDER, gone, ~F.col("empty") & ~F.col("in_table") & (F.col("toc_level") == 0) & F.col("cover"))
    skip = F.col("gone_place") > 1
    behind_toc = F.col("empty") & ~F.col("section_break") & (F.col("para_idx") > F.col("__toc")) & (F.col("para_idx") < F.col("__head"))
    drawn = F.coalesce(F.lag(F.col("text").contains("\x08")).over(w), F.lit(False))
    soft = F.col("empty") & ~F.col("section_break") & ~F.col("page_break") & ~F.col("in_table") & (F.col("heading_level") == 0) & (F.col("toc_level") == 0)
    nxt = lambda c: F.coalesce(F.lead(c).over(w), F.lit(False))
    rows = rows.withColumn("__heading", F.col("heading_level") > 0)
    before = F.col("empty") & ~F.col("section_break") & ~F.col("in_table") & ~F.col("page_break") & ~F.col("page_break_before") & (nxt("__heading") | nxt("page_break") | nxt("page_break_before"))
    # empties behind a drawing, one after the other: the run's first is behind it
    rows = rows.withColumns({"__soft": soft, "__drawn": drawn})
    rows = seq.islands(rows, BY, ORDER, [F.col("__soft")], "__run")
    led = F.max(F.col("__drawn").cast("int")).over(seq.upto(seq.ordered(["path", "__run"], ORDER))) == 1
    rows = rows.withColumn("skip", skip | F.coalesce(behind_toc, F.lit(False)) | (~F.col("cover") & ((F.col("__soft") & led) | before)))
    # the one kept empty paragraph right before a page break goes as well
    kept_break = F.when(~F.col("skip"), F.struct("para_idx", "break_before"))
    follow = F.first(kept_break, ignorenulls=True).over(w.rowsBetween(1, Window.unboundedFollowing))
    rows = rows.withColumn("skip", F.col("skip") | (F.col("empty") & ~F.col("section_break") & ~F.col("page_break") & F.coalesce(follow["break_before"], F.lit(False))))
    rows = seq.number_lists(rows, BY, ORDER, F.col("list_item"), F.col("heading_level") > 0, F.col("ilfo"), F.col("ordered"))
    lead = F.min((F.col("section_break") & F.col("empty")).cast("int")).over(seq.upto(w)) == 1
    rows = rows.withColumn("skip", F.col("skip") | lead)
    return rows.drop("__head", "__toc", "gone_place", "__heading", "__soft", "__drawn", "__run", "structural")


def contents(paras: DataFrame) -> DataFrame:
    """(path, para_idx, target): table-of-contents entries with their heading's
    paragraph, taken one after the other."""
    clean = F.trim(tx.strip_field_codes(F.col("text")))
    rows = paras.select("path", "para_idx", "heading_level", "toc_level", clean.alias("shown")).where(F.length("shown") > 0)
    heads = rows.where("heading_level > 0").select("path", F.col("para_idx").alias("target"), F.col("shown").alias("title"))
    entries = rows.where("toc_level > 0").select("path", "para_idx", F.col("shown").alias("entry"))
    return joins.match_titles(entries, heads, BY, "entry", "title", "para_idx", "target").select("path", "para_idx", "target")


def stories(table: DataFrame, pictured: DataFrame | None = None) -> DataFrame:
    """Headers and footers that show something, with their text; of
    ``pictured`` (path, story_idx) those without a text as well."""
    raw = F.regexp_replace("raw_text", "[\r\n]+$", "")
    shown = F.translate(tx.strip_field_codes(raw, keep_pictures=False), "\r\n", "")
    rows = table.withColumns({"text": shown, "raw_text": F.translate(raw, "\x01\x02\x03\x04\x05\x07\x08\x0c", "")})
    if pictured is None:
        return rows.where(F.length("text") > 0)
    marked = pictured.select("path", "story_idx", F.lit(True).alias("__pictured"))
    return rows.join(marked, ["path", "story_idx"], "left").where((F.length("text") > 0) | F.col("__pictured")).drop("__pictured")


#: Numbers of inline pictures begin here, behind those of the store.
INLINE = 1_000_000


def shape_slots(spa: DataFrame, shape_pictures: DataFrame, story: str = "main") -> DataFrame:
    """(path, slot, cp, spid, image_idx): a story's shapes in order of place,
    each with its picture, the drawing group's before the data stream's; null
    without one."""
    best = seq.first_wins(shape_pictures, ["path", "spid"], [F.col("source"), F.col("image_idx")]).drop("source")
    rows = spa.where(F.col("story") == story).select("path", "cp", "spid").join(best, ["path", "spid"], "left")
    return rows.withColumn("slot", F.row_number().over(Window.partitionBy("path").orderBy("cp", "spid")))


def _marks(rows: DataFrame, text: str, mark: str, by: list[str]) -> DataFrame:
    """A row for each mark in a text, with its place in the text from 0."""
    places = F.filter(F.transform(F.split(F.col(text), ""), lambda c, i: F.when(c == mark, i)), lambda i: i.isNotNull())
    return rows.where(F.col(text).contains(mark)).select(*by, F.explode(places).alias("place"))


def drawn_pictures(paras: DataFrame, slots: DataFrame) -> DataFrame:
    """(path, para_idx, ord, image_idx): the nth drawing mark of a document
    with its nth shape, where that has a picture."""
    marks = _marks(paras.select("path", "para_idx", "text"), "text", "\x08", ["path", "para_idx"])
    out = joins.by_place(marks, slots.select("path", F.col("slot").alias("at"), "image_idx"), BY, ["para_idx", "place"], ["at"], name="ord")
    return out.where(F.col("image_idx").isNotNull()).select("path", "para_idx", "ord", "image_idx")


def inline_pictures(runs: DataFrame, table: DataFrame) -> DataFrame:
    """(path, para_idx, ord, image_idx): a row for each picture mark of a run.
    The picture is the one at the place that the run's properties name; where
    they name none that is there, the document's nth mark has the nth picture
    of its store. ``ord`` comes behind those of drawn pictures."""
    marked = runs.where(F.col("text").contains("\x01")).select("path", "para_idx", "run_idx", "text", "pic_location")
    marks = _marks(marked, "text", "\x01", ["path", "para_idx", "run_idx", "pic_location"])
    nth = F.row_number().over(Window.partitionBy("path").orderBy("para_idx", "run_idx", "place")) - 1
    at = table.groupBy("path", "pic_location").agg(F.min("pic_idx").alias("pic_idx"))
    out = marks.withColumn("nth", nth).join(at, ["path", "pic_location"], "left")
    image = F.coalesce(F.col("pic_idx") + INLINE, F.col("nth"))
    return out.select("path", "para_idx", (F.lit(1 << 20) + F.row_number().over(Window.partitionBy("path", "para_idx").orderBy("run_idx", "place"))).alias("ord"), image.alias("image_idx"))


def story_starts(table: DataFrame) -> DataFrame:
    """(path, story_idx, cp): where each story begins among the headers."""
    rows = seq.offsets(table.select("path", "story_idx", "raw_text"), BY, ["story_idx"], F.char_length("raw_text"), "cp")
    return rows.select("path", "story_idx", "cp")


def story_texts(table: DataFrame) -> DataFrame:
    """(path, kind, texts): what headers and footers say, each text once, in
    the order of the stories."""
    first = stories(table).groupBy("path", "kind", "text").agg(F.min("story_idx").alias("at"))
    rows = F.sort_array(F.collect_list(F.struct("at", "text")))
    return first.groupBy("path", "kind").agg(F.transform(rows, lambda r: r["text"]).alias("texts"))


def header_pictures(stories_table: DataFrame, slots: DataFrame, header_starts: DataFrame) -> DataFrame:
    """(path, story_idx, images): pictures whose shape stands at a drawing mark
    of a story; ``header_starts`` has (path, story_idx, cp), where each story
    begins among the headers."""
    marks = _marks(stories_table.join(header_starts, ["path", "story_idx"]), "raw_text", "\x08", ["path", "story_idx", "cp"])
    met = marks.withColumn("cp", F.col("cp") + F.col("place")).join(slots.select("path", "cp", "image_idx"), ["path", "cp"]).where(F.col("image_idx").isNotNull())
    rows = F.sort_array(F.collect_list(F.struct("cp", "image_idx")))
    return met.groupBy("path", "story_idx").agg(F.transform(rows, lambda r: r["image_idx"]).alias("images"))


def boxes_at(paras: DataFrame, boxes: DataFrame, slots: DataFrame) -> DataFrame:
    """(path, para_idx, text): text boxes by the paragraph that their shape's
    place lies in, the nth box with the nth shape without a picture; of several
    boxes the texts one after the other."""
    bare = slots.where(F.col("image_idx").isNull()).select("path", "slot", "cp")
    met = joins.by_place(boxes, bare, BY, ["box_idx"], ["slot"])
    spans = paras.select("path", "para_idx", F.col("cp_start").alias("s"), (F.col("cp_end") + 1).alias("e"))
    at = joins.points_in_ranges(met.select("path", "box_idx", "raw_text", "cp"), spans, BY, "cp", "s", "e", ["para_idx"], ["para_idx"]).where(F.col("para_idx").isNotNull())
    shown = F.translate(tx.strip_field_codes(F.col("raw_text"), keep_pictures=False), "\r", "\n")
    rows = at.select("path", "para_idx", "box_idx", F.trim(shown).alias("shown")).where(F.length("shown") > 0)
    texts = F.sort_array(F.collect_list(F.struct("box_idx", "shown")))
    return rows.groupBy("path", "para_idx").agg(F.array_join(F.transform(texts, lambda r: r["shown"]), "\n").alias("text"))


def largest_picture(placed: DataFrame, images: DataFrame) -> DataFrame:
    """Of several pictures of one paragraph the one of most bytes, the first
    of equal ones."""
    rows = placed.join(images.select("path", "image_idx", F.octet_length("data").alias("__n")), ["path", "image_idx"])
    best = F.struct("__n", -F.col("ord"))
    return rows.groupBy("path", "para_idx").agg(F.max_by("image_idx", best).alias("image_idx"), F.max_by("ord", best).alias("ord"))
