"""Text functions on columns."""

from __future__ import annotations

import functools
import operator

from pyspark.sql import Column
from pyspark.sql import functions as F

# Font names that mean a CJK font, image formats and extensions.
CJK_FONTS = ("SimSun", "SimHei", "FangSong", "KaiTi", "Microsoft YaHei", "MS Mincho", "MS Gothic", "Malgun Gothic", "Batang")
EXTENSIONS = {"EMF": ".emf", "WMF": ".wmf", "PICT": ".pict", "JPEG": ".jpg", "PNG": ".png", "DIB": ".dib", "TIFF": ".tiff"}
PLACEHOLDER_PARTS = ("单击此处编辑母版", "点击此处编辑母版", "Click to edit Master")
PLACEHOLDER_TEXTS = ("二级", "三级", "四级", "五级", "第二级", "第三级", "第四级", "第五级", "Second level", "Third level", "Fourth level", "Fifth level")
DECORATION = ("*", "•", "-", "—", "·")
WEB, WEB_BYTES = ("www.", ".com", ".cn", ".org"), 30  # marks of web addresses, and bytes of a text that is no more than one
# End of fixed values.


def strip_field_codes(text: Column, keep_pictures: bool = True) -> Column:
    """A run's visible text: field instructions and marks go.

    The text is cut at field marks; a fold over the cuts carries the depth and
    whether an instruction is open, so nested fields come out right.
    """
    cuts = F.regexp_extract_all(text, F.lit("([\x13\x14\x15]|[^\x13\x14\x15]+)"), F.lit(1))
    start = F.struct(F.lit(0).alias("depth"), F.lit(False).alias("hidden"), F.lit("").alias("shown"))

    def step(acc: Column, cut: Column) -> Column:
        depth = F.when(cut == "\x13", acc["depth"] + 1).when(cut == "\x15", F.greatest(acc["depth"] - 1, F.lit(0))).otherwise(acc["depth"])
        hidden = F.when(cut == "\x13", True).when(cut == "\x14", False).when((cut == "\x15") & (depth == 0), False).otherwise(acc["hidden"])
        mark = cut.isin("\x13", "\x14", "\x15")
        shown = F.when(mark | ((acc["depth"] > 0) & acc["hidden"]), acc["shown"]).otherwise(F.concat(acc["shown"], cut))
        return F.struct(depth.alias("depth"), hidden.alias("hidden"), shown.alias("shown"))

    marks = "\x02\x03\x04\x05\x07\x08\x0c" + ("" if keep_pictures else "\x01")
    return F.translate(F.aggregate(cuts, start, step)["shown"], marks, "")


def lines(text: Column) -> Column:
    """Cut at CR, LF or both together."""
    return F.split(text, "\r\n|\r|\n")


def heading_level(outline: Column, sti: Column, name: Column) -> Column:
    """1 to 9, or 0 for body text: by outline level, else built-in style, else
    the style's name."""
    low = F.lower(name)
    by_name = F.coalesce(F.nullif(F.regexp_extract(low, r"^heading ([1-9])$", 1), F.lit("")), F.nullif(F.regexp_extract(low, r"^标题\s*([1-9])\s*$", 1), F.lit("")))
    return F.when(outline.between(0, 8), outline + 1).when(sti.between(1, 9), sti).otherwise(F.coalesce(by_name.cast("int"), F.lit(0))).cast("int")


def toc_level(sti: Column) -> Column:
    return F.when(sti.between(19, 27), sti - 18).otherwise(0).cast("int")


def is_cjk_font(name: Column) -> Column:
    return name.isin(*CJK_FONTS) | name.rlike(r"[\x{2E80}-\x{10FFFF}]")


def is_font_name(name: Column) -> Column:
    """Nothing but printable characters, one at least, and no long text."""
    return (F.length(name) > 0) & (F.octet_length(name) <= 100) & ~name.rlike(r"[\x{0000}-\x{001F}\x{FFFD}]")


def extension(image_format: Column) -> Column:
    table = F.create_map(*[F.lit(x) for kv in EXTENSIONS.items() for x in kv])
    return F.coalesce(F.try_element_at(table, image_format), F.lit(".bin"))


def escape_attribute(text: Column) -> Column:
    for a, b in (("&", "&amp;"), ('"', "&quot;"), ("<", "&lt;"), (">", "&gt;")):
        text = F.replace(text, F.lit(a), F.lit(b))
    return text


def drop_invalid_xml(text: Column) -> Column:
    return F.regexp_replace(text, r"[^\x{9}\x{A}\x{D}\x{20}-\x{D7FF}\x{E000}-\x{FFFD}\x{10000}-\x{10FFFF}]", "")


def squeeze(text: Column) -> Column:
    """White space as single blanks, none outside."""
    return F.trim(F.regexp_replace(text, r"\s+", " "))


def shorten(text: Column, most: int) -> Column:
    return F.when(F.char_length(text) > most, F.concat(F.substring(text, 1, most), F.lit("..."))).otherwise(text)


def column_letters(index: Column) -> Column:
    """Column number from 0 as letters, to three letters."""
    i = index.cast("int")
    letter = lambda n: F.char((n % 26 + 65).cast("int"))
    return (
        F.when(i < 26, letter(i))
        .when(i < 702, F.concat(letter(F.floor((i - 26) / 26)), letter(i - 26)))
        .otherwise(F.concat(letter(F.floor((i - 702) / 676)), letter(F.floor((i - 702) / 26)), letter(i - 702)))
    )


def cell_reference(column: Column, row: Column) -> Column:
    """Like A1, of a column and a row from 0."""
    return F.concat(column_letters(column), (row + 1).cast("string"))


def is_edit_hint(text: Column) -> Column:
    """A master's invitation to edit."""
    part = text.contains(PLACEHOLDER_PARTS[0])
    for p in PLACEHOLDER_PARTS[1:]:
        part |= text.contains(p)
    return part


def is_placeholder(text: Column) -> Column:
    """Master placeholders, bare decoration, short web addresses."""
    part = is_edit_hint(text)
    web = functools.reduce(operator.or_, (text.contains(w) for w in WEB))
    return part | text.isin(*PLACEHOLDER_TEXTS) | text.isin(*DECORATION) | ((F.octet_length(text) <= WEB_BYTES) & web)


def is_blank(text: Column) -> Column:
    return F.regexp_replace(text, r"[\s\x{85}\x{A0}]", "") == ""
