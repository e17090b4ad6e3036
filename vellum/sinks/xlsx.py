"""Spreadsheet packages from cells."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from vellum.functions import numbers
from vellum.functions import text as tx
from vellum.operators import cells as cl
from vellum.operators import packages as pk

_HEAD = '<?xml version="1.0" encoding="UTF-8" standalone="yes"?>\n'
_MAIN = "http://schemas.openxmlformats.org/spreadsheetml/2006/main"
_OFFICE = "http://schemas.openxmlformats.org/officeDocument/2006/relationships"
_PACKAGE = "http://schemas.openxmlformats.org/package/2006"
_TYPE = "application/vnd.openxmlformats-officedocument.spreadsheetml"
_STYLES = f'{_HEAD}<styleSheet xmlns="{_MAIN}"><fonts count="1"><font><sz val="11"/><name val="Calibri"/></font></fonts><fills count="2"><fill><patternFill patternType="none"/></fill><fill><patternFill patternType="gray125"/></fill></fills><borders count="1"><border/></borders><cellStyleXfs count="1"><xf/></cellStyleXfs><cellXfs count="1"><xf/></cellXfs></styleSheet>'


def parts(cells: DataFrame, strings: DataFrame, sheets: DataFrame) -> DataFrame:
    """(path, part_name, content) of a package for every workbook, from
    ``xls_cells``, ``xls_sst`` and ``xls_sheets``. Texts are numbered anew by
    first appearance; blanks are left out."""
    joined = cl.values(cl.with_strings(cells, strings)).where("kept")
    table = cl.first_appearance(joined)
    rows = joined.join(table, ["path", "string"], "left")
    ref = tx.cell_reference(F.col("col_idx"), F.col("row_idx"))
    number = F.concat(F.lit('<c r="'), ref, F.lit('"><v>'), numbers.number_text("numeric"), F.lit("</v></c>"))
    string = F.concat(F.lit('<c r="'), ref, F.lit('" t="s"><v>'), F.col("idx"), F.lit("</v></c>"))
    rows = rows.select("path", "sheet_id", "row_idx", "col_idx", F.when(F.col("numeric").isNotNull(), number).otherwise(string).alias("cell"))
    lines = rows.groupBy("path", "sheet_id", "row_idx").agg(pk.ordered_text("cell", "col_idx").alias("row"))
    lines = lines.withColumn("row", F.concat(F.lit('<row r="'), F.col("row_idx") + 1, F.lit('">'), "row", F.lit("</row>")))
    body = lines.groupBy("path", "sheet_id").agg(pk.ordered_text("row", "row_idx").alias("rows"))
    body = sheets.select("path", "sheet_id").join(body, ["path", "sheet_id"], "left")
    sheet = pk.part(body, F.concat(F.lit("xl/worksheets/sheet"), F.col("sheet_id") + 1, F.lit(".xml")), F.concat(F.lit(f'{_HEAD}<worksheet xmlns="{_MAIN}"><sheetData>'), F.coalesce("rows", F.lit("")), F.lit("</sheetData></worksheet>")))

    item = table.select("path", "idx", F.concat(F.lit('<si><t xml:space="preserve">'), pk.xml(F.col("string")), F.lit("</t></si>")).alias("item"))
    listed = sheets.select("path").distinct().join(item.groupBy("path").agg(pk.ordered_text("item", "idx").alias("items"), F.count(F.lit(1)).alias("n")), "path", "left").na.fill({"items": "", "n": 0})
    texts = pk.part(listed, "xl/sharedStrings.xml", F.concat(F.lit(f'{_HEAD}<sst xmlns="{_MAIN}" count="'), "n", F.lit('" uniqueCount="'), "n", F.lit('">'), "items", F.lit("</sst>")))

    k = F.col("sheet_id") + 1
    per = sheets.select(
        "path",
        "sheet_id",
        F.concat(F.lit('<sheet name="'), pk.xml(F.col("sheet_name")), F.lit('" sheetId="'), k, F.lit('" r:id="rId'), k, F.lit('"/>')).alias("entry"),
        F.concat(F.lit('<Relationship Id="rId'), k, F.lit(f'" Type="{_OFFICE}/worksheet" Target="worksheets/sheet'), k, F.lit('.xml"/>')).alias("relation"),
        F.concat(F.lit('<Override PartName="/xl/worksheets/sheet'), k, F.lit(f'.xml" ContentType="{_TYPE}.worksheet+xml"/>')).alias("kind"),
    )
    book = per.groupBy("path").agg(pk.ordered_text("entry", "sheet_id").alias("entries"), pk.ordered_text("relation", "sheet_id").alias("relations"), pk.ordered_text("kind", "sheet_id").alias("kinds"), F.count(F.lit(1)).alias("n"))
    wrap = lambda a, c, b: F.concat(F.lit(_HEAD + a), c, F.lit(b))
    relations = F.concat("relations", F.lit('<Relationship Id="rId'), F.col("n") + 1, F.lit(f'" Type="{_OFFICE}/styles" Target="styles.xml"/><Relationship Id="rId'), F.col("n") + 2, F.lit(f'" Type="{_OFFICE}/sharedStrings" Target="sharedStrings.xml"/>'))
    fixed = f'<Default Extension="rels" ContentType="application/vnd.openxmlformats-package.relationships+xml"/><Default Extension="xml" ContentType="application/xml"/><Override PartName="/xl/workbook.xml" ContentType="{_TYPE}.sheet.main+xml"/><Override PartName="/xl/styles.xml" ContentType="{_TYPE}.styles+xml"/><Override PartName="/xl/sharedStrings.xml" ContentType="{_TYPE}.sharedStrings+xml"/>'
    out = [
        sheet,
        texts,
        pk.part(book, "xl/workbook.xml", wrap(f'<workbook xmlns="{_MAIN}" xmlns:r="{_OFFICE}"><sheets>', F.col("entries"), "</sheets></workbook>")),
        pk.part(book, "xl/_rels/workbook.xml.rels", wrap(f'<Relationships xmlns="{_PACKAGE}/relationships">', relations, "</Relationships>")),
        pk.part(book, "[Content_Types].xml", wrap(f'<Types xmlns="{_PACKAGE}/content-types">{fixed}', F.col("kinds"), "</Types>")),
        pk.part(book, "_rels/.rels", F.lit(f'{_HEAD}<Relationships xmlns="{_PACKAGE}/relationships"><Relationship Id="rId1" Type="{_OFFICE}/officeDocument" Target="xl/workbook.xml"/></Relationships>')),
        pk.part(book, "xl/styles.xml", F.lit(_STYLES)),
    ]
    whole = out[0]
    for p in out[1:]:
        whole = whole.unionByName(p)
    return whole


def packages(cells: DataFrame, strings: DataFrame, sheets: DataFrame) -> DataFrame:
    """(path, content): a package file for every workbook."""
    return pk.zipped(parts(cells, strings, sheets))
