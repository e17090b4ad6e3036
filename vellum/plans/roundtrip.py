"""Packages written from the tables and read again."""

from __future__ import annotations

from pyspark.sql import functions as F

from vellum.operators import packages as pk
from vellum.plans.registry import query, table
from vellum.plans.text import PARAGRAPHS, paragraphs
from vellum.sinks import docx, xlsx


@query("""WITH c AS (SELECT p_brand || '-' || (p_partkey // 500) AS path, p_partkey, p_type AS text FROM part), f AS (SELECT path, text, min(p_partkey) AS first FROM c GROUP BY ALL)
SELECT path, (row_number() OVER (PARTITION BY path ORDER BY first) - 1)::INTEGER AS idx, text FROM f""")
def xlsx_round_trip(spark, sf_dir):
    """A workbook for each brand and 500 numbers of parts, a row for each part:
    the shared strings of the package, in their order."""
    path = F.concat_ws("-", "p_brand", F.floor(F.col("p_partkey") / 500).cast("string"))
    part = table(spark, sf_dir, "part").withColumn("path", path)
    at = [F.col("path"), F.lit(0).alias("sheet_id"), F.col("p_partkey").cast("int").alias("row_idx")]
    blank = [F.lit(None).cast("bigint").alias("sst_idx"), F.lit(15).alias("xf_idx")]
    texts = part.select(*at, F.lit(0).alias("col_idx"), F.lit("LabelBIFF8").alias("cell_type"), F.col("p_type").alias("str_val"), F.lit(None).cast("double").alias("num_val"), *blank)
    numbers = part.select(*at, F.lit(1).alias("col_idx"), F.lit("Number").alias("cell_type"), F.lit(None).cast("string").alias("str_val"), F.col("p_retailprice").alias("num_val"), *blank)
    strings = spark.createDataFrame([], "path string, sst_idx bigint, text string")
    sheets = part.select("path", F.lit(0).alias("sheet_id"), F.lit("Parts").alias("sheet_name")).distinct()
    read = pk.unzipped(xlsx.packages(texts.unionByName(numbers), strings, sheets)).where("part_name = 'xl/sharedStrings.xml'")
    return pk.texts(read, "t").select("path", "idx", "text")


@query(f"""WITH {PARAGRAPHS} SELECT doc_id, (row_number() OVER (PARTITION BY doc_id ORDER BY para_idx) - 1)::INTEGER AS idx, text FROM paras WHERE text <> ''""")
def docx_round_trip(spark, sf_dir):
    """A text package for each document: the texts of its runs, in order."""
    rows = paragraphs(spark, sf_dir).withColumn("path", F.col("doc_id").cast("string"))
    flags = ("page_break_before", "page_break", "break_before", "in_table", "row_end", "cell_end", "skip", "ordered")
    numbers = ("heading_level", "toc_level", "ilvl", "space_before", "space_after", "line_spacing", "line_rule", "indent_left", "indent_right", "indent_first")
    empty = {"num_id": "bigint", "alignment": "int", "cell_widths": "array<int>"}
    paras = rows.withColumns({**{c: F.lit(False) for c in flags}, **{c: F.lit(0) for c in numbers}, **{c: F.lit(None).cast(t) for c, t in empty.items()}, "nfc": F.lit(23), "lvl_text": F.lit("")})
    runs = rows.select("path", "para_idx", F.lit(0).alias("run_idx"), "text", F.lit("Arial").alias("font_name"), F.lit(21).alias("font_size"), F.lit(False).alias("bold"), F.lit(False).alias("italic"), F.lit(0).alias("underline"), F.lit(None).cast("string").alias("color"))
    none = lambda s: spark.createDataFrame([], s)
    stories = none("path string, story_idx int, kind string, story_type string, text string")
    images = none("path string, image_idx int, format string, data binary")
    placed = none("path string, para_idx int, ord int, image_idx int")
    parts = docx.parts(paras, runs, stories, images, none("path string, para_idx int, target int"), placed, none("path string, para_idx int, text string"))
    read = pk.unzipped(pk.zipped(parts)).where("part_name = 'word/document.xml'")
    return pk.texts(read, "w:t").select(F.col("path").cast("bigint").alias("doc_id"), "idx", "text")
