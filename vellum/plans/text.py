"""Paragraphs, runs of them, fields, headings and markup text."""

from __future__ import annotations

from pyspark.sql import functions as F

from vellum.functions import text as tx
from vellum.operators import sequence as seq
from vellum.plans.registry import query, table

#: Paragraphs of documents, as DuckDB has them.
PARAGRAPHS = """
cuts AS (SELECT doc_id, string_split(text, chr(10)) AS parts FROM documents),
loose AS (SELECT doc_id, unnest(parts) AS text, unnest(range(len(parts))) AS para_idx, len(parts) AS n FROM cuts),
paras AS (SELECT doc_id, para_idx::INTEGER AS para_idx, text, coalesce(sum(length(text) + 1) OVER (PARTITION BY doc_id ORDER BY para_idx ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS cp_start
  FROM loose WHERE NOT (para_idx = n - 1 AND text = ''))"""

BY, ORDER = ["doc_id"], ["para_idx"]


def paragraphs(spark, sf_dir):
    return seq.split_paragraphs(table(spark, sf_dir, "documents"), "text", doc_id="doc_id").drop("separator")


@query(f"WITH {PARAGRAPHS} SELECT doc_id, para_idx, text, cp_start FROM paras")
def paragraph_split(spark, sf_dir):
    return paragraphs(spark, sf_dir)


@query(f"""WITH {PARAGRAPHS},
flags AS (SELECT *, length(text) < 60 AS small FROM paras),
runs AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY para_idx) - row_number() OVER (PARTITION BY doc_id, small ORDER BY para_idx) AS run FROM flags),
places AS (SELECT *, row_number() OVER (PARTITION BY doc_id, small, run ORDER BY para_idx) AS place FROM runs)
SELECT doc_id, para_idx, cp_start FROM places WHERE NOT small OR place = 1""")
def collapse_blank_paragraphs(spark, sf_dir):
    """Runs of short paragraphs, which stand for empty ones, keep their first."""
    return seq.collapse_runs(paragraphs(spark, sf_dir), BY, ORDER, F.char_length("text") < 60).select("doc_id", "para_idx", "cp_start")


@query(f"""WITH {PARAGRAPHS},
flags AS (SELECT *, length(text) < 90 AS empty FROM paras),
runs AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY para_idx) - row_number() OVER (PARTITION BY doc_id, empty ORDER BY para_idx) AS run FROM flags),
places AS (SELECT *, CASE WHEN empty THEN row_number() OVER (PARTITION BY doc_id, empty, run ORDER BY para_idx) ELSE 0 END AS place FROM runs),
ends AS (SELECT *, CASE WHEN NOT empty THEN coalesce(lag(place) OVER (PARTITION BY doc_id ORDER BY para_idx), 0) ELSE 0 END AS gone FROM places),
seen AS (SELECT *, coalesce(max((gone >= 3)::INTEGER) OVER (PARTITION BY doc_id ORDER BY para_idx ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS long FROM ends)
SELECT doc_id, para_idx, (NOT empty AND gone >= 2 AND long = 1) AS break_before FROM seen""")
def page_break_runs(spark, sf_dir):
    rows = seq.page_breaks(paragraphs(spark, sf_dir), BY, ORDER, F.char_length("text") < 90, F.lit(True), long_run=3, short_run=2)
    return rows.select("doc_id", "para_idx", "break_before")


@query(f"""WITH {PARAGRAPHS},
flags AS (SELECT *, contains(text, 'the') AS item, length(text) < 120 AS head, length(text) % 2 AS kind FROM paras),
plains AS (SELECT *, item AND NOT head AS plain FROM flags),
fresh AS (SELECT *, (plain AND (NOT coalesce(lag(plain) OVER w, false) OR kind IS DISTINCT FROM lag(kind) OVER w))::INTEGER AS new FROM plains WINDOW w AS (PARTITION BY doc_id ORDER BY para_idx))
SELECT doc_id, para_idx, (CASE WHEN plain THEN sum(new) OVER (PARTITION BY doc_id ORDER BY para_idx ROWS UNBOUNDED PRECEDING) + max((item AND head)::INTEGER) OVER (PARTITION BY doc_id) WHEN item THEN 1 END)::BIGINT AS num_id FROM fresh""")
def paragraph_list_numbering(spark, sf_dir):
    rows = paragraphs(spark, sf_dir)
    out = seq.number_lists(rows, BY, ORDER, F.col("text").contains("the"), F.char_length("text") < 120, F.char_length("text") % 2)
    return out.select("doc_id", "para_idx", "num_id")


@query(f"""WITH {PARAGRAPHS}, flags AS (SELECT *, contains(text, '|') AS f FROM paras),
near AS (SELECT *, coalesce(lag(f) OVER w, false) AS b, coalesce(lead(f) OVER w, false) AS a FROM flags WINDOW w AS (PARTITION BY doc_id ORDER BY para_idx))
SELECT doc_id, para_idx, f OR (a AND b) AS in_table, (f AND NOT b) AS opens, (NOT f AND b) AS closes FROM near""")
def table_flags(spark, sf_dir):
    """Table paragraphs, single gaps filled, and where tables open and close
    before that."""
    rows = paragraphs(spark, sf_dir).withColumn("in_table", F.col("text").contains("|"))
    rows = seq.transitions(rows, BY, ORDER, F.col("in_table"))
    return seq.fill_single_gaps(rows, BY, ORDER, "in_table").select("doc_id", "para_idx", "in_table", "opens", "closes")


@query(f"""WITH {PARAGRAPHS}, f AS (SELECT *, min((length(text) < 80)::INTEGER) OVER (PARTITION BY doc_id ORDER BY para_idx ROWS UNBOUNDED PRECEDING) AS lead0 FROM paras)
SELECT doc_id, para_idx FROM f WHERE lead0 = 0""")
def leading_paragraphs_dropped(spark, sf_dir):
    return seq.drop_leading(paragraphs(spark, sf_dir), BY, ORDER, F.char_length("text") < 80).select("doc_id", "para_idx")


@query(f"""WITH {PARAGRAPHS}, w AS (SELECT *, para_idx % 5 = 4 AS row_end, contains(text, '|') OR para_idx % 7 < 5 AS in_table, length(text) > 70 AS has_text FROM paras),
isl AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY para_idx) - row_number() OVER (PARTITION BY doc_id, in_table ORDER BY para_idx) AS k FROM w),
tab AS (SELECT *, min(para_idx) OVER (PARTITION BY doc_id, in_table, k) AS t FROM isl WHERE in_table),
r AS (SELECT *, coalesce(sum(row_end::INTEGER) OVER (PARTITION BY doc_id, t ORDER BY para_idx ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS rw FROM tab),
rows_ AS (SELECT doc_id, t, rw, count(*) FILTER (NOT row_end) AS cells, bool_or(row_end) AS closed, min(para_idx) AS at0 FROM r GROUP BY ALL),
a AS (SELECT doc_id, arg_min(cells, at0) AS a FROM rows_ WHERE rw > 0 AND closed AND cells > 0 GROUP BY doc_id),
first_ AS (SELECT *, coalesce(max((NOT has_text)::INTEGER) OVER (PARTITION BY doc_id ORDER BY para_idx ROWS UNBOUNDED PRECEDING), 0) AS blank FROM (SELECT *, min(t) OVER (PARTITION BY doc_id) AS t0 FROM tab) WHERE t = t0),
b AS (SELECT doc_id, CASE WHEN max(blank) = 1 THEN count(*) FILTER (blank = 0) ELSE 0 END AS b FROM first_ GROUP BY doc_id)
SELECT doc_id, coalesce(a, b, 0)::BIGINT AS n_columns FROM (SELECT DISTINCT doc_id FROM paras) LEFT JOIN a USING (doc_id) LEFT JOIN b USING (doc_id)""")
def table_column_count(spark, sf_dir):
    rows = paragraphs(spark, sf_dir)
    return seq.table_columns(rows, BY, ORDER, F.col("text").contains("|") | (F.col("para_idx") % 7 < 5), F.col("para_idx") % 5 == 4, F.char_length("text") > 70)


@query("""SELECT doc_id, regexp_replace(marked, chr(19) || '[^' || chr(20) || ']*' || chr(20) || '([^' || chr(21) || ']*)' || chr(21), '\\1', 'g') AS shown
FROM (SELECT doc_id, substr(text, 1, 10) || chr(19) || ' HYPERLINK ' || substr(text, 3, 8) || chr(20) || substr(text, 11, 20) || chr(21) || substr(text, 31) AS marked FROM documents)""")
def field_code_strip(spark, sf_dir):
    """A field set into each text: its instruction is hidden, its result shown."""
    part = lambda a, n: F.substring("text", a, n)
    marked = F.concat(part(1, 10), F.lit("\x13 HYPERLINK "), part(3, 8), F.lit("\x14"), part(11, 20), F.lit("\x15"), part(31, 2**31 - 1))
    return table(spark, sf_dir, "documents").select("doc_id", tx.strip_field_codes(marked).alias("shown"))


@query("""WITH s AS (SELECT doc_id, CASE doc_id % 4 WHEN 0 THEN doc_id % 12 ELSE 9 END AS outline, CASE WHEN doc_id % 4 = 1 THEN doc_id % 30 ELSE 40 END AS sti,
  CASE WHEN doc_id % 4 = 2 THEN 'Heading ' || (doc_id % 11) WHEN doc_id % 4 = 3 THEN '标题 ' || (doc_id % 10) ELSE lang END AS name FROM documents)
SELECT doc_id, (CASE WHEN outline BETWEEN 0 AND 8 THEN outline + 1 WHEN sti BETWEEN 1 AND 9 THEN sti WHEN regexp_matches(lower(name), '^heading [1-9]$') OR regexp_matches(name, '^标题 *[1-9]$') THEN right(name, 1)::INTEGER ELSE 0 END)::INTEGER AS heading,
  (CASE WHEN sti BETWEEN 19 AND 27 THEN sti - 18 ELSE 0 END)::INTEGER AS toc FROM s""")
def heading_levels(spark, sf_dir):
    k = F.col("doc_id")
    outline = F.when(k % 4 == 0, k % 12).otherwise(9)
    sti = F.when(k % 4 == 1, k % 30).otherwise(40)
    name = F.when(k % 4 == 2, F.concat(F.lit("Heading "), k % 11)).when(k % 4 == 3, F.concat(F.lit("标题 "), k % 10)).otherwise(F.col("lang"))
    return table(spark, sf_dir, "documents").select("doc_id", tx.heading_level(outline, sti, name).alias("heading"), tx.toc_level(sti).alias("toc"))


@query("""SELECT page_id, len(nodes)::BIGINT AS n_nodes, coalesce(list_sum(list_transform(nodes, lambda x: length(x))), 0)::BIGINT AS n_chars, len(links)::BIGINT AS n_links FROM
(SELECT page_id, list_filter(regexp_extract_all(html, '>([^<]+)<', 1), lambda x: trim(replace(replace(replace(x, chr(10), ''), chr(9), ''), chr(13), '')) <> '') AS nodes, regexp_extract_all(html, 'href="([^"]*)"', 1) AS links FROM pages)""")
def html_text_nodes(spark, sf_dir):
    """Text nodes and links of markup."""
    nodes = F.filter(F.regexp_extract_all("html", F.lit(">([^<]+)<"), F.lit(1)), lambda x: F.trim(F.translate(x, "\n\t\r", "")) != "")
    links = F.regexp_extract_all("html", F.lit('href="([^"]*)"'), F.lit(1))
    rows = table(spark, sf_dir, "pages").select("page_id", nodes.alias("nodes"), links.alias("links"))
    chars = F.aggregate("nodes", F.lit(0).cast("long"), lambda n, x: n + F.char_length(x))
    return rows.select("page_id", F.size("nodes").cast("long").alias("n_nodes"), chars.alias("n_chars"), F.size("links").cast("long").alias("n_links"))


@query("""SELECT conv_id, turn, trim(regexp_replace(text, '[ \\t\\n\\r\\f\\x0b]+', ' ', 'g'), ' ') AS clean, CASE WHEN length(text) > 30 THEN substr(text, 1, 30) || '...' ELSE text END AS short,
replace(replace(replace(replace(text, '&', '&amp;'), '"', '&quot;'), '<', '&lt;'), '>', '&gt;') AS escaped FROM conversations""")
def text_cleanup(spark, sf_dir):
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", tx.squeeze(F.col("text")).alias("clean"), tx.shorten(F.col("text"), 30).alias("short"), tx.escape_attribute(F.col("text")).alias("escaped"))


@query("""SELECT doc_id, contains(t, 'Click to edit Master') OR t IN ('二级', '三级', '四级', '五级', '第二级', '第三级', '第四级', '第五级', 'Second level', 'Third level', 'Fourth level', 'Fifth level', '*', '•', '-', '—', '·')
 OR (strlen(t) <= 30 AND (contains(t, 'www.') OR contains(t, '.com') OR contains(t, '.cn') OR contains(t, '.org'))) AS placeholder
FROM (SELECT doc_id, CASE doc_id % 6 WHEN 0 THEN 'Second level' WHEN 1 THEN '—' WHEN 2 THEN 'see www.' || source WHEN 3 THEN 'x Click to edit Master ' || lang ELSE text END AS t FROM documents)""")
def placeholder_texts(spark, sf_dir):
    k = F.col("doc_id") % 6
    t = F.when(k == 0, "Second level").when(k == 1, "—").when(k == 2, F.concat(F.lit("see www."), "source")).when(k == 3, F.concat(F.lit("x Click to edit Master "), "lang")).otherwise(F.col("text"))
    return table(spark, sf_dir, "documents").select("doc_id", tx.is_placeholder(t).alias("placeholder"))
