"""Range, place, title and difference joins over the tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from vellum.operators import joins
from vellum.plans.registry import query, table


@query("""WITH b AS (SELECT n_nationkey AS band, n_nationkey * 20000 AS s, n_nationkey * 20000 + 26000 AS e FROM nation WHERE n_nationkey % 4 <> 3)
SELECT o_orderkey, arg_min(band, band) FILTER (band IS NOT NULL) AS band FROM (SELECT o_orderkey, floor(o_totalprice)::BIGINT AS p FROM orders) LEFT JOIN b ON p >= s AND p < e GROUP BY o_orderkey""")
def range_join_runs(spark, sf_dir):
    """Each price with the first band that holds it, met by buckets."""
    k = F.col("n_nationkey").cast("long")
    bands = table(spark, sf_dir, "nation").where("n_nationkey % 4 <> 3").select(F.lit(0).alias("path"), F.col("n_nationkey").alias("band"), (k * 20000).alias("s"), (k * 20000 + 26000).alias("e"))
    points = table(spark, sf_dir, "orders").select(F.lit(0).alias("path"), "o_orderkey", F.floor("o_totalprice").alias("p"))
    return joins.points_in_ranges(points, bands, ["path"], "p", "s", "e", ["band"], ["band"]).select("o_orderkey", "band")


@query("""WITH b AS (SELECT l_orderkey, l_linenumber AS z, (l_partkey * 7 % 500)::BIGINT AS x, (l_suppkey * 13 % 500)::BIGINT AS y, (l_quantity * 6)::BIGINT AS w, (20 + l_partkey % 200)::BIGINT AS h, l_returnflag = 'N' AS filled FROM lineitem)
SELECT s.l_orderkey, s.z FROM b s WHERE NOT s.filled AND EXISTS (SELECT 1 FROM b WHERE b.l_orderkey = s.l_orderkey AND b.z < s.z AND b.filled AND s.x + s.w // 2 BETWEEN b.x AND b.x + b.w AND s.y + s.h // 2 BETWEEN b.y AND b.y + b.h)""")
def spatial_semi(spark, sf_dir):
    """Shapes whose center lies on an earlier filled one."""
    boxes = table(spark, sf_dir, "lineitem").select("l_orderkey", F.col("l_linenumber").alias("z"), (F.col("l_partkey") * 7 % 500).alias("x"), (F.col("l_suppkey") * 13 % 500).alias("y"), (F.col("l_quantity") * 6).cast("long").alias("w"), (F.col("l_partkey") % 200 + 20).alias("h"), (F.col("l_returnflag") == "N").alias("filled"))
    center = F.col("x") + F.floor(F.col("w") / 2), F.col("y") + F.floor(F.col("h") / 2)
    return joins.in_front_of(boxes, ["l_orderkey"], "z", center, ("x", "y", "w", "h"), ~F.col("filled"), F.col("filled"), 256).select("l_orderkey", "z")


@query("""WITH u AS (SELECT conv_id, text, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS place FROM conversations WHERE role = 'user'), a AS (SELECT conv_id, text, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS place FROM conversations WHERE role = 'assistant')
SELECT conv_id, place::INTEGER AS place, u.text AS question, a.text AS answer FROM u JOIN a USING (conv_id, place)""")
def positional_zip(spark, sf_dir):
    """The nth of one kind with the nth of the other."""
    rows = table(spark, sf_dir, "conversations")
    user = rows.where("role = 'user'").select("conv_id", "turn", F.col("text").alias("question"))
    answer = rows.where("role = 'assistant'").select("conv_id", F.col("turn").alias("at"), F.col("text").alias("answer"))
    return joins.by_place(user, answer, ["conv_id"], ["turn"], ["at"]).select("conv_id", "place", "question", "answer")


@query("""WITH u AS (SELECT conv_id, length(text) AS n, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS place FROM conversations WHERE length(text) > 40), a AS (SELECT conv_id, length(text) AS n, row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) AS place FROM conversations WHERE length(text) > 60)
SELECT conv_id, place::INTEGER AS place, u.n::INTEGER AS n_a, a.n::INTEGER AS n_b, u.n IS NOT DISTINCT FROM a.n AS same FROM u FULL JOIN a USING (conv_id, place)""")
def align_skip_blank(spark, sf_dir):
    """Two sequences aligned by place with blanks dropped; short turns stand
    for blanks."""
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", F.char_length("text").alias("n"))
    a = rows.where("n > 40").withColumnRenamed("n", "n_a")
    b = rows.where("n > 60").select("conv_id", (-F.col("turn")).alias("back"), F.col("n").alias("n_b"))
    out = joins.by_place(a, b, ["conv_id"], ["turn"], ["back"], "full_outer")
    return out.select("conv_id", "place", "n_a", "n_b", F.col("n_a").eqNullSafe(F.col("n_b")).alias("same"))


_TITLES = """titles AS (SELECT p_brand, p_partkey AS title_id, split_part(p_name, ' ', 1) || ' ' || p_type AS title FROM part),
entries AS (SELECT p_brand, p_partkey AS entry_id, CASE p_partkey % 2 WHEN 0 THEN p_type ELSE split_part(p_name, ' ', 1) || ' ' || p_type || ' ' || p_size % 3 END AS entry FROM part)"""


@query(f"""WITH {_TITLES}, m AS (SELECT *, abs(length(entry) - length(title)) AS gap FROM entries JOIN titles USING (p_brand) WHERE contains(entry, title) OR contains(title, entry))
SELECT p_brand, entry_id, title_id, gap::INTEGER AS gap FROM (SELECT *, row_number() OVER (PARTITION BY p_brand, entry_id ORDER BY (entry <> title)::INTEGER, gap, title_id) AS n FROM m) WHERE n = 1""")
def fuzzy_heading_match(spark, sf_dir):
    """Contents entries with the nearest heading of their document."""
    part = table(spark, sf_dir, "part")
    word = F.concat_ws(" ", F.split_part("p_name", F.lit(" "), F.lit(1)), "p_type")
    titles = part.select("p_brand", F.col("p_partkey").alias("title_id"), word.alias("title"))
    entry = F.when(F.col("p_partkey") % 2 == 0, F.col("p_type")).otherwise(F.concat_ws(" ", word, (F.col("p_size") % 3).cast("string")))
    entries = part.select("p_brand", F.col("p_partkey").alias("entry_id"), entry.alias("entry"))
    return joins.best_titles(entries, titles, ["p_brand"], "entry", "title", "entry_id", "title_id").select("p_brand", "entry_id", "title_id", "gap")


@query("""SELECT doc_id, source FROM documents d WHERE NOT EXISTS (SELECT 1 FROM labels l WHERE l.doc_id = d.doc_id)""")
def broken_refs_anti(spark, sf_dir):
    return joins.missing(table(spark, sf_dir, "documents").select("doc_id", "source"), table(spark, sf_dir, "labels"), ["doc_id"])


@query("""WITH a AS (SELECT source, lang, count(*) AS n FROM documents GROUP BY ALL), b AS (SELECT source, lang, count(*) AS n FROM documents JOIN (SELECT DISTINCT doc_id FROM labels) USING (doc_id) GROUP BY ALL)
SELECT source, lang, a.n::BIGINT AS value_a, b.n::BIGINT AS value_b, CASE WHEN b.n IS NULL THEN '-' WHEN a.n IS NULL THEN '+' WHEN a.n = b.n THEN '=' ELSE '~' END AS state FROM a FULL JOIN b USING (source, lang)""")
def package_diff(spark, sf_dir):
    """Parts of two packages, all documents and the labelled ones by source
    and language: gone, new, equal, changed."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "source", "lang")
    count = lambda df: df.groupBy("source", "lang").agg(F.count(F.lit(1)).alias("n"))
    return joins.difference(count(docs), count(docs.join(table(spark, sf_dir, "labels"), "doc_id", "left_semi")), ["source", "lang"], "n")


@query("""SELECT doc_id, lang, rank FROM (SELECT doc_id, lang, rank, min(rank) OVER (PARTITION BY lang, doc_id // 10) AS best FROM (SELECT doc_id, lang, (CASE source WHEN 'src7' THEN 1 WHEN 'src3' THEN 2 ELSE 3 END)::INTEGER AS rank FROM documents)) WHERE rank = best""")
def source_priority_fallback(spark, sf_dir):
    """Of each group the rows of the best source that has any."""
    rank = F.when(F.col("source") == "src7", 1).when(F.col("source") == "src3", 2).otherwise(3)
    rows = table(spark, sf_dir, "documents").select("doc_id", "lang", rank.alias("rank"), F.floor(F.col("doc_id") / 10).alias("part"))
    return joins.first_source(rows, ["lang", "part"], "rank").select("doc_id", "lang", "rank")


@query("""WITH m AS (SELECT s_suppkey AS k, s_name AS name FROM supplier) SELECT k, name FROM m UNION ALL SELECT c_custkey AS k, c_name AS name FROM customer WHERE c_custkey NOT IN (SELECT k FROM m)""")
def fill_missing_styles(spark, sf_dir):
    """Master styles, and those of the environment that the master lacks."""
    main = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("k"), F.col("s_name").alias("name"))
    other = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("k"), F.col("c_name").alias("name"))
    return joins.fill_missing(main, other, ["k"])


@query("""SELECT d.source, count(*)::BIGINT AS n_docs, count(l.quality)::BIGINT AS n_labelled, (count(*) FILTER (l.quality = 0))::BIGINT AS n_low, coalesce(bool_or(l.toxic = 1), false) AS any_toxic, max(d.n_chars)::BIGINT AS max_chars FROM documents d LEFT JOIN labels l USING (doc_id) GROUP BY 1""")
def quality_audit(spark, sf_dir):
    rows = table(spark, sf_dir, "documents").select("doc_id", "source", "n_chars").join(table(spark, sf_dir, "labels"), "doc_id", "left")
    return rows.groupBy("source").agg(F.count(F.lit(1)).alias("n_docs"), F.count("quality").alias("n_labelled"), F.count_if(F.col("quality") == 0).alias("n_low"), F.coalesce(F.bool_or(F.col("toxic") == 1), F.lit(False)).alias("any_toxic"), F.max("n_chars").alias("max_chars"))


@query("""SELECT source, arg_max(doc_id, (n_chars * 100000000 - doc_id)) AS doc_id, max(n_chars)::BIGINT AS n_chars FROM documents GROUP BY 1""")
def argmax_image(spark, sf_dir):
    """The largest of each group, the first of equal ones."""
    best = F.struct(F.col("n_chars"), -F.col("doc_id"))
    return table(spark, sf_dir, "documents").groupBy("source").agg(F.max_by("doc_id", best).alias("doc_id"), F.max("n_chars").alias("n_chars"))


@query("""WITH s AS (SELECT doc_id, (3000000 + doc_id % 5000 * 1000)::BIGINT AS w, (300000 + doc_id % 37 * 100000)::BIGINT AS h, string_split(coalesce(text, ''), chr(10)) AS paras FROM documents),
q AS (SELECT doc_id, w, h, list_transform(paras, lambda x: length(x)) AS ns FROM s),
c AS (SELECT doc_id, size, h, w, ns, greatest(1, trunc((w - 182880) / (size * 127 * 0.85)))::BIGINT AS cpl FROM q, (SELECT unnest([2000, 1800, 1600, 1400, 1200, 1100, 1000, 900, 800, 700, 600]) AS size)),
f AS (SELECT doc_id, size, list_sum(list_transform(ns, lambda n: greatest(1, ceil(n / cpl::DOUBLE)))) * size * 127 * 1.2 <= h - 91440 AS fits FROM c)
SELECT doc_id, coalesce(max(size) FILTER (fits), 600)::INTEGER AS size FROM f GROUP BY 1""")
def font_size_fit(spark, sf_dir):
    """The largest of eleven sizes at which the text fits its shape."""
    from vellum.operators import slides

    rows = table(spark, sf_dir, "documents").select("doc_id", (F.col("doc_id") % 5000 * 1000 + 3000000).alias("w"), (F.col("doc_id") % 37 * 100000 + 300000).alias("h"), F.transform(F.split(F.coalesce("text", F.lit("")), "\n"), F.char_length).alias("ns"))
    return rows.select("doc_id", slides.largest_fit(F.col("w") - 182880, F.col("h") - 91440, F.col("ns")).alias("size"))
