"""Queries over whole texts and tables, against SQL without any cut."""

from pyspark.sql import functions as F

from tests.oracle import compare, connection
from vellum.functions.text import strip_field_codes
from vellum.operators import joins, recursion
from vellum.plans import catalog


def differs(spark, sf_dir, name, sql):
    return compare(catalog.queries()[name](spark, sf_dir), connection(sf_dir), sql)


def test_font_size_of_whole_texts(spark, sf_dir):
    assert not differs(spark, sf_dir, "font_size_fit", """WITH s AS (SELECT doc_id, (3000000 + doc_id % 5000 * 1000)::BIGINT AS w, (300000 + doc_id % 37 * 100000)::BIGINT AS h, string_split(coalesce(text, ''), chr(10)) AS paras FROM documents),
q AS (SELECT doc_id, w, h, list_transform(paras, lambda x: length(x)) AS ns FROM s),
c AS (SELECT doc_id, size, h, w, ns, greatest(1, trunc((w - 182880) / (size * 127 * 0.85)))::BIGINT AS cpl FROM q, (SELECT unnest([2000, 1800, 1600, 1400, 1200, 1100, 1000, 900, 800, 700, 600]) AS size)),
f AS (SELECT doc_id, size, list_sum(list_transform(ns, lambda n: greatest(1, ceil(n / cpl::DOUBLE)))) * size * 127 * 1.2 <= h - 91440 AS fits FROM c)
SELECT doc_id, coalesce(max(size) FILTER (fits), 600)::INTEGER AS size FROM f GROUP BY 1""")


def test_field_codes_of_whole_texts(spark, sf_dir):
    assert not differs(spark, sf_dir, "field_code_strip", """SELECT doc_id, substr(text, 1, 10) || substr(text, 11, 20) || substr(text, 31) AS shown FROM documents""")


def test_placeholders_in_whole_texts(spark, tmp_path):
    late = "a long text whose mark stands far behind: Click to edit Master title"
    rows = [(k, t, "en", "src1") for k, t in enumerate(["", "", "", "", late, late, "", "", "", "", "www.example.org", "x" * 40 + ".com"])]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string").write.parquet(f"{tmp_path}/documents.parquet")
    got = {r.doc_id: r.placeholder for r in catalog.queries()["placeholder_texts"](spark, str(tmp_path)).collect()}
    assert (got[4], got[5], got[10], got[11]) == (True, True, True, False)


def test_many_fields_of_a_long_text(spark):
    texts = ["".join(f"a{i}\x13 HYPERLINK x{i}\x14shown{i}\x15 " for i in range(2000)), "x\x13 IF \x13 PAGE \x142\x15 = 2\x14yes\x15z" * 500]
    want = ["".join(f"a{i}shown{i} " for i in range(2000)), None]
    rows = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string").select("i", strip_field_codes(F.col("t")).alias("shown")).orderBy("i").collect()
    assert rows[0].shown == want[0] and rows[1].shown.count("z") == 500 and "PAGE" not in rows[1].shown


def test_overlaps_with_every_run(spark, sf_dir):
    assert not differs(spark, sf_dir, "run_overlaps", """WITH i AS (SELECT event_id, user_id, epoch_us(ts) // 1000000 AS s FROM events), r AS (SELECT user_id AS u, event_id AS run, s AS rs, s + 7200 AS re FROM i)
SELECT event_id, run, greatest(s, rs)::BIGINT AS clip_start, least(s + 3600, re)::BIGINT AS clip_end FROM i JOIN r ON user_id = u AND s < re AND rs < s + 3600""")


def test_headings_among_all_parts(spark, sf_dir):
    assert not differs(spark, sf_dir, "fuzzy_heading_match", """WITH titles AS (SELECT p_brand, p_partkey AS title_id, split_part(p_name, ' ', 1) || ' ' || p_type AS title FROM part),
entries AS (SELECT p_brand, p_partkey AS entry_id, CASE p_partkey % 2 WHEN 0 THEN p_type ELSE split_part(p_name, ' ', 1) || ' ' || p_type || ' ' || p_size % 3 END AS entry FROM part),
m AS (SELECT *, abs(length(entry) - length(title)) AS gap FROM entries JOIN titles USING (p_brand) WHERE contains(entry, title) OR contains(title, entry))
SELECT p_brand, entry_id, title_id, gap::INTEGER AS gap FROM (SELECT *, row_number() OVER (PARTITION BY p_brand, entry_id ORDER BY (entry <> title)::INTEGER, gap, title_id) AS n FROM m) WHERE n = 1""")


def test_styles_of_every_supplier(spark, sf_dir):
    assert not differs(spark, sf_dir, "fill_missing_styles", """SELECT s_suppkey AS k, s_name AS name FROM supplier UNION ALL SELECT c_custkey, c_name FROM customer WHERE c_custkey NOT IN (SELECT s_suppkey FROM supplier)""")


def test_repeated_points_stay(spark):
    points = spark.createDataFrame([(1, 5, "a"), (1, 5, "a"), (1, 9000, "b"), (1, None, "c"), (None, 5, "d"), (2, 7, "e")], "path int, cp int, text string")
    ranges = spark.createDataFrame([(1, 4, 10, 2), (1, 0, 100, 1), (2, 8, 9, 1), (1, 0, 100, None)], "path int, s int, e int, idx int")
    rows = joins.points_in_ranges(points, ranges, ["path"], "cp", "s", "e", ["idx"], ["idx"]).collect()
    assert sorted(((r.path, r.cp, r.text, r.idx) for r in rows), key=str) == sorted([(1, 5, "a", 1), (1, 5, "a", 1), (1, 9000, "b", None), (1, None, "c", None), (None, 5, "d", None), (2, 7, "e", None)], key=str)


def test_chains_of_any_number_of_rows(spark):
    # halving chains of more rows than a recursive query may have
    n = 120_000
    rows = spark.range(1, n + 1).select(F.lit("f").alias("path"), F.col("id").alias("k"), F.when(F.col("id") > 1, F.floor(F.col("id") / 2)).alias("up"), F.when(F.col("id") % 1000 == 1, F.col("id")).alias("v"))
    out = recursion.chains(rows, ["path"], "k", "up")
    got = out.agg(F.count(F.lit(1)).alias("n"), F.sum("distance").alias("d")).first()
    assert (got.n, got.d) == (sum(k.bit_length() for k in range(1, n + 1)), sum(k.bit_length() * (k.bit_length() - 1) // 2 for k in range(1, n + 1)))
    far = recursion.inherit(rows, ["path"], "k", "up", ["v"]).where("k = 119999").first()
    k = 119999
    while k % 1000 != 1:
        k //= 2
    assert far.v == k


def test_chains_with_loops_gaps_and_null_keys(spark):
    rows = [(None, 1, 2), (None, 2, 3), (None, 3, 1), ("a", 1, 1), ("a", 2, 9), ("a", 3, None), ("a", 4, 3), ("a", None, 4), ("a", 5, 4)]
    df = spark.createDataFrame(rows, "path string, k int, up int")
    got = sorted((r.path or "", r.node, r.ancestor, r.distance) for r in recursion.chains(df, ["path"], "k", "up").collect())
    loop = [("", a, (a + d - 1) % 3 + 1, d) for a in (1, 2, 3) for d in range(3)]
    assert got == sorted(loop + [("a", 1, 1, 0), ("a", 2, 2, 0), ("a", 3, 3, 0), ("a", 4, 4, 0), ("a", 4, 3, 1), ("a", 5, 5, 0), ("a", 5, 4, 1), ("a", 5, 3, 2)])


def test_deep_and_broken_nests(spark):
    cols = "path string, id long, parent long, x long, y long, w long, h long, gx long, gy long, gw long, gh long"
    rows = [("a", 0, None, 10, 10, 100, 100, 0, 0, 200, 200)]
    rows += [("a", k, k - 1, 20, 20, 100, 100, 0, 0, 200, 200) for k in range(1, 6)]
    rows += [("a", 50, 5, 100, 0, 50, 50, 0, 0, 0, 0), ("a", 60, 61, 1, 1, 1, 1, 0, 0, 9, 9), ("a", 61, 60, 1, 1, 1, 1, 0, 0, 9, 9), ("a", 62, 99, 1, 1, 1, 1, 0, 0, 0, 0), ("b", 1, None, -7, 3, 9, 9, 2, 2, 4, 0), ("b", 2, 1, 5, 6, 7, 8, 0, 0, 0, 0), ("b", 2, 1, 5, 6, 7, 8, 0, 0, 0, 0)]

    def by_hand(boxes):
        found = {}
        for p, i, up, x, y, w, h, *g in boxes:
            found.setdefault((p, i), (up, x, y, w, h, *g))
        div = lambda a, b: int(a / b)

        def at(p, i, box, seen):
            up, x, y, w, h, *g = box
            if up is None:
                return 0, x, y, w, h
            if (p, up) in seen or (p, up) not in found:
                return None
            t = at(p, up, found[p, up], seen | {(p, up)})
            if t is None:
                return None
            level, tx, ty, tw, th = t
            ox, oy, ow, oh = found[p, up][5:]
            return (level + 1, x, y, w, h) if ow == 0 or oh == 0 else (level + 1, tx + div((x - ox) * tw, ow), ty + div((y - oy) * th, oh), div(w * tw, ow), div(h * th, oh))

        return sorted((b[0], b[1], *t) for b in boxes if (t := at(b[0], b[1], b[2:], {(b[0], b[1])})))

    out = recursion.nested_boxes(spark.createDataFrame(rows, cols), ["path"])
    assert sorted((r.path, r.id, r.level, r.x, r.y, r.w, r.h) for r in out.collect()) == by_hand(rows)
