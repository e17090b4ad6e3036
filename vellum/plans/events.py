"""Ordered events and interval-like rows: numbering, versions, coverage."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from vellum.operators import joins, recursion
from vellum.operators import sequence as seq
from vellum.plans.registry import query, table

BY, ORDER = ["user_id"], ["ts", "event_id"]


@query("""WITH f AS (SELECT *, event_type <> 'view' AS item FROM events),
n AS (SELECT *, (item AND (NOT coalesce(lag(item) OVER w, false) OR event_type IS DISTINCT FROM lag(event_type) OVER w))::INTEGER AS new FROM f WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id))
SELECT event_id, user_id, (CASE WHEN item THEN sum(new) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) END)::BIGINT AS num_id FROM n""")
def list_numbering(spark, sf_dir):
    rows = table(spark, sf_dir, "events").select("event_id", "user_id", "ts", "event_type")
    return seq.number_lists(rows, BY, ORDER, F.col("event_type") != "view", F.lit(False), F.col("event_type")).select("event_id", "user_id", "num_id")


@query("""SELECT event_id, user_id, event_type, value FROM (SELECT *, row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts DESC, event_id DESC) AS r FROM events) WHERE r = 1""")
def first_write_wins(spark, sf_dir):
    """The newest row of each key."""
    rows = table(spark, sf_dir, "events").select("event_id", "user_id", "event_type", "value", "ts")
    return seq.first_wins(rows, ["user_id", "event_type"], [F.desc("ts"), F.desc("event_id")]).drop("ts")


@query("""WITH i AS (SELECT user_id, epoch_us(ts) // 1000000 AS s, epoch_us(ts) // 1000000 + 1 + (value * 600)::BIGINT % 86400 AS e FROM events WHERE value IS NOT NULL),
r AS (SELECT *, max(e) OVER (PARTITION BY user_id ORDER BY s, e ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS reach FROM i)
SELECT user_id, reach::BIGINT AS gap_start, s::BIGINT AS gap_end FROM r WHERE s > reach""")
def coverage_gaps(spark, sf_dir):
    s = F.floor(F.unix_micros(F.col("ts").cast("timestamp")) / 1000000).cast("long")
    rows = table(spark, sf_dir, "events").where("value IS NOT NULL").select("user_id", s.alias("s"), (s + 1 + F.rint(F.col("value") * 600).cast("long") % 86400).alias("e"))
    return seq.uncovered(rows, BY, "s", "e")


@query("""SELECT event_id, user_id, coalesce(sum(len) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS "offset" FROM (SELECT *, length(event_type) + 1 AS len FROM events)""")
def running_offsets(spark, sf_dir):
    rows = table(spark, sf_dir, "events").select("event_id", "user_id", "ts", "event_type")
    return seq.offsets(rows, BY, ORDER, F.char_length("event_type") + 1).select("event_id", "user_id", "offset")


@query("""WITH c AS (SELECT user_id, event_type, count(*) AS n, min(event_id) AS first FROM events GROUP BY ALL)
SELECT user_id, event_type AS layout, n::BIGINT AS uses FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY n DESC, first) AS r FROM c) WHERE r = 1""")
def majority_layout(spark, sf_dir):
    counts = table(spark, sf_dir, "events").groupBy("user_id", "event_type").agg(F.count(F.lit(1)).alias("n"), F.min("event_id").alias("first"))
    best = F.struct(-F.col("n"), F.col("first"))
    return counts.groupBy("user_id").agg(F.min_by("event_type", best).alias("layout"), F.max("n").alias("uses"))


@query("""SELECT event_type, lang_rank, n FROM (SELECT event_type, n, row_number() OVER (ORDER BY n DESC, event_type)::INTEGER AS lang_rank FROM (SELECT event_type, count(*)::BIGINT AS n FROM events GROUP BY 1)) WHERE lang_rank <= 3""")
def frequency_topk(spark, sf_dir):
    counts = table(spark, sf_dir, "events").groupBy("event_type").agg(F.count(F.lit(1)).alias("n"))
    return counts.withColumn("lang_rank", F.row_number().over(Window.orderBy(F.desc("n"), "event_type"))).orderBy("lang_rank").limit(3)


@query("""SELECT user_id, min(ts) AS first_ts, max(ts) AS last_ts, count(*)::BIGINT AS n_events, count(DISTINCT event_type)::BIGINT AS n_types, bool_or(event_type = 'purchase') AS any_purchase, (count(*) FILTER (value > 50))::BIGINT AS n_large FROM events GROUP BY user_id""")
def user_facts(spark, sf_dir):
    """Greatest keys, distinct counts and whether any row holds a fact."""
    return table(spark, sf_dir, "events").groupBy("user_id").agg(F.min("ts").alias("first_ts"), F.max("ts").alias("last_ts"), F.count(F.lit(1)).alias("n_events"), F.count_distinct("event_type").alias("n_types"), F.bool_or(F.col("event_type") == "purchase").alias("any_purchase"), F.count_if(F.col("value") > 50).alias("n_large"))


@query("""SELECT date_trunc('hour', ts) AS window_start, event_type, count(*)::BIGINT AS n FROM events GROUP BY ALL""")
def hourly_windows(spark, sf_dir):
    """Tumbling windows, the batch form of the stream in ``streaming``."""
    rows = table(spark, sf_dir, "events").groupBy(F.window("ts", "1 hour"), "event_type").agg(F.count(F.lit(1)).alias("n"))
    return rows.select(F.col("window.start").alias("window_start"), "event_type", "n")


@query("""WITH RECURSIVE c AS (SELECT p_partkey AS node, p_partkey AS ancestor, 0 AS distance FROM part UNION ALL SELECT node, ancestor // 2, distance + 1 FROM c WHERE ancestor > 1 AND distance < 32)
SELECT node, ancestor, distance::INTEGER AS distance FROM c""")
def style_chain(spark, sf_dir):
    """Every node of a tree, each half of its number, with its ancestors."""
    rows = table(spark, sf_dir, "part").select(F.lit(0).alias("path"), "p_partkey", F.when(F.col("p_partkey") > 1, F.floor(F.col("p_partkey") / 2)).alias("base"))
    return recursion.chains(rows, ["path"], "p_partkey", "base").select("node", "ancestor", "distance")


@query("""WITH RECURSIVE c AS (SELECT p_partkey AS node, p_partkey AS a, 0 AS distance FROM part UNION ALL SELECT node, a // 2, distance + 1 FROM c WHERE a > 1 AND distance < 32),
v AS (SELECT node, distance, CASE WHEN p_size % 3 = 0 THEN p_size END AS size, CASE WHEN p_size % 2 = 0 THEN p_brand END AS font FROM c JOIN part ON p_partkey = a)
SELECT node AS p_partkey, arg_min(size, distance) FILTER (size IS NOT NULL) AS size, arg_min(font, distance) FILTER (font IS NOT NULL) AS font FROM v GROUP BY node""")
def style_inheritance(spark, sf_dir):
    """Properties from the nearest style of the chain that has them."""
    p = F.col("p_size")
    rows = table(spark, sf_dir, "part").select(F.lit(0).alias("path"), "p_partkey", F.when(F.col("p_partkey") > 1, F.floor(F.col("p_partkey") / 2)).alias("base"), F.when(p % 3 == 0, p).alias("size"), F.when(p % 2 == 0, F.col("p_brand")).alias("font"))
    return recursion.inherit(rows, ["path"], "p_partkey", "base", ["size", "font"]).select("p_partkey", "size", "font")


@query("""WITH RECURSIVE b AS (SELECT p_partkey AS id, CASE WHEN p_partkey > 5 THEN p_partkey // 5 END AS parent, (p_partkey * 37 % 900)::BIGINT AS x, (p_partkey * 53 % 700)::BIGINT AS y, (50 + p_partkey % 400)::BIGINT AS w, (40 + p_partkey % 300)::BIGINT AS h, 0::BIGINT AS gx, 10::BIGINT AS gy, (CASE WHEN p_partkey % 7 = 0 THEN 0 ELSE 1000 END)::BIGINT AS gw, 800::BIGINT AS gh FROM part),
t AS (SELECT *, 0 AS level FROM b WHERE parent IS NULL UNION ALL
 SELECT b.id, b.parent, CASE WHEN t.gw = 0 OR t.gh = 0 THEN b.x ELSE t.x + (b.x - t.gx) * t.w // t.gw END, CASE WHEN t.gw = 0 OR t.gh = 0 THEN b.y ELSE t.y + CASE WHEN b.y < t.gy THEN -((t.gy - b.y) * t.h // t.gh) ELSE (b.y - t.gy) * t.h // t.gh END END,
 CASE WHEN t.gw = 0 OR t.gh = 0 THEN b.w ELSE b.w * t.w // t.gw END, CASE WHEN t.gw = 0 OR t.gh = 0 THEN b.h ELSE b.h * t.h // t.gh END, b.gx, b.gy, b.gw, b.gh, t.level + 1 FROM t JOIN b ON b.parent = t.id)
SELECT id, level::INTEGER AS level, x, y, w, h FROM t""")
def group_transform(spark, sf_dir):
    """Boxes of nested groups in outer coordinates."""
    k = F.col("p_partkey")
    long = lambda c: c.cast("long")
    rows = table(spark, sf_dir, "part").select(F.lit(0).alias("path"), k.alias("id"), F.when(k > 5, F.floor(k / 5)).alias("parent"), long(k * 37 % 900).alias("x"), long(k * 53 % 700).alias("y"), long(50 + k % 400).alias("w"), long(40 + k % 300).alias("h"), long(F.lit(0)).alias("gx"), long(F.lit(10)).alias("gy"), long(F.when(k % 7 == 0, 0).otherwise(1000)).alias("gw"), long(F.lit(800)).alias("gh"))
    return recursion.nested_boxes(rows, ["path"]).drop("path")


@query("""WITH i AS (SELECT event_id, user_id, epoch_us(ts) // 1000000 AS s FROM events), r AS (SELECT user_id AS u, event_id AS run, s AS rs, s + 7200 AS re FROM i)
SELECT event_id, run, greatest(s, rs)::BIGINT AS clip_start, least(s + 3600, re)::BIGINT AS clip_end FROM i JOIN r ON user_id = u AND s < re AND rs < s + 3600""")
def run_overlaps(spark, sf_dir):
    """Overlapping intervals, clipped, met by buckets."""
    s = F.floor(F.unix_micros(F.col("ts").cast("timestamp")) / 1000000).cast("long")
    rows = table(spark, sf_dir, "events").select("event_id", "user_id", s.alias("s"), (s + 3600).alias("e"))
    runs = rows.select("user_id", F.col("event_id").alias("run"), F.col("s").alias("rs"), (F.col("s") + 7200).alias("re"))
    return joins.overlaps(rows, runs, BY, "s", "e", "rs", "re", width=14400).select("event_id", "run", "clip_start", "clip_end")
