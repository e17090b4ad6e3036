"""Cells, dictionaries, formats, dates, colors and lengths over the tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from vellum.functions import color, dates, numbers, units
from vellum.functions import text as tx
from vellum.operators import joins
from vellum.operators import sequence as seq
from vellum.plans.registry import query, table


@query("""WITH d AS (SELECT p_brand, p_type, row_number() OVER (PARTITION BY p_brand ORDER BY first, p_type) - 1 AS idx FROM (SELECT p_brand, p_type, min(p_partkey) AS first FROM part GROUP BY p_brand, p_type))
SELECT p_partkey, p_brand, idx::BIGINT AS sst_idx FROM part JOIN d USING (p_brand, p_type)""")
def shared_strings(spark, sf_dir):
    """Strings of each workbook numbered by first appearance, cells by number."""
    cells = table(spark, sf_dir, "part").select("p_partkey", "p_brand", "p_type")
    strings = seq.dictionary(cells, ["p_brand"], "p_type", ["p_partkey"], "sst_idx")
    return cells.join(strings, ["p_brand", "p_type"]).select("p_partkey", "p_brand", "sst_idx")


@query("""WITH s AS (SELECT conv_id, max(turn) AS rows_ FROM conversations GROUP BY 1),
g AS (SELECT conv_id, r.v AS turn, k.v AS col FROM s, LATERAL (SELECT unnest(range(rows_ + 1)) AS v) r, LATERAL (SELECT unnest(range(3)) AS v) k)
SELECT g.conv_id, g.turn::BIGINT AS turn, g.col::BIGINT AS col, c.role, c.chars FROM g LEFT JOIN (SELECT conv_id, turn, CASE role WHEN 'user' THEN 0 WHEN 'assistant' THEN 1 ELSE 2 END AS col, max(role) AS role, max(length(text))::INTEGER AS chars FROM conversations GROUP BY ALL) c ON c.conv_id = g.conv_id AND c.turn = g.turn AND c.col = g.col""")
def dense_grid(spark, sf_dir):
    """Every place of each sheet's grid, blanks where there is no cell."""
    col = F.when(F.col("role") == "user", 0).when(F.col("role") == "assistant", 1).otherwise(2).cast("long")
    cells = table(spark, sf_dir, "conversations").select("conv_id", "turn", col.alias("col"), "role", F.char_length("text").alias("chars"))
    cells = cells.groupBy("conv_id", "turn", "col").agg(F.max("role").alias("role"), F.max("chars").alias("chars"))
    return seq.densify(cells, ["conv_id"], "turn", "col", "role", "chars", n_columns=3)


@query("""SELECT s_suppkey, CASE WHEN n_nationkey IS NULL THEN 15 ELSE n_nationkey END::INTEGER AS xf, coalesce(r_name, 'General') AS format FROM supplier
LEFT JOIN (SELECT * FROM nation WHERE n_nationkey % 3 <> 0) ON s_nationkey = n_nationkey LEFT JOIN region ON n_regionkey = r_regionkey""")
def dict_two_hop_default(spark, sf_dir):
    """Cell to its XF, else 15, then to its format, else General."""
    xf = table(spark, sf_dir, "nation").where("n_nationkey % 3 <> 0").select(F.col("n_nationkey").alias("s_nationkey"), "n_nationkey", F.col("n_regionkey").alias("r_regionkey"))
    cells = joins.lookup(table(spark, sf_dir, "supplier").select("s_suppkey", "s_nationkey"), xf, ["s_nationkey"], {"n_nationkey": 15})
    cells = joins.lookup(cells, table(spark, sf_dir, "region").select("r_regionkey", "r_name"), ["r_regionkey"], {"r_name": "General"})
    return cells.select("s_suppkey", F.col("n_nationkey").alias("xf"), F.col("r_name").alias("format"))


@query("""SELECT o_orderkey, (epoch_us(o_orderdate) / 86400000000.0 + 25569)::DOUBLE AS serial, (epoch_us(o_orderdate) / 86400000000.0 + 24107)::DOUBLE AS serial_1904,
 make_timestamp(((floor(25569 + o_custkey / 8.0)::BIGINT - 25569) * 86400000000 + round((o_custkey / 8.0 - floor(o_custkey / 8.0)) * 86400000000)::BIGINT)) AS stamp FROM orders""")
def excel_serial_dates(spark, sf_dir):
    own = F.lit(25569) + F.col("o_custkey") / 8.0
    return table(spark, sf_dir, "orders").select("o_orderkey", dates.to_serial(F.col("o_orderdate")).alias("serial"), dates.to_serial(F.col("o_orderdate"), True).alias("serial_1904"), dates.to_timestamp(own).alias("stamp"))


@query("""SELECT l_orderkey, l_linenumber, CASE l_linenumber % 4 WHEN 0 THEN printf('%.2f', l_discount * 100) || '%' WHEN 1 THEN printf('%.2f', l_extendedprice) WHEN 2 THEN printf('%.0f', l_quantity) ELSE strftime(make_timestamp(((l_partkey + 40000 - 25569) * 86400000000)::BIGINT), '%d/%m/%Y') END AS shown FROM lineitem""")
def format_render(spark, sf_dir):
    """Numbers as custom formats show them: percent, two places, whole, date."""
    k = F.col("l_linenumber") % 4
    value = F.when(k == 0, F.col("l_discount")).when(k == 1, F.col("l_extendedprice")).when(k == 2, F.col("l_quantity")).otherwise((F.col("l_partkey") + 40000).cast("double"))
    pattern = F.when(k == 0, "0.00%").when(k == 1, "#,##0.00").when(k == 2, "0").otherwise("DD/MM/YYYY")
    return table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", numbers.render(value, pattern, F.lit(164)).alias("shown"))


@query("""SELECT c_custkey, CASE WHEN i < 26 THEN chr((65 + i)::INTEGER) WHEN i < 702 THEN chr((65 + (i - 26) // 26)::INTEGER) || chr((65 + (i - 26) % 26)::INTEGER) ELSE chr((65 + (i - 702) // 676)::INTEGER) || chr((65 + (i - 702) // 26 % 26)::INTEGER) || chr((65 + (i - 702) % 26)::INTEGER) END AS letters,
 CASE WHEN i < 26 THEN chr((65 + i)::INTEGER) WHEN i < 702 THEN chr((65 + (i - 26) // 26)::INTEGER) || chr((65 + (i - 26) % 26)::INTEGER) ELSE chr((65 + (i - 702) // 676)::INTEGER) || chr((65 + (i - 702) // 26 % 26)::INTEGER) || chr((65 + (i - 702) % 26)::INTEGER) END || (c_nationkey + 1) AS ref
FROM (SELECT *, c_custkey % 16384 AS i FROM customer)""")
def column_letters(spark, sf_dir):
    i = F.col("c_custkey") % 16384
    return table(spark, sf_dir, "customer").select("c_custkey", tx.column_letters(i).alias("letters"), tx.cell_reference(i, F.col("c_nationkey")).alias("ref"))


_RGB = "printf('%02X%02X%02X', (k & 255)::INTEGER, ((k >> 8) & 255)::INTEGER, ((k >> 16) & 255)::INTEGER)"


@query(f"""WITH c AS (SELECT p_partkey, (p_partkey * 7919 % 16777216)::BIGINT AS k FROM part), v AS (SELECT *, {_RGB} AS rgb, 0.299 * (k & 255)::DOUBLE + 0.587 * ((k >> 8) & 255)::DOUBLE + 0.114 * ((k >> 16) & 255)::DOUBLE AS light,
 greatest(k & 255, (k >> 8) & 255, (k >> 16) & 255) - least(k & 255, (k >> 8) & 255, (k >> 16) & 255) AS spread,
 ((k & 255) - 68) ** 2 + (((k >> 8) & 255) - 114) ** 2 + (((k >> 16) & 255) - 196) ** 2 AS far FROM c)
SELECT p_partkey, rgb, light < 128 AS dark, light > 230 OR (light > 180 AND spread < 80) AS near_white, far < 15000 AS low_contrast,
 CASE p_partkey % 10 WHEN 2 THEN '0000FF' WHEN 3 THEN '00FFFF' WHEN 4 THEN '00FF00' WHEN 5 THEN 'FF00FF' WHEN 6 THEN 'FF0000' WHEN 7 THEN 'FFFF00' WHEN 8 THEN 'FFFFFF' ELSE '000000' END AS palette FROM v""")
def color_metrics(spark, sf_dir):
    rgb = color.from_reference(F.col("p_partkey") * 7919 % 16777216)
    rows = table(spark, sf_dir, "part").select("p_partkey", rgb.alias("rgb"))
    c = F.col("rgb")
    return rows.select("p_partkey", "rgb", color.is_dark(c).alias("dark"), color.is_near_white(c).alias("near_white"), color.is_low_contrast(c, F.lit("4472C4")).alias("low_contrast"), color.from_palette(F.col("p_partkey") % 10).alias("palette"))


@query("""WITH s AS (SELECT p_partkey, CASE p_partkey % 5 WHEN 0 THEN (p_partkey % 9) * 16777216 WHEN 1 THEN 134217728 + p_partkey % 12 WHEN 2 THEN 4261412864 WHEN 3 THEN 4261412864 + 77 ELSE p_partkey END AS raw FROM part),
i AS (SELECT *, raw >> 24 AS high, raw & 255 AS low FROM s)
SELECT p_partkey, CASE WHEN high BETWEEN 1 AND 7 THEN 'SCHEM' || high WHEN high = 8 AND low < 8 THEN 'SCHEM' || low WHEN high = 254 AND raw & 16777215 = 0 THEN 'SCHEM0' ELSE 'ABCDEF' END AS color FROM i""")
def scheme_colors(spark, sf_dir):
    k = F.col("p_partkey")
    raw = F.when(k % 5 == 0, (k % 9) * 16777216).when(k % 5 == 1, F.lit(8 << 24) + k % 12).when(k % 5 == 2, F.lit(254 << 24)).when(k % 5 == 3, F.lit((254 << 24) + 77)).otherwise(k)
    scheme = F.array(*[F.lit(f"SCHEM{i}") for i in range(8)])
    return table(spark, sf_dir, "part").select("p_partkey", color.resolve(F.lit("ABCDEF"), raw, scheme).alias("color"))


@query("""WITH s AS (SELECT p_partkey, p_partkey * 97 - 3000 AS m, p_size::BIGINT * 65536 * 13 - 9000000 AS r, p_partkey * 331 % 70000 AS c FROM part)
SELECT p_partkey, trunc(m * 12700 / 8.0)::BIGINT AS emu, m * 360 AS mm_emu, m * 635 AS twip_emu, trunc(m * 914400 / 96.0)::BIGINT AS px_emu, trunc(c * 100000 / 65536.0)::BIGINT AS crop,
 ((trunc(r * 60000 / 65536.0)::BIGINT % 21600000 + 21600000) % 21600000)::BIGINT AS rotation FROM s""")
def unit_conversions(spark, sf_dir):
    m, r, c = F.col("p_partkey") * 97 - 3000, F.col("p_size").cast("long") * 65536 * 13 - 9000000, F.col("p_partkey") * 331 % 70000
    return table(spark, sf_dir, "part").select("p_partkey", units.from_master(m).alias("emu"), units.from_hundredth_mm(m).alias("mm_emu"), units.from_twips(m).alias("twip_emu"), units.from_pixels(m).alias("px_emu"), units.crop(c).alias("crop"), units.rotation(r).alias("rotation"))


@query("""SELECT o_orderkey, CASE o_orderkey % 4 WHEN 2 THEN (o_custkey - 500)::DOUBLE WHEN 3 THEN (o_custkey - 500) / 100.0 WHEN 0 THEN o_custkey::DOUBLE ELSE o_custkey / 100.0 END::DOUBLE AS value FROM orders""")
def packed_numbers(spark, sf_dir):
    """Packed numbers: signed integers, and doubles by their high bits. These
    hold whole numbers from 1 to 2^19, others go as integers; an order whose
    number is null or has over 30 bits has no packed number and a null value."""
    n, k = F.col("o_custkey").cast("long"), F.col("o_orderkey") % 4
    rows = table(spark, sf_dir, "orders").select("o_orderkey", k.alias("k"), F.when(k >= 2, n - 500).otherwise(n).alias("n"))
    n, k = F.col("n"), F.col("k")
    # high bits of the doubles of whole numbers: exponent and 20 bits
    e = F.floor(F.log2(n))
    high = F.shiftleft((e + 1023).cast("long"), 20).bitwiseOR(((n / F.pow(F.lit(2.0), e) - 1) * (1 << 20)).cast("long"))
    whole = F.when(n.between(-(1 << 29), (1 << 29) - 1), F.shiftleft(n, 2).bitwiseOR(F.lit(2)))
    rk = F.when((k < 2) & n.between(1, 1 << 19), high).otherwise(whole).bitwiseOR(k.bitwiseAND(F.lit(1)))
    return rows.select("o_orderkey", numbers.decode_rk(rk).alias("value"))


@query("""SELECT l_returnflag, l_linestatus, count(*)::BIGINT AS n, (count(*) FILTER (l_quantity > 25))::BIGINT AS n_large, max(l_linenumber)::INTEGER AS last_row, round(100.0 * count(*) FILTER (l_discount = 0) / count(*), 6) AS pct_plain FROM lineitem GROUP BY ALL""")
def frequency_report(spark, sf_dir):
    rows = table(spark, sf_dir, "lineitem").groupBy("l_returnflag", "l_linestatus")
    return rows.agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("l_quantity") > 25).alias("n_large"), F.max("l_linenumber").alias("last_row"), F.round(F.lit(100.0) * F.count_if(F.col("l_discount") == 0) / F.count(F.lit(1)), 6).alias("pct_plain"))


@query("""SELECT l_orderkey, l_linenumber, row_idx::BIGINT AS row_idx, (row_number() OVER (PARTITION BY l_orderkey, row_idx ORDER BY l_linenumber, l_partkey, l_suppkey, l_extendedprice) - 1)::BIGINT AS cell_idx FROM
(SELECT *, coalesce(sum((l_returnflag = 'R')::INTEGER) OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_extendedprice ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS row_idx FROM lineitem)""")
def row_cell_grouping(spark, sf_dir):
    """Cells grouped into rows by end marks."""
    order = ["l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice"]
    rows = table(spark, sf_dir, "lineitem").select("l_orderkey", *order, "l_returnflag")
    return seq.group_by_ends(rows, ["l_orderkey"], order, F.col("l_returnflag") == "R").select("l_orderkey", "l_linenumber", "row_idx", "cell_idx")


@query("""WITH c AS (SELECT *, CASE WHEN p_size % 4 = 0 THEN 'Blank' WHEN p_size % 4 = 1 THEN 'Rk' WHEN p_size % 4 = 2 THEN 'Number' ELSE 'LabelSSt' END AS cell_type FROM part)
SELECT p_partkey, cell_type, CASE WHEN cell_type IN ('Rk', 'Number') THEN p_retailprice END AS num_val, CASE WHEN cell_type = 'LabelSSt' THEN p_name END AS str_val, cell_type <> 'Blank' AS kept FROM c""")
def cell_values(spark, sf_dir):
    """Cells by type: numeric, text, or skipped."""
    k = F.col("p_size") % 4
    kind = F.when(k == 0, "Blank").when(k == 1, "Rk").when(k == 2, "Number").otherwise("LabelSSt")
    from vellum.operators import cells

    rows = table(spark, sf_dir, "part").select("p_partkey", kind.alias("cell_type"), F.col("p_retailprice").alias("num_val"), F.col("p_name").alias("str_val"))
    out = cells.values(rows)
    return out.select("p_partkey", "cell_type", F.col("numeric").alias("num_val"), F.col("string").alias("str_val"), "kept")
