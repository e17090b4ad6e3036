from pyspark.sql import functions as F

from vellum.operators import audit, joins


def test_reports(spark):
    df = spark.createDataFrame([("a", "red"), ("a", "red"), ("a", "blue"), ("b", "red")], "path string, color string")
    assert {(r.path, r.color): (r.n, round(r.pct, 2)) for r in audit.frequency(df, ["color"], ["path"]).collect()} == {("a", "red"): (2, 66.67), ("a", "blue"): (1, 33.33), ("b", "red"): (1, 100.0)}
    assert round(audit.frequency(df, ["color"]).where("color = 'red'").first().pct) == 75
    assert {(r.path, r.color) for r in audit.top(df, ["color"], 1, ["path"]).collect()} == {("a", "red"), ("b", "red")}
    assert {(r.path, r.n_blue, r.any_blue) for r in audit.facts(df, ["path"], blue=F.col("color") == "blue").collect()} == {("a", 1, True), ("b", 0, False)}
    assert [tuple(r) for r in audit.counts_differ(df, df.where("path = 'a'"), ["path"]).collect()] == [("b", 1, 0)]
    assert audit.in_range(df.withColumn("i", F.length("color")), "i", 4, 9, "bl", "color").count() == 1


def test_lost_texts(spark):
    a = spark.createDataFrame([("p", "one  two"), ("p", "two"), ("p", "gone"), ("q", "one two"), ("p", " ")], "path string, text string")
    b = spark.createDataFrame([("p", "x one two y"), ("p", "two")], "path string, text string")
    assert {tuple(r) for r in audit.lost_texts(a, b, ["path"]).collect()} == {("p", "gone"), ("q", "one two")}


def test_titles_are_used_up_in_order(spark):
    e = spark.createDataFrame([("p", 1, "Intro"), ("p", 2, "Intro"), ("p", 3, "Intro"), ("p", 4, "Results 4"), ("p", 5, "none")], "path string, entry_id int, entry string")
    t = spark.createDataFrame([("p", 10, "Intro"), ("p", 11, "Intro"), ("p", 12, "Results"), ("p", 13, "More results 4")], "path string, title_id int, title string")
    out = joins.match_titles(e, t, ["path"], "entry", "title", "entry_id", "title_id")
    assert {(r.entry_id, r.title_id) for r in out.collect()} == {(1, 10), (2, 11), (4, 12)}
