"""Operators over ordered rows, within a partition that is always named: runs,
gaps, offsets, groups by end marks. All are windows over one partitioning, so
a chain of them over the same keys shuffles once."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F


def ordered(by: list[str], order: list[str]) -> WindowSpec:
    return Window.partitionBy(*by).orderBy(*order)


def before(w: WindowSpec) -> WindowSpec:
    return w.rowsBetween(Window.unboundedPreceding, -1)


def upto(w: WindowSpec) -> WindowSpec:
    return w.rowsBetween(Window.unboundedPreceding, Window.currentRow)


def onward(w: WindowSpec) -> WindowSpec:
    return w.rowsBetween(Window.currentRow, Window.unboundedFollowing)


def split_paragraphs(df: DataFrame, text: str, marks: str = "\r\n\x07", **keep: str) -> DataFrame:
    """A row for each paragraph: para_idx from 0, its text, the separator that
    ends it (one of ``marks`` as a number, null at the end of the text) and
    cp_start, where it begins, each separator one place. An empty tail is no
    paragraph.

    ``keep`` names columns that come along, new name to column.
    """
    body = F.regexp_replace(F.col(text), "\r\n", "\r")
    cuts = F.regexp_extract_all(body, F.lit(f"([^{marks}]*)([{marks}]|$)"), F.lit(0))
    rows = df.select(*[F.col(c).alias(n) for n, c in keep.items()], F.posexplode(cuts).alias("para_idx", "cut"))
    rows = rows.where(F.length("cut") > 0)
    last = F.substring("cut", -1, 1)
    ended = last.isin(*marks)
    rows = rows.select(*keep, "para_idx", F.when(ended, F.expr("substring(cut, 1, length(cut) - 1)")).otherwise(F.col("cut")).alias("text"), F.when(ended, F.ascii(last)).alias("separator"))
    w = ordered(list(keep), ["para_idx"])
    return rows.withColumn("cp_start", F.coalesce(F.sum(F.char_length("text") + 1).over(before(w)), F.lit(0)).cast("long"))


def islands(df: DataFrame, by: list[str], order: list[str], same: list[Column], name: str = "island") -> DataFrame:
    """Number, from 1, the runs of rows for which all of ``same`` stay equal
    (null equals null)."""
    w = ordered(by, order)
    cols = [f"__same{i}" for i in range(len(same))]
    df = df.withColumns(dict(zip(cols, same)))
    moved = F.lit(False)
    for c in cols:
        moved |= ~F.col(c).eqNullSafe(F.lag(c).over(w))
    fresh = F.when(F.row_number().over(w) == 1, 1).otherwise(moved.cast("int"))
    return df.withColumn(name, F.sum(fresh).over(upto(w)).cast("long")).drop(*cols)


def run_places(df: DataFrame, by: list[str], order: list[str], flag: Column, name: str = "place") -> DataFrame:
    """The place, from 1, of each row in its run of rows with ``flag``; 0
    without it."""
    df = islands(df.withColumn("__flag", flag), by, order, [F.col("__flag")], "__run")
    w = ordered([*by, "__run"], order)
    return df.withColumn(name, F.when(F.col("__flag"), F.row_number().over(w)).otherwise(0).cast("long")).drop("__flag", "__run")


def collapse_runs(df: DataFrame, by: list[str], order: list[str], flag: Column, most: int = 1) -> DataFrame:
    """Rows with ``flag`` after the first ``most`` of their run go."""
    return run_places(df, by, order, flag, "__place").where(F.col("__place") <= most).drop("__place")


def number_lists(df: DataFrame, by: list[str], order: list[str], item: Column, heading: Column, *kind: Column) -> DataFrame:
    """num_id of list items, null for others: all headings that are items
    share 1, if there are any; other items get a new number after a row that
    is none, or where ``kind`` changes."""
    w = ordered(by, order)
    whole = Window.partitionBy(*by)
    names = [f"__kind{i}" for i in range(len(kind))]
    df = df.withColumns({"__item": F.coalesce(item, F.lit(False)), "__head": F.coalesce(heading, F.lit(False)), **dict(zip(names, kind))})
    plain = F.col("__item") & ~F.col("__head")
    df = df.withColumn("__plain", plain)
    moved = ~F.coalesce(F.lag("__plain").over(w), F.lit(False))
    for c in names:
        moved |= ~F.col(c).eqNullSafe(F.lag(c).over(w))
    df = df.withColumn("__new", (F.col("__plain") & moved).cast("int"))
    any_head = F.max((F.col("__item") & F.col("__head")).cast("int")).over(whole)
    number = F.when(F.col("__plain"), F.sum("__new").over(upto(w)) + any_head).when(F.col("__item"), F.lit(1))
    return df.withColumn("num_id", number.cast("long")).drop("__item", "__head", "__plain", "__new", *names)


def page_breaks(df: DataFrame, by: list[str], order: list[str], empty: Column, starter: Column, *, long_run: int = 10, short_run: int = 4) -> DataFrame:
    """break_before: rows with ``starter`` right behind a run of at least
    ``short_run`` empty rows, once a run of at least ``long_run`` has gone by;
    the first such run itself gives none."""
    w = ordered(by, order)
    df = run_places(df.withColumns({"__empty": empty, "__starter": starter}), by, order, F.col("__empty"), "__place")
    df = df.withColumn("__run", F.when(~F.col("__empty"), F.coalesce(F.lag("__place").over(w), F.lit(0))).otherwise(0))
    # how many long runs have ended before this row, and whether one ends here
    df = df.withColumn("__long", (F.col("__run") >= long_run).cast("int"))
    seen = F.coalesce(F.max("__long").over(before(w)), F.lit(0)) == 1
    return df.withColumn("break_before", F.col("__starter") & ~F.col("__empty") & (F.col("__run") >= short_run) & seen).drop("__empty", "__starter", "__place", "__run", "__long")


def fill_single_gaps(df: DataFrame, by: list[str], order: list[str], flag: str) -> DataFrame:
    """A row without ``flag`` between two with it gets it; the first and last
    row never do."""
    w = ordered(by, order)
    return df.withColumn(flag, F.col(flag) | (F.coalesce(F.lag(flag).over(w), F.lit(False)) & F.coalesce(F.lead(flag).over(w), F.lit(False))))


def group_by_ends(df: DataFrame, by: list[str], order: list[str], end: Column, name: str = "row_idx", cell: str = "cell_idx") -> DataFrame:
    """Groups, from 0, each closed by a row with ``end``, and each row's place
    in its group, from 0."""
    w = ordered(by, order)
    df = df.withColumn("__end", end.cast("int"))
    df = df.withColumn(name, F.coalesce(F.sum("__end").over(before(w)), F.lit(0)).cast("long")).drop("__end")
    return df.withColumn(cell, (F.row_number().over(ordered([*by, name], order)) - 1).cast("long"))


def table_columns(df: DataFrame, by: list[str], order: list[str], in_table: Column, row_end: Column, has_text: Column) -> DataFrame:
    """For each partition the cells between the first two row ends of one
    table that have any between them; without such, the rows with text before
    the first without in the first table; else 0."""
    df = islands(df.withColumns({"__in": in_table, "__end": in_table & row_end, "__text": has_text}), by, order, [in_table], "__table")
    w = ordered([*by, "__table"], order)
    df = df.withColumn("__row", F.coalesce(F.sum(F.col("__end").cast("int")).over(before(w)), F.lit(0)))
    inside = df.where("__in")
    at = F.struct(*order)
    rows = inside.groupBy(*by, "__table", "__row").agg(F.count_if(~F.col("__end")).alias("cells"), F.max("__end").alias("closed"), F.min(at).alias("at"))
    a = rows.where((F.col("__row") > 0) & F.col("closed") & (F.col("cells") > 0)).groupBy(*by).agg(F.min_by("cells", "at").alias("a"))
    first = inside.withColumn("__first", F.min("__table").over(Window.partitionBy(*by))).where(F.col("__table") == F.col("__first"))
    first = first.withColumn("__blank", F.coalesce(F.max((~F.col("__text")).cast("int")).over(upto(w)), F.lit(0)))
    b = first.groupBy(*by).agg(F.when(F.max("__blank") == 1, F.count_if(F.col("__blank") == 0)).otherwise(0).alias("b"))
    return df.select(*by).distinct().join(a, by, "left").join(b, by, "left").select(*by, F.coalesce("a", "b", F.lit(0)).cast("long").alias("n_columns"))


def first_wins(df: DataFrame, by: list[str], order: list[Column]) -> DataFrame:
    """The first row of each partition."""
    w = Window.partitionBy(*by).orderBy(*order)
    return df.withColumn("__rank", F.row_number().over(w)).where(F.col("__rank") == 1).drop("__rank")


def uncovered(df: DataFrame, by: list[str], start: str, end: str) -> DataFrame:
    """Gaps (gap_start, gap_end) before intervals, in order of their starts,
    that no earlier interval reaches."""
    w = Window.partitionBy(*by).orderBy(start, end)
    df = df.withColumn("__reach", F.max(end).over(before(w)))
    return df.where(F.col(start) > F.col("__reach")).select(*by, F.col("__reach").alias("gap_start"), F.col(start).alias("gap_end"))


def offsets(df: DataFrame, by: list[str], order: list[str], length: Column, name: str = "offset") -> DataFrame:
    """The sum of the lengths before each row."""
    return df.withColumn("__n", length).withColumn(name, F.coalesce(F.sum("__n").over(before(ordered(by, order))), F.lit(0)).cast("long")).drop("__n")


def transitions(df: DataFrame, by: list[str], order: list[str], flag: Column) -> DataFrame:
    """opens and closes: where runs of ``flag`` begin, and the rows behind
    their ends."""
    w = ordered(by, order)
    df = df.withColumn("__flag", flag)
    last = F.coalesce(F.lag("__flag").over(w), F.lit(False))
    return df.withColumns({"opens": F.col("__flag") & ~last, "closes": ~F.col("__flag") & last}).drop("__flag")


def drop_leading(df: DataFrame, by: list[str], order: list[str], flag: Column) -> DataFrame:
    """Rows with ``flag`` before the first without it go."""
    df = df.withColumn("__flag", flag.cast("int"))
    return df.withColumn("__all", F.min("__flag").over(upto(ordered(by, order)))).where("__all = 0").drop("__flag", "__all")


def densify(df: DataFrame, by: list[str], row: str, column: str, *values: str, n_columns: int | None = None) -> DataFrame:
    """The whole grid of each partition, from 0 to its greatest row and its
    greatest column (or ``n_columns`` in all), nulls where there is no row."""
    last = F.lit(n_columns - 1) if n_columns else F.max(column)
    size = df.groupBy(*by).agg(F.max(row).alias("__rows"), last.alias("__columns"))
    upto_ = lambda c: F.explode(F.sequence(F.lit(0).cast("long"), F.col(c).cast("long")))
    grid = size.select(*by, upto_("__rows").alias(row), "__columns").select(*by, row, upto_("__columns").alias(column))
    return grid.join(df.select(*by, F.col(row).cast("long").alias(row), F.col(column).cast("long").alias(column), *values), [*by, row, column], "left")


def dictionary(df: DataFrame, by: list[str], value: str, order: list[str], name: str = "idx") -> DataFrame:
    """Distinct values of each partition with their number, from 0, by first
    appearance. Values are grouped, in part before the shuffle, and only the
    distinct ones numbered."""
    seen = df.where(F.col(value).isNotNull()).groupBy(*by, value).agg(F.min(F.struct(*order)).alias("__first"))
    w = Window.partitionBy(*by).orderBy("__first", value)
    return seen.withColumn(name, (F.row_number().over(w) - 1).cast("long")).drop("__first")
