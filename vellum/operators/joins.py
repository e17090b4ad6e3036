"""Joins: dictionaries, ranges, rectangles, places, differences."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Width of the buckets by which ranges meet.
BUCKET = 4096


def lookup(df: DataFrame, table: DataFrame, on: list[str], defaults: dict[str, object] | None = None) -> DataFrame:
    """Left join with a table of one row for each key, defaults where none is.
    Spark broadcasts the table if its size allows."""
    out = df.join(table, on, "left")
    for c, v in (defaults or {}).items():
        out = out.withColumn(c, F.coalesce(F.col(c), F.lit(v)))
    return out


def _buckets(start: Column, end: Column, width: int) -> Column:
    """Numbers of the buckets that [start, end) meets, one at least."""
    a, b = F.floor(start / width), F.floor((F.greatest(end, start + 1) - 1) / width)
    return F.explode(F.sequence(a, b))


def points_in_ranges(points: DataFrame, ranges: DataFrame, by: list[str], point: str, start: str, end: str, first: list[str], keep: list[str], width: int = BUCKET) -> DataFrame:
    """Each row of ``points`` with the first range (by ``first``, nulls last)
    that holds its point, nulls where none does.

    Distinct points and ranges meet by partition and bucket, so a long
    partition is dealt over many tasks, and the other columns of the points
    move only once. Repeated rows stay; points and ranges with a null in
    ``by``, and null points, meet nothing."""
    key = "__bucket"
    rest = list(dict.fromkeys([*first, *keep]))
    cut = ranges.select(*[F.col(c).alias(f"__k_{c}") for c in by], F.col(start).alias("__s"), F.col(end).alias("__e"), *[F.col(c).alias(f"__r_{c}") for c in rest], _buckets(F.col(start), F.col(end), width).alias(key))
    pts = points.select(*by, F.col(point).alias("__p")).where(F.col("__p").isNotNull()).distinct().withColumn("__at", F.floor(F.col("__p") / width))
    on = [F.col(c) == F.col(f"__k_{c}") for c in by] + [F.col("__at") == F.col(key), F.col("__p") >= F.col("__s"), F.col("__p") < F.col("__e")]
    order = F.struct(*[x for c in first for x in (F.col(f"__r_{c}").isNull().alias(f"{c}_none"), F.col(f"__r_{c}").alias(c))])
    best = pts.join(cut, on).groupBy(*by, "__p").agg(F.min_by(F.struct(*[F.col(f"__r_{c}").alias(c) for c in keep]), order).alias("__best"))
    best = best.withColumnsRenamed({c: f"__k_{c}" for c in by})
    met = points.join(best, [F.col(c) == F.col(f"__k_{c}") for c in by] + [F.col(point) == F.col("__p")], "left")
    return met.select(*[F.col(c) for c in points.columns if c not in keep or c in by], *[F.col("__best")[c].alias(c) for c in keep if c not in by])


def overlaps(left: DataFrame, right: DataFrame, by: list[str], start: str, end: str, r_start: str, r_end: str, width: int = BUCKET) -> DataFrame:
    """Every pair of overlapping intervals once, clipped: clip_start and
    clip_end. Columns of the two must differ but for ``by``."""
    key = "__bucket"
    a = left.withColumn(key, _buckets(F.col(start), F.col(end), width))
    b = right.withColumn(key, _buckets(F.col(r_start), F.col(r_end), width))
    lo, hi = F.greatest(start, r_start), F.least(end, r_end)
    met = a.join(b, [*by, key]).where((lo < hi) & (F.floor(lo / width) == F.col(key)))
    return met.drop(key).withColumns({"clip_start": lo, "clip_end": hi})


def in_front_of(df: DataFrame, by: list[str], order: str, center: tuple[Column, Column], box: tuple[str, str, str, str], shown: Column, behind: Column, cell: int) -> DataFrame:
    """Rows with ``shown`` whose center lies in the box (left, top, width,
    height) of an earlier row with ``behind``; a semi join over a grid of
    ``cell``, so that only near boxes meet."""
    x, y = center
    left, top, width, height = box
    pts = df.where(shown).withColumns({"__x": x, "__y": y})
    pts = pts.withColumns({"__gx": F.floor(F.col("__x") / cell), "__gy": F.floor(F.col("__y") / cell)})
    back = df.where(behind)
    grid = lambda a, n: F.explode(F.sequence(F.floor(F.col(a) / cell), F.floor((F.col(a) + F.col(n)) / cell)))
    back = back.select(*[F.col(c).alias(f"__b_{c}") for c in dict.fromkeys([*by, order, *box])], grid(left, width).alias("__bx")).select("*", F.explode(F.sequence(F.floor(F.col(f"__b_{top}") / cell), F.floor((F.col(f"__b_{top}") + F.col(f"__b_{height}")) / cell))).alias("__by"))
    b = lambda c: F.col(f"__b_{c}")
    on = [F.col(c) == b(c) for c in by] + [F.col("__gx") == F.col("__bx"), F.col("__gy") == F.col("__by"), b(order) < F.col(order)]
    on += [F.col("__x").between(b(left), b(left) + b(width)), F.col("__y").between(b(top), b(top) + b(height))]
    return pts.join(back, on, "left_semi").drop("__x", "__y", "__gx", "__gy")


def by_place(left: DataFrame, right: DataFrame, by: list[str], left_order: list[str], right_order: list[str], how: str = "inner", name: str = "place") -> DataFrame:
    """The nth row of a partition with the nth of the other's."""
    a = left.withColumn(name, F.row_number().over(Window.partitionBy(*by).orderBy(*left_order)))
    b = right.withColumn(name, F.row_number().over(Window.partitionBy(*by).orderBy(*right_order)))
    return a.join(b, [*by, name], how)


#: Characters up to which a text is looked for by its substrings.
SHORT = 80


def _holding(long: DataFrame, short: DataFrame, by: list[str], a: str, b: str) -> DataFrame:
    """(by, a, b): texts a with the other table's texts b that they hold. Texts
    of up to ``SHORT`` characters meet by their substrings, of the lengths that
    b has, so only what matches meets; longer ones by a scan of their group."""
    sizes = short.groupBy(*by).agg(F.sort_array(F.collect_set(F.char_length(b))).alias("__sizes"))
    brief = long.where(F.char_length(a) <= SHORT).join(sizes, by)
    cuts = F.transform(F.filter("__sizes", lambda n: (n > 0) & (n <= F.char_length(a))), lambda n: F.transform(F.sequence(F.lit(1), F.char_length(a) - n + 1), lambda i: F.substring(F.col(a), i, n)))
    met = brief.select(*by, a, F.explode(F.array_distinct(F.flatten(cuts))).alias(b)).join(short, [*by, b])
    rest = long.where(F.char_length(a) > SHORT).join(short, by).where((F.length(b) > 0) & F.col(a).contains(F.col(b)))
    return met.select(*by, a, b).unionByName(rest.select(*by, a, b))


def best_titles(entries: DataFrame, titles: DataFrame, by: list[str], entry: str, title: str, entry_id: str, title_id: str) -> DataFrame:
    """Each entry's best title of its partition: an equal one, the first of
    such, else the one that holds the entry or that it holds with the least
    difference in length, the first of equal ones. Entries without are left
    out, empty and null texts match nothing. Titles are not used up;
    ``match_titles`` does that. Texts that stand several times are matched
    once."""
    firsts = titles.where(F.length(title) > 0).groupBy(*by, title).agg(F.min(title_id).alias(title_id))
    texts = entries.where(F.length(entry) > 0).select(*by, entry).distinct()
    pairs = _holding(texts, firsts.select(*by, title), by, entry, title).unionByName(_holding(firsts.select(*by, title), texts, by, title, entry)).distinct()
    gap = F.abs(F.char_length(entry) - F.char_length(title))
    met = pairs.join(firsts, [*by, title]).withColumn("gap", gap)
    order = F.struct(F.when(F.col(entry) == F.col(title), 0).otherwise(1).alias("o"), "gap", title_id)
    best = met.groupBy(*by, entry).agg(F.min_by(F.struct(title, title_id, "gap"), order).alias("__best"))
    return entries.join(best, [*by, entry]).select(*[entries[c] for c in entries.columns], "__best.*")


def match_titles(entries: DataFrame, titles: DataFrame, by: list[str], entry: str, title: str, entry_id: str, title_id: str) -> DataFrame:
    """As ``best_titles``, but the entries choose one after the other, and a
    title taken by an equal entry is gone for later ones. The nth entry of a
    text takes the nth title of that text, which orders the equal matches; the
    others choose among the titles not gone before them."""
    ew, tw = Window.partitionBy(*by, entry).orderBy(entry_id), Window.partitionBy(*by, title).orderBy(title_id)
    e = entries.withColumn("__nth", F.row_number().over(ew))
    t = titles.withColumn("__nth", F.row_number().over(tw))
    taken = e.select(*by, F.col(entry).alias("__text"), F.col(entry_id).alias("__by"), "__nth")
    t = t.join(taken, [*[t[c] == taken[c] for c in by], F.col(title) == F.col("__text"), t["__nth"] == taken["__nth"]], "left").select(t["*"], "__by").drop("__nth")
    met = e.join(t, by).where((F.col("__by").isNull() | (F.col("__by") >= F.col(entry_id))) & (F.col(entry).contains(F.col(title)) | F.col(title).contains(F.col(entry))))
    gap = F.abs(F.octet_length(entry) - F.octet_length(title))
    own = F.coalesce(F.col("__by") == F.col(entry_id), F.lit(False))
    w = Window.partitionBy(*by, entry_id).orderBy(F.when(own, 0).otherwise(1), gap, title_id)
    return met.withColumns({"gap": gap.cast("long"), "__n": F.row_number().over(w)}).where("__n = 1").drop("__n", "__nth", "__by")


def missing(refs: DataFrame, targets: DataFrame, on: list[str]) -> DataFrame:
    """References without a target."""
    return refs.join(targets, on, "left_anti")


def fill_missing(main: DataFrame, other: DataFrame, on: list[str]) -> DataFrame:
    """``main`` and the rows of ``other`` whose key it lacks."""
    return main.unionByName(other.join(main.select(*on).distinct(), on, "left_anti"))


def first_source(df: DataFrame, by: list[str], priority: str) -> DataFrame:
    """For each key all rows of the best source that has any."""
    w = Window.partitionBy(*by)
    return df.withColumn("__best", F.min(priority).over(w)).where(F.col(priority) == F.col("__best")).drop("__best")


def difference(a: DataFrame, b: DataFrame, on: list[str], value: str) -> DataFrame:
    """All keys of two tables with their state: ``-`` in the first alone, ``+``
    in the second alone, ``=`` equal, ``~`` changed."""
    x = a.select(*on, F.col(value).alias("value_a"), F.lit(True).alias("__a"))
    y = b.select(*on, F.col(value).alias("value_b"), F.lit(True).alias("__b"))
    state = F.when(F.col("__b").isNull(), "-").when(F.col("__a").isNull(), "+").when(F.col("value_a").eqNullSafe(F.col("value_b")), "=").otherwise("~")
    return x.join(y, on, "full_outer").select(*on, "value_a", "value_b", state.alias("state"))
