"""Reports on what files hold and on how two versions of them differ."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from vellum.functions import text as tx


def frequency(df: DataFrame, by: list[str], of: list[str] | None = None) -> DataFrame:
    """Rows of each combination with their share, in percent, within ``of``
    (all rows without it): n, pct. Only the counts meet by ``of``."""
    counts = df.groupBy(*(of or []), *by).agg(F.count(F.lit(1)).alias("n"))
    whole = Window.partitionBy(*(of or [F.lit(0)]))
    return counts.withColumn("pct", F.lit(100.0) * F.col("n") / F.sum("n").over(whole))


def top(df: DataFrame, by: list[str], most: int, of: list[str]) -> DataFrame:
    """The ``most`` frequent combinations within each ``of``, ties by value."""
    w = Window.partitionBy(*of).orderBy(F.desc("n"), *by)
    return frequency(df, by, of).withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= most)


def facts(df: DataFrame, by: list[str], **flags: Column) -> DataFrame:
    """For each group how many rows each condition holds for (n_...) and
    whether it holds for any (any_...)."""
    n = [F.count_if(c).alias(f"n_{k}") for k, c in flags.items()]
    some = [F.coalesce(F.bool_or(c), F.lit(False)).alias(f"any_{k}") for k, c in flags.items()]
    return df.groupBy(*by).agg(F.count(F.lit(1)).alias("n"), *n, *some)


def counts_differ(a: DataFrame, b: DataFrame, by: list[str]) -> DataFrame:
    """Groups whose numbers of rows differ: n_a, n_b, 0 where there is none."""
    x = a.groupBy(*by).agg(F.count(F.lit(1)).alias("n_a"))
    y = b.groupBy(*by).agg(F.count(F.lit(1)).alias("n_b"))
    both = x.join(y, by, "full_outer").na.fill(0, ["n_a", "n_b"])
    return both.where(F.col("n_a") != F.col("n_b"))


def lost_texts(source: DataFrame, output: DataFrame, by: list[str], text: str = "text") -> DataFrame:
    """Texts of the source that no text of the output's group holds, white
    space aside. Equal texts drop out by a hash join first, so containment is
    tried only for the rest, within a group."""
    a = source.select(*by, F.col(text).alias("text"), tx.squeeze(F.col(text)).alias("__t")).where(F.length("__t") > 0)
    b = output.select(*by, tx.squeeze(F.col(text)).alias("__t")).where(F.length("__t") > 0).distinct()
    rest = a.join(b, [*by, "__t"], "left_anti")
    whole = b.withColumnsRenamed({"__t": "__o", **{c: f"__{c}" for c in by}})
    return rest.join(whole, [*[F.col(c) == F.col(f"__{c}") for c in by], F.col("__o").contains(F.col("__t"))], "left_anti").drop("__t")


def in_range(df: DataFrame, column: str, first: int, last: int, holds: str | None = None, text: str = "text") -> DataFrame:
    """Rows of a range of slides or paragraphs, if asked those with a text."""
    out = df.where(F.col(column).between(first, last))
    return out.where(F.col(text).contains(holds)) if holds else out
