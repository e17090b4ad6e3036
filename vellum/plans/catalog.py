"""All named queries over the driver's tables, and SQL of the same results."""

from __future__ import annotations

from pyspark.sql import functions as F

from vellum.operators import sequence as seq
from vellum.plans import cells, details, events, legacy, matching, registry, roundtrip, text  # noqa: F401  (they enter their queries)


def flagship(spark, sf_dir):
    """Paragraphs with runs of short ones collapsed, list numbers and page
    breaks: one exchange by document for all of it."""
    rows = text.paragraphs(spark, sf_dir)
    short = F.char_length("text") < 60
    rows = seq.number_lists(rows, text.BY, text.ORDER, F.col("text").contains("the"), short, F.char_length("text") % 2)
    rows = seq.page_breaks(rows, text.BY, text.ORDER, short, F.lit(True), long_run=3, short_run=2)
    return seq.collapse_runs(rows, text.BY, text.ORDER, short).select("doc_id", "para_idx", "cp_start", "num_id", "break_before")


def queries() -> dict:
    return dict(registry.QUERIES)


def oracle_sql() -> dict:
    return dict(registry.SQL)
