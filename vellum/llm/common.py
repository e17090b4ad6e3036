"""Shared pieces of the training-data operators: tables in the shared scratch
folder, batched document maps, and connected components of a link table."""

from __future__ import annotations

import itertools
import tempfile
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Text handled at once by a Python worker, which bounds what a batch's
#: results can take.
SLICE_BYTES = 4 << 20


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share, spark.checkpoint.dir. Where
    that is unset a temporary one takes its place on one machine, as in tests;
    on a cluster there is none to guess."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that driver and executors share")
        found = tempfile.mkdtemp(prefix="vellum-")
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


def _place(spark: SparkSession, tag: str) -> str:
    path = f"{shared_dir(spark)}/vellum-{tag}-{uuid.uuid4().hex}"
    hadoop = spark._jvm.org.apache.hadoop.fs.Path(path)
    hadoop.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(hadoop)
    return path


def stored(df: DataFrame, tag: str) -> DataFrame:
    """``df`` written as Parquet to the shared folder and read again, which
    cuts its lineage with files that outlive any executor. Removed by ``drop``
    or when the driver ends."""
    spark = df.sparkSession
    path = _place(spark, tag)
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out.vellum_path = path
    return out


def bucketed(df: DataFrame, key: str, tag: str) -> DataFrame:
    """As ``stored``, as a table in as many buckets of ``key`` as shuffles
    have partitions: joins on the key move only their other side."""
    spark = df.sparkSession
    path = _place(spark, tag)
    name = f"vellum_{tag}_{uuid.uuid4().hex}"
    df.write.bucketBy(int(spark.conf.get("spark.sql.shuffle.partitions")), key).sortBy(key).option("path", path).saveAsTable(name)
    out = spark.table(name)
    out.vellum_path, out.vellum_table = path, name
    return out


def drop(*tables: DataFrame) -> None:
    """Remove stored tables that nothing will read any more."""
    for df in tables:
        spark = df.sparkSession
        if name := getattr(df, "vellum_table", None):
            spark.sql(f"DROP TABLE IF EXISTS {name}")
        if path := getattr(df, "vellum_path", None):
            hadoop = spark._jvm.org.apache.hadoop.fs.Path(path)
            hadoop.getFileSystem(spark._jsc.hadoopConfiguration()).delete(hadoop, True)


def clashes(df: DataFrame, most: int = 10_000) -> list[int]:
    """The 64-bit hashes ``a`` that go with more than one second hash ``b``:
    one for every 3e9 rows or so, so they fit in a list."""
    shared = df.groupBy("a").agg(F.min("b").alias("x"), F.max("b").alias("y")).where(F.col("x") != F.col("y"))
    found = [r.a for r in shared.select("a").limit(most + 1).collect()]
    if len(found) > most:
        raise ValueError(f"more than {most} clashes of 64-bit hashes")
    return found


def documents(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(doc_id, text) of any table; a null text is the empty text."""
    return df.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))


def slices(texts: pa.Array) -> Iterator[tuple[int, int]]:
    """(start, length) runs of rows with about SLICE_BYTES of text."""
    if not len(texts):
        return
    sizes = pc.binary_length(texts).to_pylist()
    start, held = 0, 0
    for i, n in enumerate(sizes):
        if held and held + n > SLICE_BYTES:
            yield start, i - start
            start, held = i, 0
        held += n
    yield start, len(sizes) - start


def unused(df: DataFrame, n: int) -> list[str]:
    """``n`` column names that ``df`` doesn't have in any spelling."""
    taken = {c.lower() for c in df.columns}
    names = (f"vellum_{k}" for k in itertools.count())
    return list(itertools.islice((x for x in names if x not in taken), n))


def map_documents(df: DataFrame, make: Callable[[], Callable[[list[int], list[str]], pa.Table | dict]], schema: str, carry: tuple[str, ...] = ()) -> DataFrame:
    """Apply a function to the documents' (doc_id, text), a few MB at a time.

    ``make`` runs once per task and returns the function from ids and texts to
    columns named as in ``schema``. The columns ``carry``, of a function with
    one result for each text, come out as they are, under their names.
    """
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import _parse_datatype_string

    target = to_arrow_schema(_parse_datatype_string(schema))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        apply = make()
        for batch in batches:
            text = batch.column(1)
            for start, n in slices(text):
                out = apply(batch.column(0).slice(start, n).to_pylist(), text.slice(start, n).to_pylist())
                out |= {c: batch.column(k).slice(start, n) for k, c in enumerate(carry, 2)}
                yield pa.RecordBatch.from_arrays([pa.array(out[f.name], type=f.type) if not isinstance(out[f.name], pa.Array) else out[f.name].cast(f.type) for f in target], schema=target)

    return df.select("doc_id", "text", *carry).mapInArrow(run, schema)


def per_text(make: Callable[[], Callable[[list[str]], list]], kind: str):
    """A column function of a text column, for decisions that stay with their
    rows. ``make`` runs once per task and returns the function from texts (a
    null is the empty text) to values, which gets a few MB at a time."""
    import pandas as pd

    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        apply = make()
        for batch in batches:
            texts = ["" if t is None else t for t in batch]
            out, start, held = [], 0, 0
            for i, t in enumerate(texts):
                held += len(t)
                if held > SLICE_BYTES:
                    out += apply(texts[start : i + 1])
                    start, held = i + 1, 0
            yield pd.Series(out + apply(texts[start:]) if start < len(texts) else out, dtype=object)

    run.__annotations__ = {"batches": Iterator[pd.Series], "return": Iterator[pd.Series]}
    return F.pandas_udf(run, kind)


def held_out(doc_id) -> F.Column:
    """Whether a row is kept from learning: crc32(doc_id as text) mod 5 is 0."""
    return F.coalesce(F.crc32(doc_id.cast("string")) % 5 == 0, F.lit(False))


def components(links: DataFrame, most_rounds: int = 60) -> DataFrame:
    """(node, root): for every node of the links (a, b), one node of its
    connected component, the same for all of them.

    Graph contraction: in each round every node points to the neighbour (or
    itself) of least priority, priorities being hashes that change by round,
    and links are drawn anew between the pointed-at nodes. A round shrinks a
    path by a constant factor whatever the ids are, so the rounds grow with
    the logarithm of the longest path. Rows of a hub meet only in partial
    aggregates and in joins that AQE can split. Each round is a written table.
    """
    spark = links.sparkSession
    kind = links.schema["a"].dataType
    edges = stored(links.where(F.col("a") != F.col("b")).select("a", "b").distinct(), "links")
    spent: list[DataFrame] = []
    maps: list[DataFrame] = []
    for k in range(most_rounds):
        if edges.isEmpty():
            break
        both = edges.union(edges.select("b", "a"))
        rank = lambda c: F.struct(F.xxhash64(c, F.lit(k)).alias("h"), F.col(c).alias("n"))  # noqa: E731, B023
        nearest = both.groupBy(F.col("a").alias("node")).agg(F.min(rank("b")).alias("m"))
        nearest = stored(nearest.select("node", F.when(F.col("m") < rank("node"), F.col("m.n")).otherwise(F.col("node")).alias("root")), "points")
        maps.append(nearest)
        moved = edges.join(nearest.select(F.col("node").alias("a"), F.col("root").alias("ra")), "a").select("b", "ra")
        moved = moved.join(nearest.select(F.col("node").alias("b"), F.col("root").alias("rb")), "b")
        spent.append(edges)
        edges = stored(moved.where(F.col("ra") != F.col("rb")).select(F.least("ra", "rb").alias("a"), F.greatest("ra", "rb").alias("b")).distinct(), "links")
    else:
        raise RuntimeError("the links did not contract")
    drop(*spent)
    if not maps:
        return spark.createDataFrame([], f"node {kind.simpleString()}, root {kind.simpleString()}")
    out = maps[0]
    for step in maps[1:]:
        out = out.join(step.select(F.col("node").alias("root"), F.col("root").alias("next")), "root", "left").select("node", F.coalesce("next", "root").alias("root"))
    out = stored(out, "roots")
    drop(edges, *maps)
    return out
