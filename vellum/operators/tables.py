"""Intermediate tables in the folder that driver and executors share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """spark.checkpoint.dir. Where that is unset a temporary folder takes its
    place on one machine; on a cluster there is none to guess."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        master = spark.sparkContext.master
        if not master.startswith("local") or master.startswith("local-cluster"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that driver and executors share")
        root = tempfile.mkdtemp(prefix="vellum-")
        spark.conf.set("spark.checkpoint.dir", root)
    return root.rstrip("/")


def stored(df: DataFrame, tag: str, by: list[str] | None = None) -> DataFrame:
    """``df`` written as Parquet to the shared folder and read again: what
    follows plans from a file, and a lost executor loses nothing. ``by`` names
    columns of few values that the files are dealt by. Removed by ``drop`` or
    when the driver ends."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/vellum-{tag}-{uuid.uuid4().hex}"
    writer = df.write.partitionBy(*by) if by else df.write
    writer.parquet(path)
    hadoop = spark._jvm.org.apache.hadoop.fs.Path(path)
    hadoop.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(hadoop)
    out = spark.read.schema(df.schema).parquet(path)
    out.vellum_path = path
    return out


def drop(*tables: DataFrame) -> None:
    """Remove stored tables that nothing will read any more; others stay."""
    for df in tables:
        if path := getattr(df, "vellum_path", None):
            spark = df.sparkSession
            hadoop = spark._jvm.org.apache.hadoop.fs.Path(path)
            hadoop.getFileSystem(spark._jsc.hadoopConfiguration()).delete(hadoop, True)
