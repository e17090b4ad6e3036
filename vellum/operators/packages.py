"""Office packages: parts as rows, and rows as files.

A package is the rows (path, part_name, content) of its parts. Everything that
decides what goes into a part is done on DataFrames; at the end the parts of a
path, which are one file and so bounded by it, meet in one task to be zipped.
"""

from __future__ import annotations

import io
import zipfile
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Time stamp in every package, so that equal parts give equal files.
STAMP = (1980, 1, 1, 0, 0, 0)


def xml(text: Column) -> Column:
    """Text ready to stand in XML: characters that it can't hold go."""
    out = F.regexp_replace(text, r"[^\x{9}\x{A}\x{D}\x{20}-\x{D7FF}\x{E000}-\x{FFFD}\x{10000}-\x{10FFFF}]", "")
    for a, b in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;")):
        out = F.replace(out, F.lit(a), F.lit(b))
    return out


def ordered_text(column: str, *order: str) -> Column:
    """Aggregate: a group's texts in order, one string."""
    rows = F.sort_array(F.collect_list(F.struct(*order, column)))
    return F.array_join(F.transform(rows, lambda r: r[column]), "")


def part(df: DataFrame, name: Column | str, content: Column) -> DataFrame:
    name = F.lit(name) if isinstance(name, str) else name
    return df.select("path", name.alias("part_name"), content.cast("binary").alias("content"))


def zipped(parts: DataFrame) -> DataFrame:
    """(path, content): each path's parts as one file, by name but for the
    content types, which come first."""

    def pack(pdf: pd.DataFrame) -> pd.DataFrame:
        out = io.BytesIO()
        rows = sorted(zip(pdf["part_name"], pdf["content"]), key=lambda r: (r[0] != "[Content_Types].xml", r[0]))
        with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as z:
            for name, content in rows:
                info = zipfile.ZipInfo(name, STAMP)
                info.compress_type = zipfile.ZIP_DEFLATED
                z.writestr(info, bytes(content))
        return pd.DataFrame({"path": [pdf["path"].iloc[0]], "content": [out.getvalue()]})

    return parts.groupBy("path").applyInPandas(pack, "path string, content binary")


def unzipped(files: DataFrame) -> DataFrame:
    """(path, part_name, content, _error) of packages (path, content)."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for path, content in zip(pdf["path"], pdf["content"]):
                rows, error = [], None
                try:
                    with zipfile.ZipFile(io.BytesIO(content)) as z:
                        rows = [(path, n, z.read(n), None) for n in z.namelist() if not n.endswith("/")]
                except Exception as e:  # noqa: BLE001
                    error = f"package: {e}"
                yield pd.DataFrame(rows + ([(path, None, None, error)] if error else []), columns=["path", "part_name", "content", "_error"])

    return files.select("path", "content").mapInPandas(run, "path string, part_name string, content binary, _error string")


def texts(parts: DataFrame, element: str) -> DataFrame:
    """(path, part_name, idx, text) of every text element, like ``w:t``."""
    body = F.decode("content", "UTF-8")
    found = F.regexp_extract_all(body, F.lit(rf"<{element}(?:\s[^>]*)?>([^<]*)</{element}>"), F.lit(1))
    rows = parts.select("path", "part_name", F.posexplode(found).alias("idx", "text"))
    for a, b in (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&apos;", "'"), ("&amp;", "&")):
        rows = rows.withColumn("text", F.replace("text", F.lit(a), F.lit(b)))
    return rows


def broken_relations(parts: DataFrame) -> DataFrame:
    """(path, source, target): relations inside a package to a part that it
    lacks."""
    rels = parts.where(F.col("part_name").endswith(".rels"))
    tags = F.regexp_extract_all(F.decode("content", "UTF-8"), F.lit("<Relationship [^>]*>"), F.lit(0))
    rows = rels.select("path", "part_name", F.explode(tags).alias("tag")).where(~F.col("tag").contains('TargetMode="External"'))
    folder = F.regexp_replace("part_name", r"_rels/[^/]*$", "")
    target = F.regexp_extract("tag", 'Target="([^"]*)"', 1)
    whole = F.when(target.startswith("/"), F.substring(target, 2, 10_000)).otherwise(F.concat(folder, target))
    for _ in range(4):
        whole = F.regexp_replace(whole, r"[^/]+/\.\./", "")
    rows = rows.select("path", F.col("part_name").alias("source"), whole.alias("target"))
    have = parts.select("path", F.col("part_name").alias("target")).distinct()
    return rows.join(have, ["path", "target"], "left_anti").select("path", "source", "target")


def missing_parts(parts: DataFrame, required: list[str]) -> DataFrame:
    """(path, part_name) of required parts that a package lacks."""
    want = parts.select("path").distinct().select("path", F.explode(F.array(*[F.lit(r) for r in required])).alias("part_name"))
    return want.join(parts.select("path", "part_name"), ["path", "part_name"], "left_anti")


def save(packages: DataFrame, directory: str, suffix: str) -> DataFrame:
    """Write each (path, content) from its task as a file under ``directory``,
    a URI that all executors reach (on one machine a path will do); returns
    (path, file). A name is the source's without its folder and a hash of its
    whole path, so that a task run again writes the same file."""

    master = packages.sparkSession.sparkContext.master
    if "://" not in directory and (not master.startswith("local") or master.startswith("local-cluster")):
        raise ValueError(f"{directory}: name the file system, like hdfs://... or file://... if all executors mount it")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        import hashlib
        import os

        from pyarrow import fs

        store, root = fs.FileSystem.from_uri(directory if "://" in directory else f"file://{os.path.abspath(directory)}")
        store.create_dir(root, recursive=True)
        for pdf in batches:
            names = []
            for path, content in zip(pdf["path"], pdf["content"]):
                stem = os.path.splitext(os.path.basename(path))[0]
                name = f"{root}/{stem}-{hashlib.sha1(path.encode()).hexdigest()[:8]}{suffix}"
                part = f"{name}.{os.getpid()}.part"
                with store.open_output_stream(part) as f:
                    f.write(content)
                store.move(part, name)
                names.append(name)
            yield pd.DataFrame({"path": pdf["path"], "file": names})

    return packages.mapInPandas(run, "path string, file string")
