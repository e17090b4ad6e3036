"""Quality scores by a regularised quadratic discriminant.

A document becomes a short vector of transformed statistics. Each class has a
mean and a covariance shrunk towards the pooled one and towards a multiple of
the identity; a score is the posterior of class 1 from the difference of the
two log-densities, their Mahalanobis terms solved with Cholesky factors that
are computed once. Learning needs counts, sums and products of the labelled
rows' statistics only, which one aggregation gathers from all of them.
"""

from __future__ import annotations

import math
from collections import Counter
from operator import eq

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vellum.llm import common

FEATURES = ("upper_words", "symbols", "bars", "repeats", "top_word", "marked_words", "word_length", "line_repeats")
#: Shrinkage of a class covariance to the pooled one, and of that to a
#: multiple of the identity.
POOL, RIDGE = 0.1, 0.02
#: Rows of each class that its prior's count is raised by.
PRIOR = 1.0

_KIND = np.zeros(256, np.uint8)
for _b in b" \t\n\r\x0b\x0c":
    _KIND[_b] = 1
for _b in range(33, 127):
    _KIND[_b] = 2
for _b in b"abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ":
    _KIND[_b] = 3
for _b in b"0123456789":
    _KIND[_b] = 4
for _b in b".,;:?'\"()+-=@_/":
    _KIND[_b] = 5  # of ordinary prose, numbers and addresses
_KIND[ord("|")] = 6


def _angle(k: float, n: float) -> float:
    """A share as an angle, which steadies its variance."""
    return math.asin(math.sqrt(min(1.0, k / n))) if n > 0 else 0.0


def statistics(text: str) -> list[float]:
    """The transformed statistics of one text; of a blank text all zeros."""
    words = text.split()
    n = len(words)
    if not n:
        return [0.0] * len(FEATURES)
    raw = np.frombuffer(text.encode(), np.uint8)
    kinds = np.bincount(_KIND[raw], minlength=7)
    solid = len(raw) - int(kinds[1])
    upper = sum(map(str.isupper, words))
    ends = sum(not w[-1].isalnum() and w[-1] not in ".,;:!?)=-\"'" or w.endswith("!!") for w in words)
    repeats = sum(map(eq, words, words[1:]))
    top = Counter(words).most_common(1)[0][1]
    lines = [x for x in text.split("\n") if x]
    return [
        _angle(upper, n + 4),
        _angle(int(kinds[2]), solid + 60),
        _angle(int(kinds[6]), solid + 20),
        _angle(repeats, n + 12),
        _angle(max(0.0, top - 5 - 0.1 * n), n + 20),
        _angle(ends, n + 4),
        math.log((sum(map(len, words)) + 300) / (n + 60)),
        _angle(len(lines) - len(set(lines)), len(lines) + 4),
    ]


def document_statistics(df: DataFrame, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, stats array<double>) for every row of ``df``."""

    def make():
        return lambda ids, texts: {"doc_id": ids, "stats": [statistics(t) for t in texts]}

    return common.map_documents(common.documents(df, id_col, text_col), make, "doc_id long, stats array<double>")


class Discriminant:
    """Two shrunk Gaussians and the posterior of class 1."""

    def __init__(self, counts, sums, products, pool: float = POOL, ridge: float = RIDGE):
        """By class 0 and 1: rows, sums, and sums of outer products."""
        d = len(FEATURES)
        self.known = min(counts) > 0
        self.only = 0.5 if sum(counts) == 0 else float(counts[1] > 0)
        if not self.known:
            return
        means = [s / n for s, n in zip(sums, counts)]
        scatter = [p - n * np.outer(m, m) for p, n, m in zip(products, counts, means)]
        pooled = (scatter[0] + scatter[1]) / max(1.0, counts[0] + counts[1] - 2)
        self.scale = np.sqrt(np.maximum(np.diag(pooled), 1e-6))
        norm = np.outer(self.scale, self.scale)
        pooled = pooled / norm
        self.means, self.factors, self.consts = [], [], []
        for k in (0, 1):
            # the pooled covariance counts as so many rows more, so that a class of few rows leans on it
            own = scatter[k] / norm
            weight = pool * (counts[k] + 10 * d)
            cov = (own + weight * pooled) / (counts[k] + weight)
            cov = (1 - ridge) * cov + ridge * np.trace(cov) / d * np.eye(d)
            factor = np.linalg.cholesky(cov)
            self.means.append(means[k] / self.scale)
            self.factors.append(factor)
            self.consts.append(math.log((counts[k] + PRIOR) / (sum(counts) + 2 * PRIOR)) - float(np.log(np.diag(factor)).sum()))

    def score(self, stats: np.ndarray) -> np.ndarray:
        if not self.known:
            return np.full(len(stats), self.only)
        x = stats / self.scale
        logs = []
        for mean, factor, const in zip(self.means, self.factors, self.consts):
            solved = np.linalg.solve(factor, (x - mean).T)
            logs.append(const - 0.5 * (solved**2).sum(axis=0))
        return 1.0 / (1.0 + np.exp(np.clip(logs[0] - logs[1], -700, 700)))


def learn(stats: DataFrame, labels: DataFrame, *, label_col: str = "quality", **shrinkage: float) -> Discriminant:
    """The discriminant of the labelled rows that aren't held out.

    All of them count; what reaches the driver is two rows of sums.
    """
    d = len(FEATURES)
    labelled = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col(label_col).cast("int").alias("y")).where(F.col("y").isin(0, 1) & F.col("doc_id").isNotNull() & ~common.held_out(F.col("doc_id")))
    x = [F.col("stats")[i] for i in range(d)]
    sums = [F.sum(x[i]).alias(f"s{i}") for i in range(d)] + [F.sum(x[i] * x[j]).alias(f"p{i}_{j}") for i in range(d) for j in range(i + 1)]
    found = {r["y"]: r for r in stats.join(labelled, "doc_id").groupBy("y").agg(F.count(F.lit(1)).alias("n"), *sums).collect()}
    counts, firsts, products = [], [], []
    for k in (0, 1):
        r = found.get(k)
        counts.append(float(r["n"]) if r else 0.0)
        firsts.append(np.array([r[f"s{i}"] if r else 0.0 for i in range(d)]))
        products.append(np.array([[r[f"p{max(i, j)}_{min(i, j)}"] if r else 0.0 for j in range(d)] for i in range(d)]))
    return Discriminant(counts, firsts, products, **shrinkage)


def quality_scores(df: DataFrame, labels: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", threshold: float = 0.3) -> DataFrame:
    """(doc_id, held_out, score, predicted) for every row of ``df``.

    One pass computes the statistics, written to the shared folder; learning
    and scoring read them. Scores are between 0 and 1, higher where class 1 is
    likelier; predicted is 1 from ``threshold`` on.

    A null, empty or blank text has statistics of zero and is scored like any
    other, a text of any length is read whole, an empty table gives an empty
    table. Labels other than 0 and 1, null ids and labels of unknown documents
    don't count; a document labelled twice counts twice. Where a class has no
    labelled row every score is the other class's number, 0.5 where neither
    has. Repeated rows each have a row, a null doc_id stays null and isn't
    held out, other columns are not looked at.
    """
    stats = common.stored(document_statistics(df, id_col=id_col, text_col=text_col), "quality")
    model = learn(stats, labels, label_col=label_col)

    def score(batches):
        for pdf in batches:
            s = model.score(np.array(pdf["stats"].tolist()).reshape(len(pdf), len(FEATURES)))
            yield pd.DataFrame({"doc_id": pdf["doc_id"], "held_out": pdf["held_out"], "score": s, "predicted": (s >= threshold).astype("int32")})

    marked = stats.withColumn("held_out", common.held_out(F.col("doc_id")))
    return marked.mapInPandas(score, "doc_id long, held_out boolean, score double, predicted int")


def keep_good(df: DataFrame, labels: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", threshold: float = 0.3) -> DataFrame:
    """The rows of ``df``, all their columns, that ``quality_scores`` would
    predict as 1. The statistics are computed once and written beside the
    rows, so nothing is joined to the texts; repeated rows, null ids and
    columns of any name stay as they are.

    A null, empty or blank text has statistics of zero and stays or goes as
    its score says; a text of any length is read whole; an empty table gives
    an empty table.
    """
    (at,) = common.unused(df, 1)

    def make():
        return lambda texts: [statistics(t) for t in texts]

    rows = common.stored(df.withColumn(at, common.per_text(make, "array<double>")(F.col(text_col).cast("string"))), "quality")
    model = learn(rows.select(F.col(id_col).cast("long").alias("doc_id"), F.col(at).alias("stats")), labels, label_col=label_col)

    @F.pandas_udf("boolean")
    def good(stats: pd.Series) -> pd.Series:
        return pd.Series(model.score(np.array(stats.tolist()).reshape(len(stats), len(FEATURES))) >= threshold)

    return rows.where(good(F.col(at))).drop(at)
