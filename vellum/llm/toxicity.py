"""Toxicity by a weighted lexicon.

Texts are folded first: case, accents and look-alike letters of other scripts
go, invisible characters vanish, digits and signs that stand for letters inside
a word become those letters, everything else separates words. An Aho-Corasick
automaton then finds the lexicon's entries (whole words and word beginnings) in
the folded text, less those inside an exception phrase, and the sum of their
weights, normalised by length, goes through a logistic curve. Entries, weights,
exceptions and the curve are learned from labelled rows, by counts that the
tasks make; no text reaches the driver.
"""

from __future__ import annotations

import functools
import math
import re
import unicodedata
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vellum.llm import common

#: Labelled rows that learning takes at most, by the hash of their id.
TRAIN_ROWS = 12_000
#: Letters of a word that is an entry at least, and of a beginning at most.
SHORTEST, LONGEST = 3, 8
#: Word count to which sums are normalised up to this power.
LENGTH_POWER = 0.25

# Letters of other scripts that look like Latin ones, and digits
# and signs that stand for letters.
LOOKALIKES = {
    "а": "a", "в": "b", "с": "c", "ԁ": "d", "е": "e", "ғ": "f", "һ": "h", "і": "i", "ј": "j", "к": "k", "ӏ": "l", "м": "m", "п": "n", "о": "o", "р": "p", "ԛ": "q", "г": "r", "ѕ": "s", "т": "t", "ц": "u", "ѵ": "v", "ԝ": "w", "х": "x", "у": "y",
    "α": "a", "β": "b", "ϲ": "c", "δ": "d", "ε": "e", "η": "n", "ι": "i", "κ": "k", "ν": "v", "ο": "o", "ρ": "p", "σ": "o", "τ": "t", "υ": "u", "χ": "x", "ω": "w", "γ": "y",
    "ı": "i", "ł": "l", "ø": "o", "đ": "d", "ɑ": "a", "ɡ": "g", "ʀ": "r", "ɪ": "i", "æ": "ae", "œ": "oe", "ß": "ss",
}
STAND_INS = {"0": "o", "1": "i", "3": "e", "4": "a", "5": "s", "7": "t", "8": "b", "9": "g", "@": "a", "$": "s", "!": "i", "|": "i", "€": "e", "+": "t"}
# End of fixed values.

_STAND = re.compile(r"(?<=[a-z])[01345789@$!|€+]+(?=[a-z])|(?<![a-z0-9@$!|€+])[0134578@$€](?=[a-z])|(?<=[a-z])[013457@$€]+(?![a-z0-9@$!|€+.])")


class _Letters(dict):
    """What each character folds to, found when first met."""

    def __missing__(self, code: int) -> str:
        c = chr(code).lower()
        if c in LOOKALIKES:
            out = LOOKALIKES[c]
        elif unicodedata.category(c[0]) in ("Cf", "Mn"):
            out = ""
        else:
            flat = "".join(LOOKALIKES.get(x, x) for x in unicodedata.normalize("NFKD", c) if unicodedata.category(x) != "Mn").lower()
            out = flat if flat.isascii() or flat.isalpha() else " "
        self[code] = out
        return out


_LETTERS = _Letters()
_BLANKS = {i: " " for i in range(128) if not chr(i).isalnum()} | {i: " " for i in range(48, 58)}


def fold(text: str) -> str:
    """Words of plain letters, one space between, before and after."""
    flat = text.lower() if text.isascii() else text.translate(_LETTERS)
    flat = _STAND.sub(lambda m: "".join(STAND_INS.get(c, c) for c in m[0]), flat)
    return " " + " ".join(flat.translate(_BLANKS).split()) + " "


class Lexicon:
    """Entries with weights (" word " or " beginning"), exception phrases and
    the curve from a normalised sum to a score."""

    def __init__(self, weights: dict[str, float], exceptions: set[str], slope: float, offset: float):
        self.weights, self.exceptions, self.slope, self.offset = weights, exceptions, slope, offset

    @functools.cached_property
    def automaton(self):
        import ahocorasick

        found = ahocorasick.Automaton()
        for entry, weight in self.weights.items():
            found.add_word(entry, (len(entry), weight))
        for phrase in self.exceptions:
            if phrase not in self.weights:
                found.add_word(phrase, (len(phrase), None))
        if len(found):
            found.make_automaton()
        return found

    def __getstate__(self):
        return {k: v for k, v in self.__dict__.items() if k != "automaton"}

    def total(self, folded: str) -> tuple[float, int]:
        """Sum of weights, one for each word, and entries found."""
        if not len(self.automaton):
            return 0.0, 0
        best: dict[int, float] = {}
        spared: list[tuple[int, int]] = []
        for stop, (size, weight) in self.automaton.iter(folded):
            start = stop - size + 1
            if weight is None:
                spared.append((start, stop))
            elif weight > best.get(start, 0.0):
                best[start] = weight
        kept = list(best.values())
        if spared:
            spared.sort()
            kept, i, reach = [], 0, -1
            for at in sorted(best):
                while i < len(spared) and spared[i][0] <= at:
                    reach = max(reach, spared[i][1])
                    i += 1
                if at >= reach:
                    kept.append(best[at])
        return math.fsum(kept), len(kept)

    def found(self, folded: str) -> tuple[float, int]:
        """The sum normalised by length, and entries found."""
        total, n = self.total(folded)
        return total / max(1, folded.count(" ") - 1) ** LENGTH_POWER, n

    def score(self, normalised: float) -> float:
        return 1.0 / (1.0 + math.exp(-max(-700.0, min(700.0, self.slope * normalised + self.offset))))


def _counted(rows: DataFrame, make, schema: str) -> DataFrame:
    """What ``make`` yields of each (row, y, folded)."""
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import _parse_datatype_string

    target = to_arrow_schema(_parse_datatype_string(schema))

    def run(batches):
        for batch in batches:
            for row, y, folded in zip(*(c.to_pylist() for c in batch.columns)):
                found = list(make(row, y, folded))
                if found:
                    yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*found), target)], schema=target)

    return rows.select("row", "y", "folded").mapInArrow(run, schema)


def learn(rows: DataFrame) -> Lexicon:
    """A lexicon from (row, y, folded) with numbered rows.

    An entry is a word or a beginning of words whose share of toxic uses is
    beyond chance for the number of entries tried. A toxic document counts
    once, and so does a pair of words around the entry, so that copies of one
    document don't pass for evidence. Of a beginning and its longer forms the shortest that
    is as pure stays. An exception is an entry with the word before or after
    it that is seen in clean documents alone.

    What reaches the driver are the entries that at least three toxic rows
    hold, the exceptions, and two numbers for each row.
    """
    rows = rows.where(F.col("y").isin(0, 1))
    sizes = {r["y"]: r["count"] for r in rows.groupBy("y").count().collect()}
    if len(sizes) < 2:
        return Lexicon({}, set(), 0.0, 0.0 if not sizes else (30.0 if 1 in sizes else -30.0))

    def uses(row, y, folded):
        words = folded.split()
        found = {(e, zlib.crc32(f"{before} {after}".encode())) for before, word, after in zip(["", *words], words, [*words[1:], ""]) for e in entries_of(word)}
        return [(e, row, around) for e, around in found]

    met = _counted(rows.where("y = 1"), uses, "entry string, row long, around long")
    # documents and surroundings are each counted once, in two steps that add up what tasks have counted
    counts = [met.select("entry", F.col(c).alias("x")).distinct().groupBy("entry").agg(F.count(F.lit(1)).alias(c)) for c in ("row", "around")]
    seen = common.stored(counts[0].join(counts[1], "entry").select("entry", F.least("row", "around").alias("k")), "toxentries")
    tried = seen.count()
    toxic = {r.entry: r.k for r in seen.where("k > 2").collect()}

    def known(row, y, folded):
        return [(e,) for e in {e for word in set(folded.split()) for e in entries_of(word) if e in toxic}]

    clean: Counter = Counter({r["entry"]: r["count"] for r in _counted(rows.where("y = 0"), known, "entry string").groupBy("entry").count().collect()})
    total = sizes[0] + sizes[1]
    base = sizes[1] / total
    bar = math.log(tried + 1) + 2.0
    sure: dict[str, tuple[float, float]] = {}
    for e, k in toxic.items():
        n = k + clean[e]
        share = k / n
        if share > max(0.6, base):
            gain = k * math.log(share / base) + ((n - k) * math.log((1 - share) / (1 - base)) if n > k else 0.0)
            if gain > bar:
                sure[e] = (share, math.log((k + 0.5) / (sizes[1] + 1)) - math.log((clean[e] + 0.5) / (sizes[0] + 1)))
    weights: dict[str, float] = {}
    for e in sorted(sure, key=lambda e: (len(e), e)):
        if not any(e[:i] in weights and sure[e[:i]][0] >= sure[e][0] - 0.02 for i in range(2, len(e))):
            weights[e] = max(0.5, sure[e][1])
    tool = Lexicon(weights, set(), 0.0, 0.0)
    near = _counted(rows, lambda row, y, folded: [(p, y) for p in phrases_of(folded, tool)], "phrase string, y int").groupBy("phrase").agg(F.sum("y").alias("toxic"), F.count(F.lit(1)).alias("n"))
    exceptions = {r.phrase for r in near.where("toxic = 0 AND n >= 5").collect()} if weights else set()
    lexicon = Lexicon(weights, exceptions, 0.0, 0.0)
    found = sorted((r.x, r.y) for r in _counted(rows, lambda row, y, folded: [(lexicon.found(folded)[0], y)], "x double, y int").collect())
    common.drop(seen)
    lexicon.slope, lexicon.offset = curve(np.array([x for x, _ in found]), np.array([float(y) for _, y in found]))
    return lexicon


def entries_of(word: str) -> list[str]:
    """The entries that would match a word: itself and its beginnings."""
    if len(word) < SHORTEST:
        return []
    return [f" {word} ", *(f" {word[:n]}" for n in range(SHORTEST + 1, min(LONGEST, len(word) + 1)))]


def phrases_of(folded: str, tool: Lexicon) -> set[str]:
    """The lexicon's finds with the word before and the word behind."""
    phrases = set()
    for stop, (size, _) in tool.automaton.iter(folded) if len(tool.automaton) else ():
        start = stop - size + 1
        end = folded.index(" ", start + 1)
        before = folded.rfind(" ", 0, start)
        after = folded.find(" ", end + 1)
        if before >= 0:
            phrases.add(folded[before : end + 1])
        if after >= 0:
            phrases.add(folded[start : after + 1])
    return phrases


def curve(x: np.ndarray, y: np.ndarray) -> tuple[float, float]:
    """Slope and offset of a logistic curve, by Newton steps on a likelihood
    with a slight pull of the slope to zero; an x of zero means no entry."""
    w = np.zeros(2)
    z = np.column_stack([x, np.ones_like(x)])
    pull = np.diag([1e-3, 1e-6])
    for _ in range(60):
        p = 1 / (1 + np.exp(-np.clip(z @ w, -30, 30)))
        step = np.linalg.solve((z * (p * (1 - p))[:, None]).T @ z + pull + 1e-9 * np.eye(2), z.T @ (y - p) - pull @ w)
        w = w + step * min(1.0, 5.0 / max(1e-9, float(np.abs(step).max())))
        if np.abs(step).max() < 1e-6:
            break
    return float(w[0]), float(w[1])


def training_rows(df: DataFrame, labels: DataFrame, *, id_col: str, text_col: str, label_col: str, most: int) -> DataFrame:
    """(row, y, folded) of at most ``most`` labelled rows that aren't held
    out, by the hash of id and text; repeated rows are one. Their ids and
    hashes, no more than ``most``, are sent to the scan of the texts."""
    known = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col(label_col).cast("int").alias("y")).where(F.col("y").isin(0, 1) & F.col("doc_id").isNotNull() & ~common.held_out(F.col("doc_id")))
    docs = common.documents(df, id_col, text_col).withColumn("a", F.xxhash64("text"))
    both = docs.select("doc_id", "a").join(known, "doc_id").distinct()
    chosen = common.stored(both.orderBy(F.xxhash64("doc_id", "a"), "doc_id", "a", "y").limit(most), "toxchosen")
    rows = docs.join(F.broadcast(chosen.select("doc_id", "a").distinct()), ["doc_id", "a"], "left_semi")

    def make():
        return lambda ids, texts: {"doc_id": ids, "folded": [fold(t) for t in texts]}

    folded = common.map_documents(rows, make, "doc_id long, folded string, a long", carry=("a",))
    folded = folded.groupBy("doc_id", "a").agg(F.any_value("folded").alias("folded")).join(F.broadcast(chosen), ["doc_id", "a"])
    return common.stored(folded.select(F.xxhash64("doc_id", "a").alias("row"), "y", "folded"), "toxrows")


def toxicity_scores(df: DataFrame, labels: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", threshold: float = 0.5, train_rows: int = TRAIN_ROWS) -> DataFrame:
    """(doc_id, held_out, score, predicted, n_entries) for every row of ``df``.

    Learning takes at most ``train_rows`` labelled rows, their whole texts;
    scoring reads every text whole, in one pass without a shuffle. Scores are between 0 and 1, higher where class 1 is likelier;
    predicted is 1 from ``threshold`` on; n_entries counts what was found.

    A null or empty text has no entries and the score of such. Labels other
    than 0 and 1, null ids and labels of unknown documents don't count. Where
    only one class has labelled rows every score is near that class, 0.5 where
    none has. Repeated rows each have a row, a null doc_id stays null and
    isn't held out, other columns are not looked at, an empty table gives an
    empty table.
    """
    chosen = training_rows(df, labels, id_col=id_col, text_col=text_col, label_col=label_col, most=train_rows)
    lexicon = learn(chosen)
    common.drop(chosen)

    def make():
        def apply(ids, texts):
            out = {"doc_id": ids, "score": [], "n_entries": []}
            for text in texts:
                x, n = lexicon.found(fold(text))
                out["score"].append(lexicon.score(x))
                out["n_entries"].append(n)
            return out

        return apply

    scored = common.map_documents(common.documents(df, id_col, text_col), make, "doc_id long, score double, n_entries long")
    return scored.select("doc_id", common.held_out(F.col("doc_id")).alias("held_out"), "score", F.when(F.col("score") >= threshold, 1).otherwise(0).alias("predicted"), "n_entries")
