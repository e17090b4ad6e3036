"""Repeated passages by sparse suffix arrays.

Of every text only the suffixes that begin at content-selected places are
kept: where the hash of a few words is the least in some window. A passage of
``least`` words holds such a place near its beginning wherever it stands, with
enough words behind it that lie within the passage.

Suffixes are sorted over all texts by a rank of those words, the hash of them,
and neighbours of one rank stay. Of these few the words on both sides are
fetched, and suffixes of one rank are sorted by the words that follow: matches
with neighbours are extended to the right, and in the order of the words before
them to the left, as far as a stretch of ``least`` words can reach. What both
reaches allow is decided by comparing the words themselves.

The suffixes of a rank that very many share are sorted over tasks. There too
neighbours are extended to both sides by their words; only what the reaches
allow beyond the stretches shared with the neighbour before meets by 128-bit
hashes of its words, a few stretches for each suffix.

Copies of whole texts are one text until the end, told apart by 128 bits.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from itertools import accumulate

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from vellum.llm import common

LEAST = 50
GRAM = 5
#: Suffixes of one rank that are compared in one piece of work.
CHUNK = 2048
#: Ranks of more up to which their list is sent to all tasks.
SENT = 100_000
#: Suffixes of crowded ranks that a task sorts, more or less.
ROWS = 1 << 16
#: Distinct words whose hashes a worker keeps.
REMEMBERED = 300_000
_BASE = np.uint64(0x9E3779B97F4A7C15 | 1)
_BACK = np.uint64(pow(int(_BASE), -1, 1 << 64))


class Hashes:
    """Hashes of runs of words, from sums over a text's beginning."""

    known: dict[bytes, int] = {}

    def __init__(self, text: str):
        import xxhash

        words = text.encode().split()
        known = Hashes.known
        if len(known) > REMEMBERED:
            known.clear()
        values = np.empty(len(words), np.uint64)
        for i, w in enumerate(words):
            h = known.get(w)
            if h is None:
                h = known[w] = xxhash.xxh64_intdigest(w, 17)
            values[i] = h
        self.n = len(words)
        powers = _powers(_BASE, self.n)
        self.back = _powers(_BACK, self.n)
        self.sums = np.zeros(self.n + 1, np.uint64)
        np.cumsum(values * powers, out=self.sums[1:])

    def of(self, start: np.ndarray, size: int) -> np.ndarray:
        """Hash of the ``size`` words from each start."""
        h = (self.sums[start + size] - self.sums[start]) * self.back[start]
        h ^= h >> np.uint64(32)
        h *= np.uint64(0xD6E8FEB86659FD93)
        return h ^ h >> np.uint64(29)


_CACHE: dict[int, np.ndarray] = {}


def _powers(base: np.uint64, n: int) -> np.ndarray:
    have = _CACHE.get(int(base))
    if have is None or len(have) < n:
        have = np.full(max(4096, 2 * n), base, np.uint64)
        have[0] = 1
        have = np.multiply.accumulate(have)
        _CACHE[int(base)] = have
    return have[:n]


def width_of(least: int) -> int:
    """Places of a window of which the least hash is kept."""
    return max(1, (least - GRAM + 1) * 4 // 5)


def anchors(h: Hashes, least: int) -> np.ndarray:
    """For each stretch of ``least`` words, by its start, the kept place that
    the stretch itself selects: the first of the least hashes at its first
    ``width_of(least)`` places. Never falls from one start to the next."""
    if h.n < least:
        return np.zeros(0, np.int64)
    grams = h.of(np.arange(h.n - GRAM + 1), GRAM)
    width, have = width_of(least), 1
    best = np.arange(len(grams))

    def lower(a, b):
        return np.where(grams[b] < grams[a], b, a)

    while have * 2 <= width:
        best = lower(best[:-have], best[have:])
        have *= 2
    if width > have:
        best = lower(best[: len(best) - (width - have)], best[width - have :])
    return best[: h.n - least + 1]


def numbered(docs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """``docs`` (doc_id, text) with ``num``, a number for each text, and the
    stored (num, doc_id) of all rows.

    The number is one 64-bit hash, or, for the few texts where two share that,
    another one.
    """
    two = docs.select("doc_id", F.xxhash64("text").alias("a"), F.xxhash64(F.lit(7), F.col("text")).alias("b"))
    owners = common.stored(two, "owners")
    clash = common.clashes(owners)
    pick = (lambda a, b: F.when(a.isin(clash), b).otherwise(a)) if clash else (lambda a, b: a)
    texts = docs.withColumn("num", pick(F.xxhash64("text"), F.xxhash64(F.lit(7), F.col("text"))))
    return texts, owners.select(pick(F.col("a"), F.col("b")).alias("num"), "doc_id").distinct()


def suffixes(df: DataFrame, least: int) -> DataFrame:
    """(key, num, place): the kept suffixes with the rank of their first
    words, and for each text a row without key whose place is its words."""
    size = least - width_of(least) + 1

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start, n in common.slices(batch.column(1)):
                keys, owners, places, hashes, sizes = [], [], [], [], []
                for own, text in zip(batch.column(0).slice(start, n).to_pylist(), batch.column(1).slice(start, n).to_pylist()):
                    h = Hashes(text)
                    at = anchors(h, least)
                    at = at[np.append(True, at[1:] != at[:-1])] if len(at) else at
                    keys.append(h.of(at, size).view(np.int64))
                    owners.append(np.full(len(at), own, np.int64))
                    places.append(at.astype(np.int32))
                    hashes.append(own)
                    sizes.append(h.n)
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(x)) for x in (keys, owners, places)], names=["key", "num", "place"])
                yield pa.RecordBatch.from_arrays([pa.nulls(n, pa.int64()), pa.array(hashes, pa.int64()), pa.array(sizes, pa.int32())], names=["key", "num", "place"])

    return df.select("num", "text").mapInArrow(run, "key long, num long, place int")


def neighbours(sorted_rows: DataFrame) -> DataFrame:
    """(key, num, place) of suffixes with a neighbour of the same rank from
    another place, and those at the ends of a task, whose neighbours are in
    another one."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last = None  # the row before, and whether it went out
        out = False

        def rows(x):
            return pa.RecordBatch.from_arrays([pa.array(x[:, 0]), pa.array(x[:, 1]), pa.array(x[:, 2].astype(np.int32))], names=["key", "num", "place"])

        for batch in batches:
            if not batch.num_rows:
                continue
            x = np.column_stack([c.to_numpy(zero_copy_only=False).astype(np.int64) for c in batch.columns])
            first = last is None
            if not first:
                x = np.concatenate([last[None, :], x])
            x = x[np.append(True, (x[1:] != x[:-1]).any(axis=1))]
            same = x[1:, 0] == x[:-1, 0]
            go = np.append(False, same) | np.append(same, False)
            go[0] |= first
            last, kept = x[-1], bool(go[-1])
            if not first and out:
                go[0] = False
                kept = kept if len(x) > 1 else True
            yield rows(x[go])
            out = kept
        if last is not None and not out:
            yield rows(last[None, :])

    return sorted_rows.mapInArrow(run, "key long, num long, place int")


CONTEXT = pa.schema([("key", pa.int64()), ("crowd", pa.bool_()), ("num", pa.int64()), ("place", pa.int32()), ("after", pa.binary()), ("before", pa.binary()), ("low", pa.int32()), ("high", pa.int32())])


def contexts(df: DataFrame, least: int) -> DataFrame:
    """The words around each suffix of (num, text, places, hot).

    A row holds the ``least`` words from the suffix's place on (after), those
    before it from the nearest on, as far as a stretch that selects the place
    can begin (before), each word with a space behind it, and the least and
    greatest number of words before it with which such a stretch begins (low,
    high). crowd tells the places of
    ``hot``, those whose rank is met by very many."""
    size = least - width_of(least) + 1

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start, n in common.slices(batch.column(1)):
                rows = []
                part = batch.slice(start, n)
                for own, text, places, hot in zip(*(c.to_pylist() for c in part.columns)):
                    h = Hashes(text)
                    words = text.encode().split()
                    at = anchors(h, least)
                    places, hot = np.unique(places), set(hot or ())
                    lows, highs = np.searchsorted(at, places), np.searchsorted(at, places, side="right") - 1
                    keys = h.of(places, size).view(np.int64).tolist()
                    for p, key, a, b in zip(places.tolist(), keys, lows.tolist(), highs.tolist()):
                        rows.append((key, p in hot, own, p, b"".join(w + b" " for w in words[p : p + least]), b"".join(w + b" " for w in words[a:p][::-1]), p - b, p - a))
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows) if rows else [[]] * len(CONTEXT), CONTEXT)], schema=CONTEXT)

    return df.select("num", "text", "places", "hot").mapInArrow(run, "key long, crowd boolean, num long, place int, after binary, before binary, low int, high int")


def _common(a: list[bytes], b: list[bytes]) -> int:
    """Words that two lists begin with alike."""
    n = 0
    for x, y in zip(a, b):
        if x != y:
            break
        n += 1
    return n


def _reach(lists: list[list[bytes]], order: list[int]) -> list[int]:
    """For each list the most words that another one begins with alike, which
    is with a neighbour in the sorted order."""
    out = [0] * len(lists)
    for i, j in zip(order, order[1:]):
        n = _common(lists[i], lists[j])
        out[i], out[j] = max(out[i], n), max(out[j], n)
    return out


def _prefixes(words: list[bytes]) -> list[int]:
    """Bytes of the first 0, 1, 2, ... words, each with a space behind it."""
    return [0, *accumulate((len(w) + 1 for w in words))]


def matches(rows: list[tuple], least: int) -> Iterator[tuple[int, int, int, int]]:
    """(num, kind, begin, end) of the repeated stretches (kind 0), and those
    that aren't the first of their words in this order (kind 1), around the
    suffixes of one rank: (after, before, low, high, num, place), sorted."""
    kinds: list[tuple] = []  # after, before, low, high, members
    for after, before, low, high, *member in rows:
        if not kinds or (after, before) != kinds[-1][:2]:
            kinds.append((after, before, low, high, []))
        if not kinds[-1][4] or kinds[-1][4][-1] != member:  # repeated rows are one
            kinds[-1][4].append(member)
    many = len(kinds)
    if many == 1 and len(kinds[0][4]) == 1:
        return
    groups: dict[tuple, list[int]] = {}
    shared: list[dict[int, list[int]]] = [{} for _ in kinds]
    if many > 1:
        ahead = [k[0].split() for k in kinds]
        behind = [k[1].split() for k in kinds]
        right = _reach(ahead, sorted(range(many), key=ahead.__getitem__))
        left = _reach(behind, sorted(range(many), key=behind.__getitem__))
        for i, (after, before, low, high, _) in enumerate(kinds):
            low, high = max(low, least - right[i]), min(high, left[i])
            if low > high:
                continue
            a, b = _prefixes(ahead[i]), _prefixes(behind[i])
            for n in range(low, high + 1):
                # the words themselves are compared; a stretch with one of another place is one of equal sides
                own = groups.setdefault((n, before[: b[n]], after[: a[least - n]]), [])
                own.append(i)
                shared[i][n] = own
    for i, (_, _, low, high, members) in enumerate(kinds):
        alone = [i]
        for num, place in members:
            runs: list[list[int]] = [[], []]
            for n in range(low, high + 1):
                own = shared[i].get(n, alone)
                if len(own) > 1 or len(members) > 1:
                    runs[0].append(n)
                    if own[0] != i or members[0] != [num, place]:
                        runs[1].append(n)
            for kind, found in enumerate(runs):
                at = 0
                while at < len(found):
                    to = at
                    while to + 1 < len(found) and found[to + 1] == found[to] + 1:
                        to += 1
                    yield num, kind, place - found[to], place - found[at] + least
                    at = to + 1


def extended(rows: DataFrame, least: int) -> DataFrame:
    """(num, kind, begin, end) of the repeated stretches around suffixes, of
    the rows of ``contexts`` that have a rank."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, held = None, []
        out: list[tuple] = []

        def table():
            cols = list(zip(*out)) if out else [[]] * 4
            out.clear()
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, (pa.int64(), pa.int32(), pa.int32(), pa.int32()))], names=["num", "kind", "begin", "end"])

        for batch in batches:
            for k, *row in zip(*(c.to_pylist() for c in batch.columns)):
                if k != key:
                    if len(held) > 1:
                        out.extend(matches(held, least))
                    key, held = k, []
                held.append(row)
            yield table()
        if len(held) > 1:
            out.extend(matches(held, least))
        yield table()

    order = ["key", "after", "before", "num", "place"]
    own = rows.select("key", "after", "before", "low", "high", "num", "place")
    return own.repartition("key").sortWithinPartitions(*order).mapInArrow(run, "num long, kind int, begin int, end int")


def _sorted(rows: DataFrame, parts: int, order: list[str], schema: str, each) -> DataFrame:
    """``each`` of every row with the row before it and the one behind it in
    the order, None where these are in another of ``parts`` tasks or of another
    rank. The first of its values is the row's number in the order."""
    from pyspark import TaskContext
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import _parse_datatype_string

    target = to_arrow_schema(_parse_datatype_string(schema))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = TaskContext.get().partitionId() << 33
        past = now = None
        out: list[tuple] = []

        def table():
            cols = list(zip(*out)) if out else [[]] * len(target)
            out.clear()
            return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(cols, target)], schema=target)

        def put(row):
            nonlocal number, past, now
            if now is not None:
                same = lambda x: x if x is not None and x["key"] == now["key"] else None
                out.append((number, *each(same(past), now, same(row), past is None, row is None)))
                number += 1
            past, now = now, row

        for batch in batches:
            for row in batch.to_pylist():
                if now is None or (row["num"], row["place"]) != (now["num"], now["place"]):
                    put(row)
            yield table()
        put(None)
        yield table()

    return rows.repartitionByRange(parts, *order).sortWithinPartitions(*order).mapInArrow(run, schema)


def crowds(rows: DataFrame, least: int, total: int) -> DataFrame:
    """(num, kind, begin, end) as ``extended``, of the ``total`` suffixes whose
    rank very many share."""
    # the places where a sort is cut are found from samples of whole keys, so no more cuts than the rows need
    parts = max(1, math.ceil(total / ROWS))

    def shared(a, b, col):
        return 0 if a is None or b is None else _common(a[col].split(), b[col].split())

    def reach(past, now, then, first, last, col):
        # what stands beyond a task's ends isn't known
        return least if first or last else max(shared(past, now, col), shared(now, then, col))

    def left(past, now, then, first, last):
        return *(now[c] for c in names), reach(past, now, then, first, last, "before")

    def right(past, now, then, first, last):
        ends = [(least - shared(x, now, "after"), shared(x, now, "before")) if x else (1, 0) for x in (past, then)]
        ends = [(max(now["low"], a), min(now["high"], b)) for a, b in ends]
        return *(now[c] for c in names[1:]), now["l"], reach(past, now, then, first, last, "after"), *ends[0], *ends[1]

    names = ("key", "num", "place", "after", "before", "low", "high")
    kinds = "num long, place int, after binary, before binary, low int, high int, l int"
    behind = _sorted(rows.select(*names), parts, ["key", "before", "num", "place"], f"rank long, key long, {kinds}", left)
    # a suffix none of whose stretches is shared as far to the left is nobody's match
    behind = behind.drop("rank").where("low <= l")
    met = common.stored(_sorted(behind, parts, ["key", "after", "before", "num", "place"], f"rank long, {kinds}, r int, plow int, phigh int, nlow int, nhigh int", right), "reaches")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import xxhash

        for batch in batches:
            out = []
            for x in batch.to_pylist():
                a, b = x["after"].split(), x["before"].split()
                for n in range(max(x["low"], least - x["r"]), min(x["high"], x["l"]) + 1):
                    if not x["plow"] <= n <= x["phigh"]:
                        words = xxhash.xxh3_128_digest(b" ".join([*b[:n][::-1], *a[: least - n]]))
                        out.append((words, x["rank"], x["num"], x["place"] - n, x["nlow"] <= n <= x["nhigh"]))
            cols = list(zip(*out)) if out else [[]] * 5
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, (pa.binary(), pa.int64(), pa.int64(), pa.int32(), pa.bool_()))], names=["words", "rank", "num", "begin", "sure"])

    # a stretch shared with the row before is that row's, so that each run of rows that share one sends the first alone
    open_ = common.stored(met.mapInArrow(run, "words binary, rank long, num long, begin int, sure boolean"), "stretches")
    groups = open_.groupBy("words").agg(F.min("rank").alias("first"), F.count(F.lit(1)).alias("n")).where(F.col("n") > 1)
    more = open_.join(groups, "words", "left").where(F.col("sure") | F.col("n").isNotNull())
    more = more.select("num", F.explode(F.when(F.col("rank") != F.col("first"), F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))).alias("kind"), "begin", (F.col("begin") + least).alias("end"))
    before = met.where("plow <= phigh").select("num", F.explode(F.array(F.lit(0), F.lit(1))).alias("kind"), (F.col("place") - F.col("phigh")).alias("begin"), (F.col("place") - F.col("plow") + least).alias("end"))
    return more.union(before)


def spans(rows: DataFrame) -> DataFrame:
    """(num, kind, spans): intervals, where they touch, as maximal spans in
    order."""
    order = Window.partitionBy("num", "kind").orderBy("begin", "end")
    fresh = F.coalesce(F.col("begin") > F.max("end").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(True)).cast("int")
    runs = rows.withColumn("run", F.sum(fresh).over(order.rowsBetween(Window.unboundedPreceding, 0)))
    each = runs.groupBy("num", "kind", "run").agg(F.min("begin").alias("begin"), F.max("end").alias("end"))
    return each.groupBy("num", "kind").agg(F.sort_array(F.collect_list(F.struct("begin", "end"))).alias("spans"))


def repeated_passages(df: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", least: int = LEAST) -> DataFrame:
    """(doc_id, n_words, n_repeated, n_removable, repeated, removable) for each
    document with a passage of at least ``least`` words that stands elsewhere
    too, in another document or the same. repeated are its maximal spans of
    such words, removable those less one place of each ``least`` words, the
    first by what follows the words' suffix, then what stands before it, then
    the texts' hashes and places; arrays of structs begin, end in words, end
    exclusive. Words are what white space separates, compared byte by byte;
    where a rank is shared by more than ``CHUNK`` places, by 128-bit hashes
    beyond neighbours.

    A text of ``least`` words that several documents have whole is repeated
    whole, and removable whole but in the one of least doc_id. Null, empty and
    shorter texts have no row, a text of any length is read whole; rows without
    an id are not looked at; repeated rows of one id and text are one document,
    while rows of one id and different texts have a row each. Other columns are
    not looked at, an empty table gives an empty one.
    """
    if least < 2 * GRAM:
        raise ValueError(f"least at least {2 * GRAM}")
    docs, pairs = numbered(common.documents(df, id_col, text_col).where(F.col("doc_id").isNotNull()))
    found = common.stored(suffixes(docs, least), "suffixes")
    owners = common.stored(pairs, "numbers")
    sizes = found.where(F.col("key").isNull()).groupBy("num").agg(F.max("place").alias("n_words"))
    heads = owners.groupBy("num").agg(F.min("doc_id").alias("head"), F.count(F.lit(1)).alias("copies"))

    split = found.where(F.col("key").isNotNull()).repartitionByRange("key", "num", "place").sortWithinPartitions("key", "num", "place")
    met = common.stored(neighbours(split), "neighbours")
    crowded = common.stored(met.groupBy("key").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > CHUNK).withColumn("crowd", F.lit(True)), "crowded")
    many, total = crowded.agg(F.count(F.lit(1)), F.coalesce(F.sum("n"), F.lit(0))).first()
    places = met.join(F.broadcast(crowded.drop("n")) if many <= SENT else crowded.drop("n"), "key", "left").groupBy("num").agg(F.collect_set("place").alias("places"), F.collect_set(F.when(F.col("crowd"), F.col("place"))).alias("hot"))
    chosen = common.stored(places.join(heads, "num").select("num", F.col("head").alias("doc_id"), "places", "hot"), "anchored")
    around = common.stored(contexts(docs.join(chosen, ["num", "doc_id"]), least), "contexts")
    hits = extended(around.where(~F.col("crowd")), least)
    if many:
        hits = hits.union(crowds(around.where("crowd"), least, total))
    parts = spans(hits).groupBy("num").agg(*(F.max(F.when(F.col("kind") == k, F.col("spans"))).alias(name) for k, name in ((0, "repeated"), (1, "removable"))))
    texts = common.stored(sizes.where(F.col("n_words") >= least).join(heads, "num").join(parts, "num", "left").where((F.col("copies") > 1) | F.col("repeated").isNotNull()), "texts")
    common.drop(found, met, chosen, around)

    whole = F.array(F.struct(F.lit(0).alias("begin"), F.col("n_words").alias("end")))
    copied, later = F.col("copies") > 1, F.col("doc_id") != F.col("head")
    out = owners.join(texts, "num").select("doc_id", "n_words", F.when(copied, whole).otherwise(F.col("repeated")).alias("repeated"), F.when(later, whole).otherwise(F.coalesce("removable", F.array_except(whole, whole))).alias("removable"))
    size = lambda c: F.aggregate(c, F.lit(0), lambda n, x: n + x["end"] - x["begin"])
    return out.select("doc_id", "n_words", size("repeated").alias("n_repeated"), size("removable").alias("n_removable"), "repeated", "removable")
