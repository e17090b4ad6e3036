"""SimHash near-duplicates, compared bit-sliced.

A text's fingerprint has a bit set where most hashes of its word shingles have
it set. Fingerprints that differ in at most ``RADIUS`` bits agree wholly in at
least half of ``BLOCKS`` blocks of bits, so every choice of that many blocks
makes one table of keys, and links are looked for among the distinct
fingerprints of a key. There, 64 fingerprints are one word of every bit plane.
A fingerprint is compared with all of them at once: the planes' differences go
into carry-save counters, and a word is abandoned once all its distances
exceed the radius.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vellum.llm import common

RADIUS, BLOCKS = 3, 6
#: Fingerprints of one key that are compared in one piece of work; a key with
#: more is dealt out in pairs of such chunks.
CHUNK = 2048
#: Fingerprints that a task compares at once, over keys.
BATCH = 1 << 16
_EDGES = [round(64 * i / BLOCKS) for i in range(BLOCKS + 1)]


def fingerprint(text: str, words: int = 3) -> int:
    """The 64-bit fingerprint, unsigned; 0 of a text without words."""
    import xxhash

    found = text.encode().lower().split()
    n = len(found)
    if not n:
        return 0
    if n < words:
        return int.from_bytes(_majority([xxhash.xxh64_digest(b" ".join(found), 42)]), "big")
    digest = xxhash.xxh64_digest
    return int.from_bytes(_majority([digest(b" ".join(s), 42) for s in zip(*(found[k:] for k in range(words)))]), "big")


def _majority(digests: list[bytes]) -> bytes:
    rows = np.frombuffer(b"".join(digests), np.uint8).reshape(-1, 8)
    total = np.zeros(64, np.int64)
    for at in range(0, len(rows), 1 << 14):
        total += np.unpackbits(rows[at : at + (1 << 14)], axis=1).sum(axis=0, dtype=np.int64)
    return np.packbits(2 * total > len(rows)).tobytes()


def fingerprints(df: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", words: int = 3) -> DataFrame:
    """(doc_id, fp long, a long, b long) for every row; fp holds the 64 bits,
    a and b are two hashes of the text."""

    def make():
        return lambda ids, texts: {"doc_id": ids, "fp": [(x := fingerprint(t, words)) - (x >> 63 << 64) for t in texts]}

    docs = common.documents(df, id_col, text_col)
    return common.map_documents(docs.select("doc_id", "text", *_hashes(F.col("text"))), make, "doc_id long, fp long, a long, b long", carry=("a", "b"))


def _hashes(text) -> list[F.Column]:
    return [F.xxhash64(text).alias("a"), F.xxhash64(F.lit(7), text).alias("b")]


def keys(fp) -> F.Column:
    """The keys of a fingerprint, one for each choice of half the blocks: the
    chosen blocks' bits side by side above the choice's number, all distinct
    between choices."""
    out = []
    for number, chosen in enumerate(combinations(range(BLOCKS), BLOCKS - RADIUS)):
        key = F.lit(0).cast("long")
        for b in chosen:
            width = _EDGES[b + 1] - _EDGES[b]
            part = F.shiftrightunsigned(fp, _EDGES[b]).bitwiseAND(F.lit((1 << width) - 1))
            key = F.shiftleft(key, width).bitwiseOR(part)
        out.append(F.shiftleft(key, 5).bitwiseOR(F.lit(number)))
    return F.array(*out)


class Planes:
    """Runs of fingerprints as bit planes, 64 to a word, each run beginning
    on a word of its own."""

    def __init__(self, values: np.ndarray, starts: np.ndarray):
        sizes = np.diff(np.append(starts, len(values)))
        self.words = -(-sizes // 64)
        self.first = np.cumsum(self.words) - self.words
        run = np.repeat(np.arange(len(starts)), sizes)
        place = np.arange(len(values)) - starts[run]
        word = self.first[run] + place // 64
        lane = (place % 64).astype(np.uint64)
        begins = np.flatnonzero(np.append(True, word[1:] != word[:-1]))
        self.base = begins  # of each word, the place of its lane 0
        self.lanes = np.zeros(len(begins), np.uint64)
        bit = np.uint64(1) << lane
        self.lanes = np.bitwise_or.reduceat(bit, begins)
        self.planes = np.empty((64, len(begins)), np.uint64)
        for p in range(64):
            self.planes[p] = np.bitwise_or.reduceat(np.where(values >> np.uint64(p) & np.uint64(1), bit, np.uint64(0)), begins)

    def near(self, queries: np.ndarray, words: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray]:
        """(row, place) of the fingerprints within ``radius`` of queries[row]
        in word words[row]. The counters hold distances up to 3 in two bits
        and, from 4 on, a flag; a smaller radius is cut from them."""
        full = np.uint64(0xFFFFFFFFFFFFFFFF)
        alive = np.arange(len(queries))
        over = ~self.lanes[words]
        ones, twos = np.zeros_like(over), np.zeros_like(over)
        q, w = queries, words
        for p in range(64):
            d = self.planes[p, w] ^ np.where(q >> np.uint64(p) & np.uint64(1), full, np.uint64(0))
            carry = ones & d
            ones ^= d
            over |= twos & carry
            twos ^= carry
            if p % 8 == 7:
                keep = over != full
                if not keep.all():
                    alive, over, ones, twos, q, w = (x[keep] for x in (alive, over, ones, twos, q, w))
                if not len(alive):
                    break
        within = ~over
        if radius < 3:
            within &= ~(ones & twos)
        if radius < 2:
            within &= ~twos
        if radius < 1:
            within &= ~ones
        rows, lanes = np.nonzero(np.unpackbits(within.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little"))
        return alive[rows], self.base[w[rows]] + lanes


def link_runs(values: np.ndarray, side: np.ndarray, starts: np.ndarray, radius: int = RADIUS) -> tuple[np.ndarray, np.ndarray]:
    """Links, as pairs of places, that connect what lies within the radius.

    ``starts`` are the runs' first places. In a run of one side (0) all are
    compared with all; in a run of sides 1 and 2, sorted by side, those of
    side 1 with those of side 2. A dense run's links are reduced to a star of
    each connected set.
    """
    n = len(values)
    stops = np.append(starts[1:], n)
    parts, queries = [], []
    for a, b in zip(starts, stops):
        cut = a + int(np.searchsorted(side[a:b], 2)) if side[a] else a
        if b - cut > 0 and b - a > 1:
            parts.append(cut)
            queries.append((a, cut if side[a] else b, cut, b))
    if not parts:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    targets = np.concatenate([np.arange(c, b) for _, _, c, b in queries])
    sizes = np.array([b - c for _, _, c, b in queries])
    planes = Planes(values[targets], np.cumsum(sizes) - sizes)
    root = np.arange(n)
    left, right = [], []
    rows, words = [], []
    held = 0
    for k, (qa, qb, c, _) in enumerate(queries):
        many = int(planes.words[k])
        mine = np.arange(qa, qb)
        r = np.repeat(mine, many)
        w = np.tile(planes.first[k] + np.arange(many), qb - qa)
        if qa == c:  # each pair once: a word behind the query's own has been its query
            ahead = w - planes.first[k] >= (r - qa) // 64
            r, w = r[ahead], w[ahead]
        rows.append(r)
        words.append(w)
        held += len(r)
        if held > 1 << 19 or k == len(queries) - 1:
            r, w = np.concatenate(rows), np.concatenate(words)
            row, place = planes.near(values[r], w, radius)
            a, b = r[row], targets[place]
            keep = a != b
            left.append(a[keep])
            right.append(b[keep])
            rows, words, held = [], [], 0
            if sum(map(len, left)) > 4 * n:
                root = _connect(root, np.concatenate(left), np.concatenate(right))
                left, right = [], []
    root = _connect(root, np.concatenate(left), np.concatenate(right)) if left else root
    moved = np.flatnonzero(root != np.arange(n))
    return moved, root[moved]


def _connect(root: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Least place of each connected set, given such of earlier links."""
    while True:
        x, y = root[a], root[b]
        open_ = x != y
        if not open_.any():
            return root
        a, b, x, y = a[open_], b[open_], x[open_], y[open_]
        low, high = np.minimum(x, y), np.maximum(x, y)
        np.minimum.at(root, high, low)
        while True:
            up = root[root]
            if (up == root).all():
                break
            root = up


def links(distinct: DataFrame, radius: int = RADIUS) -> DataFrame:
    """(a, b): links between the distinct fingerprints ``fp`` that connect all
    those within the radius.

    Keys with one fingerprint go first, by counts that are summed before they
    are shuffled. What is left meets by key, a key with many in pairs of
    chunks, so no task holds more than two chunks of a key.
    """
    if radius > RADIUS:
        raise ValueError(f"radius at most {RADIUS}")
    keyed = distinct.select("fp", F.explode(keys(F.col("fp"))).alias("key"))
    shared = common.stored(keyed.groupBy("key").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > 1), "simkeys")
    parts = F.ceil(F.col("n") / CHUNK).cast("int")
    met = keyed.join(shared, "key").select("key", "fp", parts.alias("parts"), F.pmod(F.xxhash64("fp"), parts).cast("int").alias("own"))
    dealt = met.select("key", "fp", "own", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("other"))
    dealt = dealt.select("key", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"), F.when(F.col("own") == F.col("other"), 0).when(F.col("own") < F.col("other"), 1).otherwise(2).cast("int").alias("side"), "fp")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] = []

        def flush(last: bool):
            rows = np.concatenate(held)
            change = np.flatnonzero(np.append(True, (rows[1:, :3] != rows[:-1, :3]).any(axis=1)))
            cut = len(rows) if last else int(change[-1])
            starts = change[change < cut]
            held[:] = [] if last else [rows[cut:]]
            if not len(starts):
                return None
            a, b = link_runs(rows[:cut, 4].view(np.uint64), rows[:cut, 3], starts, radius)
            return pa.RecordBatch.from_arrays([pa.array(rows[a, 4]), pa.array(rows[b, 4])], names=["a", "b"])

        size = 0
        for batch in batches:
            held.append(np.column_stack([c.to_numpy(zero_copy_only=False).astype(np.int64) for c in batch.columns]))
            size += batch.num_rows
            if size >= BATCH:
                if (out := flush(False)) is not None:
                    yield out
                size = sum(map(len, held))
        if held and (out := flush(True)) is not None:
            yield out

    return dealt.repartition("key", "i", "j").sortWithinPartitions("key", "i", "j", "side", "fp").mapInArrow(run, "a long, b long")


def simhash_components(df: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", words: int = 3, radius: int = RADIUS) -> DataFrame:
    """(doc_id, fingerprint, component_id) for every row of ``df``.

    Fingerprints are 16 lowercase hex digits; component_id is the least doc_id
    of all documents that links of at most ``radius`` differing bits reach.

    A null, empty or blank text has fingerprint zero and is linked like any
    other; a text of any length is read whole. Repeated rows each have a row;
    a null doc_id stays null, and names no component unless all of its
    component's ids are null. Other columns are not looked at, an empty table
    gives an empty table.
    """
    prints = common.stored(fingerprints(df, id_col=id_col, text_col=text_col, words=words).select("doc_id", "fp"), "simhash")
    distinct = common.stored(prints.groupBy("fp").agg(F.min("doc_id").alias("first")), "simdistinct")
    roots = common.components(links(distinct, radius))
    named = distinct.join(roots.withColumnRenamed("node", "fp"), "fp", "left").select("fp", "first", F.coalesce("root", "fp").alias("root"))
    least = common.stored(named.groupBy("root").agg(F.min("first").alias("component_id")), "simleast")
    named = common.stored(named.join(least, "root").select("fp", "component_id"), "simnames")
    common.drop(distinct, roots, least)
    return prints.join(named, "fp").select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


def keep_one(df: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", words: int = 3, radius: int = RADIUS) -> DataFrame:
    """The rows of ``df``, all their columns, that stand for their group: of
    each component of texts that ``simhash_components`` links one row.

    That is the row of the least id, so the document that names the component;
    of rows of that id with different texts the one of the least fingerprint,
    then hash; of repeated rows any one. Rows of one id stay or go each by its
    own text's component. A row without an id stays only where none of its
    component has one. Null, empty and blank texts are one component, texts of
    any length are read whole, other columns may have any names, an empty
    table gives an empty table.
    """
    prints = common.stored(fingerprints(df, id_col=id_col, text_col=text_col, words=words), "simhash")
    first = F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "fp", "a", "b")).alias("first")
    distinct = common.stored(prints.groupBy("fp").agg(first), "simdistinct")
    roots = common.components(links(distinct, radius))
    named = distinct.join(roots.withColumnRenamed("node", "fp"), "fp", "left").select(F.coalesce("root", "fp").alias("root"), "first")
    rows = prints.groupBy("doc_id", "a", "b").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > 1)
    chosen = named.groupBy("root").agg(F.min("first").alias("first")).select("first.doc_id", "first.a", "first.b")
    # which of the rows that stay stand there more than once, so that only these are looked at again
    i, a, b, n = common.unused(df, 4)
    same = [F.col("doc_id").eqNullSafe(F.col(i)), F.col("a") == F.col(a), F.col("b") == F.col(b)]
    stay = common.stored(chosen.toDF(i, a, b).join(rows, same, "left").select(i, a, b, F.coalesce("n", F.lit(1)).alias(n)), "simkept")
    common.drop(prints, distinct, roots)
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    x, y = _hashes(text)
    kept = df.join(stay, F.col(id_col).cast("long").eqNullSafe(F.col(i)) & (x == F.col(a)) & (y == F.col(b)))
    if stay.where(F.col(n) > 1).isEmpty():
        return kept.select(*map(_quoted, df.columns))
    one = kept.where(F.col(n) > 1).dropDuplicates([i, a, b])
    return kept.where(F.col(n) == 1).unionByName(one).select(*map(_quoted, df.columns))


def _quoted(name: str) -> F.Column:
    return F.col("`" + name.replace("`", "``") + "`")
