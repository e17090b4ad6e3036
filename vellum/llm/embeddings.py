"""Near-duplicate vectors by randomised-rotation binary codes.

A unit vector is turned by a random rotation and kept as the signs of its
coordinates with a correction factor, its inner product with the unit vector of
those signs. The signs' inner product with another turned vector, divided by
the factor, estimates the vectors' inner product without bias, with an error
whose bound is known; pairs whose upper bound stays below the threshold go. The
turned vectors are kept in eight bits as well, whose error is bounded for sure:
pairs beyond it are decided, and only those in doubt are recomputed from the
vectors in double precision.

Pairs to estimate come from tables over further rotations, keyed by the
coordinates that are largest there. What travels for a table is a key, a number,
128 signs and what tells whether a pair has met in the first tables; of a key's rows those whose signs differ in few enough places are
paired. Their codes, factors and vectors stay where they are, in a table
bucketed by the vectors' numbers, to which the pairs are sent. Keys shorten so
that one has some hundreds of rows, and the tables' number follows from the recall
at the threshold.

Crowds don't get there: a bounded number of leaders, a random sample, gather
balls of vectors so close to them that all links inside a ball hold, and what
lies clearly within or beyond reach of a whole ball is counted for the ball.
Vectors at its rim meet its members as the rows of a key meet each other.
"""

from __future__ import annotations

import functools
import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vellum.llm import common

#: Leaders at most, and the angle that a ball reaches from its leader.
LEADERS, BALL = 1024, math.radians(8)
#: Chance that a pair right at the threshold meets in some table.
RECALL = 0.995
#: Chance that a pair right at the threshold differs in more signs than let through.
MISS = 5e-4
#: Standard errors that an estimate's bound allows for.
SURE = 5.0
#: Rows that a key has on average, as a power of two.
SHARED = 9
#: Rows of one key that are compared in one piece of work, and the share of
#: the vectors (one of so many) that tells which keys have more.
CHUNK, SAMPLE = 2048, 64
#: Crowded keys up to which their list is sent to all tasks.
SENT = 100_000
BATCH = 1 << 16
SEED = 7
#: Coordinates of one part of a key, the signs that travel, and the first
#: tables whose keys travel in short, so that later ones pass over their pairs.
COORDS, SIGNS, FIRST = 64, 128, 4


def rotations(dim: int, n: int) -> np.ndarray:
    """``n`` random orthogonal matrices side by side."""
    out = []
    for k in range(n):
        q, r = np.linalg.qr(np.random.default_rng([SEED, dim, k]).normal(size=(dim, dim)))
        out.append(q * np.sign(np.diag(r)))
    return np.concatenate(out, axis=1)


@functools.lru_cache(64)
def code_turn(dim: int) -> np.ndarray:
    """The codes' rotation, with as many more as the signs that travel need."""
    return rotations(dim, max(1, -(-SIGNS // dim)))


def units(rows) -> np.ndarray:
    x = np.asarray(rows, np.float64)
    x = x / np.abs(x).max(axis=1, keepdims=True)
    return x / np.sqrt((x * x).sum(axis=1, keepdims=True))


@functools.lru_cache(256)
def meet(coords: int, threshold: float) -> float:
    """Chance that of two unit vectors at the threshold the same of so many
    random coordinates is largest, with the same sign; by trial."""
    rng = np.random.default_rng([SEED, coords])
    same = total = 0
    for _ in range(40):
        x = rng.normal(size=(1000, coords))
        y = threshold * x + math.sqrt(1 - threshold**2) * rng.normal(size=x.shape)
        at = np.abs(x).argmax(axis=1)
        own = np.arange(len(x))
        same += int(((np.abs(y).argmax(axis=1) == at) & ((x[own, at] > 0) == (y[own, at] > 0))).sum())
        total += len(x)
    return same / total


def tables(n: int, threshold: float, recall: float | None = None) -> tuple[tuple[int, ...], int]:
    """The parts of a key, as the coordinates each looks at, and the number of
    tables for n rows."""
    recall = RECALL if recall is None else recall
    bits = max(1, math.ceil(math.log2(max(2, n))) - SHARED)
    whole = int(math.log2(COORDS)) + 1
    parts = (COORDS,) * (bits // whole) + ((1 << bits % whole - 1,) if bits % whole else ())
    chance = math.prod(meet(c, threshold) for c in parts)
    return parts, 1 if chance >= recall else math.ceil(math.log(1 - recall) / math.log(1 - chance))


@functools.lru_cache(8)
def key_turn(dim: int, parts: tuple[int, ...], count: int) -> np.ndarray:
    """For each table and part of its key so many orthonormal directions (as
    far as there are such)."""
    out = []
    for t in range(count):
        for k, coords in enumerate(parts):
            rng = np.random.default_rng([SEED + 1, dim, t, k])
            if dim >= coords:
                out.append(np.linalg.qr(rng.normal(size=(dim, coords)))[0])
            else:
                out.append(np.concatenate([np.linalg.qr(rng.normal(size=(dim, dim)))[0] for _ in range(-(-coords // dim))], axis=1)[:, :coords])
    return np.concatenate(out, axis=1).astype(np.float32)


def keys_of(u: np.ndarray, parts: tuple[int, ...], count: int) -> np.ndarray:
    """The key of each unit vector in each table."""
    turned = u.astype(np.float32) @ key_turn(u.shape[1], parts, count)
    keys = np.empty((len(u), count), np.uint64)
    at, own = 0, np.arange(len(u))

    def mixed(key: np.ndarray) -> np.ndarray:
        key = key * np.uint64(0x9E3779B97F4A7C15)
        return key ^ key >> np.uint64(29)

    for t in range(count):
        # lengths and tables far apart before the parts come in
        key = mixed(np.full(len(u), (u.shape[1] << 20) + t + 1, np.uint64))
        for coords in parts:
            part = turned[:, at : at + coords]
            best = np.abs(part).argmax(axis=1)
            key = mixed(key ^ (2 * best + (part[own, best] > 0) + 1).astype(np.uint64))
            at += coords
        # the table's number in the low byte; as a signed number not below zero
        keys[:, t] = key >> np.uint64(9) << np.uint64(8) | np.uint64(min(t, 255))
    return keys.view(np.int64)


def met_before(keys: np.ndarray) -> np.ndarray:
    """The keys of the first tables, 16 bits of each, as one number."""
    out = np.zeros(len(keys), np.uint64)
    for t in range(min(FIRST, keys.shape[1])):
        out |= (keys[:, t].view(np.uint64) >> np.uint64(8) & np.uint64(0xFFFF)) << np.uint64(16 * t)
    return out.view(np.int64)


def fresh(table: np.ndarray, first: np.ndarray, second: np.ndarray) -> np.ndarray:
    """Whether pairs of a table haven't met in one of the first tables, by what
    ``met_before`` tells of their rows. That two different keys look alike
    hides a pair with a chance of 2 ** -14."""
    out = np.ones(len(table), bool)
    for t in range(FIRST):
        same = (first >> np.uint64(16 * t) & np.uint64(0xFFFF)) == (second >> np.uint64(16 * t) & np.uint64(0xFFFF))
        out &= ~(same & (table > t))
    return out


def signs_of(u: np.ndarray) -> np.ndarray:
    """The signs that travel, as a row of two numbers for each vector."""
    return np.packbits(u @ code_turn(u.shape[1])[:, :SIGNS] >= 0, axis=1).view(np.int64)


def most_signs(threshold: float, miss: float | None = None) -> int:
    """Signs in which vectors at the threshold may differ; more at most with
    the chance ``miss``."""
    miss = MISS if miss is None else miss
    p = math.acos(threshold) / math.pi
    beyond, k = 1.0, -1
    while beyond > miss and k < SIGNS:
        k += 1
        beyond -= math.comb(SIGNS, k) * p**k * (1 - p) ** (SIGNS - k)
    return k


class Codes:
    """What is kept of a turned vector, as fixed-size bytes: its signs with
    the correction factor, which travel, and its coordinates in eight bits
    with their scale, which stay."""

    def __init__(self, dim: int):
        self.dim = dim
        self.signs = np.dtype([("factor", "<f4"), ("code", "u1", ((dim + 7) // 8,))])
        self.turned = np.dtype([("scale", "<f4"), ("turned", "i1", (dim,))])

    def pack(self, turned: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        code, own = np.zeros(len(turned), self.signs), np.zeros(len(turned), self.turned)
        signs = turned >= 0
        code["factor"] = np.where(signs, turned, -turned).sum(axis=1) / math.sqrt(self.dim)
        code["code"] = np.packbits(signs, axis=1)
        own["scale"] = np.maximum(np.abs(turned).max(axis=1), 1e-30) / 127
        own["turned"] = np.rint(turned / own["scale"][:, None].astype(float)).clip(-127, 127)
        return code, own

    def estimate(self, code: np.ndarray, own: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Unbiased estimates of the inner products of the vectors of ``code``
        with those of ``own``, and the errors that their bounds allow for."""
        factor = np.clip(code["factor"].astype(float), 1e-9, 1.0)
        signs = (np.unpackbits(code["code"], axis=1)[:, : self.dim].astype(np.float32) * 2 - 1) / np.float32(math.sqrt(self.dim))
        inner = np.einsum("ij,ij->i", signs, own["turned"].astype(np.float32) * own["scale"][:, None])
        # rounding to eight bits moves no coordinate by more than half the scale
        slack = own["scale"].astype(float) * (0.5 * math.sqrt(self.dim)) + 1e-6
        bound = SURE * np.sqrt(np.maximum(0.0, 1 - factor**2)) / factor / math.sqrt(max(1, self.dim - 1))
        return inner / factor, slack / factor + bound

    def inner(self, x: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Inner products of vectors in eight bits, and what they can be off."""
        found = np.einsum("ij,ij->i", x["turned"].astype(np.int32), y["turned"].astype(np.int32)) * (x["scale"].astype(float) * y["scale"])
        ex, ey = (z["scale"].astype(float) * (0.5 * math.sqrt(self.dim)) for z in (x, y))
        return found, ex + (1 + ex) * ey + 1e-5


def close(signs: np.ndarray, side: np.ndarray, starts: np.ndarray, most: int) -> tuple[np.ndarray, np.ndarray]:
    """Places of pairs that differ in at most ``most`` signs: of a run of side
    0 all pairs, of the others those of sides 1 and 2 with side 3. The signs
    are rows of unsigned numbers."""
    left, right = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
    for a, b in zip(starts, np.append(starts[1:], len(signs))):
        if b - a < 2:
            continue
        cut = a + int(np.searchsorted(side[a:b], 3)) if side[a] else a
        stop = cut if side[a] else b
        for at in range(a, stop, 512):
            mine = signs[at : min(at + 512, stop)]
            begin = cut if side[a] else at
            far = sum((np.bitwise_count(mine[:, None, k] ^ signs[None, begin:b, k]) for k in range(signs.shape[1])), np.uint8(0))
            hits = np.flatnonzero(far <= most)
            i, j = hits // (b - begin) + at, hits % (b - begin) + begin
            if not side[a]:
                ahead = i < j
                i, j = i[ahead], j[ahead]
            left.append(i)
            right.append(j)
    return np.concatenate(left), np.concatenate(right)


def _flat(col: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Numbers of a list column one after the other, and where rows begin."""
    ends = np.zeros(len(col) + 1, np.int64)
    np.cumsum(pc.fill_null(pc.list_value_length(col), 0).to_numpy(zero_copy_only=False), out=ends[1:])
    return col.flatten().to_numpy(zero_copy_only=False), ends


def _by_length(col: pa.Array) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(places, matrix) of the rows of each length."""
    flat, ends = _flat(col)
    sizes = np.diff(ends)
    for d in np.unique(sizes).tolist():
        own = np.flatnonzero(sizes == d)
        yield own, flat[ends[own][:, None] + np.arange(d)].astype(np.float64)


def _digests(df: DataFrame, id_col: str, vec_col: str, schema: str, pick) -> DataFrame:
    """Rows of what ``pick`` takes of a batch's ids, pairs of 64-bit hashes
    (None for vectors that link with nothing), vectors, and their lengths."""
    kind = df.schema[vec_col].dataType.simpleString()
    kind = kind if kind in ("array<float>", "array<double>") else "array<double>"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        take = pick()
        for batch in batches:
            ids, col = batch.columns
            flat, ends = _flat(col)
            sizes = np.diff(ends)
            wrong = np.concatenate([[0], np.cumsum(~np.isfinite(flat))])
            some = np.concatenate([[0], np.cumsum(flat != 0)])
            fine = (sizes > 0) & (wrong[ends[1:]] == wrong[ends[:-1]]) & (some[ends[1:]] > some[ends[:-1]]) & ids.is_valid().to_numpy(zero_copy_only=False)
            raw, width = memoryview(np.ascontiguousarray(flat)).cast("B"), flat.itemsize
            two = np.zeros((len(ids), 2), np.int64)
            for i in np.flatnonzero(fine).tolist():
                two[i] = np.frombuffer(hashlib.md5(raw[ends[i] * width : ends[i + 1] * width]).digest(), np.int64)
            yield take(ids, fine, two, sizes, col)

    return df.select(F.col(id_col).cast("long").alias("vec_id"), F.col(vec_col).cast(kind).alias("e")).mapInArrow(run, schema.replace("VECTOR", kind))


def _ids(df: DataFrame, id_col: str, vec_col: str) -> DataFrame:
    """(vec_id, a, b): every row with two hashes of its vector, null for rows
    that link with nothing."""

    def pick():
        return lambda ids, fine, two, sizes, col: pa.RecordBatch.from_arrays([ids, *(pa.array(two[:, k], mask=~fine) for k in (0, 1))], names=["vec_id", "a", "b"])

    return _digests(df, id_col, vec_col, "vec_id long, a long, b long", pick)


def _distinct(df: DataFrame, id_col: str, vec_col: str, clash: frozenset, only: frozenset | None = None) -> DataFrame:
    """(num, e): every vector that may link, under its number, at least once
    and seldom twice in a task; of ``only`` these numbers if given."""

    def pick():
        seen: set[int] = set()

        def take(ids, fine, two, sizes, col):
            nums = two[:, 0].copy()
            if clash:
                moved = np.isin(nums, list(clash))
                nums[moved] = two[moved, 1]
            if only is not None:
                fine = fine & np.isin(nums, list(only))
            if len(seen) > 1 << 18:
                seen.clear()
            own = [i for i in np.flatnonzero(fine).tolist() if not (int(nums[i]) in seen or seen.add(int(nums[i])))]
            return pa.RecordBatch.from_arrays([pa.array(nums[own]), col.take(pa.array(own, pa.int64()))], names=["num", "e"])

        return take

    return _digests(df, id_col, vec_col, "num long, e VECTOR", pick)


def _place(classes: DataFrame, leaders: dict[int, tuple[int, np.ndarray]], threshold: float) -> DataFrame:
    """Each class, once, with its ball (-1: none), the leaders whose whole
    balls it links with (near) or may link with in part (rim), its signs and
    code. ``leaders``: by length the first leader's number, and vectors."""
    reach = math.acos(threshold)
    inside, sure, never = math.cos(BALL), math.cos(reach - BALL), math.cos(min(math.pi, reach + BALL))
    kind = classes.schema["e"].dataType.simpleString()
    names = ["num", "copies", "first", "dim", "ball", "near", "rim", "s0", "s1", "code", "turned", "e"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last = None
        for batch in batches:
            nums = batch.column(0).to_numpy()
            fresh = np.append(len(nums) > 0 and (last is None or nums[0] != last), nums[1:] != nums[:-1]) if len(nums) else np.zeros(0, bool)
            last = nums[-1] if len(nums) else last
            batch = batch.filter(pa.array(fresh))
            for own, x in _by_length(batch.column(3)):
                u = units(x)
                dim = x.shape[1]
                first, heads = leaders.get(dim, (0, np.zeros((0, dim))))
                cos = u @ heads.T
                close_ = cos >= inside
                ball = np.where(close_.any(axis=1), close_.argmax(axis=1), -1) if len(heads) else np.full(len(u), -1)
                other = np.arange(len(heads))[None, :] != ball[:, None]
                near = [(np.flatnonzero(r) + first).tolist() for r in (cos >= sure) & other]
                rim = [(np.flatnonzero(r) + first).tolist() for r in (cos < sure) & (cos >= never - 1e-12) & other]
                code, turned = ([r.tobytes() for r in x] for x in Codes(dim).pack(u @ code_turn(dim)[:, :dim]))
                part = batch.take(pa.array(own))
                made = [pa.array(np.full(len(u), dim), pa.int32()), pa.array(np.where(ball < 0, -1, ball + first), pa.int32()), pa.array(near, pa.list_(pa.int32())), pa.array(rim, pa.list_(pa.int32())), *(pa.array(np.ascontiguousarray(c)) for c in signs_of(u).T), pa.array(code, pa.binary()), pa.array(turned, pa.binary())]
                yield pa.RecordBatch.from_arrays([*part.columns[:3], *made, part.column(3)], names=names)

    return classes.select("num", "copies", "first", "e").mapInArrow(run, f"num long, copies long, first long, dim int, ball int, near array<int>, rim array<int>, s0 long, s1 long, code binary, turned binary, e {kind}")


def _keyed(singles: DataFrame, parts: tuple[int, ...], count: int) -> DataFrame:
    """(key, num, s0, s1, met): a row for each table's key of each class."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 1024):
                part = batch.slice(at, 1024)
                for own, x in _by_length(part.column(3)):
                    keys = keys_of(units(x), parts, count)
                    same = [*(part.column(k).to_numpy()[own] for k in (0, 1, 2)), met_before(keys)]
                    yield pa.RecordBatch.from_arrays([pa.array(keys.ravel()), *(pa.array(np.repeat(c, count)) for c in same)], names=["key", "num", "s0", "s1", "met"])

    return singles.select("num", "s0", "s1", "e").mapInArrow(run, "key long, num long, s0 long, s1 long, met long")


def _dealt(singles: DataFrame, parts: tuple[int, ...], count: int) -> DataFrame:
    """(key, i, j, side, num, s0, s1, met): the rows of each key, or those of a
    crowded one in pairs of chunks. Which keys are crowded a sample of the
    vectors tells; it changes how rows are dealt, not which ones meet."""
    sample = _keyed(singles.where(F.pmod(F.xxhash64("num"), F.lit(SAMPLE)) == 0), parts, count).groupBy("key").agg((F.count(F.lit(1)) * SAMPLE).alias("n"))
    crowded = common.stored(sample.where(F.col("n") > CHUNK * 3 // 2).select("key", F.ceil(F.col("n") / CHUNK).cast("int").alias("parts")), "veckeys")
    met = _keyed(singles, parts, count)
    n = crowded.count()
    met = met.join(F.broadcast(crowded) if n <= SENT else crowded, "key", "left") if n else met.withColumn("parts", F.lit(1))
    met = met.withColumn("parts", F.coalesce("parts", F.lit(1))).withColumn("own", F.pmod(F.xxhash64("num"), "parts").cast("int"))
    met = met.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
    side = F.when(F.col("own") == F.col("other"), 0).when(F.col("own") < F.col("other"), 1).otherwise(3).cast("int")
    return met.select("key", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"), side.alias("side"), "num", "s0", "s1", "met")


def _rims(placed: DataFrame, balls: DataFrame) -> DataFrame:
    """The same for the balls: members (side 3) with the vectors at the rim
    (1, or 2 where these are in another ball, whose links count one way)."""
    rim = placed.select(F.explode("rim").alias("ball"), "num", "s0", "s1", F.when(F.col("ball") < 0, 1).otherwise(2).cast("int").alias("side"))
    crowd = rim.groupBy("ball").agg(F.count(F.lit(1)).alias("r")).join(balls.where("size > 0").select("ball", "classes"), "ball")
    # no more rows than leaders
    crowd = F.broadcast(common.stored(crowd.select("ball", F.ceil(F.col("classes") / CHUNK).cast("int").alias("ms"), F.ceil(F.col("r") / CHUNK).cast("int").alias("rs")), "rims"))
    deal = lambda n: F.pmod(F.xxhash64("num"), n).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    key = (-F.col("ball").cast("long") - 1).alias("key")
    members = placed.where("ball >= 0").select("ball", "num", "s0", "s1", F.lit(3).alias("side")).join(crowd, "ball").withColumn("i", deal("ms")).withColumn("j", every("rs"))
    guests = rim.join(crowd, "ball").withColumn("j", deal("rs")).withColumn("i", every("ms"))
    cols = [key, "i", "j", "side", "num", "s0", "s1", F.lit(0).cast("long").alias("met")]
    return members.select(*cols).unionByName(guests.select(*cols))


def _met(dealt: DataFrame, threshold: float) -> DataFrame:
    """(a, b, one_way): pairs whose signs differ in few enough places."""
    most = most_signs(threshold)

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
            side, nums = rows[:cut, 3], rows[:cut, 4]
            i, j = close(np.ascontiguousarray(rows[:cut, 5:7]).view(np.uint64), side, starts, most)
            table, before = np.where(rows[:cut, 0] < 0, 0, rows[:cut, 0] & 255), rows[:cut, 7].copy().view(np.uint64)
            new = fresh(table[i], before[i], before[j])
            i, j = i[new], j[new]
            way = side[i] == 2
            a, b = np.where(way, nums[i], np.minimum(nums[i], nums[j])), np.where(way, nums[j], np.maximum(nums[i], nums[j]))
            found = np.unique(np.column_stack([a, b, way])[a != b], axis=0)
            return pa.RecordBatch.from_arrays([pa.array(found[:, 0]), pa.array(found[:, 1]), pa.array(found[:, 2].astype(bool))], names=["a", "b", "one_way"])

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

    return dealt.repartition("key", "i", "j").sortWithinPartitions("key", "i", "j", "side").mapInArrow(run, "a long, b long, one_way boolean").distinct()


def _with(pairs: DataFrame, placed: DataFrame, x: list[str], y: list[str]) -> DataFrame:
    """The pairs with columns of their first vectors (x_), which travel to the
    second ones, and of those (y_)."""
    for end, mark, cols in (("a", "x", x), ("b", "y", y)):
        pairs = pairs.join(placed.select(F.col("num").alias(end), *(F.col(c).alias(f"{mark}_{c}") for c in cols)), end)
    return pairs


def _judged(pairs: DataFrame, placed: DataFrame, threshold: float) -> DataFrame:
    """(a, b, one_way, ca, cb, sure): the pairs that may reach the threshold,
    with the copies of both; sure are those that do so whatever the bits left
    out were."""
    met = _with(pairs, placed, ["dim", "copies", "code", "turned"], ["dim", "copies", "turned"]).where(F.col("x_dim") == F.col("y_dim"))
    met = met.select("a", "b", "one_way", F.col("x_copies").alias("ca"), F.col("y_copies").alias("cb"), "x_dim", "x_code", "x_turned", "y_turned")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            dims = batch.column(5).to_numpy()
            for dim in np.unique(dims).tolist():
                codes = Codes(dim)
                part = batch.filter(pa.array(dims == dim))
                code, x, y = (np.frombuffer(b"".join(part.column(k).to_pylist()), t) for k, t in ((6, codes.signs), (7, codes.turned), (8, codes.turned)))
                about, error = codes.estimate(code, y)
                inner, off = codes.inner(x, y)
                may = (about + error >= threshold) & (inner + off >= threshold)
                sure = pa.array((inner - off >= threshold)[may])
                kept = part.select([0, 1, 2, 3, 4]).filter(pa.array(may))
                yield pa.RecordBatch.from_arrays([*kept.columns, sure], names=["a", "b", "one_way", "ca", "cb", "sure"])

    return met.mapInArrow(run, "a long, b long, one_way boolean, ca long, cb long, sure boolean")


def _exact(pairs: DataFrame, placed: DataFrame, threshold: float) -> DataFrame:
    """The pairs whose cosine in double precision is no less than the
    threshold."""
    met = _with(pairs, placed, ["e"], ["e"]).select("a", "b", "one_way", "ca", "cb", "x_e", "y_e")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for own, x in _by_length(batch.column(5)):
                part = batch.take(pa.array(own))
                (_, y), = _by_length(part.column(6))
                # by powers of two, which rounds nothing
                x, y = (np.ldexp(z, -np.frexp(np.abs(z).max(axis=1, keepdims=True))[1]) for z in (x, y))
                cos = (x * y).sum(axis=1) / np.sqrt((x * x).sum(axis=1) * (y * y).sum(axis=1))
                yield part.select([0, 1, 2, 3, 4]).filter(pa.array(cos >= threshold))

    return met.mapInArrow(run, "a long, b long, one_way boolean, ca long, cb long")


def _leaders(found: list) -> tuple[dict[int, tuple[int, np.ndarray]], list[tuple[int, int]]]:
    """Leaders by length, and (ball, number) of each."""
    by_length: dict[int, list] = {}
    for num, e in sorted({r.num: r.e for r in found}.items()):
        by_length.setdefault(len(e), []).append((num, e))
    leaders, heads = {}, []
    for dim, rows in sorted(by_length.items()):
        sample = units([e for _, e in rows])
        kept: list[int] = []
        for k in range(len(rows)):
            if not kept or (sample[kept] @ sample[k]).max() < math.cos(BALL / 2):
                kept.append(k)
        leaders[dim] = (len(heads), sample[kept])
        heads += [(len(heads) + i, rows[k][0]) for i, k in enumerate(kept)]
    return leaders, heads


def embedding_components(df: DataFrame, *, id_col: str = "vec_id", vec_col: str = "embedding", threshold: float = 0.9) -> DataFrame:
    """(vec_id, n_links, component_id, kept) for every row of ``df``.

    Two rows are linked where the cosine of their vectors, in double
    precision, is no less than ``threshold`` (above 0.2, below 1). No pair
    below it is linked, and a pair right at it is found with a chance of about
    ``RECALL`` (a little less where vectors have fewer than ``COORDS``
    numbers), closer ones with a greater one. n_links counts the other rows
    linked directly, component_id is the least vec_id that links reach, kept
    says whether that is the row's own.

    A vector that is null, empty, zero, or holds a null or a number that is
    not finite links with nothing, and so does a row without an id: no links,
    its own id as component. Vectors of different lengths, of which there can
    be any number, don't link. Equal vectors are compared once and count with
    their copies, equal by 128 bits of a hash; rows of one id are one node of
    the components. Other columns are not looked at, an empty table gives an
    empty table.
    """
    spark = df.sparkSession
    vectors = common.stored(_ids(df, id_col, vec_col), "vectors")
    fine = vectors.where(F.col("a").isNotNull())
    clash = frozenset(common.clashes(fine))
    fine = fine.select("vec_id", (F.when(F.col("a").isin(*clash), F.col("b")).otherwise(F.col("a")) if clash else F.col("a")).alias("num"))
    counted = common.stored(fine.groupBy("num").agg(F.count(F.lit(1)).alias("copies"), F.min("vec_id").alias("first")), "veccounts")
    n = counted.count()
    chosen = frozenset(r.num for r in counted.orderBy("num").limit(LEADERS).collect())
    leaders, heads = _leaders(_distinct(df, id_col, vec_col, clash, chosen).collect())
    heads = spark.createDataFrame(heads, "ball int, head long")

    rows = _distinct(df, id_col, vec_col, clash).repartition("num").join(counted, "num").sortWithinPartitions("num")
    placed = common.bucketed(_place(rows, leaders, threshold), "num", "placed")
    single = F.col("ball") < 0
    sizes = placed.where(~single).groupBy("ball").agg(F.sum("copies").alias("size"), F.count(F.lit(1)).alias("classes"))
    guests = placed.where(single).select(F.explode("near").alias("ball"), "copies").groupBy("ball").agg(F.sum("copies").alias("guests"))
    # no more rows than leaders
    balls = common.stored(heads.join(sizes, "ball", "left").join(guests, "ball", "left").na.fill(0, ["size", "classes", "guests"]), "balls")
    inside = placed.where(~single).select("num", "ball").join(F.broadcast(balls), "ball").select("num", (F.col("size") + F.col("guests") - 1).alias("n"), "head")
    beside = placed.select("num", F.explode("near").alias("ball")).join(F.broadcast(balls), "ball").select("num", F.col("size").alias("n"), "head")

    parts, count = tables(n, threshold)
    dealt = _dealt(placed.where(single), parts, count).unionByName(_rims(placed, balls))
    judged = common.stored(_judged(_met(dealt, threshold), placed, threshold), "vecjudged")
    exact = _exact(judged.where(~F.col("sure")).drop("sure"), placed, threshold)
    links = common.stored(judged.where("sure").drop("sure").unionByName(exact), "veclinks")

    counts = inside.select("num", "n").union(beside.select("num", "n"))
    counts = counts.union(placed.select("num", F.when(single, F.col("copies") - 1).otherwise(0).alias("n")))
    counts = counts.union(links.select("a", "cb")).union(links.where(~F.col("one_way")).select("b", "ca"))
    edges = inside.select("num", "head").union(beside.select("num", "head")).union(links.select("a", "b")).toDF("a", "b")
    # rows of one id are one node
    spread = fine.groupBy("vec_id").agg(F.min("num").alias("a"), F.max("num").alias("z")).where(F.col("a") != F.col("z"))
    more = fine.select("vec_id", F.col("num").alias("b")).join(spread.select("vec_id", "a"), "vec_id").select("a", "b")
    roots = common.components(edges.union(more))
    named = counted.select("num", "first").join(roots.withColumnRenamed("node", "num"), "num", "left").select("num", "first", F.coalesce("root", "num").alias("root"))
    least = common.stored(named.groupBy("root").agg(F.min("first").alias("component_id")), "vecleast")
    totals = counts.groupBy("num").agg(F.sum("n").alias("n_links"))
    names = common.stored(named.join(least, "root").join(totals, "num").select("num", "n_links", "component_id"), "vecnames")
    common.drop(placed, judged, links, roots, least, counted)
    own = F.when(F.col("a").isin(*clash), F.col("b")).otherwise(F.col("a")) if clash else F.col("a")
    out = vectors.select("vec_id", own.alias("num")).join(names, "num", "left")
    component = F.coalesce("component_id", "vec_id")
    return out.select("vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"), F.coalesce(F.col("vec_id") == component, F.lit(False)).alias("kept"))
