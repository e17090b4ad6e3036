import re

import numpy as np
import pytest
import xxhash

from vellum.llm import common, queries, simhash


def plain(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    if not words:
        return 0
    shingles = [" ".join(words[i : i + 3]) for i in range(max(1, len(words) - 2))]
    h = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def brute(rows, radius=3):
    prints = sorted({fp for _, fp in rows})
    up = {fp: fp for fp in prints}

    def find(x):
        while up[x] != x:
            up[x] = up[up[x]]
            x = up[x]
        return x

    v = np.array(prints, np.uint64)
    for fp in prints:
        for other in v[np.bitwise_count(v ^ np.uint64(fp)) <= radius]:
            up[find(fp)] = find(int(other))
    least = {}
    for doc, fp in rows:
        r = find(fp)
        if doc is not None:
            least[r] = min(least.get(r, doc), doc)
    return {(doc, f"{fp:016x}", least.get(find(fp))) for doc, fp in rows}


def test_query_against_brute_force(spark, sf_dir):
    rows = [(r.doc_id, plain(r.text)) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()]
    got = [tuple(r)[:3] for r in queries.op7_simhash(spark, sf_dir).collect()]
    assert len(got) == len(rows) and set(got) == brute(rows)


@pytest.mark.parametrize("chunk", [16, 2048])
def test_links_against_brute_force(spark, monkeypatch, chunk):
    rng = np.random.default_rng(3)
    seeds = rng.integers(0, 1 << 63, 40, dtype=np.uint64)
    flip = lambda v, k: v ^ sum(1 << int(b) for b in rng.choice(64, k, replace=False))
    values = [int(s) for s in seeds] + [flip(int(rng.choice(seeds[:4])), int(rng.integers(1, 6))) for _ in range(600)] + [0, (1 << 64) - 1, 1 << 63]
    values = sorted(set(values))
    monkeypatch.setattr(simhash, "CHUNK", chunk)
    monkeypatch.setattr(simhash, "BATCH", 50)
    df = spark.createDataFrame([(v - (v >> 63 << 64),) for v in values], "fp long")
    roots = {r.node: r.root for r in common.components(simhash.links(df)).collect()}
    got = {}
    for v in values:
        s = v - (v >> 63 << 64)
        got.setdefault(roots.get(s, s), set()).add(v)
    want = {}
    for doc, _, least in brute([(i, v) for i, v in enumerate(values)]):
        want.setdefault(least, set()).add(values[doc])
    assert sorted(map(sorted, got.values())) == sorted(map(sorted, want.values()))


def test_components_of_paths_stars_and_rings(spark):
    rows = [(i, i + 1) for i in range(0, 300)] + [(1000, 1000 + i) for i in range(1, 200)] + [(2000 + i, 2000 + (i + 1) % 50) for i in range(50)] + [(5000, 5000)]
    out = {r.node: r.root for r in common.components(spark.createDataFrame(rows, "a long, b long")).collect()}
    assert len({out[i] for i in range(301)}) == 1
    assert len({out[1000 + i] for i in range(200)}) == 1
    assert len({out[2000 + i] for i in range(50)}) == 1
    assert len(set(out.values())) == 3 and 5000 not in out
    assert common.components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_edges(spark):
    rows = [(3, None, "x"), (2, "", "y"), (None, " \t", "z"), (5, "One two", "q"), (4, "one TWO", "q"), (4, "one TWO", "q"), (9, "é È w", "k")]
    df = spark.createDataFrame(rows, "doc_id long, text string, fingerprint string")
    out = [tuple(r) for r in simhash.simhash_components(df).collect()]
    assert len(out) == len(rows)
    assert set(out) == brute([(d, plain(t)) for d, t, _ in rows])
    assert simhash.simhash_components(df.limit(0)).count() == 0


def test_one_row_of_each_group(spark):
    words = [f"w{i}" for i in range(400)]
    text = lambda k: " ".join(words[k : k + 60])
    rows = [(5, text(0), 1), (5, text(100), 2), (7, text(200), 3), (7, text(200), 3), (7, text(200), 3), (8, text(100), 4), (3, text(200).upper(), 5), (None, text(0), 6), (None, text(300), 7), (None, text(300), 7), (9, None, 8), (2, "", 9), (2, "", 9)]
    df = spark.createDataFrame(rows, "doc_id long, text string, vellum_0 int").withColumnRenamed("vellum_0", "`a b")
    out = simhash.keep_one(df)
    assert out.columns == df.columns
    assert sorted(((r[0] or 0, r[2]) for r in out.collect())) == [(0, 7), (2, 9), (3, 5), (5, 1), (5, 2)]
    assert simhash.keep_one(df.limit(0)).count() == 0
    wide = spark.createDataFrame([(*r, 1, 2, 3) for r in rows], "doc_id long, text string, fp int, a int, first int, vellum_0 int")
    assert simhash.keep_one(wide).count() == 5
