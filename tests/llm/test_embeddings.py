import math

import numpy as np
import pytest

from vellum.llm import embeddings, queries


def brute(ids, vectors, threshold=0.9):
    """{(vec_id, n_links, component_id)} with quadratic work."""
    good = [i for i, v in enumerate(vectors) if ids[i] is not None and v is not None and len(v) and all(x is not None and math.isfinite(x) for x in v) and any(v)]
    up = list(range(len(ids)))

    def find(x):
        while up[x] != x:
            up[x] = up[up[x]]
            x = up[x]
        return x

    count = [0] * len(ids)
    for dim in {len(vectors[i]) for i in good}:
        own = [i for i in good if len(vectors[i]) == dim]
        u = np.array([vectors[i] for i in own], float)
        square = (u * u).sum(axis=1)
        cos = u @ u.T / np.sqrt(square[:, None] * square[None, :])
        for r, i in enumerate(own):
            for c in np.flatnonzero(cos[r] >= threshold):
                if c != r:
                    count[i] += 1
                    up[find(i)] = find(own[c])
    seen = {}
    for i in good:
        if ids[i] in seen:
            up[find(i)] = find(seen[ids[i]])
        seen[ids[i]] = i
    least = {}
    for i in good:
        least[find(i)] = min(least.get(find(i), ids[i]), ids[i])
    return sorted(((ids[i], count[i], least[find(i)] if i in set(good) else ids[i]) for i in range(len(ids))), key=str)


def got(df):
    rows = df.collect()
    assert all(r.kept == (r.vec_id is not None and r.vec_id == r.component_id) for r in rows)
    return sorted(((r.vec_id, r.n_links, r.component_id) for r in rows), key=str)


@pytest.mark.parametrize("sf", ["sf0.01", "sf0.1"])
def test_query_against_brute_force(spark, sf):
    at = f"/root/testdata/{sf}"
    rows = spark.read.parquet(f"{at}/embeddings.parquet").collect()
    assert got(queries.op1_embedding_dedup(spark, at)) == brute([r.vec_id for r in rows], [r.embedding for r in rows])


@pytest.mark.parametrize("leaders,chunk,sample", [(4, 8, 1), (64, 1024, 64), (1, 50, 1)])
def test_crowds_rims_and_chains(spark, monkeypatch, leaders, chunk, sample):
    rng = np.random.default_rng(5)
    dim = 32
    monkeypatch.setattr(embeddings, "LEADERS", leaders)
    monkeypatch.setattr(embeddings, "CHUNK", chunk)
    monkeypatch.setattr(embeddings, "SAMPLE", sample)
    monkeypatch.setattr(embeddings, "BATCH", 64)
    monkeypatch.setattr(embeddings, "SHARED", 4)
    # with these settings no pair is lost, so that the rest is held to be exact
    monkeypatch.setattr(embeddings, "RECALL", 1 - 1e-7)
    monkeypatch.setattr(embeddings, "MISS", 1e-9)
    base = rng.normal(size=(60, dim))
    crowd = base[0] + rng.normal(size=(150, dim)) * 0.03
    rim = [base[0] * math.cos(a) + math.sin(a) * np.linalg.norm(base[0]) * (w := rng.normal(size=dim)) / np.linalg.norm(w) for a in np.linspace(0.1, 0.7, 60)]
    near = base[rng.integers(0, 60, 120)] + rng.normal(size=(120, dim)) * rng.uniform(0.02, 0.5, (120, 1))
    rows = [v.astype(np.float32).tolist() for v in [*base, *crowd, *rim, *near, base[3], base[3] * 2]]
    df = spark.createDataFrame([(i, v) for i, v in enumerate(rows)], "vec_id long, embedding array<float>")
    assert got(embeddings.embedding_components(df)) == brute(list(range(len(rows))), rows)


def test_recall_at_the_threshold():
    rng = np.random.default_rng(9)
    for dim, n, least in ((64, 50_000, 0.99), (16, 3_000_000, 0.98), (200, 1 << 34, 0.99)):
        x = embeddings.units(rng.normal(size=(2000, dim)))
        w = rng.normal(size=x.shape)
        w = embeddings.units(w - (w * x).sum(axis=1, keepdims=True) * x)
        y = 0.9 * x + math.sqrt(1 - 0.81) * w
        parts, count = embeddings.tables(n, 0.9)
        met = (embeddings.keys_of(x, parts, count) == embeddings.keys_of(y, parts, count)).any(axis=1)
        signs = np.bitwise_count((embeddings.signs_of(x) ^ embeddings.signs_of(y)).view(np.uint64)).sum(axis=1) <= embeddings.most_signs(0.9)
        assert met.mean() >= least and signs.mean() >= 0.997


def test_bounds_hold():
    rng = np.random.default_rng(6)
    x = embeddings.units(rng.normal(size=(400, 64)).tolist())
    x[200:] = embeddings.units((x[:200] + rng.normal(size=(200, 64)) * rng.uniform(0, 0.12, (200, 1))).tolist())
    codes = embeddings.Codes(64)
    turned = x @ embeddings.rotations(64, 1)
    code, own = codes.pack(turned)
    i, j = np.arange(200), np.arange(200, 400)
    cos = (x[i] * x[j]).sum(axis=1)
    for a, b in ((i, j), (j, i)):
        about, error = codes.estimate(code[a], own[b])
        assert (np.abs(about - cos) <= error).all() and abs((about - cos).mean()) < 0.02
    inner, off = codes.inner(own[i], own[j])
    assert (np.abs(inner - cos) <= off).all() and off.max() < 0.05


def test_edges(spark):
    nan, inf = float("nan"), float("inf")
    vectors = [None, [], [0.0, 0.0], [1.0, None], [1.0, nan], [inf, 1.0], [1.0, 2.0], [1.0, 2.0], [2.0, 4.1], [1.0, 2.0, 0.0], [-1.0, -2.0], [1.0, 2.0], [3.0], [-0.5, 9.0], [1.0, 2.05]]
    ids = [1, 2, 3, 4, 5, 6, 7, 8, 9, 10, 11, None, 12, 8, 8]
    df = spark.createDataFrame([(i, v, "x") for i, v in zip(ids, vectors)], "vec_id long, embedding array<double>, n_links string")
    assert got(embeddings.embedding_components(df)) == brute(ids, vectors)
    assert embeddings.embedding_components(df.limit(0)).count() == 0
    assert embeddings.embedding_components(df.limit(2)).count() == 2


def test_many_lengths_and_ties(spark):
    rng = np.random.default_rng(4)
    rows = [rng.normal(size=d).tolist() for d in range(1, 100) for _ in range(2)] + [[1.0, 0.0], [0.9, math.sqrt(1 - 0.81)], [9.0, 0.0], [3.0, 4.0], [4.0, 3.0]]
    df = spark.createDataFrame([(i, v, i, i) for i, v in enumerate(rows)], "vec_id long, embedding array<double>, num long, a long")
    assert got(embeddings.embedding_components(df)) == brute(list(range(len(rows))), rows)


def test_tables_share_no_keys():
    u = embeddings.units(np.random.default_rng(0).normal(size=(3000, 64)))
    for parts in ((64, 4), (64,), (64, 64, 2)):
        keys = embeddings.keys_of(u, parts, 5)
        each = [set(keys[:, t].tolist()) for t in range(5)]
        assert len(set.union(*each)) == sum(map(len, each)) and len(each[0]) > 100 and (keys & 255 == np.arange(5)).all()
        # a pair is fresh in the first of the tables where it meets, and there alone if that is an early one
        i, j = (np.repeat(np.arange(300), 300), np.tile(np.arange(300), 300))
        before = embeddings.met_before(keys).view(np.uint64)
        meets = keys[i] == keys[j]
        for t in range(5):
            early = meets[:, : min(t, embeddings.FIRST)].any(axis=1)
            got = embeddings.fresh(np.full(len(i), t), before[i], before[j])
            assert not got[early].any() and got[~early].mean() > 0.999
