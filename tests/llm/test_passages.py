import random

import numpy as np
import pytest

from vellum.llm import passages, queries


def brute(rows, least=50):
    """{doc_id: repeated spans} of (doc_id, text) rows with every stretch."""
    texts = {}
    for d, t in {(d, t) for d, t in rows if d is not None and t}:
        texts.setdefault(t, []).append(d)
    seen = {}
    for t in texts:
        words = t.encode().split()
        for i in range(len(words) - least + 1):
            seen.setdefault(tuple(words[i : i + least]), []).append((t, i))
    marks = {}
    for hits in seen.values():
        if len(hits) > 1:
            for t, i in hits:
                marks.setdefault(t, set()).add(i)
    out = []
    for t, docs in texts.items():
        n = len(t.encode().split())
        if n < least:
            continue
        spans = []
        for i in sorted(marks.get(t, ())):
            if spans and i <= spans[-1][1]:
                spans[-1][1] = i + least
            else:
                spans.append([i, i + least])
        if len(docs) > 1:
            spans = [[0, n]]
        out += [(d, tuple(map(tuple, spans))) for d in docs if spans]
    return sorted(out)


def got(df):
    rows = df.collect()
    for r in rows:
        assert r.n_repeated == sum(b - a for a, b in r.repeated) and r.n_removable == sum(b - a for a, b in r.removable)
        assert all(any(a <= x and y <= b for a, b in r.repeated) for x, y in r.removable)
    return sorted((r.doc_id, tuple(map(tuple, r.repeated))) for r in rows)


def test_query_against_brute_force(spark, sf_dir):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()]
    out = queries.op9_repeated_passages(spark, sf_dir)
    assert got(out) == brute(rows)


@pytest.mark.parametrize("least,chunk", [(10, 8192), (50, 8192), (10, 3), (50, 3)])
def test_planted_passages(spark, monkeypatch, least, chunk):
    monkeypatch.setattr(passages, "CHUNK", chunk)
    rng = random.Random(least)
    words = [f"w{i}" for i in range(3000)]
    parts = [rng.choices(words, k=rng.randrange(least - 2, least + 12)) for _ in range(8)]
    rows = []
    for i in range(80):
        body = rng.choices(words, k=rng.randrange(0, 200))
        for _ in range(rng.randrange(3)):
            at = rng.randrange(len(body) + 1)
            p = rng.choice(parts)
            a = rng.randrange(3)
            body[at:at] = p[a:]
        rows.append((i, " ".join(body)))
    rows += [(100, rows[3][1]), (101, "same " * 300), (102, "x same " * 80)]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    assert got(passages.repeated_passages(df, least=least)) == brute(rows, least)


def test_every_stretch_has_an_anchor_near_its_start():
    rng = random.Random(3)
    for least in (10, 23, 50):
        text = " ".join(rng.choices([f"w{i}" for i in range(rng.choice([2, 50]))], k=400))
        h = passages.Hashes(text)
        at = passages.anchors(h, least)
        width = passages.width_of(least)
        for s in range(h.n - least + 1):
            assert s <= at[s] < s + width and at[s] + least - width + 1 <= s + least


def test_edges(spark):
    long = " ".join(f"a{i}" for i in range(60))
    rows = [(1, None), (2, ""), (None, long), (3, "short text"), (4, long), (4, long), (5, "b " + long), (6, "only once " + " ".join(f"c{i}" for i in range(70)))]
    df = spark.createDataFrame([(*r, "x") for r in rows], "doc_id long, text string, place string")
    out = passages.repeated_passages(df)
    assert got(out) == brute(rows) == [(4, ((0, 60),)), (5, ((1, 61),))]
    assert sum(r.n_removable for r in out.collect()) == 60
    assert passages.repeated_passages(df.limit(0)).count() == 0


def test_one_id_with_two_texts_and_clashing_names(spark):
    a, b = (" ".join(f"{c}{i}" for i in range(70)) for c in "ab")
    rows = [(1, a, 5, "k"), (1, b, 5, "k"), (2, b + " tail", 5, "k"), (3, "x\x01y " + b, 6, "j")]
    df = spark.createDataFrame(rows, "doc_id long, text string, num long, key string")
    assert got(passages.repeated_passages(df)) == brute([r[:2] for r in rows])


def test_limits(spark):
    df = spark.createDataFrame([(1, "a b")], "doc_id long, text string")
    with pytest.raises(ValueError):
        passages.repeated_passages(df, least=3)
