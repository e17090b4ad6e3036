import random

import pytest

from vellum.llm import licenses, queries


def brute(text, templates, share=0.8):
    """Templates with enough shingles in some stretch of twice their length."""
    words = licenses.words_of(text)
    parts = licenses.shingles(words)
    out = {}
    for name, (_, notice) in templates.items():
        own = licenses.words_of(notice)
        want = set(licenses.shingles(own))
        for i in range(len(parts)):
            if parts[i] in want:
                got = len(want & set(parts[i : i + 2 * len(own) - licenses.WORDS + 1])) / len(want)
                out[name] = max(out.get(name, 0), got)
    return {k: v for k, v in out.items() if v >= share}


def test_query_against_brute_force(spark, sf_dir):
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()}
    got = {(r.doc_id, r.template): r.containment for r in queries.op8_licenses(spark, sf_dir).collect()}
    want = {(d, k): v for d, t in texts.items() for k, v in brute(t, licenses._default()).items()}
    assert got == pytest.approx(want)


def test_edited_notices_are_found():
    rng = random.Random(1)
    tool = licenses.Scanner(tuple((k, t) for k, (_, t) in licenses.TEMPLATES.items()), 0.8)
    filler = [f"x{i}" for i in range(500)] + ["the", "of", "under", "license", "software", "is"]
    seen = tried = 0
    for _ in range(300):
        name, (_, notice) = rng.choice(list(licenses.TEMPLATES.items()))
        own = notice.split()
        if len(own) > 30:
            own[rng.randrange(len(own))] = "changed"
        text = " ".join([*rng.choices(filler, k=rng.randrange(200)), *own, *rng.choices(filler, k=rng.randrange(200))])
        want = brute(text, licenses.TEMPLATES)
        got = {k: s for k, s, _, _ in tool.scan(text)}
        assert all(want[k] >= s - 1e-9 for k, s in got.items())
        tried += len(want)
        seen += len(want.keys() & got.keys())
    assert seen >= 0.995 * tried


def test_edges(spark):
    notice = "Released under the MIT License."
    df = spark.createDataFrame([(1, None, "a"), (2, "", "b"), (None, notice, "c"), (3, "x " * 40_000 + notice.upper(), "d"), (3, "x " * 40_000 + notice.upper(), "d"), (4, "Released under the", "e")], "doc_id long, text string, license string")
    out = sorted((r.doc_id or 0, r.template, r.license, r.containment, r.begin, r.end) for r in licenses.license_matches(df).collect())
    assert out == [(0, "mit-notice", "MIT", 1.0, 0, 5)] + [(3, "mit-notice", "MIT", 1.0, 40_000, 40_005)] * 2
    assert licenses.license_matches(df.limit(0)).count() == 0
    with pytest.raises(ValueError):
        licenses.license_matches(df, {"a": ("A", "too short")})


def test_whole_texts_are_found_in_files(spark):
    whole = {k: t for k, (_, t) in licenses._default().items() if k.endswith("-whole")}
    rng = random.Random(5)
    rows = []
    for i, (k, text) in enumerate(whole.items()):
        words = text.split()
        for _ in range(len(words) // 60):
            words[rng.randrange(len(words))] = "changed"
        rows.append((i, "Copyright (c) the authors of this work\n" * 3 + " ".join(words) + " and more " * 30))
    df = spark.createDataFrame([(*r, "c") for r in rows], "doc_id long, text string, template string")
    found = {}
    for r in licenses.license_matches(df).collect():
        found.setdefault(r.doc_id, {})[r.template] = r.containment
    assert all(found[i].get(k, 0) >= 0.8 for i, k in enumerate(whole))


def test_a_share_right_at_the_threshold_counts():
    words = [f"t{i}" for i in range(24)]  # 20 shingles
    tool = licenses.Scanner((("t", " ".join(words)),), 0.8)
    assert [round(s, 9) for _, s, _, _ in tool.scan("a b " + " ".join(words[:20]) + " c")] == [0.8] and not tool.scan(" ".join(words[:19]))
