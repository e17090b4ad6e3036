import numpy as np

from vellum.llm import decontaminate as dc
from vellum.llm import queries


def plain(pattern, text):
    """Least edits of the pattern to any stretch of the text."""
    last = [0] * (len(text) + 1)
    for i, x in enumerate(pattern, 1):
        row = [i]
        for j, y in enumerate(text, 1):
            row.append(min(row[-1] + 1, last[j] + 1, last[j - 1] + (x != y)))
        last = row
    return min(last)


def whole(a, b):
    last = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        row = [i]
        for j, y in enumerate(b, 1):
            row.append(min(row[-1] + 1, last[j] + 1, last[j - 1] + (x != y)))
        last = row
    return last[-1]


def test_best_match_is_exact():
    rng = np.random.default_rng(1)
    for _ in range(300):
        pattern = rng.integers(1, 5, rng.integers(1, 12)).tolist()
        text = rng.integers(0, 5, rng.integers(0, 30)).tolist()
        edits, begin, end = dc.best_match(pattern, text)
        assert edits == plain(pattern, text)
        assert whole(pattern, text[begin:end]) == edits


def edited(words, k, rng):
    row = list(words)
    for _ in range(k):
        kind, at = rng.integers(3), int(rng.integers(len(row)))
        word = f"new{rng.integers(1000)}" if rng.integers(2) else str(rng.choice(words))
        if kind == 0:
            row[at] = word
        elif kind == 1:
            row.insert(at, word)
        else:
            row.pop(at)
    return row


def test_recall_and_precision_against_brute_force():
    rng = np.random.default_rng(2)
    vocabulary = [f"w{i}" for i in range(400)]
    items = [(k, " ".join(rng.choice(vocabulary, rng.integers(6, 60)))) for k in range(60)]
    index = dc.Index(items, 0.8, 5)
    texts, planted = [], []
    for _ in range(400):
        k = int(rng.integers(60))
        words = items[k][1].split()
        body = list(rng.choice(vocabulary, rng.integers(0, 80)))
        at = int(rng.integers(len(body) + 1))
        body[at:at] = edited(words, int(rng.integers(0, index.most(len(words)) + 1)), rng)
        texts.append(" ".join(body))
        planted.append(k)
    found = index.search(texts)
    assert sum(k in {h[0] for h in hits} for k, hits in zip(planted, found)) >= 0.97 * len(planted)
    for text, hits in zip(texts, found):
        for item, n, edits, a, b in hits:
            words = text.split()
            assert edits <= index.most(n) and edits == whole(items[item][1].split(), words[a:b]) == plain(items[item][1].split(), words)


def test_query_finds_every_item_that_brute_force_finds(spark, sf_dir):
    items = {r.item_id: dc.words_of(r.text) for r in spark.read.parquet(f"{sf_dir}/benchmark.parquet").collect()}
    got = {(r.doc_id, r.item_id): r.edits for r in queries.op10_decontamination(spark, sf_dir).collect()}
    want = {}
    for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect():
        words = dc.words_of(r.text)
        known = set(words)
        for item, pattern in items.items():
            most = int(len(pattern) * 0.2 + 1e-9)
            if sum(w in known for w in pattern) >= len(pattern) - most:
                ids = {w: i for i, w in enumerate(dict.fromkeys(pattern), 1)}
                edits = dc.best_match([ids[w] for w in pattern], [ids.get(w, 0) for w in words])[0]
                if edits <= most:
                    want[r.doc_id, item] = edits
    assert got == want


def test_edges(spark, monkeypatch):
    text = "one two three four five six seven eight nine ten"
    docs = spark.createDataFrame([(1, None, "a"), (2, "", "b"), (None, text, "c"), (3, "x y " + text.upper() + "\n z", "d"), (3, "x y " + text.upper() + "\n z", "d"), (4, "one two three four five six seven eight nine", "e"), (5, "x " * 3000 + text, "f")], "doc_id long, text string, item_id string")
    items = spark.createDataFrame([(1, text), (2, text), (3, None), (4, ""), (5, "one two"), (None, "alpha beta gamma delta epsilon")], "item_id long, text string")
    out = dc.benchmark_matches(docs, items).collect()
    assert sorted(((r.doc_id or 0, r.item_id, r.edits) for r in out)) == sorted([(d, i, e) for d, e in ((0, 0), (3, 0), (3, 0), (4, 1), (5, 0)) for i in (1, 2)])
    monkeypatch.setattr(dc, "ITEMS", 2)
    assert dc.benchmark_matches(docs, items).count() == len(out)
    assert dc.benchmark_matches(docs, items.limit(0)).count() == 0
    assert dc.benchmark_matches(docs.limit(0), items).count() == 0


def test_sizes_that_miss_the_recall_are_searched_whole(monkeypatch):
    rng = np.random.default_rng(8)
    vocabulary = [f"w{i}" for i in range(300)]
    items = [(k, " ".join(rng.choice(vocabulary, n))) for k, n in enumerate((8, 30, 30, 120, 400))]
    found = dc.Index(items, 0.8, 5)
    assert all(s.recall >= dc.RECALL and s.least >= dc.LEAST_RECALL for s in found.sizes)
    monkeypatch.setattr(dc, "MOST_WALKS", 0)
    exact = dc.Index(items, 0.8, 5)
    assert all(not s.walks or s.recall >= dc.RECALL for s in exact.sizes) and any(not s.walks for s in exact.sizes)
    texts = []
    for k, text in items * 4:
        words = text.split()
        texts.append(" ".join([*rng.choice(vocabulary, 50), *edited(words, int(exact.most(len(words))), rng), *rng.choice(vocabulary, 20)]))
    assert all(k in {h[0] for h in hits} for (k, _), hits in zip(items * 4, exact.search(texts)))


def test_many_passes_and_clashing_names(spark, monkeypatch):
    rng = np.random.default_rng(9)
    items = [(k, " ".join(f"i{k}x{j}" for j in range(12))) for k in range(40)]
    docs = [(k, " ".join(rng.choice(["a", "b", "c"], 30)) + " " + items[k][1] + " tail", k, "t") for k in range(0, 40, 3)] + [(100, "a b c d e f", 1, "u"), (None, None, 2, "v")]
    df = spark.createDataFrame(docs, "doc_id long, text string, item_id int, edits string")
    bench = spark.createDataFrame(items, "item_id long, text string")
    monkeypatch.setattr(dc, "PASS_BYTES", 700)
    monkeypatch.setattr(dc, "ITEMS", 3)
    assert {(r.doc_id, r.item_id) for r in dc.benchmark_matches(df, bench).collect()} == {(k, k) for k in range(0, 40, 3)}
    clean = dc.keep_clean(df, bench)
    assert clean.columns == df.columns and {r.doc_id for r in clean.collect()} == {100, None}
