import zlib

import numpy as np
import pytest

from vellum.llm import quality, queries, toxicity


def held(doc_id):
    return zlib.crc32(str(doc_id).encode()) % 5 == 0


def accuracy(spark, sf_dir, query, label, threshold):
    y = {r.doc_id: r[label] for r in spark.read.parquet(f"{sf_dir}/labels.parquet").collect()}
    rows = query(spark, sf_dir).collect()
    assert len(rows) == spark.read.parquet(f"{sf_dir}/documents.parquet").count()
    assert all(0 <= r.score <= 1 and r.predicted == int(r.score >= threshold) and r.held_out == held(r.doc_id) for r in rows)
    tried = [r for r in rows if r.held_out and r.doc_id in y]
    return sum(r.predicted == y[r.doc_id] for r in tried) / len(tried)


def test_held_out_accuracy(spark, sf_dir):
    assert accuracy(spark, sf_dir, queries.op3_quality, "quality", 0.3) >= 0.97
    assert accuracy(spark, sf_dir, queries.op5_toxicity, "toxic", 0.5) >= 0.95


def test_discriminant_equals_the_densities():
    rng = np.random.default_rng(1)
    d = len(quality.FEATURES)
    a, b = rng.normal(0, 1, (80, d)), rng.normal(1, 2, (120, d))
    model = quality.Discriminant([80.0, 120.0], [a.sum(0), b.sum(0)], [a.T @ a, b.T @ b])
    x = rng.normal(0.5, 1, (30, d))
    logs = []
    for k in (0, 1):
        cov = model.factors[k] @ model.factors[k].T
        z = x / model.scale - model.means[k]
        logs.append(np.log((80, 120)[k] + 1) - 0.5 * np.linalg.slogdet(cov)[1] - 0.5 * np.einsum("ij,jk,ik->i", z, np.linalg.inv(cov), z))
    assert np.allclose(model.score(x), 1 / (1 + np.exp(logs[0] - logs[1])))


@pytest.mark.parametrize("make,label", [(quality.quality_scores, "quality"), (toxicity.toxicity_scores, "toxic")])
def test_edges(spark, make, label):
    docs = spark.createDataFrame([(1, None, 3), (2, "", 1), (None, "x", 2), (4, "ok " * 30, 1), (4, "ok " * 30, 1), (5, "a" * 100_000, 1)], "doc_id long, text string, score long")
    for rows in ([], [(4, 1), (4, None), (None, 0), (9, 0)], [(4, 1), (5, 0), (2, 0), (1, 0)]):
        out = make(docs, spark.createDataFrame(rows, f"doc_id long, {label} int")).collect()
        assert len(out) == 6 and all(0 <= r.score <= 1 for r in out)
        assert sum(r.doc_id is None and not r.held_out for r in out) == 1
    assert make(docs.limit(0), spark.createDataFrame(rows, f"doc_id long, {label} int")).count() == 0


def test_folding():
    assert toxicity.fold("You 1d1ot, ІDIОT! m0r0n $cum 3rd 10.0.0.1 idiót i​diot THE!! ok") == " you idiot idiot moron scum erd idiot idiot the ok "
    assert toxicity.fold("") == "  "


def test_lexicon_learns_words_beginnings_and_exceptions(spark):
    rng = np.random.default_rng(2)
    plain = [f"w{i}" for i in "abcdefghijklmnopqrstuvwxyz"]
    text = lambda *extra: toxicity.fold(" ".join(rng.permutation([*rng.choice(plain, 20), *extra])))
    rows = [(text(rng.choice(["zolter", "grimvax", "grimvut"])), 1) for _ in range(60)] + [(text(), 0) for _ in range(300)]
    rows += [(toxicity.fold(" ".join(rng.choice(plain, 8)) + " zolter bridge " + " ".join(rng.choice(plain, 8))), 0) for _ in range(10)]
    rows += [(toxicity.fold("the copied sentence rarity"), 1)] * 12
    lexicon = toxicity.learn(spark.createDataFrame([(i, y, t) for i, (t, y) in enumerate(rows)], "row long, y int, folded string"))
    assert any(" grim".startswith(e) or e.startswith(" grim") for e in lexicon.weights)
    assert not any("rari" in e for e in lexicon.weights)
    assert " zolter bridge " in lexicon.exceptions
    hit = lambda t: lexicon.total(toxicity.fold(t))[1]
    assert hit("a GR1MVAX b") == 1 and hit("the zolter bridge") == 0 and hit("a zolter there") == 1


def scored_by_hand(texts, lexicon):
    """Scores with a word-by-word search for the entries."""
    out = {}
    for d, text in texts.items():
        words = toxicity.fold(text or "").split()
        total = n = 0
        for k, word in enumerate(words):
            own = [w for e, w in lexicon.weights.items() if e.strip() == word and e.endswith(" ") or not e.endswith(" ") and word.startswith(e.strip())]
            spared = any(f" {' '.join(words[max(0, i) : j])} " in lexicon.exceptions for i, j in ((k - 1, k + 1), (k, k + 2)) if i >= 0 and j <= len(words))
            if own and not spared:
                total, n = total + max(own), n + 1
        x = lexicon.slope * total / max(1, len(words)) ** 0.25 + lexicon.offset
        out[d] = (1 / (1 + np.exp(-x)), n)
    return out


def test_toxicity_query_against_a_word_by_word_search(spark, sf_dir):
    docs, labels = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("documents", "labels"))
    chosen = toxicity.training_rows(docs, labels, id_col="doc_id", text_col="text", label_col="toxic", most=toxicity.TRAIN_ROWS)
    lexicon = toxicity.learn(chosen)
    assert lexicon.weights and not any(" " in e.strip() for e in lexicon.weights)
    want = scored_by_hand({r.doc_id: r.text for r in docs.collect()}, lexicon)
    for r in queries.op5_toxicity(spark, sf_dir).collect():
        score, n = want[r.doc_id]
        assert r.n_entries == n and abs(r.score - score) < 1e-9 and r.predicted == int(r.score >= 0.5)


def test_quality_query_against_plain_densities(spark, sf_dir):
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()}
    y = {r.doc_id: r.quality for r in spark.read.parquet(f"{sf_dir}/labels.parquet").collect()}
    stats = {d: np.array(quality.statistics(t or "")) for d, t in texts.items()}
    own = [np.array([stats[d] for d in texts if y.get(d) == k and not held(d)]) for k in (0, 1)]
    means = [x.mean(axis=0) for x in own]
    scatter = [(x - m).T @ (x - m) for x, m in zip(own, means)]
    n, d = [len(x) for x in own], own[0].shape[1]
    pooled = (scatter[0] + scatter[1]) / (sum(n) - 2)
    scale = np.sqrt(np.maximum(np.diag(pooled), 1e-6))
    dens = []
    for k in (0, 1):
        weight = quality.POOL * (n[k] + 10 * d)
        cov = (scatter[k] / np.outer(scale, scale) + weight * pooled / np.outer(scale, scale)) / (n[k] + weight)
        cov = (1 - quality.RIDGE) * cov + quality.RIDGE * np.trace(cov) / d * np.eye(d)
        inv, logdet = np.linalg.inv(cov), np.linalg.slogdet(cov)[1]
        z = {i: (s - means[k]) / scale for i, s in stats.items()}
        dens.append({i: np.log((n[k] + 1) / (sum(n) + 2)) - 0.5 * (logdet + v @ inv @ v) for i, v in z.items()})
    for r in queries.op3_quality(spark, sf_dir).collect():
        want = 1 / (1 + np.exp(np.clip(dens[0][r.doc_id] - dens[1][r.doc_id], -700, 700)))
        assert abs(r.score - want) < 1e-6 and r.predicted == int(r.score >= 0.3)


def test_a_score_right_at_the_threshold_counts():
    lexicon = toxicity.Lexicon({}, set(), 0.0, 0.0)
    assert lexicon.score(lexicon.found(toxicity.fold("any"))[0]) == 0.5
    model = quality.Discriminant([0.0, 0.0], [np.zeros(8)] * 2, [np.zeros((8, 8))] * 2)
    assert model.score(np.zeros((1, 8)))[0] == 0.5
