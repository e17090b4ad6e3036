import hashlib
import zlib

import numpy as np
import sentencepiece

import __spark_entry__
import corpus_pipeline
from tests.llm.test_simhash import brute, plain
from vellum.llm import common, decontaminate, pieces, pii, quality


def by_hand(docs, labels, items):
    """The pipeline's rows, one document after the other."""
    stats = {d: quality.statistics(t) for d, t in docs.items()}
    learned = [(stats[d], y) for d, y in labels if d in docs and y in (0, 1) and zlib.crc32(str(d).encode()) % 5]
    x = [np.array([s for s, y in learned if y == k]) for k in (0, 1)]
    model = quality.Discriminant([float(len(a)) for a in x], [a.sum(0) for a in x], [a.T @ a for a in x])
    docs = {d: t for d, t in docs.items() if model.score(np.array([stats[d]]))[0] >= 0.3}
    docs = {d: docs[d] for d, _, c in brute([(d, plain(t)) for d, t in docs.items()]) if d == c}
    index = decontaminate.Index(items, 0.8, 5)
    docs = {d: t for d, t in docs.items() if not index.search([t])[0]}
    cands = {d: [(k, a, b, base, pii.pattern_of(t, k, a, b, base)) for k, a, b, base in pii.found(t)] for d, t in docs.items()}
    counts = {}
    for rows in cands.values():
        for *_, p in rows:
            counts[p] = counts.get(p, 0) + 1
    spans = pii.SpanModel(counts)
    docs = {d: pii.redacted(t, [(pii.KINDS[k], a, b) for k, a, b, base, p in cands[d] if base or spans.accepts(p)]) for d, t in docs.items()}
    tool = sentencepiece.SentencePieceProcessor(model_file=pieces.default_model())
    return {(d, len(i := tool.encode(t, add_eos=True)), hashlib.sha256(" ".join(map(str, i)).encode()).hexdigest()) for d, t in docs.items()}


def test_rows_against_brute_force(spark, sf_small):
    read = lambda name: spark.read.parquet(f"{sf_small}/{name}.parquet").collect()
    want = by_hand({r.doc_id: r.text for r in read("documents")}, [(r.doc_id, r.quality) for r in read("labels")], [(r.item_id, r.text) for r in read("benchmark")])
    got = corpus_pipeline.run(spark, sf_small).collect()
    assert {(r.doc_id, r.n_tokens, r.ids_sha256) for r in got} == want and len(got) == len(want)
    assert "pipeline" in __spark_entry__.queries()


def test_stages_keep_columns_and_odd_rows(spark, sf_small):
    docs = spark.read.parquet(f"{sf_small}/documents.parquet")
    odd = spark.createDataFrame([(None, None, "en", "s", 0), (None, "", "en", "s", 0), (7_000_000, None, None, None, None), (7_000_001, "", "en", "s", 0), (7_000_002, "mail me@x.com now", "en", "s", 17), (7_000_002, "mail me@x.com now", "en", "s", 17)], docs.schema)
    docs = docs.unionByName(odd)
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = common.stored(stage(spark, docs, sf_small), name)
        assert docs.columns == ["doc_id", "text", "lang", "source", "n_chars"]
    rows = {r.doc_id: r for r in docs.collect()}
    assert rows[7_000_002].text == "mail <EMAIL> now" and rows[7_000_002].n_chars == 16
    assert docs.where("doc_id = 7000002").count() == 1
    empty = spark.createDataFrame([], docs.schema)
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, empty, sf_small).count() == 0


def test_stages_with_clashing_names_one_id_with_two_texts_and_long_texts(spark, sf_small):
    docs = spark.read.parquet(f"{sf_small}/documents.parquet").limit(60)
    prose = [r.text for r in docs.where("lang = 'en' AND n_chars > 400").limit(3).collect()]
    long = " ".join(prose[0].split() * 400)
    odd = spark.createDataFrame([(8_000_000, prose[1] + " and so on", "en", "s", 1), (8_000_000, "Of other things there is this to say: " + prose[2][:300], "en", "s", 2), (8_000_001, long, "en", "s", 3), (8_000_002, "token = \"" + "q7Zk" * 2000 + "\" " + prose[2], "en", "s", 4)], docs.schema)
    docs = docs.unionByName(odd)
    names = ("vellum_0", "vellum_1", "label", "quality", "y", "stats", "cands", "fp", "a", "first", "root", "item_id", "spans", "held_out", "score")
    docs = docs.select("*", *[docs.doc_id.alias(n) for n in names])
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = common.stored(stage(spark, docs, sf_small), name)
        assert docs.columns[-len(names) :] == list(names)
        rows = docs.collect()
        assert all(all(r[n] == r.doc_id for n in names) for r in rows)
    kept = [r.text for r in rows if r.doc_id == 8_000_000]
    assert len(kept) == len(set(kept)) and all("q7Zk" not in r.text for r in rows)
    assert corpus_pipeline.STAGES[-1][1](spark, docs, sf_small).count() == len(rows)


def test_tokens_are_projected_to_their_source(spark, monkeypatch):
    seen = []
    monkeypatch.setattr(pieces, "digest", lambda df: seen.append(df) or df)
    texts = ["Zwei Wörter", "", None, "a\u0000\u2603b"]
    corpus_pipeline.tokens(spark, spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), "")
    rows = seen[0].collect()
    assert len(rows) == 4
    for r in rows:
        size = len((texts[r.doc_id] or "").encode())
        assert len(r.begins) == len(r.ends) == len(r.ids) and r.begins[0] == 0 and r.ends[-1] == r.n_bytes == size
