import hashlib

import pytest
from pyspark.sql import functions as F

from vellum.llm import pieces, queries, wordpieces

ODD = ["", " ", "  a  b ", "▁x▁ y", "日本語 テスト\n\n emoji 😀👍🏽 ", "\t\x00a", "ﬁ ½ Å　b", "a" * 5000, "é ｱﾞ  x"]


@pytest.fixture(scope="module")
def codec():
    return pieces.Codec(pieces.default_model())


def test_ids_and_spans_equal_the_library(codec):
    ids = codec.encode(ODD)
    assert ids == codec.whole.encode(ODD, add_eos=True)
    for text, own in zip(ODD, ids):
        begin, end = codec.spans(text, own)
        theirs = codec.whole.encode(text, return_type="proto").pieces
        assert begin[:-1].tolist() == [p.begin for p in theirs]
        assert end[:-1].tolist() == [p.end for p in theirs]


@pytest.mark.parametrize("rule", ["nmt_nfkc", "nfkc_cf"])
@pytest.mark.parametrize("flags", [False, True])
def test_compiled_map_equals_the_library(rule, flags):
    import sentencepiece
    from sentencepiece import sentencepiece_model_pb2 as pb

    theirs = sentencepiece.SentencePieceNormalizer(rule_name=rule, add_dummy_prefix=flags, escape_whitespaces=flags, remove_extra_whitespaces=flags)
    model = pb.ModelProto()
    model.ParseFromString(theirs.serialized_model_proto())
    spec = model.normalizer_spec
    own = pieces.Normaliser(spec)
    for text in ODD:
        out, align = own.aligned(text)
        assert out.decode() == theirs.normalize(text)
        assert len(align) == len(out) + 1
        assert all(a <= b for a, b in zip(align, align[1:]))


def test_query_against_the_library(spark, sf_small):
    import sentencepiece

    tool = sentencepiece.SentencePieceProcessor(model_file=pieces.default_model())
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{sf_small}/documents.parquet").collect()}
    got = {r.doc_id: r for r in queries.op2_sentencepiece(spark, sf_small).collect()}
    assert got.keys() == texts.keys()
    for k, text in texts.items():
        ids = tool.encode(text, add_eos=True)
        assert got[k].n_tokens == len(ids)
        assert got[k].ids_sha256 == hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest()
        assert got[k].decoded_sha256 == hashlib.sha256(tool.decode(ids).encode()).hexdigest()
        assert got[k].n_bytes == len(text.encode())


def test_edges(spark):
    rows = [(1, None, "x"), (1, "", "y"), (None, "a b", None), (2, "a b", "z"), (2, "a b", "z")]
    df = spark.createDataFrame(rows, "doc_id long, text string, ids string")
    out = pieces.digest(pieces.encode_documents(df)).collect()
    assert sorted(r.n_tokens for r in out) == [1, 1, 3, 3, 3]
    assert sum(r.doc_id is None for r in out) == 1
    assert pieces.digest(pieces.encode_documents(df.limit(0))).count() == 0
    assert sorted(r.n_tokens for r in wordpieces.token_counts(df).collect()) == [0, 0, 2, 2, 2]
    assert wordpieces.token_counts(df.where(F.lit(False))).count() == 0


def greedy(word, first, later):
    at = n = 0
    have = first
    while at < len(word):
        stop = next((j for j in range(len(word), at, -1) if word[at:j] in have), None)
        if stop is None:
            return 1
        at, n, have = stop, n + 1, later
    return n


def test_counts_equal_greedy_longest_match(spark, sf_dir):
    first, later = wordpieces.vocabulary(pieces.default_model())
    small = wordpieces.LongestMatch({"a", "abc", "b"}, {"c", "cd", "d", "bcx"})
    for word in ("a", "abcd", "abcx", "abcdd", "x", "ab", "bcd", "bcdx", "abcccd"):
        assert small.count(word) == greedy(word, {"a", "abc", "b"}, {"c", "cd", "d", "bcx"}), word
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()}
    known = {}
    for r in queries.op6_token_counts(spark, sf_dir).collect():
        words = wordpieces.WORD.findall(texts[r.doc_id])
        assert r.n_words == len(words)
        assert r.n_tokens == sum(known.get(w) or known.setdefault(w, greedy(w, first, later)) for w in words)
