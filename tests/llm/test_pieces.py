"""N-best pieces against brute force and against the library's own unigram search on the same pieces."""

import zlib

import numpy as np
import public_tokenizers
import pytest
import sentencepiece
from pyspark.sql import functions as F
from sentencepiece import sentencepiece_model_pb2 as pb

from glyphmill.llm import pieces
from glyphmill.llm.pieces import Codec, decode, encode

PATH = public_tokenizers.path("piece_bpe_32k.model")
TEXTS = ["Hello  world, this is\nfine.", "a", " ", "漢字 é \u0000x", "thandble erth " * 40, "aaaaaaaaaaaaaaaa", "no-such_word!!!  \t", ""]


@pytest.fixture(scope="module")
def codec():
    return Codec(PATH, 4)


def brute(codec, text):
    ways = [[] for _ in range(len(text) + 1)]
    ways[0] = [(0.0, ())]
    for end in range(1, len(text) + 1):
        ways[end] = [(s + score, ids + more) for start, more, score in codec.lattice(text, end) for s, ids in ways[start]]
    return sorted((s for s, _ in ways[-1]), reverse=True)


@pytest.mark.parametrize("text", ["thand", "a b", "▁▁in the", "erblex", "漢a"])
def test_scores_equal_brute_force(codec, text):
    want = brute(codec, codec.normalized(text))[:4]
    got = codec.encode(text)
    assert [s for s, _ in got] == want
    assert len({ids.tobytes() for _, ids in got}) == len(got)


def test_whole_text_composes_its_stretches(codec):
    text = "than the oner"
    normal = codec.normalized(text)
    assert [s for s, _ in codec.search(normal)] == [s for s, _ in codec.encode(text)]


def test_agrees_with_the_library(codec):
    model = pb.ModelProto()
    model.ParseFromString(open(PATH, "rb").read())
    model.trainer_spec.model_type = 1
    other = sentencepiece.SentencePieceProcessor(model_proto=model.SerializeToString())
    score = lambda ids: sum(model.pieces[i].score for i in ids)
    for text in TEXTS[:1] + ["thandble erth the onin"]:
        plain = text.replace("\n", " ").replace("  ", " ")
        want = [score(ids) for ids in other.nbest_encode_as_ids(plain, 4)]
        assert [s for s, _ in codec.encode(plain)] == pytest.approx(want, rel=1e-6)


@pytest.mark.parametrize("text", TEXTS)
def test_round_trip(codec, text):
    for _, ids in codec.encode(text):
        assert codec.decode(ids) == text


def test_ids_decode_as_in_the_library(codec):
    lib = sentencepiece.SentencePieceProcessor(model_file=PATH)
    for text in TEXTS:
        ids = codec.encode(text)[0][1]
        assert lib.decode([int(i) for i in ids]) == codec.decode(ids)


def test_tables(spark):
    rows = [(1, "the one", "x"), (2, None, None), (2, None, None), (3, "", "y"), (None, "long " * 30_000, "z")]
    df = spark.createDataFrame(rows, "doc_id long, text string, Score string").withColumn("extra", F.col("Score"))
    got = encode(df, PATH)
    assert got.columns[:3] == ["doc_id", "extra", "n_pieces"]  # the input's own Score gives way
    out = {(r.doc_id, r.extra): r for r in got.collect()}
    assert len(got.collect()) == 5 and all(r.round_trip for r in out.values())
    assert out[2, None].n_pieces == 0 and out[2, None].nbest_scores == [0.0]
    assert all(zlib.crc32(np.array(r.ids, "<u4").tobytes()) == r.ids_crc32 and r.score == r.nbest_scores[0] for r in out.values())
    back = {r.doc_id: r.text for r in decode(got.select("doc_id", "ids", F.lit("own").alias("text")), PATH).collect()}
    assert back[1] == "the one" and back[None] == "long " * 30_000
    assert encode(df.where("false"), PATH).count() == 0


def test_batches_equal_single_searches(codec, monkeypatch):
    """All stretches in step, remembered or not, long or short: the same as one search after the other."""
    rng = np.random.default_rng(4)
    letters = list("abcdefgthein  .,é漢\n1")
    texts = ["".join(rng.choice(letters, n)) for n in rng.integers(0, 60, 80)] + ["ab" * 400, "", None, "\U0001f600 x\u0301"]
    want = [codec.encode_alone(t or "") if t else [(0.0, np.zeros(0))] for t in texts]
    for most, step in ((400_000, 256), (30, 256), (400_000, 3)):
        monkeypatch.setattr(pieces, "MOST_IN_STEP", step)
        monkeypatch.setattr(codec.parts, "most", most)
        codec.parts.clear()
        for _ in range(2):
            got = list(codec.encode_many(texts))
            assert [[s for s, _ in g] for g in got] == [[s for s, _ in w] for w in want]
            assert all(g[0][1].tolist() == w[0][1].tolist() for g, w in zip(got, want, strict=True))


def test_a_false_memory_is_searched_again(codec):
    """Should two stretches share a hash, the text does not decode to itself and is searched without hashes."""
    codec.parts.clear()
    want = codec.encode("other words")
    codec.parts.flat[:] = codec.pieces["x"][0]
    assert codec.decode(codec.encode("other words")[0][1]) != "other words"
    ways, back = next(codec.encode_surely(["other words"]))
    assert back == "other words" and [s for s, _ in ways] == [s for s, _ in want]
    codec.parts.clear()
