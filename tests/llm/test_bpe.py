"""BPE against the published library."""

import random

import public_tokenizers
import pytest
from tokenizers import Tokenizer

from riskloom.llm import bpe

PATH = public_tokenizers.path("byte_bpe_50k.json")


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(PATH)


def texts():
    rnd = random.Random(7)
    pools = [lambda: rnd.randrange(32, 127), lambda: rnd.randrange(1, 0x250), lambda: rnd.randrange(0x400, 0x3000), lambda: 0x20, lambda: 0x0A, lambda: rnd.randrange(0x1F300, 0x1F600)]
    out = ["".join(chr(rnd.choice(pools)()) for _ in range(rnd.randrange(60))) for _ in range(500)]
    return [*out, "", " ", "  \n\t x", "a<|endoftext|>b <|endoftext|>", "I'll we've 'S don't", "x" * 3000, "ab" * 2000, " 　　y\x1c\x1c z\x85 k"]


def test_codec_matches_library(library):
    codec = bpe.Codec(PATH)
    own = texts()
    for text, raw in zip(own, codec.encode_batch(own), strict=True):
        ids = memoryview(raw).cast("i").tolist() if raw else []
        assert ids == library.encode(text, add_special_tokens=False).ids
        assert codec.decode(ids) == text


def test_long_word_equals_matrix(monkeypatch, library):
    word = "".join(random.Random(1).choice("abcdethion") for _ in range(90))
    codec = bpe.Codec(PATH)
    short = codec.encode_words([word])[word]
    monkeypatch.setattr(bpe, "SHORT", 10)
    assert codec.encode_words([word])[word] == short


def test_cache_generations(monkeypatch, library):
    monkeypatch.setattr(bpe, "CACHED", 5)
    codec = bpe.Codec(PATH)
    for text in ["one two three four five six seven", "two nine ten seven", "one eleven"] * 3:
        assert memoryview(codec.encode_batch([text])[0]).cast("i").tolist() == library.encode(text, add_special_tokens=False).ids


def test_frames(spark, library):
    df = spark.createDataFrame([(1, "a b", "clash"), (1, "a b", "clash"), (2, None, None), (None, "", "x")], "doc_id long, text string, ids string")
    got = bpe.decode(bpe.encode(df, PATH), PATH).collect()
    a, b = library.encode("a b", add_special_tokens=False).ids
    assert sorted((str(r.doc_id), list(r.ids), r.decoded) for r in got) == [("1", [a, b], "a b"), ("1", [a, b], "a b"), ("2", [], ""), ("None", [], "")]
    digests = bpe.round_trip(df, PATH).collect()
    assert {(r.doc_id, r.n_tokens) for r in digests} == {(1, 2), (2, 0), (None, 0)}
    assert bpe.round_trip(df.limit(0), PATH).count() == 0
    bad = spark.createDataFrame([(1, [128, 50256])], "doc_id long, ids array<int>")
    assert bpe.decode(bad, PATH).first().decoded == library.decode([128, 50256], skip_special_tokens=False)
