"""Power-of-two pieces: every id in one piece, against the library; the encoder's short cuts; odd tables."""

import random
import zlib

import numpy as np
import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from ripplemark.llm import packing

PATH = public_tokenizers.path("byte_bpe_50k.json")
TOK = Tokenizer.from_file(PATH)
ENCODER = packing.Encoder(PATH, 2)
BITS = list("ab Z1.,'s\n\t\r é\xa0　漢。，\x0b\x1c<|>ªµ×ɐΑ") + ["  ", "'ll", " don't", "<|endoftext|>", "’s", "漢字。かな", "٣", "𝔘", "Éß", "\n\n", " \n", " word", "word,", "12"]


def library(text):
    return TOK.encode(text, add_special_tokens=False).ids


@settings(max_examples=400, deadline=None)
@given(st.lists(st.sampled_from(BITS), max_size=30).map("".join), st.sampled_from([1, 3, 1 << 18]))
def test_encoder_equals_library(text, stretch):
    was, packing.STRETCH = packing.STRETCH, stretch
    try:
        assert np.frombuffer(ENCODER(text), "<u2").tolist() == library(text)
    finally:
        packing.STRETCH = was


@settings(max_examples=200, deadline=None)
@given(st.text(max_size=60))
def test_encoder_equals_library_on_any_text(text):
    assert np.frombuffer(ENCODER(text), "<u2").tolist() == library(text)


def test_memory_of_chunks_is_bounded():
    encoder, was = packing.Encoder(PATH, 2), packing.REMEMBERED
    packing.REMEMBERED = 50
    try:
        for i in range(400):
            text = f"w{'abcdefghij'[i % 10] * (i % 37 + 1)} x{'klm'[i % 3] * (i % 29)}, end\nline"
            assert np.frombuffer(encoder(text), "<u2").tolist() == library(text)
            assert len(encoder.words) <= 60 and len(encoder.known) <= 60
    finally:
        packing.REMEMBERED = was


@settings(deadline=None)
@given(st.integers(0, 5000), st.sampled_from([1, 2, 8, 1024]))
def test_lengths_are_binary(n, most):
    made = packing.lengths(n, most)
    assert sum(made) == n and made == sorted(made, reverse=True) and all(x & (x - 1) == 0 and x <= most for x in made)
    assert len([x for x in made if x < most]) == len({x for x in made if x < most}) == bin(n % most).count("1")


def checked(spark, rows, most=packing.MOST):
    df = spark.createDataFrame(rows, "doc_id long, text string, ids int, length string").repartition(3)
    got = packing.pack(df, "byte_bpe_50k.json", most=most).collect()
    assert sorted(r.sequence_id for r in got) == list(range(len(got)))
    by_length = sorted(got, key=lambda r: r.sequence_id)
    assert [r.length for r in by_length] == sorted(r.length for r in got)  # a bucket is a range
    want = sorted((-1 if i is None else i, s, n, len(ids), zlib.crc32(np.array(ids[s : s + n], "<u4").tobytes()), ids[s : s + n]) for i, t, *_ in rows for ids in [[*library(t or ""), 0]] for s, n in pieces(len(ids), most))
    assert sorted((-1 if r.doc_id is None else r.doc_id, r.start, r.length, r.doc_tokens, r.ids_crc32, np.frombuffer(r.ids, "<u2").tolist()) for r in got) == want
    assert all(r.offset == 0 for r in got)
    return got


def pieces(n, most):
    at = 0
    for length in packing.lengths(n, most):
        yield at, length
        at += length


def test_pieces_against_the_library(spark):
    rng = random.Random(4)
    words = ["The", "quick", "größe", "naïve,", "x1", "漢字", "<|endoftext|>", "\n"]
    rows = [(i, " ".join(rng.choice(words) for _ in range(rng.randint(0, 300))), 1, "x") for i in range(30)]
    rows += [(None, "null id", 1, None), (None, None, None, None), (3, rows[3][1], 1, "x"), (3, rows[3][1], 1, "x"), (99, "", 1, "")]
    rows += [(100, "word " * 30_000, 1, "x")]
    got = checked(spark, rows)
    assert sum(r.doc_id == 3 and r.start == 0 for r in got) == 3 and [r.length for r in got if r.doc_id == 99] == [1]
    checked(spark, rows, 8)


def test_no_documents_and_bad_lengths(spark):
    none = spark.createDataFrame([], "doc_id long, text string")
    assert packing.pack(none, "byte_bpe_50k.json").count() == 0 and packing.query(none).columns == ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"]
    with pytest.raises(ValueError, match="power of two"):
        packing.pack(none, "byte_bpe_50k.json", most=1000)
    assert packing.batches(packing.pack(none, "byte_bpe_50k.json"), 64).count() == 0


def test_batches_are_of_one_bucket(spark):
    packed = packing.pack(spark.createDataFrame([(i, "one two three " * (i % 23)) for i in range(60)], "doc_id long, text string"), "byte_bpe_50k.json", most=16)
    rows = packing.batches(packed, 32, seed=5).collect()
    assert len(rows) == packed.count() and len({(r.length, r.batch, r.slot) for r in rows}) == len(rows)
    for length in {r.length for r in rows}:
        own = [r for r in rows if r.length == length]
        each = max(1, 32 // length)
        assert all(r.slot < each for r in own) and {r.batch for r in own} == set(range(-(-len(own) // each)))
    other = {r.sequence_id: (r.batch, r.slot) for r in packing.batches(packed, 32, seed=6).collect()}
    assert other != {r.sequence_id: (r.batch, r.slot) for r in rows}
