import hashlib
import struct

import numpy as np
import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from unifold.llm import bpe, storage, tokens

WORD, BYTE = public_tokenizers.path("word_bpe_49k.json"), public_tokenizers.path("byte_bpe_50k.json")
PARTS = ["the", "an", "  ", "\n", "é", "É", "İ", "Σ", "'s", "'ll", "<|endoftext|>", "<|startoftext|>", "12", "½", "ſ", "×", "don't", "$$$", "\xa0", "\x1c", "日本", "aaaa", "ß", "̸", "=", "ing", "\r\n"]
texts = st.lists(st.sampled_from(PARTS), max_size=60).map("".join)


@pytest.fixture(scope="module")
def encoders():
    text = bpe.load(WORD)
    full = Tokenizer.from_file(WORD)
    full.no_padding()
    full.no_truncation()
    return tokens.Encoder(text, leaf=64, long=16, window=8), tokens.Encoder(text), full


def packed(xs):
    b = [x.encode() for x in xs]
    return np.frombuffer(b"".join(b), np.uint8), np.cumsum([0, *map(len, b)])


@settings(max_examples=60, deadline=None)
@given(xs=st.lists(texts, min_size=1, max_size=4))
def test_encoding_is_the_librarys(encoders, xs):
    small, usual, full = encoders
    for e in (small, usual):
        ids = e.encode(*packed(xs))
        for x, a, b in zip(xs, ids, e.decode(ids), strict=True):
            want = full.encode(x, add_special_tokens=False).ids
            assert a.tolist() == want
            assert b.decode() == full.decode(want, skip_special_tokens=False)


@pytest.mark.parametrize("word", ["ab" * 400, "z" * 999, "thing" * 300 + "!!" * 90, "é" * 700])
def test_long_words_go_through_the_tree(encoders, word):
    small, _, full = encoders
    assert small.encode(*packed([word]))[0].tolist() == full.encode(word, add_special_tokens=False).ids


@settings(max_examples=60, deadline=None)
@given(x=texts)
def test_counts_are_the_librarys(x):
    c = tokens.held(tokens.Counter, bpe.load(BYTE))
    assert c.count(*packed([x, "a"])).tolist() == [len(Tokenizer.from_file(BYTE).encode(x, add_special_tokens=False).ids), 1]


def test_odd_documents(spark, odd_documents):
    full = Tokenizer.from_file(WORD)
    full.no_padding()
    full.no_truncation()
    rows = tokens.encode(odd_documents, WORD).collect()
    assert len(rows) == odd_documents.count() and set(odd_documents.columns) < set(rows[0].asDict())
    for r in rows:
        want = full.encode(r.text or "", add_special_tokens=False).ids
        assert bytes(r.ids) == struct.pack(f"<{len(want)}I", *want)


def test_cache_encodes_only_what_it_lacks(spark, odd_documents):
    cache = storage.new_path(spark, "test-cache")
    full = Tokenizer.from_file(BYTE)
    for n in (1, 2):
        got = tokens.count_tokens(odd_documents, BYTE, cache).collect()
        assert len(got) == odd_documents.count()
        assert spark.read.parquet(cache).count() == odd_documents.select(F.coalesce("text", F.lit(""))).distinct().count(), n
    by = {r.doc_id: r for r in got}
    assert by[3].n_tokens == by[4].n_tokens == 0
    assert by[1].n_tokens == len(full.encode(odd_documents.where("doc_id = 1").first().text).ids)
    more = spark.createDataFrame([(50, "a new text")], "doc_id long, text string")
    before = spark.read.parquet(cache).count()
    tokens.count_tokens(more, BYTE, cache).collect()
    assert spark.read.parquet(cache).count() == before + 1


def test_empty_table(spark):
    empty = spark.createDataFrame([], "doc_id long, text string")
    assert tokens.encode(empty, WORD).count() == 0
    assert tokens.count_tokens(empty, BYTE, storage.new_path(spark, "empty")).count() == 0


def test_digests_of_query(spark, sf):
    r = tokens.op6_bpe_codec(spark, sf).where("doc_id = 0").first()
    text = spark.read.parquet(f"{sf}/documents.parquet").where("doc_id = 0").first().text
    full = Tokenizer.from_file(WORD)
    full.no_padding()
    full.no_truncation()
    ids = full.encode(text, add_special_tokens=False).ids
    assert r.ids_sha256 == hashlib.sha256(struct.pack(f"<{len(ids)}I", *ids)).hexdigest()
    assert r.decoded_sha256 == hashlib.sha256(full.decode(ids, skip_special_tokens=False).encode()).hexdigest()
