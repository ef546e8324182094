"""BPE encoding and decoding against the vocabulary's own library."""

from __future__ import annotations

import hashlib
from collections import Counter

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from hypothesis import given as drawn
from hypothesis import settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from docspark.llm import bpe
from docspark.llm.plans import QUERIES

FOLDER = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(public_tokenizers.path(bpe.FILE))


@pytest.fixture(scope="module")
def codec():
    return bpe.Codec(bpe.definition())


def ids_of(codec, texts):
    batch = pa.RecordBatch.from_arrays([pa.array(range(len(texts))), pa.array(texts, type=pa.string())], names=["doc_id", "text"])

    class Shared:
        value = {"codec": codec}

    return [x for out in bpe._encode(Shared)(iter([batch])) for x in out.column(1).to_pylist()]


#: Characters at which pre-tokens, contractions, white space and added tokens begin and end.
ODD = st.lists(st.sampled_from(list(" \t\n\r\x0b\x1c\x85\xa0     　﻿'’sStrevmldaqXzZ019²½½#!?<|>endoftxé¿Â日本語😀́") + ["<|endoftext|>", "'s", "'ll", "  "]), max_size=60).map("".join)


@settings(max_examples=800, deadline=None)
@drawn(st.lists(ODD, min_size=1, max_size=6))
def test_ids_of_odd_texts(library, codec, texts):
    assert ids_of(codec, texts) == [library.encode(t, add_special_tokens=False).ids for t in texts]


@settings(max_examples=200, deadline=None)
@drawn(st.lists(st.text(max_size=80), min_size=1, max_size=4))
def test_ids_of_any_text(library, codec, texts):
    assert ids_of(codec, texts) == [library.encode(t, add_special_tokens=False).ids for t in texts]


def test_pieces_inside_a_long_text(library, codec, monkeypatch):
    texts = ["word, " * 700, "", "x" * 900, "né ë 日本語 'll " * 300, "   \n " * 200, "", "end"]
    want = [library.encode(t, add_special_tokens=False).ids for t in texts]
    for size in (1, 7, 64, 1000):
        monkeypatch.setattr(bpe, "PIECE", size)
        assert ids_of(codec, texts) == want


def test_boundaries_are_no_pairs_of_tokens(codec):
    table = codec.certain.reshape(256, 256)
    assert table.any()
    for t in codec.tokens:
        for a, b in zip(t, t[1:]):
            assert not table[a, b]


def test_decoding_any_ids(library, codec):
    rng = np.random.default_rng(5)
    lists = [rng.integers(0, len(codec.tokens), size=n).tolist() for n in (0, 1, 5, 60, 400)] + [[50256, 50256, 220], [7, 10**6, -1, 8]]
    flat = np.array([i for own in lists for i in own], dtype=np.int64)
    got = codec.decode(flat, np.cumsum([0, *map(len, lists)]))
    assert got == [library.decode([i for i in own if 0 <= i < 50257], skip_special_tokens=False) for own in lists]


def test_awkward_rows(awkward, given, nothing, library):
    out = bpe.decode(bpe.encode(awkward)).collect()
    want = [(d, tuple(library.encode(t or "", add_special_tokens=False).ids), t or "") for d, t, _ in given]
    assert Counter((r["doc_id"], tuple(r["ids"]), r["text"]) for r in out) == Counter(want)
    assert bpe.decode(bpe.encode(nothing)).count() == 0


def test_decoding_missing_ids(spark):
    rows = spark.createDataFrame([(1, None), (2, []), (None, [15496, None, 995])], "doc_id bigint, ids array<int>")
    assert Counter((r["doc_id"], r["text"]) for r in bpe.decode(rows).collect()) == Counter([(1, ""), (2, ""), (None, "Hello world")])


def test_query(spark, library):
    def sha(x):
        return hashlib.sha256(x.encode()).hexdigest()

    want = {}
    for r in spark.read.parquet(f"{FOLDER}/documents.parquet").collect():
        ids = library.encode(r["text"] or "", add_special_tokens=False).ids
        want[r["doc_id"]] = (len(ids), sha(",".join(map(str, ids))), sha(library.decode(ids, skip_special_tokens=False)))
    assert {r["doc_id"]: tuple(r)[1:] for r in QUERIES["op13_bpe_codec"](spark, FOLDER).collect()} == want
