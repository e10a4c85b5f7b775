"""Ids of texts with an added token's string, against a tokenizer loaded afresh."""

import zlib

import numpy as np
import pytest
from tokenizers import Tokenizer

from recordweave.llm import bpe, packing, token_orc
from recordweave.llm.common import shared_dir

TEXTS = ["a <|endoftext|> b", "<|endoftext|>", "x<|endoftext|><|endoftext|>\n y's", "<|endoftext |> <|ENDOFTEXT|>", "plain text", "é ½ <|endoftext|>", ""]


@pytest.fixture(scope="module")
def want():
    fresh = Tokenizer.from_file(bpe.default_path())
    return [fresh.encode(t, add_special_tokens=False).ids for t in TEXTS]


def test_encoder(want):
    assert 50256 in want[0]
    assert [np.frombuffer(x, "<u4").tolist() for x in bpe.Encoder(bpe.default_path()).encode_many(TEXTS)] == want


def test_token_files_and_sequences(spark, want):
    docs = spark.createDataFrame(list(enumerate(TEXTS)), "doc_id long, text string")
    path = shared_dir(spark, "special")
    token_orc.write(docs, path, end_id=2, partitions=2)
    got = {r.doc_id: (r.n_tokens, r.ids_crc32) for r in token_orc.checksums(token_orc.read(spark, path)).collect()}
    assert got == {i: (len(x) + 1, zlib.crc32(np.array([*x, 2], "<u4").tobytes())) for i, x in enumerate(want)}
    assert {r.doc_id: r.doc_tokens for r in packing.pack(docs).collect()} == {i: len(x) + 1 for i, x in enumerate(want)}
