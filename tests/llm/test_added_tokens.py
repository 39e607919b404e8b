"""Ids of texts that hold an added token, against the library as it comes."""

import zlib

import numpy as np
import pytest

P = pytest.importorskip("public_tokenizers")
from kindred.llm import packing, token_files  # noqa: E402
from kindred.llm.chunks import library_ids  # noqa: E402

HF = P.path("byte_bpe_50k.json")
TEXTS = ["a <|endoftext|> b", "plain text", "<|endoftext|>", "a<|endoftext|><|endoftext|>\n  b", "", "x  <|endoftext| > y", "<|endoftext|", "|> the end"]


@pytest.fixture(scope="module")
def library():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(HF)


def test_ids_are_those_of_the_unchanged_library(library):
    got = [np.frombuffer(x, "<u4").tolist() for x in library_ids(HF, TEXTS, added=True)]
    assert got == [library.encode(t, add_special_tokens=False).ids for t in TEXTS]
    assert got[0] == [64, 220, 50256, 275]


def test_queries_keep_added_tokens(spark, library, tmp_path):
    docs = spark.createDataFrame(list(enumerate(TEXTS)), "doc_id long, text string")
    ids = [library.encode(t, add_special_tokens=False).ids for t in TEXTS]
    files = token_files.read_token_files(token_files.write_token_files(docs, f"file://{tmp_path}/t", HF)).collect()
    assert {r.doc_id: r.ids_crc32 for r in files} == {i: zlib.crc32(np.array([*x, 0], "<u4").tobytes()) for i, x in enumerate(ids)}
    packed = packing.pack_sequences(docs, HF).collect()
    assert {r.doc_id: r.doc_tokens for r in packed} == {i: len(x) + 1 for i, x in enumerate(ids)}
