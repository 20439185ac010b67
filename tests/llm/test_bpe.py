import hashlib

import numpy as np
import pytest
from hypothesis import given, settings, strategies as st

from tallyledger.llm.bpe import RankArrayBPE, encode_documents, public_vocabulary

tokenizers = pytest.importorskip("tokenizers")
PATH = public_vocabulary()


@pytest.fixture(scope="module")
def pair():
    return RankArrayBPE(PATH), tokenizers.Tokenizer.from_file(PATH)


@settings(max_examples=300, deadline=None)
@given(st.text() | st.text(st.sampled_from("aeth 's\n\t<|endoftext|>.12é　\x1c\x85")))
def test_equals_the_public_library(pair, text):
    own, public = pair
    ids = public.encode(text, add_special_tokens=False).ids
    assert own.encode(text) == ids
    assert own.decode(ids) == public.decode(ids, skip_special_tokens=False)


@pytest.mark.parametrize("text", ["a" * 900, "ab" * 800 + "é", " " * 700 + "x", "thethe" * 200, "x<|endoftext|><|endoftext|> y"])
def test_long_words_and_special_tokens(pair, text):
    assert pair[0].encode(text) == pair[1].encode(text, add_special_tokens=False).ids


def test_matrix_scan_and_heap_agree(pair):
    own = pair[0]
    for word in ("lowercase", "Überraschung", "ththth", "   ", "1234567890" * 6):
        raw = word.encode()
        assert own.merge_word(raw) == own._merge_long(raw)
        if len(raw) <= 64:
            assert own.merge_word(raw) == np.frombuffer(own._merge_matrix([raw], 64)[0], "<u4").tolist()


def test_broken_bytes_decode_like_the_library(pair):
    ids = pair[1].encode("é😀", add_special_tokens=False).ids[1:]
    assert pair[0].decode(ids) == pair[1].decode(ids, skip_special_tokens=False)
    assert pair[0].decode([]) == ""


def test_table(spark, documents, corpus, no_documents, pair):
    outputs = ("n_tokens", "ids", "decoded", "ids_sha256", "decoded_sha256")
    got = {r.doc_id: r for r in encode_documents(documents, PATH, outputs=outputs).collect()}
    for i, text in corpus:
        ids = pair[1].encode(text or "", add_special_tokens=False).ids
        assert (got[i].n_tokens, got[i].ids, got[i].decoded) == (len(ids), ids, text or "")
        assert got[i].ids_sha256 == hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest()
        assert got[i].decoded_sha256 == hashlib.sha256((text or "").encode()).hexdigest()
    assert encode_documents(no_documents, PATH).count() == 0
    clash = spark.createDataFrame([(None, "a", 1), (None, "a", 1)], "doc_id bigint, text string, ids int")
    assert [r.ids for r in encode_documents(clash, PATH).collect()] == [[64], [64]]
