import base64
import hashlib
import itertools
import unicodedata

import numpy as np
import pytest
from hypothesis import given, settings, strategies as st

from tallyledger.llm import byte_bpe
from tallyledger.llm.byte_bpe import ByteBPE, decode_documents, encode_documents, public_ranks

tiktoken = pytest.importorskip("tiktoken")
regex = pytest.importorskip("regex")
tokenizers = pytest.importorskip("public_tokenizers")
PATH = public_ranks()


@pytest.fixture(scope="module")
def pair():
    with open(PATH, "rb") as file:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, file)}
    public = tiktoken.Encoding("own", pat_str=tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    return ByteBPE(PATH), public


def pieces(texts):
    points = np.frombuffer("".join(texts).encode("utf-32-le"), "<u4")
    starts = byte_bpe.piece_starts(points, np.array([len(t) for t in texts], np.int64)).tolist()
    joined = "".join(texts)
    return [joined[a:b] for a, b in itertools.pairwise([*starts, len(joined)])]


ODD = st.lists(st.sampled_from(["'re", "'s", "'", "  ", " \n", *"astrelv' \n\t1.!é", "٣", "　", "\x1c", "\x85"])).map("".join)


@settings(max_examples=400, deadline=None)
@given(st.lists(ODD | st.text(), max_size=5))
def test_scan_finds_the_pieces_of_the_pattern(texts):
    # The pattern's classes by their names: \s of the regex module also takes in four separators that are no white space.
    white = r"\p{White_Space}"
    pattern = regex.compile(tokenizers.PATTERN.replace(r"[^\s", f"[^{white}").replace(r"\S", rf"[^{white}]").replace(r"\s", white))
    known = [t for t in texts if all(unicodedata.category(c) != "Cn" for c in t)]
    assert pieces(known) == [p for t in known for p in pattern.findall(t)]


@settings(max_examples=300, deadline=None)
@given(ODD | st.text())
def test_equals_the_public_library(pair, text):
    ids = pair[0].encode(text)
    assert ids == pair[1].encode_ordinary(text)
    assert pair[0].decode(np.array(ids, np.int64)) == text.encode()


@pytest.mark.parametrize("text", ["a" * 3000, "ab" * 800 + "é", " " * 700 + "x", "thethe" * 200, "é中" * 900, " \n" * 500])
def test_long_pieces(pair, text):
    assert pair[0].encode(text) == pair[1].encode_ordinary(text)


def test_flat_rounds_and_heap_agree(pair):
    own = pair[0]
    words = [w.encode() for w in ("lowercase", "Überraschung", "ththth", "zzzzzzzzzz", "1234567890" * 6, "aaaaa", "q")]
    ids, counts = own._merge_flat(np.frombuffer(b"".join(words), np.uint8), np.array([len(w) for w in words]))
    assert [x.tolist() for x in np.split(ids, np.cumsum(counts)[:-1])] == [own._merge_long(w) for w in words]


def test_long_texts_are_cut_where_a_piece_begins(pair, monkeypatch):
    text = "Don't stop  at 12 o'clock,\n it's fine 's  \t x " * 60 + "y" * 300
    whole = pair[0].encode(text)
    for size in (1, 7, 50):
        monkeypatch.setattr(byte_bpe, "TOGETHER", size)
        assert "".join(byte_bpe._cut(text)) == text
        assert pair[0].encode(text) == whole == pair[1].encode_ordinary(text)


def test_what_is_kept_is_bounded_and_forgotten(pair, monkeypatch):
    own = ByteBPE(PATH)
    monkeypatch.setattr(byte_bpe, "REMEMBERED", 3)
    texts = ["one two three four five", "six seven", "one two"]
    for text in texts * 2:
        assert own.encode(text) == pair[1].encode_ordinary(text)
        assert len(own._known) <= 8


def test_offsets_point_into_the_text(pair):
    text = "naïve 😀 text, don't"
    ids = np.array(pair[0].encode(text))
    offsets = pair[0].offsets(ids).tolist()
    raw = text.encode()
    assert [raw[a:b] for a, b in zip(offsets, offsets[1:], strict=False)] == [pair[1].decode_single_token_bytes(i) for i in ids.tolist()]
    assert pair[0].encode("") == [] and pair[0].offsets(np.zeros(0, np.int64)).tolist() == [0]


def test_table(spark, documents, corpus, no_documents, pair):
    outputs = ("n_tokens", "ids", "offsets", "decoded", "ids_sha256", "decoded_sha256")
    encoded = encode_documents(documents, PATH, outputs=outputs)
    got = {r.doc_id: r for r in encoded.collect()}
    assert len(got) == len(corpus)
    for i, text in corpus:
        ids = pair[1].encode_ordinary(text or "")
        assert (got[i].n_tokens, got[i].ids, bytes(got[i].decoded)) == (len(ids), ids, (text or "").encode())
        assert got[i].ids_sha256 == hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest()
        assert got[i].decoded_sha256 == hashlib.sha256((text or "").encode()).hexdigest()
        assert len(got[i].offsets) == len(ids)
    back = {r.doc_id: bytes(r.decoded) for r in decode_documents(encoded, PATH).collect()}
    assert back == {i: (t or "").encode() for i, t in corpus}
    assert encode_documents(no_documents, PATH).count() == 0


def test_repeated_rows_nulls_and_clashing_columns(spark):
    rows = [(None, "a b", 1, 2), (None, "a b", 1, 2), (7, None, None, None)]
    clash = spark.createDataFrame(rows, "doc_id bigint, text string, ids int, key int")
    got = encode_documents(clash, PATH, outputs=("ids", "n_tokens")).collect()
    assert sorted((r.doc_id or 0, r.n_tokens) for r in got) == [(0, 2), (0, 2), (7, 0)]
    with pytest.raises(ValueError, match="unknown outputs"):
        encode_documents(clash, PATH, outputs=("tokens",))
