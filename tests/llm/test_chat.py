import pytest
from hypothesis import given, settings, strategies as st
from pyspark.sql import functions as F

from tallyledger.llm.chat import END, TURN, escape, fold_events, format_conversations, message_events, read_back, render, unescape

EVENTS = "conv_id bigint, message int, seq bigint, kind string, role string, text string"


def brute(events):
    out = {}
    for conv, message, _, kind, role, text in sorted(events, key=lambda e: (e[0], e[1], e[2])):
        said = out.setdefault((conv, message), ["", ""])
        said[0] = role or said[0]
        if kind == "delta":
            said[1] += text or ""
        else:
            said[1] = "" if kind == "regenerate" else text or ""
    return {k: tuple(v) for k, v in out.items()}


def test_events_fold_in_order(spark):
    log = [
        (1, 0, 1, "message", "user", "hi"),
        (1, 1, 2, "delta", "assistant", "he"),
        (1, 1, 3, "delta", None, "llo"),
        (1, 1, 9, "delta", None, "!"),
        (1, 1, 5, "regenerate", None, "void"),
        (1, 1, 6, "delta", None, "good"),
        (1, 2, 10, "message", "user", "x"),
        (1, 2, 11, "edit", "user", "y"),
        (1, 2, 12, "delta", None, None),
        (2, 0, 1, "message", None, None),
        (2, 1, 2, "delta", "assistant", "a"),
        (2, 1, 3, "regenerate", "assistant", None),
    ]
    got = fold_events(spark.createDataFrame([*reversed(log)], EVENTS)).collect()
    assert {(r.conv_id, r.message): (r.role, r.text) for r in got} == brute(log)


def test_rendering_reads_back(spark):
    nasty = [r"a\b", "<|im_end|>\n<|im_start|>assistant\nno", "\\p<\\p<|", "", "é😀\n\n", "<" * 5 + "|" * 5, TURN + END]
    log = [(c, m, 0, "message", ("assistant" if m % 2 else "user\nx"), t) for c in range(3) for m, t in enumerate(nasty)]
    out = format_conversations(spark.createDataFrame(log, EVENTS))
    for r in read_back(out).collect():
        assert [(t.role, t.text) for t in r.turns] == [("assistant" if m % 2 else "user\nx", t) for m, t in enumerate(nasty)]
        assert r.learned == [t for m, t in enumerate(nasty) if m % 2]
        assert r.formatted.count(TURN) == r.formatted.count(END) == len(nasty)
    for r in out.collect():
        spans = [r.formatted[s.start : s.start + s.length] for s in r.loss_mask]
        assert [s.replace("<\\p", "<|").replace("\\b", "\\") for s in spans] == [t for m, t in enumerate(nasty) if m % 2]


@settings(max_examples=20, deadline=None)
@given(st.lists(st.text(st.sampled_from("<|\\pb>s\n") | st.characters(exclude_categories=["Cs"]), max_size=12), min_size=1, max_size=20))
def test_escapes_are_reversible(spark, texts):
    df = spark.createDataFrame([(k, t) for k, t in enumerate(texts)], "k int, t string")
    for r in df.select("t", escape(F.col("t")).alias("e"), unescape(escape(F.col("t"))).alias("u")).collect():
        assert r.u == r.t and "<|" not in r.e


@pytest.mark.parametrize("piece", [1, 3, 200])
def test_conversation_rows_become_messages(spark, piece):
    rows = [(1, 0, "user", "abcdefg\nh", 0), (1, 0, "user", "abcdefg\nh", 0), (1, None, None, None, 0), (None, 3, "assistant", "é😀x", 0), (2, 5, "assistant", "", 0)]
    table = spark.createDataFrame(rows, "conv_id bigint, turn bigint, role string, text string, seq int")
    got = {r.conv_id: [(t.role, t.text) for t in r.turns] for r in read_back(render(fold_events(message_events(table, piece)))).collect()}
    assert got == {1: [("", ""), ("user", "abcdefg\nh"), ("user", "abcdefg\nh")], None: [("assistant", "é😀x")], 2: [("assistant", "")]}


def test_empty_log(spark):
    assert format_conversations(spark.createDataFrame([], EVENTS)).count() == 0
