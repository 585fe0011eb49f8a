"""Chat formatting: exact round trips."""

import hashlib

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st

from spanmark.llm.chat import chat_digests, escape, format_chats, parse, render, token_mask, unescape

ODD = ["", " ", "\\", "<|done|>", "a<|says|>b\\<\\|done|>", "</s>[INST] ok [/INST]", "  lead", "\n\ntrail \n", "é中🙂", "<<SYS>>x<</SYS>>", "<|endoftext|>", "don't", "x" * 9000]


@settings(max_examples=200, deadline=None)
@given(st.text(alphabet=st.sampled_from(list("\\<|>/s[]INST adone")), max_size=60))
def test_escape_is_reversible(text):
    assert unescape(escape(text)) == text
    assert not any(m in escape(text) for m in ("<|done|>", "<|says|>", "<|turn|>", "</s>", "[INST]"))


def test_parse_undoes_render():
    turns = [(r, t) for r in ("user", "assistant", "<|turn|>") for t in ODD]
    assert parse(render(turns)[0]) == turns


def test_token_mask():
    begins, ends = np.array([0, 2, 2, 5]), np.array([2, 5, 5, 9])
    assert token_mask(np.array([[2, 5], [5, 5], [5, 9]]), begins, ends).tolist() == [[1, 3], [3, 3], [3, 4]]


def test_digests(spark):
    rows = [(1, k, "assistant" if k % 2 else "user", t, "x") for k, t in enumerate(ODD)] + [(2, 0, None, None, "x"), (None, 1, "assistant", "alone", "x"), (3, 5, "assistant", "b", "y"), (3, 2, "user", "a", "y"), (3, 5, "assistant", "b", "y")]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string, formatted string")
    got = {r["conv_id"]: r for r in chat_digests(format_chats(spark, df)).collect()}
    assert set(got) == {1, 2, 3, None}
    for conv in got:
        turns = [(r[2] or "", r[3] or "") for r in sorted((r for r in rows if r[0] == conv), key=lambda r: r[1])]
        loss = "".join(t for role, t in turns if role == "assistant")
        assert got[conv]["n_turns"] == len(turns)
        assert got[conv]["turns_sha256"] == hashlib.sha256("".join(f"{r}\n{t}\n" for r, t in turns).encode()).hexdigest()
        assert (got[conv]["loss_chars"], got[conv]["loss_sha256"]) == (len(loss), hashlib.sha256(loss.encode()).hexdigest())
    assert chat_digests(format_chats(spark, df.limit(0))).collect() == []
