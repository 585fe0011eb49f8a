"""Token output and packing against the library and brute force."""

import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers as P
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from spanmark.llm import packing
from spanmark.llm.packing import cut, pack_documents, sum_of_squares
from spanmark.llm.token_output import BLOCK, pack, token_digests, unpack
from spanmark.llm.tokens import encoder

TEXTS = [None, "", " ", "a", "Hello, world!  two  spaces\n\nand\tlines ", "naïve café ÉTÉ straße Σίσυφος ΟΔΟΣ.", "<|endoftext|> </s> [INST]", "x y z  ", "don't WE'LL 'tis 123 45,6 中文 🙂🙂", "ab " * 3000, "the the.\nThe end? yes", "a \n b\r\n  c", "q" * 5000]


def direct(name, text):
    t = Tokenizer.from_file(P.path(name))
    t.encode_special_tokens = True
    return t.encode(text or "", add_special_tokens=False).ids


def crc(ids):
    return zlib.crc32(np.asarray(ids, "<u4").tobytes())


@pytest.mark.parametrize("name", ["word_bpe_49k.json", "byte_bpe_50k.json"])
def test_encoder_equals_library(name):
    import pyarrow as pa

    enc = encoder(name)
    ids, offsets = enc.encode_many(pa.array(TEXTS))
    for k, text in enumerate(TEXTS):
        assert ids[offsets[k] : offsets[k + 1]].tolist() == direct(name, text), text
        assert np.frombuffer(enc.encode(text), "<u4").tolist() == direct(name, text)


def test_encoder_on_slices():
    import pyarrow as pa

    whole = pa.array(TEXTS * 3)
    for name in ("word_bpe_49k.json", "byte_bpe_50k.json"):
        for a, n in ((1, 5), (4, 9), (9, 20)):
            ids, offsets = encoder(name).encode_many(whole.slice(a, n))
            for k in range(n):
                assert ids[offsets[k] : offsets[k + 1]].tolist() == direct(name, whole[a + k].as_py())


@settings(max_examples=60, deadline=None)
@given(st.lists(st.text(max_size=40), min_size=1, max_size=4))
def test_encoder_on_any_text(texts):
    import pyarrow as pa

    for name in ("word_bpe_49k.json", "byte_bpe_50k.json"):
        ids, offsets = encoder(name).encode_many(pa.array(texts))
        for k, text in enumerate(texts):
            assert ids[offsets[k] : offsets[k + 1]].tolist() == direct(name, text), (name, text)


@settings(max_examples=60, deadline=None)
@given(st.lists(st.one_of(st.integers(0, 300), st.integers(0, 2**32 - 1)), max_size=3 * BLOCK))
def test_blocks_round_trip(ids):
    ids = np.array(ids, np.uint32)
    payload, starts = pack(ids)
    assert unpack(payload, starts, len(ids)).tolist() == ids.tolist()


def frame(spark, rows):
    return spark.createDataFrame(rows, "doc_id long, text string, shard string, bucket int, sequence_id long")


def test_token_output(spark):
    docs = frame(spark, [(3 * i % 17, t, "s", 1, 2) for i, t in enumerate(TEXTS)])
    got = {r["doc_id"]: r for r in token_digests(spark, docs).collect()}
    start = 0
    for doc_id, text in sorted((3 * i % 17, t) for i, t in enumerate(TEXTS)):
        ids = direct("word_bpe_49k.json", text) + [1]
        assert (got[doc_id]["start"], got[doc_id]["n_tokens"], got[doc_id]["ids_crc32"]) == (start, len(ids), crc(ids))
        start += len(ids)
    assert token_digests(spark, frame(spark, [])).collect() == []


def test_packing(spark):
    rows = [(i, TEXTS[i % len(TEXTS)], "s", 1, 2) for i in range(60)] + [(None, "null id", "s", 1, 2)]
    got = pack_documents(spark, frame(spark, rows)).collect()
    want = []
    for doc_id, text, *_ in rows:
        ids, at = direct("byte_bpe_50k.json", text) + [2], 0
        for k, n in enumerate(cut(len(ids))):
            want.append((doc_id, k, at, n, crc(ids[at : at + n])))
            at += n
    key = lambda r: (r[0] is None, r[0] or 0, r[1])
    assert sorted([tuple(r[:5]) for r in got], key=key) == sorted(want, key=key)
    bins = defaultdict(list)
    for r in got:
        bins[r["sequence_id"]].append((r["offset"], r["length"]))
    for pieces in bins.values():
        at = 0
        for offset, n in sorted(pieces):
            assert offset == at
            at += n
        assert at <= 1024
    assert len(bins) <= -(-sum(w[3] for w in want) // 1024) + 2
    assert pack_documents(spark, frame(spark, [])).collect() == []


def test_packing_without_full_bins_stays_spread(spark, monkeypatch):
    monkeypatch.setattr(packing, "PER_BUCKET", 500)
    rows = [(i // 2, " ".join(["word"] * 600), "s", 1, 2) for i in range(4000)]  # no two fit together; each row twice
    got = pack_documents(spark, frame(spark, rows)).select("sequence_id", "length").collect()
    assert len({r[0] for r in got}) == len(got) == 4000 and {r[1] for r in got} == {601}
    size = Counter(r[0] >> 26 for r in got)
    assert max(size.values()) <= 1000 and len(size) >= 6


def test_token_output_with_null_and_repeated_ids(spark):
    rows = [(None, "b", "s", 1, 2), (None, "a", "s", 1, 2), *((7, f"text {i % 5}", "s", 1, 2) for i in range(300)), (8, None, "s", 1, 2)]
    got = token_digests(spark, frame(spark, rows)).collect()
    assert len(got) == len(rows)
    at = 0
    for r in sorted(got, key=lambda r: r["start"]):
        assert r["start"] == at
        at += r["n_tokens"]
    assert [r["doc_id"] for r in sorted(got, key=lambda r: r["start"])][-1] == 8


def test_sum_of_squares_fills_bins():
    size = np.sort(np.random.default_rng(1).integers(1, 700, 4000))[::-1]
    bins = sum_of_squares(size, 1024)
    fill = np.bincount(bins, size)
    assert fill.max() <= 1024 and len(fill) <= size.sum() / 1024 * 1.02


def test_packing_encodes_a_megabyte_together(monkeypatch):
    """Texts of 3 MB go to the encoder in a few calls, so that a word which they share is looked up a few times."""
    import pyarrow as pa

    calls, own = [], encoder("byte_bpe_50k.json")
    many = type(own).encode_many
    monkeypatch.setattr(type(own), "encode_many", lambda self, texts: calls.append(len(texts)) or many(self, texts))
    texts = [f"some words of text {i} " * 50 for i in range(3000)]
    size = sum(map(len, texts))
    out = list(packing._pieces(iter([pa.RecordBatch.from_pydict({"doc_id": list(range(3000)), "text": texts})]), "byte_bpe_50k.json", None, 2, 1024))
    assert sum(calls) == 3000 and len(calls) <= -(-size // (1 << 20)) + 1
    first = out[0].to_pylist()[0]
    assert (first["length"], first["ids_crc32"]) == (len(direct("byte_bpe_50k.json", texts[0])) + 1, crc(direct("byte_bpe_50k.json", texts[0]) + [2]))


def test_letter_runs_need_no_whole_encoding():
    """Chunks of letters, marks after them and line breaks are put together from letter runs, each encoded once."""
    import pyarrow as pa

    from spanmark.llm.tokens import ChunkEncoder

    texts = ["Das war.\nEnde, OFEN!! für$$$ x### don't", "war war.\nDas\n\nüber?! (so)", "über", "", "'s a's' b'\n'tis <s>ü</s>.", "one.\ntwo three .\nfour"]
    for name in ("word_bpe_49k.json", "byte_bpe_50k.json"):
        enc = ChunkEncoder(name, most=8)  # generations change while a text is encoded
        ids, offsets = enc.encode_many(pa.array(texts))
        for k, text in enumerate(texts):
            assert ids[offsets[k] : offsets[k + 1]].tolist() == direct(name, text), (name, text)
    enc, whole = ChunkEncoder("byte_bpe_50k.json"), []

    class Counted:
        def encode(self, text, **kw):
            whole.append(text)
            return library.encode(text, **kw)

    library = enc.tokenizer
    for e in (enc, getattr(enc, "spaced", enc)):
        e.tokenizer = Counted()
    enc.encode_many(pa.array(texts[:1] * 3))
    assert sorted(whole) == sorted([" ", "\n", "!!", "$$$", "###", ".", ",", " don't"]), whole
