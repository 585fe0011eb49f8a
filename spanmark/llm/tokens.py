"""Encoding of whole texts by the tokenizers library, chunk by chunk.

Both vocabularies split a text into pre-tokens before merging, and no pre-token reaches over
the cuts made here: word_bpe drops white space, byte_bpe puts at most one leading space into a
pre-token and looks no further than the next character. So the ids of a text are the ids of
its chunks in order, and each distinct chunk goes to the library once a worker.
"""

from __future__ import annotations

import re
from array import array
from codecs import charmap_decode
from string import punctuation
from unicodedata import is_normalized

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from .common import text_bytes

# The code points with the Unicode property White_Space.
WHITE = "\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
# The rule by which byte-level vocabularies spell bytes: printable Latin-1 as it is, the others from U+0100 on.
_SHOWN = {*range(33, 127), *range(161, 173), *range(174, 256)}
_BYTES = {b: 256 + i for i, b in enumerate(b for b in range(256) if b not in _SHOWN)}
_SPELT = "".join(chr(_BYTES.get(b, b)) for b in range(256))
# Latin letters up to U+017F: one pre-token, with one space before at most.
_LETTERS = re.compile(f" ?[{''.join(c for c in map(chr, range(0x180)) if c.isalpha())}]+")
_SPACED = re.compile(f" ?[^{WHITE}]+|[{WHITE}]+(?![^{WHITE}])|[{WHITE}]+")


def place(name: str, folder: str | None = None) -> str:
    """The file of a public tokenizer; folder: where the files are, if not in the installed package."""
    if folder is not None:
        return f"{folder}/{name}"
    import public_tokenizers

    return public_tokenizers.path(name)


def load(file: str):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(file)
    t.encode_special_tokens = True  # control strings inside texts are ordinary text
    return t


class ChunkEncoder(dict):
    """A chunk of text to its ids as little-endian uint32 bytes.

    Two generations of up to `most` chunks each are remembered, none over `longest` characters. Where
    a space belongs to the pre-token after it, `spaced` has the ids of a chunk with a space before it.
    """

    def __init__(self, name: str, folder: str | None = None, most: int = 400_000, longest: int = 64):
        super().__init__()
        self.tokenizer = load(place(name, folder))
        self.model = self.tokenizer.model
        self.drops_space = name.startswith("word_")
        self.most, self.longest, self.older = most, longest, {}
        self.before, self.bare = "", self
        self.spaced = self if self.drops_space else _Spaced(self)
        if not self.drops_space:
            self.most = max(1, most // 4)  # few chunks have no space before them

    def __missing__(self, chunk: str) -> bytes:
        return self.pool([chunk])[0]

    def pool(self, chunks: list[str]) -> list[bytes]:
        """The ids of each chunk."""
        out = list(map(self.get, chunks))
        tokenize, fullmatch = self.model.tokenize, _LETTERS.fullmatch
        for i in [i for i, ids in enumerate(out) if ids is None]:
            chunk = chunks[i]
            ids = self.older.get(chunk)
            if ids is None:
                text = self.before + chunk
                if fullmatch(text) and (not self.drops_space or text.isascii() or is_normalized("NFC", text)):
                    spelt = (text.lower() if self.drops_space else text).encode()
                    ids = array("I", [t.id for t in tokenize(charmap_decode(spelt, "strict", _SPELT)[0])]).tobytes()  # in bytes as the model has them
                else:
                    ids = self._ids(chunk, text)
            if len(chunk) <= self.longest:
                if len(self) >= self.most:
                    self.older = dict(self)
                    self.clear()
                self[chunk] = ids
            out[i] = ids
        return out

    def _ids(self, chunk: str, text: str) -> bytes:
        if not text:
            return b""
        run = chunk.rstrip(punctuation)
        if run and run is not chunk and run[-1].isalpha():  # a letter run ends before marks, and these are one run
            return self[run] + self.bare[chunk[len(run) :]]
        if "\n" in chunk and not self.drops_space and len(parts := _SPACED.findall(text)) > 1:
            return self[parts[0][len(self.before) :]] + b"".join([self.bare[p] for p in parts[1:]])
        return array("I", self.tokenizer.encode(text, add_special_tokens=False).ids).tobytes()

    def encode(self, text: str | None) -> bytes:
        """The ids of a whole text as little-endian uint32 bytes; null counts as empty."""
        if not text:
            return b""
        if self.drops_space:
            return b"".join(map(self.__getitem__, re.split("[\t-\r ]+", text)))
        return b"".join([self.spaced[p[1:]] if p[0] == " " else self[p] for p in _SPACED.findall(text)])

    def encode_many(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all texts one after another (uint32), and where each text's begin and the last end."""
        data, begin = text_bytes(texts)  # rebased: lower-casing a slice of an array reads the wrong bytes
        texts = pa.LargeStringArray.from_buffers(len(texts), pa.py_buffer(np.ascontiguousarray(begin)), pa.py_buffer(data))
        if self.drops_space:
            lists = pc.ascii_split_whitespace(pc.ascii_lower(texts))
            plain = None
        else:  # cuts before a space hold where no white space stands before it
            lists = pc.split_pattern(texts, " ")
            plain = ~pc.match_substring_regex(texts, f"[{WHITE}] ").to_numpy(zero_copy_only=False)
        ends = np.asarray(lists.offsets).astype(np.int64)
        ends -= ends[0]
        flat = lists.flatten()
        coded = flat.dictionary_encode()
        key = np.array(coded.indices)
        words = coded.dictionary.to_numpy(zero_copy_only=False).tolist()  # several times faster than to_pylist
        if plain is None:
            pool = self.pool(words)
        else:  # all but a text's first word have their space before them
            key[ends[:-1]] = len(words) + np.arange(len(texts))
            used = np.zeros(len(words) + len(texts), bool)
            used[key] = True
            words = [w if u else "" for w, u in zip(words, used.tolist())]  # those that only begin texts
            pool = self.spaced.pool(words) + self.pool(flat.take(pa.array(ends[:-1])).to_numpy(zero_copy_only=False).tolist())
        size = np.zeros(len(pool) + 1, np.int64)
        np.cumsum(np.fromiter(map(len, pool), np.int64, len(pool)), out=size[1:])
        coded = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(pool), [None, pa.py_buffer(size), pa.py_buffer(b"".join(pool))]).take(pa.array(key))
        raw, begin = coded.buffers()[2], np.frombuffer(coded.buffers()[1], np.int64)[: len(key) + 1]
        ids = np.frombuffer(raw or b"", np.uint8)[: begin[-1]].view("<u4")
        offsets = begin[ends] // 4
        if plain is None or plain.all():
            return ids, offsets
        parts = [ids[a:b] if ok else np.frombuffer(self.encode(t.as_py()), "<u4") for t, ok, a, b in zip(texts, plain, offsets[:-1].tolist(), offsets[1:].tolist())]
        return np.concatenate(parts), np.r_[0, np.cumsum([len(x) for x in parts])]


class _Spaced(ChunkEncoder):
    """The chunks of another encoder, each with a space before it."""

    def __init__(self, bare: ChunkEncoder):
        dict.__init__(self)
        self.tokenizer, self.model, self.drops_space = bare.tokenizer, bare.model, False
        self.most, self.longest, self.older = bare.most, bare.longest, {}
        self.before, self.bare, self.spaced = " ", bare, self


_LOADED: dict[tuple, ChunkEncoder] = {}


def encoder(name: str, folder: str | None = None, most: int = 400_000) -> ChunkEncoder:
    """One encoder a worker process."""
    key = (name, folder, most)
    if key not in _LOADED:
        _LOADED[key] = ChunkEncoder(name, folder, most)
    return _LOADED[key]
