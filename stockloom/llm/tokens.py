"""Token ids of a public byte-level vocabulary, fast enough for whole corpora.

The vocabulary file is read with ``tokenizers``.  A byte-level BPE vocabulary
whose merges are numbered in rank order gives the same ids from its ranks
alone, which ``tiktoken`` computes several times faster; texts that hold a
special token of the file go through ``tokenizers`` itself.  Words after a
single space always start a new piece, so they are encoded on their own and
kept in a bounded cache.
"""

from __future__ import annotations

import json
import re
from array import array

import numpy as np

_HELD: dict[str, Encoder] = {}
# Marks that never join a letter or digit before them.
MARKS = ".,;:!?$%&*#()"


def encoder(path: str) -> Encoder:
    """One encoder per Python worker and vocabulary file."""
    if path not in _HELD:
        _HELD[path] = Encoder(path)
    return _HELD[path]


def _byte_of_sign() -> dict[str, int]:
    """Signs of a byte-level vocabulary file: printable Latin-1 stands for itself,
    every other byte for the next free code point from 256 on."""
    shown = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    hidden = [b for b in range(256) if b not in shown]
    return {chr(b): b for b in shown} | {chr(256 + k): b for k, b in enumerate(hidden)}


class _Words(dict):
    """Ids of words behind a fixed lead as little-endian bytes, found when first met.

    A run of letters or digits always ends before ASCII punctuation, so a word and
    the run of marks behind it are looked up apart.
    """

    def __init__(self, encode, lead: str, limit: int):
        super().__init__()
        self.encode, self.lead, self.limit = encode, lead, limit
        self.marks: dict[str, bytes] = {}

    def __missing__(self, word: str) -> bytes:
        core = word.rstrip(MARKS)
        if core != word and core[-1:].isalnum():
            tail = word[len(core) :]
            marks = self.marks.get(tail)
            if marks is None:
                marks = self.encode(tail)
                if len(self.marks) < 4096:
                    self.marks[tail] = marks
            return self._keep(word, (self.get(core) or self._new(core)) + marks)
        return self._new(word)

    def _new(self, word: str) -> bytes:
        return self._keep(word, self.encode(self.lead + word))

    def _keep(self, word: str, ids: bytes) -> bytes:
        if len(word) <= 64:
            if len(self) >= self.limit:
                self.clear()
            self[word] = ids
        return ids


class Encoder:
    """``encode(text)`` gives the ids of ``text`` without special tokens added.

    ``limit`` bounds the words kept in memory; it does not change any result.
    """

    def __init__(self, path: str, limit: int = 500_000):
        import public_tokenizers
        import tiktoken
        from tokenizers import Tokenizer

        self.reference = Tokenizer.from_file(path)
        with open(path, encoding="utf-8") as file:
            content = json.load(file)
        special = {entry["content"]: entry["id"] for entry in content["added_tokens"]}
        signs = _byte_of_sign()
        self.token_bytes = {
            number: bytes(signs[sign] for sign in token)
            for token, number in content["model"]["vocab"].items()
            if token not in special
        }
        self.size = 1 + max([*self.token_bytes, *special.values()])
        self.dtype = np.dtype("<u2" if self.size <= 1 << 16 else "<u4")
        self.fast = tiktoken.Encoding(
            "ranks",
            pat_str=public_tokenizers.PATTERN,
            mergeable_ranks={token: number for number, token in self.token_bytes.items()},
            special_tokens={},
        )
        self.special = re.compile("|".join(map(re.escape, special))) if special else None
        # Beside these, a space is followed by a non-space and starts a piece.
        self.irregular = re.compile(r" \s| \Z")
        self.words, self.bare = _Words(self._ids, " ", limit), _Words(self._ids, "", limit)
        self.newline = self._ids("\n")

    def _ids(self, text: str) -> bytes:
        ids = self.fast._core_bpe.encode_ordinary(text)
        return array("H" if self.dtype.itemsize == 2 else "I", ids).tobytes()

    def encode(self, text: str) -> np.ndarray:
        if self.special is not None and self.special.search(text):
            return np.array(self.reference.encode(text, add_special_tokens=False).ids, dtype=self.dtype)
        if self.irregular.search(text):
            return np.frombuffer(self._ids(text), dtype=self.dtype)
        if "\n" not in text:
            return np.frombuffer(self._line(text), dtype=self.dtype)
        lines = text.split("\n")
        if any(not line or line[0].isspace() or line[-1].isspace() for line in lines):
            return np.frombuffer(self._ids(text), dtype=self.dtype)
        return np.frombuffer(self.newline.join(map(self._line, lines)), dtype=self.dtype)

    def _line(self, line: str) -> bytes:
        first, *rest = line.split(" ")
        return self.bare[first] + b"".join(map(self.words.__getitem__, rest))

    def ends_sentence(self) -> np.ndarray:
        """For every id, whether its bytes end a sentence or a line."""
        ends = np.zeros(self.size, dtype=bool)
        for number, token in self.token_bytes.items():
            ends[number] = token[-1:] in (b".", b"!", b"?", b"\n")
        return ends
