"""Exact byte-level BPE ids of whole texts, with a bounded memo of words.

The pre-tokenizer of a byte-level vocabulary never joins text across a space
that has a non-space on either side, so a text may be cut before each such
space and every part encoded by itself. Words recur, and the memo keeps the
library's ids of those seen. A word of letters is one piece for the library's
BPE model, and so are the signs after it and a line's end. Texts with
other white space beside a space are encoded in one piece.
"""

from __future__ import annotations

import os
import re

import numpy as np

#: Words in each of the memo's two generations, and characters above which a word is not kept.
MEMO_WORDS, MEMO_CHARS = 600_000, 48
#: Signs of which a run after letters is a piece of its own; the apostrophe isn't among them.
SIGNS = "!\"#$%&()*+,-./:;<=>?@[\\]^_`{|}~"


class _Words(dict):
    """Ids of words as little-endian unsigned integers; a word not yet known is encoded on the way."""

    def __init__(self, tokenizer, space: str):
        self._tokenizer, self._space, self._older = tokenizer, space, {}
        self._model = tokenizer.model.tokenize
        size = tokenizer.get_vocab_size(with_added_tokens=True)
        self.width = 2 if size <= 1 << 16 else 4  # small vocabularies take half the memory
        self._bytes = [i.to_bytes(self.width, "little") for i in range(size)]
        plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
        others = [b for b in range(256) if b not in plain]
        self._written = {b: chr(b) for b in plain} | {b: chr(256 + i) for i, b in enumerate(others)}
        self._before = space.translate(self._written)
        self._signs = {}

    def library(self, text: str) -> bytes:
        ids = self._bytes
        return b"".join([ids[i] for i in self._tokenizer.encode(text, add_special_tokens=False).ids])

    def letters(self, word: str, before: str) -> bytes:
        ids = self._bytes
        piece = word if word.isascii() else word.encode().decode("latin-1").translate(self._written)
        return b"".join([ids[x.id] for x in self._model(before + piece)])

    def _sign(self, signs: str) -> bytes:
        ids = self._signs.get(signs)
        if ids is None:
            ids = self.library(signs)
            if len(signs) <= 4:
                self._signs[signs] = ids
        return ids

    def _after_space(self, word: str) -> bytes | None:
        """Ids of letters and a run of signs after them, which are two pieces, or None."""
        core = word.rstrip(SIGNS)
        if not core.isalpha():
            return None
        ids = self.get(core)
        if ids is None:
            ids = self._older.get(core) or self.letters(core, self._before)
            if len(core) <= MEMO_CHARS:
                self[core] = ids
        return ids if core == word else ids + self._sign(word[len(core) :])

    def __missing__(self, word: str) -> bytes:
        ids = self._older.get(word)
        if ids is None:
            if not word or word[-1].isspace() or (self._space and word[0].isspace()):
                raise KeyError(word)  # white space beside a space
            ids = self._after_space(word)
            if ids is None:
                first, line, second = word.partition("\n")
                core = second.rstrip(SIGNS)
                ids = self._after_space(first) if core.isalpha() else None
                if ids is None:
                    ids = self.library(self._space + word)
                else:
                    ids += self._sign(line) + self.letters(core, "") + (self._sign(second[len(core) :]) if core != second else b"")
        if len(word) <= MEMO_CHARS:
            self[word] = ids
        return ids

    def age(self) -> None:
        if len(self) > MEMO_WORDS:
            self._older = dict(self)
            self.clear()


class Encoder:
    """Encodes as the tokenizers library does; a text that holds an added token's string goes to the library whole."""

    def __init__(self, path: str):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        tokenizer = Tokenizer.from_file(path)
        added = [re.escape(x.content) for x in tokenizer.get_added_tokens_decoder().values()]
        self._added = re.compile("|".join(added) or r"(?!)").search
        self._words, self._heads = _Words(tokenizer, " "), _Words(tokenizer, "")

    def encode(self, texts: list[str], end_id: int) -> list[np.ndarray]:
        """For each text its ids and the end id, as arrays of unsigned integers of 16 or 32 bits."""
        words, heads, out = self._words.__getitem__, self._heads, []
        end, kind = end_id.to_bytes(heads.width, "little"), f"<u{heads.width}"
        for i, text in enumerate(texts):
            head, *rest = text.split(" ")
            try:
                if self._added(text):
                    raise KeyError(text)
                ids = b"".join([heads[head] if head or rest else b"", *map(words, rest), end])
            except KeyError:
                ids = heads.library(text) + end
            out.append(np.frombuffer(ids, dtype=kind))
            if i % 64 == 0:
                self._words.age()
                heads.age()
        return out


_encoders: dict[str, Encoder] = {}


def encoder(path: str) -> Encoder:
    """One encoder for each vocabulary and Python process; it lives on between tasks."""
    if path not in _encoders:
        _encoders[path] = Encoder(path)
    return _encoders[path]
