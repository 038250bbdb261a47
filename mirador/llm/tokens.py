"""Token ids of whole texts by the ``tokenizers`` library, a distinct piece at a time.

Byte-pair encoding never merges across the pieces that a pre-tokenizer cuts, and the same
pieces come back millions of times. So each task cuts a text into the tokenizer's own
pieces with a compiled pattern, has the library's model encode only pieces it has not met,
and joins the ids as little-endian unsigned 32-bit bytes. No piece crosses white space
(but for one space before it), so the join goes by chunks between spaces. Texts with a character outside
``FAST`` (where the two regex engines' Unicode tables might differ) and texts that could
hold a special token go to the library whole.
"""

from __future__ import annotations

import os
import re
import unicodedata

import numpy as np

os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")

_FAST_RANGES = "\t\n\r\x20-\x7e\xa0-ɏ‐-―‘-„…€"
FAST = re.compile(f"[{_FAST_RANGES}]*")
#: Chunks kept by a worker before it starts anew; about 250 MB.
KEPT_CHUNKS = 700_000
#: A space after another white space, in FAST: here a cut at every space might part a run.
_RUNS = [f"{c} " for c in " \t\n\r\xa0"]


def _class(prefix: str) -> str:
    """The characters of FAST in a Unicode category, as the inside of a character class."""
    chars = [chr(c) for c in range(0x2100) if FAST.fullmatch(chr(c)) and unicodedata.category(chr(c))[0] == prefix]
    return "".join(map(re.escape, chars))


def piece_pattern(kind: str) -> re.Pattern[str]:
    """The published pre-tokenizer patterns of the two vocabularies, over FAST."""
    letters, numbers, spaces = _class("L"), _class("N"), " \t\n\r\xa0"
    short = "'s|'t|'re|'ve|'m|'ll|'d"
    other = f"[^{spaces}{letters}{numbers}]+"
    if kind == "word":
        return re.compile(f"{short}|[{letters}]+|[{numbers}]|{other}")
    return re.compile(f"{short}| ?[{letters}]+| ?[{numbers}]+| ?{other}|[{spaces}]+(?![^{spaces}])|[{spaces}]+")


class _Kept(dict):
    """String to the bytes of its ids, made on first sight."""

    def __init__(self, make):
        super().__init__()
        self._make = make

    def __missing__(self, key: str) -> bytes:
        got = self[key] = self._make(key)
        return got


def _byte_letters() -> dict[int, str]:
    """The printable letter that stands for each byte in a byte-level vocabulary."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {b: chr(b) for b in plain} | {b: chr(256 + n) for n, b in enumerate(rest)}


class Encoder:
    """``ids(text)`` gives the bytes of the text's ids, equal to those of
    ``Tokenizer.from_file(path).encode(text, add_special_tokens=False).ids``."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self._whole = Tokenizer.from_file(path)
        self._words = self._whole.normalizer is not None
        self._pieces_of = piece_pattern("word" if self._words else "byte").findall
        self._chunks_of = re.compile(r" ?\S+|\s+(?!\S)|\s+").findall
        self._specials = [t.content for t in self._whole.get_added_tokens_decoder().values()]
        self._model, self._letters = self._whole.model, _byte_letters()
        self._bytes = [n.to_bytes(4, "little") for n in range(self._whole.get_vocab_size())]
        self._start()

    def _start(self) -> None:
        self._pieces = _Kept(self._encode_piece)
        self._chunks = _Kept(self._encode_chunk)
        self._after = _Kept(lambda word: self._encode_chunk(" " + word))

    def _encode_piece(self, piece: str) -> bytes:
        seen = piece.encode().decode("latin-1").translate(self._letters)
        return b"".join([self._bytes[t.id] for t in self._model.tokenize(seen)])

    def _encode_chunk(self, chunk: str) -> bytes:
        if chunk.removeprefix(" ").isalpha():  # one piece
            return self._encode_piece(chunk)
        return b"".join(map(self._pieces.__getitem__, self._pieces_of(chunk)))

    def ids(self, text: str) -> bytes:
        if not FAST.fullmatch(text) or any(s in text for s in self._specials):
            return self._by_library(text)
        if len(self._chunks) + len(self._after) > KEPT_CHUNKS:
            self._start()
        if self._words:
            lower = unicodedata.normalize("NFC", text).lower()
            return b"".join(map(self._chunks.__getitem__, lower.split())) if FAST.fullmatch(lower) else self._by_library(text)
        if any(s in text for s in _RUNS):
            return b"".join(map(self._chunks.__getitem__, self._chunks_of(text)))
        first, *rest = text.split(" ")
        return b"".join([self._chunks[first], *map(self._after.__getitem__, rest)])

    def _by_library(self, text: str) -> bytes:
        return np.asarray(self._whole.encode(text, add_special_tokens=False).ids, "<u4").tobytes()


_encoders: dict[str, Encoder] = {}


def encoder(path: str) -> Encoder:
    """One encoder a worker process and vocabulary file."""
    if path not in _encoders:
        _encoders[path] = Encoder(path)
    return _encoders[path]
