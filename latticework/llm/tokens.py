"""Encoding whole texts with a public tokenizer: pre-tokens are independent, so each distinct one is encoded once per worker."""

from __future__ import annotations

import json
import re
import struct
from functools import lru_cache
from itertools import accumulate, chain

import numpy as np

#: Distinct words that a worker remembers; beyond it the memory starts anew, which changes no result.
MEMORY = 700_000

#: These are white space for str.split but not for the tokenizer's pattern, or may begin a special token.
_ODD = re.compile("[\x1c-\x1f]|<\\|")

#: Words of these characters keep their composition when they are put in lower case one by one.
_PLAIN = re.compile("[\x21-\x7e\xa1-\xff]+")


def byte_letters() -> dict[int, str]:
    """The letter that stands for each byte in a byte-level vocabulary: itself if it is printable, else the next from U+0100."""
    printable = {*range(33, 127), *range(161, 173), *range(174, 256)}
    others = (b for b in range(256) if b not in printable)
    return {b: chr(b) for b in printable} | {b: chr(256 + k) for k, b in enumerate(others)}


_LETTERS = byte_letters()


def as_letters(text: str) -> str:
    return text.encode().decode("latin-1").translate(_LETTERS)


@lru_cache(maxsize=4)
def tokenizer(path: str):
    from tokenizers import Tokenizer

    return Tokenizer.from_file(path)


class _Remembered(dict):
    def __init__(self, of):
        super().__init__()
        self.of = of

    def __missing__(self, key):
        if len(self) >= MEMORY:
            self.clear()
        value = self[key] = self.of(key)
        return value


class WordEncoder:
    """ids of a lower-casing tokenizer that drops white space and never joins across it, as little-endian unsigned 32-bit integers."""

    def __init__(self, path: str):
        import regex

        self.tokenizer = tokenizer(path)
        self.model = self.tokenizer.model
        self.split = regex.compile(json.loads(self.tokenizer.to_str())["pre_tokenizer"]["pretokenizers"][0]["pattern"]["Regex"]).findall
        self.known = _Remembered(self._word)
        self.pieces = _Remembered(self._piece)

    def _encode(self, text: str) -> bytes:
        return np.asarray(self.tokenizer.encode(text, add_special_tokens=False).ids, "<u4").tobytes()

    def _piece(self, piece: str) -> bytes:
        ids = [t.id for t in self.model.tokenize(as_letters(piece))]
        return struct.pack(f"<{len(ids)}I", *ids)

    def _word(self, word: str) -> bytes:
        if not _PLAIN.fullmatch(word):
            return self._encode(word)
        word = word.lower()
        return self.pieces[word] if word.isalpha() else b"".join(map(self.pieces.__getitem__, self.split(word)))

    def ids(self, text: str) -> bytes:
        if _ODD.search(text):
            return self._encode(text)
        return b"".join(map(self.known.__getitem__, text.split()))


class SpanEncoder:
    """Start and end of each token in code points, for a byte-level tokenizer with the usual splitting pattern."""

    def __init__(self, path: str, pattern: str, special: tuple[str, ...] = ("<|endoftext|>",)):
        import regex

        self.tokenizer = tokenizer(path)
        self.model = self.tokenizer.model
        self.find = regex.compile(pattern).findall
        self.special = special
        self.known = _Remembered(self._spans)

    def _spans(self, piece: str) -> tuple[int, bytes]:
        sizes = [len(t.value) for t in self.model.tokenize(as_letters(piece))]  # a letter for each byte
        ends = list(accumulate(sizes))
        starts = [0, *ends[:-1]]
        if len(piece) != ends[-1]:
            of = [k for k, c in enumerate(piece) for _ in c.encode()]
            starts, ends = [of[a] for a in starts], [of[b - 1] + 1 for b in ends]
        return len(sizes), struct.pack(f"<{2 * len(sizes)}i", *chain.from_iterable(zip(starts, ends, strict=True)))

    def spans(self, text: str) -> np.ndarray:
        """(n, 2) array of starts and ends."""
        if any(x in text for x in self.special):
            return np.asarray(self.tokenizer.encode(text, add_special_tokens=False).offsets, "<i4").reshape(-1, 2)
        pieces = self.find(text)
        if not pieces:
            return np.zeros((0, 2), "<i4")
        counts, blobs = zip(*map(self.known.__getitem__, pieces), strict=True)
        lengths = np.fromiter(map(len, pieces), np.int64, len(pieces))
        starts = np.cumsum(lengths) - lengths
        return np.frombuffer(b"".join(blobs), "<i4").reshape(-1, 2) + np.repeat(starts, counts)[:, None]
