"""Word splitting and hashing inside tasks. Works on UTF-8 bytes: the rules only name ASCII characters."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash

LOWER = bytes(b + 32 if 0x41 <= b <= 0x5A else b for b in range(256))
# lower-case, and every byte outside 0-9 a-z and the non-ASCII ones becomes a space
ALNUM = bytes(LOWER[b] if b >= 0x80 or chr(b).isalnum() else 0x20 for b in range(256))

_M1, _M2 = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)


def texts(batch: pa.RecordBatch, name: str = "text") -> Iterator[bytes]:
    """The column's texts as UTF-8, null as empty."""
    for value in batch.column(name).cast(pa.binary()):
        yield value.as_py() or b""


def space_words(text: bytes) -> list[bytes]:
    """Words between ASCII white space (x20, x09-x0D), A-Z lower-cased."""
    return text.translate(LOWER).split()


def alnum_words(text: bytes) -> list[bytes]:
    """Runs of 0-9, a-z (A-Z lower-cased) and non-ASCII characters."""
    return text.translate(ALNUM).split()


def mixed(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers whose bits all depend on all."""
    x = (x ^ (x >> np.uint64(30))) * _M1
    x = (x ^ (x >> np.uint64(27))) * _M2
    return x ^ (x >> np.uint64(31))


class WordHashes(dict):
    """64-bit hashes by word, remembered up to a number of words; what is forgotten is hashed again."""

    def __init__(self, most: int = 400_000):
        super().__init__()
        self.most = most

    def __missing__(self, word: bytes) -> int:
        if len(self) >= self.most:
            self.clear()
        value = xxhash.xxh3_64_intdigest(word)
        if len(word) <= 64:
            self[word] = value
        return value

    def of(self, words: list[bytes]) -> np.ndarray:
        return np.fromiter(map(self.__getitem__, words), np.uint64, len(words))
