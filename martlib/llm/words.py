"""Words and word windows of whole texts as 64-bit numbers, for use inside tasks.

Texts are handled as UTF-8 bytes. A block is a run of texts laid end to end in one array,
so numpy works on long arrays however short the texts are; a text longer than a block is
a block by itself.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash

# Words per block and remembered word hashes: bounds on a task's memory, not on the data.
BLOCK_WORDS = 200_000
CACHED_WORDS = 400_000

_MUL = np.uint64(0x9E3779B97F4A7C15)
_MUL2 = np.uint64(0xC2B2AE3D27D4EB4F)
_S29, _S32 = np.uint64(29), np.uint64(32)

# ASCII letters in lower case, digits and all bytes beyond ASCII stay; the rest separates.
ALNUM = bytes(
    c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c >= 128 else 32
    for c in range(256)
)


class WordHashes(dict):
    """Hash of each word, remembered; forgets everything when full."""

    def __missing__(self, word: bytes) -> int:
        if len(self) >= CACHED_WORDS:
            self.clear()
        made = self[word] = xxhash.xxh3_64_intdigest(word)
        return made

    def of(self, words: list[bytes]) -> np.ndarray:
        return np.fromiter(map(self.__getitem__, words), np.uint64, len(words))


def texts_of(column: pa.Array) -> list[bytes | None]:
    """A text column as bytes; null stays None."""
    return column.cast(pa.large_binary()).to_pylist()


def space_words(text: bytes | None, lower: bool = False) -> list[bytes]:
    """Runs of anything but blank, tab, line feed, vertical tab, form feed and return."""
    if text is None:
        return []
    return (text.lower() if lower else text).split()


def alnum_words(text: bytes | None) -> list[bytes]:
    return [] if text is None else text.translate(ALNUM).split()


def mix(h: np.ndarray) -> np.ndarray:
    h = h ^ (h >> _S32)
    h = h * _MUL
    return h ^ (h >> _S29)


def joined(left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """Hash of a sequence from the hashes of its two halves; order counts."""
    return mix(left * _MUL2 + (right ^ (right >> _S29)))


def window_hashes(h: np.ndarray, k: int) -> np.ndarray:
    """Hash of each k consecutive numbers, by doubling: one entry per starting place."""
    n = len(h) - k + 1
    if n <= 0:
        return h[:0]
    out, done, power, size = None, 0, h, 1
    while True:
        if k & size:
            part = power[done : done + n]
            out = mix(part) if out is None else joined(out, part)
            done += size
        if done == k:
            return out
        power = joined(power[:-size], power[size:])
        size *= 2


def blocks(word_lists):
    """Groups (number of the first text, lists of words) of about BLOCK_WORDS words."""
    first, held, total = 0, [], 0
    for i, words in enumerate(word_lists):
        if held and total + len(words) > BLOCK_WORDS:
            yield first, held
            first, held, total = i, [], 0
        held.append(words)
        total += len(words)
    if held:
        yield first, held


def starts_of(held: list[list]) -> np.ndarray:
    """Where each text of a block starts, and the end of the last."""
    at = np.zeros(len(held) + 1, np.int64)
    np.cumsum([len(w) for w in held], out=at[1:])
    return at


def flat(held: list[list[bytes]]) -> list[bytes]:
    out: list[bytes] = []
    for words in held:
        out += words
    return out
