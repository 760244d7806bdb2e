"""Token ids of whole texts by a public byte-level BPE tokenizer, inside tasks.

The tokenizer cuts a text into pieces before it merges bytes, and no piece spans a blank that
stands between two characters of which one is not white space. So a text without blanks amid or
after white space splits at its blanks, each chunk is tokenised once and its ids are remembered.
Texts with such blanks, or with the end-of-text marker written out, go to the tokenizer whole.
"""

from __future__ import annotations

import os
import re
from array import array

import numpy as np

EOD = 0
BPE_FILE = "byte_bpe_50k.json"

# Remembered chunks and unknown chunks tokenised at once: bounds on a task's memory.
CACHED_CHUNKS = 1_200_000
_WHOLE = re.compile(r"\s (?!\S)|<\|endoftext\|>|\0")

# Marks that end words; none can start a piece with letters.
_MARKS = ".,;:!?$%&*#|"


def _byte_letters() -> dict[int, str]:
    """Byte-level BPE writes each byte as one printable character: itself where it is one,
    else the next free character from U+0100 on."""
    plain = {*range(33, 127), *range(161, 173), *range(174, 256)}
    others = [b for b in range(256) if b not in plain]
    return {b: chr(b) for b in plain} | {b: chr(256 + i) for i, b in enumerate(others)}


_BYTE_LETTERS = _byte_letters()


def default_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path(BPE_FILE)


def shared_tokenizer(spark, path: str | None = None):
    """The tokenizer file's content (a few MB whatever the data) as a broadcast.

    A Python worker keeps its copy as long as it lives, and with it the encoder made of it, so
    later tasks of a worker know the chunks of earlier ones.
    """
    with open(path or default_tokenizer(), encoding="utf-8") as file:
        return spark.sparkContext.broadcast({"definition": file.read()})


def encoder_of(shared, literal: bool = False) -> Encoder:
    """This worker's encoder of a broadcast tokenizer."""
    held = shared.value
    if literal not in held:
        held[literal] = Encoder(held["definition"], literal)
    return held[literal]


class Encoder:
    """Ids of texts as little-endian unsigned 32-bit bytes.

    ``literal``: the end-of-text marker written out in a text is ordinary text.
    """

    def __init__(self, definition: str, literal: bool = False):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_str(definition)
        self.tokenizer.encode_special_tokens = literal
        self.model = self.tokenizer.model
        self.known: dict[str, bytes] = {}

    def _whole(self, texts: list[str]) -> list[bytes]:
        made = self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)
        return [array("I", x.ids).tobytes() for x in made]

    def _learn(self, chunks: list[str]) -> None:
        known = self.known
        new = [c for c in set(chunks) if c not in known]
        if len(known) + len(new) > CACHED_CHUNKS:
            known.clear()
            new = list(set(chunks))
        rest = []
        for chunk in new:
            word = chunk.rstrip(_MARKS)
            if not (word[1:].isalpha() and (word[0] == " " or word[0].isalpha())):
                rest.append(chunk)
                continue
            # A blank and letters are one piece, a run of marks after them is another.
            ids = known.get(word)
            if ids is None:
                letters = word.encode().decode("latin-1").translate(_BYTE_LETTERS)
                ids = known[word] = array("I", [t.id for t in self.model.tokenize(letters)]).tobytes()
            if len(word) < len(chunk):
                marks = chunk[len(word) :]
                if marks not in known:
                    known[marks] = self._whole([marks])[0]
                known[chunk] = ids + known[marks]
        known.update(zip(rest, self._whole(rest)))

    def encode(self, text: str) -> bytes:
        if _WHOLE.search(text):
            return self._whole([text])[0]
        chunks = text.replace(" ", "\0 ").split("\0")
        try:
            return b"".join(map(self.known.__getitem__, chunks))
        except KeyError:
            self._learn(chunks)
        return b"".join(map(self.known.__getitem__, chunks))

    def document(self, text: str | None, end: int = EOD) -> np.ndarray:
        """Ids of a text and the end-of-document id; null is empty."""
        return np.frombuffer((self.encode(text) if text else b"") + end.to_bytes(4, "little"), "<u4")
