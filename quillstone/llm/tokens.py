"""Token ids of whole texts under a word-level BPE, each word encoded once."""

from __future__ import annotations

import re

import numpy as np
from tokenizers import Tokenizer

#: Texts of plain words: letters outside ASCII besides those listed go to the tokenizer whole.
_PIECES = re.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[a-zß-öø-ÿ]+|[0-9]|[!-/:-@\[-`{-~]+")
_PLAIN = re.compile(r"[\t\n\r\x20-\x7E¡-©«-±´¶-¸»¿À-ÖØ-öø-ÿ]*")
_LATIN_SYMBOL = re.compile(r"[¡-¿×÷]")
_SPECIAL = re.compile(r"<\|(?:startoftext|endoftext)\|>")


def _byte_signs() -> dict[int, int]:
    """Code points by which a byte-level vocabulary writes bytes: printable ones stand for themselves, the others follow from 256 on."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {b: b for b in plain} | {b: 256 + n for n, b in enumerate(rest)}


class _Memory(dict):
    """Packed ids of each piece met, starting anew beyond ``most`` pieces."""

    def __init__(self, model, most: int):
        super().__init__()
        self.model, self.most, self.signs = model, most, _byte_signs()

    def __missing__(self, piece: str) -> bytes:
        if len(self) >= self.most:
            self.clear()
        written = piece if piece.isascii() else piece.encode().decode("latin-1").translate(self.signs)
        found = self[piece] = np.array([t.id for t in self.model.tokenize(written)], "<u4").tobytes()
        return found


class WordTokens:
    """Encodes with memory: the pre-tokenizer's pieces do not depend on each other, so each distinct piece is encoded once.

    Texts with characters for which the split here is not known to be the
    tokenizer's own go to the tokenizer whole.
    """

    def __init__(self, file: str, most: int = 1 << 18):
        self.tokenizer = Tokenizer.from_file(file)
        self.memory = _Memory(self.tokenizer.model, most)

    def encode(self, text: str) -> np.ndarray:
        if not _PLAIN.fullmatch(text) or _LATIN_SYMBOL.search(text) or _SPECIAL.search(text):
            return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, "<u4")
        return np.frombuffer(b"".join(map(self.memory.__getitem__, _PIECES.findall(text.lower()))), "<u4")
