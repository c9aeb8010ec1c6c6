"""Byte-level BPE ids of whole texts, by pieces between spaces that are encoded once and remembered."""

from __future__ import annotations

import base64
import re
from array import array

import numpy as np

#: Remembered pieces per worker; the table is emptied beyond this, which changes speed only.
CACHE = 400_000
# A space between other white space is merged with its neighbours, so there the text cannot be cut.
_MERGES = re.compile(r"\s \s|\s \Z|\A \s|\A \Z")
# Most texts have no white space but single blanks and line ends, which is quick to see.
_OTHER = re.compile(r"[^\S \n]")


def _merges(text: str) -> bool:
    if "  " in text or "\n " in text or text[0] == " " or text[-1] == " " or _OTHER.search(text):
        return bool(_MERGES.search(text))
    return False


class _Ids(dict):
    def __init__(self, encode):
        super().__init__()
        self.encode = encode

    def __missing__(self, piece: str) -> bytes:
        # A line end between words and a mark after a letter are pieces of their own: joined, never remembered together.
        if not piece:
            return b""
        if "\n" in piece:
            a, _, b = piece.partition("\n")
            if a and b and not a[-1].isspace() and not b[0].isspace():
                return self[a] + self["\n"] + self[b]
        if len(piece) > 2 and piece[-1] in ".," and piece[-2].isalpha():
            return self[piece[:-1]] + self[piece[-1]]
        ids = array("I", self.encode(piece)).tobytes()
        if len(piece) <= 64:
            if len(self) >= CACHE:
                self.clear()
            self[piece] = ids
        return ids


def encoder(path: str):
    """A function from texts to uint32 ids for the ranks file at ``path``; special strings are ordinary text."""
    import public_tokenizers
    import tiktoken

    with open(path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    ids = _Ids(tiktoken.Encoding("ranks", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={}).encode_ordinary)

    def encode(texts: list[str]) -> list[np.ndarray]:
        out = []
        for t in texts:
            if not t:
                out.append(np.zeros(0, np.uint32))
            elif _merges(t):
                out.append(np.array(ids.encode(t), np.uint32))
            else:
                # Pieces keep the blank before them; a mark that the text does not hold cuts there.
                pieces = t.replace(" ", "\0 ").split("\0") if "\0" not in t else [x if i == 0 else " " + x for i, x in enumerate(t.split(" "))]
                out.append(np.frombuffer(b"".join(map(ids.__getitem__, pieces)), np.uint32))
        return out

    return encode
