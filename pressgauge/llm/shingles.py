"""Words and five-word shingles of a batch of texts as 64-bit hashes, without a Python loop over words.

A word is a run of letters, digits, marks and underscores of the lower-case text, so blanks, quotes and dashes of any kind
separate. Scripts that are written without blanks have no such runs: there each character is a word.
"""

from __future__ import annotations

import unicodedata

import numpy as np

WORDS = 5
_BASE, _STEP = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xD6E8FEB86659FD93)
#: Code points whose class is looked up; those beyond (rare Han, private use) are words of one character.
_KNOWN = 0x30000
# First and last code points of scripts written without blanks (Thai to Tibetan, Myanmar, Khmer, kana, Han).
_UNSPACED = ((0xE00, 0xFFF), (0x1000, 0x109F), (0x1780, 0x17FF), (0x3040, 0x30FF), (0x3400, 0x4DBF), (0x4E00, 0x9FFF), (0xF900, 0xFAFF), (0x20000, 0x2FFFF))
_CLASS: list[np.ndarray] = []
_POWERS: dict[str, np.ndarray] = {}


def mix(z: np.ndarray) -> np.ndarray:
    z = (z ^ (z >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    z = (z ^ (z >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return z ^ (z >> np.uint64(31))


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """B^i and B^-i modulo 2^64."""
    if len(_POWERS.get("b", ())) < n:
        size = max(1 << 16, 1 << (n - 1).bit_length())
        for name, base in (("b", int(_BASE)), ("inv", pow(int(_BASE), -1, 1 << 64))):
            step = np.full(size, base, np.uint64)
            step[0] = 1
            _POWERS[name] = np.multiply.accumulate(step)
    return _POWERS["b"][:n], _POWERS["inv"][:n]


def prefix_hash(b: np.ndarray) -> np.ndarray:
    """P with P[j] - P[i] = B^i times the hash of bytes i .. j."""
    out = np.zeros(len(b) + 1, np.uint64)
    np.cumsum((b.astype(np.uint64) + np.uint64(1)) * powers(len(b))[0], out=out[1:])
    return out


def classes_of(a: np.ndarray) -> np.ndarray:
    """0 for separators, 1 for characters of spaced words, 2 for words of one character."""
    if not _CLASS:
        table = np.array([unicodedata.category(chr(i))[0] in "LNM" or i == 95 for i in range(_KNOWN)], np.uint8)
        for lo, hi in _UNSPACED:
            table[lo : hi + 1] *= 2
        _CLASS.append(np.append(table, np.uint8(2)))
    return _CLASS[0][np.minimum(a, _KNOWN)]


def words(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
    """(document number, hash) of every lower-case word in order."""
    low = [(t or "").lower() for t in texts]
    a = np.frombuffer(("\n".join(low) + "\n").encode("utf-32-le", "surrogatepass"), np.uint32)
    kind = classes_of(a)
    before = np.concatenate([[0], kind[:-1]])
    start = np.flatnonzero((kind == 2) | ((kind == 1) & (before != 1)))
    if not len(start):
        return np.zeros(0, np.int64), np.zeros(0, np.uint64)
    after = np.concatenate([kind[1:], [0]])
    end = np.flatnonzero((kind == 2) | ((kind == 1) & (after != 1))) + 1
    p = prefix_hash(a)
    h = mix((p[end] - p[start]) * powers(len(a))[1][start] + (end - start).astype(np.uint64))
    doc = np.searchsorted(np.cumsum([len(t) + 1 for t in low]), start, side="right")
    return doc, h


def identity(n_docs: int, doc: np.ndarray, h: np.ndarray) -> np.ndarray:
    """One hash of each document's word sequence; 0 for no words."""
    n = np.bincount(doc, minlength=n_docs)
    first = np.cumsum(n) - n
    out = np.zeros(n_docs, np.uint64)
    if len(h):
        place = powers(int(n.max()) + 1)[0][np.arange(len(h)) - first[doc]]
        has = n > 0
        out[has] = mix(np.add.reduceat(h * place, first[has]) + n[has].astype(np.uint64))
    return out


def shingles(n_docs: int, doc: np.ndarray, h: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Sorted distinct (document number, shingle) with counts; a text under five words is one shingle."""
    n = np.bincount(doc, minlength=n_docs)
    same = np.flatnonzero(doc[: len(doc) - WORDS + 1] == doc[WORDS - 1 :]) if len(doc) >= WORDS else np.zeros(0, np.int64)
    s = np.zeros(len(same), np.uint64)
    for j in range(WORDS):
        s = s * _STEP + h[same + j]
    d = doc[same]
    short = np.flatnonzero((n > 0) & (n < WORDS))
    if len(short):
        first = np.cumsum(n) - n
        extra = np.zeros(len(short), np.uint64)
        for j in range(WORDS - 1):
            more = n[short] > j
            extra[more] = extra[more] * _STEP + h[first[short[more]] + j]
        s, d = np.concatenate([s, extra]), np.concatenate([d, short])
    s = mix(s)
    order = np.lexsort((s, d))
    s, d = s[order], d[order]
    new = np.flatnonzero(np.concatenate([[True], (s[1:] != s[:-1]) | (d[1:] != d[:-1])])) if len(s) else np.zeros(0, np.int64)
    return d[new], s[new], np.diff(np.append(new, len(s)))
