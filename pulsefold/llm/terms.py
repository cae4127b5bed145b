"""Terms of many texts at once: runs of letter bytes, lower-cased in ASCII, as Arrow dictionaries."""

from __future__ import annotations

import numpy as np
import pyarrow as pa

_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[ord("A") : ord("Z") + 1] += 32
_ASCII = np.zeros(256, bool)
for _a in "Aa":
    _ASCII[ord(_a) : ord(_a) + 26] = True
_WIDE = _ASCII.copy()
_WIDE[0x80:] = True


def wide_letters(data: np.ndarray) -> np.ndarray:
    """True for the bytes of A-Z, a-z and of every character beyond ASCII."""
    return _WIDE[data]


def latin_letters(data: np.ndarray) -> np.ndarray:
    """True for the bytes of A-Z, a-z and U+00C0 to U+00FF, which are C3 and a byte that follows it."""
    lead = data == 0xC3
    out = _ASCII[data] | lead
    out[1:] |= lead[:-1]
    return out


def runs(data: np.ndarray, bounds: np.ndarray, letter: np.ndarray) -> tuple[np.ndarray, pa.DictionaryArray]:
    """(text of each run, the runs): maximal runs of `letter` bytes within the texts that `bounds` separates."""
    edge = np.zeros(len(data) + 1, bool)
    edge[bounds] = True
    first = letter.copy()
    first[1:] &= ~letter[:-1] | edge[1:-1]
    start = np.flatnonzero(first)
    solid = np.ascontiguousarray(_LOWER[data[letter]])
    ends = np.append((np.cumsum(letter) - 1)[start], len(solid)).astype(np.int64)
    words = pa.LargeStringArray.from_buffers(len(start), pa.py_buffer(ends), pa.py_buffer(solid))
    return np.searchsorted(bounds, start, "right") - 1, words.dictionary_encode()
