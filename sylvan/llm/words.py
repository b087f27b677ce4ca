"""Words of whole texts as arrays, shared by the text operators."""
from __future__ import annotations

import re

import numpy as np
import regex

#: Runs of letters or digits, and runs of letters, in text that is already in lower case. ``\\w`` without digits would still
#: hold fractions and superscripts, so letters are matched by their Unicode category.
WORD = re.compile(r"[^\W_]+")
LETTERS = regex.compile(r"\p{L}+")
NONE = np.uint64(0xFFFFFFFFFFFFFFFF)
_ODD = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F, 0xE7037ED1A0B428DB, 0x8EBC6AF09C88C6E3, 0x589965CC75374CC3], dtype=np.uint64)


def shingle_hashes(words: np.ndarray, k: int) -> np.ndarray:
    """64-bit hashes of every k consecutive word hashes; NONE where a word hash is 0, which stands for no word."""
    n = len(words) - k + 1
    if n <= 0:
        return np.empty(0, np.uint64)
    h = np.zeros(n, np.uint64)
    bad = np.zeros(n, bool)
    zero = words == 0
    for j in range(k):
        h = (h ^ words[j : j + n]) * _ODD[j % len(_ODD)]
        h ^= h >> np.uint64(31)
        bad |= zero[j : j + n]
    h[bad] = NONE
    return h


def window_min(h: np.ndarray, w: int) -> np.ndarray:
    """Smallest of every w consecutive values, in log(w) passes."""
    n, width = len(h) - w + 1, 1
    if n <= 0:
        return np.empty(0, h.dtype)
    while width * 2 <= w:
        h = np.minimum(h[:-width], h[width:])
        width *= 2
    return np.minimum(h[:n], h[w - width : w - width + n]) if w > width else h
