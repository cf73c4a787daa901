"""Words, shingles and 64-bit hashes, vectorised over a batch of texts."""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pandas as pd

WORD = re.compile(r"\w+")
_STEP = np.uint64(0x9E3779B97F4A7C15)


def mix(x: np.ndarray) -> np.ndarray:
    """Finalises 64-bit hashes so that all bits, also the high ones, look random (splitmix64's finaliser)."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def seeded(seed: int, x: np.ndarray) -> np.ndarray:
    """An independent 64-bit hash of x for each seed."""
    return mix(x + np.uint64(((seed + 1) * 0x9E3779B97F4A7C15) & 0xFFFFFFFFFFFFFFFF))


def words(text: str | None) -> list[str]:
    """Lower-cased runs of letters, digits and underscores."""
    return WORD.findall(text.lower()) if text else []


def hash_words(tokens: list[str]) -> np.ndarray:
    if not tokens:
        return np.zeros(0, np.uint64)
    return pd.util.hash_array(np.array(tokens, dtype=object), categorize=True)


def groups(texts, limit: int = 500_000) -> Iterator[tuple[int, int]]:
    """Ranges of a batch holding about `limit` characters each, so that the arrays made from them stay small."""
    start, size = 0, 0
    for i, t in enumerate(texts):
        size += len(t) if t else 0
        if size >= limit:
            yield start, i + 1
            start, size = i + 1, 0
    if start < len(texts):
        yield start, len(texts)


def word_hashes(texts) -> tuple[np.ndarray, np.ndarray]:
    """The texts' word hashes in one array, and each text's first place in it (one more at the end)."""
    tokens: list[str] = []
    at = [0]
    for t in texts:
        tokens += words(t)
        at.append(len(tokens))
    return hash_words(tokens), np.array(at, np.int64)


def shingles(h: np.ndarray, at: np.ndarray, n: int = 5) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all n-word shingles and each text's first place in them; a text of 1 to n-1 words has one shingle of all its words."""
    count = np.diff(at)
    made = np.where(count >= n, count - n + 1, np.minimum(count, 1))
    to = np.concatenate([[0], np.cumsum(made)])
    if not to[-1]:
        return np.zeros(0, np.uint64), to
    padded = np.concatenate([h, np.zeros(n, np.uint64)])
    start = np.repeat(at[:-1] - to[:-1], made) + np.arange(to[-1])
    short = np.repeat(np.where(count < n, count, n), made)
    out = np.zeros(len(start), np.uint64)
    for k in range(n):
        out = mix(out * _STEP + np.where(k < short, padded[start + k], np.uint64(k)))
    return out, to

#: Kinds of characters as `char_kinds` numbers them.
OTHER, LOWER, UPPER, DIGIT, SPACE = range(5)


def _kind(c: str) -> int:
    return (UPPER if c.isupper() else LOWER) if c.isalpha() else DIGIT if c.isdigit() else SPACE if c.isspace() else OTHER


_KINDS = np.array([_kind(chr(i)) for i in range(0x800)], np.uint8)


def char_kinds(codes: np.ndarray) -> np.ndarray:
    """The kind of each code point; those outside the table are looked up once for each distinct one."""
    high = codes >= 0x800
    out = _KINDS[np.where(high, 0, codes)]
    if high.any():
        seen, at = np.unique(codes[high], return_inverse=True)
        out[high] = np.array([_kind(chr(i)) for i in seen], np.uint8)[at]
    return out


def code_points(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le"), np.uint32)
