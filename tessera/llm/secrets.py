"""Secret scanning: fixed patterns, and sliding-window Shannon entropy per character class with an allow-list.

Patterns (kinds `assign`, `access`, `hex`) are found leftmost and non-overlapping over the whole text. The entropy
method looks at candidate strings (long runs of token characters) and at the runs of each character class inside
them; a window of fixed length slides along a run, its entropy kept up to date by adding the entering and removing the
leaving character. A run with a window over the class's threshold is a span of kind `entropy_<class>`, from end to end,
unless the allow-list knows the candidate or the window. What a pattern's span covers of a candidate is left out, and
each class is asked over all the rest, so spans of different classes may overlap; `redact` takes their union.

Each text is scanned once where it lies: no shuffle, and memory for one batch. Spans are code points, end exclusive.
Defined cases: a null text is empty and has no spans; equal texts have equal spans; other columns are untouched,
because the result is one struct column.
"""

from __future__ import annotations

import hashlib
import re
from dataclasses import dataclass, field
from math import log2

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

# The patterns that the contract states.
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.IGNORECASE | re.ASCII)
ACCESS = re.compile(r"AKIA[A-Z0-9]{16,}")
HEX = re.compile(r"[0-9a-f]{24,}")
KINDS = ("assign", "access", "hex", "entropy_hex", "entropy_alnum", "entropy_base64")

CANDIDATE = re.compile(r"[A-Za-z0-9+/_=-]{20,}")


@dataclass(frozen=True)
class EntropyClass:
    kind: str
    run: str
    window: int
    bits: float


@dataclass(frozen=True)
class ScanConfig:
    classes: tuple[EntropyClass, ...] = (
        EntropyClass("entropy_hex", r"[0-9A-Fa-f]+", 20, 3.0),
        EntropyClass("entropy_alnum", r"[0-9A-Za-z]+", 20, 3.7),
        EntropyClass("entropy_base64", r"[0-9A-Za-z+/_=-]+", 24, 4.0),
    )
    # What never counts as a secret by its entropy alone, besides what `like_words` takes for words.
    allow: tuple[str, ...] = field(
        default=(
            r"[0-9]+",  # numbers
            r"[0-9A-Fa-f]{8}-(?:[0-9A-Fa-f]{4}-){3}[0-9A-Fa-f]{12}",  # UUIDs
            r"[-=_+/]+",  # rules and fillers
        )
    )


#: Letters alone, in words joined by a sign: identifiers, paths; the pieces that their cases make; a long run of consonants.
LETTERS = re.compile(r"[A-Za-z]+(?:[-_/][A-Za-z]+)*")
PIECE = re.compile(r"[A-Z]+(?![a-z])|[A-Z]?[a-z]+")
CONSONANTS = re.compile(r"[b-df-hj-np-tv-xz]{7}", re.IGNORECASE)


def like_words(s: str) -> bool:
    """Letters that read as words: cases change inside a word at most once in five letters, and vowels are spread among them."""
    if not LETTERS.fullmatch(s):
        return False
    joints = len(re.findall("[-_/]", s))
    letters = len(s) - joints
    return (len(PIECE.findall(s)) - 1 - joints) * 5 <= letters and sum(c in "aeiouyAEIOUY" for c in s) * 4 >= letters and not CONSONANTS.search(s)


def window_entropies(run: str, window: int) -> list[float]:
    """Shannon entropy, in bits, of each window of a run; the sum of c log2 c changes by the two characters that move."""
    part = [0.0] + [c * log2(c) for c in range(1, window + 1)]
    count: dict[str, int] = {}
    total = 0.0
    out = []
    for i, c in enumerate(run):
        n = count.get(c, 0)
        total += part[n + 1] - part[n]
        count[c] = n + 1
        if i >= window:
            old = run[i - window]
            n = count[old]
            total += part[n - 1] - part[n]
            count[old] = n - 1
        if i >= window - 1:
            out.append(log2(window) - total / window)
    return out


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, kind, end) of the fixed patterns."""
    found = [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if m.end(2) - m.start(2) >= 6]
    found += [(m.start(), 1, m.end()) for m in ACCESS.finditer(text)]
    found += [(m.start(), 2, m.end()) for m in HEX.finditer(text)]
    return sorted(found)


def outside(start: int, end: int, base: list[tuple[int, int, int]]) -> list[tuple[int, int]]:
    """The parts of start to end that no span of `base`, sorted by start, covers."""
    parts = []
    for s, _, e in base:
        if e <= start or s >= end:
            continue
        if s > start:
            parts.append((start, s))
        start = e
    return [*parts, (start, end)] if start < end else parts


def entropy_spans(text: str, base: list[tuple[int, int, int]], config: ScanConfig) -> list[tuple[int, int, int]]:
    allow = re.compile("|".join(f"(?:{a})" for a in config.allow))
    allowed = lambda s: allow.fullmatch(s) or like_words(s.strip("-_/=+"))
    found = []
    for m in CANDIDATE.finditer(text):
        if allowed(m[0]):
            continue
        for start, end in outside(m.start(), m.end(), base):
            part = text[start:end]
            if allowed(part):
                continue
            for c in config.classes:
                own: list[tuple[int, int, int]] = []
                for r in re.finditer(c.run, part):
                    if r.end() - r.start() < c.window or allowed(r[0]):
                        continue
                    # one window over the threshold takes its whole run, so that no part of a key is left
                    if any(e >= c.bits and not allowed(r[0][i : i + c.window]) for i, e in enumerate(window_entropies(r[0], c.window))):
                        own.append((start + r.start(), KINDS.index(c.kind), start + r.end()))
                found += own
    return found


def _text_of(spans) -> str:
    return ",".join(f"{KINDS[k]}:{s}:{e}" for s, k, e in spans)


def scan_text(text: str | None, config: ScanConfig = ScanConfig()) -> tuple[list, list]:
    """The base spans, and all spans, each sorted by start and kind."""
    base = base_spans(text) if text else []
    return base, sorted(base + entropy_spans(text, base, config)) if text else []


def scan(text: Column, config: ScanConfig = ScanConfig()) -> Column:
    """A struct for each text: counts of the base kinds, the digest of the base spans, and all spans as text."""

    @F.pandas_udf("n_assign long, n_access long, n_hex long, base_sha256 string, spans string, n_spans long")
    def find(texts: pd.Series) -> pd.DataFrame:
        rows = []
        for t in texts:
            base, every = scan_text(t, config)
            n = np.bincount([k for _, k, _ in base], minlength=3)
            rows.append((n[0], n[1], n[2], hashlib.sha256(_text_of(base).encode()).hexdigest(), _text_of(every), len(every)))
        return pd.DataFrame(rows, columns=["n_assign", "n_access", "n_hex", "base_sha256", "spans", "n_spans"])

    return find(text)


def redact(text: Column, config: ScanConfig = ScanConfig(), mark: str = "[SECRET]") -> Column:
    """The text with each joined run of overlapping spans replaced by `mark`; a null text stays null."""

    @F.pandas_udf("string")
    def clean(texts: pd.Series) -> pd.Series:
        out = []
        for t in texts:
            parts, at = [], 0
            for s, _, e in scan_text(t, config)[1]:
                if s >= at:
                    parts += [t[at:s], mark]
                at = max(at, e)
            out.append("".join(parts) + t[at:] if parts else t)
        return pd.Series(out, dtype=object)

    return clean(text)
