"""Language identification by nearest centroid.

A text is a unit vector of TF-IDF weights over hashed character n-grams. Each language has a few centroids, found by
spherical k-means among its training texts; the language of the nearest centroid by cosine wins, and a text that is far
from every centroid is rejected. N-grams that training has not met stand apart: they lengthen a text's vector and so lower its
cosine, and do not fall together with known ones. How far is too far follows the training texts of about the same length.

Training reads a sample that `per_lang` and `total` bound, rows alike in key and length included; only the counts of distinct n-grams of its texts reach the driver. Prediction
reads every whole text once, without a shuffle.

Defined cases: a null text, or one without a letter, is `und` with score 0 and rejected; without training rows every
text is. Equal cosines go to the language first in alphabetical order. Repeated rows get equal results. The result
is one struct column, so other columns of the input keep their names and values.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ._spark import thinned
from ._text import LOWER, UPPER, char_kinds, code_points, mix

RESULT = "lang_pred string, score double, rejected boolean"


#: N-grams are told apart by a hash below VOCABULARY, a multiple of `dims`.
VOCABULARY = 1 << 20
#: Training texts that a limit rests on, and octaves of length that have one.
NEAREST, OCTAVES = 50, 40


@dataclass
class LanguageModel:
    langs: list[str]
    """The language of each centroid."""
    centroids: np.ndarray
    idf: np.ndarray
    known: np.ndarray
    """A bit for each n-gram that training has met."""
    strange: float
    """The weight of one that it has not met."""
    reject_below: np.ndarray
    """The least cosine for each octave of a text's number of n-grams."""
    dims: int


def ngrams(text: str | None, orders: tuple[int, ...] = (1, 2, 3)) -> np.ndarray | None:
    """The hash of each n-gram of letters, words bounded by one blank; None if there is no letter."""
    if not text:
        return None
    codes = code_points(f" {text.lower()} ")
    kinds = char_kinds(codes)
    alpha = (kinds == LOWER) | (kinds == UPPER)
    if not alpha.any():
        return None
    codes = np.where(alpha, codes, np.uint32(32))
    keep = np.ones(len(codes), bool)
    keep[1:] = alpha[1:] | alpha[:-1]
    codes = codes[keep].astype(np.uint64)
    out = []
    for n in orders:
        if len(codes) >= n:
            gram = codes[: len(codes) - n + 1] + np.uint64(n << 56)
            for k in range(1, n):
                gram = gram * np.uint64(0x9E3779B97F4A7C15) + codes[k : len(codes) - n + 1 + k]
            out.append((mix(gram) % np.uint64(VOCABULARY)).astype(np.int64))
    return np.concatenate(out)


def _weights(grams: np.ndarray, counts: np.ndarray | None, known: np.ndarray, dims: int) -> tuple[np.ndarray, float]:
    """log1p of how often the known n-grams occur, hashed, and the length of that vector for the others."""
    met = known[grams]
    of = lambda at: np.log1p(np.bincount(grams[at] % dims, None if counts is None else counts[at], minlength=dims)).astype(np.float32)
    return of(met), float(np.linalg.norm(of(~met)))


def _octave(size: int) -> int:
    return min(int(size).bit_length(), OCTAVES - 1)


def _limits(sizes: np.ndarray, cosines: np.ndarray, slack: float) -> np.ndarray:
    """For each octave of length `slack` of a low quantile of the cosines of training texts in it, or of the nearest ones,
    and at most of all.

    Texts shorter than those have less to be known by: their limit falls with the root of the length.
    """
    at, out, most = np.log2(sizes), np.zeros(OCTAVES), np.quantile(cosines, 0.005) * slack
    for octave in range(OCTAVES):
        mid = octave - 0.5
        off = np.abs(at - mid)
        own = np.flatnonzero(off <= max(0.5, np.sort(off)[min(NEAREST, len(off)) - 1]))
        out[octave] = min(most, np.quantile(cosines[own], 0.005) * slack * min(1.0, 2.0 ** ((mid + 0.5 - np.median(at[own])) / 2)))
    return out


def _unit(x: np.ndarray) -> np.ndarray:
    return x / np.maximum(np.linalg.norm(x, axis=-1, keepdims=True), 1e-12)


def _spherical_kmeans(x: np.ndarray, k: int, rounds: int = 12) -> np.ndarray:
    """k unit centroids of unit rows, started from rows far apart."""
    c = _unit(x.mean(0, keepdims=True))
    while len(c) < k:
        c = np.vstack([c, x[np.argmin((x @ c.T).max(1))]])
    for _ in range(rounds):
        near = (x @ c.T).argmax(1)
        c = np.vstack([_unit(x[near == j].mean(0)) if (near == j).any() else c[j] for j in range(len(c))])
    return c


def fit(train: DataFrame, text: str = "text", label: str = "lang", key: str = "doc_id", per_lang: int = 400, total: int = 6000, clusters: int = 4, dims: int = 4096, slack: float = 0.5) -> LanguageModel:
    """Learns from about `per_lang` texts of each language, taken by the hash of their key and text, and `total` in all.

    `slack`: a text is rejected below this share of a low quantile of the cosines of training texts about as long as it.
    """
    known = train.where(F.col(label).isNotNull() & F.col(text).isNotNull()).select(F.col(text).alias("t"), F.col(label).cast("string").alias("y"), F.xxhash64(F.col(key), F.length(text)).alias("h"))
    counts = {r["y"]: r["n"] for r in known.groupBy("y").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "y").limit(total).collect()}
    if not counts:
        return LanguageModel([], np.zeros((0, dims), np.float32), np.ones(dims, np.float32), np.packbits(np.zeros(VOCABULARY, bool)), 1.0, np.zeros(OCTAVES), dims)
    each = max(1, min(per_lang, total // len(counts)))
    # a hash between 0 and 1 under the language's share: about `each` rows of it, whatever its size
    share = F.create_map(*[x for y, n in counts.items() for x in (F.lit(y), F.lit(min(1.0, 1.2 * each / n)))])
    picked = known.where((F.col("h") / F.lit(2.0**64) + 0.5) < share[F.col("y")])

    picked = thinned(picked, "y", 2 * each)

    def vectors(batches):
        for b in batches:
            rows = []
            for t, y, h in zip(b["t"], b["y"], b["h"], strict=True):
                if (g := ngrams(t)) is not None:
                    g, c = np.unique(g, return_counts=True)
                    rows.append((y, h, g.astype("<u4").tobytes() + c.astype("<u4").tobytes()))
            yield pd.DataFrame(rows, columns=["y", "h", "v"])

    rows = sorted(((r["y"], r["h"], bytes(r["v"])) for r in picked.mapInPandas(vectors, "y string, h long, v binary").collect()))
    by_lang: dict[str, list[np.ndarray]] = {}
    for y, _, v in rows:
        own = by_lang.setdefault(y, [])
        if len(own) < each:
            own.append(np.frombuffer(v, "<u4").reshape(2, -1))
    met = np.zeros(VOCABULARY, np.int32)
    for own in by_lang.values():
        for grams, _ in own:
            met[grams] += 1
    # what one text alone has is as strange to it as it would be to a new text
    known = met >= (2 if sum(map(len, by_lang.values())) >= NEAREST else 1)
    made = {y: [_weights(grams.astype(np.int64), counts, known, dims) for grams, counts in own] for y, own in by_lang.items()}
    x = np.vstack([v for own in made.values() for v, _ in own]) if made else np.zeros((0, dims), np.float32)
    idf = (np.log((1 + len(x)) / (1 + (x > 0).sum(0))) + 1).astype(np.float32)
    strange = float(np.log(1 + len(x)) + 1)
    langs, centroids, near, sizes = [], [], [], []
    for y, own in made.items():
        w, beside = np.vstack([v for v, _ in own]) * idf, np.array([o for _, o in own]) * strange
        u = _unit(w)
        c = _spherical_kmeans(u, min(clusters, max(2, len(u) // 25), len(u)))
        near.append((w @ c.T).max(1) / np.maximum(np.hypot(np.linalg.norm(w, axis=1), beside), 1e-12))
        sizes += [int(counts.sum()) for _, counts in by_lang[y]]
        langs += [y] * len(c)
        centroids.append(c)
    limits = _limits(np.array(sizes), np.concatenate(near), slack) if near else np.zeros(OCTAVES)
    return LanguageModel(langs, np.vstack(centroids).astype(np.float32) if centroids else np.zeros((0, dims), np.float32), idf, np.packbits(known), strange, limits, dims)


def identify(model: LanguageModel, text: Column) -> Column:
    """A struct of lang_pred, score (the cosine with the nearest centroid) and rejected for each text."""

    @F.pandas_udf(RESULT)
    def nearest(texts: pd.Series) -> pd.DataFrame:
        lang, score = np.full(len(texts), "und", object), np.zeros(len(texts))
        limit = np.zeros(len(texts))
        known = np.unpackbits(model.known).view(bool)
        for i, t in enumerate(texts):
            grams = ngrams(t) if model.langs else None
            if grams is not None:
                v, beside = _weights(grams, None, known, model.dims)
                w = v * model.idf
                cos = model.centroids @ w / max(float(np.hypot(np.linalg.norm(w), beside * model.strange)), 1e-12)
                best = int(cos.argmax())
                lang[i], score[i], limit[i] = model.langs[best], min(1.0, max(0.0, float(cos[best]))), model.reject_below[_octave(len(grams))]
        return pd.DataFrame({"lang_pred": lang, "score": score, "rejected": (lang == "und") | (score < limit)})

    # else a filter on the result would have the texts read twice
    return nearest.asNondeterministic()(text)
