"""Quality classification by Bradley-Terry pairwise ranking.

Each document has a latent score w.x over its text features. Of all pairs of one document labelled good and one labelled
bad, w is fitted so that sigmoid(w.(x_good - x_bad)), the modelled chance that the good one wins, is likely: logistic
loss on feature differences, with an L2 term, by Newton steps. The threshold is a quantile of the training documents'
scores, at the share of bad labels (or a given one); scores are moved and scaled so that the threshold becomes `cut`.

Every labelled document takes part, with every document of the other class. No pair is a row: in each step documents are
counted by class and bin of their score (1/32 wide, with the mean of their features), two bins stand for all their pairs,
and the second moments are summed where the rows lie. The threshold is the exact value at its rank. Texts are not
shuffled: they are described once where they lie, and what is joined, kept and scored are the features.

Defined cases: a null text scores as an empty one; a label that is null or neither 0 nor 1, or whose document is
missing, is not used; labels repeated for a key count once; without both classes every score is `cut`. Equal texts get
equal scores. The result is one column, so other columns keep their names and values.
"""

from __future__ import annotations

from collections import Counter
from dataclasses import dataclass
from math import ceil, log, log1p

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ._spark import cut as computed
from ._spark import few, thinned
from ._text import DIGIT, LOWER, UPPER, char_kinds, code_points

FEATURES = ("log_words", "word_length", "long_words", "upper_words", "upper_letters", "letters", "digits", "symbols", "signs_at_ends", "bare_signs", "distinct_words", "distinct_pairs", "top_word", "same_as_before", "distinct_lines", "stops", "empty")


def features(text: str | None) -> list[float]:
    """Shares and counts of a whole text, each finite also for an empty one."""
    words = text.split() if text else []
    if not words:
        return [0.0] * (len(FEATURES) - 1) + [1.0]
    n, size = len(words), len(text)
    inner = sum(map(len, words))
    count = Counter(words)
    kinds = np.bincount(char_kinds(code_points(text)), minlength=5).tolist()
    letters, upper, digits = kinds[LOWER] + kinds[UPPER], kinds[UPPER], kinds[DIGIT]
    stops = text.count(".") + text.count(",")
    lines = [x for x in text.split("\n") if x]
    return [
        log1p(n),
        log1p(inner / n),
        sum(len(w) > 20 for w in words) / n,
        sum(map(str.isupper, words)) / n,
        upper / max(1, letters),
        letters / size,
        digits / size,
        (inner - letters - digits - stops) / inner,
        sum(not w[-1].isalnum() and w[-1] not in ".,;:!?" for w in words) / n,
        sum(not any(map(str.isalnum, w)) for w in words) / n,
        log(len(count) / n) / log(n + 1),
        log(max(1, len(set(zip(words, words[1:], strict=False)))) / n) / log(n + 1),
        max(count.values()) / n if n > 3 else 0.0,
        sum(a == b for a, b in zip(words, words[1:], strict=False)) / n,
        len(set(lines)) / max(1, len(lines)),
        stops / n,
        0.0,
    ]


@dataclass
class QualityModel:
    mean: np.ndarray
    scale: np.ndarray
    w: np.ndarray
    threshold: float
    steepness: float
    cut: float

    def scores(self, x: np.ndarray) -> np.ndarray:
        z = ((x - self.mean) / self.scale) @ self.w - self.threshold
        return 1 / (1 + np.exp(-np.clip(self.steepness * z + log(self.cut / (1 - self.cut)), -500, 500)))


#: Bins of a score for each unit, and the last bin either side; a step under STILL ends the fit, as bins tell no less.
FINENESS, LAST, STILL = 32, 2048, 1e-4


def pair_sums(n: tuple[np.ndarray, np.ndarray], m: tuple[np.ndarray, np.ndarray], w: np.ndarray) -> tuple[np.ndarray, np.ndarray, list[np.ndarray]]:
    """Of all pairs of a good and a bad row, from the bins' numbers and mean features (bad, good): the mean gradient, the
    mean mixed second moments, and each bin's weight of a row's own second moments."""
    (bad, good), (low, high) = [x / x.sum() for x in n], m
    gradient, mixed = np.zeros(len(w)), np.zeros((len(w), len(w)))
    weight = [np.zeros(len(bad)), np.zeros(len(good))]
    for at in range(0, len(good), 512):
        part = slice(at, at + 512)
        p = 1 / (1 + np.exp(np.clip((high[part] @ w)[:, None] - (low @ w)[None, :], -500, 500)))  # the bad one wins
        lost = good[part, None] * bad[None, :] * p
        gradient += lost.sum(1) @ high[part] - lost.sum(0) @ low
        lost *= 1 - p
        mixed += high[part].T @ (lost @ low)
        weight[1][part] = lost.sum(1) / n[1][part]
        weight[0] += lost.sum(0) / n[0]
    return gradient, mixed, weight


def linear(x: Column, by: np.ndarray, offset: float) -> Column:
    return sum((x[i] * float(v) for i, v in enumerate(by)), F.lit(float(offset)))


def bradley_terry(rows: DataFrame, mean: np.ndarray, scale: np.ndarray, ridge: float, steps: int = 25) -> np.ndarray:
    """w of the model over all pairs of a good and a bad row of (y, x)."""
    size = len(mean)
    w = np.zeros(size)
    sums = [F.sum(F.col("x")[i]).alias(f"x{i}") for i in range(size)]
    for _ in range(steps):
        at = F.round(F.greatest(F.lit(-LAST), F.least(F.lit(LAST), FINENESS * linear(F.col("x"), w / scale, -(mean / scale) @ w)))).cast("int")
        rows_ = rows.select("y", at.alias("bin"), "x")
        # a row for each class and bin
        bins = rows_.groupBy("y", "bin").agg(F.count("*").alias("n"), *sums).orderBy("y", "bin").toPandas()
        sides = [bins[bins["y"] == y] for y in (0, 1)]
        n = tuple(s["n"].to_numpy(float) for s in sides)
        m = tuple((s[[f"x{i}" for i in range(size)]].to_numpy(float) / k[:, None] - mean) / scale for s, k in zip(sides, n, strict=True))
        gradient, mixed, weight = pair_sums(n, m, w)
        places = [s["bin"].to_numpy() for s in sides]

        def moments(batches, places=places, weight=weight):
            total = np.zeros((size, size))
            for b in batches:
                u = (b.column("x").flatten().to_numpy(zero_copy_only=False).reshape(-1, size) - mean) / scale
                y, bin_ = (b.column(c).to_numpy(zero_copy_only=False) for c in ("y", "bin"))
                h = np.zeros(len(u))
                for side in (0, 1):
                    own = y == side
                    h[own] = weight[side][np.searchsorted(places[side], bin_[own])]
                total += (u * h[:, None]).T @ u
            yield pa.RecordBatch.from_pydict({"s": pa.array([total.ravel().tolist()], pa.list_(pa.float64()))})

        own = sum(np.array(r["s"]) for r in rows_.mapInArrow(moments, "s array<double>").collect()).reshape(size, size)  # a row for each task
        step = np.linalg.solve(own - mixed - mixed.T + ridge * np.eye(size), gradient - ridge * w)
        w = w + step
        if np.abs(step).max() < STILL:
            break
    return w


def at_rank(values: DataFrame, rank: int, most: int = 10_000) -> float:
    """The value of column z at a rank from 0: its range is counted by buckets and narrowed to the rank's, until the rows
    there are few."""
    low, high, n = values.agg(F.min("z"), F.max("z"), F.count("*")).first()
    z, below = F.col("z"), 0
    while n > most and low < high:
        bucket = F.least(F.floor((z - low) / ((high - low) / 1024)), F.lit(1023))
        for r in values.where(z.between(low, high)).groupBy(bucket.alias("b")).agg(F.count("*").alias("n"), F.min("z").alias("low"), F.max("z").alias("high")).orderBy("b").collect():
            if below + r["n"] > rank:
                low, high, n = r["low"], r["high"], r["n"]
                break
            below += r["n"]
    return low if low == high else sorted(r["z"] for r in values.where(z.between(low, high)).collect())[rank - below]


def fit(docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", label: str = "quality", per_class: int | None = None, ridge: float = 1e-3, quantile: float | None = None, cut: float = 0.3) -> QualityModel:
    """The model of texts; see `learn`."""
    return learn(docs.select(F.col(key), description(F.col(text)).alias("x")), labels, key, label, per_class, ridge, quantile, cut)


def learn(described: DataFrame, labels: DataFrame, key: str = "doc_id", label: str = "quality", per_class: int | None = None, ridge: float = 1e-3, quantile: float | None = None, cut: float = 0.3) -> QualityModel:
    """The model of (key, x) and labels: from all labelled rows, or where `per_class` is given from those of about so many
    keys of each class, thinned out to about twice that where keys repeat."""
    known = labels.where(F.col(label).isin(0, 1) & F.col(key).isNotNull()).select(F.col(key).alias("k"), F.col(label).cast("int").alias("y")).distinct()
    if per_class:
        counts = {r["y"]: r["n"] for r in known.groupBy("y").agg(F.count("*").alias("n")).collect()}
        share = F.when(F.col("y") == 1, F.lit(min(1.0, per_class / counts.get(1, 1)))).otherwise(F.lit(min(1.0, per_class / counts.get(0, 1))))
        known = known.where((F.xxhash64("k") / F.lit(2.0**64) + 0.5) < share)
    rows = described.select(F.col(key).alias("k"), "x").join(few(known), "k").select("y", "x")
    rows = computed(thinned(rows, "y", 2 * per_class) if per_class else rows)
    size = len(FEATURES)
    one = rows.agg(F.count("*"), F.coalesce(F.sum("y"), F.lit(0)), *[F.avg(F.col("x")[i]) for i in range(size)], *[F.stddev_pop(F.col("x")[i]) for i in range(size)]).first()
    n, good = one[0], one[1]
    if good in (0, n):
        return QualityModel(np.zeros(size), np.ones(size), np.zeros(size), 0.0, 1.0, cut)
    mean, scale = np.array(one[2 : 2 + size], float), np.maximum(np.array(one[2 + size :], float), 1e-6)
    w = bradley_terry(rows, mean, scale, ridge)
    z = computed(rows.select("y", linear(F.col("x"), w / scale, -(mean / scale) @ w).alias("z")))
    at = quantile if quantile is not None else 1 - good / n
    i = min(max(ceil(at * n - 1e-6) - 1, 0), n - 2)
    threshold = (at_rank(z, i) + at_rank(z, i + 1)) / 2
    spread = at_rank(z.where("y = 1"), (good - 1) // 2) - threshold
    return QualityModel(mean, scale, w, threshold, 4.0 / spread if spread > 1e-9 else 1.0, cut)


def description(text: Column) -> Column:
    """Each text's features."""

    @F.pandas_udf("array<double>")
    def described(texts: pd.Series) -> pd.Series:
        return pd.Series([features(t) for t in texts], dtype=object)

    return described(text)


def rated(model: QualityModel, x: Column) -> Column:
    """The score of a text's features; see `score`."""
    z = linear(x, model.w / model.scale, -(model.mean / model.scale) @ model.w - model.threshold)
    return 1 / (1 + F.exp(-F.greatest(F.lit(-500.0), F.least(F.lit(500.0), model.steepness * z + log(model.cut / (1 - model.cut))))))


def score(model: QualityModel, text: Column) -> Column:
    """Each text's score from 0 to 1; at least model.cut for the texts at or over the threshold."""

    @F.pandas_udf("double")
    def rate(texts: pd.Series) -> pd.Series:
        return pd.Series(model.scores(np.array([features(t) for t in texts], float).reshape(-1, len(FEATURES))))

    return rate(text)
