"""Benchmark decontamination: SimHash of item-sized windows, multi-index Hamming search, exact verification.

Every benchmark item has a 64-bit SimHash of its words, and so has each window of a document that is as long as an
item. The fingerprints are indexed by each of four blocks of 16 bits; a window looks up all values at most
`radius // 4` bits away in each block, so, by the pigeonhole principle, every item within `radius` bits is found. A
candidate is then verified exactly: the weight of the five-word shingles that the window shares with the item, each as
often as both have it, over the item's weight must be `threshold` or more. Windows that hold too few shingles of
items of their size to pass are not hashed; that test loses nothing, because it counts what the verification needs.

Items are shipped to the tasks in chunks of about `chunk` items and `chunk_bytes` bytes of text (a bound on what is broadcast); documents are
read once for each chunk, whole, and are never shuffled. The best window of each document and item is kept, within its
own row.

Defined cases: null or empty texts and items match nothing; an item under five words is one shingle and matches where
its words stand in a row; a document of five words or more that is shorter than an item is one window; equal items match
each; repeated rows give repeated matches; rows with a null id are left out; only the named columns are read.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import cache, reduce
from itertools import combinations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ._text import groups, mix, shingles, word_hashes

_BIT = np.arange(64, dtype=np.uint64)
#: Leading bits of the shingles of items that are looked up first.
LEADING = 20


def _signs(h: np.ndarray) -> np.ndarray:
    """Each word's 64 signs."""
    return (((mix(h)[:, None] >> _BIT) & np.uint64(1)).astype(np.int8) * 2 - 1).astype(np.int32)


def _print(sums: np.ndarray) -> np.ndarray:
    return np.bitwise_or.reduce((sums > 0).astype(np.uint64) << _BIT, axis=1)


def simhash(h: np.ndarray) -> int:
    return int(_print(_signs(h).sum(0, keepdims=True))[0])


@cache
def _near(most: int) -> np.ndarray:
    """All 16-bit values with so many bits set at most."""
    return np.array([sum(1 << i for i in c) for w in range(most + 1) for c in combinations(range(16), w)], np.int64)


class Benchmark:
    """The items' shingles, fingerprints and multi-index; `matches` is the search of one text."""

    def __init__(self, ids: list, hashes: list[np.ndarray], n: int, threshold: float, radius: int) -> None:
        self.n, self.threshold, self.radius = n, threshold, radius
        # items under n words are one shingle of all their words; these are looked up as they are
        self.short: dict[int, dict[int, list]] = {}
        for i, h in zip(ids, hashes, strict=True):
            if len(h) < n:
                s, _ = shingles(h, np.array([0, len(h)]), n)
                self.short.setdefault(len(h), {}).setdefault(int(s[0]), []).append(i)
        long = [k for k, h in enumerate(hashes) if len(h) >= n]
        self.ids, hashes = [ids[k] for k in long], [hashes[k] for k in long]
        self.size = np.array([len(h) for h in hashes], np.int64)
        self.bags = [np.unique(shingles(h, np.array([0, len(h)]), n)[0], return_counts=True) for h in hashes]
        self.vocabulary = np.unique(np.concatenate([b[0] for b in self.bags])) if self.bags else np.zeros(0, np.uint64)
        # the sizes of the items that hold a shingle, by its place in the vocabulary
        pairs = [np.searchsorted(self.vocabulary, b[0]) * (1 << 32) + m for b, m in zip(self.bags, self.size.tolist(), strict=True)]
        pairs = np.unique(np.concatenate([np.zeros(0, np.int64), *pairs]))
        self.of_size = pairs & 0xFFFFFFFF
        self.first_size = np.searchsorted(pairs >> 32, np.arange(len(self.vocabulary) + 1))
        self.leading = np.zeros(1 << LEADING, bool)
        self.leading[(self.vocabulary >> np.uint64(64 - LEADING)).astype(np.int64)] = True
        self.prints = np.array([simhash(h) for h in hashes], np.uint64)
        self.tables: list[tuple[np.ndarray, np.ndarray]] | None = None

    def index(self) -> list[tuple[np.ndarray, np.ndarray]]:
        """For each block, the first place of each of its values and the items in the order of the values."""
        if self.tables is None:
            self.tables = []
            for b in range(4):
                keys = (self.prints >> np.uint64(16 * b)) & np.uint64(0xFFFF)
                self.tables.append((np.concatenate([[0], np.cumsum(np.bincount(keys.astype(np.int64), minlength=1 << 16))]), np.argsort(keys, kind="stable")))
        return self.tables

    def candidates(self, prints: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(place in prints, item): exactly the items within the radius of each fingerprint.

        By the pigeonhole principle one block at least is within radius // 4 bits; all values that near are looked up.
        """
        near, pairs = _near(self.radius // 4), []
        for low in range(0, len(prints), 256):
            part = prints[low : low + 256]
            for b, (first, items) in enumerate(self.index()):
                keys = ((part >> np.uint64(16 * b)) & np.uint64(0xFFFF)).astype(np.int64)[:, None] ^ near
                n = first[keys + 1] - first[keys]
                at, key = np.nonzero(n)
                n, start = n[at, key], first[keys[at, key]]
                item = items[np.repeat(start - np.cumsum(n) + n, n) + np.arange(n.sum())]
                at = np.repeat(at, n)
                close = np.bitwise_count(self.prints[item] ^ part[at]) <= self.radius
                pairs.append((at[close] + low) * len(self.ids) + item[close])
        pair = np.unique(np.concatenate(pairs))
        return pair // len(self.ids), pair % len(self.ids)

    def known(self, s: np.ndarray) -> np.ndarray:
        """Whether each shingle is one of the items'; a table of leading bits settles most."""
        out = self.leading[(s >> np.uint64(64 - LEADING)).astype(np.int64)]
        some = np.flatnonzero(out)
        if len(some):
            out[some] = self.vocabulary[np.minimum(np.searchsorted(self.vocabulary, s[some]), len(self.vocabulary) - 1)] == s[some]
        return out

    def best_window(self, item: int, start: np.ndarray, width: int, s: np.ndarray) -> tuple[float, int]:
        """The highest similarity of the item to the windows of so many words, and the first start that has it."""
        bag, weight = self.bags[item]
        total, made = int(weight.sum()), width - self.n + 1
        low, high = int(start.min()), int(start.max()) + made
        own = s[low:high]
        place = np.minimum(np.searchsorted(bag, own), len(bag) - 1)
        place = np.where(bag[place] == own, place, len(bag))
        inside = np.concatenate([[0], np.cumsum(place < len(bag))])
        bound = inside[start - low + made] - inside[start - low]  # at most so many shingles are common
        best, first = -1, -1
        for k in np.lexsort((start, -bound)).tolist():
            if bound[k] < best:
                break
            at = int(start[k])
            count = np.bincount(place[at - low : at - low + made], minlength=len(bag) + 1)[: len(bag)]
            common = int(np.minimum(count, weight).sum())
            if common > best or (common == best and at < first):
                best, first = common, at
        return best / total, first

    def matches(self, h: np.ndarray, s: np.ndarray, hit: np.ndarray) -> list[tuple]:
        """(item id, first word, words, similarity, distance) of a text's best window for each item found."""
        n, best = self.n, []
        if len(h) < n:
            return []
        place = np.flatnonzero(hit)
        word = np.searchsorted(self.vocabulary, s[place])
        count = self.first_size[word + 1] - self.first_size[word]
        sizes = self.of_size[np.repeat(self.first_size[word] - np.cumsum(count) + count, count) + np.arange(count.sum())]
        place = np.repeat(place, count)
        wanted: list[tuple[int, np.ndarray]] = []
        for size in np.unique(sizes).tolist():
            own, made = place[sizes == size], min(size, len(h)) - n + 1
            enough = self.threshold * (size - n + 1) - 1e-9
            low = max(0, int(own[0]) - made + 1)
            last = min(int(own[-1]), len(s) - made)  # windows from low to last can hold a hit
            hits = np.concatenate([[0], np.cumsum(np.bincount(own - low, minlength=last - low + made))])
            start = np.flatnonzero(hits[made : made + last - low + 1] - hits[: last - low + 1] >= enough) + low
            wanted += [(size, start[i : i + 4096]) for i in range(0, len(start), 4096)]
        found: dict[int, list[tuple[int, np.ndarray, np.ndarray]]] = {}
        for size, start in wanted:
            width = min(size, len(h))
            low, high = int(start[0]), int(start[-1]) + width
            sums = np.concatenate([np.zeros((1, 64), np.int32), np.cumsum(_signs(h[low:high]), axis=0, dtype=np.int32)])
            prints = _print(sums[start - low + width] - sums[start - low])
            at, item = self.candidates(prints)
            same = self.size[item] == size
            at, item = at[same], item[same]
            for i in np.unique(item).tolist():
                own = at[item == i]
                found.setdefault(i, []).append((width, start[own], prints[own]))
        for i in sorted(found):
            top = (-1.0, 0, 0, np.uint64(0))
            for width, start, prints in found[i]:
                score, at = self.best_window(i, start, width, s)
                if score > top[0]:
                    top = (score, at, width, prints[start == at][0])
            if top[0] >= self.threshold:
                best.append((self.ids[i], top[1], top[2], top[0], int(np.bitwise_count(self.prints[i] ^ top[3]))))
        return best


def _chunks(benchmark: DataFrame, item: str, item_text: str, chunk: int, chunk_bytes: int):
    """The items of each chunk, shipped: (ids, word hashes)."""
    items = benchmark.where(F.col(item).isNotNull() & (F.length(item_text) > 0)).select(F.col(item).alias("i"), F.col(item_text).alias("t"))
    rows, size = items.agg(F.count("*"), F.sum(F.octet_length("t"))).first()
    chunks = max(1, -(-rows // chunk), -(-(size or 0) // chunk_bytes))
    for c in range(chunks):
        rows = items.where(F.pmod(F.xxhash64("i", "t"), F.lit(chunks)) == c).orderBy("i", "t").collect()
        h, at = word_hashes([r["t"] for r in rows])
        own = [(r["i"], h[at[k] : at[k + 1]]) for k, r in enumerate(rows) if at[k + 1] > at[k]]
        yield benchmark.sparkSession.sparkContext.broadcast(([i for i, _ in own], [x for _, x in own]))


def _matches(bench: Benchmark, texts: list, n: int):
    """(place in the list, match) for each text and item."""
    for i, j in groups(texts):
        h, at = word_hashes(texts[i:j])
        s, to = shingles(h, at, n)
        hit = bench.known(s)
        total = np.concatenate([[0], np.cumsum(hit)])
        for k in np.flatnonzero(total[to[1:]] > total[to[:-1]]).tolist():
            for m in bench.matches(h[at[k] : at[k + 1]], s[to[k] : to[k + 1]], hit[to[k] : to[k + 1]]):
                yield i + k, m
        for size, items in bench.short.items():
            yield from ((i + k, m) for k, m in _short_matches(h, at, size, items, n))


def _short_matches(h: np.ndarray, at: np.ndarray, size: int, items: dict[int, list], n: int):
    """The first place in each text of each item of so many words, fewer than n."""
    doc = np.repeat(np.arange(len(at) - 1), np.diff(at))
    start = np.flatnonzero(doc[: max(0, len(h) - size + 1)] == doc[size - 1 :])
    # each run of words as a text of its own, so that its one shingle is made as an item's
    runs = h[(start[:, None] + np.arange(size)).ravel()]
    s, _ = shingles(runs, np.arange(len(start) + 1) * size, n)
    seen = set()
    for k in np.flatnonzero(np.isin(s, np.array(list(items), np.uint64))).tolist():
        of = int(doc[start[k]])
        for i in items[int(s[k])]:
            if (of, i) not in seen:
                seen.add((of, i))
                yield of, (i, int(start[k] - at[of]), size, 1.0, 0)


def find(docs: DataFrame, benchmark: DataFrame, key: str = "doc_id", text: str = "text", item: str = "item_id", item_text: str = "text", n: int = 5, threshold: float = 0.8, radius: int = 19, chunk: int = 50_000, chunk_bytes: int = 8 << 20) -> DataFrame:
    """One row for each document and item that it contains: doc_id, item_id, start_word, n_words, similarity, distance."""
    source = docs.where(F.col(key).isNotNull()).select(F.col(key).alias("id"), F.col(text).alias("t"))
    kinds = docs.schema[key].dataType.simpleString(), benchmark.schema[item].dataType.simpleString()
    found = []
    for shipped in _chunks(benchmark, item, item_text, chunk, chunk_bytes):

        def search(batches, shipped=shipped):
            bench = Benchmark(*shipped.value, n, threshold, radius)
            for b in batches:
                ids = b["id"].tolist()
                yield pd.DataFrame([(ids[k], *m) for k, m in _matches(bench, b["t"].tolist(), n)], columns=["doc_id", "item_id", "start_word", "n_words", "similarity", "distance"])

        found.append(source.mapInPandas(search, f"doc_id {kinds[0]}, item_id {kinds[1]}, start_word long, n_words long, similarity double, distance int"))
    return reduce(DataFrame.unionByName, found)


def contains_item(text: Column, benchmark: DataFrame, item: str = "item_id", item_text: str = "text", n: int = 5, threshold: float = 0.8, radius: int = 19, chunk: int = 50_000, chunk_bytes: int = 8 << 20) -> Column:
    """Whether a text contains an item, by the same search; as a column, so that documents need no join."""

    def flag_of(shipped) -> Column:
        @F.pandas_udf("boolean")
        def flag(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
            bench = Benchmark(*shipped.value, n, threshold, radius)
            for texts in batches:
                out = np.zeros(len(texts), bool)
                for k, _ in _matches(bench, texts.tolist(), n):
                    out[k] = True
                yield pd.Series(out)

        return flag(text)

    return reduce(lambda a, b: a | b, [flag_of(x) for x in _chunks(benchmark, item, item_text, chunk, chunk_bytes)])
