"""Ranked lexical search by sort-based accumulation.

Documents are scored where they lie. For each group of documents the matched (item, document, impact) postings are
concatenated into arrays, put in order by a radix sort of packed (item, document) keys, and summed by `reduceat`; the best
of each item are kept by heap selection. A task's winners, at most `k` for each item, are dealt by range of (item, salt)
and then of item, and selected again, so that no task gets more than about the square root of an item's candidates.

Two scans: one for the corpus statistics (documents, terms, document frequencies of the items' terms), one for scores.
Items come in chunks bounded by the number of their terms, which are shipped; documents never move. An item whose own
terms are more than a chunk's bound ships whole.

Terms are the maximal runs of ASCII letters and digits and of all characters beyond ASCII; only A to Z is lower-cased.
Scores are integers, as in `impacts`.

Defined cases: a null text, and one without a term, has no terms, does not count and is never found; items under one id,
or under none, are one item with the terms of all; rows of documents are documents each, so repeated rows are ranked
each; documents without an id come after others of equal score; empty tables give no rows; other columns are not read.
"""

from __future__ import annotations

import heapq
from functools import reduce
from math import floor, isqrt, log

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._spark import cut

#: Bytes that stand in terms stay, A to Z in lower case; all others become spaces.
_ASCII_TERM = b"0123456789abcdefghijklmnopqrstuvwxyz"
TABLE = bytes(b if b > 127 or b in _ASCII_TERM else b + 32 if 65 <= b <= 90 else 32 for b in range(256))
#: Items' terms shipped at once; postings sorted at once; characters of texts split at once.
CHUNK, POSTINGS, CHARS = 500_000, 1 << 22, 1 << 22
TERMS, DOCS = -1, -2


def terms(text: str | None) -> list[bytes]:
    return text.encode("utf-8", "surrogatepass").translate(TABLE).split() if text else []


def radix_order(key: np.ndarray, most: int) -> np.ndarray:
    """The order of non-negative keys up to `most`, by stable counting passes over 16-bit digits, the lowest first."""
    order = np.argsort((key & 0xFFFF).astype(np.uint16), kind="stable")
    for shift in range(16, max(1, int(most).bit_length()), 16):
        order = order[np.argsort(((key[order] >> shift) & 0xFFFF).astype(np.uint16), kind="stable")]
    return order


class Index:
    """A chunk of items: the number of each term, and the items that hold it."""

    def __init__(self, items: list, pairs: list[tuple[int, bytes]]) -> None:
        self.items = items
        self.number: dict[bytes, int] = {}
        at = np.array([self.number.setdefault(t, len(self.number)) for _, t in pairs], np.int64)
        item = np.array([i for i, _ in pairs], np.int64)
        order = np.argsort(at, kind="stable")
        self.item = item[order]
        self.first = np.searchsorted(at[order], np.arange(len(self.number) + 1))


def counted(number: dict[bytes, int], texts: list) -> tuple[np.ndarray, ...]:
    """(document, term, tf) of the known terms, by document, and the number of terms of each document."""
    found, size = [], np.zeros(len(texts), np.int64)
    get = number.get
    for k, t in enumerate(texts):
        own = terms(t)
        size[k] = len(own)
        found.append(np.fromiter((x for x in map(get, own) if x is not None), np.int64))
    doc = np.repeat(np.arange(len(texts)), [len(x) for x in found])
    wide = max(1, len(number))
    key, tf = np.unique(doc * wide + np.concatenate([*found, np.zeros(0, np.int64)]), return_counts=True)
    return key // wide, key % wide, tf.astype(np.int64), size


def text_groups(texts: list):
    start, chars = 0, 0
    for i, t in enumerate(texts):
        chars += len(t) if t else 0
        if chars >= CHARS:
            yield start, i + 1
            start, chars = i + 1, 0
    if start < len(texts):
        yield start, len(texts)


def accumulated(index: Index, doc: np.ndarray, term: np.ndarray, impact: np.ndarray, docs: int):
    """(item, document, score) sorted by item and document, for whole documents at a time."""
    many = np.diff(index.first)[term]
    ends = np.cumsum(many)
    heads = np.flatnonzero(np.concatenate([[True], doc[1:] != doc[:-1]])) if len(doc) else np.zeros(0, np.int64)
    before = np.concatenate([[0], ends])[np.append(heads, len(doc))]
    at = 0
    while at < len(heads):
        to = max(at + 1, int(np.searchsorted(before, before[at] + POSTINGS, "right")) - 1)
        own = slice(heads[at], heads[to] if to < len(heads) else len(doc))
        n = many[own]
        place = np.repeat(index.first[term[own]] - (np.cumsum(n) - n), n) + np.arange(n.sum())
        key = index.item[place] * docs + np.repeat(doc[own], n)
        amount = np.repeat(impact[own], n)
        order = radix_order(key, len(index.items) * docs)
        key = key[order]
        first = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))
        yield key[first] // docs, key[first] % docs, np.add.reduceat(amount[order], first)
        at = to


def impacts(weight: np.ndarray, tf: np.ndarray, size: np.ndarray, n_docs: int, n_terms: int) -> np.ndarray:
    m = 10 + (90 * size * n_docs) // n_terms
    return weight * ((1_000_000_000 * tf) // (1000 * tf + 8 * m))


def better(row: tuple) -> tuple:
    score, doc = row
    return -score, doc is None, doc


class Best:
    """The k best (score, document) of each item."""

    def __init__(self, k: int, items: int) -> None:
        self.k, self.rows = k, {}
        self.root = np.full(items, 1, np.int64)  # scores that can still enter

    def offer(self, item: np.ndarray, place: np.ndarray, score: np.ndarray, ids: pa.Array) -> None:
        """Rows of documents whose places follow the order of their ids."""
        keep = score >= self.root[item]
        item, place, score = item[keep], place[keep], score[keep]
        order = np.lexsort((place, -score, item))
        item, place, score = item[order], place[order], score[order]
        first = np.flatnonzero(np.concatenate([[True], item[1:] != item[:-1]])) if len(item) else np.zeros(0, np.int64)
        turn = np.arange(len(item)) - np.repeat(first, np.diff(np.append(first, len(item))))
        top = turn < self.k
        item, score, ids = item[top], score[top], ids.take(pa.array(place[top])).to_pylist()
        bounds = np.flatnonzero(np.concatenate([[True], item[1:] != item[:-1], [True]])) if len(item) else np.zeros(1, np.int64)
        for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True):
            i = int(item[a])
            self.rows[i] = heapq.nsmallest(self.k, [*self.rows.get(i, ()), *zip(score[a:b].tolist(), ids[a:b], strict=True)], key=better)
            if len(self.rows[i]) == self.k:
                self.root[i] = self.rows[i][-1][0]


def _chunks(items: DataFrame, item: str, text: str, most: int):
    """The items, each with its terms, in chunks: (items, (item's number, term) pairs)."""

    def split(batches):
        for b in batches:
            yield pd.DataFrame([(k, t) for k, x in enumerate(b["t"]) for t in set(terms(x))], columns=["k", "term"]).merge(b[["i"]].reset_index(names="k"), on="k")[["i", "term"]]

    kind = items.schema[item].dataType.simpleString()
    asked = items.select(F.col(item).cast("string").alias("i"), F.col(text).alias("t"))
    pairs = cut(asked.mapInPandas(split, "i string, term binary").distinct())
    chunks = max(1, -(-pairs.count() // most))
    for c in range(chunks):
        rows = pairs.where(F.pmod(F.xxhash64("i"), F.lit(chunks)) == c).select("i", "term", F.col("i").cast(kind).alias("own")).orderBy("i", "term").collect()
        number = {r["i"]: n for n, r in enumerate(rows)}
        names = {r["i"]: r["own"] for r in rows}
        place = {i: n for n, i in enumerate(number)}
        if rows:
            yield [names[i] for i in place], [(place[r["i"]], bytes(r["term"])) for r in rows]


def _statistics(source: DataFrame, shipped) -> tuple[int, int, np.ndarray]:
    """Documents with a term, their terms, and how many documents hold each term of the items."""

    def count(batches):
        index: Index = shipped.value
        df, docs, size = np.zeros(len(index.number), np.int64), 0, 0
        for b in batches:
            texts = b["t"].to_pylist()
            for i, j in text_groups(texts):
                _, term, _, n = counted(index.number, texts[i:j])
                df += np.bincount(term, minlength=len(df))
                docs, size = docs + int((n > 0).sum()), size + int(n.sum())
        some = np.flatnonzero(df)
        yield pa.RecordBatch.from_arrays([pa.array([DOCS, TERMS, *some.tolist()], pa.int64()), pa.array([docs, size, *df[some].tolist()], pa.int64())], ["term", "n"])

    found = dict(tuple(r) for r in source.select("t").mapInArrow(count, "term long, n long").groupBy("term").agg(F.sum("n")).collect())
    df = np.zeros(len(shipped.value.number), np.int64)
    for term, n in found.items():
        if term >= 0:
            df[term] = n
    return found.get(DOCS, 0), found.get(TERMS, 0), df


def _candidates(source: DataFrame, shipped, known: tuple, k: int, kinds: str) -> DataFrame:
    """The k best documents of each item in each task: i (the item's number), item_id, doc_id, score."""

    def score(batches):
        index: Index = shipped.value
        n_docs, n_terms, df = known
        weight = np.array([floor(1000 * log((2 * n_docs + 2) / (2 * n + 1))) for n in df.tolist()], np.int64)
        best, types = Best(k, len(index.items)), None
        for b in batches:
            types = b.schema.field("id").type
            b = b.take(pc.sort_indices(b["id"], null_placement="at_end"))
            texts = b["t"].to_pylist()
            for i, j in text_groups(texts):
                doc, term, tf, size = counted(index.number, texts[i:j])
                impact = impacts(weight[term], tf, size[doc], n_docs, n_terms) if n_terms else tf
                ids = b["id"].slice(i, j - i)
                for rows in accumulated(index, doc, term, impact, j - i):
                    best.offer(*rows, ids)
        if best.rows:
            rows = [(i, index.items[i], doc, score) for i, own in best.rows.items() for score, doc in own]
            columns = list(zip(*rows, strict=True))
            yield pa.RecordBatch.from_arrays([pa.array(columns[0], pa.int64()), pa.array(columns[1]), pa.array(columns[2], types), pa.array(columns[3], pa.int64())], ["i", "item_id", "doc_id", "score"])

    return source.mapInArrow(score, f"i long, {kinds}, score long")


def _selected(rows: DataFrame, parts: int, by: list[str], k: int) -> DataFrame:
    """The k best of each group, in ranges of groups; rank counts them."""
    names = rows.columns

    def select(batches):
        best: dict[tuple, list] = {}
        item_of, schema = {}, None
        for b in batches:
            schema = b.schema
            own = b.to_pydict()
            for key, item, doc, score in zip(zip(*(own[c] for c in by), strict=True), own["item_id"], own["doc_id"], own["score"], strict=True):
                item_of[key] = item
                held = best.setdefault(key, [])
                held.append((score, doc))
                if len(held) >= 64 * k:
                    held[:] = heapq.nsmallest(k, held, key=better)
        out = [{**dict(zip(by, key, strict=True)), "item_id": item_of[key], "doc_id": doc, "score": s, "rank": n} for key, held in best.items() for n, (s, doc) in enumerate(heapq.nsmallest(k, held, key=better), 1)]
        if out:
            full = schema.append(pa.field("rank", pa.int32()))
            yield pa.RecordBatch.from_pylist([{c: r.get(c) for c in full.names} for r in out], schema=full)

    kept = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in rows.schema)
    return rows.select(*names).repartitionByRange(parts, *by).mapInArrow(select, f"{kept}, rank int")


def search(docs: DataFrame, items: DataFrame, key: str = "doc_id", text: str = "text", item: str = "item_id", item_text: str = "text", k: int = 10, chunk: int = CHUNK) -> DataFrame:
    """The k best documents of each item: item_id, rank (from 1), doc_id, score."""
    spark = docs.sparkSession
    kinds = f"item_id {items.schema[item].dataType.simpleString()}, doc_id {docs.schema[key].dataType.simpleString()}"
    source = docs.where(F.length(text) > 0).select(F.col(key).alias("id"), F.col(text).alias("t"))
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    found = []
    for own in _chunks(items, item, item_text, chunk):
        shipped = spark.sparkContext.broadcast(Index(*own))
        rows = cut(_candidates(source, shipped, _statistics(source, shipped), k, kinds))
        tasks = -(-rows.count() // (k * len(own[0])))
        salts = isqrt(max(0, tasks - 1)) + 1
        dealt = rows.withColumn("salt", F.pmod(F.xxhash64("doc_id"), F.lit(salts)))
        first = cut(_selected(dealt, parts, ["i", "salt"], k).drop("rank", "salt"))
        found.append(_selected(first, parts, ["i"], k).select("item_id", "rank", "doc_id", "score"))
    return reduce(DataFrame.unionByName, found, spark.createDataFrame([], f"{kinds}, score long, rank int").select("item_id", "rank", "doc_id", "score"))
