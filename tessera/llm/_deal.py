"""Rows of 64-bit keys, packed in binary blocks and dealt out by the leading digits of the key.

A band row is a key and the print of a set. Within a batch the rows of a key are reduced to one, the pivot; the others
come out as pairs with it, at once. So a key that very many rows share costs a row for each batch in the exchange.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

PAIRS, BLOCKS = "k long, p long, m long", "part int, block binary"
#: Band rows held before they are dealt out (16 bytes each).
FLUSH = 1 << 20


def digit(key: np.ndarray, parts: int) -> np.ndarray:
    """The leading digit of a 64-bit key, for a radix of `parts`."""
    return ((key >> np.uint64(32)) * np.uint64(parts) >> np.uint64(32)).astype(np.int64)


def filled(schema: pa.Schema, **columns) -> pa.RecordBatch:
    """A batch of the schema; the columns not given are null."""
    size = len(next(iter(columns.values())))
    made = [columns[f.name] if f.name in columns else pa.nulls(size, f.type) for f in schema]
    return pa.RecordBatch.from_arrays([x if isinstance(x, pa.Array) else pa.array(x, f.type) for x, f in zip(made, schema, strict=True)], schema=schema)


def grouped(key: np.ndarray, value: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The distinct rows, sorted, and for each row the place of its key's first row, whose value is the smallest."""
    order = np.argsort(key)
    key, value = key[order], value[order]
    start = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))
    size = np.diff(np.append(start, len(key)))
    shared = np.repeat(size > 1, size)
    # rows of a key of its own are done; the others are sorted within their keys
    k, v = key[shared], value[shared]
    order = np.lexsort((v, k))
    k, v = k[order], v[order]
    fresh = np.ones(len(k), bool)
    fresh[1:] = (k[1:] != k[:-1]) | (v[1:] != v[:-1])
    k, v = np.concatenate([k[fresh], key[~shared]]), np.concatenate([v[fresh], value[~shared]])
    head = np.ones(len(k), bool)
    head[1:] = k[1:] != k[:-1]
    return k, v, np.maximum.accumulate(np.where(head, np.arange(len(k)), 0)) if len(k) else np.zeros(0, np.int64)


def pair_rows(key: np.ndarray, value: np.ndarray, head: np.ndarray) -> dict[str, np.ndarray]:
    others = np.flatnonzero(head != np.arange(len(key)))
    return {"k": key[others].view(np.int64), "p": value[head[others]].view(np.int64), "m": value[others].view(np.int64)}


def combined(schema: pa.Schema, held: list[tuple[np.ndarray, np.ndarray]], parts: int):
    """The pairs within what is held, and the pivots' rows in blocks."""
    key, value = (np.concatenate(x) for x in zip(*held, strict=True))
    if not len(key):
        return
    key, value, head = grouped(key, value)
    pairs = pair_rows(key, value, head)
    if len(pairs["k"]):
        yield filled(schema, **pairs)
    pivots = head == np.arange(len(key))
    key, value = key[pivots], value[pivots]
    part = digit(key, parts)
    order = np.argsort(part, kind="stable")
    bounds = np.searchsorted(part[order], np.arange(parts + 1))
    some = np.flatnonzero(np.diff(bounds))
    blocks = [np.concatenate([key[o], value[o]]).tobytes() for o in (order[bounds[x] : bounds[x + 1]] for x in some)]
    yield filled(schema, part=some.astype(np.int32), block=pa.array(blocks, pa.binary()))


def band_parts(source: DataFrame, bands: int, rows_each: int = 1 << 19) -> int:
    """So many parts that each has a bounded number of band rows."""
    rows = source.count() * bands
    return max(int(source.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-rows // rows_each))


def dealt_pairs(blocks: DataFrame, parts: int) -> DataFrame:
    """(k, p, m) of the rows in blocks (part, block) that share a key."""

    def pairs(batches):
        held = [np.frombuffer(x, np.uint64) for b in batches for x in b["block"]]
        if held:
            key, value = np.concatenate([x[: len(x) // 2] for x in held]), np.concatenate([x[len(x) // 2 :] for x in held])
            yield pd.DataFrame(pair_rows(*grouped(key, value)))

    return blocks.where(F.col("block").isNotNull()).select("part", "block").repartition(parts, "part").mapInPandas(pairs, PAIRS)
