"""Exact top-k by inner product over a bit-sliced index.

Components are quantised to integers, and a block of rows keeps, for each dimension, one bitmap over its rows for each
binary digit. For a query, the bitmaps of all dimensions are added with the query's digits as weights, by full adders on
whole bitmaps, which gives the bitmaps of the scores' digits. The top rows are read off from the most significant digit
downward; rows tied at the boundary are resolved by their exact scores and ids.

Blocks of queries are sent to each block of rows, which stays in place, and stream through its task, so a task holds one
of each; where blocks of rows are fewer than `tasks`, each goes to some places, which share the queries. A query's best
k of each block are then ranked. Nothing reaches the driver but counts: the join is told to shuffle, as Spark's estimates
miss that blocks are copied, and it would broadcast what grows with the square of the input.

Defined cases: vectors that are null or hold null or non-finite components, and null ids, take no part; a query has
candidates of its own length only; ties go to the smaller id. The query's own row is no candidate; other rows with its id
are, and each row of a query id that repeats is asked by itself. Components so large that scores could leave 64 bits
raise an error.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def usable(vector: Column) -> Column:
    return vector.isNotNull() & F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf")))


def slices_of(values: np.ndarray) -> tuple[np.ndarray, list[list[int]]]:
    """The lowest value of each column, and each column's bitmaps of the digits of value minus lowest, lowest first."""
    low = values.min(0)
    out = []
    for d, rest in enumerate((values - low).T.astype(np.uint64)):
        width = int(rest.max()).bit_length()
        out.append([int.from_bytes(np.packbits((rest >> np.uint64(j)) & np.uint64(1) != 0, bitorder="little").tobytes(), "little") for j in range(width)])
    return low, out


def add_up(columns: list[list[int]]) -> list[int]:
    """Adds bitmaps, given by weight, to one bitmap for each binary digit of the sum."""
    out = []
    k = 0
    while k < len(columns):
        own = columns[k]
        carry: list[int] = []
        while len(own) > 2:
            rest = []
            for i in range(0, len(own) - 2, 3):
                a, b, c = own[i : i + 3]
                x = a ^ b
                rest.append(x ^ c)
                carry.append((a & b) | (x & c))
            own = rest + own[len(own) - len(own) % 3 :]
        if len(own) == 2:
            carry.append(own[0] & own[1])
            own = [own[0] ^ own[1]]
        out.append(own[0] if own else 0)
        if carry:
            if k + 1 == len(columns):
                columns.append([])
            columns[k + 1] += carry
        k += 1
    return out


def scores_of(query: np.ndarray, low: np.ndarray, slices: list[list[int]], every: int) -> tuple[list[int], int]:
    """The bitmaps of the digits of score plus an offset, and the offset to take away."""
    columns: list[list[int]] = []
    away = 0
    for q, lo, own in zip(query.tolist(), low.tolist(), slices, strict=True):
        away -= q * lo
        size, top = abs(q), (1 << len(own)) - 1
        if q < 0:  # counts what is missing from the largest value of so many digits
            away += size * top
        for p in range(size.bit_length()):
            if size >> p & 1:
                while len(columns) < p + len(own):
                    columns.append([])
                for j, b in enumerate(own):
                    columns[p + j].append(b if q > 0 else b ^ every)
    return add_up(columns), away


def top_rows(digits: list[int], allowed: int, k: int) -> list[int]:
    """Places of the k allowed rows with the highest scores; ties go to the lower place."""
    sure, tied = 0, allowed
    for d in reversed(digits):
        both = sure | (tied & d)
        n = both.bit_count()
        if n > k:
            tied &= d
        elif n < k:
            sure, tied = both, tied & ~d
        else:
            sure, tied = both, 0
            break
    out = []
    while sure:
        out.append((sure & -sure).bit_length() - 1)
        sure &= sure - 1
    while tied and len(out) < k:
        out.append((tied & -tied).bit_length() - 1)
        tied &= tied - 1
    return out


def row_at(low: np.ndarray, slices: list[list[int]], place: int) -> list[int]:
    """The row at a place of the index."""
    return [lo + sum((b >> place & 1) << j for j, b in enumerate(own)) for lo, own in zip(low.tolist(), slices, strict=True)]


def search(vectors: DataFrame, queries: Column, key: str = "vec_id", vector: str = "embedding", scale: int = 256, k: int = 5, block_rows: int = 8192, query_rows: int = 256, tasks: int = 64) -> DataFrame:
    """(query_id, rank, vec_id, score): the k best other rows for each row where `queries` holds."""
    v = F.col(vector)
    rows = vectors.where(usable(v) & F.col(key).isNotNull()).select(
        F.col(key).cast("long").alias("id"), F.transform(v, lambda x: F.floor(F.lit(float(scale)) * x.cast("double")).cast("long")).alias("v"), F.size(v).alias("dim"), queries.alias("asks")
    )
    count = rows.agg(F.count("*").alias("n"), F.count_if("asks").alias("q"), F.max(F.array_max(F.transform("v", lambda x: F.abs(x))) * F.sqrt("dim")).alias("top")).first()
    if (count["top"] or 0) >= 2**31:
        raise ValueError("scores may not fit 64 bits")
    blocks, asked = max(1, -(-count["n"] // block_rows)), max(1, -(-count["q"] // query_rows))
    copies = min(asked, max(1, -(-tasks // blocks)))

    def packed(part: pd.DataFrame) -> pd.DataFrame:
        values = np.stack([np.asarray(x, np.int64) for x in part["v"]])
        return pd.DataFrame({"dim": part["dim"].iloc[:1].to_numpy(), "q": part["q"].iloc[:1].to_numpy(), "q_ids": [part["id"].to_numpy(np.int64).tobytes()], "q_v": [values.tobytes()]})

    def indexed(part: pd.DataFrame) -> pd.DataFrame:
        part = part.sort_values("id", kind="stable")
        dim = int(part["dim"].iloc[0])
        low, slices = slices_of(np.stack([np.asarray(x, np.int64) for x in part["v"]]).reshape(len(part), dim)) if dim else (np.zeros(0, np.int64), [])
        size = -(-len(part) // 8)
        return pd.DataFrame({"dim": [dim], "block": part["block"].iloc[:1].to_numpy(), "ids": [part["id"].to_numpy(np.int64).tobytes()], "low": [low.astype(np.int64).tobytes()], "digits": [[len(s) for s in slices]], "slices": [b"".join(b.to_bytes(size, "little") for s in slices for b in s)]})

    spread = lambda n: F.pmod(F.xxhash64("id", "v"), F.lit(n)).cast("int")
    index = rows.withColumn("block", spread(blocks)).groupBy("dim", "block").applyInPandas(indexed, "dim int, block int, ids binary, low binary, digits array<int>, slices binary")
    asks = rows.where("asks").withColumn("q", spread(asked)).groupBy("dim", "q").applyInPandas(packed, "dim int, q int, q_ids binary, q_v binary")
    every_copy, every_block = (F.explode(F.sequence(F.lit(0), F.lit(n - 1))) for n in (copies, blocks))
    # a merge join streams its left side and holds the right side's rows of a key: one block of rows
    pairs = asks.withColumn("copy", F.pmod("q", F.lit(copies))).withColumn("block", every_block).join(index.withColumn("copy", every_copy).hint("merge"), ["dim", "block", "copy"])

    def best(batches):
        for b in batches:
            for r in b.itertuples(index=False):
                ids, low = np.frombuffer(r.ids, np.int64), np.frombuffer(r.low, np.int64)
                size, at, slices = -(-len(ids) // 8), 0, []
                for n in r.digits:
                    slices.append([int.from_bytes(r.slices[i : i + size], "little") for i in range(at, at + n * size, size)])
                    at += n * size
                every = (1 << len(ids)) - 1
                found = []
                q_ids = np.frombuffer(r.q_ids, np.int64)
                for number, (q, query) in enumerate(zip(q_ids.tolist(), np.frombuffer(r.q_v, np.int64).reshape(len(q_ids), -1), strict=True)):
                    digits, away = scores_of(query, low, slices, every)
                    same = range(int(np.searchsorted(ids, q, "left")), int(np.searchsorted(ids, q, "right")))
                    own = next((1 << p for p in same if row_at(low, slices, p) == query.tolist()), 0)
                    for p in top_rows(digits, every ^ own, k):
                        found.append((r.dim, r.q << 32 | number, q, int(ids[p]), sum((d >> p & 1) << j for j, d in enumerate(digits)) - away))
                yield pd.DataFrame(found, columns=["dim", "ask", "query_id", "vec_id", "score"])

    ranked = Window.partitionBy("dim", "ask").orderBy(F.desc("score"), "vec_id")
    best_of = pairs.mapInPandas(best, "dim int, ask long, query_id long, vec_id long, score long")
    return best_of.withColumn("rank", F.row_number().over(ranked)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
