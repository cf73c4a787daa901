"""Connected components over an edge table, without gathering it on the driver."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._spark import cut

#: So many edges are settled by one task; more go through distributed rounds.
ONE_TASK = 1 << 19


def _settled(batches):
    """(u, v) with v the smallest node of u's component, for each node that is not."""
    held = [b for b in batches if len(b)]
    if not held:
        return
    edges = pd.concat(held)
    _, names = pd.factorize(pd.concat([edges["u"], edges["v"]]), sort=True)
    places = pd.Index(names)
    u, v = places.get_indexer(edges["u"]), places.get_indexer(edges["v"])
    low = np.arange(len(names))
    while True:
        before = low.copy()
        least = np.minimum(low[u], low[v])
        # a node and what it stands for take the smaller of both ends, then chains are shortened
        for x in (u, v):
            np.minimum.at(low, low[x], least)
            np.minimum.at(low, x, least)
        while (low[low] != low).any():
            low = low[low]
        if (low == before).all():
            break
    others = np.flatnonzero(low != np.arange(len(names)))
    yield pd.DataFrame({"u": places[others], "v": places[low[others]]})


def components(edges: DataFrame, a: str = "a", b: str = "b", one_task: int = ONE_TASK) -> DataFrame:
    """(id, label) of each node of the edges, label being its component's smallest id.

    Up to `one_task` edges go to one task. More are settled by large-star and small-star steps: each groups on a node
    with a partial minimum and joins, so a node with many neighbours is pre-aggregated and its join partition can be
    split; the lineage is cut each round. Rounds grow with the logarithm of the size.
    """
    e = cut(edges.where(F.col(a) != F.col(b)).select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).distinct())
    if e.count() <= one_task:
        e = cut(e.coalesce(1).mapInPandas(_settled, e.schema))
        return _labels(e)
    state = None
    while True:
        both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.join(low, "u").where(F.col("v") > F.col("u")).select(F.col("v").alias("u"), F.col("m").alias("v")).where("u != v").distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").select(F.explode(F.array(F.struct(F.col("v").alias("u"), F.col("m").alias("v")), F.struct(F.col("u").alias("u"), F.col("m").alias("v")))).alias("x")).select("x.u", "x.v").where("u != v").distinct()
        e = cut(small)
        now = e.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if tuple(now) == state:
            break
        state = tuple(now)
    return _labels(e)


def _labels(e: DataFrame) -> DataFrame:
    return e.select(F.col("u").alias("id"), F.col("v").alias("label")).unionByName(e.select(F.col("v").alias("id"), F.col("v").alias("label")).distinct())
