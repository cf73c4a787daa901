"""Near-duplicate detection by DartMinHash signatures, banded joining and exact verification.

A document is the weighted set of its five-word shingles. Each element throws a Poisson number of darts, placed by its
hash, on the plane of weight and rank; darts inside the element's weight count, and each of k coordinates keeps the dart
of lowest rank. Two documents agree on a coordinate with their weighted Jaccard similarity as probability. Rows of
coordinates form bands; documents that share a band meet.

Within a band's bucket every member is compared with one pivot only, never with every other member. What is left open
(buckets whose members are not yet one class) is compared exactly in blocks, of which links alone come out. Links need
an exact similarity of at least `threshold`; classes are their connected components. The bands miss a pair at the
threshold with a chance below 1e-5.

Scale: a node of the graph is the 128-bit print of a shingle set, so equal sets are one node from the start, whatever
keys they have. Band rows are 16 bytes, packed, and reduced to one for each key and batch before they are dealt out, so a
very common band costs a row a batch. Only the texts of documents that share a band are read again, and their packed
shingle sets move, not their texts. No pair within a group of copies is made.

Defined cases: a null text is an empty one; texts without a word are in one class when equal; 1 to 4 words form one
shingle. The class id is the smallest key in the class. A repeated key gives one row for each of its rows, and each of
its texts is in the class of its own. Rows with a null key are left out. Only key and text are read, so names of other columns cannot clash.
"""

from __future__ import annotations

from math import log

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from ._deal import BLOCKS, FLUSH, PAIRS, band_parts, combined, dealt_pairs, filled
from ._graph import components
from ._spark import cut, few
from ._text import groups, hash_words, mix, seeded, shingles, word_hashes

#: Darts in a block of area one, a Poisson number, by 16 random bits.
_DARTS = np.searchsorted(np.cumsum(np.exp(-1.0) / np.cumprod([1.0, *range(1, 20)])), (np.arange(1 << 16) + 0.5) / (1 << 16), side="right").astype(np.int8)
_UNIT53 = 2.0**-53
#: Documents and shingles of a block, and of a block of asked documents, in the last comparison.
BLOCK_ROWS, BLOCK_ASKED, BLOCK_SHINGLES, ASKED_SHINGLES = 1024, 256, 1 << 18, 1 << 16
#: Places that a home's counts go to.
SALTS = 16


def weighted_sets(h: np.ndarray, at: np.ndarray, count_weights: bool = False) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Each document's distinct hashes, their weights (1, or how often they occur) and the documents' first places."""
    doc = np.repeat(np.arange(len(at) - 1), np.diff(at))
    # by hash, then by document with its order kept; numbers of 16 bits are sorted by radix
    order = np.argsort(h)
    order = order[np.argsort(doc[order].astype(np.uint16 if len(at) <= 1 << 16 else np.int64), kind="stable")]
    h, doc = h[order], doc[order]
    first = np.ones(len(h), bool)
    first[1:] = (h[1:] != h[:-1]) | (doc[1:] != doc[:-1])
    places = np.flatnonzero(first)
    weight = np.diff(np.append(places, len(h))).astype(float) if count_weights else np.ones(len(places))
    return h[places], weight, np.concatenate([[0], np.cumsum(np.bincount(doc[places], minlength=len(at) - 1))])


def dart_minhash(keys: np.ndarray, weights: np.ndarray, at: np.ndarray, k: int, seed: int = 0) -> np.ndarray:
    """Signatures (documents x k); a document without weight gets zeros.

    The plane is cut into blocks of area one: weight strips [0,1), [1,2), [2,4), ... and rank strips of inverse height.
    A block's darts depend on the element's hash and the block alone, so they agree in all documents. A coordinate's
    value is the rank of its earliest dart, whose 53 random bits tell it from others.
    """
    docs = len(at) - 1
    doc = np.repeat(np.arange(docs), np.diff(at))
    norm = np.bincount(doc, weights, minlength=docs)
    sig = np.zeros((docs, k), np.uint64)
    reach = np.divide(k * log(k + 1) + 2 * k, norm, out=np.zeros(docs), where=norm > 0)
    open_docs = norm > 0
    base = seeded(seed, keys)
    heaviest = float(weights.max(initial=0.0))
    plain = heaviest == 1.0 and bool((weights == 1.0).all())  # each dart in the first strip counts
    while open_docs.any():
        first = np.full(docs * k, np.inf)
        low, width, strip = 0.0, 1.0, 0
        while low < heaviest:
            own = np.flatnonzero(open_docs[doc] & (weights > low))
            rows = np.ceil(reach[doc[own]] * width).astype(np.int64)
            el = np.repeat(own, rows)
            rho = np.arange(len(el)) - np.repeat(np.cumsum(rows) - rows, rows)
            block = seeded(strip + 101, base[el] + mix(np.arange(int(rows.max(initial=0)), dtype=np.uint64))[rho])
            darts = _DARTS[(block >> np.uint64(48)).astype(np.int64)]
            some = np.repeat(np.arange(len(el)), darts)
            nth = np.arange(len(some)) - np.repeat(np.cumsum(darts, dtype=np.int64) - darts, darts)
            dart = seeded(211, block[some] + mix(np.arange(1, 22, dtype=np.uint64))[nth])
            el, rho = el[some], rho[some]
            rank = (rho + (mix(dart) >> np.uint64(11)) * _UNIT53) / width
            hit = rank < reach[doc[el]]
            if not plain:
                hit &= low + width * ((seeded(307, dart) >> np.uint64(11)) * _UNIT53) < weights[el]
            slot = doc[el[hit]] * k + (((dart[hit] >> np.uint64(32)) * np.uint64(k)) >> np.uint64(32)).astype(np.int64)
            np.minimum.at(first, slot, rank[hit])
            low, width, strip = (1.0, 1.0, 1) if strip == 0 else (low * 2, width * 2, strip + 1)
        first = first.reshape(docs, k)
        full = open_docs & np.isfinite(first).all(1)
        sig[full] = first[full].view(np.uint64)
        open_docs &= ~full
        reach *= 2
    return sig


def band_keys(sig: np.ndarray, bands: int, rows: int, seed: int = 0) -> np.ndarray:
    """A 64-bit key for each band of each signature; equal rows of the same band have equal keys."""
    out = np.tile(seeded(seed + 17, np.arange(bands, dtype=np.uint64)), (len(sig), 1))
    for r in range(rows):
        out = mix(out * np.uint64(31) + sig[:, r * bands : (r + 1) * bands])
    return out


def _set_prints(h: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Two independent 64-bit prints of each document's set of hashes."""
    total = lambda x: np.diff(np.concatenate([[np.uint64(0)], np.cumsum(x, dtype=np.uint64)])[at])
    return total(seeded(3, h)), total(seeded(5, h))


def printed_sets(texts: list, n: int, count_weights: bool):
    """(hashes, weights, first places, f1, f2) of the texts' shingle sets; f1, f2 print a set, or the text if the set is empty."""
    h, w, at = weighted_sets(*shingles(*word_hashes(texts), n), count_weights)
    f1, f2 = _set_prints(seeded(11, h) + (w - 1).astype(np.uint64), at)
    empty = np.flatnonzero(np.diff(at) == 0)
    if len(empty):
        own = [texts[x] or "" for x in empty]
        f1[empty], f2[empty] = hash_words(own), hash_words([t + " " for t in own])
    return h, w, at, f1, f2


def signed_rows(docs: DataFrame, n: int, bands: int, rows: int, count_weights: bool, seed: int, parts: int) -> DataFrame:
    """Of texts (id, t): a row (id, print, f1, f2) for each, pairs (k, p, m) that share a band within a batch, and blocks
    (part, block) of the band rows that remain, one for each key and batch."""
    kind = docs.schema["id"].dataType.simpleString()
    schema = to_arrow_schema(StructType([docs.schema["id"], *StructType.fromDDL(f"print long, f1 long, f2 long, {PAIRS}, {BLOCKS}")]))

    def make(batches):
        held: list[tuple[np.ndarray, np.ndarray]] = []
        size = 0
        for b in batches:
            texts = b.column(1).to_pylist()
            for i, j in groups(texts):
                h, w, at, f1, f2 = printed_sets(texts[i:j], n, count_weights)
                yield filled(schema, id=b.column(0).slice(i, j - i), print=b.column(2).slice(i, j - i), f1=f1.view(np.int64), f2=f2.view(np.int64))
                some = np.flatnonzero(np.diff(at))
                keys = band_keys(dart_minhash(h, w, at, bands * rows, seed)[some], bands, rows, seed)
                held.append((keys.ravel(), np.repeat(f1[some], bands)))
                size += keys.size
                if size >= FLUSH:
                    yield from combined(schema, held, parts)
                    held, size = [], 0
        if held:
            yield from combined(schema, held, parts)

    shown = F.xxhash64("t").alias("print")
    return docs.select("id", "t", shown).mapInArrow(make, f"id {kind}, print long, f1 long, f2 long, {PAIRS}, {BLOCKS}")


def _shared_sets(source: DataFrame, wanted: DataFrame, n: int, count_weights: bool) -> DataFrame:
    """(node, f1, h, w): the shingle sets of the wanted documents (id), whose texts alone move."""

    def sets(batches):
        for b in batches:
            texts = b.column(0).to_pylist()
            for i, j in groups(texts):
                h, w, at, f1, f2 = printed_sets(texts[i:j], n, count_weights)
                node = [f"{x}:{y}" for x, y in zip(f1.view(np.int64).tolist(), f2.view(np.int64).tolist(), strict=True)]
                cut_at = lambda x: [x[a:e].tobytes() for a, e in zip(at[:-1], at[1:], strict=True)]
                yield pa.record_batch({"node": node, "f1": f1.view(np.int64), "h": pa.array(cut_at(h), pa.binary()), "w": pa.array(cut_at(w.astype("<f4")) if count_weights else [None] * (j - i), pa.binary())})

    return source.join(few(wanted), "id", "left_semi").select("t").mapInArrow(sets, "node string, f1 long, h binary, w binary")


def compared(pairs: DataFrame, sets: DataFrame, threshold: float, count_weights: bool) -> DataFrame:
    """(a, b, s): the nodes of the pairs (p, m) of set prints whose exact similarity reaches the threshold.

    A pivot p meets its members in groups of about BLOCK_ASKED, so a member's set moves once for each of its pivots.
    """
    several = pairs.groupBy("p").agg(F.ceil(F.count("*") / BLOCK_ASKED).cast("int").alias("groups"))
    dealt = pairs.join(several, "p").select(F.col("p").cast("string").alias("home"), F.pmod(F.xxhash64("m"), F.col("groups")).cast("int").alias("j"), "p", "m")
    members = dealt.select("home", "j", F.col("m").alias("f1"), F.lit(1).alias("role"))
    pivots = dealt.select("home", "j", F.col("p").alias("f1"), F.lit(0).alias("role")).distinct()
    met = members.unionByName(pivots).withColumn("i", F.lit(0)).join(sets, "f1").withColumn("label", F.col("node"))
    return linked_in_groups(met, threshold, count_weights)


def mixed_buckets(met: DataFrame, label: DataFrame) -> DataFrame:
    """(k, f1, label) of the buckets whose members (k, p, m) are not of one class yet."""
    own = label.select(print_of("id").alias("f1"), "label")
    members = met.select("k", F.explode(F.array("p", "m")).alias("f1")).distinct().join(own, "f1", "left")
    members = members.withColumn("label", F.coalesce("label", F.col("f1").cast("string"))).withColumn("x", F.xxhash64("label"))
    mixed = members.groupBy("k").agg(F.min("x").alias("lo"), F.max("x").alias("hi")).where("lo != hi").select("k")
    return cut(members.join(mixed, "k").select("k", "f1", "label"))


def print_of(node: str):
    """The first print of a node's name."""
    return F.split(node, ":")[0].cast("long")


def open_links(left: DataFrame, label: DataFrame, sets: DataFrame, threshold: float, count_weights: bool) -> DataFrame:
    """(a, b, s): links that buckets of several classes, `left` (k, f1, label), still allow.

    In such a bucket the members outside its most common class, its home, are asked against all of that class and against
    each other. Members and asked ones of a home are dealt into blocks by hash; each block of asked ones meets each block
    of the home in a group of its own. Links alone come out, for each asked document at most one to each class.
    """
    most = left.groupBy("k", "label").agg(F.count("*").alias("n")).groupBy("k").agg(F.max(F.struct("n", "label")).alias("m")).select("k", F.col("m.label").alias("home"))
    asked = left.join(most, "k").where("label != home").groupBy("home", "f1").agg(F.first("label").alias("label")).withColumn("asks", F.lit(True))
    homes = asked.select("home").distinct()
    own = label.select(F.col("label").alias("home"), print_of("id").alias("f1")).join(homes, "home")
    alone = homes.where(~F.col("home").contains(":")).select("home", F.col("home").cast("long").alias("f1"))  # a class of one is named by its print
    inside = own.unionByName(alone).select("home", "f1", F.col("home").alias("label"), F.lit(False).alias("asks"))
    sized = sets.select("f1", (F.octet_length("h") / 8).alias("size"))
    rows = cut(asked.unionByName(inside, allowMissingColumns=True).join(sized, "f1"))
    # a home's blocks are counted once and sent to SALTS places, so that a large home's rows are spread
    blocks = lambda n, size: F.ceil(F.greatest(n, size)).cast("int")
    parts = blocks(F.count("*") / BLOCK_ROWS, F.sum("size") / BLOCK_SHINGLES)
    turns = blocks(F.count_if("asks") / BLOCK_ASKED, F.sum(F.when(F.col("asks"), F.col("size")).otherwise(0)) / ASKED_SHINGLES)
    counts = rows.groupBy("home").agg(parts.alias("parts"), turns.alias("turns"))
    salted = counts.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    placed = rows.withColumn("salt", F.pmod(F.xxhash64("f1"), F.lit(SALTS)).cast("int")).join(salted, ["home", "salt"])
    block = lambda of, seed: F.pmod(F.xxhash64("f1", F.lit(seed)), F.col(of)).cast("int")
    every = lambda of: F.sequence(F.lit(0), F.col(of) - 1)
    targets = placed.select("home", "f1", "label", F.lit(0).alias("role"), block("parts", 1).alias("i"), F.explode(every("turns")).alias("j"))
    asks = placed.where("asks").select("home", "f1", "label", F.lit(1).alias("role"), F.explode(every("parts")).alias("i"), block("turns", 2).alias("j"))
    met = targets.unionByName(asks).join(sets, "f1")
    return linked_in_groups(met, threshold, count_weights)


def linked_in_groups(met: DataFrame, threshold: float, count_weights: bool) -> DataFrame:
    """(a, b, s) of the links between asked rows and the others of each group (home, i, j)."""

    def compare(batches):
        held: list[pd.DataFrame] = []
        for b in batches:
            if not len(b):
                continue
            number = b[["home", "i", "j"]].ne(b[["home", "i", "j"]].shift()).any(axis=1).to_numpy()
            last = len(b) - 1 - int(np.argmax(number[::-1]))  # the last group of the batch may go on
            begun = held and tuple(held[-1][["home", "i", "j"]].iloc[-1]) != tuple(b[["home", "i", "j"]].iloc[0])
            if begun or last:
                yield block_links(pd.concat([*held, b.iloc[:last]]), threshold, count_weights)
                held = []
            held.append(b.iloc[last:])
        if held:
            yield block_links(pd.concat(held), threshold, count_weights)

    dealt = met.select("home", "i", "j", "role", "node", "label", "h", "w").repartition("home", "i", "j").sortWithinPartitions("home", "i", "j")
    return cut(dealt.mapInPandas(compare, "a string, b string, s double"))


def block_links(rows: pd.DataFrame, threshold: float, count_weights: bool, most: int = 1 << 19) -> pd.DataFrame:
    """(a, b, s) of the links from asked rows to the others of their group, for rows sorted by group (home, i, j).

    All groups of a batch are searched at once: a shingle's key holds its group, and what is found is checked by both.
    Asked rows go in slices of about `most` shingles found.
    """
    group = np.cumsum(rows[["home", "i", "j"]].ne(rows[["home", "i", "j"]].shift()).any(axis=1).to_numpy()) - 1
    asks = rows["role"].to_numpy() == 1
    size = rows["h"].map(len).to_numpy() // 8
    unpacked = lambda of: np.frombuffer(b"".join(rows["h"][of]), np.uint64)
    weighed = lambda of: np.frombuffer(b"".join(rows["w"][of]), "<f4").astype(float) if count_weights else np.ones(int(size[of].sum()))
    node, label = rows["node"].to_numpy(), rows["label"].to_numpy()
    # members
    h, w = unpacked(~asks), weighed(~asks)
    doc = np.repeat(np.flatnonzero(~asks), size[~asks])
    total = np.bincount(doc, w, minlength=len(rows))
    key = h ^ mix(group[doc].astype(np.uint64))
    order = np.argsort(key)
    key, h, w, doc = key[order], h[order], w[order], doc[order]
    # asked ones
    x, v = unpacked(asks), weighed(asks)
    by = np.repeat(np.flatnonzero(asks), size[asks])
    own = np.bincount(by, v, minlength=len(rows))
    sought = x ^ mix(group[by].astype(np.uint64))
    low = np.searchsorted(key, sought, "left")
    n = np.searchsorted(key, sought, "right") - low
    a, b, s = [], [], []
    ends = np.cumsum(n)
    bounds = np.flatnonzero(np.concatenate([[True], by[1:] != by[:-1]])) if len(by) else np.zeros(0, np.int64)
    # slices begin where an asked row does
    first = 0
    while first < len(by):
        reach = ends[first] - n[first] + most
        after = bounds[np.searchsorted(bounds, first, "right") :]
        fit = after[ends[after - 1] <= reach]
        stop = int(fit[-1]) if len(fit) else int(after[0]) if len(after) else len(by)
        if len(after) == len(fit) and ends[-1] <= reach:
            stop = len(by)
        part = slice(first, stop)
        m = n[part]
        at = np.repeat(low[part] - np.cumsum(m) + m, m) + np.arange(m.sum())
        back = np.repeat(np.arange(first, stop), m)
        true = (h[at] == x[back]) & (group[doc[at]] == group[by[back]])
        at, back = at[true], back[true]
        pair = by[back] * len(rows) + doc[at]
        pairs, place = np.unique(pair, return_inverse=True)
        common = np.bincount(place, np.minimum(w[at], v[back]), minlength=len(pairs))
        p, q = pairs // len(rows), pairs % len(rows)
        share = common / np.maximum(total[q] + own[p] - common, 1e-12)
        # an asked row's link to a class is its first one
        good = np.flatnonzero((share >= threshold) & (label[p] != label[q]) & (node[p] != node[q]))
        to = pd.DataFrame({"p": p[good], "class": label[q[good]]})
        good = good[~to.duplicated().to_numpy()]
        a.append(node[p[good]])
        b.append(node[q[good]])
        s.append(share[good])
        first = stop
    return pd.DataFrame({"a": np.concatenate([np.zeros(0, object), *a]), "b": np.concatenate([np.zeros(0, object), *b]), "s": np.concatenate([np.zeros(0), *s])})


def set_classes(source: DataFrame, n: int, threshold: float, bands: int, rows: int, count_weights: bool) -> tuple[DataFrame, DataFrame]:
    """Of texts (id, t): (id, print, f1, f2) of each, and (id, label) of each node "f1:f2" that is linked with others."""
    parts = band_parts(source, bands)
    signed = cut(signed_rows(source, n, bands, rows, count_weights, 1, parts))
    docs = signed.where("f1 is not null").select("id", "print", "f1", "f2")
    met = cut(signed.where("k is not null").select("k", "p", "m").unionByName(dealt_pairs(signed, parts)))
    wanted = met.select(F.explode(F.array("p", "m")).alias("f1")).distinct()
    first = docs.join(few(wanted), "f1", "left_semi").groupBy("f1", "f2").agg(F.min("id").alias("id")).select("id").distinct()
    return docs, linked_classes(met, cut(_shared_sets(source, first, n, count_weights)).dropDuplicates(["node"]), threshold, count_weights)


def linked_classes(met: DataFrame, sets: DataFrame, threshold: float, count_weights: bool) -> DataFrame:
    """(id, label) of the nodes that are linked: of sets (node, f1, h, w) that share a bucket, by pairs (k, p, m) of f1."""
    links = compared(met.select("p", "m").distinct(), sets, threshold, count_weights)
    label = components(links.select("a", "b"))
    left = mixed_buckets(met, label)
    if left.isEmpty():
        return label
    more = open_links(left, label, sets, threshold, count_weights)
    return label if more.isEmpty() else components(links.select("a", "b").unionByName(more.select("a", "b")))


def text_classes(docs: DataFrame, key: str = "doc_id", text: str = "text", n: int = 5, threshold: float = 0.8, bands: int = 30, rows: int = 5, count_weights: bool = False) -> DataFrame:
    """(id, print, class_id, first, n) of each text of each key: `print` is the text's xxhash64, `first` tells the class's
    text of the smallest key (within it, of the smallest print), and n how many rows are alike in key and text."""
    source = docs.where(F.col(key).isNotNull()).select(F.col(key).alias("id"), F.col(text).alias("t"))
    signed, label = set_classes(source, n, threshold, bands, rows, count_weights)
    alike = cut(signed.groupBy("f1", "f2", "id", "print").agg(F.count("*").alias("n")))
    # sets that stand alone are settled at once; the others get their class's name and its smallest key
    several = alike.groupBy("f1", "f2").agg(F.count("*").alias("n"), F.min(F.struct("id", "print")).alias("top"))
    named = label.select(print_of("id").alias("f1"), F.split("id", ":")[1].cast("long").alias("f2"), "label")
    groups_ = several.join(named, ["f1", "f2"], "left").where("n > 1 or label is not null").withColumn("label", F.coalesce("label", F.concat_ws(":", "f1", "f2")))
    tops = groups_.groupBy("label").agg(F.min("top").alias("top"))
    of_set = groups_.select("f1", "f2", "label").join(tops, "label").select("f1", "f2", "top")
    out = alike.join(of_set, ["f1", "f2"], "left").withColumn("top", F.coalesce("top", F.struct("id", "print")))
    return out.select("id", "print", F.col("top.id").alias("class_id"), ((F.col("id") == F.col("top.id")) & (F.col("print") == F.col("top.print"))).alias("first"), "n")


def classes(docs: DataFrame, key: str = "doc_id", text: str = "text", n: int = 5, threshold: float = 0.8, bands: int = 30, rows: int = 5, count_weights: bool = False) -> DataFrame:
    """One row for each document: its key and class_id, the class's smallest key."""
    found = text_classes(docs, key, text, n, threshold, bands, rows, count_weights)
    return found.select(F.col("id").alias(key), "class_id", F.explode(F.expr("array_repeat(0, int(n))")).alias("x")).drop("x")
