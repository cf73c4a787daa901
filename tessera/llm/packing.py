"""Best-fit packing of tokenised documents by a grouping genetic algorithm on islands.

Documents become pieces of at most `capacity` tokens; a piece of full length is a sequence of its own. The others are
dealt by hash into blocks of bounded size. A block starts from best-fit decreasing; if that misses the block's lower
bound (its tokens over the capacity, rounded up), the block goes to several islands, each a task with its own seed. A
generation crosses two packings: whole well-filled sequences of one are injected into the other, sequences that hold
the same documents are removed, and the displaced documents are put back best-fit. After each epoch an island's best
packing, its elite, migrates to the next island of the ring. Fitness is the mean squared fill.

Sequences that are full but for `slack` tokens stay; pieces of the others are dealt anew into fewer blocks and packed a
second time, so blocks lose next to nothing against one packing of all.

Memory is one block for a task; nothing but counts reaches the driver. Tokenising runs once, over whole texts.

Defined cases: null text is empty and has the end token alone; repeated rows and ids are packed each; an empty table
gives no rows; null ids are packed like others.
"""

from __future__ import annotations

import json
import re
import zlib

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._spark import cut

# Texts of these characters alone can be split by the plain pattern below as byte-level BPE splits them.
PLAIN = re.compile("[\t\n\r -~À-ÖØ-öø-ſ]*")
SPLIT = r"'s|'t|'re|'ve|'m|'ll|'d| ?[A-Za-zÀ-ÖØ-öø-ſ]+| ?[0-9]+| ?[^\sA-Za-zÀ-ÖØ-öø-ſ0-9]+"
#: How a run of white space goes on: its last character starts the next word. Where no run is longer than one, SINGLE does.
RUNS, SINGLE = r"|\s+(?!\S)|\s+", r"|\s"
LONGER = ("  ", "\n\n", " \n", "\n ", "\t", "\r")


def _byte_signs() -> dict[str, int]:
    """The byte that each sign of a byte-level vocabulary stands for: printable Latin-1 itself, the others from 256 on."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(256 + k): b for k, b in enumerate(rest)}


_BYTE = _byte_signs()


class Encoder:
    """Token ids of texts, equal to the tokenizer's own.

    Plain texts go through a faster byte-pair encoder that is given the tokenizer's own vocabulary, in which a token's
    number is its merge's rank; texts with other characters go through the tokenizer itself.
    """

    def __init__(self, definition: str) -> None:
        import tiktoken
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_str(definition)
        self.tokenizer.encode_special_tokens = True
        spelled = json.loads(definition)
        special = {t["content"] for t in spelled.get("added_tokens", ())}
        ranks = {bytes(map(_BYTE.__getitem__, t)): i for t, i in spelled["model"]["vocab"].items() if t not in special}
        self.runs, self.single = (tiktoken.Encoding("plain", pat_str=SPLIT + spaces, mergeable_ranks=ranks, special_tokens={}) for spaces in (RUNS, SINGLE))

    def encode(self, text: str) -> np.ndarray:
        if not PLAIN.fullmatch(text):
            return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, np.uint32)
        return (self.runs if any(s in text for s in LONGER) else self.single).encode_to_numpy(text)


def cut_pieces(n: int, capacity: int) -> list[tuple[int, int]]:
    """(start, length) of the pieces of n ids; only the first may be shorter than the capacity."""
    if n <= capacity:
        return [(0, n)]
    first = n % capacity or capacity
    return [(0, first), *((s, capacity) for s in range(first, n, capacity))]


def pieces(docs: DataFrame, tokenizer_path: str, key: str = "doc_id", text: str = "text", capacity: int = 2048, end_id: int = 0) -> DataFrame:
    """One row for each piece of each document: doc_id, piece, start, length, ids_crc32."""
    with open(tokenizer_path, encoding="utf-8") as f:
        definition = json.dumps(json.load(f))
    shipped = docs.sparkSession.sparkContext.broadcast(definition)

    def tokenised(batches):
        encoder = Encoder(shipped.value)
        for b in batches:
            rows = []
            for doc, t in zip(b["id"], b["t"], strict=True):
                ids = np.append(encoder.encode(t or ""), np.uint32(end_id)).astype("<u4", copy=False)
                rows += [(doc, k, s, n, zlib.crc32(ids[s : s + n])) for k, (s, n) in enumerate(cut_pieces(len(ids), capacity))]
            yield pd.DataFrame(rows, columns=["doc_id", "piece", "start", "length", "ids_crc32"])

    kind = docs.schema[key].dataType.simpleString()
    return docs.select(F.col(key).alias("id"), F.col(text).alias("t")).mapInPandas(tokenised, f"doc_id {kind}, piece int, start long, length long, ids_crc32 long")


class Packing:
    """Bins of item numbers, findable by their room: a bit for each amount of room that some open bin has."""

    def __init__(self, length: list[int], capacity: int, bins: list[list[int]] = ()) -> None:
        self.length, self.capacity = length, capacity
        self.bins: list[list[int]] = []
        self.room: list[int] = []
        self.by_room: dict[int, list[int]] = {}
        self.mask = 0
        for b in bins:
            self.open(b, capacity - sum(length[i] for i in b))

    def open(self, items: list[int], room: int) -> None:
        self.bins.append(items)
        self.room.append(room)
        self.note(len(self.bins) - 1)

    def note(self, b: int) -> None:
        r = self.room[b]
        self.by_room.setdefault(r, []).append(b)
        self.mask |= 1 << r

    def put(self, items) -> Packing:
        """Each item into the open bin that it leaves the least room in, or a new one."""
        for i in items:
            n = self.length[i]
            fits = self.mask >> n
            if not fits:
                self.open([i], self.capacity - n)
                continue
            r = n + (fits & -fits).bit_length() - 1
            b = self.by_room[r].pop()
            if not self.by_room[r]:
                self.mask ^= 1 << r
            self.bins[b].append(i)
            self.room[b] = r - n
            self.note(b)
        return self

    def fitness(self) -> tuple[int, float]:
        return -len(self.bins), sum((1 - r / self.capacity) ** 2 for r in self.room)


def lower_bound(length: list[int], capacity: int) -> int:
    return -(-sum(length) // capacity)


def decreasing(length: list[int], items) -> list[int]:
    return sorted(items, key=lambda i: -length[i])


def cross(one: Packing, two: Packing, rng) -> Packing:
    """Injects well-filled bins of `two` into `one`."""
    ranked = sorted(range(len(two.bins)), key=lambda b: two.room[b])
    top = ranked[: max(1, len(ranked) // 2)]
    chosen = [two.bins[b] for b in rng.choice(top, int(rng.integers(1, max(2, len(top) // 2 + 1))), replace=False)]
    taken = {i for b in chosen for i in b}
    kept, loose = [list(b) for b in chosen], []
    for b in one.bins:
        if taken.isdisjoint(b):
            kept.append(list(b))
        else:
            loose += [i for i in b if i not in taken]
    return Packing(one.length, one.capacity, kept).put(decreasing(one.length, loose))


def mutate(one: Packing, rng) -> Packing:
    """Takes the least filled bin and some others apart and packs their items anew."""
    worst = max(range(len(one.bins)), key=lambda b: one.room[b])
    out = {worst, *rng.integers(0, len(one.bins), max(2, len(one.bins) // 10)).tolist()}
    loose = [i for b in out for i in one.bins[b]]
    rng.shuffle(loose)
    return Packing(one.length, one.capacity, [list(b) for k, b in enumerate(one.bins) if k not in out]).put(loose)


def evolve(length: list[int], capacity: int, seeds: list[list[list[int]]], seed: int, population: int = 8, generations: int = 40) -> list[list[int]]:
    """The best packing after some generations; `seeds` are packings to start from. Full bins of the best are set aside."""
    rng = np.random.default_rng(seed)
    best = max((Packing(length, capacity, s) for s in seeds), key=Packing.fitness)
    done = [b for b, r in zip(best.bins, best.room, strict=True) if r == 0]
    items = [i for b, r in zip(best.bins, best.room, strict=True) if r for i in b]
    goal = lower_bound([length[i] for i in items], capacity)
    if len(best.bins) - len(done) <= goal:
        return best.bins
    aside = {i for b in done for i in b}
    herd = [Packing(length, capacity, [b for b, r in zip(best.bins, best.room, strict=True) if r])]
    for s in seeds:
        kept = [b for b in s if aside.isdisjoint(b)]
        inside = {i for b in kept for i in b}
        herd.append(Packing(length, capacity, [list(b) for b in kept]).put(decreasing(length, [i for i in items if i not in inside])))
    while len(herd) < population:
        herd.append(Packing(length, capacity).put(rng.permutation(items).tolist()))
    for _ in range(generations):
        herd.sort(key=Packing.fitness, reverse=True)
        if len(herd[0].bins) <= goal:
            break
        a, b = rng.integers(0, max(1, len(herd) // 2)), rng.integers(0, len(herd))
        child = cross(herd[a], herd[b], rng)
        herd[-1] = mutate(child, rng) if rng.random() < 0.5 else child
    return done + max(herd, key=Packing.fitness).bins


_COLUMNS = ["doc_id", "piece", "start", "length", "ids_crc32"]


def _pack_round(rows: DataFrame, block_size: int, capacity: int, islands: int, epochs: int, turn: int) -> DataFrame:
    """The rows with block, bin (within the block), offset and room of the bin."""
    n = rows.count()
    if not n:
        return rows.select("*", F.lit(0).alias("block"), F.lit(0).alias("bin"), F.lit(0).cast("long").alias("offset"), F.lit(0).alias("room")).limit(0)
    blocks = -(-n // block_size)
    # by the row's place in the checkpoint too, so that rows of one id, or rows alike, are dealt to all blocks
    own = F.xxhash64("doc_id", "piece", "start", "length", "ids_crc32", F.monotonically_increasing_id(), F.lit(turn))
    dealt = rows.withColumn("block", F.pmod(own, F.lit(blocks)).cast("int"))
    kind = rows.schema["doc_id"].dataType.simpleString()
    base = f"doc_id {kind}, piece int, start long, length long, ids_crc32 long, block int"

    def first(block: pd.DataFrame) -> pd.DataFrame:
        block = block.sort_values(["length", "doc_id", "piece", "start"], ascending=[False, True, True, True], ignore_index=True)
        length = block["length"].tolist()
        made = Packing(length, capacity).put(range(len(length)))
        return _with_bins(block, made.bins, capacity).assign(open=len(made.bins) > lower_bound(length, capacity))

    packed = cut(dealt.groupBy("block").applyInPandas(first, f"{base}, bin int, offset long, room int, open boolean"))
    fine, hard = packed.where("not open").drop("open"), packed.where("open").drop("open")
    if hard.isEmpty():
        return fine
    every = F.array([F.lit(k) for k in range(islands)])
    state = hard.select("*", F.explode(every).alias("island"), F.lit(0).alias("origin"))

    def island_of(epoch: int):
        def island(rows: pd.DataFrame) -> pd.DataFrame:
            # one packing of the island's own and, after the first epoch, its neighbour's elite
            order = ["length", "doc_id", "piece", "start", "ids_crc32"]
            split = [r.sort_values(order, ascending=[False, True, True, True, True], kind="stable", ignore_index=True) for _, r in rows.groupby("origin")]
            length = split[0]["length"].tolist()
            seeds = [[g.tolist() for g in r.groupby("bin").indices.values()] for r in split]
            number = int(rows["island"].iloc[0])
            return _with_bins(split[0], evolve(length, capacity, seeds, seed=epoch * 1000 + number), capacity)

        return island

    for epoch in range(epochs):
        best = state.groupBy("block", "island").applyInPandas(island_of(epoch), f"{base}, bin int, offset long, room int, island int, origin int")
        moves = F.explode(F.array(F.struct(F.col("island").alias("to"), F.lit(0).alias("from")), F.struct(((F.col("island") + 1) % islands).alias("to"), F.lit(1).alias("from"))))
        state = cut(best)
        if epoch < epochs - 1:
            state = state.withColumn("m", moves).withColumns({"island": F.col("m.to"), "origin": F.col("m.from")}).drop("m")
    won = state.groupBy("block", "island").agg(F.max("bin").alias("bins"), F.sum(F.col("room").cast("double") ** 2).alias("fit")).groupBy("block").agg(F.min(F.struct("bins", -F.col("fit"), "island")).alias("w")).select("block", F.col("w.island").alias("island"))
    return fine.unionByName(state.join(won, ["block", "island"]).drop("island", "origin"))


def _with_bins(rows: pd.DataFrame, bins: list[list[int]], capacity: int) -> pd.DataFrame:
    """Sets bin, offset and room of the rows, which the bins hold by number."""
    length = rows["length"].to_numpy()
    number, offset, room = np.zeros(len(rows), np.int32), np.zeros(len(rows), np.int64), np.zeros(len(rows), np.int32)
    for k, b in enumerate(bins):
        n = length[b]
        ends = np.cumsum(n)
        number[b], offset[b], room[b] = k, ends - n, capacity - ends[-1]
    return rows.assign(bin=number, offset=offset, room=room)


def pack(rows: DataFrame, capacity: int = 2048, block_size: int = 8192, islands: int = 3, epochs: int = 2, slack: int = 2) -> DataFrame:
    """The pieces with sequence_id and offset."""
    rows = cut(rows.select(*_COLUMNS))
    full = rows.where(F.col("length") == capacity).select("*", (-1 - F.monotonically_increasing_id()).alias("sequence_id"), F.lit(0).cast("long").alias("offset"))
    name = lambda turn: (F.lit(turn << 62) + F.col("block").cast("long") * F.lit(1 << 24) + F.col("bin")).alias("sequence_id")
    one = cut(_pack_round(rows.where(F.col("length") < capacity), block_size, capacity, islands, epochs, 0))
    kept = one.where(F.col("room") <= slack).select(*_COLUMNS, name(0), "offset")
    two = _pack_round(one.where(F.col("room") > slack).select(*_COLUMNS), block_size, capacity, islands, epochs, 1).select(*_COLUMNS, name(1), "offset")
    return full.unionByName(kept).unionByName(two)
