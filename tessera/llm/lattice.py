"""Language-model scores by a subword lattice: the probability of a text summed over all its segmentations into pieces.

A text is its words (A to Z lower-cased, parted by white space), each begun by a mark, and one end. A vocabulary's pieces
are the edges of a lattice over each word; the log-space forward recursion sums the paths. No piece crosses the start of
a word, so a document's marginal is the sum of its words' marginals and the end's. The vocabulary and its scores are
given (`Pieces`); scores that are ranks of merges and not log probabilities stand for weights of 1 / (1 + rank). They are
the prior of the pieces' probabilities, which `rounds` of expected counts over all training words (forward and backward
over the same lattices, the expectation-maximisation of a unigram model) then fit to the training documents. Characters
without a piece go by the byte pieces of their UTF-8 form. The base score is a smoothed unigram model of whole words.

Spark does the counting: documents are read once and packed into bundles of some 8 million characters, which hold each
distinct word once; a bundle's words go to the part that their hash names, where all counts of a word meet and its
lattice is scored once; the answers go back to the bundles. So a word costs a row entry for each bundle that has it,
however common it is, and no text, no vocabulary of the corpus and no count of words reaches the driver or a broadcast.
What is shipped is the piece table, of the vocabulary's size. A task holds one bundle, or the distinct words of one part.

Defined cases: a null text is empty and has the end alone; rows are documents each, repeated ids too; a null or false
training flag is no training document; without training documents the prior alone scores and N is 0; an empty table
gives no rows; other columns are not read.
"""

from __future__ import annotations

import zlib
from dataclasses import dataclass
from math import log10

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ._spark import cut, fresh_dir

MARK = "▁"
LOWER = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))
#: Characters of a bundle, words of a row of the word table, characters whose lattices are made at once.
BUNDLE, ROW_WORDS, LATTICE = 8 << 20, 1 << 16, 1 << 19
#: Words that one part is sent, at most about.
PART_WORDS = 1 << 23
LN10 = np.log(10.0)


def words(text: str | None) -> list[bytes]:
    return text.encode("utf-8", "surrogatepass").translate(LOWER).split() if text else []


@dataclass(frozen=True)
class Pieces:
    """A piece vocabulary: texts, prior log probabilities, the places of the 256 byte pieces and of the end."""

    texts: list[str]
    prior: np.ndarray
    bytes_at: np.ndarray
    end: int

    @staticmethod
    def read(path: str) -> Pieces:
        """The pieces of a sentencepiece model, control and unused ones left out."""
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=path)
        own = [i for i in range(model.get_piece_size()) if not (model.is_control(i) or model.is_unknown(i) or model.is_unused(i))]
        plain = [i for i in own if not model.is_byte(i)]
        # no piece may go on over the start of a word
        plain = [i for i in plain if MARK not in model.id_to_piece(i).lstrip(MARK)]
        scores = np.array([model.get_score(i) for i in plain])
        return Pieces.of([model.id_to_piece(i) for i in plain], scores)

    @staticmethod
    def of(texts: list[str], scores: np.ndarray) -> Pieces:
        """Scores are log probabilities if they sum to about one, else ranks below zero."""
        total = float(np.exp(np.minimum(scores, 1.0)).sum())
        weight = np.exp(scores) if 0.9 <= total <= 1.1 else 1.0 / (1.0 + scores.max() - scores)
        rare = np.full(257, (weight.min() if len(weight) else 1.0) / 257)
        weight = np.concatenate([weight, rare])
        n = len(texts)
        return Pieces(list(texts), np.log(weight / weight.sum()), np.arange(n, n + 256), n + 256)


class Lattices:
    """All lattices of a list of words at once."""

    def __init__(self, pieces: Pieces) -> None:
        nodes: dict[tuple[int, int], int] = {}
        piece = {}
        for k, text in enumerate(pieces.texts):
            at = 0
            for c in text:
                at = nodes.setdefault((at, ord(c)), len(nodes) + 1)
            piece[at] = k
        key = np.array([(a << 21) | c for a, c in nodes], np.int64)
        order = np.argsort(key)
        self.key, self.to = key[order], np.fromiter(nodes.values(), np.int64)[order]
        self.piece = np.full(len(nodes) + 1, -1, np.int64)
        self.piece[list(piece)] = list(piece.values())
        self.bytes_at = pieces.bytes_at

    def step(self, node: np.ndarray, code: np.ndarray) -> np.ndarray:
        """The node that a character leads to, or -1."""
        if not len(self.key):
            return np.full(len(node), -1, np.int64)
        key = (node << 21) | code
        at = np.minimum(np.searchsorted(self.key, key), len(self.key) - 1)
        return np.where(self.key[at] == key, self.to[at], -1)

    def edges(self, texts: list[bytes]):
        """(start, end, piece) over one row of places for all words, the bytes of unknown characters as (start, byte
        piece), the first place of each word, and each place's distance from it."""
        joined = np.frombuffer("".join(MARK + t.decode("utf-8", "surrogatepass") for t in texts).encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.int64)
        size = np.array([len(t.decode("utf-8", "surrogatepass")) + 1 for t in texts], np.int64)
        first = np.cumsum(size + 1) - (size + 1)  # a place more than characters in each word
        place = np.arange(len(joined)) + np.repeat(np.arange(len(texts)), size)
        code = np.full(int(first[-1] + size[-1]) + 2, -1, np.int64)
        code[place] = joined
        start, node, found = place, np.zeros(len(place), np.int64), []
        lone, width = None, 0
        while len(start):
            here = code[start + width]
            real = here >= 0
            start, node, here = start[real], node[real], here[real]
            node = self.step(node, here)
            width += 1
            known = node >= 0
            hit = self.piece[np.maximum(node, 0)] >= 0
            hit &= known
            if width == 1:
                lone = start[~hit]
            found.append((start[hit], start[hit] + width, self.piece[node[hit]]))
            start, node = start[known], node[known]
        spelled = [chr(c).encode("utf-8", "surrogatepass") for c in code[lone].tolist()]
        at = np.repeat(lone, [len(s) for s in spelled])
        own = self.bytes_at[np.frombuffer(b"".join(spelled), np.uint8)]
        offset = np.zeros(len(code), np.int64)
        offset[place] = place - np.repeat(first, size)
        offset[first + size] = size
        return [np.concatenate(x) for x in zip(*found, strict=True)], (lone, at, own), first, size, offset

    def chunks(self, texts: list[bytes]):
        """Places of words of like length, in lists of a bounded number of characters."""
        size = np.array([len(t) + 2 for t in texts], np.int64)
        order = np.argsort(size, kind="stable")
        ends = np.cumsum(size[order])
        at = 0
        while at < len(order):
            to = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + LATTICE, "right")))
            yield order[at:to]
            at = to

    def forward(self, texts: list[bytes], weight: np.ndarray, counts: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray | None]:
        """The log probability of each word, and, if the words' counts are given, the expected counts of the pieces."""
        out = np.zeros(len(texts))
        expected = None if counts is None else np.zeros(len(weight))
        for own in self.chunks(texts):
            (start, end, piece), (lone, at, byte), first, size, offset = self.edges([texts[k] for k in own])
            # an unknown character is an edge of the weight of all its bytes
            spelled = np.zeros(len(offset))
            np.add.at(spelled, at, weight[byte])
            start, end = np.concatenate([start, lone]), np.concatenate([end, lone + 1])
            cost = np.concatenate([weight[piece], spelled[lone]])
            levels = self._levels(offset[start])
            alpha = np.full(len(offset), -np.inf)
            alpha[first] = 0.0
            for edge in levels:
                alpha[end[edge]] = np.logaddexp(alpha[end[edge]], alpha[start[edge]] + cost[edge])
            total = alpha[first + size]
            out[own] = total
            if counts is None:
                continue
            beta = np.full(len(offset), -np.inf)
            beta[first + size] = 0.0
            for edge in reversed(self._levels(offset[end])):
                beta[start[edge]] = np.logaddexp(beta[start[edge]], cost[edge] + beta[end[edge]])
            word = np.searchsorted(first, start, "right") - 1
            seen = np.exp(alpha[start] + cost + beta[end] - total[word]) * counts[own][word]
            expected += np.bincount(piece, seen[: len(piece)], minlength=len(weight))
            by_place = np.zeros(len(offset))
            by_place[lone] = seen[len(piece) :]
            expected += np.bincount(byte, by_place[at], minlength=len(weight))
        return out, expected

    @staticmethod
    def _levels(offset: np.ndarray) -> list[np.ndarray]:
        """The edges of each distance from the word's start, in ascending order. Edges of one level meet no place twice."""
        narrow = offset.astype(np.uint16) if len(offset) and offset.max() < 1 << 16 else offset
        order = np.argsort(narrow, kind="stable")
        cuts = np.flatnonzero(np.diff(offset[order])) + 1
        return np.split(order, cuts) if len(order) else []


class Numbers(dict):
    """Numbers keys as they come."""

    def __missing__(self, key):
        self[key] = n = len(self)
        return n


PACKED = "bundle long, part int, n long, words binary, counts binary, ids array<{}>, n_tokens binary, n_pairs binary, pair_word binary, pair_tf binary"


def _bundle(number: int, ids: pa.Array, trained: np.ndarray, tokens: Numbers, found: list[np.ndarray], parts: int, schema: pa.Schema) -> pa.RecordBatch:
    """A bundle's documents (part -1) and its words for each part; words are numbered in the order of the parts."""
    size = np.array([len(x) for x in found], np.int64)
    wide = max(1, len(tokens))
    texts = list(tokens)
    part = np.array([zlib.crc32(w) % parts for w in texts], np.int64)
    order = np.argsort(part, kind="stable")
    place = np.empty(len(order), np.int64)
    place[order] = np.arange(len(order))
    key, tf = np.unique(np.repeat(np.arange(len(size)), size) * wide + place[np.concatenate([*found, np.zeros(0, np.int64)])], return_counts=True)
    doc, word = key // wide, key % wide
    learnt = np.bincount(word, tf * trained[doc], minlength=len(texts)).astype(np.int64)
    cuts = np.searchsorted(part[order], np.arange(parts + 1))
    some = np.flatnonzero(np.diff(cuts))
    blocks = [[texts[k] for k in order[cuts[p] : cuts[p + 1]]] for p in some]
    packed = lambda x, kind: pa.array([x.astype(kind).tobytes()] + [None] * len(some), pa.binary())
    columns = {
        "bundle": pa.array([number] * (1 + len(some)), pa.int64()), "part": pa.array([-1, *some.tolist()], pa.int32()),
        "n": pa.array([len(texts), *(len(b) for b in blocks)], pa.int64()), "words": pa.array([None, *map(b" ".join, blocks)], pa.binary()),
        "counts": pa.array([None, *(learnt[cuts[p] : cuts[p + 1]].tobytes() for p in some)], pa.binary()),
        "ids": pa.array([ids.to_pylist()] + [None] * len(some), pa.list_(ids.type)), "n_tokens": packed(size + 1, np.int64),
        "n_pairs": packed(np.bincount(doc, minlength=len(size)), np.int64), "pair_word": packed(word, np.int32), "pair_tf": packed(tf, np.int32),
    }
    return pa.RecordBatch.from_arrays([columns[f.name] for f in schema], schema=schema)


def _packed(docs: DataFrame, parts: int, kind: str) -> DataFrame:
    """Bundles of documents (id, t, trained), written once."""

    def pack(batches):
        tokens, found, ids, trained, chars, seq, schema = Numbers(), [], [], [], 0, 0, None
        task = TaskContext.get().partitionId() << 32

        def flush():
            return _bundle(task + seq, pa.chunked_array(ids).combine_chunks(), np.concatenate(trained), tokens, found, parts, schema)

        for b in batches:
            if schema is None:
                binary = [("words", pa.binary()), ("counts", pa.binary()), ("ids", pa.list_(b["id"].type)), *((c, pa.binary()) for c in ("n_tokens", "n_pairs", "pair_word", "pair_tf"))]
                schema = pa.schema([("bundle", pa.int64()), ("part", pa.int32()), ("n", pa.int64()), *binary])
            at = 0
            for k, t in enumerate(b["t"].to_pylist()):
                own = words(t)
                found.append(np.fromiter(map(tokens.__getitem__, own), np.int64, len(own)))
                chars += len(t or "") + 64
                if chars >= BUNDLE:
                    ids.append(b["id"].slice(at, k + 1 - at))
                    trained.append(b["trained"].slice(at, k + 1 - at).to_numpy(zero_copy_only=False).astype(bool))
                    yield flush()
                    tokens, found, ids, trained, chars, seq, at = Numbers(), [], [], [], 0, seq + 1, k + 1
            if at < len(b):
                ids.append(b["id"].slice(at))
                trained.append(b["trained"].slice(at).to_numpy(zero_copy_only=False).astype(bool))
        if found:
            yield flush()

    home = fresh_dir(docs.sparkSession, "lattice")
    docs.mapInArrow(pack, PACKED.format(kind)).write.option("compression", "zstd").parquet(home)
    return docs.sparkSession.read.schema(PACKED.format(kind)).parquet(home)


def _word_table(asks: DataFrame, parts: int) -> DataFrame:
    """Each distinct word with its count in the training documents, packed: part, n, words, counts."""

    def count(batches):
        total: dict[int, dict[bytes, int]] = {}
        for b in batches:
            for part, joined, n in zip(b["part"].to_pylist(), b["words"].to_pylist(), b["counts"].to_pylist(), strict=True):
                own = total.setdefault(part, {})
                for w, c in zip(joined.split(b" "), np.frombuffer(n, np.int64).tolist(), strict=True):
                    own[w] = own.get(w, 0) + c
        for part, own in total.items():
            every, counts = list(own), np.fromiter(own.values(), np.int64)
            for at in range(0, len(every), ROW_WORDS):
                some = every[at : at + ROW_WORDS]
                rows = [pa.array([part], pa.int32()), pa.array([len(some)], pa.int64()), pa.array([b" ".join(some)], pa.binary()), pa.array([counts[at : at + ROW_WORDS].tobytes()], pa.binary())]
                yield pa.RecordBatch.from_arrays(rows, ["part", "n", "words", "counts"])

    return cut(asks.select("part", "words", "counts").repartitionById(parts, "part").mapInArrow(count, "part int, n long, words binary, counts binary"))


def fit(table: DataFrame, pieces: Pieces, n_ends: int, rounds: int = 2) -> np.ndarray:
    """Log probabilities of the pieces: expected counts over all training words on top of the prior, which weighs as one
    count a piece on average."""
    weight = pieces.prior
    prior = np.exp(pieces.prior) * len(weight)
    for _ in range(rounds):
        shipped = table.sparkSession.sparkContext.broadcast((pieces, weight))

        def expect(batches, shipped=shipped):
            own, now = shipped.value
            lattices, total = Lattices(own), np.zeros(len(now))
            for b in batches:
                for joined, n in zip(b["words"].to_pylist(), b["counts"].to_pylist(), strict=True):
                    counts = np.frombuffer(n, np.int64)
                    known = np.flatnonzero(counts)
                    every = joined.split(b" ")
                    total += lattices.forward([every[k] for k in known.tolist()], now, counts[known])[1]
            some = np.flatnonzero(total)
            yield pa.RecordBatch.from_arrays([pa.array(some), pa.array(total[some])], ["piece", "n"])

        found = table.select("words", "counts").mapInArrow(expect, "piece long, n double").groupBy("piece").agg(F.sum("n").alias("n")).collect()
        count = prior.copy()
        for piece, n in found:  # no more rows than pieces
            count[piece] += n
        count[pieces.end] += n_ends
        weight = np.log(count / count.sum())
    return weight


def score(docs: DataFrame, trained: Column, vocabulary: str | Pieces, key: str = "doc_id", text: str = "text", rounds: int = 2) -> DataFrame:
    """One row for each document: doc_id, n_tokens, n_known, train_tokens, base_score, score (log10).

    `trained` says which documents are learnt from; `vocabulary` is a sentencepiece model's path or a `Pieces`.
    """
    spark = docs.sparkSession
    pieces = Pieces.read(vocabulary) if isinstance(vocabulary, str) else vocabulary
    kind = docs.schema[key].dataType.simpleString()
    source = docs.select(F.col(key).alias("id"), F.col(text).alias("t"), F.coalesce(trained, F.lit(False)).alias("trained"))
    n_ends, chars = source.agg(F.count_if("trained"), F.sum(F.length("t"))).first()
    least = int(spark.conf.get("spark.sql.shuffle.partitions"))
    parts = max(least, -(-(chars or 0) // (4 * PART_WORDS)))
    packed = _packed(source, parts, kind)
    asks = packed.where("part >= 0")
    table = _word_table(asks, parts)
    weight = fit(table, pieces, n_ends, rounds)

    def sums(batches):
        n = v = 0
        for b in batches:
            for x in b["counts"].to_pylist():
                counts = np.frombuffer(x, np.int64)
                n, v = n + int(counts.sum()), v + int(np.count_nonzero(counts))
        yield pa.RecordBatch.from_arrays([pa.array([n], pa.int64()), pa.array([v], pa.int64())], ["n", "v"])

    found = table.select("counts").mapInArrow(sums, "n long, v long").agg(F.sum("n"), F.sum("v")).first()
    n_train, distinct = (found[0] or 0) + n_ends, (found[1] or 0) + (n_ends > 0)
    shipped = spark.sparkContext.broadcast((pieces, weight))

    def answer(batches):
        own, now = shipped.value
        lattices, count, prob, number = None, [], [], {}
        for b in batches:
            for bundle, joined, n in zip(b["bundle"].to_pylist(), b["words"].to_pylist(), b["counts"].to_pylist(), strict=True):
                every = joined.split(b" ")
                if bundle is None:  # the part's words come before what is asked
                    lattices = lattices or Lattices(own)
                    number.update(zip(every, range(len(number), len(number) + len(every)), strict=True))
                    count.append(np.frombuffer(n, np.int64))
                    prob.append(lattices.forward(every, now)[0])
                    continue
                if len(count) > 1:
                    count, prob = [np.concatenate(count)], [np.concatenate(prob)]
                at = np.fromiter(map(number.__getitem__, every), np.int64, len(every))
                part = pa.array([zlib.crc32(every[0]) % parts], pa.int32())
                yield pa.RecordBatch.from_arrays([pa.array([bundle], pa.int64()), part, pa.array([count[0][at].tobytes()], pa.binary()), pa.array([prob[0][at].tobytes()], pa.binary())], ["bundle", "part", "c", "p"])

    none = F.lit(None).cast("long").alias("bundle")
    asked = table.select(none, "part", "words", "counts").unionByName(asks.select("bundle", "part", "words", F.lit(None).cast("binary").alias("counts")))
    answers = asked.repartitionById(parts, "part").sortWithinPartitions(F.col("bundle").asc_nulls_first()).select("bundle", "words", "counts").mapInArrow(answer, "bundle long, part int, c binary, p binary")
    own = ["ids", "n_tokens", "n_pairs", "pair_word", "pair_tf"]
    rows = packed.where("part < 0").select("bundle", "part", *own, *(F.lit(None).cast("binary").alias(c) for c in "cp"))
    rows = rows.unionByName(answers, allowMissingColumns=True)
    end, floor = float(weight[pieces.end]) / LN10, log10(n_train + 0.5 * (distinct + 1))

    def docs_of(held: dict, c: list, p: list) -> pa.RecordBatch:
        count = np.concatenate([*(np.frombuffer(x, np.int64) for x in c), np.zeros(0, np.int64)])
        prob = np.concatenate([*(np.frombuffer(x) for x in p), np.zeros(0)])
        size, pairs = (np.frombuffer(held[x], np.int64) for x in ("n_tokens", "n_pairs"))
        word, tf = (np.frombuffer(held[x], np.int32) for x in ("pair_word", "pair_tf"))
        doc = np.repeat(np.arange(len(size)), pairs)
        total = lambda x: np.bincount(doc, x, minlength=len(size))
        known = total(tf * (count[word] > 0)).astype(np.int64) + (n_ends > 0)
        base = total(tf * np.log10(count[word] + 0.5)) + log10(n_ends + 0.5) - size * floor
        columns = held["ids"], pa.array(size), pa.array(known), pa.array(np.full(len(size), n_train)), pa.array(base), pa.array(total(tf * prob[word]) / LN10 + end)
        return pa.RecordBatch.from_arrays(list(columns), ["doc_id", "n_tokens", "n_known", "train_tokens", "base_score", "score"])

    def finish(batches):
        held, c, p = None, [], []
        for b in batches:
            for k in range(len(b)):
                if b["part"][k].as_py() < 0:
                    if held:
                        yield docs_of(held, c, p)
                    held, c, p = {x: b[x][k].as_py() for x in own[1:]} | {"ids": b["ids"][k].values}, [], []
                else:
                    c.append(b["c"][k].as_py())
                    p.append(b["p"][k].as_py())
        if held:
            yield docs_of(held, c, p)

    bundles = max(least, -(-(chars or 0) // BUNDLE))  # about one for each task
    return rows.repartition(bundles, "bundle").sortWithinPartitions("bundle", "part").drop("bundle").mapInArrow(finish, f"doc_id {kind}, n_tokens long, n_known long, train_tokens long, base_score double, score double")
