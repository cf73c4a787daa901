"""Exact removal of repeated byte strings by a depth-limited, most-significant-digit radix sort of windows.

A string of `width` bytes is a repeat if it also starts earlier (smaller document id, or the same document and an
earlier start); every byte that a repeat covers goes. Only the first `width` bytes of a suffix ever matter, so windows
are sorted to that depth, in passes over ever deeper digits, and a group that can hold no repeat drops out early:

1. Digit one of a window is its anchor, the smallest hashed `gram`-byte string inside it. Equal windows have equal
   anchors at equal places, and neighbouring windows share an anchor, so one row stands for a run of windows.
   Occurrences are dealt out by the leading digits of a hash of the anchor and sorted by it; single ones drop out.
2. Digit two is the hash of all bytes that the run of windows covers. Runs equal in it repeat as a whole.
3. Runs of a shared anchor with different bytes around it go on if they share the bytes on one side of it, to the
   depth that a window needs. They are resolved window by window: the windows' own hashes are dealt out by their leading digits and sorted; equal groups are exactly the repeated windows.

Digits one and two together have 128 bits, and a window's hash has 96. Before each deal, equal keys within a batch are reduced to their
first occurrence, so a key costs a row for each batch and not for each copy. An anchor with many different surroundings
in one batch goes straight to pass 3, whose keys are spread. Rows are packed in binary blocks for each digit. Texts
move once, to meet their removals; nothing is gathered on the driver but counts.

Defined cases: null text is empty; a null id's row takes no part and keeps its text; rows alike in id and text are the
same document, and the same start in it is not earlier; different texts under one id are documents of their own, in the
order of their hashes. Texts under `width` bytes lose nothing. Only key and text are read.
"""

from __future__ import annotations

import hashlib
import struct
import zlib

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._spark import cut, named, numbered
from ._text import mix

_P = 0x9E3779B97F4A7C15 | 1
_Q = 0xC2B2AE3D27D4EB4F | 1
#: Bytes of a text hashed at a time; its windows join over the borders.
PIECE = 1 << 20

RUN = np.dtype([("a", "<u8"), ("s", "<u8"), ("doc", "<i8"), ("at", "<u4"), ("n", "u1"), ("place", "u1"), ("left", "<u2"), ("right", "<u2")])
WINDOW = np.dtype([("w", "<u8"), ("w2", "<u4"), ("doc", "<i8"), ("at", "<u4")])
SPAN = np.dtype([("doc", "<i8"), ("at", "<i8"), ("n", "<i8"), ("kept", "<i8")])  # kept: a document that holds it earlier
HOT = np.uint8(0xFF)  # as a run's length: the anchor is to be resolved by windows


def _powers(base: int, n: int) -> tuple[np.ndarray, np.ndarray]:
    """base^i and base^-i modulo 2^64, for i below n."""
    up = np.ones(n, np.uint64)
    up[1:] = np.uint64(base)
    down = np.ones(n, np.uint64)
    down[1:] = np.uint64(pow(base, -1, 1 << 64))
    return np.multiply.accumulate(up), np.multiply.accumulate(down)


class Hasher:
    """Rolling hashes of byte strings, from prefix sums of bytes times powers of an odd number."""

    def __init__(self) -> None:
        self.up, self.down = {}, {}
        self.grow(1 << 14)

    def grow(self, n: int) -> None:
        self.size = n
        for k, b in enumerate((_P, _Q)):
            self.up[k], self.down[k] = _powers(b, n + 1)

    def prefix(self, data: np.ndarray, k: int) -> np.ndarray:
        if len(data) > self.size:
            self.grow(max(len(data), 2 * self.size))
        out = np.zeros(len(data) + 1, np.uint64)
        np.cumsum((data.astype(np.uint64) + np.uint64(1)) * self.up[k][: len(data)], out=out[1:])
        return out

    def of(self, prefix: np.ndarray, k: int, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        return mix((prefix[end] - prefix[start]) * self.down[k][start] + (end - start).astype(np.uint64))


def runs_of(data: np.ndarray, doc: int, width: int, gram: int, hasher: Hasher, base: int = 0) -> np.ndarray:
    """A RUN for each maximal run of windows with the same anchor occurrence."""
    out = window_runs(data, np.array([0, len(data)]), np.array([doc]), width, gram, hasher)
    out["at"] += np.uint32(base)
    return out


def window_runs(data: np.ndarray, bounds: np.ndarray, docs: np.ndarray, width: int, gram: int, hasher: Hasher) -> np.ndarray:
    """A RUN for each maximal run of windows with the same anchor occurrence, of texts that follow each other."""
    if len(data) < width:
        return np.zeros(0, RUN)
    p, q = hasher.prefix(data, 0), hasher.prefix(data, 1)
    i = np.arange(len(data) - gram + 1)
    h = hasher.of(p, 0, i, i + gram)
    span = width - gram + 1  # grams in a window; minima over powers of two, then over two overlapping ones
    best, size = i.copy(), 1
    while size * 2 <= span:
        left, right = best[:-size], best[size:]
        best = np.where(h[left] <= h[right], left, right)
        size *= 2
    if size < span:
        left, right = best[: len(data) - width + 1], best[span - size : span - size + len(data) - width + 1]
        best = np.where(h[left] <= h[right], left, right)
    ok = np.ones(len(best), bool)  # windows that lie in one text
    for e in bounds[1:-1]:
        ok[max(0, e - width + 1) : e] = False
    goes_on = np.zeros(len(best), bool)
    goes_on[1:] = (best[1:] == best[:-1]) & ok[1:] & ok[:-1]
    first = np.flatnonzero(ok & ~goes_on)
    stops = np.append(np.flatnonzero(~goes_on), len(best))
    n = stops[np.searchsorted(stops, first, side="right")] - first
    of = np.searchsorted(bounds, first, side="right") - 1
    out = np.zeros(len(first), RUN)
    out["a"], out["doc"], out["at"], out["n"] = h[best[first]], docs[of], first - bounds[of], n
    end = first + n - 1 + width
    # where the anchor stands in the run belongs to its identity, too
    at = best[first]
    out["place"] = at - first
    out["s"] = mix(hasher.of(q, 1, first, end) + out["place"].astype(np.uint64))
    # a window holds `side` symbols or more before its anchor, or after it; 0: no window of the run does
    side = -(-(width - gram) // 2)
    for name, ok, start in (("left", at - side >= first, at - side), ("right", first + n - 1 + width >= at + gram + side, at)):
        hashed = hasher.of(p, 0, start[ok], start[ok] + gram + side)
        out[name][ok] = (hashed >> np.uint64(48)).astype(np.uint16) | np.uint16(1)
    return out


def runs_of_text(raw: bytes, doc: int, width: int, gram: int, hasher: Hasher) -> np.ndarray:
    parts = []
    for start in range(0, max(1, len(raw) - width + 1), PIECE):
        data = np.frombuffer(raw, np.uint8, min(len(raw) - start, PIECE + width - 1), start)
        parts.append(runs_of(data, doc, width, gram, hasher, start))
    return np.concatenate(parts)


def windows_of(data: np.ndarray, doc: int, starts: np.ndarray, width: int, hasher: Hasher) -> np.ndarray:
    out = np.zeros(len(starts), WINDOW)
    p, q = hasher.prefix(data, 0), hasher.prefix(data, 1)
    out["w"], out["w2"] = hasher.of(p, 0, starts, starts + width), (hasher.of(q, 1, starts, starts + width) >> np.uint64(32)).astype(np.uint32)
    out["doc"], out["at"] = doc, starts
    return out


def _firsts(rows: np.ndarray, keys: tuple[str, ...]) -> tuple[np.ndarray, np.ndarray]:
    """The rows sorted by keys and place, and for each row the index of the first one of its group."""
    rows = rows[np.lexsort((rows["at"], rows["doc"], *(rows[k] for k in reversed(keys))))]
    new = np.ones(len(rows), bool)
    if len(rows):
        new[1:] = np.logical_or.reduce([rows[k][1:] != rows[k][:-1] for k in keys])
    return rows, np.maximum.accumulate(np.where(new, np.arange(len(rows)), 0)) if len(rows) else np.zeros(0, int)


def _later(rows: np.ndarray, first: np.ndarray) -> np.ndarray:
    return (rows["doc"] != rows["doc"][first]) | (rows["at"] != rows["at"][first])


def _repeats(rows: np.ndarray, first: np.ndarray, later: np.ndarray, length: np.ndarray | int) -> np.ndarray:
    """The spans of the later rows, with the documents of the rows that they repeat, joined."""
    out = np.zeros(int(later.sum()), SPAN)
    out["doc"], out["at"], out["n"], out["kept"] = rows["doc"][later], rows["at"][later], length, rows["doc"][first[later]]
    return _join_spans(out)


def _join_spans(spans: np.ndarray) -> np.ndarray:
    """Overlapping or touching spans of a document joined."""
    if not len(spans):
        return spans
    spans = spans[np.lexsort((spans["at"], spans["doc"]))]
    # ends grow within a document; a new document starts over
    _, number = np.unique(spans["doc"], return_inverse=True)
    end = spans["at"] + spans["n"]
    step = int(end.max()) + 1
    reach = np.maximum.accumulate(end + number * step) - number * step
    new = np.ones(len(spans), bool)
    new[1:] = (spans["doc"][1:] != spans["doc"][:-1]) | (spans["at"][1:] > reach[:-1])
    start = np.flatnonzero(new)
    out = spans[start]
    out["n"] = reach[np.append(start[1:], len(spans)) - 1] - out["at"]
    return out


def dump(rows: np.ndarray) -> bytes:
    """Rows as bytes, by column in the order of documents; what is not a hash is small then, and deflated."""
    rows = rows[np.lexsort((rows["at"], rows["doc"]))]
    plain, small = [], []
    for name in rows.dtype.names:
        column = np.ascontiguousarray(rows[name])
        if name in ("a", "s", "w", "w2"):
            plain.append(column.tobytes())
            continue
        if name in ("doc", "at"):
            column[1:] -= column[:-1].copy()
        small.append(column.view(np.uint8).reshape(len(rows), column.itemsize).T.tobytes())
    return struct.pack("<q", len(rows)) + b"".join(plain) + zlib.compress(b"".join(small), 1)


def load(block: bytes, kind: np.dtype) -> np.ndarray:
    (n,) = struct.unpack_from("<q", block)
    out, at = np.zeros(n, kind), 8
    if not n:
        return out
    plain = [x for x in kind.names if x in ("a", "s", "w", "w2")]
    for name in plain:
        out[name] = np.frombuffer(block, kind[name], n, at)
        at += n * kind[name].itemsize
    rest, at = zlib.decompress(memoryview(block)[at:]), 0
    for name in kind.names:
        if name not in plain:
            size = kind[name].itemsize
            column = np.frombuffer(rest, np.uint8, n * size, at).reshape(size, n).T.copy().view(kind[name])[:, 0]
            out[name] = np.cumsum(column, dtype=kind[name]) if name in ("doc", "at") else column
            at += n * size
    return out


def _loaded(blocks, kind: np.dtype) -> np.ndarray:
    return np.concatenate([np.zeros(0, kind), *(load(b, kind) for b in blocks)])


def _packed(kind: str, rows: np.ndarray, part: np.ndarray, parts: int):
    """(kind, part, block) of each part's rows."""
    order = np.argsort(part, kind="stable")
    bounds = np.searchsorted(part[order], np.arange(parts + 1))
    for k in np.flatnonzero(np.diff(bounds)):
        yield kind, int(k), dump(rows[order[bounds[k] : bounds[k + 1]]])


def _digit(key: np.ndarray, parts: int) -> np.ndarray:
    """The leading digit of a 64-bit key, for a radix of `parts`."""
    return ((key >> np.uint64(32)) * np.uint64(parts) >> np.uint64(32)).astype(np.int64)


def _doc_part(doc: np.ndarray, parts: int) -> np.ndarray:
    return _digit(mix(doc.astype(np.uint64)), parts)


def _frame(rows: list) -> pd.DataFrame:
    return pd.DataFrame(rows, columns=["kind", "part", "block"])


_BLOCKS = "kind string, part int, block binary"


def _dealt(blocks: DataFrame, parts: int) -> DataFrame:
    return blocks.repartition(parts, "part")


def reduced_runs(rows: np.ndarray, symbols: dict[int, np.ndarray], width: int, parts: int, hasher: Hasher, hot: int = 512):
    """The runs of a batch (kind A) reduced to the first of each, the batch's repeats (R), and hot anchors' windows (W)."""
    rows, first = _firsts(rows, ("a", "s"))
    later = _later(rows, first)
    repeats = [_repeats(rows, first, later, rows["n"][later].astype(np.int64) + (width - 1))]
    lone = rows[first == np.arange(len(rows))]
    _, back, count = np.unique(lone["a"], return_inverse=True, return_counts=True)
    wide = count[back] >= hot
    if wide.any():
        made = []
        big = np.sort(lone[wide], order="doc")
        for doc, i, j in _doc_bounds(big):
            starts = np.concatenate([np.arange(a, a + n) for a, n in zip(big["at"][i:j], big["n"][i:j].astype(int), strict=True)])
            made.append(windows_of(symbols[int(doc)], int(doc), starts, width, hasher))
        w, at = _firsts(np.concatenate(made), ("w", "w2"))
        repeats.append(_repeats(w, at, _later(w, at), width))
        w = w[at == np.arange(len(w))]
        yield from _packed("W", w, _digit(w["w"], parts), parts)
        mark = lone[wide][np.unique(lone["a"][wide], return_index=True)[1]]
        mark["n"] = HOT
        lone = np.concatenate([lone[~wide], mark])
    # anchors are the smallest hashes around them, so the leading digits of these are not spread; a second hash's are
    yield from _packed("A", lone, _digit(mix(lone["a"]), parts), parts)
    joined = _join_spans(np.concatenate(repeats))
    yield from _packed("R", joined, _doc_part(joined["doc"], parts), parts)


def scan_runs(batches, width: int, gram: int, parts: int, flush: int = 1 << 19, hot: int = 512):
    """Pass 1, map side: what `reduced_runs` gives for about `flush` times 40 bytes of runs and texts at a time."""
    hasher = Hasher()
    held: list[np.ndarray] = []
    texts: dict[int, np.ndarray] = {}
    size = 0
    for b in batches:
        for doc, text in zip(b["id"], b["t"], strict=True):
            raw = (text or "").encode()
            if len(raw) < width:
                continue
            held.append(runs_of_text(raw, int(doc), width, gram, hasher))
            texts[int(doc)] = np.frombuffer(raw, np.uint8)
            size += held[-1].nbytes + len(raw)
            if size >= flush * 40:
                yield _frame(list(reduced_runs(np.concatenate(held), texts, width, parts, hasher, hot)))
                held.clear()
                texts.clear()
                size = 0
    if held:
        yield _frame(list(reduced_runs(np.concatenate(held), texts, width, parts, hasher, hot)))


def _by_part(batches):
    """(kind, part, blocks) of a partition; each part once."""
    held: dict[tuple[str, int], list[bytes]] = {}
    for b in batches:
        for kind, part, block in zip(b["kind"], b["part"], b["block"], strict=True):
            held.setdefault((kind, part), []).append(block)
    for kind, part in sorted(held):
        yield kind, part, held.pop((kind, part))


def _shared(rows: np.ndarray, name: str) -> np.ndarray:
    """Where another run of the same anchor has the same bytes on that side of it."""
    key = rows["a"] ^ mix(rows[name].astype(np.uint64))
    _, back, count = np.unique(key, return_inverse=True, return_counts=True)
    return (rows[name] != 0) & (count[back] > 1)


def _asked(rows: np.ndarray, width: int, gram: int) -> np.ndarray:
    """The windows to resolve, as spans of their starts: those whose longer side the anchor's other runs share, too."""
    _, back = np.unique(rows["a"], return_inverse=True)
    marked = np.bincount(back, rows["n"] == HOT, minlength=1)[back] > 0 if len(rows) else np.zeros(0, bool)
    own = rows["n"] != HOT
    side = -(-(width - gram) // 2)
    first, place, n = rows["at"].astype(np.int64), rows["place"].astype(np.int64), rows["n"].astype(np.int64)
    turn = np.clip(place - side + 1, 0, n)  # so many windows have their longer side before the anchor
    before, after = own & (_shared(rows, "left") | marked) & (turn > 0), own & (_shared(rows, "right") | marked) & (turn < n)
    out = np.zeros(int(before.sum() + after.sum()), SPAN)
    out["doc"] = np.concatenate([rows["doc"][before], rows["doc"][after]])
    out["at"] = np.concatenate([first[before], (first + turn)[after]])
    out["n"] = np.concatenate([turn[before], (n - turn)[after]])
    return out


def resolved_runs(blocks: list[bytes], width: int, gram: int, parts: int):
    """Passes 1 and 2 of a part's runs: repeats (R) and runs to resolve by windows (Q)."""
    rows, first = _firsts(_loaded(blocks, RUN), ("a", "s"))
    hot = rows["n"] == HOT
    later = _later(rows, first) & ~hot
    repeats = _repeats(rows, first, later, rows["n"][later].astype(np.int64) + (width - 1))
    distinct = rows[(first == np.arange(len(rows))) | hot]
    _, back, count = np.unique(distinct["a"], return_inverse=True, return_counts=True)
    asked = _asked(distinct[count[back] > 1], width, gram)
    yield from _packed("R", repeats, _doc_part(repeats["doc"], parts), parts)
    yield from _packed("Q", asked, _doc_part(asked["doc"], parts), parts)


def sort_runs(batches, width: int, gram: int, parts: int):
    """Passes 1 and 2, with what has to be passed on (R, W)."""
    for kind, part, blocks in _by_part(batches):
        yield _frame([(kind, part, b) for b in blocks] if kind != "A" else list(resolved_runs(blocks, width, gram, parts)))


def ask_windows(part: int, texts: pd.DataFrame, blocks: list[bytes], width: int, parts: int, symbols=lambda t: np.frombuffer((t or "").encode(), np.uint8)):
    """Pass 3, map side: the windows of the runs asked for (W), reduced within the part, and its repeats (R)."""
    hasher = Hasher()
    asked = np.sort(_loaded(blocks, SPAN), order=["doc", "at"])
    bounds = {int(d): (i, j) for d, i, j in _doc_bounds(asked)}
    made = []
    for doc, text in zip(texts["id"], texts["t"], strict=True):
        if doc in bounds:
            i, j = bounds.pop(doc)
            starts = np.concatenate([np.arange(a, a + n) for a, n in zip(asked["at"][i:j], asked["n"][i:j], strict=True)])
            made.append(windows_of(symbols(text), int(doc), starts, width, hasher))
    if not made:
        return []
    rows, first = _firsts(np.concatenate(made), ("w", "w2"))
    repeats = _repeats(rows, first, _later(rows, first), width)
    rows = rows[first == np.arange(len(rows))]
    return [*_packed("W", rows, _digit(rows["w"], parts), parts), *_packed("R", repeats, np.full(len(repeats), part), parts)]


def _doc_bounds(rows: np.ndarray):
    if len(rows):
        start = np.flatnonzero(np.concatenate([[True], rows["doc"][1:] != rows["doc"][:-1]]))
        yield from zip(rows["doc"][start], start, np.append(start[1:], len(rows)), strict=True)


def sort_windows(batches, width: int, parts: int):
    """Pass 3: the repeats (R) among the windows; repeats found before are passed on."""
    for kind, part, blocks in _by_part(batches):
        if kind != "W":
            yield _frame([(kind, part, b) for b in blocks])
            continue
        rows, first = _firsts(_loaded(blocks, WINDOW), ("w", "w2"))
        repeats = _repeats(rows, first, _later(rows, first), width)
        yield _frame(list(_packed("R", repeats, _doc_part(repeats["doc"], parts), parts)))


_RESULT = "id long, known boolean, n_bytes long, n_removed long, n_spans long, kept_sha256 string, starts array<long>, lengths array<long>"


def remove(texts: pd.DataFrame, blocks: list[bytes]) -> pd.DataFrame:
    """Each text's result, from the repeats of a part's documents."""
    spans = _join_spans(_loaded(blocks, SPAN))
    bounds = {int(d): (i, j) for d, i, j in _doc_bounds(spans)}
    rows = []
    for doc, known, text in zip(texts["id"], texts["known"], texts["t"], strict=True):
        raw = (text or "").encode()
        i, j = bounds.get(doc, (0, 0)) if known else (0, 0)
        at, kept = 0, hashlib.sha256()
        for s, n in zip(spans["at"][i:j].tolist(), spans["n"][i:j].tolist(), strict=True):
            kept.update(raw[at:s])
            at = s + n
        kept.update(raw[at:])
        rows.append((doc, known, len(raw), int(spans["n"][i:j].sum()), j - i, kept.hexdigest(), spans["at"][i:j], spans["n"][i:j]))
    return pd.DataFrame(rows, columns=["id", "known", "n_bytes", "n_removed", "n_spans", "kept_sha256", "starts", "lengths"])


def text_parts(source: DataFrame, least: int, part_bytes: int) -> int:
    """So many parts that each has about `part_bytes` of text."""
    size = source.agg(F.sum(F.octet_length("t"))).first()[0] or 0
    return max(least, -(-size // part_bytes))


def by_part(source: DataFrame, parts: int):
    """The texts grouped by the part of their document."""

    @F.pandas_udf("int")
    def part_of(ids: pd.Series) -> pd.Series:
        return pd.Series(_doc_part(ids.to_numpy(), parts))

    return source.withColumn("part", part_of("id")).repartition(parts, "part").groupBy("part")


def repeated_spans(docs: DataFrame, key: str = "doc_id", text: str = "text", width: int = 100, gram: int = 32, part_bytes: int = 8 << 20) -> DataFrame:
    """One row for each input row: id, n_bytes, n_removed, n_spans, kept_sha256, and the removed runs' starts and lengths."""
    id_ = F.col(key).cast("long")
    source, names = numbered(docs.select(id_.alias("id"), F.col(text).alias("t")))
    source = source.select(F.coalesce("id", F.lit(0)).alias("id"), F.col("id").isNotNull().alias("known"), "t")
    parts = text_parts(source, int(source.sparkSession.conf.get("spark.sql.shuffle.partitions")), part_bytes)
    shape = lambda f, *a: lambda batches: f(batches, *a)
    runs = source.where("known").mapInPandas(shape(scan_runs, width, gram, parts), _BLOCKS)
    sorted_runs = cut(_dealt(runs, parts).mapInPandas(shape(sort_runs, width, gram, parts), _BLOCKS))
    texts = by_part(source, parts)

    def asked(key_, texts: pd.DataFrame, blocks: pd.DataFrame) -> pd.DataFrame:
        return _frame(ask_windows(int(key_[0]), texts, blocks["block"].tolist(), width, parts) if len(blocks) else [])

    def removed(_, texts: pd.DataFrame, blocks: pd.DataFrame) -> pd.DataFrame:
        return remove(texts, blocks["block"].tolist())

    windows = texts.cogroup(sorted_runs.where("kind = 'Q'").groupBy("part")).applyInPandas(asked, _BLOCKS).unionByName(sorted_runs.where("kind = 'W'"))
    repeats = _dealt(windows, parts).mapInPandas(shape(sort_windows, width, parts), _BLOCKS).unionByName(sorted_runs.where("kind = 'R'"))
    result = texts.cogroup(repeats.groupBy("part")).applyInPandas(removed, _RESULT)
    result = result.select(F.when(F.col("known"), F.col("id")).alias("id"), "n_bytes", "n_removed", "n_spans", "kept_sha256", "starts", "lengths")
    return named(result, names)
