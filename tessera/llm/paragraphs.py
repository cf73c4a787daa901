"""Repeated paragraphs and passages: MinHash banding over lines, exact windows inside them, removal by components.

A line of at least `min_words` words is a paragraph, whatever its length; shorter lines that follow each other are one.
Paragraphs meet when they share a band of MinHash rows; `tune_bands` takes the fewest bands that reach the wanted recall
at the threshold. A pair is verified by exact Jaccard similarity of its word shingles. In a bucket a member is compared
with one pivot only, so a group of copies makes links in its own number; buckets that then still hold several classes
are compared exactly in blocks. In each component of verified links the first paragraph stays (smallest document id,
then first place) and the others go.

Passages that stand inside lines, or go over line breaks, are exact: every string of `min_passage` words that also
starts earlier goes. They are found by the depth-limited radix sort of `substrings`, over word hashes in place of bytes.
What goes of a document is joined into passages, and passages under `min_passage` words are left alone.

Scale: words, bands and runs are made in one pass over the texts, and dealt out once, in packed blocks. Equal paragraphs,
bands and runs are reduced within a batch first, so that a very common line costs a row for each batch. Texts move once,
to meet the windows asked for and then the removals; of near pairs only packed shingle sets move.

Defined cases: null and empty texts have no units; rows alike in id and text are one document; different texts under one
id are documents of their own, in the order of their hashes; null ids are left out; only key and text are read.
"""

from __future__ import annotations

from math import ceil, log

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._deal import PAIRS, digit, filled, grouped, pair_rows
from ._spark import cut, few, named, numbered
from ._text import WORD, groups, hash_words, mix, seeded, shingles
from .neardup import linked_classes, print_of
from .substrings import SPAN, Hasher, _by_part, _doc_bounds, _doc_part, _firsts, _frame, _join_spans, _later, _loaded, _packed, ask_windows, by_part, reduced_runs, resolved_runs, sort_windows, text_parts, window_runs

#: A paragraph: prints of its words, its document, first word and number of words.
UNIT = np.dtype([("a", "<u8"), ("s", "<u8"), ("doc", "<i8"), ("at", "<u4"), ("n", "<u4")])
#: Prints of paragraphs that a task remembers.
SEEN = 500_000
#: What a pass gives: blocks, pairs of prints that share a band, and paragraphs (repeats E with the document kept, firsts F).
_ROWS = f"kind string, part int, block binary, {PAIRS}, f1 long, f2 long, doc long, at long, n long, kept long"


def tune_bands(threshold: float, recall: float, rows: int) -> int:
    """The fewest bands of so many rows that find a pair at the threshold with the wanted chance."""
    return ceil(log(1 - recall) / log(1 - threshold**rows))


def line_words(text: str | None) -> tuple[list[str], list[int]]:
    """The lower-cased words, and how many each line that has any holds."""
    lines = [x for x in map(WORD.findall, (text or "").split("\n")) if x]
    found = [w for x in lines for w in x]
    return "\n".join(found).lower().split("\n") if found else [], [len(x) for x in lines]


def unit_bounds(count: np.ndarray, doc: np.ndarray, min_words: int) -> tuple[np.ndarray, np.ndarray]:
    """(first word, words) of the paragraphs, from the words of the lines and the documents of these."""
    if not len(count):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    first = np.cumsum(count) - count
    short = count < min_words
    goes_on = np.concatenate([[False], short[1:] & short[:-1] & (doc[1:] == doc[:-1])])  # a short line after a short one
    start = first[~goes_on]
    size = np.diff(np.append(start, count.sum()))
    return start[size >= min_words], size[size >= min_words]


def units(text: str | None, min_words: int) -> list[tuple[int, int]]:
    """(first word, end word) of each paragraph of a text."""
    _, count = line_words(text)
    start, size = unit_bounds(np.array(count, np.int64), np.zeros(len(count), np.int64), min_words)
    return list(zip(start.tolist(), (start + size).tolist(), strict=True))


def unit_prints(h: np.ndarray, start: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Two 64-bit prints of the words of each paragraph, in their order."""
    ends = np.cumsum(size)
    at = np.repeat(start - ends + size, size) + np.arange(ends[-1] if len(ends) else 0)
    place = mix(np.arange(int(size.max(initial=0)), dtype=np.uint64))[at - np.repeat(start, size)]
    words, to = h[at] + place, np.concatenate([[0], ends])
    add = lambda x: np.diff(np.concatenate([[np.uint64(0)], np.cumsum(x, dtype=np.uint64)])[to])
    return mix(add(seeded(1, words))), mix(add(seeded(2, words)))


def minhash_bands(s: np.ndarray, to: np.ndarray, bands: int, rows: int) -> np.ndarray:
    """The band keys (texts x bands) of texts whose shingles, one at least, begin at `to`: a row is the least of the
    shingles' hashes, themselves random, under an order of its own."""
    turn = seeded(100, np.arange(bands * rows, dtype=np.uint64))
    out = np.zeros((len(to) - 1, bands), np.uint64)
    for k in range(bands):
        key = np.full(len(to) - 1, np.uint64(k))
        for r in range(rows):
            salt = turn[k * rows + r]
            low = np.minimum.reduceat((s ^ salt) * (salt | np.uint64(1)), to[:-1])
            key = mix(key * np.uint64(31) + low)
        out[:, k] = key
    return out


def scan(batches, width: int, gram: int, parts: int, bands: int, rows: int, n: int, min_words: int, flush: int = 20 << 20):
    """Over the texts once: runs of windows (kinds A, R, W), paragraphs (U, E) and band rows (B, and pairs P)."""
    hasher = Hasher()
    seen: set[int] = set()
    runs, made, keys, values, words, size = [], [], [], [], {}, 0

    def flushed():
        if runs:
            yield _frame(list(reduced_runs(np.concatenate(runs), words, width, parts, hasher)))
        if made:
            own, first = _firsts(np.concatenate(made), ("a", "s"))
            yield repeated_units(own, first)
            own = own[first == np.arange(len(own))]
            yield _frame(list(_packed("U", own, digit(own["a"], parts), parts)))
        if keys:
            k, v, head = grouped(np.concatenate(keys), np.concatenate(values))
            yield pd.DataFrame({"kind": "P", **pair_rows(k, v, head)})
            pivots = head == np.arange(len(k))
            yield _frame(list(_packed("B", band_block(k[pivots], v[pivots]), digit(k[pivots], parts), parts)))
        for x in (runs, made, keys, values, words):
            x.clear()

    for b in batches:
        texts = b["t"].tolist()
        for i, j in groups(texts):
            tokens, lines, line_doc, at = [], [], [], [0]
            for x, t in enumerate(texts[i:j]):
                found, count = line_words(t)
                tokens += found
                lines += count
                line_doc += [x] * len(count)
                at.append(len(tokens))
            if not tokens:
                continue
            ids, h, at = b["id"].iloc[i:j].to_numpy(np.int64), hash_words(tokens), np.array(at)
            runs.append(window_runs(h, at, ids, width, gram, hasher))
            words.update((int(d), h[x:y]) for d, x, y in zip(ids, at[:-1], at[1:], strict=True))
            start, count = unit_bounds(np.array(lines, np.int64), np.array(line_doc, np.int64), min_words)
            own = np.zeros(len(start), UNIT)
            own["a"], own["s"] = unit_prints(h, start, count)
            of = np.searchsorted(at, start, side="right") - 1
            own["doc"], own["at"], own["n"] = ids[of], start - at[of], count
            made.append(own)
            # of equal paragraphs in a task the first alone stands in the bands
            if len(seen) > SEEN:
                seen.clear()
            fresh = np.array([x not in seen and not seen.add(x) for x in own["a"].tolist()], bool)
            size += runs[-1].nbytes + own.nbytes + h.nbytes
            if fresh.any():
                start, count, value = start[fresh], count[fresh], own["a"][fresh]
                ends = np.cumsum(count)
                place = np.repeat(start - ends + count, count) + np.arange(ends[-1])
                key = minhash_bands(*shingles(h[place], np.concatenate([[0], ends]), n), bands, rows)
                keys.append(key.ravel())
                values.append(np.repeat(value, bands))
                size += 2 * key.nbytes
            if size >= flush:
                yield from flushed()
                size = 0
    yield from flushed()


BAND = np.dtype([("w", "<u8"), ("a", "<u8"), ("doc", "<i8"), ("at", "<u4")])


def band_block(key: np.ndarray, value: np.ndarray) -> np.ndarray:
    """Band rows as rows of a block, whose places stay empty."""
    out = np.zeros(len(key), BAND)
    out["w"], out["a"] = key, value
    return out


def repeated_units(rows: np.ndarray, first: np.ndarray) -> pd.DataFrame:
    """Of sorted paragraphs, those that repeat another's words (E), with the document of the first one."""
    later = _later(rows, first)
    own, kept = rows[later], rows["doc"][first[later]]
    return pd.DataFrame({"kind": "E", "f1": own["a"].view(np.int64), "f2": own["s"].view(np.int64), "doc": own["doc"], "at": own["at"].astype(np.int64), "n": own["n"].astype(np.int64), "kept": kept})


def sort_all(batches, width: int, gram: int, parts: int):
    """What the dealt blocks hold: the runs' R and Q, W as it is, pairs (P) of the bands, repeated (E) and first (F) paragraphs."""
    for kind, part, blocks in _by_part(batches):
        if kind == "A":
            yield _frame(list(resolved_runs(blocks, width, gram, parts)))
        elif kind == "B":
            rows = _loaded(blocks, BAND)
            yield pd.DataFrame({"kind": "P", **pair_rows(*grouped(rows["w"].copy(), rows["a"].copy()))})
        elif kind == "U":
            rows, first = _firsts(_loaded(blocks, UNIT), ("a", "s"))
            yield repeated_units(rows, first)
            own = rows[first == np.arange(len(rows))]
            yield pd.DataFrame({"kind": "F", "f1": own["a"].view(np.int64), "f2": own["s"].view(np.int64), "doc": own["doc"], "at": own["at"].astype(np.int64), "n": own["n"].astype(np.int64)})
        else:
            yield _frame([(kind, part, b) for b in blocks])


_KINDS = {"string": pa.string(), "int": pa.int32(), "long": pa.int64(), "binary": pa.binary()}
_SCHEMA = pa.schema([(c.split()[0], _KINDS[c.split()[1]]) for c in _ROWS.split(", ")])


def _rows_of(frames):
    """Frames as batches with all columns of _ROWS."""
    for frame in frames:
        if len(frame):
            yield filled(_SCHEMA, **{c: frame[c].to_numpy() for c in frame})


def scan_batches(batches, *args):
    yield from _rows_of(scan((b.to_pandas() for b in batches), *args))


def sort_batches(batches, width: int, gram: int, parts: int):
    """Blocks are sorted; pairs and repeated paragraphs pass through."""
    blocks = []
    for b in batches:
        done = b.column("block").is_null()
        yield b.filter(done)
        blocks.append(b.select(["kind", "part", "block"]).filter(pc.invert(done)).to_pandas())
    yield from _rows_of(sort_all(blocks, width, gram, parts))


def unit_sets(source: DataFrame, wanted: DataFrame, n: int) -> DataFrame:
    """(node, f1, h, w): the shingle sets of the wanted paragraphs (f1, f2, doc, at, n); their documents' texts alone are read."""
    own = F.sort_array(F.collect_list(F.struct("at", "n", "f1", "f2"))).alias("xs")
    by_doc = wanted.groupBy("doc").agg(own)

    def sets(batches):
        for b in batches:
            for t, xs in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                h = hash_words(line_words(t)[0])
                s, to = shingles(np.concatenate([h[x["at"] : x["at"] + x["n"]] for x in xs]), np.cumsum([0, *(x["n"] for x in xs)]), n)
                packed = [np.unique(s[i:j]).tobytes() for i, j in zip(to[:-1], to[1:], strict=True)]
                yield pa.record_batch({"node": [f"{x['f1']}:{x['f2']}" for x in xs], "f1": pa.array([x["f1"] for x in xs], pa.int64()), "h": pa.array(packed, pa.binary()), "w": pa.nulls(len(xs), pa.binary())})

    return source.join(few(by_doc), source["id"] == by_doc["doc"]).select("t", "xs").mapInArrow(sets, "node string, f1 long, h binary, w binary")


_PASSAGES = "doc long, start long, end long, n_words long, kept long, class string"


class Places:
    """Where the words of a text stand: words are counted line by line, and looked for in the lines asked about alone."""

    def __init__(self, text: str) -> None:
        self.lines = text.split("\n")
        self.count = np.fromiter((len(WORD.findall(x)) for x in self.lines), np.int64, len(self.lines))
        self.ends = np.cumsum(self.count)
        self.start = np.cumsum([0, *(len(x) + 1 for x in self.lines)])
        self.spans: dict[int, list[tuple[int, int]]] = {}

    def of(self, word: int) -> tuple[int, int]:
        line = int(np.searchsorted(self.ends, word, side="right"))
        if line not in self.spans:
            self.spans[line] = [m.span() for m in WORD.finditer(self.lines[line])]
        a, b = self.spans[line][word - int(self.ends[line] - self.count[line])]
        return int(self.start[line]) + a, int(self.start[line]) + b


def passages(texts: pd.DataFrame, spans: pd.DataFrame, min_words: int, min_passage: int) -> pd.DataFrame:
    """What goes of each document of a part: the words of removed paragraphs and of repeated windows, joined."""
    packed = spans["block"].notna().to_numpy()
    own = _join_spans(_loaded(spans.loc[packed, "block"], SPAN))
    inside = {int(d): own[i:j] for d, i, j in _doc_bounds(own)}
    units_ = spans.loc[~packed, ["doc", "at", "n", "kept", "class"]].sort_values(["doc", "at", "kept", "class"])
    lines = {int(d): (i, j) for d, i, j in _doc_bounds(units_[["doc"]].to_records(index=False))}
    at, n, kept_doc, label_of = (units_[c].to_numpy() for c in ("at", "n", "kept", "class"))
    out = []
    for doc, t in zip(texts["id"].tolist(), texts["t"], strict=True):
        found, exact = lines.pop(doc, None), inside.pop(doc, None)
        if found is None and exact is None:
            continue
        place = Places(t)
        # for each word the number of what it goes with, from 1; -1 for what lies between two paragraphs that go
        item, kept = np.zeros(int(place.count.sum()), np.int64), [(0, "")]
        if found is not None:
            some = place.count[place.count > 0]
            first, _ = unit_bounds(some, np.zeros(len(some), np.int64), min_words)
            number = np.searchsorted(first, at[found[0] : found[1]])
            last = None
            for k, x in enumerate(range(*found)):
                a, b = int(at[x]), int(at[x] + n[x])
                item[a:b] = len(kept)
                kept.append((int(kept_doc[x]), label_of[x]))
                if last is not None and number[k - 1] + 1 == number[k]:
                    gap = item[last:a]
                    gap[gap == 0] = -1
                last = b
        for x in exact if exact is not None else ():
            part = item[x["at"] : x["at"] + x["n"]]
            part[part <= 0] = len(kept)
            kept.append((int(x["kept"]), None))
        edge = np.flatnonzero(np.diff(np.concatenate([[False], item != 0, [False]])))
        for a, b in zip(edge[::2].tolist(), edge[1::2].tolist(), strict=True):
            gone = item[a:b][item[a:b] > 0]
            if len(gone) >= min_passage:
                change = gone[np.concatenate([[True], gone[1:] != gone[:-1]])].tolist()
                out.append((doc, place.of(a)[0], place.of(b - 1)[1], len(gone), kept[change[0]][0], next((kept[k][1] for k in change if kept[k][1]), None)))
    return pd.DataFrame(out, columns=["doc", "start", "end", "n_words", "kept", "class"])


def repeats(docs: DataFrame, key: str = "doc_id", text: str = "text", n: int = 5, threshold: float = 0.8, rows: int = 3, recall: float = 0.995, min_words: int = 6, min_passage: int = 16, gram: int = 5, part_bytes: int = 16 << 20) -> DataFrame:
    """One row for each removed passage: doc_id, start, end (code points), n_words, kept_doc_id, class_id.

    kept_doc_id is a document that holds the passage's first words earlier; class_id names the class of paragraphs that
    the passage's first removed paragraph is of, and is null where exact windows alone go.
    """
    source, names = numbered(docs.where(F.col(key).isNotNull()).select(F.col(key).cast("long").alias("id"), F.col(text).alias("t")))
    source = source.dropDuplicates(["id"]) if names is not None else source  # rows alike
    parts = text_parts(source, int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")), part_bytes)
    bands = tune_bands(threshold, recall, rows)
    gram = min(gram, min_passage)
    shape = lambda f, *a: lambda batches: f(batches, *a)
    scanned = source.mapInArrow(shape(scan_batches, min_passage, gram, parts, bands, rows, n, min_words), _ROWS)
    place = F.coalesce("part", F.pmod(F.xxhash64("k", "m", "f1", "doc", "at"), F.lit(parts)).cast("int"))
    done = cut(scanned.repartition(parts, place).mapInArrow(shape(sort_batches, min_passage, gram, parts), _ROWS))

    met = done.where("kind = 'P'").select("k", "p", "m")
    first = done.where("kind = 'F'").select("f1", "f2", "doc", "at", "n")
    again = done.where("kind = 'E'").select("f1", "f2", "doc", "at", "n", "kept")
    meets = few(met.select(F.explode(F.array("p", "m")).alias("f1")).distinct())
    wanted = cut(first.join(meets, "f1", "left_semi"))
    label = linked_classes(met, cut(unit_sets(source, wanted, n)), threshold, False)
    classed = label.select(print_of("id").alias("f1"), F.split("id", ":")[1].cast("long").alias("f2"), "label")
    own = wanted.join(classed, ["f1", "f2"])
    top = own.groupBy("label").agg(F.min(F.struct("doc", "at")).alias("top"))
    near = own.join(top, "label").where((F.col("doc") != F.col("top.doc")) | (F.col("at") != F.col("top.at"))).select("doc", "at", "n", F.col("top.doc").alias("kept"), F.col("label").alias("class"))
    equal = again.join(few(classed), ["f1", "f2"], "left").select("doc", "at", "n", "kept", F.coalesce("label", F.concat_ws(":", "f1", "f2")).alias("class"))

    @F.pandas_udf("int")
    def part_of(ids: pd.Series) -> pd.Series:
        return pd.Series(_doc_part(ids.to_numpy(), parts))

    lines = near.unionByName(equal).withColumn("part", part_of("doc"))
    blocks = done.where("block is not null").select("kind", "part", "block")
    texts = by_part(source, parts)

    def asked(key_, texts: pd.DataFrame, blocks: pd.DataFrame) -> pd.DataFrame:
        symbols = lambda t: hash_words(line_words(t)[0])
        return _frame(ask_windows(int(key_[0]), texts, blocks["block"].tolist(), min_passage, parts, symbols) if len(blocks) else [])

    def removed(_, texts: pd.DataFrame, spans: pd.DataFrame) -> pd.DataFrame:
        return passages(texts, spans, min_words, min_passage)

    kinds = "kind string, part int, block binary"
    windows = texts.cogroup(blocks.where("kind = 'Q'").groupBy("part")).applyInPandas(asked, kinds).unionByName(blocks.where("kind = 'W'"))
    dealt = windows.repartition(parts, "part").mapInPandas(lambda batches: sort_windows(batches, min_passage, parts), kinds)
    none = [F.lit(0).cast("long").alias(c) for c in ("doc", "at", "n", "kept")]  # pandas would turn nulls among longs to floats
    spans = dealt.unionByName(blocks.where("kind = 'R'")).select("part", "block", *none, F.lit("").alias("class")).unionByName(lines, allowMissingColumns=True)
    result = texts.cogroup(spans.groupBy("part")).applyInPandas(removed, _PASSAGES)
    result = named(result, names, "doc", "kept")
    return result.select(F.col("doc").alias("doc_id"), "start", "end", "n_words", F.col("kept").alias("kept_doc_id"), F.col("class").alias("class_id"))
