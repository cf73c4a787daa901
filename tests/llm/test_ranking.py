"""Ranked lexical search, late session merging and lattice scores against brute force, and their defined edge cases."""

import collections
import itertools
import math
import random
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from conftest import DATA
from oracle import compare, oracle
from tessera.llm import lattice, lexical, queries, sessions

SF = f"{DATA}/sf0.001"


@pytest.fixture(scope="module")
def con():
    return oracle(SF)


@pytest.mark.parametrize("name", sorted(queries.oracle_sql()))
def test_query_equals_its_sql(spark, con, name):
    compare(queries.queries()[name](spark, SF), con, queries.oracle_sql()[name])


# 11


def ranked(docs, items, k=10):
    """By plain loops over strings."""
    terms = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
    own = [(d, collections.Counter(terms(t))) for d, t in docs if terms(t)]
    n_docs, n_terms = len(own), sum(sum(c.values()) for _, c in own)
    df = collections.Counter(t for _, c in own for t in c)
    asked = collections.defaultdict(set)
    for i, t in items:
        asked[i] |= set(terms(t))
    out = []
    for i, want in asked.items():
        scores = []
        for d, c in own:
            n = sum(c.values())
            m = 100 - 90 + (90 * n * n_docs) // n_terms
            s = sum(math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1))) * ((1000000000 * c[t]) // (1000 * c[t] + 8 * m)) for t in want if c[t])
            if s > 0:
                scores.append((-s, d is None, d))
        out += [(i, r, d, -s) for r, (s, _, d) in enumerate(sorted(scores)[:k], 1)]
    return sorted(out, key=repr)


DOCS, ITEMS = "doc_id long, text string, item_id string, score double, rank string", "item_id long, text string, doc_id double"


def test_ranking_equals_brute_force(spark, monkeypatch):
    rng = random.Random(3)
    word = lambda: rng.choice(["ka", "Lo", "MI", "né", "x9", "ß", "漢字"])
    docs = [(i % 70 * 3, " ".join(word() + rng.choice(["", "-", ";"]) + word() for _ in range(rng.randrange(0, 40)))) for i in range(140)]
    docs += [(1, "ka lo " * 50)] * 30 + [(None, "mi mi"), (None, None), (2, ""), (2**60 + 1, "né né"), (5, "!?"), (6, "long " * 20000 + "ka")]
    items = [(i, " ".join(word() for _ in range(rng.randrange(0, 6)))) for i in range(12)] + [(3, "ka zz"), (None, "lo"), (None, "mi"), (7, None), (2**60 + 1, "x9")]
    given = spark.createDataFrame([(*d, "c", 1.0, "r") for d in docs], DOCS).repartition(9), spark.createDataFrame([(*i, 0.5) for i in items], ITEMS)
    want = ranked(docs, items)
    rows = lambda df: sorted((tuple(r) for r in df.select("item_id", "rank", "doc_id", "score").collect()), key=repr)
    assert rows(lexical.search(*given)) == want
    assert rows(lexical.search(*given, chunk=7)) == want  # several chunks of items
    assert lexical.search(given[0].limit(0), given[1]).count() == lexical.search(given[0], given[1].limit(0)).count() == 0


def test_postings_are_summed_in_bounded_groups(monkeypatch):
    monkeypatch.setattr(lexical, "POSTINGS", 5)
    index = lexical.Index(list("ab"), [(0, b"x"), (0, b"y"), (1, b"x")])
    doc, term, impact = np.array([0, 0, 1, 2, 2]), np.array([index.number[t] for t in (b"x", b"y", b"x", b"x", b"y")]), np.array([1, 2, 3, 4, 5])
    got = {(i, d): s for rows in lexical.accumulated(index, doc, term, impact, 3) for i, d, s in zip(*(x.tolist() for x in rows), strict=True)}
    assert got == {(0, 0): 3, (1, 0): 1, (0, 1): 3, (1, 1): 3, (0, 2): 9, (1, 2): 4}


def test_radix_order_is_stable():
    key = np.random.default_rng(1).integers(0, 1 << 40, 5000) // (1 << 20) * (1 << 20)
    assert (lexical.radix_order(key, int(key.max())) == np.argsort(key, kind="stable")).all()


# 12


def merged(events, gap):
    """Every version, by sorting a user's events so far after each batch."""
    own = collections.defaultdict(list)
    for u, s, b, w in events:
        if u is not None and s is not None and b is not None:
            own[u].append((s, b, w or 0))
    out = []
    for u, rows in own.items():
        standing = []
        for b in sorted({r[1] for r in rows}):
            islands = []
            for r in sorted(x for x in rows if x[1] <= b):
                if islands and r[0] - islands[-1][-1][0] <= gap:
                    islands[-1].append(r)
                else:
                    islands.append([r])
            for g in islands:
                if not any(r[1] == b for r in g):
                    continue
                start, end = g[0][0], g[-1][0]
                gone = [v for v in standing if start <= v[2] <= end]
                for v in gone:
                    v[8:] = b, start
                    standing.remove(v)
                out.append([u, b, start, end, len(g), sum(r[1] == b for r in g), len(gone), sum(r[2] for r in g), None, None])
                standing.append(out[-1])
    return sorted(map(tuple, out), key=repr)


EVENTS = "user long, at_s long, batch long, weight long, start_s string, island string, open string"


def test_versions_equal_brute_force(spark):
    rng = random.Random(5)
    events = [(rng.randrange(4), rng.randrange(-3000, 6000), rng.randrange(-2, 6), rng.choice([None, 1, 2**33])) for _ in range(220)]
    events += [(9, rng.randrange(2000), rng.randrange(4), 1) for _ in range(150)] + [events[0]] * 3 + [(None, 1, 1, 1), (1, None, 1, 1), (1, 1, None, 1)]
    df = spark.createDataFrame([(*e, "s", "i", "o") for e in events], EVENTS)
    for gap in (0, 240):
        got = sorted((tuple(r) for r in sessions.versions(df, gap).collect()), key=repr)
        assert got == merged(events, gap)
    assert sessions.versions(df.limit(0)).count() == 0


def test_a_hot_user_costs_a_row_for_each_slot(spark):
    df = spark.range(30000).selectExpr("7L user", "id % 3600 at_s", "id % 2 batch", "1L weight")
    assert sessions.micro_sessions(df, 240).count() == 2 * 15
    got = sessions.versions(df).orderBy("batch").collect()
    assert [(r["n_events"], r["n_new"], r["n_retracted"], r["retracted_batch"]) for r in got] == [(15000, 15000, 0, 1), (30000, 15000, 1, None)]


# 13


def tokens(text):
    return re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


SMALL = lattice.Pieces.of(["▁", "a", "b", "ab", "▁a", "ba", "▁ab", "é"], np.log(np.array([0.2, 0.2, 0.1, 0.1, 0.1, 0.1, 0.1, 0.1])))


def paths(word, pieces):
    """Every segmentation of a word, as lists of piece numbers."""
    known = {t: k for k, t in enumerate(pieces.texts)}

    def rest(s):
        if not s:
            yield []
            return
        for n in range(1, len(s) + 1):
            if s[:n] in known:
                yield from ([known[s[:n]], *more] for more in rest(s[n:]))
        if s[0] not in known:
            yield from ([*(int(pieces.bytes_at[b]) for b in s[0].encode()), *more] for more in rest(s[1:]))

    return list(rest("▁" + word))


def test_forward_sums_all_segmentations(monkeypatch):
    found = ["a", "ab", "abab", "bab", "é", "aßb", "漢", "▁a", "aaaaabbbab", "\U0001f600ab"]
    weight = SMALL.prior
    counts = np.arange(1, len(found) + 1)
    want, expected = [], np.zeros(len(weight))
    for w, c in zip(found, counts, strict=True):
        probs = [math.exp(sum(weight[k] for k in p)) for p in paths(w, SMALL)]
        want.append(math.log(sum(probs)))
        for p, x in zip(paths(w, SMALL), probs, strict=True):
            for k in p:
                expected[k] += c * x / sum(probs)
    for size in (1 << 19, 12):
        monkeypatch.setattr(lattice, "LATTICE", size)
        total, seen = lattice.Lattices(SMALL).forward([w.encode() for w in found], weight, counts)
        assert np.allclose(total, want) and np.allclose(seen, expected)


def brute_scores(docs, pieces, rounds):
    """(n_tokens, n_known, N, base, score) of each document, by enumerating segmentations."""
    count = collections.Counter(t for _, text, trained in docs if trained for t in [*tokens(text), None])
    total, distinct = sum(count.values()), len(count)
    weight, prior = pieces.prior, np.exp(pieces.prior) * len(pieces.prior)
    marginal = lambda w: sum(math.exp(sum(weight[k] for k in p)) for p in paths(w, pieces))
    for _ in range(rounds):
        seen = prior.copy()
        seen[pieces.end] += count[None]
        for w, c in count.items():
            for p in paths(w, pieces) if w is not None else ():
                share = math.exp(sum(weight[k] for k in p)) / marginal(w)
                for k in p:
                    seen[k] += c * share
        weight = np.log(seen / seen.sum())
    out = []
    for d, text, _ in docs:
        own = [*tokens(text), None]
        base = sum(math.log10((count[t] + 0.5) / (total + 0.5 * (distinct + 1))) for t in own)
        full = sum(math.log10(marginal(t)) for t in own[:-1]) + weight[pieces.end] / math.log(10)
        out.append((d, len(own), sum(count[t] > 0 for t in own), total, round(base, 6), round(full, 6)))
    return sorted(out, key=repr)


@pytest.mark.parametrize("bundle", [8 << 20, 400])
def test_scores_equal_brute_force(spark, monkeypatch, bundle):
    monkeypatch.setattr(lattice, "BUNDLE", bundle)
    rng = random.Random(4)
    docs = [(i % 20, " ".join("".join(rng.choice("abAé") for _ in range(rng.randrange(1, 6))) for _ in range(rng.randrange(0, 15))), i % 5 != 1) for i in range(40)]
    docs += [(None, "ab ab", True), (50, None, True), (51, "", None), (52, "  \n\t ", False), (53, "ab " * 5000, True), (54, "new ßß ab a", False)]
    df = spark.createDataFrame([(*d, "p", 1.5) for d in docs], "doc_id long, text string, t boolean, part string, score double").repartition(3)
    for rounds in (0, 2):
        got = [tuple(r[:4]) + (round(r[4], 6), round(r[5], 6)) for r in lattice.score(df, F.col("t"), SMALL, rounds=rounds).collect()]
        assert sorted(got, key=repr) == brute_scores(docs, SMALL, rounds)
    assert lattice.score(df.limit(0), F.col("t"), SMALL).count() == 0
    untaught = lattice.score(df, F.lit(None).cast("boolean"), SMALL).collect()
    assert {(r["n_known"], r["train_tokens"]) for r in untaught} == {(0, 0)} and len(untaught) == len(docs)


def test_a_long_word_needs_no_recursion():
    word = b"ab" * 4000
    total, _ = lattice.Lattices(SMALL).forward([word, b"a"], SMALL.prior)
    assert np.isfinite(total).all() and total[0] < total[1]


def test_probabilities_of_short_strings_sum_below_one():
    words = ["".join(w) for n in range(1, 6) for w in itertools.product("abé", repeat=n)]
    total, _ = lattice.Lattices(SMALL).forward([w.encode() for w in words], SMALL.prior)
    assert 0.01 < np.exp(total).sum() < 1


def test_lattice_query(spark):
    docs = [(r["doc_id"], r["text"], zlib.crc32(str(r["doc_id"]).encode()) % 5 != 1) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]
    count = collections.Counter(t for _, text, trained in docs if trained for t in [*tokens(text), None])
    total, distinct = sum(count.values()), len(count)
    got = {r["doc_id"]: r for r in queries.op13_lattice(spark, SF).collect()}
    assert len(got) == len(docs)
    for d, text, trained in docs:
        own, r = [*tokens(text), None], got[d]
        base = sum(math.log10((count[t] + 0.5) / (total + 0.5 * (distinct + 1))) for t in own)
        assert (r["held_out"], r["n_tokens"], r["n_known"], r["train_tokens"]) == (not trained, len(own), sum(count[t] > 0 for t in own), total)
        assert r["base_score"] == pytest.approx(base) and r["score"] < 0
