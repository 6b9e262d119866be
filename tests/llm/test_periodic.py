"""Periodic runs against a search for every period at every place."""

import hashlib
import random
import zlib

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from cohortlens.llm import periodic
from cohortlens.llm.queries import QUERIES


def plain_runs(words):
    """Every maximal stretch of every period that is not one of a smaller period too."""
    size, found = len(words), []
    for period in range(1, size // 4 + 1):
        at = 0
        while at < size - period:
            stop = at
            while stop < size - period and words[stop] == words[stop + period]:
                stop += 1
            length = stop + period - at
            if stop > at and length >= max(6, 4 * period):
                part = words[at : at + length]
                if all(any(part[k] != part[k + q] for k in range(length - q)) for q in range(1, period)):
                    found.append((at, length, period))
            at = stop + 1
    return sorted(found, key=lambda run: (run[0], run[2]))


def made(rng):
    kinds, words = rng.choice([1, 2, 2, 3, 4, 8, 20]), []
    for _ in range(rng.randint(0, 6)):
        if rng.random() < 0.6:
            unit = [rng.randrange(kinds) for _ in range(rng.randint(1, 7))]
            size = rng.randint(1, 40)
            words += (unit * size)[:size]
        else:
            words += [rng.randrange(kinds) for _ in range(rng.randint(0, 12))]
    words = words * rng.choice([1, 1, 1, 2, 3, 5])
    if words and rng.random() < 0.3:
        words[rng.randrange(len(words))] = rng.randrange(kinds)
    return words


def test_runs_of_made_sequences():
    rng, seen = random.Random(4), 0
    for _ in range(1500):
        words = made(rng)
        want = plain_runs(words)
        assert periodic.find_runs(words) == want, words
        seen += len(want)
    assert seen > 1000


def test_grammar_gives_the_text_back():
    """Every rule stands for the same words at all its places, and no pair of symbols is left twice."""
    rng = random.Random(8)
    for _ in range(300):
        words = made(rng)
        starts, rules = periodic.re_pair(words)
        for wide, reach, places in rules:
            assert len(places) >= 2 and 0 < wide < reach
            assert len({tuple(words[p : p + reach]) for p in places}) == 1
        symbols = [tuple(words[a:b]) for a, b in zip(starts, [*starts[1:], len(words)])]
        pairs = list(zip(symbols, symbols[1:]))
        for pair in set(pairs):
            at = [k for k, p in enumerate(pairs) if p == pair]
            assert at[-1] - at[0] < 2


@pytest.mark.parametrize("words", [[0] * 50_000, [1] + [0] * 50_000, [0, 1] * 25_000, list(range(20_000)) * 2])
def test_long_sequences(words):
    runs = periodic.find_runs(words)
    want = {1: [(0, 50_000, 1)], 2: [(0, 50_000, 2)]}
    if words[:2] == [1, 0]:
        assert runs == [(1, 50_000, 1)]
    else:
        assert runs == want.get(len(set(words)), [])


def edited(doc, text):
    words = text.encode().split() if text else []
    mark = zlib.crc32(str(doc).encode())
    if mark % 10 or not words:
        return words
    g, n = mark // 10, len(words)
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    return [words[i] if i < a else words[a + (i - a) % p] for i in range(n)]


def test_query_is_brute_force(spark, sf_dir):
    texts = dict(duckdb.sql(f"select doc_id, text from '{sf_dir}/documents.parquet'").fetchall())
    got = {r.doc_id: r for r in QUERIES["op13_periodic"](spark, sf_dir).collect()}
    assert set(got) == set(texts)
    some = 0
    for doc, text in texts.items():
        words = edited(doc, text)
        runs = plain_runs(words)
        row = got[doc]
        gone = {k for s, length, q in runs for k in range(s + q, s + length)}
        shown = "".join(f"{s},{length},{q}\n" for s, length, q in runs)
        kept = b" ".join(w for k, w in enumerate(words) if k not in gone)
        assert row.n_runs == len(runs) and row.n_words == len(words)
        assert row.runs_sha256 == hashlib.sha256(shown.encode()).hexdigest()
        assert row.collapsed_sha256 == hashlib.sha256(kept).hexdigest()
        best = min(runs, key=lambda r: (-r[1], r[0], r[2]), default=None)
        wanted = (*best, best[1] * 1000 // best[2]) if best else (None,) * 4
        assert (row.start, row.length, row.period, row.exponent_milli) == wanted
        some += bool(runs)
    assert some >= 10


def test_odd_rows(spark):
    rows = [(1, None), (2, ""), (3, " \t\n\x0b\x0c\r"), (4, "a " * 9), (4, "a " * 9), (None, "x y " * 5), (7, "é é " * 8), (8, "w v " * 40_000)]
    docs = spark.createDataFrame([(*r, "old", "z") for r in rows], "doc_id long, text string, runs string, start string")
    got = periodic.periodic_runs(docs).collect()
    assert got[0].__fields__ == ["doc_id", "text", "start", "n_words", "runs", "collapsed"] and len(got) == len(rows)
    by_id = {r.doc_id: r for r in got}
    assert all(by_id[k].n_words == 0 and by_id[k].runs == [] and by_id[k].collapsed == "" for k in (1, 2, 3))
    assert [tuple(r) for r in by_id[4].runs] == [(0, 9, 1)] and by_id[4].collapsed == "a"
    assert [tuple(r) for r in by_id[None].runs] == [(0, 10, 2)] and by_id[None].collapsed == "x y"
    assert by_id[7].n_words == 8 and by_id[7].collapsed == "é é"
    assert [tuple(r) for r in by_id[8].runs] == [(0, 80_000, 2)]
    assert periodic.periodic_runs(docs.limit(0)).collect() == []


def test_regions_hold_every_run():
    rng = random.Random(15)
    for _ in range(400):
        words = made(rng)
        spots = periodic.regions(np.array(words, np.int64))
        assert spots == sorted(spots) and all(a[1] < b[0] for a, b in zip(spots, spots[1:]))
        for start, length, _ in plain_runs(words):
            assert any(low <= start and start + length <= high for low, high in spots)


def test_best_run_takes_the_earliest_of_equals(spark):
    docs = spark.createDataFrame([(1, "a a a a a a b c c c c c c")], "doc_id long, text string")
    row = periodic.periodic_runs(docs).select(F.size("runs").alias("n")).first()
    assert row.n == 2
