"""SimHash, its fuzzy keys, the linking and the components, against brute force."""

import random
from itertools import combinations

import duckdb
import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from cohortlens.llm import golay, simhash
from cohortlens.llm.components import components
from cohortlens.llm.queries import QUERIES
from cohortlens.sources.tables import write_once

SCHEMA = "doc_id long, text string"


def plain_fingerprint(text, size=4):
    words = (text or "").encode().lower().split()
    shingles = [b" ".join(words[k : k + size]) for k in range(max(1, len(words) - size + 1))] if words else []
    hashes = [xxhash.xxh64_intdigest(s, 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def plain_components(nodes, links):
    parent = {n: n for n in nodes}

    def find(n):
        while parent[n] != n:
            n = parent[n]
        return n

    for a, b in links:
        a, b = find(a), find(b)
        parent[max(a, b)] = min(a, b)
    return {n: find(n) for n in nodes}


def plain_classes(marks, bits=4):
    close = [(a, b) for a, b in combinations(marks, 2) if bin(marks[a] ^ marks[b]).count("1") <= bits]
    return plain_components(marks, close)


def test_code_is_perfect():
    rng = np.random.default_rng(3)
    data = rng.integers(0, 1 << 12, 500).astype(np.uint32)
    words = np.array([(int(d) << 11) ^ golay._remainder(int(d) << 11) for d in data], np.uint32)
    for weight in range(4):
        flips = [sum(1 << int(b) for b in rng.choice(23, weight, replace=False)) for _ in words]
        assert (golay.nearest(words ^ np.array(flips, np.uint32)) == data).all()


def test_keys_meet_up_to_four_bits():
    rng = random.Random(5)
    for _ in range(300):
        mark = rng.getrandbits(64)
        flipped = mark
        for bit in rng.sample(range(64), rng.randint(0, 4)):
            flipped ^= 1 << bit
        keys = golay.fuzzy_keys(np.array([mark, flipped], np.uint64).view(np.int64))
        assert set(keys[0]) & set(keys[1])
        assert len(keys[0]) <= 15 + 3 * 12


def test_components(spark):
    rng = random.Random(1)
    links = [(rng.randrange(400), rng.randrange(400)) for _ in range(250)]
    links += [(k, k + 1) for k in range(1000, 1040)] + [(2000, k) for k in range(2001, 2060)] + [(7, 7)]
    found = components(spark.createDataFrame(links + [(None, 3)], "a long, b long")).collect()
    nodes = {n for link in links for n in link}
    want = {n: r for n, r in plain_components(nodes, links).items() if n != r}
    assert {(r.node, r.root) for r in found} == set(want.items())
    assert not components(spark.createDataFrame([], "a long, b long")).collect()


def test_query_is_brute_force(spark, sf_dir):
    texts = dict(duckdb.sql(f"select doc_id, text from '{sf_dir}/documents.parquet'").fetchall())
    marks = {i: plain_fingerprint(t) for i, t in texts.items()}
    roots = plain_classes(marks)
    got = {r.doc_id: (r.fingerprint, r.component_id) for r in QUERIES["op3_simhash"](spark, sf_dir).collect()}
    assert got == {i: (f"{marks[i]:016x}", roots[i]) for i in texts}


def test_links_of_made_fingerprints(spark):
    """Chains, a dense group, copies and strangers; every link counts, none is made up."""
    rng = random.Random(11)
    marks = {}
    center = rng.getrandbits(64)
    for k in range(120):
        value = center
        for bit in rng.sample(range(64), rng.randint(0, 5)):
            value ^= 1 << bit
        marks[k] = value
    value = rng.getrandbits(64)
    for k in range(200, 230):
        for bit in rng.sample(range(64), 4):
            value ^= 1 << bit
        marks[k] = value
    marks |= {300 + k: rng.getrandbits(64) for k in range(200)} | {600 + k: 0 for k in range(5)}
    signed = [(i, m - (1 << 64) if m >> 63 else m) for i, m in marks.items()]
    frame = spark.createDataFrame(signed, "doc_id long, mark long")
    classed = simhash.classes(frame, 4)
    assert {r.doc_id: r.component_id for r in classed.collect()} == plain_classes(marks)


def test_keys_are_not_broadcast(spark, monkeypatch):
    """Tables far below the broadcast threshold as files may be large once their keys are listed."""
    rng = random.Random(13)
    vertices = spark.createDataFrame([(k, rng.getrandbits(63)) for k in range(300)], "node long, mark long")
    assert int(spark.conf.get("spark.sql.autoBroadcastJoinThreshold").rstrip("b")) > 1 << 20
    monkeypatch.setattr("cohortlens.llm.components.BROADCAST_LINKS", 0, raising=False)
    plans = []

    def seen(frame, name):
        plans.append(frame._jdf.queryExecution().executedPlan().toString())
        return write_once(frame, name)

    monkeypatch.setattr("cohortlens.llm.simhash.write_once", seen)
    monkeypatch.setattr("cohortlens.llm.components.write_once", seen)
    classed = simhash.classes(vertices.withColumnRenamed("node", "doc_id"), 4)
    plans.append(classed._jdf.queryExecution().executedPlan().toString())
    assert classed.count() == 300 and any("SortMergeJoin" in p for p in plans)
    assert not [p for p in plans if "BroadcastExchange" in p]


def test_odd_rows(spark):
    rows = [(1, None), (2, ""), (3, " \t\n"), (4, "one two"), (4, "one two"), (5, "One TWO"), (None, "one two"), (6, "x " * 50_000)]
    docs = spark.createDataFrame([(*r, "z", "m") for r in rows], "doc_id long, text string, node string, mark string")
    got = simhash.near_groups(docs).collect()
    assert len(got) == len(rows)
    by_id = {r.doc_id: r.component_id for r in got}
    assert by_id[None] is None and by_id[1] == by_id[2] == by_id[3] == 1 and by_id[5] == 4
    assert all(r.mark == 0 for r in got if r.doc_id in (1, 2, 3))
    empty = simhash.near_groups(spark.createDataFrame([], SCHEMA))
    assert empty.columns == ["doc_id", "mark", "component_id"] and not empty.collect()
    with pytest.raises(ValueError):
        simhash.near_groups(docs, bits=5)


@pytest.mark.parametrize("size", [1, 4])
def test_fingerprint_counts_repeats(spark, size):
    text = "a b c d " * 3 + "e f"
    got = spark.createDataFrame([(1, text)], SCHEMA).select(simhash.fingerprint(F.col("text"), size)).first()[0]
    assert got & (1 << 64) - 1 == plain_fingerprint(text, size)
