"""Threshold sketches and repeated sentence spans, against brute force."""

import hashlib
import random

import duckdb
import pytest

from cohortlens.llm import sketch, spans
from cohortlens.llm.queries import QUERIES

DOC = "doc_id long, text string"


def followed_by_hand(rows):
    """rows: (id, text) in order; (n_chars, edited digest, sketches, likenesses) of each."""
    out = {}
    for k, (doc, text) in enumerate(rows):
        after = rows[(k + 1) % len(rows)][1]
        half = len(text) // 2
        changed = text[: len(text) - half] + after[:half]
        own, new, next_one = (set(sketch.sketch(t).tolist()) for t in (text, changed, after))
        near = [len(own & x) / len(own | x) if own | x else 1.0 for x in (new, next_one)]
        out[doc] = (len(text), hashlib.sha256(changed.encode()).hexdigest(), own, new, *near)
    return out


def as_told(row):
    own, new = (set(sketch.from_text(x).tolist()) for x in (row.fingerprint, row.edited_fingerprint))
    return row.n_chars, row.edited_sha256, own, new, row.near_edited, row.near_next


def test_query_is_brute_force(spark, sf_dir):
    rows = duckdb.sql(f"select doc_id, coalesce(text, '') from '{sf_dir}/documents.parquet' order by doc_id").fetchall()
    got = {r.doc_id: as_told(r) for r in QUERIES["op4_sketch"](spark, sf_dir).collect()}
    assert got == followed_by_hand(rows)


def test_odd_rows(spark):
    rows = [(5, None), (9, "one two three four five six"), (2, "ä" * 7), (7, ""), (12, "w " * 40_000)]
    docs = spark.createDataFrame([(*r, "x") for r in rows + [(None, "lost words")]], DOC + ", part string")
    got = {r.doc_id: r for r in sketch.with_following(docs).collect()}
    lost = got.pop(None)
    assert lost.near_next is None and lost.n_chars == 10 and lost.fingerprint
    assert {k: as_told(r) for k, r in got.items()} == followed_by_hand(sorted((d, t or "") for d, t in rows))
    assert got[5].fingerprint == got[7].fingerprint == ""
    alone = sketch.with_following(spark.createDataFrame([(1, "a b c d e f g h")], DOC)).first()
    assert alone.near_next == 1.0
    twice = sketch.with_following(spark.createDataFrame([(1, "a b"), (1, "a b"), (2, "c")], DOC)).collect()
    assert len(twice) == 3
    assert sketch.with_following(spark.createDataFrame([], DOC)).collect() == []


def test_merging_and_containment():
    rng = random.Random(4)
    words = [f"w{rng.randrange(10**9)}" for _ in range(8000)]
    whole, part = " ".join(words), " ".join(words[2000:3000])
    other = " ".join(f"v{k}" for k in range(1000))
    a, b, c = (sketch.sketch(t) for t in (whole, part, other))
    assert sketch.containment(b, a) == 1.0
    assert sketch.containment(a, b) == pytest.approx(1 / 8, abs=0.03)
    assert sketch.likeness(a, c) == 0.0
    both = sketch.merged(b, c)
    assert set(both.tolist()) == set(b.tolist()) | set(c.tolist())
    assert len(a) == pytest.approx(8000 * sketch.FRACTION, rel=0.1)
    assert sketch.as_text(sketch.from_text(sketch.as_text(a))) == sketch.as_text(a)


def removed_by_hand(rows):
    first = {}
    for doc, text in sorted(rows):
        for digest, starts in spans.span_hashes(text).items():
            first.setdefault(digest, (doc, starts[0]))
    out = {}
    for doc, text in rows:
        gone = set()
        for digest, starts in spans.span_hashes(text).items():
            for start in starts:
                if first[digest] != (doc, start):
                    gone.update(range(start, start + spans.RUN))
        parts = spans.units(text)
        out[doc] = ("".join(p for k, p in enumerate(parts) if k not in gone), len(parts), len(gone))
    return out


def test_spans_query_is_brute_force(spark, sf_dir):
    rows = duckdb.sql(f"select doc_id, text from '{sf_dir}/documents.parquet'").fetchall()
    got = {r.doc_id: (r.text, r.n_units, r.n_removed) for r in QUERIES["op5_spans"](spark, sf_dir).collect()}
    assert got == removed_by_hand(rows)


def test_planted_passages_go(spark):
    rng = random.Random(8)

    def sentences(count):
        return " ".join(" ".join(f"x{rng.randrange(10**7)}" for _ in range(rng.randint(5, 16))).capitalize() + "." for _ in range(count))

    passage, flat = sentences(6), " ".join(f"y{k}" for k in range(80)) + "."
    rows = [(k, f"{sentences(5)}\n{passage} {sentences(4)}") for k in range(1, 6)] + [(9, sentences(20))]
    rows += [(k, f"{sentences(3)} {flat} {sentences(3)}") for k in range(20, 23)]
    got = {r.doc_id: r for r in spans.remove_repeats(spark.createDataFrame(rows, DOC)).collect()}
    assert passage in got[1].text and flat in got[20].text
    assert all(passage[:60] not in got[k].text for k in range(2, 6))
    assert all("y40" not in got[k].text for k in (21, 22))
    assert got[9].n_removed == 0 and got[9].text == rows[5][1]
    assert all(got[k].text.startswith(dict(rows)[k].split("\n")[0]) for k in range(1, 6))


def test_spans_of_odd_rows(spark):
    said = "One two three four. Five six seven eight. Nine ten eleven twelve."
    rows = [(1, said), (2, said.upper()), (3, None), (4, ""), (5, "..."), (6, f"{said} {said}"), (7, "word " * 30_000), (None, said)]
    docs = spark.createDataFrame([(*r, 1) for r in rows], DOC + ", n_units int")
    cut = spans.remove_repeats(docs)
    assert cut.columns == ["doc_id", "text", "n_units", "n_removed"]
    got = {r.doc_id: r for r in cut.collect()}
    assert got[None].text == said and got[1].text == "" and got[2].text == "" and got[6].text == ""
    assert got[3].text == got[4].text == "" and got[5].text == "..."
    same = spans.remove_repeats(spark.createDataFrame([(1, said), (1, said)], DOC)).collect()
    assert [r.text for r in same] == [said, said]
    assert spans.remove_repeats(spark.createDataFrame([], DOC)).collect() == []


def test_units_join_to_the_text(sf_dir):
    for (text,) in duckdb.sql(f"select text from '{sf_dir}/documents.parquet'").fetchall():
        assert "".join(spans.units(text)) == text
        assert all(len(u.split()) <= spans.MOST_WORDS for u in spans.units(text))


def test_cuts_do_not_depend_on_what_stands_before():
    words = [f"w{k}" for k in range(400)]
    one, two = (spans.units(" ".join(["x"] * lead + words)) for lead in (3, 17))
    assert len(set(one) & set(two)) >= 0.8 * len(one)
