"""Line dedup on odd rows, hot lines and its bitmaps; whole tables are compared with SQL elsewhere."""

import hashlib
from collections import defaultdict

from pyspark.sql import functions as F

from cohortlens.llm import line_dedup

BLANKS = " \t\n\x0b\x0c\r"


def fold(line):
    line = line.strip(BLANKS)
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in line)


def brute_force(rows):
    holders = defaultdict(set)
    for doc, text in rows:
        for line in (text or "").split("\n"):
            if len(fold(line)) >= 20:
                holders[fold(line)].add(doc)
    out = []
    rank = lambda d: (d is not None, d or 0)
    for doc, text in rows:
        lines = (text or "").split("\n")
        often = [len(holders[fold(x)]) >= 3 if fold(x) in holders else False for x in lines]
        kept = [x for x, o in zip(lines, often) if not o or doc == max(holders[fold(x)], key=rank)]
        out.append((doc, len(lines), len(lines) - len(kept), "\n".join(kept)))
    return sorted(out, key=repr)


LONG, OTHER = "This line is long enough to count", "Another line that is long enough"
ROWS = [
    (1, f"{LONG}\nown line\n{OTHER}"),
    (2, f"  {LONG.upper()}\t\n{LONG}\nshort"),
    (3, f"{LONG}\n\n{OTHER}\nlast"),
    (4, None),
    (5, ""),
    (6, f"{OTHER}\r\n{'ü' * 19}\n{'ü' * 20}"),
    (7, f"{'ü' * 20}\n{'Ü' * 20}"),
    (8, "ü" * 20 + "\x0b"),
    (9, "ü" * 20),
    (9, "ü" * 20),
    (None, LONG),
    (10, "\n".join(["word"] * 5000 + [OTHER] * 3)),
]


def run(spark, rows):
    docs = spark.createDataFrame([(d, t, "x", 5) for d, t in rows], "doc_id long, text string, pos string, n_lines int")
    kept = line_dedup.drop_repeated_lines(docs)
    assert kept.columns == ["doc_id", "text", "pos", "n_lines", "n_dropped"]
    return sorted([(r.doc_id, r.n_lines, r.n_dropped, r.text) for r in kept.collect()], key=repr)


def test_odd_rows(spark):
    assert run(spark, ROWS) == brute_force(ROWS)


def test_hot_and_cold_ways_agree(spark, monkeypatch):
    want = brute_force(ROWS)
    monkeypatch.setattr(line_dedup, "_hot_hashes", lambda keys: [])
    assert run(spark, ROWS) == want
    every = [r.h1 for r in line_dedup.line_keys(spark.createDataFrame(ROWS, "doc_id long, text string")).collect()]
    monkeypatch.setattr(line_dedup, "_hot_hashes", lambda keys: sorted(set(every)))
    assert run(spark, ROWS) == want


def test_many_rows_of_one_line(spark):
    rows = [(k, f"{LONG}\nline number {k} is its own") for k in range(3000)]
    got = run(spark, rows)
    assert got == brute_force(rows)
    assert sum(r[2] for r in got) == 2999


def test_bitmaps_are_runs(spark):
    docs = spark.createDataFrame([(k, "\n".join([LONG, "a", "b", OTHER, LONG, "c"])) for k in range(3)], "doc_id long, text string")
    maps = {r.doc_id: r for r in line_dedup.keep_bitmaps(docs).collect()}
    assert set(maps) == {0, 1}
    assert [(r.start, r.length) for r in maps[0].keep] == [(1, 2), (5, 1)]
    assert (maps[0].n_lines, maps[0].n_dropped) == (6, 3)


def test_empty_table(spark):
    assert run(spark, []) == []


def test_no_python_in_the_plan(spark):
    docs = spark.createDataFrame(ROWS, "doc_id long, text string")
    kept = line_dedup.drop_repeated_lines(docs).select(F.sha2("text", 256))
    plan = kept._jdf.queryExecution().executedPlan().toString()
    assert not any(word in plan for word in ("Python", "Pandas", "Arrow"))
    texts = {r[0] for r in kept.collect()}
    assert hashlib.sha256(b"").hexdigest() in texts
