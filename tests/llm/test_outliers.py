"""Base figures against regular expressions, the estimates against a plain version."""

import math
import random
import re
from collections import Counter, defaultdict

import duckdb
import numpy as np
import pytest

from cohortlens.llm import outliers
from cohortlens.llm.queries import QUERIES

DOC = "doc_id long, text string, lang string, source string"


def base_by_hand(text):
    text = text or ""
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    runs = [tuple(words[k : k + 5]) for k in range(len(words) - 4)]
    count = Counter(runs)
    covered = {k + j for k, run in enumerate(runs) if count[run] > 1 for j in range(5)}
    lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines)), len(covered)


def vector_by_hand(text):
    words, chars, symbols, dup, repeats = base_by_hand(text)
    text = text or ""
    n_lines = len([x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)])
    upper = len(re.findall("[A-Z]", text))
    more, all_chars = words + outliers.USUAL_WORDS, chars + outliers.USUAL_LENGTH * outliers.USUAL_WORDS
    values = [
        math.log(all_chars / more), math.log(1 + symbols / more), math.sqrt(dup / (n_lines + outliers.USUAL_LINES)),
        math.sqrt(repeats / more), math.sqrt(upper / all_chars),
    ]
    return [math.floor(outliers.UNIT * v + 0.5) for v in values]


def estimate_by_hand(x):
    floors = np.array(list(outliers.FLOORS.values()), float)

    def nearest(d2):
        grade = np.floor(256 * np.log2(1 + d2))
        return grade <= np.percentile(grade, 100 * outliers.SUBSET)

    def moments(rows):
        return rows.mean(axis=0), np.cov(rows.T, bias=True) + np.diag(floors**2)

    low, median, high = np.percentile(x, [25, 50, 75], axis=0)
    z = ((x - median) / np.maximum((high - low) / 1.349, floors)) ** 2
    best = None
    for d2 in (z.sum(axis=1), z.max(axis=1)):
        for _ in range(outliers.STEPS):
            mean, cov = moments(x[nearest(d2)])
            d2 = np.einsum("ij,jk,ik->i", x - mean, np.linalg.inv(cov), x - mean)
        found = np.linalg.slogdet(cov)[1], d2
        best = found if best is None or found[0] < best[0] - 1e-9 else best
    dims = x.shape[1]
    scale = outliers.SUBSET / outliers.chi_square_share(outliers.chi_square_cut(outliers.SUBSET, dims), dims + 2)
    return np.sqrt(best[1] / scale)


def judged_by_hand(rows):
    """rows: (id, text, lang, source); distance of each that has an estimate."""
    good, counts = {}, Counter()
    for doc, text, lang, source in rows:
        n, _, _, _, repeats = base_by_hand(text)
        if not (n < 10 or 100 * repeats > 20 * n):
            good[doc] = (lang, source)
            counts[lang, source] += 1
    groups, where = defaultdict(list), {}
    for doc, text, lang, source in rows:
        group = (lang, source) if counts[lang, source] >= outliers.MIN_GROUP else (lang, "few", "few")
        where[doc] = group
        if doc in good:
            groups[group].append((doc, vector_by_hand(text)))
    out = {}
    for members in groups.values():
        if len(members) >= outliers.MIN_GROUP:
            found = estimate_by_hand(np.array([v for _, v in members], float))
            out |= dict(zip([d for d, _ in members], found))
    return good, out


def test_chi_square():
    assert outliers.chi_square_share(1.0, 2) == pytest.approx(1 - math.exp(-0.5))
    assert outliers.chi_square_cut(0.95, 1) == pytest.approx(3.841459, rel=1e-6)
    assert outliers.chi_square_cut(0.999, 5) == pytest.approx(20.515, rel=1e-4)


@pytest.fixture(scope="module")
def whole(spark):
    folder = "/root/testdata/sf0.01"
    rows = duckdb.sql(f"select doc_id, text, lang, source from '{folder}/documents.parquet'").fetchall()
    labels = dict(duckdb.sql(f"select doc_id, quality from '{folder}/labels.parquet'").fetchall())
    return rows, labels, {r.doc_id: r for r in QUERIES["op7_outliers"](spark, folder).collect()}


def test_base_is_brute_force(whole):
    rows, _, got = whole
    assert len(got) == len(rows)
    for doc, text, _, _ in rows:
        assert tuple(got[doc][c] for c in outliers.BASE) == base_by_hand(text)
        n, repeats = got[doc].n_words, got[doc].n_repeat_words
        assert got[doc].base_failed == (n < 10 or 100 * repeats > 20 * n)


def test_distances_are_brute_force(whole):
    rows, _, got = whole
    good, distances = judged_by_hand(rows)
    cut = math.sqrt(outliers.chi_square_cut(1 - outliers.TAIL, len(outliers.DIMS)))
    for doc, row in got.items():
        if doc in distances:
            assert row.distance == pytest.approx(distances[doc], rel=1e-6, abs=1e-6)
        assert row.kept == (doc in good and distances.get(doc, 0.0) <= cut) or doc not in good


def test_clean_documents_stay(whole):
    _, labels, got = whole
    clean = [got[d] for d, q in labels.items() if q == 1 and not got[d].base_failed]
    poor = [got[d] for d, q in labels.items() if q == 0]
    assert all(r.kept for r in clean)
    assert sum(not r.kept for r in poor) >= 0.7 * len(poor)


def test_outlier_of_its_group(spark):
    rng = random.Random(3)
    words = lambda n, size: " ".join("".join(rng.choices("abcdefg", k=size)) for _ in range(n))
    rows = [(k, words(200, 5), "en", "a" if k < 80 else None) for k in range(160)]
    rows += [(200, words(200, 30), "en", "a"), (201, words(200, 5) + " ###$$$ " * 100, "en", None), (202, words(200, 30), "xx", "a")]
    rows += [(300, None, "en", "a"), (301, "", None, None), (302, words(60_000, 5), "en", "a"), (0, rows[0][1], "en", "a")]
    docs = spark.createDataFrame([(*r, 1, 2.0, 3) for r in rows], DOC + ", kept int, n_lines double, own int")
    judged = outliers.judged(docs)
    assert judged.columns[:6] == ["doc_id", "text", "lang", "source", "n_lines", "own"]
    assert len(judged.columns) == len(set(judged.columns)) == 14
    assert {(r.n_lines, r.own) for r in judged.select("n_lines", "own").collect()} == {(2.0, 3)}
    got = judged.collect()
    assert len(got) == len(rows)
    kept = {r.doc_id: r.kept for r in got}
    assert all(kept[k] for k in range(160)) and kept[202] and kept[302]
    assert not any(kept[k] for k in (200, 201, 300, 301))


def test_empty_table(spark):
    assert outliers.judged(spark.createDataFrame([], DOC)).collect() == []
