"""Language filters: against plain sets of n-grams, and held-out accuracy."""

import random
import zlib
from collections import Counter

import duckdb
import numpy as np
import pytest

from cohortlens.llm import language
from cohortlens.llm.queries import QUERIES

SCHEMA = "doc_id long, text string, lang string"


def plain_ngrams(text):
    words = "".join(c if c.isalpha() else " " for c in text.lower()).split()
    return Counter(f" {w} "[k : k + n] for w in words for n in language.SIZES for k in range(len(w) + 3 - n))


def test_ngrams_are_those_of_the_words():
    rng = random.Random(6)
    texts = ["", " ", "a", "É, è!", "one  two\nTHREE 4 five", "日本語 text", "x" * 500, "İstanbul ß"]
    texts += ["".join(rng.choices("abC é.\n1", k=rng.randint(0, 40))) for _ in range(200)]
    hashes, owners = language.ngrams(texts)
    names = {}
    for k, text in enumerate(texts):
        got, want = Counter(hashes[owners == k].tolist()), plain_ngrams(text)
        assert sorted(got.values()) == sorted(want.values())
        alone = language.ngrams([text])[0]
        assert sorted(alone.tolist()) == sorted(hashes[owners == k].tolist())
    for gram in {g for t in texts for g in plain_ngrams(t)}:
        word = gram.strip() or gram
        found = set(language.ngrams([word])[0].tolist())
        names[gram] = found
    assert len(set(hashes.tolist())) == len({g for t in texts for g in plain_ngrams(t)})


def small_corpus():
    rng = random.Random(3)
    letters = {"aa": "abcde", "bb": "defgh", "cc": "ghijk"}
    rows = []
    for k in range(300):
        lang = rng.choice(["aa", "aa", "bb", "cc"])
        rows.append((k, " ".join("".join(rng.choices(letters[lang], k=rng.randint(1, 7))) for _ in range(20)), lang))
    return rows


def test_filters_and_scores_are_brute_force(spark):
    rows = small_corpus()
    filters = language.train(spark.createDataFrame([*rows, (901, None, "aa"), (902, "text", None)], SCHEMA))
    counts = {}
    for _, text, lang in rows:
        counts.setdefault(lang, Counter()).update(plain_ngrams(text))
    sizes = Counter(lang for *_, lang in rows) + Counter(["aa"] * 0)
    assert filters.languages == sorted(sizes, key=lambda lang: (-sizes[lang], lang))
    rates = {lang: {g: n / sum(c.values()) for g, n in c.items()} for lang, c in counts.items()}
    held = {lang: set() for lang in rates}
    for gram in {g for r in rates.values() for g in r}:
        best = max(r.get(gram, 0.0) for r in rates.values())
        for lang, r in rates.items():
            if r.get(gram, 0.0) >= max(language.MIN_RATE, language.MIN_SHARE * best):
                held[lang].add(gram)
    chance = filters.by_chance()
    assert (chance < 0.1).all()
    texts = [t for _, t, _ in rows[:60]] + ["zzz", "a", ""]
    total, hits = filters.counts(texts)
    for k, text in enumerate(texts):
        grams = plain_ngrams(text)
        assert total[k] == sum(grams.values())
        for at, lang in enumerate(filters.languages):
            true = sum(n for g, n in grams.items() if g in held[lang])
            told = hits[k, at] * (1 - chance[at]) + total[k] * chance[at] if hits[k, at] else None
            assert told is None or true <= told + 1e-6 <= true + 0.1 * (total[k] - true) + 3 * total[k] ** 0.5 + 1


def test_held_out_accuracy(spark):
    rows = QUERIES["op11_language"](spark, "/root/testdata/sf0.01").collect()
    truth = duckdb.sql("select doc_id, lang from '/root/testdata/sf0.01/documents.parquet'").fetchall()
    lang = dict(truth)
    assert {r.doc_id for r in rows} == set(lang)
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) and 0 <= r.score <= 1 for r in rows)
    held = [r.lang_pred == lang[r.doc_id] for r in rows if r.held_out and lang[r.doc_id]]
    assert len(held) > 200 and np.mean(held) >= 0.98


def test_held_out_rows_teach_nothing(spark, tmp_path):
    rows = [(k, t, lang if zlib.crc32(str(k).encode()) % 4 != 2 else "zz") for k, t, lang in small_corpus()]
    spark.createDataFrame(rows, SCHEMA).write.parquet(str(tmp_path / "documents.parquet"))
    assert "zz" not in {r.lang_pred for r in QUERIES["op11_language"](spark, str(tmp_path)).collect()}


def test_odd_rows(spark):
    filters = language.train(spark.createDataFrame(small_corpus(), SCHEMA))
    rows = [(1, None), (2, ""), (3, "123 ... \n"), (4, "abc abc"), (4, "abc abc"), (None, "hij"), (6, "qqq"), (7, "cab " * 300_000)]
    docs = spark.createDataFrame([(*r, "old", "x") for r in rows], "doc_id long, text string, score string, gram string")
    got = language.predict(docs, filters).collect()
    assert got[0].__fields__ == ["doc_id", "text", "gram", "lang_pred", "score"] and len(got) == len(rows)
    by_id = {r.doc_id: (r.lang_pred, r.score) for r in got}
    assert by_id[1] == by_id[2] == by_id[3] == ("und", 0.0)
    assert by_id[4][0] == "aa" and by_id[None][0] == "cc" and by_id[7][0] == "aa" and by_id[7][1] > 0.5
    assert by_id[6][0] in filters.languages
    assert language.predict(docs.limit(0), filters).collect() == []
    nothing = language.train(spark.createDataFrame([(1, "text", None)], SCHEMA))
    assert {r.lang_pred for r in language.predict(docs, nothing).collect()} == {"und"}


@pytest.mark.parametrize("count", [70])
def test_more_languages_than_bits_of_a_word(spark, count):
    alphabet = [chr(0x4E00 + k) for k in range(count)]
    rows = [(k, f"{c}{c}{c}", f"l{k:02d}") for k, c in enumerate(alphabet)]
    filters = language.train(spark.createDataFrame(rows, SCHEMA))
    assert filters.slots.shape[1] == 2
    told = language.predict(spark.createDataFrame(rows, SCHEMA), filters).collect()
    assert all(r.lang_pred == r.lang for r in told)
