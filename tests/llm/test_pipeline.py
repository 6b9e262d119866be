"""Every stage of the pipeline against a plain version of it, on what the stage before kept."""

import hashlib
import math
from collections import Counter

import pytest
import sentencepiece

import corpus_pipeline
from cohortlens.llm import mixing, outliers
from cohortlens.llm.queries import MIX_WEIGHTS, PIECES_MODEL
from cohortlens.sources.tables import write_once
from test_line_dedup import brute_force
from test_outliers import judged_by_hand
from test_simhash import plain_classes, plain_fingerprint


@pytest.fixture(scope="module")
def kept(spark, sf_dir):
    """Rows of ``documents`` and of every stage."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    out = [docs.collect()]
    for name, stage in corpus_pipeline.STAGES:
        docs = write_once(stage(spark, docs, sf_dir), "stage")
        if name != "sentencepiece":
            assert docs.columns == corpus_pipeline.COLUMNS
        out.append(docs.collect())
    return out


def test_quality_rules(kept):
    rows = [(r.doc_id, r.text, r.lang, r.source) for r in kept[0]]
    good, distances = judged_by_hand(rows)
    cut = math.sqrt(outliers.chi_square_cut(1 - outliers.TAIL, len(outliers.DIMS)))
    assert {r.doc_id for r in kept[1]} == {d for d in good if distances.get(d, 0.0) <= cut}
    assert 0 < len(kept[1]) < len(kept[0])


def test_line_dedup(kept):
    want = brute_force([(r.doc_id, r.text) for r in kept[1]])
    assert sorted((r.doc_id, r.text) for r in kept[2]) == sorted((d, t) for d, _, _, t in want)
    assert all(r.n_chars == len(r.text) for r in kept[2])


def test_near_copies_broadcast_no_keys(spark, sf_dir, monkeypatch):
    """Keys outnumber the rows that Spark sizes them by, whatever the size of the files."""
    plans = []

    def seen(frame, name):
        plans.append(frame._jdf.queryExecution().executedPlan().toString())
        return write_once(frame, name)

    monkeypatch.setattr("cohortlens.llm.simhash.write_once", seen)
    monkeypatch.setattr("cohortlens.llm.components.write_once", seen)
    corpus_pipeline.drop_near_copies(spark, spark.read.parquet(f"{sf_dir}/documents.parquet"), sf_dir)
    listed = [p for p in plans if "Generate" in p]
    assert len(listed) == 2 and not [p for p in listed if "BroadcastExchange" in p]


def test_near_copies(kept):
    roots = plain_classes({r.doc_id: plain_fingerprint(r.text) for r in kept[2]})
    assert {r.doc_id for r in kept[3]} == {d for d, root in roots.items() if d == root}
    assert 0 < len(kept[3]) < len(kept[2])


def test_mixing(kept):
    counts = Counter(r.source for r in kept[3])
    total = sum(counts[s] for s in MIX_WEIGHTS)
    want = Counter()
    for r in kept[3]:
        rate = total / len(MIX_WEIGHTS) / counts[r.source] if r.source in MIX_WEIGHTS else 1.0
        u = int(hashlib.md5(f"{mixing.SEED}:{r.doc_id}".encode()).hexdigest()[:13], 16) / 2**52
        count, below = 0, math.exp(-rate)
        while below <= u:
            count += 1
            below += math.exp(count * math.log(rate) - rate - math.lgamma(count + 1))
        want[r.doc_id] = count
    assert Counter(r.doc_id for r in kept[4]) == +want


def test_pieces(kept):
    reference = sentencepiece.SentencePieceProcessor(model_file=PIECES_MODEL)
    texts = {r.doc_id: r.text for r in kept[4]}
    assert len(kept[5]) == len(kept[4])
    assert all(r.ids == reference.encode(texts[r.doc_id]) and r.parity and r.restored for r in kept[5])


def test_odd_documents(spark, sf_dir):
    rows = [(1, None, None, None, None, "x"), (2, "", "en", "src1", 0, "x"), (2, "", "en", "src1", 0, "x")]
    rows += [(None, "some words that are many enough to pass the first rule of all", "en", None, 5, "x")]
    rows += [(4, "long text " + " ".join(f"w{k}" for k in range(40_000)), "en", "src1", 1, "x")]
    schema = "doc_id long, text string, lang string, source string, n_chars long, component_id string"
    for given in (rows, []):
        docs = spark.createDataFrame(given, schema)
        for _, stage in corpus_pipeline.STAGES:
            docs = write_once(stage(spark, docs, sf_dir), "stage")
        left = {r.doc_id for r in docs.collect()}
        assert left <= {None, 4}
