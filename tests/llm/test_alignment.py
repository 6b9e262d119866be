"""Aligned tokenizers against whole texts encoded by the libraries and pairs counted in a dictionary."""

import hashlib
import random
from collections import Counter, defaultdict

import duckdb
import pytest
import sentencepiece
from tokenizers import Tokenizer

from cohortlens.llm import alignment
from cohortlens.llm.queries import BYTES_MODEL, PIECES_MODEL, QUERIES

SIDES = alignment.Sides(BYTES_MODEL, PIECES_MODEL)
SCHEMA = "doc_id long, text string"
ODD = [
    "", " ", "  a  b ", "\n\n\t x", "a \n b\n  c\t d", "emoji 😀😀 and é", "<|endoftext|> </s> <s> <unk> <0x0A>", "日本語 テスト　x y",
    "x" * 3000, "a▁b", "it's  I'll 3.14 'tis", "tail  ", "\x1c \x85   b", "nul \u0000 here", "word " * 300, "é ​ z",
]


def byte_table():
    """The signs of byte-level vocabularies, written out from their definition."""
    own = list(range(ord("!"), ord("~") + 1)) + list(range(ord("¡"), ord("¬") + 1)) + list(range(ord("®"), ord("ÿ") + 1))
    return {chr(b): b for b in own} | {chr(256 + k): b for k, b in enumerate(b for b in range(256) if b not in own)}


def plain(texts):
    """(tokens, tokens, groups, links, digest) and the links of every text, all from whole texts."""
    a_side = Tokenizer.from_file(BYTES_MODEL)
    a_side.encode_special_tokens = True
    b_side = sentencepiece.SentencePieceProcessor(model_file=PIECES_MODEL)
    table = byte_table()
    out = []
    for text in texts:
        text = text or ""
        a = a_side.encode(" " + text, add_special_tokens=False).ids
        b = b_side.encode(text)
        a_told = [bytes(table[c] for c in a_side.id_to_token(k)) for k in a]
        b_told = [
            bytes([int(p[3:5], 16)]) if b_side.is_byte(k) else p.replace("▁", " ").encode()
            for k, p in ((k, b_side.id_to_piece(k)) for k in b)
        ]
        if not text or not b"".join(a_told) == (" " + text).encode() == b"".join(b_told):
            out.append(((0, 0, 0, 0, ""), []))
            continue
        spans = []
        for told in (a_told, b_told):
            at, own = 0, []
            for piece in told:
                own.append((at, at + len(piece)))
                at += len(piece)
            spans.append(own)
        links = []
        first = 0
        for i, (low, high) in enumerate(spans[0]):
            while spans[1][first][1] <= low:
                first += 1
            j = first
            while j < len(b) and spans[1][j][0] < high:
                links.append((a[i], b[j]))
                j += 1
        ends = sorted({e for _, e in spans[0]} & {e for _, e in spans[1]})
        groups, low = [], 0
        for end in ends:
            sides = [",".join(str(k) for k, (s, e) in zip(ids, own) if low < e <= end) for ids, own in zip((a, b), spans)]
            groups.append("|".join(sides))
            low = end
        digest = hashlib.sha256(";".join(groups).encode()).hexdigest()
        out.append(((len(a), len(b), len(groups), len(links), digest), links))
    return out


def wanted(texts):
    rows = plain(texts)
    counts = Counter(link for _, links in rows for link in links)
    best = defaultdict(int)
    for (_, b), n in counts.items():
        best[b] = max(best[b], n)
    return [
        (*figures, sum(counts[k] == best[k[1]] for k in links), sum(counts[k] for k in links)) for figures, links in rows
    ]


def shown(row):
    return (row.n_a, row.n_b, row.n_groups, row.n_links, row.groups_sha256, row.n_best, row.count_sum)


def test_query_is_brute_force(spark, sf_dir):
    texts = dict(duckdb.sql(f"select doc_id, text from '{sf_dir}/documents.parquet' order by doc_id").fetchall())
    got = {r.doc_id: shown(r) for r in QUERIES["op12_alignment"](spark, sf_dir).collect()}
    assert got == dict(zip(texts, wanted(texts.values())))
    assert sum(row[3] for row in got.values()) > 10_000


@pytest.mark.parametrize("links, fan", [(1 << 30, 64), (500, 2)])
def test_odd_rows_in_any_number_of_runs(spark, monkeypatch, links, fan):
    """Small runs, merged two at a time over several levels, give the same figures."""
    monkeypatch.setattr(alignment, "RUN_LINKS", links)
    monkeypatch.setattr(alignment, "FAN_IN", fan)
    monkeypatch.setattr(alignment, "_ROWS", 3)
    rng = random.Random(2)
    texts = [None, *ODD, *ODD, *[" ".join(rng.choices(["the", "The", "over", "ünd", "x1", "ab\n"], k=rng.randint(1, 60))) for _ in range(60)]]
    ids = [None if k % 17 == 5 else k // 2 for k in range(len(texts))]
    docs = spark.createDataFrame(list(zip(ids, texts, ["z"] * len(ids))), SCHEMA + ", run string").repartition(3)
    got = alignment.align(docs, SIDES)
    assert got.columns == alignment.COLUMNS
    key = lambda row: (row[0] is None, row[0] or 0, row[1:])
    assert sorted([(r.doc_id, *shown(r)) for r in got.collect()], key=key) == sorted(
        [(i, *w) for i, w in zip(ids, wanted(texts))], key=key
    )


def test_empty_tables(spark):
    assert alignment.align(spark.createDataFrame([], SCHEMA), SIDES).collect() == []
    rows = alignment.align(spark.createDataFrame([(1, None), (2, "")], SCHEMA), SIDES).collect()
    assert sorted((r.doc_id, *shown(r)) for r in rows) == [(k, 0, 0, 0, 0, "", 0, 0) for k in (1, 2)]


def test_units_are_exact_and_bounded(monkeypatch):
    monkeypatch.setattr(alignment, "KNOWN_UNITS", 40)
    aligner = alignment.Aligner(*SIDES.data())
    assert aligner.by_unit
    for text in ODD:
        if text:
            assert " ".join(aligner.units(text)) == text
    whole = alignment.Aligner(*SIDES.data())
    whole.by_unit = False
    for start in range(0, 200, 20):
        texts = [f"word{k} other{k * 7}, <s>\n {k}" for k in range(start, start + 20)]
        assert aligner.align(texts)[1] == whole.align(texts)[1]
        assert len(aligner.known) <= 40 + 100


def test_counts_beyond_floats():
    """Sums of counts above 2^53 are exact."""
    import numpy as np
    import pyarrow as pa

    count = (1 << 58) + 1
    heads = pa.table({"head": [alignment._head(np.array([5]), np.array([count]))]})
    body = alignment._packed(np.array([3]), np.array([2]))
    runs = pa.table({"run": ["0-0"], "head": [alignment._head(np.array([5]), np.array([3]), np.array([1]))], "body": [body]})
    best, total = alignment._unpacked(alignment._give_back(10)(runs, heads)["figures"][0].as_py())
    assert best.tolist() == [0, 0, 0, 3] and total.tolist() == [0, 0, 0, 3 * count]
