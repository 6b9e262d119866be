"""The rebuilt tokenizer against SentencePiece: the public model and hand-made ones."""

import random
import struct

import duckdb
import pytest

from cohortlens.llm import pieces
from cohortlens.llm.queries import PIECES_MODEL, QUERIES

DOC = "doc_id long, text string"
ODD = ["", " ", "  a  b ", "\n\n\t", "emoji 😀 and \u0000 nul", "</s> <s> <unk> <0x0A>", "日本語 テスト", "x" * 3000, "a b", "word " * 5000]


@pytest.fixture(scope="module")
def model():
    return pieces.model_bytes(PIECES_MODEL)


def field(number, kind, payload):
    def varint(value):
        out = b""
        while value > 0x7F:
            out, value = out + bytes([value & 0x7F | 0x80]), value >> 7
        return out + bytes([value])

    key = varint(number << 3 | kind)
    return key + (varint(payload) if kind == 0 else varint(len(payload)) + payload if kind == 2 else payload)


def made_model(kind, byte_fallback):
    """A small model over a few letters, as its file would have it."""
    rows = [("<unk>", 0.0, 2), ("<s>", 0.0, 3), ("</s>", 0.0, 3)]
    if byte_fallback:
        rows += [(f"<0x{b:02X}>", 0.0, 6) for b in range(256)]
    words = ["ab", "abc", "bc", "▁a", "▁ab", "ca", "▁c", "cab", "aa", "▁abc"]
    rows += [(w, -float(k + 1), 1) for k, w in enumerate(words)]
    rows += [(c, -float(20 + k), 1) for k, c in enumerate("▁abc")]
    out = b"".join(
        field(1, 2, field(1, 2, w.encode()) + field(2, 5, struct.pack("<f", s)) + (field(3, 0, t) if t != 1 else b""))
        for w, s, t in rows
    )
    out += field(2, 2, field(3, 0, kind) + field(4, 0, len(rows)) + field(35, 0, int(byte_fallback)))
    return out + field(3, 2, field(1, 2, b"identity") + field(3, 0, 1) + field(4, 0, 0))


def test_parses_the_model(model):
    parsed = pieces.parse_model(model)
    assert len(parsed.pieces) == 32_000 and parsed.kind == pieces.BPE and parsed.byte_fallback
    assert parsed.unknown == 0 and parsed.pieces[3][:1] == ("<0x00>",) and parsed.dummy_prefix and not parsed.single_spaces


def test_parity_and_round_trip(model, sf_dir):
    texts = ODD + [t for (t,) in duckdb.sql(f"select text from '{sf_dir}/documents.parquet'").fetchall()]
    codec = pieces.Codec(model, 1)
    assert codec.by_unit
    wanted = codec.reference.encode(texts)
    coded = list(codec.encode(texts))
    for want, (ids, same, restored) in zip(wanted, coded):
        assert ids.tolist() == want and same and restored
    assert codec.decode([ids for ids, _, _ in coded]) == texts
    assert [restored for _, _, restored in codec.encode(["a\u2581b"])] == [False]
    whole = codec.tokenizer.encode_batch(texts, add_special_tokens=False)
    assert [e.ids for e in whole] == wanted
    assert codec.tokenizer.decode_batch(wanted, skip_special_tokens=False) == texts


@pytest.mark.parametrize("kind", [pieces.UNIGRAM, pieces.BPE])
@pytest.mark.parametrize("byte_fallback", [False, True])
def test_hand_made_models(kind, byte_fallback):
    rng = random.Random(kind)
    texts = ["".join(rng.choices("aaabbcc  é", k=rng.randint(0, 25))) for _ in range(300)]
    codec = pieces.Codec(made_model(kind, byte_fallback), 1)
    wanted = codec.reference.encode(texts)
    coded = list(codec.encode(texts))
    assert [ids.tolist() for ids, _, _ in coded] == wanted and all(same for _, same, _ in coded)
    back = codec.decode([ids for ids, _, _ in coded])
    assert [restored for _, _, restored in coded] == [a == b for a, b in zip(back, texts)]
    assert not byte_fallback or back == texts


def test_units_that_do_not_decode_are_told(model):
    codec = pieces.Codec(model, 1)
    codec._learn(["word", "other"])
    codec.lossy.add("word")
    assert [restored for _, _, restored in codec.encode(["word", "other word", "other", ""])] == [False, False, True, True]
    lossy = pieces.Codec(made_model(pieces.BPE, False), 1)
    assert [restored for _, _, restored in lossy.encode(["ab", "é ab", "ab c"])] == [True, False, True]


def test_whole_texts_are_checked(model, monkeypatch):
    """A difference that shows in whole texts only is told for every text, not for a sample."""
    texts = [f"some words {k}" for k in range(64)]
    codec = pieces.Codec(model, 1)
    encode = codec.reference.encode
    monkeypatch.setattr(codec.reference, "encode", lambda given, **way: [[*ids[:-1], 5] for ids in encode(given, **way)])
    assert [(same, restored) for _, same, restored in codec.encode(texts)] == [(False, True)] * 64


def test_units_make_up_every_text(model):
    """Whole lists of ids decoded by the library are the texts, over all documents of the largest table."""
    codec = pieces.Codec(model, 8)
    texts = [t for (t,) in duckdb.sql("select text from '/root/testdata/sf0.1/documents.parquet'").fetchall()]
    for start in range(0, len(texts), 1000):
        block = texts[start : start + 1000]
        coded = list(codec.encode(block))
        assert all(same and restored for _, same, restored in coded)
        assert codec.decode([ids for ids, _, _ in coded]) == block


def test_memory_of_units_is_bounded(model, monkeypatch):
    monkeypatch.setattr(pieces, "KNOWN_UNITS", 50)
    codec = pieces.Codec(model, 1)
    for start in range(0, 1000, 100):
        texts = [f"word{k} other{k * 7}" for k in range(start, start + 100)]
        assert [i.tolist() for i, _, _ in codec.encode(texts)] == codec.reference.encode(texts)
        assert len(codec.known) <= 50 + 400


def test_tasks_of_a_worker_learn_a_unit_once(model, monkeypatch):
    """Two tasks that follow each other in one process share the units; another model has a codec of its own."""
    learnt = []
    learn = pieces.Codec._learn
    monkeypatch.setattr(pieces.Codec, "_learn", lambda self, units: (learnt.extend(units), learn(self, units))[1])
    first = list(pieces.shared_codec(model).encode(["some words", "more words"]))
    again = list(pieces.shared_codec(model).encode(["more words", "some words"]))
    assert sorted(learnt) == ["more", "some", "words"]
    assert [ids.tolist() for ids, _, _ in again] == [ids.tolist() for ids, _, _ in first[::-1]]
    other = pieces.shared_codec(made_model(pieces.BPE, True))
    assert [ids.tolist() for ids, _, _ in other.encode(["ab"])] == other.reference.encode(["ab"])
    assert pieces.shared_codec(model).known == {}


def test_units_that_are_met_again_are_not_forgotten(model, monkeypatch):
    """A unit of every batch is learnt once, though the memory of units is full many times over."""
    monkeypatch.setattr(pieces, "KNOWN_UNITS", 100)
    learnt = []
    codec = pieces.Codec(model, 1)
    learn = codec._learn
    monkeypatch.setattr(codec, "_learn", lambda units: (learnt.extend(units), learn(units))[1])
    for start in range(0, 2000, 40):
        texts = [f"often word{k}" for k in range(start, start + 40)]
        assert [i.tolist() for i, _, _ in codec.encode(texts)] == codec.reference.encode(texts)
        assert len(codec.known) + len(codec.older) <= 100 + 82
    assert learnt.count("often") == 1 and len(learnt) == 2001


def test_units_learnt_together_are_those_learnt_alone(model):
    units = ["", "a", "\u2581b", "x\ny", "é", "😀", "</s>", "<0x0A>", "\u0000", "\u200b", *[f"word{k}" for k in range(100)]]
    for data in (model, made_model(pieces.BPE, True), made_model(pieces.BPE, False)):
        together, alone = pieces.Codec(data, 1), pieces.Codec(data, 1)
        together._learn(units)
        alone._learn_alone(units)
        assert together.known == alone.known and together.lossy == alone.lossy


def test_query(spark, sf_dir):
    rows = QUERIES["op9_sentencepiece"](spark, sf_dir).collect()
    texts = dict(duckdb.sql(f"select doc_id, text from '{sf_dir}/documents.parquet'").fetchall())
    assert {r.doc_id for r in rows} == set(texts)
    assert all(r.parity and r.restored and r.n_ids == len(r.ids) for r in rows)


def test_frames(spark, model):
    rows = [(k, t, "old") for k, t in enumerate([None, *ODD, *ODD])]
    docs = spark.createDataFrame(rows, DOC + ", ids string")
    coded = pieces.encode(docs, model)
    assert coded.columns == ["doc_id", "text", "ids", "n_ids", "parity", "restored"]
    back = pieces.decode(coded, model).collect()
    assert len(back) == len(rows)
    assert all(r.decoded == (r.text or "") and r.parity and r.restored for r in back)
    assert pieces.encode(spark.createDataFrame([], DOC), model).collect() == []


def test_other_models_are_refused():
    with pytest.raises(ValueError):
        pieces.parse_model(made_model(3, False))
