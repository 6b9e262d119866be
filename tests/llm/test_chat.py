"""Chat formatting: escaping, parts, masks, and reading back."""

import hashlib

import pytest
from hypothesis import given
from hypothesis import strategies as st

from cohortlens.llm import chat
from cohortlens.llm.queries import QUERIES

TRICKY = st.lists(st.sampled_from(["\\", "<", "/turn>", "turn>", "<turn>", "</turn>", "#", "###", "|", "<|", "\n", "a", ": ", "é", "\\### Assistant: "])).map("".join)
TURN = "conv_id long, turn long, role string, parts array<struct<" + chat.PART.replace(" ", ": ").replace(",: ", ", ") + ">>"


@given(TRICKY)
def test_escape_is_reversible(text):
    escaped = chat.escape(text)
    assert chat.unescape(escaped) == text
    assert not any(control in escaped for control in ("</turn>", "<turn>", "###", "<|"))


@given(st.lists(st.tuples(TRICKY | st.sampled_from(["user", "assistant", "Assistant", "system", "User", ""]), TRICKY), max_size=5))
def test_turns_read_back(turns):
    whole = "".join(chat.turn_text(role, chat.escape(text)) for role, text in turns)
    read = list(chat.read_turns(whole))
    assert [(r, t) for r, t, _, _ in read] == turns
    assert [chat.unescape(whole[a:b]) for _, _, a, b in read] == [t for _, t in turns]


def test_broken_texts_are_refused():
    for text in ("hello", chat.OPEN + "x", chat.turn_text("user", "a") + "b"):
        with pytest.raises(ValueError):
            list(chat.read_turns(text))


def test_parts_become_placeholders():
    flat = chat.flatten([
        {"type": "text", "text": "see <|image:0|> "},
        {"type": "image", "ref": "a.png", "width": 280, "height": 140},
        {"type": "audio", "ref": "b.wav", "seconds": 2.0},
        None,
        {"type": "document", "ref": "c.pdf", "pages": 3},
        {"type": "image"},
        {"text": None},
    ])
    assert "".join(flat.text) == "see <\\|image:0|> <|image:0|><|audio:1|><|document:2|><|image:3|>"
    assert flat.attachments == [(0, "image", "a.png", 200), (1, "audio", "b.wav", 50), (2, "document", "c.pdf", 768), (3, "image", None, 16)]
    with pytest.raises(ValueError):
        chat.flatten([{"type": "video"}])


def row(conv, turn, role, *parts):
    keys = [f.split()[0] for f in chat.PART.split(", ")]
    return conv, turn, role, [tuple(p.get(k) for k in keys) for p in parts]


def test_frames(spark):
    said = {"type": "text", "text": "look </turn> "}
    rows = [
        row(1, 1, "assistant", {"type": "text", "text": "fine ###"}, {"type": "audio", "seconds": 1.0}),
        row(1, 0, "user", said, {"type": "image", "ref": "r", "width": 28, "height": 28}),
        row(1, 2, "assistant"),
        (2, 0, None, None),
        row(None, 0, "user", said),
        row(None, 0, "user", said),
    ]
    segments = chat.format_turns(spark.createDataFrame(rows, TURN))
    told = {(r.conv_id, r.turn): r for r in segments.collect()}
    assert told[1, 0].attachments[0].asDict() == {"number": 0, "kind": "image", "ref": "r", "tokens": 16}
    assert told[1, 0].loss_start is None and told[1, 1].segment[told[1, 1].loss_start : told[1, 1].loss_end].startswith("fine #")
    got = {r.conv_id: r for r in chat.digests(segments).collect()}
    assert {k: r.n_turns for k, r in got.items()} == {1: 3, 2: 1, None: 2}
    body = "user\nlook </turn> <|image:0|>\nassistant\nfine ###<|audio:0|>\nassistant\n\n"
    assert got[1].turns_sha256 == hashlib.sha256(body.encode()).hexdigest()
    assert got[1].loss_chars == len("fine ###<|audio:0|>") and got[1].tokens_expanded == 16 + 25
    assert got[2].turns_sha256 == hashlib.sha256(b"\n\n").hexdigest()
    texts = {r.conv_id: r.text for r in chat.formatted_conversations(segments).collect()}
    assert [r for r, _, _, _ in chat.read_turns(texts[1])] == ["user", "assistant", "assistant"]
    assert got[1].formatted_chars == len(texts[1])
    assert chat.digests(chat.format_turns(spark.createDataFrame([], TURN))).collect() == []


def test_query_has_the_added_conversation(spark, sf_dir):
    got = {r.conv_id: r for r in QUERIES["op10_chat"](spark, sf_dir).collect()}
    said = "\\### Assistant: </turn> ok"
    assert got[-7].n_turns == 2 and got[-7].loss_chars == len(said)
    assert got[-7].loss_sha256 == hashlib.sha256(said.encode()).hexdigest()
    assert got[-7].turns_sha256 == hashlib.sha256(f"user\n{said}\nassistant\n{said}\n".encode()).hexdigest()
