"""SentencePiece models run by the tokenizers library, checked against SentencePiece itself."""

from __future__ import annotations

import os
import re
import struct
from array import array
from collections.abc import Iterator
from dataclasses import dataclass, field
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

MARK = "\u2581"
# Fixed values of the model format: piece types and model types.
NORMAL, UNKNOWN, CONTROL, USER, UNUSED, BYTE = range(1, 7)
UNIGRAM, BPE = 1, 2

# Tasks keep the cores busy by themselves: more threads in a task cost more CPU seconds for the same rows.
THREADS = 1
KNOWN_UNITS = 600_000
# Units that are encoded and decoded by one call.
_JOINED = 32
_ROWS = 256


def _varint(data: bytes, at: int) -> tuple[int, int]:
    value = shift = 0
    while True:
        byte = data[at]
        value |= (byte & 0x7F) << shift
        at, shift = at + 1, shift + 7
        if byte < 0x80:
            return value, at


def wire_fields(data: bytes) -> Iterator[tuple[int, int | bytes]]:
    """(field number, value) of a protobuf message: numbers, and bytes of the other kinds."""
    at = 0
    while at < len(data):
        key, at = _varint(data, at)
        kind = key & 7
        if kind == 0:
            value, at = _varint(data, at)
        else:
            if kind == 2:
                size, at = _varint(data, at)
            elif kind in (1, 5):
                size = 8 if kind == 1 else 4
            else:
                raise ValueError(f"wire type {kind} in a model file")
            value, at = data[at : at + size], at + size
        yield key >> 3, value


@dataclass
class Model:
    """What a model file says that encoding depends on."""

    pieces: list[tuple[str, float, int]] = field(default_factory=list)
    kind: int = UNIGRAM
    byte_fallback: bool = False
    suffix_marks: bool = False
    charsmap: bytes = b""
    dummy_prefix: bool = True
    single_spaces: bool = True
    escape_spaces: bool = True

    @property
    def unknown(self) -> int | None:
        return next((k for k, p in enumerate(self.pieces) if p[2] == UNKNOWN), None)


def parse_model(data: bytes) -> Model:
    """The pieces, the model type and the normaliser of a serialized model.

    Field numbers are those of the public model definition: pieces 1, trainer 2, normaliser 3.
    """
    model = Model()
    for number, value in wire_fields(data):
        if number == 1:
            parts = dict(wire_fields(value))
            score = struct.unpack("<f", parts[2])[0] if 2 in parts else 0.0
            model.pieces.append((parts.get(1, b"").decode("utf-8"), score, parts.get(3, NORMAL)))
        elif number == 2:
            trainer = dict(wire_fields(value))
            model.kind = trainer.get(3, UNIGRAM)
            model.suffix_marks = bool(trainer.get(24, 0))
            model.byte_fallback = bool(trainer.get(35, 0))
        elif number == 3:
            spec = dict(wire_fields(value))
            model.charsmap = spec.get(2, b"")
            model.dummy_prefix = bool(spec.get(3, 1))
            model.single_spaces = bool(spec.get(4, 1))
            model.escape_spaces = bool(spec.get(5, 1))
    if model.kind not in (UNIGRAM, BPE) or model.suffix_marks or not model.escape_spaces:
        raise ValueError("only unigram and BPE models with leading space marks can be rebuilt")
    return model


def _merges(model: Model) -> list[tuple[str, str]]:
    """Pairs that make up a piece, best piece first, as SentencePiece joins them."""
    ids = {p: k for k, (p, _, kind) in enumerate(model.pieces) if kind in (NORMAL, USER, UNUSED)}
    ranked = []
    for number, (piece, score, kind) in enumerate(model.pieces):
        if kind == NORMAL:
            for cut in range(1, len(piece)):
                left, right = piece[:cut], piece[cut:]
                if left in ids and right in ids:
                    ranked.append((-score, number, ids[left], ids[right], left, right))
    return [pair[4:] for pair in sorted(ranked)]


def build_core(model: Model):
    """The bare model in the tokenizers library: it takes text with marks in place of spaces."""
    from tokenizers import AddedToken, Tokenizer, models

    unknown = model.unknown
    if model.kind == UNIGRAM:
        vocabulary = [(p, s) for p, s, _ in model.pieces]
        core = Tokenizer(models.Unigram(vocabulary, unk_id=unknown, byte_fallback=model.byte_fallback))
    else:
        core = Tokenizer(
            models.BPE(
                {p: k for k, (p, _, _) in enumerate(model.pieces)},
                _merges(model),
                unk_token=None if unknown is None else model.pieces[unknown][0],
                fuse_unk=True,
                byte_fallback=model.byte_fallback,
            )
        )
    core.add_tokens([AddedToken(p, normalized=False) for p, _, kind in model.pieces if kind == USER])
    return core


def decoder(prefix: bool):
    """Marks to spaces, byte pieces to characters; the space of the mark before a text taken off."""
    from tokenizers import decoders

    steps = [decoders.Replace(MARK, " "), decoders.ByteFallback(), decoders.Fuse()]
    return decoders.Sequence([*steps, decoders.Strip(" ", 1, 0)] if prefix else steps)


def build_tokenizer(model: Model):
    """The whole tokenizer: normaliser, space mark, model and decoder with byte fallback."""
    from tokenizers import Regex, normalizers

    tokenizer = build_core(model)
    steps = [normalizers.Precompiled(model.charsmap)] if model.charsmap else []
    if model.single_spaces:
        steps += [normalizers.Replace(Regex(" {2,}"), " "), normalizers.Strip()]
    steps.append(normalizers.Replace(" ", MARK))
    if model.dummy_prefix:
        steps.append(normalizers.Prepend(MARK))
    tokenizer.normalizer = normalizers.Sequence(steps)
    tokenizer.decoder = decoder(model.dummy_prefix)
    return tokenizer


# A unit is a run of marks with what follows it, written without its first mark.
_UNIT = re.compile(f"{MARK}({MARK}*[^{MARK}]*)")


def _has_units(model: Model) -> bool:
    """Whether a unit of a normalised text is encoded alike alone and within the text."""
    across = any(MARK in piece.lstrip(MARK) for piece, _, _ in model.pieces)
    users = any(kind == USER for _, _, kind in model.pieces)
    changed = model.charsmap or model.single_spaces or not model.dummy_prefix
    return model.kind == BPE and not (changed or across or users)


class Codec:
    """Encodes batches of texts by their distinct units, and checks every whole text.

    Each distinct unit is encoded once and kept, and SentencePiece decodes it once. When half of the
    memory of units is full, those that were not met since the half before are forgotten. Models whose pieces leave no such units, and unigram models, which weigh a whole
    text, encode and decode whole texts.
    """

    def __init__(self, data: bytes, threads: int = THREADS):
        os.environ["TOKENIZERS_PARALLELISM"] = "true" if threads > 1 else "false"
        os.environ["RAYON_NUM_THREADS"] = str(threads)
        import sentencepiece

        self.model = parse_model(data)
        self.tokenizer = build_tokenizer(self.model)
        self.core = build_core(self.model)
        self.reference = sentencepiece.SentencePieceProcessor(model_proto=data)
        self.threads = threads
        self.by_unit = _has_units(self.model)
        self.marked = np.array([piece.startswith(MARK) for piece, _, _ in self.model.pieces], bool)
        self.known: dict[str, bytes] = {}
        self.older: dict[str, bytes] = {}
        self.lossy: set[str] = set()

    @staticmethod
    def units(text: str) -> list[str]:
        """The units of a text with one mark before it; none of an empty text."""
        if not text:
            return []
        spaced = " " + text
        if "  " in spaced or MARK in text:
            return _UNIT.findall(spaced.replace(" ", MARK))
        return text.split(" ")

    def _learn(self, units: list[str]) -> None:
        """Encode units that are not known yet, and note those that do not decode to themselves.

        Units that hold no mark go side by side into one text: each begins with its one mark, so its ids
        begin with its one marked piece, and the text decodes to the units between spaces if every unit
        decodes to itself. Those for which that does not hold are encoded and decoded alone.
        """
        plain = [u for u in units if u and MARK not in u]
        alone = [u for u in units if not u or MARK in u]
        groups = [plain[start : start + _JOINED] for start in range(0, len(plain), _JOINED)]
        joined = self.core.encode_batch_fast([MARK + MARK.join(g) for g in groups], add_special_tokens=False)
        encoded = [e.ids for e in joined]
        for group, ids, told in zip(groups, encoded, self.reference.decode(encoded, num_threads=self.threads)):
            flat = np.array(ids, np.int32)
            starts = np.flatnonzero(self.marked[flat])
            if len(starts) != len(group) or starts[0] or told != " ".join(group):
                alone += group
                continue
            cells, cuts = flat.tobytes(), (starts * flat.itemsize).tolist()
            self.known.update(zip(group, map(cells.__getitem__, map(slice, cuts, [*cuts[1:], None]))))
        if alone:
            self._learn_alone(alone)

    def _learn_alone(self, units: list[str]) -> None:
        encoded = [e.ids for e in self.core.encode_batch_fast([MARK + u for u in units], add_special_tokens=False)]
        told = self.reference.decode(encoded, num_threads=self.threads)
        self.known.update(zip(units, [array("i", ids).tobytes() for ids in encoded]))
        if told != units:
            self.lossy.update(u for u, back in zip(units, told) if back != u.replace(MARK, " "))

    def _whole(self, texts: list[str]) -> Iterator[tuple[np.ndarray, bool, bool]]:
        encoded = [e.ids for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]
        wanted = self.reference.encode(texts, num_threads=self.threads)
        back = self.tokenizer.decode_batch(encoded, skip_special_tokens=False)
        for text, ids, other, told in zip(texts, encoded, wanted, back):
            yield np.array(ids, np.int32), ids == other, told == text

    def encode(self, texts: list[str]) -> Iterator[tuple[np.ndarray, bool, bool]]:
        """(ids, parity, restored) of every text, in order.

        Parity says that SentencePiece gives the same ids for the whole text. Restored says that
        the ids decode to the text: every unit does, and no mark of the text itself becomes a space.
        """
        if not self.by_unit:
            yield from self._whole(texts)
            return
        parts = [self.units(t) for t in texts]
        if len(self.known) >= KNOWN_UNITS // 2:
            self.known, self.older = {}, self.known
            self.lossy.intersection_update(self.older)
        new = set(chain.from_iterable(parts)).difference(self.known)
        if self.older:
            self.known.update([(u, self.older[u]) for u in new if u in self.older])
            new = new.difference(self.known)
        if new:
            self._learn(list(new))
        known = self.known.__getitem__
        wanted = self.reference.encode(texts, return_type="numpy", num_threads=self.threads)
        for text, units, other in zip(texts, parts, wanted):
            ids = b"".join(map(known, units))
            restored = MARK not in text and (not self.lossy or self.lossy.isdisjoint(units))
            yield np.frombuffer(ids, np.int32), np.asarray(other, np.int32).tobytes() == ids, restored

    def decode(self, lists: list[np.ndarray]) -> list[str]:
        return self.tokenizer.decode_batch([ids.tolist() for ids in lists], skip_special_tokens=False)


# The codec of a worker process, by model and threads: the tasks of a worker learn a unit once among them.
_codecs: dict[tuple[bytes, int], Codec] = {}


def shared_codec(data: bytes, threads: int = THREADS) -> Codec:
    """The codec this process keeps for a model; that of another model takes its place."""
    if (data, threads) not in _codecs:
        _codecs.clear()
        _codecs[data, threads] = Codec(data, threads)
    return _codecs[data, threads]


def model_bytes(path: str) -> bytes:
    with open(path, "rb") as file:
        return file.read()


def encode(docs: DataFrame, model: bytes, text_col: str = "text", threads: int = THREADS) -> DataFrame:
    """The columns of ``docs``, ``ids``, ``n_ids``, ``parity`` and ``restored``.

    ``ids`` are the piece ids without begin and end marks; ``parity`` says that SentencePiece
    gives the same ids for the whole text and ``restored`` that the ids decode to the text. Null
    and empty texts have no ids; texts are encoded whole, however long. Other columns and repeated
    rows stay as they are; columns of those names in ``docs`` are replaced. The model goes to the
    tasks as its file's bytes.
    """
    docs = docs.drop("ids", "n_ids", "parity", "restored")
    shared = docs.sparkSession.sparkContext.broadcast(model)

    @F.arrow_udf("ids array<int>, parity boolean, restored boolean")
    def encoded(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        codec = shared_codec(shared.value, threads)
        kind = pa.struct([("ids", pa.list_(pa.int32())), ("parity", pa.bool_()), ("restored", pa.bool_())])
        for batch in batches:
            blocks, same, back = [], [], []
            for start in range(0, len(batch), _ROWS):
                texts = [t or "" for t in batch[start : start + _ROWS].to_pylist()]
                for ids, parity, restored in codec.encode(texts):
                    blocks.append(ids)
                    same.append(parity)
                    back.append(restored)
            sizes = [len(ids) for ids in blocks]
            offsets = pa.array(np.concatenate([[0], np.cumsum(sizes, dtype=np.int64)]).astype(np.int32))
            flat = pa.array(np.concatenate(blocks) if blocks else np.empty(0, np.int32))
            lists = pa.ListArray.from_arrays(offsets, flat)
            yield pa.StructArray.from_arrays([lists, pa.array(same, pa.bool_()), pa.array(back, pa.bool_())], fields=list(kind))

    done = docs.withColumn("_coded", encoded(F.col(text_col)))
    return done.select(
        *docs.columns,
        "_coded.ids",
        F.size("_coded.ids").alias("n_ids"),
        "_coded.parity",
        "_coded.restored",
    )


def decode(rows: DataFrame, model: bytes, ids_col: str = "ids", out: str = "decoded") -> DataFrame:
    """The columns of ``rows`` and the text of their ids; a null list gives an empty text."""
    shared = rows.sparkSession.sparkContext.broadcast(model)

    @F.arrow_udf("string")
    def texts(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        tokenizer = build_tokenizer(parse_model(shared.value))
        for batch in batches:
            lists = [ids or [] for ids in batch.to_pylist()]
            yield pa.array(tokenizer.decode_batch(lists, skip_special_tokens=False), pa.string())

    return rows.withColumn(out, texts(F.col(ids_col)))
