"""Two tokenizers aligned over a corpus: which of their tokens overlap, and how often.

Texts are cut where both tokenizers cut them anyway, and each distinct piece is encoded and aligned
once. Every task gathers (pair of ids, document, times) records and spills them as runs: sorted
by radix of the second side, then side-major by pair, then document, compressed with zstd, with
a head that has the sum of every pair. The heads of a bucket are merged by a heap, a bounded
number of runs at a time, until one is left; as it is side-major, it shows the highest count of
each id of the second side at once. The counts then meet the runs' records, which give back what
every document gets from them.
"""

from __future__ import annotations

import hashlib
import json
import re
from collections.abc import Iterator
from dataclasses import dataclass
from heapq import merge
from itertools import chain

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType

from cohortlens.llm.pieces import BYTE, MARK, _has_units, model_bytes, parse_model
from cohortlens.sources.tables import write_once

COLUMNS = ["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]
# Buckets by the last bits of the second side's id; links and documents of a run; runs merged at once.
BUCKETS = 32
RUN_LINKS, RUN_DOCS = 2_000_000, 1 << 16
FAN_IN = 64
KNOWN_UNITS = 400_000
_ROWS, _UNITS_AT_ONCE = 256, 4096
_PAIRS = 1 << 16
_PAIR_BITS, _SLOT_BITS = 40, 16

# Appended to a model file, this turns off the mark that is put before a text.
_NO_PREFIX = b"\x1a\x02\x18\x00"
# A space behind a space or another blank is no place where both tokenizers cut.
_NO_CUT, _CUT = re.compile(r"^ |\s "), re.compile(r"(?<=\S) ")


@dataclass
class Sides:
    """Files of a byte-level model of the tokenizers library and of a SentencePiece model."""

    a_path: str
    b_path: str

    def data(self) -> tuple[bytes, bytes]:
        return model_bytes(self.a_path), model_bytes(self.b_path)


def byte_signs() -> dict[str, int]:
    """The byte that each sign of a byte-level vocabulary stands for.

    Printable bytes stand for themselves, the others for the signs from 256 on, in order.
    """
    plain = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b]
    others = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + k): b for k, b in enumerate(others)}


@dataclass
class Tokens:
    """Tokens of many units behind each other: their ids, numbers of bytes and the units they are of."""

    ids: np.ndarray
    sizes: np.ndarray
    unit: np.ndarray

    def of(self, units: np.ndarray) -> Tokens:
        """The tokens of the units that a mask names."""
        own = units[self.unit]
        return Tokens(self.ids[own], self.sizes[own], self.unit[own])


def spelled(side: list[list[int]], told: list[bytes], sizes: np.ndarray, texts: list[bytes]) -> tuple[Tokens, np.ndarray]:
    """The tokens of the units' texts, and whether their bytes are those of the text."""
    counts = np.fromiter(map(len, side), np.int64, len(side))
    ids = np.fromiter(chain.from_iterable(side), np.int64, int(counts.sum()))
    tokens = Tokens(ids, sizes[ids], np.repeat(np.arange(len(side)), counts))
    lengths = np.bincount(tokens.unit, tokens.sizes, len(side)).astype(np.int64)
    right = lengths == np.fromiter(map(len, texts), np.int64, len(texts))
    said = b"".join(map(told.__getitem__, ids.tolist()))
    if not right.all() or said != b"".join(texts):
        ends = np.cumsum(lengths)
        parts = zip((ends - lengths).tolist(), ends.tolist(), texts)
        right &= np.fromiter((said[start:end] == text for start, end, text in parts), bool, len(texts))
    return tokens, right


def linked(a: Tokens, b: Tokens) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Overlaps as places in ``a`` and ``b``, where a group ends with one, and the groups of all tokens.

    The units have equal numbers of bytes on both sides, so all are one stretch of bytes: every
    stretch between two ends of tokens is the overlap of one token of each side.
    """
    a_ends, b_ends = np.cumsum(a.sizes), np.cumsum(b.sizes)
    ends = np.union1d(a_ends, b_ends)
    i, j = np.searchsorted(a_ends, ends), np.searchsorted(b_ends, ends)
    closed = (a_ends[i] == ends) & (b_ends[j] == ends)
    group = np.cumsum(closed) - closed
    return i, j, closed, group[np.searchsorted(ends, a_ends)], group[np.searchsorted(ends, b_ends)]


# What stands behind a token: another of its side and group, the other side, the next group, the end.
_SIGNS = (",", "|", ";", "\n")


def shown_groups(a: Tokens, b: Tokens, a_group: np.ndarray, b_group: np.ndarray, words: list[str]) -> list[str]:
    """The groups of every unit as text; ``words`` are the ids with each of the signs behind them."""
    if not len(a.ids):
        return []
    side = np.concatenate([2 * a_group, 2 * b_group + 1])
    order = np.argsort(side, kind="stable")
    side, unit, ids = side[order], np.concatenate([a.unit, b.unit])[order], np.concatenate([a.ids, b.ids])[order]
    sign = np.full(len(ids), 3)
    sign[:-1] = np.where(side[1:] == side[:-1], 0, np.where(side[:-1] % 2 == 0, 1, np.where(unit[1:] == unit[:-1], 2, 3)))
    told = map(words.__getitem__, (sign * (len(words) // len(_SIGNS)) + ids).tolist())
    return "".join(told).split("\n")[:-1]


class Aligner:
    """Aligns texts by their distinct units; the memory of units is cleared when it is full.

    A unit is a space with what follows, up to the next space that stands behind a character
    that is no blank. A byte-level model with its usual pattern and a SentencePiece model whose
    pieces have marks in front only encode it alike alone and in a text; for other models the
    whole text is one unit.
    """

    def __init__(self, a_data: bytes, b_data: bytes):
        import sentencepiece
        from tokenizers import Tokenizer

        self.a = Tokenizer.from_buffer(a_data)
        self.a.encode_special_tokens = True
        settings, model = json.loads(a_data), parse_model(b_data)
        split = settings.get("pre_tokenizer") or {}
        plain = split.get("type") == "ByteLevel" and split.get("use_regex", True) and not split.get("add_prefix_space")
        self.by_unit = bool(plain and not settings.get("normalizer") and _has_units(model))
        self.b = sentencepiece.SentencePieceProcessor(model_proto=b_data + _NO_PREFIX)
        signs = byte_signs()
        vocabulary = self.a.get_vocab()
        self.a_bytes = [b""] * (max(vocabulary.values()) + 1)
        for token, number in vocabulary.items():
            if all(c in signs for c in token):
                self.a_bytes[number] = bytes(signs[c] for c in token)
        self.b_bytes = [
            bytes([int(piece[3:5], 16)]) if kind == BYTE else piece.replace(MARK, " ").encode()
            for piece, _, kind in model.pieces
        ]
        if len(self.a_bytes) * len(self.b_bytes) >> _PAIR_BITS:
            raise ValueError("too many pairs of ids")
        self.a_sizes, self.b_sizes = (np.array([len(t) for t in side]) for side in (self.a_bytes, self.b_bytes))
        largest = max(len(self.a_bytes), len(self.b_bytes))
        self.words = [f"{number}{sign}" for sign in _SIGNS for number in range(largest)]
        self._forget()

    def _forget(self) -> None:
        self.known: dict[str, int] = {}
        self.groups: list[str] = []
        # Of every unit: tokens of both sides, groups, links, and whether both sides spell it.
        self.sizes = np.empty((0, 5), np.int64)
        self.pairs = np.empty(0, np.int64)
        self.starts = np.empty(0, np.int64)

    def units(self, text: str) -> list[str]:
        """The units of a space and the text, without their first space."""
        if not self.by_unit:
            return [text]
        return _CUT.split(text) if _NO_CUT.search(text) else text.split(" ")

    def _learn(self, units: list[str]) -> None:
        spaced = [" " + u for u in units]
        sides_a = [
            encoded.ids
            for start in range(0, len(spaced), _UNITS_AT_ONCE)
            for encoded in self.a.encode_batch_fast(spaced[start : start + _UNITS_AT_ONCE], add_special_tokens=False)
        ]
        sides_b = self.b.encode(spaced, num_threads=1)
        texts = [unit.encode() for unit in spaced]
        a, a_right = spelled(sides_a, self.a_bytes, self.a_sizes, texts)
        b, b_right = spelled(sides_b, self.b_bytes, self.b_sizes, texts)
        right = a_right & b_right
        a, b = a.of(right), b.of(right)
        i, j, closed, a_group, b_group = linked(a, b)
        shown = iter(shown_groups(a, b, a_group, b_group, self.words))
        self.groups += [next(shown) if good else "" for good in right.tolist()]
        figures = [a.unit, b.unit, a.unit[i[closed]], a.unit[i]]
        sizes = np.stack([*(np.bincount(of, minlength=len(units)) for of in figures), right.astype(np.int64)], axis=1)
        pairs = b.ids[j] * len(self.a_bytes) + a.ids[i]
        for unit in units:
            self.known[unit] = len(self.known)
        self.sizes = np.concatenate([self.sizes, sizes])
        self.pairs = np.concatenate([self.pairs, pairs])
        self.starts = np.cumsum(self.sizes[:, 3]) - self.sizes[:, 3]

    def align(self, texts: list[str]) -> tuple[np.ndarray, list[str], np.ndarray, np.ndarray]:
        """Per text tokens of both sides, groups and links, and its groups as text; per link text and pair.

        A pair is the second side's id times the size of the first vocabulary plus the first's id.
        """
        if len(self.known) >= KNOWN_UNITS:
            self._forget()
        parts = [self.units(t) if t else [] for t in texts]
        new = set(chain.from_iterable(parts)).difference(self.known)
        if new:
            self._learn(list(new))
        places = [list(map(self.known.__getitem__, units)) for units in parts]
        counts = np.array([len(p) for p in places])
        flat = np.fromiter(chain.from_iterable(places), np.int64, int(counts.sum()))
        owner = np.repeat(np.arange(len(texts)), counts)
        sizes = np.zeros((len(texts), 5), np.int64)
        filled = np.flatnonzero(counts)
        if len(flat):
            sizes[filled] = np.add.reduceat(self.sizes[flat], (np.cumsum(counts) - counts)[filled])
        whole = (counts > 0) & (sizes[:, 4] == counts)
        sizes[~whole] = 0
        shown = [";".join([self.groups[k] for k in p]) if good else "" for p, good in zip(places, whole.tolist())]
        good = whole[owner]
        flat, owner = flat[good], owner[good]
        lengths = self.sizes[flat, 3]
        steps = np.arange(int(lengths.sum())) - np.repeat(np.cumsum(lengths) - lengths, lengths)
        return sizes[:, :4], shown, np.repeat(owner, lengths), self.pairs[np.repeat(self.starts[flat], lengths) + steps]


# Arrays in compressed blocks -------------------------------------------------------------------


def _packed(*arrays: np.ndarray) -> bytes:
    """Integer arrays of one length, byte plane by byte plane, in one zstd frame."""
    planes = [len(arrays[0]).to_bytes(8, "little")]
    for values in arrays:
        width = max(1, (int(values.max()).bit_length() + 7) // 8) if len(values) else 1
        raw = values.astype("<i8").view(np.uint8).reshape(-1, 8)[:, :width]
        planes += [bytes([width]), raw.T.tobytes()]
    return zstandard.ZstdCompressor(level=3).compress(b"".join(planes))


def _unpacked(frame: bytes) -> list[np.ndarray]:
    data = zstandard.ZstdDecompressor().decompress(frame)
    size, at, arrays = int.from_bytes(data[:8], "little"), 8, []
    while at < len(data):
        width = data[at]
        raw = np.zeros((size, 8), np.uint8)
        raw[:, :width] = np.frombuffer(data, np.uint8, width * size, at + 1).reshape(width, size).T
        arrays.append(raw.view("<i8").ravel())
        at += 1 + width * size
    return arrays


def _head(pairs: np.ndarray, sums: np.ndarray, *more: np.ndarray) -> list[bytes]:
    """Sorted pairs with their figures, in blocks; pairs as steps from the one before."""
    blocks = []
    for start in range(0, len(pairs), _PAIRS):
        part = slice(start, start + _PAIRS)
        blocks.append(_packed(np.diff(pairs[part], prepend=0), sums[part], *[m[part] for m in more]))
    return blocks


def _read_head(blocks: list[bytes]) -> Iterator[list[np.ndarray]]:
    for block in blocks:
        steps, *more = _unpacked(block)
        yield [np.cumsum(steps), *more]


# Tasks ------------------------------------------------------------------------------------------

_DOCUMENT = "run string, slot int, {id}, n_a long, n_b long, n_groups long, n_links long, groups_sha256 string"
_RUN = "bucket int, head array<binary>, body binary"


def _keyed(pairs: np.ndarray, slots: np.ndarray, width: int) -> np.ndarray:
    """Bucket, pair and slot of each link in one number."""
    bucket = pairs // width % BUCKETS
    return bucket << _PAIR_BITS + _SLOT_BITS | pairs << _SLOT_BITS | slots


def _runs(keys: np.ndarray) -> Iterator[tuple[int, list[bytes], bytes]]:
    """(bucket, head, body) of a run, for each bucket it has records of, from its links in any order."""
    keys.sort()
    firsts = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]]))
    times = np.diff(firsts, append=len(keys))
    keys = keys[firsts]
    slots, keyed = keys & (1 << _SLOT_BITS) - 1, keys >> _SLOT_BITS
    heads = np.flatnonzero(np.concatenate([[True], keyed[1:] != keyed[:-1]]))
    records = np.diff(heads, append=len(keyed))
    sums = np.add.reduceat(times, heads)
    pairs, bucket = keyed[heads] & (1 << _PAIR_BITS) - 1, keyed[heads] >> _PAIR_BITS
    steps = np.diff(slots, prepend=0)
    steps[heads] = slots[heads]
    bounds = np.flatnonzero(np.concatenate([[True], bucket[1:] != bucket[:-1]])).tolist()
    ends = np.append(heads, len(slots))
    for low, high in zip(bounds, [*bounds[1:], len(pairs)]):
        part, own = slice(low, high), slice(ends[low], ends[high])
        yield int(bucket[low]), _head(pairs[part], sums[part], records[part]), _packed(steps[own], times[own] - 1)


def _spill(shared):
    """Rows of documents and of runs, from batches of (id, text); the columns of the other kind are null."""

    def spill(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        aligner = Aligner(*shared.value)
        width, task = len(aligner.a_bytes), TaskContext.get().partitionId()
        number = docs = links = 0
        held: list[np.ndarray] = []
        kind = pa.int64()

        def rows(size: int, **columns) -> pa.RecordBatch:
            schema = _arrow(_DOCUMENT.format(id="id long") + ", " + _RUN).set(2, pa.field("id", kind))
            filled = [pa.array(columns[f.name], f.type) if f.name in columns else pa.nulls(size, f.type) for f in schema]
            return pa.RecordBatch.from_arrays(filled, schema=schema)

        def flushed() -> Iterator[pa.RecordBatch]:
            if links:
                keys = np.concatenate(held)
                held.clear()
                for bucket, head, body in _runs(keys):
                    yield rows(1, run=[f"{task}-{number}"], bucket=[bucket], head=[head], body=[body])

        for batch in batches:
            kind = batch.schema.field("id").type
            for start in range(0, len(batch), _ROWS):
                part = batch.slice(start, _ROWS)
                sizes, shown, owner, pairs = aligner.align([t or "" for t in part["text"].to_pylist()])
                if docs and (docs + len(part) > RUN_DOCS or links + len(pairs) > RUN_LINKS):
                    yield from flushed()
                    number, docs, links = number + 1, 0, 0
                    held.clear()
                digests = [hashlib.sha256(s.encode()).hexdigest() if s else "" for s in shown]
                figures = dict(zip(("n_a", "n_b", "n_groups", "n_links"), sizes.T))
                slots = np.arange(docs, docs + len(part), dtype=np.int32)
                yield rows(
                    len(part), run=[f"{task}-{number}"] * len(part), slot=slots, id=part["id"], groups_sha256=digests, **figures
                )
                held.append(_keyed(pairs, owner + docs, width))
                docs, links = docs + len(part), links + len(pairs)
        yield from flushed()

    return spill


def _merged(heads: list[list[bytes]]) -> tuple[np.ndarray, np.ndarray]:
    """The pairs of all heads in order with the sums of their counts, by a heap over the heads."""

    def stream(blocks: list[bytes]) -> Iterator[tuple[int, int]]:
        for pairs, sums, *_ in _read_head(blocks):
            yield from zip(pairs.tolist(), sums.tolist())

    pairs, sums, last = [], [], -1
    for pair, count in merge(*map(stream, heads)):
        if pair == last:
            sums[-1] += count
        else:
            pairs.append(pair)
            sums.append(count)
            last = pair
    return np.array(pairs, np.int64), np.array(sums, np.int64)


_MERGED = "bucket int, part int, head array<binary>"


def _merge_part(key: tuple, rows: pa.Table) -> pa.Table:
    head = _head(*_merged(rows["head"].to_pylist()))
    return pa.table({"bucket": [key[0].as_py()], "part": [key[1].as_py()], "head": [head]}, _arrow(_MERGED))


def _arrow(fields: str) -> pa.Schema:
    kinds = {
        "int": pa.int32(), "long": pa.int64(), "string": pa.string(), "binary": pa.binary(),
        "array<binary>": pa.list_(pa.binary()),
    }
    return pa.schema([pa.field(name, kinds[kind]) for name, kind in (f.split(" ") for f in fields.split(", "))])


def _with_best(rows: pa.Table, width: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Pairs, counts, and whether a count is the highest of the second side's id."""
    pairs, sums = _merged(rows["head"].to_pylist())
    owner = pairs // width
    firsts = np.flatnonzero(np.concatenate([[True], owner[1:] != owner[:-1]]))
    highest = np.repeat(np.maximum.reduceat(sums, firsts), np.diff(firsts, append=len(pairs)))
    return pairs, sums, sums == highest


_GIVEN = "run string, figures binary"
_LOW = (1 << 26) - 1


def _give_back(width: int):
    """What the documents of each run get from the records of a bucket: (run, figures)."""

    def give(runs: pa.Table, heads: pa.Table) -> pa.Table:
        names, figures = [], []
        if runs.num_rows:
            pairs, sums, best = _with_best(heads, width)
            for run, head, body in zip(*(runs[c].to_pylist() for c in ("run", "head", "body"))):
                steps, times = _unpacked(body)
                own, _, records = (np.concatenate(c) for c in zip(*_read_head(head)))
                at = np.searchsorted(pairs, own)
                starts = np.cumsum(records) - records
                slots = np.cumsum(steps)
                slots -= np.repeat(slots[starts] - steps[starts], records)
                times += 1
                each, highest = np.repeat(sums[at], records), np.repeat(best[at], records)
                size = int(slots.max()) + 1
                # Floats add whole numbers below 2^53 exactly, so counts are added in two halves.
                total = np.zeros(size, np.int64)
                for shift, part in ((26, each >> 26), (0, each & _LOW)):
                    total += np.bincount(slots, times * part, size).astype(np.int64) << shift
                names.append(run)
                figures.append(_packed(np.bincount(slots, times * highest, size).astype(np.int64), total))
        return pa.table({"run": names, "figures": figures}, _arrow(_GIVEN))

    return give


_ADDED = "run string, slot int, n_best long, count_sum long"


def _add_up(key: tuple, rows: pa.Table) -> pa.Table:
    """The figures of a run's documents, added up over the buckets."""
    parts = [_unpacked(frame) for frame in rows["figures"].to_pylist()]
    size = max(len(part[0]) for part in parts)
    added = np.zeros((2, size), np.int64)
    for part in parts:
        for k in (0, 1):
            added[k, : len(part[k])] += part[k]
    return pa.table(
        {"run": [key[0].as_py()] * size, "slot": np.arange(size, dtype=np.int32), "n_best": added[0], "count_sum": added[1]},
        _arrow(_ADDED),
    )


def align(docs: DataFrame, sides: Sides, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``COLUMNS`` for every row of ``docs``: its tokens on both sides, groups, links and what they are worth.

    A space and the text are encoded by the first side, the text by the second, which adds the
    space; strings of special tokens are plain text. A link is an overlap of two tokens in bytes.
    A pair of ids counts its links over all rows, repeated rows as often as they occur.
    ``n_best`` are the links whose count is the highest of their second id, ``count_sum`` is the
    sum of the counts of all links. Null and empty texts, and texts that one side cannot spell, have
    no tokens: zeros and an empty digest. Ids may repeat or be null: each row has its own
    figures. Texts are taken whole; other columns are not read. A run holds ``RUN_LINKS`` links, or
    one batch of longer texts; the counts of a bucket are bounded by the two vocabularies.
    """
    spark = docs.sparkSession
    data = sides.data()
    aligner = Aligner(*data)
    width = len(aligner.a_bytes)
    shared = spark.sparkContext.broadcast(data)
    own = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    kind = own.schema["id"].dataType
    fields = _DOCUMENT.format(id=f"id {kind.simpleString()}") + ", " + _RUN
    spilled = own.mapInArrow(_spill(shared), fields)
    spilled = write_once(spilled, "spilled")
    runs = spilled.filter("bucket IS NOT NULL").select("run", "bucket", "head", "body")
    rows = spilled.filter("bucket IS NULL")

    count = runs.select("run").distinct().count()
    parts = max(1, -(-count // FAN_IN))
    part = F.pmod(F.xxhash64("run"), F.lit(parts)).cast("int")
    heads = runs.select("bucket", part.alias("part"), "head")
    while True:
        heads = write_once(heads.groupBy("bucket", "part").applyInArrow(_merge_part, _MERGED), "heads")
        if parts == 1:
            break
        parts = max(1, -(-parts // FAN_IN))
        heads = heads.withColumn("part", F.pmod(F.xxhash64("part"), F.lit(parts)).cast("int"))

    split = max(1, -(-count // FAN_IN))
    keyed = runs.withColumn("part", F.pmod(F.xxhash64("run"), F.lit(split)).cast("int"))
    copies = heads.drop("part").withColumn("part", F.explode(F.sequence(F.lit(0), F.lit(split - 1))))
    given = keyed.groupBy("bucket", "part").cogroup(copies.groupBy("bucket", "part")).applyInArrow(_give_back(width), _GIVEN)
    added = given.groupBy("run").applyInArrow(_add_up, _ADDED)
    named = rows.drop("bucket", "head", "body").join(added, ["run", "slot"], "left").withColumnRenamed("id", id_col)
    zero = F.lit(0).cast(LongType())
    return named.select(
        id_col, "n_a", "n_b", "n_groups", "n_links",
        F.coalesce("n_best", zero).alias("n_best"), F.coalesce("count_sum", zero).alias("count_sum"), "groups_sha256",
    )
