"""Language of a text by bit-sliced Bloom filters over character n-grams.

One array of slots serves all languages: bit l of a slot is that of the filter of language l, so
the slots of an n-gram, combined by AND, are at once the set of all languages whose filter holds
it. The n-grams of a text are counted per language and corrected for the share that a filter of
its filling takes in by chance; the language with most decides.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import cache

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from cohortlens.sources.tables import write_once

UNKNOWN = "und"
SIZES = (2, 3, 4)
# A language's filter takes the n-grams that are so frequent among those of its texts, and not
# rarer than such a part of their frequency in the language that has them most. The first
# bounds a filter to 1 / MIN_RATE n-grams, whatever the corpus.
MIN_RATE, MIN_SHARE = 1e-5, 0.1
HASHES = 3
SLOTS_PER_GRAM = 8
_BITS = 63
_BLOCK_CHARS = 1 << 19
_KEPT_GRAMS = 1 << 20
_FIRST, _SECOND = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xD6E8FEB86659FD93)


@cache
def _letters() -> np.ndarray:
    return np.fromiter((chr(c).isalpha() for c in range(0x110000)), bool, 0x110000)


def ngrams(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """(hash, number of the text) of every n-gram of the words of the texts.

    Letters are lower-cased; a word is a run of letters with one blank at each end, and an
    n-gram lies in one word with its blanks. Hashes have 62 bits.
    """
    lower = [t.lower() for t in texts]
    points = np.frombuffer(" ".join(["", *lower, ""]).encode("utf-32-le", "surrogatepass"), np.uint32)
    owner = np.repeat(np.arange(len(lower)), [len(t) + 1 for t in lower])
    letter = _letters()[points]
    kept = letter.copy()
    kept[1:] |= letter[:-1]
    kept[0] = True
    owner = np.concatenate([[0], owner])[kept]
    signs = np.where(letter, points, 0)[kept].astype(np.uint64)
    hashes, owners = [], []
    for size in SIZES:
        count = len(signs) - size + 1
        if count <= 0:
            continue
        mixed, whole = np.full(count, size, np.uint64), np.ones(count, bool)
        for place in range(size):
            sign = signs[place : place + count]
            mixed = (mixed ^ sign) * _FIRST
            mixed ^= mixed >> np.uint64(29)
            if 0 < place < size - 1:
                whole &= sign != 0
        if size == 2:
            whole &= (signs[:count] != 0) | (signs[1:] != 0)
        mixed *= _SECOND
        hashes.append((mixed >> np.uint64(2))[whole].astype(np.int64))
        # The blank before the first letter belongs to the text before; the second sign decides.
        owners.append(owner[1 : 1 + count][whole])
    return np.concatenate(hashes or [np.empty(0, np.int64)]), np.concatenate(owners or [np.empty(0, np.int64)])


def _blocks(texts: list[str]) -> Iterator[tuple[int, list[str]]]:
    """(number of the first text, texts) of bounded size; a longer text is a block of its own."""
    start, block, chars = 0, [], 0
    for at, text in enumerate(texts):
        if block and chars + len(text) > _BLOCK_CHARS:
            yield start, block
            start, block, chars = at, [], 0
        block.append(text)
        chars += len(text)
    if block:
        yield start, block


def _added_up(parts: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    grams, at = np.unique(np.concatenate([g for g, _ in parts]), return_inverse=True)
    return grams, np.bincount(at, np.concatenate([n for _, n in parts])).astype(np.int64)


def _count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """(lang, gram, n) of every task: n-grams are added up before they leave it."""
    held: dict[str, list[tuple[np.ndarray, np.ndarray]]] = {}
    sizes: dict[str, int] = {}

    def flushed() -> Iterator[pd.DataFrame]:
        for lang, parts in held.items():
            grams, n = _added_up(parts)
            yield pd.DataFrame({"lang": lang, "gram": grams, "n": n})
        held.clear()
        sizes.clear()

    for batch in batches:
        for lang, part in batch.groupby("lang"):
            for _, block in _blocks(part["text"].tolist()):
                grams, n = np.unique(ngrams(block)[0], return_counts=True)
                parts = held.setdefault(lang, [])
                parts.append((grams, n))
                sizes[lang] = sizes.get(lang, 0) + len(grams)
                if sizes[lang] > _KEPT_GRAMS:
                    held[lang] = [_added_up(parts)]
                    sizes[lang] = len(held[lang][0][0])
                    if sizes[lang] > _KEPT_GRAMS // 2:
                        yield from flushed()
    yield from flushed()


@dataclass
class Filters:
    """The learned languages, most texts first, and the slots: one row of words of 63 bits each."""

    languages: list[str]
    slots: np.ndarray

    def masks(self, grams: np.ndarray) -> np.ndarray:
        """The languages that hold each n-gram, as bits."""
        low, step = grams & 0x7FFFFFFF, grams >> 31 | 1
        found = self.slots[low & len(self.slots) - 1]
        for turn in range(1, HASHES):
            found = found & self.slots[low + turn * step & len(self.slots) - 1]
        return found

    def by_chance(self) -> np.ndarray:
        """The part of foreign n-grams that each language's filter takes in: its filling to the power of its hashes."""
        return np.array([(self.slots[:, k // _BITS] >> k % _BITS & 1).mean() for k in range(len(self.languages))]) ** HASHES

    def counts(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """n-grams of each text, and those of them that each language holds, corrected for chance."""
        total = np.zeros(len(texts))
        hits = np.zeros((len(texts), len(self.languages)))
        for start, block in _blocks(texts):
            grams, owner = ngrams(block)
            if not len(grams):
                continue
            stop = start + len(block)
            total[start:stop] = np.bincount(owner, minlength=len(block))
            found = self.masks(grams)
            for k in range(len(self.languages)):
                bit = found[:, k // _BITS] >> k % _BITS & 1
                hits[start:stop, k] = np.bincount(owner, bit, len(block))
        chance = self.by_chance()
        return total, np.maximum(0.0, (hits - total[:, None] * chance) / np.maximum(1.0 - chance, 1e-9))


def train(docs: DataFrame, text_col: str = "text", lang_col: str = "lang") -> Filters:
    """Filters of every non-null language of ``docs``, from all its whole texts.

    Rows without a language or a text teach nothing; repeated rows count as often as they
    occur. n-grams are counted inside the tasks, then by a partial aggregate; which languages
    take an n-gram is decided per n-gram, and the slots are combined by a bitwise OR before
    they come to the driver: at most 16 slots for each n-gram of the largest filter, whose size
    ``MIN_RATE`` bounds.
    """
    told = docs.select(F.col(lang_col).cast("string").alias("lang"), F.col(text_col).alias("text")).filter(
        "lang IS NOT NULL AND text IS NOT NULL"
    )
    sizes = told.groupBy("lang").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "lang").collect()
    languages = [row.lang for row in sizes]  # one row per language
    words = max(1, -(-len(languages) // _BITS))
    if not languages:
        return Filters([], np.zeros((1, words), np.int64))
    counted = told.mapInPandas(_count, "lang string, gram long, n long")
    counted = write_once(counted.groupBy("lang", "gram").agg(F.sum("n").alias("n")), "ngrams")
    totals = counted.groupBy("lang").agg(F.sum("n").alias("total"))
    numbers = docs.sparkSession.createDataFrame([(lang, k) for k, lang in enumerate(languages)], "lang string, number int")
    rated = counted.join(totals.join(numbers, "lang"), "lang").select("gram", "number", (F.col("n") / F.col("total")).alias("rate"))
    best = F.max("rate").over(Window.partitionBy("gram"))
    held = rated.filter(F.col("rate") >= MIN_RATE).withColumn("best", best)
    held = write_once(held.filter(F.col("rate") >= MIN_SHARE * F.col("best")).select("gram", "number"), "held")
    largest = max([row.n for row in held.groupBy("number").agg(F.count(F.lit(1)).alias("n")).collect()], default=0)
    size = 1 << max(10, (SLOTS_PER_GRAM * largest - 1).bit_length())
    low, step = F.col("gram").bitwiseAND(0x7FFFFFFF), F.shiftright("gram", 31).bitwiseOR(F.lit(1))
    places = F.array(*[(low + turn * step).bitwiseAND(size - 1) for turn in range(HASHES)])
    bits = held.select(
        F.explode(places).alias("slot"),
        F.floor(F.col("number") / _BITS).alias("word"),
        F.expr(f"shiftleft(1L, CAST(number % {_BITS} AS INT))").alias("bit"),
    )
    set_bits = bits.groupBy("slot", "word").agg(F.bit_or("bit").alias("mask")).toPandas()
    slots = np.zeros((size, words), np.int64)
    slots[set_bits["slot"].to_numpy(np.int64), set_bits["word"].to_numpy(np.int64)] = set_bits["mask"].to_numpy(np.int64)
    return Filters(languages, slots)


def predict(docs: DataFrame, filters: Filters, text_col: str = "text") -> DataFrame:
    """The columns of ``docs``, ``lang_pred`` and ``score``.

    The language is the one with most n-grams, ties going to the language with more texts in
    training, then by name; a text without any known n-gram gets the language with most texts
    and a score of 0. The score is the share of the best in the sum of the best two. Null texts,
    texts without a letter, and all texts where nothing was learned, are ``und`` with a score of
    0. Texts are read whole, long ones in one piece; every row is judged by itself. Columns of
    these names in ``docs`` are replaced, others stay.
    """
    docs = docs.drop("lang_pred", "score")
    shared = docs.sparkSession.sparkContext.broadcast((filters.languages, filters.slots))

    @F.arrow_udf("lang_pred string, score double")
    def told(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        known = Filters(*shared.value)
        for batch in batches:
            total, hits = known.counts([t or "" for t in batch.to_pylist()])
            names, scores = np.full(len(total), UNKNOWN, object), np.zeros(len(total))
            if known.languages:
                read = total > 0
                names[read] = np.array(known.languages, object)[hits[read].argmax(axis=1)]
                top = np.sort(hits, axis=1)[:, ::-1][:, :2]
                scores = np.divide(top[:, 0], top.sum(axis=1), out=scores, where=top.sum(axis=1) > 0)
            yield pa.StructArray.from_arrays(
                [pa.array(names, pa.string()), pa.array(scores, pa.float64())], ["lang_pred", "score"]
            )

    judged = docs.withColumn("_told", told(F.col(text_col)))
    return judged.select(*docs.columns, "_told.lang_pred", "_told.score")
