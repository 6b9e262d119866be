"""Repeated runs of consecutive sentences, removed from all places but the first."""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator

import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cohortlens.sources.tables import write_once

RUN = 3
MIN_WORDS = 8
# Sentences of more words than this are cut behind words whose hash is divisible by CUT, and
# behind MOST_WORDS words without such a word: the places do not depend on what stands before.
WHOLE_WORDS = 16
CUT = 8
MOST_WORDS = 24

# A sentence reaches to its closing mark and the white space after it, or to a line's end.
_SENTENCE = re.compile(r"(?:[^.!?\n]|[.!?]+(?=[^\s.!?]))*(?:[.!?]+\s+|[.!?]+$|\n\s*|$)")
_WORD = re.compile(r"\s*\S+\s*")


def units(text: str | None) -> list[str]:
    """The text in sentences, long ones cut at words chosen by their hash.

    Joined they give the text again. A piece without words goes with the piece before it.
    """
    found: list[str] = []
    for sentence in _SENTENCE.findall(text or ""):
        words = sentence.split()
        if not words:
            if sentence:
                found[-1:] = [found[-1] + sentence] if found else [sentence]
        elif len(words) <= WHOLE_WORDS:
            found.append(sentence)
        else:
            found += _cut(sentence, words)
    return found


def _cut(sentence: str, words: list[str]) -> list[str]:
    parts, piece = [], []
    for word, spaced in zip(words, _WORD.findall(sentence)):
        piece.append(spaced)
        if len(piece) == MOST_WORDS or zlib.crc32(word.lower().encode("utf-8", "surrogatepass")) % CUT == 0:
            parts.append("".join(piece))
            piece = []
    return [*parts, "".join(piece)] if piece else parts


def span_hashes(text: str | None) -> dict[bytes, list[int]]:
    """Hash of every run of ``RUN`` units with ``MIN_WORDS`` words at least, and where it begins.

    Words are compared with A-Z lower-cased, white space between them as one space.
    """
    keys = [unit.encode("utf-8", "surrogatepass").lower().split() for unit in units(text)]
    places: dict[bytes, list[int]] = {}
    for start in range(len(keys) - RUN + 1):
        words = [w for key in keys[start : start + RUN] for w in key]
        if len(words) >= MIN_WORDS:
            places.setdefault(xxhash.xxh3_128_digest(b" ".join(words)), []).append(start)
    return places


def _spans(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    names = ["id", "version", "high", "low", "start", "again"]
    for batch in batches:
        rows = []
        for doc, version, text in batch.itertuples(index=False, name=None):
            for digest, starts in span_hashes(text).items():
                halves = int.from_bytes(digest[:8], "big", signed=True), int.from_bytes(digest[8:], "big", signed=True)
                rows += [(doc, version, *halves, start, start != starts[0]) for start in starts]
            if len(rows) >= 20_000:
                yield pd.DataFrame(rows, columns=names)
                rows = []
        yield pd.DataFrame(rows, columns=names)


def repeated_spans(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, version, covered) of the documents with a span that is not the first of its kind.

    The first span is that of the smallest document id, and in it the first one. Spans that
    occur more than once are found by a count per hash, which is reduced before it moves, and
    joined to all spans; a span that very many documents hold is a hot key that adaptive
    execution splits. ``covered`` holds the numbers of the units below a span to remove;
    ``version`` tells rows apart that repeat an id with another text.
    """
    text = F.col(text_col)
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.hash(text).alias("version"), text.alias("text"))
    schema = "id long, version int, high long, low long, start int, again boolean"
    spans = write_once(rows.mapInPandas(_spans, schema), "spans")
    # A null id counts as the smallest.
    order = F.coalesce("id", F.lit(-(2**63)))
    firsts = (
        spans.groupBy("high", "low")
        .agg(F.min(order).alias("first"), F.max(order).alias("last"))
        .filter(F.col("first") < F.col("last"))
        .select("high", "low", "first")
    )
    columns = ["id", "version", "start"]
    elsewhere = spans.drop("again").join(firsts, ["high", "low"]).filter(order > F.col("first")).select(*columns)
    found = elsewhere.unionAll(spans.filter("again").select(*columns)).groupBy("id", "version")
    units_of = F.transform(F.collect_set("start"), lambda start: F.sequence(start, start + RUN - 1))
    return found.agg(F.array_distinct(F.flatten(units_of)).alias("covered"))


def remove_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The columns of ``docs``, the text without repeated spans, ``n_units`` and ``n_removed``.

    A null text becomes empty; a text of fewer than ``RUN`` units has no span. Columns named
    like the added ones are replaced.
    """

    @F.pandas_udf("text string, n_units long, n_removed long")
    def cut(texts: pd.Series, covered: pd.Series) -> pd.DataFrame:
        rows = []
        for text, numbers in zip(texts, covered):
            parts = units(text)
            gone = set() if numbers is None else set(numbers)
            kept = "".join(p for k, p in enumerate(parts) if k not in gone) if gone else text or ""
            rows.append((kept, len(parts), len(gone)))
        return pd.DataFrame(rows, columns=["text", "n_units", "n_removed"])

    own = docs.drop("n_units", "n_removed")
    marks = repeated_spans(docs, id_col, text_col).select(
        F.struct("id", "version").alias("_row"), F.col("covered").alias("_covered")
    )
    key = F.struct(F.col(id_col).cast("long").alias("id"), F.hash(F.col(text_col)).alias("version"))
    rows = own.withColumn("_row", key)
    joined = rows.join(marks, rows["_row"].eqNullSafe(marks["_row"]), "left").drop("_row")
    done = joined.withColumn("_cut", cut(F.col(text_col), F.col("_covered")))
    return done.select(
        *[F.col("_cut.text").alias(text_col) if c == text_col else F.col(c) for c in own.columns],
        "_cut.n_units",
        "_cut.n_removed",
    )
