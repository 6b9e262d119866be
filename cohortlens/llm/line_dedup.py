"""Lines repeated over documents, as per-document keep bitmaps. DataFrame functions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cohortlens.llm.text import LOWER, UPPER, WHITESPACE
from cohortlens.sources.tables import write_once

# Lines that go the pre-aggregated way, and the counters of the sketch that finds them.
HOT_LINES = 1000
SKETCH_ITEMS = 10_000


def lines_of(text: Column) -> Column:
    return F.split(F.coalesce(text, F.lit("")), "\n")


def _version(text: Column) -> Column:
    """Keeps rows apart that repeat an id with another text."""
    return F.hash(F.coalesce(text, F.lit("")))


def line_keys(
    docs: DataFrame, min_chars: int = 20, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """One row per line whose key is long enough: id, version, n_lines, pos, and a 128-bit hash.

    The key is the line without white space at its ends, A-Z lower-cased.
    """
    lines = docs.select(
        F.col(id_col).alias("id"), _version(F.col(text_col)).alias("version"), lines_of(F.col(text_col)).alias("lines")
    )
    exploded = lines.select("id", "version", F.size("lines").alias("n_lines"), F.posexplode("lines").alias("pos", "line"))
    trimmed = exploded.withColumn("line", F.btrim("line", F.lit(WHITESPACE))).filter(
        F.char_length("line") >= min_chars
    )
    key = F.translate("line", UPPER, LOWER)
    keyed = trimmed.select("id", "version", "n_lines", "pos", key.alias("key"))
    return keyed.select(
        "id", "version", "n_lines", "pos", F.xxhash64("key").alias("h1"), F.xxhash64(F.lit(1), "key").alias("h2")
    )


def _hot_hashes(keys: DataFrame) -> list[int]:
    """The most frequent hashes, from a sketch of fixed size: HOT_LINES numbers at most.

    A line missed by the sketch holds less than a thousandth of all lines. The choice decides
    which way a line goes, never what becomes of it.
    """
    top = keys.agg(F.expr(f"approx_top_k(h1, {HOT_LINES}, {SKETCH_ITEMS})").alias("top")).first()["top"]
    return [item["item"] for item in top or []]


def repeated_lines(keys: DataFrame, min_docs: int) -> DataFrame:
    """(id, version, n_lines, pos) of the lines to drop: in ``min_docs`` documents, not in the last.

    Hashes are range-partitioned and sorted by document, the largest id first, and position;
    one pass over each range meets the first occurrence of a line before the others. The most
    frequent lines would fill a range of their own: they are counted by partial aggregates
    instead, and the few results go to every task. A null id is a document below all others.
    """
    hot = _hot_hashes(keys)
    is_hot = F.col("h1").isin(hot) if hot else F.lit(False)
    by_line = Window.partitionBy("h1", "h2")
    met = (
        keys.filter(~is_hot)
        .repartitionByRange("h1", "h2")
        .withColumn("place", F.dense_rank().over(by_line.orderBy(F.desc_nulls_last("id"))))
        .withColumn("places", F.max("place").over(by_line))
    )
    columns = ["id", "version", "n_lines", "pos"]
    dropped = met.filter((F.col("places") >= min_docs) & (F.col("place") > 1)).select(*columns)
    if not hot:
        return dropped
    often = keys.filter(is_hot)
    # At most one row per hot hash (and per collision of its other half).
    facts = (
        often.groupBy("h1", "h2")
        .agg(
            (F.count_distinct("id") + F.max(F.col("id").isNull().cast("int"))).alias("docs"), F.max("id").alias("last")
        )
        .filter(F.col("docs") >= min_docs)
    )
    often = often.join(F.broadcast(facts), ["h1", "h2"]).filter(~F.col("id").eqNullSafe(F.col("last")))
    return dropped.unionAll(often.select(*columns))


def _kept_runs(dropped: Column, n_lines: Column) -> Column:
    """Runs of kept lines between sorted dropped positions, as (start, length)."""
    last = F.size(dropped) - 1
    begins = F.filter(dropped, lambda x, i: (i == 0) | (F.get(dropped, i - 1) != x - 1))
    ends = F.filter(dropped, lambda x, i: (i == last) | (F.get(dropped, i + 1) != x + 1))
    starts = F.concat(F.array(F.lit(0)), F.transform(ends, lambda x: x + 1))
    stops = F.concat(begins, F.array(n_lines))
    runs = F.zip_with(starts, stops, lambda a, b: F.struct(a.alias("start"), (b - a).alias("length")))
    return F.filter(runs, lambda r: r["length"] > 0)


def keep_bitmaps(
    docs: DataFrame, min_chars: int = 20, min_docs: int = 3, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """(id, version, n_lines, n_dropped, keep) for the documents that lose a line.

    ``keep`` is the bitmap of kept lines in run-length form: (start, length) of each run of
    ones; a document that loses every line has no run. A line that ``min_docs`` documents hold
    stays in the document of the largest id alone. No text is moved. Nulls and empty texts
    have one empty line, which is never long enough.
    """
    keys = write_once(line_keys(docs, min_chars, id_col, text_col), "line-keys")
    return (
        repeated_lines(keys, min_docs)
        .groupBy("id", "version")
        .agg(F.max("n_lines").alias("n_lines"), F.array_sort(F.collect_set("pos")).alias("dropped"))
        .select(
            F.col("id").alias(id_col),
            "version",
            "n_lines",
            F.size("dropped").alias("n_dropped"),
            _kept_runs(F.col("dropped"), F.col("n_lines")).alias("keep"),
        )
    )


def apply_bitmaps(docs: DataFrame, bitmaps: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The columns of ``docs`` with the kept lines as text, and ``n_lines`` and ``n_dropped`` (long).

    A null text becomes empty. Columns of those two names in ``docs`` are replaced.
    """
    own = docs.drop("n_lines", "n_dropped")
    marks = bitmaps.select(F.struct(id_col, "version").alias("_row"), "n_dropped", F.col("keep").alias("_keep"))
    rows = own.withColumn("_row", F.struct(F.col(id_col), _version(F.col(text_col)).alias("version")))
    joined = rows.join(marks, rows["_row"].eqNullSafe(marks["_row"]), "left").select(
        *own.columns, lines_of(F.col(text_col)).alias("_lines"), "n_dropped", "_keep"
    )
    kept = F.flatten(F.transform("_keep", lambda r: F.slice("_lines", r["start"] + 1, r["length"])))
    text = F.when(F.col("_keep").isNull(), F.coalesce(F.col(text_col), F.lit(""))).otherwise(F.array_join(kept, "\n"))
    return joined.select(
        *[text.alias(text_col) if c == text_col else F.col(c) for c in own.columns],
        F.size("_lines").cast("long").alias("n_lines"),
        F.coalesce("n_dropped", F.lit(0)).cast("long").alias("n_dropped"),
    )


def drop_repeated_lines(
    docs: DataFrame, min_chars: int = 20, min_docs: int = 3, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """Documents without the lines that others hold too; see ``keep_bitmaps`` and ``apply_bitmaps``."""
    return apply_bitmaps(docs, keep_bitmaps(docs, min_chars, min_docs, id_col, text_col), id_col, text_col)
