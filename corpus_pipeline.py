"""The corpus pipeline: documents through five operators of ``cohortlens.llm``, stage by stage."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cohortlens.llm import line_dedup, mixing, outliers, pieces, simhash
from cohortlens.llm.queries import MIX_WEIGHTS, PIECES_MODEL
from cohortlens.sources.tables import write_once

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def _measured(docs: DataFrame) -> DataFrame:
    return docs.withColumn("n_chars", F.char_length("text").cast("long"))


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass the base rules and are no outliers of their language and source."""
    return outliers.judged(docs.select(*COLUMNS)).filter("kept").select(*COLUMNS)


def drop_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines that three documents hold stay in one of them."""
    return _measured(line_dedup.drop_repeated_lines(docs.select(*COLUMNS))).select(*COLUMNS)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies stays, that of the smallest id; see ``near_groups``.

    Rows that repeat the id that stays all stay, and so do rows without an id.
    """
    groups = simhash.near_groups(docs)
    first = groups.filter(F.col("doc_id") == F.col("component_id")).select("doc_id")
    named = docs.select(*COLUMNS).join(first.distinct(), "doc_id")
    return named.unionByName(docs.select(*COLUMNS).filter("doc_id IS NULL")).select(*COLUMNS)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents repeated so that every source gets its target weight, in random order."""
    return mixing.mix(docs.select(*COLUMNS), MIX_WEIGHTS).select(*COLUMNS)


def encode_pieces(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with the ids of their pieces."""
    return pieces.encode(docs.select(*COLUMNS), pieces.model_bytes(PIECES_MODEL)).drop("text")


STAGES = [
    ("quality rules", quality_rules),
    ("line dedup", drop_lines),
    ("simhash near-dedup", drop_near_copies),
    ("mixing", mix_sources),
    ("sentencepiece", encode_pieces),
]

# The fingerprints, the estimates and the ids have no counterpart in SQL; see tests/llm.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, each written and read again before the next."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = write_once(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return docs
