"""The operators as queries over whole tables, and SQL counterparts where SQL can express them."""

from __future__ import annotations

import zlib
from collections.abc import Callable

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from cohortlens.llm import (
    alignment,
    chat,
    language,
    line_dedup,
    mixing,
    outliers,
    periodic,
    pieces,
    quality,
    simhash,
    sketch,
    spans,
    zipwarc,
)
from cohortlens.llm.oracles import quality_rules
from cohortlens.runtime import new_path
from cohortlens.sources.tables import write_once

# Every source is to have the same share of the mixture.
MIX_WEIGHTS = {f"src{k}": 1.0 for k in range(20)}
PIECES_MODEL = "/opt/tokenizers/piece_bpe_32k.model"
BYTES_MODEL = "/opt/tokenizers/byte_bpe_50k.json"
SAID = "\\### Assistant: </turn> ok"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def quality_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    scored = quality.score(docs, quality.train(docs, table(spark, sf_dir, "labels")))
    return scored.select("doc_id", quality.held_out().alias("held_out"), "score", "predicted")


def line_dedup_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept = line_dedup.drop_repeated_lines(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return kept.select("doc_id", "n_lines", "n_dropped", F.sha2("text", 256).alias("kept_sha256"))


def simhash_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    grouped = simhash.near_groups(table(spark, sf_dir, "documents"))
    return grouped.select(
        "doc_id", F.lower(F.lpad(F.hex("mark"), 16, "0")).alias("fingerprint"), "component_id"
    )


def sketch_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sketch.with_following(table(spark, sf_dir, "documents"))


def spans_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spans.remove_repeats(table(spark, sf_dir, "documents").select("doc_id", "text"))


def mixing_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(table(spark, sf_dir, "documents"), MIX_WEIGHTS)


def outliers_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang", "source")
    told = outliers.judged(docs, keep_text=False).withColumn("distance", F.round("distance", 6))
    return told.select("doc_id", *outliers.BASE, "base_failed", "distance", "kept")


def warc_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = new_path(spark, "archives")
    zipwarc.write_archives(zipwarc.with_revisits(table(spark, sf_dir, "pages")), path)
    records = zipwarc.read_archives(spark, path)
    return records.select(
        "page_id",
        "payload_bytes",
        F.coalesce(F.sha1("payload"), F.col("payload_sha1")).alias("payload_digest"),
        "record_type",
        "refers_to",
    )


def pieces_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return pieces.encode(docs, pieces.model_bytes(PIECES_MODEL)).drop("text")


def chat_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    added = spark.createDataFrame([(-7, 0, "user", SAID), (-7, 1, "assistant", SAID)], turns.schema)
    rows = turns.unionAll(added).withColumn("parts", chat.as_parts(F.col("text")))
    return chat.digests(chat.format_turns(rows))


def language_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    held_out = F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 4 == 2, F.lit(False))
    filters = language.train(docs.filter(~held_out))
    told = language.predict(docs.drop("lang"), filters)
    return told.select("doc_id", held_out.alias("held_out"), "lang_pred", "score")


def alignment_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    aligned = alignment.align(docs, alignment.Sides(BYTES_MODEL, PIECES_MODEL))
    return aligned.select(*alignment.COLUMNS)


def _with_repeats(ids: pa.Array, texts: pa.Array) -> pa.Array:
    """Every tenth text, by the CRC-32 of its id, with words from a place on repeated with a period."""
    out = []
    for doc, text in zip(ids.to_pylist(), texts.to_pylist()):
        mark = 1 if doc is None else zlib.crc32(str(doc).encode())
        words = text.encode().split() if text and mark % 10 == 0 else []
        if words:
            size, group = len(words), mark // 10
            start = group % size
            period = 1 + (size - start) // (3 + group % 8)
            text = b" ".join(words[:start] + [words[start + k % period] for k in range(size - start)]).decode()
        out.append(text)
    return pa.array(out, pa.string())


def _text_digest(text: Column) -> Column:
    return F.sha2(text.cast("binary"), 256)


def periodic_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    repeated = F.arrow_udf(_with_repeats, "string")("doc_id", "text")
    docs = table(spark, sf_dir, "documents").select("doc_id", repeated.alias("text"))
    best = F.array_max(F.transform("runs", lambda r: F.struct(r.length, -r.start, -r.period)))
    lines = F.transform("runs", lambda r: F.concat(r.start, F.lit(","), r.length, F.lit(","), r.period, F.lit("\n")))
    return (
        periodic.periodic_runs(docs)
        .withColumn("best", best)
        .select(
            "doc_id",
            F.size("runs").cast("long").alias("n_runs"),
            (-F.col("best.col2")).alias("start"),
            F.col("best.length").alias("length"),
            (-F.col("best.col3")).alias("period"),
            F.floor(1000 * F.col("best.length") / -F.col("best.col3")).alias("exponent_milli"),
            _text_digest(F.array_join(lines, "")).alias("runs_sha256"),
            _text_digest(F.col("collapsed")).alias("collapsed_sha256"),
            "n_words",
        )
    )


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_quality": quality_query,
    "op2_line_dedup": line_dedup_query,
    "op3_simhash": simhash_query,
    "op4_sketch": sketch_query,
    "op5_spans": spans_query,
    "op6_mixing": mixing_query,
    "op7_outliers": outliers_query,
    "op8_zip_warc": warc_query,
    "op9_sentencepiece": pieces_query,
    "op10_chat": chat_query,
    "op11_language": language_query,
    "op12_alignment": alignment_query,
    "op13_periodic": periodic_query,
}

_BLANKS = "' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)"
_FOLDED = "translate(trim(line, " + _BLANKS + "), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

# Backslashes that escaping adds to a text.
_MARKS = """(length({0}) - length(replace({0}, chr(92), '')) + len(regexp_extract_all({0}, '<(/?turn>|[|])'))
            + coalesce(list_sum(list_transform(regexp_extract_all({0}, '##+#'), lambda x: length(x) - 2)), 0))"""

ORACLES = {
    "op2_line_dedup": f"""
WITH lines AS (
    SELECT doc_id, unnest(range(len(parts))) AS pos, unnest(parts) AS line
    FROM (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS parts FROM documents)
), keyed AS (SELECT *, {_FOLDED} AS key FROM lines),
often AS (
    SELECT key, max(doc_id) AS keeper FROM keyed WHERE length(key) >= 20
    GROUP BY key HAVING count(DISTINCT doc_id) >= 3
), marked AS (
    SELECT doc_id, pos, line, keeper IS NOT NULL AND keeper <> doc_id AS dropped
    FROM keyed LEFT JOIN often USING (key)
)
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (dropped) AS n_dropped,
    sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (NOT dropped), '')) AS kept_sha256
FROM marked GROUP BY doc_id
""",
    "op6_mixing": f"""
WITH listed AS (SELECT unnest([{", ".join(repr(s) for s in MIX_WEIGHTS)}]) AS source),
counts AS (SELECT source, count(*) AS n FROM documents JOIN listed USING (source) GROUP BY source),
rates AS (SELECT source, (SELECT sum(n) FROM counts) / ({len(MIX_WEIGHTS)}.0::DOUBLE * n) AS rate FROM counts
    UNION ALL SELECT NULL, 1.0),
steps AS (
    SELECT source, k, sum(exp(k * ln(rate) - rate - lgamma(k + 1)))
        OVER (PARTITION BY source ORDER BY k) AS below
    FROM rates, (SELECT unnest(range(200)) AS k)
), drawn AS (
    SELECT *, ('0x' || substr(md5('{mixing.SEED}:' || doc_id), 1, 13))::BIGINT / 4503599627370496.0::DOUBLE AS u,
        CASE WHEN source IN (SELECT source FROM listed) THEN source END AS rated
    FROM documents
), counted AS (
    SELECT d.doc_id, any_value(u) AS u, count(*) FILTER (below <= u) AS n
    FROM drawn d JOIN steps s ON s.source IS NOT DISTINCT FROM d.rated GROUP BY d.doc_id
)
SELECT d.*, copy, md5('{mixing.SEED}:' || doc_id || ':' || copy) AS mix_key
FROM (SELECT doc_id, unnest(range(1, n + 1)) AS copy FROM counted WHERE n > 0)
JOIN documents d USING (doc_id)
""",
    "op7_outliers": quality_rules(),
    "op8_zip_warc": """
WITH paid AS (
    SELECT page_id, encode(coalesce(html, '')) AS payload, coalesce(html, '') AS said FROM pages
), sized AS (
    SELECT page_id, octet_length(payload) AS payload_bytes, sha1(said) AS payload_digest, said FROM paid
), last AS (
    SELECT *, max(page_id) OVER (PARTITION BY said) AS response FROM sized
)
SELECT page_id, payload_bytes, payload_digest,
    CASE WHEN payload_bytes >= 1000 AND page_id < response THEN 'revisit' ELSE 'response' END AS record_type,
    CASE WHEN payload_bytes >= 1000 AND page_id < response THEN response END AS refers_to
FROM last
""",
    "op10_chat": f"""
WITH turns AS (
    SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
    UNION ALL SELECT -7, 0, 'user', '\\### Assistant: </turn> ok'
    UNION ALL SELECT -7, 1, 'assistant', '\\### Assistant: </turn> ok'
), sized AS (
    SELECT *, length(text) + {_MARKS.format("text")} AS body,
        CASE WHEN role IN ('system', 'user', 'assistant') THEN length(role)
            ELSE 5 + length(role) + {_MARKS.format("role")} + length(role) - length(replace(role, ':', '')) END AS shown
    FROM turns
)
SELECT conv_id, count(*) AS n_turns,
    sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn)) AS turns_sha256,
    coalesce(sum(length(text)) FILTER (role = 'assistant'), 0)::BIGINT AS loss_chars,
    sha256(coalesce(string_agg(text, '' ORDER BY turn) FILTER (role = 'assistant'), '')) AS loss_sha256,
    sum(6 + 4 + shown + 2 + body + 8)::BIGINT AS formatted_chars,
    0::BIGINT AS tokens_expanded
FROM sized GROUP BY conv_id
""",
}
