"""From raw documents to training tokens, in five stages.

Every stage takes the whole table that the one before kept and returns a table with the columns
of ``documents`` (the last one: token ids). The runner writes each result and reads it again.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from palimpsest.llm import common, lang_id, line_chunks, minhash, mixing, piece_codec, registry

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Label each document by its main language; those without a letter go.

    A text in several languages stays, whatever share its main one has. Where no document has a
    label nothing can be judged, and all stay as they are.
    """
    model = lang_id.fit(docs, "text", "lang", F.col("doc_id"))
    if not model.langs:
        return docs.select(*COLUMNS)
    labelled = lang_id.identify(docs, model, {c: F.col(c) for c in COLUMNS})
    return labelled.filter(F.col("lang_pred") != lang_id.UNKNOWN).withColumn("lang", F.col("lang_pred")).select(*COLUMNS)


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Take out chunks of lines that an earlier place holds already; every document stays."""
    done = line_chunks.dedup(docs.select(*COLUMNS))
    return done.withColumn("n_chars", F.length("text").cast("long")).select(*COLUMNS)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies stays; rows that share an id are one document, rows without one all stay."""
    kept = minhash.cluster(docs, words=5).filter("kept").select(F.col("doc_id").alias("_kept")).distinct()
    return docs.join(kept, F.col("doc_id").eqNullSafe(F.col("_kept")), "left_semi").select(*COLUMNS)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mix takes it."""
    return mixing.resampled(docs, COLUMNS)


def sentencepiece(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids (little-endian unsigned 32-bit) and whether they decode to the text again."""
    return piece_codec.encode_checked(docs, registry.tokenizer_path(), {c: F.col(c) for c in ("doc_id", "lang", "source")})


STAGES = [("language_id", language_id), ("line_dedup", line_dedup), ("near_dedup", near_dedup), ("mix_sources", mix_sources), ("sentencepiece", sentencepiece)]

#: SQL has no trained model, minhash or tokenizer.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = common.documents(spark, sf_dir)
    for name, step in STAGES[:-1]:
        docs = common.stage(step(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
