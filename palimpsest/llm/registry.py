"""The training-data queries: ``opN_<name>`` applies operator N to its whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from palimpsest.llm import common, itq, lang_id, line_chunks, minhash, mixing, pii, piece_codec, quality, secrets, winnow

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def tokenizer_path() -> str:
    """Where the public 32k BPE model lies."""
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


def op6_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    return piece_codec.digests(common.documents(spark, sf_dir), tokenizer_path())


QUERIES["op6_sentencepiece"] = op6_sentencepiece


def op3_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lang_id.predict(common.documents(spark, sf_dir))


def op9_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.classify(common.documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/labels.parquet"))


QUERIES["op3_language"] = op3_language
QUERIES["op9_quality"] = op9_quality


def op2_personal_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.digests(common.documents(spark, sf_dir))


QUERIES["op2_personal_data"] = op2_personal_data


def op10_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.digests(common.documents(spark, sf_dir))


QUERIES["op10_secrets"] = op10_secrets


def op8_winnowing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return winnow.compare_edited(common.documents(spark, sf_dir))


QUERIES["op8_winnowing"] = op8_winnowing


def op5_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.contract(common.documents(spark, sf_dir))


QUERIES["op5_mixing"] = op5_mixing
ORACLES["op5_mixing"] = mixing.ORACLE


def op4_line_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_chunks.contract(common.documents(spark, sf_dir))


QUERIES["op4_line_chunks"] = op4_line_chunks
ORACLES["op4_line_chunks"] = line_chunks.ORACLE


def op1_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash.cluster(common.documents(spark, sf_dir), words=4)


QUERIES["op1_minhash"] = op1_minhash


def op7_embeddings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return itq.similar(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))


QUERIES["op7_embeddings"] = op7_embeddings
