"""The corpus pipeline: stages over documents, each written as Parquet before the next."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tsforge.llm import bpe, decontaminate, language_id, line_dedup, minhash
from tsforge.llm.common import materialize, table


#: A line of at least this many words counts as a repeated run alone.
LINE_WORDS = 8


def _without(docs: DataFrame, ids: DataFrame) -> DataFrame:
    """The rows whose doc_id isn't among ``ids``; rows without a doc_id stay."""
    return docs.join(ids.distinct(), "doc_id", "left_anti").select(*docs.columns)


def _row_key() -> Column:
    """A key of what a judgment of the row alone reads, with or without a doc_id. Hashes skip
    nulls, so where they stand is hashed too."""
    read = ("doc_id", "text", "lang", "source")
    return F.xxhash64(*read, *(F.col(c).isNull() for c in read))


def _without_rows(docs: DataFrame, keys: DataFrame) -> DataFrame:
    """The rows whose key isn't among the only column of ``keys``."""
    return docs.withColumn("row_key", _row_key()).join(keys.toDF("row_key").distinct(), "row_key", "left_anti").select(*docs.columns)


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    judged = language_id.identify(docs.withColumn("row_key", _row_key()), id_col="row_key", declared=F.col("lang"), host=F.col("source"))
    return _without_rows(docs, judged.where("not kept").select("row_key"))


def drop_repeated_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that lose every line to earlier copies go; n_chars follows the text."""
    cleaned = line_dedup.drop_repeated_lines(docs, words=LINE_WORDS).where("not line_dedup.emptied")
    n_chars = F.when(F.col("line_dedup.n_removed") > 0, F.length("text")).otherwise(F.col("n_chars")).cast(docs.schema["n_chars"].dataType)
    return cleaned.withColumn("n_chars", n_chars).select(*docs.columns)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return _without(docs, minhash.near_duplicates(docs).where("not kept").select("doc_id"))


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    found = decontaminate.contaminated(docs.withColumn("row_key", _row_key()), table(spark, sf_dir, "benchmark"), doc_id="row_key")
    return _without_rows(docs, found.select("doc_id"))


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return bpe.encode_texts(docs, public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("language_id", identify_language),
    ("line_dedup", drop_repeated_lines),
    ("near_duplicates", drop_near_duplicates),
    ("decontamination", drop_contaminated),
    ("byte_bpe", encode),
]

#: The classifier and the tokenizer stand outside SQL; tests hold each stage against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = materialize(stage(spark, docs, sf_dir), name)
    return docs
