"""A corpus pipeline of five operators. Each stage takes (spark, docs, sf_dir) and returns a DataFrame."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessitura.llm import bpe, decontam, line_dedup, near_dup, quality
from tessitura.llm.common import shared_folder, table
from tessitura.llm.queries import vocabulary_path


def _as_documents(df: DataFrame, docs: DataFrame) -> DataFrame:
    """The columns of ``docs``; where there is n_chars, as the text now has."""
    return df.select(*[F.char_length("text").cast(docs.schema[c].dataType).alias(c) if c == "n_chars" else F.col(c) for c in docs.columns])


def quality_filter(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the documents that the quality classifier doesn't reject. A null text counts as empty; every row is judged by itself."""
    return quality.keep_good(docs, table(spark, sf_dir, "labels"))


def line_filter(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops lines of 40 characters or more that five or more documents share, but in the last of them. Every document stays, if only as an empty text."""
    return _as_documents(line_dedup.dedup_lines(docs), docs)


def near_dup_filter(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the document with the smallest doc_id of each class of near duplicates."""
    return near_dup.keep_one(docs)


def leak_filter(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents in which a benchmark item stands, within an edit budget of a tenth of its length."""
    return decontam.clean_documents(docs, table(spark, sf_dir, "benchmark"))


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of every document, with digests of the ids and of the text that they decode to."""
    return bpe.encode_texts(docs, vocabulary_path(), with_decoded=False)


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("quality", quality_filter),
    ("lines", line_filter),
    ("near_duplicates", near_dup_filter),
    ("leaks", leak_filter),
    ("tokens", tokens),
]
#: SQL expresses neither the classifier nor the signatures.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents; each is written as Parquet into the shared folder that spark.checkpoint.dir names and read again."""
    root = shared_folder(spark, "pipeline")
    docs = table(spark, sf_dir, "documents")
    for k, (name, stage) in enumerate(STAGES):
        out = f"{root}/{k}-{name}"
        stage(spark, docs, sf_dir).write.parquet(out)
        docs = spark.read.parquet(out)
    return docs
