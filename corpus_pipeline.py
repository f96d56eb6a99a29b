"""Training-data pipeline over ``documents``; each stage applies one operator of ``normlens.llm``.

Every stage takes the rows that its predecessor kept and returns the columns of
``documents``, but for the last, which adds the token ids. ``n_chars`` follows
the text where a stage changes it.

Edge cases: null and empty texts pass all stages, with no ids at the end (they
are one group of near copies, so one of them stays); rows with a null id are
kept, compared and joined like others; of exactly repeated rows one stays;
columns beside those of ``documents`` are kept whatever their names, but that
a column ``ids`` is replaced by the token ids; very long texts go through
whole; an empty table gives an empty table.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from normlens.llm import byte_bpe, decontaminate, simhash, substring_dedup, toxicity
from normlens.llm.frames import free_names
from normlens.plans.relational import shared_folder

RANKS = public_tokenizers.path("byte_bpe_50k.tiktoken")


def aside(docs: DataFrame, *made: str) -> tuple[DataFrame, dict[str, str]]:
    """``docs`` with its own columns of these names renamed, and how to name them back."""
    clash = [c for c in docs.columns if c.lower() in made]
    held = dict(zip(clash, free_names(docs, *[f"{c}_" for c in clash])))
    return docs.withColumnsRenamed(held), {new: old for old, new in held.items()}


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose expected severity reaches the threshold go."""
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").select("doc_id", "toxic")
    rows, back = aside(docs, "severity", "is_toxic")
    kept = toxicity.grade(rows, labels).where(~F.col("is_toxic")).drop("severity", "is_toxic")
    return kept.withColumnsRenamed(back).select(docs.columns)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each SimHash group stays, that of the smallest id."""
    return simhash.keep_one(docs, size=3, radius=3)


def cut_repeated_spans(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Word runs under repeated 35-word windows are cut from the texts; every row stays."""
    rows, back = aside(docs, "n_words", "n_removed")
    cut = substring_dedup.remove_repeated(rows, width=35)
    if "n_chars" in docs.columns:
        length = F.length("text").cast(docs.schema["n_chars"].dataType)
        cut = cut.withColumn("n_chars", F.when(F.col("n_removed") > 0, length).otherwise(F.col("n_chars")))
    return cut.drop("n_words", "n_removed").withColumnsRenamed(back).select(docs.columns)


def drop_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that leak a benchmark item go."""
    return decontaminate.remove_leaks(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def encode_ids(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents with their token ids."""
    return byte_bpe.encode(docs, RANKS, public_tokenizers.PATTERN)


Stage = tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]
STAGES: list[Stage] = [
    ("toxicity", drop_toxic),
    ("simhash_near_dedup", drop_near_copies),
    ("substring_dedup", cut_repeated_spans),
    ("decontamination", drop_leaks),
    ("byte_bpe", encode_ids),
]

#: The stages fit a model and cluster near copies, which SQL cannot express.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Apply the stages to ``documents``; each result is written and read again by the next."""
    folder = f"{shared_folder(spark).rstrip('/')}/pipeline-{uuid.uuid4().hex}"
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        stage(spark, docs, sf_dir).write.parquet(f"{folder}/{name}")
        docs = spark.read.parquet(f"{folder}/{name}")
    return docs
