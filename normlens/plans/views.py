"""Norm-shaped views over the driver's tables (see FIXTURES.md)."""

from __future__ import annotations

from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from normlens.functions.numeric import round_even
from normlens.operators.targets import minmax_scale
from normlens.operators.vectors import dimension, lookup
from normlens.plans.relational import materialize
from normlens.sources.tables import nan_to_null

ROW_KEY = ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice"]
LEXICON_TARGETS = ("en_share", "pos", "neg", "mixed")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return nan_to_null(spark.read.parquet(f"{sf_dir}/{name}.parquet"))


def ratings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One rated item per line item; ``ROW_KEY`` is its unique total order."""
    return table(spark, sf_dir, "lineitem").selectExpr(
        *ROW_KEY,
        "concat(l_orderkey, '-', l_linenumber) AS Word",
        "1D + 4D * (l_quantity - 1D) / 49D AS Valence",
        "1D + 4D * l_extendedprice / 105000D AS Arousal",
        "1D + 40D * l_discount AS Happiness",
        "1D + 50D * l_tax AS Anger",
        "5D - 4D * (l_quantity - 1D) / 49D AS Fear",
        "CASE WHEN l_linenumber = 7 THEN NULL ELSE 1D + 4D * (l_linenumber - 1) / 6D END AS Sadness",
        "1D + 4D * (l_partkey % 50) / 49D AS Disgust",
        "1D + 4D * (l_suppkey % 10) / 9D AS Surprise",
        "l_extendedprice AS Frequency_Zipf",
        "l_quantity AS Concreteness",
        "CASE WHEN l_returnflag = 'R' THEN NULL ELSE l_tax END AS Imageability",
        "nullif(l_returnflag, 'R') AS PoS",
    )


def _tokens() -> Column:
    return F.array_distinct(F.filter(F.split(F.lower("text"), r"[^\p{L}]+"), lambda t: t != ""))


def lexicon(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Distinct lowercase words with document counts and averaged document labels.

    Words are made distinct inside each document's own row, so the only shuffle
    is the map-side-combined count per word.
    """
    documents = table(spark, sf_dir, "documents").join(
        table(spark, sf_dir, "labels"), "doc_id", "left")
    return (
        documents
        .select("lang", "quality", "toxic", F.explode(_tokens()).alias("w"))
        .groupBy("w")
        .agg(
            F.count("*").alias("n_docs"),
            F.avg((F.col("lang") == "en").cast("int")).alias("en_share"),
            F.avg("quality").alias("pos"),
            F.avg("toxic").alias("neg"),
        )
    )


def vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "embeddings").select(
        F.col("vec_id"), F.col("embedding").alias("emb"), F.col("label"))


def token_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Token rows: the label groups them, and group 9 is fully masked."""
    return table(spark, sf_dir, "embeddings").selectExpr(
        "label AS word_id",
        "vec_id AS pos",
        "embedding AS emb",
        "CASE WHEN label = 9 THEN 0 ELSE int(vec_id % 3 <> 0) END AS mask",
    )


def modelling_lexicon(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All lexicon words with the mixed target.

    The lexicon is far smaller than the documents and is read several times, so
    it is written out rather than tokenised again.
    """
    words = materialize(lexicon(spark, sf_dir))
    scaled = minmax_scale(words, ["pos", "neg"], strict=False)
    return scaled.withColumn("mixed", round_even(F.col("pos_01") * F.col("neg_01"), 6)).drop("pos_01", "neg_01")


def word_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(w, emb): the mean embedding of the documents that hold a word; words of no such document are absent."""
    held = table(spark, sf_dir, "documents").join(
        vectors(spark, sf_dir).withColumnRenamed("vec_id", "doc_id").drop("label"), "doc_id")
    tokens = held.select(array_to_vector(F.col("emb").cast("array<double>")).alias("v"), F.explode(_tokens()).alias("w"))
    return tokens.groupBy("w").agg(vector_to_array(Summarizer.mean(F.col("v")), "float32").alias("emb"))


def modelling_vectors(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, int]:
    """Lexicon words with their targets and static vectors (zero if unknown), and the dimension."""
    known = materialize(word_vectors(spark, sf_dir))
    dim = dimension(known)
    return lookup(modelling_lexicon(spark, sf_dir), known, "w", dim).drop("oov"), dim
