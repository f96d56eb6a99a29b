"""Word-vector text files and the Parquet vector cache."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from normlens.sources.tables import _existing, table_exists


def read_vector_text(spark: SparkSession, path: str) -> DataFrame:
    """(word, emb) from text lines ``word v1 ... vd`` after a first line ``n d``.

    Files are split and parsed in parallel. Only the header line goes to the
    driver. A word that occurs more than once keeps its first vector in file
    order; that choice is combined before the shuffle. A line with another
    number of values raises when the result is read; empty lines are skipped.
    """
    source = _existing(lambda: spark.read.text(path), path)
    files = sorted(source.inputFiles())
    first = spark.read.text(files[0]).first() if files else None
    counts = first["value"].split() if first else []
    if len(counts) != 2 or not all(c.isdigit() for c in counts):
        raise ValueError(f"no 'count dimension' header line in {path}")
    dim = int(counts[1])
    lines = source.select(
        F.rtrim("value").alias("line"),
        F.col("_metadata.file_path").alias("file"),
        F.col("_metadata.file_block_start").alias("start"),
        F.monotonically_increasing_id().alias("position"),
    )
    parts = F.split("line", " ")
    # Every file may begin with a header; any other line must be an entry.
    header = (F.col("start") == 0) & (F.col("line") == first["value"].rstrip())
    body = lines.where(~header & (F.col("line") != ""))
    wrong = F.raise_error(F.concat(F.lit(f"vector line without {dim} values: "), F.substring("line", 1, 80)))
    return (
        body.select(
            F.when(F.size(parts) == dim + 1, F.get(parts, F.lit(0))).otherwise(wrong).alias("word"),
            F.slice(parts, 2, dim).cast("array<float>").alias("emb"),
            F.struct("file", "start", "position").alias("at"))
        .groupBy("word").agg(F.min_by("emb", "at").alias("emb"))
    )


def write_vector_text(vectors: DataFrame, path: str, key: str = "word", emb: str = "emb") -> None:
    """Write (key, vector) rows as vector text with a leading header line.

    The header has a file of its own that sorts first; the rest stays as
    parallel part files.
    """
    sizes = vectors.agg(F.count("*").alias("n"), F.max(F.size(emb)).alias("d"))
    header = sizes.select(F.format_string("%d %d", "n", "d").alias("value"))
    rows = vectors.select(F.concat_ws(" ", F.col(key).cast("string"), F.col(emb).cast("array<string>"))
                          .alias("value"))
    header.coalesce(1).write.mode("overwrite").text(f"{path}/part=0")
    rows.write.mode("overwrite").text(f"{path}/part=1")


def write_vector_cache(vectors: DataFrame, path: str) -> None:
    """Always keeps the key beside its vector."""
    vectors.select("word", "emb").write.mode("overwrite").parquet(path)


def read_vector_cache(spark: SparkSession, path: str) -> DataFrame | None:
    """The cached vectors, or None so that callers skip this feature family."""
    return spark.read.parquet(path) if table_exists(spark, path) else None


def write_bucketed_vectors(df: DataFrame, name: str, path: str, key: str, buckets: int) -> DataFrame:
    """Store (key, emb) as the table ``name`` at ``path``, hashed by key into sorted buckets, and read it.

    Look-ups then shuffle the word list alone, in as many parts as there are
    buckets; the vectors stay where they are. Take at least as many buckets as
    the session has shuffle partitions.
    """
    (df.select(key, "emb").repartition(buckets, key).write.bucketBy(buckets, key).sortBy(key)
     .option("path", path).mode("overwrite").saveAsTable(name))
    return df.sparkSession.table(name)
