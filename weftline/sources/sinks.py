"""Sinks: submissions as CSV, resumable output, profiles."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def score_rows(df: DataFrame, id_col: str = "id", score_col: str = "score") -> DataFrame:
    """Ids in order with scores clipped to [0, 1] and written to six places."""
    clipped = F.least(F.greatest(F.col(score_col), F.lit(0.0)), F.lit(1.0))
    return df.select(F.col(id_col), F.format_string("%.6f", clipped).alias(score_col)).orderBy(id_col)


def write_csv(df: DataFrame, path: str, single: bool = False) -> None:
    """``single`` makes one file of rows that are few by contract, as a submission's are."""
    (df.coalesce(1) if single else df).write.mode("overwrite").option("header", True).csv(path)


def pending(todo: DataFrame, done: DataFrame, key: str) -> DataFrame:
    """What is still to do: a checkpointed job goes on with this."""
    return todo.join(done.select(key).distinct(), key, "left_anti")


def append_parquet(df: DataFrame, path: str) -> None:
    df.write.mode("append").parquet(path)


def write_json_lines(df: DataFrame, path: str) -> None:
    df.write.mode("append").json(path)


def latest_file(spark: SparkSession, pattern: str, without: str = "") -> str | None:
    """The last file by name under a pattern, leaving out names that end in ``without``."""
    files = spark.read.format("binaryFile").load(pattern).select("path")
    if without:
        files = files.filter(~F.col("path").endswith(without))
    return files.agg(F.max("path")).first()[0]


def describe(df: DataFrame, about: bool = False) -> DataFrame:
    """Rows, nulls and distinct values of every column, in one pass; ``about``: distinct values by a sketch."""
    distinct = F.approx_count_distinct if about else F.count_distinct
    cells = [
        F.struct(F.lit(c).alias("field"), F.count(c).alias("n"), F.sum(F.col(c).isNull().cast("long")).alias("nulls"), distinct(F.col(c)).alias("n_distinct"))
        for c in df.columns
        if not df.schema[c].dataType.simpleString().startswith("map")
    ]
    return df.agg(F.array(*cells).alias("c")).select(F.explode("c").alias("c")).select("c.*")
