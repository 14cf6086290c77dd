"""Pieces that several operators of this subpackage use."""

from __future__ import annotations

import atexit
import gc
import os
import re
import shutil
import tempfile

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def shared_dir(spark: SparkSession) -> str:
    """The folder that the driver and all executors share.

    It is read from ``spark.checkpoint.dir``.  Only where that setting is
    absent and all of Spark is one process (unit tests) a folder of this machine
    is used, and removed at the end.
    """
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise RuntimeError("on a cluster, set spark.checkpoint.dir to a folder that the driver and all executors share")
        folder = getattr(shared_dir, "own", None)
        if folder is None:
            place = tempfile.mkdtemp(prefix="weftline-")
            atexit.register(shutil.rmtree, place, ignore_errors=True)
            folder = shared_dir.own = "file://" + place
    jsc = spark.sparkContext._jsc.sc()
    if jsc.getCheckpointDir().isEmpty():
        spark.sparkContext.setCheckpointDir(folder)
    return folder.rstrip("/")


def remove(spark: SparkSession, folder: str) -> None:
    """Delete a folder that nothing reads any more."""
    place = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
    place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(place, True)


FILE_ROWS = 500_000


def cut(df: DataFrame, rows: int | None = None) -> DataFrame:
    """Write ``df`` to the shared folder and go on from the written rows.

    ``rows``: about how many narrow rows there are, if known.  They are then
    written to a file for each ``FILE_ROWS``, not one for each shuffle partition.
    """
    shared_dir(df.sparkSession)
    if rows is not None:
        # a shuffle of narrow rows: what makes them stays spread over its own tasks
        df = df.repartition(1 + rows // FILE_ROWS)
    return df.checkpoint(eager=True)


BROADCAST_ROWS = 100_000


def counted(df: DataFrame) -> tuple[DataFrame, int]:
    """A narrow table, written, and the number of its rows."""
    written = cut(df)
    return written, written.count()


def beside(df: DataFrame, rows: int) -> DataFrame:
    """``df`` marked for broadcast if its counted rows are few; else joins shuffle it, and split what is skewed."""
    return F.broadcast(df) if rows <= BROADCAST_ROWS else df


def masked(docs: DataFrame):
    """``docs`` under names that clash with none, the new name of each old one, and the way back to the old names."""
    names = docs.columns
    plain = docs.toDF(*[f"__c{i}" for i in range(len(names))])
    new = {name: f"__c{i}" for i, name in enumerate(names)}
    return plain, new, lambda df, *more: df.select(*[F.col(f"__c{i}").alias(n) for i, n in enumerate(names)], *more)


def fresh(names: list[str], wanted: str) -> str:
    """``wanted``, with further underscores in front as long as a column is named so."""
    taken = {n.lower() for n in names}
    while wanted.lower() in taken:
        wanted = "_" + wanted
    return wanted


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def utf8(text: Column) -> Column:
    return F.coalesce(text, F.lit(""))


def or_null(value: Column) -> Column:
    """A value as a string that null has a place of its own among: empty, before all others."""
    return F.when(value.isNull(), F.lit("")).otherwise(F.concat(F.lit("="), value.cast("string")))


def crc_mod(identifier: Column, modulus: int) -> Column:
    """crc32 of the identifier's decimal digits, modulo ``modulus``."""
    return F.crc32(identifier.cast("string").cast("binary")) % F.lit(modulus)


def spread(df: DataFrame, parts: int | None = None) -> int:
    """Number of shuffle partitions that the session asks for."""
    return parts or int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))


def local_env() -> None:
    """One thread for each Python worker: the cores belong to Spark's tasks."""
    os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
    os.environ.setdefault("OMP_NUM_THREADS", "1")


_model: dict = {}


def only(key, make):
    """What ``make`` gives, kept by this worker until another key is asked for: the models of a job's steps don't add up."""
    if key not in _model:
        _model.clear()
        gc.collect()  # a model's parts may refer to each other
        _model[key] = make()
    return _model[key]


def given_back(batches):
    """The batches a task makes; what Arrow holds unused goes back to the system at the end."""
    yield from batches
    gc.collect()
    pa.default_memory_pool().release_unused()


def runs(batches, columns: int, most: int):
    """Record batches cut and joined so that rows with equal first ``columns`` columns, which follow one another, are in one batch.

    A batch has ``most`` bytes or a little more, unless one run has.
    """
    held, size = [], 0
    for batch in batches:
        held.append(batch)
        size += batch.nbytes
        if size < most:
            continue
        table = pa.Table.from_batches(held).combine_chunks()
        last = [table.column(i)[-1].as_py() for i in range(columns)]
        same = np.logical_and.reduce([table.column(i).to_numpy() == last[i] for i in range(columns)])
        start = int(np.flatnonzero(~same)[-1]) + 1 if not same.all() else 0
        if start:
            yield table.slice(0, start)
        rest = table.slice(start).combine_chunks()
        held = rest.to_batches()
        size = rest.nbytes * (len(rest) / max(1, len(table))) if start else 0
    if held:
        yield pa.Table.from_batches(held).combine_chunks()


def running_total(df: DataFrame, order: list[str], weight: str, name: str) -> DataFrame:
    """Add ``name``: the sum of ``weight`` over all rows that come before in ``order``.

    The rows are dealt out by ranges of ``order``, which should tell them apart;
    a range adds up its own rows, and the ranges' totals - one row for each - are
    added up in turn.
    """
    ranged = cut(df.repartitionByRange(spread(df), *order).withColumn("__range", F.spark_partition_id()))
    totals = ranged.groupBy("__range").agg(F.sum(weight).alias("__sum"))
    earlier = Window.orderBy("__range").rowsBetween(Window.unboundedPreceding, -1)
    totals = totals.select("__range", F.coalesce(F.sum("__sum").over(earlier), F.lit(0)).alias("__base"))
    within = Window.partitionBy("__range").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    return (
        ranged.withColumn("__own", F.coalesce(F.sum(weight).over(within), F.lit(0)))
        .join(totals, "__range")
        .withColumn(name, F.col("__own") + F.col("__base"))
        .drop("__range", "__own", "__base")
    )
