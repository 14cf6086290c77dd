"""A folder of micro-batches with a commit log: a batch that runs twice is there once.

A batch's rows are written to a folder of their own attempt.  Then one small
file, named by the batch, names that folder: this is the commit, and the only
step that has to be atomic; folders are never renamed.  Readers see the folders that the log names;
what a killed attempt left behind is in none of them.
"""

from __future__ import annotations

import uuid

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


def _path(spark: SparkSession, path: str):
    place = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), place


class CommittedBatches:
    """For ``foreachBatch``, or for numbered batches of a job that resumes.

    ``before_commit``: called with the batch's number when its rows are written
    and not yet committed; tests break off there.
    """

    def __init__(self, folder: str, before_commit=None):
        self.folder, self.before_commit = folder.rstrip("/"), before_commit

    def committed(self, spark: SparkSession, batch: int) -> bool:
        fs, mark = _path(spark, f"{self.folder}/_commits/{batch}")
        return fs.exists(mark)

    def __call__(self, rows: DataFrame, batch: int) -> None:
        spark = rows.sparkSession
        if self.committed(spark, batch):
            return
        name = f"batch-{batch}-{uuid.uuid4().hex}"
        rows.write.parquet(f"{self.folder}/data/{name}")
        if self.before_commit is not None:
            self.before_commit(batch)
        fs, mark = _path(spark, f"{self.folder}/_commits/{batch}")
        # written aside and renamed: a mark is there whole or not at all.  Of two writers at once the first
        # one's stays, where renaming refuses a target that exists, as HDFS does
        _, aside = _path(spark, f"{self.folder}/_commits/_{name}")
        out = fs.create(aside, False)
        out.write(bytearray(name.encode()))
        out.close()
        if fs.exists(mark) or not fs.rename(aside, mark):
            fs.delete(aside, False)
            if not fs.exists(mark):
                raise OSError(f"batch {batch} couldn't be committed to {self.folder}")


def commits(spark: SparkSession, folder: str) -> DataFrame:
    """(batch, name): the committed batches."""
    schema = T.StructType([T.StructField("value", T.StringType())])
    try:
        marks = spark.read.schema(schema).option("wholetext", True).text(f"{folder.rstrip('/')}/_commits")
    except AnalysisException:  # there is no commit yet
        return spark.createDataFrame([], "batch bigint, name string")
    return marks.select(F.element_at(F.split("value", "-"), 2).cast("bigint").alias("batch"), F.col("value").alias("name"))


def read_committed(spark: SparkSession, folder: str, schema: T.StructType | str) -> DataFrame:
    """The rows of all committed batches, and no others; empty if there is none."""
    names = [r.name for r in commits(spark, folder).orderBy("batch").collect()]  # one for each batch
    places = [f"{folder.rstrip('/')}/data/{n}" for n in names]
    return spark.read.schema(schema).parquet(*places) if places else spark.createDataFrame([], schema)


def abandoned(spark: SparkSession, folder: str) -> list[str]:
    """Folders of attempts that weren't committed; once no job writes, they can go."""
    fs, top = _path(spark, f"{folder.rstrip('/')}/data")
    there = {f.getPath().getName() for f in fs.listStatus(top)} if fs.exists(top) else set()
    return sorted(there - {r.name for r in commits(spark, folder).collect()})


def run_committed(stream: DataFrame, sink: CommittedBatches, checkpoint: str) -> None:
    """Process what there is and stop; a restart with the same checkpoint and folder goes on after the last committed batch."""
    stream.writeStream.foreachBatch(sink).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()
