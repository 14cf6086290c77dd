"""Scans: tables, JSON in its shapes, files with their origin, registries of named sets."""

from __future__ import annotations

import uuid
from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..operators.ordered import positions


def load(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def spread(df: DataFrame) -> DataFrame:
    """A table read in fewer splits than there are cores, dealt to all of them; a larger one as it is.

    For work within the row that takes long: a file of one row group is one task.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() < cores else df


def require(df: DataFrame, *columns: str) -> DataFrame:
    missing = [c for c in columns if c not in df.columns]
    if missing:
        raise ValueError(f"missing columns: {', '.join(missing)}")
    return df


RECORD = T.StructType([T.StructField("id", T.LongType()), T.StructField("text", T.StringType())])


def read_records(spark: SparkSession, path: str, schema: T.StructType = RECORD, bad: str = "PERMISSIVE") -> DataFrame:
    """JSON lines with an explicit schema; blank lines are skipped, bad ones handled as ``bad`` says."""
    return require(spark.read.schema(schema).option("mode", bad).json(path), "id", "text")


def labelled_union(parts: list[tuple[DataFrame, int, str]], id_col: str = "id") -> DataFrame:
    """Parts with their label and source, and ``row_id``, the position by source and id, a number.

    The position is computed within slots of each source and shifted by the
    sizes of what is before, so that no task has to order a source.
    """
    united = reduce(DataFrame.unionByName, [df.withColumn("label", F.lit(label)).withColumn("source", F.lit(source)) for df, label, source in parts])
    sizes = united.groupBy("source").agg(F.count("*").alias("__n"))  # a row for each part
    before = sizes.select("source", F.coalesce(F.sum("__n").over(Window.orderBy("source").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("__before"))
    placed = positions(united, ["source"], id_col, "__r")
    return placed.join(F.broadcast(before), "source").withColumn("row_id", F.col("__r") + F.col("__before")).drop("__r", "__before")


def read_parquet_with_origin(spark: SparkSession, path: str) -> DataFrame:
    """A file, folder or pattern of Parquet, with the name of the file each row is from."""
    return spark.read.parquet(path).withColumn("_source_file", F.element_at(F.split(F.col("_metadata.file_path"), "/"), -1))


def read_csv(spark: SparkSession, path: str, schema: T.StructType | str) -> DataFrame:
    return spark.read.option("header", True).schema(schema).csv(path)


def read_json_array(spark: SparkSession, path: str, schema: T.StructType | str) -> DataFrame:
    """A file that holds one array of objects."""
    return spark.read.option("multiLine", True).schema(schema).json(path)


def read_json_map(spark: SparkSession, path: str, value: str) -> DataFrame:
    """A file that holds one object of objects: a row (key, value) for each."""
    whole = spark.read.option("wholetext", True).text(path)
    return whole.select(F.explode(F.from_json("value", f"map<string,{value}>")).alias("key", "value"))


def read_or_make(spark: SparkSession, path: str, make: Callable[[], DataFrame]) -> DataFrame:
    """Rows of ``path`` if they were written there whole, else those of ``make``, written first.

    Rows go to a folder of their own attempt beside the path, which is renamed
    when it is whole and bears Spark's mark of success.  A folder without the
    mark, as an older job may have left it, is made anew.  Of two writers the
    first to rename wins; the other one's rows are deleted, and both read the
    same.
    """
    jvm = spark.sparkContext._jvm
    place = jvm.org.apache.hadoop.fs.Path(path.rstrip("/"))
    fs = place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    whole = lambda at: fs.exists(jvm.org.apache.hadoop.fs.Path(at, "_SUCCESS"))
    if not whole(place):
        attempt = jvm.org.apache.hadoop.fs.Path(place.getParent(), f"_{place.getName()}-{uuid.uuid4().hex}")
        try:
            make().write.parquet(attempt.toString())
            if not whole(attempt):
                raise OSError(f"{attempt.toString()} bears no mark of success")
            if fs.exists(place) and not whole(place):
                fs.delete(place, True)
            # where a folder is there by now, renaming into it would nest this one
            if not whole(place) and not fs.rename(attempt, place) and not whole(place):
                raise OSError(f"couldn't rename to {path}")
        finally:
            fs.delete(attempt, True)
    return spark.read.parquet(path)


class Registry:
    """Named data sets, built when asked for, joined into one by name."""

    def __init__(self):
        self._makers: dict[str, Callable[[], DataFrame]] = {}

    def add(self, name: str, make: Callable[[], DataFrame]) -> None:
        self._makers[name] = make

    def build(self, names: str) -> DataFrame:
        wanted = [n.strip() for n in names.split(",") if n.strip()]
        unknown = [n for n in wanted if n not in self._makers]
        if unknown or not wanted:
            raise KeyError(f"unknown data sets: {unknown}" if unknown else "no data set named")
        return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), [self._makers[n]() for n in wanted])


def pick_column(columns: list[str], names: list[str], parts: list[str] = ()) -> str | None:
    """The first column whose plain name is one of ``names``, else one that contains one of ``parts``."""
    plain = {c: c.strip().lower().replace("-", "_").replace(" ", "_") for c in columns}
    exact = (c for n in names for c in columns if plain[c] == n)
    loose = (c for p in parts for c in columns if p in plain[c])
    return next(exact, next(loose, None))


def feature_columns(columns: list[str], without: list[str] = (), starts: list[str] = ()) -> list[str]:
    """The columns that aren't named in ``without`` and, if ``starts`` is given, begin with one of it, in order."""
    left = set(without)
    return [c for c in columns if c not in left and (not starts or c.startswith(tuple(starts)))]


def key_union(df: DataFrame, objects: str, *keys: str) -> DataFrame:
    """(keys, names): all field names of the JSON objects of a column, in order."""
    names = df.select(*keys, F.explode(F.json_object_keys(objects)).alias("__name")).distinct()
    return names.groupBy(*keys).agg(F.sort_array(F.collect_list("__name")).alias("names"))


def normalise_channels(array: Column, means: list[float], stds: list[float], scale: float = 1.0) -> Column:
    """Scale an interleaved array and standardise it by channel."""
    k = len(means)
    m, s = F.array(*map(F.lit, means)), F.array(*map(F.lit, stds))
    return F.transform(array, lambda x, i: (x * scale - F.get(m, i % k)) / F.get(s, i % k))
