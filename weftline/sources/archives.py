"""Tar shards of samples: a data source that splits archives, streams new ones, and writes them.

Members that share a name without its ending, and follow one another, are one
sample.  Headers are walked first, by seeking over contents, an archive a task;
what this gives is a row for each byte range of about ``range_bytes``, cut
between samples.  Each range is then a partition of its own, read from front to
back with one sample in memory, so a large archive is as many tasks as it has
ranges, and archives of any size can be read.
"""

from __future__ import annotations

import bisect
import io
import json
import lzma
import tarfile
import time
import uuid
import zlib
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass

import pyarrow as pa
import pyarrow.dataset
import pyarrow.fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, DataSourceStreamReader, InputPartition, WriterCommitMessage

from ..streaming import shared_folder

RANGE_BYTES = 64 << 20
SHARD_BYTES = 256 << 20
BATCH_BYTES = 16 << 20
BLOCK = 512
SCHEMA = "shard string, key string, media binary, json string, fault string"
BROKEN = (tarfile.TarError, EOFError, OSError, zlib.error, lzma.LZMAError)
INDEX = "path string, start bigint, end bigint, packed boolean, fault string"
_PACKED = (b"\x1f\x8b", b"BZh", b"\xfd7zXZ\x00", b"\x28\xb5\x2f\xfd")  # gzip, bzip2, xz, zstandard: fixed values


def _place(path: str) -> tuple[pa.fs.FileSystem, str]:
    """The file system of a path and the path within it."""
    if path.startswith("file:") and not path.startswith("file://"):
        path = "file://" + path.removeprefix("file:")
    return pa.fs.FileSystem.from_uri(path) if "://" in path else (pa.fs.LocalFileSystem(), path)


def _stem(name: str) -> tuple[str, str]:
    """A member's sample and its ending, in lower case."""
    folder, _, last = name.rpartition("/")
    stem, _, ending = last.partition(".")
    return (f"{folder}/{stem}" if folder else stem), ending.lower()


# --- headers -------------------------------------------------------------------


def _ranges(path: str, range_bytes: int):
    """(path, start, end, packed, fault) of the ranges of an archive; a packed one is one range, an unreadable rest one with a fault."""
    fs, within = _place(path)
    start = end = size = 0
    try:
        size = fs.get_file_info(within).size or 0
        if not size:
            return  # scans of files leave empty ones out
        with fs.open_input_file(within) as file:
            if file.read(6).startswith(_PACKED):
                yield path, 0, size, True, None
                return
            file.seek(0)
            with tarfile.open(fileobj=file, mode="r:") as tar:
                stem = None
                while (member := tar.next()) is not None:
                    tar.members.clear()  # else all headers of the archive are kept
                    if member.offset_data + (member.size if member.isfile() else 0) > size:
                        raise tarfile.ReadError("unexpected end of data")
                    now = _stem(member.name)[0] if member.isfile() else stem
                    if now != stem and member.offset - start >= range_bytes:
                        yield path, start, member.offset, False, None
                        start = member.offset
                    stem, end = now, tar.offset
                file.seek(end)
                if file.read(BLOCK).strip(b"\0"):
                    raise tarfile.ReadError("bad header")
    except BROKEN as error:
        if start < end <= size:
            yield path, start, end, False, None
        yield path, max(start, min(end, size)), size, False, f"unreadable archive: {error}"
        return
    if start < end:
        yield path, start, end, False, None


def index_tar_shards(spark: SparkSession, path: str, range_bytes: int = RANGE_BYTES) -> DataFrame:
    """(path, start, end, packed, fault): the byte ranges of the archives under a path or pattern."""

    def run(batches):
        for batch in batches:
            for path in batch.column(0).to_pylist():
                rows = list(_ranges(path, range_bytes))  # one for each range of an archive
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), (pa.string(), pa.int64(), pa.int64(), pa.bool_(), pa.string()))], ["path", "start", "end", "packed", "fault"])

    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.tar*").load(path)
    return files.select("path").mapInArrow(run, INDEX)


# --- contents ------------------------------------------------------------------


@dataclass
class TarRange(InputPartition):
    path: str
    start: int
    end: int
    packed: bool
    fault: str | None


class _Window:
    """The bytes of a file from its place on, up to an end."""

    def __init__(self, file, n: int):
        self.file, self.left = file, n

    def read(self, n: int = -1) -> bytes:
        data = self.file.read(self.left if n < 0 else min(n, self.left))
        self.left -= len(data)
        return data


def _row(shard: str, key: str, parts: dict[str, bytes], media: str) -> tuple:
    missing = [e for e in (media, "json") if e not in parts]
    fault = f"without {', '.join(missing)}" if missing else None
    if not fault:
        try:
            json.loads(parts["json"])
        except ValueError as error:
            fault = f"json: {error}"
    return (shard, key, None, None, fault) if fault else (shard, key, parts[media], parts["json"].decode("utf-8", "replace"), None)


def _samples(part: TarRange, media: str):
    """Rows of the samples that begin and end within a range; members of other endings are passed over."""
    shard = part.path.rpartition("/")[2]
    if part.fault:
        yield shard, shard, None, None, part.fault
        return
    key, held = None, {}
    try:
        fs, within = _place(part.path)
        with fs.open_input_file(within) as file:
            file.seek(part.start)
            window = _Window(file, part.end - part.start)
            with tarfile.open(fileobj=window, mode="r|*" if part.packed else "r|", bufsize=1 << 20) as tar:
                while (member := tar.next()) is not None:
                    tar.members.clear()
                    if not member.isfile():
                        continue
                    stem, ending = _stem(member.name)
                    if ending not in (media, "json"):
                        continue
                    if held and (stem != key or ending in held):  # a repeated name begins a sample of its own
                        yield _row(shard, key, held, media)
                        held = {}
                    key = stem
                    held[ending] = tar.extractfile(member).read()
    except BROKEN as error:
        yield shard, shard, None, None, f"unreadable archive: {error}"
    if held:
        yield _row(shard, key, held, media)


def _batches(rows):
    held, size = [], 0
    kinds = (pa.string(), pa.string(), pa.binary(), pa.string(), pa.string())
    names = ["shard", "key", "media", "json", "fault"]
    for row in rows:
        held.append(row)
        size += 64 + len(row[2] or b"") + len(row[3] or "")
        if size >= BATCH_BYTES:
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*held), kinds)], names)
            held, size = [], 0
    if held:
        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*held), kinds)], names)


def _archives(folder: str) -> list[tuple[int, str, str]]:
    """(time, name, path) of a folder's archives, in order."""
    fs, within = _place(folder)
    found = fs.get_file_info(pa.fs.FileSelector(within, allow_not_found=True))
    top = folder.rstrip("/")
    return sorted((f.mtime_ns or 0, f.base_name, f"{top}/{f.base_name}") for f in found if f.is_file and ".tar" in f.base_name and not f.base_name.startswith(("_", ".")))


def _walked(paths: list[str], range_bytes: int) -> list[TarRange]:
    with ThreadPoolExecutor(16) as pool:
        return [TarRange(*r) for rows in pool.map(lambda p: list(_ranges(p, range_bytes)), paths) for r in rows]


class TarReader(DataSourceReader):
    def __init__(self, options):
        self.path, self.index, self.media = options.get("path"), options.get("index"), options.get("media", "jpg")
        self.range_bytes = int(options.get("range_bytes", RANGE_BYTES))

    def partitions(self):
        if not self.index:
            return _walked([p for *_, p in _archives(self.path)], self.range_bytes)
        fs, within = _place(self.index)
        ranges = pyarrow.dataset.dataset(within, filesystem=fs, format="parquet", exclude_invalid_files=True)
        return [TarRange(**r) for batch in ranges.to_batches() for r in batch.to_pylist()]

    def read(self, partition):
        if partition is not None:
            yield from _batches(_samples(partition, self.media))


class TarStream(DataSourceStreamReader):
    """Archives by time and name: a batch has those after the last offset, split into ranges as in a scan.

    ``settle``: seconds for which a new archive is left, so that one of the same
    moment that shows up later isn't passed by; writers should rename whole
    archives into the folder, as ``TarWriter`` does.
    """

    def __init__(self, options):
        self.path, self.media = options.get("path"), options.get("media", "jpg")
        self.range_bytes, self.settle = int(options.get("range_bytes", RANGE_BYTES)), float(options.get("settle", 0))

    def initialOffset(self):
        return {"time": 0, "name": ""}

    def latestOffset(self):
        upto = time.time_ns() - int(self.settle * 1e9)
        there = [a for a in _archives(self.path) if not self.settle or a[0] <= upto]
        return {"time": there[-1][0], "name": there[-1][1]} if there else self.initialOffset()

    def partitions(self, start, end):
        all_ = _archives(self.path)
        at = [(o["time"], o["name"], "\U0010ffff") for o in (start, end)]
        return _walked([p for *_, p in all_[bisect.bisect_right(all_, at[0]) : bisect.bisect_right(all_, at[1])]], self.range_bytes)

    def read(self, partition):
        if partition is not None:
            yield from _batches(_samples(partition, self.media))


# --- writing -------------------------------------------------------------------


@dataclass
class TarWritten(WriterCommitMessage):
    names: list[str]
    folder: str


class TarWriter(DataSourceArrowWriter):
    """Rows (key, media, json) as archives; what is null has no member.  A task's archives are renamed into the folder when all tasks are done."""

    def __init__(self, options, schema, overwrite):
        self.path, self.media, self.overwrite = options["path"], options.get("media", "jpg"), overwrite
        self.shard_bytes = int(options.get("shard_bytes", SHARD_BYTES))
        self.at = [schema.fieldNames().index(c) for c in ("key", "media", "json")]

    def write(self, iterator):
        fs, top = _place(self.path)
        attempt = uuid.uuid4().hex
        folder, names, tar, out = f"{top}/_staged/{attempt}", [], None, None
        fs.create_dir(folder, recursive=True)

        def close():
            if tar is not None:
                tar.close()
                out.close()

        for batch in iterator:
            key, media, about = (batch.column(i) for i in self.at)
            for i in range(len(batch)):
                if tar is None or tar.offset >= self.shard_bytes:
                    close()
                    names.append(f"shard-{TaskContext.get().partitionId():06d}-{len(names):04d}-{attempt[:8]}.tar")
                    out = fs.open_output_stream(f"{folder}/{names[-1]}")
                    tar = tarfile.open(fileobj=out, mode="w|")
                for ending, column in ((self.media, media), ("json", about)):
                    value = column[i].as_py()
                    if value is not None:
                        data = value.encode() if isinstance(value, str) else value
                        info = tarfile.TarInfo(f"{key[i].as_py()}.{ending}")
                        info.size = len(data)
                        tar.addfile(info, io.BytesIO(data))
                        tar.members.clear()
        close()
        return TarWritten(names, folder)

    def commit(self, messages):
        fs, top = _place(self.path)
        old = [_place(p)[1] for *_, p in _archives(self.path)] if self.overwrite else []
        for message in filter(None, messages):
            for name in message.names:
                fs.move(f"{message.folder}/{name}", f"{top}/{name}")
            fs.delete_dir(message.folder)
        for path in old:
            fs.delete_file(path)

    def abort(self, messages):
        fs, _ = _place(self.path)
        for message in filter(None, messages):
            fs.delete_dir(message.folder)


class TarShards(DataSource):
    """``format("tar_shards")``: options ``path``, ``media`` (ending, jpg), ``range_bytes``, ``index`` (see ``index_tar_shards``), ``settle``, ``shard_bytes``."""

    @classmethod
    def name(cls) -> str:
        return "tar_shards"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema):
        return TarReader(self.options)

    def streamReader(self, schema):
        return TarStream(self.options)

    def writer(self, schema, overwrite):
        return TarWriter(self.options, schema, overwrite)


def read_tar_shards(spark: SparkSession, path: str, media: str = "jpg", range_bytes: int = RANGE_BYTES) -> DataFrame:
    """(shard, key, media, json, fault) of every sample of the archives under a path or pattern.

    Samples that lack a part, or whose JSON can't be read, and archives that
    break off, don't end the scan: they come with a ``fault`` and no content, to
    be counted (``faults``) or left out (``sound``).  What an archive has before
    its fault is read.
    """
    spark.dataSource.register(TarShards)
    index = f"{shared_folder(spark)}/tar-index-{uuid.uuid4().hex}"
    index_tar_shards(spark, path, range_bytes).write.parquet(index)
    return spark.read.format("tar_shards").option("index", index).option("media", media).load()


def stream_tar_shards(spark: SparkSession, folder: str, media: str = "jpg", range_bytes: int = RANGE_BYTES, settle: float = 0) -> DataFrame:
    """The same rows, as a stream over the archives of a folder; a restart goes on after the last batch."""
    spark.dataSource.register(TarShards)
    return spark.readStream.format("tar_shards").option("path", folder).option("media", media).option("range_bytes", range_bytes).option("settle", settle).load()


def write_tar_shards(df: DataFrame, folder: str, media: str = "jpg", shard_bytes: int = SHARD_BYTES, mode: str = "append") -> None:
    """Write rows (key, media, json) as archives of about ``shard_bytes``, at least one for each task that has rows."""
    df.sparkSession.dataSource.register(TarShards)
    df.select("key", "media", "json").write.format("tar_shards").mode(mode).option("path", folder).option("media", media).option("shard_bytes", shard_bytes).save()


def sound(samples: DataFrame, schema: str) -> DataFrame:
    """Samples without a fault, their JSON parsed."""
    return samples.filter(F.col("fault").isNull()).select("shard", "key", "media", F.from_json("json", schema).alias("about"))


def faults(samples: DataFrame) -> DataFrame:
    return samples.filter(F.col("fault").isNotNull()).groupBy("shard").agg(F.count("*").alias("n_faults"))
