"""Tar shards split, streamed and written; the commit log; shuffle buffers."""

import gzip
import io
import json
import tarfile

import numpy as np
import pytest
from pyspark.sql import functions as F

from weftline.operators import shuffling
from weftline.sources import archives
from weftline.streaming import commits, file_stream


def _about(n):
    return json.dumps({"n": n}).encode()


def _tar(path, members):
    with tarfile.open(path, "w") as tar:
        for name, data in members:
            info = tarfile.TarInfo(name)
            info.size = len(data)
            tar.addfile(info, io.BytesIO(data))


def _content(samples):
    return sorted((r.key, bytes(r.media), r.json) for r in samples.filter("fault is null").collect())


def test_one_archive_is_read_by_several_tasks(spark, tmp_path):
    long = "long/" + "n" * 150  # a name with a header of its own
    members = [(f"{long}{i}.{e}", bytes([i % 256]) * (1 + i % 700) if e == "jpg" else _about(i)) for i in range(300) for e in ("jpg", "json")]
    _tar(tmp_path / "a.tar", members)
    want = sorted((f"{long}{i}", bytes([i % 256]) * (1 + i % 700), _about(i).decode()) for i in range(300))
    index = archives.index_tar_shards(spark, str(tmp_path), 20_000).orderBy("start").collect()
    assert len(index) > 10 and index[0].start == 0 and all(a.end == b.start for a, b in zip(index, index[1:]))
    samples = archives.read_tar_shards(spark, str(tmp_path), range_bytes=20_000)
    parts = {r.p for r in samples.select(F.spark_partition_id().alias("p")).collect()}
    assert len(parts) == len(index)
    assert _content(samples) == want and samples.count() == 300
    assert _content(archives.read_tar_shards(spark, str(tmp_path))) == want


def test_archives_that_break_off(spark, tmp_path):
    _tar(tmp_path / "whole.tar", [(f"{i}.{e}", b"x" * 900 if e == "jpg" else _about(i)) for i in range(40) for e in ("jpg", "json")])
    raw = (tmp_path / "whole.tar").read_bytes()
    (tmp_path / "whole.tar").unlink()
    size = 3 * 512 + 1024  # of a sample: two headers, two blocks of media, one of JSON
    (tmp_path / "cut.tar").write_bytes(raw[: 20 * size + 700])  # within the media of the 21st sample
    (tmp_path / "bad.tar").write_bytes(raw[: 10 * size] + b"?" * 512 + raw[10 * size + 512 :])
    (tmp_path / "packed.tar.gz").write_bytes(gzip.compress(raw))
    (tmp_path / "torn.tar.gz").write_bytes(gzip.compress(raw)[:300])
    (tmp_path / "none.tar").write_bytes(b"")
    for range_bytes in (5_000, 1 << 30):
        samples = archives.read_tar_shards(spark, str(tmp_path), range_bytes=range_bytes)
        sound = {r.shard: r.n for r in samples.filter("fault is null").groupBy("shard").agg(F.count("*").alias("n")).collect()}
        assert {k: sound.get(k) for k in ("cut.tar", "bad.tar", "packed.tar.gz")} == {"cut.tar": 20, "bad.tar": 10, "packed.tar.gz": 40}
        found = {r.shard: r.n_faults for r in archives.faults(samples).collect()}
        assert set(found) == {"cut.tar", "bad.tar", "torn.tar.gz"}


def test_repeated_names_are_samples_of_their_own(spark, tmp_path):
    _tar(tmp_path / "a.tar", [("1.jpg", b"a"), ("1.json", _about(1)), ("1.jpg", b"b"), ("1.json", _about(2))])
    assert _content(archives.read_tar_shards(spark, str(tmp_path))) == [("1", b"a", '{"n": 1}'), ("1", b"b", '{"n": 2}')]


def test_writing_and_streaming_of_shards(spark, tmp_path):
    rows = spark.range(200).select(F.col("id").cast("string").alias("key"), F.expr("cast(repeat('é', int(id)) as binary)").alias("media"), F.to_json(F.struct("id")).alias("json"))
    folder, out = f"{tmp_path}/shards", f"{tmp_path}/out"
    schema = "key string, n int"
    stream = lambda: archives.stream_tar_shards(spark, folder, "txt", 10_000).filter("fault is null").select("key", F.octet_length("media").alias("n"))
    sink = commits.CommittedBatches(out)
    for k in range(3):
        archives.write_tar_shards(rows.filter(F.col("id") % 3 == k).repartition(2), folder, "txt", shard_bytes=20_000)
        commits.run_committed(stream(), sink, f"{tmp_path}/checkpoint")
        commits.run_committed(stream(), sink, f"{tmp_path}/checkpoint")  # nothing new: no batch
        assert commits.read_committed(spark, out, schema).count() == rows.filter(F.col("id") % 3 <= k).count()
    assert sorted(map(tuple, commits.read_committed(spark, out, schema).collect())) == sorted((str(i), 2 * i) for i in range(200))
    assert commits.commits(spark, out).count() == 3
    assert not list((tmp_path / "shards/_staged").iterdir()) and len(list((tmp_path / "shards").glob("*.tar"))) > 6
    archives.write_tar_shards(rows.limit(1), folder, "txt", mode="overwrite")
    assert archives.read_tar_shards(spark, folder, "txt").count() == 1


def test_a_failed_write_leaves_no_archive(spark, tmp_path):
    rows = spark.range(10).select(F.col("id").cast("string").alias("key"), F.when(F.col("id") == 7, F.raise_error(F.lit("no"))).otherwise("x").cast("binary").alias("media"), F.lit("{}").alias("json"))
    with pytest.raises(Exception, match="no"):
        archives.write_tar_shards(rows, f"{tmp_path}/s", "txt")
    assert not list((tmp_path / "s").glob("*.tar"))


def test_killed_between_batches_and_resumed(spark, tmp_path):
    events = spark.read.parquet("/root/testdata/sf0.001/events.parquet").select("event_id", "user_id", "value")
    events.repartition(6).write.parquet(f"{tmp_path}/in")
    stream = lambda: file_stream(spark, f"{tmp_path}/in", events.schema, "*.parquet", 2)
    seen = []

    def fall(batch):
        seen.append(batch)
        if seen.count(batch) == 1 and batch > 0:
            raise RuntimeError("killed before the commit")

    sink, out = commits.CommittedBatches(f"{tmp_path}/out", fall), f"{tmp_path}/out"
    for done in (1, 2):
        with pytest.raises(Exception, match="killed"):
            commits.run_committed(stream(), sink, f"{tmp_path}/checkpoint")
        assert commits.commits(spark, out).count() == done
        assert len(commits.abandoned(spark, out)) == done
    commits.run_committed(stream(), sink, f"{tmp_path}/checkpoint")
    assert seen == [0, 1, 1, 2, 2]
    sink(events, 2)  # run a second time: it is there already
    read = commits.read_committed(spark, out, events.schema)
    assert read.exceptAll(events).count() == 0 and events.exceptAll(read).count() == 0
    assert commits.read_committed(spark, f"{tmp_path}/none", "a int").count() == 0


def _plain_shuffle(rows, size, seed):
    """A stream reader's buffer, row by row."""
    rng = np.random.default_rng(seed)

    def draws():
        while True:
            yield from (int(i) for i in rng.integers(0, size, size=1000))

    picks, held = draws(), []
    for x in rows:
        if len(held) == size:
            i = next(picks)
            yield held[i]
            held[i] = x
        else:
            held.append(x)
    rng.shuffle(held)
    yield from held


@pytest.mark.parametrize("size", [1, 7, 64, 5000])
def test_buffered_shuffle(spark, size):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("source", "doc_id", "lang")
    more = spark.range(2500).select(F.lit("big").alias("source"), "id", F.lit(None).cast("string").alias("lang"))
    df = docs.union(more).union(spark.createDataFrame([(None, 3, "x"), (None, 1, "y")], docs.schema))
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 300)
    try:
        got = shuffling.buffered_shuffle(df, ["source"], ["doc_id"], size).collect()
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    by = {}
    for r in df.collect():
        by.setdefault(r.source, []).append((r.doc_id, r.lang))
    for source, rows in by.items():
        mine = sorted((r for r in got if r.source == source), key=lambda r: r.position)
        assert [r.position for r in mine] == list(range(len(rows)))
        assert [(r.doc_id, r.lang) for r in mine] == list(_plain_shuffle(sorted(rows, key=str if source is None else lambda t: t[0]), size, 42))


def test_buffered_shuffle_of_shards_and_of_nothing(spark):
    df = shuffling.sharded(spark.range(900), "id", 4)
    got = shuffling.buffered_shuffle(df, ["shard"], ["id"], 50)
    assert {r.id for r in got.collect()} == set(range(900)) and got.filter("position = 0").count() == 4
    assert shuffling.buffered_shuffle(df.limit(0), ["shard"], ["id"], 50).count() == 0
