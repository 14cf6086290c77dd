"""Queries over archives, streams and sinks that resume (S14, K4, §2.15)."""

from __future__ import annotations

import os

from pyspark.sql import functions as F

from .. import streaming as st
from ..sources import archives as ar
from ..sources.tables import load
from ..streaming import commits as cm
from .catalog import query


def _folder(spark, name: str) -> str:
    return f"{st.shared_folder(spark)}/{name}-{os.urandom(8).hex()}"


def _samples(spark, sf_dir):
    """Documents as samples: the text is the media, the other columns are JSON."""
    d = load(spark, sf_dir, "documents")
    about = F.to_json(F.struct("doc_id", "lang", "source"))
    return d.select(F.format_string("%s/%d", "lang", "doc_id").alias("key"), F.encode(F.col("text"), "utf-8").alias("media"), about.alias("json"))


RANGE = 4 << 20  # of test data; production archives are read in ranges of 64 MB


@query("SELECT doc_id, lang, source, lang || '/' || doc_id AS key, strlen(text) AS n_bytes, md5(text) AS text_md5 FROM documents")
def tar_shards(spark, sf_dir):
    """Documents written as tar shards and read back by byte ranges."""
    folder = _folder(spark, "tar")
    ar.write_tar_shards(_samples(spark, sf_dir), folder, "txt")
    read = ar.sound(ar.read_tar_shards(spark, folder, "txt", RANGE), "doc_id bigint, lang string, source string")
    return read.select("about.*", "key", F.octet_length("media").cast("bigint").alias("n_bytes"), F.md5("media").alias("text_md5"))


@query("""SELECT CASE WHEN doc_id % 5 = 0 THEN 'json' WHEN doc_id % 7 = 0 THEN 'without json' WHEN doc_id % 11 = 0 THEN 'without txt' ELSE 'sound' END AS state, count(*) AS n,
  CAST(sum(CASE WHEN doc_id % 5 = 0 OR doc_id % 7 = 0 OR doc_id % 11 = 0 THEN 0 ELSE strlen(text) END) AS BIGINT) AS n_bytes FROM documents GROUP BY 1""")
def tar_shard_faults(spark, sf_dir):
    """Shards in which some samples have broken JSON or lack a part: these are counted, the others read."""
    folder = _folder(spark, "tar")
    number = F.get_json_object("json", "$.doc_id").cast("bigint")
    broken = F.when(number % 5 == 0, F.expr("left(json, length(json) - 1)")).when(number % 7 != 0, F.col("json"))
    media = F.when((number % 5 == 0) | (number % 7 == 0) | (number % 11 != 0), F.col("media"))
    ar.write_tar_shards(_samples(spark, sf_dir).select("key", media.alias("media"), broken.alias("json")), folder, "txt")
    state = F.coalesce(F.split("fault", ":")[0], F.lit("sound")).alias("state")
    return ar.read_tar_shards(spark, folder, "txt", RANGE).groupBy(state).agg(F.count("*").alias("n"), F.coalesce(F.sum(F.octet_length("media")), F.lit(0)).cast("bigint").alias("n_bytes"))


@query("SELECT lang, count(*) AS n, CAST(sum(strlen(text)) AS BIGINT) AS n_bytes FROM documents GROUP BY lang")
def tar_stream(spark, sf_dir):
    """A stream over a folder of shards that grows between two runs; the second goes on after the first."""
    folder, out = _folder(spark, "tar"), _folder(spark, "tar-stream")
    samples = _samples(spark, sf_dir)
    early = F.crc32("key") % 2 == 0
    sink = cm.CommittedBatches(f"{out}/batches")
    for part in (samples.filter(early), samples.filter(~early)):
        ar.write_tar_shards(part, folder, "txt")
        read = ar.sound(ar.stream_tar_shards(spark, folder, "txt", RANGE), "lang string")
        cm.run_committed(read.select("about.lang", F.octet_length("media").cast("bigint").alias("n_bytes")), sink, f"{out}/checkpoint")
    return cm.read_committed(spark, f"{out}/batches", "lang string, n_bytes bigint").groupBy("lang").agg(F.count("*").alias("n"), F.sum("n_bytes").alias("n_bytes"))


@query("SELECT user_id, count(*) AS n, round(sum(value), 4) AS total, count(DISTINCT event_id) AS n_events FROM events GROUP BY user_id")
def committed_stream(spark, sf_dir):
    """Events through a sink with a commit log, stopped and resumed, with the last batch run a second time."""
    files, out = _folder(spark, "events"), _folder(spark, "committed")
    events = load(spark, sf_dir, "events").select("event_id", "user_id", "value")
    sink = cm.CommittedBatches(f"{out}/batches")
    late = F.crc32(F.col("event_id").cast("string")) % 2 == 1
    for part in (events.filter(~late), events.filter(late)):
        part.repartition(4).write.mode("append").parquet(files)
        cm.run_committed(st.file_stream(spark, files, events.schema, "*.parquet", 2), sink, f"{out}/checkpoint")
    last = cm.commits(spark, f"{out}/batches").agg(F.max("batch")).first()[0]
    sink(events, last)
    return cm.read_committed(spark, f"{out}/batches", events.schema).groupBy("user_id").agg(F.count("*").alias("n"), F.round(F.sum("value"), 4).alias("total"), F.count_distinct("event_id").alias("n_events"))
