"""Shuffles of streams through a bounded buffer, exact for a given order and seed."""

from __future__ import annotations

import itertools

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

DRAWS = 1000


class Reservoir:
    """The rows of one stream: a full buffer gives up a drawn row for each new one, the rest comes out shuffled at the end.

    Draws are made ``DRAWS`` at a time, as stream readers of training data do,
    so the order is theirs for the same seed.
    """

    def __init__(self, size: int, seed: int):
        self.size, self.rng = size, np.random.default_rng(seed)
        self.draws = itertools.chain.from_iterable(iter(lambda: self.rng.integers(0, size, size=DRAWS).tolist(), None))
        self.held: pa.Table | None = None

    def push(self, rows: pa.Table) -> pa.Table:
        """Rows that come out when these come in."""
        known = self.held.num_rows if self.held is not None else 0
        table = pa.concat_tables([self.held, rows]) if known else rows
        slots, out = list(range(min(self.size, table.num_rows))), []
        for new in range(len(slots), table.num_rows):
            i = next(self.draws)
            out.append(slots[i])
            slots[i] = new
        # copies: what came out isn't kept alive by what stays
        self.held = table.take(slots).combine_chunks()
        return table.take(pa.array(out, pa.int64()))

    def rest(self) -> pa.Table | None:
        if self.held is None:
            return None
        order = list(range(self.held.num_rows))
        self.rng.shuffle(order)
        return self.held.take(pa.array(order, pa.int64()))


def buffered_shuffle(df: DataFrame, streams: list[str], order: list[str], size: int = 1000, seed: int = 42, name: str = "position") -> DataFrame:
    """Rows of each stream in the order of a buffered shuffle, with ``name``, their new place from 0.

    A stream, named by the columns ``streams``, is what one reader reads in the
    order of ``order``; it passes through one task, which holds ``size`` of its
    rows.  Readers of a large source take a shard each: put a shard number
    (``sharded``) into ``streams``, and a stream has a bounded share of it.
    """
    schema = T.StructType([*df.schema.fields, T.StructField(name, T.LongType())])
    # column types as Arrow gives them to the task and takes them back
    wanted = to_arrow_schema(schema)
    keys = [df.columns.index(c) for c in streams]

    def run(batches):
        key, held, place = None, None, 0

        def placed(rows: pa.Table | None):
            nonlocal place
            if rows is None or not rows.num_rows:
                return
            rows = rows.append_column(name, pa.array(range(place, place + rows.num_rows), pa.int64()))
            place += rows.num_rows
            for batch in rows.combine_chunks().to_batches():
                yield pa.RecordBatch.from_arrays([c.cast(f.type) for c, f in zip(batch.columns, wanted)], schema=wanted)

        for batch in batches:
            marks = list(zip(*[batch.column(i).to_pylist() for i in keys])) if keys else [()] * len(batch)
            at = 0
            for mark, run_ in itertools.groupby(marks):
                n = sum(1 for _ in run_)
                if held is None or mark != key:
                    if held is not None:
                        yield from placed(held.rest())
                    key, held, place = mark, Reservoir(size, seed), 0
                yield from placed(held.push(pa.Table.from_batches([batch.slice(at, n)])))
                at += n
        if held is not None:
            yield from placed(held.rest())

    dealt = df.repartition(*streams) if streams else df.coalesce(1)
    return dealt.sortWithinPartitions(*streams, *order).mapInArrow(run, schema)


def sharded(df: DataFrame, key: str, shards: int, name: str = "shard") -> DataFrame:
    """Add a shard number by a hash of the key."""
    return df.withColumn(name, F.pmod(F.crc32(F.col(key).cast("string")), F.lit(shards)).cast("int"))
