"""Centroid clustering of quantised vectors: equal vectors are grouped with their number first, whole-number Lloyd rounds run on the groups.

Every component becomes floor(256 x).  Rounds read each different vector once,
with its multiplicity as weight; distances, sums and means are whole numbers and
exact, so the result doesn't depend on how rows are dealt out.  A task sends one
row for each centroid, so what is shuffled in a round doesn't grow with the rows.
Assignments are joined back to the ids by a sha256 of the quantised vector.
"""

from __future__ import annotations

import hashlib
from functools import reduce

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ._shared import beside, cut

SCALE = 256
WIDTH = 64
MOST = 1 << 27  # distances of 64 components up to this are whole numbers of 64 bits
EXACT = 1 << 53


def quantised(vector: Column, scale: int = SCALE) -> Column:
    """floor(scale * x) of every component; one of a magnitude of ``MOST`` or more stops the job, its distances have no 64 bits."""
    level = lambda x: F.floor(x.cast("double") * scale)
    far = F.raise_error(F.lit(f"a quantised component isn't below {MOST}")).cast("int")
    return F.transform(vector, lambda x: F.when(F.abs(x.cast("double") * scale) < MOST - 1, level(x).cast("int")).otherwise(far))


def usable(vector: Column, width: int = WIDTH) -> Column:
    """Exactly ``width`` components, none null, infinite or not a number."""
    good = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x.cast("double")) & (F.abs(x.cast("double")) < float("inf")))
    return F.coalesce((F.size(vector) == width) & good, F.lit(False))


def name_of(vector: Column) -> Column:
    return F.sha2(F.concat_ws(",", vector.cast("array<string>")), 256)


def first_centroids(kept: DataFrame, key: str, clusters: int, seed: int) -> np.ndarray:
    """The vectors whose ids have the smallest hashes, in the order of these; rows that share an id, in the order of their vectors."""
    order = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col(key).cast("string"), F.lit(""))), 256)
    rows = kept.select("__q", order.alias("__h")).orderBy("__h", "__q").limit(clusters).collect()
    return np.array([r["__q"] for r in rows], dtype=np.int64)


def nearest(x: np.ndarray, centroids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(cluster, squared distance) of each row, exactly; ties go to the smaller number."""
    most = max(1, int(np.abs(x).max(initial=0)), int(np.abs(centroids).max(initial=0)))
    if 4 * x.shape[1] * most * most < EXACT:  # all intermediate results are whole numbers that doubles hold
        a, b = x.astype(np.float64), centroids.astype(np.float64)
        d = (b * b).sum(axis=1) - 2 * (a @ b.T) + (a * a).sum(axis=1)[:, None]
    else:
        d = np.stack([((x - c) ** 2).sum(axis=1) for c in centroids], axis=1)
    at = d.argmin(axis=1)
    return at.astype(np.int32), d[np.arange(len(x)), at].astype(np.int64)


def _matrix(column: pa.Array, width: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.int64).reshape(len(column), width)


ROWS = 8192


def _cuts(batches):
    for batch in batches:
        for at in range(0, len(batch), ROWS):
            yield batch.slice(at, ROWS)


def _sums(x: np.ndarray, weight: np.ndarray, at: np.ndarray, k: int) -> np.ndarray:
    """Weighted sums of each cluster's rows as Python's whole numbers, which don't overflow."""
    if int(weight.sum()) * max(1, int(np.abs(x).max(initial=0))) < EXACT:
        hits = np.zeros((len(x), k))
        hits[np.arange(len(x)), at] = weight
        return (hits.T @ x.astype(np.float64)).astype(np.int64).astype(object)
    out = np.zeros((k, x.shape[1]), dtype=object)
    np.add.at(out, at, x.astype(object) * weight.astype(object)[:, None])
    return out


def one_round(groups: DataFrame, centroids: np.ndarray) -> np.ndarray:
    """The centroids after one assignment of all vectors; empty ones stay.

    Sums that have no 64 bits - 2**36 vectors of the greatest magnitude - stop the job.
    """
    k, width = centroids.shape

    def run(batches):
        total, count = np.zeros((k, width), dtype=object), np.zeros(k, dtype=np.int64)
        for batch in _cuts(batches):
            x, weight = _matrix(batch.column(0), width), batch.column(1).to_numpy(zero_copy_only=False)
            at, _ = nearest(x, centroids)
            total += _sums(x, weight, at, k)
            np.add.at(count, at, weight)
        there = np.flatnonzero(count)
        sums = pa.array([total[i].tolist() for i in there], pa.list_(pa.int64()))
        yield pa.RecordBatch.from_arrays([pa.array(there, pa.int32()), pa.array(count[there]), sums], ["cluster", "n", "sums"])

    parts = groups.select("__q", "__n").mapInArrow(run, "cluster int, n bigint, sums array<bigint>")
    totals = parts.groupBy("cluster").agg(F.sum("n").alias("n"), *[F.sum(F.get("sums", F.lit(i))).alias(f"s{i}") for i in range(width)])
    new = centroids.copy()
    for row in totals.collect():  # a row for each centroid at most
        new[row.cluster] = [int(row[f"s{i}"]) // int(row.n) for i in range(width)]
    return new


def cluster(vectors: DataFrame, key: str = "vec_id", vector: str = "embedding", clusters: int = 40, rounds: int = 5, width: int = WIDTH, seed: int = 2) -> DataFrame:
    """(key, cluster, distance, cluster_inertia, inertia, centroid_sha256) of every usable vector.

    Vectors that are null, of another length, or hold null or non-finite
    components have no row.  With fewer vectors than ``clusters`` there are as
    many centroids as vectors; an empty table gives an empty one.  Rows that
    repeat an id or a vector are rows of their own, and count so.
    """
    kept = vectors.filter(usable(F.col(vector), width)).select(F.col(key), quantised(F.col(vector)).alias("__q"))
    # equal vectors meet in the tasks first, so no frequent one is a hot key
    groups = cut(kept.groupBy("__q").agg(F.count("*").alias("__n")))
    centroids = first_centroids(kept, key, clusters, seed)
    out = "__name string, cluster int, distance bigint, __n bigint"
    if not len(centroids):
        empty = vectors.sparkSession.createDataFrame([], "cluster int, distance bigint, cluster_inertia bigint, inertia bigint, centroid_sha256 string")
        return kept.filter(F.lit(False)).select(key).join(empty, F.lit(True))
    for _ in range(rounds):
        centroids = one_round(groups, centroids)

    def assign(batches):
        for batch in _cuts(batches):
            at, d = nearest(_matrix(batch.column(1), width), centroids)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(at), pa.array(d), batch.column(2)], ["__name", "cluster", "distance", "__n"])

    assigned = cut(groups.select(name_of(F.col("__q")).alias("__name"), "__q", "__n").mapInArrow(assign, out))
    inertia = {r.cluster: int(r.d) for r in assigned.groupBy("cluster").agg(F.sum(F.col("distance").cast("decimal(38,0)") * F.col("__n")).alias("d")).collect()}
    whole = sum(inertia.values())
    rows = [(c, d, whole, hashlib.sha256(",".join(map(str, centroids[c].tolist())).encode()).hexdigest()) for c, d in sorted(inertia.items())]
    about = vectors.sparkSession.createDataFrame(pd.DataFrame(rows, columns=["cluster", "cluster_inertia", "inertia", "centroid_sha256"]), "cluster int, cluster_inertia bigint, inertia bigint, centroid_sha256 string")
    return (
        kept.select(key, name_of(F.col("__q")).alias("__name"))
        .join(assigned.select("__name", "cluster", "distance"), "__name")
        .join(beside(about, len(rows)), "cluster")
        .select(key, "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")
    )


def oracle_sql(clusters: int = 40, rounds: int = 5, width: int = WIDTH, seed: int = 2) -> str:
    """DuckDB: the rounds one after another, over every vector instead of groups of equal ones."""
    good = f"len(embedding) = {width} AND len(list_filter(embedding, lambda x: x IS NOT NULL AND isfinite(x))) = {width}"
    start = f"""WITH v AS MATERIALIZED (SELECT row_number() OVER () AS r, vec_id, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)::BIGINT) AS q FROM embeddings WHERE {good}),
l AS MATERIALIZED (SELECT r, unnest(q) AS x, unnest(range({width})) AS i FROM v),
s AS (SELECT q, row_number() OVER (ORDER BY sha256('{seed}:' || vec_id), q) - 1 AS c FROM v),
c0 AS MATERIALIZED (SELECT c, unnest(q) AS x, unnest(range({width})) AS i FROM s WHERE c < {clusters})"""

    def assigned(n: int) -> str:
        return f"""d{n} AS (SELECT r, c, sum((l.x - c{n}.x) * (l.x - c{n}.x))::BIGINT AS d FROM l JOIN c{n} USING (i) GROUP BY r, c),
a{n} AS MATERIALIZED (SELECT r, c, d FROM d{n} QUALIFY row_number() OVER (PARTITION BY r ORDER BY d, c) = 1)"""

    def moved(n: int) -> str:
        return f"""m{n} AS (SELECT c, i, sum(x)::BIGINT AS s, count(*)::BIGINT AS n FROM l JOIN a{n} USING (r) GROUP BY c, i),
c{n + 1} AS MATERIALIZED (SELECT c, i, CASE WHEN n IS NULL THEN x ELSE (s - ((s % n) + n) % n) // n END AS x FROM c{n} LEFT JOIN m{n} USING (c, i))"""

    parts = reduce(lambda out, n: [*out, assigned(n), moved(n)], range(rounds), [start])
    return ",\n".join([*parts, assigned(rounds)]) + f""",
h AS (SELECT c, sha256(string_agg(x::VARCHAR, ',' ORDER BY i)) AS h FROM c{rounds} GROUP BY c),
w AS (SELECT c, sum(d)::BIGINT AS w FROM a{rounds} GROUP BY c)
SELECT vec_id, c::INT AS cluster, d AS distance, w AS cluster_inertia, (SELECT sum(w)::BIGINT FROM w) AS inertia, h AS centroid_sha256
FROM v JOIN a{rounds} USING (r) JOIN w USING (c) JOIN h USING (c)"""
