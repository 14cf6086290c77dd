"""Near-duplicate vectors by a forest of random-projection trees with spill.

Each tree splits the space along random directions.  A split's threshold is the
median of a bounded sample of the vectors; vectors within ``margin`` of it go
down both sides, so that near pairs are seldom parted, and several trees make
it rarer still.  Every vector - not only the sample - is routed to its leaves.
Leaves that still have more than ``block_rows`` vectors are split further, level
by level, at the median of their own vectors, all such leaves of a tree along
one more random direction, until they have no more or a split no longer makes
them smaller, as in a dense cluster.  So leaves don't grow with the table.
Vectors that share a leaf are compared by cosine in double precision, and those
that reach the threshold are linked.  Vectors of each length have a forest of
their own, but where they are so few that they fit one leaf.

Equal vectors are one class: classes are compared, and their sizes counted, so
copies are never expanded into pairs.  A pair of classes that shares several
leaves is counted in the first of them.  A leaf of more than ``block_rows``
classes is compared block against block, each pair of blocks a task of its own,
so a task's memory has a bound whatever the data are.  What a task returns is a
row for each linked class - links counted, and the least class reachable within
the task - not the pairs.

Rows: vectors that are null, empty, zero, or hold null or non-finite
components link with nothing and are their own component; components of any
finite size are scaled before they are squared; vectors of different lengths
don't link; a null id is its own component, and of equal vectors the least id
names the class; repeated rows are vectors like others, linked with one another;
an empty table gives an empty table; other columns are ignored.  Recall against
brute force is measured in the tests.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._shared import beside, counted, cut
from .simhash import components

SEED = 7


class Forest:
    """Directions and thresholds of complete binary trees."""

    def __init__(self, sample: np.ndarray, depth: int, trees: int, margin: float, seed: int = SEED):
        self.depth, self.trees, self.margin = depth, trees, margin
        width = sample.shape[1]
        rng = np.random.default_rng(seed)
        nodes = (1 << depth) - 1
        self.directions = rng.normal(size=(trees, nodes, width))
        self.directions /= np.linalg.norm(self.directions, axis=2, keepdims=True)
        self.thresholds = np.zeros((trees, nodes))
        for t in range(trees):
            held = {0: np.arange(len(sample))}
            for node in range(nodes):
                rows = held.pop(node, np.zeros(0, int))
                along = sample[rows] @ self.directions[t, node]
                middle = self.thresholds[t, node] = float(np.median(along)) if len(rows) else 0.0
                held[2 * node + 1] = rows[along <= middle + margin]
                held[2 * node + 2] = rows[along > middle - margin]

    def leaves(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(row, leaf) of every leaf that each row reaches, leaves numbered through all trees."""
        rows_out, leaves_out = [], []
        for t in range(self.trees):
            rows, nodes = np.arange(len(x)), np.zeros(len(x), int)
            for _ in range(self.depth):
                along = np.einsum("ij,ij->i", x[rows], self.directions[t, nodes]) - self.thresholds[t, nodes]
                left, right = along <= self.margin, along > -self.margin
                rows, nodes = np.concatenate([rows[left], rows[right]]), np.concatenate([2 * nodes[left] + 1, 2 * nodes[right] + 2])
            rows_out.append(rows)
            leaves_out.append(nodes - ((1 << self.depth) - 1) + (t << self.depth))
        return np.concatenate(rows_out), np.concatenate(leaves_out)


def _unit(column) -> np.ndarray:
    """Vectors of one length, each of length one; scaled first, so that no square overflows or vanishes."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    x = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(column), -1)
    x = x / np.abs(x).max(axis=1, keepdims=True)
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def _classes(vectors: DataFrame) -> DataFrame:
    """(cid, v, w, least, copies): the distinct usable vectors, named by a hash, with their length, least id and number."""
    usable = (
        F.col("v").isNotNull()
        & (F.size("v") > 0)
        & F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
        & F.exists("v", lambda x: x != 0)
    )
    found = vectors.filter(F.coalesce(usable, F.lit(False))).groupBy("v").agg(F.min("vec_id").alias("least"), F.count("*").alias("copies"))
    return found.select(F.xxhash64("v").alias("cid"), "v", F.size("v").alias("w"), "least", "copies")


def _compare(ids, x, copies, leaf, rows_of, leaves, side, least_cosine, block=512):
    """Links of each row and the least row reachable, over the pairs first met in ``leaf``.

    ``rows_of`` and ``leaves`` list all leaves of each row.  ``side`` is 0 or 1
    where two blocks are compared, None where one is with itself.
    """
    n = len(ids)
    earlier = leaves < leaf
    rows_of, leaves = rows_of[earlier], leaves[earlier]
    names, at = np.unique(leaves, return_inverse=True)
    again = np.flatnonzero(np.bincount(at, minlength=len(names)) > 1)  # a leaf of one row is no pair's
    member = np.zeros((n, len(again)), dtype=np.float32)
    place = np.full(len(names), -1)
    place[again] = np.arange(len(again))
    shared = place[at] >= 0
    member[rows_of[shared], place[at][shared]] = 1.0

    def near(a, b):
        close = x[a:b] @ x.T >= least_cosine
        close[np.arange(b - a), np.arange(a, b)] = False
        if side is not None:
            close &= side[a:b, None] != side[None, :]
        if len(again):
            i, j = np.nonzero(close)
            if len(i) > n:
                close &= member[a:b] @ member.T == 0
            elif len(i):
                close[i, j] = np.einsum("ij,ij->i", member[a + i], member[j]) == 0
        return close

    links = np.zeros(n, dtype=np.int64)
    order = np.argsort(ids, kind="stable")
    label = np.empty(n, dtype=np.int64)
    label[order] = np.arange(n)
    touched = []
    for a in range(0, n, block):
        b = min(n, a + block)
        close = near(a, b)
        if close.any():
            touched.append((a, b, close))  # at most (2 * block_rows) ** 2 bits of a byte each
            links[a:b] = close @ copies
    while touched:
        before = label.copy()
        for a, b, close in touched:
            label[a:b] = np.minimum(label[a:b], np.where(close, label[None, :], n).min(axis=1))
        label = np.minimum(label, label[order[label]])
        if (label == before).all():
            break
    return links, ids[order[label]]


def _split_further(routed: DataFrame, margin_of, block_rows: int, most_rounds: int = 40) -> DataFrame:
    """``routed`` (cid, w, v, copies, tree, leaf, leaves), with leaves of at most ``block_rows`` rows but for dense clusters."""
    given, routed = routed, routed.drop("leaves").withColumn("was", F.lit(0).cast("long"))
    element = routed.schema["v"].dataType.simpleString()
    for step in range(most_rounds):
        sizes = routed.groupBy("w", "leaf", "was").agg(F.count("*").alias("n"))
        # a split that leaves four fifths together isn't worth a further one
        full, n_full = counted(sizes.filter((F.col("n") > block_rows) & ((F.col("was") == 0) | (F.col("n") < 0.8 * F.col("was")))).select("w", "leaf", "n"))
        if not n_full:
            break

        def project(batches):
            for batch in batches:
                if not batch.num_rows:
                    continue
                w, tree = batch.column(1).to_numpy(), batch.column(4).to_numpy()
                along, margin = np.zeros(batch.num_rows), np.zeros(batch.num_rows)
                for width in np.unique(w):
                    for t in np.unique(tree[w == width]):
                        rows = np.flatnonzero((w == width) & (tree == t))
                        direction = np.random.default_rng([SEED, step, int(t), int(width)]).normal(size=int(width))
                        along[rows] = _unit(batch.column(2).take(pa.array(rows))) @ (direction / np.linalg.norm(direction))
                        margin[rows] = margin_of(int(width))
                yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(along), pa.array(margin)], [*batch.schema.names, "along", "margin"])

        split = routed.drop("was").join(beside(full, n_full), ["w", "leaf"]).select("cid", "w", "v", "copies", "tree", "leaf", F.col("n").alias("was"))
        split = cut(split.mapInArrow(project, f"cid long, w int, v {element}, copies long, tree int, leaf long, was long, along double, margin double"))
        middle, n_middle = counted(split.groupBy("w", "leaf").agg(F.percentile_approx("along", 0.5, 1000).alias("t")))
        low, high = F.col("along") <= F.col("t") + F.col("margin"), F.col("along") > F.col("t") - F.col("margin")
        sides = F.filter(F.array(F.when(low, F.lit(0)), F.when(high, F.lit(1))), lambda s: s.isNotNull())
        halves = split.join(beside(middle, n_middle), ["w", "leaf"]).withColumn("side", F.explode(sides))
        halves = halves.select("cid", "w", "v", "copies", "tree", F.xxhash64("leaf", "side", F.lit(step)).alias("leaf"), "was")
        rest = routed.join(beside(full.select("w", "leaf"), n_full), ["w", "leaf"], "left_anti").select(*halves.columns)
        routed = cut(rest.unionByName(halves))
    if not step:
        return given
    # leaves of each class anew: as many as its trees and what spilled over
    held = routed.groupBy("cid").agg(F.collect_list("leaf").alias("leaves"))
    return cut(routed.drop("was").join(held, "cid"))


def link_vectors(
    table: DataFrame,
    least_cosine: float = 0.95,
    trees: int = 4,
    leaf_rows: int = 512,
    sample_rows: int = 16_384,
    block_rows: int = 4096,
    id_col: str = "vec_id",
    vector_col: str = "embedding",
) -> DataFrame:
    """(vec_id, n_links, component_id, kept) of every row."""
    vectors = table.select(F.col(id_col).cast("long").alias("vec_id"), F.col(vector_col).alias("v"))
    classes = cut(_classes(vectors))
    # lengths with more vectors than a leaf holds: a forest each
    many = {r.w: r.n for r in classes.groupBy("w").agg(F.count("*").alias("n")).filter(F.col("n") > leaf_rows).collect()}
    share, forests = 1 << 20, {}

    def margin_of(width: int) -> float:
        """Half of a usual difference along a direction, of a pair just at the threshold."""
        return 0.5 * float(np.sqrt(2 * (1 - least_cosine)) / np.sqrt(width))

    for width, n in sorted(many.items()):
        chosen = classes.filter((F.col("w") == width) & (F.pmod("cid", F.lit(share)) < max(1, share * sample_rows // n))).select("cid", "v").toArrow().sort_by("cid")
        depth = 0
        while n / (1 << depth) > leaf_rows and chosen.num_rows / (1 << (depth + 1)) >= 16:
            depth += 1
        sample = _unit(chosen.column(1)) if chosen.num_rows else np.zeros((0, width))
        forests[width] = Forest(sample, depth, trees, margin_of(width))
    forests = table.sparkSession.sparkContext.broadcast(forests)

    def route(batches):
        for batch in batches:
            w = batch.column(2).to_numpy()
            for width in np.unique(w):
                which = np.flatnonzero(w == width)
                forest = forests.value.get(int(width))
                if forest is None:  # few: one leaf for all
                    rows, leaves, tree = np.arange(len(which)), np.zeros(len(which), np.int64), np.zeros(len(which), np.int32)
                else:
                    rows, leaves = forest.leaves(_unit(batch.column(1).take(pa.array(which))))
                    tree = (leaves >> forest.depth).astype(np.int32)
                taken = pa.array(which[rows])
                cid, v, copies = (batch.column(i).take(taken) for i in (0, 1, 3))
                leaves = leaves.astype(np.int64)
                ends = np.concatenate([[0], np.cumsum(np.bincount(rows, minlength=len(which)))]).astype(np.int32)
                every = pa.ListArray.from_arrays(pa.array(ends), pa.array(leaves[np.argsort(rows, kind="stable")])).take(pa.array(rows))
                yield pa.RecordBatch.from_arrays([cid, pa.array(np.full(len(rows), width, np.int32)), v, copies, pa.array(tree), pa.array(leaves), every], ["cid", "w", "v", "copies", "tree", "leaf", "leaves"])

    element = classes.schema["v"].dataType.simpleString()
    routed = classes.select("cid", "v", "w", "copies").mapInArrow(route, f"cid long, w int, v {element}, copies long, tree int, leaf long, leaves array<bigint>")
    routed = _split_further(cut(routed), margin_of, block_rows)
    blocks, n_blocks = counted(routed.groupBy("w", "leaf").agg(F.count("*").alias("n")).filter("n > 1").select("w", "leaf", F.ceil(F.col("n") / block_rows).cast("int").alias("nb")))
    dealt = (
        routed.join(beside(blocks, n_blocks), ["w", "leaf"])
        .withColumn("b", F.pmod(F.xxhash64("cid"), F.col("nb")).cast("int"))
        .withColumn("o", F.explode(F.sequence(F.lit(0), F.col("nb") - 1)))
        .select("w", "leaf", F.least("b", "o").alias("lo"), F.greatest("b", "o").alias("hi"), "b", "cid", "v", "copies", "leaves")
    )

    def compare(group: pa.Table) -> pa.Table:
        leaf, lo, hi = (group.column(c)[0].as_py() for c in ("leaf", "lo", "hi"))
        ids = group.column("cid").to_numpy()
        side = None if lo == hi else group.column("b").to_numpy()
        leaves = group.column("leaves").combine_chunks()
        rows_of = np.repeat(np.arange(len(ids)), leaves.value_lengths().to_numpy())
        links, root = _compare(ids, _unit(group.column("v")), group.column("copies").to_numpy(), leaf, rows_of, leaves.flatten().to_numpy(), side, least_cosine)
        found = (links > 0) | (root != ids)
        return pa.table({"cid": ids[found], "links": links[found], "root": root[found]})

    met = cut(dealt.groupBy("w", "leaf", "lo", "hi").applyInArrow(compare, "cid long, links long, root long"))
    counts = met.groupBy("cid").agg(F.sum("links").alias("links"))
    roots = components(met.select(F.col("root").alias("a"), F.col("cid").alias("b")).filter("a <> b"))
    linked = cut(
        classes.join(counts, "cid", "left")
        .join(roots, F.col("cid") == F.col("node"), "left")
        .filter("copies > 1 or links > 0")
        .select("cid", "v", "least", (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n"), F.coalesce("root", "cid").alias("root"))
    )
    smallest, n_smallest = counted(linked.groupBy("root").agg(F.min("least").alias("c")))
    # rows find their class by a hash of the vector, then the vector itself
    about = linked.join(beside(smallest, n_smallest), "root").select(F.col("cid").alias("h_"), F.col("v").alias("v_"), "n", "c")
    whole = vectors.withColumn("h", F.xxhash64("v")).join(about, (F.col("h") == F.col("h_")) & (F.col("v") == F.col("v_")), "left")
    component = F.coalesce("c", "vec_id")
    return whole.select(
        "vec_id", F.coalesce("n", F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"), F.coalesce(F.col("vec_id") == component, F.lit(True)).alias("kept")
    )
