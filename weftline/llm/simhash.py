"""SimHash near-duplicates found with a pivot distance table.

Fingerprints
    A-Z become a-z; words are runs of bytes other than the six ASCII white
    space characters; each window of three words, joined by one space, is
    hashed by XXH64 (seed 42).  Bit *i* of the fingerprint is one if it is one
    in more than half of the hashes.  A text of one or two words has itself as
    its only window; a text without words (or null) has fingerprint zero, which
    links like any other.

Links
    Two fingerprints link if they differ in at most ``radius`` (2) bits.

Search
    Each distinct fingerprint has a row of distances to reference fingerprints
    (the pivots), which are the rows of a Hadamard matrix: they are 32 bits
    apart, so the coordinates are uncorrelated.  By the triangle inequality no
    coordinate of a linked pair differs by more than ``radius``, and there is a
    whole number at most 1 from both.  So a pivot's distances are cut in two at
    their median, fingerprints within 1 of the cut go to both sides, and a
    linked pair meets in some cell of any number of such cuts.  As many pivots
    cut as it takes for cells to hold ``crowd`` fingerprints at most if they
    were spread as the single coordinates are; the table's counts, 65 for each
    pivot, decide which.  Within a cell, pairs whose rows differ by more than
    ``radius`` in any of ``MORE`` further coordinates are discarded, and only
    the survivors' bits compared.  A cell gives no more edges than join its
    fingerprints.
    The fingerprints of cells with more than ``crowd`` (clusters of near copies)
    take an exact way of linear cost instead: two fingerprints are at most 2
    bits apart just if some 64-bit point is at most 1 bit from both, so each
    goes to its 65 points and is linked with the least fingerprint there.  At
    most 65 fingerprints can meet at a point, so no group grows with the data
    and no link is lost.

Components come from alternating large-star and small-star steps over the
links between distinct fingerprints; copies never are expanded into pairs.

Rows: null text counts as empty; repeated rows give repeated rows; an empty
table gives an empty table; other columns are ignored (or carried on by
``drop_near_duplicates``).  Ties go to the smallest doc_id; null doc_ids sort
last and take part like others.
"""

from __future__ import annotations

from itertools import accumulate

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._shared import BROADCAST_ROWS, beside, counted, cut, masked, runs, spread

SEED = 42
HELD_BYTES = 1 << 24
_BITS = ((np.arange(256)[:, None] >> np.arange(8)) & 1).astype(np.float64)
_PLACE = np.arange(8, dtype=np.int64) * 256
_POWERS = np.uint64(1) << np.arange(64, dtype=np.uint64)


def fingerprint(text: str | None) -> int:
    """The signed 64-bit fingerprint of one text."""
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    n = len(words)
    if not n:
        return 0
    line = b" ".join(words)
    if n < 4:
        hashes = [xxhash.xxh64_intdigest(line, SEED)]
    else:
        ends = list(accumulate(len(w) + 1 for w in words))
        digest = xxhash.xxh64_intdigest
        hashes = [digest(line[a : b - 1], SEED) for a, b in zip([0, *ends], ends[2:])]
    m = len(hashes)
    places = np.array(hashes, dtype="<u8").view(np.uint8).reshape(m, 8) + _PLACE
    counts = np.bincount(places.ravel(), minlength=2048).reshape(8, 256) @ _BITS
    return int(_POWERS[(counts.ravel() * 2 > m)].sum(dtype=np.uint64).astype(np.int64))


def _fingerprints(batches):
    for batch in batches:
        texts = batch.column(1)
        values = np.fromiter((fingerprint(t.as_py()) for t in texts), np.int64, len(texts))
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(values)], ["doc_id", "fp"])


def _fingerprints_hashed(batches):
    for batch in batches:
        (found,) = _fingerprints([batch])
        yield pa.RecordBatch.from_arrays([*found.columns, batch.column(2)], ["doc_id", "fp", "th"])


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, fp) of every row."""
    narrow = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return narrow.mapInArrow(_fingerprints, "doc_id long, fp long")


PIVOTS = np.array([sum((bin(i & j).count("1") & 1) << j for j in range(64)) for i in range(64)], dtype=np.uint64)
MORE = 8


def pivot_table(fps: np.ndarray, which) -> np.ndarray:
    """Hamming distances of each fingerprint to the pivots ``which``."""
    return np.bitwise_count(fps.view(np.uint64)[:, None] ^ PIVOTS[np.asarray(which, dtype=int)]).astype(np.int8)


class Cuts:
    """The pivots that cut the fingerprints into cells, and where."""

    def __init__(self, counts: np.ndarray, crowd: int):
        """``counts``: how many fingerprints are at each distance (0 to 64) of each pivot."""
        n = int(counts[0].sum())
        below = np.cumsum(counts, axis=1)
        at = np.array([int(np.searchsorted(c, n / 2)) for c in below])  # the low side ends here
        low = below[np.arange(len(at)), np.minimum(at + 1, 64)] / max(1, n)
        high = 1 - np.where(at > 0, below[np.arange(len(at)), at - 1], 0) / max(1, n)
        worst = np.maximum(low, high)
        order = np.argsort(worst, kind="stable")
        used, left = 0, float(n)
        while left > crowd / 2 and used < 63 - MORE and worst[order[used]] < 0.9:
            left *= worst[order[used]]
            used += 1
        self.which, self.at = order[:used], at[order[:used]].astype(np.int8)
        self.more = order[used : used + MORE]

    def cells(self, fps: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(row, cell) of every cell that each fingerprint goes to."""
        rows, cells = np.arange(len(fps)), np.zeros(len(fps), dtype=np.int64)
        table = pivot_table(fps, self.which)
        for p, at in enumerate(self.at):
            d = table[rows, p]
            low, high = d <= at + 1, d >= at
            rows, cells = np.concatenate([rows[low], rows[high]]), np.concatenate([2 * cells[low], 2 * cells[high] + 1])
        return rows, cells


def compare(fps: np.ndarray, cell: np.ndarray, more, radius: int) -> tuple[np.ndarray, np.ndarray, tuple[int, int, int]]:
    """Edges that join the linked fingerprints of each cell (rows of a cell together), and how many pairs met, survived the table, and linked."""
    starts = np.flatnonzero(np.concatenate([[True], cell[1:] != cell[:-1]])) if len(cell) else np.zeros(0, int)
    sizes = np.diff(np.concatenate([starts, [len(cell)]]))
    table, label, a, b = pivot_table(fps, more), list(range(len(fps))), [], []
    met = survived = linked = 0

    def top(x):
        while label[x] != x:
            label[x] = x = label[label[x]]
        return x

    def verify(i, j):
        nonlocal survived, linked
        survived += len(i)
        near = np.bitwise_count(fps[i].view(np.uint64) ^ fps[j].view(np.uint64)) <= radius
        linked += int(near.sum())
        for x, y in zip(i[near].tolist(), j[near].tolist()):
            if (p := top(x)) != (q := top(y)):
                a.append(x)
                b.append(y)
                label[p] = q

    # small cells: pairs a fixed number of rows apart, all cells at once
    left = np.where(np.repeat(sizes, sizes) <= 16, np.repeat(starts + sizes, sizes) - np.arange(len(cell)), 0)
    for step in range(1, 16):
        i = np.flatnonzero(left > step)
        met += len(i)
        near = (np.abs(table[i] - table[i + step]) <= radius).all(axis=1)
        verify(i[near], i[near] + step)
    for start, n in zip(starts[sizes > 16], sizes[sizes > 16]):
        own = table[start : start + n]
        met += n * (n - 1) // 2
        for x in range(0, n, 256):
            near = np.arange(x, min(n, x + 256))[:, None] < np.arange(n)[None, :]
            for p in range(own.shape[1]):
                near &= np.abs(own[x : x + 256, p, None] - own[None, :, p]) <= radius
            i, j = np.nonzero(near)
            verify(start + x + i, start + j)
    a, b = fps[np.array(a, dtype=int)], fps[np.array(b, dtype=int)]
    return np.minimum(a, b), np.maximum(a, b), (int(met), survived, linked)


def _cuts(distinct: DataFrame, crowd: int) -> Cuts:
    def count(batches):
        counts = np.zeros((64, 65), dtype=np.int64)
        for batch in batches:
            table = pivot_table(batch.column(0).to_numpy(), range(64))
            for p in range(64):
                counts[p] += np.bincount(table[:, p], minlength=65)
        p, d = np.nonzero(counts)
        yield pa.RecordBatch.from_arrays([pa.array(p, pa.int32()), pa.array(d, pa.int32()), pa.array(counts[p, d])], ["p", "d", "n"])

    rows = distinct.select("fp").mapInArrow(count, "p int, d int, n long").groupBy("p", "d").agg(F.sum("n").alias("n")).toArrow()  # 64 by 65 at most
    counts = np.zeros((64, 65), dtype=np.int64)
    counts[rows.column("p").to_numpy(), rows.column("d").to_numpy()] = rows.column("n").to_numpy()
    return Cuts(counts, crowd)


def links(distinct: DataFrame, radius: int = 2, crowd: int = 2048) -> DataFrame:
    """Edges (a, b), a < b, that connect all linked fingerprints of ``distinct`` (column fp)."""
    if radius > 2:
        raise ValueError("cells and points are laid out for links of at most 2 bits")
    cuts = distinct.sparkSession.sparkContext.broadcast(_cuts(distinct, crowd))

    def deal(batches):
        for batch in batches:
            for at in range(0, batch.num_rows, 4096):
                fps = batch.column(0)[at : at + 4096].to_numpy()
                rows, cells = cuts.value.cells(fps)
                yield pa.RecordBatch.from_arrays([pa.array(cells), pa.array(fps[rows])], ["cell", "fp"])

    def run(batches):
        for table in runs(batches, 1, HELD_BYTES):
            cell, fps = table.column("cell").to_numpy(), table.column("fp").to_numpy()
            a, b, _ = compare(fps, cell, cuts.value.more, radius)
            yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], ["a", "b"])

    dealt = cut(distinct.select("fp").mapInArrow(deal, "cell long, fp long"))
    full, n_full = counted(dealt.groupBy("cell").agg(F.count("*").alias("n")).filter(F.col("n") > crowd).select("cell"))
    if not n_full:
        thin = dealt
    else:
        thin = dealt.join(beside(full, n_full), "cell", "left_anti")
    sparse = thin.repartition(spread(distinct), "cell").sortWithinPartitions("cell").mapInArrow(run, "a long, b long")
    if not n_full:
        return sparse.distinct()
    crowded = dealt.join(beside(full, n_full), "cell", "left_semi").select("fp").distinct()
    flips = F.expr("concat(array(fp), transform(sequence(0, 63), i -> fp ^ shiftleft(1L, i)))")
    points = crowded.select("fp", F.explode(flips).alias("point"))
    stars = (
        points.groupBy("point")
        .agg(F.collect_list("fp").alias("fps"))
        .filter(F.size("fps") > 1)
        .select(F.array_min("fps").alias("a"), F.explode("fps").alias("b"))
        .filter("a < b")
    )
    return sparse.union(stars).distinct()


def components(edges: DataFrame, rounds: int = 40, nodes: int | None = None) -> DataFrame:
    """(node, root): the least node reachable, for every node of an edge (a < b) but the least of each component.

    ``nodes``: about how many nodes there are, if known.  Minima are taken in
    two steps, within tasks and then over one row for each node and task, so
    that a node with very many neighbours is no one's burden; they come back to
    the edges by a join that is broadcast where its counted rows are few, and
    else has its skewed partitions split at run time.
    """
    edges = cut(edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).filter("u <> v"), nodes)
    rows = edges.count()

    def told(least: DataFrame, most: int) -> DataFrame:
        return F.broadcast(least) if most <= BROADCAST_ROWS else beside(*counted(least))

    before = None
    for _ in range(rounds):
        # large star: a node's greater neighbours go to its least neighbour
        both = edges.union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.join(told(least, 2 * rows), "u").filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        # small star: a node and its lesser neighbours go to the least of them
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(told(least, rows), "u")
        edges = cut(
            small.select(F.col("v").alias("u"), F.col("m").alias("v"))
            .union(least.select("u", F.col("m").alias("v")))
            .filter("u <> v")
            .distinct(),
            rows,
        )
        now = edges.agg(F.count("*"), F.sum(F.hash("u", "v").cast("long")), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if now == before:
            break
        before = now
    else:
        raise RuntimeError(f"components didn't settle in {rounds} rounds")
    return edges.groupBy("u").agg(F.min("v").alias("root")).select(F.col("u").alias("node"), "root")


def _roots(marked: DataFrame, radius: int = 2, crowd: int = 2048) -> DataFrame:
    """(fp, least, copies, root) of every distinct fingerprint of ``marked``."""
    n = marked.count()
    classes = cut(marked.groupBy("fp").agg(F.min("doc_id").alias("least"), F.count("*").alias("copies")), n)
    found = components(links(classes.select("fp"), radius, crowd), nodes=n)
    return classes.join(found, classes.fp == found.node, "left").select("fp", "least", "copies", F.coalesce("root", "fp").alias("root"))


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **how) -> DataFrame:
    """(doc_id, fingerprint, component_id) of every row; ``how``: radius, crowd."""
    marked = cut(fingerprints(docs, id_col, text_col))
    rooted = _roots(marked, **how)
    smallest = rooted.groupBy("root").agg(F.min("least").alias("component_id"))
    # only what a row doesn't know itself is joined: classes of one row without links need nothing
    known = (
        rooted.join(smallest, "root")
        .filter("copies > 1 or not (component_id <=> least)")
        .select(F.col("fp").alias("fp_"), "component_id")
    )
    return marked.join(known, F.col("fp") == F.col("fp_"), "left").select(
        "doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), F.coalesce("component_id", "doc_id").alias("component_id")
    )


def drop_near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **how) -> DataFrame:
    """One row of each component - one with its smallest id - with the columns of ``docs``, whatever their names.

    Rows that repeat an id are copies of one another if their texts are near;
    of equal rows one stays.  Of a component without ids, the row whose text
    sorts first by hash stays.
    """
    plain, new, restore = masked(docs)
    identifier = F.col(new[id_col]).cast("long")
    hashed = plain.withColumn("__h", F.xxhash64(F.coalesce(F.col(new[text_col]), F.lit(""))))
    named = hashed.select(identifier.alias("doc_id"), F.col(new[text_col]).cast("string").alias("text"), "__h")
    marked = cut(named.mapInArrow(_fingerprints_hashed, "doc_id long, fp long, th long"))
    rooted = _roots(marked, **how)
    best = marked.join(rooted.select(F.col("fp").alias("fp_"), "root"), F.col("fp") == F.col("fp_")).groupBy("root").agg(
        F.min(F.struct(F.col("doc_id").isNull().alias("absent"), "doc_id", "th")).alias("best")
    )
    keep, n_keep = counted(best.select(F.col("best.doc_id").alias("i"), F.col("best.th").alias("t")))
    same = identifier.eqNullSafe(F.col("i")) & (F.col("__h") == F.col("t"))
    kept = hashed.join(beside(keep, n_keep), same, "left_semi")
    chosen = F.col("doc_id").eqNullSafe(F.col("i")) & (F.col("th") == F.col("t"))
    again = cut(marked.join(beside(keep, n_keep), chosen, "left_semi").groupBy("doc_id", "th").agg(F.count("*").alias("n")).filter("n > 1"))
    if again.isEmpty():
        return restore(kept)
    again = again.select(F.col("doc_id").alias("i"), F.col("th").alias("t"))
    return restore(kept.join(again, same, "left_anti").unionByName(kept.join(again, same, "left_semi").dropDuplicates([new[id_col], "__h"])))
