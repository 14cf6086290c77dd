"""Near-duplicates by fingerprint and by similarity: SimHash with pivots, then an exact join of shingle sets.

Fingerprints
    Every text has the fingerprint of ``simhash``, and the distinct ones go
    through its search: distances to the pivots, cells of them, further
    coordinates that discard, bits that verify.  Texts at most 2 bits apart
    link, whatever their sets of shingles.

Similarity
    Copies with a few words changed are 3 bits and more apart, which pivots
    can't sift, so an exact join adds the links of all texts whose sets of
    five-word shingles have a Jaccard similarity of 0.8 or more, as laid out
    below.  Components are those of both kinds of links.

Meeting
    Of two sets of that similarity, each has one of the other's shingles among
    its own first ``k - ceil(0.8 k) + 1`` in any order that all sets share.  So
    each set goes under those shingles, and sets meet under the ones they have
    in common, whatever the number of rows.  The order puts rare shingles
    first, by counts over hashed buckets: passages that many texts share come
    last, and few sets go under them.  A bucket's count only steers the order;
    every order gives the same pairs.

Table of counts
    A set is a point of a Hamming space with a bit for each possible shingle,
    which is what a SimHash fingerprint rounds to 64 bits.  The space is split
    into ``m`` cells by hash, about one for each ``PER_CELL`` shingles of the
    set, and the reference fingerprints are all unions of cells.  A set's
    distance to a reference follows from its counts in the cells, so the counts
    are its row of the table, and the greatest difference of two rows over all
    ``2 ** m`` coordinates has a closed form: the sum of the absolute
    differences of the counts.  By the triangle inequality no coordinate of a
    pair differs by more than the pair's own distance, which at that similarity
    is at most ``(k + l) / 9``.  A pair whose rows differ by more is discarded.
    No true pair is lost.  (A row with more cells is folded to compare it with
    one that has fewer.)

Linking
    The sets of a key are compared by the table, block against block.  A task
    returns no more of the surviving pairs than join its rows, and these join
    the sets into candidate groups, within which all similar pairs must lie.
    Only for groups of two or more the shingles are gathered, each set once, and
    the survivors of the table verified, again block against block and with no
    more links returned than join the rows.  Nothing is sampled, no key is cut,
    and groups of close copies take time linear in their rows, as what is joined
    isn't compared again.

Equal sets are one class from the start.  Null text counts as empty; texts of
fewer than five words are one shingle; texts without words are copies of one
another.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._shared import beside, counted, cut, masked, runs, spread, utf8
from .simhash import SEED, components, fingerprint, links

BUCKETS = 1 << 18
LEAST_CELLS, PER_CELL = 64, 4
BLOCK_ROWS, BLOCK_SHINGLES = 2048, 1 << 21
HELD_BYTES = 1 << 25
_WANTED_BITS = 1 << 23
_SLACK = 1e-6  # bounds are rounded outwards


def shingles(text: str, words: int = 5) -> set[int]:
    """Hashes of the distinct shingles of a text, A-Z in lower case."""
    w = text.encode("utf-8", "surrogatepass").lower().split()
    if not w:
        return set()
    digest = xxhash.xxh64_intdigest
    return {digest(b" ".join(w[i : i + words]), SEED) for i in range(max(1, len(w) - words + 1))}


def prefix_length(k: int, similarity: float) -> int:
    """How many first shingles of a set of ``k`` meet every set that is similar enough."""
    return k - int(np.ceil(similarity * k - _SLACK)) + 1 if k else 0


def pivot_row(hashes: np.ndarray) -> bytes:
    """Counts of a set in its cells, a byte each; a count of 255 stands for more, too."""
    bits = max(LEAST_CELLS, len(hashes) // PER_CELL).bit_length() - 1
    return np.minimum(np.bincount((hashes >> np.uint64(64 - bits)).astype(np.int64), minlength=1 << bits), 255).astype(np.uint8).tobytes()


class PivotTable:
    """Rows of the table, of any numbers of cells."""

    def __init__(self, rows: list[bytes]):
        self.cells = np.array([len(r) for r in rows], dtype=np.int64)
        self._place, self._rows = np.zeros(len(rows), dtype=np.int64), {}
        for m in np.unique(self.cells):
            where = np.flatnonzero(self.cells == m)
            self._place[where] = np.arange(len(where))
            self._rows[int(m)] = np.frombuffer(b"".join(rows[i] for i in where), np.uint8).reshape(-1, m)

    def _folded(self, i: np.ndarray, m: int, to: int) -> np.ndarray:
        rows = self._rows[m][self._place[i]].astype(np.int16)
        return rows if m == to else np.minimum(rows.reshape(len(i), to, m // to).sum(axis=2), 255).astype(np.int16)

    def apart(self, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        """The greatest difference over all coordinates, for each pair of rows."""
        out = np.zeros(len(i), dtype=np.int64)
        kinds = self.cells[i] * (1 << 32) + self.cells[j]
        for kind in np.unique(kinds):
            m, n = int(kind) >> 32, int(kind) & 0xFFFFFFFF
            to = min(m, n)
            where = np.flatnonzero(kinds == kind)
            step = max(1, (1 << 22) // max(m, n))
            for at in range(0, len(where), step):
                some = where[at : at + step]
                out[some] = np.abs(self._folded(i[some], m, to) - self._folded(j[some], n, to)).sum(axis=1, dtype=np.int64)
        return out


def most_apart(k, l, similarity: float):
    """The greatest distance of two sets of these sizes that are similar enough."""
    return (1 - similarity) / (1 + similarity) * (k + l) + _SLACK


def _bucket(hashes: np.ndarray) -> np.ndarray:
    return (hashes >> np.uint64(46)).astype(np.int64)


def _packed(text) -> bytes:
    found = shingles(text.as_py() or "")
    return np.sort(np.fromiter(found, np.uint64, len(found))).tobytes()


def _mark(batches):
    for batch in batches:
        cids, sizes, rows, fps = [], [], [], []
        for text in batch.column(1):
            held = _packed(text)
            fps.append(fingerprint(text.as_py()))
            cids.append(xxhash.xxh64_intdigest(held, SEED))
            sizes.append(len(held) // 8)
            rows.append(pivot_row(np.frombuffer(held, np.uint64)))
        cids = np.array(cids, dtype=np.uint64).view(np.int64)
        yield pa.RecordBatch.from_arrays(
            [batch.column(0), batch.column(2), pa.array(fps, pa.int64()), pa.array(cids), pa.array(sizes, pa.int32()), pa.array(rows, pa.binary())],
            ["doc_id", "th", "fp", "cid", "k", "pivots"],
        )


def _once(batches):
    """The sets of each class, as (cid, hashes); copies within the task are left out."""
    seen = set()
    for batch in batches:
        for text in batch.column(0):
            held = _packed(text)
            cid = xxhash.xxh64_intdigest(held, SEED)
            if cid not in seen:
                seen.add(cid)
                yield cid, np.frombuffer(held, np.uint64)


def _bucket_counts(texts: DataFrame) -> np.ndarray:
    def run(batches):
        counts = np.zeros(BUCKETS, dtype=np.int64)
        for _, hashes in _once(batches):
            np.add.at(counts, _bucket(hashes), 1)
        used = np.flatnonzero(counts)
        yield pa.RecordBatch.from_arrays([pa.array(used), pa.array(counts[used])], ["bucket", "n"])

    rows = texts.mapInArrow(run, "bucket long, n long").groupBy("bucket").agg(F.sum("n").alias("n")).toArrow()
    counts = np.zeros(BUCKETS, dtype=np.int64)
    counts[rows.column("bucket").to_numpy()] = rows.column("n").to_numpy()
    return counts


def _met(texts: DataFrame, similarity: float) -> DataFrame:
    """(key, cid, k, at) for the keys that two classes or more stand under: size of the set, place of the key in it.

    Keys that the same classes stand under are one, named by those classes.
    """
    counts = texts.sparkSession.sparkContext.broadcast(_bucket_counts(texts))

    def deal(batches):
        held, rows = [], 0
        for cid, hashes in _once(batches):
            k = len(hashes)
            first = hashes[np.lexsort((hashes, counts.value[_bucket(hashes)]))][: prefix_length(k, similarity)]
            held.append((first, cid, k))
            rows += len(first)
            if rows > 50_000:
                yield packed(held)
                held, rows = [], 0
        if rows:
            yield packed(held)

    def packed(held):
        n = [len(first) for first, _, _ in held]
        cids, sizes = (np.repeat(np.array([row[i] for row in held], dtype=np.uint64), n) for i in (1, 2))
        keys, places = np.concatenate([first for first, _, _ in held]), np.concatenate([np.arange(m, dtype=np.uint64) for m in n])
        columns = (keys, cids, (sizes << np.uint64(32)) | places)
        return pa.RecordBatch.from_arrays([pa.array(x.view(np.int64)) for x in columns], ["key", "cid", "ka"])

    def shared(batches):
        held = []  # rows of the last key, which may go on
        for batch in batches:
            if not batch.num_rows:
                continue
            key = batch.column(0).to_numpy()
            last = int(np.searchsorted(key, key[-1]))
            if held and (last or held[0].column(0)[0].as_py() != key[0]):
                yield from shown([*held, batch.slice(0, last)])
                held = []
            elif last:
                yield from shown([batch.slice(0, last)])
            held.append(batch.slice(last))
        if held:
            yield from shown(held)

    def shown(rows):
        key, cid, ka = (np.concatenate([r.column(i).to_numpy() for r in rows]) for i in range(3))
        new = np.concatenate([[True], (key[1:] != key[:-1]) | (cid[1:] != cid[:-1])])
        key, cid, ka = key[new], cid[new], ka[new]
        starts = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))
        n = np.diff(np.concatenate([starts, [len(key)]]))
        mixed = cid.view(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
        mixed = (mixed ^ (mixed >> np.uint64(31))) * np.uint64(0xD6E8FEB86659FD93)
        group = np.repeat(np.add.reduceat(mixed ^ (mixed >> np.uint64(29)), starts), n).view(np.int64)
        found = np.repeat(n, n) > 1
        if found.any():
            yield pa.RecordBatch.from_arrays([pa.array(x[found]) for x in (group, cid, ka)], ["group", "cid", "ka"])

    dealt = texts.mapInArrow(deal, "key long, cid long, ka long").repartition(spread(texts), "key").sortWithinPartitions("key", "cid")
    groups = dealt.mapInArrow(shared, "group long, cid long, ka long")
    # the first key of a group is the first for each of its classes
    least = groups.groupBy(F.col("group").alias("key"), "cid").agg(F.min("ka").alias("ka"))
    return least.select("key", "cid", F.shiftright("ka", 32).cast("int").alias("k"), F.col("ka").bitwiseAND(F.lit(0xFFFFFFFF)).cast("int").alias("at"))


def _sets(texts: DataFrame, classes: DataFrame, wanted: DataFrame) -> DataFrame:
    """(cid, shingles) of the wanted classes; ``texts``: (doc_id, th, text), ``classes`` with the first row of each.

    The rows to read are told by a bitmap of fixed size; what it lets through by
    chance leaves by the join, and no text is shuffled.
    """
    mark = lambda i, t: F.pmod(F.xxhash64(i, t), F.lit(_WANTED_BITS)).cast("int")
    wanted = cut(classes.join(wanted.distinct(), "cid", "left_semi").select("cid", mark(F.col("first.doc_id"), F.col("first.th")).alias("m")))
    words = wanted.groupBy(F.shiftright("m", 5).alias("w")).agg(F.expr("bit_or(shiftleft(1L, m & 31))").alias("x")).toArrow()
    bits = np.zeros(_WANTED_BITS >> 5, dtype=np.uint64)  # at most that many rows
    bits[words.column("w").to_numpy()] = words.column("x").to_numpy().astype(np.uint64)
    bits = texts.sparkSession.sparkContext.broadcast(bits)

    def run(batches):
        for batch in batches:
            m = batch.column(1).to_numpy()
            asked = np.flatnonzero((bits.value[m >> 5] >> (m & 31).astype(np.uint64)) & np.uint64(1))
            held = [_packed(batch.column(0)[int(i)]) for i in asked]
            cids = np.array([xxhash.xxh64_intdigest(x, SEED) for x in held], dtype=np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(cids), pa.array(held, pa.binary())], ["cid", "shingles"])

    made = texts.select("text", mark(F.col("doc_id"), F.col("th")).alias("m")).mapInArrow(run, "cid long, shingles binary")
    # rows that repeat an id and its text are one row twice
    return cut(made.join(wanted.select("cid"), "cid", "left_semi").groupBy("cid").agg(F.any_value("shingles").alias("shingles")))


def _blocks(rows: DataFrame, group: str, many) -> DataFrame:
    """``rows`` once for each pair of blocks (lo, hi) of their group that they stand in; ``many``: blocks of a group, an aggregate."""
    blocks = rows.groupBy(group).agg(F.ceil(many).cast("int").alias("nb"))
    return (
        rows.join(blocks, group)
        .withColumn("b", F.pmod(F.xxhash64("cid"), F.col("nb")).cast("int"))
        .withColumn("o", F.explode(F.sequence(F.lit(0), F.col("nb") - 1)))
        .withColumn("lo", F.least("b", "o"))
        .withColumn("hi", F.greatest("b", "o"))
        .drop("nb", "o")
    )


def _fits(k, at, i, j, similarity: float) -> np.ndarray:
    """Whether the sets of pairs can be similar enough by their sizes, and by the places of a key if that is the first they share."""
    need = similarity / (1 + similarity) * (k[i] + k[j]) - _SLACK
    return (np.minimum(k[i], k[j]) >= similarity * np.maximum(k[i], k[j]) - _SLACK) & (np.minimum(k[i] - at[i], k[j] - at[j]) >= need)


def _joined(label: np.ndarray, i: np.ndarray, j: np.ndarray, cid: np.ndarray, a: list, b: list) -> None:
    """Join pairs that aren't joined yet, and note them."""
    for x, y in zip(i.tolist(), j.tolist()):
        if label[x] != label[y]:
            a.append(cid[x])
            b.append(cid[y])
            label[label == label[y]] = label[x]


def _candidates(met: DataFrame, classes: DataFrame, n_classes: int, similarity: float, block_rows: int) -> DataFrame:
    """Pairs (a, b) that the pivot table keeps: for each key enough of them to join all that it keeps."""

    def run(batches):
        for table in runs(batches, 3, HELD_BYTES):
            key, lo, hi, block, cid, k, at = (table.column(c).to_numpy() for c in ("key", "lo", "hi", "b", "cid", "k", "at"))
            k, at = k.astype(np.int64), at.astype(np.int64)
            pivots = PivotTable(table.column("pivots").to_pylist())
            new = np.concatenate([[True], (key[1:] != key[:-1]) | (lo[1:] != lo[:-1]) | (hi[1:] != hi[:-1])])
            starts = np.flatnonzero(new)
            sizes = np.diff(np.concatenate([starts, [len(key)]]))
            a, b, label = [], [], list(range(len(key)))

            def top(x):
                while label[x] != x:
                    label[x] = x = label[label[x]]
                return x

            # small groups: pairs a fixed number of rows apart, all groups at once
            small = np.repeat(sizes <= 16, sizes)
            left = np.repeat(sizes, sizes) - (np.arange(len(key)) - np.repeat(starts, sizes))
            for step in range(1, 16):
                i = np.flatnonzero(small & (left > step))
                j = i + step
                ok = ((lo[i] == hi[i]) | (block[i] != block[j])) & _fits(k, at, i, j, similarity)
                i, j = i[ok], j[ok]
                near = pivots.apart(i, j) <= most_apart(k[i], k[j], similarity)
                for x, y in zip(i[near].tolist(), j[near].tolist()):
                    if (p := top(x)) != (q := top(y)):
                        a.append(cid[x])
                        b.append(cid[y])
                        label[p] = q
            for start, n in zip(starts[sizes > 16], sizes[sizes > 16]):
                own = np.arange(n)
                for x in range(n):
                    other = np.flatnonzero(own != own[x])
                    if not len(other):
                        break
                    i, j = np.full(len(other), start + x), start + other
                    ok = ((lo[i] == hi[i]) | (block[i] != block[j])) & _fits(k, at, i, j, similarity)
                    i, j, other = i[ok], j[ok], other[ok]
                    near = pivots.apart(i, j) <= most_apart(k[i], k[j], similarity)
                    _joined(own, np.full(int(near.sum()), x), other[near], cid[start : start + n], a, b)
            a, b = np.array(a, dtype=np.int64), np.array(b, dtype=np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(np.minimum(a, b)), pa.array(np.maximum(a, b))], ["a", "b"])

    rows = _blocks(met, "key", F.count("*") / block_rows).select("key", "lo", "hi", "b", "cid", "k", "at")
    named = rows.join(beside(classes.select("cid", "pivots"), n_classes), "cid").select("key", "lo", "hi", "b", "cid", "k", "at", "pivots")
    dealt = named.repartition(spread(met), "key", "lo", "hi").sortWithinPartitions("key", "lo", "hi", "cid")
    return dealt.mapInArrow(run, "a long, b long").distinct()


def _compared(rows: DataFrame, sets: DataFrame, similarity: float, block_rows: int) -> DataFrame:
    """Links (a, b) that join all similar sets of a candidate group, block against block; ``rows``: (cid, k, root)."""

    def run(group: pa.Table) -> pa.Table:
        within = group.column("lo")[0] == group.column("hi")[0]
        block, cid, k = (group.column(c).to_numpy() for c in ("b", "cid", "k"))
        k, at = k.astype(np.int64), np.zeros(len(k), dtype=np.int64)
        held = [np.frombuffer(v.as_py(), np.uint64) for v in group.column("shingles")]
        pivots, label = PivotTable([pivot_row(h) for h in held]), np.arange(len(k))
        a, b = [], []
        for x in range(len(k)):
            other = np.flatnonzero(label != label[x])
            if not len(other):
                break
            if not within:
                other = other[block[other] != block[x]]
            one = np.full(len(other), x)
            ok = _fits(k, at, one, other, similarity)
            other = other[ok]
            near = other[pivots.apart(one[ok], other) <= most_apart(k[x], k[other], similarity)]
            for y in near:
                if label[y] == label[x]:
                    continue
                common = np.count_nonzero(held[x][np.searchsorted(held[x], held[y]).clip(max=k[x] - 1)] == held[y])
                if common >= similarity * (k[x] + k[y] - common):
                    _joined(label, np.array([x]), np.array([y]), cid, a, b)
        return pa.table({"a": pa.array(np.minimum(a, b), pa.int64()), "b": pa.array(np.maximum(a, b), pa.int64())})

    many = F.greatest(F.count("*") / block_rows, F.sum("k") / BLOCK_SHINGLES)
    return _blocks(rows, "root", many).join(sets, "cid").groupBy("root", "lo", "hi").applyInArrow(run, "a long, b long").distinct()


def _links(texts: DataFrame, classes: DataFrame, n_classes: int, similarity: float, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """(node, root) of every class that is similar to one before it, as ``components`` gives them; ``texts``: (doc_id, th, text) of all rows."""
    met = cut(_met(texts.select("text"), similarity))
    kept = cut(_candidates(met, classes, n_classes, similarity, block_rows), n_classes)
    told = cut(components(kept, nodes=n_classes).select(F.col("node").alias("cid"), "root"))
    groups, n = counted(told.unionByName(told.select(F.col("root").alias("cid"), "root").distinct()))
    rows = cut(groups.join(beside(classes.select("cid", "k"), n_classes), "cid"), n)
    found = _compared(rows, _sets(texts, classes, groups.select("cid")), similarity, block_rows)
    return components(found, nodes=n)


def _near(marked: DataFrame) -> DataFrame:
    """Edges (a, b) between classes that join all texts with equal fingerprints or such that differ in at most 2 bits; ``marked``: fp, cid of every row."""
    held, _ = counted(marked.select("fp", "cid").distinct())
    # a fingerprint is named by the least of its classes
    names, n = counted(held.groupBy("fp").agg(F.min("cid").alias("least")))
    same = held.join(beside(names, n), "fp").select(F.col("least").alias("a"), F.col("cid").alias("b"))
    named = lambda end: beside(names.select(F.col("fp").alias(end), F.col("least").alias(f"{end}_class")), n)
    found = links(names.select("fp")).join(named("a"), "a").join(named("b"), "b").select("a_class", "b_class")
    return same.union(found).filter("a <> b").distinct()


def drop_similar(docs: DataFrame, similarity: float = 0.8, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row of each component of texts that link by fingerprint or by similarity, with the columns of ``docs``, whatever their names.

    The row with the smallest id stays; of a component without ids the one whose
    text's hash is least; of equal rows, one.  An empty table stays empty.
    """
    plain, new, restore = masked(docs)
    identifier, text = F.col(new[id_col]).cast("long"), utf8(F.col(new[text_col]).cast("string"))
    hashed = plain.withColumn("__h", F.xxhash64(text))
    texts = hashed.select(identifier.alias("doc_id"), text.alias("text"), F.col("__h").alias("th"))
    marked = cut(texts.mapInArrow(_mark, "doc_id long, th long, fp long, cid long, k int, pivots binary"))
    order = F.struct(F.col("doc_id").isNull().alias("absent"), "doc_id", "th")
    # a class is named by a hash of its set, and known by its first row
    classes, n = counted(marked.groupBy("cid").agg(F.min(order).alias("first"), F.any_value("k").alias("k"), F.any_value("pivots").alias("pivots")))
    alike = _links(texts, classes, n, similarity).select(F.col("root").alias("a"), F.col("node").alias("b"))
    roots = components(_near(marked).union(alike), nodes=n)
    rooted = classes.select("cid", "first").join(roots, F.col("cid") == F.col("node"), "left").select("first", F.coalesce("root", "cid").alias("root"))
    keep, n_keep = counted(rooted.groupBy("root").agg(F.min("first").alias("f")).select(F.col("f.doc_id").alias("i"), F.col("f.th").alias("t")))
    chosen = F.col("doc_id").eqNullSafe(F.col("i")) & (F.col("th") == F.col("t"))
    narrow = marked.select("doc_id", "th")
    again = cut(narrow.join(beside(keep, n_keep), chosen, "left_semi").groupBy("doc_id", "th").agg(F.count("*").alias("m")).filter("m > 1"), 0)
    gone, n_gone = counted(narrow.join(beside(keep, n_keep), chosen, "left_anti").distinct().select(F.col("doc_id").alias("i"), F.col("th").alias("t")))
    same = identifier.eqNullSafe(F.col("i")) & (F.col("__h") == F.col("t"))
    # the shorter list meets the documents
    kept = hashed.join(beside(gone, n_gone), same, "left_anti") if n_gone <= n_keep else hashed.join(beside(keep, n_keep), same, "left_semi")
    if again.isEmpty():
        return restore(kept)
    again = again.select(F.col("doc_id").alias("i"), F.col("th").alias("t"))
    return restore(kept.join(again, same, "left_anti").unionByName(kept.join(again, same, "left_semi").dropDuplicates([new[id_col], "__h"])))
