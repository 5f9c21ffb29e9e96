"""N-gram Jaccard join by a count-vector R-tree.

A document's set holds its distinct word shingles (see ``shingles``). Documents of equal sets form a
class, and classes are joined: two link if their sets' Jaccard likeness is at least ``percent`` / 100.

The points. A set's shingles are hashed into groups, at least ``GROUPS`` and about as many as shingles; the
group counts are a point, which folds onto ``GROUPS`` groups for the tree and onto the coarser of two for a pair. The overlap
of two sets is at most the sum over groups of the smaller count; for two boxes of points, of the smaller
upper corner. An R-tree is packed over the points of a cell (halved at the middle of the widest side, the
set size among the sides, until ``LEAF`` points are left); pairs of its nodes are followed from the root down while that bound
reaches the overlap that the threshold needs, and the pairs of points that survive are verified on the sets.

The cells. Linked sets must share one of the first ``n - ceil(t n) + 1`` shingles of each in any order that is the same for
all: the order by count, over all documents, of a shingle's bucket among ``BUCKETS``, so that frequent ones come last. So the tree is laid out over cells, one
for each such shingle, and no pair is missed:

1. Each class goes with its set to the cells of its ``FIRST`` least shingles, which near copies are likely to share. A cell over ``CELL`` classes
   or ``HELD`` shingles is dealt into parts by hash. In a part the tree's pairs are verified at once, and a pair whose classes are already
   connected is skipped. The links' components are found by one task, over ``EDGES`` links by large-star and small-star rounds.
2. All shingles of the prefixes make cells; those whose classes are all in one component by now are
   done. In parts of the others, the cells of each class's ``NEAREST`` least open shingles, the tree gives each class its likeliest partner in
   another component, so no more pairs than classes. They are verified, and components are found again: so members of a group of near copies that the
   first pass missed join it by one link each, not by all of theirs.
3. Of the cells that are still open the tree gives all pairs across components, in cells over ``CELL`` classes for each pair of
   parts, within bands of set size; a pair only in the first of its cells, as far as the ``HEAD`` least open shingles of its classes tell.
   They are verified, and components are found again.

So a group of near copies costs a few passes over its members, while links between different texts are all
tested unless their ends are connected already; components are exact. With ``count_links`` the first pass is left out and no pair is skipped, so every link between
classes is verified (a number that is quadratic in groups of near copies) and each document's links are counted.

A null text is an empty one; a set without shingles is linked with nothing. A null id is a document that
is linked with nothing, without component. Rows of equal sets are one class, so repeated rows are linked. An empty table gives an
empty result; other columns are not read.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidelog.llm.common import id_text, map_steps, mix64, release, steps
from tidelog.llm.saved import Scratch
from tidelog.llm.shingles import shingle_sets
from tidelog.llm.skew import looked_up

GROUPS, LEAF, CELL, FIRST, NEAREST, HEAD = 64, 16, 512, 2, 4, 16
#: Shingles of all classes of a part of a cell together, about, where sets are held.
HELD = 1 << 19
#: Links that one task joins into components, in some 200 MB; more go through rounds, of some 15 stages each.
EDGES = 1 << 21
#: Buckets of shingles whose documents are counted, and buckets in a block; the counts take some 4 MB whatever the input.
BUCKETS, BLOCK = 1 << 20, 1 << 12
#: A count of ``FULL`` means that many or more; it bounds nothing.
FULL, UNBOUND, FINEST, PAIR_FINEST = 15, 1 << 20, 256, 1 << 14


def point_of(shingles: np.ndarray, finest: int = FINEST) -> bytes:
    """Group counts, two in a byte; the number of groups is the power of two from the set's size."""
    groups = min(finest, max(GROUPS, 1 << int(max(1, len(shingles)) - 1).bit_length()))
    counts = np.minimum(np.bincount((shingles >> np.uint64(65 - groups.bit_length())).astype(np.int64), minlength=groups), FULL).astype(np.uint8)
    return (counts[::2] | counts[1::2] << np.uint8(4)).tobytes()


def counts_of(point: bytes) -> np.ndarray:
    packed = np.frombuffer(point, np.uint8)
    out = np.empty(2 * len(packed), np.int32)
    out[::2], out[1::2] = packed & 15, packed >> 4
    out[out == FULL] = UNBOUND
    return out


def folded(counts: np.ndarray, groups: int) -> np.ndarray:
    return np.minimum(counts.reshape(groups, -1).sum(axis=1), UNBOUND).astype(np.int32)


def bounded_pairs(points: list[bytes], sizes: np.ndarray, percent: int, owners: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Pairs of places, of different ``owners`` if these are given, that the tree leaves and that the bound at the pair's own resolution leaves too."""
    if len(points) <= LEAF:  # a tree of one leaf
        i, j = np.triu_indices(len(points), 1)
        near = (sizes[i] * 100 >= percent * sizes[j]) & (sizes[j] * 100 >= percent * sizes[i])
        if owners is not None:
            near &= owners[i] != owners[j]
        if not near.any():
            return (np.zeros(0, np.int64),) * 3
        i, j = i[near], j[near]
        counts = [counts_of(p) for p in points]
    else:
        counts = [counts_of(p) for p in points]
        i, j, _ = CountTree(np.stack([folded(c, GROUPS) for c in counts]), sizes, owners).pairs(percent)
    if not len(i):
        return i, j, i
    widths = np.array([len(c) for c in counts])
    common = np.minimum(widths[i], widths[j])
    bound = np.zeros(len(i), np.int64)
    for groups in np.unique(common).tolist():
        at = np.flatnonzero(common == groups)
        used = np.unique(np.concatenate([i[at], j[at]]))
        fold = np.stack([folded(counts[k], groups) for k in used])
        a, b = np.searchsorted(used, i[at]), np.searchsorted(used, j[at])
        step = max(1, (1 << 21) // groups)
        for k in range(0, len(at), step):
            bound[at[k : k + step]] = np.minimum(fold[a[k : k + step]], fold[b[k : k + step]]).sum(axis=1)
    kept = bound * (100 + percent) >= percent * (sizes[i] + sizes[j])
    return i[kept], j[kept], bound[kept]


def class_id(shingles: np.ndarray) -> int:
    """A 64-bit name of a set."""
    a = int(mix64(shingles ^ np.uint64(0x9E3779B97F4A7C15)).sum(dtype=np.uint64)) + len(shingles)
    return int(mix64(np.array([a & 0xFFFFFFFFFFFFFFFF], np.uint64)).view(np.int64)[0])


def prefix_of(shingles: np.ndarray, percent: int, counts: np.ndarray) -> np.ndarray:
    """The first shingles of a sorted set, by their bucket's count and then by value."""
    n = len(shingles)
    size = n - -(-percent * n // 100) + 1 if n else 0
    return shingles[np.argsort(counts[_buckets(shingles)], kind="stable")[:size]]


def _buckets(shingles: np.ndarray) -> np.ndarray:
    return (shingles & np.uint64(BUCKETS - 1)).astype(np.int64)


class CountTree:
    """An R-tree packed over points and set sizes; pairs of one owner are left out."""

    def __init__(self, points: np.ndarray, sizes: np.ndarray, owners: np.ndarray | None = None):
        self.points = points
        self.owners = np.arange(len(sizes)) if owners is None else owners
        self.single = owners is None
        self.sizes = sizes.astype(np.int64)
        self.order = np.arange(len(sizes))
        self.kids: list[tuple] = []  # start, stop, left, right
        self._pack(0, len(sizes))
        self.high = np.stack([self.points[self.order[a:b]].max(axis=0) for a, b, *_ in self.kids])
        self.least = np.array([self.sizes[self.order[a:b]].min() for a, b, *_ in self.kids])
        self.most = np.array([self.sizes[self.order[a:b]].max() for a, b, *_ in self.kids])
        self.first = np.array([self.owners[self.order[a:b]].min() for a, b, *_ in self.kids])
        self.last = np.array([self.owners[self.order[a:b]].max() for a, b, *_ in self.kids])

    def _pack(self, start: int, stop: int) -> int:
        me = len(self.kids)
        self.kids.append((start, stop, -1, -1))
        if stop - start > LEAF:
            own = self.order[start:stop]
            sides = np.column_stack([self.sizes[own], self.points[own]])
            widest = int(np.argmax(sides.max(axis=0) - sides.min(axis=0)))
            self.order[start:stop] = own[np.argsort(sides[:, widest], kind="stable")]
            middle = (start + stop) // 2
            left = self._pack(start, middle)
            self.kids[me] = (start, stop, left, self._pack(middle, stop))
        return me

    def pairs(self, percent: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Pairs of places whose bound reaches the needed overlap, and the bounds."""
        firsts, seconds, bounds = [], [], []
        now = np.zeros((1, 2), np.int64)
        while len(now):
            i, j = now.T
            # overlap needed by the smallest sizes, and sizes that the threshold keeps together
            fits = np.minimum(self.high[i], self.high[j]).sum(axis=1) * (100 + percent) >= percent * (self.least[i] + self.least[j])
            fits &= (self.most[i] * 100 >= percent * self.least[j]) & (self.most[j] * 100 >= percent * self.least[i])
            fits &= np.minimum(self.first[i], self.first[j]) < np.maximum(self.last[i], self.last[j])
            following = []
            for a, b in now[fits].tolist():
                (sa, ea, la, ra), (sb, eb, lb, rb) = self.kids[a], self.kids[b]
                if la < 0 and lb < 0:
                    x, y = np.meshgrid(self.order[sa:ea], self.order[sb:eb], indexing="ij")
                    x, y = (x[np.triu_indices(ea - sa, 1)], y[np.triu_indices(ea - sa, 1)]) if a == b else (x.reshape(-1), y.reshape(-1))
                    if not self.single:
                        apart = self.owners[x] != self.owners[y]
                        x, y = x[apart], y[apart]
                    firsts.append(x.reshape(-1))
                    seconds.append(y.reshape(-1))
                elif a == b:
                    following += [(la, la), (la, ra), (ra, ra)]
                elif lb < 0 or la >= 0 and ea - sa >= eb - sb:
                    following += [(la, b), (ra, b)]
                else:
                    following += [(a, lb), (a, rb)]
            now = np.array(following, np.int64).reshape(-1, 2)
        if not firsts:
            return (np.zeros(0, np.int64),) * 3
        i, j = np.concatenate(firsts), np.concatenate(seconds)
        kept = [np.zeros(0, np.int64)]
        for at in range(0, len(i), 1 << 15):
            bound = np.minimum(self.points[i[at : at + (1 << 15)]], self.points[j[at : at + (1 << 15)]]).sum(axis=1)
            bounds.append(bound)
            a, b = self.sizes[i[at : at + (1 << 15)]], self.sizes[j[at : at + (1 << 15)]]
            kept.append(at + np.flatnonzero((bound * (100 + percent) >= percent * (a + b)) & (a * 100 >= percent * b) & (b * 100 >= percent * a)))
        kept = np.concatenate(kept)
        return i[kept], j[kept], np.concatenate(bounds)[kept]


def linked(a: np.ndarray, b: np.ndarray, percent: int) -> bool:
    """The exact test on two sets."""
    both = len(a) + len(b) - len(np.union1d(a, b))
    return both > 0 and 100 * both >= percent * (len(a) + len(b) - both)


def _by_cell(batches: Iterator[pa.RecordBatch], work: Callable[[list[tuple]], list[tuple]], schema: pa.Schema) -> Iterator[pa.RecordBatch]:
    """Hands the rows of each cell (their first column, rows sorted by it) to ``work``, one for each class."""

    def packed(rows: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), schema.types)], schema=schema)

    cell, held, out = None, {}, []
    for batch in batches:
        for row in zip(*(c.to_pylist() for c in batch.columns)):
            if row[0] != cell:
                if len(held) > 1:
                    out += work([*held.values()])
                cell, held = row[0], {}
                if len(out) > 20_000:
                    yield packed(out)
                    out = []
            held[row[1]] = row
    if len(held) > 1:
        out += work([*held.values()])
    if out:
        yield packed(out)
    release()


def _mapped(df: DataFrame, work: Callable, percent: int) -> DataFrame:
    schema = pa.schema([("u", pa.int64()), ("v", pa.int64())])
    return df.mapInArrow(lambda batches: _by_cell(batches, lambda rows: work(rows, percent), schema), "u long, v long")


def _links_in_cell(rows: list[tuple], percent: int) -> list[tuple]:
    """Of (cell, class, set): an edge from each linked class to the least one that it is connected with."""
    sets = [np.frombuffer(r[2], np.uint64) for r in rows]
    sizes = np.array([len(s) for s in sets], np.int64)
    i, j, bound = bounded_pairs([point_of(s) for s in sets], sizes, percent)
    root = list(range(len(rows)))

    def find(x: int) -> int:
        while root[x] != x:
            root[x] = root[root[x]]
            x = root[x]
        return x

    for k in np.argsort(-bound / (sizes[i] + sizes[j] + 1), kind="stable").tolist():  # likeliest first
        a, b = find(int(i[k])), find(int(j[k]))
        if a != b and linked(sets[i[k]], sets[j[k]], percent):
            root[max(a, b, key=lambda x: rows[x][1])] = min(a, b, key=lambda x: rows[x][1])
    return [(rows[x][1], rows[find(x)][1]) for x in range(len(rows)) if find(x) != x]


def _apart(rows: list[tuple], percent: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Places and bounds of the pairs of different components among rows (cell, class, component, size, point, ..)."""
    owners = np.array([r[2] for r in rows], np.int64)
    if owners.min() == owners.max():
        return (np.zeros(0, np.int64),) * 3
    return bounded_pairs([r[4] for r in rows], np.array([r[3] for r in rows], np.int64), percent, owners)


def _nearest_in_cell(rows: list[tuple], percent: int) -> list[tuple]:
    """Each class with its likeliest partner in another component, the least one of equals: no more pairs than classes."""
    i, j, bound = _apart(rows, percent)
    best: dict[int, tuple] = {}
    for a, b, share in zip(i.tolist(), j.tolist(), (bound / (np.array([r[3] for r in rows])[i] + np.array([r[3] for r in rows])[j])).tolist()):
        for x, y in ((a, b), (b, a)):
            offer = (-share, rows[y][1])
            if x not in best or offer < best[x]:
                best[x] = offer
    return sorted({(max(rows[x][1], c), min(rows[x][1], c)) for x, (_, c) in best.items()})


def _pairs_in_cell(rows: list[tuple], percent: int) -> list[tuple]:
    """Of (cell, class, component, size, point, key, head): pairs of classes of different components. A pair whose heads share
    a lesser key than this cell's is left to that key's cell, which holds both."""
    i, j, _ = _apart(rows, percent)
    lesser: dict[int, frozenset] = {x: frozenset(k for k in rows[x][6] if k < rows[x][5]) for x in {*i.tolist(), *j.tolist()}}
    return [(max(rows[a][1], rows[b][1]), min(rows[a][1], rows[b][1])) for a, b in zip(i.tolist(), j.tolist()) if lesser[a].isdisjoint(lesser[b])]


def least_reached(u: np.ndarray, v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The nodes of the edges ``u``, ``v``, sorted, and the least node that each reaches."""
    nodes, at = np.unique(np.concatenate([u, v]), return_inverse=True)
    i, j = at[: len(u)], at[len(u) :]
    root = np.arange(len(nodes))
    while len(i):
        a, b = root[i], root[j]
        apart = a != b
        i, j, a, b = i[apart], j[apart], a[apart], b[apart]
        np.minimum.at(root, np.maximum(a, b), np.minimum(a, b))
        while not np.array_equal(up := root[root], root):
            root = up
    return nodes, nodes[root]


def _in_one_task(edges: DataFrame) -> DataFrame:
    """``components`` of few edges."""
    schema = pa.schema([("u", pa.int64()), ("v", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ends = [[c.to_numpy() for c in batch.columns] for batch in batches if batch.num_rows]
        if ends:
            nodes, least = least_reached(*(np.concatenate(x) for x in zip(*ends)))
            others = np.flatnonzero(nodes != least)
            for k in range(0, len(others), 1 << 16):
                yield pa.RecordBatch.from_arrays([pa.array(x[others[k : k + (1 << 16)]]) for x in (nodes, least)], schema=schema)
        release()

    return edges.select("u", "v").repartition(1).mapInArrow(run, "u long, v long")


def components(edges: DataFrame, scratch: Scratch) -> DataFrame:
    """(u, v): each node of ``edges`` but the least of its component, and that least one. Up to ``EDGES`` of them by one task; more by large-star and
    small-star rounds until nothing changes or so few are left; hot nodes are joined, never gathered."""
    if edges.count() <= EDGES:
        return scratch.save(_in_one_task(edges))
    state = lambda e: e.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(20,0)"))).first()
    edges = scratch.save(edges.filter("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct())
    before = state(edges)
    while before[0]:
        both = edges.union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m"), F.count(F.lit(1)).alias("n")).select("u", F.least("u", "m").alias("m"), "n")
        large = looked_up(both, least, "u", "n", ["m"]).filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").filter("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        new = scratch.save(small.union(least.select("u", F.col("m").alias("v"))).filter("u <> v").distinct())
        scratch.drop(edges)
        after, edges = state(new), new
        if after == before:
            break
        if after[0] <= EDGES:
            new = scratch.save(_in_one_task(edges))
            scratch.drop(edges)
            return new
        before = after
    return edges


def bucket_counts(docs: DataFrame, words: int) -> np.ndarray:
    """How many documents hold the shingles of each bucket, over all documents. A task sends its counts in
    blocks, a byte a bucket where that is enough; they are added as they stream by."""

    def tallied(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = np.zeros(BUCKETS, np.int64)
        for part in steps(batches):
            sets = shingle_sets(part.column(0).cast(pa.binary()).to_pylist(), words)
            counts += np.bincount(_buckets(np.concatenate(sets)), minlength=BUCKETS)
        blocks = [c.astype(np.uint8 if c.max() < 256 else np.int64).tobytes() for c in counts.reshape(-1, BLOCK)]
        yield pa.RecordBatch.from_arrays([pa.array(range(len(blocks)), pa.int32()), pa.array(blocks, pa.binary())], names=["block", "counts"])

    def added(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[int, np.ndarray] = {}
        for batch in batches:
            for block, raw in zip(*(c.to_pylist() for c in batch.columns)):
                sums[block] = sums.get(block, 0) + np.frombuffer(raw, np.uint8 if len(raw) == BLOCK else np.int64).astype(np.int64)
        yield pa.RecordBatch.from_arrays([pa.array([*sums], pa.int32()), pa.array([c.tobytes() for c in sums.values()], pa.binary())], names=["block", "counts"])

    out = np.zeros((BUCKETS // BLOCK, BLOCK), np.int64)
    for r in docs.select("text").mapInArrow(tallied, "block int, counts binary").repartition("block").mapInArrow(added, "block int, counts binary").collect():
        out[r.block] = np.frombuffer(r.counts, np.int64)
    return np.minimum(out.reshape(-1), (1 << 31) - 1).astype(np.int32)


def joined_table(df: DataFrame, percent: int = 90, words: int = 3, id_col: str = "doc_id", text_col: str = "text", count_links: bool = False) -> DataFrame:
    """doc_id, n_shingles, component_id (least doc_id that links reach), root (a name of its component) and text_hash (xxhash64) of
    every row; with ``count_links`` also n_links, how many other rows it links with."""
    spark = df.sparkSession
    scratch = Scratch(spark, "jaccard")
    docs = id_text(df, id_col, text_col)
    counts = spark.sparkContext.broadcast(bucket_counts(docs, words))

    def featured(part: pa.RecordBatch) -> dict:
        sets = shingle_sets(part.column(1).cast(pa.binary()).to_pylist(), words)
        return {"doc_id": part.column(0), "text_hash": part.column(2), "class": [class_id(s) for s in sets], "n": [len(s) for s in sets], "point": [point_of(s) for s in sets], "least": [s[:FIRST].view(np.int64) for s in sets], "prefix": [prefix_of(s, percent, counts.value).view(np.int64) for s in sets]}

    def with_sets(part: pa.RecordBatch) -> dict:
        sets = shingle_sets(part.column(0).cast(pa.binary()).to_pylist(), words)
        own = [(cell, c, len(s), point_of(s, PAIR_FINEST), s.tobytes()) for s, c, cells in zip(sets, part.column(1).to_pylist(), part.column(2).to_pylist()) if class_id(s) == c for cell in cells]
        return dict(zip(names := ("cell", "class", "n", "point", "shingles"), zip(*own) if own else [[]] * len(names)))

    rows = scratch.save(map_steps(docs.select("doc_id", "text", F.xxhash64("text").alias("text_hash")), featured, "doc_id long, text_hash long, class long, n long, point binary, least array<long>, prefix array<long>"))
    real = rows.filter("n > 0 AND doc_id IS NOT NULL")
    first = real.groupBy("class").agg(F.min("doc_id").alias("doc_id"), F.count(F.lit(1)).alias("held"))
    classes = scratch.save(real.join(first, ["class", "doc_id"]).dropDuplicates(["class"]))

    made: list[DataFrame] = []

    def sets_of(wanted: DataFrame) -> DataFrame:
        """(cell, class, shingles) of the rows (class, cell) of ``wanted``, from the text of each class's least
        document: a text is shuffled once, and its set once for each cell. The ids grow with the input, so they
        are joined by the same shuffle at every size."""
        made.append(cells := scratch.save(classes.join(wanted.groupBy("class").agg(F.collect_set("cell").alias("cells")), "class").select("doc_id", "class", "cells")))
        return map_steps(docs.join(cells.hint("merge"), "doc_id").select("text", "class", "cells"), with_sets, "cell long, class long, n long, point binary, shingles binary")

    def in_parts(cells: DataFrame, sizes: DataFrame) -> DataFrame:
        """The rows of cells of two classes or more, large cells dealt into parts."""
        both = cells.join(sizes.filter("size > 1"), "key")
        return both.withColumn("cell", F.xxhash64("key", F.pmod(F.xxhash64("class", "key"), F.ceil(F.greatest(F.col("size") / CELL, F.col("all") / HELD)))))

    if count_links:
        edges = joined = scratch.save(spark.createDataFrame([], "u long, v long"))
    else:
        near = classes.select("class", "n", F.explode("least").alias("key"))
        sizes = near.groupBy("key").agg(F.count(F.lit(1)).alias("size"), F.sum("n").alias("all"))
        members = sets_of(in_parts(near, sizes).select("class", "cell")).select("cell", "class", "shingles")
        edges = scratch.save(_mapped(members.repartition("cell").sortWithinPartitions("cell"), _links_in_cell, percent).distinct())
        joined = components(edges, scratch)

    def verified(pairs: DataFrame) -> DataFrame:
        """The links among pairs of classes."""
        ends = pairs.select(F.col("u").alias("class")).union(pairs.select(F.col("v").alias("class"))).distinct()
        sets = scratch.save(sets_of(ends.withColumn("cell", F.lit(0).cast("long"))).drop("cell").dropDuplicates(["class"]))
        near = scratch.save(_tested(_with_ends(pairs, sets, "point"), _bounded, percent))  # points are a sixteenth of sets
        links = scratch.save(_tested(_with_ends(near, sets, "shingles"), _linked, percent))
        scratch.drop(sets, near)
        return links

    def named(rows: DataFrame) -> DataFrame:
        """``rows`` with the component that their class is in by now."""
        own = joined.select(F.col("u").alias("class"), F.col("v").alias("component"))
        return rows.join(own, "class", "left").withColumn("component", F.coalesce("component", "class"))

    def open_cells(members: DataFrame) -> DataFrame:
        """(key, size, class, n) of ``members`` (key, class, n, component) in cells of several components."""
        cells = members.groupBy("key").agg(F.count(F.lit(1)).alias("size"), F.min("component").alias("low"), F.max("component").alias("high"), F.min("n").alias("least"), F.max("n").alias("most"))
        cells = cells.filter(f"low <> high AND (size > 2 OR least * 100 >= most * {percent})").select("key", "size")
        return members.join(cells, "key").select("key", "size", "class", "n")

    def cells_of(rows: DataFrame, work: Callable) -> DataFrame:
        """The distinct pairs that ``work`` finds in the cells of ``rows``."""
        pairs = scratch.save(_mapped(rows.repartition("cell").sortWithinPartitions("cell"), work, percent).distinct())
        made.append(pairs)
        return pairs

    held = scratch.save(open_cells(named(classes.select("class", "n", "prefix")).select("class", "component", "n", F.explode("prefix").alias("key"))))
    heads = scratch.save(held.groupBy("class").agg(F.slice(F.sort_array(F.collect_list("key")), 1, HEAD).alias("head")))
    made += [held, heads]
    if not count_links:
        few = heads.select("class", F.explode(F.slice("head", 1, NEAREST)).alias("key")).join(classes.select("class", "n"), "class")
        sizes = few.groupBy("key").agg(F.count(F.lit(1)).alias("size"), F.sum(F.lit(0)).alias("all"))
        near = named(in_parts(few, sizes).select("cell", "class", "n")).join(classes.select("class", "point"), "class")
        pairs = cells_of(near.select("cell", "class", "component", "n", "point"), _nearest_in_cell)
        if not pairs.isEmpty():
            links = verified(pairs)
            if not links.isEmpty():
                made += [edges, joined, links]
                edges = scratch.save(edges.union(links))
                joined = components(edges, scratch)
                held = scratch.save(open_cells(named(held.select("key", "class", "n"))))
                made.append(held)
    crossed = named(_crossed(held, percent)).join(classes.select("class", "n", "point"), "class").join(heads, "class")
    pairs = cells_of(crossed.select("cell", "class", "component", "n", "point", "key", "head"), _pairs_in_cell)
    more = None
    if not pairs.isEmpty():
        more = verified(pairs)
        if not more.isEmpty():
            made.append(joined)
            joined = components(edges.union(more), scratch)

    lowest = scratch.save(classes.join(joined.withColumnRenamed("u", "class"), "class", "left").select("class", "doc_id", "held", F.coalesce("v", "class").alias("root")))
    roots = lowest.groupBy("root").agg(F.min("doc_id").alias("component_id"), F.count(F.lit(1)).alias("size"))
    found = looked_up(lowest, roots, "root", "size", ["component_id"]).select("class", "component_id", "held", "root")
    if count_links:
        ways = (more if more is not None else edges).select("u", "v")
        ends = ways.union(ways.select("v", "u")).join(lowest.select(F.col("class").alias("v"), "held"), "v").groupBy("u").agg(F.sum("held").alias("others"))
        found = found.join(ends.withColumnRenamed("u", "class"), "class", "left").withColumn("n_links", F.col("held") - 1 + F.coalesce("others", F.lit(0)))
    found = scratch.save(found)
    scratch.drop(*{t._tidelog_path: t for t in (classes, edges, joined, lowest, *made, *([more] if more is not None else []))}.values())
    component = F.when(F.col("doc_id").isNull(), F.lit(None).cast("long")).when(F.col("n") == 0, F.col("doc_id")).otherwise(F.col("component_id"))
    out = [F.col("n").alias("n_shingles"), component.alias("component_id")]
    if count_links:
        out.append(F.when(F.col("doc_id").isNull() | (F.col("n") == 0), 0).otherwise(F.coalesce("n_links", F.lit(0))).alias("n_links"))
    own = rows.select("doc_id", "text_hash", "n", F.when(F.col("doc_id").isNotNull() & (F.col("n") > 0), F.col("class")).alias("class"))
    return looked_up(own, found, "class", "held", ["component_id", "root", *(["n_links"] if count_links else [])]).select("doc_id", *out, "root", "text_hash")


def _crossed(held: DataFrame, percent: int) -> DataFrame:
    """Cells of the second pass. A shingle's cell over ``CELL`` classes is split into bands of set size, each
    class in its own and the next larger one, and a large cell into parts, with a cell for each pair of parts."""
    band: Column = F.floor(F.log(F.col("n").cast("double")) / float(np.log(100 / percent))).cast("int")
    banded = held.withColumn("band", F.explode(F.when(F.col("size") > CELL, F.array(band, band + 1)).otherwise(F.array(F.lit(-1)))))
    counts = banded.filter("band >= 0").groupBy("key", "band").agg(F.ceil(F.count(F.lit(1)) / CELL).cast("int").alias("parts"))
    dealt = banded.join(counts, ["key", "band"], "left").withColumn("parts", F.coalesce("parts", F.lit(1)))
    own = F.pmod(F.xxhash64("class"), F.col("parts")).cast("int")
    dealt = dealt.withColumn("own", own).withColumn("other", F.explode(F.expr("sequence(0, parts - 1)")))
    return dealt.select(F.xxhash64("key", "band", F.least("own", "other"), F.greatest("own", "other")).alias("cell"), "class", "key")


def _with_ends(pairs: DataFrame, sets: DataFrame, column: str) -> DataFrame:
    left = sets.select(F.col("class").alias("u"), F.col("n").alias("a"), F.col(column).alias("x"))
    right = sets.select(F.col("class").alias("v"), F.col("n").alias("b"), F.col(column).alias("y"))
    return pairs.join(left, "u").join(right, "v").select("u", "v", "a", "b", "x", "y")


def _bounded(a: int, b: int, x: bytes, y: bytes, percent: int) -> bool:
    one, other = counts_of(x), counts_of(y)
    groups = min(len(one), len(other))
    return int(np.minimum(folded(one, groups), folded(other, groups)).sum()) * (100 + percent) >= percent * (a + b)


def _linked(a: int, b: int, x: bytes, y: bytes, percent: int) -> bool:
    return linked(np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64), percent)


def _tested(pairs: DataFrame, test: Callable, percent: int) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            u, v, *ends = (c.to_pylist() for c in batch.columns)
            ok = [test(*e, percent) for e in zip(*ends)]
            yield pa.RecordBatch.from_arrays([pa.array([n for n, k in zip(c, ok) if k], pa.int64()) for c in (u, v)], names=["u", "v"])

    return pairs.mapInArrow(run, "u long, v long")
