"""A Merkle manifest of a table: a digest a row, a tree for each group (language), a tree over the groups' roots, and proofs checked by folding.

A leaf is the SHA-256 of a row's columns, each as `-` if null, else its UTF-8 byte count, `:` and its value. FAN consecutive nodes (a last run
has fewer, even one) have the SHA-256 of their digests in hexadecimal as parent; what remains of a group is its subroot, and the subroots in the
order of the groups (null first, then by UTF-8 bytes) have the root above them.

The trees are walked in supersteps, as in Pregel, over RDDs. A vertex (tree, layer, place) stands for LOCAL levels of its tree, so it has FAN^LOCAL
children at most. Upward, a vertex sends its digest to its parent; a parent that has all its children hashes them, level by level, and
forwards its own digest in the next superstep; the vertex that holds a whole tree halts, and has its root. Downward, the supersteps run in
reverse: a vertex sends to each child the digests of the child's siblings, level by level, and all that it was sent itself, until each leaf
has its path, folds it, and compares with the root.

Leaves are numbered from sorted ranges of rows, so a group of any size spreads over all tasks; the driver sees one row a partition, and one
digest. One in FAN^LOCAL of the vertices of a layer goes up to the next. Each layer is checkpointed in the shared folder; what a lost executor
held is made again from there. Memory: a vertex and its children.

Defined results: null columns have digests as above, null doc_id comes first, null groups have a tree of their own; empty and long texts are
hashed whole; rows alike in group and doc_id are ordered by their digests, and repeated rows are a leaf each; other columns are
ignored, whatever their names; an empty table has no root and gives no rows; a table of one row has its leaf as root and an empty proof.
"""

from __future__ import annotations

import hashlib
import itertools
import math
from collections.abc import Iterator

import xxhash
from pyspark import RDD, StorageLevel
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quire.llm.common import cut

FAN = 8
#: Levels that a vertex stands for, and children that it has at most; rows of a partition, about.
LOCAL = 4
SPAN, PART_ROWS = FAN**LOCAL, 1 << 15
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")
_TOP = ""
PROVED = "doc_id long, leaf string, subroot string, root string, proof_sha256 string, folded_root string, verified boolean"


def _hash(x: str) -> str:
    return hashlib.sha256(x.encode()).hexdigest()


def leaf(**values: Column) -> Column:
    """The digest of a row, of FIELDS or of what is given in place of some."""
    said = []
    for name in FIELDS:
        value = values.get(name, F.col(name)).cast("string")
        said.append(F.coalesce(F.concat(F.octet_length(value).cast("string"), F.lit(":"), value), F.lit("-")))
    return F.sha2(F.concat(*said), 256)


def _place(key: tuple[str, int, int]) -> int:
    tree, layer, at = key
    return xxhash.xxh64_intdigest(f"{layer}|{at}|{tree}".encode("utf-8", "surrogatepass"))


def _tree(group: str | None) -> str:
    return "-" if group is None else f"={group}"


def _order(tree: str) -> tuple[bool, bytes]:
    return tree != "-", tree.encode()


# leaves in their places


def _ranged(leaves: DataFrame, parts: int) -> DataFrame:
    """Sorted within partitions that are ranges of the order; a repeated row is split from its like by rid."""
    by = ["tree", "doc_id", "leaf", "rid"]
    return cut(leaves.repartitionByRange(parts, *by).sortWithinPartitions(*by))


def _counted(index: int, rows: Iterator[tuple]) -> Iterator[tuple]:
    """Of a partition: its number, its first group and that group's rows, its last group and that group's rows, the number of groups, and the
    rows of the largest one.
    """
    first = last = None
    groups = most = 0
    for tree, run in itertools.groupby(rows, key=lambda r: r[0]):
        last = (tree, sum(1 for _ in run))
        first, groups, most = first or last, groups + 1, max(most, last[1])
    if last:
        yield index, *first, *last, groups, most


class _Places:
    """Where the partitions' first and last groups begin and end, from a row a partition; the number of groups, and the rows of the largest one."""

    def __init__(self, seen: list[tuple]):
        #: Rows of a partition's first group that lie before it, and of its last group that lie behind it.
        self.before, self.after = {}, {}
        self.trees, self.most = 0, 0
        held = None  # the group that the last partition ended with, and its rows so far
        for index, first, first_rows, last, last_rows, groups, most in seen:
            goes_on = held is not None and held[0] == first
            self.before[index] = held[1] if goes_on else 0
            self.trees += groups - goes_on
            held = (last, last_rows + (self.before[index] if groups == 1 else 0))
            self.most = max(self.most, most, held[1], first_rows + self.before[index])
        held = None
        for index, first, first_rows, last, _, groups, _ in seen[::-1]:
            self.after[index] = held[1] if held is not None and held[0] == last else 0
            held = (first, first_rows + (self.after[index] if groups == 1 else 0))

    def number(self, index: int, part: Iterator[tuple]) -> Iterator[tuple]:
        """Rows (tree, doc_id, leaf, claimed), in order, as messages to the vertices of the first layer."""
        groups = itertools.groupby(part, key=lambda r: r[0])
        held, start = next(groups, None), self.before.get(index, 0)
        while held is not None:
            tree, run = _tree(held[0]), list(held[1])  # of one partition
            held = next(groups, None)
            n = start + len(run) + (self.after[index] if held is None else 0)
            for k, (_, doc_id, digest, claimed) in enumerate(run, start):
                yield (tree, 1, k // SPAN), (n, k % SPAN, digest, (doc_id, claimed))
            start = 0


# supersteps


def _kept(rdd: RDD, held: list[RDD]) -> RDD:
    """The same, written to the shared folder by the first action on it; held: what proofs() lets go at its end."""
    rdd = rdd.persist(StorageLevel.MEMORY_AND_DISK)
    rdd.checkpoint()
    held.append(rdd)
    return rdd


def _layers(n: int) -> int:
    layers = 1
    while n > SPAN:
        n, layers = -(-n // SPAN), layers + 1
    return layers


def _levels(n: int, digests: list[str]) -> list[list[str]]:
    """The digests of a vertex by level, from its children to its own; n: nodes of the tree as low as the children."""
    levels = [digests]
    while len(levels[-1]) > 1 if n <= SPAN else len(levels) <= LOCAL:
        low = levels[-1]
        levels.append([_hash("".join(low[k : k + FAN])) for k in range(0, len(low), FAN)])
    return levels


def _completed(met: Iterator[tuple]) -> Iterator[tuple]:
    """Vertices (key, (n, children, digest)) of which every child has sent."""
    for (tree, layer, at), messages in met:
        sent = sorted(messages, key=lambda m: m[1])
        n = sent[0][0]
        if [m[1] for m in sent] != list(range(min(SPAN, n - SPAN * at))):
            raise ValueError(f"a vertex of layer {layer} has {len(sent)} children")
        yield (tree, layer, at), (n, [m[2:] for m in sent], _levels(n, [m[2] for m in sent])[-1][0])


def _to_parents(vertices: Iterator[tuple]) -> Iterator[tuple]:
    for (tree, layer, at), (n, _, digest) in vertices:
        if n > SPAN:
            yield (tree, layer + 1, at // SPAN), (-(-n // SPAN), at % SPAN, digest, None)


def _upward(messages: RDD, layers: int, parts: int, held: list[RDD]) -> tuple[list[RDD], RDD]:
    """The vertices of each layer, and the roots (tree, (layer, digest)) of all trees."""
    found: list[RDD] = []
    for _ in range(layers):
        found.append(_kept(messages.groupByKey(parts, _place).mapPartitions(_completed, preservesPartitioning=True), held))
        messages = found[-1].mapPartitions(_to_parents)
    return found, messages.ctx.union([v.filter(lambda x: x[1][0] <= SPAN).map(lambda x: (x[0][0], (x[0][1], x[1][2]))) for v in found])


def _to_children(met: Iterator[tuple]) -> Iterator[tuple]:
    """To each child of a vertex that has been sent a path: ((tree, layer, place), (child's digest and more, what was told, path)). A path is the digests before and
    behind, level by level.
    """
    for (tree, layer, at), found in met:
        (n, children, _), (told, path) = (next(x for kind, x in found if kind == k) for k in (0, 1))
        levels = _levels(n, [c[0] for c in children])[:-1]
        for slot, (digest, more) in enumerate(children):
            own, k = [], slot
            for level in levels:
                low = k // FAN * FAN
                own.append(("".join(level[low:k]), "".join(level[k + 1 : low + FAN])))
                k //= FAN
            yield (tree, layer - 1, at * SPAN + slot), (digest, more, told, own + path)


def _downward(vertices: list[RDD], roots: RDD, parts: int) -> RDD:
    """The leaves' (digest, more, told, path). roots: ((tree, layer, 0), (told, path))."""
    reached = None
    for layer in range(len(vertices), 0, -1):
        paths = roots.filter(lambda v, layer=layer: v[0][1] == layer)
        if reached is not None:
            paths = paths.union(reached.mapValues(lambda v: v[2:]))
        met = vertices[layer - 1].mapValues(lambda v: (0, v)).union(paths.partitionBy(parts, _place).mapValues(lambda v: (1, v)))
        reached = met.groupByKey(parts, _place).mapPartitions(_to_children)
    return reached.values()


def proofs(leaves: DataFrame) -> DataFrame:
    """PROVED of each row of leaves: tree (string, the group), doc_id (long), leaf, claimed (the digest that is folded along the proof)."""
    spark, sc = leaves.sparkSession, leaves.sparkSession.sparkContext
    narrow = cut(leaves.select("tree", F.col("doc_id").cast("long").alias("doc_id"), "leaf", "claimed", F.monotonically_increasing_id().alias("rid")))
    rows = narrow.count()
    if not rows:
        return spark.createDataFrame([], PROVED)
    parts = max(sc.defaultParallelism, math.ceil(rows / PART_ROWS))
    ordered = _ranged(narrow, parts).select("tree", "doc_id", "leaf", "claimed").rdd.map(tuple)
    places = _Places(sorted(ordered.mapPartitionsWithIndex(_counted).collect(), key=lambda x: x[0]))  # a row a partition
    held: list[RDD] = []
    vertices, subroots = _upward(ordered.mapPartitionsWithIndex(places.number), _layers(places.most), parts, held)
    few, trees = math.ceil(places.trees / PART_ROWS), places.trees
    numbered = _kept(subroots, held).sortBy(lambda v: _order(v[0]), numPartitions=few).zipWithIndex()
    messages = numbered.map(lambda v: ((_TOP, 1, v[1] // SPAN), (trees, v[1] % SPAN, v[0][1][1], (v[0][0], v[0][1][0]))))
    top_vertices, top = _upward(messages, _layers(trees), few, held)
    root = top.first()[1][1]
    told = _downward(top_vertices, sc.parallelize([((_TOP, len(top_vertices), 0), ("", []))], 1), few)
    roots = _kept(told.map(lambda v: ((*v[1], 0), (v[0], v[3]))), held)
    reached = _downward(vertices, roots, parts)

    def fold(part: Iterator[tuple]) -> Iterator[tuple]:
        for digest, (doc_id, claimed), subroot, path in part:
            proof = hashlib.sha256()
            folded = claimed
            for before, after in path:
                proof.update((before + after).encode())
                folded = _hash(before + folded + after)
            yield doc_id, digest, subroot, root, proof.hexdigest(), folded, folded == root

    proved = cut(spark.createDataFrame(reached.mapPartitions(fold), PROVED, verifySchema=False))
    for rdd in held:
        rdd.unpersist()
    return proved


def manifest(docs: DataFrame, claimed: Column | None = None, group: str = "lang") -> DataFrame:
    """PROVED of each row of docs, which has FIELDS. claimed: the digest to prove, such as that of a copy kept elsewhere; the row's own where it
    isn't given.
    """
    own = leaf()
    return proofs(docs.select(F.col(group).cast("string").alias("tree"), "doc_id", own.alias("leaf"), (own if claimed is None else claimed).alias("claimed")))
