"""N-gram Jaccard self-join by chosen paths.

A document is the set of its five-word shingles (words: runs of letters and digits, lower case). In each run a set walks down a
path: at every node it samples one of its shingles, by the least value of a hash that is seeded with the run and the path so
far, so two sets stay together as long as they sample shared shingles. A bucket (sets with the same path) of at most LIMIT sets is
brute-forced where the walk meets it; a larger one is split again by the next sampled shingle. Runs repeat until a pair at the
threshold has shared its path to the end with the target probability: 1 - (1 - t^depth)^runs.

A bucket that is large at the end of its path is brute-forced in tiles of LIMIT sets against each other, up to TILES of them. Sets in
still larger ones (many texts with much boilerplate in common) walk again in another round, on fresh samples, along longer paths
and in more runs. What is large at the end of the last round shares more shingles than texts below the threshold are
likely to; it is brute-forced in tiles whatever its size, so none is dropped. Each round misses a pair at the threshold with probability
1 - RECALL at most; pairs above it are missed less often.

Within a bucket a pair is looked at only in the first run whose bucket it shares, if sizes allow the threshold and a sketch of 64
bins doesn't put it far below (more than five standard deviations); then only do whole sets move, once for each bucket in which
they have a candidate, and the exact similarity decides where the sets are. Sets that are equal are one node from the start. What is emitted is a
row per set and bucket (a count of links and the least set it is linked with), never pairs; classes are the connected components.

Buckets above the limit are known to every task, as a broadcast of HOT_BUCKETS of them at most. Where a level has more, no list is made: every
bucket of that level is split, which the number of runs allows for, since the target probability is that of whole paths. The limit is the
same for any number of sets. At the end of the paths the sets that share a large bucket are dealt to its tiles in the shuffle, with the
bucket's size joined to them where there are too many such buckets to broadcast.

Memory: an Arrow batch of texts; the sketches, then the sets, of a bucket or of two tiles; compared in strips of STRIP sets.
Counting every link of a group of g different near copies takes g^2 / 2 comparisons of sketches; that is the price of n_links.

Defined results: null, empty and word-less texts have no set, no links, and a class of their own; texts of one to four words are one
shingle; repeated rows share a class; a null doc_id is never a class id unless its class has no other; other columns are ignored;
an empty table gives an empty result. Texts are fetched and removed by doc_id and a hash of the text, so rows without a doc_id, and
different texts with one doc_id, count like any others.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quire.llm.common import KeyFilter, compact, cut, gather, join_groups, kept, modest_batches, sized, small_side
from quire.llm.components import components

WORDS, THRESHOLD, LIMIT, TILES, RECALL, BINS, STRIP = 5, 0.8, 256, 4, 0.999, 64, 256
#: Lengths at which the paths of each round are looked at; the last is their end.
ROUNDS = ((1, 2, 3), (4, 8))
#: Most large buckets of a level that every task is told of.
HOT_BUCKETS = 1 << 18
_WORD = re.compile(r"\w+")
_REMEMBER = 300_000
_M1, _M2, _M3 = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x100000001B3)
_S = np.uint64(31)


def runs_for(threshold: float = THRESHOLD, depth: int = 3, recall: float = RECALL) -> int:
    return math.ceil(math.log(1 - recall) / math.log(1 - threshold**depth))


def _mix(x: np.ndarray) -> np.ndarray:
    x = x * _M1
    x ^= x >> _S
    x *= _M2
    return x ^ (x >> _S)


class Shingler:
    """Sorted, distinct 64-bit hashes of the word shingles of texts."""

    def __init__(self, width: int = WORDS):
        self.width, self.words = width, {}

    def shingles(self, text: str | None) -> np.ndarray:
        found = _WORD.findall((text or "").lower())
        if not found:
            return np.zeros(0, "u8")
        known = self.words
        if missing := [w for w in set(found) if w not in known]:
            if len(known) + len(missing) > _REMEMBER:
                known.clear()
                missing = set(found)
            for w in missing:
                known[w] = xxhash.xxh64_intdigest(w)
        h = np.fromiter([known[w] for w in found], "u8", len(found))
        width = min(self.width, len(h))
        out = np.full(len(h) - width + 1, width, "u8")
        for k in range(width):
            out = out * _M3 + h[k : len(h) - width + 1 + k]
            out ^= out >> _S
        return np.unique(_mix(out))


def paths(tokens: np.ndarray, runs: int, depth: int, first: int = 0) -> np.ndarray:
    """runs x depth path hashes of a set; runs are numbered from first."""
    seeds = _mix(np.arange(first + 1, first + runs + 1, dtype="u8"))
    out = np.empty((runs, depth), "u8")
    for d in range(depth):
        sampled = tokens[np.argmin(_mix(tokens[None, :] ^ seeds[:, None]), axis=1)] if len(tokens) < 4096 else np.array([tokens[np.argmin(_mix(tokens ^ s))] for s in seeds], "u8")
        seeds = _mix(seeds + sampled * _M3)
        out[:, d] = seeds
    return out


def sketch(tokens: np.ndarray) -> np.ndarray:
    """A byte for each of BINS bins, which the hashes of the set are dealt to: of the least hash in it, 0 in an empty bin. Of the bins
    that either set fills, the share where both have one byte estimates their similarity.
    """
    h = np.sort(_mix(tokens ^ _M2))
    at = np.searchsorted(h, np.arange(BINS, dtype="u8") << np.uint64(64 - BINS.bit_length() + 1))
    full = np.diff(np.append(at, len(h))) > 0
    return np.where(full, (h[np.minimum(at, len(h) - 1)] >> np.uint64(8)) % np.uint64(255) + np.uint64(1), 0).astype("u1")


def node_of(tokens: np.ndarray) -> int:
    return int(np.array(xxhash.xxh64_intdigest(tokens.tobytes()), "u8").astype("i8"))


def _signer(runs: int, depth: int, first: int = 0):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingler = kept("shingles", Shingler)
        for b in batches:
            for at in range(0, b.num_rows, 1000):
                part = b.slice(at, 1000)
                nodes, sizes, walks, sketches = [], [], [], []
                for text in part.column("text").to_pylist():
                    tokens = shingler.shingles(text)
                    some = len(tokens) > 0
                    nodes.append(node_of(tokens) if some else None)
                    sizes.append(len(tokens))
                    walks.append(paths(tokens, runs, depth, first).tobytes() if some else None)
                    sketches.append(sketch(tokens).tobytes() if some else None)
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), part.column("key"), pa.array(nodes, pa.int64()), pa.array(sizes, pa.int64()), pa.array(walks, pa.binary()), pa.array(sketches, pa.binary())], ["doc_id", "key", "node", "size", "walks", "sketch"])

    return run


_SIGNED = "doc_id long, key long, node long, size long, walks binary, sketch binary"


def _sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The sets of texts, each once a task."""
    shingler, seen = kept("shingles", Shingler), set()
    for b in batches:
        for at in range(0, b.num_rows, 1000):
            found = {node_of(x): x.tobytes() for x in map(shingler.shingles, b.column("text").slice(at, 1000).to_pylist())}
            found = {n: x for n, x in found.items() if n not in seen}
            seen.update(found)
            yield pa.RecordBatch.from_arrays([pa.array(found.keys(), pa.int64()), pa.array(found.values(), pa.binary())], ["node", "tokens"])


# buckets


def _walks(column: pa.Array, runs: int, depth: int) -> np.ndarray:
    """rows x runs x depth."""
    return np.frombuffer(b"".join(column.to_pylist()), "u8").reshape(-1, runs, depth)


def _bucket(walks: np.ndarray, level: int, run: np.ndarray) -> np.ndarray:
    """The buckets at a level: the path so far, with its run."""
    return _mix(walks[:, :, level - 1] + run[None, :] * _M3)


def _members(runs: int, depth: int, first: int, level: int, above: np.ndarray | None, before: int):
    """The buckets at a level of all sets, or, with above, of those whose bucket at the level before is one of these."""
    run_ids = np.arange(first, first + runs, dtype="u8")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                walks = _walks(b.column("walks"), runs, depth)
                here = _bucket(walks, level, run_ids)
                if above is not None:
                    here = here[np.isin(_bucket(walks, before, run_ids), above)]
                yield pa.RecordBatch.from_arrays([pa.array(here.ravel().astype("i8"))], ["bucket"])

    return run


def _hot(sets: DataFrame, rows: int, runs: int, levels: tuple[int, ...], first: int, limit: int) -> tuple[list[np.ndarray | None], dict[int, int] | DataFrame]:
    """For each level the buckets of more than limit sets within such buckets of the level before, or None where there are more than HOT_BUCKETS: then
    all count as large. And the sizes of those at the end of the paths, as a table (bucket, n) where there are so many.
    """
    out: list[np.ndarray | None] = []
    ends: dict[int, int] | DataFrame = {}
    for k, level in enumerate(levels):
        found = sets.select("walks").mapInArrow(_members(runs, levels[-1], first, level, out[-1] if out else None, levels[k - 1]), "bucket long")
        large = found.groupBy("bucket").agg(F.count("*").alias("n")).where(F.col("n") > limit)
        n = 0
        if rows * runs > limit * HOT_BUCKETS:  # else there can't be too many
            large, n = sized(large)
        if n > HOT_BUCKETS:
            out.append(None)
            ends = large if k + 1 == len(levels) else ends
            continue
        told = large.collect()  # HOT_BUCKETS rows at most
        ids = np.array([r[0] for r in told], "i8").astype("u8")
        out.append(np.sort(ids))
        if k + 1 == len(levels):
            ends = dict(zip(ids.tolist(), [r[1] for r in told], strict=True))
        if not told:
            break
    return out, ends


def _record(leaves: int) -> np.dtype:
    return np.dtype([("node", "<i8"), ("key", "<i8"), ("size", "<u4"), ("run", "<u4"), ("tile", "<u4"), ("leaves", "<u4", (leaves,)), ("sketch", "u1", (BINS,))])


def _leaves(walks: np.ndarray, levels: tuple[int, ...], first: int, hot: list[np.ndarray | None]) -> tuple[np.ndarray, np.ndarray]:
    """The bucket that each set (row) ends in in each run (column), and whether that is a hot one. hot: buckets by level."""
    run_ids = np.arange(first, first + walks.shape[1], dtype="u8")
    leaf = _bucket(walks, levels[0], run_ids)
    large = _is_hot(leaf, hot[0])
    for k in range(1, len(levels)):
        if not large.any():
            break
        leaf = np.where(large, _bucket(walks, levels[k], run_ids), leaf)
        large &= _is_hot(leaf, hot[k])
    return leaf, large


def _is_hot(leaf: np.ndarray, hot: np.ndarray | None) -> np.ndarray:
    return np.ones(leaf.shape, bool) if hot is None else np.isin(leaf, hot)


def _short(leaf: np.ndarray) -> np.ndarray:
    """Four bytes of a bucket, never 0."""
    return (leaf >> np.uint64(32)).astype("u4") | np.uint32(1)


def _dealer(runs: int, levels: tuple[int, ...], first: int, hot: list[np.ndarray | None], tiles: dict[int, int] | None, column: str):
    """Rows (leaf, at, raw) for each set and run. tiles: their number for large buckets, others of which are left to the next round; None: large
    buckets are dealt like others here, and to tiles later.
    """
    known = np.sort(np.array(list(tiles or ()), "u8"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for at in range(0, b.num_rows, 2000):
                part = b.slice(at, 2000)
                walks = _walks(part.column("walks"), runs, levels[-1])
                leaf, large = _leaves(walks, levels, first, hot)
                large &= tiles is not None
                tiled = large & np.isin(leaf, known)
                own = np.where(large & ~tiled, np.uint32(0), _short(leaf))
                old = [np.frombuffer(x, "<u4") for x in part.column(column).to_pylist()] if column in part.schema.names else []
                rows = np.zeros(walks.shape[:2], _record(runs + (len(old[0]) if old else 0)))
                rows["node"], rows["key"], rows["size"] = part.column("node").to_numpy()[:, None], part.column("key").to_numpy()[:, None], part.column("size").to_numpy()[:, None]
                rows["run"] = np.arange(first, first + runs)[None, :]
                rows["leaves"] = (np.concatenate([np.stack(old), own], axis=1) if old else own)[:, None, :]
                rows["sketch"] = np.frombuffer(b"".join(part.column("sketch").to_pylist()), "u1").reshape(-1, 1, BINS)
                yield _dealt(leaf[~large], np.zeros(int((~large).sum()), "i8"), rows[~large])
                if tiled.any():
                    yield from _spread(leaf[tiled], rows[tiled], np.array([tiles[x] for x in leaf[tiled].tolist()]))

    return run


def _spread(leaf: np.ndarray, rows: np.ndarray, tiles: np.ndarray) -> Iterator[pa.RecordBatch]:
    """Rows of large buckets, which have so many tiles: a set goes to every pair of tiles with its own."""
    own = (_mix(rows["node"].astype("u8")) % tiles.astype("u8")).astype("i8")
    for lo in range(0, len(tiles), 2000):
        few = slice(lo, lo + 2000)
        times = tiles[few]
        other = np.arange(times.sum()) - np.repeat(np.cumsum(times) - times, times)
        mine = np.repeat(own[few], times)
        copies = np.repeat(rows[few], times)
        copies["tile"] = mine
        yield _dealt(np.repeat(leaf[few], times), (np.minimum(other, mine) << 32) + np.maximum(other, mine) + 1, copies)


def _tiler(leaves: int, limit: int):
    """Rows (leaf, raw, n) of buckets of n sets, dealt to their tiles."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                rows = np.frombuffer(b"".join(b.column("raw").to_pylist()), _record(leaves))
                yield from _spread(b.column("leaf").to_numpy().astype("u8"), rows, -(-b.column("n").to_numpy() // limit))

    return run


def _dealt(leaf: np.ndarray, at: np.ndarray, rows: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(leaf.astype("i8")), pa.array(at), _raw(rows)], ["leaf", "at", "raw"])


def _raw(rows: np.ndarray) -> pa.Array:
    return pa.array([], pa.binary()) if not len(rows) else pa.FixedSizeBinaryArray.from_buffers(pa.binary(rows.dtype.itemsize), len(rows), [None, pa.py_buffer(np.ascontiguousarray(rows).tobytes())]).cast(pa.binary())


def _groups(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.Table]:
    """The rows of each run of equal (leaf, at) that has two or more, from batches sorted by them."""
    held: pa.Table | None = None
    for b in batches:
        for start in range(0, b.num_rows, 4096):
            t = pa.Table.from_batches([b.slice(start, 4096)])
            t = pa.concat_tables([held, t]) if held is not None else t
            leaf, at = t.column("leaf").to_numpy(), t.column("at").to_numpy()
            edges = np.flatnonzero((leaf[1:] != leaf[:-1]) | (at[1:] != at[:-1])) + 1
            edges = np.concatenate([[0], edges])
            for a, z in zip(edges[:-1], edges[1:], strict=True):
                if z - a > 1:
                    yield t.slice(a, z - a)
            held = t.slice(edges[-1])
    if held is not None and held.num_rows > 1:
        yield held


def _pairs(rows: np.ndarray, tiled: bool, threshold: float) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Places (a, b) in rows, which are sorted by size, of the pairs that are to be verified in this bucket; by strips of a."""
    size, node, leaves, marks = rows["size"].astype("i8"), rows["node"], rows["leaves"], rows["sketch"]
    run_at, n = int(rows["run"][0]), len(rows)
    ends = np.searchsorted(size, np.floor(size / threshold + 1e-9), "right")  # as large as the threshold allows, or smaller
    for lo in range(0, n, STRIP):
        hi = min(lo + STRIP, n)
        end = int(ends[hi - 1])
        ok = np.arange(lo + 1, end + 1)[None, :] > np.arange(lo + 1, hi + 1)[:, None]
        ok &= np.arange(lo, end)[None, :] < ends[lo:hi, None]
        ok &= node[lo:hi, None] != node[None, lo:end]
        if tiled:
            ok &= rows["tile"][lo:hi, None] != rows["tile"][None, lo:end]
        for r in range(run_at):
            ok &= (leaves[lo:hi, None, r] != leaves[None, lo:end, r]) | (leaves[lo:hi, None, r] == 0)
        a, b = np.nonzero(ok)
        a, b = a + lo, b + lo
        near = np.zeros(len(a), bool)
        for x in range(0, len(a), 1 << 16):
            one, two = marks[a[x : x + (1 << 16)]], marks[b[x : x + (1 << 16)]]
            filled = ((one | two) != 0).sum(axis=1)
            same = ((one == two) & (one != 0)).sum(axis=1)
            near[x : x + (1 << 16)] = same >= threshold * filled - 5 * np.sqrt(threshold * (1 - threshold) * filled)
        if near.any():
            yield a[near], b[near]


def _opened(group: pa.Table, leaves: int) -> tuple[np.ndarray, np.ndarray, bool]:
    """The records of a group by size, their order in the group, and whether it is a pair of different tiles."""
    rows = np.frombuffer(b"".join(group.column("raw").to_pylist()), _record(leaves))
    order = np.lexsort([rows["node"], rows["size"]])
    at = int(group.column("at")[0].as_py()) - 1
    return rows[order], order, at >= 0 and at >> 32 != at & 0xFFFFFFFF


def _candidates(threshold: float, leaves: int):
    """Of each bucket the rows that have a partner to be verified."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for g in _groups(batches):
            rows, order, tiled = _opened(g, leaves)
            wanted = np.zeros(len(rows), bool)
            for a, b in _pairs(rows, tiled, threshold):
                wanted[a] = wanted[b] = True
            if wanted.any():
                part = g.take(pa.array(np.sort(order[wanted])))
                records = np.frombuffer(b"".join(part.column("raw").to_pylist()), _record(leaves))
                cols = [part.column(c).combine_chunks() for c in ("leaf", "at", "raw")]
                yield pa.RecordBatch.from_arrays([*cols, pa.array(records["node"].copy()), pa.array(records["key"].copy())], ["leaf", "at", "raw", "node", "key"])

    return run


class _Union:
    """Places of a bucket, joined."""

    def __init__(self, n: int):
        self.up = list(range(n))

    def top(self, x: int) -> int:
        while self.up[x] != x:
            self.up[x] = self.up[self.up[x]]
            x = self.up[x]
        return x

    def join(self, x: int, y: int) -> None:
        x, y = self.top(x), self.top(y)
        self.up[max(x, y)] = min(x, y)


def _verify(threshold: float, leaves: int):
    """Exact links within each bucket: of each set their number, and the least set it hangs together with."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for g in _groups(batches):
            rows, order, tiled = _opened(g, leaves)
            held = g.column("tokens").to_pylist()
            sets = [np.frombuffer(held[i], "u8") for i in order]
            starts = np.concatenate([[0], np.cumsum([len(x) for x in sets])])
            vocab, local = np.unique(np.concatenate(sets), return_inverse=True)
            mark = np.zeros(len(vocab), "u1")
            links, union = np.zeros(len(rows), "i8"), _Union(len(rows))
            for a, b in _pairs(rows, tiled, threshold):
                for x in np.unique(a).tolist():
                    partners = b[a == x]
                    own = local[starts[x] : starts[x + 1]]
                    mark[own] = 1
                    low, high = int(partners[0]), int(partners[-1]) + 1
                    if starts[high] - starts[low] <= 4 * (starts[partners + 1] - starts[partners]).sum():
                        shared = np.add.reduceat(mark[local[starts[low] : starts[high]]], starts[low:high] - starts[low], dtype="i8")[partners - low]
                    else:
                        shared = np.array([mark[local[starts[p] : starts[p + 1]]].sum(dtype="i8") for p in partners.tolist()])
                    mark[own] = 0
                    both = len(own) + starts[partners + 1] - starts[partners]
                    found = partners[shared >= threshold * (both - shared) - 1e-9]
                    links[x] += len(found)
                    links[found] += 1
                    for p in found.tolist():
                        union.join(x, p)
            some = np.flatnonzero(links)
            if len(some):
                node = rows["node"]
                tops = np.array([union.top(int(i)) for i in some])
                least = {t: node[some[tops == t]].min() for t in np.unique(tops).tolist()}
                yield pa.RecordBatch.from_arrays([pa.array(node[some].copy()), pa.array(links[some]), pa.array([int(least[t]) for t in tops.tolist()], pa.int64())], ["node", "links", "root"])

    return run


# the join


def _keyed(docs: DataFrame) -> DataFrame:
    """doc_id, text and key: a hash of both, the same in every scan."""
    return docs.select("doc_id", "text", F.xxhash64("doc_id", "text").alias("key"))


def _texts(docs: DataFrame, keys: DataFrame, rows: int) -> DataFrame:
    """doc_id, text, key of the rows with these keys (distinct); other rows don't move."""
    maybe = KeyFilter(keys, "key", rows).mark(_keyed(docs), "key", "maybe").where("maybe").drop("maybe")
    return maybe.join(small_side(keys, rows), "key", "left_semi")


def _linked(docs: DataFrame, dealt: DataFrame, leaves: int, threshold: float) -> DataFrame:
    """node, links, root from the rows that _dealer made."""
    by = ["leaf", "at"]
    tiled = dealt.repartition(*by).sortWithinPartitions(*by)
    wanted = cut(tiled.mapInArrow(_candidates(threshold, leaves), "leaf long, at long, raw binary, node long, key long"))
    ids, rows = sized(wanted.select("key").distinct())
    sets = _texts(docs, ids, rows).select("text").mapInArrow(_sets, "node long, tokens binary")
    sets = sets.groupBy("node").agg(F.first("tokens").alias("tokens"))  # rows alike in doc_id and text
    held = wanted.drop("key").join(sets, "node").select(*by, "raw", "tokens").repartition(*by).sortWithinPartitions(*by)
    return held.mapInArrow(_verify(threshold, leaves), "node long, links long, root long")


def _rounds(docs: DataFrame, sets: DataFrame, rows: int, threshold: float, rounds: tuple[tuple[int, ...], ...], limit: int, recall: float) -> DataFrame:
    """node, links, root of all rounds. sets: node, key, size, walks (of the first round), sketch."""
    found, first, held = None, 0, 0
    shape = "leaf long, at long, raw binary"
    for k, levels in enumerate(rounds):
        runs = runs_for(threshold, levels[-1], recall)
        hot, ends = _hot(sets, rows, runs, levels, first, limit)
        last = k + 1 == len(rounds)
        deep = np.zeros(0, "u8")
        if isinstance(ends, DataFrame):
            # too many large buckets to tell every task of: their sizes are joined to the rows
            dealt = cut(sets.mapInArrow(_dealer(runs, levels, first, hot, None, "old"), shape))
            sizes = ends.withColumnRenamed("bucket", "leaf")
            large = join_groups(dealt, sizes, "leaf", "n").select("leaf", "raw", "n").mapInArrow(_tiler(held + runs, limit), shape)
            dealt = dealt.join(sizes, "leaf", "left_anti").unionByName(large)
        else:
            deep = np.sort(np.array([x for x, n in ends.items() if not last and n > TILES * limit], "u8"))
            tiles = {x: -(-n // limit) for x, n in ends.items() if last or n <= TILES * limit}
            dealt = sets.mapInArrow(_dealer(runs, levels, first, hot, tiles, "old"), shape)
        now = cut(_linked(docs, dealt, held + runs, threshold))
        found = now if found is None else found.unionByName(now)
        if not len(deep):
            return found
        # sets of buckets that are large to the end walk again
        again, rows = sized(sets.mapInArrow(_left(runs, levels, first, hot, deep), "node long, key long, size long, sketch binary, old binary"))
        first, held = first + runs, held + runs
        longer = rounds[k + 1][-1]
        walks = _texts(docs, compact(again.select("key"), rows), rows).mapInArrow(_signer(runs_for(threshold, longer, recall), longer, first), _SIGNED)
        sets = cut(again.join(walks.groupBy("node").agg(F.first("walks").alias("walks")), "node"))
    return found


def _left(runs: int, levels: tuple[int, ...], first: int, hot: list[np.ndarray | None], deep: np.ndarray):
    """The sets that end in one of the deep buckets in some run, with the buckets in which they have been compared."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if not b.num_rows:
                continue
            leaf, large = _leaves(_walks(b.column("walks"), runs, levels[-1]), levels, first, hot)
            large &= np.isin(leaf, deep)
            own = np.where(large, np.uint32(0), _short(leaf))
            old = b.column("old").to_pylist() if "old" in b.schema.names else [b""] * b.num_rows
            take = pa.array(np.flatnonzero(large.any(axis=1)))
            before = pa.array([old[i] + own[i].tobytes() for i in take.to_pylist()], pa.binary())
            yield pa.RecordBatch.from_arrays([*(b.column(c).take(take) for c in ("node", "key", "size", "sketch")), before], ["node", "key", "size", "sketch", "old"])

    return run


def _first_key() -> Column:
    """The row of the least doc_id stands for a set; of a set without any, that of the least key."""
    return F.coalesce(F.min(F.when(F.col("doc_id").isNotNull(), F.struct("doc_id", "key")))["key"], F.min("key"))


def _classed(docs: DataFrame, threshold: float = THRESHOLD, rounds: tuple[tuple[int, ...], ...] = ROUNDS, limit: int = LIMIT, recall: float = RECALL) -> tuple[DataFrame, DataFrame]:
    """Rows with a set (doc_id, key, class_id, class_key, n_links, n_equal) and those without (doc_id). class_key: the key of the row that stands for the class."""
    modest_batches(docs.sparkSession)
    signed = cut(_keyed(docs).mapInArrow(_signer(runs_for(threshold, rounds[0][-1], recall), rounds[0][-1]), _SIGNED))
    sets = cut(signed.where("node is not null").groupBy("node").agg(F.min("doc_id").alias("doc_id"), _first_key().alias("key"), F.count("*").alias("n_equal"), F.first("size").alias("size"), F.first("walks").alias("walks"), F.first("sketch").alias("sketch")))
    linked = _rounds(docs, sets.select("node", "key", "size", "walks", "sketch"), sets.count(), threshold, rounds, limit, recall)
    labels = components(linked.select(F.col("node").alias("u"), F.col("root").alias("v")))
    met, rows = sized(linked.groupBy("node").agg(F.sum("links").alias("n_links")).join(labels, "node", "left").select("node", "n_links", F.coalesce("label", "node").alias("label")))
    own = sets.select("node", "doc_id", "key", "n_equal").join(small_side(met, rows), "node", "left").withColumn("label", F.coalesce("label", "node"))
    grouped = own.where("n_links is not null")
    names, rows = sized(grouped.groupBy("label").agg(F.min("doc_id").alias("class_id"), _first_key().alias("class_key")))
    told = own.join(small_side(names, rows), "label", "left")
    own_class = F.col("n_links").isNull()
    found = cut(told.select("node", F.when(own_class, F.col("doc_id")).otherwise(F.col("class_id")).alias("class_id"), F.when(own_class, F.col("key")).otherwise(F.col("class_key")).alias("class_key"), F.coalesce("n_links", F.lit(0)).alias("n_links"), "n_equal"))
    rows = signed.where("node is not null").select("doc_id", "key", "node")
    return join_groups(rows, found, "node", "n_equal").drop("node"), signed.where("node is null").select("doc_id")


def classes(docs: DataFrame, **more) -> DataFrame:
    """A row per document: doc_id, class_id (least doc_id of its class), n_links (other sets it is linked with), n_equal (rows with its very set)."""
    rows, alone = _classed(docs, **more)
    alone = alone.select("doc_id", F.col("doc_id").alias("class_id"), F.lit(0).cast("long").alias("n_links"), F.lit(1).cast("long").alias("n_equal"))
    return rows.drop("key", "class_key").unionByName(alone)


def dedup(docs: DataFrame, **more) -> DataFrame:
    """One document of each class, that of the least doc_id (null comes last), and those without words. Rows that may go move, the others stay."""
    rows = cut(_classed(docs, **more)[0].select("doc_id", "key", "class_key"))
    gone = gather(rows.where("key <> class_key").select(F.col("doc_id").alias("_gone"), F.col("key").alias("_key")).distinct())
    # rows alike in doc_id and text that stand for their class: one of them stays
    twice = gather(rows.where("key = class_key").groupBy(F.col("doc_id").alias("_gone"), F.col("key").alias("_key")).agg(F.count("*").alias("n")).where("n > 1").drop("n"))
    names = docs.columns
    whole = docs.select(F.struct(*(F.col(f"`{c}`") for c in names)).alias("row"), F.col("doc_id").alias("_id"), F.xxhash64("doc_id", "text").alias("h"))
    whole = KeyFilter(gone.unionByName(twice), "_key").mark(whole, "h", "maybe")
    same = (F.col("h") == F.col("_key")) & F.col("_id").eqNullSafe(F.col("_gone"))
    again = whole.where("maybe").join(gone, same, "left_anti")
    if not twice.isEmpty():
        again = again.join(twice, same, "left_anti").unionByName(again.join(twice, same, "left_semi").dropDuplicates(["h", "_id"]))
    return whole.where(~F.col("maybe")).select("row").unionByName(again.select("row")).select("row.*")
