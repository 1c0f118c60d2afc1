"""Exact top-k inner-product search over a pivot-distance index.

Components become integers floor(256 x). With M the largest squared length, a vector x is lifted to (x, sqrt(M - |x|^2)) and a
query q to (q, 0); then |q' - x'|^2 = |q|^2 + M - 2 q.x, so the highest products are the nearest neighbours. The index keys every
lifted vector by its nearest pivot and its distance to it, and is a table sorted by both (and vec_id, so equal vectors spread over
partitions too). A query with a lower bound t on its k-th product needs distances up to r = sqrt(|q|^2 + M - 2t) only; by the
triangle inequality those lie, for each pivot, in the annulus d(q', p) - r .. d(q', p) + r. What lies in no query's annulus isn't
read; a task takes the blocks of its part of the index from the nearest annulus outward, tightens t as it finds more, and leaves out
the queries whose annulus misses a block. The first bounds come from the pivot sample, which is a part of the table. Pivots only
decide what is skipped, never the result; evaluated() tells how many products were computed.

Pivots are fitted on FIT_ROWS vectors at most (those with the least hashes); all vectors are indexed. Queries go in waves of WAVE,
each a broadcast of bounded size, and each wave's few results are written before the next.

Products are exact while squared lengths stay below 2^52. Longer vectors aren't indexed: they meet every query, and as queries every
vector, in integers of any size, which costs a Python product each; such products are cut to the ends of a long.

Memory: a part of the index (PART_CELLS numbers) and the best of a wave. Defined results: null vectors and those with null or
non-finite components take no part, nor do rows without vec_id; shorter vectors count as padded with zeros; of rows with one
vec_id the greatest vector counts as the query, and each vec_id is returned once, with its highest score; ties go to the smaller vec_id;
other columns are ignored, whatever their names; an empty table gives an empty result.
"""

from __future__ import annotations

import math
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quire.llm.common import cut, delete, shared_dir

FIT_ROWS, PIVOTS, WAVE, BLOCK = 2048, 64, 16_384, 512
#: Numbers in a part of the index; in a wave of queries, and in the fitted sample, which have fewer vectors where vectors are long.
PART_CELLS, WAVE_CELLS, FIT_CELLS = 1 << 22, 1 << 22, 1 << 21
_LONG = 2.0**52
_RESULT = "query_id long, vec_id long, score long"


def scaled(vectors: DataFrame) -> DataFrame:
    """vec_id, e (the vector), v (integers as doubles), norm (squared length), long (whether products may not fit a double) of the rows that take part."""
    usable = vectors.select("vec_id", F.col("embedding").cast("array<double>").alias("e")).where("e is not null and vec_id is not null and forall(e, x -> x is not null and not isnan(x) and abs(x) < double('infinity'))")
    rows = usable.select("vec_id", "e", F.transform("e", lambda x: F.floor(x * 256).cast("double")).alias("v"))
    return rows.withColumn("norm", F.aggregate("v", F.lit(0.0), lambda a, x: a + x * x)).withColumn("long", F.col("norm") >= _LONG)


def _matrix(rows: list, dim: int) -> np.ndarray:
    out = np.zeros((len(rows), dim))
    for i, r in enumerate(rows):
        out[i, : len(r)] = r
    return out


def _lift(m: np.ndarray, most: float) -> np.ndarray:
    return np.concatenate([m, np.sqrt(np.maximum(most - (m * m).sum(axis=1, keepdims=True), 0))], axis=1)


def _distances(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.sqrt(np.maximum((a * a).sum(1)[:, None] + (b * b).sum(1)[None, :] - 2 * a @ b.T, 0))


def fit_pivots(sample: np.ndarray, count: int = PIVOTS, rounds: int = 5) -> np.ndarray:
    """Farthest-first choice, then a few rounds of means."""
    if not len(sample):
        return np.zeros((1, sample.shape[1]))
    chosen = [0]
    far = _distances(sample, sample[:1])[:, 0]
    while len(chosen) < min(count, len(sample)) and far.max() > 0:
        chosen.append(int(far.argmax()))
        far = np.minimum(far, _distances(sample, sample[chosen[-1:]])[:, 0])
    pivots = sample[chosen].copy()
    for _ in range(rounds):
        near = _distances(sample, pivots).argmin(axis=1)
        for k in np.unique(near):
            pivots[k] = sample[near == k].mean(axis=0)
    return pivots


def _keyer(pivots: np.ndarray, most: float, dim: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            m = _matrix(b.column("v").to_pylist(), dim)
            d = _distances(_lift(m, most), pivots)
            near = d.argmin(axis=1)
            yield pa.RecordBatch.from_arrays([b.column("vec_id"), pa.array(near.astype("i4")), pa.array(d[np.arange(len(m)), near]), pa.array([r.tobytes() for r in m], pa.binary())], ["vec_id", "pivot", "distance", "raw"])

    return run


class Best:
    """The k best (score, vec_id) of each query, each vec_id once."""

    def __init__(self, bounds: np.ndarray, k: int):
        self.k, self.bounds, self.held = k, bounds.copy(), [{} for _ in bounds]

    def offer(self, q: int, ids: list[int], scores: list) -> None:
        held = self.held[q]
        for v, s in zip(ids, scores, strict=True):
            if v not in held or s > held[v]:
                held[v] = s
        if len(held) >= self.k:
            best = sorted(held.items(), key=lambda x: (-x[1], x[0]))[: self.k]
            self.held[q] = dict(best)
            self.bounds[q] = max(self.bounds[q], best[-1][1])

    def batch(self, ids: np.ndarray) -> pa.RecordBatch:
        rows = [(int(ids[i]), v, int(s)) for i, held in enumerate(self.held) for v, s in held.items()]
        return _told(rows)


def _told(rows: list[tuple]) -> pa.RecordBatch:
    cols = list(zip(*rows, strict=True)) if rows else [(), (), ()]
    return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in cols], ["query_id", "vec_id", "score"])


def _bounder(sample_ids: np.ndarray, sample: np.ndarray, dim: int, k: int):
    """For each query the k-th best product with other vectors of the sample, or minus infinity where there are fewer."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for at in range(0, b.num_rows, 1024):
                part = b.slice(at, 1024)
                m = _matrix([v[:dim] for v in part.column("v").to_pylist()], dim)
                own = part.column("vec_id").to_numpy()
                bounds = np.full(len(m), -np.inf)
                if len(sample) > k:
                    scores = np.where(sample_ids[None, :] == own[:, None], -np.inf, m @ sample.T)
                    bounds = np.partition(scores, -k, axis=1)[:, -k]
                yield pa.RecordBatch.from_arrays([part.column("vec_id"), pa.array([r.tobytes() for r in m], pa.binary()), pa.array(bounds)], ["vec_id", "raw", "bound"])

    return run


def _search(ids: np.ndarray, q: np.ndarray, bounds: np.ndarray, pivots: np.ndarray, most: float, k: int):
    """The best of a part of the index; a row without query_id tells the products computed and possible."""
    dim = q.shape[1]
    to_pivot = _distances(np.concatenate([q, np.zeros((len(q), 1))], axis=1), pivots)
    norms = (q * q).sum(axis=1)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tables = [b for b in batches if b.num_rows]
        if not tables:
            return
        part = pa.Table.from_batches(tables)
        pivot, distance, vec = (part.column(c).to_numpy() for c in ("pivot", "distance", "vec_id"))
        m = np.frombuffer(b"".join(part.column("raw").to_pylist()), "f8").reshape(-1, dim)
        edges = [0, *(np.flatnonzero(np.diff(pivot)) + 1).tolist(), len(pivot)]
        blocks = [(at, min(at + BLOCK, hi)) for lo, hi in zip(edges[:-1], edges[1:], strict=True) for at in range(lo, hi, BLOCK)]
        best, done = Best(bounds, k), 0
        for first in range(0, len(q), 1024):
            mine = slice(first, first + 1024)
            # how near to each query the annulus of a block can be, and so how high a product in it
            gap = np.stack([np.maximum(0, np.maximum(to_pivot[mine, pivot[a]] - distance[a:z].max(), distance[a:z].min() - to_pivot[mine, pivot[a]])) for a, z in blocks], axis=1)
            gap = np.maximum(0, gap * (1 - 1e-9) - 1e-6)
            high = (norms[mine, None] + most - gap * gap) / 2 * (1 + 1e-12) + 1
            for x in np.argsort(-high.max(axis=0), kind="stable").tolist():
                active = np.flatnonzero(high[:, x] >= best.bounds[mine])
                if not len(active):
                    continue
                (a, z), active = blocks[x], active + first
                scores = q[active] @ m[a:z].T
                done += scores.size
                hits = (scores >= best.bounds[active][:, None]) & (vec[None, a:z] != ids[active][:, None])
                for y in np.flatnonzero(hits.any(axis=1)):
                    found = np.flatnonzero(hits[y])
                    if len(found) > k:  # the k-th best here bounds what can count; ties stay
                        least = np.sort(scores[y][found])[-k]
                        top = found[scores[y][found] >= least]
                        if len(np.unique(vec[a:z][top])) >= k:
                            found = top
                    best.offer(int(active[y]), vec[a:z][found].tolist(), scores[y][found].tolist())
        yield best.batch(ids)
        yield _told([(None, done, len(q) * len(m))])

    return run


def integers(e: list[float]) -> list[int]:
    """floor(256 x) of any finite doubles."""
    return [math.floor(x * 256) if abs(x) < 1e300 else int(x) * 256 for x in e]


def _exact(queries: list[tuple[int, list[int]]], k: int):
    """The best of rows (vec_id, e) for a few queries, in integers of any size, cut to a long."""
    low, high = -(1 << 63), (1 << 63) - 1

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best = Best(np.full(len(queries), -np.inf), k)
        for b in batches:
            rows = [(i, integers(e)) for i, e in zip(b.column("vec_id").to_pylist(), b.column("e").to_pylist(), strict=True)]
            for at, (own, q) in enumerate(queries):
                some = [(i, min(high, max(low, sum(map(int.__mul__, q, v))))) for i, v in rows if i != own]
                best.offer(at, [i for i, _ in some], [s for _, s in some])
        yield best.batch(np.array([i for i, _ in queries], "i8"))

    return run


def _run(vectors: DataFrame, queries: DataFrame, k: int) -> tuple[DataFrame, tuple[int, int]]:
    """The k best of each query, and how many products of indexed vectors were computed and possible."""
    spark = vectors.sparkSession
    folder = f"{shared_dir(spark).rstrip('/')}/topk-{uuid.uuid4().hex}"
    rows = scaled(vectors)
    some, long, most, dim = rows.agg(F.count_if(~F.col("long")), F.count_if("long"), F.coalesce(F.max(F.when(~F.col("long"), F.col("norm"))), F.lit(0.0)), F.coalesce(F.max(F.size("v")), F.lit(0))).first()
    short = rows.where(~F.col("long"))
    sample = {r[0]: r[1] for r in short.orderBy(F.xxhash64("vec_id"), "vec_id", "v").limit(min(FIT_ROWS, max(1, FIT_CELLS // max(dim, 1)))).select("vec_id", "v").collect()}
    sample_ids, sample_m = np.array(list(sample), "i8"), _matrix(list(sample.values()), dim)
    pivots = fit_pivots(_lift(sample_m, most))
    keyed = short.select("vec_id", "v").mapInArrow(_keyer(pivots, most, dim), "vec_id long, pivot int, distance double, raw binary")
    by = ["pivot", "distance", "vec_id"]
    parts = max(spark.sparkContext.defaultParallelism, -(-some * max(dim, 1) // PART_CELLS))
    keyed.repartitionByRange(parts, *by).sortWithinPartitions(*by).write.parquet(f"{folder}/index")
    index = spark.read.parquet(f"{folder}/index")
    asked = scaled(queries).groupBy("vec_id").agg(F.max(F.struct("v", "e", "long")).alias("x")).select("vec_id", "x.*")
    ready = asked.where(~F.col("long")).select("vec_id", "v").mapInArrow(_bounder(sample_ids, sample_m, dim, k), "vec_id long, raw binary, bound double")
    ready.write.parquet(f"{folder}/queries")
    asked.where("long").select("vec_id", "e").write.parquet(f"{folder}/long")
    ready = spark.read.parquet(f"{folder}/queries")
    waves = max(1, -(-ready.count() // min(WAVE, max(1, WAVE_CELLS // max(dim, 1)))))
    done = False

    def add(found: DataFrame) -> None:
        found.groupBy("query_id", "vec_id").agg(F.max("score").alias("score")).write.mode("append").parquet(f"{folder}/found")

    told = [0, 0]
    for wave in range(waves):
        few = sorted(ready.where(F.pmod(F.xxhash64("vec_id"), F.lit(waves)) == wave).collect(), key=lambda r: r["vec_id"])  # about WAVE rows, of WAVE_CELLS numbers
        if not few:
            continue
        ids, q, bounds = np.array([r["vec_id"] for r in few], "i8"), np.frombuffer(b"".join(r["raw"] for r in few), "f8").reshape(len(few), -1), np.array([r["bound"] for r in few])
        got = cut(index.where(_annuli(q, bounds, pivots, most)).select("vec_id", "pivot", "distance", "raw").mapInArrow(_search(ids, q, bounds, pivots, most, k), _RESULT))
        add(got.where("query_id is not null"))
        done = True
        one = got.where("query_id is null").agg(F.coalesce(F.sum("vec_id"), F.lit(0))).first()[0]
        told = [told[0] + one, told[1] + some * len(few)]
        if long:
            exact = [(int(i), [int(x) for x in v]) for i, v in zip(ids, q, strict=True)]
            add(rows.where("long").select("vec_id", "e").mapInArrow(_exact(exact, k), _RESULT))
    wide = spark.read.parquet(f"{folder}/long")
    waves = -(-wide.count() // 64)
    for wave in range(waves):
        exact = [(r["vec_id"], integers(r["e"])) for r in wide.where(F.pmod(F.xxhash64("vec_id"), F.lit(waves)) == wave).collect()]
        if exact:
            add(rows.select("vec_id", "e").mapInArrow(_exact(exact, k), _RESULT))
            done = True
    found = spark.read.parquet(f"{folder}/found") if done else spark.createDataFrame([], _RESULT)
    found = found.groupBy("query_id", "vec_id").agg(F.max("score").alias("score"))
    ranked = found.withColumn("rank", F.expr("row_number() over (partition by query_id order by score desc, vec_id)")).where(F.col("rank") <= k)
    out = cut(ranked.select("query_id", "rank", "vec_id", "score"))
    delete(spark, folder)
    return out, (told[0], told[1])


def _annuli(q: np.ndarray, bounds: np.ndarray, pivots: np.ndarray, most: float):
    """What of the index any query's annuli reach: for each pivot a range of distances."""
    to_pivot = _distances(np.concatenate([q, np.zeros((len(q), 1))], axis=1), pivots)
    reach = np.sqrt(np.maximum((q * q).sum(axis=1) + most - 2 * bounds, 0)) * (1 + 1e-9) + 1e-6
    out = F.lit(False)
    for p in range(len(pivots)):
        low, high = float((to_pivot[:, p] - reach).min()), float((to_pivot[:, p] + reach).max())
        here = F.col("pivot") == p
        out |= here if np.isinf(high) else here & (F.col("distance") >= low) & (F.col("distance") <= high)
    return out


def search(vectors: DataFrame, queries: DataFrame, k: int = 5) -> DataFrame:
    """query_id, rank, vec_id, score: for each row of queries (vec_id, embedding) the k highest products among the other rows of vectors."""
    return _run(vectors, queries, k)[0]


def evaluated(vectors: DataFrame, queries: DataFrame, k: int = 5) -> tuple[int, int]:
    """Products of indexed vectors with queries that a search computes, and all of them."""
    return _run(vectors, queries, k)[1]
