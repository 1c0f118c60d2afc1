"""The positional index as ordinary tables, and the ways to read it.

tokens: a row per page with its terms in order. postings: a row per term and page, in buckets by block (BLOCK_PAGES neighbouring pages of a
book) and sorted by term in each, so all that a query asks of a page lies in one bucket and is met there without an exchange; a common term
spreads over all buckets, and a lookup skips what is sorted elsewhere. impacts: a row per term and block with the most that the term can
add to a score there. term_stats and corpus_stats hold what ranking needs of the whole index, so a scope never changes a score.

A one-off query over an index that isn't stored scans tokens and computes term counts row by row, with no exchange at all; a
stored index is read through postings, by the query's terms only, and by the blocks that can matter if only the best are asked for.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quire.functions import text as T
from quire.plans import store as forms

#: Pages of a block; rows of a page of postings within a Parquet file; blocks that are looked up as literals; rows of a side that is broadcast.
BLOCK_PAGES, PAGE_ROWS, FEW_BLOCKS, MAX_BROADCAST_ROWS = 64, 1024, 256, 100_000
#: Postings take about so many times the bytes of the stored tokens.
POSTINGS_BYTES = 2


def block() -> Column:
    """The block of a page."""
    return F.xxhash64("book_id", F.floor(F.col("page_id") / BLOCK_PAGES))


def impacts(postings: DataFrame) -> DataFrame:
    """term, block, n (postings), most: of each class of lengths (powers of two) the greatest tf and the least dl, which bound any score that a
    page of the block can have, whatever the statistics.
    """
    per = postings.groupBy("term", "block", F.floor(F.log2(F.col("dl") + 1)).alias("length")).agg(F.max("tf").alias("tf"), F.min("dl").alias("dl"), F.count("*").alias("n"))
    return per.groupBy("term", "block").agg(F.sum("n").alias("n"), F.collect_list(F.struct("tf", "dl")).alias("most"))


@dataclass
class Stats:
    """Of the whole index: pages, their tokens, and the pages that hold each term."""

    docs: int
    tokens: int
    df: dict[str, int]


def tokens(pages: DataFrame, nfc: bool | None = None) -> DataFrame:
    """doc, book_id, page_id, terms, dl. nfc: None looks whether any body needs it."""
    if nfc is None:
        nfc = T.needs_nfc(pages, "body")
    terms = T.tokens(T.fold(F.col("body"), nfc))
    # exploded from an array of one, so that no later filter or projection has the terms computed again
    return pages.select("doc", "book_id", "page_id", F.explode(F.array(terms)).alias("terms")).withColumn("dl", F.size("terms"))


def postings(tokens: DataFrame) -> DataFrame:
    """term, doc, book_id, page_id, dl, tf, positions: a row per term and page. A page's terms are grouped where the page lies."""
    fields = {f.name: f.dataType.simpleString() for f in tokens.schema.fields}
    kinds = {"term": "string", **{c: fields[c] for c in ("doc", "book_id", "page_id", "dl")}, "tf": "int", "positions": "array<int>"}
    rows = tokens.select("doc", "book_id", "page_id", "dl", "terms")
    return rows.mapInArrow(_grouped, ", ".join(f"{c} {kind}" for c, kind in kinds.items()))


def _grouped(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        # as many pages at a time as have a million terms
        at = 0
        while at < b.num_rows:
            ends = np.cumsum(pc.list_value_length(b.column("terms").slice(at)).to_numpy(zero_copy_only=False))
            n = max(1, int(np.searchsorted(ends, 1_000_000, "right")))
            part = b.slice(at, n)
            at += n
            lists = part.column("terms")
            lengths = pc.list_value_length(lists).to_numpy(zero_copy_only=False)
            terms = lists.flatten().dictionary_encode()
            codes = terms.indices.to_numpy(zero_copy_only=False).astype("i8")
            if not len(codes):
                continue
            page = np.repeat(np.arange(len(lengths)), lengths)
            place = np.arange(len(codes)) - np.repeat(np.cumsum(lengths) - lengths, lengths)
            key = page * len(terms.dictionary) + codes
            order = np.argsort(key, kind="stable")
            first = np.flatnonzero(np.diff(key[order], prepend=-1))
            whose, tf = pa.array(page[order][first]), np.diff(np.append(first, len(codes)))
            places = pa.ListArray.from_arrays(pa.array(np.append(first, len(codes)).astype("i4")), pa.array(place[order].astype("i4")))
            cols = [terms.dictionary.take(pa.array(codes[order][first])), *(part.column(c).take(whose) for c in ("doc", "book_id", "page_id", "dl")), pa.array(tf.astype("i4")), places]
            yield pa.RecordBatch.from_arrays(cols, ["term", "doc", "book_id", "page_id", "dl", "tf", "positions"])


def term_stats(tokens: DataFrame) -> DataFrame:
    """term, df, cf. A page counts once for df; partial counts come before the shuffle."""
    once = F.transform(F.array_distinct("terms"), lambda t: F.struct(t.alias("term"), F.lit(1).alias("df"), F.lit(0).alias("cf")))
    each = F.transform("terms", lambda t: F.struct(t.alias("term"), F.lit(0).alias("df"), F.lit(1).alias("cf")))
    rows = tokens.select(F.explode(F.concat(once, each)).alias("x")).select("x.*")
    return rows.groupBy("term").agg(F.sum("df").alias("df"), F.sum("cf").alias("cf"))


def corpus_stats(tokens: DataFrame) -> DataFrame:
    return tokens.agg(F.count("*").alias("n_docs"), F.coalesce(F.sum("dl"), F.lit(0)).alias("sum_dl"))


def count_of(term: str, terms: Column) -> Column:
    return F.size(F.filter(terms, lambda t: t == term))


def phrase_count(phrase: list[str], terms: Column) -> Column:
    """Starts of the phrase in terms; overlapping ones count each. The terms shifted by each offset are zipped, so the condition is one on
    the elements and nothing outside them is evaluated anew for each.
    """
    shifted = [terms if k == 0 else F.slice(terms, F.lit(k + 1), F.greatest(F.size(terms), F.lit(1))) for k in range(len(phrase))]
    zipped = F.arrays_zip(*(c.alias(f"w{k}") for k, c in enumerate(shifted)))

    def here(x: Column) -> Column:
        out = F.lit(True)
        for k, t in enumerate(phrase):
            out &= x[f"w{k}"] == t
        return F.coalesce(out, F.lit(False))

    return F.size(F.filter(zipped, here))


@dataclass
class Index:
    """An index over pages. Without a path it scans tokens; with one it reads the stored tables, and those of segments that were added
    later: pages of a segment are in no other, so counts add up.
    """

    spark: SparkSession
    tokens: DataFrame
    path: str | None = None
    generation: str = "unstored"
    segments: tuple[str, ...] = ()
    _stats: dict = field(default_factory=dict)
    _tables: dict = field(default_factory=dict)

    def table(self, name: str) -> DataFrame:
        """A stored table; its files are listed once for each generation that is opened."""
        if name not in self._tables:
            rows = self._bucketed(name) if name in ("postings", "impacts") and not self.segments else self.spark.read.parquet(*(f"{p}/{name}" for p in (self.path, *self.segments)))
            if self.segments and name == "term_stats":
                rows = rows.groupBy("term").agg(F.sum("df").alias("df"), F.sum("cf").alias("cf"))
            if self.segments and name == "corpus_stats":
                rows = rows.agg(F.sum("n_docs").alias("n_docs"), F.sum("sum_dl").alias("sum_dl")).withColumn("generation", F.lit(self.generation))
            self._tables[name] = rows
        return self._tables[name]

    def _bucketed(self, name: str) -> DataFrame:
        """A table of the session's catalogue over the stored files, which says how they are bucketed."""
        table = f"quire_{name}_{self.generation}"
        if not self.spark.catalog.tableExists(table):
            folder = f"{self.path}/{name}"
            fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in self.spark.read.parquet(folder).schema.fields)
            buckets = self.spark.read.parquet(f"{self.path}/layout").first()["buckets"]
            self.spark.sql(f"create table if not exists {table} ({fields}) using parquet clustered by (block) sorted by (term, block) into {buckets} buckets location '{folder}'")
        return self.spark.table(table)

    @classmethod
    def over(cls, pages: DataFrame, nfc: bool | None = None) -> Index:
        return cls(pages.sparkSession, tokens(pages, nfc))

    def store(self, path: str, partitions: int | None = None) -> Index:
        """Writes the tables. partitions: buckets of the postings; None takes as many as their bytes ask for."""
        spark, generation = self.spark, uuid.uuid4().hex
        self.tokens.write.mode("overwrite").parquet(f"{path}/tokens")
        held = spark.read.parquet(f"{path}/tokens")
        buckets = partitions or max(spark.sparkContext.defaultParallelism, -(-POSTINGS_BYTES * forms.state(spark, f"{path}/tokens")[0] // forms.PARTITION_BYTES))
        rows = postings(held).withColumn("block", block()).repartition(buckets, "block")
        self._write(rows, f"{path}/postings", f"quire_written_{generation}", buckets, ["term", "block", "doc"])
        spark.createDataFrame([(buckets,)], "buckets int").coalesce(1).write.mode("overwrite").parquet(f"{path}/layout")
        made = Index(spark, held, path, generation)
        self._write(impacts(made.table("postings")), f"{path}/impacts", f"quire_bounds_{generation}", buckets, ["term", "block"])
        stats = made.table("postings").groupBy("term").agg(F.count("*").alias("df"), F.sum("tf").alias("cf"))
        stats.repartitionByRange("term").sortWithinPartitions("term").write.mode("overwrite").parquet(f"{path}/term_stats")
        corpus_stats(held).withColumn("generation", F.lit(generation)).coalesce(1).write.mode("overwrite").parquet(f"{path}/corpus_stats")
        return Index.open(spark, path)

    @staticmethod
    def _write(rows: DataFrame, path: str, table: str, buckets: int, order: list[str]) -> None:
        """rows in buckets by block. Spark writes buckets through a table of the catalogue only; the files stay when that is dropped."""
        spark = rows.sparkSession
        forms.remove(spark, path)
        rows.write.option("path", path).option("parquet.page.row.count.limit", PAGE_ROWS).bucketBy(buckets, "block").sortBy(*order).mode("overwrite").saveAsTable(table)
        spark.sql(f"drop table {table}")

    @classmethod
    def open(cls, spark: SparkSession, path: str, segments: tuple[str, ...] = (), generation: str | None = None) -> Index:
        if generation is None:
            generation = spark.read.parquet(f"{path}/corpus_stats").first()["generation"]
        return cls(spark, spark.read.parquet(*(f"{p}/tokens" for p in (path, *segments))), path, generation, segments)

    def refresh(self) -> Index:
        """The index as it is stored now; another generation if it was built again."""
        return Index.open(self.spark, self.path) if self.path else self

    def stats(self, terms: list[str]) -> Stats:
        """One small job, over whole-index tables."""
        key = json.dumps(sorted(terms))
        if key not in self._stats:
            if self.path:
                n = self.table("corpus_stats").first()
                df = {r["term"]: r["df"] for r in self.table("term_stats").where(F.col("term").isin(terms)).collect()}
                self._stats[key] = Stats(n["n_docs"], n["sum_dl"], {t: df.get(t, 0) for t in terms})
            else:
                row = self.tokens.agg(F.count("*"), F.coalesce(F.sum("dl"), F.lit(0)), *(F.count_if(F.array_contains("terms", t)) for t in terms)).first()
                self._stats[key] = Stats(row[0], row[1], dict(zip(terms, row[2:], strict=True)))
        return self._stats[key]

    def counts(self, terms: list[str], phrase: list[str] | None = None, blocks: DataFrame | None = None) -> DataFrame:
        """doc, book_id, page_id, dl, tf (array, by terms) of every page with one of the terms; pf: starts of the phrase. blocks: of a stored index
        only the pages of these are looked at.
        """
        if not self.path:
            rows = self.tokens.where(F.arrays_overlap("terms", F.array(*(F.lit(t) for t in terms))))
            rows = rows.withColumn("tf", F.array(*(count_of(t, F.col("terms")) for t in terms)))
            return rows.withColumn("pf", phrase_count(phrase, F.col("terms")) if phrase else F.lit(0)).drop("terms")
        held = self.table("postings").where(F.col("term").isin(terms))
        if blocks is not None:
            held = self._within(held, blocks)
        tf = [F.coalesce(F.max(F.when(F.col("term") == t, F.col("tf"))), F.lit(0)).alias(f"tf{i}") for i, t in enumerate(terms)]
        places = [F.collect_list(F.struct("term", "positions")).alias("at")] if phrase else []
        # all postings of a block lie in one bucket, so this needs no exchange
        rows = held.groupBy("block", "doc", "book_id", "page_id", "dl").agg(*tf, *places)
        pf = F.lit(0)
        if phrase:
            # positions at which each term of the phrase would have it start; what is common to all are its starts
            for i in range(len(terms)):
                rows = rows.where(F.col(f"tf{i}") > 0)
            at, starts = F.map_from_entries("at"), None
            for i, t in enumerate(phrase):
                own = F.transform(F.coalesce(F.try_element_at(at, F.lit(t)), F.expr("cast(array() as array<int>)")), (lambda k: lambda p: p - k)(i))
                starts = own if starts is None else F.array_intersect(starts, own)
            pf = F.size(starts)
        return rows.select("doc", "book_id", "page_id", "dl", F.array(*(F.col(f"tf{i}") for i in range(len(terms)))).alias("tf"), pf.alias("pf"))

    @staticmethod
    def _within(held: DataFrame, blocks: DataFrame) -> DataFrame:
        """The postings of these blocks (distinct). Few are literals, which reach the files' statistics; of more the postings don't move either."""
        n = blocks.count()
        if n > FEW_BLOCKS:
            return held.join(F.broadcast(blocks) if n <= MAX_BROADCAST_ROWS else blocks, "block", "left_semi")
        wanted = F.lit(False)
        for r in blocks.select("block").collect():
            wanted |= F.col("block") == r["block"]
        return held.where(wanted)


def describe(df: DataFrame) -> DataFrame:
    """column, type, rows, present, longest (bytes): a row per column, in one pass; lengths only, no contents."""
    aggs = []
    for i, (c, _) in enumerate(df.dtypes):
        q = F.col(f"`{c}`")
        aggs += [F.count(q).alias(f"p{i}"), F.max(F.octet_length(q.cast("string"))).cast("long").alias(f"l{i}"), F.coalesce(F.sum(F.octet_length(q.cast("string"))), F.lit(0)).cast("long").alias(f"b{i}")]
    one = df.agg(F.count("*").alias("n"), *aggs)
    told = F.array(*(F.struct(F.lit(c).alias("column"), F.lit(t).alias("type"), F.col("n").alias("rows"), F.col(f"p{i}").alias("present"), F.col(f"l{i}").alias("longest"), F.col(f"b{i}").alias("bytes")) for i, (c, t) in enumerate(df.dtypes)))
    return one.select(F.explode(told).alias("x")).select("x.*")


def infer_key_column(df: DataFrame, key: str, candidates: list[str]) -> str | None:
    """The first candidate that equals the part of the key before its first dash, on every row."""
    prefix = F.substring_index(key, "-", 1)
    row = df.agg(F.count("*"), *(F.count_if(F.col(c).cast("string").eqNullSafe(prefix)) for c in candidates)).first()
    return next((c for c, n in zip(candidates, row[1:], strict=True) if row[0] and n == row[0]), None)
