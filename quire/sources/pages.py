"""A store of pages in order of book and page, with a locator that says which pages of which book each file holds.

A request reads the files that hold its pages, and of those the Parquet pages (PAGE_ROWS rows) that its keys fall into; a page's body goes from its file
to where it is wanted and is never part of an exchange. Requests move instead: they are broadcast, MAX_BROADCAST_ROWS at a time, each time to
the files of a stretch of the order, so a file is read once however many requests there are.
"""

from __future__ import annotations

from collections import defaultdict

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quire.plans.store import cut

KEYS = ["book_id", "page_id"]
#: Rows of a page within a Parquet file; requests whose keys are looked up as literals; rows of a side that is broadcast.
PAGE_ROWS, FEW, MAX_BROADCAST_ROWS = 16, 512, 100_000


class PageStore:
    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path
        self.rows = spark.read.parquet(f"{path}/pages")
        self.locator = spark.read.parquet(f"{path}/locator")

    @classmethod
    def write(cls, rows: DataFrame, path: str) -> PageStore:
        """rows: pages whose partitions are ranges of book and page, sorted."""
        # a dictionary would be read whole for any of its pages; few bodies repeat
        rows.write.option("parquet.page.row.count.limit", PAGE_ROWS).option("parquet.enable.dictionary#body", "false").parquet(f"{path}/pages")
        held = rows.sparkSession.read.parquet(f"{path}/pages").select(*KEYS, F.col("_metadata.file_name").alias("file"))
        spans = held.groupBy("book_id", "file").agg(F.min("page_id").alias("first"), F.max("page_id").alias("last"), F.count("*").alias("pages"))
        spans.repartitionByRange("book_id").sortWithinPartitions("book_id", "first").write.parquet(f"{path}/locator")
        return cls(rows.sparkSession, path)

    def _files(self, names: list[str]) -> DataFrame:
        return self.spark.read.schema(self.rows.schema).parquet(*(f"{self.path}/pages/{n}" for n in names))

    def _none(self) -> DataFrame:
        return self.spark.createDataFrame([], self.rows.schema)

    def few(self, keys: list[tuple[str, int]]) -> DataFrame:
        """The pages with these keys, of which there are FEW at most."""
        asked = defaultdict(set)
        for book, page in keys:
            asked[book].add(page)
        if not asked:
            return self._none()
        spans = self.locator.where(F.col("book_id").isin(list(asked))).collect()  # of FEW books at most
        files = sorted({s["file"] for s in spans if any(s["first"] <= p <= s["last"] for p in asked[s["book_id"]])})
        if not files:
            return self._none()
        held = {s["book_id"] for s in spans}
        wanted: Column = F.lit(False)
        for book in sorted(held):
            # the span as well: of longer lists only that reaches the files' statistics
            wanted |= (F.col("book_id") == book) & F.col("page_id").between(min(asked[book]), max(asked[book])) & F.col("page_id").isin(sorted(asked[book]))
        return self._files(files).where(wanted)

    def located(self, requests: DataFrame) -> DataFrame:
        """requests with file, the one that holds their page's place; those that no file can hold are gone."""
        spans = self.locator.select(F.col("book_id").alias("_book"), "file", "first", "last")
        spans = F.broadcast(spans) if self.locator.count() <= MAX_BROADCAST_ROWS else spans
        on = (F.col("book_id") == F.col("_book")) & F.col("page_id").between(F.col("first"), F.col("last"))
        return requests.join(spans, on).drop("_book", "first", "last")

    def fetch(self, requests: DataFrame, rows: int | None = None) -> DataFrame:
        """requests (book_id, page_id and other columns, none of which a page has), each with its page's columns, where there is such a page. rows: of
        requests that are written down already, and counted.
        """
        asked = cut(requests) if rows is None else requests
        rows = asked.count() if rows is None else rows
        if rows <= FEW:
            pages = self.few([tuple(r) for r in asked.select(*KEYS).distinct().collect()])
            return pages.join(F.broadcast(asked), KEYS)
        placed = cut(self.located(asked))
        counts = sorted((r["file"], r["n"]) for r in placed.groupBy("file").agg(F.count("*").alias("n")).collect())  # a row a file
        waves: list[list[str]] = []
        room = 0
        for file, n in counts:
            if n > room:
                waves.append([])
                room = MAX_BROADCAST_ROWS
            waves[-1].append(file)
            room -= n
        out = None
        size = dict(counts)
        for files in waves:
            some, pages = placed.where(F.col("file").between(files[0], files[-1])).drop("file"), self._files(files)
            shares = max(1, -(-size[files[0]] // MAX_BROADCAST_ROWS))  # one file's requests may be too many for one broadcast
            for k in range(shares):
                share = some if shares == 1 else some.where(F.pmod(F.monotonically_increasing_id(), F.lit(shares)) == k)
                met = pages.join(F.broadcast(share), KEYS)
                out = met if out is None else out.unionByName(met)
        return self._none().join(asked, KEYS) if out is None else out
