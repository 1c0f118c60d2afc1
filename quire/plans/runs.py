"""Ranked runs: the hits of a query stored once in the order of their scores, so that a walk over them ranks once and not for each batch.

A run is a folder of files, each a range of the order (score, highest first, then doc), and a table of where each range begins. A batch reads the
range that it begins in, and the next ones if it goes beyond its end. Runs are kept by key (what is asked, of which index and scope) for as
long as the session lives, the MOST last used; others are removed.
"""

from __future__ import annotations

import threading
import uuid
from collections import OrderedDict

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quire.plans.store import remove, shared_dir

#: Runs that are kept; rows of a range, at least, and ranges of a run, at most.
MOST, RANGE_ROWS, MOST_RANGES = 8, 20_000, 10_000


class Run:
    """hits: doc, book_id, page_id, score."""

    def __init__(self, hits: DataFrame, folder: str):
        self.spark, self.folder = hits.sparkSession, folder
        hits.write.parquet(f"{folder}/hits")
        held = self.spark.read.parquet(f"{folder}/hits")
        self.total = held.count()
        ranges = max(1, min(MOST_RANGES, -(-self.total // RANGE_ROWS)))
        by = [F.desc("score"), F.asc("doc")]
        held.repartitionByRange(ranges, *by).sortWithinPartitions(*by).write.parquet(f"{folder}/ranked")
        remove(self.spark, f"{folder}/hits")
        rows = self.spark.read.parquet(f"{folder}/ranked")
        self.schema = rows.schema
        order = F.struct((-F.col("score")).alias("turned"), "doc")
        told = rows.groupBy(F.col("_metadata.file_name").alias("file")).agg(F.max(order).alias("last"), F.count("*").alias("rows")).collect()  # MOST_RANGES rows at most
        #: file, and (score turned, doc) of its last row, in order
        self.ranges = sorted(((r["file"], (r["last"]["turned"], r["last"]["doc"]), r["rows"]) for r in told), key=lambda x: x[1])

    def page(self, limit: int, after: tuple[float, int] | None = None) -> DataFrame:
        """The limit hits that follow after (score, doc)."""
        left = [x for x in self.ranges if after is None or x[1] > (-after[0], after[1])]
        files = [x[0] for x in left[:1]]
        if left and limit > (inside := self._left(left[0][0], after)):
            room = limit - inside
            for file, _, rows in left[1:]:
                if room <= 0:
                    break
                files.append(file)
                room -= rows
        if not files:
            return self.spark.createDataFrame([], self.schema)
        return self._behind(files, after).orderBy(F.desc("score"), "doc").limit(limit)

    def _behind(self, files: list[str], after: tuple[float, int] | None) -> DataFrame:
        rows = self.spark.read.schema(self.schema).parquet(*(f"{self.folder}/ranked/{f}" for f in files))
        return rows if after is None else rows.where((F.col("score") < after[0]) | ((F.col("score") == after[0]) & (F.col("doc") > after[1])))

    def _left(self, file: str, after: tuple[float, int] | None) -> int:
        """Rows of a range behind a place."""
        return self._behind([file], after).count()


class Runs:
    def __init__(self, most: int = MOST):
        self.most, self._held, self._lock = most, OrderedDict(), threading.Lock()

    def of(self, spark: SparkSession, key: tuple, hits) -> Run:
        """The run of a key; hits() says what it holds, and is asked only if there is none."""
        with self._lock:
            if key not in self._held:
                self._held[key] = Run(hits(), f"{shared_dir(spark).rstrip('/')}/run-{uuid.uuid4().hex}")
            self._held.move_to_end(key)
            while len(self._held) > self.most:
                _, old = self._held.popitem(last=False)
                remove(old.spark, old.folder)
            return self._held[key]

    def forget(self) -> None:
        """Removes them all."""
        with self._lock:
            for run in self._held.values():
                remove(run.spark, run.folder)
            self._held.clear()
