"""Streaming upkeep of a stored index: each batch of new pages becomes a segment beside the base, and the generation changes with each.

An extension: a segment has the tables of an index, over its own pages, and readers add up what base and segments say. What a batch
costs grows with the batch, not with the index. A batch that is repeated after a failure is written to the same folder of its
number, so its rows are there once. compact() makes one new base of all.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from quire.plans import index as I
from quire.plans.store import file_system, remove


def ingest(pages: DataFrame, path: str, checkpoint: str, nfc: bool = True, once: bool = True) -> StreamingQuery:
    """pages: a stream with doc, book_id, page_id, body, of pages that the index doesn't have. path: of a stored index."""

    def take(batch: DataFrame, number: int) -> None:
        I.Index(batch.sparkSession, I.tokens(batch, nfc)).store(f"{path}/segments/{number:012d}")
        publish(batch.sparkSession, path)

    writer = pages.writeStream.foreachBatch(take).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if once else writer).start()


def _names(spark, folder: str) -> list[str]:
    fs, p = file_system(spark, folder)
    return sorted(s.getPath().getName() for s in fs.listStatus(p)) if fs.exists(p) else []


def _there(spark, file: str) -> bool:
    fs, p = file_system(spark, file)
    return fs.exists(p)


def _manifests(spark, path: str) -> list[str]:
    return [n for n in _names(spark, f"{path}/manifests") if _there(spark, f"{path}/manifests/{n}/_SUCCESS")]


def publish(spark, path: str, base: str | None = None) -> None:
    """Names the base and its whole segments in a new manifest, under a new generation. Readers of an older one keep what they have."""
    last = _manifest(spark, path)
    base = base or (last["base"] if last else path)
    whole = [n for n in _names(spark, f"{path}/segments") if _there(spark, f"{path}/segments/{n}/corpus_stats/_SUCCESS")]
    row = [(base, [f"{path}/segments/{n}" for n in whole], uuid.uuid4().hex)]
    number = int(last["number"]) + 1 if last else 0
    spark.createDataFrame(row, "base string, segments array<string>, generation string").coalesce(1).write.mode("overwrite").parquet(f"{path}/manifests/{number:012d}")


def _manifest(spark, path: str) -> dict | None:
    names = _manifests(spark, path)
    return spark.read.parquet(f"{path}/manifests/{names[-1]}").first().asDict() | {"number": names[-1]} if names else None


def current(spark, path: str) -> I.Index:
    """The index that was published last; the base alone, if nothing was."""
    m = _manifest(spark, path)
    return I.Index.open(spark, m["base"], tuple(m["segments"]), m["generation"]) if m else I.Index.open(spark, path)


def compact(spark, path: str) -> I.Index:
    """One new base of the base and all its segments, which are removed then; for a time when no stream writes."""
    now = current(spark, path)
    base = f"{path}/base-{uuid.uuid4().hex[:12]}"
    I.Index(spark, now.tokens).store(base)
    for s in now.segments:
        remove(spark, s)
    publish(spark, path, base)
    if now.path != path:
        remove(spark, now.path)
    return current(spark, path)


def rate_by_school(events: DataFrame, width: str = "10 minutes", late: str = "1 hour") -> DataFrame:
    """Counts of a stream (ts, school) by tumbling windows, with a watermark for late rows."""
    return events.withWatermark("ts", late).groupBy(F.window("ts", width), "school").agg(F.count("*").alias("n"))
