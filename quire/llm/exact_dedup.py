"""Exact dedup by two-pass Bloom filtering, in DataFrame operations only.

Pass 1 finds the hashes that may be repeated (RepeatFilter); pass 2 lets every other row straight through, and only possibly
repeated rows shuffle. Their groups are formed by partial aggregation, so a group that holds a third of all rows costs one
partial row a task. Where rows are told their group, the verdict comes back by a join that keeps large groups out of the shuffle
(join_groups); where only the rows that stay are wanted, the best row of each group so far is all that a task sends.

The filter's size is bounded, so with hundreds of millions of repeated texts it says "maybe" more often, more rows shuffle, and
nothing else changes.

Defined results: a null text counts as empty; empty texts are equal; of rows equal in text, length and doc_id one stays; a
null doc_id loses every tie; other columns are carried unread, whatever their names; an empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quire.llm.common import RepeatFilter, cut, gather, join_groups, text_of


def normalised(text: Column) -> Column:
    """text without the characters of BLANK."""
    return F.translate(text, " \t\n\x0b\x0c\r", "")


def fingerprints(docs: DataFrame) -> DataFrame:
    """doc_id, n (code points), sha, h of every row, and rid, which tells rows apart."""
    return cut(
        docs.select("doc_id", F.length(text_of()).alias("n"), F.sha2(normalised(text_of()), 256).alias("sha"))
        .withColumns({"h": F.xxhash64("sha"), "rid": F.monotonically_increasing_id()})
    )


def _groups(rows: DataFrame) -> DataFrame:
    """The row of each sha that stays: most code points, then smallest doc_id (~x falls as x rises and can't overflow)."""
    best = F.max(F.struct("n", F.expr("~doc_id").alias("turned"), F.expr("~rid").alias("turned_rid")))
    return rows.groupBy("sha").agg(best.alias("best"), F.count("*").alias("group_size")).select("sha", F.expr("~best.turned").alias("keep_id"), F.expr("~best.turned_rid").alias("keep_rid"), "group_size")


def classes(docs: DataFrame) -> DataFrame:
    """One row per document: doc_id, keep_id, group_size, kept, text_sha256."""
    rows = fingerprints(docs)
    rows = RepeatFilter(rows, "h").mark(rows, "h", "maybe")
    alone = rows.where(~F.col("maybe")).select("doc_id", F.col("doc_id").alias("keep_id"), F.lit(1).cast("long").alias("group_size"), F.lit(True).alias("kept"), F.col("sha").alias("text_sha256"))
    again = rows.where("maybe")
    joined = join_groups(again, gather(_groups(again)), "sha", "group_size").select("doc_id", "keep_id", "group_size", (F.col("rid") == F.col("keep_rid")).alias("kept"), F.col("sha").alias("text_sha256"))
    return alone.unionByName(joined)


def dedup(docs: DataFrame) -> DataFrame:
    """The documents that stay, with the columns of docs. Only rows whose text may be repeated move, one of each text from a task."""
    names = docs.columns
    hashes = cut(docs.select(F.xxhash64(normalised(text_of())).alias("h")))
    whole = docs.select(F.struct(*(F.col(f"`{c}`") for c in names)).alias("row"), normalised(text_of()).alias("bare"), F.length(text_of()).alias("n"))
    whole = RepeatFilter(hashes, "h").mark(whole.withColumn("h", F.xxhash64("bare")), "h", "maybe")
    again = whole.where("maybe").select("row", F.sha2("bare", 256).alias("sha"), "n")
    first = again.groupBy("sha").agg(F.max_by("row", F.struct("n", F.expr("~row.doc_id").alias("turned"))).alias("row"))
    return whole.where(~F.col("maybe")).select("row").unionByName(first.select("row")).select("row.*")
