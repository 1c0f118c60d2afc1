"""Heading trails: for a page, the latest heading at or before it on each level, where a heading ends all deeper ones."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quire.plans.store import cut


def intervals(toc: DataFrame) -> DataFrame:
    """toc with until: the page of the next heading of its level or above; null if it holds to the end.

    Headings are ranked by page and title; for each level that occurs one window finds the next heading as high, so the work is a
    sort a book. Missing levels and those below 1 are 1.
    """
    level = F.greatest(F.coalesce(F.col("level").cast("int"), F.lit(1)), F.lit(1))
    rows = toc.where("page_id is not null").withColumn("level", level)
    levels = sorted(r[0] for r in rows.select("level").distinct().collect())
    # what follows a heading precedes it in the reverse order, where a frame grows by a row at a time
    ahead = "over (partition by book_id order by page_id desc, title_id desc rows between unbounded preceding and 1 preceding)"
    nexts = [F.expr(f"last_value(if(level <= {n}, page_id, null), true) {ahead}") for n in levels] or [F.lit(None).cast("int")]
    at = F.array_position(F.array(*(F.lit(n) for n in levels or [1])), F.col("level")).cast("int")
    return rows.withColumn("_next", F.array(*nexts)).withColumn("until", F.element_at("_next", at)).drop("_next")


#: Pages of a stretch of a book, in which pages and headings meet.
STRETCH = 64


def trails(pages: DataFrame, toc: DataFrame, intervals_of: DataFrame | None = None) -> DataFrame:
    """book_id, page_id, toc_path (titles by level) of the pages.

    A book is a row of stretches of STRETCH pages. An interval is there once in each stretch that it reaches; those of a level don't
    overlap, so that is about a row per level and stretch besides the headings themselves. Pages meet the intervals of their stretch
    only: the work grows with the pages, and a large book spreads over many keys.
    """
    few = pages.select("book_id", "page_id").distinct()
    last = few.groupBy("book_id").agg(F.max("page_id").alias("_last"))
    spans = intervals(toc) if intervals_of is None else intervals_of
    # a heading that another as high follows on the same page holds for no page, so a page has one of each level at most
    spans = spans.join(last, "book_id").where("until is null or until > page_id").withColumn("_end", F.least(F.coalesce(F.col("until") - 1, "_last"), "_last")).where("_end >= page_id")
    stretch = lambda c: F.floor(F.col(c) / STRETCH).cast("long")
    spans = spans.select(F.col("book_id").alias("_b"), F.col("page_id").alias("_from"), "_end", "level", "title", F.explode(F.sequence(stretch("page_id"), stretch("_end"))).alias("_s"))
    on = (F.col("book_id") == F.col("_b")) & (stretch("page_id") == F.col("_s")) & (F.col("_from") <= F.col("page_id")) & (F.col("page_id") <= F.col("_end"))
    named = F.when(F.col("title") != "", F.struct("level", "title"))
    rows = few.join(spans, on, "left").groupBy("book_id", "page_id").agg(F.array_sort(F.collect_list(named)).alias("path"))
    return rows.select("book_id", "page_id", F.transform("path", lambda x: x["title"]).alias("toc_path"))


def titled(headings: DataFrame, titles: DataFrame) -> DataFrame:
    """headings (book_id, title_id, page_id, level, parent) with the titles (book_id, title_id, title) that are known; one without a title
    keeps its place in the tree and an empty title, which trails leave out.
    """
    return headings.join(titles.select("book_id", "title_id", "title"), ["book_id", "title_id"], "left").withColumn("title", F.coalesce("title", F.lit("")))


def with_parents(toc: DataFrame) -> DataFrame:
    """level from parent links (parent: a title_id of the book, or null), by a join of the table with itself for each level there is.

    Links that run in a circle are refused.
    """
    out = toc.withColumns({"level": F.lit(1), "_up": F.col("parent")})
    links = toc.select(F.col("book_id").alias("_b"), F.col("title_id").alias("_t"), F.col("parent").alias("_p"))
    most, depth = None, 1
    while not out.where("_up is not null").isEmpty():
        most = toc.count() if most is None else most
        if depth > most:
            raise ValueError("headings are their own parents")
        out = out.join(links, (F.col("book_id") == F.col("_b")) & (F.col("_up") == F.col("_t")), "left")
        out = out.withColumn("level", F.col("level") + F.when(F.col("_t").isNotNull(), 1).otherwise(0)).withColumn("_up", F.col("_p")).drop("_b", "_t", "_p")
        out, depth = cut(out), depth + 1
    return out.drop("_up")
