"""Matching, ranking, paging."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quire.plans.index import Index, Stats
from quire.plans.query import ParsedQuery
from quire.plans.store import cut

K1, B = 1.2, 0.75


def matches(index: Index, query: ParsedQuery, blocks: DataFrame | None = None) -> DataFrame:
    """doc, book_id, page_id, dl, tf, pf of the pages that match, over the whole index, or these blocks of it."""
    terms = query.distinct
    phrase = list(query.terms) if query.mode == "phrase" and len(query.terms) > 1 else None
    rows = index.counts(terms, phrase, blocks)
    if phrase:
        return rows.where("pf > 0")
    return rows.where(F.forall("tf", lambda n: n > 0)) if query.mode in ("phrase", "all_terms") else rows.where(F.exists("tf", lambda n: n > 0))


def bm25(query: ParsedQuery, stats: Stats) -> Column:
    """The default similarity of public full-text engines, with exact lengths in doubles; terms add up in query order and the sum is
    rounded to nine digits, so that reruns agree and keyset paging is stable.
    """
    mean = stats.tokens / stats.docs if stats.docs else 1.0
    norm = K1 * (1 - B + B * F.col("dl") / F.lit(mean or 1.0))
    idf = {t: math.log(1 + (stats.docs - n + 0.5) / (n + 0.5)) for t, n in stats.df.items()}
    if query.mode == "phrase" and len(query.terms) > 1:
        total = F.lit(sum(idf[t] for t in query.terms)) * F.col("pf") / (F.col("pf") + norm)
    else:
        total = F.lit(0.0)
        for t in query.terms:
            n = F.element_at("tf", query.distinct.index(t) + 1)
            total = total + F.lit(idf[t]) * n / (n + norm)
    return F.round(total, 9)


#: Blocks that are scored first, for a score that others have to reach.
FIRST_BLOCKS = 64


def bounds(index: Index, query: ParsedQuery) -> DataFrame:
    """block, bound, n of the blocks that can have matches: the most that a page there can score, and the query's postings there."""
    stats, distinct = index.stats(query.distinct), query.distinct
    mean = (stats.tokens / stats.docs if stats.docs else 1.0) or 1.0
    idf = {t: math.log(1 + (stats.docs - n + 0.5) / (n + 0.5)) for t, n in stats.df.items()}
    share = lambda x: x["tf"] / (x["tf"] + K1 * (1 - B + B * x["dl"] / F.lit(mean)))
    held = index.table("impacts").where(F.col("term").isin(distinct)).withColumn("share", F.array_max(F.transform("most", share)))
    per = [F.coalesce(F.max(F.when(F.col("term") == t, F.col("share"))), F.lit(0.0)).alias(f"s{i}") for i, t in enumerate(distinct)]
    rows = held.groupBy("block").agg(F.sum("n").alias("n"), F.count_distinct("term").alias("terms"), *per)
    if query.mode != "any_terms":
        rows = rows.where(F.col("terms") == len(distinct))
    if query.mode == "phrase" and len(query.terms) > 1:
        # a phrase starts no more often than its rarest term occurs
        top = F.lit(sum(idf[t] for t in query.terms)) * F.least(*(F.col(f"s{i}") for i in range(len(distinct))), F.lit(1.0))
    else:
        top = sum((F.lit(idf[t]) * F.col(f"s{distinct.index(t)}") for t in query.terms), F.lit(0.0))
    return rows.select("block", top.alias("bound"), "n")


def best(index: Index, query: ParsedQuery, limit: int) -> tuple[DataFrame, dict]:
    """The limit best hits of a stored index, and how many of the query's postings were read for them (read, of).

    The blocks with the highest bounds are scored first; what the last of the best there scores, a page of another block has to reach. So two
    passes find the same hits as scoring every match, and blocks that can't reach it aren't read.
    """
    known = cut(bounds(index, query))
    first = cut(known.orderBy(F.desc("bound"), "block").limit(FIRST_BLOCKS))
    weight = bm25(query, index.stats(query.distinct))
    score = lambda blocks: page(matches(index, query, blocks.select("block")).withColumn("score", weight).select("doc", "book_id", "page_id", "score"), limit)
    some = cut(score(first))
    told = some.agg(F.count("*"), F.min("score")).first()
    rest = known.join(F.broadcast(first.select("block")), "block", "left_anti")
    if told[0] >= limit:
        rest = rest.where(F.col("bound") >= told[1] - 1e-8)  # scores are rounded; an equal one may win by its number
    rest = cut(rest)
    read, of = (known.join(rest.union(first).select("block"), "block", "left_semi") if x else known for x in (1, 0))
    seen = [df.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0] for df in (read, of)]
    return page(some.unionByName(score(rest)), limit), {"read": seen[0], "of": seen[1]}


def hits(index: Index, query: ParsedQuery, scope: DataFrame | list[str] | None = None) -> DataFrame:
    """doc, book_id, page_id, score. scope: books (a list of ids or a frame with book_id); None is everything, empty is nothing.
    Statistics are those of the whole index, whatever the scope.
    """
    rows = matches(index, query).withColumn("score", bm25(query, index.stats(query.distinct)))
    if isinstance(scope, list):
        rows = rows.where(F.col("book_id").isin(scope)) if scope else rows.where("false")
    elif scope is not None:
        rows = rows.join(scope.select("book_id").distinct(), "book_id", "left_semi")
    return rows.select("doc", "book_id", "page_id", "score")


def keyed(rows: DataFrame, key: str = "id") -> DataFrame:
    """rows with book_id and page_id from a composite key: what stands before and after its first dash. A row whose key has no dash, or
    nothing before it, is dropped; a page part that isn't a whole number is -1.
    """
    at = F.instr(key, "-")
    page = F.substring(F.col(key), at + 1, F.length(key))
    whole = F.when(page.rlike(r"^[+-]?[0-9]+$"), page.try_cast("int"))
    return rows.where(at > 1).withColumns({"book_id": F.substring_index(key, "-", 1), "page_id": F.coalesce(whole, F.lit(-1))})


def passage_key() -> Column:
    """What names a passage: its book and page."""
    return F.concat_ws("#", "book_id", F.col("page_id").cast("string"))


def bounded(rows: DataFrame, most: int = 200_000) -> tuple[DataFrame, bool]:
    """The most best hits, and whether those are all; for a caller who would rather have bounded work than whole counts."""
    first = rows.orderBy(F.desc("score"), "doc").limit(most)
    return first, rows.limit(most + 1).count() <= most


def page(rows: DataFrame, limit: int, after: tuple[float, int] | None = None) -> DataFrame:
    """The limit rows of hits that follow after (score, doc), by score and then doc."""
    if after is not None:
        score, doc = after
        rows = rows.where((F.col("score") < score) | ((F.col("score") == score) & (F.col("doc") > doc)))
    return rows.orderBy(F.desc("score"), "doc").limit(limit)


def top_per(rows: DataFrame, key: str, limit: int) -> DataFrame:
    """The limit best hits of each key, with their rank."""
    return rows.withColumn("rank", F.expr(f"row_number() over (partition by {key} order by score desc, doc)")).where(F.col("rank") <= limit)


def _ordered(order: list[str]) -> list[Column]:
    return [F.desc(c.removesuffix(" desc")) if c.endswith(" desc") else F.asc(c) for c in order]


def within_budget(rows: DataFrame, order: list[str], budget: int, size: Column | None = None, by: str | None = None) -> DataFrame:
    """The prefix of rows whose running size (bytes of their JSON, unless size is given) stays within the budget; the first row of each
    by is always there. order tells rows apart; its columns hold no nulls.

    Without by the sizes of ranges of the order are summed first, and only the range in which the budget ends is looked at row by row; then
    rows up to that place are what stays. No row but its order and size moves. With by each group is summed by itself.
    """
    size = F.octet_length(F.to_json(F.struct(*(F.col(c) for c in rows.columns)))) if size is None else size
    rows = rows.withColumn("bytes", size.cast("long"))
    running = f"order by {', '.join(order)} rows unbounded preceding"
    if by:
        rows = rows.withColumns({"_upto": F.expr(f"sum(bytes) over (partition by {by} {running})"), "_n": F.expr(f"row_number() over (partition by {by} order by {', '.join(order)})")})
        return rows.where((F.col("_n") == 1) | (F.col("_upto") <= budget)).drop("_upto", "_n")
    names = [c.removesuffix(" desc") for c in order]
    placed = cut(rows.select(*names, "bytes").repartitionByRange(*_ordered(order)).withColumn("_range", F.spark_partition_id()))
    sums = sorted(placed.groupBy("_range").agg(F.sum("bytes").alias("s")).collect())  # a row per partition
    before, ends = 0, None
    for r in sums:
        ends = r["_range"]
        if before + r["s"] > budget:
            break
        before += r["s"]
    else:
        return rows
    inside = placed.where(F.col("_range") == ends).withColumn("_upto", F.expr(f"sum(bytes) over ({running})"))
    last = inside.where(F.col("_upto") <= budget - before).orderBy(*_ordered([c.removesuffix(" desc") if c.endswith(" desc") else f"{c} desc" for c in order])).first()
    if last is None:  # the budget ends before this range, or within its first row
        earlier = placed.where(F.col("_range") < ends)
        flip = _ordered([c.removesuffix(" desc") if c.endswith(" desc") else f"{c} desc" for c in order])
        last = earlier.orderBy(*flip).first() or placed.orderBy(*_ordered(order)).first()
    stays, same = F.lit(False), F.lit(True)
    for c in order:
        name = c.removesuffix(" desc")
        at = F.lit(last[name])
        stays |= same & ((F.col(name) > at) if c.endswith(" desc") else (F.col(name) < at))
        same &= F.col(name) == at
    return rows.where(stays | same)


def first_of(rows: DataFrame, keys: list[str], order: str) -> DataFrame:
    """The first row of each key."""
    return rows.withColumn("_n", F.expr(f"row_number() over (partition by {', '.join(keys)} order by {order})")).where("_n = 1").drop("_n")


#: Questions' terms that are broadcast, at most.
MAX_BROADCAST_ROWS = 100_000


def answers(index: Index, questions: DataFrame, limit: int = 20) -> DataFrame:
    """The best hits of each of a table of questions over a stored index: query, rank, doc, book_id, page_id, score.

    questions: query (any type, one row each), terms (array of folded terms, in order), mode. One plan of fixed size, however many there are:
    their terms meet the postings in one scan, a page's postings are gathered where they lie, and of each question a task sends its
    limit best rows on. Scores are those of hits(). A question without terms has no answer.
    """
    asked = cut(questions.select("query", "terms", F.when((F.col("mode") == "phrase") & (F.size("terms") > 1), "phrase").when(F.col("mode") == "any_terms", "any").otherwise("all").alias("mode")))
    stats = index.stats([])
    mean = (stats.tokens / stats.docs if stats.docs else 1.0) or 1.0
    each = asked.select("query", "mode", F.size(F.array_distinct("terms")).alias("_of"), F.posexplode("terms").alias("at", "term"))
    each = each.groupBy("query", "mode", "_of", "term").agg(F.sort_array(F.collect_list("at")).alias("ats"))
    df = F.coalesce(F.col("df"), F.lit(0))
    each = each.join(index.table("term_stats").select("term", "df"), "term", "left").withColumn("idf", F.log(1 + (F.lit(stats.docs) - df + 0.5) / (df + 0.5)))
    each = cut(each.drop("df"))
    phrases = not asked.where("mode = 'phrase'").isEmpty()
    held = index.table("postings").select("term", "block", "doc", "book_id", "page_id", "dl", "tf", *(["positions"] if phrases else []))
    met = held.join(F.broadcast(each) if each.count() <= MAX_BROADCAST_ROWS else each, "term")
    where_ = [F.when(F.col("mode") == "phrase", F.col("positions")).alias("positions")] if phrases else []
    page_ = ["block", "doc", "book_id", "page_id", "dl"]
    rows = met.groupBy(*page_, "query", "mode", "_of").agg(F.collect_list(F.struct("ats", "idf", "tf", *where_)).alias("has"))
    rows = rows.where((F.col("mode") == "any") | (F.size("has") == F.col("_of")))
    norm = K1 * (1 - B + B * F.col("dl") / F.lit(mean))
    by_place = lambda value: F.transform(F.array_sort(F.flatten(F.transform("has", lambda x: F.transform(x["ats"], lambda a: F.struct(a.alias("at"), value(x).alias("v")))))), lambda x: x["v"])
    total = lambda values: F.aggregate(values, F.lit(0.0), lambda a, x: a + x)
    score = total(by_place(lambda x: x["idf"] * x["tf"] / (x["tf"] + norm)))
    if phrases:
        starts = F.flatten(F.transform("has", lambda x: F.transform(x["ats"], lambda a: F.transform(x["positions"], lambda p: p - a))))
        common = F.aggregate(F.slice(starts, 2, F.greatest(F.size(starts), F.lit(1))), F.get(starts, F.lit(0)), lambda a, x: F.array_intersect(a, x))
        rows = rows.withColumn("pf", F.when(F.col("mode") == "phrase", F.size(common))).where("mode <> 'phrase' or pf > 0")
        score = F.when(F.col("mode") == "phrase", total(by_place(lambda x: x["idf"])) * F.col("pf") / (F.col("pf") + norm)).otherwise(score)
    rows = rows.select("query", "doc", "book_id", "page_id", F.round(score, 9).alias("score"))
    return top_per(rows, "query", limit).select("query", "rank", "doc", "book_id", "page_id", "score")


def many(index: Index, queries: dict[str, ParsedQuery], scope=None, limit: int = 20) -> DataFrame:
    """The best hits of several queries as one plan: query, rank, doc, book_id, page_id, score. Over a stored index and without a scope they are a
    table of questions; else each is a branch of the plan.
    """
    if index.path and scope is None and queries:
        asked = [(name, list(q.terms), q.mode) for name, q in queries.items()]
        return answers(index, index.spark.createDataFrame(asked, "query string, terms array<string>, mode string"), limit)
    out = None
    for name, q in queries.items():
        one = page(hits(index, q, scope), limit).withColumn("query", F.lit(name))
        out = one if out is None else out.unionByName(one)
    return top_per(out, "query", limit).select("query", "rank", "doc", "book_id", "page_id", "score")
