"""From hits to passages: discovery, neighbour windows, comparison, citations, export rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quire.functions import text as T
from quire.operators.toc import trails
from quire.plans.query import ParsedQuery
from quire.plans.store import written
from quire.schema import EXCERPT_FETCH, EXCERPT_SEARCH, SCHOOLS, schools
from quire.sources.pages import KEYS, MAX_BROADCAST_ROWS, PageStore

NUMBERING = "page numbers are those of the digital library and may differ from the printed edition"
TRUST = "untrusted_source_text"
UNREADABLE = "the index names this page; it can't be read in its book"


def notes(query: ParsedQuery) -> dict:
    """What holds for every passage of a response, said once."""
    return {"query": query.raw, "match_mode": query.mode, "numbering_note": NUMBERING, "content_trust": TRUST}


def counts_by_book(hits: DataFrame) -> DataFrame:
    return hits.groupBy("book_id").agg(F.count("*").alias("hits")).orderBy(F.desc("hits"), "book_id")


def totals_by_school(hits: DataFrame, books: DataFrame) -> DataFrame:
    """school (null: all), books, hits. One rollup; the catalogue is joined to counts per book."""
    per = hits.groupBy("book_id").agg(F.count("*").alias("n")).join(books.select("book_id", "school"), "book_id")
    return per.rollup("school").agg(F.count("*").alias("books"), F.coalesce(F.sum("n"), F.lit(0)).alias("hits"))


def page_samples(hits: DataFrame, n: int) -> DataFrame:
    """Per book its hits, its n best pages in page order, and whether more match."""
    ranked = hits.withColumns({"_rank": F.expr("row_number() over (partition by book_id order by score desc, doc)")})
    few = F.array_sort(F.collect_list(F.when(F.col("_rank") <= n, F.col("page_id"))))
    return ranked.groupBy("book_id").agg(F.count("*").alias("hits"), few.alias("page_ids")).withColumn("page_ids_truncated", F.col("hits") > F.size("page_ids"))


def discover(hits: DataFrame, books: DataFrame, sample: int = 10) -> DataFrame:
    """A row per book with hits, most first: hits, page_ids, page_ids_truncated and the book's columns. One job."""
    return page_samples(hits, sample).join(books, "book_id").orderBy(F.desc("hits"), "book_id")


def windows(requests: DataFrame, neighbours: int = 1) -> DataFrame:
    """book_id, page_id, requested: each requested page with so many before and behind, each once."""
    span = F.sequence(F.greatest(F.lit(0), F.col("page_id") - neighbours), F.greatest(F.lit(0), F.col("page_id") + neighbours))
    rows = requests.select("book_id", F.explode(span).alias("near"), "page_id")
    return rows.groupBy("book_id", F.col("near").cast("int").alias("page_id")).agg(F.bool_or(F.col("near") == F.col("page_id")).alias("requested"))


def _with_pages(requests: DataFrame, pages: DataFrame | PageStore, rows: int) -> DataFrame:
    """requests, of so many rows and written down, with their pages' columns, where there is such a page. A body moves only where pages aren't a store and requests are more than a
    broadcast may have.
    """
    if isinstance(pages, PageStore):
        return pages.fetch(requests.withColumnRenamed("doc", "_doc"), rows).drop("doc", "present").withColumnRenamed("_doc", "doc")
    return pages.drop("doc", "present").join(F.broadcast(requests) if rows <= MAX_BROADCAST_ROWS else requests, KEYS)


def looked_up(requests: DataFrame, pages: DataFrame | PageStore) -> DataFrame:
    """requests with the pages' columns and found; repeats of requests are kept. Pages are met by the requests where they lie, and the
    requests that meet none are added; no exchange holds a page's text.
    """
    asked = written(requests)
    rows = asked.count()
    met = _with_pages(asked, pages, rows)
    there = met.select(*KEYS).distinct()
    there = F.broadcast(there) if rows <= MAX_BROADCAST_ROWS else there
    gone = asked.join(there, KEYS, "left_anti").withColumn("found", F.lit(False))
    return met.withColumn("found", F.lit(True)).unionByName(gone, allowMissingColumns=True)


def fetch(requests: DataFrame, pages: DataFrame | PageStore, books: DataFrame, neighbours: int = 1, toc: DataFrame | None = None) -> DataFrame:
    """Every page of the windows with status: found, missing (requested, not there), absent (a neighbour, not there), failed (its book
    isn't in the catalogue or not downloaded). toc: for toc_path too.
    """
    asked = windows(requests, neighbours).join(books.select("book_id", F.col("downloaded").alias("_ok")), "book_id", "left")
    if toc is not None:
        asked = written(asked)
        asked = asked.join(trails(asked, toc), KEYS, "left")
    rows = looked_up(asked, pages)
    status = F.when(~F.coalesce("_ok", F.lit(False)), "failed").when(F.col("found"), "found").when(F.col("requested"), "missing").otherwise("absent")
    return rows.withColumn("status", status).drop("_ok")


_BOOK = ["book_id", "title", "author", "school", "classification_source", "verification_status"]


def _trail() -> Column:
    return F.coalesce("toc_path", F.expr("cast(array() as array<string>)"))


def _folded(rows: DataFrame, nfc: bool) -> tuple[DataFrame, Column]:
    """rows with the folded body, and that column; exploded from an array of one, so that each use of it doesn't fold again."""
    return rows.withColumn("_folded", F.explode(F.array(T.fold(F.coalesce("body", F.lit("")), nfc)))), F.col("_folded")


def passages(hits: DataFrame, pages: DataFrame | PageStore, books: DataFrame, toc: DataFrame, query: ParsedQuery, radius: int = EXCERPT_SEARCH, nfc: bool = False) -> DataFrame:
    """Hits as passages: the book's and the page's columns, the heading trail, why it matched, and an excerpt. Hits of unknown
    books are gone; a page that isn't there leaves null texts, and a reason that says so. What is joined is narrow until the pages
    are met, last of all.
    """
    few = written(hits).select("book_id", "page_id", "doc", "score")
    rows = few.join(books.select(*_BOOK), "book_id").join(trails(few, toc), KEYS, "left")
    rows = looked_up(rows, pages)
    rows, folded = _folded(rows, nfc)
    at = F.greatest(F.lit(0), T.first_match_offset(folded, list(query.terms), query.mode))
    reason = F.when(F.col("body").isNull(), UNREADABLE).otherwise(T.match_reason(folded, query.raw, list(query.terms), query.mode))
    return rows.select(
        *_BOOK, "page_id", "doc", "part", "printed_page", _trail().alias("toc_path"), "score", reason.alias("match_reason"), F.col("body").alias("text_original"),
        F.nullif(F.trim("footnote"), F.lit("")).alias("footnote"), T.excerpt(F.col("body"), at, radius).alias("excerpt"),
    )


def unreadable(hits: DataFrame, pages: DataFrame | PageStore, books: DataFrame) -> DataFrame:
    """book_id, title, pages: known books of which hits name pages that can't be read, and how many of those there are."""
    asked = written(hits.select(*KEYS).distinct())
    held = _with_pages(asked, pages, asked.count()).where("body is not null").select(*KEYS)
    gone = asked.join(held, KEYS, "left_anti")
    return gone.groupBy("book_id").agg(F.count("*").alias("pages")).join(books.select("book_id", "title"), "book_id").select("book_id", "title", "pages")


def failing(hits: DataFrame, pages: DataFrame | PageStore, books: DataFrame) -> DataFrame:
    """book_id, title, error: known books of whose hits not one page can be read."""
    gone = unreadable(hits, pages, books)
    all_of = hits.select("book_id", "page_id").distinct().groupBy("book_id").agg(F.count("*").alias("_n"))
    return gone.join(all_of, "book_id").where("pages = _n").select("book_id", "title", F.lit("none of the book's pages can be read").alias("error"))


def fetched_passages(rows: DataFrame, books: DataFrame, toc: DataFrame, query: ParsedQuery | None = None, nfc: bool = False) -> DataFrame:
    """The found pages of fetch() as passages, score 0. With a query a requested page tells why it matches it and its excerpt lies around the first
    match; a neighbour, and any page without a query, shows its beginning.
    """
    rows = rows.where("status = 'found'")
    known = books.select(*_BOOK)
    out = rows.join(F.broadcast(known) if known.count() <= MAX_BROADCAST_ROWS else known, "book_id")
    if "toc_path" not in rows.columns:  # fetch() has looked the trails up already, before the pages
        out = out.join(trails(rows, toc), KEYS, "left")
    asked, at = F.lit("requested page"), F.lit(0)
    if query is not None:
        out, folded = _folded(out, nfc)
        asked = T.match_reason(folded, query.raw, list(query.terms), query.mode)
        at = F.when(F.col("requested"), F.greatest(F.lit(0), T.first_match_offset(folded, list(query.terms), query.mode))).otherwise(0)
    reason = F.when(F.col("requested"), asked).otherwise("neighbour of a requested page")
    return out.select(*_BOOK, "page_id", "part", "printed_page", _trail().alias("toc_path"), F.lit(0.0).alias("score"), reason.alias("match_reason"), F.col("body").alias("text_original"), "footnote", T.excerpt(F.col("body"), at, EXCERPT_FETCH).alias("excerpt"))


def after(pages: DataFrame, last: int | None, limit: int) -> DataFrame:
    """A batch of pages in order of page_id: the limit (1 to 5000) that follow last; a short batch is the end."""
    rows = pages if last is None else pages.where(F.col("page_id") > last)
    return rows.orderBy("page_id").limit(max(1, min(5000, limit)))


def groups(passages: DataFrame) -> DataFrame:
    """school, books (array of book_id, passages), n_passages, n_books; schools in order, books by passages and then id."""
    per = passages.groupBy("school", "book_id").agg(F.array_sort(F.collect_list(F.struct((-F.col("score")).alias("by"), "doc", "page_id", "excerpt"))).alias("p"))
    one = F.struct((-F.size("p")).alias("by"), "book_id", F.transform("p", lambda x: F.struct(x["page_id"].alias("page_id"), (-x["by"]).alias("score"), x["excerpt"].alias("excerpt"))).alias("passages"))
    out = per.groupBy("school").agg(F.array_sort(F.collect_list(one)).alias("b"), F.sum(F.size("p")).alias("n_passages"), F.count("*").alias("n_books"))
    listed = F.transform("b", lambda x: F.struct(x["book_id"].alias("book_id"), x["passages"].alias("passages")))
    return out.join(schools(passages.sparkSession), "school").select("school", "label", "ord", listed.alias("books"), "n_passages", "n_books").orderBy("ord")


def evidence(passages: DataFrame, requested: list[str]) -> DataFrame:
    """Per requested school, in order: passages and books found, zeros kept."""
    got = passages.groupBy("school").agg(F.count("*").alias("passages"), F.count_distinct("book_id").alias("books"))
    asked = schools(passages.sparkSession).where(F.col("school").isin(requested))
    return asked.join(got, "school", "left").select("school", "ord", F.coalesce("passages", F.lit(0)).alias("passages"), F.coalesce("books", F.lit(0)).alias("books")).orderBy("ord")


def _label() -> Column:
    return F.element_at(F.create_map(*(F.lit(x) for p in SCHOOLS.items() for x in p)), F.col("school"))


def citations(rows: DataFrame) -> DataFrame:
    """rows (book, page and toc_path columns) with a long and a short citation and their caveats. Absent parts are left out; the
    page's own id never passes for a printed number; edition and publisher are unknown and stay null.
    """
    number = F.regexp_replace(F.col("printed_page").cast("string"), r"\.0$", "")
    locus = F.array_join(F.array_compact(F.array(F.concat(F.lit("v."), "part"), F.concat(F.lit("p."), number))), "/")
    name = F.coalesce("title", "book_id")
    trail = F.coalesce("toc_path", F.expr("cast(array() as array<string>)"))
    where = F.when(locus != "", F.concat(F.lit(", "), locus)).otherwise("")
    long = F.concat(
        F.coalesce(F.concat("author", F.lit(", ")), F.lit("")), name, where, F.lit(" (page id "), F.col("page_id").cast("string"), F.lit(")"),
        F.when(F.size(trail) > 0, F.concat(F.lit(", in: "), F.array_join(trail, " › "))).otherwise(""), F.lit(". ["), _label(), F.lit("] - "), F.lit(NUMBERING),
    )
    short = F.concat(name, where, F.when(F.col("printed_page").isNull(), F.concat(F.lit(" (page id "), F.col("page_id").cast("string"), F.lit(")"))).otherwise(""))
    caveats = F.array_compact(F.array(
        F.lit(NUMBERING), F.when(F.col("printed_page").isNull(), "no printed page is recorded; none was guessed"), F.when(F.col("part").isNull(), "no volume is recorded; none was guessed"),
        F.when(F.col("verification_status") != "verified", F.concat(F.lit("the attribution to "), _label(), F.lit(" is "), "verification_status", F.lit(" (source: "), "classification_source", F.lit(")"))),
        F.when(F.size(trail) == 0, "the book has no headings for this page"),
    ))
    return rows.withColumns({"edition": F.lit(None).cast("string"), "publisher": F.lit(None).cast("string"), "formatted": long, "formatted_short": short, "caveats": caveats})


EXPORT_COLUMNS = ["book_id", "title", "author", "school", "classification_source", "verification_status", "page_id", "part", "printed_page", "toc_path", "score", "match_reason", "query", "match_mode", "numbering_note", "content_trust", "text_original"]


def export_rows(passages: DataFrame, query: ParsedQuery, full_text: bool = True) -> DataFrame:
    """The rows of an export; with two of the notes in each, since a line is read far from its envelope."""
    rows = passages.withColumn("text_original", F.coalesce("text_original", F.lit(""))).withColumns({"query": F.lit(query.raw), "match_mode": F.lit(query.mode), "numbering_note": F.lit(NUMBERING), "content_trust": F.lit(TRUST)})
    return rows.select("doc", *(c for c in EXPORT_COLUMNS if full_text or c != "text_original"))
