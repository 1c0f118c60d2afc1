"""Whole results, held against plain Python: nothing is cut by a page number, a column, a level, a null or a length."""

import hashlib
from collections import defaultdict

import pandas as pd
import pytest
from conftest import SF
from pyspark.sql import functions as F

from quire import queries as Q
from quire import schema
from quire.operators import passages as P
from quire.operators import toc as H


def library():
    """(book_id, page_id) of every page with its source, and the headings of each book as (page, level, title)."""
    d = pd.read_parquet(f"{SF}/documents.parquet").sort_values("doc_id")
    pages, heads = {}, defaultdict(list)
    for r in d.itertuples():
        book = f"{r.source}-{r.lang}"
        n = sum(1 for b, _ in pages if b == book) + 1
        pages[book, n] = r.source
        if n % 5 == 0:
            heads[book].append((n, 1 + n // 5 % 3, f"Heading {n}"))
    return pages, heads


def plain_trail(heads, page):
    open_ = {}
    for at, level, title in heads:
        if at <= page:
            open_ = {k: v for k, v in open_.items() if k < level} | {level: title}
    return [open_[k] for k in sorted(open_)]


@pytest.fixture(scope="module")
def cited(spark):
    """By (book_id, page_id): the long and the short citation and the caveats, as plain Python says them."""
    books = {r.book_id: r for r in Q._books(spark, SF).collect()}
    pages, heads = library()
    out = {}
    for (book, page), source in pages.items():
        b, trail, printed = books[book], plain_trail(heads[book], page), source != "src3"
        name = f"{b.title or book}, v.{(page - 1) // 60 + 1}" + (f"/p.{page}" if printed else "")
        label = schema.SCHOOLS[b.school]
        long = (f"{b.author}, " if b.author else "") + f"{name} (page id {page})" + (f", in: {' › '.join(trail)}" if trail else "") + f". [{label}] - {P.NUMBERING}"
        told = [P.NUMBERING] + ([] if printed else ["no printed page is recorded; none was guessed"])
        if b.verification_status != "verified":
            told.append(f"the attribution to {label} is {b.verification_status} (source: {b.classification_source})")
        if not trail:
            told.append("the book has no headings for this page")
        out[book, page] = (long, name + ("" if printed else f" (page id {page})"), "|".join(told))
    return out


def test_every_page_is_cited(spark, cited):
    got = {(r.book_id, r.page_id): (r.formatted, r.formatted_short) for r in Q.citation_strings(spark, SF).collect()}
    assert max(p for _, p in cited) > 12 and got == {k: v[:2] for k, v in cited.items()}


def test_every_page_has_caveats(spark, cited):
    got = {(r.book_id, r.page_id): r.caveats for r in Q.caveats(spark, SF).collect()}
    assert got == {k: v[2] for k, v in cited.items()}


def test_checksums_read_every_column(spark):
    d = pd.read_parquet(f"{SF}/documents.parquet")
    want = {r[0]: hashlib.sha256("\x1f".join("-" if x is None or x != x else f"={x}" for x in r).encode()).hexdigest() for r in d.itertuples(index=False, name=None)}
    assert "text" in d.columns and {r.doc_id: r.checksum for r in Q.row_checksums(spark, SF).collect()} == want


def test_deep_headings(spark):
    toc = [("b", k, k, k, f"h{k}") for k in range(1, 13)] + [("b", 20, 20, 10, "later"), ("b", 30, 30, 9, "last")]
    frame = spark.createDataFrame(toc, "book_id string, title_id int, page_id int, level int, title string")
    assert {r.title_id: (r.level, r.until) for r in H.intervals(frame).collect()} == {k: (k, 20 if k > 9 else 30 if k == 9 else None) for k in range(1, 13)} | {20: (10, 30), 30: (9, None)}
    pages = spark.createDataFrame([("b", p) for p in range(1, 35)], "book_id string, page_id int")
    heads = [(at, level, title) for _, _, at, level, title in toc]
    assert {r.page_id: list(r.toc_path) for r in H.trails(pages, frame).collect()} == {p: plain_trail(heads, p) for p in range(1, 35)}
    links = spark.createDataFrame([("b", k, k, k - 1 or None) for k in range(1, 13)], "book_id string, title_id int, page_id int, parent int")
    assert {r.title_id: r.level for r in H.with_parents(links).collect()} == {k: k for k in range(1, 13)}
    with pytest.raises(ValueError, match="own parents"):
        H.with_parents(spark.createDataFrame([("b", 1, 1, 2), ("b", 2, 2, 1)], "book_id string, title_id int, page_id int, parent int"))


def test_documents_without_source_or_lang(spark, tmp_path):
    rows = [(k, f"the text {k}", lang, source, 10) for k, (source, lang) in enumerate([("src0", "en"), (None, "en"), ("src0", None), (None, None)] * 5)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    names = {"src0-en", "(none)-en", "src0-(none)", "(none)-(none)"}
    assert {r.book_id for r in Q.classify_books(spark, str(tmp_path)).collect()} == names == {r.book_id for r in Q.toc_intervals(spark, str(tmp_path)).collect()}
    assert Q.doc_lengths(spark, str(tmp_path)).count() == 20 and {r.hits for r in Q.corpus.pages(spark, str(tmp_path)).groupBy("book_id").agg(F.count("*").alias("hits")).collect()} == {5}
    assert {(r.lang, r.source, r.doc_id) for r in Q.first_occurrence(spark, str(tmp_path)).collect()} == {("en", "src0", 0), ("en", None, 1), (None, "src0", 2), (None, None, 3)}
