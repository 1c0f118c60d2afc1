"""A library of SQLite files whose hits are known: a seeded draw says which pages of which shelf's books hold which saying, the files are written
from that draw, and the tools have to find the very same pages.
"""

import json
import random
import sqlite3
from collections import Counter

import pytest

from quire import engine as E
from quire.operators import catalogue as C
from quire.operators import search as S
from quire.plans.index import Index
from quire.plans.query import parse
from quire.sources import library as L
from quire.sources import sqlite as Q

#: shelf -> its school, by the shipped rules
SHELVES = {"الفقه المالكي": "maliki", "الفقه الحنفي": "hanafi", "الفقه الحنبلي": "hanbali", "الفقه الشافعي": "shafii", "الرحلات": "unclassified"}
#: What is searched, and two more spellings of the same letters.
SAYINGS = {
    "bread": ("خبز القمح في السوق", "خُبْزُ القمحِ في السّوق", "خبـز القمـح في السوق"),
    "boat": ("يعبر القارب النهر مساء", "يَعبُرُ القاربُ النّهرَ مساءً", "يعبر القارب النهـر مساء"),
    "lamp": ("سراج البيت لا ينطفئ", "سِراجُ البيتِ لا يَنطفئُ", "ســراج البيت لا ينطفئ"),
}
CHAPTER = 12


def drawn():
    """book -> (shelf, whether its pages are printed ones, [sayings of each page])"""
    draw, out = random.Random(20), {}
    for number in range(14):
        shelf = list(SHELVES)[number % len(SHELVES)]
        pages = [[s for s in SAYINGS if draw.random() < share] for share in [draw.choice((0.0, 0.1, 0.4))] for _ in range(draw.randint(18, 75))]
        out[str(310 + 7 * number)] = (shelf, number != 6, pages)
    return out


BOOKS = drawn()
ABSENT = {"900": "الفقه الحنفي", "907": "الرحلات"}


def places(saying, schools=None):
    return {(b, p) for b, (shelf, _, pages) in BOOKS.items() if schools is None or SHELVES[shelf] in schools for p, held in enumerate(pages, 1) if saying in held}


def body(book, page):
    held = BOOKS[book][2][page - 1]
    return " ".join(["كتاب", book, "ورقة", str(page), *(SAYINGS[s][(page + len(s)) % 3] for s in held), "تمت"])


@pytest.fixture(scope="module")
def tools(spark, tmp_path_factory):
    root = tmp_path_factory.mktemp("library")
    (root / "app").mkdir()
    (root / "database").mkdir()
    m = sqlite3.connect(root / "database" / "master.db")
    m.executescript("create table book (book_id integer primary key, book_name text, book_category integer, main_author integer, major_ondisk integer); create table category (category_id integer primary key, category_name text); create table author (author_id integer primary key, author_name text);")
    m.executemany("insert into category values (?, ?)", enumerate(SHELVES, 1))
    m.executemany("insert into book values (?, ?, ?, 1, ?)", [(int(b), f"Volume {b}", list(SHELVES).index(c) + 1, 1) for b, (c, *_) in BOOKS.items()] + [(int(b), "Elsewhere", list(SHELVES).index(c) + 1, 0) for b, c in ABSENT.items()])
    m.commit()
    for b, (_, printed, pages) in BOOKS.items():
        path = root / "database" / L.shard_path(b)
        path.parent.mkdir(parents=True, exist_ok=True)
        c = sqlite3.connect(path)
        c.executescript("create table page (id integer primary key, content text, part text, page integer); create table title (id integer primary key, page integer, parent integer, tit text);")
        c.executemany("insert into page values (?, ?, ?, ?)", [(p, body(b, p), "1", p if printed else None) for p in range(1, len(pages) + 1)])
        c.executemany("insert into title values (?, ?, null, ?)", [(p, p, f"Chapter from {p}") for p in range(1, len(pages) + 1, CHAPTER)])
        c.commit()
    spark.dataSource.register(Q.BookFiles)
    read = lambda table: spark.read.format("bookfiles").option("root", str(root)).option("table", table).load()
    pages = read("pages")
    number = "row_number() over (order by cast(book_id as int), page_id)"
    pages = pages.selectExpr(f"{number} as doc", "book_id", "page_id", "part", "printed_page", "body", "cast(null as string) as footnote").cache()
    e = E.Engine(C.classify(Q.catalogue(spark, str(root)), C.Config()), pages, read("toc"), Index.over(pages), library=str(root), output_root=str(tmp_path_factory.mktemp("out")), nfc=True)
    e.index = e.index.store(str(tmp_path_factory.mktemp("planted")), 2)
    return e


def found(tools, saying, spelling=0):
    return {(r.book_id, r.page_id) for r in S.hits(tools.index, parse(SAYINGS[saying][spelling], "phrase")).collect()}


@pytest.mark.parametrize("saying", SAYINGS)
def test_pages_found_are_those_planted(tools, saying):
    assert places(saying)
    for spelling in range(3):
        assert found(tools, saying, spelling) == places(saying)


@pytest.mark.parametrize("saying", SAYINGS)
def test_totals_of_the_four_schools(tools, saying):
    want = Counter(SHELVES[BOOKS[b][0]] for b, _ in places(saying))
    want.pop("unclassified", None)
    r = tools.discover_issue(SAYINGS[saying][0], "phrase", limit=200)
    assert r["totals"]["hits"] == want.total() and {s["school"]: s["hits"] for s in r["totals"]["by_school"]} == dict(want)
    assert {b["book_id"]: b["hits"] for b in r["books"]} == Counter(b for b, _ in places(saying, schema_of_four()))


def schema_of_four():
    return {s for s in SHELVES.values() if s != "unclassified"}


def test_a_walk_meets_each_page_once(tools):
    seen, cursor = [], None
    while True:
        r = tools.search(SAYINGS["boat"][1], "phrase", limit=7, cursor=cursor)
        for p in r["passages"]:
            seen.append((p["book_id"], p["page_id"]))
            assert p["match_reason"].endswith("occurs in order on the page") and p["toc_path"] == [f"Chapter from {(p['page_id'] - 1) // CHAPTER * CHAPTER + 1}"]
        if not (cursor := r["batch"]["next_cursor"]):
            break
    assert Counter(seen) == Counter(places("boat", schema_of_four()))


def test_export_and_health(tools):
    """An export has every hit, with printed pages where there are any."""
    r = tools.export_results(SAYINGS["lamp"][2], "phrase", job_id="planted")
    rows = [json.loads(x) for x in open(f"{r['path']}/results.jsonl")]
    assert {(x["book_id"], x["page_id"]) for x in rows} == places("lamp", schema_of_four()) and len(rows) == r["total"] and r["failed"] == []
    assert all((x["printed_page"] is not None) == BOOKS[x["book_id"]][1] for x in rows)
    h = tools.health()
    assert h["library"]["found"] and h["index"]["documents"] == sum(len(pages) for _, _, pages in BOOKS.values()) and h["catalogue"]["downloaded"] == len(BOOKS)
