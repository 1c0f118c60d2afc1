"""SQLite libraries: probing, the data source, classification tables, trails, safe paths, settings, streaming."""

import random
import sqlite3

import pytest
from pyspark.sql import functions as F

from quire.errors import QuireError
from quire.operators import catalogue as C
from quire.operators import toc as H
from quire.sources import library as L
from quire.sources.sqlite import BookFiles, catalogue


@pytest.fixture
def root(tmp_path):
    (tmp_path / "app").mkdir()
    (tmp_path / "database").mkdir()
    m = sqlite3.connect(tmp_path / "database" / "master.db")
    m.executescript("""
      create table book (book_id integer, book_name text, book_category integer, main_author integer, major_ondisk integer);
      create table author (author_id integer, author_name text); create table category (category_id integer, category_name text);
      insert into author values (1, 'Someone'); insert into category values (4, 'الفقه الحنفي'), (5, 'الفقه العام');
      insert into book values (1001, ' One ', 4, 1, 1), (2, 'Two', 5, 9, 0), (3, 'Three', null, 1, null), (4, '', 4, null, 1), (null, 'x', 4, 1, 1);""")
    m.commit()
    for b in (1001, 2, 3):
        p = tmp_path / "database" / L.shard_path(str(b))
        p.parent.mkdir(parents=True, exist_ok=True)
        c = sqlite3.connect(p)
        c.executescript("create table page (id integer, part text, page text, number integer); create table title (id integer, page integer, parent integer);")
        c.executemany("insert into page values (?, ?, ?, ?)", [(i, "" if i == 1 else "2", "" if i == 2 else str(i + 10), i) for i in range(1, 6)])
        c.executemany("insert into title values (?, ?, ?)", [(1, 1, None), (2, 3, 1), (3, None, None)])
        c.commit()
    bad = tmp_path / "database" / "book" / "009" / "9.db"
    bad.parent.mkdir()
    bad.write_bytes(b"not a database" * 100)
    return str(tmp_path)


def test_probe_generations(root):
    p = L.probe_catalogue(L.introspect(L.open_read_only(f"{root}/database/master.db")))
    assert p.tables == {"books": "book", "categories": "category", "authors": "author"} and p.roles["book_title"] == "book_name" and p.roles["category_name"] == "category_name"
    old = {"bok": ["bkid", "bk", "cat", "auth"], "cats": ["id", "name"], "misc": ["a"]}
    p = L.probe_catalogue(old)
    assert p.tables["books"] == "bok" and p.roles["book_author_name"] == "auth" and p.roles["book_category_ref"] == "cat" and p.roles["category_key"] == "id"
    assert L.probe_book({"book": ["id", "nass", "part", "page"], "title": ["id", "tit", "lvl", "sub"]}).roles | {} == {"page_id": "id", "page_text": "nass", "page_part": "part", "page_printed": "page", "title_id": "id", "title_page": "id", "title_text": "tit", "title_level": "lvl"}
    with pytest.raises(QuireError, match="SCHEMA_UNRECOGNISED"):
        L.probe_catalogue({"x": ["a", "b"]})
    assert L.quoted('a"b') == '"a""b"'


def test_catalogue_and_files(spark, root):
    rows = {r.book_id: r for r in catalogue(spark, root).collect()}
    assert set(rows) == {"1001", "2", "3", "4"} and rows["1001"].title == "One" and rows["1001"].author == "Someone" and rows["1001"].category == "الفقه الحنفي"
    assert [rows[b].downloaded for b in ("1001", "2", "3", "4")] == [True, False, True, False] and rows["4"].title is None
    spark.dataSource.register(BookFiles)
    got = spark.read.format("bookfiles").option("root", root).load().collect()
    assert len([r for r in got if r.error is None]) == 15 and [r.error for r in got if r.book_id == "9"] == ["BOOK_UNREADABLE"]
    one = {r.page_id: r for r in got if r.book_id == "1001"}
    assert one[1].part is None and one[3].part == "2" and one[2].printed_page is None and one[4].printed_page == 14.0
    toc = spark.read.format("bookfiles").option("root", root).option("table", "toc").option("ids", "1001").load().collect()
    assert [(r.title_id, r.page_id, r.level) for r in toc] == [(1, 1, 1), (2, 3, 1)]
    assert C.classify(catalogue(spark, root)).where("school = 'hanafi'").count() == 2


def test_locate(root, tmp_path):
    assert L.locate(root) == root and L.locate(candidates=["/nowhere", root]) == root
    with pytest.raises(QuireError, match="LIBRARY_DIR_MISSING") as e:
        L.locate(candidates=["/nowhere"])
    assert e.value.details["tried"][0]["failed"] == "is a folder"
    assert L.shard_path("12345") == "book/345/12345.db" and L.shard_path("x1") is None


def test_safe_paths(root, tmp_path):
    out = tmp_path / "out"
    out.mkdir()
    assert L.safe_output(None, str(out)) == str(out) and L.safe_output("a/b", str(out)).endswith("/a/b")
    (out / "link").symlink_to(root)
    for asked, library, code in (("../x", None, "UNSAFE_OUTPUT_PATH"), ("/etc", None, "UNSAFE_OUTPUT_PATH"), ("link/database", root + "/database", "WRITE_INTO_LIBRARY")):
        with pytest.raises(QuireError, match=code):
            L.safe_output(asked, str(out), library)


def test_settings():
    env = {"A": " x ", "B": "", "C": "${user.x}", "N": "99", "M": "many"}
    assert [L.setting(k, env=env) for k in "ABCD"] == [("x", "set"), (None, "empty"), (None, "placeholder"), (None, "unset")]
    assert L.setting("N", 5, 1, 16, env)[0] == 16 and L.setting("M", 5, 1, 16, env)[0] == 5 and L.setting("D", 0, 1, 16, env)[0] == 1


def test_config():
    rules = [{"id": "a", "school": "maliki", "match_type": "equals", "patterns": ["x"]}, {"id": "b", "school": "nobody"}, "junk", {"id": "c", "school": "maliki", "match_type": "contains", "patterns": [""]}]
    c = C.Config.of(rules, {"overrides": [{"book_id": "1", "school": "maliki"}, {"book_id": 1, "school": "hanafi"}]})
    assert [r["id"] for r in c.rules] == ["a"] and c.overrides == {"1": "hanafi"}
    with pytest.raises(QuireError, match="OVERRIDES_INVALID"):
        C.Config.of(rules, {"overrides": [{"book_id": "1", "school": "nobody"}]})


def test_trails_equal_simulation(spark):
    rng = random.Random(5)
    toc, pages = [], []
    for b in range(40):
        toc += [(f"b{b}", i, rng.randint(1, 12), rng.randint(1, 4), f"t{i}") for i in range(rng.randint(0, 12))]
        pages += [(f"b{b}", p) for p in range(1, 14)]
    frame = spark.createDataFrame(toc, "book_id string, title_id int, page_id int, level int, title string")
    got = {(r.book_id, r.page_id): list(r.toc_path) for r in H.trails(spark.createDataFrame(pages, "book_id string, page_id int"), frame).collect()}
    for b, p in pages:
        trail = {}
        for _, _, at, level, title in sorted((x for x in toc if x[0] == b and x[2] <= p), key=lambda x: (x[2], x[1])):
            trail = {k: v for k, v in trail.items() if k < level} | {level: title}
        assert got[b, p] == [trail[k] for k in sorted(trail)], (b, p)


def test_levels_from_parents(spark):
    toc = spark.createDataFrame([("b", 1, 1, None), ("b", 2, 2, 1), ("b", 3, 3, 2), ("c", 3, 3, None)], "book_id string, title_id int, page_id int, parent int")
    assert {(r.book_id, r.title_id): r.level for r in H.with_parents(toc).collect()} == {("b", 1): 1, ("b", 2): 2, ("b", 3): 3, ("c", 3): 1}


def test_streaming_ingest(spark, tmp_path):
    from quire.plans.index import Index
    from quire.streaming import ingest as G

    schema = "doc long, book_id string, page_id int, body string"
    base = spark.createDataFrame([(1, "b", 1, "one two"), (2, "b", 2, "two three")], schema)
    path = str(tmp_path / "index")
    Index.over(base, False).store(path, 2)
    spark.createDataFrame([(3, "c", 1, "three four")], schema).coalesce(1).write.json(str(tmp_path / "in"))
    G.ingest(spark.readStream.schema(schema).json(str(tmp_path / "in")), path, str(tmp_path / "cp"), nfc=False).awaitTermination()
    now = G.current(spark, path)
    assert now.stats(["three"]).df == {"three": 2} and now.stats(["three"]).docs == 3
    assert {r.doc for r in now.counts(["three"]).where(F.exists("tf", lambda n: n > 0)).collect()} == {2, 3}
    # a second batch is a segment of its own; the base and the first segment aren't written again
    written = {p: p.stat().st_mtime_ns for p in (tmp_path / "index").glob("**/*.parquet") if "manifests" not in str(p)}
    spark.createDataFrame([(4, "c", 2, "three three")], schema).coalesce(1).write.mode("append").json(str(tmp_path / "in"))
    G.ingest(spark.readStream.schema(schema).json(str(tmp_path / "in")), path, str(tmp_path / "cp"), nfc=False).awaitTermination()
    later = G.current(spark, path)
    assert len(later.segments) == 2 and later.generation != now.generation and all(p.stat().st_mtime_ns == t for p, t in written.items())
    told = lambda i: (i.stats(["three", "one"]).df, i.stats(["three"]).docs, i.stats(["three"]).tokens, sorted((r.doc, r.tf, r.pf) for r in i.counts(["three"], ["three"]).collect()))
    whole = Index.over(base.unionByName(spark.createDataFrame([(3, "c", 1, "three four"), (4, "c", 2, "three three")], schema)), False).store(str(tmp_path / "whole"))
    assert told(later) == told(whole)
    one = G.compact(spark, path)
    assert one.segments == () and told(one) == told(whole) and told(G.current(spark, path)) == told(whole)


def test_filters_reach_the_book_files(spark, tmp_path):
    """A filter on book and page opens one file and reads its rows only; files whose page ids are texts are read whole, and results agree."""
    import sqlite3

    from pyspark.sql.datasource import EqualTo, GreaterThan, In, LessThanOrEqual

    from quire.sources import sqlite as Q

    for k, kind in ((7, "integer primary key"), (8, "text"), (9, "integer primary key")):
        path = tmp_path / "database" / L.shard_path(str(k))
        path.parent.mkdir(parents=True, exist_ok=True)
        con = sqlite3.connect(path)
        con.execute(f"create table page (id {kind}, content text, part text, page integer)")
        con.executemany("insert into page values (?, ?, '1', ?)", [(p, f"page {p} of {k}", p) for p in range(1, 501)])
        con.commit()
        con.close()

    def read(*filters):
        reader = Q.FilteringReader({"root": str(tmp_path)})
        assert list(reader.pushFilters(list(filters))) == list(filters)
        parts = reader.partitions()
        return [p.book_id for p in parts], sum(b.num_rows for p in parts for b in reader.read(p))

    assert read() == (["7", "8", "9"], 1500)
    assert read(EqualTo(("book_id",), "9"), GreaterThan(("page_id",), 20), LessThanOrEqual(("page_id",), 25)) == (["9"], 5)
    assert read(In(("book_id",), ("7", "9")), In(("page_id",), (3, 4, 9999))) == (["7", "9"], 4)
    assert read(EqualTo(("book_id",), "8"), EqualTo(("page_id",), 5)) == (["8"], 500)
    assert read(EqualTo(("book_id",), "8"), EqualTo(("book_id",), "7")) == ([], 0)
    spark.dataSource.register(Q.BookFiles)
    plain = spark.read.format("bookfiles").option("root", str(tmp_path)).load()
    told = []
    for rows in (plain, Q.read(spark, str(tmp_path))):
        some = rows.where("book_id in ('7', '8') and page_id > 10 and page_id <= 13 and body like 'page%'")
        told.append(sorted((r.book_id, r.page_id, r.body) for r in some.collect()))
    assert told[0] == told[1] == [(b, p, f"page {p} of {b}") for b in ("7", "8") for p in (11, 12, 13)]
    assert Q.read(spark, str(tmp_path)).where("book_id = '9' and page_id = 400").rdd.getNumPartitions() == 1
