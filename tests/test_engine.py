"""The tools over the driver's tables: paging totality, scopes, cursors, exports."""

import json

import pytest
from conftest import SMALL
from pyspark.sql import functions as F

from quire import engine as E
from quire.errors import QuireError, guarded
from quire.operators import search as S
from quire.operators.export import checksum
from quire.plans import cursor as K
from quire.plans.index import Index, infer_key_column
from quire.plans.query import parse


@pytest.fixture(scope="module")
def engine(spark, tmp_path_factory):
    e = E.over_tables(spark, SMALL)
    e.index = e.index.store(str(tmp_path_factory.mktemp("index")), 3)
    e.books, e.pages, e.toc = e.books.cache(), e.pages.cache(), e.toc.cache()
    e.output_root = str(tmp_path_factory.mktemp("exports"))
    return e


MODES = [("of the", "phrase"), ("the the", "phrase"), ("of the and", "all_terms"), ("zu the est", "any_terms"), ("the", "phrase"), ("the of the", "all_terms")]


@pytest.mark.parametrize("raw,mode", MODES)
def test_stored_and_scanned_agree(spark, engine, raw, mode):
    q = parse(raw, mode)
    scanned = E.over_tables(spark, SMALL).index
    row = lambda i: sorted((r.doc, r.book_id, r.page_id, r.score) for r in S.hits(i, q).collect())
    assert row(engine.index) == row(scanned) and row(scanned)


def test_modes_nest(engine):
    n = {m: S.hits(engine.index, parse("of the", m)).count() for m in ("phrase", "all_terms", "any_terms")}
    assert 0 < n["phrase"] <= n["all_terms"] <= n["any_terms"]


def walk(engine, query, mode, limit, **more):
    seen, cursor, total = [], None, None
    while True:
        r = engine.search(query, mode, limit=limit, cursor=cursor, **more)
        seen += [(p["book_id"], p["page_id"], p["score"]) for p in r["passages"]]
        total = r["batch"]["total_hits"] if total is None else total
        assert r["batch"]["total_hits"] == total and r["batch"]["returned"] == len(r["passages"])
        cursor = r["batch"]["next_cursor"]
        if not cursor:
            assert not r["batch"]["has_more"]
            return seen, total


@pytest.mark.parametrize("limit", [17, 50])
def test_paging_meets_every_hit_once(engine, limit):
    seen, total = walk(engine, "of the", "phrase", limit)
    assert len(seen) == len(set(seen)) == total and [-s for *_, s in seen] == sorted(-s for *_, s in seen)


def test_byte_budget(engine):
    small = E.Engine(**{**engine.__dict__, "byte_budget": 16_384})
    r = small.search("of the", "phrase", limit=40, include_full_text=True)
    assert r["batch"]["truncation_reason"] == "byte_budget" and r["passages"] and r["batch"]["next_cursor"]
    again = small.search("of the", "phrase", limit=40, include_full_text=True, cursor=r["batch"]["next_cursor"])
    assert not {(p["book_id"], p["page_id"]) for p in r["passages"]} & {(p["book_id"], p["page_id"]) for p in again["passages"]}


def test_scope(engine):
    one = engine.search("the", book_ids=["src1-en"], limit=500)
    assert {p["book_id"] for p in one["passages"]} == {"src1-en"}
    score = {(p["book_id"], p["page_id"]): p["score"] for p in engine.search("the", limit=500)["passages"]}
    assert all(score[p["book_id"], p["page_id"]] == p["score"] for p in one["passages"] if (p["book_id"], p["page_id"]) in score)
    none = engine.search("the", book_ids=["nowhere"])
    assert none["batch"]["total_hits"] == 0 and none["passages"] == [] and none["batch"]["next_cursor"] is None


def test_cursor_is_bound(engine):
    c = engine.search("of the", "phrase", limit=5)["batch"]["next_cursor"]
    for call, code in (
        (lambda: engine.search("of the", "all_terms", limit=5, cursor=c), "CURSOR_STALE"), (lambda: engine.search("of the", "phrase", book_ids=["src1-en"], cursor=c), "CURSOR_STALE"),
        (lambda: engine.discover_issue("of the", "phrase", cursor=c), "CURSOR_INVALID"), (lambda: engine.search("of the", "phrase", cursor="!!"), "CURSOR_INVALID"), (lambda: engine.list_books(cursor=K.encode_ordinal("list", ["other"], 1)), "CURSOR_STALE"),
    ):
        assert guarded(call)["error"]["code"] == code


def test_generation_changes_the_fingerprint(engine, spark, tmp_path):
    a = Index.over(engine.pages, False).store(str(tmp_path / "i"), 2)
    before = K.fingerprint(a.generation, 1, [])
    Index.over(engine.pages, False).store(str(tmp_path / "i"), 2)
    assert K.fingerprint(a.refresh().generation, 1, []) != before


def test_discover(engine):
    r = engine.discover_issue("of the", "phrase", limit=3, page_sample=2)
    assert len(r["books"]) == 3 and r["batch"]["truncation_reason"] == "book_limit"
    hits, cursor = list(r["books"]), r["batch"]["next_cursor"]
    while cursor:
        x = engine.discover_issue("of the", "phrase", limit=50, cursor=cursor)
        hits += x["books"]
        cursor = x["batch"]["next_cursor"]
    assert sum(b["hits"] for b in hits) == r["totals"]["hits"] == sum(s["hits"] for s in r["totals"]["by_school"])
    assert len(hits) == r["totals"]["books_with_hits"] and all(len(b["page_ids"]) <= 2 and b["page_ids"] == sorted(b["page_ids"]) for b in r["books"])


def test_fetch(engine):
    asked = [{"book_id": "src0-en", "page_ids": [2, 3, 99999]}, {"book_id": "src18-en", "page_ids": [1]}, {"book_id": "nowhere", "page_ids": [1]}]
    r = engine.fetch_passages(asked)
    assert [p["page_id"] for p in r["passages"]] == [1, 2, 3, 4] and [p["match_reason"][:5] for p in r["passages"]] == ["neigh", "reque", "reque", "neigh"]
    asked_why = engine.fetch_passages(asked, query="of the", mode="phrase")["passages"]
    assert [p["match_reason"][:6] for p in asked_why if p["page_id"] in (2, 3)] == [("phrase" if "of the" in p["text_original"].lower() else "the in") for p in asked_why if p["page_id"] in (2, 3)]
    assert r["failed_books"] == ["nowhere", "src18-en"] and r["missing_pages"] == [{"book_id": "src0-en", "page_id": 99999}]
    pages, cursor = [], None
    while True:
        x = engine.fetch_passages(asked, limit=2, cursor=cursor)
        pages += [p["page_id"] for p in x["passages"]]
        if not (cursor := x["batch"]["next_cursor"]):
            break
    assert pages == [1, 2, 3, 4]


def test_compare_has_no_verdict(engine):
    r = engine.compare_issue("of the", "phrase", per_school=3)
    assert r["summary"]["schools_with_evidence"] + r["summary"]["schools_without_evidence"] and all(len({p["page_id"] for b in g["books"] for p in b["passages"]}) <= 3 for g in r["groups"])
    told = json.dumps(r, default=str)
    assert not any(f'"{k}"' in told for k in ("verdict", "preferred", "winner", "strongest", "conclusion"))
    near = engine.compare_issue("of the", "phrase", per_school=2, neighbors=1)
    assert near["summary"]["passages"] >= r["summary"]["books"] and all(p["score"] == 0 for g in near["groups"] for b in g["books"] for p in b["passages"])
    one = engine.compare_issue("of the", "phrase", book_ids=["src1-en"])
    keys = [(b["book_id"], p["page_id"]) for g in one["groups"] for b in g["books"] for p in b["passages"]]
    assert len(keys) == len(set(keys))


def test_citation(engine):
    r = engine.citation("src0-en", 2)
    assert r["citation"]["edition"] is None and "page id 2" in r["formatted"] and r["citation"]["printed_page"] == 2
    assert engine.citation("src3-en", 2)["formatted_short"].endswith("(page id 2)")
    for args, code in ((("nowhere", 1), "BOOK_NOT_FOUND"), (("src18-en", 1), "BOOK_NOT_DOWNLOADED"), (("src0-en", 99999), "BOOK_NOT_FOUND")):
        assert guarded(engine.citation, *args)["error"]["code"] == code


def test_lists_health_guide(engine):
    a = engine.list_books(limit=7)
    b = engine.list_books(limit=7, cursor=a["batch"]["next_cursor"])
    ids = [x["book_id"] for x in a["books"] + b["books"]]
    assert ids == sorted(ids) and len(set(ids)) == 14
    assert engine.list_books(ambiguous_only=True)["totals"]["matched"] < a["totals"]["matched"]
    h = engine.health()
    assert h["index"]["documents"] == engine.pages.count() and len(h["classification"]) == 6 and h["index"]["readable"]
    assert h["engines"]["active"] == "spark" and set(h["environment"]) == set(E.SETTINGS) and h["unmapped_total"] and any("mapped" in w for w in h["warnings"])
    assert set(engine.guide()) == {"overview", "workflow", "examples", "limits", "fields"} and list(engine.guide("limits")) == ["limits"]


def test_health_tells_what_is_missing(engine, spark, tmp_path):
    """A library that isn't there, a catalogue that isn't one, and an index that can't be read are told, not raised."""
    gone = E.Engine(**{**engine.__dict__, "library": str(tmp_path / "none"), "index": Index(spark, engine.index.tokens, str(tmp_path / "noindex"))}).health()
    assert not gone["library"]["found"] and gone["schema"]["error"] == "BOOK_UNREADABLE" and not gone["index"]["readable"] and {"the library wasn't found", "the index can't be read"} <= set(gone["warnings"])
    import sqlite3

    (tmp_path / "lib" / "database").mkdir(parents=True)
    (tmp_path / "lib" / "app").mkdir()
    con = sqlite3.connect(tmp_path / "lib" / "database" / "master.db")
    con.execute("create table book (book_id integer, book_name text, book_category integer, main_author integer)")
    con.commit()
    con.close()
    there = E.Engine(**{**engine.__dict__, "library": str(tmp_path / "lib")}).health()
    assert there["library"]["found"] and there["schema"]["roles"]["books"] == "book" and there["schema"]["roles"]["book_title"] == "book_name" and there["schema"]["notes"]


def test_unreadable_pages(engine, tmp_path):
    """A hit whose page can't be read is consumed and its book named; an export marks the page, and fails the book if none of its pages is there."""
    whole = engine.search("of the", "phrase", limit=500)
    first, other = whole["passages"][0], next(p for p in whole["passages"] if p["book_id"] != whole["passages"][0]["book_id"])
    cond = (F.col("book_id") != first["book_id"]) & ~((F.col("book_id") == other["book_id"]) & (F.col("page_id") == other["page_id"]))
    poor = E.Engine(**{**engine.__dict__, "pages": engine.pages.where(cond), "store": None, "output_root": str(tmp_path)})
    seen, cursor, named = [], None, set()
    while True:
        r = poor.search("of the", "phrase", limit=20, cursor=cursor)
        seen += [(p["book_id"], p["page_id"]) for p in r["passages"]]
        named |= {b["book_id"] for b in r["unreadable_books"]}
        if not (cursor := r["batch"]["next_cursor"]):
            break
    want = [(p["book_id"], p["page_id"]) for p in whole["passages"] if p["book_id"] != first["book_id"] and (p["book_id"], p["page_id"]) != (other["book_id"], other["page_id"])]
    assert seen == want and named == {first["book_id"], other["book_id"]} and r["batch"]["total_hits"] == whole["batch"]["total_hits"]
    x = poor.export_results("of the", "phrase", job_id="poor")
    assert [f["book_id"] for f in x["failed"]] == [first["book_id"]] and first["book_id"] not in {b["book_id"] for b in x["by_book"]}
    rows = [json.loads(line) for line in open(f"{x['path']}/results.jsonl")]
    (marked,) = [r for r in rows if (r["book_id"], r["page_id"]) == (other["book_id"], other["page_id"])]
    assert marked["text_original"] == "" and "can't be read" in marked["match_reason"] and "none of the book's pages can be read" in open(f"{x['path']}/report.md").read()
    again = E.Engine(**{**engine.__dict__, "output_root": str(tmp_path)}).export_results("of the", "phrase", job_id="poor")
    assert again["failed"] == [] and again["total"] == whole["batch"]["total_hits"]


def test_scan_limit(engine):
    r = engine.discover_issue("of the", "phrase", scan_limit=10)
    assert r["batch"]["truncation_reason"] == "scan_limit" and r["counts_truncated"] and not r["batch"]["total_hits_exact"] and r["totals"]["hits"] == 10
    assert engine.discover_issue("of the", "phrase", scan_limit=100_000)["batch"]["truncation_reason"] != "scan_limit"


def test_export_notices_lost_rows(engine, spark, tmp_path, monkeypatch):
    """Rows that executors have written and the driver can't find fail the export before a shard appears."""
    from quire.operators import export as X

    real = type(spark.read).text
    monkeypatch.setattr(type(spark.read), "text", lambda self, *a, **k: real(self, *a, **k).limit(3))
    e = E.Engine(**{**engine.__dict__, "output_root": str(tmp_path)})
    assert guarded(e.export_results, "of the", "phrase", job_id="lost")["error"]["code"] == "EXPORT_INCOMPLETE"
    assert X.Folder(spark, str(tmp_path / "lost")).names("shards") == []


def test_budget_prefix_over_ranges(spark):
    from quire.operators import search as S

    rows = spark.range(0, 5000, 1, 7).select((F.col("id") * 7919 % 5000).alias("k"), F.lit("x").alias("body")).withColumn("n", F.col("k") % 11)
    held = sorted((r.k, r.n) for r in rows.collect())
    for budget in (-1, 0, 5, 777, 24_000, 10**9):
        for order in (["k"], ["k desc"]):
            want, used = [], 0
            for k, n in held if order == ["k"] else reversed(held):
                used += n
                if want and used > budget:
                    break
                want.append(k)
            got = S.within_budget(rows, order, budget, F.col("n"))
            assert sorted(r.k for r in got.collect()) == sorted(want), (budget, order)
            assert "Window" not in got._jdf.queryExecution().executedPlan().toString()


def test_export_resumes_to_the_same_file(engine):
    r = engine.export_results("of the", "phrase", job_id="one")
    rows = [json.loads(x) for x in open(f"{r['path']}/results.jsonl")]
    assert len(rows) == r["total"] == sum(b["hits"] for b in r["by_book"]) and len(rows[0]) == 17 and r["files"]["results.jsonl"] == r["checksum"]
    hits = [b["hits"] for b in r["by_book"]]
    assert hits == sorted(hits, reverse=True) and r["skipped"]
    import pathlib

    shards = sorted(pathlib.Path(r["path"], "shards").glob("*.jsonl"))
    for s in shards[::2]:
        s.unlink()
    again = engine.export_results("of the", "phrase", job_id="one")
    assert again["checksum"] == r["checksum"] == checksum(f"{r['path']}/results.jsonl") and 0 < again["resumed_books"] < len(shards)
    whole = engine.export_results("of the", "phrase", job_id="one")
    assert whole["resumed_books"] == len(shards) and whole["checksum"] == r["checksum"]
    assert guarded(engine.export_results, "of the", "phrase", job_id="one", include_full_text=False)["error"]["code"] == "CHECKPOINT_MISMATCH"
    assert guarded(engine.export_results, "of the", job_id="../x")["error"]["code"] == "UNSAFE_OUTPUT_PATH"


def test_index_tables(spark, engine):
    assert E.index_report(engine.index).count() == 5
    df = spark.createDataFrame([("7-1", "7", "x"), ("8-2", "8", "x")], "id string, book string, other string")
    assert infer_key_column(df, "id", ["other", "book"]) == "book" and infer_key_column(df, "id", ["other"]) is None
    plan = engine.index.spark.read.parquet(f"{engine.index.path}/postings").where(F.col("term") == "the")._jdf.queryExecution().toString()
    assert "EqualTo(term,the)" in plan


def test_forms_follow_their_input(spark, tmp_path):
    """Stored pages are used again while the input stays the same, made anew when it changes, and removed on demand."""
    from quire.plans import store
    from quire.sources import corpus

    row = lambda k, t: (k, t, "en", "s", 5)
    write = lambda rows: spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.mode("overwrite").parquet(f"{tmp_path}/documents.parquet")
    write([row(2, "b"), row(1, "a"), row(3, None)])
    told = lambda: sorted((r.book_id, r.page_id, r.doc, r.body) for r in corpus.pages(spark, str(tmp_path)).collect())
    assert told() == [("s-en", 1, 1, "a"), ("s-en", 2, 2, "b"), ("s-en", 3, 3, "")]
    key = next(k for k in store._forms if k[1].startswith(str(tmp_path)))
    first = store._forms[key]
    assert told() and store._forms[key] == first and corpus.texts(spark, str(tmp_path)).count() == 2
    write([row(9, "z"), row(1, "a")])
    assert told() == [("s-en", 1, 1, "a"), ("s-en", 2, 9, "z")] and store._forms[key] != first
    fs, p = store.file_system(spark, store._forms[key][1])
    assert fs.exists(p) and not fs.exists(store.file_system(spark, first[1])[1])
    store.remove(spark, store._forms.pop(key)[1])
    assert not fs.exists(p)


def test_pages_of_a_book_over_many_partitions(spark, tmp_path, monkeypatch):
    """A book that fills several partitions is numbered through, and each book by itself."""
    from quire.plans import store
    from quire.sources import corpus

    monkeypatch.setattr(store, "partitions", lambda *a: 7)
    rows = [(k * 37 % 1000, f"t{k}", "en", "big" if k % 3 else f"s{k % 5}", 2) for k in range(1000)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").repartition(4).write.parquet(f"{tmp_path}/documents.parquet")
    got = {(r.book_id, r.page_id): r.doc for r in corpus.pages(spark, str(tmp_path)).collect()}
    want = {}
    for book in {r[3] for r in rows}:
        want |= {(f"{book}-en", n): d for n, d in enumerate(sorted(r[0] for r in rows if r[3] == book), 1)}
    assert got == want


def test_compare_with_full_text_and_refresh(spark, engine, tmp_path):
    short, long = engine.compare_issue("of the", "phrase"), engine.compare_issue("of the", "phrase", include_full_text=True)
    of = lambda r: [(b["book_id"], p["page_id"]) for g in r["groups"] for b in g["books"] for p in b["passages"]]
    texts = {(r.book_id, r.page_id): r.body for r in engine.pages.collect()}
    assert all("text_original" not in p for g in short["groups"] for b in g["books"] for p in b["passages"])
    assert of(long) and set(of(long)) <= set(of(short)) and all(p["text_original"] == texts[b["book_id"], p["page_id"]] for g in long["groups"] for b in g["books"] for p in b["passages"])
    near = engine.compare_issue("of the", "phrase", neighbors=1, include_full_text=True)
    assert all(p["text_original"] == texts[b["book_id"], p["page_id"]] for g in near["groups"] for b in g["books"] for p in b["passages"])
    # the index at the same path is built anew: health tells of the old one, unless it is to look again
    e = E.Engine(**{**engine.__dict__, "index": Index.over(engine.pages, False).store(str(tmp_path / "i"), 2)})
    Index.over(engine.pages.where("page_id < 3"), False).store(str(tmp_path / "i"), 2)
    before = e.index.generation
    assert e.health()["index"]["generation"] == before
    told = e.health(refresh=True)["index"]
    assert told["generation"] != before and told["documents"] == engine.pages.where("page_id < 3").count()


def test_export_in_one_job_with_limited_threads(engine, tmp_path, monkeypatch):
    """All books of an export are evaluated once; no more threads publish than were asked for, within 1 and 16."""
    import threading

    from quire.operators import export as X

    at_once, most, lock, jobs = 0, 0, threading.Lock(), []
    real, shards = X.Folder.publish, X._shards

    def publish(self, made, name):
        nonlocal at_once, most
        with lock:
            at_once += 1
            most = max(most, at_once)
        try:
            return real(self, made, name)
        finally:
            with lock:
                at_once -= 1

    monkeypatch.setattr(X.Folder, "publish", publish)
    monkeypatch.setattr(X, "_shards", lambda *a, **k: jobs.append(1) or shards(*a, **k))
    e = E.Engine(**{**engine.__dict__, "output_root": str(tmp_path)})
    sums = set()
    for asked, limit in ((1, 1), (3, 3), (99, 16)):
        most = 0
        sums.add(e.export_results("of the", "phrase", job_id=f"c{asked}", concurrency=asked)["checksum"])
        assert 1 <= most <= limit
    assert len(sums) == 1 and len(jobs) == 3


def test_unknown_mode(engine):
    with pytest.raises(QuireError, match="INVALID_QUERY"):
        engine.search("x", "fuzzy")
