"""Walks over stored ranges: the same rows as ranking for each batch, from one range each, ranked once."""

import pytest
from conftest import SMALL
from pyspark.sql import functions as F

from quire import engine as E
from quire.operators import search as S
from quire.plans import runs as R


@pytest.fixture(scope="module")
def hits(spark):
    # many equal scores, over several ranges
    return spark.range(5000).select(F.col("id").alias("doc"), F.lit("b").alias("book_id"), F.col("id").cast("int").alias("page_id"), (F.col("id") * 7919 % 40 / 8).alias("score")).cache()


def test_batches_are_those_of_ranking_each(hits, tmp_path, monkeypatch):
    monkeypatch.setattr(R, "RANGE_ROWS", 600)
    run = R.Run(hits, str(tmp_path / "run"))
    assert run.total == 5000 and 5 <= len(run.ranges) <= 9 and not (tmp_path / "run" / "hits").exists()
    want = [tuple(r) for r in S.page(hits, 5000).collect()]
    seen, last, read = [], None, []
    while True:
        batch = run.page(230, last)
        some = [tuple(r) for r in batch.collect()]
        if not some:
            break
        read.append(len(batch.inputFiles()))
        seen += some
        last = (some[-1][3], some[-1][0])
    assert seen == want and max(read) <= 2 and sum(read) <= len(read) + len(run.ranges)
    assert [tuple(r) for r in run.page(2000, (want[99][3], want[99][0])).collect()] == want[100:2100]
    assert run.page(10, (want[-1][3], want[-1][0])).count() == 0


def test_runs_are_made_once_and_the_oldest_go(spark, hits, tmp_path):
    runs, made = R.Runs(most=2), []
    ask = lambda key: runs.of(spark, (key,), lambda: made.append(key) or hits)
    first = ask("a")
    assert ask("a") is first and ask("b") and ask("a") is first and ask("c") and made == ["a", "b", "c"]
    folder = lambda run: run.spark._jvm.java.io.File(run.folder.removeprefix("file:")).exists()
    assert folder(first) and ask("b") and made == ["a", "b", "c", "b"] and not folder(first)  # a was used before c, so it went
    runs.forget()
    assert not runs._held
    assert R.Run(hits.where("false"), str(tmp_path / "none")).page(5).count() == 0


def test_a_tools_walk_ranks_once(spark, monkeypatch):
    e = E.over_tables(spark, SMALL)
    made = []
    real = R.Run.__init__
    monkeypatch.setattr(R.Run, "__init__", lambda self, *a: made.append(1) or real(self, *a))
    whole = e.search("of the", "phrase", limit=500)
    seen, cursor, batches = [], None, 0
    while True:
        r = e.search("of the", "phrase", limit=9, cursor=cursor)
        seen += [(p["book_id"], p["page_id"]) for p in r["passages"]]
        batches += 1
        if not (cursor := r["batch"]["next_cursor"]):
            break
    assert seen == [(p["book_id"], p["page_id"]) for p in whole["passages"]] and batches > 2 and made == [1]
    e.runs.forget()
