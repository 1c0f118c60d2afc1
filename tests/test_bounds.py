"""Postings in buckets by block: no exchange for what a page holds, and the best hits without reading every block."""

import pytest
from conftest import SF
from pyspark.sql import functions as F

from quire import queries as Q
from quire.operators import search as S
from quire.plans import index as I
from quire.plans.index import Index
from quire.plans.query import parse
from quire.sources import corpus


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize(("raw", "mode"), [(Q.ALL, "all_terms"), (Q.ANY, "any_terms"), (Q.PHRASE, "phrase"), (Q.TWICE, "phrase")])
def test_matches_need_no_exchange(spark, raw, mode):
    told = plan(S.matches(corpus.index(spark, SF), parse(raw, mode)))
    assert "Exchange" not in told and "Bucketed: true" in told and "max(positions" not in told


@pytest.mark.parametrize(("raw", "mode"), [("zu the est", "any_terms"), ("of the and", "all_terms"), ("of the", "phrase"), ("der die und the", "any_terms"), ("trash the", "any_terms"), ("qqqzzzabsent the", "all_terms"), ("the", "any_terms")])
def test_best_are_those_of_all(spark, raw, mode):
    big = "/root/testdata/sf0.1"
    index, q = corpus.index(spark, big), parse(raw, mode)
    for limit in (20, 7):
        got, told = S.best(index, q, limit)
        assert [tuple(r) for r in got.orderBy(F.desc("score"), "doc").collect()] == [tuple(r) for r in S.page(S.hits(index, q), limit).collect()]
        assert 0 <= told["read"] <= told["of"]


def test_common_terms_are_read_in_part(spark):
    _, told = S.best(corpus.index(spark, "/root/testdata/sf0.1"), parse("zu the est", "any_terms"), 20)
    assert 0 < told["read"] < told["of"] / 2, told


def test_best_where_blocks_are_many_and_scores_tie(spark, tmp_path, monkeypatch):
    """Equal scores across blocks go by number; more blocks than literals; bounds hold whatever the lengths."""
    rows = [(k, f"b{k % 40}", k // 40 + 1, " ".join(["alpha"] * (1 + k % 5) + ["beta"] * (k % 3) + ["gamma"] * (k % 7 == 0) + ["pad"] * (k % 11))) for k in range(2400)]
    pages = spark.createDataFrame(rows, "doc long, book_id string, page_id int, body string")
    index = Index.over(pages, False).store(str(tmp_path / "i"), 3)
    for literals in (256, 2):
        monkeypatch.setattr(I, "FEW_BLOCKS", literals)
        monkeypatch.setattr(S, "FIRST_BLOCKS", literals)
        for raw, mode in (("alpha beta", "any_terms"), ("alpha gamma", "all_terms"), ("alpha beta", "phrase"), ("alpha alpha", "phrase"), ("alpha beta alpha", "any_terms")):
            q = parse(raw, mode)
            assert [tuple(r) for r in S.best(index, q, 30)[0].orderBy(F.desc("score"), "doc").collect()] == [tuple(r) for r in S.page(S.hits(index, q), 30).collect()], (raw, mode)


def test_a_table_of_questions(spark):
    """Thousands of questions in one plan, whose size doesn't grow with them; each has the rows of a search of its own."""
    from quire.functions import text as T

    index = corpus.index(spark, SF)
    docs = spark.read.parquet(f"{SF}/documents.parquet").where("n_chars > 30")
    begin = F.slice(T.tokens(T.fold(F.col("text"), True)), 1, 3)
    asked = docs.select(F.col("doc_id").alias("query"), begin.alias("terms"), F.element_at(F.array(*map(F.lit, ("any_terms", "all_terms", "phrase"))), (F.col("doc_id") % 3 + 1).cast("int")).alias("mode"))
    more = asked
    for k in range(1, 11):
        more = more.unionByName(asked.withColumn("query", F.col("query") + 1_000_000 * k))
    got = S.answers(index, more.unionByName(spark.createDataFrame([(-1, [], "any_terms"), (-2, ["qqqzzzabsent"], "any_terms"), (-3, ["the", "the"], "phrase"), (-4, ["the"], "phrase")], "query long, terms array<string>, mode string")), 5)
    shape = lambda df: len(df._jdf.queryExecution().optimizedPlan().toString().splitlines())
    assert shape(got) == shape(S.answers(index, asked, 5)) and more.count() > 9000
    held = {}
    for r in got.collect():
        held.setdefault(r.query, []).append((r["rank"], r.doc, r.book_id, r.page_id, r.score))
    assert -1 not in held and -2 not in held
    singles = [(r.query, r.terms, r.mode) for r in asked.orderBy(F.xxhash64("query")).limit(9).collect()] + [(-3, ["the", "the"], "phrase"), (-4, ["the"], "phrase")]
    for query, terms, mode in singles:
        one = [(k, r.doc, r.book_id, r.page_id, pytest.approx(r.score, abs=2e-9)) for k, r in enumerate(S.page(S.hits(index, parse(" ".join(terms), mode)), 5).collect(), 1)]
        assert sorted(held.get(query, [])) == one
        assert query < 0 or [x[1:3] for x in sorted(held.get(query + 1_000_000, []))] == [x[1:3] for x in sorted(held.get(query, []))]
