"""Nulls, empty and very long texts, ties, repeated rows, empty tables, clashing column names."""

import hashlib

import numpy as np
import pytest
from conftest import SF
from pyspark.sql import functions as F

from quire.llm import chat, common, exact_dedup, mixing, ngram_join, packing, quality, queries, secrets, token_count, topk, url_filter
from quire.llm import components as components_module
from quire.llm.common import RepeatFilter
from quire.llm.components import components

LONG = " ".join(f"w{i % 977}x{i}" for i in range(60_000))
ROWS = [
    (1, "alpha beta gamma delta epsilon zeta", "s1"), (2, "alpha  beta gamma delta\tepsilon zeta", "s1"), (3, None, None), (4, "", "s2"), (5, " \n", "s2"),
    (6, LONG, "s1"), (7, LONG + " tail", "s3"), (7, LONG + " tail", "s3"), (None, "alpha beta gamma delta epsilon zeta", "s1"), (8, "one two", None), (9, "one two", "s2"), (10, "solo", "s2"),
]
SCHEMA = "doc_id long, text string, source string, n_chars long, h string, row int, maybe int, sha string, node string, size string, label int, rank int, score string, target string"


@pytest.fixture(scope="module")
def rows(spark):
    return spark.createDataFrame([(i, t, s, len(t) if t else None, "h", 1, 2, "x", "n", "z", 0, 3, "sc", "tg") for i, t, s in ROWS], SCHEMA).repartition(3).cache()


@pytest.fixture(scope="module")
def none(rows):
    return rows.where("false")


def test_exact(rows, none):
    got = {(r.doc_id, r.keep_id, r.group_size, r.kept) for r in exact_dedup.classes(rows).collect()}
    assert {(1, 2, 3, False), (2, 2, 3, True), (None, 2, 3, False), (3, 5, 3, False), (4, 5, 3, False), (5, 5, 3, True), (6, 6, 1, True), (7, 7, 2, True), (7, 7, 2, False), (8, 8, 2, True), (9, 8, 2, False), (10, 10, 1, True)} == got
    assert sorted(r.doc_id for r in exact_dedup.dedup(rows).collect()) == [2, 5, 6, 7, 8, 10]
    assert exact_dedup.dedup(rows).columns == rows.columns
    assert exact_dedup.classes(none).count() == 0 and exact_dedup.dedup(none).count() == 0


def test_ngram(rows, none):
    got = {(r.doc_id, r.class_id, r.n_links) for r in ngram_join.classes(rows).collect()}
    assert {(1, 1, 0), (2, 1, 0), (None, 1, 0), (6, 6, 1), (7, 6, 1), (8, 8, 0), (9, 8, 0), (10, 10, 0), (3, 3, 0), (4, 4, 0), (5, 5, 0)} == got
    assert sorted(r.doc_id for r in ngram_join.dedup(rows.where("doc_id is not null")).collect()) == [1, 3, 4, 5, 6, 8, 10]
    assert ngram_join.classes(none).count() == 0


@pytest.mark.parametrize("told", [1 << 18, 8, 0])
def test_ngram_large_group(spark, monkeypatch, told):
    """A group far over the bucket limit, of different texts all alike, with its links counted by brute force; also where the large buckets are
    too many to tell every task of.
    """
    monkeypatch.setattr(ngram_join, "HOT_BUCKETS", told)
    base = [f"w{i}" for i in range(120)]
    texts = []
    for k in range(300):
        w = list(base)
        w[(7 * k) % 120] = f"v{k}"
        texts.append((k, " ".join(w)))
    texts += [(1000 + k, " ".join(f"u{k}_{i}" for i in range(30)) + " the same five words here are common to all") for k in range(200)]
    got = {r.doc_id: r for r in ngram_join.classes(spark.createDataFrame(texts, "doc_id long, text string"), limit=32).collect()}
    sh = ngram_join.Shingler()
    sets = {i: set(sh.shingles(t).tolist()) for i, t in texts}
    links = {i: 0 for i in sets}
    for i in sets:
        for j in sets:
            if i < j and sets[i] != sets[j] and len(sets[i] & sets[j]) >= 0.8 * len(sets[i] | sets[j]):
                links[i] += 1
                links[j] += 1
    assert {i: r.n_links for i, r in got.items()} == links
    assert {r.class_id for i, r in got.items() if i < 1000} == {0} and all(got[i].class_id == i for i in got if i >= 1000)


def test_ngram_rows_without_id_and_shared_ids(spark):
    """Near copies count whatever their doc_id; an unrelated text that shares one stays; of rows alike in doc_id and text one does."""
    base = [f"w{i}" for i in range(100)]
    near = " ".join([*base[:-1], "other"])
    texts = [(None, " ".join(base)), (None, near), (5, " ".join([*base[:-2], "x", "y"])), (5, "a text of its own that nothing else is like"), (5, "a text of its own that nothing else is like"), (6, ""), (6, ""), (6, None)]
    frame = spark.createDataFrame([(*t, 1) for t in texts], "doc_id long, text string, key int")
    got = sorted((r.doc_id or 0, r.class_id or 0, r.n_links) for r in ngram_join.classes(frame).collect())
    assert got == [(0, 5, 2), (0, 5, 2), (5, 5, 0), (5, 5, 0), (5, 5, 2), (6, 6, 0), (6, 6, 0), (6, 6, 0)]
    kept = ngram_join.dedup(frame)
    assert kept.columns == frame.columns
    assert sorted((r.doc_id or 0, (r.text or "")[:8]) for r in kept.collect()) == [(5, "a text o"), (5, "w0 w1 w2"), (6, ""), (6, ""), (6, "")]


def test_ngram_deep_rounds(spark):
    """Much boilerplate, few links: buckets stay above the limit through the first round. Recall of links against brute force."""
    rng = np.random.default_rng(5)
    common = [f"c{i}" for i in range(60)]
    texts = []
    for k in range(150):
        own = [f"o{k}_{i}" for i in range(int(rng.integers(10, 60)))]
        texts.append((2 * k, " ".join(common + own)))
        own[int(rng.integers(len(own)))] = "changed"
        texts.append((2 * k + 1, " ".join(common + own)))
    sh = ngram_join.Shingler()
    sets = {i: set(sh.shingles(t).tolist()) for i, t in texts}
    links = sum(len(sets[i] & sets[j]) >= 0.8 * len(sets[i] | sets[j]) for i in sets for j in sets if i < j)
    frame = spark.createDataFrame(texts, "doc_id long, text string")
    for limit, rounds in ((6, ((1, 2), (3, 6))), (5, ((1,), (2,), (3,))), (40, ((1, 2), (3, 6)))):
        got = ngram_join.classes(frame, limit=limit, rounds=rounds).agg(F.sum("n_links")).first()[0]
        assert 0.99 * links <= got / 2 <= links, rounds


def test_filters_in_parts(spark):
    """More hashes than a small filter holds go to several: few others are marked, and nothing is missed."""
    hashes = spark.range(6000).select(F.xxhash64("id").alias("h"))
    rows = spark.range(60_000).select("id", F.xxhash64("id").alias("h")).union(spark.sql("select 60000L as id, cast(null as long) as h"))
    for bits, most in ((1 << 26, 0.01), (1 << 12, 0.1)):
        filter_ = common.KeyFilter(hashes, "h", bits=bits)
        got = filter_.mark(rows, "h", "maybe")
        assert got.count() == 60_001 and got.columns == ["id", "h", "maybe"]
        assert got.where("maybe and id < 6000").count() == 6000 and got.where("maybe and id >= 6000").count() < most * 54_000 + 1
    twice = rows.where("id < 5000").union(rows)
    got = RepeatFilter(twice, "h", bits=1 << 14).mark(rows, "h", "maybe")
    assert got.where("maybe and id < 5000").count() == 5000 and got.where("maybe").count() < 6000


def test_checkpoints_of_a_run(spark):
    """A run removes its own checkpoints only, whatever other threads of the driver write meanwhile."""
    import threading
    from pathlib import Path

    ready, go_on, others = threading.Event(), threading.Event(), []

    def other():
        with common.own_cuts(spark):
            others.append(common.cut(spark.range(10)))
            ready.set()
            go_on.wait(60)
            others.append(others[0].count())

    t = threading.Thread(target=other)
    t.start()
    ready.wait(60)
    with common.own_cuts(spark):
        mine = common.cut(spark.range(5))
        path = Path(mine._jdf.logicalPlan().rdd().getCheckpointFile().get().removeprefix("file:"))
        assert path.exists()
    assert not path.exists()
    go_on.set()
    t.join()
    assert others[1] == 10


def test_quality_samples_documents_that_exist(spark):
    """Labels of ids that the documents lack neither fill the sample nor change the fit."""
    docs = spark.createDataFrame([(k, "good plain words here" if k % 3 else "BAD!!! 000 ###", 14) for k in range(60)], "doc_id long, text string, n_chars long")
    labels = spark.createDataFrame([(k, int(k % 3 > 0)) for k in range(60)], "doc_id long, quality int")
    more = labels.unionByName(spark.range(1000, 60_000).select(F.col("id").alias("doc_id"), F.lit(1).alias("quality")))
    one, two = quality.train(docs, labels, fit_rows=30), quality.train(docs, more, fit_rows=30)
    assert one.w0 == two.w0 and np.array_equal(one.w, two.w) and np.array_equal(one.v, two.v)


def test_topk_of_long_vectors_goes_in_more_waves(spark, monkeypatch):
    monkeypatch.setattr(topk, "WAVE_CELLS", 600)
    monkeypatch.setattr(topk, "FIT_CELLS", 600)
    rng = np.random.default_rng(8)
    m = np.floor(256 * rng.standard_normal((80, 100)).astype("f4").astype("f8"))
    rows = spark.createDataFrame([(i, [float(x) / 256 for x in v]) for i, v in enumerate(m)], "vec_id long, embedding array<float>")
    got = {(r.query_id, r["rank"]): (r.vec_id, r.score) for r in topk.search(rows, rows.where("vec_id % 4 = 0")).collect()}
    for q in range(0, 80, 4):
        best = sorted(((-int(m[q] @ m[v]), v) for v in range(80) if v != q))[:5]
        assert [got[q, k + 1] for k in range(5)] == [(v, -s) for s, v in best]


def test_repeat_filter(spark):
    """No repeated hash is missed, few others are marked, and hashes go four bytes each, not rows, into the one exchange that grows."""
    rows = spark.range(0, 60_000, 1, 6).select(F.xxhash64(F.when(F.col("id") % 3 == 0, -1).when(F.col("id") % 7 == 0, F.col("id") % 500).otherwise(F.col("id"))).alias("h"), F.lit("a text").alias("text"))
    marked = RepeatFilter(rows, "h").mark(rows, "h", "maybe")
    true = rows.groupBy("h").agg(F.count("*").alias("n"))
    told = {(r.rep, r.maybe): r.n for r in marked.join(true, "h").groupBy((F.col("n") > 1).alias("rep"), "maybe").agg(F.count("*").alias("n")).collect()}
    assert (True, False) not in told and told.get((False, True), 0) < 0.01 * told[False, False]
    plan = marked._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastHashJoin" in plan and "Exchange hashpartitioning" not in plan
    none = rows.where("false")
    assert RepeatFilter(none, "h").mark(rows.limit(5), "h", "maybe").where("maybe").count() == 0


def test_full_filter(spark, monkeypatch):
    """A filter that has reached its bound says "maybe" more often; results are the same, and nothing but possibly repeated rows moves."""
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    want = sorted(r.doc_id for r in exact_dedup.dedup(docs).collect())
    monkeypatch.setattr(common, "MAX_FILTER_BITS", 4096)
    kept = exact_dedup.dedup(docs)
    exchanges = [line for line in kept._jdf.queryExecution().executedPlan().toString().splitlines() if "Exchange hashpartitioning" in line]
    assert len(exchanges) == 1 and "sha" in exchanges[0]
    assert sorted(r.doc_id for r in kept.collect()) == want


def test_wide_hot_groups(spark, monkeypatch):
    """Large groups whose rows are too wide to broadcast are dealt over salts."""
    monkeypatch.setattr(common, "MAX_BROADCAST_BYTES", 10)
    rows = spark.range(3000).select(F.when(F.col("id") < 1000, F.lit("hot")).otherwise(F.concat(F.lit("k"), F.col("id"))).alias("k"))
    groups = rows.groupBy("k").agg(F.count("*").alias("n"), F.lit("wide").alias("w"))
    got = common.join_groups(rows, groups, "k", "n")
    assert got.groupBy("k").agg(F.count("*").alias("c"), F.max("n").alias("n")).where("c <> n").count() == 0 and got.count() == 3000


def test_components(spark):
    edges = [(k, k + 1) for k in range(0, 60)] + [(100, k) for k in range(101, 140)] + [(7, 7), (140, 100)]
    got = {r.node: r.label for r in components(spark.createDataFrame(edges, "u long, v long")).collect()}
    assert got == {k: 0 for k in range(1, 61)} | {k: 100 for k in range(101, 141)}
    assert components(spark.createDataFrame([(None, 1), (2, 2)], "u long, v long")).count() == 0


def test_components_of_many_partitions(spark, monkeypatch):
    """The path that larger edge tables take."""
    monkeypatch.setattr(common, "PARTITION_ROWS", 40)
    monkeypatch.setattr(components_module, "PARTITION_ROWS", 40)
    edges = [(k, k + 1) for k in range(0, 40)] + [(100, k) for k in range(101, 240)] + [(140, 100), (300, 140)]
    got = {r.node: r.label for r in components(spark.createDataFrame(edges, "u long, v long")).collect()}
    assert got == {k: 0 for k in range(1, 41)} | {k: 100 for k in [*range(101, 240), 300]}


def test_mix(rows, none):
    got = mixing.report(rows).collect()
    assert len(got) == len(ROWS) and all(0 <= r.taken <= 3 * r["size"] for r in got)
    assert mixing.report(none).count() == 0
    mixed = mixing.mix(rows)
    assert mixed.columns == rows.columns
    assert mixed.count() == sum(1 if r["size"] == 0 else r.copies for r in got)
    assert mixing.mix(none).count() == 0


def test_mix_of_a_repeated_row(spark, monkeypatch):
    """A source that is mostly one repeated row meets its target: the cutoff lies between rows alike. Small ranges force several descents."""
    monkeypatch.setattr(mixing, "RANGE_ROWS", 4)
    monkeypatch.setattr(mixing, "FAN_BITS", 3)
    rows = [(1, "one two three four", "a")] * 600 + [(k, "five six", "a") for k in range(2, 50)] + [(k, " ".join(["w"] * (k % 40)), "b") for k in range(100, 200)]
    frame = spark.createDataFrame(rows, "doc_id long, text string, source string").repartition(3).cache()
    for s, target, taken in mixing.report(frame).groupBy("source").agg(F.first("target"), F.sum("taken")).collect():
        assert abs(target - taken) <= 40, s


def test_source_ranks_over_many_partitions(spark, monkeypatch):
    monkeypatch.setattr(mixing, "PARTITION_ROWS", 7)
    names = [f"s{k}" for k in range(50)] + ["\U0001f642", "\uffff", "Z", ""]
    frame = spark.createDataFrame([(n, 10 + k) for k, n in enumerate(names)] + [(None, 5)], "source string, size long")
    got = {r.source: r.target for r in mixing.source_targets(frame).collect()}
    size = dict(frame.collect())
    order = [*sorted(names), None]
    w = {s: k % 3 + 1 for k, s in enumerate(order)}
    low, high = 0.0, float(sum(size.values()))
    for _ in range(200):
        mid = (low + high) / 2
        low, high = (mid, high) if sum(min(3.0 * size[s], mid * w[s]) for s in order) < sum(size.values()) else (low, mid)
    assert got == {s: pytest.approx(min(3.0 * size[s], low * w[s]), rel=1e-6) for s in order}


def test_tokens(rows, none):
    path = queries.vocabulary("word_bpe_49k.json")
    got = {r.doc_id: (r.n_bytes, r.over_limit) for r in token_count.count(rows, path).collect()}
    assert got[3] == (0, False) and got[6] == (len(LONG), True)
    all_ = [(r.doc_id, r.n_bytes) for r in token_count.count(rows, path).collect()]  # repeated rows and null ids each count
    assert len(all_) == len(ROWS) and all_.count((7, len(LONG) + 5)) == 2 and all_.count((None, len(ROWS[0][1]))) == 1
    assert token_count.count(none, path).count() == 0


def test_packing(rows, none):
    from test_queries import check_packing

    path = queries.vocabulary("byte_bpe_50k.json")
    some = rows.where("doc_id is not null").dropDuplicates(["doc_id"])
    check_packing(packing.pack(some, path).toPandas(), [(r.doc_id, r.text) for r in some.collect()])
    assert packing.pack(rows, path).where("doc_id = 7").selectExpr("sum(length) s", "max(doc_tokens) m").first() == tuple([2 * (m := packing.pack(rows, path).where("doc_id = 7").agg(F.max("doc_tokens")).first()[0]), m])
    assert packing.pack(none, path).count() == 0


def test_quality(rows, none, spark):
    labels = spark.createDataFrame([(1, 1, 0, "x"), (1, 1, 0, "x"), (4, 0, 0, "x"), (6, None, 0, "x"), (None, 1, 0, "x"), (99, 1, 0, "x")], "doc_id long, quality int, toxic int, text string")
    got = quality.report(rows, labels).collect()
    assert len(got) == len(ROWS) and all(0 <= r.score <= 1 for r in got)
    assert {r.score for r in quality.report(rows, labels.where("false")).collect()} == {0.5}
    assert quality.keep(rows, labels).columns == rows.columns
    assert quality.report(none, labels).count() == 0 and quality.keep(none, labels).count() == 0
    assert {r.score for r in quality.report(rows, labels.where("doc_id = 99")).collect()} == {0.5}


def test_secrets(spark, none, tmp_path):
    text = "Token: 'abcdefgh' pass\u212aword=zzzzzzzzzz AKIA1234567890AB deadbeef" + "0" * 24 + " \U0001f642 PASSWD=short api_key=0123456789abcdef0123456789abcdef"
    rows = spark.createDataFrame([(1, text, 1), (2, text, 1), (2, text, 1), (None, text, 1), (3, None, 1)], "doc_id long, text string, blob int")
    got = secrets.scan(rows, secrets.Ledger(spark, str(tmp_path / "a"))).collect()
    spans = [s for r in got if r.doc_id == 1 for s in r.spans.split(",")]
    assert [s.split(":")[0] for s in spans] == ["assign", "access", "hex", "assign", "hex"]
    assert len(got) == 5 and {r.spans for r in got if r.doc_id != 3} == {",".join(spans)}
    assert secrets.scan(none, secrets.Ledger(spark, str(tmp_path / "b"))).count() == 0
    long = ("x" * 50 + " ") * 40_000 + "token=abcdefgh1"
    r = secrets.scan(spark.createDataFrame([(1, long)], "doc_id long, text string"), secrets.Ledger(spark, str(tmp_path / "c"))).first()
    assert r.spans == f"assign:{len(long) - 15}:{len(long)}"


def test_urls(spark):
    urls = [None, "", "no scheme", "http://", "HTTPS://A.Example.NET/en/x?y", "http://net/", "http://net", "http://xnet/", "http://example.com/de/?q", "http://example.com/dex", "http://b.org/fr/", "http://b.org/frx", "x://É.NET/", "a://b://net/", "http://a.net?x/", "http://example.net/en"]
    got = [(r.page_id, r.host, r.path, r.rule, r.verdict) for r in url_filter.judge(spark.createDataFrame(list(enumerate(urls)), "page_id long, url string"), queries.URL_RULES).orderBy("page_id").collect()]
    want = [("", "", None, "allow")] * 4 + [("a.example.net", "/en/x", "example.net/en/", "allow"), ("net", "/", "net/", "block"), ("net", "", None, "allow"), ("xnet", "/", None, "allow"), ("example.com", "/de/", "example.com/de/", "block"), ("example.com", "/dex", None, "allow"), ("b.org", "/fr/", "org/fr/", "allow"), ("b.org", "/frx", None, "allow"), ("É.net", "/", "net/", "block"), ("b:", "//net/", None, "allow"), ("a.net", "", None, "allow"), ("example.net", "/en", "net/", "block")]
    assert [x[1:] for x in got] == want


def test_urls_long_repeated_and_clashing(spark):
    rows = [(1, "http://" + "a." * 100_000 + "org/fr/x", "h", "p"), (2, "http://b.net/" + "y/" * 200_000, "h", "p"), (3, "http://net/", None, None), (3, "http://net/", None, None), (None, None, None, None)]
    frame = spark.createDataFrame(rows, "page_id long, url string, host string, rule string")
    got = sorted((r.page_id or 0, r.rule or "", r.verdict, len(r.host)) for r in url_filter.judge(frame, queries.URL_RULES).collect())
    assert got == [(0, "", "allow", 0), (1, "org/fr/", "allow", 200_003), (2, "net/", "block", 5), (3, "net/", "block", 3), (3, "net/", "block", 3)]
    assert url_filter.judge(frame.where("false"), queries.URL_RULES).count() == 0
    assert {r.verdict for r in url_filter.judge(frame, [], "block").collect()} == {"block"}


def test_digest_collisions():
    """With a digest that always collides only the stored strings decide."""
    a = url_filter.DigestArray.build({"x": 1, "y": 2, "zz": 3}, key=lambda s: 7)
    assert a.find(["y", "w", "zz", "x"], key=lambda s: 7).tolist() == [2, -1, 3, 1]


def test_topk(spark):
    rng = np.random.default_rng(3)
    rows = [(i, [float(x) for x in rng.integers(-2, 3, 4)]) for i in range(300)] + [(300 + i, [0.5, 0.5, 0.5, 0.5]) for i in range(40)]
    rows += [(1000, None), (1001, [float("nan"), 0.0, 0.0, 0.0]), (1002, [None, 1.0, 1.0, 1.0]), (50, rows[50][1]), (1050, [9.0, float("inf"), 0.0, 0.0]), (1100, [3.0])]
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = [(r.query_id, r.rank, r.vec_id, r.score) for r in topk.search(frame, frame.where("vec_id % 50 = 0")).orderBy("query_id", "rank").collect()]
    v = {i: np.array([np.floor(256 * x) for x in e] + [0] * (4 - len(e))) for i, e in rows if e is not None and all(x is not None and np.isfinite(x) for x in e)}
    want = []
    for q in sorted(i for i in v if i % 50 == 0):
        best = sorted(((-int(v[q] @ v[c]), c) for c in v if c != q))[:5]
        want += [(q, k + 1, c, -s) for k, (s, c) in enumerate(best)]
    assert got == want
    assert topk.search(frame.where("false"), frame.where("false")).count() == 0
    assert topk.search(frame.where("vec_id < 3"), frame.where("vec_id = 0")).count() == 2


def test_topk_in_waves(spark, monkeypatch):
    """Several waves, a sample much smaller than the table, clashing column names; nearby vectors let most products be skipped."""
    monkeypatch.setattr(topk, "WAVE", 30)
    monkeypatch.setattr(topk, "FIT_ROWS", 200)
    monkeypatch.setattr(topk, "BLOCK", 16)
    rng = np.random.default_rng(4)
    centres = rng.normal(size=(40, 6)) * 8
    rows = [(i, [float(x) for x in centres[i % 40] + rng.normal(size=6) / 10], "x", 1.0, 2) for i in range(4000)]
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<double>, v string, norm double, pivot int").repartition(3)
    queries = frame.where("vec_id % 50 = 0")
    got = sorted((r.query_id, r.rank, r.vec_id) for r in topk.search(frame, queries).collect())
    ids, m = np.array([r[0] for r in rows]), np.floor(256 * np.array([r[1] for r in rows]))
    want = []
    for q in range(0, 4000, 50):
        scores = m @ m[q]
        best = sorted((-s, i) for s, i in zip(scores.tolist(), ids.tolist()) if i != q)[:5]
        want += [(q, k + 1, i) for k, (_, i) in enumerate(best)]
    assert got == want
    done, possible = topk.evaluated(frame, queries)
    assert possible == 80 * 4000 and done < 0.5 * possible, (done, possible)


def test_topk_of_long_vectors(spark):
    """Finite vectors of any length take part, with exact products cut to the ends of a long."""
    rows = [(0, [1e15, 0.0]), (50, [1.0, 2.0]), (1, [3.0, -1.0]), (2, [-1e6, 1e6 + 1 / 256]), (3, [1e300, 0.0]), (4, [-1.7e308, 1.0]), (5, [1e6, 1e6]), (6, [3e9, 1.0]), (100, [2e7, -3e7])]
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = [(r.query_id, r.rank, r.vec_id, r.score) for r in topk.search(frame, frame.where("vec_id % 50 = 0")).orderBy("query_id", "rank").collect()]
    v = {i: [int(np.floor(x * 256)) if abs(x) < 1e300 else int(x) * 256 for x in e] for i, e in rows}
    clip = lambda n: max(-(1 << 63), min((1 << 63) - 1, n))
    want = []
    for q in (0, 50, 100):
        best = sorted((-clip(sum(a * b for a, b in zip(v[q], v[c], strict=True))), c) for c in v if c != q)[:5]
        want += [(q, k + 1, c, -s) for k, (s, c) in enumerate(best)]
    assert got == want


CONTROL = ["</s>", "<s>", "[INST]", "[/INST]", "\\", "<|image|>", "<|audio|>", "a\nb", "[\\INST]", "<", "/s>", " [/INST]", "[INST] "]


def test_chat_round_trip(spark):
    texts = [x + y for x in CONTROL for y in CONTROL] + [None, "", "x" * 100_000]
    rows = [(k // 10, k % 10, ["user", "assistant", "system", None, "r\n<s>"][k % 5], t) for k, t in enumerate(texts)] + [(None, None, "assistant", "x"), (None, None, "assistant", "x")]
    frame = spark.createDataFrame([(*r, "extra") for r in rows], "conv_id long, turn long, role string, text string, at string")
    done = chat.format_chats(chat.with_parts(frame)).withColumn("turns", chat.read_back(F.col("formatted")))
    done = done.withColumn("spans", F.transform("loss_spans", lambda s: F.substring("formatted", (s["start"] + 1).cast("int"), (s["end"] - s["start"]).cast("int"))))
    for r in done.withColumn("loss", F.transform("spans", chat.unescape)).collect():
        want = [(role or "", t or "") for c, _, role, t in sorted((x for x in rows if x[0] == r.conv_id), key=lambda x: x[1] or 0)]
        assert [(t.role, t.text) for t in r.turns] == want
        assert r.loss == [t for role, t in want if role == "assistant"] and r.mask == [role == "assistant" for role, _ in want]
    assert chat.format_chats(chat.with_parts(frame.where("false"))).count() == 0


def test_chat_parts(spark):
    parts = [("text", "see <|image|>", None, None), ("image", None, "a.png", 12), ("audio", None, "b.wav", None), ("text", " end", None, None), (None, "?", None, None)]
    frame = spark.createDataFrame([(1, 0, "user", parts), (1, 1, "assistant", None)], f"conv_id long, turn long, role string, parts {chat.PART}")
    r = chat.format_chats(frame).first()
    assert r.formatted == "<s>user\n[INST] see <\\|image|><|image|><|audio|> end? [/INST]</s><s>assistant\n</s>"
    assert [tuple(a) for a in r.attachments] == [("image", "a.png", 12), ("audio", "b.wav", 1500)] and r.expanded_tokens == 1512


def test_chat_typed_parts_against_a_plain_rendering(spark):
    """Conversations of several turns with parts of every kind: placeholders in order, references, token counts, spans and the way back."""
    rng = np.random.default_rng(8)
    kinds = ["text", "image", "audio", "document", "odd", None]
    texts = ["plain", "<|image|> typed", "a\\b", "</s>", "[INST]x[/INST]", None, "", "é🙂"]
    rows = []
    for c in range(12):
        for t in range(int(rng.integers(1, 7))):
            parts = [(kinds[int(rng.integers(6))], texts[int(rng.integers(8))], f"ref{c}.{t}.{k}", [None, 7][int(rng.integers(2))]) for k in range(int(rng.integers(0, 5)))]
            rows.append((c, t, ["user", "assistant", "system"][t % 3], parts))
    frame = spark.createDataFrame([(*r, "x") for r in rows], f"conv_id long, turn long, role string, parts {chat.PART}, formatted string").repartition(3)
    done = chat.format_chats(frame).withColumns({"turns": chat.read_back(F.col("formatted")), "loss": chat.under_mask(F.col("formatted"), F.col("loss_spans"))})
    got = {r.conv_id: r for r in done.collect()}
    for c in range(12):
        mine = [r for r in rows if r[0] == c]
        shown = ["".join(chat.PLACEHOLDERS.get(k) or t or "" for k, t, _, _ in parts) for *_, parts in mine]
        held = [(k, ref, n or chat.DEFAULT_TOKENS[k]) for *_, parts in mine for k, _, ref, n in parts if k in chat.PLACEHOLDERS]
        r = got[c]
        assert [(t.role, t.text) for t in r.turns] == [(m[2], s) for m, s in zip(mine, shown, strict=True)]
        assert [tuple(a) for a in r.attachments] == held and r.expanded_tokens == sum(n for *_, n in held)
        assert r.loss == "".join(s for m, s in zip(mine, shown, strict=True) if m[2] == "assistant")
        assert sum(len(__import__("re").findall(r"<\|(?:image|audio|document)\|>", r.formatted)) for _ in (0,)) == len(held)


def test_control_conversation(spark):
    from conftest import SMALL

    r = queries.op10_chat_format(spark, SMALL).where("conv_id = -1").first()
    text = queries.CONTROL_TEXT
    assert (r.n_turns, r.loss_chars) == (2, len(text)) and r.loss_sha256 == hashlib.sha256(text.encode()).hexdigest()
    assert r.turns_sha256 == hashlib.sha256(f"user\n{text}\nassistant\n{text}\n".encode()).hexdigest()
