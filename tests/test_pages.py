"""The page store: what a lookup reads, what moves, and that waves of requests give what a plain join gives."""

import re
import uuid

import pytest
from conftest import SF
from pyspark.sql import functions as F

from quire import queries as Q
from quire.operators import passages as P
from quire.sources import corpus
from quire.sources import pages as S


def read_by(spark, run):
    """What run() gives, and the bytes and rows that the tasks of its jobs have read."""
    sc, group = spark.sparkContext, uuid.uuid4().hex
    sc.setJobGroup(group, "")
    try:
        out = run()
    finally:
        sc.setLocalProperty("spark.jobGroup.id", None)
    sc._jsc.sc().listenerBus().waitUntilEmpty(30_000)
    held = sc._jsc.sc().statusStore()
    stages = [held.lastStageAttempt(i) for i in {i for j in sc.statusTracker().getJobIdsForGroup(group) for i in sc.statusTracker().getJobInfo(j).stageIds}]
    return out, sum(s.inputBytes() for s in stages), sum(s.inputRecords() for s in stages)


def size_of(spark, path):
    fs = spark._jvm.org.apache.hadoop.fs.Path(path)
    return fs.getFileSystem(spark._jsc.hadoopConfiguration()).getContentSummary(fs).getLength()


def exchanged(df):
    """Columns that go into exchanges of any kind."""
    plan = df._jdf.queryExecution().explainString(df.sparkSession._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("formatted"))
    found = re.findall(r"\(\d+\) (?:Broadcast)?Exchange\s*\nInput \[\d+\]: \[([^\]]*)\]", plan)
    assert found or "Exchange" not in plan
    return {re.sub(r"#\d+L?$", "", c.strip()) for x in found for c in x.split(",")}


def test_a_lookup_reads_its_pages_only(spark):
    """Of 10,000 pages some PAGE_ROWS for each request are decoded. Bytes are mostly read buffers of 64 KB for the footers and indexes of three files,
    which don't grow with the store: a thousandth of check_l's.
    """
    big = "/root/testdata/sf0.1"
    store = corpus.page_store(spark, big)
    books = [r.book_id for r in store.locator.groupBy("book_id").agg(F.max("last").alias("n")).orderBy(F.desc("n"), "book_id").limit(3).collect()]
    asked = [(b, p) for b in books for p in (3, 40)]
    got, read, rows = read_by(spark, lambda: store.few(asked).select("book_id", "page_id", "body").collect())
    assert {(r.book_id, r.page_id) for r in got} == set(asked)
    assert rows <= 6 * 2 * S.PAGE_ROWS + store.locator.count() and read < 0.06 * size_of(spark, f"{store.path}/pages"), (rows, read)
    requests = spark.createDataFrame(asked, "book_id string, page_id int")
    all_, read, rows = read_by(spark, lambda: P.looked_up(requests, store).select("book_id", "page_id", "found", "body").collect())
    assert len(all_) == 6 and all(r.found for r in all_) and rows < 600, (rows, read)


@pytest.mark.parametrize("name", ["lookup_batched_misses", "fetch_with_query", "export_rows", "compare_groups_excerpts", "unreadable_books"])
def test_no_exchange_holds_a_text(spark, name):
    before = {k: spark.conf.get(k) for k in ("spark.sql.autoBroadcastJoinThreshold", "spark.sql.adaptive.enabled")}
    try:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "1m")
        spark.conf.set("spark.sql.adaptive.enabled", "false")
        assert not exchanged(Q.queries()[name](spark, SF)) & {"body", "text_original"}
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)


def test_waves(spark, monkeypatch, tmp_path):
    """More requests than a broadcast may have, more of one file than that, repeats, misses, and requests of unknown books."""
    rows = spark.range(3000).select(F.concat(F.lit("b"), (F.col("id") / 400).cast("int")).alias("book_id"), (F.col("id") % 400 + 1).cast("int").alias("page_id"), F.concat(F.lit("text "), "id").alias("body"))
    store = S.PageStore.write(rows.repartitionByRange(6, "book_id", "page_id").sortWithinPartitions("book_id", "page_id"), str(tmp_path / "store"))
    asked = spark.range(700).select(F.concat(F.lit("b"), F.col("id") % 9).alias("book_id"), (F.col("id") * 7 % 430).cast("int").alias("page_id"), F.col("id").alias("doc"), F.lit(1).alias("k"))
    asked = asked.unionByName(asked.where("doc < 50"))
    plain = sorted(map(tuple, asked.join(rows, ["book_id", "page_id"], "left").withColumn("found", F.col("body").isNotNull()).collect()), key=str)
    for few, most in ((512, 100_000), (4, 100_000), (4, 150), (4, 30)):
        monkeypatch.setattr(S, "FEW", few)
        monkeypatch.setattr(S, "MAX_BROADCAST_ROWS", most)
        got = P.looked_up(asked, store).select("book_id", "page_id", "doc", "k", "body", "found")
        assert sorted(map(tuple, got.collect()), key=str) == plain
    assert store.few([]).count() == 0 == store.few([("b0", 9999), ("x", 1)]).count()
    assert P.looked_up(asked.where("false"), store).count() == 0 == P.looked_up(asked.where("book_id = 'b8'"), store).where("found").count()
