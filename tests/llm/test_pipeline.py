"""The pipeline's stages, each against a plain rendering of its task over what the stage before kept."""

import re
from collections import Counter

import pytest
from conftest import SMALL
from pyspark.sql import functions as F

import corpus_pipeline
from quire.llm import ngram_join, quality
from quire.llm.common import shared_dir


@pytest.fixture(scope="module")
def stages(spark, tmp_path_factory):
    folder = tmp_path_factory.mktemp("stages")
    docs, out = spark.read.parquet(f"{SMALL}/documents.parquet"), {}
    out["start"] = docs.toPandas()
    for name, f in corpus_pipeline.STAGES:
        f(spark, docs, SMALL).write.parquet(f"{folder}/{name}")
        docs = spark.read.parquet(f"{folder}/{name}")
        out[name] = docs.toPandas()
    return out


def test_names():
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality", "exact_dedup", "near_dedup", "mix", "pack"]


def test_columns(stages):
    for name in ("quality", "exact_dedup", "near_dedup", "mix"):
        assert list(stages[name].columns) == ["doc_id", "text", "lang", "source", "n_chars"]


def test_empty_documents(spark):
    """Every stage passes an empty table on."""
    docs = spark.read.parquet(f"{SMALL}/documents.parquet").where("false")
    for name, f in corpus_pipeline.STAGES:
        got = f(spark, docs, SMALL)
        assert got.count() == 0 and (name == "pack" or got.columns == docs.columns), name


@pytest.fixture(scope="module")
def odd(spark):
    """The smallest documents, and rows with nulls in every column, empty and long texts, repeated rows, shared ids, and columns of other names."""
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    long = " ".join(f"w{i % 977}x{i}" for i in range(40_000))
    rows = [(None, "a text without an id or a source", None, None, None), (900_001, None, "en", "src1", None), (900_002, "", "en", None, 0), (900_003, " \n", None, "src1", 2), (900_004, long, "en", "src2", len(long)),
            (900_005, long, "en", "src2", len(long)), (900_005, long, "en", "src2", len(long)), (900_005, "another text of the same id", "en", "src2", 27), (900_006, long + " tail", "en", "src3", None)]
    more = spark.createDataFrame(rows, docs.schema).repartition(3)
    extra = {c: F.lit("q") for c in ("row", "h", "key", "maybe", "rid", "turn", "score", "label", "sha", "node", "size", "target", "taken", "class_id", "n", "bytes")}
    return docs.unionByName(more).withColumns(extra).cache()


def rows_of(df):
    return Counter((r.doc_id, r.text, r.lang, r.source, r.n_chars) for r in df.collect())


@pytest.mark.parametrize("stage", range(5))
def test_stages_on_odd_rows(spark, odd, stage):
    """Each stage has a defined result for such rows: no row is changed, none appears, and what it has to keep is there."""
    name, f = corpus_pipeline.STAGES[stage]
    was, got = rows_of(odd), f(spark, odd, SMALL)
    if name == "pack":
        pieces = got.toPandas()
        assert set(pieces[pieces.start == 0].doc_id.dropna()) == {r[0] for r in was if r[0] is not None} and (pieces.start == 0).sum() == sum(was.values())
        return
    assert got.columns == odd.columns
    now = rows_of(got)
    assert set(now) <= set(was)
    if name == "quality":
        assert all(now[r] in (0, was[r]) for r in was)  # rows that are alike are judged alike
    if name == "exact_dedup":
        groups = {}
        for r in was:
            key = re.sub(r"[\x20\x09-\x0D]", "", r[1] or "")
            groups[key] = max(groups.get(key, (-1, False, 0)), (len(r[1] or ""), r[0] is not None, -(r[0] or 0)))
        assert sum(now.values()) == len(groups)
        assert sorted(str(r[0]) for r in now.elements()) == sorted(str(-b[2]) if b[1] else "None" for b in groups.values())
    if name == "near_dedup":
        ids = Counter(r[0] for r in now.elements())
        # of the long text, its repeats and its near copy the least id stays; texts without words stay all
        assert ids[900_004] == 1 and ids[900_005] == 1 and ids[900_006] == 0 and ids[900_001] == ids[900_002] == ids[900_003] == 1 and ids[None] == 1
        assert [r[1] for r in now if r[0] == 900_005] == ["another text of the same id"]
    if name == "mix":
        assert all(now[r] <= 3 * was[r] for r in was)


def test_exact(stages):
    best = {}
    for r in stages["quality"].itertuples():
        key = re.sub(r"[\x20\x09-\x0D]", "", r.text or "")
        best[key] = max(best.get(key, (-1, 0)), (len(r.text or ""), -r.doc_id))
    assert sorted(stages["exact_dedup"].doc_id) == sorted(-b[1] for b in best.values())


def test_near(stages):
    sh = ngram_join.Shingler()
    sets = {r.doc_id: set(sh.shingles(r.text).tolist()) for r in stages["exact_dedup"].itertuples()}
    label = {i: i for i in sets}
    changed = True
    while changed:
        changed = False
        for i in sets:
            for j in sets:
                if i < j and sets[i] and len(sets[i] & sets[j]) >= 0.8 * len(sets[i] | sets[j]) and label[i] != label[j]:
                    label[i] = label[j] = min(label[i], label[j])
                    changed = True
    assert sorted(stages["near_dedup"].doc_id) == sorted(i for i in sets if label[i] == i)


def test_quality(stages, spark):
    """The stage keeps what a machine fitted on the same rows scores at the threshold or above, text by text."""
    labels = spark.read.parquet(f"{SMALL}/labels.parquet")
    m, features = quality.train(spark.read.parquet(f"{SMALL}/documents.parquet"), labels), quality.Features()
    kept = [r.doc_id for r in stages["start"].itertuples() if m.scores([features.of(r.text or "", float(r.n_chars or 0))])[0] >= quality.THRESHOLD]
    assert sorted(stages["quality"].doc_id) == sorted(kept) and len(kept) < len(stages["start"])


def test_mix(stages):
    """Every source near its target: shares by weight, none above three times its words."""
    near = stages["near_dedup"]
    size = {r.doc_id: len(re.findall(r"[^\x20\x09-\x0D]+", r.text or "")) for r in near.itertuples()}
    times = Counter(stages["mix"].doc_id)
    assert set(times) <= set(size) and max(times.values()) <= 3
    per, taken, longest = Counter(), Counter(), Counter()
    for r in near.itertuples():
        per[r.source] += size[r.doc_id]
        taken[r.source] += size[r.doc_id] * times[r.doc_id] if size[r.doc_id] else 0
        longest[r.source] = max(longest[r.source], size[r.doc_id])
    weight = {s: k % 3 + 1 for k, s in enumerate(sorted(per))}
    low, high = 0.0, float(sum(per.values()))
    for _ in range(200):
        mid = (low + high) / 2
        low, high = (mid, high) if sum(min(3.0 * per[s], mid * weight[s]) for s in per) < sum(per.values()) else (low, mid)
    for s in per:
        target = min(3.0 * per[s], low * weight[s])
        # a source of a dozen documents can be off by half of one
        assert abs(taken[s] - target) <= max(0.03 * target, longest[s] / 2 + 64), s


def test_pack(stages):
    assert stages["pack"].length.sum() == stages["pack"][stages["pack"].start == 0].doc_tokens.sum()
    assert (stages["pack"].start == 0).sum() == len(stages["mix"])


def test_run(spark, stages):
    """The same rows; of the stages' tables only the last is left, and no checkpoint."""
    from pathlib import Path
    from urllib.parse import urlparse

    folder = Path(urlparse(shared_dir(spark)).path)
    known, before = set(folder.glob("rdd-*")), set(folder.glob("pipeline-*"))
    assert corpus_pipeline.run(spark, SMALL).count() == len(stages["pack"])
    (own,) = set(folder.glob("pipeline-*")) - before
    assert [p.name for p in own.iterdir() if p.is_dir()] == ["pack"] and set(folder.glob("rdd-*")) <= known
