"""Spelling variants, the Merkle manifest and toxicity: by brute force, on edges, and beyond one bucket, vertex or member."""

import hashlib
import re
import zlib
from collections import defaultdict

import numpy as np
import pandas as pd
import pytest
from conftest import SF
from pyspark.sql import functions as F

from quire.llm import merkle, queries, spelling, toxicity

ROWS = "doc_id long, text string, lang string, source string, n_chars long, word string, n long, score string, leaf string, tree string, path string"


def brute_near(words):
    near, less = defaultdict(set), defaultdict(set)
    for w in words:
        for k in range(len(w)):
            less[k, w[:k] + w[k + 1 :]].add(w)
            if w[:k] + w[k + 1 :] in words:
                near[w].add(w[:k] + w[k + 1 :])
                near[w[:k] + w[k + 1 :]].add(w)
    for alike in less.values():
        for w in alike:
            near[w] |= alike - {w}
    return near


def brute_variants(words, ratio=10):
    near, form = brute_near(words), {}
    for w, n in words.items():
        best = min(near[w], key=lambda x: (-words[x], x), default=None)
        form[w] = best if best is not None and words[best] >= ratio * n else None

    def root(w):
        while form[w] is not None:
            w = form[w]
        return w

    return {(w, form[w], root(w), n, len(near[w]), words.get(form[w])) for w, n in words.items()}


def test_spelling_chains_ties_and_shared_bits(spark):
    """Forms that lead on over several words, ties, code points beyond the bits' letters, and words that differ in a swap only."""
    words = {"abcdefg": 10**6, "abcdefh": 10**5, "abcdeih": 10**4, "abjdeih": 900, "akjdeih": 80, "akjdeihl": 7, "zzzzzzz": 5, "zzzzzzy": 50, "zzzzzzx": 50, "abcdegf": 3}
    words |= {"".join(chr(0x4E00 + 7 * k + j) for j in range(7)): k + 1 for k in range(40)}
    words |= {"".join(chr(0x4E00 + 7 * k + j) for j in range(6)) + "a": 1000 for k in range(40)}
    df = spark.createDataFrame([(w, n, "x") for w, n in words.items()], "word string, n long, path string")
    got = {tuple(r) for r in spelling.variants(df).collect()}
    assert got == brute_variants(words)
    assert ("akjdeihl", "akjdeih", "abcdefg", 7, 1, 80) in got
    assert {tuple(r) for r in spelling.variants(df, limit=3).collect()} == got


def test_spelling_splits_large_buckets(spark):
    """Words of few letters fill few buckets; each is split down to a few words, and no near pair is lost or counted twice."""
    rng = np.random.default_rng(5)
    words = {"".join("abcd"[k] for k in rng.integers(0, 4, rng.integers(7, 10))): int(rng.integers(1, 500)) for _ in range(1500)}
    df = spark.createDataFrame(list(words.items()), "word string, n long")
    want = brute_variants(words)
    for limit in (1024, 20):
        assert {tuple(r) for r in spelling.variants(df, limit=limit).collect()} == want


def test_spelling_edges(spark):
    long = "abcdefgh" * 5000
    docs = spark.createDataFrame([(1, f"Wörterbuch wörterbuch x {long}"), (2, f"{long} {long}z WÖRTERBUCH"), (2, None), (None, ""), (None, "Wörterbuch-Wörterbuchs short")], "doc_id long, text string").withColumns({c: F.lit("q") for c in ("word", "path", "id")})
    runs = {(r.id, r.run) for r in spelling.runs(docs).collect()}
    assert runs == {("1", "wörterbuch"), ("1", long), ("2", long), ("2", long + "z"), ("2", "wÖrterbuch"), ("", "wörterbuch"), ("", "wörterbuchs")}
    words = spelling.counted(spelling.runs(docs).select(F.col("run").alias("word")), occurrences=1)
    got = {r.word: r for r in spelling.variants(words, ratio=1).collect()}
    assert got["wörterbuchs"].form == "wörterbuch" and got["wörterbuch"].n == 3 and got["wörterbuch"].n_near == 2
    assert got[long + "z"].form == long and got[long].n == 2
    for none in (spelling.variants(words.where("false")), spelling.counted(spelling.runs(docs.where("false")).select(F.col("run").alias("word")))):
        assert none.count() == 0


def hexed(x):
    return hashlib.sha256(x.encode()).hexdigest()


def brute_leaf(values):
    return hexed("".join("-" if x is None else f"{len(str(x).encode())}:{x}" for x in values))


def brute_manifest(rows):
    """rows: (doc_id, source, lang, n_chars, text, claimed leaf or None)."""

    def climb(low):
        levels = [low]
        while len(levels[-1]) > 1:
            levels.append([hexed("".join(levels[-1][i : i + 8])) for i in range(0, len(levels[-1]), 8)])
        return levels

    def way(levels, k):
        out = []
        for level in levels[:-1]:
            low = k // 8 * 8
            out.append(("".join(level[low:k]), "".join(level[k + 1 : low + 8])))
            k //= 8
        return out

    by = defaultdict(list)
    for r in rows:
        by[r[2]].append((r[0] is not None, r[0] or 0, brute_leaf(r[:5]), r))
    groups = sorted(by, key=lambda x: (x is not None, (x or "").encode()))
    trees = {g: climb([x[2] for x in sorted(by[g], key=lambda x: x[:3])]) for g in groups}
    top, out = climb([trees[g][-1][0] for g in groups]), []
    for i, g in enumerate(groups):
        for k, (_, _, digest, r) in enumerate(sorted(by[g], key=lambda x: x[:3])):
            path = way(trees[g], k) + way(top, i)
            folded = r[5] or digest
            for before, behind in path:
                folded = hexed(before + folded + behind)
            out.append((r[0], digest, trees[g][-1][0], top[-1][0], hexed("".join(a + b for a, b in path)), folded, folded == top[-1][0]))
    return sorted(out, key=str)


FIELDS = "doc_id long, source string, lang string, n_chars long, text string, claimed string"


@pytest.mark.parametrize("case", ["edges", "many groups", "one large group", "one row"])
def test_manifest(spark, case):
    if case == "edges":  # nulls everywhere, repeated rows, ties, clashing names, empty and long texts
        rows = [(1, None, None, None, None, None), (None, "s", "de", 3, "", None), (None, "s", "de", 3, "", None), (2, "s", "dé", 3, "x" * 100_000, "0" * 64), (2, "s", "dé", 3, "y", None), (7, "s", "", 3, "ü", None), (3, "s", "-", 3, "z", None), (9, "s", "de", 0, "Q", None)]
    elif case == "many groups":  # more groups than a vertex has children
        rows = [(k, "s", f"g{k % 4500}", k, f"t{k}", "f" * 64 if k % 500 == 0 else None) for k in range(4700)]
    elif case == "one large group":  # more rows than a vertex has children, and another group around it
        rows = [(k, None, "en", 1, str(k), "f" * 64 if k % 1000 == 0 else None) for k in range(9001)] + [(5, "s", "a", 1, "u", None), (5, "s", "z", 1, "u", None)]
    else:
        rows = [(4, "s", "x", 1, "t", None)]
    docs = spark.createDataFrame(rows, FIELDS).repartition(5).withColumns({c: F.lit("q") for c in ("leaf", "tree", "rid")})
    got = merkle.manifest(docs, F.coalesce("claimed", merkle.leaf()))
    assert sorted((tuple(r) for r in got.collect()), key=str) == brute_manifest(rows)


def test_manifest_empty(spark):
    none = spark.createDataFrame([], FIELDS)
    assert merkle.manifest(none).count() == 0 and merkle.manifest(none).columns == "doc_id leaf subroot root proof_sha256 folded_root verified".split()


def test_toxicity_held_out(spark):
    got = queries.op13_toxicity(spark, "/root/testdata/sf0.1").toPandas()
    docs, labels = pd.read_parquet("/root/testdata/sf0.1/documents.parquet"), pd.read_parquet("/root/testdata/sf0.1/labels.parquet")
    assert sorted(got.doc_id) == sorted(docs.doc_id) and got.score.between(0, 1).all() and ((got.score >= 0.5).astype(int) == got.predicted).all()
    assert all((zlib.crc32(str(i).encode()) % 5 == 0) == h for i, h in zip(got.doc_id, got.held_out, strict=True))
    both = got.merge(labels, on="doc_id")
    both = both[both.held_out]
    assert both[both.toxic == 1].predicted.mean() > 0.9 and both[both.toxic == 0].predicted.mean() < 0.01


def test_toxicity_scores_by_brute_force(spark):
    """The scores of the query against features looked up text by text, long texts too."""
    docs, labels = spark.read.parquet(f"{SF}/documents.parquet"), spark.read.parquet(f"{SF}/labels.parquet")
    models = toxicity.train(docs, labels)
    got = {r.doc_id: r.score for r in queries.op13_toxicity(spark, SF).collect()}
    texts = sorted(docs.collect(), key=lambda r: len(r.text or ""))
    for r in texts[:20] + texts[-20:]:
        words = re.findall(r"[^\W\d_]+", (r.text or "").lower())
        have = defaultdict(int)
        for w in words:
            for x in {w, *("^" + w[:n] for n in range(3, 8) if n < len(w))}:
                have[zlib.crc32(x.encode())] += 1
        want = 0.0
        for hashes, weights in models:
            known = dict(zip(hashes.tolist(), weights, strict=False))
            m = weights[-1] + sum(known.get(h, 0) + (known.get(h ^ toxicity._OFTEN, 0) if n * 100 >= len(words) else 0) for h, n in have.items())
            want += 1 / (1 + np.exp(-np.clip(m, -30, 30))) / len(models)
        assert got[r.doc_id] == pytest.approx(want, abs=1e-9)


def test_toxicity_correction():
    """The negative part falls below zero where unlabelled texts are told from positives by heart, and the fit stays off it."""
    positive, negative = toxicity.risk(np.full(10, 9.0), np.full(10, -9.0), 0.3)
    assert positive < 0.001 and negative < 0
    rng = np.random.default_rng(3)
    some = [np.unique(np.append(rng.integers(100, 2000, 30), 7)).astype("u4") for _ in range(60)]
    others = [np.unique(np.append(rng.integers(100, 2000, 30), [7] if k % 10 == 0 else [])).astype("u4") for k in range(300)]
    words, weights = toxicity.fit(some, others, 0.1)
    assert 7 in words.tolist() and weights[words.tolist().index(7)] + weights[-1] > 0 > weights[-1]


def told(k):
    """Words that no other text has."""
    return " ".join(f"{c}{chr(97 + k % 26)}{chr(97 + k // 26 % 26)}{c}" for c in "abcdef")


def test_toxicity_edges(spark):
    long = "good words and more of them " * 3000
    texts = [(k, f"you utter villain {told(k)}" if k % 5 == 0 else f"a fine day {told(k)}") for k in range(400)]
    docs = spark.createDataFrame([*texts, (1500, None), (1501, ""), (None, "villain"), (1502, long), (0, texts[0][1])], "doc_id long, text string").withColumns({c: F.lit("q") for c in ("lang", "score", "toxic", "turn", "positive", "words")})
    labels = spark.createDataFrame([(k, 1 if k % 5 == 0 else 0) for k in range(400)] + [(5, 0), (None, 1), (900, 1), (7, None)], "doc_id long, toxic int")
    got = toxicity.report(docs, labels).collect()
    assert len(got) == 405 and {r.held_out for r in got if r.doc_id is None} == {False}
    by = {r.doc_id: r for r in got}
    assert by[5].predicted == 1 and by[1].predicted == 0 and by[1500].score == by[1501].score and by[1502].predicted == 0
    none = toxicity.report(docs, labels.where("toxic = 0 and doc_id <> 5")).collect()
    assert {r.score for r in none} == {0.0} and {r.score for r in toxicity.report(docs, labels.where("false")).collect()} == {0.0}
    assert toxicity.report(docs.where("false"), labels).count() == 0


def test_toxicity_learns_from_documents_that_exist(spark):
    """Labels of ids that the documents lack neither fill the sample nor move the prior."""
    docs = spark.createDataFrame([(k, f"you utter villain {told(k)}" if k % 5 == 0 else f"fine day {told(k)}") for k in range(400)], "doc_id long, text string")
    labels = spark.createDataFrame([(k, int(k % 5 == 0)) for k in range(400)], "doc_id long, toxic int")
    more = labels.unionByName(spark.range(1000, 30000).select(F.col("id").alias("doc_id"), F.lit(1).alias("toxic")))
    one, two = toxicity.train(docs, labels), toxicity.train(docs, more)
    assert all(np.array_equal(a[0], b[0]) and np.allclose(a[1], b[1]) for a, b in zip(one, two, strict=True))
