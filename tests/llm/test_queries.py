"""Each query over its whole table, against SQL where it has one and against brute force where it hasn't."""

import hashlib
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pandas as pd
import pytest
from compare import same
from conftest import SF, SMALL

from quire.llm import mixing, packing, quality, queries, secrets, sql, token_count

BLANK = re.compile(r"[\x20\x09-\x0D]+")


def docs(sf=SF):
    return pd.read_parquet(f"{sf}/documents.parquet")


@pytest.mark.parametrize("name", list(sql.oracle_sql()))
@pytest.mark.parametrize("sf", [SMALL, SF])
def test_against_sql(spark, name, sf):
    same(queries.queries()[name](spark, sf), sql.oracle_sql()[name], sf)


def test_mix(spark):
    d = docs()
    got = queries.op2_source_mix(spark, SF).toPandas().set_index("doc_id")
    size = {i: len(re.findall(r"[^\x20\x09-\x0D]+", t or "")) for i, t in zip(d.doc_id, d.text)}
    assert got["size"].to_dict() == size and len(got) == len(d)
    per = Counter()
    for i, s in zip(d.doc_id, d.source):
        per[s] += size[i]
    names = sorted(per, key=lambda s: (s is None, s))
    weight = {s: k % 3 + 1 for k, s in enumerate(names)}
    target, free, left = {}, set(names), float(sum(per.values()))
    while True:
        level = left / sum(weight[s] for s in free)
        over = {s for s in free if level * weight[s] > 3 * per[s]}
        if not over:
            break
        for s in over:
            target[s] = 3.0 * per[s]
            left -= target[s]
        free -= over
    target |= {s: level * weight[s] for s in free}
    taken = defaultdict(int)
    for i, s in zip(d.doc_id, d.source):
        row = got.loc[i]
        assert row.source_size == per[s] and row.target == pytest.approx(target[s])
        assert 0 <= row.taken <= 3 * row["size"]
        taken[s] += row.taken
    for s in names:
        assert abs(taken[s] - target[s]) <= 0.02 * target[s] + 64, s
    again = queries.op2_source_mix(spark, SF).toPandas().set_index("doc_id")
    assert again.taken.sort_index().equals(got.taken.sort_index())


def test_token_counts(spark):
    from tokenizers import Tokenizer

    d = docs()
    t = Tokenizer.from_file(queries.vocabulary("word_bpe_49k.json"))
    got = queries.op4_token_count(spark, SF).toPandas().set_index("doc_id")
    for i, text in zip(d.doc_id, d.text):
        n = len(t.encode(text or "").ids)
        assert tuple(got.loc[i]) == (len((text or "").encode()), n, n > 2048)


def test_token_counts_of_odd_texts():
    from tokenizers import Tokenizer

    path = queries.vocabulary("word_bpe_49k.json")
    t, c = Tokenizer.from_file(path), token_count.Counter(path)
    assert c.count("<|x|> <| a <|endoftext|") == len(t.encode("<|x|> <| a <|endoftext|").ids)
    for text in ["", " ", "Ünïcode ΑΣ ΟΔΟΣ İstanbul", "a<|endoftext|>b <|startoftext|>", "<|ENDOFTEXT|>", "x" * 3000, "don't we'll", "e\u0301\u0301 \x1c\x85\u200b中文🙂👍", "a\u3000b\u00a0c"]:
        assert c.count(text) == len(t.encode(text).ids), text


def test_quality_held_out(spark):
    got = queries.op6_quality_classifier(spark, SF).toPandas().set_index("doc_id")
    labels = pd.read_parquet(f"{SF}/labels.parquet").set_index("doc_id")
    assert len(got) == len(docs()) and got.score.between(0, 1).all()
    assert all((zlib.crc32(str(i).encode()) % 5 == 0) == h for i, h in got.held_out.items())
    assert ((got.score >= 0.3).astype(int) == got.predicted).all()
    both = got.join(labels, how="inner")
    both = both[both.held_out]
    good, bad = both[both.quality == 1], both[both.quality == 0]
    assert good.predicted.mean() > 0.97 and (len(bad) == 0 or 1 - bad.predicted.mean() > 0.6)
    again = queries.op6_quality_classifier(spark, SF).toPandas().set_index("doc_id")
    assert np.allclose(again.score.sort_index(), got.score.sort_index())


def test_quality_scores_by_explicit_pairs(spark):
    """The query's scores over its table against a sum over all pairs of a text's features."""
    rows = spark.read.parquet(f"{SF}/documents.parquet").where("doc_id % 40 = 0 or n_chars < 60")
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    m, features = quality.train(spark.read.parquet(f"{SF}/documents.parquet"), labels), quality.Features()
    got = {r.doc_id: r.score for r in queries.op6_quality_classifier(spark, SF).collect()}
    some = sorted(rows.collect(), key=lambda r: len(r.text or ""))
    for r in some[:30] + some[-3:]:  # long texts too
        ids, x = features.of(r.text or "", float(r.n_chars or 0))
        brute = float(m.w0) + sum(float(m.w[i]) * float(v) for i, v in zip(ids, x, strict=True))
        v = m.v[ids].astype("f8") * x[:, None]
        brute += sum(float((v[a] * v[:a]).sum()) for a in range(1, len(ids)))  # every pair of features
        assert got[r.doc_id] == pytest.approx(1 / (1 + np.exp(-brute)), abs=2e-4)


def test_quality_learns_from_one_row_an_id(spark):
    """Rows that share a labelled id don't add to what is learned, so the fitted rows stay within their bound."""
    docs_ = spark.createDataFrame([(1, "good text here", 14)] * 500 + [(2, "bad", 3), (4, "fine words", 10)], "doc_id long, text string, n_chars long")
    labels = spark.createDataFrame([(1, 1), (2, 0), (4, 1)], "doc_id long, quality int")
    one, many = quality.train(docs_.dropDuplicates(), labels), quality.train(docs_, labels)
    assert one.w0 == many.w0 and np.array_equal(one.w, many.w)


def test_factorisation_identity():
    rng = np.random.default_rng(0)
    m = quality.Machine(20, 3)
    m.w0, m.w, m.v = 0.3, rng.standard_normal(20).astype("f4"), rng.standard_normal((20, 3)).astype("f4")
    ids, x = np.array([1, 4, 7, 9]), rng.standard_normal(4).astype("f4")
    brute = 0.3 + (m.w[ids] * x).sum() + sum(m.v[ids[a]] @ m.v[ids[b]] * x[a] * x[b] for a in range(4) for b in range(a))
    assert m.scores([(ids, x)])[0] == pytest.approx(1 / (1 + np.exp(-brute)), rel=1e-4)


def plain_spans(text):
    kinds = [("assign", r"""(?ai:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 8), ("access", r"AKIA[A-Z0-9]+", 0, 16), ("hex", r"[0-9a-f]+", 0, 32)]
    kinds[0] = ("assign", r"""((?:[pP][aA][sS][sS][wW][oO][rR][dD]|[pP][aA][sS][sS][wW][dD]|[sS][eE][cC][rR][eE][tT]|[tT][oO][kK][eE][nN]|[aA][pP][iI]_?[kK][eE][yY]))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 8)
    found = [(m.start(), k, m.end()) for k, (_, p, g, n) in enumerate(kinds) for m in re.finditer(p, text) if len(m[g]) >= n]
    return [(kinds[k][0], s, e) for s, k, e in sorted(found)]


def test_secrets(spark):
    d = docs()
    got = queries.op7_secret_scan(spark, SF).toPandas().set_index("doc_id")
    assert len(got) == len(d) and got.n_assign.sum() > 0
    for i, text in zip(d.doc_id, d.text):
        want = plain_spans(text or "")
        row = got.loc[i]
        joined = ",".join(f"{k}:{s}:{e}" for k, s, e in want)
        n = Counter(k for k, _, _ in want)
        assert (row.n_assign, row.n_access, row.n_hex, row.spans) == (n["assign"], n["access"], n["hex"], joined)
        assert row.base_sha256 == hashlib.sha256(joined.encode()).hexdigest()


def test_secret_query_stores_its_ledger(spark, monkeypatch):
    made = []
    monkeypatch.setattr(secrets, "Ledger", type("Seen", (secrets.Ledger,), {"__init__": lambda self, *a: made.append(self) or super(type(self), self).__init__(*a)}))
    n = queries.op7_secret_scan(spark, SF).count()
    d = docs()
    assert n == len(d) and made[0].findings().count() == d.text.fillna("").nunique() and made[0].table("paths").count() == len(d)


def test_ledger(spark, tmp_path):
    """Only pairs of blob and rule version that the ledger lacks are scanned; findings of replaced versions stay in the history."""
    a = spark.createDataFrame([(1, "token = abcdefgh1"), (2, "none"), (3, "token = abcdefgh1"), (3, "token = abcdefgh1"), (4, None)], "doc_id long, text string")
    ledger = secrets.Ledger(spark, str(tmp_path / "ledger"))
    todo = lambda docs, *v: sorted({r.text for r in secrets.unseen(docs, ledger, *v)[1].collect()})
    assert todo(a) == ["", "none", "token = abcdefgh1"]
    first = secrets.scan(a, ledger).toPandas()
    assert sorted(zip(first.doc_id, first.n_assign)) == [(1, 1), (2, 0), (3, 1), (3, 1), (4, 0)]
    assert ledger.findings().count() == 3 and todo(a) == []
    b = spark.createDataFrame([(1, "none"), (9, "none"), (10, "secret: zzzzzzzzz")], "doc_id long, text string")
    assert todo(b) == ["secret: zzzzzzzzz"]
    second = secrets.scan(b, ledger).toPandas()
    assert sorted(zip(second.doc_id, second.n_assign)) == [(1, 0), (9, 0), (10, 1)] and ledger.findings().count() == 4
    assert sorted((r.doc_id, r.n_assign) for r in ledger.history().collect()) == [(1, 0), (1, 1), (2, 0), (3, 1), (4, 0), (9, 0), (10, 1)]
    assert todo(b, "next") == ["none", "secret: zzzzzzzzz"]
    secrets.scan(b, ledger, "next").count()
    assert ledger.findings("next").count() == 2 and ledger.table("findings").count() == 6 and todo(b, "next") == []


def test_rank_file_gives_the_same_ids():
    """Over every plain character in several settings, over random mixtures and over real texts; unusual texts go to the library."""
    import random

    from tokenizers import Tokenizer

    path = queries.vocabulary("byte_bpe_50k.json")
    e, t = packing.Encoder(path, queries.vocabulary("byte_bpe_50k.tiktoken")), Tokenizer.from_file(path)
    rng = random.Random(1)
    chars = [c for c in map(chr, range(0x2100)) if not packing._UNUSUAL.search(c)]
    texts = [a + c + b for c in chars for a in ("", "a", " ", "1", "\n", "'", "x\n") for b in ("", "a", " ", "s", "!", "9", " 's")]
    texts += ["".join(rng.choice(chars) for _ in range(40)) for _ in range(3000)] + ["".join(rng.choice(" \n\xa0\tab's.") for _ in range(30)) for _ in range(5000)]
    texts += [t for t in docs().text if t] + ["", "a<|endoftext|>b", "\u4e2d\u6587 \U0001f642 \u0301 \x1c\x85", "x" * 20_000, " " * 5000, "\n" * 3000, "a b " * 9000]
    assert [np.frombuffer(x, "<u4").tolist() for x in e.encode_many(texts)] == [x.ids for x in t.encode_batch(texts, add_special_tokens=False)]


def test_step_groups_are_balanced(spark):
    """Every step group holds the same number of tokens, but for one of a task at most, whatever its tier."""
    rng = np.random.default_rng(3)
    texts = [(i, "word " * int(n)) for i, n in enumerate(rng.integers(0, 2500, 900))]
    got = packing.pack(spark.createDataFrame(texts, "doc_id long, text string").repartition(2), queries.vocabulary("byte_bpe_50k.json")).toPandas()
    sizes = got.groupby("step_group").length.sum()
    assert (sizes == packing.STEP_WINDOWS * 1024).sum() >= len(sizes) - 2 and sizes.max() == packing.STEP_WINDOWS * 1024
    assert got.groupby("sequence_id").step_group.nunique().max() == 1


def check_packing(rows, texts):
    """rows: pieces; texts: (doc_id, text), each doc_id once."""
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(queries.vocabulary("byte_bpe_50k.json"))
    by_doc, by_seq = defaultdict(list), defaultdict(list)
    for r in rows.itertuples():
        by_doc[r.doc_id].append(r)
        by_seq[r.sequence_id].append(r)
    total = 0
    for doc, text in texts:
        ids = [*t.encode(text or "", add_special_tokens=False).ids, 0]
        total += len(ids)
        at = 0
        for r in sorted(by_doc.pop(doc), key=lambda r: r.start):
            assert r.start == at and r.length > 0 and r.doc_tokens == len(ids)
            assert r.ids_crc32 == zlib.crc32(np.array(ids[at : at + r.length], "<u4").tobytes())
            at += r.length
        assert at == len(ids)
    assert not by_doc
    padded, groups = 0, defaultdict(int)
    for pieces in by_seq.values():
        at = 0
        for r in sorted(pieces, key=lambda r: r.offset):
            assert r.offset == at
            at += r.length
        assert 0 < at <= 1024
        padded += 0 if at & (at - 1) == 0 else 1024 - at
        groups[pieces[0].step_group] += at
    assert padded == 0 and max(groups.values()) <= packing.STEP_WINDOWS * 1024
    return total


def test_packing(spark):
    d = docs()
    check_packing(queries.op9_packing(spark, SF).toPandas(), list(zip(d.doc_id, d.text)))


def test_rates_meet_two_sets_of_targets(spark):
    """Raking two level columns at once: against iterative proportional fitting."""
    cells = pd.DataFrame({"a": ["x", "x", "y", "y"], "b": ["p", "q", "p", "q"], "size": [10.0, 20.0, 30.0, 40.0]})
    ta, tb = {"x": 45.0, "y": 55.0}, {"p": 50.0, "q": 50.0}
    w = cells["size"].copy()
    for _ in range(200):
        w = w * cells.a.map(ta) / w.groupby(cells.a).transform("sum")
        w = w * cells.b.map(tb) / w.groupby(cells.b).transform("sum")
    frame = lambda c, t: spark.createDataFrame(list(t.items()), f"{c} string, target double")
    got = mixing.balance(spark.createDataFrame(cells), {"a": frame("a", ta), "b": frame("b", tb)}).toPandas().sort_values(["a", "b"])
    assert np.allclose(got.rate * got["size"], w, rtol=1e-6)
