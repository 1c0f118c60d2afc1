import hashlib
import tracemalloc

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from quire.errors import QuireError
from quire.functions import text as T
from quire.plans.query import parse, to_expression

ALEF, LAM, MEEM, BEH, FATHA, SHADDA, TATWEEL = "ا", "ل", "م", "ب", "َ", "ّ", "ـ"
SAMPLES = [
    None, "", "  ", "a b　c\x85d", "é آ", f"{ALEF}{LAM}{FATHA}{MEEM}{SHADDA}{TATWEEL}", "آأإٱ ىی ؤ ة گک پ چ ئ", "٠١۸۹",
    "​x‏y‪z⁠﻿", "tab\tnew\n\r\nline", "ؐ اؐب", "UPPER lower ÀÉ", "ابن ابناء",
]


def test_fold_parity(spark):
    df = spark.createDataFrame([(i, t) for i, t in enumerate(SAMPLES)], "i int, t string")
    got = {r.i: (r.f, r.w) for r in df.select("i", T.fold(F.coalesce("t", F.lit(""))).alias("f")).withColumn("w", T.tokens(F.col("f"))).collect()}
    for i, t in enumerate(SAMPLES):
        assert got[i] == (T.fold_py(t), T.tokens_py(T.fold_py(t))), t
        assert T.fold_py(T.fold_py(t)) == T.fold_py(t)


def test_fold_table():
    assert T.fold_py(SAMPLES[5]) == ALEF + LAM + MEEM
    assert T.fold_py("آأإٱ") == ALEF * 4 and T.fold_py("ئ") == "ئ" and T.fold_py("٠۹") == "09"
    assert T.tokens_py(T.fold_py("إبن ابنا")) == ["بن", "ابنا"]
    assert T.fold_py("A  b") == "A b"


def test_marks_outside_the_ranges_split_tokens():
    assert T.tokens_py("اؐب") == ["ا", "ب"]


def test_fold_map(spark):
    for t in SAMPLES:
        folded, at = T.fold_map_py(t)
        assert folded == T.fold_py(t) and len(folded) == len(at) and at == sorted(at)
    assert T.fold_map_py(f" {ALEF}{FATHA}  {BEH} ")[1] == [1, 5, 5]
    row = spark.createDataFrame([("a  b",)], "t string").select(T.fold_map(F.col("t")).alias("m")).first()
    assert row.m.folded == "a b" and list(row.m.source_at) == T.fold_map_py("a  b")[1]


def test_fold_map_of_many_long_texts(spark):
    words = [f"{ALEF}{FATHA} b{i} " * 20_000 for i in range(40)]
    texts = pa.array([None, *words, ""])
    tracemalloc.start()
    try:
        sizes, rows = [], 0
        for piece in T.fold_maps(iter([texts])):
            sizes.append(piece.nbytes)
            rows += len(piece)
        peak = tracemalloc.get_traced_memory()[1]
    finally:
        tracemalloc.stop()
    assert rows == len(texts) and len(sizes) > 1 and max(sizes) < 16 << 20 and peak < 64 << 20
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts.to_pylist())], "i int, t string").coalesce(1)
    got = df.select("i", T.fold_map(F.col("t")).alias("m")).select("i", F.md5("m.folded").alias("f"), F.md5(F.array_join(F.col("m.source_at").cast("array<string>"), ",")).alias("a")).collect()
    md5 = lambda s: hashlib.md5(s.encode()).hexdigest()
    assert len(got) == len(texts)
    for r in got:
        folded, at = T.fold_map_py(texts[r.i].as_py())
        assert (r.f, r.a) == (md5(folded), md5(",".join(map(str, at)))) and folded == T.fold_py(texts[r.i].as_py())


HTML = {
    "<p>a</p><p>b</p>": "a\n\nb", "x<br/>y<!-- z\n -->": "x\ny", "<script>no()</script>yes<STYLE a=b>p{}</style>": "yes", "a<b>c</b>d": "acd", "&lt;&amp;lt;&gt; &copy; &#65;&#x42; &#38;amp; &#xD800; &#0; &#1114112;": "<&lt;> &copy; AB &amp; &#xD800; &#0; &#1114112;",
    " a \t b \r\n c\n\n\n\nd ": "a b\nc\n\nd", "&AMP;&Quot;&nbsp;x": '&" x', "": "", "a & b &; &#; &zz;": "a & b &; &#; &zz;", "<h2 class=x>T</h2>t": "T\nt", "&#x1F642;": "\U0001f642",
}


def test_html(spark):
    df = spark.createDataFrame([(h,) for h in HTML], "h string")
    for r in df.select("h", T.html_to_text(F.col("h")).alias("t")).collect():
        assert r.t == HTML[r.h], r.h


def test_excerpt(spark):
    words = " ".join(f"word{i}" for i in range(100))
    df = spark.createDataFrame([(words, 300), (words, 0), ("short", 2), (words, len(words) - 1)], "t string, at int")
    a, b, c, d = (r[0] for r in df.select(T.excerpt(F.col("t"), F.col("at"), 20)).collect())
    assert a.startswith("… word") and a.endswith(" …") and all(w in words.split() for w in a.strip("… ").split())
    assert b.startswith("word0 ") and b.endswith(" …") and c == "short" and d.startswith("… ") and d.endswith("word99")


def test_excerpt_after_line_breaks(spark):
    """A window that begins right after a line break begins there, and none is wider for what stands before."""
    for gap in ("\n", "\r\n", "\r", "\u2028", "\u2029", "\n\n", " ", "\x0b", "\n\x85"):
        t = "before" * 9 + gap + "word " * 20 + "after" + gap
        at = len(t) - len("word " * 20 + "after" + gap)
        cut = {at + 20: 20, at + 22: 20, len(t) - 1: 20}
        df = spark.createDataFrame([(t, a) for a in cut], "t string, a int")
        for r in df.select("a", T.excerpt(F.col("t"), F.col("a"), 20).alias("e")).collect():
            left, right = max(0, r.a - 20), min(len(t), r.a + 20)
            while left > 0 and not T._PY_SPACE.fullmatch(t[left - 1]):
                left -= 1
            while right < len(t) and not T._PY_SPACE.fullmatch(t[right]):
                right += 1
            spaces = "".join(c for c in set(t) if T._PY_SPACE.fullmatch(c))
            assert r.e == ("… " if left else "") + t[left:right].strip(spaces) + (" …" if right < len(t) else ""), (gap, r.a)


def test_excerpt_in_long_words(spark):
    t = "y" * 300_000 + "\nof " + "z" * 300_000
    row = spark.createDataFrame([(t,)], "t string").select(T.excerpt(F.col("t"), F.lit(300_001), 20).alias("all"), T.excerpt(F.col("t"), F.lit(300_021), 20).alias("end")).first()
    assert row.all == t and row.end == "… of " + "z" * 300_000


def test_excerpt_window_looks_after_line_breaks(spark, tmp_path):
    import duckdb

    from quire import queries as Q

    text = ["x" * 50 + "\n" + "word " * 35 + "lead of " + "word " * 90, "x" * 500 + "\r\nof " + "z" * 500, "short\n", "\n" * 500 + "the\n" * 200, None]
    df = spark.createDataFrame([(i, t, "en", "src1", len(t or "")) for i, t in enumerate(text)], "doc_id long, text string, lang string, source string, n_chars long")
    df.toPandas().to_parquet(tmp_path / "documents.parquet", index=False)
    sql = Q.oracle_sql()["excerpt_window"]
    want = dict(duckdb.connect().execute(sql.replace("from documents", f"from '{tmp_path}/documents.parquet'")).fetchall())
    got = {r.doc_id: r.excerpt for r in Q.queries()["excerpt_window"](spark, str(tmp_path)).collect()}
    assert got == want


def test_parse():
    q = parse("  The (quick) fox! ", "phrase")
    assert q.terms == ("The", "quick", "fox") and to_expression(q) == '"The" + "quick" + "fox"' and len(q.hash) == 16
    assert parse("a b", "any_terms").hash != parse("a b", "all_terms").hash
    assert parse("الصَّلَاة").hash == parse("الصلاه").hash
    for bad in ("", "!?", " َ "):
        with pytest.raises(QuireError, match="INVALID_QUERY"):
            parse(bad)
