"""Queries of the passage engine over the driver's tables, each with the SQL it is held against (quire.oracle)."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quire import oracle as O
from quire import schema
from quire.functions import text as T
from quire.operators import catalogue as C
from quire.operators import passages as P
from quire.operators import profile as R
from quire.operators import search as S
from quire.operators import toc as H
from quire.plans import cursor as K
from quire.plans import index as I
from quire.plans.query import parse
from quire.plans.runs import Runs
from quire.sources import corpus

RUNS = Runs()
QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}

ALL, ANY, PHRASE, TWICE = "of the and", "zu the est", "of the", "the the"
RULES = [*C.RULES, *corpus.EXTRA_RULES]
#: A second rule list: two rules of one strength contradict each other.
CLASHING = [*C.RULES, {"id": "other", "school": "hanbali", "match_type": "equals", "patterns": ["الفقه الحنفي"], "reviewed": True}, {"id": "any", "school": "comparative", "match_type": "contains", "patterns": ["الفقه"], "reviewed": False}]
OVERRIDES = {"overrides": [{"book_id": "src1-en", "school": "comparative"}, {"book_id": "src1-en", "school": "shafii"}, {"book_id": "src7-de", "school": "hanbali"}], "exclude": ["src2-fr"], "include": ["src9-en"]}
REQUESTS = [("src0-en", 3), ("src0-en", 4), ("src0-en", 1), ("src3-en", 100000), ("src18-en", 2), ("nowhere", 1)]
BUDGET = 20_000


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql is not None:
            SQL[f.__name__] = sql
        return f

    return add


def _docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return corpus.texts(spark, sf_dir)


def _folded(spark: SparkSession, sf_dir: str):
    """The folded text of documents; with NFC only where some text could change by it."""
    return T.fold(F.col("text"), corpus.needs_nfc(spark, sf_dir))


def _html(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/pages.parquet").where("html is not null")


def _index(spark: SparkSession, sf_dir: str) -> I.Index:
    return corpus.index(spark, sf_dir)


def _books(spark: SparkSession, sf_dir: str, rules=None, overrides=None) -> DataFrame:
    return C.classify(corpus.books(spark, sf_dir), C.Config.of(rules or RULES, overrides))


def _hits(spark: SparkSession, sf_dir: str, raw: str, mode: str, scope=None) -> DataFrame:
    return S.hits(_index(spark, sf_dir), parse(raw, mode), scope)


def _joined(c: str = "ambiguity_reasons"):
    return F.array_join(F.array_sort(c), ",")


# text

DOCS = "(select doc_id, text from documents where text is not null)"


@query(f"select doc_id, {O.fold('text')} as folded from {DOCS}")
def fold_documents(spark, sf_dir):
    d = _docs(spark, sf_dir)
    return d.select("doc_id", _folded(spark, sf_dir).alias("folded"))


_ARABISED = f"replace(replace(translate(lower(text), '{O.LATIN}', '{O.ARABIC}'), 'ت', 'ت\u064e\u0640'), '1', '\u0661')"


@query(f"select doc_id, {O.fold(_ARABISED)} as folded, array_to_string({O.tokens(O.fold(_ARABISED))}, ' ') as tokens from {DOCS}")
def fold_arabised(spark, sf_dir):
    d = _docs(spark, sf_dir)
    folded = T.fold(F.expr(_ARABISED))
    return d.select("doc_id", folded.alias("folded"), F.array_join(T.tokens(folded), " ").alias("tokens"))


@query(f"select doc_id, cast(len(w) as bigint) n_tokens, cast(len(list_distinct(w)) as bigint) n_distinct from (select doc_id, {O.tokens(O.fold('text'))} w from {DOCS}) t")
def tokenize_counts(spark, sf_dir):
    d = _docs(spark, sf_dir)
    w = T.tokens(_folded(spark, sf_dir))
    return d.select("doc_id", F.size(w).cast("long").alias("n_tokens"), F.size(F.array_distinct(w)).cast("long").alias("n_distinct"))


def _plain_entities(x: str) -> str:
    for k, v in T.ENTITIES.items():
        if k != "amp":
            x = f"replace({x}, '&{k};', '{v.replace(chr(39), chr(39) * 2)}')"
    return f"replace({x}, '&amp;', '&')"


def _plain_html(x: str) -> str:
    for p in ("(?s)<!--.*?-->", r"(?is)<script\b[^>]*>.*?</script>", r"(?is)<style\b[^>]*>.*?</style>"):
        x = f"regexp_replace({x}, '{p}', '', 'g')"
    x = _plain_entities(f"regexp_replace(regexp_replace({x}, '(?i){T.BLOCK}', chr(10), 'g'), '<[^>]*>', '', 'g')")
    for p, to in (("\\r\\n?", "chr(10)"), ("[ \\t\xa0]+", "' '"), (" *\\n *", "chr(10)"), ("\\n{3,}", "chr(10) || chr(10)")):
        x = f"regexp_replace({x}, '{p}', {to}, 'g')"
    return f"regexp_replace({x}, '^[{T.SPACES}]+|[{T.SPACES}]+$', '', 'g')"


@query(f"select page_id, {_plain_html('html')} as text from pages where html is not null")
def html_to_text_pages(spark, sf_dir):
    return _html(spark, sf_dir).select("page_id", T.html_to_text(F.col("html")).alias("text"))


@query(f"select page_id, {_plain_entities('html')} as decoded from pages where html is not null")
def decode_entities_pages(spark, sf_dir):
    return _html(spark, sf_dir).select("page_id", T.decode_entities(F.col("html")).alias("decoded"))


_FOLDED = f"(select doc_id, text, {O.fold('text')} f from {DOCS})"
_AT = lambda terms: f"coalesce(list_min(list_filter([{', '.join(f"instr(f, '{t}') - 1" for t in terms)}], lambda x: x >= 0)), -1)"
_OFFSET = f"case when instr(f, '{PHRASE}') > 0 then instr(f, '{PHRASE}') - 1 else {_AT(PHRASE.split())} end"


@query(f"select doc_id, cast({_OFFSET} as int) phrase_at, cast({_AT(ANY.split())} as int) any_at from {_FOLDED} t")
def first_match_offset(spark, sf_dir):
    d = _docs(spark, sf_dir)
    f = _folded(spark, sf_dir)
    return d.select("doc_id", T.first_match_offset(f, PHRASE.split(), "phrase").alias("phrase_at"), T.first_match_offset(f, ANY.split(), "any_terms").alias("any_at"))


def _plain_list(terms: list[str], some: str) -> str:
    return f"array_to_string(list_filter({O.LIST(terms)}, lambda t: {some}contains(f, t)), ', ')"


@query(f"select doc_id, case when contains(f, '{PHRASE}') then 'phrase «{PHRASE}» occurs in order on the page' else 'the index matched the phrase; its order isn''t confirmed in the readable text' end reason from {_FOLDED} t")
def match_reason_phrase(spark, sf_dir):
    d = _docs(spark, sf_dir)
    return d.select("doc_id", T.match_reason(_folded(spark, sf_dir), PHRASE, PHRASE.split(), "phrase").alias("reason"))


@query(f"select doc_id, 'all terms on the page (' || len(list_filter({O.LIST(ALL.split())}, lambda t: contains(f, t))) || '/3): ' || {_plain_list(ALL.split(), '')} reason from {_FOLDED} t")
def match_reason_all(spark, sf_dir):
    d = _docs(spark, sf_dir)
    return d.select("doc_id", T.match_reason(_folded(spark, sf_dir), ALL, ALL.split(), "all_terms").alias("reason"))


@query(f"select doc_id, case when {_plain_list(ANY.split(), 'not ')} = '' then 'every term found: ' || {_plain_list(ANY.split(), '')} else 'found: ' || {_plain_list(ANY.split(), '')} || ' - missing: ' || {_plain_list(ANY.split(), 'not ')} end reason from {_FOLDED} t")
def match_reason_any(spark, sf_dir):
    d = _docs(spark, sf_dir)
    return d.select("doc_id", T.match_reason(_folded(spark, sf_dir), ANY, ANY.split(), "any_terms").alias("reason"))


@query(
    f"""with a as (select doc_id, text, greatest(0, {_AT(PHRASE.split())}) at_ from {_FOLDED} t),
b as (select *, length(text) n, greatest(0, at_ - 180) s, least(length(text), at_ + 180) e from a),
c as (select *, s - length(regexp_extract(substring(text, 1, s), '[^{T.SPACES}]*$')) l, e + length(regexp_extract(substring(text, e + 1), '^[^{T.SPACES}]*')) r from b)
select doc_id, case when n <= 360 then text else case when l > 0 then '… ' else '' end || regexp_replace(substring(text, l + 1, r - l), '^[{T.SPACES}]+|[{T.SPACES}]+$', '', 'g') || case when r < n then ' …' else '' end end excerpt from c"""
)
def excerpt_window(spark, sf_dir):
    d = _docs(spark, sf_dir)
    at = F.greatest(F.lit(0), T.first_match_offset(_folded(spark, sf_dir), PHRASE.split(), "any_terms"))
    d = d.select("doc_id", "text", at.alias("at"))  # folded once, not wherever the excerpt needs the offset
    return d.select("doc_id", T.excerpt(F.col("text"), F.col("at"), schema.EXCERPT_SEARCH).alias("excerpt"))


@query(
    f"""with d as (select doc_id, nfc_normalize(text) t, {O.fold('text')} f from {DOCS}),
c as (select doc_id, unnest(regexp_extract_all(t, '(?s).')) ch, unnest(range(length(t))) i from d),
k as (select doc_id, i, regexp_matches(ch, '[{T.SPACES}]') sp from c where not regexp_matches(ch, '[{T.ZERO_WIDTH}{T.MARKS}{T.TATWEEL}]')),
p as (select *, lag(sp) over (partition by doc_id order by i) gap, count(*) filter (where not sp) over (partition by doc_id order by i rows between unbounded preceding and 1 preceding) seen from k),
m as (select doc_id, string_agg(case when gap and seen > 0 then i || ',' || i else cast(i as varchar) end, ',' order by i) o from p where not sp group by doc_id)
select doc_id, f as folded, md5(coalesce(o, '')) as offsets from d left join m using (doc_id)"""
)
def fold_offset_map(spark, sf_dir):
    T.modest_batches(spark)
    m = _docs(spark, sf_dir).select("doc_id", T.fold_map(F.col("text")).alias("m"))
    return m.select("doc_id", "m.folded", F.md5(F.array_join(F.col("m.source_at").cast("array<string>"), ",")).alias("offsets"))


# index


@query(f"with {O.TOK}, u as (select doc, unnest(terms) term from tok) select term, count(distinct doc) df, count(*) cf from u group by term")
def term_stats(spark, sf_dir):
    return _index(spark, sf_dir).table("term_stats").select("term", "df", "cf")


@query(f"with {O.TOK} select count(*) n_docs, cast(sum(dl) as bigint) sum_dl from tok")
def corpus_stats(spark, sf_dir):
    return _index(spark, sf_dir).table("corpus_stats").drop("generation")


@query(f"with {O.TOK} select doc, book_id, page_id, cast(dl as int) dl from tok")
def doc_lengths(spark, sf_dir):
    return _index(spark, sf_dir).tokens.select("doc", "book_id", "page_id", "dl")


@query(f"with {O.TOK}, u as (select doc, unnest(terms) term, unnest(range(0, len(terms))) p from tok) select term, doc, cast(count(*) as int) tf, string_agg(p, ',' order by p) positions from u where term in ('the', 'der', 'de') group by term, doc")
def postings_lookup(spark, sf_dir):
    rows = _index(spark, sf_dir).table("postings").where(F.col("term").isin("the", "der", "de"))
    return rows.select("term", "doc", "tf", F.array_join(F.col("positions").cast("array<string>"), ",").alias("positions"))


@query(f"with {O.TOK}, u as (select term, count(distinct doc) df from (select doc, unnest(terms) term from tok) x group by term) select term, df from u order by df desc, term limit 50")
def postings_topdf(spark, sf_dir):
    return _index(spark, sf_dir).table("term_stats").select("term", "df").orderBy(F.desc("df"), "term").limit(50)


@query("select 'doc_id' as \"column\", count(*) as \"rows\", count(doc_id) present, max(octet_length(encode(cast(doc_id as varchar)))) longest, cast(sum(octet_length(encode(cast(doc_id as varchar)))) as bigint) bytes from documents"
       + "".join(f" union all select '{c}', count(*), count({c}), max(octet_length(encode(cast({c} as varchar)))), cast(coalesce(sum(octet_length(encode(cast({c} as varchar)))), 0) as bigint) from documents" for c in ("text", "lang", "source", "n_chars")))
def profile_columns(spark, sf_dir):
    return I.describe(spark.read.parquet(f"{sf_dir}/documents.parquet")).drop("type")


_SIZE = "octet_length(encode(text))"


@query(f"with d as (select {_SIZE} s from documents where text is not null), b as (select case when s < 1024 then 0 when s < 10240 then 1 when s < 102400 then 2 when s < 1048576 then 3 else 4 end bucket, s from d) select cast(r.k as int) bucket, count(s) n, cast(coalesce(sum(s), 0) as bigint) bytes from range(5) r(k) left join b on b.bucket = r.k group by r.k")
def size_buckets(spark, sf_dir):
    return R.size_buckets(_docs(spark, sf_dir), F.octet_length("text"))


@query(f"select doc_id, {_SIZE} as bytes from documents where text is not null order by bytes desc, doc_id limit 10")
def largest_texts(spark, sf_dir):
    return R.largest(_docs(spark, sf_dir), "doc_id", F.octet_length("text"))


@query("select source as \"value\", count(*) n from documents group by source order by n desc, source limit 6")
def common_values(spark, sf_dir):
    return R.common_values(spark.read.parquet(f"{sf_dir}/documents.parquet"), "source")


@query("select doc_id, sha256(concat_ws(chr(31), coalesce('=' || cast(doc_id as varchar), '-'), coalesce('=' || text, '-'), coalesce('=' || lang, '-'), coalesce('=' || source, '-'), coalesce('=' || cast(n_chars as varchar), '-'))) checksum from documents")
def row_checksums(spark, sf_dir):
    return R.row_checksums(spark.read.parquet(f"{sf_dir}/documents.parquet"), "doc_id")


# match and rank


@query(f"with {O.hits(ALL.split(), 'all_terms')} select doc, book_id, page_id from hits")
def search_all_terms(spark, sf_dir):
    return _hits(spark, sf_dir, ALL, "all_terms").drop("score")


@query(f"with {O.hits(ANY.split(), 'any_terms')} select doc, book_id, page_id from hits")
def search_any_terms(spark, sf_dir):
    return _hits(spark, sf_dir, ANY, "any_terms").drop("score")


_CB = O.classified(RULES, C.HINTS)


@query(f"with {O.hits(PHRASE.split(), 'phrase')}, {_CB}, best as (select *, row_number() over (order by score desc, doc) as rnk from hits) select cast(rnk as int) as rank, doc, best.book_id, page_id, round(score, 6) score, title, school from best join cb on cb.book_id = best.book_id where rnk <= 20")
def search_phrase(spark, sf_dir):
    best = S.page(_hits(spark, sf_dir, PHRASE, "phrase"), 20).withColumn("rank", F.expr("row_number() over (order by score desc, doc)"))
    return best.join(_books(spark, sf_dir), "book_id").select("rank", "doc", "book_id", "page_id", F.round("score", 6).alias("score"), "title", "school").orderBy("rank")


@query(f"with {O.TOK} select doc, {O.pf(TWICE.split())} pf from tok where {O.pf(TWICE.split())} > 0")
def search_phrase_repeated_term(spark, sf_dir):
    return S.matches(_index(spark, sf_dir), parse(TWICE, "phrase")).select("doc", F.col("pf").cast("long").alias("pf"))


@query(f"with {O.hits(['the', 'qqqzzzabsent'], 'all_terms')} select doc, book_id, page_id from hits")
def search_missing_term(spark, sf_dir):
    return _hits(spark, sf_dir, "the qqqzzzabsent", "all_terms").drop("score")


@query(f"with {O.hits(ANY.split(), 'any_terms', 'false')} select doc, book_id, page_id from hits")
def search_empty_scope(spark, sf_dir):
    return _hits(spark, sf_dir, ANY, "any_terms", []).drop("score")


_SCOPE = ["src1-en", "src1-de", "src2-fr", "src5-en"]


@query(f"with {O.hits(ANY.split(), 'any_terms', 'book_id in (' + ', '.join(repr(b) for b in _SCOPE) + ')')} select doc, book_id, page_id, round(score, 6) score from hits order by hits.score desc, doc limit 20")
def search_scoped_global_stats(spark, sf_dir):
    return S.page(_hits(spark, sf_dir, ANY, "any_terms", _SCOPE), 20).withColumn("score", F.round("score", 6))


@query(f"with {O.hits(ANY.split(), 'any_terms')} select doc, book_id, page_id, round(score, 6) score from hits order by hits.score desc, doc limit 20")
def bm25_top20(spark, sf_dir):
    return S.page(_hits(spark, sf_dir, ANY, "any_terms"), 20).withColumn("score", F.round("score", 6))


@query(f"with {O.hits(PHRASE.split(), 'phrase')} select doc, book_id, page_id, round(score, 6) score from hits order by hits.score desc, doc limit 20")
def bm25_phrase_top20(spark, sf_dir):
    return S.page(_hits(spark, sf_dir, PHRASE, "phrase"), 20).withColumn("score", F.round("score", 6))


@query(f"with {O.hits(ANY.split(), 'any_terms')} select doc, book_id, page_id, round(score, 6) score from hits order by hits.score desc, doc limit 30 offset 60")
def ranked_run_batch(spark, sf_dir):
    """The third batch of a walk, from ranges that are stored in order."""
    run = RUNS.of(spark, (sf_dir, _index(spark, sf_dir).generation, ANY), lambda: _hits(spark, sf_dir, ANY, "any_terms"))
    last = None
    for _ in range(2):
        end = run.page(30, last).orderBy("score", F.desc("doc")).first()
        last = (end["score"], end["doc"])
    return run.page(30, last).withColumn("score", F.round("score", 6))


def _best(spark, sf_dir, raw: str, mode: str):
    return S.best(_index(spark, sf_dir), parse(raw, mode), 20)[0].withColumn("score", F.round("score", 6))


@query(f"with {O.hits(ANY.split(), 'any_terms')} select doc, book_id, page_id, round(score, 6) score from hits order by hits.score desc, doc limit 20")
def bm25_top20_by_bounds(spark, sf_dir):
    """The best hits with only those blocks of postings read that can have them."""
    return _best(spark, sf_dir, ANY, "any_terms")


@query(f"with {O.hits(ALL.split(), 'all_terms')} select doc, book_id, page_id, round(score, 6) score from hits order by hits.score desc, doc limit 20")
def bm25_all_terms_by_bounds(spark, sf_dir):
    return _best(spark, sf_dir, ALL, "all_terms")


@query(f"with {O.hits(PHRASE.split(), 'phrase')} select doc, book_id, page_id, round(score, 6) score from hits order by hits.score desc, doc limit 20")
def bm25_phrase_by_bounds(spark, sf_dir):
    return _best(spark, sf_dir, PHRASE, "phrase")


@query(f"with {O.hits(['the', 'of', 'the'], 'all_terms')} select doc, book_id, page_id, round(score, 6) score from hits order by hits.score desc, doc limit 20")
def bm25_repeated_term(spark, sf_dir):
    return S.page(_hits(spark, sf_dir, "the of the", "all_terms"), 20).withColumn("score", F.round("score", 6))


@query(f"with {O.hits(ANY.split(), 'any_terms')} select doc, book_id, page_id, round(score, 6) score from hits order by hits.score desc, doc limit 20 offset 20")
def keyset_page2(spark, sf_dir):
    rows = _hits(spark, sf_dir, ANY, "any_terms")
    last = S.page(rows, 20).agg(F.min("score").alias("s"), F.max_by("doc", F.struct(-F.col("score"), "doc")).alias("d")).first()
    return S.page(rows, 20, (last["s"], last["d"])).withColumn("score", F.round("score", 6))


@query(f"with {O.hits(ANY.split(), 'any_terms')}, {_CB}, k as (select h.*, school, row_number() over (partition by school order by score desc, doc) as rnk from hits h join cb using (book_id)) select school, cast(rnk as int) as rank, doc, book_id, page_id, round(score, 6) score from k where rnk <= 8")
def top_n_per_school(spark, sf_dir):
    rows = _hits(spark, sf_dir, ANY, "any_terms").join(_books(spark, sf_dir).select("book_id", "school"), "book_id")
    return S.top_per(rows, "school", 8).select("school", "rank", "doc", "book_id", "page_id", F.round("score", 6).alias("score"))


@query(f"with {O.hits(ANY.split(), 'any_terms')}, k as (select *, row_number() over (partition by book_id order by score desc, doc) as rnk from hits) select book_id, count(*) as hits, string_agg(page_id, ',' order by page_id) filter (where rnk <= 10) page_ids, count(*) > 10 page_ids_truncated from k group by book_id")
def page_sample_per_book(spark, sf_dir):
    rows = P.page_samples(_hits(spark, sf_dir, ANY, "any_terms"), 10)
    return rows.select("book_id", "hits", F.array_join(F.col("page_ids").cast("array<string>"), ",").alias("page_ids"), "page_ids_truncated")


@query(f"with p as (select doc, octet_length(encode(body)) as bytes from {O.PAGES} q), c as (select *, sum(bytes) over (order by doc rows unbounded preceding) upto, row_number() over (order by doc) k from p) select doc, bytes from c where k = 1 or upto <= {BUDGET}")
def byte_budget_prefix(spark, sf_dir):
    rows = corpus.pages(spark, sf_dir).select("doc", "body")
    return S.within_budget(rows, ["doc"], BUDGET, F.octet_length("body")).select("doc", "bytes")


@query(f"with p as (select lang, source, doc_id, row_number() over (partition by lang, source order by doc_id) k from documents where source is not null and lang is not null) select lang, source, doc_id from p where k = 1")
def first_occurrence(spark, sf_dir):
    rows = spark.read.parquet(f"{sf_dir}/documents.parquet").select("lang", "source", "doc_id")
    return S.first_of(rows, ["lang", "source"], "doc_id")


@query(f"with a as (with {O.hits(ANY.split(), 'any_terms')} select 'any' query, doc, score from hits order by score desc, doc limit 5), b as (with {O.hits(ALL.split(), 'all_terms')} select 'all' query, doc, score from hits order by score desc, doc limit 5), c as (with {O.hits(PHRASE.split(), 'phrase')} select 'phrase' query, doc, score from hits order by score desc, doc limit 5), u as (select * from a union all select * from b union all select * from c) select query, cast(row_number() over (partition by query order by score desc, doc) as int) as rank, doc, round(score, 6) score from u")
def many_queries(spark, sf_dir):
    asked = {"any": parse(ANY, "any_terms"), "all": parse(ALL, "all_terms"), "phrase": parse(PHRASE, "phrase")}
    return S.many(_index(spark, sf_dir), asked, limit=5).select("query", "rank", "doc", F.round("score", 6).alias("score"))


_ASKED_BY = f"q as (select item_id as query, list_slice({O.tokens(O.fold('text'))}, 1, 3) w from benchmark)"
_OCCURS = "u as (select doc, cast(dl as double) dl, term, cast(count(*) as double) tf from (select doc, dl, unnest(terms) term from tok) x group by doc, dl, term), n as (select cast(count(*) as double) docs, cast(sum(dl) as double) total from tok), f as (select term, count(*) df from u group by term)"
_IDF = "ln(1 + (docs - df + 0.5) / (df + 0.5))"
_NORM = "(1.2 * (1 - 0.75 + 0.75 * dl / (total / docs)))"
_LAST = "r as (select *, row_number() over (partition by query order by score desc, doc) rnk from s) select query, cast(rnk as int) as rank, doc, round(score, 6) score from r where rnk <= 5"


def _items(spark: SparkSession, sf_dir: str, mode: str, terms: int) -> DataFrame:
    """A question for each benchmark item: how its text begins."""
    items = spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    return items.select(F.col("item_id").alias("query"), F.slice(T.tokens(T.fold(F.col("text"), True)), 1, terms).alias("terms"), F.lit(mode).alias("mode"))


@query(f"with {O.TOK}, {_OCCURS}, {_ASKED_BY}, e as (select query, unnest(w) term from q), s as (select query, doc, round(sum({_IDF} * tf / (tf + {_NORM})), 9) score from e join u using (term) join f using (term), n group by query, doc), {_LAST}")
def benchmark_any_terms(spark, sf_dir):
    """The best pages for a table of questions, in one plan."""
    return S.answers(_index(spark, sf_dir), _items(spark, sf_dir, "any_terms", 3), 5).select("query", "rank", "doc", F.round("score", 6).alias("score"))


@query(f"with {O.TOK}, {_OCCURS}, {_ASKED_BY}, e as (select query, w[1] a, w[2] b from q), m as (select query, doc, a, b, cast(len(list_filter(range(1, len(terms)), lambda i: terms[i] = a and terms[i + 1] = b)) as double) pf, cast(dl as double) dl from e, tok where list_contains(terms, a) and list_contains(terms, b)), s as (select query, doc, round(({_IDF.replace('df', 'fa.df')} + {_IDF.replace('df', 'fb.df')}) * pf / (pf + {_NORM}), 9) score from m join f fa on fa.term = a join f fb on fb.term = b, n where pf > 0), {_LAST}")
def benchmark_phrases(spark, sf_dir):
    return S.answers(_index(spark, sf_dir), _items(spark, sf_dir, "phrase", 2), 5).select("query", "rank", "doc", F.round("score", 6).alias("score"))


# catalogue


@query(f"select book_id, title, author, category_id, trim(category) category, downloaded, file_path from {O.BOOKS} b")
def catalogue_join(spark, sf_dir):
    b = corpus.books(spark, sf_dir)
    authors = b.select(F.col("book_id").alias("author_id"), "author")
    categories = b.select(F.coalesce("category_id", F.lit("none")).alias("category_id"), "category", F.col("book_id").alias("_b"))
    keyed = b.select("book_id", "title", F.col("book_id").alias("author_id"), "category_id", "downloaded", "file_path")
    named = categories.groupBy("category_id").agg(F.min("category").alias("category")).where("category_id <> 'none'")
    few = C.raw_books(keyed, authors, named)
    exact = b.select(F.col("book_id").alias("_b"), F.trim("category").alias("_c"))
    return few.join(exact, F.col("book_id") == F.col("_b")).withColumn("category", F.col("_c")).drop("_b", "_c")


_TOLD = f"book_id, school, classification_source, verification_status, {O.joined_reasons()} as reasons, matched_rule"


def _told(books: DataFrame) -> DataFrame:
    return books.select("book_id", "school", "classification_source", "verification_status", _joined().alias("reasons"), "matched_rule")


@query(f"with {_CB} select {_TOLD} from cb")
def classify_books(spark, sf_dir):
    return _told(_books(spark, sf_dir))


@query(f"with {O.classified(CLASHING, C.HINTS)} select {_TOLD} from cb")
def classify_conflicts(spark, sf_dir):
    return _told(_books(spark, sf_dir, CLASHING))


_FORCED = O.classified(RULES, C.HINTS, {"src1-en": "shafii", "src7-de": "hanbali"}, ["src2-fr"])


@query(f"with {_FORCED} select {_TOLD} from cb where downloaded and (school in ('hanafi', 'shafii') or book_id = 'src9-en')")
def override_exclude_include(spark, sf_dir):
    config = C.Config.of(RULES, OVERRIDES)
    books = C.classify(corpus.books(spark, sf_dir), config)
    return _told(C.select_books(books, ["hanafi", "shafii"], downloaded_only=True, include=config.include))


@query(f"with {_CB} select book_id, unnest(reasons) reason from cb")
def hint_reasons(spark, sf_dir):
    return _books(spark, sf_dir).select("book_id", F.explode("ambiguity_reasons").alias("reason"))


@query(f"with {_CB} select trim(category) category, count(*) book_count from cb where classification_source = 'unclassified' and trim(category) <> '' group by 1")
def unmapped_categories(spark, sf_dir):
    return C.unmapped_categories(_books(spark, sf_dir))


@query(f"with {O.classified(CLASHING, C.HINTS)} select r.rule, count(cb.book_id) books from (values {', '.join(f"('{r['id']}')" for r in CLASHING)}) r(rule) left join cb on cb.matched_rule = r.rule group by r.rule")
def rule_effectiveness(spark, sf_dir):
    return C.rule_effect(_books(spark, sf_dir, CLASHING), C.Config.of(CLASHING))


@query(f"with {_CB} select split_part(r, ':', 1) reason, count(*) books from (select unnest(reasons) r from cb) t group by 1")
def reason_histogram(spark, sf_dir):
    return C.reason_histogram(_books(spark, sf_dir))


@query(f"with {_CB} select school, count(*) filter (where verification_status = 'verified') verified, count(*) filter (where verification_status = 'needs_review') needs_review, count(*) filter (where verification_status = 'unverified') unverified from cb group by school")
def verification_pivot(spark, sf_dir):
    return C.verification_matrix(_books(spark, sf_dir))


@query(f"with {_CB} select category, count(*) books, array_to_string(list_sort(list(distinct school)), ',') schools, bool_or(matched_rule is not null) mapped from cb group by category")
def category_breakdown(spark, sf_dir):
    return C.category_breakdown(_books(spark, sf_dir))


@query(f"with {_CB} select book_id, title, school from cb where downloaded and verification_status = 'needs_review' and len(reasons) > 0 and contains({O.fold('title')}, 'Book') order by book_id limit 5 offset 2")
def list_books_page(spark, sf_dir):
    books = C.select_books(_books(spark, sf_dir), downloaded_only=True, title="Book")
    return C.listing(books, ["needs_review"], True).select("book_id", "title", "school").orderBy("book_id").offset(2).limit(5)


@query(f"with {_CB} select count(*) matched, count(*) filter (where downloaded) downloaded, count(*) filter (where verification_status = 'needs_review') needs_review from cb")
def list_totals(spark, sf_dir):
    return C.totals(_books(spark, sf_dir))


_FILES = "(select source || '-' || lang book_id from (select distinct source, lang from documents) d where source <> 'src17' union all values ('orphan-1'), ('orphan-2'))"


def _files(spark: SparkSession, sf_dir: str) -> DataFrame:
    own = corpus.books(spark, sf_dir).where("not startswith(book_id, 'src17-')").select("book_id")
    return own.unionByName(spark.sql("select * from values ('orphan-1'), ('orphan-2') as t(book_id)"))


@query(f"with b as (select book_id, downloaded from {O.BOOKS} x), f as {_FILES}, j as (select b.book_id b, f.book_id f, downloaded from b full join f using (book_id)) select count(b) catalogue, count(*) filter (where downloaded) downloaded, count(f) files_on_disk, count(*) filter (where b is not null and f is not null and not downloaded) structure_only, count(*) filter (where b is null) orphans from j")
def structure_only_counts(spark, sf_dir):
    return C.counts(corpus.books(spark, sf_dir), _files(spark, sf_dir))


@query(f"select book_id from {_FILES} f where book_id not in (select book_id from {O.BOOKS} b)")
def orphan_books(spark, sf_dir):
    return _files(spark, sf_dir).join(corpus.books(spark, sf_dir), "book_id", "left_anti")


@query(f"with {_CB} select s.school, ord, count(book_id) books, count(*) filter (where downloaded) downloaded from {O.SCHOOL_ROWS} left join cb on cb.school = s.school group by s.school, ord")
def health_per_school(spark, sf_dir):
    return C.by_school(_books(spark, sf_dir), books=F.count("*"), downloaded=F.count_if("downloaded"))


# discovery and coverage


@query(f"with {O.hits(ANY.split(), 'any_terms')} select book_id, count(*) hits from hits group by book_id")
def counts_by_book(spark, sf_dir):
    return P.counts_by_book(_hits(spark, sf_dir, ANY, "any_terms"))


@query(f"with {O.hits(ANY.split(), 'any_terms')}, {_CB}, per as (select book_id, school, count(*) n from hits join cb using (book_id) group by all) select school, count(*) books, cast(sum(n) as bigint) hits from per group by rollup (school)")
def totals_by_school_rollup(spark, sf_dir):
    return P.totals_by_school(_hits(spark, sf_dir, ANY, "any_terms"), _books(spark, sf_dir))


@query(f"with {O.hits(PHRASE.split(), 'phrase')}, {_CB}, k as (select *, row_number() over (partition by book_id order by score desc, doc) as rnk from hits), g as (select book_id, count(*) as hits, string_agg(page_id, ',' order by page_id) filter (where rnk <= 5) page_ids from k group by book_id) select g.*, title, school from g join cb using (book_id)")
def discover_books(spark, sf_dir):
    rows = P.discover(_hits(spark, sf_dir, PHRASE, "phrase"), _books(spark, sf_dir), 5)
    return rows.select("book_id", "hits", F.array_join(F.col("page_ids").cast("array<string>"), ",").alias("page_ids"), "title", "school")


@query(f"with {_CB} select s.school, ord, count(book_id) in_scope, count(*) filter (where downloaded) searched, count(*) filter (where not downloaded) not_downloaded from {O.SCHOOL_ROWS} left join cb on cb.school = s.school group by s.school, ord")
def coverage_by_school(spark, sf_dir):
    return C.coverage(_books(spark, sf_dir))


@query(f"with m as (select book_id from {O.BOOKS} b where not downloaded) select (select count(*) from m) missing, (select string_agg(book_id, ',' order by book_id) from (select book_id from m order by book_id limit 20) t) named")
def coverage_missing_sample(spark, sf_dir):
    return C.missing_books(corpus.books(spark, sf_dir)).select("missing", F.array_join(F.transform("named", lambda x: x["book_id"]), ",").alias("named"))


# context

_REQ = "(values " + ", ".join(f"('{b}', {p})" for b, p in REQUESTS) + ") r(book_id, page_id)"
_WIN = f"w as (select book_id, cast(near as int) page_id, bool_or(near = page_id) requested from (select book_id, page_id, unnest(range(greatest(0, page_id - 1), greatest(0, page_id + 1) + 1)) near from {_REQ}) x group by book_id, near)"


def _requests(spark: SparkSession) -> DataFrame:
    return spark.sql("select * from values " + ", ".join(f"('{b}', {p})" for b, p in REQUESTS) + " as r(book_id, page_id)")


@query(f"select book_id, cast(near as int) page_id, bool_or(near = page_id) requested from (select book_id, page_id, unnest(range(greatest(0, page_id - 2), page_id + 3)) near from {O.PAGES} p where page_id % 7 = 3) x group by book_id, near")
def neighbour_windows(spark, sf_dir):
    """Windows of two pages around every seventh page of each book."""
    asked = corpus.pages(spark, sf_dir).where("page_id % 7 = 3").select("book_id", "page_id")
    return P.windows(asked, 2)


_STATUS = f"{_WIN}, s as (select w.*, case when not coalesce(b.downloaded, false) then 'failed' when p.doc is not null then 'found' when requested then 'missing' else 'absent' end status, p.doc from w left join {O.PAGES} p using (book_id, page_id) left join {O.BOOKS} b using (book_id))"


@query(f"with {_STATUS} select book_id, page_id, requested, status from s")
def fetch_found_missing(spark, sf_dir):
    return P.fetch(_requests(spark), corpus.page_store(spark, sf_dir), corpus.books(spark, sf_dir), 1).select("book_id", "page_id", "requested", "status")


@query(f"with {_STATUS} select distinct book_id from s where status = 'failed'")
def failed_books(spark, sf_dir):
    return P.fetch(_requests(spark), corpus.page_store(spark, sf_dir), corpus.books(spark, sf_dir), 1).where("status = 'failed'").select("book_id").distinct()


@query(f"select r.book_id, r.page_id, p.doc is not null found, length(p.body) body_length from {_REQ} left join {O.PAGES} p using (book_id, page_id)")
def lookup_batched_misses(spark, sf_dir):
    return P.looked_up(_requests(spark), corpus.page_store(spark, sf_dir)).select("book_id", "page_id", "found", F.length("body").cast("long").alias("body_length"))


@query(f"with {O.TRAILS} select book_id, title_id, page_id, level, until from held")
def toc_intervals(spark, sf_dir):
    return H.intervals(corpus.toc(spark, sf_dir)).select("book_id", "title_id", "page_id", "level", "until")


@query(f"with {O.TRAILS} select p.book_id, p.page_id, coalesce(string_agg(h.title, ' › ' order by h.level), '') trail from {O.PAGES} p left join held h on h.book_id = p.book_id and h.page_id <= p.page_id and (h.until is null or p.page_id < h.until) group by p.book_id, p.page_id")
def toc_trail(spark, sf_dir):
    return H.trails(corpus.pages(spark, sf_dir), corpus.toc(spark, sf_dir)).select("book_id", "page_id", F.array_join("toc_path", " › ").alias("trail"))


# comparison, citation, export


_GROUPS = f"{O.hits(PHRASE.split(), 'phrase')}, {_CB}, k as (select h.*, school, row_number() over (partition by school order by score desc, doc) as rnk from hits h join cb using (book_id)), few as (select * from k where rnk <= 8)"


def _few(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _hits(spark, sf_dir, PHRASE, "phrase").join(_books(spark, sf_dir).select("book_id", "school"), "book_id")
    return S.top_per(rows, "school", 8).withColumn("excerpt", F.lit(""))


@query(f"with {_GROUPS}, b as (select school, book_id, count(*) n, string_agg(page_id, ',' order by score desc, doc) pages from few group by school, book_id) select school, cast(sum(n) as bigint) n_passages, count(*) n_books, string_agg(book_id || ':' || pages, ';' order by n desc, book_id) groups from b group by school")
def compare_groups_flat(spark, sf_dir):
    g = P.groups(_few(spark, sf_dir))
    flat = F.array_join(F.transform("books", lambda b: F.concat(b["book_id"], F.lit(":"), F.array_join(F.transform(b["passages"], lambda p: p["page_id"].cast("string")), ","))), ";")
    return g.select("school", F.col("n_passages").cast("long").alias("n_passages"), "n_books", flat.alias("groups"))


@query(f"with {_GROUPS} select s.school, ord, count(f.doc) passages, count(distinct f.book_id) books from {O.SCHOOL_ROWS} left join few f on f.school = s.school where ord < 4 group by s.school, ord")
def schools_without_evidence(spark, sf_dir):
    return P.evidence(_few(spark, sf_dir), list(schema.CORE))


_LABEL = "case school " + " ".join(f"when '{k}' then '{v}'" for k, v in schema.SCHOOLS.items()) + " end"
_CITED = f"""{O.TRAILS}, {_CB}, t as (select p.book_id, p.page_id, string_agg(h.title, ' › ' order by h.level) trail from {O.PAGES} p join held h on h.book_id = p.book_id and h.page_id <= p.page_id and (h.until is null or p.page_id < h.until) group by all),
c as (select p.book_id, p.page_id, author, coalesce(title, p.book_id) name_, part, printed_page, trail, school, verification_status, classification_source,
  'v.' || part || case when printed_page is null then '' else '/p.' || cast(cast(printed_page as int) as varchar) end locus
  from {O.PAGES} p join cb using (book_id) left join t using (book_id, page_id))"""


def _cited(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages, toc = corpus.pages(spark, sf_dir), corpus.toc(spark, sf_dir)
    return P.citations(pages.join(_books(spark, sf_dir), "book_id").join(H.trails(pages, toc), ["book_id", "page_id"], "left"))


@query(f"with {_CITED} select book_id, page_id, coalesce(author || ', ', '') || name_ || ', ' || locus || ' (page id ' || page_id || ')' || coalesce(', in: ' || trail, '') || '. [' || {_LABEL} || '] - {P.NUMBERING}' formatted, name_ || ', ' || locus || case when printed_page is null then ' (page id ' || page_id || ')' else '' end formatted_short from c")
def citation_strings(spark, sf_dir):
    return _cited(spark, sf_dir).select("book_id", "page_id", "formatted", "formatted_short")


@query(f"with {_CITED} select book_id, page_id, '{P.NUMBERING}' || case when printed_page is null then '|no printed page is recorded; none was guessed' else '' end || case when verification_status <> 'verified' then '|the attribution to ' || {_LABEL} || ' is ' || verification_status || ' (source: ' || classification_source || ')' else '' end || case when trail is null then '|the book has no headings for this page' else '' end caveats from c")
def caveats(spark, sf_dir):
    return _cited(spark, sf_dir).select("book_id", "page_id", F.array_join("caveats", "|").alias("caveats"))


@query(f"with {O.hits(PHRASE.split(), 'phrase')}, {_CB}, {O.TRAILS}, t as (select p.book_id, p.page_id, string_agg(h.title, ' › ' order by h.level) trail from {O.PAGES} p join held h on h.book_id = p.book_id and h.page_id <= p.page_id and (h.until is null or p.page_id < h.until) group by all) select x.book_id, title, school, x.page_id, part, printed_page, coalesce(trail, '') toc_path, round(score, 6) score, case when contains({O.fold('body')}, '{PHRASE}') then 'phrase «{PHRASE}» occurs in order on the page' else 'the index matched the phrase; its order isn''t confirmed in the readable text' end match_reason, 'phrase' match_mode, sha256(body) text_sha256 from hits x join cb using (book_id) join {O.PAGES} p using (book_id, page_id) left join t using (book_id, page_id) where downloaded")
def export_rows(spark, sf_dir):
    q = parse(PHRASE, "phrase")
    books = _books(spark, sf_dir).where("downloaded")
    rows = P.passages(S.hits(_index(spark, sf_dir), q), corpus.page_store(spark, sf_dir), books, corpus.toc(spark, sf_dir), q)
    out = P.export_rows(rows, q)
    return out.select("book_id", "title", "school", "page_id", "part", "printed_page", F.array_join("toc_path", " › ").alias("toc_path"), F.round("score", 6).alias("score"), "match_reason", "match_mode", F.sha2("text_original", 256).alias("text_sha256"))


@query(f"with {O.hits(PHRASE.split(), 'phrase')}, {_CB} select cb.book_id, school, count(doc) as hits from cb left join hits using (book_id) where downloaded group by all")
def export_by_book(spark, sf_dir):
    hits = _hits(spark, sf_dir, PHRASE, "phrase").groupBy("book_id").agg(F.count("*").alias("hits"))
    return _books(spark, sf_dir).where("downloaded").join(hits, "book_id", "left").select("book_id", "school", F.coalesce("hits", F.lit(0)).alias("hits"))


# what tools add


@query(f"with {O.hits(PHRASE.split(), 'phrase')} select count(*) total, count(*) met, count(distinct doc) apart, cast(ceil(count(*) / 50.0) as bigint) batches from hits")
def cursor_walk(spark, sf_dir):
    """A walk by cursors: every hit is met once, in batches of 50."""
    rows, after, met, batches = _hits(spark, sf_dir, PHRASE, "phrase").persist(), None, [], 0
    while few := S.page(rows, 50, after).collect():
        met, batches, after = [*met, *(r["doc"] for r in few)], batches + 1, (few[-1]["score"], few[-1]["doc"])
    total = rows.count()
    rows.unpersist()
    return spark.range(1).select(F.lit(total).cast("long").alias("total"), F.lit(len(met)).cast("long").alias("met"), F.lit(len(set(met))).cast("long").alias("apart"), F.lit(batches).cast("long").alias("batches"))


@query(f"with p as (select page_id, cast(floor((page_id - 1) / 37.0) as int) as batch from {O.PAGES} x where book_id = 'src0-en') select page_id, batch from p")
def keyset_pages(spark, sf_dir):
    """One book read in batches of 37 pages, each from where the last one ended."""
    book, last, out, batch = corpus.pages(spark, sf_dir).where("book_id = 'src0-en'").select("page_id"), None, [], 0
    while few := [r[0] for r in P.after(book, last, 37).collect()]:
        out, batch, last = [*out, *((p, batch) for p in few)], batch + 1, few[-1]
    return spark.createDataFrame(out, "page_id int, batch int")


_IDS = "case lang when 'de' then '-' || doc_id when 'fr' then source || '-x' || doc_id when 'es' then source else source || '-' || doc_id || case when doc_id % 3 = 0 then '-1' else '' end end"


@query(f"with k as (select doc_id, {_IDS} id from documents), p as (select doc_id, split_part(id, '-', 1) book_id, substring(id, strpos(id, '-') + 1) rest from k where strpos(id, '-') > 1), q as (select doc_id, book_id, coalesce(try_cast(case when regexp_full_match(rest, '[+-]?[0-9]+') then rest end as int), -1) page_id from p) select *, book_id || '#' || page_id passage from q")
def composite_keys(spark, sf_dir):
    rows = corpus.documents(spark, sf_dir).select("doc_id", F.expr(_IDS).alias("id"))
    return S.keyed(rows).select("doc_id", "book_id", "page_id", S.passage_key().alias("passage"))


_ALL_HITS = O.hits(ANY.split(), "any_terms")


@query(f"with {_ALL_HITS}, few as (select * from hits order by score desc, doc limit 300) select book_id, count(*) hits, (select count(*) from hits) <= 300 as scanned from few group by book_id")
def bounded_discovery(spark, sf_dir):
    """Counts of the 300 best hits, and whether those are all."""
    few, scanned = S.bounded(_hits(spark, sf_dir, ANY, "any_terms"), 300)
    return P.counts_by_book(few).withColumn("scanned", F.lit(scanned))


def _readable(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The pages of books that are there."""
    return corpus.pages(spark, sf_dir).join(corpus.books(spark, sf_dir).where("downloaded").select("book_id"), "book_id", "left_semi")


@query(f"with {_ALL_HITS} select h.book_id, title, count(*) pages from hits h join {O.BOOKS} b using (book_id) where not downloaded group by all")
def unreadable_books(spark, sf_dir):
    return P.unreadable(_hits(spark, sf_dir, ANY, "any_terms"), _readable(spark, sf_dir), corpus.books(spark, sf_dir))


@query(f"with {_ALL_HITS} select distinct h.book_id, title, 'none of the book''s pages can be read' as error from hits h join {O.BOOKS} b using (book_id) where not downloaded")
def failing_books(spark, sf_dir):
    return P.failing(_hits(spark, sf_dir, ANY, "any_terms"), _readable(spark, sf_dir), corpus.books(spark, sf_dir))


@query(f"with {_STATUS} select s.book_id, s.page_id, case when not requested then 'neighbour of a requested page' when contains({O.fold('body')}, '{PHRASE}') then 'phrase «{PHRASE}» occurs in order on the page' else 'the index matched the phrase; its order isn''t confirmed in the readable text' end match_reason, sha256(body) text_sha256 from s join {O.PAGES} p on p.book_id = s.book_id and p.page_id = s.page_id where status = 'found'")
def fetch_with_query(spark, sf_dir):
    rows = P.fetch(_requests(spark), corpus.page_store(spark, sf_dir), corpus.books(spark, sf_dir), 1, corpus.toc(spark, sf_dir))
    got = P.fetched_passages(rows, _books(spark, sf_dir), corpus.toc(spark, sf_dir), parse(PHRASE, "phrase"), corpus.needs_nfc(spark, sf_dir))
    return got.select("book_id", "page_id", "match_reason", F.sha2("text_original", 256).alias("text_sha256"))


@query(f"with h as (select book_id, title_id, page_id, level, title from {O.TOC} t) select book_id, title_id, case when title_id % 2 = 0 then title else '' end title from h")
def headings_titled(spark, sf_dir):
    """Headings whose titles lie in a table of their own, which lacks some."""
    toc = corpus.toc(spark, sf_dir)
    return H.titled(toc.drop("title"), toc.where("title_id % 2 = 0")).select("book_id", "title_id", "title")


@query(f"select book_id, count(*) pages, count(*) filter (where body <> '') with_text from {O.PAGES} p group by book_id")
def pages_per_book(spark, sf_dir):
    return corpus.pages(spark, sf_dir).groupBy("book_id").agg(F.count("*").alias("pages"), F.count_if(F.col("body") != "").alias("with_text"))


@query(f"select book_id, page_id, doc from {O.PAGES} p where page_id between 3 and 7")
def page_range_scan(spark, sf_dir):
    """Pages 3 to 7 of each book, by their numbers."""
    return corpus.pages(spark, sf_dir).where(F.col("page_id").between(3, 7)).select("book_id", "page_id", "doc")


@query(" union all ".join(f"select '{m}' as mode, count(*) total from (with {O.hits(raw.split(), m)} select doc from hits) t" for raw, m in ((PHRASE, "phrase"), (ALL, "all_terms"), (ANY, "any_terms"))))
def total_hits(spark, sf_dir):
    each = [_hits(spark, sf_dir, raw, m).agg(F.count("*").alias("total")).select(F.lit(m).alias("mode"), "total") for raw, m in ((PHRASE, "phrase"), (ALL, "all_terms"), (ANY, "any_terms"))]
    return each[0].unionByName(each[1]).unionByName(each[2])


@query(f"with {_CB} select s.school from {O.SCHOOL_ROWS} left join cb on cb.school = s.school and cb.downloaded group by s.school having count(cb.book_id) = 0")
def schools_not_searched(spark, sf_dir):
    return C.coverage(_books(spark, sf_dir)).where("searched = 0").select("school")


@query(f"with {_ALL_HITS}, {_CB}, b as (select * from hits order by score desc, doc limit 50) select school, count(*) returned from b join cb using (book_id) group by school")
def batch_by_school(spark, sf_dir):
    """How many passages of one batch of 50 each school has."""
    return S.page(_hits(spark, sf_dir, ANY, "any_terms"), 50).join(_books(spark, sf_dir).select("book_id", "school"), "book_id").groupBy("school").agg(F.count("*").alias("returned"))


@query(f"with {_ALL_HITS}, {_CB}, k as (select h.doc, school, octet_length(encode(body)) as bytes, sum(octet_length(encode(body))) over w upto, row_number() over w k from hits h join cb using (book_id) join {O.PAGES} p on p.doc = h.doc window w as (partition by school order by score desc, h.doc rows unbounded preceding)) select school, doc, bytes from k where k = 1 or upto <= {BUDGET // 4}")
def equal_byte_shares(spark, sf_dir):
    """What fits each school's equal share of a byte budget, the best hits first."""
    rows = _hits(spark, sf_dir, ANY, "any_terms").join(_books(spark, sf_dir).select("book_id", "school"), "book_id").join(corpus.pages(spark, sf_dir).select("doc", "body"), "doc")
    return S.within_budget(rows, ["score desc", "doc"], BUDGET // 4, F.octet_length("body"), by="school").select("school", "doc", "bytes")


@query(f"with {_ALL_HITS} select doc, round(score, 6) score from hits order by hits.score desc, doc limit 20")
def cursor_round_trip(spark, sf_dir):
    """Where cursors after each of the 20 best hits go on from, as they are read back."""
    rows = S.page(_hits(spark, sf_dir, ANY, "any_terms"), 20).collect()
    told = [K.decode(K.encode("search", "fp", "qh", r["score"], r["doc"], k, 20), "search", "fp", "qh")["after"] for k, r in enumerate(rows)]
    return spark.createDataFrame([(a["doc"], round(a["score"], 6)) for a in told], "doc long, score double")


_LIMITS = ", ".join(f"('{k}', {m})" for k, (_, m) in schema.LIMITS.items())


@query(f"select doc_id, k kind, cast(greatest(1, least(m, floor(n_chars / 8.0 - 3))) as int) got from documents, (values {_LIMITS}) l(k, m) where n_chars is not null")
def clamped_limits(spark, sf_dir):
    """Every limit as a document's length would ask for it."""
    rows = corpus.documents(spark, sf_dir).where("n_chars is not null").select("doc_id", (F.col("n_chars") / 8.0 - 3).alias("asked"))
    told = F.array(*(F.struct(F.lit(k).alias("kind"), schema.clamped(F.col("asked"), k).alias("got")) for k in schema.LIMITS))
    return rows.select("doc_id", F.explode(told).alias("x")).select("doc_id", "x.*")


@query("select case when bool_and(coalesce(lang, '') = source) then 'lang' when bool_and(source is not null) then 'source' end as \"column\" from documents where source is not null")
def inferred_key(spark, sf_dir):
    """Which column is the part of a composite key before its dash."""
    rows = corpus.documents(spark, sf_dir).where("source is not null").select(F.concat_ws("-", "source", "doc_id").alias("id"), "lang", "source")
    return spark.range(1).select(F.lit(I.infer_key_column(rows, "id", ["lang", "source"])).alias("column"))


_EXCERPT = f"case when n <= 360 then body else case when l > 0 then '… ' else '' end || regexp_replace(substring(body, l + 1, r - l), '^[{T.SPACES}]+|[{T.SPACES}]+$', '', 'g') || case when r < n then ' …' else '' end end"


@query(f"""with {_GROUPS}, t as (select few.*, body, {O.fold('body')} f from few join {O.PAGES} p on p.doc = few.doc),
a as (select *, greatest(0, {_OFFSET}) at_ from t), b as (select *, length(body) n, greatest(0, at_ - 180) s, least(length(body), at_ + 180) e from a),
c as (select *, s - length(regexp_extract(substring(body, 1, s), '[^{T.SPACES}]*$')) l, e + length(regexp_extract(substring(body, e + 1), '^[^{T.SPACES}]*')) r from b),
x as (select school, book_id, count(*) k, string_agg(page_id || '=' || md5({_EXCERPT}), ',' order by score desc, doc) pages from c group by school, book_id)
select school, string_agg(book_id || ':' || pages, ';' order by k desc, book_id) groups from x group by school""")
def compare_groups_excerpts(spark, sf_dir):
    """The passages of a comparison as they are shown: by school and book, each with its excerpt."""
    few, q = _few(spark, sf_dir), parse(PHRASE, "phrase")
    rows = P.passages(few.select("book_id", "page_id", "doc", "score"), corpus.page_store(spark, sf_dir), _books(spark, sf_dir), corpus.toc(spark, sf_dir), q, nfc=corpus.needs_nfc(spark, sf_dir))
    flat = F.array_join(F.transform("books", lambda b: F.concat(b["book_id"], F.lit(":"), F.array_join(F.transform(b["passages"], lambda p: F.concat(p["page_id"].cast("string"), F.lit("="), F.md5(p["excerpt"]))), ","))), ";")
    return P.groups(rows).select("school", flat.alias("groups"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(SQL)
