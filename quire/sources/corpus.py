"""The driver's tables as a library of books: catalogue, pages and headings.

The mapping to books is plain SQL that Spark and DuckDB share; placeholders in braces name the tables. Pages are numbered once, stored
in order of book and page, and so are their index and what else is asked again and again (plans.store); PAGES, PLACED and TOC say
the same in SQL for DuckDB.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quire.functions import text as T
from quire.plans import store
from quire.plans.index import Index
from quire.sources.pages import PageStore

PAGES = """
select source || '-' || lang as book_id, cast(row_number() over (partition by source, lang order by doc_id) as int) as page_id, doc_id as doc, coalesce(text, '') as body, source
from {documents} where source is not null and lang is not null
"""

PLACED = """
select book_id, page_id, doc, body, cast(cast(floor((page_id - 1) / 60.0) as int) + 1 as string) as part,
  cast(case when source = 'src3' then null else page_id end as double) as printed_page, cast(null as string) as footnote
from ({pages}) p
"""

BOOKS = """
select source || '-' || lang as book_id,
  'Book ' || source || ' ' || lang || case when source = 'src5' then ' الحنفي' when source = 'src6' then ' للمالكية والشافعية' else '' end as title,
  case when source = 'src2' then null when source = 'src4' then 'أحمد بن حنبل' else 'Author ' || source end as author,
  case when source = 'src7' then null when source = 'src9' then '90' else lang end as category_id,
  case when source = 'src7' then null when source = 'src9' then 'الفقه العام' when source = 'src11' then ' أصول الفقه المالكي '
    when lang = 'en' then 'الفقه الحنفي' when lang = 'fr' then 'الفقه المالكي' when lang = 'de' then 'الفقه الشافعيّ' else 'الفقه الحنبلي' end as category,
  source not in ('src18', 'src19') as downloaded,
  case when source in ('src18', 'src19') then null else 'book/' || source || '/' || lang || '.db' end as file_path
from (select distinct source, lang from {documents} where source is not null and lang is not null) b
"""

TOC = """
select book_id, page_id as title_id, page_id, 1 + cast(page_id / 5 as int) % 3 as level, 'Heading ' || cast(page_id as string) as title
from ({pages}) p where page_id % 5 = 0
"""

#: Rules of the catalogue beside the shipped ones: a partial one, and two that contradict each other.
EXTRA_RULES = [{"id": "usul", "school": "maliki", "match_type": "contains", "patterns": ["أصول الفقه"], "reviewed": False}]


def _sql(text: str, documents: str = "{documents}") -> str:
    return text.replace("{pages}", PLACED.replace("{pages}", PAGES) if text is TOC else PAGES).replace("{documents}", documents)


def duck(text: str) -> str:
    """The mapping as DuckDB runs it, as a parenthesised query."""
    return f"({_sql(text, 'documents')})"


#: What a null source or lang is called; such documents have books of their own.
UNKNOWN = "(none)"


#: Rows of a side table that is broadcast, at most.
MAX_BROADCAST_ROWS = 100_000


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def _named(spark: SparkSession, sf_dir: str) -> DataFrame:
    return documents(spark, sf_dir).withColumns({c: F.coalesce(c, F.lit(UNKNOWN)) for c in ("source", "lang")})


def _write_pages(spark: SparkSession, sf_dir: str, folder: str) -> None:
    """The pages in order of book and page. Texts move once, to where their book and place in it lie in the order of all; a page's
    number then follows from its place in its partition and the number of its book's pages in the partitions before, so a book may be of any size.
    """
    by = ["source", "lang", "doc_id"]
    placed = _named(spark, sf_dir).select(*by, "text").repartitionByRange(store.partitions(spark, f"{sf_dir}/documents.parquet"), *by).sortWithinPartitions(*by)
    placed.withColumn("at", F.monotonically_increasing_id()).write.parquet(f"{folder}/placed")
    held = spark.read.parquet(f"{folder}/placed").withColumn("piece", F.shiftright("at", 33))
    pieces = store.cut(held.groupBy("source", "lang", "piece").agg(F.min("at").alias("first"), F.count("*").alias("n")))
    before = F.expr("coalesce(sum(n) over (partition by source, lang order by piece rows between unbounded preceding and 1 preceding), 0)")
    side = pieces.withColumn("before", before).drop("n")
    side = F.broadcast(side) if pieces.count() <= MAX_BROADCAST_ROWS else side
    rows = held.join(side, ["source", "lang", "piece"]).withColumn("page_id", (F.col("at") - F.col("first") + F.col("before") + 1).cast("int"))
    numbered = rows.select(
        F.concat("source", F.lit("-"), "lang").alias("book_id"), "page_id", F.col("doc_id").alias("doc"), F.coalesce("text", F.lit("")).alias("body"), F.col("text").isNotNull().alias("present"),
        (F.floor((F.col("page_id") - 1) / 60) + 1).cast("int").cast("string").alias("part"), F.when(F.col("source") == "src3", None).otherwise(F.col("page_id")).cast("double").alias("printed_page"), F.lit(None).cast("string").alias("footnote"),
    )
    PageStore.write(numbered, folder)
    store.remove(spark, f"{folder}/placed")


def page_store(spark: SparkSession, sf_dir: str) -> PageStore:
    """The pages of all documents, as they were numbered and stored once, with their locator."""
    return PageStore(spark, store.form(spark, f"{sf_dir}/documents.parquet", "pages", lambda folder: _write_pages(spark, sf_dir, folder)))


def _stored(spark: SparkSession, sf_dir: str) -> DataFrame:
    return page_store(spark, sf_dir).rows


def pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The pages of all documents, as they were numbered and stored once."""
    return _stored(spark, sf_dir).drop("present")


def texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, text of the documents that have one."""
    return _stored(spark, sf_dir).where("present").select(F.col("doc").alias("doc_id"), F.col("body").alias("text"))


def needs_nfc(spark: SparkSession, sf_dir: str) -> bool:
    """Whether any text needs NFC before it is folded; looked up once for each state of the documents."""
    folder = store.form(spark, f"{sf_dir}/documents.parquet", "nfc", lambda folder: spark.range(1).select(F.lit(T.needs_nfc(pages(spark, sf_dir), "body")).alias("nfc")).write.parquet(folder))
    return spark.read.parquet(folder).first()["nfc"]


def index(spark: SparkSession, sf_dir: str) -> Index:
    """The stored index of the pages."""
    folder = store.form(spark, f"{sf_dir}/documents.parquet", "index", lambda folder: Index.over(pages(spark, sf_dir), needs_nfc(spark, sf_dir)).store(folder))
    return Index.open(spark, folder)


def books(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.sql(_sql(BOOKS), documents=_named(spark, sf_dir))


def toc(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = pages(spark, sf_dir).where("page_id % 5 = 0")
    return rows.select("book_id", F.col("page_id").alias("title_id"), "page_id", (F.floor(F.col("page_id") / 5) % 3 + 1).cast("int").alias("level"), F.concat(F.lit("Heading "), F.col("page_id").cast("string")).alias("title"))
