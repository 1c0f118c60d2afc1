"""Schools, limits and record types."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: School codes in their order of presentation, with their Arabic labels.
SCHOOLS = {"hanafi": "الحنفي", "maliki": "المالكي", "shafii": "الشافعي", "hanbali": "الحنبلي", "comparative": "الفقه المقارن", "unclassified": "غير مُصنَّف"}
CORE = ("hanafi", "maliki", "shafii", "hanbali")
MODES = ("phrase", "all_terms", "any_terms")
STATUSES = ("verified", "needs_review", "unverified")
REASONS_CUT = ("none", "max_results", "byte_budget", "book_limit", "scan_limit", "time_budget")
#: Fixed values: (default, most) of each limit.
LIMITS = {"search": (50, 500), "books": (25, 200), "sample": (10, 200), "fetch": (50, 300), "neighbours": (1, 10), "list": (50, 500), "per_school": (8, 100), "export_batch": (500, 2000), "concurrency": (4, 16)}
RESPONSE_BYTES = (262_144, 16_384, 4_194_304)
EXCERPT_SEARCH, EXCERPT_FETCH = 180, 220

BOOK = "book_id string, title string, author string, category_id string, category string, downloaded boolean, file_path string"
PASSAGE = "book_id string, title string, author string, school string, classification_source string, verification_status string, page_id int, part string, printed_page double, toc_path array<string>, score double, match_reason string, text_original string, footnote string, excerpt string"


def schools(spark: SparkSession) -> DataFrame:
    """code, ord, label of every school; six rows, made in the plan."""
    values = ", ".join(f"('{c}', {i}, '{label}')" for i, (c, label) in enumerate(SCHOOLS.items()))
    return F.broadcast(spark.sql(f"select * from values {values} as t(school, ord, label)"))


def clamp(value: int | float | None, kind: str) -> int:
    """A limit as asked for, floored, within 1 and its most."""
    default, most = LIMITS[kind]
    return default if value is None else max(1, min(most, int(value // 1)))


def clamped(value: Column, kind: str) -> Column:
    """The same of a column."""
    default, most = LIMITS[kind]
    return F.when(value.isNull(), default).otherwise(F.greatest(F.lit(1), F.least(F.lit(most), F.floor(value)))).cast("int")
