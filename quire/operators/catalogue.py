"""The catalogue: joins, classification by rules, lists and counts."""

from __future__ import annotations

import json
from dataclasses import dataclass, field
from pathlib import Path

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quire.errors import QuireError
from quire.functions import text as T
from quire.schema import CORE, SCHOOLS, STATUSES, schools

# What a title or an author may hint at.
HINTS = {
    "hanafi": ["حنفي", "حنفيه", "الاحناف", "ابو حنيفه"],
    "maliki": ["مالكي", "مالكيه", "المالكيه", "مالك بن انس"],
    "shafii": ["شافعي", "شافعيه", "الشافعيه"],
    "hanbali": ["حنبلي", "حنبليه", "الحنابله", "ابن حنبل", "احمد بن حنبل"],
}
#: The shipped rules, one category name a school.
RULES = [{"id": s, "school": s, "match_type": "equals", "patterns": [f"الفقه {SCHOOLS[s]}"], "reviewed": True} for s in CORE]


@dataclass
class Config:
    rules: list[dict] = field(default_factory=lambda: RULES)
    overrides: dict[str, str] = field(default_factory=dict)
    include: list[str] = field(default_factory=list)
    exclude: list[str] = field(default_factory=list)

    @classmethod
    def of(cls, rules: list, overrides: dict | None = None) -> Config:
        """Bad rules are left out; a bad override is an error. Of overrides for one book the last holds. Patterns are folded."""
        good = []
        for r in rules:
            named = isinstance(r, dict) and r.get("id") and r.get("school") in SCHOOLS and r.get("match_type") in ("equals", "contains")
            patterns = [f for p in r.get("patterns") or [] if isinstance(p, str) and (f := T.fold_py(p))] if named else []
            if patterns:
                good.append({"id": str(r["id"]), "school": r["school"], "match_type": r["match_type"], "patterns": patterns, "reviewed": bool(r.get("reviewed"))})
        given = overrides or {}
        if not isinstance(given, dict):
            raise QuireError("OVERRIDES_INVALID", "overrides aren't an object")
        held = {}
        for o in given.get("overrides", []):
            if not isinstance(o, dict) or not o.get("book_id") or o.get("school") not in SCHOOLS:
                raise QuireError("OVERRIDES_INVALID", "an override needs a book_id and a known school", override=o)
            held[str(o["book_id"])] = o["school"]
        return cls(good, held, [str(x) for x in given.get("include", [])], [str(x) for x in given.get("exclude", [])])

    @classmethod
    def load(cls, rules: str | None = None, overrides: str | None = None) -> Config:
        """From JSON files; no file of overrides is fine."""
        listed = json.loads(Path(rules).read_text())["rules"] if rules else RULES
        try:
            given = json.loads(Path(overrides).read_text()) if overrides and Path(overrides).exists() else None
        except ValueError as e:
            raise QuireError("OVERRIDES_INVALID", f"overrides can't be read: {e}") from e
        return cls.of(listed, given)


def raw_books(books: DataFrame, authors: DataFrame | None = None, categories: DataFrame | None = None) -> DataFrame:
    """The catalogue with its authors' and categories' names: left joins on small tables, which Catalyst broadcasts by their size."""
    out = books
    if authors is not None:
        out = out.join(authors, "author_id", "left")
    if categories is not None:
        out = out.join(categories, "category_id", "left")
    blank = lambda c: F.nullif(F.trim(c.cast("string")), F.lit(""))
    return out.select(*(blank(F.col(c)).alias(c) for c in ("book_id", "title", "author", "category_id", "category")), "downloaded", blank(F.col("file_path")).alias("file_path")).where("book_id is not null")


def _hints(text: Column) -> Column:
    """The schools a folded text hints at, in order."""
    some = []
    for school, needles in HINTS.items():
        hit = F.lit(False)
        for n in needles:
            hit |= text.contains(T.fold_py(n))
        some.append(F.when(hit, school))
    return F.array_compact(F.array(*some))


def classify(books: DataFrame, config: Config | None = None) -> DataFrame:
    """books with school, classification_source, verification_status, ambiguity_reasons, matched_rule: override, else category rule,
    else unclassified. Rules and overrides are compiled into the plan, so the catalogue doesn't move. Excluded books are gone.
    """
    config = config or Config.of(RULES)
    out = books.where(~F.col("book_id").isin(config.exclude)) if config.exclude else books
    folded = lambda c: T.fold(F.coalesce(F.col(c), F.lit("")))
    out = out.withColumns({"_category": folded("category"), "_title": folded("title"), "_author": folded("author")})

    def hit(rule: dict) -> Column:
        some = F.lit(False)
        for p in rule["patterns"]:
            some |= (F.col("_category") == p) if rule["match_type"] == "equals" else F.col("_category").contains(p)
        strength = 2 if rule["match_type"] == "equals" else 1
        told = F.struct(F.lit(strength).alias("strength"), F.lit(rule["id"]).alias("id"), F.lit(rule["school"]).alias("school"), F.lit(rule["reviewed"]).alias("reviewed"))
        return F.when(some & (F.col("_category") != ""), told)

    found = F.array_compact(F.array(*map(hit, config.rules))) if config.rules else F.expr("cast(array() as array<struct<strength:int,id:string,school:string,reviewed:boolean>>)")
    override = F.try_element_at(F.create_map(*(F.lit(x) for p in config.overrides.items() for x in p)), F.col("book_id")) if config.overrides else F.lit(None).cast("string")
    out = out.withColumns({"_hits": found, "_override": override, "_th": _hints(F.col("_title")), "_ah": _hints(F.col("_author"))})
    out = out.withColumn("_best", F.array_max(F.transform("_hits", lambda h: h["strength"])))
    out = out.withColumn("_top", F.filter("_hits", lambda h: h["strength"] == F.col("_best")))
    out = out.withColumns({"_schools": F.array_sort(F.array_distinct(F.transform("_top", lambda h: h["school"]))), "_rule": F.try_element_at("_top", F.lit(1))})
    ruled, clash = F.size("_schools") == 1, F.size("_schools") > 1
    empty = F.expr("cast(array() as array<string>)")
    tell = lambda hints, what: F.transform(hints, lambda h: F.concat(F.lit(what), h))
    other = lambda c: F.filter(c, lambda h: h != F.col("_rule.school"))
    conflicts = F.concat(tell(other("_th"), "title_hint_conflicts:"), tell(other("_ah"), "author_hint_conflicts:"), F.when(F.col("_best") == 1, F.array(F.concat(F.lit("partial_category_match:"), F.col("_rule.id")))).otherwise(empty))
    only = F.concat(
        tell("_th", "title_hint_only:"), tell("_ah", "author_hint_only:"), F.when(F.size(F.array_union("_th", "_ah")) > 1, F.array(F.lit("conflicting_hints"))).otherwise(empty),
        F.when(F.coalesce("category", F.lit("")) == "", F.array(F.lit("no_category_in_catalogue"))).otherwise(F.array(F.lit("category_not_in_map"))),
    )
    candidates = F.concat(F.array(F.lit("conflicting_category_rules")), tell("_schools", "candidate:"))
    overridden = F.col("_override").isNotNull()
    out = out.withColumn("ambiguity_reasons", F.array_distinct(F.when(overridden, empty).when(clash, candidates).when(ruled, conflicts).otherwise(only)))
    plain = ruled & ~overridden
    status = F.when(overridden, "verified").when(clash, "needs_review").when(ruled, F.when(F.size("ambiguity_reasons") > 0, "needs_review").when(F.col("_rule.reviewed"), "verified").otherwise("unverified"))
    status = status.otherwise(F.when(F.exists("ambiguity_reasons", lambda r: r.contains("hint")), "needs_review").otherwise("unverified"))
    return out.select(
        *(c for c in books.columns), F.when(overridden, F.col("_override")).when(ruled, F.col("_rule.school")).otherwise("unclassified").alias("school"),
        F.when(overridden, "override").when(ruled, "category_map").otherwise("unclassified").alias("classification_source"), status.alias("verification_status"), "ambiguity_reasons",
        F.when(plain, F.col("_rule.id")).alias("matched_rule"),
    )


def folded_contains(column: str, needle: str) -> Column:
    return F.coalesce(T.fold(F.col(column)).contains(T.fold_py(needle)), F.lit(False))


def select_books(books: DataFrame, schools: list[str] | None = None, book_ids: list[str] | None = None, downloaded_only: bool = False, title: str | None = None, author: str | None = None, include: list[str] = ()) -> DataFrame:
    """Explicit ids set all other filters aside; else downloaded (if asked), of a school (or included by hand), with title and author."""
    if book_ids:
        return books.where(F.col("book_id").isin(book_ids))
    keep = F.col("downloaded") if downloaded_only else F.lit(True)
    if schools:
        keep &= F.col("school").isin(schools) | F.col("book_id").isin(list(include))
    if title:
        keep &= folded_contains("title", title)
    if author:
        keep &= folded_contains("author", author)
    return books.where(keep)


def listing(books: DataFrame, statuses: list[str] | None = None, ambiguous_only: bool = False) -> DataFrame:
    if statuses:
        books = books.where(F.col("verification_status").isin(statuses))
    return books.where(F.size("ambiguity_reasons") > 0) if ambiguous_only else books


def counts(books: DataFrame, files: DataFrame | None = None) -> DataFrame:
    """catalogue, downloaded, files_on_disk, structure_only (a file, not downloaded), orphans (a file, not in the catalogue)."""
    files = books.where("file_path is not null").select("book_id") if files is None else files.select("book_id").distinct()
    both = books.select("book_id", "downloaded").join(files.withColumn("_file", F.lit(True)), "book_id", "full")
    own = F.col("downloaded").isNotNull()
    return both.agg(F.count_if(own).alias("catalogue"), F.count_if(F.coalesce("downloaded", F.lit(False))).alias("downloaded"), F.count_if(F.col("_file")).alias("files_on_disk"), F.count_if(own & ~F.col("downloaded") & F.col("_file").isNotNull()).alias("structure_only"), F.count_if(~own).alias("orphans"))


def by_school(books: DataFrame, /, **measures: Column) -> DataFrame:
    """A row per school, in order and with zeros, with the measures."""
    got = books.groupBy("school").agg(*(m.alias(k) for k, m in measures.items()))
    out = schools(books.sparkSession).join(got, "school", "left")
    return out.select("school", "ord", *(F.coalesce(k, F.lit(0)).alias(k) for k in measures)).orderBy("ord")


def totals(books: DataFrame) -> DataFrame:
    return books.agg(F.count("*").alias("matched"), F.count_if("downloaded").alias("downloaded"), F.count_if(F.col("verification_status") == "needs_review").alias("needs_review"))


def unmapped_categories(books: DataFrame) -> DataFrame:
    name = F.trim("category")
    return books.where((F.col("classification_source") == "unclassified") & (name != "")).groupBy(name.alias("category")).agg(F.count("*").alias("book_count")).orderBy(F.desc("book_count"), "category")


def rule_effect(books: DataFrame, config: Config | None = None) -> DataFrame:
    """Books per rule, zeros kept."""
    rules = ", ".join(f"('{r['id']}')" for r in (config or Config.of(RULES)).rules)
    listed = books.sparkSession.sql(f"select * from values {rules} as t(rule)")
    return listed.join(books.where("matched_rule is not null").groupBy(F.col("matched_rule").alias("rule")).agg(F.count("*").alias("n")), "rule", "left").select("rule", F.coalesce("n", F.lit(0)).alias("books"))


def category_breakdown(books: DataFrame) -> DataFrame:
    return books.groupBy("category").agg(F.count("*").alias("books"), F.array_join(F.array_sort(F.collect_set("school")), ",").alias("schools"), F.bool_or(F.col("matched_rule").isNotNull()).alias("mapped"))


def reason_histogram(books: DataFrame) -> DataFrame:
    return books.select(F.explode("ambiguity_reasons").alias("r")).groupBy(F.split_part("r", F.lit(":"), F.lit(1)).alias("reason")).agg(F.count("*").alias("books"))


def verification_matrix(books: DataFrame) -> DataFrame:
    return books.groupBy("school").pivot("verification_status", list(STATUSES)).count().na.fill(0)


def coverage(books: DataFrame) -> DataFrame:
    """Per school: books in scope, searched (downloaded) and not downloaded; zeros kept, in order."""
    return by_school(books, in_scope=F.count("*"), searched=F.count_if("downloaded"), not_downloaded=F.count_if(~F.col("downloaded")))


def missing_books(books: DataFrame, sample: int = 20) -> DataFrame:
    """One row: the true number of books that aren't downloaded, and the first of them by id."""
    gone = books.where(~F.col("downloaded")).select("book_id", "title")
    first = gone.orderBy("book_id").limit(sample).agg(F.array_sort(F.collect_list(F.struct("book_id", "title"))).alias("named"))
    return gone.agg(F.count("*").alias("missing")).join(F.broadcast(first))  # one row each
