"""The tools: one call each, over a catalogue, pages, headings and an index. A call collects one batch at most."""

from __future__ import annotations

import json
from collections.abc import Callable
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quire import schema
from quire.errors import QuireError
from quire.operators import catalogue as C
from quire.operators import export as X
from quire.operators import passages as P
from quire.operators import search as S
from quire.plans import cursor as K
from quire.plans.index import Index, describe
from quire.plans.query import ParsedQuery, parse
from quire.plans.runs import Runs
from quire.sources import library as L
from quire.sources.pages import PageStore

#: Variables whose state health tells.
SETTINGS = ("QUIRE_LIBRARY", "QUIRE_OUTPUT", "QUIRE_RESPONSE_BYTES", "QUIRE_CATEGORY_MAP", "QUIRE_OVERRIDES")

GUIDE = {
    "overview": "Search, compare and cite passages of a library of paged books. Nothing is written but exports.",
    "workflow": "list_books, then discover_issue for where a topic occurs, fetch_passages to read around it, compare_issue across schools, export_results for all of it, citation for one page.",
    "examples": "search(query, mode='phrase'); discover_issue(query); fetch_passages(requests=[{'book_id': b, 'page_ids': [1, 2]}]).",
    "limits": "No fuzzy, prefix, wildcard, proximity or semantic search and no stemming. " + "; ".join(f"{k}: {a}, at most {b}" for k, (a, b) in schema.LIMITS.items()),
    "fields": "school, classification_source, verification_status and ambiguity_reasons tell how a book was classified; page_id is the library's own page, printed_page the edition's.",
}


def _together(*calls: Callable) -> list:
    """The results of calls whose Spark jobs don't wait for one another."""
    with ThreadPoolExecutor(len(calls)) as pool:
        return [f.result() for f in [pool.submit(c) for c in calls]]


@dataclass
class Engine:
    books: DataFrame  # classified
    pages: DataFrame
    toc: DataFrame
    index: Index
    include: list[str] = field(default_factory=list)
    byte_budget: int = schema.RESPONSE_BYTES[0]
    output_root: str = "exports"
    library: str | None = None
    nfc: bool = False
    store: PageStore | None = None  # the pages with their locator, where there is one
    runs: Runs = field(default_factory=Runs)  # of walks that are under way

    def __post_init__(self):
        _, least, most = schema.RESPONSE_BYTES
        self.byte_budget = max(least, min(most, self.byte_budget))

    # scope

    def scope(self, schools=None, book_ids=None, core_only: bool = False) -> DataFrame:
        asked = [s for s in (schools or schema.CORE) if not core_only or s in schema.CORE]
        return C.select_books(self.books, asked, book_ids, include=self.include)

    def _identity(self, scope: DataFrame) -> tuple[str, DataFrame]:
        """The fingerprint of the index and of the scope's downloaded books, and those books. However many they are, a row comes back."""
        some = scope.where("downloaded").select("book_id").distinct()
        told = some.agg(F.count("*"), F.bit_xor(F.xxhash64("book_id")), F.bit_xor(F.xxhash64("book_id", F.lit(1)))).first()
        return K.fingerprint(self.index.generation, self.index.stats([]).docs, list(told)), some

    def coverage(self, scope: DataFrame, schools=None) -> dict:
        rows = [r.asDict() for r in C.coverage(scope).collect()]
        asked = list(schools or schema.CORE)
        rows = [r for r in rows if r["school"] in asked or r["in_scope"]]
        gone = C.missing_books(scope).first()
        four = set(asked) == set(schema.CORE)
        return {
            "scope": "the four schools" if four else ", ".join(asked), "schools_requested": asked, "in_scope": sum(r["in_scope"] for r in rows), "searched": sum(r["searched"] for r in rows),
            "schools": [{k: r[k] for k in ("school", "in_scope", "searched", "not_downloaded")} for r in rows], "schools_not_searched": [r["school"] for r in rows if not r["searched"]],
            "missing": gone["missing"], "missing_named": [x["book_id"] for x in gone["named"]],
        }

    @staticmethod
    def _envelope(total: int, returned: int, more: bool, cursor: str | None, reason: str, exact: bool = True) -> dict:
        return {"total_hits": total, "total_hits_exact": exact, "returned": returned, "has_more": more, "next_cursor": cursor, "truncated": reason != "none", "truncation_reason": reason}

    @staticmethod
    def _bytes(row: dict) -> int:
        return len(json.dumps(row, ensure_ascii=False, default=str).encode())

    def _fit(self, rows: list[dict], share: int = 1) -> list[dict]:
        """The prefix of rows within the byte budget, or one of so many equal shares of it; the first is always there."""
        out, used = [], 0
        for r in rows:
            used += self._bytes(r)
            if out and used > self.byte_budget // share:
                break
            out.append(r)
        return out

    # tools

    def health(self, refresh: bool = False) -> dict:
        """What is there and what isn't. A missing library, catalogue or index is told, never raised. refresh: the index is opened anew first, as it is
        stored now.
        """
        if refresh:
            try:
                self.index = self.index.refresh()
            except Exception:  # told below: what can't be opened can't be read
                self.index = Index(self.books.sparkSession, self.index.tokens, self.index.path, self.index.generation)
        counts = C.counts(self.books).first().asDict()
        unmapped, review = C.unmapped_categories(self.books), self.books.where("verification_status = 'needs_review'").count()
        warnings = []
        try:
            n = self.index.stats([])
            index = {"readable": True, "documents": n.docs, "tokens": n.tokens, "generation": self.index.generation, "stored": self.index.path}
        except Exception as e:
            index = {"readable": False, "documents": 0, "tokens": 0, "generation": self.index.generation, "stored": self.index.path, "error": str(e).splitlines()[0]}
        library, schema_told = self._library()
        environment = {name: L.setting(name)[1] for name in SETTINGS}
        spark = self.books.sparkSession
        missed = unmapped.count()
        if not index["documents"]:
            warnings.append("the index can't be read" if not index["readable"] else "the index is empty")
        if missed:
            warnings.append(f"{missed} categories aren't mapped to a school")
        if review:
            warnings.append(f"the attribution of {review} books needs review")
        if counts.get("structure_only"):
            warnings.append(f"{counts['structure_only']} books have a file without a text")
        if library and not library["found"]:
            warnings.append("the library wasn't found")
        warnings += [f"{name} holds a placeholder and was ignored" for name, state in environment.items() if state == "placeholder"]
        return {
            "library": library, "schema": schema_told, "catalogue": counts, "index": index, "environment": environment, "warnings": warnings,
            "classification": [r.asDict() for r in C.by_school(self.books, books=F.count("*"), downloaded=F.count_if("downloaded")).collect()],
            "needs_review": review, "unmapped": [r.asDict() for r in unmapped.limit(20).collect()], "unmapped_total": missed,
            "engines": {"active": "spark", "version": spark.version, "master": spark.sparkContext.master, "cores": spark.sparkContext.defaultParallelism},
            "settings": {"response_bytes": self.byte_budget, "output_root": self.output_root, "limits": {k: {"default": a, "most": b} for k, (a, b) in schema.LIMITS.items()}},
        }

    def _library(self) -> tuple[dict | None, dict | None]:
        """Whether the library's folder is one, and which tables and columns of its catalogue play which role."""
        if not self.library:
            return None, None
        check = L.source_check([self.library])[0]
        found = {"found": check["failed"] is None, "path": check["path"], "failed": check["failed"], "access": "read-only"}
        try:
            con = L.open_read_only(f"{self.library}/database/master.db")
            tables = L.introspect(con)
            con.close()
            p = L.probe_catalogue(tables)
        except QuireError as e:
            return found, {"error": e.code, "message": e.message}
        return found, {"tables": sorted(tables), "roles": p.tables | p.roles, "notes": p.notes}

    @staticmethod
    def guide(topic: str | None = None) -> dict:
        return {topic: GUIDE[topic]} if topic in GUIDE else dict(GUIDE)

    def list_books(self, schools=None, title=None, author=None, downloaded_only=False, statuses=None, ambiguous_only=False, limit=None, cursor=None) -> dict:
        request = ["list", schools, title, author, downloaded_only, statuses, ambiguous_only]
        at, limit = K.decode_ordinal(cursor, "list", request), schema.clamp(limit, "list")
        rows = C.listing(C.select_books(self.books, schools, None, downloaded_only, title, author, self.include), statuses, ambiguous_only)
        some = [r.asDict(True) for r in rows.orderBy("book_id").offset(at).limit(limit + 1).collect()]
        total = C.totals(rows).first().asDict()
        more = len(some) > limit
        return {"books": some[:limit], "batch": self._envelope(total["matched"], min(limit, len(some)), more, K.encode_ordinal("list", request, at + limit) if more else None, "max_results" if more else "none"), "totals": total | {"schools": [r.asDict() for r in C.by_school(rows, books=F.count("*")).where("books > 0").collect()]}}

    def search(self, query: str, mode: str = "all_terms", schools=None, book_ids=None, limit=None, cursor=None, include_full_text=False) -> dict:
        q, limit = parse(query, mode), schema.clamp(limit, "search")
        scope = self.scope(schools, book_ids)
        fp, some = self._identity(scope)
        after = K.decode(cursor, "search", fp, q.hash) if cursor else None
        found = S.hits(self.index, q, some)
        # a walk that goes on is ranked and stored once, and each further batch reads a range of that
        one = self.runs.of(self.pages.sparkSession, (fp, q.hash), lambda: found).page(limit + 1, (after["after"]["score"], after["after"]["doc"])) if after else S.page(found, limit + 1)
        total, few, told = _together(
            lambda: after["total"] if after and after["total"] >= 0 else found.count(), lambda: [r.asDict() for r in one.collect()],  # limit + 1 rows at most
            lambda: self.coverage(scope, schools),
        )
        more, few = len(few) > limit, few[:limit]
        rows = self._passages(few, q, include_full_text)
        fitted, gone, used, taken = [], {}, 0, 0
        for r in rows:
            if r.pop("unreadable"):  # consumed all the same: going on doesn't try it again
                gone[r["book_id"]] = {"book_id": r["book_id"], "title": r["title"], "reason": P.UNREADABLE}
            else:
                used += self._bytes(r)
                if fitted and used > self.byte_budget:
                    break
                fitted.append(r)
            taken += 1
        cut = taken < len(rows)
        delivered = (after["delivered"] if after else 0) + len(fitted)
        last = few[taken - 1] if taken else None
        cursor = K.encode("search", fp, q.hash, last["score"], last["doc"], delivered, total) if last and (more or cut) else None
        by: dict[str, int] = {}
        for r in fitted:
            by[r["school"]] = by.get(r["school"], 0) + 1
        return {"passages": fitted, "by_school": by, "batch": self._envelope(total, len(fitted), more or cut, cursor, "byte_budget" if cut else "max_results" if more else "none"), "unreadable_books": sorted(gone.values(), key=lambda x: x["book_id"]), "notes": P.notes(q), "coverage": told, "engine": {"generation": self.index.generation}}

    def _passages(self, few: list[dict], q: ParsedQuery, full_text: bool) -> list[dict]:
        if not few:
            return []
        spark = self.pages.sparkSession
        hits = spark.createDataFrame([(r["doc"], r["book_id"], r["page_id"], r["score"]) for r in few], "doc long, book_id string, page_id int, score double")
        pages = self.store or self.pages.where(F.col("book_id").isin(sorted({r["book_id"] for r in few})) & F.col("page_id").isin(sorted({r["page_id"] for r in few})))
        rows = P.passages(hits, pages, self.books, self.toc, q, nfc=self.nfc).withColumn("unreadable", F.col("text_original").isNull()).orderBy(F.desc("score"), "doc").drop("doc")
        rows = rows if full_text else rows.drop("text_original")
        return [r.asDict(True) for r in rows.collect()]

    def discover_issue(self, query: str, mode: str = "all_terms", schools=None, book_ids=None, limit=None, cursor=None, page_sample=None, scan_limit: int | None = None) -> dict:
        """scan_limit: of the best hits only so many are looked at, and totals are those of these; None counts all."""
        q, limit, sample = parse(query, mode), schema.clamp(limit, "books"), schema.clamp(page_sample, "sample")
        scope = self.scope(schools, book_ids)
        fp, some = self._identity(scope)
        at = int(K.decode(cursor, "discover", fp, q.hash)["after"]["doc"]) if cursor else 0
        found, scanned = S.hits(self.index, q, some), True
        if scan_limit is not None:
            found, scanned = S.bounded(found, scan_limit)
        found = found.persist()
        try:
            per, books, told = _together(
                lambda: P.totals_by_school(found, scope).collect(),
                lambda: [r.asDict(True) for r in P.discover(found, scope.select("book_id", "title", "author", "school"), sample).offset(at).limit(limit + 1).collect()],
                lambda: self.coverage(scope, schools),
            )
        finally:
            found.unpersist()
        grand = next((r for r in per if r["school"] is None), None)
        more = len(books) > limit
        by = sorted((r.asDict() for r in per if r["school"] is not None), key=lambda r: list(schema.SCHOOLS).index(r["school"]))
        cursor = K.encode("discover", fp, q.hash, 0.0, at + limit, at + limit, grand["hits"]) if more else None
        return {"totals": {"hits": grand["hits"] if grand else 0, "books_with_hits": grand["books"] if grand else 0, "by_school": by}, "books": books[:limit], "batch": self._envelope(grand["books"] if grand else 0, min(limit, len(books)), more, cursor, "scan_limit" if not scanned else "book_limit" if more else "none", scanned), "coverage": told, "counts_truncated": not scanned}

    def fetch_passages(self, requests: list[dict], neighbors=None, limit=None, cursor=None, include_full_text=True, query: str | None = None, mode: str = "all_terms") -> dict:
        """With a query requested pages tell why they match it, and their excerpts lie around the first match."""
        q, limit = parse(query, mode) if query else None, schema.clamp(limit, "fetch")
        n = 1 if neighbors is None else max(0, min(10, int(neighbors)))
        at = K.decode_ordinal(cursor, "fetch", [requests, n, query, mode])
        asked = [(str(r["book_id"]), int(p)) for r in requests for p in r["page_ids"]]
        spark = self.pages.sparkSession
        rows = P.fetch(spark.createDataFrame(asked, "book_id string, page_id int"), self.store or self.pages, self.books, n, self.toc)
        total = rows.count()
        window = rows.orderBy("book_id", "page_id").offset(at).limit(limit).persist()
        try:
            told = [r.asDict() for r in window.select("book_id", "page_id", "requested", "status").orderBy("book_id", "page_id").collect()]
            found = P.fetched_passages(window, self.books, self.toc, q, self.nfc).orderBy("book_id", "page_id")
            got = [r.asDict(True) for r in (found if include_full_text else found.drop("text_original")).collect()]
        finally:
            window.unpersist()
        fitted = self._fit(got)
        cut = len(fitted) < len(got)
        step = len(told)
        if cut:
            last = (fitted[-1]["book_id"], fitted[-1]["page_id"])
            step = 1 + next(i for i, r in enumerate(told) if (r["book_id"], r["page_id"]) == last)
        more = at + step < total
        seen = told[:step]
        return {
            "passages": fitted, "batch": self._envelope(total, len(fitted), more, K.encode_ordinal("fetch", [requests, n, query, mode], at + step) if more else None, "byte_budget" if cut else "max_results" if more else "none"),
            "failed_books": sorted({r["book_id"] for r in seen if r["status"] == "failed"}), "missing_pages": [{"book_id": r["book_id"], "page_id": r["page_id"]} for r in seen if r["status"] == "missing"],
        }

    def compare_issue(self, query: str, mode: str = "all_terms", schools=None, book_ids=None, per_school=None, neighbors=0, include_full_text=False) -> dict:
        """With neighbors every passage is read anew as a window: page order within a book, score 0."""
        q, n = parse(query, mode), schema.clamp(per_school, "per_school")
        asked = [s for s in schema.CORE if s in (schools or schema.CORE)]
        scope = self.scope(asked, book_ids).where(F.col("school").isin(asked))
        _, some = self._identity(scope)
        found = S.hits(self.index, q, some).join(scope.select("book_id", "school"), "book_id")
        few = [r.asDict() for r in S.top_per(found, "school", n).collect()]  # per_school rows a school
        rows = [r for r in self._passages(few, q, include_full_text) if not r.pop("unreadable")]
        if neighbors and rows:
            school = {r["book_id"]: r["school"] for r in rows}
            asked_pages = self.pages.sparkSession.createDataFrame([(r["book_id"], r["page_id"]) for r in few], "book_id string, page_id int")
            near = P.fetch(asked_pages, self.store or self.pages.where(F.col("book_id").isin(list(school))), self.books, max(0, min(10, int(neighbors))), self.toc)
            windows = P.fetched_passages(near, self.books, self.toc, q, self.nfc)
            rows = [r.asDict(True) for r in (windows if include_full_text else windows.drop("text_original")).orderBy("book_id", "page_id").collect()]
        rows = [r for s in asked for r in self._fit([r for r in rows if r["school"] == s], len(asked))]
        groups: dict[str, dict[str, list]] = {}
        for r in rows:
            groups.setdefault(r["school"], {}).setdefault(r["book_id"], []).append(r)
        listed = [{"school": s, "label": schema.SCHOOLS[s], "books": [{"book_id": b, "title": p[0]["title"], "passages": p} for b, p in sorted(groups[s].items(), key=lambda x: (-len(x[1]), x[0]))]} for s in schema.CORE if s in groups]
        return {"groups": listed, "summary": {"passages": len(rows), "books": len({r["book_id"] for r in rows}), "schools_with_evidence": [g["school"] for g in listed], "schools_without_evidence": [s for s in asked if s not in groups]}, "coverage": self.coverage(scope, asked), "notes": P.notes(q)}

    def export_results(self, query: str, mode: str = "all_terms", schools=None, book_ids=None, job_id: str = "export", output_dir: str | None = None, include_full_text=True, concurrency: int | None = None) -> dict:
        """concurrency: files that are published at a time."""
        q = parse(query, mode)
        folder = L.safe_output(output_dir, self.output_root, self.library)
        L.safe_job_id(job_id)
        scope = self.scope(schools, book_ids)
        fp, some = self._identity(scope)
        found = S.hits(self.index, q, some)
        failed, told = _together(lambda: [r.asDict() for r in P.failing(found, self.store or self.pages, self.books).collect()], lambda: self.coverage(scope, schools))  # a row per book that can't be read
        rows = P.export_rows(P.passages(found, self.store or self.pages, self.books, self.toc, q, nfc=self.nfc), q, include_full_text)
        return X.export(rows, scope, q, fp, folder, job_id, include_full_text, failed=failed, concurrency=schema.clamp(concurrency, "concurrency")) | {"coverage": told}

    def citation(self, book_id: str, page_id: int, include_text=False) -> dict:
        book = self.books.where(F.col("book_id") == book_id).first()
        if book is None:
            raise QuireError("BOOK_NOT_FOUND", f"no book {book_id}", book_id=book_id)
        if not book["downloaded"]:
            raise QuireError("BOOK_NOT_DOWNLOADED", f"book {book_id} isn't downloaded", book_id=book_id)
        page = self.pages.where((F.col("book_id") == book_id) & (F.col("page_id") == page_id))
        own = page.join(F.broadcast(self.books.where(F.col("book_id") == book_id)), "book_id")
        rows = own.join(P.trails(page, self.toc.where(F.col("book_id") == book_id)), ["book_id", "page_id"], "left")
        row = P.citations(rows).first()
        if row is None:
            raise QuireError("BOOK_NOT_FOUND", f"no page {page_id} in book {book_id}", book_id=book_id, page_id=page_id)
        keys = ("book_id", "title", "author", "school", "classification_source", "verification_status", "part", "printed_page", "page_id", "edition", "publisher")
        told = {k: row[k] for k in keys} | {"label": schema.SCHOOLS[row["school"]], "toc_path": list(row["toc_path"] or []), "numbering_authority": "library", "numbering_note": P.NUMBERING, "text_original": row["body"] if include_text else None}
        return {"citation": told, "formatted": row["formatted"], "formatted_short": row["formatted_short"], "caveats": list(row["caveats"])}


def index_report(index: Index) -> DataFrame:
    """Columns of an index with counts and lengths; no contents."""
    return describe(index.tokens.withColumn("terms", F.array_join("terms", " ")))


def over_tables(spark, sf_dir: str, config: C.Config | None = None, index: Index | None = None) -> Engine:
    """An engine over the driver's tables."""
    from quire.sources import corpus

    pages = corpus.pages(spark, sf_dir)
    nfc = corpus.needs_nfc(spark, sf_dir)
    config = config or C.Config.of([*C.RULES, *corpus.EXTRA_RULES])
    return Engine(C.classify(corpus.books(spark, sf_dir), config), pages, corpus.toc(spark, sf_dir), index or Index.over(pages, nfc), config.include, nfc=nfc, store=corpus.page_store(spark, sf_dir))
