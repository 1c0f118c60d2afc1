"""Exhaustive exports: shards per book, a checkpoint, resumption, one ordered file, checksums.

All files are written and read through Hadoop's file systems, by executors and driver alike, so the folder may lie wherever both see it.
"""

from __future__ import annotations

import hashlib
import json
import uuid
from concurrent.futures import ThreadPoolExecutor
from datetime import UTC, datetime

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from quire.errors import QuireError
from quire.functions.text import NORMALIZER
from quire.plans.query import ParsedQuery
from quire.plans.store import cut, file_system
from quire.sources.library import shard_path

_BUFFER = 1 << 20


class Folder:
    """Files below a folder, as Hadoop sees it."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")
        self.fs, self.root = file_system(spark, self.path)
        self.jvm = spark._jvm

    def at(self, name: str):
        return self.jvm.org.apache.hadoop.fs.Path(f"{self.path}/{name}")

    def exists(self, name: str) -> bool:
        return self.fs.exists(self.at(name))

    def names(self, name: str) -> list[str]:
        return sorted(s.getPath().getName() for s in self.fs.listStatus(self.at(name))) if self.exists(name) else []

    def read(self, name: str) -> str:
        stream = self.fs.open(self.at(name))
        try:
            return self.jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
        finally:
            stream.close()

    def write(self, name: str, text: str) -> None:
        """The whole file or none: it appears under its name when it is complete."""
        stream = self.fs.create(self.at(f"{name}.partial"), True)
        stream.write(text.encode())
        stream.close()
        self.publish(f"{name}.partial", name)

    def publish(self, made: str, name: str) -> None:
        self.fs.delete(self.at(name), False)
        if not self.fs.rename(self.at(made), self.at(name)):
            raise QuireError("EXPORT_INCOMPLETE", f"can't put {name} in place", path=self.path)

    def joined(self, names: list[str], to: str) -> str:
        """Writes the files behind one another; the SHA-256 of what was written. Bytes don't leave the JVM."""
        digest = self.jvm.java.security.MessageDigest.getInstance("SHA-256")
        out = self.jvm.java.security.DigestOutputStream(self.fs.create(self.at(f"{to}.partial"), True), digest)
        for n in names:
            self.jvm.org.apache.hadoop.io.IOUtils.copyBytes(self._open(n), out, _BUFFER, False)
        out.close()
        self.publish(f"{to}.partial", to)
        return bytes(digest.digest()).hex()

    def _open(self, name: str):
        return self.fs.open(self.at(name))

    def checksum(self, name: str) -> str:
        digest = self.jvm.java.security.MessageDigest.getInstance("SHA-256")
        nowhere = self.jvm.java.security.DigestOutputStream(self.jvm.java.io.OutputStream.nullOutputStream(), digest)
        self.jvm.org.apache.hadoop.io.IOUtils.copyBytes(self._open(name), nowhere, _BUFFER, True)
        return bytes(digest.digest()).hex()


def checksum(path: str) -> str:
    """SHA-256 of a file on this machine, read in pieces."""
    h = hashlib.sha256()
    with open(path, "rb") as f:
        while piece := f.read(_BUFFER):
            h.update(piece)
    return h.hexdigest()


def _checkpoint(out: Folder, identity: dict) -> dict:
    if not out.exists("checkpoint.json"):
        return identity | {"completed": {}}
    held = json.loads(out.read("checkpoint.json"))
    if any(held.get(k) != v for k, v in identity.items()):
        raise QuireError("CHECKPOINT_MISMATCH", "the job was begun with another query, index or form of rows", job=identity["job_id"])
    return held


def _key(book: str) -> str:
    return hashlib.sha256(book.encode()).hexdigest()[:32]


def _shards(out: Folder, rows: DataFrame, batch: list[str], threads: int = 8) -> dict[str, int]:
    """Writes the shards of some books in one job, each sorted by score and doc, and returns their rows. A large book's rows come from several
    tasks, in order. What the job has written is counted against what lies in the folder before any shard appears.
    """
    staging = f".staging-{uuid.uuid4().hex}"
    line = F.to_json(F.struct(*(c for c in rows.columns if c != "doc")), {"ignoreNullFields": "false"})
    part = rows.where(F.col("book_id").isin(batch)).select(F.substring(F.sha2("book_id", 256), 1, 32).alias("_book"), "score", "doc", line.alias("value"))
    part = cut(part)  # ranges are sampled first, and rows aren't made twice for that
    order = ["_book", F.desc("score"), "doc"]
    told = Observation()
    placed = part.repartitionByRange(*order).sortWithinPartitions(*order).select("_book", "value").observe(told, F.count(F.lit(1)).alias("n"))
    placed.write.partitionBy("_book").text(f"{out.path}/{staging}")
    key = {_key(b): b for b in batch}
    held = out.spark.read.schema("value string, _book string").text(f"{out.path}/{staging}") if told.get["n"] else None
    counts = {} if held is None else {key[r["_book"]]: r["n"] for r in held.groupBy("_book").agg(F.count("*").alias("n")).collect()}  # a row per book
    if sum(counts.values()) != told.get["n"]:
        raise QuireError("EXPORT_INCOMPLETE", "the folder lacks rows that executors wrote; driver and executors have to share it", path=out.path, wrote=told.get["n"], found=sum(counts.values()))

    def put(book: str) -> None:
        own = f"{staging}/_book={_key(book)}"
        files = [f"{own}/{n}" for n in out.names(own) if n.startswith("part-")]
        if len(files) == 1:
            out.publish(files[0], f"shards/{_name(book)}")
        else:
            out.joined(files, f"shards/{_name(book)}")

    with ThreadPoolExecutor(threads) as pool:
        list(pool.map(put, batch))
    out.fs.delete(out.at(staging), True)
    return {b: counts.get(b, 0) for b in batch}


def export(rows: DataFrame, books: DataFrame, query: ParsedQuery, fingerprint: str, folder: str, job_id: str, full_text: bool = True, books_per_job: int = 5000, failed: list[dict] = (), concurrency: int = 8) -> dict:
    """Writes rows (export_rows of the whole scope) book by book into folder/job_id and one results.jsonl.

    A Spark job writes the shards of up to books_per_job books; they appear under their names by a rename, and only then does the
    checkpoint name them. A book that is in the checkpoint with its shard is not done again. Books in failed (book_id, title, error)
    get no shard and are tried again by the next run. What the driver holds is a row per book. The single file is the shards behind one another,
    most hits first, then by id.
    """
    out = Folder(rows.sparkSession, f"{folder}/{job_id}")
    out.fs.mkdirs(out.at("shards"))
    identity = {"job_id": job_id, "query_hash": query.hash, "fingerprint": fingerprint, "normalizer": NORMALIZER, "include_full_text": full_text}
    state = _checkpoint(out, identity)
    there, bad = set(out.names("shards")), {f["book_id"] for f in failed}
    done = {b: n for b, n in state["completed"].items() if _name(b) in there and b not in bad}
    resumed = len(done)
    scope = [(r["book_id"], r["school"], r["downloaded"]) for r in books.select("book_id", "school", "downloaded").orderBy("book_id").collect()]
    todo = [b for b, _, ok in scope if ok and b not in done and b not in bad]
    for at in range(0, len(todo), books_per_job):
        done |= _shards(out, rows, todo[at : at + books_per_job], concurrency)
        out.write("checkpoint.json", json.dumps(state | {"completed": done, "updated_at": datetime.now(UTC).isoformat()}, ensure_ascii=False, indent=1))
    order = sorted((b for b in done if done[b]), key=lambda b: (-done[b], b))
    digest = out.joined([f"shards/{_name(b)}" for b in order], "results.jsonl")
    school = {b: s for b, s, _ in scope}
    by_school: dict[str, int] = {}
    for b in order:
        by_school[school[b]] = by_school.get(school[b], 0) + done[b]
    result = {
        "job_id": job_id, "path": out.path, "total": sum(done.values()), "checksum": digest, "resumed_books": resumed,
        "by_book": sorted(({"book_id": b, "hits": done.get(b, 0)} for b, _, ok in scope if ok and b not in bad), key=lambda x: (-x["hits"], x["book_id"])),
        "by_school": sorted(({"school": s, "hits": n} for s, n in by_school.items()), key=lambda x: (-x["hits"], x["school"])),
        "skipped": [b for b, _, ok in scope if not ok], "failed": sorted(failed, key=lambda f: f["book_id"]),
    }
    out.write("manifest.json", json.dumps({**identity, **result, "raw_query": query.raw, "mode": query.mode, "terms": query.terms, "written_at": datetime.now(UTC).isoformat()}, ensure_ascii=False, indent=1))
    out.write("report.md", report(result, query))
    return result | {"files": {"results.jsonl": digest} | {n: out.checksum(n) for n in ("manifest.json", "report.md")}}


def report(result: dict, query: ParsedQuery) -> str:
    lines = [f"# Export {result['job_id']}", "", f"Query: {query.raw} ({query.mode}). Rows: {result['total']}. SHA-256 of results.jsonl: {result['checksum']}", "", "| school | rows |", "| --- | ---: |"]
    lines += [f"| {x['school']} | {x['hits']} |" for x in result["by_school"]]
    lines += ["", "| book | rows |", "| --- | ---: |"] + [f"| {x['book_id']} | {x['hits']} |" for x in result["by_book"]]
    lines += ["", f"Not downloaded, not searched: {', '.join(result['skipped']) or 'none'}", "", "Failed:" if result["failed"] else "Failed: none"]
    lines += [f"* {f['title'] or f['book_id']}: {f['error']}" for f in result["failed"]] + [""]
    return "\n".join(lines)


def _name(book: str) -> str:
    return (shard_path(book) or f"book-{_key(book)}").replace("/", "-").removesuffix(".db") + ".jsonl"
