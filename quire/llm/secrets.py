"""Secret scans over an incremental blob ledger.

Every text is a blob, addressed by its SHA-256. The ledger holds, for each pair of blob and rule version, the spans found, and
for each path (doc_id) every blob it has ever carried, so findings of replaced versions stay known. A scan takes only pairs of blob
and rule version that the ledger lacks, and findings are joined back to all paths.

What is neither repeated nor, by a filter, perhaps known is scanned where it lies. Of the rest the hashes meet: one path of each blob that
the ledger lacks is chosen, and only those texts move. A second scan of the same texts scans none, and moves none. The join
back to the paths keeps common blobs out of the shuffle (join_groups).

Memory: one Arrow batch. Defined results: null text is the empty blob; a blob without findings has empty spans and is in the
ledger too; repeated rows each get the findings; other columns are ignored, whatever their names; an empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quire.llm.common import KeyFilter, RepeatFilter, cut, join_groups, modest_batches, sized, text_of

# The kinds in their order, the pattern of each, the group that is measured, and its least length.
KINDS = ("assign", "access", "hex")
RULES = {
    "assign": (r"""(?i:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 8),
    "access": (r"AKIA[A-Z0-9]+", 0, 16),
    "hex": (r"[0-9a-f]+", 0, 32),
}
VERSION = hashlib.sha256(repr(RULES).encode()).hexdigest()[:16]
_ASSIGN = re.compile(RULES["assign"][0], re.ASCII)
_ACCESS = re.compile(RULES["access"][0])
#: Maximal runs: the same as matching runs of any length and dropping those under 32.
_HEX = re.compile(r"[0-9a-f]{32,}")
_SCHEMA = "doc_id long, blob string, n_assign long, n_access long, n_hex long, spans string"


def spans(text: str) -> list[tuple[int, int, str]]:
    """(start, kind, end) in code points, by start and then kind as listed."""
    found = []
    if ":" in text or "=" in text:
        found += [(m.start(), 0, m.end()) for m in _ASSIGN.finditer(text) if m.end(2) - m.start(2) >= 8]
    found += [(m.start(), 1, m.end()) for m in _ACCESS.finditer(text) if m.end() - m.start() >= 16]
    found += [(m.start(), 2, m.end()) for m in _HEX.finditer(text)]
    return sorted(found)


def _scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        cols: list[list] = [[], [], [], []]
        for text in b.column("text").to_pylist():
            found = spans(text)
            for k in range(3):
                cols[k].append(sum(x[1] == k for x in found))
            cols[3].append(",".join(f"{KINDS[k]}:{s}:{e}" for s, k, e in found))
        yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("blob"), *(pa.array(c, pa.int64()) for c in cols[:3]), pa.array(cols[3], pa.string())], ["doc_id", "blob", "n_assign", "n_access", "n_hex", "spans"])


_FOUND = ["n_assign", "n_access", "n_hex", "spans"]


class Ledger:
    """Two Parquet tables under path, in a folder that driver and executors share; each scan appends to both. findings: a row per blob
    and rule version. paths: a row per path and blob that it has carried.
    """

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path

    def table(self, name: str) -> DataFrame | None:
        p = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{name}")
        there = p.getFileSystem(self.spark._jsc.hadoopConfiguration()).exists(p)
        return self.spark.read.parquet(f"{self.path}/{name}") if there else None

    def findings(self, version: str = VERSION) -> DataFrame | None:
        held = self.table("findings")
        return None if held is None else held.where(F.col("rule_version") == version).drop("rule_version")

    def append(self, found: DataFrame, version: str) -> None:
        found.select("blob", *_FOUND, F.lit(version).alias("rule_version")).write.mode("append").parquet(f"{self.path}/findings")

    def remember(self, paths: DataFrame) -> None:
        """Adds the pairs of path and blob that aren't there yet."""
        new, held = paths.groupBy("doc_id", "blob").agg(F.count("*").alias("n")).drop("n"), self.table("paths")
        if held is not None:
            old = held.select(F.col("doc_id").alias("_doc"), F.col("blob").alias("_blob"))
            new = new.join(old, (F.col("blob") == F.col("_blob")) & F.col("doc_id").eqNullSafe(F.col("_doc")), "left_anti")
        new.write.mode("append").parquet(f"{self.path}/paths")

    def history(self, version: str = VERSION) -> DataFrame:
        """doc_id, blob and findings of every version that any path has carried."""
        return _joined(self.table("paths"), self.findings(version))


def _joined(paths: DataFrame, findings: DataFrame) -> DataFrame:
    counted = paths.groupBy("blob").agg(F.count("*").alias("paths"))
    found = cut(findings.join(counted, "blob"))
    return join_groups(paths.select("doc_id", "blob"), found, "blob", "paths").select("doc_id", "blob", *_FOUND)


def unseen(docs: DataFrame, ledger: Ledger, version: str = VERSION) -> tuple[DataFrame, DataFrame]:
    """The paths (doc_id, blob) of docs, and the texts that have to be scanned (doc_id, text, blob): one at least, and but for rows alike in
    doc_id and text only one, of each blob that has no findings under version.
    """
    texts = docs.select("doc_id", text_of().alias("text")).withColumn("blob", F.sha2("text", 256)).withColumn("h", F.xxhash64("blob"))
    paths = cut(texts.select("doc_id", "blob", "h"))
    repeated, known = RepeatFilter(paths, "h"), ledger.findings(version)
    old = None if known is None else KeyFilter(known.select(F.xxhash64("blob").alias("h")), "h")

    def marked(rows: DataFrame) -> DataFrame:
        rows = repeated.mark(rows, "h", "maybe")
        return rows if old is None else old.mark(rows, "h", "_old").withColumn("maybe", F.col("maybe") | F.col("_old")).drop("_old")

    texts = marked(texts)
    rest = marked(paths).where("maybe").groupBy("blob").agg(F.min("doc_id").alias("doc_id"))
    rest = rest if known is None else rest.join(known.select("blob"), "blob", "left_anti")
    one, rows = sized(rest.select(F.col("blob").alias("_blob"), F.col("doc_id").alias("_doc"), F.xxhash64("blob", "doc_id").alias("_place")))
    out = texts.where(~F.col("maybe")).select("doc_id", "text", "blob")
    if rows:
        chosen = texts.where("maybe").withColumn("place", F.xxhash64("blob", "doc_id"))
        chosen = KeyFilter(one, "_place", rows).mark(chosen, "place", "_wanted").where("_wanted")
        same = (F.col("blob") == F.col("_blob")) & F.col("doc_id").eqNullSafe(F.col("_doc"))
        out = out.unionByName(chosen.join(one.hint("shuffle_hash"), same, "left_semi").select("doc_id", "text", "blob"))
    return paths.select("doc_id", "blob"), out


def scan(docs: DataFrame, ledger: Ledger, version: str = VERSION) -> DataFrame:
    """doc_id, blob, n_assign, n_access, n_hex, spans of every row of docs, after what the ledger lacks was scanned and added to it."""
    modest_batches(docs.sparkSession)
    paths, todo = unseen(docs, ledger, version)
    ledger.append(todo.mapInArrow(_scan, _SCHEMA), version)
    ledger.remember(paths)
    return _joined(paths, ledger.findings(version).dropDuplicates(["blob"]))
