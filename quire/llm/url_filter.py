"""URL filters: a sorted digest array, memory-mapped and probed by vectorised binary search.

Rules are (host, path) strings such as ``example.net/en/``. Two arrays hold them in one file: the rules' hosts and the whole
rules, each as sorted 64-bit xxhash keys beside the full strings. A url's host and its parent domains are looked up among the
hosts; for those found, the prefixes of its path that are as long as some rule of that host are looked up among the rules.
A key that is found counts only if the stored string is equal, so colliding digests do no harm. The longest rule wins.

The file goes to each executor once through Spark's file server, under a name made of its content, and a lost executor's
successor fetches it again; tasks map it and keep one Arrow batch in memory.

Defined results: a null url, or one without ``://``, has an empty host and path and no rule; no rule means the default verdict;
a rule that is stated twice counts once, and of contradicting verdicts block wins; repeated rows each get their row; very long urls
cost no more than their length; other columns are ignored, whatever their names; an empty table gives an empty result.
"""

from __future__ import annotations

import atexit
import functools
import hashlib
import os
import re
import shutil
import tempfile
from collections.abc import Iterable, Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark import SparkFiles
from pyspark.sql import DataFrame

from quire.llm.common import kept

_URL = re.compile(r"://([^/?#]*)([^?#]*)", re.S)
_LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def digest(text: str) -> int:
    return xxhash.xxh64_intdigest(text.encode())


class DigestArray:
    """Sorted keys, and the strings they stand for; values: an integer of each string."""

    def __init__(self, keys: np.ndarray, ends: np.ndarray, blob: np.ndarray, values: np.ndarray):
        self.keys, self.ends, self.blob, self.values = keys, ends, blob, values

    @classmethod
    def build(cls, values: dict[str, int], key=digest) -> DigestArray:
        rows = sorted((key(s), s) for s in values)
        raw = [s.encode() for _, s in rows]
        return cls(np.array([k for k, _ in rows], "<u8"), np.cumsum([len(x) for x in raw], dtype="<u8"), np.frombuffer(b"".join(raw), "u1"), np.array([values[s] for _, s in rows], "<i8"))

    def string(self, i: int) -> str:
        return bytes(self.blob[int(self.ends[i - 1]) if i else 0 : int(self.ends[i])]).decode()

    def find(self, texts: list[str], key=digest) -> np.ndarray:
        """The values of texts; -1 where a text isn't held."""
        out = np.full(len(texts), -1, "i8")
        if not len(texts) or not len(self.keys):
            return out
        keys = np.fromiter(map(key, texts), "<u8", len(texts))
        at, end = np.searchsorted(self.keys, keys, "left"), np.searchsorted(self.keys, keys, "right")
        for i in np.flatnonzero(end > at):
            for k in range(at[i], end[i]):
                if self.string(k) == texts[i]:
                    out[i] = self.values[k]
                    break
        return out

    def parts(self) -> list[np.ndarray]:
        return [self.keys, self.ends, self.blob, self.values]


class RuleFile:
    """The hosts and rules of a rule list in one file: counts, then the parts one behind the other, each on an 8-byte boundary."""

    @staticmethod
    def write(rules: Iterable[tuple[str, str, str]], folder: str) -> str:
        """rules: (host, path, verdict). Returns the file's path; its name follows from its content."""
        verdicts: dict[str, int] = {}
        lengths: dict[str, set[int]] = {}
        for host, path, verdict in rules:
            name = host.translate(_LOWER) + path
            verdicts[name] = max(verdicts.get(name, 0), int(verdict == "block"))
            lengths.setdefault(host.translate(_LOWER), set()).add(len(path))
        hosts = sorted(lengths)
        ends = np.cumsum([len(lengths[h]) for h in hosts], dtype="<i8")
        lens = np.array([n for h in hosts for n in sorted(lengths[h], reverse=True)], "<i8")
        parts = [*DigestArray.build({h: i for i, h in enumerate(hosts)}).parts(), *DigestArray.build(verdicts).parts(), ends, lens, np.array([max([1, *(h.count(".") + 1 for h in hosts)])], "<i8")]
        raw = np.array([len(p) for p in parts], "<i8").tobytes() + b"".join(p.tobytes() + bytes(-p.nbytes % 8) for p in parts)
        path = os.path.join(folder, f"rules-{hashlib.sha256(raw).hexdigest()[:24]}.bin")
        with open(path, "wb") as f:
            f.write(raw)
        return path

    def __init__(self, path: str):
        whole = np.memmap(path, "u1", "r")
        counts, at, parts = whole[:88].view("<i8"), 88, []
        for n, kind in zip(counts, ["<u8", "<u8", "u1", "<i8"] * 2 + ["<i8"] * 3, strict=True):
            size = int(n) * np.dtype(kind).itemsize
            parts.append(whole[at : at + size].view(kind))
            at += size + -size % 8
        self.hosts, self.rules, self.ends, self.lens = DigestArray(*parts[:4]), DigestArray(*parts[4:8]), parts[8], parts[9]
        self.labels = int(parts[10][0])  # of the longest host

    def judge(self, hosts: list[str], paths: list[str]) -> tuple[list[str | None], np.ndarray]:
        """For each url the longest rule that fits, and whether it blocks (-1: no rule)."""
        rule: list[str | None] = [None] * len(hosts)
        block = np.full(len(hosts), -1, "i8")
        tried, owner = [], []
        for i, host in enumerate(hosts):
            # no more labels than the longest rule's host has
            labels = host.rsplit(".", self.labels)
            for k in range(len(labels) > self.labels, len(labels)):
                tried.append(".".join(labels[k:]))
                owner.append(i)
        found = self.hosts.find(tried)
        names, of = [], []
        for k in np.flatnonzero(found >= 0):
            h, path = int(found[k]), paths[owner[k]]
            for n in self.lens[int(self.ends[h - 1]) if h else 0 : int(self.ends[h])]:
                if n <= len(path):
                    names.append(tried[k] + path[:n])
                    of.append(owner[k])
        hits = self.rules.find(names)
        for k in np.flatnonzero(hits >= 0):
            if rule[of[k]] is None or len(names[k]) > len(rule[of[k]]):
                rule[of[k]], block[of[k]] = names[k], hits[k]
        return rule, block


def split_url(url: str | None) -> tuple[str, str]:
    found = _URL.search(url) if url else None
    return (found[1].translate(_LOWER), found[2]) if found else ("", "")


@functools.cache
def _folder() -> str:
    folder = tempfile.mkdtemp(prefix="quire-rules-")
    atexit.register(shutil.rmtree, folder, ignore_errors=True)
    return folder


def judge(pages: DataFrame, rules: Iterable[tuple[str, str, str]], default: str = "allow", url: str = "url", key: str = "page_id") -> DataFrame:
    """page_id, host, path, rule, verdict of every row."""
    sc = pages.sparkSession.sparkContext
    path = RuleFile.write(rules, _folder())  # the file server reads it there for as long as the session lives
    sc.addFile(path)
    name = os.path.basename(path)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held = kept(("rules", name), lambda: RuleFile(SparkFiles.get(name)))  # the map stays between tasks
        for b in batches:
            parts = [split_url(u) for u in b["url"]]
            hosts, paths = [p[0] for p in parts], [p[1] for p in parts]
            rule, block = held.judge(hosts, paths)
            verdict = [default if x < 0 else "block" if x else "allow" for x in block]
            yield pd.DataFrame({"page_id": b["page_id"], "host": hosts, "path": paths, "rule": pd.Series(rule, dtype=object), "verdict": verdict})

    rows = pages.selectExpr(f"`{key}` as page_id", f"`{url}` as url")
    return rows.mapInPandas(run, "page_id long, host string, path string, rule string, verdict string")
