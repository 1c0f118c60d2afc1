"""Token counts by heap-and-linked-list byte-pair merging.

A word's byte symbols form a linked list; a heap holds its adjacent pairs that have a merge, by rank and then position. The
lowest is popped again and again and merged, and entries that an earlier merge made stale are passed over. The count is the
number of symbols at the start less the number of merges; no identifiers are made. Words are counted once and remembered in a
table of bounded size that a Python worker keeps between tasks, so a text costs a lookup a word. A word of n bytes costs O(n log n).

The tokenizer file is read for its merges, its added tokens and its word-end suffix; the normaliser (NFC, white space to one
space, lower case by character) and the split pattern are those the file names, and a file with others is refused.

Defined results: null text is empty and has 0 tokens; an added token's string inside a text counts one token; very long words
and texts are counted whole; repeated rows each get their row; other columns are ignored.
"""

from __future__ import annotations

import heapq
import json
import re
import unicodedata
from collections.abc import Iterator

import pyarrow as pa
import regex
from pyspark.sql import DataFrame

from quire.llm.common import kept, modest_batches

#: Words remembered, in each of two generations; a text may add its own beyond that.
REMEMBER = 400_000
_SCHEMA = "doc_id long, n_bytes long, n_tokens long, over_limit boolean"
#: White space as Unicode has it; Python's also takes U+001C to U+001F.
_ODD_SPACE = re.compile("[\x1c-\x1f]")
_SPACE = re.compile("[\t-\r \x85\xa0  -     　]+")


def byte_symbols() -> list[str]:
    """The printable symbol of each byte, by the public byte-level rule: printable Latin-1 characters stand for themselves, the rest follow from U+0100 on."""
    own = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b <= 255]
    rest = iter(range(256, 512))
    return [chr(b) if b in own else chr(next(rest)) for b in range(256)]


def merge_count(symbols: list[int], ranks: dict[tuple[int, int], tuple[int, int]]) -> int:
    """The number of merges that byte-pair encoding makes in symbols. ranks: pair -> (rank, merged symbol)."""
    n = len(symbols)
    sym, left, right = list(symbols), list(range(-1, n - 1)), [*range(1, n), -1]
    heap = [(*ranks[p], i) for i, p in enumerate(zip(sym, sym[1:])) if p in ranks]
    heap = [(rank, i, merged) for rank, merged, i in heap]
    heapq.heapify(heap)
    merges = 0
    while heap:
        rank, i, merged = heapq.heappop(heap)
        j = right[i] if sym[i] >= 0 else -1
        if j < 0 or (now := ranks.get((sym[i], sym[j]))) is None or now[0] != rank:
            continue
        sym[i], sym[j] = merged, -1
        merges += 1
        right[i] = k = right[j]
        if k >= 0:
            left[k] = i
            if (sym[i], sym[k]) in ranks:
                r, m = ranks[sym[i], sym[k]]
                heapq.heappush(heap, (r, i, m))
        h = left[i]
        if h >= 0 and (sym[h], sym[i]) in ranks:
            r, m = ranks[sym[h], sym[i]]
            heapq.heappush(heap, (r, h, m))
    return merges


class Counter:
    """Counts of the tokens of texts, for one tokenizer file of the word kind."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            held = json.load(f)
        kinds = [x["type"] for x in (held["normalizer"] or {}).get("normalizers", [])]
        split = held["pre_tokenizer"]["pretokenizers"]
        model = held["model"]
        flags = [model.get(k) for k in ("dropout", "unk_token", "continuing_subword_prefix", "fuse_unk", "byte_fallback", "ignore_merges")]
        flags += [x[k] for x in held["added_tokens"] for k in ("single_word", "lstrip", "rstrip", "normalized")] + [split[-1]["use_regex"], split[-1]["add_prefix_space"]]
        if kinds != ["NFC", "Replace", "Lowercase"] or [x["type"] for x in split] != ["Split", "ByteLevel"] or not split[0]["invert"] or any(flags):
            raise ValueError(f"{path}: another kind of tokenizer than this counter knows")
        self.pattern = regex.compile(split[0]["pattern"]["Regex"])
        suffix = model["end_of_word_suffix"] or ""
        vocab = model["vocab"]
        merges = [tuple(m) if isinstance(m, list) else tuple(m.split(" ")) for m in model["merges"]]
        self.ranks = {(vocab[a], vocab[b]): (i, vocab[a + b]) for i, (a, b) in enumerate(merges)}
        self.plain = [vocab[s] for s in byte_symbols()]
        self.last = [vocab[s + suffix] for s in byte_symbols()]
        added = [re.escape(x["content"]) for x in held["added_tokens"]]
        self.added = re.compile("|".join(added)) if added else None
        #: Words met lately, and those of the generation before.
        self.words: dict[str, int] = {}
        self.old: dict[str, int] = {}

    def word(self, text: str) -> int:
        """Tokens of a text without white space (or of any text, for that matter)."""
        text = unicodedata.normalize("NFC", text)
        text = text.lower() if text.isascii() else "".join(c.lower() for c in text)
        total = 0
        for piece in self.pattern.findall(text):
            raw = piece.encode()
            symbols = [self.plain[b] for b in raw]
            symbols[-1] = self.last[raw[-1]]
            total += len(symbols) - merge_count(symbols, self.ranks)
        return total

    def _plain(self, text: str) -> int:
        if len(self.words) >= REMEMBER:
            self.old, self.words = self.words, {}
        words, old = self.words, self.old
        total = 0
        for w in _SPACE.split(text) if _ODD_SPACE.search(text) else text.split():
            n = words.get(w)
            if n is None:
                n = old.get(w)
                if n is None:
                    n = self.word(w)
                if len(w) <= 64:
                    words[w] = n
            total += n
        return total

    def count(self, text: str) -> int:
        if self.added is None or not self.added.search(text):
            return self._plain(text)
        parts = self.added.split(text)
        return len(parts) - 1 + sum(map(self._plain, parts))


def count(docs: DataFrame, path: str, limit: int = 2048) -> DataFrame:
    """doc_id, n_bytes, n_tokens, over_limit of every row. path: the tokenizer file, at the same place on every machine."""

    modest_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter = kept(("tokens", path), lambda: Counter(path))
        for b in batches:
            texts = [t or "" for t in b.column("text").to_pylist()]
            n = [counter.count(t) for t in texts]
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array([len(t.encode()) for t in texts], pa.int64()), pa.array(n, pa.int64()), pa.array([x > limit for x in n], pa.bool_())], ["doc_id", "n_bytes", "n_tokens", "over_limit"])

    return docs.select("doc_id", "text").mapInArrow(run, _SCHEMA)
