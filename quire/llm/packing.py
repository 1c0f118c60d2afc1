"""Hierarchical multi-length packing.

Context windows come in tiers (128, 256, 512, 1024 tokens). Each document's full longest windows are cut off first; what is left
goes to the shortest tier that holds it. A tier is packed by opening a window with its own pieces and filling the gap with
pieces of shorter tiers, the longest that fit first and, where none fits, by cutting one so that the window ends full.
What a task has left at its end is cut into windows of powers of two. So no window is padded at all.

Packing needs no exchange: each task packs its own rows, keeps at most POOL pieces, and numbers its windows within its own
range, so a lost task is repeated alone and the number of windows that end short of the longest tier grows with tasks.

Step groups hold STEP_WINDOWS windows' worth of tokens each, to the token: windows are powers of two, so those of one tier fill a group
exactly. What is left open in the tiers when a task ends is put together, the longest windows first, so that one group of a task at most holds less.

Ids are those of the tokenizers library for the tokenizer's file. Where the rank file of the same vocabulary is given, texts that
consist of plain characters (ASCII, Latin letters, common marks) and hold no added token's string are encoded from the ranks, which
gives the same ids several times faster; the tests hold both against each other over all these characters.

Defined results: null text is empty, and such a document is its closing id alone; repeated rows are packed as often as they
occur; very long documents span windows; other columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

import base64
import os
import re
import zlib
from collections import deque
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame

from quire.llm.common import kept, modest_batches

TIERS = (128, 256, 512, 1024)
#: Pieces that a task holds back before it packs them.
POOL = 4096
#: Windows of the longest tier whose tokens make a step group.
STEP_WINDOWS = 64
#: Fixed value: the byte-level vocabulary's pattern.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
_UNUSUAL = re.compile("[^\t\n\r\x20-\x7e\xa0-\u024f\u2010-\u2027\u20ac]")
_NAMES = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset", "tier", "step_group"]


class Encoder:
    """Ids of whole texts, as little-endian unsigned 32-bit bytes. ranks: the rank file of the same byte-level vocabulary, or None."""

    def __init__(self, path: str, ranks: str | None = None):
        from tokenizers import Tokenizer

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        self.tokenizer = Tokenizer.from_file(path)
        self.added = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.plain = None
        if ranks:
            import tiktoken

            with open(ranks, "rb") as f:
                merges = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, f)}
            self.plain = tiktoken.Encoding("ranks", pat_str=PATTERN, mergeable_ranks=merges, special_tokens={})

    def encode_many(self, texts: list[str]) -> list[bytes]:
        """By the rank file where a text has plain characters only and no added token's string; else by the tokenizers library."""
        fast = [self.plain is not None and not _UNUSUAL.search(t) and not any(a in t for a in self.added) for t in texts]
        rest = iter(self.tokenizer.encode_batch_fast([t for t, ok in zip(texts, fast, strict=True) if not ok], add_special_tokens=False))
        return [np.array(self.plain.encode_ordinary(t) if ok else next(rest).ids, "<u4").tobytes() for t, ok in zip(texts, fast, strict=True)]


class Packer:
    """Packs pieces (doc_id, start, ids, doc_tokens) of one task. first: where its window and group numbers begin. A group of windows in
    each tier waits until it is full, so a task holds that many besides its pools.
    """

    def __init__(self, first: int, tiers: tuple[int, ...] = TIERS):
        self.tiers, self.next, self.group = tiers, first, first
        self.pools: dict[int, deque] = {t: deque() for t in tiers}
        self.held = 0
        self.out: list[tuple] = []
        #: Windows of each tier that wait for their group to be full, and their tokens.
        self.open: dict[int, tuple[list[list[tuple]], int]] = {t: ([], 0) for t in tiers}

    def _tier(self, n: int) -> int:
        return next(t for t in self.tiers if n <= t)

    def _emit(self, pieces: list[tuple], tier: int) -> None:
        windows, tokens = self.open[tier]
        windows.append(pieces)
        tokens += sum(len(p[2]) for p in pieces)
        if tokens >= STEP_WINDOWS * self.tiers[-1]:
            self._close([(w, tier) for w in windows])
            windows, tokens = [], 0
        self.open[tier] = (windows, tokens)

    def _close(self, windows: list[tuple[list[tuple], int]]) -> None:
        for pieces, tier in windows:
            offset = 0
            for doc, start, ids, whole in pieces:
                self.out.append((doc, start, len(ids), zlib.crc32(ids.tobytes()), whole, self.next, offset, tier, self.group))
                offset += len(ids)
            self.next += 1
        self.group += 1

    def finish(self) -> None:
        """Packs what is left and puts the open groups together, the longest windows first: powers of two fill a group to the token."""
        self.pack(last=True)
        left = [(w, t) for t, (windows, _) in self.open.items() for w in windows]
        left.sort(key=lambda x: -sum(len(p[2]) for p in x[0]))
        group: list = []
        tokens, most = 0, STEP_WINDOWS * self.tiers[-1]
        for w in left:
            n = sum(len(p[2]) for p in w[0])
            if tokens + n > most:
                self._close(group)
                group, tokens = [], 0
            group.append(w)
            tokens += n
        if group:
            self._close(group)
        self.open = {t: ([], 0) for t in self.tiers}

    def add(self, doc: int | None, raw: bytes) -> None:
        ids = np.frombuffer(raw, "<u4")
        most, n = self.tiers[-1], len(ids)
        for start in range(0, n - most + 1, most):
            self._emit([(doc, start, ids[start : start + most], n)], most)
        if rest := n % most:
            self.pools[self._tier(rest)].append((doc, n - rest, ids[n - rest :].copy(), n))
            self.held += 1
            if self.held >= POOL:
                self.pack()

    def _take(self, gap: int, below: int) -> tuple | None:
        """A piece for a gap: whole from the longest tier that must fit, else cut to fit."""
        for t in reversed([t for t in self.tiers if t <= min(gap, below)]):
            if self.pools[t]:
                self.held -= 1
                return self.pools[t].popleft()
        for t in self.tiers:
            if t <= below and self.pools[t]:
                doc, start, ids, whole = self.pools[t].popleft()
                self.held -= 1
                if len(ids) > gap:
                    rest = (doc, start + gap, ids[gap:], whole)
                    self.pools[self._tier(len(rest[2]))].appendleft(rest)
                    self.held += 1
                    ids = ids[:gap]
                return doc, start, ids, whole
        return None

    def pack(self, last: bool = False) -> None:
        """Packs the tiers from the longest down. A window that the pools can't fill goes back to them, or, at the end, is cut up."""
        for tier in reversed(self.tiers):
            while self.pools[tier]:
                window = [self.pools[tier].popleft()]
                self.held -= 1
                gap = tier - len(window[0][2])
                while gap and (piece := self._take(gap, tier)):
                    window.append(piece)
                    gap -= len(piece[2])
                if not gap:
                    self._emit(window, tier)
                elif last:
                    self._cut_up(window)
                else:
                    for p in reversed(window):
                        self.pools[self._tier(len(p[2]))].appendleft(p)
                        self.held += 1
                    return
        return

    def _cut_up(self, pieces: list[tuple]) -> None:
        """Windows of powers of two, the longest first, from what is left."""
        total = sum(len(p[2]) for p in pieces)
        todo = deque(pieces)
        for bit in reversed(range(total.bit_length())):
            room, window = total & (1 << bit), []
            while room:
                doc, start, ids, whole = todo.popleft()
                if len(ids) > room:
                    todo.appendleft((doc, start + room, ids[room:], whole))
                    ids = ids[:room]
                window.append((doc, start, ids, whole))
                room -= len(ids)
            if window:
                self._emit(window, self._tier(1 << bit))

    def drain(self) -> pa.RecordBatch:
        rows, self.out = self.out, []
        cols = list(zip(*rows, strict=True)) if rows else [()] * len(_NAMES)
        return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in cols], _NAMES)


def pack(docs: DataFrame, path: str, ranks: str | None = None, close_id: int = 0) -> DataFrame:
    """A row per piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset, tier, step_group. path, ranks: the
    tokenizer's file and the rank file of its vocabulary, at the same place on every machine.
    """
    modest_batches(docs.sparkSession)
    closing = np.array([close_id], "<u4").tobytes()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, packer = kept(("packing", path, ranks), lambda: Encoder(path, ranks)), Packer(TaskContext.get().partitionId() << 40)
        for b in batches:
            for at in range(0, b.num_rows, 256):
                part = b.slice(at, 256)
                for doc, ids in zip(part.column("doc_id").to_pylist(), encoder.encode_many([t or "" for t in part.column("text").to_pylist()]), strict=True):
                    packer.add(doc, ids + closing)
            if packer.out:
                yield packer.drain()
        packer.finish()
        if packer.out:
            yield packer.drain()

    return docs.select("doc_id", "text").mapInArrow(run, ", ".join(f"`{n}` long" for n in _NAMES))
