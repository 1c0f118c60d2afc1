"""A quality classifier: a factorisation machine over hashed words, word shapes, structure statistics and metadata.

score = sigmoid(w0 + sum w_i x_i + 1/2 sum_f [(sum_i v_if x_i)^2 - sum_i v_if^2 x_i^2]): all pairwise interactions, of rank FACTORS,
in time linear in the features that a text has. Features: the share of each hashed word (lower case, without marks at its
ends) and of each hashed word shape, as square roots; statistics of structure (case, marks, digits, lengths, repeats); and the
length of the text and of its column n_chars. Labels, lang, source and doc_id are never inputs.

It is fitted on the driver on FIT_ROWS labelled documents at most, those with the least hashes of doc_id among documents that have a label and whose
crc32 isn't held out, and on FIT_CELLS pairs of numbers of theirs; the bounds are these parameters, and scores cover all rows. Of labelled rows that share a
doc_id the one with the greatest text is learned from. Fitting is seeded and reruns agree.

Defined results: null text is empty and is scored on its statistics; null n_chars counts as 0; rows without a quality label
aren't learned from; with no label at all every score is 0.5; repeated rows have equal scores; other columns are carried unread.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quire.llm.common import cut, fit_sample, held_out, kept, modest_batches, text_of, within_cells

#: Passes over the fitted rows: EPOCHS, or as many as LEAST_STEPS batches take where the rows are few.
FIT_ROWS, FACTORS, EPOCHS, LEAST_STEPS, THRESHOLD = 6000, 8, 10, 600, 0.3
#: Pairs of all fitted rows together; 12 bytes each.
FIT_CELLS = 1 << 23
WORD_SLOTS, SHAPE_SLOTS = 1 << 15, 1 << 11
_REMEMBER = 150_000
_EDGE = "".join(chr(c) for c in range(33, 127) if not chr(c).isalnum())
STATS = ("bias_len", "n_chars", "upper", "marks", "digits", "odd", "space", "word_len", "long_words", "word_repeat", "line_repeat", "line_len", "caps_words", "marks_a_word", "top_word", "lines")
SLOTS = WORD_SLOTS + SHAPE_SLOTS + len(STATS)
_RUNS = [(re.compile("[A-ZÀ-ÖØ-Þ]+"), "A"), (re.compile("[a-zß-öø-ÿ]+"), "a"), (re.compile("[0-9]+"), "0")]
#: Byte classes: other, upper case, lower case, digit, blank, line break, plain stop, mark, first byte of a longer character.
_CLASS = np.zeros(256, "u1")
for _k, _chars in enumerate(("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz", "0123456789", " \t", "\r\n", ".,", "!\"#$%&'()*+-/:;<=>?@[\\]^_`{|}~"), 1):
    _CLASS[[ord(c) for c in _chars]] = _k
_CLASS[0xC0:] = 8


def _shape(word: str) -> str:
    for run, to in _RUNS:
        word = run.sub(to, word)
    return word


class Features:
    def __init__(self):
        #: Slots of words met lately, and of the generation before: the word's, and the shape's above it.
        self.words: dict[str, int] = {}
        self.old: dict[str, int] = {}

    def _word(self, w: str) -> int:
        slot = self.old.get(w)
        if slot is None:
            slot = zlib.crc32(w.strip(_EDGE).lower().encode()) % WORD_SLOTS | zlib.crc32(b"shape" + _shape(w).encode()) % SHAPE_SLOTS << 20
        if len(w) <= 64:
            self.words[w] = slot
        return slot

    def of(self, text: str, n_chars: float) -> tuple[np.ndarray, np.ndarray]:
        """Slots and values."""
        if len(self.words) >= _REMEMBER:
            self.old, self.words = self.words, {}
        words = text.split()
        n, chars = len(words), max(1, len(text))
        get, make = self.words.get, self._word
        both = np.fromiter([make(w) if (s := get(w)) is None else s for w in words], "i8", n)
        ids, counts = np.unique(np.concatenate([both & 0xFFFFF, (both >> 20) + WORD_SLOTS]), return_counts=True)
        lines = [x for x in text.split("\n") if x.strip()]
        _, upper, lower, digits, blanks, _, _, marks, wide = np.bincount(_CLASS[np.frombuffer(text.encode(), "u1")], minlength=9).tolist()
        letters = upper + lower + wide
        shapes = ids >= WORD_SLOTS
        stats = [
            np.log1p(chars) / 10, np.log1p(max(0.0, n_chars)) / 10, upper / max(1, letters), min(1.0, 5 * marks / chars), digits / chars,
            (chars - letters - marks) / chars, blanks / chars, min(3.0, chars / max(1, n) / 8), sum(len(w) > 20 for w in words) / max(1, n), 1 - (~shapes).sum() / max(1, n),
            1 - len(set(lines)) / max(1, len(lines)), min(3.0, chars / max(1, len(lines)) / 200), sum(map(str.isupper, words)) / max(1, n), marks / max(1, n),
            (counts[~shapes].max() if n else 0) / max(1, n), np.log1p(len(lines)) / 10,
        ]
        values = np.sqrt(counts / max(1, n))
        return np.concatenate([ids, np.arange(SLOTS - len(STATS), SLOTS)]), np.concatenate([values, stats]).astype("f4")


class Machine:
    """w0, w and v of the factorisation machine."""

    def __init__(self, slots: int = SLOTS, factors: int = FACTORS, seed: int = 1):
        self.w0, self.w = 0.0, np.zeros(slots, "f4")
        self.v = (np.random.default_rng(seed).standard_normal((slots, factors)) * 0.05).astype("f4")

    @staticmethod
    def _sums(values: np.ndarray, starts: np.ndarray) -> np.ndarray:
        return np.add.reduceat(values, starts, axis=0)

    def margins(self, ids: np.ndarray, x: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        vx = self.v[ids] * x[:, None]
        s = self._sums(vx, starts)
        return self.w0 + self._sums(self.w[ids] * x, starts) + 0.5 * (s**2 - self._sums(vx**2, starts)).sum(axis=1), s

    def scores(self, rows: list[tuple[np.ndarray, np.ndarray]]) -> np.ndarray:
        if not rows:
            return np.zeros(0)
        starts = np.cumsum([0, *(len(i) for i, _ in rows[:-1])])
        m, _ = self.margins(np.concatenate([i for i, _ in rows]), np.concatenate([x for _, x in rows]), starts)
        return 1 / (1 + np.exp(-np.clip(m.astype("f8"), -30, 30)))

    def fit(self, rows: list[tuple[np.ndarray, np.ndarray]], y: np.ndarray, epochs: int = EPOCHS, rate: float = 0.3, decay: float = 1e-5, batch: int = 64, seed: int = 2) -> Machine:
        """AdaGrad on the log loss."""
        if not len(y):
            self.v[:] = 0
            return self
        share = min(max(float(y.mean()), 1e-3), 1 - 1e-3)
        self.w0 = float(np.log(share / (1 - share)))
        g0, gw, gv = 1e-2, np.full(len(self.w), 1e-2, "f4"), np.full(self.v.shape, 1e-2, "f4")
        rng = np.random.default_rng(seed)
        for _ in range(max(epochs, -(-LEAST_STEPS * batch // len(y)))):
            order = rng.permutation(len(y))
            for at in range(0, len(y), batch):
                take = order[at : at + batch]
                lens = np.array([len(rows[i][0]) for i in take])
                starts = np.concatenate([[0], np.cumsum(lens)[:-1]])
                ids, x = np.concatenate([rows[i][0] for i in take]), np.concatenate([rows[i][1] for i in take])
                m, s = self.margins(ids, x, starts)
                err = (1 / (1 + np.exp(-np.clip(m, -30, 30))) - y[take]).astype("f4") / len(take)
                e = np.repeat(err, lens) * x
                slots, back = np.unique(ids, return_inverse=True)
                dw = np.bincount(back, e, len(slots)).astype("f4") + decay * self.w[slots]
                dv = np.zeros((len(slots), self.v.shape[1]), "f4")
                np.add.at(dv, back, e[:, None] * (np.repeat(s, lens, axis=0) - self.v[ids] * x[:, None]))
                dv += decay * self.v[slots]
                d0 = float(err.sum())
                g0 += d0 * d0
                self.w0 -= rate * d0 / g0**0.5
                gw[slots] += dw * dw
                self.w[slots] -= rate * dw / np.sqrt(gw[slots])
                gv[slots] += dv * dv
                self.v[slots] -= 0.5 * rate * dv / np.sqrt(gv[slots])
        return self


def train(docs: DataFrame, labels: DataFrame, fit_rows: int = FIT_ROWS) -> Machine:
    """A machine fitted on at most fit_rows labelled rows that aren't held out."""
    known = labels.where("doc_id is not null and quality is not null").where(~held_out()).groupBy("doc_id").agg(F.min("quality").alias("quality"))
    modest_batches(docs.sparkSession)
    known = cut(known.join(docs.select("doc_id").distinct(), "doc_id", "left_semi"))  # labels of other documents don't count
    some = fit_sample(known.select("doc_id"), fit_rows).join(known, "doc_id")
    rows = docs.select("doc_id", text_of().alias("text"), F.coalesce(F.col("n_chars").cast("double"), F.lit(0.0)).alias("n_chars")).join(F.broadcast(some), "doc_id")  # fit_rows rows at most
    rows = rows.groupBy("doc_id", "turn").agg(F.max(F.struct("text", "n_chars", "quality")).alias("x")).select("doc_id", "turn", "x.*")  # one of each id

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        features = kept("quality", Features)
        for b in batches:
            found = [features.of(t, n) for t, n in zip(b["text"], b["n_chars"], strict=True)]
            yield pd.DataFrame({"doc_id": b["doc_id"], "turn": b["turn"], "quality": b["quality"], "cells": [len(i) for i, _ in found], "ids": [i.astype("i4").tobytes() for i, _ in found], "x": [x.tobytes() for _, x in found]})

    found = within_cells(cut(rows.mapInPandas(run, "doc_id long, turn long, quality int, cells long, ids binary, x binary")), FIT_CELLS, [])
    got = sorted(found.collect(), key=lambda r: r["doc_id"])  # fit_rows rows of FIT_CELLS pairs at most
    return Machine().fit([(np.frombuffer(r["ids"], "i4").astype("i8"), np.frombuffer(r["x"], "f4")) for r in got], np.array([float(r["quality"]) for r in got]))


def scored(docs: DataFrame, machine: Machine, name: str = "score") -> DataFrame:
    """docs with a score column. The machine goes out as one broadcast of fixed size."""
    modest_batches(docs.sparkSession)
    sent = docs.sparkSession.sparkContext.broadcast((machine.w0, machine.w, machine.v))

    def run(columns: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        m, features = Machine(1, 1), kept("quality", Features)
        m.w0, m.w, m.v = sent.value
        for text, n_chars in columns:
            out = []
            for at in range(0, len(text), 256):
                out.append(m.scores([features.of(t, n) for t, n in zip(text.iloc[at : at + 256], n_chars.iloc[at : at + 256], strict=True)]))
            yield pd.Series(np.concatenate(out) if out else np.zeros(0))

    return docs.withColumn(name, _udf(run)(text_of(), F.coalesce(F.col("n_chars").cast("double"), F.lit(0.0))))


def _udf(run):
    run.__annotations__ = {"columns": Iterator[tuple[pd.Series, pd.Series]], "return": Iterator[pd.Series]}
    return F.pandas_udf(run, "double")


def report(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """doc_id, held_out, score, predicted of every row."""
    out = scored(docs.select("doc_id", "text", "n_chars"), train(docs, labels))
    return out.select("doc_id", held_out().alias("held_out"), "score", F.when(F.col("score") >= threshold, 1).otherwise(0).alias("predicted"))


def keep(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """The rows of docs that score at or above the threshold, with their columns."""
    names = docs.columns
    held = docs.select(F.struct(*(F.col(f"`{c}`") for c in names)).alias("row"), "text", "n_chars")
    return scored(held, train(docs, labels), "_score").where(F.col("_score") >= threshold).select("row.*")
