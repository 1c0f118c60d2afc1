"""A toxicity classifier by non-negative positive-unlabelled learning.

What is known for certain are confirmed toxic texts; everything else is unlabelled, and some of it is toxic too. With the class prior p, the risk
of a classifier is p R+(positives) + max(0, R-(unlabelled) - p R-(positives)): what the unlabelled texts cost as negatives, less what the toxic
ones among them are expected to cost. Where that difference falls below zero, the classifier has begun to learn the texts by
heart, and a step goes the other way. Rows that are labelled as not toxic are unlabelled text like any other; the labels give the positives and
the prior (the share of toxic ones among the labelled documents), nothing else.

MEMBERS classifiers (numpy, logistic loss, linear in whether words and words' beginnings occur, and whether they make up a FREQUENT-th of a text's words, all known by 32-bit hashes) are fitted as Spark tasks, each without
a share of the rows; a score is the mean of theirs. A word takes part if it is in more positive texts than its share of the unlabelled ones
explains (EXCESS standard deviations and LEAST_TEXTS texts beyond it), so words of single texts, and groups of copies, which count once, decide
nothing. Each is fitted on FIT_POSITIVES positive and FIT_UNLABELLED unlabelled documents at most, those with the
least hashes of doc_id, and on FIT_CELLS words of theirs; these bounds are the parameters, and scores cover every row and whole texts. Held-out
rows are never fitted on, lang, source and doc_id are never inputs. Fitting is seeded and reruns agree.

Defined results: null text is empty and has the score of a text without words; a null doc_id is not held out, and is not fitted on; of rows that
share a doc_id the one with the greatest text is fitted on; a document that is labelled twice is toxic if any label says so; without
any positive every score is 0; repeated rows have equal scores; other columns are ignored, whatever their names; an
empty table gives an empty result.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quire.llm.common import cut, fit_sample, held_out, kept, modest_batches, text_of, within_cells

FIT_POSITIVES, FIT_UNLABELLED, FIT_CELLS = 3000, 9000, 1 << 22
MEMBERS, STEPS, RATE, DECAY, EXCESS, LEAST_TEXTS, THRESHOLD = 4, 400, 0.1, 1e-2, 4.0, 4, 0.5
#: Lengths of beginnings; what a classifier knows at most, of what is most in excess.
BEGINNINGS, MOST_WORDS = range(3, 8), 1 << 14
#: A word or beginning is frequent in a text if that many times its count are the text's words at least.
FREQUENT = 100
_OFTEN = 0x5BD1E995
_WORD = re.compile(r"[^\W\d_]+")
_REMEMBER = 150_000


def hashed(word: str) -> list[int]:
    """Hashes of a word and of its beginnings."""
    return [zlib.crc32(x.encode("utf-8", "surrogatepass")) for x in (word, *("^" + word[:n] for n in BEGINNINGS if n < len(word)))]


class Features:
    """Hashes of what a text has; wanted: those that matter, all where it isn't given."""

    def __init__(self, wanted: frozenset[int] | None = None):
        self.wanted, self.known = wanted, {}

    def _tell(self, word: str) -> list[int]:
        found, wanted = hashed(word), self.wanted
        return found if wanted is None else [h for h in found if h in wanted or h ^ _OFTEN in wanted]

    def of(self, text: str | None) -> list[int]:
        words = _WORD.findall((text or "").lower())
        times, known = Counter(words), self.known
        if missing := [w for w in times if w not in known]:
            if len(known) + len(missing) > _REMEMBER:
                known.clear()
                missing = list(times)
            for w in missing:
                known[w] = self._tell(w)
        counts: dict[int, int] = {}
        for w, n in times.items():
            for h in known[w]:
                counts[h] = counts.get(h, 0) + n
        found = [*counts, *(h ^ _OFTEN for h, n in counts.items() if n * FREQUENT >= len(words))]
        return found if self.wanted is None else [h for h in found if h in self.wanted]


def _apart(rows: list[np.ndarray]) -> list[int]:
    """Places of the rows, the first only of those that are alike in two sampled words: copies count once."""
    seen: dict[tuple, int] = {}
    for k, r in enumerate(rows):
        mixed = r * np.uint32(0x9E3779B1)
        seen.setdefault((int(mixed.min()), int((mixed ^ (mixed >> np.uint32(15))).max())) if len(r) else (), k)
    return sorted(seen.values())


def _sums(weights: np.ndarray, at: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """The sum of the weights of each row's places, which lie one row after another."""
    upto = np.concatenate([[0.0], np.cumsum(weights[at])])
    ends = np.cumsum(sizes)
    return upto[ends] - upto[ends - sizes]


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


def risk(margin_p: np.ndarray, margin_u: np.ndarray, prior: float) -> tuple[float, float]:
    """The positive part of the risk, and the corrected negative part, which falls below zero where texts are learned by heart."""
    loss = lambda m: float(np.logaddexp(0, -m).mean())
    return prior * loss(margin_p), loss(-margin_u) - prior * loss(-margin_p)


def telling(positive: list[np.ndarray], unlabelled: list[np.ndarray]) -> np.ndarray:
    """Hashes of what takes part, sorted."""
    words, in_p = np.unique(np.concatenate(positive), return_counts=True)
    words, in_p = words[in_p >= LEAST_TEXTS], in_p[in_p >= LEAST_TEXTS]
    flat = np.concatenate(unlabelled)
    flat = flat[np.isin(flat, words)]
    expected = np.bincount(np.searchsorted(words, flat), minlength=len(words)) * len(positive) / max(1, len(unlabelled))
    excess = in_p - expected - EXCESS * np.sqrt(expected) - LEAST_TEXTS
    best = np.argsort(-excess, kind="stable")[:MOST_WORDS]
    return np.sort(words[best[excess[best] >= 0]])


def fit(positive: list[np.ndarray], unlabelled: list[np.ndarray], prior: float, steps: int = STEPS, rate: float = RATE, decay: float = DECAY) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of words, and their weights with the bias at the end; by Adam over whole passes."""
    positive, unlabelled = [positive[k] for k in _apart(positive)], [unlabelled[k] for k in _apart(unlabelled)]
    words = telling(positive, unlabelled)
    sides = []
    for rows in (positive, unlabelled):
        flat, whose = np.concatenate(rows), np.repeat(np.arange(len(rows)), [len(r) for r in rows])
        own = np.isin(flat, words)
        sides.append((np.searchsorted(words, flat[own]), np.bincount(whose[own], minlength=len(rows))))
    (at_p, size_p), (at_u, size_u) = sides
    x = np.zeros(len(words) + 1)  # the words, the bias
    x[-1] = np.log(prior / (1 - prior))
    first, second = np.zeros(len(x)), np.zeros(len(x))
    for step in range(1, steps + 1):
        margin_p, margin_u = _sums(x, at_p, size_p) + x[-1], _sums(x, at_u, size_u) + x[-1]
        _, negative = risk(margin_p, margin_u, prior)
        by_u, by_p = _sigmoid(margin_u) / len(margin_u), -prior * _sigmoid(margin_p) / len(margin_p)  # slopes of the negative part by margin
        if negative >= 0:
            by_p = by_p - prior * _sigmoid(-margin_p) / len(margin_p)
        else:
            by_u, by_p = -by_u, -by_p
        slope = np.bincount(at_p, np.repeat(by_p, size_p), len(x)) + np.bincount(at_u, np.repeat(by_u, size_u), len(x))
        slope = slope.astype("f8")  # whole numbers, where nothing takes part
        slope[-1] = by_p.sum() + by_u.sum()
        slope[:-1] += decay * prior * x[:-1]
        first, second = 0.9 * first + 0.1 * slope, 0.999 * second + 0.001 * slope**2
        x -= rate * (first / (1 - 0.9**step)) / (np.sqrt(second / (1 - 0.999**step)) + 1e-8)
    return words, x


def train(docs: DataFrame, labels: DataFrame, prior: float | None = None) -> list[tuple[np.ndarray, np.ndarray]]:
    """(hashes, weights and bias) of MEMBERS classifiers; none without positives. prior: by the labels where it isn't given."""
    modest_batches(docs.sparkSession)
    known = labels.where("doc_id is not null and toxic is not null").where(~held_out()).groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    ids = docs.where("doc_id is not null").where(~held_out()).select("doc_id").distinct()
    told = cut(known.join(ids, "doc_id", "left_semi"))
    total, toxic = told.agg(F.count("*"), F.coalesce(F.sum((F.col("toxic") > 0).cast("int")), F.lit(0))).first()
    if not toxic:
        return []
    share = min(max(prior if prior is not None else toxic / total, 1e-3), 0.5)
    some = fit_sample(told.where("toxic > 0").select("doc_id"), FIT_POSITIVES, 1).withColumn("positive", F.lit(True))
    some = some.unionByName(fit_sample(ids, FIT_UNLABELLED, 2).withColumn("positive", F.lit(False)))
    texts = docs.select("doc_id", text_of().alias("text")).join(F.broadcast(some.select("doc_id").distinct()), "doc_id")  # both bounds together at most
    texts = texts.groupBy("doc_id").agg(F.max("text").alias("text"))

    def words(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        features = kept("toxicity", Features)
        for b in batches:
            found = [np.unique(np.array(features.of(t), "u4")) for t in b["text"]]
            yield pd.DataFrame({"doc_id": b["doc_id"], "cells": [len(x) for x in found], "words": [x.tobytes() for x in found]})

    rows = some.join(texts.mapInPandas(words, "doc_id long, cells long, words binary"), "doc_id")
    rows = cut(within_cells(rows, FIT_CELLS, ["positive"]))

    def member(key: tuple[int], rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values(["positive", "doc_id"])
        sets = [np.frombuffer(x, "u4") for x in rows["words"]]
        is_p = rows["positive"].to_numpy()
        words, weights = fit([x for x, p in zip(sets, is_p, strict=True) if p], [x for x, p in zip(sets, is_p, strict=True) if not p], share)
        return pd.DataFrame({"member": [key[0]], "words": [words.astype("u4").tobytes()], "weights": [weights.tobytes()]})

    members = F.explode(F.sequence(F.lit(0), F.lit(MEMBERS - 1))).alias("member")
    # a member leaves a share of the rows out, if that leaves it enough of both kinds
    out = F.pmod(F.xxhash64("doc_id", F.lit(3)), F.lit(MEMBERS)) == F.col("member")
    dealt = rows.select("doc_id", "positive", "words", members).where(~out | F.lit(toxic < 50 * MEMBERS))
    got = sorted(dealt.groupBy("member").applyInPandas(member, "member int, words binary, weights binary").collect(), key=lambda r: r["member"])  # MEMBERS rows
    return [(np.frombuffer(r["words"], "u4"), np.frombuffer(r["weights"], "f8")) for r in got]


def scored(docs: DataFrame, models: list[tuple[np.ndarray, np.ndarray]], name: str = "score") -> DataFrame:
    """docs with a score column; the models go out as one broadcast of MEMBERS times MOST_WORDS words at most."""
    modest_batches(docs.sparkSession)
    hashes = np.unique(np.concatenate([m[0] for m in models])) if models else np.zeros(0, "u4")
    table = np.zeros((len(hashes) + 1, max(1, len(models))))  # the last row is nothing's
    for k, (words, weights) in enumerate(models):
        table[np.searchsorted(hashes, words), k] = weights[:-1]
    sent = docs.sparkSession.sparkContext.broadcast((hashes, table, np.array([m[1][-1] for m in models])))

    def run(columns: Iterator[pd.Series]) -> Iterator[pd.Series]:
        hashes, table, bias = sent.value
        place = {h: k for k, h in enumerate(hashes.tolist())}
        features = Features(frozenset(place))
        for texts in columns:
            if not len(bias):
                yield pd.Series(np.zeros(len(texts)))
                continue
            yield pd.Series([float(_sigmoid(table[[*(place[h] for h in features.of(t)), len(place)]].sum(axis=0) + bias).mean()) for t in texts], dtype="f8")

    run.__annotations__ = {"columns": Iterator[pd.Series], "return": Iterator[pd.Series]}
    return docs.withColumn(name, F.pandas_udf(run, "double")(text_of()))


def report(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """doc_id, held_out, score, predicted of every row."""
    out = scored(docs.select("doc_id", "text"), train(docs, labels))
    return out.select("doc_id", F.coalesce(held_out(), F.lit(False)).alias("held_out"), "score", F.when(F.col("score") >= threshold, 1).otherwise(0).alias("predicted"))
