"""Spelling variants of words by bands of letter parities.

A word's mask has a bit a letter: whether the letter occurs an odd number of times. One inserted or deleted code point flips one bit, one
replaced code point two (none, if both letters share a bit). So the masks of two near words differ in two bits at most, and of three bands
of the bits one at least is equal. Words with an equal band meet in a bucket; there, of the pairs whose lengths differ by one at
most and whose masks by as many bits as one edit flips, the code points decide. The letters are dealt to the bands by how evenly they split
the words, so each band has its share of what tells words apart.

A bucket of more than LIMIT words, or of more than LIMIT_CHARS code points, is split again. First by halves: one edit leaves the first half
or the last half of the shorter word as it is, so its words are dealt by either, for both lengths that they can be near. What is still large
is split by bands of the other bits: its words agree in a band, so the two bits lie in the others, and of three bands of those one is
equal again. That goes on until buckets are small; it is exact at every depth, drops no pair, and counts each pair in one bucket only (that
of the first equal band, and of the first halves if those are equal). Where two bits are left (some eleven depths down) a bucket is compared
whatever its size: its words have four masks between them.

Large buckets are found by partial counts and split where their rows lie; only rows of small buckets gather. What leaves a bucket is a row
a word (its near words' number and the best one), never pairs. Memory: some buckets of CHUNK rows together; pairs go by blocks.

Defined results: null and empty texts have no words; a null doc_id reads as an empty string in what `runs` hands on; repeated rows count as
often as they occur; of near words with equal n the one smallest in code-point order counts; words that differ in case of letters
outside A-Z are different words; other columns are ignored, whatever their names; empty tables give empty results.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quire.llm.common import cut, gather, sized, small_side, text_of

#: Fixed value: the letters of a word.
LETTERS = r"[A-Za-zÀ-ÿ]"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
LEAST, OCCURRENCES, RATIO = 7, 2, 10
#: Bits of a mask; words, and code points, of a bucket that is compared as it is; rows of buckets that are compared together; pairs of a block.
BITS, LIMIT, LIMIT_CHARS, CHUNK, BLOCK = 126, 1024, 1 << 20, 8192, 1 << 20


def runs(docs: DataFrame, least: int = LEAST) -> DataFrame:
    """id (doc_id as text) and run of every maximal run of at least so many letters, A-Z in lower case; a row each time that it occurs."""
    # a match of {least,} begins where its run begins, as any shorter beginning leaves nothing to match before it
    found = F.regexp_extract_all(text_of(), F.lit(f"{LETTERS}{{{least},}}"), F.lit(0))
    rows = docs.select(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).alias("id"), F.explode(found).alias("run"))
    return rows.select("id", F.translate("run", UPPER, LOWER).alias("run"))


def counted(words: DataFrame, least: int = LEAST, occurrences: int = OCCURRENCES) -> DataFrame:
    """word, n of the distinct words that are long and frequent enough."""
    return words.where(F.length("word") >= least).groupBy("word").agg(F.count("*").alias("n")).where(F.col("n") >= occurrences)


# masks and bands


def _codes(words: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Code points of all words, one after another, and the words' lengths."""
    raw = "".join(words).encode("utf-32-le", "surrogatepass")
    return np.frombuffer(raw, "<u4"), np.array([len(w) for w in words], "i8")


def _letters(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of each code point the words that have it an odd number of times."""
    for b in batches:
        if b.num_rows:
            codes, lengths = _codes(b.column("word").to_pylist())
            both, n = np.unique(np.repeat(np.arange(len(lengths), dtype="u8"), lengths) << np.uint64(32) | codes, return_counts=True)
            letters, odd = np.unique((both & np.uint64(0xFFFFFFFF)).astype("i4"), return_inverse=True)
            yield pa.RecordBatch.from_arrays([pa.array(letters), pa.array(np.bincount(odd, n & 1, len(letters)).astype("i8"))], ["letter", "odd"])


class Alphabet:
    """The bit of each letter. Bits are numbered by how evenly their letters split the words; letters beyond the BITS first share bits."""

    def __init__(self, letters: list[int], shared: bool):
        self.letters = np.array(sorted(letters), "u4")
        rank = {c: k for k, c in enumerate(letters)}
        self.bits = np.array([rank[c] for c in self.letters.tolist()], "i8")
        self.shared = shared

    def masks(self, codes: np.ndarray, lengths: np.ndarray) -> np.ndarray:
        """words x 2 halves of 63 bits."""
        at = np.minimum(np.searchsorted(self.letters, codes), max(0, len(self.letters) - 1))
        own = self.letters[at] == codes
        bit = np.where(own, self.bits[at], codes % BITS)
        whose = np.repeat(np.arange(len(lengths)), lengths)
        odd = (np.bincount(whose * BITS + bit, minlength=len(lengths) * BITS) & 1).astype("u8").reshape(-1, 2, BITS // 2)
        return (odd << np.arange(BITS // 2, dtype="u8")).sum(axis=2, dtype="u8")


def alphabet(words: DataFrame) -> Alphabet:
    """From one pass over the words; BITS rows reach the driver."""
    found = words.select("word").mapInArrow(_letters, "letter int, odd long").groupBy("letter").agg(F.sum("odd").alias("odd"))
    total = words.count()
    rows = found.orderBy(F.abs(F.col("odd") / F.lit(max(1, total)) - 0.5), "letter").limit(BITS + 1).collect()
    return Alphabet([r["letter"] for r in rows[:BITS]], len(rows) > BITS)


def _mask(bits: list[int]) -> np.ndarray:
    half = BITS // 2
    return np.array([sum(1 << b for b in bits if b < half), sum(1 << b - half for b in bits if b >= half)], "u8")


@cache
def _bands(path: str) -> list[list[np.ndarray]]:
    """The masks of the three bands at each depth of a path, and of those below its end. A path is a band (0 to 2) a depth; p or s (first or
    last halves) stand for no bits.
    """
    rest, out = list(range(BITS)), []
    for step in [*map(int, re.sub("[ps]", "", path)), None]:
        out.append([_mask(rest[k::3]) for k in range(3)])
        if step is not None:
            rest = [b for i, b in enumerate(rest) if i % 3 != step]
    return out


@cache
def _ends(path: str) -> bool:
    """Whether a path has too few bits left to split by."""
    return sum(int(np.bitwise_count(m).sum()) for m in _bands(path)[-1]) < 3


def _mix(x: np.ndarray) -> np.ndarray:
    x = x * np.uint64(0x9E3779B97F4A7C15)
    x ^= x >> np.uint64(29)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    return x ^ (x >> np.uint64(32))


_DEALT = "bucket long, path string, ends boolean, short int, word string, n long"


def _rows(part: pa.RecordBatch, bucket: np.ndarray, path: str, short: np.ndarray) -> pa.RecordBatch:
    size = part.num_rows
    return pa.RecordBatch.from_arrays([pa.array(bucket.astype("i8")), pa.array([path] * size), pa.array([_ends(path)] * size), pa.array(short.astype("i4")), part.column("word"), part.column("n")], ["bucket", "path", "ends", "short", "word", "n"])


def _halves(words: list[str], lengths: np.ndarray, short: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the first and the last halves of words, which of a word of length short are its whole."""
    first = np.array([xxhash.xxh64_intdigest(w[: n // 2].encode("utf-8", "surrogatepass")) for w, n in zip(words, short.tolist(), strict=True)], "u8")
    last = np.array([xxhash.xxh64_intdigest(w[len(w) - n + n // 2 :].encode("utf-8", "surrogatepass")) for w, n in zip(words, short.tolist(), strict=True)], "u8")
    return first, last


def _dealer(letters: Alphabet):
    """Rows for the buckets below each row's path. short: the length of the shorter word of the pairs that a bucket answers for; 0 before words
    are dealt by halves.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if not b.num_rows:
                continue
            words = b.column("word").to_pylist()
            codes, lengths = _codes(words)
            masks, path = letters.masks(codes, lengths), np.array(b.column("path").to_pylist(), object)
            bucket, short = b.column("bucket").to_numpy().astype("u8"), b.column("short").to_numpy()
            for p in np.unique(path).tolist():
                at = np.flatnonzero(path == p)
                part = b.take(pa.array(at))
                if len(p) == 1:
                    for longer in (0, 1):
                        n = lengths[at] - longer
                        for side, half in zip("ps", _halves([words[i] for i in at], lengths[at], n), strict=True):
                            yield _rows(part, _mix(bucket[at] ^ _mix(half ^ (n.astype("u8") << np.uint64(1)) ^ np.uint64(side == "s"))), p + side, n)
                    continue
                for k, band in enumerate(_bands(p)[-1]):
                    seen = masks[at] & band
                    yield _rows(part, _mix(_mix(_mix(bucket[at] + np.uint64(k + 1)) ^ seen[:, 0]) ^ seen[:, 1]), f"{p}{k}", short[at])

    return run


# buckets


def _chunks(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.Table, np.ndarray]]:
    """Whole buckets (rows of one bucket and path), CHUNK rows together or one larger bucket, and the bucket's number of each row; from
    batches sorted by bucket and path.
    """

    def numbered(t: pa.Table) -> np.ndarray:
        bucket, path = t.column("bucket").to_numpy(), t.column("path").combine_chunks().dictionary_encode()
        code = (path.combine_chunks() if isinstance(path, pa.ChunkedArray) else path).indices.to_numpy()
        return np.cumsum(np.concatenate([[0], (bucket[1:] != bucket[:-1]) | (code[1:] != code[:-1])]))

    held: list[pa.RecordBatch] = []
    rows = 0
    for b in batches:
        held.append(b)
        rows += b.num_rows
        if rows >= CHUNK:
            t = pa.Table.from_batches(held)
            number = numbered(t)
            whole = int(np.searchsorted(number, number[-1]))
            if whole:
                yield t.slice(0, whole), number[:whole]
                held = t.slice(whole).to_batches()
                rows -= whole
    if rows:
        t = pa.Table.from_batches(held)
        yield t, numbered(t)


def _one_edit(short: np.ndarray, long: np.ndarray) -> np.ndarray:
    """Rows of code points of equal length, or one longer: whether exactly one is replaced, or inserted."""
    n = short.shape[1]
    ahead = short == long[:, :n]
    if long.shape[1] == n:
        return n - ahead.sum(axis=1) == 1
    behind = short == long[:, 1:]
    begins = np.where(ahead.all(axis=1), n, ahead.argmin(axis=1))
    ends = np.where(behind.all(axis=1), n, behind[:, ::-1].argmin(axis=1))
    return begins + ends >= n


def _answers(path: str, xor: np.ndarray) -> np.ndarray:
    """Whether a pair whose masks differ so is counted at this path: each of its bands is the first of its depth that is equal."""
    out = np.ones(len(xor), bool)
    for step, level in zip(re.sub("[ps]", "", path), _bands(path), strict=False):
        for k in range(int(step) + 1):
            out &= ((xor & level[k]) != 0).any(axis=1) != (k == int(step))
    return out


def near_pairs(words: list[str], number: np.ndarray, path: np.ndarray, short: np.ndarray, letters: Alphabet) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Places (a, b) in words of the near pairs that their buckets answer for. number: of each word's bucket, rising."""
    codes, lengths = _codes(words)
    starts, masks = np.cumsum(lengths) - lengths, letters.masks(codes, lengths)
    order = np.lexsort([lengths, number])
    wide = int(lengths.max(initial=0)) + 2
    key = number[order] * wide + lengths[order]
    count = np.searchsorted(key, key + 1, "right") - np.arange(len(key)) - 1
    count[(short[order] > 0) & (lengths[order] != short[order])] = 0
    upto = np.concatenate([[0], np.cumsum(count)])
    lo = 0
    while lo < len(order):
        hi = max(lo + 1, int(np.searchsorted(upto, upto[lo] + BLOCK, "right")) - 1)
        times = count[lo:hi]
        a = np.repeat(np.arange(lo, hi), times)
        b = a + 1 + np.arange(times.sum()) - np.repeat(np.cumsum(times) - times, times)
        lo, a, b = hi, order[a], order[b]
        xor, longer = masks[a] ^ masks[b], lengths[b] != lengths[a]
        flips = np.bitwise_count(xor).sum(axis=1)
        some = (flips == 2 - longer) | (letters.shared & ~longer & (flips == 0))
        a, b, xor = a[some], b[some], xor[some]
        here = np.zeros(len(a), bool)
        for p in np.unique(path[a]).tolist():
            at = path[a] == p
            here[at] = _answers(p, xor[at])
        a, b = a[here], b[here]
        n = lengths[a]
        kinds = 2 * n + lengths[b] - n
        for kind in np.unique(kinds).tolist():
            size, more = divmod(kind, 2)
            x, y = a[kinds == kind], b[kinds == kind]
            step = max(1, (1 << 22) // (size + 1))  # so many code points are looked at together
            for at in range(0, len(x), step):
                i, j = x[at : at + step], y[at : at + step]
                one, two = codes[starts[i][:, None] + np.arange(size)], codes[starts[j][:, None] + np.arange(size + more)]
                ok = _one_edit(one, two)
                # dealt by halves: a pair counts with its first halves if these are equal
                first = (one[:, : size // 2] == two[:, : size // 2]).all(axis=1)
                side = np.array([p[1:2] for p in path[i].tolist()], "U1")
                ok &= (side == "") | ((side == "p") == first)
                if ok.any():
                    yield i[ok], j[ok]


def _compare(letters: Alphabet):
    """Of each word in each bucket: the number of its near words there, and the best one."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t, number in _chunks(batches):
            words, n = t.column("word").to_pylist(), t.column("n").to_numpy()
            pairs = list(near_pairs(words, number, np.array(t.column("path").to_pylist(), object), t.column("short").to_numpy(), letters))
            if not pairs:
                continue
            a, b = np.concatenate([p[0] for p in pairs]), np.concatenate([p[1] for p in pairs])
            a, b = np.concatenate([a, b]), np.concatenate([b, a])
            known = {w: k for k, w in enumerate(sorted(set(words)))}
            place = np.array([known[w] for w in words])
            order = np.lexsort([place[b], -n[b], place[a]])
            _, first, count = np.unique(place[a][order], return_index=True, return_counts=True)
            own, best = a[order][first], b[order][first]
            yield pa.RecordBatch.from_arrays([pa.array([words[i] for i in own]), pa.array(count.astype("i8")), pa.array(n[best]), pa.array([words[i] for i in best], pa.string())], ["word", "n_near", "best_n", "best"])

    return run


def near(words: DataFrame, limit: int = LIMIT) -> DataFrame:
    """word, n_near, best_n, best of each word that has near words; words: word, n, distinct and not null."""
    letters = alphabet(words)
    dealt, found = words.select("word", F.col("n").cast("long").alias("n"), F.lit("").alias("path"), F.lit(0).cast("long").alias("bucket"), F.lit(0).alias("short")), None
    while True:
        dealt = cut(dealt.mapInArrow(_dealer(letters), _DEALT))
        sizes = dealt.where(~F.col("ends")).groupBy("bucket", "ends").agg(F.count("*").alias("rows"), F.sum(F.length("word")).alias("chars"))
        large, rows = sized(sizes.where((F.col("rows") > limit) | ((F.col("chars") > LIMIT_CHARS) & (F.col("rows") > 1))).select("bucket", "ends"))
        small = dealt.join(small_side(large, rows), ["bucket", "ends"], "left_anti") if rows else dealt
        met = small.repartition("bucket").sortWithinPartitions("bucket", "path").mapInArrow(_compare(letters), "word string, n_near long, best_n long, best string")
        found = met if found is None else found.unionByName(met)
        if not rows:
            break
        dealt = dealt.join(small_side(large, rows), ["bucket", "ends"], "left_semi").select("word", "n", "path", "bucket", "short")
    best = F.min(F.struct((-F.col("best_n")).alias("turned"), F.col("best")))
    return found.groupBy("word").agg(F.sum("n_near").alias("n_near"), best.alias("b")).select("word", "n_near", (-F.col("b.turned")).alias("best_n"), "b.best")


def variants(words: DataFrame, ratio: int = RATIO, limit: int = LIMIT) -> DataFrame:
    """word, form, root, n, n_near, form_n of each word. words: word, n, distinct.

    form: the near word of largest n, if that is ratio times the word's at least; root: where the forms lead. Forms grow by ratio a
    step, so a root is a few steps away; each pass over the words halves what is left of the longest way.
    """
    words = gather(words.where("word is not null").select("word", "n"))
    told = words.join(near(words, limit), "word", "left")
    takes = F.col("best_n") >= ratio * F.col("n")
    told = cut(told.select("word", "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"), F.when(takes, F.col("best")).alias("form"), F.when(takes, F.col("best_n")).alias("form_n")))
    ways = told.where("form is not null").select("word", F.col("form").alias("root"))
    while True:
        ways, rows = sized(ways)
        on = ways.select(F.col("word").alias("root"), F.col("root").alias("beyond"))
        if ways.join(on, "root", "left_semi").isEmpty():
            break
        ways = ways.join(on, "root", "left").select("word", F.coalesce("beyond", "root").alias("root"))
    roots = told.join(small_side(ways, rows), "word", "left")
    return roots.select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")


def misspelt(run: Column, key: Column, one_in: int) -> Column:
    """run without one of its code points, where one_in divides key: a word with a planted slip."""
    at = F.pmod(key, F.length(run)).cast("int")
    return F.when(F.pmod(key, F.lit(one_in)) == 0, F.concat(run.substr(F.lit(1), at), run.substr(at + 2, F.length(run)))).otherwise(run)
