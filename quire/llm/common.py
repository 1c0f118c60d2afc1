"""What several operators share: lineage cuts, tables sized to their rows, bounded filters, joins that keep hot groups out of shuffles."""

from __future__ import annotations

import atexit
import math
import shutil
import tempfile
from collections.abc import Iterator
from contextlib import contextmanager
from contextvars import ContextVar

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: White space in the sense of the contracts, for Java's and Python's regex alike.
BLANK = r"[\x20\x09-\x0D]"
#: Bits of the largest filter: 8 MB. More hashes go to so many filters, each for a part of the hashes; beyond those a fuller filter says "maybe"
#: more often (of one row in 200 at 16 bits a hash, of one in 16 at 6), and no result depends on it.
MAX_FILTER_BITS, MAX_FILTERS = 1 << 26, 16
#: Words of 64 bits in a segment of a filter, which is one row of its broadcast.
SEGMENT_WORDS = 64
#: Hashes of a block in which repeats are looked for, at most on average, and the least number of blocks.
BLOCK_HASHES, LEAST_BLOCKS = 1 << 18, 64
#: First bits of a hash by which crowded ranges of hashes are told.
FIRST_BITS = 10
#: Largest side table (levels, cells, pivots ...) that is broadcast, in rows, after counting it.
MAX_BROADCAST_ROWS = 20_000


#: Rows of an Arrow batch of texts.
BATCH_ROWS = 1000


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir, or one of our own where it is unset (local mode, tests)."""
    sc = spark.sparkContext
    held = sc._jsc.sc().getCheckpointDir()
    if held.isDefined():
        return held.get()
    folder = sc.getConf().get("spark.checkpoint.dir")
    if not folder and not sc.master.startswith("local[") and sc.master != "local":
        raise ValueError("spark.checkpoint.dir has to name a folder that the driver and all executors share")
    if not folder:
        folder = tempfile.mkdtemp(prefix="quire-")
        atexit.register(shutil.rmtree, folder, ignore_errors=True)
    sc.setCheckpointDir(folder)
    return sc._jsc.sc().getCheckpointDir().get()


def modest_batches(spark: SparkSession) -> None:
    """Texts are long: keeps Arrow batches to BATCH_ROWS rows, unless the session has a setting of its own. Python workers and the
    JVM's buffers then hold a few MB of texts each instead of tens.
    """
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if spark.conf.get(key) == "10000":  # the default
        spark.conf.set(key, str(BATCH_ROWS))


_kept: dict = {}


def kept(key, make):
    """What a Python worker keeps between tasks, such as words it has met: that of the last operator only, so that the stages of a
    pipeline, which share their workers, don't add up.
    """
    if key not in _kept:
        _kept.clear()
        _kept[key] = make()
    return _kept[key]


#: Folders of the checkpoints that the run at hand has written; of no run, none are kept.
_cuts: ContextVar[list[str] | None] = ContextVar("cuts", default=None)


def cut(df: DataFrame) -> DataFrame:
    """The same rows, written to the shared folder once, with no lineage behind them."""
    shared_dir(df.sparkSession)
    held = df.checkpoint(eager=True)
    file = held._jdf.logicalPlan().rdd().getCheckpointFile()
    mine = _cuts.get()
    if mine is not None and file.isDefined():
        mine.append(file.get())
    return held


#: Files of a checkpoint for each core, at most.
FILES_A_CORE = 4


def gather(df: DataFrame) -> DataFrame:
    """cut(), in no more files than FILES_A_CORE for each core: neighbouring partitions go to one task, and nothing moves. For narrow tables
    that are much smaller than what they come from; many small files cost more than they hold, on some file systems a process each.
    """
    return cut(df.coalesce(FILES_A_CORE * df.sparkSession.sparkContext.defaultParallelism))


def delete(spark: SparkSession, folder: str) -> None:
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


@contextmanager
def own_cuts(spark: SparkSession) -> Iterator[None]:
    """A run: the checkpoints that are written in it are removed at its end, by which all that was built on them has to be written down. Other
    runs of the same driver, in other threads, keep theirs.
    """
    mine: list[str] = []
    before = _cuts.set(mine)
    try:
        yield
    finally:
        _cuts.reset(before)
        for folder in mine:
            delete(spark, folder)


#: Rows of a partition of a small table.
PARTITION_ROWS = 50_000


def compact(df: DataFrame, rows: int) -> DataFrame:
    """df, of so many rows, in as many partitions as they fill. One partition needs no exchange in what follows, so tables of a few
    thousand rows don't cost a task for each shuffle partition in each step of an iteration; larger ones keep theirs.
    """
    return df.coalesce(max(1, math.ceil(rows / PARTITION_ROWS)))


def sized(df: DataFrame) -> tuple[DataFrame, int]:
    """The rows of df, written once, in as many partitions as they fill, and their number."""
    held = gather(df)
    rows = held.count()
    return compact(held, rows), rows


def small_side(side: DataFrame, rows: int | None = None) -> DataFrame:
    """side with a broadcast hint if its counted rows are within the bound; else as it is, for a shuffled join."""
    n = side.count() if rows is None else rows
    return F.broadcast(side) if n <= MAX_BROADCAST_ROWS else side


def text_of(name: str = "text") -> Column:
    return F.coalesce(F.col(name), F.lit(""))


#: Groups above this share of all rows stay out of shuffles; there are fewer than one in so many.
HOT_GROUPS = 1000
#: Bytes of large groups' rows that are broadcast at most; wider ones are dealt over SALTS places instead.
MAX_BROADCAST_BYTES, SALTS = 8 << 20, 256


def join_groups(rows: DataFrame, groups: DataFrame, key: str, size: str) -> DataFrame:
    """rows with the columns of groups, inner. groups: a row per key, with the number of its rows in size.

    A group with more than 1/HOT_GROUPS of all rows doesn't gather in one task: there are fewer than HOT_GROUPS of those, so
    they are broadcast, and only rows of the other groups shuffle. Where even so few are too wide for that, their rows are dealt over
    SALTS places each.
    """
    total, most = groups.agg(F.coalesce(F.sum(size), F.lit(0)), F.coalesce(F.max(size), F.lit(0))).first()
    if most <= max(total / HOT_GROUPS, 1):
        return rows.join(groups, key)
    hot = F.col(size) > total / HOT_GROUPS
    large = compact(groups.where(hot), HOT_GROUPS)
    wide = large.agg(F.sum(F.octet_length(F.to_json(F.struct("*"))))).first()[0] > MAX_BROADCAST_BYTES
    keys = F.broadcast(large.select(key))
    if wide:
        salted = large.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
        met = rows.join(keys, key, "left_semi").withColumn("_salt", F.pmod(F.monotonically_increasing_id(), F.lit(SALTS)).cast("int")).join(salted.hint("shuffle_hash"), [key, "_salt"]).drop("_salt")
    else:
        met = rows.join(F.broadcast(large), key)
    return met.unionByName(rows.join(keys, key, "left_anti").join(groups.where(~hot), key))


#: Rows whose crc32 of doc_id leaves 0 by this are held out from fitting.
FOLDS = 5


def held_out() -> Column:
    return F.pmod(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(FOLDS)) == 0


def fit_sample(ids: DataFrame, rows: int, seed: int = 0) -> DataFrame:
    """doc_id, turn of at most so many ids (distinct), those with the least hashes; turn: their order. Of many ids only some times rows are
    sorted at all, however many there are.
    """
    turn = F.xxhash64("doc_id", F.lit(seed))
    total = ids.count()
    if total > 8 * rows:
        ids = ids.where(F.pmod(turn, F.lit(1 << 30)) < math.ceil((1 << 30) * 4 * rows / total))
    return ids.select("doc_id", turn.alias("turn")).orderBy("turn", "doc_id").limit(rows)


def within_cells(rows: DataFrame, cells: int, by: list[str]) -> DataFrame:
    """Of a sample (turn, doc_id, cells) the first rows of each kind, as long as they have no more than so many cells together."""
    upto = F.sum("cells").over(Window.partitionBy(*by).orderBy("turn", "doc_id"))
    return rows.withColumn("_upto", upto).where(F.col("_upto") <= cells).drop("_upto")


class KeyFilter:
    """A Bloom filter of given 64-bit hashes: mark() never misses one, and says "maybe" of few others.

    The filter has 16 bits a hash in parts of MAX_FILTER_BITS at most, as many as the hashes ask for, up to MAX_FILTERS; so a broadcast is
    bounded whatever the input. Three bits of a hash lie in one segment of SEGMENT_WORDS words, and a probe is one broadcast join on the
    segment: with several parts, each probes its own share of the rows. No row of the probed table ever moves. Null hashes are never in
    it; an empty filter marks nothing.
    """

    def __init__(self, hashes: DataFrame, column: str, rows: int | None = None, bits: int = MAX_FILTER_BITS):
        rows = hashes.count() if rows is None else rows
        self.parts = min(MAX_FILTERS, max(1, math.ceil(16 * rows / bits)))
        rows = math.ceil(rows / self.parts)
        segment = SEGMENT_WORDS * 64
        self.segments = 1 << max(0, math.ceil(math.log2(max(1, min(bits, 16 * rows) / segment))))
        known = hashes.where(F.col(column).isNotNull())
        self.words = [self._built(known if self.parts == 1 else known.where(self._part(F.col(column)) == k), column, rows) for k in range(self.parts)]

    def _built(self, hashes: DataFrame, column: str, rows: int) -> DataFrame:
        bits = hashes.select(self._segment(F.col(column)).alias("s"), F.explode(F.array(*self._bits(F.col(column)))).alias("p"))
        words = bits.groupBy("s", F.shiftright("p", 6).alias("w")).agg(F.bit_or(F.expr("shiftleft(1L, cast(p & 63 as int))")).alias("b"))
        words = compact(words, 3 * rows).groupBy("s").agg(F.map_from_entries(F.collect_list(F.struct("w", "b"))).alias("m"))
        return cut(words.select("s", F.expr(f"transform(sequence(0L, {SEGMENT_WORDS - 1}L), w -> coalesce(try_element_at(m, w), 0L))").alias("words")))

    def _part(self, h: Column) -> Column:
        return F.pmod(F.xxhash64(h, F.lit(3)), F.lit(self.parts).cast("long"))

    def _segment(self, h: Column) -> Column:
        return F.pmod(F.xxhash64(h, F.lit(1)), F.lit(self.segments).cast("long"))

    @staticmethod
    def _bits(h: Column) -> list[Column]:
        x = F.xxhash64(h, F.lit(2))
        return [F.pmod(F.shiftright(x, 20 * k), F.lit(SEGMENT_WORDS * 64).cast("long")) for k in range(3)]

    def mark(self, df: DataFrame, column: str, flag: str) -> DataFrame:
        """df with a boolean: whether the hash in column may be one of the filter's."""
        if self.parts == 1:
            return self._marked(df, column, flag, self.words[0])
        part = F.coalesce(self._part(F.col(column)), F.lit(0))
        shares = [self._marked(df.where(part == k), column, flag, words) for k, words in enumerate(self.words)]
        out = shares[0]
        for share in shares[1:]:
            out = out.union(share)
        return out

    def _marked(self, df: DataFrame, column: str, flag: str, words: DataFrame) -> DataFrame:
        side = words.select(F.col("s").alias("_s"), F.col("words").alias("_words"))
        out = df.join(F.broadcast(side), self._segment(F.col(column)) == F.col("_s"), "left")
        both = F.lit(True)
        for p in self._bits(F.col(column)):
            word = F.get("_words", F.shiftright(p, 6).cast("int"))
            both &= F.coalesce(F.getbit(word, p.bitwiseAND(F.lit(63)).cast("int")) == 1, F.lit(False))
        return out.withColumn(flag, both).drop("_s", "_words")


class RepeatFilter:
    """A filter of the 64-bit hashes that may occur more than once; a row it doesn't mark has a hash of its own for certain.

    Pass 1 deals 32 bits of each hash to a block that the other bits name. They are gathered by task and block before the
    exchange, so about four bytes a row move, and a block finds its repeats where it is. Hashes that many rows share would fill their
    block's list; counts by the first bits tell where those are, and there rows are counted by hash instead, with partial counts before
    the exchange. Pass 2 probes a KeyFilter of the repeats, in parts of bounded size. Null hashes never repeat.
    """

    def __init__(self, hashes: DataFrame, column: str, bits: int = MAX_FILTER_BITS):
        known = hashes.where(F.col(column).isNotNull())
        first = F.shiftright(column, 64 - FIRST_BITS)
        counts = known.groupBy(first.alias("first")).agg(F.count("*").alias("n")).collect()  # 2^FIRST_BITS rows at most
        rows = sum(r["n"] for r in counts)
        hot = [r["first"] for r in counts if r["n"] > max(1000, 4 * rows >> FIRST_BITS)]  # a quarter of them at most
        self.blocks = max(LEAST_BLOCKS, math.ceil(rows / BLOCK_HASHES))
        dealt = known.where(~first.isin(hot)).select(*self._places(F.col(column)))
        lists = dealt.groupBy("block").agg(F.collect_list("rest").alias("rests"))
        again = lists.select("block", F.explode("rests").alias("rest")).groupBy("block", "rest").agg(F.count("*").alias("n")).where("n > 1")
        if hot:
            crowded = known.where(first.isin(hot)).select(*self._places(F.col(column))).groupBy("block", "rest").agg(F.count("*").alias("n")).where("n > 1")
            again = again.unionByName(crowded)
        again, self.repeats = sized(again.select(F.xxhash64("block", "rest").alias("place")))
        self.filter = KeyFilter(again, "place", self.repeats, bits)

    def _places(self, h: Column) -> list[Column]:
        return [F.pmod(h, F.lit(self.blocks).cast("long")).alias("block"), F.shiftright(h, 32).cast("int").alias("rest")]

    def mark(self, df: DataFrame, column: str, flag: str) -> DataFrame:
        """df with a boolean: whether the hash in column may repeat."""
        place = F.when(F.col(column).isNotNull(), F.xxhash64(*self._places(F.col(column))))
        return self.filter.mark(df.withColumn("_place", place), "_place", flag).drop("_place")
