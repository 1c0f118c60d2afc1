"""Mixing sources to target weights by entropy balancing, in DataFrame operations only.

Each word of a document is taken at a rate; among all rates that meet the token targets, those closest (in Kullback-Leibler
divergence from 1) are r = exp(sum of the multipliers of the document's levels), cut at the cap. The multipliers maximise a
convex dual and are found by Newton steps: levels of one column don't overlap, so their block of the Hessian is diagonal, and
each step is one aggregation over the cells (distinct combinations of levels, with their word sums) and one join back.

Rates become copies: floor(r), and one more for those documents whose hash is below a cutoff. Each cell has a cutoff for each of
three bands of length, long documents first, and what one band misses by is carried to the next, so a cell ends within about half a short
document of its target. A cutoff is found by descent: word sums over at most 2^FAN_BITS ranges of the hash tell the range where the
target is crossed, that range is split again until it holds a few times RANGE_ROWS documents, and these decide exactly. No document
moves, and what a cell sends in a step is bounded, whatever its rows.

Memory: a row per cell and range. Defined results: null text has size 0; a null source is a source of its own, last in order; sources
without words have target 0 and take 0; copies never exceed the cap; rows alike in doc_id and text are told apart by a hash of
their place in the table, so the cutoff can lie between them (docs has to be a table, or another plan that gives its rows in one order);
an empty table gives an empty result.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quire.llm.common import MAX_BROADCAST_ROWS, PARTITION_ROWS, compact, cut, gather, join_groups, sized, small_side, text_of

CAP = 3.0
#: Rows of the last hash range, on average, and the bits by which one descent splits a range at most.
RANGE_ROWS, FAN_BITS = 256, 12
#: Bits of the key that orders the documents of a cell, and how many of them tell rows alike apart.
KEY_BITS, PLACE_BITS = 63, 23
#: Least words of the bands of documents, the longest first, whose extra copies are chosen one band after the other.
BANDS = (1024, 128, 0)


def words(text: Column) -> Column:
    return F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")).cast("long")


def _ranked(per: DataFrame, rows: int) -> DataFrame:
    """per with rank: the place (from 0) of each source by code point, null last. Sorted by ranges; only the sizes of the ranges meet."""
    parts = max(1, math.ceil(rows / PARTITION_ROWS))
    order = [F.col("source").isNull(), F.col("source")]
    held = cut(per.repartitionByRange(parts, *order).sortWithinPartitions(*order).withColumn("_at", F.monotonically_increasing_id()))
    sizes = held.groupBy(F.shiftright("_at", 33).alias("_part")).agg(F.count("*").alias("n")).collect()  # a row per partition
    before, offsets = 0, []
    for r in sorted(sizes, key=lambda r: r["_part"]):
        offsets += [F.lit(r["_part"]), F.lit(before)]
        before += r["n"]
    first = F.element_at(F.create_map(*offsets), F.shiftright("_at", 33)) if offsets else F.lit(0)
    return held.withColumn("rank", first + F.col("_at").bitwiseAND(F.lit((1 << 33) - 1))).drop("_at")


def source_targets(sizes: DataFrame, weights: int = 3, cap: float = CAP) -> DataFrame:
    """source, source_size, target. Sources by code point, null last, weigh 1..weights in turn and share all words; none is above
    cap times its size, and the excess is reshared by weight: the share of a weight rises until it would cap no more sources.
    """
    per, rows = sized(sizes.groupBy("source").agg(F.sum("size").alias("source_size")))
    per = _ranked(per, rows).withColumn("w", (F.col("rank") % weights + 1).cast("double")).withColumn("most", F.col("source_size") * F.lit(cap))
    total = per.agg(F.sum("source_size")).first()[0] or 0
    share, capped = 0.0, F.col("most") < 0
    while True:
        held, free = per.agg(F.sum(F.when(capped, F.col("most")).otherwise(0.0)), F.sum(F.when(capped, 0.0).otherwise(F.col("w")))).first()
        now = (total - held) / free if free else share
        if now <= share:
            break
        share = now
        capped = F.col("most") < F.lit(share) * F.col("w")
    return per.select("source", "source_size", F.when(capped, F.col("most")).otherwise(F.lit(share) * F.col("w")).alias("target"))


def balance(cells: DataFrame, targets: dict[str, DataFrame], cap: float = CAP, steps: int = 60, tolerance: float = 1e-9) -> DataFrame:
    """cells (level columns, size) with a rate each. targets: for each level column a frame (column, target).

    Newton steps on the dual, a column at a time, until every level is within tolerance of its target or stays at the cap.
    """
    cells, rows = sized(cells.withColumn("theta", F.lit(0.0)))
    rate = F.least(F.exp(F.least(F.col("theta"), F.lit(50.0))), F.lit(cap))
    for _ in range(steps):
        worst = 0.0
        for column, target in targets.items():
            side = target.select(F.col(column).alias("_level"), F.col("target").alias("_target"))
            now = cells.groupBy(F.col(column).alias("_level2")).agg(F.sum(F.col("size") * rate).alias("_got"), F.sum(F.when(F.exp("theta") < cap, F.col("size") * rate).otherwise(0.0)).alias("_slope"), F.sum("size").alias("_all"))
            now = now.join(side, F.col("_level2").eqNullSafe(F.col("_level")))
            gap = F.col("_target") - F.col("_got")
            # a step is at most 2: exp is steep; a level that is all at the cap only moves down again
            step = F.when(F.col("_all") == 0, 0.0).when(F.col("_slope") > 0, F.greatest(F.lit(-2.0), F.least(F.lit(2.0), gap / F.col("_slope")))).when(gap < 0, F.lit(-0.5)).otherwise(0.0)
            now = now.select("_level2", step.alias("_step"), F.when(F.col("_all") > 0, F.abs(gap) / F.greatest(F.col("_target"), F.lit(1.0))).otherwise(0.0).alias("_off"))
            cells = compact(cut(cells.join(now, F.col(column).eqNullSafe(F.col("_level2"))).withColumn("theta", F.col("theta") + F.col("_step")).select(*cells.columns, "_off")), rows)
            worst = max(worst, cells.agg(F.max("_off")).first()[0] or 0.0)
            cells = cells.drop("_off")
        if worst < tolerance:
            break
    return cells.withColumn("rate", rate).drop("theta")


def _cell(levels: list[str]) -> Column:
    """The levels of a row as one string; nulls are told from every value."""
    return F.to_json(F.struct(*(F.col(f"`{c}`").cast("string").alias(c) for c in levels)))


def _nearest(rows: DataFrame, cells: DataFrame, cell_rows: int) -> DataFrame:
    """For each cell of cells (_cell, need) the key (cut) below which the words (got) of rows (_cell, size, h) come nearest to need."""
    side = compact(cut(cells.where("need > 0").select("_cell", "need", F.lit(0).cast("long").alias("prefix"), F.lit(0).cast("double").alias("before"))), cell_rows)
    used, step = 0, 0
    before = Window.partitionBy("_cell").orderBy("range").rowsBetween(Window.unboundedPreceding, -1)
    most = cells.agg(F.max("n")).first()[0] or 0
    while most > 4 * RANGE_ROWS and used < KEY_BITS:
        step = min(FAN_BITS, KEY_BITS - used, math.ceil(math.log2(most / RANGE_ROWS)))
        here = rows.join(small_side(side, cell_rows), "_cell").where(F.shiftright("h", KEY_BITS - used) == F.col("prefix"))
        here = here.withColumn("range", F.shiftright("h", KEY_BITS - used - step))
        sums = compact(here.groupBy("_cell", "need", "before", "range").agg(F.sum("size").alias("s"), F.count("*").alias("n")), cell_rows << step)
        sums = sums.withColumn("upto", F.col("before") + F.coalesce(F.sum("s").over(before), F.lit(0)))
        crossed = sums.where((F.col("upto") < F.col("need")) & (F.col("upto") + F.col("s") >= F.col("need")))
        side = compact(cut(crossed.select("_cell", "need", F.col("range").alias("prefix"), F.col("upto").alias("before"), "n")), cell_rows)
        used, most = used + step, side.agg(F.max("n")).first()[0] or 0
        side = side.drop("n")
    inside = rows.join(small_side(side, cell_rows), "_cell").where(F.shiftright("h", KEY_BITS - used) == F.col("prefix"))
    inside = compact(inside.groupBy("_cell", "need", "before", "h").agg(F.sum("size").alias("size")), 4 * cell_rows * RANGE_ROWS)
    upto = Window.partitionBy("_cell").orderBy("h").rowsBetween(Window.unboundedPreceding, 0)
    inside = inside.withColumn("upto", F.col("before") + F.sum("size").over(upto))
    with_it, without = F.abs(F.col("upto") - F.col("need")), F.abs(F.col("upto") - F.col("size") - F.col("need"))
    taken = F.struct(with_it.alias("off"), (F.col("h") + 1).alias("cut"), F.col("upto").alias("got"))
    left = F.struct(without.alias("off"), F.col("h").alias("cut"), (F.col("upto") - F.col("size")).alias("got"))
    best = F.min(F.when(with_it <= without, taken).otherwise(left))
    return inside.groupBy("_cell").agg(best.alias("best")).select("_cell", "best.cut", "best.got")


def _key(seed: int) -> Column:
    """What orders the documents of a cell: a hash of doc_id and text, then one of the row's place, which tells rows alike apart."""
    own = F.expr(f"xxhash64(doc_id, text, {seed})").bitwiseAND(F.lit((1 << KEY_BITS - PLACE_BITS) - 1))
    place = F.xxhash64(F.monotonically_increasing_id()).bitwiseAND(F.lit((1 << PLACE_BITS) - 1))
    return F.shiftleft(own, PLACE_BITS).bitwiseOR(place)


def copies(docs: DataFrame, extra_targets: dict[str, DataFrame] | None = None, weights: int = 3, cap: float = CAP, seed: int = 7) -> DataFrame:
    """docs with _size, _copies and _mix (source_size, target, rate ...). extra_targets: further level columns, each with (column, target words)."""
    levels = ["source", *(extra_targets or {})]
    rows = cut(docs.select(*levels, words(text_of()).alias("size"), _key(seed).alias("h")).withColumns({"_cell": _cell(levels), "band": _band("size")}))
    target = gather(source_targets(rows, weights, cap))
    cells = rows.groupBy("_cell", *levels).agg(F.sum("size").alias("size"), F.count("*").alias("n"), *(F.sum(F.when(F.col("band") == k, F.col("size")).otherwise(0)).alias(f"s{k}") for k in range(len(BANDS))))
    cells, cell_rows = sized(cells)
    cells = balance(cells, {"source": target, **(extra_targets or {})}, cap)
    near = F.abs(F.col("rate") - F.round("rate")) < 1e-7
    cells = cells.withColumn("rate", F.when(near, F.round("rate")).otherwise(F.col("rate"))).withColumn("base", F.floor("rate").cast("long"))
    cells = compact(cut(cells.withColumn("carry", F.lit(0.0))), cell_rows)
    for k in range(len(BANDS)):
        # what the longer documents missed by is made up for here, as far as it can be;
        # rounded, so that the last bits of a sum never decide between two equally near cutoffs
        want = F.round((F.col("rate") - F.col("base")) * F.col(f"s{k}") + F.col("carry"), 6)
        cells = cells.withColumn("want", want).withColumn("need", F.greatest(F.lit(0.0), F.least(F.col("want"), F.col(f"s{k}").cast("double"))))
        found = _nearest(rows.where((F.col("size") > 0) & (F.col("band") == k)).select("_cell", "size", "h"), cells, cell_rows)
        cells = cells.join(found, "_cell", "left")
        cells = cells.withColumn(f"cut{k}", F.coalesce("cut", F.lit(0))).withColumn("carry", F.col("want") - F.coalesce("got", F.lit(0)))
        cells = compact(cut(cells.drop("cut", "got", "want", "need")), cell_rows)
    rates = cells.join(target.select(F.col("source").alias("_source"), "source_size", "target"), F.col("source").eqNullSafe(F.col("_source")))
    cuts = F.array(*(F.col(f"cut{k}") for k in range(len(BANDS))))
    rates = compact(cut(rates.select("_cell", "n", F.struct("source_size", "target", "rate", "base", cuts.alias("cuts")).alias("_mix"))), cell_rows)
    out = docs.withColumns({"_size": words(text_of()), "_h": _key(seed), "_cell": _cell(levels)})
    side = small_side(rates.drop("n"), cell_rows)
    # many cells: the large ones stay out of the shuffle
    out = (out.join(side, "_cell") if cell_rows <= MAX_BROADCAST_ROWS else join_groups(out, rates, "_cell", "n").drop("n")).drop("_cell")
    more = F.when((F.col("_size") > 0) & (F.col("_h") < F.element_at("_mix.cuts", _band("_size") + 1)), 1).otherwise(0)
    return out.withColumn("_copies", F.col("_mix.base") + more)


def _band(size: str) -> Column:
    """The place of a size among BANDS; the last takes the rest."""
    out = F.lit(len(BANDS) - 1)
    for k in reversed(range(len(BANDS) - 1)):
        out = F.when(F.col(size) >= BANDS[k], k).otherwise(out)
    return out


def report(docs: DataFrame, **more) -> DataFrame:
    """doc_id, size, source_size, target, taken, source, rate, copies: a row per document."""
    out = copies(docs.select("doc_id", "text", "source"), **more)
    return out.select("doc_id", F.col("_size").alias("size"), F.col("_mix.source_size").alias("source_size"), F.col("_mix.target").alias("target"), (F.col("_copies") * F.col("_size")).alias("taken"), "source", F.col("_mix.rate").alias("rate"), F.col("_copies").alias("copies"))


def mix(docs: DataFrame, **more) -> DataFrame:
    """The mixed corpus: every document as often as its copies say, with the columns of docs. Documents without words stay once."""
    names = docs.columns
    held = docs.select(*(F.col(c) for c in ("doc_id", "text", "source")), F.struct(*(F.col(f"`{c}`") for c in names)).alias("_row"))
    out = copies(held, **more)
    times = F.when(F.col("_size") == 0, 1).otherwise(F.col("_copies")).cast("int")
    return out.where(times > 0).withColumn("_n", times).select("_row", F.explode(F.expr("sequence(1, _n)"))).select("_row.*")
