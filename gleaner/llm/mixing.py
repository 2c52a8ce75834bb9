"""Mixing sources to target weights by weighted fair queueing, with DataFrame functions only.

Each source gets a share of all words by its weight; no target is above `most_repeats` times its source's size, and the
excess goes to the others by weight (a water level: see targets()). Documents of a source queue in a fixed shuffled order,
in passes 0, 1, ... over the whole source. The virtual finish time of a copy is the number of the source's words up to its
end, divided by the source's target. A copy is eligible if its virtual start time is below 1. All eligible copies are put
in the order of their finish times, and the mix takes the longest head of that order whose words fit the budget.

Scale: the hot source is spread over slices of the shuffled order, so prefix sums are taken within slices (bounded rows), over
slice totals in groups of slices, and over the groups' totals. Of the global order only a range with the cut is sorted: it is cut
into range buckets, and the bucket with the cut again, until at most SORTED_ROWS are left. Long texts are counted whole.

Defined cases: a null text has size 0; a document of size 0 is taken 0 times; a source without words has target 0. A null
source is a source of its own, last in order. Null or repeated doc_ids and repeated rows are allowed: each row counts by
itself; rows that tie in the order are equal in source, doc_id and text. An empty table gives an empty table. Columns of
the input whose names equal result columns are replaced by the result.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window as W
from pyspark.sql import functions as F

from .common import INNER, key_hash, written

WORD = r"[^\x20\x09-\x0D]+"
WEIGHTS = (5.0, 2.0, 1.0)
MOST_REPEATS = 3
SEED = "mix-1"
#: Rows of one slice of one source's order, about; and range buckets of finish times from 0 to 1.
SLICE_ROWS, RANGE_BUCKETS = 2048, 4096
#: Rows around the cut that are sorted in one task.
SORTED_ROWS = 50_000
HASH_BITS = 60


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def targets(sizes: DataFrame, weights=WEIGHTS, share: float = 1.0, most_repeats: int = MOST_REPEATS) -> DataFrame:
    """sizes: a row for each source (src, source_size). Adds place (by code point, null last), weight and target.

    Sources sorted by cap / weight fill up first. With the level (words left) / (weight left) before each of them, the
    level rises as long as sources are capped and never rises after, so its maximum is the final level.
    """
    order = W.orderBy(F.col("src").isNull(), F.col("src"))
    every = W.partitionBy()
    rising = W.orderBy(F.col("cap") / F.col("weight"), "place")
    before = rising.rowsBetween(W.unboundedPreceding, -1)
    onward = rising.rowsBetween(W.currentRow, W.unboundedFollowing)
    listed = sizes.withColumn("place", F.row_number().over(order)).withColumn(
        "weight", F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (F.pmod(F.col("place") - 1, F.lit(len(weights))) + 1).cast("int"))
    )
    level = listed.withColumn("cap", (F.col("source_size") * most_repeats).cast("double")).withColumn(
        "level", (F.sum("source_size").over(every) * share - F.coalesce(F.sum("cap").over(before), F.lit(0.0))) / F.sum("weight").over(onward)
    )
    return level.withColumn("target", F.least(F.col("cap"), F.max("level").over(every) * F.col("weight"))).select("src", "place", "source_size", "weight", "target")


def _queued(docs: DataFrame, keep: list[str], id_column: str, text_column: str, source_column: str, bits: int) -> DataFrame:
    h = key_hash(F.lit(SEED), F.col(id_column), F.md5(F.coalesce(F.col(text_column), F.lit("\x00"))))
    return docs.select(
        F.struct(*[F.col(f"`{c}`") for c in keep]).alias(f"{INNER}row"), F.col(source_column).cast("string").alias(f"{INNER}src"), word_count(F.col(text_column)).alias(f"{INNER}size"), h.alias(f"{INNER}h")
    ).withColumn(f"{INNER}slice", F.expr(f"shiftright({INNER}h, {HASH_BITS - bits})"))


def mix_sources(docs: DataFrame, *, keep: list[str] | None = None, id_column="doc_id", text_column="text", source_column="source", weights=WEIGHTS, share: float = 1.0, most_repeats: int = MOST_REPEATS, sorted_rows: int = SORTED_ROWS) -> DataFrame:
    """Each row of docs (the columns in keep; all by default) with size, source_size, target, copies, taken and finish_time (of its first copy)."""
    keep = docs.columns if keep is None else keep
    g = lambda c: F.col(f"{INNER}{c}")
    narrow = written(_queued(docs, [], id_column, text_column, source_column, HASH_BITS).select(g("src"), g("size"), g("h")), "mix")
    rows = narrow.count()
    bits = min(40, max(8, math.ceil(math.log2(max(1, rows) / SLICE_ROWS))))
    sliced = narrow.withColumn(f"{INNER}slice", F.expr(f"shiftright({INNER}h, {HASH_BITS - bits})"))
    by_source = targets(narrow.groupBy(g("src").alias("src")).agg(F.sum(g("size")).alias("source_size")), weights, share, most_repeats)
    of = lambda c: by_source[c].alias(f"{INNER}{c}")
    slices = sliced.groupBy(g("src"), g("slice")).agg(F.sum(g("size")).alias("n"))
    earlier = lambda x, order, *by: F.coalesce(F.sum(x).over(W.partitionBy(*by).orderBy(order).rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    slices = slices.withColumn("group", F.expr(f"shiftright({INNER}slice, {bits // 2})"))
    tops = slices.groupBy(g("src").alias("top"), F.col("group").alias("top_group")).agg(F.sum("n").alias("m"))
    tops = tops.withColumn("before", earlier("m", "top_group", "top"))
    ahead = (F.col("before") + earlier("n", g("slice"), g("src"), "group")).alias(f"{INNER}ahead")
    slices = slices.join(tops, g("src").eqNullSafe(F.col("top")) & (F.col("group") == F.col("top_group")))
    offsets = slices.select(g("src"), g("slice"), ahead).join(by_source, g("src").eqNullSafe(by_source["src"]))
    offsets = written(offsets.select(g("src").alias("src"), g("slice").alias("slice"), g("ahead"), of("place"), of("source_size"), of("target")), "mix-offsets")

    def placed(queued: DataFrame) -> DataFrame:
        """With cum: the source's words up to the end of the row's first copy."""
        both = queued.join(offsets, g("src").eqNullSafe(offsets["src"]) & (g("slice") == offsets["slice"]))
        run = W.partitionBy(g("place"), g("slice")).orderBy(g("h"), g("size")).rowsBetween(W.unboundedPreceding, W.currentRow)
        return both.withColumn(f"{INNER}cum", g("ahead") + F.sum(g("size")).over(run))

    def finish(p) -> Column:
        return F.try_divide(p * g("source_size") + g("cum"), g("target"))

    copies = placed(sliced).select(F.explode(F.sequence(F.lit(0), F.lit(most_repeats - 1))).alias("p"), g("place"), g("size"), g("cum"), g("source_size"), g("target"))
    copies = copies.where((g("target") > 0) & (g("size") > 0) & ((F.col("p") * g("source_size") + g("cum") - g("size")) < g("target")))
    copies = copies.select(finish(F.col("p")).alias("t"), g("place").alias("place"), g("size").alias("size"))
    copies = written(copies, "mix-copies")
    budget = narrow.agg(F.sum(g("size") * F.lit(1)).alias("n")).first()["n"] or 0
    budget = int(budget * share)
    inside, before, low, width = copies, 0, 0.0, 1.0
    while True:
        bucket = F.least(F.floor((F.col("t") - low) / width * RANGE_BUCKETS), F.lit(2 * RANGE_BUCKETS))
        totals = inside.groupBy(bucket.alias("range")).agg(F.sum("size").alias("n"), F.count(F.lit(1)).alias("rows")).withColumn("upto", F.sum("n").over(W.orderBy("range")) + before)
        over = totals.where(F.col("upto") > budget).orderBy("range").limit(1).select("range", "rows", (F.col("upto") - F.col("n")).alias("before")).first()
        if over is None:
            break
        inside, before = inside.where(bucket == over["range"]), over["before"]
        if over["rows"] <= sorted_rows or width < 1e-12:  # what is left then is equal
            break
        low, width = low + over["range"] * width / RANGE_BUCKETS, width / RANGE_BUCKETS
    if over is None:
        taken_if = lambda p: F.lit(True)
    else:
        inside = inside.withColumn("upto", before + F.sum("size").over(W.orderBy("t", "place").rowsBetween(W.unboundedPreceding, W.currentRow)))
        cut = inside.where(F.col("upto") > budget).orderBy("t", "place").select("t", "place").first()
        taken_if = lambda p: (finish(p) < cut["t"]) | ((finish(p) == cut["t"]) & (g("place") < cut["place"]))
    eligible = lambda p: (g("target") > 0) & (g("size") > 0) & ((p * g("source_size") + g("cum") - g("size")) < g("target"))
    n = sum((F.coalesce((eligible(F.lit(p)) & taken_if(F.lit(p))).cast("int"), F.lit(0)) for p in range(most_repeats)), F.lit(0))
    done = placed(_queued(docs, keep, id_column, text_column, source_column, bits)).withColumn(f"{INNER}n", n)
    made = {"size": g("size"), "source_size": g("source_size"), "target": g("target"), "copies": g("n"), "taken": g("size") * g("n"), "finish_time": finish(F.lit(0))}
    return done.select(*[F.col(f"{INNER}row")[c].alias(c) for c in keep if c not in made], *[v.alias(k) for k, v in made.items()])


def mixed_rows(docs: DataFrame, **options) -> DataFrame:
    """The mix itself: a row for each copy taken, in the order of virtual finish times, with copy (from 0) and finish_time."""
    rows = mix_sources(docs, **options)
    every = rows.where(F.col("copies") > 0).withColumn("copy", F.explode(F.sequence(F.lit(0), F.col("copies") - 1)))
    at = F.col("finish_time") + F.try_divide(F.col("copy") * F.col("source_size"), F.col("target"))
    return every.withColumn("finish_time", at).orderBy("finish_time", "copy")
