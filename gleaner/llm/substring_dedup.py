"""Substring dedup: words inside a run of `window` words that starts anywhere else too are removed, by seed and extend.

Seeds: of each window the leftmost smallest hash of its runs of `seed` words is its anchor (winnowing), so equal windows have
equal anchors at equal places, and every repeat of the threshold length or more shares one. The windows of one anchor
occurrence are consecutive; the stretch they cover (at most 2 * window - seed words) is the anchor's reach. Documents are
joined on anchors:
1. anchors that occur once are dropped (a count with partial sums);
2. an anchor occurrence whose whole reach occurs again is extended to the full reach at once;
3. where one anchor has different reaches, a match ends inside the reach: each distinct reach is extended left and right
   window by window against the others (hashes of windows, counted with partial sums; many equal reaches count through one).
Extensions of neighbouring anchors join up to the maximal repeats; all their words go. Windows are judged on the input.

No group of occurrences is gathered in one task, and no pairs are made. Joins are on written tables, so that Spark can split
hot anchors. Identity is by two 64-bit hashes (anchor and reach or window).

Defined cases: a null or empty text has no words and becomes ''. Texts of fewer than `window` words stay (as words joined by
single spaces). A repeated row is another document: all its windows repeat. Rows with the same doc_id and other texts are
kept apart. Other columns pass through; n_words and n_removed are replaced. An empty table gives an empty table.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import words
from .common import INNER, forget, written

WINDOW, SEED_WORDS = 35, 8


def anchors(w: words.Words, grams: words.Grams, window: int, seed: int) -> tuple[np.ndarray, ...]:
    """Of each anchor occurrence: the seed's hash, the number of its first window's first word and the number of its windows."""
    starts = words.window_starts(w.first, window)
    if not len(starts):
        return np.zeros(0, np.uint64), starts, starts
    at = np.arange(int(w.first[-1]) - seed + 1)
    least = grams.of(at, at + seed)
    width, span = 1, window - seed + 1
    while width < span:  # (least, at) of positions i .. i + width - 1; ties to the left
        step = min(width, span - width)
        later = least[step:] < least[:-step]
        least, at = np.where(later, least[step:], least[:-step]), np.where(later, at[step:], at[:-step])
        width += step
    own = at[starts]
    head = np.flatnonzero(np.concatenate([[True], (np.diff(own) != 0) | (np.diff(starts) != 1)]))
    return least[starts[head]], starts[head], np.diff(np.append(head, len(starts)))


def _signed(x: np.ndarray) -> pa.Array:
    return pa.array(x.view(np.int64))


def _occurrences(window: int, seed: int, text: str, id_column: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo, hi in words.slices(batch.column(text)):
                w = words.split(batch.column(text).slice(lo, hi - lo))
                grams = words.Grams(w.hashes())
                seeds, starts, n = anchors(w, grams, window, seed)
                if len(starts):
                    row = np.searchsorted(w.first, starts, "right") - 1
                    at = pa.array(row + lo)
                    yield pa.RecordBatch.from_arrays(
                        [_signed(seeds), _signed(grams.of(starts, starts + n - 1 + window)), batch.column(id_column).take(at), batch.column(f"{INNER}fp").take(at), pa.array((starts - w.first[row]).astype(np.int32)), pa.array(n.astype(np.int32))],
                        ["anchor", "reach", "id", "fp", "start", "n"],
                    )

    return run


def _windows(window: int, text: str, id_column: str):
    """Hashes of the windows of listed reaches."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo, hi in words.slices(batch.column(text)):
                w = words.split(batch.column(text).slice(lo, hi - lo))
                listed = batch.column(f"{INNER}parts").slice(lo, hi - lo)
                flat = listed.flatten()
                row = np.repeat(np.arange(hi - lo), pa.compute.list_value_length(listed).to_numpy(zero_copy_only=False))
                n, m = flat.field("n").to_numpy(), flat.field("m").to_numpy()
                of = np.repeat(np.arange(len(n)), n)
                start = flat.field("start").to_numpy()[of] + np.arange(len(of)) - np.repeat(np.cumsum(n) - n, n)
                at = w.first[row[of]] + start
                rows = pa.array(row[of] + lo)
                yield pa.RecordBatch.from_arrays(
                    [flat.field("anchor").take(pa.array(of)), _signed(words.Grams(w.hashes()).of(at, at + window, 1)), batch.column(id_column).take(rows), batch.column(f"{INNER}fp").take(rows), pa.array(start.astype(np.int32)), pa.array(m[of])],
                    ["anchor", "window", "id", "fp", "start", "m"],
                )

    return run


def _removed(window: int, text: str, columns: list[str]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            kept, total, gone = [], [], []
            for t, parts in zip(batch.column(text).cast(pa.large_binary()), batch.column(f"{INNER}parts"), strict=True):
                own = (t.as_py() or b"").split()
                total.append(len(own))
                if parts.is_valid:
                    edge = np.zeros(len(own) + 1, np.int64)
                    start, n = (parts.values.field(c).to_numpy() for c in ("start", "n"))
                    np.add.at(edge, start, 1)
                    np.add.at(edge, start + n - 1 + window, -1)
                    own = [own[i] for i in np.flatnonzero(np.cumsum(edge)[:-1] == 0)]
                gone.append(total[-1] - len(own))
                kept.append(b" ".join(own))
            made = {text: pa.array(kept, pa.binary()).cast(batch.schema.field(text).type), "n_words": pa.array(total, pa.int64()), "n_removed": pa.array(gone, pa.int64())}
            yield pa.RecordBatch.from_arrays([made[c] if c in made else batch.column(c) for c in columns], columns)

    return run


def remove_repeats(docs: DataFrame, *, id_column="doc_id", text_column="text", window: int = WINDOW, seed: int = SEED_WORDS) -> DataFrame:
    """docs with the words that stay, joined by one space, n_words (before) and n_removed."""
    docs = docs.drop("n_words", "n_removed")
    keyed = docs.withColumn(f"{INNER}fp", F.xxhash64(F.col(text_column)))
    narrow = keyed.select(id_column, text_column, f"{INNER}fp")
    id_type = docs.schema[id_column].dataType.simpleString()
    seen = written(narrow.mapInArrow(_occurrences(window, seed, text_column, id_column), f"anchor long, reach long, id {id_type}, fp long, start int, n int"), "anchors")
    again = seen.groupBy("anchor").agg(F.count(F.lit(1)).alias("c"), F.min("reach").alias("a"), F.max("reach").alias("b")).where(F.col("c") > 1)
    again = written(again.select("anchor", (F.col("a") == F.col("b")).alias("same")), "anchors-again")
    found = written(seen.join(again, "anchor"), "anchors-found")
    forget(seen)
    reaches = found.where(~F.col("same")).groupBy("anchor", "reach").agg(F.count(F.lit(1)).alias("m"), F.min(F.struct("id", "fp", "start", "n")).alias("one"))
    reaches = written(reaches.select("anchor", "reach", "m", "one.*"), "reaches")
    whole = found.where("same").select("id", "fp", "start", "n")
    whole = whole.unionByName(found.where(~F.col("same")).join(reaches.where("m > 1").select("anchor", "reach"), ["anchor", "reach"]).select("id", "fp", "start", "n"))
    listed = reaches.groupBy("id", "fp").agg(F.collect_list(F.struct("anchor", "start", "n", "m")).alias(f"{INNER}parts"))

    def with_parts(left: DataFrame, parts: DataFrame, how: str) -> DataFrame:
        parts = parts.withColumnsRenamed({"id": f"{INNER}id", "fp": f"{INNER}fp2"})
        return left.join(parts, left[id_column].eqNullSafe(parts[f"{INNER}id"]) & (left[f"{INNER}fp"] == parts[f"{INNER}fp2"]), how).drop(f"{INNER}id", f"{INNER}fp2")

    each = written(with_parts(narrow, listed, "inner").mapInArrow(_windows(window, text_column, id_column), f"anchor long, window long, id {id_type}, fp long, start int, m long"), "windows")
    twice = written(each.groupBy("anchor", "window").agg(F.sum("m").alias("m"), F.count(F.lit(1)).alias("k")).where("m > 1 AND k > 1").select("anchor", "window"), "windows-again")
    single = each.where("m = 1").join(twice, ["anchor", "window"]).select("id", "fp", "start", F.lit(1).alias("n"))
    parts = whole.unionByName(single).groupBy("id", "fp").agg(F.collect_list(F.struct("start", "n")).alias(f"{INNER}parts"))
    columns = [*docs.columns, "n_words", "n_removed"]
    schema = T.StructType([*docs.schema.fields, T.StructField("n_words", T.LongType()), T.StructField("n_removed", T.LongType())])
    return with_parts(keyed, parts, "left").mapInArrow(_removed(window, text_column, columns), schema)
