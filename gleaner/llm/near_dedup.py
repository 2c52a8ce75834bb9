"""Near-dedup by ProbMinHash: weighted five-word shingles, banding, verification and connected components.

A document's shingles are its runs of five words (A-Z lower-cased), weighted by how often they occur in it; a document of one
to four words has one shingle. Similarity is the probability Jaccard J_P(x, y) = sum over common i of
1 / sum_j max(x_j / x_i, y_j / y_i), which is the Jaccard similarity where no shingle repeats. Each shingle makes arrivals of a
Poisson process with its weight as rate, each at a random one of `BANDS * ROWS` places; a place keeps the shingle that comes
first, and a shingle stops as soon as its next arrival is later than all places' firsts. Places agree with probability J_P.

Documents with equal word sequences are one node, whose documents are counted, not paired. Nodes that agree in a band's places
share a bucket; at similarity 0.8 two nodes share none with probability (1 - 0.8**6)**36 < 2e-5. Nodes connected by buckets are
a family. Pairs are verified exactly, in tiles of two blocks of about BLOCK nodes each, in two rounds: first each block of a
family with its first one, which connects most near copies; then, of each bucket that this left in more components than one, the
blocks of nodes outside the largest component with all blocks. Nodes of a large family share many buckets: where it takes fewer
rows the family is taken as one unit instead, once for all of its buckets. So all pairs of a bucket are compared or connected,
whatever the size of the family; a task holds one tile, and a tile gives at most a link for each node. Nodes that are really
apart are to be compared pair by pair: o such ones of a unit with n nodes take some 2 o n / BLOCK rows. Texts are taken whole.

Components are found by hooking, pointer jumping and contraction over written tables. Nothing of all documents is collected.

Defined cases: a document without words (null, empty or only white space) is in a class of its own. Repeated rows and exact
copies are in one class. A null doc_id is allowed: class_id is the smallest doc_id of the class, null if it has none. An
empty table gives an empty table. Other columns pass through near_duplicates(); its result columns replace input columns.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import words
from .common import INNER, forget, written

SHINGLE, SIMILARITY = 5, 0.8
BANDS, ROWS = 36, 6
BLOCK = 64
_U = np.uint64
_ARRIVAL, _PLACE, _ROW = _U(0xA0761D6478BD642F), _U(0xE7037ED1A0B428DB), _U(0x8EBC6AF09C88C6E3)
SLICE_BYTES = 2 << 20


def shingles(w: words.Words, grams: words.Grams, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of shingles and the texts that they are in."""
    starts = words.window_starts(w.first, size)
    short = np.flatnonzero((w.counts > 0) & (w.counts < size))
    hashes = np.concatenate([grams.of(starts, starts + size), grams.of(w.first[short], w.first[short + 1])])
    return hashes, np.concatenate([np.searchsorted(w.first, starts, "right") - 1, short])


def prob_minhash(hashes: np.ndarray, weights: np.ndarray, rows: np.ndarray, n_rows: int, places: int) -> np.ndarray:
    """Of each row and place, the shingle that arrives first. hashes: the distinct shingles of each row."""
    first, kept = np.full(n_rows * places, np.inf), np.zeros(n_rows * places, np.uint64)
    last = np.full(n_rows, np.inf)
    time = np.zeros(len(hashes))
    step = 0
    while len(hashes):
        draw = words.mix(hashes + _U(step * int(_ARRIVAL) & words.MASK))
        time = time - np.log(((draw >> _U(11)).astype(np.float64) + 0.5) * 2.0**-53) / weights
        on = np.flatnonzero(time < last[rows])
        hashes, weights, rows, time, draw = hashes[on], weights[on], rows[on], time[on], draw[on]
        at = rows * places + ((words.mix(draw + _PLACE) >> _U(32)) * _U(places) >> _U(32)).astype(np.int64)
        np.minimum.at(first, at, time)
        won = time == first[at]
        kept[at[won]] = hashes[won]
        last = first.reshape(n_rows, places).max(axis=1)
        step += 1
    return kept.reshape(n_rows, places)


def probability_jaccard(a: tuple[np.ndarray, np.ndarray], b: tuple[np.ndarray, np.ndarray]) -> float:
    """Exact J_P of two weighted sets, each given as sorted distinct hashes and weights."""
    every = np.union1d(a[0], b[0])
    x, y = np.zeros(len(every)), np.zeros(len(every))
    x[np.searchsorted(every, a[0])], y[np.searchsorted(every, b[0])] = a[1], b[1]
    with np.errstate(divide="ignore"):
        ratio = np.where(y > 0, x / np.where(y > 0, y, 1), np.inf)
    order = np.argsort(ratio, kind="stable")
    x, y, ratio = x[order], y[order], ratio[order]
    head = np.searchsorted(ratio, ratio, "left")  # max() takes x_j for ratio_j >= ratio_i, else y_j
    above, below = x.sum() - np.concatenate([[0], np.cumsum(x)])[head], np.concatenate([[0], np.cumsum(y)])[head]
    common = (x > 0) & (y > 0)
    return float((1 / (above[common] / x[common] + below[common] / y[common])).sum())


def _signatures(text: str, id_column: str, size: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo, hi in words.slices(batch.column(text), SLICE_BYTES):
                w = words.split(batch.column(text).slice(lo, hi - lo), lower=True)
                h = w.hashes()
                grams = words.Grams(h)
                whole = np.stack([g.of(w.first[:-1], w.first[1:]) for g in (grams, words.Grams(words.mix(h + _PLACE)))], axis=1)
                hashes, rows = shingles(w, grams, size)
                _, one, weight = np.unique(hashes + rows.astype(np.uint64) * _ROW, return_index=True, return_counts=True)
                kept = prob_minhash(hashes[one], weight.astype(np.float64), rows[one], hi - lo, BANDS * ROWS)
                mixed = np.zeros((hi - lo, BANDS), np.uint64)
                for r in range(ROWS):
                    mixed = words.mix(mixed + kept[:, r::ROWS])
                full = w.counts > 0
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column(id_column).slice(lo, hi - lo),
                        batch.column(f"{INNER}fp").slice(lo, hi - lo),
                        pa.array([x.tobytes() if ok else None for x, ok in zip(whole, full, strict=True)], pa.binary()),
                        pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(full * BANDS)]).astype(np.int32)), pa.array(mixed[full].ravel().view(np.int64))),
                    ],
                    ["id", "fp", "node", "bands"],
                )

    return run


def weighted(texts: pa.Array, size: int) -> list[tuple[np.ndarray, np.ndarray]]:
    """Sorted distinct shingles and weights of each text."""
    out = []
    for lo, hi in words.slices(texts, SLICE_BYTES):
        w = words.split(texts.slice(lo, hi - lo), lower=True)
        hashes, rows = shingles(w, words.Grams(w.hashes()), size)
        order = np.argsort(rows, kind="stable")
        out += [np.unique(x, return_counts=True) for x in np.split(hashes[order], np.cumsum(np.bincount(rows, minlength=hi - lo))[:-1])]
    return out


def similar(sets: list[tuple[np.ndarray, np.ndarray]], least: float) -> np.ndarray:
    """Which pairs have J_P >= least, exactly. Where weights are 1, J_P is |x & y| / |x | y|; else J_P is at most the common share
    of either document's weight, and is computed where that bound allows."""
    n = len(sets)
    lens = np.array([len(x) for x, _ in sets])
    total = np.array([w.sum() for _, w in sets], np.float64)
    rows, column = np.repeat(np.arange(n), lens), np.concatenate([x for x, _ in sets])
    weight = np.concatenate([w for _, w in sets]).astype(np.float64) / np.repeat(total, lens)
    _, column, often = np.unique(column, return_inverse=True, return_counts=True)
    on = np.flatnonzero(often[column] > 1)  # a shingle of one document is not common to any pair
    order = on[np.argsort(column[on], kind="stable")]
    rows, weight, column = rows[order], weight[order], column[order]
    column = np.cumsum(np.diff(column, prepend=column[:1]) != 0)
    common, share = np.zeros((n, n)), np.zeros((n, n))
    for lo in range(0, int(column[-1]) + 1 if len(column) else 0, 4096):
        a, b = np.searchsorted(column, [lo, lo + 4096])
        has, part = np.zeros((n, 4096)), np.zeros((n, 4096))
        has[rows[a:b], column[a:b] - lo] = 1
        part[rows[a:b], column[a:b] - lo] = weight[a:b]
        common += has @ has.T
        share += part @ has.T
    plain = total == lens
    out = common >= (least - 1e-12) * (lens[:, None] + lens[None] - common)
    check = (np.minimum(share, share.T) >= least - 1e-9) & ~(plain[:, None] & plain[None])
    out &= plain[:, None] & plain[None]
    for i, j in zip(*np.nonzero(np.triu(check, 1)), strict=True):
        out[i, j] = out[j, i] = probability_jaccard(sets[i], sets[j]) >= least - 1e-12
    return out


def _tile(size: int, least: float):
    """Links of a tile's nodes to the first node of their component in it."""

    def run(table: pa.Table) -> pa.Table:
        table = table.sort_by("node")
        near = similar(weighted(table.column("text").combine_chunks(), size), least)
        np.fill_diagonal(near, True)
        label = np.arange(len(near))
        while True:
            new = np.where(near, label[None], len(near)).min(axis=1)
            new = new[new]
            if (new == label).all():
                break
            label = new
        moved = np.flatnonzero(label != np.arange(len(near)))
        nodes = table.column("node").combine_chunks()
        return pa.Table.from_arrays([nodes.take(pa.array(moved)), nodes.take(pa.array(label[moved]))], ["a", "b"])

    return run


def components(links: DataFrame, labels: DataFrame | None = None) -> DataFrame:
    """links: rows (a, b). labels: earlier components (node, label), where nodes without a row are alone. Returns the new ones."""
    if labels is not None:  # links between components
        own = lambda c: labels.select(F.col("node").alias(c), F.col("label").alias(f"l{c}"))
        links = links.join(own("a"), "a", "left").join(own("b"), "b", "left").select(F.coalesce("la", "a").alias("a"), F.coalesce("lb", "b").alias("b")).where("a <> b").distinct()
    edges = written(links.select(F.col("a").alias("u"), F.col("b").alias("v")), "links")
    now = None
    while now is None or edges.limit(1).count():
        # Every node hooks to its smallest neighbour, trees become stars, and links between stars are all that is left.
        near = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v"))).groupBy(F.col("u").alias("node")).agg(F.least(F.col("u"), F.min("v")).alias("label"))
        star, moved = written(near, "labels"), 1
        while moved:
            far = star.select(F.col("node").alias("label"), F.col("label").alias("far"))
            step = written(star.join(far, "label").select("node", F.col("far").alias("label"), (F.col("far") != F.col("label")).alias("moved")), "labels")
            moved, star = step.where("moved").limit(1).count(), step.select("node", "label")
        of = lambda c: star.select(F.col("node").alias(c), F.col("label").alias(f"l{c}"))  # noqa: B023, E731
        left = edges.join(of("u"), "u").join(of("v"), "v").where("lu <> lv").select(F.least("lu", "lv").alias("u"), F.greatest("lu", "lv").alias("v")).distinct()
        now = star if now is None else written(now.join(star.select(F.col("node").alias("label"), F.col("label").alias("to")), "label", "left").select("node", F.coalesce("to", "label").alias("label")), "labels")
        edges = written(left, "links")
    if labels is None:
        return now
    moved = now.select(F.col("node").alias("label"), F.col("label").alias("to"))
    old = labels.join(moved, "label", "left").select("node", F.coalesce("to", "label").alias("label"))
    return written(old.unionByName(now.join(labels, "node", "left_anti")), "labels")


def near_classes(docs: DataFrame, *, id_column="doc_id", text_column="text", similarity: float = SIMILARITY, shingle: int = SHINGLE, block: int = BLOCK) -> DataFrame:
    """A row for each row of docs: id, fp (xxhash64 of the text), node, class (its component; null without words), class_id, class_size."""
    id_type = docs.schema[id_column].dataType.simpleString()
    keyed = docs.select(F.col(id_column), F.coalesce(F.col(text_column), F.lit("")).alias(text_column)).withColumn(f"{INNER}fp", F.xxhash64(F.col(text_column)))
    signed = written(keyed.mapInArrow(_signatures(text_column, id_column, shingle), f"id {id_type}, fp long, node binary, bands array<long>"), "signatures")
    nodes = signed.where("node IS NOT NULL").groupBy("node").agg(F.min(F.struct("id", "fp")).alias("one"), F.min("bands").alias("bands"))
    placed = written(nodes.select("node", "one", F.posexplode("bands").alias("band", "bucket")).withColumn("turn", F.xxhash64("node")), "buckets")
    shared = placed.groupBy("band", "bucket").agg(F.count(F.lit(1)).alias("n"), F.min(F.struct("turn", "node")).alias("first")).where("n > 1")
    # Written, so that each side of the join is a plain shuffle whose large partitions Spark can split.
    shared = written(shared.select("band", "bucket", F.col("first.node").alias("leader")), "buckets-shared")
    active = written(placed.join(shared, ["band", "bucket"]), "buckets-active")
    forget(placed)
    families = components(active.where("node <> leader").select(F.col("node").alias("a"), F.col("leader").alias("b")).distinct())
    units = families.select("node", F.col("label").alias("unit"))
    sizes = units.groupBy("unit").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    sizes = written(sizes.select("unit", F.ceil(F.col("n") / block).cast("int").alias("blocks")), "family-sizes")
    wanted = active.select("node", "one.id", "one.fp").distinct().select("node", F.col("id").alias(f"{INNER}id"), F.col("fp").alias(f"{INNER}f"))
    texts = keyed.join(wanted, keyed[id_column].eqNullSafe(wanted[f"{INNER}id"]) & (keyed[f"{INNER}fp"] == wanted[f"{INNER}f"])).select("node", F.col(text_column).alias("text"))
    texts = written(texts.dropDuplicates(["node"]), "node-texts")

    def links(tiles: DataFrame) -> DataFrame:
        """tiles: unit, i, j, node."""
        tiles = written(tiles.select("unit", "i", "j", "node"), "tiles")
        return written(tiles.join(texts, "node").groupBy("unit", "i", "j").applyInArrow(_tile(shingle, similarity), "a binary, b binary").distinct(), "verified")

    turn = lambda n: F.pmod(F.xxhash64("node", F.lit("block")), n).cast("int")
    first = units.join(sizes, "unit").withColumn("block", turn(F.col("blocks")))
    first = first.withColumn("j", F.explode(F.when(F.col("block") == 0, F.sequence(F.lit(0), F.col("blocks") - 1)).otherwise(F.array("block"))))
    labels = components(links(first.withColumn("i", F.lit(0))))
    def measures(rows: DataFrame) -> DataFrame:
        """Of units (unit, node, label) in several components: the largest one, its blocks and those of the others, and how many rows tiles of the others with all have."""
        most = rows.groupBy("unit", "label").agg(F.count(F.lit(1)).alias("k")).groupBy("unit").agg(F.sum("k").alias("n"), F.max(F.struct("k", "label")).alias("m")).where("m.k < n")
        most = most.select("unit", "n", F.col("m.k").alias("k"), F.col("m.label").alias("main"), F.ceil(F.col("m.k") / block).cast("int").alias("mains"), F.ceil((F.col("n") - F.col("m.k")) / block).cast("int").alias("others"))
        return most.withColumn("cost", F.col("k") * F.col("others") + (F.col("n") - F.col("k")) * (F.col("others") + F.col("mains") - 1))

    wide = units.join(sizes.where("blocks > 1"), "unit").join(labels, "node", "left").select("unit", "node", F.coalesce("label", "node").alias("label"))
    wide = written(wide, "families-wide")
    families = written(measures(wide), "families-most")
    if families.limit(1).count():
        # A bucket in several components has a node outside its family's largest one; only such buckets are looked at.
        apart = written(wide.join(families.select("unit", "main"), "unit").where("label <> main").select("node"), "nodes-apart")
        open_buckets = written(active.join(apart, "node").select("band", "bucket").distinct(), "buckets-apart")
        rest = active.join(open_buckets, ["band", "bucket"]).select(F.concat_ws(":", "band", "bucket").cast("binary").alias("unit"), "node")
        rest = written(rest.join(wide.select("node", F.col("unit").alias("family"), "label"), "node", "left"), "buckets-open")
        most = written(measures(rest), "units-most")
        # The others of each bucket with the whole bucket; or once those of a family with the family, where that takes fewer rows.
        in_buckets = rest.select("unit", "family").distinct().join(most, "unit").groupBy("family").agg(F.sum("cost").alias("total"))
        whole = families.select(F.col("unit").alias("family"), "cost").join(in_buckets, "family").where("cost < total").select("family")
        whole = written(whole, "families-whole")
        rest = rest.join(whole, "family", "left_anti").select("unit", "node", "label").unionByName(wide.join(whole.select(F.col("family").alias("unit")), "unit"))
        both = rest.join(most.unionByName(families), "unit").withColumn("in", F.col("label") == F.col("main")).withColumn("block", F.when(F.col("in"), F.col("others") + turn(F.col("mains"))).otherwise(turn(F.col("others"))))
        # A tile compares each of its two blocks with itself too.
        parts = F.filter(F.sequence(F.lit(0), F.when(F.col("in"), F.col("others")).otherwise(F.col("others") + F.col("mains")) - 1), lambda w: w != F.col("block"))
        both = both.withColumn("with", F.explode(parts))
        labels = components(links(both.select("unit", "node", F.least("block", "with").alias("i"), F.greatest("block", "with").alias("j"))), labels)
    known = written(signed.select("id", "fp", "node").join(labels, "node", "left").select("id", "fp", "node", F.coalesce("label", "node").alias("class")), "members")
    classes = written(known.where("class IS NOT NULL").groupBy("class").agg(F.min("id").alias("class_id"), F.count(F.lit(1)).alias("class_size")), "classes")
    return known.join(classes, "class", "left").select("id", "fp", "node", "class", F.when(F.col("class").isNull(), F.col("id")).otherwise(F.col("class_id")).alias("class_id"), F.coalesce("class_size", F.lit(1)).alias("class_size"))


def near_duplicates(docs: DataFrame, *, id_column="doc_id", text_column="text", **options) -> DataFrame:
    """docs with class_id, class_size and kept (the first document of its class; one row even if rows repeat)."""
    made = ["class_id", "class_size", "kept"]
    docs = docs.drop(*made)
    # Written, so that no aggregate shares a stage with a join by class, and Spark can split the rows of a large class.
    of = written(near_classes(docs, id_column=id_column, text_column=text_column, **options), "near-classes")
    first = written(of.where("class IS NOT NULL AND id <=> class_id").groupBy("class").agg(F.min("fp").alias("first_fp")), "near-first")
    # One row for each doc_id and text, then one kept row in each class.
    one = of.groupBy("id", "fp", "class").agg(F.min("class_id").alias("class_id"), F.min("class_size").alias("class_size"))
    one = one.join(first, "class", "left").select(
        F.col("id").alias(f"{INNER}id"), F.col("fp").alias(f"{INNER}f"), "class_id", "class_size", (F.col("class").isNull() | (F.col("id").eqNullSafe(F.col("class_id")) & (F.col("fp") == F.col("first_fp")))).alias("kept")
    )
    one = written(one, "near")
    keyed = docs.withColumn(f"{INNER}fp", F.xxhash64(F.coalesce(F.col(text_column), F.lit(""))))
    return keyed.join(one, keyed[id_column].eqNullSafe(one[f"{INNER}id"]) & (keyed[f"{INNER}fp"] == one[f"{INNER}f"])).select(*docs.columns, *made)


def drop_near_duplicates(docs: DataFrame, **options) -> DataFrame:
    """One document of each class stays; of exactly repeated rows one stays too."""
    columns = docs.columns
    id_column, text_column = options.get("id_column", "doc_id"), options.get("text_column", "text")
    kept = near_duplicates(docs, **options).where("kept").select(*columns)
    narrow = docs.select(id_column, F.xxhash64(F.coalesce(F.col(text_column), F.lit(""))).alias("f")).where(F.trim(F.coalesce(F.col(text_column), F.lit(""))) != "")
    repeated = narrow.groupBy(id_column, "f").count().where("count > 1").limit(1).count()
    if not repeated:
        return kept
    blank = F.coalesce(F.regexp_count(F.col(text_column), F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)) == 0
    return kept.where(~blank).dropDuplicates([id_column, text_column]).unionByName(kept.where(blank))


__all__ = ["BANDS", "ROWS", "components", "drop_near_duplicates", "near_classes", "near_duplicates", "prob_minhash", "probability_jaccard"]
