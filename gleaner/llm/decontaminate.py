"""Benchmark decontamination: passages of documents within a word edit distance of benchmark items.

Distances are edit distances over words (A-Z lower-cased). The CGK embedding walks over a word sequence: step j copies the
word under a pointer, which then moves on if a random bit of (j, word) is 1; so an edit distance becomes a Hamming distance
between the copies, small if few words were edited. Each of `REPEATS` repetitions has its own bits, its own anchor (a place
inside the item from which the walk starts, so that no edited word spoils all repetitions) and its own sample of steps; step
0 is always in the sample. Each place of each document is taken as the anchor of an item-sized window; its sampled copies are
matched, one sampled step after another, with those of all items, and it drops out as soon as no item has them. That gives
the same candidates as a table of whole keys, without walking the rest of the way. Walks have STEPS steps from their anchor,
not the item's length.

Items of fewer than SHORT words leave no room for anchors. They are cut into one piece more than the edits they may have; an
edit spoils one piece, so a passage within the distance has a piece whole, and runs of words equal to a piece are candidates.

A candidate (place, item) is checked exactly: first with the number of item words in the window (a bound that loses nothing),
then with the edit distance of the item to the best substring around the place. A match has distance <= (1 - similarity) *
words of the item. Items go to the workers in blocks of at most MOST_ITEMS; more items mean more passes, none is left out.

Recall: copies without edits are always found, and of items of fewer than SHORT words all copies up to the threshold; of longer
ones, tests measure it for random edits up to the threshold.

Defined cases: null or empty texts of documents have no match; null or empty items and items of fewer than `min_words` words
are no evidence and are not searched (op1 and the pipeline search all; up to four words no edit is allowed); equal items are found each by its own item_id. A null doc_id is kept. Repeated rows give
repeated results. Texts of any length are walked whole. An empty table on either side gives no match.
"""

from __future__ import annotations

import math
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import words

SIMILARITY, MIN_WORDS = 0.8, 5
#: Repetitions, sampled steps of each, and the steps among which they are drawn.
REPEATS, SAMPLES, STEPS = 32, 4, 10
#: Anchors drawn for each item and repetition; the walk whose sampled words are rarest in the benchmark is taken.
PROPOSALS = 4
#: Items of fewer words are searched by pieces.
SHORT = 15
MOST_ITEMS = 20_000
#: Bits of the table that says which copies any item has.
TABLE_BITS = 18
_U = np.uint64
_END = _U(0x5851F42D4C957F2D)


class Items:
    """Items with their walks or pieces, made once in each worker."""

    def __init__(self, ids: list, texts: list[str], similarity: float):
        self.ids = ids
        w = words.split(pa.array(texts, pa.string()), lower=True)
        h = w.hashes()
        self.hashes = [h[a:b] for a, b in zip(w.first[:-1], w.first[1:], strict=True)]
        self.most = [int((1 - similarity) * len(x) + 1e-9) for x in self.hashes]
        self.sets = [np.unique(x) for x in self.hashes]
        self.masks = [{int(v): sum(1 << int(i) for i in np.flatnonzero(x == v)) for v in np.unique(x)} for x in self.hashes]
        often = dict(zip(*(x.tolist() for x in np.unique(h, return_counts=True)), strict=True))
        rng = np.random.Generator(np.random.PCG64(7))
        self.pieces = self._pieces(words.Grams(h), w.first)
        long = np.flatnonzero(w.counts >= SHORT)
        self.repeats = []
        for _ in range(REPEATS if len(long) else 0):
            salt = _U(int(rng.integers(1, 2**63)))
            sample = [0, *sorted(rng.choice(np.arange(1, STEPS), SAMPLES - 1, replace=False).tolist())]
            anchor, keys = np.zeros(len(self.hashes), np.int64), []
            draws = rng.random(PROPOSALS)
            for i in long.tolist():
                x, best = self.hashes[i], -1.0
                for a in {int(d * max(1, len(x) - STEPS)) for d in draws}:
                    copies, own = self._walk(np.append(x[a:], np.full(STEPS, _END)), salt, sample)
                    rare = sum(math.log(len(w.starts) / often.get(c, 1)) for c in set(copies))
                    if rare > best:
                        best, anchor[i], walked = rare, a, own
                keys.append(walked)
            keys = np.array(keys, np.uint64).reshape(len(long), SAMPLES)
            stages = []
            for s in range(SAMPLES):
                table = np.zeros(1 << TABLE_BITS, bool)
                table[(keys[:, s] >> _U(64 - TABLE_BITS)).astype(np.int64)] = True
                stages.append((sample[s], table))
            order = np.argsort(keys[:, -1], kind="stable")
            self.repeats.append((salt, stages, keys[order, -1], long[order], anchor))

    def _pieces(self, grams: words.Grams, first: np.ndarray) -> list[tuple[int, np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
        """For each length of pieces: a table of which hashes any has; sorted hashes, with their items and places in these."""
        own = []
        for i, x in enumerate(self.hashes):
            if 0 < len(x) < SHORT:
                cuts = np.arange(self.most[i] + 2) * len(x) // (self.most[i] + 1)
                own += [(b - a, i, a) for a, b in zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True)]
        out = []
        for size in sorted({x[0] for x in own}):
            which, place = np.array([x[1:] for x in own if x[0] == size], np.int64).T
            keys = grams.of(first[which] + place, first[which] + place + size)
            order = np.argsort(keys, kind="stable")
            table = np.zeros(1 << TABLE_BITS, bool)
            table[(keys >> _U(64 - TABLE_BITS)).astype(np.int64)] = True
            out.append((size, table, keys[order], which[order], place[order]))
        return out

    @staticmethod
    def _walk(x: np.ndarray, salt: np.uint64, sample: list[int]) -> tuple[list[int], list[np.uint64]]:
        """The sampled copies, and hashes of the first of them, the first two, ..."""
        at, key, copies, out = 0, np.zeros(1, np.uint64), [], []
        for j in range(sample[-1] + 1):
            here = x[at : at + 1]
            if j in sample:
                key = chain(key, here, j)
                copies.append(int(here[0]))
                out.append(key[0])
            at += int(moves(here, salt, j)[0])
        return copies, out


def chain(key: np.ndarray, here: np.ndarray, j: int) -> np.ndarray:
    """Hash of the sampled copies so far."""
    return words.mix(key * _U(0xD1342543DE82EF95) + here + _U(j))


def moves(here: np.ndarray, salt: np.uint64, j: int) -> np.ndarray:
    """The random bit of (step, word)."""
    return (((here ^ salt) * _U((2 * j + 1) * 0x9E3779B97F4A7C15 & words.MASK)) >> _U(63)).astype(np.int64)


def candidates(h: np.ndarray, first: np.ndarray, items: Items) -> tuple[np.ndarray, np.ndarray]:
    """Distinct pairs (text, item) and the places of the item's first word, which may lie outside the text."""
    n = len(h)
    ends = np.repeat(first[1:], np.diff(first))
    padded = np.append(h, np.full(1, _END))
    most = max(len(x) for x in items.hashes)
    found = []

    def add(start: np.ndarray, key: np.ndarray, keys: np.ndarray, order: np.ndarray, back: np.ndarray) -> None:
        """Places whose key items have; back: of each sorted key, the words of its item before the place."""
        lo, hi = np.searchsorted(keys, key, "left"), np.searchsorted(keys, key, "right")
        hit = np.flatnonzero(hi > lo)
        many = (hi - lo)[hit]
        place = np.repeat(start[hit], many)
        at = np.repeat(lo[hit], many) + np.arange(many.sum()) - np.repeat(np.cumsum(many) - many, many)
        # A place may lie before the document's start; its anchor says which document it is of.
        doc = np.searchsorted(first, place, "right") - 1
        found.append(((place - back[at] - first[doc] + most) * len(items.ids) + order[at]) * (len(first) - 1) + doc)

    grams = words.Grams(h) if items.pieces else None
    for size, table, keys, which, back in items.pieces:
        start = words.window_starts(first, size)
        key = grams.of(start, start + size)
        on = np.flatnonzero(table[(key >> _U(64 - TABLE_BITS)).astype(np.int64)])
        add(start[on], key[on], keys, which, back)
    for salt, stages, keys, order, anchor in items.repeats:
        at = start = None
        key = words.mix(h)  # chain() with key 0 and step 0
        on = np.flatnonzero(stages[0][1][(key >> _U(64 - TABLE_BITS)).astype(np.int64)])
        start, key = on, key[on]
        at, here, end = start.copy(), h[start], ends[start]
        for (j0, _), (j1, table) in zip(stages[:-1], stages[1:], strict=True):
            for j in range(j0, j1):
                at = at + moves(here, salt, j)
                here = np.where(at < end, padded[np.minimum(at, n)], _END)
            key = chain(key, here, j1)
            on = np.flatnonzero(table[(key >> _U(64 - TABLE_BITS)).astype(np.int64)])
            start, key, at, here, end = start[on], key[on], at[on], here[on], end[on]
        add(start, key, keys, order, anchor[order])
    every, doc = np.divmod(np.unique(np.concatenate(found)), len(first) - 1)
    start, which = np.divmod(every, len(items.ids))
    return np.stack([doc, which], axis=1), start - most + first[doc]


def best_substring(text: np.ndarray, n: int, masks: dict[int, int]) -> tuple[int, int]:
    """The least edit distance of an item of n words to a substring of text, and the first end of such a one (bit-parallel)."""
    ones = (1 << n) - 1
    plus, minus, score, best, end, top = ones, 0, n, n, 0, 1 << (n - 1)
    for i, c in enumerate(text.tolist()):
        eq = masks.get(c, 0)
        d0 = (((eq & plus) + plus) ^ plus) | eq | minus
        up, down = minus | (ones & ~(d0 | plus)), plus & d0
        score += bool(up & top) - bool(down & top)
        up, down = (up << 1) & ones, (down << 1) & ones
        plus, minus = down | (ones & ~(d0 | up)), up & d0
        if score < best:
            best, end = score, i + 1
    return best, end


def matches(h: np.ndarray, first: np.ndarray, items: Items) -> list[tuple[int, int, int, int, int]]:
    """(text, item, first word, words, distance): of each text and item the match with the least distance, leftmost of these."""
    pairs, starts = candidates(h, first, items)
    best: dict[tuple[int, int], tuple[int, int, int]] = {}
    by_item = np.argsort(pairs[:, 1], kind="stable")
    bounds = np.searchsorted(pairs[by_item, 1], np.arange(len(items.ids) + 1))
    for item in np.flatnonzero(np.diff(bounds)):
        own = by_item[bounds[item] : bounds[item + 1]]
        n, most, mine = len(items.hashes[item]), items.most[item], items.hashes[item]
        # Chunks bound the memory of the check by words.
        for lo in range(0, len(own), 8192):
            rows = own[lo : lo + 8192]
            doc = pairs[rows, 0]
            a, b = first[doc], first[doc + 1]
            at = starts[rows][:, None] + np.arange(-2 * most, n + 2 * most)[None]
            inside = (at >= a[:, None]) & (at < b[:, None])
            seen = np.where(inside, h[np.clip(at, 0, len(h) - 1)], _END)
            place = np.minimum(np.searchsorted(items.sets[item], seen), len(items.sets[item]) - 1)
            hit = items.sets[item][place] == seen
            have = np.zeros((len(rows), len(items.sets[item])), bool)
            r, c = np.nonzero(hit)
            have[r, place[r, c]] = True
            count = np.bincount(np.searchsorted(items.sets[item], mine), minlength=len(items.sets[item]))
            for i in np.flatnonzero(have @ count >= n - most):
                text = h[max(a[i], starts[rows[i]] - 2 * most) : min(b[i], starts[rows[i]] + n + 2 * most)]
                distance, end = best_substring(text, n, items.masks[item])
                if distance <= most:
                    back, length = best_substring(text[:end][::-1], n, {k: int(f"{v:0{n}b}"[::-1], 2) for k, v in items.masks[item].items()})
                    begin = max(a[i], starts[rows[i]] - 2 * most) + end - length - a[i]
                    new = (distance, int(begin), int(length))
                    if (old := best.get((int(doc[i]), int(item)))) is None or new < old:
                        best[int(doc[i]), int(item)] = new
    return [(d, i, begin, length, distance) for (d, i), (distance, begin, length) in sorted(best.items())]


_made: dict[str, Items] = {}


def _items(shared, similarity: float) -> Items:
    name, ids, texts = shared.value
    if name not in _made:
        _made.clear()
        _made[name] = Items(ids, texts, similarity)
    return _made[name]


def _found(shared, similarity: float, text: str, id_column: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        items = _items(shared, similarity)
        for batch in batches:
            for lo, hi in words.slices(batch.column(text)):
                w = words.split(batch.column(text).slice(lo, hi - lo), lower=True)
                if rows := matches(w.hashes(), w.first, items) if len(w.starts) else []:
                    d, i, begin, length, distance = zip(*rows, strict=True)
                    yield pa.RecordBatch.from_arrays(
                        [batch.column(id_column).take(pa.array([x + lo for x in d])), pa.array([items.ids[x] for x in i]), pa.array(begin, pa.int64()), pa.array(length, pa.int64()), pa.array(distance, pa.int64()), pa.array([len(items.hashes[x]) for x in i], pa.int64())],
                        ["doc", "item", "first_word", "n_words", "distance", "item_words"],
                    )

    return run


def _clean(shared, similarity: float, text: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        items = _items(shared, similarity)
        for batch in batches:
            keep = np.ones(len(batch), bool)
            for lo, hi in words.slices(batch.column(text)):
                w = words.split(batch.column(text).slice(lo, hi - lo), lower=True)
                if len(w.starts):
                    keep[[lo + r[0] for r in matches(w.hashes(), w.first, items)]] = False
            yield batch.filter(pa.array(keep))

    return run


def _blocks(benchmark: DataFrame, item_id: str, text: str, min_words: int) -> Iterator[tuple[str, list, list[str]]]:
    """Items in blocks of bounded size: by count, parts of a hash of the item."""
    usable = benchmark.select(F.col(item_id).alias("i"), F.col(text).alias("t")).where(F.regexp_count("t", F.lit(r"[^\x20\x09-\x0D]+")) >= max(1, min_words))
    n = usable.count()
    parts = -(-n // (MOST_ITEMS // 2)) if n > MOST_ITEMS else 1
    for part in range(parts):
        rows = usable.where(F.pmod(F.xxhash64("t", "i"), F.lit(parts)) == part).orderBy("i", "t").collect() if parts > 1 else usable.orderBy("i", "t").collect()
        if rows:
            yield uuid.uuid4().hex, [r["i"] for r in rows], [r["t"] for r in rows]


def find_leaks(docs: DataFrame, benchmark: DataFrame, *, id_column="doc_id", text_column="text", item_id="item_id", item_text="text", similarity: float = SIMILARITY, min_words: int = MIN_WORDS) -> DataFrame:
    """A row for each document row and item that it has: ids, first_word (from 0), n_words, distance and item_words."""
    spark = docs.sparkSession
    schema = T.StructType([T.StructField("doc", docs.schema[id_column].dataType), T.StructField("item", benchmark.schema[item_id].dataType), *[T.StructField(c, T.LongType()) for c in ("first_word", "n_words", "distance", "item_words")]])
    out = spark.createDataFrame([], schema)
    for block in _blocks(benchmark, item_id, item_text, min_words):
        out = out.unionByName(docs.select(id_column, text_column).mapInArrow(_found(spark.sparkContext.broadcast(block), similarity, text_column, id_column), schema))
    return out.withColumnsRenamed({"doc": id_column, "item": item_id})


def decontaminate(docs: DataFrame, benchmark: DataFrame, *, text_column="text", item_id="item_id", item_text="text", similarity: float = SIMILARITY, min_words: int = MIN_WORDS) -> DataFrame:
    """The rows of docs in which no item is found."""
    for block in _blocks(benchmark, item_id, item_text, min_words):
        docs = docs.mapInArrow(_clean(docs.sparkSession.sparkContext.broadcast(block), similarity, text_column), docs.schema)
    return docs
