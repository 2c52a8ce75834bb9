"""LM scoring with a hierarchical Pitman-Yor model whose seating is sampled by Gibbs sweeps.

The model. Each word that stands before another (or the start of a text) is a restaurant, a room; its customers are the tokens
that come next, words or the end of the text. All rooms share one parent, the word restaurant, whose base is uniform over the V
known words (the end is one) and one unknown word. Each table of a room sends one customer to the word restaurant. Predictive
probabilities of a room sum to 1 over V + 1 words; a room that training has not seen gives what its parent gives.

Seating. In each sweep all customers of a dish (a word in a restaurant) leave and are seated again, one after another under
the Chinese-restaurant rule (join a table: customers - discount * tables; open one: (strength + discount * all tables) *
parent's probability), with the rest as the sweep before left it. Beyond the first 2**24 customers of a dish the number of those
who join before the next table opens is drawn at once, by inversion of its distribution. Draws depend only on the word, the
room and the sweep, so a lost task draws the same again. Discounts are n1 / (n1 + 2 n2) of a level's counts. After BURN_IN
sweeps the predictive probabilities of SAMPLES sweeps are averaged. Their logs are summed to scores and give perplexities.

Scale. Pairs (room, word) are counted in each task, then by room in parts; a room with many tokens is split over parts by
word. A pair of one token always has one table: only pairs of more tokens are drawn. Pairs are written once. In a sweep the
parts send the tables of each word to the word's part, which seats the word restaurant and answers with its state: no pair moves
between parts, and no vector of all words comes to one place. Which rooms are split is decided by a sample of texts; that only
spreads work, as do the parts' numbers, which Spark deals to different tasks. Scores: pairs as frequent as the MOST_PAIRS most
frequent ones, and words as the MOST_HEAD ones, are broadcast with what they give; all other tokens go to the part of their
pair. Of a pair that no training text has, what the room and the word give is multiplied, from the broadcast or else by joins.
Nothing is dropped: all words and pairs count, all tokens are scored.

Defined cases: a null text is empty, its only token is the end. A null doc_id is a training document. Repeated rows count
each. Without training tokens N = V = 0, and all probabilities are 1. Texts are taken whole, however long. Other columns pass
only if in `keep`, and result columns replace those of their names. An empty table gives an empty table.
"""

from __future__ import annotations

import pickle
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import words
from .common import INNER, forget, give_back, release, sparing, tidy, written

BURN_IN, SAMPLES, STRENGTH = 2, 3, 1.0
LAST = BURN_IN + SAMPLES
MOST_HEAD, MOST_PAIRS = 1 << 19, 1 << 20
#: Customers of a dish that are seated together with those of other dishes; so many at once; and those of one dish with a draw each.
ONE_BY_ONE, CHUNK, MOST_ALONE = 64, 1 << 16, 1 << 24
#: Dishes whose first customers are seated at once.
AT_A_TIME = 1 << 14
#: One text in so many, by a hash, tells which rooms to split.
HOT_SAMPLE = 64
#: Tokens that a task counts at once, and those that it sends to be scored; texts whose sums it sends; bytes of text that it scores at once.
AT_ONCE, SENT, SENT_TEXTS, SLICE_BYTES = 1 << 20, 1 << 18, 1 << 16, 1 << 18
#: Log probabilities of pairs are kept in units of 1 / SCALE.
SCALE = 100_000
_U = np.uint64
#: The end of a text as a word, and its start as a room.
END, START = _U(0), _U(1)
BLOB = "part int, kind int, data binary, sums array<long>"
#: Kinds of rows: pairs of a task; a part's repeated pairs and its other ones; what a part tells a word part; the answer; a word
#: part's state; tables of a part's rooms; of split rooms; a part's probabilities; those of frequent pairs; what rooms give; tokens
#: with broadcast words, other tokens; documents' sums.
COUNTED, PAIRS, ONES, TOLD, ANSWER, STATE, ROOMS, SPLIT, MODEL, FREQUENT, GIVEN, ASKED, OTHERS, SUMS = range(14)
#: Answers, states and tables of sweep s have their kind plus s times this.
KINDS = 16


# ---- rows of arrays ---------------------------------------------------------------------------------------------------


def packed(**columns: np.ndarray) -> bytes:
    """Arrays as bytes: integers in the least width, and compressed; hashes and fractions as they are."""
    out = {}
    for k, x in columns.items():
        if x.dtype.kind in "iu" and x.dtype != np.uint64 and len(x) and x.min() >= 0:
            x = x.astype(np.min_scalar_type(int(x.max())))
        raw = np.ascontiguousarray(x).tobytes()
        out[k] = (x.dtype.str, x.shape, raw if x.dtype.itemsize == 8 else pa.compress(raw, "zstd", asbytes=True), len(raw))
    return pickle.dumps(out, 5)


def unpacked(data: bytes) -> dict[str, np.ndarray]:
    """What packed() got; integers are 64 bits wide."""
    out = {}
    for k, (kind, shape, raw, size) in pickle.loads(data).items():
        kind = np.dtype(kind)
        x = np.frombuffer(raw if kind.itemsize == 8 else pa.decompress(raw, size, "zstd", asbytes=True), kind).reshape(shape)
        out[k] = x.astype(np.int64) if kind.kind in "iu" and kind != np.uint64 else x
    return out


def rows_of(rows: list[tuple[int, int, bytes, list[int] | None]]) -> pa.Table:
    part, kind, data, sums = zip(*rows, strict=True) if rows else ((), (), (), ())
    return pa.Table.from_arrays([pa.array(part, pa.int32()), pa.array(kind, pa.int32()), pa.array(data, pa.binary()), pa.array(sums, pa.list_(pa.int64()))], ["part", "kind", "data", "sums"])


def groups(part: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
    """Each part with the places that have it, in order."""
    order = np.argsort(part.astype(np.uint16) if len(part) and part.max() < 1 << 16 else part, kind="stable")  # short integers go by counts
    heads = np.flatnonzero(np.diff(part[order], prepend=-1))
    for a, b in zip(heads.tolist(), [*heads[1:].tolist(), len(part)], strict=True) if len(heads) else ():
        yield int(part[order[a]]), order[a:b]


def blobs(table: pa.Table, kind: int, sweep: int = 0) -> Iterator[dict[str, np.ndarray]]:
    """What rows of a kind hold; of a sweep, where sweeps have it."""
    for k, data in zip(table.column("kind").to_pylist(), table.column("data"), strict=True):
        if k == kind + sweep * KINDS:
            yield unpacked(data.as_py())


def runs(x: np.ndarray) -> np.ndarray:
    """Where values other than the one before begin."""
    return np.flatnonzero(np.concatenate([np.ones(min(1, len(x)), bool), x[1:] != x[:-1]]))


class Places:
    """Places in a sorted array of hashes, -1 where one is not there. Their first bits lead to the place or near it."""

    def __init__(self, of: np.ndarray):
        bits = max(1, len(of).bit_length())
        self.of, self.shift = of, _U(64 - bits)
        self.first = np.zeros((1 << bits) + 1, np.int32 if len(of) < 1 << 31 else np.int64)
        np.cumsum(np.bincount((of >> self.shift).view(np.int64), minlength=1 << bits), out=self.first[1:])

    def __call__(self, x: np.ndarray) -> np.ndarray:
        if not len(self.of):
            return np.full(len(x), -1)
        slot = (x >> self.shift).view(np.int64)
        at, end = self.first[slot].astype(np.int64), self.first[slot + 1]
        hit = self.of[np.minimum(at, len(self.of) - 1)] == x
        out = np.where(hit, at, -1)
        on = np.flatnonzero(~hit & (end - at > 1))
        while len(on):
            at[on] += 1
            hit = self.of[at[on]] == x[on]
            out[on[hit]] = at[on[hit]]
            on = on[~hit & (at[on] + 1 < end[on])]
        return out


def word_part(h: np.ndarray, n: int) -> np.ndarray:
    return ((words.mix(h) >> _U(32)) % _U(n)).astype(np.int64)


# ---- tokens and pairs -------------------------------------------------------------------------------------------------


def laid_out(w: words.Words) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """All tokens in order, each text's end after its words: hashes, the rooms they sit in, their texts, and where texts begin."""
    n = len(w.first) - 1
    v = np.full(len(w.starts) + n, END)
    row = w.rows
    v[np.arange(len(w.starts)) + row] = w.hashes()
    heads = w.first[:-1] + np.arange(n)
    u = np.empty_like(v)
    u[1:] = v[:-1]
    u[heads] = START
    return v, u, np.repeat(np.arange(n), w.counts + 1), heads


def pair_key(v: np.ndarray, u: np.ndarray) -> np.ndarray:
    return words.mix(v * words._GRAM + u)


class Parts:
    """Where pairs are: a room is in one part, or with some of its words in each of several."""

    def __init__(self, n: int, hot: np.ndarray, slices: np.ndarray, names: np.ndarray | None = None):
        """hot: sorted hashes of the rooms that are split, and into how many slices. names: of the parts in tables, 0 to n - 1 by default."""
        self.n, self.hot, self.slices = n, hot, slices
        self.names = np.arange(n) if names is None else names

    def split(self, u: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Numbers of split rooms (0 for others) and which are."""
        at = np.minimum(np.searchsorted(self.hot, u), max(0, len(self.hot) - 1))
        return at, self.hot[at] == u if len(self.hot) else np.zeros(len(u), bool)

    def of(self, u: np.ndarray, v: np.ndarray) -> np.ndarray:
        at, on = self.split(u)
        part = word_part(u + words._STEP, self.n)
        if on.any():
            part[on] = (part[on] + word_part(v[on] + words._GRAM, 1 << 30) % self.slices[at[on]]) % self.n
        return self.names[part]

    def home(self, h: np.ndarray) -> np.ndarray:
        """The parts of words, or of documents."""
        return self.names[word_part(h, self.n)]


def _before(text: str):
    """How often each word (or start) of a task's texts is a room."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo, hi in words.slices(batch.column(text)):
                u, n = np.unique(laid_out(words.split(batch.column(text).slice(lo, hi - lo), lower=True))[1], return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array(u.view(np.int64)), pa.array(n)], ["u", "n"])

    return run


def names_of(spark: SparkSession, n: int) -> np.ndarray:
    """n numbers that Spark deals to different shuffle partitions, or as evenly as there are partitions."""
    deal = int(spark.conf.get("spark.sql.shuffle.partitions"))
    to = spark.range(0, 8 * (n + deal), 1, 1).select(F.pmod(F.hash(F.col("id").cast("int")), F.lit(deal)).alias("to")).toArrow().column("to").to_numpy()
    order = np.argsort(to, kind="stable")
    heads = runs(to[order])
    nth = np.empty(len(to), np.int64)
    nth[order] = np.arange(len(to)) - np.repeat(heads, np.diff(np.append(heads, len(to))))
    return np.sort(np.argsort(nth, kind="stable")[:n])


def parts_of(docs: DataFrame, text: str) -> Parts:
    """About as many parts as 32 MB of input make; rooms with more than half a part's share of tokens are split."""
    split = int(docs.sparkSession._jsparkSession.sessionState().conf().filesMaxPartitionBytes())
    n = max(16, docs.rdd.getNumPartitions() * max(1, split >> 25))
    some = docs.where(F.pmod(F.xxhash64(F.col(text)), F.lit(HOT_SAMPLE)) == 0).select(text)
    counts = written(some.mapInArrow(_before(text), "u long, n long").groupBy("u").agg(F.sum("n").alias("n")), "rooms")
    total = counts.agg(F.sum("n")).first()[0] or 0
    hot = sorted((np.int64(r["u"]).view(np.uint64), -(-2 * n * r["n"] // total)) for r in counts.where(F.col("n") * (2 * n) > total).collect())  # at most 2 n rooms
    forget(counts)
    return Parts(n, np.array([h for h, _ in hot], np.uint64), np.array([min(k, n) for _, k in hot], np.int64), names_of(docs.sparkSession, n))


def _counted(shared, text: str):
    """Pairs of training tokens, summed in the task over AT_ONCE tokens."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts, waiting, size = shared.value, [], 0
        sparing()

        def out() -> pa.RecordBatch:
            v = np.concatenate([x for x, _ in waiting])
            heads = np.concatenate([x for _, x in waiting])
            known, iv = np.unique(v, return_inverse=True)
            iu = np.empty_like(iv)
            iu[1:] = iv[:-1]
            iu[heads] = len(known)
            known = np.append(known, START)
            pair, n = np.unique(iu * len(known) + iv, return_counts=True)
            iu, iv = np.divmod(pair, len(known))
            rows = []
            for part, own in groups(parts.of(known[iu], known[iv])):
                w, at = np.unique(iv[own], return_inverse=True)
                u, sizes = np.unique(iu[own], return_counts=True)
                rows.append((part, COUNTED, packed(u=known[u], size=sizes, w=known[w], at=at, n=n[own]), None))
            return rows_of(rows).combine_chunks().to_batches()[0]

        for batch in batches:
            for lo, hi in words.slices(batch.column(text)):
                v, _, _, heads = laid_out(words.split(batch.column(text).slice(lo, hi - lo), lower=True))
                waiting.append((v, heads + size))
                size += len(v)
                if size >= AT_ONCE:
                    yield out()
                    waiting, size = [], 0
        if waiting:
            yield out()
        del waiting
        give_back()

    return run


def _joined(table: pa.Table) -> pa.Table:
    """A part's pairs. PAIRS has its words and rooms, each with its tokens and its pairs of one token, and the pairs of more."""
    part, own = table.column("part")[0].as_py(), list(blobs(table, COUNTED))
    del table
    u, iu = np.unique(np.concatenate([x["u"] for x in own]), return_inverse=True)
    w, iw = np.unique(np.concatenate([x["w"] for x in own]), return_inverse=True)
    iu = np.repeat(iu, np.concatenate([x.pop("size") for x in own]))
    offsets = np.cumsum([0, *(len(x["w"]) for x in own)])
    iu *= len(w)
    iu += iw[np.concatenate([x.pop("at") + at for x, at in zip(own, offsets, strict=False)])]
    n = np.concatenate([x.pop("n").astype(np.int32) for x in own])  # a task counts AT_ONCE tokens, or a text, at once
    del own, iw
    order = np.argsort(iu)
    iu, n = iu[order], n[order]
    del order
    heads = runs(iu)
    n, iu = np.add.reduceat(n, heads, dtype=np.int64), iu[heads]
    del heads
    iu, iw = np.divmod(iu, len(w))
    one = n == 1
    count = lambda at, size, x=None: np.bincount(at, x, size).astype(np.int64)
    pairs = packed(u=u, w=w, customers=count(iu, len(u), n), count=count(iw, len(w), n), ones_u=count(iu[one], len(u)), ones_w=count(iw[one], len(w)), size=count(iu[~one], len(u)), at=iw[~one], n=n[~one])
    return rows_of([(part, PAIRS, pairs, [int(one.sum()), int((n == 2).sum())]), (part, ONES, packed(size=count(iu[one], len(u)), at=iw[one]), None)])


# ---- seating ----------------------------------------------------------------------------------------------------------


def log_gamma(x: np.ndarray) -> np.ndarray:
    """For x >= 1."""
    y = x + 6.0
    product = x * (x + 1) * (x + 2) * (x + 3) * (x + 4) * (x + 5)
    return (y - 0.5) * np.log(y) - y + 0.91893853320467274 + 1 / (12 * y) - 1 / (360 * y**3) + 1 / (1260 * y**5) - np.log(product)


def _draws(seeds, k) -> np.ndarray:
    """One number between 0 and 1 for each seed and customer k."""
    return ((words.mix(seeds + np.asarray(k, np.uint64) * words._STEP) >> _U(11)).astype(np.float64) + 0.5) * 2.0**-53


def _seated_alone(made: float, customers: int, new: float, discount: float, seed: np.uint64) -> float:
    """The customers of one dish after the first ONE_BY_ONE. Customer k opens a table if draw * (k - discount * tables + new) < new;
    most cannot, however many tables there were by then, so the loop has little more turns than tables."""
    for at in range(ONE_BY_ONE, customers, CHUNK):
        k = np.arange(at, min(customers, at + CHUNK))
        short = k + new - new / _draws(seed, k)  # a table opens if this is below discount * tables
        most = made + len(k)
        while (upper := made + np.count_nonzero(short < discount * most)) < most:
            most = upper
        for x in short[short < discount * most].tolist():
            made += x < discount * made
    return made


def _seated_together(made: np.ndarray, customers: np.ndarray, new: np.ndarray, discount: float, seeds: np.ndarray) -> list[float]:
    """_seated_alone of several dishes with one call for all their customers."""
    sizes = customers - ONE_BY_ONE
    dish = np.repeat(np.arange(len(sizes)), sizes)
    k = np.arange(len(dish)) - np.repeat(np.cumsum(sizes) - sizes - ONE_BY_ONE, sizes)
    weight = np.repeat(new, sizes)
    short = k + weight - weight / _draws(np.repeat(seeds, sizes), k)
    most, fewer = None, made + sizes
    while most is None or fewer.sum() < 0.9 * most.sum():
        most = fewer
        on = np.flatnonzero(short < (discount * most)[dish])
        short, dish = short[on], dish[on]
        fewer = made + np.bincount(dish, minlength=len(made))
    out = made.tolist()
    for i, x in zip(dish.tolist(), short.tolist(), strict=True):
        out[i] += x < discount * out[i]
    return out


def seat(customers: np.ndarray, new: np.ndarray, discount: float, seeds: np.ndarray) -> np.ndarray:
    """Tables of dishes with so many customers, where opening a table has weight `new`. seeds: 64 bits for each dish."""
    made = np.minimum(customers, 1).astype(np.float64)
    on = np.flatnonzero(customers > 1)
    on = on[np.argsort(ONE_BY_ONE + 1 - np.minimum(customers[on], ONE_BY_ONE + 1).astype(np.uint8), kind="stable")]  # the most first: those with more customers to come lead
    for lo in range(0, len(on), AT_A_TIME):
        own = on[lo : lo + AT_A_TIME]
        left = np.cumsum(np.bincount(np.minimum(customers[own], ONE_BY_ONE), minlength=ONE_BY_ONE + 1)[::-1])[::-1].tolist()  # dishes with n customers or more
        t, weight, seed = np.ones(len(own)), new[own], seeds[own]
        for n in range(1, ONE_BY_ONE):
            if not (k := left[n + 1]):
                break
            t[:k] += _draws(seed[:k], n) * (n - discount * t[:k] + weight[:k]) < weight[:k]
        made[own] = t
    on = on[: np.count_nonzero(customers > ONE_BY_ONE)]
    few = on[customers[on] <= CHUNK]
    at = np.cumsum(customers[few] - ONE_BY_ONE) // CHUNK
    for some in np.split(few, np.flatnonzero(np.diff(at)) + 1) if len(few) else ():
        made[some] = _seated_together(made[some], customers[some], new[some], discount, seeds[some])
    on = on[customers[on] > CHUNK]
    for i in on.tolist():
        made[i] = _seated_alone(made[i], min(int(customers[i]), MOST_ALONE), float(new[i]), discount, seeds[i])
    on = on[customers[on] > MOST_ALONE]
    at, n = np.full(len(on), float(MOST_ALONE)), MOST_ALONE
    while len(on):
        # k more join with probability G(a + k) G(a + b) / (G(a) G(a + k + b)); one opens a table after the last k with more than a draw.
        a, b, left = at - discount * made[on], new[on], customers[on] - at
        goal = np.log(_draws(seeds[on], n)) + log_gamma(a) - log_gamma(a + b)
        above = lambda k: log_gamma(a + k) - log_gamma(a + k + b) > goal  # noqa: B023, E731
        low, high, kept = np.zeros(len(on)), left.astype(np.float64), above(left)
        while (~kept & (high - low > 1)).any():
            middle = np.floor((low + high) / 2)
            up = above(middle)
            low, high = np.where(up, middle, low), np.where(up, high, middle)
        made[on] += ~kept
        at = at + low + 1
        stay = ~kept & (at < customers[on])
        on, at, n = on[stay], at[stay], n + 1
    return made


def discount_of(n1: float, n2: float) -> float:
    return min(0.95, max(0.05, n1 / (n1 + 2 * n2) if n1 + n2 else 0.5))


class Level:
    """What a sweep leaves that all must know: numbers of the word restaurant and the tables of split rooms."""

    def __init__(self, v: int, discounts: tuple[float, float], customers: int, tables: int, split: np.ndarray):
        self.v, self.discounts, self.customers, self.tables, self.split = v, discounts, customers, tables, split

    def base(self) -> float:
        return (STRENGTH + self.discounts[0] * self.tables) / (self.v + 1)

    def words(self, customers: np.ndarray, tables: np.ndarray) -> np.ndarray:
        """Probabilities that the word restaurant gives; a word without customers is unknown."""
        return (customers - self.discounts[0] * tables + self.base()) / (self.customers + STRENGTH)

    def rooms(self, tables: np.ndarray, customers: np.ndarray) -> np.ndarray:
        """What rooms give to a word through the word restaurant."""
        return (STRENGTH + self.discounts[1] * tables) / (customers + STRENGTH)


class Part:
    """A part's pairs of more tokens than one, and its words and rooms."""

    def __init__(self, table: pa.Table, parts: Parts):
        self.table, self.parts = table, parts
        x = next(blobs(table, PAIRS))
        self.u, self.w, self.customers, self.count, self.ones_u, self.ones_w, self.size = (x[k] for k in ("u", "w", "customers", "count", "ones_u", "ones_w", "size"))
        self.iu, self.iw, self.n = np.repeat(np.arange(len(self.u)), x["size"]), x["at"], x["n"]
        self.home = list(groups(parts.home(self.w)))
        self.hot, self.is_hot = parts.split(self.u)

    def answers(self, sweep: int, *names: str) -> tuple[np.ndarray, ...]:
        """What word parts answered in a sweep, for each of its words."""
        out = tuple(np.zeros(len(self.w), np.int64) for _ in names)
        where = dict(self.home)
        for x in blobs(self.table, ANSWER, sweep):
            for o, k in zip(out, names, strict=True):
                o[where[int(x["from"][0])]] = x[k]
        return out

    def tables(self, sweep: int, split: np.ndarray) -> np.ndarray:
        """Tables of its rooms after a sweep; split rooms' ones are known to all."""
        out = next(blobs(self.table, ROOMS, sweep))["t"].copy()
        out[self.is_hot] = split[self.hot[self.is_hot]]
        return out

    def seated(self, sweep: int, before: Level) -> np.ndarray:
        """Tables of its pairs in a sweep."""
        p = before.words(*self.answers(sweep - 1, "c", "t"))
        new = (STRENGTH + before.discounts[1] * self.tables(sweep - 1, before.split))[self.iu] * p[self.iw]
        return seat(self.n, new, before.discounts[1], words.mix(pair_key(self.w[self.iw], self.u[self.iu]) + _U(sweep)))


def _told(shared, sweep: int):
    """A part's sweep: what it tells the word parts, and the tables of its rooms. Sweep 0: one table for each pair."""

    def run(table: pa.Table) -> pa.Table:
        parts, before = shared.value
        own = Part(table, parts)
        t = own.seated(sweep, before) if sweep else np.ones(len(own.n))
        rooms, dishes = own.ones_u + np.bincount(own.iu, t, len(own.u)).astype(np.int64), own.ones_w + np.bincount(own.iw, t, len(own.w)).astype(np.int64)
        part = table.column("part")[0].as_py()
        more = {} if sweep else {"count": own.count}
        out = [(q, TOLD, packed(w=own.w[at], c=dishes[at], source=np.array([part]), **{k: x[at] for k, x in more.items()}), None) for q, at in own.home]
        out.append((part, ROOMS + sweep * KINDS, packed(t=rooms), None))
        if len(parts.hot):
            on = np.flatnonzero(own.is_hot)
            sums = np.zeros((2, len(parts.hot)), np.int64)
            sums[:, own.hot[on]] = rooms[on], own.customers[on]
            out.append((part, SPLIT, b"", sums.ravel().tolist()))
        return rows_of(out)

    return tidy(run)


def _answered(shared, sweep: int):
    """A word part's sweep: it seats the word restaurant and answers the parts."""

    def run(table: pa.Table) -> pa.Table:
        parts, before = shared.value
        kinds = table.column("kind").to_numpy()
        passed = table.filter(pa.array((kinds == ROOMS + sweep * KINDS) | (kinds == SPLIT)))
        own = list(blobs(table, TOLD))
        if not own:
            return passed
        w, at = np.unique(np.concatenate([x["w"] for x in own]), return_inverse=True)
        c = np.bincount(at, np.concatenate([x["c"] for x in own]), len(w)).astype(np.int64)
        t = (seat(c, np.full(len(w), before.base()), before.discounts[0], words.mix(w + _U(sweep << 8))) if sweep else np.minimum(c, 1)).astype(np.int64)
        state = {"c": c, "t": t}
        if not sweep:
            state["count"] = np.bincount(at, np.concatenate([x["count"] for x in own]), len(w)).astype(np.int64)
        q, out, end = table.column("part")[0].as_py(), [], 0
        for x in own:
            mine = at[end : (end := end + len(x["w"]))]
            out.append((int(x["source"][0]), ANSWER + sweep * KINDS, packed(**{"from": np.array([q])}, **{k: s[mine] for k, s in state.items()}), None))
        known = [len(w), int(state["count"].sum())] if not sweep else [0, 0]
        out.append((q, STATE + sweep * KINDS, packed(**state, **({} if sweep else {"w": w})), [int(c.sum()), int(t.sum()), int((c == 1).sum()), int((c == 2).sum()), *known]))
        return pa.concat_tables([rows_of(out), passed])

    return tidy(run)


def summed(rows: DataFrame, kind: int) -> np.ndarray:
    """Sums of the numbers that rows of a kind carry."""
    got = rows.where(F.col("kind") == kind).select(F.posexplode("sums").alias("k", "n")).groupBy("k").agg(F.sum("n").alias("n")).collect()
    out = np.zeros(len(got), np.int64)
    for r in got:
        out[r["k"]] = r["n"]
    return out


class Fitted:
    """levels: after each sweep; tokens; customers of split rooms; pairs and sweeps as written."""

    def __init__(self, parts: Parts, pairs: DataFrame):
        self.parts, self.pairs = parts, pairs
        self.levels: list[Level | None] = []
        self.sweeps: list[DataFrame] = []
        self.tokens, self.split_customers = 0, np.zeros(0, np.int64)

    def of(self, *sweeps: int) -> DataFrame:
        """The parts' pairs with what those sweeps answered."""
        out = self.pairs.where(F.col("kind") == PAIRS)
        for s in sweeps:
            out = out.union(self.sweeps[s].where(F.col("kind").isin(ANSWER + s * KINDS, ROOMS + s * KINDS)))
        return out


def fit(docs: DataFrame, text_column: str = "text") -> Fitted:
    spark = docs.sparkSession
    parts = parts_of(docs, text_column)
    counted = docs.select(text_column).mapInArrow(_counted(spark.sparkContext.broadcast(parts), text_column), BLOB)
    model = Fitted(parts, written(counted.groupBy("part").applyInArrow(tidy(_joined), BLOB), "pairs"))
    release(spark)
    few = summed(model.pairs, PAIRS)
    for s in range(LAST + 1):
        shared = spark.sparkContext.broadcast((parts, model.levels[-1] if s else None))
        told = model.of(*([s - 1] if s else [])).groupBy("part").applyInArrow(_told(shared, s), BLOB)
        done = written(told.groupBy("part").applyInArrow(_answered(shared, s), BLOB), "sweep")
        del told
        release(spark)
        sums, split = summed(done, STATE + s * KINDS), summed(done, SPLIT)
        sums = sums if len(sums) else np.zeros(6, np.int64)
        if not s:
            v, model.tokens, discounts = int(sums[4]), int(sums[5]), (discount_of(*sums[2:4]), discount_of(*(few if len(few) else (0, 0))))
            model.split_customers = split[len(parts.hot) :]
        model.levels.append(Level(v, discounts, int(sums[0]), int(sums[1]), split[: len(parts.hot)]))
        model.sweeps.append(done)
        if 0 < s - 1 < BURN_IN:
            forget(model.sweeps[s - 1])
    return model


# ---- probabilities ----------------------------------------------------------------------------------------------------


def _modelled(shared, least: int):
    """A part's pairs with their log10 probabilities; those of `least` tokens or more once more; what its rooms give."""

    def run(table: pa.Table) -> pa.Table:
        parts, levels, split_customers = shared.value
        own = Part(table, parts)
        (counts,) = own.answers(0, "count")
        ones = next(blobs(table, ONES))
        one_u, one_w = np.repeat(np.arange(len(own.u)), ones["size"]), ones.pop("at")
        customers = own.customers.copy()
        customers[own.is_hot] = split_customers[own.hot[own.is_hot]]
        p, q, given = np.zeros(len(own.n)), np.zeros(len(one_u)), []
        for s in range(BURN_IN + 1, LAST + 1):
            level, d = levels[s], levels[s].discounts[1]
            word, room = level.words(*own.answers(s, "c", "t")), level.rooms(own.tables(s, level.split), customers)
            p += (own.n - d * own.seated(s, levels[s - 1])) / (customers[own.iu] + STRENGTH) + room[own.iu] * word[own.iw]
            for lo in range(0, len(q), CHUNK):
                u, w = one_u[lo : lo + CHUNK], one_w[lo : lo + CHUNK]
                q[lo : lo + CHUNK] += ((1 - d) / (customers + STRENGTH))[u] + room[u] * word[w]
            given.append(room)
        p, q = np.log10(p / SAMPLES), np.log10(q / SAMPLES)
        lp = np.concatenate([p, q])
        del q
        lp = np.rint(np.multiply(lp, -SCALE, out=lp), out=lp).astype(np.int32)
        order, iw = np.concatenate([own.iu, one_u]), np.concatenate([own.iw, one_w])
        del one_u, one_w
        order *= len(own.w)
        order += iw
        order = np.argsort(order)
        iw, lp = iw[order], lp[order]
        del order
        part = table.column("part")[0].as_py()
        out = [(part, MODEL, packed(u=own.u, w=own.w, count=counts, size=own.size + ones["size"], at=iw, lp=lp), None)]
        del iw, lp
        often = own.n >= least
        out.append((part, FREQUENT, packed(key=pair_key(own.w[own.iw[often]], own.u[own.iu[often]]), lp=p[often].astype(np.float32)), None))
        given = np.stack(given, axis=1).astype(np.float32)
        out += [(to, GIVEN, packed(u=own.u[at], room=given[at]), None) for to, at in groups(parts.home(own.u))]
        return rows_of(out)

    return tidy(run)


def _types(shared):
    """c, what the word as a room gives, and what it gets from the word restaurant, in each sample."""

    def run(table: pa.Table) -> pa.Table:
        levels = shared.value
        states = {s: x for s in (0, *range(BURN_IN + 1, LAST + 1)) for x in blobs(table, STATE, s)}
        rooms = list(blobs(table, GIVEN))
        w = states[0]["w"] if states else np.zeros(0, np.uint64)
        u, first = np.unique(np.concatenate([np.zeros(0, np.uint64), *(x["u"] for x in rooms)]), return_index=True)
        h = np.union1d(w, u)
        at, place = np.searchsorted(h, w), np.searchsorted(h, u)
        c = np.zeros(len(h), np.int64)
        room, word = np.ones((len(h), SAMPLES)), np.zeros((len(h), SAMPLES))
        if len(u):
            room[place] = np.concatenate([x["room"] for x in rooms])[first]
        for i, s in enumerate(range(BURN_IN + 1, LAST + 1)):
            word[:, i] = levels[s].words(0, 0)
            if states:
                word[at, i] = levels[s].words(states[s]["c"], states[s]["t"])
        if states:
            c[at] = states[0]["count"]
        return pa.Table.from_arrays([pa.array(h.view(np.int64)), pa.array(c), *(pa.array(x[:, i].astype(np.float32)) for x in (room, word) for i in range(SAMPLES))], ["h", "c", *_GIVES])

    return tidy(run)


_GIVES = [f"{x}{i}" for x in ("room", "word") for i in range(SAMPLES)]


def _of_tokens(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """How many pairs have so many tokens."""
    for batch in batches:
        for data in batch.column("data"):
            n, pairs = np.unique(unpacked(data.as_py())["n"], return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(n), pa.array(pairs)], ["n", "pairs"])


def _least(counts: DataFrame, n: str, k: str, most: int) -> int:
    """The least n such that all with n or more, k of each, are at most `most`."""
    least, upto = 1 << 62, 0
    for r in counts.orderBy(F.desc(n)).toLocalIterator():
        if (upto := upto + r[k]) > most:
            break
        least = r[n]
    return least


def probabilities(model: Fitted, most_pairs: int) -> tuple[DataFrame, DataFrame]:
    """Rows MODEL and FREQUENT of the parts, and types (h, c, room0.., word0..); written."""
    spark = model.pairs.sparkSession
    counts = model.pairs.where(F.col("kind") == PAIRS).select("data").mapInArrow(_of_tokens, "n long, pairs long").groupBy("n").agg(F.sum("pairs").alias("pairs"))
    least = _least(counts, "n", "pairs", most_pairs)
    rows = model.of(0, *range(BURN_IN, LAST + 1)).union(model.pairs.where(F.col("kind") == ONES))
    shared = spark.sparkContext.broadcast((model.parts, model.levels, model.split_customers))
    done = written(rows.groupBy("part").applyInArrow(_modelled(shared, least), BLOB), "model")
    release(spark)
    rows = done.where(F.col("kind") == GIVEN)
    for s in (0, *range(BURN_IN + 1, LAST + 1)):
        rows = rows.union(model.sweeps[s].where(F.col("kind") == STATE + s * KINDS))
    schema = "h long, c long, " + ", ".join(f"{x} float" for x in _GIVES)
    types = written(rows.groupBy("part").applyInArrow(_types(spark.sparkContext.broadcast(model.levels)), schema), "types")
    for x in (model.pairs, model.sweeps[0], *model.sweeps[BURN_IN:]):
        forget(x)
    release(spark)
    return done, types


# ---- scores -----------------------------------------------------------------------------------------------------------


def held_out(doc_id: Column, folds: int, fold: int) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string")) % folds == fold, F.lit(False))


class Shared:
    """What is broadcast: the most frequent words (and the end and the start), with what they give."""

    def __init__(self, parts: Parts, log_all: float, h, room, word):
        self.parts, self.log_all, self.h, self.room, self.word = parts, log_all, h, room, word


class Often:
    """What is broadcast to those who read texts: counts of the most frequent words, and the most frequent pairs."""

    def __init__(self, c, keys, lp):
        self.c, self.keys, self.lp = c, keys, lp

    def ready(self, known: Shared) -> Often:
        """With what follows from it, which is not broadcast. Place -1, the last one, gives nothing."""
        if not hasattr(self, "words"):
            self.words, self.pairs = Places(known.h), Places(self.keys)
            self.base = np.append(np.log10(self.c + 1.0) - known.log_all, 0.0)
            self.trained = np.append(self.c > 0, False)
            self.lp = np.append(self.lp, np.float32(0))
        return self


SUM_NAMES = ("doc", "rows", "tokens", "known", "base", "s")


def _sums_to(parts: Parts, doc: np.ndarray, **x: np.ndarray) -> list[tuple]:
    return [(to, SUMS, packed(doc=doc[at].view(np.uint64), **{k: v[at] for k, v in x.items()}), None) for to, at in groups(parts.home(doc.view(np.uint64)))]


def _asked(shared, frequent, text: str):
    """Texts' sums over what is broadcast, and their other tokens by part."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = shared.value
        often = frequent.value.ready(known)
        waiting, sums, size, texts = [], [], 0, 0
        start = often.words(np.array([START]))[0]
        sparing()

        def out() -> Iterator[pa.RecordBatch]:
            every, *own = (np.concatenate(x) for x in zip(*sums, strict=True))
            rows = _sums_to(known.parts, every, **dict(zip(SUM_NAMES[1:], own, strict=True)))
            doc, u, v, iu, iv, m, part = (np.concatenate(x) for x in zip(*waiting, strict=True))
            both = (iu >= 0) & (iv >= 0)
            for kind, on in ((ASKED, np.flatnonzero(both)), (OTHERS, np.flatnonzero(~both))):
                if kind == ASKED:
                    on = on[np.argsort(iu[on].astype(np.int64) * len(known.h) + iv[on])]
                for to, at in groups(part[on]):
                    at = on[at]
                    docs, place = np.unique(doc[at], return_inverse=True)
                    x = {"docs": every[docs].view(np.uint64), "doc": place, "m": m[at]}
                    if kind == ASKED:
                        heads = runs(iu[at])
                        x |= {"u": iu[at[heads]], "size": np.diff(np.append(heads, len(at))), "v": iv[at]}
                    else:
                        x |= {"u": u[at], "v": v[at], "open": (iv[at] < 0).astype(np.uint8)}
                    rows.append((to, kind, packed(**x), None))
            yield from rows_of(rows).combine_chunks().to_batches()

        for batch in batches:
            for lo, hi in words.slices(batch.column(text), SLICE_BYTES):
                v, u, row, heads = laid_out(words.split(batch.column(text).slice(lo, hi - lo), lower=True))
                at = often.words(v)
                near = np.empty_like(at)
                near[1:] = at[:-1]
                near[heads] = start
                n = hi - lo
                key = pair_key(v, u)
                pair = often.pairs(key)
                sums.append((batch.column(f"{INNER}doc").slice(lo, n).to_numpy(), np.ones(n, np.int64), np.bincount(row, minlength=n), np.bincount(row, often.trained[at], n).astype(np.int64), np.bincount(row, often.base[at], n), np.bincount(row, often.lp[pair], n)))
                rest = np.flatnonzero(pair < 0)
                same = key[rest] + row[rest].astype(np.uint64) * words._STEP
                order = np.argsort(same)
                one = runs(same[order])
                m = np.diff(np.append(one, len(order)))
                one = rest[order[one]]
                waiting.append((row[one] + texts, u[one], v[one], near[one].astype(np.int32), at[one].astype(np.int32), m, known.parts.of(u[one], v[one])))
                size, texts = size + len(one), texts + n
                if size >= SENT or texts >= SENT_TEXTS:
                    yield from out()
                    waiting, sums, size, texts = [], [], 0, 0
        if sums:
            yield from out()
        del waiting, sums
        give_back()

    return run


SCORED = f"{BLOB}, doc long, u long, v long, m long, open boolean"


def _given(shared):
    """Sums over the tokens of a part, by document; tokens of unseen pairs with words that are not broadcast remain."""

    def run(table: pa.Table) -> pa.Table:
        known, kinds = shared.value, table.column("kind").to_numpy()

        def more(rows: pa.Table, *rest) -> pa.Table:
            rest = [pa.array(r) for r in rest] or [pa.nulls(rows.num_rows, k) for k in (*[pa.int64()] * 4, pa.bool_())]
            return pa.Table.from_arrays([*rows.columns, *rest], [*rows.column_names, "doc", "u", "v", "m", "open"])

        out = [more(table.filter(pa.array(kinds == SUMS)))]
        x = next(blobs(table, MODEL), None) or {k: np.zeros(0, np.uint64 if k in "uw" else np.int64) for k in ("u", "w", "count", "size", "at", "lp")}
        u, w, count, lp = x["u"], x["w"], x["count"], x.pop("lp") / -SCALE
        keys = np.repeat(np.arange(len(u)) * len(w), x["size"])
        keys += x.pop("at")
        rooms, dishes = Places(u), Places(w)
        of_u, of_w = rooms(known.h), dishes(known.h)
        docs, sums = [], []

        def found(iu, iw):
            if not len(keys):
                return np.full(len(iu), -1), np.zeros(len(iu), bool)
            asked = np.where((iu >= 0) & (iw >= 0), iu * len(w) + iw, -1)
            at = np.minimum(np.searchsorted(keys, asked), len(keys) - 1)
            return at, keys[at] == asked

        for x in blobs(table, ASKED):
            nu, nv = np.repeat(x["u"], x["size"]), x["v"]
            at, hit = found(of_u[nu], of_w[nv])
            s = np.empty(len(at))
            s[hit] = lp[at[hit]]
            s[~hit] = np.log10((known.room[nu[~hit]].astype(np.float64) * known.word[nv[~hit]]).mean(axis=1))
            size = len(x["docs"])
            docs.append(x["docs"].view(np.int64))
            sums.append((np.bincount(x["doc"], x["m"] * s, size), np.zeros(size), np.zeros(size)))
        for x in blobs(table, OTHERS):
            iw = dishes(x["v"])
            at, hit = found(rooms(x["u"]), iw)
            size, m, told = len(x["docs"]), x["m"], hit & (x["open"] > 0)
            docs.append(x["docs"].view(np.int64))
            sums.append((np.bincount(x["doc"][hit], m[hit] * lp[at[hit]], size), np.bincount(x["doc"][told], m[told] * (np.log10(count[iw[told]] + 1.0) - known.log_all), size), np.bincount(x["doc"][told], m[told], size)))
            if not hit.all():
                left = rows_of([(-1, OTHERS, None, None)] * int((~hit).sum()))
                out.append(more(left, x["docs"].view(np.int64)[x["doc"][~hit]], x["u"][~hit].view(np.int64), x["v"][~hit].view(np.int64), m[~hit], x["open"][~hit] > 0))
        if docs:
            doc, at = np.unique(np.concatenate(docs), return_inverse=True)
            s, base, seen = (np.bincount(at, np.concatenate(x), len(doc)) for x in zip(*sums, strict=True))
            nobody = np.zeros(len(doc), np.int64)
            out.append(more(rows_of(_sums_to(known.parts, doc, rows=nobody, tokens=nobody, known=seen.astype(np.int64), base=base, s=s))))
        return pa.concat_tables(out).combine_chunks()

    return tidy(run)


def _totals(table: pa.Table) -> pa.Table:
    own = list(blobs(table, SUMS))
    doc, at = np.unique(np.concatenate([x["doc"] for x in own]), return_inverse=True)
    sums = [np.bincount(at, np.concatenate([x[k] for x in own]), len(doc)) for k in SUM_NAMES[1:]]
    return pa.Table.from_arrays([pa.array(doc.view(np.int64)), *(pa.array(x.astype(np.int64) if k in ("rows", "tokens", "known") else x) for k, x in zip(SUM_NAMES[1:], sums, strict=True))], list(SUM_NAMES))


def score_texts(docs: DataFrame, *, id_column="doc_id", text_column="text", keep: list[str] | None = None, folds: int = 7, fold: int = 2, most_head: int = MOST_HEAD, most_pairs: int = MOST_PAIRS) -> DataFrame:
    """keep (the id by default) with held_out, n_tokens, n_known, train_tokens, base_score, score and perplexity."""
    spark = docs.sparkSession
    made = ["held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score", "perplexity"]
    keep = [c for c in (keep or [id_column]) if c not in made]
    model = fit(docs.where(~held_out(F.col(id_column), folds, fold)), text_column)
    table, types = probabilities(model, most_pairs)
    level, parts = model.levels[-1], model.parts
    log_all = float(np.log10(model.tokens + level.v + 1))
    always = F.col("h").isin(int(END), int(START))
    least = _least(types.where(~always & (F.col("c") > 0)).groupBy("c").count(), "c", "count", most_head)
    head = types.where(always | (F.col("c") >= least)).toArrow().combine_chunks()
    column = lambda x: head.column(x).to_numpy()
    absent = [x for x in (END, START) if x not in column("h").view(np.uint64)]  # only without training texts
    h, c = np.append(column("h").view(np.uint64), np.array(absent, np.uint64)), np.append(column("c"), np.zeros(len(absent), np.int64))
    unknown = [float(model.levels[s].words(0, 0)) for s in range(BURN_IN + 1, LAST + 1)]
    gives = lambda x, other: np.concatenate([np.stack([column(f"{x}{i}") for i in range(SAMPLES)], axis=1), np.tile(np.array(other, np.float32), (len(absent), 1))])
    order = np.argsort(h)
    pairs = [unpacked(r["data"]) for r in table.where(F.col("kind") == FREQUENT).select("data").toLocalIterator()]
    keys, lp = (np.concatenate([np.zeros(0, k), *(x[f] for x in pairs)]) for f, k in (("key", np.uint64), ("lp", np.float32)))
    by = np.argsort(keys)
    shared = spark.sparkContext.broadcast(Shared(parts, log_all, h[order], gives("room", [1.0] * SAMPLES)[order], gives("word", unknown)[order]))
    frequent = spark.sparkContext.broadcast(Often(c[order], keys[by], lp[by]))
    keyed = docs.withColumn(f"{INNER}doc", F.xxhash64(F.col(id_column), F.col(text_column)))
    asked = keyed.select(text_column, f"{INNER}doc").mapInArrow(_asked(shared, frequent, text_column), BLOB)
    rows = asked.union(table.where(F.col("kind") == MODEL)).groupBy("part").applyInArrow(_given(shared), SCORED)
    rows = written(rows, "scored")
    forget(table)
    shared.unpersist()
    frequent.unpersist()
    del asked
    release(spark)
    # Unseen pairs with words beyond the broadcast: what the room and the word give comes by joins.
    rest = rows.where(F.col("kind") == OTHERS).select("doc", "u", "v", "m", "open")
    room = types.select(F.col("h").alias("u"), *[f"room{i}" for i in range(SAMPLES)])
    word = types.select(F.col("h").alias("v"), "c", *[f"word{i}" for i in range(SAMPLES)])
    met = rest.join(room, "u", "left").join(word, "v", "left")
    p = sum((F.coalesce(F.col(f"room{i}").cast("double"), F.lit(1.0)) * F.coalesce(F.col(f"word{i}").cast("double"), F.lit(unknown[i])) for i in range(SAMPLES)), F.lit(0.0)) / SAMPLES
    seen, count = F.col("open").cast("int") * F.col("m"), F.coalesce("c", F.lit(0))
    met = met.select("doc", F.lit(0).cast("long").alias("rows"), F.lit(0).cast("long").alias("tokens"), F.when(count > 0, seen).otherwise(0).cast("long").alias("known"), (seen * (F.log10(count + 1.0) - log_all)).alias("base"), (F.col("m") * F.log10(p)).alias("s"))
    totals = rows.where(F.col("kind") == SUMS).select("part", "kind", "data").groupBy("part").applyInArrow(tidy(_totals), "doc long, rows long, tokens long, known long, base double, s double")
    # Equal rows (same id and text) have equal sums; these are over all of them.
    every = totals.union(met).groupBy("doc").agg(*[F.sum(x).alias(x) for x in SUM_NAMES[1:]])
    each = lambda x: F.col(x) / F.col("rows")
    done = written(every.select(F.col("doc").alias(f"{INNER}d"), each("tokens").cast("long").alias("n_tokens"), each("known").cast("long").alias("n_known"), each("base").alias("base_score"), each("s").alias("score")), "scores")
    forget(rows)
    forget(types)
    out = keyed.select(*dict.fromkeys([*keep, id_column]), f"{INNER}doc").join(done, F.col(f"{INNER}doc") == F.col(f"{INNER}d"))
    return out.withColumns({"held_out": held_out(F.col(id_column), folds, fold), "train_tokens": F.lit(model.tokens).cast("long"), "perplexity": F.pow(F.lit(10.0), -F.col("score") / F.col("n_tokens"))}).select(*keep, *made)
