"""Toxicity: noisy-channel deobfuscation by Viterbi, then a score of the restored words.

Channel and language model. A token that may be disguised (a digit or symbol next to letters, a letter three times in a row, or
single letters in a row with spaces) becomes a lattice: a digit or symbol stands for itself, for letters that look like it, or
for nothing; a repeated letter may go; a space between single letters may go. Viterbi (the best paths for each three last
characters, at most BEAM of them) finds the likeliest letters under a character 4-gram model whose counts come from all texts;
other tokens have one path only. Counts are hashed into tables of fixed size, so they are broadcast.

Score. Features of a restored token are the token and its first 4, 5 and 6 letters. The log ratio of how many toxic and how
many other labelled documents have a feature is its weight; a token weighs as much as its best feature. A logistic regression
over a document's three heaviest tokens, the number of heavy tokens and the document's length gives the score. Both are fitted on
at most FIT_ROWS labelled rows of each class (the first by a hash of the id, equal texts once); the regression sees weights
without the document's own count (leave one out). Neither id, source, language nor label of a scored row is an input.

Defined cases: null and empty texts have no token and get the score of a document without heavy tokens. A null doc_id is not
held out and has no label. Labels that are null or other than 0 and 1 are not used; a document with both labels counts for both.
Without labels of both classes, all scores are the share of toxic labels (0 without labels). Repeated rows get equal scores.
Long texts are taken whole; of a token longer than all weighted words, decoding ends where the rest can no longer change a
feature. Other columns pass only if in `keep`. An empty table gives an empty table.
"""

from __future__ import annotations

import math
import re
import uuid
import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import tables, words
from .common import INNER, written

FIT_ROWS, THRESHOLD = 6000, 0.7
ORDER, TABLE_BITS = 4, 20
BEAM, HEAVY = 12, 2.5
#: A feature is in at least so many toxic documents of the sample.
MIN_DOCS = 2
#: Characters of a long token between looks whether the rest can change what counts.
LOOK_EVERY = 64
CACHE = 100_000
#: What a digit or symbol may stand for.
LOOKS_LIKE = {"0": "o", "1": "il", "2": "z", "3": "e", "4": "a", "5": "s", "6": "gb", "7": "t", "8": "b", "9": "g", "@": "a", "$": "s", "!": "i", "|": "il", "+": "t", "(": "c", "€": "e", "£": "l", "¡": "i", "*": "aeiou", "#": "h"}
#: Log probabilities of the channel.
SAME, ALIKE, GONE, DOUBLED, JOINED, APART = -3.0, -1.2, -2.5, -0.7, -0.5, -1.5
EDGE = ".,;:?\"'`()[]{}<>«»“”„…-_*#%&=/\\~^"
LATE = "!$|+@€£"
ODD = re.compile(r"[^\W\d_][\d\W_]|[\d\W_][^\W\d_]|(.)\1\1")
_U = np.uint64


#: What a worker keeps from task to task, of one model at a time.
_fits: dict[str, tuple[Channel, dict]] = {}
_scorers: dict[str, Scorer] = {}


# ---- character counts -------------------------------------------------------------------------------------------------


def _slots(grams: np.ndarray, n: int) -> np.ndarray:
    return (words.mix(grams + _U(n * 0x9E3779B97F4A7C15 & words.MASK)) >> _U(64 - TABLE_BITS)).astype(np.int64)


def _slot(gram: int, n: int) -> int:
    """_slots() of one gram, without arrays."""
    x = gram + n * 0x9E3779B97F4A7C15 & words.MASK
    x = (x ^ x >> 30) * 0xBF58476D1CE4E5B9 & words.MASK
    x = (x ^ x >> 27) * 0x94D049BB133111EB & words.MASK
    return (x ^ x >> 31) >> 64 - TABLE_BITS


def gram_counts(texts: pa.Array, into: np.ndarray) -> None:
    """Adds the counts of 1- to ORDER-grams of bytes, A-Z lower-cased, any white space as one space on either side of a word."""
    w = words.split(texts, lower=True)
    if not len(w.starts):
        return
    lens = w.ends - w.starts
    starts = np.cumsum(lens + 1) - lens
    text = np.full(int((lens + 1).sum()) + 1, 32, np.uint64)
    text[np.arange(int(lens.sum())) + np.repeat(starts - np.cumsum(lens) + lens, lens)] = w.data[w.solid]
    gram = text.copy()
    for n in range(1, ORDER + 1):
        if n > 1:
            gram = gram[1:] | text[: len(gram) - 1] << _U(8 * (n - 1))
        into[n - 1] += np.bincount(_slots(gram, n), minlength=1 << TABLE_BITS)


def _counts(text: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        _fits.clear()  # of models before
        _scorers.clear()
        table = np.zeros((ORDER, 1 << TABLE_BITS), np.int64)
        for batch in batches:
            for lo, hi in words.slices(batch.column(text)):
                gram_counts(batch.column(text).slice(lo, hi - lo), table)
        yield from tables.pieces(table)

    return run


def character_counts(docs: DataFrame, text_column: str = "text") -> bytes:
    """Counts over all rows, packed: ORDER tables of 2**TABLE_BITS, mostly zeros."""
    counts = tables.total(docs.select(text_column).mapInArrow(_counts(text_column), tables.SCHEMA), ORDER << TABLE_BITS)
    return zlib.compress(counts.tobytes(), 1)


# ---- decoding ---------------------------------------------------------------------------------------------------------


class Channel:
    """Restores tokens; packed: character_counts()."""

    def __init__(self, packed: bytes):
        table = np.frombuffer(zlib.decompress(packed), np.int64).reshape(ORDER, -1)
        self.table, self.total = np.minimum(table, 2**31 - 1).astype(np.int32), max(1, int(table[0].sum()))  # half the memory
        self.log = lru_cache(20_000)(self._log)

    def count(self, gram: bytes) -> int:
        n = len(gram)
        return int(self.table[n - 1, _slot(int.from_bytes(gram, "big"), n)])

    def _log(self, before: str, c: str) -> float:
        """Log probability of the character's bytes after the characters before; shorter contexts fill in."""
        out, context = 0.0, before.encode()
        for byte in c.encode():
            tail = context[-(ORDER - 1) :]
            p = 1 / 256
            for k in range(len(tail) + 1):
                part = tail[len(tail) - k :]
                n = self.count(part) if k else self.total
                p = (self.count(part + bytes([byte])) + 4 * p) / (n + 4)
            out += math.log(max(p, 1e-12))
            context += bytes([byte])
        return out

    def restore(self, token: str, enough: int | None = None) -> str:
        """The likeliest letters; spaces inside token may go too. enough: the first so many of them will do; then the rest of a long
        token is not decoded once all paths agree on these and a letter that no path may leave out comes later."""
        paths: dict[str, tuple[float, tuple | None]] = {" ": (0.0, None)}  # what was emitted, each with what was before it
        previous, sure = "", self._last_sure(token) if enough is not None else -1
        for i, c in enumerate(token):
            if i % LOOK_EVERY == 0 and enough is not None and enough < i < sure:
                heads = {self._emitted(out)[: enough + 1] for _, out in paths.values()}
                if len(heads) == 1 and len(head := heads.pop()) > enough:
                    return head
            arcs = [(c, 0.0)]
            if c == " ":
                arcs = [("", JOINED), (" ", APART)]
            elif c in LOOKS_LIKE:
                arcs = [(c, SAME), ("", GONE), *((x, ALIKE) for x in LOOKS_LIKE[c])]
            elif not c.isalpha():
                arcs = [(c, SAME), ("", GONE)]
            elif c == previous:
                arcs = [(c, 0.0), ("", DOUBLED)]
            new: dict[str, tuple[float, tuple | None]] = {}
            for state, (score, out) in paths.items():
                for emitted, cost in arcs:
                    s = score + cost + (self.log(state, emitted) if emitted else 0.0)
                    to = (state + emitted)[-(ORDER - 1) :]
                    if to not in new or s > new[to][0]:
                        new[to] = (s, (out, emitted) if emitted else out)
            paths = dict(sorted(new.items(), key=lambda x: -x[1][0])[:BEAM]) if len(new) > BEAM else new
            previous = c
        return self._emitted(max(paths.items(), key=lambda x: x[1][0] + self.log(x[0], " "))[1][1])

    @staticmethod
    def _emitted(out: tuple | None) -> str:
        parts = []
        while out is not None:
            out, c = out
            parts.append(c)
        return "".join(reversed(parts))

    @staticmethod
    def _last_sure(token: str) -> int:
        """The place of the last letter that every path emits, -1 if there is none or a space."""
        if " " in token:
            return -1
        return next((i for i in range(len(token) - 1, 0, -1) if token[i].isalpha() and token[i] not in LOOKS_LIKE and token[i] != token[i - 1]), -1)


def core(token: str) -> str:
    """The token without marks around it. Of symbols that look like letters, one or two at the end stay, exclamation marks go."""
    inner = token.strip(EDGE)
    if inner[-1:] in LATE:
        bare = inner.rstrip(LATE)
        inner = (bare if len(bare) < len(inner) - 2 else inner.rstrip("!")).strip(EDGE)
    return inner


def plain_words(token: str, channel: Channel, longest: int | None = None) -> list[str]:
    """Words of a token, restored where it may be disguised. longest: of longer words only the first letters matter, and may be given."""
    inner = core(token)
    if not ODD.search(inner):
        return [inner] if inner else []
    restored = channel.restore(inner, longest and 2 * longest)
    if longest and len(restored) > 2 * longest:  # the word has a letter later on, so no mark here is at its end
        if len(head := restored.lstrip(EDGE)) > longest:
            return [head]
        restored = channel.restore(inner)
    return [x for x in (core(y) for y in restored.split(" ")) if x]


def spaced_runs(w: words.Words) -> list[tuple[int, int]]:
    """Ranges of three or more one-character words in a row in one text."""
    lens = w.ends - w.starts
    lead = w.data[w.starts]
    one = (lens == 1) & (lead < 128) | (lens == 2) & (lead >= 0xC2) & (lead < 0xE0)
    if not one.any():
        return []
    at = np.flatnonzero(one)
    head = np.flatnonzero(np.concatenate([[True], (np.diff(at) != 1) | np.isin(at[1:], w.first)]))
    n = np.diff(np.append(head, len(at)))
    return [(int(at[h]), int(at[h] + k)) for h, k in zip(head, n, strict=True) if k >= 3]


def run_text(w: words.Words, a: int, b: int) -> str:
    return " ".join(w.word(i).decode("utf-8", "replace") for i in range(a, b))


# ---- features and scores ----------------------------------------------------------------------------------------------


def features(word: str) -> list[str]:
    return ["=" + word, *(word[:n] for n in (4, 5, 6) if len(word) >= n)]


def doc_words(w: words.Words, channel: Channel, cache: dict) -> Iterator[list[str]]:
    """Restored words of each text; used where documents are few."""
    runs: dict[int, list[str]] = {}
    for a, b in spaced_runs(w):
        runs.setdefault(int(np.searchsorted(w.first, a, "right")) - 1, []).extend(plain_words_of_run(run_text(w, a, b), channel))
    for d in range(len(w.first) - 1):
        out = []
        for i in range(w.first[d], w.first[d + 1]):
            t = w.word(i)
            if t not in cache:
                cache[t] = plain_words(t.decode("utf-8", "replace"), channel)
            out += cache[t]
        yield out + runs.get(d, [])


def plain_words_of_run(run: str, channel: Channel) -> list[str]:
    return [x for x in (core(y) for y in channel.restore(run).split(" ")) if len(x) > 2]


def weight(pos: float, neg: float, n_pos: float, n_neg: float) -> float:
    return math.log((pos + 0.5) / (n_pos + 1)) - math.log((neg + 0.5) / (n_neg + 1)) if pos >= MIN_DOCS else 0.0


def summary(weights: list[float] | np.ndarray, n_words: int) -> list[float]:
    """Inputs of the regression."""
    top = sorted((x for x in weights if x >= HEAVY), reverse=True)
    return [1.0, *(top + [0.0] * 3)[:3], math.log1p(len(top)), math.log1p(n_words)]




def _fitting(name: str, packed: bytes) -> tuple[Channel, dict]:
    """The channel and the restored tokens of a worker, from task to task."""
    if name not in _fits:
        _fits.clear()
        _scorers.clear()
        _fits[name] = Channel(packed), {}
    channel, cache = _fits[name]
    if len(cache) > CACHE:
        cache.clear()
    return channel, cache


def _fit_rows(shared, text: str):
    """For each labelled text its distinct features: sums of labels in each task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        channel, cache = _fitting(*shared.value)
        for batch in batches:
            sums: dict[str, list[int]] = {}
            labels = batch.column("toxic").to_pylist()
            for lo, hi in words.slices(batch.column(text)):
                w = words.split(batch.column(text).slice(lo, hi - lo), lower=True)
                for label, own in zip(labels[lo:hi], doc_words(w, channel, cache), strict=True):
                    for f in {f for x in set(own) for f in features(x)}:
                        sums.setdefault(f, [0, 0])[label] += 1
            yield pa.RecordBatch.from_arrays([pa.array(list(sums)), pa.array([x[1] for x in sums.values()], pa.int64()), pa.array([x[0] for x in sums.values()], pa.int64())], ["feature", "pos", "neg"])

    return run


def _summaries(shared, text: str):
    """Inputs of the regression for labelled texts, without their own counts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        name, table, known, n_pos, n_neg = shared.value
        channel, cache = _fitting(name, table)
        for batch in batches:
            labels, rows = batch.column("toxic").to_pylist(), []
            for lo, hi in words.slices(batch.column(text)):
                w = words.split(batch.column(text).slice(lo, hi - lo), lower=True)
                for label, own, n in zip(labels[lo:hi], doc_words(w, channel, cache), w.counts.tolist(), strict=True):
                    left = lambda f: weight(known[f][0] - label, known[f][1] - 1 + label, n_pos - label, n_neg - 1 + label)  # noqa: B023, E731
                    best = {x: max((left(f) for f in features(x) if f in known), default=0.0) for x in set(own)}
                    rows.append(summary([best[x] for x in own], n))
            yield pa.RecordBatch.from_arrays([batch.column("toxic"), pa.array(rows, pa.list_(pa.float64()))], ["toxic", "x"])

    return run


def logistic(x: np.ndarray, y: np.ndarray, ridge: float = 0.05, rounds: int = 30) -> np.ndarray:
    """Newton's method; inputs are scaled inside."""
    scale = np.maximum(np.abs(x).max(axis=0), 1e-9)
    z, b = x / scale, np.zeros(x.shape[1])
    penalty = np.full(x.shape[1], ridge)
    penalty[0] = 1e-6
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(z @ b, -30, 30)))
        step = np.linalg.solve(z.T @ (z * (p * (1 - p))[:, None]) + np.diag(penalty), z.T @ (y - p) - penalty * b)
        b += np.clip(step, -4, 4)
        if np.abs(step).max() < 1e-8:
            break
    return b / scale


def held_out(doc_id: Column, folds: int = 3, fold: int = 1) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string")) % folds == fold, F.lit(False))


def fit(docs: DataFrame, labels: DataFrame, *, id_column="doc_id", text_column="text", label_column="toxic", fit_rows: int = FIT_ROWS):
    """The model: character counts, weights of features, regression (or a constant). labels: only rows that may be learned from."""
    spark = docs.sparkSession
    table = character_counts(docs, text_column)
    labels = labels.where(F.col(label_column).isin(0, 1) & F.col(id_column).isNotNull()).select(F.col(id_column).alias(f"{INNER}id"), F.col(label_column).cast("int").alias("toxic")).distinct()
    labels = written(labels, "labels")
    n = {r["toxic"]: r["count"] for r in labels.groupBy("toxic").count().collect()}
    share = n.get(1, 0) / max(1, sum(n.values()))
    if len(n) < 2:
        return table, {}, share
    some = [labels.where(F.col("toxic") == y).orderBy(F.xxhash64(f"{INNER}id"), f"{INNER}id").limit(fit_rows) for y in (0, 1)]
    some = F.broadcast(written(some[0].unionByName(some[1]), "labels-fit"))  # at most 2 * fit_rows ids
    rows = docs.select(id_column, F.coalesce(F.col(text_column), F.lit("")).alias(text_column)).join(some, F.col(id_column) == F.col(f"{INNER}id"))
    rows = written(rows.select(text_column, "toxic").dropDuplicates([text_column, "toxic"]), "labelled")
    n_neg, n_pos = (rows.where(F.col("toxic") == y).count() for y in (0, 1))
    if not n_pos or not n_neg:
        return table, {}, share
    # Small partitions: restoring is the work here.
    rows = rows.repartition(max(8, (n_pos + n_neg) // 256))
    name = uuid.uuid4().hex
    sums = rows.mapInArrow(_fit_rows(spark.sparkContext.broadcast((name, table)), text_column), "feature string, pos long, neg long").groupBy("feature").agg(F.sum("pos").alias("pos"), F.sum("neg").alias("neg"))
    ratio = F.log((F.col("pos") + 0.5) / (n_pos + 1)) - F.log((F.col("neg") + 0.5) / (n_neg + 1))
    # Bounded: each text of the bounded sample has so many features, and few are this one-sided.
    known = {r["feature"]: (r["pos"], r["neg"]) for r in sums.where((F.col("pos") >= MIN_DOCS) & (ratio >= HEAVY)).toLocalIterator()}
    got = rows.mapInArrow(_summaries(spark.sparkContext.broadcast((name, table, known, n_pos, n_neg)), text_column), "toxic int, x array<double>").toArrow()
    y = got.column("toxic").to_numpy().astype(np.float64)
    x = np.array(got.column("x").to_pylist())
    b = logistic(x, y)
    b[0] += math.log(n[1] / n[0]) - math.log(n_pos / n_neg)
    weights = {f: weight(p, q, n_pos, n_neg) for f, (p, q) in known.items()}
    return table, weights, b


class Scorer:
    """What a worker keeps from task to task: the channel and, in two generations of bounded size, the weights of tokens."""

    def __init__(self, model):
        packed, self.weights, self.b = model
        self.channel = Channel(packed)
        self.heads = {f.removeprefix("=")[:4] for f in self.weights}
        self.longest = max([8, *(len(f) for f in self.weights)])
        self.young: dict[int, float] = {}
        self.old: dict[int, float] = {}

    def heavy(self, own: list[str]) -> float:
        """All features of a word begin as it does, so most words need one look."""
        return max((self.weights.get(f, 0.0) for x in own if x[:4] in self.heads for f in features(x)), default=0.0)

    def tokens(self, w: words.Words, u: np.ndarray, first: np.ndarray) -> np.ndarray:
        """Weights of the distinct tokens u, which first occur at the words `first`."""
        out = np.zeros(len(u))
        for i, h in enumerate(u.tolist()):
            if (x := self.young.get(h)) is None:
                if (x := self.old.get(h)) is None:
                    x = self.heavy(plain_words(w.word(first[i]).decode("utf-8", "replace"), self.channel, self.longest))
                self.young[h] = x
            out[i] = x
        if len(self.young) > CACHE:
            self.young, self.old = {}, self.young
        return out

    def scores(self, texts: pa.Array) -> list[float]:
        w = words.split(texts, lower=True)
        found: dict[int, list[float]] = {}
        if self.weights and len(w.starts):
            u, first, back = np.unique(w.hashes(), return_index=True, return_inverse=True)
            each = self.tokens(w, u, first)[back]
            on = np.flatnonzero(each >= HEAVY)
            for row, x in zip((np.searchsorted(w.first, on, "right") - 1).tolist(), each[on].tolist(), strict=True):
                found.setdefault(row, []).append(x)
            for a, z in spaced_runs(w):
                x = max((self.heavy([y]) for y in plain_words_of_run(run_text(w, a, z), self.channel)), default=0.0)
                if x >= HEAVY:
                    found.setdefault(int(np.searchsorted(w.first, a, "right")) - 1, []).append(x)
        if isinstance(self.b, float):
            return [self.b] * len(texts)
        return [1 / (1 + math.exp(-min(30.0, max(-30.0, float(np.dot(self.b, summary(found.get(row, []), n))))))) for row, n in enumerate(w.counts.tolist())]


def _scored(shared, text: str, columns: list[str]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        name, model = shared.value
        if name not in _scorers:
            _scorers.clear()
            _fits.clear()
            _scorers[name] = Scorer(model)
        for batch in batches:
            scores: list[float] = []
            for lo, hi in words.slices(batch.column(text)):
                scores += _scorers[name].scores(batch.column(text).slice(lo, hi - lo))
            made = {"score": pa.array(scores, pa.float64())}
            yield pa.RecordBatch.from_arrays([made[c] if c in made else batch.column(c) for c in columns], columns)

    return run


def _restored(shared, text: str, columns: list[str]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        channel = Channel(shared.value)
        cache: dict[str, str] = {}
        spaced = re.compile(r"(?<![^\x20\x09-\x0D])[^\x20\x09-\x0D](?: [^\x20\x09-\x0D]){2,}(?![^\x20\x09-\x0D])")

        def one(m: re.Match) -> str:
            t = m[0]
            if t not in cache:
                inner = core(t.lower())
                cache[t] = t if not inner or not ODD.search(inner) else t.lower().replace(inner, channel.restore(inner), 1)
                if len(cache) > CACHE:
                    cache.clear()
                    return one(m)
            return cache[t]

        for batch in batches:
            out = []
            for t in batch.column(text).to_pylist():
                t = spaced.sub(lambda m: channel.restore(m[0].lower()), t) if t else t
                out.append(re.sub(r"[^\x20\x09-\x0D]+", one, t) if t else t)
            made = pa.array(out, pa.string())
            yield pa.RecordBatch.from_arrays([made if c == text else batch.column(c) for c in columns], columns)

    return run


def deobfuscate(docs: DataFrame, table: bytes, *, text_column="text") -> DataFrame:
    """docs with restored texts: tokens that may be disguised are replaced by the likeliest letters, all else stays."""
    shared = docs.sparkSession.sparkContext.broadcast(table)
    return docs.mapInArrow(_restored(shared, text_column, docs.columns), docs.schema)


def score_toxicity(docs: DataFrame, model, *, text_column="text", keep: list[str] | None = None, threshold: float = THRESHOLD) -> DataFrame:
    """keep (all columns by default) with score and predicted. model: what fit() returns."""
    kept = [c for c in (docs.columns if keep is None else keep) if c not in ("score", "predicted")]
    inner = docs.select(*dict.fromkeys([*kept, text_column]))
    shared = docs.sparkSession.sparkContext.broadcast((uuid.uuid4().hex, model))
    schema = T.StructType([*(docs.schema[c] for c in kept), T.StructField("score", T.DoubleType())])
    return inner.mapInArrow(_scored(shared, text_column, [*kept, "score"]), schema).withColumn("predicted", (F.col("score") >= threshold).cast("int"))


def drop_toxic(docs: DataFrame, model, *, text_column="text", threshold: float = THRESHOLD) -> DataFrame:
    """The rows of docs that score below the threshold, with all their columns."""
    if not {"score", "predicted"} & set(docs.columns):
        return score_toxicity(docs, model, text_column=text_column, threshold=threshold).where("predicted = 0").select(*docs.columns)
    row = docs.select(F.col(text_column), F.struct("*").alias(f"{INNER}row"))  # columns with these names stay as they are
    kept = score_toxicity(row, model, text_column=text_column, keep=[f"{INNER}row"], threshold=threshold).where("predicted = 0")
    return kept.select(*(F.col(f"{INNER}row")[c].alias(c) for c in docs.columns))
