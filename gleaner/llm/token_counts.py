"""Token counts as a public tokenizer gives them, by a map-side lookup in two tiers.

A text is cut at ASCII white space into pre-tokens; the vocabulary used here drops white space, so a text's count is the sum
of its pre-tokens' counts (checked when the tokenizer is loaded). Tier one: a compact table of frequent pre-tokens (sorted
64-bit hashes and lengths, at most `table_size` entries), learned from a sample of `sample_docs` texts and broadcast; it only saves
work, results do not depend on it. Tier two: a cache in each worker, of bounded size, for the rest; what is in neither is
encoded by the library itself. No pre-token is shuffled.

Defined cases: a null text counts as ''. Special strings inside texts are taken as the library does by default. Very long
texts are not truncated. Other columns pass through; result columns replace input columns of the same name.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import words

TABLE_SIZE, SAMPLE_DOCS = 65_536, 2_000
#: Texts in that sample have at most so many characters, which bounds what comes to the driver.
SAMPLE_CHARS = 20_000
#: Entries of a worker's cache, in each of two generations.
CACHE = 400_000
ENCODE = 4096

_tokenizers: dict[int, object] = {}
_caches: dict[int, tuple[dict, dict]] = {}


def _tokenizer(blob: str):
    from tokenizers import Tokenizer

    key = hash(blob)
    if key not in _tokenizers:
        tokenizer = Tokenizer.from_str(blob)
        tokenizer.no_truncation()
        tokenizer.no_padding()
        probe = ["a b", "don't  stop\tnow.\n", "xé 中文 42"]
        for p in probe:
            if sum(len(e) for e in tokenizer.encode_batch(p.split(), add_special_tokens=False)) != len(tokenizer.encode(p, add_special_tokens=False)):
                raise ValueError("this vocabulary gives tokens to white space; its texts cannot be cut there")
        _tokenizers[key] = tokenizer
    return _tokenizers[key]


def encoded_lengths(tokenizer, tokens: list[bytes]) -> list[int]:
    out: list[int] = []
    for lo in range(0, len(tokens), ENCODE):
        out += [len(e) for e in tokenizer.encode_batch([x.decode("utf-8", "replace") for x in tokens[lo : lo + ENCODE]], add_special_tokens=False)]
    return out


def frequent(texts: list[str], blob: str, table_size: int) -> tuple[np.ndarray, np.ndarray]:
    """Sorted hashes and lengths of the most frequent pre-tokens."""
    counts: Counter = Counter()
    for t in texts:
        counts.update(t.encode().split())
    tokens = [x for x, _ in counts.most_common(table_size)]
    if not tokens:
        return np.zeros(0, np.uint64), np.zeros(0, np.int32)
    hashes = np.concatenate([words.split(pa.array(tokens[lo : lo + ENCODE], pa.binary())).hashes() for lo in range(0, len(tokens), ENCODE)])
    order = np.argsort(hashes)
    return hashes[order], np.array(encoded_lengths(_tokenizer(blob), tokens), np.int32)[order]


def _lookup(u: np.ndarray, first: np.ndarray, w: words.Words, table, blob: str) -> np.ndarray:
    """Token counts of the distinct pre-tokens u, which first occur at the words `first`."""
    known, lens = table
    out = np.full(len(u), -1, np.int64)
    if len(known):
        at = np.minimum(np.searchsorted(known, u), len(known) - 1)
        hit = known[at] == u
        out[hit] = lens[at[hit]]
    missed = np.flatnonzero(out < 0)
    key = hash(blob)
    young, old = _caches.setdefault(key, ({}, {}))
    hashes = u[missed].tolist()
    got = [young.get(h) for h in hashes]
    todo = []
    for i, (h, x) in enumerate(zip(hashes, got, strict=True)):
        if x is None:
            if (x := old.get(h)) is None:
                todo.append(i)
            else:
                got[i] = young[h] = x
    for i, n in zip(todo, encoded_lengths(_tokenizer(blob), [w.word(first[missed[i]]) for i in todo]), strict=True):
        got[i] = young[hashes[i]] = n
    if len(young) > CACHE:
        _caches[key] = ({}, young)
    out[missed] = got
    return out


def _counted(shared, text: str, columns: list[str]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        blob, table = shared.value
        for batch in batches:
            texts = batch.column(text)
            n_tokens = np.zeros(len(batch), np.int64)
            n_bytes = np.zeros(len(batch), np.int64)
            for lo, hi in words.slices(texts):
                part = texts.slice(lo, hi - lo)
                n_bytes[lo:hi] = np.diff(words.flat(part)[1])
                w = words.split(part)
                if len(w.starts):
                    u, first, back = np.unique(w.hashes(), return_index=True, return_inverse=True)
                    upto = np.concatenate([[0], np.cumsum(_lookup(u, first, w, table, blob)[back])])
                    n_tokens[lo:hi] = np.diff(upto[w.first])
            made = {"n_bytes": pa.array(n_bytes), "n_tokens": pa.array(n_tokens)}
            yield pa.RecordBatch.from_arrays([made[c] if c in made else batch.column(c) for c in columns], columns)

    return run


def count_tokens(docs: DataFrame, tokenizer_path: str, *, text_column="text", keep: list[str] | None = None, limit: int = 2048, table_size: int = TABLE_SIZE, sample_docs: int = SAMPLE_DOCS) -> DataFrame:
    """keep (all columns by default) with n_bytes (UTF-8), n_tokens and over_limit. tokenizer_path: a .json of the tokenizers library, read on the driver."""
    made = ("n_bytes", "n_tokens", "over_limit")
    with open(tokenizer_path, encoding="utf-8") as f:
        blob = f.read()
    sample = [r[0] for r in docs.where(F.length(text_column) <= SAMPLE_CHARS).select(text_column).limit(sample_docs).collect()] if table_size and sample_docs else []
    shared = docs.sparkSession.sparkContext.broadcast((blob, frequent(sample, blob, table_size)))
    kept = [c for c in (docs.columns if keep is None else keep) if c not in made]
    inner = docs.select(*dict.fromkeys([*kept, text_column]))
    schema = T.StructType([*[docs.schema[c] for c in kept], T.StructField("n_bytes", T.LongType()), T.StructField("n_tokens", T.LongType())])
    return inner.mapInArrow(_counted(shared, text_column, [*kept, "n_bytes", "n_tokens"]), schema).withColumn("over_limit", F.col("n_tokens") > limit)
