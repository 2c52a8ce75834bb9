"""Approximate nearest neighbours by a permutation index: largest inner product.

Every vector is represented by the order of its PIVOTS_EACH nearest pivots. Pivots are rows of a sample of at most FIT_ROWS
vectors (the first by a hash of the id). For inner products, vectors are divided by the largest length and get one more
component that makes their length 1; queries get 0 there, so that the nearest pivots follow the inner product.

The index has shards of about SHARD_ROWS vectors by a hash of the id; each is one row with its vectors and, for each pivot,
the posting list of the vectors that have it, with its rank there. All vectors are indexed. Queries come in blocks of
QUERY_ROWS and meet every shard once. In a shard, the posting lists of a query's pivots give Spearman's footrule with
location parameter k (k (k + 1) - 2 * sum over common pivots of k - max(rank, rank')), the candidates are a share of the
shard with the least footrule, and these are ranked again by the exact inner product in double precision. The share is the least
one with which TRIALS vectors of the sample, as queries among the others, find the share RECALL of their true nearest; so it
follows the data (few dimensions or clusters need little, evenly spread vectors of many dimensions much). Shards and blocks bound
what a task holds; a query gives `k` rows for each shard. Recall against brute force is measured in the tests.

Defined cases: vectors that are null, empty, all zero, or hold null or non-finite components take no part, nor rows without
id, nor vectors of another dimension than the most frequent one. Exactly repeated rows count once. Ties go to the smaller id.
Other columns, whatever their names, are not read. No vectors give no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window as W
from pyspark.sql import functions as F

from . import words
from .common import written

PIVOTS, PIVOTS_EACH, FIT_ROWS = 512, 96, 8192
SHARD_ROWS, QUERY_ROWS = 8192, 512
RECALL, TRIALS = 0.97, 128


def _usable(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        ids, vectors, dims, norms = [], [], [], []
        for i, v in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
            if i is None or not v.is_valid or not len(v.values) or v.values.null_count:
                continue
            x = v.values.to_numpy(zero_copy_only=False).astype(np.float64)
            if np.isfinite(x).all() and x.any():
                ids.append(i)
                vectors.append(x.tobytes())
                dims.append(len(x))
                norms.append(float(np.sqrt(x @ x)))
        yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(vectors, pa.binary()), pa.array(dims, pa.int32()), pa.array(norms, pa.float64())], ["id", "vector", "dim", "norm"])


def matrix(vectors: pa.Array, dim: int) -> np.ndarray:
    data, _ = words.flat(vectors)
    return data.view(np.float64).reshape(-1, dim) if len(data) else np.zeros((0, dim))


def nearest_pivots(x: np.ndarray, pivots: np.ndarray, longest: float | None, k: int) -> np.ndarray:
    """longest: None for queries."""
    if longest is None:
        x = np.hstack([x / np.linalg.norm(x, axis=1, keepdims=True), np.zeros((len(x), 1))])
    else:
        x = x / longest
        x = np.hstack([x, np.sqrt(np.maximum(0, 1 - (x * x).sum(axis=1, keepdims=True)))])
    return np.argsort(-(x @ pivots.T), axis=1, kind="stable")[:, :k].astype(np.int16)


def inverted(order: np.ndarray, n_pivots: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Posting lists: rows and ranks by pivot, and where each pivot's list starts."""
    flat = order.ravel()
    by = np.argsort(flat, kind="stable")
    return (by // order.shape[1]).astype(np.int32), (by % order.shape[1]).astype(np.int16), np.searchsorted(flat[by], np.arange(n_pivots + 1)).astype(np.int32)


def _packed(shared, dim: int, query: bool):
    def run(table: pa.Table) -> pa.Table:
        pivots, longest = shared.value
        table = table.sort_by("id")
        x = matrix(table.column("vector"), dim)
        k = min(PIVOTS_EACH, len(pivots))
        rows, ranks, heads = inverted(nearest_pivots(x, pivots, None if query else longest, k), len(pivots))
        blobs = [table.column("id").to_numpy().tobytes(), x.tobytes(), rows.tobytes(), ranks.tobytes(), heads.tobytes()]
        return pa.Table.from_arrays([table.column("part").slice(0, 1), *(pa.array([b], pa.binary()) for b in blobs)], ["part", "ids", "vectors", "rows", "ranks", "heads"])

    return run


def footrule_closeness(a, b, k: int, n_a: int, n_b: int) -> np.ndarray:
    """Sum over common pivots of k - max(rank, rank'), for all pairs of two inverted files; larger is closer."""
    out = np.zeros((n_a, n_b), np.int32)
    for p in range(len(a[2]) - 1):
        i, j = slice(a[2][p], a[2][p + 1]), slice(b[2][p], b[2][p + 1])
        if i.start < i.stop and j.start < j.stop:
            out[a[0][i][:, None], b[0][j][None]] += k - np.maximum(a[1][i][:, None], b[1][j][None])
    return out


def share_for(x: np.ndarray, pivots: np.ndarray, longest: float, k: int) -> float:
    """The share of candidates with which the last TRIALS of the vectors x, as queries, find RECALL of their k nearest in x."""
    each, queries = min(PIVOTS_EACH, len(pivots)), x[-TRIALS:]
    if len(x) <= k + 1:
        return 1.0
    files = inverted(nearest_pivots(queries, pivots, None, each), len(pivots)), inverted(nearest_pivots(x, pivots, longest, each), len(pivots))
    close = footrule_closeness(*files, each, len(queries), len(x)).astype(np.float64)
    score = queries @ x.T
    own = (np.arange(len(queries)), np.arange(len(x) - len(queries), len(x)))
    close[own], score[own] = np.inf, -np.inf
    true = np.argpartition(-score, k - 1, axis=1)[:, :k]
    # Of equally close vectors any may be left out, so all count as before the one that is looked for.
    needed = np.sort(np.concatenate([len(x) - np.searchsorted(np.sort(c), c[t], "left") for c, t in zip(close, true, strict=True)]))
    return float(needed[min(len(needed) - 1, int(RECALL * len(needed)))]) / len(x)


def _searched(dim: int, k: int, n_pivots: int, share: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        each = min(PIVOTS_EACH, n_pivots)
        for batch in batches:
            for row in range(len(batch)):
                get = lambda c, kind: np.frombuffer(batch.column(c)[row].as_py(), kind)  # noqa: B023, E731
                ids, qids = get("ids", np.int64), get("q_ids", np.int64)
                x, q = get("vectors", np.float64).reshape(-1, dim), get("q_vectors", np.float64).reshape(-1, dim)
                files = [tuple(get(p + c, kind) for c, kind in (("rows", np.int32), ("ranks", np.int16), ("heads", np.int32))) for p in ("q_", "")]
                close = footrule_closeness(*files, each, len(q), len(x))
                n = min(len(x), max(k + 1, int(np.ceil(share * len(x)))))
                best = np.argpartition(-close, n - 1, axis=1)[:, :n] if n < len(x) else np.broadcast_to(np.arange(n), (len(q), n))
                found = []
                for i in range(len(q)):
                    c = best[i][ids[best[i]] != qids[i]]
                    score = (x[c] * q[i]).sum(axis=1)
                    if len(c) > k:
                        least = -np.partition(-score, k - 1)[k - 1]
                        c, score = c[score >= least], score[score >= least]
                    top = np.lexsort((ids[c], -score))[:k]
                    found.append((np.full(len(top), qids[i]), ids[c[top]], score[top]))
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(x)) for x in zip(*found, strict=True)], ["query_id", "id", "score"])

    return run


def nearest(vectors: DataFrame, queries_if, *, id_column="vec_id", vector_column="embedding", k: int = 20, share: float | None = None, shard_rows: int = SHARD_ROWS) -> DataFrame:
    """query_id, rank (from 1), id and score: the k nearest found for each vector that meets the condition queries_if (over the column id). share: of candidates in each shard; learned from the sample if it is not given."""
    spark = vectors.sparkSession
    schema = "query_id long, rank int, id long, score double"
    usable = vectors.select(F.col(id_column).cast("long"), vector_column).mapInArrow(_usable, "id long, vector binary, dim int, norm double")
    usable = written(usable.dropDuplicates(["id", "vector"]), "vectors")
    dims = usable.groupBy("dim").agg(F.count(F.lit(1)).alias("n"), F.max("norm").alias("longest")).orderBy(F.desc("n"), "dim").limit(1).first()
    if dims is None:
        return spark.createDataFrame([], schema)
    dim, n, longest = dims["dim"], dims["n"], dims["longest"]
    usable = usable.where(F.col("dim") == dim).select("id", "vector")
    fit = usable.withColumn("turn", F.xxhash64("id", "vector")).orderBy("turn").limit(FIT_ROWS).select("vector").toArrow()
    sample = (drawn := matrix(fit.column("vector"), dim)) / longest
    sample = np.hstack([sample, np.sqrt(np.maximum(0, 1 - (sample * sample).sum(axis=1, keepdims=True)))])
    _, one = np.unique(sample, axis=0, return_index=True)
    pivots = sample[np.sort(one)[:PIVOTS]]
    share = share_for(drawn, pivots, longest, k) if share is None else share
    shared = spark.sparkContext.broadcast((pivots, longest))
    parts = -(-n // shard_rows)
    blob = "part int, ids binary, vectors binary, rows binary, ranks binary, heads binary"
    shard = lambda df, m: df.withColumn("part", F.pmod(F.xxhash64("id"), F.lit(m)).cast("int"))
    shards = written(shard(usable, parts).groupBy("part").applyInArrow(_packed(shared, dim, False), blob), "shards")
    asked = usable.where(queries_if(F.col("id")))
    blocks = shard(asked, max(1, -(-asked.count() // QUERY_ROWS))).groupBy("part").applyInArrow(_packed(shared, dim, True), blob)
    blocks = written(blocks.toDF(*(f"q_{c}" for c in blocks.columns)), "query-blocks")
    meet = blocks.withColumn("part", F.explode(F.sequence(F.lit(0), F.lit(parts - 1))))
    found = shards.join(meet, "part").mapInArrow(_searched(dim, k, len(pivots), share), "query_id long, id long, score double")
    rank = F.row_number().over(W.partitionBy("query_id").orderBy(F.desc("score"), "id"))
    return found.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", "id", "score")
