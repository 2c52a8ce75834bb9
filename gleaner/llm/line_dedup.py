"""Line dedup: lines whose key many documents hold stay only in the document with the largest id.

Two Bloom filters, once-seen and twice-seen, are built over all lines: a bit goes to the second one if two documents hit it.
Each task fills both; parts of them are merged as (once, twice) + (once', twice') = (once | once', twice | twice' | once & once').
So the second filter has every key of two documents, whatever the tasks. It has a fixed most size, whatever the corpus; once it
is full, more keys are suspected and the exact step has more to do, but results stay the same. Only keys in the second filter are
shuffled (16 bytes of BLAKE2b and the doc_id), counted exactly, and the rows to drop are joined back by doc_id.

Defined cases: a null or empty text is one empty line; its key is shorter than any minimum. Rows with the same doc_id are
one document. A row without doc_id counts as no document and loses each repeated line. Other columns pass through; columns
named n_lines and n_dropped are replaced. An empty table gives an empty table.
"""

from __future__ import annotations

import hashlib
import math
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import INNER, written

MIN_CHARS, MIN_DOCS = 20, 3
#: Bits for each line, hits for each key, and the most bits that a filter may have (32 MB).
BITS_PER_LINE, HITS, MOST_BITS = 16, 3, 1 << 28
PART_BITS = 1 << 19
SPACE = b" \t\n\x0b\x0c\r"


def line_keys(text: bytes, min_chars: int) -> Iterator[tuple[int, bytes]]:
    """Numbers of the lines that are long enough, and their keys' hashes."""
    for i, line in enumerate(text.split(b"\n")):
        key = line.strip(SPACE).lower()  # bytes: A-Z only
        if len(key) >= min_chars and (len(key) >= 4 * min_chars or len(key.decode("utf-8", "replace")) >= min_chars):
            yield i, hashlib.blake2b(key, digest_size=16).digest()


def _texts(batch: pa.RecordBatch, column: str) -> Iterator[bytes]:
    for x in batch.column(column).cast(pa.large_binary()):
        yield x.as_py() or b""


def _hits(keys: list[bytes], bits: int) -> np.ndarray:
    words = np.frombuffer(b"".join(keys), np.uint32).reshape(-1, 4)[:, :HITS]
    return words & np.uint32(bits - 1)


def _filters(bits: int, min_chars: int, text: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        once, twice = np.zeros(bits, bool), np.zeros(bits, bool)
        for batch in batches:
            keys = [k for t in _texts(batch, text) for k in {k for _, k in line_keys(t, min_chars)}]
            if keys:
                at, n = np.unique(_hits(keys, bits), return_counts=True)
                twice[at[(n > 1) | once[at]]] = True
                once[at] = True
        for lo in range(0, bits, PART_BITS):
            a = once[lo : lo + PART_BITS]
            if a.any():
                yield pa.RecordBatch.from_arrays([pa.array([lo // PART_BITS], pa.int32()), *(pa.array([zlib.compress(np.packbits(x), 1)], pa.binary()) for x in (a, twice[lo : lo + PART_BITS]))], ["part", "once", "twice"])

    return run


def _merged(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    parts: dict[int, tuple[np.ndarray, np.ndarray]] = {}
    for batch in batches:
        for row in batch.to_pylist():
            once, twice = (np.frombuffer(zlib.decompress(row[c]), np.uint8) for c in ("once", "twice"))
            if row["part"] in parts:
                a, b = parts[row["part"]]
                once, twice = a | once, b | twice | a & once
            parts[row["part"]] = once, twice
    for part, (_, twice) in parts.items():
        if twice.any():
            yield pa.RecordBatch.from_arrays([pa.array([part], pa.int32()), pa.array([zlib.compress(twice, 1)], pa.binary())], ["part", "twice"])


def twice_seen(docs: DataFrame, text_column: str, min_chars: int) -> tuple[np.ndarray, int]:
    """The second filter (packed) and its bits; at most MOST_BITS come to the driver."""
    lines = docs.agg(F.sum(F.length(text_column) - F.length(F.replace(F.col(text_column), F.lit("\n"), F.lit(""))) + 1)).first()[0] or 0
    bits = min(MOST_BITS, max(PART_BITS, 1 << math.ceil(math.log2(1 + BITS_PER_LINE * lines))))
    parts = docs.select(text_column).mapInArrow(_filters(bits, min_chars, text_column), "part int, once binary, twice binary")
    packed = np.zeros(bits // 8, np.uint8)
    for row in parts.repartition(bits // PART_BITS, "part").mapInArrow(_merged, "part int, twice binary").toLocalIterator():
        packed[row["part"] * PART_BITS // 8 : (row["part"] + 1) * PART_BITS // 8] = np.frombuffer(zlib.decompress(row["twice"]), np.uint8)
    return packed, bits


def _suspects(shared, bits: int, min_chars: int, text: str, id_column: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        packed = shared.value
        for batch in batches:
            keys, rows = [], []
            for row, t in enumerate(_texts(batch, text)):
                found = {k for _, k in line_keys(t, min_chars)}
                keys += found
                rows += [row] * len(found)
            if keys:
                hits = _hits(keys, bits)
                at = np.flatnonzero(((packed[hits >> 3] >> (7 - (hits & 7)).astype(np.uint8)) & 1).all(axis=1))
                ids = batch.column(id_column).take(pa.array([rows[i] for i in at], pa.int64()))
                yield pa.RecordBatch.from_arrays([pa.array([keys[i] for i in at], pa.binary()), ids], ["key", "id"])

    return run


def _dropped(min_chars: int, text: str, columns: list[str]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            kept, n, gone = [], [], []
            for t, drop in zip(_texts(batch, text), batch.column(f"{INNER}drop"), strict=True):
                lines = t.split(b"\n")
                drop = drop.as_py()
                out = {i for i, k in line_keys(t, min_chars) if k in drop} if drop and (drop := set(drop)) else ()
                kept.append(b"\n".join(x for i, x in enumerate(lines) if i not in out) if out else t)
                n.append(len(lines))
                gone.append(len(out))
            made = {text: pa.array(kept, pa.binary()).cast(batch.schema.field(text).type), "n_lines": pa.array(n, pa.int64()), "n_dropped": pa.array(gone, pa.int64())}
            yield pa.RecordBatch.from_arrays([made[c] if c in made else batch.column(c) for c in columns], columns)

    return run


def dedup_lines(docs: DataFrame, *, id_column="doc_id", text_column="text", min_chars: int = MIN_CHARS, min_docs: int = MIN_DOCS) -> DataFrame:
    """docs with the text that stays, n_lines (before) and n_dropped. A null text becomes ''."""
    spark = docs.sparkSession
    docs = docs.drop("n_lines", "n_dropped")
    id_type = docs.schema[id_column].dataType.simpleString()
    packed, bits = twice_seen(docs, text_column, min_chars)
    shared = spark.sparkContext.broadcast(packed)
    suspects = written(docs.select(id_column, text_column).mapInArrow(_suspects(shared, bits, min_chars, text_column, id_column), f"key binary, id {id_type}"), "lines")
    repeated = suspects.distinct().groupBy("key").agg(F.count("id").alias("n"), F.max("id").alias("keep")).where(F.col("n") >= min_docs).select("key", "keep")
    # Written, so that each side of the join is a plain shuffle whose large partitions Spark can split; it may also choose to broadcast.
    repeated = written(repeated, "lines-repeated")
    drops = suspects.join(repeated, "key").where(~F.col("id").eqNullSafe(F.col("keep"))).groupBy(F.col("id").alias(f"{INNER}id")).agg(F.collect_set("key").alias(f"{INNER}drop"))
    joined = docs.join(drops, docs[id_column].eqNullSafe(drops[f"{INNER}id"]), "left").drop(f"{INNER}id")
    columns = [*docs.columns, "n_lines", "n_dropped"]
    schema = T.StructType([*docs.schema.fields, T.StructField("n_lines", T.LongType()), T.StructField("n_dropped", T.LongType())])
    return joined.mapInArrow(_dropped(min_chars, text_column, columns), schema)
