"""Tables of counts of fixed size, filled in each task and summed over all tasks."""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

PIECE = 1 << 16
SCHEMA = "part int, n binary"


def pieces(table: np.ndarray) -> Iterator[pa.RecordBatch]:
    """Rows of SCHEMA for a task's table."""
    flat = table.ravel()
    for lo in range(0, len(flat), PIECE):
        if flat[lo : lo + PIECE].any():
            yield pa.RecordBatch.from_arrays([pa.array([lo // PIECE], pa.int32()), pa.array([zlib.compress(flat[lo : lo + PIECE].astype(np.int64).tobytes(), 1)], pa.binary())], ["part", "n"])


def _summed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    parts: dict[int, np.ndarray] = {}
    for batch in batches:
        for part, n in zip(batch.column("part").to_pylist(), batch.column("n").to_pylist(), strict=True):
            new = np.frombuffer(zlib.decompress(n), np.int64)
            parts[part] = parts[part] + new if part in parts else new
    for part, n in parts.items():
        yield pa.RecordBatch.from_arrays([pa.array([part], pa.int32()), pa.array([zlib.compress(n.tobytes(), 1)], pa.binary())], ["part", "n"])


def total(parts: DataFrame, size: int) -> np.ndarray:
    """The sum of all tasks' tables of `size` numbers; it comes to the driver, so size is what bounds it."""
    out = np.zeros(size, np.int64)
    for row in parts.repartition(-(-size // PIECE), "part").mapInArrow(_summed, SCHEMA).toLocalIterator():
        piece = np.frombuffer(zlib.decompress(row["n"]), np.int64)
        out[row["part"] * PIECE : row["part"] * PIECE + len(piece)] = piece
    return out
