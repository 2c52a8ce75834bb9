"""Chat formatting: cumulative snapshots of a conversation collapse to the longest ones, which are rendered.

A logged conversation often is a prefix of a longer one. Of each conversation the turns (by turn number, then role and text;
nulls first) give rolling prefix hashes: h_0 = '', h_t = BLAKE2b(h_{t-1}, role, text). A conversation whose last hash is an
inner prefix hash of another one is dropped by an anti-join; of equal conversations the one with the smallest conv_id stays.
Both sides are reduced to distinct hashes with partial sums first, so a hot first turn or a hot conversation costs one row
for each task. A conversation is rendered as one text value, so its own turns come together in one row, as its result does.

Defined cases: a null role renders as `none`, a null text as an empty one; for equality null and '' differ. `<|` inside roles
and texts is written `<||`, so that parse() gets the turns back. Rows without conv_id form one conversation. Repeated rows
are repeated turns. Columns other than the four named are ignored. An empty table gives an empty table.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import written


def render(turns: list[dict]) -> str:
    safe = lambda x: x.replace("<|", "<||")
    return "".join(f"<|{safe('none' if t['role'] is None else t['role'])}|>\n{safe(t['text'] or '')}<|end|>\n" for t in turns)


def parse(text: str) -> list[tuple[str, str]]:
    """(role, text) of each turn of a rendered conversation."""
    plain = lambda x: x.replace("<||", "<|")
    return [(plain(r), plain(t)) for r, t in re.findall(r"<\|(?!\|)((?:(?!\|>\n).)*)\|>\n(.*?)<\|end\|>\n", text, re.S)]


def prefix_hashes(turns: list[dict]) -> list[bytes]:
    out, h = [], b""
    for t in turns:
        d = hashlib.blake2b(h, digest_size=16)
        for x in (t["role"], t["text"]):
            raw = b"" if x is None else x.encode("utf-8", "surrogatepass")
            d.update(b"-" if x is None else b"=%d:" % len(raw))
            d.update(raw)
        out.append(h := d.digest())
    return out


def _rendered(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        turns = batch.column("turns").to_pylist()
        hashes = [prefix_hashes(x) for x in turns]
        made = [
            pa.array([len(x) for x in turns], pa.int64()),
            pa.array([h[-1] for h in hashes], pa.binary()),
            pa.array([h[:-1] for h in hashes], pa.list_(pa.binary())),
            pa.array([render(x) for x in turns], pa.string()),
        ]
        yield pa.RecordBatch.from_arrays([batch.column("id"), *made], ["id", "n_turns", "whole", "inner", "rendered"])


def format_chats(conversations: DataFrame, *, id_column="conv_id", turn_column="turn", role_column="role", text_column="text") -> DataFrame:
    """A row for each maximal conversation: its id, n_turns, n_equal (equal conversations, itself included) and rendered."""
    id_type = conversations.schema[id_column].dataType.simpleString()
    turns = conversations.select(F.col(id_column).alias("id"), F.struct(F.col(turn_column).alias("turn"), F.col(role_column).alias("role"), F.col(text_column).alias("text")).alias("t"))
    whole = turns.groupBy("id").agg(F.sort_array(F.collect_list("t")).alias("turns"))
    chats = written(whole.mapInArrow(_rendered, f"id {id_type}, n_turns long, whole binary, inner array<binary>, rendered string"), "chats")
    distinct = chats.groupBy("whole").agg(F.min("id").alias("first"), F.count(F.lit(1)).alias("n_equal"))
    inner = chats.select(F.explode("inner").alias("whole")).distinct()
    kept = distinct.join(inner, "whole", "left_anti").withColumnRenamed("whole", "w")
    out = chats.join(kept, chats["id"].eqNullSafe(kept["first"]) & (chats["whole"] == kept["w"]))
    return out.select(F.col("id").alias(id_column), "n_turns", "n_equal", "rendered")
