"""Rounds of messages between units of documents and buckets of keys.

A unit is a few megabytes of whole documents, dealt by a hash of id and text, so that many rows with one id (or none) are
many units' rows; only rows that are equal in both stay together.  A bucket is a share of the key space.
A unit sends each bucket one packed blob of its distinct keys (whatever repeats inside a unit is sent once, so a group
of copies costs one entry per unit, not one per copy), and the bucket answers each unit with bits in the order of the
blob.  Units and buckets grow in number with the input and each fits a task's memory.

Unit functions run on the same exchange of the documents each round and sort their rows first, so every round sees the
same order, also after a lost executor.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from trellis.llm.shared import give_back, text_bytes, units

#: Ids of documents without one: larger than any other.
NO_ID = np.iinfo(np.int64).max
MESSAGES = "g int, b int, kind int, blob binary"
Message = tuple[int, int, int, bytes]


class Layout:
    """The documents of a run, dealt to units, and the number of buckets."""

    def __init__(self, df: DataFrame, id_col: str, text_col: str, unit_bytes: int = 4 << 20, bucket_bytes: int = 16 << 20, carry: tuple[str, ...] = ()):
        """``carry``: columns that stay with their document, as c0, c1, ... in the unit's table."""
        text = df[text_col].cast("string")
        self.carried = [f"c{i}" for i in range(len(carry))]
        more = [df[c].alias(name) for c, name in zip(carry, self.carried, strict=True)]
        source = df.select(df[id_col].cast("long").alias("id"), text.alias("text"), *more)
        self.carried_ddl = "".join(f", `{c}` {source.schema[name].dataType.simpleString()}" for c, name in zip(carry, self.carried, strict=True))
        self.total = text_bytes(source)
        self.n_units, self.n_buckets = units(self.total, unit_bytes), units(self.total, bucket_bytes)
        self.docs = source.select(F.pmod(F.xxhash64("id", "text"), F.lit(self.n_units)).cast("int").alias("g"), "id", "text", *self.carried)

    def ask(self, unit: Callable[[pa.Table], Iterable[Message]]) -> DataFrame:
        """Messages of each unit."""

        def run(docs: pa.Table) -> pa.Table:
            return trimmed(_table(unit(in_order(docs))))

        return self.docs.groupBy("g").applyInArrow(run, MESSAGES)

    def join(self, messages: DataFrame, unit: Callable[[pa.Table, dict], pa.Table], schema: str) -> DataFrame:
        """Each unit with the messages sent to it, by (kind, bucket); units without documents are left out."""

        def run(docs: pa.Table, sent: pa.Table) -> pa.Table:
            if not docs.num_rows:
                return nothing(schema)
            got = {(k, b): blob for k, b, blob in zip(sent["kind"].to_pylist(), sent["b"].to_pylist(), sent["blob"].to_pylist(), strict=True)}
            return trimmed(unit(in_order(docs), got))

        return self.docs.groupBy("g").cogroup(messages.groupBy("g")).applyInArrow(run, schema)

    def join_ask(self, messages: DataFrame, unit: Callable[[pa.Table, dict], Iterable[Message]]) -> DataFrame:
        return self.join(messages, lambda docs, got: _table(unit(docs, got)), MESSAGES)


def answer(messages: DataFrame, bucket: Callable[[list[tuple[int, bytes]], int], Iterable[Message]]) -> DataFrame:
    """Messages of each bucket, given the (unit, blob) pairs that it was sent."""

    def run(sent: pa.Table) -> pa.Table:
        pairs = sorted(zip(sent["g"].to_pylist(), sent["blob"].to_pylist(), strict=True))
        return trimmed(_table(bucket(pairs, sent["b"][0].as_py())))

    return messages.groupBy("b").applyInArrow(run, MESSAGES)


def trimmed(table: pa.Table) -> pa.Table:
    """``table``, after the worker gave back the memory that it no longer uses."""
    give_back()
    return table


def nothing(schema: str) -> pa.Table:
    """An empty table of a schema."""
    return to_arrow_schema(T.StructType.fromDDL(schema)).empty_table()


def _table(messages: Iterable[Message]) -> pa.Table:
    rows = list(messages)
    columns = list(zip(*rows, strict=True)) if rows else [[], [], [], []]
    return pa.Table.from_arrays([pa.array(columns[0], pa.int32()), pa.array(columns[1], pa.int32()), pa.array(columns[2], pa.int32()), pa.array(columns[3], pa.binary())], names=["g", "b", "kind", "blob"])


def in_order(docs: pa.Table) -> pa.Table:
    return docs.sort_by([("id", "ascending"), ("text", "ascending")]) if docs.num_rows > 1 else docs


def ids_of(docs: pa.Table) -> np.ndarray:
    return docs["id"].combine_chunks().fill_null(NO_ID).to_numpy(zero_copy_only=False).astype(np.int64) if docs.num_rows else np.zeros(0, np.int64)


def unit_of(docs: pa.Table) -> int:
    return docs["g"][0].as_py()


def bits(flags: np.ndarray) -> bytes:
    return np.packbits(flags).tobytes()


def unbits(blob: bytes, n: int) -> np.ndarray:
    return np.unpackbits(np.frombuffer(blob, np.uint8), count=n).astype(bool)


class Spread:
    """Distinct keys of a unit, grouped by bucket; the same keys give the same order in every round."""

    def __init__(self, keys: np.ndarray, buckets: int):
        to = (keys % np.uint64(buckets)).astype(np.int64)
        self.order = np.argsort(to, kind="stable")
        ranked = to[self.order]
        cuts = np.flatnonzero(np.r_[True, ranked[1:] != ranked[:-1]]) if len(ranked) else np.zeros(0, np.int64)
        self.buckets = ranked[cuts].tolist()
        self.bounds = np.r_[cuts, len(ranked)].tolist()

    def parts(self) -> Iterable[tuple[int, np.ndarray]]:
        for k, b in enumerate(self.buckets):
            yield b, self.order[self.bounds[k] : self.bounds[k + 1]]

    def collect(self, got: dict, kind: int) -> np.ndarray:
        """The answered bit of each key."""
        out = np.zeros(len(self.order), bool)
        for b, at in self.parts():
            blob = got.get((kind, b))
            if blob is not None:
                out[at] = unbits(blob, len(at))
        return out


def runs(ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Run-length form of sorted ids."""
    if not len(ids):
        return np.zeros(0, np.int64), np.zeros(0, np.uint32)
    cuts = np.flatnonzero(np.r_[True, ids[1:] != ids[:-1]])
    return ids[cuts], np.diff(np.r_[cuts, len(ids)]).astype(np.uint32)
